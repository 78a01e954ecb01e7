"""Steps that grow with the input: what they broadcast, and what one task takes."""

import pytest

from tagweave import tables
from tagweave.llm.tokens import Encoder, default_tokenizer
from tagweave.operators import circles
from tagweave.plans import queries

SMALL = "/root/testdata/sf0.001"


def plans(spark, monkeypatch, name):
    """The plans of all tables that a query writes on its way, and its own."""
    seen, real = [], tables.stored
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(tables, "stored", lambda df, *a: (seen.append(plan(df)), real(df, *a))[1])
    df = queries.QUERIES[name](spark, SMALL)
    return [*seen, plan(df)]


@pytest.mark.parametrize("name", ["correction_kinds", "corrections", "tags_reconciled"])
def test_joins_of_growing_tables_broadcast_nothing(spark, monkeypatch, name):
    found = plans(spark, monkeypatch, name)
    assert any("SortMergeJoin" in p for p in found) and not any("Broadcast" in p for p in found)


def test_votes_are_counted_by_as_many_tasks_as_they_ask_for(spark):
    edges = spark.sql(queries._EDGES, part=spark.read.parquet(f"{SMALL}/part.parquet"))
    one, many = circles.hough_votes(edges, 18, 22), circles.hough_votes(edges, 18, 22, task_votes=100)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.rindex("HashAggregate") < plan.index("Exchange")  # no counts before the shuffle
    assert many.rdd.getNumPartitions() == -(-edges.count() * 10 // 100)
    assert sorted(one.collect()) == sorted(many.collect()) and one.count() > 0


def test_circles_are_settled_from_votes_dealt_by_number(spark, monkeypatch):
    found = plans(spark, monkeypatch, "circle_suppression")
    assert any("REPARTITION_BY_NUM" in p for p in found) and not any("Broadcast" in p for p in found)



def test_pieces_stay_known_between_tasks():
    coder = Encoder(default_tokenizer(), plain=True)
    text = " ".join(f"w{i:06d}q" for i in range(120_000))  # as many distinct pieces
    first = coder.encode([text])
    n = len(coder.known)
    Encoder._own["test", True] = coder
    Encoder.rest()
    del Encoder._own["test", True]
    assert len(coder.known) == n > 100_000 and coder.encode([text]) == first


def test_a_later_task_asks_the_library_for_new_pieces_only():
    coder = Encoder(default_tokenizer(), plain=True)
    text = " ".join(f"w{i:06d}q" for i in range(250_000))
    first = coder.encode([text])
    Encoder._own["test", True] = coder
    Encoder.rest()
    del Encoder._own["test", True]
    model, asked = coder.model, []
    coder.model = type("Model", (), {"tokenize": lambda self, name: (asked.append(name), model.tokenize(name))[1]})()
    assert coder.encode([text, text + " new"]) == [first[0], first[0] + coder.whole(" new")] and len(asked) == 1


def test_pieces_with_controls_are_the_librarys():
    coder = Encoder(default_tokenizer(), plain=True)
    texts = ["\x1cabc d\x1def", " \x1fa1 b", "a\x1e  b c9\x1d", "'sab's é\x1céa 12ab", "  abc\n\n d", " ", ""]
    assert [coder.encode([t]) for t in texts * 2] == [[coder.whole(t)] for t in texts * 2]
