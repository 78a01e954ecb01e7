"""The pipeline's stages row by row against brute force; empty tables, nulls alone, clashing names."""

import random
import re
from collections import Counter

import pytest

import corpus_pipeline
from tagweave.llm import common, decontaminate, near_copies, suffixes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = r"[^\x20\x09-\x0D]+"


def make(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t in rows], schema)


def prose(rng, n, pool=3000):
    return [f"w{rng.randrange(pool)}" for _ in range(n)]


def test_repeated_passages_go_word_by_word(spark):
    rng = random.Random(1)
    shared, other = prose(rng, 70), prose(rng, 50)
    rows = [(1, prose(rng, 30) + shared + prose(rng, 30)), (2, shared + other), (3, prose(rng, 20) + shared[10:65] + prose(rng, 5)), (4, prose(rng, 20) + shared[:49]), (5, other + ["x"] + other + prose(rng, 9)), (6, shared[5:60]), (7, prose(rng, 40)), (None, other[:], )]
    texts = [(r[0], rng.choice([" ", "\n"]).join(r[1])) for r in rows] + [(8, None), (9, "")]
    order = sorted(range(len(rows)), key=lambda d: (rows[d][0] is not None, rows[d][0] or 0))
    first: dict = {}
    times: Counter = Counter()
    for d in order:
        for k in range(len(rows[d][1]) - 49):
            first.setdefault(tuple(rows[d][1][k : k + 50]), (d, k))
            times[tuple(rows[d][1][k : k + 50])] += 1
    want = []
    for d, (i, words) in enumerate(rows):
        gone, stay = set(), set()
        for k in range(len(words) - 49):
            run = tuple(words[k : k + 50])
            if times[run] > 1:
                (stay if first[run] == (d, k) else gone).update(range(k, k + 50))
        left = [w for q, w in enumerate(words) if q not in gone - stay]
        if left:
            want.append((i, left))
    want += [(8, []), (9, [])]
    got = [(r["doc_id"], re.findall(WORD, r["text"] or "")) for r in suffixes.without_repeats(make(spark, texts)).collect()]
    key = lambda x: (x[0] is not None, x[0] or 0)
    assert sorted(got, key=key) == sorted(want, key=key) and len(want) < len(texts)


def test_documents_with_a_benchmark_window_go(spark):
    rng = random.Random(2)
    items = [prose(rng, 30), prose(rng, 10), prose(rng, 4), []]
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)] + [(99, None)], "item_id long, text string")
    texts = [prose(rng, 40) + items[0][5:15] + prose(rng, 9), prose(rng, 40) + items[0][5:14] + prose(rng, 9), [w.upper() for w in items[1]], prose(rng, 20) + items[2], items[2][:3], prose(rng, 200)]
    docs = make(spark, [(k, rng.choice([" ", ", ", "\n"]).join(w)) for k, w in enumerate(texts)] + [(50, None), (51, ""), (None, " ".join(items[1]))])
    windows = {tuple(w[k : k + 10]) for w in items for k in range(max(1, len(w) - 9)) if w}

    def hit(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        return any(tuple(w[k : k + len(x)]) == x for x in windows for k in range(len(w) - len(x) + 1))

    want = {r["doc_id"] for r in docs.collect() if not hit(r["text"])}
    for most in (4_000_000, 12):
        got = [r["doc_id"] for r in decontaminate.clean(docs, bench, block_windows=most).collect()]
        assert set(got) == want == {1, 4, 5, 50, 51} and len(got) == len(want)


def test_clashing_names(spark):
    rng = random.Random(3)
    text = prose(rng, 80)
    rows = [(1, " ".join(text)), (2, " ".join([*text[:-1], "changed"])), (3, " ".join(prose(rng, 60)))]
    names = ["_id", "_t", "key", "tok", "removed", "toks", "n", "root"]
    docs = spark.createDataFrame([(i, t, *range(len(names))) for i, t in rows], f"doc_id long, text string, {', '.join(f'{c} int' for c in names)}")
    bench = spark.createDataFrame([(1, rows[2][1])], "item_id long, text string")
    kept = near_copies.one_of_each(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {1, 3}
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {1, 2}


@pytest.mark.parametrize("rows", [[], [(None, None)] * 3, [(1, None), (2, ""), (2, "")]])
def test_stages_on_tables_without_text(spark, rows):
    docs = make(spark, rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.stored(stage(spark, docs, "/root/testdata/sf0.001"), name)
        assert docs.columns == [c.split(" ")[0] for c in SCHEMA.split(", ")]
    assert docs.count() == 0 and corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == 0
