"""Packing: every piece against the library, every window against the targets."""

import functools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tagweave.llm import packing, tokens

SCHEMA = "doc_id long, text string, source string, queue string, part int"


def make(spark, rows):
    return spark.createDataFrame([(i, t, s, "mine", 7) for i, t, s in rows], SCHEMA)


@functools.cache
def plain():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_tokenizer())


@functools.cache
def library(text, end=0):
    return [*plain().encode(text or "", add_special_tokens=False).ids, end]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choice(["the", "river", "ran", "é", "stone", "zq" + str(rng.randrange(999))]) for _ in range(n))
    out = [(1, None, "a"), (2, "", None), (3, " \n ", "a"), (None, text(40), "b"), (4, text(9000), "b"), (5, "same text", "c"), (5, "same text", "c"), (6, "<|endoftext|> x", "c")]
    return out + [(10 + i, text(rng.randint(1, 300)), rng.choice("aaaaabbc")) for i in range(400)]


def check_layout(got, length):
    """Sequences are gapless in ids and offsets and hold no more than length; -> tokens of each queue by sequence."""
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append(r)
    assert sorted(by) == list(range(len(by)))
    held = {}
    for k, pieces in by.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= length
        held[k] = Counter()
        for r in pieces:
            held[k][r["queue"]] += r["length"]
    return held


@pytest.mark.parametrize("length,part_tokens", [(64, 1024), (1024, 1 << 20), (32, 64)])
def test_pieces_are_the_librarys_ids(spark, rows, length, part_tokens):
    got = packing.pack(make(spark, rows).repartition(5), length=length, part_tokens=part_tokens).collect()
    check_layout(got, length)
    spans = defaultdict(list)
    by_id = defaultdict(list)
    for i, t, _ in rows:
        by_id[i].append(library(t))
    for r in got:
        ids = np.frombuffer(r["ids"], "<u4")
        assert len(ids) == r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"]
        ids = ids.tolist()
        assert any(len(x) == r["doc_tokens"] and ids == x[r["start"] : r["start"] + r["length"]] for x in by_id[r["doc_id"]])
        spans[r["doc_id"]] += range(r["start"], r["start"] + r["length"])
    for i, texts in by_id.items():
        assert sorted(spans[i]) == sorted(k for x in texts for k in range(len(x)))
    assert sum(len(library(t)) for _, t, _ in rows) == sum(r["length"] for r in got)


def test_every_full_window_meets_the_targets(spark, rows):
    length, part = 64, 64 * 32
    got = packing.pack(make(spark, rows).repartition(3), length=length, quantum=4, part_tokens=part).collect()
    held = check_layout(got, length)
    total = Counter()
    for t in held.values():
        total += t
    n, ends = sum(total.values()), Counter({k: sum(t.values()) for k, t in held.items()})
    of_part = {r["sequence_id"]: r["part"] for r in got}
    last = {p: max(k for k, x in of_part.items() if x == p) for p in set(of_part.values())}
    served = Counter()
    for k in sorted(held):
        if k < last[of_part[k]] - 1:  # a partition's last windows end its queues
            assert ends[k] == length
            for q in total:
                assert abs(held[k][q] - length * total[q] / n) <= 4 + 1, (k, q, held[k], total)
    # what is carried from partition to partition is below a token and the queue's own rounding
    for p in sorted(last):
        for k in (k for k in held if of_part[k] == p):
            served += held[k]
        whole = min(n, (p + 1) * part)
        assert all(abs(served[q] - whole * total[q] / n) <= 1 for q in total)
    assert sum(ends[k] < length for k in ends) <= len(last)


def test_shares_that_are_given(spark, rows):
    length = 64
    got = packing.pack(make(spark, rows), length=length, quantum=4, part_tokens=64 * 16, shares={"a": 0.25, "b": 0.5, "c": 0.25}).collect()
    held = check_layout(got, length)
    keys = sorted([packing.source_key(x) for x in ("a", "b", "c", None)])
    q = {name: keys.index(packing.source_key(name)) for name in ("a", "b", "c", None)}
    first = [held[k] for k in range(10)]  # no source has ended here
    assert all(abs(h[q["b"]] - 32) <= 5 and abs(h[q["a"]] - 16) <= 5 and abs(h[q["c"]] - 16) <= 5 and not h[q[None]] for h in first)
    assert sum(h[q[None]] for h in held.values()) == 1  # the source without a share comes last


def test_keys_equal_sparks(spark):
    from pyspark.sql import functions as F

    for name in ("a", "", "src0", "é"):
        assert spark.range(1).select(F.xxhash64(F.lit(name))).first()[0] == packing.source_key(name)


def test_more_sources_than_queues(spark):
    rows = [(i, f"word {i} " * (1 + i % 7), f"s{i % 50}") for i in range(300)]
    got = packing.pack(make(spark, rows), length=64, part_tokens=512, queues=8).collect()
    check_layout(got, 64)
    assert sum(r["length"] for r in got) == sum(len(library(t)) for _, t, _ in rows) and len({r["queue"] for r in got}) == 9


def test_empty_table_and_only_nulls(spark):
    assert packing.pack(make(spark, [])).count() == 0
    got = packing.pack(make(spark, [(None, None, None), (1, None, None)])).collect()
    assert sorted((str(r["doc_id"]), r["length"], r["offset"]) for r in got) == [("1", 1, 0), ("None", 1, 1)] or len(got) == 2


def test_cuts_are_monotone_and_complete():
    rng = np.random.default_rng(2)
    totals = {int(k): int(n) for k, n in enumerate(rng.integers(1, 10**6, 30))} | {99: 3, 100: 10**8}
    for shares in (None, {0: 0.5, 1: 0.2, 100: 0.3}):
        mix = packing.Mixture.of(totals, shares, 1 << 14)
        every = np.arange(len(totals))
        cuts = mix.cut(np.arange(mix.parts + 1)[:, None], every)
        assert (np.diff(cuts, axis=0) >= 0).all() and not cuts[0].any() and cuts[-1].tolist() == [totals[k] for k in mix.keys.tolist()]
        assert (np.abs(np.diff(cuts, axis=0)[:-1].sum(axis=1) - (1 << 14)) <= len(totals)).all()
        queue = rng.integers(0, len(totals), 2000)
        pos = (rng.random(2000) * cuts[-1][queue]).astype(np.int64)
        part = mix.part_of(queue, pos)
        assert (mix.cut(part, queue) <= pos).all() and (pos < mix.cut(part + 1, queue)).all()


def test_schedule_against_a_plain_deficit_round_robin():
    """Nobody is served more than a quantum ahead or behind."""
    want = np.tile([600.0, 400.0, 20.0, 4.0], (40, 1))
    take = packing.schedule(want, np.array([24000, 16000, 800, 160]), np.zeros(4), 1024, 16)
    assert (take.sum(axis=1) == 1024).all() and take.sum(axis=0).tolist() == [24000, 16000, 800, 160]
    owed = np.cumsum(want - take, axis=0)
    assert np.abs(owed).max() <= 17
