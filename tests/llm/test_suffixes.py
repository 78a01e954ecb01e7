"""The sort of suffixes: neighbours against a plain grouping, first bytes, and suffixes whose hashes collide."""

import collections
import random

import numpy as np
import pytest

from tagweave.llm import common, suffixes


def brute(rows):
    places = collections.defaultdict(set)
    for w, k, a, b, c in rows:
        places[bytes(w), k].add((a, b, c))
    return sorted((*p, p == min(at)) for at in places.values() if len(at) > 1 for p in at)


@pytest.mark.parametrize(("keys", "batch"), [(1, 10_000), (1, 7), (4, 3), (40, 1), (3000, 50)])
def test_neighbours(spark, keys, batch):
    draw = random.Random(keys)
    some = [(bytes([97 + w]), k) for w in range(2) for k in range(keys)]
    rows = [(*some[i], draw.randrange(60), i, draw.randrange(9)) for i in draw.choices(range(len(some)), k=1500)]  # a place has one key
    df = spark.createDataFrame([(bytearray(r[0]), *r[1:]) for r in rows], "w binary, k long, a long, b long, c int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = sorted(map(tuple, suffixes.neighbours(df).distinct().collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == brute(rows)


def test_equal_hashes_of_unequal_suffixes_are_no_match(spark):
    rows = [(bytearray(b"one way"), 7, 1, 0, 0), (bytearray(b"or other"), 7, 2, 0, 0), (bytearray(b"or other"), 7, 3, 0, 5), (bytearray(b"or other"), 8, 4, 0, 0)]
    df = spark.createDataFrame(rows, "w binary, k long, a long, b long, c int")
    assert sorted(map(tuple, suffixes.neighbours(df).collect())) == [(2, 0, 0, True), (3, 0, 5, False)]
    runs = spark.createDataFrame([(5, 6, 1, 0, 0), (5, 7, 2, 0, 0)], "w long, k long, a long, b long, c int")
    assert suffixes.neighbours(runs).count() == 0


def test_first_bytes_ignore_the_kind_of_white_space():
    text = "alpha beta\n\tgamma  delta".encode() + b"x" * 90 + " e f g".encode()
    seg, bounds = np.frombuffer(text + b"second text of the rows", np.uint8), np.array([0, len(text), len(text) + 23])
    starts, ends, first = common.words(seg, bounds, common.NON_SPACE)
    at = np.array([0, 1, 3, 7])
    length, raw = suffixes._prefixes(seg, starts, ends, at, 4)
    cut = np.concatenate([[0], np.cumsum(length)])
    for i, place in enumerate(at):
        want = b"".join(bytes(seg[starts[j] : ends[j]]) + b" " for j in range(place, place + 4))[: suffixes.PREFIX]
        assert bytes(raw[cut[i] : cut[i + 1]]) == want
