"""Mixing against brute force: sizes, targets, permutations, slots, taken words and the words themselves."""

import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tagweave.llm import mixing

SCHEMA = "doc_id long, text string, source string, size int, s string, target string"
SMALL = mixing.Mixture(block=16, slots=32)


def make(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, "own", "x") for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    text = lambda n: rng.choice([" ", "\n", "\t "]).join(f"w{rng.randrange(50)}" for _ in range(n))
    out = [(i, text(rng.randint(0, 60)), rng.choice(["b", "a", "é", "hot", "hot", "hot"])) for i in range(400)]
    out += [(1000, text(5000), "hot"), (1001, None, "a"), (1002, "", "b"), (1003, " \x0b ", None), (1004, text(7), None), (1005, "one", "tiny"), (1006, "a b c", "tiny"), (1007, None, "none")]
    return out + [(1004, text(7), None), (7, out[7][1], out[7][2]), (None, text(20), "a"), (None, text(20), "a")]


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def wanted(rows, weights=(3, 1, 2), percent=150, most=2):
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += size(t)
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, got, open_ = Fraction(sum(sizes.values()) * percent, 100), {}, set(names)
    while open_:
        level = (total - sum(got.values())) / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > most * sizes[s]}
        if not over:
            return sizes, got | {s: level * weight[s] for s in open_}
        got |= {s: Fraction(most * sizes[s]) for s in over}
        open_ -= over
    return sizes, got


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64, 1000])
def test_permutations_are_bijections_and_differ(spark, n):
    def mapped(seed):
        keys = mixing.permutation_keys(F.lit(n).cast("long"), 24, "t", seed)
        return [r[0] for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), keys, "t", seed).alias("x")).collect()]

    a, b = mapped(1), mapped(2)
    assert sorted(a) == sorted(b) == list(range(n)) and (n < 17 or (a != b and a != list(range(n))))
    if n == 1000:
        assert abs(sum(abs(x - i) for i, x in enumerate(a)) / n - n / 3) < n / 10


@pytest.mark.parametrize("m", [SMALL, mixing.Mixture(), mixing.Mixture(block=1, slots=7)])
def test_targets_slots_and_words(spark, rows, m):
    docs = make(spark, rows)
    sizes, target = wanted(rows)
    found, mixture = mixing.mixed(docs, m)
    found = found.collect()
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in found) == Counter((i, s, size(t)) for i, t, s in rows)
    assert all(r["source_size"] == sizes[r["source"]] and abs(r["target"] - float(target[r["source"]])) < 1e-6 for r in found)
    starts = defaultdict(list)
    for r in found:
        if r["size"]:
            starts[r["source"]].append((r["start"], r["size"], r["doc_id"]))
    of = {(r["s"], r["start"]): r for r in found if r["size"]}
    for s, places in starts.items():
        places.sort()
        assert [a for a, _, _ in places] == [sum(n for _, n, _ in places[:k]) for k in range(len(places))]
        ids = [i for _, _, i in places]
        assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    taken, uses, shards = Counter(), Counter(), defaultdict(set)
    for r in mixture.collect():
        doc = of[r["s"], r["start"]]
        assert 0 <= r["at"] and r["at"] + r["words"] <= doc["size"] and (r["start"] + r["at"]) // m.block == r["block"]
        taken[doc["source"]] += r["words"]
        for k in range(r["at"], r["at"] + r["words"]):
            uses[r["s"], r["start"], k] += 1
        shards[r["shard"]].add((r["slot"], r["s"]))
    assert all(taken[s] == round(target[s] + Fraction(1, 10**9)) for s in sizes)
    assert max(uses.values()) == 2
    # a source that is taken 1.5 times is taken once or twice in each word
    for (s, start, _), n in uses.items():
        t = target[of[s, start]["source"]] / sizes[of[s, start]["source"]]
        assert t.__floor__() <= n <= t.__ceil__()
    assert all(len(x) == m.slots for k, x in shards.items() if k < max(shards))


def test_counts_of_a_shard_vary_as_multinomial_draws_do(spark):
    rng = random.Random(6)
    docs = make(spark, [(i, "x " * rng.randint(50, 70), "abc"[i % 3]) for i in range(600)])
    _, mixture = mixing.mixed(docs, mixing.Mixture(block=8, slots=256))
    counts = mixture.select("shard", "slot", "s").distinct().groupBy("shard", "s").count().collect()
    shards = max(r["shard"] for r in counts)
    firsts = [r["count"] for r in counts if r["s"] == 0 and r["shard"] < shards]
    assert len(firsts) > 15 and 90 < sum(firsts) / len(firsts) < 170
    mean = sum(firsts) / len(firsts)
    spread = sum((x - mean) ** 2 for x in firsts) / len(firsts)
    assert 0.2 < spread / (mean * (1 - mean / 256)) < 3


def test_reruns_agree_and_texts_are_the_words(spark, rows):
    unique = [r for k, r in enumerate(rows) if r[0] is not None and r[0] not in {x[0] for x in rows[:k]}]
    docs = make(spark, unique)
    _, a = mixing.mixed(docs, SMALL)
    _, b = mixing.mixed(docs.repartition(7), SMALL)
    keys = ["shard", "slot", "s", "block", "doc_id", "start", "at", "words"]
    first = sorted(tuple(r[k] for k in keys) for r in a.collect())
    assert first == sorted(tuple(r[k] for k in keys) for r in b.collect())
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t, _ in unique}
    got = {(r["shard"], r["slot"], r["block"], r["start"]): r["text"] for r in mixing.texts(docs, a).collect()}
    assert len(got) == len(first)
    assert all(got[shard, slot, block, start] == " ".join(words[doc][at : at + n]) for shard, slot, _, block, doc, start, at, n in first)


def test_tables_without_words(spark):
    for rows in ([], [(1, None, None), (2, "", "a"), (2, "", "a")]):
        found, mixture = mixing.mixed(make(spark, rows))
        assert found.count() == len(rows) and mixture.count() == 0
