"""Sharding of documents: sizes and sums by brute force, balance, places, and what an edited map moves."""

import random
import zlib
from collections import Counter, defaultdict

from tagweave.llm import common, sharding

SCHEMA = "doc_id long, text string, size int, shard string"


def test_shards_of_documents_and_an_edited_map(spark):
    rng = random.Random(6)
    rows = [(i, "x" * rng.randint(0, 400)) for i in range(3000)] + [(7, "same"), (7, "same"), (None, None), (None, "é"), (8, "")]
    docs = spark.createDataFrame([(i, t, 1, "own") for i, t in rows], SCHEMA)
    folder = common.new_path(spark, "map")
    got = sharding.shard(docs, 6, folder, slots=512).collect()
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    places, size = defaultdict(list), Counter()
    for r in got:
        places[r["shard"]].append(r["slot"])
        size[r["shard"]] += r["size"]
    assert sorted(size) == list(range(6)) and all(sorted(p) == list(range(len(p))) for p in places.values())
    even = sum(size.values()) / 6
    assert all(abs(n - even) < 0.02 * even for n in size.values())
    # one shard more: slots that stay keep their rows, and the new shard gets about its share
    of_slot = Counter()
    for r in got:
        of_slot[r["vslot"]] += r["size"]
    now = spark.createDataFrame(list(of_slot.items()), "vslot int, bytes long")
    grown = {r["vslot"]: r["shard"] for r in sharding.edit_map(sharding.read_map(spark, folder, 1), now, 7, folder, 2).collect()}
    moved = sum(r["size"] for r in got if grown[r["vslot"]] != r["shard"])
    after = Counter()
    for r in got:
        after[grown[r["vslot"]]] += r["size"]
    even = sum(size.values()) / 7
    assert sorted(after) == list(range(7)) and all(abs(n - even) < 0.1 * even for n in after.values())
    assert moved <= 1.15 * even and all(grown[r["vslot"]] in (r["shard"], 6) for r in got)
    assert {r["vslot"]: r["shard"] for r in sharding.read_map(spark, folder, 1).collect()} == {r["vslot"]: r["shard"] for r in got}
