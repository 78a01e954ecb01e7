"""Benchmark decontamination by a broadcast set of test n-grams.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z became a-z.  A benchmark item's
windows are all runs of ``window`` (10) of its words; an item of fewer words, but not
none, is one window.  A document word is hit if it lies in any occurrence of a window.

Documents are scanned once per block of the benchmark.  A block holds at most
``block_windows`` windows (120 MB), which bounds what is broadcast whatever the benchmark's size;
hits of several blocks are merged by document.  Window hashes find candidates; each hit
is verified by its words.

Null or wordless texts have no words and no hits; repeated documents each get a row
(several blocks need a distinct row number, which is then made); a null doc_id stays.
Benchmark items without an id hit like any other and count, together, as one item that
no list of ids names.

Ids are integers, or text that Spark casts to them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as c

_NO_ID = -(1 << 63)
_FOUND = "doc_id long, n_words long, spans array<struct<s:long,e:long>>, items array<long>"


def _keys(seg: np.ndarray, bounds: np.ndarray):
    starts, ends, first = c.words(seg, bounds, c.ALNUM)
    return starts, ends, first, c.word_hashes(seg, starts, ends)


def index_block(items: list[tuple[int, str]], window: int) -> dict:
    """Windows of the items: by length, a sieve, hashes in order, and where each window's words lie in the items' words; about 30 bytes a window.

    Returns {"words": all items' words, space-joined, k: (sieve, hashes, starts, ends, item_ids), ...}.
    """
    held, size, by_length = [], 0, {}
    for item, text in items:
        seg = c.LOWER[np.frombuffer((text or "").encode(), np.uint8)]
        starts, ends, _, hashes = _keys(seg, np.array([0, len(seg)]))
        n, raw = len(starts), seg.tobytes()
        if not n:
            continue
        held.append(b" ".join(raw[s:e] for s, e in zip(starts.tolist(), ends.tolist())))
        to = size + np.cumsum(ends - starts + 1) - 1  # ends of the words as joined
        k = min(window, n)
        by_length.setdefault(k, []).append((c.gram_hashes(hashes, k), (to - (ends - starts))[: n - k + 1], to[k - 1 :], np.full(n - k + 1, _NO_ID if item is None else item, np.int64)))
        size += len(held[-1]) + 1
    out: dict = {"words": b" ".join(held)}
    for k, rows in by_length.items():
        keys, *places = (np.concatenate(x) for x in zip(*rows))
        order = np.argsort(keys, kind="stable")
        sieve = np.zeros(1 << 20, bool)
        sieve[(keys >> np.uint64(44)).astype(np.int64)] = True
        out[k] = (sieve, keys[order], *(x[order] for x in places))
    return out


def scan(offsets: np.ndarray, data: np.ndarray, index: dict) -> Iterator[tuple[int, list[tuple[int, int]], set[int]]]:
    """Words, merged spans of hit words and items found, of each document."""
    for lo, hi in c.chunks(offsets):
        base = offsets[lo]
        seg, bounds = c.LOWER[data[base : offsets[hi]]], offsets[lo : hi + 1] - base
        starts, ends, first, hashes = _keys(seg, bounds)
        spans: list[list[tuple[int, int]]] = [[] for _ in range(hi - lo)]
        items: list[set[int]] = [set() for _ in range(hi - lo)]
        for k, (sieve, keys, begins, finishes, of) in ((k, x) for k, x in index.items() if k != "words"):
            grams = c.gram_hashes(hashes, k)
            at = np.flatnonzero(sieve[(grams >> np.uint64(44)).astype(np.int64)]) if len(grams) else np.zeros(0, np.int64)
            left, right = np.searchsorted(keys, grams[at], "left"), np.searchsorted(keys, grams[at], "right")
            doc = np.searchsorted(first, at, "right") - 1
            hit = (right > left) & (at + k <= first[doc + 1])
            for i, d, x, y in zip(at[hit].tolist(), doc[hit].tolist(), left[hit].tolist(), right[hit].tolist()):
                words = b" ".join(seg[starts[j] : ends[j]].tobytes() for j in range(i, i + k))
                found = {int(of[q]) for q in range(x, y) if index["words"][begins[q] : finishes[q]] == words}
                if found:
                    items[d] |= found
                    spans[d].append((int(i - first[d]), int(i - first[d] + k)))
        for d in range(hi - lo):
            yield int(first[d + 1] - first[d]), merged(spans[d]), items[d]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def blocks(benchmark: DataFrame, window: int, block_windows: int) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of at most ``block_windows`` windows (one item alone may have more), streamed through the driver."""
    held, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("long"), "text").filter("text IS NOT NULL").toLocalIterator():
        n = len(row[1]) // 2 + 1  # no more words, so no more windows, than this
        if held and size + n > block_windows:
            yield held
            held, size = [], 0
        held.append((row[0], row[1]))
        size += n
    yield held


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_windows: int = 4_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, spans, items): one row per document; spans are disjoint word ranges [s, e), items sorted."""
    spark = docs.sparkSession
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    several = list(_lookahead(blocks(benchmark, window, block_windows), 2))
    if len(several) > 1:
        # rows are told apart by a number that is written, for it must not change between scans
        narrow = c.stored(narrow.withColumn("row", F.monotonically_increasing_id()), "numbered")

    def scanned(items):
        shared = spark.sparkContext.broadcast(index_block(items, window))

        def run(batches):
            index = shared.value
            kind = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))
            for b in batches:
                rows = list(scan(*c.utf8(b.column(1)), index))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([[{"s": s, "e": e} for s, e in r[1]] for r in rows], kind), pa.array([[None if x == _NO_ID else x for x in sorted(r[2])] for r in rows], pa.list_(pa.int64())), *b.columns[2:]],
                    names=["doc_id", "n_words", "spans", "items", *["row"] * (b.num_columns - 2)],
                )

        return narrow.mapInArrow(c.tidy(run), _FOUND + (", row long" if len(several) > 1 else ""))

    if len(several) == 1:
        return scanned(several[0])
    parts = [c.stored(scanned(items), "hits") for items in blocks(benchmark, window, block_windows)]
    together = parts[0]
    for p in parts[1:]:
        together = together.unionByName(p)
    joined = together.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    union = """aggregate(spans, cast(array() AS array<struct<s:bigint,e:bigint>>), (a, x) -> CASE WHEN size(a) > 0 AND element_at(a, -1).e >= x.s
        THEN concat(slice(a, 1, size(a) - 1), array(struct(element_at(a, -1).s AS s, greatest(element_at(a, -1).e, x.e) AS e))) ELSE concat(a, array(x)) END)"""
    return joined.select("doc_id", "n_words", F.expr(union).alias("spans"), "items")


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_windows: int = 4_000_000, text_col: str = "text") -> DataFrame:
    """The documents' rows that hold no window of the benchmark, with all their columns; no shuffle, a scan per block."""
    spark, place = docs.sparkSession, docs.columns.index(text_col)
    for k, items in enumerate(blocks(benchmark, window, block_windows)):
        shared = spark.sparkContext.broadcast(index_block(items, window))

        def run(batches, shared=shared):
            for b in batches:
                yield b.filter(pa.array([not spans for _, spans, _ in scan(*c.utf8(b.column(place)), shared.value)], pa.bool_()))

        docs = (c.stored(docs, "clean") if k else docs).mapInArrow(c.tidy(run), docs.schema)
    return docs


def _lookahead(it, n):
    for _, x in zip(range(n), it):
        yield x


def remove_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans and what lies between them."""
    data = np.frombuffer(text, np.uint8)
    starts, ends, _ = c.words(c.LOWER[data], np.array([0, len(data)]), c.ALNUM)
    out, at = [], 0
    for s, e in spans:
        out.append(text[at : starts[s]])
        at = int(ends[e - 1])
    return b"".join([*out, text[at:]])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(c.table(spark, sf_dir, "documents"), c.table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["e"] - x["s"])
    listed = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(listed.cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


ORACLE = r"""
WITH item AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
gram AS (SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS g FROM item, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS t(i) WHERE len(w) > 0),
size AS (SELECT DISTINCT k FROM gram),
doc AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
win AS (SELECT r, k, i, array_to_string(w[i : i + k - 1], ' ') AS g FROM doc, size, unnest(range(1, len(w) - k + 2)) AS t(i)),
hit AS (SELECT r, win.k, i, item_id FROM win JOIN gram ON win.g = gram.g AND win.k = gram.k),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM hit, unnest(range(i, i + k)) AS t(p) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS listed FROM (SELECT DISTINCT r, item_id FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""
