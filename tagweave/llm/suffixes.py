"""Repeated passages by a sparse suffix array.

A passage is a run of ``least`` (50) words, ``[^\\x20\\x09-\\x0D]+``, that occurs at two
places or more of the corpus, in one document or several.  A word is repeated if it lies
in such a run.

1. Suffixes are kept at minimiser positions only: of each ``least - gram + 1`` consecutive
   grams of ``gram`` (16) words, the one with the smallest hash.  Two equal runs of
   ``least`` words hold the same minimisers, so each repeat keeps a suffix at both places.
2. The kept suffixes are sorted: by their first ``PREFIX`` bytes (words with one space
   between), then by the hash of their gram, then by place.  Neighbours are compared; a
   suffix matches where both the bytes and the hash of the whole gram agree.  Ranges split
   even the most common gram; a range is read as a stream with one row carried over, and
   what it shares with the next is settled by a table of two rows per range.
3. Matches are extended left and right as far as a passage can hold the matched gram, by
   ``least - gram`` words to each side, and the runs of ``least`` words in that reach are
   sorted and compared in the same way.  A pair of neighbours alone doesn't settle this:
   the suffix that shares the most words to the left of a place may be far from it in the
   order, so every place is extended, and the sort finds its partners.  This gives exactly
   the repeated runs, and the first place (smallest doc_id, then position) of each.

Runs are equal if two 64-bit hashes of their words are, 128 bits in all.  Texts that are
equal as a whole (hash, checksum and size) are one text from the start: copies are wholly
repeated.  A word is removed if it lies in a run that isn't the first of its kind, and in
none that is.  Rows equal in id and text count as one document.  A null id orders before
all others; null texts and texts under ``least`` words have no repeats; no rows in, none out.

Ids are integers, or text that Spark casts to them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as c

_NULL = -(1 << 63)
#: bytes of a suffix that its order and the comparison see beside the hash of its gram
PREFIX = 32
_SECOND = np.uint64(0xD6E8FEB86659FD93)
#: kinds of rows that a range hands over: settled there, open until all ranges are seen, or a witness for others only
KNOWN, OPEN, WITNESS = 0, 1, 2
_SPANS = "array<struct<s:int,e:int,removed:int>>"


def text_key(text_col: str = "text"):
    """The columns t, crc and size that tell texts apart."""
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    return {"t": F.xxhash64(text), "crc": F.crc32(text), "size": F.octet_length(text)}


def minimisers(grams: np.ndarray, owner: np.ndarray, window: int) -> np.ndarray:
    """Places of the smallest gram of each window of grams with one owner (the first of equals), sorted."""
    n = len(grams)
    if n < window:
        return np.zeros(0, np.int64)
    # smallest value of runs that double in length, then of two runs that overlap
    low, run = grams.copy(), 1
    while run * 2 <= window:
        low = np.minimum(low[: len(low) - run], low[run:])
        run *= 2
    low = np.minimum(low[: n - window + 1], low[window - run : window - run + n - window + 1])
    valid = owner[: n - window + 1] == owner[window - 1 :]
    # a gram is chosen if it equals the smallest value of a window that holds it: the last valid window
    # with that value is enough to look at, by carrying each window's minimum along its grams
    chosen = np.zeros(n, bool)
    at = np.flatnonzero(valid)
    if not len(at):
        return at
    offset = np.zeros(len(at), np.int64)
    open_ = np.ones(len(at), bool)
    for k in range(window):
        hit = open_.copy()
        hit[open_] = grams[at[open_] + k] == low[at[open_]]
        offset[hit], open_ = k, open_ & ~hit
        if not open_.any():
            break
    chosen[at + offset] = True
    return np.flatnonzero(chosen)


def _grams(seg: np.ndarray, bounds: np.ndarray, k: int):
    """Starts and ends of words, each document's first word, word hashes, gram hashes, and the document of each gram (-1 if it crosses an end)."""
    starts, ends, first = c.words(seg, bounds, c.NON_SPACE)
    hashes = c.word_hashes(seg, starts, ends)
    grams = c.gram_hashes(hashes, k)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(first))[: len(grams)]
    return starts, ends, first, hashes, grams, np.where(np.arange(len(grams)) + k <= first[doc + 1], doc, -1) if len(grams) else doc


def _prefixes(seg: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and bytes of the first PREFIX bytes of the grams at ``at``, one space between words."""
    size = ends - starts
    # a prefix has PREFIX bytes, so it never needs more than PREFIX bytes of a word
    size = np.minimum(size, PREFIX) + 1
    place = np.concatenate([[0], np.cumsum(size)])
    flat = np.repeat(starts - place[:-1], size) + np.arange(place[-1])
    spaced = seg[np.minimum(flat, len(seg) - 1)]
    spaced[place[1:] - 1] = 0x20
    length = np.minimum(place[at + gram] - place[at], PREFIX)
    cut = np.concatenate([[0], np.cumsum(length)])
    return length, spaced[np.repeat(place[at] - cut[:-1], length) + np.arange(cut[-1])]


def sample(docs: DataFrame, least: int, gram: int, id_col: str, text_col: str) -> DataFrame:
    """(id, t, crc, size, n_words, w, h, p) of each document: its minimisers' first bytes, hashes and places."""

    def run(batches):
        for b in batches:
            offsets, data = c.utf8(b.column(4))
            n_words, ws, sizes, hs, ps, cut = [], [], [], [], [], [0]
            for lo, hi in c.chunks(offsets):
                base = offsets[lo]
                seg = data[base : offsets[hi]]
                starts, ends, first, _, grams, doc = _grams(seg, offsets[lo : hi + 1] - base, gram)
                at = minimisers(grams, doc, least - gram + 1)
                at = at[doc[at] >= 0]
                n_words.append(np.diff(first))
                if len(at):
                    length, raw = _prefixes(seg, starts, ends, at, gram)
                    sizes.append(length)
                    ws.append(raw)
                hs.append(grams[at].view(np.int64))
                ps.append(at - first[doc[at]])
                cut += (cut[-1] + np.searchsorted(at, first[1:])).tolist()
            bounds = np.array(cut)
            ends_of = np.cumsum(np.concatenate([[0], *sizes])).astype(np.int32)
            raw = np.concatenate(ws) if ws else np.zeros(0, np.uint8)
            firsts = pa.Array.from_buffers(pa.binary(), len(ends_of) - 1, [None, pa.py_buffer(ends_of.tobytes()), pa.py_buffer(raw.tobytes())])
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(np.concatenate(n_words), pa.int32()), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), firsts), c.list_column(np.concatenate(hs), bounds, pa.int64()), c.list_column(np.concatenate(ps), bounds, pa.int32())], names=["id", "t", "crc", "size", "n_words", "w", "h", "p"])

    keyed = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL)).alias("id"), *[x.alias(k) for k, x in text_key(text_col).items()], F.col(text_col).cast("binary").alias("text"))
    return keyed.mapInArrow(c.tidy(run), "id long, t long, crc long, size int, n_words int, w array<binary>, h array<long>, p array<int>")


def _changes(columns) -> np.ndarray:
    """Of each row but the first: whether it differs from the row before in any of the columns."""
    out = np.zeros(len(columns[0]) - 1, bool)
    for x in columns:
        out |= pc.not_equal(x.slice(1), x.slice(0, len(x) - 1)).to_numpy(zero_copy_only=False)
    return out


def neighbours(df: DataFrame) -> DataFrame:
    """df (w, k, a, b, c): a stored table.  The distinct places (a, b, c) of keys (w, k) that have two or more, and whether each is its key's first.

    Range sort by all columns, then each row against the one before, a batch at a time.  A
    key may go on in the next range, however many ranges it fills: each range hands over
    one row for its first key and one for its last, and those few rows settle what a range
    can't tell.
    """
    names = ["w", "k", "a", "b", "c"]
    place = F.struct("a", "b", "c")

    def run(batches):
        tail = head = None  # the last row so far, and the first row of its key
        several = False  # that key has more than one place here
        opening = True  # that key is the range's first

        def rows(at, first, many, kind):
            n = at.num_rows
            return pa.RecordBatch.from_arrays([*at.columns, pa.array(np.full(n, first)), pa.array(np.full(n, many)), pa.array(np.full(n, kind, np.int32))], names=[*names, "first", "several", "kind"])

        for batch in batches:
            if not batch.num_rows:
                continue
            batch = pa.RecordBatch.from_arrays(batch.columns, names=names)
            both = batch if tail is None else pa.Table.from_batches([tail, batch]).combine_chunks().to_batches()[0]
            new_key = np.ones(both.num_rows, bool)
            new_key[0] = tail is None
            new_key[1:] = _changes(both.columns[:2])
            new_place = new_key.copy()
            new_place[1:] |= _changes(both.columns[2:])
            group = np.cumsum(new_key)  # 0: the key that began before this batch
            more = new_place & ~new_key
            n_more = np.bincount(group[more], minlength=group[-1] + 1)
            if more.any():
                yield rows(both.take(pa.array(np.flatnonzero(more))), False, True, KNOWN)
            if n_more[0] and not several:
                several = True
                if not opening:
                    yield rows(head, True, True, KNOWN)
            starts = np.flatnonzero(new_key)
            if len(starts):
                if opening:
                    if tail is None:
                        head, several = both.take(pa.array(starts[:1])), bool(n_more[1])
                    if tail is not None or len(starts) > 1:
                        yield rows(head, False, several, OPEN)
                        opening = False
                    known = starts[1:] if tail is None else starts
                else:
                    known = starts
                known = known[n_more[group[known]] > 0]
                if len(known):
                    yield rows(both.take(pa.array(known)), True, True, KNOWN)
                if not opening:
                    head, several = both.take(pa.array(starts[-1:])), bool(n_more[-1])
            tail = both.take(pa.array([both.num_rows - 1]))
        if head is not None:
            yield rows(head, False, several, WITNESS if several and not opening else OPEN)

    kinds = {x.name: x.dataType.simpleString() for x in df.schema}
    ordered = df.select(*names).repartitionByRange(*names).sortWithinPartitions(*names)
    compared = c.stored(ordered.mapInArrow(c.tidy(run), ", ".join(f"{x} {kinds[x]}" for x in names) + ", first boolean, several boolean, kind int"), "compared")
    edges = compared.filter(F.col("kind") != KNOWN)  # two rows per range at most
    told = edges.groupBy("w", "k").agg(F.min(place).alias("least"), F.max(place).alias("most"), F.max("several").alias("any")).filter("least <> most OR any").select("w", "k", "least")
    settled = edges.filter(F.col("kind") == OPEN).join(F.broadcast(told), ["w", "k"]).select("a", "b", "c", (place == F.col("least")).alias("first"))
    return compared.filter(F.col("kind") == KNOWN).select("a", "b", "c", "first").unionByName(settled)


def passages(docs: DataFrame, least: int = 50, gram: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, t, n_words, spans, removed): documents with repeated words; spans [s, e) with the number of removed words, and the removed ranges."""
    kept = c.stored(sample(docs, least, gram, id_col, text_col), "suffixes")
    text = ["t", "crc", "size"]
    own = c.stored(kept.select("id", *text, "n_words"), "own")
    classes = c.stored(own.groupBy(*text).agg(F.min("id").alias("rep"), F.max("id").alias("other"), F.count("*").alias("n"), F.max("n_words").alias("n_words")), "texts")
    suffixes = kept.select("t", F.explode(F.arrays_zip("w", "h", "p")).alias("x")).select(F.col("x.w").alias("w"), F.col("x.h").alias("k"), F.col("t").alias("a"), F.lit(0).cast("long").alias("b"), F.col("x.p").alias("c"))
    matched = neighbours(suffixes).groupBy(F.col("a").alias("t")).agg(F.collect_set("c").alias("at"))  # no more than a text's own places
    c.dropped(kept)
    wanted = matched.join(classes.select("t", F.col("rep").alias("id")), "t")
    keyed = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL)).alias("id"), text_key(text_col)["t"].alias("t"), F.col(text_col).cast("binary").alias("text"))

    def extend(batches):
        for b in batches:
            offsets, data = c.utf8(b.column(2))
            places = b.column(3)
            cut, flat = places.offsets.to_numpy(), places.values.to_numpy(zero_copy_only=False)
            for lo, hi in c.chunks(offsets):
                base = offsets[lo]
                _, _, first, hashes, runs, doc = _grams(data[base : offsets[hi]], offsets[lo : hi + 1] - base, least)
                seconds = c.gram_hashes(c.mixed(hashes ^ _SECOND), least)
                near = np.zeros(int(first[-1]) + 1, np.int64)
                of = np.repeat(np.arange(hi - lo), np.diff(cut[lo : hi + 1]))
                at = first[of] + flat[cut[lo] : cut[hi]]
                # every run that holds the whole gram, up to the start of the text
                np.add.at(near, np.maximum(at - (least - gram), first[of]), 1)
                np.add.at(near, at + 1, -1)
                i = np.flatnonzero((np.cumsum(near)[: len(runs)] > 0) & (doc >= 0)) if len(runs) else np.zeros(0, np.int64)
                bounds = np.searchsorted(i, first)
                yield pa.RecordBatch.from_arrays([b.column(0)[lo:hi], b.column(1)[lo:hi], c.list_column(runs[i].view(np.int64), bounds, pa.int64()), c.list_column(seconds[i].view(np.int64), bounds, pa.int64()), c.list_column(i - first[doc[i]], bounds, pa.int32())], names=["id", "t", "h", "g", "p"])

    runs = keyed.join(wanted, ["id", "t"]).select("id", "t", "text", "at").mapInArrow(c.tidy(extend), "id long, t long, h array<long>, g array<long>, p array<int>")
    runs = c.stored(runs.filter("size(h) > 0").select("id", "t", F.explode(F.arrays_zip("h", "g", "p")).alias("x")).select(F.col("x.h").alias("w"), F.col("x.g").alias("k"), F.col("id").alias("a"), F.col("t").alias("b"), F.col("x.p").alias("c")), "runs")
    found = neighbours(runs).groupBy(F.col("a").alias("id"), F.col("b").alias("t")).agg(F.collect_set(F.when(F.col("first"), F.col("c"))).alias("firsts"), F.collect_set(F.when(~F.col("first"), F.col("c"))).alias("others"))
    c.dropped(runs)
    total = own.count()
    told = c.heavy_join(own, classes.drop("n_words"), text, "n", total)
    reps = told.filter("id = rep").dropDuplicates(["id", *text]).join(found, ["id", "t"], "left").filter((F.col("rep") != F.col("other")) & (F.col("n_words") >= least) | F.col("firsts").isNotNull())
    copies = told.filter("id <> rep").filter(F.col("n_words") >= least).withColumns({"firsts": F.lit(None).cast("array<int>"), "others": F.lit(None).cast("array<int>")})

    def settle(batches):
        for b in batches:
            out = []
            for row in b.to_pylist():
                out.append(_settled(row["n_words"], least, row["copied"], row["copy"], row["firsts"], row["others"]))
            kind = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32()), ("removed", pa.int32())]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([x[0] for x in out], kind), pa.array([x[1] for x in out], pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())])))], names=["doc_id", "t", "n_words", "spans", "removed"])

    every = reps.unionByName(copies).select(F.when(F.col("id") != _NULL, F.col("id")).alias("doc_id"), "t", "n_words", (F.col("rep") != F.col("other")).alias("copied"), (F.col("id") != F.col("rep")).alias("copy"), "firsts", "others")
    return every.mapInArrow(c.tidy(settle), f"doc_id long, t long, n_words int, spans {_SPANS}, removed array<struct<s:int,e:int>>")


def _ranges(mask: np.ndarray) -> list[tuple[int, int]]:
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()))


def _settled(n_words: int, least: int, copied: bool, copy: bool, firsts: list[int] | None, others: list[int] | None):
    if copy:
        return [{"s": 0, "e": n_words, "removed": n_words}], [{"s": 0, "e": n_words}]

    def covered(starts):
        mark = np.zeros(n_words + 1, np.int64)
        at = np.array(starts or [], np.int64)
        mark[at] += 1
        mark[at + least] -= 1
        return np.cumsum(mark)[:n_words] > 0

    first, other = covered(firsts), covered(others)
    if copied:
        # every run recurs in a copy; those that aren't known from another text are first here
        rest = np.ones(max(0, n_words - least + 1), bool)
        rest[np.array(others or [], np.int64)] = False
        first = covered(np.flatnonzero(rest).tolist())
    gone = other & ~first
    spans = _ranges(first | other)
    return [{"s": s, "e": e, "removed": int(gone[s:e].sum())} for s, e in spans], [{"s": s, "e": e} for s, e in _ranges(gone)]


def cut_words(text: bytes, ranges: list[tuple[int, int]]) -> bytes:
    """The text without the words of the ranges and the white space after them."""
    data = np.frombuffer(text, np.uint8)
    starts, _, _ = c.words(data, np.array([0, len(data)]), c.NON_SPACE)
    out, at = [], 0
    for s, e in ranges:
        out.append(text[at : starts[s]])
        at = int(starts[e]) if e < len(starts) else len(text)
    return b"".join([*out, text[at:]])


def without_repeats(docs: DataFrame, least: int = 50, id_col: str = "doc_id", text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """The documents' rows without removed words; a text of which no word is left goes.  size_col, if there is one, is counted anew."""
    *key, gone = c.free_names(docs, "_id", "_t", "_removed")
    found = passages(docs, least, id_col=id_col, text_col=text_col).filter("size(removed) > 0").select(F.coalesce("doc_id", F.lit(_NULL)).alias(key[0]), F.col("t").alias(key[1]), F.col("removed").alias(gone)).dropDuplicates(key)
    names, place = docs.columns, docs.columns.index(text_col)
    keyed = docs.withColumns({key[0]: F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL)), key[1]: text_key(text_col)["t"]}).join(found, key, "left").select(*names, gone)

    def run(batches):
        for b in batches:
            removed = b.column(b.num_columns - 1).to_pylist()
            columns, keep = list(b.columns[:-1]), [True] * b.num_rows
            if any(removed):
                texts = columns[place].to_pylist()
                for i, ranges in enumerate(removed):
                    if ranges:
                        raw = cut_words(texts[i].encode(), [(r["s"], r["e"]) for r in ranges])
                        texts[i] = raw.decode()
                        keep[i] = bool(raw.strip(b" \t\n\x0b\x0c\r"))
                columns[place] = pa.array(texts, columns[place].type)
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(keep, pa.bool_()))

    out = keyed.mapInArrow(c.tidy(run), docs.schema)
    if size_col in names:
        out = out.withColumn(size_col, F.coalesce(F.char_length(text_col).cast(docs.schema[size_col].dataType), F.col(size_col)))
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = passages(c.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.explode("spans").alias("x")).select("doc_id", F.col("x.s").cast("long").alias("start_word"), F.col("x.e").cast("long").alias("end_word"), F.col("x.removed").cast("long").alias("removed_words"))


ORACLE = r"""
WITH doc AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i + 1 : i + 50], ' ')) AS g FROM doc, unnest(range(0, len(w) - 49)) AS t(i)),
rep AS (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) = 1 AS first FROM win WHERE g IN (SELECT g FROM win GROUP BY g HAVING count(*) > 1)),
word AS (SELECT doc_id, p, bool_or(first) AS first FROM rep, unnest(range(i, i + 50)) AS t(p) GROUP BY doc_id, p),
island AS (SELECT *, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS k FROM word)
SELECT doc_id, CAST(min(p) AS BIGINT) AS start_word, CAST(max(p) + 1 AS BIGINT) AS end_word, CAST(count(*) FILTER (WHERE NOT first) AS BIGINT) AS removed_words FROM island GROUP BY doc_id, k
"""
