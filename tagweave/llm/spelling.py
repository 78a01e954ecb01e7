"""Spelling variants: words within one edit of each other, and the form that each is a variant of.

1. Runs are maximal ``[A-Za-z\\u00C0-\\u00FF]+`` of whole texts, A-Z in lower case.  A planted typing error: where
   ``garble`` divides crc32 of ``<id>:<run>``, the run's code point crc32 % length goes.  A null id garbles nothing.
2. Words are the distinct results of ``letters`` code points or more that occur ``least`` times or more.  Tasks count
   what they read before they hand it on, in tables of bounded size.
3. Even-partition pigeonhole join: a word of l code points has two segments, its first l div 2 and the rest.  One edit
   leaves one segment whole, so two near words of lengths l and l or l + 1 share (l, first segment) as prefixes or
   (l, second segment) as suffixes: each word is indexed under its own two segments and probes those of words that
   are as long, or one shorter, with its own prefix and its suffix, shifted by the difference.
4. Segments of up to ``bucket`` words are paired.  The words of any larger one are joined by what is left of them without
   one code point instead: the same pairs, in rows that grow with the words, for as many words as an alphabet
   has letters share such a key.  A word of l code points makes l rows there.
5. Candidates of both ways are united, and verified: a Levenshtein distance of one code point.
6. A word's form is its near word of the largest number, of ties the first by code point, if that number is twice its own
   or more.  Numbers double along forms, so roots are found by pointer doubling in rounds that grow with the
   logarithm of the logarithm of the largest number.

Keys are 64-bit hashes: equal ones of unequal segments are candidates that fail verification.  Null and empty texts
have no runs.  Repeated rows count as often as they occur.  Empty table: no rows.  Ids are integers or text.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as c

_RUN = re.compile("[a-zÀ-ÿ]+")
_GAP = re.compile(rb"[\x00-@\[-`{-\x7f]")
#: bytes of a text that are read at once, up to the next ASCII character that no word holds
PIECE = 1 << 20
#: words, and code points in them, that a task counts before it hands them on
HELD, HELD_POINTS = 200_000, 1 << 24


def runs(text: bytes):
    """Lower-cased runs of a text in UTF-8, by pieces."""
    at = 0
    while at < len(text):
        gap = _GAP.search(text, at + PIECE)
        end = gap.end() if gap else len(text)
        yield _RUN.findall(text[at:end].lower().decode("utf-8", "replace"))  # bytes in lower case: A-Z alone
        at = end


def occurrences(docs: DataFrame, garble: int = 97, letters: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): partial counts; no shuffle."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def handed(total: dict[str, int]) -> pa.RecordBatch:
        return c.batch(schema, pa.array(list(total), pa.string()), np.fromiter(total.values(), np.int64, len(total)))

    def run(batches):
        total: dict[str, int] = {}
        points = 0
        for b in batches:
            offsets, data = c.utf8(b.column(1))
            for i, doc in enumerate(b.column(0).to_pylist()):
                start = None if doc is None else zlib.crc32(f"{doc}:".encode())
                for found in runs(data[offsets[i] : offsets[i + 1]].tobytes()):
                    for word, n in Counter(found).items():
                        if len(word) < letters:
                            continue
                        if start is not None and (h := zlib.crc32(word.encode(), start)) % garble == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < letters:
                                continue
                        if word in total:
                            total[word] += n
                        else:
                            total[word] = n
                            points += len(word)
                    if len(total) >= HELD or points >= HELD_POINTS:
                        yield handed(total)
                        total, points = {}, 0
        if total:
            yield handed(total)

    return docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(c.tidy(run), "word string, n long")


def vocabulary(counts: DataFrame, least: int = 3) -> DataFrame:
    """(id, word, n, l) of the words that occur often enough; stored."""
    words = counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    return c.stored(words.select(F.monotonically_increasing_id().alias("id"), "word", "n", F.char_length("word").cast("long").alias("l")), "words")


def _segments(length: Column, probe: int) -> list[Column]:
    """The two keys of a word of l code points for words of ``length``, as index (0) or as probe of one longer (1)."""
    half = F.floor(length / 2).cast("int")
    rest = (length - half).cast("int")
    parts = F.substring(F.col("word"), F.lit(1), half), F.substring(F.col("word"), (F.col("l") - rest + 1).cast("int"), rest)
    return [F.struct(F.lit(probe).alias("probe"), F.xxhash64(length, F.lit(k), part).alias("k")) for k, part in enumerate(parts)]


def candidates(words: DataFrame, bucket: int = 64) -> DataFrame:
    """(a, b) of ids: all pairs of words within one edit, and others; once each."""
    keys = c.stored(words.select("id", F.explode(F.array(*_segments(F.col("l"), 0), *_segments(F.col("l") - 1, 1))).alias("e")).select("id", "e.*"), "segments")
    groups = keys.groupBy("k").agg(F.count("*").alias("w"), F.min("probe").alias("least")).filter("w > 1 AND least = 0").select("k", "w")
    shared = c.stored(c.heavy_join(keys, groups, ["k"], "w", keys.count()), "shared")
    few = shared.filter(F.col("w") <= bucket)
    index, every = few.filter("probe = 0").select("k", F.col("id").alias("a")), few.select("k", F.col("id").alias("b"), "probe")
    pairs = index.join(every, "k").filter("probe = 1 OR a < b").select("a", "b")
    return pairs.unionByName(_without_one(shared.filter(F.col("w") > bucket).select("id").distinct().join(words, "id"))).distinct()


def _without_one(words: DataFrame) -> DataFrame:
    """(a, b): words that are equal without one code point at the same place, and words that are another without one."""
    each = words.select("id", "word", "l", F.posexplode(F.expr("transform(sequence(1, cast(l AS int)), i -> xxhash64(concat(substring(word, 1, i - 1), substring(word, i + 1))))")).alias("i", "v"))
    each = c.stored(each.select("id", "l", "i", "v"), "without-one")
    side = lambda x: each.select("l", "i", "v", F.col("id").alias(x))
    replaced = side("a").join(side("b"), ["l", "i", "v"]).filter("a < b").select("a", "b")
    longer = words.select(F.col("id").alias("a"), F.xxhash64("word").alias("v")).join(each.select("v", F.col("id").alias("b")), "v").select("a", "b")
    return replaced.unionByName(longer)


def near(words: DataFrame, bucket: int = 64) -> DataFrame:
    """(id, other, n): each word's near words, from both ends of each verified pair; stored."""
    side = lambda x: words.select(F.col("id").alias(x), F.col("word").alias("w" + x), F.col("n").alias("n" + x))
    pairs = candidates(words, bucket).join(side("a"), "a").join(side("b"), "b").filter(F.levenshtein("wa", "wb", 1) == 1)
    pairs = c.stored(pairs, "near")
    return pairs.select(F.col("a").alias("id"), F.col("wb").alias("other"), F.col("nb").alias("n")).union(pairs.select("b", "wa", "na"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, form) without circles -> (word, root): the end of each path."""
    here = c.stored(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        ahead = here.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        here = c.stored(here.join(ahead, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "roots")
        if not here.filter("moved").count():
            return here.select("word", "root")


def variants(docs: DataFrame, garble: int = 97, letters: int = 5, least: int = 3, factor: int = 2, bucket: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n): a row for each word."""
    words = vocabulary(occurrences(docs, garble, letters, id_col, text_col), least)
    best = near(words, bucket).groupBy("id").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("less"), F.col("other").alias("word"))).alias("best"))
    known = words.join(best, "id", "left").withColumn("form_n", F.when(-F.col("best.less") >= F.col("n") * factor, -F.col("best.less")))
    known = c.stored(known.select("word", F.when(F.col("form_n").isNotNull(), F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n"), "known")
    return known.join(roots(known.filter("form IS NOT NULL")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(c.table(spark, sf_dir, "documents"))


#: crc32 by a table of 256 values, made from its polynomial; near words by what is left without one code point
ORACLE = r"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))) AS t),
runs AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
lowered AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM runs WHERE length(run) >= 5),
counted AS (SELECT doc_id, run, count(*) AS n, hex(encode(concat(doc_id, ':', run))) AS x FROM lowered GROUP BY doc_id, run),
hashed AS (SELECT doc_id, run, n, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(length(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT))), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))) AS h FROM counted, crc),
results AS (SELECT CASE WHEN doc_id IS NOT NULL AND h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) + 2 AS BIGINT)) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM results WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cuts AS (SELECT DISTINCT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM words, unnest(range(1, length(word) + 1)) AS u(i)),
pairs AS (SELECT a.word, b.word AS other, b.n FROM cuts a JOIN cuts b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
    UNION SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.rest = b.word UNION SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, max(n) AS top FROM pairs GROUP BY word),
formed AS (SELECT words.word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 2 * words.n THEN top END AS form_n,
    (SELECT min(other) FROM pairs p WHERE p.word = words.word AND p.n = top AND top >= 2 * words.n) AS form FROM words LEFT JOIN best USING (word)),
path AS (SELECT word, form AS tip FROM formed WHERE form IS NOT NULL UNION ALL SELECT path.word, formed.form FROM path JOIN formed ON formed.word = path.tip WHERE formed.form IS NOT NULL),
ends AS (SELECT path.word, tip AS root FROM path JOIN formed ON formed.word = path.tip WHERE formed.form IS NULL)
SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n FROM formed LEFT JOIN ends USING (word)
"""
