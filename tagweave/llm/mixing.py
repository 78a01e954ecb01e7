"""A mixture of sources at target weights, in blocks of a fixed number of words.

1. Sizes: words ``[^\\x20\\x09-\\x0D]+`` of whole texts.  Sources are numbered by code point, null last.
2. Targets: ``weights``, repeating by that number, share ``percent`` of all words.  A target stops at ``most`` times its
   source's size; the excess is shared again by weight among the others until none is above.
3. Packing: the texts of a source, by document id, are one sequence of words, cut into blocks of ``block`` words
   and a shorter tail.  Places are prefix sums over ranges of ids, so that no source is in one task.
4. An epoch of a source is each of its full blocks in pseudorandom order, then its tail: every word once.
   A target of e epochs and a rest gives e whole epochs and the first blocks of another, the last one cut, so
   that a source's words are its target's, rounded, and no word is taken more than ``most`` times.
5. Draw: output shards have ``slots`` slots.  Each slot draws a source with the chance of its number of slots in
   all, so that the counts of a shard are multinomial.  Slots of a source are numbered through the shards in order.
   What a source has drawn beyond its number goes, in order, to sources that have drawn too few.
6. A slot's number is mapped through a permutation of its source and epoch (swap-or-not: each round pairs x with
   key - x and a keyed bit of the larger one tells whether to swap them, a bijection for any number of blocks).
7. Slots and pieces of documents are joined by source and block.  A block is in ``most`` + 1 slots at most and holds
   ``block`` pieces at most, so no key is hot.

Only DataFrame and SQL functions; pseudorandom numbers are the first 52 bits of md5, so reruns agree and SQL can do
the same.  Null and empty texts have no words: they have a row, and none is taken.  A null id comes first.  Rows equal
in id and size are interchangeable: each has a row and place of its own.  Empty table: no rows.  Text columns may
have any other columns beside them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as c

WORD = r"[^\x20\x09-\x0D]+"
_ROW = (1 << 33) - 1
#: spans are looked up by cells of this many numbers
CELL = 16


@dataclass(frozen=True)
class Mixture:
    weights: tuple[int, ...] = (3, 1, 2)
    percent: int = 150
    most: int = 2
    block: int = 1024
    slots: int = 4096
    rounds: int = 24
    seed: str = "mix"


def drawn(*parts) -> Column:
    """52 pseudorandom bits of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])), 1, 13), 16, 10).cast("long")


def permutation_keys(n: Column, rounds: int, *seed) -> Column:
    """The key of each round, each under n; n isn't zero."""
    return F.transform(F.sequence(F.lit(1), F.lit(rounds)), lambda r: drawn(*seed, r) % n)


def permuted(x: Column, n: Column, keys: Column, *seed) -> Column:
    """x, from 0 to n - 1, mapped through the permutation of the keys."""

    def step(at, key):
        other = F.pmod(key - at, n)
        return F.when(drawn(*seed, key, F.greatest(at, other)) % 2 == 1, other).otherwise(at)

    return F.aggregate(keys, x, step)


def _numbered(df: DataFrame, order: list[Column], name: str, out: str) -> DataFrame:
    """Adds the row's rank from 0, counted by ranges: a sort, and sums of as many rows as there are ranges."""
    rows = c.stored(df.orderBy(*order).select("*", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW)).alias("_i")), name)
    tops = rows.groupBy("_p").agg(F.count("*").alias("_n")).select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return rows.join(F.broadcast(tops), "_p").select(*df.columns, (F.col("_before") + F.col("_i")).alias(out))


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, key, size); key: the source as text that isn't null."""
    source = F.col(source_col).cast("string")
    return docs.select(F.col(id_col).alias("doc_id"), source.alias("source"), F.coalesce(F.concat(F.lit("="), source), F.lit("")).alias("key"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def targets(rows: DataFrame, m: Mixture = Mixture()) -> DataFrame:
    """(source, key, n, source_size, s, weight, target) of sizes' rows, one for each source; stored."""
    own = rows.groupBy("key").agg(F.first("source").alias("source"), F.count("*").alias("n"), F.sum("size").alias("source_size"))
    own = _numbered(own, [F.col("source").isNull(), F.col("source")], "sources", "s")
    own = c.stored(own.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in m.weights]), (F.col("s") % len(m.weights) + 1).cast("int"))), "weighed")
    level, limit = 0.0, F.col("source_size") * m.most
    total = own.agg(F.sum("source_size")).first()[0] or 0
    while True:  # the level only rises; one row of sums in each round
        under = limit > F.col("weight") * F.lit(level)
        row = own.agg(F.sum(F.when(under, F.col("weight"))).alias("w"), F.sum(F.when(~under, limit)).alias("full")).first()
        if not row["w"]:
            break
        was, level = level, (total * m.percent / 100 - (row["full"] or 0)) / row["w"]
        if level <= was:
            break
    return own.withColumn("target", F.least(limit.cast("double"), F.col("weight") * F.lit(level)))


def plans(own: DataFrame, m: Mixture = Mixture()) -> DataFrame:
    """Adds full (blocks), tail (its words), per (slots of an epoch), k (slots), cut (words of the last slot, null: all); stored."""
    size = F.greatest("source_size", F.lit(1))
    own = own.withColumns({"full": (F.col("source_size") / m.block).cast("long"), "tail": F.col("source_size") % m.block, "want": F.round("target").cast("long")})
    own = own.withColumns({"per": F.col("full") + (F.col("tail") > 0).cast("long"), "rest": F.col("want") % size, "epochs": ((F.col("want") - F.col("want") % size) / size).cast("long")})
    own = own.withColumns({"k": F.col("epochs") * F.col("per") + F.ceil(F.col("rest") / m.block), "cut": F.when(F.col("rest") % m.block > 0, F.col("rest") % m.block)})
    keys = F.transform(F.sequence(F.lit(0), F.lit(m.most)), lambda e: permutation_keys(F.greatest("full", F.lit(1)), m.rounds, m.seed, F.col("s"), e))
    return c.stored(own.withColumn("keys", keys), "plans")


def _counted(df: DataFrame, n: str, out: str, run: int = 4096) -> DataFrame:
    """A row for each number from 0 to n - 1 of each row, in runs dealt over tasks."""
    runs = df.withColumn("_r", F.explode(F.sequence(F.lit(0), F.ceil(F.col(n) / run) - 1))) if run > 1 else df
    runs = runs.filter(F.col(n) > 0).repartition("_r", *[x for x in ("s",) if x in df.columns])
    return runs.withColumn(out, F.explode(F.sequence(F.col("_r") * run, F.least((F.col("_r") + 1) * run, F.col(n)) - 1))).drop("_r")


def _owned(points: DataFrame, at: str, spans: DataFrame, first: str, n: str) -> DataFrame:
    """points, each with the span that holds its number ``at``; spans, of n numbers from first, touch without overlap."""
    cells = _counted(spans.withColumn("_c", F.floor((F.col(first) + F.col(n) - 1) / CELL) - F.floor(F.col(first) / CELL) + 1).filter(F.col(n) > 0), "_c", "_j")
    cells = cells.withColumn("_cell", F.floor(F.col(first) / CELL) + F.col("_j")).drop("_c", "_j")
    return points.withColumn("_cell", F.floor(F.col(at) / CELL)).join(cells, "_cell").filter((F.col(at) >= F.col(first)) & (F.col(at) < F.col(first) + F.col(n))).drop("_cell")


def draw(planned: DataFrame, m: Mixture = Mixture()) -> DataFrame:
    """(shard, s, j): each slot's source and its number there; every j from 0 to k - 1 once."""
    spark = planned.sparkSession
    spans = c.stored(c.running(planned.select("s", "k"), "s", "k", "first"), "spans")
    n = spans.agg(F.sum("k")).first()[0] or 0
    slots = spark.range(n).select(F.floor(F.col("id") / m.slots).alias("shard"), (drawn(m.seed, "draw", F.col("id")) % F.lit(max(n, 1))).alias("v"))
    counts = c.stored(_owned(slots, "v", spans, "first", "k").groupBy("shard", "s").agg(F.count("*").alias("n")), "counts")
    # what each source has drawn against its number, and both kinds of difference summed over sources
    off = spans.select("s", "k").join(counts.groupBy("s").agg(F.sum("n").alias("d")), "s", "left").withColumn("d", F.coalesce("d", F.lit(0)))
    off = off.select("s", "k", "d", F.greatest(F.col("d") - F.col("k"), F.lit(0)).alias("over"), F.greatest(F.col("k") - F.col("d"), F.lit(0)).alias("under"))
    off = c.stored(c.running(c.running(off, "s", "over", "over_first"), "s", "under", "under_first"), "differences")
    base = F.coalesce(F.sum("n").over(Window.partitionBy("s").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    each = counts.withColumn("base", base).join(off.select("s", "k", "over_first"), "s")
    each = c.stored(each.withColumn("j", F.explode(F.expr("sequence(base, base + n - 1)"))), "slots")  # m.slots at most
    spare = each.filter("j >= k").select("shard", (F.col("over_first") + F.col("j") - F.col("k")).alias("v"))
    dealt = _owned(spare, "v", off.select("s", "d", "under", "under_first"), "under_first", "under")
    return each.filter("j < k").select("shard", "s", "j").unionByName(dealt.select("shard", "s", (F.col("d") + F.col("v") - F.col("under_first")).alias("j")))


def blocks(slots: DataFrame, planned: DataFrame, m: Mixture = Mixture()) -> DataFrame:
    """(shard, slot, s, block, words): the block that each slot takes, and how many of its words; slot orders a shard at random."""
    n = planned.agg(F.sum("k")).first()[0] or 0
    df = c.heavy_join(c.stored(slots, "dealt"), planned.select("s", "full", "per", "k", "cut", "keys"), ["s"], "k", n)
    df = df.withColumns({"epoch": F.floor(F.col("j") / F.col("per")), "at": F.col("j") % F.col("per")})
    block = F.when(F.col("at") < F.col("full"), permuted(F.col("at"), F.col("full"), F.element_at("keys", (F.col("epoch") + 1).cast("int")), m.seed, F.col("s"), F.col("epoch"))).otherwise(F.col("full"))
    return df.select("shard", drawn(m.seed, "slot", F.col("s"), F.col("j")).alias("slot"), "s", block.alias("block"), F.when(F.col("j") == F.col("k") - 1, F.col("cut")).alias("words"))


def placed(rows: DataFrame, own: DataFrame) -> DataFrame:
    """rows of sizes with their source's number, size and target, and ``start``, the words of the source before them."""
    df = c.heavy_join(rows, own.select("key", "n", "s", "source_size", "target"), ["key"], "n", rows.count()).drop("n", "key")
    # equal rows are interchangeable, so that they may be dealt over ranges at random
    df = c.stored(df.repartitionByRange("doc_id", "size", F.rand(7)).withColumn("p", F.spark_partition_id()), "ranges")
    before = lambda w: F.coalesce(F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tops = df.groupBy("p", "s").agg(F.sum("size").alias("size"))
    tops = tops.select("p", "s", before(Window.partitionBy("s").orderBy("p")).alias("base"))
    return df.withColumn("start", before(Window.partitionBy("p", "s").orderBy("doc_id", "size"))).join(tops, ["p", "s"]).withColumn("start", F.col("start") + F.col("base")).drop("p", "base")


def mixed(docs: DataFrame, m: Mixture = Mixture(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """The documents and the mixture, both stored.

    documents: (doc_id, source, size, s, source_size, target, start), a row each; (s, start) is unique where size > 0.
    mixture: (shard, slot, s, block, doc_id, start, at, words): words of a document, from its word ``at`` on, that a slot
    takes; sorting a shard by slot, s, block, start gives its text.
    """
    rows = c.stored(sizes(docs, id_col, text_col, source_col), "sizes")
    planned = plans(targets(rows, m), m)
    found = c.stored(placed(rows, planned), "placed")
    slots = blocks(draw(planned, m), planned, m)
    pieces = found.filter("size > 0").select("doc_id", "s", "start", "size", F.explode(F.expr(f"sequence(start div {m.block}, (start + size - 1) div {m.block})")).alias("block"))
    lo, end = F.greatest(F.col("start"), F.col("block") * m.block), F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * m.block)
    cut = F.least(end, F.col("block") * m.block + F.coalesce("words", F.lit(m.block)))
    taken = pieces.join(slots, ["s", "block"]).select("shard", "slot", "s", "block", "doc_id", "start", (lo - F.col("start")).alias("at"), (cut - lo).alias("words"))
    return found, c.stored(taken.filter("words > 0"), "mixture")


def texts(docs: DataFrame, mixture: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(shard, slot, s, block, start, text): the words themselves, space-joined; ids must be unique."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.regexp_extract_all(text_col, F.lit(WORD), F.lit(0)).alias("_w"))
    cut = F.array_join(F.slice("_w", (F.col("at") + 1).cast("int"), F.col("words").cast("int")), " ")
    return mixture.join(own, "doc_id").select("shard", "slot", "s", "block", "start", cut.alias("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, mixture = mixed(c.table(spark, sf_dir, "documents"))
    taken = mixture.groupBy("s", "start").agg(F.sum("words").alias("taken"))
    columns = ["doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "source"]
    empty = found.filter("size = 0").withColumn("taken", F.lit(0))
    return found.filter("size > 0").join(taken, ["s", "start"], "left").select(*columns).unionByName(empty.select(*columns))


_M = Mixture()

#: the same numbers from md5; a target's level is the first, by full targets for each weight, that exceeds no limit
ORACLE = rf"""
WITH RECURSIVE docs AS (SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST) AS r, doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
src AS (SELECT source, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS s, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source),
weighed AS (SELECT *, [3, 1, 2][CAST(s % 3 + 1 AS INT)] AS weight FROM src),
levels AS (SELECT s, {_M.most} * source_size / weight AS ratio,
    (sum(source_size) OVER () * 1.5 - coalesce(sum({_M.most} * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
    FROM weighed WINDOW o AS (ORDER BY {_M.most} * source_size / weight, s)),
level AS (SELECT arg_min(level, {{'r': ratio, 's': s}}) AS level FROM levels WHERE level <= ratio),
aimed AS (SELECT weighed.*, CASE WHEN level IS NULL THEN {_M.most}.0 * source_size ELSE least({_M.most}.0 * source_size, CAST(weight AS DOUBLE) * level) END AS target FROM weighed, level),
part AS (SELECT *, source_size // {_M.block} AS full_blocks, source_size % {_M.block} AS tail, CAST(round(target) AS BIGINT) AS want FROM aimed),
planned AS (SELECT *, full_blocks + CAST(tail > 0 AS BIGINT) AS per, want % greatest(source_size, 1) AS rest, want // greatest(source_size, 1) AS epochs FROM part),
plan AS (SELECT *, epochs * per + (rest + {_M.block - 1}) // {_M.block} AS k FROM planned),
slots AS (SELECT s, per, k, full_blocks, CASE WHEN j = k - 1 AND rest % {_M.block} > 0 THEN rest % {_M.block} ELSE {_M.block} END AS words, j // per AS epoch, j % per AS pos FROM plan, unnest(range(k)) AS t(j)),
walk AS (SELECT s, epoch, pos AS x, full_blocks AS n, words, 0 AS round FROM slots WHERE pos < full_blocks
    UNION ALL
    SELECT s, epoch, CASE WHEN CAST('0x' || substr(md5(concat_ws(':', '{_M.seed}', s, epoch, key, greatest(x, other))), 1, 13) AS BIGINT) % 2 = 1 THEN other ELSE x END, n, words, round + 1
    FROM (SELECT *, (key - x + n) % n AS other FROM (SELECT *, CAST('0x' || substr(md5(concat_ws(':', '{_M.seed}', s, epoch, round + 1)), 1, 13) AS BIGINT) % n AS key FROM walk WHERE round < {_M.rounds}))),
used AS (SELECT s, x AS block, words FROM walk WHERE round = {_M.rounds} UNION ALL SELECT s, full_blocks, words FROM slots WHERE pos >= full_blocks),
lying AS (SELECT docs.*, s, source_size, target, coalesce(sum(size) OVER (PARTITION BY s ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM docs JOIN aimed ON docs.source IS NOT DISTINCT FROM aimed.source),
pieces AS (SELECT r, s, size, start, block FROM lying, unnest(range(CAST(start // {_M.block} AS BIGINT), CAST((start + size - 1) // {_M.block} + 1 AS BIGINT))) AS t(block) WHERE size > 0),
sums AS (SELECT r, sum(greatest(0, least(start + size, block * {_M.block} + words) - greatest(start, block * {_M.block}))) AS taken FROM pieces JOIN used USING (s, block) GROUP BY r)
SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken, source FROM lying LEFT JOIN sums USING (r)
"""
