"""Sharding by fixed virtual slots.

Records are hashed into ``slots`` (4096) virtual slots, which never change.  Bytes per
slot are summed, and a slot-to-shard map is made by giving the slots, largest first, to
the shard with the fewest bytes; the map is stored as one version per folder.  When
shards are added or bytes drift, :func:`edit_map` writes the next version: a slot stays
where it is as long as its shard stays under its even share plus a tolerance, so only
what must move does.

A record's place (``slot`` in results, gapless from 0 in its shard) is the number of
records in the shard's earlier virtual slots plus its rank in its own, so a shard, of
any size, is never sorted in one task.

Only DataFrame and SQL functions.  Null texts have no bytes (size 8, crc of nothing);
null ids are hashed by their text alone; repeated rows take places of their own.  A text larger than
an even share makes its shard larger.  Empty table: no rows, and a map of empty slots isn't needed.

Ids are integers, or text that Spark casts to them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as c

SLOTS = 4096


def virtual_slot(*columns: str, slots: int = SLOTS):
    """The virtual slot of a record, from the values of its columns."""
    return F.pmod(F.xxhash64(*columns), F.lit(slots)).cast("int")


def assign(weights: DataFrame, shards: int, tolerance: float = 0.01) -> DataFrame:
    """weights (vslot, bytes, shard or null) of SLOTS rows at most -> (vslot, shard); all in one SQL fold over that bounded list.

    Largest slots first.  A slot stays in its shard while that has room for it under
    (1 + tolerance) x even share; others go to the shard with the fewest bytes.
    """
    rows = weights.agg(F.sort_array(F.collect_list(F.struct((F.col("shard").isNull()).cast("int").alias("fresh"), (-F.col("bytes")).alias("less"), "vslot", "shard"))).alias("rows"), F.sum("bytes").alias("total"))
    limit = f"total * {1 + tolerance} / {shards}"
    fold = f"""
    aggregate(rows, named_struct('load', array_repeat(0L, {shards}), 'to', cast(array() AS array<int>)),
      (s, r) -> named_struct(
        'load', transform(s.load, (b, i) -> IF(i = CASE WHEN r.shard < {shards} AND s.load[r.shard] - r.less <= {limit} THEN r.shard ELSE array_position(s.load, array_min(s.load)) - 1 END, b - r.less, b)),
        'to', concat(s.to, array(cast(CASE WHEN r.shard < {shards} AND s.load[r.shard] - r.less <= {limit} THEN r.shard ELSE array_position(s.load, array_min(s.load)) - 1 END AS int)))),
      s -> transform(s.to, (x, i) -> named_struct('vslot', rows[i].vslot, 'shard', x)))"""
    return rows.select(F.explode(F.expr(fold)).alias("m")).select("m.*")


def write_map(mapped: DataFrame, folder: str, version: int) -> DataFrame:
    mapped.repartition(1).write.parquet(f"{folder}/version={version:06d}")
    return read_map(mapped.sparkSession, folder, version)


def read_map(spark: SparkSession, folder: str, version: int) -> DataFrame:
    return spark.read.schema("vslot int, shard int").parquet(f"{folder}/version={version:06d}")


def edit_map(old: DataFrame, bytes_now: DataFrame, shards: int, folder: str, version: int, tolerance: float = 0.01) -> DataFrame:
    """The next version for bytes_now (vslot, bytes) and a number of shards that may have grown or shrunk."""
    joined = bytes_now.join(F.broadcast(old.select("vslot", "shard")), "vslot", "full").select("vslot", F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"), "shard")
    return write_map(assign(joined, shards, tolerance), folder, version)


def shard(docs: DataFrame, shards: int = 24, folder: str | None = None, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot, vslot): one row per document; writes version 1 of the map."""
    spark = docs.sparkSession
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))
    # ids are unique as a rule; where they aren't, the text tells rows apart, so no id fills a slot alone unless rows are equal
    rows = c.stored(narrow.select("doc_id", (F.octet_length("text").cast("long") + 8).alias("size"), F.crc32("text").alias("text_crc32"), virtual_slot("doc_id", "text", slots=slots).alias("vslot")), "sizes")
    weights = c.stored(rows.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")), "slots")
    mapped = write_map(assign(weights.select("vslot", "bytes", F.lit(None).cast("int").alias("shard")), shards), folder or c.new_path(spark, "shard-map"), 1)
    # `slots` rows at most from here on: a bound that doesn't grow with the data
    first = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    bases = weights.join(F.broadcast(mapped), "vslot").select("vslot", "shard", F.coalesce(F.sum("n").over(first), F.lit(0)).alias("base"))
    rank = F.row_number().over(Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size"))
    return rows.withColumn("rank", rank).join(F.broadcast(bases), "vslot").select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("rank") - 1).cast("long").alias("slot"), "vslot")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shard(c.table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

