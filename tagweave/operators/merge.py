"""A reviewed seed list joined with the tags of a drawing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..schema import BOX, SEED_FIELDS, TAG_TEXTS, MergeOptions


@dataclass
class Merged:
    """tags: enriched and added; the rest are lists, in the order of their source."""

    tags: DataFrame
    missing: DataFrame  # seed rows that the drawing lacks, which were added
    unmatched: DataFrame  # tags that the list lacks
    duplicates: DataFrame  # tags whose key another had before
    counts: DataFrame  # (drawing_id, matched, added, missing, unmatched, duplicates) of each drawing that has any


def seed_distinct(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with a tag, the first of each key; and a warning for every other row.  row_seq counts data rows from 0."""
    keyed = rows.withColumn("key", S.tag_key(F.col("tag"))).withColumn("r", F.row_number().over(Window.partitionBy("drawing_id", "key", F.col("tag") == "").orderBy("row_seq")))
    n = (F.col("row_seq") + 2).cast("string")
    said = F.when(F.col("tag") == "", F.concat(F.lit("Row "), n, F.lit(": no tag number — skipped."))).otherwise(F.concat(F.lit("Row "), n, F.lit(': duplicate tag "'), "tag", F.lit('" — skipped.')))
    return keyed.filter("tag <> '' AND r = 1").withColumn("tag", S.trimmed(F.col("tag"))).drop("key", "r"), keyed.filter("tag = '' OR r > 1").select("drawing_id", "row_seq", said.alias("warning"))


def _keyed(tags: DataFrame) -> DataFrame:
    keyed = tags.withColumn("_key", S.tag_key(F.col("text")))
    return keyed.withColumn("_first", F.row_number().over(Window.partitionBy("drawing_id", "_key").orderBy("tag_seq")) == 1)


def seed_tags(rows: DataFrame, o: MergeOptions = MergeOptions()) -> DataFrame:
    """Seed rows as tags without a place on the drawing."""
    pattern, text = "^([A-Za-z]+)[\\s-]*([0-9]+)([A-Za-z]*)$", S.trimmed(F.col("tag"))
    given = {c: F.col(c) for c in SEED_FIELDS} | {
        "function_code": F.upper(F.regexp_extract(text, pattern, 1)), "loop_number": F.regexp_extract(text, pattern, 2), "suffix": F.upper(F.regexp_extract(text, pattern, 3)), "type": F.lit("Imported"),
        "state": F.coalesce("state", F.lit(o.imported_state)), "source": F.lit("imported"), "pattern_name": F.lit("Imported"), "origin": F.lit("page"), "updated_at": F.lit(o.updated_at), "updated_by": F.lit(o.reviewer),
    }
    return rows.select("drawing_id", F.col("row_seq").alias("tag_seq"), F.concat(F.lit("import-"), "drawing_id", F.lit("-"), F.col("row_seq").cast("string")).alias("id"), F.col("tag").alias("text"), F.lit(o.page).alias("page"), F.lit(100.0).alias("confidence"), *[F.lit(0.0).alias(c) for c in BOX], *[given.get(c, F.lit("")).alias(c) for c in TAG_TEXTS])


def enriched(tags: DataFrame, seed: DataFrame, o: MergeOptions = MergeOptions()) -> DataFrame:
    """All tags; the first of each key takes its seed row's text, state and what it lacks.  Adds matched."""
    rows = seed.select("drawing_id", S.tag_key(F.col("tag")).alias("_key"), *[F.col(c).alias(f"_{c}") for c in ("tag", "state", *SEED_FIELDS)], F.lit(True).alias("_hit"))
    t = _keyed(tags).join(rows, ["drawing_id", "_key"], "left").withColumn("matched", F.col("_first") & F.coalesce("_hit", F.lit(False)))

    def take(c: str) -> Column:
        return F.when((F.col(f"_{c}") != "") & (F.lit(o.overwrite) | (F.col(c) == "")), F.col(f"_{c}")).otherwise(F.col(c))

    new = {c: take(c) for c in SEED_FIELDS} | {"text": F.col("_tag"), "state": F.coalesce("_state", F.lit(o.imported_state)), "updated_at": F.lit(o.updated_at), "updated_by": F.lit(o.reviewer)}
    if o.split_text:
        pattern, text = "^([A-Za-z]+)[\\s-]*([0-9]+)([A-Za-z]*)$", F.col("_tag")
        new |= {c: F.when(text.rlike(pattern), F.upper(F.regexp_extract(text, pattern, i))).otherwise(F.col(c)) for i, c in enumerate(("function_code", "loop_number", "suffix"), 1)}
    return t.select(*[(F.when(F.col("matched"), new[c]).otherwise(F.col(c)) if c in new else F.col(c)).alias(c) for c in tags.columns], "matched")


def unmatched(tags: DataFrame, seed: DataFrame) -> DataFrame:
    keys = seed.select("drawing_id", S.tag_key(F.col("tag")).alias("_key"))
    return tags.withColumn("_key", S.tag_key(F.col("text"))).join(keys, ["drawing_id", "_key"], "left_anti").drop("_key")


def missing(tags: DataFrame, seed: DataFrame) -> DataFrame:
    keys = tags.select("drawing_id", S.tag_key(F.col("text")).alias("_key"))
    return seed.withColumn("_key", S.tag_key(F.col("tag"))).join(keys, ["drawing_id", "_key"], "left_anti").drop("_key")


def duplicates(tags: DataFrame) -> DataFrame:
    return _keyed(tags).filter("NOT _first").drop("_key", "_first")


def merge(tags: DataFrame, seed: DataFrame, o: MergeOptions = MergeOptions()) -> Merged:
    lacking = missing(tags, seed)
    last = tags.groupBy("drawing_id").agg(F.max("tag_seq").alias("_last"))
    added = seed_tags(lacking, o).join(last, "drawing_id", "left").withColumn("tag_seq", F.col("tag_seq") + F.coalesce("_last", F.lit(0)) + 1).drop("_last")
    taken = enriched(tags, seed, o)
    alone, again = unmatched(tags, seed), duplicates(tags)
    of = lambda df, name, keep=F.lit(True): df.select("drawing_id", F.lit(name).alias("what"), keep.cast("long").alias("one"))
    every = of(taken, "matched", F.col("matched")).unionByName(of(lacking, "added")).unionByName(of(lacking, "missing")).unionByName(of(alone, "unmatched")).unionByName(of(again, "duplicates"))
    counts = every.groupBy("drawing_id").agg(*[F.coalesce(F.sum(F.when(F.col("what") == w, F.col("one"))), F.lit(0)).alias(w) for w in ("matched", "added", "missing", "unmatched", "duplicates")])
    return Merged(taken.drop("matched").unionByName(added.select(*tags.columns)), lacking, alone, again, counts)
