"""Votes over repeated readings of a bubble, and what a bubble yields."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import TAG_TEXTS

BUBBLE = ("drawing_id", "bubble_id")


def classified(reads: DataFrame) -> DataFrame:
    """reads (drawing_id, bubble_id, variant, read_seq, text, confidence) with kind func or loop; others go."""
    token = F.regexp_replace(F.upper("text"), "[^A-Z0-9]", "")
    return reads.withColumn("token", token).withColumn("kind", F.when(F.col("token").rlike("^[A-Z]{1,5}$"), "func").when(F.col("token").rlike("^[0-9]{2,5}[A-Z]?$"), "loop")).filter("kind IS NOT NULL")


def votes(reads: DataFrame) -> DataFrame:
    """Each token counts once for each variant, with its first confidence."""
    once = classified(reads).groupBy(*BUBBLE, "kind", "variant", "token").agg(F.min_by("confidence", F.struct("variant", "read_seq")).alias("confidence"), F.min(F.struct("variant", "read_seq")).alias("seen"))
    return once.groupBy(*BUBBLE, "kind", "token").agg(F.count("*").alias("votes"), F.sum("confidence").alias("confidence_sum"), F.min("seen").alias("seen"))


def winners(reads: DataFrame) -> DataFrame:
    """Most votes, then the longer token, then the one seen first."""
    best = Window.partitionBy(*BUBBLE, "kind").orderBy(F.desc("votes"), F.desc(F.length("token")), "seen")
    return votes(reads).withColumn("r", F.row_number().over(best)).filter("r = 1").select(*BUBBLE, "kind", "token", "votes", (F.col("confidence_sum") / F.col("votes")).alias("confidence"))


def halves(reads: DataFrame) -> DataFrame:
    """One row per bubble that was read at all: func, loop (null if unread) and their confidences."""
    pick = lambda kind, col: F.max(F.when(F.col("kind") == kind, F.col(col)))
    return winners(reads).groupBy(*BUBBLE).agg(pick("func", "token").alias("func"), pick("func", "confidence").alias("func_confidence"), pick("loop", "token").alias("loop"), pick("loop", "confidence").alias("loop_confidence"))


def bubble_words(circles: DataFrame, reads: DataFrame) -> DataFrame:
    """Two words, one above the other, of each circle (drawing_id, bubble_id, page, cx, cy, r) whose halves were both read."""
    both = circles.join(halves(reads).filter("func IS NOT NULL AND loop IS NOT NULL"), [*BUBBLE])
    word = lambda half, text, conf, wide, top, low: F.struct(F.lit(half).alias("half"), F.col(text).alias("text"), F.col(conf).alias("confidence"), (F.col("cx") - F.col("r") * wide).alias("x0"), (F.col("cy") + F.col("r") * top).alias("y0"), (F.col("cx") + F.col("r") * wide).alias("x1"), (F.col("cy") + F.col("r") * low).alias("y1"))
    rows = both.select("drawing_id", "page", "bubble_id", F.explode(F.array(word(0, "func", "func_confidence", 0.7, -0.65, -0.05), word(1, "loop", "loop_confidence", 0.85, 0.05, 0.65))).alias("w"))
    return rows.select("drawing_id", (F.col("bubble_id") * 2 + F.col("w.half")).cast("long").alias("word_seq"), "page", "w.text", "w.confidence", "w.x0", "w.y0", "w.x1", "w.y1", F.lit("bubble").alias("origin"))


def unread(circles: DataFrame, reads: DataFrame) -> DataFrame:
    """Circles of which a half or both weren't read, with what was."""
    h = circles.join(halves(reads), [*BUBBLE], "left").filter("func IS NULL OR loop IS NULL")
    return h.select("drawing_id", "bubble_id", "page", *[(F.col(c) + F.col("r") * s).alias(n) for n, c, s in (("x0", "cx", -1.0), ("y0", "cy", -1.0), ("x1", "cx", 1.0), ("y1", "cy", 1.0))], F.coalesce("func", F.lit("")).alias("partial_func"), F.coalesce("loop", F.lit("")).alias("partial_loop"))


def placeholders(rows: DataFrame, reviewer: str = "") -> DataFrame:
    """Unread bubbles as illegible tags, so that none is lost from the list."""
    f, n = F.col("partial_func"), F.col("partial_loop")
    partial = F.when(f != "", f).otherwise(n)
    text = F.when((f == "") & (n == "") , "").otherwise(F.concat(F.when(f == "", "?").otherwise(f), F.lit("-"), F.when(n == "", "?").otherwise(n)))
    detail = F.when(partial == "", "").otherwise(F.concat(F.lit(' Only "'), partial, F.lit('" could be read.')))
    note = F.concat(F.lit("Instrument bubble detected here, but its tag could not be read in full."), detail, F.lit(" Zoom in and complete it."))
    given = {"function_code": f, "loop_number": n, "type": F.lit("Unreadable bubble"), "state": F.lit("illegible"), "source": F.lit("auto"), "pattern_name": F.lit("Unreadable bubble"), "origin": F.lit("bubble"), "notes": note, "updated_by": F.lit(reviewer)}
    seq = F.row_number().over(Window.partitionBy("drawing_id").orderBy("page", "bubble_id")).cast("long")
    return rows.withColumn("tag_seq", seq).select("drawing_id", "tag_seq", F.concat(F.lit("unread-"), "drawing_id", F.lit("-"), F.col("bubble_id").cast("string")).alias("id"), text.alias("text"), "page", F.lit(0.0).alias("confidence"), "x0", "y0", "x1", "y1", *[given.get(c, F.lit("")).alias(c) for c in TAG_TEXTS])
