"""Words to tags: pattern match, stacked pairs, overlap suppression, projections."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import tables
from ..functions import scalars as S
from ..schema import BOX, Settings, TagPattern

_NO_MATCH = "struct<n:int,rank:int,text:string,pattern_id:string,pattern_name:string,func:string,loop:string,suffix:string>"
PAGE = ("drawing_id", "page")


def group_numbers(pattern: str) -> tuple[str, dict[str, int]]:
    """The pattern with names that Java accepts, and the number of each named group."""
    names, n, i, in_class = {}, 0, 0, False
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            i += 1
        elif ch in "[]":
            in_class = ch == "["
        elif ch == "(" and not in_class:
            named = re.match(r"\(\?<([A-Za-z_$][\w$]*)>", pattern[i:])
            if named or pattern[i + 1 : i + 2] != "?":
                n += 1
            if named:
                names[named[1]] = n
        i += 1
    return re.sub(r"\(\?<([A-Za-z_$][\w$]*)>", lambda m: "(?<" + re.sub(r"[^A-Za-z0-9]", "x", m[1]) + ">", pattern), names


def usable(spark: SparkSession, patterns: tuple[TagPattern, ...]) -> list[TagPattern]:
    """Enabled patterns that compile; others are left out silently."""
    out = []
    for p in patterns:
        if not p.enabled:
            continue
        try:
            spark.sparkContext._jvm.java.util.regex.Pattern.compile(group_numbers(p.pattern)[0])
        except Exception:  # the JVM's PatternSyntaxException
            continue
        out.append(p)
    return out


def best_match(text: Column, patterns: list[TagPattern], coverage: float) -> Column:
    """The longest first match that covers enough of the text, the earlier pattern on ties; null if none."""
    upper, found = F.upper(text), []
    for rank, p in enumerate(patterns):
        regex, groups = group_numbers(p.pattern)
        part = lambda k, regex=regex, groups=groups: F.regexp_extract(upper, regex, groups[k]) if k in groups else F.lit("")
        whole = F.regexp_extract(upper, regex, 0)
        match = F.struct(F.length(whole).alias("n"), F.lit(-rank).alias("rank"), whole.alias("text"), F.lit(p.id).alias("pattern_id"), F.lit(p.name).alias("pattern_name"), part("func").alias("func"), part("loop").alias("loop"), part("suffix").alias("suffix"))
        found.append(F.when((whole != "") & (F.length(whole) / F.greatest(F.length(upper), F.lit(1)) >= coverage), match))
    return F.array_max(F.array_compact(F.array(*found))) if found else F.lit(None).cast(_NO_MATCH)


def _matched(df: DataFrame, text: Column, s: Settings) -> DataFrame:
    """Rows whose text matches, with the match m: a generator, so that it is computed once, not in a filter and again in a projection."""
    return df.select("*", F.explode(F.array_compact(F.array(best_match(text, usable(df.sparkSession, s.patterns), s.coverage)))).alias("m"))


def word_matches(words: DataFrame, s: Settings = Settings()) -> DataFrame:
    m = _matched(words, F.col("text"), s)
    order = F.struct(F.lit(0).alias("phase"), F.lit(0).cast("long").alias("bucket_seq"), F.col("word_seq").alias("top"), F.lit(0).alias("side"), F.lit(0).cast("long").alias("bottom"), F.lit(0).alias("form"))
    return m.select(*PAGE, *BOX, "confidence", "origin", order.alias("ordinal"), "m.text", "m.pattern_id", "m.pattern_name", "m.func", "m.loop", "m.suffix")


def stacked_pairs(words: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Pairs of words one above the other: an equi-join on (drawing, page, bucket), the lower word in three buckets."""
    bucket = F.floor((F.col("x0") + F.col("x1")) / 2 / s.bucket).cast("long")
    seen = words.withColumn("bucket", bucket).withColumn("bucket_seq", F.min("word_seq").over(Window.partitionBy(*PAGE, "bucket")))
    box = F.struct("word_seq", "text", "confidence", "origin", *BOX)
    tops = seen.select(*PAGE, "bucket", "bucket_seq", box.alias("t"))
    # side: 0 is the same bucket, 1 the one to the left of the upper word, 2 to the right
    lows = seen.select(*PAGE, F.explode(F.array(*[F.struct((F.col("bucket") + d).alias("bucket"), F.lit(side).alias("side")) for d, side in ((0, 0), (1, 1), (-1, 2))])).alias("k"), box.alias("b")).select(*PAGE, "k.*", "b")
    t, b = F.col("t"), F.col("b")
    gap, height = b["y0"] - t["y1"], t["y1"] - t["y0"]
    width = F.least(t["x1"] - t["x0"], b["x1"] - b["x0"])
    shared = F.least(t["x1"], b["x1"]) - F.greatest(t["x0"], b["x0"])
    tall = F.greatest(t["y1"], b["y1"]) - F.least(t["y0"], b["y0"])
    fits = (t["word_seq"] != b["word_seq"]) & (gap >= s.min_gap) & (gap <= height * s.stack_gap_factor) & (width > 0) & (F.try_divide(shared, width) >= s.min_x_overlap) & (tall <= F.greatest(height, b["y1"] - b["y0"]) * s.max_stack_height)
    return tops.join(tables.shuffled(lows), [*PAGE, "bucket"]).filter(fits).select(
        *PAGE, "bucket_seq", "side", t["word_seq"].alias("top_seq"), b["word_seq"].alias("bottom_seq"), t["text"].alias("top_text"), b["text"].alias("bottom_text"),
        F.least(t["x0"], b["x0"]).alias("x0"), F.least(t["y0"], b["y0"]).alias("y0"), F.greatest(t["x1"], b["x1"]).alias("x1"), F.greatest(t["y1"], b["y1"]).alias("y1"),
        F.least(t["confidence"], b["confidence"]).alias("confidence"), F.when((t["origin"] == "bubble") & (b["origin"] == "bubble"), "bubble").otherwise("page").alias("origin"),
    )


def pair_matches(pairs: DataFrame, s: Settings = Settings()) -> DataFrame:
    forms = F.explode(F.array(F.struct(F.lit(0).alias("form"), F.concat("top_text", F.lit("-"), "bottom_text").alias("text")), F.struct(F.lit(1).alias("form"), F.concat("top_text", "bottom_text").alias("text"))))
    m = _matched(pairs.select("*", forms.alias("f")), F.col("f.text"), s)
    order = F.struct(F.lit(1).alias("phase"), "bucket_seq", F.col("top_seq").alias("top"), "side", F.col("bottom_seq").alias("bottom"), F.col("f.form").alias("form"))
    return m.select(*PAGE, *BOX, "confidence", "origin", order.alias("ordinal"), "m.text", "m.pattern_id", "m.pattern_name", "m.func", "m.loop", "m.suffix")


#: groups of more rows than this are settled by rounds instead of a fold in one task
FOLD = 512


def suppress(rows: DataFrame, group: tuple[str, ...], priority: list[Column], clash, place: tuple[Column, Column, Column], same: tuple[str, ...], fold: int = FOLD) -> DataFrame:
    """Accepts rows by priority unless they clash with one accepted before.

    place: (x, y, size) such that rows clash only if neither coordinate differs by the larger size.  same: columns whose
    equal values make rows clash with each other and with the same others.  Groups of up to ``fold`` rows are folded,
    each in one task; larger ones take rounds over pairs of clashing neighbours, with the same result.
    """
    held = tables.stored(rows.withColumn("_id", F.monotonically_increasing_id()), "candidates")
    large = tables.stored(held.groupBy(*group).agg(F.count("*").alias("_n")).filter(F.col("_n") > fold).select(*group), "large")
    if large.isEmpty():
        return _folded(held.drop("_id"), group, priority, clash)
    large = tables.shuffled(large)
    own = held.join(large, [*group], "left_semi")
    return _folded(held.join(large, [*group], "left_anti").drop("_id"), group, priority, clash).unionByName(own.join(tables.shuffled(_beaten(own, group, priority, clash, place, same)), "_id", "left_anti").drop("_id"))


def _folded(rows: DataFrame, group: tuple[str, ...], priority: list[Column], clash) -> DataFrame:
    ranked = rows.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(*[p.alias(f"_{i}") for i, p in enumerate(priority)], F.struct(*[c for c in rows.columns if c not in group]).alias("row")))).alias("all"))
    kept = F.aggregate("all", F.slice("all", 1, 0), lambda acc, x: F.when(F.exists(acc, lambda a: clash(a["row"], x["row"])), acc).otherwise(F.concat(acc, F.array(x))))
    return ranked.select(*group, F.explode(kept).alias("k")).select(*group, "k.row.*")


def _beaten(rows: DataFrame, group: tuple[str, ...], priority: list[Column], clash, place: tuple[Column, Column, Column], same: tuple[str, ...]) -> DataFrame:
    """(_id) of the rows that aren't accepted.

    A row that no clashing one precedes is accepted, and all that clash with it are out; of the others, again.  Each
    round settles the first of all open rows at least.  Neighbours are found on grids: a row lies in one cell of its own
    scale and of each coarser one, and looks into the nine cells around it.
    """
    rank = F.struct(*[p.alias(f"_{i}") for i, p in enumerate(priority)], F.col("_id").alias("_last"))
    x, y, size = place
    inside = [c for c in rows.columns if c not in (*group, "_id")]
    level = F.floor(F.log2(F.greatest(size.cast("double"), F.lit(1.0)))).cast("int") + 1
    df = rows.select(*group, "_id", rank.alias("rank"), F.struct(*inside).alias("row"), x.alias("px"), y.alias("py"), level.alias("level"))
    first = Window.partitionBy(*group, *[F.col(f"row.{c}") for c in same]).orderBy("rank")
    df = tables.stored(df.withColumn("_k", F.row_number().over(first)), "ranked")
    copies, df = df.filter("_k > 1").select("_id"), df.filter("_k = 1").drop("_k")
    top = df.agg(F.max("level")).first()[0] or 0
    cell = lambda v: F.floor(v / F.pow(F.lit(2.0), F.col("at"))).cast("long")
    scaled = df.withColumn("at", F.explode(F.sequence("level", F.lit(top)))).withColumns({"gx": cell(F.col("px")), "gy": cell(F.col("py"))})
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    keys = [*group, "at", "gx", "gy"]
    left = scaled.select(*keys, F.col("level").alias("la"), F.col("rank").alias("ra"), F.col("row").alias("a"), F.col("_id").alias("hi"))
    right = scaled.withColumn("d", around).withColumns({"gx": F.col("gx") + F.col("d.i"), "gy": F.col("gy") + F.col("d.j")}).select(*keys, F.col("level").alias("lb"), F.col("rank").alias("rb"), F.col("row").alias("b"), F.col("_id").alias("lo"))
    met = left.join(tables.shuffled(right), keys).filter((F.greatest("la", "lb") == F.col("at")) & (F.col("ra") < F.col("rb")) & clash(F.col("a"), F.col("b")))
    pairs, out = tables.stored(met.select("hi", "lo"), "clashes"), [copies]
    while not pairs.isEmpty():
        won = pairs.select("hi").distinct().join(pairs.select(F.col("lo").alias("hi")).distinct(), "hi", "left_anti")
        lost = tables.stored(pairs.join(won, "hi", "left_semi").select(F.col("lo").alias("_id")).distinct(), "lost")
        out.append(lost)
        pairs = tables.stored(pairs.join(lost.withColumnRenamed("_id", "hi"), "hi", "left_anti").join(lost.withColumnRenamed("_id", "lo"), "lo", "left_anti").select("hi", "lo"), "clashes")
    return reduce(DataFrame.unionByName, out)


def suppress_overlaps(candidates: DataFrame, s: Settings = Settings(), fold: int = FOLD) -> DataFrame:
    first = [F.when(F.col("origin") == "bubble", 0).otherwise(1), -F.length("text"), -F.col("confidence"), F.col("ordinal")]
    place = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2, F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    same = (*BOX,) if s.overlap < 1 else ("ordinal",)
    flat = candidates.withColumn("_flat", F.when((F.col("x1") <= F.col("x0")) | (F.col("y1") <= F.col("y0")), F.col("ordinal")))  # boxes without an area overlap nothing, not even their like
    return suppress(flat, PAGE, first, lambda a, b: S.iou(a, b) > s.overlap, place, (*same, "_flat"), fold).drop("_flat")


def candidates(words: DataFrame, s: Settings = Settings()) -> DataFrame:
    return word_matches(words, s).unionByName(pair_matches(stacked_pairs(words, s), s))


def to_tags(found: DataFrame) -> DataFrame:
    """Candidates as tags, numbered in reading order within each drawing."""
    blank = {c: F.lit("") for c in ("description", "line_or_equipment", "panel", "size", "fail_position", "notes", "continues_on", "updated_at", "updated_by")}
    seq = F.row_number().over(Window.partitionBy("drawing_id").orderBy("page", "y0", "x0", "ordinal")).cast("long")
    loop = F.when(F.col("loop") != "", F.concat("loop", "suffix")).otherwise("")
    return found.withColumn("tag_seq", seq).select(
        "drawing_id", "tag_seq", F.concat(F.lit("tag-"), "drawing_id", F.lit("-"), F.col("tag_seq").cast("string")).alias("id"), "text", "page", "confidence", *BOX,
        F.col("func").alias("function_code"), F.col("loop").alias("loop_number"), "suffix", F.col("pattern_name").alias("type"), F.lit("uncertain").alias("state"), F.lit("auto").alias("source"), "pattern_name", "origin",
        S.isa_meaning(F.col("func")).alias("isa_function"), loop.alias("loop_group"), *[v.alias(k) for k, v in blank.items()],
    )


def extract(words: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Tags found on each drawing; none if no pattern is usable."""
    return to_tags(suppress_overlaps(candidates(words, s), s))


def unrotated(df: DataFrame, height: str) -> DataFrame:
    """Boxes of a raster turned by 90 degrees clockwise, back in the upright page."""
    old = F.struct(*BOX)
    return df.withColumn("_b", old).withColumns({"x0": F.col("_b.y0"), "x1": F.col("_b.y1"), "y0": F.col(height) - F.col("_b.x1"), "y1": F.col(height) - F.col("_b.x0")}).drop("_b")


def flattened_words(ocr: DataFrame, origin: str = "page") -> DataFrame:
    """ocr (drawing_id, page, blocks: nested paragraphs, lines, words) as trimmed words, in order; blank ones go."""
    df = ocr
    for name in ("blocks", "paragraphs", "lines", "words"):
        df = df.select(*[c for c in df.columns if c not in ("blocks", "item")], F.posexplode(F.col("blocks") if name == "blocks" else F.col(f"item.{name}")).alias(f"_{name}", "item"))
    text = S.trimmed(F.col("item.text"))
    seq = F.row_number().over(Window.partitionBy(*PAGE).orderBy("_blocks", "_paragraphs", "_lines", "_words")).cast("long")
    return df.withColumn("word_seq", seq).select(*PAGE, "word_seq", text.alias("text"), F.col("item.confidence").cast("double").alias("confidence"), *[F.col(f"item.bbox.{k}").cast("double").alias(k) for k in BOX], F.lit(origin).alias("origin")).filter("text <> ''")


def united(*passes: DataFrame) -> DataFrame:
    """Words of several passes, in that order."""
    out = None
    for i, p in enumerate(passes):
        numbered = p.withColumn("_pass", F.lit(i))
        out = numbered if out is None else out.unionByName(numbered)
    return out.withColumn("word_seq", F.row_number().over(Window.partitionBy("drawing_id").orderBy("page", "_pass", "word_seq")).cast("long")).drop("_pass")
