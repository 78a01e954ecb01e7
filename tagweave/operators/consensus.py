"""Corrections by consensus of a drawing: no reading is invented that its sheet doesn't support.

All aggregates are by drawing (pages pooled unless ``same_page_only``) and computed once
from the first readings.  A drawing's distinct tokens are joined by what one edit leaves
of them.  The note sentences are fixed values.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import dims, tables
from ..functions import scalars as S
from ..schema import ReconcileOptions


def subjects(tags: DataFrame, o: ReconcileOptions = ReconcileOptions()) -> DataFrame:
    """Bubbles read automatically and not confirmed, of drawings that have enough of them; with token, stem and letters."""
    sheet = F.concat_ws("/", "drawing_id", F.col("page").cast("string")) if o.same_page_only else F.col("drawing_id")
    rows = tags.filter("origin = 'bubble' AND source = 'auto' AND state <> 'confirmed'").select(sheet.alias("sheet"), "drawing_id", "id", "tag_seq", "function_code", F.concat("loop_number", "suffix").alias("token"), ((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("y0") + F.col("y1")) / 2).alias("cy"))
    rows = rows.withColumns({"stem": S.stem(F.col("token")), "letters": S.letters(F.col("token"))})
    return rows.withColumn("n", F.count("*").over(Window.partitionBy("sheet"))).filter(F.col("n") >= o.min_subjects).drop("n")


def token_support(sub: DataFrame) -> DataFrame:
    return sub.filter("token <> ''").groupBy("sheet", "token").agg(F.count("*").alias("support"), F.min("tag_seq").alias("first_seq"))


def stem_support(sub: DataFrame) -> DataFrame:
    return sub.filter("stem <> ''").groupBy("sheet", "stem").agg(F.count("*").alias("stem_support"))


def modal_length(sub: DataFrame) -> DataFrame:
    """The sheet's most common length of distinct stems, the shorter on ties; stems that are one longer than another one don't count."""
    stems = stem_support(sub).select("sheet", "stem")
    shorter = stems.withColumnRenamed("stem", "base")
    own = stems.withColumn("base", F.when(F.length("stem") > 1, F.expr("substring(stem, 1, length(stem) - 1)")))
    counts = own.join(tables.shuffled(shorter), ["sheet", "base"], "left_anti").groupBy("sheet", F.length("stem").alias("len")).agg(F.count("*").alias("n"))
    return counts.groupBy("sheet").agg(F.max_by("len", F.struct("n", -F.col("len"))).cast("int").alias("modal"))


#: readings of a token on a sheet, up to which all of them are measured
READINGS = 64


def nearest(pairs: DataFrame, points: DataFrame, on: list[str], radius: float, few: int = READINGS) -> DataFrame:
    """pairs (cx, cy), each with the distance to the nearest of points (ox, oy) of equal ``on`` columns, of those within the radius; pairs without one go.

    Where a token has more than ``few`` points, pairs look at them by grids from fine to coarse: the nearest point within a
    cell's side lies in the nine cells around, and only pairs that have none look at the next grid, of twice the side.
    """
    away = F.hypot(F.col("ox") - F.col("cx"), F.col("oy") - F.col("cy"))
    points = points.select(*on, "ox", "oy").distinct()
    counts = points.groupBy(*on).agg(F.count("*").alias("_n"))
    known = pairs.join(tables.shuffled(counts), on)
    sparse = known.filter(F.col("_n") <= few).drop("_n").join(tables.shuffled(points), on).groupBy(*pairs.columns).agg(F.min(away).alias("distance")).filter(F.col("distance") <= radius)
    dense = counts.filter(F.col("_n") > few).select(*on)
    if dense.isEmpty():
        return sparse
    dense = tables.shuffled(tables.stored(dense, "dense"))
    points, open_ = tables.stored(points.join(dense, on, "left_semi"), "points"), tables.stored(pairs.join(dense, on, "left_semi"), "open")
    found = [sparse]
    for k in range(6, -1, -1):
        side = radius / 2**k
        cell = lambda x, y, side=side: (F.floor(F.col(x) / side).alias("gx"), F.floor(F.col(y) / side).alias("gy"))
        around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
        looks = open_.select("*", *cell("cx", "cy")).withColumn("d", around).withColumns({"gx": F.col("gx") + F.col("d.i"), "gy": F.col("gy") + F.col("d.j")}).drop("d")
        near = looks.join(tables.shuffled(points.select("*", *cell("ox", "oy"))), [*on, "gx", "gy"]).groupBy(*pairs.columns).agg(F.min(away).alias("distance")).filter(F.col("distance") <= side)
        near = tables.stored(near, "near")
        found.append(near)
        if k:
            open_ = tables.stored(open_.join(tables.shuffled(near.select(*pairs.columns)), [*pairs.columns], "left_anti"), "open")
    return reduce(DataFrame.unionByName, found)


def corrections(tags: DataFrame, o: ReconcileOptions = ReconcileOptions()) -> DataFrame:
    """(drawing_id, id, field, before, after, kind, support): two rows per tag at most."""
    sub = tables.stored(subjects(tags, o), "subjects")  # narrow, and read by each of the joins below
    tokens, stems = token_support(sub), stem_support(sub)
    marked = sub.join(tables.shuffled(tokens.select("sheet", "token", "support")), ["sheet", "token"]).join(tables.shuffled(modal_length(sub)), "sheet", "left")
    odd = (F.col("stem") != "") & (F.length("stem") != F.coalesce("modal", F.lit(0)))
    marked = tables.stored(marked.withColumn("odd", odd).filter((F.col("support") <= o.weak_support) | F.col("odd")), "marked")
    target = tokens.select("sheet", F.col("token").alias("to"), F.col("support").alias("to_support"), "first_seq").withColumn("stem", S.stem(F.col("to"))).join(tables.shuffled(stems), ["sheet", "stem"], "left").select("sheet", "to", F.coalesce("stem_support", "to_support").alias("evidence"), "first_seq")
    # by token, not by tag; an equi-join on what one edit leaves of both, then the whole rule
    reading = marked.select("sheet", "token", "support", "odd").distinct().withColumn("key", F.explode(S.edit_keys(F.col("token"), False)))
    found = reading.join(tables.shuffled(target.withColumn("key", F.explode(S.edit_keys(F.col("to"), True)))), ["sheet", "key"]).filter(F.col("evidence") >= F.col("support") + F.when(F.col("odd"), 1).otherwise(o.support_margin))
    found = found.withColumn("kind", S.correction_kind(F.col("token"), F.col("to"))).filter("kind IS NOT NULL").select("sheet", "token", "to", "kind", "evidence", "first_seq").distinct()
    pairs = marked.select("sheet", "drawing_id", "id", "token", "cx", "cy").join(tables.shuffled(found), ["sheet", "token"])
    other = sub.select("sheet", F.col("token").alias("to"), F.col("cx").alias("ox"), F.col("cy").alias("oy"))
    near = nearest(pairs, other, ["sheet", "to"], o.cluster_radius)
    best = near.withColumn("r", F.row_number().over(Window.partitionBy("sheet", "id").orderBy(F.desc("evidence"), "distance", "first_seq"))).filter("r = 1")
    best = tables.stored(best.select("sheet", "drawing_id", "id", F.col("token").alias("before"), F.col("to").alias("after"), "kind", F.col("evidence").alias("support")), "best")

    # no reading of the suffix anywhere: inferred where the shape of the token forces one answer
    single = F.create_map(*[F.lit(x) for d, found in S.confusable_letters().items() if len(found) == 1 for x in (d, found[0])])
    lone = marked.filter("letters = '' AND length(stem) = coalesce(modal, 0) + 1").join(tables.shuffled(best.select("sheet", "id")), ["sheet", "id"], "left_anti")
    lone = lone.withColumns({"base": F.expr("substring(stem, 1, length(stem) - 1)"), "letter": F.try_element_at(single, F.expr("substring(stem, length(stem), 1)"))}).filter("letter IS NOT NULL")
    lone = lone.join(tables.shuffled(stems.withColumnRenamed("stem", "base")), ["sheet", "base"]).filter(F.col("stem_support") >= o.support_margin)
    other = sub.select("sheet", F.col("stem").alias("base"), F.col("cx").alias("ox"), F.col("cy").alias("oy"))
    lone = nearest(lone.select("sheet", "drawing_id", "id", "token", "base", "letter", "stem_support", "cx", "cy"), other, ["sheet", "base"], o.cluster_radius)
    inferred = lone.select("drawing_id", "id", F.col("token").alias("before"), F.concat("base", "letter").alias("after"), F.lit("suffix-inferred").alias("kind"), F.col("stem_support").alias("support"))
    loops = best.drop("sheet").unionByName(inferred).withColumn("field", F.lit("loop"))
    return loops.unionByName(function_fixes(sub)).select("drawing_id", "id", "field", "before", "after", "kind", "support")


def function_fixes(sub: DataFrame) -> DataFrame:
    """Codes that aren't known and lie one edit from exactly one that is; the dictionary is a constant."""
    known = F.array(*[F.lit(k) for k in dims.KNOWN_CODES])
    odd = sub.filter("function_code <> ''").filter(~F.array_contains(known, F.col("function_code")))
    near = odd.withColumn("near", F.filter(known, lambda k: S.one_edit(F.col("function_code"), k))).filter("size(near) = 1")
    return near.select("drawing_id", "id", F.col("function_code").alias("before"), F.col("near")[0].alias("after"), F.lit("nearest known function code").alias("kind"), F.lit(None).cast("long").alias("support"), F.lit("func").alias("field"))


def reconcile(tags: DataFrame, o: ReconcileOptions = ReconcileOptions(), fixes: DataFrame | None = None) -> DataFrame:
    """The tags with corrections applied and noted; a corrected tag stays in review."""
    fixes = corrections(tags, o) if fixes is None else fixes
    pick = lambda f, c: F.max(F.when(F.col("field") == f, F.col(c)))
    by = fixes.groupBy("drawing_id", "id").agg(pick("loop", "before").alias("l0"), pick("loop", "after").alias("l1"), pick("loop", "kind").alias("lk"), pick("loop", "support").alias("ls"), pick("func", "before").alias("f0"), pick("func", "after").alias("f1"))
    t = tags.join(tables.shuffled(by), ["drawing_id", "id"], "left")
    any_, tail = F.col("l1").isNotNull() | F.col("f1").isNotNull(), lambda c: F.expr(f"substring({c}, length({c}), 1)")
    func, loop, suffix = F.coalesce("f1", "function_code"), F.when(F.col("l1").isNotNull(), S.stem(F.col("l1"))).otherwise(F.col("loop_number")), F.when(F.col("l1").isNotNull(), S.letters(F.col("l1"))).otherwise(F.col("suffix"))
    said = F.when(
        F.col("lk") == "suffix-inferred",
        F.format_string('Loop read as "%s". No bubble on this sheet read the suffix, but "%s" is a %s-bubble loop here and a trailing "%s" is a common misread of "%s". Check this one against the drawing.', F.col("l0"), F.expr("substring(l0, 1, length(l0) - 1)"), F.col("ls").cast("string"), tail("l0"), tail("l1")),
    ).when(F.col("l1").isNotNull(), F.format_string('Loop read as "%s"; corrected to "%s" (%s nearby bubbles on this loop). Verify against the drawing.', F.col("l0"), F.col("l1"), F.col("ls").cast("string")))
    also = F.when(F.col("f1").isNotNull(), F.format_string('Function code read as "%s"; "%s" is the only known code one character away.', F.col("f0"), F.col("f1")))
    new = {
        "function_code": func, "loop_number": loop, "suffix": suffix, "text": S.rebuilt_text(func, loop, suffix), "loop_group": F.when(loop != "", F.concat(loop, suffix)).otherwise(F.col("loop_group")),
        "state": F.when(F.col("state") == "illegible", "illegible").otherwise("uncertain"), "notes": F.concat_ws(" ", F.when(F.col("notes") != "", F.col("notes")), said, also),
    } | ({"isa_function": S.isa_meaning(func)} if o.refresh_isa_function else {})
    return t.select(*[(F.when(any_, new[c]).otherwise(F.col(c)) if c in new else F.col(c)).alias(c) for c in tags.columns])
