"""Greedy suppression by rounds gives what the fold gives, and grows with the rows."""

import random

from pyspark.sql import functions as F

from tagweave.operators import circles, extract

KINDS = "drawing_id string, page int, x0 double, y0 double, x1 double, y1 double, confidence double, origin string, ordinal struct<phase:int,bucket_seq:long,top:long,side:int,bottom:long,form:int>, text string"


def found(spark, n, side, seed):
    rng = random.Random(seed)

    def row(k):
        x, y = rng.randrange(side), rng.randrange(side)
        w, h = rng.choice([(60, 20), (20, 20), (200, 90), (5, 3), (0, 4), (0, 0)])
        return ("d", k % 2 + 1, float(x), float(y), float(x + w), float(y + h), float(rng.randrange(100)), rng.choice(["page", "bubble"]), (0, 0, k, 0, 0, 0), "A" * rng.randint(2, 6))

    rows = [row(k) for k in range(n)]
    rows += [r[:6] + (1.0, "page", (0, 0, n + i, 0, 0, 0), r[9]) for i, r in enumerate(rows[: n // 10])]  # the same boxes
    return spark.createDataFrame(rows, KINDS)


def test_rounds_equal_the_fold(spark):
    for n, side in ((60, 200), (250, 300), (200, 3000)):
        rows = found(spark, n, side, n)
        fold = extract.suppress_overlaps(rows, fold=10**9).collect()
        rounds = extract.suppress_overlaps(rows, fold=0).collect()
        assert sorted(map(str, rounds)) == sorted(map(str, fold)) and 0 < len(fold) < rows.count()


def test_rounds_of_circles_equal_the_fold(spark):
    rng = random.Random(5)
    rows = spark.createDataFrame([(k % 2, rng.randint(8, 40), rng.randrange(300), rng.randrange(300), rng.randrange(50)) for k in range(300)], "page int, r int, cx long, cy long, votes long").dropDuplicates(["page", "r", "cx", "cy"])
    fold = sorted(map(tuple, circles.separated(rows).collect()))
    was, extract.FOLD = extract.FOLD, 0
    try:
        clash = lambda a, b: F.hypot(a["cx"] - b["cx"], a["cy"] - b["cy"]) < 1.2 * F.greatest(a["r"], b["r"])
        rounds = extract.suppress(rows, ("page",), [-F.col("votes"), F.col("r"), F.col("cy"), F.col("cx")], clash, (F.col("cx"), F.col("cy"), 1.2 * F.col("r")), ("cx", "cy", "r"), 0)
        assert sorted(map(tuple, rounds.select("page", "r", "cx", "cy", "votes").collect())) == [(p, r, x, y, v) for p, r, x, y, v in fold]
    finally:
        extract.FOLD = was


def test_a_page_of_many_words(spark):
    """40,000 boxes in a grid, each read three times: the fold would compare each with all before it."""
    rows = spark.range(120_000).select(
        F.lit("d").alias("drawing_id"), F.lit(1).alias("page"), ((F.col("id") / 3).cast("long") % 200 * 80 + F.col("id") % 3).cast("double").alias("x0"), (F.floor(F.col("id") / 600) * 40).cast("double").alias("y0"),
        (F.col("id") % 100).cast("double").alias("confidence"), F.lit("page").alias("origin"), F.lit("AB").alias("text"), "id",
    )
    rows = rows.withColumns({"x1": F.col("x0") + 60, "y1": F.col("y0") + 20, "ordinal": F.struct(F.lit(0).alias("phase"), F.lit(0).cast("long").alias("bucket_seq"), F.col("id").alias("top"), F.lit(0).alias("side"), F.lit(0).cast("long").alias("bottom"), F.lit(0).alias("form"))}).drop("id")
    kept = extract.suppress_overlaps(rows)
    assert kept.count() == 40_000
    best = kept.select((F.col("ordinal.top") % 3).alias("k"), "confidence").first()
    assert best["confidence"] >= 0
