"""Connected components by alternating large-star and small-star steps.

Links stay distributed; each round is written to the shared folder.  A hub's links are
spread by heavy_join; where all links together are few enough for one task, by their count,
a window takes each node's, in a fourth of the shuffles.  Rounds grow with the logarithm of a
component's size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import heavy_join, stored


#: links, 16 bytes each, up to which even all of them fit a task
FEW = 500_000


def _mark(df: DataFrame):
    row = df.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("x")).first()
    return row["n"], row["x"]


def _star(linked: DataFrame) -> DataFrame:
    """(a, b, m): b and a, both linked to m."""
    return linked.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b), non-null and comparable, in any order, repeats and loops allowed -> (node, root).

    Every node that has a link to another appears once, roots too; root is the smallest
    node that it reaches, itself included.  No edges: no rows.
    """
    here = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    mark = _mark(here)
    while mark[0]:
        both = here.select(F.col("a").alias("u"), F.col("b").alias("v")).union(here.select("b", "a"))
        if mark[0] <= FEW:
            large = both.withColumn("m", F.least("u", F.min("v").over(Window.partitionBy("u")))).filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
            small = _star(large.withColumn("m", F.min("b").over(Window.partitionBy("a"))))
            here, was = stored(small.filter("a <> b").distinct(), "links"), mark
            mark = _mark(here)
            if was == mark:
                break
            continue
        near = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("w"))
        large = stored(heavy_join(both, near, ["u"], "w", 2 * mark[0]).filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct(), "links")
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("w"))
        small = _star(heavy_join(large, least, ["a"], "w", mark[0]))
        here = stored(small.filter("a <> b").distinct(), "links")
        was, mark = mark, _mark(here)
        if was == mark:
            break
    return here.select(F.col("a").alias("node"), F.col("b").alias("root")).union(here.select("b", "b").distinct())
