"""Workbooks streamed by rows, the catalog of versions in buckets, nearest readings by grids, merge counts, notes."""

import io
import math
import random
import xml.etree.ElementTree as ET
import zipfile

from pyspark.sql import functions as F

from tagweave.operators import consensus, lines, merge, review
from tagweave.schema import SEED, TAGS, TAG_TEXTS
from tagweave.sources import sinks

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def tag_rows(spark, n):
    blank = [F.lit("").alias(c) if c not in ("state", "notes") else F.when(F.col("id") % 3 == 0, "confirmed").otherwise("uncertain").alias(c) if c == "state" else F.concat(F.lit('a <b> & "c" '), F.col("id").cast("string")).alias(c) for c in TAG_TEXTS]
    return spark.range(n).select(F.lit("d").alias("drawing_id"), F.col("id").alias("tag_seq"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("_id"), F.concat(F.lit("PT-"), F.col("id").cast("string")).alias("text"), F.lit(1).alias("page"), F.lit(90.4).alias("confidence"), F.lit(1.0).alias("x0"), F.lit(2.0).alias("y0"), F.lit(31.0).alias("x1"), F.lit(12.0).alias("y1"), *blank).withColumnRenamed("_id", "id")


def cells(sheet):
    return [["".join(c.itertext()) for c in row] for row in ET.fromstring(sheet).iter(f"{MAIN}row")]


def test_workbook_of_many_rows(spark):
    tags = tag_rows(spark, 5000).repartition(7)
    want = review.export_rows(tags.orderBy("tag_seq"))
    out = io.BytesIO()
    notes = spark.createDataFrame([("n", "1", "see\x01 <x>")], "id string, flag string, text string")
    sinks.write_workbook(out, tags, {"title": "T<1>"}, notes=notes, exported="2024")
    with zipfile.ZipFile(out) as z:
        rows = cells(z.read("xl/worksheets/sheet1.xml"))
        assert rows[0] == want.columns and len(rows) == 5001
        assert rows[1:] == [[("" if v is None else str(v)) for v in r] for r in want.collect()]
        drawing = dict(r[:2] for r in cells(z.read("xl/worksheets/sheet2.xml")))
        assert drawing["Tag Count"] == "5000" and drawing["Confirmed"] == "1667" and "T<1>" in drawing.values()
        assert cells(z.read("xl/worksheets/sheet3.xml"))[1][-1] == "see <x>"


def drawings(spark, rows):
    made = spark.createDataFrame([(i, {"title": t}, t) for i, t in rows], "id string, m map<string,string>, t string")
    empty = F.lit("")
    return made.select(
        "id", F.struct(empty.alias("drawing_number"), F.col("t").alias("title"), empty.alias("revision"), empty.alias("source_file_name")).alias("meta"), F.array(F.struct(F.concat("id", F.lit("-1")).alias("text"), F.lit("confirmed").alias("state"))).alias("tags"),
        F.when(F.col("t") != "bare", F.lit(b"%PDF-")).alias("file"),
    )


def test_catalog_keeps_the_last_version(spark, tmp_path):
    c = sinks.Catalog(spark, str(tmp_path / "c"), buckets=8)
    c.save(drawings(spark, [(f"x/{k}", "first") for k in range(60)]), "2024-01-01")
    c.save(drawings(spark, [("x/1", "second"), ("x/2", "bare")]), "2024-01-02")
    c.save(drawings(spark, [("x/1", "third")]), "2024-01-03")
    c.delete("x/3", "x/4", "nobody")
    want = {f"x/{k}": "first" for k in range(60) if k not in (3, 4)} | {"x/1": "third", "x/2": "bare"}
    for again in range(3):
        got = c.all().collect()
        assert {r["id"]: r["meta"]["title"] for r in got} == want and len(got) == len(want)
        assert [r["meta"]["title"] for r in c.load("x/1").collect()] == ["third"] and c.load("x/3").isEmpty() and c.load("y").isEmpty()
        newest = c.summaries().first()
        assert (newest["id"], newest["has_file"]) == ("x/1", True) and not c.summaries().filter("id = 'x/2'").first()["has_file"]
        assert c.tags().count() == len(want)
        c.compact()
        assert len(c.generations()) <= 2
    c.save(drawings(spark, [("x/3", "back")]), "2024-01-04")
    assert c.load("x/3").first()["meta"]["title"] == "back" and c.all().count() == len(want) + 1


def test_catalog_looks_into_one_bucket(spark, tmp_path):
    c = sinks.Catalog(spark, str(tmp_path / "c"), buckets=8)
    c.save(drawings(spark, [(f"d{k}", "t") for k in range(100)]), "2024")
    files = c.load("d7").inputFiles()
    plan = c.load("d7")._jdf.queryExecution().executedPlan().toString()
    assert files and "PartitionFilters: [isnotnull(bucket" in plan


def test_nearest_by_grids_equals_all_distances(spark):
    rng = random.Random(1)
    place = lambda: (rng.choice("ab"), rng.choice([rng.uniform(0, 3000), rng.uniform(0, 60)]), rng.uniform(0, 3000))
    pairs, points = [(k, *place()) for k in range(150)], [place() for _ in range(900)] + [("c", 1.0, 1.0)]
    p = spark.createDataFrame(pairs, "id long, sheet string, cx double, cy double")
    o = spark.createDataFrame(points, "sheet string, ox double, oy double")
    want = {}
    for k, s, x, y in pairs:
        d = min(math.hypot(x - a, y - b) for t, a, b in points if t == s)
        if d <= 200:
            want[k] = d
    for few in (10**6, 10):
        got = {r["id"]: r["distance"] for r in consensus.nearest(p, o, ["sheet"], 200.0, few).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got) and 0 < len(got) < 150


def test_merge_counts(spark):
    t = tag_rows(spark, 3).unionByName(tag_rows(spark, 1).withColumns({"tag_seq": F.lit(9).cast("long"), "id": F.lit("again")}))
    seed = spark.createDataFrame([("d", 0, "pt 1", *[""] * 8, None), ("d", 1, "XX-9", *[""] * 8, None), ("e", 0, "PT-1", *[""] * 8, None)], SEED)
    m = merge.merge(t.select(*[c.split(" ")[0] for c in TAGS.split(", ")]), seed)
    got = {r["drawing_id"]: tuple(r)[1:] for r in m.counts.collect()}
    assert got == {"d": (1, 1, 1, 3, 1), "e": (0, 1, 1, 0, 0)}


def test_blank_note(spark):
    notes = spark.createDataFrame([("n1", "1", "text")], "id string, flag string, text string")
    assert sorted(map(tuple, lines.added_note(notes, "n2").collect())) == [("n1", "1", "text"), ("n2", "", "")]
