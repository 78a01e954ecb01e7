"""Tags: extraction, consensus, merge, sources and sinks on small fixtures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagweave.functions import scalars as S
from tagweave.operators import circles, consensus, extract, lines, merge, review
from tagweave.schema import SEED, TAG_TEXTS, WORDS, CircleOptions, MergeOptions, Settings, TagPattern
from tagweave.sources import readers, sinks


def words(spark, rows):
    return spark.createDataFrame([("d", i, 1, t, float(c), *map(float, b), o) for i, (t, c, b, o) in enumerate(rows)], WORDS)


def tags(spark, rows):
    """rows (id, text, cx, cy, changes)."""
    out = []
    for i, (key, text, cx, cy, more) in enumerate(rows):
        import re

        m = re.match(r"^([A-Z]+)-(\d+)([A-Z]*)$", text)
        base = dict.fromkeys(TAG_TEXTS, "") | {"function_code": m[1] if m else "", "loop_number": m[2] if m else "", "suffix": m[3] if m else "", "state": "uncertain", "source": "auto", "origin": "bubble"} | more
        out.append(("d", i, key, text, 1, 80.0, cx - 40.0, cy - 30.0, cx + 40.0, cy + 30.0, *[base[c] for c in TAG_TEXTS]))
    from tagweave.schema import TAGS

    return spark.createDataFrame(out, TAGS)


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_anchored_patterns(spark):
    texts = ['8"-G-0331-8E1550', "03-BD-0038", '4"-BD-0334-8E1550', "03-G-0046", "FCV-1319", "BDV-1378A"]
    got = extract.extract(words(spark, [(t, 90, (0, 200 * i, 200, 200 * i + 40), "page") for i, t in enumerate(texts)]))
    assert sorted(r["text"] for r in got.collect()) == ["BDV-1378A", "FCV-1319"]


def test_stack_height_and_bubble_wins(spark):
    far = words(spark, [("ZSC", 90, (100, 100, 160, 140), "page"), ("1378A", 90, (100, 350, 170, 390), "page")])
    assert extract.extract(far, Settings(stack_gap_factor=8)).count() == 0
    rows = [("AOV", 74, (3543, 2129, 3611, 2163), "bubble"), ("1321A", 74, (3543, 2171, 3611, 2205), "bubble"), ("AOV", 92, (3543, 2130, 3611, 2164), "page"), ("1321A", 92, (3543, 2172, 3611, 2206), "page"), ("SI-9701", 80, (6255, 1798, 6340, 1818), "page")]
    got = {r["text"]: r["origin"] for r in extract.extract(words(spark, rows)).collect()}
    assert got == {"AOV-1321A": "bubble", "SI-9701": "page"}


def test_invalid_and_absent_patterns(spark):
    w = words(spark, [("PT-101", 90, (0, 0, 10, 10), "page")])
    bad = TagPattern("x", "x", "([")
    assert extract.extract(w, Settings(patterns=(bad,))).count() == 0
    assert [r["function_code"] for r in extract.extract(w, Settings(patterns=(bad, TagPattern("y", "y", r"(?<func_a>[A-Z]+)-\d+")))).collect()] == [""]


CLUSTER = [("a", "AOV-1321A", 3576, 2169, {}), ("b", "SVO-13217", 3306, 2160, {}), ("c", "ZSC-13217", 3417, 2160, {}), ("d", "ZSO-13214", 3417, 2067, {}), ("e", "SVO-1321", 3306, 2766, {}), ("f", "ZSC-1321", 3417, 2769, {}), ("g", "AOV-1321", 3576, 2778, {}), ("h", "PDIT-1321", 3825, 2010, {})]


def reconciled(spark, rows):
    return {r["id"]: r for r in consensus.reconcile(tags(spark, rows)).collect()}


def test_consensus_cluster(spark):
    got = reconciled(spark, CLUSTER)
    assert {k: r["text"] for k, r in got.items()} == {"a": "AOV-1321A", "b": "SVO-1321A", "c": "ZSC-1321A", "d": "ZSO-1321A", "e": "SVO-1321", "f": "ZSC-1321", "g": "AOV-1321", "h": "PDIT-1321"}
    assert got["b"]["state"] == "uncertain" and "13217" in got["b"]["notes"] and "1321A" in got["b"]["notes"]


def test_consensus_cases(spark):
    rest = CLUSTER[4:]
    got = reconciled(spark, [("x", "AQV-1321", 3576, 2778, {}), ("y", "A-1378", 3813, 1551, {}), ("u", "SVO-13217", 3306, 2160, {"state": "confirmed"}), ("v", "SVO-13217", 3306, 2160, {"origin": "page"}), *rest])
    assert (got["x"]["text"], got["y"]["text"], got["u"]["text"], got["v"]["text"]) == ("AOV-1321", "A-1378", "SVO-13217", "SVO-13217")
    got = reconciled(spark, [("m1", "SVO-13217", 3306, 2160, {}), ("m2", "ZSC-13217", 3417, 2157, {}), ("m3", "AOV-13214", 3576, 2169, {}), *rest])
    assert [got[k]["text"][-5:] for k in ("m1", "m2", "m3")] == ["1321A"] * 3 and got["e"]["text"] == "SVO-1321"
    far = reconciled(spark, [("far", "ZSO-13217", 200, 200, {}), CLUSTER[0], *rest])
    assert far["far"]["text"] == "ZSO-13217"
    five = [("1", "SVO-13217", 0, 0, {}), ("2", "SVO-13210", 0, 0, {}), ("3", "ZSC-13211", 0, 0, {}), ("4", "PDIT-13212", 0, 0, {})]
    assert {r["text"] for r in reconciled(spark, five).values()} == {t for _, t, *_ in five}
    hint = reconciled(spark, [("i", "?-13214", 3417, 2067, {"loop_number": "13214", "state": "illegible"}), *rest[:3]])
    assert (hint["i"]["text"], hint["i"]["state"]) == ("?-1321A", "illegible")


@pytest.mark.parametrize("a,b,kind", [("1321A", "1321", None), ("13217", "1321A", "suffix-recovered"), ("13214", "1321A", "suffix-recovered"), ("1378", "1378A", None), ("1327", "1321", "stem-substitution"), ("1329", "1321", None), ("378A", "1378A", "stem-insertion"), ("1234", "5678", None), ("13", "1321", None), ("1321U", "1321V", "suffix-substitution")])
def test_correction_kind(spark, a, b, kind):
    assert value(spark, S.correction_kind(F.lit(a), F.lit(b))) == kind


def test_scalars(spark):
    assert [value(spark, S.tag_key(F.lit(x))) for x in ("ZSC-1378A", "zsc 1378a", "ZSC1378A")] == ["ZSC1378A"] * 3
    assert [value(spark, S.half_up(F.lit(x))) for x in (-2.5, 2.5)] == [-2, 3]
    assert value(spark, S.isa_meaning(F.lit("PT"))) == "Pressure + Temperature/Transmit"
    assert value(spark, S.trimmed(F.lit("\t a ﻿"))) == "a"
    parts = {k: value(spark, v) for k, v in S.line_parts(F.lit('8"-G-0331-8E1550')).items()}
    assert parts == {"size": '8"', "service": "G", "spec_code": "8E1550"}


def test_seed_file_and_merge(spark, tmp_path):
    f = tmp_path / "seed.csv"
    f.write_bytes('﻿Tag,ISA_Function,Description,Panel,Size,Verified\r\nPT-1001,,"Gas, ""hot""",UCP-100,10",yes\nfcv 1002,,8" bore,,20"x10",\n,,,,,\n,x,y,,,\nPT1001,,again,,,\n'.encode())
    rows, warnings = merge.seed_distinct(readers.seed_list(spark, str(f)).withColumn("drawing_id", F.lit("d")))
    got = {r["tag"]: r for r in rows.collect()}
    assert set(got) == {"PT-1001", "fcv 1002"} and got["PT-1001"]["description"] == 'Gas, "hot"' and got["PT-1001"]["size"] == '10"' and got["fcv 1002"]["size"] == '20"x10"' and got["PT-1001"]["state"] == "confirmed"
    assert sorted(r["warning"][:5] for r in warnings.collect()) == ["Row 4", "Row 5"]
    t = tags(spark, [("p", "PT 1001", 100, 100, {"panel": "OLD"}), ("q", "ZZ-9", 0, 0, {}), ("r", "PT-1001", 5, 5, {})])
    m = merge.merge(t, rows, MergeOptions(reviewer="KG"))
    out = {r["id"]: r for r in m.tags.collect()}
    assert len(out) == 4 and out["p"]["text"] == "PT-1001" and out["p"]["panel"] == "OLD" and out["p"]["x0"] == 60 and out["r"]["text"] == "PT-1001" and out["r"]["state"] == "uncertain"
    assert [r["text"] for r in m.unmatched.collect()] == ["ZZ-9"] and [r["id"] for r in m.duplicates.collect()] == ["r"] and [r["tag"] for r in m.missing.collect()] == ["fcv 1002"]
    with pytest.raises(ValueError):
        g = tmp_path / "none.csv"
        g.write_text("Function,Description\na,b\n")
        readers.seed_list(spark, str(g))


def test_line_lists(spark, tmp_path):
    f = tmp_path / "plain.txt"
    f.write_text('8"-G-0331-8E1550\n4"-IA-0334, 8"-G-0331-8E1550')
    assert sorted(r["service"] for r in readers.line_list(spark, str(f)).collect()) == ["G", "IA"]
    g = tmp_path / "lines.csv"
    g.write_text('Line Number,Service,From,To\n8"-G-0331-8E1550,Gas,E-1301,C-1300\n')
    (r,) = readers.line_list(spark, str(g)).collect()
    assert (r["service"], r["from_ref"], r["to_ref"], r["size"]) == ("Gas", "E-1301", "C-1300", '8"')
    new = lines.new_lines(spark.createDataFrame([("a-1",)], "line_number string"), spark.createDataFrame([("A-1",), ("B",), ("b",)], "line_number string"))
    assert new.count() == 2


def test_export_and_catalog(spark, tmp_path):
    t = tags(spark, [("p", "PT-1001", 100, 100, {"notes": 'say "x", y', "state": "confirmed"})]).unionByName(merge.seed_tags(spark.createDataFrame([("d", 1, "ZT-1", *[""] * 8, None)], SEED)))
    text = sinks.tags_csv(t).split("\n")
    assert text[0].startswith("Tag,ISA_Function") and '"say ""x"", y"' in text[1] and ",100,100,80,60," in text[1] and ",,,,," in text[2]
    book = sinks.workbook(t, {"title": "T<1>"})
    import io
    import zipfile

    assert "T&lt;1&gt;" in zipfile.ZipFile(io.BytesIO(book)).read("xl/worksheets/sheet2.xml").decode()
    nested = t.groupBy(F.col("drawing_id").alias("id")).agg(F.collect_list(F.struct(*[c for c in t.columns if c != "drawing_id"])).alias("tags"))
    meta = F.struct(*[F.lit("n").alias(c) for c in ("drawing_number", "title", "revision", "source_file_name")])
    drawing = nested.select("id", meta.alias("meta"), "tags", F.lit(b"x").alias("file"))
    catalog = sinks.Catalog(spark, str(tmp_path / "catalog"))
    catalog.save(drawing, "2024-01-01")
    catalog.save(drawing.withColumn("id", F.lit("e")).withColumn("file", F.lit(None).cast("binary")), "2024-01-02")
    assert [(r["id"], r["tag_count"], r["confirmed_count"], r["has_file"]) for r in catalog.summaries().collect()] == [("e", 2, 2, False), ("d", 2, 2, True)]
    catalog.delete("e")
    assert catalog.tags().count() == 2 and catalog.load("d").count() == 1
    assert review.filtered(t, search="pt-10").count() == 1


def test_circles(spark):
    y, x = np.mgrid[0:260, 0:260]
    ring = np.abs(np.hypot(x - 90, y - 100) - 36) - 1.5
    disc = np.hypot(x - 200, y - 200) - 36  # filled: not a bubble
    img = np.repeat(np.clip(255 * np.minimum(ring, disc), 0, 255).astype(np.uint8)[:, :, None], 3, axis=2)
    o = CircleOptions(min_radius=30, max_radius=42, downsample=1)
    got = circles.find_circles(img, o)
    assert len(got) == 1 and abs(got[0][0] - 90) <= 2 and abs(got[0][1] - 100) <= 2 and abs(got[0][2] - 36) <= 3
    df = spark.createDataFrame([("d", 1, 260, 260, 3, bytearray(img.tobytes()))], "drawing_id string, page int, height int, width int, n_channels int, data binary")
    assert circles.detect(df, o).count() == 1


def test_entry_without_training_operators():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_crop_offsets_round_the_edge_not_the_side():
    from tagweave.schema import BubbleView

    page = np.zeros((300, 300, 3), np.uint8)
    page[:, 42], page[42, :] = 200, 200
    got = circles.crop(page, 100, 100, 36, BubbleView(1, 1.6, 9, 9))  # 36 * 1.6 = 57.6: from 42, 115 wide
    assert got.shape[:2] == (115, 115) and (got[:, 0] == 200).all() and (got[0, :] == 200).all() and not got[1:, 1:].any()


def test_views_of_circles(spark):
    from tagweave.schema import BUBBLE_VIEWS

    got = circles.views(spark.createDataFrame([("d", 1, 1, 100.0, 80.0, 36.0)], "drawing_id string, bubble_id int, page int, cx double, cy double, r double")).orderBy("variant").collect()
    assert [(r["variant"], r["x"], r["w"]) for r in got] == [(i, 100 - 36 * v.pad, 2 * 36 * v.pad) for i, v in enumerate(BUBBLE_VIEWS)]


def test_boxes_of_clicks_at_all_corners(spark):
    clicks = [("d", i, 1, fx, fy, 1000.0, 800.0) for i, (fx, fy) in enumerate([(0.0, 0.0), (1.0, 0.0), (0.0, 1.0), (1.0, 1.0), (0.5, 0.5), (0.99, 0.5)])]
    rows = review.manual_tags(spark.createDataFrame(clicks, "drawing_id string, tag_seq long, page int, fx double, fy double, page_width double, page_height double"), "KG", "now").orderBy("tag_seq").collect()
    assert [(r["x0"], r["y0"], r["x1"], r["y1"]) for r in rows] == [(0, 0, 45, 18), (955, 0, 1000, 18), (0, 782, 45, 800), (955, 782, 1000, 800), (455, 382, 545, 418), (945, 382, 1000, 418)]


def test_detail_crop_stays_on_the_page(spark):
    t = tags(spark, [("a", "PT-1", 50, 50, {}), ("b", "PT-2", 500, 400, {})]).withColumns({"page_width": F.lit(1000.0), "page_height": F.lit(800.0)})
    got = {r["id"]: r for r in review.detail_crop(t, 240, 120, 2.0).collect()}
    # boxes of 80 x 60: the scale is min(240/80, 120/60) / 2
    assert all(r["scale"] == 1.0 and (r["sw"], r["sh"]) == (240, 120) for r in got.values())
    assert (got["a"]["sx"], got["a"]["sy"]) == (0, 0) and (got["b"]["sx"], got["b"]["sy"]) == (380, 340)


def test_notices_and_report(spark):
    fixes = spark.createDataFrame([("d", "a"), ("d", "a"), ("e", "x")], "drawing_id string, id string")
    t = tags(spark, [("u", "?-1", 0, 0, {"type": "Unreadable bubble"}), ("v", "PT-1", 0, 0, {})])
    assert sorted(map(tuple, review.notices(t, fixes).collect())) == [("d", 1, 2), ("e", 0, 1)]  # each adjusted reading counts
    names = spark.createDataFrame([(f"n{i:02d}",) for i in range(12)], "t string").coalesce(1)
    assert review.report(names, "t") == ", ".join(f"n{i:02d}" for i in range(10)) + " (+2 more)" and review.report(names.limit(2), "t") == "n00, n01"


def test_edit_keys_meet_wherever_a_correction_is_possible(spark):
    rng = np.random.default_rng(3)
    make = lambda: "".join(rng.choice(list("0123456789"), rng.integers(1, 6))) + "".join(rng.choice(list("AB"), rng.integers(0, 3)))
    found = list({make() for _ in range(60)} | {"1321A", "13217", "1321", "1327", "378A", "1378A", ""})
    t = spark.createDataFrame([(x,) for x in found], "a string")
    both = t.crossJoin(t.withColumnRenamed("a", "b"))  # a small fixture
    rows = both.select("a", "b", S.correction_kind(F.col("a"), F.col("b")).alias("k"), F.arrays_overlap(S.edit_keys(F.col("a"), False), S.edit_keys(F.col("b"), True)).alias("meet")).filter("k IS NOT NULL").collect()
    assert len(rows) > 5 and all(r["meet"] for r in rows)


def test_bubbles_to_reviewed_tags(spark):
    """Votes, words, placeholders and reconciliation in one call."""
    from tagweave.plans.pipeline import extract_drawing

    places = [(0, "AOV", "1321A", 3576, 2169), (1, "SVO", "13217", 3306, 2160), (2, "ZSC", "1321", 3417, 2769), (3, "AOV", "1321", 3576, 2778), (4, "SVO", "1321", 3306, 2766), (5, None, "13214", 3417, 2067)]
    rings = spark.createDataFrame([("d", i, 1, float(x), float(y), 40.0) for i, _, _, x, y in places], "drawing_id string, bubble_id long, page int, cx double, cy double, r double")
    reads = spark.createDataFrame([("d", i, v, k, t, 80.0) for i, f, n, _, _ in places for v in (0, 1) for k, t in enumerate((f, n)) if t], "drawing_id string, bubble_id long, variant int, read_seq long, text string, confidence double")
    got, _ = extract_drawing(spark.createDataFrame([], WORDS), rings, reads)
    texts = {(r["text"], r["state"]) for r in got.collect()}
    assert ("SVO-1321A", "uncertain") in texts and any(s == "illegible" and t.startswith("?-") for t, s in texts)
