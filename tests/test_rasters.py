"""From rasters to reviewed tags with a fake recogniser; edges and circles of tiles against whole pages; annotated pages."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagweave.operators import annotate, circles, recognition
from tagweave.plans import pipeline
from tagweave.schema import CircleOptions, Settings
from tagweave.sources import readers

from .fakes import Recogniser, Renderer, document, draw, ring

RASTER = "drawing_id string, page int, height int, width int, n_channels int, data binary"


def sheet(side=420):
    page = np.full((side, side, 3), 255, np.uint8)
    ring(page, 100, 110, 40)
    draw(page, "PT", 94, 93)
    draw(page, "1378A", 85, 112)
    ring(page, 300, 120, 42)  # nothing in it
    ring(page, 120, 320, 38)
    draw(page, "FIC", 111, 303)  # a half is missing
    draw(page, "PSV-2001", 250, 250)
    draw(page, "FCV-1002", 360, 300, turned=True)
    return page


def row(name, number, page):
    return (name, number, page.shape[0], page.shape[1], page.shape[2], page.tobytes())


def by_text(tags):
    return {r["text"]: r for r in tags.collect()}


def test_rasters_to_tags(spark):
    rasters = spark.createDataFrame([row("d", 1, sheet()), row("d", 2, sheet()), row("e", 1, np.full((60, 80, 3), 255, np.uint8))], RASTER)
    words, found, reads = recognition.recognised(rasters, Recogniser())
    assert found.filter("drawing_id = 'd'").count() == 6 == found.select("bubble_id").distinct().count()
    # both views of a circle were read, each on its own
    assert {(r["text"], r["variant"]) for r in reads.filter("text IN ('PT', '1378A')").collect()} == {(t, v) for t in ("PT", "1378A") for v in (0, 1)}
    turned = words.filter("text = 'FCV-1002'").collect()
    assert len(turned) == 2 and all((r["x0"], r["y0"], r["x1"], r["y1"]) == (360, 300, 370, 348) for r in turned)
    tags, _ = pipeline.extract_drawing(words, found, reads)
    got = tags.collect()
    assert sorted((r["text"], r["page"]) for r in got if r["state"] != "illegible") == sorted((t, p) for t in ("PT-1378A", "PSV-2001", "FCV-1002") for p in (1, 2))
    assert all(r["origin"] == "bubble" for r in got if r["text"] == "PT-1378A")
    lost = sorted((r["page"], r["text"]) for r in got if r["state"] == "illegible")
    assert lost == [(1, ""), (1, "FIC-?"), (2, "", ), (2, "FIC-?")]
    words, found, reads = recognition.recognised(rasters, Recogniser(), Settings(detect_bubbles=False))
    assert found is None and reads is None and words.count() > 0


def test_uploads_to_tags_in_one_call(spark, tmp_path):
    """An image, a PDF by its name and one by its first bytes, whose circles are drawn anew from the source."""
    small = np.full((200, 200, 3), 255, np.uint8)
    ring(small, 60, 60, 22)
    draw(small, "T", 57, 48)
    draw(small, "77", 54, 62)
    (tmp_path / "a.pdf").write_bytes(document(small))
    (tmp_path / "b.png").write_bytes(document(small))
    (tmp_path / "c.png").write_bytes(annotate._png(sheet()))
    (tmp_path / "notes.txt").write_text("PT-1")
    uploads = {r["path"].rsplit("/", 1)[1]: r["kind"] for r in readers.files(spark, str(tmp_path)).collect()}
    assert uploads == {"a.pdf": "pdf", "b.png": "pdf", "c.png": "image"}
    settings = Settings(ocr_scale=2.0, bubble_min_radius=16, bubble_max_radius=24)
    tags, _ = pipeline.read_drawings(spark, str(tmp_path), Recogniser(), Renderer(), settings)
    got = {(r["drawing_id"].rsplit("/", 1)[1], r["text"], r["origin"]) for r in tags.filter("state <> 'illegible'").collect()}
    assert {("a.pdf", "T-77", "bubble"), ("b.png", "T-77", "bubble"), ("c.png", "PT-1378A", "bubble"), ("c.png", "PSV-2001", "page"), ("c.png", "FCV-1002", "page")} <= got
    with pytest.raises(ValueError):
        pipeline.read_drawings(spark, str(tmp_path), Recogniser())


def pixel_rows(spark, page, gray):
    y, x = np.nonzero(gray != 255)
    return spark.createDataFrame([(page, int(a), int(b), float(gray[b, a])) for b, a in zip(y, x)], "page int, x long, y long, gray double")


@pytest.mark.parametrize("tile", [5, 16, 128])
def test_edges_of_tiles_equal_those_of_the_page(spark, tile):
    rng = np.random.default_rng(3)
    gray = np.full((61, 83), 255.0)
    ys, xs = rng.integers(0, 61, 400), rng.integers(0, 83, 400)
    gray[ys, xs] = rng.integers(0, 255, 400)
    x, y, ux, uy = circles._edges(gray, 60)
    want = {(int(a), int(b)): (c, d) for a, b, c, d in zip(x, y, ux, uy)}
    pages = spark.createDataFrame([(1, 83, 61), (2, 83, 61)], "page int, width long, height long")
    got = circles.edges(pixel_rows(spark, 1, gray), pages, tile=tile).collect()
    assert {(r["x"], r["y"]): (r["ux"], r["uy"]) for r in got} == want and len(got) == len(want) > 500
    assert {(r["page"], r["width"], r["height"]) for r in got} == {(1, 83, 61)}


def test_circles_of_relations_equal_those_of_the_detector(spark):
    """Pixels as rows, all the way: means of squares, edges of tiles, votes, peaks, separation, ring and ink."""
    page = sheet()
    page[200:240, 330:390] = 0  # ink that is no circle
    y, x = np.mgrid[0:420, 0:420]
    page[np.hypot(x - 210, y - 210) <= 36] = 0  # a filled one
    o = CircleOptions()
    want = sorted(circles.find_circles(page, o))
    gray = page[: 420 // 3 * 3, : 420 // 3 * 3].astype(float).mean(axis=2)
    rows = spark.createDataFrame([(1, int(b), int(a), float(gray[a, b])) for a in range(420) for b in range(420)], "page int, x long, y long, gray double")
    small = circles.shrunk(rows, o.scale).filter("gray < 255").cache()
    pages = spark.createDataFrame([(1, 140, 140)], "page int, width long, height long")
    low, high = max(2, math.floor(o.min_radius / 3 + 0.5)), math.floor(o.max_radius / 3 + 0.5)
    peaks = circles.bucket_peaks(circles.hough_votes(circles.edges(small, pages, o.edge, tile=32), low, high, o.votes), o.bucket)
    found = circles.verified(circles.separated(peaks, o.apart), small.filter(F.col("gray") < o.dark), pages, o)
    got = sorted((r["cx"] * 3, r["cy"] * 3, r["r"] * 3) for r in found.collect())
    assert got == want and len(want) == 3


def test_shares_of_ring_and_disk(spark):
    rng = random.Random(4)
    dark = np.zeros((70, 90), bool)
    for _ in range(1500):
        dark[rng.randrange(70), rng.randrange(90)] = True
    o = CircleOptions()
    some = [(rng.randrange(-5, 95), rng.randrange(-5, 75), rng.randint(2, 25)) for _ in range(40)]
    found = spark.createDataFrame([(1, x, y, r) for x, y, r in some], "page int, cx long, cy long, r int").distinct()
    ink = spark.createDataFrame([(1, int(x), int(y)) for y, x in zip(*np.nonzero(dark))], "page int, x int, y int")
    pages = spark.createDataFrame([(1, 90, 70)], "page int, width long, height long")
    kept = {(r["cx"], r["cy"], r["r"]) for r in circles.verified(found, ink, pages, o).collect()}
    assert kept == {c for c in some if circles._ring(dark, *c, o) and circles._hollow(dark, *c, o)} and 0 < len(kept) < len(set(some))


def test_annotated_pages_read_back(spark, tmp_path):
    pages = {("d/1", 1): sheet(), ("d/1", 2): np.full((50, 70, 4), 255, np.uint8), ("e", 1): np.full((40, 40, 1), 9, np.uint8)}
    rasters = spark.createDataFrame([row(d, p, a) for (d, p), a in pages.items()], RASTER)
    boxes = [("d/1", 1, 1, "confirmed", 60.0, 60.0, 140.0, 150.0), ("d/1", 1, 2, "illegible", 100.0, 100.0, 200.0, 130.0), ("d/1", 2, 3, "uncertain", -5.0, 10.0, 30.0, 90.0), ("d/1", 1, 4, "confirmed", 0.0, 0.0, 0.0, 0.0)]
    tags = spark.createDataFrame(boxes, "drawing_id string, page int, tag_seq long, state string, x0 double, y0 double, x1 double, y1 double")
    annotate.write(annotate.pictures(rasters, tags), tmp_path.as_uri())
    back = {r["drawing_id"].rsplit("/", 1)[1]: r for r in readers.images(spark, str(tmp_path)).collect()}
    assert set(back) == {"d_1-page-1-annotated.png", "d_1-page-2-annotated.png", "e-page-1-annotated.png"}
    for (d, p), a in pages.items():
        r = back[f"{d.replace('/', '_')}-page-{p}-annotated.png"]
        got = np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], r["n_channels"])[:, :, :3]
        want = np.repeat(a, 3, axis=2) if a.shape[2] == 1 else a[:, :, :3].copy()
        for _, _, _, state, x0, y0, x1, y1 in sorted((b for b in boxes if b[:2] == (d, p) and b[6] > b[4]), key=lambda b: b[2]):
            colour = {"confirmed": (0x4A, 0xA3, 0x16), "illegible": (0x26, 0x26, 0xDC), "uncertain": (0x0B, 0x9E, 0xF5)}[state]
            ys, xs = np.mgrid[0 : a.shape[0], 0 : a.shape[1]]
            outer = (xs >= x0 - 1) & (xs < x1 + 1) & (ys >= y0 - 1) & (ys < y1 + 1)
            inner = (xs >= x0 + 1) & (xs < x1 - 1) & (ys >= y0 + 1) & (ys < y1 - 1)
            want[outer & ~inner] = colour
        assert (got == want).all(), (d, p)
