"""Rasters to words: page passes, upright and turned, and readings of each circle, by a recogniser that workers can import.

A page's raster and its circles meet in one task (cogroup by page); only words leave it.  A recogniser is given a
raster and a mode: ``sparse`` for text scattered over a page, ``block`` for the few lines in a circle, of which only
``dims.TAG_ALPHABET`` counts.  Words are (text, x0, y0, x1, y1, confidence) in the raster's own pixels.  Channels are in
the order of Spark's image source: blue, green, red.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import dims, tables
from ..functions import scalars as S
from ..schema import BOX, BUBBLE_VIEWS, CircleOptions, Settings
from ..sources.readers import PageRenderer, WordRecognizer
from . import circles, extract

_READ = "drawing_id string, page int, bubble_id long, variant int, read_seq long, text string, confidence double"
_WORD = "drawing_id string, page int, turned boolean, height double, word_seq long, text string, confidence double, x0 double, y0 double, x1 double, y1 double"


def _pixels(row: dict) -> np.ndarray:
    return np.frombuffer(row["data"], np.uint8).reshape(row["height"], row["width"], row["n_channels"])


def _table(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.Table:
    return pa.table({n: pa.array([r[k] for r in rows], t) for k, (n, t) in enumerate(zip(names, kinds))})


_LONG, _INT, _TEXT, _REAL = pa.int64(), pa.int32(), pa.string(), pa.float64()


def page_words(rasters: DataFrame, recogniser: WordRecognizer) -> DataFrame:
    """Trimmed words of each page (drawing_id, page, height, width, n_channels, data), upright ones first, then those of the page turned clockwise by 90 degrees, with boxes of the upright page."""
    names, kinds = [x.split(" ")[0] for x in _WORD.split(", ")], [_TEXT, _INT, pa.bool_(), _REAL, _LONG, _TEXT, *[_REAL] * 5]

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):  # one page at a time
                row = b.slice(k, 1).to_pylist()[0]
                upright, out = _pixels(row), []
                for turned, seen in ((False, upright), (True, np.ascontiguousarray(np.rot90(upright, -1)))):
                    for text, x0, y0, x1, y1, confidence in recogniser.words(seen.shape[1], seen.shape[0], seen.tobytes(), "sparse"):
                        out.append((row["drawing_id"], row["page"], turned, float(row["height"]), len(out), text, float(confidence), float(x0), float(y0), float(x1), float(y1)))
                yield from _table(out, names, kinds).to_batches()

    found = rasters.select("drawing_id", "page", "height", "width", "n_channels", "data").mapInArrow(run, _WORD)
    found = found.withColumn("text", S.trimmed(F.col("text"))).filter("text <> ''")
    turned = extract.unrotated(found.filter("turned"), "height")
    return found.filter("NOT turned").unionByName(turned.select(*found.columns)).select("drawing_id", "page", "word_seq", "text", "confidence", *BOX, F.lit("page").alias("origin"))


def _reads_of(recogniser: WordRecognizer, view: np.ndarray, drawing: str, page: int, bubble: int, variant: int, out: list) -> None:
    for text, *_, confidence in recogniser.words(view.shape[1], view.shape[0], view.tobytes(), "block"):
        kept = "".join(c for c in text if c in dims.TAG_ALPHABET)
        if kept:
            out.append((drawing, page, bubble, variant, len(out), kept, float(confidence)))


def bubble_reads(rasters: DataFrame, found: DataFrame, recogniser: WordRecognizer, base_scale: float = 1.0) -> DataFrame:
    """Each circle (drawing_id, page, bubble_id, cx, cy, r), cut out of its page's raster and read once for each of BUBBLE_VIEWS."""
    names, kinds = [x.split(" ")[0] for x in _READ.split(", ")], [_TEXT, _INT, _LONG, _INT, _LONG, _TEXT, _REAL]

    def run(pages: pa.Table, symbols: pa.Table) -> pa.Table:
        out: list[tuple] = []
        for row in pages.to_pylist()[:1]:
            pixels = _pixels(row)
            for s in sorted(symbols.to_pylist(), key=lambda s: s["bubble_id"]):
                for variant, view in enumerate(BUBBLE_VIEWS):
                    _reads_of(recogniser, circles.crop(pixels, s["cx"], s["cy"], s["r"], view, base_scale), row["drawing_id"], row["page"], s["bubble_id"], variant, out)
        return _table(out, names, kinds)

    pages = rasters.select("drawing_id", "page", "height", "width", "n_channels", "data").groupBy("drawing_id", "page")
    symbols = found.select("drawing_id", "page", "bubble_id", "cx", "cy", "r").groupBy("drawing_id", "page")
    return pages.cogroup(symbols).applyInArrow(run, _READ)


def rendered_reads(documents: DataFrame, found: DataFrame, recogniser: WordRecognizer, renderer: PageRenderer) -> DataFrame:
    """The same from the vector source (drawing_id, content): each view's region is drawn anew at the view's own scale, then masked.  circles are in pixels of pages drawn at ``found.base_scale``."""
    names, kinds = [x.split(" ")[0] for x in _READ.split(", ")], [_TEXT, _INT, _LONG, _INT, _LONG, _TEXT, _REAL]

    def run(sources: pa.Table, regions: pa.Table) -> pa.Table:
        out: list[tuple] = []
        for row in sources.to_pylist()[:1]:
            for s in sorted(regions.to_pylist(), key=lambda s: (s["page"], s["bubble_id"], s["variant"])):
                k = s["base_scale"]
                width, height, data = renderer.region(row["content"], s["page"], (s["x"] / k, s["y"] / k, s["w"] / k, s["h"] / k), s["scale"])
                view = np.frombuffer(data, np.uint8).reshape(height, width, -1)
                _reads_of(recogniser, circles.masked(view, BUBBLE_VIEWS[s["variant"]]), row["drawing_id"], s["page"], s["bubble_id"], s["variant"], out)
        return _table(out, names, kinds)

    regions = circles.views(found).select("drawing_id", "page", "bubble_id", "variant", "x", "y", "w", "h", "scale", "base_scale")
    return documents.select("drawing_id", "content").groupBy("drawing_id").cogroup(regions.groupBy("drawing_id")).applyInArrow(run, _READ)


def recognised(rasters: DataFrame, recogniser: WordRecognizer, settings: Settings = Settings(), base_scale: float = 1.0, documents: DataFrame | None = None, renderer: PageRenderer | None = None) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """(words, circles, reads) of pages drawn at ``base_scale``, all stored, so that nothing is recognised twice; circles and reads are None if bubbles aren't asked for.

    Radii are those of the settings times their ``ocr_scale``, whatever the page was drawn at.  Without a renderer
    circles are cut out of the raster.
    """
    words = tables.stored(page_words(rasters, recogniser), "words")
    if not settings.detect_bubbles:
        return words, None, None
    options = CircleOptions(min_radius=settings.bubble_min_radius * settings.ocr_scale, max_radius=settings.bubble_max_radius * settings.ocr_scale)
    found = circles.detect(rasters, options)  # numbered by page; a drawing has many
    found = tables.stored(found.withColumn("bubble_id", F.row_number().over(Window.partitionBy("drawing_id").orderBy("page", "bubble_id")).cast("long") - 1), "circles")
    if renderer is not None and documents is not None:
        reads = rendered_reads(documents, found.withColumn("base_scale", F.lit(float(base_scale))), recogniser, renderer)
    else:
        reads = bubble_reads(rasters, found, recogniser, base_scale)
    return words, found, tables.stored(reads.drop("page"), "reads")
