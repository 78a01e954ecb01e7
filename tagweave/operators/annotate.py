"""Annotated pages as pictures: each page's raster and its tags meet in one task, which draws the boxes and writes a PNG."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..schema import BOX

LINE = 2


def _png(pixels: np.ndarray) -> bytes:
    """An 8-bit PNG of (height, width, 3 or 4) pixels, blue first."""
    height, width, channels = pixels.shape
    pixels = pixels[:, :, [2, 1, 0, 3][:channels]]
    rows = np.zeros((height, width * channels + 1), np.uint8)  # each row follows its filter: none
    rows[:, 1:] = pixels.reshape(height, -1)

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, {3: 2, 4: 6}[channels], 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")


def boxed(pixels: np.ndarray, x0: float, y0: float, x1: float, y1: float, colour: str) -> None:
    """Draws a box's edges, LINE pixels wide with their middle on the box, as far as they are on the page."""
    height, width = pixels.shape[:2]
    half = LINE / 2
    paint = np.frombuffer(bytes.fromhex(colour.lstrip("#")), np.uint8)[::-1]

    def fill(left, top, right, bottom):
        a, b = max(0, int(np.floor(left + 0.5))), max(0, int(np.floor(top + 0.5)))
        c, d = min(width, int(np.floor(right + 0.5))), min(height, int(np.floor(bottom + 0.5)))
        if a < c and b < d:
            pixels[b:d, a:c, :3] = paint
            pixels[b:d, a:c, 3:] = 255

    for y in (y0, y1):
        fill(x0 - half, y - half, x1 + half, y + half)
    for x in (x0, x1):
        fill(x - half, y0 - half, x + half, y1 + half)


def pictures(rasters: DataFrame, tags: DataFrame) -> DataFrame:
    """(drawing_id, page, png) of each page (drawing_id, page, height, width, n_channels, data): its raster with the boxes of its tags, in the order of tag_seq, in the colour of their state; tags without an area aren't drawn.

    Labels are rows of review.overlay, for a font belongs to whoever shows the page.  One channel becomes three.
    """
    colours, other = dims.EXPORT_COLOURS, dims.EXPORT_COLOURS["uncertain"]

    def run(pages: pa.Table, boxes: pa.Table) -> pa.Table:
        out = []
        for row in pages.to_pylist()[:1]:
            pixels = np.frombuffer(row["data"], np.uint8).reshape(row["height"], row["width"], row["n_channels"])
            pixels = np.repeat(pixels, 3, axis=2) if row["n_channels"] == 1 else pixels.copy()
            for t in sorted(boxes.to_pylist(), key=lambda t: t["tag_seq"]):
                boxed(pixels, t["x0"], t["y0"], t["x1"], t["y1"], colours.get(t["state"], other))
            out.append((row["drawing_id"], row["page"], _png(pixels)))
        return pa.table({"drawing_id": pa.array([r[0] for r in out], pa.string()), "page": pa.array([r[1] for r in out], pa.int32()), "png": pa.array([r[2] for r in out], pa.binary())})

    drawn = tags.filter(~((F.col("x1") <= F.col("x0")) & (F.col("y1") <= F.col("y0")))).select("drawing_id", "page", "tag_seq", "state", *BOX)
    pages = rasters.select("drawing_id", "page", "height", "width", "n_channels", "data")
    return pages.groupBy("drawing_id", "page").cogroup(drawn.groupBy("drawing_id", "page")).applyInArrow(run, "drawing_id string, page int, png binary")


def write(found: DataFrame, path: str) -> None:
    """Each picture as a file of its own in a folder that all executors reach, named by drawing and page, through Hadoop's file systems."""
    def put(batches):
        from pyarrow import fs

        where, root = fs.FileSystem.from_uri(path)
        for b in batches:
            for drawing, page, png in zip(*(b.column(k).to_pylist() for k in range(3))):
                name = f"{root}/{drawing.replace('/', '_')}-page-{page}-annotated.png"
                with where.open_output_stream(name + ".tmp") as f:
                    f.write(png)
                where.move(name + ".tmp", name)  # whole or absent, also if a task runs twice
                yield pa.RecordBatch.from_pydict({"name": [name]})

    found.select("drawing_id", "page", "png").mapInArrow(put, "name string").count()
