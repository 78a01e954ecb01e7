"""Circular symbols on a page raster, found by gradient votes.

``detect`` runs numpy on one page per row (a raster is a unit that no relation splits);
``hough_votes``, ``bucket_peaks`` and ``separated`` are the voting steps as relations.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import BUBBLE_VIEWS, BubbleView, CircleOptions
from .extract import suppress


def _round(x):
    return np.floor(np.asarray(x) + 0.5).astype(np.int64)


def _edges(gray: np.ndarray, least: float):
    """Interior pixels with a steep gradient: places and unit vectors."""
    g = gray.astype(np.float64)
    gx = (g[:-2, 2:] + 2 * g[1:-1, 2:] + g[2:, 2:]) - (g[:-2, :-2] + 2 * g[1:-1, :-2] + g[2:, :-2])
    gy = (g[2:, :-2] + 2 * g[2:, 1:-1] + g[2:, 2:]) - (g[:-2, :-2] + 2 * g[:-2, 1:-1] + g[:-2, 2:])
    size = gx * gx + gy * gy
    y, x = np.nonzero(size > least * least)
    norm = np.sqrt(size[y, x])
    return x + 1, y + 1, gx[y, x] / norm, gy[y, x] / norm


def find_circles(pixels: np.ndarray, o: CircleOptions = CircleOptions()) -> list[tuple[int, int, int]]:
    """(cx, cy, r) of circles on a raster (height, width, channels)."""
    ds = o.scale
    h, w = pixels.shape[0] // ds, pixels.shape[1] // ds
    if min(h, w) < 4:
        return []
    gray = pixels[: h * ds, : w * ds, :3].astype(np.float64).mean(axis=2).reshape(h, ds, w, ds).mean(axis=(1, 3)).astype(np.float32)
    low = max(2, int(_round(o.min_radius / ds)))
    high = max(low, int(_round(o.max_radius / ds)))
    x, y, ux, uy = _edges(gray, o.edge)
    found = []
    for r in range(low, high + 1):
        votes = np.zeros(h * w, np.int64)
        for sign in (1, -1):
            cx, cy = _round(x + sign * r * ux), _round(y + sign * r * uy)
            ok = (cx >= 0) & (cx < w) & (cy >= 0) & (cy < h)
            votes += np.bincount(cy[ok] * w + cx[ok], minlength=h * w)
        hot = np.flatnonzero(votes >= max(1, int(_round(2 * math.pi * r * o.votes))))
        peaks: dict[tuple[int, int], int] = {}
        for at in hot.tolist():  # row by row: the first of equals stays
            key = (at // w // o.bucket, at % w // o.bucket)
            if key not in peaks or votes[at] > votes[peaks[key]]:
                peaks[key] = at
        found += [(int(votes[at]), r, at % w, at // w) for at in peaks.values()]
    found.sort(key=lambda f: -f[0])
    kept: list[tuple[int, int, int]] = []
    for _, r, cx, cy in found:
        if all(math.hypot(cx - a, cy - b) >= o.apart * max(r, q) for a, b, q in kept):
            kept.append((cx, cy, r))
    dark = gray < o.dark
    return [(cx * ds, cy * ds, r * ds) for cx, cy, r in kept if _ring(dark, cx, cy, r, o) and _hollow(dark, cx, cy, r, o)]


def _ring(dark: np.ndarray, cx: int, cy: int, r: int, o: CircleOptions) -> bool:
    """Enough points of the circumference have ink within a pixel."""
    h, w = dark.shape
    hits = 0
    for k in range(o.samples):
        a = 2 * math.pi * k / o.samples
        px, py = int(_round(cx + r * math.cos(a))), int(_round(cy + r * math.sin(a)))
        hits += bool(dark[max(0, py - 1) : min(h, py + 2), max(0, px - 1) : min(w, px + 2)].any()) if py >= -1 and px >= -1 else False
    return hits / o.samples >= o.coverage


def _hollow(dark: np.ndarray, cx: int, cy: int, r: int, o: CircleOptions) -> bool:
    """A bubble holds text, not a filled shape."""
    h, w = dark.shape
    inner = max(1, int(_round(r * o.inner)))
    y, x = np.mgrid[-inner : inner + 1, -inner : inner + 1]
    inside = x * x + y * y <= inner * inner
    px, py = x[inside] + cx, y[inside] + cy
    ok = (px >= 0) & (px < w) & (py >= 0) & (py < h)
    return not ok.any() or dark[py[ok], px[ok]].mean() <= o.ink


def detect(rasters: DataFrame, o: CircleOptions = CircleOptions()) -> DataFrame:
    """rasters (drawing_id, page, height, width, n_channels, data) -> (drawing_id, page, bubble_id, cx, cy, r), one page at a time."""

    def run(batches):
        for pdf in batches:
            for p in pdf.itertuples():
                found = find_circles(np.frombuffer(p.data, np.uint8).reshape(p.height, p.width, p.n_channels), o)
                yield pd.DataFrame([(p.drawing_id, p.page, i, *c) for i, c in enumerate(found)], columns=["drawing_id", "page", "bubble_id", "cx", "cy", "r"])

    return rasters.select("drawing_id", "page", "height", "width", "n_channels", "data").mapInPandas(run, "drawing_id string, page int, bubble_id long, cx int, cy int, r int")


#: votes that a task counts, about
TASK_VOTES = 500_000


def hough_votes(edges: DataFrame, low: int, high: int, share: float = 0.20, task_votes: int = TASK_VOTES) -> DataFrame:
    """edges (page, x, y, ux, uy, width, height) -> (page, r, cx, cy, votes) of cells with enough votes.

    Most cells get one vote, so counts before the shuffle would hold nearly all votes of a file in one task.  Votes are dealt
    by cell first, to as many tasks as their number asks for, and counted there; Spark doesn't unite those.  The edges are
    read twice, to count them and to vote: give a stored table where they are costly.
    """
    tasks = max(1, -(-edges.count() * 2 * (high - low + 1) // task_votes))
    both = edges.select("*", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("r")).select("*", F.explode(F.array(F.lit(1), F.lit(-1))).alias("sign"))
    at = both.select("page", "r", "width", "height", F.floor(F.col("x") + F.col("sign") * F.col("r") * F.col("ux") + 0.5).alias("cx"), F.floor(F.col("y") + F.col("sign") * F.col("r") * F.col("uy") + 0.5).alias("cy"))
    cell = ["page", "r", "cx", "cy"]
    inside = at.filter("cx >= 0 AND cx < width AND cy >= 0 AND cy < height").select(*cell).repartition(tasks, *cell)
    return inside.groupBy(*cell).agg(F.count("*").alias("votes")).filter(F.col("votes") >= F.floor(2 * math.pi * F.col("r") * share + 0.5))


def bucket_peaks(votes: DataFrame, bucket: int = 4) -> DataFrame:
    """The strongest cell of each bucket and radius, the first row by row on ties."""
    w = Window.partitionBy("page", "r", F.floor(F.col("cy") / bucket), F.floor(F.col("cx") / bucket)).orderBy(F.desc("votes"), "cy", "cx")
    return votes.withColumn("k", F.row_number().over(w)).filter("k = 1").drop("k")


def separated(peaks: DataFrame, apart: float = 1.2) -> DataFrame:
    """Circles by votes, none nearer to a stronger one than 1.2 of the larger radius."""
    clash = lambda a, b: F.hypot(a["cx"] - b["cx"], a["cy"] - b["cy"]) < apart * F.greatest(a["r"], b["r"])
    return suppress(peaks, ("page",), [-F.col("votes"), F.col("r"), F.col("cy"), F.col("cx")], clash, (F.col("cx"), F.col("cy"), apart * F.col("r")), ("cx", "cy", "r"))


#: pixels of a tile's side
TILE = 128


def shrunk(pixels: DataFrame, scale: int, group: tuple[str, ...] = ("page",)) -> DataFrame:
    """pixels (page, x, y, gray), all of a page, as means of squares of ``scale`` pixels; squares that aren't whole go."""
    mean = pixels.groupBy(*group, F.floor(F.col("x") / scale).alias("x"), F.floor(F.col("y") / scale).alias("y")).agg(F.avg("gray").alias("gray"), F.count("*").alias("n"))
    return mean.filter(F.col("n") == scale * scale).drop("n")


def edges(pixels: DataFrame, pages: DataFrame, least: float = 60, group: tuple[str, ...] = ("page",), tile: int = TILE) -> DataFrame:
    """pixels (page, x, y, gray) and pages (page, width, height) -> (page, x, y, ux, uy, width, height) of interior pixels with a steep gradient.

    A page may be larger than a task: pixels go to their tile, and those at its rim to the neighbours that look at them,
    so each tile has a halo of one pixel and no edge depends on how a page is cut.  Pixels that aren't given are white.
    """
    near = lambda v: F.array_distinct(F.array(*[F.floor((F.col(v) + d) / tile) for d in (-1, 0, 1)]))
    dealt = pixels.join(pages, [*group]).withColumn("ty", F.explode(near("y"))).withColumn("tx", F.explode(near("x")))
    kinds = dict(pixels.dtypes)
    schema = ", ".join([f"{g} {kinds[g]}" for g in group] + ["x long", "y long", "ux double", "uy double", "width long", "height long"])
    names = [*group, "x", "y", "ux", "uy", "width", "height"]

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        ty, tx = key[-2].as_py(), key[-1].as_py()
        width, height = rows["width"][0].as_py(), rows["height"][0].as_py()
        x, y = rows["x"].to_numpy() - tx * tile + 1, rows["y"].to_numpy() - ty * tile + 1
        gray = np.full((tile + 2, tile + 2), 255.0)
        gray[y, x] = rows["gray"].to_numpy()
        px, py, ux, uy = _edges(gray, least)
        px, py = px + tx * tile - 1, py + ty * tile - 1
        inner = (px >= 1) & (px < width - 1) & (py >= 1) & (py < height - 1)
        found = [px[inner], py[inner], ux[inner], uy[inner]]
        n = int(inner.sum())
        return pa.table([pa.array([k.as_py()] * n, k.type) for k in key[:-2]] + [pa.array(c) for c in found] + [pa.array(np.full(n, v, np.int64)) for v in (width, height)], names=names)

    return dealt.groupBy(*group, "ty", "tx").applyInArrow(run, schema)


def measured(found: DataFrame, dark: DataFrame, pages: DataFrame, o: CircleOptions = CircleOptions(), group: tuple[str, ...] = ("page",)) -> DataFrame:
    """Circles (page, cx, cy, r) with ring, the share of points of the circumference that have ink within a pixel, and ink, the inked share of the disk inside; dark: (page, x, y) of inked pixels.

    Points and disks are cells that meet dark ones in one equi-join; both shares are conditional sums by circle.
    """
    circle = [*group, "cx", "cy", "r"]
    angles = [2 * math.pi * k / o.samples for k in range(o.samples)]
    points = F.array(*[F.struct(F.lit(k).alias("k"), F.floor(F.col("cx") + F.col("r") * math.cos(a) + 0.5).alias("x"), F.floor(F.col("cy") + F.col("r") * math.sin(a) + 0.5).alias("y")) for k, a in enumerate(angles)])
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    own = found.select(*circle).distinct().join(pages, [*group])
    ring = own.select(*circle, F.explode(points).alias("p")).select(*circle, "p.k", "p.x", "p.y", F.explode(around).alias("d")).select(*circle, "k", (F.col("x") + F.col("d.i")).alias("x"), (F.col("y") + F.col("d.j")).alias("y"))
    inner = F.greatest(F.lit(1), F.floor(F.col("r") * o.inner + 0.5)).cast("int")
    disk = own.withColumn("q", inner).withColumn("i", F.explode(F.sequence(-F.col("q"), "q"))).withColumn("j", F.explode(F.sequence(-F.col("q"), "q"))).filter("i * i + j * j <= q * q")
    disk = disk.select(*circle, F.lit(-1).alias("k"), (F.col("cx") + F.col("i")).alias("x"), (F.col("cy") + F.col("j")).alias("y"), "width", "height").filter("x >= 0 AND y >= 0 AND x < width AND y < height").drop("width", "height")
    inked = dark.select(*group, F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y")).distinct().withColumn("hit", F.lit(1))
    cells = ring.unionByName(disk).join(inked, [*group, "x", "y"], "left").groupBy(*circle, "k").agg(F.count("hit").alias("hits"), F.count("*").alias("n"))
    shares = cells.groupBy(*circle).agg((F.count_if((F.col("k") >= 0) & (F.col("hits") > 0)) / o.samples).alias("ring"), F.coalesce(F.max(F.when(F.col("k") == -1, F.col("hits") / F.col("n"))), F.lit(0.0)).alias("ink"))
    return found.join(shares, circle)


def verified(found: DataFrame, dark: DataFrame, pages: DataFrame, o: CircleOptions = CircleOptions(), group: tuple[str, ...] = ("page",)) -> DataFrame:
    """Circles with enough ink on their circumference, and not too much inside."""
    return measured(found, dark, pages, o, group).filter((F.col("ring") >= o.coverage) & (F.col("ink") <= o.ink)).drop("ring", "ink")


def crop(pixels: np.ndarray, cx: float, cy: float, r: float, view: BubbleView, base_scale: float = 1.0) -> np.ndarray:
    """A square around a circle, scaled up by nearest pixels, white outside the page and the view's ellipse."""
    half = r * view.pad
    side = max(1, int(_round(2 * half)))
    up = max(1.0, view.scale / base_scale)
    n = max(1, int(_round(side * up)))
    grid = np.floor((np.arange(n) + 0.5) / up).astype(np.int64)
    xs, ys = grid + int(_round(cx - half)), grid + int(_round(cy - half))
    out = np.full((n, n, pixels.shape[2]), 255, np.uint8)
    oy, ox = (ys >= 0) & (ys < pixels.shape[0]), (xs >= 0) & (xs < pixels.shape[1])
    out[np.ix_(oy, ox)] = pixels[np.ix_(ys[oy], xs[ox])]
    return masked(out, view)


def views(circles: DataFrame) -> DataFrame:
    """Each circle once for each of BUBBLE_VIEWS: the region (x, y, w, h) of its page that a recogniser reads, its scale and mask."""
    every = F.array(*[F.struct(F.lit(i).alias("variant"), *[F.lit(float(getattr(v, k))).alias(k) for k in ("scale", "pad", "rx", "ry")]) for i, v in enumerate(BUBBLE_VIEWS)])
    half = F.col("r") * F.col("pad")
    return circles.withColumn("_view", F.explode(every)).select("*", "_view.*").drop("_view").withColumns({"x": F.col("cx") - half, "y": F.col("cy") - half, "w": 2 * half, "h": 2 * half})


def masked(region: np.ndarray, view: BubbleView) -> np.ndarray:
    """White outside the ellipse with half axes (w/2)(rx/pad) and (h/2)(ry/pad)."""
    h, w = region.shape[:2]
    y, x = np.mgrid[0:h, 0:w]
    a, b = w / 2 * view.rx / view.pad, h / 2 * view.ry / view.pad
    out = region.copy()
    out[((x + 0.5 - w / 2) / a) ** 2 + ((y + 0.5 - h / 2) / b) ** 2 > 1] = 255
    return out
