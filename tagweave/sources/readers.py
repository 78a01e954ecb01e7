"""Sources: files, lenient CSV, seed lists, line lists, and the provider interfaces for rendering and recognition."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import dims, tables
from ..functions import scalars as S
from ..operators import lines
from . import csvs


class PageRenderer(Protocol):
    """Turns a document into page rasters, and page regions into rasters at another scale."""

    def pages(self, content: bytes, scale: float) -> Iterator[tuple[int, int, int, bytes]]: ...

    def region(self, content: bytes, page: int, box: tuple[float, float, float, float], scale: float) -> tuple[int, int, bytes]:
        """(width, height, data) of the region (x, y, w, h), in the document's own units, drawn at a scale of its own."""
        ...


class WordRecognizer(Protocol):
    """Reads words with boxes and confidences from a raster; mode: sparse text of a page, or the block of a circle."""

    def words(self, width: int, height: int, data: bytes, mode: str) -> Iterator[tuple[str, float, float, float, float, float]]: ...


def files(spark: SparkSession, path: str) -> DataFrame:
    """Accepted uploads with their kind: a PDF by its first bytes or its name, anything else is an image."""
    glob = "*.{" + ",".join(x for t in dims.UPLOAD_TYPES for x in (t, t.upper())) + "}"
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).withColumn("kind", kind_of(F.col("path"), F.col("content")))


def kind_of(path: Column, content: Column) -> Column:
    return F.when(F.lower(path).endswith(".pdf") | (F.substring(content, 1, 5) == F.lit(b"%PDF-")), "pdf").otherwise("image")


def images(spark: SparkSession, path: str) -> DataFrame:
    """Image files as one page each, at their own resolution."""
    i = spark.read.format("image").option("dropInvalid", True).load(path)
    return i.select(F.col("image.origin").alias("drawing_id"), F.lit(1).alias("page"), F.col("image.height").alias("height"), F.col("image.width").alias("width"), F.col("image.nChannels").alias("n_channels"), F.col("image.data").alias("data"))


def rendered(documents: DataFrame, renderer: PageRenderer, scale: float) -> DataFrame:
    """(drawing_id, page, height, width, n_channels, data) of documents (path, content), by a renderer that workers can import."""
    import pandas as pd

    def run(batches):
        for pdf in batches:
            for d in pdf.itertuples():
                for page, width, height, data in renderer.pages(d.content, scale):
                    yield pd.DataFrame([(d.path, page, height, width, len(data) // max(1, width * height), data)], columns=["drawing_id", "page", "height", "width", "n_channels", "data"])

    return documents.select("path", "content").mapInPandas(run, "drawing_id string, page int, height int, width int, n_channels int, data binary")


def lenient_csv(spark: SparkSession, path: str) -> DataFrame:
    """(drawing_id, row_seq, header, cells) of hand-written CSV files, each with a header of its own; drawing_id is the file's path.  Files are parsed in parallel, however large: see csvs."""
    rows = csvs.rows_of(spark, path)
    heads = rows.filter("row_seq = -1").select("file", F.col("cells").alias("header"))
    return rows.filter("row_seq >= 0").join(csvs.few(tables.stored(heads, "heads")), "file").select(F.col("file").alias("drawing_id"), "row_seq", "header", "cells")


def headers(spark: SparkSession, path: str) -> DataFrame:
    """(drawing_id, header): the first row with text of each file, also of one without another row."""
    return csvs.rows_of(spark, path).filter("row_seq = -1").select(F.col("file").alias("drawing_id"), F.col("cells").alias("header"))


def by_header(name: str):
    """The row's trimmed cell under a normal header name; of equal names the last counts; empty where the file lacks it."""
    normal = F.transform("header", lambda h: F.regexp_replace(F.lower(S.trimmed(h)), r"[\s_-]+", ""))
    back = F.array_position(F.reverse(normal), name)
    return F.when(back > 0, S.trimmed(F.coalesce(F.get("cells", (F.size("header") - back).cast("int")), F.lit("")))).otherwise("")


def _has(aliases: list[str]):
    normal = F.transform("header", lambda h: F.regexp_replace(F.lower(S.trimmed(h)), r"[\s_-]+", ""))
    return F.arrays_overlap(normal, F.array(*[F.lit(a) for a in aliases]))


def _picked(aliases: dict[str, list[str]]):
    return {field: S.first_filled([by_header(a) for a in names]) for field, names in aliases.items()}


def seed_list(spark: SparkSession, path: str) -> DataFrame:
    """All data rows of reviewed tag lists; see operators.merge.seed_distinct.  A file without a tag column: an error that says so."""
    rows = tables.stored(csvs.rows_of(spark, path).select(F.col("file").alias("drawing_id"), "row_seq", "cells"), "seed")
    heads = tables.stored(rows.filter("row_seq = -1").select("drawing_id", F.col("cells").alias("header")), "heads")
    bare = heads.filter(~_has(dims.SEED_ALIASES["tag"])).first()
    if bare or not heads.first():
        raise ValueError(f'No "Tag" column found{f" in {bare[0]}" if bare else ""}: a header row with at least a Tag column is expected.')
    data = rows.filter("row_seq >= 0").join(csvs.few(heads), "drawing_id")
    return data.select("drawing_id", "row_seq", *[(S.review_state(v) if k == "state" else v).alias(k) for k, v in _picked(dims.SEED_ALIASES).items()])


def line_list(spark: SparkSession, path: str) -> DataFrame:
    """Lines of CSV files with a line-number column, and of plain lists by lines or commas, of which repeats go; each file is one or the other."""
    rows = tables.stored(csvs.rows_of(spark, path).select(F.col("file").alias("drawing_id"), "row_seq", "cells"), "lines")
    heads = tables.stored(rows.filter("row_seq = -1").select("drawing_id", F.col("cells").alias("header")), "heads")
    tabled = heads.filter(_has(dims.LINE_ALIASES["line_number"]))
    given = rows.filter("row_seq >= 0").join(csvs.few(tabled), "drawing_id")
    given = given.select("drawing_id", "row_seq", *[v.alias(f"_{k}" if k != "line_number" else k) for k, v in _picked(dims.LINE_ALIASES).items()]).filter("line_number <> ''")
    base = lines.from_numbers(given)
    named = base.select("drawing_id", "row_seq", "line_number", *[(F.when(F.col(f"_{k}") != "", F.col(f"_{k}")).otherwise(F.col(k)) if k in ("size", "service", "spec_code") else F.col(f"_{k}")).alias(k) for k in dims.LINE_ALIASES if k != "line_number"])
    plain = csvs.lines_of(spark, path).join(csvs.few(tabled.select(F.col("drawing_id").alias("file"))), "file", "left_anti")
    parts = plain.select(F.col("file").alias("drawing_id"), "start", F.monotonically_increasing_id().alias("_i"), "line").select("drawing_id", "start", "_i", F.posexplode(F.split("line", ",")).alias("_k", "line_number"))
    found = parts.withColumn("line_number", S.trimmed(F.col("line_number"))).filter("line_number <> ''").groupBy("drawing_id", "line_number").agg(F.min(F.struct("start", "_i", "_k")).alias("first"))
    seen = found.withColumn("row_seq", F.row_number().over(Window.partitionBy("drawing_id").orderBy("first")).cast("long") - 1).drop("first")
    return named.unionByName(lines.from_numbers(seen).select("drawing_id", "row_seq", *dims.LINE_ALIASES))
