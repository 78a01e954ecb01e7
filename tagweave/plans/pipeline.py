"""The whole way from words and bubble readings to reviewed tags."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import tables
from ..operators import consensus, extract, recognition, votes
from ..schema import ReconcileOptions, Settings
from ..sources import readers
from ..sources.readers import PageRenderer, WordRecognizer


def extract_drawing(words: DataFrame, circles: DataFrame | None = None, reads: DataFrame | None = None, settings: Settings = Settings(), options: ReconcileOptions = ReconcileOptions(), keep: Callable[[DataFrame], DataFrame] = tables.stored) -> tuple[DataFrame, DataFrame]:
    """(tags, corrections) of drawings: page words, and bubbles with their readings where there are any.  ``keep`` holds the tags below them, which are read several times: as a table in the shared folder, if nothing else is given."""
    found, lost = words, None
    if settings.detect_bubbles and circles is not None and reads is not None:
        found = extract.united(words, votes.bubble_words(circles, reads))
        lost = votes.placeholders(votes.unread(circles, reads), settings.reviewer)
    tags = extract.extract(found, settings)
    if lost is not None:
        last = tags.groupBy("drawing_id").agg(F.max("tag_seq").alias("_last"))
        tags = tags.unionByName(lost.join(last, "drawing_id", "left").withColumn("tag_seq", F.col("tag_seq") + F.coalesce("_last", F.lit(0))).drop("_last"))
    tags = keep(tags)
    fixes = consensus.corrections(tags, options)
    return consensus.reconcile(tags, options, fixes), fixes


def reapply(words: DataFrame, settings: Settings, options: ReconcileOptions = ReconcileOptions()) -> DataFrame:
    """Tags of words that were read before, with other patterns; edits are discarded."""
    return extract_drawing(words, settings=settings, options=options)[0]


def read_drawings(spark: SparkSession, path: str, recogniser: WordRecognizer, renderer: PageRenderer | None = None, settings: Settings = Settings(), options: ReconcileOptions = ReconcileOptions()) -> tuple[DataFrame, DataFrame]:
    """(tags, corrections) of the uploads in a folder: PDF files by the renderer, whose circles are drawn anew for reading, and images at their own resolution.  PDF files without a renderer: an error."""
    uploads = readers.files(spark, path)
    pdfs = uploads.filter("kind = 'pdf'").select("path", "content")
    parts = [recognition.recognised(readers.images(spark, path), recogniser, settings)]
    if not pdfs.select("path").isEmpty():
        if renderer is None:
            raise ValueError("PDF files need a renderer")
        pages = tables.stored(readers.rendered(pdfs, renderer, settings.ocr_scale), "pages")
        parts.append(recognition.recognised(pages, recogniser, settings, settings.ocr_scale, pdfs.withColumnRenamed("path", "drawing_id"), renderer))
    words, circles, reads = (None if any(p[k] is None for p in parts) else reduce(DataFrame.unionByName, [p[k] for p in parts]) for k in range(3))
    return extract_drawing(words, circles, reads, settings, options)
