"""Pipe line numbers, notes and title blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S


def from_numbers(rows: DataFrame, column: str = "line_number") -> DataFrame:
    """Lines of bare numbers: trimmed and split into size, service and specification."""
    t = rows.withColumn("line_number", S.trimmed(F.col(column)))
    parts = S.line_parts(F.col("line_number"))
    return t.withColumns(parts | {c: F.lit("") for c in ("from_ref", "to_ref", "notes")})


def new_lines(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming lines that the drawing doesn't have, whatever their case; repeats within the file stay."""
    have = existing.select(F.upper("line_number").alias("_n"))
    return incoming.withColumn("_n", F.upper("line_number")).join(have, "_n", "left_anti").drop("_n")


def patched(rows: DataFrame, edits: DataFrame, key: str = "id") -> DataFrame:
    """Rows with the edits' values that aren't null; derived parts aren't read anew."""
    changed = [c for c in edits.columns if c != key]
    e = edits.select(key, *[F.col(c).alias(f"_{c}") for c in changed])
    return rows.join(e, key, "left").select(*[F.coalesce(f"_{c}", c).alias(c) if c in changed else F.col(c) for c in rows.columns])


def added_line(lines: DataFrame, number: str, line_id: str) -> DataFrame:
    """The lines and one more; a blank number changes nothing."""
    if not number.strip():
        return lines
    new = from_numbers(lines.sparkSession.range(1).select(F.lit(line_id).alias("id"), F.lit(number).alias("line_number")))
    return lines.unionByName(new.select(*lines.columns))


def added_note(notes: DataFrame, note_id: str) -> DataFrame:
    """The notes (id, flag, text) and a blank one after them."""
    row = {c: F.lit(note_id if c == "id" else "").cast(notes.schema[c].dataType) for c in notes.columns}
    return notes.unionByName(notes.sparkSession.range(1).select(*[v.alias(k) for k, v in row.items()]))


def label(meta: str = "meta"):
    """What a drawing is called in lists."""
    number, file = F.trim(F.col(f"{meta}.drawing_number")), F.col(f"{meta}.source_file_name")
    return F.when(number != "", number).when(file != "", file).otherwise("(untitled)")


def titled(drawings: DataFrame, **changes: str) -> DataFrame:
    """Title-block fields replaced; the source file's name isn't one of them."""
    for name, value in changes.items():
        if name == "source_file_name":
            raise ValueError("the source file's name is display only")
        drawings = drawings.withColumn("meta", F.col("meta").withField(name, F.lit(value)))
    return drawings
