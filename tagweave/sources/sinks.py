"""Sinks: CSV text, workbook, and the catalog of drawings."""

from __future__ import annotations

import io
import time
import zipfile
from collections.abc import Iterator
from typing import IO
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dims
from ..functions import scalars as S
from ..operators import review


def csv_lines(rows: DataFrame, order: list[str]) -> DataFrame:
    """(seq, line): the header and each row as CSV text; order: columns that sort the rows, left out of the text."""
    shown = [c for c in rows.columns if c not in order]
    line = F.concat_ws(",", *[S.csv_cell(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))) for c in shown])
    head = rows.sparkSession.range(1).select(F.lit(",".join(_cell(c) for c in shown)).alias("line"), F.lit(0).alias("_head"), *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in order])
    return rows.select(line.alias("line"), F.lit(1).alias("_head"), *order).unionByName(head).orderBy("_head", *order)


def _cell(x: str) -> str:
    return '"' + x.replace('"', '""') + '"' if any(c in x for c in '",\r\n') else x


def write_csv(rows: DataFrame, order: list[str], path: str) -> None:
    """One drawing's rows as one text file; a drawing's list is small."""
    csv_lines(rows, order).select("line").coalesce(1).write.text(path, lineSep="\n")


def csv_text(rows: DataFrame, order: list[str]) -> str:
    return "\n".join(r["line"] for r in csv_lines(rows, order).select("line").toLocalIterator())


def tags_csv(tags: DataFrame) -> str:
    return csv_text(review.export_rows(tags).withColumn("_seq", F.monotonically_increasing_id()), ["_seq"])


def lines_csv(lines: DataFrame) -> str:
    return csv_text(lines.select(*[F.col(c).alias(h) for h, c in dims.LINE_HEADERS.items()]).withColumn("_seq", F.monotonically_increasing_id()), ["_seq"])


def _shown(column: str, kind: str):
    """A cell of a sheet: a number, or text; empty ones have no value."""
    c = F.col(f"`{column}`")
    if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal"):
        return F.when(c.isNull(), "<c/>").otherwise(F.concat(F.lit("<c><v>"), c.cast("string"), F.lit("</v></c>")))
    text = c.cast("string")
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(mark), F.lit(name))
    text = F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")  # XML has no such characters
    return F.when(F.coalesce(c.cast("string"), F.lit("")) == "", "<c/>").otherwise(F.concat(F.lit('<c t="inlineStr"><is><t xml:space="preserve">'), text, F.lit("</t></is></c>")))


def _sheet(rows: DataFrame, least: int) -> Iterator[str]:
    """The XML of a sheet, a row at a time, in the order of rows: executors write the rows, the driver holds a partition's at most."""
    widths = rows.agg(*[F.max(F.length(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")))).alias(str(i)) for i, c in enumerate(rows.columns)]).first()
    cols = "".join(f'<col min="{i}" max="{i}" width="{max(least, len(c) + 2, (n or 0) + 2)}" customWidth="1"/>' for i, (c, n) in enumerate(zip(rows.columns, widths), 1))
    yield f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><cols>{cols}</cols><sheetData>'
    yield "<row>" + "".join(f'<c t="inlineStr"><is><t xml:space="preserve">{escape(c)}</t></is></c>' for c in rows.columns) + "</row>"
    lines = rows.select(F.concat(F.lit("<row>"), *[_shown(c, kind) for c, kind in rows.dtypes], F.lit("</row>")).alias("line"))
    for r in lines.toLocalIterator():
        yield r["line"]
    yield "</sheetData></worksheet>"


def _plain(rows: list[list], least: int) -> Iterator[str]:
    """The XML of a sheet of a few rows."""
    def cell(v):
        if v is None or v == "":
            return "<c/>"
        if isinstance(v, (int, float)):
            return f"<c><v>{v}</v></c>"
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'

    widths = [max([len(str(v if v is not None else "")) + 2 for v in col] + [least]) for col in zip(*rows)]
    cols = "".join(f'<col min="{i}" max="{i}" width="{w}" customWidth="1"/>' for i, w in enumerate(widths, 1))
    body = "".join("<row>" + "".join(map(cell, r)) + "</row>" for r in rows)
    yield f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><cols>{cols}</cols><sheetData>{body}</sheetData></worksheet>'


def write_workbook(out: IO[bytes], tags: DataFrame, meta: dict[str, str], lines: DataFrame | None = None, notes: DataFrame | None = None, exported: str = "") -> None:
    """An .xlsx file of drawings' tags, in the order of tag_seq: Tags, Drawing, and Lines and Notes where there are any.  Sheets are streamed into the archive."""
    sheets: dict[str, Iterator[str]] = {"Tags": _sheet(review.export_rows(tags.orderBy("drawing_id", "tag_seq")), 12)}
    n = tags.agg(F.count("*"), *[F.count_if(F.col("state") == s) for s in ("confirmed", "uncertain", "illegible")]).first()
    counts = zip(("Tag Count", "Confirmed", "Uncertain", "Illegible", "Exported"), [*n, exported])
    sheets["Drawing"] = _plain([*[[label, meta.get(k, "")] for k, label in dims.META_LABELS.items()], *map(list, counts)], 14)
    for name, df, headers in (("Lines", lines, dims.LINE_HEADERS), ("Notes", notes, dims.NOTE_HEADERS)):
        if df is not None and not df.isEmpty():
            sheets[name] = _sheet(df.select(*[F.col(c).alias(h) for h, c in headers.items()]), 14)
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        over = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}.worksheet+xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("[Content_Types].xml", f'<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>{over}</Types>')
        rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        z.writestr("_rels/.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>")
        for i, parts in enumerate(sheets.values(), 1):
            with z.open(f"xl/worksheets/sheet{i}.xml", "w", force_zip64=True) as f:
                for part in parts:
                    f.write(part.encode())


def workbook(tags: DataFrame, meta: dict[str, str], lines: DataFrame | None = None, notes: DataFrame | None = None, exported: str = "") -> bytes:
    """The same as bytes, for one drawing; many are written to a file."""
    out = io.BytesIO()
    write_workbook(out, tags, meta, lines, notes, exported)
    return out.getvalue()


class Catalog:
    """Millions of drawings (id, meta, tags, lines, notes, saved_at, file, file_name, file_type) as Parquet in hashed buckets.

    Every save appends rows of a later version, a file for each bucket that it touches, and a deletion is such a row
    as well; of an id the last version counts.  ``compact`` writes what counts as the next generation, and a generation counts
    as soon as it is complete, so readers never see half of one.  Saves of the same version by one process at a time; none while compacting.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 256):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, root, root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def generations(self) -> list[int]:
        """Those that are complete, in order."""
        jvm, root, fs = self._fs()
        names = [x.getPath().getName() for x in fs.listStatus(root)] if fs.exists(root) else []
        return sorted(int(n[1:]) for n in names if n[:1] == "g" and fs.exists(jvm.org.apache.hadoop.fs.Path(root, f"{n}/_SUCCESS")))

    def _folder(self, generation: int) -> str:
        return f"{self.path}/g{generation:06d}"

    def _bucket(self, drawing_id):
        return F.pmod(F.xxhash64(drawing_id), F.lit(self.buckets)).cast("int")

    def _append(self, rows: DataFrame) -> None:
        rows = rows.withColumns({"version": F.lit(time.time_ns()), "bucket": self._bucket(F.col("id"))})
        rows.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(self._folder((self.generations() or [1])[-1]))

    def save(self, drawings: DataFrame, saved_at: str) -> None:
        """Replaces drawings of the same ids; one without a file loses the file it had."""
        self._append(drawings.withColumns({"saved_at": F.lit(saved_at), "deleted": F.lit(False)}))

    def delete(self, *drawing_ids: str) -> None:
        known = self._rows().drop("version", "bucket").schema
        ids = self.spark.createDataFrame([(i,) for i in drawing_ids], "id string")
        self._append(ids.select(*[F.col("id") if f.name == "id" else F.lit(True).alias("deleted") if f.name == "deleted" else F.lit(None).cast(f.dataType).alias(f.name) for f in known]))

    def _rows(self) -> DataFrame:
        return self.spark.read.parquet(self._folder(self.generations()[-1]))

    @staticmethod
    def _latest(rows: DataFrame) -> DataFrame:
        """Joined by (id, version), so that columns which nobody reads, files above all, aren't read for it."""
        last = rows.groupBy("bucket", "id").agg(F.max("version").alias("version"))
        return rows.join(last, ["bucket", "id", "version"]).filter("NOT deleted")

    def all(self) -> DataFrame:
        return self._latest(self._rows()).drop("bucket", "version", "deleted")

    def load(self, drawing_id: str) -> DataFrame:
        """Reads one bucket."""
        own = self._rows().filter((F.col("bucket") == self._bucket(F.lit(drawing_id))) & (F.col("id") == drawing_id))
        return self._latest(own).drop("bucket", "version", "deleted")

    def compact(self) -> None:
        """Writes the last versions alone, then drops all generations before the one that this replaces."""
        old = self.generations()
        self._latest(self._rows()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(self._folder(old[-1] + 1))
        jvm, _, fs = self._fs()
        for g in old[:-1]:
            fs.delete(jvm.org.apache.hadoop.fs.Path(self._folder(g)), True)

    def summaries(self) -> DataFrame:
        """One row per drawing, the newest first."""
        return summaries(self.all())

    def tags(self) -> DataFrame:
        return self.all().select(F.col("id").alias("drawing_id"), F.explode("tags").alias("tag")).select("drawing_id", "tag.*")


def summaries(drawings: DataFrame) -> DataFrame:
    return drawings.select(
        "id", "meta.drawing_number", "meta.title", "meta.revision", "meta.source_file_name", F.size("tags").alias("tag_count"),
        F.size(F.filter("tags", lambda t: t["state"] == "confirmed")).alias("confirmed_count"), "saved_at", F.col("file").isNotNull().alias("has_file"),
    ).orderBy(F.desc("saved_at"), "id")


def export_name(drawing_number: str, file_name: str) -> str:
    """Base name of exported files."""
    return drawing_number.strip() or file_name.rpartition(".")[0] or file_name or "pid-tags"
