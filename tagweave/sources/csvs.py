"""Hand-written CSV files of any size, parsed in parallel.

A quote opens a field only at the field's start, and ends it only before a comma, a line's end or the end of the
text; elsewhere it is an inch mark.  So what a line means depends on whether it begins inside a quoted field, which
all lines before it decide.  Files are read in the chunks that Spark deals to tasks:

1. Each chunk maps both states that it may begin in, outside a quoted field and inside, to the state it ends in.  Only
   lines with a quote count; any other leaves the state as it is.
2. A window over the chunks of a file, in order, composes these maps: the last chunk that ends in one state whatever
   it began in, turned over by each chunk since then that swaps the states.
3. Each chunk is cut into rows from its real state.  A row that crosses chunks is left as fragments, which meet
   by the chunk in which the row began.
4. Rows are numbered by sums over chunks.

No task holds more than a row and a batch of lines; a quoted field that nothing ends runs to the file's end, as one
row.  Line ends may be mixed.  Rows without any text go.  The first row left of each file is its header.  A row's last
field, if its quote is never closed, lacks the file's last line end.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import tables

#: a field: opened by a quote at its start, where a quote ends it only before a comma, a line's end or the end of the text; or plain text
_FIELD = re.compile(r'"((?:""|"(?![,\r\n]|\Z)|[^"])*)(?:"|\Z)|([^,\r\n]*)')
#: what is left of a quoted field, with the quote that ends it
_REST = re.compile(r'(?:""|"(?![,\r\n]|\Z)|[^"])*+"')
_PLAIN = re.compile(r"[^,\r\n]*")
_OUT, _IN = 0, 1


def cells_of(text: str) -> list[list[str]]:
    """Rows of a whole text; blank ones go."""
    text, at, rows, row = text.removeprefix("\ufeff"), 0, [], []
    while at < len(text):
        m = _FIELD.match(text, at)
        row.append(m[1].replace('""', '"') if m[1] is not None else m[2])
        at = m.end()
        if text[at : at + 1] == ",":
            at += 1
            if at == len(text):
                row.append("")
            continue
        rows.append(row)
        row, at = [], at + (2 if text[at : at + 2] == "\r\n" else 1)
    rows += [row] if row else []
    return [r for r in rows if any(c.strip() for c in r)]


def scan(line: str, state: int) -> tuple[list[int], int]:
    """Of a line without its end: where rows end in it (after a carriage return of its own), and the state at its end."""
    at, ends = 0, []
    while True:
        if state == _OUT and line[at : at + 1] == '"':
            state, at = _IN, at + 1
        if state == _IN:
            m = _REST.match(line, at)
            if not m:
                return ends, _IN
            at, state = m.end(), _OUT
        else:
            at = _PLAIN.match(line, at).end()
        if at >= len(line) - (line[at : at + 1] == "\r"):  # a carriage return at its end is part of the line's end
            return ends, _OUT
        if line[at] == "\r":
            ends.append(at + 1)
        at += 1


def _states(batches):
    """(file, start, out, inn, met) of each chunk: the states it ends in, and whether a row ends in it that began before it."""
    schema = pa.schema([("file", pa.string()), ("start", pa.int64()), ("out", pa.int32()), ("inn", pa.int32()), ("met", pa.bool_())])
    chunk, ends, met = None, [_OUT, _IN], False

    def row():
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((*chunk, *ends, met), schema)], schema=schema)

    for b in batches:
        for file, start, line in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            if (file, start) != chunk:
                if chunk:
                    yield row()
                chunk, ends, met = (file, start), [_OUT, _IN], False
            cut, after = scan(line, ends[1])
            met |= bool(cut) or after == _OUT
            ends = [scan(line, ends[0])[1], after]
    if chunk:
        yield row()


_ROWS = pa.schema([("file", pa.string()), ("start", pa.int64()), ("idx", pa.int64()), ("cells", pa.list_(pa.string())), ("begun", pa.int64()), ("text", pa.string())])


def _fields(text: str) -> list[str]:
    """Cells of one row."""
    if '"' not in text:
        return text.split(",")
    out, at = [], 0
    while True:
        m = _FIELD.match(text, at)
        out.append(m[1].replace('""', '"') if m[1] is not None else m[2])
        at = m.end() + 1
        if at > len(text):
            return out


def _cut(batches):
    """Lines (file, start, line, state, begun) in order -> rows (cells) and fragments (text) of rows that cross chunks."""
    out: list[tuple] = []
    held = 0
    chunk, state, begun, idx, parts, head = None, _OUT, None, 0, [], False

    def put(*row):
        nonlocal held
        out.append(row)
        held += len(row[5] or "") + sum(map(len, row[3] or ()))

    def ended():
        """The row in parts is whole, or, if it began in another chunk, its last fragment is."""
        nonlocal idx, parts, head
        text = "\n".join(parts)
        if head:
            put(*chunk, None, None, begun, text)
        else:
            cells = _fields(text)
            if any(c.strip() for c in cells):
                put(*chunk, idx, cells, None, None)
                idx += 1
        parts, head = [], False

    def closed():
        """The chunk is over; what is left crosses its end."""
        if chunk and parts:
            put(*chunk, None, None, begun if head else chunk[1], "\n".join(parts))

    def batch():
        nonlocal out, held
        rows, out, held = out, [], 0
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_ROWS)], schema=_ROWS)

    for b in batches:
        for file, start, line, entry, first in zip(*(b.column(k).to_pylist() for k in range(5))):
            if (file, start) != chunk:
                closed()
                chunk, state, begun, idx, parts = (file, start), entry, first, 0, []
                head = state == _IN
                if start == 0:
                    line = line.removeprefix("\ufeff")
            if state == _OUT and '"' not in line and "\r" not in line[:-1]:
                parts.append(line.removesuffix("\r"))
                ended()
            else:
                cuts, after = scan(line, state)
                at = 0
                for end in cuts:
                    parts.append(line[at : end - 1])
                    ended()
                    at = end
                parts.append(line[at:] if after == _IN else line[at:].removesuffix("\r"))
                if after == _OUT:
                    ended()
                state = after
            if held > 1 << 21:
                yield batch()
    closed()
    if out:
        yield batch()


def _whole(batches):
    for b in batches:
        file, start, idx = (b.column(k) for k in range(3))
        cells = [_fields(t) for t in b.column(3).to_pylist()]
        keep = pa.array([any(c.strip() for c in r) for r in cells])
        yield pa.RecordBatch.from_arrays([file, start, idx, pa.array(cells, pa.list_(pa.string()))], names=["file", "start", "idx", "cells"]).filter(keep)


def few(df: DataFrame) -> DataFrame:
    """A stored side of a join, broadcast if it has few rows."""
    return F.broadcast(df) if df.count() <= tables.FEW else df


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, line): physical lines, in order within each chunk of a file, which starts at the byte ``start``."""
    return spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").alias("line"))


def rows_of(spark: SparkSession, path: str) -> DataFrame:
    """(file, row_seq, cells): all rows of one file or more, the header's row_seq is -1; stored."""
    lines = lines_of(spark, path)
    known = lines.groupBy("file", "start").agg(F.count("*").alias("n"))
    maps = lines.filter(F.contains("line", F.lit('"'))).mapInArrow(_states, "file string, start long, out int, inn int, met boolean")
    chunks = tables.stored(known.join(maps, ["file", "start"], "left").select("file", "start", F.coalesce("out", F.lit(_OUT)).alias("out"), F.coalesce("inn", F.lit(_IN)).alias("inn"), F.coalesce("met", F.lit(False)).alias("met")), "chunks")
    so_far = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    swaps = F.sum(F.when((F.col("out") == _IN) & (F.col("inn") == _OUT), 1).otherwise(0)).over(Window.partitionBy("file").orderBy("start"))
    settled = F.last(F.when(F.col("out") == F.col("inn"), F.struct("out", "swaps")), ignorenulls=True).over(so_far)
    before = chunks.withColumn("swaps", swaps).withColumns({"last": settled, "prior": F.coalesce(F.lag("swaps").over(Window.partitionBy("file").orderBy("start")), F.lit(0))})
    entry = F.coalesce("last.out", F.lit(_OUT)).bitwiseXOR(((F.col("prior") - F.coalesce("last.swaps", F.lit(0))) % 2).cast("int"))
    # a row that crosses chunks began in the last chunk before that isn't wholly inside it
    entered = before.withColumn("state", entry).withColumn("begun", F.last(F.when((F.col("state") == _OUT) | F.col("met"), F.col("start")), ignorenulls=True).over(so_far))
    entered = tables.stored(entered.select("file", "start", "state", "begun"), "entered")
    n = entered.count()
    if n <= tables.FEW:
        real = lines.join(F.broadcast(entered), ["file", "start"])
    else:
        placed = lines.withColumn("_at", F.monotonically_increasing_id())
        real = placed.join(entered, ["file", "start"]).repartition("file", "start").sortWithinPartitions("file", "start", "_at")
    cut = tables.stored(real.select("file", "start", "line", "state", "begun").mapInArrow(_cut, "file string, start long, idx long, cells array<string>, begun long, text string"), "cut")
    counts = cut.filter("idx IS NOT NULL").groupBy("file", "start").agg(F.count("*").alias("idx"))
    crossing = cut.filter("text IS NOT NULL").groupBy("file", F.col("begun").alias("start")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("start").alias("s"), "text"))), lambda x: x["text"]), "\n").alias("text"))
    crossing = crossing.join(counts, ["file", "start"], "left").select("file", "start", F.coalesce("idx", F.lit(0)).alias("idx"), "text").mapInArrow(_whole, "file string, start long, idx long, cells array<string>")
    rows = tables.stored(cut.filter("idx IS NOT NULL").select("file", "start", "idx", "cells").unionByName(crossing), "rows")
    bases = tables.stored(rows.groupBy("file", "start").agg(F.count("*").alias("n")).select("file", "start", F.coalesce(F.sum("n").over(so_far), F.lit(0)).alias("base")), "bases")
    return rows.join(few(bases), ["file", "start"]).select("file", (F.col("base") + F.col("idx") - 1).alias("row_seq"), "cells")
