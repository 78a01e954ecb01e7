"""Plumbing that the training-data operators share.

Intermediate tables go to the folder in ``spark.checkpoint.dir``, which every executor
sees, so a lost executor never takes results with it; large ones go as soon as they have been
used (:func:`dropped`), so that the disk holds little beside one step's shuffle.  Joins on keys that one value may
dominate go through :func:`heavy_join`.
"""

from __future__ import annotations

import contextlib
import ctypes
import os
import re
import tempfile
import uuid
import weakref
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: At most this many keys can each hold more than 1/HEAVY_KEYS of the rows: the proven
#: bound of what heavy_join broadcasts.
HEAVY_KEYS = 1000

_tables: list[str] = []
_path_of: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_own_dir: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this cluster; a folder of our own only on a local master where none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own_dir:
            _own_dir[app] = "file://" + tempfile.mkdtemp(prefix="tagweave-")
        found = _own_dir[app]
    return found.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Texts may be long: Arrow batches of 2 MB at most and Parquet batches of 1,024 rows from here on, where the session keeps Spark's defaults."""
    for key, usual, small in (("spark.sql.execution.arrow.maxBytesPerBatch", ("64MB", f"{64 << 20}b"), f"{2 << 20}b"), ("spark.sql.parquet.columnarReaderBatchSize", ("4096",), "1024")):
        if spark.conf.get(key) in usual:
            spark.conf.set(key, small)


#: called at the end of a task, to let go what the worker can do without
at_rest: list = []


def rested() -> None:
    """A Python worker that waits for its next task gives back what it holds."""
    _cache.clear()
    for let_go in at_rest:
        let_go()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/tagweave/{name}-{uuid.uuid4().hex}"
    _tables.append(path)
    return path


@contextlib.contextmanager
def _shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Writes within delete their shuffle files at their end; else these stay until the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, was)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes the table to the shared folder and reads it back: lineage ends here, and the write's shuffle files go."""
    path = new_path(df.sparkSession, name)
    with _shuffles_go(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _path_of[out] = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def dropped(*frames: DataFrame) -> None:
    """Deletes tables of :func:`stored` whose rows have all been used: no frame that is still to be computed may read them.  Other frames are left alone."""
    for df in frames:
        path = _path_of.pop(df, None)
        if path in _tables:
            _tables.remove(path)
            _delete(df.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Deletes the intermediate tables that this process has written; frames that read them are void."""
    while _tables:
        _delete(spark, _tables.pop())


def tidy(run):
    """run for mapInArrow over texts: in small batches, and its worker gives back memory at the end of each task."""
    small_batches(SparkSession.active())

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            rested()

    return whole


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it until no column of the table is called so."""
    taken, out = {x.lower() for x in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def heavy_join(left: DataFrame, right: DataFrame, on: list[str], weight: str, total: int, how: str = "inner", few: int = 0) -> DataFrame:
    """Joins left to right, whose keys are unique and whose ``weight`` is the number of left rows of the key.

    Keys with more than total/HEAVY_KEYS rows, HEAVY_KEYS at most, are joined by
    broadcast, so that their rows stay where they are; all other keys by shuffle.
    ``left`` is read twice and should be a stored table.  Key columns aren't null.  Where total is ``few`` at most, even
    all rows fit a task, and the join is a plain one.
    """
    if total <= few:
        return left.join(right, on, how)
    heavy = F.col(weight) * F.lit(HEAVY_KEYS) > F.lit(int(total))
    few, many = F.broadcast(right.filter(heavy)), right.filter(~heavy)
    return left.join(few, on, "inner").unionByName(left.join(F.broadcast(right.filter(heavy).select(*on)), on, "left_anti").join(many, on, how))


def running(df: DataFrame, order: str, value: str, out: str, block: int = 4096) -> DataFrame:
    """Adds the sum of ``value`` over all rows of smaller ``order`` (distinct, from 0); two levels, so that a task holds 1/block of the rows."""
    blocked = df.withColumn("_block", (F.col(order) / block).cast("long"))
    tops = blocked.groupBy("_block").agg(F.sum(value).alias("_n"))
    tops = tops.select("_block", F.coalesce(F.sum("_n").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inner = F.coalesce(F.sum(value).over(Window.partitionBy("_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return blocked.withColumn("_inner", inner).join(tops, "_block").withColumn(out, F.col("_inner") + F.col("_before")).drop("_block", "_inner", "_before")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id):
    """The rows that training never sees: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


# ---------------------------------------------------------------- bytes and words in numpy

#: Bytes of text that one vectorised step takes at most, unless one document is longer.
CHUNK = 1 << 18
_MULT = np.uint64(0x9E3779B97F4A7C15)
_WORD_MULT = np.uint64(0xC2B2AE3D27D4EB4F)


def _inverse(x: np.uint64) -> np.uint64:
    return np.uint64(pow(int(x), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    if n > 1:
        out[1:] = base
        np.multiply.accumulate(out, out=out)
    return out


_cache: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_pair(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of base and of its inverse, n of each at least; the longest so far are kept, unless a giant text asked for them."""
    found = _cache.get(int(base))
    if found is None or len(found[0]) < n:
        size = max(2 * CHUNK, n)
        found = _powers(base, size), _powers(_inverse(base), size)
        if size <= 8 * CHUNK:
            _cache[int(base)] = found
    return found


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * _MULT)

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: bytes of words that are runs of anything but ASCII white space
NON_SPACE = ~SPACES
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
#: bytes of words that are runs of digits, ASCII letters and everything beyond ASCII (text already in lower case)
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (one more than rows) and bytes of a text or binary column; null is empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    wide = pa.large_string() if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else pa.large_binary()
    column = column.cast(wide).fill_null("" if wide == pa.large_string() else b"")
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return offsets, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def chunks(offsets: np.ndarray, most: int = CHUNK):
    """Row ranges of about ``most`` bytes; a longer document is alone in its range."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = hi


def words(seg: np.ndarray, bounds: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words in seg; the index of each document's first word (and the total).  bounds: offsets of documents in seg."""
    if not len(seg):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
    inside = is_word[seg]
    before, after = np.empty_like(inside), np.empty_like(inside)
    before[0] = after[-1] = False
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[bounds[bounds < len(seg)]] = False
    last = bounds - 1
    after[last[last >= 0]] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def word_hashes(seg: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, a megabyte of text at a time."""
    out, i, n = np.empty(len(starts), np.uint64), 0, len(starts)
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + CHUNK, "right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        power, inverse = _power_pair(_MULT, hi - lo + 1)
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(_BYTE[seg[lo:hi]] * power[: hi - lo], out=total[1:])
        out[i:j] = (total[ends[i:j] - lo] - total[starts[i:j] - lo]) * inverse[starts[i:j] - lo] + (ends[i:j] - starts[i:j]).astype(np.uint64)
        i = j
    return mixed(out)


def gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive word hashes; the caller leaves out those that cross a document's end."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, np.uint64)
    power, inverse = _power_pair(_WORD_MULT, n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * power[:n], out=total[1:])
    return mixed((total[k:] - total[:-k]) * inverse[: n - k + 1])


def list_column(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values, kind))


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def quiet_threads() -> None:
    """Native libraries in a Python worker keep to the one core that its task has."""
    os.environ["RAYON_NUM_THREADS"], os.environ["TOKENIZERS_PARALLELISM"] = "1", "false"
