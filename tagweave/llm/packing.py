"""Mixture-controlled packing: deficit round-robin over source queues.

1. Each task encodes the texts it has, where they lie, into one file of ids in the shared
   folder, and reports the tokens of each source in it (a few rows per file).
2. Every source is a queue: its documents' tokens in the order of files, so prefix sums of
   those reports give each document its place in its queue.  Target shares are parameters;
   by default a source's share of all tokens, so that all queues end together.  A source
   without a given share is served once the others have ended.
3. The target of a queue after t tokens is a function of t (``Mixture``).  Packing
   partitions of ``part_tokens`` tokens get the tokens of each queue between the targets at
   their ends, cut to whole tokens: what a partition's queues miss of their targets at its
   start is below one token each, and is their deficit there.
4. In a partition each window (a sequence of ``length`` tokens) raises each queue's deficit
   by its target; queues are visited in turn and serve the whole tokens of a deficit of
   ``quantum`` or more; what room is left goes, a token each, to the queues just served with
   the largest deficits, else to the largest deficit, a quantum at once.  Deficits carry
   over from window to window.  So a full window departs from each target by ``quantum``
   + 1 tokens at most, by 2 where every target is over ``quantum`` + 1 (but in the last
   windows of a partition, which end all its queues, and at the end of an explicit mixture).

The largest ``queues`` sources by tokens have queues of their own; where there are more,
all others share one more queue.  Every sequence is full but a partition's last one; sequence numbers
are gapless prefix sums.  Ids are integers.  Null text: only the end id.  Null source: a queue of its
own.  Repeated rows are packed each.  Empty table: no rows.
"""

from __future__ import annotations

import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as c
from .tokens import Encoder, default_tokenizer, file_system, texts_of

#: the key of the null source, and of the queue that sources beyond the limit share
NULL_SOURCE, REST = -(1 << 63), -(1 << 63) + 1
#: tokens of a shuffle task, about
TASK_TOKENS = 32 << 20
_SLICE = "part long, queue int, pos long, doc_id long, first long, doc_tokens long, ids binary, base long"
_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, queue int, part long"


def source_key(name: str | None) -> int:
    """xxhash64 of the name, as Spark's function gives it."""
    from xxhash import xxh64_intdigest

    if name is None:
        return NULL_SOURCE
    h = xxh64_intdigest(name.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


@dataclass
class Mixture:
    """How many tokens of each queue the first t tokens of the whole should hold: linear between ``times``."""

    keys: np.ndarray  # source key of each queue, in ascending order
    times: np.ndarray
    served: np.ndarray  # times x queues
    part_tokens: int

    @staticmethod
    def of(totals: dict[int, int], shares: dict[int, float] | None, part_tokens: int) -> "Mixture":
        keys = np.array(sorted(totals), np.int64)
        left = np.array([totals[k] for k in keys.tolist()], float)
        share = left.copy() if shares is None else np.array([shares.get(k, 0.0) for k in keys.tolist()])
        done, times, served = np.zeros(len(keys)), [0.0], [np.zeros(len(keys))]
        while left.any():
            weight = np.where(left > 0, share, 0.0)
            weight = weight if weight.any() else left.copy()
            weight /= weight.sum()
            on = weight > 0
            span = float((left[on] / weight[on]).min())  # until the first queue ends
            more = np.where(on & (left / np.where(on, weight, 1) <= span * (1 + 1e-12)), left, np.minimum(left, weight * span))
            done, left = done + more, left - more
            left[left < 0.5] = 0
            times.append(times[-1] + span)
            served.append(done.copy())
        served[-1] = np.array([totals[k] for k in keys.tolist()], float)
        times[-1] = float(served[-1].sum())
        return Mixture(keys, np.array(times), np.array(served), part_tokens)

    @property
    def total(self) -> int:
        return int(self.times[-1])

    @property
    def parts(self) -> int:
        return max(1, -(-self.total // self.part_tokens)) if self.total else 0

    def target(self, t, queue) -> np.ndarray:
        """Target of each queue after t tokens (arrays that broadcast)."""
        t = np.minimum(np.asarray(t, float), self.times[-1])
        i = np.clip(np.searchsorted(self.times, t, "right") - 1, 0, len(self.times) - 2)
        a, b = self.served[i, queue], self.served[i + 1, queue]
        return np.minimum(a + (b - a) * ((t - self.times[i]) / np.maximum(self.times[i + 1] - self.times[i], 1e-300)), b)

    def cut(self, part, queue) -> np.ndarray:
        """Tokens of the queue in all partitions before ``part``."""
        part = np.asarray(part)
        return np.where(part >= self.parts, self.served[-1, queue], np.floor(self.target(part * float(self.part_tokens), queue))).astype(np.int64)

    def part_of(self, queue: np.ndarray, pos: np.ndarray) -> np.ndarray:
        """The partition that holds each place of a queue."""
        lo, hi = np.zeros(len(pos), np.int64), np.full(len(pos), max(1, self.parts), np.int64)
        while (hi - lo > 1).any():
            mid = (lo + hi) // 2
            below = self.cut(mid, queue) <= pos
            lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
        return lo


def schedule(want: np.ndarray, backlog: np.ndarray, deficit: np.ndarray, length: int, quantum: int) -> np.ndarray:
    """Tokens that each queue serves in each window: windows x queues.

    want: each window's targets; backlog: tokens of each queue; deficit: of each queue at the start.
    """
    left, owed = backlog.astype(float), deficit.astype(float).copy()  # whole numbers, exact as such
    out = np.zeros((-(-int(left.sum()) // length), len(left)), np.int64)
    for w in range(len(out)):
        owed += want[w]
        take = np.floor(owed + 1e-9)
        take[owed < quantum] = 0
        np.minimum(take, left, out=take)
        room = length - int(take.sum())
        if room < 0:  # deficits of more than a window: in turn, until it is full
            take = np.diff(np.minimum(np.cumsum(take), length), prepend=0)
            room = 0
        if room:
            over = take - owed
            over[(take <= 0) | (left <= take)] = np.inf
            more = over.argsort(kind="stable")[:room]
            more = more[over[more] < 0]
            take[more] += 1
            room -= len(more)
            while room and (left > take).any():
                q = int(np.argmax(np.where(left > take, owed - take, -np.inf)))
                n = min(room, int(left[q] - take[q]), quantum)
                take[q] += n
                room -= n
        out[w] = take
        owed -= take
        left -= take
    return out


def encoded(docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """Writes one file of ids per task and returns (task, file, source, n): the tokens of each source in it."""
    source = F.col(source_col).cast("string")
    data = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.when(source.isNull(), F.lit(NULL_SOURCE)).otherwise(F.xxhash64(source)).alias("source"), F.col(text_col).cast("binary").alias("text"))
    kind = pa.schema([("doc_id", pa.int64()), ("source", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        coder, task, own = Encoder.of(tokenizer, plain=True), TaskContext.get().partitionId(), {}
        end = np.array([end_id], coder.dtype).tobytes()
        fs, at = file_system(f"{folder}/ids-{task:06d}-{uuid.uuid4().hex}")
        stream = writer = None
        try:
            for b in batches:
                if not writer:
                    fs.create_dir(at.rpartition("/")[0], recursive=True)
                    stream = fs.open_output_stream(at)
                    writer = pa.ipc.new_stream(stream, kind)
                for lo in range(0, b.num_rows, 256):
                    s = b.slice(lo, 256)
                    ids = [x + end for x in coder.encode(texts_of(s.column(2)))]
                    writer.write_batch(pa.RecordBatch.from_arrays([s.column(0), s.column(1), pa.array(ids, pa.binary())], schema=kind))
                    for k, x in zip(s.column(1).to_pylist(), ids):
                        own[k] = own.get(k, 0) + len(x) // coder.dtype.itemsize
        finally:
            if writer:
                writer.close()
                stream.close()
        if own:
            n = len(own)
            yield pa.RecordBatch.from_pydict({"task": pa.array([task] * n, pa.int32()), "file": pa.array([at.rpartition("/")[2]] * n), "source": pa.array(list(own), pa.int64()), "n": pa.array(list(own.values()), pa.int64())})

    return c.stored(data.mapInArrow(c.tidy(run), "task int, file string, source long, n long"), "runs")


def slices(runs: DataFrame, mixture: Mixture, folder: str, width: int) -> DataFrame:
    """Rows _SLICE of each file: runs of ids of one document that belong to one partition."""
    spark = runs.sparkSession
    known = spark.createDataFrame([(k, q) for q, k in enumerate(mixture.keys.tolist()) if k != REST], "source long, queue int")
    rest = int(np.searchsorted(mixture.keys, REST))
    # one row per file and queue (at most `queues` of them), then within the queue that several sources share
    placed = runs.join(F.broadcast(known), "source", "left").withColumn("queue", F.coalesce("queue", F.lit(rest)))
    earlier = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    inner = placed.withColumn("inner", F.coalesce(F.sum("n").over(earlier("task", "queue").orderBy("source")), F.lit(0)))
    outer = placed.groupBy("task", "queue").agg(F.sum("n").alias("n")).withColumn("outer", F.coalesce(F.sum("n").over(earlier("queue").orderBy("task")), F.lit(0))).drop("n")
    bases = inner.join(outer, ["task", "queue"]).groupBy("file").agg(F.collect_list(F.struct("source", "queue", (F.col("inner") + F.col("outer")).alias("base"))).alias("at"))
    n_files = runs.select("file").distinct().count()
    shared = spark.sparkContext.broadcast(mixture)

    def run(batches):
        mix = shared.value
        kind = np.dtype(f"<u{width}")
        for b in batches:
            for row in b.to_pylist():
                place = {x["source"]: (x["queue"], x["base"]) for x in row["at"]}
                queue_of, next_of = {k: q for k, (q, _) in place.items()}, {k: n for k, (_, n) in place.items()}
                fs, at = file_system(f"{folder}/{row['file']}")
                with fs.open_input_stream(at) as stream, pa.ipc.open_stream(stream) as reader:
                    for s in reader:
                        ids = s.column(2)
                        sizes = np.diff(np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1]) // width
                        sources, pos = s.column(1).to_pylist(), np.zeros(len(ids), np.int64)
                        for i, (k, n) in enumerate(zip(sources, sizes.tolist())):
                            pos[i] = next_of[k]
                            next_of[k] += n
                        queue = np.array([queue_of[k] for k in sources], np.int64)
                        first, last = mix.part_of(queue, pos), mix.part_of(queue, pos + sizes - 1)
                        doc = np.repeat(np.arange(len(ids)), last - first + 1)
                        part = first[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(last - first + 1) - (last - first + 1), last - first + 1)
                        lo = np.maximum(pos[doc], mix.cut(part, queue[doc]))
                        hi = np.minimum(pos[doc] + sizes[doc], mix.cut(part + 1, queue[doc]))
                        some = hi > lo  # a partition may hold no token of the queue
                        doc, part, lo, hi = doc[some], part[some], lo[some], hi[some]
                        raw = ids.to_pylist()
                        cut = [raw[d] if n == m else raw[d][a * kind.itemsize : (a + n) * kind.itemsize] for d, a, n, m in zip(doc.tolist(), (lo - pos[doc]).tolist(), (hi - lo).tolist(), sizes[doc].tolist())]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(part, pa.int64()), pa.array(queue[doc], pa.int32()), pa.array(lo, pa.int64()), s.column(0).take(pa.array(doc)), pa.array(lo - pos[doc], pa.int64()), pa.array(sizes[doc], pa.int64()), pa.array(cut, pa.binary()), pa.nulls(len(doc), pa.int64())],
                            names=["part", "queue", "pos", "doc_id", "first", "doc_tokens", "ids", "base"])

    return bases.repartitionByRange(max(1, min(n_files, 100_000)), "file").mapInArrow(c.tidy(run), _SLICE)


def sequence_bases(spark: SparkSession, mixture: Mixture, length: int) -> DataFrame:
    """Rows _SLICE, one per partition: the number of sequences before it."""
    shared = spark.sparkContext.broadcast(mixture)

    def run(batches):
        mix = shared.value
        every = np.arange(len(mix.keys))
        for b in batches:
            parts = b.column(0).to_numpy()
            n = np.zeros(len(parts), np.int64)
            for i in range(0, len(parts), 256):
                p = parts[i : i + 256, None]
                n[i : i + 256] = (mix.cut(p + 1, every) - mix.cut(p, every)).sum(axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(-(-n // length), pa.int64())], names=["part", "n"])

    counts = spark.range(0, mixture.parts).select(F.col("id").alias("part")).mapInArrow(c.tidy(run), "part long, n long")
    kinds = dict(x.rsplit(" ", 1) for x in _SLICE.split(", "))
    return c.running(counts, "part", "n", "base").select(*[F.col(k) if k in ("part", "base") else F.lit(None).cast(t).alias(k) for k, t in kinds.items()])


def pack(docs: DataFrame, tokenizer: str | None = None, end_id: int = 0, length: int = 1024, quantum: int = 16, part_tokens: int = 1 << 20, queues: int = 4096, shares: dict[str | None, float] | None = None,
         ids: bool = True, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, queue, part and, if asked for, ids): one row per piece.

    ids: the piece's ids as little-endian unsigned 32-bit integers.  A partition's rows are together and in order.
    """
    spark, tokenizer = docs.sparkSession, tokenizer or default_tokenizer()
    if part_tokens % length:
        raise ValueError("a packing partition holds whole windows")
    folder = c.new_path(spark, "packing")
    runs = encoded(docs, folder, tokenizer, end_id, id_col, text_col, source_col)
    width = Encoder.of(tokenizer, plain=True).dtype.itemsize
    by_source = runs.groupBy("source").agg(F.sum("n").alias("n"))
    # `queues` rows at most come to the driver
    totals = {r["source"]: r["n"] for r in by_source.orderBy(F.desc("n"), "source").limit(queues).collect()}
    whole = runs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    given = None if shares is None else {source_key(k): float(v) for k, v in shares.items()}
    if whole > sum(totals.values()):
        totals[REST] = whole - sum(totals.values())
    mixture = Mixture.of(totals, given, part_tokens)
    if not whole:
        return spark.createDataFrame([], _PIECE + ", ids binary" * ids)
    n_tasks = max(min(mixture.parts, int(spark.conf.get("spark.sql.shuffle.partitions"))), -(-whole // TASK_TOKENS))
    dealt = slices(runs, mixture, folder, width).unionByName(sequence_bases(spark, mixture, length)).repartition(n_tasks, "part").sortWithinPartitions("part", "queue", "pos")
    shared = spark.sparkContext.broadcast(mixture)

    def run(batches):
        mix = shared.value
        part, held, base = None, [], 0
        for b in batches:
            # rows of one partition are consecutive, its base first (a null queue sorts before all)
            parts = b.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(parts)]
            for lo, hi in zip(edges, edges[1:]):
                if lo == hi:
                    continue
                if parts[lo] != part:
                    if held:
                        yield from pieces_of(part, base, held, mix, length, quantum, width, ids)
                    part, held = int(parts[lo]), []
                s = b.slice(lo, hi - lo)
                if s.column(7)[0].is_valid:
                    base, s = s.column(7)[0].as_py(), s.slice(1)
                if s.num_rows:
                    held.append(s)
        if held:
            yield from pieces_of(part, base, held, mix, length, quantum, width, ids)

    return dealt.mapInArrow(c.tidy(run), _PIECE + ", ids binary" * ids)


def pieces_of(part: int, base: int, held: list[pa.RecordBatch], mix: Mixture, length: int, quantum: int, width: int, with_ids: bool):
    """The pieces of one partition, in the order of queues and places; held: its slices, sorted."""
    every = np.arange(len(mix.keys))
    start, stop = mix.cut(part, every), mix.cut(part + 1, every)
    used = np.flatnonzero(stop > start)
    backlog = (stop - start)[used]
    n_windows = -(-int(backlog.sum()) // length)
    begin = part * float(mix.part_tokens)
    ends = mix.target(begin + length * np.arange(n_windows + 1)[:, None], used)
    take = schedule(np.diff(ends, axis=0), backlog, ends[0] - start[used], length, quantum)
    until = np.concatenate([np.zeros((1, len(used)), np.int64), np.cumsum(take, axis=0)])  # of each queue, by window
    ahead = np.cumsum(take, axis=1) - take  # of earlier queues, in the window
    column = lambda i: np.concatenate([np.asarray(s.column(i)) for s in held])
    queue, pos, first, doc_tokens = (column(i) for i in (1, 2, 4, 5))
    docs = pa.concat_arrays([s.column(3) for s in held])
    for k, q in enumerate(used.tolist()):
        lo, hi = np.searchsorted(queue, [q, q + 1])
        at = pos[lo:hi] - start[q]  # each slice's place in the partition's own queue
        ids = np.frombuffer(b"".join(_binaries(held, int(lo), int(hi))), f"<u{width}").astype("<u4")
        cuts = np.unique(np.concatenate([at, until[:, k]]))
        a, b = cuts[:-1], cuts[1:]
        doc, window = np.searchsorted(at, a, "right") - 1, np.searchsorted(until[:, k], a, "right") - 1
        raw = memoryview(ids).cast("B")
        sums = np.fromiter((zlib.crc32(raw[4 * i : 4 * j]) for i, j in zip(a.tolist(), b.tolist())), np.int64, len(a))
        n = len(a)
        out = [docs[lo:hi].take(pa.array(doc)), pa.array(first[lo:hi][doc] + a - at[doc]), pa.array(b - a), pa.array(sums), pa.array(doc_tokens[lo:hi][doc]), pa.array(base + window), pa.array(ahead[window, k] + a - until[window, k]),
               pa.array(np.full(n, q), pa.int32()), pa.array(np.full(n, part), pa.int64())]
        if with_ids:
            out.append(pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((4 * cuts).astype(np.int32)), pa.py_buffer(ids)]))
        yield pa.RecordBatch.from_arrays(out, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "queue", "part", *["ids"] * with_ids])


def _binaries(held: list[pa.RecordBatch], lo: int, hi: int):
    """The ids of rows lo to hi of the batches."""
    for s in held:
        if lo < s.num_rows and hi > 0:
            yield from s.column(6)[max(lo, 0) : min(hi, s.num_rows)].to_pylist()
        lo, hi = lo - s.num_rows, hi - s.num_rows


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(c.table(spark, sf_dir, "documents"), ids=False).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
