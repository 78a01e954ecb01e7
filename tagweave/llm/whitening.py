"""Whitening of embeddings, with a covariance that is exact until the last step.

1. Entries become integers x = floor(scale * c) + shift.  Rows whose vector is null, or holds null or an entry that
   isn't finite, are dropped, and so are vectors of another length than most (ties: the longer) and empty ones.  Entries
   beyond 2**62 are held there.
2. Fit list: each distinct x vector once, by an aggregation that starts where rows lie, so that copies cost nothing.
3. Digit-slice GEMM: x is split into limbs of 16 bits, the topmost signed.  Products of limbs are under 2**32, so that
   float64 sums of 8,192 rows are exact in one BLAS product; those are added as 64-bit integers by task.  Executors
   add the tasks' rows of the product, each split in two halves so that no sum overflows; a task holds as many sums as
   keys fall to it, not as many as there are tasks.
4. The driver gets dimensions x dimensions sums, recombines limbs as big integers, and makes n * G - S S', exact.  Only
   its division by n * n is rounded.
5. Eigenvectors: LAPACK's, then rotations (Jacobi) in extended precision until each pair is orthogonal relative to
   its own two eigenvalues, so small ones are as right as large ones.  Eigenvalues under 1e-17 of the largest count as
   zero: such components don't exist (fewer distinct vectors than dimensions, constant or equal dimensions).
6. Rows are projected after n * x - S has been taken as integers.

The covariance of whitened vectors is measured on the fit list: means and centred products by task, merged by sums.
Ids of any kind, null or repeated, keep a row each.  Empty table: no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as c

LIMB, ROWS = 16, 8192
_HALF = (1 << 32) - 1
_MOST = (1 << 63) - 1
_SAFE = 1 << 62
#: rows after which a task hands on its sums, far below where 64 bits overflow
_FLUSH = 1 << 28
TINY = 1e-17


@dataclass
class Whitening:
    n: int
    sums: list[int]  # by dimension
    axes: np.ndarray  # dimensions x components, unit eigenvectors
    values: np.ndarray  # eigenvalues, falling
    explained: np.ndarray  # eigenvalues over the trace
    identity_error: float = field(default=float("nan"))


def integers(df: DataFrame, vec_col: str, *others: str, scale: float = 64, shift: int = 1000000) -> DataFrame:
    """The other columns and x, of the rows that remain."""
    v = F.col(vec_col)
    whole = df.filter(v.isNotNull() & ~F.exists(v, lambda e: e.isNull() | F.isnan(e.cast("double")) | (F.abs(e.cast("double")) == float("inf"))))
    bound = float(_SAFE)
    return whole.select(*others, F.transform(v, lambda e: F.floor(F.greatest(F.lit(-bound), F.least(F.lit(bound), e.cast("double") * scale))).cast("long") + shift).alias("x"))


def matrix(column: pa.Array) -> np.ndarray:
    """rows x dimensions of a list column whose lists are equally long."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def limbs(x: np.ndarray) -> list[np.ndarray]:
    """float64 limbs of int64 x, as many as its largest entry needs: x = sum of limb k << (LIMB * k)."""
    most = max(int(x.max(initial=0)), -int(x.min(initial=0)) - 1)
    k = most.bit_length() // LIMB + 1  # the topmost has a sign
    low = [((x >> (LIMB * p)) & ((1 << LIMB) - 1)).astype(np.float64) for p in range(k - 1)]
    return [*low, (x >> (LIMB * (k - 1))).astype(np.float64)]


def products(x: np.ndarray) -> dict[int, np.ndarray]:
    """{s: sums}: of [1, x]' [1, x], the int64 sums that count 1 << (LIMB * s); ROWS rows at most."""
    parts = [np.concatenate([np.full((len(x), 1), float(p == 0)), limb], axis=1) for p, limb in enumerate(limbs(x))]
    wide = parts[0].shape[1]
    every = np.concatenate(parts, axis=1)
    gram = every.T @ every
    out: dict[int, np.ndarray] = {}
    for p in range(len(parts)):
        for q in range(len(parts)):
            block = gram[p * wide : (p + 1) * wide, q * wide : (q + 1) * wide].astype(np.int64)
            out[p + q] = out[p + q] + block if p + q in out else block
    return out


_PART = pa.schema([("i", pa.int32()), ("s", pa.int32()), ("hi", pa.list_(pa.int64())), ("lo", pa.list_(pa.int64()))])


def _rows_of(sums: dict) -> pa.RecordBatch:
    """{(i, s): (hi, lo)} as rows."""
    return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(([k[0] for k in sums], [k[1] for k in sums], [h.tolist() for h, _ in sums.values()], [x.tolist() for _, x in sums.values()]), _PART)], schema=_PART)


def _multiply(batches):
    """Sums of each row of the product, from the diagonal on."""
    total: dict[int, np.ndarray] = {}
    seen = 0

    def rows():
        for s, g in total.items():
            for i in range(len(g)):
                yield (i, s), (g[i, i:] >> 32, g[i, i:] & _HALF)

    for b in batches:
        x = matrix(b.column(0))
        for lo in range(0, len(x), ROWS):
            for s, g in products(x[lo : lo + ROWS]).items():
                total[s] = total[s] + g if s in total else g
        seen += len(x)
        if seen >= _FLUSH:
            yield _rows_of(dict(rows()))
            total, seen = {}, 0
    if total:
        yield _rows_of(dict(rows()))


def _merge(batches):
    total: dict[tuple[int, int], list[np.ndarray]] = {}
    for b in batches:
        for i, s, hi, lo in zip(*(b.column(k).to_pylist() for k in range(4))):
            hi, lo = np.array(hi, np.int64), np.array(lo, np.int64)
            if (i, s) in total:
                hi, lo = hi + total[i, s][0], lo + total[i, s][1]
            total[i, s] = hi + (lo >> 32), lo & _HALF
    if total:
        yield _rows_of(total)


_KIND = "i int, s int, hi array<long>, lo array<long>"


def moments(vectors: DataFrame) -> tuple[int, list[int], list[list[int]]]:
    """n, the sums S and the products G of x, exact; vectors (x), all of one length."""
    parts = vectors.mapInArrow(c.tidy(_multiply), _KIND).repartition("i", "s").mapInArrow(c.tidy(_merge), _KIND)
    found = parts.collect()  # as many values as the matrix has, for each of a few shifts
    d = max((len(r["hi"]) for r in found), default=1)
    g = [[0] * d for _ in range(d)]
    for r in found:
        for j, (hi, lo) in enumerate(zip(r["hi"], r["lo"])):
            g[r["i"]][r["i"] + j] += ((hi << 32) + lo) << (LIMB * r["s"])
    n, sums = g[0][0], g[0][1:]
    return n, sums, [[g[min(i, j)][max(i, j)] for j in range(1, d)] for i in range(1, d)]


def eigen(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors of a covariance, each exact to double precision; those of zero aren't returned."""
    v = v.astype(np.longdouble)
    d = len(v)
    if not d or not v.any():
        return np.zeros(0), np.zeros((d, 0))
    q = np.linalg.eigh(v.astype(np.float64))[1].astype(np.longdouble)
    for _ in range(2):  # orthogonal to extended precision
        q = q @ (np.longdouble(1.5) * np.eye(d) - np.longdouble(0.5) * (q.T @ q))
    b = q.T @ v @ q
    floor = np.longdouble(TINY) * np.abs(np.diag(b)).max()
    for _ in range(12):
        size = np.sqrt(np.maximum(np.abs(np.diag(b)), floor))
        todo = np.argwhere(np.triu(np.abs(b), 1) > TINY * np.outer(size, size))
        if not len(todo):
            break
        for i, j in todo:
            if b[i, j] == 0:
                continue
            tau = (b[j, j] - b[i, i]) / (2 * b[i, j])
            t = (1 if tau >= 0 else -1) / (abs(tau) + np.sqrt(1 + tau * tau))
            cos = 1 / np.sqrt(1 + t * t)
            turn = np.array([[cos, t * cos], [-t * cos, cos]], np.longdouble)
            b[:, [i, j]] = b[:, [i, j]] @ turn
            b[[i, j]] = turn.T @ b[[i, j]]
            q[:, [i, j]] = q[:, [i, j]] @ turn
    e = np.diag(b)
    order = [k for k in np.argsort(-e, kind="stable") if e[k] > floor]
    axes = q[:, order] / np.sqrt((q[:, order] ** 2).sum(axis=0))
    return e[order].astype(np.float64), axes.astype(np.float64)


def _length(rows: DataFrame) -> int:
    """The length that most vectors have, of ties the longest."""
    found = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return found["d"] if found else 0


def fit(rows: DataFrame, components: int = 16) -> Whitening:
    """rows (x) of integers."""
    d = _length(rows)
    vectors = c.stored(rows.filter(F.size("x") == d).select("x").distinct(), "vectors") if d else rows.limit(0).select("x")
    n, sums, g = moments(vectors)
    if not n:
        return Whitening(0, [0] * d, np.zeros((d, 0)), np.zeros(0), np.zeros(0))
    square = n * n
    v = np.array([[_quotient(n * g[i][j] - sums[i] * sums[j], square) for j in range(d)] for i in range(d)], np.longdouble)
    values, axes = eigen(v)
    trace = sum(n * g[i][i] - sums[i] ** 2 for i in range(d)) / square
    values, axes = values[:components], axes[:, :components]
    axes *= np.where(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])] < 0, -1.0, 1.0)  # reruns have the same signs
    out = Whitening(n, sums, axes, values, values / trace if trace else values)
    out.identity_error = _identity_error(vectors, out)
    return out


def _quotient(a: int, b: int) -> np.longdouble:
    """a / b, in extended precision."""
    whole, rest = divmod(a, b)
    return np.longdouble(whole) + np.longdouble(rest / b)


def _centred(x: np.ndarray, w: Whitening) -> np.ndarray:
    """n * x - S; Python's integers where 64 bits don't do."""
    big = max(int(x.max(initial=0)), -int(x.min(initial=0))) * w.n + max(map(abs, w.sums)) >= _SAFE
    return (x.astype(object) if big else x) * w.n - np.array(w.sums, object if big else np.int64)


def _project(centred: np.ndarray, w: Whitening) -> np.ndarray:
    return (centred / w.n).astype(np.float64) @ w.axes / np.sqrt(w.values)


def _deviation(centred: np.ndarray) -> list[int | None]:
    """The exact sum of squares of each row; null beyond 64 bits."""
    near = (centred.astype(np.float64) ** 2).sum(axis=1)
    if centred.dtype != object and near.max(initial=0) < _SAFE:
        return (centred * centred).sum(axis=1).tolist()
    exact = [sum(int(e) ** 2 for e in row) if f < 2 * _MOST else _MOST + 1 for row, f in zip(centred, near)]
    return [e if e <= _MOST else None for e in exact]


def _identity_error(vectors: DataFrame, w: Whitening) -> float:
    """The largest absolute entry of the whitened fit list's covariance minus the identity."""
    k = len(w.values)
    if not k:
        return 0.0

    def run(batches):
        n, mean, around = 0, np.zeros(k), np.zeros((k, k))
        for b in batches:
            z = _project(_centred(matrix(b.column(0)), w), w) if b.num_rows else np.zeros((0, k))
            if not len(z):
                continue
            m = z.mean(axis=0)
            off, both = m - mean, n + len(z)
            around += (z - m).T @ (z - m) + np.outer(off, off) * n * len(z) / both
            mean, n = mean + off * len(z) / both, both
        if n:
            values = np.concatenate([around.ravel(), n * mean, n * np.outer(mean, mean).ravel()])
            yield pa.RecordBatch.from_pydict({"k": pa.array(np.arange(len(values)), pa.int32()), "v": pa.array(values)})

    rows = vectors.mapInArrow(c.tidy(run), "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()  # some hundreds of sums
    sums = np.zeros(2 * k * k + k)
    for r in rows:
        sums[r["k"]] = r["v"]
    mean = sums[k * k : k * k + k] / w.n
    covariance = (sums[: k * k] + sums[k * k + k :]).reshape(k, k) / w.n - np.outer(mean, mean)
    return float(np.abs(covariance - np.eye(k)).max())


def whiten(rows: DataFrame, w: Whitening) -> DataFrame:
    """rows (vec_id, x) -> (vec_id, deviation, whitened): no shuffle; whitened has as many entries as components exist."""
    kind = dict(rows.dtypes)["vec_id"]
    out = rows.filter(F.size("x") == len(w.sums)).select("vec_id", "x")
    if not w.n:
        return out.limit(0).select("vec_id", F.lit(0).cast("long").alias("deviation"), F.lit(None).cast("array<double>").alias("whitened"))

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            centred = _centred(matrix(b.column(1)), w)
            z = _project(centred, w)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_deviation(centred), pa.int64()), c.list_column(z.ravel(), np.arange(len(z) + 1) * z.shape[1], pa.float64())], names=["vec_id", "deviation", "whitened"])

    return out.mapInArrow(c.tidy(run), f"vec_id {kind}, deviation long, whitened array<double>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = integers(c.table(spark, sf_dir, "embeddings"), "embedding", "vec_id")
    w = fit(rows)
    one = whiten(rows, w).select("vec_id", "deviation", F.posexplode("whitened").alias("k", "whitened"))
    explained = F.element_at(F.array(*[F.lit(float(e)) for e in w.explained]), F.col("k") + 1) if len(w.explained) else F.lit(0.0)
    return one.select("vec_id", (F.col("k") + 1).alias("component"), F.lit(w.n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(w.identity_error).alias("identity_error"))
