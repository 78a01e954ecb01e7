"""Quality classifier: a factorisation machine.

Features of a text, each hashed into ``buckets``: its words in lower case, weighted by
log(1 + count) and scaled to length one; and bins of structure statistics and metadata
of the text itself (length in bytes and words, mean word length, shares of symbols,
digits, capitals and marks, share of repeated words and lines, words per line), weighted
by ``structure``.  The score is the logistic of

    w0 + sum w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2]

which is linear in the number of features.  Labels, language, source and id are never
features.

Weights are trained by stochastic gradient descent in numpy on a bounded sample of
labelled rows: about ``per_class`` of each class, texts up to ``train_bytes``, drawn by a
hash of the id.  A tenth of them fits the final bias, so that scores reflect the classes'
true shares.

Null and empty texts get the score of their structure features; no labels: 0.5 for all.
Labels without quality and ids with contradicting labels aren't used.

Ids are integers, or text that Spark casts to them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as c

_STATS = 11
_BINS = 16


@dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 16
    factors: int = 6
    per_class: int = 1500
    train_bytes: int = 1 << 16
    epochs: int = 6
    rate: float = 0.1
    decay: float = 1e-5
    structure: float = 0.6
    seed: int = 5


@dataclass
class Model:
    bias: float
    linear: np.ndarray
    factors: np.ndarray


_CLASS = np.zeros((4, 256), bool)  # symbols, digits, capitals, marks
_CLASS[0, list(b"#*$%&|<>@^~_=+{}[]\\/")] = True
_CLASS[1, 0x30:0x3A] = True
_CLASS[2, 0x41:0x5B] = True
_CLASS[3, list(b"!?.,;:'\"()-")] = True


def features(offsets: np.ndarray, data: np.ndarray, s: Settings):
    """For ranges of documents: (lo, hi, bucket, document from lo, value), documents in order."""
    for lo, hi in c.chunks(offsets):
        base, n = offsets[lo], hi - lo
        seg, bounds = data[base : offsets[hi]], offsets[lo : hi + 1] - base
        size = np.diff(bounds)
        starts, ends, first = c.words(seg, bounds, c.NON_SPACE)
        n_words = np.diff(first)
        hashes = c.word_hashes(c.LOWER[seg], starts, ends)
        of = np.repeat(np.arange(n), n_words)
        key = of.astype(np.uint64) * np.uint64(s.buckets) + (hashes % np.uint64(s.buckets))
        key, count = np.unique(key, return_counts=True)
        doc, bucket = (key // np.uint64(s.buckets)).astype(np.int64), (key % np.uint64(s.buckets)).astype(np.int64)
        value = np.log1p(count)
        norm = np.sqrt(np.bincount(doc, value * value, minlength=n))
        value = value / np.maximum(norm, 1e-9)[doc]
        total = lambda hit: np.diff(np.concatenate([[0], np.cumsum(hit)])[bounds])
        one, many = np.maximum(size, 1), np.maximum(n_words, 1)
        lines = total(seg == 0x0A) + 1
        distinct = np.bincount(doc, minlength=n)
        stats = [np.log2(size + 1) / 24, np.log2(n_words + 1) / 20, np.bincount(of, (ends - starts), minlength=n) / many / 24, *(total(k[seg]) / one * 2 for k in _CLASS), 1 - distinct / many,
                 np.log2(n_words / lines + 1) / 12, np.bincount(doc, count * (count > 3), minlength=n) / many, np.bincount(doc, (count == 1), minlength=n) / many]
        bins = np.stack([np.clip((x * _BINS).astype(np.int64), 0, _BINS - 1) for x in stats], axis=1)
        at = (c.mixed((bins + np.arange(_STATS) * _BINS + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(s.buckets)).astype(np.int64)
        docs = np.concatenate([doc, np.repeat(np.arange(n), _STATS)])
        order = np.argsort(docs, kind="stable")
        yield lo, hi, np.concatenate([bucket, at.ravel()])[order], docs[order], np.concatenate([value, np.full(n * _STATS, s.structure)])[order]


def raw_scores(offsets: np.ndarray, data: np.ndarray, model: Model, s: Settings) -> np.ndarray:
    out = np.zeros(len(offsets) - 1)
    for lo, hi, bucket, doc, x in features(offsets, data, s):
        n = hi - lo
        score = model.bias + np.bincount(doc, model.linear[bucket] * x, minlength=n)
        for f in range(model.factors.shape[1]):
            vx = model.factors[bucket, f] * x
            score += 0.5 * (np.bincount(doc, vx, minlength=n) ** 2 - np.bincount(doc, vx * vx, minlength=n))
        out[lo:hi] = score
    return out


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def train(rows: list[tuple[bytes, int]], share: float, s: Settings = Settings()) -> Model | None:
    """rows (text, 0 or 1) in any order; share: that of label 1 among all labels."""
    if not rows:
        return None
    offsets = np.concatenate([[0], np.cumsum([len(t) for t, _ in rows])])
    data = np.frombuffer(b"".join(t for t, _ in rows), np.uint8)
    y = np.array([q for _, q in rows], float)
    rng = np.random.default_rng(s.seed)
    sparse = []
    for lo, hi, bucket, doc, x in features(offsets, data, s):
        cut = np.searchsorted(doc, np.arange(hi - lo + 1))
        sparse += [(bucket[a:b], x[a:b].astype(np.float32)) for a, b in zip(cut[:-1], cut[1:])]
    order = rng.permutation(len(rows))
    n_valid = len(rows) // 10
    valid, fit = order[:n_valid], order[n_valid:]
    model = Model(0.0, np.zeros(s.buckets, np.float32), rng.normal(0, 0.05, (s.buckets, s.factors)).astype(np.float32))
    step, steps = 0, max(1, s.epochs * len(fit))
    for _ in range(s.epochs):
        for i in rng.permutation(fit):
            ids, x = sparse[i]
            rate = s.rate * (1 - step / steps)
            step += 1
            v = model.factors[ids]
            both = x @ v
            z = model.bias + float(model.linear[ids] @ x) + 0.5 * float((both**2).sum() - ((v * x[:, None]) ** 2).sum())
            g = 1 / (1 + np.exp(-np.clip(z, -35, 35))) - y[i]
            model.bias -= rate * 0.1 * g
            model.linear[ids] -= rate * (g * x + s.decay * model.linear[ids])
            model.factors[ids] = v - rate * (g * (x[:, None] * both - v * (x * x)[:, None]) + s.decay * v)
    if n_valid:
        z = raw_scores(offsets, data, model, s)[valid]
        # each class weighs as in all labels; the bias that fits best
        weight = np.where(y[valid] == 1, share / max((y[valid] == 1).mean(), 1e-9), (1 - share) / max((y[valid] == 0).mean(), 1e-9))
        loss = lambda b: float((weight * (np.logaddexp(0, z + b) - y[valid] * (z + b))).sum())
        model.bias += min(np.linspace(-4, 4, 81), key=loss)
    return model


def sample(docs: DataFrame, labels: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> tuple[list[tuple[bytes, int]], float]:
    """Training rows, and the share of label 1 among usable labels."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("q")).filter("id IS NOT NULL AND q IN (0, 1)").filter(~c.held_out("id"))
    known = known.groupBy("id").agg(F.min("q").alias("q"), F.max("q").alias("q2")).filter("q = q2").select("id", "q")
    counts = {r["q"]: r["n"] for r in known.groupBy("q").agg(F.count("*").alias("n")).collect()}
    rate = F.when(F.col("q") == 1, s.per_class / max(counts.get(1, 0), 1)).otherwise(s.per_class / max(counts.get(0, 0), 1))
    few = known.filter(F.pmod(F.xxhash64(F.lit(s.seed), "id"), F.lit(1 << 30)) / F.lit(float(1 << 30)) < rate)  # about 2 x per_class rows
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).filter(F.octet_length("text") <= s.train_bytes).join(F.broadcast(few), "id").select("id", "text", "q").collect()
    total = sum(counts.values())
    return [(bytes(r["text"]), r["q"]) for r in sorted(rows, key=lambda r: (r["id"], r["text"]))], counts.get(1, 0) / total if total else 0.5


def scored(docs: DataFrame, model: Model | None, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score): one row per document, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
        for b in batches:
            x = logistic(raw_scores(*c.utf8(b.column(1)), m, s)) if m else np.full(b.num_rows, 0.5)
            yield c.batch(schema, b.column(0), x)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(c.tidy(run), "doc_id long, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = c.table(spark, sf_dir, "documents")
    found = scored(docs, train(*sample(docs, c.table(spark, sf_dir, "labels"))))
    return found.select("doc_id", c.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
