"""Language identification: averaged hashed subword embeddings and a linear softmax.

Subwords are runs of 2, 3 and 4 bytes of a word in lower case with a boundary on each
side, hashed into ``buckets``.  Each bucket has an embedding; a text is the mean of its
subwords' embeddings, and a linear layer with softmax gives the languages.  Both are
trained by stochastic gradient descent in numpy on a bounded sample of labelled rows
(``per_language`` rows and ``sample_bytes`` / languages bytes expected for each of at most
``languages`` languages, texts of at most ``train_bytes`` bytes, drawn by a hash of id and
text; rows equal in language and text count once).  As the last layer is linear, the
mean of embeddings times weights equals the mean of per-bucket scores: only that table
(buckets x languages) is broadcast.  Its values are multiples of 2**-14, so sums are exact
and a text of any length scores the same in pieces as in one.

A tenth of the sample, apart from training, calibrates both outputs.  The temperature of the softmax makes scores
probabilities of being right among the learned languages.  Rejection has a measure of its own, since a text of none of them
may look clearly more like one than the others: the table's last column is the logarithm of each bucket's share in
training, and a text is as strange as the mean of that column over its subwords lies under the mean of known texts, in
standard deviations for a text of its length.  The limit is set between known texts (those of the tenth) and unknown
ones: texts of each language against a table that never saw it, and texts whose letters are shuffled.  It lies midway
between the ``reject_rate`` quantile of known and the ``accept_rate`` quantile of unknown texts; where these overlap, at
the former, so that clean texts stay.

Null texts and texts without a letter are ``und`` with score 0 and rejected; so is all
text if no labelled row exists.  Ids are integers; a null id keeps its row and is one of
training's.  Repeated rows get a row each.  Whole texts are read.  Empty table: no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as c

_LETTER = re.compile(r"[^\W\d_]")
_FOLD = c.LOWER.copy()
_FOLD[[b for b in range(128) if not chr(b).isalpha()]] = 0x20
_FOLD[0x80:0x9F] += 0x20  # second bytes of capitals with accents; that other letters become alike costs little
#: a text is counted in pieces of so many bytes, so that long ones need no more memory: each subword in
#: the piece where it starts, for which a piece also sees the three bytes after it
PIECE = 1 << 18
_GRAIN = 1 << 14
#: more subwords than this make no mean surer, for long texts repeat their words
REPEATS = 150


@dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 15
    dimensions: int = 16
    languages: int = 500
    per_language: int = 700
    train_bytes: int = 1 << 16
    sample_bytes: int = 1 << 28
    epochs: int = 4
    rate: float = 4.0
    reject_rate: float = 0.0005
    accept_rate: float = 0.02
    unknown: int = 20  # languages left out, one at a time, and hundreds of texts that are shuffled
    seed: int = 11


@dataclass
class Model:
    names: list[str]
    table: np.ndarray  # buckets x languages, and a last column of familiarity
    bias: np.ndarray
    temperature: float
    usual: tuple[float, float, float]  # of familiarity: mean, variance between texts and within one
    limit: float  # strangeness up to which a text is accepted


def subwords(seg: np.ndarray, bounds: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and document of each subword; bounds: offsets of documents in seg."""
    n_docs = len(bounds) - 1
    # a boundary before and after each document
    padded = np.full(len(seg) + n_docs + 1, 0x20, np.uint8)
    doc = np.repeat(np.arange(n_docs), np.diff(bounds))
    padded[np.arange(len(seg)) + doc + 1] = _FOLD[seg]
    of = np.zeros(len(padded), np.int32)
    of[1:] = np.repeat(np.arange(n_docs), np.diff(bounds) + 1)
    found = list(_runs(padded, buckets, len(padded)))
    # the second byte of a run belongs to its document, but for two bytes that end in a boundary
    return np.concatenate([keys for _, keys, _ in found]), np.concatenate([of[at + (padded[at] == 0x20 if k == 2 else 1)] for at, _, k in found])


def _runs(padded: np.ndarray, buckets: int, most: int):
    """(starts, buckets, k) of the runs of k bytes that start before ``most``."""
    b, gap = padded.astype(np.uint32), padded == 0x20
    for k in (2, 3, 4):
        n = max(0, min(len(b) - k + 1, most))
        h = b[:n].copy()
        ok = ~(gap[:n] & gap[k - 1 : k - 1 + n]) if k == 2 else np.ones(n, bool)
        for j in range(1, k):
            h = h * np.uint32(0x01000193) ^ b[j : j + n]
            if j < k - 1:
                ok &= ~gap[j : j + n]
        h = (h + np.uint32(k)) * np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(15)
        at = np.flatnonzero(ok)
        yield at, (h[at] % np.uint32(buckets)).astype(np.int64), k


def _totals(offsets: np.ndarray, data: np.ndarray, table: np.ndarray):
    """(lo, hi, sums, n) of row ranges: sums of the table's rows over each document's subwords, and their number."""
    buckets, k = table.shape
    for lo, hi in c.chunks(offsets, PIECE):
        base, size = offsets[lo], int(offsets[hi] - offsets[lo])
        if hi - lo > 1 or size <= PIECE:
            keys, doc = subwords(data[base : offsets[hi]], offsets[lo : hi + 1] - base, buckets)
            yield lo, hi, np.stack([np.bincount(doc, table[:, j][keys], minlength=hi - lo) for j in range(k)], axis=1), np.bincount(doc, minlength=hi - lo)
            continue
        seen = np.zeros(buckets, np.int64)
        for at in range(0, size + 2, PIECE):  # one long document with a boundary on each side
            end = min(size + 2, at + PIECE + 3)
            piece = np.full(end - at, 0x20, np.uint8)
            inner = _FOLD[data[base + max(0, at - 1) : base + min(size, end - 1)]]
            piece[at == 0 : (at == 0) + len(inner)] = inner
            for _, keys, _ in _runs(piece, buckets, PIECE):
                seen += np.bincount(keys, minlength=buckets)
        yield lo, hi, (seen @ table.astype(np.float64))[None, :], np.array([seen.sum()])


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _familiar(data: list, buckets: int) -> np.ndarray:
    """The logarithm of each bucket's mean share in the texts."""
    share = np.zeros(buckets)
    for ids, part, *_ in data:
        share[ids] += part
    return np.round(np.log(share / max(1, len(data)) + 1e-6) * _GRAIN) / _GRAIN


def _usual(data: list, column: np.ndarray) -> tuple[float, float, float]:
    u = np.array([part @ column[ids] for ids, part, *_ in data])
    inner = np.array([part @ column[ids] ** 2 for ids, part, *_ in data]) - u * u
    n = np.array([count for *_, count in data])
    within = float(np.maximum(inner, 0).mean())
    return float(u.mean()), float(max(1e-4, u.var() - (within / np.minimum(n, REPEATS)).mean())), within


def strangeness(familiar, n, usual: tuple[float, float, float]):
    """How far sums of familiarity over n subwords lie under those of known texts, in standard deviations."""
    mean, between, within = usual
    n = np.maximum(n, 1)
    return (mean - familiar / n) / np.sqrt(between + within / np.minimum(n, REPEATS))


def _strange(data: list, column: np.ndarray, usual) -> np.ndarray:
    return np.array([float(strangeness(part @ column[ids] * count, count, usual)) for ids, part, _, count in data])


def _counted(text: bytes, y: int, buckets: int):
    seg = np.frombuffer(text, np.uint8)
    keys, _ = subwords(seg, np.array([0, len(seg)]), buckets)
    if not len(keys):
        return None
    ids, n = np.unique(keys, return_counts=True)
    return ids, (n / n.sum()).astype(np.float32), y, int(n.sum())


def _shuffled(text: bytes, rng) -> bytes:
    """The text with its letters in another order, the gaps where they were."""
    seg = np.frombuffer(text, np.uint8).copy()
    letters = np.flatnonzero(_FOLD[seg] != 0x20)
    seg[letters] = seg[rng.permutation(letters)]
    return seg.tobytes()


def _rejection(fit: list, valid: list, texts: list[bytes], column: np.ndarray, s: Settings, rng) -> tuple[tuple[float, float, float], float]:
    """The usual familiarity, and the limit of strangeness."""
    usual = _usual(valid, column)
    known = float(np.quantile(_strange(valid, column, usual), 1 - s.reject_rate))
    unknown = [_strange([x for t in texts[: 100 * s.unknown] if (x := _counted(_shuffled(t, rng), 0, s.buckets))], column, usual)]
    for y in sorted({d[2] for d in valid})[: s.unknown]:
        rest, others, own = [d for d in fit if d[2] != y], [d for d in valid if d[2] != y], [d for d in [*valid, *fit] if d[2] == y][:200]
        if rest and others:
            blind = _familiar(rest, s.buckets)
            unknown.append(_strange(own, blind, _usual(others, blind)))
    strange = float(np.quantile(np.concatenate(unknown), s.accept_rate)) if sum(map(len, unknown)) else known
    return usual, max(known, (known + strange) / 2)


def train(rows: list[tuple[bytes, str]], s: Settings = Settings()) -> Model | None:
    """rows in any order; None if there are none."""
    if not rows:
        return None
    names = sorted({lang for _, lang in rows})
    of = {n: i for i, n in enumerate(names)}
    rng = np.random.default_rng(s.seed)
    data, texts = [], []
    for text, lang in rows:
        found = _counted(text, of[lang], s.buckets)
        if found:
            data.append(found)
            texts.append(text)
    order = rng.permutation(len(data))
    n_valid = max(1, len(data) // 10) if len(data) > 20 else 0
    valid, fit = order[:n_valid], order[n_valid:]
    e = rng.uniform(-1, 1, (s.buckets, s.dimensions)).astype(np.float32) / s.dimensions
    w, bias = np.zeros((s.dimensions, len(names)), np.float32), np.zeros(len(names), np.float32)
    step, steps = 0, max(1, s.epochs * len(fit))
    for _ in range(s.epochs):
        for i in rng.permutation(fit):
            ids, share, y, _ = data[i]
            rate = s.rate * (1 - step / steps)
            step += 1
            x = share @ e[ids]
            g = _softmax(x @ w + bias)
            g[y] -= 1
            back = w @ g
            w -= rate * 0.1 * np.outer(x, g)
            bias -= rate * 0.01 * g
            e[ids] -= rate * np.outer(share, back)
    table = np.round(e @ w * _GRAIN) / _GRAIN
    column = _familiar([data[i] for i in fit], s.buckets)
    temperature, usual, limit = 1.0, (0.0, 1.0, 0.0), float("inf")
    if n_valid:
        logits = np.array([share @ table[ids] + bias for ids, share, *_ in (data[i] for i in valid)])
        y = np.array([data[i][2] for i in valid])
        temperature = _fitted(logits, y)
        usual, limit = _rejection([data[i] for i in fit], [data[i] for i in valid], [texts[i] for i in valid], column, s, rng)
    return Model(names, np.concatenate([table, column[:, None]], axis=1).astype(np.float32), bias, float(temperature), usual, limit)


def _fitted(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of the least loss; smoothing by half a wrong answer keeps it finite where all answers are right."""
    soft = 0.5 / (len(y) + 1)
    hot = np.eye(logits.shape[1])[y] * (1 - soft) + soft / logits.shape[1]
    return float(min(np.geomspace(1e-4, 100, 241), key=lambda t: float(-(hot * np.log(np.maximum(_softmax(logits / t), 1e-300))).sum())))


def predict(offsets: np.ndarray, data: np.ndarray, model: Model) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, scores, and whether each text is accepted as one of the learned languages."""
    names, scores, ok = [], np.zeros(len(offsets) - 1), np.zeros(len(offsets) - 1, bool)
    for lo, hi, sums, n in _totals(offsets, data, model.table):
        p = _softmax((sums[:, :-1] / np.maximum(n, 1)[:, None] + model.bias) / model.temperature)
        best = p.argmax(axis=1)
        scores[lo:hi] = p[np.arange(hi - lo), best]
        ok[lo:hi] = strangeness(sums[:, -1], n, model.usual) <= model.limit
        names += [model.names[i] for i in best]
    return names, scores, ok


def sample(docs: DataFrame, s: Settings = Settings(), text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> list[tuple[bytes, str]]:
    """Labelled rows for training: about languages x per_language of them and sample_bytes at most, by expectation."""
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("lang IS NOT NULL AND text IS NOT NULL").filter(~c.held_out("id"))
    known = known.filter(F.octet_length("text") <= s.train_bytes)
    counts = known.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).orderBy(F.desc("n"), "lang").limit(s.languages)
    share = F.pmod(F.xxhash64(F.lit(s.seed), "id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    few = F.broadcast(counts.withColumn("bytes_each", F.lit(s.sample_bytes) / F.count("*").over(Window.partitionBy(F.lit(0)))))  # s.languages rows at most
    rows = known.join(few, "lang").filter((share * F.col("n") <= s.per_language) & (share * F.col("bytes") <= F.col("bytes_each")))
    rows = rows.groupBy("lang", F.col("text").cast("binary").alias("text")).agg(F.min("id").alias("id"))
    return [(bytes(r["text"]), r["lang"]) for r in sorted(rows.collect(), key=lambda r: (str(r["id"]), r["lang"], r["text"]))]


def identify(docs: DataFrame, model: Model | None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, lang_pred, score, rejected): one row per document, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])
        for b in batches:
            offsets, data = c.utf8(b.column(1))
            names, scores, ok = predict(offsets, data, m) if m else (["und"] * b.num_rows, np.zeros(b.num_rows), np.zeros(b.num_rows, bool))
            for i in range(b.num_rows):
                if not has_letter(data, int(offsets[i]), int(offsets[i + 1])):
                    names[i], scores[i], ok[i] = "und", 0.0, False
            yield c.batch(schema, b.column(0), pa.array(names), scores, ~ok)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(c.tidy(run), "doc_id long, lang_pred string, score double, rejected boolean")


def accepted(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The documents' rows whose language the model doesn't reject, with all their columns; no shuffle.  Without a model nothing is rejected but texts without letters."""
    shared, place = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches):
        m = shared.value
        for b in batches:
            offsets, data = c.utf8(b.column(place))
            keep = np.array([has_letter(data, int(offsets[i]), int(offsets[i + 1])) for i in range(b.num_rows)], bool)
            if m:
                keep &= predict(offsets, data, m)[2]
            yield b.filter(pa.array(keep))

    return docs.mapInArrow(c.tidy(run), docs.schema)


def has_letter(data: np.ndarray, lo: int, hi: int) -> bool:
    if lo == hi:
        return False
    head = data[lo : min(hi, lo + 64)]
    if (((head | 32) >= 0x61) & ((head | 32) <= 0x7A)).any():
        return True
    # superscripts and the like pass the pattern, but aren't letters
    return any(m[0].isalpha() for m in _LETTER.finditer(data[lo:hi].tobytes().decode("utf-8", "replace")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = c.table(spark, sf_dir, "documents")
    found = identify(docs, train(sample(docs)))
    return found.select("doc_id", c.held_out("doc_id").alias("held_out"), "lang_pred", "score", "rejected")
