"""SimHash near-duplicates, linked by the generalised pigeonhole principle.

A fingerprint has 64 bits; two link at ``distance`` (2) or fewer differing bits.

1. Fingerprints: words are ``[^\\x20\\x09-\\x0D]+`` after A-Z became a-z; shingles of 3
   words, repeats included, space-joined; fewer words make one shingle, none the
   fingerprint zero.  A bit is 1 if it is set in over half of the shingles' XXH64 (seed 42).
2. Equal fingerprints become one class first, so that copies cost nothing later.
3. The 64 bits are grouped into partitions, correlated bits together (correlations over
   all classes).  Dynamic programming gives each partition a number of differing bits
   to tolerate, -1 (never probed) and up, the sum of (tolerance + 1) being distance + 1,
   so that estimated candidates and probes are fewest.  By the principle, two
   fingerprints within the distance agree up to the tolerance in one partition at least.
4. Probe: each fingerprint looks up all values within a partition's tolerance, and
   candidates are verified.  A bucket with more than ``bucket`` members isn't paired:
   its members and those that probe it emit the 65 values within one bit of them.  Two
   fingerprints are within two bits exactly if they share such a value, and a value has
   65 emitters at most, so this finds the same links in linear work.
5. Links become components; a component's id is its smallest doc_id.

Null texts and texts without a word share the fingerprint zero and are linked like any
other.  A null doc_id keeps its row and gets its component's id.  Empty table: no rows.

Ids are integers, or text that Spark casts to them.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as c
from .components import components

BITS = 64
_BITS_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprints_of(offsets: np.ndarray, data: np.ndarray, size: int = 3) -> np.ndarray:
    """The fingerprint, as int64, of each document in an Arrow text buffer."""
    from xxhash import xxh64_intdigest

    clean = np.where(c.SPACES, np.uint8(0x20), c.LOWER)
    out = np.zeros(len(offsets) - 1, np.uint64)
    for lo, hi in c.chunks(offsets):
        base = offsets[lo]
        seg, bounds = data[base : offsets[hi]], offsets[lo : hi + 1] - base
        starts, ends, first = c.words(seg, bounds, c.NON_SPACE)
        if not len(starts):
            continue
        raw = clean[seg].tobytes()
        n_words = np.diff(first)
        n_grams = np.where(n_words >= size, n_words - size + 1, np.minimum(n_words, 1))
        of = np.repeat(np.arange(hi - lo), n_grams)
        at = np.arange(len(of)) - np.repeat(np.cumsum(n_grams) - n_grams, n_grams) + first[of]
        to = np.minimum(at + size, first[of + 1]) - 1
        s, e = starts[at], ends[to]
        # one space between words: the shingle lies in the text as it is
        length = np.concatenate([[0], np.cumsum(ends - starts)])
        tight = (e - s) == length[to + 1] - length[at] + (to - at)
        hashes = np.fromiter((xxh64_intdigest(raw[i:j], 42) for i, j in zip(s.tolist(), e.tolist())), np.uint64, len(s))
        for k in np.flatnonzero(~tight):
            hashes[k] = xxh64_intdigest(b" ".join(raw[starts[w] : ends[w]] for w in range(at[k], to[k] + 1)), 42)
        octets = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
        for b in range(8):
            # documents in blocks: a histogram of 256 values for each
            seen = np.bincount(of * 256 + octets[:, b], minlength=(hi - lo) * 256).reshape(hi - lo, 256)
            over = (2 * (seen @ _BITS_OF_BYTE) > n_grams[:, None]) & (n_grams > 0)[:, None]
            out[lo:hi] |= np.packbits(over, axis=1, bitorder="little")[:, 0].astype(np.uint64) << np.uint64(8 * b)
    return out.view(np.int64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """(doc_id, t, fp): one row per document, no shuffle; t is a hash of the text, to tell rows apart."""

    def run(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("t", pa.int64()), ("fp", pa.int64())])
        for b in batches:
            yield c.batch(schema, b.column(0), b.column(1), fingerprints_of(*c.utf8(b.column(2)), size))

    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("t"), text.alias("text")).mapInArrow(c.tidy(run), "doc_id long, t long, fp long")


def _moments(classes: DataFrame) -> tuple[int, np.ndarray]:
    """Number of classes and the 64 x 64 counts of bits that are 1 together, over all classes."""
    pairs = [(i, j) for i in range(BITS) for j in range(i, BITS)]

    def run(batches):
        total = np.zeros((BITS, BITS))
        for b in batches:
            fps = b.column(0).to_numpy(zero_copy_only=False).astype("<i8")
            for k in range(0, len(fps), 1 << 15):
                x = np.unpackbits(fps[k : k + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                total += x.T @ x
        if total.any():
            i, j = np.triu_indices(BITS)
            yield pa.RecordBatch.from_pydict({"k": pa.array(np.arange(len(i)), pa.int32()), "v": pa.array(total[i, j].astype(np.int64))})

    out = np.zeros((BITS, BITS))
    for row in classes.select("fp").mapInArrow(c.tidy(run), "k int, v long").groupBy("k").agg(F.sum("v").alias("v")).collect():  # 2,080 rows at most
        i, j = pairs[row["k"]]
        out[i, j] = out[j, i] = row["v"]
    return classes.count(), out


def arrange(n: int, together: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in ``parts`` groups of near equal size, the most correlated ones together."""
    p = np.diag(together) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    strength = np.abs((together / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(strength, 0)
    left, out = set(range(BITS)), []
    for k in range(parts):
        size = BITS // parts + (k < BITS % parts)
        rest = sorted(left)
        group = [max(rest, key=lambda b: (strength[b, rest].sum(), -b))]
        while len(group) < size:
            rest = sorted(left - set(group))
            group.append(max(rest, key=lambda b: (strength[b, group].mean(), -b)))
        left -= set(group)
        out.append(sorted(group))
    return out


def allot(n: int, together: np.ndarray, groups: list[list[int]], distance: int) -> tuple[float, list[int]]:
    """The tolerance of each group with the least estimated cost; cost counts probes and candidates alike."""
    p = np.diag(together) / max(n, 1)
    costs = []
    for g in groups:
        near = np.zeros(len(g) + 2)  # chance that two fingerprints differ in k bits of the group
        near[0] = 1
        for b in g:
            differ = 2 * p[b] * (1 - p[b])
            near[1:] = near[1:] * (1 - differ) + near[:-1] * differ
            near[0] *= 1 - differ
        ball, cost = 0.0, [0.0]
        for t in range(min(distance, len(g)) + 1):
            ball += float(np.prod([(len(g) - i) / (i + 1) for i in range(t)]))
            cost.append(n * ball + n * n / 2 * float(near[: t + 1].sum()))
        costs.append(cost)
    best = {0: (0.0, [])}  # budget used so far -> cost, tolerances
    for cost in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (sofar, chosen) in best.items():
            for e, more in enumerate(cost):
                if used + e <= distance + 1 and (used + e not in step or sofar + more < step[used + e][0]):
                    step[used + e] = (sofar + more, [*chosen, e - 1])
        best = step
    return best.get(distance + 1, (float("inf"), []))


def plan(n: int, together: np.ndarray, distance: int) -> list[tuple[list[int], int]]:
    """(bits, tolerance) of each partition that is probed, from the cheapest number of partitions."""
    n = max(n, 2)  # an empty table is planned like a tiny one
    options = []
    for parts in range(1, distance + 3):
        groups = arrange(n, together, parts)
        cost, chosen = allot(n, together, groups, distance)
        options.append((cost, parts, [(g, t) for g, t in zip(groups, chosen) if t >= 0]))
    return min(options, key=lambda o: o[:2])[2]


def _long(bits) -> int:
    x = sum(1 << b for b in bits)
    return x - (1 << 64) if x >> 63 else x


def links(classes: DataFrame, distance: int = 2, bucket: int = 16) -> DataFrame:
    """(a, b) of distinct fingerprints that connect all that are within the distance; classes: stored, one row per fp."""
    if distance > 2:
        raise ValueError("oversized buckets are split exactly for distances up to 2 only")
    n, together = _moments(classes)
    probed = plan(n, together, distance)
    mask = [F.col("fp").bitwiseAND(F.lit(_long(bits))) for bits, _ in probed]
    index = c.stored(classes.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("part"), m.alias("key")) for i, m in enumerate(mask)])).alias("k")).select("fp", "k.*"), "index")
    total = n * len(probed)
    counts = index.groupBy("part", "key").agg(F.count("*").alias("n")).filter("n > 1")
    crowded = c.stored(counts.filter(F.col("n") > bucket), "crowded")
    # Members of buckets that may be paired: those of partitions probed exactly need a partner there.
    exact = [i for i, (_, t) in enumerate(probed) if t == 0]
    wide = [i for i, (_, t) in enumerate(probed) if t > 0]
    small = counts.filter(F.col("n") <= bucket)
    pairs = []
    if exact:
        members = index.filter(F.col("part").isin(exact)).join(small, ["part", "key"]).groupBy("part", "key").agg(F.collect_list("fp").alias("fps"))  # bucket rows at most
        pairs.append(members.select(F.explode(F.expr(
            f"filter(flatten(transform(fps, x -> transform(filter(fps, y -> x < y AND bit_count(x ^ y) <= {distance}), y -> struct(x AS a, y AS b)))), p -> true)")).alias("p")).select("p.a", "p.b"))
    hot = c.heavy_join(index, crowded, ["part", "key"], "n", total).select("fp")
    if wide:
        flips = F.array(*[F.struct(F.lit(i).alias("part"), mask[i].bitwiseXOR(F.lit(_long(f))).alias("key")) for i in wide for r in range(probed[i][1] + 1) for f in combinations(probed[i][0], r)])
        probes = c.stored(classes.select(F.col("fp").alias("a"), F.explode(flips).alias("k")).select("a", "k.*"), "probes")
        open_index = index.filter(F.col("part").isin(wide)).join(crowded.select("part", "key"), ["part", "key"], "left_anti").withColumnRenamed("fp", "b")
        pairs.append(probes.join(open_index, ["part", "key"]).filter(f"a < b AND bit_count(a ^ b) <= {distance}").select("a", "b"))
        hot = hot.union(probes.join(crowded.select("part", "key"), ["part", "key"], "left_semi").select(F.col("a").alias("fp")))
    # 65 values within one bit; a value has 65 emitters at most, for the fingerprints are distinct
    star = hot.distinct().select("fp", F.explode(F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_long([b]))) for b in range(BITS)])).alias("z"))
    near = star.groupBy("z").agg(F.min("fp").alias("b"), F.collect_list("fp").alias("fps")).filter("size(fps) > 1")
    if distance < 2:
        near = near.withColumn("fps", F.expr(f"filter(fps, x -> bit_count(x ^ b) <= {distance})"))
    found = near.select(F.explode("fps").alias("a"), "b").filter("a <> b")
    for p in pairs:
        found = found.union(p)
    return found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 2, bucket: int = 16) -> DataFrame:
    """(doc_id, t, fp, root, component_id, n_equal): one row per document; root is the component's smallest fingerprint."""
    own = c.stored(fingerprints(docs, id_col, text_col), "fingerprints")
    classes = c.stored(own.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("least")), "classes")
    roots = components(links(classes, distance, bucket))
    joined = c.stored(classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "n", "least", F.coalesce("root", "fp").alias("root"), F.col("root").isNotNull().alias("linked")), "roots")
    ids = joined.filter("linked").groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("w"))
    n_linked = joined.filter("linked").count()
    known = c.stored(
        c.heavy_join(joined.filter("linked"), ids, ["root"], "w", n_linked).select("fp", "n", "root", "component_id").unionByName(joined.filter("NOT linked").select("fp", "n", "root", F.col("least").alias("component_id"))), "known"
    )
    total = own.count()
    return c.heavy_join(own, known, ["fp"], "n", total).select("doc_id", "t", "fp", "root", "component_id", F.col("n").alias("n_equal"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents' rows without near duplicates: of each component the row with the smallest id (null last), once."""
    last = F.lit((1 << 63) - 1)
    key = c.free_names(docs, "_id", "_t")
    found = near_duplicates(docs, id_col, text_col)
    stay = found.groupBy("root").agg(F.min(F.struct(F.coalesce("doc_id", last).alias(key[0]), F.col("t").alias(key[1]))).alias("k")).select("k.*")
    keyed = docs.withColumns({key[0]: F.coalesce(F.col(id_col).cast("long"), last), key[1]: F.xxhash64(F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")))})
    return keyed.join(stay, key, "left_semi").dropDuplicates(key).drop(*key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(c.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
