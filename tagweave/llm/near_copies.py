"""SimHash near-dedup at a similarity: documents whose sets of five-word shingles are alike by 0.8 or more, all of them.

Words are those of simhash, after A-Z became a-z; a document is the set of its shingles of
``size`` (5) words, fewer words make one shingle.  Two sets link if shared/united shingles,
the Jaccard similarity, is 4/5 or more.  Shingles are equal if their 64-bit hashes are.

1. Equal sets become one class first, so that copies cost nothing later.
2. SimHash: the fingerprints of five-word shingles, linked by the generalised pigeonhole of
   simhash.links, give candidates; so do classes of one fingerprint.  At a similarity of 0.8
   some fingerprints differ in more bits than any pigeonhole can probe (README), so:
3. Prefix filter: in any one order of all shingles, two linked sets share a shingle among
   the first n - ceil(4n/5) + 1 of each.  The order puts those last that recur most, by
   counts over all documents: tasks hand on what two of their documents hold, so a shingle
   in one of ten thousand documents is found at any size.  The counts decide the cost, never
   the result.
   The first shingle that two sets share comes before most of both: at places i of n and j of m, they share
   min(n - i, m - j) at most, which must be 4/9 of n + m; a pair needs to be met at one such place only.
4. Candidates are pruned by size and by parities: a set has 512 bits, each the parity of
   the shingles that hash to it.  Two sets differ in as many shingles at least as in
   bits, and linked sets differ in a ninth of both sizes' sum at most.  Sets over LARGE are
   pruned by counts in bins too: these differ by as much as the sets at most.  What is
   left, of 2 and 3, is verified on the whole sets.
5. First SimHash's candidates are verified, and each class is compared with members of its
   shared shingles chosen by hash (the ``hubs`` nearest in parities): this joins large
   groups in linear work.  Then candidates that aren't of one component yet are compared:
   pairs from shingles that up to HOT classes have in their prefix.
6. Classes with a hotter shingle in their prefix (texts put together from common passages)
   aren't paired.  Shingles that the same of these classes hold are one unit, whose weight is their
   number; units of a thirty-second of a set's size are heavy.  Two linked sets are equal in their heavy units without
   some of a fifth of each set's weight at most, so each class emits a signature of what is left without each
   such choice.  Sets n and m that share a signature of weight H, and l and k of whose shingles are light, can only link if
   9 (H + min(l, k)) >= 4 (n + m), and do if 9 H >= 4 (n + m): then the smallest of a signature's sets links with both,
   a star in linear work.  Other pairs of a signature are verified.
   A class with more than CHOICES choices, or over a fifth of light shingles, is compared with all that share a hot
   shingle of its prefix: nothing is missed, but classes of that kind cost pairs.

Null texts and texts without a word are copies of each other.  Ids are integers.  Empty table: no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c
from .components import components
from .simhash import fingerprints_of
from .simhash import links as fingerprint_links

SIZE, SIGNS = 5, 512
#: sets of more shingles than this also have the number of shingles in each of BINS bins, 255 at most
LARGE, BINS = 500, 512
#: the most recurring shingles that the order knows, and the hashes that a task holds to find them
RECUR, HELD = 100_000, 1 << 22
#: shingles that more open classes have in their prefix are hot; the choices of units that a class may have
HOT, CHOICES = 64, 512
#: a heavy unit has this part of a set's size, rounded up to a power of two
HEAVY = 32
#: the most keys that are broadcast, by their count: 32 MB
FEW = 1_000_000
#: rows (tok, key) that fit a task, should all of them have one key
TASK_ROWS = 500_000
_LAST = (1 << 63) - 1
_KEY = np.uint64(0xA0761D6478BD642F)


def shingle_sets(offsets: np.ndarray, data: np.ndarray, size: int = SIZE):
    """(lo, hi, hashes, bounds) of row ranges: each row's distinct shingle hashes in ascending order, and where they start."""
    for lo, hi in c.chunks(offsets):
        base = offsets[lo]
        seg, at = c.LOWER[data[base : offsets[hi]]], offsets[lo : hi + 1] - base
        starts, ends, first = c.words(seg, at, c.NON_SPACE)
        n_words = np.diff(first)
        hashes = c.word_hashes(seg, starts, ends)
        grams = c.gram_hashes(hashes, size)
        n_grams = np.maximum(n_words - size + 1, 0)
        of = np.repeat(np.arange(hi - lo), n_grams)
        h = grams[np.arange(len(of)) - np.repeat(np.cumsum(n_grams) - n_grams, n_grams) + first[of]] if len(of) else np.zeros(0, np.uint64)
        short = np.flatnonzero((n_words > 0) & (n_words < size))
        if len(short):
            few = [c.gram_hashes(hashes[first[d] : first[d + 1]], int(n_words[d]))[0] for d in short]
            of, h = np.concatenate([of, short]), np.concatenate([h, np.array(few, np.uint64)])
        order = np.lexsort((h, of))
        of, h = of[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = (of[1:] != of[:-1]) | (h[1:] != h[:-1])
        of, h = of[new], h[new]
        yield lo, hi, h, np.searchsorted(of, np.arange(hi - lo + 1))


def _keys(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A hash of each set, as int64; that of the empty set is zero."""
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(c.mixed(h ^ _KEY), out=total[1:])
    return (total[bounds[1:]] - total[bounds[:-1]]).view(np.int64)


def _parities(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """SIGNS parities of each set, in int64."""
    rows = len(bounds) - 1
    cell = np.repeat(np.arange(rows), np.diff(bounds)) * SIGNS + (c.mixed(h) % np.uint64(SIGNS)).astype(np.int64)
    return np.packbits(np.bincount(cell, minlength=rows * SIGNS).reshape(rows, SIGNS) & 1, axis=1, bitorder="little").view("<i8")


def _counts(h: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Counts in bins of each set over LARGE, else null."""
    sizes = np.diff(bounds)
    large = np.flatnonzero(sizes > LARGE)
    of = np.repeat(np.searchsorted(large, np.arange(len(sizes))), sizes)
    own = np.repeat(sizes > LARGE, sizes)
    cell = of[own] * BINS + (c.mixed(h[own] ^ _KEY) % np.uint64(BINS)).astype(np.int64)
    found = np.minimum(np.bincount(cell, minlength=len(large) * BINS), 255).astype(np.int16)
    ends = np.zeros(len(sizes) + 1, np.int32)
    ends[1:] = np.cumsum(sizes > LARGE) * BINS
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(found, pa.int16()), mask=pa.array(sizes <= LARGE))


def _texts(docs: DataFrame, text_col: str, *others) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    return docs.select(*others, F.xxhash64(text).alias("t"), text.alias("text"))


def _classes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, n, signs, fp, bins, t, least): one row per distinct set; least: id (null last) and text hash of its first document."""

    def run(batches):
        schema = pa.schema([("id", pa.int64()), ("t", pa.int64()), ("key", pa.int64()), ("n", pa.int64()), ("signs", pa.list_(pa.int64())), ("fp", pa.int64()), ("bins", pa.list_(pa.int16()))])
        for b in batches:
            offsets, data = c.utf8(b.column(2))
            for lo, hi, h, bounds in shingle_sets(offsets, data):
                width = SIGNS // 64
                signs = c.list_column(_parities(h, bounds).ravel(), np.arange(hi - lo + 1) * width, pa.int64())
                yield c.batch(schema, b.column(0)[lo:hi], b.column(1)[lo:hi], _keys(h, bounds), np.diff(bounds), signs, fingerprints_of(offsets[lo : hi + 1], data, SIZE), _counts(h, bounds))

    own = _texts(docs, text_col, F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("id")).mapInArrow(c.tidy(run), "id long, t long, key long, n long, signs array<long>, fp long, bins array<smallint>")
    return c.stored(own.groupBy("key").agg(F.first("n").alias("n"), F.min("t").alias("t"), F.min(F.struct("id", "t")).alias("least"), F.first("signs").alias("signs"), F.first("fp").alias("fp"), F.first("bins").alias("bins")), "classes")


def _recurring(docs: DataFrame, text_col: str) -> np.ndarray:
    """Shingles (uint64) that recur most, the rarest first."""

    def run(batches):
        schema = pa.schema([("tok", pa.int64()), ("n", pa.int64())])
        held, n = [], 0

        def handed():
            toks, counts = np.unique(np.concatenate(held), return_counts=True)
            several = counts > 1
            return c.batch(schema, toks[several].view(np.int64), counts[several])

        for b in batches:
            for _, _, h, _ in shingle_sets(*c.utf8(b.column(1))):
                held.append(h)
                n += len(h)
                if n >= HELD:
                    yield handed()
                    held, n = [], 0
        if n:
            yield handed()

    counts = _texts(docs, text_col).mapInArrow(c.tidy(run), "tok long, n long").groupBy("tok").agg(F.sum("n").alias("n")).filter("n > 2")
    top = c.stored(counts.orderBy(F.desc("n"), "tok").limit(RECUR), "recurring")
    found = top.toArrow().sort_by([("n", "ascending"), ("tok", "descending")])  # RECUR rows at most
    c.dropped(top)
    return found.column("tok").to_numpy().astype(np.int64).view(np.uint64)


def _shared(docs: DataFrame, text_col: str) -> DataFrame:
    """(tok, key, at, n): members of prefixes with their place and the set's size, of shingles that more than one class has in its prefix."""
    recurring = _recurring(docs, text_col)
    by_value = np.argsort(recurring)
    values = recurring[by_value]

    schema = pa.schema([("tok", pa.int64()), ("key", pa.int64()), ("at", pa.int32()), ("n", pa.int32())])
    kind = "tok long, key long, at int, n int"

    def prefixes(batches):
        sent: set[int] = set()
        for b in batches:
            for lo, hi, h, bounds in shingle_sets(*c.utf8(b.column(1))):
                keys, sizes = _keys(h, bounds), np.diff(bounds)
                fresh = np.zeros(hi - lo, bool)
                for i, k in enumerate(keys.tolist()):
                    if k not in sent:
                        fresh[i] = True
                        sent.add(k)
                h, sizes, keys = h[np.repeat(fresh, sizes)], sizes[fresh], keys[fresh]
                of, start = np.repeat(np.arange(len(keys)), sizes), np.cumsum(sizes) - sizes
                rank = np.zeros(len(h), np.int64)
                if len(values):
                    at = np.minimum(np.searchsorted(values, h), len(values) - 1)
                    rank = np.where(values[at] == h, by_value[at] + 1, 0)
                order = np.lexsort((h, rank, of))
                at = np.arange(len(h)) - start[of]
                stay = at < (sizes - (4 * sizes + 4) // 5 + 1)[of]
                yield c.batch(schema, h[order][stay].view(np.int64), keys[of[stay]], at[stay], sizes[of[stay]])

    def several(batches):
        """Rows sorted by tok and key: drops repeats, and shingles with one class."""
        held, more = [np.zeros(0, np.int64)] * 4, False  # the row before; whether it went out already

        for b in batches:
            cols = [np.concatenate([x, b.column(i).to_numpy(zero_copy_only=False)]) for i, x in enumerate(held)]
            t, k = cols[:2]
            if not len(t):
                continue
            new = np.ones(len(t), bool)
            new[1:] = (t[1:] != t[:-1]) | (k[1:] != k[:-1])
            cols = [x[new] for x in cols]
            t = cols[0]
            same = t[1:] == t[:-1]
            out = np.zeros(len(t), bool)
            out[1:] |= same
            out[:-1] |= same
            last_out = bool(out[-1]) or (len(t) == 1 and more)
            if more:
                out[0] = False
            held, more = [x[-1:] for x in cols], last_out
            yield c.batch(schema, *[x[out] for x in cols])

    # texts stay where they are; a task sends each of its sets once, so that copies send as many rows as there are tasks at most
    rows = _texts(docs, text_col).mapInArrow(c.tidy(prefixes), kind)
    return c.stored(rows.repartition("tok").sortWithinPartitions("tok", "key").mapInArrow(c.tidy(several), kind), "shared")


def _apart(x: str, y: str) -> str:
    return "(" + " + ".join(f"bit_count({x}[{i}] ^ {y}[{i}])" for i in range(SIGNS // 64)) + ")"


_FIRST = "9 * (na - ia) >= 4 * (na + nb) AND 9 * (nb - ib) >= 4 * (na + nb)"
_MAY = f"5 * na >= 4 * nb AND 5 * nb >= 4 * na AND 9 * {_apart('sa', 'sb')} <= na + nb"


def _known(keys: DataFrame, n: int) -> DataFrame:
    """keys, broadcast if they are few by their count: then what they are joined to isn't shuffled."""
    return F.broadcast(keys) if n <= FEW else keys


def _may(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Of the pairs (a, b), those whose sizes and parities allow a similarity of 4/5."""
    side = lambda x: classes.select(F.col("key").alias(x), F.col("n").alias("n" + x), F.col("signs").alias("s" + x))
    return pairs.join(side("a"), "a").join(side("b"), "b").filter(_MAY)


def _likely(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Of the pairs (a, b), those whose counts in bins allow a similarity of 4/5."""
    side = lambda x: classes.select(F.col("key").alias(x), F.col("n").alias("n" + x), F.col("bins").alias("c" + x))
    far = "9 * aggregate(zip_with(ca, cb, (x, y) -> abs(x - y)), 0, (x, y) -> x + y) > na + nb"
    return pairs.join(side("a"), "a").join(side("b"), "b").filter(f"ca IS NULL OR cb IS NULL OR NOT ({far})").select("a", "b")


def _sets(docs: DataFrame, needed: DataFrame, n: int, name: str = "sets") -> DataFrame:
    """(key, toks): the shingles, in ascending order, of the classes in needed (key, id, lt), stored, n of them."""

    def run(batches):
        schema = pa.schema([("t", pa.int64()), ("toks", pa.list_(pa.int64()))])
        for b in batches:
            for lo, hi, h, bounds in shingle_sets(*c.utf8(b.column(1))):
                yield c.batch(schema, b.column(0)[lo:hi], c.list_column(h.view(np.int64), bounds, pa.int64()))

    # the one text of each set that its class names, by id and hash; rows equal in both are dropped below
    texts = docs.select(F.coalesce(F.col("_id"), F.lit(_LAST)).alias("id"), F.xxhash64("_text").alias("lt"), F.col("_text").alias("text"))
    own = texts.join(_known(needed.select("id", "lt"), n), ["id", "lt"], "left_semi").dropDuplicates(["lt"]).select(F.col("lt").alias("t"), "text")
    return c.stored(own.mapInArrow(c.tidy(run), "t long, toks array<long>").join(_known(needed.select("key", F.col("lt").alias("t")), n), "t").select("key", "toks"), name)


def _named(keys: DataFrame, classes: DataFrame) -> DataFrame:
    """(key, id, lt) of the classes in keys; stored."""
    return c.stored(keys.join(classes.select("key", "least"), "key").select("key", F.col("least.id").alias("id"), F.col("least.t").alias("lt")), "needed")


def _verified(docs: DataFrame, pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Of the pairs (a, b) of keys, stored, those with a similarity of 4/5 or more."""
    pairs = c.stored(_likely(pairs, classes), "likely")
    needed = _named(pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct(), classes)
    sets = _sets(docs, needed, needed.count())
    left = sets.toDF("a", "ta").join(_known(pairs, pairs.count()), "a")
    both = left.join(sets.toDF("b", "tb"), "b")
    found = c.stored(both.filter("9 * size(array_intersect(ta, tb)) >= 4 * (size(ta) + size(tb))").select("a", "b"), "verified")
    c.dropped(pairs, needed, sets)
    return found


def choices(weights: list[int], most: int, limit: int) -> list[tuple[int, ...]] | None:
    """All sets of places whose weights sum up to ``most`` at most; None if there are more than ``limit``."""
    order = sorted(range(len(weights)), key=lambda i: weights[i])
    out: list[tuple[int, ...]] = []
    todo: list[tuple[tuple[int, ...], int, int]] = [((), 0, 0)]
    while todo:
        chosen, at, used = todo.pop()
        out.append(chosen)
        if len(out) > limit:
            return None
        for k in range(at, len(order)):  # the lightest first: what follows is too heavy as well
            if used + weights[order[k]] > most:
                break
            todo.append(((*chosen, order[k]), k + 1, used + weights[order[k]]))
    return out


def _signatures(sets: DataFrame, limit: int) -> DataFrame:
    """(key, n, light, level, sig, size): what is left of each set's heavy units without each choice of them, and how many shingles; sig is null for a loose class.

    level: the power of two that heaviness is measured by; a set emits its own and the next, for a linked one may be a quarter larger.
    """
    each = c.stored(sets.select("key", F.explode("toks").alias("tok")), "open-shingles")
    units = each.groupBy("tok").agg(F.count("*").alias("w"), F.expr("xxhash64(count(*), bit_xor(xxhash64(key)), bit_xor(xxhash64(key, 1)))").alias("unit"))
    weighed = c.heavy_join(each, units, ["tok"], "w", each.count(), few=TASK_ROWS).groupBy("key", "unit").agg(F.count("*").alias("n"), F.first("w").alias("held_by"))
    listed = weighed.groupBy("key").agg(F.collect_list(F.struct("unit", "n", "held_by")).alias("units"))

    def run(batches):
        schema = pa.schema([("key", pa.int64()), ("n", pa.int64()), ("light", pa.int64()), ("level", pa.int64()), ("sig", pa.int64()), ("size", pa.int64())])
        for b in batches:
            for key, found in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                n = sum(u["n"] for u in found)
                # what no other class holds is in no other set: it goes in any case
                common = [u for u in found if u["held_by"] > 1]
                most = n // 5 - (n - sum(u["n"] for u in common))
                if most < 0:
                    continue
                own = max(n - 1, 0).bit_length()
                rows = []
                for level in (own, own + 1):
                    heavy = [u for u in common if u["n"] * HEAVY >= 1 << level]
                    size = sum(u["n"] for u in heavy)
                    light = sum(u["n"] for u in common) - size
                    left = choices([u["n"] for u in heavy], most, limit) if 5 * light <= n else None
                    if left is None:
                        rows = [(key, n, light, level, None, size)]
                        break
                    h = [int(x) for x in c.mixed(np.array([u["unit"] for u in heavy], np.int64).view(np.uint64))]
                    total = sum(h)
                    rows += [(key, n, light, level, _signed(total - sum(h[i] for i in r)), size - sum(heavy[i]["n"] for i in r)) for r in left]
                yield c.batch(schema, *[pa.array(col, pa.int64()) for col in zip(*rows)])

    found = c.stored(listed.mapInArrow(c.tidy(run), "key long, n long, light long, level long, sig long, size long"), "signatures")
    c.dropped(each)
    return found


def _signed(x: int) -> int:
    x %= 1 << 64
    return x - (1 << 64) if x >> 63 else x


def _composed(docs: DataFrame, open_: DataFrame, classes: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) among the classes of open_ (tok, key, root), and candidates (a, b)."""
    needed = _named(open_.select("key").distinct(), classes)
    sets = _sets(docs, needed, needed.count(), "open-sets")
    signed = _signatures(sets, limit)
    c.dropped(needed, sets)
    on = ["level", "sig", "size"]
    several = signed.filter("sig IS NOT NULL").groupBy(*on).agg(F.min(F.struct("n", "key")).alias("hub"), F.count("*").alias("w")).filter("w > 1")
    met = c.stored(c.heavy_join(signed.filter("sig IS NOT NULL"), several, on, "w", signed.count()), "met")
    sure = "9 * size >= 4 * (n + hub.n)"
    links = met.filter("key <> hub.key").filter(sure).select(F.col("key").alias("a"), F.col("hub.key").alias("b")).distinct()
    roots = open_.select("key", "root").distinct()
    # pairs that light shingles may make similar; of large groups only those that the star doesn't hold
    side = lambda x: met.select(*on, "w", F.col("key").alias(x), F.col("n").alias("n" + x), F.col("light").alias("l" + x), F.expr(sure).alias("s" + x))
    may = side("a").join(side("b").drop("w"), on).filter("a < b AND NOT (sa AND sb) AND 9 * (size + least(la, lb)) >= 4 * (na + nb) AND 9 * size < 4 * (na + nb)").select("a", "b").distinct()
    loose = signed.filter("sig IS NULL").select("key", F.lit(True).alias("loose"))
    every = open_.join(classes.select("key", "signs"), "key").join(loose, "key", "left")
    end = lambda x, df: df.select("tok", F.col("key").alias(x), F.col("n").alias("n" + x), F.col("at").alias("i" + x), F.col("signs").alias("s" + x), F.col("root").alias("r" + x), F.col("loose").alias("l" + x))
    compared = end("a", every.filter("loose")).join(end("b", every), "tok").filter("ra <> rb AND (lb IS NULL OR a < b)").filter(_FIRST).filter(_MAY).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    apart = may.join(roots.toDF("a", "ra"), "a").join(roots.toDF("b", "rb"), "b").filter("ra <> rb").select("a", "b")
    return links, compared.union(_may(apart, classes).select("a", "b")).distinct()


def _alike(classes: DataFrame) -> DataFrame:
    """(a, b) of keys that SimHash links: each class with the first of its fingerprint, and the firsts of linked fingerprints."""
    firsts = c.stored(classes.groupBy("fp").agg(F.min("key").alias("b"), F.count("*").alias("n")), "fingerprints")
    of = lambda x, y: firsts.select(F.col("fp").alias(x), F.col("b").alias(y))
    linked = fingerprint_links(firsts).distinct().toDF("fa", "fb").join(of("fa", "a"), "fa").join(of("fb", "b"), "fb").select("a", "b")
    several = firsts.filter("n > 1")
    return linked.union(c.heavy_join(classes.select("key", "fp"), several, ["fp"], "n", classes.count()).select(F.col("key").alias("a"), "b"))


def links(docs: DataFrame, classes: DataFrame, text_col: str = "text", hubs: int = 1, id_col: str = "doc_id", hot: int = HOT, limit: int = CHOICES) -> DataFrame:
    """(a, b) of keys that connect all classes whose similarity is 4/5 or more."""
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("_text"))
    shared = _shared(docs, text_col)
    # (a, b): each class and a member of each of its shared shingles, chosen by hash; as many as a prefix at most
    hub = shared.groupBy("tok").agg(F.min_by("key", F.xxhash64("tok", "key")).alias("b"), F.count("*").alias("w"))
    total = shared.count()
    near = _may(c.heavy_join(shared.select("tok", "key"), hub, ["tok"], "w", total, few=TASK_ROWS).select(F.col("key").alias("a"), "b").filter("a <> b").distinct(), classes)
    near = near.groupBy("a").agg(F.collect_set(F.struct(F.expr(_apart("sa", "sb")).alias("far"), "b")).alias("x"))
    star = near.select("a", F.explode(F.slice(F.sort_array("x"), 1, hubs)).alias("x")).select("a", "x.b").union(_may(_alike(classes), classes).select("a", "b"))
    first = _verified(texts, c.stored(star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "star"), classes)
    roots = c.stored(components(first), "roots")
    rooted = c.stored(shared.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key")), "rooted")
    c.dropped(shared, roots)
    mixed = c.stored(rooted.groupBy("tok").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("w")).filter("x <> y").select("tok", "w"), "mixed")
    open_ = c.stored(c.heavy_join(rooted, mixed, ["tok"], "w", total, few=TASK_ROWS), "open")
    c.dropped(rooted, mixed)
    few = open_.filter(F.col("w") <= hot).join(classes.select("key", "signs"), "key")
    side = lambda x: few.select("tok", F.col("key").alias(x), F.col("n").alias("n" + x), F.col("at").alias("i" + x), F.col("signs").alias("s" + x), F.col("root").alias("r" + x))
    rest = side("a").join(side("b"), "tok").filter("ra < rb").filter(_FIRST).filter(_MAY).select("a", "b").distinct()
    crowded = open_.filter(F.col("w") > hot)
    if not crowded.isEmpty():
        composed, loose = _composed(texts, crowded, classes, limit)
        first, rest = first.union(composed), rest.union(loose).distinct()
    rest = c.stored(rest, "rest")
    c.dropped(open_)
    return first.union(_verified(texts, rest, classes))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents' rows without near copies: of each component the row with the smallest id (null last), once."""
    key = c.free_names(docs, "_id", "_t")
    classes = _classes(docs, id_col, text_col)
    roots = components(links(docs, classes, text_col, id_col=id_col))
    rooted = classes.join(roots, classes["key"] == roots["node"], "left").select(F.coalesce("root", "key").alias("root"), "least")
    stay = rooted.groupBy("root").agg(F.min("least").alias("k")).select(F.col("k.id").alias(key[0]), F.col("k.t").alias(key[1]))
    stay = c.stored(stay, "stay")
    c.dropped(classes)
    keyed = docs.withColumns({key[0]: F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)), key[1]: F.xxhash64(F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")))})
    # rows equal in id and text are few, or else one key's rows meet as partial aggregates
    again = c.stored(keyed.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1").select(*key), "again")
    n = again.count()
    kept = keyed.join(_known(stay, stay.count()), key, "left_semi")
    if n:
        kept = kept.join(_known(again, n), key, "left_anti").unionByName(kept.join(_known(again, n), key, "left_semi").dropDuplicates(key))
    return kept.drop(*key)
