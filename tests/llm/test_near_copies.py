"""Near copies of texts put together from common passages: links against brute force, and work that grows with the texts."""

import random
from itertools import combinations

import numpy as np
import pytest

from tagweave.llm import near_copies as nc

SCHEMA = "doc_id long, text string, key string, root int, tok string"


def passages(rng, n, words=40):
    return [" ".join(f"w{rng.randrange(400)}" for _ in range(words)) for _ in range(n)]


def shingles(text):
    w = text.lower().split()
    return frozenset(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def components(texts):
    """Smallest place of each text's component."""
    sets = [shingles(t) for t in texts]
    every = sorted(set().union(*sets))
    at = {s: i for i, s in enumerate(every)}
    m = np.zeros((len(sets), max(1, len(every))), np.float32)
    for i, s in enumerate(sets):
        m[i, [at[x] for x in s]] = 1
    shared = m @ m.T
    n = m.sum(axis=1)
    near = 9 * shared >= 4 * (n[:, None] + n[None, :])
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in np.argwhere(np.triu(near, 1)):
        a, b = find(int(i)), find(int(j))
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))], int(np.triu(near, 1).sum())


def composed(rng, n, pool, of):
    """Texts of passages, with copies that lack one, have another one, or a changed word."""
    out = []
    while len(out) < n:
        own = rng.sample(pool, of)
        out.append(" ".join(own))
        kind = rng.random()
        if kind < 0.1:
            out.append(" ".join(own[:-1]))
        elif kind < 0.2:
            out.append(" ".join([*own[:-1], rng.choice(pool)]))
        elif kind < 0.25:
            out.append(" ".join(own).replace("w1", "x1", 2))
        elif kind < 0.3:
            out.append(" ".join(rng.sample(own, of)))
    return out[:n]


@pytest.mark.parametrize("hot,limit", [(64, 512), (3, 512), (1, 4), (3, 0)])
def test_links_of_composed_texts(spark, hot, limit):
    rng = random.Random(hot + limit)
    pool = passages(rng, 14)
    texts = composed(rng, 220, pool, 7) + composed(rng, 60, pool, 3) + [" ".join(f"v{rng.randrange(90)}" for _ in range(80)) for _ in range(20)] + ["", "one two", "one two"]
    want, linked = components(texts)
    docs = spark.createDataFrame([(i, t, "own", 1, "x") for i, t in enumerate(texts)], SCHEMA)
    classes = nc._classes(docs, "doc_id", "text")
    found = nc.links(docs, classes, hot=hot, limit=limit).distinct().collect()
    ids = {r["key"]: r["least"]["id"] for r in classes.collect()}
    root = {i: i for i in range(len(texts))}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    first = {}
    for i, t in enumerate(texts):  # equal sets are one class
        j = first.setdefault(shingles(t), i)
        root[find(i)] = find(j)
    for r in found:
        a, b = find(ids[r["a"]]), find(ids[r["b"]])
        root[max(a, b)] = min(a, b)
    got = [find(i) for i in range(len(texts))]
    assert linked > 20 and {(i, j) for i, j in combinations(range(len(texts)), 2) if got[i] == got[j]} == {(i, j) for i, j in combinations(range(len(texts)), 2) if want[i] == want[j]}


def test_choices():
    assert sorted(nc.choices([3, 1, 2], 3, 99)) == sorted([(), (1,), (2,), (1, 2), (0,)])
    assert nc.choices([1] * 20, 2, 211) is not None and nc.choices([1] * 20, 2, 210) is None and nc.choices([], 5, 1) == [()]


def test_work_grows_with_the_texts(spark, monkeypatch):
    """Unlike texts of common passages: each shares hundreds of shingles with most others."""
    rng = random.Random(1)
    pool = passages(rng, 50, 60)
    rows: dict = {}
    stored = nc.c.stored

    def counted(df, name):
        out = stored(df, name)
        rows[name] = rows.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(nc.c, "stored", counted)
    sizes, seen = (400, 1600), []
    for n in sizes:
        rows.clear()
        texts = [" ".join(rng.sample(pool, 10)) for _ in range(n)]
        docs = spark.createDataFrame([(i, t, "own", 1, "x") for i, t in enumerate(texts)], SCHEMA)
        found = nc.links(docs, nc._classes(docs, "doc_id", "text")).distinct().count()
        assert found == 0 and components(texts)[1] == 0
        seen.append(dict(rows))
    pairs = lambda x: x.get("rest", 0) + x.get("star", 0) + x.get("met", 0)
    assert pairs(seen[1]) < 1600 and all(seen[1][k] < 8 * seen[0][k] + 1600 for k in seen[0])
