"""Spelling variants against brute force over all pairs, with every bucket size that changes the way."""

import random
import re
import zlib
from collections import Counter

import pytest

from tagweave.llm import spelling

SCHEMA = "doc_id long, text string, word string, n int, id string"


def make(spark, rows):
    return spark.createDataFrame([(i, t, "own", 1, "x") for i, t in rows], SCHEMA)


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def brute(rows, garble=97, letters=5, least=3):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in run)
            h = zlib.crc32(f"{doc}:{run}".encode())
            if doc is not None and h % garble == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    words = {w: k for w, k in n.items() if len(w) >= letters and k >= least}
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {w: (lambda best: best if best and words[best] >= 2 * words[w] else None)(min(near[w], key=lambda v: (-words[v], v), default=None)) for w in words}

    def root(w):
        return root(form[w]) if form[w] else w

    return {(w, form[w], root(w), words[w], len(near[w]), words[form[w]] if form[w] else None) for w in words}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    stems = ["".join(rng.choice("abéÀßxyz") for _ in range(rng.randint(4, 9))) for _ in range(25)] + ["aaaaaa", "ababab", "Großstadt", "straße"]

    def variant(w):
        k = rng.randrange(len(w) + 1)
        return rng.choice([w, w, w, w[:k] + rng.choice("abéxyz") + w[k:], w[:k] + w[k + 1 :], w[:k] + rng.choice("abéxyz") + w[k + 1 :]])

    pool = [variant(variant(w)) for w in stems for _ in range(14)]
    text = lambda n: rng.choice([" ", ", ", "\n", "1"]).join(rng.choice([str.upper, str.title, str])(rng.choice(pool)).replace("SS", "ß") for _ in range(n))
    out = [(i, text(rng.randint(0, 60))) for i in range(150)]
    return out + [(500, text(20000)), (501, None), (502, ""), (503, "12 Ā 中文 x×y÷z"), (None, text(80)), (7, out[7][1]), (504, "q" * 3000 + " " + "q" * 2999), (505, ("q" * 3000 + "1") * 3 + ("q" * 2999 + " ") * 5)]


@pytest.mark.parametrize("bucket", [64, 3, 1])
def test_variants(spark, rows, bucket):
    got = spelling.variants(make(spark, rows), bucket=bucket).collect()
    want = brute(rows)
    assert len(got) == len(want) and {tuple(r[k] for k in ("word", "form", "root", "n", "n_near", "form_n")) for r in got} == want
    assert sum(r["root"] != r["form"] for r in got if r["form"]) > 3


def test_candidates_hold_every_pair(spark):
    """All words of a few letters: prefixes and suffixes are as crowded as can be."""
    rng = random.Random(8)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(5, 9))) for _ in range(260)})
    rows = [(1, " ".join(w for w in words for _ in range(3)))]
    for bucket in (1000, 8):
        got = spelling.variants(make(spark, rows), garble=1 << 40, bucket=bucket).collect()
        assert {(r["word"], r["n_near"]) for r in got} == {(w, sum(one_edit(w, v) for v in words)) for w in words}


def test_runs_by_pieces(monkeypatch):
    rng = random.Random(9)
    text = "".join(rng.choice("abÀÿ×Ā 1Z") for _ in range(5000))
    whole = [r for found in spelling.runs(text.encode()) for r in found]
    monkeypatch.setattr(spelling, "PIECE", 7)
    assert [r for found in spelling.runs(text.encode()) for r in found] == whole == [r.translate({90: 122}) for r in re.findall("[A-Za-zÀ-ÿ]+", text)]


def test_counts_are_handed_on_in_bounded_tables(spark, rows, monkeypatch):
    want = brute(rows)
    monkeypatch.setattr(spelling, "HELD", 5)
    got = spelling.variants(make(spark, rows)).collect()
    assert {(r["word"], r["n"]) for r in got} == {(w[0], w[3]) for w in want}


def test_no_words(spark):
    for rows in ([], [(1, None), (2, ""), (None, "abc def")]):
        assert spelling.variants(make(spark, rows)).count() == 0
