"""Operators against brute force and round trips, with nulls, empties, ties, repeats, long texts and clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tagweave.llm import common, decontaminate, host_rules, language, near_copies, packing, quality, sharding, simhash, suffixes, tokens, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, n_words string, kept int"


def make_docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, src, len(t or ""), "x", "y", 1) for i, t, lang, src in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice(["the", "on", "er", "ti", "ha", "st", "é", "ß"]) for _ in range(rng.randint(1, 3)))
    text = lambda n: " ".join(word() for _ in range(n))
    base, passage = text(200), text(60)
    near = base.split(" ")
    # edits, in a row, until the fingerprint differs by one or two bits
    for k in range(10, 200):
        near = base.split(" ")
        near[k] = "changed"
        if 1 <= bin(brute_fp(base) ^ brute_fp(" ".join(near))).count("1") <= 2:
            break
    out = [(1, base, "en", "a"), (2, base, "en", "a"), (3, " ".join(near), "en", "a"), (4, None, None, "b"), (5, "", "en", None), (6, " \n\t ", "fr", "b"), (7, "one two", "de", "a"), (8, "12 34", "de", "a")]
    out += [(9, text(30) + " " + passage + "\n" + text(30), "en", "a"), (10, text(90) + "  " + passage, "fr", "a"), (11, text(30000), "fr", "hot"), (12, "x " * 120, "de", "hot"), (None, text(80), "en", "a"), (1, base, "en", "a")]
    return out + [(20 + i, text(60), rng.choice(["en", "fr"]), "hot") for i in range(30)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return make_docs(spark, rows).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_fp(text):
    import xxhash

    w = re.findall(r"[^\x20\x09-\x0d]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("bucket", [16, 1])
def test_simhash(spark, docs, rows, empty, bucket):
    got = simhash.near_duplicates(docs, bucket=bucket).collect()
    fps = [brute_fp(t) for _, t, _, _ in rows]
    comp = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(len(rows)):
                if bin(fps[i] ^ fps[j]).count("1") <= 2:
                    comp[i] = comp[j] = min(comp[i], comp[j])
    assert any(fps[i] != fps[j] and comp[i] == comp[j] for i in range(len(rows)) for j in range(i))
    least = {c: min((rows[i][0] for i in range(len(rows)) if comp[i] == c and rows[i][0] is not None), default=None) for c in comp}
    want = sorted(((rows[i][0], fps[i], least[comp[i]]) for i in range(len(rows))), key=str)
    assert sorted(((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in got), key=str) == want
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(comp))


def test_pigeonhole_plans_cover_all_pairs():
    rng = np.random.default_rng(1)
    bits = rng.integers(0, 2, (500, 64)).astype(float)
    together = bits.T @ bits
    for n in (500, 10**7, 3 * 10**10):
        plan = simhash.plan(n, together * (n / 500), 2)
        assert sum(t + 1 for _, t in plan) == 3 and len({b for g, _ in plan for b in g}) == sum(len(g) for g, _ in plan)
    assert max(t for _, t in simhash.plan(3 * 10**10, together * (3e10 / 500), 2)) == 1


def test_wide_tolerance_finds_the_same_links(spark, monkeypatch):
    rng = random.Random(5)
    fps = {rng.getrandbits(64) for _ in range(40)}
    for f in list(fps)[:20]:
        fps |= {f ^ (1 << rng.randrange(64)), f ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    classes = common.stored(spark.createDataFrame([(f, 1) for f in signed], "fp long, n long"), "t")
    monkeypatch.setattr(simhash, "plan", lambda n, together, d: [(list(range(32)), 1), (list(range(32, 64)), 0)])
    from tagweave.llm.components import components

    for bucket in (16, 1):
        found = {(r["a"], r["b"]) for r in simhash.links(classes, bucket=bucket).collect()}
        assert all(bin((a ^ b) & (2**64 - 1)).count("1") <= 2 for a, b in found)
        roots = {r["node"]: r["root"] for r in components(spark.createDataFrame(list(found), "a long, b long")).collect()}
        for a in signed:
            for b in signed:
                if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= 2:
                    assert roots[a] == roots[b]


def test_components_of_a_chain_and_a_hub(spark):
    from tagweave.llm.components import components

    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 40)] + [(5, 5), (7, 6)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[1000 + i] == 1000 for i in range(40)) and len(got) == 101
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_repeats(rows, least):
    seen, order = {}, {}
    for i, t in sorted({(-1 if i is None else i, t or "") for i, t, _, _ in rows}):
        w = re.findall(r"[^\x20\x09-\x0d]+", t)
        order[i, t] = w
        for p in range(len(w) - least + 1):
            seen.setdefault(tuple(w[p : p + least]), []).append((i, p, t))
    marks = {}
    for places in seen.values():
        if len(places) > 1:
            for k, (i, p, t) in enumerate(sorted(places)):
                for q in range(p, p + least):
                    marks.setdefault((i, t), {}).setdefault(q, []).append(k == 0)
    out = {}
    for key, at in marks.items():
        out[key] = (sorted(at), sorted(q for q, firsts in at.items() if not any(firsts)))
    return out


def test_suffix_array(docs, rows, empty):
    want = {(i, tuple(w), tuple(g)) for (i, _), (w, g) in brute_repeats(rows, 50).items()}
    flat = lambda spans: tuple(q for x in spans for q in range(x["s"], x["e"]))
    got = {(-1 if r["doc_id"] is None else r["doc_id"], flat(r["spans"]), flat(r["removed"])) for r in suffixes.passages(docs).collect()}
    assert got == want
    assert suffixes.passages(empty).count() == 0
    cleaned = suffixes.without_repeats(docs)
    assert cleaned.columns == docs.columns
    left = {(r["doc_id"], r["text"], r["n_chars"]) for r in cleaned.collect()}
    assert 2 not in {i for i, _, _ in left} and all(n == len(t or "") for _, t, n in left)


def test_host_rules(docs, empty):
    got = {(r["doc_id"], r["n_words"]): r for r in host_rules.judge(docs).collect()}
    assert got[4, 0]["fail_base"] and not got[4, 0]["kept"] and got[11, 30000]["n_words"] == 30000
    assert got[12, 120]["n_repeat_words"] == 120 and got[12, 120]["fail_base"]
    assert got[1, 200]["kept"]
    assert host_rules.judge(empty).count() == 0


def test_host_verdict_reaches_documents(spark):
    bad = "x#$% " * 0 + " ".join(f"w{i}##{i * 7 % 97}" for i in range(80))
    good = " ".join(f"word{i * 13 % 997}" for i in range(80))
    rows = [(i, bad, "en", "bad") for i in range(40)] + [(100 + i, good + str(i), "en", "good") for i in range(60)] + [(300, good, "en", "bad")]
    kept = {r["doc_id"]: r["kept"] for r in host_rules.judge(make_docs(spark, rows)).collect()}
    assert not kept[300] and kept[100]


def test_language(spark, docs, empty):
    model = language.train(language.sample(docs))
    got = {r["doc_id"]: r for r in language.identify(docs, model).collect()}
    assert got[4]["lang_pred"] == got[5]["lang_pred"] == got[8]["lang_pred"] == "und" and got[8]["rejected"]
    assert 0 < got[1]["score"] <= 1 and got[1]["lang_pred"] in {"en", "fr", "de"}
    assert language.train(language.sample(empty)) is None
    assert {r["lang_pred"] for r in language.identify(docs, None).collect()} == {"und"}
    assert language.accepted(docs, model).columns == docs.columns


def test_superscripts_are_no_letters():
    for text, want in (("²³ 12 ½", False), ("²³ é", True), ("", False), ("x" * 3, True), ("1" * 200 + "z", True)):
        raw = np.frombuffer(text.encode(), np.uint8)
        assert language.has_letter(raw, 0, len(raw)) is want


def test_stages_keep_columns_whose_names_they_use_themselves(docs):
    clash = docs.withColumnsRenamed({"fp": "_id", "n_words": "_t", "kept": "_removed"})
    for stage in (simhash.one_of_each, suffixes.without_repeats):
        got, plain = stage(clash), stage(docs)
        assert got.columns == clash.columns and sorted(map(str, got.collect())) == sorted(str(r) for r in plain.toDF(*clash.columns).collect())


def small_model():
    return language.train([(("der und die " * 50).encode(), "de"), (("the and of " * 50).encode(), "en")] * 30)


def brute_language(text, model):
    """Mean of bucket scores, byte by byte."""
    raw = text.encode().lower() if text.isascii() else bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode())
    p = b" " + bytes(b + 32 if 128 <= b < 159 else b if b >= 128 or chr(b).isalpha() else 32 for b in raw) + b" "
    total, n, buckets = np.zeros(len(model.names) + 1), 0, len(model.table)
    for k in (2, 3, 4):
        for i in range(len(p) - k + 1):
            g = p[i : i + k]
            if 32 in g[1:-1] or g == b"  ":
                continue
            h = g[0]
            for x in g[1:]:
                h = (h * 0x01000193 % 2**32) ^ x
            h = (h + k) * 0x85EBCA6B % 2**32
            h ^= h >> 15
            total += model.table[h % buckets]
            n += 1
    x = (total[:-1] / max(n, 1) + model.bias) / model.temperature
    e = np.exp(x - x.max())
    mean, between, within = model.usual
    strange = (mean - total[-1] / max(n, 1)) / np.sqrt(between + within / min(max(n, 1), 150))
    return model.names[int(x.argmax())], float((e / e.sum()).max()), bool(strange <= model.limit)


def test_language_scores_against_brute_force():
    model = small_model()
    texts = ["the and of", "Der UND die", "", "x", "  a1b 22 the\u00e9 ", "of\tder", "\u00c9T\u00c9 qqq", "the and of " * 80]
    offsets = np.cumsum([0, *[len(t.encode()) for t in texts]])
    names, scores, ok = language.predict(offsets, np.frombuffer("".join(texts).encode(), np.uint8), model)
    for t, name, score, kept in zip(texts, names, scores, ok):
        want = brute_language(t, model)
        assert name == want[0] and abs(score - want[1]) < 1e-6 and kept == want[2], t


def tongue(rng, syllables):
    words = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(300)]
    return lambda n: " ".join(rng.choice(words) for _ in range(n))


def test_rejection_of_other_languages_and_shuffled_letters(spark):
    """Each kept row is one that the model accepts; known texts stay, of every length; a language that training never saw goes."""
    rng = random.Random(12)
    known = {"a": tongue(rng, ["the", "on", "er", "ti", "ha", "st"]), "b": tongue(rng, ["sch", "und", "ei", "er", "\u00fc", "ge"]), "c": tongue(rng, ["que", "os", "ci\u00f3n", "ar", "la", "do"])}
    other = tongue(rng, ["kk", "aa", "jo", "ye", "mpi", "vu"])
    rows = [(t(rng.randint(5, 200)).encode(), name) for name, t in known.items() for _ in range(300)]
    model = language.train(rows)
    assert 1e-4 < model.temperature < 100 and 0 < model.limit < 1e6
    mine = [t(rng.choice([8, 40, 400])) for t in known.values() for _ in range(100)]
    foreign = [other(60) for _ in range(100)] + ["\u0441\u044a\u0435\u0448\u044c \u0435\u0449\u0451 " * 9, "bcdfghjklm npqrstvwxz" * 9]
    shuffled = ["".join(rng.sample(t, len(t))) for t in mine[2:200:3] if len(t) > 200]
    texts = [*mine, *foreign, *shuffled, None, "", "12 34"]
    docs = make_docs(spark, [(i, t, None, None) for i, t in enumerate(texts)])
    kept = {r["doc_id"] for r in language.accepted(docs, model).collect()}
    assert kept == {i for i, t in enumerate(texts) if re.search("[^\\W\\d_]", t or "") and brute_language(t, model)[2]}
    assert {r["doc_id"] for r in language.identify(docs, model).filter("NOT rejected").collect()} == kept
    n = len(mine)
    assert sum(i in kept for i in range(n)) >= 0.99 * n
    assert sum(n <= i < n + len(foreign) for i in kept) <= 0.05 * len(foreign)
    assert sum(i >= n + len(foreign) for i in kept) <= 0.2 * len(shuffled)


@pytest.mark.parametrize("piece", [7, 64, 1000])
def test_language_of_pieces_equals_that_of_the_whole(monkeypatch, piece):
    model = small_model()
    text = b"the and of der \xc3\xa9 x  " * 300
    offsets, data = np.array([0, len(text)]), np.frombuffer(text, np.uint8)
    whole = language.predict(offsets, data, model)
    monkeypatch.setattr(language, "PIECE", piece)
    pieces = language.predict(offsets, data, model)
    assert whole[0] == pieces[0] and whole[1].tolist() == pieces[1].tolist()


def test_language_sample_is_bounded(spark):
    text = [f"the and of {i} " * 20 for i in range(400)]
    docs = make_docs(spark, [(None, t, "en", "a") for t in text] + [(None, "same row", "de", "a")] * 300)
    assert len(language.sample(docs)) == 401  # rows with null ids differ by their texts; equal rows count once
    assert 20 < len(language.sample(docs, language.Settings(per_language=60))) < 130
    rows = language.sample(docs, language.Settings(sample_bytes=40_000))
    assert 0 < sum(len(t) for t, _ in rows) < 40_000
    assert language.sample(docs, language.Settings(languages=1)) and {x for _, x in language.sample(docs, language.Settings(languages=1))} == {"en"}


def test_language_of_an_empty_table(empty):
    assert language.identify(empty, small_model()).count() == 0 and language.accepted(empty, small_model()).count() == 0
    assert language.identify(empty, None).count() == 0


@pytest.mark.parametrize("block", [4_000_000, 40])
def test_decontamination(spark, docs, rows, empty, block):
    w = rows[8][1].split()
    items = [(1, " ".join(w[5:40]).upper()), (2, "One, two!"), (3, ""), (4, None), (5, " ".join(w[35:50])), (None, " ".join(w[30:45]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    low = lambda t: re.findall(pattern, (t or "").translate({c: c + 32 for c in range(65, 91)}))
    grams = {}
    for i, t in items:
        x = low(t)
        for k in range(max(1, len(x) - 9) if x else 0):
            grams.setdefault(tuple(x[k : k + min(10, len(x))]), set()).add(i)
    want = []
    for i, t, _, _ in rows:
        x, hit, found = low(t), set(), set()
        for k in range(len(x)):
            for n in {len(g) for g in grams}:
                if k + n <= len(x) and tuple(x[k : k + n]) in grams:
                    hit |= set(range(k, k + n))
                    found |= grams[tuple(x[k : k + n])]
        want.append((i, len(x), sorted(hit), sorted(found, key=str)))
    got = [(r["doc_id"], r["n_words"], [q for s in r["spans"] for q in range(s["s"], s["e"])], sorted(r["items"], key=str)) for r in decontaminate.contamination(docs, bench, block_windows=block).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert decontaminate.contamination(empty, bench).count() == 0
    assert decontaminate.contamination(docs, bench.limit(0)).filter("size(spans) > 0").count() == 0
    assert decontaminate.clean(docs, bench, block_windows=block).count() == sum(not h for _, _, h, _ in want)


ODD = ["", " ", "a", "  two  spaces \n\n and\ttabs \r\n", "it's we'll 12a3 <|endoftext|> x'y  ", "é ü  x \x1c y", " lead", "don't. 'quoted' a1b2, ok!? end ", "日本語 テキスト, ok", "#tag $5.00 50%% x|y |", "ends in a line\n", "a \nb c\n d\u00a0e \u00a0f g", "   ", "a b ", " a", "x\u2028 y z\u3000", "é́ ñ ſt 𝔘x 👩‍👩‍👧 e\u0301x ١٢ ²x"]


def reference_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_tokenizer())
    t.encode_special_tokens = True
    return [np.array(e.ids, "<u4") for e in t.encode_batch(texts, add_special_tokens=False)]


def test_encoder_equals_the_library(rows, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE", 50)
    texts = ODD + [t or "" for _, t, _, _ in rows]
    got = tokens.Encoder.of(tokens.default_tokenizer()).encode(texts)
    for t, a, b in zip(texts, got, reference_ids(texts)):
        assert np.array_equal(np.frombuffer(a, "<u2"), b), t


def test_encoder_on_all_characters_and_on_random_texts(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE", 1000)
    rng = random.Random(5)
    every = [chr(i) for i in range(1, 1 << 16) if not 0xD800 <= i < 0xE000]
    texts = [f"a{x}b {x}{x} 1{x}\n{x}." for x in every]
    odd = [*"abZé' \n\t.,1½²٣ⅷ's\x1c\x85\u180e\u1680\u3000中ыß\U0001f600힣\u0301ª_-", *every[0x20:0x3000:37]]
    texts += ["".join(rng.choice(odd if rng.random() < 0.5 else "ab '\n s1.t") for _ in range(rng.randint(0, 25))) for _ in range(10_000)]
    coder = tokens.Encoder.of(tokens.default_tokenizer())
    assert coder.by_piece
    for t, a, b in zip(texts, coder.encode(texts), reference_ids(texts)):
        assert np.array_equal(np.frombuffer(a, "<u2"), b), repr(t)
    monkeypatch.setattr(coder, "by_piece", False)  # as for other kinds of tokenizers
    assert [np.frombuffer(x, "<u2").tolist() for x in coder.encode(ODD)] == [x.tolist() for x in reference_ids(ODD)]


def test_token_files(spark, docs, rows, empty):
    folder = common.new_path(spark, "t")
    tokens.write(docs, folder)
    got = sorted(((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in tokens.read(spark, folder).collect()))
    ids = reference_ids([t or "" for _, t, _, _ in rows])
    sums = sorted((zlib.crc32(np.append(x, 2).astype("<u4").tobytes()), len(x) + 1) for x in ids)
    assert sorted((c, n) for _, _, n, c in got) == sums and [s for s, *_ in got] == [0, *np.cumsum([n for _, _, n, _ in got])[:-1].tolist()]
    order = [i for _, i, _, _ in got]
    assert order[0] is None and order[1:] == sorted(order[1:])
    folder = common.new_path(spark, "t")
    assert tokens.write(empty, folder).count() == 0 and tokens.read(spark, folder).count() == 0


def test_sharding(spark, docs, empty):
    folder = common.new_path(spark, "map")
    got = sharding.shard(docs, 3, folder).collect()
    assert len(got) == docs.count()
    for s in range(3):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert sharding.shard(empty, 3).count() == 0


def test_shard_map_edit_moves_little(spark):
    folder = common.new_path(spark, "map")
    weights = spark.range(256).selectExpr("cast(id as int) as vslot", "cast(1000 + id % 7 as long) as bytes")
    from pyspark.sql import functions as F

    v1 = sharding.write_map(sharding.assign(weights.withColumn("shard", F.lit(None).cast("int")), 4), folder, 1)
    v2 = sharding.edit_map(v1, weights, 5, folder, 2)
    a, b = ({r["vslot"]: r["shard"] for r in v.collect()} for v in (v1, v2))
    moved = [k for k in a if a[k] != b[k]]
    assert all(b[k] == 4 for k in moved) and 45 <= len(moved) <= 55 and set(b.values()) == set(range(5))


def test_quality(spark, empty):
    rng = random.Random(1)
    good = [" ".join(rng.choice(["river", "stone", "walks", "under", "the"]) for _ in range(60)) for _ in range(60)]
    bad = [" ".join(rng.choice(["BUY!!", "$$$", "NOW###", "click"]) for _ in range(60)) for _ in range(60)]
    rows = [(i, t, "en", "a") for i, t in enumerate(good + bad)] + [(500, None, None, None), (501, "", None, None)]
    docs = make_docs(spark, rows)
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(120)] + [(500, None), (7, 0), (None, 1)], "doc_id long, quality int")
    got = {r["doc_id"]: r["score"] for r in quality.scored(docs, quality.train(*quality.sample(docs, labels))).collect()}
    assert np.mean([(got[i] > 0.5) == (i < 60) for i in range(120)]) > 0.95 and all(0 <= x <= 1 for x in got.values())
    assert {r["score"] for r in quality.scored(docs, quality.train(*quality.sample(docs, labels.limit(0)))).collect()} == {0.5}
    assert quality.scored(empty, None).count() == 0


def test_factorisation_identity():
    s = quality.Settings(buckets=64, factors=3)
    rng = np.random.default_rng(0)
    m = quality.Model(0.1, rng.normal(size=64), rng.normal(size=(64, 3)))
    data = np.frombuffer(b"a b a c d", np.uint8)
    (_, _, bucket, _, x), = quality.features(np.array([0, len(data)]), data, s)
    pairs = sum(float(m.factors[bucket[i]] @ m.factors[bucket[j]]) * x[i] * x[j] for i in range(len(x)) for j in range(i))
    assert abs(quality.raw_scores(np.array([0, len(data)]), data, m, s)[0] - (0.1 + float(m.linear[bucket] @ x) + pairs)) < 1e-9


def test_warc(spark):
    big, small = "<p>é</p>" * 30, "<p>x</p>"
    rows = [(1, "http://a/ b", big), (2, None, big), (3, "u", small), (4, "u", small), (5, "u", None), (6, "u", ""), (None, "n", "z" * 200), (7, "u", "y" * 5000)] + [(100 + i, f"u{i}", "c" * 300) for i in range(40)]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, digest string")
    folder = common.new_path(spark, "w")
    manifest = warc.write(pages, folder, roll_bytes=2000)
    assert manifest.count() > 4
    got = {r["page_id"]: r for r in warc.read(spark, folder).collect()}
    for i, _, html in rows:
        body = (html or "").encode()
        first = min((j for j, _, h in rows if h == html and j is not None), default=None)
        again = i is not None and len(body) >= 100 and first != i
        assert (got[i]["payload_bytes"], got[i]["payload_digest"], got[i]["record_type"], got[i]["refers_to"]) == (len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", first if again else None)
    folder2 = common.new_path(spark, "w")
    again = warc.write(pages, folder2, roll_bytes=2000)
    assert sorted(manifest.select("file", "sha256").collect()) == sorted(again.select("file", "sha256").collect())
    folder = common.new_path(spark, "w")
    assert warc.write(pages.limit(0), folder).count() == 0 and warc.read(spark, folder).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = common.table(spark, sf, "documents")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf), name)
        assert docs.columns == columns and 0.5 * n < docs.count() <= n
        n = docs.count()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).agg({"length": "sum"}).first()[0] > 0


def brute_sets(text):
    w = re.findall(r"[^\x20\x09-\x0d]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize("hubs", [1, 0])
def test_near_copies_of_five_words(spark, docs, rows, empty, hubs, monkeypatch):
    import corpus_pipeline

    rng = random.Random(11)
    text = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    more, line = [], text(12)
    for g in range(6):
        base = text(rng.randint(40, 300))
        for k in range(12):
            w = list(base)
            for _ in range(rng.randint(0, 1 + len(w) // 35)):
                w[rng.randrange(len(w))] = f"n{rng.randrange(4000)}"
            more.append((1000 + 20 * g + k, " ".join(w + line * (k % 2)), "en", "a"))
    all_rows = rows + more
    sets = [brute_sets(t) for _, t, _, _ in all_rows]
    comp = list(range(len(sets)))
    linked = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    for _ in range(len(sets)):
        was = list(comp)
        for i, j in linked:
            comp[i] = comp[j] = min(comp[i], comp[j])
        if was == comp:
            break
    last = lambda i: all_rows[i][0] if all_rows[i][0] is not None else 1 << 63
    want = {min(last(i) for i in range(len(sets)) if comp[i] == k) for k in comp}
    assert any(bin(brute_fp(all_rows[i][1]) ^ brute_fp(all_rows[j][1])).count("1") > 2 for i, j in linked)
    table = docs.union(make_docs(spark, more))
    if hubs:
        got = corpus_pipeline.drop_near_duplicates(spark, table, "")
    else:  # the exhaustive comparison alone finds the same
        links = near_copies.links
        monkeypatch.setattr(near_copies, "links", lambda *a, **k: links(*a, hubs=0, **k))
        got = near_copies.one_of_each(table)
    assert got.columns == table.columns
    assert sorted(1 << 63 if r["doc_id"] is None else r["doc_id"] for r in got.collect()) == sorted(want)
    assert near_copies.one_of_each(empty).count() == 0


def test_added_tokens_by_the_plain_library_call(spark, rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_tokenizer())
    texts = ["<|endoftext|>", "a <|endoftext|> b", "x<|endoftext|>y  ", "<|endoftext |> a b", "a b c", "b c <|endoftext|>\n<|endoftext|>"]
    texts += [x for x in ODD] + [x or "" for _, x, _, _ in rows]
    want = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    assert any(t.token_to_id("<|endoftext|>") in w for w in want)
    got = tokens.Encoder.of(tokens.default_tokenizer(), plain=True).encode(texts)
    assert [np.frombuffer(g, "<u2").tolist() for g in got] == want
    docs = make_docs(spark, [(i, x, "en", "a") for i, x in enumerate(texts)])
    folder = common.new_path(spark, "t")
    tokens.write(docs, folder)
    crc = lambda ids, end: zlib.crc32(np.array([*ids, end], "<u4").tobytes())
    assert {r["doc_id"]: r["ids_crc32"] for r in tokens.read(spark, folder).collect()} == {i: crc(w, 2) for i, w in enumerate(want)}
    packed = packing.pack(docs, length=1 << 20).collect()
    assert {r["doc_id"]: r["ids_crc32"] for r in packed} == {i: crc(w, 0) for i, w in enumerate(want)}
