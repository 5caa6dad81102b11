"""Each operator against brute force on small tables with nulls, empty texts, ties, repeated rows and clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from rillview.llm import decontaminate, language, language_model, licenses, neighbours, quality, simhash, suffixes, tokenize, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, score double, fp long, w string"
RNG = random.Random(1)
WORDS = ["the", "River", "house", "ñandú", "straße", "one", "two", "GREEN", "x1", "walks", "under", "sky"]


def passage(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


SHARED = passage(60)
TEXTS = [passage(RNG.randrange(1, 150)) for _ in range(30)]
TEXTS += [None, "", " ", "...", TEXTS[0], TEXTS[0], TEXTS[1] + " end", passage(20) + " " + SHARED, SHARED + "\n" + passage(5), "a" * 1000, "ab " * 300, "x" * 99, "İstanbul " + passage(12)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "de", "fr"][i % 3], "s", 1.0, 2, "c") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, (None, SHARED, None, None, None, None, None)], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_suffixes(docs, none):
    seen, want = set(), {}
    for i, t in [(None, SHARED), *enumerate(TEXTS)]:
        b = (t or "").encode()
        hit = bytearray(len(b))
        for s in range(len(b) - 99):
            if b[s : s + 100] in seen:
                hit[s : s + 100] = b"\1" * 100
            seen.add(b[s : s + 100])
        kept = bytes(x for x, h in zip(b, hit, strict=True) if not h)
        want[i] = (len(b), sum(hit), len(re.findall(b"\1+", bytes(hit))), hashlib.sha256(kept).hexdigest())
    for crowd in (2000, 1):
        assert {r[0]: tuple(r)[1:] for r in suffixes.remove_repeats(docs, crowd).collect()} == want
    assert suffixes.remove_repeats(none).count() == 0
    kept = suffixes.without_repeats(docs)
    assert kept.columns == docs.columns and kept.count() < docs.count()
    twice = suffixes.remove_repeats(docs.union(docs)).collect()
    assert len(twice) == 2 * docs.count() and all(tuple(r)[1:] == want[r[0]] for r in twice)


def test_contamination(spark, docs, none):
    items = [(1, " ".join(SHARED.split()[5:20]).upper()), (2, "GREEN sky"), (3, None), (4, "!!"), (None, SHARED), (1, " ".join(SHARED.split()[5:20])), (12, SHARED)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(low))
    windows = {}
    for i, t in items:
        w = words(t)
        for s in range(len(w) - min(10, len(w)) + 1) if w and i is not None else ():
            windows.setdefault(tuple(w[s : s + 10]), set()).add(str(i))
    want = {}
    for i, t in [(None, SHARED), *enumerate(TEXTS)]:
        w, hit, own = words(t), set(), set()
        for n in {len(k) for k in windows}:
            for s in range(len(w) - n + 1):
                if (k := tuple(w[s : s + n])) in windows:
                    hit.update(range(s, s + n))
                    own |= windows[k]
        want[i] = (len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), bool(hit))
    for most in (100_000, 0):
        assert {r[0]: tuple(r)[1:6] for r in decontaminate.contamination(docs, bench, most).collect()} == want
    assert decontaminate.contamination(docs, bench.limit(0)).filter("contaminated").count() == 0
    assert decontaminate.contamination(none, bench).count() == 0
    assert decontaminate.clean_documents(docs, bench).count() == sum(not x[4] for x in want.values())


def test_simhash(docs, none):
    got = simhash.near_duplicates(docs).collect()
    prints = {}
    for i, t in [(None, SHARED), *enumerate(TEXTS)]:
        h = [x % (1 << 64) for x in simhash.shingle_hashes(t)]
        prints[i] = sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))
    assert {r[0]: int(r[1], 16) for r in got} == prints
    root = {i: i for i in prints}
    for _ in prints:
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 2:
                    best = min((x for x in (root[a], root[b]) if x is not None), default=None)
                    root[a] = root[b] = best
    assert {r[0]: r[2] for r in got} == root
    assert simhash.near_duplicates(none).count() == 0
    assert simhash.one_of_each(docs).columns == docs.columns


def test_chains_of_links(spark):
    chain = [0]
    for b in range(40):
        chain.append(chain[-1] ^ (1 << b))
    edges = simhash.links(spark.createDataFrame([(x,) for x in chain], "fp long"))
    found = simhash.components(edges).collect()
    assert {r["root"] for r in found} == {0} and len(found) == 40


def test_tokenize(docs, none):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokenize.default_vocabulary())
    for r in tokenize.encode_documents(docs, full=True, leaf=64).collect():
        text = SHARED if r["doc_id"] is None else TEXTS[r["doc_id"]] or ""
        ids = lib.encode(text, add_special_tokens=False).ids
        assert r["ids"] == ids and r["decoded"] == lib.decode(ids, skip_special_tokens=False) and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    parts = ["a", "the", " ", "  ", "\n", "\t", "é", "x" * 30, "123", "!!", "<|endoftext|>", "<|", "endoftext", "|>", "'", "re", "'s", "\x85", "漢字", "、", "👍🏽", "\r\n", "ab" * 40, " word"]
    for leaf in (3, 16, 40):
        own = tokenize.Bpe(tokenize.default_vocabulary(), leaf)
        for _ in range(300):
            t = "".join(RNG.choice(parts) for _ in range(RNG.randrange(30)))
            assert own.encode(t) == lib.encode(t, add_special_tokens=False).ids
        assert own.joined > 300 and own.unsplit
    assert tokenize.encode_documents(none).count() == 0


def test_tokenize_joins_ordinary_and_unsplit_texts(spark):
    """Texts beyond a leaf come through joins, each exact; halves of long text without a sure cut too."""
    from tokenizers import Tokenizer

    lib, own = Tokenizer.from_file(tokenize.default_vocabulary()), tokenize.Bpe(tokenize.default_vocabulary())
    for n, text in enumerate([passage(400), passage(3000), passage(2) + "z" * 5000 + " " * 3000 + "q", "漢字かな、" * 1500, "".join(RNG.choice("abcdef") for _ in range(6000)), "1" * 4000 + "ab" * 3000]):
        before = own.joined
        ids = own.encode(text)
        assert own.joined > before and ids == lib.encode(text, add_special_tokens=False).ids and own.decode(ids) == text
        assert bool(own.unsplit) == (n > 1)
    many = "".join(RNG.choice([" a", "b", " the", "c\n"]) for _ in range(60_000))  # leaves of several threads
    assert own.encode(many) == lib.encode(many, add_special_tokens=False).ids
    docs = spark.createDataFrame([(1, "a b", 7, "x"), (1, "a b", 7, "x"), (2, None, None, None)], "doc_id long, text string, ids long, decoded string")
    got = sorted(map(tuple, tokenize.encode_documents(docs, full=True).select("doc_id", "n_tokens", "ids", "decoded").collect()))
    want = lib.encode("a b").ids
    assert got == [(1, 2, want, "a b"), (1, 2, want, "a b"), (2, 0, [], "")]


def test_encoders_cut_all_characters_alike():
    """The faster encoder of leaves and the library have one notion of letters, digits and white space."""
    import sys
    import unicodedata

    from tokenizers import Tokenizer

    lib, own = Tokenizer.from_file(tokenize.default_vocabulary()), tokenize.Bpe(tokenize.default_vocabulary())
    points = [c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) not in ("Cs", "Cn", "Co") and not 0xAC00 < c < 0xD7A3 and not 0x4E00 < c < 0x9FA5]
    for i in range(0, len(points), 4000):
        text = "\n".join("a%c1%c!%c a" % (c, c, c) for c in points[i : i + 4000])
        assert lib.encode(text, add_special_tokens=False).ids == own.ranked.encode_ordinary(text)


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((400, 8)) * rng.uniform(0.5, 2, (400, 1))
    x[40:140] = x[40]  # a group of copies
    rows = [(i, v.tolist(), 0.0) for i, v in enumerate(x)] + [(1000, None, 0.0), (1020, [0.0] * 8, 0.0), (1040, [float("nan")] * 8, 0.0), (1060, [1.0], 0.0), (None, [1.0] * 8, 0.0), (5, x[5].tolist(), 0.0)]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>, score double"), cell_rows=100, query_rows=7).collect()
    found = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    hits = 0
    for q in range(0, 400, 20):
        s = x @ x[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(400), -s))[:20]
        hits += len({int(i) for i in best} & {i for i, _ in found[q]})
        assert all(abs(v - float(x[i] @ x[q])) < 1e-9 for i, v in found[q])
    assert set(found) == set(range(0, 400, 20)) and hits >= 0.9 * 400
    assert neighbours.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_neighbours_prune_clustered_vectors(spark):
    """The stop fires: far fewer than half of all pairs are verified, within cells and by leaving cells out, at a recall of 0.9 or more."""
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((60, 24))
    x = centres[rng.integers(0, 60, 6000)] + 0.3 * rng.standard_normal((6000, 24))
    x[:2000] = centres[0] + 0.01 * rng.standard_normal((2000, 24))  # a third of all in one group
    got = neighbours.nearest(spark.createDataFrame(((i, v.tolist()) for i, v in enumerate(x)), "vec_id long, embedding array<double>"), cell_rows=500, query_rows=100).collect()
    hits, verified = 0, {r["query_id"]: r["verified"] for r in got}
    for q in range(0, 6000, 20):
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(set(np.argsort(-s)[:20].tolist()) & {r["vec_id"] for r in got if r["query_id"] == q})
    assert len(verified) == 300 and hits >= 0.9 * 300 * 20
    assert sum(verified.values()) < 0.35 * 300 * 6000


def test_language(spark, none):
    made = {"en": ["the", "thing", "with"], "de": ["der", "schon", "pflicht"], "fr": ["eau", "oui", "chez"]}
    rows = [(i, " ".join(RNG.choice(made[k]) for _ in range(8)), k) for i, k in enumerate(["en", "de", "fr"] * 40)] + [(900, None, "en"), (901, "123 ... ½ ²", "de"), (902, "the thing", None)]
    got = {r["doc_id"]: r for r in language.detect_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got[900]["lang_pred"] == got[901]["lang_pred"] == "und" and got[902]["lang_pred"] == "en"
    assert all(got[i]["lang_pred"] == k for i, _, k in rows[:120]) and all(0 <= r["score"] <= 1 for r in got.values())
    assert got[3]["held_out"] == (zlib.crc32(b"3") % 4 == 2)
    assert language.detect_languages(none).count() == 0


def test_scores(spark, docs, none):
    rows = [(i, passage(40) + (" you moron" if i % 4 == 0 else "") + ("!!! ### " * 20 if i % 3 == 0 else "")) for i in range(300)] + [(None, "moron"), (999, None), (998, "")]
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 != 0), int(i % 4 == 0)) for i in range(300)] + [(None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    tox = {r["doc_id"]: r for r in toxicity.toxic_spans(texts, labels).collect()}
    assert all(tox[i]["predicted"] == (i % 4 == 0) for i in range(300)) and tox[999]["predicted"] == 0 and len(tox) == 303
    t = dict(rows)[4]
    assert "moron" in [t[s["start"] : s["end"]] for s in tox[4]["spans"]]
    good = {r["doc_id"]: r for r in quality.quality_scores(texts, labels).collect()}
    assert np.mean([good[i]["predicted"] == (i % 3 != 0) for i in range(300)]) > 0.97 and all(0 <= r["score"] <= 1 for r in good.values())
    assert toxicity.toxic_spans(docs, labels.limit(0)).count() == docs.count() == quality.quality_scores(docs, labels.limit(0)).count()
    assert toxicity.toxic_spans(none, labels).count() == 0 == quality.quality_scores(none, labels).count()


def test_forward_backward_is_exact():
    rng = np.random.default_rng(0)
    s, a, starts = rng.standard_normal(1300), np.array([[1.0, 0.3], [0.5, 2.0]]), np.array([0, 3, 700])
    p, _, _ = toxicity.forward_backward(s, starts, a)
    for lo, hi in ((0, 3), (3, 700), (700, 1300)):
        e = np.stack([np.ones(hi - lo), np.exp(s[lo:hi])], 1)
        f, b = [e[0] / e[0].sum()], [np.ones(2)]
        for t in range(1, hi - lo):
            v = e[t] * (f[-1] @ a)
            f.append(v / v.sum())
            w = a @ (e[hi - lo - t] * b[0])
            b.insert(0, w / w.sum())
        m = np.array(f) * np.array(b)
        assert np.allclose(p[lo:hi], m[:, 1] / m.sum(1))


def test_language_model(spark, docs, none):
    from collections import Counter

    got = {r["doc_id"]: r for r in language_model.log_likelihoods(docs, listed=8, model_words=6).collect()}
    texts = {None: SHARED, **dict(enumerate(TEXTS))}
    cut = {i: [*(t or "").encode().lower().split(), None] for i, t in texts.items()}
    out = {i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2 for i in texts}
    c = Counter(w for i, ws in cut.items() if not out[i] for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in cut.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (out[i], len(ws), sum(c[w] > 0 for w in ws), n)
        assert abs(r["base_score"] - sum(np.log10((c[w] + 1) / (n + v + 1)) for w in ws)) < 1e-6 and r["score"] < 0
    assert language_model.log_likelihoods(none).count() == 0


def test_network_sums_to_one():
    net = language_model.Gru(100)
    h = np.random.default_rng(1).standard_normal((1, 16)).astype(np.float32)
    total = sum(np.exp(net.log_probs(h, np.array([w]))[0]) for w in range(100))
    assert abs(total - 1) < 1e-3
    long = np.append(np.random.default_rng(2).integers(2, 90, 200), language_model.END)
    assert abs(net.score([long])[0] - net.score([long, np.array([language_model.END])])[0]) < 1e-3


def test_licenses(spark, none):
    mit = dict(licenses.TEMPLATES)["MIT"]
    rows = [(1, passage(30) + "\nReleased under the MIT License.\n" + passage(9)), (2, mit.upper()), (3, None), (4, "word"), (5, mit + " " + passage(400)), (1, "All rights reserved")]
    got = sorted(tuple(r) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).fillna("-").collect())
    assert got == [(1, "MIT", 1.0, "MIT"), (1, "all-rights-reserved", 1.0, "all-rights-reserved"), (2, "MIT", 1.0, "MIT"), (3, "-", 0.0, ""), (4, "-", 0.0, ""), (5, "-", 0.0, "")]
    assert licenses.scan(none).count() == 0


def test_licences_found_ties_and_repeated_rows(spark):
    of = {}
    for name, text in licenses.TEMPLATES:
        of.setdefault(name, []).append(text)
    zlib_notice, bsd = of["Zlib"][0], max(of["BSD-3-Clause"], key=len)
    long = passage(3000) + "\n\n" + zlib_notice + "\n\n" + passage(3000)
    rows = [(1, long, 0.1, "n"), (2, "All rights reserved. " + of["MIT"][0], 0.1, "n"), (3, bsd, 0.1, "n"), (3, bsd, 0.1, "n"), (None, of["CC0-1.0"][0], None, None)]
    got = sorted((tuple(r) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, dice double, name string")).collect()), key=str)
    assert [r[1] for r in got if r[0] == 1] == ["Zlib"] and [r[1] for r in got if r[0] is None] == ["CC0-1.0"]
    threes = [r for r in got if r[0] == 3]
    assert len(threes) == 2 and threes[0] == threes[1] and threes[0][1:3] == ("BSD-3-Clause", 1.0)
    # a tie goes to the licence whose name comes first
    tied = licenses.scan(spark.createDataFrame([(1, "one two three")], "doc_id long, text string"), 0.8, [("b", "one two three"), ("a", "one two three")]).first()
    assert (tied["license"], tied["licenses"]) == ("a", "a,b")


@pytest.mark.parametrize("threshold", [0.3, 0.55, 0.8, 1.0])
def test_units_that_match_a_license_hold_a_telling_word(threshold):
    rng = random.Random(5)
    words = licenses.telling_words(threshold, licenses.TEMPLATES)
    matched = 0
    for _, text in licenses.TEMPLATES:
        own = set(licenses.bigrams(text))
        for _ in range(40):
            w, bad = re.findall("[A-Za-z0-9]+", text), set(rng.sample(words, rng.randrange(len(words) + 1)))
            share = rng.random() * 0.4
            unit = " ".join("zzz" if rng.random() < share or any(x in v.lower() for x in bad) else v for v in w)
            grams = set(licenses.bigrams(unit))
            if grams and 2 * len(grams & own) / (len(grams) + len(own)) >= threshold:
                matched += 1
                assert any(x in unit.lower() for x in words)
    assert matched > 20


def test_texts_without_telling_words_are_not_cut_into_grams(spark):
    assert licenses.telling_words(0.8, []) == [] and licenses.telling_words(0.8, [("a", "one two")]) in (["one"], ["two"])
    docs = spark.createDataFrame([(1, "no words of that kind " * 50), (2, "x\nALL RIGHTS RESERVED"), (3, None)], "doc_id long, text string")
    assert sorted((r["doc_id"], r["license"]) for r in licenses.scan(docs).collect()) == [(1, None), (2, "all-rights-reserved"), (3, None)]
    plan = licenses.scan(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "contains" in plan.lower()[plan.lower().index("generate") :]



def test_repeated_rows_and_clashing_names(spark):
    """Each row gets its result, the same for repeated rows, whatever else the table holds."""
    text = passage(50)
    docs = spark.createDataFrame([(1, text, "en", "x", 0.5, 3, "w")] * 3 + [(2, passage(40), "de", None, None, None, None)], SCHEMA)
    for rows in (toxicity.toxic_spans(docs, docs.selectExpr("doc_id", "1 AS toxic", "1 AS quality")), quality.quality_scores(docs, docs.selectExpr("doc_id", "1 AS quality", "1 AS toxic")), language.detect_languages(docs), language_model.log_likelihoods(docs), tokenize.encode_documents(docs), suffixes.remove_repeats(docs)):
        got = [tuple(map(str, r)) for r in rows.collect()]
        assert len(got) == 4 and len({r for r in got if r[0] == "1"}) == 1
