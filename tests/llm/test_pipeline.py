"""The pipeline against a brute-force version, stage by stage, with nulls, repeated rows and columns of clashing names."""

import hashlib
import random
import re

import corpus_pipeline
from rillview.llm import language, simhash, tokenize

RNG = random.Random(3)
WORDS = {k: [f"{a}{b}" for a in stems for b in ends] for k, stems, ends in (("en", ("walk", "think", "house"), ("ing", "er", "s", "ly")), ("de", ("geh", "schön", "straß"), ("en", "er", "t", "heit")), ("fr", ("mang", "parl", "vérit"), ("er", "ons", "é", "eaux")))}
EXTRA = "score double, lang_pred string, the_text string, the_spans string, s_id long, the_id long, k0 string, h long"


def passage(lang, n):
    return " ".join(RNG.choice(WORDS[lang]) for _ in range(n))


SHARED = passage("en", 70)
ITEM = passage("en", 14)
BODIES = [(passage(k, RNG.randrange(20, 120)), k) for k in ["en", "de", "fr"] * 10]
BODIES += [(None, "en"), ("", "de"), ("123 456 ...", "fr"), (BODIES[0][0], "en"), (BODIES[4][0], "de"), (BODIES[1][0] + " ", None)]
BODIES += [(passage("en", 40) + " " + SHARED + " " + passage("en", 30), "en"), (SHARED + "\n" + passage("en", 45), "en"), (passage("fr", 50) + SHARED, None)]
BODIES += [(passage("de", 30) + " " + ITEM + " " + passage("de", 20), "de"), ("é" + "ñ" * 80 + " x", "fr"), ("ã" + "ñ" * 80 + " y", "fr"), ("漢字" * 3000, "zh")]
ROWS = [(i, t, k, "s", len(t or "")) for i, (t, k) in enumerate(BODIES)]
ROWS += [ROWS[3], (None, passage("fr", 33), "fr", "s", None)]


def letters_only(rows, model):
    return [r for r in rows if model.predict(r[1])[0] != language.UND]


def one_of_each(rows):
    fp = [simhash.fingerprint(simhash.shingle_hashes(r[1])) for r in rows]
    group = list(range(len(rows)))
    for _ in rows:
        for a in range(len(rows)):
            group[a] = min(group[b] for b in range(len(rows)) if ((fp[a] ^ fp[b]) & (1 << 64) - 1).bit_count() <= 2)
    best = {}
    for g, r in zip(group, rows, strict=True):
        if r[0] is not None and (g not in best or r[0] < best[g][0]):
            best[g] = r
    return [*best.values(), *(r for r in rows if r[0] is None)]


def without_repeats(rows):
    seen, out = set(), []
    for r in sorted(rows, key=lambda r: -1 if r[0] is None else r[0]):
        b = r[1].encode()
        hit = bytearray(len(b))
        for s in range(len(b) - 99):
            if b[s : s + 100] in seen:
                hit[s : s + 100] = b"\1" * 100
            seen.add(b[s : s + 100])
        text = "".join(b[m.start() : m.end()].decode("utf-8", "ignore") for m in re.finditer(b"\0+", bytes(hit)))
        if not any(hit):
            out.append(r)
        elif text.strip():
            out.append((r[0], text, *r[2:4], len(text)))
    return out


def clean(rows, items):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(low))
    windows = {tuple(w[s : s + 10]) for t in items if (w := words(t)) for s in range(max(1, len(w) - 9))}
    sizes = {len(w) for w in windows}
    return [r for r in rows if not any(tuple(w[s : s + n]) in windows for w in [words(r[1])] for n in sizes for s in range(len(w) - n + 1))]


def test_stages_and_run(spark, tmp_path):
    from tokenizers import Tokenizer

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(*r, 0.5, "x", "t", "s", 7, 8, "k", 9) for r in ROWS], f"{schema}, {EXTRA}")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    items = [(1, ITEM.upper()), (2, None), (3, "no such words")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    model = language.fit(docs.filter(~language.held_out(docs["doc_id"])))
    want = [letters_only(ROWS, model)]
    want.append(one_of_each(want[0]))
    want.append(without_repeats(want[1]))
    want.append(clean(want[2], [t for _, t in items]))
    key = lambda r: (-1 if r[0] is None else r[0], r[1])
    now = docs
    for (name, stage), expected in zip(corpus_pipeline.STAGES[:-1], want, strict=True):
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns, name
        now.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        assert sorted((tuple(r)[:5] for r in now.collect()), key=key) == sorted(expected, key=key), name
        assert {tuple(r)[5:] for r in now.collect()} == {(0.5, "x", "t", "s", 7, 8, "k", 9)}
    assert len(ROWS) > len(want[0]) > len(want[1]) > len(want[3]) and want[2] != want[1]
    lib = Tokenizer.from_file(tokenize.default_vocabulary())
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    last = {}
    for r in want[3]:
        ids = lib.encode(r[1], add_special_tokens=False).ids
        last[r[0]] = (len(ids), digest(",".join(map(str, ids))), digest(lib.decode(ids, skip_special_tokens=False)), ids)
    assert {r[0]: tuple(r)[1:] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == last


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_an_id_with_several_texts(spark):
    """Of an id's texts each group keeps its own; the choice does not depend on the order of rows."""
    a, b = passage("en", 50), passage("de", 50)
    docs = spark.createDataFrame([(5, a), (5, b), (3, b), (7, a), (7, a)], "doc_id long, text string")
    for n in (1, 4):
        assert sorted(map(tuple, simhash.one_of_each(docs.repartition(n)).collect())) == [(3, b), (5, a)]
