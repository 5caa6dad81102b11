"""Groups of similar texts against brute force over all pairs."""

import random

import corpus_pipeline
from rillview.llm import similar, simhash

RNG = random.Random(5)
VOCABULARY = [f"w{i}" for i in range(3000)]


def passage(n):
    return [RNG.choice(VOCABULARY) for _ in range(n)]


def changed(words, n):
    out = list(words)
    for at in RNG.sample(range(len(words)), n):
        out[at] = RNG.choice(VOCABULARY)
    return out


def bit_distance(a, b):
    return ((simhash.fingerprint(simhash.shingle_hashes(a)) ^ simhash.fingerprint(simhash.shingle_hashes(b))) & (1 << 64) - 1).bit_count()


def test_one_replaced_word(spark):
    """Beyond two bits of the 3-word fingerprint, but alike."""
    own = passage(112)
    other = next(t for t in (" ".join(changed(own, 1)) for _ in range(100)) if bit_distance(" ".join(own), t) > 2)
    docs = spark.createDataFrame([(9, other), (4, " ".join(own)), (5, " ".join(passage(112)))], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.one_of_each_group(spark, docs, "").collect()) == [4, 5]


def test_parities_refuse_no_alike_pair():
    import numpy as np

    refused = 0
    for _ in range(300):
        own = passage(RNG.randrange(5, 400))
        a, b = (similar.shingle_set(" ".join(t), 5) for t in (own, changed(own, RNG.randrange(1 + len(own) // 8))))
        fits = similar.possible([similar.parities(a)], [similar.parities(b)], np.array([len(a) + len(b)]), 0.8)[0]
        assert fits or not similar.alike(frozenset(a.tolist()), frozenset(b.tolist()), 0.8)
        refused += not fits
    assert refused


def test_all_pairs(spark):
    common, crowd = passage(30), passage(60)
    texts = [changed(crowd, RNG.randrange(3)) for _ in range(60)]  # alike only through others, in part
    texts += [[*passage(RNG.randrange(20, 60)), *common] for _ in range(40)]  # one passage in unlike texts
    for _ in range(30):
        own = passage(RNG.randrange(3, 90))
        texts += [own, changed(own, min(len(own), RNG.randrange(4))), own[: RNG.randrange(1, len(own) + 1)]]
    texts = [" ".join(t) for t in texts] + ["", " ", texts[0][0], " ".join(texts[0]).upper(), " ".join(texts[0])]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[3]), (900, None)]
    sets = [frozenset(similar.shingle_set(t, 5).tolist()) for _, t in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and group[a] != group[b]:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    want = sorted({g: min(i for (i, _), h in zip(rows, group, strict=True) if h == g and i is not None) for g in group}.values())
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [r["doc_id"] for r in simhash.one_of_each(docs, 5, 0.8).collect()]
    assert None in kept and sorted(i for i in kept if i is not None) == want
    hashes = dict(spark.createDataFrame(enumerate(t for _, t in rows), "i long, text string").selectExpr("i", "xxhash64(text)").collect())
    for crowd_size, block in ((1, 4096), (1000, 4096), (1, 7)):
        of = {}
        for r in simhash.components(similar.similar_links(docs, crowd=crowd_size, block=block)).collect():
            of[r["node"]] = r["root"]
        roots = [of.get(hashes[i], hashes[i]) for i in range(len(rows))]
        assert len(set(zip(roots, group, strict=True))) == len(set(group)) == len(set(roots))
    assert similar.similar_links(docs.limit(0)).count() == 0


def test_ball_links_equal_all_pairs(spark):
    fps = {RNG.getrandbits(64) for _ in range(60)}
    for fp in sorted(fps):
        fps.add(fp ^ sum(1 << b for b in RNG.sample(range(64), RNG.randrange(9))))
    signed = {fp - (1 << 64) if fp >> 63 else fp: fp for fp in fps}
    table = spark.createDataFrame([(fp,) for fp in signed], "fp long")
    for radius in (2, 5):
        want = {(u, v) for u in signed for v in signed if u > v and (signed[u] ^ signed[v]).bit_count() <= radius}
        assert len(want) > 10 and set(map(tuple, simhash.ball_links(table, radius).collect())) == want


def test_fingerprints_give_pairs(spark, monkeypatch):
    """The stage takes pairs from ball hashing; those beyond its radius are found as well."""
    texts, given = [], []
    for _ in range(40):
        own = passage(300)
        texts += [" ".join(own), " ".join(changed(own, 1))]
    texts += [texts[0].upper(), texts[0] + " "]
    plain = similar.near_pairs

    def seen(*args):
        out = plain(*args)
        given.extend((r["u"], r["v"]) for r in out.collect())
        return out

    monkeypatch.setattr(similar, "near_pairs", seen)
    docs = spark.createDataFrame(enumerate(texts), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.one_of_each_group(spark, docs, "").collect()) == list(range(0, 80, 2))
    fp = {r["node"]: r["fp"] for r in similar.sketched(docs.selectExpr("xxhash64(text) AS node", "text"), 5).collect()}
    assert 10 < len(given) and all(u > v and ((fp[u] ^ fp[v]) & (1 << 64) - 1).bit_count() <= similar.RADIUS for u, v in given)
