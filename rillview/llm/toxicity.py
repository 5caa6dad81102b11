"""Toxicity by a linear-chain conditional random field over words.

Labelled tokens come from labelled documents: from a bounded sample of learning rows, a cover of marker features (whole
words or prefixes that stand in toxic and hardly in other texts) is chosen greedily, and a word of a toxic text that
carries a marker is labelled 1; the fewer toxic texts a feature stands in, the surer it must be. A chain of two states is fitted to these labels by gradient ascent on the conditional
likelihood. Forward-backward gives every word of every text its marginal; a logistic function of aggregates of a text's marginals (highest, sum, mean),
corrected to the share of toxic rows among all learning rows, is its score, and words at or over 0.5 are its
spans.

The chain's messages are ratios that pass through 2x2 matrices, so texts of a batch are laid end to end with resets and
scanned in blocks: products within all blocks at once, then over the blocks, then within again (exact, no cut of texts).

Defined cases: null, empty and wordless texts get the score of a text whose marginals are all zero; without a toxic
learning row all scores are 0; without another learning row the same; a doc_id labelled more than once is toxic if any of
its labels is; rows with null ids are scored, never learned from; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillview.llm.common import chunks, fold

WORD = re.compile(r"\w+")
BLOCK = 512
REMEMBERED = 200_000
PREFIXES = (4, 5, 6, 7, 8)


def word_features(word: str) -> list[str]:
    w = word.lower()
    return ["=" + w, *["^" + w[:n] for n in PREFIXES if len(w) > n]]


def messages(s: np.ndarray, reset: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Log ratio of state 1 to state 0 after each position. a[y, y2]: potential of y followed by y2; reset: a chain starts here."""
    n = len(s)
    if not n:
        return np.zeros(0)
    blocks = -(-n // BLOCK)
    pad = blocks * BLOCK - n
    e = np.exp(np.clip(np.pad(s, (0, pad)), -30, 30)).reshape(blocks, BLOCK).T.copy()
    r = np.pad(reset, (0, pad), constant_values=True).reshape(blocks, BLOCK).T.copy()
    p11, p10 = np.ones(blocks), np.zeros(blocks)  # rows: where state 1 comes from
    p01, p00 = np.zeros(blocks), np.ones(blocks)
    for t in range(BLOCK):
        n11, n10 = e[t] * (a[1, 1] * p11 + a[0, 1] * p01), e[t] * (a[1, 1] * p10 + a[0, 1] * p00)
        n01, n00 = a[1, 0] * p11 + a[0, 0] * p01, a[1, 0] * p10 + a[0, 0] * p00
        if r[t].any():
            n11, n10, n01, n00 = np.where(r[t], 0, n11), np.where(r[t], e[t], n10), np.where(r[t], 0, n01), np.where(r[t], 1, n00)
        norm = 1 / np.maximum(np.maximum(n11, n10), np.maximum(n01, n00))
        p11, p10, p01, p00 = n11 * norm, n10 * norm, n01 * norm, n00 * norm
    ahead = np.empty((2, blocks))
    v1, v0 = 0.5, 0.5
    for b, (x11, x10, x01, x00) in enumerate(zip(p11.tolist(), p10.tolist(), p01.tolist(), p00.tolist(), strict=True)):
        ahead[0, b], ahead[1, b] = v1, v0
        v1, v0 = x11 * v1 + x10 * v0, x01 * v1 + x00 * v0
        v1, v0 = v1 / (v1 + v0), v0 / (v1 + v0)
    v1, v0 = ahead
    out = np.empty((BLOCK, blocks))
    for t in range(BLOCK):
        n1, n0 = np.where(r[t], e[t], e[t] * (a[1, 1] * v1 + a[0, 1] * v0)), np.where(r[t], 1, a[1, 0] * v1 + a[0, 0] * v0)
        v1, v0 = n1 / (n1 + n0), n0 / (n1 + n0)
        out[t] = v1
    out = np.clip(out.T.reshape(-1)[:n], 1e-300, 1 - 1e-16)
    return np.log(out) - np.log1p(-out)


def forward_backward(s: np.ndarray, starts: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of state 1, and the messages forwards and backwards (both hold the position's own evidence)."""
    first = np.zeros(len(s), bool)
    first[starts] = True
    last = np.roll(first, -1)
    if len(s):
        last[-1] = True
    f = messages(s, first, a)
    b = messages(s[::-1], last[::-1], a.T)[::-1]
    return 1 / (1 + np.exp(-np.clip(f + b - s, -500, 500))), f, b


class Memory(dict):
    """word -> row in `rows`: the word's evidence as itself, as the word before, as the word after."""

    def __init__(self, weights: dict[str, tuple[float, float, float]]):
        super().__init__()
        self.weights, self.rows = weights, []

    def __missing__(self, word: str) -> int:
        here = before = after = 0.0
        for i, f in enumerate(word_features(word)):
            if w := self.weights.get(f):
                here += w[0]
                if i == 0:
                    before, after = w[1], w[2]
        self[word] = len(self.rows)
        self.rows.append((here, before, after))
        return len(self.rows) - 1


def _starts(texts: list[list[str]]) -> np.ndarray:
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    return (np.cumsum(sizes) - sizes)[sizes > 0]


class Chain:
    def __init__(self, weights: dict[str, tuple[float, float, float]], bias: float, a: np.ndarray):
        self.weights, self.bias, self.a = weights, bias, a
        self.coef = np.zeros(4)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "memory"}

    def marginals(self, texts: list[list[str]]) -> np.ndarray:
        if len(getattr(self, "memory", ())) > REMEMBERED or not hasattr(self, "memory"):
            self.memory = Memory(self.weights)
        ids = np.fromiter((self.memory[w] for t in texts for w in t), np.int64)
        if not len(ids):
            return np.zeros(0)
        rows = np.array(self.memory.rows)[ids]
        starts = _starts(texts)
        inner = np.ones(len(ids), bool)
        inner[starts] = False
        s = rows[:, 0] + self.bias
        s[1:] += np.where(inner[1:], rows[:-1, 1], 0)
        s[:-1] += np.where(inner[1:], rows[1:, 2], 0)
        return forward_backward(s, starts, self.a)[0]

    def summary(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """For each text: 1, the log odds of its highest marginal, the logs of the sum and the mean of its marginals; and all marginals."""
        p = self.marginals(texts)
        out = np.tile([1.0, -8.0, 0.0, -8.0], (len(texts), 1))
        if len(p):
            some = np.array([bool(t) for t in texts])
            starts = _starts(texts)
            top = np.clip(np.maximum.reduceat(p, starts), 1e-12, 1 - 1e-12)
            out[some, 1] = np.clip(np.log(top / (1 - top)), -8, 8)
            total = np.add.reduceat(p, starts)
            out[some, 2] = np.log1p(total)
            out[some, 3] = np.log(total / [len(t) for t in texts if t] + np.exp(-8))
        return out, p


def markers(texts: list[set[str]], toxic: np.ndarray, least: int, ratio: float, often_ratio: float) -> set[str]:
    """Greedy cover: features that mark texts which no feature before marks, while they mark `least` new ones. They stand `ratio` times as often in toxic texts as in others, those in 5 * `least` toxic texts `often_ratio` times."""
    bad, good = Counter(), Counter()
    for t, y in zip(texts, toxic, strict=True):
        (bad if y else good).update(t)
    n1, n0 = max(1, toxic.sum()), max(1, (~toxic).sum())
    able = {f for f, n in bad.items() if n >= least and (n / n1) / ((good[f] + 0.5) / n0) >= (ratio if n < 5 * least else often_ratio)}
    where: dict[str, set[int]] = {f: set() for f in able}
    for i in np.flatnonzero(toxic):
        for f in texts[i] & able:
            where[f].add(int(i))
    chosen: set[str] = set()
    open_ = {int(i) for i in np.flatnonzero(toxic)}
    while where:
        f = max(where, key=lambda k: (len(where[k] & open_), len(where[k]), k))
        if len(where[f] & open_) < least:
            break
        chosen.add(f)
        open_ -= where.pop(f)
    # what marks nearly as many texts as the chosen and as surely, though others of its texts' features came first
    return chosen | {f for f, own in where.items() if len(own) >= max(10 * least, len(toxic) // 50)}


def fit(texts: list[list[str]], toxic: np.ndarray, share: float, rounds: int = 60, least: int = 4, ratio: float = 30.0, often_ratio: float = 8.0) -> Chain:
    sets = [{f for w in set(t) for f in word_features(w)} for t in texts]
    marks = markers(sets, toxic, least, ratio, often_ratio)
    frequent = Counter(f for t in sets for f in t)
    known = sorted(f for f, n in frequent.items() if n >= 3)
    number = {f: i for i, f in enumerate(known)}
    del sets
    words = {w: i for i, w in enumerate(dict.fromkeys(w for t in texts for w in t))}
    owns = [[number[f] for f in word_features(w) if f in number] for w in words]
    flat = np.array([f for o in owns for f in o], dtype=np.int64)
    whose = np.repeat(np.arange(len(words)), [len(o) for o in owns])
    whole = np.array([number.get("=" + w.lower(), -1) for w in words])
    marked = np.array([any(f in marks for f in word_features(w)) for w in words], dtype=bool)
    ids = np.fromiter((words[w] for t in texts for w in t), np.int64)
    y = marked[ids] & np.repeat(toxic, [len(t) for t in texts])
    starts = _starts(texts)
    inner = np.ones(len(ids), bool)
    inner[starts] = False
    k = len(known)
    theta = np.zeros(3 * k + 5)
    theta[3 * k] = -2.0
    squares, step = np.zeros(len(theta)), 0.5
    has = whole[ids] >= 0
    for _ in range(rounds):  # AdaGrad
        here, before, after, bias, log_a = theta[:k], theta[k : 2 * k], theta[2 * k : 3 * k], theta[3 * k], theta[3 * k + 1 :].reshape(2, 2)
        of_word = np.bincount(whose, here[flat], minlength=len(words))
        s = of_word[ids] + bias
        prev, nxt = np.where(has, before[whole[ids]], 0), np.where(has, after[whole[ids]], 0)
        s[1:] += np.where(inner[1:], prev[:-1], 0)
        s[:-1] += np.where(inner[1:], nxt[1:], 0)
        p, f, b = forward_backward(s, starts, np.exp(log_a))
        d = y - p
        by_word = np.bincount(ids, d, minlength=len(words))
        g = np.zeros_like(theta)
        g[:k] = np.bincount(flat, by_word[whose], minlength=k)
        use = inner[1:] & has[:-1]
        g[k : 2 * k] = np.bincount(whole[ids][:-1][use], d[1:][use], minlength=k)
        use = inner[1:] & has[1:]
        g[2 * k : 3 * k] = np.bincount(whole[ids][1:][use], d[:-1][use], minlength=k)
        g[3 * k] = d.sum()
        pair = np.stack([log_a[i, j] + i * f[:-1] + j * b[1:] for i in (0, 1) for j in (0, 1)])[:, inner[1:]]
        pair = np.exp(pair - pair.max(0))
        pair = (pair / pair.sum(0)).sum(1)
        seen = np.bincount((2 * y[:-1] + y[1:])[inner[1:]].astype(np.int64), minlength=4)
        g[3 * k + 1 :] = seen - pair
        g -= 0.05 * theta
        squares += g * g
        theta += step * g / np.sqrt(squares + 1e-8)
    weights = {f: (theta[i], theta[k + i], theta[2 * k + i]) for f, i in number.items() if np.abs(theta[[i, k + i, 2 * k + i]]).max() > 1e-3}
    chain = Chain(weights, theta[3 * k], np.exp(theta[3 * k + 1 :].reshape(2, 2)))
    x, _ = chain.summary(texts)
    chain.coef = logistic(x, toxic.astype(float))
    drawn = toxic.mean()
    chain.coef[0] += np.log(share / (1 - share)) - np.log(drawn / (1 - drawn))
    return chain


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
        w += np.linalg.solve(h, x.T @ (y - p) - 0.1 * w)
    return w


def learn(docs: DataFrame, labels: DataFrame, sample: int = 1000, longest: int = 200_000) -> Chain | None:
    """Draws at most about `sample` toxic and `sample` other learning rows of at most `longest` characters by a hash of the id, which bounds what the driver gets; the shares are counted over all."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("the_label"))
    known = known.filter(~held_out(F.col("doc_id")))
    n = {r["the_label"]: r["n"] for r in known.groupBy("the_label").agg(F.count("*").alias("n")).collect()}
    if not n.get(1) or not n.get(0):
        return None
    some = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.when(F.col("the_label") == 1, min(1.0, sample / n[1])).otherwise(min(1.0, sample / n[0])) * (1 << 30))
    got = docs.select("doc_id", "text").filter(F.coalesce(F.length("text"), F.lit(0)) <= longest).join(F.broadcast(some), "doc_id").select("text", "the_label").dropDuplicates(["text"]).collect()  # `sample` bounds the broadcast
    got.sort(key=lambda r: (r["text"] or ""))
    toxic = np.array([r["the_label"] == 1 for r in got], dtype=bool)
    if not toxic.any() or toxic.all():
        return None
    return fit([WORD.findall(r["text"] or "") for r in got], toxic, n[1] / (n[0] + n[1]))


def held_out(doc_id: Column) -> Column:
    return fold(doc_id, 5) == 0


def toxic_spans(docs: DataFrame, labels: DataFrame, sample: int = 1000) -> DataFrame:
    """doc_id, held_out, score, predicted, spans (start and end of each offending word, in characters) for every row."""
    docs = docs.select("doc_id", "text")
    chain = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = chain.value
        for batch in chunks(batches, 1):
            raw = [t or "" for t in batch.column(1).to_pylist()]
            scores, spans = np.zeros(len(raw)), [[] for _ in raw]
            if own is not None:
                texts = [WORD.findall(t) for t in raw]
                x, p = own.summary(texts)
                scores = 1 / (1 + np.exp(-np.clip(x @ own.coef, -30, 30)))
                end = np.cumsum([len(t) for t in texts])
                for i in np.flatnonzero(x[:, 1] >= 0):
                    bad = p[end[i] - len(texts[i]) : end[i]] >= 0.5
                    spans[i] = [{"start": m.start(), "end": m.end()} for m, hit in zip(WORD.finditer(raw[i]), bad, strict=True) if hit]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array((scores >= 0.5).astype(np.int32), pa.int32()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))], names=["doc_id", "score", "predicted", "spans"])

    out = docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, predicted int, spans array<struct<start:int,end:int>>")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "spans")
