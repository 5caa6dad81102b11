"""Document log-likelihood under a gated recurrent language model in numpy.

A gated recurrent unit reads a text's tokens; its state predicts the group of the next token's class, then the class, then the
token within it (classes of equal size by frequency, groups of neighbouring classes). It learns by truncated backpropagation from all learning rows, each token once: the rows are
dealt by hash to slices (`SLICES`); for each slice in turn every task goes on from the model over all its rows, and the model
becomes the mean of the results, weighted by tokens (tasks send what they changed, in half precision). Partitions are put together
to one task for `WORDS_A_MODEL` words, or `MODELS` tasks, if they are more: a model grows by the root of the rows, and so does
the number of models, so what they exchange grows in proportion to the rows. Nothing is fitted on the driver. When texts are scored, the state is
carried from window to window through each whole text, however long.

The model's words are the most frequent of all learning rows: `model_words` up to `sample` rows, and by the root of the rows' number more
beyond. Any other token has the probability of the model's unknown
symbol times (c + 1) / Z, where c is its count in all learning rows and Z sums c + 1 over all such tokens and one for what was never
seen. Counts cover the whole corpus: tokens among the `listed` most frequent are counted within tasks, all others
meet by their 64-bit hash in a shuffle; as that hash stands for the token, two tokens with one hash would count as one.

Defined cases: null and empty texts hold only the end token; without learning rows all counts are 0 and the model is
uniform; repeated rows count each and get the same result each; null ids are held out or not as the empty text is; extra
columns are ignored.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillview.llm.common import chunks, discard, fold, stored

UNKNOWN, END = 0, 1
LANES, STEPS = 1024, 32
#: Of AdaGrad; the best of 0.1 to 0.6 on a seventh of sf0.1's learning rows, by a model of the others.
RATE = 0.2
#: Shares of the learning rows that are read between two means, and how many lanes read them: small windows first.
SLICES = ((1 / 32, 128), (3 / 32, 512), (7 / 8, 1024))
#: Bytes of tokens that a task holds until it counts them.
HELD_BYTES = 64 << 20
#: Bytes of text that a task scores at once: the more texts, the fewer steps that only the longest of them take.
SCORED_BYTES = 32 << 20
#: States that await their probabilities together.
HELD_STATES = 1 << 17
#: Models that are averaged: one for so many words, so that what they exchange grows with the rows, as words grow by the root.
WORDS_A_MODEL, MODELS = 1500, 12
#: Parameters that are averaged at once.
BLOCK = 4096
#: Logits that are laid out at once, so that they stay in the processor's cache.
CELLS = 1 << 16
INDEX, ONES = np.arange(CELLS), {t: np.ones(CELLS, t) for t in (np.float32, np.float64)}
#: Logits within this bound need no maximum subtracted before their exponentials are summed, in single precision either.
SMALL = 40
END_HASH = 0x7265_6375_7272_656E  # stands for the end token


def cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The tokens of all texts, one after the other, and where each text's begin and the last one's end."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
    edges, flat = lists.offsets.to_numpy(), lists.flatten()
    edges = edges - edges[0]
    full = pc.greater(pc.binary_length(flat), 0)  # whitespace around a text leaves empty strings
    if not pc.all(full).as_py():
        edges, flat = np.append(0, np.cumsum(full.to_numpy(zero_copy_only=False)))[edges], flat.filter(full)
    return flat, edges


def _with_one(h: np.ndarray) -> np.ndarray:
    """States with a last component of 1, which the biases are multiplied with."""
    out = np.ones((len(h), h.shape[1] + 1), h.dtype)
    out[:, :-1] = h
    return out


def _exp(a: np.ndarray, target: np.ndarray, small: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """exp(a) (in place), the targets' logits and the rows' sums; unless logits are small, all less each row's maximum."""
    if not small:
        a -= a.max(1, keepdims=True)
    own = a[INDEX[: len(a)], target]
    np.exp(a, out=a)
    return a, own, a @ ONES[a.dtype.type][: a.shape[1]]


def _order(numbers: np.ndarray, below: int) -> np.ndarray:
    """The stable order of numbers below a bound; those of 16 bits are sorted by their digits."""
    return np.argsort(numbers.astype(np.uint16) if below <= 1 << 16 else numbers, kind="stable")


class Gru:
    def __init__(self, words: int, hidden: int = 16, per_class: int = 64, seed: int = 3, per_group: int = 0, width: int = 0):
        """per_group: classes of a group, which is predicted before the class (0: no groups); width: of a word's vector, which `v` and `b` turn into the gates' inputs (0: the word has these itself)."""
        rng = np.random.default_rng(seed)
        self.squares: dict[str, np.ndarray] = {}
        self.h, self.per, self.per_group = hidden, per_class, per_group
        self.classes = -(-words // per_class)
        n = self.classes * per_class
        r = lambda *s: (rng.standard_normal(s) * 0.1).astype(np.float32)
        o = lambda *s: np.zeros(s, np.float32)
        self.p = {"x": r(n, width or 3 * hidden), "u": r(hidden, 3 * hidden), "c": r(hidden, self.classes), "cb": o(self.classes), "w": r(self.classes, hidden, per_class), "wb": o(self.classes, per_class)}
        left = n - words  # the last class is filled up with words that never come
        if left:
            self.p["wb"][-1, per_class - left :] = -30
        if width:
            self.p |= {"v": r(width, 3 * hidden) * np.float32(10 / width**0.5), "b": o(3 * hidden)}
        if per_group:
            groups = -(-self.classes // per_group)
            self.p |= {"g": r(hidden, groups), "gb": o(groups), "c": r(groups, hidden, per_group), "cb": o(groups, per_group)}
            self.p["cb"].reshape(-1)[self.classes :] = -30  # as above

    def inputs(self, x: np.ndarray) -> np.ndarray:
        """What the gates get from words of these rows of `x`."""
        return (self.p["v"].T @ x.T + self.p["b"][:, None]).T if "v" in self.p else x

    def step(self, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """The next state, and what backpropagation needs. All are laid out column by column, so that the parts of the gates are contiguous."""
        k = self.h
        hu = (self.p["u"].T @ h.T).T
        gates = x[:, : 2 * k] + hu[:, : 2 * k]
        np.exp(np.negative(gates, out=gates), out=gates)
        gates += 1
        np.reciprocal(gates, out=gates)
        r, z = gates[:, :k], gates[:, k:]
        n = r * hu[:, 2 * k :]
        n += x[:, 2 * k :]
        np.tanh(n, out=n)
        return n + z * (h - n), r, z, n, hu[:, 2 * k :]

    def output(self) -> tuple[list[np.ndarray], bool]:
        """For each level, from the top, the weights of each node's children, biases as their last rows; whether every logit is small (components of a state are within 1)."""
        out = []
        for key in "gcw":
            if key in self.p:
                w, bias = self.p[key], self.p[key + "b"]
                out.append(np.concatenate([w, bias[:, None]], 1) if w.ndim == 3 else np.vstack([w, bias])[None])
        return out, max(np.abs(w).sum(1).max() for w in out) < SMALL

    def _levels(self, target: np.ndarray) -> list[tuple[str, np.ndarray, np.ndarray]]:
        """(key, node, child) of each level, from the top, for words sorted by class."""
        cls, place = np.divmod(target, self.per)
        out, above = [("w", cls, place)], "c"
        if self.per_group:
            group, own = np.divmod(cls, self.per_group)
            out, above, cls = [("c", group, own), *out], "g", group
        return [(above, np.zeros_like(cls), cls), *out]

    @staticmethod
    def _blocks(node: np.ndarray, w: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(node, first, end) of runs of one node, of CELLS logits at most, in sorted nodes."""
        edges, rows = np.searchsorted(node, np.arange(len(w) + 1)).tolist(), -(-CELLS // w.shape[2])
        for c in range(len(w)):
            for at in range(edges[c], edges[c + 1], rows):
                yield c, at, min(at + rows, edges[c + 1])

    def log_probs(self, h: np.ndarray, target: np.ndarray, weights: tuple[list[np.ndarray], bool] | None = None) -> np.ndarray:
        """Natural logarithms of the targets' probabilities; weights: what output() gives."""
        levels, small = weights or self.output()
        order = _order(target // self.per, self.classes)
        h, got = _with_one(h.take(order, axis=0)), np.zeros(len(h), h.dtype)
        sums = np.empty_like(got)
        for w, (_, node, child) in zip(levels, self._levels(target[order]), strict=True):
            for c, at, end in self._blocks(node, w):
                _, own, sums[at:end] = _exp(h[at:end] @ w[c], child[at:end], small)
                got[at:end] += own
            got -= np.log(sums)
        out = np.empty_like(got)
        out[order] = got
        return out

    def read(self, stream: np.ndarray, lanes: int = 256, steps: int = 16) -> None:
        """Learns from every token of the stream once."""
        width = -(-len(stream) // lanes) + 1
        grid = np.full((lanes, width), END)
        grid[:, 0] = END  # each lane begins behind the token before it
        own = np.append(stream, np.full(lanes * (width - 1) - len(stream), END)).reshape(lanes, width - 1)
        grid[:, 1:] = own
        grid[1:, 0] = own[:-1, -1]
        h = np.zeros((lanes, self.h), np.float32)
        for at in range(0, width - 1, steps):
            h = self._window(grid[:, at : at + steps + 1], h)

    def _window(self, grid: np.ndarray, h: np.ndarray, rate: float = RATE) -> np.ndarray:
        """One AdaGrad step over a window, whose last column is only a target; the state behind it."""
        for key, v in self.p.items():
            if key not in self.squares:
                self.squares[key] = np.full_like(v, 1e-6)
        g, words, h = self.gradients(grid, h)
        for key, v in g.items():
            at = words if key == "x" else slice(None)
            v *= np.float32((len(grid) * (grid.shape[1] - 1)) ** -0.5)
            squares, more = self.squares[key][at], v * v
            squares += more
            if key == "x":
                self.squares[key][at] = squares
            np.clip(v, -1, 1, out=v)
            v *= np.float32(rate)
            v /= np.sqrt(squares, out=more)
            self.p[key][at] -= v
        return h

    def gradients(self, grid: np.ndarray, h: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
        """Of the negative log-likelihood (of x: only the rows of these words), and the state behind the window."""
        lanes, steps, k, narrow = len(grid), grid.shape[1] - 1, self.h, "v" in self.p
        hs, kept, ends = np.empty((steps, lanes, k), h.dtype), [], grid.T == END
        words = grid[:, :-1].T.reshape(-1)
        xs = self.p["x"].take(words, axis=0).reshape(steps, lanes, -1)
        for t in range(steps):
            before = np.array(h.T, order="C")
            before[:, ends[t]] = 0  # a new text begins
            h, *rest = self.step(self.inputs(xs[t]), before.T)
            hs[t] = h
            kept.append((before, *(v.T for v in rest)))
        g: dict[str, np.ndarray] = {}
        dh_all = self._output_gradient(hs.reshape(-1, k), grid[:, 1:].T.reshape(-1), g).reshape(steps, lanes, k)
        g |= {key: np.zeros_like(self.p[key]) for key in ("u", "v", "b") if key in self.p}
        dh, dx, du = np.zeros((k, lanes), h.dtype), np.empty((3 * k, lanes), h.dtype), np.empty((3 * k, lanes), h.dtype)
        for t in reversed(range(steps)):
            before, r, z, n, hun = kept[t]
            dh += dh_all[t].T
            dhz = dh * z
            dn = (dh - dhz) * (1 - n * n)
            dx[2 * k :] = dn
            dn *= r
            du[2 * k :] = dn
            dx[:k] = dn * hun * (1 - r)
            dx[k : 2 * k] = dhz * (before - n) * (1 - z)
            du[: 2 * k] = dx[: 2 * k]
            dh = self.p["u"] @ du
            dh += dhz
            dh[:, ends[t]] = 0
            g["u"] += before @ du.T
            if narrow:
                g["v"] += xs[t].T @ dx.T
                g["b"] += dx.sum(1)
            xs[t] = dx.T @ self.p["v"].T if narrow else dx.T  # from here on its gradient
        # of x only the rows of the window's words change
        order = _order(words, len(self.p["x"]))
        words = words[order]
        first = np.flatnonzero(np.diff(words, prepend=-1))
        g["x"] = np.add.reduceat(xs.reshape(len(order), -1).take(order, axis=0), first, axis=0)
        return g, words[first], h

    def _output_gradient(self, h: np.ndarray, target: np.ndarray, g: dict[str, np.ndarray]) -> np.ndarray:
        levels, small = self.output()
        order = _order(target // self.per, self.classes)
        h, dh = _with_one(h.take(order, axis=0)), np.zeros((len(h), self.h), h.dtype)
        for w, (key, node, child) in zip(levels, self._levels(target[order]), strict=True):
            # the rows' sums divide the narrow factors, not the exponentials
            dw, back = np.zeros_like(w), w[:, :-1].transpose(0, 2, 1)
            for c, at, end in self._blocks(node, w):
                own = h[at:end]
                e, _, total = _exp(own @ w[c], child[at:end], small)
                e[INDEX[: end - at], child[at:end]] -= total
                total = total[:, None]
                dw[c] += (own / total).T @ e
                more = e @ back[c]
                more /= total
                dh[at:end] += more
            g[key], g[key + "b"] = (dw[:, :-1], dw[:, -1]) if self.p[key].ndim == 3 else (dw[0, :-1], dw[0, -1])
        out = np.empty_like(dh)
        out[order] = dh
        return out

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        """For each text (numbers that end with END) its log10 probability."""
        out = np.zeros(len(texts))
        weights = self.output()
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        waiting = 0
        held: list[tuple[np.ndarray, ...]] = []  # states, targets and texts that await their probabilities

        def done() -> None:
            nonlocal out
            states, targets, whose = (np.concatenate(part) for part in zip(*held, strict=True))
            out += np.bincount(whose, self.log_probs(states, targets, weights), len(out))
            held.clear()

        for first in range(0, len(order), LANES):
            own = np.array(order[first : first + LANES])
            sizes = np.array([len(texts[i]) for i in own])
            flat, starts = np.concatenate([texts[i] for i in own]), np.cumsum(sizes) - sizes
            h, was = np.zeros((len(own), self.h), np.float32), np.full(len(own), END)
            # texts are sorted by length, so the lanes still in use stand first
            for t, now in enumerate(np.searchsorted(-sizes, -np.arange(sizes[0])).tolist()):
                h = self.step(self.inputs(self.p["x"].take(was[:now], axis=0)), h[:now])[0]
                was = flat.take(starts[:now] + t)
                held.append((h, was, own[:now]))
                waiting += now
                if waiting >= HELD_STATES:
                    done()
                    waiting = 0
        if held:
            done()
        return out / np.log(10)


class Model:
    """common: the `listed` tokens; their places begin at 2, behind UNKNOWN and END, and those below `own` are the network's own."""

    def __init__(self, common: pa.Array, model_words: int):
        """common: the most frequent tokens, in order."""
        self.common = common
        self.own = min(model_words, len(common) + 2)
        leaf = max(64, round(self.own**0.44))  # each costs a call, so words of a class are more than classes of a group
        self.gru = Gru(self.own, per_class=leaf, per_group=max(4, round((self.own / leaf) ** 0.5)), width=16)
        self.hashes = np.concatenate([np.array([0, END_HASH]), _hashes(common)])

    def numbers(self, words: pa.Array) -> np.ndarray:
        """The places of listed tokens, UNKNOWN for all others."""
        return pc.add(pc.fill_null(pc.index_in(words, value_set=self.common), UNKNOWN - 2), 2).to_numpy(zero_copy_only=False).astype(np.int64)

    def stream(self, texts: pa.Array) -> np.ndarray:
        """The network's numbers of all texts, each closed by END."""
        words, edges = cut(texts)
        ids = self.numbers(words)
        ids[ids >= self.own] = UNKNOWN
        return np.insert(ids, edges[1:], END)


def _hashes(words: pa.Array) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words.cast(pa.binary()).to_pylist()), np.uint64, len(words)).view(np.int64)


def held_out(doc_id: Column) -> Column:
    return fold(doc_id, 7) == 2


def _text_bits(text: str | None) -> int:
    return xxhash.xxh32_intdigest((text or "").encode("utf-8", "replace")) >> 1


def most_frequent(learning: DataFrame, n: int) -> pa.Array:
    """The n most frequent tokens of all rows, most frequent first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Array] = []

        def done() -> pa.RecordBatch:
            values, times = pc.value_counts(pa.chunked_array(held, pa.string())).flatten()
            held.clear()
            return pa.RecordBatch.from_arrays([values, times], names=["token", "n"])

        for batch in chunks(batches, 0):
            held.append(cut(batch.column(0))[0])
            if sum(words.nbytes for words in held) > HELD_BYTES:
                yield done()
        if held:
            yield done()

    counts = learning.select("text").mapInArrow(count, "token string, n bigint").groupBy("token").agg(F.sum("n").alias("n"))
    return counts.orderBy(F.desc("n"), "token").limit(n).toArrow().column("token").combine_chunks().cast(pa.string())


def learn_all(model: Model, learning: DataFrame, lanes: int, models: int) -> None:
    """Each of at most `models` tasks goes on from the model over all its rows; the model takes the mean of the results, weighted by tokens."""
    shared = learning.sparkSession.sparkContext.broadcast(model)
    sizes = {k: v.size for k, v in model.gru.p.items()}

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, seen = shared.value, 0
        gru = copy.deepcopy(m.gru)
        for batch in chunks(batches, 0):
            stream = m.stream(batch.column(0))
            gru.read(stream, max(1, min(lanes, len(stream) // 32)), STEPS if lanes == LANES else STEPS // 2)
            seen += len(stream)
        if seen:
            flat = np.concatenate([(gru.p[k] - m.gru.p[k]).reshape(-1) for k in sizes]).astype(np.float16)
            parts = [flat[i : i + BLOCK].tobytes() for i in range(0, len(flat), BLOCK)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([seen] * len(parts), pa.int64()), pa.array(parts, pa.binary())], names=["block", "n", "v"])

    def mean(key: tuple, t: pa.Table) -> pa.Table:
        rows = zip(t.column("n").to_pylist(), t.column("v").to_pylist(), strict=True)
        total = sum(np.frombuffer(v, np.float16).astype(np.float64) * n for n, v in rows) / sum(t.column("n").to_pylist())
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "v": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

    got = learning.select("text").coalesce(models).mapInArrow(learn, "block int, n bigint, v binary").groupBy("block").applyInArrow(mean, "block int, v binary").collect()
    if got:
        flat = np.frombuffer(b"".join(bytes(r["v"]) for r in sorted(got, key=lambda r: r["block"])), np.float32).copy()
        for k, v in zip(sizes, np.split(flat, np.cumsum([*sizes.values()])[:-1]), strict=True):
            model.gru.p[k] = model.gru.p[k] + v.reshape(model.gru.p[k].shape)
    model.gru.squares = {}


def log_likelihoods(docs: DataFrame, sample: int = 3000, model_words: int = 4096, listed: int = 150_000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    learning = docs.filter("NOT held_out")
    n_learn = learning.count()
    own_words = round(model_words * max(1.0, n_learn / sample) ** 0.5)
    model = Model(most_frequent(learning, max(listed, own_words) - 2), own_words)
    dealt, low = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) / (1 << 20), 0.0
    for share, lanes in SLICES:
        learn_all(model, learning.filter((dealt >= low) & (dealt < low + share)), lanes, max(MODELS, round(own_words / WORDS_A_MODEL)))
        low += share
    shared = spark.sparkContext.broadcast(model)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each unlisted token of each text; at the end, rows without id for the listed ones."""
        m, hashes = shared.value, shared.value.hashes
        sums = np.zeros(len(hashes), np.int64)
        names = ["hash", "doc_id", "bits", "times", "learned", "head"]
        id_type = None
        for batch in chunks(batches, 1):
            id_type = batch.schema.field(0).type
            (words, edges), out = cut(batch.column(1)), batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            ids, whose = m.numbers(words), np.repeat(np.arange(len(out)), np.diff(edges))
            sums += np.bincount(ids[~out[whose]], minlength=len(sums))
            sums[END] += (~out).sum()
            far = ids == UNKNOWN
            rare = words.filter(pa.array(far)).dictionary_encode()
            if len(rare):
                k = len(rare.dictionary)
                pairs, times = np.unique(whose[far] * k + rare.indices.to_numpy(), return_counts=True)
                rows, code = np.divmod(pairs, k)
                head = np.diff(rows, prepend=-1) != 0
                bits = np.repeat([_text_bits(t) for t in batch.column(1).take(pa.array(rows[head])).to_pylist()], np.diff(np.append(np.flatnonzero(head), len(rows))))
                yield pa.RecordBatch.from_arrays([pa.array(_hashes(rare.dictionary)[code]), batch.column(0).take(pa.array(rows)), pa.array(bits, pa.int32()), pa.array(times, pa.int32()), pa.array(np.where(out[rows], 0, times), pa.int64()), pa.array(head.astype(np.int32))], names=names)
        seen = np.flatnonzero(sums)
        seen = seen[seen != UNKNOWN]
        if len(seen):
            yield pa.RecordBatch.from_arrays([pa.array(hashes[seen]), pa.nulls(len(seen), id_type), pa.array([-1] * len(seen), pa.int32()), pa.array([0] * len(seen), pa.int32()), pa.array(sums[seen]), pa.array([0] * len(seen), pa.int32())], names=names)

    counted = stored(docs.mapInArrow(count, f"hash bigint, doc_id {kind}, bits int, times int, learned bigint, head int"))
    # summed before the shuffle; the join back is one that adaptive execution splits where a token is frequent
    corpus = stored(counted.groupBy("hash").agg(F.sum("learned").alias("c"), F.max("bits").alias("any")))
    known = F.col("c") > 0
    per = counted.filter("bits >= 0").join(corpus.select("hash", "c"), "hash").groupBy("doc_id", "bits").agg(
        F.sum(F.log10(F.col("c") + 1) * F.col("times")).alias("logs"), F.sum(F.when(known, F.col("times")).otherwise(0)).alias("n_known"), F.sum("head").alias("copies"),
    )
    per = stored(per)
    of = {r["hash"]: r["c"] for r in corpus.filter("any = -1").select("hash", "c").collect()}  # `listed` rows at most
    counts = np.array([of.get(h, 0) for h in model.hashes.tolist()], np.int64)
    counts[UNKNOWN] = 0
    totals = corpus.filter("any >= 0").agg(F.count_if(F.col("c") > 0).alias("v"), F.sum("c").alias("n")).first()
    v, n = int(totals["v"] or 0) + int((counts > 0).sum()), int(counts.sum()) + int(totals["n"] or 0)
    discard(counted)
    discard(corpus)
    own = counts[: model.own]
    z = float((n - own.sum()) + (v - (own > 0).sum()) + 1)
    tables = spark.sparkContext.broadcast((np.log10(counts + 1.0), counts > 0))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, (logs, have) = shared.value, tables.value
        for batch in chunks(batches, 1, SCORED_BYTES):
            words, edges = cut(batch.column(1))
            ids, ends = np.insert(m.numbers(words), edges[1:], END), edges[1:] + np.arange(1, len(edges))
            starts = np.append(0, ends[:-1])
            of_text = lambda v: np.add.reduceat(v, starts)  # noqa: E731, B023
            base, far = logs[ids], ids >= m.own
            ids_own = np.where(far, UNKNOWN, ids)
            got = m.gru.score(np.split(ids_own, starts[1:]))
            bits = [_text_bits(t) for t in batch.column(1).to_pylist()]
            n_tokens, n_known, n_other = ends - starts, of_text(have[ids].astype(np.int64)), of_text((ids_own == UNKNOWN).astype(np.int64))
            base, other = of_text(base), of_text(np.where(far, base, 0.0))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(bits, pa.int32()), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base, pa.float64()), pa.array(other, pa.float64()), pa.array(n_other, pa.int64()), pa.array(got, pa.float64())], names=["doc_id", "held_out", "bits", "n_tokens", "known", "base", "other", "n_other", "net"])

    scored = docs.mapInArrow(score, f"doc_id {kind}, held_out boolean, bits int, n_tokens bigint, known bigint, base double, other double, n_other bigint, net double")
    rest = per.select(F.col("doc_id").alias("r_id"), F.col("bits").alias("r_bits"), (F.col("logs") / F.col("copies")).alias("logs"), (F.col("n_known") / F.col("copies")).cast("long").alias("more"))
    both = scored.join(rest, F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("bits") == F.col("r_bits")), "left")
    logs = F.coalesce("logs", F.lit(0.0))
    return both.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + logs - F.col("n_tokens") * float(np.log10(n + v + 1.0))).alias("base_score"),
        (F.col("net") + F.col("other") + logs - F.col("n_other") * float(np.log10(z))).alias("score"),
    )
