"""Groups of texts whose sets of word shingles have a Jaccard similarity of at least `least`, by SimHash and prefix filtering.

Texts whose SimHash fingerprints meet in the ball hashing of simhash.py (at most RADIUS bits apart) are pairs, verified by their whole sets.
As pairs of similarity 0.8 differ in up to 11 bits, which no ball can hold, all others are found by prefix filtering:

Under any fixed order of all shingles, two such sets share one among the first n - ceil(least * n) + 1 of each, so texts are
compared only where these prefixes meet, and every comparison is of the whole sets: no similar pair is missed, none is guessed. The
order puts shingles that are frequent in a sample last; it decides the work, never the result.

A shingle with at most `crowd` texts gives pairs. Before a pair's texts are fetched, the parities of their sets' counts in slots are
compared: these differ in no more slots than the sets in shingles, so that only pairs that cannot be similar go. A set has as many slots
as shingles at least, so that long texts are told apart as well; of two sets the parities of more slots are folded. Of any
other shingle, first the texts of which it is the most frequent such one are compared, where a text is compared with a group only
until it joins it; a task holds `block` of them, and more are dealt to parts at random, twice, the second time with the groups of the
first. Texts of one shingle that are in different groups by then are pairs again, in tasks of two blocks each; the blocks of the largest
group are not compared with each other.

Defined cases: texts of fewer words than a shingle are one shingle; null, empty and wordless texts are alike; equal texts
count once; a text is known by its 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillview.llm.common import chunks, discard, stored
from rillview.llm.simhash import ball_links, components, fingerprint, shingle_hashes

#: The fewest slots; a set of more shingles has the next power of two.
SLOTS = 2048
#: Texts of so many hashes are fetched by broadcasting these; beyond, the rows are shuffled.
BROADCAST = 200_000
#: Members of one shingle that a task compares at once.
BLOCK = 4096
#: Bits in which the fingerprints of a pair differ at most.
RADIUS = 5
#: Rows whose shingles are counted to order all shingles, and how many of the most frequent are ordered by their counts.
SAMPLE, RANKED = 10_000, 200_000


def shingle_set(text: str | None, words: int) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(text, words) or [0], np.uint64))


def prefix(own: np.ndarray, least: float, ranked: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    rank = np.zeros(len(own), np.int64)
    if len(ranked):
        at = np.minimum(np.searchsorted(ranked, own), len(ranked) - 1)
        rank = np.where(ranked[at] == own, ranks[at], 0)
    return own[np.lexsort((own, rank))[: len(own) - ceil(least * len(own) - 1e-9) + 1]]


def parities(own: np.ndarray) -> bytes:
    slots = max(SLOTS, 1 << (len(own) - 1).bit_length())
    return np.packbits((np.bincount((own % np.uint64(slots)).astype(np.int64), minlength=slots) & 1).astype(np.uint8)).tobytes()


def folded(bits: bytes, size: int) -> bytes:
    """The parities in the slots that `size` bytes hold."""
    return bits if len(bits) == size else np.bitwise_xor.reduce(np.frombuffer(bits, np.uint64).reshape(-1, size // 8)).tobytes()


def laid(bits: list[bytes], size: int) -> np.ndarray:
    return np.frombuffer(b"".join(folded(b, size) for b in bits), np.uint64).reshape(-1, size // 8)


def most_apart(n: np.ndarray, least: float) -> np.ndarray:
    """The most elements in which two alike sets of n elements in sum differ."""
    return n * (1 - least) / (1 + least) + 1e-6


def possible(a: list[bytes], b: list[bytes], n: np.ndarray, least: float) -> np.ndarray:
    """Whether sets of these parities and n elements in sum may be alike."""
    sizes = np.array([min(len(x), len(y)) for x, y in zip(a, b, strict=True)], np.int64)
    out = np.zeros(len(sizes), bool)
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        x, y = (laid([c[i] for i in at], size) for c in (a, b))
        out[at] = np.bitwise_count(x ^ y).sum(1, dtype=np.int64) <= most_apart(n[at], least)
    return out


class Crowd:
    """Sizes and parities of sets, of which each is asked for those before it that may be like it."""

    def __init__(self, sizes: list[int], bits: list[bytes], least: float):
        self.n, self.least, self.width = np.array(sizes), least, np.array([len(b) for b in bits])
        self.laid = {}
        for size in np.unique(self.width).tolist():
            at = np.flatnonzero(self.width >= size)
            self.laid[size] = at, laid([bits[i] for i in at], size)

    def before(self, x: int, wanted: np.ndarray) -> np.ndarray:
        """wanted: whether each of the sets before x counts."""
        out = []
        for size, (at, rows) in self.laid.items():
            if size > self.width[x]:
                continue
            place = np.searchsorted(at, x)
            others = at[:place]
            fits = wanted[others] & (np.minimum(self.n[others], self.n[x]) >= self.least * np.maximum(self.n[others], self.n[x]) - 1e-9)
            if size < self.width[x]:
                fits &= self.width[others] == size
            some = np.flatnonzero(fits)
            apart = np.bitwise_count(rows[some] ^ rows[place]).sum(1, dtype=np.int64)
            out.append(others[some][apart <= most_apart(self.n[others[some]] + self.n[x], self.least)])
        return np.concatenate(out)


def alike(a: frozenset | np.ndarray, b: frozenset | np.ndarray, least: float) -> bool:
    """Two sets, or two arrays of shingle_set."""
    if min(len(a), len(b)) < least * max(len(a), len(b)) - 1e-9:
        return False
    both = len(a & b) if isinstance(a, frozenset) else len(np.intersect1d(a, b, assume_unique=True))
    return both >= least * (len(a) + len(b) - both) - 1e-9


def group_links(nodes: list[int], sets: list[np.ndarray], least: float, labels: list[int] | None = None) -> list[tuple[int, int]]:
    """Links that join all alike members, of which those with one label are joined already."""
    crowd = Crowd([len(s) for s in sets], [parities(s) for s in sets], least)
    group = np.arange(len(nodes)) if labels is None else np.unique(np.array(labels), return_inverse=True)[1]
    out = []
    for x in range(1, len(nodes)):
        left = crowd.before(x, group[:x] != group[x])
        while len(left):
            y, left = left[0], left[1:]
            if alike(sets[x], sets[y], least):
                out.append((max(nodes[x], nodes[y]), min(nodes[x], nodes[y])))
                group[group == group[y]] = group[x]
                left = left[group[left] != group[x]]
    return out


def cross_pairs(nodes: list[int], labels: list[int], sides: list[int], sizes: list[int], bits: list[bytes], least: float) -> list[tuple[int, int]]:
    """Pairs of members with different labels whose sizes and parities let them be alike; of members of two sides, pairs of both sides only."""
    node, label, side = np.array(nodes), np.array(labels), np.array(sides)
    two = len(set(sides)) > 1
    crowd = Crowd(sizes, bits, least)
    out = []
    for x in range(1, len(node)):
        wanted = label[:x] != label[x]
        if two:
            wanted &= side[:x] != side[x]
        out += [(max(a, nodes[x]), min(a, nodes[x])) for a in node[crowd.before(x, wanted)].tolist()]
    return out


def in_blocks(members: DataFrame, block: int) -> DataFrame:
    """members: token, node, label, kinds (a token's members) and more columns. Deals each token's members, a row for each task (a, b) in which it is
    compared: those of one block with themselves (a = b) or with those of another. The most frequent label's members have blocks of their own, which
    need no comparison with each other."""
    counts = members.groupBy("token", "label").agg(F.count("*").alias("c"))
    largest = counts.groupBy("token").agg(F.max(F.struct("c", "label")).alias("top")).select("token", F.col("top.label").alias("top"), F.col("top.c").alias("c"))
    dealt = members.join(largest, "token").withColumns({
        "rest": F.when(F.col("kinds") <= block, 1).otherwise(F.ceil((F.col("kinds") - F.col("c")) / block)).cast("int"),
        "tops": F.when(F.col("kinds") <= block, 0).otherwise(F.ceil(F.col("c") / block)).cast("int"),
    })
    of_top = (F.col("label") == F.col("top")) & (F.col("tops") > 0)
    spread = F.xxhash64("node", F.lit(2))
    dealt = dealt.withColumn("side", F.when(of_top, F.col("rest") + F.pmod(spread, F.col("tops"))).otherwise(F.pmod(spread, F.col("rest"))).cast("int"))
    other = F.explode(F.when(of_top, F.sequence(F.lit(0), F.col("rest") - 1)).otherwise(F.sequence(F.lit(0), F.col("rest") + F.col("tops") - 1)))
    dealt = dealt.withColumn("other", other).withColumns({"a": F.least("side", "other"), "b": F.greatest("side", "other")})
    return dealt.drop("rest", "tops", "top", "c", "other")


def _ranking(rows: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The sample's most frequent shingles, sorted, and the place of each by frequency (1 is the rarest)."""
    share = min(1.0, SAMPLE / max(1, rows.count()))
    drawn = rows.filter(F.pmod(F.xxhash64("node"), F.lit(1 << 30)) < share * (1 << 30))

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, 1):
            sets = [shingle_set(t, words) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], names=["token"])

    counts = drawn.mapInArrow(shingles, "token bigint").groupBy("token").agg(F.count("*").alias("n")).filter("n > 2")
    most = counts.orderBy(F.desc("n"), "token").limit(RANKED).toArrow()
    tokens, n = most.column("token").to_numpy().view(np.uint64), most.column("n").to_numpy()
    ranks = np.empty(len(tokens), np.int64)
    ranks[np.lexsort((tokens, n))] = np.arange(1, len(tokens) + 1)
    order = np.argsort(tokens)
    return tokens[order], ranks[order]


def sketched(rows: DataFrame, words: int) -> DataFrame:
    """node, bits (parities), n (shingles) and fp (fingerprint) of the distinct texts; rows: node, text."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, 1):
            hashes = [shingle_hashes(t, words) for t in batch.column(1).to_pylist()]
            sets = [np.unique(np.array(h or [0], np.uint64)) for h in hashes]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(parities, sets), pa.binary()), pa.array([len(s) for s in sets], pa.int32()), pa.array(map(fingerprint, hashes), pa.int64())], names=["node", "bits", "n", "fp"])

    return rows.mapInArrow(sketch, "node bigint, bits binary, n int, fp bigint").groupBy("node").agg(*(F.first(c).alias(c) for c in ("bits", "n", "fp")))


def near_pairs(sketches: DataFrame, least: float) -> DataFrame:
    """u > v, n (shingles of both): texts of one fingerprint with the first of these, and the first texts of linked fingerprints, if their sizes fit."""
    firsts = stored(sketches.groupBy("fp").agg(F.min(F.struct("node", "n")).alias("own")))
    same = sketches.join(firsts, "fp").filter(F.col("node") != F.col("own.node")).select(F.struct("node", "n").alias("a"), F.col("own").alias("b"))
    linked = ball_links(firsts.select("fp"), RADIUS)
    linked = linked.join(firsts.toDF("u", "a"), "u").join(firsts.toDF("v", "b"), "v").select("a", "b")
    fits = F.least("a.n", "b.n") >= least * F.greatest("a.n", "b.n") - 1e-9
    out = stored(same.unionByName(linked).filter(fits).select(F.greatest("a.node", "b.node").alias("u"), F.least("a.node", "b.node").alias("v"), (F.col("a.n") + F.col("b.n")).alias("n")))
    discard(firsts)
    return out


def similar_links(docs: DataFrame, words: int = 5, least: float = 0.8, crowd: int = 16, block: int = BLOCK) -> DataFrame:
    """u > v: pairs of hashes of alike texts, whose components are those of all alike pairs. docs: text."""
    spark = docs.sparkSession
    rows = docs.select(F.xxhash64("text").alias("node"), "text")
    order = spark.sparkContext.broadcast(_ranking(rows, words))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, 1):
            sets = [shingle_set(t, words) for t in batch.column(1).to_pylist()]
            firsts = [prefix(s, least, *order.value) for s in sets]
            kept = [len(f) for f in firsts]
            node = np.repeat(batch.column(0).to_numpy(), kept)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(firsts).view(np.int64)), pa.array(node), pa.array(np.repeat([len(s) for s in sets], kept).astype(np.int32))], names=["token", "node", "n"])

    marks = stored(sketched(rows, words))
    near = near_pairs(marks, least)
    # counted before the shuffle and written, so that a shingle of very many rows, copies of one text too, needn't meet in one task
    every = stored(rows.mapInArrow(prefixes, "token bigint, node bigint, n int"))
    often = stored(every.groupBy("token").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo <> hi").select("token"))
    shared = stored(every.join(often, "token", "left_semi"))
    discard(every)
    discard(often)
    met = stored(shared.groupBy("token", "node").agg(F.first("n").alias("n")))
    discard(shared)
    sizes = stored(met.groupBy("token").agg(F.count("*").alias("kinds")))
    calm = met.join(sizes.filter(F.col("kinds") <= crowd), "token").select("token", "node", "n")
    other = calm.select("token", F.col("node").alias("v"), F.col("n").alias("m"))
    fits = (F.col("node") > F.col("v")) & (F.least("n", "m") >= least * F.greatest("n", "m") - 1e-9)
    pairs = calm.join(other, "token").filter(fits).select(F.col("node").alias("u"), "v", (F.col("n") + F.col("m")).alias("n"))

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, 3):
            yes = possible(batch.column(3).to_pylist(), batch.column(4).to_pylist(), batch.column(2).to_numpy(), least)
            yield batch.select(["u", "v"]).filter(pa.array(yes))

    pairs = pairs.unionByName(near).distinct()
    sketches = marks.select("node", "bits")
    told = pairs.join(sketches.toDF("u", "a"), "u").join(sketches.toDF("v", "b"), "v").select("u", "v", "n", "a", "b")
    pairs = stored(told.mapInArrow(select, "u bigint, v bigint"))
    crowded = stored(met.join(sizes.filter(F.col("kinds") > crowd), "token").select("token", "node", "kinds", "n"))
    discard(met)
    needed = stored(pairs.select(F.col("u").alias("node")).union(pairs.select("v")).union(crowded.select("node")).distinct())
    if needed.count() <= BROADCAST:
        needed = F.broadcast(needed)
    texts = stored(rows.join(needed, "node", "left_semi").groupBy("node").agg(F.first("text").alias("text")))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, np.empty(0, np.uint64)
        for batch in chunks(batches, 2):
            yes = []
            for v, a, b in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                if v != last:  # the join leaves the rows of one v together
                    last, own = v, shingle_set(b, words)
                yes.append(alike(shingle_set(a, words), own, least))
            yield batch.select(["u", "v"]).filter(pa.array(yes))

    def verified(some: DataFrame) -> DataFrame:
        both = some.join(texts.toDF("u", "a"), "u").join(texts.toDF("v", "b"), "v").select("u", "v", "a", "b")
        return both.mapInArrow(verify, "u bigint, v bigint")

    def of_each(work: Callable[..., list[tuple[int, int]]], keys: int, text: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        """work: from the columns after the first `keys` of the rows that agree in these, which stand together, to links."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last, held = None, []

            def done() -> pa.RecordBatch:
                links = work(*zip(*held, strict=True))
                return pa.RecordBatch.from_arrays([pa.array([k[i] for k in links], pa.int64()) for i in (0, 1)], names=["u", "v"])

            for batch in chunks(batches, text):
                for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if row[:keys] != last and held:
                        yield done()
                        held = []
                    last = row[:keys]
                    held.append(row[keys:])
            if held:
                yield done()

        return run

    def by_text(nodes: list[int], labels: list[int], texts: list[str | None]) -> list[tuple[int, int]]:
        return group_links(nodes, [shingle_set(t, words) for t in texts], least, labels)

    def by_parity(nodes: list[int], labels: list[int], sides: list[int], sizes: list[int], bits: list[bytes]) -> list[tuple[int, int]]:
        return cross_pairs(nodes, labels, sides, sizes, bits, least)

    def together(members: DataFrame, *keys: str) -> DataFrame:
        return members.repartition(*keys).sortWithinPartitions(*keys, "node")

    def within(members: DataFrame, seed: int) -> DataFrame:
        """Links within random parts of each shingle's members; members: token, node, label, kinds."""
        part = F.pmod(F.xxhash64("node", F.lit(seed)), F.ceil(F.col("kinds") / block)).cast("int")
        dealt = members.withColumn("part", part).join(texts, "node").select("token", "part", "node", "label", "text")
        return together(dealt, "token", "part").mapInArrow(of_each(by_text, 2, 4), "u bigint, v bigint")

    def with_labels(members: DataFrame, links: DataFrame) -> DataFrame:
        return members.join(components(links), "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root")

    most = stored(crowded.groupBy("node").agg(F.max(F.struct("kinds", "token")).alias("most")).select(F.col("most.token").alias("token"), "node", F.col("most.kinds").alias("kinds")))
    first = stored(verified(pairs).unionByName(within(most.withColumn("label", F.col("node")), 0)).distinct())
    parted = most.filter(F.col("kinds") > block)
    if not parted.isEmpty():  # parts of other members join the parts' groups
        more = stored(first.unionByName(within(with_labels(parted, first), 1)).distinct())
        discard(first)
        first = more
    labelled = stored(with_labels(crowded, first).select("token", "node", "label", "n", "kinds"))
    open_tokens = stored(labelled.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("token"))
    open_members = stored(labelled.join(open_tokens, "token", "left_semi"))
    apart = in_blocks(open_members, block).join(sketches, "node").select("token", "a", "b", "node", "label", "side", "n", "bits")
    apart = stored(together(apart, "token", "a", "b").mapInArrow(of_each(by_parity, 3, 7), "u bigint, v bigint").distinct())
    links = stored(first.unionByName(verified(apart)).distinct())
    for done in (sizes, pairs, near, crowded, marks, texts, most, first, labelled, open_tokens, open_members, apart):
        discard(done)
    return links
