"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Every distinct fingerprint emits all variants within half the radius (itself and each single flipped bit, for radius 2);
fingerprints that meet in a variant differ in at most `radius` bits. As any two in a variant's bucket are linked, the
bucket links each to its smallest one (no pairs within a bucket are made); every link is verified by its bit count, and a
bucket holds 65 fingerprints at most. Components grow by alternating large-star and small-star rounds over tables in the shared
folder; nothing is collected.

Defined cases: a text that is null, empty or without words has fingerprint zero, which links like any other; a null
doc_id takes part in linking but is never a component's id (a component of null ids only has a null id); repeated rows are
kept, each with the same result; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rillview.llm.common import chunks, discard, stored

SEED = 42


def shingle_hashes(text: str | None, words: int = 3) -> list[int]:
    w = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z only, ASCII white space
    if not w:
        return []
    if len(w) < words:
        return [xxhash.xxh64_intdigest(b" ".join(w), SEED)]
    return [xxhash.xxh64_intdigest(b" ".join(s), SEED) for s in zip(*(w[i:] for i in range(words)), strict=False)]


def fingerprint(hashes: list[int]) -> int:
    """Bit b is 1 if it is set in over half of the hashes; signed, as Spark's bigint."""
    if not hashes:
        return 0
    bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = bits.sum(axis=0, dtype=np.int64) * 2 > len(hashes)
    return int(np.packbits(ones, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """The columns of docs but text, and fp (bigint)."""
    rest = [c for c in docs.columns if c != "text"]
    frame = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(rest)], F.col("text").alias("the_text"))
    n = len(rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, n):
            fps = [fingerprint(shingle_hashes(t, words)) for t in batch.column(n).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(fps, pa.int64())], names=[*[f"k{i}" for i in range(n)], "fp"])

    return frame.mapInArrow(run, ", ".join([*[f"k{i} {frame.schema[i].dataType.simpleString()}" for i in range(n)], "fp bigint"])).toDF(*rest, "fp")


def links(fps: DataFrame) -> DataFrame:
    """u > v for distinct fingerprints (column fp) that share a variant, each with its bucket's smallest; the union of the stars spans all links at 2 or fewer bits."""
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << b if b < 63 else -(1 << 63)).cast("long") for b in range(64)])
    emitted = fps.select("fp", F.explode(flips).alias("flip")).select("fp", F.expr("fp ^ flip").alias("variant"))
    met = emitted.withColumn("least", F.min("fp").over(Window.partitionBy("variant")))
    verified = met.filter("fp <> least AND bit_count(fp ^ least) <= 2")
    return verified.select(F.col("fp").alias("u"), F.col("least").alias("v")).distinct()


def ball_links(fps: DataFrame, radius: int) -> DataFrame:
    """u > v for distinct fingerprints (column fp) that differ in `radius` bits at most.

    The bits are split into parts of which two such fingerprints differ in one by 2 bits at most, and the balls are those of each part. As not
    all in such a bucket are linked, each is compared with the bucket's smallest and the one before it: buckets of over three can miss links."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    parts = radius // 3 + 1
    edges = [64 * i // parts for i in range(parts + 1)]
    balls = [(i, (1 << b) - (1 << a), flip) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) for flip in (0, *(1 << k for k in range(a, b)))]
    structs = [F.struct(F.lit(i).alias("part"), F.lit(signed(mask)).cast("long").alias("mask"), F.lit(signed(flip)).cast("long").alias("flip")) for i, mask, flip in balls]
    emitted = fps.select("fp", F.inline(F.array(*structs))).select("fp", "part", F.expr("(fp & mask) ^ flip").alias("variant"))
    bucket = Window.partitionBy("part", "variant").orderBy("fp")
    met = emitted.select("fp", F.first("fp").over(bucket).alias("least"), F.lag("fp").over(bucket).alias("before")).filter("fp <> least")
    both = met.select(F.col("fp").alias("u"), F.explode(F.array("least", "before")).alias("v"))
    return both.filter(f"bit_count(u ^ v) <= {int(radius)}").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root (the smallest node of its component) for nodes of edges u > v, by alternating stars."""
    now = stored(edges)
    for _ in range(most_rounds):
        # large star: neighbours larger than the node go to its smallest neighbour (or itself)
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = stored(both.filter("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct())
        # small star: neighbours not larger than the node, and the node, go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "w")
        joined = large.join(least, F.col("u") == F.col("w"))
        small = stored(joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("w").alias("u"), F.col("m").alias("v"))).filter("u <> v").distinct())
        discard(large)
        # at the end each node has one link, to a root that has none
        state = lambda df: df.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)))
        same = tuple(state(now).first()) == tuple(state(small).first())
        discard(now)
        now = small
        if same:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    raise RuntimeError("components did not settle")


def _grouped(docs: DataFrame, words: int) -> tuple[DataFrame, DataFrame]:
    """docs with fp instead of text; and fp, root (its component's smallest fingerprint), first (its smallest doc_id)."""
    rows = stored(fingerprints(docs, words))
    least = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    rooted = components(links(least.select("fp")))
    return rows, least.join(rooted, least.fp == rooted.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, fingerprint, component_id for every row."""
    rows, placed = _grouped(docs.select("doc_id", "text"), words)
    # the components' smallest ids; only fingerprints with links can differ from their own
    root = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    whose = placed.select("fp", "root").join(root, "root").select("fp", "component_id")
    return rows.join(whose, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, words: int = 3, similarity: float | None = None) -> DataFrame:
    """The row of docs with the smallest doc_id of each component (if that id has several texts in it, the one with the least hash; one of its repeated rows), and all rows without an id; with the columns of docs.

    Without `similarity`, components of fingerprints; with it, of texts whose shingle sets have at least that Jaccard similarity."""
    if similarity is None:
        rows, placed = _grouped(docs.select("doc_id", "text", F.xxhash64("text").alias("bits")), words)
    else:
        from rillview.llm.similar import similar_links

        rows = docs.select("doc_id", F.xxhash64("text").alias("bits"), F.xxhash64("text").alias("fp"))
        placed = components(similar_links(docs.select("text"), words, similarity)).select(F.col("node").alias("fp"), "root")
    named = rows.filter("doc_id IS NOT NULL").groupBy("fp").agg(F.min(F.struct("doc_id", "bits")).alias("least"))
    first = named.join(placed.select("fp", "root"), "fp", "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("least").alias("least"))
    first = first.select(F.col("least.doc_id").alias("f_id"), F.col("least.bits").alias("f_bits"))
    keyed = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(docs.columns)], F.col("doc_id").alias("the_id"), F.xxhash64("text").alias("the_bits"))
    kept = keyed.filter("the_id IS NOT NULL").join(first, (F.col("the_id") == F.col("f_id")) & (F.col("the_bits") == F.col("f_bits")), "left_semi").dropDuplicates(["the_id", "the_bits"])
    return kept.unionByName(keyed.filter("the_id IS NULL")).drop("the_id", "the_bits").toDF(*docs.columns)
