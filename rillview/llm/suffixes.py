"""Exact removal of repeated substrings by longest-previous-factor arrays in suffix order.

Every byte that lies in a `LENGTH`-byte string which also starts earlier (smaller doc_id, or same document and earlier
start) goes. A string's anchor is the leftmost `GRAM`-byte gram with the least hash in it, so equal strings have equal anchors at
equal places. The strings of a document that share an anchor occurrence form a run; its bytes are the run's context.

1. Anchors that stand once in the whole corpus have no repeats; counts (summed before the shuffle) drop them.
2. Runs with equal contexts repeat the first of them whole.
3. First runs of different contexts with one anchor meet: their contexts are laid end to end in the order of the corpus, a
   suffix order to depth LENGTH is built, and a position whose longest previous factor reaches LENGTH repeats another.
   Suffixes that agree to that depth stand in order of position, so the previous smaller position in suffix order is the
   direct neighbour before, and the next smaller one cannot agree.
   An anchor with more than `CROWD` contexts is spread by string instead: each string's first place is found by its hash.
4. Each document's spans are merged and cut out.

Defined cases: null and empty texts keep the empty text; rows of one doc_id and equal texts stand at one place, so neither
removes from the other, and each gets a row; null ids come before all others (and count as one document);
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillview.llm.common import chunks, discard, stored

LENGTH, GRAM = 100, 24
CROWD = 2000
#: A place holds the start (below 2^31, as texts are) and, below it, these many bits of the text's hash, which tell rows of one id apart.
TEXT_BITS = 32
#: A run's length and its anchor's offset are packed.
PACK = 128
#: Bytes of contexts that are laid end to end and sorted at once (about 40 times that in memory); a single anchor may need more.
SORT_BYTES = 1 << 20


def words_at(b: np.ndarray) -> np.ndarray:
    """The eight bytes at each place, as one big-endian number."""
    n = len(b) - 7
    out = np.empty(n, np.uint64)
    for o in range(8):
        m = (n - o + 7) // 8
        if m > 0:
            out[o::8] = b[o : o + 8 * m].view(">u8")
    return out


def runs(b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First string start, number of strings, anchor place and anchor hash of each run."""
    n = len(b) - LENGTH + 1
    x = words_at(b)
    with np.errstate(over="ignore"):
        h = x[:-16] * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h = (h + x[8:-8]) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        h = (h + x[16:]) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
    key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    least, d, width = key, 1, LENGTH - GRAM + 1
    while 2 * d <= width:
        least = np.minimum(least[:-d], least[d:])
        d *= 2
    if d < width:
        least = np.minimum(least[: len(least) - (width - d)], least[width - d :])
    at = (least[:n] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return first, np.diff(np.append(first, n)), at[first], h[at[first]].view(np.int64)


def text_bits(data: bytes) -> int:
    return xxhash.xxh3_64_intdigest(data) & ((1 << TEXT_BITS) - 1)


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, 1):
        parts, ids, contexts = [], [], []
        for row, text in enumerate(batch.column(1).to_pylist()):
            data = (text or "").encode("utf-8", "replace")
            if len(data) < LENGTH:
                continue
            lo, own, at, anchor = runs(np.frombuffer(data, np.uint8))
            off = at - lo
            parts.append(((lo << TEXT_BITS) | text_bits(data), own * PACK + off, anchor))
            ids += [row] * len(lo)
            contexts += [xxhash.xxh3_64_intdigest(data[a:z], o) for a, z, o in zip(lo.tolist(), (lo + own + LENGTH - 1).tolist(), off.tolist(), strict=True)]
        if parts:
            place, size, anchor = (np.concatenate(c) for c in zip(*parts, strict=True))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int32())), pa.array(place), pa.array(size, pa.int32()), pa.array(anchor), pa.array(np.array(contexts, np.uint64).view(np.int64))], names=["doc_id", "place", "size", "anchor", "context"])


def repeated_starts(contexts: list[bytes]) -> list[np.ndarray]:
    """For each context its string starts whose longest previous factor, over all contexts laid end to end, reaches LENGTH."""
    lengths = np.array([len(c) for c in contexts])
    begin = np.cumsum(lengths) - lengths
    b = np.frombuffer(b"".join(contexts) + bytes(LENGTH), np.uint8)
    rank, depth = words_at(b), 8
    while depth < LENGTH:
        step = min(depth, LENGTH - depth)
        rank = np.unique(rank, return_inverse=True)[1].astype(np.uint64)
        rank = (rank[:-step] << np.uint64(32)) | rank[step:]
        depth += step
    valid = np.concatenate([np.arange(s, s + n - LENGTH + 1) for s, n in zip(begin, lengths, strict=True)])
    rank = rank[valid]
    order = np.argsort(rank, kind="stable")  # suffix order to depth LENGTH, ties by position
    again = np.zeros(len(valid), bool)
    again[order[1:]] = rank[order[1:]] == rank[order[:-1]]
    cuts = np.cumsum(lengths - LENGTH + 1)[:-1]
    return [np.flatnonzero(p) for p in np.split(again, cuts)]


def merged(starts: np.ndarray) -> list[tuple[int, int]]:
    """Runs of neighbouring numbers: first, count."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.concatenate([[True], np.diff(starts) > 1]))
    return list(zip(starts[cut].tolist(), np.diff(np.append(cut, len(starts))).tolist(), strict=True))


def _span_batch(ids: list, places: list, counts: list, kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(places, pa.int64()), pa.array(counts, pa.int32())], names=["doc_id", "place", "count"])


def _sorted_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In: anchor, doc_id, place, bytes, sorted. Out: spans of string starts that repeat."""
    ids, places, contexts, held, last, kind = [], [], [], 0, None, None

    def done() -> pa.RecordBatch:
        out = [(i, p + (s << TEXT_BITS), n) for i, p, starts in zip(ids, places, repeated_starts(contexts), strict=True) for s, n in merged(starts)]
        return _span_batch([o[0] for o in out], [o[1] for o in out], [o[2] for o in out], kind)

    for batch in batches:
        kind = batch.schema.field(1).type
        for anchor, i, p, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if held > SORT_BYTES and anchor != last:
                yield done()
                ids, places, contexts, held = [], [], [], 0
            last = anchor
            ids.append(i)
            places.append(p)
            contexts.append(c)
            held += len(c)
    if ids:
        yield done()


def repeated_spans(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """doc_id, place, count: runs of starts of LENGTH-byte strings that also start earlier."""
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = stored(docs.mapInArrow(_anchor_rows, f"doc_id {kind}, place bigint, size int, anchor bigint, context bigint"))
    # written first, as the counts below: adaptive execution can then split the join where an anchor has many rows
    often = stored(rows.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor"))
    again = stored(rows.join(often, "anchor", "left_semi").select(*rows.columns))
    discard(rows)
    discard(often)
    classes = stored(again.groupBy("anchor", "context").agg(F.min(F.struct("doc_id", "place", "size")).alias("first"), F.count("*").alias("n")))
    # 2. runs whose context stands earlier
    firsts = classes.filter("n > 1").select("anchor", "context", F.col("first.doc_id").alias("f_id"), F.col("first.place").alias("f_place"))
    whole = again.join(firsts, ["anchor", "context"]).filter(~(F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("place") == F.col("f_place"))))
    whole = whole.select("doc_id", "place", F.floor(F.col("size") / PACK).cast("int").alias("count"))
    # 3. first runs of anchors with several contexts
    several = stored(classes.groupBy("anchor").agg(F.count("*").alias("kinds")).filter("kinds > 1"))
    needed = classes.join(several, "anchor").select(F.col("first.doc_id").alias("n_id"), F.col("first.place").alias("place"), F.floor(F.col("first.size") / PACK).cast("int").alias("own"), "anchor", (F.col("kinds") > crowd).alias("crowded"))
    needed = needed.withColumn("bits", F.expr(f"place & {(1 << TEXT_BITS) - 1}"))
    needed = needed.groupBy("n_id", "bits").agg(F.collect_list(F.struct("place", "own", "anchor", "crowded")).alias("needs"))
    joined = docs.join(needed, docs["doc_id"].eqNullSafe(needed["n_id"])).select("doc_id", "text", "bits", "needs")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, 1):
            out = []
            for i, text, bits, needs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = (text or "").encode("utf-8", "replace")
                if text_bits(data) == bits:
                    out += [(n["anchor"], i, n["place"], n["crowded"], data[(lo := n["place"] >> TEXT_BITS) : lo + n["own"] + LENGTH - 1]) for n in needs]
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int64(), batch.schema.field(0).type, pa.int64(), pa.bool_(), pa.binary()))], names=["anchor", "doc_id", "place", "crowded", "bytes"])

    contexts = stored(joined.mapInArrow(cut, f"anchor bigint, doc_id {kind}, place bigint, crowded boolean, bytes binary"))
    spans = f"doc_id {kind}, place bigint, count int"
    calm = contexts.filter("NOT crowded").select("anchor", "doc_id", "place", "bytes").distinct()
    by_suffix = calm.repartition("anchor").sortWithinPartitions("anchor", F.col("doc_id").asc_nulls_first(), "place").mapInArrow(_sorted_groups, spans)

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(i, p + (s << TEXT_BITS), xxhash.xxh3_128_digest(c[s : s + LENGTH])) for i, p, c in zip(*(x.to_pylist() for x in batch.columns), strict=True) for s in range(len(c) - LENGTH + 1)]
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((batch.schema.field(0).type, pa.int64(), pa.binary()))], names=["doc_id", "place", "string"])

    crowded = contexts.filter("crowded").select("doc_id", "place", "bytes").mapInArrow(strings, f"doc_id {kind}, place bigint, string binary")
    first = crowded.groupBy("string").agg(F.min(F.struct("doc_id", "place")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    by_string = crowded.join(first, "string").filter(~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("place") == F.col("first.place")))).select("doc_id", "place", F.lit(1).alias("count"))
    return whole.unionByName(by_suffix).unionByName(by_string)


def covered(spans: list[dict], n: int) -> list[tuple[int, int]]:
    """Disjoint, maximal byte ranges of a text of n bytes that the spans' strings cover."""
    out: list[list[int]] = []
    for a, z in sorted(((p := s["place"] >> TEXT_BITS), min(n, p + s["count"] - 1 + LENGTH)) for s in spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return [(a, z) for a, z in out]


def _with_spans(docs: DataFrame, crowd: int) -> DataFrame:
    spans = repeated_spans(docs, crowd).groupBy(F.col("doc_id").alias("s_id")).agg(F.collect_list(F.struct("place", "count")).alias("the_spans"))
    return docs.join(spans, docs["doc_id"].eqNullSafe(spans["s_id"]), "left").drop("s_id")


def _own_ranges(text: str | None, spans: list[dict] | None) -> tuple[bytes, list[tuple[int, int]]]:
    data = (text or "").encode("utf-8", "replace")
    if not spans:
        return data, []
    bits = text_bits(data)
    return data, covered([s for s in spans if s["place"] & ((1 << TEXT_BITS) - 1) == bits], len(data))


def _kept(data: bytes, ranges: list[tuple[int, int]]) -> list[bytes]:
    """What lies between the ranges."""
    at, parts = 0, []
    for a, z in ranges:
        parts.append(data[at:a])
        at = z
    return [*parts, data[at:]]


def remove_repeats(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row."""
    frame = _with_spans(docs.select("doc_id", "text"), crowd)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, 1):
            done = [_own_ranges(t, s) for t, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([len(d) for d, _ in done], pa.int64()), pa.array([sum(z - a for a, z in r) for _, r in done], pa.int64()),
                pa.array([len(r) for _, r in done], pa.int64()), pa.array([hashlib.sha256(b"".join(_kept(d, r))).hexdigest() for d, r in done], pa.string()),
            ], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return frame.mapInArrow(run, f"doc_id {frame.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def without_repeats(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """docs with repeated bytes cut out of `text`; a text of which nothing but white space is left goes, if anything was cut. A range that begins or ends within a character takes the character's remaining bytes along. n_chars, if there, is counted anew."""
    at, n = docs.columns.index("text"), len(docs.columns)
    # the columns under names of our own, as those of docs may be anything
    named = docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(docs.columns)])
    frame = _with_spans(named, crowd).drop("doc_id", "text")
    chars = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, at):
            texts, keep = [], []
            for t, s in zip(batch.column(at).to_pylist(), batch.column(n).to_pylist(), strict=True):
                data, ranges = _own_ranges(t, s)
                left = "".join(p.decode("utf-8", "ignore") for p in _kept(data, ranges)) if ranges else t  # part by part: no new character arises at a cut
                texts.append(left)
                keep.append(not ranges or bool(left.strip()))
            columns = list(batch.columns[:n])
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            if chars is not None:
                columns[chars] = pa.array([old if new == t else len(new or "") for old, new, t in zip(columns[chars].to_pylist(), texts, batch.column(at).to_pylist(), strict=True)], batch.schema.field(chars).type)
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema([batch.schema.field(i) for i in range(n)])).filter(pa.array(keep))

    return frame.mapInArrow(run, named.drop("doc_id", "text").schema).toDF(*docs.columns)
