"""Quality scores: random Fourier features, ridge regression, isotonic calibration.

Every text gives statistics (shares of kinds of characters, lengths, repetition of words and lines). Standardised, they
pass through random Fourier features of a Gaussian kernel; the normal equations are summed by partition and added up, the
ridge weights solved on the driver (their size is fixed by `features`). Raw scores of the learning rows, counted in
`LEVELS` equal steps, give an isotonic calibration to probabilities.

Defined cases: null and empty texts have all-zero statistics and are scored like others; without a learning row every
score is 0.5; a doc_id labelled more than once counts with the mean of its labels; rows with null ids are scored but
never labelled; repeated rows are scored each; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillview.llm.common import chunks, fold, stored

N_STATS = 18
LEVELS = 4096
LOW, HIGH = -1.0, 2.0  # raw scores beyond fall in the outermost steps


def statistics(text: str | None) -> list[float]:
    if not text:
        return [0.0] * N_STATS
    n = len(text)
    c = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    total = max(1, int(c.sum()))
    share = lambda *spans: float(sum(c[a:b].sum() for a, b in spans)) / total
    words = text.split()
    m = max(1, len(words))
    counts = Counter(words)
    lines = text.split("\n")
    p = c / total
    p = p[p > 0]
    marks = c.copy()
    marks[48:58] = marks[65:91] = marks[97:123] = marks[128:] = 0
    marks[[32, 10]] = 0
    return [
        np.log1p(n), np.log1p(len(words)), sum(map(len, counts.elements())) / m / 10, share((65, 91)), share((48, 58)), share((128, 256)),
        marks.sum() / total, marks.max() / total, float(c[33] + c[63]) / total, float(c[124]) / total, share((35, 39), (42, 43)),
        share((32, 33)), len(counts) / m, (counts.most_common(1)[0][1] / m) if words else 0.0, len(set(lines)) / len(lines),
        n / len(lines) / 500, float(-(p * np.log(p)).sum()) / 5, np.sqrt(len(counts) / m) * np.log1p(m) / 5,
    ]


def all_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, stats for every row."""
    frame = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, 1):
            rows = [np.asarray(statistics(t), np.float64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tolist() for r in rows], pa.list_(pa.float64()))], names=["doc_id", "stats"])

    return frame.mapInArrow(run, f"doc_id {frame.schema['doc_id'].dataType.simpleString()}, stats array<double>")


class Kernel:
    """z(x) = sqrt(2 / D) cos(W x + b) and the scaling of x before."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, features: int, width: float, seed: int):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.w = rng.standard_normal((len(mean), features)) / width
        self.b = rng.uniform(0, 2 * np.pi, features)
        self.coef = np.zeros(features + 1)

    def z(self, x: np.ndarray) -> np.ndarray:
        x = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([np.sqrt(2 / len(self.b)) * np.cos(x @ self.w + self.b), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.z(x) @ self.coef


def isotonic(value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the non-decreasing sequence nearest to value."""
    blocks: list[list[float]] = []
    for v, w in zip(value, weight, strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks.pop()
            blocks.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.repeat([b[0] for b in blocks], [int(b[2]) for b in blocks])


def _matrix(batch: pa.RecordBatch, column: int) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def fit_kernel(rows: DataFrame, features: int, width: float, ridge: float, seed: int) -> Kernel | None:
    """rows: stats, label. Means and normal equations over all rows; what reaches the driver is of fixed size."""
    moments = rows.select(*[F.avg(F.col("stats")[i]).alias(f"m{i}") for i in range(N_STATS)], *[F.stddev_pop(F.col("stats")[i]).alias(f"s{i}") for i in range(N_STATS)]).first()
    if moments["m0"] is None:
        return None
    kernel = Kernel(np.array([moments[f"m{i}"] for i in range(N_STATS)]), np.array([max(moments[f"s{i}"], 1e-6) for i in range(N_STATS)]), features, width, seed)
    shared = rows.sparkSession.sparkContext.broadcast(kernel)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sums = shared.value, 0.0
        for batch in batches:
            if batch.num_rows:
                z, y = own.z(_matrix(batch, 0)), batch.column(1).to_numpy(zero_copy_only=False)
                sums = sums + z.T @ np.hstack([z, y[:, None]])
        if isinstance(sums, np.ndarray):
            yield pa.RecordBatch.from_arrays([pa.array(range(len(sums)), pa.int32()), pa.array(list(sums), pa.list_(pa.float64()))], names=["i", "v"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), _matrix(batch, 1) if batch.num_rows else (), strict=True):
                sums[i] = sums[i] + v if i in sums else v.copy()
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(list(sums.values()), pa.list_(pa.float64()))], names=["i", "v"])

    partial = rows.select("stats", F.col("label").cast("double")).mapInArrow(part, "i int, v array<double>")
    found = {r["i"]: r["v"] for r in partial.repartition("i").mapInArrow(add, "i int, v array<double>").collect()}
    sums = np.array([found[i] for i in range(len(found))])
    a = sums[:, :-1] + ridge * np.eye(len(sums))
    a[-1, -1] -= ridge * 0.999
    kernel.coef = np.linalg.solve(a, sums[:, -1])
    return kernel


def quality_scores(docs: DataFrame, labels: DataFrame, features: int = 256, width: float = 4.0, ridge: float = 1.0, threshold: float = 0.3, seed: int = 7) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs. labels: doc_id, quality (0 or 1)."""
    spark = docs.sparkSession
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.avg(F.col("quality").cast("double")).alias("label"))
    rows = stored(all_statistics(docs).join(known, "doc_id", "left").withColumn("held_out", held_out(F.col("doc_id"))))
    learn = rows.filter(~F.col("held_out") & F.col("label").isNotNull())
    kernel = fit_kernel(learn, features, width, ridge, seed)
    steps, values = np.array([0.0]), np.array([0.5])
    if kernel is not None:
        raw = spark.sparkContext.broadcast(kernel)

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array(raw.value.raw(_matrix(batch, 0)), pa.float64()), batch.column(1)], names=["raw", "label"])

        level = F.least(F.lit(LEVELS - 1), F.greatest(F.lit(0), F.floor((F.col("raw") - LOW) / (HIGH - LOW) * LEVELS)))
        counted = learn.select("stats", "label").mapInArrow(score, "raw double, label double").groupBy(level.alias("level")).agg(F.avg("label").alias("y"), F.count("*").alias("n")).collect()
        counted.sort(key=lambda r: r["level"])
        weight = np.array([r["n"] for r in counted], float)
        steps = LOW + (np.array([r["level"] for r in counted]) + 0.5) / LEVELS * (HIGH - LOW)
        values = isotonic(np.array([r["y"] for r in counted]), weight)
    shared = spark.sparkContext.broadcast((kernel, steps, values))

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, x, y = shared.value
        for batch in batches:
            if batch.num_rows:
                found = np.interp(own.raw(_matrix(batch, 2)), x, y) if own is not None else np.full(batch.num_rows, 0.5)
                found = np.clip(found + 1e-6 * (np.tanh(own.raw(_matrix(batch, 2))) if own is not None else 0), 0, 1)  # order within a level
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.float64()), pa.array((found >= threshold).astype(np.int32), pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    return rows.select("doc_id", "held_out", "stats").mapInArrow(final, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def held_out(doc_id: Column) -> Column:
    return fold(doc_id, 5) == 0
