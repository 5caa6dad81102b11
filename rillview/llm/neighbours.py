"""Nearest neighbours by largest inner product: stable projections, kd-trees, a chi-square stopping test.

Vectors get one more component that makes all norms equal, so that the largest inner product is the smallest Euclidean
distance. The others are projected to `m` dimensions by one fixed Gaussian matrix. A kd-tree over a bounded sample of projections deals
every vector to a cell; the cells' own bounding boxes are then measured over all vectors. As the squared projected distance over
the squared true one is chi-square with m degrees of freedom, a vector at most as far as a query's present k-th is projected
beyond `limit` times that squared distance (the quantile of `sure`) with probability 1 - sure at most.

1. Each query searches the `HOMES` cells nearest to its projection and so gets a first k-th distance.
2. Then it visits the other cells whose box the test admits, and no more.

Within a cell a smaller kd-tree hands out leaves in order of projected distance; only vectors whose own projected distance passes
the test are verified with exact inner products, and the query stops when the next leaf fails it. A cell goes to tasks in parts of
about `cell_rows` vectors, each with about `query_rows` of its counted visitors, so that no group grows with the tables.

Identical vectors compete only by id: of each, the k + 1 smallest ids go to the cells, which loses no result.

How much the test saves depends on the vectors: where a query's k-th is hardly nearer than the others are (vectors without any
structure, such as uniform random ones), no low-dimensional projection can tell them apart and about half are verified.
`verified` tells.

Defined cases: vectors that are null, empty, zero or hold a null or non-finite component take no part, nor do rows with null
ids; inner products need vectors of one length, so of several lengths only the most common (the greater, if tied) takes part; repeated
rows count once, and so do rows of one id with different vectors (the one with the smaller hash counts); ties go to the smaller id;
with fewer than k candidates all are returned; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, exp, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rillview.llm.common import discard, stored

LEAF, AHEAD, SEED = 32, 4, 11
#: Cells that a query searches first.
HOMES = 4
NO_ID = np.iinfo(np.int64).max


def chi_square_quantile(p: float, m: int) -> float:
    """For an even number m of degrees of freedom."""

    def cdf(x: float) -> float:
        term = total = 1.0
        for i in range(1, m // 2):
            term *= x / 2 / i
            total += term
        return 1 - exp(-x / 2) * total

    low, high = 0.0, 100.0 * m
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid) < p else (low, mid)
    return high


class Projection:
    """The Gaussian matrix for vectors of `dim` components and norms up to `top`, and the test's factor. The component that makes norms equal is not projected (it is far from random), but kept as a last dimension that weighs `limit` times."""

    def __init__(self, dim: int, m: int, top: float, sure: float):
        self.matrix, self.top, self.limit = np.random.default_rng(SEED).standard_normal((dim, m)), top, chi_square_quantile(sure, m)

    def points(self, vectors: np.ndarray) -> np.ndarray:
        rest = np.sqrt(self.limit * np.maximum(0, self.top**2 - (vectors**2).sum(1)))
        return np.hstack([vectors @ self.matrix, rest[:, None]])

    def queries(self, vectors: np.ndarray) -> np.ndarray:
        return np.hstack([vectors @ self.matrix, np.zeros((len(vectors), 1))])


class Cells:
    """A complete kd-tree of `depth` levels over a sample; each level halves the widest dimension."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth = depth
        self.dims, self.at = np.zeros(1 << depth, np.int64), np.zeros(1 << depth)
        own = {1: sample}
        for node in range(1, 1 << depth):
            p = own.pop(node)
            if len(p):
                d = int((p.max(0) - p.min(0)).argmax())
                self.dims[node], self.at[node] = d, np.median(p[:, d])
            right = p[:, self.dims[node]] >= self.at[node]
            own[2 * node], own[2 * node + 1] = p[~right], p[right]

    def of(self, points: np.ndarray) -> np.ndarray:
        node = np.ones(len(points), np.int64)
        for _ in range(self.depth):
            node = 2 * node + (points[np.arange(len(points)), self.dims[node]] >= self.at[node])
        return node - (1 << self.depth)


class KdTree:
    """Leaves of a tree that halves the widest dimension; order: places of the points, leaf after leaf."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(points))
        edges, todo = [], [(0, len(points))]
        while todo:
            a, z = todo.pop()
            own = self.order[a:z]
            if z - a <= leaf:
                edges.append((a, z))
                continue
            p = points[own]
            d = int((p.max(0) - p.min(0)).argmax())
            mid = (z - a) // 2
            self.order[a:z] = own[np.argpartition(p[:, d], mid)]
            todo += [(a + mid, z), (a, a + mid)]
        edges.sort()
        self.edges = np.array(edges, dtype=np.int64).reshape(-1, 2)
        self.low = np.array([points[self.order[a:z]].min(0) for a, z in edges])
        self.high = np.array([points[self.order[a:z]].max(0) for a, z in edges])


def box_distances(p: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of each point to each box, a row for each point."""
    out = np.zeros((len(p), len(low)))
    for d in range(p.shape[1]):
        out += np.maximum(0, np.maximum(low[None, :, d] - p[:, None, d], p[:, None, d] - high[None, :, d])) ** 2
    return out


def search(vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, bounds: np.ndarray, k: int, projection: Projection) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """For each query the ids and scores of its k nearest of these vectors, nearest first, and how many were verified. bounds: scores that a result must reach (-inf: none)."""
    points = projection.points(vectors)
    tree = KdTree(points)
    vectors, ids, points = vectors[tree.order], ids[tree.order], points[tree.order]
    out = []
    width = int((tree.edges[:, 1] - tree.edges[:, 0]).max())
    for first in range(0, len(queries), 128):
        q, q_ids, least = (x[first : first + 128] for x in (queries, query_ids, bounds))
        p = projection.queries(q)
        near = box_distances(p, tree.low, tree.high)
        order = np.argsort(near, axis=1)
        near = np.take_along_axis(near, order, 1)
        norms = (q**2).sum(1) + projection.top**2
        best_s, best_i = np.full((len(q), k), -np.inf), np.full((len(q), k), NO_ID)
        live, verified = np.arange(len(q)), np.zeros(len(q), np.int64)
        for at in range(0, len(tree.edges), AHEAD):
            worst = np.maximum(0, norms[live] - 2 * np.maximum(best_s[live, -1], least[live]))  # squared distance of the k-th so far
            radius = projection.limit * worst + 1e-9 * norms[live]
            on = near[live, at] <= radius
            live, radius = live[on], radius[on]
            if not len(live):
                break
            leaves = tree.edges[order[live, at : at + AHEAD]]
            place = leaves[:, :, :1] + np.arange(width)
            valid = (place < leaves[:, :, 1:]).reshape(len(live), -1)
            place = np.where(valid, place.reshape(len(live), -1), 0)
            off = points[place] - p[live][:, None]
            valid &= (np.einsum("qcd,qcd->qc", off, off) <= radius[:, None]) & (ids[place] != q_ids[live, None])
            row, column = np.nonzero(valid)
            verified[live] += valid.sum(1)
            s = np.full(valid.shape, -np.inf)
            s[row, column] = np.einsum("nd,nd->n", vectors[place[row, column]], q[live[row]])
            i = np.where(valid, ids[place], NO_ID)
            all_s, all_i = np.hstack([best_s[live], s]), np.hstack([best_i[live], i])
            kept = np.lexsort((all_i, -all_s), axis=1)[:, :k]
            best_s[live], best_i[live] = np.take_along_axis(all_s, kept, 1), np.take_along_axis(all_i, kept, 1)
        for s, i, n in zip(best_s, best_i, verified, strict=True):
            some = np.isfinite(s)
            out.append((i[some], s[some], int(n)))
    return out


def usable(rows: DataFrame, id_column: str, vector_column: str) -> tuple[DataFrame, int]:
    """id, v (array<double>): the rows that take part, each id once; and the length of v."""
    v = F.col(vector_column).cast("array<double>")
    rows = rows.select(F.col(id_column).cast("long").alias("id"), v.alias("v")).filter("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0 AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists(v, x -> x <> 0)")
    lengths = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), F.desc("n")).first()
    dim = lengths["n"] if lengths else 0
    return rows.filter(F.size("v") == dim).groupBy("id").agg(F.min_by("v", F.xxhash64("v")).alias("v")), dim


def _matrix(column: pa.Array | pa.ChunkedArray, n: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def _visited(placed: DataFrame, queries: DataFrame, parts: dict[int, int], query_rows: int, k: int, projection: Projection) -> DataFrame:
    """query_id, vec_id, score, verified of each query (q_id, q_v, bound, cells) in each of its cells; a row without vec_id tells how many were verified."""
    spark = placed.sparkSession
    visits = queries.select("q_id", "q_v", "bound", F.explode("cells").alias("cell"))
    visitors = {r["cell"]: r["n"] for r in visits.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # a row for each cell at most
    plan = F.broadcast(spark.createDataFrame([(c, parts[c], ceil(n / query_rows)) for c, n in visitors.items()], "cell int, parts int, copies int"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = placed.select("id", "v", "cell").join(plan, "cell").select("id", "v", "cell", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part"), every("copies").alias("copy"))
    right = visits.join(plan, "cell").select("q_id", "q_v", "bound", F.col("cell").alias("q_cell"), F.pmod(F.xxhash64("q_id"), "copies").cast("int").alias("q_copy"), every("parts").alias("q_part"))

    def run(key: tuple, own: pa.Table, asked: pa.Table) -> pa.Table:
        found = []
        if own.num_rows and asked.num_rows:
            bounds = asked.column("bound").to_numpy()
            found = search(_matrix(own.column("v"), own.num_rows), own.column("id").to_numpy(), _matrix(asked.column("q_v"), asked.num_rows), asked.column("q_id").to_numpy(), bounds, k, projection)
        out = [(q, None, None, n) for q, (_, _, n) in zip(asked.column("q_id").to_pylist(), found, strict=False)]
        out += [(q, i, s, 0) for q, (ids, scores, _) in zip(asked.column("q_id").to_pylist(), found, strict=False) for i, s in zip(ids.tolist(), scores.tolist(), strict=True)]
        return pa.table({name: pa.array([o[j] for o in out], t) for j, (name, t) in enumerate((("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64()), ("verified", pa.int64())))})

    return left.groupBy("cell", "part", "copy").cogroup(right.groupBy("q_cell", "q_part", "q_copy")).applyInArrow(run, "query_id bigint, vec_id bigint, score double, verified bigint")


def nearest(rows: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", every: int = 20, k: int = 20, m: int = 16, sure: float = 0.9, cell_rows: int = 4_096, query_rows: int = 512, sample: int = 50_000, most_depth: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score, verified: for each row whose id is divisible by `every` its k nearest of all other rows. sample: of how many projections, about, the cells' tree is made; most_depth: its levels at most (larger cells go in parts); verified: of how many vectors the query's exact inner product was taken."""
    rows, dim = usable(rows, id_column, vector_column)
    rows = stored(rows)
    facts = rows.agg(F.count("*").alias("n"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).alias("top")).first()
    projection = Projection(dim, m, facts["top"] or 0.0, sure)
    # of identical vectors the k + 1 smallest ids, in two steps so that no group meets in one task whole
    same = rows.select("id", F.xxhash64("v").alias("h1"), F.hash("v").alias("h2"), F.pmod(F.xxhash64("id"), F.lit(256)).alias("salt"))
    for keys in (["h1", "h2", "salt"], ["h1", "h2"]):
        same = same.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy("id"))).filter(F.col("nth") <= k + 1).drop("nth")
    candidates = rows.join(same.select("id"), "id", "left_semi")

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([p.tobytes() for p in projection.points(_matrix(batch.column(0), batch.num_rows))], pa.binary())], names=["p"])

    depth = max(0, min(most_depth, ceil(log2(max(1, facts["n"]) / cell_rows))))
    drawn = rows.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < min(1.0, sample / max(1, facts["n"])) * (1 << 30)).select("v")
    points = [np.frombuffer(r["p"]) for r in drawn.mapInArrow(project, "p binary").collect()] if depth else []
    cells = Cells(np.array(sorted(map(tuple, points))).reshape(-1, m + 1), depth)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                p = projection.points(_matrix(batch.column(1), batch.num_rows))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells.of(p), pa.int32()), pa.array(list(p), pa.list_(pa.float64()))], names=["id", "v", "cell", "p"])

    placed = stored(candidates.select("id", "v").mapInArrow(place, "id bigint, v array<double>, cell int, p array<double>"))
    boxes = placed.groupBy("cell").agg(F.count("*").alias("n"), *[f(F.col("p")[i]).alias(f"{s}{i}") for i in range(m + 1) for f, s in ((F.min, "l"), (F.max, "h"))]).collect()  # 2 ** most_depth at most
    boxes.sort(key=lambda b: b["cell"])
    numbers = np.array([b["cell"] for b in boxes])
    low, high = (np.array([[b[f"{s}{i}"] for i in range(m + 1)] for b in boxes]).reshape(-1, m + 1) for s in "lh")
    parts = {b["cell"]: ceil(b["n"] / cell_rows) for b in boxes}

    def deal(admit: bool):
        """The cells of each query: the nearest ones, or all others that the test admits."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                q = _matrix(batch.column(1), batch.num_rows)
                near = box_distances(projection.queries(q), low, high)
                homes, bound = np.argsort(near, axis=1, kind="stable")[:, :HOMES], batch.column(2).to_numpy(zero_copy_only=False)
                if admit:
                    norms = (q**2).sum(1) + projection.top**2
                    yes = near <= (projection.limit * np.maximum(0, norms - 2 * bound) + 1e-9 * norms)[:, None]
                    np.put_along_axis(yes, homes, False, 1)
                    own = [numbers[y].tolist() for y in yes]
                else:
                    own = numbers[homes].tolist()
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.list_(pa.int32()))], names=["q_id", "q_v", "bound", "cells"])

        return run

    kinds = "q_id bigint, q_v array<double>, bound double, cells array<int>"
    queries = rows.filter(F.col("id") % every == 0).select(F.col("id").alias("q_id"), F.col("v").alias("q_v"))
    none = F.lit(float("-inf"))
    if not boxes:
        found, own = rows.select(F.col("id").alias("query_id"), F.col("id").alias("vec_id"), none.alias("score"), F.lit(0).cast("long").alias("verified")).limit(0), []
    else:
        asked = stored(queries.withColumn("bound", none).mapInArrow(deal(False), kinds))
        found, own = stored(_visited(placed, asked, parts, query_rows, k, projection)), [asked]
        if len(boxes) > HOMES:
            reached = found.filter("vec_id IS NOT NULL").groupBy("query_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("score"), False).alias("scores"))  # k for each part of the first cells at most
            reached = reached.filter(F.col("n") >= k).select("query_id", F.col("scores")[k - 1].alias("reached"))
            again = stored(queries.join(reached, F.col("q_id") == F.col("query_id"), "left").select("q_id", "q_v", F.coalesce("reached", none).alias("bound")).mapInArrow(deal(True), kinds).filter(F.size("cells") > 0))
            more = stored(_visited(placed, again, parts, query_rows, k, projection))
            own += [found, again, more]
            found = found.unionByName(more)
        else:
            own.append(found)
    of_query = Window.partitionBy("query_id")
    ranked = found.withColumns({"verified": F.sum("verified").over(of_query), "rank": F.row_number().over(of_query.orderBy(F.desc_nulls_last("score"), "vec_id"))})
    out = stored(ranked.filter((F.col("rank") <= k) & F.col("vec_id").isNotNull()).select("query_id", "rank", "vec_id", "score", "verified"))
    for done in (rows, placed, *own):
        discard(done)
    return out
