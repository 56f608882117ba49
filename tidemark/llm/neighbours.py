"""Operator 2: approximate nearest neighbours by inner product, with 2-stable projections in a kd-tree.

Vectors get one more coordinate that makes all lengths equal, queries are scaled to that length, so the largest inner product is the
smallest distance. Gaussian projections take both to M dimensions; the ratio of squared projected and original
distance then follows a chi-square law with M degrees of freedom. A kd-tree over the projected points has two levels: cells, cut at
medians of a bounded sample, whose rows are stored together in shards of a bounded size; and leaves inside each shard.

A query takes projected neighbours leaf by leaf and verifies them on original vectors, until the law says that a point at
the next one's projected distance has been as close as the k-th best with a chance of under 1 - CONFIDENCE: this test holds for a point, a
leaf and a cell alike. Queries go to one shard of their own cell first; with the k-th best that they bring from there they go on to all
shards of those cells that the test doesn't exclude.

Every row is indexed and stored once; a shard's rows stay where they are and its queries stream past them in batches, so memory is
bounded by a shard and a batch. No candidate is capped. Equal vectors are one point of the index, which keeps its k + 1 smallest ids,
more than any query can return.

Cases: vectors that are null, zero, or hold null or non-finite components take no part, nor do those of another
length than most; rows with equal ids count once, with the smallest vector; ties go to the smaller id; with under
k candidates all are returned; an empty table gives an empty result; texts take no part; extra columns, whatever their names, are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import alone, kept, table

#: Projected dimensions, neighbours, and the confidence at which the search stops.
M, NEIGHBOURS, CONFIDENCE = 12, 20, 0.97
#: Rows in a shard, points in a leaf, leaves verified between two tests, queries worked on at once.
SHARD, LEAF, STEP, QUERIES, SEED = 8192, 128, 4, 1024, 2
#: The cells are cut at medians of so many points at most, and there are 2 ** DEEPEST at most.
SAMPLE, DEEPEST = 20_000, 12
FOUND = "query_id long, vec_id long, score double"


def chi_square(x: np.ndarray) -> np.ndarray:
    """The law's distribution function for the even M."""
    half, term, total = x / 2, np.ones_like(x), np.zeros_like(x)
    for i in range(M // 2):
        total += term
        term = term * half / (i + 1)
    return 1 - np.exp(-half) * total


def stop_ratio() -> float:
    """The ratio of squared distances at which the stopping test holds: the law's quantile, by bisection."""
    low, high = 0.0, 100.0 * M
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(np.array([mid]))[0] < CONFIDENCE else (low, mid)
    return high


def projected(x: np.ndarray, longest: float, query: bool = False) -> np.ndarray:
    """Rows in M dimensions: points with the coordinate that makes them equally long, queries scaled to that length."""
    g = np.random.default_rng(SEED).standard_normal((x.shape[1] + 1, M))
    if query:
        return (x * (longest / np.linalg.norm(x, axis=1))[:, None]) @ g[:-1]
    return x @ g[:-1] + np.sqrt(np.maximum(longest**2 - (x * x).sum(1), 0))[:, None] * g[-1]


def cut_at_medians(p: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The upper kd-tree, as its nodes' axes and medians: node i has the children 2i + 1 and 2i + 2."""
    axis, at, groups = np.zeros(2**depth - 1, np.int64), np.zeros(2**depth - 1), {0: p}
    for node in range(2**depth - 1):
        part = groups.pop(node)
        if len(part):
            axis[node] = np.argmax(part.max(0) - part.min(0))
            at[node] = np.median(part[:, axis[node]])
        right = part[:, axis[node]] > at[node]
        groups[2 * node + 1], groups[2 * node + 2] = part[~right], part[right]
    return axis, at


def cell_of(p: np.ndarray, tree: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    axis, at = tree
    node = np.zeros(len(p), np.int64)
    for _ in range((len(axis) + 1).bit_length() - 1):
        node = 2 * node + 1 + (p[np.arange(len(p)), axis[node]] > at[node])
    return node - len(axis)


def gaps(p: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances from projected queries to boxes."""
    out = np.zeros((len(p), len(low)))
    for j in range(M):
        out += np.square(np.maximum(0, np.maximum(low[:, j] - p[:, j, None], p[:, j, None] - high[:, j])))
    return out


def leaves(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A kd-tree's leaves: points in leaf order, where each leaf starts, and its box."""
    order, starts, todo = np.arange(len(points)), [], [(0, len(points))]
    while todo:
        a, b = todo.pop()
        if b - a <= LEAF:
            starts.append(a)
            continue
        part = points[order[a:b]]
        axis, mid = int(np.argmax(part.max(0) - part.min(0))), (b - a) // 2
        order[a:b] = order[a:b][np.argpartition(part[:, axis], mid)]
        todo += [(a, a + mid), (a + mid, b)]
    starts = np.sort(np.array(starts))
    p = points[order]
    return order, np.append(starts, len(points)), np.minimum.reduceat(p, starts), np.maximum.reduceat(p, starts)


class Shard:
    """A shard's points (x, their smallest ids) with their kd-tree; `verified` counts the pairs that were."""

    def __init__(self, x: np.ndarray, first_id: np.ndarray, longest: float):
        self.longest, self.verified = longest, 0
        self.order, self.starts, self.low, self.high = leaves(projected(x, longest))
        self.x, self.ids = x[self.order], first_id[self.order]
        self.p, self.stop = projected(self.x, longest), stop_ratio()

    def search(self, queries: np.ndarray, k: int, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query the k best points found, best first: row numbers (-1: none) and inner products. bound: the k-th best inner product from elsewhere."""
        q, d = len(queries), queries.shape[1]
        length = np.linalg.norm(queries, axis=1)
        pq = projected(queries, self.longest, True)
        gap = gaps(pq, self.low, self.high)
        visit = np.argsort(gap, axis=1, kind="stable")
        best, score = np.full((q, k), -1), np.full((q, k), -np.inf)

        def beyond(rows: np.ndarray) -> np.ndarray:
            """The squared projected distance at which the test holds, for the k-th best so far."""
            kth = np.maximum(score[rows, -1], bound[rows])
            return np.where(np.isfinite(kth), self.stop * np.maximum(0, 2 * self.longest**2 - 2 * np.where(np.isfinite(kth), kth, 0) * self.longest / length[rows]), np.inf)

        active = np.flatnonzero(gap[np.arange(q), visit[:, 0]] <= beyond(np.arange(q)))
        for turn in range(0, len(self.low), STEP):
            if not len(active):
                break
            whose, which, values = [np.repeat(active, k)], [best[active].ravel()], [score[active].ravel()]
            now = visit[active, turn : turn + STEP].ravel()
            asked, by_leaf = np.repeat(active, now.size // len(active)), np.argsort(now, kind="stable")
            for part in np.split(by_leaf, np.flatnonzero(np.diff(now[by_leaf])) + 1):
                leaf, of = now[part[0]], asked[part]
                a, b = self.starts[leaf], self.starts[leaf + 1]
                away = (pq[of] ** 2).sum(1)[:, None] + (self.p[a:b] ** 2).sum(1) - 2 * pq[of] @ self.p[a:b].T
                near = away <= beyond(of)[:, None]
                some = np.flatnonzero(near.any(0))
                if not len(some):
                    continue
                got = queries[of] @ self.x[a:b][some].T
                self.verified += int(near.sum())
                i, j = np.nonzero(near[:, some] & (got >= np.maximum(score[of, -1], bound[of])[:, None]))
                whose.append(of[i])
                which.append(a + some[j])
                values.append(got[i, j])
            whose, which, values = (np.concatenate(v) for v in (whose, which, values))
            sort = np.lexsort((np.where(which >= 0, self.ids[which], np.iinfo(np.int64).max), -values, whose))
            sort = sort[np.arange(len(sort)) - np.searchsorted(whose[sort], whose[sort]) < k]
            best[active], score[active] = which[sort].reshape(-1, k), values[sort].reshape(-1, k)
            if turn + STEP < len(self.low):
                active = active[gap[active, visit[active, turn + STEP]] <= beyond(active)]
        return np.where(best >= 0, self.order[best], -1), score


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _place(tree: tuple, longest: float, query: bool):
    """Rows with the number of their cell, and for points each batch's boxes by cell and axis."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                yield b.append_column("cell", pa.array(cell_of(projected(_matrix(b.column("vec")), longest, query), tree), pa.int32()))

    return run


def _boxes(longest: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            p, cell = projected(_matrix(b.column("vec")), longest), b.column("cell").to_numpy()
            order = np.argsort(cell, kind="stable")
            cells, starts, n = np.unique(cell[order], return_index=True, return_counts=True)
            low, high = np.minimum.reduceat(p[order], starts), np.maximum.reduceat(p[order], starts)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(cells, M), pa.int32()), pa.array(np.tile(np.arange(M), len(cells)), pa.int32()), pa.array(low.ravel()), pa.array(high.ravel()), pa.array(np.repeat(n, M))], ["cell", "axis", "low", "high", "n"])

    return run


def _onward(cells: np.ndarray, low: np.ndarray, high: np.ndarray, first: np.ndarray, count: np.ndarray, longest: float):
    """Queries (with bound, and shard, the one that they saw) once for each further shard of the cells that the test leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stop = stop_ratio()
        for b in batches:
            for at in range(0, len(b), QUERIES):
                part = b.slice(at, QUERIES)
                x, bound, seen = _matrix(part.column("vec")), part.column("bound").to_numpy(), part.column("shard").to_numpy()
                far = stop * np.maximum(0, 2 * longest**2 - 2 * np.where(np.isfinite(bound), bound, 0) * longest / np.linalg.norm(x, axis=1))
                i, c = np.nonzero(gaps(projected(x, longest, True), low, high) <= np.where(np.isfinite(bound), far, np.inf)[:, None])
                i, n = np.repeat(i, count[c]), count[c]
                shard = np.repeat(first[c], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                i, shard = i[shard != seen[i]], shard[shard != seen[i]]
                for k in range(0, len(i), 4096):
                    rows = part.take(pa.array(i[k : k + 4096]))
                    yield pa.RecordBatch.from_arrays([pa.array(shard[k : k + 4096], pa.int32()), rows.column("query_id"), rows.column("vec"), rows.column("bound")], ["shard", "query_id", "vec", "bound"])

    return run


def _visit(longest: float, k: int):
    """Streams of shards, each with its points (ids set) before its queries: the queries' best points."""

    def answers(shard: Shard, ids: list, queries: pa.RecordBatch) -> pa.RecordBatch:
        own, bound = queries.column("query_id").to_numpy(), queries.column("bound").to_numpy()
        best, score = shard.search(_matrix(queries.column("vec")), k + 1, bound)
        out = []
        for q, rows, scores in zip(own, best, score, strict=True):
            found = sorted((-s, i) for r, s in zip(rows, scores, strict=True) if r >= 0 for i in ids[r] if i != q)
            out += [(q, i, -s) for s, i in found[:k]]
        a, b, c = zip(*out, strict=True) if out else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.float64())], ["query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, vecs, ids, shard = None, [], [], None
        for b in batches:
            if not len(b):
                continue
            number, point = b.column("shard").to_numpy(), b.column("ids").is_valid().to_numpy(zero_copy_only=False)
            turns = np.flatnonzero((number[1:] != number[:-1]) | (point[1:] != point[:-1])) + 1
            for first, last in zip([0, *turns], [*turns, len(b)], strict=True):
                if number[first] != now:
                    now, vecs, ids, shard = number[first], [], [], None
                part = b.slice(first, last - first)
                if point[first]:
                    vecs.append(_matrix(part.column("vec")))
                    ids += part.column("ids").to_pylist()
                elif vecs:
                    shard = shard or Shard(np.concatenate(vecs), np.array([i[0] for i in ids]), longest)
                    for at in range(0, len(part), QUERIES):
                        yield answers(shard, ids, part.slice(at, QUERIES))

    return run


def valid(vec: Column) -> Column:
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vec.isNotNull() & F.coalesce(fine, F.lit(False)) & F.exists(vec, lambda x: x != 0)


def best(found: DataFrame, k: int) -> DataFrame:
    """found's k best for each query, with rank."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def neighbours(vectors: DataFrame, is_query: Column, k: int = NEIGHBOURS) -> DataFrame:
    """query_id, rank, vec_id and score: for each row of vectors (vec_id, embedding) that is_query names, its k nearest."""
    spark = vectors.sparkSession
    rows = vectors.where(valid(F.col("embedding")) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vec"))
    rows = kept(rows.groupBy("vec_id").agg(F.min("vec").alias("vec")))
    usual = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if usual is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("vec") == usual.d)
    longest = float(rows.agg(F.max(F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)))).first()[0])

    def points() -> DataFrame:
        first = Window.partitionBy("vec").orderBy("vec_id")
        return rows.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1).groupBy("vec").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))

    data = alone(spark, points)
    depth = min(DEEPEST, max(0, (-(-data.count() // SHARD) - 1).bit_length()))
    sample = np.array([r.vec for r in data.select("vec").orderBy(F.xxhash64("vec")).limit(SAMPLE).collect()])
    tree = cut_at_medians(projected(sample, longest), depth)
    data = kept(data.mapInArrow(_place(tree, longest, False), "vec array<double>, ids array<long>, cell int"))
    # at most 2 ** DEEPEST cells with M axes each
    boxes = data.mapInArrow(_boxes(longest), "cell int, axis int, low double, high double, n long").groupBy("cell", "axis").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).orderBy("cell", "axis").collect()
    low, high = (np.array([r[c] for r in boxes]).reshape(-1, M) for c in ("low", "high"))
    cells, count = np.array([r.cell for r in boxes[::M]]), np.array([-(-r.n // SHARD) for r in boxes[::M]])
    first = np.cumsum(count) - count
    shards = F.broadcast(spark.createDataFrame(list(zip(cells.tolist(), first.tolist(), count.tolist(), strict=True)), "cell int, first int, shards int"))
    at = lambda *key: (F.col("first") + F.pmod(F.xxhash64(*key), F.col("shards"))).cast("int").alias("shard")
    data = data.join(shards, "cell").select(at("vec"), "vec", "ids")

    def visited(queries: DataFrame) -> DataFrame:
        none = F.lit(None)
        both = data.select("shard", none.cast("long").alias("query_id"), "vec", none.cast("double").alias("bound"), "ids").unionByName(queries.withColumn("ids", none.cast("array<long>")))
        return kept(both.repartition("shard").sortWithinPartitions("shard", F.col("ids").isNull()).mapInArrow(_visit(longest, k), FOUND))

    asked = rows.where(is_query).select(F.col("vec_id").alias("query_id"), "vec")
    # a query whose cell holds no point starts in any cell
    home = asked.mapInArrow(_place(tree, longest, True), "query_id long, vec array<double>, cell int").join(shards, "cell", "left")
    home = kept(home.select("query_id", "vec", F.coalesce(at("query_id"), F.lit(0)).alias("shard")))
    near = visited(home.withColumn("bound", F.lit(float("-inf"))))
    kth = best(near, k).groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("bound"))
    onward = home.join(kth, "query_id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("-inf"))))
    onward = onward.mapInArrow(_onward(cells, low, high, first, count, longest), "shard int, query_id long, vec array<double>, bound double")
    return best(near.unionByName(visited(onward)), k).select("query_id", "rank", "vec_id", "score")


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
