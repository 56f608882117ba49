"""Operator 11: hard negatives by a vector-approximation file.

Vectors become integers, floor(256 * x). They are dealt out by their id into blocks of a bounded number of rows, and each block keeps an
approximation beside them: every dimension is cut into CELLS cells at the block's own quantiles, a row is the number of its
cell in each, a byte. For an anchor the smallest and the largest product that a cell's values can have with the
anchor's component are tabled; a row's lower and upper bound on the inner product are sums of table entries.

1. Positives. Of an anchor's label, the rows whose upper bound reaches the k-th best lower bound are scored exactly, the others
   can't be among the best k of the block.
2. Negatives. Of the other labels, for each positive's window, the rows whose bounds meet the window and whose upper bound reaches
   the k-th best lower bound among those that are in the window for sure are scored exactly.

Each block returns a few rows for an anchor and positive; the best ones are taken over all blocks. The result is exact: bounds only say what
needs no scoring. Anchors are a stated set and meet every row once, block by block, in batches; a block stays in its task while anchors stream
past it, so memory is bounded by a block and a batch.

Cases: rows with a null id or label, or a vector that is null, empty, holds a null or non-finite component or has another length than most, take no part;
rows with equal ids count once, with the smallest label and vector; equal vectors are rows of their own, ties go to the smaller id; components
of more than 2**26 in magnitude after rounding count as 2**26, so that scores stay exact in 64 bits; a positive with a negative score has no window;
an anchor without positives has no rows; an empty table gives an empty result; extra columns, whatever their names, are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import kept, table

#: Positives of an anchor, negatives of a positive, and the window of their scores in hundredths of the positive's.
POSITIVES, NEGATIVES, LOW, HIGH = 5, 3, 50, 95
#: Rows in a block, anchors worked on at once, cells of a dimension, largest magnitude of a component.
BLOCK, ANCHORS, CELLS, LARGEST = 2048, 64, 64, 1 << 26
LEAST = np.iinfo(np.int64).min
FOUND = "anchor_id long, positive_id long, positive_score long, vec_id long, score long"


class Block:
    """A block's rows, sorted by label and id, with their approximation; `scored` counts the pairs that were scored exactly."""

    def __init__(self, ids: np.ndarray, label: np.ndarray, x: np.ndarray):
        order = np.lexsort((ids, label))
        self.ids, self.label, self.x, self.scored = ids[order], label[order], x[order], 0
        x, d = self.x, x.shape[1]
        self.codes, self.low, self.high = np.empty((d, len(x)), np.uint8), np.zeros((d, CELLS), np.int64), np.zeros((d, CELLS), np.int64)
        for j, at in enumerate(np.quantile(x, np.arange(1, CELLS) / CELLS, axis=0, method="lower").T):
            self.codes[j] = np.searchsorted(at, x[:, j], side="left")
            by_cell = np.argsort(self.codes[j], kind="stable")
            cells, first = np.unique(self.codes[j][by_cell], return_index=True)
            self.low[j, cells], self.high[j, cells] = np.minimum.reduceat(x[by_cell, j], first), np.maximum.reduceat(x[by_cell, j], first)

    def bounds(self, anchors: np.ndarray, rows: slice) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds on the inner products of anchors with these rows."""
        one, other = anchors[:, :, None] * self.low, anchors[:, :, None] * self.high
        out = []
        for products in (np.minimum(one, other), np.maximum(one, other)):
            total = np.zeros((len(anchors), rows.stop - rows.start), np.int64)
            for j, codes in enumerate(self.codes[:, rows]):
                total += products[:, j].take(codes, axis=1)
            out.append(total)
        return out[0], out[1]

    def exact(self, anchors: np.ndarray, i: np.ndarray, rows: np.ndarray) -> np.ndarray:
        self.scored += len(i)
        return np.concatenate([np.einsum("ij,ij->i", anchors[i[k : k + 4096]], self.x[rows[k : k + 4096]]) for k in range(0, len(i), 4096)] or [np.zeros(0, np.int64)])

    def positives(self, ids: np.ndarray, label: np.ndarray, anchors: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, ...]]:
        """Anchor's number, row and score of each anchor's best k other rows of its label."""
        for value in np.unique(label):
            own, rows = np.flatnonzero(label == value), slice(*np.searchsorted(self.label, [value, value + 1]))
            if rows.start == rows.stop:
                continue
            low, high = self.bounds(anchors[own], rows)
            other = self.ids[rows] != ids[own, None]
            i, j = np.nonzero(other & (high >= kth_best(np.where(other, low, LEAST), k)))
            yield best(own[i], rows.start + j, self.exact(anchors, own[i], rows.start + j), self.ids, k)

    def negatives(self, label: np.ndarray, anchors: np.ndarray, scores: np.ndarray, k: int, window: tuple[int, int]) -> Iterator[tuple[np.ndarray, ...]]:
        """Anchor's number, row, score and positive's number of each window's best k rows of other labels. scores: the positives' (LEAST: none)."""
        low, high = self.bounds(anchors, slice(0, len(self.ids)))
        foreign = self.label != label[:, None]
        first, last = windows(scores, window)
        maybe = [foreign & (high >= a) & (low <= z) & (high >= kth_best(np.where(foreign & (low >= a) & (high <= z), low, LEAST), k)) for a, z in zip(first.T[..., None], last.T[..., None], strict=True)]
        i, j = np.nonzero(np.logical_or.reduce(maybe))
        got = self.exact(anchors, i, j)
        for p in range(scores.shape[1]):
            inside = (got >= first[i, p]) & (got <= last[i, p])
            found = best(i[inside], j[inside], got[inside], self.ids, k)
            yield *found, np.full(len(found[0]), p)


def windows(scores: np.ndarray, window: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """The first and last score in each positive's window: low * positive <= 100 * score <= high * positive. An empty window ends before it begins."""
    some = scores > LEAST
    s = np.where(some, scores, 0)
    wide = np.abs(s) >= 1 << 56  # 100 times that leaves 64 bits
    parts = [(s // 100) * w + ((s % 100) * w + up) // 100 for w, up in zip(window, (99, 0), strict=True)]
    exact = [(s * np.where(wide, 0, w) + up) // 100 for w, up in zip(window, (99, 0), strict=True)]
    first, last = (np.where(wide, p, e) for p, e in zip(parts, exact, strict=True))
    return np.where(some, first, 1), np.where(some, last, 0)


def kth_best(values: np.ndarray, k: int) -> np.ndarray:
    """Each row's k-th largest value, as a column; LEAST if there are fewer."""
    if values.shape[1] < k:
        return np.full((len(values), 1), LEAST)
    return np.partition(values, values.shape[1] - k, axis=1)[:, values.shape[1] - k, None]


def best(i: np.ndarray, rows: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each i the best k rows, ties to the smaller id."""
    order = np.lexsort((ids[rows], -score, i))
    order = order[np.arange(len(order)) - np.searchsorted(i[order], i[order]) < k]
    return i[order], rows[order], score[order]


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def _past_blocks(k: int, window: tuple[int, int] | None):
    """Streams of blocks, each with its rows (kind 0) before the anchors (kind 1): what each block finds. window: search negatives there, not positives."""

    def found(block: Block, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, label, x = part.column("vec_id").to_numpy(), part.column("label").to_numpy(), _matrix(part.column("q"))
        if window is None:
            for i, rows, score in block.positives(ids, label, x, k):
                none = pa.nulls(len(i), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(ids[i]), none, none, pa.array(block.ids[rows]), pa.array(score)], [c.split()[0] for c in FOUND.split(", ")])
            return
        each = part.column("positives").to_pylist()
        most = max(len(p) for p in each)
        who, scores = np.zeros((len(each), most), np.int64), np.full((len(each), most), LEAST)
        for i, p in enumerate(each):
            who[i, : len(p)], scores[i, : len(p)] = [y["vec_id"] for y in p], [y["score"] for y in p]
        for i, rows, score, p in block.negatives(label, x, scores, k, window):
            yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(who[i, p]), pa.array(scores[i, p]), pa.array(block.ids[rows]), pa.array(score)], [c.split()[0] for c in FOUND.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, block = None, [], None
        for b in batches:
            number, kind = b.column("block").to_numpy(), b.column("kind").to_numpy()
            turns = np.flatnonzero((number[1:] != number[:-1]) | (kind[1:] != kind[:-1])) + 1
            for first, last in zip([0, *turns], [*turns, len(b)], strict=True):
                if first == last:
                    continue
                if number[first] != now:
                    now, parts, block = number[first], [], None
                part = b.slice(first, last - first)
                if kind[first] == 0:
                    parts.append((part.column("vec_id").to_numpy(), part.column("label").to_numpy(), _matrix(part.column("q"))))
                elif parts:
                    block = block or Block(*(np.concatenate(c) for c in zip(*parts, strict=True)))
                    for at in range(0, len(part), ANCHORS):
                        yield from found(block, part.slice(at, ANCHORS))

    return run


def in_integers(vectors: DataFrame) -> DataFrame:
    """vec_id, label and q (the vector in integers) of the rows of vectors (vec_id, embedding, label) that take part, one for each id."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    q = F.transform("embedding", lambda x: F.floor(F.greatest(F.least(x.cast("double") * 256, F.lit(float(LARGEST))), F.lit(float(-LARGEST)))).cast("int"))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0) & F.coalesce(fine, F.lit(False)))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.struct(F.col("label").cast("long").alias("label"), q.alias("q")).alias("row"))
    rows = kept(rows.groupBy("vec_id").agg(F.min("row").alias("row")).select("vec_id", "row.*"))
    usual = rows.groupBy(F.size("q").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("q") == (usual.d if usual else 0))


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, window: tuple[int, int] = (LOW, HIGH)) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score for the anchors among vectors (vec_id, embedding, label)."""
    rows = in_integers(vectors)
    blocks = -(-rows.count() // BLOCK)
    anchors = rows.where(is_anchor)
    filed = rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(max(1, blocks))).cast("int").alias("block"), F.lit(0).alias("kind"), "vec_id", "label", "q")

    def past_blocks(asked: DataFrame, k: int, within: tuple[int, int] | None) -> DataFrame:
        everywhere = asked.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("kind"), *asked.columns) if blocks else asked.select(F.lit(0).alias("block"), F.lit(1).alias("kind"), *asked.columns)
        both = filed.unionByName(everywhere, allowMissingColumns=True)
        # a block for a task: their number follows the rows
        return both.repartition(max(1, blocks), "block").sortWithinPartitions("block", "kind").mapInArrow(_past_blocks(k, within), FOUND)

    order = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id")
    near = past_blocks(anchors, positives, None).withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives)
    near = near.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list(F.struct("vec_id", "score")).alias("positives"))  # a few
    found = past_blocks(kept(anchors.join(near, "vec_id")), negatives, window)
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return found.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", label), F.col("vec_id") % 50 == 0)


#: From the definition, for unique ids: every anchor against every row.
OP11_SQL = f"""
WITH q AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score FROM q a JOIN q b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0),
positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pairs WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES})
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY n.score DESC, n.vec_id) AS rank, n.vec_id AS negative_id, positive_score, n.score AS negative_score
FROM positives JOIN pairs n USING (anchor_id) WHERE NOT n.same AND {LOW} * positive_score <= 100 * n.score AND 100 * n.score <= {HIGH} * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY n.score DESC, n.vec_id) <= {NEGATIVES}
"""
