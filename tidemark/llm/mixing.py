"""Operator 3: mixing sources to target weights.

Words are packed, source by source, into blocks of a fixed length. Every source has a target in words; the slots
that this takes are dealt to output shards by multinomial draws (each source's draw is split between the two halves
of the shards, again and again, by binomials whose seed is the half itself, so a count can be drawn anywhere,
alone, and always comes out the same; halves that get nothing are not followed). A source's j-th slot gets the block at
place j of a pseudorandom permutation of its block numbers, another one for each pass over the source. Placements and
blocks are joined by block number. The last slot of a source takes only what its target still lacks.

Documents' places in their source come from sums over hashed chunks of about CHUNK_ROWS rows, so no task holds a source;
placements are made in as many tasks as there are sources and output shards to draw for.

Cases: null or empty texts have size 0 and nothing is taken; a null source is a source of its own, the last one;
rows with equal id, source and text are packed one by one; a very long text spans many blocks, its words are cut out
one row at a time; an empty table gives an empty result; extra columns, whatever their names, are left out
(`mixed_documents` keeps them, of equal rows those of one).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, alone, fresh, kept, kept_in_batches, ranked, running, table

#: Words in a block, slots in an output shard, rows in a chunk of a source, output shards that are drawn for together.
BLOCK, SHARD_SLOTS, CHUNK_ROWS, DRAWN = 256, 4096, 4096, 1024
#: The weights by a source's place, the share of all words, and how often a word may be taken.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
SEED = 20261126
#: Bytes of cut texts that leave a task at once.
FLUSH = 4 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(i: np.ndarray, n: np.ndarray, key: np.ndarray, inverse: bool = False) -> np.ndarray:
    """The place of i in the permutation of range(n) that key names: four Feistel rounds, walked on until below n."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask, out, todo = (np.uint64(1) << half) - np.uint64(1), i.astype(np.uint64), np.arange(len(i))
    keys = [_mix(key.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15 * (r + 1) & 0xFFFFFFFFFFFFFFFF)) for r in range(4)]
    while len(todo):
        h, m, x = half[todo], mask[todo], out[todo]
        left, right = x >> h, x & m
        for k in reversed(keys) if inverse else keys:
            if inverse:
                left, right = right ^ (_mix(left ^ k[todo]) & m), left
            else:
                left, right = right, left ^ (_mix(right ^ k[todo]) & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= n[todo].astype(np.uint64)]
    return out.astype(np.int64)


def sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size"), F.xxhash64("text").alias("text_key"))


def targets(sizes: DataFrame) -> DataFrame:
    """source, rank, source_size, n_rows, weight, target: sources by code point, null last.

    A source is full if the level, words for each unit of weight, passes its most; sources fill in order of most by weight. What is left over
    and the weights that share it are sums over all earlier ones, so the level is found in one pass, however many sources there are.
    """
    s = ranked(sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows")), F.asc_nulls_last("source"))
    s = kept(s.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("rank") % len(WEIGHTS) + 1).cast("int"))))
    most = MOST * F.col("source_size")
    total, weights = s.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    order = running(s.withColumn("fills", most / F.col("weight")), [F.col("fills"), F.col("rank")], {"before": most, "shared": F.col("weight")})
    order = order.withColumn("level", (F.lit(SHARE * total) - F.col("before")) / (F.lit(weights) - F.col("shared")))
    level = order.where("level <= fills").agg(F.min_by("level", F.struct("fills", "rank"))).first()[0]
    return s.withColumn("target", F.least(most.cast("double"), F.lit(float("inf") if level is None else level) * F.col("weight")))


def plan(sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """Each source's blocks, whole passes, and words and slots of the last, partial pass."""
    words = F.round("target").cast("long")
    size = F.greatest("source_size", F.lit(1))
    p = sources.withColumn("blocks", F.ceil(F.col("source_size") / block)).withColumn("passes", F.floor(words / size)).withColumn("rest", words - F.col("passes") * F.col("source_size"))
    return p.withColumn("slots", F.col("passes") * F.col("blocks") + F.when(F.col("rest") > 0, F.least("blocks", F.ceil(F.col("rest") / block) + 1)).otherwise(0))


def _dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of a node of the tree of halves (path: its turns from the root, a bit each, depth many): the shards that get slots of a source, how many, and which is the first."""
    for b in batches:
        out = []
        for rank, slots, shards, depth, path in zip(b["rank"], b["slots"], b["shards"], b["depth"], b["path"], strict=True):
            todo = [(0, shards, slots, 0, 0)]
            while todo:
                low, high, n, start, at = todo.pop()
                if not n:
                    continue
                if high - low == 1:
                    if at >= depth or not path >> at:  # a node above the depth is dealt by the leftmost path below it alone
                        out.append((rank, low, n, start))
                    continue
                mid = (low + high) // 2
                left = int(np.random.default_rng((SEED, rank, low, high)).binomial(n, (mid - low) / (high - low)))
                halves = [(low, mid, left, start, at + 1), (mid, high, n - left, start + left, at + 1)]
                todo += halves if at >= depth else [halves[path >> at & 1]]
        yield pd.DataFrame(out, columns=["rank", "shard", "n", "start"]).astype({"rank": "int64", "shard": "int64", "n": "int64", "start": "int64"})


def _placed(block: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n, j = b["blocks"].to_numpy(), b["j"].to_numpy()
            turn, at = j // n, j % n
            key = _mix(np.uint64(SEED) + b["rank"].to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) + turn.astype(np.uint64)
            number = permuted(at, n, key)
            short = n * block - b["source_size"].to_numpy()
            before = at * block - np.where(permuted(n - 1, n, key, inverse=True) < at, short, 0)
            size = block - np.where(number == n - 1, short, 0)
            take = np.where(turn < b["passes"], size, np.clip(b["rest"] - before, 0, size))
            yield b[["rank", "shard", "j"]].assign(block=number, take=take)[take > 0]

    return run


def placements(p: DataFrame, block: int = BLOCK) -> DataFrame:
    """rank, shard, j (the source's slot), block (the number that it gets) and take (words from the block's start)."""
    slots = p.agg(F.sum("slots")).first()[0] or 0
    shards = max(1, -(-slots // SHARD_SLOTS))
    depth = max(0, (-(-shards // DRAWN) - 1).bit_length())
    nodes = p.where("slots > 0").select("rank", "slots", F.lit(shards).alias("shards"), F.lit(depth).alias("depth"), F.explode(F.sequence(F.lit(0), F.lit((1 << depth) - 1))).alias("path"))
    dealt = nodes.repartition("rank", "path").mapInPandas(_dealt, "rank long, shard long, n long, start long").repartition("rank", "shard")
    each = dealt.select("rank", "shard", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("j"))
    each = each.join(p.select("rank", "blocks", "passes", "rest", "source_size"), "rank")
    return each.mapInPandas(_placed(block), "rank long, shard long, j long, block long, take long")


def packed(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """sizes with rank and `at`, the document's first word in its source's stream; documents without words are left out."""
    s = sources.select(F.col("source").alias("of"), "rank", F.ceil(F.col("n_rows") / CHUNK_ROWS).alias("chunks"))
    d = sizes.where("size > 0").join(s, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    d = d.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text_key"), F.col("chunks"))).drop("chunks")
    chunks = d.groupBy("rank", "chunk").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("rank").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.select("rank", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("from"))
    inside = Window.partitionBy("rank", "chunk").orderBy("doc_id", "text_key").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("at", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return d.join(chunks, ["rank", "chunk"]).withColumn("at", F.col("at") + F.col("from")).drop("chunk", "from")


def spans(docs: DataFrame, placed: DataFrame, block: int = BLOCK) -> DataFrame:
    """The parts of documents that the mix takes: docs' columns, shard, j, first word and number of words."""
    first, last = F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block)
    parts = docs.withColumn("block", F.explode(F.sequence(first, last)))
    both = parts.join(placed.hint("merge"), ["rank", "block"])  # placements grow with the corpus: never a broadcast
    start = F.greatest("at", F.col("block") * block)
    end = F.least(F.col("at") + F.col("size"), F.col("block") * block + F.col("take"))
    return both.withColumn("first", start - F.col("at")).withColumn("n", end - start).where("n > 0").drop("take")


def mixed(docs: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sizes of all documents, sources with their targets, and the spans that the mix takes."""
    sizes = kept(sized(docs))
    sources = alone(docs.sparkSession, lambda: plan(targets(sizes), block))
    return sizes, sources, spans(packed(sizes, sources), placements(sources, block), block)


def taken(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per document with the words that the mix takes from it."""
    sizes, sources, got = mixed(docs, block)
    # a packed document is known by its source and first word
    words = packed(sizes, sources).select("doc_id", "size", "rank", "at", F.lit(0).cast("long").alias("n")).unionAll(got.select("doc_id", "size", "rank", "at", "n"))
    full = words.groupBy("rank", "at").agg(F.first("doc_id").alias("doc_id"), F.first("size").alias("size"), F.sum("n").alias("taken"))
    s = sources.select("rank", "source_size", "target")
    none = sizes.where("size = 0").join(sources.select(F.col("source").alias("of"), "source_size", "target"), F.col("source").eqNullSafe(F.col("of")))
    rest = none.select("doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"))
    return full.join(s, "rank").select("doc_id", "size", "source_size", "target", "taken").unionAll(rest)


def _cut(columns: list[str], lists: str):
    import re

    word = re.compile(WORD)

    def copies(text: str, spans: list[dict]) -> Iterator[str]:
        """The text that each pass takes of a document."""
        found = [m.span() for m in word.finditer(text)]
        by_pass: dict[tuple, list] = {}
        for s in spans:
            by_pass.setdefault((s["at"], s["turn"]), []).append((s["first"], s["n"]))
        for _, parts in sorted(by_pass.items()):
            runs: list[list[int]] = []
            for first, n in sorted(parts):
                if runs and runs[-1][1] == first:
                    runs[-1][1] += n
                else:
                    runs.append([first, first + n])
            yield text if runs == [[0, len(found)]] else "\n".join(text[found[i][0] : found[k - 1][1]] for i, k in runs)

    def rows(b: pa.RecordBatch, texts: list[str], of: list[int]) -> pa.RecordBatch:
        take = pa.array(of, pa.int64())
        made = {"text": lambda: pa.array(texts, pa.string()), "n_chars": lambda: pa.array([len(t) for t in texts], pa.int64()).cast(b.schema.field("n_chars").type)}
        return pa.RecordBatch.from_arrays([made[c]() if c in made else b.column(c).take(take) for c in columns], columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, of, size = [], [], 0
            for i in range(len(b)):
                for t in copies(b.column("text")[i].as_py(), b.column(lists)[i].as_py()):
                    texts.append(t)
                    of.append(i)
                    size += len(t)
                if size > FLUSH:
                    yield rows(b, texts, of)
                    texts, of, size = [], [], 0
            yield rows(b, texts, of)

    return run


def mixed_documents(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The mix as documents: a row per document and pass, with the text that this pass takes of it and docs' columns."""
    _, sources, got = mixed(docs, block)
    n, lists, kd, kt, ks = sources.select("rank", "blocks"), *(fresh(docs, c) for c in ("taken_spans", "key_id", "key_text", "key_source"))
    got = got.join(n, "rank").withColumn("turn", F.floor(F.col("j") / F.col("blocks")))
    per = got.groupBy(F.hash("doc_id").alias(kd), F.col("text_key").alias(kt), F.xxhash64("source", "doc_id").alias(ks)).agg(F.collect_list(F.struct("at", "turn", "first", "n")).alias(lists))
    keyed = docs.withColumns({kd: F.hash("doc_id"), kt: F.xxhash64("text"), ks: F.xxhash64("source", "doc_id")}).dropDuplicates([kd, kt, ks])
    return kept_in_batches(keyed.join(per, [kd, kt, ks]).drop(kd, kt, ks).mapInArrow(_cut(docs.columns, lists), docs.schema), 256)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
