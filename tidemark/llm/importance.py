"""Operator 12: importance resampling towards a target's n-grams, with an integer word dictionary.

Texts are worked on in batches of a bounded number of words. A batch's distinct words get integer ids from a dictionary of its own, as one of
the whole corpus has no bound. A run of two words is a tuple of ids, folded into one integer, and the distinct tuples get ids in turn. The bytes of
each distinct word and tuple are put together and hashed once in a batch; the buckets are joined back by id, to the counts and to
the places where the words stand. So a batch leaves each document's buckets in the order of its features, two bytes each, and no feature is hashed again:
bucket counts of corpus and target are sums over stored buckets, and once they give the gains, a bounded table, a document's weight
is a mean of looked-up gains. Scores add pseudorandom Gumbel noise that the id decides, so the highest ones are a draw without replacement; places in
their order are given without a single task.

Cases: a null text is an empty one, and texts without words have no features and weight 0; text and target may be empty tables; a text of any length
is taken whole, in batches that share the word at their seam; rows with equal ids or texts are rows of their own, and of equal scores the
smaller id is drawn first, a null id (hashed as an empty one) last; rows equal in these are drawn in any order; extra columns, whatever their names, are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import kept, kept_in_batches, ranked, table

#: Buckets, the seed of the noise, the words that a document needs to be drawn, and the share that is drawn, in hundredths.
BUCKETS, SEED, LEAST_WORDS, DRAWN = 10_000, 7, 20, 25
#: Words of a batch, and bytes of the texts that are taken at once.
WORDS, BYTES = 1 << 19, 4 << 20

#: Word characters as bytes: 0-9, a-z and all that isn't ASCII; A-Z are lower-cased before.
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True
FEATURES = "doc_id long, n_words long, n_features long, buckets binary"


def word_bounds(data: np.ndarray) -> np.ndarray:
    """Where words start and end, in turn."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = _WORD[data]
    return np.flatnonzero(inside[1:] != inside[:-1])


def hashed(data: bytes, bounds: np.ndarray, joined: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of the words between bounds, and of each word with its next where joined says so (0 elsewhere)."""
    offsets = pa.py_buffer(np.append(bounds, bounds[-1:]).astype(np.int32))
    between = pa.Array.from_buffers(pa.binary(), len(bounds), [None, offsets, pa.py_buffer(data)])  # words and what is between them
    coded = between.take(pa.array(np.arange(0, len(bounds), 2))).dictionary_encode()
    word, known = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
    single = np.array([crc32(w) % BUCKETS for w in known], np.uint16)[word]
    pairs = np.zeros(len(word), np.uint16)
    if joined.any():
        at = np.flatnonzero(joined)
        coded = pa.array(word[at] * len(known) + word[at + 1]).dictionary_encode()
        first, second = np.divmod(coded.dictionary.to_numpy(), len(known))
        of_tuple = np.array([crc32(known[a] + b" " + known[b]) % BUCKETS for a, b in zip(first.tolist(), second.tolist(), strict=True)], np.uint16)
        pairs[at] = of_tuple[coded.indices.to_numpy()]
    return single, pairs


def buckets(texts: list[bytes]) -> list[np.ndarray]:
    """Each text's buckets: word, then word and next word, and so on."""
    data = b"\n".join(texts).translate(_LOWER)
    bounds = word_bounds(np.frombuffer(data, np.uint8))
    start = bounds[0::2]
    ends = np.searchsorted(start, np.cumsum([len(t) + 1 for t in texts]))  # of each text's words
    joined = np.ones(len(start), bool)
    joined[ends[ends > 0] - 1] = False
    single, pairs = np.zeros(len(start), np.uint16), np.zeros(len(start), np.uint16)
    for a in range(0, len(start), WORDS):
        z = min(a + WORDS, len(start))
        seam = min(z + 1, len(start))  # the next batch's first word, for the tuple at the seam
        some, low = bounds[2 * a : 2 * seam], bounds[2 * a]
        mine = joined[a:seam].copy()
        mine[-1] = False
        one, two = hashed(data[low : some[-1]], some - low, mine)
        single[a:z], pairs[a:z] = one[: z - a], two[: z - a]
    out = np.empty(2 * len(start), np.uint16)
    out[0::2], out[1::2] = single, pairs
    keep = np.ones(len(out), bool)
    keep[1::2] = joined
    return [out[2 * a : 2 * z][keep[2 * a : 2 * z]] for a, z in zip([0, *ends[:-1]], ends, strict=True)]


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, texts = b.column("doc_id").cast(pa.int64()), b.column("text")
        size = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        first = 0
        while first < len(b):
            last = first + max(1, int(np.searchsorted(np.cumsum(size[first:]), BYTES, side="right")))
            got = buckets([t.as_buffer().to_pybytes() if t.is_valid else b"" for t in texts[first:last]])
            n = np.array([len(g) for g in got])
            yield pa.RecordBatch.from_arrays([ids[first:last], pa.array((n + 1) // 2), pa.array(n), pa.array([g.astype("<u2").tobytes() for g in got], pa.binary())], ["doc_id", "n_words", "n_features", "buckets"])
            first = last


def featured(texts: DataFrame) -> DataFrame:
    """doc_id, n_words, n_features and buckets (unsigned 16-bit integers) of texts (doc_id, text), stored."""
    return kept_in_batches(texts.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_features, FEATURES), 1024)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for b in batches:
        for x in b.column("buckets"):
            total += np.bincount(np.frombuffer(x.as_buffer(), "<u2"), minlength=BUCKETS)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["bucket", "n"])


def gains(features: DataFrame, target: DataFrame) -> DataFrame:
    """bucket and gain, in thousandths, for all buckets."""
    count = lambda df, n: df.select("buckets").mapInArrow(_counts, f"bucket int, {n} long").groupBy("bucket").agg(F.sum(n).alias(n))
    counts = features.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    counts = counts.join(count(features, "n").withColumnRenamed("n", "s"), "bucket", "left").join(count(target, "n").withColumnRenamed("n", "t"), "bucket", "left").na.fill(0)
    counts = kept(counts)
    all_s, all_t = counts.agg(F.sum("s"), F.sum("t")).first()
    ratio = (F.col("t") + F.lit(1.0)) * F.lit(float(all_s + BUCKETS)) / ((F.col("s") + F.lit(1.0)) * F.lit(float(all_t + BUCKETS)))
    return counts.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


def _weigh(gain: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            each = [np.frombuffer(x.as_buffer(), "<u2") for x in b.column("buckets")]
            weight = [int(gain[x].sum()) // len(x) if len(x) else 0 for x in each]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_words"), b.column("n_features"), pa.array(weight, pa.int64())], ["doc_id", "n_words", "n_features", "weight"])

    return run


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, which the id decides."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def resampled(docs: DataFrame, target: DataFrame, percent: int = DRAWN, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null: not drawn) of docs (doc_id, text), drawn towards target (text)."""
    features = featured(docs)
    # at most BUCKETS rows
    gain = {r.bucket: r.gain for r in gains(features, featured(target.select(F.lit(None).alias("doc_id"), "text"))).collect()}
    rows = features.mapInArrow(_weigh(np.array([gain[b] for b in range(BUCKETS)], np.int64)), "doc_id long, n_words long, n_features long, weight long")
    rows = kept(rows.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)))
    long = rows.where(F.col("n_words") >= LEAST_WORDS)
    drawn = F.lit(percent * long.count() // 100)
    columns = ["doc_id", "n_features", "weight", "score"]
    placed = ranked(long.select(*columns), F.desc("score"), F.asc_nulls_last("doc_id"))
    placed = placed.withColumn("rank", F.when(F.col("rank") < drawn, F.col("rank") + 1))
    return placed.unionByName(rows.where(F.col("n_words") < LEAST_WORDS).select(*columns, F.lit(None).cast("long").alias("rank"))).select(*columns, F.col("rank").cast("long").alias("rank"))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: From the definition, for unique ids; DuckDB has no CRC, so it is made from its polynomial.
OP12_SQL = rf"""
WITH RECURSIVE steps(i, k, c) AS (SELECT i, 0, i::UBIGINT FROM range(256) r(i) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END FROM steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS crc FROM steps WHERE k = 8),
w AS (SELECT kind, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM (SELECT 1 AS kind, doc_id, text FROM documents UNION ALL SELECT 2, item_id, text FROM benchmark)),
f AS (SELECT kind, doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM w),
distinct_f AS (SELECT f, hex(encode(f)) AS x FROM (SELECT DISTINCT f FROM f)),
bytes AS (SELECT f, list_transform(range(0, len(x) // 2), lambda i: (strpos('0123456789ABCDEF', x[2 * i + 1]) - 1) * 16 + strpos('0123456789ABCDEF', x[2 * i + 2]) - 1) AS b FROM distinct_f),
hashed AS (SELECT f, xor(list_reduce(list_prepend(4294967295::UBIGINT, b::UBIGINT[]), lambda c, y: xor(c >> 8, crc[(xor(c & 255, y) + 1)::BIGINT])), 4294967295::UBIGINT) % {BUCKETS} AS bucket FROM bytes, crc),
placed AS (SELECT kind, doc_id, bucket FROM f JOIN hashed USING (f)),
counts AS (SELECT bucket, count(*) FILTER (WHERE kind = 1) AS s, count(*) FILTER (WHERE kind = 2) AS t FROM placed GROUP BY bucket),
total AS (SELECT sum(s)::DOUBLE AS all_s, sum(t)::DOUBLE AS all_t FROM counts),
gain AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (all_s + {BUCKETS}) / ((s + 1)::DOUBLE * (all_t + {BUCKETS}))))::BIGINT AS gain FROM counts, total),
weighed AS (SELECT doc_id, count(*) AS n_features, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM placed JOIN gain USING (bucket) WHERE kind = 1 GROUP BY doc_id),
scored AS (SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, ('0x' || sha256('{SEED}:' || doc_id)[1:8])::BIGINT AS h FROM w LEFT JOIN weighed USING (doc_id) WHERE kind = 1),
final AS (SELECT doc_id, n_words, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::BIGINT AS score FROM scored),
places AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, {DRAWN} * count(*) OVER () // 100 AS drawn FROM final WHERE n_words >= {LEAST_WORDS})
SELECT doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN place <= drawn THEN place END AS rank FROM final LEFT JOIN places USING (doc_id)
"""
