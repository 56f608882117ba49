"""Operator 13: substring dedup by difference-cover anchors.

COVER is a difference cover modulo PERIOD: for any two places of words there is a shift under PERIOD that takes both to places
whose numbers are in the cover, modulo PERIOD. So two equal windows of WINDOW words hold two equal runs of ANCHOR = WINDOW - PERIOD + 1 words that
start at cover places of both texts, at the same shift. Only runs at cover places are hashed, about a fifth of all.

1. Texts of the same words are one class, of which the row with the smallest id stands for all: the others go whole.
2. Anchors are joined by hash; those that documents of two ids have are seeds. Other places can't be in a window that repeats.
3. Seeds are extended: all windows of WINDOW words around a seed are hashed, to 128 bits, and held against the smallest id that has the same window.
   A window whose smallest id is smaller than its own document's covers its words.

Places never meet each other but one row for each anchor or window, and keys that very many rows have are broadcast, so the work is linear however
common a passage is. The result is exact, but for equal 128-bit hashes of different windows.

Cases: null texts and texts without words have no words; rows with equal ids never take words from each other, whatever their texts, so repeated rows keep what one row keeps; a null id
comes before all others; texts under WINDOW words are never cut; windows are judged on whole texts as they were given; a text of any
length is one sequence of words, cut in parts only to bound memory; an empty table gives an empty result; extra columns, whatever their names, are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import alone, checked, joined_by_key, kept, kept_in_batches, table
from tidemark.llm.shingles import mix

#: Words of a window; a perfect difference cover and its period; words of an anchor.
WINDOW, PERIOD, COVER = 50, 31, (1, 5, 11, 24, 25, 27)
ANCHOR = WINDOW - PERIOD + 1
#: Bytes of a text whose words are hashed at once, and words that are written at once.
PART, WORDS = 1 << 20, 1 << 16

_rng = np.random.default_rng(13)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_OF_BYTES, *_OF_WORDS = (int(x) | 1 for x in _rng.integers(2**62, 2**63, 3))
KEY = ["kd", "kt"]


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base & (2**64 - 1), np.uint64)
    p[:1] = 1
    return np.cumprod(p, dtype=np.uint64)


def runs(values: np.ndarray, base: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of values[start:end], by one pass over values."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers(base, len(values)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _powers(pow(base, -1, 1 << 64), len(values) + 1)[starts] + (ends - starts).astype(np.uint64))


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~_SPACE[data]
    at = np.flatnonzero(inside[1:] != inside[:-1])
    return at[0::2], at[1::2]


def word_hashes(data: np.ndarray) -> np.ndarray:
    """A text's words, in 64 bits each."""
    start, end = word_bounds(data)
    out, a = [np.zeros(0, np.uint64)], 0
    while a < len(start):
        z = max(a + 1, int(np.searchsorted(end, start[a] + PART, side="right")))
        low = start[a]
        out.append(runs(_BYTE[data[low : end[z - 1]]], _OF_BYTES, start[a:z] - low, end[a:z] - low))
        a = z
    return np.concatenate(out)


def windows(words: np.ndarray, starts: np.ndarray, length: int, base: int) -> np.ndarray:
    """Hashes of `length` words from each of starts (sorted), in parts."""
    out, a = [np.zeros(0, np.uint64)], 0
    while a < len(starts):
        z = int(np.searchsorted(starts, starts[a] + WORDS))
        low = starts[a]
        out.append(runs(words[low : starts[z - 1] + length], base, starts[a:z] - low, starts[a:z] - low + length))
        a = z
    return np.concatenate(out)


def anchor_places(words: int) -> np.ndarray:
    at = np.arange(max(0, words - ANCHOR + 1))
    return at[np.isin(at % PERIOD, COVER)] if words >= WINDOW else at[:0]


def around(seeds: np.ndarray, words: int) -> np.ndarray:
    """Where the windows start that hold the anchor at one of these places."""
    step = np.zeros(words + 2, np.int32)
    np.add.at(step, np.maximum(seeds - (WINDOW - ANCHOR), 0), 1)
    np.add.at(step, seeds + 1, -1)
    at = np.flatnonzero(np.cumsum(step) > 0)
    return at[at <= words - WINDOW]


def _text(value: pa.Scalar) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), np.uint8) if value.is_valid else np.zeros(0, np.uint8)


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """kd, kt, key (a hash of all words) and n_words of the texts with a window."""
    for b in batches:
        found = [word_hashes(_text(t)) for t in b.column("text")]
        full = [i for i, w in enumerate(found) if len(w) >= WINDOW]
        keys = [hashlib.blake2b(found[i].tobytes(), digest_size=16).digest() for i in full]
        yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(full, pa.int64())) for c in KEY), pa.array(keys, pa.binary()), pa.array([len(found[i]) for i in full], pa.int64())], [*KEY, "key", "n_words"])


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """kd, kt, g (an anchor's hash) and its place."""
    for b in batches:
        for i, text in enumerate(b.column("text")):
            words = word_hashes(_text(text))
            places = anchor_places(len(words))
            for at in range(0, len(places), WORDS):
                part = places[at : at + WORDS]
                g = windows(words, part, ANCHOR, _OF_WORDS[0]).view(np.int64)
                yield pa.RecordBatch.from_arrays([*(pa.repeat(b.column(c)[i], len(part)) for c in KEY), pa.array(g), pa.array(part, pa.int32())], [*KEY, "g", "place"])


def _extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """kd, kt, where a window around a seed (places in `seeds`) starts, and its hash in two halves."""
    for b in batches:
        for i, (text, seeds) in enumerate(zip(b.column("text"), b.column("seeds"), strict=True)):
            words = word_hashes(_text(text))
            starts = around(np.asarray(seeds.values), len(words))
            for at in range(0, len(starts), WORDS):
                part = starts[at : at + WORDS]
                halves = [windows(words, part, WINDOW, base).view(np.int64) for base in _OF_WORDS]
                yield pa.RecordBatch.from_arrays([*(pa.repeat(b.column(c)[i], len(part)) for c in KEY), pa.array(part, pa.int32()), *map(pa.array, halves)], [*KEY, "start", "w0", "w1"])


def _key() -> list[Column]:
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("kd"), F.xxhash64("text").alias("kt")]


def repeated_spans(docs: DataFrame) -> DataFrame:
    """kd, kt and `spans`: first word, and the one after the last, of what earlier documents have; documents without any are left out."""
    texts = docs.select(*_key(), "text")
    rows = kept_in_batches(texts.mapInArrow(_classes, "kd long, kt long, key binary, n_words long"), 512)
    first = kept(rows.groupBy("key").agg(F.min(F.struct(*KEY)).alias("first"), F.count("*").alias("times")).where("times > 1"))
    same = joined_by_key(rows, first, ["key"], "times").select(*KEY, "first", "n_words").distinct()
    copies = kept(same.where(F.struct(*KEY) != F.col("first")))
    # one row stands for a class; rows that are repeated as they are stay, as there is one place to find all of them
    alive = texts.join(checked(copies.select(*KEY)), KEY, "left_anti")
    places = kept_in_batches(alive.mapInArrow(_anchors, "kd long, kt long, g long, place int"), 256)
    common = places.groupBy("g").agg(F.min("kd").alias("low"), F.max("kd").alias("high"), F.count("*").alias("times")).where("low < high").drop("high")
    seeds = joined_by_key(places, kept(common), ["g"], "times").select(*KEY, "place").distinct()
    seeds = kept(seeds.groupBy(*KEY).agg(F.collect_list("place").alias("seeds")))
    found = kept_in_batches(alive.join(checked(seeds, 48 + 4 * F.size("seeds")), KEY).select(*KEY, "text", "seeds").mapInArrow(_extended, "kd long, kt long, start int, w0 long, w1 long"), 64)
    w = ["w0", "w1"]
    common = found.groupBy(*w).agg(F.min("kd").alias("low"), F.max("kd").alias("high"), F.count("*").alias("times")).where("low < high").drop("high")
    later = joined_by_key(found, kept(common), w, "times").where("kd > low").select(*KEY, "start").distinct()
    by = Window.partitionBy(*KEY).orderBy("start")
    new = F.col("start") > F.coalesce(F.lag("start").over(by) + WINDOW, F.lit(-1))
    islands = later.withColumn("new", new.cast("int")).withColumn("island", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    islands = islands.groupBy(*KEY, "island").agg(F.min("start").alias("first"), (F.max("start") + WINDOW).alias("last"))
    spans = islands.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("spans"))
    whole = F.array(F.struct(F.lit(0).alias("first"), F.col("n_words").cast("int").alias("last"))).alias("spans")
    # of a class, rows with the first one's id keep what it keeps
    twins = copies.where(F.col("kd") == F.col("first.kd")).select("first", *(F.col(c).alias(f"own_{c}") for c in KEY))
    twins = twins.join(spans, (F.col("first.kd") == F.col("kd")) & (F.col("first.kt") == F.col("kt"))).select(F.col("own_kd").alias("kd"), F.col("own_kt").alias("kt"), "spans")
    return spans.unionByName(twins).unionByName(copies.where(F.col("kd") > F.col("first.kd")).select(*KEY, whole))


def kept_parts(data: np.ndarray, spans: list[tuple[int, int]]) -> tuple[int, int, Iterator[bytes]]:
    """Words, words in spans, and the other words joined by one space, in parts."""
    start, end = word_bounds(data)
    gone = sum(b - a for a, b in spans)

    def parts() -> Iterator[bytes]:
        sep = b""
        for a, b in zip([0, *(z for _, z in spans)], [*(a for a, _ in spans), len(start)], strict=True):
            for i in range(a, b, WORDS):
                j = min(i + WORDS, b)
                yield sep + b" ".join(data[start[i] : end[j - 1]].tobytes().split())
                sep = b" "

    return len(start), gone, parts()


def _cut(as_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total, gone, out = [], [], []
            for text, spans in zip(b.column("text"), b.column("spans").to_pylist(), strict=True):
                n, removed, parts = kept_parts(_text(text), [(s["first"], s["last"]) for s in spans or []])
                total.append(n)
                gone.append(removed)
                if as_text:
                    out.append(b"".join(parts).decode())
                else:
                    sha = hashlib.sha256()
                    for p in parts:
                        sha.update(p)
                    out.append(sha.hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(out, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return run


def substring_deduped(docs: DataFrame, as_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words that stay, joined by one space; their SHA-256 if not as_text) of docs (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = alone(docs.sparkSession, lambda: repeated_spans(docs))
    rows = docs.select("doc_id", "text", *_key()).join(checked(found, 48 + 8 * F.size("spans")), KEY, "left").select("doc_id", "text", "spans")
    return kept_in_batches(rows.mapInArrow(_cut(as_text), "doc_id long, n_words long, n_removed long, kept string"), 256)


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_deduped(table(spark, sf_dir, "documents"), as_text=False).withColumnRenamed("kept", "kept_sha256")


#: From the definition, without anchors, for unique ids: every window against the first document that has it.
OP13_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, i, md5(array_to_string(w[i:i + {WINDOW - 1}], ' ')) AS h FROM d, unnest(range(1, len(w) - {WINDOW - 2})) AS r(i)),
later AS (SELECT doc_id, i FROM windows JOIN (SELECT h, min(doc_id) AS low FROM windows GROUP BY h) USING (h) WHERE low < doc_id),
gone AS (SELECT DISTINCT doc_id, i + k AS place FROM later, range({WINDOW}) AS r(k)),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS place FROM d),
rest AS (SELECT doc_id, string_agg(word, ' ' ORDER BY place) FILTER (WHERE g.place IS NULL) AS kept, count(g.place) AS n_removed FROM words LEFT JOIN gone g USING (doc_id, place) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN rest USING (doc_id)
"""
