"""What the training-data operators share: inputs, shared storage, words, bounded label samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.shared import alone, clear, kept, ranked, running, scratch, shared_dir  # noqa: F401

#: A word is a run of anything but these six ASCII spaces.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, base: str) -> str:
    """A column name that df doesn't have, whatever extra columns it carries."""
    taken, name = {c.lower() for c in df.columns}, base
    while name.lower() in taken:
        name += "_"
    return name


def let(value: Column, body) -> Column:
    """body(value) with value computed once, inside one expression."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({WORD})"), F.lit(1))


def fold(doc_id: Column, k: int) -> Column:
    """crc32 of the id as text, mod k: the contract's split of labelled rows."""
    return F.crc32(doc_id.cast("string").cast("binary")) % k


def labelled_ids(labels: DataFrame, label: str, most: int, rows: Column | None = None, ones: int | None = None) -> DataFrame:
    """At most `most` labelled ids (doc_id, y), the first ones in hash order: a proven bound, safe to broadcast.

    ones: at most so many of them with label 1. Ids with a null id or label take no part.
    """
    ids = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).where(F.lit(True) if rows is None else rows)
    ids = ids.select("doc_id", F.col(label).cast("int").alias("y")).groupBy("doc_id").agg(F.max("y").alias("y"))
    order = (F.xxhash64("doc_id"), "doc_id")
    if ones is None:
        return ids.orderBy(*order).limit(most)
    return ids.where("y = 1").orderBy(*order).limit(ones).unionAll(ids.where("y = 0").orderBy(*order).limit(most - ones))


def kept_in_batches(df: DataFrame, rows: int) -> DataFrame:
    """df, which calls Python over Arrow batches, kept: batches have at most so many rows and, where these are long, about 8 MB. The session's settings are as before afterwards."""
    conf, values = df.sparkSession.conf, {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}
    before = {k: conf.get(k) for k in values}
    for k, v in values.items():
        conf.set(k, v)
    try:
        return kept(df)
    finally:
        for k, v in before.items():
            conf.set(k, v)


def sample_texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id, y and text of a bounded sample of ids (doc_id, y): one row for each id, whatever the number of rows that have it."""
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))


#: What is broadcast has at most so many rows and so many bytes, both counted; all else is joined by a shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 400_000, 32 << 20


def checked(rows: DataFrame, size: Column | None = None) -> DataFrame:
    """rows, written out, and marked for broadcast only if they were counted to be few. size: about how many bytes a row takes, if it isn't under 80."""
    rows = kept(rows)
    n, total = rows.agg(F.count("*"), F.sum(F.lit(80) if size is None else size)).first()
    return F.broadcast(rows) if n <= BROADCAST_ROWS and (total or 0) <= BROADCAST_BYTES else rows.hint("merge")


#: A key that more than this share of all rows have is hot: there are at most HOT of them.
HOT = 1000


def joined_by_key(rows: DataFrame, one: DataFrame, key: list[str], times: str) -> DataFrame:
    """rows joined with `one`, both stored tables: `one` has a row for each key, with the number of rows that have it in `times`.

    A hot key's rows would all come to one task, so hot keys, at most HOT by their definition, are broadcast; the rest are joined by a shuffle.
    """
    total = one.agg(F.sum(times)).first()[0] or 0
    is_hot = F.col(times) > F.lit(total // HOT)
    hot = one.where(is_hot)
    cold = rows.join(F.broadcast(hot.select(*key)), key, "left_anti").join(one.where(~is_hot).hint("merge"), key)
    return rows.join(F.broadcast(hot), key).unionByName(cold)
