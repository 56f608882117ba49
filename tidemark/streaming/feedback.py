"""The feedback log as a stream: kept whole and without repeats in versioned tables, or counted as it arrives; equal to the batch views."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.feedback import log_counters, rate
from tidemark.versions import Versions


def log_stream(spark: SparkSession, path: str, schema: str, files: int | None = None) -> DataFrame:
    """files: how many a batch takes at most."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)


def by_version(log: DataFrame) -> DataFrame:
    """Counters by version. Late rows need no policy: the state is one row per version, and all of it is put out again."""
    df = log.groupBy("project_id", "review_version", "copy_from_version").agg(*(c.alias(k) for k, c in log_counters().items()), F.min("create_time").alias("first_seen"))
    return df.withColumns({"agree_rate": rate(F.col("agree_count"), F.col("feedback_count")), "severe_agree_rate": rate(F.col("severe_agree_count"), F.col("severe_count"))})


def by_day(log: DataFrame, late: str = "1 day") -> DataFrame:
    """Feedback per day and kind; days older than the watermark are closed, so the state stays bounded."""
    return log.withWatermark("create_time", late).groupBy(F.window("create_time", "1 day").alias("day"), "feedback_type").count()


def run_once(df: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> None:
    """All files that are there, then stop."""
    df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def row_hash(df: DataFrame) -> Column:
    """128 bits of all columns, in the order of their names: equal for equal rows, whichever drop they came in."""
    every = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    return F.md5(every.cast("binary"))


def sink(store: Versions, name: str = "log", figures: str = "log_by_version") -> Callable[[DataFrame, int], None]:
    """For foreachBatch: rows whose hash isn't stored yet are merged into table `name`, and the versions' figures are added up in table `figures`, both
    under one version that notes the stream's batch. A batch that was committed already does nothing, so one that was killed on its way is simply run
    again; a stream that begins anew, with another checkpoint, finds its rows' hashes stored.

    Stored rows are in buckets of their hash: a batch meets the hashes of those buckets that it has rows for, no other columns. Figures are sums, so
    only the batch's new rows are counted and the figures' few rows replaced.
    """
    versions = ["project_id", "review_version", "copy_from_version"]

    def take(batch: DataFrame, batch_id: int) -> None:
        stream = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or ""
        note = f"{name}.{stream}"

        def change(read: int) -> int | None:
            if store.notes(read).get(note, -1) >= batch_id:
                return None
            tables = store.names(read)
            rows = batch.withColumn("row_hash", row_hash(batch)).dropDuplicates(["row_hash"])
            if name in tables:
                rows = rows.join(store.read(name, read).select("row_hash"), "row_hash", "left_anti")
            new = rows.groupBy(*versions).agg(*(c.alias(k) for k, c in log_counters().items()), F.min("create_time").alias("first_seen"))
            if figures in tables:
                old = store.read(figures, read).join(new.select(*versions), versions, "left_semi").select(new.columns)
                sums = [F.sum(k).alias(k) for k in log_counters()]
                new = old.unionByName(new).groupBy(*versions).agg(*sums, F.min("first_seen").alias("first_seen"))
            new = new.withColumn("version_key", F.md5(F.concat_ws("\x1f", *versions).cast("binary")))
            return store.commit(read, merge={name: rows, figures: new}, keys={name: "row_hash", figures: "version_key"}, notes={note: batch_id})

        store.retried(change)

    return take


def drain(log: DataFrame, store: Versions, checkpoint: str, name: str = "log") -> None:
    """All files that are there, into the store; then stop."""
    log.writeStream.foreachBatch(sink(store, name)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def stored_by_version(store: Versions, figures: str = "log_by_version") -> DataFrame:
    """The figures as `log_summary` has them by version, from the sums alone."""
    df = store.read(figures).drop("version_key")
    return df.withColumns({"agree_rate": rate(F.col("agree_count"), F.col("feedback_count")), "severe_agree_rate": rate(F.col("severe_agree_count"), F.col("severe_count"))})

