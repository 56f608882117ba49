"""Tables in the folder that all executors see, and places and sums in an order without a global window."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see. Only a local session (tests) may leave it unnamed; a temporary one is set then."""
    set_already = spark.sparkContext._jsc.sc().getCheckpointDir()
    if set_already.isDefined():
        return set_already.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors see")
        named = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, named, True)
    spark.sparkContext.setCheckpointDir(named)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


_tables: list[str] = []


def _delete(spark: SparkSession, at: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def mark() -> int:
    """How many tables `kept` has written: what `clear` takes to delete only later ones."""
    return len(_tables)


def clear(spark: SparkSession, since: int = 0) -> None:
    """Delete the tables that `kept` has written (since a mark), once the results that read them are stored."""
    while len(_tables) > since:
        _delete(spark, _tables.pop())


def alone(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """make()'s result, kept; the tables that were kept on the way to it are deleted."""
    since = mark()
    out = kept(make())
    own = _tables.pop()
    clear(spark, since)
    _tables.append(own)
    return out


def scratch(spark: SparkSession) -> str:
    """A folder of its own in the shared one, which `clear` deletes with the tables."""
    at = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    _tables.append(at)
    return at


def kept(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(at)
    _tables.append(at)
    return spark.read.schema(df.schema).parquet(at)


def ranked(df: DataFrame, *order: Column, out: str = "rank", by: tuple[str, ...] = ()) -> DataFrame:
    """df with its place in this order, from 0, among all rows or within the groups of `by`, without bringing all rows or a group into one task.

    The sorted rows are written with their task's number; only the counts of each task and group are summed up in one place.
    """
    rows = kept(df.orderBy(*by, *order).withColumns({"_task": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    before = Window.partitionBy(*by).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("_task", *by).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    starts = counts.select(F.col("_task").alias("_of"), *(F.col(c).alias(f"_by_{c}") for c in by), (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_start"))
    on = F.col("_task") == F.col("_of")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    # without groups there is a row for each task, else one for each group more
    placed = rows.join(starts if by else F.broadcast(starts), on)
    return placed.withColumn(out, F.col("_start") + F.col("_at")).drop("_task", "_at", "_start", "_of", *(f"_by_{c}" for c in by))


def running(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """df with the sums of all rows before each in this order, as new columns, without bringing the rows into one task."""
    rows = kept(df.withColumns({f"_of_{k}": c for k, c in sums.items()}).orderBy(*order).withColumns({"_task": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    earlier = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("_task").agg(*(F.sum(f"_of_{k}").alias(f"_all_{k}") for k in sums))
    starts = starts.select("_task", *(F.coalesce(F.sum(f"_all_{k}").over(earlier), F.lit(0)).alias(f"_start_{k}") for k in sums))
    inside = Window.partitionBy("_task").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(F.broadcast(starts), "_task").withColumns({k: F.col(f"_start_{k}") + F.coalesce(F.sum(f"_of_{k}").over(inside), F.lit(0)) for k in sums})
    return out.drop("_task", "_at", *(f"_{p}_{k}" for k in sums for p in ("of", "start")))
