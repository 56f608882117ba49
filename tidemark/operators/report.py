"""The task report: weights, scores, progress, critical issues, roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numeric import clamp, weighted_mean
from tidemark.functions.status import block_in_report, block_in_retry, file_in_report, progress, reportable, retry_possible

SCORES = ("logic_score", "performance_score", "security_score", "readable_score", "code_style_score")


def block_weight(contents: Column, task_type: Column) -> Column:
    """Changed lines in an increment (types 1 and 2), else all lines, at least 1, of a block that has lines; 0 without lines."""
    changed = F.size(F.filter(contents, lambda x: F.substring(x, 7, 1).isin("+", "-")))
    n = F.when(task_type.isin(1, 2), changed).otherwise(F.size(contents))
    return F.when(F.size(contents) > 0, F.greatest(n, F.lit(1))).otherwise(F.lit(0))


def weighted_scores(blocks: DataFrame, *keys: str, how: str = "round", clamped: bool = True) -> DataFrame:
    """Mean scores by weight (columns: keys, weight, the scores). how: floor for a finished task's variant."""
    value = lambda s: clamp(F.col(s), 0, 100) if clamped else F.col(s)
    return blocks.groupBy(*keys).agg(*(weighted_mean(value(s), F.col("weight"), how).alias(s) for s in SCORES if s in blocks.columns))


def average_completed(blocks: DataFrame, *keys: str) -> DataFrame:
    """The variant at synchronisation: completed blocks count alike."""
    return blocks.where("completed").groupBy(*keys).agg(*(F.coalesce(F.bround(F.avg(s), 0).cast("int"), F.lit(0)).alias(s) for s in SCORES if s in blocks.columns))


def blocks_of(files: DataFrame, task_type: Column) -> DataFrame:
    each = files.select("task_id", "file_name", "file_author", F.explode("code_blocks").alias("b"))
    return each.select("task_id", "file_name", "file_author", "b.block_id", block_weight(F.col("b.contents"), task_type).alias("weight"), *(f"b.{s}" for s in SCORES))


def progress_of(tasks: DataFrame, files: DataFrame) -> DataFrame:
    """Files and blocks by status, percent done, and whether failed blocks can be tried again."""
    state, status = F.col("state"), F.col("extra.status")
    per = files.select("task_id", state, status.alias("status"), F.transform("code_blocks", lambda b: block_in_report(b, state, status)).alias("s"))
    per = per.withColumn("file", file_in_report(F.col("s"), F.col("state"), F.col("status")))
    n = lambda what: F.size(F.filter("s", lambda x: x == what))
    agg = per.groupBy("task_id").agg(
        F.count("*").alias("files"),
        *(F.count_if(F.col("file") == w).alias(f"{w}_files") for w in ("completed", "reviewing", "pending", "failed")),
        F.sum(F.size("s")).alias("blocks"),
        *(F.sum(n(w)).alias(f"{w}_blocks") for w in ("completed", "reviewing", "pending", "failed")),
        F.count_if(F.array_contains("s", "failed")).alias("retryable_files"),
    )
    counted = [c for c in agg.columns if c != "task_id"]
    out = tasks.select("id", F.col("state").alias("task_state"), F.coalesce("retry_failed_only", F.lit(False)).alias("only_failed")).join(agg, F.col("id") == F.col("task_id"), "left").drop("task_id").na.fill(0, counted)
    c = F.col
    out = out.withColumn("percent", progress(c("completed_blocks"), c("blocks"), c("completed_files"), c("files"), c("task_state")))
    out = out.withColumn("retry_in_progress", c("only_failed") & c("task_state").isin(0, 1))
    return out.withColumn("retry_available", retry_possible(c("percent"), c("failed_blocks"), c("pending_blocks") + c("reviewing_blocks"), c("task_state"), c("retry_in_progress")))


def retry_failures(files: DataFrame) -> DataFrame:
    """By task, what a manual retry would find: files with failed blocks, failed, pending and running blocks. Files skipped for budget don't count."""
    status = F.coalesce("extra.status", F.lit(""))
    s = files.where(status != "skipped_budget").select("task_id", F.transform("code_blocks", lambda b: block_in_retry(b, status)).alias("s"))
    n = lambda what: F.size(F.filter("s", lambda x: x == what))
    return s.groupBy("task_id").agg(F.count_if(n("failed") > 0).alias("files"), *(F.sum(n(w)).alias(w) for w in ("failed", "pending", "running")))


def critical_issues(issues: DataFrame) -> DataFrame:
    """Reportable issues of severity 5, in order of file, block and issue."""
    return issues.where(reportable(F.col("filter_status")) & (F.col("severity") == 5)).orderBy("file_name", "block_id", F.coalesce("issue_id", F.lit(0)))


def top_files(issues: DataFrame, k: int = 10) -> DataFrame:
    """Files with the most reportable issues; ties by name."""
    n = issues.where(reportable(F.col("filter_status"))).groupBy("file_name").agg(F.count("*").alias("issue_count"))
    return n.orderBy(F.desc("issue_count"), "file_name").limit(k)


def histogram(df: DataFrame, key: str, value: str, default: str = "") -> DataFrame:
    """By key, a map of how often each value occurs."""
    n = df.withColumn(value, F.coalesce(F.nullif(F.col(value), F.lit("")), F.lit(default))).groupBy(key, value).agg(F.count("*").alias("n"))
    return n.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(value, "n")))).alias("counts"))


def merged_counts(a: Column, b: Column) -> Column:
    """Two maps of counts, added up."""
    return F.map_zip_with(a, b, lambda _, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))


def owners(issues: DataFrame) -> DataFrame:
    """Severe and other reportable issues of each owner; a blank one is an owner too."""
    shown = issues.where(reportable(F.col("filter_status"))).withColumn("owner", F.trim(F.coalesce("file_author", F.lit(""))))
    return shown.groupBy("owner").agg(F.count_if(F.col("severity") == 5).alias("severe"), F.count_if(F.coalesce(F.col("severity") != 5, F.lit(True))).alias("other"))


def last_messages(messages: DataFrame) -> DataFrame:
    """By conversation: messages by role, and the last ones of the user and of a tool."""
    roles = ("system", "user", "assistant", "tool")
    last = lambda r: F.max_by(F.when(F.col("role") == r, F.col("text")), F.when(F.col("role") == r, F.col("turn"))).alias(f"last_{r}")
    return messages.groupBy("conv_id").agg(*(F.count_if(F.col("role") == r).alias(f"{r}_count") for r in roles), last("user"), last("tool"))
