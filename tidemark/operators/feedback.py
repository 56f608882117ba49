"""Counters over issues and feedback: the dashboard, feedback reports, log views and the admin list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numeric import or_else, rate
from tidemark.functions.status import reportable
from tidemark.functions.text import strip

SEVERE = 5


def counters(lower: bool = False) -> dict[str, Column]:
    """Aggregates over reportable issues. lower: feedback is compared in lower case, as the dashboard does."""
    f = F.lower(F.coalesce("feedback_type", F.lit(""))) if lower else F.coalesce("feedback_type", F.lit(""))
    given, severe = f.isin("agree", "reject"), F.col("severity") == SEVERE
    return {
        "issue_count": F.count("*"),
        "feedback_count": F.count_if(given),
        "severe_count": F.count_if(severe),
        "severe_feedback_count": F.count_if(severe & given),
        "severe_agree_count": F.count_if(severe & (f == "agree")),
        "severe_reject_count": F.count_if(severe & (f == "reject")),
    }


def with_rates(df: DataFrame) -> DataFrame:
    c = F.col
    return df.withColumns(
        {
            "feedback_rate": rate(c("feedback_count"), c("issue_count")),
            "severe_feedback_rate": rate(c("severe_feedback_count"), c("severe_count")),
            "severe_agree_rate": rate(c("severe_agree_count"), c("severe_feedback_count")),
        }
    )


def counted(issues: DataFrame, *keys: str) -> DataFrame:
    """Counters and rates of reportable issues, by keys or in all."""
    shown = issues.where(reportable(F.col("filter_status")))
    grouped = shown.groupBy(*keys) if keys else shown
    return with_rates(grouped.agg(*(v.alias(k) for k, v in counters().items())))


def severity_histogram(issues: DataFrame) -> DataFrame:
    """Severities 1 to 5, each with a row; others count in totals only."""
    dense = issues.sparkSession.range(1, 6).select(F.col("id").cast("int").alias("severity"))
    n = issues.where(reportable(F.col("filter_status"))).groupBy("severity").agg(F.count("*").alias("n"))
    return dense.join(F.broadcast(n.where(F.col("severity").between(1, 5))), "severity", "left").select("severity", F.coalesce("n", F.lit(0)).alias("n"))


def by_author(issues: DataFrame, files: DataFrame) -> DataFrame:
    """Counters for every author of files, those without issues too; authors are trimmed."""
    names = files.select(strip(F.coalesce("file_author", F.lit(""))).alias("author")).distinct()
    n = counted(issues.withColumn("author", strip(F.coalesce("file_author", F.lit("")))), "author")
    return names.join(n, "author", "left").na.fill(0)


def dashboard_tasks(tasks: DataFrame) -> DataFrame:
    """Tasks, projects and tokens; a task's total is its parts' sum where it is 0 or missing."""
    total = or_else(F.col("llm_total_tokens"), F.col("llm_prompt_tokens") + F.col("llm_completion_tokens"))
    return tasks.agg(
        F.count("*").alias("task_count"),
        F.count_distinct("project_id").alias("project_count"),
        F.coalesce(F.sum("llm_prompt_tokens"), F.lit(0)).alias("prompt_tokens"),
        F.coalesce(F.sum("llm_completion_tokens"), F.lit(0)).alias("completion_tokens"),
        F.coalesce(F.sum(total), F.lit(0)).alias("total_tokens"),
        F.coalesce(F.sum("llm_elapsed_ms"), F.lit(0)).alias("elapsed_ms"),
    )


def tasks_by_type(tasks: DataFrame) -> DataFrame:
    """Only types that occur: known ones by number, then others, null last."""
    n = tasks.groupBy("task_type").agg(F.count("*").alias("n"))
    return n.withColumn("place", F.when(F.col("task_type").isin(1, 2, 3), F.col("task_type")).when(F.col("task_type").isNull(), 1_000_000).otherwise(F.col("task_type") + 1000)).orderBy("place").drop("place")


def dashboard_files(files: DataFrame, statuses: Column) -> DataFrame:
    """One pass over nested files: no explode, so blocks, rounds, tools and issues don't multiply. statuses: each file's blocks'."""
    b = F.col("code_blocks")
    issues = F.flatten(F.transform(b, lambda x: x["issues"]))
    shown = F.filter(issues, lambda i: reportable(i["filter_status"]))
    said = lambda *w: F.size(F.filter(shown, lambda i: F.lower(F.coalesce(i["feedback_type"], F.lit(""))).isin(*w)))
    size = lambda k: F.aggregate(b, F.lit(0), lambda a, x: a + F.coalesce(F.size(x[k]), F.lit(0)))
    per = {
        "file_count": F.lit(1),
        "reviewed_count": F.when(statuses == "completed", 1).otherwise(0),
        "tool_call_count": size("tool_calls"),
        "block_round_count": size("model_rounds"),
        "valid_count": F.size(shown),
        "filtered_count": F.size(issues) - F.size(shown),
        "severe_count": F.size(F.filter(shown, lambda i: i["severity"] == SEVERE)),
        "feedback_count": said("agree", "reject"),
        "agree_count": said("agree"),
    }
    df = files.select(*(c.cast("long").alias(k) for k, c in per.items())).agg(*(F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in per))
    return df.withColumn("agree_rate", rate(F.col("agree_count"), F.col("feedback_count")))


def dashboard(tasks: DataFrame, issues: DataFrame, log: DataFrame) -> DataFrame:
    """One row: the tasks' figures, their issues' and the log's. tasks and log are in range already."""
    mine = issues.join(tasks.select(F.col("id").alias("task_id")), "task_id", "left_semi")
    shown = reportable(F.col("filter_status"))
    f = F.lower(F.coalesce("feedback_type", F.lit("")))
    per_issue = mine.agg(
        F.count_if(shown).alias("valid_count"),
        F.count_if(~shown).alias("filtered_count"),
        F.count_if(shown & (F.col("severity") == SEVERE)).alias("severe_count"),
        F.count_if(shown & f.isin("agree", "reject")).alias("feedback_count"),
        F.count_if(shown & (f == "agree")).alias("agree_count"),
    ).withColumn("agree_rate", rate(F.col("agree_count"), F.col("feedback_count")))
    past = log.agg(F.count("*").alias("past_count"), F.count_if(F.col("feedback_type") == "agree").alias("past_agree_count")).withColumn("past_agree_rate", rate(F.col("past_agree_count"), F.col("past_count")))
    one = F.lit(1).alias("one")
    out = dashboard_tasks(tasks).select("*", one).join(per_issue.select("*", one), "one").join(past.select("*", one), "one")
    return out.drop("one")


def log_counters() -> dict[str, Column]:
    severe, agree = F.col("severity") == SEVERE, F.col("feedback_type") == "agree"
    return {"feedback_count": F.count("*"), "agree_count": F.count_if(agree), "severe_count": F.count_if(severe), "severe_agree_count": F.count_if(severe & agree)}


def log_summary(log: DataFrame, *keys: str) -> DataFrame:
    """The log's counters, agreement rates and, by keys, the first time of each."""
    columns = [c.alias(k) for k, c in log_counters().items()]
    df = log.groupBy(*keys).agg(*columns, F.min("create_time").alias("first_seen")) if keys else log.agg(*columns)
    return df.withColumns({"agree_rate": rate(F.col("agree_count"), F.col("feedback_count")), "severe_agree_rate": rate(F.col("severe_agree_count"), F.col("severe_count"))})


def latest_feedback(log: DataFrame, *keys: str) -> DataFrame:
    return log.groupBy(*keys).agg(F.max_by("feedback_type", F.struct("create_time", "id")).alias("feedback_type"), F.max("create_time").alias("create_time"))


def issue_stats(issues: DataFrame) -> DataFrame:
    """By task: reportable issues, the highest severity and those of severity 5."""
    shown = issues.where(reportable(F.col("filter_status")))
    return shown.groupBy("task_id").agg(F.count("*").alias("issue_count"), F.max("severity").alias("highest_severity"), F.count_if(F.col("severity") == SEVERE).alias("critical_issue_count"))


def stored_issue_stats(tasks: DataFrame) -> DataFrame:
    """The same from a finished task's stored map of severities; negative counts are 0, and 0 counts for nothing. A map with a severity that isn't a number, where it counts, is
    no map: its task isn't among these."""
    entries = F.filter(F.map_entries("severity_counts"), lambda e: F.coalesce(e["value"], F.lit(0)) > 0)
    severity = lambda e: F.coalesce(F.nullif(F.trim(e["key"]), F.lit("")), F.lit("0")).try_cast("int")
    stored = tasks.where(F.col("state").isin(2, 3) & F.col("severity_counts").isNotNull() & F.forall(entries, lambda e: severity(e).isNotNull()))
    return stored.select(
        F.col("id").alias("task_id"),
        F.aggregate(entries, F.lit(0).cast("long"), lambda a, e: a + e["value"]).alias("issue_count"),
        F.array_max(F.transform(entries, severity)).alias("highest_severity"),
        F.aggregate(F.filter(entries, lambda e: severity(e) == SEVERE), F.lit(0).cast("long"), lambda a, e: a + e["value"]).alias("critical_issue_count"),
    )


#: What the admin list can be sorted by.
SORTS = ("create_time", "project_id", "review_version", "copy_from_version", "task_type", "state", "score", "issue_count", "critical_issue_count")


def admin_order(sort_by: str, descending: bool) -> list[Column]:
    """Ties go to the newer task in either direction, then to the id."""
    c = F.col(sort_by)
    first = c.desc_nulls_last() if descending else c.asc_nulls_first()
    return [first, *([] if sort_by == "create_time" else [F.col("create_time").desc_nulls_last()]), F.col("id").asc()]


def admin_list(tasks: DataFrame, issues: DataFrame) -> DataFrame:
    """Tasks with their issue figures: stored ones where there are, else counted; zeros without issues."""
    stored = stored_issue_stats(tasks)
    counted_ = issue_stats(issues.join(stored.select("task_id"), "task_id", "left_anti"))
    stats = stored.unionByName(counted_)
    out = tasks.join(stats, tasks.id == stats.task_id, "left").drop("task_id")
    return out.withColumns({"issue_count": F.coalesce("issue_count", F.lit(0)), "critical_issue_count": F.coalesce("critical_issue_count", F.lit(0))})


def contains_text(c: Column, term: str) -> Column:
    """The term as it is, trimmed, whatever its case."""
    return F.contains(F.lower(c), F.lit(term.strip().lower()))
