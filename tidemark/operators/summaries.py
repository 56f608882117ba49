"""What a report, a snapshot and a finished task say about nested files (task_id, file_name, file_author, state, extra.status, code_blocks).

Every figure is reduced inside its row first, by higher-order functions, and then summed by task: blocks, issues, rounds and tools
are never exploded against each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numeric import clamp
from tidemark.functions.status import block_in_report, block_in_snapshot, file_in_report, file_in_snapshot, reportable, snapshot_task
from tidemark.functions.text import counts_text, strip
from tidemark.operators.feedback import SEVERE
from tidemark.operators.report import SCORES, block_weight
from tidemark.shared import kept

B = "code_blocks"


def _total(blocks: Column | str, value) -> Column:
    """The sum of a block's value over an array of blocks."""
    return F.aggregate(blocks, F.lit(0).cast("long"), lambda a, b: a + F.coalesce(value(b), F.lit(0)).cast("long"))


def _issues(blocks: Column | str) -> Column:
    return F.flatten(F.transform(blocks, lambda b: b["issues"]))


def _size(c: Column) -> Column:
    return F.greatest(F.size(c), F.lit(0))


def _weighed(blocks: Column | str, task_type: Column, bounded: bool) -> dict[str, Column]:
    """The weight of blocks and, for each score, the weighted sum."""
    value = lambda b, s: clamp(b[s], 0, 100, 0) if bounded else F.coalesce(b[s], F.lit(0))
    weights = {"weight": _total(blocks, lambda b: block_weight(b["contents"], task_type))}
    return weights | {f"_{s}": _total(blocks, lambda b, s=s: value(b, s) * block_weight(b["contents"], task_type)) for s in SCORES}


def _scored(df: DataFrame) -> DataFrame:
    """Scores from weighted sums, half-even; 0 without weight; and their mean, half-even."""
    scores = {s: F.when(F.col("weight") > 0, F.bround(F.col(f"_{s}") / F.col("weight"), 0)).otherwise(0).cast("int") for s in SCORES}
    df = df.withColumns(scores).drop(*(f"_{s}" for s in SCORES))
    return df.withColumn("overall_score", overall(*map(F.col, SCORES)))


def overall(*scores: Column) -> Column:
    """The plain mean of scores, half-even."""
    return F.bround(sum(scores[1:], scores[0]) / len(scores), 0).cast("int")


def file_rows(files: DataFrame, task_type: Column) -> DataFrame:
    """A report's rows of files: trimmed author, status, completed and failed blocks, weight and scores of the file alone."""
    state, status = F.col("state"), F.col("extra.status")
    per = files.withColumns({"_s": F.transform(B, lambda b: block_in_report(b, state, status)), **_weighed(B, task_type, True)})
    n = lambda what: F.size(F.filter("_s", lambda x: x == what))
    per = per.withColumns({"status": file_in_report(F.col("_s"), state, status), "completed_block_num": n("completed"), "failed_block_num": n("failed"), "file_author": strip(F.coalesce("file_author", F.lit("")))})
    keep = ["task_id", "file_name", "file_author", "state", "status", "completed_block_num", "failed_block_num", F.col("weight").alias("changed_line_num"), F.coalesce("add_code_line_num", F.lit(0)).alias("added_line_num")]
    return _scored(per).select(*keep, "overall_score", *SCORES)


def task_metrics(files: DataFrame, tasks: DataFrame) -> DataFrame:
    """A report's figures by task: all files count, whatever author or page is shown. tasks: id, task_type and task_round_num, its rounds outside blocks."""
    files = files.join(tasks.select(F.col("id").alias("task_id"), "task_type", "task_round_num"), "task_id")
    state, status = F.col("state"), F.col("extra.status")
    every = _issues(B)
    shown = F.filter(every, lambda i: reportable(i["filter_status"]))
    file = file_in_report(F.transform(B, lambda b: block_in_report(b, state, status)), state, status)
    per = {
        "file_num": F.lit(1),
        "reviewed_file_num": (file == "completed").cast("int"),
        "incomplete_file_num": (file == "failed").cast("int"),
        "code_block_num": F.size(B),
        "issue_num": F.size(shown),
        "filtered_issue_num": F.size(every) - F.size(shown),
        "critical_issue_num": F.size(F.filter(shown, lambda i: i["severity"] == SEVERE)),
        "tool_call_num": _total(B, lambda b: _size(b["tool_calls"])),
        "block_round_num": _total(B, lambda b: _size(b["model_rounds"])),
        "memory_compression_num": _total(B, lambda b: b["memory_compression_count"]),
        "added_line_num": F.coalesce("add_code_line_num", F.lit(0)),
        **_weighed(B, F.col("task_type"), True),
    }
    out = files.select("task_id", "task_round_num", *(c.cast("long").alias(k) for k, c in per.items())).groupBy("task_id").agg(F.max(F.coalesce("task_round_num", F.lit(0))).alias("rounds"), *(F.sum(k).alias(k) for k in per))
    out = out.withColumn("model_round_num", F.col("block_round_num") + F.col("rounds")).drop("block_round_num", "rounds")
    return _scored(out).withColumnRenamed("weight", "changed_line_num")


def authors(files: DataFrame) -> DataFrame:
    """By task, its authors: trimmed, not blank, sorted, each once."""
    name = F.nullif(strip(F.coalesce("file_author", F.lit(""))), F.lit(""))
    return files.groupBy("task_id").agg(F.array_sort(F.collect_set(name)).alias("authors"))


def by_author(files: DataFrame, author: str) -> DataFrame:
    """Files of an author of the task; of all authors if that name is none of them."""
    name = strip(F.coalesce("file_author", F.lit("")))
    if not author.strip():
        return files
    known = F.broadcast(files.agg(F.count_if(name == author.strip()).alias("_known"), F.lit(1).alias("_one")))
    return files.withColumn("_one", F.lit(1)).join(known, "_one").where((F.col("_known") == 0) | (name == author.strip())).drop("_one", "_known")


def _counted(rows: DataFrame, value: Column, out: str) -> DataFrame:
    """By task, a map of how often each value occurs, as its sorted text would list it."""
    n = rows.select("task_id", value.alias("k")).groupBy("task_id", "k").agg(F.count("*").alias("n"))
    return n.groupBy("task_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias(out))


def issue_maps(files: DataFrame) -> DataFrame:
    """By task, reportable issues by type (none is `general`) and by severity (none is 0)."""
    i = files.select("task_id", F.explode(_issues(B)).alias("i")).where(reportable(F.col("i.filter_status")))
    kind = F.coalesce(F.nullif("i.type", F.lit("")), F.lit("general"))
    by_type = _counted(i, kind, "issue_type_counts")
    return by_type.join(_counted(i, F.coalesce("i.severity", F.lit(0)).cast("string"), "severity_counts"), "task_id")


def tool_map(files: DataFrame) -> DataFrame:
    tools = files.select("task_id", F.explode(F.flatten(F.transform(B, lambda b: b["tool_calls"]))).alias("t"))
    return _counted(tools, F.col("t.tool_name"), "tool_call_summary")


USAGE = ("process_time", "llm_prompt_tokens", "llm_completion_tokens", "llm_total_tokens", "llm_elapsed_ms")


def snapshot_rollup(files: DataFrame, snapshots: DataFrame) -> DataFrame:
    """What a snapshot's files make of it: status, file and block counts, unclamped scores of completed blocks, usage and histograms.

    snapshots: task_id, task_type, parent_state, finalize and has_removals. A snapshot without files keeps its zeros.
    """
    own = F.transform(B, block_in_snapshot)
    done = F.filter(B, lambda b: block_in_snapshot(b) == "completed")
    f = files.join(snapshots.select("task_id", "task_type"), "task_id").withColumns({"_own": own, "_done": done})
    of_file = file_in_snapshot(F.col("_own"))
    any_of = lambda *w: F.exists("_own", lambda s: s.isin(*w)).cast("int")
    per = {
        "file_num": F.lit(1),
        "reviewed_file_num": (of_file == "reviewed").cast("int"),
        "incomplete_file_num": (of_file == "partial").cast("int"),
        "code_block_num": F.size(B),
        "add_code_line_num": F.coalesce("add_code_line_num", F.lit(0)),
        "estimated_token_num": F.coalesce("extra.estimated_tokens", F.lit(0)),
        "llm_call_count": _total(B, lambda b: F.size(F.filter(b["model_rounds"], lambda r: r["model"] != "local"))),
        **{c: _total(B, lambda b, c=c: b[c]) for c in USAGE},
        **_weighed(F.col("_done"), F.col("task_type"), False),
        "_failed": any_of("failed"),
        "_pending": any_of("pending"),
        "_reviewing": any_of("reviewing"),
    }
    got = f.select("task_id", *(c.cast("long").alias(k) for k, c in per.items())).groupBy("task_id").agg(*(F.sum(k).alias(k) for k in per))
    out = snapshots.join(got, "task_id", "left").na.fill(0, list(per))
    kinds = F.array_compact(F.array(*(F.when(F.col(f"_{k}") > 0, k) for k in ("failed", "pending", "reviewing"))))
    statuses = F.when((F.size(kinds) == 0) & (F.col("code_block_num") > 0), F.array(F.lit("completed"))).otherwise(kinds)
    out = out.withColumn("state", snapshot_task(statuses, F.col("has_removals"), F.col("finalize"), F.col("parent_state")))
    word = F.element_at(F.array(*map(F.lit, ("pending", "running", "completed", "partial"))), F.col("state") + 1)
    out = _scored(out.withColumn("completion_status", word).drop("_failed", "_pending", "_reviewing")).drop("weight").withColumnRenamed("overall_score", "score")
    return out.join(issue_maps(files), "task_id", "left").join(tool_map(files), "task_id", "left")


def _counts(rows: DataFrame, **arrays: str) -> DataFrame:
    """By task, a map for each of arrays (name: column) of how often each value occurs; null for a task without values. One pass over rows, however many arrays."""
    tagged = lambda k, c: F.transform(c, lambda x: F.struct(F.lit(k).alias("of"), x.alias("k")))
    value = F.explode(F.flatten(F.array(*(tagged(k, c) for k, c in arrays.items()))))
    n = rows.select("task_id", value.alias("v")).groupBy("task_id", "v.of", "v.k").agg(F.count("*").alias("n"))
    entries = lambda k: F.array_sort(F.collect_list(F.when(F.col("of") == k, F.struct("k", "n"))))
    return n.groupBy("task_id").agg(*(F.map_from_entries(F.nullif(entries(k), F.array().cast("array<struct<k:string,n:bigint>>"))).alias(k) for k in arrays))


def finished(files: DataFrame, tasks: DataFrame, top: int = 10) -> DataFrame:
    """What a finished review makes of its task: status counts, tokens, histograms, static findings, the files with most issues, the summary's text and scores:
    those of reviewed files' blocks, weighed by changed lines whatever the type and not clamped; the task's score is their mean, truncated.

    Files carry comment_line_number, and extra with status and estimated_tokens.
    """
    status = F.coalesce(F.nullif("extra.status", F.lit("")), F.lit("unknown"))
    reviewed = F.coalesce(F.col("extra.status").isin("reviewed", "resumed"), F.lit(False))
    tokens = F.coalesce("extra.estimated_tokens", F.lit(0)).cast("long")
    shown = F.filter(_issues(B), lambda i: reportable(i["filter_status"]))
    per = files.select(
        "task_id",
        "file_name",
        status.alias("status"),
        reviewed.alias("reviewed"),
        tokens.alias("tokens"),
        F.size(B).alias("blocks"),
        F.coalesce("comment_line_number", F.lit(0)).alias("comments"),
        F.coalesce("add_code_line_num", F.lit(0)).alias("added"),
        _total(B, lambda b: _size(b["static_findings"])).alias("findings"),
        F.size(F.filter(shown, lambda i: F.coalesce(i["static_corroborated"], F.lit(False)))).alias("corroborated"),
        F.size(shown).alias("shown"),
        F.transform(shown, lambda i: F.coalesce(F.nullif(i["type"], F.lit("")), F.lit("general"))).alias("kinds"),
        F.transform(shown, lambda i: F.coalesce(i["severity"], F.lit(0)).cast("string")).alias("severities"),
        F.transform(F.flatten(F.transform(B, lambda b: b["static_findings"])), lambda s: F.coalesce(F.nullif(s["analyzer"], F.lit("")), F.lit("unknown"))).alias("analyzers"),
        *(F.when(reviewed, c).otherwise(0).alias(k) for k, c in _weighed(B, F.lit(1), False).items()),
    )
    per = kept(per)  # what is counted below comes from these rows; the nested files are read and reduced once
    is_ = lambda *w: F.col("status").isin(*w)
    out = per.groupBy("task_id").agg(
        F.count("*").alias("file_num"),
        F.count_if("reviewed").alias("reviewed_file_num"),
        F.count_if(is_("resumed")).alias("resumed_file_num"),
        F.count_if(is_("skipped_budget")).alias("skipped_file_num"),
        F.count_if(is_("partial", "skipped_budget")).alias("incomplete_file_num"),
        F.count_if(is_("partial")).alias("retryable_file_num"),
        F.sum("blocks").alias("code_block_num"),
        F.sum("added").alias("add_code_line_num"),
        F.sum("comments").alias("comment_line_number"),
        F.sum("tokens").alias("estimated_token_num"),
        F.sum(F.when(is_("reviewed"), F.col("tokens")).otherwise(0)).alias("consumed_estimated_token_num"),
        F.sum("findings").alias("static_finding_count"),
        F.sum("corroborated").alias("static_corroborated_issue_count"),
        F.sum("shown").alias("issue_num"),
        F.count_if(F.col("comments") > 0).alias("files_with_issues"),
        *(F.sum(k).alias(k) for k in ("weight", *(f"_{s}" for s in SCORES))),
    )
    out = _scored(out).drop("weight", "overall_score")
    # only the first files of each task are brought together
    place = F.row_number().over(Window.partitionBy("task_id").orderBy(F.desc("comments"), "file_name"))
    best = F.array_sort(F.collect_list(F.struct((-F.col("comments")).alias("n"), "file_name")))
    first = per.where("comments > 0").select("task_id", "comments", "file_name").withColumn("place", place).where(F.col("place") <= top).groupBy("task_id").agg(best.alias("top"))
    out = out.join(first, "task_id", "left").join(_counted(per, F.col("status"), "status_counts"), "task_id")
    out = out.join(_counts(per, issue_type_counts="kinds", severity_counts="severities", static_sources="analyzers"), "task_id", "left")
    out = tasks.select(F.col("id").alias("task_id"), "retry_count").join(out, "task_id")
    out = out.withColumns({"state": F.when(F.col("incomplete_file_num") > 0, 3).otherwise(2), "retry_count": F.coalesce("retry_count", F.lit(0)) + (F.col("incomplete_file_num") > 0).cast("int")})
    total = sum((F.col(s) for s in SCORES[1:]), F.col(SCORES[0]))
    out = out.withColumns({"completion_status": F.when(F.col("state") == 3, "partial").otherwise("completed"), "score": F.floor(total / len(SCORES)).cast("int"), "top_files": F.transform(F.coalesce("top", F.array().cast("array<struct<n:int,file_name:string>>")), lambda x: F.struct(x["file_name"], (-x["n"]).alias("issue_count")))})
    return out.withColumn("project_summary", summary_text(F.col("issue_num"), F.size("top_files"), F.col("issue_type_counts"), F.col("severity_counts"))).drop("top")


def summary_text(issues: Column, top_files: Column, types: Column, severities: Column) -> Column:
    """The text of a project's summary that needs no model. Fixed wording, as it is stored and shown."""
    counted = lambda m: F.coalesce(F.nullif(counts_text(m, "，"), F.lit("")), F.lit("无"))
    parts = (F.lit("本次审核发现 "), issues.cast("string"), F.lit(" 个展示问题，涉及 "), top_files.cast("string"), F.lit(" 个重点文件；主要类型："), counted(types), F.lit("；严重度分布："), counted(severities), F.lit("。"))
    return F.when(issues > 0, F.concat(*parts)).otherwise("本次审核未发现需要展示的问题。")


def new_snapshot(files: DataFrame, changed: DataFrame, removed: list[str]) -> DataFrame:
    """One row: the changed files and blocks that a trigger's snapshot holds, by name in order; no row if nothing changed.

    files: id and file_name of the task's files; changed: file_name, block_id and block_hash of changed blocks (a null block for a file without any).
    """
    both = changed.join(files.select(F.col("id").alias("file_id"), "file_name"), "file_name", "left")
    blocks = F.array_sort(F.collect_list(F.when(F.col("file_id").isNotNull() & F.col("block_hash").isNotNull(), F.struct("file_name", F.coalesce("block_id", F.lit(0)).alias("block_id"), "block_hash", "file_id"))))
    names = F.array_sort(F.collect_set("file_name"))
    known = F.transform(F.array_sort(F.collect_set(F.when(F.col("file_id").isNotNull(), F.struct("file_name", "file_id")))), lambda x: x["file_id"])
    out = both.agg(names.alias("changed_file_names"), known.alias("changed_files"), blocks.alias("changed_blocks"))
    gone = F.array(*map(F.lit, sorted(removed))).cast("array<string>")
    out = out.withColumns({"removed_file_names": gone, "report_file_names": F.array_sort(F.concat("changed_file_names", gone)), "state": F.lit(0), "completion_status": F.lit("pending")})
    return out.where((F.size("changed_file_names") > 0) | (F.size("removed_file_names") > 0))
