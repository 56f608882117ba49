"""One function for each read endpoint: tables and parameters in, DataFrames out. Only page numbers come to the driver."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import status
from tidemark.functions.numeric import to_int
from tidemark.functions.status import reportable
from tidemark.functions.text import strip
from tidemark.operators import control, feedback, report, summaries
from tidemark.operators.rollup import display_name
from tidemark.shared import kept
from tidemark.sources.views import RequestError, author_is, date_range, issues_of, page_of, within

#: Names of task types, which views there are of feedback, and the type of each.
TASK_TYPES = {1: "轮询版", 2: "正式版", 3: "全量审核"}
VIEWS = {"prd_version": 2, "full_scan": 3, "author_prd": 2, "author_full": 3}
NO_TYPE = "未分类"


@dataclass(frozen=True)
class Page:
    rows: DataFrame
    page: int
    pages: int


def _page(df: DataFrame, order: list[Column], page: int, size: int) -> Page:
    return Page(*page_of(df, order, page, size))


def type_name(task_type: Column) -> Column:
    names = F.create_map(*(F.lit(x) for kv in TASK_TYPES.items() for x in kv))
    return F.coalesce(F.try_element_at(names, task_type), F.lit(NO_TYPE))


def issue_view(issues: DataFrame) -> DataFrame:
    """An issue's row as it is shown: a missing number is 0, a missing text is empty."""
    numbers, texts = ("issue_id", "severity"), ("issue_line_numbers", "type", "description", "suggestion", "feedback_type", "feedback_content")
    return issues.withColumns({c: to_int(F.col(c)) for c in numbers if c in issues.columns} | {c: F.coalesce(F.col(c), F.lit("")) for c in texts if c in issues.columns})


def dashboard(tasks: DataFrame, files: DataFrame, log: DataFrame, start: dt.date | None, end: dt.date | None, today: dt.date) -> dict[str, DataFrame]:
    """The dashboard of a range: the tasks' figures, their number by type, their files' figures, all model rounds, and the log's figures."""
    start, end = date_range(start, end, today)
    mine = tasks.where(within(F.col("create_time"), start, end))
    ids = mine.select(F.col("id").alias("task_id"))
    own = files.join(ids, "task_id", "left_semi")
    s = F.transform("code_blocks", lambda b: status.block_in_dashboard(b, F.col("state"), F.col("extra.status")))
    of_files = feedback.dashboard_files(own, status.file_in_report(s, F.col("state"), F.col("extra.status")))
    rounds = mine.agg(F.coalesce(F.sum(F.greatest(F.size("task_model_rounds"), F.lit(0))), F.lit(0)).alias("task_round_count"), F.lit(1).alias("one"))
    of_files = of_files.withColumn("one", F.lit(1)).join(rounds, "one").withColumn("model_round_count", F.col("block_round_count") + F.col("task_round_count")).drop("one", "task_round_count", "block_round_count")
    return {"tasks": feedback.dashboard_tasks(mine), "by_type": feedback.tasks_by_type(mine).withColumn("name", type_name(F.col("task_type"))), "files": of_files, "log": feedback.log_summary(log.where(within(F.col("create_time"), start, end)))}


def admin_tasks(
    tasks: DataFrame, issues: DataFrame, project_id: str = "", review_version: str = "", date_from: dt.datetime | None = None, date_to: dt.datetime | None = None,
    task_type: int | None = None, state: int | None = None, sort_by: str = "create_time", descending: bool = True, page: int = 1, size: int = 20,
) -> Page:
    """The admin list: literal searches whatever the case, a closed range of times (an aware one in UTC), equal type and state, one page in order.

    Only tasks that are listed get their issues counted, and unless these are what it is sorted by, only those of the page.
    """
    if sort_by not in feedback.SORTS:
        raise RequestError(f"can't sort by {sort_by}")
    plain = lambda t: t.astimezone(dt.UTC).replace(tzinfo=None) if t is not None and t.tzinfo else t
    date_from, date_to = plain(date_from), plain(date_to)
    if date_from and date_to and date_from > date_to:
        raise RequestError("the range starts after its end")
    time = F.col("create_time")
    wanted = {
        "project": feedback.contains_text(F.col("project_id"), project_id) if project_id.strip() else None,
        "version": feedback.contains_text(F.col("review_version"), review_version) if review_version.strip() else None,
        "from": time >= F.lit(date_from) if date_from else None,
        "to": time <= F.lit(date_to) if date_to else None,
        "type": F.col("task_type") == task_type if task_type is not None else None,
        "state": F.col("state") == state if state is not None else None,
    }
    for c in wanted.values():
        tasks = tasks if c is None else tasks.where(c)
    order = feedback.admin_order(sort_by, descending)
    if sort_by in ("issue_count", "critical_issue_count"):
        return _page(feedback.admin_list(tasks, issues.join(tasks.select(F.col("id").alias("task_id")), "task_id", "left_semi")), order, page, size)
    listed = _page(tasks, order, page, size)
    own = issues.join(listed.rows.select(F.col("id").alias("task_id")), "task_id", "left_semi")
    return Page(feedback.admin_list(listed.rows, own).orderBy(*order), listed.page, listed.pages)


def _view(tasks: DataFrame, files: DataFrame, task_type: int, start: dt.date | None, end: dt.date | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A view's tasks, their files and their files' issues; either day may be left out."""
    if start and end and start > end:
        raise RequestError("the range starts after its end")
    mine = tasks.where((F.col("task_type") == task_type) & within(F.col("create_time"), start, end))
    own = files.join(mine.select(F.col("id").alias("task_id")), "task_id", "left_semi")
    return mine, own, issues_of(own)


def feedback_admin(tasks: DataFrame, files: DataFrame, names: DataFrame, view: str, start: dt.date | None = None, end: dt.date | None = None, page: int = 1, size: int = 20) -> dict[str, DataFrame | Page]:
    """Feedback of a view: the summary, severities 1 to 5, and a page of tasks (the newest first) or of authors (by display name, then account). names: account, name."""
    if view not in VIEWS:
        raise RequestError(f"no view {view}")
    mine, own, issues = _view(tasks, files, VIEWS[view], start, end)
    one = F.lit(1).alias("one")
    author = strip(F.coalesce("file_author", F.lit("")))
    sets = mine.agg(F.count_distinct("project_id").alias("projects"), F.count_distinct(F.struct("project_id", "review_version")).alias("versions")).select("*", one)
    summary = feedback.counted(issues).select("*", one).join(sets, "one").join(own.agg(F.count_distinct(author).alias("authors")).select("*", one), "one").drop("one")
    if view.startswith("author_"):
        rows = kept(display_name(feedback.by_author(issues, own), names, "author"))  # counted for pages, and read for one
        items = _page(rows, [F.asc("display_name"), F.asc("author")], page, size)
    else:
        n = feedback.counted(issues, "task_id")
        rows = mine.select(F.col("id").alias("task_id"), "project_id", "review_version", "copy_from_version", "create_time").join(n, "task_id", "left").na.fill(0)
        items = _page(rows, [F.desc("create_time"), F.desc("task_id")], page, size)
    return {"summary": summary, "severities": feedback.severity_histogram(issues), "items": items}


def author_report(tasks: DataFrame, files: DataFrame, author: str, task_type: int, start: dt.date | None = None, end: dt.date | None = None, page: int = 1, size: int = 20) -> dict[str, DataFrame | Page]:
    """An author's issues (the worst first, then by file, block and issue), counters, and files, those without issues too. `__empty__` stands for no author."""
    if task_type not in (2, 3):
        raise RequestError("authors have reports of types 2 and 3")
    _, own, issues = _view(tasks, files, task_type, start, end)
    own, issues = (df.where(author_is(F.col("file_author"), author)) for df in (own, issues))
    one = F.lit(1).alias("one")
    summary = feedback.counted(issues).select("*", one).join(own.agg(F.count("*").alias("file_count")).select("*", one), "one").drop("one")
    shown = issue_view(issues.where(reportable(F.col("filter_status"))))
    order = [F.desc("severity"), F.asc("file_name"), F.asc("block_id"), *([F.asc("issue_id")] if "issue_id" in shown.columns else [])]
    return {"summary": summary, "items": _page(shown, order, page, size)}


def log_items(log: DataFrame, group_by: str) -> tuple[DataFrame, list[Column]]:
    """The log's rows, versions or authors (trimmed), and their order: as they came, or by when each was first seen."""
    if group_by == "version":
        keys = ["project_id", "review_version", "copy_from_version"]
        return feedback.log_summary(log, *keys), [F.asc("first_seen"), *map(F.asc, keys)]
    if group_by == "author":
        named = log.withColumn("author", strip(F.coalesce("file_author", F.lit(""))))
        return feedback.log_summary(named, "author"), [F.asc("first_seen"), F.asc("author")]
    if group_by != "none":
        raise RequestError(f"can't group by {group_by}")
    return log_view(log), [F.asc("create_time"), F.asc("id")]


def log_view(log: DataFrame) -> DataFrame:
    """A log row as it is shown: nulls filled in, the author trimmed."""
    texts = [c for c in ("issue_line_numbers", "suggestion", "description", "feedback_type", "feedback_content", "file_name") if c in log.columns]
    return log.withColumns({"severity": to_int(F.col("severity")), "author": strip(F.coalesce("file_author", F.lit("")))} | {c: F.coalesce(F.col(c), F.lit("")) for c in texts})


def feedback_logs(log: DataFrame, group_by: str, start: dt.date | None, end: dt.date | None, today: dt.date, page: int = 1, size: int = 20) -> dict[str, DataFrame | Page]:
    start, end = date_range(start, end, today)
    mine = log.where(within(F.col("create_time"), start, end))
    rows, order = log_items(mine, group_by)
    return {"summary": feedback.log_summary(mine), "items": _page(rows, order, page, size)}


def feedback_log_of_version(log: DataFrame, project_id: str, review_version: str, copy_from_version: str, start: dt.date | None, end: dt.date | None, today: dt.date) -> dict[str, DataFrame]:
    """All feedback on one version, in order of time."""
    start, end = date_range(start, end, today)
    same = (F.col("project_id") == project_id) & (F.col("review_version") == review_version) & (F.col("copy_from_version") == copy_from_version)
    mine = log.where(within(F.col("create_time"), start, end) & same)
    return {"summary": feedback.log_summary(mine), "items": log_view(mine).orderBy("create_time", "id")}


def feedback_log_of_author(log: DataFrame, author: str, start: dt.date | None, end: dt.date | None, today: dt.date, page: int = 1, size: int = 20) -> dict[str, DataFrame | Page]:
    if not author.strip():
        raise RequestError("an author is needed")
    start, end = date_range(start, end, today)
    mine = log.where(within(F.col("create_time"), start, end) & author_is(F.col("file_author"), author.strip()))
    return {"summary": feedback.log_summary(mine), "items": _page(log_view(mine), [F.asc("create_time"), F.asc("id")], page, size)}


def task_report(task: DataFrame, files: DataFrame, author: str = "", page: int = 1, size: int = 100) -> dict[str, DataFrame | Page]:
    """A task's report (task: its one row; files: its files, or a snapshot's): metrics and progress over all files, critical issues of the author's, a page of the author's files by name."""
    id_, kind = task.select(F.col("id").alias("task_id"), "task_type"), task.select("id", "task_type", F.greatest(F.size("task_model_rounds"), F.lit(0)).alias("task_round_num"))
    mine = files.join(id_, "task_id")
    shown = summaries.by_author(mine, author)
    return {
        "metrics": summaries.task_metrics(files, kind),
        "progress": report.progress_of(task, files),
        "authors": summaries.authors(files),
        "critical": report.critical_issues(issue_view(issues_of(shown.withColumn("id", F.col("file_name")) if "id" not in shown.columns else shown))),
        "files": _page(summaries.file_rows(shown, F.col("task_type")), [F.asc("file_name")], page, size),
    }


def comparison_report(tasks: DataFrame, files: DataFrame, project: str, comparison: str, author: str = "", page: int = 1, size: int = 100) -> dict[str, DataFrame | Page]:
    """The report of a comparison's newest task."""
    task = control.latest_comparison(tasks, project, comparison)
    return task_report(task, files.join(task.select(F.col("id").alias("task_id")), "task_id", "left_semi"), author, page, size)


def snapshot_of(snapshots: DataFrame, task_id: str = "", revision: int | None = None, snapshot_id: str = "", project: str = "", comparison: str = "") -> DataFrame:
    """The snapshot of a task's revision, or that of an id within a comparison, at most one row."""
    if not snapshot_id:
        return snapshots.where((F.col("task_id") == task_id) & (F.col("trigger_revision") == revision)).limit(1)
    review, _, base = comparison.rpartition("_vs_")
    if not review:
        raise RequestError("no such comparison", 404)
    return snapshots.where((F.col("snapshot_id") == snapshot_id) & (F.col("project_id") == project) & (F.col("review_version") == review) & (F.col("copy_from_version") == base)).limit(1)


def snapshot_report(snapshots: DataFrame, snapshot_files: DataFrame, author: str = "", page: int = 1, size: int = 100, **which) -> dict[str, DataFrame | Page]:
    """The report over a snapshot's own rows, which later runs don't change."""
    found = snapshot_of(snapshots, **which)
    files = snapshot_files.join(found.select("snapshot_id"), "snapshot_id", "left_semi")
    return task_report(found.withColumn("id", F.col("task_id")), files, author, page, size)


def listed(df: DataFrame, order: list[Column], limit: int = 100, offset: int = 0) -> tuple[DataFrame, int]:
    """Rows from an offset on, 200 at most, and how many there are in all."""
    return df.orderBy(*order).offset(max(0, offset)).limit(max(1, min(limit, 200))), df.count()
