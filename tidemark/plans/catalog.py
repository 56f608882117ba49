"""Every query over the driver's tables, with its SQL counterpart."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import numeric, status, text
from tidemark.functions.status import reportable
from tidemark.operators import code, control, diffs, feedback, issues, report, rollup
from tidemark.plans.proxy import nested_files, role, sql, table
from tidemark.sources import trees, views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

START, END = dt.date(1996, 1, 1), dt.date(1998, 6, 30)
LOG_START, LOG_END = dt.date(2024, 1, 5), dt.date(2024, 1, 24)
IN_RANGE = "create_time >= TIMESTAMP '1996-01-01' AND create_time < TIMESTAMP '1998-07-01'"
LOG_RANGE = "create_time >= TIMESTAMP '2024-01-05' AND create_time < TIMESTAMP '2024-01-25'"
SHOWN = "lower(coalesce(filter_status, '')) <> 'filtered'"


def rate(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN round_even({a} * 100.0::DOUBLE / {b}, 1) ELSE 0.0::DOUBLE END"


def query(body: str | None = None, *roles: str):
    def add(f):
        QUERIES[f.__name__] = f
        if body:
            ORACLE_SQL[f.__name__] = sql(body, *roles)
        return f

    return add


def tasks_in_range(spark, d):
    return role(spark, d, "task").where(views.within(F.col("create_time"), START, END))


def log_in_range(spark, d):
    return role(spark, d, "log").where(views.within(F.col("create_time"), LOG_START, LOG_END))


# --- dashboard

TASK_FIGURES = """count(*) AS task_count, count(DISTINCT project_id) AS project_count, coalesce(sum(llm_prompt_tokens), 0)::BIGINT AS prompt_tokens, coalesce(sum(llm_completion_tokens), 0)::BIGINT AS completion_tokens,
 coalesce(sum(CASE WHEN coalesce(llm_total_tokens, 0) = 0 THEN llm_prompt_tokens + llm_completion_tokens ELSE llm_total_tokens END), 0)::BIGINT AS total_tokens, coalesce(sum(llm_elapsed_ms), 0)::BIGINT AS elapsed_ms"""


@query(
    f"""WITH mine AS (SELECT * FROM task WHERE {IN_RANGE}), a AS (SELECT {TASK_FIGURES} FROM mine),
 b AS (SELECT count(*) FILTER ({SHOWN}) AS valid_count, count(*) FILTER (NOT ({SHOWN})) AS filtered_count, count(*) FILTER ({SHOWN} AND severity = 5) AS severe_count,
 count(*) FILTER ({SHOWN} AND feedback_type IN ('agree', 'reject')) AS feedback_count, count(*) FILTER ({SHOWN} AND feedback_type = 'agree') AS agree_count FROM issue WHERE task_id IN (SELECT id FROM mine)),
 c AS (SELECT count(*) AS past_count, count(*) FILTER (feedback_type = 'agree') AS past_agree_count FROM log WHERE {LOG_RANGE})
 SELECT *, {rate('agree_count', 'feedback_count')} AS agree_rate, {rate('past_agree_count', 'past_count')} AS past_agree_rate FROM a, b, c""",
    "task", "issue", "log",
)
def dashboard(spark, d):
    return feedback.dashboard(tasks_in_range(spark, d), role(spark, d, "issue"), log_in_range(spark, d))


@query(f"SELECT {TASK_FIGURES} FROM task WHERE {IN_RANGE}", "task")
def dashboard_tasks(spark, d):
    return feedback.dashboard_tasks(tasks_in_range(spark, d))


@query(f"SELECT task_type, count(*) AS n FROM task WHERE {IN_RANGE} GROUP BY task_type", "task")
def dashboard_by_type(spark, d):
    return feedback.tasks_by_type(tasks_in_range(spark, d))


BLOCKS = """WITH b AS (SELECT task_id, block_id, block_id % 3 <> 0 AS done, block_id % 13 = 0 AS failed, block_id % 4 AS bstate, task_id::INT % 4 AS state, CASE WHEN task_id::INT % 17 = 0 THEN 'reviewed' WHEN task_id::INT % 19 = 0 THEN 'skipped_budget' ELSE '' END AS status
 FROM issue GROUP BY task_id, block_id),"""
FAILED, DONE = "(failed OR bstate = 3)", "(done OR bstate = 2)"
FILE_DONE = "(state = 2 OR status IN ('reviewed', 'resumed'))"
IN_DASHBOARD = f"CASE WHEN {FAILED} THEN 'failed' WHEN {DONE} OR {FILE_DONE} THEN 'completed' WHEN bstate = 1 OR state = 1 THEN 'reviewing' ELSE 'pending' END"
IN_REPORT = f"CASE WHEN {FAILED} THEN 'failed' WHEN {DONE} OR {FILE_DONE} THEN 'completed' WHEN bstate = 1 THEN 'reviewing' ELSE 'pending' END"
IN_SNAPSHOT = f"CASE WHEN {FAILED} THEN 'failed' WHEN {DONE} THEN 'completed' WHEN bstate = 1 THEN 'reviewing' ELSE 'pending' END"
IN_RETRY = f"CASE WHEN {FAILED} THEN 'failed' WHEN {DONE} OR status IN ('reviewed', 'resumed') THEN 'skip' WHEN bstate = 1 THEN 'running' ELSE 'pending' END"
FILE_STATUS = """CASE WHEN status = 'skipped_budget' THEN 'failed' WHEN bool_and(s = 'completed') THEN 'completed' WHEN state = 1 OR bool_or(s = 'reviewing') THEN 'reviewing' WHEN state = 3 OR bool_or(s = 'failed') OR status = 'partial' THEN 'failed' ELSE 'pending' END"""


@query(
    f"""{BLOCKS} s AS (SELECT *, {IN_DASHBOARD} AS s FROM b), f AS (SELECT task_id, {FILE_STATUS} AS file FROM s GROUP BY task_id, status, state),
 i AS (SELECT count(*) FILTER ({SHOWN}) AS valid_count, count(*) FILTER (NOT ({SHOWN})) AS filtered_count, count(*) FILTER ({SHOWN} AND severity = 5) AS severe_count, count(*) FILTER ({SHOWN} AND feedback_type IN ('agree', 'reject')) AS feedback_count, count(*) FILTER ({SHOWN} AND feedback_type = 'agree') AS agree_count FROM issue)
 SELECT *, {rate('agree_count', 'feedback_count')} AS agree_rate FROM (SELECT count(*) AS file_count, count(*) FILTER (file = 'completed') AS reviewed_count FROM f), i""",
    "issue",
)
def dashboard_files(spark, d):
    files = nested_files(spark, d)
    blocks = F.transform("code_blocks", lambda b: b.withField("tool_calls", F.array()).withField("model_rounds", F.array()))
    statuses = F.transform("code_blocks", lambda b: status.block_in_dashboard(b, F.col("state"), F.col("status")))
    files = files.withColumns({"code_blocks": blocks, "s": statuses})
    return feedback.dashboard_files(files, status.file_in_report(F.col("s"), F.col("state"), F.col("status"))).drop("tool_call_count", "block_round_count")


# --- feedback reports

COUNTERS = """count(*) AS issue_count, count(*) FILTER (feedback_type IN ('agree', 'reject')) AS feedback_count, count(*) FILTER (severity = 5) AS severe_count, count(*) FILTER (severity = 5 AND feedback_type IN ('agree', 'reject')) AS severe_feedback_count,
 count(*) FILTER (severity = 5 AND feedback_type = 'agree') AS severe_agree_count, count(*) FILTER (severity = 5 AND feedback_type = 'reject') AS severe_reject_count"""
RATES = f"{rate('feedback_count', 'issue_count')} AS feedback_rate, {rate('severe_feedback_count', 'severe_count')} AS severe_feedback_rate, {rate('severe_agree_count', 'severe_feedback_count')} AS severe_agree_rate"


def view_of(spark, d, task_type):
    return role(spark, d, "issue").join(role(spark, d, "task").where(F.col("task_type") == task_type).select(F.col("id").alias("task_id"), "project_id", "review_version"), "task_id")


VIEW = "WITH v AS (SELECT i.*, project_id, review_version FROM issue i JOIN task t ON t.id = i.task_id WHERE task_type = 2)"


@query(f"{VIEW} SELECT *, {RATES} FROM (SELECT {COUNTERS} FROM v WHERE {SHOWN}), (SELECT count(DISTINCT project_id) AS projects, count(DISTINCT (project_id, review_version)) AS versions, count(DISTINCT trim(file_author)) AS authors FROM v)", "task", "issue")
def feedback_summary(spark, d):
    v, one = view_of(spark, d, 2), F.lit(1).alias("one")
    sets = v.agg(F.count_distinct("project_id").alias("projects"), F.count_distinct(F.struct("project_id", "review_version")).alias("versions"), F.count_distinct(text.strip(F.col("file_author"))).alias("authors"))
    return feedback.counted(v).select("*", one).join(sets.select("*", one), "one").drop("one")


@query(f"{VIEW} SELECT *, {RATES} FROM (SELECT task_id, {COUNTERS} FROM v WHERE {SHOWN} GROUP BY task_id)", "task", "issue")
def feedback_by_task(spark, d):
    return feedback.counted(view_of(spark, d, 2), "task_id")


@query(f"{VIEW}, a AS (SELECT DISTINCT trim(file_author) AS author FROM v), n AS (SELECT *, {RATES} FROM (SELECT trim(file_author) AS author, {COUNTERS} FROM v WHERE {SHOWN} GROUP BY 1)) SELECT author, " + ", ".join(f"coalesce({c}, 0) AS {c}" for c in ("issue_count", "feedback_count", "severe_count", "severe_feedback_count", "severe_agree_count", "severe_reject_count", "feedback_rate", "severe_feedback_rate", "severe_agree_rate")) + " FROM a LEFT JOIN n USING (author)", "task", "issue")
def feedback_by_author(spark, d):
    v = view_of(spark, d, 2)
    return feedback.by_author(v, v)


@query(f"{VIEW} SELECT s::INT AS severity, count(v.severity) AS n FROM range(1, 6) r(s) LEFT JOIN (SELECT severity FROM v WHERE {SHOWN}) v ON v.severity = s GROUP BY s", "task", "issue")
def severity_histogram(spark, d):
    return feedback.severity_histogram(view_of(spark, d, 2))


@query(f"SELECT task_id, file_name, severity, feedback_type, line_no FROM issue WHERE file_author = 's7' AND {SHOWN}", "issue")
def author_issue_detail(spark, d):
    i = role(spark, d, "issue").where(views.author_is(F.col("file_author"), "s7") & reportable(F.col("filter_status")))
    return i.select("task_id", "file_name", "severity", "feedback_type", "line_no").orderBy(F.desc("severity"), "file_name", "line_no")


@query(f"WITH a AS (SELECT *, {RATES} FROM (SELECT {COUNTERS} FROM issue WHERE trim(file_author) = '' AND {SHOWN})) SELECT a.*, (SELECT count(DISTINCT file_name) FROM issue WHERE trim(file_author) = '') AS file_count FROM a", "issue")
def blank_author_summary(spark, d):
    i, one = role(spark, d, "issue").where(views.author_is(F.col("file_author"), "__empty__")), F.lit(1).alias("one")
    return feedback.counted(i).select("*", one).join(i.agg(F.count_distinct("file_name").alias("file_count")).select("*", one), "one").drop("one")


# --- feedback log

LOG_COUNTERS = "count(*) AS feedback_count, count(*) FILTER (feedback_type = 'agree') AS agree_count, count(*) FILTER (severity = 5) AS severe_count, count(*) FILTER (severity = 5 AND feedback_type = 'agree') AS severe_agree_count"
LOG_RATES = f"{rate('agree_count', 'feedback_count')} AS agree_rate, {rate('severe_agree_count', 'severe_count')} AS severe_agree_rate"


@query(f"SELECT *, {LOG_RATES} FROM (SELECT {LOG_COUNTERS} FROM log WHERE {LOG_RANGE})", "log")
def log_summary(spark, d):
    return feedback.log_summary(log_in_range(spark, d))


@query(f"SELECT *, {LOG_RATES} FROM (SELECT project_id, review_version, copy_from_version, {LOG_COUNTERS}, min(create_time) AS first_seen FROM log WHERE {LOG_RANGE} GROUP BY ALL)", "log")
def log_by_version(spark, d):
    return feedback.log_summary(log_in_range(spark, d), "project_id", "review_version", "copy_from_version")


@query(f"SELECT *, {LOG_RATES} FROM (SELECT trim(file_author) AS author, {LOG_COUNTERS}, min(create_time) AS first_seen FROM log WHERE {LOG_RANGE} GROUP BY 1)", "log")
def log_by_author(spark, d):
    return feedback.log_summary(log_in_range(spark, d).withColumn("author", text.strip(F.col("file_author"))), "author")


@query(f"SELECT id, project_id, file_author, feedback_type, create_time FROM log WHERE {LOG_RANGE} ORDER BY create_time, id::BIGINT LIMIT 50 OFFSET 100", "log")
def log_page(spark, d):
    df = log_in_range(spark, d).select("id", "project_id", "file_author", "feedback_type", "create_time")
    return views.page_of(df, [F.col("create_time"), F.col("id").cast("long")], 3, 50)[0]


@query("SELECT project_id, file_author, max_by(feedback_type, (create_time, id)) AS feedback_type, max(create_time) AS create_time FROM log GROUP BY ALL", "log")
def log_latest_feedback(spark, d):
    return feedback.latest_feedback(role(spark, d, "log"), "project_id", "file_author")


# --- admin list

STATS = f"SELECT task_id, count(*) AS issue_count, max(severity) AS highest_severity, count(*) FILTER (severity = 5) AS critical_issue_count FROM issue WHERE {SHOWN} GROUP BY task_id"


@query(STATS, "issue")
def admin_issue_stats(spark, d):
    return feedback.issue_stats(role(spark, d, "issue"))


def _admin(spark, d):
    t = role(spark, d, "task").withColumn("severity_counts", F.when(F.col("id").cast("int") % 3 == 0, F.create_map(F.lit("5"), F.col("score").cast("long") - 50, F.lit("2"), F.lit(1).cast("long"))))
    return feedback.admin_list(t, role(spark, d, "issue")).drop("severity_counts")


ADMIN = f"""WITH n AS ({STATS}), s AS (SELECT id AS task_id, (greatest(score - 50, 0) + 1)::BIGINT AS issue_count, CASE WHEN score > 50 THEN 5 ELSE 2 END AS highest_severity, greatest(score - 50, 0)::BIGINT AS critical_issue_count FROM task WHERE state IN (2, 3) AND id::INT % 3 = 0),
 every AS (SELECT * FROM s UNION ALL SELECT * FROM n WHERE task_id NOT IN (SELECT task_id FROM s)), a AS (SELECT task.*, coalesce(issue_count, 0) AS issue_count, highest_severity, coalesce(critical_issue_count, 0) AS critical_issue_count FROM task LEFT JOIN every ON task.id = every.task_id)"""
LISTED = "id, project_id, state, score, issue_count, highest_severity, critical_issue_count"


@query(f"{ADMIN} SELECT {LISTED} FROM a", "task", "issue")
def admin_list(spark, d):
    return _admin(spark, d).select(*LISTED.split(", "))


@query(f"{ADMIN} SELECT {LISTED} FROM a WHERE contains(lower(project_id), '7') ORDER BY critical_issue_count DESC, create_time DESC, id LIMIT 100", "task", "issue")
def admin_list_sorted(spark, d):
    df = _admin(spark, d).where(feedback.contains_text(F.col("project_id"), " 7 "))
    return views.page_of(df, feedback.admin_order("critical_issue_count", True), 1, 100)[0].select(*LISTED.split(", "))


# --- task reports


@query(f"{BLOCKS} s AS (SELECT *, {IN_REPORT} AS s FROM b), f AS (SELECT task_id, {FILE_STATUS} AS file, count(*) AS blocks, " + ", ".join(f"count(*) FILTER (s = '{w}') AS {w}_blocks" for w in ("completed", "reviewing", "pending", "failed")) + f" FROM s GROUP BY task_id, status, state) SELECT t.id, f.file, coalesce(blocks, 0)::BIGINT AS blocks, " + ", ".join(f"coalesce({w}_blocks, 0)::BIGINT AS {w}_blocks" for w in ("completed", "reviewing", "pending", "failed")) + ", CASE WHEN blocks > 0 THEN round_even(completed_blocks * 100.0 / blocks, 0)::INT WHEN t.state = 2 THEN 100 ELSE 0 END AS percent, coalesce(round_even(completed_blocks * 100.0 / blocks, 0) < 100 AND failed_blocks > 0 AND pending_blocks + reviewing_blocks = 0 AND t.state = 3, false) AS retry_available FROM task t LEFT JOIN f ON f.task_id = t.id", "task", "issue")
def progress_counts(spark, d):
    files = nested_files(spark, d).withColumn("extra", F.struct("status"))
    p = report.progress_of(role(spark, d, "task").withColumn("retry_failed_only", F.lit(False)), files)
    file = F.when(F.col("completed_files") > 0, "completed").when(F.col("reviewing_files") > 0, "reviewing").when(F.col("pending_files") > 0, "pending").when(F.col("failed_files") > 0, "failed")
    return p.select("id", file.alias("file"), "blocks", "completed_blocks", "reviewing_blocks", "pending_blocks", "failed_blocks", "percent", "retry_available")


@query(f"{BLOCKS} x AS (SELECT {IN_DASHBOARD} AS in_dashboard, {IN_REPORT} AS in_report, {IN_SNAPSHOT} AS in_snapshot, {IN_RETRY} AS in_retry FROM b) SELECT *, count(*) AS n FROM x GROUP BY ALL", "issue")
def block_statuses(spark, d):
    b = nested_files(spark, d).select("state", "status", F.explode("code_blocks").alias("b"))
    s = (F.col("state"), F.col("status"))
    b = b.select(status.block_in_dashboard(F.col("b"), *s).alias("in_dashboard"), status.block_in_report(F.col("b"), *s).alias("in_report"), status.block_in_snapshot(F.col("b")).alias("in_snapshot"), status.block_in_retry(F.col("b"), s[1]).alias("in_retry"))
    return b.groupBy(*b.columns).agg(F.count("*").alias("n"))


@query(f"{BLOCKS} x AS (SELECT task_id, CASE WHEN bool_and(s = 'completed') THEN 'reviewed' WHEN bool_or(s = 'reviewing') THEN 'reviewing' WHEN bool_or(s = 'failed') AND NOT bool_or(s = 'pending') THEN 'partial' ELSE 'pending' END AS file FROM (SELECT *, {IN_SNAPSHOT} AS s FROM b) GROUP BY task_id) SELECT task_id, file, CASE file WHEN 'reviewed' THEN 2 WHEN 'reviewing' THEN 1 WHEN 'partial' THEN 3 ELSE 0 END AS file_state FROM x", "issue")
def snapshot_files(spark, d):
    f = nested_files(spark, d).select("task_id", status.file_in_snapshot(F.transform("code_blocks", status.block_in_snapshot)).alias("file"))
    return f.withColumn("file_state", status.file_state(F.col("file")))


WEIGHED = "WITH b AS (SELECT l_orderkey::VARCHAR AS task_id, (l_quantity * 3 - 20)::INT AS logic_score, l_linenumber::INT AS weight, l_returnflag = 'A' AS completed FROM lineitem)"


def _weighed(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("task_id"), (F.col("l_quantity") * 3 - 20).cast("int").alias("logic_score"), F.col("l_linenumber").cast("int").alias("weight"), (F.col("l_returnflag") == "A").alias("completed"))


@query(f"{WEIGHED} SELECT task_id, round_even(sum(greatest(0, least(100, logic_score)) * weight)::DOUBLE / sum(weight), 0)::INT AS logic_score FROM b GROUP BY task_id")
def weighted_scores(spark, d):
    return report.weighted_scores(_weighed(spark, d), "task_id")


@query(f"{WEIGHED} SELECT task_id, floor(sum(logic_score * weight)::DOUBLE / sum(weight))::INT AS logic_score FROM b GROUP BY task_id")
def finished_scores(spark, d):
    return report.weighted_scores(_weighed(spark, d), "task_id", how="floor", clamped=False)


@query(f"{WEIGHED} SELECT task_id, round_even(avg(logic_score), 0)::INT AS logic_score FROM b WHERE completed GROUP BY task_id")
def synchronised_scores(spark, d):
    return report.average_completed(_weighed(spark, d), "task_id")


@query(f"SELECT task_id, file_name, block_id, line_no FROM issue WHERE {SHOWN} AND severity = 5", "issue")
def critical_issues(spark, d):
    i = role(spark, d, "issue").withColumn("issue_id", F.col("line_no"))
    return report.critical_issues(i).select("task_id", "file_name", "block_id", "line_no")


@query(f"SELECT file_name, count(*) AS issue_count FROM issue WHERE {SHOWN} GROUP BY file_name ORDER BY issue_count DESC, file_name LIMIT 10", "issue")
def top_files(spark, d):
    return report.top_files(role(spark, d, "issue"))


@query("WITH n AS (SELECT project_id, event_type AS k, count(*) AS n FROM (SELECT concat('p', CAST(user_id % 20 AS STRING)) AS project_id, event_type FROM events) GROUP BY ALL) SELECT project_id, string_agg(k || '=' || n, ', ' ORDER BY k) AS counts FROM n GROUP BY project_id")
def tool_histogram(spark, d):
    e = table(spark, d, "events").select(F.concat(F.lit("p"), (F.col("user_id") % 20).cast("string")).alias("project_id"), "event_type")
    return report.histogram(e, "project_id", "event_type").select("project_id", text.counts_text(F.col("counts")).alias("counts"))


@query("WITH n AS (SELECT user_id % 20 AS p, user_id % 2 AS half, event_type AS k, count(*) AS n FROM events GROUP BY ALL), m AS (SELECT p - p % 2 AS p, k, sum(n) AS n FROM n GROUP BY ALL) SELECT p, string_agg(k || '=' || n, ', ' ORDER BY k) AS counts FROM m GROUP BY p")
def merged_usage(spark, d):
    e = table(spark, d, "events").select((F.col("user_id") % 20).alias("q"), "event_type")
    h = report.histogram(e, "q", "event_type")
    a, b = h.where("q % 2 = 0").select(F.col("q").alias("p"), F.col("counts").alias("x")), h.where("q % 2 = 1").select((F.col("q") - 1).alias("p"), F.col("counts").alias("y"))
    none = F.create_map().cast("map<string,bigint>")
    return a.join(b, "p", "full_outer").select("p", text.counts_text(report.merged_counts(F.coalesce("x", none), F.coalesce("y", none))).alias("counts"))


@query(f"SELECT trim(file_author) AS owner, count(*) FILTER (severity = 5) AS severe, count(*) FILTER (severity <> 5) AS other FROM issue WHERE {SHOWN} GROUP BY 1", "issue")
def owner_counts(spark, d):
    return report.owners(role(spark, d, "issue"))


@query("WITH c AS (SELECT conv_id, turn, text, CASE WHEN role = 'assistant' AND turn % 4 = 3 THEN 'tool' ELSE role END AS role FROM conversations) SELECT conv_id, " + ", ".join(f"count(*) FILTER (role = '{r}') AS {r}_count" for r in ("system", "user", "assistant", "tool")) + ", max_by(text, turn) FILTER (role = 'user') AS last_user, max_by(text, turn) FILTER (role = 'tool') AS last_tool FROM c GROUP BY conv_id")
def message_summary(spark, d):
    """Some of the assistant's turns are taken for a tool's."""
    c = table(spark, d, "conversations")
    return report.last_messages(c.withColumn("role", F.when((F.col("role") == "assistant") & (F.col("turn") % 4 == 3), "tool").otherwise(F.col("role"))))


# --- trees, diffs, blocks


def halves(spark, d):
    t = role(spark, d, "tree").groupBy("path").agg(F.min_by("md5", "doc_id").alias("md5_0"), F.max_by("md5", "doc_id").alias("md5_1"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
    old = t.where("lo % 5 <> 0").select(F.when(F.col("lo") % 7 == 0, F.concat(F.lit("old/"), "path")).otherwise(F.col("path")).alias("path"), F.col("md5_0").alias("md5"))
    return old, t.where("lo % 6 <> 0").select("path", F.col("md5_1").alias("md5"))


HALVES = """WITH t AS (SELECT path, min_by(md5, doc_id) AS md5_0, max_by(md5, doc_id) AS md5_1, min(doc_id) AS lo, max(doc_id) AS hi FROM tree GROUP BY path),
 o AS (SELECT CASE WHEN lo % 7 = 0 THEN 'old/' || path ELSE path END AS path, md5_0 AS md5 FROM t WHERE lo % 5 <> 0), h AS (SELECT path, md5_1 AS md5 FROM t WHERE lo % 6 <> 0),
 gone AS (SELECT *, count(*) OVER (PARTITION BY md5) AS n FROM o WHERE path NOT IN (SELECT path FROM h)), came AS (SELECT *, count(*) OVER (PARTITION BY md5) AS n FROM h WHERE path NOT IN (SELECT path FROM o)),
 moved AS (SELECT g.path AS old_path, c.path FROM gone g JOIN came c USING (md5) WHERE g.n = 1 AND c.n = 1)"""


@query(HALVES + " SELECT path, path AS old_path, 'MODIFIED' AS change_type FROM o JOIN h USING (path) WHERE o.md5 <> h.md5 UNION ALL SELECT path, NULL, 'ADDED' FROM came WHERE path NOT IN (SELECT path FROM moved) UNION ALL SELECT path, path, 'DELETED' FROM gone WHERE path NOT IN (SELECT old_path FROM moved) UNION ALL SELECT path, old_path, 'RENAMED' FROM moved", "tree")
def tree_compare(spark, d):
    return diffs.compared(*halves(spark, d))


@query(HALVES + " SELECT old_path, path FROM moved", "tree")
def rename_pairs(spark, d):
    return diffs.compared(*halves(spark, d)).where("change_type = 'RENAMED'").select("old_path", "path")


@query(HALVES + " SELECT path FROM gone", "tree")
def removed_files(spark, d):
    old, new = halves(spark, d)
    return diffs.removed_files(old.select("path"), new)


@query(HALVES + " SELECT coalesce(o.path, h.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN h.path IS NULL THEN 'removed' WHEN o.md5 = h.md5 THEN 'reused' ELSE 'changed' END AS kind FROM o FULL JOIN h ON o.path = h.path", "tree")
def synchronised_files(spark, d):
    old, new = halves(spark, d)
    return diffs.classified(new.withColumnRenamed("md5", "source_hash"), old.withColumnRenamed("md5", "source_hash"))


def _lines_of(spark, d):
    return role(spark, d, "tree").select("doc_id", "path", F.posexplode(F.split("text", "\n")).alias("pos", "code"))


LINES = "lines AS (SELECT doc_id, path, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS code FROM (SELECT doc_id, path, string_split(text, chr(10)) AS l FROM tree))"


@query(f"WITH {LINES} SELECT doc_id, sum(greatest(1, length(code) // 4))::BIGINT AS tokens, count(*) AS n FROM lines GROUP BY doc_id", "tree")
def token_estimate(spark, d):
    n = F.split("text", "\n")
    return role(spark, d, "tree").select("doc_id", F.aggregate(n, F.lit(0).cast("long"), lambda a, x: a + text.line_tokens(x)).alias("tokens"), F.size(n).cast("long").alias("n"))


@query(f"WITH {LINES} SELECT md5(string_agg(lpad((pos + 1)::VARCHAR, greatest(6, length((pos + 1)::VARCHAR))::INT, ' ') || '+  ' || code, chr(10) ORDER BY pos)) AS digest, doc_id, count(*) AS n FROM lines GROUP BY doc_id", "tree")
def full_scan(spark, d):
    lines = F.transform(F.split("text", "\n"), lambda x, i: text.diff_line(i + 1, F.lit("+"), x))
    return role(spark, d, "tree").select("doc_id", diffs.block_hash(lines).alias("digest"), F.size(lines).cast("long").alias("n"))


@query("WITH x AS (SELECT doc_id, path, CASE WHEN regexp_extract(path, '\\.([a-z]+)$', 1) = 'c' THEN 'C' WHEN regexp_extract(path, '\\.([a-z]+)$', 1) = 'py' THEN 'Python' ELSE 'General' END AS language, regexp_extract(path, '\\.([a-z]+)$', 1) IN ('c', 'py') AS allowed, contains(path, 'src1') OR list_contains(string_split(path, '/'), 'de') AS excluded FROM tree) SELECT language, allowed, excluded, count(*) AS n FROM x GROUP BY ALL", "tree")
def scan_filters(spark, d):
    t, skip = role(spark, d, "tree"), trees.Exclusions(("de",), ("*SRC1*",))
    p = F.col("path")
    return t.select(trees.language(p).alias("language"), trees.allowed(p).alias("allowed"), skip.column(p).alias("excluded")).groupBy("language", "allowed", "excluded").agg(F.count("*").alias("n"))


@query(
    f"""WITH RECURSIVE {LINES}, c AS (SELECT doc_id, pos, greatest(1, length(code) // 4) AS t FROM lines),
 fold AS (SELECT doc_id, pos, t AS used, 0 AS block FROM c WHERE pos = 0 UNION ALL SELECT c.doc_id, c.pos, CASE WHEN f.used + c.t > 300 THEN c.t ELSE f.used + c.t END, CASE WHEN f.used + c.t > 300 THEN f.block + 1 ELSE f.block END FROM fold f JOIN c ON c.doc_id = f.doc_id AND c.pos = f.pos + 1)
 SELECT doc_id, block, count(*) AS n FROM fold GROUP BY ALL""".replace("WITH RECURSIVE ", "WITH "),
    "tree",
)
def block_split(spark, d):
    b = role(spark, d, "tree").select("doc_id", F.posexplode(diffs.split_blocks(F.split("text", "\n"), 300)).alias("block", "lines"))
    return b.select("doc_id", "block", F.size("lines").cast("long").alias("n"))


ORACLE_SQL["block_split"] = ORACLE_SQL["block_split"].replace("WITH ", "WITH RECURSIVE ", 1)


@query(
    """WITH RECURSIVE c AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents),
 fold AS (SELECT source, doc_id, k, n_chars <= 40000 AS ok, CASE WHEN n_chars <= 40000 THEN n_chars ELSE 0 END AS used FROM c WHERE k = 1
 UNION ALL SELECT c.source, c.doc_id, c.k, f.used + c.n_chars <= 40000, CASE WHEN f.used + c.n_chars <= 40000 THEN f.used + c.n_chars ELSE f.used END FROM fold f JOIN c ON c.source = f.source AND c.k = f.k + 1)
 SELECT source, doc_id, ok FROM fold"""
)
def budget_admission(spark, d):
    return diffs.admitted(table(spark, d, "documents").select("source", "doc_id", "n_chars"), "source", ["doc_id"], "n_chars", 40_000).drop("n_chars")


@query("SELECT path, doc_id, lang, ((row_number() OVER (PARTITION BY lang ORDER BY path, doc_id) - 1) // 20)::BIGINT AS batch FROM tree JOIN (SELECT doc_id, lang FROM documents) USING (doc_id)", "tree")
def batch_assignment(spark, d):
    t = role(spark, d, "tree").select("path", "doc_id").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return diffs.batches(t, "lang", ["path", "doc_id"]).select("path", "doc_id", "lang", "batch")


def _hashed(spark, d):
    b = _lines_of(spark, d).where("code <> ''").select(F.col("doc_id").cast("string").alias("doc"), F.element_at(F.split("path", "/"), 1).alias("path"), F.substring(F.md5(F.col("code").cast("binary")), 1, 2).alias("block_hash"), (F.col("doc_id") * 10000 + F.col("pos")).alias("block_id"), (F.col("pos") % 2 == 0).alias("completed"))
    return b.where("block_id % 3 <> 0").select("path", "block_hash", "block_id"), b.where("block_id % 3 <> 1").select("path", "block_hash", "block_id", "completed")


HASHED = f"WITH {LINES}, b AS (SELECT string_split(path, '/')[1] AS path, substr(md5(code), 1, 2) AS block_hash, doc_id * 10000 + pos AS block_id, pos % 2 = 0 AS completed FROM lines WHERE code <> ''), n AS (SELECT *, row_number() OVER (PARTITION BY path, block_hash ORDER BY block_id) AS k FROM b WHERE block_id % 3 <> 0), o AS (SELECT *, row_number() OVER (PARTITION BY path, block_hash ORDER BY completed DESC, block_id) AS k FROM b WHERE block_id % 3 <> 1)"


@query(f"{HASHED} SELECT n.path, n.block_hash, n.block_id, o.block_id AS old_block_id, o.completed AS reused FROM n LEFT JOIN o USING (path, block_hash, k)", "tree")
def block_reuse(spark, d):
    return diffs.matched_blocks(*_hashed(spark, d))


@query(f"{HASHED}, had AS (SELECT path, block_hash, count(*) AS had FROM o GROUP BY ALL) SELECT path, block_hash, block_id FROM n LEFT JOIN had USING (path, block_hash) WHERE k > coalesce(had, 0)", "tree")
def block_multiset_diff(spark, d):
    return diffs.added_blocks(*_hashed(spark, d))


@query(f"{HASHED}, a AS (SELECT path, block_hash, block_id, block_id AS found_id FROM n WHERE (path, block_hash, block_id) IN (SELECT path, block_hash, block_id FROM o)), r AS (SELECT *, row_number() OVER (PARTITION BY path, block_hash ORDER BY block_id) AS j FROM n WHERE block_id NOT IN (SELECT block_id FROM a)), l AS (SELECT *, row_number() OVER (PARTITION BY path, block_hash ORDER BY block_id) AS j FROM o WHERE block_id NOT IN (SELECT block_id FROM a)) SELECT * FROM a UNION ALL SELECT r.path, r.block_hash, r.block_id, l.block_id FROM r JOIN l USING (path, block_hash, j)", "tree")
def block_rematch(spark, d):
    new, old = _hashed(spark, d)
    return diffs.rematched_refs(new, old.select("path", "block_hash", "block_id"))


@query("SELECT id, copy_from_version = '0_version' AND task_type <> 3 AS changed, CASE WHEN copy_from_version = '0_version' THEN 3 ELSE task_type END AS task_type FROM task", "task")
def legacy_migration(spark, d):
    return diffs.migrated_types(role(spark, d, "task")).select("id", "changed", "task_type")


# --- issues

HITS = " OR ".join(f"contains(lower(code), '{w}')" for w in ("token", "ing", "ption"))


@query(f"WITH {LINES} SELECT doc_id::VARCHAR AS path, pos::BIGINT AS line_no, rule_id, trim(code) AS existing_code FROM lines JOIN (VALUES ('any', 'token', 'de%', ''), ('both', 'mail', 'com', '@')) r(rule_id, w1, w2, w3) ON (rule_id = 'any' AND (contains(lower(code), 'token') OR contains(lower(code), 'secret'))) OR (rule_id = 'both' AND contains(lower(code), '@') AND contains(lower(code), 'com') AND NOT contains(lower(code), 'org'))", "tree")
def line_scan_rules(spark, d):
    lines = _lines_of(spark, d).select(F.col("doc_id").cast("string").alias("path"), F.lit("C").alias("language"), F.col("pos").cast("long").alias("line_no"), "code")
    rules = spark.createDataFrame([("any", "", ["token", "secret"], [], [], "security", 4, 0.7), ("both", "C", [], ["@", "com"], ["org"], "logic", 3, 0.8)], issues.rule_table(spark).schema)
    return issues.detected(lines, rules).select("path", "line_no", "rule_id", "existing_code")


@query(f"WITH {LINES} SELECT doc_id, CASE WHEN contains(j, 'password') OR contains(j, 'secret') OR contains(j, 'eval(') OR contains(j, 'exec(') OR contains(j, 'api_key') THEN 60 ELSE 90 END AS security_score, CASE WHEN contains(j, 'todo') OR contains(j, 'fixme') THEN 75 ELSE 90 END AS readable_score FROM (SELECT doc_id, lower(text) AS j FROM tree)", "tree")
def plan_scores(spark, d):
    s = issues.plan_scores(F.col("text"))
    return role(spark, d, "tree").select("doc_id", s["security_score"].alias("security_score"), s["readable_score"].alias("readable_score"))


@query("SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(regexp_replace(d.text, '\\s+', '', 'g'), regexp_replace(b.text, '\\s+', '', 'g'))")
def evidence_exact(spark, d):
    """Benchmark texts as fragments: a word window of the fragment is the key, so only texts that share it are compared."""
    words = lambda c: F.regexp_extract_all(c, F.lit(r"(\S+)"), F.lit(1))
    bare = lambda c: F.regexp_replace(c, r"\s+", "")
    b = table(spark, d, "benchmark").select("item_id", bare(F.col("text")).alias("wanted"), F.array_join(F.slice(words(F.col("text")), 2, 4), "").alias("key"))
    t = table(spark, d, "documents").select("doc_id", bare(F.col("text")).alias("hay"), words(F.col("text")).alias("w"))
    windows = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - 3, F.lit(1))), lambda i: F.array_join(F.slice("w", i, 4), "")))
    keys = t.select("doc_id", F.explode(windows).alias("key")).join(b.select("item_id", "key"), "key").select("doc_id", "item_id").distinct()
    return keys.join(b, "item_id").join(t.select("doc_id", "hay"), "doc_id").where(F.contains("hay", F.col("wanted"))).select("item_id", "doc_id")


def _marked(spark, d):
    m = F.when(F.col("l_returnflag") == "A", "+").when(F.col("l_returnflag") == "R", "-").otherwise(" ")
    i = table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("path"), F.col("l_partkey").cast("int").alias("line_no"), "l_linenumber", m.alias("marker"))
    # dealt by file before it is grouped: a task sorts its share of files, not all that it read
    i = i.repartition("path").groupBy("path", "line_no").agg(F.min("marker").alias("marker"))
    return i.withColumn("seq", F.row_number().over(Window.partitionBy("path").orderBy("line_no")))


MARKED = "WITH m AS (SELECT l_orderkey::VARCHAR AS path, l_partkey::INT AS line_no, min(CASE l_returnflag WHEN 'A' THEN '+' WHEN 'R' THEN '-' ELSE ' ' END) AS marker FROM lineitem GROUP BY ALL)"


@query(f"{MARKED}, n AS (SELECT *, last_value(CASE WHEN marker <> '-' THEN line_no END IGNORE NULLS) OVER (PARTITION BY path ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, first_value(CASE WHEN marker <> '-' THEN line_no END IGNORE NULLS) OVER (PARTITION BY path ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM m) SELECT path, line_no AS line FROM n WHERE marker = '+' UNION SELECT path, before FROM n WHERE marker = '-' AND before IS NOT NULL UNION SELECT path, after FROM n WHERE marker = '-' AND after IS NOT NULL")
def reviewable_lines(spark, d):
    return issues.reviewable_lines(_marked(spark, d))


@query(f"{MARKED} SELECT path, line_no, marker, coalesce(max((marker <> ' ')::INT) OVER (PARTITION BY path ORDER BY line_no ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 0) = 1 AS near FROM m")
def context_mask(spark, d):
    near = F.max((F.col("marker") != " ").cast("int")).over(Window.partitionBy("path").orderBy("seq").rowsBetween(-1, 1)) == 1
    return _marked(spark, d).select("path", "line_no", "marker", near.alias("near"))


SPANS = "WITH i AS (SELECT l_orderkey, l_partkey AS part, l_quantity::INT AS a, l_quantity::INT + l_linenumber::INT AS b, l_suppkey AS k FROM lineitem WHERE l_returnflag = 'A'), f AS (SELECT l_partkey AS part, l_quantity::INT AS a, l_quantity::INT + 2 AS b, l_suppkey AS k FROM lineitem WHERE l_returnflag = 'R')"


@query(f"{SPANS} SELECT i.part, i.a, i.b, i.k, f.a AS fa, f.k AS fk FROM i JOIN f ON i.part = f.part AND f.a <= i.b AND f.b >= i.a")
def interval_overlap(spark, d):
    li = table(spark, d, "lineitem")
    q = F.col("l_quantity").cast("int")
    i = li.where("l_returnflag = 'A'").select(F.col("l_partkey").alias("part"), q.alias("a"), (q + F.col("l_linenumber")).cast("int").alias("b"), F.col("l_suppkey").alias("k"))
    f = li.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("part"), q.alias("fa"), (q + 2).alias("fb"), F.col("l_suppkey").alias("fk"))
    return i.join(f, "part").where("fa <= b and fb >= a").drop("fb")


@query("WITH w AS (SELECT p_partkey, p_type, p_size, list_distinct(string_split(lower(p_name) || ' ' || lower(p_brand), ' ')) AS w FROM part) SELECT a.p_partkey AS a, b.p_partkey AS b, len(list_intersect(a.w, b.w))::DOUBLE / len(list_distinct(list_concat(a.w, b.w))) AS similarity FROM w a JOIN w b ON a.p_type = b.p_type AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey WHERE len(list_intersect(a.w, b.w))::DOUBLE / len(list_distinct(list_concat(a.w, b.w))) >= 0.65")
def jaccard_pairs(spark, d):
    words = F.split(F.concat(F.lower("p_name"), F.lit(" "), F.lower("p_brand")), " ")
    return issues.similar_pairs(table(spark, d, "part"), "p_partkey", ["p_type", "p_size"], words, 0.65)


@query("WITH g AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, row_number() OVER (PARTITION BY l_returnflag, l_linenumber, l_quantity ORDER BY l_orderkey, l_partkey, l_suppkey, l_shipdate, l_extendedprice) = 1 AS first, count(*) OVER (PARTITION BY l_returnflag, l_linenumber, l_quantity) AS copies FROM lineitem) SELECT * FROM g WHERE first")
def exact_dedupe_groups(spark, d):
    li = table(spark, d, "lineitem")
    li = li.withColumns({"type": F.col("l_returnflag"), "severity": F.col("l_linenumber").cast("int"), "issue_line_numbers": F.col("l_quantity").cast("int").cast("string"), "description": F.lit(""), "suggestion": F.lit("")})
    g = issues.exact_groups(li, ["l_orderkey", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"])
    return g.where("first").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "first", "copies")


@query(f"SELECT task_id, file_name, line_no, row_number() OVER w - 1 AS number, CASE WHEN {SHOWN} THEN sum(CASE WHEN {SHOWN} THEN 1 ELSE 0 END) OVER w ELSE 0 END::BIGINT AS visible_number FROM (SELECT DISTINCT task_id, file_name, line_no, min(filter_status) AS filter_status FROM issue GROUP BY task_id, file_name, line_no) WINDOW w AS (PARTITION BY task_id ORDER BY file_name, line_no ROWS UNBOUNDED PRECEDING)", "issue")
def issue_numbering(spark, d):
    i = role(spark, d, "issue").groupBy("task_id", "file_name", "line_no").agg(F.min("filter_status").alias("filter_status"))
    n = issues.numbered(i, ["task_id"], ["file_name", "line_no"])
    return n.select("task_id", "file_name", "line_no", F.col("number").cast("long").alias("number"), F.col("visible_number").cast("long").alias("visible_number"))


@query("WITH e AS (SELECT DISTINCT l_partkey AS caller, l_suppkey + 1000000 AS callee FROM lineitem UNION SELECT DISTINCT l_suppkey + 1000000, l_partkey FROM lineitem), s1 AS (SELECT DISTINCT callee AS s FROM e WHERE caller = 7), s2 AS (SELECT DISTINCT callee AS s FROM e WHERE caller IN (SELECT s FROM s1)) SELECT 'f' || caller AS caller, 'f' || callee AS callee FROM e WHERE caller = 7 OR caller IN (SELECT s FROM s1) OR caller IN (SELECT s FROM s2)")
def call_graph_bfs(spark, d):
    li = table(spark, d, "lineitem")
    name = lambda c: F.concat(F.lit("f"), c.cast("string"))
    a = li.select(name(F.col("l_partkey")).alias("caller"), name(F.col("l_suppkey") + 1_000_000).alias("callee"))
    b = li.select(name(F.col("l_suppkey") + 1_000_000).alias("caller"), name(F.col("l_partkey")).alias("callee"))
    return code.call_graph(a.union(b).distinct(), "f7", "outgoing", 3)


@query(f"WITH {LINES} SELECT path, doc_id, (pos + 1)::INT AS line, code FROM lines WHERE contains(lower(code), 'password') OR contains(lower(code), 'token = ') ORDER BY path, doc_id, line LIMIT 500", "tree")
def code_search(spark, d):
    lines = _lines_of(spark, d).withColumn("line", (F.col("pos") + 1).cast("int"))
    return code.code_search(lines, "password|token = ", regex=True, limit=500).select("path", "doc_id", "line", "code")


@query("SELECT DISTINCT path FROM tree WHERE contains(path, 'd17') ORDER BY path LIMIT 100", "tree")
def file_find(spark, d):
    return code.file_find(role(spark, d, "tree").select("path").distinct(), "D17")


# --- control plane

NOW = dt.datetime(1998, 7, 1)


def _queue(spark, d):
    t = role(spark, d, "task")
    later = F.col("create_time") + F.expr("interval 30 days")
    n = F.col("id").cast("long")
    of = lambda k, *values: F.element_at(F.array(*map(F.lit, values)), (n % k + 1).cast("int"))
    return t.withColumns({"lease_token": of(3, "", "w1", None), "lease_expires_at": F.when(n % 7 > 0, later), "next_retry_time": F.when(n % 4 > 0, later), "completion_status": of(4, "partial", "failed", "superseded", None)}), F.lit("1998-07-01 00:00:00").cast("timestamp_ntz")


QUEUE = """WITH x AS (SELECT *, CASE id::BIGINT % 3 WHEN 1 THEN 'w1' ELSE '' END AS token, CASE WHEN id::BIGINT % 7 > 0 THEN create_time + INTERVAL 30 DAY END AS expires, CASE WHEN id::BIGINT % 4 > 0 THEN create_time + INTERVAL 30 DAY END AS due,
 CASE id::BIGINT % 4 WHEN 0 THEN 'partial' WHEN 1 THEN 'failed' WHEN 2 THEN 'superseded' END AS completion FROM task), q AS (SELECT *, token = '' OR expires IS NULL OR expires <= TIMESTAMP '1998-07-01' AS free FROM x)"""
ELIGIBLE = "free AND (state IN (0, 1) OR (state = 3 AND retry_count < 3 AND automatic_retry_pending AND completion IN ('partial', 'failed') AND coalesce(due <= TIMESTAMP '1998-07-01', true)))"


@query(f"{QUEUE} SELECT id, state FROM q WHERE {ELIGIBLE}", "task")
def eligible_tasks(spark, d):
    t, now = _queue(spark, d)
    return t.where(control.eligible(now)).select("id", "state")


@query(f"{QUEUE} SELECT id, state, dispatch_priority FROM q WHERE {ELIGIBLE} ORDER BY dispatch_priority DESC, task_type = 3, create_time, id LIMIT 1", "task")
def next_task(spark, d):
    t, now = _queue(spark, d)
    return control.next_task(t, now).select("id", "state", "dispatch_priority")


@query("SELECT id, dispatch_priority, task_type FROM task r WHERE state = 1 AND (dispatch_priority < (SELECT max(dispatch_priority) FROM task WHERE state = 0) OR (task_type = 3 AND dispatch_priority <= (SELECT max(dispatch_priority) FROM task WHERE state = 0 AND task_type <> 3)))", "task")
def preempted_tasks(spark, d):
    t = role(spark, d, "task")
    return control.preempted(t.where("state = 1"), t.where("state = 0")).select("id", "dispatch_priority", "task_type")


@query("SELECT id, CASE WHEN retry_count < 3 THEN least(900, 30 * pow(2, greatest(0, retry_count - 1)))::INT END AS delay FROM task", "task")
def retry_backoff(spark, d):
    return role(spark, d, "task").select("id", numeric.retry_delay(F.col("retry_count")).alias("delay"))


@query("SELECT id, review_version, create_time FROM task WHERE project_id = '7' AND review_version = 'v3' AND copy_from_version = 'master' ORDER BY create_time DESC, id DESC LIMIT 1", "task")
def latest_comparison(spark, d):
    return control.latest_comparison(role(spark, d, "task"), "7", "v3_vs_master").select("id", "review_version", "create_time")


# --- scalar functions


@query("SELECT c_custkey, greatest(1, least(5, CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 1 WHEN 'AUTOMOBILE' THEN 4 WHEN 'FURNITURE' THEN 5 ELSE (c_custkey % 9)::INT END)) AS severity, trim(regexp_replace(lower(c_name || '  ' || c_mktsegment), '\\s+', ' ', 'g')) AS k, replace(replace(c_name, '#', '%23'), ' ', '%20') AS url, md5(c_name) AS digest FROM customer")
def scalar_functions(spark, d):
    level = F.when(F.col("c_mktsegment") == "BUILDING", "low").when(F.col("c_mktsegment") == "MACHINERY", "High ").when(F.col("c_mktsegment") == "AUTOMOBILE", "HIGH").when(F.col("c_mktsegment") == "FURNITURE", " 7 ").otherwise((F.col("c_custkey") % 9).cast("string"))
    return table(spark, d, "customer").select(
        "c_custkey", numeric.severity(level).alias("severity"), text.text_key(F.concat_ws("  ", "c_name", "c_mktsegment")).alias("k"), text.percent_encoded(F.col("c_name")).alias("url"), F.md5("c_name").alias("digest")
    )


@query("SELECT event_id, (json_extract(props, '$.k'))::INT AS k, list_sort(list_distinct(list_transform(regexp_extract_all(props, '(\\d+)', 1), lambda x: x::INT)))[1] AS first_number FROM events")
def parsed_numbers(spark, d):
    n = F.array_sort(F.array_distinct(text.numbers(F.col("props"))))
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), F.get(n, 0).alias("first_number"))


# --- roll-ups


@query("SELECT id, CASE WHEN state = 1 THEN 100 + greatest(0, date_diff('millisecond', create_time, TIMESTAMP '1998-07-01')) ELSE 100 END::BIGINT AS spent FROM task", "task")
def live_process_time(spark, d):
    now = F.lit("1998-07-01 00:00:00").cast("timestamp_ntz")
    return role(spark, d, "task").select("id", rollup.live_time(F.lit(100), F.col("state"), F.col("create_time"), now).cast("long").alias("spent"))


@query("""SELECT id, sha256('{"copy_from_version": "' || copy_from_version || '", "project_id": "' || project_id || '", "review_version": "' || review_version || '"}') AS submission_key FROM task""", "task")
def submission_keys(spark, d):
    return role(spark, d, "task").select("id", rollup.submission_key(F.col("project_id"), F.col("review_version"), F.col("copy_from_version")).alias("submission_key"))


@query("SELECT id, greatest(llm_prompt_tokens, coalesce(b.n, 0))::BIGINT AS prompt_baseline FROM task LEFT JOIN (SELECT task_id, sum(line_no) * 1000 AS n FROM issue GROUP BY task_id) b ON b.task_id = id", "task", "issue")
def usage_baseline(spark, d):
    b = role(spark, d, "issue").groupBy("task_id").agg((F.sum("line_no") * 1000).alias("n"))
    return role(spark, d, "task").join(b, F.col("id") == F.col("task_id"), "left").select("id", rollup.baseline(F.col("llm_prompt_tokens"), F.col("n")).alias("prompt_baseline"))


@query("SELECT c_custkey, CASE WHEN c_mktsegment NOT IN ('logic', 'BUILDING') THEN 'unsupported type: ' || c_mktsegment WHEN c_custkey % 2 = 0 THEN 'missing required fields: suggestion, evidence' END AS error FROM customer WHERE c_mktsegment <> 'BUILDING' OR c_custkey % 2 = 0 OR true".replace("NOT IN ('logic', 'BUILDING')", "<> 'BUILDING'"))
def comment_validation(spark, d):
    c = table(spark, d, "customer")
    half = F.when(F.col("c_custkey") % 2 == 0, F.lit("  ")).otherwise(F.lit("x"))
    kind = F.when(F.col("c_mktsegment") == "BUILDING", F.lit("security")).otherwise(F.col("c_mktsegment"))
    c = c.withColumns({"type": kind, "severity": F.lit("high"), "description": F.lit("x"), "suggestion": half, "issue_line_numbers": F.lit("1"), "existing_code": F.lit("x"), "evidence": half})
    return rollup.checked_comments(c).select("c_custkey", "error")


@query("WITH x AS (SELECT source AS path, doc_id AS place, text, greatest(0, 12000 - coalesce(sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INT AS room FROM documents) SELECT path, place, least(length(text), room)::INT AS n, room > 0 AND length(text) > room AS cut FROM x")
def related_diff_budget(spark, d):
    t = table(spark, d, "documents").select(F.col("source").alias("path"), F.col("doc_id").alias("place"), F.col("text").alias("diff_text"))
    return rollup.inlined(t).select("path", "place", F.length("excerpt").alias("n"), "cut")


@query("WITH w AS (SELECT conv_id, turn, role, greatest(1, sum(length(coalesce(text, ''))) OVER (PARTITION BY conv_id) // 4)::BIGINT AS tokens, min(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id) AS first, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) SELECT conv_id, turn, tokens, role = 'system' OR coalesce(turn = first, false) OR back <= 2 AS keep, tokens > 600 AS compress FROM w")
def kept_messages(spark, d):
    return rollup.kept_messages(table(spark, d, "conversations"), 2, 1000, 0.6).select("conv_id", "turn", "tokens", "keep", "compress")


@query("WITH k AS (SELECT event_id AS id, event_type || user_id AS k, row_number() OVER w AS n, first_value(event_id) OVER w AS f FROM events WINDOW w AS (PARTITION BY event_type, user_id ORDER BY event_id)), g AS (SELECT k, row_number() OVER (ORDER BY id) AS group_id FROM k WHERE n = 2) SELECT id, group_id::INT AS group_id, CASE WHEN n > 1 THEN f END AS duplicate_of FROM k LEFT JOIN g USING (k)")
def duplicate_groups(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), "event_type", "user_id")
    return rollup.duplicate_groups(e, F.concat("event_type", F.col("user_id").cast("string")), ["id"]).select("id", "group_id", "duplicate_of")


@query("SELECT count(*) = count(DISTINCT id) AND bool_and(known) AS exact FROM (SELECT o_orderkey AS id, true AS known FROM orders)")
def group_cover(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    return rollup.exact_cover(o, o)


@query("WITH g AS (SELECT p_size AS group_id, count(*) AS n, count(DISTINCT lower(p_type)) AS t, count(DISTINCT p_size % 4) AS s, count(DISTINCT p_brand) AS r FROM part GROUP BY p_size) SELECT group_id, n > 1 AND t = 1 AND r = 1 AS safe FROM g")
def semantic_group_safety(spark, d):
    p = table(spark, d, "part")
    p = p.select(F.col("p_size").alias("group_id"), F.col("p_partkey").alias("place"), F.col("p_type").alias("type"), (F.col("p_size") % 4).alias("severity"), F.col("p_brand").alias("rule_id"), F.lit("").alias("existing_code"), F.col("p_name").alias("description"))
    return rollup.safe_groups(p)


@query(
    """WITH p AS (SELECT p_partkey // 3 AS group_id, p_partkey AS place, lower(p_type) AS kind, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE '' END AS rule, CASE WHEN p_partkey % 4 < 2 THEN 'x' ELSE '' END AS code, list_distinct(regexp_extract_all(lower(p_name), '[a-z0-9_]+')) AS w FROM part),
 f AS (SELECT *, first_value(w) OVER (PARTITION BY group_id ORDER BY place) AS w0, row_number() OVER (PARTITION BY group_id ORDER BY place) AS k FROM p),
 g AS (SELECT group_id, count(*) AS n, count(DISTINCT kind) AS kinds, count(DISTINCT rule) AS rules, max(rule) AS rule, count(DISTINCT code) AS codes, max(code) AS code, bool_and(k = 1 OR len(list_intersect(w, w0))::DOUBLE / len(list_distinct(list_concat(w, w0))) >= 0.75) AS close FROM f GROUP BY group_id)
 SELECT group_id, n > 1 AND kinds = 1 AND ((rules = 1 AND rule <> '') OR (codes = 1 AND code <> '' AND close)) AS safe FROM g"""
)
def semantic_group_code(spark, d):
    p = table(spark, d, "part")
    rule, code_ = F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise(""), F.when(F.col("p_partkey") % 4 < 2, F.lit(" X")).otherwise("")
    p = p.select(F.floor(F.col("p_partkey") / 3).alias("group_id"), F.col("p_partkey").alias("place"), F.col("p_type").alias("type"), F.lit(3).alias("severity"), rule.alias("rule_id"), code_.alias("existing_code"), F.col("p_name").alias("description"))
    return rollup.safe_groups(p)


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN NULL WHEN s_suppkey % 3 = 0 THEN s_name || '@x.org' ELSE s_name || '@corp.example' END AS address, coalesce(n_name, s_nationkey::VARCHAR) AS display_name FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey AND n_nationkey % 2 = 0")
def owner_routing(spark, d):
    s = table(spark, d, "supplier").withColumn("account", F.col("s_nationkey").cast("string"))
    owner = F.when(F.col("s_suppkey") % 5 == 0, " ").when(F.col("s_suppkey") % 3 == 0, F.concat("s_name", F.lit("@x.org"))).otherwise(F.col("s_name"))
    names = table(spark, d, "nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").cast("string").alias("account"), F.col("n_name").alias("name"))
    s = s.withColumn("address", rollup.mail_address(owner, "corp.example"))
    return rollup.display_name(s, names, "account").select("s_suppkey", "address", "display_name")


@query("SELECT path, CASE WHEN path LIKE '%/de/%' AND (path LIKE '%.c' OR path LIKE '%.h') THEN 'german-c' WHEN path LIKE 'src1/%' THEN 'one' WHEN path LIKE '%.py' THEN 'python' END AS rule_id FROM (SELECT DISTINCT path FROM tree)", "tree")
def first_rule(spark, d):
    return code.first_rule(role(spark, d, "tree").select("path").distinct(), [("german-c", "*/de/*.{c,h}"), ("one", "src1/*"), ("python", "**/*.py")])


@query("WITH c AS (SELECT DISTINCT path FROM tree WHERE path LIKE '%.c'), f AS (SELECT path FROM c UNION SELECT left(path, length(path) - 1) || 'h' FROM c), n AS (SELECT path, string_split(path, '/')[-1] AS name FROM f) SELECT path, related, 100 AS score FROM (SELECT a.path, b.path AS related, row_number() OVER (PARTITION BY a.path ORDER BY b.path) AS k FROM n a JOIN n b ON left(a.name, length(a.name) - 1) = left(b.name, length(b.name) - 1) AND a.name <> b.name) WHERE k <= 8", "tree")
def related_files(spark, d):
    t = role(spark, d, "tree").select("path", "text")
    headers = t.where("path like '%.c'").select(F.regexp_replace("path", "c$", "h").alias("path"), F.lit("").alias("text")).distinct()
    return code.related_files(t.union(headers).withColumn("language", trees.language(F.col("path")))).select("path", "related", "score")


# --- order-dependent and sequence-matching operators


@query(f"SELECT file_name, block_id, line_no AS issue_id, row_number() OVER (PARTITION BY file_name, severity, line_no, feedback_type ORDER BY ({SHOWN}) DESC) = 1 AS survivor FROM issue", "issue")
def merged_issues(spark, d):
    i = role(spark, d, "issue").withColumns({"issue_id": F.col("line_no"), "type": F.lit("logic"), "issue_line_numbers": F.col("line_no").cast("string"), "description": F.col("feedback_type"), "suggestion": F.lit(""), "rule_id": F.lit(""), "existing_code": F.lit("")})
    return issues.merged_in_file(i)


@query(
    f"""WITH {LINES}, c AS (SELECT doc_id, path, pos, code, greatest(1, (length(code) + 9) // 4) AS t FROM lines),
 fold AS (SELECT doc_id, pos, t AS used, 0 AS block FROM c WHERE pos = 0 UNION ALL SELECT c.doc_id, c.pos, CASE WHEN f.used + c.t > 300 THEN c.t ELSE f.used + c.t END, CASE WHEN f.used + c.t > 300 THEN f.block + 1 ELSE f.block END FROM fold f JOIN c ON c.doc_id = f.doc_id AND c.pos = f.pos + 1),
 j AS (SELECT c.*, block, lower(trim(code)) AS x, ends_with(path, '.c') AS is_c, ends_with(path, '.py') AS is_py FROM c JOIN fold USING (doc_id, pos)),
 k AS (SELECT *, (is_c AND regexp_matches(x, '^(//.*)?$')) OR (is_py AND regexp_matches(x, '^(#.*)?$')) AS bare, (pos = 0 AND starts_with(x, '#!')) OR regexp_matches(x, 'coding[:=]|coverage:|eslint-|go:build|gosec|noinspection|nolint|noqa|nosec|pragma:|shellcheck|sourcemappingurl=|type: ignore') AS acts FROM j)
 SELECT doc_id::VARCHAR AS path, block AS block_id, bool_and(bare AND NOT acts) AS comment_only FROM k GROUP BY ALL""",
    "tree",
)
def comment_only_blocks(spark, d):
    lines = F.transform(F.split("text", "\n"), lambda x, i: text.diff_line(i + 1, F.lit("+"), x))
    t = role(spark, d, "tree").select(F.col("doc_id").cast("string").alias("path"), trees.language(F.col("path")).alias("language"), F.posexplode(diffs.split_blocks(lines, 300)).alias("block_id", "diff_lines"))
    return code.comment_only(t)


ORACLE_SQL["comment_only_blocks"] = ORACLE_SQL["comment_only_blocks"].replace("WITH ", "WITH RECURSIVE ", 1)


@query()
def line_diffs(spark, d):
    t = role(spark, d, "tree").groupBy("path").agg(F.min_by("text", "doc_id").alias("a"), F.max_by("text", "doc_id").alias("b"))
    base = t.select("path", F.col("a").alias("text"), F.md5(F.col("a").cast("binary")).alias("md5"))
    head = t.select("path", F.col("b").alias("text"), F.md5(F.col("b").cast("binary")).alias("md5"))
    return diffs.changed_targets(diffs.compared(base, head), base, head)


@query("""WITH t AS (SELECT path, min_by(text, doc_id) AS a, max_by(text, doc_id) AS b FROM tree GROUP BY path),
 l AS (SELECT path, string_split(a, chr(10)) AS x, string_split(b, chr(10)) AS y FROM t WHERE a <> b)
 SELECT path, md5(array_to_string(x[1:len(x) - (x[-1] = '')::INT], chr(10))) AS old_digest, md5(array_to_string(y[1:len(y) - (y[-1] = '')::INT], chr(10))) AS new_digest FROM l""", "tree")
def line_diffs_rebuilt(spark, d):
    """Both texts, rebuilt from the diff with all of its context: old lines are the equal and removed ones, new lines the equal and added ones."""
    t = role(spark, d, "tree").groupBy("path").agg(F.min_by("text", "doc_id").alias("a"), F.max_by("text", "doc_id").alias("b"))
    base = t.select("path", F.col("a").alias("text"), F.md5(F.col("a").cast("binary")).alias("md5"))
    head = t.select("path", F.col("b").alias("text"), F.md5(F.col("b").cast("binary")).alias("md5"))
    made = diffs.changed_targets(diffs.compared(base, head), base, head, 1 << 30)
    side = lambda *marks: F.md5(F.array_join(F.transform(F.filter("diff_lines", lambda x: F.substring(x, 7, 1).isin(*marks)), lambda x: F.substring(x, F.lit(10), F.length(x))), "\n").cast("binary"))
    return made.select("path", side(" ", "-").alias("old_digest"), side(" ", "+").alias("new_digest"))


from tidemark.plans import reports  # noqa: E402, F401  (adds its queries to these)
