"""Queries of reports, snapshots, endpoints and answers over nested files, with their SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tidemark.functions import numeric, status, text
from tidemark.operators import answers, control, diffs, endpoints, feedback, issues, report, rollup, summaries
from tidemark.operators.report import SCORES
from tidemark.plans.catalog import ADMIN, COUNTERS, END, LISTED, LOG_COUNTERS, LOG_END, LOG_RANGE, LOG_RATES, LOG_START, SHOWN, START, query, rate
from tidemark.plans.proxy import role, table
from tidemark.sources import views

# --- files of a report: an order is a file, its parts' remainders are its blocks, 97 tasks share the files

SCORE = {"logic_score": "block_id * 7 - 30", "performance_score": "block_id * 3", "security_score": "100 - block_id", "readable_score": "50", "code_style_score": "block_id * 11 % 101"}
FILE_WORD = "CASE WHEN f % 17 = 0 THEN 'reviewed' WHEN f % 19 = 0 THEN 'skipped_budget' WHEN f % 23 = 0 THEN 'partial' WHEN f % 29 = 0 THEN 'resumed' ELSE '' END"


def _word(f):
    return F.when(f % 17 == 0, "reviewed").when(f % 19 == 0, "skipped_budget").when(f % 23 == 0, "partial").when(f % 29 == 0, "resumed").otherwise("")


def report_files(spark, d):
    i = role(spark, d, "issue").repartition("task_id")  # dealt by file once: blocks and files are then nested where they are
    kind = F.when(F.col("severity") % 3 == 0, "logic").when(F.col("severity") % 3 == 1, "security").otherwise("")
    i = i.groupBy("task_id", "block_id").agg(F.collect_list(F.struct(F.col("line_no").alias("issue_id"), "severity", kind.alias("type"), "feedback_type", "filter_status", (F.col("severity") >= 6).alias("static_corroborated"))).alias("issues"))
    picked = lambda keep, make: F.transform(F.filter("issues", keep), make)
    mark = lambda x: F.when(x["severity"] % 3 == 0, "+").when(x["severity"] % 3 == 1, "-").otherwise(" ")
    b = F.col("block_id")
    block = F.struct(
        b,
        "issues",
        F.transform("issues", lambda x: text.diff_line(x["issue_id"], mark(x), F.lit("x"))).alias("contents"),
        picked(lambda x: x["severity"] >= 6, lambda x: F.struct(F.when(x["severity"] == 6, "code_search").otherwise("call_graph").alias("tool_name"))).alias("tool_calls"),
        picked(lambda x: x["severity"] <= 2, lambda x: F.struct(F.when(x["severity"] == 1, "local").otherwise("remote").alias("model"))).alias("model_rounds"),
        picked(lambda x: x["severity"] == 4, lambda x: F.struct(F.when(x["issue_id"] % 2 == 0, "lint").otherwise("").alias("analyzer"))).alias("static_findings"),
        (b % 3 != 0).alias("main_task_completed"),
        F.when(b % 13 == 0, "boom").otherwise("").alias("failure_message"),
        (b % 4).alias("review_state"),
        (b % 3).alias("memory_compression_count"),
        *((b * n).alias(c) for c, n in (("process_time", 10), ("llm_prompt_tokens", 3), ("llm_completion_tokens", 2), ("llm_total_tokens", 5), ("llm_elapsed_ms", 7))),
        *(F.expr(e).cast("int").alias(s) for s, e in SCORE.items()),
    )
    files = i.groupBy("task_id").agg(F.collect_list(block).alias("code_blocks"))
    f = F.col("task_id").cast("int")
    shown = F.size(F.filter(F.flatten(F.transform("code_blocks", lambda x: x["issues"])), lambda x: status.reportable(x["filter_status"])))
    extra = F.struct(_word(f).alias("status"), (f % 1000).alias("estimated_tokens"))
    return files.select(
        F.concat(F.lit("r"), (f % 97).cast("string")).alias("task_id"), F.concat(F.lit("t"), "task_id").alias("file_name"), F.when(f % 5 == 0, "  ").otherwise(F.concat(F.lit(" s"), (f % 5).cast("string"))).alias("file_author"),
        (f % 4).alias("state"), extra.alias("extra"), (f % 50).alias("add_code_line_num"), shown.alias("comment_line_number"), "code_blocks",
    )


def report_tasks(spark):
    n = F.col("id").cast("int")
    return spark.range(97).select(F.concat(F.lit("r"), n.cast("string")).alias("id"), (n % 3 + 1).alias("task_type"), (n % 5).alias("task_round_num"), (n % 4).alias("state"), (n % 3).alias("retry_count"), (n % 2 == 0).alias("retry_failed_only"))


RT = "rt AS (SELECT 'r' || n AS id, (n % 3 + 1)::INT AS task_type, (n % 5)::BIGINT AS task_round_num, (n % 4)::INT AS state, (n % 3)::INT AS retry_count FROM range(97) t(n))"
RB = f"""rb AS (SELECT f, block_id, any_value(task) AS task, count(*) AS lines, count(*) FILTER (severity % 3 < 2) AS changed, count(*) FILTER ({SHOWN}) AS shown, count(*) FILTER ({SHOWN} AND severity = 5) AS critical,
 count(*) FILTER (severity >= 6) AS tools, count(*) FILTER (severity <= 2) AS rounds, count(*) FILTER (severity = 2) AS calls, count(*) FILTER (severity = 4) AS findings, count(*) FILTER ({SHOWN} AND severity >= 6) AS corroborated,
 block_id % 3 <> 0 AS done, block_id % 13 = 0 AS failed, block_id % 4 AS bstate, {', '.join(f'({e})::INT AS {s}' for s, e in SCORE.items())} FROM (SELECT *, task_id::INT AS f, 'r' || (task_id::INT % 97) AS task FROM issue) GROUP BY f, block_id)"""
RS = f"""rs AS (SELECT rb.*, task_type, task_round_num, f % 4 AS state, {FILE_WORD} AS status, greatest(1, CASE WHEN task_type = 3 THEN lines ELSE changed END) AS weight,
 CASE WHEN failed OR bstate = 3 THEN 'failed' WHEN done OR bstate = 2 OR f % 4 = 2 OR {FILE_WORD} IN ('reviewed', 'resumed') THEN 'completed' WHEN bstate = 1 THEN 'reviewing' ELSE 'pending' END AS s,
 CASE WHEN failed OR bstate = 3 THEN 'failed' WHEN done OR bstate = 2 THEN 'completed' WHEN bstate = 1 THEN 'reviewing' ELSE 'pending' END AS own FROM rb JOIN rt ON rt.id = rb.task)"""
OF_FILE = "CASE WHEN status = 'skipped_budget' THEN 'failed' WHEN bool_and(s = 'completed') THEN 'completed' WHEN state = 1 OR bool_or(s = 'reviewing') THEN 'reviewing' WHEN state = 3 OR bool_or(s = 'failed') OR status = 'partial' THEN 'failed' ELSE 'pending' END"
IN_BOUNDS = ", ".join(f"sum(greatest(0, least(100, {s})) * weight) AS w_{s}" for s in SCORES)
ROUNDED = ", ".join(f"round_even(w_{s}::DOUBLE / weight, 0)::INT AS {s}" for s in SCORES)
OVERALL = f"round_even(({' + '.join(SCORES)})::DOUBLE / 5, 0)::INT"
REPORT = f"WITH {RT}, {RB}, {RS}"


@query(f"""{REPORT}, f AS (SELECT f, task, status, state, {OF_FILE} AS file, count(*) FILTER (s = 'completed') AS completed_block_num, count(*) FILTER (s = 'failed') AS failed_block_num, sum(weight)::BIGINT AS weight, {IN_BOUNDS} FROM rs GROUP BY f, task, status, state)
 SELECT *, {OVERALL} AS overall_score FROM (SELECT task AS task_id, 't' || f AS file_name, CASE WHEN f % 5 = 0 THEN '' ELSE 's' || (f % 5) END AS file_author, state, file AS status, completed_block_num, failed_block_num, weight AS changed_line_num, f % 50 AS added_line_num, {ROUNDED} FROM f)""", "issue")  # fmt: skip
def report_file_rows(spark, d):
    files = report_files(spark, d).join(report_tasks(spark).select(F.col("id").alias("task_id"), "task_type"), "task_id")
    return summaries.file_rows(files, F.col("task_type"))


@query(f"""{REPORT}, f AS (SELECT f, task, {OF_FILE} AS file FROM rs GROUP BY f, task, status, state), n AS (SELECT task, count(*) AS file_num, count(*) FILTER (file = 'completed') AS reviewed_file_num, count(*) FILTER (file = 'failed') AS incomplete_file_num, sum(f % 50)::BIGINT AS added_line_num FROM f GROUP BY task),
 m AS (SELECT task, count(*) AS code_block_num, sum(shown)::BIGINT AS issue_num, sum(lines - shown)::BIGINT AS filtered_issue_num, sum(critical)::BIGINT AS critical_issue_num, sum(tools)::BIGINT AS tool_call_num, (sum(rounds) + max(task_round_num))::BIGINT AS model_round_num, sum(block_id % 3)::BIGINT AS memory_compression_num, sum(weight)::BIGINT AS weight, {IN_BOUNDS} FROM rs GROUP BY task)
 SELECT *, {OVERALL} AS overall_score FROM (SELECT task AS task_id, file_num, reviewed_file_num, incomplete_file_num, code_block_num, issue_num, filtered_issue_num, critical_issue_num, tool_call_num, model_round_num, memory_compression_num, added_line_num, weight AS changed_line_num, {ROUNDED} FROM m JOIN n USING (task))""", "issue")  # fmt: skip
def report_metrics(spark, d):
    return summaries.task_metrics(report_files(spark, d), report_tasks(spark))


@query(f"{REPORT} SELECT task AS task_id, string_agg(DISTINCT 's' || (f % 5), ',' ORDER BY 's' || (f % 5)) AS authors FROM rs WHERE f % 5 > 0 GROUP BY task", "issue")
def report_authors(spark, d):
    return summaries.authors(report_files(spark, d)).select("task_id", F.array_join("authors", ",").alias("authors"))


@query(f"{REPORT} SELECT DISTINCT 't' || f AS file_name FROM rs WHERE task = 'r5' AND f % 5 = 3", "issue")
def report_author_files(spark, d):
    return summaries.by_author(report_files(spark, d).where("task_id = 'r5'"), " s3 ").select("file_name")


@query(f"{REPORT} SELECT DISTINCT 't' || f AS file_name FROM rs WHERE task = 'r5'", "issue")
def report_unknown_author(spark, d):
    return summaries.by_author(report_files(spark, d).where("task_id = 'r5'"), "nobody").select("file_name")


@query(f"{REPORT} SELECT 't' || f AS file_name, block_id, shown::INT AS issues, {', '.join(f'greatest(0, least(100, {s})) AS {s}' for s in SCORES)}, round_even(({' + '.join(f'greatest(0, least(100, {s}))' for s in SCORES)})::DOUBLE / 5, 0)::INT AS overall FROM rs", "issue")
def report_block_rows(spark, d):
    return rollup.block_rows(report_files(spark, d)).select("file_name", "block_id", F.size("issues").alias("issues"), *SCORES, "overall")


RETRY = "CASE WHEN failed OR bstate = 3 THEN 'failed' WHEN done OR bstate = 2 OR status IN ('reviewed', 'resumed') THEN 'skip' WHEN bstate = 1 THEN 'running' ELSE 'pending' END"


@query(f"{REPORT} SELECT task AS task_id, count(DISTINCT CASE WHEN r = 'failed' THEN f END) AS files, {', '.join(f'count(*) FILTER (r = {chr(39)}{w}{chr(39)}) AS {w}' for w in ('failed', 'pending', 'running'))} FROM (SELECT *, {RETRY} AS r FROM rs WHERE status <> 'skipped_budget') GROUP BY task", "issue")
def retry_summary(spark, d):
    return report.retry_failures(report_files(spark, d))


@query(f"{REPORT}, f AS (SELECT DISTINCT f, task, status, state FROM rs) SELECT task AS task_id, count(*) AS files, count(*) FILTER (state = 2 OR status IN ('reviewed', 'resumed')) AS reviewed, count(*) FILTER (state = 3 OR status IN ('partial', 'skipped_budget')) AS incomplete, any_value(n)::BIGINT AS blocks FROM f JOIN (SELECT task, count(*) AS n FROM rs GROUP BY task) USING (task) GROUP BY task", "issue")
def file_checkpoints(spark, d):
    return rollup.file_checkpoint(report_files(spark, d))


@query(f"""{REPORT} SELECT file_name, issue_count, highest_severity, types, filtered_count, tools, complete FROM (SELECT f, 't' || f AS file_name, bool_and(done) AS complete FROM rs GROUP BY f) JOIN (SELECT task_id::INT AS f, count(*)::INT AS issue_count, max(severity) AS highest_severity, count(*) FILTER (NOT ({SHOWN}))::INT AS filtered_count,
 array_to_string(list_sort(list_distinct(list(CASE severity % 3 WHEN 0 THEN 'logic' WHEN 1 THEN 'security' ELSE '' END))), ',') AS types, coalesce(array_to_string(list_sort(list_distinct(list(CASE severity WHEN 6 THEN 'code_search' WHEN 7 THEN 'call_graph' END) FILTER (severity >= 6))), ','), '') AS tools FROM issue GROUP BY ALL) USING (f)""", "issue")  # fmt: skip
def run_summaries(spark, d):
    return rollup.run_summary(report_files(spark, d)).withColumns({"types": F.array_join("types", ","), "tools": F.array_join("tools", ",")})


@query(f"{REPORT} SELECT task AS task_id, sum(block_id * 3)::BIGINT AS llm_prompt_tokens, sum(block_id * 2)::BIGINT AS llm_completion_tokens, sum(block_id * 5)::BIGINT AS llm_total_tokens, sum(block_id * 7)::BIGINT AS llm_elapsed_ms, sum(calls)::BIGINT AS llm_call_count FROM rs GROUP BY task", "issue")
def block_usage(spark, d):
    return rollup.usage(report_files(spark, d).select("task_id", F.explode("code_blocks").alias("b")).select("task_id", "b.*"), "task_id")


MAPS = f"""kinds AS (SELECT task, string_agg(k || '=' || n, ', ' ORDER BY k) AS issue_type_counts FROM (SELECT 'r' || (task_id::INT % 97) AS task, CASE severity % 3 WHEN 0 THEN 'logic' WHEN 1 THEN 'security' ELSE 'general' END AS k, count(*) AS n FROM issue WHERE {SHOWN} GROUP BY ALL) GROUP BY task),
 levels AS (SELECT task, string_agg(k || '=' || n, ', ' ORDER BY k) AS severity_counts FROM (SELECT 'r' || (task_id::INT % 97) AS task, severity::VARCHAR AS k, count(*) AS n FROM issue WHERE {SHOWN} GROUP BY ALL) GROUP BY task),
 tools AS (SELECT task, string_agg(k || '=' || n, ', ' ORDER BY k) AS tool_call_summary FROM (SELECT 'r' || (task_id::INT % 97) AS task, CASE severity WHEN 6 THEN 'code_search' ELSE 'call_graph' END AS k, count(*) AS n FROM issue WHERE severity >= 6 GROUP BY ALL) GROUP BY task)"""
SNAPSHOT = f"""f AS (SELECT f, task, CASE WHEN bool_and(own = 'completed') THEN 'reviewed' WHEN bool_or(own = 'reviewing') THEN 'reviewing' WHEN bool_or(own = 'failed') AND NOT bool_or(own = 'pending') THEN 'partial' ELSE 'pending' END AS file FROM rs GROUP BY f, task),
 n AS (SELECT task, count(*) AS file_num, count(*) FILTER (file = 'reviewed') AS reviewed_file_num, count(*) FILTER (file = 'partial') AS incomplete_file_num, sum(f % 50)::BIGINT AS add_code_line_num, sum(f % 1000)::BIGINT AS estimated_token_num FROM f GROUP BY task),
 m AS (SELECT task, count(*) AS code_block_num, sum(calls)::BIGINT AS llm_call_count, sum(block_id * 10)::BIGINT AS process_time, sum(block_id * 5)::BIGINT AS llm_total_tokens, count(*) FILTER (own = 'failed') AS failures, count(*) FILTER (own IN ('pending', 'reviewing')) AS waiting, coalesce(sum(weight) FILTER (own = 'completed'), 0) AS weight,
 {', '.join(f"sum({s} * weight) FILTER (own = 'completed') AS w_{s}" for s in SCORES)} FROM rs GROUP BY task)"""


@query(f"""{REPORT}, {MAPS}, {SNAPSHOT}, x AS (SELECT *, CASE WHEN failures = 0 AND waiting = 0 THEN 2 WHEN failures > 0 AND waiting = 0 THEN 3 WHEN rt.state = 1 THEN 1 ELSE 0 END AS snapshot_state FROM m JOIN n USING (task) JOIN rt ON rt.id = task)
 SELECT *, {OVERALL} AS score, CASE state WHEN 0 THEN 'pending' WHEN 1 THEN 'running' WHEN 2 THEN 'completed' ELSE 'partial' END AS completion_status FROM (SELECT task AS task_id, snapshot_state AS state, file_num, reviewed_file_num, incomplete_file_num, code_block_num, add_code_line_num, estimated_token_num, llm_call_count, process_time, llm_total_tokens, {', '.join(f'CASE WHEN weight > 0 THEN round_even(w_{s}::DOUBLE / weight, 0)::INT ELSE 0 END AS {s}' for s in SCORES)}, issue_type_counts, severity_counts, tool_call_summary FROM x LEFT JOIN kinds USING (task) LEFT JOIN levels USING (task) LEFT JOIN tools USING (task))""", "issue")  # fmt: skip
def snapshot_rollups(spark, d):
    s = report_tasks(spark).select(F.col("id").alias("task_id"), "task_type", F.col("state").alias("parent_state"), F.lit(True).alias("finalize"), F.lit(False).alias("has_removals"))
    out = summaries.snapshot_rollup(report_files(spark, d), s).where("file_num > 0")
    out = out.withColumns({c: text.counts_text(F.col(c)) for c in ("issue_type_counts", "severity_counts", "tool_call_summary")})
    return out.drop("task_type", "parent_state", "finalize", "has_removals", "llm_prompt_tokens", "llm_completion_tokens", "llm_elapsed_ms")


@query(f"""{REPORT}, {MAPS}, f AS (SELECT f, task, CASE status WHEN '' THEN 'unknown' ELSE status END AS status, sum(shown) AS shown, count(*) AS blocks, sum(findings) AS findings, sum(corroborated) AS corroborated FROM rs GROUP BY f, task, status),
 t AS (SELECT task, count(*) FILTER (status IN ('reviewed', 'resumed')) AS reviewed_file_num, count(*) AS file_num, count(*) FILTER (status = 'resumed') AS resumed_file_num, count(*) FILTER (status = 'skipped_budget') AS skipped_file_num, count(*) FILTER (status IN ('partial', 'skipped_budget')) AS incomplete_file_num, count(*) FILTER (status = 'partial') AS retryable_file_num, sum(blocks)::BIGINT AS code_block_num, sum(f % 50)::BIGINT AS add_code_line_num,
 sum(shown)::BIGINT AS issue_num, sum(f % 1000)::BIGINT AS estimated_token_num, coalesce(sum(f % 1000) FILTER (status = 'reviewed'), 0)::BIGINT AS consumed_estimated_token_num, sum(findings)::BIGINT AS static_finding_count, sum(corroborated)::BIGINT AS static_corroborated_issue_count, count(*) FILTER (shown > 0) AS files_with_issues FROM f GROUP BY task),
 w AS (SELECT task, coalesce(sum(greatest(1, changed)), 0) AS weight, {', '.join(f'sum({s} * greatest(1, changed)) AS w_{s}' for s in SCORES)} FROM rs WHERE status IN ('reviewed', 'resumed') GROUP BY task),
 counts AS (SELECT task, string_agg(status || '=' || n, ', ' ORDER BY status) AS status_counts FROM (SELECT task, status, count(*) AS n FROM f GROUP BY ALL) GROUP BY task),
 top AS (SELECT task, string_agg('t' || f || ':' || shown, ' ' ORDER BY shown DESC, 't' || f) AS top_files, count(*) AS n_top FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY shown DESC, 't' || f) AS k FROM f WHERE shown > 0) WHERE k <= 10 GROUP BY task),
 z AS (SELECT t.*, rt.retry_count + (incomplete_file_num > 0)::INT AS retry_count, CASE WHEN incomplete_file_num > 0 THEN 3 ELSE 2 END AS state, {', '.join(f'CASE WHEN weight > 0 THEN round_even(w_{s}::DOUBLE / weight, 0)::INT ELSE 0 END AS {s}' for s in SCORES)}, status_counts, top_files, n_top, issue_type_counts, severity_counts FROM t JOIN rt ON rt.id = t.task LEFT JOIN w USING (task) JOIN counts USING (task) LEFT JOIN top USING (task) LEFT JOIN kinds USING (task) LEFT JOIN levels USING (task))
 SELECT task AS task_id, * EXCLUDE (task, n_top, issue_type_counts, severity_counts), CASE state WHEN 3 THEN 'partial' ELSE 'completed' END AS completion_status, floor(({' + '.join(SCORES)})::DOUBLE / 5)::INT AS score,
 '本次审核发现 ' || issue_num || ' 个展示问题，涉及 ' || n_top || ' 个重点文件；主要类型：' || replace(issue_type_counts, ', ', '，') || '；严重度分布：' || replace(severity_counts, ', ', '，') || '。' AS project_summary FROM z""", "issue")  # fmt: skip
def finish_rollups(spark, d):
    out = summaries.finished(report_files(spark, d), report_tasks(spark))
    out = out.withColumns({"status_counts": text.counts_text(F.col("status_counts")), "top_files": F.array_join(F.transform("top_files", lambda x: F.concat(x["file_name"], F.lit(":"), x["issue_count"].cast("string"))), " ")})
    return out.drop("issue_type_counts", "severity_counts", "static_sources", "comment_line_number")


@query("SELECT 2 AS n_files, 3 AS n_blocks, 'a.c,b.c,c.c' AS changed_file_names, 'a.c,b.c,c.c,x.c' AS report_file_names")
def snapshot_created(spark, d):
    files = spark.createDataFrame([("1", "a.c"), ("2", "b.c")], "id string, file_name string")
    changed = spark.createDataFrame([("b.c", 1, "h"), ("a.c", 0, "g"), ("a.c", 2, "k"), ("c.c", 0, "z")], "file_name string, block_id int, block_hash string")
    out = summaries.new_snapshot(files, changed, ["x.c"])
    return out.select(F.size("changed_files").alias("n_files"), F.size("changed_blocks").alias("n_blocks"), F.array_join("changed_file_names", ",").alias("changed_file_names"), F.array_join("report_file_names", ",").alias("report_file_names"))


# --- endpoints


@query(f"""{ADMIN}, k AS (SELECT *, row_number() OVER (ORDER BY issue_count DESC, create_time DESC, id) AS k, count(*) OVER () AS n FROM a WHERE contains(lower(review_version), 'v3') AND create_time >= TIMESTAMP '1995-06-01 00:00:00' AND create_time <= TIMESTAMP '1997-01-01 00:00:00' AND task_type = 2 AND state = 3)
 SELECT {LISTED} FROM k WHERE (k - 1) // 40 = least(2, greatest(1, (n + 39) // 40)) - 1""", "task", "issue")  # fmt: skip
def endpoint_admin_tasks(spark, d):
    t = role(spark, d, "task").withColumn("severity_counts", F.when(F.col("id").cast("int") % 3 == 0, F.create_map(F.lit("5"), F.col("score").cast("long") - 50, F.lit("2"), F.lit(1).cast("long"))))
    p = endpoints.admin_tasks(t, role(spark, d, "issue"), review_version=" V3 ", date_from=dt.datetime(1995, 6, 1), date_to=dt.datetime(1997, 1, 1), task_type=2, state=3, sort_by="issue_count", page=2, size=40)
    return p.rows.select(*LISTED.split(", "))


@query(f"SELECT *, {LOG_RATES} FROM (SELECT project_id, review_version, copy_from_version, {LOG_COUNTERS}, min(create_time) AS first_seen FROM log WHERE {LOG_RANGE} GROUP BY ALL) ORDER BY first_seen, project_id, review_version, copy_from_version LIMIT 7 OFFSET 7", "log")
def endpoint_log_versions(spark, d):
    return endpoints.feedback_logs(role(spark, d, "log"), "version", LOG_START, LOG_END, LOG_END, 2, 7)["items"].rows


@query(f"SELECT *, {LOG_RATES} FROM (SELECT trim(file_author) AS author, {LOG_COUNTERS}, min(create_time) AS first_seen FROM log WHERE {LOG_RANGE} GROUP BY 1) ORDER BY first_seen, author LIMIT 25", "log")
def endpoint_log_authors(spark, d):
    return endpoints.feedback_logs(role(spark, d, "log"), "author", LOG_START, LOG_END, LOG_END, 1, 25)["items"].rows


@query(f"SELECT id, severity, trim(file_author) AS author, feedback_type FROM log WHERE {LOG_RANGE} AND project_id = 'p7' AND review_version = 'v1' AND copy_from_version = 'master'", "log")
def endpoint_log_of_version(spark, d):
    return endpoints.feedback_log_of_version(role(spark, d, "log"), "p7", "v1", "master", LOG_START, LOG_END, LOG_END)["items"].select("id", "severity", "author", "feedback_type")


@query(f"SELECT id, severity, create_time FROM log WHERE {LOG_RANGE} AND trim(file_author) = '' ORDER BY create_time, id LIMIT 30", "log")
def endpoint_log_of_author(spark, d):
    return endpoints.feedback_log_of_author(role(spark, d, "log"), "__empty__", LOG_START, LOG_END, LOG_END, 1, 30)["items"].rows.select("id", "severity", "create_time")


@query(f"SELECT *, {LOG_RATES} FROM (SELECT {LOG_COUNTERS} FROM log WHERE create_time >= TIMESTAMP '2024-01-01' AND create_time < TIMESTAMP '2024-01-31')", "log")
def endpoint_log_default_range(spark, d):
    return endpoints.feedback_logs(role(spark, d, "log"), "none", None, None, dt.date(2024, 1, 30))["summary"]


def _nested_issues(spark, d):
    """Files of tasks of the issue role, one for each task, author and file."""
    # dealt by task once: nesting, picking tasks and counting by task then deal nothing anew, however the picked tasks are joined
    i = role(spark, d, "issue").repartition("task_id")
    b = i.groupBy("task_id", "file_name", "file_author", "block_id").agg(F.collect_list(F.struct(F.col("line_no").alias("issue_id"), "severity", "feedback_type", "filter_status")).alias("issues"))
    return b.groupBy("task_id", "file_name", "file_author").agg(F.collect_list(F.struct("block_id", "issues")).alias("code_blocks")).withColumn("id", F.concat_ws("/", "task_id", "file_name"))


SEEN = "WITH v AS (SELECT i.*, project_id, review_version, create_time FROM issue i JOIN task t ON t.id = i.task_id WHERE task_type = 2 AND create_time >= TIMESTAMP '1996-01-01' AND create_time < TIMESTAMP '1998-07-01')"


@query(f"""{SEEN}, a AS (SELECT DISTINCT trim(file_author) AS author FROM v), n AS (SELECT trim(file_author) AS author, {COUNTERS} FROM v WHERE {SHOWN} GROUP BY 1)
 SELECT author, coalesce(issue_count, 0) AS issue_count, coalesce(severe_count, 0) AS severe_count, CASE WHEN author = 's7' THEN 'Ada' ELSE author END AS display_name FROM a LEFT JOIN n USING (author) ORDER BY display_name, author LIMIT 20""", "task", "issue")  # fmt: skip
def endpoint_feedback_authors(spark, d):
    names = spark.createDataFrame([("s7", "Ada")], "account string, name string")
    p = endpoints.feedback_admin(role(spark, d, "task"), _nested_issues(spark, d), names, "author_prd", START, END, 1, 20)
    return p["items"].rows.select("author", "issue_count", "severe_count", "display_name")


@query(f"""{SEEN}, m AS (SELECT id AS task_id, create_time FROM task WHERE task_type = 2 AND create_time >= TIMESTAMP '1996-01-01' AND create_time < TIMESTAMP '1998-07-01'), n AS (SELECT task_id, {COUNTERS} FROM v WHERE {SHOWN} GROUP BY 1)
 SELECT task_id, coalesce(issue_count, 0) AS issue_count, coalesce(severe_count, 0) AS severe_count FROM m LEFT JOIN n USING (task_id) ORDER BY create_time DESC, task_id DESC LIMIT 30 OFFSET 30""", "task", "issue")  # fmt: skip
def endpoint_feedback_tasks(spark, d):
    names = spark.createDataFrame([], "account string, name string")
    return endpoints.feedback_admin(role(spark, d, "task"), _nested_issues(spark, d), names, "prd_version", START, END, 2, 30)["items"].rows.select("task_id", "issue_count", "severe_count")


@query(f"{SEEN} SELECT severity, file_name, block_id, line_no AS issue_id, feedback_type FROM v WHERE file_author = 's7' AND {SHOWN} ORDER BY severity DESC, file_name, block_id, issue_id LIMIT 1000", "task", "issue")
def endpoint_author_report(spark, d):
    p = endpoints.author_report(role(spark, d, "task"), _nested_issues(spark, d), "s7", 2, START, END, 1, 1000)
    return p["items"].rows.select("severity", "file_name", "block_id", "issue_id", "feedback_type")


@query("SELECT task_type, count(*) AS n, CASE task_type WHEN 1 THEN '轮询版' WHEN 2 THEN '正式版' WHEN 3 THEN '全量审核' ELSE '未分类' END AS name FROM (SELECT CASE WHEN id::BIGINT % 10 = 0 THEN 9 ELSE task_type END AS task_type FROM task) GROUP BY ALL", "task")
def task_type_names(spark, d):
    t = role(spark, d, "task").withColumn("task_type", F.when(F.col("id").cast("long") % 10 == 0, 9).otherwise(F.col("task_type")))
    return feedback.tasks_by_type(t).withColumn("name", endpoints.type_name(F.col("task_type")))


# --- answers of a model

ANSWER = """a AS (SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN '```json' || chr(10) || '{"issues": []}' || chr(10) || '```' WHEN 1 THEN 'so: {"issues": [{"type": "Bug", "severity": "High", "description": "d' || c_custkey || '", "confidence_level": 1.5}, {"type": "style"}]} ok' WHEN 2 THEN 'none' ELSE '{"other": 1}' END AS text FROM customer)"""


def _answers(spark, d):
    c = table(spark, d, "customer").withColumn("k", F.col("c_custkey") % 4)
    one = F.concat(F.lit('so: {"issues": [{"type": "Bug", "severity": "High", "description": "d'), F.col("c_custkey").cast("string"), F.lit('", "confidence_level": 1.5}, {"type": "style"}]} ok'))
    return c.select(F.col("c_custkey").alias("id"), F.when(F.col("k") == 0, '```json\n{"issues": []}\n```').when(F.col("k") == 1, one).when(F.col("k") == 2, "none").otherwise('{"other": 1}').alias("text"))


@query(f"WITH {ANSWER} SELECT id, 1 AS issue_id, 'logic' AS type, 4 AS severity, 'd' || id AS description, 1.0::DOUBLE AS confidence_level FROM a WHERE id % 4 = 1 UNION ALL SELECT id, 2, 'code_style', 1, '', 0.8::DOUBLE FROM a WHERE id % 4 = 1")
def comment_issues(spark, d):
    return answers.issues_of_comments(answers.comments_of(_answers(spark, d))).select("id", "issue_id", "type", "severity", "description", "confidence_level")


@query(f"WITH {ANSWER} SELECT id, id % 4 = 0 OR (id % 4 = 1) AS taken FROM a")
def comment_answers_taken(spark, d):
    a = _answers(spark, d)
    return answers.comments_taken(a, answers.comments_of(a).where("coalesce(description, '') <> ''"))


def _judged(spark, d):
    li = table(spark, d, "lineitem").where("l_linenumber <= 3").groupBy(F.col("l_orderkey").alias("path"), F.col("l_linenumber").cast("int").alias("issue_id")).agg(F.max("l_quantity").cast("int").alias("q"), F.max("l_partkey").alias("p"))
    given = F.when(F.col("q") % 3 == 0, "Filtered").when(F.col("q") % 3 == 1, "odd").otherwise(F.lit(None))
    said = li.where("p % 2 = 0").select("path", "issue_id", F.lit(1).alias("place"), given.alias("filter_status"), F.lit("why").alias("filter_reason"), F.when(F.col("p") % 4 == 0, " seen ").otherwise(" ").alias("counter_evidence"))
    return li.select("path", "issue_id", F.lit("filtered").alias("filter_status"), F.lit("old").alias("filter_reason")), said


@query("""WITH g AS (SELECT l_orderkey AS path, l_linenumber::INT AS issue_id, max(l_quantity)::INT AS q, max(l_partkey) AS p FROM lineitem WHERE l_linenumber <= 3 GROUP BY ALL)
 SELECT path, issue_id, CASE WHEN p % 2 = 1 THEN 'filtered' WHEN q % 3 = 0 AND p % 4 = 0 THEN 'filtered' ELSE 'kept' END AS filter_status, CASE WHEN p % 2 = 1 THEN 'old' WHEN q % 3 = 0 AND p % 4 <> 0 THEN '过滤结论缺少 diff 直接反证，按保守原则保留。' ELSE 'why' END AS filter_reason,
 CASE WHEN p % 2 = 1 THEN NULL WHEN q % 3 = 0 AND p % 4 = 0 THEN 1 ELSE 0 END AS re_review_status FROM g""")  # fmt: skip
def filter_guard(spark, d):
    return answers.filter_applied(*_judged(spark, d)).select("path", "issue_id", "filter_status", "filter_reason", "re_review_status")


@query("""WITH g AS (SELECT l_orderkey AS path, l_linenumber::INT AS issue_id, max(l_quantity)::INT AS q, max(l_partkey) AS p FROM lineitem WHERE l_linenumber <= 3 GROUP BY ALL)
 SELECT path, issue_id, CASE WHEN p % 3 = 0 THEN p::VARCHAR WHEN p % 3 = 1 THEN '0' WHEN q % 2 = 0 THEN q::VARCHAR ELSE '' END AS issue_line_numbers,
 CASE WHEN p % 3 = 2 THEN NULL WHEN q % 2 = 0 THEN q::VARCHAR ELSE '0' END AS original_issue_line_numbers, CASE p % 3 WHEN 0 THEN 'relocated' WHEN 1 THEN 'unchanged' END AS relocation_status,
 CASE WHEN p % 3 = 1 THEN 'new' ELSE 'x' END AS existing_code, CASE p % 3 WHEN 0 THEN 'why' WHEN 1 THEN '' END AS re_review_description, CASE WHEN p % 3 < 2 THEN 'matched' END AS evidence_match_status,
 CASE p % 3 WHEN 0 THEN 0.25 WHEN 1 THEN 1 ELSE 0.5 END::DOUBLE AS confidence_level, CASE WHEN p % 3 = 0 THEN 0 WHEN p % 3 = 1 THEN 0 END AS re_review_status FROM g""")  # fmt: skip
def relocation_answers(spark, d):
    """Two answers for an issue, taken field by field: the second lacks lines, code and evidence for every third, the first is out of range in its confidence."""
    li = table(spark, d, "lineitem").where("l_linenumber <= 3").groupBy(F.col("l_orderkey").alias("path"), F.col("l_linenumber").cast("int").alias("issue_id")).agg(F.max("l_quantity").cast("int").alias("q"), F.max("l_partkey").alias("p"), F.lit("x").alias("existing_code"), F.lit(0.5).alias("confidence_level"))
    li = li.withColumn("issue_line_numbers", F.when(F.col("q") % 2 == 0, F.col("q").cast("string")).otherwise(""))
    said = li.where("p % 3 < 2").select("path", "issue_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("place"), "p")
    first, moved = F.col("place") == 0, F.col("p") % 3 == 0
    said = said.select(
        "path", "issue_id", "place", F.when(first, "0").when(moved, F.col("p").cast("string")).alias("issue_line_numbers"), F.when(first & ~moved, "new").otherwise("").alias("existing_code"),
        F.when(first, "failed").when(moved, "relocated").alias("relocation_status"), F.when(~first & moved, "why").alias("relocation_description"), F.when(first, "matched").otherwise("").alias("evidence_match_status"),
        F.when(first, "1.5").when(moved, "0.25").otherwise("high").alias("confidence_level"),
    )
    return answers.relocation_applied(li, said).select("path", "issue_id", "issue_line_numbers", "original_issue_line_numbers", "relocation_status", "existing_code", "re_review_description", "evidence_match_status", "confidence_level", "re_review_status")


@query("SELECT conv_id, turn, '{\"content\": ' || to_json(CASE WHEN length(text) > 100 THEN left(text, 80) || '...<truncated>' ELSE text END)::VARCHAR || ', \"tool_call_count\": 2, \"tool_names\": [\"read_file\"]}' AS summary FROM conversations WHERE role = 'assistant' AND text IS NOT NULL")
def assistant_summaries(spark, d):
    c = table(spark, d, "conversations").where("role = 'assistant' and text is not null")
    return c.select("conv_id", "turn", answers.message_summary(F.col("text"), F.array(F.lit("read_file"), F.lit("")), 100).alias("summary"))


# --- issues, by the operators themselves


@query("""WITH lines AS (SELECT doc_id, path, generate_subscripts(l, 1) AS line_no, unnest(l) AS code FROM (SELECT doc_id, path, string_split(text, chr(10)) AS l FROM tree)), r AS (SELECT doc_id::VARCHAR AS path, line_no, lower(code) AS c, trim(code) AS existing_code, CASE WHEN ends_with(path, '.c') THEN 'C' WHEN ends_with(path, '.py') THEN 'Python' ELSE 'General' END AS language FROM lines)
 SELECT path, line_no::INT AS line_no, rule_id, severity, confidence, existing_code FROM r JOIN (VALUES ('credential', 4, 0.75::DOUBLE), ('dynamic-execution', 5, 0.9::DOUBLE), ('unfinished', 2, 0.7::DOUBLE), ('swallowed-exception', 3, 0.8::DOUBLE)) x(rule_id, severity, confidence) ON
 (rule_id = 'credential' AND (contains(c, 'password') OR contains(c, 'secret') OR contains(c, 'api_key') OR contains(c, 'access_token'))) OR (rule_id = 'dynamic-execution' AND (contains(c, 'eval(') OR contains(c, 'exec('))) OR (rule_id = 'unfinished' AND (contains(c, 'todo') OR contains(c, 'fixme'))) OR (rule_id = 'swallowed-exception' AND language = 'Python' AND contains(c, 'except exception') AND contains(c, 'pass'))
 UNION ALL SELECT path, line_no::INT, rule_id, severity, confidence, existing_code FROM r JOIN (VALUES ('unbounded-copy', 5, 0.9::DOUBLE), ('unbounded-scan', 4, 0.85::DOUBLE), ('format-string', 5, 0.9::DOUBLE), ('zero-division', 4, 0.8::DOUBLE), ('missing-argument', 4, 0.85::DOUBLE)) x(rule_id, severity, confidence) ON language = 'C' AND
 ((rule_id = 'unbounded-copy' AND (contains(c, 'strcpy(') OR contains(c, 'strcat('))) OR (rule_id = 'unbounded-scan' AND contains(c, 'sscanf(') AND contains(c, '%s') AND NOT contains(c, '%31s')) OR (rule_id = 'format-string' AND (contains(c, 'printf(message)') OR contains(c, 'fprintf(file, message)'))) OR (rule_id = 'zero-division' AND contains(c, '/ right')) OR (rule_id = 'missing-argument' AND contains(c, 'argv[2]')))""", "tree")  # fmt: skip
def detector_rules(spark, d):
    from tidemark.sources import trees

    t = role(spark, d, "tree")
    lines = t.select(F.col("doc_id").cast("string").alias("path"), trees.language(F.col("path")).alias("language"), F.posexplode(F.split("text", "\n")).alias("pos", "code"))
    return issues.detected(lines.withColumn("line_no", F.col("pos") + 1)).select("path", "line_no", "rule_id", "severity", "confidence", "existing_code")


@query("SELECT doc_id::VARCHAR AS path, 'FULL' AS change_type, len(l) - (l[-1] = '')::INT AS line_count, md5(array_to_string(list_transform(l[1:len(l) - (l[-1] = '')::INT], lambda x, i: lpad(i::VARCHAR, greatest(6, length(i::VARCHAR))::INT, ' ') || '+  ' || x), chr(10))) AS digest FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM tree WHERE text <> '')", "tree")
def full_scan_targets(spark, d):
    t = role(spark, d, "tree").select(F.col("doc_id").cast("string").alias("path"), F.lit("C").alias("language"), "text")
    return diffs.full_scan(t).select("path", "change_type", F.col("line_count"), diffs.block_hash(F.col("diff_lines")).alias("digest"))


@query("""WITH lines AS (SELECT doc_id, generate_subscripts(l, 1) AS line_no, unnest(l) AS code FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM tree)), w AS (SELECT doc_id, line_no, regexp_replace(code, '\\s+', '', 'g') AS norm FROM lines), n AS (SELECT *, lead(norm) OVER o AS next, lead(line_no) OVER o AS next_no, row_number() OVER o AS k FROM w WHERE norm <> '' WINDOW o AS (PARTITION BY doc_id ORDER BY line_no)),
 f AS (SELECT doc_id, norm, next FROM n WHERE k = 2 AND next IS NOT NULL)
 SELECT n.doc_id::VARCHAR AS path, n.line_no::INT AS start_line, n.next_no::INT AS end_line, n.line_no % 3 = 0 OR n.next_no % 3 = 0 AS on_change FROM n JOIN f ON n.doc_id = f.doc_id AND n.norm = f.norm AND n.next = f.next WHERE n.next_no - n.line_no <= 8""", "tree")  # fmt: skip
def evidence_windows(spark, d):
    t = role(spark, d, "tree").select(F.col("doc_id").cast("string").alias("path"), "text")
    lines = t.select("path", F.posexplode(F.split("text", "\n")).alias("pos", "code")).select("path", (F.col("pos") + 1).alias("line_no"), text.squeeze(F.col("code")).alias("norm"), ((F.col("pos") + 1) % 3 == 0).alias("changed"))
    bare = F.filter(F.split("text", "\n"), lambda x: text.squeeze(x) != "")
    quoted = F.concat(F.lit("+  "), F.get(bare, 1), F.lit(" \n\n"), F.get(bare, 2))
    wanted = t.where(F.size(bare) > 2).select("path", F.lit(1).cast("long").alias("fragment_id"), quoted.alias("code")).withColumn("wanted", F.transform(F.array(F.get(bare_of("code"), 0), F.get(bare_of("code"), 1)), text.squeeze))
    return issues.exact_matches(wanted, lines).select("path", "start_line", "end_line", "on_change")


def bare_of(c):
    """Lines of a quoted fragment as they stand, without its marker."""
    return F.filter(F.split(F.regexp_replace(c, r"^\+  ", ""), "\n"), lambda x: text.squeeze(x) != "")


@query("""WITH m AS (SELECT l_orderkey::VARCHAR AS path, l_linenumber::BIGINT AS fragment_id, l_quantity::INT AS start_line, l_quantity::INT + 2 AS end_line, (l_partkey % 5 + 5)::DOUBLE / 10 AS score, l_returnflag = 'A' AS on_change FROM lineitem GROUP BY ALL), r AS (SELECT *, row_number() OVER w AS n, first_value(on_change) OVER w AS top_change, first_value(score) OVER w AS top_score, count(*) OVER (PARTITION BY path, fragment_id) AS occurrences FROM m WINDOW w AS (PARTITION BY path, fragment_id ORDER BY on_change DESC, score DESC, abs(start_line - 20), start_line, end_line)),
 t AS (SELECT path, fragment_id, count(*) FILTER (on_change = top_change AND abs(score - top_score) < 0.001) > 1 AS ambiguous FROM r GROUP BY ALL)
 SELECT path, fragment_id, start_line, on_change, occurrences, ambiguous, least(1, score * CASE WHEN ambiguous THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN on_change THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END) AS confidence FROM r JOIN t USING (path, fragment_id) WHERE n = 1""")  # fmt: skip
def evidence_located(spark, d):
    li = table(spark, d, "lineitem")
    q = F.col("l_quantity").cast("int")
    m = li.select(F.col("l_orderkey").cast("string").alias("path"), F.col("l_linenumber").cast("long").alias("fragment_id"), q.alias("start_line"), (q + 2).alias("end_line"), ((F.col("l_partkey") % 5 + 5).cast("double") / 10).alias("score"), (F.col("l_returnflag") == "A").alias("on_change")).distinct()
    claimed = m.select("path", "fragment_id", F.lit(20).alias("claimed_line")).distinct()
    return issues.located(m, claimed).select("path", "fragment_id", "start_line", "on_change", "occurrences", "ambiguous", "confidence")


@query("""SELECT l_orderkey, l_partkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN 'no description or suggestion' WHEN l_linenumber = 2 THEN 'no code' WHEN l_linenumber = 3 THEN 'no evidence' WHEN l_returnflag = 'N' AND l_linestatus = 'O' AND l_suppkey % 3 = 0 THEN 'no line' WHEN l_suppkey % 5 = 0 THEN 'not relocated' WHEN l_discount < 0.03 THEN 'low confidence' WHEN l_tax < 0.02 THEN 'code doesn''t match' WHEN l_quantity::INT % 2 = 1 THEN 'line isn''t under review' END AS reason FROM lineitem""")
def rejections(spark, d):
    li = table(spark, d, "lineitem")
    n = F.col("l_linenumber")
    no_line = (F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "O") & (F.col("l_suppkey") % 3 == 0)
    i = li.withColumns({
        "description": F.lit("d"), "suggestion": F.when(n == 1, "  ").otherwise("s"), "existing_code": F.when(n == 2, "").otherwise("c"), "evidence": F.when(n != 3, "e"), "issue_line_numbers": F.when(no_line, "none").otherwise(F.concat(F.lit("line "), (F.col("l_quantity").cast("int") % 2).cast("string"))),
        "relocation_status": F.when(F.col("l_suppkey") % 5 == 0, "failed"), "confidence_level": F.when(F.col("l_discount") < 0.03, 0.4), "evidence_match_score": F.when(F.col("l_tax") < 0.02, 0.5),
    })
    return i.select("l_orderkey", "l_partkey", "l_linenumber", issues.rejection(F.array(F.lit(0), F.lit(2))).alias("reason"))


@query("""WITH i AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_shipdate, l_extendedprice) AS issue_id, l_partkey AS part, l_quantity::INT AS a, l_quantity::INT + l_linenumber::INT AS b, CASE WHEN l_suppkey % 2 = 0 THEN 'R' || (l_suppkey % 7) ELSE '' END AS rule, CASE WHEN l_suppkey % 3 = 0 THEN 'security' ELSE 'style' END AS kind FROM lineitem WHERE l_returnflag = 'A'),
 f AS (SELECT DISTINCT l_partkey AS part, l_quantity::INT AS a, l_quantity::INT + 2 AS b, 'r' || (l_suppkey % 7) AS rule, CASE WHEN l_suppkey % 4 = 0 THEN 'taint reaches it' ELSE 'plain words' END AS message, CASE WHEN l_suppkey % 5 = 0 THEN 'error' ELSE 'note' END AS level FROM lineitem WHERE l_returnflag = 'R'),
 x AS (SELECT i.issue_id, f.rule FROM i JOIN f ON f.part = i.part AND f.a <= i.b AND f.b >= i.a WHERE (i.rule <> '' AND lower(i.rule) = f.rule) OR (kind = 'security' AND contains(message, 'taint')) OR (level = 'error' AND f.a = i.a AND f.b = i.b))
 SELECT issue_id, string_agg(DISTINCT rule, ',' ORDER BY rule) AS rule_ids FROM x GROUP BY issue_id""")  # fmt: skip
def corroborations(spark, d):
    from tidemark.shared import ranked

    li = table(spark, d, "lineitem")
    q, k = F.col("l_quantity").cast("int"), F.col("l_suppkey")
    order = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate", "l_extendedprice")
    i = ranked(li.where("l_returnflag = 'A'"), *map(F.asc, order), out="n")
    i = i.select((F.col("n") + 1).alias("issue_id"), F.col("l_partkey").alias("file_name"), q.alias("start_line"), (q + F.col("l_linenumber")).cast("int").alias("end_line"), F.when(k % 2 == 0, F.concat(F.lit("R"), (k % 7).cast("string"))).otherwise("").alias("rule_id"), F.when(k % 3 == 0, "security").otherwise("style").alias("type"), F.lit("").alias("description"), F.lit("").alias("evidence"))
    f = li.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("file_name"), q.alias("start_line"), (q + 2).alias("end_line"), F.concat(F.lit("r"), (k % 7).cast("string")).alias("rule_id"), F.when(k % 4 == 0, "taint reaches it").otherwise("plain words").alias("message"), F.when(k % 5 == 0, "error").otherwise("note").alias("level")).distinct()
    f = f.withColumns({"analyzer": F.lit("a"), "fingerprint": F.sha2(F.to_json(F.struct(*f.columns)), 256)})
    return issues.corroborated(i, f).select("issue_id", F.array_join("rule_ids", ",").alias("rule_ids"))


@query(f"{REPORT} SELECT 't' || f AS file_name, coalesce(f % 3 = 0 AND f % 4 > 0 AND status <> 'skipped_budget' AND bool_and(done AND NOT failed), false) AS reusable FROM rs GROUP BY f, status", "issue")
def reusable_files(spark, d):
    f = report_files(spark, d)
    n = F.substring("file_name", F.lit(2), F.length("file_name")).cast("int")
    f = f.withColumns({"source_hash": F.lit("h"), "new_source_hash": F.when(n % 3 == 0, "h").otherwise("g"), "fingerprint": F.lit("p"), "new_fingerprint": F.when(n % 4 > 0, "p").otherwise("q"), "status": F.col("extra.status"), "complete": F.transform("code_blocks", status.block_complete)})
    return f.select("file_name", F.coalesce(diffs.reusable(f), F.lit(False)).alias("reusable"))


@query("SELECT id, CASE WHEN copy_from_version = '0_version' OR id::BIGINT % 13 = 0 THEN 3 WHEN task_type IN (1, 2) THEN task_type ELSE 1 END AS task_type, state = 1 AND id::BIGINT % 2 = 0 AND create_time > TIMESTAMP '1995-01-01' AS active FROM task", "task")
def task_states(spark, d):
    t = role(spark, d, "task")
    n = F.col("id").cast("long")
    base = F.when(n % 13 == 0, " ").otherwise(F.col("copy_from_version"))
    return t.select("id", status.task_type(base, F.col("task_type")).alias("task_type"), status.worker_active(F.col("state"), F.when(n % 2 == 0, "w").otherwise(""), F.col("create_time"), F.lit("1995-01-01 00:00:00").cast("timestamp_ntz")).alias("active"))


@query("SELECT c_custkey, round_even(least(1, greatest(0, c_acctbal / 5000)), 6)::DOUBLE AS confidence, greatest(0, least(100, floor(c_acctbal / 50)))::INT AS score, CASE c_mktsegment WHEN 'BUILDING' THEN 'logic' WHEN 'MACHINERY' THEN 'code_style' WHEN 'FURNITURE' THEN 'readability' ELSE 'logic' END AS kind, CASE WHEN length(c_name || c_mktsegment) > 26 THEN left(c_name || c_mktsegment, 6) || chr(10) || '...[truncated]' ELSE c_name || c_mktsegment END AS cut, c_custkey::VARCHAR || '/x' AS path FROM customer")
def bounded_values(spark, d):
    c = table(spark, d, "customer")
    kind = F.when(F.col("c_mktsegment") == "BUILDING", "Bug").when(F.col("c_mktsegment") == "MACHINERY", "Code Style").when(F.col("c_mktsegment") == "FURNITURE", "maintainability").otherwise(F.col("c_mktsegment"))
    return c.select("c_custkey", F.bround(numeric.clamp(F.col("c_acctbal") / 5000, 0.0, 1.0, 0.8), 6).alias("confidence"), numeric.clamp(F.floor(F.col("c_acctbal") / 50), 0, 100, 80).cast("int").alias("score"), text.issue_type(kind).alias("kind"), text.cut(F.concat("c_name", "c_mktsegment"), 26).alias("cut"), F.concat(F.col("c_custkey").cast("string"), F.lit("/x")).alias("path"))


@query("SELECT id, CASE WHEN state IN (0, 1, 3) AND id::BIGINT % 3 > 0 AND rev < 9 AND rev = (SELECT max(rev) FROM s b WHERE b.k = s.k AND b.state IN (0, 1, 3) AND b.id::BIGINT % 3 > 0 AND b.rev < 9) THEN 9 ELSE rev END AS trigger_revision FROM s WHERE k = '7'".replace("SELECT id, CASE", "WITH s AS (SELECT id, state, project_id AS k, (row_number() OVER (PARTITION BY project_id ORDER BY id::BIGINT))::INT AS rev FROM task) SELECT id, CASE", 1), "task")
def snapshot_carried(spark, d):
    from pyspark.sql import Window

    n = F.col("id").cast("long")
    s = role(spark, d, "task").withColumns({"task_id": F.col("project_id"), "trigger_revision": F.row_number().over(Window.partitionBy("project_id").orderBy(n)), "completion_status": F.when(n % 3 > 0, "pending").otherwise("superseded")}).where("task_id = '7'")
    return control.carried_forward(s, F.lit("7"), 9).select("id", "trigger_revision")


@query(f"SELECT project_id, {rate('sum(CASE WHEN feedback_type = ' + chr(39) + 'agree' + chr(39) + ' THEN 1 ELSE 0 END)', 'count(*)')} AS agree_rate FROM log GROUP BY project_id", "log")
def feedback_rates(spark, d):
    n = role(spark, d, "log").groupBy("project_id").agg(F.count_if(F.col("feedback_type") == "agree").alias("a"), F.count("*").alias("n"))
    return n.select("project_id", numeric.rate(F.col("a"), F.col("n")).alias("agree_rate"))


@query(f"SELECT id, severity FROM log WHERE {LOG_RANGE} AND file_author = 'u7'", "log")
def log_rows_of_author(spark, d):
    log = role(spark, d, "log").where(views.within(F.col("create_time"), LOG_START, LOG_END) & views.author_is(F.col("file_author"), "u7"))
    return endpoints.log_view(log).select("id", "severity")


from tidemark.plans import indexed, stored  # noqa: E402, F401  (adds its queries to these)
