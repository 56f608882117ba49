"""The driver's tables in the engine's roles, for Spark and, as common table expressions, for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: In SQL that both engines read. Prefix a query with WITH and the ones it needs, in this order.
TASK = """task AS (SELECT CAST(o_orderkey AS STRING) AS id, CAST(o_custkey AS STRING) AS project_id, concat('v', CAST(o_orderkey % 7 AS STRING)) AS review_version,
 CASE WHEN o_orderkey % 11 = 0 THEN '0_version' ELSE 'master' END AS copy_from_version, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS task_type,
 CAST(o_orderkey % 5 AS INT) AS state, CAST(o_orderkey % 101 AS INT) AS score, o_orderdate AS create_time, CAST(floor(o_totalprice / 3) AS BIGINT) AS llm_prompt_tokens,
 CAST(floor(o_totalprice / 5) AS BIGINT) AS llm_completion_tokens, CASE WHEN o_orderkey % 4 = 0 THEN CAST(0 AS BIGINT) ELSE CAST(floor(o_totalprice / 2) AS BIGINT) END AS llm_total_tokens,
 CAST(o_orderkey % 1000 AS BIGINT) AS llm_elapsed_ms, 5 - CAST(substring(o_orderpriority, 1, 1) AS INT) AS dispatch_priority, CAST(o_orderkey % 6 AS INT) AS retry_count,
 o_orderkey % 3 = 0 AS automatic_retry_pending FROM orders)"""
ISSUE = """issue AS (SELECT CAST(l_orderkey AS STRING) AS task_id, concat('src/f', CAST(l_partkey AS STRING), '.c') AS file_name,
 CASE WHEN l_suppkey % 10 = 0 THEN ' ' ELSE concat(CASE WHEN l_suppkey % 3 = 0 THEN ' ' ELSE '' END, 's', CAST(l_suppkey AS STRING)) END AS file_author,
 CAST(l_linenumber AS INT) AS severity, CASE l_returnflag WHEN 'A' THEN 'agree' WHEN 'R' THEN 'reject' ELSE '' END AS feedback_type,
 CASE WHEN l_linestatus = 'F' AND l_suppkey % 2 = 0 THEN 'FILTERED' WHEN l_linestatus = 'F' THEN 'kept' END AS filter_status, CAST(l_quantity AS INT) AS line_no,
 CAST(l_partkey % 40 AS INT) AS block_id FROM lineitem)"""
LOG = """log AS (SELECT CAST(event_id AS STRING) AS id, concat('p', CAST(user_id % 20 AS STRING)) AS project_id, concat('v', CAST(user_id % 3 AS STRING)) AS review_version, 'master' AS copy_from_version,
 CASE WHEN user_id % 9 = 0 THEN '' ELSE concat('u', CAST(user_id AS STRING)) END AS file_author, CAST(1 + floor(value) % 5 AS INT) AS severity,
 CASE event_type WHEN 'purchase' THEN 'agree' WHEN 'error' THEN 'reject' ELSE event_type END AS feedback_type, ts AS create_time FROM events)"""
TREE = """tree AS (SELECT concat(source, '/', lang, '/d', CAST(doc_id % 200 AS STRING), CASE WHEN doc_id % 3 = 0 THEN '.c' WHEN doc_id % 3 = 1 THEN '.py' ELSE '.txt' END) AS path, doc_id, text,
 md5(text) AS md5 FROM documents)"""
ROLES = {"task": TASK, "issue": ISSUE, "log": LOG, "tree": TREE}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def role(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A role's DataFrame; its table is scanned with the columns that the plan needs alone."""
    source = ROLES[name].rstrip(")").rsplit("FROM ", 1)[1].strip()
    body = ROLES[name].split(" AS (", 1)[1].rsplit(")", 1)[0]
    return spark.sql(body.replace(f"FROM {source}", "FROM {t}"), t=spark.read.parquet(f"{sf_dir}/{source}.parquet"))


def sql(body: str, *roles: str) -> str:
    """The same roles before a DuckDB query."""
    ctes = ", ".join(ROLES[r] for r in roles)
    if not roles:
        return body
    return f"WITH {ctes}, {body.split('WITH ', 1)[1]}" if body.lstrip().startswith("WITH ") else f"WITH {ctes} {body}"


def nested_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues folded into files with blocks, as they are stored: a task is a file here, so nothing outgrows a row."""
    i = role(spark, sf_dir, "issue")
    block = F.struct(F.col("block_id"), F.col("issues"), (F.col("block_id") % 3 != 0).alias("main_task_completed"), F.when(F.col("block_id") % 13 == 0, "boom").otherwise("").alias("failure_message"), (F.col("block_id") % 4).alias("review_state"))
    blocks = i.groupBy("task_id", "block_id").agg(F.collect_list(F.struct("severity", "feedback_type", "filter_status", "line_no")).alias("issues"))
    return blocks.groupBy("task_id").agg(F.collect_list(block).alias("code_blocks")).withColumns({"file_name": F.concat(F.lit("t"), "task_id"), "state": (F.col("task_id").cast("int") % 4), "status": F.when(F.col("task_id").cast("int") % 17 == 0, "reviewed").when(F.col("task_id").cast("int") % 19 == 0, "skipped_budget").otherwise("")})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
