"""Queries over what is written and read back: versioned tables, the log's sink, triggers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import diffs, submission
from tidemark.plans.catalog import LOG_COUNTERS, LOG_RATES, query
from tidemark.plans.proxy import role, table
from tidemark.shared import scratch
from tidemark.streaming import feedback as stream
from tidemark.versions import Versions


@query(f"SELECT *, {LOG_RATES} FROM (SELECT project_id, review_version, copy_from_version, {LOG_COUNTERS}, min(create_time) AS first_seen FROM log GROUP BY ALL)", "log")
def log_stored_by_version(spark, d):
    """The log in three drops that overlap, through the sink: each row is stored and counted once."""
    log, at = role(spark, d, "log"), scratch(spark)
    n = F.col("id").cast("long") % 3
    for drop in (n != 0, n != 1, n == 1):
        log.where(drop).write.mode("append").parquet(f"{at}/drops")
    store = Versions(spark, f"{at}/store")
    schema = ", ".join(f"{c} {t}" for c, t in log.dtypes)
    stream.drain(stream.log_stream(spark, f"{at}/drops", schema), store, f"{at}/checkpoint")
    return stream.stored_by_version(store)


@query(
    """WITH v1 AS (SELECT o_orderkey, o_orderstatus, (o_custkey % 10)::INT AS o_shippriority, o_totalprice FROM orders),
 v2 AS (SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderstatus = 'F' THEN o_shippriority + 2 ELSE o_shippriority END AS o_shippriority, o_totalprice FROM v1),
 v3 AS (SELECT * FROM v2 WHERE o_orderkey % 7 <> 0 AND o_orderkey % 9 <> 0 UNION ALL SELECT o_orderkey, 'X', 5, o_totalprice FROM v1 WHERE o_orderkey % 9 = 0),
 every AS (SELECT 1 AS version, * FROM v1 UNION ALL SELECT 2, * FROM v2 UNION ALL SELECT 3, * FROM v3)
 SELECT version, o_orderstatus, count(*) AS n, sum(o_shippriority)::BIGINT AS priorities, sum(o_orderkey)::BIGINT AS ids, (SELECT count(*) FROM orders WHERE o_orderkey % 9 = 0) * (version = 3)::INT AS logged FROM every GROUP BY ALL"""
)
def versioned_orders(spark, d):
    """Three versions of a table: put, updated where a condition holds, and merged with rows that are replaced and removed, while a log is appended to under the same version."""
    store = Versions(spark, scratch(spark))
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", (F.col("o_custkey") % 10).cast("int").alias("o_shippriority"), "o_totalprice")
    store.commit(0, put={"orders": orders}, keys={"orders": "o_orderkey"})
    store.update("orders", F.col("o_orderstatus") == "F", {"o_shippriority": F.col("o_shippriority") + 2})
    new = orders.where(F.col("o_orderkey") % 9 == 0).withColumns({"o_orderstatus": F.lit("X"), "o_shippriority": F.lit(5)})
    store.commit(2, merge={"orders": new}, remove={"orders": orders.where(F.col("o_orderkey") % 7 == 0).select("o_orderkey")}, append={"log": new.select("o_orderkey")})
    logged = store.read("log").count()
    every = [store.read("orders", v).withColumns({"version": F.lit(v), "logged": F.lit(logged if v == 3 else 0).cast("long")}) for v in (1, 2, 3)]
    out = every[0].unionByName(every[1]).unionByName(every[2])
    return out.groupBy("version", "o_orderstatus", "logged").agg(F.count("*").alias("n"), F.sum("o_shippriority").alias("priorities"), F.sum("o_orderkey").alias("ids"))


# --- a trigger: the documents as a tree, stored as it was, and as it is now: every 7th has a new last line, every 11th is new, every 13th is gone

NEW_TEXT = "CASE WHEN doc_id % 7 = 0 THEN text || chr(10) || 'new line' ELSE text END"
SYNC = f"""WITH RECURSIVE sides AS (SELECT 'o' AS side, doc_id, text AS t FROM documents WHERE text <> '' AND doc_id % 11 <> 0 UNION ALL SELECT 'n', doc_id, {NEW_TEXT} FROM documents WHERE text <> '' AND doc_id % 13 <> 0),
 a AS (SELECT side, doc_id, x[1:len(x) - (x[-1] = '')::INT] AS x FROM (SELECT side, doc_id, string_split(t, chr(10)) AS x FROM sides)),
 lines AS (SELECT side, doc_id, generate_subscripts(x, 1) AS pos, unnest(x) AS code FROM a), f AS (SELECT side, doc_id, pos, lpad(pos::VARCHAR, greatest(6, length(pos::VARCHAR))::INT, ' ') || '+  ' || code AS line FROM lines),
 c AS (SELECT *, greatest(1, length(line) // 4) AS t FROM f),
 fold AS (SELECT side, doc_id, pos, line, t AS used, 0 AS block FROM c WHERE pos = 1 UNION ALL SELECT c.side, c.doc_id, c.pos, c.line, CASE WHEN f.used + c.t > 300 THEN c.t ELSE f.used + c.t END, CASE WHEN f.used + c.t > 300 THEN f.block + 1 ELSE f.block END FROM fold f JOIN c ON c.side = f.side AND c.doc_id = f.doc_id AND c.pos = f.pos + 1),
 b AS (SELECT side, doc_id, block, md5(string_agg(line, chr(10) ORDER BY pos)) AS h FROM fold GROUP BY ALL),
 o AS (SELECT *, (block + doc_id) % 3 <> 0 AS done, row_number() OVER (PARTITION BY doc_id, h ORDER BY ((block + doc_id) % 3 <> 0) DESC, block) AS k FROM b WHERE side = 'o'),
 n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, h ORDER BY block) AS k FROM b WHERE side = 'n'),
 m AS (SELECT n.doc_id, n.block, n.h, coalesce(o.done, false) AS taken, o.k IS NOT NULL AS had, o.block AS old_block FROM n LEFT JOIN o USING (doc_id, h, k)),"""


def sync(spark, d):
    docs = table(spark, d, "documents").where("text <> ''").withColumn("file_name", F.col("doc_id").cast("string"))
    i = F.col("doc_id")

    def targets(df):
        tree = df.select(F.col("file_name").alias("path"), F.lit("C").alias("language"), "text")
        t = diffs.full_scan(tree, F.col("text").alias("full_code"))
        return t.select(F.col("path").alias("file_name"), "language", "change_type", F.lit("").alias("old_file_name"), "full_code", "diff_lines", F.col("line_count").alias("code_line_num"), F.col("added_count").alias("add_code_line_num"))

    new = targets(docs.where(i % 13 != 0).withColumn("text", F.when(i % 7 == 0, F.concat("text", F.lit("\nnew line"))).otherwise(F.col("text"))))
    key, none = F.lit("t"), spark.createDataFrame
    first = submission.synchronised(key, 1, targets(docs.where(i % 11 != 0)), none([], submission.FILE), none([], submission.BLOCK), limit=300)
    number = first.files.select(F.col("id").alias("file_id"), F.col("file_name").cast("long").alias("n"))
    done = (F.col("block_id") + F.col("n")) % 3 != 0
    blocks = first.blocks.join(number, "file_id").withColumns({"main_task_completed": done, "review_state": F.when(done, 2).otherwise(0), "logic_score": F.when(done, F.col("block_id") * 7 % 101).otherwise(0).cast("int")}).drop("n")
    authors = docs.where(i % 5 == 0).select("file_name", F.col("lang").alias("file_author"))
    return submission.synchronised(key, 2, new, first.files, blocks, authors, 300)


@query(f"{SYNC} g AS (SELECT doc_id, count(*) AS blocks, count(*) FILTER (taken) AS taken, count(*) FILTER (NOT had) AS changed FROM m GROUP BY doc_id) SELECT coalesce(g.doc_id, p.doc_id)::VARCHAR AS file_name, CASE WHEN g.doc_id IS NULL THEN 'removed' WHEN p.doc_id IS NULL THEN 'added' WHEN changed > 0 THEN 'changed' ELSE 'reused' END AS kind, CASE WHEN g.doc_id IS NULL THEN NULL WHEN taken = blocks THEN 2 ELSE 0 END AS state, coalesce(changed, 0) AS changed_blocks FROM g FULL JOIN (SELECT DISTINCT doc_id FROM o) p USING (doc_id)")
def trigger_files(spark, d):
    made = sync(spark, d)
    n = made.refs.groupBy("file_name").agg(F.count("*").alias("changed_blocks"))
    out = made.kinds.join(made.files.select("file_name", "state"), "file_name", "left").join(n, "file_name", "left")
    return out.select("file_name", "kind", "state", F.coalesce("changed_blocks", F.lit(0)).alias("changed_blocks"))


@query(f"{SYNC} q AS (SELECT doc_id, bool_and(coalesce(taken, false)) AND count(*) = max(old_n) AND bool_and(block = old_block) AS stays FROM m JOIN (SELECT doc_id, count(*) AS old_n FROM o GROUP BY doc_id) USING (doc_id) GROUP BY doc_id) SELECT doc_id::VARCHAR AS file_name, block AS block_id, h AS block_hash, CASE WHEN taken THEN 2 ELSE 0 END AS review_state, CASE WHEN taken THEN old_block * 7 % 101 ELSE 0 END AS logic_score FROM m WHERE doc_id NOT IN (SELECT doc_id FROM q WHERE stays)")
def trigger_blocks(spark, d):
    """Blocks of files that had to be read again: those that take over a finished one keep its result."""
    made = sync(spark, d)
    names = made.files.select(F.col("id").alias("file_id"), "file_name")
    return made.blocks.join(names, "file_id").select("file_name", "block_id", "block_hash", "review_state", "logic_score")


@query(f"{SYNC} g AS (SELECT doc_id, count(*) AS blocks, count(*) FILTER (taken) AS done, round_even(avg(old_block * 7 % 101) FILTER (taken), 0) AS score FROM m GROUP BY doc_id) SELECT g.doc_id::VARCHAR AS file_name, CASE WHEN doc_id % 5 = 0 THEN lang ELSE '' END AS file_author, coalesce(score, 0)::INT AS logic_score, CASE WHEN done = blocks THEN 'reviewed' ELSE 'pending' END AS status, 2 AS trigger_revision FROM g JOIN documents USING (doc_id)")
def trigger_file_fields(spark, d):
    return sync(spark, d).files.select("file_name", "file_author", "logic_score", "status", "trigger_revision")
