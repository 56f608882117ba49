"""A trigger as one dataflow: target files and stored tables to files, blocks, snapshot and task, committed together.

Stored tables (`Versions`), flat, keyed by what a merge replaces: `project` (project_id), `task` (submission_key), `file` (id), `block` (file_id: all of
a file's blocks go together) and `snapshot` (snapshot_id), `snapshot_file` (snapshot_id), `snapshot_block` (snapshot_id). Files whose source is as
stored and whose blocks are all done aren't read again: their blocks stay where they are.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from tidemark.operators.control import carried_forward, superseded
from tidemark.operators.diffs import BLOCK_TOKENS, block_hash, rematched_refs, split_blocks
from tidemark.operators.report import SCORES
from tidemark.operators.rollup import submission_key as key_of
from tidemark.shared import kept
from tidemark.sources.views import RequestError
from tidemark.versions import Versions

FULL_BASE, PENDING, RUNNING, COMPLETED, PREPARING = "0_version", 0, 1, 2, 4
COUNTS = ("comment_line_number", "process_time", "llm_prompt_tokens", "llm_completion_tokens", "llm_total_tokens", "llm_reasoning_tokens", "llm_cached_tokens", "llm_elapsed_ms", "memory_compression_count", "main_task_round_count", "review_attempt_count")
WORDS = ("review_fingerprint", "comment", "plan_change_summary", "plan_risk_level", "main_task_completion_mode", "failure_message")
#: What a review leaves on a block; a changed block begins with none of it.
RESULTS = {**dict.fromkeys(SCORES, "int"), **dict.fromkeys(COUNTS, "bigint"), **dict.fromkeys(WORDS, "string"), "main_task_completed": "boolean"}
BLOCK = "file_id string, block_id int, block_hash string, contents array<string>, review_state int, " + ", ".join(f"{k} {v}" for k, v in RESULTS.items()) + ", issues array<struct<issue_id:int, severity:int, feedback_type:string, feedback_content:string, description:string>>"
FILE = "id string, task_id string, file_name string, language string, change_type string, old_file_name string, source_hash string, review_fingerprint string, state int, status string, trigger_revision int, code_line_num bigint, add_code_line_num bigint, comment_line_number bigint, file_author string, " + ", ".join(f"{s} int" for s in SCORES)
TASK = "submission_key string, project_id string, review_version string, copy_from_version string, task_type int, state int, completion_status string, trigger_count int, trigger_revision int, submitter string, interrupt_requested boolean, dispatch_priority int, retry_failed_only boolean, automatic_retry_pending boolean, next_retry_time timestamp, lease_owner string, lease_token string, lease_expires_at timestamp, heartbeat_time timestamp, file_num bigint, reviewed_file_num bigint, resumed_file_num bigint, skipped_file_num bigint, incomplete_file_num bigint, code_block_num bigint, add_code_line_num bigint, comment_line_number bigint, latest_snapshot_id string, score int, " + ", ".join(f"{s} int" for s in SCORES) + ", project_summary string, create_time timestamp, update_time timestamp"
SNAPSHOT = "snapshot_id string, task_id string, trigger_count int, trigger_revision int, state int, completion_status string, task_type int, llm_total_tokens_baseline bigint, create_time timestamp, update_time timestamp"
SNAPSHOT_FILE = "snapshot_id string, place bigint, file_name string, file_id string, kind string"
SNAPSHOT_BLOCK = "snapshot_id string, file_id string, file_name string, block_id int, block_hash string"
TABLES = {"task": (TASK, "submission_key"), "file": (FILE, "id"), "block": (BLOCK, "file_id"), "project": ("project_id string, scan_round int, update_time timestamp", "project_id"), "snapshot": (SNAPSHOT, "snapshot_id"), "snapshot_file": (SNAPSHOT_FILE, "snapshot_id"), "snapshot_block": (SNAPSHOT_BLOCK, "snapshot_id")}
KEYS = {name: key for name, (_, key) in TABLES.items()}


def done(block_fields=F.col) -> Column:
    """A block whose review came to its end without a failure."""
    return F.coalesce(block_fields("main_task_completed"), F.lit(False)) & (F.coalesce(block_fields("failure_message"), F.lit("")) == "")


def pending_results() -> dict[str, Column]:
    zero = {"int": 0, "bigint": 0, "string": "", "boolean": False}
    return {k: F.lit(zero[v]).cast(v) for k, v in RESULTS.items()}


def source_hash() -> Column:
    """The digest of a target's name, language, whole text and diff lines."""
    return F.md5(F.array_join(F.concat(F.array("file_name", "language", "full_code"), "diff_lines"), "\n").cast("binary"))


def file_id(task_id: Column) -> Column:
    return F.md5(F.concat(task_id, F.lit("\n"), F.col("file_name")).cast("binary"))


@dataclass(frozen=True)
class Synchronised:
    """files: all of the task's files as they are now; blocks: those of files that were read again; kinds: file_name and kind (added, changed, reused, removed);
    refs: changed blocks (file_id, file_name, block_id, block_hash); settled: ids of files whose blocks stay; removed: ids of files that went."""

    files: DataFrame
    blocks: DataFrame
    kinds: DataFrame
    refs: DataFrame
    settled: DataFrame
    removed: DataFrame


def synchronised(task_id: Column, revision: int, targets: DataFrame, files: DataFrame, blocks: DataFrame, authors: DataFrame | None = None, limit: int = BLOCK_TOKENS) -> Synchronised:
    """What targets (file_name, language, change_type, old_file_name, full_code, diff_lines, code_line_num, add_code_line_num) make of a task's stored files and blocks.

    The k-th new block of a hash in a file takes over the k-th old one of it, finished ones first; those beyond as many as there were are changed.
    authors: file_name and file_author; without it authors stay, with it a file that isn't named there has none.
    """
    targets = targets.withColumns({"new_hash": source_hash(), "id": file_id(task_id)})
    old_files = files.select("id", F.col("source_hash").alias("old_hash"), F.col("file_author").alias("old_author"), F.col("review_fingerprint").alias("old_fingerprint"))
    # blocks stay where the source is as it was and all of them are done
    state = blocks.groupBy("file_id").agg(F.bool_and(done() & (F.col("review_state") == COMPLETED)).alias("settled"))
    old = old_files.join(state.withColumnRenamed("file_id", "id"), "id", "left")
    t = targets.join(old, "id", "left")
    stays = F.coalesce((F.col("old_hash") == F.col("new_hash")) & F.col("settled"), F.lit(False))
    settled = t.where(stays).select("id")

    fresh = t.where(~stays).select("id", "file_name", F.posexplode(split_blocks(F.col("diff_lines"), limit)).alias("block_id", "contents"))
    fresh = fresh.select(F.col("id").alias("file_id"), "file_name", "block_id", "contents", block_hash(F.col("contents")).alias("block_hash"))
    fresh = kept(fresh)  # it is split once, and read for blocks, references and files
    mine = blocks.join(t.where(~stays).select(F.col("id").alias("file_id")), "file_id", "left_semi")
    key = ["file_id", "block_hash"]
    hashed = mine.where(F.coalesce("block_hash", F.lit("")) != "")
    old_k = hashed.withColumns({"k": F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(done()), "block_id")), "was_done": done()})
    new_k = fresh.withColumn("k", F.row_number().over(Window.partitionBy(*key).orderBy("block_id")))
    taken = new_k.join(old_k.select(*key, "k", "was_done", F.col("contents").alias("old_contents"), *RESULTS, "issues"), [*key, "k"], "left")
    found = F.col("was_done").isNotNull()
    blank = pending_results()
    new_blocks = taken.select(
        "file_id", "block_id", "block_hash",
        F.when(F.coalesce("was_done", F.lit(False)), F.col("old_contents")).otherwise(F.col("contents")).alias("contents"),
        F.when(F.coalesce("was_done", F.lit(False)), COMPLETED).otherwise(PENDING).alias("review_state"),
        *(F.when(found, F.col(k)).otherwise(v).alias(k) for k, v in blank.items()),
        F.when(found, F.col("issues")).otherwise(F.array().cast(dict(blocks.dtypes)["issues"])).alias("issues"),
    )

    had = mine.withColumn("block_hash", F.when(F.coalesce("block_hash", F.lit("")) != "", F.col("block_hash")).otherwise(block_hash(F.col("contents")))).groupBy(*key).agg(F.count("*").alias("had"))
    refs = new_k.join(had, key, "left").where(F.col("k") > F.coalesce("had", F.lit(0))).select("file_id", "file_name", "block_id", "block_hash")
    touched = refs.select(F.col("file_id").alias("id")).distinct().withColumn("touched", F.lit(True))
    kind = F.when(F.col("known").isNull(), "added").when(F.col("touched"), "changed").otherwise("reused")
    known = files.select("id", F.lit(True).alias("known"))
    kinds = targets.select("id", "file_name").join(known, "id", "left").join(touched, "id", "left").select("file_name", kind.alias("kind"))
    gone = files.join(targets.select("id"), "id", "left_anti")
    kinds = kinds.unionByName(gone.select("file_name", F.lit("removed").alias("kind")))

    every = new_blocks.unionByName(blocks.join(settled.select(F.col("id").alias("file_id")), "file_id", "left_semi").select(*new_blocks.columns))
    of_done = lambda s: F.coalesce(F.bround(F.avg(F.when(done(), F.col(s))), 0), F.lit(0)).cast("int").alias(s)
    sums = every.groupBy(F.col("file_id").alias("id")).agg(F.bool_and(done()).alias("complete"), F.sum(F.coalesce("comment_line_number", F.lit(0))).alias("comment_line_number"), *map(of_done, SCORES))
    out = t.join(sums, "id", "left")
    if authors is not None:
        out = out.join(authors.groupBy("file_name").agg(F.max("file_author").alias("named")), "file_name", "left")
    author = F.coalesce("old_author", F.lit("")) if authors is None else F.coalesce("named", F.lit(""))
    complete = F.coalesce("complete", F.lit(False))
    changed = (F.coalesce("old_hash", F.lit("")) != "") & (F.col("old_hash") != F.col("new_hash"))
    new_files = out.select(
        "id", task_id.alias("task_id"), "file_name", "language", "change_type", "old_file_name", F.col("new_hash").alias("source_hash"),
        F.when(changed, "").otherwise(F.coalesce("old_fingerprint", F.lit(""))).alias("review_fingerprint"),
        F.when(complete, COMPLETED).otherwise(PENDING).alias("state"), F.when(complete, "reviewed").otherwise("pending").alias("status"), F.lit(revision).alias("trigger_revision"),
        F.col("code_line_num").cast("bigint").alias("code_line_num"), F.col("add_code_line_num").cast("bigint").alias("add_code_line_num"), F.coalesce("comment_line_number", F.lit(0)).cast("bigint").alias("comment_line_number"),
        author.alias("file_author"), *(F.coalesce(s, F.lit(0)).alias(s) for s in SCORES),
    )
    return Synchronised(new_files, new_blocks, kinds, refs, settled, gone.select("id"))


def _stored(store: Versions, name: str, version: int) -> DataFrame:
    return store.read(name, version) if name in store.names(version) else store.spark.createDataFrame([], TABLES[name][0])


def _one(store: Versions, name: str, values: dict) -> DataFrame:
    """A row of a table; fields that values lack are null."""
    schema = store.spark.createDataFrame([], TABLES[name][0]).schema
    return store.spark.createDataFrame([tuple(values.get(f.name) for f in schema)], schema)


def submission_key(store: Versions, project: str, review: str, base: str) -> str:
    return store.spark.range(1).select(key_of(F.lit(project), F.lit(review), F.lit(base))).first()[0]


def trigger(store: Versions, project: str, review: str, base: str, task_type: int | None, targets: DataFrame, now: dt.datetime, authors: DataFrame | None = None, submitter: str | None = None, limit: int = BLOCK_TOKENS) -> Row:
    """A submission: the task's files are synchronised with targets, and files, blocks, snapshot, project and task are committed under one version. The task as it is then.

    Another writer in between refuses it with 409, and nothing changes.
    """
    project, review, base = project.strip(), review.strip(), base.strip() or FULL_BASE
    kind = 3 if base in ("0", FULL_BASE) else task_type if task_type in (1, 2) else 1
    read, key = store.latest(), submission_key(store, project, review, base)
    task = _stored(store, "task", read).where(F.col("submission_key") == key).first()
    created = task is None
    was = {} if created else task.asDict()
    count, revision = (1, 1) if created else ((was["trigger_count"] or 1) + 1, (was["trigger_revision"] or 1) + 1)
    files = _stored(store, "file", read).where(F.col("task_id") == key)
    blocks = _stored(store, "block", read).join(files.select(F.col("id").alias("file_id")), "file_id", "left_semi")
    made = synchronised(F.lit(key), revision, targets, files, blocks, authors, limit)

    # of blocks, those of files that went or were read again, which may have none now
    unsettled = files.select("id").join(made.settled, "id", "left_anti").select(F.col("id").alias("file_id"))
    writes, gone = {"file": made.files, "block": made.blocks}, {"file": made.removed, "block": unsettled}
    n = made.kinds.groupBy("kind").count().collect()
    n = {r.kind: r["count"] for r in n}
    snapshots = _stored(store, "snapshot", read)
    latest = was.get("latest_snapshot_id")
    if not created and (n.get("added", 0) + n.get("changed", 0) + n.get("removed", 0)):
        latest = now.strftime("%Y%m%d%H%M%S%f")
        row = {"snapshot_id": latest, "task_id": key, "trigger_count": count, "trigger_revision": revision, "state": 0, "completion_status": "pending", "task_type": kind, "create_time": now, "update_time": now}
        tokens = blocks.agg(F.coalesce(F.sum("llm_total_tokens"), F.lit(0))).first()[0]
        mine = superseded(snapshots.where(F.col("task_id") == key), F.lit(key), revision)
        writes["snapshot"] = mine.select(*snapshots.columns).unionByName(_one(store, "snapshot", row | {"llm_total_tokens_baseline": tokens}))
        order = Window.partitionBy("kind").orderBy("file_name")
        listed = made.kinds.where("kind <> 'reused'").withColumn("kind", F.when(F.col("kind") == "removed", "removed").otherwise("changed"))
        listed = listed.withColumns({"snapshot_id": F.lit(latest), "place": F.row_number().over(order).cast("bigint"), "file_id": F.when(F.col("kind") == "changed", file_id(F.lit(key)))})
        writes["snapshot_file"] = listed.select("snapshot_id", "place", "file_name", "file_id", "kind")
        writes["snapshot_block"] = made.refs.select(F.lit(latest).alias("snapshot_id"), "file_id", "file_name", "block_id", "block_hash")
    elif not created:
        writes["snapshot"] = carried_forward(snapshots.where(F.col("task_id") == key), F.lit(key), revision).select(*snapshots.columns)

    total = made.files.agg(F.count("*").alias("n"), F.count_if(F.col("state") == COMPLETED).alias("done"), F.coalesce(F.sum("add_code_line_num"), F.lit(0)).alias("added"), F.coalesce(F.sum("comment_line_number"), F.lit(0)).alias("comments")).first()
    settled = blocks.join(made.settled.select(F.col("id").alias("file_id")), "file_id", "left_semi").count()
    finalise = not created and total.n == total.done and (was["state"] != COMPLETED or n.get("removed", 0) > 0)
    waits = total.n > total.done or finalise
    leased = not created and was["state"] == RUNNING and was["lease_token"] and was["lease_expires_at"] and was["lease_expires_at"] > now
    after = {**was, "submission_key": key, "project_id": project, "review_version": review, "copy_from_version": base, "task_type": kind, "trigger_count": count, "trigger_revision": revision}
    after |= {"state": PENDING if waits else COMPLETED, "completion_status": "pending" if waits else "completed", "interrupt_requested": False, "dispatch_priority": 0, "retry_failed_only": False, "automatic_retry_pending": False, "next_retry_time": None}
    after |= {"file_num": total.n, "reviewed_file_num": total.done, "resumed_file_num": total.done, "skipped_file_num": 0, "incomplete_file_num": 0, "code_block_num": settled + made.blocks.count(), "add_code_line_num": total.added, "comment_line_number": total.comments}
    after |= {"latest_snapshot_id": latest, "submitter": submitter or was.get("submitter"), "create_time": was.get("create_time") or now, "update_time": now}
    if waits:
        after |= {"score": 0, "project_summary": "", **dict.fromkeys(SCORES, 0)}
    if not leased:
        after |= {"lease_owner": "", "lease_token": "", "lease_expires_at": None, "heartbeat_time": None}
    writes["task"] = _one(store, "task", after)
    rounds = _stored(store, "project", read).where(F.col("project_id") == project).first()
    writes["project"] = _one(store, "project", {"project_id": project, "scan_round": (rounds.scan_round if rounds else 0) + 1, "update_time": now})
    store.commit(read, merge=writes, remove=gone, keys=KEYS)
    return store.read("task").where(F.col("submission_key") == key).first()


def checkpoint(store: Versions, snapshot_id: str, version: int | None = None) -> DataFrame:
    """file_id, file_name and the blocks of a snapshot's files as the task has them now: those whose ids and hashes it noted, else, k-th to k-th, others of those hashes."""
    version = store.latest() if version is None else version
    refs = _stored(store, "snapshot_block", version).where(F.col("snapshot_id") == snapshot_id)
    blocks = _stored(store, "block", version).join(refs.select("file_id").distinct(), "file_id", "left_semi")
    found = rematched_refs(refs.select(F.col("file_id").alias("path"), "block_id", "block_hash"), blocks.select(F.col("file_id").alias("path"), "block_id", "block_hash"))
    picked = blocks.join(found.select(F.col("path").alias("file_id"), F.col("found_id").alias("block_id")), ["file_id", "block_id"])
    return picked.join(refs.select("file_id", "file_name").distinct(), "file_id")


def saved_feedback(store: Versions, file: str, block_id: int, issue_id: int, kind: str, reason: str = "", now: dt.datetime | None = None) -> Row:
    """Feedback on an issue: the embedded issue changes and the log gets its row, under one version. The log's row.

    404 without such a file, block or issue, 422 for a rejection without a reason, 409 if another writer came first.
    """
    reason = (reason or "").strip()
    if kind not in ("agree", "reject") or (kind == "reject" and not reason):
        raise RequestError("agree, or reject with a reason")
    reason = reason[:4000] if kind == "reject" else ""
    read = store.latest()
    owner = _stored(store, "file", read).where(F.col("id") == file).first()
    if owner is None:
        raise RequestError("no such file", 404)
    blocks = _stored(store, "block", read).where(F.col("file_id") == file)
    issues = blocks.where(F.col("block_id") == block_id).select(F.filter("issues", lambda i: i["issue_id"] == issue_id).alias("i")).first()
    if issues is None or not issues.i:
        raise RequestError("no such block" if issues is None else "no such issue", 404)
    # of equal ids the first one
    at = F.array_position(F.transform("issues", lambda i: i["issue_id"]), F.lit(issue_id)) - 1
    said = F.transform("issues", lambda i, n: F.when(n == at, i.withField("feedback_type", F.lit(kind)).withField("feedback_content", F.lit(reason))).otherwise(i))
    changed = blocks.withColumn("issues", F.when(F.col("block_id") == block_id, said).otherwise(F.col("issues")))
    task = _stored(store, "task", read).where(F.col("submission_key") == owner.task_id).first()
    issue = issues.i[0]
    log = "task_id string, project_id string, review_version string, copy_from_version string, task_type int, file_name string, file_author string, severity int, description string, feedback_type string, feedback_content string, create_time timestamp"
    of_task = (task.project_id, task.review_version, task.copy_from_version, task.task_type) if task else ("", "", "", None)
    row = store.spark.createDataFrame([(owner.task_id, *of_task, owner.file_name, owner.file_author or "", issue.severity or 0, issue.description or "", kind, reason, now or dt.datetime.now(dt.timezone.utc))], log)
    store.commit(read, merge={"block": changed}, append={"feedback_log": row})
    return row.first()


def migrated(store: Versions) -> dict[str, int]:
    """Tasks without a base, and their files and snapshots, are full scans: how many of each weren't, after one version has them all made right. A second run changes none."""
    read = store.latest()
    tasks, snapshots = (_stored(store, n, read) for n in ("task", "snapshot"))
    full = tasks.where(F.col("copy_from_version") == FULL_BASE)
    wrong = {"task": full.where(F.coalesce("task_type", F.lit(0)) != 3), "snapshot": snapshots.where(F.coalesce("task_type", F.lit(0)) != 3).join(full.select(F.col("submission_key").alias("task_id")), "task_id", "left_semi").select(*snapshots.columns)}
    counts = {k: df.count() for k, df in wrong.items()}
    changed = {k: df.withColumn("task_type", F.lit(3)) for k, df in wrong.items() if counts[k]}
    if changed:
        store.commit(read, merge=changed)
    return counts
