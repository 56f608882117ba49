"""Scheduling and snapshots as queries: what may run, what is next, what is superseded. `now` is always given."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.views import RequestError

RETRIES, MANUAL_PRIORITY = 3, 100


def eligible(now: Column) -> Column:
    """Tasks without a live lease that wait, run, or are partial or failed and due for an automatic retry."""
    free = (F.coalesce("lease_token", F.lit("")) == "") | F.col("lease_expires_at").isNull() | (F.col("lease_expires_at") <= now)
    due = F.coalesce("automatic_retry_pending", F.lit(False)) & (F.coalesce("retry_count", F.lit(0)) < RETRIES) & (F.col("next_retry_time").isNull() | (F.col("next_retry_time") <= now))
    failed = F.coalesce(F.col("completion_status").isin("partial", "failed"), F.lit(False))
    return free & (F.col("state").isin(0, 1) | ((F.col("state") == 3) & due & failed))


def queue_order() -> list[Column]:
    """Priority, then increments before full scans, then age."""
    return [F.desc(F.coalesce("dispatch_priority", F.lit(0))), (F.col("task_type") == 3).asc(), F.asc("create_time"), F.asc("id")]


def next_task(tasks: DataFrame, now: Column) -> DataFrame:
    return tasks.where(eligible(now)).orderBy(*queue_order()).limit(1)


def preempted(running: DataFrame, waiting: DataFrame) -> DataFrame:
    """Running tasks that must give way: to a higher priority, or, as a full scan, to an increment of the same one. Only the best waiting priority of either kind is held against them."""
    p = F.coalesce("dispatch_priority", F.lit(0))
    best = waiting.agg(F.max(p).alias("any_best"), F.max(F.when(F.col("task_type") != 3, p)).alias("increment_best"))
    out = running.withColumn("one", F.lit(1)).join(F.broadcast(best.withColumn("one", F.lit(1))), "one").drop("one")
    gives = (F.col("any_best") > p) | ((F.col("task_type") == 3) & (F.col("increment_best") >= p))
    return out.where(F.coalesce(gives, F.lit(False))).drop("any_best", "increment_best")


def manual_retry(task: dict | None, failures: dict, now=None) -> dict:
    """The task as a manual retry leaves it, for the failures of its blocks (`retry_failures`' row). A retry that waits already stays
    as it is; a task that runs or is prepared, isn't partial, has nothing failed, has blocks to come, or is leased is refused."""
    if task is None:
        raise RequestError("no such task", 404)
    if task["state"] == 0 and task.get("retry_failed_only"):
        return task
    refused = {
        "the task runs or is prepared": task["state"] in (1, 4),
        "only a partial task can be retried": task["state"] != 3,
        "nothing failed": not failures.get("failed"),
        "blocks are still to come": failures.get("pending") or failures.get("running"),
        "the task is leased": task.get("lease_token"),
    }
    for why, holds in refused.items():
        if holds:
            raise RequestError(why, 409)
    changes = {"state": 0, "completion_status": "retry_pending", "retry_failed_only": True, "dispatch_priority": MANUAL_PRIORITY, "automatic_retry_pending": False, "interrupt_requested": False, "next_retry_time": None, "retry_requested_time": now, "update_time": now}
    return task | changes | {"manual_retry_count": (task.get("manual_retry_count") or 0) + 1}


def claimed(task: dict, owner: str, token: str, now, lease_seconds: int = 120) -> dict:
    """An eligible task as a worker's claim leaves it. Held against its state, revision, priority and lease token by whoever stores it."""
    running = "retry_running" if task.get("retry_failed_only") else "running"
    lease = {"lease_owner": owner, "lease_token": token, "lease_expires_at": now + dt.timedelta(seconds=max(10, lease_seconds))}
    return task | lease | {"state": 1, "completion_status": running, "heartbeat_time": now, "last_start_time": now, "automatic_retry_pending": False, "interrupt_requested": False, "update_time": now}


def superseded(snapshots: DataFrame, task_id: Column, revision: int) -> DataFrame:
    """Snapshots after a new revision of a task: open older ones are partial and frozen."""
    open_ = (F.col("task_id") == task_id) & F.col("state").isin(0, 1) & (F.col("trigger_revision") < revision)
    return snapshots.withColumns({"completion_status": F.when(open_, "superseded").otherwise(F.col("completion_status")), "state": F.when(open_, 3).otherwise(F.col("state"))})


def carried_forward(snapshots: DataFrame, task_id: Column, revision: int) -> DataFrame:
    """If a trigger changed nothing: the newest unfinished snapshot of an earlier revision gets the new one, and waits again."""
    mine = (F.col("task_id") == task_id) & F.col("state").isin(0, 1, 3) & (F.coalesce("completion_status", F.lit("")) != "superseded") & (F.col("trigger_revision") < revision)
    newest = snapshots.where(mine).agg(F.max("trigger_revision").alias("r"), F.lit(1).alias("one"))
    out = snapshots.withColumn("one", F.lit(1)).join(F.broadcast(newest), "one", "left").drop("one")
    this = F.coalesce(mine & (F.col("trigger_revision") == F.col("r")), F.lit(False))
    changes = {"state": F.lit(0), "completion_status": F.lit("pending"), "trigger_revision": F.lit(revision)}
    return out.withColumns({c: F.when(this, v).otherwise(F.col(c)) for c, v in changes.items()}).drop("r")


def latest_comparison(tasks: DataFrame, project: str, comparison: str) -> DataFrame:
    """The newest task of a comparison `review_vs_base`, split at the last `_vs_`."""
    review, _, base = comparison.rpartition("_vs_")
    if not review:
        raise RequestError("no such comparison", 404)
    return tasks.where((F.col("project_id") == project) & (F.col("review_version") == review) & (F.col("copy_from_version") == base)).orderBy(F.desc("create_time"), F.desc("id")).limit(1)


def triggered(task: dict | None, identity: dict, changed: bool, now) -> dict:
    """The task after a trigger: a new one waits; one whose files changed waits again at the next revision; an unchanged one stays completed if it was, else waits."""
    if task is None:
        return identity | {"state": 0, "trigger_count": 1, "trigger_revision": 1, "create_time": now, "update_time": now}
    state = 2 if task["state"] == 2 and not changed else 0
    return task | {"state": state, "trigger_count": task.get("trigger_count", 0) + 1, "trigger_revision": task.get("trigger_revision", 0) + 1, "update_time": now}


def interrupted(task: dict, owner: str, revision: int) -> dict:
    """The task after its worker stopped: its lease goes if the worker still held it; at the same revision it waits."""
    out = dict(task)
    if task.get("lease_owner") == owner:
        out |= {"lease_owner": "", "lease_token": "", "lease_expires_at": None}
        if task.get("trigger_revision") == revision:
            out |= {"state": 0, "completion_status": "interrupted"}
    return out
