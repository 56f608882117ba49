"""Status of blocks, files and tasks. The variants differ on purpose and share no builder."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def reportable(filter_status: Column) -> Column:
    return F.lower(F.coalesce(filter_status, F.lit(""))) != "filtered"


def _failed(b: Column) -> Column:
    return (F.coalesce(b["failure_message"], F.lit("")) != "") | (F.coalesce(b["review_state"], F.lit(0)) == 3)


def _done(b: Column) -> Column:
    return F.coalesce(b["main_task_completed"], F.lit(False)) | (F.coalesce(b["review_state"], F.lit(0)) == 2)


def _file_done(state: Column, status: Column) -> Column:
    return (F.coalesce(state, F.lit(0)) == 2) | F.coalesce(status, F.lit("")).isin("reviewed", "resumed")


def block_in_report(b: Column, state: Column, status: Column) -> Column:
    return F.when(_failed(b), "failed").when(_done(b) | _file_done(state, status), "completed").when(b["review_state"] == 1, "reviewing").otherwise("pending")


def block_in_dashboard(b: Column, state: Column, status: Column) -> Column:
    """As in a report, but a running file's block is reviewing."""
    return F.when(_failed(b), "failed").when(_done(b) | _file_done(state, status), "completed").when((b["review_state"] == 1) | (state == 1), "reviewing").otherwise("pending")


def block_in_snapshot(b: Column) -> Column:
    """The block alone counts."""
    return F.when(_failed(b), "failed").when(_done(b), "completed").when(b["review_state"] == 1, "reviewing").otherwise("pending")


def block_in_retry(b: Column, status: Column) -> Column:
    """skip: nothing to do for it; the file's own state is no reason to."""
    done = _done(b) | F.coalesce(status, F.lit("")).isin("reviewed", "resumed")
    return F.when(_failed(b), "failed").when(done, "skip").when(b["review_state"] == 1, "running").otherwise("pending")


def block_complete(b: Column) -> Column:
    """Fit for reuse when files are synchronised."""
    return F.coalesce(b["main_task_completed"], F.lit(False)) & (F.coalesce(b["failure_message"], F.lit("")) == "")


def _all(statuses: Column, what: str) -> Column:
    return (F.size(statuses) > 0) & F.forall(statuses, lambda s: s == what)


def file_in_report(statuses: Column, state: Column, status: Column) -> Column:
    """From the statuses of its blocks."""
    s = F.coalesce(status, F.lit(""))
    return (
        F.when(s == "skipped_budget", "failed")
        .when(_all(statuses, "completed"), "completed")
        .when((state == 1) | F.array_contains(statuses, "reviewing"), "reviewing")
        .when((state == 3) | F.array_contains(statuses, "failed") | (s == "partial"), "failed")
        .otherwise("pending")
    )


def file_in_snapshot(statuses: Column) -> Column:
    failed_only = F.array_contains(statuses, "failed") & ~F.array_contains(statuses, "pending")
    return F.when(_all(statuses, "completed"), "reviewed").when(F.array_contains(statuses, "reviewing"), "reviewing").when(failed_only, "partial").otherwise("pending")


def file_state(status: Column) -> Column:
    return F.when(status == "reviewed", 2).when(status == "reviewing", 1).when(status == "partial", 3).otherwise(0)


def snapshot_task(statuses: Column, removals: Column, finalize: Column, parent: Column) -> Column:
    """2 completed, 3 partial, 1 running, 0 waiting; statuses are those of all blocks."""
    open_ = F.array_contains(statuses, "pending") | F.array_contains(statuses, "reviewing")
    failed = F.array_contains(statuses, "failed")
    none = F.size(statuses) == 0
    done = (none & ~removals & finalize & (parent == 2)) | (~none & ~failed & ~open_)
    return F.when(done, 2).when(failed & ~F.array_contains(statuses, "pending"), 3).when(parent == 1, 1).otherwise(0)


def task_type(base: Column, given: Column) -> Column:
    """A full scan if there is no base version; else as given if that is 1 or 2, else 1."""
    return F.when(F.coalesce(F.trim(base), F.lit("")).isin("", "0", "0_version"), 3).when(given.isin(1, 2), given).otherwise(1)


def retry_possible(percent: Column, failed: Column, waiting: Column, state: Column, retrying: Column) -> Column:
    return (percent < 100) & (failed > 0) & (waiting == 0) & (state == 3) & ~retrying


def progress(done_blocks: Column, blocks: Column, done_files: Column, files: Column, state: Column) -> Column:
    """Percent of blocks, or of files without blocks, or by the task's state without files."""
    share = lambda a, b: F.bround(a * 100.0 / b, 0).cast("int")
    return F.when(blocks > 0, share(done_blocks, blocks)).when(files > 0, share(done_files, files)).otherwise(F.when(state == 2, 100).otherwise(0))


def worker_active(state: Column, lease_token: Column, lease_expires: Column, now: Column) -> Column:
    return (state == 1) & (F.coalesce(lease_token, F.lit("")) != "") & F.coalesce(lease_expires > now, F.lit(False))
