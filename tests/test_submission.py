"""Versioned tables, the log's sink, and triggers over them."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import submission as sub
from tidemark.operators.diffs import full_scan
from tidemark.operators.feedback import log_summary
from tidemark.sources.views import RequestError
from tidemark.streaming import feedback as stream
from tidemark.versions import Versions

NOW = dt.datetime(2024, 5, 1, 12)


def refused(code, call):
    with pytest.raises(RequestError) as e:
        call()
    assert e.value.code == code


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture()
def store(spark, tmp_path):
    return Versions(spark, str(tmp_path / "store"), 4)


def test_versions_change_together(spark, store):
    a = spark.createDataFrame([(i, f"v{i}") for i in range(20)], "k int, v string")
    assert store.latest() == 0 and store.names() == []
    assert store.commit(0, merge={"a": a}, append={"log": a.limit(1)}, keys={"a": "k"}) == 1
    new = spark.createDataFrame([(3, "new"), (50, "more")], "k int, v string")
    before = store._state(1)["tables"]["a"]["parts"]
    assert store.commit(1, merge={"a": new}, append={"log": new}, remove={"a": spark.createDataFrame([(7,)], "k int")}, notes={"n": 1}) == 2
    assert rows(store.read("a")) == sorted([(i, f"v{i}") for i in range(20) if i not in (3, 7)] + rows(new), key=str)
    assert rows(store.read("a", 1)) == rows(a) and store.read("log").count() == 3 and store.read("log", 1).count() == 1
    assert store.notes() == {"n": 1} and store.notes(1) == {}
    after = store._state(2)["tables"]["a"]["parts"]
    assert any(p in before for p in after), "buckets without changed rows stay where they are"
    refused(409, lambda: store.commit(1, append={"log": a}))
    refused(404, lambda: store.read("none"))
    refused(404, lambda: store.read("a", 9))
    refused(422, lambda: store.commit(2, append={"a": a}))
    assert store.latest() == 2 and store.read("log").count() == 3


def test_of_two_writers_the_second_is_refused(spark, store, monkeypatch):
    a = spark.createDataFrame([(1, 1)], "k int, v int")
    store.commit(0, put={"a": a}, keys={"a": "k"})
    other = Versions(spark, store.path, 4)
    publish = store._publish
    # the other one commits after the first has looked and written, just before it publishes
    monkeypatch.setattr(store, "_publish", lambda v, s: (other.commit(1, merge={"a": a.withColumn("v", F.lit(2))}), publish(v, s)))
    refused(409, lambda: store.commit(1, merge={"a": a.withColumn("v", F.lit(3))}))
    monkeypatch.undo()
    assert store.latest() == 2 and rows(store.read("a")) == [(1, 2)]
    tries = []

    def change(read):
        tries.append(read)
        if len(tries) == 1:
            other.update("a", F.lit(True), {"v": F.col("v") + 10})
        return store.update("a", F.col("k") == 1, {"v": F.col("v") + 100}, read)[1]

    assert store.retried(change) == 4 and tries == [2, 3] and rows(store.read("a")) == [(1, 112)]


def test_conditional_updates(spark, store):
    store.commit(0, put={"t": spark.createDataFrame([("a", 1, None), ("b", 2, "x")], "id string, n int, w string")}, keys={"t": "id"})
    assert store.update("t", F.col("n") > 1, {"n": F.col("n") + 1, "w": F.lit(None)}) == (1, 2)
    assert rows(store.read("t")) == [("a", 1, None), ("b", 3, None)]
    assert store.update("t", F.col("n") > 9, {"n": F.lit(0)}) == (0, 2)
    refused(409, lambda: store.update("t", F.lit(True), {"n": F.lit(0)}, read=1))


LOG = "id string, project_id string, review_version string, copy_from_version string, severity int, feedback_type string, create_time timestamp"


def log_rows(a, z):
    return [(str(i), f"p{i % 2}", f"v{i % 3}", "m", i % 6, ["agree", "reject", "agree"][i % 3], NOW + dt.timedelta(hours=i)) for i in range(a, z)]


def test_overlapping_drops_also_after_a_killed_batch(spark, store, tmp_path, monkeypatch):
    drops, at = str(tmp_path / "drops"), str(tmp_path / "checkpoint")

    def drop(a, z):
        spark.createDataFrame(log_rows(a, z) + log_rows(a, a + 2), LOG).coalesce(1).write.mode("append").parquet(drops)

    def equal(n):
        log = spark.createDataFrame(log_rows(0, n), LOG)
        want = log_summary(log, "project_id", "review_version", "copy_from_version")
        assert rows(store.read("log").drop("row_hash").select(log.columns)) == rows(log)
        assert rows(stream.stored_by_version(store).select(want.columns)) == rows(want)

    drop(0, 40)
    stream.drain(stream.log_stream(spark, drops, LOG, 1), store, at)
    equal(40)
    drop(30, 60)  # overlaps
    publish, calls = store._publish, []

    def killed_before(version, state):
        raise OSError("killed before it was published")

    monkeypatch.setattr(store, "_publish", killed_before)
    with pytest.raises(Exception):
        stream.drain(stream.log_stream(spark, drops, LOG, 1), store, at)
    equal(40)

    def killed_after(version, state):
        calls.append(publish(version, state))
        raise OSError("killed after it was published")

    monkeypatch.setattr(store, "_publish", killed_after)
    with pytest.raises(Exception):
        stream.drain(stream.log_stream(spark, drops, LOG, 1), store, at)
    equal(60)
    monkeypatch.undo()
    version = store.latest()
    stream.drain(stream.log_stream(spark, drops, LOG, 1), store, at)
    assert store.latest() == version, "the batch was committed already"
    equal(60)
    drop(55, 90)
    stream.drain(stream.log_stream(spark, drops, LOG, 1), store, str(tmp_path / "another"))  # a stream that begins anew
    equal(90)


def targets_of(spark, files):
    tree = spark.createDataFrame([(p, "C", t) for p, t in files.items()], "path string, language string, text string")
    t = full_scan(tree).join(tree.select("path", F.col("text").alias("full_code")), "path")
    return t.select(F.col("path").alias("file_name"), "language", "change_type", F.lit("").alias("old_file_name"), "full_code", "diff_lines", F.col("line_count").alias("code_line_num"), F.col("added_count").alias("add_code_line_num"))


def submit(spark, store, files, hours=0, **more):
    return sub.trigger(store, " p ", "v2", "", None, targets_of(spark, files), NOW + dt.timedelta(hours=hours), limit=8, **more)


def finish(store, name=None):
    """All blocks (of one file) reviewed, as a review leaves them."""
    of = F.col("file_id").isin([r.id for r in store.read("file").where(F.lit(True) if name is None else F.col("file_name") == name).collect()])
    issue = F.array(F.struct(F.lit(1).alias("issue_id"), F.lit(5).alias("severity"), F.lit("").alias("feedback_type"), F.lit("").alias("feedback_content"), F.lit("bad").alias("description"))).cast(dict(store.read("block").dtypes)["issues"])
    store.update("block", of, {"main_task_completed": F.lit(True), "review_state": F.lit(2), "logic_score": F.lit(80) + F.col("block_id"), "comment_line_number": F.lit(2), "llm_total_tokens": F.lit(10), "issues": issue})


FILES = {"a.c": "int a1;\nint a2;\nint a3;\nint a4;", "b.c": "int b;", "c.c": "same\nsame line here\nsame"}


def test_first_trigger(spark, store):
    task = submit(spark, store, FILES, authors=spark.createDataFrame([("a.c", "ann")], "file_name string, file_author string"))
    assert (task.project_id, task.copy_from_version, task.task_type, task.state, task.completion_status) == ("p", "0_version", 3, 0, "pending")
    assert (task.trigger_count, task.trigger_revision, task.file_num, task.reviewed_file_num, task.latest_snapshot_id) == (1, 1, 3, 0, None)
    assert store.read("block").count() == task.code_block_num and task.add_code_line_num == 8 and store.latest() == 1
    assert "snapshot" not in store.names() and store.read("project").first().scan_round == 1
    assert {r.file_name: r.file_author for r in store.read("file").collect()} == {"a.c": "ann", "b.c": "", "c.c": ""}
    fresh = store.read("block").first()
    assert fresh.review_state == 0 and fresh.issues == [] and fresh.main_task_completed is False and fresh.llm_total_tokens == 0 and fresh.comment == ""


def test_a_second_trigger_of_the_same_tree_changes_nothing(spark, store):
    submit(spark, store, FILES)
    finish(store)
    before, version = rows(store.read("block")), store.latest()
    task = submit(spark, store, FILES, 1)
    assert (task.trigger_count, task.trigger_revision, task.latest_snapshot_id) == (2, 2, None)
    assert rows(store.read("block")) == before and store._state(version)["tables"]["block"] == store._state(version + 1)["tables"]["block"]
    assert (task.state, task.completion_status) == (0, "pending"), "all files are done, but the task wasn't: it is to be finished"
    store.update("task", F.lit(True), {"state": F.lit(2), "score": F.lit(77)})
    task = submit(spark, store, FILES, 2)
    assert (task.state, task.completion_status, task.score, task.reviewed_file_num) == (2, "completed", 77, 3)
    assert store.read("project").first().scan_round == 3


def test_one_changed_file_recomputes_that_file_alone(spark, store):
    submit(spark, store, FILES)
    finish(store)
    before = {(r.file_id, r.block_id): r for r in store.read("block").collect()}
    ids = {r.file_name: r.id for r in store.read("file").collect()}
    store.update("file", F.lit(True), {"review_fingerprint": F.lit("fp")})
    changed = FILES | {"a.c": FILES["a.c"].replace("a4", "a4444")}
    task = submit(spark, store, changed, 1)
    now = {(r.file_id, r.block_id): r for r in store.read("block").collect()}
    assert now.keys() == before.keys()
    new = {k for k in now if now[k] != before[k]}
    assert new and all(f == ids["a.c"] for f, _ in new) and len(new) < sum(f == ids["a.c"] for f, _ in now), "unchanged blocks of the file stay done"
    refs = store.read("snapshot_block").collect()
    assert {(r.file_id, r.block_id) for r in refs} == new and all(now[k].review_state == 0 and now[k].issues == [] and now[k].logic_score == 0 for k in new)
    files = {r.file_name: r for r in store.read("file").collect()}
    assert (files["a.c"].state, files["a.c"].review_fingerprint, files["b.c"].state, files["b.c"].review_fingerprint) == (0, "", 2, "fp")
    assert files["b.c"].trigger_revision == 2 and files["b.c"].logic_score == 80
    assert (task.state, task.file_num, task.reviewed_file_num, task.code_block_num) == (0, 3, 2, len(now)) and task.latest_snapshot_id
    snap = store.read("snapshot").first()
    assert (snap.state, snap.completion_status, snap.trigger_revision, snap.llm_total_tokens_baseline) == (0, "pending", 2, 10 * len(before))
    assert [(r.file_name, r.kind, r.place) for r in store.read("snapshot_file").collect()] == [("a.c", "changed", 1)]
    assert {(r.file_id, r.block_id) for r in sub.checkpoint(store, snap.snapshot_id).collect()} == new
    # nothing new: the open snapshot moves to the new revision
    submit(spark, store, changed, 2)
    snaps = store.read("snapshot").collect()
    assert [(s.trigger_revision, s.state, s.completion_status) for s in snaps] == [(3, 0, "pending")]
    # a change again: the open one is superseded, a new one comes
    submit(spark, store, {"a.c": changed["a.c"], "d.c": "d"}, 3)
    snaps = sorted(store.read("snapshot").collect(), key=lambda s: s.trigger_revision)
    assert [(s.trigger_revision, s.state, s.completion_status) for s in snaps] == [(3, 3, "superseded"), (4, 0, "pending")]
    last = store.read("snapshot_file").where(F.col("snapshot_id") == snaps[1].snapshot_id)
    assert sorted((r.file_name, r.kind) for r in last.collect()) == [("b.c", "removed"), ("c.c", "removed"), ("d.c", "changed")]
    assert {r.file_name for r in store.read("file").collect()} == {"a.c", "d.c"} and {r.file_id for r in store.read("block").collect()} <= {r.id for r in store.read("file").collect()}


def test_equal_blocks_are_taken_over_one_by_one(spark, store):
    submit(spark, store, {"x.c": "1234567890123456789012345678\n" * 3})
    assert store.read("block").count() == 3
    h = store.read("block").where("block_id = 0").first().block_hash
    store.update("block", F.col("block_id") > 0, {"block_hash": F.lit(h), "main_task_completed": F.lit(True), "review_state": F.lit(2), "comment": F.concat(F.lit("was "), F.col("block_id").cast("string"))})
    fid = store.read("file").select("id").first().id
    store.update("file", F.lit(True), {"source_hash": F.lit("old")})
    new = targets_of(store.spark, {"x.c": "1234567890123456789012345678\n"}).withColumn("diff_lines", F.array_repeat(F.get("diff_lines", 0), 5))
    sub.trigger(store, "p", "v2", "", None, new, NOW, limit=8)
    got = store.read("block").orderBy("block_id").collect()
    assert [(r.file_id, r.review_state, r.comment) for r in got] == [(fid, 2, "was 1"), (fid, 2, "was 2"), (fid, 0, ""), (fid, 0, ""), (fid, 0, "")]
    assert [(r.block_id) for r in store.read("snapshot_block").orderBy("block_id").collect()] == [3, 4]


def test_a_lease_stays_while_it_lasts_and_conflicts_are_refused(spark, store):
    submit(spark, store, FILES)
    store.update("task", F.lit(True), {"state": F.lit(1), "lease_token": F.lit("t"), "lease_owner": F.lit("w"), "lease_expires_at": F.lit(NOW + dt.timedelta(hours=2))})
    assert submit(spark, store, FILES, 1).lease_token == "t"
    store.update("task", F.lit(True), {"state": F.lit(1)})
    assert submit(spark, store, FILES, 3).lease_token == ""
    commit = store.commit
    store.commit = lambda read, **w: commit(read - 1, **w)
    version = store.latest()
    refused(409, lambda: submit(spark, store, FILES, 4))
    assert store.latest() == version


def test_feedback_and_migration(spark, store):
    submit(spark, store, FILES)
    finish(store)
    file = store.read("file").where("file_name = 'b.c'").first().id
    version = store.latest()
    refused(422, lambda: sub.saved_feedback(store, file, 0, 1, "reject", " "))
    refused(422, lambda: sub.saved_feedback(store, file, 0, 1, "maybe"))
    refused(404, lambda: sub.saved_feedback(store, "none", 0, 1, "agree"))
    refused(404, lambda: sub.saved_feedback(store, file, 9, 1, "agree"))
    refused(404, lambda: sub.saved_feedback(store, file, 0, 9, "agree"))
    assert store.latest() == version
    row = sub.saved_feedback(store, file, 0, 1, "reject", " no ", NOW)
    assert (row.file_name, row.project_id, row.feedback_type, row.feedback_content, row.severity, row.task_type) == ("b.c", "p", "reject", "no", 5, 3)
    assert store.latest() == version + 1 and store.read("block").where(F.col("file_id") == file).first().issues[0].feedback_content == "no"
    sub.saved_feedback(store, file, 0, 1, "agree", "dropped", NOW)
    assert [r.feedback_content for r in store.read("feedback_log").collect()] in (["no", ""], ["", "no"]) and store.read("feedback_log", version + 1).count() == 1
    assert "feedback_log" not in store.names(version)
    store.update("task", F.lit(True), {"task_type": F.lit(2)})
    assert sub.migrated(store)["task"] == 1 and store.read("task").first().task_type == 3
    version = store.latest()
    assert set(sub.migrated(store).values()) == {0} and store.latest() == version
