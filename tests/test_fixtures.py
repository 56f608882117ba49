"""Worked cases with known results."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.plans import reports
from tidemark.functions import numeric, status, text
from tidemark.operators import code, control, diffs, feedback, issues, report, rollup
from tidemark.sources import trees, views
from tidemark.streaming import feedback as stream

BASE = dt.datetime(2026, 7, 10, 8)
ISSUE = "severity int, feedback_type string, filter_status string"
BLOCK = f"block_id int, contents array<string>, main_task_completed boolean, failure_message string, review_state int, model_rounds array<int>, tool_calls array<int>, issues array<struct<{ISSUE.replace(' ', ':').replace(',:', ', ')}>>, logic_score int, performance_score int, security_score int, readable_score int, code_style_score int"
FILE = f"id string, task_id string, file_name string, file_author string, state int, extra struct<status:string>, code_blocks array<struct<{', '.join(p.replace(' ', ':', 1) for p in BLOCK.split(', ', 7)[:7])}, issues:array<struct<severity:int, feedback_type:string, filter_status:string>>, logic_score:int, performance_score:int, security_score:int, readable_score:int, code_style_score:int>>"


def block(n=0, contents=(), done=False, state=0, failure="", rounds=0, tools=0, issues=(), score=0):
    return (n, list(contents), done, failure, state, [0] * rounds, [0] * tools, list(issues), *[score] * 5)


def files(spark, rows):
    return spark.createDataFrame([(f"f{i}", task, name, author, state, (st,), blocks) for i, (task, name, author, state, st, blocks) in enumerate(rows)], FILE)


def one(df):
    return df.first().asDict()


def test_dashboard(spark):
    day = dt.timedelta(days=1)
    tasks = spark.createDataFrame(
        [("1", "alpha", 1, BASE, 70, 30, 100, 1000), ("2", "alpha", 2, BASE + day, 100, 50, 150, 2500), ("3", "beta", 3, BASE + 2 * day, 150, 50, 0, 6500), ("4", "outside", 1, BASE - 20 * day, 999, 999, 1998, 99999)],
        "id string, project_id string, task_type int, create_time timestamp, llm_prompt_tokens long, llm_completion_tokens long, llm_total_tokens long, llm_elapsed_ms long",
    ).where(views.within(F.col("create_time"), dt.date(2026, 7, 10), dt.date(2026, 7, 12)))
    stored = files(spark, [
        ("1", "completed.c", "", 2, "", [block(done=True, state=2, rounds=2, tools=2, issues=[(5, "agree", None), (3, "reject", None), (5, "agree", "filtered")])]),
        ("2", "pending.c", "", 0, "", [block(rounds=1, tools=1, issues=[(1, None, None)])]),
        ("3", "full.c", "", 2, "", [block(done=True, state=2, rounds=1, tools=3, issues=[(2, None, "filtered")])]),
        ("4", "outside.c", "", 2, "", [block(done=True, tools=1)]),
    ])
    log = spark.createDataFrame([(BASE, "agree"), (BASE + day, "reject"), (BASE + 2 * day, "agree")], "create_time timestamp, feedback_type string")
    got = one(feedback.dashboard(tasks, views.issues_of(stored), log))
    want = {"task_count": 3, "project_count": 2, "total_tokens": 450, "prompt_tokens": 320, "completion_tokens": 130, "elapsed_ms": 10000, "valid_count": 3, "filtered_count": 2, "severe_count": 1, "feedback_count": 2, "agree_count": 1, "agree_rate": 50.0, "past_count": 3, "past_agree_count": 2, "past_agree_rate": 66.7}
    assert got == want
    mine = stored.join(tasks.select(F.col("id").alias("task_id")), "task_id", "left_semi")
    s = F.transform("code_blocks", lambda b: status.block_in_dashboard(b, F.col("state"), F.col("extra.status")))
    got = one(feedback.dashboard_files(mine, status.file_in_report(s, F.col("state"), F.col("extra.status"))))
    assert (got["file_count"], got["reviewed_count"], got["tool_call_count"], got["block_round_count"], got["severe_count"]) == (3, 2, 6, 4, 1)


def test_feedback_report_and_blank_author(spark):
    rows = [("t", "auth.c", "mallow", 5, "agree", None), ("t", "auth.c", "mallow", 5, None, None), ("t", "auth.c", "mallow", 4, "reject", None), ("t", "auth.c", "mallow", 5, None, "FILTERED")]
    i = spark.createDataFrame(rows, "task_id string, file_name string, file_author string, " + ISSUE)
    got = one(feedback.counted(i))
    assert (got["severe_count"], got["severe_feedback_count"], got["severe_feedback_rate"], got["severe_agree_rate"], got["issue_count"], got["feedback_rate"]) == (2, 1, 50.0, 100.0, 3, 66.7)
    assert [r.n for r in feedback.severity_histogram(i).orderBy("severity").collect()] == [0, 0, 0, 1, 2]
    blank = spark.createDataFrame([("t", "a.c", "", 5, None, None), ("t", "a.c", "  ", 2, "agree", None)], i.schema)
    assert blank.where(views.author_is(F.col("file_author"), "__empty__")).count() == 2
    assert one(feedback.by_author(blank, blank))["issue_count"] == 2


LOG = [("project-a", "release-1", "master", "mallow", 5, "agree", 0), ("project-a", "release-1", "master", "mallow", 5, "reject", 1), ("project-b", "release-2", "0_version", "sorrel", 3, "agree", 2), ("project-b", "release-2", "0_version", "", 4, "reject", 3), ("outside", "old", "master", "mallow", 5, "agree", -2)]
LOG_SCHEMA = "id string, project_id string, review_version string, copy_from_version string, file_author string, severity int, feedback_type string, create_time timestamp"


def log_of(spark):
    start = dt.datetime(2026, 7, 1, 8)
    return spark.createDataFrame([(str(i), *r[:-1], start + dt.timedelta(days=r[-1])) for i, r in enumerate(LOG)], LOG_SCHEMA)


def test_log_views_and_stream(spark, tmp_path):
    log = log_of(spark).where(views.within(F.col("create_time"), dt.date(2026, 7, 1), dt.date(2026, 7, 31)))
    got = one(feedback.log_summary(log))
    assert (got["feedback_count"], got["agree_rate"], got["severe_count"], got["severe_agree_rate"]) == (4, 50.0, 2, 50.0)
    pages = [[r.id for r in views.page_of(log, [F.col("create_time"), F.col("id")], p, 2)[0].collect()] for p in (1, 2, 99)]
    assert pages == [["0", "1"], ["2", "3"], ["2", "3"]]
    versions = feedback.log_summary(log, "project_id", "review_version", "copy_from_version").orderBy("first_seen").collect()
    assert [(r.project_id, r.feedback_count, r.agree_rate) for r in versions] == [("project-a", 2, 50.0), ("project-b", 2, 50.0)]
    log.write.parquet(str(tmp_path / "in"))
    stream.run_once(stream.by_version(stream.log_stream(spark, str(tmp_path / "in"), LOG_SCHEMA)), "by_version", str(tmp_path / "state"))
    same = ["project_id", "feedback_count", "agree_rate", "severe_agree_rate", "first_seen"]
    assert sorted(map(tuple, spark.table("by_version").select(*same).collect())) == sorted(map(tuple, feedback.log_summary(log, "project_id", "review_version", "copy_from_version").select(*same).collect()))


def line(n, marker):
    return f"{n:>6}{marker}  x"


def test_task_report(spark):
    stored = files(spark, [
        ("1", "src/auth.c", "alice", 2, "", [block(0, [line(1, "+"), line(2, "-"), line(2, " ")], True, 2, issues=[(5, None, None), (5, None, "filtered")], score=50), block(1, [line(8, "+")], True, 2, score=100)]),
        ("1", "src/math.c", "bob", 2, "", [block(0, [line(4, "+")], True, 2, issues=[(3, None, None)], score=0)]),
    ])
    b = report.blocks_of(stored, F.lit(1))
    assert b.agg(F.sum("weight")).first()[0] == 4
    assert one(report.weighted_scores(b, "task_id"))["logic_score"] == 50
    assert one(report.weighted_scores(b, "file_author").where("file_author = 'alice'"))["logic_score"] == 67
    assert [r.n for r in b.groupBy("task_id").agg(F.count("*").alias("n")).collect()] == [3]


@pytest.mark.parametrize(
    ("blocks", "state", "percent", "retry"),
    [([block(0, done=True), block(1), block(2, failure="x")], 1, 33, False), ([block(0, done=True), block(1, done=True), block(2, failure="x")], 3, 67, True), ([block(0, done=True)], 2, 100, False)],
)
def test_progress(spark, blocks, state, percent, retry):
    tasks = spark.createDataFrame([("1", state, False)], "id string, state int, retry_failed_only boolean")
    got = one(report.progress_of(tasks, files(spark, [("1", "a.c", "", 0, "", blocks)])))
    assert (got["percent"], got["retry_available"]) == (percent, retry)


def test_legacy_file_counts_as_done(spark):
    tasks = spark.createDataFrame([("1", 2, False)], "id string, state int, retry_failed_only boolean")
    assert one(report.progress_of(tasks, files(spark, [("1", "a.c", "", 0, "reviewed", [block()])])))["percent"] == 100


def test_admin_list(spark):
    day = dt.timedelta(days=1)
    tasks = spark.createDataFrame(
        [("b", "bravo", "v2", "z-base", 2, 2, 70, BASE + day, {"5": 2, "1": 1}), ("a", "alpha", "v3", "y-base", 1, 1, 90, BASE + 2 * day, None), ("c", "charlie", "v1", "x-base", 2, 0, 50, BASE, None)],
        "id string, project_id string, review_version string, copy_from_version string, task_type int, state int, score int, create_time timestamp, severity_counts map<string,long>",
    )
    i = spark.createDataFrame([("a", 4, None, None)], "task_id string, " + ISSUE)
    listed = feedback.admin_list(tasks, i)
    first = {"project_id": "alpha", "review_version": "charlie", "copy_from_version": "charlie", "state": "charlie", "task_type": "alpha", "score": "charlie", "critical_issue_count": "alpha", "issue_count": "charlie", "create_time": "charlie"}
    assert {k: listed.orderBy(*feedback.admin_order(k, False)).first().project_id for k in feedback.SORTS} == first
    bravo = one(listed.where("project_id = 'bravo'"))
    assert (bravo["issue_count"], bravo["highest_severity"], bravo["critical_issue_count"]) == (3, 5, 2)
    assert listed.where(feedback.contains_text(F.col("project_id"), "ALPHA")).count() == 1


def test_compare_and_diff(spark):
    old, new = "a\nb\nc\n", "a\nB\nc\nd\n"
    schema = "path string, text string, md5 string"
    base = spark.createDataFrame([("same", "x", "1"), ("mod", old, "2"), ("gone", "y", "3"), ("was", "z", "4"), ("twin1", "t", "5"), ("twin2", "t", "5")], schema)
    head = spark.createDataFrame([("same", "x", "1"), ("mod", new, "6"), ("new", "n", "7"), ("is", "z", "4"), ("twin3", "t", "5")], schema)
    changes = diffs.compared(base, head)
    assert sorted((r.path, r.change_type) for r in changes.collect()) == [("gone", "DELETED"), ("is", "RENAMED"), ("mod", "MODIFIED"), ("new", "ADDED"), ("twin1", "DELETED"), ("twin2", "DELETED"), ("twin3", "ADDED")]
    lines = {r.path: list(r.diff_lines) for r in diffs.changed_targets(changes, base, head).collect()}
    assert lines["mod"] == ["     1   a", "     2-  b", "     2+  B", "     3   c", "     4+  d"]
    assert set(lines) == {"mod", "new", "twin3"}


def test_folds_match_python(spark):
    rng = random.Random(3)
    rows = [(i, [("x" * rng.randrange(120)) for _ in range(rng.randrange(0, 30))], [rng.randrange(1, 30) for _ in range(12)]) for i in range(20)]
    df = spark.createDataFrame(rows, "i int, lines array<string>, costs array<int>").select("i", "costs", diffs.split_blocks(F.col("lines"), 40).alias("b"))
    each = df.select("i", F.posexplode("costs").alias("k", "cost"))
    oks = {}
    for r in diffs.admitted(each, "i", ["k"], "cost", 60).orderBy("i", "k").collect():
        oks.setdefault(r.i, []).append(r.ok)
    assert diffs.admitted(each, "i", ["k"], "cost", 0).where("not ok").count() == 0
    for r, (_, lines, costs) in zip(df.orderBy("i").collect(), rows, strict=True):
        blocks, used = [], 0
        for x in lines:
            t = max(1, len(x) // 4)
            if not blocks or used + t > 40:
                blocks, used = [*blocks, []], 0
            blocks[-1].append(x)
            used += t
        left, ok = 60, []
        for c in costs:
            ok.append(c <= left)
            left -= c * ok[-1]
        assert (r.b, oks[r.i]) == (blocks, ok)


@pytest.mark.parametrize(
    ("language", "blocks", "want"),
    [
        ("C", [["     1-  /* old", "     1+  /* new", "     2   more */", "     3+  // line"]], [True]),
        ("C", [["     1+  int value = 1; // note"]], [False]),
        ("Shell", [["     1+  #!/bin/sh"]], [False]),
        ("Python", [["     4+  # noqa"]], [False]),
        ("SQL", [["     1+  /*+ hint */"]], [False]),
        ("Unheard", [["     1+  # x"]], [False]),
        ("C", [["     1+  /* start"], ["     2+   * more", "     3+   */"]], [True, True]),
        ("C", [['     1+  "/* text"', "     2+  // x"]], [False]),
        ("C", [["     1   // same"]], [False]),
    ],
)
def test_comment_only(spark, language, blocks, want):
    df = spark.createDataFrame([("f", language, i, b) for i, b in enumerate(blocks)], "path string, language string, block_id int, diff_lines array<string>")
    assert [r.comment_only for r in code.comment_only(df).orderBy("block_id").collect()] == want


def test_related_files(spark):
    rows = [("src/user.c", "C", '#include "user.h"\nint load(int x) {\n}\n'), ("src/user.h", "C/C++ Header", ""), ("tests/test_user.c", "C", '#include "../src/user.h"\nint main(void) {\n load(1);\n}\n'), ("src/other.c", "C", "int other(void) {\n}\n"), ("data/a_en.json", "JSON", ""), ("data/a_de.json", "JSON", "")]
    got = {(r.path, r.related): (r.score, r.reasons) for r in code.related_files(spark.createDataFrame(rows, "path string, language string, text string")).collect()}
    assert got["src/user.c", "src/user.h"] == (100, ["companion_source_header", "current_references_related"])
    assert got["tests/test_user.c", "src/user.c"][0] == 95 and "implementation_test_pair" in got["tests/test_user.c", "src/user.c"][1]
    assert got["data/a_en.json", "data/a_de.json"] == (70, ["localized_resource_family"])
    assert not any("src/other.c" in k for k in got)


SARIF = """{"runs": [{"tool": {"driver": {"name": "ExampleSAST", "rules": [{"id": "R1", "shortDescription": {"text": "buffer"}}]}}, "results": [
 {"ruleId": "R1", "locations": [{"physicalLocation": {"artifactLocation": {"uri": "src/main.c"}, "region": {"startLine": 2}}}]},
 {"ruleId": "R1", "message": {"text": "x"}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": "../outside.c"}, "region": {"startLine": 2}}}]}]}]}"""


def test_findings_support_issues(spark):
    f = trees.findings(spark.createDataFrame([(SARIF,), (SARIF,)], "value string"))
    assert [(r.file_name, r.start_line, r.end_line, r.level, r.message) for r in f.collect()] == [("src/main.c", 2, 2, "warning", "buffer")]
    i = spark.createDataFrame([(1, "src/main.c", "", "security", "strcpy overflows the buffer", "strcpy", 2, 2), (2, "src/main.c", "", "logic", "other", "", 9, 9)], "issue_id int, file_name string, rule_id string, type string, description string, evidence string, start_line int, end_line int")
    assert [(r.issue_id, r.sources, r.rule_ids, r.least_confidence) for r in issues.corroborated(i, f).collect()] == [(1, ["ExampleSAST"], ["R1"], 0.95)]


def test_findings_paths(spark):
    uris = ["c++/x.cpp", "src/100%.c", ".github/w.yml", "file:///root/p/src/x.c", "file:///other/x.c", "/root/p/./y.c", "https://a/b.c", "a%20b.c", "./z//q.c", "a\\\\b.c", "x/../y.c", ""]
    results = ",".join('{"ruleId": "R", "level": "Error", "message": {"text": "m"}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": "%s"}, "region": {"startLine": 3, "endLine": 1}}}]}' % u for u in uris)
    value = '{"runs": [{"tool": {"driver": {}}, "results": [%s, {"message": {}}, {"locations": []}]}]}' % results
    f = trees.findings(spark.createDataFrame([("reports/scan.sarif", value), ("bad", "{")], "path string, value string"), "/root/p").collect()
    assert sorted(r.file_name for r in f) == sorted(["c++/x.cpp", "src/100%.c", ".github/w.yml", "src/x.c", "y.c", "a b.c", "z/q.c", "a/b.c"])
    assert {(r.level, r.analyzer, r.start_line, r.end_line) for r in f} == {("error", "scan", 3, 3)}


def test_reports_are_bounded(spark, tmp_path):
    for name, size in (("a.sarif", 10), ("b.json", 10), ("c.txt", 10), ("sub/d.sarif", 10), ("big.sarif", 5000)):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x" * size)
    assert sorted(r.path for r in trees.read_reports(spark, str(tmp_path), ["*.sarif", "*.json"], 1000).collect()) == ["a.sarif", "b.json", "sub/d.sarif"]


def test_references_between_files(spark):
    rows = [("src/a.c", "C", '#include "util.h"'), ("lib/util.c", "C", ""), ("foo.c", "C", ""), ("x.py", "Python", "open('x/foo')"), ("web/p/q.js", "JavaScript", "import './r/s'; import '../t.js'; import 'n/../m.js'"), ("web/p/r/s.ts", "TypeScript", ""), ("web/t.js", "JavaScript", ""), ("web/p/m.js", "JavaScript", "")]
    got = {(r.path, r.related): r.score for r in code.related_files(spark.createDataFrame(rows, "path string, language string, text string")).collect()}
    assert got["src/a.c", "lib/util.c"] == 90 and got["lib/util.c", "src/a.c"] == 85
    assert ("x.py", "foo.c") not in got
    assert got["web/p/q.js", "web/p/r/s.ts"] == 90 and got["web/p/q.js", "web/t.js"] == 90
    assert got["web/p/q.js", "web/p/m.js"] == 90  # by its name after a slash


def test_symbols(spark):
    tree = spark.createDataFrame([("entry.c", "int add_one(int x) {\n  return x;\n}\nint calculate(int x) {\n  return add_one(x);\n}"), ("main.c", "int main(void) {\n  return calculate(1);\n}")], "path string, text string")
    lines = code.code_lines(tree)
    assert [(r.path, r.line) for r in code.find_definition(code.definitions(lines), F.lit("calculate")).collect()] == [("entry.c", 4)]
    edges = code.call_graph(code.calls(lines), "calculate", "both", 1)
    assert sorted((r.caller, r.callee) for r in edges.collect()) == [("calculate", "add_one"), ("main", "calculate")]
    assert [r.line for r in code.code_search(lines, "ADD_ONE", patterns=["*.c", ":(exclude)main.c"]).collect()] == [1, 5]
    with pytest.raises(views.RequestError):
        code.path_filter(F.col("path"), ["../x"])


def test_detection_location_and_filter(spark):
    b = spark.createDataFrame([("a.c", ["     1   int x;", "     2+  strcpy(a, b); // TODO", "     3-  old();", "     3   done();"])], "path string, diff_lines array<string>")
    lines = issues.parsed(b).withColumn("language", F.lit("C"))
    found = issues.detected(lines.where("marker = '+'"))
    assert sorted((r.line_no, r.rule_id, r.severity) for r in found.collect()) == [(2, "unbounded-copy", 5), (2, "unfinished", 2)]
    can = issues.reviewable_lines(lines)
    assert sorted(r.line for r in can.collect()) == [2, 3]
    side = lines.where("marker <> '-'").select("path", "line_no", text.squeeze(F.col("code")).alias("norm"), F.col("line_no").isin(2, 3).alias("changed"))
    wanted = spark.createDataFrame([("a.c", 1, "+ strcpy(a,  b); // TODO\n\n done();"), ("a.c", 2, "strcpy(a, c); // TODO")], "path string, fragment_id long, code string").withColumn("wanted", issues.fragment_lines(F.col("code")))
    exact = issues.exact_matches(wanted, side)
    assert [(r.fragment_id, r.start_line, r.end_line, r.on_change) for r in exact.collect()] == [(1, 2, 3, True)]
    rest = wanted.join(exact.select("fragment_id"), "fragment_id", "left_anti")
    place = issues.located(issues.fuzzy_matches(rest, side), spark.createDataFrame([("a.c", 2, 2)], "path string, fragment_id long, claimed_line int")).first()
    assert (place.start_line, place.ambiguous, place.score > 0.8) == (2, False, True)
    schema = "description string, suggestion string, existing_code string, evidence string, issue_line_numbers string, relocation_status string, confidence_level double, evidence_match_score double"
    rows = [("", "s", "c", "e", "2", "", 0.9, 1.0), ("d", "s", "c", "e", "2", "", 0.2, 1.0), ("d", "s", "c", "e", "9", "", 0.9, 1.0), ("d", "s", "c", "e", "2", "", None, None)]
    reasons = [r[0] for r in spark.createDataFrame(rows, schema).select(issues.rejection(F.array(F.lit(2), F.lit(3)))).collect()]
    assert reasons == ["no description or suggestion", "low confidence", "line isn't under review", None]


def test_merge_in_file(spark):
    schema = "file_name string, block_id int, issue_id int, type string, severity int, issue_line_numbers string, description string, suggestion string, rule_id string, existing_code string, filter_status string"
    rows = [
        ("f", 0, 0, "Logic", 3, "1,2", "null check is missing here", "s", "", "x = y", "filtered"),
        ("f", 0, 1, "logic ", 3, "2, 1", "null  check is missing here", "S", "", "", "kept"),
        ("f", 1, 0, "logic", 3, "2", "a null check is missing here", "t", "", "x=y", "kept"),
        ("f", 1, 1, "logic", 4, "2", "null check is missing here", "s", "", "x = y", "kept"),
    ]
    got = {(r.block_id, r.issue_id): r.survivor for r in issues.merged_in_file(spark.createDataFrame(rows, schema)).collect()}
    assert got == {(0, 0): False, (0, 1): True, (1, 0): True, (1, 1): True}


def test_control_plane(spark):
    t0 = dt.datetime(2026, 7, 10, 8)
    schema = "id string, state int, task_type int, dispatch_priority int, create_time timestamp, lease_expires_at timestamp, automatic_retry_pending boolean, retry_count int, next_retry_time timestamp, lease_token string, completion_status string"
    rows = [("full", 0, 3, 0, t0 - dt.timedelta(minutes=10)), ("late", 0, 1, 0, t0 - dt.timedelta(minutes=1)), ("early", 0, 1, 0, t0 - dt.timedelta(minutes=5))]
    df = spark.createDataFrame([(*r, None, False, 0, None, None, None) for r in rows], schema)
    assert control.next_task(df, F.lit(t0)).first().id == "early"
    manual = control.manual_retry({"state": 3, "retry_count": 2}, {"failed": 1, "pending": 0, "running": 0}, t0)
    assert (manual["state"], manual["dispatch_priority"], manual["manual_retry_count"], manual["completion_status"], manual["retry_count"]) == (0, 100, 1, "retry_pending", 2)
    assert control.manual_retry(manual, {}) is manual
    for task, failures, code_ in [(None, {}, 404), ({"state": 1}, {}, 409), ({"state": 2}, {"failed": 1}, 409), ({"state": 0}, {"failed": 1}, 409), ({"state": 3}, {"failed": 0}, 409), ({"state": 3}, {"failed": 1, "pending": 1}, 409), ({"state": 3, "lease_token": "x"}, {"failed": 1}, 409)]:
        with pytest.raises(views.RequestError) as e:
            control.manual_retry(task, failures)
        assert e.value.code == code_
    leased = [("waiting", 0, "w", t0 + dt.timedelta(1)), ("untokened", 1, "", t0 + dt.timedelta(1)), ("lapsed", 1, "w", t0), ("live", 1, "w", t0 + dt.timedelta(1)), ("superseded", 3, "", None), ("failed", 3, "", None)]
    more = spark.createDataFrame([(i, s, 1, 0, t0, e, True, 0, None, k, "superseded" if i == "superseded" else "failed") for i, s, k, e in leased], schema)
    assert {r.id for r in more.where(control.eligible(F.lit(t0))).collect()} == {"untokened", "lapsed", "failed"}
    claim = control.claimed({"state": 0, "retry_failed_only": True}, "me", "token", t0)
    assert (claim["state"], claim["completion_status"], claim["lease_expires_at"]) == (1, "retry_running", t0 + dt.timedelta(seconds=120))
    assert [r[0] for r in spark.range(4).select(numeric.retry_delay(F.col("id").cast("int"))).collect()] == [30, 30, 60, None]
    old = spark.createDataFrame([("1", "0_version", 2), ("2", "master", 2)], "id string, copy_from_version string, task_type int")
    once = diffs.migrated_types(old)
    assert once.where("changed").count() == 1 and diffs.migrated_types(once.drop("changed")).where("changed").count() == 0
    with pytest.raises(views.RequestError):
        views.date_range(dt.date(2026, 2, 1), dt.date(2026, 1, 1), dt.date(2026, 3, 1))


def test_tree_source(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "dist").mkdir()
    (tmp_path / "src" / "a.py").write_bytes(b"x\n\xff\n")
    (tmp_path / "src" / "b.c").write_bytes(b"\0binary")
    (tmp_path / "src" / "c.txt").write_text("x")
    (tmp_path / "dist" / "d.py").write_text("x")
    got = trees.read_tree(spark, str(tmp_path)).collect()
    assert [(r.path, r.language, r.text) for r in got] == [("src/a.py", "Python", "x\n�\n")]
    assert diffs.full_scan(trees.read_tree(spark, str(tmp_path))).first().diff_lines == ["     1+  x", "     2+  �"]
    m = trees.author_map(spark.createDataFrame([('{"./src/a.py": " ann ", "b": "", "src/a.py": "bob"}',)], "value string"))
    assert [tuple(r) for r in m.collect()] == [("src/a.py", "bob")]


def test_text_functions(spark):
    row = spark.createDataFrame([("a\r\nb c\n", "Foo::Bar.baz", "ab 你好吗 x_1", "，3, 1,1", '```json\n{"a": 1}\n```')], "a string, b string, c string, d string, e string")
    got = row.select(text.split_lines(F.col("a")), text.symbol_key(F.col("b")), text.word_set(F.col("c")), text.lines_key(F.col("d")), text.json_text(F.col("e")), text.percent_encoded(F.lit("a b~*/")), text.cut(F.lit("x" * 50), 30), numeric.rate(F.lit(1), F.lit(0)), text.issue_type(F.lit("Code-Style")), code.expand_braces("a{b,c{d,e}}f")[0] == F.lit("abf")).first()
    assert got[0] == ["a", "b", "c"] and got[1] == "baz" and got[2] == ["ab", "x_1", "你好", "好吗"] and got[3] == "1,3" and got[4] == '{"a": 1}' and got[5] == "a%20b~%2A%2F" and got[6].startswith("x" * 10 + "\n") and got[7] == 0.0 and got[8] == "code_style"


def test_rollups(spark):
    f = spark.createDataFrame([("f1", "t", "a.c", "", 3, ("partial",), [block(0, ["x"], True, 2, issues=[(5, None, None), (1, None, "filtered")], score=140), block(1, score=20)])], FILE)
    rows = rollup.block_rows(f).orderBy("block_id").collect()
    assert [(r.logic_score, r.overall, len(r.issues)) for r in rows] == [(100, 100, 1), (20, 20, 0)]
    assert one(rollup.file_checkpoint(f)) == {"task_id": "t", "files": 1, "reviewed": 0, "incomplete": 1, "blocks": 2}
    stored = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    assert sorted(map(tuple, rollup.upserted(stored, spark.createDataFrame([(2, "c"), (3, "d")], stored.schema), "id").collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert rollup.merged_rules({"a": [1], "b": {"c": [1], "d": 1}, "language": "C"}, {"a": [2], "b": {"c": [2], "d": 2}, "language": "x"}) == {"a": [1, 2], "b": {"c": [1, 2], "d": 2}, "language": "C"}
    assert rollup.distinct_values([{"a": 1}, 2, {"a": 1}, 2]) == [{"a": 1}, 2]
    with pytest.raises(views.RequestError):
        rollup.saved_feedback("reject", " ")
    m = {r.path: (r.lines, r.full) for r in rollup.manifest(spark.createDataFrame([("a", None, "ADDED"), ("b", "c", "RENAMED")], "path string, old_path string, change_type string"), 1).collect()}
    assert m == {"a": (["RENAMED c -> b"], True), "b": (["ADDED a"], True)}


def test_snapshots(spark):
    s = spark.createDataFrame([("t", 1, 0, ""), ("t", 2, 1, ""), ("t", 3, 2, "completed"), ("u", 1, 0, "")], "task_id string, trigger_revision int, state int, completion_status string")
    assert [(r.state, r.completion_status) for r in control.superseded(s, F.lit("t"), 4).orderBy("task_id", "trigger_revision").collect()] == [(3, "superseded"), (3, "superseded"), (2, "completed"), (0, "")]
    assert sorted((r.task_id, r.trigger_revision) for r in control.carried_forward(s, F.lit("t"), 9).collect()) == [("t", 1), ("t", 3), ("t", 9), ("u", 1)]


def test_guessed_lines_and_background(spark):
    found = spark.createDataFrame([("a.c", 1, "security", "buffer overflow", ""), ("a.c", 2, "logic", "the counter is never reset", ""), ("a.c", 3, "logic", "no", "")], "path string, issue_id int, type string, description string, suggestion string")
    lines = spark.createDataFrame([("a.c", 4, "counter += 1;"), ("a.c", 7, "strcpy(a, b);"), ("a.c", 9, "reset(counter);")], "path string, line_no int, code string")
    assert sorted((r.issue_id, r.line_no) for r in issues.guessed_lines(found, lines).collect()) == [(1, 7), (2, 9)]
    b = spark.createDataFrame([("auth.c", "reject")], "name string, content string")
    assert [(r.background, r.background_source) for r in rollup.with_background(spark.createDataFrame([("src/Auth.c",), ("b.c",)], "path string"), b).orderBy("path").collect()] == [("", ""), ("reject", "file-name")]


@pytest.mark.parametrize(("state", "changed", "want"), [(0, False, 0), (1, False, 0), (2, False, 2), (3, False, 0), (2, True, 0)])
def test_trigger_again(state, changed, want):
    got = control.triggered({"state": state, "trigger_revision": 4}, {}, changed, BASE)
    assert (got["state"], got["trigger_revision"]) == (want, 5)
    assert control.triggered(None, {"project_id": "p"}, True, BASE)["state"] == 0
    assert control.interrupted({"lease_owner": "w", "trigger_revision": 1, "state": 1}, "w", 1)["state"] == 0


def test_finished_reads_nested_files_once(spark):
    d = "/root/testdata/sf0.001"
    assert not any("lineitem" in f for f in reports.finish_rollups(spark, d).inputFiles()), "everything is counted from the stored rows"
    assert reports.report_files(spark, d)._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1, "blocks and files are nested after one deal"
