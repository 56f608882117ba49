"""Pairs and ranges: by classes and sums, against all pairs."""

import itertools
import random

import pyarrow as pa

from tidemark.operators import code, diffs, issues, ranges
from tidemark.plans import catalog, reports


def test_similar_pairs_are_those_of_all_pairs(spark):
    r = random.Random(5)
    rows = [(i, r.choice("gh"), [r.choice("abcdefg") for _ in range(r.randint(1, 9))]) for i in range(250)] + [(900 + i, "g", ["x", "y", "z"]) for i in range(30)]
    df = spark.createDataFrame(rows, "id long, g string, w array<string>")
    found = issues.similar_pairs(df, "id", ["g"], df.w, 0.65)
    got = sorted((p.a, p.b, p.similarity) for p in found.collect())
    share = lambda x, y: len(set(x) & set(y)) / len(set(x) | set(y))
    assert got == sorted((a, b, share(x, y)) for (a, g, x), (b, h, y) in itertools.combinations(rows, 2) if g == h and share(x, y) >= 0.65)


def test_similar_pairs_join_no_rows_by_their_group_alone(spark):
    df = spark.createDataFrame([(1, "g", ["x"])], "id long, g string, w array<string>")
    plan = issues.similar_pairs(df, "id", ["g"], df.w, 0.65)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join Inner" in line]
    assert joins and all("_word" in j or "_set" in j or "_x" in j or "_y" in j for j in joins)


def test_nested_issues_are_dealt_once(spark):
    had = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with many tasks
        files = reports._nested_issues(spark, "/root/testdata/sf0.001")
        own = files.join(files.sparkSession.range(9).selectExpr("cast(id as string) as task_id"), "task_id", "left_semi")
        plan = own._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in had.items():
            spark.conf.set(k, v)
    assert plan.count("Exchange hashpartitioning") == 2  # the issues, and the tasks


def test_overlap_sums_are_those_of_all_pairs(spark):
    r = random.Random(8)
    made = lambda n, longest: [(i, r.choice("fg"), a, a + r.randint(-2, r.choice([1, 9, longest]))) for i in range(n) for a in [r.randint(-40, 400)]]
    one, two = made(120, 200), made(90, 300)
    left, right = spark.createDataFrame(one, "id long, f string, a1 long, a2 long"), spark.createDataFrame(two, "e long, f string, b1 long, b2 long")
    found = ranges.overlap_sums(left, right, "f", ("a1", "a2"), ("b1", "b2"), "e")
    want = {i: [e for e, g, b1, b2 in two if g == f and b1 <= b2 and a1 <= b2 and b1 <= a2] for i, f, a1, a2 in one if a1 <= a2}
    assert {x.id: (x.n, x.least) for x in found.collect()} == {i: (len(e), min(e)) for i, e in want.items() if e}


def test_findings_are_not_dealt_with_each_line(spark):
    r = random.Random(9)
    found = [(i % 40, r.choice("fg"), a, a + r.randint(-2, 90)) for i in range(80) for a in [r.randint(0, 300)]] + [(1, "f", 5, 9)] * 2
    lines = [(r.choice("fg"), r.choice([1, 2, None]), r.randint(0, 350)) for _ in range(300)]
    f, p = spark.createDataFrame(found, "id long, file_name string, start_line long, end_line long"), spark.createDataFrame(lines, "file_name string, block_id int, line long")
    out = ranges.findings_on_changes(f, p)
    want: dict = {}
    for row in found:
        for g, b, line in set(lines):
            if g == row[1] and row[2] <= line <= row[3]:
                n, first = want.get((row, b), (0, line))
                want[row, b] = n + 1, min(first, line)
    assert {((x.id, x.file_name, x.start_line, x.end_line), x.block_id): (x.changed_lines, x.first_line) for x in out.collect()} == want
    # the last step is a join: what it makes isn't dealt again
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan[: plan.index("Join")]


def test_call_graph_goes_through_its_edges_once_a_step(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("x", "a"), ("ns.B", "q")], "caller string, callee string")
    found = code.call_graph(edges, "a", "outgoing", 3)
    assert sorted(map(tuple, found.collect())) == [("a", "b"), ("b", "c"), ("c", "d"), ("ns.B", "q")]
    both = code.call_graph(edges, "a", "both", 2)
    assert sorted(map(tuple, both.collect())) == [("a", "b"), ("b", "c"), ("ns.B", "q"), ("x", "a")]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1  # the edges


def test_comment_scan_takes_runs_of_code_as_one(spark):
    scan = code.scanner("c")
    assert [scan(x, "") for x in ("plain code // no", "a/b/*c", "  // only", '"/*" x', "a\\\\'/*'")] == [(True, ""), (True, "*/"), (False, ""), (True, ""), (True, "")]
    texts = [["word " * 4000], ["/* open"], ["inside"], ["closed */"], ["x = 1"]]
    df = spark.createDataFrame([("f", "C", i, [f"{i + 1:>6}+  {t[0]}"]) for i, t in enumerate(texts)], "path string, language string, block_id int, diff_lines array<string>")
    out = code.comment_only(df)
    assert [r.comment_only for r in out.orderBy("block_id").collect()] == [False, True, True, True, False]
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().optimizedPlan().toString()  # no frame for each file


def test_full_scan_takes_columns_along(spark):
    tree = spark.createDataFrame([("a.c", "C", "x\ny"), ("b.c", "C", "")], "path string, language string, text string")
    assert [(r.path, r.line_count, r.full_code) for r in diffs.full_scan(tree, tree.text.alias("full_code")).collect()] == [("a.c", 2, "x\ny")]


def test_marked_lines_are_dealt_by_file_once(spark):
    had = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        plan = catalog.QUERIES["reviewable_lines"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", had)
    assert plan.count("Exchange hashpartitioning") == 1


def test_merged_issues_come_in_batches_of_many_files(spark):
    rows = [(f"f{i}", 1, 1, "logic", 3, "7", "d", "", "", "", None) for i in range(3000)]
    df = spark.createDataFrame(rows, "file_name string, block_id int, issue_id int, type string, severity int, issue_line_numbers string, description string, suggestion string, rule_id string, existing_code string, filter_status string")
    sizes = issues.merged_in_file(df).mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long").collect()
    assert sum(r.n for r in sizes) == 3000 and len(sizes) <= 2 * df.sparkSession.sparkContext.defaultParallelism + 8
