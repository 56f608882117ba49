"""Rules by file, the symbol index, what a review asks for, and contexts that are compressed."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.operators import issues, rollup, rules, tools
from tidemark.operators.symbols import SymbolIndex
from tidemark.plans.indexed import RULES, SNIPPETS
from tidemark.sources.views import RequestError
from tidemark.versions import Versions


def test_layers_are_merged_in_order(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"default": {"focus": ["x"], "n": {"deep": [1]}}, "rules": [{"path": "*.z", "rule": "r"}]}')
    (tmp_path / "b.json").write_text('{"default": {"focus": ["y", "x"], "n": {"deep": [2], "more": true}}, "rules": [{"path": "q/*"}]}')
    made = rules.load_rules(spark, [str(tmp_path / n) for n in ("a.json", "none.json", "b.json")])
    assert made["default"] == {"focus": ["x", "y", "x"], "n": {"deep": [1, 2], "more": True}} and [r["path"] for r in made["rules"]] == ["*.z", "q/*"]
    files = spark.createDataFrame([("a.c", "C"), ("d/b.z", "Z"), ("q/b.c", None)], "path string, language string")
    got = {r.path: r for r in rules.resolved(files, made).collect()}
    assert got["a.c"].focus == ["x", "y"] and got["a.c"].settings == {"n.deep": "[1, 2]", "n.more": "true"} and got["a.c"].matched_rule_id is None
    assert (got["d/b.z"].focus, got["d/b.z"].matched_rule_id, got["d/b.z"].resolution) == (["r"], "rule-1", "first-match")
    assert (got["q/b.c"].focus, got["q/b.c"].matched_rule_id) == ([], "rule-2")


def test_suffixes_globs_and_kinds(spark):
    files = spark.createDataFrame([(p, "") for p in ("x.C", ".c", "a.tar.c", "c", "d/.h.c", "e.", "src1.c", "w\\y.c")], "path string, language string")
    data = {"default": {"v": ["d"]}, "languages": [{"extensions": [".c"], "v": ["ext"]}], "path_rules": [{"pattern": "src[0-9].?", "v": "one"}, {"pattern": "c1.c", "v": ["after"]}]}
    got = {r.path: r.settings["v"] for r in rules.resolved(files, data).collect()}
    assert {p for p, v in got.items() if "ext" in v} == {"x.C", "a.tar.c", "d/.h.c", "w\\y.c"} and got[".c"] == '["d"]' and got["src1.c"] == '["after"]', "a list after a plain value begins anew"
    with pytest.raises(RequestError):
        rules.resolved(files, {"default": {"a": {"b": 1}}, "languages": [{"language": "x", "a": 2}]})
    assert rules.resolved(files, {}).first().focus == [] and rules.resolved(files.limit(0), RULES).count() == 0


def test_lookups_read_one_bucket(spark, tmp_path):
    store = Versions(spark, str(tmp_path / "s"), 4)
    tree = spark.createDataFrame([("b.c", "int run(int a);\nint run(int a) {\n  return help(a) + run(a);\n}\n"), ("a.c", "int main(void) {\n  run(1);\n  Run(2);\n}\nstatic int help(int b);\n"), ("n.c", None)], "path string, text string")
    index = SymbolIndex.build(store, tree)
    found = index.find_definition("mod::RUN", "./b.c")
    assert [(r.path, r.line, r.is_definition) for r in found.orderBy("place").collect()] == [("b.c", 2, True), ("b.c", 1, False)]
    assert len(store.read("definition").inputFiles()) > len(store.lookup("definition", ["run"]).inputFiles()) == 1
    assert [(r.path, r.line, r.reference_kind) for r in index.find_references("run", declarations=True).orderBy("place").collect()] == [("a.c", 2, "call"), ("a.c", 3, "call"), ("b.c", 1, "definition"), ("b.c", 2, "definition"), ("b.c", 3, "call")]
    assert [r.truncated for r in index.find_references("run", limit=2).collect()] == [True, True] and index.find_references("run", "a.c").count() == 2
    assert {(r.caller, r.callee) for r in index.call_graph("main", "outgoing", 2).collect()} == {("main", "run"), ("main", "Run"), ("run", "help"), ("run", "run")}
    assert {(r.caller, r.callee) for r in index.call_graph("help", "incoming").collect()} == {("run", "help")}
    assert tuple(index.stats().first()) == (3, 4, 4, 4)
    for bad in ("", "a b", "x" * 300):
        with pytest.raises(RequestError):
            index.find_definition(bad)
    old = index.version
    SymbolIndex.build(store, tree.where("path = 'a.c'"))
    assert SymbolIndex(store).stats().first().files_indexed == 1 and SymbolIndex(store, old).find_definition("run").count() == 2


def test_a_hook_that_follows_the_rules_gives_their_issues(spark):
    lines = spark.createDataFrame([(f"p{n % 3}", lang, n, code) for lang in ("C", "Python", "Go") for n, (code, _, _) in enumerate(SNIPPETS)] + [("p", "C", 99, None)], "path string, language string, line_no int, code string")

    def hook(batches):
        for b in batches:
            rows = []
            for r in b.to_pylist():
                low = (r["code"] or "").lower()
                for rule, lang, some, every, none, kind, severity, confidence in issues.RULES:
                    if r["code"] is not None and lang in ("", r["language"]) and (not some or any(w in low for w in some)) and all(w in low for w in every) and not any(w in low for w in none):
                        rows.append({"confidence": confidence, "path": r["path"], "line_no": r["line_no"], "rule_id": rule, "type": kind, "severity": severity, "existing_code": r["code"].strip()})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("confidence", pa.float64()), ("path", pa.string()), ("line_no", pa.int32()), ("rule_id", pa.string()), ("type", pa.string()), ("severity", pa.int32()), ("existing_code", pa.string())]))

    own, built_in = (sorted(map(tuple, tools.reviewed(lines, h).collect())) for h in (hook, None))
    assert own == built_in and {r[2] for r in own} == {r[0] for r in issues.RULES}
    as_rows = sorted(map(tuple, issues.detected(lines, issues.rule_table(spark)).select(*tools.reviewed(lines).columns).collect()))
    assert as_rows == built_in
    with pytest.raises(Exception, match="left out"):
        tools.reviewed(lines, lambda batches: (b.select(["path"]) for b in batches)).collect()


def test_diffs_and_files_are_read_in_parts(spark):
    t = spark.createDataFrame([("a", ["1", "2", "3"]), ("b", [])], "path string, diff_lines array<string>")
    got = tools.file_read_diff(t, ["a", "./a", "b", "none", ""] + ["a"] * 30, 2)
    rows = sorted(map(tuple, got.collect()), key=str)
    assert [r for r in rows if r[0] == 0] == [(0, "a", 3, 2, "2"), (0, "a", 3, 3, "3")] and [r for r in rows if r[0] in (2, 3)] == [(2, "b", 0, None, None), (3, "none", None, None, None)]
    assert max(r[0] for r in rows) == 19
    tree = spark.createDataFrame([("a", "x\ny\nz")], "path string, text string")
    assert [tuple(r) for r in tools.read_file(tree, "./a", 2).collect()] == [(2, "y", 3), (3, "z", 3)] and tools.read_file(tree, "none").count() == 0
    assert [r.line for r in tools.read_file(tree, "a", 1, 9, 2).collect()] == ["x", "y"]


def test_a_context_is_compressed_again_and_again(spark):
    roles = ["system", "user"] + ["assistant", "tool", "user"] * 12
    df = spark.createDataFrame([(c, n, r, "x" * 40) for c in (1, 2) for n, r in enumerate(roles)] + [(3, 0, "assistant", None), (3, 1, "assistant", "y" * 4000), (3, 2, "user", ""), (3, 3, "assistant", "z")], "conv_id long, turn long, role string, text string")
    got = sorted(map(tuple, rollup.compressions(df.repartition(5), 200, 0.5, 0.8, 0, 3, 20).collect()))
    one = [g[1:] for g in got if g[0] == 1]
    assert one == [g[1:] for g in got if g[0] == 2]
    # a hundred tokens are ten messages: the eighth after the first two is before round 4
    assert [(g[1], g[2], g[3]) for g in one][:4] == [(1, 20, None), (2, 50, None), (3, 80, None), (4, 110, "token")] and one[3][4] == 6 and one[3][5] == (5 * 40 + 20) // 4
    assert sum(g[3] == "token" for g in one) > 2 and all(g[5] < 160 for g in one)
    # a conversation that is past the hard limit with nothing to leave out is stopped
    assert [g[1:] for g in got if g[0] == 3] == [(0, 1, 1, None, 0, 1, False), (1, 2, 1, None, 0, 1, False), (3, 3, 1000, None, 0, 1000, True)] or [g[7] for g in got if g[0] == 3][-1]
    by_round = [g for g in rollup.compressions(df, 10_000, 0.5, 0.8, 3, 3, 20).collect() if g.conv_id == 1 and g.trigger]
    assert {g.round for g in by_round} == {4, 7, 10} and all(g.trigger == "round" for g in by_round)
