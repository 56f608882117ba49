"""Queries over small tables of all ids, against brute force."""

import os
import random
import re

from tidemark.plans import catalog


def stored(spark, tmp_path, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_call_graph_walks_all_edges(spark, tmp_path):
    rng = random.Random(1)
    rows = [(7, 900), (7, 3), (5_000, 900), (5_000, 40), (199, 40), (8, 41), *((rng.randrange(300, 400), rng.randrange(1, 60)) for _ in range(150))]
    edges = {(f"f{p}", f"f{s + 1_000_000}") for p, s in rows} | {(f"f{s + 1_000_000}", f"f{p}") for p, s in rows}
    seen, frontier, want = {"f7"}, {"f7"}, set()
    for _ in range(3):
        step = {e for e in edges if e[0] in frontier}
        want |= step
        frontier = {b for _, b in step} - seen
        seen |= frontier
    got = catalog.QUERIES["call_graph_bfs"](spark, stored(spark, tmp_path, "lineitem", rows, "l_partkey long, l_suppkey long")).collect()
    assert sorted((r.caller, r.callee) for r in got) == sorted(want)
    assert ("f1000900", "f5000") in want


def test_duplicate_groups_of_all_events(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, rng.choice(["view", "error"]), rng.randrange(60)) for i in rng.sample(range(6_000), 150)]
    by, second = {}, {}
    for i, t, u in sorted(rows):
        by.setdefault((t, u), []).append(i)
        if len(by[t, u]) == 2:
            second[t, u] = i
    number = {k: n for n, k in enumerate(sorted(second, key=second.get), 1)}
    want = sorted((i, number.get((t, u)), by[t, u][0] if i != by[t, u][0] else None) for i, t, u in rows)
    df = catalog.QUERIES["duplicate_groups"](spark, stored(spark, tmp_path, "events", rows, "event_id long, event_type string, user_id long"))
    assert "windowspecdefinition(id#" not in df._jdf.queryExecution().toString()
    assert sorted((r.id, r.group_id, r.duplicate_of) for r in df.collect()) == want


def test_merged_issues_of_all_blocks(spark, tmp_path):
    rng = random.Random(3)
    rows = [(n, rng.choice([3, 39, 80, 117]), rng.randrange(1, 21), rng.choice([1, 2]), rng.choice("AR"), rng.choice("FO"), float(rng.randrange(1, 4))) for n in range(120)]
    folded, want = set(), []
    for _, part, _, number, flag, _, quantity in rows:
        # without rules and code only issues of one key merge, and one of each key survives
        key = (part, int(quantity), number, flag)
        want.append((f"src/f{part}.c", part % 40, int(quantity), key not in folded))
        folded.add(key)
    schema = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_returnflag string, l_linestatus string, l_quantity double"
    got = catalog.QUERIES["merged_issues"](spark, stored(spark, tmp_path, "lineitem", rows, schema)).collect()
    assert sorted((r.file_name, r.block_id, r.issue_id, r.survivor) for r in got) == sorted(want)
    assert {b for _, b, _, _ in want} >= {3, 39, 37} and not all(w[3] for w in want)


def test_group_safety_of_all_parts(spark, tmp_path):
    rng = random.Random(4)
    rows = [(n, rng.choice(["STEEL", "steel "]), rng.randrange(1, 4), "B1", "red bolt") for n in range(1, 40)]
    rows += [(40, "TIN", 7, "B1", "a"), (41, "TIN", 7, "B1", "b"), (45, "BRASS", 7, "B1", "c"), (46, "TIN", 8, "B1", "a"), (49, "TIN", 8, "B1", "b"), (54, "TIN", 9, "B1", "a"), (55, "TIN", 9, "B2", "a"), (63, "TIN", 9, "B1", "a")]
    groups = {}
    for _, kind, size, brand, _ in rows:
        groups.setdefault(size, []).append((kind.strip().lower(), brand))
    want = sorted((size, len(g) > 1 and len(set(g)) == 1) for size, g in groups.items())
    got = catalog.QUERIES["semantic_group_safety"](spark, stored(spark, tmp_path, "part", rows, "p_partkey long, p_type string, p_size int, p_brand string, p_name string")).collect()
    assert sorted((r.group_id, r.safe) for r in got) == want
    assert {s for _, s in want} == {True, False}


def test_merged_usage_of_all_events(spark, tmp_path):
    rng = random.Random(5)
    rows = [(rng.randrange(50), rng.choice(["view", "view", "error"])) for _ in range(200)]
    counts = {}
    for u, t in rows:
        of = counts.setdefault(u % 20 - u % 2, {})
        of[t] = of.get(t, 0) + 1
    got = catalog.QUERIES["merged_usage"](spark, stored(spark, tmp_path, "events", rows, "user_id long, event_type string")).collect()
    assert {r.p: r.counts for r in got} == {p: ", ".join(f"{k}={n}" for k, n in sorted(of.items())) for p, of in counts.items()}


FUNCTION = re.compile(r"^[\t ]*(?:[A-Za-z_]\w*[\t ]+|[*][\t ]*)+([A-Za-z_]\w*)[\t ]*\([^;{}]*\)[\t ]*\{", re.MULTILINE)


def test_related_files_read_all_texts(spark, tmp_path):
    prose = " ".join(["word"] * 20_000)
    texts = {
        3: f"int helper (int x) {{\n}}\nint * other(void) {{\n}}\n{prose}", 6: "int main(void) {\n helper(1);\n}\n", 603: "see 'd7.py' and \"./D8.txt\"", 9: "void far(void) {\n other(); main(1);\n}\n",
        1: "open('d3.c')", 4: "helper(1); 'nothing'", 7: "read \"../en/d2\"", 2: "", 8: "it's 'web/en/d5.txt' here", 5: prose, 12: 'include "d3.h"',
    }
    rows = [(i, t, "en" if i != 9 else "de", "web") for i, t in texts.items()]
    files = {}
    for i, t, lang, source in rows:
        files.setdefault(f"{source}/{lang}/d{i % 200}" + (".c", ".py", ".txt")[i % 3], []).append(t)
    files |= {p[:-1] + "h": [""] for p in files if p.endswith(".c")}
    quoted = {p: {q for t in ts for q in re.findall(r"""["']([^"'\r\n]+)["']""", t)} for p, ts in files.items()}
    defined = {p: {m for t in ts for m in FUNCTION.findall(t)} if p.endswith(".c") else set() for p, ts in files.items()}
    called = {p: {m for t in ts for m in re.findall(r"\b([A-Za-z_]\w*)\s*\(", t)} - defined[p] if p.endswith(".c") else set() for p, ts in files.items()}

    def refers(a, b):
        near = os.path.relpath(b, os.path.dirname(a))
        names, (stem, ext) = {b, b.rsplit("/", 1)[1], near, b.rsplit(".", 1)[0], near.rsplit(".", 1)[0]}, b.rsplit("/", 1)[1].split(".")
        for r in (q.removeprefix("./").lower() for q in quoted[a]):
            last = r.rsplit("/", 1)[-1].rsplit(".", 1)
            if {r, r.removeprefix("../")} & names or r.endswith("/" + b.rsplit("/", 1)[1]) or (len(last) == 2 and last[0] == stem and {last[1], ext} == {"c", "h"}):
                return True
        return False

    want = []
    for a in files:
        scores = []
        for b in set(files) - {a}:
            (x, e), (y, f) = (p.rsplit("/", 1)[1].split(".") for p in (a, b))
            of = [100] * (x == y and {e, f} == {"c", "h"}) + [95] * bool(called[a] & defined[b]) + [90] * refers(a, b) + [88] * bool(called[b] & defined[a]) + [85] * refers(b, a)
            scores += [(-max(of), b)] if of else []
        want += [(a, b, -s) for s, b in sorted(scores)[:8]]
    got = catalog.QUERIES["related_files"](spark, stored(spark, tmp_path, "documents", rows, "doc_id long, text string, lang string, source string")).collect()
    assert sorted((r.path, r.related, r.score) for r in got) == sorted(want)
    assert {s for _, _, s in want} == {100, 95, 90, 88, 85}
