"""Issues: detection by rules, evidence, corroboration, filtering and deduplication."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher
from itertools import chain, groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.numeric import location_confidence
from tidemark.functions.status import reportable
from tidemark.functions.text import code_key, jaccard, lines_key, numbers, parse_diff_line, split_lines, squeeze, text_key, word_set
from tidemark.operators.ranges import overlapping

#: A rule's language ('' for any), what the lower-cased line must hold (one of any, all of all, none of none), and what it says.
RULES = [
    ("dynamic-execution", "", ["eval(", "exec("], [], [], "security", 5, 0.9),
    ("credential", "", ["password", "secret", "api_key", "access_token"], [], [], "security", 4, 0.75),
    ("unbounded-copy", "C", ["strcpy(", "strcat("], [], [], "security", 5, 0.9),
    ("unbounded-scan", "C", [], ["sscanf(", "%s"], ["%31s"], "security", 4, 0.85),
    ("format-string", "C", ["printf(message)", "fprintf(file, message)"], [], [], "security", 5, 0.9),
    ("zero-division", "C", [], ["/ right"], [], "logic", 4, 0.8),
    ("missing-argument", "C", [], ["argv[2]"], [], "logic", 4, 0.85),
    ("unfinished", "", ["todo", "fixme"], [], [], "readability", 2, 0.7),
    ("swallowed-exception", "Python", [], ["except exception", "pass"], [], "logic", 3, 0.8),
]
#: Words in a finding that support an issue of a type.
SUPPORT = {
    "security": ["security", "cwe", "injection", "xss", "taint", "overflow", "bounds", "secret", "traversal"],
    "logic": ["bug", "null", "overflow", "uninitialized", "deadlock", "leak", "resource", "incorrect"],
    "performance": ["performance", "complexity", "allocation", "quadratic", "slow"],
    "readability": ["readability", "maintainability", "confusing"],
    "code_style": ["style", "convention", "format"],
}
LEAST_CONFIDENCE, LEAST_SIMILARITY = 0.45, 0.55


def rule_table(spark: SparkSession) -> DataFrame:
    """The rules, as many rows as there are: small by construction."""
    schema = "rule_id string, rule_language string, any array<string>, all array<string>, none array<string>, type string, severity int, confidence double"
    return spark.createDataFrame(RULES, schema)


def detected(lines: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Issues of added lines (path, language, line_no, code), by the rules that hold for them. The built-in rules are one array, filtered for each line; others
    are joined as Spark finds fit."""
    low = F.lower("code")
    # with the rule's fields as columns, or as those of an array's element
    holds = lambda r: ((r("rule_language") == "") | (r("rule_language") == F.col("language"))) & ((F.size(r("any")) == 0) | F.exists(r("any"), lambda t: F.contains(low, t))) & F.forall(r("all"), lambda t: F.contains(low, t)) & ~F.exists(r("none"), lambda t: F.contains(low, t))
    said = ("rule_id", "type", "severity", "confidence")
    if rules is not None:
        return lines.join(rules, holds(F.col)).select("path", "line_no", *said, F.trim("code").alias("existing_code"))
    words = lambda w: F.array(*map(F.lit, w)).cast("array<string>")
    fields = ("rule_id", "rule_language", "any", "all", "none", "type", "severity", "confidence")
    every = F.array(*(F.struct(*((words(v) if isinstance(v, list) else F.lit(v)).alias(k) for k, v in zip(fields, r, strict=True))) for r in RULES))
    hits = lines.where("code is not null").select("path", "line_no", "code", F.explode(F.filter(every, lambda r: holds(lambda c: r[c]))).alias("r"))
    return hits.select("path", "line_no", *(f"r.{c}" for c in said), F.trim("code").alias("existing_code"))


def plan_scores(code: Column) -> dict[str, Column]:
    """Scores before a review, from all added code."""
    low = F.lower(code)
    has = lambda *w: F.greatest(*(F.contains(low, F.lit(x)) for x in w), F.lit(False))
    out = dict.fromkeys(("logic_score", "performance_score", "security_score", "readable_score", "code_style_score"), F.lit(90))
    out["security_score"] = F.when(has("eval(", "exec(", "password", "secret", "api_key"), 60).otherwise(90)
    out["readable_score"] = F.when(has("todo", "fixme"), 75).otherwise(90)
    out["logic_score"] = F.when(has("except exception") & has("pass"), 70).otherwise(90)
    return out


def parsed(blocks: DataFrame) -> DataFrame:
    """path, seq, line_no, marker and code of formatted diff lines."""
    rows = blocks.select("path", F.posexplode("diff_lines").alias("seq", "line")).withColumn("p", parse_diff_line(F.col("line")))
    return rows.where("p is not null").select("path", "seq", "p.*")


def reviewable_lines(lines: DataFrame) -> DataFrame:
    """Added lines, and the nearest lines on the new side before and after a run of removed ones."""
    by = Window.partitionBy("path").orderBy("seq")
    alive = F.when(F.col("marker") != "-", F.col("line_no"))
    before = F.last(alive, True).over(by.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(alive, True).over(by.rowsBetween(1, Window.unboundedFollowing))
    near = lines.withColumns({"before": before, "after": after})
    near = near.select("path", "marker", F.explode(F.when(F.col("marker") == "-", F.array("before", "after")).otherwise(F.array("line_no"))).alias("line"))
    return near.where("line is not null and marker <> ' '").select("path", "line").distinct()


def fragment_lines(code: Column) -> Column:
    """A quoted fragment's lines without white space, markers in front and blank ones."""
    bare = F.transform(split_lines(F.coalesce(code, F.lit(""))), lambda x: F.regexp_replace(x, r"(?U)^\s*[+-] ", ""))
    return F.filter(F.transform(bare, squeeze), lambda x: x != "")


def exact_matches(fragments: DataFrame, lines: DataFrame) -> DataFrame:
    """Where fragments (path, fragment_id, wanted) stand in a file's lines (path, line_no, norm, changed, source): windows of as
    many lines that aren't blank, at most 8 apart. The file's lines are one array, so nothing is joined line by line."""
    files = lines.where("norm <> ''").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("line_no", "norm", "changed"))).alias("a"))
    both = fragments.where(F.size("wanted") > 0).join(files, "path")
    w = F.size("wanted")
    start = F.filter(
        F.when(F.size("a") >= w, F.sequence(F.lit(1), F.size("a") - w + 1)).otherwise(F.array().cast("array<int>")),
        lambda i: (F.transform(F.slice("a", i, w), lambda x: x["norm"]) == F.col("wanted"))
        & F.forall(F.sequence(i, i + w - 1), lambda k: (k == i) | ((F.get(F.col("a"), k - 1)["line_no"] - F.get(F.col("a"), k - 2)["line_no"]).between(1, 8))),
    )
    hits = both.select("path", "fragment_id", F.explode(start).alias("i"), "a", w.alias("w"))
    window = F.slice("a", F.col("i"), F.col("w"))
    return hits.select("path", "fragment_id", F.get(F.col("a"), F.col("i") - 1)["line_no"].alias("start_line"), F.get(F.col("a"), F.col("i") + F.col("w") - 2)["line_no"].alias("end_line"), F.lit(1.0).alias("score"), F.exists(window, lambda x: x["changed"]).alias("on_change"))


def indexed_matches(fragments: DataFrame, lines: DataFrame, gap: int = 8) -> DataFrame:
    """The same over several sources (lines: path, source, line_no, norm, changed; sources `diff` and `file`), by an inverted index of lines.

    A fragment's rarest line, in each source of its file, leads to the places where it may stand; only these are verified, line by line by place. Every
    step is a join on keys, so neither a file's length nor the number of its fragments is squared. Spans that both sources have are the diff's.
    """
    at = ["path", "source"]
    index = lines.where("norm <> ''").select(*at, "line_no", "changed", F.md5(F.col("norm").cast("binary")).alias("h"))
    index = index.withColumn("pos", F.row_number().over(Window.partitionBy(*at).orderBy("line_no")))
    wanted = fragments.where(F.size("wanted") > 0).select("path", "fragment_id", F.size("wanted").alias("w"), F.transform("wanted", lambda x: F.md5(x.cast("binary"))).alias("hs"))
    each = wanted.select("path", "fragment_id", "w", "hs", F.posexplode("hs").alias("k", "h"))
    seeds = each.join(index.groupBy(*at, "h").agg(F.count("*").alias("times")), ["path", "h"])
    # a source that lacks a line has no place for the fragment
    seeds = seeds.groupBy(*at, "fragment_id", "w", "hs").agg(F.min(F.struct("times", "k", "h")).alias("rarest"), F.count_distinct("k").alias("found")).where("found = w")
    starts = seeds.select(*at, "fragment_id", "w", "hs", "rarest.k", "rarest.h").join(index.select(*at, "h", "pos"), [*at, "h"]).select(*at, "fragment_id", "w", "hs", (F.col("pos") - F.col("k")).alias("start")).where("start > 0")
    places = starts.select(*at, "fragment_id", "w", "start", F.posexplode("hs").alias("k", "h")).withColumn("pos", F.col("start") + F.col("k"))
    held = places.join(index, [*at, "pos", "h"]).groupBy(*at, "fragment_id", "w", "start").agg(F.array_sort(F.collect_list(F.struct("k", "line_no", "changed"))).alias("a")).where(F.size("a") == F.col("w"))
    near = F.forall(F.sequence(F.lit(0), F.col("w") - 1), lambda k: (k == 0) | (F.get(F.col("a"), k)["line_no"] - F.get(F.col("a"), k - 1)["line_no"]).between(1, gap))
    spans = held.where(near).select("path", "fragment_id", "source", F.get(F.col("a"), 0)["line_no"].alias("start_line"), F.get(F.col("a"), F.col("w") - 1)["line_no"].alias("end_line"), F.exists("a", lambda x: x["changed"]).alias("on_change"))
    best = F.min_by(F.struct("source", "on_change"), F.when(F.col("source") == "diff", 0).otherwise(1))
    spans = spans.groupBy("path", "fragment_id", "start_line", "end_line").agg(best.alias("b"))
    return spans.select("path", "fragment_id", "start_line", "end_line", F.lit(1.0).alias("score"), "b.on_change", "b.source")


def fuzzy_matches(fragments: DataFrame, lines: DataFrame, least: float = LEAST_SIMILARITY) -> DataFrame:
    """The same for fragments without an exact place: the ratio of a sequence matcher, in Python, a file at a time."""
    files = lines.where("norm <> ''").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("line_no", "norm", "changed"))).alias("a"))
    both = fragments.where(F.length(F.array_join("wanted", "\n")) >= 8).join(files, "path").select("path", "fragment_id", "wanted", "a")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, number, wanted, rows in zip(b["path"], b["fragment_id"], b["wanted"], b["a"], strict=True):
                target, w, rows = "\n".join(wanted), len(wanted), list(rows)
                for i in range(len(rows) - w + 1):
                    part = rows[i : i + w]
                    if any(not 1 <= y["line_no"] - x["line_no"] <= 8 for x, y in zip(part, part[1:], strict=False)):
                        continue
                    text = "\n".join(x["norm"] for x in part)
                    score = max(SequenceMatcher(None, target, text).ratio(), SequenceMatcher(None, target.lower(), text.lower()).ratio())
                    if score >= least:
                        out.append((path, number, part[0]["line_no"], part[-1]["line_no"], score, any(x["changed"] for x in part)))
            yield pd.DataFrame(out, columns=["path", "fragment_id", "start_line", "end_line", "score", "on_change"])

    return both.mapInPandas(run, "path string, fragment_id long, start_line int, end_line int, score double, on_change boolean")


def located(matches: DataFrame, claimed: DataFrame) -> DataFrame:
    """The best place of each fragment: on the change first, then score, then distance to the claimed line, then start. Ambiguous
    if another one ties in the first two. claimed: path, fragment_id, claimed_line (0: none)."""
    m = matches.join(claimed, ["path", "fragment_id"], "left")
    line = F.coalesce("claimed_line", F.lit(0))
    distance = F.when(line > 0, F.abs(F.col("start_line") - line)).otherwise(F.col("start_line"))
    by = Window.partitionBy("path", "fragment_id")
    m = m.withColumn("n", F.row_number().over(by.orderBy(F.desc("on_change"), F.desc("score"), distance, "start_line", "end_line")))
    top = F.first(F.struct("on_change", "score")).over(by.orderBy("n").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    m = m.withColumn("tie", (F.col("on_change") == top["on_change"]) & (F.abs(F.col("score") - top["score"]) < 0.001))
    m = m.withColumns({"occurrences": F.count("*").over(by), "ambiguous": F.count_if("tie").over(by) > 1}).where("n = 1").drop("n", "tie", "claimed_line")
    return m.withColumn("confidence", location_confidence(F.col("score"), F.col("ambiguous"), F.col("on_change")))


def relocated(on_change: Column, ambiguous: Column, inside: Column, same: Column) -> Column:
    """What a match does to an issue's lines."""
    return F.when(on_change & (~ambiguous | inside), F.when(same, "unchanged").otherwise("relocated")).otherwise("failed")


def rejection(reviewable: Column) -> Column:
    """Why an issue is filtered, the first reason of eight; null if it is kept. reviewable: the file's lines that can carry one."""
    empty = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    lines = numbers(F.col("issue_line_numbers"))
    return (
        F.when(empty("description") | empty("suggestion"), "no description or suggestion")
        .when(empty("existing_code"), "no code")
        .when(empty("evidence"), "no evidence")
        .when(F.size(lines) == 0, "no line")
        .when(F.col("relocation_status") == "failed", "not relocated")
        .when(F.coalesce("confidence_level", F.lit(0.8)) < LEAST_CONFIDENCE, "low confidence")
        .when(F.col("evidence_match_score") < LEAST_SIMILARITY, "code doesn't match")
        .when((F.size(reviewable) > 0) & ~F.arrays_overlap(lines, reviewable), "line isn't under review")
    )


def corroborated(issues: DataFrame, findings: DataFrame) -> DataFrame:
    """Findings that support issues (issue_id, file_name, rule_id, type, description, evidence, start_line, end_line): they overlap, and share
    the rule, a tenth of their words, a word of the issue's type, or the exact lines of an error."""
    f = findings.select("file_name", F.col("rule_id").alias("f_rule"), F.col("message"), F.col("level"), F.col("analyzer"), F.col("fingerprint"), F.col("start_line").alias("f_start"), F.col("end_line").alias("f_end"))
    f = f.withColumn("f_words", word_set(F.concat_ws(" ", "f_rule", "message")))
    i = issues.where("start_line > 0").withColumn("words", word_set(F.concat_ws(" ", "type", "description", "evidence")))
    support = F.create_map(*(x for k, v in SUPPORT.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    both = overlapping(i, f, "file_name", ("start_line", "end_line"), ("f_start", "f_end"))
    same = (F.coalesce("rule_id", F.lit("")) != "") & (F.lower("rule_id") == F.lower("f_rule"))
    of_type = F.coalesce(F.arrays_overlap("f_words", F.try_element_at(support, F.lower("type"))), F.lit(False))
    exact = (F.col("level") == "error") & (F.col("f_start") == F.col("start_line")) & (F.col("f_end") == F.col("end_line"))
    both = both.where(same | (jaccard(F.col("f_words"), F.col("words")) >= 0.1) | of_type | exact)
    return both.groupBy("issue_id").agg(*(F.array_sort(F.collect_set(c)).alias(n) for c, n in (("analyzer", "sources"), (F.nullif("f_rule", F.lit("")), "rule_ids"), ("fingerprint", "fingerprints"))), F.lit(0.95).alias("least_confidence"))


def merge_key() -> Column:
    return F.struct(text_key(F.col("type")).alias("t"), F.col("severity").alias("s"), lines_key(F.col("issue_line_numbers")).alias("l"), text_key(F.col("description")).alias("d"), text_key(F.col("suggestion")).alias("g"))


def exact_groups(issues: DataFrame, order: list[str]) -> DataFrame:
    """issues with `first`, whether each is the first of its key, and `copies`, how many have it."""
    by = Window.partitionBy(merge_key())
    return issues.withColumns({"first": F.row_number().over(by.orderBy(*order)) == 1, "copies": F.count("*").over(by)})


def similar_pairs(rows: DataFrame, key: str, by: list[str], words: Column, least: float) -> DataFrame:
    """a, b and similarity of rows with equal `by` whose word sets have at least this Jaccard similarity; key: a row's id, a < b.

    Rows of one set are a class, and its pairs have similarity 1. Classes meet by their sizes, where these allow as much similarity, and by a word of both prefixes: a
    set's words, the rarest first, without the last ones that can't be all that is shared. Only pairs of classes that were found are dealt to rows.
    """
    rows = rows.select(key, *by, F.array_sort(F.array_distinct(words)).alias("_set")).where(F.size("_set") > 0).repartition(*by, "_set")
    classes = rows.select(*by, "_set").distinct()
    each = classes.select(*by, "_set", F.explode("_set").alias("_word"))
    times = each.groupBy(*by, "_word").agg(F.count("*").alias("_times"))
    order = each.join(times, [*by, "_word"]).groupBy(*by, "_set").agg(F.array_sort(F.collect_list(F.struct("_times", "_word"))).alias("_rare"))
    n, slack = F.size("_set"), 1e-9
    # the other set's size, and what two different sets of these sizes share at most and at least
    sizes = order.withColumn("_m", F.explode(F.sequence(F.ceil(n * least - slack), F.floor(n / least + slack)))).withColumn("_least", F.ceil((n + F.col("_m")) * (least / (1 + least)) - slack))
    sizes = sizes.where(F.col("_least") <= F.least(n, F.col("_m")) - F.when(n == F.col("_m"), 1).otherwise(0))
    prefix = sizes.select(*by, "_set", n.cast("long").alias("_n"), "_m", F.explode(F.slice("_rare", 1, (n - F.col("_least") + 1).cast("int"))).alias("_w"))
    x = prefix.where("_n <= _m").select(*by, F.col("_set").alias("_x"), F.col("_n").alias("_low"), F.col("_m").alias("_high"), "_w._word")
    y = prefix.where("_n >= _m").select(*by, F.col("_set").alias("_y"), F.col("_m").alias("_low"), F.col("_n").alias("_high"), "_w._word")
    met = x.join(y, [*by, "_low", "_high", "_word"]).where((F.col("_low") < F.col("_high")) | (F.col("_x") < F.col("_y"))).select(*by, "_x", "_y").distinct()
    met = met.withColumn("similarity", jaccard(F.col("_x"), F.col("_y"))).where(F.col("similarity") >= least)
    one = rows.select(*by, F.col("_set").alias("_x"), F.col(key).alias("_p"))
    two = rows.select(*by, F.col("_set").alias("_y"), F.col(key).alias("_q"))
    across = met.join(one, [*by, "_x"]).join(two, [*by, "_y"]).where("_p <> _q").select(F.least("_p", "_q").alias("a"), F.greatest("_p", "_q").alias("b"), "similarity")
    inside = one.join(two.withColumnRenamed("_y", "_x"), [*by, "_x"]).where("_p < _q").select(F.col("_p").alias("a"), F.col("_q").alias("b"), F.lit(1.0).alias("similarity"))
    return inside.unionByName(across)


def merged_in_file(issues: DataFrame) -> DataFrame:
    """issue_id and survivor of a file's issues (file_name, block_id, issue_id, ...), in order: one that equals an earlier survivor
    goes, unless only it is reportable, when it takes the place. Order decides, so a file's issues are folded together. Ids may repeat: rows are judged."""
    ready = issues.select(
        "file_name", "block_id", "issue_id", F.to_json(merge_key()).alias("key"), text_key(F.col("type")).alias("t"), "severity", F.array_distinct(numbers(F.col("issue_line_numbers"))).alias("lines"),
        F.coalesce("rule_id", F.lit("")).alias("rule"), code_key(F.col("existing_code")).alias("code"), word_set(F.col("description")).alias("words"), reportable(F.col("filter_status")).alias("shown"),
    )

    def equal(a: dict, b: dict) -> bool:
        if a["key"] == b["key"]:
            return True
        if (a["t"], a["severity"]) != (b["t"], b["severity"]) or not set(a["lines"]) & set(b["lines"]):
            return False
        if not (a["rule"] and a["rule"] == b["rule"]) and not (a["code"] and a["code"] == b["code"]):
            return False
        x, y = set(a["words"]), set(b["words"])
        return bool(x and y) and len(x & y) / len(x | y) >= 0.65

    def fold(rows: list[dict]) -> list[bool]:
        """Whether each of a file's issues, in order, survives."""
        slots: list[dict] = []
        by_key: dict[str, int] = {}
        by_line: dict[tuple, set[int]] = {}  # only issues of one type and severity that share a line can be equal
        for n, r in enumerate(rows):
            r["n"], places = n, [(r["t"], r["severity"], x) for x in r["lines"]]
            at = by_key.get(r["key"])
            if at is None:
                at = next((k for k in sorted(set().union(*(by_line.get(p, ()) for p in places))) if equal(slots[k], r)), None)
            if at is None:
                at = len(slots)
                slots.append(r)
            elif r["shown"] and not slots[at]["shown"]:
                old, slots[at] = slots[at], r
                del by_key[old["key"]]
                for x in old["lines"]:
                    by_line[old["t"], old["severity"], x].discard(at)
            else:
                continue
            by_key[r["key"]] = at
            for p in places:
                by_line.setdefault(p, set()).add(at)
        alive = {s["n"] for s in slots}
        return [n in alive for n in range(len(rows))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("file_name", pa.string()), ("block_id", pa.int32()), ("issue_id", pa.int32()), ("survivor", pa.bool_())])
        rows = chain.from_iterable(b.to_pylist() for b in batches)
        made: list[tuple] = []
        batch = lambda part: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), schema, strict=True)], schema=schema)
        for _, group in groupby(rows, key=lambda r: r["file_name"]):
            own = list(group)
            made += [(r["file_name"], r["block_id"], r["issue_id"], survives) for r, survives in zip(own, fold(own), strict=True)]
            if len(made) >= 8192:  # of many files: most have few issues
                yield batch(made)
                made = []
        if made:
            yield batch(made)

    order = ["file_name", "block_id", "issue_id", "key", "shown", "rule", "code"]
    return ready.repartition("file_name").sortWithinPartitions(*order).mapInArrow(run, "file_name string, block_id int, issue_id int, survivor boolean")


def numbered(issues: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """issues with a number from 0 in its block, and a visible one from 1 (0 if filtered)."""
    w = Window.partitionBy(*by).orderBy(*order)
    shown = reportable(F.col("filter_status"))
    seen = F.sum(F.when(shown, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return issues.withColumns({"number": F.row_number().over(w) - 1, "visible_number": F.when(shown, seen).otherwise(F.lit(0))})


#: Words in an issue's text, and what the line that it means may hold, in order; and words that say nothing.
HINTS = [
    (["strcpy", "strcat", "buffer", "overflow", "缓冲", "溢出"], ["strcpy(", "strcat("]),
    (["sscanf", "%s"], ["sscanf(", "%s"]),
    (["format", "printf", "格式化"], ["printf(", "fprintf("]),
    (["divide", "division", "除数", "除法"], ["/ right", "/right"]),
    (["argv", "参数", "越界"], ["argv["]),
    (["eval", "exec"], ["eval(", "exec("]),
    (["secret", "password", "api_key", "token", "敏感"], ["secret", "password", "api_key", "token"]),
    (["todo", "fixme", "未完成"], ["todo", "fixme"]),
]
SAYS_NOTHING = ("issue", "line", "code", "suggestion", "description", "security", "logic", "performance", "readability", "style")


def guessed_lines(found: DataFrame, lines: DataFrame) -> DataFrame:
    """path, issue_id and the added line (path, line_no, code) that an issue's text (type, description, suggestion) means: the first line that fits
    its first hint, else the first of those with most of its words; no row without one."""
    spark = found.sparkSession
    said = found.select("path", "issue_id", F.lower(F.concat_ws(" ", "type", "description", "suggestion")).alias("said"))
    low = lines.select("path", "line_no", F.lower("code").alias("low"))
    hints = F.broadcast(spark.createDataFrame([(i, *h) for i, h in enumerate(HINTS)], "n int, hints array<string>, patterns array<string>"))
    holds = lambda text, words: F.exists(words, lambda w: F.contains(F.col(text), w))
    hinted = said.join(hints, holds("said", "hints")).join(low, "path").where(holds("low", "patterns"))
    hinted = hinted.groupBy("path", "issue_id").agg(F.min_by("line_no", F.struct("n", "line_no")).alias("line_no"))
    words = F.slice(F.array_distinct(F.filter(F.regexp_extract_all("said", F.lit("([A-Za-z_][A-Za-z0-9_]{2,})"), F.lit(1)), lambda w: ~w.isin(*SAYS_NOTHING))), 1, 12)
    rest = said.join(hinted, ["path", "issue_id"], "left_anti").withColumn("words", words).join(low, "path")
    rest = rest.withColumn("score", F.size(F.filter("words", lambda w: F.contains("low", w)))).where("score > 0")
    worded = rest.groupBy("path", "issue_id").agg(F.min_by("line_no", F.struct(-F.col("score"), F.col("line_no"))).alias("line_no"))
    return hinted.unionByName(worded)
