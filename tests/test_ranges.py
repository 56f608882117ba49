"""Range joins, the index of lines, grouped places, answers one after another."""

import random
import time

from pyspark.sql import functions as F

from tidemark.operators import answers, diffs, issues, ranges
from tidemark.shared import ranked


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_overlaps_match_all_pairs(spark):
    rng = random.Random(3)
    a = [(i, rng.choice("xy"), s, s + rng.choice([-1, 0, 3, 70, 400])) for i in range(150) for s in [rng.randrange(300)]] + [(900, "x", None, 5), (901, None, 1, 5)]
    b = [(i, rng.choice("xyz"), s, s + rng.choice([0, 1, 40])) for i in range(150) for s in [rng.randrange(300)]]
    want = sorted((i, j) for i, f, s, e in a for j, g, t, u in b if f == g and s is not None and s <= e and s <= u and t <= e)
    left, right = spark.createDataFrame(a, "i int, f string, a1 int, a2 int"), spark.createDataFrame(b, "j int, f string, b1 int, b2 int")
    for width in (1, 7, 32, 10_000):
        assert sorted(map(tuple, ranges.overlapping(left, right, "f", ("a1", "a2"), ("b1", "b2"), width).select("i", "j").collect())) == want


def test_a_long_file_tests_about_the_pairs_it_finds(spark):
    a = spark.range(20_000).select(F.lit("f").alias("f"), (F.col("id") * 5).alias("a1"), (F.col("id") * 5 + 9).alias("a2"))
    b = spark.range(100_000).select(F.lit("f").alias("f"), F.col("id").alias("b1"), F.col("id").alias("b2"))
    found = ranges.overlapping(a, b, "f", ("a1", "a2"), ("b1", "b2")).count()
    tested = ranges._cut(a, F.col("a1"), F.col("a2"), ranges.WIDTH, "l").join(ranges._cut(b, F.col("b1"), F.col("b2"), ranges.WIDTH, "r"), ["f", "_bucket"]).count()
    assert found == 200_000 - 5 and tested < 5 * found


def test_indexed_matches_are_the_array_ones(spark):
    rng = random.Random(5)
    lines = [(p, n, rng.choice(["a", "b", "c", "dd", "", "e"]), n % 4 == 0) for p in ("x", "y") for n in range(1, 90) if rng.random() < 0.7]
    frags = [(p, k, [rng.choice(["a", "b", "c", "dd", "e"]) for _ in range(1 + k % 4)]) for p in ("x", "y", "z") for k in range(40)] + [("x", 99, []), ("y", 98, ["none"])]
    f = spark.createDataFrame(frags, "path string, fragment_id long, wanted array<string>")
    df = spark.createDataFrame(lines, "path string, line_no int, norm string, changed boolean")
    want = rows(issues.exact_matches(f, df).select("path", "fragment_id", "start_line", "end_line", "on_change"))
    got = issues.indexed_matches(f, df.withColumn("source", F.lit("file")))
    assert rows(got.select("path", "fragment_id", "start_line", "end_line", "on_change")) == want and len(want) > 50
    # the diff's side comes first where both have a span; what only one has stays
    part = df.where("line_no > 30").withColumns({"source": F.lit("diff"), "changed": F.lit(True)})
    both = issues.indexed_matches(f, df.withColumn("source", F.lit("file")).unionByName(part)).collect()
    assert {(r.path, r.fragment_id, r.start_line, r.end_line) for r in both} == {tuple(w[:4]) for w in want}
    assert all((r.source == "diff") == (r.start_line > 30) and (r.on_change or r.source == "file") for r in both)


def test_places_within_groups(spark):
    data = [(g, v) for g, n in (("a", 500), (None, 40), ("b", 1), ("c", 77)) for v in range(n)]
    random.Random(1).shuffle(data)
    got = ranked(spark.createDataFrame(data, "g string, v int").repartition(7), F.col("v"), by=("g",)).collect()
    assert len(got) == len(data) and all(r["rank"] == r.v for r in got)
    assert sorted(r["rank"] for r in ranked(spark.createDataFrame(data, "g string, v int"), F.col("v"), F.col("g")).collect()) == list(range(len(data)))
    assert ranked(spark.createDataFrame([], "g string, v int"), F.col("v"), by=("g",)).count() == 0


def test_blocks_of_twice_the_text_take_twice_the_time(spark):
    def took(n):
        df = spark.createDataFrame([("\n".join(f"line {i} of some text" for i in range(n)),)], "t string").select(diffs.split_blocks(F.split("t", "\n"), 40).alias("b"))
        began = time.time()
        assert sum(len(b) for b in df.first().b) == n
        return time.time() - began

    took(1000)
    short, long = min(took(10_000) for _ in range(2)), min(took(40_000) for _ in range(2))
    assert long < 9 * max(short, 0.3), "four times the text"


def test_answers_are_taken_one_after_another(spark):
    issue = spark.createDataFrame([("f", 1, "7", "old", "", None), ("f", 2, "", "c", None, 0.4), ("f", 3, "9", "c", "8", None)], "path string, issue_id int, issue_line_numbers string, existing_code string, original_issue_line_numbers string, evidence_match_score double")
    said = [
        ("f", 1, 0, "12", "new", "relocated", "a", "matched", "0.9"), ("f", 1, 1, "", "", "", "", "", None),
        ("f", 2, 0, "5", "", "failed", "b", "", "x"), ("f", 2, 1, "6", "", "failed", "c", "partial", "7"),
        ("f", 9, 0, "1", "", "", "", "", None),
    ]
    said = spark.createDataFrame(said, "path string, issue_id int, place int, issue_line_numbers string, existing_code string, relocation_status string, relocation_description string, evidence_match_status string, evidence_match_score string")
    got = {r.issue_id: r for r in answers.relocation_applied(issue, said).collect()}
    assert (got[1].issue_line_numbers, got[1].existing_code, got[1].original_issue_line_numbers, got[1].relocation_status) == ("12", "new", "7", "unchanged")
    assert (got[1].evidence_match_status, got[1].evidence_match_score, got[1].re_review_status, got[1].re_review_description) == ("matched", 0.9, 0, "")
    assert (got[2].issue_line_numbers, got[2].original_issue_line_numbers, got[2].evidence_match_status, got[2].evidence_match_score, got[2].re_review_status, got[2].re_review_description) == ("6", "5", "partial", 1.0, 1, "c")
    assert (got[3].issue_line_numbers, got[3].original_issue_line_numbers, got[3].relocation_status, got[3].evidence_match_status) == ("9", "8", None, None) and len(got) == 3
    decided = spark.createDataFrame([("f", 1, 0, "filtered", "r", "seen", "0.3"), ("f", 1, 1, "kept", "r2", "", None), ("f", 3, 0, "FILTERED", "r", "  ", "no")], "path string, issue_id int, place int, filter_status string, filter_reason string, counter_evidence string, confidence_level string")
    got = {r.issue_id: r for r in answers.filter_applied(issue, decided).collect()}
    assert (got[1].filter_status, got[1].filter_reason, got[1].filter_counter_evidence, got[1].confidence_level, got[1].re_review_status) == ("kept", "r2", "", 0.3, 0)
    assert got[3].filter_status == "kept" and got[3].filter_reason == answers.UNFOUNDED and got[3].confidence_level is None and got[2].filter_status is None
