import random
import re
import unicodedata
import zlib

import numpy as np
from pyspark.sql import functions as F

from tests.llm.helpers import docs, prose
from tidemark.llm import quality_rank, quality_rules
from tidemark.llm.text_stats import FEATURES, features, with_stats

SF = "/root/testdata/sf0.01"


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0d]+", text)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    inside = {i + k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


def test_statistics_match_brute_force(spark):
    rng = random.Random(5)
    texts = [None, "", " \n\t\r\n ", "a", "a b c d e a b c d e f a b", "x " * 400, "l one\nl one\n\nl two\nl one", "é#*$%&|<> 中文\x0bx", "a b c d\na b c d"]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randrange(60))) for _ in range(30)]
    got = with_stats(docs(spark, list(enumerate(texts))), "text", "s").select("doc_id", "s.*").orderBy("doc_id").collect()
    assert [(r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got] == [brute(t) for t in texts]


def test_rules_cover_planted_conjunction():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 10))
    y = 1 - ((x[:, 0] > 0.7) & (x[:, 2] < 0.4) | (x[:, 4] > 0.95)).astype(int)
    rules = quality_rules.learn(x, y)
    hit = np.any([r.covers(x) for r in rules], 0)
    assert (hit == (y == 0)).mean() > 0.98 and all(len(r.tests) <= quality_rules.MOST_TESTS for r in rules)


def test_rules_keep_good_documents(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = quality_rules.op9_quality_rules(spark, SF).join(labels, "doc_id").where("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    kept = {r.quality: r.kept for r in got}
    assert kept[1] > 0.97 and kept[0] < 0.1


def test_filter_keeps_columns_that_clash(spark):
    df = docs(spark, [(1, prose(1, 60)), (1, prose(1, 60)), (2, "short"), (3, None), (None, prose(2, 60))]).withColumns({"n_words": F.lit("mine"), "kept": F.lit("too"), "judged": F.lit(1), "stats_of_text": F.lit(2)})
    none = spark.createDataFrame([], "doc_id long, quality int")
    out = quality_rules.quality_filter(df, none)
    assert out.columns == df.columns
    assert sorted((r.doc_id is None, r.doc_id, r.n_words) for r in out.collect()) == [(False, 1, "mine"), (False, 1, "mine"), (True, None, "mine")]
    assert quality_rules.quality_filter(df.limit(0), none).count() == 0


def test_ranker_on_held_out_rows(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    out = quality_rank.op10_quality_rank(spark, SF).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in out]) > 0.95
    assert all((r.score >= 0.5) == (r.predicted == 1) and 0 <= r.score <= 1 for r in out)


def test_ranker_without_labels(spark):
    out = quality_rank.scored(docs(spark, [(1, None), (None, ""), (3, "x")]), spark.createDataFrame([(1, 1), (None, 0)], "doc_id long, quality int"))
    assert sorted((str(r.doc_id), r.score, r.predicted) for r in out.collect()) == [("1", 0.5, 1), ("3", 0.5, 1), ("None", 0.5, 1)]


def numpy_rows(spark, path=SF):
    """doc_id and features of all given documents, from the text alone."""
    df = with_stats(spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text"), "text", "s")
    rows = df.select("doc_id", "s", *(c.alias(k) for k, c in features("s").items())).orderBy("doc_id").collect()
    return df, [r.doc_id for r in rows], np.array([[r[k] for k in FEATURES] for r in rows])


def test_features_match_numpy(spark):
    _, ids, x = numpy_rows(spark)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for i, row in list(zip(ids, x, strict=True))[::7]:
        n, chars, symbols, dup, repeat = brute(texts[i])
        t = texts[i]
        w, lines = re.findall(r"[^\x20\x09-\x0d]+", t), [v for v in t.split("\n") if re.search(r"[^\x20\x09-\x0d]", v)]
        upper = sum(c.isupper() and unicodedata.category(c) == "Lu" for c in t)
        want = [symbols / max(chars, 1), dup / max(len(lines), 1), repeat / max(n, 1), chars / max(n, 1), upper / max(chars, 1), t.count("!") / max(n, 1), len(re.findall("[0-9]", t)) / max(chars, 1), len(set(w)) / max(n, 1), np.log1p(n), n / max(len(lines), 1)]
        assert np.allclose(row, want, rtol=1e-9)


def test_verdict_is_the_list_of_rules(spark):
    """The CASE expression against the rules over numpy, for all given documents."""
    df, ids, x = numpy_rows(spark)
    rules = quality_rules.fit(df.select("doc_id", "text"), spark.read.parquet(f"{SF}/labels.parquet"))
    odd = [quality_rules.Rule([(0, 1, 0.01), (9, -1, 12.0)]), quality_rules.Rule([(8, -1, 4.0)]), quality_rules.Rule([(3, 1, 5.0), (4, 1, 0.02), (7, -1, 0.9)])]
    for some in (rules, odd, []):
        got = {r.doc_id: r.k for r in df.select("doc_id", quality_rules.verdict(some, "s").alias("k")).collect()}
        want = ~np.any([r.covers(x) for r in some], 0) if some else np.ones(len(ids), bool)
        assert [got[i] for i in ids] == want.tolist()
    assert rules


def test_rules_of_the_query_match_brute_force(spark):
    got = {r.doc_id: r for r in quality_rules.op9_quality_rules(spark, SF).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    _, ids, x = numpy_rows(spark)
    rules = quality_rules.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    hit = dict(zip(ids, np.any([r.covers(x) for r in rules], 0), strict=True))
    for i, t in texts.items():
        n = brute(t)
        failed = n[0] < 10 or 100 * n[4] > 20 * n[0]
        assert (got[i].n_words, got[i].word_chars, got[i].n_symbols, got[i].n_dup_lines, got[i].n_repeat_words, got[i].base_failed, got[i].kept) == (*n, failed, not failed and not hit[i])


def test_ranker_matches_numpy(spark):
    df, ids, x = numpy_rows(spark)
    model = quality_rank.fit(df.select("doc_id", "text"), spark.read.parquet(f"{SF}/labels.parquet"))
    got = {r.doc_id: r.v for r in df.select("doc_id", model.column("s").alias("v")).collect()}
    want = quality_rank._expand(x, model.mean, model.scale) @ model.weight
    assert np.allclose([got[i] for i in ids], want, atol=1e-9)
    out = {r.doc_id: r for r in quality_rank.op10_quality_rank(spark, SF).collect()}
    order = np.argsort(want)
    assert all(out[ids[a]].score <= out[ids[b]].score + 1e-12 for a, b in zip(order, order[1:], strict=False))
    assert {i: r.held_out for i, r in out.items()} == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in ids}


def test_ranker_on_odd_tables(spark):
    rows = [(i, prose(i, 60) if i % 2 else "junk # junk # junk ! " * 12) for i in range(60)]
    odd = [(100, prose(9, 20_000)), (101, None), (101, None), (102, prose(3, 60)), (102, prose(3, 60)), (None, "x"), (3, "another text of a labelled id"), (3, "a third")]
    marks = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (7, None)], "doc_id long, quality int")
    df = docs(spark, rows + odd).withColumns({"score": F.lit("x"), "strength": F.lit("y"), "s": F.lit(1), "held_out": F.lit(2)})
    out = quality_rank.scored(df, marks).collect()
    assert len(out) == len(rows) + len(odd) and all(0 <= r.score <= 1 for r in out)
    assert len({r.score for r in out if r.doc_id == 102}) == 1 and len({r.score for r in out if r.doc_id == 101}) == 1
    assert quality_rank.scored(df.limit(0), marks).count() == 0
    kept = quality_rules.judged(docs(spark, [(1, prose(1, 20_000)), (2, prose(1, 10_000) + " " + prose(1, 10_000))]), [], "q").select("doc_id", "q.*").orderBy("doc_id").collect()
    assert [(r.n_words, r.n_repeat_words, r.kept) for r in kept] == [(20_000, 0, True), (20_000, 20_000, False)]
