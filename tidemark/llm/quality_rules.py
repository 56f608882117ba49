"""Operator 9, native: quality rules as a learned decision list.

Sequential covering: one conjunction of thresholds after another is grown on two thirds of a bounded labelled
sample and pruned on the rest; the list becomes an ordered Spark CASE expression. Nothing but built-in
expressions runs on the executors; only the sample's feature rows come to the driver.

Rules are learned from labelled rows that pass the base rule, as it alone judges the others; one row for each id.

Cases: a null or empty text has no words and fails the base rule; repeated rows are judged alike; a very long text is
counted whole, its windows sorted only if one repeats; an empty table gives an empty result; without labels of both
kinds the list is empty and keeps what the base rule keeps;
extra columns, whatever their names, pass through `quality_filter` untouched.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import fresh, labelled_ids, sample_texts, table
from tidemark.llm.text_stats import FEATURES, features, with_stats

#: The classifier is fitted on at most so many labelled rows.
SAMPLE_ROWS = 20_000
#: A rule stays if at least this share of the pruning rows that it covers are bad, and it covers this many.
LEAST_PRECISION, LEAST_COVER, MOST_RULES, MOST_TESTS = 0.9, 3, 12, 4


@dataclass
class Rule:
    """A conjunction: each test is (feature index, 1 for >= or -1 for <=, threshold)."""

    tests: list[tuple[int, int, float]] = field(default_factory=list)

    def covers(self, x: np.ndarray) -> np.ndarray:
        hit = np.ones(len(x), bool)
        for f, sign, t in self.tests:
            hit &= sign * x[:, f] >= sign * t
        return hit

    def column(self, feature: dict[str, Column]) -> Column:
        out = F.lit(True)
        for f, sign, t in self.tests:
            c = feature[FEATURES[f]]
            out = out & (c >= F.lit(t) if sign > 0 else c <= F.lit(t))
        return out

    def __str__(self) -> str:
        return " AND ".join(f"{FEATURES[f]} {'>=' if s > 0 else '<='} {t:.6g}" for f, s, t in self.tests)


def _best_test(x: np.ndarray, bad: np.ndarray) -> tuple[float, tuple[int, int, float]] | None:
    """The threshold with the largest gain in information per bad row kept."""
    p0, n0 = bad.sum(), (~bad).sum()
    base = np.log2(p0 / (p0 + n0))
    best = None
    for f in range(x.shape[1]):
        for sign in (1, -1):
            order = np.argsort(-sign * x[:, f], kind="stable")
            v, p = x[order, f], np.cumsum(bad[order])
            ends = np.flatnonzero(np.append(v[1:] != v[:-1], True))[:-1]
            if not len(ends):
                continue
            pos = p[ends]
            gain = pos * (np.log2(np.maximum(pos, 0.5) / (ends + 1)) - base)
            k = int(np.argmax(gain))
            if gain[k] > 1e-9 and (best is None or gain[k] > best[0]):
                e = ends[k]
                best = (float(gain[k]), (f, sign, float((v[e] + v[e + 1]) / 2)))
    return best


def learn(x: np.ndarray, y: np.ndarray, seed: int = 7) -> list[Rule]:
    """Rules for label 0, in order. x: rows by FEATURES; y: 0 or 1."""
    bad, rules = y == 0, []
    grow = np.random.default_rng(seed).permutation(len(y)) % 3 != 0
    left = np.ones(len(y), bool)
    while len(rules) < MOST_RULES and bad[left & grow].any() and not bad[left].all():
        rule, inside = Rule(), left & grow
        while len(rule.tests) < MOST_TESTS and bad[inside].any() and (~bad[inside]).any():
            best = _best_test(x[inside], bad[inside])
            if best is None:
                break
            rule.tests.append(best[1])
            inside &= rule.covers(x)
        held = left & ~grow

        def worth(tests: list) -> float:
            hit = Rule(tests).covers(x) & held
            return (2 * bad[hit].sum() - hit.sum()) / max(1, hit.sum())

        while len(rule.tests) > 1:
            shorter = max((rule.tests[:i] + rule.tests[i + 1 :] for i in range(len(rule.tests))), key=worth)
            if worth(shorter) < worth(rule.tests):
                break
            rule.tests = shorter
        hit = rule.covers(x) & left
        if not rule.tests or (hit & held).sum() < LEAST_COVER or bad[hit & held].mean() < LEAST_PRECISION or bad[hit].mean() < LEAST_PRECISION:
            break
        rules.append(rule)
        left &= ~hit
    return rules


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_ROWS) -> list[Rule]:
    rows = with_stats(sample_texts(docs, labelled_ids(labels, "quality", most)), "text", "s").where(~base_failed("s"))
    got = sorted(tuple(r) for r in rows.select("y", *(c.alias(k) for k, c in features("s").items())).collect())
    if len({r[0] for r in got}) < 2:
        return []
    return learn(np.array([r[1:] for r in got], float), np.array([r[0] for r in got]))


def verdict(rules: list[Rule], stats: str) -> Column:
    """The ordered conditional: the first rule that covers a text rejects it, the default keeps it."""
    feature, out = features(stats), None
    for r in rules:
        out = F.when(r.column(feature), F.lit(False)) if out is None else out.when(r.column(feature), F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def base_failed(stats: str) -> Column:
    s = lambda k: F.col(f"{stats}.{k}")
    return (s("n_words") < 10) | (100 * s("n_repeat_words") > 20 * s("n_words"))


def judged(docs: DataFrame, rules: list[Rule], out: str) -> DataFrame:
    """docs with a struct `out` of the statistics, base_failed and kept."""
    s = fresh(docs, "stats_of_text")
    df = with_stats(docs, "text", s)
    return df.withColumn(out, F.struct(f"{s}.*", base_failed(s).alias("base_failed"), (~base_failed(s) & verdict(rules, s)).alias("kept"))).drop(s)


def quality_filter(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are kept, with docs' own columns."""
    out = fresh(docs, "judged")
    return judged(docs, fit(docs, labels), out).where(F.col(f"{out}.kept")).drop(out)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = fit(docs, table(spark, sf_dir, "labels"))
    q = judged(docs, rules, "q")
    return q.select("doc_id", *(f"q.{k}" for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")))
