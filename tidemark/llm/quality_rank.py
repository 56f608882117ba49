"""Operator 10: a quality classifier by Bradley-Terry pairwise ranking.

Preference pairs (a text labelled 1 over one labelled 0) are drawn from a bounded labelled sample; weights are learned by
logistic loss on differences of features, so that a text's score is its strength in the Bradley-Terry model. The
threshold is a quantile of scores: of all labelled training rows, the share labelled 0 falls below it. The score
that is returned is the logistic of strength minus threshold.

A feature is a clipped, standardised statistic of the text or the square of one; no id, label, language or source
is among them. The statistics are built-in expressions; only the sample's feature rows come to the driver.

Cases: a null text counts as an empty one and is scored; rows with equal texts have equal scores; a very long text is
counted whole; an id that several rows have is one row of the sample; an empty table gives an empty result; without labels of
both kinds every score is 0.5; extra columns, whatever their names, are left out; labels of null ids or other values than 0 and
1 take no part.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import fold, kept, labelled_ids, sample_texts, table
from tidemark.llm.text_stats import FEATURES, features, with_stats

#: The model is fitted on at most so many labelled rows, and so many pairs of them.
SAMPLE_ROWS, PAIRS = 20_000, 60_000
FOLDS, HELD_OUT = 3, 1
CLIP, PENALTY, STEPS, SEED = 4.0, 1e-3, 60, 11


@dataclass
class Ranker:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray

    def column(self, stats: str) -> Column:
        """The strength of a text."""
        out = F.lit(0.0)
        for k, (name, c) in enumerate(features(stats).items()):
            assert name == FEATURES[k]
            z = F.greatest(F.lit(-CLIP), F.least(F.lit(CLIP), (c - float(self.mean[k])) / float(self.scale[k])))
            out = out + z * float(self.weight[k]) + z * z * float(self.weight[len(FEATURES) + k])
        return out


def _expand(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    z = np.clip((x - mean) / scale, -CLIP, CLIP)
    return np.hstack([z, z * z])


def learn(x: np.ndarray, y: np.ndarray) -> Ranker:
    """Newton's steps on the pairs' logistic loss."""
    mean, scale = np.median(x, 0), np.maximum(x.std(0), 1e-6)
    z, rng = _expand(x, mean, scale), np.random.default_rng(SEED)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    d = z[rng.choice(good, PAIRS)] - z[rng.choice(bad, PAIRS)]
    w = np.zeros(d.shape[1])
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
        grad = -(d * p[:, None]).mean(0) + PENALTY * w
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / len(d) + PENALTY * np.eye(len(w)), grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return Ranker(mean, scale, w)


def fit(docs: DataFrame, labels: DataFrame) -> Ranker | None:
    rows = with_stats(sample_texts(docs, labelled_ids(labels, "quality", SAMPLE_ROWS, fold(F.col("doc_id"), FOLDS) != HELD_OUT)), "text", "s")
    got = sorted(tuple(r) for r in rows.select("y", *(c.alias(k) for k, c in features("s").items())).collect())
    if len({r[0] for r in got}) < 2:
        return None
    return learn(np.array([r[1:] for r in got], float), np.array([r[0] for r in got]))


def threshold(strengths: DataFrame, labels: DataFrame) -> float:
    """The quantile of all labelled training rows' strengths that as many of them fall below as are labelled 0."""
    y = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & (fold(F.col("doc_id"), FOLDS) != HELD_OUT)).select("doc_id", F.col("quality").alias("y"))
    both = kept(strengths.join(y, "doc_id").select("strength", "y"))
    n, bad = both.agg(F.count("*"), F.count_if(F.col("y") == 0)).first()
    at = F.array(F.lit(bad / n), F.lit(min(1.0, (bad + 1) / n)))
    below, above = both.agg(F.percentile_approx("strength", at, F.lit(10_000))).first()[0]
    return (below + above) / 2


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted, a row for each row of docs."""
    model = fit(docs, labels)
    out = docs.select("doc_id", "text")
    if model is None:
        out = out.withColumn("score", F.lit(0.5))
    else:
        out = kept(with_stats(out, "text", "s").select("doc_id", model.column("s").alias("strength")))
        out = out.withColumn("score", 1 / (1 + F.exp(F.lit(threshold(out, labels)) - F.col("strength"))))
    held = F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_quality_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
