import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import hard_negatives as hard

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, n_pos=5, n_neg=3, low=50, high=95, every=50):
    """rows: (id, vector of numbers, label), unique ids, all taking part."""
    q = {i: [int(np.floor(256 * np.float64(np.float32(x)))) for x in v] for i, v, _ in rows}
    label, out = {i: y for i, _, y in rows}, set()
    for a in (i for i in q if i % every == 0):
        score = {i: sum(x * y for x, y in zip(q[a], q[i], strict=True)) for i in q if i != a}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if label[i] == label[a]][:n_pos]:
            fit = [i for i in order if label[i] != label[a] and low * score[p] <= 100 * score[i] <= high * score[p]][:n_neg]
            out |= {(a, p, r + 1, n, score[p], score[n]) for r, n in enumerate(fit)}
    return out


def some(seed, n, d, labels, spread=1.0):
    rng = np.random.default_rng(seed)
    centre = rng.standard_normal((labels, d))
    return [(i, (centre[y] + spread * rng.standard_normal(d)).tolist(), int(y)) for i, y in enumerate(rng.integers(0, labels, n))]


@pytest.mark.parametrize(("seed", "n", "d", "labels"), [(1, 400, 7, 3), (2, 300, 64, 10), (3, 60, 1, 2), (4, 300, 8, 300)])
def test_against_brute_force(spark, monkeypatch, seed, n, d, labels):
    rows = some(seed, n, d, labels)
    if seed == 1:  # ties, also for the anchors' own vectors, and a hot vector with two labels
        rows = [(i, rows[i % 20][1] if i % 3 else rows[0][1], y) for i, _, y in rows]
    monkeypatch.setattr(hard, "BLOCK", 64)
    got = hard.hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == sorted(plain(rows))


def test_other_limits_and_windows(spark):
    rows = some(5, 200, 6, 2)
    got = hard.hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 10 == 0, 2, 7, (-30, 120))
    assert set(map(tuple, got.collect())) == plain(rows, 2, 7, -30, 120, 10)


def test_odd_rows_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    good = some(6, 120, 5, 2)
    odd = [(1000, None, 1), (1001, [1.0, None, 1.0, 1.0, 1.0], 1), (1002, [nan, 1.0, 1.0, 1.0, 1.0], 1), (1003, [inf, 1.0, 1.0, 1.0, 1.0], 0), (1004, [9.0] * 5, None), (1005, [], 1), (1006, [9.0] * 4, 1), (None, [9.0] * 5, 1)]
    rows = good + odd + [(50, [-99.0] * 5, 5)] * 200 + [good[3]] * 50  # a repeated id with a larger label, and repeated rows
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"q": F.lit(1), "row": F.lit("x"), "block": F.lit(2), "score": F.lit(3)})
    assert set(map(tuple, hard.hard_negatives(df, F.col("vec_id") % 50 == 0).collect())) == plain(good)
    assert hard.hard_negatives(df.where("false"), F.col("vec_id") % 50 == 0).count() == 0
    alone = spark.createDataFrame([(0, [1.0, 2.0], 1)], SCHEMA)
    assert hard.hard_negatives(alone, F.col("vec_id") == 0).count() == 0
    huge = spark.createDataFrame([(0, [1e30, 1.0], 1), (1, [1e30, 1.0], 1), (2, [0.8e6 / 4, 0.0], 2), (3, [0.0, 1e38], 2)], SCHEMA)
    assert [(r.negative_id, r.positive_score) for r in hard.hard_negatives(huge, F.col("vec_id") == 0).collect()] == [(2, 2**52 + 2**16)]


def test_windows_are_exact_at_every_size():
    scores = np.array([[0, 1, 199, -7, 10**12 + 3, 2**61 + 12345, hard.LEAST]])
    first, last = hard.windows(scores, (50, 95))
    for s, a, z in zip(scores[0].tolist(), first[0].tolist(), last[0].tolist(), strict=True):
        if s == hard.LEAST:
            assert a > z
            continue
        assert 100 * a >= 50 * s > 100 * (a - 1) and 100 * z <= 95 * s < 100 * (z + 1)


def test_bounds_hold_and_exclude(spark):
    rows = some(7, 2000, 32, 10, 0.7)
    ids, label = np.arange(2000), np.array([y for _, _, y in rows])
    x = np.floor(256 * np.array([v for _, v, _ in rows])).astype(np.int64)
    block = hard.Block(ids, label, x)
    low, high = block.bounds(x[:50], slice(0, 2000))
    real = x[:50] @ block.x.T
    assert (low <= real).all() and (real <= high).all()
    list(block.positives(ids[:50], label[:50], x[:50], 5))
    assert 50 * 5 <= block.scored < 0.3 * 50 * 200


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want, got = con.sql(hard.OP11_SQL), hard.op11_hard_negatives(spark, SF)
    rows = [tuple(r[c] for c in want.columns) for r in got.collect()]
    assert rows and sorted(rows) == sorted(want.fetchall())
