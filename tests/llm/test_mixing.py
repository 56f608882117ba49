from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import docs, prose
from tidemark.llm import mixing


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 65, 1000])
def test_permutations(n):
    i, size, key = np.arange(n), np.full(n, n), np.full(n, 9, np.uint64)
    p = mixing.permuted(i, size, key)
    assert sorted(p) == list(range(n)) and (mixing.permuted(p, size, key, inverse=True) == i).all()


def wanted(sizes):
    """Targets by resharing until no source is above twice its size."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    total, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: 2.0 * sizes[s] for s in over}


def test_targets_and_taken(spark):
    rows = [(i, prose(i, 20 + i % 90), "big" if i % 3 else f"s{i % 7}") for i in range(240)] + [(500, prose(1, 400), None), (501, None, "s1"), (502, "", "empty"), (7, prose(7, 27), "big")]
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    df = docs(spark, rows)
    out = mixing.taken(df, block=16)
    got = out.collect()
    assert len(got) == len(rows) and all(0 <= r.taken <= 2 * r.size for r in got)
    want, source = wanted(sizes), {i: s for i, _, s in rows}
    taken = defaultdict(int)
    for r in got:
        taken[source[r.doc_id]] += r.taken
        assert r.target == pytest.approx(want[source[r.doc_id]]) and r.source_size == sizes[source[r.doc_id]]
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.taken(df.repartition(7), block=16).collect()))
    mixed = mixing.mixed_documents(df.withColumn("taken_spans", F.lit("mine")), block=16)
    assert mixed.columns == [*df.columns, "taken_spans"]
    per = {r.doc_id: r.n for r in mixed.groupBy("doc_id").agg(F.sum(F.regexp_count("text", F.lit(mixing.WORD))).alias("n")).collect()}
    once = {r.doc_id: r.taken for r in got if r.doc_id != 7 and r.taken}
    assert {k: v for k, v in per.items() if k != 7} == once


def test_placements_take_each_block_twice_at_most(spark):
    df = docs(spark, [(i, prose(i, 50), f"s{i % 4}") for i in range(60)])
    sources = mixing.plan(mixing.targets(mixing.sized(df)), 16)
    placed = mixing.placements(sources, 16).collect()
    seen = defaultdict(int)
    for r in placed:
        seen[r["rank"], r.block] += 1
    assert max(seen.values()) <= 2 and len({(r["rank"], r.j) for r in placed}) == len(placed)


def test_empty_table(spark):
    assert mixing.taken(docs(spark, [])).count() == 0
    assert mixing.mixed_documents(docs(spark, [])).count() == 0
    assert [r.taken for r in mixing.taken(docs(spark, [(1, None), (2, "")])).collect()] == [0, 0]


def test_long_texts_and_clashing_columns(spark):
    rows = [(1, prose(1, 30_000), "a"), (2, prose(2, 50), "a"), (3, prose(3, 900), "b"), (3, prose(3, 900), "b"), (None, prose(4, 40), "b")]
    df = docs(spark, rows).withColumns({"size": F.lit("x"), "rank": F.lit(1), "at": F.lit(2), "taken": F.lit("y"), "target": F.lit(None)})
    got = mixing.taken(df)
    assert got.columns == ["doc_id", "size", "source_size", "target", "taken"]
    out = got.collect()
    assert sorted((r.size, str(r.doc_id)) for r in out) == sorted((len(t.split()), str(i)) for i, t, _ in rows) and all(r.taken <= 2 * r.size for r in out)
    assert abs(sum(r.taken for r in out) - sum({r.source_size: r.target for r in out}.values())) <= 2


def test_draws_agree_however_they_are_split(spark, monkeypatch):
    """Slots are dealt alike, and all of them, whether shards are drawn for together or apart."""
    sources = mixing.plan(mixing.targets(mixing.sized(docs(spark, [(i, prose(i, 80), f"s{i % 5}") for i in range(100)]))), 16)
    monkeypatch.setattr(mixing, "SHARD_SLOTS", 20)
    found = []
    for drawn in (1, 3, 1024):
        monkeypatch.setattr(mixing, "DRAWN", drawn)
        found.append(sorted(map(tuple, mixing.placements(sources, 16).collect())))
    assert found[0] == found[1] == found[2] and len({s for _, s, *_ in found[0]}) > 20
    words = {r["rank"]: round(r.target) for r in sources.collect()}
    assert {k: sum(t for r, *_, t in found[0] if r == k) for k in words} == words


def test_targets_of_many_sources(spark):
    rng = np.random.default_rng(2)
    sizes = {f"s{i:03d}": int(rng.integers(0, 1000) ** 2 / 100) for i in range(300)}
    df = spark.createDataFrame([(i, s, n, i) for i, (s, n) in enumerate(sizes.items())], "doc_id long, source string, size long, text_key long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    want = wanted(sizes)
    assert all(got[s] == pytest.approx(want[s]) for s in sizes)
