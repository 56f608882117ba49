import random
import re
from collections import defaultdict

import numpy as np
import pytest

from tidemark.llm import common, near_dedup

SCHEMA = "doc_id long, text string, n_shingles string, comp string"


def brute(rows):
    """Components of texts whose 5-word shingle sets have a similarity of 0.75, by comparing all pairs that share one."""
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for i, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0d]+", (t or "").translate(lower))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    by, common, up = defaultdict(list), defaultdict(int), {i: i for i in sets}
    for i, s in sets.items():
        for x in s:
            by[x].append(i)
    for ids in by.values():
        for a in range(len(ids)):
            for b in ids[a + 1 :]:
                common[ids[a], b] += 1

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for (a, b), n in common.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i), root(i) == i) for i in sets}


def rows_of(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA)


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(df).collect()}


def corpus(seed, copies, edits):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    base, rows = [word() for _ in range(150)], []
    for i in range(copies):
        w = list(base)
        for _ in range(rng.randrange(edits)):
            w[rng.randrange(len(w))] = word()
        rows.append((i, " ".join(w)))
    passage = " ".join(base[:40])
    rows += [(1000 + i, passage + " " + " ".join(word() for _ in range(100))) for i in range(40)]
    rows += [(2000 + i, " ".join(word() for _ in range(rng.choice([1, 3, 4, 5, 6, 300])))) for i in range(20)]
    return rows + [(3000 + i, rows[i][1].upper()) for i in range(5)]


def test_components_match_brute_force(spark):
    rows = corpus(1, 60, 12)
    assert result(rows_of(spark, rows)) == brute(rows)


@pytest.mark.parametrize(("small", "size"), [(4, 1 << 20), (12, 1 << 20), (4, 12_000)])
def test_dense_groups_are_compared_in_blocks(spark, monkeypatch, small, size):
    monkeypatch.setattr(near_dedup, "SMALL", small)
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    monkeypatch.setattr(near_dedup, "BLOCK_BYTES", size)
    monkeypatch.setattr(common, "HOT", 20)
    rows = corpus(2, 160, 40)
    assert result(rows_of(spark, rows)) == brute(rows)


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "One"), (6, "a b c d e"), (7, long), (8, long + " end"), (8, "a b c d e"), (None, "one"), (4, "one")]
    got = sorted(near_dedup.near_duplicates(rows_of(spark, rows)).select("doc_id", "n_shingles", "component_id", "kept").collect(), key=str)
    want = [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 1, 6, True), (7, 29996, 7, True), (8, 29997, 7, False), (8, 1, 6, False), (None, 1, 4, False), (4, 1, 4, True)]
    assert [tuple(r) for r in got] == sorted(want, key=lambda r: str(got[0].__class__(*r)) if False else f"Row(doc_id={r[0]}, n_shingles={r[1]}, component_id={r[2]}, kept={r[3]})")
    kept = near_dedup.one_of_each(rows_of(spark, rows))
    assert kept.columns == ["doc_id", "text", "n_shingles", "comp"]
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4, 4, 6, 7]


def test_empty_table(spark):
    assert near_dedup.near_duplicates(rows_of(spark, [])).collect() == []


def test_given_documents_match_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    assert result(df) == brute([tuple(r) for r in df.collect()])


def near_texts(seed, copies, shared):
    """Texts that have a passage of `shared` words in common, and copies of one text with a few words changed that link only in part."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    passage, base = [word() for _ in range(shared)], [word() for _ in range(150)]
    rows = [(i, " ".join(passage + [word() for _ in range(100)])) for i in range(copies)]
    for i in range(copies):
        w = list(base)
        for _ in range(rng.randrange(16)):
            w[rng.randrange(len(w))] = word()
        rows.append((copies + i, " ".join(w)))
    return rows


def branched(spark, monkeypatch, rows):
    """The result, the rows that branching stored and those that came to the dense step."""
    real, dense, made, left = near_dedup.kept_in_batches, near_dedup._dense, [], []

    def counting(df, n):
        out = real(df, n)
        if {"path", "sketch"} <= set(out.columns):
            made.append(out.count())
        return out

    with monkeypatch.context() as m:
        m.setattr(near_dedup, "SMALL", 8)
        m.setattr(near_dedup, "kept_in_batches", counting)
        m.setattr(near_dedup, "_dense", lambda large, *more: left.append(large.count()) or dense(large, *more))
        return result(rows_of(spark, rows)), sum(made), sum(left)


def test_texts_that_share_a_passage_do_not_branch(spark, monkeypatch):
    rows = near_texts(3, 120, 20)[:120]
    assert branched(spark, monkeypatch, rows) == (brute(rows), 0, 0)


def test_branching_grows_as_a_group_does(spark, monkeypatch):
    (a, small, _), (b, large, _) = (branched(spark, monkeypatch, rows) for rows in (near_texts(4, 60, 45), near_texts(4, 120, 45)))
    assert (a, b) == (brute(near_texts(4, 60, 45)), brute(near_texts(4, 120, 45)))
    assert 0 < large <= 3 * small


def counted(monkeypatch, name):
    """How often near_dedup calls its function of this name."""
    calls, real = [], getattr(near_dedup, name)
    monkeypatch.setattr(near_dedup, name, lambda *a: calls.append(1) or real(*a))
    return calls


@pytest.mark.parametrize("few", [400_000, 0])
def test_components_whether_labels_are_broadcast_or_dealt(spark, monkeypatch, few):
    monkeypatch.setattr(near_dedup, "BROADCAST_ROWS", few, raising=False)
    rng = random.Random(5)
    pairs = [(0, i) for i in range(1, 40)] + [(i, i + 1) for i in range(100, 130)] + [(200 + rng.randrange(60), 200 + rng.randrange(60)) for _ in range(45)] + [(0, 1), (300, 300)]
    up = {i: i for p in pairs for i in p}
    for _ in up:
        for a, b in pairs:
            up[a] = up[b] = min(up[a], up[b])
    key = lambda i: i.to_bytes(16, "big")
    got = near_dedup.components(spark.createDataFrame([(key(a), key(b)) for a, b in pairs], "a binary, b binary")).collect()
    assert sorted((bytes(r.key), bytes(r.comp)) for r in got) == sorted((key(i), key(c)) for i, c in up.items())


def test_components_of_stars_end_after_one_look_at_the_neighbours(spark, monkeypatch):
    tables = counted(monkeypatch, "kept")
    got = near_dedup.components(spark.createDataFrame([(bytes([0]), bytes([i])) for i in range(1, 50)], "a binary, b binary")).collect()
    assert {bytes(r.comp) for r in got} == {bytes([0])} and len(got) == 50
    assert len(tables) <= 3


@pytest.mark.parametrize("few", [400_000, 0])
def test_pairs_of_further_levels_are_confirmed_together(spark, monkeypatch, few):
    monkeypatch.setattr(near_dedup, "BROADCAST_ROWS", few, raising=False)
    monkeypatch.setattr(near_dedup, "SMALL", 8)
    calls, levels = counted(monkeypatch, "_confirmed"), counted(monkeypatch, "_children")
    rows = near_texts(4, 60, 45)
    assert result(rows_of(spark, rows)) == brute(rows)
    assert len(levels) == near_dedup.DEEPEST - 1 and len(calls) == 3


def test_bitmaps_lose_no_linked_pair():
    rng = np.random.default_rng(6)
    kinds = {True: [], False: []}
    for size in (1, 4, 40, 150, 600, 5000):
        for share in np.linspace(0.3, 1, 57):
            h = rng.integers(0, 2**63, 2 * size, dtype=np.uint64)
            x, y = h[:size], h[int(size * (1 - share)) :][:size]
            both = len(np.intersect1d(x, y))
            s = [np.hstack([np.zeros((1, near_dedup.K), np.uint32), near_dedup.bitmaps(z, np.array([size])), np.array([[size]], np.uint32)]) for z in (x, y)]
            linked = 100 * both >= 75 * (2 * size - both)
            if linked or size <= 600 and both < 0.75 * size:
                kinds[linked].append(bool(near_dedup._alike(*s)[0]))
    assert all(kinds[True]) and len(kinds[True]) > 50
    assert len(kinds[False]) > 50 and sum(kinds[False]) < 0.05 * len(kinds[False])


def test_unlike_pairs_of_a_group_are_not_confirmed(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "SMALL", 8)
    real, n = near_dedup._confirmed, [0, 0]

    def counting(pairs, *more):
        out = real(pairs, *more)
        n[0], n[1] = n[0] + pairs.count(), n[1] + out.count()
        return out

    monkeypatch.setattr(near_dedup, "_confirmed", counting)
    rows = near_texts(4, 120, 45)
    assert result(rows_of(spark, rows)) == brute(rows)
    assert 0 < n[0] <= 3 * n[1], n
