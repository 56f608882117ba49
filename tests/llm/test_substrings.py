import hashlib
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import docs, prose
from tidemark.llm import substrings

SF = "/root/testdata/sf0.001"


def plain(rows, as_text=True):
    """From the definition; a null id comes first."""
    each = [(-(2**63) if i is None else i, i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, *_ in rows]
    first = {}
    for k, _, w in each:
        for s in range(len(w) - 49):
            x = tuple(w[s : s + 50])
            first[x] = min(first.get(x, k), k)
    out = []
    for k, i, w in each:
        gone = {p for s in range(len(w) - 49) if first[tuple(w[s : s + 50])] < k for p in range(s, s + 50)}
        text = " ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((i, len(w), len(gone), text if as_text else hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def got(spark, rows, **more):
    return sorted(map(tuple, substrings.substring_deduped(docs(spark, rows), **more).collect()), key=str)


def test_cover_meets_every_pair_of_places():
    cover, period = set(substrings.COVER), substrings.PERIOD
    assert all(any((i + s) % period in cover and (j + s) % period in cover for s in range(period)) for i in range(period) for j in range(period))
    assert substrings.ANCHOR + period - 1 == substrings.WINDOW


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    rng, rows = random.Random(seed), []
    pool = [prose(100 + i, rng.randrange(40, 90)).split() for i in range(8)]
    for i in range(60):
        words = []
        for _ in range(rng.randrange(0, 6)):
            p = rng.choice(pool)
            a, z = sorted(rng.sample(range(len(p) + 1), 2))
            words += p if rng.random() < 0.4 else p[a:z]
            words += prose(rng.random(), rng.randrange(0, 30)).split()
        text = "".join(w + rng.choice([" ", "\n", "\t ", " "]) for w in words)
        rows.append((rng.choice([i, i, i, i // 2, None]), rng.choice([text, text, text.replace(" ", "  ")])))
    rows += [rows[5]] * 3 + [(7, rows[5][1]), (3, rows[5][1] + " "), (900, "A " * 120), (901, "a " * 90), (902, "A " * 49), (903, "A " * 50)]
    want = plain(rows)
    assert got(spark, rows) == want and sum(r[2] for r in want) > 500


def test_every_length_and_shift_of_a_match(spark):
    rows = [(1, prose(1, 400))]
    words = rows[0][1].split()
    for n in (49, 50, 51, 80):
        for shift in range(31):
            a = (7 * shift + n) % 300
            rows.append((100 * n + shift, " ".join(prose(n * 50 + shift, shift).split() + words[a : a + n] + prose(n * 51 + shift, 12).split())))
    want = plain(rows)
    assert got(spark, rows) == want
    assert {r[0] // 100 for r in want if r[2]} == {50, 51, 80} and all(r[2] >= r[0] // 100 for r in want if r[2])


def test_a_passage_in_very_many_documents(spark):
    shared = prose(3, 70)
    rows = [(i, f"{prose(i, 20)} {shared} {prose(-i - 1, 5)}") for i in range(1500)] + [(5000 + i, t) for i, t in enumerate([prose(4, 60)] * 700)]
    want = plain(rows, as_text=False)
    assert got(spark, rows, as_text=False) == want
    assert sum(r[2] >= 70 for r in want) == 1499 and sum(r[1:3] == (60, 60) for r in want) == 699


def test_odd_tables(spark):
    assert got(spark, []) == []
    rows = [(None, None), (1, ""), (2, " \n\t "), (None, prose(1, 60)), (3, prose(1, 60)), (3, prose(1, 60)), (3, prose(1, 60).replace(" ", "\n")), (4, "É" * 10 + " " + prose(1, 60) + " x")]
    df = docs(spark, rows).withColumns({"kd": F.lit(1), "spans": F.lit("x"), "kept": F.lit(2), "seeds": F.lit(3)})
    assert sorted(map(tuple, substrings.substring_deduped(df).collect()), key=str) == plain(rows)


def test_long_text(spark):
    words = prose(8, 1_000_000).split()
    text = " ".join(words[:600_000] + words[1000:1100] + words[600_000:])
    rows = [(1, " ".join(words[500_000:500_200])), (2, text), (3, " ".join(words[599_960:600_010]))]
    found = {r[0]: r for r in got(spark, rows)}
    assert found[1][2] == 0 and found[3][2] == 0  # words between are another text's
    assert found[2][1:3] == (1_000_100, 200) and found[2][3] == " ".join(words[:500_000] + words[500_200:600_000] + words[1000:1100] + words[600_000:])


def test_words_are_hashed_in_parts(monkeypatch):
    data = np.frombuffer((prose(2, 900) + " " + "x" * 300 + "  é\t" + prose(3, 20)).encode(), np.uint8)
    whole = substrings.word_hashes(data)
    at = np.arange(0, len(whole) - 50, 3)
    hashes = substrings.windows(whole, at, 50, substrings._OF_WORDS[0])
    monkeypatch.setattr(substrings, "PART", 100)
    monkeypatch.setattr(substrings, "WORDS", 16)
    assert (substrings.word_hashes(data) == whole).all() and len(whole) == len(bytes(data).split()) == len(np.unique(whole)) + len(whole) - len(set(bytes(data).split()))
    assert (substrings.windows(whole, at, 50, substrings._OF_WORDS[0]) == hashes).all()


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want, found = con.sql(substrings.OP13_SQL), substrings.op13_substring_dedup(spark, SF)
    rows = sorted(tuple(r[c] for c in want.columns) for r in found.collect())
    assert rows == sorted(want.fetchall()) and sum(r[want.columns.index("n_removed")] for r in rows) > 0
