import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import prose
from tidemark.llm import importance

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return len(w), [crc32(x.encode()) % 10000 for x in w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]]


def plain(docs, target, percent=25, seed=7):
    each = [(i, *features(t)) for i, t in docs]
    s, t = (Counter(b for f in fs for b in f) for fs in ([f for _, _, f in each], [features(x)[1] for x in target]))
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000)))) for b in range(10000)]
    out = {}
    for i, n, f in each:
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        out[i] = [n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
    order = sorted((i for i in out if out[i][0] >= 20), key=lambda i: (-out[i][3], i is None, i or 0))
    for place, i in enumerate(order[: percent * len(order) // 100]):
        out[i][4] = place + 1
    return {(i, *v[1:]) for i, v in out.items()}


TEXTS = [
    None, "", " \n.-!", "One", "a b a b a b", "É é ÀB cd ÀB", "x1y2-3z", "日本語 テキスト 日本語", "Kelvin K sign", "\x00nul\x7fdel\x80pad", "a" * 5000, "ß straße STRASSE 4.5",
]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("words", [3, 64, 1 << 19])
def test_against_brute_force(spark, monkeypatch, words):
    rng = random.Random(words)
    rows = list(enumerate(TEXTS)) + [(100 + i, prose(i % 30, rng.randrange(1, 60)).title()) for i in range(80)] + [(None, prose(3, 30)), (-5, prose(3, 30))]
    target = [prose(i, 40) for i in range(10)] + [None, ""]
    got = importance.resampled(frame(spark, rows), frame(spark, list(enumerate(target))))
    assert got.dtypes == [("doc_id", "bigint"), ("n_features", "bigint"), ("weight", "bigint"), ("score", "bigint"), ("rank", "bigint")]
    assert set(map(tuple, got.collect())) == plain(rows, target)
    monkeypatch.setattr(importance, "WORDS", words)  # seams between batches
    each = [(t or "").encode() for _, t in rows]
    for (_, t), found in zip(rows, importance.buckets(each), strict=True):
        n, want = features(t)
        assert found[0::2].tolist() == want[:n] and found[1::2].tolist() == want[n:]


def test_repeated_rows_empty_tables_and_extra_columns(spark):
    rows = [(1, prose(1, 25))] * 6 + [(2, prose(1, 25)), (2, prose(2, 30))] + [(3, "short")]
    df = frame(spark, rows).withColumns({"score": F.lit("x"), "buckets": F.lit(1), "rank": F.lit(2)})
    got = importance.resampled(df, frame(spark, []), percent=50).collect()
    assert len(got) == 9 and sorted(r["rank"] for r in got if r["rank"]) == [1, 2, 3, 4]
    drawn = sorted((-r.score, r.doc_id) for r in got if r["rank"])
    assert drawn == sorted((-r.score, r.doc_id) for r in got if r.n_features > 1)[:4]
    assert importance.resampled(frame(spark, []), df).count() == 0


def test_long_text(spark):
    text = prose(9, 1_500_000)
    n, want = features(text)
    got = importance.featured(frame(spark, [(1, text), (2, "a b")])).where("doc_id = 1").first()
    assert (got.n_words, got.n_features) == (n, len(want))
    found = memoryview(bytes(got.buckets)).cast("H")
    assert found[0::2].tolist() == want[:n] and found[1::2].tolist() == want[n:]


def test_query_equals_sql_and_python(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want, got = con.sql(importance.OP12_SQL), importance.op12_importance(spark, SF)
    rows = {tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in got.collect()}
    assert {tuple(r[want.columns.index(c)] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in want.fetchall()} == rows
    docs = con.sql("SELECT doc_id, text FROM documents").fetchall()
    assert rows == plain(docs, [t for (t,) in con.sql("SELECT text FROM benchmark").fetchall()])
