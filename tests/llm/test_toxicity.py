import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tests.llm.helpers import docs, prose
from tidemark.llm import toxicity

SF = "/root/testdata/sf0.1"


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    net = toxicity.Network(None, 12, 15)
    net.p = {k: rng.standard_normal(v.shape) * 0.5 for k, v in net.p.items()}
    for k in ("words", "grams"):
        net.p[k][-1] = 0
    buckets = np.concatenate([rng.integers(0, 12, (6, 1)), rng.integers(0, 15, (6, 8))], 1)
    idx = np.where(np.arange(5) < rng.integers(1, 6, (4, 1)), rng.integers(0, 6, (4, 5)), 6)
    y, w = np.array([0.0, 1, 1, 0]), np.array([1.0, 2, 1, 0.5])

    def loss():
        z = net.forward(net.inputs(buckets), idx).astype(float)
        return (w * (np.logaddexp(0, z) - y * z)).sum() / w.sum()

    g = net.gradients(buckets, net.inputs(buckets), idx, y, w)
    for k, v in net.p.items():
        for at in [tuple(rng.integers(0, s) for s in v.shape) for _ in range(6)]:
            if k in ("words", "grams") and at[0] == len(v) - 1:
                continue
            old = v[at]
            v[at] = old + 2e-2
            up = loss()
            v[at] = old - 2e-2
            down = loss()
            v[at] = old
            assert abs((up - down) / 4e-2 - g[k][at]) < 5e-3, (k, at)


def test_every_letter_enters_a_score():
    for raw in (b"unbelievable", "中文字符没有空格的一段话很长很长很长".encode(), b"x" * 70, b"ab", b"a.b"):
        base = toxicity.word_features(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        for i in range(len(raw)):
            if raw[i : i + 1] == b".":
                continue
            other = raw[:i] + b"q" + raw[i + 1 :]
            got = toxicity.word_features(np.frombuffer(other, np.uint8), np.array([0, len(raw)]))
            assert not np.array_equal(base[0][base[1]][:, 1:], got[0][got[1]][:, 1:]), (raw, i)
    stem, compound = (toxicity.word_features(np.frombuffer(w, np.uint8), np.array([0, len(w)]))[0][0, 1:] for w in (b"xvile", b"previleness"))
    assert set(stem) & set(compound) - {0}


def test_windows_cover_every_word():
    for n in (0, 1, 16, 17, 32, 33, 100):
        idx, owner = toxicity.windows(np.arange(n), np.array([n, 0]), n)
        assert set(idx[owner == 0].ravel()) - {n} == set(range(n)) and (owner == 1).sum() == 1


def test_held_out_accuracy(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("toxic is not null")
    out = toxicity.op6_toxicity(spark, SF).join(labels, "doc_id").where("held_out").collect()
    p, y = np.array([r.predicted for r in out]), np.array([r.toxic for r in out])
    assert (p == y).mean() > 0.95 and p[y == 1].mean() > 0.8 and p[y == 0].mean() < 0.05


def test_odd_rows(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [(r.score, r.predicted) for r in toxicity.scored(docs(spark, [(1, None), (None, "x")]), none).collect()] == [(0.0, 0)] * 2
    rows = [(i, prose(i, 40) + (" vile" if i % 2 else "") + prose(100 + i, 20)) for i in range(60)] + [(100, None), (101, ""), (102, "..."), (None, "vile vile"), (3, prose(3, 20_000)), (103, prose(9, 30)), (103, prose(9, 30))]
    marks = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    df = docs(spark, rows).withColumns({"score": F.lit("x"), "held_out": F.lit("y")})
    out = toxicity.scored(df, marks).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    assert len({r.score for r in out if r.doc_id == 103}) == 1
    assert toxicity.scored(df.limit(0), marks).count() == 0
    # a fitted model over an empty table, and ids that several rows have
    assert toxicity.fit(df.unionAll(df), marks) is not None
    out = list(toxicity._score(toxicity.fit(df, marks))(iter([pa.RecordBatch.from_pydict({"doc_id": pa.array([], pa.int64()), "text": pa.array([], pa.string())})])))
    assert sum(len(b) for b in out) == 0


def test_long_texts_are_sampled_in_parts(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_CHARS", 400)
    seen = []
    monkeypatch.setattr(toxicity, "learn", lambda texts, y, share: seen.extend(texts))
    toxicity.fit(docs(spark, [(i, prose(i, 3000)) for i in range(8)] + [(8, "short")]), spark.createDataFrame([(i, i % 2) for i in range(9)], "doc_id long, toxic int"))
    assert len(seen) > 4 and all(len(t) <= 420 for t in seen)
    assert any(t[:20] == prose(i, 3000)[:20] and t[-20:] == prose(i, 3000)[-20:] for t in seen for i in range(8))


def test_scores_match_a_plain_network():
    """The operator's batched network against one that walks each window word by word."""
    rng = np.random.default_rng(3)
    net = toxicity.Network(None, 12, 15)
    net.p = {k: rng.standard_normal(v.shape) * 0.5 for k, v in net.p.items()}
    buckets = np.concatenate([rng.integers(0, 12, (6, 1)), rng.integers(0, 15, (6, toxicity.GRAMS))], 1)
    idx, p = np.where(np.arange(7) < rng.integers(1, 8, (5, 1)), rng.integers(0, 6, (5, 7)), 6), net.p
    got = net.forward(net.inputs(buckets), idx)
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    for row, score in zip(idx, got, strict=True):
        x = [np.concatenate([p["words"][buckets[w, 0]], sum(p["grams"][g] for g in buckets[w, 1:]) / toxicity.SHRINK]) for w in row if w < 6]
        states = []
        for d, steps in (("f", x), ("b", x[::-1])):
            h, out = np.zeros(toxicity.H), []
            for v in steps:
                g, u = v @ p["W" + d] + p["c" + d], h @ p["U" + d]
                z, r = sigmoid(g[: toxicity.H] + u[: toxicity.H]), sigmoid((g + u)[toxicity.H : 2 * toxicity.H])
                new = np.tanh(g[2 * toxicity.H :] + r * u[2 * toxicity.H :])
                h = (1 - z) * new + z * h
                out.append(h)
            states.append(out if d == "f" else out[::-1])
        s = np.hstack(states)
        w = np.exp(np.tanh(s @ p["A"]) @ p["v"])
        assert abs((w / w.sum()) @ s @ p["o"] + p["bias"][0] - score) < 1e-3
