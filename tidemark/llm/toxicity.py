"""Operator 6: toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A step of the network is a word (of a long run of letters, as in writing without spaces, a part of STEP bytes that overlaps
the next); its input is a word embedding beside the summed embeddings of the character n-grams at all of its places, so
every letter enters a score; punctuation doesn't. Words and n-grams that few of the sample's texts have share one embedding
that stays 0, so a word that was never seen says nothing by itself and only its n-grams speak. Two GRUs read a window of words in either direction, attention
pools their states, and a logistic unit scores the window. All overlapping windows of a text are scored; the text's
score is the calibrated maximum.

Labels mark texts, not windows, so training goes in rounds: first every window carries its text's label, then a toxic
text's windows count as toxic only if they stand out, and as clean if they don't. Fitted on a bounded sample of labelled rows
outside the held-out fold, one row for each id, with a fixed seed: reruns agree.

Cases: null and empty texts have one empty window and are scored; rows with equal texts have equal scores; all windows of a very
long text are scored, 4096 at a time; an empty table gives an empty result; without labels of both kinds every score is 0; extra columns are left out; ids, languages,
sources and labels are no inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import fold, kept_in_batches, labelled_ids, sample_texts, table
from tidemark.llm.shingles import _BASE, _BYTE, _INVERSE, _powers, chunks, mix

#: The model is fitted on at most so many labelled rows, a third of them toxic if there are as many. Of a text of more characters
#: than this, so many parts at even distances, as many characters together, are in the sample, which bounds its size. Scores are of whole texts.
SAMPLE_ROWS, SAMPLE_CHARS, SAMPLE_PARTS = 4500, 50_000, 20
FOLDS, HELD_OUT = 5, 0
#: Words in a window, and from one window's start to the next.
WINDOW, STRIDE = 32, 16
DW, DC, H, HA = 8, 8, 8, 8
ROUNDS, BATCH, RATE, DECAY, SEED = 4, 1024, 0.02, 0.5, 6
#: Texts of the sample that must have a word, or an n-gram, before it gets an embedding of its own.
LEAST_TEXTS, LEAST_GRAM_TEXTS = 5, 10
#: Bytes of a word, and how many a part of a longer one shares with the next.
STEP, SHARED = 16, 3
#: Character n-grams of a word: lengths at its front, at its back, and at all places between; and what their sum is divided by.
FRONT, BACK, INSIDE, SHRINK = (3, 4, 5), (3, 4), (3, 4), 8
GRAMS = len(FRONT) + len(BACK) + sum(STEP - n for n in INSIDE)

_LETTER = np.zeros(256, bool)
_LETTER[48:58] = _LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def word_features(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words' hashes (words x 1 + n-grams; 0 for none), each word's number among them, and how many words each text has."""
    n = len(data)
    inside = _LETTER[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    full = bounds[:-1] < bounds[1:]
    first[bounds[:-1][full]] = inside[bounds[:-1][full]]
    last[bounds[1:][full] - 1] = inside[bounds[1:][full] - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    parts = np.maximum(1, -(-(end - start - SHARED) // (STEP - SHARED)))
    turn = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
    start = np.repeat(start, parts) + turn * (STEP - SHARED)
    end = np.minimum(start + STEP, np.repeat(end, parts))
    counts = np.diff(np.searchsorted(start, bounds))
    if not len(start):
        return np.zeros((0, 1 + GRAMS), np.uint64), np.zeros(0, np.int64), counts
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * _powers(_BASE, n), out=sums[1:])
    back = _powers(_INVERSE, n + 1)
    hashed = lambda a, b, tag: mix((sums[b] - sums[a]) * back[a] + np.uint64(tag))
    whole, at, number = np.unique(hashed(start, end, 0), return_index=True, return_inverse=True)
    s, e = start[at], end[at]
    out = np.zeros((len(whole), 1 + GRAMS), np.uint64)
    out[:, 0], column = whole, 1
    for size in FRONT:
        out[:, column] = hashed(s, np.minimum(s + size, e), size)
        column += 1
    for size in BACK:
        out[:, column] = hashed(np.maximum(e - size, s), e, 100 + size)
        column += 1
    for size in INSIDE:
        for skip in range(1, STEP - size + 1):
            there = np.flatnonzero(s + skip + size <= e)
            out[there, column] = hashed(s[there] + skip, s[there] + skip + size, 200 + size)
            column += 1
    return out, number, counts


def rows_of(hashes: np.ndarray, known: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Embedding rows of words' and n-grams' hashes: their place among the known, sorted ones, or the last row."""
    out = np.empty(hashes.shape, np.int32)
    for part, k in ((slice(0, 1), known[0]), (slice(1, None), known[1])):
        at = np.minimum(np.searchsorted(k, hashes[:, part]), max(0, len(k) - 1))
        out[:, part] = np.where(k[at] == hashes[:, part], at, len(k)) if len(k) else 0
    return out


def common(hashes: np.ndarray, text: np.ndarray, number: np.ndarray, columns: range, least: int) -> np.ndarray:
    """Sorted hashes that at least so many texts have in one of these columns."""
    found = []
    for c in columns:
        h, code = np.unique(hashes[:, c], return_inverse=True)
        pairs = np.unique(text * len(h) + code[number])
        found.append(h[(np.bincount(pairs % len(h), minlength=len(h)) >= least) & (h != 0)])
    return np.unique(np.concatenate(found))


def windows(number: np.ndarray, counts: np.ndarray, none: int) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of all windows (windows x WINDOW, `none` beyond the text) and the text that each belongs to."""
    per = np.maximum(1, -(-(counts - STRIDE) // STRIDE))
    owner = np.repeat(np.arange(len(counts)), per)
    total = int(per.sum())
    inner = (np.arange(total) - np.repeat(np.cumsum(per) - per, per)) * STRIDE
    at = inner[:, None] + np.arange(WINDOW)
    ends = np.cumsum(counts)
    real = at < counts[owner][:, None]
    padded = np.append(number, none)
    return np.where(real, padded[np.minimum(at + (ends - counts)[owner][:, None], len(number))], none), owner


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * np.tanh(np.float32(0.5) * x) + np.float32(0.5)


class Network:
    """Parameters in a dict of float32 arrays, so that it travels as a closure's value."""

    def __init__(self, params: dict[str, np.ndarray] | None = None, words: int = 0, grams: int = 0):
        if params is None:
            rng = np.random.default_rng(SEED)
            init = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
            params = {"words": np.zeros((words + 1, DW), np.float32), "grams": np.zeros((grams + 1, DC), np.float32), "A": init(2 * H, HA), "v": init(HA), "o": init(2 * H), "bias": np.zeros(1, np.float32)}
            for d in "fb":
                params |= {f"W{d}": init(DW + DC, 3 * H), f"U{d}": init(H, 3 * H), f"c{d}": np.zeros(3 * H, np.float32)}
        self.p = params

    def inputs(self, buckets: np.ndarray) -> np.ndarray:
        """Input vectors of distinct words, and a last one for no word."""
        x = np.zeros((len(buckets) + 1, DW + DC), np.float32)
        x[:-1, :DW] = self.p["words"][buckets[:, 0]]
        for k in range(1, buckets.shape[1]):
            x[:-1, DW:] += self.p["grams"][buckets[:, k]]
        x[:-1, DW:] /= SHRINK
        return x

    def forward(self, x: np.ndarray, idx: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Logits of windows; keep: gets what backward needs."""
        n, t = idx.shape
        states = np.zeros((t, n, 2 * H), np.float32)
        none = len(x) - 1
        for d, steps in (("f", range(t)), ("b", range(t - 1, -1, -1))):
            gates, u, h = x @ self.p["W" + d] + self.p["c" + d], self.p["U" + d], np.zeros((n, H), np.float32)
            part, kept_steps = slice(0, H) if d == "f" else slice(H, 2 * H), []
            for s in steps:
                i = idx[:, s]
                g, hu = gates[i], h @ u
                zr = _sigmoid(g[:, : 2 * H] + hu[:, : 2 * H])
                z, r = zr[:, :H], zr[:, H:]
                new = np.tanh(g[:, 2 * H :] + r * hu[:, 2 * H :])
                real = (i != none)[:, None]
                after = np.where(real, new + z * (h - new), h)
                if keep is not None:
                    kept_steps.append((s, h, z, r, new, hu[:, 2 * H :], real))
                h = after
                states[s, :, part] = h
            if keep is not None:
                keep.append(kept_steps)
        seen = (idx != none).T
        a = np.tanh(states @ self.p["A"])
        e = np.where(seen, a @ self.p["v"], np.float32(-1e9))
        w = np.exp(e - e.max(0))
        w /= w.sum(0)
        pooled = (w[:, :, None] * states).sum(0)
        if keep is not None:
            keep += [states, a, w, pooled]
        return pooled @ self.p["o"] + self.p["bias"][0]

    def gradients(self, buckets: np.ndarray, x: np.ndarray, idx: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        keep: list = []
        logit = self.forward(x, idx, keep)
        back_steps, (states, a, w, pooled) = keep[:2], keep[2:]
        d_logit = ((_sigmoid(logit) - y) * weight / max(1.0, weight.sum())).astype(np.float32)
        g = {"o": pooled.T @ d_logit, "bias": np.array([d_logit.sum()], np.float32)}
        d_pooled = d_logit[:, None] * self.p["o"]
        d_states = w[:, :, None] * d_pooled
        d_w = (states * d_pooled).sum(2)
        d_e = w * (d_w - (w * d_w).sum(0))
        d_a = d_e[:, :, None] * self.p["v"] * (1 - a * a)
        g["v"] = np.einsum("tn,tnk->k", d_e, a)
        g["A"] = states.reshape(-1, 2 * H).T @ d_a.reshape(-1, HA)
        d_states += d_a @ self.p["A"].T
        d_x = np.zeros((*idx.shape, DW + DC), np.float32)
        for d, steps, part in (("f", back_steps[0], slice(0, H)), ("b", back_steps[1], slice(H, 2 * H))):
            u, wx = self.p["U" + d], self.p["W" + d]
            gu, gw, gc, dh = np.zeros_like(u), np.zeros_like(wx), np.zeros(3 * H, np.float32), 0
            for s, h, z, r, new, hn, real in reversed(steps):
                dh = dh + d_states[s, :, part]
                d_new = np.where(real, dh, 0) * (1 - z) * (1 - new * new)
                d_z = np.where(real, dh, 0) * (h - new) * z * (1 - z)
                d_r = d_new * hn * r * (1 - r)
                d_g = np.concatenate([d_z, d_r, d_new], 1)
                d_hu = np.concatenate([d_z, d_r, d_new * r], 1)
                gu += h.T @ d_hu
                gw += x[idx[:, s]].T @ d_g
                gc += d_g.sum(0)
                d_x[:, s] += d_g @ wx.T
                dh = np.where(real, dh * z, dh) + d_hu @ u.T
            g |= {"U" + d: gu, "W" + d: gw, "c" + d: gc}
        flat, d_x = idx.ravel(), d_x.reshape(-1, DW + DC)
        per_word = np.stack([np.bincount(flat, d_x[:, k], len(x)) for k in range(DW + DC)], 1)[:-1]
        used = np.flatnonzero(np.bincount(flat, minlength=len(x))[:-1])
        b, per_word = buckets[used], per_word[used]
        words, grams = len(self.p["words"]), len(self.p["grams"])
        g["words"] = np.stack([np.bincount(b[:, 0], per_word[:, k], words) for k in range(DW)], 1).astype(np.float32)
        many = np.repeat(per_word[:, DW:], b.shape[1] - 1, 0) / SHRINK
        g["grams"] = np.stack([np.bincount(b[:, 1:].ravel(), many[:, k], grams) for k in range(DC)], 1).astype(np.float32)
        g["words"][-1] = g["grams"][-1] = 0
        return g


def _per_text(values: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """The largest value of each text's windows; owners are sorted and have no gaps."""
    return np.maximum.reduceat(values, np.flatnonzero(np.append(True, owner[1:] != owner[:-1])))


def learn(texts: list[str], y: np.ndarray, toxic_share: float = 0.5) -> tuple[dict[str, np.ndarray], tuple, float, float]:
    """Parameters, known hashes, and the line from a text's largest logit to its calibrated one."""
    raw = [t.encode() for t in texts]
    hashes, number, counts = word_features(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
    text = np.repeat(np.arange(len(texts)), counts)
    known = common(hashes, text, number, range(1), LEAST_TEXTS), common(hashes, text, number, range(1, hashes.shape[1]), LEAST_GRAM_TEXTS)
    buckets = rows_of(hashes, known)
    idx, owner = windows(number, counts, len(buckets))
    net, rng = Network(None, *map(len, known)), np.random.default_rng(SEED)
    target, weight = y[owner].astype(np.float32), np.where(y[owner] == 1, 0.5, 1).astype(np.float32)
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    turn = 0
    for round_ in range(ROUNDS):
        if round_:
            logit = score_windows(net, buckets, idx)
            top = _per_text(logit, owner)[owner]
            toxic = y[owner] == 1
            target = (toxic & (logit >= top - 0.5)).astype(np.float32)
            weight = np.where(toxic & (target == 0) & (logit > top - 3), 0, 1).astype(np.float32)
            weight *= np.where(target == 1, max(1.0, (target == 0).sum() / max(1, target.sum()) / 4), 1)
        order = rng.permutation(np.flatnonzero(weight > 0))
        for first in range(0, len(order), BATCH):
            rows = order[first : first + BATCH]
            words_here, local = np.unique(idx[rows], return_inverse=True)
            real = words_here[words_here < len(buckets)]
            b = buckets[real]
            g = net.gradients(b, net.inputs(b), local.reshape(len(rows), WINDOW), target[rows], weight[rows])
            turn += 1
            for k, d in g.items():
                m, v = moment[k]
                m += 0.1 * (d - m)
                v += 0.001 * (d * d - v)
                if k in ("words", "grams"):
                    net.p[k] *= 1 - RATE * DECAY
                net.p[k] -= (RATE * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.999**turn)) + 1e-7)).astype(np.float32)
    top = _per_text(score_windows(net, buckets, idx), owner).astype(float)
    slope, shift = 1.0, 0.0
    for _ in range(200):  # logistic regression on one variable, labels weighted as they are among all labelled rows
        p = 1 / (1 + np.exp(-np.clip(slope * top + shift, -30, 30)))
        by = np.where(y == 1, toxic_share / max(1, (y == 1).sum()), (1 - toxic_share) / max(1, (y == 0).sum()))
        r, q = by * (p - y), by * p * (1 - p)
        hess = np.array([[(q * top * top).sum() + 1e-3, (q * top).sum()], [(q * top).sum(), q.sum() + 1e-3]])
        step = np.linalg.solve(hess, [(r * top).sum() + 1e-3 * (slope - 1), r.sum() + 1e-3 * shift])
        slope, shift = slope - np.clip(step[0], -1, 1), shift - np.clip(step[1], -1, 1)
        if np.abs(step).max() < 1e-8:
            break
    return net.p, known, max(float(slope), 1e-3), float(shift)


def score_windows(net: Network, buckets: np.ndarray, idx: np.ndarray, at_once: int = 4096) -> np.ndarray:
    x = net.inputs(buckets)
    return np.concatenate([net.forward(x, idx[i : i + at_once]) for i in range(0, len(idx), at_once)])


def _score(model: tuple):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network(model[0])
        for b in batches:
            for first, last, data, bounds in chunks(b.column("text")):
                hashes, number, counts = word_features(data, bounds)
                buckets = rows_of(hashes, model[1])
                idx, owner = windows(number, counts, len(buckets))
                top = _per_text(score_windows(net, buckets, idx), owner).astype(float)
                # rounded, as the last digits of single precision depend on a text's company in its batch
                score = np.round(1 / (1 + np.exp(-np.clip(model[2] * top + model[3], -700, 700))), 6)
                yield pa.RecordBatch.from_arrays([b.column("doc_id")[first:last].cast(pa.int64()), pa.array(score, pa.float64())], ["doc_id", "score"])

    return run


def fit(docs: DataFrame, labels: DataFrame) -> tuple | None:
    rows = fold(F.col("doc_id"), FOLDS) != HELD_OUT
    share = labels.where(rows & F.col("toxic").isin(0, 1)).agg(F.avg("toxic")).first()[0]
    ids = labelled_ids(labels, "toxic", SAMPLE_ROWS, rows, ones=SAMPLE_ROWS // 3)
    part = SAMPLE_CHARS // SAMPLE_PARTS
    parts = F.transform(F.sequence(F.lit(0), F.lit(SAMPLE_PARTS - 1)), lambda i: F.substring("text", (i * (F.length("text") - part) / (SAMPLE_PARTS - 1)).cast("int") + 1, F.lit(part)))
    text = F.when(F.length("text") <= SAMPLE_CHARS, F.col("text")).otherwise(F.array_join(parts, "\n"))
    got = sorted((r.doc_id, r.y, r.text or "") for r in sample_texts(docs, ids).select("doc_id", "y", text.alias("text")).collect())
    if len({y for _, y, _ in got}) < 2:
        return None
    return learn([t for _, _, t in got], np.array([y for _, y, _ in got]), share)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted, a row for each row of docs."""
    model = fit(docs, labels)
    if model is None:
        out = docs.select("doc_id", F.lit(0.0).alias("score"))
    else:
        out = kept_in_batches(docs.select("doc_id", "text").mapInArrow(_score(model), "doc_id long, score double"), 1024)
    held = F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
