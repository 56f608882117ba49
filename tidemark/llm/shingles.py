"""Word shingles of many texts at once, in numpy: one pass over the bytes of a batch, no loop over words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

SHINGLE = 5

_rng = np.random.default_rng(20261126)
#: A random number for each byte; A-Z share those of a-z, spaces have none.
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: Bytes of text that are worked on at once.
CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[:1] = 1
    return np.cumprod(p, dtype=np.uint64)


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts that lie one after another in data, and how many words each text has.

    bounds: where each text starts, and where the last one ends. A-Z count as a-z.
    """
    n, texts = len(data), len(bounds) - 1
    if not n:
        return np.zeros(0, np.uint64), np.zeros(texts, np.int64)
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = bounds[:-1][bounds[:-1] < bounds[1:]]
    first[heads] = inside[heads]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    ends = bounds[1:][bounds[:-1] < bounds[1:]] - 1
    last[ends] = inside[ends]
    start, end = np.flatnonzero(first), np.flatnonzero(last)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * _powers(_BASE, n), out=sums[1:])
    raw = (sums[end + 1] - sums[start]) * _powers(_INVERSE, n)[start]
    return mix(raw + (end - start).astype(np.uint64)), np.diff(np.searchsorted(start, bounds))


def shingle_hashes(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the 5-word shingles of each text, repeats included; a shorter text is one shingle, an empty one none."""
    per = np.where(counts >= SHINGLE, counts - SHINGLE + 1, np.minimum(counts, 1))
    total = int(per.sum())
    ends = np.cumsum(counts)
    at = np.repeat(ends - counts - (np.cumsum(per) - per), per) + np.arange(total)
    left = np.minimum(np.repeat(ends, per) - at, SHINGLE)
    padded = np.concatenate([words, np.zeros(SHINGLE, np.uint64)])
    out = np.zeros(total, np.uint64)
    for k in range(SHINGLE):
        out = out * _STEP + np.where(k < left, mix(padded[at + k] + np.uint64(k + 1)), np.uint64(0))
    return mix(out), per


def chunks(texts: pa.Array, most: int = CHUNK):
    """Slices (first, last, bytes, bounds) of a string array with about `most` bytes each; one text is never split."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    size = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    first, n = 0, len(texts)
    while first < n:
        last = first + max(1, int(np.searchsorted(np.cumsum(size[first:]), most, side="right")))
        part = size[first:last]
        data = b"".join(x.as_buffer() for x in texts[first:last] if x.is_valid)
        yield first, last, np.frombuffer(data, np.uint8), np.concatenate([[0], np.cumsum(part)])
        first = last
