"""Operator 4: byte-level BPE encoding and decoding by DuckDB's recursive queries, one database per Python worker.

The pattern cuts texts into pieces. Pieces that the worker hasn't met yet become token-position rows, one for
each byte; a recursive query joins neighbouring rows with the merge table and contracts every piece's leftmost pair
of minimum rank, until no pair is left. Pieces of over LONG bytes contract all their pairs of minimum rank in one pass,
from the left, none overlapping: that is the same, as a new pair always has a higher rank than the one it came from, the
vocabulary being one in which every token encodes to itself. Decoding is an ordered aggregation of the tokens' bytes.

Texts are taken in slices of a bounded number of bytes, and longer ones in parts of as many bytes that are
digested one after another; a query gets a bounded number of bytes, and the table of known pieces loses those that were met least when it has
grown past a bound. So memory follows neither the partition's size nor a text's, but for a text's own bytes and those of a single piece.
Nothing is shuffled and nothing is written locally.

Cases: a null text is an empty one; both have no tokens; a null id stays null; an empty table gives an empty result; repeated
rows are encoded one by one; a text of any length is encoded whole; extra columns, whatever their names, are left out.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import kept_in_batches, table
from tidemark.llm.shingles import chunks

#: Bytes of text worked on at once, bytes that a query contracts at once, and known pieces and their bytes that are kept.
SLICE, CALL, KNOWN, KNOWN_BYTES = 2 << 20, 1 << 20, 500_000, 16 << 20
ENCODED = "doc_id long, n_tokens long, ids binary, decoded binary"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
IDS = "doc_id long, n_tokens long, ids binary, decoded_sha256 string"

#: Bytes of a piece: a longer one contracts many pairs in a pass; one beyond LONGEST would still take minutes (300,000 random
#: letters: 160 s, and its rows 400 MB) and is merged by the same rule with a heap.
LONG, LONGEST = 64, 16_384

#: A row is a token at a position: k holds the piece's number above 16 bits of position, and positions stay dense.
#: Every pass keeps the rows of pieces that had a pair to merge in the last one; a piece leaves when it has none.
#: low holds the piece's smallest rank above the leftmost position that has it.
ENCODE = """
WITH RECURSIVE step(k, tok, live) AS (
    SELECT k, tok, true FROM bytes_of
  UNION ALL
    SELECT CASE WHEN (k & 65535) > (low & 65535) THEN k - 1 ELSE k END,
           CASE WHEN (k & 65535) = (low & 65535) THEN (low >> 16)::INT ELSE tok END,
           low IS NOT NULL
    FROM (SELECT k, tok, low FROM (SELECT k, tok FROM step WHERE live) rows_of LEFT JOIN (
        SELECT a.k >> 16 AS piece, min((merges.merged::BIGINT << 16) | (a.k & 65535)) AS low
        FROM step a JOIN step b ON b.k = a.k + 1 JOIN merges ON merges.pair = (a.tok::BIGINT << 32) | b.tok
        WHERE a.live AND b.live GROUP BY 1) pairs ON pairs.piece = rows_of.k >> 16)
    WHERE low IS NULL OR (k & 65535) <> (low & 65535) + 1
)
SELECT k >> 16 AS piece, list(tok ORDER BY k) AS ids FROM step WHERE NOT live GROUP BY 1
"""

#: Long pieces: every token knows the position of the next one; a pass returns the changed rows alone, contracted ones as -1.
#: In a run of overlapping pairs every second one is taken, from the left. A piece without a pair left isn't looked at again.
ENCODE_LONG = """
WITH RECURSIVE step(k, tok, next) USING KEY (k) AS (
    SELECT k, tok, lead(k) OVER (PARTITION BY k >> 16 ORDER BY k) FROM bytes_of
  UNION
    SELECT * FROM (
    WITH live AS (SELECT k, tok, next FROM recurring.step WHERE tok >= 0 AND k >> 16 IN (SELECT k >> 16 FROM step)),
    pairs AS (SELECT a.k, a.next, b.next AS after, merged, min(merged) OVER (PARTITION BY a.k >> 16) AS low
        FROM live a JOIN live b ON b.k = a.next JOIN merges ON merges.pair = (a.tok::BIGINT << 32) | b.tok),
    least AS (SELECT *, CASE WHEN lag(next) OVER (ORDER BY k) = k THEN 0 ELSE 1 END AS head FROM pairs WHERE merged = low),
    runs AS (SELECT *, sum(head) OVER (ORDER BY k) AS run FROM least),
    taken AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY k) AS place FROM runs) WHERE place % 2 = 1)
    SELECT k, merged, after FROM taken UNION ALL SELECT next, -1, NULL FROM taken)
)
SELECT k >> 16 AS piece, list(tok ORDER BY k) AS ids FROM step WHERE tok >= 0 GROUP BY 1
"""

#: A token's bytes are written as the characters with these numbers (0 as 256), so that any bytes make a string.
DECODE = "SELECT doc, array_to_string(list(chars ORDER BY pos), '') FROM tokens JOIN vocabulary USING (tok) GROUP BY doc"


@lru_cache(1)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def bounded(items: list[int], sizes: list[int], most: int) -> Iterator[list[int]]:
    """items in groups of at most so many bytes together, or one."""
    first, total = 0, 0
    for i, size in enumerate(sizes):
        if i > first and total + size > most:
            yield items[first:i]
            first, total = i, 0
        total += size
    if items:
        yield items[first:]


class Codec:
    """A task's database: the merge table, the vocabulary and the pieces met so far."""

    def __init__(self, path: str, pattern: str):
        import duckdb
        import regex

        self.ranks, self.pattern = ranks(path), regex.compile(pattern)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "300MB", "temp_directory": ""})
        left, right, merged = [], [], []
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(rank)
        pairs = pa.table({"pair": pa.array(np.array(left, np.int64) << 32 | np.array(right, np.int64)), "merged": pa.array(merged, pa.int32())})  # noqa: F841
        words = pa.table({"tok": pa.array(self.ranks.values(), pa.int32()), "chars": pa.array([t.decode("latin-1").replace("\0", "Ā") for t in self.ranks])})  # noqa: F841
        self.db.execute("CREATE TABLE merges AS SELECT * FROM pairs")
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM words")
        self.byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.forget()

    def forget(self, keep: int = 0) -> None:
        """Known pieces go, but for `keep` of them that were met most often, and more than once."""
        kept = np.zeros(0, np.int64)
        if keep:
            often = np.flatnonzero(self.hits > 1)
            kept = np.sort(often[np.argsort(-self.hits[often], kind="stable")[:keep]])
        pieces = list(self.known) if keep else []
        ids = [self.ids[self.starts[i] : self.starts[i + 1]] for i in kept]
        self.known: dict[str, int] = {pieces[i]: n for n, i in enumerate(kept)}
        self.known_bytes = sum(map(len, self.known))
        self.ids = np.concatenate([np.zeros(0, np.int32), *ids])
        self.starts, self.hits = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64), np.zeros(len(kept), np.int64)

    def learn(self, pieces: list[str]) -> None:
        """Ids of pieces that aren't known: whole tokens as they are, the others by the recursive queries."""
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        ids = [[self.ranks[r]] if r in self.ranks else None for r in raw]
        short, long = [], []
        for i, r in enumerate(raw):
            if ids[i] is None and len(r) > LONGEST:
                ids[i] = self.merged(r)
            elif ids[i] is None:
                (long if len(r) > LONG else short).append(i)
        for query, some, most in ((ENCODE, short, CALL), (ENCODE_LONG, long, LONGEST)):
            for part in bounded(some, [len(raw[i]) for i in some], most):
                for i, found in self.contracted(query, [raw[i] for i in part]):
                    ids[part[i]] = found
        self.known_bytes += sum(map(len, raw))
        first = len(self.known)
        self.known.update(zip(pieces, range(first, first + len(pieces)), strict=True))
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(ids), np.int32)])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum([len(x) for x in ids])])

    def contracted(self, query: str, raw: list[bytes]) -> list[tuple[int, list[int]]]:
        """Number and ids of each piece, by a recursive query over its bytes."""
        if not raw:
            return []
        size = np.array([len(r) for r in raw])
        data = np.frombuffer(b"".join(raw), np.uint8)
        pos = np.arange(len(data)) - np.repeat(np.cumsum(size) - size, size)
        self.db.register("bytes_of", pa.table({"k": pa.array(np.repeat(np.arange(len(raw)), size) << 16 | pos), "tok": pa.array(self.byte[data])}))
        try:
            return self.db.execute(query).fetchall()
        finally:
            self.db.unregister("bytes_of")

    def merged(self, raw: bytes) -> list[int]:
        """The same contraction for one long piece: the leftmost pair of minimum rank comes off a heap."""
        tok, n = [bytes([x]) for x in raw], len(raw)
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := self.ranks.get(tok[i] + tok[i + 1])) is not None]
        heapify(heap)
        while heap:
            rank, i = heappop(heap)
            j = right[i] if tok[i] else n
            if j == n or self.ranks.get(tok[i] + tok[j]) != rank:
                continue
            tok[i], tok[j], right[i] = tok[i] + tok[j], b"", right[j]
            if right[i] < n:
                left[right[i]] = i
            for a in (left[i], i):
                if a >= 0 and right[a] < n and (r := self.ranks.get(tok[a] + tok[right[a]])) is not None:
                    heappush(heap, (r, a))
        return [self.ranks[t] for t in tok if t]

    def parts(self, texts: list[str]) -> Iterator[tuple[int, list[list[str]]]]:
        """The pieces of texts: the first text's number and the pieces of each from there on; a long text alone, a part at a time."""
        if len(texts) > 1 or len(texts[0]) <= SLICE // 4:
            yield 0, [self.pattern.findall(t) for t in texts]
            return
        part, size = [], 0
        for m in self.pattern.finditer(texts[0]):
            part.append(m[0])
            size += len(m[0].encode("utf-8", "surrogatepass"))
            if size >= SLICE:
                yield 0, [part]
                part, size = [], 0
        if part:
            yield 0, [part]

    def encode(self, found: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts' pieces, one after another, and how many each text has."""
        pieces = list(chain.from_iterable(found))
        if len(self.known) > KNOWN or self.known_bytes > KNOWN_BYTES:
            self.forget(KNOWN // 2)
        if self.known_bytes > KNOWN_BYTES // 2 and not self.hits.any():
            self.forget()  # what was kept is long
        new = list(set(pieces) - self.known.keys())
        if new:
            self.learn(new)
        number = np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))
        met = np.bincount(number, minlength=len(self.starts) - 1)
        met[: len(self.hits)] += self.hits
        self.hits = met
        size = self.starts[number + 1] - self.starts[number]
        ends = np.cumsum(size)
        ids = self.ids[np.repeat(self.starts[number] - (ends - size), size) + np.arange(int(size.sum()))]
        upto = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int64)]
        return ids, np.diff(upto)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        tokens = pa.table({"doc": pa.array(np.repeat(np.arange(len(counts)), counts), pa.int32()), "pos": pa.array(np.arange(len(ids)), pa.int32()), "tok": pa.array(ids)})
        self.db.register("tokens", tokens)
        got = self.db.execute(DECODE).fetchall()
        self.db.unregister("tokens")
        out = [b""] * len(counts)
        for doc, text in got:
            out[doc] = text.replace("Ā", "\0").encode("latin-1")
        return out


@lru_cache(1)
def codec_of(path: str, pattern: str) -> Codec:
    """The database of this Python worker; the next partition that it takes finds the pieces of the last one."""
    return Codec(path, pattern)


class _Digest:
    """Takes bytes in parts; holds their digest alone."""

    def __init__(self):
        self.of = sha256()

    def add(self, part: bytes) -> None:
        self.of.update(part)

    def value(self) -> str:
        return self.of.hexdigest()


class _Whole:
    """Takes bytes in parts; holds them all."""

    def __init__(self):
        self.parts: list[bytes] = []

    def add(self, part: bytes) -> None:
        self.parts.append(part)

    def value(self) -> bytes:
        return b"".join(self.parts)


def _run(path: str, pattern: str, schema: str):
    names, types = zip(*(c.split() for c in schema.split(", ")), strict=True)
    (of_ids, ids_type), (of_back, back_type) = ((_Digest, pa.string()) if t == "string" else (_Whole, pa.binary()) for t in types[2:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codec = codec_of(path, pattern)
            for first, last, _, _ in chunks(b.column("text"), SLICE):
                texts = [t or "" for t in b.column("text")[first:last].to_pylist()]
                n, raw, back = np.zeros(len(texts), np.int64), [of_ids() for _ in texts], [of_back() for _ in texts]
                for at, found in codec.parts(texts):
                    ids, counts = codec.encode(found)
                    ends, decoded, as_bytes = np.cumsum(counts), codec.decode(ids, counts), ids.astype("<u4")
                    for k, (e, c) in enumerate(zip(ends, counts, strict=True)):
                        n[at + k] += c
                        raw[at + k].add(as_bytes[e - c : e].tobytes())
                        back[at + k].add(decoded[k])
                rows = [b.column("doc_id")[first:last].cast(pa.int64()), pa.array(n), pa.array([x.value() for x in raw], ids_type), pa.array([x.value() for x in back], back_type)]
                yield pa.RecordBatch.from_arrays(rows, names=names)

    return run


def encoded(docs: DataFrame, path: str, pattern: str, schema: str = ENCODED) -> DataFrame:
    """One row per document, stored: ids as little-endian unsigned 32-bit integers and the bytes that they decode to (ENCODED), or the digest of the second (IDS) or of both (DIGESTS)."""
    return kept_in_batches(docs.select("doc_id", "text").mapInArrow(_run(path, pattern, schema), schema), 1024)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, DIGESTS)
