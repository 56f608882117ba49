import base64
import random
from hashlib import sha256

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import functions as F

from tests.llm.helpers import docs, prose
from tidemark.llm import bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
TEXTS = [None, "", " ", "a" * 3000, " " * 500 + "x", "hello world's <|endoftext|>", "é中文😀\x00\x01\n\n  \t end  ", prose(1, 3000), "ab" * 40 + " " + "=-" * 70, "\x85　 x", prose(1, 50), prose(1, 50)]


def test_same_as_the_library(spark, monkeypatch):
    monkeypatch.setattr(bpe, "SLICE", 4000)
    monkeypatch.setattr(bpe, "KNOWN", 50)
    monkeypatch.setattr(bpe, "CALL", 300)
    own = library()
    out = {r.doc_id: r for r in bpe.encoded(docs(spark, list(enumerate(TEXTS))), PATH, PATTERN).collect()}
    digests = {r.doc_id: r for r in bpe.encoded(docs(spark, list(enumerate(TEXTS))), PATH, PATTERN, bpe.DIGESTS).collect()}
    for i, t in enumerate(TEXTS):
        want = np.array(own.encode_ordinary(t or ""), "<u4").tobytes()
        assert bytes(out[i].ids) == want and out[i].n_tokens == len(want) // 4 and bytes(out[i].decoded) == (t or "").encode()
        assert digests[i].ids_sha256 == sha256(want).hexdigest() and digests[i].decoded_sha256 == sha256((t or "").encode()).hexdigest()


def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_heap_and_queries_agree():
    codec, rng = bpe.Codec(PATH, PATTERN), random.Random(4)
    pieces = [w.encode() for t in TEXTS[5:8] for w in codec.pattern.findall(t)]
    pieces += ["".join(rng.choice(letters) for _ in range(n)).encode() for letters in ("a", "ab", "acgt", "abcdefghijklmnop", "=-") for n in (2, 5, 40, 64)]
    want = [codec.merged(p) for p in pieces]
    for query in (bpe.ENCODE, bpe.ENCODE_LONG):
        assert [ids for _, ids in sorted(codec.contracted(query, pieces))] == want
    for letters in ("a", "ab", "aab", "abcdefghijklmnop", "acgt"):
        long = "".join(rng.choice(letters) for _ in range(3000)).encode()
        assert codec.contracted(bpe.ENCODE_LONG, [long, long[:70]]) is not None
        assert dict(codec.contracted(bpe.ENCODE_LONG, [long, long[:70]])) == {0: codec.merged(long), 1: codec.merged(long[:70])}


def test_every_token_encodes_to_itself():
    """What makes it exact to contract all pairs of a rank at once."""
    codec = bpe.Codec(PATH, PATTERN)
    assert all(codec.merged(t) == [r] for t, r in codec.ranks.items())


def test_text_of_millions_of_tokens(spark):
    text = prose(9, 1_400_000) + " " + "b" * 70_000 + " end"
    got = bpe.encoded(docs(spark, [(1, text), (2, "short")]).withColumns({"ids": F.lit(1), "n_tokens": F.lit("x")}), PATH, PATTERN, bpe.DIGESTS).where("doc_id = 1").first()
    want = np.array(library().encode_ordinary(text), "<u4")
    assert len(want) > 4_000_000 and got.n_tokens == len(want)
    assert got.ids_sha256 == sha256(want.tobytes()).hexdigest() and got.decoded_sha256 == sha256(text.encode()).hexdigest()


def test_long_text_of_long_pieces():
    """8 MB of distinct words of 60 letters, and a few of thousands: neither parts nor queries outgrow the database's memory."""
    rng = random.Random(11)
    text = " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=60)) for _ in range(130_000)) + " " + " ".join("".join(rng.choices("acgt", k=5000)) for _ in range(20))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([text, "x"])], ["doc_id", "text"])
    got = pa.Table.from_batches(bpe._run(PATH, PATTERN, bpe.DIGESTS)([batch])).to_pylist()[0]
    want = np.array(library().encode_ordinary(text), "<u4")
    assert len(text) > 8_000_000 and got["n_tokens"] == len(want)
    assert got["ids_sha256"] == sha256(want.tobytes()).hexdigest() and got["decoded_sha256"] == sha256(text.encode()).hexdigest()


def test_null_id(spark):
    assert [(r.doc_id, r.n_tokens) for r in bpe.encoded(docs(spark, [(None, "a"), (None, None)]), PATH, PATTERN).orderBy("n_tokens").collect()] == [(None, 0), (None, 1)]


def test_empty_table(spark):
    assert bpe.encoded(docs(spark, []), PATH, PATTERN).count() == 0
