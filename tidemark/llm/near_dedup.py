"""Operator 5: near-duplicates by chosen-path similarity join on minhashed 5-word shingles.

Texts with the same words form one class, so exact copies are never compared. Every class gets K minwise hashes
of its shingle set. In each of TREES independent trees a node of the tree chooses one coordinate, or two, so that
4/3 are chosen on average (1 / similarity); its classes branch by the token that is minwise there.

1. At the first level each class is held against the smallest class of its node, which is one comparison for each
   class and node, however large a group of copies is. What links goes into components.
2. Nodes that still hold several components are compared exhaustively if they are small; the large ones branch
   again. A node whose classes are in one component already is done: no link between texts is lost by that, as it
   could not change a component. Before they branch, classes go that no pair could pass the sketch test with: those of whose
   coordinates under SKETCH hold a token that another component's class of a large node has too (texts that only share
   a passage). A class's children are counted before rows are made of them; one without several components gets none. What is still large at the deepest level is a dense group: there every class outside
   the group's largest component is held against all others, in blocks of full shingle sets that are bounded in classes and bytes.

Pairs whose minhashes agree in under SKETCH of K coordinates are passed over (at similarity 0.75 that loses a pair
with probability 4e-8), and so are those that a bitmap of BITS bits for each set shows to be unlike: every bit that one set alone has
is a shingle that the other lacks, so this bound loses no pair. All others are confirmed on the full shingle sets. A pair of similarity 0.75 is in one node of some tree
at each level but with a probability under 1e-6 (a million pairs drawn, none missed). Nothing but counts comes to the driver.

A node's rows meet the node's own figures, never each other, and nodes that very many classes share get them by a
broadcast, so a large group of copies doesn't come to one task.

Cases: null and empty texts, and those of spaces only, have no shingles and stand alone; rows with equal texts share a
component; a null id is never the smallest, and a component of null ids has a null id and keeps no row, but goes whole
through `one_of_each`, which has no id to choose by; rows with equal ids and texts are kept or dropped together; a very long text is one set, made from its bytes in one pass; an empty table
gives an empty result; extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import BROADCAST_ROWS, alone, checked, fresh, joined_by_key, kept, kept_in_batches, table
from tidemark.llm.shingles import chunks, mix, shingle_hashes, word_hashes

#: Coordinates of the sketch, independent trees, largest node that is compared exhaustively, deepest level.
K, TREES, SMALL, DEEPEST = 64, 20, 64, 3
#: Classes in a block of a dense group, and bytes of their texts.
BLOCK, BLOCK_BYTES = 512, 4 << 20
#: Similarity in hundredths, and the number of equal coordinates under which a pair is not confirmed.
SIMILAR, SKETCH = 75, 28
#: Bits of a set's bitmap. Of sets with many more shingles nearly all bits are set, so it passes over fewer of their pairs.
BITS = 1024

_rng = np.random.default_rng(75)
_A, _B = _rng.integers(1, 2**63, K, dtype=np.uint64) | np.uint64(1), _rng.integers(0, 2**63, K, dtype=np.uint64)

SKETCHED = "doc_id long, text_key long, key binary, n_shingles long, n_bytes long, sketch binary"
NODE = ["tree", "path"]


def _distinct(h: np.ndarray, per: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The set of each text's hashes, sorted, and its size."""
    ends = np.cumsum(per)
    for e, n in zip(ends, per, strict=True):
        h[e - n : e].sort()
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    new[(ends - per)[per > 0]] = True
    at = np.concatenate([[0], np.cumsum(new)])
    return h[new], at[ends] - at[ends - per]


def minhash(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """K minima for each set that starts at one of starts; no set is empty."""
    out = np.empty((len(starts), K), np.uint32)
    for k in range(K):
        out[:, k] = np.minimum.reduceat(((h * _A[k] + _B[k]) >> np.uint64(32)).astype(np.uint32), starts)
    return out


def bitmaps(h: np.ndarray, per: np.ndarray) -> np.ndarray:
    """A bitmap for each set of per hashes: the bits that its hashes fall on."""
    bits = np.zeros((len(per), BITS), bool)
    bits[np.repeat(np.arange(len(per)), per), (mix(h) % np.uint64(BITS)).astype(np.int64)] = True
    return np.packbits(bits, axis=1).view(np.uint32)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from hashlib import blake2b

    for b in batches:
        for first, last, data, bounds in chunks(b.column("text")):
            words, counts = word_hashes(data, bounds)
            h, per = _distinct(*shingle_hashes(words, counts))
            full = per > 0
            sketch = minhash(h, (np.cumsum(per) - per)[full]) if full.any() else np.zeros((0, K), np.uint32)
            ends, rows = np.cumsum(counts), iter(np.hstack([sketch, bitmaps(h, per[full]), per[full, None].astype(np.uint32)]))
            keys = [blake2b(words[e - n : e].tobytes(), digest_size=16).digest() if n else None for e, n in zip(ends, counts, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id")[first:last].cast(pa.int64()), b.column("text_key")[first:last], pa.array(keys, pa.binary()), pa.array(per, pa.int64()), pa.array(np.diff(bounds), pa.int64()), pa.array([next(rows).tobytes() if x else None for x in full], pa.binary())],
                ["doc_id", "text_key", "key", "n_shingles", "n_bytes", "sketch"],
            )


def sketched(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_key")).mapInArrow(_sketch, SKETCHED)


def _choose(tree: np.ndarray, path: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The children that a node's classes go to: row numbers and new paths. The node alone decides on its coordinates."""
    rows, paths = [], []
    for turn in range(2):
        r = mix(path + mix(tree.astype(np.uint64) * np.uint64(2) + np.uint64(turn + 1)))
        going = np.flatnonzero((r >> np.uint64(32)) % np.uint64(3) == 0) if turn else np.arange(len(path))
        at = (r[going] % np.uint64(K)).astype(np.int64)
        rows.append(going)
        paths.append(mix(r[going] + mix(at.astype(np.uint64) << np.uint64(32) | sketch[going, at].astype(np.uint64))))
    return np.concatenate(rows), np.concatenate(paths).astype(np.int64)


def _whole(sketches: list[bytes]) -> np.ndarray:
    """A row for each sketch: K minima, the bitmap and the set's size."""
    return np.frombuffer(b"".join(sketches), np.uint32).reshape(-1, K + BITS // 32 + 1)


def _sketches(column: pa.Array) -> np.ndarray:
    return _whole(column.to_pylist())[:, :K]


def _alike(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which rows of whole sketches can be of linked sets: no more is shared than what is left without the bits that one set alone has."""
    (u, n), (v, m) = ((z[:, K:-1], z[:, -1].astype(np.int64)) for z in (x, y))
    most = np.minimum(n - np.bitwise_count(u & ~v).sum(1, np.int64), m - np.bitwise_count(v & ~u).sum(1, np.int64))
    return 100 * most >= SIMILAR * (n + m - most)


def _grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From key and sketch: the nodes of the first level of all trees."""
    for b in batches:
        s = _sketches(b.column("sketch"))
        for tree in range(TREES):
            t = np.full(len(s), tree)
            rows, paths = _choose(t, np.zeros(len(s), np.uint64), s)
            yield pa.RecordBatch.from_arrays([pa.array(t[rows], pa.int32()), pa.array(paths), b.column("key").take(pa.array(rows))], ["tree", "path", "key"])


def _branch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row with the paths of its children: one, or two where the node chose a second coordinate."""
    for b in batches:
        n = len(b)
        rows, paths = _choose(b.column("tree").to_numpy(), b.column("path").to_numpy().astype(np.uint64), _sketches(b.column("sketch")))
        second, none = np.zeros(n, np.int64), np.ones(n, bool)
        second[rows[n:]], none[rows[n:]] = paths[n:], False
        yield pa.RecordBatch.from_arrays([b.column("tree"), pa.array(paths[:n]), pa.array(second, mask=none), *(b.column(c) for c in ("key", "comp", "sketch"))], ["tree", "path", "second", "key", "comp", "sketch"])


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A class's coordinates, each as one number with its token."""
    for b in batches:
        s = _sketches(b.column("sketch")).astype(np.uint64) | np.arange(K, dtype=np.uint64) << np.uint64(32)
        take = pa.array(np.repeat(np.arange(len(s)), K))
        yield pa.RecordBatch.from_arrays([b.column("key").take(take), b.column("comp").take(take), pa.array(s.ravel().astype(np.int64))], ["key", "comp", "token"])


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) with two sketches: those worth confirming."""
    for b in batches:
        x, y = (_whole(b.column(c).to_pylist()) for c in ("sa", "sb"))
        same = ((x[:, :K] == y[:, :K]).sum(1) >= SKETCH) & _alike(x, y)
        yield pa.RecordBatch.from_arrays([b.column(c).filter(pa.array(same)) for c in ("a", "b")], ["a", "b"])


def _within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Small nodes (key, comp and sketch in lists): pairs of different components that are worth confirming."""
    for batch in batches:
        a, b = [], []
        for keys, comps, sketches in zip(*(batch.column(c).to_pylist() for c in ("keys", "comps", "sketches")), strict=True):
            s = _whole(sketches)
            c = np.unique(np.array(comps, object), return_inverse=True)[1]
            for i in range(len(keys) - 1):
                near = np.flatnonzero(((s[i + 1 :, :K] == s[i, :K]).sum(1) >= SKETCH) & (c[i + 1 :] != c[i])) + i + 1
                for j in near[_alike(s[i : i + 1], s[near])]:
                    x, y = sorted((keys[i], keys[j]))
                    a.append(x)
                    b.append(y)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs with their texts: those whose full sets are similar enough."""
    for b in batches:
        sets: dict[bytes, np.ndarray] = {}
        for key, text in (("a", "ta"), ("b", "tb")):
            column, keys = b.column(text), b.column(key).to_pylist()
            for i, k in enumerate(keys):
                if k not in sets:
                    data = np.frombuffer(column[i].as_buffer(), np.uint8)
                    sets[k] = _distinct(*shingle_hashes(*word_hashes(data, np.array([0, len(data)]))))[0]
        ok = []
        for x, y in zip(b.column("a").to_pylist(), b.column("b").to_pylist(), strict=True):
            both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
            ok.append(100 * both >= SIMILAR * (len(sets[x]) + len(sets[y]) - both))
        yield pa.RecordBatch.from_arrays([b.column(c).filter(pa.array(ok, pa.bool_())) for c in ("a", "b")], ["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """key, comp for all keys of links (a, b): the smallest key that can be reached.

    Every round each key takes the smallest label among its own and its neighbours', then that label's own label.
    When no label changes by its neighbours', all keys of a component have one label, which is the smallest key's as no label is above its key.
    Rounds grow with the logarithm of a chain's length, in practice; all is written to the shared folder.
    Labels that were counted to be few are broadcast, so that a round deals rows once only; of more, a key with very many links, and a label that very many keys have.
    """
    both = kept(links.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x")).select("x.a", "x.b"))
    labels = kept(both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("times")).select(F.col("a").alias("key"), F.least("a", "m").alias("comp"), "times"))
    few = labels.count() <= BROADCAST_ROWS
    while True:
        of_b = labels.withColumnRenamed("key", "b")
        met = both.join(F.broadcast(of_b.drop("times")), "b") if few else joined_by_key(both, of_b, ["b"], "times")
        own = labels.select("key", "comp", F.col("comp").alias("old"), "times")
        near = met.select(F.col("a").alias("key"), "comp").unionByName(own, allowMissingColumns=True)
        new = kept(near.groupBy("key").agg(*(f(c).alias(c) for f, c in ((F.min, "comp"), (F.max, "old"), (F.max, "times")))))
        if not new.where("comp <> old").limit(1).count():
            out = new.select("key", "comp")
            return F.broadcast(out) if few else out
        jump = new.select(F.col("key").alias("comp"), F.col("comp").alias("up"))
        if few:
            new = new.join(F.broadcast(jump), "comp")
        else:
            new = joined_by_key(new, kept(jump.join(new.groupBy("comp").agg(F.count("*").alias("n")), "comp")), ["comp"], "n")
        labels = kept(new.select("key", F.col("up").alias("comp"), "times"))


def _row_id(doc_id: str) -> Column:
    return F.coalesce(F.col(doc_id), F.lit(2**63 - 1))


def _texts(need: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """key and text of the classes in need (key, repeats allowed). A class's text is that of one row; no other text travels."""
    need = F.broadcast(need) if need.count() <= BROADCAST_ROWS else need.distinct()
    need = checked(classes.join(need, "key", "left_semi").select("key", "row.id", "row.text_key"))
    return kept(docs.select(_row_id("doc_id").alias("id"), F.xxhash64("text").alias("text_key"), "text").join(need, ["id", "text_key"]).select("key", "text").dropDuplicates(["key"]))


def _confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts are linked."""
    t = _texts(pairs.select(F.explode(F.array("a", "b")).alias("key")), classes, docs)
    with_a = pairs.join(t.select(F.col("key").alias("a"), F.col("text").alias("ta")), "a")
    return kept_in_batches(with_a.join(t.select(F.col("key").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb").mapInArrow(_confirm, "a binary, b binary"), 64)


def _labelled(rows: DataFrame, comps: DataFrame) -> DataFrame:
    return rows.drop("comp").join(comps, "key", "left").withColumn("comp", F.coalesce("comp", "key"))


def _linkable(large: DataFrame, classes: DataFrame) -> DataFrame:
    """The rows of large nodes whose classes share SKETCH coordinates at least with classes of other components there, taken all together.

    No other class can pass the sketch test with one of another component, so none is lost that was found before.
    """
    sketches = large.select("key", "comp").distinct().join(classes.select("key", "sketch"), "key")
    tokens = kept_in_batches(sketches.mapInArrow(_tokens, "key binary, comp binary, token long"), 1024)
    shared = tokens.groupBy("token").agg(F.count("*").alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("token", "n")
    able = joined_by_key(tokens.select("token", "key"), kept(shared), ["token"], "n").groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") >= SKETCH)
    return kept(large.join(checked(able.select("key")), "key", "left_semi"))


def _children(large: DataFrame) -> DataFrame:
    """The children of large nodes, with the rows that they would have. Both paths stand in one stored row, so that children of one component can be left out before rows are made."""
    both = kept_in_batches(large.select(*NODE, "key", "comp", "sketch").mapInArrow(_branch, "tree int, path long, second long, key binary, comp binary, sketch binary"), 1024)
    return both.drop("second").unionAll(both.where("second is not null").select("tree", F.col("second").alias("path"), "key", "comp", "sketch"))


def links(classes: DataFrame, docs: DataFrame) -> DataFrame:
    """Enough links (a, b) between classes (key, sketch, n_bytes, row) of docs to make the components."""
    nodes = kept_in_batches(classes.select("key", "sketch").mapInArrow(_grow, "tree int, path long, key binary"), 1024)
    stars = kept(nodes.groupBy(*NODE).agg(F.min("key").alias("low"), F.count("*").alias("n")).where("n > 1"))
    nodes = kept(joined_by_key(nodes, stars, NODE, "n").drop("n"))
    s = classes.select("key", "sketch")
    pairs = nodes.where("key > low").select(F.col("low").alias("a"), F.col("key").alias("b")).distinct()
    pairs = pairs.join(s.select(F.col("key").alias("a"), F.col("sketch").alias("sa")), "a").join(s.select(F.col("key").alias("b"), F.col("sketch").alias("sb")), "b")
    found = _confirmed(kept_in_batches(pairs.select("a", "b", "sa", "sb").mapInArrow(_close, "a binary, b binary"), 1024), classes, docs)
    rows, waiting = kept(_labelled(nodes.drop("low"), components(found))), None
    for level in range(1, DEEPEST + 1):
        size = rows.groupBy(*NODE).agg(F.count("*").alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").drop("lo", "hi")
        rows = joined_by_key(rows, kept(size), NODE, "n")
        rows = kept(rows.join(s, "key") if level == 1 else rows)
        inner = rows.where(F.col("n") <= SMALL).groupBy(*NODE).agg(*(F.collect_list(c).alias(c + ("es" if c == "sketch" else "s")) for c in ("key", "comp", "sketch")))
        pairs = kept_in_batches(inner.select("keys", "comps", "sketches").mapInArrow(_within, "a binary, b binary").distinct(), 1024)
        if level == 1:
            found = found.unionAll(_confirmed(pairs, classes, docs))
        else:
            waiting = pairs if waiting is None else waiting.unionAll(pairs)
        large = rows.where(F.col("n") > SMALL).drop("n")
        if not large.limit(1).count():
            break
        if level == 1:
            large = _linkable(kept(_labelled(large, components(found))), classes)
        if level < DEEPEST:
            rows = _children(large)
    else:
        found = found.unionAll(_dense(large, classes, docs))
    # no label is made anew after the first level, so pairs of the further ones are confirmed together, each once
    return found if waiting is None else found.unionAll(_confirmed(kept(waiting.distinct()), classes, docs))


def _root(up: list[int], x: int) -> int:
    while up[x] != x:
        up[x] = x = up[up[x]]
    return x


def _in_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Units of a dense group (key, comp and text in lists): by exact set sizes, links that join what isn't joined yet."""
    for batch in batches:
        a, b = [], []
        for row in range(len(batch)):
            keys, comps = batch.column("keys")[row].as_py(), np.unique(np.array(batch.column("comps")[row].as_py(), object), return_inverse=True)[1]
            raw = [t.as_buffer() for t in batch.column("texts")[row].values]
            bounds = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
            h, per = _distinct(*shingle_hashes(*word_hashes(np.frombuffer(b"".join(raw), np.uint8), bounds)))
            code, times = np.unique(h, return_inverse=True, return_counts=True)[1:]
            shared = np.cumsum(times > 1) - 1
            both = np.zeros((len(keys), len(keys)), np.float32)
            owner, at, on = np.repeat(np.arange(len(keys)), per), shared[code], times[code] > 1
            owner, at = owner[on], at[on]
            for low in range(0, int((times > 1).sum()), 4096):  # shingles that two texts have, some columns at a time
                part = (at >= low) & (at < low + 4096)
                have = np.zeros((len(keys), 4096), np.float32)
                have[owner[part], at[part] - low] = 1
                both += have @ have.T
            i, j = np.nonzero(np.triu(100 * both >= SIMILAR * (per[:, None] + per[None, :] - both), 1) & (comps[:, None] != comps[None, :]))
            _, one = np.unique(np.minimum(comps[i], comps[j]) * len(keys) + np.maximum(comps[i], comps[j]), return_index=True)
            up = list(range(len(keys)))
            for x, y in zip(i[one], j[one], strict=True):  # a forest of links is enough
                p, q = _root(up, comps[x]), _root(up, comps[y])
                if p != q:
                    up[p] = q
                    x, y = sorted((keys[x], keys[y]))
                    a.append(x)
                    b.append(y)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])


def _dense(large: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """Links in nodes that stay large. The largest component's classes meet only the others; a unit holds two blocks at most."""
    large = kept(large.select(*NODE, "key", "comp").join(classes.select("key", "n_bytes"), "key"))
    counts = large.groupBy(*NODE, "comp").agg(F.count("*").alias("c"), F.sum("n_bytes").alias("b"))
    core = counts.groupBy(*NODE).agg(F.max_by(F.struct("comp", "b"), F.struct("c", "comp")).alias("core"), F.max("c").alias("c"), F.sum("c").alias("n"), F.sum("b").alias("b"))
    blocks = lambda n, b: F.greatest(F.ceil(n / BLOCK), F.ceil(b / BLOCK_BYTES)).cast("int")
    of_rest = blocks(F.col("n") - F.col("c"), F.col("b") - F.col("core.b"))
    core = core.select(*NODE, "n", F.col("core.comp").alias("core"), blocks(F.col("c"), F.col("core.b")).alias("of_core"), of_rest.alias("of_rest"))
    rows = joined_by_key(large, kept(core), NODE, "n").drop("n", "n_bytes")
    inner = F.col("comp") == F.col("core")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("key", "path"), F.when(inner, F.col("of_core")).otherwise(F.col("of_rest"))).cast("int"))
    b = F.col("block")
    against_rest = F.transform(F.sequence(F.lit(0), F.col("of_rest") - 1), lambda x: F.when(inner, F.struct(x.alias("i"), b.alias("j"), F.lit(1).alias("k"))).otherwise(F.struct(F.least(x, b).alias("i"), F.greatest(x, b).alias("j"), F.lit(0).alias("k"))))
    against_core = F.transform(F.sequence(F.lit(0), F.col("of_core") - 1), lambda x: F.struct(b.alias("i"), x.alias("j"), F.lit(1).alias("k")))
    texts = _texts(large.select("key"), classes, docs)
    units = rows.join(texts, "key").select(*NODE, F.explode(F.when(inner, against_rest).otherwise(F.concat(against_rest, against_core))).alias("unit"), "key", "comp", "text")
    lists = units.groupBy(*NODE, "unit").agg(*(F.collect_list(c).alias(c + "s") for c in ("key", "comp", "text")))
    return kept_in_batches(lists.select("keys", "comps", "texts").mapInArrow(_in_block, "a binary, b binary").distinct(), 1)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, key (the words' hash), n_shingles, component_id and kept, a row for each row of docs."""
    spark = docs.sparkSession
    rows = kept_in_batches(sketched(docs), 512)
    row = F.min(F.struct(_row_id("doc_id").alias("id"), "text_key")).alias("row")

    def named() -> DataFrame:
        classes = kept(rows.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("low"), row, F.max("n_bytes").alias("n_bytes"), F.first("sketch").alias("sketch")))
        comps = components(links(classes, docs))
        out = classes.select("key", "low").join(comps, "key", "left").withColumn("comp", F.coalesce("comp", "key"))
        return out.join(out.groupBy("comp").agg(F.min("low").alias("component_id")), "comp").select("key", "component_id")

    out = rows.select("doc_id", "text_key", "key", "n_shingles").join(alone(spark, named), "key", "left")
    out = out.withColumn("component_id", F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs that near_duplicates keeps, and those of components without any id, with docs' own columns."""
    i, t = fresh(docs, "gone_id"), fresh(docs, "gone_text")
    gone = alone(docs.sparkSession, lambda: near_duplicates(docs).where("not kept and component_id is not null").select(_row_id("doc_id").alias(i), F.col("text_key").alias(t)).distinct())
    gone = checked(gone)
    return docs.join(gone, (_row_id("doc_id") == F.col(i)) & (F.xxhash64("text") == F.col(t)), "left_anti")


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


#: For DuckDB, for unique ids: all pairs that share a shingle, and what can be reached over links.
OP5_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS shingle FROM w),
n AS (SELECT doc_id, count(shingle) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (shingle) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM n UNION SELECT reach.doc_id, b FROM reach JOIN links ON a = other)
SELECT n.doc_id, n.n AS n_shingles, min(other) AS component_id, n.doc_id = min(other) AS kept FROM n JOIN reach USING (doc_id) GROUP BY n.doc_id, n.n
"""
