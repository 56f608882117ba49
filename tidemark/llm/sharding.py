"""Operator 8, native: sharding by fixed virtual slots.

Records are hashed into thousands of fixed slots; bytes are summed per slot; a versioned slot-to-shard map, stored
as a table, says where each slot lives. The map is made by giving each slot, largest first, to the lightest
shard, and is edited, never remade, when shards are rebalanced: each edit is stored beside the earlier ones as the next
version, which is never overwritten. The map has one row per slot, a bound that doesn't grow with the data, so it may come to
the driver and be broadcast.

Law of the query: `bytes` (shards nearly equal in bytes). A record's place in its shard is its slot's offset there
plus its rank inside the slot, so no task ever holds a shard.

Cases: a null text has no bytes and checksum 0; a null id hashes like any value; rows with equal id and text are numbered, and
the number is hashed with them, so they spread over the slots like others; a very long text is one record, whose bytes are counted; an empty table gives an empty result;
extra columns, whatever their names, are left out.
"""

from __future__ import annotations

import heapq
import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import checked, kept, ranked, scratch, table

SLOTS, SHARDS = 8192, 40
#: What a record takes besides its text.
OVERHEAD = 16
MAP = "slot int, shard int, bytes long, n_rows long, at long"


def slot_of(*key: Column) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(SLOTS)).cast("int")


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot."""
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    df = docs.select("doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return df.withColumn("virtual_slot", slot_of(F.col("doc_id"), F.col("text_crc32"), F.col("size")))


def spread(rows: DataFrame) -> DataFrame:
    """Records (sized, stored) with repeated ones in slots of their own: which of the equal rows gets which number doesn't matter."""
    h = F.xxhash64("doc_id", "text_crc32", "size").alias("_h")
    repeats = kept(rows.groupBy(h).agg(F.count("*").alias("_times")).where("_times > 1"))
    if not repeats.limit(1).count():
        return rows
    both = kept(rows.withColumns({"_h": F.xxhash64("doc_id", "text_crc32", "size"), "_any": F.monotonically_increasing_id()}).join(checked(repeats), "_h", "left"))
    numbered = ranked(both.where("_times is not null"), F.col("_any"), out="_n", by=("_h",))
    slot = F.when(F.col("_n") == 0, F.col("virtual_slot")).otherwise(slot_of(F.col("_h"), F.col("_n")))
    return kept(numbered.withColumn("virtual_slot", slot).select(*rows.columns).unionByName(both.where("_times is null").select(*rows.columns)))


def slot_bytes(rows: DataFrame) -> dict[int, tuple[int, int]]:
    """Bytes and rows of each slot: at most SLOTS rows."""
    return {r.virtual_slot: (r.b, r.n) for r in rows.groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()}


def new_map(weight: dict[int, tuple[int, int]], shards: int = SHARDS) -> dict[int, int]:
    """The shard of every slot, the empty ones too."""
    heap, out = [(0, s) for s in range(shards)], {}
    for slot in sorted(range(SLOTS), key=lambda s: (-weight.get(s, (0, 0))[0], s)):
        load, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (load + weight.get(slot, (0, 0))[0], shard))
    return out


def rebalanced(old: dict[int, int], weight: dict[int, tuple[int, int]], shards: int) -> dict[int, int]:
    """The next version: slots move, one at a time, from the heaviest shard to the lightest while that narrows the gap.

    Shards that are gone give all their slots away; nothing else moves.
    """
    out, w = dict(old), {s: weight.get(s, (0, 0))[0] for s in old}
    load = dict.fromkeys(range(shards), 0)
    for slot in sorted(out, key=lambda s: (-w[s], s)):
        if out[slot] in load:
            load[out[slot]] += w[slot]
    for slot in sorted((s for s in out if out[s] not in load), key=lambda s: (-w[s], s)):
        out[slot] = min(load, key=lambda k: (load[k], k))
        load[out[slot]] += w[slot]
    inside: dict[int, list[int]] = {s: [] for s in load}
    for slot, shard in out.items():
        inside[shard].append(slot)
    for _ in range(len(out)):
        high, low = max(load, key=lambda k: (load[k], -k)), min(load, key=lambda k: (load[k], k))
        gap = load[high] - load[low]
        moving = max((s for s in inside[high] if 0 < w[s] < gap), key=lambda s: (min(w[s], gap - w[s]), -s), default=None)
        if moving is None:
            break
        inside[high].remove(moving)
        inside[low].append(moving)
        out[moving], load[high], load[low] = low, load[high] - w[moving], load[low] + w[moving]
    return out


def versions(spark: SparkSession, path: str) -> list[int]:
    """The versions that are stored under a path, in order."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(n.removeprefix("version=")) for n in names if n.startswith("version="))


def store_map(spark: SparkSession, path: str, shard_of: dict[int, int], weight: dict[int, tuple[int, int]]) -> int:
    """Store a map as the next version, and return its number; `at` is where a slot's first row stands in its shard.

    Of two writers of one version the second fails.
    """
    version, at, rows = max(versions(spark, path), default=0) + 1, {}, []
    for slot in sorted(shard_of):
        b, n = weight.get(slot, (0, 0))
        rows.append([slot, shard_of[slot], b, n, at.get(shard_of[slot], 0)])
        at[shard_of[slot]] = at.get(shard_of[slot], 0) + n
    names = [c.split()[0] for c in MAP.split(", ")]
    as_json = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    made = spark.range(1).select(F.explode(F.from_json(F.lit(as_json), f"array<struct<{MAP.replace(' ', ':').replace(',:', ', ')}>>")).alias("m")).select("m.*")
    made.coalesce(1).write.mode("errorifexists").parquet(f"{path}/version={version}")
    return version


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version of the map, the latest one if none is named."""
    return spark.read.schema(MAP).parquet(f"{path}/version={max(versions(spark, path)) if version is None else version}")


def rebalance(spark: SparkSession, path: str, rows: DataFrame, shards: int) -> int:
    """Edit the latest version for the records as they are now (sized) and so many shards; the number of the new version."""
    weight = slot_bytes(rows)
    old = {r.slot: r.shard for r in load_map(spark, path).collect()}
    return store_map(spark, path, rebalanced(old, weight, shards), weight)


def placed(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Records (sized) with shard and slot, the place in the shard, without gaps from 0, by a version of the map that was made for them."""
    plan = F.broadcast(plan.select(F.col("slot").alias("virtual_slot"), "shard", "at"))
    in_slot = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    ranked = rows.withColumn("n_before", F.row_number().over(in_slot) - 1)
    return ranked.join(plan, "virtual_slot").withColumn("slot", F.col("at") + F.col("n_before")).drop("at", "n_before")


def sharded(docs: DataFrame, shards: int = SHARDS, path: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot, shard and slot. path: where the map's versions are; a folder of its own if none is named."""
    spark = docs.sparkSession
    path = path or scratch(spark)
    rows = spread(kept(sized(docs)))
    if versions(spark, path):
        return placed(rows, load_map(spark, path, rebalance(spark, path, rows, shards)))
    weight = slot_bytes(rows)
    return placed(rows, load_map(spark, path, store_map(spark, path, new_map(weight, shards), weight)))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharded(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")
