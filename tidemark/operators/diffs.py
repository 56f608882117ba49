"""Trees, diffs and blocks: full scans, comparisons, renames, block splitting, budgets, incremental synchronisation."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from tidemark.functions.text import diff_line, line_tokens, split_lines
from tidemark.shared import kept, ranked, running

#: Tokens of a block, equal lines kept around a change, files of a batch.
BLOCK_TOKENS, CONTEXT, BATCH = 10_000, 10, 20


def full_scan(tree: DataFrame, *more: Column) -> DataFrame:
    """Every line of every file that isn't empty, as added; more: further columns of the tree."""
    lines = split_lines(F.col("text"))
    formatted = F.transform(lines, lambda x, i: diff_line(i + 1, F.lit("+"), x))
    return tree.where("text <> ''").select("path", "language", F.lit("FULL").alias("change_type"), formatted.alias("diff_lines"), F.size(lines).alias("line_count"), F.size(lines).alias("added_count"), *more)


def compared(base: DataFrame, head: DataFrame) -> DataFrame:
    """path, old_path and change_type of files that differ: a file gone and one that came are a rename if their
    digest occurs once on both sides."""
    both = base.select(F.col("path").alias("old_path"), F.col("md5").alias("old_md5")).join(head.select("path", "md5"), F.col("old_path") == F.col("path"), "full_outer")
    both = both.where("old_md5 is null or md5 is null or old_md5 <> md5")
    gone, came = both.where("path is null").select("old_path", "old_md5"), both.where("old_path is null").select("path", "md5")
    once = lambda df, key: df.withColumn("n", F.count("*").over(Window.partitionBy(key))).where("n = 1").drop("n")
    moved = once(gone, "old_md5").join(once(came, "md5"), F.col("old_md5") == F.col("md5")).select("old_path", "path")
    rest = both.join(moved.select(F.col("old_path").alias("x")), F.col("old_path") == F.col("x"), "left_anti").join(moved.select(F.col("path").alias("y")), F.col("path") == F.col("y"), "left_anti")
    kind = F.when(F.col("old_path").isNull(), "ADDED").when(F.col("path").isNull(), "DELETED").otherwise("MODIFIED")
    rest = rest.select(F.coalesce("path", "old_path").alias("path"), F.when(F.col("path").isNull() | F.col("old_path").isNotNull(), F.col("old_path")).alias("old_path"), kind.alias("change_type"))
    return rest.unionByName(moved.select("path", "old_path", F.lit("RENAMED").alias("change_type")))


def diff_of(old: list[str], new: list[str], context: int = CONTEXT) -> list[str]:
    """Formatted lines of a diff: removed lines before added ones, equal ones only near a change."""
    rows: list[tuple[int, str, str]] = []
    for tag, a, b, c, d in SequenceMatcher(None, old, new, autojunk=False).get_opcodes():
        if tag == "equal":
            rows += [(c + i + 1, " ", new[c + i]) for i in range(d - c)]
        else:
            rows += [(i + 1, "-", old[i]) for i in range(a, b)] + [(i + 1, "+", new[i]) for i in range(c, d)]
    near, last = [False] * len(rows), None
    for order in (range(len(rows)), range(len(rows) - 1, -1, -1)):
        last = None
        for i in order:
            last = i if rows[i][1] != " " else last
            near[i] |= last is not None and abs(i - last) <= context
    return [f"{n:>6}{m}  {code}" for (n, m, code), keep in zip(rows, near, strict=True) if keep]


def changed_targets(changes: DataFrame, base: DataFrame, head: DataFrame, context: int = CONTEXT) -> DataFrame:
    """Diff lines of added and modified files; files gone or only renamed yield none. Matching runs in Python, for these pairs alone."""
    pairs = changes.where(F.col("change_type").isin("ADDED", "MODIFIED")).join(head.select("path", F.col("text").alias("new_text")), "path")
    pairs = pairs.join(base.select(F.col("path").alias("old_path"), F.col("text").alias("old_text")), "old_path", "left").select("path", "change_type", "old_text", "new_text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            lines = [diff_of((o or "").splitlines(), (n or "").splitlines(), context) for o, n in zip(b["old_text"], b["new_text"], strict=True)]
            yield pd.DataFrame({"path": b["path"], "change_type": b["change_type"], "diff_lines": lines})

    return pairs.mapInPandas(run, "path string, change_type string, diff_lines array<string>")


def split_blocks(lines: Column, limit: int = BLOCK_TOKENS) -> Column:
    """Arrays of lines: a block closes when the next line would take it past the limit; one longer line is a block.

    The fold keeps the places where blocks start alone, so lines are copied once, into their block.
    """
    state = lambda starts, n, at: F.struct(starts.alias("starts"), n.alias("n"), at.alias("at"))

    def step(a: Column, x: Column) -> Column:
        t = line_tokens(x)
        full = (a["at"] == 0) | (a["n"] + t > limit)
        return state(F.when(full, F.array_append(a["starts"], a["at"])).otherwise(a["starts"]), F.when(full, t).otherwise(a["n"] + t), a["at"] + 1)

    starts = F.aggregate(lines, state(F.array().cast("array<int>"), F.lit(0), F.lit(0)), step, lambda a: F.array_append(a["starts"], a["at"]))
    pairs = F.transform(F.array(F.struct(lines.alias("x"), starts.alias("s"))), lambda b: F.transform(F.slice(b["s"], 1, F.size(b["s"]) - 1), lambda x, i: F.slice(b["x"], x + 1, F.get(b["s"], i + 1) - x)))[0]
    return F.when(F.size(lines) > 0, pairs).otherwise(F.array().cast("array<array<string>>"))


def block_hash(lines: Column) -> Column:
    return F.md5(F.array_join(lines, "\n").cast("binary"))


def admitted(files: DataFrame, key: str, order: list[str], cost: str, budget: int) -> DataFrame:
    """files with `ok`: in order, whether each one's cost fits what its key's budget still holds; what doesn't fit takes nothing. No budget (0) admits all.

    What fits depends on all decisions before, so a key's costs are folded in order, a batch of rows at a time: no key is an array or a frame in memory.
    """
    if budget <= 0:
        return files.withColumn("ok", F.lit(True))
    schema = StructType([*files.schema.fields, StructField("ok", BooleanType())])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, left = None, budget
        for b in rows:
            ok = []
            for k, c in zip(b.column(key).to_pylist(), b.column(cost).to_pylist(), strict=True):
                of, left = (of, left) if k == of and of is not None else (k, budget)
                ok.append((c or 0) <= left)
                left -= (c or 0) * ok[-1]
            yield b.append_column("ok", pa.array(ok, pa.bool_()))

    return files.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def batches(files: DataFrame, bucket: str | None, order: list[str], size: int = BATCH) -> DataFrame:
    """files with `batch`, the number of its batch (from 0) inside its bucket, or among all files in order if there is none."""
    return ranked(files, *map(F.col, order), out="batch", by=(bucket,) if bucket else ()).withColumn("batch", F.floor(F.col("batch") / size))


def bucket_of(strategy: str, path: Column, language: Column) -> Column:
    """What a full scan's batches keep together: a language, or a first directory."""
    if strategy == "by-language":
        return F.coalesce(F.nullif(F.lower(language), F.lit("")), F.lit("<unknown>"))
    return F.when(F.contains(path, F.lit("/")), F.substring_index(path, "/", 1)).otherwise("<root>")


def target_batches(files: DataFrame, strategy: str, full_scan: bool, order: list[str], size: int = BATCH) -> DataFrame:
    """files (path, language, ...) with `bucket` and `batch`, its number among all batches: buckets one after another by name in a full scan by language or directory, else in order alone."""
    if not full_scan or strategy.strip().lower() not in ("by-language", "by-directory"):
        return batches(files, None, order, size).withColumn("bucket", F.lit(""))
    rows = kept(batches(files.withColumn("bucket", bucket_of(strategy.strip().lower(), F.col("path"), F.col("language"))), "bucket", order, size))
    sizes = rows.groupBy("bucket").agg((F.max("batch") + 1).alias("n"))
    starts = running(sizes, [F.col("bucket")], {"before": F.col("n")}).select("bucket", "before")
    return rows.join(starts, "bucket").withColumn("batch", F.col("batch") + F.col("before")).drop("before")


def removed_files(existing: DataFrame, targets: DataFrame) -> DataFrame:
    return existing.join(targets.select("path"), "path", "left_anti")


def classified(targets: DataFrame, existing: DataFrame) -> DataFrame:
    """path and what a run does with it: added, changed, reused (same source hash) or removed."""
    both = targets.select("path", F.col("source_hash").alias("new_hash")).join(existing.select("path", F.col("source_hash").alias("old_hash")), "path", "full_outer")
    kind = F.when(F.col("old_hash").isNull(), "added").when(F.col("new_hash").isNull(), "removed").when(F.col("old_hash") == F.col("new_hash"), "reused").otherwise("changed")
    return both.select("path", kind.alias("kind"))


def matched_blocks(new: DataFrame, old: DataFrame) -> DataFrame:
    """new's blocks with the old block that each takes over: the k-th of a hash in a file gets the k-th old one, finished ones first."""
    key = ["path", "block_hash"]
    n = new.withColumn("k", F.row_number().over(Window.partitionBy(*key).orderBy("block_id")))
    o = old.withColumn("k", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("completed"), "block_id")))
    return n.join(o.select(*key, "k", F.col("block_id").alias("old_block_id"), F.col("completed").alias("reused")), [*key, "k"], "left").drop("k")


def added_blocks(new: DataFrame, old: DataFrame) -> DataFrame:
    """new's blocks beyond as many of the same hash as old has: a multiset difference that keeps the ids."""
    key = ["path", "block_hash"]
    n = new.withColumn("k", F.row_number().over(Window.partitionBy(*key).orderBy("block_id")))
    had = old.groupBy(*key).agg(F.count("*").alias("had"))
    return n.join(had, key, "left").where(F.col("k") > F.coalesce("had", F.lit(0))).drop("k", "had")


def rematched_refs(refs: DataFrame, blocks: DataFrame) -> DataFrame:
    """Block references found again: by id and hash, else the k-th left over of a hash gets the k-th left block; each block once."""
    key = ["path", "block_hash"]
    first = refs.join(blocks.select(*key, "block_id"), [*key, "block_id"]).withColumn("found_id", F.col("block_id"))
    left_refs, left = refs.join(first.select(*key, "block_id"), [*key, "block_id"], "left_anti"), blocks.join(first.select(*key, "block_id"), [*key, "block_id"], "left_anti")
    number = F.row_number().over(Window.partitionBy(*key).orderBy("block_id"))
    second = left_refs.withColumn("k", number).join(left.select(*key, F.col("block_id").alias("found_id"), number.alias("k")), [*key, "k"]).drop("k")
    return first.unionByName(second)


def reusable(files: DataFrame) -> Column:
    """A file whose results stand: same hash and fingerprint, not skipped for budget, with blocks, all complete."""
    same = (F.col("source_hash") == F.col("new_source_hash")) & (F.col("fingerprint") == F.col("new_fingerprint"))
    return same & (F.coalesce("status", F.lit("")) != "skipped_budget") & (F.size("complete") > 0) & F.forall("complete", lambda x: x)


def migrated_types(tasks: DataFrame) -> DataFrame:
    """Tasks whose base is none are full scans; `changed` marks those that weren't. A second run changes nothing."""
    wrong = (F.col("copy_from_version") == "0_version") & (F.coalesce("task_type", F.lit(0)) != 3)
    return tasks.withColumn("changed", F.coalesce(wrong, F.lit(False))).withColumn("task_type", F.when(F.col("changed"), 3).otherwise(F.col("task_type")))
