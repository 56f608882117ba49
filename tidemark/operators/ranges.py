"""Joins on overlapping line ranges within a file, by buckets of lines, so a long file doesn't pair all its ranges with all others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lines of a bucket.
WIDTH = 32


def _cut(df: DataFrame, first: Column, last: Column, width: int, prefix: str) -> DataFrame:
    """df with a row for each bucket that first to last touches; rows whose range is empty or unknown have none."""
    at = lambda line: F.floor(line / width).cast("long")
    buckets = F.when(first <= last, F.sequence(at(first), at(last)))
    return df.withColumns({f"{prefix}_low": at(first), "_bucket": F.explode(buckets)})


def overlapping(left: DataFrame, right: DataFrame, key: str, left_range: tuple[str, str], right_range: tuple[str, str], width: int = WIDTH) -> DataFrame:
    """Pairs of left and right with the same key whose ranges (first and last line, both inside) share a line, each pair once.

    Both sides meet bucket by bucket; a pair counts in the first bucket that both touch. What is tested is what shares a
    bucket of lines, not what shares a file. Besides the key, the sides' columns have to differ.
    """
    a = _cut(left, F.col(left_range[0]), F.col(left_range[1]), width, "_l")
    b = _cut(right, F.col(right_range[0]), F.col(right_range[1]), width, "_r")
    both = a.join(b, [key, "_bucket"]).where(F.col("_bucket") == F.greatest("_l_low", "_r_low"))
    shares = (F.col(left_range[0]) <= F.col(right_range[1])) & (F.col(right_range[0]) <= F.col(left_range[1]))
    return both.where(shares).drop("_l_low", "_r_low", "_bucket")


def _width(first: Column, last: Column) -> Column:
    """The smallest power of two that is no less than the number of lines from first to last."""
    return F.pow(F.lit(2.0), F.ceil(F.log2((last - first + 1).cast("double")))).cast("long")


def findings_on_changes(findings: DataFrame, lines: DataFrame) -> DataFrame:
    """Findings (file_name, start_line, end_line, ...) that hold a reviewable line of a block (file_name, block_id, line): one row for each block and finding, with how many such lines it holds.

    A finding is one row, in a cell as wide as itself (to the next power of two); the cell's lines and those of the next are an array, for each width that occurs. So
    its lines are counted where they are met, and no pair of a line and a finding is dealt.
    """
    at = lambda line: F.floor(F.col(line) / F.col("_width")).cast("long")
    own = findings.where("start_line <= end_line").groupBy(*findings.columns).agg(F.count("*").alias("_copies"))
    own = own.withColumn("_width", _width(F.col("start_line"), F.col("end_line"))).withColumn("_cell", at("start_line"))
    widths = findings.where("start_line <= end_line").select(_width(F.col("start_line"), F.col("end_line")).alias("_width")).distinct()  # at most 64
    points = lines.select("file_name", "block_id", "line").where("line is not null").distinct().crossJoin(F.broadcast(widths))
    points = points.withColumn("_cell", F.explode(F.array(at("line") - 1, at("line"))))
    cells = points.groupBy("file_name", "_width", "_cell").agg(F.collect_list(F.struct("block_id", "line")).alias("_points"))
    met = own.join(cells, ["file_name", "_width", "_cell"])
    met = met.withColumn("_points", F.filter("_points", lambda p: p["line"].between(F.col("start_line"), F.col("end_line"))))
    of = lambda b: F.transform(F.filter("_points", lambda p: p["block_id"].eqNullSafe(b)), lambda p: p["line"])
    blocks = F.transform(F.array_distinct(F.transform("_points", lambda p: p["block_id"])), lambda b: F.struct(b.alias("block_id"), of(b).alias("lines")))
    held = met.select(*findings.columns, "_copies", F.explode(blocks).alias("_held"))
    return held.select(*findings.columns, "_held.block_id", (F.size("_held.lines") * F.col("_copies")).cast("long").alias("changed_lines"), F.array_min("_held.lines").alias("first_line"))


def _nodes(first: Column, last: Column) -> Column:
    """The aligned spans of 2 ** level lines that make up first to last, none longer than needed: at most two of a level."""
    ceil = lambda x, k: -F.call_function("shiftright", -x, k)

    def of_level(k: Column) -> Column:
        low, high = ceil(first, k), F.call_function("shiftright", last + 1, k)
        node = lambda there, n: F.when((low < high) & there, F.struct(k.alias("level"), n.alias("node")))
        return F.array(node(low.bitwiseAND(F.lit(1)) == 1, low), node(high.bitwiseAND(F.lit(1)) == 1, high - 1))

    levels = F.sequence(F.lit(0), F.floor(F.log2((last - first + 1).cast("double"))).cast("int"))
    return F.when(first <= last, F.filter(F.flatten(F.transform(levels, of_level)), lambda n: n.isNotNull()))


def overlap_sums(left: DataFrame, right: DataFrame, key: str, left_range: tuple[str, str], right_range: tuple[str, str], value: str) -> DataFrame:
    """left with `n`, how many ranges of right with the same key share a line with its own, and `least`, the least value of these; rows without any are left out.

    A range that shares a line starts inside, or covers the first line from further ahead. Sums by aligned spans of lines answer both, so no pair is made and
    work grows with the rows and the logarithm of their ranges.
    """
    a1, a2, b1, b2 = (F.col(c).cast("long") for c in (*left_range, *right_range))
    ends = {"_a1": a1, "_a2": a2}
    asked = left.select(key, *(c.alias(n) for n, c in ends.items())).where("_a1 <= _a2").distinct()
    there = right.where(b1 <= b2).groupBy(key, b1.alias("_b1"), b2.alias("_b2")).agg(F.count("*").alias("_n"), F.min(value).alias("_least"))
    above = lambda line, top: F.transform(F.sequence(F.lit(0), top), lambda k: F.struct(k.alias("level"), F.call_function("shiftright", line, k).alias("node")))
    top = lambda df, first, last: df.agg(F.coalesce(F.max(F.floor(F.log2((F.col(last) - F.col(first) + 1).cast("double")))), F.lit(0)).cast("int").alias("_top"))
    dealt = lambda df, kind, nodes, *kept: df.select(key, *kept, F.lit(kind).alias("_kind"), F.explode(nodes).alias("_at"))
    starts = dealt(there.crossJoin(F.broadcast(top(asked, "_a1", "_a2"))), "starts", above(F.col("_b1"), F.col("_top")), "_n", "_least")
    covers = dealt(there, "covers", _nodes(F.col("_b1") + 1, F.col("_b2")), "_n", "_least")
    sums = starts.unionByName(covers).groupBy(key, "_kind", "_at").agg(F.sum("_n").alias("_n"), F.min("_least").alias("_least"))
    inside = dealt(asked, "starts", _nodes(F.col("_a1"), F.col("_a2")), "_a1", "_a2")
    ahead = dealt(asked.crossJoin(F.broadcast(top(there, "_b1", "_b2"))), "covers", above(F.col("_a1"), F.col("_top")), "_a1", "_a2")
    found = inside.unionByName(ahead).join(sums, [key, "_kind", "_at"]).groupBy(key, "_a1", "_a2").agg(F.sum("_n").alias("n"), F.min("_least").alias("least"))
    return left.withColumns(ends).join(found, [key, "_a1", "_a2"]).drop("_a1", "_a2")
