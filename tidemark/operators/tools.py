"""What a review may ask for, as tables, and the place where a reviewer of one's own goes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import split_lines
from tidemark.operators.issues import detected
from tidemark.operators.symbols import clean
from tidemark.sources.trees import Exclusions, allowed, clean_path
from tidemark.sources.views import RequestError

#: Paths of one request.
PATHS = 20
#: What a reviewer gets and gives.
LINES = ["path", "language", "line_no", "code"]
ISSUES = "path string, line_no int, rule_id string, type string, severity int, confidence double, existing_code string"


def file_read_diff(targets: DataFrame, paths: list[str], start: int = 1, end: int | None = None) -> DataFrame:
    """The diff lines of the named files among targets (path, diff_lines), at most PATHS of them, from `start` to `end`: place (of the path in the request), path, total_diff_lines, line_number and line.
    A path that has no diff is one row with nulls; more than PATHS and blank ones are passed over."""
    spark = targets.sparkSession
    asked = [(n, clean(p or "")) for n, p in enumerate(paths[:PATHS])]
    want = F.broadcast(spark.createDataFrame([a for a in asked if a[1]], "place int, path string"))
    first = max(1, start)
    last = F.size("diff_lines") if end is None else F.least(F.size("diff_lines"), F.lit(max(first, end)))
    found = want.join(targets.select("path", "diff_lines"), "path", "left")
    lines = F.slice("diff_lines", F.lit(first), F.greatest(F.lit(0), last - first + 1))
    rows = found.select("place", "path", F.size("diff_lines").alias("n"), F.posexplode_outer(lines).alias("pos", "line"))
    return rows.select("place", "path", F.when(F.col("n") >= 0, F.col("n")).alias("total_diff_lines"), (F.col("pos") + first).alias("line_number"), "line")


def read_file(tree: DataFrame, path: str, start: int = 1, end: int | None = None, most: int = 500) -> DataFrame:
    """line_number and line of one file of tree (path, text), at most so many, and how many it has; no rows if there is no such file."""
    lines, first = split_lines(F.col("text")), max(1, start)
    n = most if end is None else max(0, min(end - first + 1, most))
    rows = tree.where(F.col("path") == clean(path)).select(F.size(lines).alias("total_lines"), F.posexplode(F.slice(lines, first, n)).alias("pos", "line"))
    return rows.select((F.col("pos") + first).alias("line_number"), "line", "total_lines")


def reviewed(lines: DataFrame, hook: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] | None = None) -> DataFrame:
    """Issues (ISSUES) of added lines (path, language, line_no, code): by the built-in rules, or by a hook over Arrow batches, such as a model's client, which runs in the tasks.

    A hook may return any number of rows for a batch, with ISSUES' columns in any order; one that it leaves out is refused.
    """
    lines = lines.select(*LINES)
    names = [c.split()[0] for c in ISSUES.split(", ")]
    if hook is None:
        return detected(lines).select(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in hook(batches):
            missing = [c for c in names if c not in b.schema.names]
            if missing:
                raise RequestError(f"the reviewer left out {', '.join(missing)}")
            yield b.select(names)

    return lines.mapInArrow(run, ISSUES)


def checked_paths(requests: DataFrame, tree: DataFrame, exclusions: Exclusions = Exclusions(), most_bytes: int = 1 << 20) -> DataFrame:
    """requests (path, ...) with `resolved`, the file in tree (path, size in bytes) that is meant, and `reason`, the first one why it isn't read; null if it is."""
    norm = clean_path(F.trim(F.coalesce("path", F.lit(""))))
    parts = F.filter(F.split(norm, "/"), lambda p: ~p.isin("", "."))
    begin = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("left"))
    up = lambda a: F.struct(F.slice(a["out"], 1, F.greatest(F.size(a["out"]) - 1, F.lit(0))).alias("out"), (a["left"] | (F.size(a["out"]) == 0)).alias("left"))
    walked = F.aggregate(parts, begin, lambda a, p: F.when(p == "..", up(a)).otherwise(F.struct(F.array_append(a["out"], p).alias("out"), a["left"].alias("left"))))
    out = requests.withColumns({"_norm": norm, "_walked": walked}).withColumn("resolved", F.array_join("_walked.out", "/"))
    known = tree.select(F.col("path").alias("_file"), F.col("size").alias("_size"))
    out = out.join(known, F.col("resolved") == F.col("_file"), "left")
    reason = (
        F.when(F.col("_norm") == "", "File path is required")
        .when(F.col("path").startswith("/") | F.col("path").rlike("^[A-Za-z]:"), "Absolute file paths are not allowed")
        .when(F.col("_walked.left"), "File path escapes review root")
        .when(F.col("_file").isNull(), "File not found")
        .when(exclusions.column(F.col("resolved")), "File path is excluded from review")
        .when(~allowed(F.col("resolved")), "File extension is not allowed for review tools")
        .when(F.col("_size") > max(1, most_bytes), "File exceeds review tool size limit")
    )
    return out.withColumn("reason", reason).drop("_norm", "_walked", "_file", "_size")
