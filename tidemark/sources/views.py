"""Read views: nested files flattened once, missing fields set to their defaults, errors with the API's codes."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class RequestError(ValueError):
    """A refused request; code is the HTTP status that stands for it."""

    def __init__(self, message: str, code: int = 422):
        super().__init__(message)
        self.code = code


#: Fields that readers fill in when a stored row lacks them.
TASK_DEFAULTS = {"task_type": 1, "state": 0, "score": 0, "retry_count": 0, "dispatch_priority": 0, "llm_prompt_tokens": 0, "llm_completion_tokens": 0, "llm_total_tokens": 0, "process_time": 0}


def with_defaults(df: DataFrame, defaults: dict) -> DataFrame:
    """Missing, null and default are the same: each field is there and not null."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) if c in df.columns else F.lit(v) for c, v in defaults.items()})


def issues_of(files: DataFrame) -> DataFrame:
    """One row per issue of nested files: the file's and block's keys and the issue's fields. Files without issues have none."""
    blocks = files.select(F.col("id").alias("file_id"), "task_id", "file_name", F.coalesce("file_author", F.lit("")).alias("file_author"), F.explode("code_blocks").alias("b"))
    return blocks.select("file_id", "task_id", "file_name", "file_author", F.col("b.block_id").alias("block_id"), F.explode("b.issues").alias("i")).select("file_id", "task_id", "file_name", "file_author", "block_id", "i.*")


def date_range(start: dt.date | None, end: dt.date | None, today: dt.date) -> tuple[dt.date, dt.date]:
    """The last 30 days unless given; both days are inside."""
    end = end or today
    start = start or end - dt.timedelta(days=29)
    if start > end:
        raise RequestError("the range starts after its end")
    return start, end


def within(ts: Column, start: dt.date | None, end: dt.date | None) -> Column:
    """Half-open: from the start of the first day to the end of the last; either bound may be left out."""
    out = F.lit(True)
    if start is not None:
        out = out & (ts >= F.lit(start).cast("timestamp"))
    if end is not None:
        out = out & (ts < F.lit(end + dt.timedelta(days=1)).cast("timestamp"))
    return out


def author_is(author: Column, name: str | None) -> Column:
    """A named author exactly as stored; `__empty__` for a missing or blank one; None for all."""
    if name is None:
        return F.lit(True)
    if name == "__empty__":
        return author.isNull() | author.rlike(r"(?U)^\s*$")
    return author == name


def page_of(df: DataFrame, order: list[Column], page: int, size: int) -> tuple[DataFrame, int, int]:
    """One page in a total order, the page it really is, and how many there are: one count, nothing else on the driver."""
    pages = -(-df.count() // size)
    page = min(page, pages) if pages else 1
    return df.orderBy(*order).offset((page - 1) * size).limit(size), page, pages
