"""Statistics of a text as built-in Spark expressions: no Python runs on the executors.

Cases: a null text counts as an empty one, for which all counts are 0; a text of fewer words than a window has no windows; a very
long text is counted whole, in one row; columns of other names are left alone, so the output's name must be new.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SPACES, WORD, let, words

#: The characters that count as symbols, and the words of a window.
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5

#: The features that the quality models see, in order; all are doubles.
FEATURES = ("symbol_share", "dup_line_share", "repeat_share", "word_length", "upper_share", "bang_share", "digit_share", "distinct_share", "log_words", "line_words")


def _covered(positions: Column) -> Column:
    """Words covered by windows at these sorted positions: a later window adds what the earlier one doesn't reach."""
    return F.aggregate(
        F.transform(positions, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(positions, i + 1), p + WINDOW) - p)),
        F.lit(0).cast("long"),
        lambda a, x: a + x.cast("long"),
    )


def _repeated(windows: Column) -> Column:
    """Words in windows whose hash occurs twice or more. Only texts that have such a window are sorted."""
    tagged = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))

    def positions(s: Column) -> Column:
        twin = F.filter(s, lambda x, i: (F.get(s, i + 1)["h"] == x["h"]) | ((i > 0) & (F.get(s, i - 1)["h"] == x["h"])))
        return F.sort_array(F.transform(twin, lambda x: x["p"]))

    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(let(tagged, lambda s: let(positions(s), _covered)))


def with_stats(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with a struct column `out` of counts (long). A null text counts as an empty one.

    The row number, always true here, keeps Spark from moving a later filter below the statistics, where it would repeat
    them inside themselves.
    """
    t, w = F.coalesce(F.col(text), F.lit("")), f"{out}_w"
    df = df.withColumn(w, F.transform(words(F.col(text)), lambda x: F.xxhash64(x)))
    df = df.withColumn(f"{w}in", F.when(F.size(w) >= WINDOW, F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*(F.get(F.col(w), i + k) for k in range(WINDOW))))).otherwise(F.array().cast("array<long>")))
    df = df.withColumn(f"{w}lines", F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD)))
    n = {
        "n_words": F.size(w),
        "word_chars": F.length(F.regexp_replace(t, SPACES, "")),
        "n_symbols": F.regexp_count(t, F.lit(SYMBOLS)),
        "n_lines": F.size(f"{w}lines"),
        "n_dup_lines": F.size(f"{w}lines") - F.size(F.array_distinct(f"{w}lines")),
        "n_repeat_words": _repeated(F.col(f"{w}in")),
        "n_upper": F.regexp_count(t, F.lit(r"\p{Lu}")),
        "n_bang": F.regexp_count(t, F.lit("!")),
        "n_digit": F.regexp_count(t, F.lit("[0-9]")),
        "n_distinct": F.size(F.array_distinct(w)),
    }
    every = F.monotonically_increasing_id() >= 0
    return df.withColumn(out, F.when(every, F.struct(*(c.cast("long").alias(k) for k, c in n.items())))).drop(w, f"{w}in", f"{w}lines")


def features(stats: str) -> dict[str, Column]:
    s = lambda k: F.col(f"{stats}.{k}").cast("double")
    per = lambda a, b: s(a) / F.greatest(s(b), F.lit(1.0))
    return {
        "symbol_share": per("n_symbols", "word_chars"),
        "dup_line_share": per("n_dup_lines", "n_lines"),
        "repeat_share": per("n_repeat_words", "n_words"),
        "word_length": per("word_chars", "n_words"),
        "upper_share": per("n_upper", "word_chars"),
        "bang_share": per("n_bang", "n_words"),
        "digit_share": per("n_digit", "word_chars"),
        "distinct_share": per("n_distinct", "n_words"),
        "log_words": F.log1p(s("n_words")),
        "line_words": per("n_words", "n_lines"),
    }
