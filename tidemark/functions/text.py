"""Text as Column builders: diff lines, keys, word sets, encodings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Issue types by their other names, and the marker of a cut text.
TYPE_ALIASES = {
    "bug": "logic", "correctness": "logic", "robustness": "logic", "maintainability": "readability", "readable": "readability",
    "style": "code_style", "code_style": "code_style", "codestyle": "code_style", "code": "code_style",
    "security": "security", "performance": "performance", "logic": "logic", "readability": "readability",
}
CUT = "\n...[truncated]"

#: Any Unicode white space; and what ends a line for Python's splitlines.
SPACE = r"(?U)\s+"
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\u0085  ]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def blank(c: Column) -> Column:
    return F.coalesce(c.rlike(r"(?U)^\s*$"), F.lit(True))


def split_lines(c: Column) -> Column:
    """Lines without their ends; no empty one after the last end."""
    parts = F.split(c, LINE_END)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)


def squeeze(c: Column) -> Column:
    """No white space at all."""
    return F.regexp_replace(c, SPACE, "")


def code_key(c: Column) -> Column:
    return F.lower(squeeze(F.coalesce(c, F.lit(""))))


def text_key(c: Column) -> Column:
    """Lower case, white space collapsed and trimmed."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), SPACE, " "))


def numbers(c: Column) -> Column:
    """All integers in a text."""
    return F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(\d+)"), F.lit(1)), lambda x: x.cast("int"))


def lines_key(c: Column) -> Column:
    """Line numbers, sorted and distinct; the text's own key if it holds none."""
    parts = F.transform(F.split(F.replace(F.coalesce(c, F.lit("")), F.lit("，"), F.lit(",")), ","), lambda x: strip(x))
    found = F.array_sort(F.array_distinct(F.transform(F.filter(parts, lambda x: x.rlike(r"^\d+$")), lambda x: x.cast("int"))))
    return F.when(F.size(found) > 0, F.array_join(found.cast("array<string>"), ",")).otherwise(text_key(c))


def word_set(c: Column) -> Column:
    """Words of letters, digits and underscores, and pairs of neighbouring Han characters (one alone counts too)."""
    low = F.lower(F.coalesce(c, F.lit("")))
    words = F.regexp_extract_all(low, F.lit("([a-z0-9_]+)"), F.lit(1))
    runs = F.regexp_extract_all(low, F.lit("([一-鿿]+)"), F.lit(1))
    pairs = F.flatten(F.transform(runs, lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2))))))
    return F.array_distinct(F.concat(words, pairs))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def issue_type(c: Column) -> Column:
    key = F.replace(F.replace(text_key(F.coalesce(c, F.lit("logic"))), F.lit("-"), F.lit("_")), F.lit(" "), F.lit("_"))
    table = F.create_map(*(F.lit(x) for kv in TYPE_ALIASES.items() for x in kv))
    return F.coalesce(F.try_element_at(table, key), F.lit("logic"))


def diff_line(number: Column, marker: Column, code: Column) -> Column:
    """Number right-aligned to six, marker, two spaces, code."""
    n = number.cast("string")
    return F.concat(F.lpad(n, F.greatest(F.length(n), F.lit(6)), F.lit(" ")), marker, F.lit("  "), code)


def parse_diff_line(c: Column) -> Column:
    """(line_no, marker, code), null for what isn't a diff line."""
    number = F.trim(F.substring(c, 1, 6)).try_cast("int")
    return F.when((F.length(c) >= 9) & number.isNotNull(), F.struct(number.alias("line_no"), F.substring(c, 7, 1).alias("marker"), F.substring(c, F.lit(10), F.length(c)).alias("code")))


def added_line(c: Column) -> Column:
    """(line_no, code) of an added diff line, null for others; a number that can't be read is 0."""
    number = F.coalesce(F.trim(F.substring(c, 1, 6)).try_cast("int"), F.lit(0))
    return F.when((F.length(c) > 8) & (F.substring(c, 7, 1) == "+"), F.struct(number.alias("line_no"), F.substring(c, F.lit(10), F.length(c)).alias("code")))


def line_tokens(c: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(c) / 4).cast("int"))


def cut(c: Column, most: int) -> Column:
    return F.when(F.length(c) > most, F.concat(F.left(c, F.lit(most - 20)), F.lit(CUT))).otherwise(c)


def percent_encoded(c: Column) -> Column:
    """Every reserved character encoded; a space as %20, a tilde as it is."""
    return F.replace(F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def json_text(c: Column) -> Column:
    """The JSON in a model's answer: what a fence holds, else from the first brace to the last."""
    fenced = F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)```", 1)
    return F.coalesce(F.nullif(strip(fenced), F.lit("")), F.nullif(F.regexp_extract(c, r"(?s)(\{.*\})", 1), F.lit("")))


def symbol_key(c: Column) -> Column:
    """The last part of a qualified name, in lower case; null for what is no name. `<module>` names itself."""
    last = F.element_at(F.split(F.element_at(F.split(strip(c), r"\."), -1), "::"), -1)
    qualified = F.when(strip(c) == "<module>", F.lit("<module>")).when(strip(c).rlike(r"^[A-Za-z_~][\w.:~]*$") & (last != ""), F.lower(last))
    return F.when(c.rlike(r"\A[A-Za-z_~][A-Za-z0-9_~]*\z"), F.lower(c)).otherwise(qualified)  # most names have one part: nothing to cut


def counts_text(m: Column, between: str = ", ") -> Column:
    """A map of counts as k=v, sorted by key."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), between)


def snapshot_id(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMddHHmmssSSSSSS")


def json_string(c: Column) -> Column:
    """A text as a JSON string, control characters escaped."""
    made = F.to_json(F.struct(c.alias("x")))
    return F.substring(made, F.lit(6), F.length(made) - 6)
