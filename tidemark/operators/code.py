"""Code as data: symbols and calls, searches, related files, comment-only changes."""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Iterator
from functools import cache, reduce
from itertools import chain, groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import split_lines, symbol_key
from tidemark.shared import kept
from tidemark.sources.trees import clean_path
from tidemark.sources.views import RequestError

#: Lines that define a function, calls, and words that look like calls.
DEFINITION = r"^\s*(?:[A-Za-z_$][\w$<>:\[\]*&\s]+\s+)?([A-Za-z_$][\w$]*)\s*\([^;{}]*\)\s*(?:\{|:)$"
CALL = r"\b([A-Za-z_$][\w$]*)\s*\("
CONTROL = ("if", "for", "while", "switch", "catch", "return", "sizeof", "function", "elif", "with", "def", "class", "new", "await")
DEPTH = 3


def code_lines(tree: DataFrame) -> DataFrame:
    """path, line (from 1) and code of a tree's files (path, text)."""
    return tree.select("path", F.posexplode(split_lines(F.col("text"))).alias("line", "code")).withColumn("line", F.col("line") + 1)


def definitions(lines: DataFrame) -> DataFrame:
    name = F.regexp_extract("code", DEFINITION, 1)
    return lines.select("path", "line", F.substring(F.trim("code"), 1, 300).alias("signature"), name.alias("name")).where((F.col("name") != "") & ~F.col("name").isin(*CONTROL))


def calls(lines: DataFrame) -> DataFrame:
    """caller, callee, path, line and context: the caller is the last function defined above, `<module>` before the first."""
    defined = F.regexp_extract("code", DEFINITION, 1)
    own = F.when((defined != "") & ~defined.isin(*CONTROL), defined)
    scope = F.last(own, True).over(Window.partitionBy("path").orderBy("line"))
    found = F.filter(F.regexp_extract_all("code", F.lit(CALL), F.lit(1)), lambda x: ~x.isin(*CONTROL))
    df = lines.withColumns({"own": own, "caller": F.coalesce(scope, F.lit("<module>"))})
    df = df.select("caller", "own", "path", "line", F.substring(F.trim("code"), 1, 500).alias("context"), F.explode(found).alias("callee"))
    return df.where("own is null or callee <> own").select("caller", "callee", "path", "line", "context")


def find_definition(defs: DataFrame, symbol: Column, current: str = "", limit: int = 20) -> DataFrame:
    """The current file first, then by path and line; one row more than the limit shows that there are more."""
    return defs.where(symbol_key(F.col("name")) == symbol_key(symbol)).orderBy(F.col("path") != current, "path", "line").limit(limit + 1)


def find_references(edges: DataFrame, symbol: Column, path: str = "", limit: int = 100) -> DataFrame:
    df = edges.where(symbol_key(F.col("callee")) == symbol_key(symbol))
    return (df.where(F.col("path") == path) if path else df).orderBy("path", "line").limit(limit + 1)


def call_graph(edges: DataFrame, symbol: str, direction: str = "both", depth: int = 1) -> DataFrame:
    """Edges within `depth` (1 to 3) steps of a symbol: as many joins, each with the frontier alone, and one for the edges of all frontiers.

    A frontier is stored, so that no step goes through the edges again for the steps before it.
    """
    e = edges.withColumns({"a": symbol_key(F.col("caller")), "b": symbol_key(F.col("callee"))})
    seen = frontier = edges.sparkSession.range(1).select(symbol_key(F.lit(symbol)).alias("s"))
    ways = [w for d, *w in (("outgoing", "a", "b"), ("incoming", "b", "a")) if direction in (d, "both")]
    along = lambda symbols: [(e.join(symbols, e[start] == symbols.s, "left_semi"), to) for start, to in ways]
    for _ in range(min(DEPTH, max(1, depth)) - 1):
        step = reduce(DataFrame.unionByName, (df.select(F.col(to).alias("s")) for df, to in along(frontier)))
        frontier = kept(step.distinct().join(seen, "s", "left_anti"))
        seen = seen.unionByName(frontier)
    return reduce(DataFrame.unionByName, (df.select(*edges.columns) for df, _ in along(seen))).distinct()


def path_filter(path: Column, patterns: list[str]) -> Column:
    """Include and `:(exclude)` patterns: a trailing slash means a prefix, else a glob on the path or the name."""
    name = F.element_at(F.split(path, "/"), -1)

    def fits(p: str) -> Column:
        return path.startswith(p) if p.endswith("/") else path.rlike(f"^{fnmatch.translate(p)}") | name.rlike(f"^{fnmatch.translate(p)}")

    if any(".." in p.split("/") for p in patterns):
        raise RequestError("patterns can't leave the tree")
    patterns = [p.replace("\\", "/") for p in patterns if p]
    out = F.lit(True)
    if wanted := [fits(p) for p in patterns if not p.startswith(":(exclude)")]:
        out = F.greatest(*wanted, F.lit(False))
    for p in patterns:
        if p.startswith(":(exclude)"):
            out = out & ~fits(p.removeprefix(":(exclude)"))
    return out


def code_search(lines: DataFrame, term: str, regex: bool = False, case: bool = False, patterns: list[str] | None = None, limit: int = 100) -> DataFrame:
    """Lines that hold a term, by path and line; as many rows as the limit means that it was reached."""
    code = F.col("code") if case or regex else F.lower("code")
    hit = F.col("code").rlike(term if case else f"(?i){term}") if regex else F.contains(code, F.lit(term if case else term.lower()))
    return lines.where(hit & path_filter(F.col("path"), patterns or [])).orderBy("path", "line").limit(limit)


def file_find(tree: DataFrame, term: str, regex: bool = False, limit: int = 100) -> DataFrame:
    hit = F.col("path").rlike(f"(?i){term}") if regex else F.contains(F.lower("path"), F.lit(term.lower()))
    return tree.where(hit).select("path").orderBy("path").limit(limit)


def read_lines(tree: DataFrame, start: int, end: int, most: int = 500) -> DataFrame:
    """path and the lines from start to end, at most so many."""
    n = max(0, min(end - start + 1, most))
    return tree.select("path", F.slice(split_lines(F.col("text")), max(1, start), n).alias("lines"))


def expand_braces(pattern: str) -> list[str]:
    """a{b,c}d as abd and acd; an empty or open brace stays."""
    m = re.search(r"\{([^}]*)\}", pattern)
    values = [v.strip() for v in m[1].split(",") if v.strip()] if m else []
    return [x for v in values for x in expand_braces(pattern[: m.start()] + v + pattern[m.end() :])] or [pattern]


def first_rule(files: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """files with rule_id, that of the first rule (id, glob) whose path fits; `**/` may stand for nothing."""
    out = F.lit(None).cast("string")
    for rule_id, glob in reversed(rules):
        globs = [g for x in expand_braces(glob) for g in ([x, x[3:]] if x.startswith("**/") else [x])]
        out = F.when(F.greatest(*(F.col("path").rlike(f"^{fnmatch.translate(g)}") for g in globs), F.lit(False)), F.lit(rule_id)).otherwise(out)
    return files.withColumn("rule_id", out)


#: Extensions that go together, scores of relations, and what marks tests and locales in a name.
COMPANIONS = ({"c", "h", "cc", "cpp", "hpp"}, {"js", "jsx", "ts", "tsx"}, {"java", "kt", "kts"})
SCORES = {"companion_source_header": 100, "current_calls_related_symbol": 95, "current_references_related": 90, "related_calls_current_symbol": 88, "related_references_current": 85, "implementation_test_pair": 80, "localized_resource_family": 70}
TEST_PREFIX, TEST_SUFFIX = r"(?i)^(?:test_|spec_)", r"(?i)[._-](?:test|tests|spec)$"
LOCALE_SUFFIX = r"(?i)[._-][a-z]{2}(?:[_-][A-Z]{2})?$"
SOURCE_FOLDERS = r"(?i)(^|/)(?:src|source|test|tests|spec|specs)$"
#: Possessive, as Java's regex recurses for each word otherwise and overflows its stack on a long line.
C_FUNCTION = r"(?m)^[\t ]*(?:[A-Za-z_]\w*+[\t ]++(?!\()|[*][\t ]*+)++([A-Za-z_]\w*)[\t ]*\([^;{}]*\)[\t ]*\{"
QUOTED = r"""["']([^"'\r\n]+)["']"""


def _name_parts(df: DataFrame) -> DataFrame:
    base = F.element_at(F.split("path", "/"), -1)
    folder = F.when(F.contains("path", F.lit("/")), F.regexp_extract("path", r"^(.*)/", 1)).otherwise("")
    stem = F.when(base.rlike(r"^.+\.[^.]+$"), F.regexp_extract(base, r"^(.+)\.[^.]+$", 1)).otherwise(base)
    ext = F.when(base.rlike(r"^.+\.[^.]+$"), F.lower(F.regexp_extract(base, r"\.([^.]+)$", 1))).otherwise("")
    family = F.coalesce(*(F.when(ext.isin(*g), F.lit(i)) for i, g in enumerate(COMPANIONS)))
    return df.withColumns({"base": F.lower(base), "folder": F.lower(folder), "stem": F.lower(stem), "raw_stem": stem, "ext": ext, "family": family}).withColumns(
        {
            "test_key": F.concat_ws("\t", F.lower(F.regexp_replace(F.regexp_replace("raw_stem", TEST_PREFIX, ""), TEST_SUFFIX, "")), F.regexp_replace("folder", SOURCE_FOLDERS, "")),
            "locale_key": F.concat_ws("\t", F.lower(F.regexp_replace("raw_stem", LOCALE_SUFFIX, "")), "ext", "folder"),
        }
    )


def _joined_path(folder: Column, ref: Column) -> Column:
    """The parts of folder/ref with `.` and empty parts left out and `..` applied; those that lead above the root stay."""
    parts = F.filter(F.split(F.concat_ws("/", folder, ref), "/"), lambda p: ~p.isin("", "."))
    up = lambda a: F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))
    return F.aggregate(parts, F.array().cast("array<string>"), lambda a, p: F.when((p == "..") & (F.size(a) > 0) & (F.try_element_at(a, F.lit(-1)) != ".."), up(a)).otherwise(F.array_append(a, p)))


def _relative(folder: Column, parts: Column) -> Column:
    """The shortest way from a folder to a path given in parts."""
    start = F.filter(F.split(folder, "/"), lambda p: p != "")
    least = F.least(F.size(start), F.size(parts))
    differs = F.filter(F.sequence(F.lit(0), least), lambda i: (i == least) | (F.get(start, i) != F.get(parts, i)))
    common = F.get(differs, 0)
    return F.array_join(F.concat(F.array_repeat(F.lit(".."), F.size(start) - common), F.slice(parts, common + 1, F.size(parts))), "/")


def _references(t: DataFrame) -> DataFrame:
    """from, kind and key of what texts quote: a path, name or path without suffix as it stands or without its first `../`; the
    path that it leads to from the text's folder; its last part after a slash; and, with a suffix, what goes together with it by name."""
    low = F.lower(F.replace("q", F.lit("\\"), F.lit("/")))
    refs = t.select("path", "folder", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(QUOTED), F.lit(1)))).alias("q"))
    refs = refs.select("path", "folder", F.when(low.startswith("./"), F.substring(low, F.lit(3), F.length(low))).otherwise(low).alias("ref")).distinct()
    short = F.when(F.col("ref").startswith("../"), F.substring("ref", F.lit(4), F.length("ref"))).otherwise(F.col("ref"))
    led = lambda c: F.when(_relative(F.col("folder"), _joined_path(F.col("folder"), c)) == c, F.array_join(_joined_path(F.col("folder"), c), "/"))
    last = F.element_at(F.split("ref", "/"), -1)
    stem, ext = F.regexp_extract(last, r"^(.+)\.[^.]+$", 1), F.regexp_extract(last, r"^.+\.([^.]+)$", 1)
    family = F.coalesce(*(F.when(ext.isin(*g), F.lit(str(i))) for i, g in enumerate(COMPANIONS)))
    key = lambda kind, c: F.struct(F.lit(kind).alias("kind"), c.alias("key"))
    keys = F.array(
        key("path", F.col("ref")), key("path", short), key("path", led(F.col("ref"))), key("path", led(short)), key("bare", F.col("ref")), key("bare", short), key("bare", led(F.col("ref"))), key("bare", led(short)),
        key("name", F.col("ref")), key("name", short), key("name", F.when(F.contains("ref", F.lit("/")), last)), key("family", F.concat_ws("\t", stem, family, ext)),
    )
    found = refs.select(F.col("path").alias("from"), F.explode(keys).alias("k")).select("from", "k.kind", "k.key")
    return found.where("key <> '' and (kind <> 'family' or size(split(key, '\t')) = 3)").distinct()


def _referred(files: DataFrame) -> DataFrame:
    """to, kind and key by which files are referred to: a file goes together with others of its stem and family, but not of its own extension."""
    bare = F.when(F.col("ext") != "", F.lower(F.regexp_replace("path", r"\.[^./]+$", ""))).otherwise(F.lower("path"))
    others = F.coalesce(*(F.when(F.col("family") == i, F.array(*(F.lit(e) for e in sorted(g)))) for i, g in enumerate(COMPANIONS)), F.array().cast("array<string>"))
    with_it = F.transform(F.filter(others, lambda e: e != F.col("ext")), lambda e: F.concat_ws("\t", "stem", F.col("family").cast("string"), e))
    key = lambda kind, c: F.struct(F.lit(kind).alias("kind"), c.alias("key"))
    keys = F.concat(F.array(key("path", F.lower("path")), key("bare", bare), key("name", F.col("base"))), F.transform(with_it, lambda x: key("family", x)))
    return files.select(F.col("path").alias("to"), F.explode(keys).alias("k")).select("to", "k.kind", "k.key").distinct()


def related_files(tree: DataFrame, k: int = 8) -> DataFrame:
    """path, related, score (the largest of its reasons) and reasons, the k best per path. Every reason is an equality join on a key
    of its own (name, test name, locale family, quoted name, called symbol), so files are never paired with all others. A path may have several texts."""
    t = _name_parts(tree.select("path", "language", F.coalesce("text", F.lit("")).alias("text")))
    files = _name_parts(tree.select("path", "language").distinct())
    a, b = (files.select(*(F.col(c).alias(f"{c}_{s}") for c in ("path", "base", "stem", "raw_stem", "ext", "family", "test_key", "locale_key", "language"))) for s in "ab")
    pair = ["path_a", "path_b"]
    found = [
        (a.join(b, (a.stem_a == b.stem_b) & (a.family_a == b.family_b) & (a.ext_a != b.ext_b)), "companion_source_header"),
        (a.join(b, (a.test_key_a == b.test_key_b) & (a.raw_stem_a != b.raw_stem_b)), "implementation_test_pair"),
        (a.join(b, (a.locale_key_a == b.locale_key_b) & (a.raw_stem_a != b.raw_stem_b)), "localized_resource_family"),
    ]
    linked = _references(t).join(_referred(files), ["kind", "key"]).select("from", "to").distinct().where("from <> to")
    found += [(linked.select(F.col("from").alias("path_a"), F.col("to").alias("path_b")), "current_references_related"), (linked.select(F.col("to").alias("path_a"), F.col("from").alias("path_b")), "related_references_current")]
    c = t.where("language = 'C'")
    defined = c.select(F.col("path").alias("to"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(C_FUNCTION), F.lit(1)))).alias("s"))
    called = c.select(F.col("path").alias("from"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\b([A-Za-z_]\w*)\s*\("), F.lit(1)))).alias("s"))
    called = called.join(defined.select(F.col("to").alias("from"), "s"), ["from", "s"], "left_anti")
    uses = called.join(defined, "s").select("from", "to").distinct().where("from <> to")
    found += [(uses.select(F.col("from").alias("path_a"), F.col("to").alias("path_b")), "current_calls_related_symbol"), (uses.select(F.col("to").alias("path_a"), F.col("from").alias("path_b")), "related_calls_current_symbol")]
    out = None
    for df, reason in found:
        df = df.where("path_a <> path_b").select(*pair, F.lit(reason).alias("reason"), F.lit(SCORES[reason]).alias("score")).distinct()
        out = df if out is None else out.unionByName(df)
    out = out.groupBy(*pair).agg(F.max("score").alias("score"), F.array_sort(F.collect_set("reason")).alias("reasons"))
    best = Window.partitionBy("path_a").orderBy(F.desc("score"), "path_b")
    return out.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k).select(F.col("path_a").alias("path"), F.col("path_b").alias("related"), "score", "reasons")


#: Comment syntax by language (line starts, block pairs), and comments that tools act on.
_C = (("//",), (("/*", "*/"),))
_HASH = (("#",), ())
COMMENTS = dict.fromkeys(("c", "c/c++ header", "c++", "c++ header", "c#", "go", "java", "javascript", "javascript react", "kotlin", "rust", "scala", "swift", "typescript", "typescript react", "scss"), _C)
COMMENTS |= dict.fromkeys(("python", "ruby", "shell", "powershell", "yaml", "toml"), _HASH)
COMMENTS |= {"php": (("//", "#"), (("/*", "*/"),)), "css": ((), (("/*", "*/"),)), "html": ((), (("<!--", "-->"),)), "vue": (("//",), (("<!--", "-->"), ("/*", "*/"))), "sql": (("--",), (("/*", "*/"),)), "ini": ((";", "#"), ())}
EFFECTIVE = ("coding:", "coding=", "coverage:", "eslint-", "go:build", "gosec", "noinspection", "nolint", "noqa", "nosec", "pragma:", "shellcheck", "sourcemappingurl=", "type: ignore")
EFFECTIVE_STARTS = {"powershell": ("#requires",), "sql": ("/*+", "/*!"), "html": ("<!--[if",), "vue": ("<!--[if",), "go": ("// +build",)}


@cache
def scanner(language: str):
    """A function (code, open block's end) -> (has code, open block's end), by one pattern per language; None for unknown ones."""
    if (syntax := COMMENTS.get(language.strip().lower())) is None:
        return None
    starts, pairs = syntax
    ends = dict(pairs)
    either = lambda name, words: f"(?P<{name}>{'|'.join(map(re.escape, words))})"
    parts = [either("line", starts)] * bool(starts) + [either("block", ends)] * bool(ends)
    # code runs on to what may begin another token
    first = "".join(re.escape(c) for c in sorted({w[0] for w in (*starts, *ends)} | set("\"'`")))
    token = re.compile("|".join([*parts, r"""(?P<text>"(?:\\.|[^"\\])*(?:"|\\?$)|'(?:\\.|[^'\\])*(?:'|\\?$)|`(?:\\.|[^`\\])*(?:`|\\?$))""", r"(?P<space>\s+)", rf"(?P<code>[^\s{first}][^{first}]*|.)"]), re.DOTALL)

    def scan(code: str, inside: str) -> tuple[bool, str]:
        at, seen = 0, False
        while at < len(code):
            if inside:
                at = code.find(inside, at)
                if at < 0:
                    return seen, inside
                at, inside = at + len(inside), ""
                continue
            m = token.match(code, at)
            kind = m.lastgroup
            if kind == "line":
                break
            if kind == "block":
                inside = ends[m[0]]
            seen |= kind in ("text", "code")
            if seen and not ends:  # no block can open
                break
            at = m.end()
        return seen, inside

    return scan


def comment_only(blocks: DataFrame) -> DataFrame:
    """path, block_id and whether a block (path, language, block_id, diff_lines) changes comments and blanks alone. Open comments are carried
    from block to block of a file, for either side of the diff, so a file's blocks are scanned in order, in Python."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, out = chain.from_iterable(b.to_pylist() for b in batches), []
        for _, group in groupby(rows, key=lambda r: r["path"]):
            language, scan, inside = None, None, {"old": "", "new": ""}
            for r in group:
                if language is None:  # the file's first block names it
                    language = r["language"] or ""
                    scan, low = scanner(language), language.strip().lower()
                changed, only = False, scan is not None
                for line in (r["diff_lines"] or ()) if scan else ():
                    marker, code = line[6:7], line[9:]
                    number = line[:6].strip()
                    for side in {"+": ("new",), "-": ("old",), " ": ("old", "new")}.get(marker, ()):
                        seen, inside[side] = scan(code, inside[side])
                        if marker in "+-":
                            changed = True
                            if only:
                                text = code.strip().lower()
                                acts = (number == "1" and text.startswith("#!")) or text.startswith(EFFECTIVE_STARTS.get(low, ("\0",))) or any(m in text for m in EFFECTIVE)
                                only = not seen and not acts
                out.append({"path": r["path"], "block_id": r["block_id"], "comment_only": changed and only})
                if len(out) == 4096:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out = []
        yield pa.RecordBatch.from_pylist(out, schema)

    schema = pa.schema([("path", pa.string()), ("block_id", pa.int32()), ("comment_only", pa.bool_())])
    dealt = blocks.select("path", "language", "block_id", "diff_lines").repartition("path").sortWithinPartitions("path", "block_id")
    return dealt.mapInArrow(run, "path string, block_id int, comment_only boolean")
