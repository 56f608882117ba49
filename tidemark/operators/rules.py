"""Review rules by file: a default, layers that are merged over it in order where they fit, or the first rule whose path fits.

Rules are configuration, read from JSON files; what they make of a file is one expression over its path and language, so a tree of any
size is resolved in one pass without a join. Merging: lists are joined, nested maps merged alike, all else is replaced.
"""

from __future__ import annotations

import fnmatch
import json
from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.code import expand_braces
from tidemark.sources.views import RequestError

#: What selects a layer and isn't merged.
SELECTORS = ("language", "extensions", "pattern")


def merged(base: dict, extra: dict) -> dict:
    """base with extra's values, as layers are merged; neither is changed."""
    out = dict(base)
    for k, v in extra.items():
        if k in SELECTORS:
            continue
        old = out.get(k)
        out[k] = [*old, *v] if isinstance(v, list) and isinstance(old, list) else merged(old, v) if isinstance(v, dict) and isinstance(old, dict) else v
    return out


def load_rules(spark: SparkSession, paths: list[str]) -> dict:
    """Rule files, each a JSON object, merged in order; a file that isn't there counts for nothing."""
    out: dict[str, Any] = {}
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            data = json.loads(spark.read.text(path, wholetext=True).first().value)
            if not isinstance(data, dict):
                raise RequestError(f"no rules in {path}")
            out = merged(out, data)
    return out


def fits(layer: dict, path: Column, language: Column, by_path: bool) -> Column:
    """Whether a layer fits a file: a path's part or glob; or else a language's part, or one of its extensions."""
    if by_path:
        pattern = str(layer.get("pattern") or "")
        return F.contains(path, F.lit(pattern)) | path.rlike(f"^{fnmatch.translate(pattern)}") if pattern else F.lit(False)
    name = F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1)
    # leading dots begin no extension, nor does a last one
    suffix = F.lower(F.regexp_extract(name, r"^\.*[^.]+.*?(\.[^.]+)$", 1))
    wanted = str(layer.get("language") or "").lower()
    out = suffix.isin([str(x).lower() for x in layer.get("extensions") or []]) if layer.get("extensions") else F.lit(False)
    return out | F.contains(F.lower(language), F.lit(wanted)) if wanted else out


def _leaves(value: dict, prefix: tuple = ()) -> Iterator[tuple[tuple, Any]]:
    for k, v in value.items():
        if isinstance(v, dict) and v:
            yield from _leaves(v, (*prefix, k))
        else:
            yield (*prefix, k), v


def _json(v: Any) -> str:
    return json.dumps(v, ensure_ascii=False, sort_keys=True)


def resolved(files: DataFrame, rules: dict) -> DataFrame:
    """files (path, language, ...) with `resolution`, `matched_rule_id`, `focus` (an array of texts) and `settings`: the other fields, as a map from dotted names to JSON.

    A field that one layer has as a list and a later one as something else is what the later one says; lists join after it. A name that one layer has as a map and
    another as a plain value is refused.
    """
    path, language = F.col("path"), F.coalesce("language", F.lit(""))
    layers: list[tuple[Column | None, dict]] = [(None, rules.get("default") or {})]
    for by_path, name in ((False, "languages"), (True, "path_rules")):
        layers += [(fits(x, path, language, by_path), {k: v for k, v in x.items() if k not in SELECTORS}) for x in rules.get(name) or []]
    fields: dict[tuple, list[tuple[Column | None, Any]]] = {}
    for holds, layer in layers:
        for name, value in _leaves(layer):
            fields.setdefault(name, []).append((holds, value))
    for a in fields:
        if any(a != b and b[: len(a)] == a for b in fields):
            raise RequestError(f"{'.'.join(a)} is a map and a plain value")

    def folded(said: list[tuple[Column | None, Any]]) -> Column:
        """A field's value as an array of JSON texts with a mark of whether it is a list; null where no layer has it."""
        out = F.lit(None).cast("struct<list:boolean,items:array<string>>")
        for holds, value in said:
            is_list = isinstance(value, list)
            items = F.array(*(F.lit(_json(x)) for x in (value if is_list else [value]))).cast("array<string>")
            items = F.when(out["list"], F.concat(out["items"], items)).otherwise(items) if is_list else items
            new = F.struct(F.lit(is_list).alias("list"), items.alias("items"))
            out = new if holds is None else F.when(holds, new).otherwise(out)
        return out

    as_text = lambda v: F.when(v["list"], F.concat(F.lit("["), F.array_join(v["items"], ", "), F.lit("]"))).otherwise(F.get(v["items"], 0))
    focus = F.coalesce(F.array_distinct(folded(fields.get(("focus",), []))["items"]), F.array().cast("array<string>"))
    others = {".".join(n): as_text(folded(v)) for n, v in fields.items() if n != ("focus",)}
    base = {".".join(n): _json(v) for n, v in _leaves(rules.get("default") or {}) if n != ("focus",)}

    explicit, rule_focus, pattern = F.lit(None).cast("string"), F.array().cast("array<string>"), F.lit(None).cast("string")
    for n, rule in reversed([(n, r) for n, r in enumerate(rules.get("rules") or []) if isinstance(r, dict) and r.get("path")]):
        glob = str(rule["path"]).replace("\\", "/")
        globs = [g for x in expand_braces(glob) for g in ([x, x[3:]] if x.startswith("**/") else [x])]
        holds = F.greatest(*(F.replace(path, F.lit("\\"), F.lit("/")).rlike(f"^{fnmatch.translate(g)}") for g in globs), F.lit(False))
        text = str(rule.get("rule") or "").strip()
        explicit = F.when(holds, F.lit(str(rule.get("id", f"rule-{n + 1}") or ""))).otherwise(explicit)
        pattern = F.when(holds, F.lit(str(rule["path"]))).otherwise(pattern)
        rule_focus = F.when(holds, F.array(*([F.lit(_json(text))] if text else [])).cast("array<string>")).otherwise(rule_focus)
    first = explicit.isNotNull()
    made = lambda of: F.map_from_entries(F.filter(F.array(*(F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in of.items())), lambda e: e["v"].isNotNull())) if of else F.create_map().cast("map<string,string>")
    return files.withColumns(
        {
            "resolution": F.when(first, "first-match").otherwise("legacy-merge"),
            "matched_rule_id": explicit,
            "matched_rule_pattern": pattern,
            "focus": F.transform(F.when(first, rule_focus).otherwise(focus), lambda x: F.when(x.startswith('"'), F.from_json(F.concat(F.lit('{"x": '), x, F.lit("}")), "x string")["x"]).otherwise(x)),
            "settings": F.when(first, made({k: F.lit(v) for k, v in base.items()})).otherwise(made(others)),
        }
    )
