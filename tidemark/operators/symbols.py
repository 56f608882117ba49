"""A stored symbol index: definitions, references and call edges, written once in buckets of the symbol that they are looked up by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import symbol_key
from tidemark.operators.code import CONTROL, DEPTH, call_graph, calls, code_lines, definitions
from tidemark.shared import kept
from tidemark.sources.views import RequestError
from tidemark.versions import Versions

#: A line that declares a function without its body: a type, a name, parameters and a semicolon.
DECLARATION = r"^\s*(?!return\b|else\b|throw\b|new\b|await\b)[A-Za-z_][\w\s*<>:&\[\]]*[\s*&]([A-Za-z_]\w*)\s*\([^;{}()]*\)\s*;\s*$"
TABLES = {"definition": "k", "reference": "k", "edge_by_caller": "k", "edge_by_callee": "k"}
MOST = 100


def declarations(lines: DataFrame) -> DataFrame:
    name = F.regexp_extract("code", DECLARATION, 1)
    return lines.select("path", "line", F.substring(F.trim("code"), 1, 300).alias("signature"), name.alias("name")).where((F.col("name") != "") & ~F.col("name").isin(*CONTROL))


def bounded(df: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The first rows in order, at most so many, with `place` from 1 and `truncated`, whether there are more: one row more than the limit is looked at."""
    limit = max(1, min(limit, MOST))
    first = df.orderBy(*order).limit(limit + 1)
    # limit + 1 rows at most from here on
    first = first.withColumns({"place": F.row_number().over(Window.orderBy(*order)), "truncated": F.count("*").over(Window.partitionBy()) > limit})
    return first.where(F.col("place") <= limit)


class SymbolIndex:
    """The index of a version of a store; built from a tree (path, text), each file read once."""

    def __init__(self, store: Versions, version: int | None = None):
        self.store, self.version = store, store.latest() if version is None else version

    @classmethod
    def build(cls, store: Versions, tree: DataFrame) -> SymbolIndex:
        lines = kept(code_lines(tree))
        declared = declarations(lines)
        defs = definitions(lines).withColumn("is_definition", F.lit(True)).unionByName(declared.withColumn("is_definition", F.lit(False))).withColumn("k", symbol_key(F.col("name")))
        edges = kept(calls(lines.join(declared.select("path", "line"), ["path", "line"], "left_anti")))
        put = {
            "definition": defs,
            "reference": edges.select(symbol_key(F.col("callee")).alias("k"), F.col("callee").alias("symbol"), "path", "line", "context", F.lit("call").alias("reference_kind")),
            "edge_by_caller": edges.withColumn("k", symbol_key(F.col("caller"))),
            "edge_by_callee": edges.withColumn("k", symbol_key(F.col("callee"))),
        }
        files = tree.select("path").distinct().count()
        put = {name: df.where("k is not null") for name, df in put.items()}
        return cls(store, store.commit(store.latest(), put=put, keys=TABLES, notes={"files_indexed": files}))

    def _of(self, table: str, symbol: str) -> DataFrame:
        """A symbol's rows; only its bucket is read."""
        key = self.store.spark.range(1).select(symbol_key(F.lit(symbol))).first()[0] if len(symbol) <= 256 else None
        if key is None:
            raise RequestError("a symbol is an identifier or a qualified name")
        return self.store.lookup(table, [key], self.version)

    def find_definition(self, symbol: str, current: str = "", limit: int = 20) -> DataFrame:
        """The current file first, definitions before declarations, then by path and line."""
        return bounded(self._of("definition", symbol), [F.col("path") != clean(current), ~F.col("is_definition"), F.col("path"), F.col("line")], limit)

    def find_references(self, symbol: str, path: str = "", declarations: bool = False, limit: int = 100) -> DataFrame:
        """By path and line; with declarations, definitions are among them, as references of kind `definition`."""
        df = self._of("reference", symbol)
        if declarations:
            own = self._of("definition", symbol)
            df = df.unionByName(own.select("k", F.col("name").alias("symbol"), "path", "line", F.col("signature").alias("context"), F.lit("definition").alias("reference_kind")))
        df = df.where(F.col("path") == clean(path)) if clean(path) else df
        return bounded(df, [F.col("path"), F.col("line"), F.desc("reference_kind"), F.col("context")], limit)

    def call_graph(self, symbol: str, direction: str = "both", depth: int = 1, limit: int = 100) -> DataFrame:
        """Edges within 1 to 3 steps, by path, line, caller and callee. One step reads one bucket of each side; further ones meet the frontier by a join."""
        direction = direction if direction in ("incoming", "outgoing", "both") else "both"
        columns = ["caller", "callee", "path", "line", "context"]
        if min(DEPTH, max(1, depth)) == 1:
            sides = [self._of(t, symbol).select(*columns) for t, d in (("edge_by_caller", "outgoing"), ("edge_by_callee", "incoming")) if direction in (d, "both")]
            found = sides[0] if len(sides) == 1 else sides[0].unionByName(sides[1])
        else:
            self._of("edge_by_caller", symbol)  # a symbol that is none is refused
            found = call_graph(self.store.read("edge_by_caller", self.version).select(*columns), symbol, direction, depth)
        return bounded(found.distinct(), [F.col("path"), F.col("line"), F.col("caller"), F.col("callee")], limit)

    def stats(self) -> DataFrame:
        """One row of counts, from the stored tables."""
        n = {name: self.store.read(t, self.version).count() for name, t in (("definition_count", "definition"), ("reference_count", "reference"), ("call_edge_count", "edge_by_caller"))}
        n = {"files_indexed": self.store.notes(self.version)["files_indexed"]} | n
        return self.store.spark.createDataFrame([tuple(n.values())], ", ".join(f"{c} long" for c in n))


def clean(path: str) -> str:
    return path.replace("\\", "/").strip().lstrip("./")
