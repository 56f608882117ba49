"""Source trees, SARIF reports and author maps as DataFrames."""

from __future__ import annotations

import fnmatch
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.views import RequestError

#: Languages by extension; the extensions are those that are read. Folders that are never read.
LANGUAGES = {
    "py": "Python", "js": "JavaScript", "jsx": "JavaScript React", "ts": "TypeScript", "tsx": "TypeScript React", "go": "Go", "java": "Java", "kt": "Kotlin", "kts": "Kotlin",
    "c": "C", "h": "C/C++ Header", "cpp": "C++", "hpp": "C++ Header", "cc": "C++", "cs": "C#", "rs": "Rust", "php": "PHP", "rb": "Ruby", "swift": "Swift", "scala": "Scala", "sql": "SQL",
    "yaml": "YAML", "yml": "YAML", "json": "JSON", "toml": "TOML", "ini": "INI", "md": "Markdown", "sh": "Shell", "bash": "Shell", "ps1": "PowerShell", "html": "HTML", "css": "CSS", "scss": "SCSS", "vue": "Vue",
}
FOLDERS = (".git", ".opencodereview", "__pycache__", "node_modules", ".venv", "venv", "dist", "build", ".pytest_cache")


@dataclass(frozen=True)
class Exclusions:
    """folders: whole path parts; patterns: substrings of the lower-cased path, asterisks aside."""

    folders: tuple[str, ...] = FOLDERS
    patterns: tuple[str, ...] = field(default=())

    def column(self, path: Column) -> Column:
        out = F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, self.folders))) if self.folders else F.lit(False)
        for p in self.patterns:
            if text := p.replace("*", "").strip().lower():
                out = out | F.contains(F.lower(path), F.lit(text))
        return out


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))


def language(path: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))
    return F.coalesce(F.try_element_at(table, extension(path)), F.lit("General"))


def allowed(path: Column) -> Column:
    return extension(path).isin(*LANGUAGES)


def clean_path(path: Column) -> Column:
    """Forward slashes, and none of the characters `.` and `/` in front."""
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^[./]+", "")


def read_tree(spark: SparkSession, root: str, exclusions: Exclusions = Exclusions()) -> DataFrame:
    """path, text, md5 and language of a tree's files that are allowed, not excluded and not binary (no NUL in 4 KiB)."""
    either = lambda c: f"[{c}{c.upper()}]" if c.isalpha() else c
    glob = "*.{" + ",".join("".join(map(either, e)) for e in LANGUAGES) + "}"  # so that files of other kinds aren't read at all
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    base = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath().rstrip("/")
    path = F.expr(f"substring(path, locate('{base}/', path) + {len(base) + 1})")
    files = files.withColumn("rel", path).where(allowed(F.col("rel")) & ~exclusions.column(F.col("rel")))
    files = files.where(~F.contains(F.substring("content", 1, 4096), F.lit(bytearray(b"\0"))))
    return files.select(F.col("rel").alias("path"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"), F.md5("content").alias("md5"), language(F.col("rel")).alias("language"))


SARIF = "runs array<struct<tool:struct<driver:struct<name:string,rules:array<struct<id:string,helpUri:string,shortDescription:struct<text:string>,fullDescription:struct<text:string>>>>>,results:array<struct<ruleId:string,level:string,message:struct<text:string,markdown:string>,locations:array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:string,endLine:string>>>>>>>>"


def read_reports(spark: SparkSession, root: str, globs: list[str], most_bytes: int = 20 << 20) -> DataFrame:
    """path and value of the SARIF reports (.sarif, .json) under root that fit a glob and aren't too large; larger ones aren't read."""
    base = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath().rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{sarif,json,SARIF,JSON}").load(root).where(F.col("length") <= most_bytes)
    files = files.withColumn("rel", F.expr(f"substring(path, locate('{base}/', path) + {len(base) + 1})"))
    fits = F.greatest(*(F.col("rel").rlike(f"^{fnmatch.translate(g)}") for g in globs), F.lit(False), F.lit(False))
    return files.where(fits).select(F.col("rel").alias("path"), F.make_valid_utf8(F.col("content").cast("string")).alias("value"))


def unquoted(c: Column) -> Column:
    """Percent escapes decoded; a plus sign, and a percent sign that starts no escape, stay."""
    return F.url_decode(F.replace(F.regexp_replace(c, "%(?![0-9A-Fa-f]{2})", "%25"), F.lit("+"), F.lit("%2B")))


def repository_path(uri: Column, root: str = "") -> Column:
    """A finding's URI as a path in the tree: no scheme or file:, absolute ones inside root; null for all others and for those with `..`."""
    scheme = F.lower(F.regexp_extract(uri, r"^([a-zA-Z][a-zA-Z0-9+.-]*):", 1))
    raw = F.when(scheme == "file", F.regexp_replace(F.regexp_replace(uri, r"(?i)^file:(//[^/?#]*)?", ""), r"[?#].*$", "")).when(scheme == "", uri)
    raw = F.replace(unquoted(raw), F.lit("\\"), F.lit("/"))
    base = root.rstrip("/") + "/"
    inside = F.when(~raw.startswith("/"), raw).when(F.lit(bool(root)) & raw.startswith(base), F.substring(raw, F.lit(len(base) + 1), F.length(raw)))
    parts = F.filter(F.split(inside, "/"), lambda p: ~p.isin("", "."))
    return F.when((F.size(parts) > 0) & ~F.array_contains(parts, ".."), F.array_join(parts, "/"))


def findings(reports: DataFrame, root: str = "", most: int = 2000) -> DataFrame:
    """Findings of SARIF reports (columns value and, if there, path), each once: by fingerprint, the first `most` by file, lines, rule and analyzer."""
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"(.)\.[^.]*$", "$1") if "path" in reports.columns else F.lit("sarif")
    runs = reports.select(stem.alias("stem"), F.explode(F.from_json("value", SARIF)["runs"]).alias("r")).select("stem", F.col("r.tool.driver").alias("d"), F.explode("r.results").alias("x"))
    place = F.get(F.col("x.locations"), 0)["physicalLocation"]
    rule = F.try_element_at(F.filter("d.rules", lambda r: r["id"] == F.col("x.ruleId")), F.lit(-1))
    text = lambda c: F.nullif(c, F.lit(""))
    line = lambda c: F.when(c.try_cast("int") > 0, c.try_cast("int"))
    start = line(place["region"]["startLine"])
    df = runs.select(
        F.coalesce(text(F.col("d.name")), "stem").alias("analyzer"),
        F.coalesce("x.ruleId", F.lit("")).alias("rule_id"),
        F.lower(F.coalesce(text(F.col("x.level")), F.lit("warning"))).alias("level"),
        F.coalesce(text(F.col("x.message.text")), text(F.col("x.message.markdown")), text(F.coalesce(rule["shortDescription"], rule["fullDescription"])["text"])).alias("message"),
        repository_path(place["artifactLocation"]["uri"], root).alias("file_name"),
        start.alias("start_line"),
        F.coalesce(line(place["region"]["endLine"]), start).alias("given_end"),
        F.coalesce(rule["helpUri"], F.lit("")).alias("help_uri"),
    )
    df = df.where("file_name is not null and start_line is not null and message is not null")
    df = df.withColumn("fingerprint", F.sha2(F.concat_ws("|", "analyzer", "rule_id", "file_name", F.col("start_line").cast("string"), F.col("given_end").cast("string"), "message"), 256))
    df = df.withColumn("end_line", F.greatest("start_line", "given_end")).drop("given_end")
    order = ["file_name", "start_line", "end_line", "rule_id", "analyzer"]
    return df.dropDuplicates(["fingerprint"]).orderBy(*order, "fingerprint").limit(most)


def author_map(documents: DataFrame) -> DataFrame:
    """path and author from JSON objects (column `value`): blanks are left out, of equal paths the last one counts."""
    pairs = documents.select(F.posexplode(F.from_json("value", "map<string,string>"))).select("pos", clean_path(F.trim("key")).alias("path"), F.trim("value").alias("author"))
    return pairs.where("path <> '' and author <> ''").groupBy("path").agg(F.max_by("author", "pos").alias("author"))


def version_path(version: str, project: str = "", parent: str = "", root: str = "") -> str:
    """Where a version's tree is: as it is if absolute, else under its parent, else under the project's folder in the root, else as it is."""
    if version.startswith("/"):
        return version
    if parent:
        return f"{parent.rstrip('/')}/{version}"
    return f"{root.rstrip('/')}/{project}/{version}" if root else version


def author_map_path(spark: SparkSession, value: str, root: str = "") -> str:
    """An author map's file, checked: it has to be there, and inside the root if there is one; no name is no map."""
    if not (value or "").strip():
        return ""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(value.strip())
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at) or not fs.getFileStatus(at).isFile():
        raise RequestError(f"no such author map: {value}")
    path = at.toUri().normalize().getPath()
    if root and not path.startswith(root.rstrip("/") + "/"):
        raise RequestError("the author map has to be inside the repository's root")
    return path
