"""Operator 1, native: line dedup by winnowing.

A text is its lines that have a word. From every line starts a gram: the shortest run of lines with NOISE words. From
every line that GUARANTEE words follow, the smallest gram hash is selected among the grams that start within the next
GUARANTEE - NOISE words: so any run of lines of GUARANTEE words that two places share has the same fingerprint in both.

Positions are joined by fingerprint; one that stands alone is done with. From those that repeat, matches are extended
both ways: around each, the shortest runs of GUARANTEE words from a line on, and up to a line, are joined with the first
place (by doc_id, then line) that has the same run, and go if that isn't their own. Every run is held against its own
first place, so parts of a passage may be matched with different texts; overlapping ones add up to the whole match.
The result is exact: a line goes if and only if a run of lines of GUARANTEE words or more around it stands at an earlier
place as well. No shorter run is ever deleted, and of equal lines the first one always stays.

Places are never joined with each other but with one row for each fingerprint or run, and keys that are very common are
broadcast, so the work is linear however common a passage is. Only hashes of lines are shuffled; texts meet the runs to
delete in a broadcast join while these are counted to be few.

Cases: null texts stay null; texts without words have no lines; a blank line goes if the lines with words before and after
it go; a text may become empty, its row stays; a null id comes first; rows with equal id and text are one document
and keep equal texts; ties between grams go to the earlier line; a very long text is worked on line by line, windows never
span more than GUARANTEE words; an empty table gives an empty result; extra columns pass through `line_deduped`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, alone, checked, fresh, joined_by_key, kept, table

#: Words of a gram, and of the shortest run that is deleted where it repeats.
NOISE, GUARANTEE = 25, 50
KEY = ["kd", "kt"]


def _key(doc_id: str = "doc_id", text: str = "text") -> tuple[Column, Column]:
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**63))), F.xxhash64(text)


def hashed_lines(docs: DataFrame) -> DataFrame:
    """kd, kt and, for each line that has a word, pos, o (its place in the text), h (its hash), the words before it (s) and up to its end (e), and the text's words. One text for each different document."""
    kd, kt = _key()
    each = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x, i: F.struct(i.alias("o"), F.xxhash64(x).alias("h"), F.regexp_count(x, F.lit(WORD)).alias("n")))
    texts = docs.select(kd.alias("kd"), kt.alias("kt"), F.filter(each, lambda x: x["n"] > 0).alias("lines")).dropDuplicates(KEY)
    rows = texts.select(*KEY, F.aggregate("lines", F.lit(0), lambda a, x: a + x["n"]).alias("words"), F.posexplode("lines").alias("pos", "x"))
    upto = Window.partitionBy(*KEY).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select(*KEY, "words", "pos", "x.o", "x.h", "x.n").where(F.col("words") >= GUARANTEE).withColumn("e", F.sum("n").over(upto).cast("int"))
    return rows.select(*KEY, "words", "pos", "o", "h", (F.col("e") - F.col("n")).alias("s"), "e")


def fingerprints(lines: DataFrame) -> DataFrame:
    """kd, kt, g (hash of a gram), and pos, s and e of the line where it starts."""
    by_words = Window.partitionBy(*KEY).orderBy("s")
    grams = lines.withColumn("g", F.xxhash64(F.collect_list("h").over(by_words.rangeBetween(0, NOISE - 1))))
    low = F.min(F.struct("g", "pos", "s", "e")).over(by_words.rangeBetween(0, GUARANTEE - NOISE))
    return grams.withColumn("low", low).where(F.col("s") + GUARANTEE <= F.col("words")).select(*KEY, "low.*").distinct()


def _run_hash(lines: Column, tag: int) -> list[Column]:
    """128 bits, as a 64-bit hash would have equals by chance among all runs of a large corpus."""
    return [F.xxhash64(F.lit(tag + i), lines).alias(f"g{i}") for i in range(2)]


def extended(lines: DataFrame, seeds: DataFrame) -> DataFrame:
    """The runs that seeds (kd, kt, pos, s, e) are extended by: hash (g0, g1), first and last line (p1, p2) and their places in the text (o1, o2).

    Seeds lie among the lines as rows without a hash, so each window sees whether it holds one.
    """
    rows = lines.join(seeds.select(*KEY).distinct(), KEY, "left_semi").withColumn("seed", F.lit(0))
    rows = rows.unionByName(seeds.select(*KEY, "pos", "s", "e", F.lit(1).alias("seed")), allowMissingColumns=True)
    on = Window.partitionBy(*KEY).orderBy("s").rangeBetween(0, GUARANTEE - 1)
    back = Window.partitionBy(*KEY).orderBy("e").rangeBetween(1 - GUARANTEE, 0)
    rows = rows.withColumns({"f": F.collect_list("h").over(on), "fp": F.max("pos").over(on), "fo": F.max("o").over(on), "fs": F.max("seed").over(on)})
    rows = rows.withColumns({"b": F.collect_list("h").over(back), "bp": F.min("pos").over(back), "bo": F.min("o").over(back), "bs": F.max("seed").over(back), "low": F.min("s").over(back)})
    rows = rows.where("seed = 0")
    after = rows.where((F.col("fs") == 1) & (F.col("s") + GUARANTEE <= F.col("words"))).select(*KEY, *_run_hash(F.col("f"), 0), F.col("pos").alias("p1"), F.col("fp").alias("p2"), F.col("o").alias("o1"), F.col("fo").alias("o2"))
    # one that its first line's own run reaches as well says nothing new
    before = rows.where((F.col("bs") == 1) & (F.col("e") >= GUARANTEE) & (F.col("s") - F.col("low") >= GUARANTEE)).select(*KEY, *_run_hash(F.col("b"), 2), F.col("bp").alias("p1"), F.col("pos").alias("p2"), F.col("bo").alias("o1"), F.col("o").alias("o2"))
    return after.unionByName(before)


def repeated_runs(docs: DataFrame) -> DataFrame:
    """kd, kt and `runs`: first and last place in the text of the runs of lines that an earlier place has."""
    lines = kept(hashed_lines(docs))
    marks = kept(fingerprints(lines))
    times = kept(marks.groupBy("g").agg(F.count("*").alias("times")).where("times > 1"))
    seeds = kept(joined_by_key(marks, times, ["g"], "times").select(*KEY, "pos", "s", "e").distinct())
    runs = kept(extended(lines, seeds))
    g = ["g0", "g1"]
    first = runs.groupBy(*g).agg(F.min(F.struct(*KEY, "p1")).alias("first"), F.count("*").alias("times")).where("times > 1")
    later = joined_by_key(runs, kept(first), g, "times").where(F.struct(*KEY, "p1") != F.col("first")).select(*KEY, "p1", "p2", "o1", "o2").distinct()
    by = Window.partitionBy(*KEY).orderBy("p1", "p2")
    reached = F.max("p2").over(by.rowsBetween(Window.unboundedPreceding, -1))
    later = later.withColumn("new", F.when(F.col("p1") <= reached + 1, 0).otherwise(1)).withColumn("island", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    islands = later.groupBy(*KEY, "island").agg(F.min("o1").alias("first"), F.max("o2").alias("last"))
    return islands.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("runs"))


def line_deduped(docs: DataFrame, removed: str | None = None) -> DataFrame:
    """docs with the later repeated runs deleted from text (and n_chars, if there, made right); removed: a column to add with the lines that went."""
    d, t, runs, gone = (fresh(docs, c) for c in ("run_doc", "run_text", "runs", "gone"))
    found = alone(docs.sparkSession, lambda: repeated_runs(docs)).select(F.col("kd").alias(d), F.col("kt").alias(t), F.col("runs").alias(runs))
    found = checked(found, 48 + 8 * F.size(runs))
    kd, kt = _key()
    lines = F.split("text", "\n")
    left = F.filter(lines, lambda _, i: ~F.exists(runs, lambda r: (r["first"] <= i) & (i <= r["last"])))
    df = docs.join(found, (kd == F.col(d)) & (kt == F.col(t)), "left")
    df = df.withColumn(gone, F.when(F.col(runs).isNotNull(), left))
    if removed:
        df = df.withColumn(removed, F.coalesce(F.size(lines) - F.size(gone), F.lit(0)).cast("long"))
    df = df.withColumn("text", F.when(F.col(runs).isNotNull(), F.array_join(gone, "\n")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        df = df.withColumn("n_chars", F.when(F.col(runs).isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return df.drop(d, t, runs, gone)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_deduped(table(spark, sf_dir, "documents").select("doc_id", "text"), "n_removed")


#: From the definition, without fingerprints, for unique ids: every shortest run of GUARANTEE words from a line on or up to a line, held against its first place.
OP1_SQL = f"""
WITH every AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS o FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
counted AS (SELECT doc_id, o, md5(line) AS h, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS n FROM every),
numbered AS (SELECT doc_id, o, h, n, row_number() OVER (PARTITION BY doc_id ORDER BY o) AS pos, (sum(n) OVER (PARTITION BY doc_id ORDER BY o))::BIGINT AS e, (sum(n) OVER (PARTITION BY doc_id))::BIGINT AS words FROM counted WHERE n > 0),
after AS (SELECT doc_id, pos AS p1, max(pos) OVER w AS p2, list(h) OVER w AS lines, e - n + {GUARANTEE} <= words AS fits FROM numbered WINDOW w AS (PARTITION BY doc_id ORDER BY e - n RANGE BETWEEN CURRENT ROW AND {GUARANTEE - 1} FOLLOWING)),
before AS (SELECT doc_id, min(pos) OVER w AS p1, pos AS p2, list(h) OVER w AS lines, e >= {GUARANTEE} AS fits FROM numbered WINDOW w AS (PARTITION BY doc_id ORDER BY e RANGE BETWEEN {GUARANTEE - 1} PRECEDING AND CURRENT ROW)),
runs AS (SELECT doc_id, p1, p2, row_number() OVER (PARTITION BY kind, lines ORDER BY doc_id, p1) AS place FROM (SELECT 1 AS kind, * FROM after WHERE fits UNION ALL SELECT 2, * FROM before WHERE fits)),
gone AS (SELECT DISTINCT n.doc_id, n.o FROM runs r JOIN numbered n ON n.doc_id = r.doc_id AND n.pos BETWEEN r.p1 AND r.p2 WHERE r.place > 1),
flagged AS (SELECT e.doc_id, e.o, e.line, CASE WHEN n.o IS NOT NULL THEN g.o IS NOT NULL END AS goes FROM every e LEFT JOIN numbered n USING (doc_id, o) LEFT JOIN gone g USING (doc_id, o)),
decided AS (SELECT doc_id, o, line, coalesce(goes, last_value(goes IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AND first_value(goes IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY o ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), false) AS goes FROM flagged),
rest AS (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY o) FILTER (WHERE NOT goes), '') AS text, count(*) FILTER (WHERE goes) AS n_removed FROM decided GROUP BY doc_id)
SELECT d.doc_id, r.text, coalesce(r.n_removed, 0) AS n_removed FROM documents d LEFT JOIN rest r USING (doc_id)
"""
