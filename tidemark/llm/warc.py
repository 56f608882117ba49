"""Operator 7: WARC derivatives. Each response becomes a metadata record (title, links, sizes, the source's HTTP status and
headers, as JSON) and a plain-text conversion record, linked to it.

A derived record names the response in WARC-Refers-To, keeps its target, date and payload digest, and has an id made
from its own type and the response's id, so reruns give the same records. Everything is a projection in built-in
expressions: no shuffle, and a page never meets another one.

Cases: a null page is an empty response; a null URL leaves the target out; equal rows give equal records; unclosed
comments, scripts and styles reach to the end; unknown entities stay as they are; line ends in a URL are
percent-encoded, so they can't end a header; a very long page is one record; an empty table gives an empty result; extra columns,
whatever their names, are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import let, table

DATE = "2026-01-01T00:00:00Z"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"

#: The letters of base 32, tags that end a line, elements without text, and named entities.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
BLOCKS = "address|article|aside|blockquote|br|dd|div|dl|dt|figcaption|figure|footer|form|h1|h2|h3|h4|h5|h6|header|hr|li|main|nav|ol|option|p|pre|section|table|td|th|tr|ul"
SILENT = ("head", "script", "style", "noscript", "template")
ENTITIES = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "copy": "©", "reg": "®", "trade": "™", "middot": "·", "bull": "•", "hellip": "…", "ndash": "–", "mdash": "—", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "laquo": "«", "raquo": "»", "euro": "€", "pound": "£", "deg": "°", "times": "×"}

SILENCED = r"(?is)<(?:!--.*?(?:-->|\z)|" + "|".join(rf"{t}(?:\s[^>]*)?>.*?(?:</{t}\s*>|\z)" for t in SILENT) + ")"
BREAK = rf"(?i)</?(?:{BLOCKS})(?:\s[^>]*)?/?>"
TAG = r"<[/!?]?[a-zA-Z][^>]*>"
TITLE = r"(?is)<title(?:\s[^>]*)?>(.*?)</title\s*>"
LINK = r"""(?i)<a\s(?:[^>]*?\s)?href\s*=\s*["']([^"'>]*)["']"""


def sha1_base32(data: Column) -> Column:
    """The digest as WARC writes it: 160 bits, 20 at a time, as 32 letters."""
    letters = lambda v: F.concat(*(F.substring(F.lit(BASE32), F.shiftright(v, 15 - 5 * k).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for k in range(4)))
    return let(F.sha1(data), lambda h: F.concat(F.lit("sha1:"), *(let(F.conv(F.substring(h, i * 5 + 1, 5), 16, 10).cast("int"), letters) for i in range(8))))


def record_id(*parts: Column) -> Column:
    return let(F.md5(F.concat_ws("|", *parts).cast("binary")), lambda h: F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), *(F.concat(F.lit("-"), F.substring(h, a, n)) for a, n in ((9, 4), (13, 4), (17, 4), (21, 12))), F.lit(">")))


def unescaped(t: Column) -> Column:
    """Numeric references and the named ones above, by what follows an ampersand; &amp; itself last, so that it is read once."""
    named = F.create_map(*(F.lit(x) for kv in ENTITIES.items() for x in kv))
    fine = lambda n: n.between(1, 0xD7FF) | n.between(0xE000, 0x10FFFF)
    char = lambda n: F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    point = lambda k: F.when(k.rlike("^#[0-9]{1,7}$"), F.substring(k, F.lit(2), F.lit(7)).try_cast("int")).when(k.rlike("^#[xX][0-9a-fA-F]{1,6}$"), F.conv(F.substring(k, F.lit(3), F.lit(6)), 16, 10).try_cast("int"))
    value = lambda k: F.coalesce(F.try_element_at(named, k), let(point(k), lambda n: F.when(n == 38, "&amp;").when(fine(n), char(n))))
    after = lambda x, k: F.substring(x, F.length(k) + 2, F.length(x))
    one = lambda x: let(F.substring_index(x, ";", 1), lambda k: F.when(F.length(k).between(2, 9) & (F.length(k) < F.length(x)), F.coalesce(F.concat(value(k), after(x, k)), F.concat(F.lit("&"), x))).otherwise(F.concat(F.lit("&"), x)))
    return F.replace(F.array_join(F.transform(F.split(t, "&(?!amp;)"), lambda x, i: F.when(i == 0, x).otherwise(one(x))), ""), F.lit("&amp;"), F.lit("&"))


def plain_text(html: Column) -> Column:
    t = F.regexp_replace(F.regexp_replace(html, SILENCED, ""), r"[\t\n\x0B\f\r]", " ")
    t = unescaped(F.regexp_replace(F.regexp_replace(t, BREAK, "\n"), TAG, ""))
    return F.btrim(F.regexp_replace(F.regexp_replace(t, "[ \u00a0]{2,}|\u00a0", " "), " ?\n[ \n]*", "\n"), F.lit(" \n"))


def responses(pages: DataFrame) -> DataFrame:
    """Pages as WARC response records: id, target, date, block (HTTP head and body) and digests."""
    df = pages.select("page_id", F.col("url").alias("target_uri"), F.coalesce("html", F.lit("")).alias("html"))
    df = df.withColumn("payload_digest", sha1_base32(F.encode("html", "UTF-8")))
    return df.withColumns({"record_id": record_id(F.lit("response"), F.col("page_id").cast("string"), F.col("target_uri"), F.col("payload_digest")), "warc_date": F.lit(DATE), "block": F.concat(F.lit(HTTP), F.col("html"))})


def derivatives(found: DataFrame) -> DataFrame:
    """Two records for each response: metadata, then conversion."""
    df = found.withColumns(
        {
            "text": plain_text(F.col("html")),
            "title": F.btrim(F.regexp_replace(unescaped(F.regexp_extract("html", TITLE, 1)), r"[\t\n\x0B\f\r ]+", " "), F.lit(" ")),
            "links": F.transform(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)), unescaped),
        }
    )
    head = F.split(F.substring_index("block", "\r\n\r\n", 1), "\r\n")
    headers = F.map_from_entries(F.transform(F.slice(head, 2, F.size(head)), lambda x: F.struct(F.substring_index(x, ":", 1), F.trim(F.substring(x, F.locate(":", x) + 1, F.length(x))))))
    status = F.regexp_extract(head[0], r"^HTTP/\S+ (\d+)", 1).try_cast("int")
    meta = F.to_json(F.struct("title", F.col("links"), F.octet_length("html").alias("html_bytes"), F.octet_length("text").alias("text_bytes"), status.alias("http_status"), headers.alias("http_headers")))
    each = F.explode(F.array(F.struct(F.lit("metadata").alias("record_type"), F.lit("application/json").alias("content_type"), meta.alias("block")), F.struct(F.lit("conversion").alias("record_type"), F.lit("text/plain").alias("content_type"), F.col("text").alias("block"))))
    df = df.select("page_id", F.col("record_id").alias("refers_to"), "target_uri", "warc_date", F.col("payload_digest").alias("source_digest"), each.alias("r")).select("*", "r.*").drop("r")
    return df.withColumns({"record_id": record_id(F.col("record_type"), F.col("refers_to")), "content_length": F.octet_length("block").cast("long"), "block_digest": sha1_base32(F.encode("block", "UTF-8"))})


def as_warc() -> Column:
    """A derived record in the file format, without the two line ends that follow it."""
    head = {"WARC-Type": "record_type", "WARC-Record-ID": "record_id", "WARC-Refers-To": "refers_to", "WARC-Refers-To-Target-URI": "target_uri", "WARC-Refers-To-Date": "warc_date", "WARC-Target-URI": "target_uri", "WARC-Date": "warc_date", "WARC-Source-Payload-Digest": "source_digest", "WARC-Block-Digest": "block_digest", "Content-Type": "content_type", "Content-Length": "content_length"}
    value = lambda c: F.replace(F.replace(F.col(c).cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.concat(F.lit("WARC/1.1\r\n"), F.concat_ws("\r\n", *(F.concat(F.lit(f"{k}: "), value(c)) for k, c in head.items())), F.lit("\r\n\r\n"), F.col("block"))


def write_warc(records: DataFrame, path: str) -> None:
    """Compressed WARC files, one for each task: the text writer, with WARC's end of record as its line end."""
    records.select(as_warc().alias("value")).write.option("compression", "gzip").option("lineSep", "\r\n\r\n").text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files: `headers` (a map) and `block`. `whole` is false where a block holds a record's first line."""
    raw = spark.read.option("lineSep", "WARC/1.1\r\n").text(path).where(F.length("value") > 0)
    at = F.locate("\r\n\r\n", F.col("value"))
    pairs = F.transform(F.split(F.substring(F.col("value"), F.lit(1), at - 1), "\r\n"), lambda x: F.struct(F.substring_index(x, ": ", 1), F.substring(x, F.locate(": ", x) + 2, F.length(x))))
    df = raw.select(F.map_from_entries(pairs).alias("headers"), F.substring(F.col("value"), at + 4, F.length("value") - at - 7).alias("block"))
    return df.withColumn("whole", F.octet_length("block") == F.col("headers")["Content-Length"].cast("long"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derivatives(responses(table(spark, sf_dir, "pages")))


def _sql_unescaped(c: str) -> str:
    k = "string_split(x, ';')[1]"
    point = rf"CASE WHEN regexp_matches({k}, '^#[0-9]{{1,7}}$') THEN try_cast(substr({k}, 2) AS INT) WHEN regexp_matches({k}, '^#[xX][0-9a-fA-F]{{1,6}}$') THEN try_cast('0x' || substr({k}, 3) AS INT) END"
    fine = f"({point} BETWEEN 1 AND 55295 OR {point} BETWEEN 57344 AND 1114111)"
    named = " ".join(f"WHEN {_quoted(n)} THEN {_quoted(to)}" for n, to in (ENTITIES | {"amp": "&"}).items())
    value = f"CASE {k} {named} ELSE CASE WHEN {fine} THEN chr({point}) END END"
    one = f"CASE WHEN length({k}) BETWEEN 2 AND 9 AND length({k}) < length(x) THEN coalesce({value} || substr(x, length({k}) + 2), '&' || x) ELSE '&' || x END"
    return f"array_to_string(list_transform(string_split({c}, '&'), lambda x, i: CASE WHEN i = 1 THEN x ELSE {one} END), '')"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql_text(c: str) -> str:
    c = rf"regexp_replace(regexp_replace({c}, {_quoted(SILENCED)}, '', 'g'), '[\t\n\x0B\f\r]', ' ', 'g')"
    c = f"regexp_replace(regexp_replace({c}, {_quoted(BREAK)}, chr(10), 'g'), {_quoted(TAG)}, '', 'g')"
    return rf"trim(regexp_replace(regexp_replace({_sql_unescaped(c)}, '[ \x{{a0}}]{{2,}}|\x{{a0}}', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), ' ' || chr(10))"


def _sql_digest(c: str) -> str:
    return f"'sha1:' || array_to_string(list_transform(range(32), lambda i: substr('{BASE32}', (((('0x' || substr(sha1({c}), (i // 4) * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1), 1)), '')"


def _sql_id(c: str) -> str:
    return "'<urn:uuid:' || " + " || '-' || ".join(f"substr(md5({c}), {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) + " || '>'"


#: The same for DuckDB.
OP7_SQL = rf"""
WITH p AS (SELECT page_id, url AS target_uri, coalesce(html, '') AS html FROM pages),
d AS (SELECT *, {_sql_digest('html')} AS source_digest FROM p),
r AS (SELECT *, {_sql_id("concat_ws('|', 'response', page_id::VARCHAR, target_uri, source_digest)")} AS refers_to FROM d),
t AS (SELECT *, {_sql_text('html')} AS text,
    trim(regexp_replace({_sql_unescaped(f"coalesce(regexp_extract(html, {_quoted(TITLE)}, 1), '')")}, '[\t\n\x0B\f\r ]+', ' ', 'g'), ' ') AS title,
    list_transform(regexp_extract_all(html, {_quoted(LINK)}, 1), lambda u: {_sql_unescaped('u')}) AS links FROM r),
b AS (SELECT *, 'metadata' AS record_type, 'application/json' AS content_type,
    to_json({{'title': title, 'links': links, 'html_bytes': strlen(html), 'text_bytes': strlen(text), 'http_status': 200, 'http_headers': {{'Content-Type': 'text/html; charset=utf-8'}}}})::VARCHAR AS block FROM t
  UNION ALL SELECT *, 'conversion', 'text/plain', text FROM t)
SELECT page_id, refers_to, target_uri, '{DATE}' AS warc_date, source_digest, record_type, content_type, block,
    {_sql_id("concat_ws('|', record_type, refers_to)")} AS record_id, strlen(block)::BIGINT AS content_length, {_sql_digest('block')} AS block_digest
FROM b
"""
