"""Answers of a model made fit to be stored, and what is sent to it: projections, guards and fingerprints around the stages that need one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numeric import clamp, severity
from tidemark.functions.status import reportable
from tidemark.functions.text import blank, issue_type, json_string, json_text
from tidemark.operators.report import SCORES

#: What a call about an issue is told, what one about its filtering is, and the reason that an unfounded filtering gets.
PAYLOAD = (
    "issue_id", "type", "severity", "description", "suggestion", "issue_line_numbers", "existing_code", "suggestion_code", "evidence", "rule_id", "evidence_match_status", "evidence_match_score", "evidence_start_line", "evidence_end_line",
    "evidence_occurrence_count", "evidence_source", "location_confidence", "location_ambiguous", "confidence_level", "original_issue_line_numbers", "relocation_status", "filter_status", "filter_counter_evidence",
)
FILTER_PAYLOAD = ("issue_id", "filter_status", "filter_reason", "evidence_match_status", "evidence_match_score", "confidence_level")
UNFOUNDED = "过滤结论缺少 diff 直接反证，按保守原则保留。"
TRUNCATED = "...<truncated>"
COMMENT = "type string, severity string, description string, suggestion string, issue_line_numbers string, existing_code string, suggestion_code string, evidence string, rule_id string, confidence_level double"


def payload(issues: DataFrame, fields: tuple[str, ...] = PAYLOAD) -> DataFrame:
    """issues with `payload`: those of the fields that they have, as JSON."""
    return issues.withColumn("payload", F.to_json(F.struct(*(c for c in fields if c in issues.columns)), {"ignoreNullFields": "false"}))


def confidence(c: Column, default: float = 0.8) -> Column:
    return clamp(c.try_cast("double"), 0.0, 1.0, default)


def comments_of(answers: DataFrame) -> DataFrame:
    """Comments (id and the fields of a comment) in answers (id, text): the JSON's list `issues`."""
    found = F.from_json(json_text(F.col("text")), f"issues array<struct<{COMMENT.replace(' ', ':').replace(',:', ', ')}>>")
    return answers.select("id", F.posexplode(found["issues"]).alias("place", "c")).where("c is not null").select("id", "place", "c.*")


def comments_taken(answers: DataFrame, accepted: DataFrame) -> DataFrame:
    """id and whether an answer counts: its list is empty, or one of its comments was accepted (id). No list, no answer."""
    listed = F.from_json(json_text(F.col("text")), "issues array<string>")["issues"]
    some = accepted.select("id", F.lit(True).alias("some")).distinct()
    return answers.select("id", listed.alias("l")).join(some, "id", "left").select("id", F.coalesce((F.size("l") == 0) | (F.col("l").isNotNull() & F.coalesce("some", F.lit(False))), F.lit(False)).alias("taken"))


def issues_of_comments(comments: DataFrame) -> DataFrame:
    """Comments (id, place, fields) as issues: numbered from 1 by place, with types, severities and confidences made right."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    fields = ("description", "suggestion", "issue_line_numbers", "existing_code", "suggestion_code", "evidence", "rule_id")
    number = (F.col("place") + 1).cast("int")
    return comments.select("id", number.alias("issue_id"), issue_type(F.col("type")).alias("type"), severity(F.col("severity")).alias("severity"), *(text(c).alias(c) for c in fields), number.alias("comment_line_number"), confidence(F.col("confidence_level")).alias("confidence_level"), text("issue_line_numbers").alias("original_issue_line_numbers"))


def plans(answers: DataFrame, most: int = 10) -> DataFrame:
    """Plans (id, JSON text) made fit: scores 80 unless given, within 0 to 100; at most so many checkpoints; risk medium unless named."""
    fields = ", ".join(f"{s}:string" for s in SCORES)
    p = F.from_json(json_text(F.col("text")), f"change_summary string, risk_level string, checkpoints array<string>, scores struct<{fields}>")
    scores = {s: F.least(F.lit(100), F.greatest(F.lit(0), F.coalesce(F.col(f"p.scores.{s}").try_cast("int"), F.lit(80)))) for s in SCORES}
    return answers.withColumn("p", p).select("id", F.coalesce("p.change_summary", F.lit("")).alias("change_summary"), F.coalesce(F.nullif("p.risk_level", F.lit("")), F.lit("medium")).alias("risk_level"), F.slice(F.coalesce("p.checkpoints", F.array().cast("array<string>")), 1, most).alias("checkpoints"), *(c.alias(s) for s, c in scores.items()))


def _said(rows: DataFrame, keys: list[str], last: tuple[str, ...], some: tuple[str, ...], graded: tuple[str, ...]) -> DataFrame:
    """One row for each key of answers that are taken in order of `place`, field by field: of `last` what the last answer says, of `some` the last text that isn't
    empty, of `graded` the last number. Answers may lack fields."""
    value = lambda c: F.col(c).cast("string") if c in rows.columns else F.lit(None).cast("string")
    number = lambda c: F.col(c).cast("string").try_cast("double") if c in rows.columns else F.lit(None).cast("double")
    latest = lambda v, holds: F.max_by(v, F.when(holds, F.col("place")))
    aggs = [latest(value(c), F.lit(True)).alias(f"r_{c}") for c in last]
    for c in some:
        filled = F.coalesce(value(c), F.lit("")) != ""
        aggs += [latest(value(c), filled).alias(f"r_{c}"), F.min_by(value(c), F.when(filled, F.col("place"))).alias(f"r_first_{c}"), F.min(F.when(filled, F.col("place"))).alias(f"r_at_{c}")]
    aggs += [latest(F.greatest(F.lit(0.0), F.least(F.lit(1.0), number(c))), number(c).isNotNull() & ~F.isnan(number(c))).alias(f"r_{c}") for c in graded]
    return rows.groupBy(*keys).agg(*aggs, F.max("place").alias("r_last_place"), F.lit(True).alias("_hit"))


GRADES = ("evidence_match_score", "confidence_level")


def _applied(issues: DataFrame, said: DataFrame, keys: list[str]):
    """issues with their answers' fields, whether there are any, and what an issue had."""
    out = issues.join(said, keys, "left")
    old = lambda c, kind="string": F.col(c).cast(kind) if c in issues.columns else F.lit(None).cast(kind)
    hit = F.coalesce("_hit", F.lit(False))
    evidence = {"evidence_match_status": F.when(hit, F.coalesce("r_evidence_match_status", old("evidence_match_status"), F.lit(""))).otherwise(old("evidence_match_status"))}
    evidence |= {c: F.coalesce(F.col(f"r_{c}"), old(c, "double")) for c in GRADES}
    return out, hit, old, evidence


def filter_applied(issues: DataFrame, decisions: DataFrame) -> DataFrame:
    """issues (path, issue_id, ...) after decisions (path, issue_id, place, filter_status, filter_reason, counter_evidence, and what they say of the evidence) by issue, in order.

    An issue is only filtered against evidence; without it, it is kept, and the reason says so. Unknown issues are passed over.
    """
    keys = ["path", "issue_id"]
    said = _said(decisions, keys, ("filter_status", "filter_reason", "counter_evidence"), ("evidence_match_status",), GRADES)
    out, hit, old, evidence = _applied(issues, said, keys)
    counter = F.trim(F.coalesce("r_counter_evidence", F.lit("")))
    wanted = F.lower(F.coalesce(F.nullif("r_filter_status", F.lit("")), F.lit("kept")))
    unfounded = (wanted == "filtered") & (counter == "")
    status = F.when(~unfounded & wanted.isin("kept", "filtered"), wanted).otherwise("kept")
    reason = F.when(unfounded, F.lit(UNFOUNDED)).otherwise(F.coalesce("r_filter_reason", F.lit("")))
    new = {"filter_status": status, "filter_reason": reason, "filter_counter_evidence": counter}
    out = out.withColumns({c: F.when(hit, v).otherwise(old(c)) for c, v in new.items()} | evidence)
    out = out.withColumns({"re_review_status": F.when(hit, F.when(reportable(F.col("filter_status")), 0).otherwise(1)).otherwise(old("re_review_status", "int")), "re_review_description": F.when(hit, F.col("filter_reason")).otherwise(old("re_review_description"))})
    return out.drop("_hit", *(c for c in out.columns if c.startswith("r_")))


def relocation_applied(issues: DataFrame, answers: DataFrame) -> DataFrame:
    """issues (path, issue_id, issue_line_numbers, existing_code, ...) after answers (path, issue_id, place, issue_line_numbers, existing_code, relocation_status, relocation_description, and what they say
    of the evidence), one after another: lines and code change where an answer has some, the lines from before the first that found any are kept as the original ones."""
    keys = ["path", "issue_id"]
    said = _said(answers, keys, ("relocation_status", "relocation_description"), ("issue_line_numbers", "existing_code", "evidence_match_status"), GRADES)
    out, hit, old, evidence = _applied(issues, said, keys)
    filled = lambda c: F.nullif(c, F.lit(""))
    status = F.coalesce(filled(F.col("r_relocation_status")), F.lit("unchanged"))
    # without lines of its own, an issue's original ones are those of an answer that others follow
    followed = F.when(F.col("r_at_issue_line_numbers") < F.col("r_last_place"), F.col("r_first_issue_line_numbers"))
    description = F.coalesce("r_relocation_description", F.lit(""))
    values = {
        "original_issue_line_numbers": F.when(hit, F.coalesce(filled(old("original_issue_line_numbers")), filled(F.col("issue_line_numbers")), followed, F.lit(""))).otherwise(old("original_issue_line_numbers")),
        "issue_line_numbers": F.when(hit, F.coalesce("r_issue_line_numbers", F.col("issue_line_numbers"), F.lit(""))).otherwise(F.col("issue_line_numbers")),
        "existing_code": F.coalesce("r_existing_code", F.col("existing_code")),
        "relocation_status": F.when(hit, status).otherwise(old("relocation_status")),
        "relocation_description": F.when(hit, description).otherwise(old("relocation_description")),
        "re_review_status": F.when(hit, F.when(status == "failed", 1).otherwise(0)).otherwise(old("re_review_status", "int")),
        "re_review_description": F.when(hit, description).otherwise(old("re_review_description")),
    }
    return out.withColumns(values | evidence).drop("_hit", *(c for c in out.columns if c.startswith("r_")))


def message_summary(content: Column, tool_names: Column, most: int = 1200) -> Column:
    """An assistant's message as JSON: its content, cut, how many tools it called, and their names."""
    text = F.coalesce(content, F.lit(""))
    cut = F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most - 20)), F.lit(TRUNCATED))).otherwise(text)
    names = F.coalesce(tool_names, F.array().cast("array<string>"))
    listed = F.array_join(F.transform(F.filter(names, lambda n: F.coalesce(n, F.lit("")) != ""), json_string), ", ")
    return F.concat(F.lit('{"content": '), json_string(cut), F.lit(', "tool_call_count": '), F.size(names).cast("string"), F.lit(', "tool_names": ['), listed, F.lit("]}"))


def fingerprint(**parts: Column) -> Column:
    """A digest of what a review depends on: parts by name, nulls told from empty texts. Good for equality alone."""
    return F.sha2(F.to_json(F.struct(*(parts[k].alias(k) for k in sorted(parts))), {"ignoreNullFields": "false"}), 256)


def accepted(comments: DataFrame) -> DataFrame:
    """Comments without an `error`, with no required field blank."""
    return comments.where(F.col("error").isNull() & ~blank(F.col("description")))
