"""Roll-ups and projections of tasks, snapshots, files and blocks, and the checks around a trigger."""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numeric import clamp, severity
from tidemark.functions.status import reportable
from tidemark.functions.text import blank, code_key, issue_type, jaccard, json_string, text_key, word_set
from tidemark.operators.report import SCORES
from tidemark.shared import ranked
from tidemark.sources.views import RequestError

USAGE = ("llm_prompt_tokens", "llm_completion_tokens", "llm_total_tokens", "llm_reasoning_tokens", "llm_cached_tokens", "llm_elapsed_ms")
#: What a reviewer's comment needs, and which types it may have.
REQUIRED = ("description", "suggestion", "issue_line_numbers", "existing_code", "evidence")
TYPES = ("logic", "performance", "security", "readability", "code_style")


def usage(blocks: DataFrame, *keys: str) -> DataFrame:
    """Sums of the blocks' token counters, and model calls: rounds of a model that isn't `local`."""
    calls = F.size(F.filter("model_rounds", lambda r: r["model"] != "local"))
    return blocks.groupBy(*keys).agg(*(F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in USAGE if c in blocks.columns), F.sum(calls).alias("llm_call_count"))


def baseline(task: Column, blocks: Column) -> Column:
    """A counter's start: the task's own or its blocks' sum, whichever is larger."""
    return F.greatest(F.coalesce(task, F.lit(0)), F.coalesce(blocks, F.lit(0)))


def live_time(stored: Column, state: Column, started: Column, now: Column) -> Column:
    """Milliseconds spent, with the current run's so far while it runs."""
    run = F.timestamp_diff("MILLISECOND", started, now)
    return F.coalesce(stored, F.lit(0)) + F.when((state == 1) & started.isNotNull(), F.greatest(run, F.lit(0))).otherwise(F.lit(0))


def block_rows(files: DataFrame) -> DataFrame:
    """A report's rows of blocks: clamped scores, their mean, reportable issues alone."""
    b = files.select("task_id", "file_name", F.explode("code_blocks").alias("b"))
    scores = {s: clamp(F.col(f"b.{s}"), 0, 100, 0) for s in SCORES}
    total = sum((scores[s] for s in SCORES[1:]), scores[SCORES[0]])
    return b.select("task_id", "file_name", "b.block_id", *(c.cast("int").alias(s) for s, c in scores.items()), F.bround(total / len(SCORES), 0).cast("int").alias("overall"), F.filter("b.issues", lambda i: reportable(i["filter_status"])).alias("issues"))


def file_checkpoint(files: DataFrame) -> DataFrame:
    """A task's files, those reviewed and those incomplete, and blocks: the variant of a running review."""
    done = (F.col("state") == 2) | F.col("extra.status").isin("reviewed", "resumed")
    part = (F.col("state") == 3) | F.col("extra.status").isin("partial", "skipped_budget")
    return files.groupBy("task_id").agg(F.count("*").alias("files"), F.count_if(done).alias("reviewed"), F.count_if(part).alias("incomplete"), F.sum(F.size("code_blocks")).alias("blocks"))


def run_summary(files: DataFrame) -> DataFrame:
    """By file: issues, the highest severity (0 without), types, filtered ones, tools in use, and whether all blocks are done."""
    i = F.flatten(F.transform("code_blocks", lambda b: b["issues"]))
    tools = F.flatten(F.transform("code_blocks", lambda b: F.transform(b["tool_calls"], lambda t: t["tool_name"])))
    return files.select(
        "file_name",
        F.size(i).alias("issue_count"),
        F.coalesce(F.array_max(F.transform(i, lambda x: x["severity"])), F.lit(0)).alias("highest_severity"),
        F.array_sort(F.array_distinct(F.transform(i, lambda x: x["type"]))).alias("types"),
        F.size(F.filter(i, lambda x: ~reportable(x["filter_status"]))).alias("filtered_count"),
        F.array_sort(F.array_distinct(tools)).alias("tools"),
        ((F.size("code_blocks") > 0) & F.forall("code_blocks", lambda b: F.coalesce(b["main_task_completed"], F.lit(False)))).alias("complete"),
    )


def mail_address(owner: Column, domain: str) -> Column:
    """As it is with an at sign, else at the domain; null for a blank owner."""
    name = F.trim(owner)
    return F.when(name == "", None).when(F.contains(name, F.lit("@")), name).otherwise(F.concat(name, F.lit(f"@{domain}")))


def display_name(df: DataFrame, names: DataFrame, account: str) -> DataFrame:
    """df with display_name from names (account, name): the account itself where there is none."""
    n = names.select(F.col("account").alias("_account"), F.col("name").alias("_name"))
    return df.join(n, F.col(account) == F.col("_account"), "left").withColumn("display_name", F.coalesce("_name", account)).drop("_account", "_name")


def submission_key(project: Column, review: Column, base: Column) -> Column:
    """The digest of a comparison's identity as JSON with sorted keys."""
    base = F.when(blank(base), F.lit("0_version")).otherwise(F.trim(base))
    return F.sha2(F.concat(F.lit('{"copy_from_version": '), json_string(base), F.lit(', "project_id": '), json_string(F.trim(project)), F.lit(', "review_version": '), json_string(F.trim(review)), F.lit("}")), 256)


def checked_comments(comments: DataFrame) -> DataFrame:
    """comments with `error`: an unsupported type, or what is missing; null for one that is accepted, which has its fields made right."""
    kind = F.coalesce(F.nullif(F.col("type"), F.lit("")), F.lit("logic"))
    missing = F.array_compact(F.array(*(F.when(blank(F.col(c)), F.lit(c)) for c in REQUIRED)))
    error = F.when(~kind.isin(*TYPES), F.concat(F.lit("unsupported type: "), kind)).when(F.size(missing) > 0, F.concat(F.lit("missing required fields: "), F.array_join(missing, ", ")))
    return comments.withColumns({"error": error, "type": issue_type(kind), "severity": severity(F.col("severity"))})


def saved_feedback(kind: str, reason: str | None) -> dict:
    """A feedback row's two fields; a rejection without a reason is refused."""
    if kind not in ("agree", "reject") or (kind == "reject" and not (reason or "").strip()):
        raise RequestError("agree, or reject with a reason")
    return {"feedback_type": kind, "feedback_content": (reason or "").strip()}


def feedback_target(files: DataFrame, snapshots: DataFrame, file_id: str, block_id: int, issue_id: int) -> DataFrame:
    """The issue that feedback is for, among the files, else among the snapshots' files; the first match of each."""

    def of(df: DataFrame, place: int) -> DataFrame:
        b = F.get(F.filter("code_blocks", lambda x: x["block_id"] == block_id), 0)
        i = F.get(F.filter(b["issues"], lambda x: x["issue_id"] == issue_id), 0)
        return df.where(F.col("id") == file_id).select(F.lit(place).alias("place"), i.alias("issue")).where("issue is not null")

    return of(files, 0).unionByName(of(snapshots, 1)).orderBy("place").limit(1).select("issue.*")


def upserted(stored: DataFrame, rows: DataFrame, *keys: str) -> DataFrame:
    """stored with rows in place of those of the same keys, as one plan: written to a new version, never over what is read."""
    return stored.join(rows.select(*keys), list(keys), "left_anti").unionByName(rows, allowMissingColumns=True)


def merged_rules(base: dict, extra: dict) -> dict:
    """base with extra's values: lists are joined, dicts merged alike, the rest replaced; selectors stay."""
    out = json.loads(json.dumps(base))
    for k, v in extra.items():
        if k in ("language", "extensions", "pattern"):
            continue
        if isinstance(v, dict) and isinstance(out.get(k), dict):
            out[k] = merged_rules(out[k], v)
        else:
            out[k] = out[k] + v if isinstance(v, list) and isinstance(out.get(k), list) else v
    return out


def distinct_values(values: list) -> list:
    """The first of each value, compared as JSON."""
    return list({json.dumps(v, sort_keys=True): v for v in reversed(values)}.values())[::-1]


def inlined(related: DataFrame, budget: int = 12_000) -> DataFrame:
    """related (path, place, diff_text) with as much of each diff as the budget still holds, in order of place; `cut` marks the one that it ends in."""
    w = Window.partitionBy("path").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    left = F.greatest(F.lit(0), budget - F.coalesce(F.sum(F.length("diff_text")).over(w), F.lit(0))).cast("int")
    df = related.withColumn("left", left)
    return df.withColumns({"excerpt": F.left("diff_text", F.col("left")), "cut": (F.col("left") > 0) & (F.length("diff_text") > F.col("left"))}).drop("left")


def manifest(changes: DataFrame, most: int = 500) -> DataFrame:
    """By path, the other changed files as lines, at most so many. One array of all changes is made once, bounded by most + 1, and shared."""
    line = F.concat_ws(" ", "change_type", F.when(F.col("old_path").isNotNull() & (F.col("old_path") != F.col("path")), F.concat("old_path", F.lit(" -> "), "path")).otherwise(F.col("path")))
    first = changes.select("path", line.alias("line")).orderBy("path").limit(most + 1)
    every = F.broadcast(first.agg(F.array_sort(F.collect_list(F.struct("path", "line"))).alias("every"), F.lit(1).alias("one")))
    both = changes.select("path", F.lit(1).alias("one")).join(every, "one")
    others = F.filter("every", lambda x: x["path"] != F.col("path"))
    return both.select("path", F.transform(F.slice(others, 1, most), lambda x: x["line"]).alias("lines"), (F.size(others) > most - 1).alias("full"))


def safe_groups(issues: DataFrame) -> DataFrame:
    """group_id and whether its issues (group_id, place, type, severity, rule_id, existing_code, description) may be taken as one: two at least, of one type
    and severity, and one rule for all or one code with descriptions close to the first's."""
    g = issues.groupBy("group_id").agg(
        F.count("*").alias("n"),
        F.count_distinct(text_key(F.col("type"))).alias("types"),
        F.count_distinct("severity").alias("severities"),
        F.collect_set(F.coalesce("rule_id", F.lit(""))).alias("rules"),
        F.collect_set(code_key(F.col("existing_code"))).alias("codes"),
        F.array_sort(F.collect_list(F.struct("place", word_set(F.col("description")).alias("w")))).alias("d"),
    )
    rule = (F.size("rules") == 1) & ~F.array_contains("rules", "")
    close = F.forall(F.slice("d", 2, F.greatest(F.size("d") - 1, F.lit(1))), lambda x: jaccard(F.get(F.col("d"), 0)["w"], x["w"]) >= 0.75)
    same = (F.size("codes") == 1) & ~F.array_contains("codes", "") & close
    return g.select("group_id", ((F.col("n") > 1) & (F.col("types") == 1) & (F.col("severities") == 1) & (rule | same)).alias("safe"))


def exact_cover(groups: DataFrame, ids: DataFrame) -> DataFrame:
    """One row: whether groups (id) hold every id of ids once and nothing else."""
    both = groups.groupBy("id").agg(F.count("*").alias("n")).join(ids.select("id", F.lit(1).alias("known")).distinct(), "id", "full_outer")
    return both.agg((F.count_if(F.coalesce(F.col("n") != 1, F.lit(True)) | F.col("known").isNull()) == 0).alias("exact"))


def duplicate_groups(issues: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """issues with group_id (null alone; else numbered by where the group's first duplicate stands) and duplicate_of, the first one's id."""
    by = Window.partitionBy("_key").orderBy(*order)
    df = issues.withColumn("_key", key)
    df = df.withColumns({"_n": F.row_number().over(by), "_first": F.first("id").over(by)})
    seconds = df.where("_n = 2").select("_key", *order)
    numbers = ranked(seconds, *map(F.col, order), out="_rank").select("_key", (F.col("_rank") + 1).cast("int").alias("group_id"))
    return df.join(numbers, "_key", "left").withColumn("duplicate_of", F.when(F.col("_n") > 1, F.col("_first"))).drop("_key", "_n", "_first")


def kept_messages(messages: DataFrame, recent: int = 6, limit: int = 58_888, ratio: float = 0.6) -> DataFrame:
    """messages (conv_id, turn, role, text) with `tokens` of the conversation, `compress` past the soft limit, and `keep`: system, the first of the user, and the recent ones."""
    by = Window.partitionBy("conv_id")
    first = F.min(F.when(F.col("role") == "user", F.col("turn"))).over(by)
    tokens = F.greatest(F.lit(1), F.floor(F.sum(F.length(F.coalesce("text", F.lit("")))).over(by) / 4).cast("long"))
    back = F.row_number().over(by.orderBy(F.desc("turn")))
    df = messages.withColumns({"tokens": tokens, "keep": (F.col("role") == "system") | F.coalesce(F.col("turn") == first, F.lit(False)) | (back <= recent)})
    return df.withColumn("compress", F.col("tokens") > limit * ratio)


COMPRESSIONS = "conv_id long, turn long, round int, tokens long, trigger string, dropped int, tokens_after long, stopped boolean"


class _Context:
    """A conversation's messages as they are kept: the first two, a summary once there was a compression, and the rest, as (characters, whether a tool's)."""

    def __init__(self):
        self.head, self.rest, self.chars, self.summary, self.round, self.stopped = [], deque(), 0, 0, 0, False

    def tokens(self) -> int:
        return max(1, (sum(self.head) + self.summary + self.chars) // 4)

    def add(self, chars: int, tool: bool) -> None:
        if len(self.head) < 2:
            self.head.append(chars)
        else:
            self.rest.append((chars, tool))
            self.chars += chars

    def start(self, keep: int) -> int:
        """How many of the rest go: none if 0."""
        n = len(self.rest)
        s = max(0, n - keep)
        while s > 0 and self.rest[s][1]:
            s -= 1
        if s == 0 and n > 2:
            s = 1
            while s < n and self.rest[s][1]:
                s += 1
        return s

    def compress(self, s: int, summary: int) -> None:
        for _ in range(s):
            self.chars -= self.rest.popleft()[0]
        self.summary = summary


def compressions(messages: DataFrame, limit: int = 58_888, soft: float = 0.60, hard: float = 0.80, rounds: int = 4, recent: int = 6, summary: int = 500) -> DataFrame:
    """What happens before each of an assistant's turns (messages: conv_id, turn, role, text): the context's tokens, what triggers a compression (`token`, `round` or null), how many messages go
    into the summary, of `summary` characters, and the tokens then. From there the count begins anew; past the hard limit the conversation is stopped.

    Each compression depends on the ones before, so a conversation's turns are folded in order as they stream past; only what its context holds is kept.
    """
    at, end = int(max(1, limit) * min(0.95, max(0.10, soft))), int(limit * min(0.98, max(0.20, hard)))
    keep, names = max(2, recent), [c.split()[0] for c in COMPRESSIONS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, c = None, _Context()
        for b in batches:
            out = []
            for conv, turn, role, chars in zip(*(b.column(k).to_pylist() for k in ("conv_id", "turn", "role", "chars")), strict=True):
                if conv != of:
                    of, c = conv, _Context()
                if role == "assistant" and not c.stopped:
                    c.round += 1
                    tokens, gone = c.tokens(), 0
                    trigger = "token" if tokens >= at else "round" if rounds > 0 and c.round > rounds and (c.round - 1) % rounds == 0 else None
                    if trigger and c.rest:
                        gone = c.start(keep)
                        if gone:
                            c.compress(gone, summary)
                    c.stopped = 0 < end <= c.tokens()
                    out.append((conv, turn, c.round, tokens, trigger if gone else None, gone, c.tokens(), c.stopped))
                if not c.stopped:
                    c.add(chars, role == "tool")
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], schema=ARROW)

    ARROW = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("round", pa.int32()), ("tokens", pa.int64()), ("trigger", pa.string()), ("dropped", pa.int32()), ("tokens_after", pa.int64()), ("stopped", pa.bool_())])
    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("chars"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "chars").mapInArrow(run, COMPRESSIONS)


def with_background(files: DataFrame, backgrounds: DataFrame) -> DataFrame:
    """files with background and background_source, by base name in lower case from backgrounds (name, content): the provider's table, joined."""
    name = F.lower(F.element_at(F.split(F.replace(F.col("path"), F.lit("\\"), F.lit("/")), "/"), -1))
    b = backgrounds.select(F.col("name").alias("_name"), F.col("content").alias("_content"))
    out = files.join(b, name == F.col("_name"), "left").withColumn("background", F.coalesce("_content", F.lit("")))
    return out.withColumn("background_source", F.when(F.col("background") != "", "file-name").otherwise("")).drop("_name", "_content")
