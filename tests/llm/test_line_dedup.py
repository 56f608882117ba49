import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import docs, prose
from tidemark.llm import line_dedup

SF = "/root/testdata/sf0.001"


def test_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.sql(f"SELECT doc_id, text, n_removed FROM ({line_dedup.OP1_SQL})").fetchall()
    got = line_dedup.op1_line_dedup(spark, SF).select("doc_id", "text", "n_removed").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def brute(rows):
    """Texts without the lines that are in a run of GUARANTEE words which an earlier place has, by extending all pairs of equal lines."""
    texts = [(i, [x.strip() and x for x in t.split("\n")]) for i, t in sorted(rows)]
    worded = [(d, [(o, x, len(x.split())) for o, x in enumerate(lines) if x]) for d, (_, lines) in enumerate(texts)]
    gone = {d: set() for d in range(len(texts))}
    for d, a in worded:
        for e, b in worded[: d + 1]:
            for i in range(len(a)):
                for j in range(len(b) if e < d else i):
                    if (i and j and a[i - 1][1] == b[j - 1][1]) or a[i][1] != b[j][1]:
                        continue
                    n = 0
                    while i + n < len(a) and j + n < len(b) and a[i + n][1] == b[j + n][1]:
                        n += 1
                    if sum(x[2] for x in a[i : i + n]) >= line_dedup.GUARANTEE:
                        gone[d] |= set(range(i, i + n))
    out = {}
    for (d, a), (i, lines) in zip(worded, texts, strict=True):
        goes = {a[k][0] for k in gone[d]}
        places = [o for o, _, _ in a]
        for o, x in enumerate(lines):
            if not x and any(p < o for p in places) and any(p > o for p in places):
                goes |= {o} if max(p for p in places if p < o) in goes and min(p for p in places if p > o) in goes else set()
        out[i] = "\n".join(x for o, x in enumerate(lines) if o not in goes)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_all_repeated_runs_go(spark, seed):
    rng = random.Random(seed)
    words = [1, 2, 3, 7, 10, 12, 20, 30, 45, 60][:: 1 if seed < 3 else -1]
    pool = [prose(seed * 1000 + k, rng.choice(words)) for k in range(60)]
    passages = [[rng.choice(pool) for _ in range(rng.randrange(2, 12))] for _ in range(12)]
    rows = []
    for i in range(90):
        lines = []
        for _ in range(rng.randrange(1, 4)):
            part = rng.choice(passages)
            a = rng.randrange(len(part))
            lines += part[a : rng.randrange(a, len(part)) + 1] + [rng.choice(["", prose(rng.random(), 8)])] * rng.randrange(2)
        rows.append((i, "\n".join(lines)))
    rows += [(200, "\n".join([pool[0]] * 80)), (201, "\n\n".join(pool[:30])), (202, "\n".join(pool[:30]))]
    # A has the middle of a passage that B and C have whole
    middle = [prose(7000 + seed * 10 + k, 10) for k in range(7)]
    rows += [(300, "\n".join(middle[2:5])), (301, "\n".join(middle)), (302, prose(8, 9) + "\n" + "\n".join(middle))]
    # three texts share their first line, two the next one as well
    rows += [(310, pool[1] + "\n" + prose(11, 30)), (311, "\n".join([pool[1], middle[0], middle[1], pool[2]])), (312, "\n".join([pool[1], middle[0], middle[1], pool[2]]))]
    want = brute(rows)
    got = {r.doc_id: r.text for r in line_dedup.line_deduped(docs(spark, rows)).collect()}
    assert got == want and sum(want[i] != t for i, t in rows) > 20


def test_common_keys_are_broadcast(spark, monkeypatch):
    from tidemark.llm import common

    monkeypatch.setattr(common, "HOT", 3)
    rows = [(i, prose(1, 60) + "\n" + prose(100 + i, 20)) for i in range(30)] + [(50 + i, prose(200 + i % 4, 70)) for i in range(8)]
    assert {r.doc_id: r.text for r in line_dedup.line_deduped(docs(spark, rows)).collect()} == brute(rows)


def test_runs(spark):
    passage, own = prose(1, 60), [prose(10 + i, 30) for i in range(12)]
    half = [prose(30 + i, 20) for i in range(4)]  # a run of 80 words in four lines
    rows = [
        (1, "\n".join([own[0], passage, own[1]])),
        (2, "\n".join([own[2], passage, own[3]])),  # one long line
        (3, "\n".join([own[4], *half, own[5]])),
        (4, "\n".join([own[6], *half, own[7]])),  # several short lines
        (5, "\n".join([own[8], half[0], own[9]])),  # 20 words in common: too few
        (6, passage + "\n\n" + passage),  # inside one text; the first one is a repeat of text 1 as well
        (7, None),
        (8, ""),
        (9, "\n\n"),
        (10, passage),
    ]
    out = {r.doc_id: r for r in line_dedup.line_deduped(docs(spark, rows).withColumns({"runs": F.lit("x"), "gone": F.lit("y")}), "n_removed").collect()}
    assert out[1].text == rows[0][1] and out[2].text == "\n".join([own[2], own[3]]) and out[2].n_chars == len(out[2].text)
    assert out[3].text == rows[2][1] and out[4].text == "\n".join([own[6], own[7]]) and out[4].n_removed == 4
    assert out[5].text == rows[4][1]
    assert out[6].text == "" and out[10].text == "" and out[10].n_removed == 1
    assert out[7].text is None and out[7].n_removed == 0 and out[8].text == "" and out[9].text == "\n\n"
    assert out[1].runs == "x" and out[1].gone == "y"


def test_repeated_rows_and_empty_table(spark):
    passage = prose(2, 80)
    out = line_dedup.line_deduped(docs(spark, [(1, passage), (1, passage), (None, passage), (2, passage)]))
    assert sorted((str(r.doc_id), r.text) for r in out.collect()) == [("1", ""), ("1", ""), ("2", ""), ("None", passage)]
    assert line_dedup.line_deduped(docs(spark, [(1, passage), (1, passage)])).where("text = ''").count() == 0
    assert line_dedup.line_deduped(docs(spark, [])).count() == 0


def test_long_text(spark):
    lines = [prose(i, 12) for i in range(1500)]
    out = {r.doc_id: r.text for r in line_dedup.line_deduped(docs(spark, [(1, "\n".join(lines)), (2, "\n".join(lines[700:720]) + "\nmine")])).collect()}
    assert out[1] == "\n".join(lines) and out[2] == "mine"
