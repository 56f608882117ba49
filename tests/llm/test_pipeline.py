import corpus_pipeline
from pyspark.sql import functions as F

from tests.llm.helpers import docs, prose

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    base = prose(1, 300)
    rows = [(i, prose(10 + i, 200) + "\n" + prose(500 + i, 60), f"s{i % 3}") for i in range(30)]
    rows += [(100, base, "s0"), (101, base + " tail", "s1"), (102, "junk " * 300, "s0"), (103, "too short", "s1"), (104, None, None), (105, prose(7, 80) + "\n" + rows[3][1].split("\n")[1], "s2")]
    df = docs(spark, rows)
    (tmp_path / "sf").mkdir()
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "sf" / "labels.parquet"))
    left = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, df, str(tmp_path / "sf"))
        if k < 4:
            assert out.columns == df.columns
        out.write.parquet(str(tmp_path / str(k)))
        df = spark.read.parquet(str(tmp_path / str(k)))
        left[k] = {r.doc_id for r in df.select("doc_id").collect()}
    assert left[0] == {*range(30), 100, 101, 105} and left[1] == left[0] and left[2] == left[0] - {101}
    assert spark.read.parquet(str(tmp_path / "1")).where("doc_id = 105").first().text == rows[-1][1].split("\n")[0]
    assert left[3] == left[4] <= left[2]
    assert df.where(F.length("ids") != 4 * F.col("n_tokens")).count() == 0


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"] and out.count() > 100


def test_stages_take_odd_tables(spark, tmp_path):
    (tmp_path / "sf").mkdir()
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "sf" / "labels.parquet"))
    long = prose(1, 20_000)
    tables = {
        "empty": [],
        "null": [(None, None, None), (None, None, None), (1, None, "s")],
        "odd": [(1, long, "a"), (1, long, "a"), (2, long + " end", None), (None, prose(2, 60), "b"), (3, "", "b"), (4, prose(3, 40), "a"), (5, prose(3, 40), "b")],
    }
    want = {"empty": set(), "null": set(), "odd": {1, None, 4}}
    for name, rows in tables.items():
        df = docs(spark, rows).withColumns({"runs": F.lit("r"), "kept": F.lit(1), "taken_spans": F.lit("t"), "rank": F.lit(2), "key": F.lit("k"), "size": F.lit(3)})
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, df, str(tmp_path / "sf"))
            if k < 4:
                assert out.columns == df.columns
            out.write.parquet(str(tmp_path / f"{name}{k}"))
            df = spark.read.parquet(str(tmp_path / f"{name}{k}"))
        assert {r.doc_id for r in df.collect()} == want[name]


def test_near_dedup_after_line_dedup(spark):
    """What is left of a near copy whose repeated lines went is a text of its own: it is no longer a copy, and stays."""
    lines = [prose(i, 30) for i in range(6)]
    edited = [*lines[:5], "w " + lines[5]]
    first = {r.doc_id: r.text for r in corpus_pipeline.lines(spark, docs(spark, [(1, "\n".join(lines)), (2, "\n".join(edited))]), "").collect()}
    assert first == {1: "\n".join(lines), 2: edited[5]}
    assert {r.doc_id for r in corpus_pipeline.near(spark, docs(spark, list(first.items())), "").collect()} == {1, 2}
