"""The corpus pipeline, stage by stage."""

import corpus_pipeline
from tamarack.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    junk = spark.createDataFrame([(10**6, None), (10**6 + 1, ""), (10**6 + 2, "12 34"), (10**6 + 3, "qzxv jkwq " * 40)], "doc_id bigint, text string").selectExpr("doc_id", "text", "'en' as lang", "'x' as source", "cast(0 as bigint) as n_chars")
    now = docs.unionByName(junk)
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, SF)
        out = spark.createDataFrame(out.collect(), out.schema)
        assert out.columns[:5] == docs.columns and (name == "sharding" or len(out.columns) == 5)
        counts.append(out.count())
        if name == "language_id":
            assert {r.doc_id for r in docs.collect()} >= {r.doc_id for r in out.collect()} and counts[0] >= docs.count() - 1
        now = out
    assert counts[0] > counts[1] > counts[2] and counts[3] == counts[4]


def test_run_on_nothing(spark, tmp_path):
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registered():
    assert sorted(QUERIES, key=lambda n: int(n[2:].split("_")[0])) == list(QUERIES) and len(QUERIES) == 10
    assert set(ORACLE_SQL) <= set(QUERIES)


def test_reruns_agree(spark):
    for name in ("op4_sharding", "op6_mixing"):
        one, two = (sorted(map(str, QUERIES[name](spark, SF).collect())) for _ in range(2))
        assert one == two
