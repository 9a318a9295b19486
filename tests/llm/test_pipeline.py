import corpus_pipeline
from waymark.llm import decontam, simhash
from waymark.storage import saved


def test_stages_take_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = saved(stage(spark, docs, sf), name)
        assert docs.columns == columns
        seen[name] = {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert seen["near_duplicates"] < seen["language"] and seen["decontaminate"] < seen["near_duplicates"] and seen["secrets"] == seen["decontaminate"]
    assert simhash.near_duplicates(docs).select("component_id").distinct().count() >= 0.99 * docs.count()
    assert decontam.leaks(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == seen["secrets"]


def test_empty_table(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
