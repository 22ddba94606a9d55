"""The pipeline's stages on a small corpus, each on what the one before kept."""

import os

import pytest

import corpus_pipeline
from grainfield.llm import decontaminate, simhash

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.exists(SF), reason="no test tables")
def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, SF).cache()
        assert 0 < docs.count() <= n, name
        n = docs.count()
        if k + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == columns, name
        if name == "near_duplicates":
            found = simhash.near_duplicates(docs)
            assert found.select("component_id").distinct().count() == n
        if name == "decontamination":
            assert decontaminate.hits(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).where("contaminated").count() == 0
    assert docs.where("decoded is distinct from text").count() == 0


def test_decontamination_takes_one_worker_a_task(spark):
    docs = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    benchmark = spark.createDataFrame([("a", "some words of an item"), ("b", "others")], "item_id string, text string")
    for part_bytes in (decontaminate.PART_BYTES, 8):  # one part of the benchmark, and several
        plan = decontaminate.remove(docs, benchmark, part_bytes=part_bytes)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow") == 1
