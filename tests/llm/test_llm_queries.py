"""Registered queries and the pipeline on the smallest tables."""

import __spark_entry__ as contract
import corpus_pipeline
from checks.compare import database, differences
from pulsemill.llm import decontaminate, simhash_dedup


def test_decontamination_equals_sql(spark, sf_dir):
    mine = contract.queries()["op4_decontamination"](spark, sf_dir).toPandas()
    assert differences(mine, database(sf_dir).execute(contract.oracle_sql()["op4_decontamination"]).df()) == ""


def test_every_operator_is_registered():
    names = contract.queries().keys()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names


def test_pipeline_stages_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    columns, ids = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, sf_dir).toArrow())
        ids.append({r.doc_id for r in docs.select("doc_id").collect()})
        if name == "SimHash near-dedup":
            found = simhash_dedup.near_components(docs)
            assert found.count() == found.select("component_id").distinct().count()
        if name == "benchmark decontamination":
            assert not decontaminate.decontaminate(docs, benchmark).where("contaminated").count()
        assert docs.columns[: len(columns)] == columns
    assert len(ids[0]) < 200 and ids[1] < ids[0] and ids[2] < ids[1] and ids[3] == ids[2] and ids[4] <= ids[3]
    assert docs.where("taken <= 0 OR taken > 2 * size").count() == 0
