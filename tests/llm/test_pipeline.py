"""The pipeline's stages against brute force on the small tables."""

import re

import corpus_pipeline
from reelframe.llm.registry import ORACLES, QUERIES


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir).cache()
        assert out.columns == names, name
        assert 0 < out.count() <= docs.count()
        before = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert {r["doc_id"] for r in out.select("doc_id").collect()} <= before
        docs = out
    bench = [re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", r["text"].lower()) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    windows = {tuple(w[i : i + 10]) for w in bench for i in range(len(w) - 9)}
    for r in docs.collect():
        w = re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", r["text"].lower())
        assert not any(tuple(w[i : i + 10]) in windows for i in range(len(w) - 9))
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).toPandas()
    assert set(packed["doc_id"]) == {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert packed.groupby("sequence_id")["length"].sum().max() <= 2048


def test_stages_take_odd_tables(spark, sf_dir, docs):
    clash = docs.withColumnsRenamed({"digest": "hit", "key": "score", "row": "toxicity_score", "id": "counts"}).selectExpr("*", "1 AS found", "2 AS n_lines", "3 AS n_kept", "4L AS n_chars")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, clash, sf_dir).columns == clash.columns, name
        assert stage(spark, clash, sf_dir).count() > 0, name
        assert stage(spark, clash.where("false"), sf_dir).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, clash.where("false"), sf_dir).count() == 0


def test_registered():
    import __spark_entry__ as entry

    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert set(ORACLES) <= set(entry.oracle_sql())
