"""The pipeline's stages and its registration."""

from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, sf).cache()
        assert after.columns == docs.columns, name
        if name != "mixing sources":
            assert after.count() <= before.count()
            assert after.select("doc_id").exceptAll(before.select("doc_id")).count() == 0
        before = after
    packed = corpus_pipeline.STAGES[-1][1](spark, before, sf)
    fill = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    assert fill.filter("n > 4096").count() == 0
    assert packed.filter("piece = 0").count() == before.count()


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_stages_on_nulls_repeats_and_long_texts(spark):
    """Each stage takes nulls in any column, empty and long texts and repeated rows; no row is made up."""
    sf = "/root/testdata/sf0.001"
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    long = " ".join(f"w{i}" for i in range(20000))
    texts = [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, None), (3, ""), (None, "x y z"), (5, long), (6, long)]
    table = [tuple({"doc_id": i, "text": t}.get(f.name) for f in schema) for i, t in texts]
    for docs in (spark.createDataFrame(table, schema), spark.createDataFrame([], schema)):
        rows = {(r.doc_id, r.text) for r in docs.collect()}
        for name, stage in corpus_pipeline.STAGES[:-1]:
            after = stage(spark, docs, sf)
            assert after.columns == docs.columns, name
            assert {(r.doc_id, r.text) for r in after.collect()} <= rows, name
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
        assert packed.filter("piece = 0").count() == docs.count()
