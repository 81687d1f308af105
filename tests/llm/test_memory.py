"""What executors hold at a time: small batches on their way to workers, and no join done twice."""

import pyarrow as pa

from sentrylake.llm import debruijn, line_crf, packing, trie_join
from sentrylake.llm.text import BATCH_BYTES, READER_ROWS, SMALL_BATCH_BYTES


def largest_batch(docs):
    def measure(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes], pa.int64())], ["bytes"])

    return max(r.bytes for r in docs.select("doc_id", "text").mapInArrow(measure, "bytes long").collect())


def test_stages_send_small_batches(spark, tmp_path):
    text = " ".join(f"w{i}" for i in range(9000))
    spark.range(400).selectExpr("id doc_id", f"concat('{text} ', id) text").coalesce(1).write.parquet(f"{tmp_path}/documents")
    docs = spark.read.parquet(f"{tmp_path}/documents")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    row = len(text) + 64
    for stage, most in (
        (lambda: line_crf.score_quality(docs, labels), SMALL_BATCH_BYTES),
        (lambda: trie_join.jaccard_sets(docs.limit(3)), SMALL_BATCH_BYTES),
        (lambda: debruijn.repeated_spans(docs.limit(3)), SMALL_BATCH_BYTES),
        (lambda: packing.token_pieces(docs, ""), packing.BLOCK_BYTES),
    ):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
        spark.conf.unset("spark.sql.parquet.columnarReaderBatchSize")
        stage()
        assert largest_batch(docs) <= most + 2 * row
        assert spark.conf.get("spark.sql.parquet.columnarReaderBatchSize") == str(READER_ROWS)


def test_members_meet_their_components_once(spark, monkeypatch):
    """The join of every meeting point's members with components is written once and read from there."""
    plans, cut = [], trie_join.cut
    monkeypatch.setattr(trie_join, "cut", lambda df: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), cut(df))[1])
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(words[: 50 + i % 7] + [f"x{i}"])) for i in range(20)] + [(100 + i, f"only {i} a b c d e") for i in range(5)]
    got = {r.doc_id: r.component_id for r in trie_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).collect()}
    assert {got[i] for i in range(20)} == {0} and all(got[100 + i] == 100 + i for i in range(5))
    relations = [[line for line in p.splitlines() if "Relation [" in line] for p in plans]
    joined = [[r for r in rs if "key#" in r and "component#" not in r] for rs in relations if any("component#" in r and "key#" not in r for r in rs)]
    assert max(map(len, joined)) == 1
