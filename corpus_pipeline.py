"""From raw documents to packed training sequences, as five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept;
all but the last return the columns of documents. run() writes each stage's rows as
Parquet to the folder that driver and executors share and reads them again.

Every stage takes nulls in any column, empty and long texts (read whole), rows that
repeat, extra columns of any name and empty tables; what each makes of them is said
with the operator's function that it calls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sentrylake.llm import debruijn, line_crf, mixing, packing, trie_join
from sentrylake.llm.queries import tokenizer_path
from sentrylake.llm.text import cut


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier doesn't reject."""
    return line_crf.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of least doc_id, of each group that the n-gram Jaccard join connects.

    Word shingles of five words and a similarity of 0.8 or more.
    """
    return trie_join.keep_one(docs, n=5, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without words of passages that also start earlier; those left empty go."""
    return debruijn.remove_repeats(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.repeat_copies(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their place in sequences of at most 4096 tokens."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("mixing sources", source_mix),
    ("best-fit packing", packed),
]

#: The classifier and the mix's roundings can't be said in SQL; tests hold all stages but the classifier's against plain Python, and its scores against a plain recursion.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
