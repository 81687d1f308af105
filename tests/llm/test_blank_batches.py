"""Every operator and stage on one-partition tables of null, empty, blank and very long texts."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from sentrylake.llm import byte_cnn, ctw, debruijn, divergence, line_crf, packing, trie_join
from sentrylake.llm.queries import tokenizer_path

BIG = " ".join(f"word{i % 977}{'é' if i % 5 else '.'}\n" for i in range(30_000))  # above a 256 KB slice
HUGE = " ".join(f"tok{i % 3001}" for i in range(1_100_000))  # above a 4 MB block
TABLES = {"null": [None], "empty": [""], "blank": ["  \n "], "null_big": [None, BIG], "big_null_big": [BIG, None, BIG]}


def table(spark, texts):
    schema = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").schema
    rows = [tuple({"doc_id": i, "text": t}.get(f.name) for f in schema) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, schema).coalesce(1)


def words(t):
    return re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())


def counted(t):
    w = words(t)
    tri = Counter(tuple(w[j : j + 3]) for j in range(len(w) - 2))
    hit = {j + d for j in range(len(w) - 2) if tri[tuple(w[j : j + 3])] > 1 for d in range(3)}
    lines = [x for x in (t or "").split("\n") if words(x)]
    return len(w), sum(len(x.decode()) for x in w), len(lines) - len(set(lines)), len(hit)


def packed_pieces(tok, texts):
    for i, t in enumerate(texts):
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        yield from ((i, p, s, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096].tobytes())) for p, s in enumerate(range(0, len(ids), 4096)))


@pytest.mark.parametrize("name", TABLES)
def test_counts_and_packing(spark, name):
    from tokenizers import Tokenizer

    docs, texts = table(spark, TABLES[name]), TABLES[name]
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) for r in divergence.quality_rules(docs).collect()}
    assert got == {i: counted(t) for i, t in enumerate(texts)}
    pieces = packing.pack_documents(docs, tokenizer_path()).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in pieces) == sorted(packed_pieces(Tokenizer.from_file(tokenizer_path()), texts))


def test_a_text_longer_than_a_block(spark):
    from tokenizers import Tokenizer

    docs = table(spark, [None, HUGE, ""])
    pieces = packing.token_pieces(docs, tokenizer_path()).collect()
    assert sorted(tuple(r) for r in pieces) == sorted(packed_pieces(Tokenizer.from_file(tokenizer_path()), [None, HUGE, ""]))
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_dup_lines) for r in divergence.quality_rules(docs).collect()}
    assert got == {0: (0, 0, 0), 1: (1_100_000, sum(map(len, words(HUGE))), 0), 2: (0, 0, 0)}


@pytest.mark.parametrize("name", ["blank", "big_null_big"])
def test_a_row_for_each_document(spark, name):
    docs, n = table(spark, TABLES[name]), len(TABLES[name])
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    for run in (line_crf.score_quality(docs, labels), debruijn.dedup_report(docs), ctw.score_texts(docs), trie_join.jaccard_components(docs), byte_cnn.identify_language(docs)):
        assert sorted(r.doc_id for r in run.select("doc_id").collect()) == list(range(n))


@pytest.mark.parametrize("name", ["null"])
def test_stages(spark, name):
    docs = table(spark, TABLES[name])
    rows = {(r.doc_id, r.text) for r in docs.collect()}
    for stage, f in corpus_pipeline.STAGES[:-1]:
        if stage != "substring dedup":  # changes texts
            assert {(r.doc_id, r.text) for r in f(spark, docs, "/root/testdata/sf0.001").collect()} <= rows, stage
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").filter("piece = 0").count() == docs.count()
