"""Repeated rows and many short lines: work in proportion, equal results."""

import hashlib
import math
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sentrylake.llm import debruijn, line_crf


def test_repeated_rows_share_a_list_of_spans(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(0, text)] + [(1, text)] * 2000 + [(2, "tail " + text)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    hit, _ = debruijn._with_spans(docs, 20)
    assert hit.agg(F.max(F.size("_spans"))).first()[0] <= 41
    occurrences = debruijn.repeated_spans(docs).withColumn("one", F.lit(1).cast("long")).drop("x")
    said = debruijn._said(docs, occurrences, 20)
    assert said.filter("doc_id = 1").count() <= 2000 * 41
    got = {(r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.n) for r in debruijn.dedup_report(docs).groupBy("doc_id", "n_words", "n_removed", "kept_sha256").agg(F.count("*").alias("n")).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == {(0, 60, 0, sha(text), 1), (1, 60, 60, sha(""), 2000), (2, 61, 60, sha("tail"), 1)}


def some_texts(r):
    line = lambda: " ".join("".join(r.choice(list("abz.#9A|é"), int(r.integers(1, 14)))) for _ in range(int(r.integers(0, 9))))
    return ["\n".join(line() for _ in range(int(r.integers(1, 40)))) for _ in range(60)] + ["", None, "\n\n", "one", "ends\n"]


def test_scores_in_blocks_are_those_of_all_features(monkeypatch):
    r = np.random.default_rng(4)
    texts = pa.array(some_texts(r), pa.string())
    w = r.normal(size=3 * line_crf.OWN + 1)
    x, length, counts = line_crf.line_features(texts)
    assert x.shape[1] == len(w)
    for most in (7, 64, 1 << 15):
        monkeypatch.setattr(line_crf._blocks, "__defaults__", (most,))
        node, own_length, own_counts = line_crf.node_scores(texts, w)
        assert np.allclose(node, x @ w, atol=1e-3) and (length == own_length).all() and (counts == own_counts).all()


def test_marginals_in_blocks(monkeypatch):
    r = np.random.default_rng(5)
    counts = np.array([1, 70, 3, 200, 1, 1, 40])
    node, trans = r.normal(size=counts.sum()) * 3, r.normal(size=(2, 2))
    want = line_crf.Chains(counts).marginals(node, trans)
    for block in (1, 2, 13, 64):
        got = line_crf.Chains(counts).marginals(node, trans, block=block)
        assert np.allclose(got[0], want[0]) and np.allclose(got[1], want[1])


def test_a_recursion_gives_the_same(spark):
    """Whole scores against a plain forward-backward for each document."""
    r = np.random.default_rng(6)
    texts, labels = some_texts(r)[:60], [int(i % 2) for i in range(60)]
    model = line_crf.train(texts, labels)
    node, length, counts = line_crf.node_scores(pa.array(texts, pa.string()), model.w)
    _, mean = model.quality(node, length, counts)
    t, at = np.exp(model.trans), 0
    for i, n in enumerate(counts):
        e = [(1 / (1 + math.exp(min(30, max(-30, x)))), 1 / (1 + math.exp(-min(30, max(-30, x))))) for x in node[at : at + n]]
        f = [e[0]]
        for k in range(1, n):
            v = [sum(f[-1][a] * t[a, b] for a in (0, 1)) * e[k][b] for b in (0, 1)]
            f.append([x / sum(v) for x in v])
        b = [(1.0, 1.0)]
        for k in range(n - 1, 0, -1):
            v = [sum(t[a, c] * e[k][c] * b[0][c] for c in (0, 1)) for a in (0, 1)]
            b.insert(0, [x / sum(v) for x in v])
        good = np.array([f[k][1] * b[k][1] / (f[k][0] * b[k][0] + f[k][1] * b[k][1]) for k in range(n)])
        weight = length[at : at + n] + 1e-6
        assert abs(mean[i] - (good * weight).sum() / weight.sum()) < 1e-9
        at += n


def test_a_million_line_ends_in_little_memory():
    text = pa.array(["ab c\n" * 500_000 + "\n" * 500_000])
    model = line_crf.LineCrf(3 * line_crf.OWN + 1)
    model.w = np.random.default_rng(1).normal(size=len(model.w))
    tracemalloc.start()
    node, length, counts = line_crf.node_scores(text, model.w)
    p, mean = model.quality(node, length, counts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(p) == 1_000_001 and 0 <= mean[0] <= 1 and peak < 200 << 20
