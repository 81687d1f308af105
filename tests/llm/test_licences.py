"""Licence labels against a plain scan of every alignment."""

import math
import random
import re

from sentrylake.llm import licences as L

DOCS = "doc_id long, text string, label string, score double, word string"


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def stands(w, phrase):
    p = phrase.split()
    return [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]


def expected(texts):
    every = [words(t) for t in texts]
    weight = lambda x: 1 + round(1024 * math.log2((len(every) + 1) / (sum(x in w for w in map(set, every)) + 1)))
    weights = {x: weight(x) for t in L.TEMPLATES for x in t.words.split()}
    for w in every:
        base = [(i, label) for p, label in L.PHRASES.items() for i in stands(w, p)]
        labels, score = {label for _, label in base}, 1.0 if base else 0.0
        for t in L.TEMPLATES:
            tw = t.words.split()
            total = sum(weights[x] for x in tw)
            for b in range(-len(tw) + 1, len(w)):
                got = sum(weights[x] for i, x in enumerate(tw) if 0 <= b + i < len(w) and w[b + i] == x)
                near = lambda k, b=b, tw=tw, w=w: any(b - L.SLACK <= i and i + len(k.split()) <= b + len(tw) + L.SLACK for i in stands(w, k))
                if 100 * got >= L.LEAST_SHARE * total and all(map(near, t.keys)):
                    labels.add(t.label)
                    score = max(score, got / total)
        at = [i for i, _ in base]
        yield len(w), len(base), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), score


def some_texts():
    r = random.Random(4)
    noise = ["the", "of", "software", "license", "copy", "permission", "cc", "version", "straße", "x1", "and"]
    out = [None, "", " \n", "THE MIT LICENSE", "mit license mit license", "Licensed under CC BY-NC 4.0.", "apache\nlicense, version 2.0", "gnu general public licens", "license " * 400, "cc by", "mit", "license"]
    for t in L.TEMPLATES:
        w = t.words.split()
        out.append(" ".join(w).title() + ".")
        for rate in (0.1, 0.3):
            out.append("// ".join(x if r.random() > rate else r.choice(noise) for x in w))
        i = len(w) // 2
        out.append(" ".join(r.choices(noise, k=30) + w[:i] + ["inserted"] + w[i:] + r.choices(noise, k=9)))
    return out + [" ".join(r.choices(noise, k=200)) for _ in range(20)] + [" ".join(r.choices(noise, k=70_000)) + " released under the MIT License"] + out[3:6]


def test_labels(spark):
    texts = some_texts()
    docs = spark.createDataFrame([(i if i % 50 else None, t, "l", 0.0, "w") for i, t in enumerate(texts)], DOCS)
    for parts in (1, 5):
        got = L.scan_licences(docs.repartition(parts, "text")).collect()
        key = lambda x: [str(v) for v in x]
        short = [i for i, t in enumerate(texts) if len(t or "") < 100_000]
        want = list(expected(texts[: len(texts) - 4] + texts[-3:] + texts[-4:-3])) if parts == 1 else want  # noqa: F821
        assert len(got) == len(texts) and len(short) == len(texts) - 1
        assert sorted((tuple(r)[1:] for r in got), key=key) == sorted(want, key=key)


def test_edited_notices_are_found_and_plain_text_is_not(spark):
    mit = next(t.words for t in L.TEMPLATES if t.label == "mit" and len(t.words) > 100)
    plain = "She asked permission to copy the public notice and use the software of the library without charge under the conditions of the general agreement."
    docs = spark.createDataFrame([(1, mit.upper(), "", 0.0, ""), (2, plain, "", 0.0, ""), (3, mit.replace("merge", "unite"), "", 0.0, "")], DOCS)
    got = {r.doc_id: r.labels for r in L.scan_licences(docs).collect()}
    assert got == {1: "mit", 2: "", 3: "mit"}


def test_empty(spark):
    assert L.scan_licences(spark.createDataFrame([], DOCS)).count() == 0
