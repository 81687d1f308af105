"""The manifest against a plain recursion over lists."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from sentrylake.llm import merkle

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, bucket long, digest string, leaf string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, source, lang, n, text):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n, text)])


def tree(digests):
    """(top, for each leaf its steps: (siblings before, siblings after))."""
    steps, own = [[] for _ in digests], [[i] for i in range(len(digests))]
    while len(digests) > 1:
        for at, members in enumerate(own):
            a = at - at % 3
            for i in members:
                steps[i].append((digests[a:at], digests[at + 1 : a + 3]))
        own = [sum(own[a : a + 3], []) for a in range(0, len(own), 3)]
        digests = [h(*digests[a : a + 3]) for a in range(0, len(digests), 3)]
    return digests[0], steps


def expected(rows):
    by = defaultdict(list)
    for doc_id, text, lang, source, n, *_ in rows:
        now = text.replace("\n", "") if text and doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0 else text
        by[source].append(((doc_id is not None, doc_id or 0), leaf(doc_id, source, lang, n, text), leaf(doc_id, source, lang, n, now), doc_id))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[1] for x in sorted(by[s], key=lambda x: x[:2])]) for s in names}
    root, over = tree([trees[s][0] for s in names])
    for s, outer in zip(names, over):
        for x, inner in zip(sorted(by[s], key=lambda x: x[:2]), trees[s][1]):
            f = x[2]
            for a, b in inner + outer:
                f = h(*a, f, *b)
            yield x[3], x[1], trees[s][0], root, h(*[d for a, b in inner + outer for d in a + b]), f, f == root


def rows_of(n, sources, r):
    out = []
    for i in range(n):
        text = r.choice([None, "", "plain text", "two\nlines\n", "naïve\nçafé " * r.randint(1, 50), "x" * 5000])
        out.append((i if i % 97 else (None if i else -5), text, r.choice(["en", None]), r.choice(sources), None if i % 11 == 0 else i, "k", 1, "d", "l"))
    return out + out[3:9] + [out[4][:1] + ("another text",) + out[4][2:]]


@pytest.mark.parametrize(("band", "n", "sources"), [(1, 60, ["a", "é", "Z", None, ""]), (2, 300, ["big", "big", "big", *[f"s{i}" for i in range(40)]]), (6, 900, ["one"]), (6, 9, ["a", "b", "c", "d"])])
def test_proofs(spark, band, n, sources):
    rows = rows_of(n, sources, random.Random(n))
    got = merkle.merkle_proofs(spark.createDataFrame(rows, DOCS).repartition(3), band).collect()
    key = lambda x: [str(v) for v in x]
    assert sorted((tuple(r)[:7] for r in got), key=key) == sorted(expected(rows), key=key)


def test_labels_are_nested_intervals(spark):
    docs = spark.createDataFrame(rows_of(900, ["a", "b", "b"], random.Random(1)), DOCS)
    made = merkle.Manifest(docs)
    nodes = made.nodes().collect()
    size = {r["key"]: r["n"] for r in made.trees.tops.collect()}
    for name, n in size.items():
        own = [r for r in nodes if r.source_key == name]
        while n > 1:
            n = -(-n // 3)
            level = min(r.level for r in own)
            assert sum(r.level == level for r in own) == n
            own = [r for r in own if r.level > level]
        assert not own
    ivs = [(r.lo, r.hi) for r in nodes]
    assert all(a <= c and d <= b or c <= a and b <= d or b <= c or d <= a for a, b in ivs[:200] for c, d in ivs[:200])


def test_empty_and_single(spark):
    assert merkle.merkle_proofs(spark.createDataFrame([], DOCS)).count() == 0
    r = merkle.merkle_proofs(spark.createDataFrame([(7, "a\nb", "en", None, 3, "k", 1, "d", "l")], DOCS)).collect()[0]
    own = leaf(7, None, "en", 3, "a\nb")
    assert (r.leaf, r.subroot, r.root, r.proof_sha256) == (own, own, own, h())
    assert r.verified == (zlib.crc32(b"7") % 2 == 1)
