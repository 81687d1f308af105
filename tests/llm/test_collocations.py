"""Phrases against plain counting."""

import random
import re
from collections import Counter

import pytest

from sentrylake.llm import collocations as C

DOCS = "doc_id long, text string, lang string, word string, score double, n long, w1 long"


def expected(rows, least, report):
    f, n = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, 6) for i in range(len(w) - k + 1))
    cand = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    inside = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
    out = []
    for (lang, p), a in cand.items():
        if any(g == lang and len(q) > len(p) and b >= a and inside(p, q) for (g, q), b in cand.items()):
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.append((lang, -score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    out.sort()
    rank = Counter()
    for lang, score, a, p, l, r in out:  # noqa: E741
        rank[lang] += 1
        if rank[lang] <= report:
            yield lang, rank[lang], p.decode(), -a, l, r, n[lang], -score


def some_rows():
    r = random.Random(11)
    pool = ["the", "OF", "new", "york", "city", "straße", "x\x0by", "é"] + [f"w{i}" for i in range(40)]
    rows = []
    for i in range(150):
        parts = [" ".join(r.choices(pool, weights=[9, 9, 4, 4, 4, 2, 1, 1] + [1] * 40, k=r.randint(0, 30))) for _ in range(4)]
        parts.insert(r.randint(0, 4), r.choice(["new york city", "a b c d e f g", "ha ha ha ha ha ha", "New\tYork", ""]))
        rows.append((i, r.choice([". ", "\n", "  ", ", "]).join(parts), r.choice(["en", "en", "de", None, ""]), "w", 0.0, 1, 2))
    return rows + [(None, None, "en", "", 0.0, 1, 2), (5, "", None, "", 0.0, 1, 2), (6, " \n", "xx", "", 0.0, 1, 2), (7, "tick tock " * 20_000, "fr", "", 0.0, 1, 2)] + rows[:10]


@pytest.mark.parametrize(("least", "report"), [(8, 2000), (3, 7)])
def test_phrases(spark, least, report):
    rows = some_rows()
    got = C.mine_phrases(spark.createDataFrame(rows, DOCS).repartition(3), least, report).collect()
    want = sorted(expected(rows, least, report), key=str)
    assert len(want) > 20 and sorted((tuple(r) for r in got), key=str) == want


def test_products_beyond_64_bits(spark):
    """floor(1000 a n / (l r)) for counts that no small corpus reaches."""
    a, n, l, r = 123_456_789_012, 987_654_321_098_765, 123_456_789_013, 765_432_109_876  # noqa: E741
    got = spark.createDataFrame([(a, n, l, r)], "a long, n long, l long, r long").selectExpr(C.SCORE).first()[0]
    assert got == 1000 * a * n // (l * r)


def test_another_seed_where_keys_meet(spark, monkeypatch):
    """Keys that two words share are found and the next seed taken."""
    rows = some_rows()
    docs = spark.createDataFrame(rows, DOCS)
    plain = C.keyed
    coarse = lambda counts, seed: plain(counts, seed).selectExpr("lang", "word", "n", "w div 1000000000000000000 as w" if seed == 0 else "w")
    monkeypatch.setattr(C, "keyed", coarse)
    table, seed = C.frequent_words(docs.selectExpr("coalesce(lang, 'und') as lang", "coalesce(text, '') as text"), 8)
    assert seed == 1 and table.count() > 10


def test_empty(spark):
    assert C.mine_phrases(spark.createDataFrame([], DOCS)).count() == 0
