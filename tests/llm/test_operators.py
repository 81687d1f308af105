"""Each operator against brute force, on a small table with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sentrylake.llm import byte_cnn, ctw, debruijn, divergence, line_crf, mixing, packing, topk, trie_join, url_filter
from sentrylake.llm.queries import tokenizer_path

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, _text string, block string, target string"


def rng_words(r, n, pool=400):
    return [f"w{int(x)}é" if x % 7 == 0 else f"Wo{int(x)}" for x in r.integers(0, pool, n)]


def texts():
    r = np.random.default_rng(3)
    base = [rng_words(r, int(n)) for n in r.integers(1, 300, 30)]
    out = [" ".join(b) for b in base]
    out += [out[5], out[5], out[7] + " tail end", "head " + out[7]]
    cut = base[9][:]
    cut[3] = "changed"
    out += [" ".join(cut), "\n".join(base[11]), " \t".join(base[11][:40] + base[12][:60])]
    out += ["a b " * 40, "x\n" * 30, "", None, "   \n", "one", "two three", " ".join(rng_words(r, 9000))]
    return out


@pytest.fixture(scope="module")
def rows():
    t = texts()
    return [(i, x, ("en", "de", None)[i % 3], None if i % 5 == 4 else f"s{i % 4 if i % 3 else 0}", len(x or ""), 1, 0.5, "z", "q", None) for i, x in enumerate(t)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def words(t):
    return WORD.findall((t or "").encode())


def test_divergence(docs, rows, empty, spark):
    got = {r.doc_id: r for r in divergence.quality_rules(docs).collect()}
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        w, g = words(t), got[i]
        tri = Counter(tuple(w[j : j + 3]) for j in range(len(w) - 2))
        hit = {j + d for j in range(len(w) - 2) if tri[tuple(w[j : j + 3])] > 1 for d in range(3)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == (
            len(w), sum(len(x.decode()) for x in w), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(hit),
        )
        assert g.base_failed == (len(w) < 50 or 100 * len(hit) > 50 * len(w)) and not (g.kept and g.base_failed)
    assert divergence.quality_rules(empty).count() == 0
    p, q = np.array([[1.0, 1, 0]]), np.array([[1.0, 0, 1], [2, 2, 0]])
    assert np.allclose(divergence.js_distance(p, q), [[math.sqrt(0.5), 0]])


def junk(r, i):
    w = rng_words(r, 80)
    return " ".join(w) if i % 3 else " | ".join(w)


def test_line_crf(spark, docs, empty):
    r = np.random.default_rng(5)
    df = spark.createDataFrame([(i, junk(r, i)) for i in range(200)] + [(900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(200)] + [(5000, 1, 0)], "doc_id long, quality int, toxic int")
    got = line_crf.score_quality(df, labels).collect()
    assert len(got) == 202 and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.3) for x in got)
    held = [x for x in got if x.held_out and x.doc_id < 200]
    assert {x.doc_id for x in held} == {i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(x.predicted == int(x.doc_id % 3 != 0) for x in held) >= 0.95 * len(held)
    kept = line_crf.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert line_crf.score_quality(empty, labels).count() == 0 and line_crf.score_quality(docs, labels.limit(0)).filter("score = 0.5").count() == docs.count()


def test_crf_marginals_by_enumeration():
    r = np.random.default_rng(1)
    node, trans, counts = r.normal(size=7), r.normal(size=(2, 2)), np.array([3, 4])
    p, pairs = line_crf.Chains(counts).marginals(node, trans)
    want, total = np.zeros(7), np.zeros((2, 2))
    for at, n in ((0, 3), (3, 4)):
        z, own, both = 0.0, np.zeros(n), np.zeros((2, 2))
        for m in range(2**n):
            y = [(m >> j) & 1 for j in range(n)]
            s = math.exp(sum(node[at + j] * y[j] for j in range(n)) + sum(trans[a, b] for a, b in zip(y, y[1:])))
            z += s
            own += s * np.array(y)
            for a, b in zip(y, y[1:]):
                both[a, b] += s
        want[at : at + n], total = own / z, total + both / z
    assert np.allclose(p, want) and np.allclose(pairs, total)


def test_packing(docs, rows, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    got = packing.pack_documents(docs, tokenizer_path()).collect()
    want = []
    for i, t, *_ in rows:
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        want += [(i, p, s, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096].tobytes())) for p, s in enumerate(range(0, len(ids), 4096))]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= 4096
    assert len(bins) <= packing.bins_needed(np.array([r.length for r in got]), 4096) + 1
    assert packing.pack_documents(empty, tokenizer_path()).count() == 0


def test_packing_rounds(spark):
    r = np.random.default_rng(2)
    n = r.integers(1, 4000, 3000)
    pieces = spark.createDataFrame([(int(i), 0, 0, int(x), int(i)) for i, x in enumerate(n)], packing.PIECES)
    got = packing.pack(pieces, group=300).collect()
    assert len(got) == len(n)
    fill = Counter()
    for x in got:
        fill[x.sequence_id] += x.length
    one = len(packing.best_fit_decreasing(n, 4096)[2])
    assert max(fill.values()) <= 4096 and len(fill) <= 1.03 * one + 3
    for _ in range(20):
        x = r.integers(1, 30, 7)
        assert packing.bins_needed(x, 30) <= len(packing.best_fit_decreasing(x, 30)[2])


def dedup_by_hand(rows, k=20):
    seen, out = set(), {}
    for i, t, *_ in sorted(rows, key=lambda r: r[0]):
        w = words(t)
        gone = [False] * len(w)
        for p in range(len(w) - k + 1):
            key = tuple(w[p : p + k])
            if key in seen:
                gone[p : p + k] = [True] * k
            seen.add(key)
        out[i] = (w, gone)
    return out


def test_debruijn(docs, rows, empty):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in debruijn.dedup_report(docs).collect()}
    hand = dedup_by_hand(rows)
    assert got == {i: (len(w), sum(g), hashlib.sha256(b" ".join(x for x, y in zip(w, g) if not y)).hexdigest()) for i, (w, g) in hand.items()}
    left = {r.doc_id: r.text for r in debruijn.remove_repeats(docs).collect()}
    for i, t, *_ in rows:
        w, g = hand[i]
        if w and all(g):
            assert i not in left
        elif not any(g):
            assert left[i] == t
        else:
            assert words(left[i]) == [x for x, y in zip(w, g) if not y]
    assert debruijn.remove_repeats(docs).columns == docs.columns and debruijn.dedup_report(empty).count() == 0


def test_topk(spark):
    r = np.random.default_rng(4)
    x = np.round(r.normal(size=(230, 9)), 1)
    data = [(i, [float(v) for v in x[i % 200]]) for i in range(230)] + [(300, None), (350, [1.0, None]), (400, [float("nan")]), (450, [float("inf")]), (None, [1.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    got = sorted((q.query_id, q.rank, q.vec_id, q.score) for q in topk.top_k(df).collect())
    whole = np.floor(256 * np.float32(x[np.arange(230) % 200]).astype(float)).astype(int)
    want = []
    for q in range(0, 230, 50):
        s = sorted((-int(whole[q] @ whole[i]), i) for i in range(230) if i != q)[:5]
        want += [(q, k + 1, i, -v) for k, (v, i) in enumerate(s)]
    assert got == sorted(want)
    assert topk.top_k(df.limit(0)).count() == 0 and topk.top_k(df.filter("vec_id in (0, 1)")).count() == 1


def test_context_tree(docs, rows, empty):
    got = {r.doc_id: r for r in ctw.score_texts(docs).collect()}
    fold = lambda t: [bytes(b + 32 if 65 <= b <= 90 else b for b in w) for w in words(t)]
    train = [fold(t) for i, t, *_ in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(w for t in train for w in t)
    n, v = sum(c.values()) + len(train), len(c) + 1
    for i, t, *_ in rows:
        w, g = fold(t), got[i]
        assert (g.n_tokens, g.n_known, g.train_tokens) == (len(w) + 1, sum(c[x] > 0 for x in w) + 1, n)
        assert math.isclose(g.base_score, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w) + math.log10((len(train) + 1) / (n + v + 1)), rel_tol=1e-9)
        assert g.score < 0 and g.bits_per_byte > 0
    assert ctw.score_texts(empty).count() == 0


def test_context_tree_weighting_is_a_distribution(spark):
    """After two levels of context the eight decisions of all bytes sum to one, and match the recursion."""
    depth = 2
    text = b"abacab "
    keys, _ = ctw.spellings(np.frombuffer(b"abacab", np.uint8), np.array([0, 6]), depth)
    assert len(keys) == len(text)
    counts = Counter(keys.tolist())
    ctx = keys[3] >> 8
    every = [(int(k), [counts[int(k)]]) for k in sorted({*counts, *[(int(ctx) << 8) | b for b in range(256)]})]
    p = {r.key: 10 ** r.logp[0] for r in ctw.spelling_model(spark.createDataFrame(every, "key long, n array<long>"), 1, depth).collect()}
    assert math.isclose(sum(p[(int(ctx) << 8) | b] for b in range(256)), 1, rel_tol=1e-9)

    def kt(seq):
        a = [0, 0]
        out = 1.0
        for s in seq:
            out *= (a[s] + 0.5) / (sum(a) + 1)
            a[s] += 1
        return out, a

    def mix(node, d, context):
        """(Pw, P(next bit is 1)) at a node: bits of keys whose context starts with `context` and whose byte starts with the node's bits."""
        bits, n = [], node.bit_length() - 1
        for k, c in counts.items():
            if (k >> (8 * (depth + 1 - d))) == context and ((1 << n) | ((k & 255) >> (8 - n))) == node:
                bits += [((k & 255) >> (7 - n)) & 1] * c
        pe, a = kt(bits)
        one = (a[1] + 0.5) / (sum(a) + 1)
        if d == depth:
            return pe, one
        below = math.prod(mix(node, d + 1, k)[0] for k in {k >> (8 * (depth - d)) for k in counts if (k >> (8 * (depth + 1 - d))) == context})
        deeper = mix(node, d + 1, int(ctx) >> (8 * (depth - d - 1)))[1]
        pw = (pe + below) / 2
        w = pe / 2 / pw
        return pw, w * one + (1 - w) * deeper

    for b in (ord("a"), ord("b"), ord(" "), 200):
        want, node = 1.0, 1
        for j in range(7, -1, -1):
            one = mix(node, 0, 0)[1]
            bit = (b >> j) & 1
            want *= one if bit else 1 - one
            node = node * 2 + bit
        assert math.isclose(p[(int(ctx) << 8) | b], want, rel_tol=1e-9)


def jaccard_by_hand(rows, n=4, percent=85):
    sets = {}
    for i, t, *_ in rows:
        w = [bytes(b + 32 if 65 <= b <= 90 else b for b in x) for x in words(t)]
        sets[i] = {tuple(w[p : p + n]) for p in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sets:
        for j in sets:
            if j < i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(s), root(i)) for i, s in sets.items()}


def test_trie_join(docs, rows, empty, spark):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in trie_join.jaccard_components(docs).collect()}
    assert got == jaccard_by_hand(rows)
    assert trie_join.jaccard_components(empty).count() == 0 and trie_join.keep_one(docs).columns == docs.columns


def test_trie_join_on_chains(spark, monkeypatch):
    """Long chains of near copies, which need more than one hub, with tiny tries."""
    monkeypatch.setattr(trie_join, "BLOCK", 3)
    r = np.random.default_rng(8)
    data = []
    for g in range(6):
        w = rng_words(r, 120, 5000)
        for _ in range(15):
            w = w[:]
            for p in r.integers(0, 120, int(r.integers(1, 4))):
                w[p] = f"n{r.integers(1 << 30)}"
            data.append((len(data), " ".join(w)))
    data += [(len(data) + i, t) for i, (_, t) in enumerate(data[:5])]
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in trie_join.jaccard_components(df).collect()} == jaccard_by_hand(data)


def test_trie_search():
    r = np.random.default_rng(6)
    sets = [np.unique(r.integers(0, 40, int(n)).astype(np.uint64)) for n in r.integers(1, 30, 80)] + [np.arange(5, dtype=np.uint64)] * 2
    trie = trie_join.Trie(sets)
    for q in sets:
        for percent in (30, 60, 100):
            want = {i for i, s in enumerate(sets) if 100 * len(np.intersect1d(q, s)) >= percent * len(np.union1d(q, s))}
            assert set(trie.search(q, percent)) == want


def test_url_filter(spark):
    urls = ["https://A.example.org/es/1?x", "http://example.org/en/12", "http://example.org/en/2#f", "http://x.org", "ftp://m.Shop.com/de/1", "http://shop.com/fr/a", "http://shop.com/en/1", "no url", None, "http://notexample.orgs/", "http://n.net/en/1", "://h/p"]
    urls += [f"http://bad.com/de/{i}" for i in range(30)] + ["http://bad.com/de"]
    df = spark.createDataFrame([(i, u, "<p>") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(df).collect()}
    assert len(got) == len(urls)
    assert got[0] == ("a.example.org", "/es/1", "example.org/es/", "block") and got[1] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert got[2][2:] == ("org/", "allow") and got[3] == ("x.org", "", None, "allow") and got[4] == ("m.shop.com", "/de/1", "com/de/", "block")
    assert got[5][2:] == ("com/fr/", "allow") and got[7][:3] == ("", "", None) and got[8][:3] == ("", "", None) and got[11][:2] == ("h", "/p")
    assert got[42] == ("bad.com", "/de", None, "block")  # its branch is all blocked
    assert url_filter.filter_urls(df.limit(0)).count() == 0


def test_mixing(docs, rows, empty):
    got = {r.doc_id: r for r in mixing.mix_sources(docs).collect()}
    assert len(got) == len(rows)
    size = {i: len(words(t)) for i, t, *_ in rows}
    of = {r[0]: r[3] for r in rows}
    sources = sorted({s for s in of.values() if s is not None}) + [None]
    own = {s: sum(size[i] for i in of if of[i] == s) for s in sources}
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sources)}
    left, free, target = 1.5 * sum(own.values()), set(sources), {}
    while True:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > 2 * own[s]}
        if not over:
            break
        for s in over:
            target[s] = 2.0 * own[s]
        left -= sum(2.0 * own[s] for s in over)
        free -= over
    target |= {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
    taken = Counter()
    for i, g in got.items():
        assert (g.size, g.source_size) == (size[i], own[of[i]]) and math.isclose(g.target, target[of[i]], rel_tol=1e-9)
        assert 0 <= g.taken <= 2 * g.size and (g.size == 0 or g.taken % g.size == 0)
        taken[of[i]] += g.taken
    for s in sources:
        assert abs(taken[s] - target[s]) <= max(size[i] for i in of if of[i] == s)
    assert {r.doc_id: r.taken for r in mixing.mix_sources(docs.repartition(7)).collect()} == {i: g.taken for i, g in got.items()}
    assert mixing.repeat_copies(docs).columns == docs.columns and mixing.mix_sources(empty).count() == 0
    assert mixing.mix_sources(docs.withColumn("text", F.lit(None).cast("string"))).agg(F.sum("taken")).first()[0] == 0


def test_byte_cnn(spark, empty):
    r = np.random.default_rng(9)
    own = {"aa": ["kato", "mira", "suno"], "bb": ["schr", "ängt", "über"]}
    data = [(i, " ".join(r.choice(own[lang], 60)), lang) for i, lang in enumerate(r.choice(["aa", "bb"], 300))]
    data += [(1000, None, "aa"), (1001, "", "aa"), (1002, "12 34 !!", "bb"), (1003, data[0][1], None)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    got = {x.doc_id: x for x in byte_cnn.identify_language(df).collect()}
    assert [got[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and got[1003].lang_pred == data[0][2]
    held = [x for x in data[:300] if zlib.crc32(str(x[0]).encode()) % 3 == 1]
    assert all(got[x[0]].held_out for x in held) and sum(got[x[0]].lang_pred == x[2] for x in held) >= 0.95 * len(held)
    assert all(0 <= x.score <= 1 for x in got.values()) and byte_cnn.identify_language(empty).count() == 0


def test_context_tree_crosses_words_at_its_depth(spark):
    """The order of words counts, and so does a byte six places back; every language has a tree."""
    assert ctw.DEPTH >= 6
    langs = [f"l{i}" for i in range(12)]
    rows = [(i, "one two three four " * 20, langs[i % 12]) for i in range(36)] + [(100, "one two three four", None), (101, "four two one three", None)]
    got = {r.doc_id: r for r in ctw.score_texts(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.col("doc_id") < 100).collect()}
    assert len(got) == 38 and got[100].score > got[101].score + 1 and math.isclose(got[100].base_score, got[101].base_score)
    rows = [(i, t, None) for i, t in enumerate(["x bcdef1", "y bcdef2"] * 40)] + [(100, "x bcdef1", None), (101, "x bcdef2", None)]
    got = {r.doc_id: r.score for r in ctw.score_texts(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.col("doc_id") < 100, 7).collect()}
    assert got[100] > got[101] + 1


def test_context_tree_keeps_a_tree_of_every_language(spark):
    """Twelve languages that continue one prefix in their own ways: each whole text is likely by its own tree."""
    rows = [(i, "common " * 3 + chr(97 + i % 12) * 30, f"l{i % 12:02d}") for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = [r.bits_per_byte for r in ctw.score_texts(docs, F.lit(True)).collect()]
    assert len(got) == 240 and max(got) - min(got) < 0.05


def test_divergence_has_a_reference_of_every_language(spark):
    """Eighty languages with words of their own: the rarest have references too, and common words go by whole counts."""
    rows = [(i * 100 + j, " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}{chr(97 + k % 20)}q" for k in range(120)), f"l{i:02d}") for i in range(80) for j in range(1 + (i < 70))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = divergence.quality_rules(docs).collect()
    assert len(got) == len(rows) and {r.nearest for r in got} == {f"l{i:02d}" for i in range(80)}
    languages, common, _, words = divergence.language_references(docs)
    assert len(languages) == 80 and all(len(c) == 20 for c in common) and words[79][0] == 6


def test_byte_cnn_learns_every_language_from_whole_texts(spark):
    rows = [(i, "same licence head " * 80 + "zz" * 800, f"l{i % 70:02d}") for i in range(140)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs = sorted({r[2] for r in rows})
    got = byte_cnn.sample(docs, langs, dict.fromkeys(langs, 2)).collect()
    assert {r.lang for r in got} == set(langs) and sum(r.text == "z" * byte_cnn.WINDOW for r in got) >= 140


def test_mixing_dual_by_bisection(spark):
    """Rates of a small table are those of the dual solved by hand: min(cap, exp(lam size / scale)), tokens as asked."""
    r = np.random.default_rng(12)
    sizes = {"a": r.integers(1, 60, 40), "b": r.integers(1, 200, 25), "c": r.integers(5, 30, 3)}
    rows = [(i, " ".join(["w"] * int(n)), s) for i, (s, n) in enumerate((s, n) for s, own in sizes.items() for n in own)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for s, own in sizes.items():
        mine = [g for g in got if g.source == s]
        target, scale = mine[0].target, float((own * own).sum() / own.sum())
        lo, hi = -200.0, 200.0
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if (own * np.minimum(2, np.exp(np.minimum(mid * own / scale, 50)))).sum() < target else (lo, mid)
        for g in mine:
            want = min(2.0, math.exp(min(lo * g.size / scale, 50)))
            assert math.isclose(g.rate, want, rel_tol=0.02), (s, g.rate, want)
        assert len({round(g.rate, 6) for g in mine}) > 1 or target >= 2 * own.sum() * (1 - 1e-9)
        assert abs(sum(g.taken for g in mine) - target) <= max(own)


def test_url_filter_rejects_a_purely_bad_template(spark):
    """Deep templates of a host whose labelled pages are all blocked are rejected; those beside allowed ones aren't."""
    urls = [f"http://bad.com/de/shop/{i}" for i in range(8)] + ["http://bad.com/en/shop/7/x", "http://good.com/en/shop/1/x"] + [f"http://good.com/fr/{i}" for i in range(8)] + [f"http://bad.com{'/a' * 300}"]
    df = spark.createDataFrame([(i, u, "h", "t") for i, u in enumerate(urls)], "page_id long, url string, host string, template string")
    got = {r.page_id: r for r in url_filter.filter_urls(df.unionByName(df.filter("page_id = 8"))).collect()}
    assert (got[8].rule, got[8].verdict, got[8].template) == (None, "block", "/en/shop/*/x") and got[9].verdict == "allow"
    assert got[18].verdict == "block" and got[18].template == "/a" * 300 and len(got) == len(urls)


def test_parity_never_parts_sets_that_link(spark):
    r = np.random.default_rng(13)
    rows = []
    for n in (3, 40, 500, 3000):
        a = np.unique(r.integers(0, 1 << 62, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: len(a) - len(a) // 20], r.integers(0, 1 << 62, len(a) // 20).astype(np.uint64)]))
        other = np.unique(r.integers(0, 1 << 62, 2 * n).astype(np.uint64))
        rows += [(len(np.setxor1d(a, x)), trie_join.parity(a).tolist(), trie_join.parity(x).tolist()) for x in (b, other)]
    got = spark.createDataFrame(rows, "d long, a array<long>, b array<long>").select("d", trie_join.differing(F.col("a"), F.col("b")).alias("h")).collect()
    assert all(g.h <= g.d for g in got) and got[-1].h > 1000


def test_debruijn_verifies_words_when_hashes_meet(docs, rows, spark):
    """With one bit of each window's hash, chance meetings abound, yet no word goes that has no earlier equal window."""
    hand = dedup_by_hand(rows)
    got = {r.doc_id: r.n_removed for r in debruijn.dedup_report(docs, mask=1).collect()}
    assert sum(got.values()) and all(got[i] <= sum(g) for i, (_, g) in hand.items())


def test_debruijn_rows_of_one_doc_id(spark):
    """Rows that repeat an id are one place in the order; rows without an id are compared with themselves only."""
    r = np.random.default_rng(8)
    a, b = (" ".join(rng_words(r, 60)) for _ in range(2))
    table = [(5, a), (5, a), (5, b), (7, a + " " + b), (None, a), (None, b + " " + b), (9, b)]
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in debruijn.dedup_report(spark.createDataFrame(table, "doc_id long, text string")).collect())
    assert got == [(0, 60, 0), (0, 120, 60), (5, 60, 0), (5, 60, 0), (5, 60, 0), (7, 120, 120), (9, 60, 60)]


def test_line_crf_samples_whole_texts_within_bytes(spark):
    long = "a line of words\n" * 1000 + "the end"
    df = spark.createDataFrame([(i, long) for i in range(40)] + [(7, "again")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    whole = line_crf.training_sample(df, labels, F.lit(True)).collect()
    assert len(whole) == 41 and {r.text for r in whole} == {long, "again"}
    some = line_crf.training_sample(df, labels, F.lit(True), most_bytes=4 * len(long)).groupBy("quality").agg(F.sum(F.length("text")).alias("n")).collect()
    assert len(some) == 2 and all(3 * len(long) < r.n <= 4 * len(long) + 5 for r in some)
    few = line_crf.training_sample(df, labels, F.lit(True), most=3).groupBy("quality").count().collect()
    assert [r["count"] for r in few] == [3, 3]


def test_crf_marginals_of_long_chains():
    """Against the recursion, line by line."""
    r = np.random.default_rng(2)
    counts = np.array([700, 1, 33])
    node, trans = r.normal(size=734) * 8, r.normal(size=(2, 2))
    p, pairs = line_crf.Chains(counts).marginals(node, trans)
    t, want, total, at = np.exp(trans), [], np.zeros((2, 2)), 0
    for n in counts:
        e = np.stack([1 / (1 + np.exp(node[at : at + n])), 1 / (1 + np.exp(-node[at : at + n]))], 1)
        f, b = [e[0] / e[0].sum()], [np.ones(2)]
        for j in range(1, n):
            x = f[-1] @ t * e[j]
            f.append(x / x.sum())
            y = t @ (e[n - j] * b[0])
            b.insert(0, y / y.sum())
        want += [f[j][1] * b[j][1] / (f[j] @ b[j]) for j in range(n)]
        for j in range(1, n):
            both = f[j - 1][:, None] * t * (e[j] * b[j])[None]
            total += both / both.sum()
        at += n
    assert np.allclose(p, want) and np.allclose(pairs, total)
