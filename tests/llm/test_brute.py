"""Verdicts, networks, copies and stages against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from sentrylake.llm import byte_cnn, ctw, divergence, mixing, packing, topk, trie_join
from sentrylake.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


# operator 1
def kind_of(c):
    if "a" <= c <= "z":
        return 0
    for k, chars in ((1, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (2, "0123456789"), (3, " \t\x0b\x0c\r"), (4, "\n"), (5, ".,;:?'\"-"), (6, "#*$%&<>"), (7, "|"), (8, "!")):
        if c in chars:
            return k
    return 10 if ord(c) > 127 else 9


def js(p, q):
    sp, sq = sum(p) or 1, sum(q) or 1
    d = 0.0
    for a, b in zip(p, q):
        a, b = a / sp, b / sq
        m = (a + b) / 2
        d += (a * math.log2(a / m) if a else 0) + (b * math.log2(b / m) if b else 0)
    return math.sqrt(max(0.0, d / 2))


def test_kept_by_divergence(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.collect()
    classes, common = defaultdict(lambda: [0] * 11), defaultdict(Counter)
    for r in rows:
        if r.lang is not None and r.text is not None:
            for c in r.text:
                classes[r.lang][kind_of(c)] += 1
            common[r.lang].update(words(r.text))
    top = {x: sorted(c, key=lambda w, c=c: (-c[w], w.encode()))[: divergence.COMMON] for x, c in common.items()}
    refs = {x: [common[x][w] for w in top[x]] + [sum(common[x].values()) - sum(common[x][w] for w in top[x])] for x in top}
    got = {r.doc_id: r for r in divergence.quality_rules(docs).collect()}
    n_kept = 0
    for r in rows:
        w, g = words(r.text), got[r.doc_id]
        own = [0] * 11
        for c in r.text or "":
            own[kind_of(c)] += 1
        have = Counter(w)
        near = False
        for x in top:
            mine = [have[v] for v in top[x]]
            by_class, by_word = js(own, classes[x]), js([*mine, len(w) - sum(mine)], refs[x])
            assert min(abs(by_class - 0.19), abs(by_word - 0.36)) > 1e-9
            near |= (by_class <= 0.19 or len(r.text or "") < 200) and (by_word <= 0.36 or len(w) < 50)
        assert g.kept == (near and not g.base_failed), r.doc_id
        n_kept += g.kept
    assert 0 < n_kept < len(rows)


# operator 10
def direct(net, x):
    """Log probabilities by plain loops over windows, widths, filters and offsets."""
    out = []
    for row in x:
        h = []
        for w, k, b in zip(byte_cnn.WIDTHS, net.conv, net.bias):
            for f in range(byte_cnn.FILTERS):
                h.append(max(sum(float(net.embed[row[i + j]] @ k[j * byte_cnn.DIM : (j + 1) * byte_cnn.DIM, f]) for j in range(w)) + float(b[f]) for i in range(len(row) - w + 1)))
        s = np.maximum(np.array(h), 0) @ net.out.astype(float) + net.shift
        out.append(s - s.max() - math.log(np.exp(s - s.max()).sum()))
    return np.array(out)


def small_net():
    r = np.random.default_rng(3)
    net, x, y = byte_cnn.ByteCnn(3), r.integers(0, 257, (5, 20)), np.array([0, 1, 2, 1, 0])
    for p in net.params():
        p += r.normal(0, 0.05, p.shape).astype(np.float32)
    net.embed[byte_cnn.PAD] = 0
    return net, x, y


def test_network_by_direct_convolution():
    net, x, _ = small_net()
    assert np.allclose(net.log_probs(x, net.tables()), direct(net, x), atol=1e-4)


def test_network_moves_against_numeric_gradients():
    """The first step of Adam goes `rate` against each gradient's sign."""
    net, x, y = small_net()
    loss = lambda: -direct(net, x)[np.arange(5), y].mean()
    r, checked = np.random.default_rng(1), 0
    before = [p.copy() for p in net.params()]
    gradients = []
    for i, p in enumerate(net.params()):
        for _ in range(12):
            at = tuple(int(r.integers(0, n)) for n in p.shape) if i else (int(x[r.integers(0, 5), r.integers(0, 20)]), int(r.integers(0, byte_cnn.DIM)))
            if i == 0 and at[0] == byte_cnn.PAD:
                continue
            keep = p[at]
            p[at] = keep + 1e-2
            up = loss()
            p[at] = keep - 1e-2
            down = loss()
            p[at] = keep
            gradients.append((i, at, (up - down) / 2e-2))
    net.train(x, y, epochs=1, rate=1e-3, size=5)
    for i, at, g in gradients:
        if abs(g) > 2e-2:
            checked += 1
            assert np.sign(before[i][at] - net.params()[i][at]) == np.sign(g), (i, at, g)
    assert checked > 10


# operator 9
def test_copies_of_each_group(spark):
    """Copies from given tilts: rounded rates, what is left made up from small documents on, spread evenly over a group."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(spark.read.parquet(f"{SF}/documents.parquet").limit(30))
    sizes = docs.select(F.coalesce("source", F.lit("")).alias("_s"), F.col("source").isNull().alias("_n"), mixing.word_count(F.col("text")).alias("size"))
    groups = sizes.groupBy("_s", "_n", "size").agg(F.count("*").alias("n"))
    mixed = mixing.mix_sources(docs).cache()
    targets = mixed.groupBy(F.coalesce("source", F.lit("")).alias("_s"), F.col("source").isNull().alias("_n")).agg(F.first("source_size").alias("source_size"), F.first("target").alias("target"))
    tilts = {r["_s"]: r for r in mixing.solve_tilts(groups, targets).collect()}
    of = defaultdict(dict)
    for r in groups.collect():
        of[r["_s"]][r["size"]] = r["n"]
    got = defaultdict(list)
    for r in mixed.collect():
        got[r.source or "", r["size"]].append(r.copies)
        assert r.taken == r.copies * r["size"] and r.copies <= 2
    for s, own in of.items():
        t = tilts[s]
        rate = {z: 2.0 if t.full else min(2.0, math.exp(t.lam * z / t.scale)) for z in own}
        copies = {z: math.floor(n * rate[z] + 0.5) for z, n in own.items()}
        for last in (False, False, False, True):
            left = t.target - sum(copies[z] * z for z in own)
            room = {z: 0 if z == 0 else math.floor(2.0 * own[z]) - copies[z] if left > 0 else copies[z] for z in own}
            before = 0
            for z in sorted(own):
                wanted = (abs(left) - before) / max(z, 1)
                before += room[z] * z
                copies[z] += int(np.sign(left)) * max(0, min(room[z], math.floor(wanted + 0.5) if last else math.ceil(wanted)))
        for z, n in own.items():
            part = lambda k, a=copies[z], n=n: a // n * k + (a % n) * k // n
            assert sorted(got[s, z]) == sorted(part(k) - part(k - 1) for k in range(1, n + 1)), (s, z)
        assert abs(sum(c * z for z, c in copies.items()) - t.target) <= max(own)


# rows that repeat, and columns with names that operators use
CLASH = "doc_id long, text string, lang string, source string, n_chars long, w long, n long, p long, at long, key string, score double, x long, norm double, _text string, _id long, group long"


def test_repeated_rows_and_clashing_columns(spark):
    base = [r for r in spark.read.parquet(f"{SF}/documents.parquet").limit(40).collect()]
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars, 1, 2, 3, 4, "k", 0.5, 6, 0.1, "t", 9, 1) for r in base]
    rows += [rows[3]] * 25 + [rows[5][:1] + ("another text of the same id",) + rows[5][2:]]
    docs = spark.createDataFrame(rows, CLASH).repartition(3)
    ids = sorted(r[0] for r in rows)
    for run in (divergence.quality_rules(docs), ctw.score_texts(docs), trie_join.jaccard_components(docs), mixing.mix_sources(docs), byte_cnn.identify_language(docs)):
        out = run.collect()
        assert sorted(r.doc_id for r in out) == ids
        same = [tuple(v for c, v in r.asDict().items() if c not in ("copies", "taken")) for r in out if r.doc_id == rows[3][0]]
        assert len(same) == 26 and len(set(map(str, same))) == 1
    pieces = packing.pack_documents(docs, tokenizer_path()).filter("piece = 0").collect()
    assert sorted(r.doc_id for r in pieces) == ids


def test_search_with_repeated_rows_and_clashing_columns(spark):
    r = np.random.default_rng(2)
    v = [(i, [float(x) for x in r.normal(size=6)], 1, 2.0, "q") for i in range(200)]
    v += [v[50]] * 30 + [v[7]] * 30
    docs = spark.createDataFrame(v, "vec_id long, embedding array<float>, x long, norm double, rank string").repartition(3)
    got = topk.top_k(docs).collect()
    small = topk.top_k(docs, every=3, block=7)  # many blocks, more than a task holds
    assert small.filter("query_id % 50 = 0").exceptAll(topk.top_k(docs).filter("query_id % 3 = 0")).count() == 0 and small.select("query_id").distinct().count() == 67
    whole = [(i, np.floor(256 * np.float32(e).astype(float)).astype(np.int64)) for i, e, *_ in v]
    for q in (0, 50, 100, 150):
        x = next(y for i, y in whole if i == q)
        want = sorted(((-int(x @ y), i) for i, y in whole if i != q))[:5]
        assert [(-r.score, r.vec_id) for r in sorted((g for g in got if g.query_id == q), key=lambda g: g["rank"])] == want


# the pipeline's stages, each on what its predecessor kept
def test_stages_by_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.quality(spark, docs, SF).cache()
    rows = sorted(kept.collect(), key=lambda r: r.doc_id)
    # one of each group of near duplicates
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    sets = {}
    for r in rows:
        w = words(low(r.text))
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    single = corpus_pipeline.near_duplicates(spark, kept, SF).cache()
    assert sorted(r.doc_id for r in single.collect()) == sorted({find(i) for i in ids})
    # words of windows that also start earlier
    rows, seen, left = sorted(single.collect(), key=lambda r: r.doc_id), set(), {}
    for r in rows:
        w, gone, new = words(r.text), set(), []
        for i in range(len(w) - 19):
            key = hashlib.md5(" ".join(w[i : i + 20]).encode()).digest()
            if key in seen:
                gone.update(range(i, i + 20))
            seen.add(key)
        left[r.doc_id] = [x for i, x in enumerate(w) if i not in gone]
        assert new == []
    short = corpus_pipeline.repeated_passages(spark, single, SF).cache()
    got = {r.doc_id: words(r.text) for r in short.collect()}
    assert got == {i: w for i, w in left.items() if w or not words(next(r.text for r in rows if r.doc_id == i))}
    # whole copies of rows that came in, each source near its target
    mixed = corpus_pipeline.source_mix(spark, short, SF).cache()
    n = Counter((r.doc_id, r.text) for r in mixed.collect())
    came = {(r.doc_id, r.text): r.source for r in short.collect()}
    assert set(n) <= set(came) and max(n.values()) <= 2
    taken, size = Counter(), Counter()
    for (i, t), s in came.items():
        size[s] += len(words(t))
        taken[s] += n[i, t] * len(words(t))
    names = sorted(size)
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    target, pool, open_ = {}, 1.5 * sum(size.values()), set(names)
    while open_:
        share = {s: pool * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * size[s]]
        if not over:
            target.update(share)
            break
        for s in over:
            target[s] = 2 * size[s]
            pool -= target[s]
            open_.discard(s)
    assert all(abs(taken[s] - target[s]) <= 0.05 * target[s] + 30 for s in names)
    # every document's ids, in sequences without gaps
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    want = Counter()
    for (i, t), c in n.items():
        x = np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        for p, s in enumerate(range(0, len(x), 4096)):
            want[i, p, s, len(x[s : s + 4096]), zlib.crc32(x[s : s + 4096].tobytes())] += c
    packed = corpus_pipeline.packed(spark, mixed, SF).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == want
    at = defaultdict(list)
    for r in packed:
        at[r.sequence_id].append((r.offset, r.length))
    for own in at.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and sum(own[-1]) <= 4096
