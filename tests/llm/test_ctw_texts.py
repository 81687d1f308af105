"""Whole-text scores against the recursion over all contexts of every tree."""

import math
import zlib
from collections import Counter, defaultdict

from sentrylake.llm import ctw

DEPTH = 3


def stream(text):
    return b"".join(bytes(b + 32 if 65 <= b <= 90 else b for b in w) + b" " for w in (text or "").encode().split()) + b"\n"


def bytes_in_context(text):
    s = b" " * DEPTH + stream(text)
    return [(s[i - DEPTH : i][::-1], s[i]) for i in range(DEPTH, len(s))]  # newest byte first


class Tree:
    def __init__(self, texts):
        self.n, self.children, self.known = defaultdict(lambda: [0, 0]), defaultdict(set), {}
        for t in texts:
            for ctx, byte in bytes_in_context(t):
                for b in range(8):
                    path = (1 << b) | (byte >> (8 - b))
                    for d in range(DEPTH + 1):
                        self.n[path, ctx[:d]][(byte >> (7 - b)) & 1] += 1
                        if d:
                            self.children[path, ctx[: d - 1]].add(ctx[:d])

    def log_pe(self, node):
        a, b = self.n.get(node, (0, 0))
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)

    def log_pw(self, node):
        if node not in self.known:
            pe = self.log_pe(node)
            if len(node[1]) < DEPTH:
                below = sum(self.log_pw((node[0], c)) for c in self.children.get(node, ()))
                m = max(pe, below)
                pe = m + math.log(math.exp(pe - m) + math.exp(below - m)) - math.log(2)
            self.known[node] = pe
        return self.known[node]

    def one(self, path, ctx, d=0):
        node = path, ctx[:d]
        a, b = self.n.get(node, (0, 0))
        own = (b + 0.5) / (a + b + 1)
        if d == DEPTH:
            return own
        w = math.exp(self.log_pe(node) - math.log(2) - self.log_pw(node))
        return w * own + (1 - w) * self.one(path, ctx, d + 1)

    def log10(self, text):
        total = 0.0
        for ctx, byte in bytes_in_context(text):
            for b in range(8):
                p = self.one((1 << b) | (byte >> (8 - b)), ctx)
                total += math.log10(p if (byte >> (7 - b)) & 1 else 1 - p)
        return total


def test_scores_of_whole_texts(spark):
    texts = ["The cat sat", "the Dog sat on the cat", "le chat était là", "le chien", None, "", "der Hund", "a a a a a a", "zebra!", "The cat sat", "la la land"]
    langs = ["en", "en", "fr", "fr", "en", None, None, "en", "fr", "en", "fr"]
    rows = [(i, t, x) for i, (t, x) in enumerate(zip(texts, langs))]
    learn = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 7 != 2]
    share = Counter(x for _, _, x in learn)
    trees = {x: Tree([t for _, t, y in learn if y == x]) for x in share}
    got = {r.doc_id: r.score for r in ctw.score_texts(spark.createDataFrame(rows, "doc_id long, text string, lang string"), depth=DEPTH).collect()}
    for i, t, _ in rows:
        each = [math.log10((share[x] + 0.5) / (len(learn) + len(trees) / 2)) + trees[x].log10(t) for x in trees]
        want = max(each) + math.log10(sum(10 ** (e - max(each)) for e in each))
        assert math.isclose(got[i], want, rel_tol=2e-3), (i, got[i], want)
    assert len(trees) == 3 and 0 < len(learn) < len(rows)
