"""Operator 6: language-model scores by context-tree weighting over bytes.

A text is its lower-cased words, each closed by a space, and one end mark. A byte is
eight binary decisions; a decision's contexts are the 0 to DEPTH bytes before it in the
text's running stream, across words (spaces before the text's start). Every node
estimates by Krichevsky-Trofimov; weighting mixes the estimates of all depths.

Documents are put into blocks. A block counts its distinct (context, byte) keys and its
distinct words first, and sends them packed, one row for each bucket of contexts; a
bucket sends every block the values of the block's own keys. Keys hold the newest
context byte first, so a node at any depth is a prefix of the key; a bucket holds whole
subtrees of the newest three bytes. What lies above them has at most 65,536 contexts and
is finished on the driver.

Each language that the training rows name has a tree of its own, rows without a language
have one together, and a text's probability is the mean of what the trees give to the
whole text, weighted by their shares of the training documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentrylake.llm.text import LOWER, SEPARATOR, buffers, cut, held_out, kept_here, release, sliced, small_batches, word_hashes

DEPTH = 6
#: Bytes of context that a bucket's subtrees share.
TOP = 3
BLOCK_BYTES, SLICE_BYTES = 32 << 20, 1 << 20
#: Buckets for each partition of the input, and their least and greatest number; a quarter as many hold words.
BUCKETS_EACH, LEAST_BUCKETS, MOST_BUCKETS = 4, 64, 16384
EXACT = 1 << 14
LN2, LN10 = float(np.log(2)), float(np.log(10))


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma(x) for x > 0: Stirling's series after shifting x above 8."""
    y, shift = x.astype(float), np.zeros(len(x))
    low = y < 8
    while low.any():
        shift[low] += np.log(y[low])
        y = np.where(low, y + 1, y)
        low = y < 8
    r = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r / 1680))) / y - shift


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of a zeros and b ones; the first EXACT values are looked up."""
    kept = kept_here()
    if "ctw gamma" not in kept:
        n = np.arange(EXACT, dtype=float)
        kept["ctw gamma"] = log_gamma(n + 0.5), log_gamma(n + 1.0)
    half, whole = kept["ctw gamma"]
    a, b = a.astype(np.int64), b.astype(np.int64)
    n = a + b
    out = half[np.minimum(a, EXACT - 1)] + half[np.minimum(b, EXACT - 1)] - whole[np.minimum(n, EXACT - 1)] - np.log(np.pi)
    far = np.flatnonzero(n >= EXACT)
    out[far] = log_gamma(a[far] + 0.5) + log_gamma(b[far] + 0.5) - np.log(np.pi) - log_gamma(n[far] + 1.0)
    return out


def spellings(body: np.ndarray, bounds: np.ndarray, depth: int = DEPTH, close: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """(key of each byte of each text and of its closing byte, the text it is of): newest context byte on top, the byte itself at the bottom."""
    sizes = np.diff(bounds)
    n, wide = len(sizes), sizes + depth + 1
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    ends = np.cumsum(wide)
    own = np.ones(ends[-1], bool)
    own[((ends - wide)[:, None] + np.arange(depth)).ravel()] = False
    inner = own.copy()
    inner[ends - 1] = False
    text = np.full(ends[-1] + 8, 32, np.uint8)  # eight more, as eight bytes are read at once
    text[8:][inner] = body[bounds[0] : bounds[-1]]
    text[8:][ends - 1] = close
    # backwards, the eight bytes from a place on are the byte before it, and older ones
    back = np.ascontiguousarray(text[::-1])
    eight = np.ndarray((ends[-1],), ">u8", back, 1, (1,))[::-1]
    keys = (eight[own].astype(np.uint64) >> np.uint64(8 * (8 - depth)) << np.uint64(8)).view(np.int64)
    return keys | text[8:][own], np.repeat(np.arange(n, dtype=np.int32), sizes + 1)


def stream(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(lower-cased words of all texts, each closed by a space; bounds of the texts in it)."""
    data, off = buffers(pc.binary_join_element_wise(pc.fill_null(texts, "").cast(pa.string()), "", " "))
    gap = SEPARATOR[data]
    keep = ~gap
    keep[1:] |= ~gap[:-1]
    total = np.concatenate([[0], np.cumsum(keep, dtype=np.int64)])
    gap = gap[keep]
    body = LOWER[data[keep]]
    body[gap] = 32
    return body, total[off]


def words_in(body: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words of a stream, the text of each)."""
    gap = body == 32
    ends = np.flatnonzero(gap)
    stops = ends - np.arange(len(ends))
    return word_hashes(body[~gap], np.concatenate([[0], stops]).astype(np.int64)).view(np.int64), np.searchsorted(bounds, ends, "right") - 1


class Decision:
    """The nodes of one of the eight decisions of a byte, at depths `depth` up to `top`, for sorted distinct keys.

    A node is named by its context, then by the byte's bits before the decision
    behind a leading one.
    """

    def __init__(self, keys: np.ndarray, b: int, top: int, depth: int):
        byte = keys & 255
        self.bit = (byte >> (7 - b)) & 1
        name = (keys >> 8 << 8) | (1 << b) | (byte >> (8 - b))
        first = np.flatnonzero(np.append(True, name[1:] != name[:-1])) if len(name) else np.zeros(0, np.int64)
        self.of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(name))))
        name = name[first]
        self.sizes, self.up = [len(name)], []  # nodes of a depth, and the parent of each, from `depth` up
        for _ in range(depth - top):
            name, up = np.unique(name >> 16 << 8 | name & 255, return_inverse=True)
            self.up.append(up)
            self.sizes.append(len(name))
        self.top = name

    def fit(self, counts: np.ndarray) -> list[tuple]:
        """Zeros, ones, ln Pe and ln Pw of the nodes of each depth, from `depth` up."""
        zeros, ones = (np.bincount(self.of, counts * (self.bit == v), self.sizes[0]) for v in (0, 1))
        pe = log_kt(zeros, ones)
        out = [(zeros, ones, pe, pe)]
        for up, size in zip(self.up, self.sizes[1:], strict=True):
            zeros, ones, below = (np.bincount(up, x, size) for x in (zeros, ones, out[-1][3]))
            pe = log_kt(zeros, ones)
            out.append((zeros, ones, pe, np.logaddexp(pe, below) - LN2))
        return out

    def log_probability(self, fitted: list[tuple], mixed: np.ndarray, left: np.ndarray) -> np.ndarray:
        """ln P(bit | context) of each key; mixed, left: of each top node the estimate of a one by the depths above, and the weight that remains."""
        for i in range(len(fitted) - 1, -1, -1):
            zeros, ones, pe, pw = fitted[i]
            if i < len(self.up):
                mixed, left = mixed[self.up[i]], left[self.up[i]]
            w = np.exp(pe - LN2 - pw) if i else 1.0
            mixed = mixed + left * w * (ones + 0.5) / (zeros + ones + 1)
            left = left * (1 - w)
        p = mixed[self.of]
        return np.log(np.where(self.bit == 1, p, 1 - p))


def tree_values(keys: np.ndarray, counts: list[np.ndarray], depth: int = DEPTH, above: list[list] | None = None) -> np.ndarray:
    """For each tree: log10 probability of each key's byte in its context, for sorted distinct keys.

    above: what `above_of` gives for each tree; without it the keys are the whole trees'.
    """
    out = np.zeros((len(counts), len(keys)))
    levels = len(above[0]) if above else 0
    for b in range(8):
        tree = Decision(keys, b, levels, depth)
        for c, n in enumerate(counts):
            mixed, left = np.zeros(len(tree.top)), np.ones(len(tree.top))
            for d in range(levels):
                name, one, weight = above[c][d]
                own = tree.top >> 8 * (1 + levels - d) << 8 | tree.top & 255
                p, w = np.full(len(own), 0.5), np.full(len(own), 0.5)  # of a node without counts
                if len(name):
                    at = np.minimum(np.searchsorted(name, own), len(name) - 1)
                    known = name[at] == own
                    p[known], w[known] = one[at[known]], weight[at[known]]
                mixed += left * w * p
                left *= 1 - w
            out[c] += tree.log_probability(tree.fit(n), mixed, left)
    return out / LN10


def top_nodes(keys: np.ndarray, counts: list[np.ndarray], depth: int = DEPTH, top: int = TOP) -> pd.DataFrame:
    """For each tree and each node one level above `top`: zeros, ones and ln Pw of its children here, summed."""
    parts = []
    for b in range(8):
        tree = Decision(keys, b, top, depth)
        node = tree.top >> 16 << 8 | tree.top & 255
        for c, n in enumerate(counts):
            zeros, ones, _, pw = tree.fit(n)[-1]
            parts.append(pd.DataFrame({"tree": c, "node": node, "zeros": zeros, "ones": ones, "pw": pw})[zeros + ones > 0])
    return pd.concat(parts).groupby(["tree", "node"], as_index=False).sum()


def above_of(top: pd.DataFrame, trees: int, levels: int = TOP) -> list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """For each tree, depths 0 to levels - 1: names of nodes in order, estimate of a one, and weight."""
    out = []
    for c in range(trees):
        own = top[top["tree"] == c]
        name, zeros, ones, below = (own[x].to_numpy() for x in ("node", "zeros", "ones", "pw"))
        depths = []
        for _ in range(levels):
            name, of = np.unique(name.astype(np.int64), return_inverse=True)
            zeros, ones, below = (np.bincount(of, x, len(name)) for x in (zeros, ones, below))
            pe = log_kt(zeros, ones)
            pw = np.logaddexp(pe, below) - LN2
            depths.append((name, (ones + 0.5) / (zeros + ones + 1), np.exp(pe - LN2 - pw)))
            name, below = name >> 16 << 8 | name & 255, pw
        out.append(depths[::-1])
    return out


TOP_SQL = "tree long, node long, zeros double, ones double, pw double"


def summed(top: DataFrame) -> pd.DataFrame:
    return top.groupBy("tree", "node").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "pw")]).toPandas()


def spelling_model(pairs: DataFrame, classes: int, depth: int = DEPTH) -> DataFrame:
    """(key, logp): log10 probability of each spelled byte in its context by the tree of each class, an array.

    pairs: (key, n), n an array with the training count of each class, 0 too. The same
    model as in score_texts, for keys that lie in a table.
    """
    top = min(TOP, depth)
    pairs = cut(pairs.groupBy("key").agg(*[F.sum(F.get("n", F.lit(c))).alias(f"n{c}") for c in range(classes)]))
    pairs = pairs.withColumn("root", F.pmod(F.xxhash64(F.shiftright("key", 8 * (depth + 1 - top))), F.lit(LEAST_BUCKETS)))

    def sorted_keys(pdf: pd.DataFrame) -> tuple[np.ndarray, list[np.ndarray]]:
        pdf = pdf.sort_values("key")
        return pdf["key"].to_numpy(), [pdf[f"n{c}"].to_numpy() for c in range(classes)]

    found = summed(pairs.groupBy("root").applyInPandas(lambda pdf: top_nodes(*sorted_keys(pdf), depth, top), TOP_SQL))
    above = pairs.sparkSession.sparkContext.broadcast(above_of(found, classes, top))

    def spell(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, counts = sorted_keys(pdf)
        return pd.DataFrame({"key": keys, "logp": list(tree_values(keys, counts, depth, above.value).T)})

    return pairs.groupBy("root").applyInPandas(spell, "key long, logp array<double>")


class Tally:
    """Distinct keys, sorted, and how often each was added."""

    def __init__(self):
        self.keys, self.counts, self.wait, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.wait.append((keys, counts))
        self.size += len(keys)
        if self.size > len(self.keys) // 2 + (1 << 20):
            self.merge()

    def merge(self) -> Tally:
        if self.wait:
            keys, counts = (np.concatenate([x, *[w[i] for w in self.wait]]) for i, x in enumerate((self.keys, self.counts)))
            self.wait, self.size = [], 0
            order = np.argsort(keys)
            keys = keys[order]
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
            self.keys, self.counts = keys[first], np.add.reduceat(counts[order], first) if len(first) else counts
        return self


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, in order, and how often each comes."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys)))


def _pack(a: np.ndarray, level: int = 1) -> bytes:
    """An array, the first bytes of all its items first."""
    a = np.ascontiguousarray(a)
    return a.nbytes.to_bytes(8, "big") + (pa.Codec("zstd", level).compress(np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes(), asbytes=True) if a.nbytes else b"")


def _unpack(data: bytes, kind) -> np.ndarray:
    size, kind = int.from_bytes(data[:8], "big"), np.dtype(kind)
    if not size:
        return np.zeros(0, kind)
    return np.ascontiguousarray(np.frombuffer(pa.decompress(data[8:], size, "zstd", asbytes=True), np.uint8).reshape(kind.itemsize, -1).T).reshape(-1).view(kind)


def _steps(keys: np.ndarray) -> bytes:
    return _pack(np.diff(keys, prepend=0))


def _from_steps(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack(data, np.int64))


#: Rows of two kinds: a slice of texts (bucket -1), or a block's keys of one bucket.
BLOCK = pa.schema([
    ("block", pa.int64()), ("bucket", pa.int32()), ("ids", pa.list_(pa.int64())), ("learn", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int64())), ("text", pa.binary()),
    ("train_docs", pa.int64()), ("train_words", pa.int64()), ("keys", pa.binary()), ("trees", pa.list_(pa.int32())), ("counts", pa.list_(pa.binary())),
])
BLOCK_SQL = "block long, bucket int, ids array<long>, learn array<boolean>, sizes array<long>, text binary, train_docs long, train_words long, keys binary, trees array<int>, counts array<binary>"


def bucket_of(keys: np.ndarray, depth: int, buckets: int) -> np.ndarray:
    """A key's bucket, by its newest TOP bytes."""
    root = (keys >> (8 * (depth + 1 - TOP))).astype(np.uint64)
    return ((root * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(buckets)).astype(np.int32)


def dealt(tallies: dict[int, Tally], place) -> Iterator[tuple[int, bytes, list[int], list[bytes]]]:
    """(bucket, keys, trees that have some, their counts) of a block; tree -1 brings keys only."""
    every = Tally()
    for t in tallies.values():
        every.add(t.merge().keys, t.counts)
    keys = every.merge().keys
    dense = {}
    for c in sorted(c for c in tallies if c >= 0):
        dense[c] = np.zeros(len(keys), np.uint32)
        dense[c][np.searchsorted(keys, tallies[c].keys)] = tallies[c].counts
    tallies.clear()
    bucket = place(keys)
    order = np.argsort(bucket, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else []:
        having = [c for c, d in dense.items() if d[own].any()]
        yield int(bucket[own[0]]), _steps(keys[own]), having, [_pack(dense[c][own]) for c in having]


def blocks_of(docs: DataFrame, names: pa.Array, trees: int, buckets: int, depth: int = DEPTH) -> DataFrame:
    """Documents (doc_id, text, lang, learn) in blocks of about BLOCK_BYTES: rows with the texts, and one for each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, size, keys, words = TaskContext.get().partitionId() << 32, 0, {}, {}
        for batch in sliced(batches, "text", SLICE_BYTES):
            body, bounds = stream(batch.column("text"))
            learn = batch.column("learn").to_numpy(zero_copy_only=False)
            tree = np.where(learn, np.asarray(pc.index_in(batch.column("lang"), names).fill_null(trees - 1)), -1)
            spelled, doc = spellings(body, bounds, depth, 10)
            of = tree[doc]
            for c in np.unique(tree).tolist():
                keys.setdefault(c, Tally()).add(*counted(spelled[of == c]))
            hashes, doc = words_in(body, bounds)
            for c in {min(int(c), 0) for c in tree}:
                words.setdefault(c, Tally()).add(*counted(hashes[learn[doc] == (c == 0)]))
            whole = [0, batch.num_rows]
            sizes = pa.ListArray.from_arrays(whole, pa.array(np.diff(bounds)))
            yield row(number, -1, *(pa.ListArray.from_arrays(whole, batch.column(c)) for c in ("doc_id", "learn")), sizes, _pack(body, 6), int(learn.sum()), int(learn[doc].sum()), None, None, None)
            size += len(body)
            if size >= BLOCK_BYTES:
                yield from block(number, keys, words)
                number, size, keys, words = number + 1, 0, {}, {}
                release()
        yield from block(number, keys, words)

    def block(number: int, keys: dict[int, Tally], words: dict[int, Tally]) -> Iterator[pa.RecordBatch]:
        for tallies, place in ((keys, lambda k: bucket_of(k, depth, buckets)), (words, lambda k: (buckets + k % (buckets // 4)).astype(np.int32))):
            for bucket, *more in dealt(tallies, place):
                yield row(number, bucket, None, None, None, None, 0, 0, *more)

    def row(*values) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array([v], f.type) for v, f in zip(values, BLOCK, strict=True)], schema=BLOCK)

    return docs.mapInArrow(run, BLOCK_SQL)


def merged(batches: Iterator[pa.RecordBatch], trees: int) -> tuple[np.ndarray, list[np.ndarray], list[tuple[int, bytes]]]:
    """All keys of a bucket's rows, each tree's training counts, and each row's block and packed keys."""
    every, each, rows = Tally(), [Tally() for _ in range(trees)], []
    for batch in batches:
        for number, packed, having, counts in zip(*(batch.column(c).to_pylist() for c in ("block", "keys", "trees", "counts")), strict=True):
            keys = _from_steps(packed)
            every.add(keys, np.zeros(len(keys), np.int64))
            for c, n in zip(having, counts, strict=True):
                n = _unpack(n, np.uint32)
                some = np.flatnonzero(n)
                each[c].add(keys[some], n[some].astype(np.int64))
            rows.append((number, packed))
    keys, dense = every.merge().keys, []
    for t in each:
        n, t = np.zeros(len(keys), np.int64), t.merge()
        n[np.searchsorted(keys, t.keys)] = t.counts
        dense.append(n)
    return keys, dense, rows


def score_texts(docs: DataFrame, learn_from=None, depth: int = DEPTH) -> DataFrame:
    """Base and model scores of every whole text.

    Learns from the rows that `learn_from` allows (default: crc32(doc_id) mod 7 is
    not 2). Trees are those of all languages with training rows, and one for training
    rows without a language; the language of a text that is scored isn't used. Null
    and empty texts are the end mark alone; long ones need no more than their bytes. A
    word never seen still has a score, by its bytes. With nothing to learn from, all
    estimates are even. Repeated rows each count and each return a row; other columns,
    whatever their names, are not looked at; an empty table gives an empty result.
    bits_per_byte is the code length of the text as its stream here. Values of bytes
    travel as 16-bit floats, which moves a text's score by about one part in 100,000.
    Depth is TOP to 7 bytes.
    """
    learn_from = ~held_out("doc_id", 7, 2) if learn_from is None else learn_from
    small_batches(docs.sparkSession)
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    share = {r["lang"]: r["n"] for r in docs.filter(learn_from).groupBy(lang.alias("lang")).agg(F.count("*").alias("n")).collect()}
    langs = sorted(x for x in share if x is not None) + [None] * (None in share or not share)
    trees = len(langs)
    prior = np.log10(np.array([share.get(x, 0) + 0.5 for x in langs]) / (sum(share.values()) + trees / 2))
    names = pa.array([x for x in langs if x is not None], pa.string())
    rows = docs.select("doc_id", "text", lang.alias("lang"), F.coalesce(learn_from, F.lit(False)).alias("learn"))
    buckets = min(MOST_BUCKETS, max(LEAST_BUCKETS, BUCKETS_EACH * docs.rdd.getNumPartitions()))
    blocks = cut(blocks_of(rows, names, trees, buckets, depth))
    packed = blocks.filter("bucket >= 0").select("block", "bucket", "keys", "trees", "counts")
    is_word = lambda key: key[0].as_py() >= buckets

    def tops(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, _ = merged(batches, 1 if is_word(key) else trees)
        if is_word(key):
            out = pd.DataFrame({"tree": [-1], "node": [0], "zeros": [float((counts[0] > 0).sum())], "ones": [0.0], "pw": [0.0]})
        else:
            out = top_nodes(keys, counts, depth)
        schema = pa.schema([("tree", pa.int64()), ("node", pa.int64()), ("zeros", pa.float64()), ("ones", pa.float64()), ("pw", pa.float64())])
        yield pa.RecordBatch.from_pandas(out, schema, preserve_index=False)

    top = summed(packed.groupBy("bucket").applyInArrow(tops, TOP_SQL))
    known = int(top.loc[top["tree"] < 0, "zeros"].sum())
    above = docs.sparkSession.sparkContext.broadcast(above_of(top, trees))
    ends, tokens = (x or 0 for x in blocks.filter("bucket < 0").agg(F.sum("train_docs"), F.sum("train_words")).first())
    total, distinct = tokens + ends, known + (ends > 0)
    floor = total + distinct + 1.0

    def values(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, rows = merged(batches, 1 if is_word(key) else trees)
        each = counts if is_word(key) else tree_values(keys, counts, depth, above.value).astype(np.float16)
        for number, own in rows:
            at = np.searchsorted(keys, _from_steps(own))
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([is_word(key)]), pa.array([own]), pa.array([[_pack(v[at]) for v in each]])], ["block", "word", "keys", "v"])
        del keys, counts, each, rows
        release()

    value = packed.groupBy("bucket").applyInArrow(values, "block long, word boolean, keys binary, v array<binary>")

    def table(found: pa.Table, word: bool, kind, many: int) -> tuple[pd.Index, list[np.ndarray]]:
        own = found.filter(pc.equal(found.column("word"), word))
        keys, v = own.column("keys"), own.column("v")
        index = pd.Index(np.concatenate([np.zeros(0, np.int64), *(_from_steps(k.as_py()) for k in keys)]))
        return index, [np.concatenate([np.zeros(0, kind), *(_unpack(x[c].as_py(), kind) for x in v)]) for c in range(many)]

    def finish(block: pa.Table, found: pa.Table) -> pa.Table:
        words, (seen,) = table(found, True, np.int64, 1)
        keys, logp = table(found, False, np.float16, trees)
        parts = []
        for i in range(block.num_rows):
            ids, learn, sizes = (block.column(c).slice(i, 1).combine_chunks().flatten() for c in ("ids", "learn", "sizes"))
            body, sizes, n = _unpack(block.column("text")[i].as_py(), np.uint8), np.asarray(sizes), len(ids)
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            spelled, doc = spellings(body, bounds, depth, 10)
            at = keys.get_indexer(spelled)
            del spelled
            each = np.stack([np.bincount(doc, p[at], n) for p in logp]) + prior[:, None]
            score = np.logaddexp.reduce(each * LN10, axis=0) / LN10
            hashes, doc = words_in(body, bounds)
            c = seen[words.get_indexer(hashes)]
            base = np.bincount(doc, np.log10((c + 1) / floor), n) + np.log10((ends + 1) / floor)
            parts.append(pa.table([
                ids, pc.invert(learn), pa.array(np.bincount(doc, minlength=n) + 1), pa.array(np.bincount(doc, c > 0, n).astype(np.int64) + int(ends > 0)),
                pa.array(np.full(n, total, np.int64)), pa.array(base), pa.array(score), pa.array(-score / np.log10(2) / (sizes + 1)),
            ], [f.split()[0] for f in SCORES.split(", ")]))
        del words, seen, keys, logp
        release()
        return pa.concat_tables(parts).combine_chunks()

    texts = blocks.filter("bucket < 0").select(F.col("block").alias("number"), "ids", "learn", "sizes", "text")
    return texts.groupBy("number").cogroup(value.groupBy("block")).applyInArrow(finish, SCORES)


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
