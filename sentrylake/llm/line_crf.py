"""Operator 2: document quality from a linear-chain conditional random field over lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sentrylake.llm.text import SEPARATOR, SMALL_BATCH_BYTES, buffers, held_out, sliced, small_batches, word_hashes

#: Bounds of the training sample, for each label: documents, and bytes and lines of their whole texts.
SAMPLE_DOCS, SAMPLE_BYTES, SAMPLE_LINES = 2000, 4 << 20, 100_000
#: Lines whose features and messages are held at a time.
BLOCK_LINES = 1 << 15
STEPS, ROUNDS = 100, 2
THRESHOLD = 0.3

_GROUPS = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", ".,;:?'\"-", "#*$%&<>", "|", "!", "()[]{}/\\_=+~^`@")
_KIND = np.full(256, len(_GROUPS), np.uint8)
for _i, _g in enumerate(_GROUPS):
    _KIND[[ord(c) for c in _g]] = _i
KINDS = len(_GROUPS) + 1
OWN = 3 * KINDS + 8


def line_bounds(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, stop, ended, counts): each line's bytes, whether a line end follows, and lines of each text. An empty text has one empty line."""
    n = len(off) - 1
    ends = np.flatnonzero(data == 10)
    counts = np.bincount(np.searchsorted(off, ends, "right") - 1, minlength=n) + 1
    stop = np.empty(counts.sum(), np.int64)
    last = np.cumsum(counts) - 1
    stop[last] = off[1:]
    ended = np.ones(len(stop), bool)
    ended[last] = False
    stop[ended] = ends
    start = np.empty_like(stop)
    start[0:1] = 0
    start[1:] = stop[:-1] + ended[:-1]
    start[np.append(0, last[:-1] + 1)] = off[:-1]
    return start, stop, ended, counts


def own_features(data: np.ndarray, start: np.ndarray, stop: np.ndarray, ended: np.ndarray) -> np.ndarray:
    """A line's own features: shares of the character kinds, each also as a square root and as a flag;
    its length, words, mean word length, shares of short and of long words and of words like the one before, whether it is empty.

    data: the bytes of these lines, one after another with their ends; start and stop count from its beginning.
    """
    n, length = len(stop), stop - start
    line = np.repeat(np.arange(n), length + ended)  # a line's end counts to it
    kind = np.bincount(line * KINDS + _KIND[data], minlength=n * KINDS).reshape(-1, KINDS).astype(np.float32)
    kind[:, KINDS - 1] -= ended
    share = kind / np.maximum(length, 1)[:, None]
    keep = ~SEPARATOR[data]
    first = keep.copy()
    first[1:] &= ~keep[:-1]
    inner = start[start < len(keep)]  # texts touch where no line end parts them
    first[inner] |= keep[inner]
    at = np.flatnonzero(first)
    before = np.cumsum(keep, dtype=np.int64)
    bounds = np.append(before[at] - 1, int(keep.sum()))
    word_len, word_line = np.diff(bounds), line[at]
    words = np.bincount(word_line, minlength=n).astype(np.float32)
    some = np.maximum(words, 1)
    mean = np.bincount(word_line, word_len, n) / some
    short = np.bincount(word_line, word_len <= 3, n) / some
    long_ = np.bincount(word_line, word_len >= 12, n) / some
    hashed = word_hashes(data[keep], bounds)
    like = np.zeros(len(hashed), bool)
    like[1:] = (hashed[1:] == hashed[:-1]) & (word_line[1:] == word_line[:-1])
    like = np.bincount(word_line, like, n) / some
    return np.column_stack([share, np.sqrt(share), share > 0.02, like, like > 0.3, np.log1p(length) / 5, np.log1p(words) / 4, mean / 8, short, long_, length == 0]).astype(np.float32)


def _blocks(data: np.ndarray, start: np.ndarray, stop: np.ndarray, ended: np.ndarray, most: int = BLOCK_LINES) -> Iterator[tuple[slice, np.ndarray]]:
    """Own features of at most `most` lines at a time."""
    for i in range(0, len(stop), most):
        own = slice(i, min(i + most, len(stop)))
        a, b = start[i], stop[own.stop - 1] + ended[own.stop - 1]
        yield own, own_features(data[a:b], start[own] - a, stop[own] - a, ended[own])


def line_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of each line, bytes of each line, lines of each text): its own, those of the lines before and after it in its text, and a one."""
    data, off = buffers(texts)
    start, stop, ended, counts = line_bounds(data, off)
    own = np.concatenate([np.zeros((0, OWN), np.float32), *(x for _, x in _blocks(data, start, stop, ended))])
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    last = np.cumsum(counts) - 1
    before[np.append(0, last[:-1] + 1)] = 0
    after[last] = 0
    return np.hstack([own, before, after, np.ones((len(own), 1), np.float32)]), stop - start, counts


def node_scores(texts: pa.Array, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features times w for each line, bytes of each line, lines of each text), with the features of BLOCK_LINES lines at a time."""
    data, off = buffers(texts)
    start, stop, ended, counts = line_bounds(data, off)
    parts = np.empty((3, len(stop)))
    for lines, own in _blocks(data, start, stop, ended):
        for j in range(3):
            parts[j, lines] = own @ w[j * OWN : (j + 1) * OWN]
    node = parts[0] + w[-1]
    last = np.cumsum(counts) - 1
    follows, goes_on = np.ones(len(stop), bool), np.ones(len(stop), bool)
    follows[np.append(0, last[:-1] + 1)] = False
    goes_on[last] = False
    node[1:] += np.where(follows[1:], parts[1, :-1], 0)
    node[:-1] += np.where(goes_on[:-1], parts[2, 1:], 0)
    return node, stop - start, counts


def _products(m: np.ndarray, most: int) -> np.ndarray:
    """For each place of a row of 2 x 2 matrices (2, 2, n) the product of the `most` matrices, or more, that end there, to a factor."""
    span = 1
    while span < most:
        left, right = m[:, :, :-span], m[:, :, span:]
        both = left[:, 0, None] * right[None, 0] + left[:, 1, None] * right[None, 1]
        m = np.concatenate([m[:, :, :span], both / both.sum((0, 1))], 2)
        span *= 2
    return m


class Chains:
    """Lines of many texts one after another, for passes over all chains at once."""

    def __init__(self, counts: np.ndarray):
        self.most = int(counts.max(initial=0))
        self.first = np.cumsum(counts) - counts
        self.inner = np.ones(int(counts.sum()), bool)  # all lines that follow one of their text
        self.inner[self.first] = False

    def marginals(self, node: np.ndarray, trans: np.ndarray, pairs: bool = True, block: int = BLOCK_LINES) -> tuple[np.ndarray, np.ndarray]:
        """Forward-backward with two states: P(good) of each line; expected transitions, 2 x 2 (only if asked for).

        node: log score of good over bad for each line; trans: log score of (from, to).
        Messages are products of one matrix a line, formed over spans that double, a
        block of lines at a time. A text's first matrix has equal rows, so nothing comes
        over from the text before.
        """
        n = len(node)
        if not n:
            return np.zeros(0), np.zeros((2, 2))
        t = np.exp(trans)

        def matrices(i: int, j: int) -> np.ndarray:
            x = np.clip(node[i:j], -30, 30)
            e = np.stack([1 / (1 + np.exp(x)), 1 / (1 + np.exp(-x))])
            m = t[:, :, None] * e[None]
            starts = np.flatnonzero(~self.inner[i:j])
            m[:, :, starts] = e[None, :, starts]
            return m

        def passed(m: np.ndarray, v: np.ndarray) -> np.ndarray:
            """The vector v times the matrices up to each place, each to a factor."""
            p = _products(m, min(self.most, m.shape[2]))
            out = v[0] * p[0] + v[1] * p[1]
            return out / out.sum(0)

        fwd, v = np.empty((2, n)), np.full(2, 0.5)
        for i in range(0, n, block):
            j = min(i + block, n)
            fwd[:, i:j] = passed(matrices(i, j), v)
            v = fwd[:, j - 1]
        good, expected, v = np.empty(n), np.zeros((2, 2)), np.full(2, 0.5)
        for i in reversed(range(0, n, block)):
            j = min(i + block, n)
            m = matrices(i, min(j + 1, n))
            behind = np.ones((2, 2, j - i))
            behind[:, :, : m.shape[2] - 1] = m[:, :, 1:]
            behind[:, :, np.append(~self.inner[i + 1 : j + 1], np.ones(j + 1 - i - m.shape[2], bool))] = 1.0  # a text's last line
            back = passed(behind.transpose(1, 0, 2)[:, :, ::-1], v)[:, ::-1]
            v = back[:, 0]
            p = fwd[:, i:j] * back
            good[i:j] = p[1] / p.sum(0)
            if pairs:
                k = np.flatnonzero(self.inner[i:j])
                joint = fwd[:, None, i + k - 1] * m[:, :, k] * back[None, :, k]
                expected += (joint / joint.sum((0, 1))).sum(2)
        return good, expected


class LineCrf:
    def __init__(self, width: int):
        self.w, self.trans = np.zeros(width), np.zeros((2, 2))
        self.scale = (1.0, 0.0)

    def fit(self, x: np.ndarray, counts: np.ndarray, y: np.ndarray, steps: int = STEPS, rate: float = 0.05, ridge: float = 1e-4) -> None:
        """Adam on the conditional likelihood: observed less expected features and transitions."""
        chains = Chains(counts)
        first = np.zeros(len(y), bool)
        first[np.cumsum(counts) - counts] = True
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[:-1][~first[1:]], y[1:][~first[1:]]), 1)
        theta = np.concatenate([self.w, self.trans.ravel()])
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for k in range(1, steps + 1):
            p, pairs = chains.marginals(x @ theta[:-4], theta[-4:].reshape(2, 2))
            g = np.concatenate([x.T @ (y - p), (seen - pairs).ravel()]) / len(y) - ridge * theta
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            theta = theta + rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
        self.w, self.trans = theta[:-4], theta[-4:].reshape(2, 2)

    def quality(self, node: np.ndarray, length: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(P(good) of each line, mean over each text weighted by line length), from node_scores."""
        p, _ = Chains(counts).marginals(node, self.trans, pairs=False)
        weight = length + 1e-6
        at = np.cumsum(counts) - counts
        return p, np.add.reduceat(p * weight, at) / np.add.reduceat(weight, at)

    def score(self, mean: np.ndarray) -> np.ndarray:
        a, b = self.scale
        return 1 / (1 + np.exp(-np.clip(a * (mean - 0.5) + b, -30, 30)))


def train(texts: list[str | None], labels: list[int]) -> LineCrf:
    """Fit on documents' labels.

    A document's lines first take its label. In each later round, lines of bad
    documents that the field itself finds good are good, but for the worst line of
    each. Last, a rising logistic curve maps mean line quality to a probability.
    """
    x, length, counts = line_features(pa.array(texts, pa.string()))
    doc = np.asarray(labels)
    y = np.repeat(doc, counts)
    model = LineCrf(x.shape[1])
    for _ in range(ROUNDS):
        model.fit(x, counts, y)
        p, _ = model.quality(x @ model.w, length, counts)
        worst = np.repeat(np.minimum.reduceat(p, np.cumsum(counts) - counts), counts)
        y = np.where((np.repeat(doc, counts) == 0) & ((p < 0.5) | (p <= worst)), 0, 1)
    _, mean = model.quality(x @ model.w, length, counts)
    a, b = 4.0, 0.0
    weight = np.where(doc == 1, 0.5 / max(1, (doc == 1).sum()), 0.5 / max(1, (doc == 0).sum()))
    for _ in range(400):
        s = 1 / (1 + np.exp(-np.clip(a * (mean - 0.5) + b, -30, 30)))
        a, b = max(0.1, a + 5 * float((weight * (doc - s) * (mean - 0.5)).sum())), b + 2 * float((weight * (doc - s)).sum())
    model.scale = (a, b)
    return model


def training_sample(docs: DataFrame, labels: DataFrame, train_on, most: int = SAMPLE_DOCS, most_bytes: int = SAMPLE_BYTES, most_lines: int = SAMPLE_LINES) -> DataFrame:
    """(doc_id, text, quality): whole texts of labelled documents, of each label those of least hash.

    At most `most` documents of a label, as many as start within `most_bytes` of text and
    `most_lines` lines: fewer where texts are long. A text that is longer than that by
    itself isn't sampled; rows that repeat count once. Ids and sizes are ranked, and
    the texts of the chosen ones fetched after that.
    """
    known = labels.filter(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("quality")).filter(train_on)
    counts = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    h = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30))
    part = {q: int(min(1.0, 2 * most / n) * (1 << 30)) for q, n in counts.items()}  # about twice as many, then exactly
    keep = F.lit(False)
    for q, p in part.items():
        keep = keep | ((F.col("quality") == q) & (h < p))
    near = docs.filter(h < max(part.values(), default=0)).select("doc_id", "text", F.xxhash64("text").alias("_th"))
    size, lines = F.coalesce(F.octet_length("text"), F.lit(0)), F.coalesce(F.regexp_count("text", F.lit("\n")), F.lit(0)) + 1
    sizes = near.select("doc_id", "_th", size.alias("_size"), lines.alias("_lines")).filter((F.col("_size") <= most_bytes) & (F.col("_lines") <= most_lines)).distinct()
    order = Window.partitionBy("quality").orderBy(h, "doc_id", "_th")
    ranked = sizes.join(known.filter(keep), "doc_id").withColumn("_rank", F.row_number().over(order))
    sofar = order.rowsBetween(Window.unboundedPreceding, 0)
    ranked = ranked.withColumns({f"_before{c}": F.sum(c).over(sofar) - F.col(c) for c in ("_size", "_lines")})
    chosen = ranked.filter((F.col("_rank") <= most) & (F.col("_before_size") < most_bytes) & (F.col("_before_lines") < most_lines)).select("doc_id", "_th", "quality")
    return near.join(F.broadcast(chosen), ["doc_id", "_th"]).dropDuplicates(["doc_id", "_th"]).select("doc_id", "text", "quality")  # at most `most` of each label


def score_quality(docs: DataFrame, labels: DataFrame, train_on=None, carry: list[str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """score, predicted and counts of lines for every whole text.

    Learns from documents that `labels` marks and `train_on` allows (default:
    crc32(doc_id) mod 5 is not 0), of each label at most SAMPLE_DOCS and about
    SAMPLE_BYTES or SAMPLE_LINES, whole texts, which bounds what the driver holds. score: the length-weighted mean of the lines'
    P(good), mapped to a probability. Null and empty texts are one empty line. If
    no label of both kinds can be learned from, score is 0.5. Labels for unknown
    documents are ignored; of contradictory ones 0 holds. `carry` adds columns of
    docs. Repeated rows each return a row; an empty table gives an empty result.
    Very long texts are scored whole, as one chain. Equal texts have equal scores;
    columns that aren't carried, whatever their names, aren't looked at.
    """
    small_batches(docs.sparkSession, SMALL_BATCH_BYTES)
    train_on = ~held_out("doc_id", 5, 0) if train_on is None else train_on
    rows = sorted(((r["doc_id"], r["text"] or "", r["quality"]) for r in training_sample(docs, labels, train_on).collect()))
    model = train([t for _, t, _ in rows], [q for *_, q in rows]) if len({q for *_, q in rows}) == 2 else None
    carry = list(carry or [])
    text = f"_c{carry.index('text')}" if "text" in carry else "_text"  # one copy of a text in a batch

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text, 1 << 20):
            node, length, counts = node_scores(batch.column(text), np.zeros(3 * OWN + 1) if model is None else model.w)
            if model is None:
                p, score = np.full(len(node), 0.5), np.full(len(counts), 0.5)
            else:
                p, mean = model.quality(node, length, counts)
                score = model.score(mean)
            bad = np.add.reduceat((p < 0.5).astype(np.int64), np.cumsum(counts) - counts)
            fixed = [batch.column("_id"), batch.column("_held"), pa.array(score), pa.array((score >= threshold).astype(np.int32)), pa.array(counts.astype(np.int64)), pa.array(bad)]
            more = [batch.column(f"_c{i}") for i in range(len(carry))]
            yield pa.RecordBatch.from_arrays(fixed + more, ["doc_id", "held_out", "score", "predicted", "n_lines", "bad_lines", *[f"_c{i}" for i in range(len(carry))]])

    base = docs.select(F.col("doc_id").alias("_id"), held_out("doc_id", 5, 0).alias("_held"), *([F.col("text").alias("_text")] if text == "_text" else []), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)])
    kinds = dict(docs.dtypes)
    schema = "doc_id long, held_out boolean, score double, predicted int, n_lines long, bad_lines long" + "".join(f", _c{i} {kinds[c]}" for i, c in enumerate(carry))
    return base.mapInArrow(run, schema)


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that the classifier doesn't reject, with the columns they came with, whatever their names.

    Null and empty texts are scored like any other; rows that repeat go or stay
    together. An empty table gives an empty result.
    """
    scored = score_quality(docs, labels, carry=docs.columns, **options)
    return scored.filter("predicted = 1").select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns)])
