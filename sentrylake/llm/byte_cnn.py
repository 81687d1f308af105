"""Operator 10: language identification by a byte convolutional network trained in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentrylake.llm.text import buffers, held_out, places, sliced, small_batches

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8
DIM = 8
#: Bounds of the training sample: documents of each language, of all together (but one of each language), and pieces of a text, WINDOW characters each.
SAMPLE_DOCS, ALL_DOCS = 1500, 96_000
PIECES = 4
PAD = 256


class ByteCnn:
    """Byte embedding, filters of several widths with ReLU, max over the window, softmax."""

    def __init__(self, classes: int, seed: int = 7):
        r = np.random.default_rng(seed)
        self.embed = r.normal(0, 0.5, (257, DIM)).astype(np.float32)
        self.embed[PAD] = 0
        self.conv = [r.normal(0, (2 / (w * DIM)) ** 0.5, (w * DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = r.normal(0, 0.2, (FILTERS * len(WIDTHS), classes)).astype(np.float32)
        self.shift = np.zeros(classes, np.float32)

    def params(self) -> list[np.ndarray]:
        return [self.embed, *self.conv, *self.bias, self.out, self.shift]

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, rate: float = 0.01, size: int = 128, seed: int = 11) -> None:
        """Adam on cross-entropy; x: windows of bytes (PAD where short), y: classes."""
        r = np.random.default_rng(seed)
        m, v, step = [np.zeros_like(p) for p in self.params()], [np.zeros_like(p) for p in self.params()], 0
        for _ in range(epochs):
            for at in np.array_split(r.permutation(len(x)), max(1, len(x) // size)):
                xb, yb = x[at], y[at]
                e, n = self.embed[xb], len(at)
                cols, hits, pooled = [], [], []
                for w, k, b in zip(WIDTHS, self.conv, self.bias, strict=True):
                    c = np.concatenate([e[:, j : xb.shape[1] - w + 1 + j] for j in range(w)], axis=2)
                    z = c @ k + b
                    hit = z.argmax(1)
                    cols.append(c)
                    hits.append(hit)
                    pooled.append(np.take_along_axis(z, hit[:, None], 1)[:, 0])
                h = np.concatenate(pooled, 1)
                a = np.maximum(h, 0)
                s = a @ self.out + self.shift
                p = np.exp(s - s.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(n), yb] -= 1
                p /= n
                g_out, g_shift, g_h = a.T @ p, p.sum(0), (p @ self.out.T) * (h > 0)
                g_embed, g_conv, g_bias = np.zeros_like(self.embed), [], []
                for i, w in enumerate(WIDTHS):
                    gh, hit = g_h[:, i * FILTERS : (i + 1) * FILTERS], hits[i]
                    picked = np.take_along_axis(cols[i], hit[:, :, None], 1)  # n, filters, w * dim
                    g_conv.append(np.einsum("nfd,nf->df", picked, gh))
                    g_bias.append(gh.sum(0))
                    back = np.einsum("nf,df->nfd", gh, self.conv[i]).reshape(n, FILTERS, w, DIM)
                    for j in range(w):
                        np.add.at(g_embed, np.take_along_axis(xb, hit + j, 1).ravel(), back[:, :, j].reshape(-1, DIM))
                g_embed[PAD] = 0
                step += 1
                for p_, g, m_, v_ in zip(self.params(), [g_embed, *g_conv, *g_bias, g_out, g_shift], m, v, strict=True):
                    m_ += 0.1 * (g - m_)
                    v_ += 0.001 * (g * g - v_)
                    p_ -= rate * (m_ / (1 - 0.9**step)) / (np.sqrt(v_ / (1 - 0.999**step)) + 1e-8)

    def tables(self) -> list[np.ndarray]:
        """For each width, what a byte adds to each filter at each offset: (width, 257, filters)."""
        return [np.stack([self.embed @ k[j * DIM : (j + 1) * DIM] for j in range(w)]) for w, k in zip(WIDTHS, self.conv, strict=True)]

    def log_probs(self, x: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
        pooled = []
        for w, t, b in zip(WIDTHS, tables, self.bias, strict=True):
            n = x.shape[1] - w + 1
            z = t[0][x[:, :n]]
            for j in range(1, w):
                z += t[j][x[:, j : j + n]]
            pooled.append(z.max(1) + b)
        s = np.maximum(np.concatenate(pooled, 1), 0) @ self.out + self.shift
        s -= s.max(1, keepdims=True)
        return s - np.log(np.exp(s).sum(1, keepdims=True))


def windows_of(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All windows of all texts, padded at each text's end, and the text of each; an empty text has one."""
    sizes = np.diff(off)
    counts = np.maximum(1, -(-sizes // WINDOW))
    group, place = places(counts)
    x = np.full((len(group), WINDOW), PAD, np.int16)
    doc, within = places(sizes)
    row = (np.cumsum(counts) - counts)[doc] + within // WINDOW
    x[row, within % WINDOW] = data
    return x, group


def sample(docs: DataFrame, languages: list[str], counts: dict[str, int], most: int = SAMPLE_DOCS) -> DataFrame:
    """About `most` documents of each language, those of least hash; a bounded training sample.

    A text longer than PIECES windows gives PIECES of them, from its start to its end at even distances.
    """
    parts = docs.sparkSession.createDataFrame([(x, int(min(1.0, most / counts[x]) * (1 << 30))) for x in languages], "lang string, part long")
    picked = docs.join(F.broadcast(parts), "lang").filter(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30)) < F.col("part"))
    size = F.length("text")
    pieces = [F.substring("text", F.floor((size - WINDOW) * i / (PIECES - 1)).cast("int") + 1, F.lit(WINDOW)) for i in range(PIECES)]
    return picked.select("lang", F.explode(F.when(size > PIECES * WINDOW, F.array(*pieces)).otherwise(F.array("text"))).alias("text"))


def identify_language(docs: DataFrame, train_on=None) -> DataFrame:
    """lang_pred and score for every whole text.

    Training: rows where `train_on` (default: crc32(doc_id) mod 3 is not 1) with a
    language and a text; of every language a sample of SAMPLE_DOCS documents, fewer
    where all would be more than ALL_DOCS, and windows spread over each whole text. Prediction: the whole text in windows of WINDOW
    bytes; log probabilities are averaged over windows, weighted by their bytes.

    Null text and text without a letter give ``und`` with score 0; so does every
    text if nothing can be learned from. Repeated rows each return a row. Of languages
    with equal log probability the first by code points is taken. Texts are read whole,
    however long; columns other than doc_id, text and (to learn from) lang, whatever
    their names, aren't looked at. An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    train_on = ~held_out("doc_id", 3, 1) if train_on is None else train_on
    known = docs.filter(train_on & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(counts)
    most = min(SAMPLE_DOCS, max(1, ALL_DOCS // max(1, len(languages))))
    rows = sample(known, languages, counts, most).collect() if languages else []
    rows = sorted((r["lang"], r["text"]) for r in rows)
    model = tables = None
    if rows:
        data, off = buffers(pa.array([t for _, t in rows], pa.string()))
        x, group = windows_of(data, off)
        y = np.array([languages.index(lang) for lang, _ in rows])[group]
        model = ByteCnn(len(languages))
        full = (x != PAD).sum(1) >= 16
        full = full if full.any() else np.ones(len(x), bool)
        model.train(x[full], y[full])
        tables = model.tables()

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", 1 << 20):
            data, off = buffers(batch.column("text"))
            n = batch.num_rows
            lang, score = np.full(n, "und", object), np.zeros(n)
            if model is not None:
                x, group = windows_of(data, off)
                weight = (x != PAD).sum(1) + 1e-9
                total, mass = np.zeros((n, len(languages))), np.zeros(n)
                for i in range(0, len(x), 256):
                    at = slice(i, i + 256)
                    np.add.at(total, group[at], model.log_probs(x[at], tables) * weight[at, None])
                np.add.at(mass, group, weight)
                total /= mass[:, None]
                best = total.argmax(1)
                prob = np.exp(total - total.max(1, keepdims=True))
                has = np.asarray(batch.column("has_letter").to_numpy(zero_copy_only=False), bool)
                lang = np.where(has, np.array(languages, object)[best], "und")
                score = np.where(has, 1 / prob.sum(1), 0.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(lang.tolist(), pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"]
            )

    base = docs.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), F.col("text"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("has_letter"))
    return base.mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double")
