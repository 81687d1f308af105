"""Operator 1: quality rules by divergence from language references."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sentrylake.llm.text import SEPARATOR, as_strings, buffers, cut, places, sliced, small_batches, window_hashes, word_hashes, words_of

#: Words that make a language's word histogram.
COMMON = 40
#: References that a text is held against at a time, and bytes of text whose counts a task adds up.
REFERENCES, GATHER_BYTES = 64, 16 << 20
#: Guards: a histogram of fewer characters or words is too noisy to judge by.
LEAST_CHARS, LEAST_WORDS = 200, 50
#: Largest Jensen-Shannon distances (base 2, 0 to 1) of a kept document.
MOST_CLASS, MOST_WORD = 0.19, 0.36

LOWER, UPPER, DIGIT, SPACE, LINE, STOP, SYMBOL, BAR, BANG, OTHER, WIDE, INNER = range(12)
KINDS = 11  # INNER bytes, those inside a character, count nowhere


def _kinds() -> np.ndarray:
    k = np.full(256, OTHER, np.uint8)
    k[97:123], k[65:91], k[48:58] = LOWER, UPPER, DIGIT
    k[[32, 9, 11, 12, 13]], k[10] = SPACE, LINE
    for chars, kind in ((".,;:?'\"-", STOP), ("#*$%&<>", SYMBOL), ("|", BAR), ("!", BANG)):
        k[[ord(c) for c in chars]] = kind
    k[128:192], k[192:] = INNER, WIDE
    return k


KIND = _kinds()
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True


def _per_text(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[off[1:]] - total[off[:-1]]


def class_counts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    n = len(off) - 1
    doc = np.repeat(np.arange(n, dtype=np.int64), np.diff(off))
    return np.bincount(doc * (KINDS + 1) + KIND[data], minlength=n * (KINDS + 1)).reshape(n, -1)[:, :KINDS]


def repeated(group: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each item: whether an equal key comes earlier in its group, and whether one comes at all."""
    order = np.lexsort((np.arange(len(key)), key, group))
    g, k = group[order], key[order]
    same = (g[1:] == g[:-1]) & (k[1:] == k[:-1])
    earlier, any_ = np.zeros(len(key), bool), np.zeros(len(key), bool)
    earlier[order[1:]] = same
    any_[order[1:]] = same
    any_[order[:-1]] |= same
    return earlier, any_


def base_counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    data, off = buffers(texts)
    n = len(off) - 1
    body, bounds, counts = words_of(texts)
    out = {"n_words": counts, "word_chars": _per_text(~SEPARATOR[data] & (KIND[data] != INNER), off), "n_symbols": _per_text(SYMBOLS[data], off)}
    # lines, each with its end; the last gets none
    ends = np.flatnonzero(data == 10)
    cuts = np.unique(np.concatenate([off, ends + 1]))
    doc = np.searchsorted(off, cuts[:-1], "right") - 1
    closed = data[cuts[1:] - 1] == 10
    hashed = _line_hashes(data, cuts[:-1], cuts[1:] - closed)
    total = np.concatenate([[0], np.cumsum(~SEPARATOR[data], dtype=np.int64)])
    filled = total[cuts[1:]] > total[cuts[:-1]]
    earlier, _ = repeated(doc[filled], hashed[filled])
    out["n_dup_lines"] = np.bincount(doc[filled][earlier], minlength=n)
    # words inside a 3-word window that the text has twice
    wh = word_hashes(body, bounds)
    group, place = places(counts)
    wins = window_hashes(wh, 3)
    inside = place[: len(wins)] + 3 <= counts[group[: len(wins)]]
    _, twice = repeated(group[: len(wins)][inside], wins[inside])
    hit = np.zeros(len(wh) + 3, bool)
    at = np.flatnonzero(inside)[twice]
    for j in range(3):
        hit[at + j] = True
    out["n_repeat_words"] = np.bincount(group[hit[: len(wh)]], minlength=n)
    return out


def _line_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the spans [start, end); spans do not touch where a line end lies between."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    bounds = np.stack([starts, ends], 1).ravel()
    return word_hashes(data[: bounds[-1]], bounds)[::2]


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance, base 2, of each row of p to each row of q (counts; an empty row is at distance 1)."""
    p = p / np.maximum(p.sum(1, keepdims=True), 1e-300)
    q = q / np.maximum(q.sum(1, keepdims=True), 1e-300)
    a, b = p[:, None, :], q[None, :, :]
    m = (a + b) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        d = np.where(a > 0, a * np.log2(a / m), 0).sum(2) + np.where(b > 0, b * np.log2(b / m), 0).sum(2)
    return np.sqrt(np.clip(d / 2, 0, 1))


def language_references(docs: DataFrame) -> tuple[list[str], list[list[str]], np.ndarray, np.ndarray]:
    """(languages, their common words, class counts, word counts with the rest last), of every language and over all documents.

    Each task adds up some chunks' counts of (language, word) before the shuffle; a
    language's COMMON words are ranked by their whole counts.
    """
    small_batches(docs.sparkSession)
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in sliced(batches, "text"):
            lang = batch.column("lang").dictionary_encode()
            names, of = lang.dictionary, np.asarray(lang.indices)
            data, off = buffers(batch.column("text"))
            body, bounds, counts = words_of(batch.column("text"))
            coded = as_strings(body, bounds).dictionary_encode()
            v = len(coded.dictionary)
            at, n = np.unique(np.repeat(of, counts).astype(np.int64) * max(1, v) + np.asarray(coded.indices), return_counts=True)
            kinds = np.zeros((len(names), KINDS + 1), np.int64)
            np.add.at(kinds[:, :KINDS], of, class_counts(data, off))
            np.add.at(kinds[:, KINDS], of, counts)
            who = np.concatenate([at // max(1, v), np.repeat(np.arange(len(names)), KINDS + 1)])
            words = pa.concat_arrays([coded.dictionary.take(pa.array(at % max(1, v))), pa.nulls(kinds.size, coded.dictionary.type)])
            kind = np.concatenate([np.full(len(at), -1), np.tile(np.arange(KINDS + 1), len(names))]).astype(np.int32)
            parts.append(pa.table({"lang": names.take(pa.array(who)), "word": words, "kind": pa.array(kind), "n": pa.array(np.concatenate([n, kinds.ravel()]))}))
            size += batch.num_rows and int(off[-1])
            if size >= GATHER_BYTES:
                yield from added(parts)
                parts, size = [], 0
        if parts:
            yield from added(parts)

    def added(parts: list[pa.Table]) -> list[pa.RecordBatch]:
        t = pa.concat_tables(parts).group_by(["lang", "word", "kind"]).aggregate([("n", "sum")])
        return t.rename_columns({"n_sum": "n"}).select(["lang", "word", "kind", "n"]).to_batches(max_chunksize=1 << 16)

    found = cut(known.mapInArrow(count, "lang string, word string, kind int, n long").groupBy("lang", "word", "kind").agg(F.sum("n").alias("n")))
    classes, totals = {}, {}
    for r in found.filter(F.col("word").isNull()).collect():
        if r["kind"] == KINDS:
            totals[r["lang"]] = r["n"]
        else:
            classes.setdefault(r["lang"], np.zeros(KINDS))[r["kind"]] = r["n"]
    languages = sorted(totals)
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    best: dict[str, list] = {lang: [] for lang in languages}
    for r in found.filter(F.col("word").isNotNull()).withColumn("place", place).filter(F.col("place") <= COMMON).orderBy("lang", "place").collect():
        best[r["lang"]].append((r["word"], r["n"]))
    words = np.zeros((len(languages), COMMON + 1))
    for i, lang in enumerate(languages):
        words[i, : len(best[lang])] = [n for _, n in best[lang]]
        words[i, COMMON] = totals[lang] - words[i, :COMMON].sum()
    return languages, [[w for w, _ in best[lang]] for lang in languages], np.array([classes[lang] for lang in languages]).reshape(-1, KINDS), words


def word_index(body: np.ndarray, bounds: np.ndarray, vocabulary: list[str]) -> np.ndarray:
    """Place of each word in a small vocabulary, or -1."""
    if len(bounds) < 2 or not vocabulary:
        return np.full(len(bounds) - 1, -1)
    return np.asarray(pc.index_in(as_strings(body, bounds), pa.array(vocabulary)).fill_null(-1))


def distances(texts: pa.Array, common: list[list[str]], classes: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class and word distance of each text to each language."""
    data, off = buffers(texts)
    body, bounds, counts = words_of(texts)
    vocabulary = sorted({w for ws in common for w in ws})
    at = word_index(body, bounds, vocabulary)
    n, v = len(off) - 1, len(vocabulary)
    doc = np.repeat(np.arange(n), counts)
    have = np.bincount(doc[at >= 0] * v + at[at >= 0], minlength=n * v).reshape(n, v)
    far = np.ones((n, len(common)))
    for i, ws in enumerate(common):
        mine = np.zeros((n, COMMON + 1))
        mine[:, : len(ws)] = have[:, [vocabulary.index(w) for w in ws]]
        mine[:, COMMON] = counts - mine.sum(1)
        far[:, i] = js_distance(mine, words[i : i + 1])[:, 0]
    return js_distance(class_counts(data, off).astype(float), classes), far


def quality_rules(docs: DataFrame, most_class: float = MOST_CLASS, most_word: float = MOST_WORD) -> DataFrame:
    """Counts of each whole text, base_failed, and kept.

    A document is kept if base_failed is false and some language's reference is
    near: character classes within `most_class` and common words within
    `most_word`. A histogram under its guard (LEAST_CHARS, LEAST_WORDS) isn't held
    against a document. class_js and word_js are those of the language with the
    least sum. Null and empty text have no words and so fail the base; null
    languages give no reference; without any reference nothing is held against a
    document. Of languages at equal distance the first by code points is named.
    Repeated rows each return a row. Texts are read whole, however long; columns other
    than doc_id, text and lang, whatever their names, aren't looked at. An empty table
    gives an empty result.
    """
    languages, common, classes, words = language_references(docs)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            texts = batch.column("text")
            out = pd.DataFrame(base_counts(texts)).astype("int64")
            data, off = buffers(texts)
            failed = (out["n_words"] < 50) | (100 * out["n_repeat_words"] > 50 * out["n_words"])
            kept, cj, wj, name = ~failed, np.full(len(out), np.nan), np.full(len(out), np.nan), np.full(len(out), None, object)
            if languages:
                short_c = (_per_text(KIND[data] != INNER, off) < LEAST_CHARS)[:, None]
                short_w = (out["n_words"].to_numpy() < LEAST_WORDS)[:, None]
                row, any_near, cj, wj, at = np.arange(len(out)), np.zeros(len(out), bool), np.full(len(out), np.inf), np.full(len(out), np.inf), np.zeros(len(out), int)
                for i in range(0, len(languages), REFERENCES):
                    own = slice(i, i + REFERENCES)
                    by_class, by_word = distances(texts, common[own], classes[own], words[own])
                    any_near |= (((by_class <= most_class) | short_c) & ((by_word <= most_word) | short_w)).any(1)
                    best = (by_class + by_word).argmin(1)
                    c, w = by_class[row, best], by_word[row, best]
                    less = c + w < cj + wj
                    cj, wj, at = np.where(less, c, cj), np.where(less, w, wj), np.where(less, best + i, at)
                kept, name = kept & any_near, np.array(languages, object)[at]
            arrays = [batch.column("doc_id"), *[pa.array(out[c]) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]]
            arrays += [pa.array(np.asarray(failed)), pa.array(np.asarray(kept)), pa.array(cj, from_pandas=True), pa.array(wj, from_pandas=True), pa.array(list(name), pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, [f.split()[0] for f in SCHEMA.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(judge, SCHEMA)


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, class_js double, word_js double, nearest string"
