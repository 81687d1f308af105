"""Operator 13: phrases whose words stand together more often than apart.

Only the longest windows are counted: the columns of a row are a word and the four after
it in its piece, padded where the piece ends. A ROLLUP over these columns sums them to
all shorter prefixes, so every phrase's count comes from one pass, without a pass for
each length. A window also ends before a word, a pair or three words that are too rare to
belong to any candidate (no part of a phrase is rarer than the phrase), which leaves few
windows; pairs and threes are only sieved, by filters of a fixed size that may let more
through. Words travel as hashes of (language, word); hashes of two words that are both
met are told apart by another seed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sentrylake.llm.text import LOWER, as_strings, bit_filter, buffers, cut, inside, mix64, signed, sliced, small_batches, word_hashes

#: Words of the longest phrase, occurrences of a candidate, and rows of a language's report.
LONGEST, LEAST, REPORT = 5, 100, 2000
#: Sieves before the windows are counted: of pairs, then of three words.
SIEVES = 2
#: Bytes of text that are turned into arrays at a time, and whose counts a task adds up before it sends them.
SLICE_BYTES, GATHER_BYTES = 1 << 20, 16 << 20
UNKNOWN = "und"
#: In decimals of up to 37 digits.
SCORE = "cast(1000 * a as decimal(18, 0)) * cast(n as decimal(18, 0)) div (cast(l as decimal(18, 0)) * cast(r as decimal(18, 0)))"
_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".,;:!?"] + [10, 11, 12, 13]] = True  # of pieces
_BREAK = _ENDS.copy()
_BREAK[[0x20, 0x09]] = True
_MORE = np.uint64(0xC2B2AE3D27D4EB4F)
#: Bits by which sequences are counted for the sieves: fewer cost less to send; those that share them only let more windows through.
SIEVE_BITS = np.uint64((1 << 40) - 1)


def piece_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all words joined, lower-cased; word bounds in them; words per text; whether a word follows the one before in its piece)."""
    data, off = buffers(texts)
    keep = ~_BREAK[data]
    first = keep.copy()
    first[1:] &= ~keep[:-1]
    inner = off[:-1][off[:-1] < len(keep)]
    first[inner] |= keep[inner]
    starts = np.flatnonzero(first)
    piece = np.cumsum(_ENDS[data], dtype=np.int64)[starts]
    text = np.searchsorted(off, starts, "right") - 1
    follows = np.zeros(len(starts), bool)
    follows[1:] = (piece[1:] == piece[:-1]) & (text[1:] == text[:-1])
    before = np.cumsum(keep, dtype=np.int64)
    return LOWER[data[keep]], np.append(before[starts] - 1, int(keep.sum())), np.diff(np.searchsorted(starts, off)), follows


def word_keys(langs: pa.Array, body: np.ndarray, bounds: np.ndarray, counts: np.ndarray, seed: int) -> np.ndarray:
    """A uint64, never 0, for each word together with its text's language (counts: words of each)."""
    data, off = buffers(langs)
    lang = mix64(word_hashes(data, off) + np.uint64(seed))
    with np.errstate(over="ignore"):
        return np.maximum(mix64(word_hashes(body, bounds) ^ np.repeat(lang, counts)), np.uint64(1))


def may_stand(keys: np.ndarray, follows: np.ndarray, words: np.ndarray, sieves: list[np.ndarray], upto: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For 2 to `upto` words from each place on: (their hash, whether they lie in one piece and no sieve that there is finds their words, pairs, ... too rare)."""
    known, n = inside(words, keys), len(keys)
    stand, h, out = np.zeros(n, bool), keys, []
    stand[: n - 1] = follows[1:] & known[1:] & known[:-1]
    for k in range(2, upto + 1):
        mixed = np.zeros(n, np.uint64)
        with np.errstate(over="ignore"):
            mixed[: max(0, n - k + 1)] = mix64(h[: max(0, n - k + 1)] * _MORE + keys[k - 1 :])
        h = mixed
        if k > 2:
            stand = stand & np.append(stand[1:], False)
        if k - 2 < len(sieves):
            at = np.flatnonzero(stand)
            stand[at] = inside(sieves[k - 2], h[at] & SIEVE_BITS)
        out.append((h, stand))
    return out


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n) of every word. docs: (lang, text), lang not null."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in sliced(batches, "text", SLICE_BYTES):
            body, bounds, counts, _ = piece_words(batch.column("text"))
            langs = batch.column("lang").dictionary_encode()
            lang = pa.DictionaryArray.from_arrays(pa.array(np.repeat(np.asarray(langs.indices), counts)), langs.dictionary).cast(pa.string())
            parts.append(pa.table({"lang": lang, "word": as_strings(body, bounds), "n": pa.array(np.ones(len(lang), np.int64))}).group_by(["lang", "word"]).aggregate([("n", "sum")]))
            size += len(body)
            if size >= GATHER_BYTES:
                yield from added(parts)
                parts, size = [], 0
        if parts:
            yield from added(parts)

    def added(parts: list[pa.Table]) -> list[pa.RecordBatch]:
        t = pa.concat_tables(parts).group_by(["lang", "word"]).aggregate([("n_sum", "sum")])
        return t.rename_columns({"n_sum_sum": "n"}).select(["lang", "word", "n"]).to_batches(max_chunksize=1 << 16)

    return docs.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def keyed(counts: DataFrame, seed: int) -> DataFrame:
    """Adds w, the word's key; the same that word_keys gives in a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, bounds = buffers(batch.column("word"))
            keys = word_keys(batch.column("lang"), body, bounds, np.ones(batch.num_rows, np.int64), seed)
            yield pa.RecordBatch.from_arrays([*batch.columns, signed(keys)], ["lang", "word", "n", "w"])

    return counts.select("lang", "word", "n").mapInArrow(run, "lang string, word string, n long, w long")


def sieve_counts(docs: DataFrame, words, sieves: list, seed: int) -> DataFrame:
    """(p, n): how often each sequence of words, one longer than the last sieve's, stands in a piece; p: a hash of its keys. Only of those that pass the sieves."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", 4 * SLICE_BYTES):
            body, bounds, counts, follows = piece_words(batch.column("text"))
            keys = word_keys(batch.column("lang"), body, bounds, counts, seed)
            if len(keys):
                h, stand = may_stand(keys, follows, words.value, [x.value for x in sieves], len(sieves) + 2)[-1]
                p, n = np.unique(h[stand] & SIEVE_BITS, return_counts=True)
                yield pa.RecordBatch.from_arrays([signed(p), pa.array(n.astype(np.int64))], ["p", "n"])

    return docs.mapInArrow(count, "p long, n long").groupBy("p").agg(F.sum("n").alias("n"))


def windows(docs: DataFrame, words, sieves: list, seed: int, longest: int = LONGEST) -> DataFrame:
    """(w1 .. w5): each word and those after it, as far as its piece and the sieves go; 0 is padding. Windows of one word are left out."""
    names = [f"w{i}" for i in range(1, longest + 1)]

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", SLICE_BYTES):
            body, bounds, counts, follows = piece_words(batch.column("text"))
            keys = word_keys(batch.column("lang"), body, bounds, counts, seed)
            if not len(keys):
                continue
            (_, two), (_, three) = may_stand(keys, follows, words.value, [x.value for x in sieves], 3)
            at = np.flatnonzero(two)
            padded, three = np.append(keys, np.zeros(longest, np.uint64)), np.append(three, np.zeros(longest, bool))
            columns, still = [keys[at], padded[at + 1]], np.ones(len(at), bool)
            for k in range(2, longest):
                still = still & three[at + k - 2]
                columns.append(np.where(still, padded[at + k], np.uint64(0)))
            yield pa.RecordBatch.from_arrays([signed(c) for c in columns], names)

    return docs.mapInArrow(lead, ", ".join(f"{n} long" for n in names))


def phrase_counts(rows: DataFrame, least: int = LEAST) -> DataFrame:
    """(ws, a): phrases of two words and more that stand `least` times or more, as lists of keys; by a ROLLUP over the window's columns."""
    names = rows.columns
    summed = rows.withColumn("_head", F.struct(*names[:2])).rollup("_head", *names[2:]).agg(F.count("*").alias("a"), F.grouping_id().alias("_g"))
    level = F.lit(len(names)) - F.bit_count("_g").cast("int")  # columns that aren't rolled up; of the head two
    length = F.when(F.col("_head").isNotNull(), level)
    kept = summed.filter((F.col("a") >= least) & length.isNotNull())
    ws = F.array(F.col("_head")[names[0]], F.col("_head")[names[1]], *[F.col(n) for n in names[2:]])
    return kept.select(F.slice(ws, 1, length).alias("ws"), "a").filter(F.element_at("ws", -1) != 0)


def frequent_words(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, int]:
    """(table of all words, seed): with the first seed by which no frequent word shares its key with another word."""
    counts, seed = cut(word_counts(docs)), 0
    while True:
        table = cut(keyed(counts, seed))
        shared = table.groupBy("w").agg(F.count("*").alias("k"), F.max("n").alias("n")).filter((F.col("k") > 1) & (F.col("n") >= least))
        if shared.isEmpty():
            return table, seed
        seed += 1


def mine_phrases(docs: DataFrame, least: int = LEAST, report: int = REPORT) -> DataFrame:
    """The `report` best phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Null languages count as `und`, null texts as empty. A phrase of two to five words
    that stands `least` times or more is a candidate; its score is that of its weakest
    cut into two parts, floor(1000 a n / (l r)) in exact decimals, of equal ones the
    earliest. Candidates that always stand inside a longer one are dropped. An empty
    table gives an empty result; repeated rows count each; columns other than lang and
    text aren't looked at. Long texts are read whole.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    table, seed = frequent_words(docs, least)
    totals = table.groupBy("lang").agg(F.sum("n").alias("n"))
    frequent = table.filter(F.col("n") >= least)
    words = bit_filter(frequent, "w")
    sieves: list = []
    for _ in range(SIEVES):
        sieves.append(bit_filter(sieve_counts(docs, words, sieves, seed).filter(F.col("n") >= least), "p"))
    found = cut(phrase_counts(windows(docs, words, sieves, seed), least))
    parts = found.unionByName(frequent.select(F.array("w").alias("ws"), F.col("n").alias("a")))

    # a phrase inside a longer one that stands as often also is the beginning or the end of one a word longer that does
    longer = found.filter(F.size("ws") > 2)
    ends = F.array(F.slice("ws", F.lit(1), F.size("ws") - 1), F.slice("ws", F.lit(2), F.size("ws") - 1))
    covered = longer.select(F.explode(ends).alias("ws"), "a").groupBy("ws").agg(F.max("a").alias("most"))
    kept = found.join(covered, "ws", "left").filter(F.col("most").isNull() | (F.col("most") < F.col("a"))).select("ws", "a")

    cuts = kept.select("ws", "a", F.explode(F.sequence(F.lit(1), F.size("ws") - 1)).alias("k"))
    cuts = cuts.withColumn("left", F.slice("ws", F.lit(1), F.col("k"))).withColumn("right", F.slice("ws", F.col("k") + 1, F.size("ws") - F.col("k")))
    cuts = cuts.join(parts.select(F.col("ws").alias("left"), F.col("a").alias("l")), "left").join(parts.select(F.col("ws").alias("right"), F.col("a").alias("r")), "right").drop("left", "right")
    named = frequent.join(totals.withColumnRenamed("n", "total"), "lang").select("lang", "word", "w", "total")
    spelled = kept.select("ws", F.posexplode("ws").alias("place", "w")).join(named, "w").groupBy("ws").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda x: x["word"]), " ").alias("phrase"), F.first("lang").alias("lang"), F.first("total").alias("n"),
    )
    scored = cuts.join(spelled, "ws").withColumn("score", F.expr(SCORE))
    weakest = scored.groupBy("ws", "lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("m")).select("lang", "phrase", "a", "m.l", "m.r", "n", "m.score")

    order = (F.desc("score"), F.desc("a"), "phrase")
    some = F.pmod(F.xxhash64("phrase"), F.lit(int(spark.conf.get("spark.sql.shuffle.partitions"))))
    first = weakest.withColumn("_part", some).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).filter(F.col("rank") <= report)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= report)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
