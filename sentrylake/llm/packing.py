"""Operator 3: best-fit packing, certified by lower bounds and repacked where they leave a gap."""

from __future__ import annotations

import os
import string
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentrylake.llm.text import LOWER, as_strings, cut, places, release, sliced, small_batches, words_of

CAPACITY = 4096
END_ID = 1
GROUP = 8192
ROUNDS = 3
#: Bytes of text whose words are encoded together.
BLOCK_BYTES = 4 << 20
#: Parts one word from the next where many are encoded as one text; a word that holds it is encoded alone.
MARK = "\x01"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _table(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


LETTER, PUNCTUATION = _table(string.ascii_letters), _table(string.punctuation)


def parted(body: np.ndarray, bounds: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bounds, items per text) with the ASCII punctuation that ends a word after an ASCII letter as an item of its own.

    The tokenizer always parts a text there, so fewer distinct items have to be encoded.
    """
    last = np.maximum.accumulate(np.where(PUNCTUATION[body], -1, np.arange(len(body), dtype=np.int32)))[bounds[1:] - 1]
    cuts = (last >= bounds[:-1]) & (last + 1 < bounds[1:]) & LETTER[body[last]]
    total, ends = np.concatenate([[0], np.cumsum(cuts)]), np.cumsum(counts)
    return np.sort(np.concatenate([bounds, last[cuts] + 1])), counts + total[ends] - total[ends - counts]


class Encoder:
    """Ids of many words at once, by the tokenizer of a file that lower-cases, parts at white space and marks word ends.

    A call for each word costs more than its merges do, so words are encoded a
    thousand at a time as one text. Where each word is one letter run, its last token
    alone bears the end mark. Lower-case ASCII letters need neither normaliser nor
    splitting pattern. All other words have MARK between them, which always is one
    token that no other word gives: the tokenizer makes no control character.
    """

    def __init__(self, path: str):
        import tokenizers

        self.full = tokenizers.Tokenizer.from_file(path)
        self.plain = tokenizers.Tokenizer(self.full.model)  # the same merges and vocabulary, held once
        self.plain.pre_tokenizer = tokenizers.pre_tokenizers.WhitespaceSplit()
        (self.mark,) = self.full.encode(MARK, add_special_tokens=False).ids
        suffix, vocabulary = self.full.model.end_of_word_suffix, self.full.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if suffix and t.endswith(suffix)]] = True
        del vocabulary
        release()  # what loading took

    def _joined(self, tokenizer, words: list[str], between: str = " ", end: str = "") -> np.ndarray:
        got = [np.zeros(0, np.uint32)]
        for i in range(0, len(words), 16384):  # an encoding is many times its ids, so few are held at once
            texts = [between.join(words[j : j + 1024]) + end for j in range(i, min(i + 16384, len(words)), 1024)]
            got += [np.array(e.ids, np.uint32) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate(got)

    def _runs(self, tokenizer, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = self._joined(tokenizer, words)
        at = np.flatnonzero(self.ends[np.minimum(ids, len(self.ends) - 1)])
        return (ids, np.diff(at, prepend=-1)) if len(at) == len(words) else self._marked(words)

    def _marked(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = self._joined(self.full, words, f" {MARK} ", f" {MARK}")
        at = np.flatnonzero(ids == self.mark)
        return ids[ids != self.mark], np.diff(at, prepend=-1) - 1

    def _each(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [np.array(self.full.encode(w, add_special_tokens=False).ids, np.uint32) for w in words]
        return np.concatenate([np.zeros(0, np.uint32), *got]), np.array([len(x) for x in got], np.int64)

    def kind(self, word: str) -> int:
        if word.isascii():
            return 0 if word.isalpha() and word.islower() else 3 if MARK in word else 2
        return 1 if word.isalpha() and unicodedata.normalize("NFC", word).lower().isalpha() else 3 if MARK in word else 2

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, where each word's begin, how many it has)."""
        kinds = np.fromiter(map(self.kind, words), np.int8, len(words))
        at, sizes, every, base = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), [np.zeros(0, np.uint32)], 0
        for k, encode in enumerate((lambda w: self._runs(self.plain, w), lambda w: self._runs(self.full, w), self._marked, self._each)):
            own = np.flatnonzero(kinds == k)
            if len(own):
                ids, n = encode([words[j] for j in own])
                at[own], sizes[own] = base + np.cumsum(n) - n, n
                every.append(ids)
                base += len(ids)
        return np.concatenate(every), at, sizes


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Each document's token ids and one end id, cut into pieces of at most `capacity`.

    The tokenizer never joins across white space, so the distinct words of each
    BLOCK_BYTES of text are encoded once and a document's ids are put together from
    its words'.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = Encoder(tokenizer_path)
        for block in sliced(batches, "text", BLOCK_BYTES):
            chunks, counts, held = [], [], []
            for batch in sliced([block], "text"):
                body, bounds, n = words_of(batch.column("text"))
                if b"<|" not in body.tobytes():  # what may be a special token stays as it is
                    body = LOWER[body]
                    bounds, n = parted(body, bounds, n)
                chunks.append(as_strings(body, bounds))
                counts.append(n)
                held.append(batch.column("doc_id"))
            chunks = pa.concat_arrays(chunks)  # one array: of chunked ones those without words would go
            coded = chunks.dictionary_encode()
            chunks = body = bounds = batch = None  # the words are in the dictionary now
            ids, at, sizes = encoder(coded.dictionary.to_pylist())
            codes = np.asarray(coded.indices)
            cuts = np.cumsum([int(n.sum()) for n in counts])[:-1]
            for doc_ids, n, own in zip(held, counts, np.split(codes, cuts), strict=True):
                yield from pieces_of(doc_ids, n, own, ids, at, sizes)
        encoder = block = batch = chunks = held = coded = codes = own = ids = at = sizes = None  # noqa: F841  not to be kept by the worker
        release()

    def pieces_of(doc_ids: pa.Array, counts: np.ndarray, codes: np.ndarray, ids: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
        group, place = places(sizes[codes])
        flat = ids[at[codes][group] + place]
        ends = np.concatenate([[0], np.cumsum(sizes[codes])])[np.cumsum(counts)]
        rows, begin = [], 0
        for doc_id, end in zip(doc_ids.to_pylist(), ends.tolist(), strict=True):
            doc = np.append(flat[begin:end], np.uint32(end_id)).astype("<u4")
            begin = end
            for piece, s in enumerate(range(0, len(doc), capacity)):
                part = doc[s : s + capacity]
                rows.append((doc_id, piece, s, len(part), zlib.crc32(part), part.astype(np.int32) if with_ids else None))
        cols = list(zip(*rows, strict=True))
        arrays = [pa.array(c, t) for c, t in zip(cols[:5], (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        if with_ids:
            arrays.append(pa.array(cols[5], pa.list_(pa.int32())))
            names.append("ids")
        yield pa.RecordBatch.from_arrays(arrays, names)

    small_batches(docs.sparkSession, BLOCK_BYTES)
    return docs.select("doc_id", "text").mapInArrow(encode, PIECES + (", ids array<int>" if with_ids else ""))


def bins_needed(lengths: np.ndarray, capacity: int) -> int:
    """Lower bound on the bins for these lengths, the best of several dual feasible functions.

    A function u with sum u(x_i) <= capacity for whatever fits one bin proves
    ceil(sum u(x) / capacity) bins. Used here: the identity; for each threshold e,
    lengths above capacity - e count as full and those below e as nothing; for
    each k, lengths rounded to k-ths: x if (k + 1) x / capacity is whole, else
    floor((k + 1) x / capacity) capacity / k.
    """
    if not len(lengths):
        return 0
    have = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    x = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int(have @ x) // capacity)
    count, mass = np.cumsum(have), np.cumsum(have * x)
    e = np.arange(1, capacity // 2 + 1)
    full = count[-1] - count[capacity - e]
    best = max(best, int((full + -(-(mass[capacity - e] - mass[e - 1]) // capacity)).max()))
    for k in range(1, 33):
        q, r = np.divmod((k + 1) * x, capacity)
        scaled = np.where(r == 0, k * x, q * capacity)  # times k, to stay in integers
        best = max(best, -(-int(have @ scaled) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin of each item, its offset there, fill of each bin); the fullest bin that still takes it wins."""
    bin_of, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    fill: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms = 0  # bit r is set where by_room[r] holds a bin
    for i in np.argsort(-lengths, kind="stable"):
        n = int(lengths[i])
        fits = open_rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                open_rooms ^= 1 << room
        else:
            room, b = capacity, len(fill)
            fill.append(0)
        bin_of[i], offset[i] = b, fill[b]
        fill[b] += n
        if room > n:
            by_room[room - n].append(b)
            open_rooms |= 1 << (room - n)
    return bin_of, offset, np.asarray(fill, np.int64)


def pack(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP, rounds: int = ROUNDS) -> DataFrame:
    """Sequences for pieces (doc_id, piece, start, length, ids_crc32): adds sequence_id, offset.

    Pieces are dealt by hash into groups of about `group`, and each is packed best-fit
    decreasing. A group whose bins equal its lower bound is certified and done. Of
    the others, bins with room go back: their pieces are dealt anew by another hash,
    so that groups exchange documents, and are packed again. A round whose bins are
    not fewer than those it took apart is dropped and its predecessor kept. Each
    piece gets a number of its own when the table is written, and groups are dealt by
    it, so rows that repeat spread over groups like any others; full pieces are
    sequences of their own. An empty table gives an empty result.
    """
    schema = "_row long, " + PIECES + ", sequence_id long, offset long, gap boolean"
    columns = ["_row", *(f.split()[0] for f in PIECES.split(", "))]

    def packer(this: int):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            lengths = pdf["length"].to_numpy()
            bin_of, offset, fill = best_fit_decreasing(lengths, capacity)
            short = len(fill) > bins_needed(lengths, capacity)
            out = pdf[columns].copy()
            # 4 bits of round, 36 of group, 20 of bin, which a group's size keeps far away
            out["sequence_id"] = (this << 56) + (int(pdf["_group"].iloc[0]) << 20) + bin_of
            out["offset"] = offset
            out["gap"] = short & (fill[bin_of] < capacity)
            return out

        return run

    def dealt(df: DataFrame, rows: int, this: int) -> DataFrame:
        groups = max(1, -(-rows // group))
        return df.withColumn("_group", F.pmod(F.xxhash64(F.lit(this), "_row"), F.lit(groups))).groupBy("_group").applyInPandas(packer(this), schema)

    pieces = cut(pieces.withColumn("_row", F.monotonically_increasing_id()).select(columns))
    whole = pieces.filter(F.col("length") >= capacity).select("*", (F.lit(127 << 56) + F.col("_row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    columns_out = [c for c in whole.columns if c != "_row"]
    rest = pieces.filter(F.col("length") < capacity)
    now = cut(dealt(rest, rest.count(), 0))
    done = whole.select(columns_out)
    for this in range(1, rounds + 1):
        again = now.filter("gap")
        rows, bins = again.agg(F.count("*"), F.count_distinct("sequence_id")).first()
        if not rows:
            break
        then = cut(dealt(again.select(columns), rows, this))
        if then.select(F.count_distinct("sequence_id")).first()[0] >= bins:
            break
        done = done.unionByName(now.filter("not gap").select(columns_out))
        now = then
    return done.unionByName(now.select(columns_out))


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Tokenise, cut and pack `docs`; null text is empty text and gives one piece, the end id alone.

    doc_id may be null or repeated; such rows are documents of their own. A long text
    gives as many pieces as it needs; equal lengths are packed in any order. Other
    columns of docs, whatever their names, are not looked at. An empty table gives an
    empty result.
    """
    return pack(token_pieces(docs, tokenizer_path, capacity, end_id), capacity)
