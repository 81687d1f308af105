"""Operator 4: removing long repeated passages with a compacted De Bruijn graph.

Edges of the graph are k-word windows, its nodes the (k - 1)-word sequences between
them. As in minimiser-partitioned graph builders, each edge belongs to the partition
of its anchor, the GRAM-word sequence of least hash inside it, so equal edges meet in one
partition; a run of consecutive edges of one document with one anchor place is a piece of a
path; windows of one run are never equal, as the anchor stands at another place in
each. An anchor that only one run has bears unique edges and goes away. Equal runs
of an anchor are one path. Where an anchor has several paths, the graph branches, and
only there edges are compared one by one, those of each path's first run.

Each path knows what follows it. The node between two paths doesn't branch if one
always precedes the other and they occur equally often (in and out degree one); paths
are compacted over such nodes, and only the first of a compacted path is joined with
its occurrences. At last each occurrence's words, read again at its coordinates, are
grouped with those of the path's source: where a path turns out to have more than one
text, hashes have met by chance, and its windows are decided on their words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sentrylake.llm.text import SEPARATOR, SMALL_BATCH_BYTES, bit_filter, buffers, cut, inside, places, signed, sliced, small_batches, window_hashes, word_hashes, words_of

K = 20
GRAM = 8
_Q, _SECOND = 0xA0761D6478BD642F, 0xE7037ED1A0B428DB
FULL = (1 << 64) - 1


def _anchors(wh: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of k words the least hash of its GRAM-word sequences, and where it first stands."""
    key = window_hashes(wh, GRAM)
    need, span = k - GRAM + 1, 1
    low, at = key, np.arange(len(key), dtype=np.int32)

    def least(step: int) -> tuple[np.ndarray, np.ndarray]:
        n = len(low) - step
        right = low[step:] < low[:n]
        return np.where(right, low[step:], low[:n]), np.where(right, at[step:], at[:n])

    while 2 * span <= need:
        low, at = least(span)
        span *= 2
    return least(need - span) if need > span else (low, at)


class Windows:
    """All windows of a chunk of texts: document, place, anchor, and the runs of equal anchors."""

    def __init__(self, texts: pa.Array, k: int, second: bool, mask: int = FULL):
        body, bounds, counts = words_of(texts)
        wh = word_hashes(body, bounds)
        self.n = max(0, len(wh) - k + 1)
        if not self.n:
            self.at = np.zeros(0, np.int64)
            self.doc = self.place = self.begin = self.count = self.at
            self.anchor = np.zeros(0, np.uint64)
            return
        group, place = places(counts)
        self.at = np.flatnonzero(place[: self.n] + k <= counts[group[: self.n]])
        self.doc, self.place = group[self.at], place[self.at]
        anchor, where = _anchors(wh, k)
        self.anchor, where = anchor[self.at], where[self.at]
        new = np.ones(len(self.at), bool)
        new[1:] = (where[1:] != where[:-1]) | (self.doc[1:] != self.doc[:-1])
        self.begin = np.flatnonzero(new)
        self.count = np.diff(np.append(self.begin, len(self.at)))
        if second:
            self.first = window_hashes(wh, k)[self.at] & np.uint64(mask)
            self.check = window_hashes(word_hashes(body, bounds, _SECOND), k, _Q)[self.at] & np.uint64(mask)

    def run_hashes(self) -> tuple[np.ndarray, np.ndarray]:
        with np.errstate(over="ignore"):
            _, place = places(self.count)
            power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(self.count.max(initial=1)), np.uint64(_Q), np.uint64)]), dtype=np.uint64)[place]
            longer = self.count.astype(np.uint64) * np.uint64(_SECOND)  # runs of unequal lengths are unequal
            return np.add.reduceat(self.first * power, self.begin) + longer, np.add.reduceat(self.check * power, self.begin)


def _again(doc: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Whether an equal (one, two) comes earlier in the same document."""
    order = np.lexsort((np.arange(len(doc)), two, one, doc))
    same = (doc[order][1:] == doc[order][:-1]) & (one[order][1:] == one[order][:-1]) & (two[order][1:] == two[order][:-1])
    out = np.zeros(len(doc), bool)
    out[order[1:]] = same
    return out


def half(x: np.ndarray) -> pa.Array:
    """The upper half of a hash, as a signed number."""
    return pa.array((x >> np.uint64(32)).astype(np.uint32).view(np.int32))


def _following(one: np.ndarray, doc: np.ndarray, at: np.ndarray) -> pa.Array:
    """The hash of the piece right after each in its document, null where that isn't among the pieces."""
    out = np.zeros(len(one), np.int64)
    out[:-1] = one[1:].view(np.int64)
    last = np.ones(len(one), bool)
    last[:-1] = (at[1:] != at[:-1] + 1) | (doc[1:] != doc[:-1])
    return pa.array(out, mask=last)


def _paths(pieces: DataFrame, *keys: str) -> DataFrame:
    """How often each path occurs, in which first document, and as `out` the one path that always follows, if one does."""
    after = F.when((F.count("next") == F.count("*")) & (F.min("next") == F.max("next")), F.min("next"))
    return pieces.groupBy(*keys, "one", "two").agg(F.count("*").alias("times"), F.min("doc_id").alias("source"), after.alias("out"))


def _compacted(pieces: DataFrame, paths: DataFrame) -> DataFrame:
    """(one, two, doc_id, th, place, n, later): occurrences of compacted paths, the sources among them with later = false.

    A path is named by its first piece. Path B continues path A if A's out degree is
    one, with B after it, and B occurs no more often than A, so that its in degree is
    one too. All occurrences then agree on what is later, so the pieces of the source
    document, in their order, show how far a compacted path goes.
    """
    later = F.col("again") | F.coalesce(F.col("doc_id") > F.col("source"), F.lit(False))
    met = pieces.join(paths.filter("times > 1").select("one", "two", "times", "source", "out"), ["one", "two"])
    met = cut(met.select("one", "two", "doc_id", "th", "place", "n", "times", "out", later.alias("later")))
    order = Window.partitionBy("doc_id", "th").orderBy("place")
    firsts = met.filter("not later").dropDuplicates(["doc_id", "th", "place"])
    on = [F.lag(c).over(order) for c in ("place", "n", "out", "times")]
    goes_on = F.coalesce((on[0] + on[1] == F.col("place")) & (on[2] == F.col("one")) & (on[3] == F.col("times")), F.lit(False))
    firsts = firsts.withColumn("goes_on", goes_on).withColumn("unit", F.sum(F.when(F.col("goes_on"), 0).otherwise(1)).over(order))
    end = F.max(F.col("place") + F.col("n")).over(Window.partitionBy("doc_id", "th", "unit"))
    sources = cut(firsts.withColumn("n", end - F.col("place")).filter("not goes_on").select("one", "two", "doc_id", "th", "place", "n"))
    # written first: a small table is then broadcast, of a large one hot keys can be split
    whole = cut(sources.groupBy("one", "two").agg(F.max("n").alias("n")))
    again = met.filter("later").drop("n").join(whole, ["one", "two"]).select("one", "two", "doc_id", "th", "place", "n")
    return again.withColumn("later", F.lit(True)).unionByName(sources.withColumn("later", F.lit(False)))


def _said(docs: DataFrame, occurrences: DataFrame, k: int) -> DataFrame:
    """(one, doc_id, th, place, n, words): the words that stand in the documents at the occurrences' coordinates."""
    at = F.shiftleft(F.col("place").cast("long"), 32).bitwiseOR(F.col("n").cast("long"))
    lists = cut(occurrences.groupBy("doc_id", "th").agg(F.collect_set(F.struct(at.alias("at"), "one")).alias("_spans")))  # a set: rows that repeat have the same

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "_c1"):
            body, bounds, counts = words_of(batch.column("_c1"))
            word = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            joined = np.full(len(body) + len(bounds), 32, np.uint8)
            joined[np.arange(len(body)) + word] = body
            joined = joined.tobytes()
            spans = batch.column("_spans")
            doc = np.repeat(np.arange(len(counts)), np.asarray(pa.compute.list_value_length(spans), np.int64))
            flat = spans.flatten()
            packed = np.asarray(flat.field("at"), np.int64)
            place, n = packed >> 32, packed & 0xFFFFFFFF
            a = (np.cumsum(counts) - counts)[doc] + place
            b = np.minimum(a + n + k - 1, np.cumsum(counts)[doc])
            begin, end = (bounds[a] + a).tolist(), (bounds[b] + b - 1).tolist()
            said = pa.array([joined[i:j] for i, j in zip(begin, end, strict=True)], pa.binary()).cast(pa.string())
            of = pa.array(doc)
            yield pa.RecordBatch.from_arrays(
                [flat.field("one"), batch.column("_c0").take(of), batch.column("_of").take(of), pa.array(place.astype(np.int32)), pa.array(n.astype(np.int32)), said],
                ["one", "doc_id", "th", "place", "n", "words"],
            )

    hit, _, _ = _beside(docs.select("doc_id", "text"), lists)
    return hit.filter("_spans is not null").select("_c0", "_c1", "_of", "_spans").mapInArrow(read, "one long, doc_id long, th int, place int, n int, words string")


def _verified(docs: DataFrame, occurrences: DataFrame, k: int) -> DataFrame:
    """(doc_id, th, place, n) of later occurrences whose words are those of their path's source.

    A path with several texts (chance meetings of hashes) is taken apart, and each of
    its windows is later if its words also start earlier.
    """
    said = _said(docs, occurrences, k)
    several = cut(said.select("one", "words").distinct().groupBy("one").agg(F.count("*").alias("texts")).filter("texts > 1").select("one"))
    sure = occurrences.filter("later")
    if several.isEmpty():
        return sure.select("doc_id", "th", "place", "n")
    split = F.split("words", " ")
    grams = F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.array_join(F.slice(split, i, k), " "))
    single = said.join(several, "one").select("doc_id", "th", "place", F.posexplode(grams).alias("i", "gram")).select("doc_id", "th", (F.col("place") + F.col("i")).alias("place"), "gram").distinct()
    least = F.min("doc_id").over(Window.partitionBy("gram"))
    own = F.min("place").over(Window.partitionBy("gram", "doc_id", "th"))
    later = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False)) | (F.col("place") > F.col("own"))
    apart = single.withColumn("least", least).withColumn("own", own).filter(later).select("doc_id", "th", "place", F.lit(1).alias("n"))
    return sure.join(several, "one", "left_anti").select("doc_id", "th", "place", "n").unionByName(apart)


def repeated_spans(docs: DataFrame, k: int = K, mask: int = FULL) -> DataFrame:
    """(doc_id, th, place, n): n windows from word `place` on, all of which start earlier elsewhere too.

    th is a hash of the text; with doc_id it names the row. `mask` keeps some bits of
    the windows' hashes only, to test what chance meetings do.
    """
    small_batches(docs.sparkSession, SMALL_BATCH_BYTES)
    base = docs.select("doc_id", "text").filter(F.col("text").isNotNull())

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            w = Windows(batch.column("text"), k, False)
            a, n = np.unique(w.anchor[w.begin], return_counts=True)
            yield pa.RecordBatch.from_arrays([signed(a), pa.array(n)], ["a", "n"])

    often = base.select("text").mapInArrow(anchors, "a long, n long").groupBy("a").agg(F.sum("n").alias("n")).filter("n > 1")
    some = bit_filter(often, "a")
    named = base.select("doc_id", "text", F.hash("text").alias("th"))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = some.value
        for batch in sliced(batches, "text"):
            w = Windows(batch.column("text"), k, True, mask)
            if not w.n or not len(w.begin):
                continue
            one, two = w.run_hashes()
            hit = np.flatnonzero(inside(bits, w.anchor[w.begin]))
            b = w.begin[hit]
            doc = w.doc[b]
            again = _again(doc, one[hit], two[hit])
            of = pa.array(doc)
            yield pa.RecordBatch.from_arrays(
                [signed(w.anchor[b]), signed(one[hit]), half(two[hit]), batch.column("doc_id").take(of), batch.column("th").take(of), pa.array(w.place[b].astype(np.int32)), pa.array(w.count[hit].astype(np.int32)), pa.array(again), _following(one[hit], doc, hit)],
                ["a", "one", "two", "doc_id", "th", "place", "n", "again", "next"],
            )

    pieces = cut(named.mapInArrow(runs, "a long, one long, two int, doc_id long, th int, place int, n int, again boolean, next long"))
    paths = cut(_paths(pieces, "a"))
    straight = _compacted(pieces, paths)
    # where paths of one anchor differ, the edges of each path's first run are compared
    knots = paths.groupBy("a").agg(F.count("*").alias("paths")).filter("paths > 1").select("a")
    first_runs = bit_filter(paths.join(knots, "a").select(F.expr("one ^ coalesce(source, 0L)").alias("h")), "h")

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = first_runs.value
        for batch in sliced(batches, "text"):
            w = Windows(batch.column("text"), k, True, mask)
            if not w.n or not len(w.begin):
                continue
            of_doc = np.asarray(pa.compute.fill_null(batch.column("doc_id"), 0), np.int64).view(np.uint64)
            hit = np.flatnonzero(np.repeat(inside(bits, w.run_hashes()[0] ^ of_doc[w.doc[w.begin]]), w.count))
            doc = w.doc[hit]
            again = _again(doc, w.first[hit], w.check[hit])
            of = pa.array(doc)
            yield pa.RecordBatch.from_arrays(
                [signed(w.first[hit]), half(w.check[hit]), batch.column("doc_id").take(of), batch.column("th").take(of), pa.array(w.place[hit].astype(np.int32)), pa.array(np.ones(len(hit), np.int32)), pa.array(again), _following(w.first[hit], doc, hit)],
                ["one", "two", "doc_id", "th", "place", "n", "again", "next"],
            )

    single = named.mapInArrow(edges, "one long, two int, doc_id long, th int, place int, n int, again boolean, next long")
    crossed = _compacted(single, cut(_paths(single).filter("times > 1")))
    return _verified(docs, cut(straight.unionByName(crossed)), k)


def _covered(counts: np.ndarray, spans: list, k: int) -> np.ndarray:
    """Which words of a chunk lie in a span."""
    edge = np.zeros(int(counts.sum()) + 1, np.int64)
    begin = np.cumsum(counts) - counts
    for i, own in enumerate(spans):
        if own is not None:
            place, n = np.asarray(own, np.int64) >> 32, np.asarray(own, np.int64) & 0xFFFFFFFF
            np.add.at(edge, begin[i] + place, 1)
            np.add.at(edge, np.minimum(begin[i] + place + n + k - 1, begin[i] + counts[i]), -1)
    return np.cumsum(edge)[:-1] > 0


def _beside(docs: DataFrame, lists: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """docs under numbered names: those that may have a list (doc_id, th, _spans), with it and its key, those that have none, and the named docs.

    A bit filter of fixed size parts the two, so texts without repeats aren't shuffled.
    """
    some = bit_filter(lists.select(F.expr("xxhash64(doc_id, th)").alias("h")), "h")
    named = docs.select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(docs.columns)])
    sized = f"_c{docs.columns.index('text')}"
    doc_id = F.col(f"_c{docs.columns.index('doc_id')}")
    hashed = named.withColumn("_th", F.hash(F.col(sized))).withColumn("_h", F.xxhash64(doc_id, "_th"))

    def part(wanted: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches, sized, 4 << 20):
                batch = batch.filter(pa.array(inside(some.value, np.asarray(batch.column("_h"), np.int64).view(np.uint64)) == wanted))
                yield pa.RecordBatch.from_arrays(batch.columns[:-1], batch.schema.names[:-1])

        return run

    kept = hashed.drop("_h").schema
    lists = lists.select(F.col("doc_id").alias("_id"), F.col("th").alias("_of"), "_spans")
    hit = hashed.mapInArrow(part(True), kept).join(lists, doc_id.eqNullSafe(F.col("_id")) & (F.col("_th") == F.col("_of")), "left")
    return hit, hashed.mapInArrow(part(False), kept), named


def _with_spans(docs: DataFrame, k: int, mask: int = FULL) -> tuple[DataFrame, DataFrame]:
    """docs under numbered names: those that may have spans, with them (an array bounded by the document's own length), and the rest."""
    at = F.shiftleft(F.col("place").cast("long"), 32).bitwiseOR(F.col("n").cast("long"))
    lists = cut(repeated_spans(docs, k, mask).groupBy("doc_id", "th").agg(F.collect_set(at).alias("_spans")))  # a set: rows that repeat have the same
    hit, rest, named = _beside(docs, lists)
    columns = [*named.columns, "_spans"]
    return hit.select(columns), rest.withColumn("_spans", F.lit(None).cast("array<long>")).select(columns)


def dedup_report(docs: DataFrame, k: int = K, mask: int = FULL) -> DataFrame:
    """doc_id, n_words, n_removed and the SHA-256 of the kept words, for each document.

    A word goes if a window of k words that covers it also starts earlier, in a
    document of smaller doc_id or earlier in the same one. Null and empty texts
    have no words; texts under k words keep all. Rows of one doc_id are one place
    in the order: neither is earlier than the other. Rows with null doc_id are
    compared with themselves only. Rows that repeat share one list of spans. Texts are
    read whole, however long; an empty table gives an empty result; columns other than
    doc_id and text, whatever their names, aren't looked at.
    """

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "_c1"):
            body, bounds, counts = words_of(batch.column("_c1"))
            gone = _covered(counts, batch.column("_spans").to_pylist(), k)
            sizes = np.diff(bounds)
            kept = ~gone
            joined = np.full(int(sizes[kept].sum()) + int(kept.sum()), 32, np.uint8)
            word, place = places(sizes[kept])
            starts = np.cumsum(sizes[kept] + 1) - sizes[kept] - 1
            joined[starts[word] + place] = body[np.repeat(kept, sizes)]
            begin = np.cumsum(counts) - counts
            total = np.concatenate([[0], np.cumsum(kept)])
            ends = np.append(starts, len(joined))
            removed, digests = np.zeros(len(counts), np.int64), []
            for i in range(len(counts)):
                a, b = total[begin[i]], total[begin[i] + counts[i]]
                removed[i] = counts[i] - (b - a)
                digests.append(hashlib.sha256(joined[ends[a] : ends[b] - 1] if b > a else b"").hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("_c0"), pa.array(counts.astype(np.int64)), pa.array(removed), pa.array(digests)], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    hit, rest = (df.mapInArrow(report, schema) for df in _with_spans(docs.select("doc_id", "text"), k, mask))
    return hit.unionByName(rest)


def remove_repeats(docs: DataFrame, k: int = K) -> DataFrame:
    """The documents without the repeated words; a kept word keeps the white space before it.

    Documents that lose nothing stay as they are (those of null or blank text among
    them), those that lose every word go. Columns stay, whatever their names; n_chars,
    where there is one, is counted anew. Rows that repeat lose the same. Texts are read
    whole, however long; an empty table gives an empty result.
    """
    columns = docs.columns
    text_at = columns.index("text")

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, f"_c{text_at}"):
            texts = batch.column(f"_c{text_at}")
            data, off = buffers(texts)
            _, bounds, counts = words_of(texts)
            spans = batch.column("_spans").to_pylist()
            gone = _covered(counts, spans, k)
            keep = ~SEPARATOR[data]
            last = keep.copy()  # a word and the white space before it belong together
            last[:-1] &= ~keep[1:]
            ends = off[1:][off[1:] > 0] - 1
            last[ends] |= keep[ends]
            word = np.cumsum(last) - last
            cutting = np.append(gone, False)[np.minimum(word, len(gone))]
            begin = np.cumsum(counts) - counts
            out, whole = texts.to_pylist(), []
            for i, own in enumerate(spans):
                if own is not None:
                    part = slice(off[i], off[i + 1])
                    tail = word[part] >= begin[i] + counts[i]  # white space after the last word
                    out[i] = data[part][~(cutting[part] & ~tail)].tobytes().decode()
                whole.append(own is None or not gone[begin[i] : begin[i] + counts[i]].all())
            arrays = [batch.column(f"_c{j}") for j in range(len(columns))]
            arrays[text_at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(arrays, [f"_c{j}" for j in range(len(columns))]).filter(pa.array(whole))

    schema = ", ".join(f"_c{i} {kind}" for i, (_, kind) in enumerate(docs.dtypes))
    hit, rest = (df.mapInArrow(shorten, schema) for df in _with_spans(docs, k))
    out = hit.unionByName(rest).select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(columns)])
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return out.select(*columns)
