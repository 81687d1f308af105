"""Operator 7: exact n-gram Jaccard join over prefix trees, as components.

Each document is the set of its word n-grams in one global order: those seen rarely
by hash, then the most frequent ones by count. Two sets that link share an n-gram in
the first n - ceil(t n) + 1 of each, so documents meet at shared prefix n-grams
only. At a meeting point the sets are stored in a trie in that order; a traversal
with another set shares the overlap of common beginnings among all sets below a
node, and leaves a subtree when what remains of either side can't reach the
threshold.

Not all pairs that meet are compared. First each meets one hub of its point and size
band, the least of its points' hubs; links found so make components. Then, at points
where different components still meet, a document is a candidate for a larger
component if their sizes, what remains of both after the point, and the number of
such points allow the threshold, and its set traverses the tries of that whole component. Pairs are never
listed, and only texts of candidates move.

Before texts move, parities part most sets that meet by chance. A set's parity is a
bitmap, about a bit for each n-gram, in which each n-gram flips one bit. Two bitmaps
differ in no more bits than the sets differ in n-grams, so too many such bits prove
that two sets don't link; no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrylake.llm.text import SMALL_BATCH_BYTES, bit_filter, cut, inside, mix64, places, release, rows_of, sliced, small_batches, window_hashes, word_hashes, words_of

N = 4
PERCENT = 85
#: The frequent n-grams that go last in the global order: a table of bounded size, which only speeds the join.
FREQUENT, OFTEN = 65536, 3
#: Sets in one trie; a hub with more candidates has several. Sets in one task.
BLOCK, GROUP = 256, 512
#: Meeting points beyond the first that a candidate must have, where its size leaves room for them.
MORE = 8
#: Most words of 64 bits in a parity; longer ones would tell no more of sets of usual size.
PARITY_WORDS = 1024
#: Most ids that are broadcast, 8 bytes each.
BROADCAST_ROWS = 1 << 20
_TOP = np.uint64(1 << 63)


def gram_sets(texts: pa.Array, n: int, frequent: np.ndarray) -> list[np.ndarray]:
    """For each text its distinct n-grams as ascending keys, which are the global order.

    frequent: hashes (shifted) of frequent n-grams, sorted, with their ranks in a second row.
    """
    body, bounds, counts = words_of(texts, lower=True)
    wh = word_hashes(body, bounds)
    group, place = places(counts)
    keys = np.zeros(0, np.uint64)
    if len(wh) >= n:
        wins = window_hashes(wh, n)
        full = np.flatnonzero(place[: len(wins)] + n <= counts[group[: len(wins)]])
        keys = wins[full] >> np.uint64(1)
        if frequent.shape[1]:
            at = np.minimum(np.searchsorted(frequent[0], keys), frequent.shape[1] - 1)
            keys = np.where(frequent[0][at] == keys, _TOP | frequent[1][at], keys)
    per = np.where(counts >= n, counts - n + 1, 0)
    end, begin = np.cumsum(per), np.cumsum(counts) - counts
    out = []
    for i, c in enumerate(counts):
        if per[i]:
            out.append(np.unique(keys[end[i] - per[i] : end[i]]))
        elif c:  # fewer words than n: the whole sequence is one item
            out.append(window_hashes(wh[begin[i] : begin[i] + c], int(c)) >> np.uint64(1))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def prefix_length(size: int, percent: int) -> int:
    return size - -(-percent * size // 100) + 1


class Trie:
    """Radix tree over ascending key lists; nodes in preorder."""

    def __init__(self, sets: list[np.ndarray]):
        order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes())
        self.sets, self.order = sets, order
        lcp = [0] * (len(order) + 1)
        for j in range(1, len(order)):
            a, b = sets[order[j - 1]], sets[order[j]]
            m = min(len(a), len(b))
            differ = np.flatnonzero(a[:m] != b[:m])
            lcp[j] = int(differ[0]) if len(differ) else m
        self.lcp = lcp
        self.sizes = np.array([len(sets[i]) for i in order])

    def search(self, query: np.ndarray, percent: int, skip=lambda i: False) -> list[int]:
        """Sets whose Jaccard similarity to the query is at least percent / 100, by number."""
        found: list[int] = []
        if not len(query):
            return found
        q, t = len(query), 100 + percent
        stack = [(0, len(self.order), 0, 0)]  # sets from, to; depth; overlap so far
        while stack:
            lo, hi, depth, over = stack.pop()
            # children: runs between places where the common beginning is no longer than depth
            at = lo
            while at < hi:
                end = at + 1
                while end < hi and self.lcp[end] > depth:
                    end += 1
                shared = len(self.sets[self.order[at]]) if end == at + 1 else min(self.lcp[at + 1 : end])
                if end == at + 1 and skip(self.order[at]):
                    at = end
                    continue
                edge = self.sets[self.order[at]][depth:shared]
                place = np.searchsorted(query, edge)
                place[place == q] = q - 1
                o = over + int((query[place] == edge).sum())
                left = q - int(np.searchsorted(query, edge[-1], "right")) if len(edge) else q
                sizes = self.sizes[at:end]
                best = min(max(shared + left, int(sizes.min())), int(sizes.max()))
                if t * (o + min(best - shared, left)) >= percent * (q + best):
                    if end == at + 1:
                        found.append(self.order[at])
                    else:
                        first = at
                        while first < end and self.sizes[first] == shared:  # sets that end here
                            if not skip(self.order[first]) and t * o >= percent * (q + shared):
                                found.append(self.order[first])
                            first += 1
                        if first < end:
                            stack.append((first, end, shared, o))
                at = end
        return found


def parity(keys: np.ndarray) -> np.ndarray:
    """A set's parity bitmap, as a power of two of 64-bit words."""
    words = min(PARITY_WORDS, max(1, 1 << (len(keys) - 1).bit_length() >> 6)) if len(keys) else 1
    odd = np.bincount((mix64(keys) & np.uint64(64 * words - 1)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def differing(a: Column, b: Column) -> Column:
    """In how many bits two parities differ, the longer one folded to the length of the other."""
    words = F.least(F.size(a), F.size(b))
    folded = lambda x: F.when(F.size(x) == words, x).otherwise(F.transform(F.sequence(F.lit(0), words - 1), lambda i: F.aggregate(F.sequence(i, F.size(x) - 1, words), F.lit(0).cast("long"), lambda acc, j: acc.bitwiseXOR(F.get(x, j)))))
    return F.aggregate(F.zip_with(folded(a), folded(b), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda acc, n: acc + n)


def within_parity(pairs: DataFrame, signs: DataFrame, percent: int, reach: DataFrame | None = None) -> DataFrame:
    """The pairs (hub, doc_id) that may link by their parities; signs: (doc_id, n, parity).

    reach: (hub, radius, most): how far, in bits, the farthest member of a component is
    from its hub and how large the largest is; others are their hub alone.
    """
    own = pairs.join(signs, "doc_id")
    both = own.join(signs.select(F.col("doc_id").alias("hub"), F.col("n").alias("_n"), F.col("parity").alias("_parity")), "hub")
    both = both.withColumn("_bits", differing(F.col("parity"), F.col("_parity")))
    if reach is not None:
        both = both.join(reach, "hub", "left").withColumn("_bits", F.col("_bits") - F.coalesce("radius", F.lit(0))).withColumn("_n", F.coalesce("most", "_n"))
    return both.filter((100 + percent) * F.col("_bits") <= (100 - percent) * (F.col("n") + F.col("_n"))).select("hub", "doc_id")


def components(links: DataFrame) -> DataFrame:
    """(node, component): the least node that links (a, b) reach, by alternating large and small stars.

    Every step is an aggregate and a join, written to the shared folder; the loop
    reads back a count and a sum only.
    """
    now = cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    before = None
    while True:
        both = now.union(now.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").union(low.select("a", F.col("m").alias("b"))).distinct()
        now = cut(small)
        after = now.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).first()
        if after == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = after


def jaccard_sets(docs: DataFrame, n: int = N, percent: int = PERCENT):
    """((doc_id, n_shingles, class, meets, at, parity) of each document, the broadcast frequent n-grams).

    class, meets, at and parity are null unless some prefix n-gram is in another document's
    prefix too. class: 128-bit hash of the set; meets: the prefix keys that others
    have too (and perhaps some that none has); at: their places in the order.
    """
    small_batches(docs.sparkSession, SMALL_BATCH_BYTES)
    texts = docs.select("text").filter(F.col("text").isNotNull())
    none = np.zeros((2, 0), np.uint64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            keys, times = np.unique(np.concatenate(gram_sets(batch.column("text"), n, none)), return_counts=True)
            keep = times >= OFTEN
            yield pa.RecordBatch.from_arrays([pa.array(keys[keep].view(np.int64)), pa.array(times[keep])], ["key", "n"])

    top = texts.mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "key").limit(FREQUENT).toArrow()
    keys = np.asarray(top.column("key")).astype(np.uint64)
    rank = np.arange(len(keys), 0, -1).astype(np.uint64)
    order = np.argsort(keys)
    frequent = docs.sparkSession.sparkContext.broadcast(np.stack([keys[order], rank[order]]))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            sets = gram_sets(batch.column("text"), n, frequent.value)
            got, times = np.unique(np.concatenate([s[: prefix_length(len(s), percent)] for s in sets if len(s)] or [np.zeros(0, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(got.view(np.int64)), pa.array(times)], ["key", "n"])

    shared = bit_filter(texts.mapInArrow(prefixes, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).filter("n > 1"), "key")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            sets = gram_sets(batch.column("text"), n, frequent.value)
            name, meets, at, bits = [], [], [], []
            for s in sets:
                p = s[: prefix_length(len(s), percent)] if len(s) else s
                place = np.flatnonzero(inside(shared.value, p))
                if len(place):
                    with np.errstate(over="ignore"):
                        power = np.cumprod(np.full(len(s), 0xD6E8FEB86659FD93, np.uint64), dtype=np.uint64)
                        other = np.cumprod(np.full(len(s), 0xA3B195354A39B70D, np.uint64), dtype=np.uint64)
                        name.append(np.array([(s * power).sum(), (s * other).sum()], np.uint64).tobytes())
                    meets.append(p[place].view(np.int64))
                    at.append(place.astype(np.int32))
                    bits.append(parity(s))
                else:
                    for out in (name, meets, at, bits):
                        out.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(name, pa.binary()), pa.array(meets, pa.list_(pa.int64())), pa.array(at, pa.list_(pa.int32())), pa.array(bits, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "class", "meets", "at", "parity"],
            )

    return docs.select("doc_id", "text").mapInArrow(rows, "doc_id long, n_shingles long, class binary, meets array<long>, at array<int>, parity array<long>"), frequent


def verified(docs: DataFrame, stored: DataFrame, asked: DataFrame, n: int, percent: int, frequent) -> DataFrame:
    """Links (a, b) of asked sets (hub, doc_id) to the sets stored under the same hub (hub, doc_id).

    Stored sets are dealt into tries of about BLOCK; each asked set traverses all tries of its hub.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sets = gram_sets(pa.array(pdf["text"], pa.string()), n, frequent.value)
        ids, asks, a, b = pdf["doc_id"].to_numpy(), pdf["asks"].to_numpy(), [], []
        for rows in pdf.groupby(["hub", "part"]).indices.values():
            others = [i for i in rows if not asks[i]]
            trie = Trie([sets[i] for i in others])
            for i in rows:
                if asks[i]:
                    for j in trie.search(sets[i], percent):
                        a.append(ids[i])
                        b.append(ids[others[j]])
        sets = trie = None  # noqa: F841  not to be kept by the worker
        release()
        return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    parts = stored.groupBy("hub").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    kept = stored.join(parts, "hub").select("hub", F.pmod(F.xxhash64("doc_id"), "parts").cast("int").alias("part"), "doc_id", F.lit(False).alias("asks"))
    asking = asked.join(parts, "hub").select("hub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "doc_id", F.lit(True).alias("asks"))
    sent = cut(kept.unionByName(asking))
    groups = max(1, -(-sent.count() // GROUP))
    texts = rows_of(docs, sent, "doc_id", "text")
    sent = sent.join(texts, "doc_id").withColumn("group", F.pmod(F.xxhash64("hub", "part"), F.lit(groups)))
    return cut(sent.groupBy("group").applyInPandas(run, "a long, b long"))


def jaccard_links(docs: DataFrame, reps: DataFrame, n: int, percent: int, frequent) -> DataFrame:
    """Links (a, b) that connect all documents of reps (doc_id, n_shingles, meets, at, parity) that similarity connects."""
    signs = cut(reps.select("doc_id", F.col("n_shingles").alias("n"), "parity"))
    member = reps.select("doc_id", F.col("n_shingles").alias("n"), F.explode(F.arrays_zip("meets", "at")).alias("m")).select("doc_id", "n", F.col("m.meets").alias("key"), F.col("m.at").alias("at"))
    # sizes in one band can link
    member = cut(member.withColumn("band", F.floor(F.log("n") / F.lit(float(np.log(100 / percent)))).cast("int")))
    hubs = member.groupBy("key", "band").agg(F.min("doc_id").alias("hub"), F.count("*").alias("k")).filter("k > 1").drop("k")
    star = member.join(hubs, ["key", "band"]).groupBy("doc_id").agg(F.min("hub").alias("hub")).filter("doc_id <> hub")
    star = cut(within_parity(star, signs, percent))
    centre = star.select("hub").distinct().select("hub", F.col("hub").alias("doc_id"))
    links = verified(docs, star.select("hub", "doc_id"), centre, n, percent, frequent)

    # what a point may still connect: a document with a larger component (or an equal one of lesser name)
    found = components(links)
    part = member.select("doc_id").distinct().join(found, F.col("doc_id") == F.col("node"), "left").select("doc_id", F.coalesce("component", "doc_id").alias("component"))
    part = cut(part)
    part = cut(part.join(part.groupBy("component").agg(F.count("*").alias("size")), "component"))
    placed = cut(member.join(part, "doc_id"))  # read twice
    mixed = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("key")
    placed = cut(placed.join(mixed, "key"))
    other = placed.groupBy("key", "band", F.col("component").alias("hub"), F.col("size").alias("hub_size")).agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max(F.col("n") - F.col("at")).alias("rest"))
    own = placed.drop("band")
    fits = (
        (F.col("hub") != F.col("component"))
        & ((F.col("hub_size") > F.col("size")) | ((F.col("hub_size") == F.col("size")) & (F.col("hub") < F.col("component"))))
        & (100 * F.least("n", "most") >= percent * F.greatest("n", "least"))
        & ((100 + percent) * (F.least(F.col("n") - F.col("at"), "rest") + MORE) >= percent * (F.col("n") + F.col("least")))
    )
    # sets that link share need n-grams; from the m-th shared one on need - m + 1 remain, so the first
    # MORE + 1 shared ones all pass the test above, and lie in both prefixes as far as `room` says
    need = percent * (F.col("n") + F.col("least")) / (100 + percent)
    room = F.floor(need - F.lit(percent) * F.greatest("n", "most") / 100).cast("int") - 1
    met = own.join(other, "key").filter(fits).select("hub", "doc_id", F.greatest(F.lit(0), F.least(F.lit(MORE), room)).alias("room"))
    asked = met.groupBy("hub", "doc_id").agg(F.count("*").alias("k"), F.min("room").alias("room")).filter("k > room").select("hub", "doc_id")
    several = part.filter("size > 1").select("doc_id", F.col("component").alias("hub")).join(signs, "doc_id")
    several = several.join(signs.select(F.col("doc_id").alias("hub"), F.col("parity").alias("_parity")), "hub")
    reach = several.groupBy("hub").agg(F.max(differing(F.col("parity"), F.col("_parity"))).alias("radius"), F.max("n").alias("most"))
    asked = cut(within_parity(asked, signs, percent, reach))
    stored = part.select(F.col("component").alias("hub"), "doc_id").join(asked.select("hub").distinct(), "hub")
    return links.unionByName(verified(docs, stored, asked, n, percent, frequent))


def jaccard_components(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of each document.

    Null texts and texts without words have empty sets and link with nothing; a text
    under n words is one item. Documents with equal sets (or repeated rows) are one
    class, whose least doc_id stands for it in the join. Rows of null doc_id come
    back with a null component and link with nothing. Rows that share a doc_id but not
    their text are sets of their own, each with its own component. Texts are read
    whole, however long; columns other than doc_id and text, whatever their names,
    aren't looked at. An empty table gives an empty result.
    """
    sets, frequent = jaccard_sets(docs, n, percent)
    every = cut(sets)
    known = every.filter(F.col("class").isNotNull() & F.col("doc_id").isNotNull())
    classes = cut(known.groupBy("class").agg(F.min("doc_id").alias("rep")))
    reps = known.join(classes, (known["class"] == classes["class"]) & (known["doc_id"] == classes["rep"])).select("doc_id", "n_shingles", "meets", "at", "parity")
    found = components(jaccard_links(docs, reps, n, percent, frequent))
    named = classes.join(found, F.col("rep") == F.col("node"), "left").select("class", F.coalesce("component", "rep").alias("component_id"))
    linked = known.select("doc_id", "n_shingles", "class").join(named, "class").select("doc_id", "n_shingles", "component_id")
    alone = every.filter(F.col("class").isNull() | F.col("doc_id").isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone)


def keep_one(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """The document of least doc_id of each component, with the columns it came with, whatever their names.

    Rows of null doc_id, and rows without words, stay; rows that repeat the least
    doc_id all stay. An empty table gives an empty result.
    """
    gone = cut(jaccard_components(docs, n, percent).filter(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("_gone")).distinct())
    few = gone.count() <= BROADCAST_ROWS  # else the texts are shuffled
    return docs.join(F.broadcast(gone) if few else gone, docs["doc_id"] == F.col("_gone"), "left_anti")
