"""Operator 11: a Merkle manifest of a dataset, its nodes labelled by the intervals of leaves they cover.

Leaves are numbered over the whole table in the order of (source, doc_id); a node's
label is its level and the interval [lo, hi) of leaves under it. A leaf's ancestors
are the nodes whose interval holds it. Of the children inside a parent's interval,
those that don't hold the leaf are the siblings that its proof needs.

Levels come in buckets of BAND: a bucket is a run of FAN ** BAND items of one source
and all nodes over them up to its top, so no task holds more than one bucket's nodes,
however large a source is. The tops of one band are the items of the next, and the
sources' tops are the items of the tree over sources.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentrylake.llm.text import cut

#: Children of a node, and levels that a bucket spans: 729 items.
FAN, BAND = 3, 6
#: Levels of the tree over sources count from here, above those of any source; a subroot and the root, as rows of their own.
OVER, SUBROOT, ROOT = 64, 63, 127
NODE = "key string, bucket long, off long, n long, level int, lo long, hi long, digest binary"
ABOVE = "key string, band int, bucket long, level int, lo long, hi long, digest binary"


def field(c: Column, text: bool = False) -> Column:
    """A value as it enters a leaf: its UTF-8 byte count, a colon and the value; `-` for null."""
    value = c if text else c.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, key, leaf, tampered): digests of each row, and of the row without its text's line ends where those are deleted.

    key orders sources: null first, then by their bytes. tampered is null where it would equal leaf.
    """
    head = [field(F.col("doc_id")), field(F.col("source")), field(F.col("lang")), field(F.col("n_chars"))]
    digest = lambda text: F.unhex(F.sha2(F.concat(*head, field(text, True)), 256))
    cut_here = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0) & F.col("text").contains("\n")
    return docs.select(
        "doc_id", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("key"), digest(F.col("text")).alias("leaf"),
        F.when(cut_here, digest(F.replace(F.col("text"), F.lit("\n"), F.lit("")))).alias("tampered"),
    )


def in_order(df: DataFrame, *order: str) -> DataFrame:
    """Adds `at`, the row's place (from 0) in the whole table's order, and `part`, its range.

    Ranges are dealt and sorted by the order and written; what comes before a range is
    a sum over a row for each range.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    sizes = dealt.groupBy(part.alias("part")).agg(F.count("*").alias("_size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as ranges
    sizes = sizes.select("part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    placed = dealt.withColumn("part", part).join(F.broadcast(sizes), "part")  # a row for each range
    return placed.withColumn("at", F.col("_before") + (F.col("_id") - F.shiftleft(F.col("part"), 33))).drop("_id", "_before")


def _joined(digests: list[bytes]) -> bytes:
    return b"".join(d.hex().encode() for d in digests)


def bucket_nodes(items: pd.DataFrame, level: int, left: int, levels: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[bytes]]]:
    """(level, lo, hi, digest) of the nodes over one bucket's items, level by level.

    left: how many items the whole tree has at the items' level; it ends where one node remains.
    """
    items = items.sort_values("lo")
    lo, hi, digest = items["lo"].to_numpy(), items["hi"].to_numpy(), list(items["digest"])
    for _ in range(levels):
        if left == 1:
            return
        starts = np.arange(0, len(lo), FAN)
        digest = [hashlib.sha256(_joined(digest[i : i + FAN])).digest() for i in starts]
        lo, hi = lo[starts], hi[np.minimum(starts + FAN, len(hi)) - 1]
        level, left = level + 1, -(-left // FAN)
        yield level, lo, hi, digest


def band_nodes(items: DataFrame, band: int, base: int, levels: int) -> DataFrame:
    """Nodes over items (key, bucket, off, n, lo, hi, digest); n: how many items of the first band the tree has."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        one = pdf.iloc[0]
        found = list(bucket_nodes(pdf, base + band * levels, -(-int(one["n"]) // FAN ** (levels * band)), levels))
        own = {"key": one["key"], "bucket": one["bucket"], "off": one["off"], "n": one["n"]}
        parts = [pd.DataFrame({**own, "level": level, "lo": lo, "hi": hi, "digest": digest}) for level, lo, hi, digest in found]
        return pd.concat(parts) if parts else pd.DataFrame(columns=[f.split()[0] for f in NODE.split(", ")])

    return items.groupBy("key", "bucket").applyInPandas(run, NODE)


def height(n: Column) -> Column:
    """Levels over n items."""  # 3 ** 39 is the last power that a long holds
    return F.coalesce(*[F.when(n <= FAN**h, h) for h in range(40)])


class Forest:
    """Trees over items (key, off, n, place, lo, hi, digest): the items and nodes of each band, and each tree's top.

    off and n: the first leaf of the item's tree and how many items the tree has; place:
    the item's number in it; most: items of the largest tree. A tree of one item is its own top.
    """

    def __init__(self, items: DataFrame, most: int, levels: int, base: int = 0):
        width = FAN**levels
        self.base, self.levels, self.nodes = base, levels, []
        self.items = [items.withColumn("bucket", F.expr(f"place div {width}"))]
        fields = ("key", "off", "n", "lo", "hi", "digest")
        self.tops = items.filter("n = 1").select(*fields)
        while most > 1:
            band = len(self.nodes)
            made = cut(band_nodes(self.items[band].select("bucket", *fields), band, base, levels))
            self.nodes.append(made)
            ends = height(F.col("n")) <= (band + 1) * levels
            self.tops = self.tops.unionByName(made.filter(ends & (F.col("level") == height(F.col("n")) + base)).select(*fields))
            most = -(-most // width)
            if most > 1:
                up = made.filter(~ends & (F.col("level") == base + (band + 1) * levels))
                self.items.append(up.select(*fields, F.col("bucket").alias("place"), F.expr(f"bucket div {width}").alias("bucket")))

    def above(self, tops: DataFrame, child: list[Column] | None = None) -> DataFrame:
        """What lies above each bucket of the first band, or above each of its items where `child` gives their ckey, cband, cbucket.

        tops: ABOVE rows of the buckets that end a tree.
        """
        got = tops
        for band in reversed(range(0 if child else 1, len(self.nodes))):
            names = child if band == 0 else [F.col("key").alias("ckey"), F.lit(band - 1).alias("cband"), F.col("place").alias("cbucket")]
            items = self.items[band].select("key", "bucket", "lo", "hi", "digest", *names)
            here = attach(items, self.nodes[band], got.filter(F.col("band") == band), self.base + band * self.levels)
            got = cut(here if band == 0 else here.unionByName(tops.filter(F.col("band") < band)))
        return got


class Bucket:
    """One bucket's items and nodes by level."""

    def __init__(self, rows: pd.DataFrame):
        self.levels = {}
        for level, own in rows.groupby("level"):
            own = own.sort_values("lo")
            self.levels[int(level)] = own["lo"].to_numpy(np.int64), own["hi"].to_numpy(np.int64), list(own["digest"])
        self.order = sorted(self.levels)

    def children(self, at: int) -> Iterator[tuple[int, list[tuple[int, int, bytes]]]]:
        """For each level of the bucket but the top: the nodes (lo, hi, digest) inside the interval of leaf `at`'s ancestor one level up."""
        for level, above in zip(self.order, self.order[1:]):
            plo, phi, _ = self.levels[above]
            i = np.searchsorted(plo, at, "right") - 1
            lo, hi, digest = self.levels[level]
            a, b = np.searchsorted(lo, plo[i]), np.searchsorted(lo, phi[i])
            yield level, list(zip(lo[a:b].tolist(), hi[a:b].tolist(), digest[a:b]))


def attach(items: DataFrame, nodes: DataFrame, above: DataFrame, level: int) -> DataFrame:
    """What lies above each item: of each ancestor the children, inside the item's bucket, and what lies above the bucket.

    items: (key, bucket, lo, hi, digest) and (ckey, cband, cbucket), the bucket that has the
    item as its top; above: ABOVE rows of this band's buckets.
    """
    names = [f.split()[0] for f in ABOVE.split(", ")]

    def run(_: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        own, bucket = left[left["cband"] >= 0], Bucket(left)
        rest = list(zip(right["level"], right["lo"], right["hi"], right["digest"]))
        rows = []
        for ckey, cband, cbucket, at in zip(own["ckey"], own["cband"], own["cbucket"], own["lo"]):
            near = [(level, *x) for level, some in bucket.children(at) for x in some]
            rows += [(ckey, cband, cbucket, *x) for x in near + rest]
        return pd.DataFrame(rows, columns=names)

    low = items.select("key", "bucket", F.lit(level).alias("level"), "lo", "hi", "digest", "ckey", "cband", "cbucket")
    high = nodes.select("key", "bucket", "level", "lo", "hi", "digest", F.lit(None).cast("string").alias("ckey"), F.lit(-1).alias("cband"), F.lit(-1).cast("long").alias("cbucket"))
    return low.unionByName(high).groupBy("key", "bucket").cogroup(above.groupBy("key", "bucket")).applyInPandas(run, ABOVE)


PROOF = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, leaf_rank long, proof_length int"


def prove(_: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Proofs of one bucket's leaves, from the bucket's nodes and from what lies above it (outer)."""
    is_outer = right["outer"].to_numpy(bool)
    outer: dict[int, list] = {}
    for level, lo, hi, digest in right.loc[is_outer, ["level", "lo", "hi", "digest"]].itertuples(index=False):
        outer.setdefault(level, []).append((lo, hi, digest))
    subroot, root = outer.pop(SUBROOT)[0][2].hex(), outer.pop(ROOT)[0][2].hex()
    upper = [sorted(outer[level]) for level in sorted(outer)]
    mine = pd.DataFrame({"level": 0, "lo": left["at"], "hi": left["at"] + 1, "digest": left["leaf"]})
    bucket = Bucket(pd.concat([mine, right.loc[~is_outer, ["level", "lo", "hi", "digest"]]]))
    rows = []
    for doc_id, at, leaf, tampered in left[["doc_id", "at", "leaf", "tampered"]].itertuples(index=False):
        folded, proof = (tampered or leaf).hex().encode(), []
        for some in [*(c for _, c in bucket.children(at)), *upper]:
            before = [d.hex().encode() for lo, hi, d in some if hi <= at]
            after = [d.hex().encode() for lo, hi, d in some if lo > at]
            folded = hashlib.sha256(b"".join([*before, folded, *after])).hexdigest().encode()
            proof += before + after
        folded = folded.decode()
        rows.append((doc_id, leaf.hex(), subroot, root, hashlib.sha256(b"".join(proof)).hexdigest(), folded, folded == root, at, len(proof)))
    return pd.DataFrame(rows, columns=[f.split()[0] for f in PROOF.split(", ")])


class Manifest:
    """Leaves of a table in order, the nodes over each source's leaves, and those over the sources' tops.

    Leaves ascend by source (null first, then UTF-8 bytes) and doc_id (null first);
    rows that share both by their leaf, so what rows repeat doesn't matter. Columns
    other than doc_id, source, lang, n_chars and text aren't looked at.
    """

    def __init__(self, docs: DataFrame, levels: int = BAND):
        self.spark, self.levels = docs.sparkSession, levels
        placed = in_order(cut(leaves(docs)), "key", "doc_id", "leaf")
        # a source's first leaf and size, by way of the few rows a range has of it, so that a large source isn't one key
        parts = placed.groupBy("key", "part").agg(F.min("at").alias("_first"), F.count("*").alias("_rows"))
        whole = Window.partitionBy("key")
        parts = cut(parts.select("key", "part", F.min("_first").over(whole).alias("off"), F.sum("_rows").over(whole).alias("n")))
        self.leaves = placed.join(parts, ["key", "part"]).withColumn("place", F.col("at") - F.col("off"))
        most = parts.agg(F.max("n")).first()[0]
        self.empty = most is None
        if self.empty:
            return
        self.trees = Forest(self.leaves.select("key", "off", "n", "place", F.col("at").alias("lo"), (F.col("at") + 1).alias("hi"), F.col("leaf").alias("digest")), most, levels)
        tops = in_order(cut(self.trees.tops), "key")
        sources = tops.count()
        items = tops.select(F.lit("").alias("key"), F.lit(0).cast("long").alias("off"), F.lit(sources).cast("long").alias("n"), F.col("at").alias("place"), "lo", "hi", "digest", F.col("key").alias("ckey"), F.col("n").alias("size"))
        self.over = Forest(items.drop("ckey", "size"), sources, levels, OVER)
        self.over.items[0] = items.withColumn("bucket", F.expr(f"place div {FAN**levels}"))
        self.root = self.over.tops.first()

    def nodes(self) -> DataFrame:
        """(source_key, level, lo, hi, digest) of all nodes above the leaves; levels from OVER + 1 on are those over sources."""
        out = [n.select(F.col("key").alias("source_key"), "level", "lo", "hi", F.lower(F.hex("digest")).alias("digest")) for n in [*self.trees.nodes, *self.over.nodes]]
        found = self.spark.createDataFrame([], "source_key string, level int, lo long, hi long, digest string")
        for n in out:
            found = found.unionByName(n)
        return found

    def proofs(self) -> DataFrame:
        """PROOF rows: each leaf with its subroot, the root, and what folding its row as it is now with the original siblings gives."""
        band = F.greatest(F.lit(0), F.ceil(height(F.col("size")) / self.levels).cast("int") - 1)  # the last of the source's
        child = [F.col("ckey"), band.alias("cband"), F.lit(0).cast("long").alias("cbucket")]
        none = self.spark.createDataFrame([], ABOVE)
        tops = self.over.items[0].select(F.col("ckey").alias("key"), band.alias("band"), F.lit(0).cast("long").alias("bucket"), "lo", "hi", "digest")
        ends = tops.select("key", "band", "bucket", F.lit(SUBROOT).alias("level"), "lo", "hi", "digest")
        root = F.unhex(F.lit(bytes(self.root["digest"]).hex()))
        ends = ends.unionByName(tops.select("key", "band", "bucket", F.lit(ROOT).alias("level"), "lo", "hi", root.alias("digest")))
        above = cut(ends.unionByName(self.over.above(none, child)))
        outer = self.trees.above(above).filter("band = 0").select("key", "bucket", "level", "lo", "hi", "digest", F.lit(True).alias("outer"))
        inner = [n.select("key", "bucket", "level", "lo", "hi", "digest", F.lit(False).alias("outer")) for n in self.trees.nodes[:1]]
        held = outer.unionByName(inner[0]) if inner else outer
        own = self.leaves.select("key", F.expr(f"place div {FAN**self.levels}").alias("bucket"), F.col("doc_id").cast("string").alias("doc_id"), "at", "leaf", "tampered")
        found = own.groupBy("key", "bucket").cogroup(held.groupBy("key", "bucket")).applyInPandas(prove, PROOF.replace("doc_id long", "doc_id string", 1))
        return found.withColumn("doc_id", F.col("doc_id").cast("long"))  # as text on the way, since pandas makes long with nulls inexact


def merkle_proofs(docs: DataFrame, levels: int = BAND) -> DataFrame:
    """For each row its leaf, subroot, root, the digest of its proof, and whether the row as it is now folds to the root.

    Rows whose doc_id has an even crc32 are taken without their text's line ends ("tampered").
    Null values enter a leaf as `-`, empty texts as `0:`; long texts are hashed whole.
    Rows that share source and doc_id are leaves of their own, in the order of their
    leaves. An empty table gives an empty result. Clashing extra columns are ignored.
    levels: how many levels a bucket spans; it doesn't change the result.
    """
    manifest = Manifest(docs, levels)
    return docs.sparkSession.createDataFrame([], PROOF) if manifest.empty else manifest.proofs()
