"""Operator 5: exact top-k inner products with norm order and rotated partial sums."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sentrylake.llm.text import cut, small_batches

#: Queries of a block, and blocks whose best a task holds at a time.
QUERY_BLOCK, HELD_BLOCKS = 4096, 8
#: Longest vectors that give the first thresholds; a bound on what the driver holds.
LONGEST = 2048
SCALE = 256.0
HEAD = 0.75


def whole_vectors(vectors: DataFrame, scale: float = SCALE) -> DataFrame:
    """(vec_id, x, norm): vectors as whole numbers, floor(scale * component); those with a null or non-finite component go."""
    bad = F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    x = F.transform("embedding", lambda c: F.floor(c.cast("double") * scale).cast("long"))
    fit = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~bad)
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double")))
    return fit.select("vec_id", x.alias("x")).withColumn("norm", norm)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of equal width; shorter vectors are filled with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.asarray(pa.compute.list_value_length(column), np.int64)
    out = np.zeros((len(size), dim), np.int64)
    out[np.arange(dim)[None, :] < size[:, None]] = np.asarray(column.flatten(), np.int64)
    return out


def _gram(vectors: DataFrame, dim: int) -> np.ndarray:
    """Sum of the outer products of all vectors, dim x dim."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            x = _matrix(batch.column("x"), dim).astype(float)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim * dim)), pa.array(total.ravel())], ["at", "v"])

    rows = vectors.select("x").mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros(dim * dim)
    out[rows["at"].to_numpy()] = rows["v"].to_numpy()
    return out.reshape(dim, dim)


class Search:
    """Best k of each query so far, over vectors that come in chunks by descending length."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, rotation: np.ndarray, k: int, least: np.ndarray | None = None):
        self.ids, self.q, self.rotation, self.k = ids, queries, rotation, k
        self.head = max(1, int(HEAD * queries.shape[1]))
        r = queries @ rotation
        self.r, self.norm, self.rest = r[:, : self.head], np.linalg.norm(r, axis=1), np.linalg.norm(r[:, self.head :], axis=1)
        self.least = np.full(len(ids), -np.inf) if least is None else least.copy()
        self.best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))  # query, score, vec_id

    def take(self, ids: np.ndarray, x: np.ndarray) -> None:
        """Exact scores only where |q| |x|, then the head's sum plus the Cauchy-Schwarz bound of the rest, reach the k-th best."""
        norm = np.linalg.norm(x.astype(float), axis=1)
        slack = 1e-6 * (1 + self.norm * norm.max(initial=0))
        some = np.flatnonzero(self.norm * norm.max(initial=0) + slack >= self.least)
        if not len(some) or not len(ids):
            return
        r = x @ self.rotation
        bound = self.r[some] @ r[:, : self.head].T + self.rest[some, None] * np.linalg.norm(r[:, self.head :], axis=1)[None, :]
        qi, xi = np.nonzero(bound + slack[some, None] >= self.least[some, None])
        qi = some[qi]
        other = self.ids[qi] != ids[xi]
        qi, xi = qi[other], xi[other]
        score = np.empty(len(qi), np.int64)
        for i in range(0, len(qi), 65536):
            at = slice(i, i + 65536)
            score[at] = np.einsum("ij,ij->i", self.q[qi[at]], x[xi[at]])
        q, s, v = (np.concatenate(z) for z in zip(self.best, (qi, score, ids[xi]), strict=True))
        order = np.lexsort((v, -s, q))
        q, s, v = q[order], s[order], v[order]
        start = np.searchsorted(q, q, "left")
        keep = np.arange(len(q)) - start < self.k
        self.best = q[keep], s[keep], v[keep]
        q, s, _ = self.best
        last = np.flatnonzero(np.arange(len(q)) - np.searchsorted(q, q, "left") == self.k - 1)
        self.least[q[last]] = np.maximum(self.least[q[last]], s[last])

    def run(self, ids: np.ndarray, x: np.ndarray, most: int = 2048) -> None:
        at, step = 0, 64
        while at < len(ids):
            self.take(ids[at : at + step], x[at : at + step])
            at, step = at + step, min(most, 2 * step)


def _packed(x: np.ndarray) -> tuple[bytes, str]:
    """A matrix of whole numbers in the least type that holds it."""
    low, high = int(x.min(initial=0)), int(x.max(initial=0))
    kind = next(t for t in ("int8", "int16", "int32", "int64") if np.iinfo(t).min <= low and high <= np.iinfo(t).max)
    return np.ascontiguousarray(x, kind).tobytes(), kind


def _unpacked(data: bytes, kind: str, dim: int) -> np.ndarray:
    return np.frombuffer(data, kind).reshape(-1, dim).astype(np.int64)


def query_blocks(asked: DataFrame, head: tuple[np.ndarray, np.ndarray], rotation: np.ndarray, k: int) -> DataFrame:
    """A row for each block of asked (vec_id, x, _block): its queries, packed, the score each must reach by the longest vectors (`head`), and `reach`, the length that a vector needs to matter to any of them."""
    dim = len(rotation)

    def run(table: pa.Table) -> pa.Table:
        ids, q = np.asarray(table.column("vec_id")), _matrix(table.column("x"), dim)
        search = Search(ids, q, rotation, k)
        search.run(*head)
        with np.errstate(divide="ignore", invalid="ignore"):
            need = np.where(search.norm > 0, search.least / search.norm, np.where(search.least > 0, np.inf, -np.inf))
        data, kind = _packed(q)
        row = {"_block": [table.column("_block")[0].as_py()], "q_ids": [ids], "q": [data], "q_kind": [kind], "least": [search.least], "reach": [float(need.min())]}
        return pa.table(row, schema=pa.schema([("_block", pa.int64()), ("q_ids", pa.list_(pa.int64())), ("q", pa.binary()), ("q_kind", pa.string()), ("least", pa.list_(pa.float64())), ("reach", pa.float64())]))

    return asked.groupBy("_block").applyInArrow(run, "_block long, q_ids array<long>, q binary, q_kind string, least array<double>, reach double")


def vector_chunks(rows: DataFrame, dim: int) -> DataFrame:
    """(v_ids, v, v_kind, top): the vectors of an Arrow batch, packed, and their greatest length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                data, kind = _packed(_matrix(batch.column("x"), dim))
                yield pa.RecordBatch.from_arrays([pa.array([np.asarray(batch.column("vec_id"))], pa.list_(pa.int64())), pa.array([data], pa.binary()), pa.array([kind]), pa.array([float(np.asarray(batch.column("norm")).max())])], ["v_ids", "v", "v_kind", "top"])

    return rows.select("vec_id", "x", "norm").mapInArrow(run, "v_ids array<long>, v binary, v_kind string, top double")


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: float = SCALE, block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id and score of the k best other rows for each query row.

    Queries are the rows whose vec_id is divisible by `every`; a query's own row
    (any row of its vec_id) is no candidate. Ties go to the smaller vec_id. Rows with
    null vec_id or vector, or with a null or non-finite component take no part;
    vectors of unequal length count as filled with zeros. Repeated rows are
    candidates each and, as queries, are answered once. Fewer candidates than k give
    fewer rows; an empty table none. Columns other than vec_id and embedding, whatever
    their names, aren't looked at. Sums of products must stay below 2^63.

    The vectors are written once in ranges of descending length (equal lengths are
    spread by hash) and read in chunks. Queries lie in blocks of about `block`, to which
    the LONGEST vectors give first thresholds, in tasks. A chunk is joined with the
    blocks that its longest vector can matter to, on the block's number; what a task
    finds for a block raises that block's thresholds for the chunks that follow. Only
    the LONGEST vectors and a dim x dim matrix pass through the driver.
    """
    small_batches(vectors.sparkSession)
    x = whole_vectors(vectors, scale)
    spread = F.xxhash64("vec_id")
    rows = cut(x.repartitionByRange(F.desc("norm"), spread).sortWithinPartitions(F.desc("norm"), spread))
    dim, queries = rows.agg(F.max(F.size("x")), F.count_if(F.col("vec_id") % every == 0)).first()
    out = vectors.sparkSession.createDataFrame([], "query_id long, vec_id long, score long")
    if not dim or not queries:
        return out.select("query_id", F.lit(0).alias("rank"), "vec_id", "score")
    values, axes = np.linalg.eigh(_gram(rows, dim))
    rotation = axes[:, np.argsort(-values)]
    longest = rows.orderBy(F.desc("norm"), "vec_id").limit(LONGEST).select("vec_id", "x").toArrow()
    head = np.asarray(longest.column("vec_id")), _matrix(longest.column("x"), dim)
    asked = rows.filter(F.col("vec_id") % every == 0).dropDuplicates(["vec_id"]).select("vec_id", "x")
    blocks = cut(query_blocks(asked.withColumn("_block", F.pmod(F.xxhash64("vec_id"), F.lit(-(-queries // block)))), head, rotation, k))
    reaches = blocks.agg(F.collect_list(F.struct("_block", "reach"))).scalar()  # two numbers a block
    chunks = cut(vector_chunks(rows, dim))
    near = F.expr("filter(_reaches, r -> r.reach <= top * 1.00001D + 0.001D)")
    met = chunks.withColumn("_reaches", reaches).withColumn("_r", F.explode(near)).select("v_ids", "v", "v_kind", F.col("_r._block").alias("_block")).join(blocks.drop("reach"), "_block")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Search] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                own = {c: batch.column(c)[i] for c in batch.schema.names}
                number = own["_block"].as_py()
                if number not in held:
                    if len(held) == HELD_BLOCKS:
                        yield best(held.pop(next(iter(held))))
                    held[number] = Search(np.asarray(own["q_ids"].values), _unpacked(own["q"].as_py(), own["q_kind"].as_py(), dim), rotation, k, np.asarray(own["least"].values))
                held[number].run(np.asarray(own["v_ids"].values), _unpacked(own["v"].as_py(), own["v_kind"].as_py(), dim))
        for search in held.values():
            yield best(search)

    def best(search: Search) -> pa.RecordBatch:
        at, score, vec = search.best
        return pa.RecordBatch.from_arrays([pa.array(search.ids[at]), pa.array(vec), pa.array(score)], ["query_id", "vec_id", "score"])

    out = met.mapInArrow(find, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
