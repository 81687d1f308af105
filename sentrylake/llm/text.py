"""Shared pieces: word extraction on Arrow buffers, 64-bit hashes, and cutting lineage.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D. UTF-8 never uses
those bytes inside a longer character, so words can be found on raw bytes.
"""

from __future__ import annotations

import contextlib
import ctypes
import os
import sys
import tempfile
import types
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Arrow's own pool keeps what it frees; a worker lives on between tasks and shares its executor's memory.
pa.set_memory_pool(pa.system_memory_pool())

WORD_SQL = r"[^\x20\x09-\x0D]+"
#: Bytes of text that are turned into arrays at a time; bounds what a task holds beside its batch.
CHUNK_BYTES = 1 << 18
#: Bytes of an Arrow batch on its way to a Python worker, and where a worker cuts it into chunks at once.
BATCH_BYTES, SMALL_BATCH_BYTES = 8 << 20, 2 << 20
#: Rows that a Parquet reader holds as columns, texts among them.
READER_ROWS = 512
#: Bits of the filters that are broadcast: 8 MB, whatever the input. A full filter only lets more rows through.
FILTER_BITS = 1 << 26
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_P1, _P2 = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is set (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None) or os.environ.get("SENTRYLAKE_SCRATCH")
    if not path:
        path = os.environ["SENTRYLAKE_SCRATCH"] = tempfile.mkdtemp(prefix="spark-")
    return path.rstrip("/")


def small_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Bound the bytes of the Arrow batches that go to Python workers; a bound on rows alone lets long texts make huge ones.

    With a bound under BATCH_BYTES, few rows are read at a time as well: the executor
    holds a batch as it is read, as it is written to the worker and as the worker has it.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most))
    if most < BATCH_BYTES:
        spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(READER_ROWS))


def cut(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def held_out(key, modulus: int, remainder: int):
    """crc32 of the id as text, modulo; false where the id is null."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def sliced(batches, column: str, most: int = CHUNK_BYTES):
    """Arrow batches cut so that each holds about `most` bytes of `column`, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0), np.int64))
        at = 0
        while at < batch.num_rows:
            base = sizes[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(sizes, base + most, "right")))
            yield batch.slice(at, end - at)
            at = end
    release()


def release() -> None:
    """Give what this worker has freed back to the system, as workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # where the C library can't
        ctypes.CDLL(None).malloc_trim(0)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after another, and each text's bounds; null counts as empty."""
    texts = pa.compute.fill_null(texts, "")
    if not pa.types.is_string(texts.type):
        texts = texts.cast(pa.string())
    off = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def words_of(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all words joined, word bounds in them, words per text)."""
    data, off = buffers(texts)
    keep = ~SEPARATOR[data]
    first = keep.copy()
    first[1:] &= ~keep[:-1]
    inner = off[:-1][off[:-1] < len(keep)]
    first[inner] |= keep[inner]
    starts = np.flatnonzero(first)
    body = data[keep]
    if lower:
        body = LOWER[body]
    before = np.cumsum(keep, dtype=np.int32 if len(keep) < 1 << 31 else np.int64)  # a word's first byte counts itself
    bounds = np.append(before[starts].astype(np.int64) - 1, len(body))
    return body, bounds, np.diff(np.searchsorted(starts, off))


def as_strings(body: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(body)))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over a uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def kept_here() -> dict:
    """What this process keeps between tasks. Not a global of this module, as those travel with functions sent to executors."""
    return sys.modules.setdefault("_sentrylake_kept", types.ModuleType("_sentrylake_kept")).__dict__


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n, 1) - 1, np.uint64(base), np.uint64)]), dtype=np.uint64)


def _power(base: int, n: int) -> np.ndarray:
    """The first n powers of base modulo 2^64; those that a chunk needs are kept."""
    if n > CHUNK_BYTES + 1:
        return _powers(base, n)
    kept = kept_here()
    if f"power {base}" not in kept:
        kept[f"power {base}"] = _powers(base, CHUNK_BYTES + 1)
    return kept[f"power {base}"][:n]


def word_hashes(body: np.ndarray, bounds: np.ndarray, base: int = _P1) -> np.ndarray:
    """A uint64 for each word, from a polynomial of its bytes modulo 2^64.

    The polynomial starts at the word, so words can be taken in stretches of
    CHUNK_BYTES and a very long text needs no more memory than its bytes.
    """
    inverse, n = pow(base, -1, 1 << 64), len(bounds) - 1
    out, at = np.empty(n, np.uint64), 0
    with np.errstate(over="ignore"):
        while at < n:
            end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + CHUNK_BYTES, "right")) - 1)
            own = bounds[at : end + 1] - bounds[at]
            part = body[bounds[at] : bounds[end]].astype(np.uint64)
            part += np.uint64(1)
            part *= _power(base, len(part))
            total = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(part, out=total[1:])
            out[at:end] = (total[own[1:]] - total[own[:-1]]) * _power(inverse, len(part) + 1)[own[:-1]]
            at = end
        return mix64(out + np.diff(bounds).astype(np.uint64) * np.uint64(_P2))


def window_hashes(words: np.ndarray, k: int, base: int = _P2) -> np.ndarray:
    """A uint64 for each k consecutive words (over text bounds too; the caller masks those)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(n, np.uint64)
        for j in range(k):
            out = out * np.uint64(base) + words[j : j + n]
        return mix64(out + np.uint64(k))


def places(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For items dealt to groups: each item's group, and its place in the group."""
    group = np.repeat(np.arange(len(counts)), counts)
    return group, np.arange(len(group)) - np.repeat(np.cumsum(counts) - counts, counts)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def bit_filter(keys: DataFrame, column: str):
    """The keys as a bit filter of fixed size, gathered as at most FILTER_BITS / 64 words."""
    at = F.pmod(F.col(column), F.lit(FILTER_BITS))
    # pmod of a negative number differs from the unsigned remainder only by a multiple of 2^64, a multiple of FILTER_BITS
    words = keys.select(F.shiftright(at, 6).alias("w"), F.expr(f"shiftleft(1L, cast(pmod({column}, 64) as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    got = words.toArrow()
    bits[np.asarray(got.column("w"))] = np.asarray(got.column("b"))
    return keys.sparkSession.sparkContext.broadcast(bits)


def inside(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys & np.uint64(FILTER_BITS - 1)
    return (bits[at >> np.uint64(6)].view(np.uint64) >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def rows_of(docs: DataFrame, keys: DataFrame, *columns: str) -> DataFrame:
    """The rows of docs whose doc_id is in keys (doc_id), and perhaps a few more: a first sieve before a join on doc_id.

    The sieve is a bit filter of fixed size, so only the rows that pass are shuffled.
    """
    some = bit_filter(keys.select(F.xxhash64("doc_id").alias("h")), "h")
    kinds = dict(docs.dtypes)

    def sieve(batches):
        for batch in batches:
            h = np.asarray(batch.column("_h"), np.int64).view(np.uint64)
            batch = batch.filter(pa.array(inside(some.value, h)))
            yield pa.RecordBatch.from_arrays(batch.columns[:-1], batch.schema.names[:-1])

    named = docs.select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(columns)], F.xxhash64("doc_id").alias("_h"))
    out = named.mapInArrow(sieve, ", ".join(f"_c{i} {kinds[c]}" for i, c in enumerate(columns)))
    return out.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(columns)])
