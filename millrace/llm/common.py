"""What the corpus operators share: tables, shared storage, word and shingle hashing, components."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import time
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of words: space and the controls from tab to carriage return.
WHITESPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Texts are hashed in slices of about so many bytes, which bounds a worker's memory.
SLICE_BYTES = 2_000_000
#: Rows and bytes in one Arrow batch, so that a batch of long texts stays small.
BATCH_ROWS = 2_000
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Before Python runs on executors: rows per Arrow batch are BATCH_ROWS at most, and workers find this package."""
    paths = [p for p in (str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment.get("PYTHONPATH")) if p]
    spark.sparkContext.environment["PYTHONPATH"] = ":".join(dict.fromkeys(":".join(paths).split(":")))
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(f"spark.sql.execution.arrow.{key}").rstrip("b")
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(most))


def give_back() -> None:
    """At the end of a task: a reused worker returns the memory that it freed to the system."""
    global _powers
    _powers = _powers[0][:1], _powers[1][:1]
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library can
        ctypes.CDLL(None).malloc_trim(0)


def giving_back(work: Callable) -> Callable:
    """`work` over batches, for mapInArrow, that calls give_back when it ends or fails."""

    @functools.wraps(work)
    def run(batches: Iterator) -> Iterator:
        try:
            yield from work(batches)
        finally:
            give_back()

    return run


def shared_folder(spark: SparkSession) -> str:
    """A new path below spark.checkpoint.dir, which the driver and all executors can reach.

    The session's setting comes first, then the context's.  Only a local master (tests) may do
    without either: there a folder below the warehouse serves.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"{spark.conf.get('spark.sql.warehouse.dir')}/.millrace"
    return f"{base.rstrip('/')}/millrace-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove the folders of a stored table that nothing reads any more."""
    spark = df.sparkSession
    for path in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        if at.getName().startswith("millrace-"):
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Let Spark remove shuffle files of plans that nothing refers to any more.

    Its cleaner follows the driver's garbage collection, which may not happen for long.
    """
    for _ in range(2):  # listeners may still hold the last plan the first time
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


# ------------------------------------------------------------------ hashing

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(WHITESPACE)] = True
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64, over an array of unsigned 64-bit integers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def seeds(name: int, n: int) -> np.ndarray:
    """n fixed odd 64-bit numbers, a rule of the stream's number."""
    with np.errstate(over="ignore"):
        return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_BASE) + np.uint64(name * 0x51ED2701)) | np.uint64(1)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 1 << 20)
        with np.errstate(over="ignore"):
            up, down = np.full(size, _BASE, np.uint64), np.full(size, _BASE_INV, np.uint64)
            up[0] = down[0] = 1
            up, down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        if n > 8 * SLICE_BYTES:  # one huge text: do not keep its tables
            return up, down
        _powers = up, down
    return _powers


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, nulls as empty texts, and the offsets of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1 + column.offset)[column.offset :]
    size = int(at[-1] - at[0])
    return (np.frombuffer(data, np.uint8)[at[0] : at[-1]] if size else np.zeros(0, np.uint8)), at - at[0]


def byte_slices(offsets: np.ndarray, most: int = SLICE_BYTES):
    """Ranges of rows whose texts have about `most` bytes together, one row at least."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1)
        yield row, min(end, n)
        row = min(end, n)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each row the index of its first word."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~_IS_SPACE[data]
    first = np.zeros(len(data), bool)
    inner = offsets[:-1]
    first[inner[inner < len(data)]] = True
    starts = word.copy()
    starts[1:] &= ~word[:-1] | first[1:]
    last = np.ones(len(data), bool)
    last[:-1] = ~word[1:] | first[1:]
    start, end = np.flatnonzero(starts), np.flatnonzero(word & last) + 1
    return start, end, np.searchsorted(start, offsets)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, A-Z lower-cased: differences of one prefix sum, then mixed."""
    up, down = _power_tables(len(data) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
        value = (total[end] - total[start]) * down[start]
        return mix64(value + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingle_hashes(words: np.ndarray, first: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles in order, and for each row the index of its first one.

    A row of fewer words has its whole sequence as one shingle; a row of none has none.
    """
    counts = np.diff(first)
    weight = seeds(k, k)
    padded = np.concatenate([words, np.zeros(k, np.uint64)])
    with np.errstate(over="ignore"):
        value = sum((padded[j : j + len(words)] * weight[j] for j in range(k)), np.zeros(len(words), np.uint64))
        full = mix64(value)
        made = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
        at = np.concatenate([[0], np.cumsum(made)])
        rows = np.repeat(np.arange(len(counts)), made)
        out = full[first[:-1][rows] + (np.arange(at[-1]) - at[:-1][rows])] if at[-1] else np.zeros(0, np.uint64)
        for row in np.flatnonzero((counts > 0) & (counts < k)):
            own = words[first[row] : first[row + 1]]
            out[at[row]] = mix64(np.array([int(sum(int(w) * int(c) for w, c in zip(own, weight, strict=False)) + len(own) * _BASE) & _MASK], np.uint64))[0]
    return out, at


def text_shingles(column: pa.Array, k: int = 5):
    """Yield (row, sorted distinct shingle hashes) for each row of a column of texts."""
    data, offsets = text_buffers(column)
    for a, b in byte_slices(offsets):
        part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        start, end, first = word_spans(part, at)
        value, own = shingle_hashes(word_hashes(part, start, end), first, k)
        for row in range(b - a):
            yield a + row, np.unique(value[own[row] : own[row + 1]])


# --------------------------------------------------------------- components


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """The smallest node that each node of `edges` (a long, b long) reaches: (node, component).

    Large-star and small-star steps in turn (Kiveris et al., 2014).  Each step is a grouped
    minimum and a join, written to the shared folder; nothing reaches the driver but counts.
    """
    current = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    mark = None
    for _ in range(most_rounds):
        both = current.union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        joined = large.join(low, "a")
        small = joined.select(F.col("b").alias("a"), F.col("low").alias("b")).union(low.select("a", F.col("low").alias("b")))
        current = stored(small.where("a <> b").distinct())
        now = tuple(current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).cast("string")).first())
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("the components did not converge")
    return current.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
