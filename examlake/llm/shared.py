"""Helpers the corpus operators share: tables in the shared folder, byte views of Arrow columns, vectorised hashes.

Every hash here works on whole arrays of bytes in wrapping 64-bit arithmetic, so that a task handles a block of documents with a few
numpy calls instead of a Python step per character.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task holds in numpy arrays at once; a longer document is a block of its own.
BLOCK_BYTES = 2 << 20

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: The white space of the word definition: space and 9 to 13.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; only where that is unset (tests), a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="examlake-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_watching: list[list[str]] = []


@contextmanager
def working_tables() -> Iterator[list[str]]:
    """The paths of the tables that written() makes meanwhile."""
    _watching.append(paths := [])
    try:
        yield paths
    finally:
        _watching.remove(paths)


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: lineage ends there and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    for paths in _watching:
        paths.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_paths(spark: SparkSession, paths: Iterable[str]) -> None:
    for path in map(spark._jvm.org.apache.hadoop.fs.Path, paths):
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_written(*tables: DataFrame) -> None:
    """Delete the files of tables made by written(), once nothing reads them any more."""
    for df in tables:
        drop_paths(df.sparkSession, {f.rpartition("/")[0] for f in df.inputFiles()})


#: What tasks of this package keep in a Python worker between batches; each entry empties one such cache.
_caches: list[Callable[[], None]] = []


def kept_in_worker(clear: Callable[[], None]) -> None:
    """Register a cache that releasing() empties."""
    _caches.append(clear)


def release() -> None:
    """Empty the caches of this worker and give its free memory back to the system."""
    for clear in _caches:
        clear()
    gc.collect()
    trim()


def trim() -> None:
    """Give the worker's free memory back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not the C library that has it: the allocator keeps what it has
        pass


def releasing(run: Callable) -> Callable:
    """run (batches in, batches out) for mapInArrow or mapInPandas, releasing the worker's memory at its end.

    Workers outlive their tasks and idle ones stay for a minute, so what one operator leaves behind would add up with the next one's.
    """

    @wraps(run)
    def all_batches(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()

    return all_batches


def text_column(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit("")).alias(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column without nulls, and the offsets (one more than rows)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose bytes stay within limit; a longer row is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
kept_in_worker(_powers.clear)
#: Entries up to which tables of powers are kept for the next block; those for a longer text are made for it alone.
_KEPT_POWERS = (BLOCK_BYTES * 9) // 8


def _power_tables(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse."""
    if base in _powers and len(_powers[base][0]) >= n:
        return _powers[base]
    size = min(max(1 << 16, n + n // 8), max(n, _KEPT_POWERS))
    up, down = np.full(size, base, U64), np.full(size, pow(base, -1, 1 << 64), U64)
    up[0] = down[0] = 1
    np.cumprod(up, out=up)
    np.cumprod(down, out=down)
    if size <= _KEPT_POWERS:
        _powers[base] = up, down
    return up, down


class Rolling:
    """Hashes of any range of a block of bytes, from prefix sums of a polynomial in wrapping 64-bit arithmetic."""

    def __init__(self, data: np.ndarray, base: int = _BASE):
        up, self._down = _power_tables(base, len(data) + 1)
        self._sums = np.zeros(len(data) + 1, U64)
        terms = data.astype(U64)
        terms += U64(1)
        terms *= up[: len(data)]
        np.cumsum(terms, out=self._sums[1:])

    def ranges(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        out = self._sums[stop] - self._sums[start]
        out *= self._down[start]
        out ^= (stop - start).astype(U64) << U64(40)
        return mix(out)

    def grams(self, width: int) -> np.ndarray:
        """The hash of the width bytes at each position."""
        n = len(self._sums) - width
        if n <= 0:
            return np.zeros(0, U64)
        out = self._sums[width:] - self._sums[:n]
        out *= self._down[:n]
        return mix(out)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case A-Z and find the words of each document: lowered bytes, starts, stops and document index of each word."""
    low = _LOWER[data]
    inside = np.zeros(len(low) + 1, bool)
    np.logical_not(_SPACE[low], out=inside[:-1])
    first = inside[:-1].copy()
    first[1:] &= ~inside[:-2]
    edges = offsets[1:-1]
    edges = edges[edges < len(low)]
    first[edges] = inside[edges]
    starts = np.flatnonzero(first)
    last = inside[:-1] & ~inside[1:]
    ends = offsets[1:]
    ends = ends[ends > 0] - 1
    last[ends] = inside[ends]
    stops = np.flatnonzero(last) + 1
    return low, starts, stops, np.searchsorted(offsets, starts, "right") - 1
