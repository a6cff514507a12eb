"""Questions from chunks to key buckets and answers back: how tasks look up corpus-wide facts without any shared table.

A chunk asks about many 64-bit keys, each distinct one once. All keys of one bucket travel as one packed row, in the chunk's order; the
bucket sees the rows of all chunks, works out an answer for each key and returns them packed in the same order. There are at most as many
rows as keys. A key that very many chunks ask about is met in stages: the chunks of a part are solved together first, and only what is
distinct within the part goes on, so a bucket gets one entry a part for it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import rows_of
from .shared import releasing, trim, written

#: Chunks whose questions to one bucket are met by one task before the bucket itself; of fewer chunks, the bucket takes the questions at once.
CHUNKS_A_PART = 1024


def squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays as one zstd frame, each behind its length and type."""
    parts = []
    for x in arrays:
        raw = np.ascontiguousarray(x)
        parts += [f"{raw.dtype.str}:{raw.nbytes};".encode(), raw.tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def expand(frame: bytes) -> list[np.ndarray]:
    raw, out, at = zstandard.ZstdDecompressor().decompress(frame), [], 0
    while at < len(raw):
        end = raw.index(b";", at)
        kind, size = raw[at:end].decode().split(":")
        out.append(np.frombuffer(raw[end + 1 : end + 1 + int(size)], kind))
        at = end + 1 + int(size)
    return out


def by_bucket(bucket: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each bucket that occurs: its number and the indices it has, in order."""
    if not len(bucket):
        return
    order = np.argsort(bucket.astype(np.uint16 if n <= 65536 else np.int64), kind="stable")
    sorted_ = bucket[order]
    at = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
    for a, b in zip(at, np.append(at[1:], len(bucket)), strict=True):
        yield int(sorted_[a]), order[a:b]


def questions(chunks: DataFrame, ask: Callable[[dict], Iterator[tuple[int, bytes]]]) -> DataFrame:
    """bucket, chunk, asked: what ask(row of a chunk) yields."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            got = list(ask(row))
            if got:
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in got], pa.int32()), pa.array([row["chunk"]] * len(got), pa.int64()), pa.array([x for _, x in got], pa.binary())], names=["bucket", "chunk", "asked"])

    return chunks.mapInArrow(releasing(run), "bucket int, chunk long, asked binary")


def _direct(solve: Callable[[list[bytes]], list[bytes]]):
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("chunk")  # of equal doc_ids, the one in the earlier chunk counts as earlier
        told = solve(group.column("asked").to_pylist())
        out = pa.table({"bucket": group.column("bucket"), "chunk": group.column("chunk"), "told": pa.array(told, pa.binary())})
        trim()
        return out

    return run


def answers(asked: DataFrame, n_chunks: int, solve: Callable, narrow: Callable, widen: Callable, chunks_a_part: int = CHUNKS_A_PART) -> DataFrame:
    """bucket, chunk, told: a packed answer for each packed question.

    solve(questions) answers questions that are all there are in a bucket. For more than chunks_a_part chunks, narrow(questions) gives one
    question in the same form that stands for those of a part, and widen(questions, answer to it) their answers.
    """
    if n_chunks <= chunks_a_part:
        return asked.groupBy("bucket").applyInArrow(_direct(solve), "bucket int, chunk long, told binary")
    parts = -(-n_chunks // chunks_a_part)
    asked = written(asked.withColumn("part", F.pmod(F.xxhash64("chunk"), F.lit(parts)).cast("int")), "asked")

    def narrowed(group: pa.Table) -> pa.Table:
        group = group.sort_by("chunk")
        return pa.table({"bucket": group.column("bucket")[:1], "chunk": group.column("part")[:1].cast(pa.int64()), "asked": pa.array([narrow(group.column("asked").to_pylist())], pa.binary())})

    def widened(group: pa.Table, answer: pa.Table) -> pa.Table:
        group = group.sort_by("chunk")
        told = widen(group.column("asked").to_pylist(), answer.column("told")[0].as_py())
        return pa.table({"bucket": group.column("bucket"), "chunk": group.column("chunk"), "told": pa.array(told, pa.binary())})

    own = asked.groupBy("bucket", "part").applyInArrow(narrowed, "bucket int, chunk long, asked binary")
    told = own.groupBy("bucket").applyInArrow(_direct(solve), "bucket int, chunk long, told binary").withColumn("part", F.col("chunk").cast("int"))
    return asked.groupBy("bucket", "part").cogroup(told.groupBy("bucket", "part")).applyInArrow(widened, "bucket int, chunk long, told binary")


def with_answers(chunks: DataFrame, told: DataFrame, name: str = "told") -> DataFrame:
    """chunks with an array of (bucket, told) structs; null where a chunk asked nothing."""
    return chunks.join(told.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "told")).alias(name)), "chunk", "left")
