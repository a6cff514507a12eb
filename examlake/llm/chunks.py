"""Documents packed into chunks of two megabytes: the unit that operators on bytes read, ask about and get answers for.

A chunk holds whole documents and is written once, so its number and contents stay the same however often a later step reads it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .shared import as_bytes, blocks, releasing, text_column

#: Bytes of text in a chunk; a longer document is a chunk of its own.
CHUNK_BYTES = 2 << 20
#: Stands for a null doc_id in the packed ids; `known` tells it from the same number as an id.
NO_ID = np.iinfo(np.int64).min
SCHEMA = "chunk long, ids binary, known binary, sizes binary, payload binary"
_NAMES = ["chunk", "ids", "known", "sizes", "payload"]


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task, seq = TaskContext.get().partitionId(), 0
    packer = zstandard.ZstdCompressor(level=1)
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

    def row() -> pa.RecordBatch:
        ids, known, sizes, data = (np.concatenate(x) for x in zip(*held, strict=True))
        frames = [ids.tobytes(), known.tobytes(), sizes.tobytes(), packer.compress(data.tobytes())]
        return pa.RecordBatch.from_arrays([pa.array([task << 32 | seq]), *[pa.array([x], pa.binary()) for x in frames]], names=_NAMES)

    for batch in batches:
        data, offsets = as_bytes(batch.column("text"))
        doc_id = batch.column("doc_id").cast(pa.int64())
        known = doc_id.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8)
        ids = doc_id.fill_null(int(NO_ID)).to_numpy()
        for i, j in blocks(offsets, CHUNK_BYTES // 4):
            if held and sum(len(x[3]) for x in held) + offsets[j] - offsets[i] > CHUNK_BYTES:
                yield row()
                held, seq = [], seq + 1
            held.append((ids[i:j], known[i:j], np.diff(offsets[i : j + 1]), data[offsets[i] : offsets[j]].copy()))
    if held:
        yield row()


def packed(docs: DataFrame, before: Callable | None = None, after: Callable | None = None, more: str = "") -> DataFrame:
    """docs (doc_id, text; null text: empty) as chunks with SCHEMA: ids, sizes as packed 64-bit, known as bytes, payload as zstd; to be written before it is used.

    before and after are functions from batches to batches that run in the same task on documents and on chunks; more: columns that `after` adds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = _pack(before(batches) if before else batches)
        return after(chunks) if after else chunks

    return docs.select("doc_id", text_column()).mapInArrow(releasing(run), SCHEMA + more)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The rows of batches of chunks, one by one."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)}


def unpack(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The doc_ids (NO_ID: null), the bytes and the offsets of a chunk."""
    offsets = np.concatenate([[0], np.cumsum(np.frombuffer(row["sizes"], np.int64))])
    data = zstandard.ZstdDecompressor().decompress(row["payload"], max_output_size=int(offsets[-1]) + 1)
    return np.frombuffer(row["ids"], np.int64), np.frombuffer(data, np.uint8), offsets


def id_column(row: dict) -> pa.Array:
    """A chunk's doc_ids with their nulls."""
    return pa.array(np.frombuffer(row["ids"], np.int64), mask=np.frombuffer(row["known"], np.uint8) == 0)
