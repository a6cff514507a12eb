"""Audio columns: lossless 8-bit samples in WAVE form, polyphase resampling, overlapped log-mel filterbanks, energy segments.

A clip is a multiple of BLOCK samples. Resampling by UP / DOWN turns a block into STEPS hops, so every block has a feature tensor of one
fixed shape, (STEPS, MELS); together with its time span it is a row of an Arrow table with a fixed-shape tensor column. Each clip's table is
stored as an Arrow stream beside the time spans of its energy segments.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import releasing, text_column, written

RATE = 16_000
BLOCK = 576
PAD = 255
UP, DOWN = 2, 3
FRAME, HOP, MELS = 256, 128, 20
STEPS = BLOCK * UP // DOWN // HOP
#: Taps of each phase of the resampling filter.
TAPS = 12
#: Decibels over the clip's median energy at which a segment begins, and below which it ends.
BEGIN_DB, END_DB = 1.5, 0.5


def wave(payload: bytes, rate: int = RATE) -> bytes:
    """8-bit mono samples as a RIFF WAVE file; odd lengths get the format's pad byte."""
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, rate, rate, 1, 8)
    data = struct.pack("<4sI", b"data", len(payload)) + payload + b"\0" * (len(payload) % 2)
    return struct.pack("<4sI4s", b"RIFF", 4 + len(fmt) + len(data), b"WAVE") + fmt + data


def samples(media: bytes) -> tuple[int, bytes]:
    """Rate and samples of such a file; chunks of other kinds are skipped."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a RIFF WAVE file")
    at, rate = 12, None
    while at + 8 <= len(media):
        kind, size = struct.unpack_from("<4sI", media, at)
        if kind == b"fmt ":
            form, channels, rate, _, _, width = struct.unpack_from("<HHIIHH", media, at + 8)
            if (form, channels, width) != (1, 1, 8):
                raise ValueError("only 8-bit mono PCM is stored here")
        elif kind == b"data":
            if rate is None or at + 8 + size > len(media):
                raise ValueError("damaged WAVE file")
            return rate, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no samples")


@cache
def _phases() -> np.ndarray:
    """A windowed sinc low-pass of UP * TAPS taps, a row for each phase, each of unit gain."""
    n = np.arange(UP * TAPS) - (UP * TAPS - 1) / 2
    taps = np.sinc(n / max(UP, DOWN)) * np.kaiser(UP * TAPS, 6.0)
    rows = taps.reshape(TAPS, UP).T[:, ::-1]
    return rows / rows.sum(axis=1, keepdims=True)


def resampled(x: np.ndarray) -> np.ndarray:
    """x at UP / DOWN of its rate: output m is phase (m * DOWN) % UP of the filter over the inputs around m * DOWN / UP."""
    n = len(x) * UP // DOWN
    padded = np.concatenate([np.zeros(TAPS // 2), x, np.zeros(TAPS // 2 + 1)])
    views = np.lib.stride_tricks.sliding_window_view(padded, TAPS)
    out = np.empty(n)
    for first in range(UP):
        at = np.arange(first, n, UP)
        out[first::UP] = views[at * DOWN // UP] @ _phases()[first * DOWN % UP]
    return out


@cache
def _filters() -> tuple[np.ndarray, np.ndarray]:
    """The frame's window, and triangular filters at even distances on the mel scale."""
    rate = RATE * UP / DOWN
    mel = np.linspace(0, 2595 * np.log10(1 + rate / 2 / 700), MELS + 2)
    edge, bins = 700 * (10 ** (mel / 2595) - 1), np.arange(FRAME // 2 + 1) * rate / FRAME
    rise = (bins[:, None] - edge[:-2]) / (edge[1:-1] - edge[:-2])
    fall = (edge[2:] - bins[:, None]) / (edge[2:] - edge[1:-1])
    return np.hanning(FRAME), np.maximum(0, np.minimum(rise, fall))


def log_mel(x: np.ndarray) -> np.ndarray:
    """(hops, MELS) log energies in decibels of frames that start at each hop; the last frames reach into silence."""
    window, filters = _filters()
    padded = np.concatenate([x, np.zeros(FRAME - HOP)])
    out = []
    for i in range(0, len(x) // HOP, 4096):
        frames = np.lib.stride_tricks.sliding_window_view(padded[i * HOP : (i + 4096) * HOP + FRAME - HOP], FRAME)[::HOP]
        power = np.abs(np.fft.rfft(frames * window, axis=1)) ** 2
        out.append(10 * np.log10(power @ filters + 1e-9))
    return np.concatenate(out).astype(np.float32)


def segments(mel: np.ndarray, begin: float = BEGIN_DB, end: float = END_DB) -> np.ndarray:
    """(n, 2) hop ranges: a segment begins where the energy rises to `begin` over the clip's median and lasts until it falls under `end`."""
    energy = mel.astype(np.float64).mean(axis=1)
    over = energy - np.median(energy)
    mark = np.where(over >= begin, 1, np.where(over < end, -1, 0))
    at = np.maximum.accumulate(np.where(mark != 0, np.arange(len(mark)), -1))
    on = np.where(at >= 0, mark[at], -1) == 1
    edge = np.diff(on.astype(np.int8), prepend=0, append=0)
    return np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], axis=1)


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 200):
            part = batch.slice(i, 200)
            raw = [x.encode() for x in part.column("text").to_pylist()]
            media = [wave(x + bytes([PAD]) * (-len(x) % BLOCK or (BLOCK if not x else 0))) for x in raw]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(x) for x in raw], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])


def stored_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each text's UTF-8 bytes, padded by 255 to a positive multiple of BLOCK, as WAVE in a written table."""
    return written(docs.select("doc_id", text_column()).mapInArrow(releasing(_stored), "doc_id long, n_bytes long, media binary"), "media")


def as_tensors(mel: np.ndarray) -> pa.Table:
    """The blocks of a clip: start_ms, stop_ms, tensor (a fixed-shape Arrow tensor of (STEPS, MELS) float32)."""
    blocks = np.ascontiguousarray(mel, np.float32).reshape(-1, STEPS, MELS)
    start = np.arange(len(blocks)) * 1000.0 * BLOCK / RATE
    return pa.table({"start_ms": start, "stop_ms": start + 1000.0 * BLOCK / RATE, "tensor": pa.FixedShapeTensorArray.from_numpy_ndarray(blocks)})


def packed_tensors(mel: np.ndarray) -> bytes:
    """The blocks of a clip as an Arrow stream."""
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, (table := as_tensors(mel)).schema) as out:
        out.write_table(table)
    return sink.getvalue()


def unpacked_tensors(stream: bytes) -> pa.Table:
    return pa.ipc.open_stream(stream).read_all()


def mel_of(stream: bytes) -> np.ndarray:
    """(hops, MELS) of a clip, from its stored tensors."""
    return np.concatenate([x.to_numpy_ndarray() for x in unpacked_tensors(stream).column("tensor").chunks]).reshape(-1, MELS)


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hop_ms = 1000 * HOP * DOWN / UP / RATE
    span = pa.list_(pa.struct([("start_ms", pa.float64()), ("stop_ms", pa.float64())]))
    types = {"payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "tensors": pa.binary(), "spans": span}
    for batch in batches:
        for i in range(0, batch.num_rows, 200):
            part = batch.slice(i, 200)
            rows = []
            for media in part.column("media").to_pylist():
                _, payload = samples(media)
                mel = log_mel(resampled((np.frombuffer(payload, np.uint8).astype(np.float64) - 128) / 128))
                spans = [{"start_ms": float(a * hop_ms), "stop_ms": float(b * hop_ms)} for a, b in segments(mel)]
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), packed_tensors(mel), spans))
            columns = [pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), types.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), *columns], names=["doc_id", "n_bytes", *types])


def stored_features(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, tensors, spans of stored clips, read back from them; a written table.

    tensors: an Arrow stream of the clip's blocks, each a fixed-shape tensor (STEPS, MELS) of log-mel energies with its time span; spans: the
    time spans of energy segments. A null or empty text is one block of padding. Equal clips get equal values: a clip is computed by itself.
    A null doc_id stays null. Damaged media raise an error. Repeated rows stay; other columns don't matter; an empty table gives no rows.
    """
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, tensors binary, spans array<struct<start_ms: double, stop_ms: double>>"
    return written(media.select("doc_id", "n_bytes", "media").mapInArrow(releasing(_featured), schema), "features")


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hop_ms = 1000 * HOP * DOWN / UP / RATE
    for batch in batches:
        texts = []
        for stream, spans in zip(batch.column("tensors"), batch.column("spans").to_pylist(), strict=True):
            mel = mel_of(stream.as_py()).astype(np.float64)
            voiced = round(sum(s["stop_ms"] - s["start_ms"] for s in spans) / hop_ms)
            mean, spread = mel.mean(axis=0), mel.std(axis=0)
            texts.append(f"blocks={len(mel) // STEPS};segments={len(spans)};voiced={voiced};mean=" + ",".join(f"{v:.2f}" for v in mean) + ";std=" + ",".join(f"{v:.2f}" for v in spread))
        kept = [name for name in batch.schema.names if name not in ("tensors", "spans")]
        yield pa.RecordBatch.from_arrays([*[batch.column(name) for name in kept], pa.array(texts, pa.string())], names=[*kept, "feature"])


def audio_features(features: DataFrame) -> DataFrame:
    """The columns of stored_features with feature, a text made of the stored tensors and spans, in their place."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return features.mapInArrow(releasing(_described), schema)
