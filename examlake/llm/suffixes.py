"""Removal of repeated strings by prefix-free parsing.

A rolling hash over GRAM bytes triggers phrases: the smallest hash in each window of WIDTH bytes is its trigger, so that every string of
WIDTH bytes holds one, and two equal strings hold the same one at the same place. The parse of a document is its sequence of phrases, each
reaching WIDTH bytes beyond its last start, so that neighbours overlap and each string of WIDTH bytes lies within one phrase.

The dictionary has one entry for equal phrases (64 bits of BLAKE2b under equal 64-bit trigger hashes), with its first occurrence in corpus
order: doc_id, then position. Every later occurrence is a repeat as a whole, without a look at its suffixes; that is where highly repetitive
text gets cheap. A string can only start in two entries if they share a trigger, so the dictionary is dealt out by triggers, and each share has
its own suffix array: suffixes sorted on their bytes by prefix doubling, to the WIDTH bytes that the question asks about. Equal strings are
neighbours there; ordered by the parse (doc_id, place) among themselves, all but the first are repeats. Beyond these bytes neither the
dictionary's nor the parse's order can change the answer, so the parse itself needs no suffix array of its own.

A trigger with very many different phrases (HOT) isn't met in one task: its strings are dealt out one by one, by 128 bits of BLAKE2b.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .asking import CHUNKS_A_PART, answers, by_bucket, expand, questions, squeeze, with_answers
from .chunks import id_column, packed, rows_of, unpack
from .shared import U64, mix, releasing, written

#: Bytes of a string that counts as a repeat.
WIDTH = 100
#: Bytes under the rolling hash.
GRAM = 32
#: Different phrases of a trigger up to which they share one suffix array.
HOT = 4096
_BASE = 0x9E3779B97F4A7C15
SINGLE, REPEAT, OPEN, SPREAD = 0, 1, 2, 3


def rolling(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """The hash of the gram bytes at each position (gram: a power of two), by doubling."""
    if len(data) < gram:
        return np.zeros(0, U64)
    out, width, power = data.astype(U64) + U64(1), 1, _BASE
    while width < gram:
        head = out[:-width] * U64(power)
        head += out[width:]
        out, width, power = head, width * 2, power * power % (1 << 64)
    return mix(out)


def gram_keys(data: np.ndarray, at: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """The same hash at some positions."""
    powers = np.array([pow(_BASE, gram - 1 - j, 1 << 64) for j in range(gram)], U64)
    views, out = np.lib.stride_tricks.sliding_window_view(data, gram) if len(data) >= gram else None, np.zeros(len(at), U64)
    for i in range(0, len(at), 1 << 15):
        out[i : i + (1 << 15)] = ((views[at[i : i + (1 << 15)]].astype(U64) + U64(1)) * powers).sum(axis=1, dtype=U64)
    return mix(out)


def phrases(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First start, last start and trigger of each phrase; the starts of all strings of width bytes within documents, cut by trigger."""
    none = np.zeros(0, np.int64)
    if len(data) < width:
        return none, none, none
    least = rolling(data, gram)
    bits = U64(len(data).bit_length())
    least = (least >> bits << bits) | np.arange(len(least), dtype=np.uint64)
    span, reach = width - gram + 1, 1
    while reach * 2 <= span:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if span > reach:
        least = np.minimum(least[: len(least) - (span - reach)], least[span - reach :])
    trigger = (least & ((U64(1) << bits) - U64(1))).astype(np.int64)
    edge = np.zeros(len(data) + 1, np.int32)
    np.add.at(edge, offsets[:-1], 1)
    np.add.at(edge, np.maximum(offsets[1:] - width + 1, offsets[:-1]), -1)
    start = np.flatnonzero(np.cumsum(edge)[: len(trigger)] > 0)
    if not len(start):
        return none, none, none
    trigger = trigger[start]
    new = np.ones(len(start), bool)
    new[1:] = (trigger[1:] != trigger[:-1]) | (start[1:] != start[:-1] + 1) | np.isin(start[1:], offsets[1:-1])
    at = np.flatnonzero(new)
    return start[at], start[np.append(at[1:], len(start)) - 1], trigger[at]


def _digests(data: np.ndarray, start: np.ndarray, stop: np.ndarray, size: int) -> np.ndarray:
    """BLAKE2b of so many bytes of each range; a row of 64-bit words each."""
    view, made = memoryview(data.tobytes()), hashlib.blake2b
    raw = b"".join([made(view[a:b], digest_size=size).digest() for a, b in zip(start.tolist(), stop.tolist(), strict=True)])
    return np.frombuffer(raw, U64).reshape(len(start), size // 8)


def _firsts(doc: np.ndarray, *key: np.ndarray) -> np.ndarray:
    """Whether each is the first of its key in order of doc, then place."""
    order = np.lexsort((doc, *key))  # stable: the place decides last
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in key:
        new[1:] |= k[order[1:]] != k[order[:-1]]
    out = np.empty(len(order), bool)
    out[order] = new
    return out


class _Parsed:
    """A chunk with its parse; lead marks the first phrase of each dictionary entry within the chunk."""

    def __init__(self, row: dict, width: int, gram: int):
        self.ids, self.data, self.offsets = unpack(row)
        self.width = width
        if row.get("parse") is None:
            self.first, self.last, self.trigger = phrases(self.data, self.offsets, width, gram)
            self.key = gram_keys(self.data, self.trigger, gram)
            self.lead = _firsts(self.doc(self.first), self.whole(slice(None)), self.key)
        else:
            gap, size, to_trigger, lead = expand(row["parse"])
            self.first = np.cumsum(gap, dtype=np.int64)
            self.last, self.trigger, self.lead = self.first + size, self.first + to_trigger, lead.astype(bool)
            self.key = gram_keys(self.data, self.trigger, gram)

    def frame(self) -> bytes:
        return squeeze(np.diff(self.first, prepend=0).astype(np.int32), (self.last - self.first).astype(np.uint8), (self.trigger - self.first).astype(np.uint8), self.lead.astype(np.uint8))

    def doc(self, start: np.ndarray) -> np.ndarray:
        return self.ids[np.searchsorted(self.offsets, start, "right") - 1]

    def whole(self, which) -> np.ndarray:
        return _digests(self.data, self.first[which], self.last[which] + self.width, 8)[:, 0]

    def flags(self, row: dict, n_buckets: int) -> np.ndarray:
        """SINGLE, REPEAT, OPEN or SPREAD for each phrase."""
        out, lead = np.full(len(self.first), REPEAT, np.uint8), np.flatnonzero(self.lead)
        told = {x["bucket"]: x["told"] for x in row["phrase_answers"] or []}
        for b, at in by_bucket(_bucket(self.key[lead], n_buckets), n_buckets):
            out[lead[at]] = expand(told[b])[0]
        return out

    def starts(self, of: np.ndarray) -> np.ndarray:
        """The starts of all strings of some phrases."""
        size = self.last[of] - self.first[of] + 1
        return np.repeat(self.first[of] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum()) if len(of) else np.zeros(0, np.int64)

    def spread(self, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The strings of phrases with hot triggers: starts, digests, and whether each is its first in the chunk."""
        start = self.starts(np.flatnonzero(flags == SPREAD))
        digest = _digests(self.data, start, start + self.width, 16)
        return start, digest, _firsts(self.doc(start), digest[:, 1], digest[:, 0])


def _bucket(key: np.ndarray, n_buckets: int) -> np.ndarray:
    return (key % U64(n_buckets)).astype(np.int64)


def _delta(doc: np.ndarray) -> np.ndarray:
    return np.diff(doc, prepend=np.int64(0))  # they squeeze well


def _asked_phrases(n_buckets: int, width: int, gram: int):
    def ask(row: dict) -> Iterator[tuple[int, bytes]]:
        chunk = _Parsed(row, width, gram)
        lead = np.flatnonzero(chunk.lead)
        if len(lead):
            key, whole, doc = chunk.key[lead], chunk.whole(lead), chunk.doc(chunk.first[lead])
            for b, at in by_bucket(_bucket(key, n_buckets), n_buckets):
                yield b, squeeze(key[at], whole[at], _delta(doc[at]))

    return ask


def _entries(asked: list[bytes]) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
    parts = [expand(x) for x in asked]
    return [len(p[0]) for p in parts], *(np.concatenate(x) for x in ([p[0] for p in parts], [p[1] for p in parts], [np.cumsum(p[2]) for p in parts]))


def _split(flags: np.ndarray, lengths: list[int]) -> list[bytes]:
    ends = np.cumsum([0, *lengths])
    return [squeeze(flags[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _solved_phrases(hot: int):
    def solve(asked: list[bytes]) -> list[bytes]:
        sizes, key, whole, doc = _entries(asked)
        lead = _firsts(doc, whole, key)
        _, of, n = np.unique(key[lead], return_inverse=True, return_counts=True)
        flags = np.full(len(key), REPEAT, np.uint8)
        flags[lead] = np.where(n[of] > hot, SPREAD, np.where(n[of] > 1, OPEN, SINGLE))
        return _split(flags, sizes)

    return solve


def _narrowed_phrases(asked: list[bytes]) -> bytes:
    _, key, whole, doc = _entries(asked)
    lead = _firsts(doc, whole, key)
    return squeeze(key[lead], whole[lead], _delta(doc[lead]))


def _widened_phrases(asked: list[bytes], told: bytes) -> list[bytes]:
    sizes, key, whole, doc = _entries(asked)
    flags = np.full(len(key), REPEAT, np.uint8)
    flags[_firsts(doc, whole, key)] = expand(told)[0]
    return _split(flags, sizes)


def _asked_strings(n_buckets: int, width: int, gram: int):
    """Of open phrases, the bytes and the place in corpus order; of spread ones, the digests of their strings."""

    def ask(row: dict) -> Iterator[tuple[int, bytes]]:
        chunk = _Parsed(row, width, gram)
        flags = chunk.flags(row, n_buckets) if len(chunk.first) else np.zeros(0, np.uint8)
        of = np.flatnonzero(flags == OPEN)
        start, digest, lead = chunk.spread(flags)
        start, digest = start[lead], digest[lead]
        doc, string_doc = chunk.doc(chunk.first[of]), chunk.doc(start)
        own = dict(by_bucket(_bucket(chunk.key[of], n_buckets), n_buckets))
        single = dict(by_bucket(_bucket(digest[:, 0], n_buckets), n_buckets))
        none = np.zeros(0, np.int64)
        for b in sorted(own.keys() | single.keys()):
            at, s = own.get(b, none), single.get(b, none)
            size = chunk.last[of[at]] - chunk.first[of[at]] + width
            place = np.repeat(chunk.first[of[at]] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum()) if len(at) else none
            yield b, squeeze(_delta(doc[at]), size.astype(np.int32), chunk.data[place], digest[s, 0], digest[s, 1], _delta(string_doc[s]))

    return ask


def string_ranks(data: np.ndarray, start: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """The rank of each string of width bytes (8 at least) in byte order, equal strings alike: suffix sorting by prefix doubling."""
    if not len(start):
        return np.zeros(0, np.int64)
    rank, reach = data.astype(U64), 1
    while reach < 8:  # eight bytes are one word
        rank = (rank[:-reach] << U64(8 * reach)) | rank[reach:]
        reach *= 2
    rank = np.unique(rank, return_inverse=True)[1].astype(U64)
    while reach * 2 <= width:
        rank = np.unique((rank[:-reach] << U64(32)) | rank[reach:], return_inverse=True)[1].astype(U64)
        reach *= 2
    return np.unique((rank[start] << U64(32)) | rank[start + width - reach], return_inverse=True)[1]


class _Strings:
    """What chunks ask about strings in one bucket."""

    def __init__(self, asked: list[bytes], width: int):
        parts = [expand(x) for x in asked]
        self.width = width
        self.doc, self.size, self.data = np.concatenate([np.cumsum(p[0]) for p in parts]), np.concatenate([p[1] for p in parts]).astype(np.int64), np.concatenate([p[2] for p in parts])
        self.high, self.low, self.string_doc = np.concatenate([p[3] for p in parts]), np.concatenate([p[4] for p in parts]), np.concatenate([np.cumsum(p[5]) for p in parts])
        self.strings = [int((p[1].astype(np.int64) - width + 1).sum()) for p in parts]
        self.spread = [len(p[3]) for p in parts]

    def spread_lead(self) -> np.ndarray:
        return _firsts(self.string_doc, self.low, self.high)

    def flags(self) -> tuple[np.ndarray, np.ndarray]:
        """1 for each string of a phrase, and for each spread string, that starts earlier in the corpus too."""
        n = self.size - self.width + 1
        begin = np.cumsum(self.size) - self.size
        start = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
        rank = string_ranks(self.data, start, self.width)
        return (~_firsts(np.repeat(self.doc, n), rank)).astype(np.uint8), (~self.spread_lead()).astype(np.uint8)

    def told(self, own: np.ndarray, spread: np.ndarray) -> list[bytes]:
        a, b = np.cumsum([0, *self.strings]), np.cumsum([0, *self.spread])
        return [squeeze(own[a[i] : a[i + 1]], spread[b[i] : b[i + 1]]) for i in range(len(self.strings))]


def _solved_strings(width: int):
    def solve(asked: list[bytes]) -> list[bytes]:
        strings = _Strings(asked, width)
        return strings.told(*strings.flags())

    def narrow(asked: list[bytes]) -> bytes:  # phrases asked about are distinct already
        s = _Strings(asked, width)
        lead = s.spread_lead()
        return squeeze(_delta(s.doc), s.size.astype(np.int32), s.data, s.high[lead], s.low[lead], _delta(s.string_doc[lead]))

    def widen(asked: list[bytes], told: bytes) -> list[bytes]:
        s = _Strings(asked, width)
        own, of_leads = expand(told)
        spread = np.ones(len(s.high), np.uint8)
        spread[s.spread_lead()] = of_leads
        return s.told(own, spread)

    return solve, narrow, widen


def _repeats(row: dict, chunk: _Parsed, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of what starts earlier too: whole phrases, and single strings."""
    flags = chunk.flags(row, n_buckets)
    told = {x["bucket"]: expand(x["told"]) for x in row["string_answers"] or []}
    of, again = np.flatnonzero(flags == OPEN), flags == REPEAT
    size = chunk.last[of] - chunk.first[of] + 1
    ends = np.cumsum(size)
    hit = np.zeros(int(size.sum()), bool)
    for b, at in by_bucket(_bucket(chunk.key[of], n_buckets), n_buckets):
        place = np.repeat(ends[at] - size[at] - (np.cumsum(size[at]) - size[at]), size[at]) + np.arange(size[at].sum())
        hit[place] = told[b][0] == 1
    start, digest, lead = chunk.spread(flags)
    spread, leads = np.ones(len(start), bool), np.flatnonzero(lead)
    for b, at in by_bucket(_bucket(digest[leads, 0], n_buckets), n_buckets):
        spread[leads[at]] = told[b][1] == 1
    single = np.concatenate([chunk.starts(of)[hit], start[spread]])
    return np.concatenate([chunk.first[again], single]), np.concatenate([chunk.last[again], single]) + chunk.width


def _kept(n_buckets: int, width: int, gram: int, texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            chunk = _Parsed(row, width, gram)
            data, offsets, edge = chunk.data, chunk.offsets, np.zeros(len(chunk.data) + 1, np.int32)
            if len(chunk.first):
                start, stop = _repeats(row, chunk, n_buckets)
                np.add.at(edge, start, 1)
                np.add.at(edge, stop, -1)
            gone = np.cumsum(edge[:-1]) > 0
            removed, spans, digests, kept = [], [], [], []
            for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                out = gone[a:b]
                removed.append(int(out.sum()))
                spans.append(int(out[:1].sum() + (out[1:] & ~out[:-1]).sum()) if removed[-1] else 0)
                rest = data[a:b][~out].tobytes() if removed[-1] else data[a:b].tobytes()
                digests.append(hashlib.sha256(rest).hexdigest())
                if texts:
                    kept.append(rest.decode("utf-8", "ignore"))
            columns = [id_column(row), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(kept, pa.string())] if texts else []), names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["text"] * texts)

    return run


def _with_parse(width: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                (row,) = rows_of([one])
                yield pa.RecordBatch.from_arrays([*one.columns, pa.array([_Parsed(row, width, gram).frame()], pa.binary())], names=[*one.schema.names, "parse"])

    return run


def repeated_strings(docs: DataFrame, texts: bool = False, width: int = WIDTH, gram: int = GRAM, hot: int = HOT, chunks_a_part: int = CHUNKS_A_PART) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each document; texts: also what is left, as text.

    A byte goes if a string of width bytes covers it that also starts earlier in the corpus: in a document with a smaller doc_id, or
    earlier in the same one. Strings are judged on the input and never cross documents. Null texts count as empty: 0 bytes, digest of
    nothing. A null doc_id stays null and counts as the smallest. Rows with the same doc_id are taken one after the other, as they happen to
    be read. In kept texts, a character that lost part of its bytes is dropped. Other columns don't matter; an empty table gives no rows.
    width: from gram to 255; gram: a power of two from 8 on.
    """
    chunks = written(packed(docs, after=_with_parse(width, gram), more=", parse binary"), "parsed")
    n_chunks = chunks.count()
    n_buckets = max(4, n_chunks // 2)
    told = written(answers(questions(chunks, _asked_phrases(n_buckets, width, gram)), n_chunks, _solved_phrases(hot), _narrowed_phrases, _widened_phrases, chunks_a_part), "phrases")
    open_ = with_answers(chunks, told, "phrase_answers")
    told_strings = written(answers(questions(open_, _asked_strings(n_buckets, width, gram)), n_chunks, *_solved_strings(width), chunks_a_part), "strings")
    both = with_answers(open_, told_strings, "string_answers")
    return both.mapInArrow(releasing(_kept(n_buckets, width, gram, texts)), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", text string" * texts)
