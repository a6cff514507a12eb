"""Language-model scoring by context-tree weighting over bytes, with exact corpus-wide counts.

A text is read as its tokens: lower-cased words, each followed by a space, then one end mark. Each byte is eight binary decisions, and each
decision (the bits of the byte seen so far) has a context tree of its own over the DEPTH preceding bytes. Every node holds a
Krichevsky-Trofimov estimate; a node's weighted probability is half its own estimate, half the product of its children's, and the posterior
of that choice mixes the predictions of all depths along the path. Counts come from all training documents, so the estimates and weights
have closed forms, and no order of documents matters.

Where things live: chunks count their distinct strings of DEPTH + 1 bytes, buckets (by the two nearest context bytes) merge these counts
and hold the trees from depth two down; of depths one and zero, at most 257 * 255 decisions in all, sums go through the driver. Chunks
then ask the buckets for the probabilities of their distinct strings and for the counts of their distinct words, and add up what they get.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from math import log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .asking import by_bucket, expand, questions, squeeze, with_answers
from .chunks import id_column, packed, rows_of, unpack
from .shared import U64, Rolling, as_bytes, blocks, mix, releasing, trim, words, written

#: Context bytes of the deepest nodes.
DEPTH = 5
#: Training strings of a bucket whose questions one task answers at least; more, more tasks, each with a copy of the bucket's counts. A bucket of
#: many distinct strings is copied only for eight times as many occurrences, so all copies together are smaller than the corpus.
STRINGS_A_TASK = 32 << 20
#: Tasks whose counts of one bucket are merged at once; of more, they are merged in rounds.
MERGED_AT_ONCE = 256
END = 10
_HALF = log(0.5)


def held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 7 == 2


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id and its token stream: words, each with a space behind it, and the end mark."""
    for batch in batches:
        data, offsets = as_bytes(batch.column("text"))
        for i, j in blocks(offsets):
            at = offsets[i : j + 1] - offsets[i]
            low, starts, stops, doc = words(data[offsets[i] : offsets[j]], at)
            sizes = stops - starts
            inside = np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum()) if len(starts) else np.zeros(0, np.int64)
            number = np.repeat(np.arange(len(starts)), sizes)
            out_sizes = np.bincount(doc, sizes + 1, j - i).astype(np.int64) + 1
            out = np.full(out_sizes.sum(), 32, np.uint8)
            out[np.arange(len(inside)) + number + doc[number]] = low[inside]
            ends = np.cumsum(out_sizes)
            out[ends - 1] = END
            text = pa.LargeBinaryArray.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64)), pa.py_buffer(out)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id")[i:j], text.cast(pa.binary())], names=["doc_id", "text"])


class _Chunk:
    """A chunk of token streams: its distinct strings of DEPTH + 1 bytes and its distinct words."""

    def __init__(self, row: dict, depth: int):
        self.ids, self.data, self.offsets = unpack(row)
        self.depth = depth
        known = np.frombuffer(row["known"], np.uint8)
        self.train = np.array([not (k and held_out(int(x))) for x, k in zip(self.ids, known, strict=True)], bool)

    def strings(self) -> np.ndarray:
        """A number for each byte: the nearest context byte is the most significant, the byte itself the least; before a text, end marks."""
        n, key = len(self.data), self.data.astype(U64)
        for d in range(1, self.depth + 1):
            shift = U64(8 * (self.depth - d + 1))
            key[d:] |= self.data[: n - d].astype(U64) << shift
            for r in range(d):  # the d bytes before the r-th byte of a text belong to no text
                at = self.offsets[:-1] + r
                at = at[at < self.offsets[1:]]
                key[at] = (key[at] & ~(U64(255) << shift)) | (U64(END) << shift)
        return key

    def tokens(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the tokens in order, and the number of tokens of each document."""
        stop = np.flatnonzero((self.data == 32) | (self.data == END))
        start = np.concatenate([[0], stop[:-1] + 1]) if len(stop) else stop
        key = Rolling(self.data).ranges(start, stop)
        return key, np.bincount(np.searchsorted(self.offsets, stop, "right") - 1, minlength=len(self.ids))


def _counted(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key = np.sort(key)
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[at], np.diff(np.append(at, len(key)))


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    key, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(key)
    key, n = key[order], n[order]
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[at], np.add.reduceat(n, at) if len(at) else n


def _string_bucket(key: np.ndarray, depth: int, n_buckets: int) -> np.ndarray:
    return (mix(key >> U64(8 * (depth - 1))) % U64(n_buckets)).astype(np.int64)


def _word_bucket(key: np.ndarray, n_buckets: int) -> np.ndarray:
    return (key % U64(n_buckets)).astype(np.int64)


def _delta(key: np.ndarray) -> np.ndarray:
    return np.diff(key, prepend=U64(0))


def _undelta(key: np.ndarray) -> np.ndarray:
    return np.cumsum(key, dtype=U64)


def _training(n_buckets: int, depth: int, held: int = 1 << 21):
    """Counts of training strings and words, merged over the chunks of a task as far as memory allows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list] = {0: [], 1: []}

        def flush() -> Iterator[pa.RecordBatch]:
            for kind, found in parts.items():
                if found:
                    key, n = _merged(found)
                    bucket = _word_bucket(key, n_buckets) if kind else _string_bucket(key, depth, n_buckets)
                    rows = [(b, squeeze(_delta(key[at]), n[at].astype(np.uint32 if n.max() < 1 << 32 else np.int64))) for b, at in by_bucket(bucket, n_buckets)]
                    yield pa.RecordBatch.from_arrays([pa.array([2 * b + kind for b, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], names=["bucket", "counts"])
                    found.clear()

        for row in rows_of(batches):
            chunk = _Chunk(row, depth)
            use = np.repeat(chunk.train, np.diff(chunk.offsets))
            parts[0].append(_counted(chunk.strings()[use]))
            key, per_doc = chunk.tokens()
            parts[1].append(_counted(key[np.repeat(chunk.train, per_doc)]))
            for found in parts.values():
                if len(found) > 1 and len(found[-1][0]) + len(found[0][0]) < held:
                    found[:] = [_merged(found)]
            if sum(len(p[0]) for p in parts[0]) > held or sum(len(p[0]) for p in parts[1]) > held:
                yield from flush()
        yield from flush()

    return run


def _merge_counts(pdf: pd.DataFrame) -> pd.DataFrame:
    """One frame for a bucket (or a part of its frames), with the number of keys and their sum."""
    key, n = _merged([(_undelta(p[0]), p[1].astype(np.int64)) for p in map(expand, pdf["counts"])])
    out = pd.DataFrame({"bucket": [pdf["bucket"].iloc[0]], "part": [pdf["part"].iloc[0]], "counts": [squeeze(_delta(key), n)], "distinct": [len(key)], "total": [int(n.sum())]})
    trim()
    return out


_LOG_GAMMA_HALF = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, 4096) - 0.5))])  # log of gamma(n + 1/2) / gamma(1/2)
_LOG_FACTORIAL = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, 8192)))])


def _stirling(x: np.ndarray) -> np.ndarray:
    return (x - 0.5) * np.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x**3)


def _log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Natural log of the Krichevsky-Trofimov probability of so many zeros and ones."""

    def half(n: np.ndarray) -> np.ndarray:
        return np.where(n < 4096, _LOG_GAMMA_HALF[np.minimum(n, 4095).astype(np.int64)], _stirling(np.maximum(n, 4096) + 0.5) - 0.5723649429247001)

    n = zeros + ones
    return half(zeros) + half(ones) - np.where(n < 8192, _LOG_FACTORIAL[np.minimum(n, 8191).astype(np.int64)], _stirling(np.maximum(n, 8192) + 1.0))


class _Trees:
    """The 255 context trees below depth `top` over sorted distinct strings with counts (0 for strings that only were asked for)."""

    def __init__(self, key: np.ndarray, n: np.ndarray, depth: int, top: int):
        self.depth, self.top = depth, top
        keys, counts, parents = {depth: key}, {depth: n.astype(np.float64)}, {}
        for d in range(depth - 1, top - 1, -1):
            below = keys[d + 1]
            short = (below >> U64(16) << U64(8)) | (below & U64(255))
            keys[d], parents[d + 1] = np.unique(short, return_inverse=True)
            counts[d] = np.bincount(parents[d + 1], counts[d + 1], len(keys[d]))
        self.keys, self.counts, self.parents = keys, counts, parents
        self.levels = [self._level(bit) for bit in range(8)]

    def _level(self, bit: int) -> dict[int, tuple]:
        """By depth: each string's node, and of the nodes: zeros, ones, log KT, log weighted, weight of the own estimate."""
        out: dict[int, tuple] = {}
        for d in range(self.depth, self.top - 1, -1):
            key = self.keys[d]
            name = key >> U64(8 - bit)
            new = np.concatenate([[True], name[1:] != name[:-1]])
            node = np.cumsum(new) - 1
            one = (key >> U64(7 - bit)) & U64(1) == U64(1)
            ones = np.bincount(node, np.where(one, self.counts[d], 0.0))
            zeros = np.bincount(node, self.counts[d]) - ones
            own = _log_kt(zeros, ones)
            if d == self.depth:
                weighted, weight = own, np.ones(len(own))
            else:
                below_node, below = out[d + 1][0], out[d + 1]
                first = np.flatnonzero(np.concatenate([[True], below_node[1:] != below_node[:-1]]))
                split = np.bincount(node[self.parents[d + 1][first]], below[4], len(own))
                weighted = np.logaddexp(own, split) + _HALF
                weight = np.exp(own + _HALF - weighted)
            out[d] = (node, zeros, ones, own, weighted, weight, one)
        return out

    def at_top(self) -> pd.DataFrame:
        """Of the nodes of the top depth: context, decision (1 and the bits so far), zeros, ones, log weighted."""
        rows = []
        for bit in range(8):
            node, zeros, ones, _, weighted, _, _ = self.levels[bit][self.top]
            key = self.keys[self.top][np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))]
            decision = (key & U64(255)) >> U64(8 - bit) | U64(1 << bit)
            rows.append(pd.DataFrame({"context": (key >> U64(8)).astype(np.int64), "decision": decision.astype(np.int64), "zeros": zeros, "ones": ones, "weighted": weighted}))
        return pd.concat(rows)

    def bits(self) -> np.ndarray:
        """For each string and bit, the probability of the bit as mixed over the depths from top down."""
        out = np.empty((8, len(self.keys[self.depth])))
        for bit in range(8):
            at, steps = np.arange(len(self.keys[self.depth])), []
            for d in range(self.depth, self.top - 1, -1):
                node, zeros, ones, _, _, weight, one = self.levels[bit][d]
                own = (np.where(one, ones[node], zeros[node]) + 0.5) / (zeros[node] + ones[node] + 1.0)
                steps.append((own[at], weight[node][at]))
                if d > self.top:
                    at = self.parents[d][at]
            p = steps[0][0]
            for own, weight in steps[1:]:
                p = weight * own + (1 - weight) * p
            out[bit] = p
        return out


def _tops(depth: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for bucket, frame in zip(pdf["bucket"], pdf["counts"], strict=True):
                if bucket % 2 == 0:
                    key, n = expand(frame)
                    top = _Trees(_undelta(key), n, depth, 2).at_top()
                    top["context"] //= 256
                    yield top.groupby(["context", "decision"], as_index=False).sum()

    return run


class _Roots:
    """Depths one and zero, from the sums of the depth below: estimates and weights by nearest byte and decision."""

    def __init__(self, top: pd.DataFrame):
        shape = (256, 256)
        self.n = np.zeros((2, *shape))
        split = np.zeros(shape)
        c, d = top["context"].to_numpy(), top["decision"].to_numpy()
        self.n[0][c, d], self.n[1][c, d], split[c, d] = top["zeros"], top["ones"], top["weighted"]
        own = _log_kt(self.n[0], self.n[1])
        weighted = np.logaddexp(own, split) + _HALF
        self.weight = np.exp(own + _HALF - weighted)
        self.n0 = self.n.sum(axis=1)
        own0 = _log_kt(self.n0[0], self.n0[1])
        self.weight0 = np.exp(own0 + _HALF - (np.logaddexp(own0, weighted.sum(axis=0)) + _HALF))

    def log10(self, key: np.ndarray, bits: np.ndarray, depth: int) -> np.ndarray:
        """The log probability of each string's last byte."""
        byte, near = (key & U64(255)).astype(np.int64), (key >> U64(8 * depth)).astype(np.int64)
        out = np.zeros(len(key))
        for bit in range(8):
            one, node = byte >> (7 - bit) & 1, byte >> (8 - bit) | 1 << bit
            p1 = (self.n[one, near, node] + 0.5) / (self.n[0, near, node] + self.n[1, near, node] + 1)
            p0 = (self.n0[one, node] + 0.5) / (self.n0[0, node] + self.n0[1, node] + 1)
            p = self.weight[near, node] * p1 + (1 - self.weight[near, node]) * bits[bit]
            out += np.log10(self.weight0[node] * p0 + (1 - self.weight0[node]) * p)
        return out


def _asked(n_buckets: int, depth: int):
    def ask(row: dict) -> Iterator[tuple[int, bytes]]:
        chunk = _Chunk(row, depth)
        key = _counted(chunk.strings())[0]
        for b, at in by_bucket(_string_bucket(key, depth, n_buckets), n_buckets):
            yield 2 * b, squeeze(_delta(key[at]))
        key = _counted(chunk.tokens()[0])[0]
        for b, at in by_bucket(_word_bucket(key, n_buckets), n_buckets):
            yield 2 * b + 1, squeeze(_delta(key[at]))

    return ask


def _solved(roots: _Roots, depth: int):
    def run(key: tuple, asked: pa.Table, model: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        wanted = [_undelta(expand(x)[0]) for x in asked.column("asked").to_pylist()]
        known = [expand(x) for x in model.column("counts").to_pylist()]
        have, n = (_undelta(known[0][0]), known[0][1]) if known else (np.zeros(0, U64), np.zeros(0, np.int64))
        told = []
        if bucket % 2:
            for w in wanted:
                at = np.minimum(np.searchsorted(have, w), max(0, len(have) - 1))
                told.append(squeeze(np.where(have[at] == w, n[at], 0) if len(have) else np.zeros(len(w), np.int64)))
        elif wanted:
            all_, counts = _merged([(have, n)] + [(w, np.zeros(len(w), np.int64)) for w in wanted])
            value = roots.log10(all_, _Trees(all_, counts, depth, 2).bits(), depth).astype(np.float32)
            told = [squeeze(value[np.searchsorted(all_, w)]) for w in wanted]
        out = pa.table({"bucket": pa.array([bucket] * len(told), pa.int32()), "chunk": asked.column("chunk").cast(pa.int64()), "told": pa.array(told, pa.binary())})
        trim()
        return out

    return run


class _Lookup:
    """Values of 64-bit keys from sorted distinct keys: one probe of a table of slots, binary search for those that lost theirs."""

    def __init__(self, keys: np.ndarray):
        self.keys, bits = keys, max(10, len(keys).bit_length() + 2)
        self.shift = U64(64 - bits)
        self.slots = np.zeros(1 << bits, np.int32)
        self.slots[self._slot(keys)] = np.arange(len(keys), dtype=np.int32)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key * U64(0x9E3779B97F4A7C15)) >> self.shift

    def __call__(self, key: np.ndarray) -> np.ndarray:
        at = self.slots[self._slot(key)]
        lost = np.flatnonzero(self.keys[at] != key)
        at[lost] = np.searchsorted(self.keys, key[lost])
        return at


def _values(row: dict, kind: int, bucket: np.ndarray, n_buckets: int, dtype) -> np.ndarray:
    told = {x["bucket"] // 2: x["told"] for x in row["told"] or [] if x["bucket"] % 2 == kind}
    out = np.zeros(len(bucket), dtype)
    for b, at in by_bucket(bucket, n_buckets):
        out[at] = expand(told[b])[0]
    return out


def _scores(n_buckets: int, depth: int, n_train: int, n_words: int):
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "stream_bytes", "bits_per_byte"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            chunk = _Chunk(row, depth)
            strings = chunk.strings()
            key = _counted(strings)[0]
            value = _values(row, 0, _string_bucket(key, depth, n_buckets), n_buckets, np.float64)
            score = np.add.reduceat(value[_Lookup(key)(strings)], chunk.offsets[:-1])
            token, per_doc = chunk.tokens()
            key = _counted(token)[0]
            seen = _values(row, 1, _word_bucket(key, n_buckets), n_buckets, np.int64)[_Lookup(key)(token)]
            first = np.concatenate([[0], np.cumsum(per_doc)[:-1]])
            base = np.add.reduceat(np.log10((seen + 1) / (n_train + (n_words + 1))), first)
            known = np.add.reduceat((seen > 0).astype(np.int64), first)
            columns = [~chunk.train, per_doc, known, np.full(len(first), n_train), base, score, np.diff(chunk.offsets), -score / np.log10(2) / np.diff(chunk.offsets)]
            yield pa.RecordBatch.from_arrays([id_column(row), *[pa.array(x) for x in columns]], names=names)

    return run


def _merged_counts(counts: DataFrame, n_chunks: int, at_once: int) -> DataFrame:
    """One row a bucket: bucket, counts, distinct, total. A frame comes from a task of some chunks; n_chunks bounds their number."""
    frame = "bucket int, part int, counts binary, distinct long, total long"
    counts, parts = counts.withColumn("part", F.spark_partition_id()), n_chunks // at_once
    while parts > 1:
        counts = counts.withColumn("part", F.col("part") % parts).groupBy("bucket", "part").applyInPandas(_merge_counts, frame).select("bucket", "part", "counts")
        parts //= at_once
    return counts.groupBy("bucket").applyInPandas(_merge_counts, frame).drop("part")


def scored(docs: DataFrame, depth: int = DEPTH, strings_a_task: int = STRINGS_A_TASK, merged_at_once: int = MERGED_AT_ONCE) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, stream_bytes, bits_per_byte of each document.

    score is the log10 probability of the token stream under context-tree weighting; bits_per_byte its code length for each byte of the
    stream. Documents with crc32(doc_id as text) mod 7 = 2 are held out of all counts; one with a null doc_id isn't. A null, empty or blank
    text is the end mark alone; without training documents every count is 0 and each bit has probability one half. Repeated rows count and
    appear each time; other columns don't matter; an empty table gives no rows.
    """
    chunks = written(packed(docs, before=_streams), "streams")
    n_chunks = chunks.count()
    n_buckets = max(4, n_chunks // 2)
    counts = chunks.mapInArrow(releasing(_training(n_buckets, depth)), "bucket int, counts binary")
    model = written(_merged_counts(counts, n_chunks, merged_at_once), "model")
    sums = model.where("bucket % 2 = 1").agg(F.coalesce(F.sum("distinct"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    top = model.select("bucket", "counts").mapInPandas(releasing(_tops(depth)), "context long, decision long, zeros double, ones double, weighted double")
    roots = _Roots(top.groupBy("context", "decision").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "weighted")]).toPandas())  # at most 256 * 255 rows
    asked = questions(chunks, _asked(n_buckets, depth))
    known = model.select("bucket", "counts", F.expr(f"cast(1 + total div greatest({strings_a_task}, 8 * distinct) as int)").alias("parts"))
    several = known.where("parts > 1").select("bucket", "parts")
    if several.isEmpty():
        asked = asked.withColumn("part", F.lit(0))
    else:  # an occurrence in training is at most one question of a chunk, so `total` bounds what a bucket is asked
        asked = asked.join(several, "bucket", "left").withColumn("part", F.pmod(F.xxhash64("chunk"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    copies = known.select("bucket", "counts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    told = asked.groupBy("bucket", "part").cogroup(copies.groupBy("bucket", "part")).applyInArrow(_solved(roots, depth), "bucket int, chunk long, told binary")
    both = with_answers(chunks, told)
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, stream_bytes long, bits_per_byte double"
    return both.mapInArrow(releasing(_scores(n_buckets, depth, int(sums[1]), int(sums[0]))), schema)
