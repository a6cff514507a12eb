"""Mixture-controlled packing of documents into token windows by deficit round-robin over source queues.

Every source is a queue of its documents' tokens. A window of WINDOW tokens gives each source a quantum in proportion to its target share;
what rounding keeps from a source is its deficit, carried to the next window. Once a queue runs dry, those that are left share the windows in
proportion to their targets. Between two such moments the grants of the first k windows have a closed form: the tokens due to the first j
queues together, rounded down, less those of the first j - 1. So each document knows from its place in its queue, a distributed prefix
sum, in which windows its tokens go, and deficits carry over windows and partitions without any task waiting for another.

A queue to which a window owes less than a token can't be in each one: all such sources together are one queue, the first (whose grants,
rounded alone, never fall). Documents are cut freely; the tokens behind the last full window fill sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from itertools import accumulate
from math import ceil, lcm

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .encoding import encode
from .shared import drop_written, releasing, text_column, written

WINDOW = 1024
#: The id behind each document.
END_ID = 0
#: Rows (one for each task and source) up to which the queues' places are broadcast; more are joined by a shuffle.
SMALL = 100_000
#: The queue of all sources that are too small for one of their own, or that no target names.
REST = "r"


def _encoded(folder: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        had: dict[str | None, int] = {}  # tokens of each source in this task so far
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                ids = [np.append(encode(x, folder), np.uint16(END_ID)).astype(np.uint16) for x in part.column("text").to_pylist()]
                inside = []
                for source, x in zip(part.column("source").to_pylist(), ids, strict=True):
                    inside.append(had.get(source, 0))
                    had[source] = inside[-1] + len(x)
                columns = [part.column("doc_id"), part.column("source"), pa.array([task] * len(ids), pa.int32()), pa.array(inside, pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "source", "part", "inside", "doc_tokens", "ids"])

    return run


@dataclass(frozen=True)
class Phase:
    """From token `begin` of the packed stream until the next phase, the first queues together are due done + weight * (token - dry) / all tokens.

    done and weight: a pair each, of the queues ahead and of these with the own one; done: the tokens of those among them that have run dry,
    weight: the weights of the others. dry: the tokens of all dry queues, all: the weights of all others.
    """

    begin: int
    done: tuple[int, int]
    weight: tuple[int, int]
    dry: int
    all: int


@dataclass(frozen=True)
class Queue:
    """A queue's phases, the tokens of the queues ahead and of these with it, and of all."""

    phases: tuple[Phase, ...]
    low: int
    high: int
    total: int

    def granted(self, k: int) -> tuple[int, int]:
        """The tokens that the queues ahead have, and they and the queue itself, in the first k windows."""
        at = k * WINDOW
        p = self.phases[bisect_right(self.phases, at, key=lambda x: x.begin) - 1] if len(self.phases) > 1 else self.phases[0]
        return p.done[0] + p.weight[0] * (at - p.dry) // p.all, p.done[1] + p.weight[1] * (at - p.dry) // p.all

    def own(self, k: int) -> int:
        ahead, then = self.granted(k)
        return then - ahead

    def window_of(self, token: int) -> int:
        """The window that the token-th token goes to: the first k whose k + 1 windows grant more than `token` tokens; behind them, the number of full windows."""
        full = self.total // WINDOW
        if len(self.phases) > 1:
            return bisect_right(range(1, full + 1), token, key=self.own)
        k = min(full, token * self.total // (WINDOW * (self.high - self.low)))
        while k and self.own(k) > token:
            k -= 1
        while k < full and self.own(k + 1) <= token:
            k += 1
        return k


def plan(tokens: dict[str, int], weights: dict[str, Fraction]) -> dict[str, Queue]:
    """The queues, REST first, from their numbers of tokens and their target weights. One of weight 0 gets its turn when the others have run dry."""
    names = sorted((n for n in tokens if tokens[n]), key=lambda n: (n != REST, n))
    scale = lcm(*(Fraction(weights[n]).denominator for n in names))
    weight = {n: int(weights[n] * scale) for n in names}
    total, active, begin = sum(tokens.values()), set(names), Fraction(0)
    phases: dict[str, list[Phase]] = {n: [] for n in names}
    while active:
        now = {n: weight[n] if n in active else 0 for n in names} if any(weight[n] for n in active) else {n: int(n in active) for n in names}
        dry, whole = total - sum(tokens[n] for n in active), sum(now.values())
        done = due = 0
        for n in names:
            ahead = done, due
            done, due = done + (0 if n in active else tokens[n]), due + now[n]
            phases[n].append(Phase(ceil(begin), (ahead[0], done), (ahead[1], due), dry, whole))
        # every weighted queue has had its weight times the same number, so the one with the fewest tokens for its weight runs dry next
        least = min(Fraction(tokens[n], now[n]) for n in active if now[n])
        begin = dry + whole * least
        active -= {n for n in active if now[n] and Fraction(tokens[n], now[n]) == least}
    ends = list(accumulate(tokens[n] for n in names))
    return {n: Queue(tuple(phases[n]), high - tokens[n], high, total) for n, high in zip(names, ends, strict=True)}


def _cut(doc_id: int, source: str | None, packed: bytes, first: int, queue: Queue) -> Iterator[tuple]:
    """The pieces of a document; first is its place in the queue."""
    ids = np.frombuffer(packed, np.uint16).astype("<u4")
    full, start = queue.total // WINDOW, 0
    k = queue.window_of(first)
    while start < len(ids):
        at = first + start
        ahead, had = queue.granted(k)
        if k < full:
            ahead_then, had_then = queue.granted(k + 1)
            sequence, offset, left = k, ahead_then - ahead + at - (had - ahead), had_then - ahead_then - at
        else:  # behind the last full window lies what is left of each queue, cut into powers of two
            offset, left, sequence = queue.low - ahead + at - (had - ahead), queue.high - queue.low - at, full
            for bit in range(WINDOW.bit_length() - 2, -1, -1):
                if (queue.total - full * WINDOW) >> bit & 1:
                    if offset < 1 << bit:
                        left = min(left, (1 << bit) - offset)
                        break
                    offset, sequence = offset - (1 << bit), sequence + 1
        length = min(left, len(ids) - start)
        if length:
            yield doc_id, start, length, zlib.crc32(ids[start : start + length].tobytes()), len(ids), sequence, offset, source
            start += length
        if length == left and k < full:
            k += 1


def _pieces(queues: dict[str, Queue]):
    names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source")
    schema = pa.schema([(k, pa.string() if k == "source" else pa.int64()) for k in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                rows = zip(*[part.column(k).to_pylist() for k in ("doc_id", "source", "ids", "first", "queue")], strict=True)
                cut = list(zip(*[piece for *row, queue in rows for piece in _cut(*row, queues[queue])], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(cut, schema, strict=True)], schema=schema)

    return run


def _key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def _queues(held: DataFrame, targets: dict[str | None, float] | None) -> dict[str, Queue]:
    """The plan: a queue for each target, or else for each source that a window owes a token at least; the others are one, REST."""
    totals = held.groupBy("key").agg(F.sum("tokens").alias("tokens"))
    total = totals.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    if targets is None:
        own = {r.key: r.tokens for r in totals.where(F.col("tokens") * WINDOW >= total).collect()}  # WINDOW rows at most
        weights = {n: Fraction(t) for n, t in own.items()}
        weights[REST] = Fraction(total - sum(own.values()))
    else:
        shares = {"n" if k is None else f"s{k}": Fraction(str(v)) for k, v in targets.items()}
        if any(v * WINDOW < 1 for v in shares.values()) or sum(shares.values()) > 1:
            raise ValueError("targets are shares of 1 / WINDOW at least that add up to 1 at most")
        own = {r.key: r.tokens for r in totals.where(F.col("key").isin(list(shares))).collect()}
        weights = shares | {REST: 1 - sum(shares.values())}
    return plan(own | {REST: total - sum(own.values())}, weights)


def packed_sequences(docs: DataFrame, source: str = "source", folder: str | None = None, targets: dict[str | None, float] | None = None) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source: a row for each piece of a document.

    A document is its token ids and END_ID. targets: the share of the tokens of each window that a source shall have; sources without one
    share what is left to 1 (nothing left: they come when all others have run dry). Once a source runs dry, the others share the windows in proportion to their
    targets, so all documents are packed. Without targets a source's share is that of all tokens, so all queues run dry together and each
    window holds it to within a token; sources with less than a token a window are one queue. Null texts are empty: one piece of one id. A null source
    is a source of its own, a null doc_id stays null. Ties need no rule: the order within a queue is that of the written table. Repeated doc_ids are
    packed each; other columns don't matter; an empty table gives no rows.
    """
    plain = docs.select("doc_id", F.col(source).cast("string").alias("source"), text_column())
    ids = written(plain.mapInArrow(releasing(_encoded(folder)), "doc_id long, source string, part int, inside long, doc_tokens long, ids binary"), "ids")
    held = written(ids.groupBy("part", _key(F.col("source")).alias("key")).agg(F.sum("doc_tokens").alias("tokens")), "held")
    queues = _queues(held, targets)
    queue = F.when(F.col("key").isin([n for n in queues if n != REST]), F.col("key")).otherwise(REST) if queues.keys() - {REST} else F.lit(REST)
    of_part = held.withColumn("queue", queue)
    inside = Window.partitionBy("part", "queue").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a task
    parts = of_part.groupBy("queue", "part").agg(F.sum("tokens").alias("all")).withColumn("earlier", F.coalesce(F.sum("all").over(before), F.lit(0))).drop("all")
    ahead = of_part.withColumn("ahead", F.coalesce(F.sum("tokens").over(inside), F.lit(0))).drop("tokens")
    places = written(ahead.join(parts, ["queue", "part"]).select("part", "key", "queue", (F.col("earlier") + F.col("ahead")).alias("place")), "places")
    drop_written(held)
    if places.limit(SMALL + 1).count() <= SMALL:
        places = F.broadcast(places)
    placed = ids.withColumn("key", _key(F.col("source"))).join(places, ["part", "key"])
    cut = placed.select("doc_id", "source", "ids", (F.col("place") + F.col("inside")).alias("first"), "queue")
    return cut.mapInArrow(releasing(_pieces(queues)), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string")
