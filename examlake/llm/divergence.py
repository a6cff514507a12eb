"""Which sources of a language use other terms than the language does: an audit from byte tries that are merged by prefix.

A partition counts its terms in radix tries over UTF-8, one a language, whose leaves count each source's occurrences and the documents. Tries are cut
into pieces of one prefix, the pieces of a prefix are merged one after the other in one task, and what is left is walked in byte order: each
walk adds to the divergence of every two sources and keeps the best candidates of every source.
"""

from __future__ import annotations

import gc
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from heapq import nsmallest

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import BLOCK_BYTES, as_bytes, blocks, drop_written, releasing, written

#: Documents of its language that a kept term is in.
LEAST_DOCUMENTS = 10
#: Ranks of terms.
MOST_TERMS = 10
#: Bytes by which tries are cut into pieces, at first and more at a time where a prefix is heavy.
CUT = 2
#: Counters of all pieces of a prefix from which on its pieces are cut further, and those that a partition's tries hold before they are given out.
HEAVY, HELD = 1 << 20, 1 << 19
#: Sources that one walk compares with all others, and cells of its tables.
STRIPE, CELLS = 1024, 1 << 21
#: Copies of a language's totals, so that the pieces of one language meet them in as many tasks.
SALTS = 64
#: Key of a leaf's count of documents, beside those of its sources.
_DOCS = -1
#: Terms are runs of letters and of bytes beyond ASCII; A-Z become lower case, all else a space.
_TERM_BYTES = np.array([c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)], np.uint8)


class RadixTrie:
    """Terms as paths of byte labels; a node is [label, children by first byte, counters], the last two None where there are none."""

    def __init__(self) -> None:
        self._root: list = [b"", None, None]
        self._path: list[tuple[list, int]] = [(self._root, 0)]  # to the term that was new last, and where each node ends: sorted terms go on from there
        self._last = b""
        self._known: dict[bytes, dict[int, int]] = {}  # leaves by term: most terms are met again
        self.held = 0

    def leaf(self, term: bytes) -> dict[int, int]:
        """The counters at a term, new ones where it is not in yet; a label that the term leaves half-way is split there."""
        known = self._known.get(term)
        if known is not None:
            return known
        path, same = self._path, _common(self._last, term)
        while path[-1][1] > same:
            path.pop()
        (node, at), self._last = path[-1], term
        while at < len(term):
            first = term[at]
            if node[1] is None:
                node[1] = {}
            below = node[1].get(first)
            if below is None:
                below = node[1][first] = [term[at:], None, None]
            elif not term.startswith(below[0], at):
                label, rest = below[0], below
                same = _common(label, term[at : at + len(label)])
                rest[0] = label[same:]
                below = node[1][first] = [label[:same], {label[same]: rest}, None]
            node, at = below, at + len(below[0])
            path.append((node, at))
        node[2] = self._known[term] = {}
        return node[2]

    def add(self, term: bytes, counts: Iterable[tuple[int, int]]) -> None:
        leaf = self.leaf(term)
        self.held -= len(leaf)
        for key, n in counts:
            leaf[key] = leaf.get(key, 0) + n
        self.held += len(leaf)

    def count(self, key: int, terms: list[bytes], occurrences: list[int], documents: list[int]) -> None:
        """Add what one source has of some terms."""
        leaf_of, known, new = self.leaf, self._known.get, 0
        for term, n, in_documents in zip(terms, occurrences, documents, strict=True):
            leaf = known(term)
            if leaf is None:
                leaf_of(term).update({key: n, _DOCS: in_documents})
                new += 2
                continue
            new += key not in leaf
            leaf[key] = leaf.get(key, 0) + n
            leaf[_DOCS] += in_documents
        self.held += new

    def walk(self) -> Iterator[tuple[bytes, dict[int, int]]]:
        """Terms in the order of their bytes, which is that of their code points."""
        stack = [(b"", self._root)]
        while stack:
            path, node = stack.pop()
            path += node[0]
            if node[2] is not None:
                yield path, node[2]
            if node[1] is not None:
                stack += [(path, node[1][byte]) for byte in sorted(node[1], reverse=True)]


def _common(a: bytes, b: bytes) -> int:
    """How many bytes two strings share at their start."""
    unlike = int.from_bytes(a[:8].ljust(8, b"\0"), "big") ^ int.from_bytes(b[:8].ljust(8, b"\0"), "big")
    if unlike:
        return min(8 - (unlike.bit_length() + 7) // 8, len(a), len(b))
    low, high = min(len(a), len(b), 8), min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[:middle] == b[:middle] else (low, middle - 1)
    return low


_packer, _unpacker = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def packed_walk(leaves: list[tuple[bytes, dict[int, int]]]) -> bytes:
    """A walk, packed: what each term shares with the one before, the rest of it, and its counters."""
    shared, rest, before = [], [], b""
    for term, _ in leaves:
        same = _common(before, term)
        shared.append(same)
        rest.append(term[same:])
        before = term
    counters = [len(x) for _, x in leaves]
    keys = [k for _, x in leaves for k in x]
    counts = [n for _, x in leaves for n in x.values()]
    head = np.array([len(leaves), len(keys)], np.int64)
    parts = (head, np.array(shared, np.uint32), np.array([len(x) for x in rest], np.uint32), np.array(counters, np.uint32), np.array(keys, np.int32), np.array(counts, np.int64))
    return _packer.compress(b"".join(x.tobytes() for x in parts) + b"".join(rest))


def unpacked_walk(data: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """The terms of a packed walk in order, the number of counters of each, all keys and all counts."""
    raw = _unpacker.decompress(data)
    n, m = np.frombuffer(raw, np.int64, 2)
    at, arrays = 16, []
    for kind, size in ((np.uint32, n), (np.uint32, n), (np.uint32, n), (np.int32, m), (np.int64, m)):
        arrays.append(np.frombuffer(raw, kind, int(size), at))
        at += arrays[-1].nbytes
    terms, before = [], b""
    for same, size in zip(arrays[0].tolist(), arrays[1].tolist(), strict=True):
        before = before[:same] + raw[at : at + size]
        at += size
        terms.append(before)
    return terms, *arrays[2:]


def _leaves(data: bytes) -> Iterator[tuple[bytes, list[tuple[int, int]]]]:
    terms, sizes, keys, counts = unpacked_walk(data)
    pairs, at = list(zip(keys.tolist(), counts.tolist(), strict=True)), 0
    for term, size in zip(terms, sizes.tolist(), strict=True):
        yield term, pairs[at : at + size]
        at += size


_PIECES = "lang string, prefix binary, counters long, terms long, sources array<string>, trie binary"


def _pieces(lang: str, width: int, names: list[str], leaves: Iterable[tuple[bytes, dict[int, int]]]) -> Iterator[dict]:
    """A walk cut where the first bytes of its terms change."""
    prefix, held = b"", []
    for term, leaf in leaves:
        if held and term[:width] != prefix:
            yield _piece(lang, prefix, names, held)
            held = []
        prefix = term[:width]
        held.append((term, leaf))
    if held:
        yield _piece(lang, prefix, names, held)


def _piece(lang: str, prefix: bytes, names: list[str], leaves: list) -> dict:
    return {"lang": lang, "prefix": prefix, "counters": sum(len(x) for _, x in leaves), "terms": len(leaves), "sources": names, "trie": packed_walk(leaves)}


def _batches(rows: Iterable[dict], schema: pa.Schema, most: int = 4096) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


_PIECE_SCHEMA = pa.schema([("lang", pa.string()), ("prefix", pa.binary()), ("counters", pa.int64()), ("terms", pa.int64()), ("sources", pa.list_(pa.string())), ("trie", pa.binary())])


def terms_of(data: np.ndarray, offsets: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The different terms of a block of documents in order, and which of them each document's words are: terms, and document and term of each word."""
    low = _TERM_BYTES[data]
    inside = np.concatenate([low != 32, [False]])
    first = inside[:-1].copy()
    first[1:] &= ~inside[:-2]
    edges = offsets[1:-1][offsets[1:-1] < len(low)]
    first[edges] = inside[edges]
    starts = np.flatnonzero(first)
    if not len(starts):
        return [], np.zeros(0, np.int64), np.zeros(0, np.int64)
    # all bytes of words, one word behind the other: a word is as long as there are such bytes up to the next one's start
    so_far = np.cumsum(inside[:-1])
    ends = np.append(so_far[starts[1:]] - 1, so_far[-1])
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64)), pa.py_buffer(low[inside[:-1]])])
    found = words.dictionary_encode()
    terms = found.dictionary.to_pylist()
    order = sorted(range(len(terms)), key=terms.__getitem__)
    rank = np.empty(len(terms), np.int64)
    rank[order] = np.arange(len(terms))
    return [terms[k] for k in order], np.searchsorted(offsets, starts, "right") - 1, rank[found.indices.to_numpy()]


def _counted(batches: Iterator[pa.RecordBatch], cut: int, most: int) -> Iterator[pa.RecordBatch]:
    """Tries of this partition's documents, in pieces; given out whenever they hold `most` counters."""
    tries: dict[str, RadixTrie] = defaultdict(RadixTrie)
    names: dict[str, dict[str, int]] = defaultdict(dict)

    def count(groups: list[tuple[str, str]], group: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> None:
        terms, document, term = terms_of(data, offsets)
        if not terms:
            return
        pairs, times = np.unique(document * len(terms) + term, return_counts=True)
        keys, at, documents = np.unique(group[pairs // len(terms)] * len(terms) + pairs % len(terms), return_inverse=True, return_counts=True)
        occurrences = np.zeros(len(keys), np.int64)
        np.add.at(occurrences, at, times)
        ends = np.searchsorted(keys, np.arange(len(groups) + 1) * len(terms))
        for g, (lang, source) in enumerate(groups):
            here = slice(ends[g], ends[g + 1])
            if here.start < here.stop:
                tries[lang].count(names[lang].setdefault(source, len(names[lang])), [terms[k] for k in (keys[here] - g * len(terms)).tolist()], occurrences[here].tolist(), documents[here].tolist())

    def given_out() -> Iterator[dict]:
        for lang, trie in tries.items():
            yield from _pieces(lang, cut, list(names[lang]), trie.walk())
        tries.clear()
        names.clear()

    def rows() -> Iterator[dict]:
        for batch in batches:
            if not batch.num_rows:
                continue
            data, offsets = as_bytes(batch.column(2))
            place: dict[tuple[str, str], int] = {}
            group = np.array([place.setdefault(x, len(place)) for x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)])
            for i, j in blocks(offsets, 4 * BLOCK_BYTES):
                count(list(place), group[i:j], data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                if sum(x.held for x in tries.values()) > most:
                    yield from given_out()
        yield from given_out()

    return _batches(rows(), _PIECE_SCHEMA)


def _cut_further(batches: Iterator[pa.RecordBatch], cut: int) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[dict]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in ("lang", "prefix", "sources", "trie")}
                yield from _pieces(row["lang"], len(row["prefix"]) + cut, row["sources"], ((t, dict(x)) for t, x in _leaves(row["trie"])))

    return _batches(rows(), _PIECE_SCHEMA)


_MERGED = "lang string, prefix binary, terms long, sources array<string>, totals array<long>, trie binary"
_MERGED_SCHEMA = pa.schema([("lang", pa.string()), ("prefix", pa.binary()), ("terms", pa.int64()), ("sources", pa.list_(pa.string())), ("totals", pa.list_(pa.int64())), ("trie", pa.binary())])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces that come sorted by language and prefix, merged one by one: only one prefix's terms are held, however many pieces it has."""

    def kept(key: tuple[str, bytes], trie: RadixTrie, names: dict[str, int]) -> Iterator[dict]:
        leaves = [(term, {k: n for k, n in leaf.items() if k != _DOCS}) for term, leaf in trie.walk() if leaf[_DOCS] >= LEAST_DOCUMENTS]
        if leaves:
            totals = [0] * len(names)
            for _, leaf in leaves:
                for k, n in leaf.items():
                    totals[k] += n
            yield {"lang": key[0], "prefix": key[1], "terms": len(leaves), "sources": list(names), "totals": totals, "trie": packed_walk(leaves)}

    def rows() -> Iterator[dict]:
        at, trie, names = None, RadixTrie(), {}
        for batch in batches:
            for i in range(batch.num_rows):
                key = batch.column("lang")[i].as_py(), batch.column("prefix")[i].as_py()
                if key != at:
                    if at is not None:
                        yield from kept(at, trie, names)
                    at, trie, names = key, RadixTrie(), {}
                known = {_DOCS: _DOCS} | {k: names.setdefault(s, len(names)) for k, s in enumerate(batch.column("sources")[i].as_py())}
                for term, counts in _leaves(batch.column("trie")[i].as_py()):
                    trie.add(term, [(known[k], n) for k, n in counts])
        if at is not None:
            yield from kept(at, trie, names)

    return _batches(rows(), _MERGED_SCHEMA, 64)


def billionths(count: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """floor(10^9 * count / total) for 0 <= count <= total, exactly: long division, three decimals at a time (total below 9 * 10^15)."""
    rest, out = count % total, count // total
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest = rest % total
    return out


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q)) of values up to 10^9 + 1, exact in 64 bits."""
    return (p - q) ** 2 // (p + q)


_FOUND = "lang string, source string, part string, item string, value long"
_FOUND_SCHEMA = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def _walked(batches: Iterator[pa.RecordBatch], width: int, most: int) -> Iterator[pa.RecordBatch]:
    """Walks merged pieces: sums over their terms for every two sources, and each source's best candidates so far. Both are given out before they exceed `most` cells."""
    pairs: dict[tuple, np.ndarray] = {}
    best: dict[tuple[str, str], list[tuple[int, bytes]]] = {}
    others: dict[tuple, list[str]] = {}

    def given_out() -> Iterator[dict]:
        for (lang, stripe), sums in pairs.items():
            names = others[lang, stripe]
            for i, values in enumerate(sums):
                source = names[stripe * width + i]
                for other, value in zip(names, values.tolist(), strict=True):
                    if other != source:
                        yield {"lang": lang, "source": source, "part": "pair", "item": other, "value": value}
        for (lang, source), found in best.items():
            for value, term in found:
                yield {"lang": lang, "source": source, "part": "term", "item": term.decode(), "value": -value}
        pairs.clear()
        best.clear()
        others.clear()

    def walk(lang: str, stripe: int, names: list[str], sums: np.ndarray, v: int, row: dict) -> None:
        terms, sizes, keys, counts = unpacked_walk(row["trie"])
        place = {s: i for i, s in enumerate(names)}
        column = np.array([place[s] for s in row["sources"]])[keys]
        line = np.repeat(np.arange(len(terms)), sizes)
        first, last = stripe * width, min((stripe + 1) * width, len(names))
        total = pairs.setdefault((lang, stripe), np.zeros((last - first, len(names)), np.int64))
        others[lang, stripe] = names
        ends, step = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), max(1, most // len(names))
        for a in range(0, len(terms), step):
            b = min(a + step, len(terms))
            here = slice(int(ends[a]), int(ends[b]))
            table = np.zeros((b - a, len(names)), np.int64)
            table[line[here] - a, column[here]] = counts[here]
            p = billionths(table + 2, sums + 2 * v) + 1
            q = billionths(table.sum(1) + 2, int(sums.sum()) + 2 * v) + 1
            for s in range(first, last):
                total[s - first] += divergence(p[:, s : s + 1], p).sum(0)
                good = np.flatnonzero((table[:, s] > 0) & (p[:, s] > q))
                value = divergence(p[good, s], q[good])
                top = np.argsort(-value, kind="stable")[:MOST_TERMS]
                found = [(-int(value[i]), terms[a + int(good[i])]) for i in top]
                best[lang, names[s]] = nsmallest(MOST_TERMS, best.get((lang, names[s]), []) + found)

    def rows() -> Iterator[dict]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in ("lang", "stripe", "v", "names", "sums", "sources", "trie")}
                if (row["lang"], row["stripe"]) not in pairs and sum(x.size for x in pairs.values()) > most:
                    yield from given_out()
                walk(row["lang"], row["stripe"], row["names"], np.array(row["sums"], np.int64), row["v"], row)
        yield from given_out()

    return _batches(rows(), _FOUND_SCHEMA)


def _with(run: Callable, *limits: int) -> Callable:
    """run with limits as they are now, whatever a worker's module says. Tries hold no cycles, so looking for some among millions of nodes is left off meanwhile."""

    def all_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()
        try:
            yield from run(batches, *limits)
        finally:
            gc.enable()

    return releasing(all_batches)


def _texts(docs: DataFrame) -> DataFrame:
    blank: list[Column] = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")]
    return docs.select(*blank, F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8").alias("text"))


def merged_tries(docs: DataFrame) -> DataFrame:
    """Kept terms of docs (text, lang, source) as written pieces of tries: lang, prefix, terms, sources, totals (of each source), trie (packed)."""
    pieces = written(_texts(docs).mapInArrow(_with(_counted, CUT, HELD), _PIECES), "term-tries")
    parts, done = [pieces], []
    while True:
        weight = pieces.groupBy("lang", "prefix").agg(F.sum("counters").alias("all"), F.max("terms").alias("most"))
        heavy = weight.where((F.col("all") > HEAVY) & (F.col("most") > 1)).select("lang", "prefix")
        if heavy.isEmpty():
            done.append(pieces)
            break
        heavy = written(heavy, "heavy-prefixes")
        done.append(pieces.join(heavy, ["lang", "prefix"], "left_anti"))
        pieces = written(pieces.join(heavy, ["lang", "prefix"], "left_semi").select(*pieces.columns).mapInArrow(_with(_cut_further, CUT), _PIECES), "term-tries")
        parts += [heavy, pieces]
    all_pieces = done[0]
    for more in done[1:]:
        all_pieces = all_pieces.unionByName(more)
    sorted_pieces = all_pieces.repartition("lang", "prefix").sortWithinPartitions("lang", "prefix")
    out = written(sorted_pieces.mapInArrow(_with(_merged), _MERGED), "merged-tries")
    drop_written(*parts)
    return out


def source_divergence(docs: DataFrame) -> DataFrame:
    """For each (lang, source) of docs (text, lang, source; others are left out, null counts as ''): its divergence from each other source, and its most typical terms.

    lang, source, part ('pair' or 'term'), item, value long, rank int: see `_walked`; ranks by value, then by the item's bytes. A language of one source has
    no pairs and no terms above itself, an empty table no rows; a language without kept terms has pairs of value 0. Repeated rows count as often as they occur.
    """
    tries = merged_tries(docs)
    totals = tries.select("lang", F.explode(F.arrays_zip("sources", "totals")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.totals").alias("n"))
    groups = _texts(docs).groupBy("lang", "source").agg(F.lit(1).alias("one")).join(totals, ["lang", "source"], "left")
    by_lang = groups.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", F.coalesce("n", F.lit(0)).alias("n")))).alias("g"))
    by_lang = by_lang.join(tries.groupBy("lang").agg(F.sum("terms").alias("v")), "lang", "left")
    langs = written(by_lang.select("lang", F.col("g.source").alias("names"), F.col("g.n").alias("sums"), F.coalesce("v", F.lit(0)).alias("v")), "lang-totals")
    salted = langs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    pieces = tries.withColumn("salt", F.pmod(F.xxhash64("prefix"), F.lit(SALTS)).cast("int")).join(salted, ["lang", "salt"])
    stripes = pieces.withColumn("stripe", F.explode(F.sequence(F.lit(0), F.expr(f"cast((size(names) - 1) div {STRIPE} as int)"))))
    found = stripes.select("lang", "stripe", "v", "names", "sums", "sources", "trie").mapInArrow(_with(_walked, STRIPE, CELLS), _FOUND)
    found = written(found, "divergence")
    summed = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    bare = langs.where("v = 0").select("lang", F.explode("names").alias("source"), "names").select("lang", "source", F.lit("pair").alias("part"), F.explode("names").alias("item"), F.lit(0).cast("long").alias("value"))
    ranked = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    every = summed.unionByName(bare.where("source <> item")).unionByName(found.where("part = 'term'"))
    return every.withColumn("rank", F.row_number().over(ranked)).where((F.col("part") == "pair") | (F.col("rank") <= MOST_TERMS))
