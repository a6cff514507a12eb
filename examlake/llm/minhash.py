"""Near-duplicate documents: SuperMinHash signatures, banding, verification on full shingle sets, union-find grouping.

A SuperMinHash signature gives every element its own random permutation of the registers; at level j the element offers j plus a
uniform number to the j-th register of its permutation. The ranks of one element are thus correlated (each register gets a different
level), which lowers the variance, and once every register of a document holds a value of a lower level nothing above can change it:
long documents stop after a level or two.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .components import components
from .shared import U64, Rolling, as_bytes, blocks, drop_written, mix, releasing, text_column, words, written

SHINGLE_WORDS = 5
#: Registers of a signature, and how many of them make a band. Each register is in one band for each stride: that of stride s holds the
#: registers at s, 2 s, ... modulo REGISTERS, so few registers give many selective bands. A pair at similarity 0.75 shares no band with
#: probability 5e-6; documents that share a common passage only, at 0.3, share one with probability 0.06.
REGISTERS, ROWS = 168, 6
STRIDES = (1, 5, 11)
BANDS = len(STRIDES) * REGISTERS // ROWS
#: Members of a bucket that all others are compared with, and parts in which they are looked for, as a third of all documents may share a bucket.
LEADERS, SALTS = 3, 16
#: Share of the union that two sets must have in common, in hundredths.
SIMILARITY = 75
#: Sketch bits in which a pair at similarity 0.75 differs: an eighth of the registers, 21, and never five deviations of 4.3 more.
MOST_BITS = 43
_ALIKE = " + ".join(f"bit_count(bits[{i}] ^ bits_a[{i}])" for i in range(-(-REGISTERS // 64))) + f" <= {MOST_BITS}"
_SIZES = f"100 * least(n, na) >= {SIMILARITY} * greatest(n, na)"


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the word shingles of each document; under size words, one for the whole sequence; none, empty."""
    low, starts, stops, doc = words(data, offsets)
    word = Rolling(low).ranges(starts, stops)
    n = len(offsets) - 1
    first = np.searchsorted(doc, np.arange(n + 1))
    whole = np.zeros(max(0, len(word) - size + 1), U64)
    for k in range(size):
        whole = mix(whole * U64(0x9E3779B97F4A7C15) + word[k : len(word) - size + 1 + k]) if len(whole) else whole
    out = []
    for i in range(n):
        a, b = first[i], first[i + 1]
        if b - a >= size:
            out.append(np.unique(whole[a : b - size + 1]))
        elif b > a:
            h = np.array([b - a], U64)
            for k in range(a, b):
                h = mix(h * U64(0xD6E8FEB86659FD93) + word[k : k + 1])
            out.append(h)
        else:
            out.append(np.zeros(0, U64))
    return out


def super_minhash(sets: list[np.ndarray], registers: int = REGISTERS) -> np.ndarray:
    """One row of registers for each set; all ones for an empty set. Equal registers hold the same element at the same level."""
    n, none = len(sets), np.iinfo(np.uint64).max
    values = np.full(n * registers, none, U64)
    sizes = np.array([len(s) for s in sets], np.int64)
    if not sizes.sum():
        return values.reshape(n, registers)
    element, doc = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    order = None  # of the elements of unfinished documents: their permutations, a row each
    for level in range(registers):
        draw = mix(element + U64((level * 0x9E3779B97F4A7C15 + 0x1234567) & none))
        at = (draw & U64(0xFFFFFF)).astype(np.int64) % (registers - level) + level
        if level == 0:
            place = at
        else:
            if order is None:
                order = np.tile(np.arange(registers, dtype=np.uint16), (len(element), 1))
                order[np.arange(len(element)), swapped] = 0  # noqa: F821
            each = np.arange(len(element))
            place = order[each, at]
            order[each, at] = order[:, level]
        np.minimum.at(values, doc * registers + place, (U64(level) << U64(54)) | (draw >> U64(10)))
        unfinished = (values.reshape(n, registers) == none).any(axis=1) & (sizes > 0)
        keep = unfinished[doc]
        if not keep.any():
            break
        if not keep.all():
            element, doc = element[keep], doc[keep]
            order = order[keep] if order is not None else None
        swapped = at[keep] if level == 0 else None  # noqa: F841
    return values.reshape(n, registers)


def band_keys(registers: np.ndarray) -> np.ndarray:
    """(documents, BANDS) keys of the bands of signatures."""
    picked = np.concatenate([np.arange(REGISTERS) * stride % REGISTERS for stride in STRIDES])
    rows = registers[:, picked].reshape(len(registers), BANDS, ROWS)
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(registers), BANDS)).copy()
    for r in range(ROWS):
        keys = mix(keys * U64(0x9E3779B97F4A7C15) + rows[:, :, r])
    return keys


def sketches(registers: np.ndarray) -> np.ndarray:
    """One bit of each register, packed into 64-bit words."""
    odd = (mix(registers.copy()) & U64(1)).astype(np.uint8)
    words_ = -(-REGISTERS // 64)
    full = np.zeros((len(registers), words_ * 64), np.uint8)
    full[:, :REGISTERS] = odd
    return np.packbits(full, axis=1).view(np.uint64).reshape(len(registers), words_)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = as_bytes(batch.column("text"))
        for i, j in blocks(offsets, 1 << 18):
            sets = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            registers = super_minhash(sets)
            keys, bits = band_keys(registers), sketches(registers)
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.view(np.int64).ravel()), x.shape[1]).cast(pa.list_(pa.int64())) for x in (keys, bits)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id")[i:j], pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), *lists], names=["doc_id", "n_shingles", "digest", "bands", "bits"])


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, digest of the shingle set (null: empty set) band keys and sketch bits of each document."""
    return docs.select("doc_id", text_column()).mapInArrow(releasing(_signatures), "doc_id long, n_shingles long, digest binary, bands array<long>, bits array<long>")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = as_bytes(batch.column("text"))
        for i, j in blocks(offsets, 1 << 20):
            sets = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            flat = pa.array(np.concatenate(sets).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id")[i:j], pa.ListArray.from_arrays(pa.array(ends), flat)], names=["doc_id", "shingles"])


def _one_bit(h: Column) -> Column:
    """A word with the bit that bits 3 to 8 of a hash name."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, 3).bitwiseAND(63).cast("int"))


def _compared(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) with their sizes na and nb and the number of shingles in common, counted on full sets; written.

    marks has a bit for each shingle that b has and a hasn't (several may share one).
    """
    wanted = pairs.select(F.col("a").alias("doc_id")).distinct().unionByName(pairs.select(F.col("b").alias("doc_id")).distinct()).distinct()
    sets = written(docs.select("doc_id", text_column()).join(wanted, "doc_id").mapInArrow(releasing(_sets), "doc_id long, shingles array<long>"), "sets")
    both = pairs.join(sets.toDF("b", "sb"), "b").join(sets.toDF("a", "sa"), "a")
    counted = both.select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.array_except("sb", "sa").alias("beside"))
    word = lambda w: F.aggregate(F.filter("beside", lambda h: h.bitwiseAND(7) == w), F.lit(0).cast("long"), lambda bits, h: bits.bitwiseOR(_one_bit(h)))
    marks = F.array(*[word(w) for w in range(8)])
    out = written(counted.select("a", "b", "na", "nb", (F.col("nb") - F.size("beside")).alias("common"), marks.alias("marks")), "compared")
    drop_written(sets)
    return out


def _links(compared: DataFrame) -> DataFrame:
    return compared.where(f"common * 100 >= (na + nb - common) * {SIMILARITY}").select("a", "b")


def _leaders(members: DataFrame) -> DataFrame:
    """band, leaders: the LEADERS members (doc, n, bits) of each band that share most bands with others; first within parts of a band, then among theirs."""
    order = Window.partitionBy("band", "salt").orderBy(F.desc("mates"), "doc")
    salted = members.withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(SALTS))).withColumn("rank", F.row_number().over(order)).where(f"rank <= {LEADERS}")
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("mates")).alias("less"), "doc", "n", "bits"))), 1, LEADERS)
    return salted.groupBy("band").agg(best.alias("leaders"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each document of docs (doc_id, text; other columns don't matter).

    Documents with equal shingle sets form a class, whose smallest doc_id stands for it. Representatives that share a band are
    candidates; all links are verified on full sets. At first each bucket's members are compared with LEADERS members alone, those that
    share most bands with others: in a group of copies, what they were copied from. Where a bucket's members then lie in several
    components, those of different components are compared, but for pairs that can't be links: what both share with the first leader, and
    what both can have in common beside it (512 marks of it tell), bounds what they share; so do, but for a chance of 1e-6, the bits in which their sketches differ. A pair is taken up in the first band that it shares only. So a group of alike
    documents costs a few comparisons a member, and no link between components is lost. Null, empty or blank texts have an empty set, link
    with nothing and stay. Repeated doc_ids give repeated rows; one that has
    several texts is one document to the links, which any of its texts may have. A null doc_id links with nothing, has no component and is kept.
    Empty table: no rows.
    """
    docs = docs.select("doc_id", "text")
    known = written(signatures(docs), "signatures")
    classes = known.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("bits").alias("bits"))
    classes = written(classes, "classes")
    rows = classes.select("doc", "n", F.explode("bands").alias("band"))
    shared = rows.groupBy("band").agg(F.count("*").alias("members")).where("members > 1")
    inside = written(rows.select("doc", "n", "band").join(shared, "band"), "buckets")
    known_by = inside.groupBy("doc").agg(F.sum("members").alias("mates"))
    of_doc = known_by.join(classes.select("doc", "bits"), "doc")
    members = written(inside.drop("members").join(of_doc, "doc"), "members")
    drop_written(inside)
    leaders = written(_leaders(members), "leaders")
    place = F.array_position(F.transform("leaders", lambda x: x["doc"]), F.col("doc"))  # from 1; 0: none of them
    led = members.join(leaders, "band").select("doc", "n", "bits", place.alias("place"), F.posexplode("leaders").alias("at", "leader")).where("place = 0 or at + 1 < place")
    led = led.select("doc", "n", "bits", F.col("leader.doc").alias("a"), F.col("leader.n").alias("na"), F.col("leader.bits").alias("bits_a"))
    pairs = led.where(f"{_SIZES} and {_ALIKE}").select("a", F.col("doc").alias("b")).distinct()
    compared = _compared(pairs, docs)
    links = _links(compared)
    state = components(links)
    now = members.join(state.toDF("doc", "comp"), "doc", "left").withColumn("comp", F.coalesce("comp", "doc"))
    mixed = now.groupBy("band").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("all")).where(f"low < high and all > {LEADERS + 1}").select("band")
    first = leaders.join(mixed, "band").select("band", "leaders", F.col("leaders")[0]["doc"].alias("a"), F.col("leaders")[0]["n"].alias("leader_n"))
    now = now.join(first, "band").where(place == 0)
    now = now.join(compared.select("a", F.col("b").alias("doc"), "common", "marks"), ["a", "doc"], "left").join(classes.select("doc", "bands"), "doc")
    # without a count (too different in size or by sketch), a document has its smaller size in common with the leader at most, and beside it all it has
    now = written(now.select("band", "doc", "n", "comp", "bands", "bits", "marks", F.coalesce("common", F.least("n", "leader_n")).alias("within"), (F.col("n") - F.coalesce("common", F.lit(0))).alias("beside")), "open")
    drop_written(members, leaders)
    if not now.isEmpty():
        other = now.select("band", *[F.col(c).alias(f"{c}_a") for c in ("doc", "n", "comp", "bands", "bits", "marks", "within", "beside")])
        only, only_a = ("coalesce(" + " + ".join(f"bit_count({x}[{w}] & ~{y}[{w}])" for w in range(8)) + ", 0)" for x, y in (("marks", "marks_a"), ("marks_a", "marks")))
        # at least what they have in common: a mark that one has alone stands for a shingle that the other hasn't
        least = f"least(within, within_a) + least(beside - {only}, beside_a - {only_a})"
        may_link = f"doc > doc_a and comp <> comp_a and {100 + SIMILARITY} * ({least}) >= {SIMILARITY} * (n + n_a) and {_ALIKE}"
        first = F.array_min(F.array_intersect("bands", "bands_a")) == F.col("band")
        pairs = now.join(other, "band").where(may_link).where(first).select(F.col("doc_a").alias("a"), F.col("doc").alias("b"))
        pairs = written(pairs, "pairs")
        more = _compared(pairs, docs)
        drop_written(now, pairs)
        state = components(links.unionByName(_links(more)))
    group = classes.select("digest", "doc").join(state.toDF("doc", "comp"), "doc", "left").select("digest", F.coalesce("comp", "doc").alias("comp"))
    out = known.select("doc_id", "n_shingles", "digest").join(group, "digest", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
