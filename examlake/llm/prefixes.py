"""The trie of conversation beginnings, by partition refinement.

All conversations begin as one class. Each round splits the classes by the next turns; a class of one conversation retires and the rest of that
conversation is given out as a chain without being compared with anything; the others go on, through twice as many turns the next time. Then the
classes are folded back: every conversation adds up, from its end to its start, what it shares and where it ends, and classes sum their members.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import drop_written, releasing, written

#: Turns that a round splits by at most; rounds begin with one turn and double.
MOST_TURNS = 4096
#: Conversations of one end that are hashed together.
BLOCK_IDS = 4096
#: SHA-256 of nothing.
NO_ENDS = hashlib.sha256(b"").hexdigest()
_NO_TURNS = b""


def _sha(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def placed_turns(conversations: DataFrame, texts: bool = False) -> DataFrame:
    """Turns (conv_id, turn, role, text) with their place from 1 in the conversation, by turn (null first): conv_id, pos, digest, n_chars long, and role and text if asked for.

    Null role or text is empty, turns without conv_id are left out, and turns with one number are ordered by the digest of role and text. Places are counted in
    ranges of turns that are about as large as each other, so one very long conversation is dealt out as many short ones are. Written.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = _sha(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    kept = [role.alias("role"), text.alias("text")] if texts else []
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long"), "turn", digest.alias("digest"), F.length(text).cast("long").alias("n_chars"), *kept)
    dealt = written(turns.repartitionByRange("conv_id", "turn", "digest").withColumn("part", F.spark_partition_id()), "turns")
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy("conv_id", "part").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    local = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy("turn", "digest"))
    rows = dealt.withColumn("local", local).join(parts, ["conv_id", "part"])
    out = written(rows.select("conv_id", (F.col("before") + F.col("local")).alias("pos"), "digest", "n_chars", *(["role", "text"] if texts else [])), "placed-turns")
    drop_written(dealt)
    return out


def lengths_of(turns: DataFrame) -> DataFrame:
    return turns.groupBy("conv_id").agg(F.count("*").alias("length"))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The contract's conversations: the first h turns of conversation c - c % 100, then c's own after its first h, h = crc32 of the decimal c, modulo 6.

    Gives conv_id and length of each, and its turns. A head has five turns at most, and at most a hundred conversations share it.
    """
    convs = lengths_of(turns).withColumn("h", F.crc32(F.col("conv_id").cast("string")) % 6).withColumn("base", F.expr("conv_id - conv_id % 100"))
    bases = lengths_of(turns.where("conv_id % 100 = 0")).toDF("base", "n_base")
    convs = convs.join(bases, "base", "left").withColumn("shared", F.least("h", F.coalesce("n_base", F.lit(0))))
    convs = written(convs.select("conv_id", "base", "shared", (F.col("shared") + F.greatest(F.col("length") - F.col("h"), F.lit(0))).alias("length")), "rebuilt-lengths")
    # What a turn needs to know of its own conversation follows from its conv_id, but for the head's length; that is fetched for the hundred together.
    h = F.crc32(F.col("conv_id").cast("string")) % 6
    own = turns.where(F.col("pos") > h).withColumn("base", F.expr("conv_id - conv_id % 100")).join(bases, "base", "left")
    own = own.select("conv_id", (F.col("pos") - h + F.least(h, F.coalesce("n_base", F.lit(0)))).alias("pos"), "digest", "n_chars")
    heads = turns.where("conv_id % 100 = 0 and pos <= 5").withColumnRenamed("conv_id", "base")
    heads = heads.join(convs, "base").where("pos <= shared").select("conv_id", "pos", "digest", "n_chars")
    return convs.select("conv_id", "length"), written(own.unionByName(heads), "rebuilt-turns")


def _split(turns: DataFrame, active: DataFrame, low: int, high: int) -> DataFrame:
    """The classes of active conversations (conv_id, length, key) after each of the turns low + 1 to high: a class's key is the digest of its parent's key and the turn's digest."""
    step = F.aggregate(
        F.array_sort(F.collect_list(F.struct("pos", "digest", "n_chars"))),
        F.struct(F.first("key").alias("key"), F.expr("cast(array() as array<struct<pos: bigint, key: binary, parent: binary, n_chars: bigint>>)").alias("out")),
        lambda done, turn: _after(done, turn),
        lambda done: done["out"],
    )
    rows = turns.where((F.col("pos") > low) & (F.col("pos") <= high)).join(active, "conv_id")
    return rows.groupBy("conv_id", "length").agg(step.alias("out")).select("conv_id", "length", F.inline("out"))


def _after(done: Column, turn: Column) -> Column:
    key = _sha(F.concat(done["key"], turn["digest"]))
    return F.struct(key.alias("key"), F.concat(done["out"], F.array(F.struct(turn["pos"].alias("pos"), key.alias("key"), done["key"].alias("parent"), turn["n_chars"].alias("n_chars")))).alias("out"))


def _union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def _refined(convs: DataFrame, turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All rounds: the classes that conversations went through (conv_id, length, pos, key, parent, n_chars, round), and where those that retired did (conv_id, length, at)."""
    active, low, width, through, retired = convs.where("length > 0").withColumn("key", F.lit(_NO_TURNS)), 0, 1, [], []
    while True:
        high = low + width
        classes = written(_split(turns, active, low, high).withColumn("round", F.lit(len(through))), "classes")
        through.append(classes)
        going_on = classes.where((F.col("pos") == high) & (F.col("length") > high)).select("conv_id", "length", "key")
        shared = classes.where(F.col("pos") == high).groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
        retired.append(going_on.join(shared, "key", "left_anti").select("conv_id", "length", F.lit(high).alias("at")))
        active = written(going_on.join(shared, "key", "left_semi").select("conv_id", "length", "key"), "active")
        if active.isEmpty():
            return _union(through), written(_union(retired), "retired")
        low, width = high, min(2 * width, MOST_TURNS)


def _blocks_of_ids(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Sorted (key, conv_id) as one row for up to `most` ids of one key."""
    at, held = None, []

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([at], pa.binary()), pa.array([held[0]], pa.int64()), pa.array([",".join(map(str, held))])], names=["key", "first", "ids"])

    for batch in batches:
        for key, conv_id in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if held and (key != at or len(held) == most):
                yield row()
                held = []
            at = key
            held.append(conv_id)
    if held:
        yield row()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted blocks of ids, streamed through one hash for each key."""
    at, state = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([at], pa.binary()), pa.array([state.hexdigest()])], names=["key", "ends_sha256"])

    for batch in batches:
        for key, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if key != at:
                if at is not None:
                    yield row()
                at, state = key, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
    if at is not None:
        yield row()


def _ends(ends: DataFrame) -> DataFrame:
    """key, ends_sha256 of rows (key, conv_id): the ids of a key in order are hashed one after the other by definition, so they travel there in packed blocks."""
    most = BLOCK_IDS
    blocks = ends.select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(releasing(lambda batches: _blocks_of_ids(batches, most)), "key binary, first long, ids string")
    return blocks.repartition("key").sortWithinPartitions("key", "first").select("key", "ids").mapInArrow(releasing(_hashed), "key binary, ends_sha256 string")


def prefix_trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """The nodes of the trie of conversations (conv_id, length from 0) with turns (conv_id, pos from 1 to length, digest of what is compared, n_chars).

    A node is what its members begin with: conv_id (the smallest member), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves (childless nodes in its subtree, itself
    included), saved_tokens (over its subtree, members but one times characters of the last turn), ends_sha256 (of the ids of members that end there, in order, joined by commas).
    No conversations: no nodes; conversations without turns are members of the root alone. Columns beside these are left behind.
    """
    classes, retired = _refined(convs, turns)
    node = classes.groupBy("pos", "key", "parent").agg(F.min("conv_id").alias("conv_id"))
    children = node.groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n"))
    tails = retired.select("conv_id", F.col("at").alias("pos"), F.lit(True).alias("tail"))
    owners = node.join(children, "key", "left").join(tails, ["conv_id", "pos"], "left")
    owners = owners.select("conv_id", "pos", F.coalesce("tail", F.lit(False)).alias("tail"), (F.coalesce("n", F.lit(0)) + F.coalesce("tail", F.lit(False)).cast("long")).alias("n_children"))
    # A node belongs to its smallest member; what its other members have there is saved, and a leaf counts once, for its owner.
    leaf = F.col("tail") | ((F.col("pos") == F.col("length")) & (F.col("n_children") == 0))
    rows = classes.join(owners, ["conv_id", "pos"], "left").select(
        "conv_id", "length", "pos", "key", "parent", "round", "n_children",
        F.when(F.col("n_children").isNull(), F.col("n_chars")).otherwise(0).alias("spare"), F.coalesce(leaf, F.lit(False)).cast("long").alias("leaf"),
    )
    rows = written(rows, "owned-classes")
    back = Window.partitionBy("conv_id", "round").orderBy(F.desc("pos"))
    later = Window.partitionBy("conv_id").orderBy(F.desc("round")).rowsBetween(Window.unboundedPreceding, -1)
    rounds = rows.groupBy("conv_id", "round").agg(F.sum("spare").alias("s"), F.sum("leaf").alias("l"))
    rounds = rounds.select("conv_id", "round", F.coalesce(F.sum("s").over(later), F.lit(0)).alias("s"), F.coalesce(F.sum("l").over(later), F.lit(0)).alias("l"))
    folded = rows.withColumns({"spare": F.sum("spare").over(back), "leaf": F.sum("leaf").over(back)}).join(rounds, ["conv_id", "round"])
    nodes = folded.groupBy("pos", "key", "parent").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("n_children").alias("n_children"),
        F.sum(F.col("leaf") + F.col("l")).alias("n_leaves"), F.sum(F.col("spare") + F.col("s")).alias("saved_tokens"),
    )
    nodes = written(nodes, "nodes")
    ends = rows.where("pos = length").select("key", "conv_id").unionByName(convs.where("length = 0").select(F.lit(_NO_TURNS).alias("key"), "conv_id"))
    ends = written(_ends(ends), "ends")
    drop_written(rows)
    none = F.lit(0).cast("long")
    members = convs.select("conv_id", F.lit(1).cast("long").alias("n_convs"), none.alias("n_children"), none.alias("n_leaves"), none.alias("saved_tokens"))
    top = nodes.where("pos = 1").select(F.lit(None).cast("long").alias("conv_id"), none.alias("n_convs"), F.lit(1).cast("long").alias("n_children"), "n_leaves", "saved_tokens")
    root = members.unionByName(top).agg(F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]).where("n_convs > 0")
    root = root.withColumn("n_leaves", F.when(F.col("n_children") == 0, 1).otherwise(F.col("n_leaves"))).select(none.alias("pos"), F.lit(_NO_TURNS).alias("key"), F.lit(None).cast("binary").alias("parent"), *root.columns)
    every = nodes.select(root.columns).unionByName(root)
    parents = every.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    every = every.join(parents, "parent", "left").join(ends, "key", "left")
    out = ["conv_id", F.col("pos").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256")]
    # Tails in pieces, so that a very long one is dealt out.
    starts = retired.withColumn("start", F.explode(F.sequence(F.col("at") + F.lit(1).cast("long"), F.col("length"), F.lit(MOST_TURNS).cast("long"))))
    chain = starts.withColumn("pos", F.explode(F.sequence("start", F.least(F.col("start") + MOST_TURNS - 1, F.col("length")))))
    last = F.col("pos") == F.col("length")
    chain = chain.select("conv_id", F.col("pos").alias("depth"), F.col("conv_id").alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"), (~last).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), none.alias("saved_tokens"), F.when(last, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(NO_ENDS).alias("ends_sha256"))
    return every.select(out).unionByName(chain)


def node_texts(nodes: DataFrame, turns: DataFrame) -> DataFrame:
    """Nodes with role and text of their last turn, from turns placed with texts; the root has none."""
    last = turns.select("conv_id", F.col("pos").cast("long").alias("depth"), "role", "text")
    return nodes.join(last, ["conv_id", "depth"], "left")
