"""A store of tables that are changed by key, one atomic version after the other.

A table lies in buckets of its key's hash. A change writes new files for the buckets it touches and then a manifest, which says for each table which folder holds which
bucket, under the next version's name. That name is taken by one rename that fails if another writer was first, in which case the change is made again on what that one left. A writer
that is killed before leaves files that no manifest names: readers stay at the old version, and vacuum() removes them. Several tables change in one version, so a move is whole or isn't.

Rows are dealt out once, by bucket, when they come in. What a change keeps of a bucket, and what moves from one table to another, is written from where it lies: keys meet keys alone, and what
comes back to the files is a bit for each row.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator, Mapping
from contextlib import contextmanager
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of a table: a change rewrites as many of them as it has keys at most, a lookup of a key reads one.
BUCKETS = 64
#: Versions that are tried when other writers keep being first, and those that vacuum() leaves.
TRIES, KEPT = 20, 10


@dataclass(frozen=True)
class Kind:
    """A table's schema, the columns of its key, and the one that its buckets are by."""

    schema: str
    key: tuple[str, ...]
    bucket_by: str


@dataclass(frozen=True)
class Change:
    """Rows to put in place of those of equal keys, and keys (any of the table's columns) whose rows go first.

    placed: the rows put come from a table of this store with buckets by the same column, by rows alone, and are written from where they lie.
    """

    put: DataFrame | None = None
    remove: DataFrame | None = None
    placed: bool = False


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that executors share (spark.checkpoint.dir; only where that is unset, as in tests, a temporary one)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return f"{(found or 'file://' + tempfile.mkdtemp(prefix='examlake-store-')).rstrip('/')}/store-{uuid.uuid4().hex}"


def _place() -> dict[str, Column]:
    """Where a row lies: a number for its file, and for its place there a block of 32,768 rows and a bit in it."""
    row = F.col("_metadata.row_index")
    return {"_file": F.xxhash64("_metadata.file_path"), "_block": F.bitmap_bucket_number(row), "_bit": F.bitmap_bit_position(row)}


def _told(rows: DataFrame, keys: DataFrame, on: list[str], hidden: str) -> DataFrame:
    """rows (a read, or such with places) with places and whether their key is among keys. Whole rows are not dealt out: the keys that are found give a bit for each row to all tasks."""
    placed = rows if "_bit" in rows.columns else rows.withColumns(_place())
    found = placed.select(*on, *_place()).join(keys.select(*on), on, "left_semi")
    bits = found.groupBy("_file", "_block").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    byte = F.ascii(F.decode(F.substring("_bits", (F.col("_bit") / 8).cast("int") + 1, F.lit(1)), "ISO-8859-1"))
    return placed.join(F.broadcast(bits), ["_file", "_block"], "left").withColumn(hidden, F.coalesce(F.getbit(byte, (F.col("_bit") % 8).cast("int")) == 1, F.lit(False))).drop("_bits")


class Store:
    def __init__(self, spark: SparkSession, path: str, kinds: Mapping[str, Kind], buckets: int = BUCKETS):
        self.spark, self.path, self.kinds, self.buckets = spark, path.rstrip("/"), dict(kinds), buckets

    # files

    def _hadoop(self, path: str):
        found = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return found, found.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        path, fs = self._hadoop(f"{self.path}/{folder}")
        return sorted(x.getPath().getName() for x in fs.listStatus(path)) if fs.exists(path) else []

    def versions(self) -> list[int]:
        return [int(name.removesuffix(".json")) for name in self._names("versions") if name.endswith(".json")]

    def manifest(self, version: int | None = None) -> dict[str, dict[str, str]]:
        """For each table, the folder of each bucket; an empty one before the first version."""
        known = self.versions()
        at = version if version is not None else (known[-1] if known else None)
        if at is None:
            return {name: {} for name in self.kinds}
        path, fs = self._hadoop(f"{self.path}/versions/{at:012d}.json")
        stream = fs.open(path)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return {name: {} for name in self.kinds} | json.loads(text)

    def _publish(self, manifest: dict, version: int) -> bool:
        """Whether this writer got the version's name."""
        staged, fs = self._hadoop(f"{self.path}/staged/{uuid.uuid4().hex}.json")
        stream = fs.create(staged, False)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        target, _ = self._hadoop(f"{self.path}/versions/{version:012d}.json")
        fs.mkdirs(target.getParent())
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        plain = self.spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0)
        try:
            hadoop.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration()).rename(staged, target, plain)
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in e.java_exception.getClass().getName():
                raise
            fs.delete(staged, False)
            return False
        return True

    # tables

    def _bucketed(self, name: str, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64(F.col(self.kinds[name].bucket_by)), F.lit(self.buckets)).cast("int"))

    def _read(self, name: str, folders: Iterable[str]) -> DataFrame:
        paths = sorted(f"{self.path}/data/{folder}" for folder in folders)
        empty = self.spark.createDataFrame([], self.kinds[name].schema)
        return self.spark.read.schema(empty.schema).parquet(*paths) if paths else empty

    def table(self, name: str, version: int | None = None, of: Iterable | None = None, having: DataFrame | None = None) -> DataFrame:
        """A table, as of a version (the latest); of: values of the column that buckets are by, whose buckets alone are read; having: keys (any of the table's columns) whose rows alone are wanted."""
        folders, by = self.manifest(version)[name], self.kinds[name].bucket_by
        if having is not None:
            rows = self._read(name, folders.values())
            return _told(rows, having, having.columns, "_wanted").where("_wanted").select(*rows.columns) if folders else rows
        if of is None:
            return self._read(name, folders.values())
        wanted = self.spark.createDataFrame([(x,) for x in of], f"{by} {dict(self.spark.createDataFrame([], self.kinds[name].schema).dtypes)[by]}")
        buckets = {str(r.bucket) for r in self._bucketed(name, wanted).select("bucket").distinct().collect()}
        return self._read(name, (f for b, f in folders.items() if b in buckets)).join(wanted, by, "left_semi")

    @contextmanager
    def _unsorted(self) -> Iterator[None]:
        """Tasks keep a file open for each bucket, instead of sorting whole rows by bucket first."""
        name = "spark.sql.maxConcurrentOutputFileWriters"
        before = self.spark.conf.get(name)
        self.spark.conf.set(name, str(self.buckets))
        try:
            yield
        finally:
            self.spark.conf.set(name, before)

    def _written(self, name: str, rows: DataFrame, placed: bool = False) -> dict[str, str]:
        """Rows as new files: the folder of each bucket. They are dealt out by bucket, large buckets to several tasks (rebalance), unless they lie so."""
        folder, rows = f"{name}-{uuid.uuid4().hex}", self._bucketed(name, rows)
        with self._unsorted():
            (rows if placed else rows.hint("rebalance", "bucket")).write.partitionBy("bucket").parquet(f"{self.path}/data/{folder}")
        return {x.removeprefix("bucket="): f"{folder}/{x}" for x in self._names(f"data/{folder}") if x.startswith("bucket=")}

    def _rewritten(self, name: str, change: Change, folders: dict[str, str]) -> dict[str, str]:
        """Where a table's buckets lie after a change; those it doesn't touch stay where they are, and where nothing was before, what is put is the bucket."""
        kind = self.kinds[name]
        columns = self.spark.createDataFrame([], kind.schema).columns
        put = self._written(name, change.put.select(*columns), change.placed) if change.put is not None else {}
        touched = set(put)
        if change.remove is not None:
            touched |= {str(r.bucket) for r in self._bucketed(name, change.remove).select("bucket").distinct().collect()} if kind.bucket_by in change.remove.columns else set(folders)
        met = touched & set(folders)
        if not met:
            return folders | put
        rest = self._read(name, (folders[b] for b in met))
        if change.remove is not None:
            rest = _told(rest, change.remove, [c for c in change.remove.columns if c in columns], "_gone").where("not _gone")
        if put.keys() & met:
            new = self._read(name, (put[b] for b in put.keys() & met))
            rest = _told(rest, new, list(kind.key), "_replaced").where("not _replaced").select(*columns).unionByName(new)
        kept = self._written(name, rest.select(*columns), placed=True)
        return {b: f for b, f in folders.items() if b not in met} | {b: f for b, f in put.items() if b not in met} | kept

    def change(self, **changes: Change) -> int:
        """Changes tables (by name) in one new version, and gives its number. Rows put must have one row a key."""
        return self.changed(lambda _: changes)

    def changed(self, changes: Callable[[int | None], Mapping[str, Change]]) -> int:
        """As change(), with changes that are made from the version at hand (None: there is none yet): where another writer was first, they are made again from its version."""
        for _ in range(TRIES):
            known = self.versions()
            at = known[-1] if known else None
            manifest = self.manifest(at)
            after = manifest | {name: self._rewritten(name, change, manifest[name]) for name, change in changes(at).items()}
            version = at + 1 if at else 1
            if self._publish(after, version):
                return version
        raise RuntimeError(f"other writers were first {TRIES} times")

    def vacuum(self, kept: int = KEPT) -> int:
        """Deletes versions but for the last ones, and folders that those left don't name; not while others write. Gives the number of folders deleted."""
        versions = self.versions()
        named = {folder.partition("/")[0] for v in versions[-kept:] for folders in self.manifest(v).values() for folder in folders.values()}
        old = [f"versions/{v:012d}.json" for v in versions[:-kept]] + [f"staged/{name}" for name in self._names("staged") if name.endswith(".json")]
        gone = [f"data/{name}" for name in self._names("data") if name not in named]
        for name in old + gone:
            path, fs = self._hadoop(f"{self.path}/{name}")
            fs.delete(path, True)
        return len(gone)
