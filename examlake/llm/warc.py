"""WARC archives: writing with revisit records, and a splittable reader.

Each record is a gzip member of its own. A reading task gets a byte range of a file: it scans for the gzip magic, takes a candidate only if
what it decodes to starts like a record whose block has the stated length, and owns the records whose first byte lies in its
range; the last of them may end beyond it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import drop_written, releasing, shared_dir, written

MAGIC = b"\x1f\x8b\x08"
#: Bytes of a byte range, bytes that a reading task gets at most (in one or several ranges), and that it fetches at once.
SPLIT_BYTES = 4 << 20
TASK_BYTES = 64 << 20
FETCH_BYTES = 1 << 18
#: Parts into which the pages of a payload are dealt, as one payload (the empty one) may be that of very many pages.
SALTS = 16
#: Revisits up to which they are broadcast (about 30 MB); more are joined by a shuffle.
BROADCAST_REVISITS = 250_000
#: Payloads of fewer bytes are never revisits.
LEAST_BYTES = 0
_URN = "urn:examlake:page:"
#: Fixed values of the format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_KINDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = "2024-01-01T00:00:00Z") -> bytes:
    """One gzip member. A revisit has the HTTP header alone; that states the length of the payload it stands for."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    clean = "" if url is None else url.replace("\r", "%0D").replace("\n", "%0A")
    lines = [
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{_URN}{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        *([] if url is None else [f"WARC-Target-URI: {clean}"]),
        f"WARC-Payload-Digest: sha1:{digest_of(payload)}",
        *([] if refers_to is None else [f"WARC-Refers-To: <{_URN}{refers_to}>", f"WARC-Profile: {PROFILE}"]),
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(VERSION + b"\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


_LONG = re.compile(r"-?[0-9]{1,19}")


def _number(urn: str | None) -> int | None:
    """The page_id in a record id of this module; None in any other, also in one of its form that has no 64-bit number."""
    found = (urn or "").strip("<>")
    number = found.removeprefix(_URN) if found.startswith(_URN) else ""
    return int(number) if _LONG.fullmatch(number) and -(2**63) <= int(number) < 2**63 else None


def parsed(raw: bytes) -> dict | None:
    """The record that a member decodes to; None if it isn't one. Other kinds than response and revisit have a record_type alone; a response whose payload isn't what its digest or length says is damaged: that is its record_type, and what it says is kept without the payload."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    if not gap or not head.startswith(b"WARC/"):
        return None
    fields = {name.lower(): value for name, value in (line.split(": ", 1) for line in head.decode("utf-8", "replace").split("\r\n")[1:] if ": " in line)}
    if not fields.get("content-length", "").isdigit() or rest[int(fields["content-length"]) :] != b"\r\n\r\n":
        return None
    kind = fields.get("warc-type", "")
    if kind not in ("response", "revisit"):
        return {"record_type": kind}
    http, _, payload = rest[: int(fields["content-length"])].partition(b"\r\n\r\n")
    stated = next((x.partition(b":")[2].strip() for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), b"")
    length = int(stated) if stated.isdigit() and len(stated) < 19 else None
    revisit = kind == "revisit"
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:") or (None if revisit else digest_of(payload))
    if not revisit and (digest != digest_of(payload) or length not in (None, len(payload))):
        kind, payload = "damaged", None
    return {"page_id": _number(fields.get("warc-record-id")), "url": fields.get("warc-target-uri"), "record_type": kind, "refers_to": _number(fields.get("warc-refers-to")) if revisit else None, "payload_bytes": length if revisit or payload is None else len(payload), "payload_digest": digest, "payload": None if revisit else payload}


def _opened(path: str):
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    return store, inner


def owned_records(source, start: int, stop: int, size: int, fetch: int = FETCH_BYTES) -> Iterator[dict]:
    """The records that start in [start, stop) of a seekable file of so many bytes."""

    def member(at: int) -> tuple[bytes, int] | None:
        """What the member at `at` decodes to, and where it ends; nothing if it isn't a record's."""
        unpack, out, here = zlib.decompressobj(31), [], at
        while not unpack.eof:
            source.seek(here)
            part = source.read(min(fetch, size - here))
            if not part:
                return None
            try:
                out.append(unpack.decompress(part))
            except zlib.error:
                return None
            here += len(part)
            if sum(map(len, out)) >= 5 and not b"".join(out[:2])[:5].startswith(b"WARC/"):
                return None
        return b"".join(out), here - len(unpack.unused_data)

    at = start
    while at < stop:
        source.seek(at)
        part = source.read(min(fetch + len(MAGIC) - 1, size - at))
        found = part.find(MAGIC)
        if found < 0:
            at += max(1, len(part) - len(MAGIC) + 1)
            continue
        at += found
        if at >= stop:
            return
        got = member(at)
        row = parsed(got[0]) if got else None
        if row is None:
            at += 1
        else:
            if "payload" in row:
                yield row
            at = got[1]


def _written_archives(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, count, out = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, None
        for batch in batches:
            for row in zip(*[batch.column(k).to_pylist() for k in ("page_id", "url", "payload", "refers_to")], strict=True):
                if out is None:
                    store, inner = _opened(name)
                    store.create_dir(inner.rpartition("/")[0], recursive=True)
                    out = store.open_output_stream(inner, compression=None)
                out.write(record(*row))
                count += 1
        if out is not None:
            size = out.tell()
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [name], "size": [size], "records": [count]})

    return run


def write_archives(pages: DataFrame, folder: str | None = None, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """A written table of the archives: path, size, records. pages: page_id, url, html.

    Of records with equal payloads of at least least_bytes, that with the smallest page_id is a response and the others revisit it; smaller
    ones are responses. Null html is an empty payload; a null page_id is never a revisit; rows that repeat a response's page_id are responses
    too. A task's file has a name of its own, and only files of tasks that ended well are in the table, so a repeated task leaves no trace in it.
    """
    spark = pages.sparkSession
    folder = folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload")).withColumn("key", F.sha2("payload", 256))
    # SHA-256 alone decides which payloads are equal
    keys = rows.where(F.length("payload") >= least_bytes).select("page_id", "key", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int").alias("salt"))
    firsts = keys.groupBy("key").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).where("refers_to < last").drop("last")
    firsts = firsts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    again = written(keys.join(firsts, ["key", "salt"]).where("page_id > refers_to").select("page_id", "key", "refers_to").distinct(), "revisits")
    # by page and payload: a page may have several payloads
    few = again.limit(BROADCAST_REVISITS + 1).count() <= BROADCAST_REVISITS
    full = rows.join(F.broadcast(again) if few else again, ["page_id", "key"], "left").select("page_id", "url", "payload", "refers_to")
    out = written(full.mapInArrow(releasing(_written_archives(folder)), "path string, size long, records long"), "archives")
    drop_written(again)
    return out


def _read(payloads: bool):
    names = [k.split()[0] for k in _KINDS.split(", ")][: None if payloads else -1]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    schema = pa.schema(list(zip(names, types, strict=False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, stop, size in zip(*[batch.column(k).to_pylist() for k in ("path", "start", "stop", "size")], strict=True):
                store, inner = _opened(path)
                with store.open_input_file(inner) as source:
                    held, weight = [], 0
                    for row in owned_records(source, start, stop, size):
                        held.append(row if payloads else {k: row[k] for k in names})
                        weight += len(row["payload"] or b"") if payloads else 1000
                        if weight > 4 << 20:
                            yield pa.RecordBatch.from_pylist(held, schema)
                            held, weight = [], 0
                    if held:
                        yield pa.RecordBatch.from_pylist(held, schema)

    return run


def reading_tasks(archives: DataFrame, split_bytes: int = SPLIT_BYTES) -> int:
    """Tasks for the byte ranges of all archives: a few for each core, more where that would be over TASK_BYTES each, never more than ranges."""
    ranges, total = archives.agg(F.coalesce(F.sum(F.ceil(F.col("size") / split_bytes)), F.lit(0)), F.coalesce(F.sum("size"), F.lit(0))).first()
    return max(1, min(int(ranges), max(4 * archives.sparkSession.sparkContext.defaultParallelism, int(total) // TASK_BYTES)))


def read_archives(archives: DataFrame, payloads: bool = True, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """page_id, url, record_type, refers_to, payload_bytes, payload_digest and payload (null for revisits) of all records.

    archives: path and size of each file. Payload digests are verified as they are read; a response without one gets its own, and one whose payload is another is a row of record_type damaged, with what it says and no payload. Records of
    other kinds, and bytes between members that are no record, are passed over; page_id is null where a record id isn't one of this module. An empty table gives no rows.
    """
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(split_bytes).cast("long")))
    splits = archives.select("path", "size", starts.alias("start")).withColumn("stop", F.least(F.col("start") + split_bytes, "size"))
    # a number of its own, which adaptive execution leaves as it is: the rows are few and small, what they stand for isn't
    spread = splits.repartition(reading_tasks(archives, split_bytes))
    return spread.mapInArrow(releasing(_read(payloads)), _KINDS if payloads else _KINDS.rpartition(",")[0])


def read_files(spark: SparkSession, pattern: str, payloads: bool = True) -> DataFrame:
    """The same for files found by a path pattern."""
    found = spark.read.format("binaryFile").load(pattern).select("path", F.col("length").alias("size"))
    return read_archives(found.withColumn("path", F.regexp_replace("path", "^file:/+", "file:///")), payloads)
