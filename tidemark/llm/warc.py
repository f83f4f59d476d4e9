"""Deterministic sharded WARC writer and reader (operator 2).

A first pass takes digests and sizes only. From it come the revisits (all but the largest page_id of equal payloads)
and the shard limits: ranges of page_id that hold about as many bytes each, found by counting bytes in equal parts of
the ranges that still hold too much, again and again, so that ids may lie as unevenly as they like. An id that holds
more than a shard by itself is split by its payload digests. Shards grow with the root of the corpus (16 MB of payload
up to 27 GB, 1 GB at 100 TB), as does their number.

A second pass sends each record once to its shard; a revisit's mark travels as a small row of its own that sorts just
before its page. A task writes a shard in order of page_id, each record as a gzip member of its own with regenerated
headers and digests, and begins a new file when the compressed size reaches ROLL. A file is written under a temporary
name that is unique to the attempt and renamed by its task when it is whole; the manifest, written last, lists the files.
Contents and names depend on the rows alone, so a second attempt after a lost executor renames the same bytes to the
same name.
"""

from __future__ import annotations

import base64
import hashlib
import math
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, new_folder, remove, shared, slices

SHARD = 16 << 20  # payload bytes of a shard at least, about
ROLL = 8 << 20  # compressed bytes at which a file is closed
READ = 32 << 20  # compressed bytes that a reading task goes through, about
PARTS = 1 << 18  # ranges whose bytes are counted in one pass, at most about
HEAD = 400  # bytes reckoned for a record's headers
NO_ID = -(1 << 63)  # where rows without page_id are sorted
DATE = "2024-01-01T00:00:00Z"
LEVEL = 6
EMPTY_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, payload_digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{payload_digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One gzip member: a response, or a revisit of the page refers_to, which has the same payload."""
    of_payload = digest(payload)
    block = EMPTY_HEAD + b"Content-Length: %d\r\n\r\n" % len(payload) + (payload if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, of_payload)}", f"WARC-Date: {DATE}"]
    if url is not None:
        # a header is one line: white space and control characters cannot stand in it
        head.append("WARC-Target-URI: " + "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url))
    head += [f"WARC-Payload-Digest: sha1:{of_payload}", f"WARC-Block-Digest: sha1:{digest(block)}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, of_payload)}", f"X-Refers-To-Page: {refers_to}"]
    if page_id is not None:
        head.append(f"X-Page: {page_id}")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a file of gzip members, one member in memory at a time."""
    rest = b""
    while True:
        unpacker, parts = zlib.decompressobj(31), []
        while not unpacker.eof:
            if not rest and not (rest := stream.read(1 << 20)):
                break
            parts.append(unpacker.decompress(rest))
            rest = unpacker.unused_data
        if not parts:
            return
        if not unpacker.eof:
            raise ValueError("a record is cut short")
        head, _, block = b"".join(parts).partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        block = block[: int(fields["Content-Length"])]
        if f"sha1:{digest(block)}" != fields["WARC-Block-Digest"]:
            raise ValueError(f"wrong block digest in {fields['WARC-Record-ID']}")
        yield fields, block


class Shards:
    """Limits of the shards: ranges of page_id from starts on; an id in splits has shards of its own by digest."""

    def __init__(self, starts: list[int], splits: dict[int, int]) -> None:
        self.starts = np.array(starts, np.int64)
        parts = np.array([splits.get(s, 1) for s in starts], np.int64)
        self.parts, self.first = parts, np.cumsum(parts) - parts
        self.count = int(parts.sum())

    def of(self, page_id: np.ndarray, sha1: list[str]) -> np.ndarray:
        at = np.searchsorted(self.starts, page_id, "right") - 1
        out = self.first[at]
        for i in np.flatnonzero(self.parts[at] > 1):
            out[i] += int(sha1[i][:8], 16) * self.parts[at[i]] >> 32
        return out


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(NO_ID).to_numpy(zero_copy_only=False)


def limits(known: DataFrame, least: int) -> Shards:
    """Shards of known (page_id, n): about max(least, sqrt(10,000 * all bytes)) bytes each."""
    spark = known.sparkSession
    low, high, total = known.agg(F.min(F.coalesce("page_id", F.lit(NO_ID))), F.max(F.coalesce("page_id", F.lit(NO_ID))), F.sum(F.col("n") + HEAD)).first()
    if total is None:
        return Shards([NO_ID], {})
    size = max(least, math.isqrt(10_000 * total))

    def counted(starts: list[int]) -> dict[int, int]:
        sent = shared(spark, np.array(starts, np.int64))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = np.zeros(len(sent()), np.int64)
            for batch in batches:
                at = np.searchsorted(sent(), _ids(batch.column(0)), "right") - 1
                np.add.at(held, at[at >= 0], (batch.column(1).to_numpy(zero_copy_only=False) + HEAD)[at >= 0])
            some = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(held[some])], names=["at", "n"])

        return {r["at"]: r.n for r in known.select("page_id", F.col("n").cast("long").alias("n")).mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()}

    ranges = [(low, high, total)]  # first id, last id, bytes; in order and without overlap
    while hot := [r for r in ranges if r[2] > size and r[0] < r[1]]:
        parts = max(4, min(4096, PARTS // len(hot)))
        cuts: list[int] = []
        fine: list[tuple[int, int, int]] = []
        for a, b, n in ranges:
            if n > size and a < b:
                step = -(-(b - a + 1) // parts)
                own = list(range(a, b + 1, step))
                fine += [(x, min(b, x + step - 1), -1) for x in own]
            else:
                own = [a]
                fine.append((a, b, n))
            cuts += own
        held = counted(cuts)
        ranges = []
        for k, (a, b, n) in enumerate(fine):
            n = held.get(k, 0) if n < 0 else n
            if ranges and ranges[-1][2] + n <= size:
                ranges[-1] = (ranges[-1][0], b, ranges[-1][2] + n)
            else:
                ranges.append((a, b, n))
    return Shards([a for a, _, _ in ranges], {a: -(-n // size) for a, b, n in ranges if n > size})


def _write(folder: str, roll: int):
    """Sorted rows of one or more shards -> a row for each file written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt = uuid.uuid4().hex
        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(f"{path}/_temporary", recursive=True)
        made, out, at = [], None, None
        marks: dict[tuple, int] = {}

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                out = None
                name = made[-1][0]
                store.move(f"{path}/_temporary/{attempt}-{name}", f"{path}/{name}")

        for batch in slices(batches):
            for shard, page_id, later, sha1, url, html, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != shard:
                    close()
                    at, number = shard, 0
                if not later:
                    marks = {k: v for k, v in marks.items() if k[0] == page_id} | {(page_id, sha1): refers}
                    continue
                payload = (html or "").encode()
                data = record(page_id, url, payload, marks.get((page_id, sha1)) if marks else None)
                if out is None:
                    made.append([f"shard-{shard:07d}-{number:05d}.warc.gz", shard, 0, 0])
                    number += 1
                    out = store.open_output_stream(f"{path}/_temporary/{attempt}-{made[-1][0]}", compression=None)  # members are gzip already
                out.write(data)
                made[-1][2] += 1
                made[-1][3] += len(data)
                if made[-1][3] >= roll:
                    close()
        close()
        columns = list(zip(*made, strict=True)) or [[]] * 4
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["name", "shard", "records", "bytes"])

    return run


def write(pages: DataFrame, folder: str, shard: int | None = None, roll: int | None = None) -> DataFrame:
    """Write a record per row of pages (page_id, url, html) into folder; gives the manifest, also written as
    folder/manifest (name, shard, records, bytes).

    A null html is an empty payload, a null url leaves the target out. Rows with a null page_id are written first,
    always as responses. Of rows with the same page_id and payload all are responses if it is the largest such id,
    else all revisit that one; such rows stay in one shard, however many. Other columns are ignored; an empty table gives
    an empty manifest and no files.
    """
    spark = pages.sparkSession
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    sha1 = F.sha1(F.coalesce("html", F.lit("")).cast("binary"))
    known = cut(base.select("page_id", sha1.alias("sha1"), F.coalesce(F.octet_length("html"), F.lit(0)).alias("n")))
    largest = known.where("page_id IS NOT NULL").groupBy("sha1").agg(F.max("page_id").alias("refers"), F.count("*").alias("rows")).where("rows > 1").drop("rows")
    marks = known.where("page_id IS NOT NULL").join(largest, "sha1").where("page_id < refers").select("page_id", "sha1", "refers").distinct()
    shards = limits(known, shard or SHARD)
    sent = shared(spark, shards)
    rows = base.select("page_id", F.lit(True).alias("later"), sha1.alias("sha1"), "url", "html", F.lit(None).cast("long").alias("refers"))
    rows = rows.union(marks.select("page_id", F.lit(False), "sha1", F.lit(None), F.lit(None), "refers"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            own = sent().of(_ids(batch.column(0)), batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), *batch.columns], names=["shard", *batch.schema.names])

    placed = rows.mapInArrow(place, "shard int, page_id long, later boolean, sha1 string, url string, html string, refers long")
    dealt = placed.repartitionById(shards.count, "shard").sortWithinPartitions("shard", "page_id", "later", "sha1", "url")
    manifest = cut(dealt.mapInArrow(_write(folder, roll or ROLL), "name string, shard long, records long, bytes long"))
    remove(spark, f"{folder.rstrip('/')}/_temporary")
    manifest.write.parquet(f"{folder.rstrip('/')}/manifest")
    return manifest


def read(spark, folder: str) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload) of the files that folder's
    manifest names. Block and payload digests are checked; a revisit has the size and digest of the full payload and
    a null payload."""
    manifest = spark.read.parquet(f"{folder.rstrip('/')}/manifest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())

        def packed(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            for name in batch.column(0).to_pylist():
                held, rows = 0, []
                with store.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    for fields, block in records(stream):
                        head, _, payload = block.partition(b"\r\n\r\n")
                        full = int(head.rpartition(b"Content-Length: ")[2])
                        said = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        kind = fields["WARC-Type"]
                        if kind == "response" and (digest(payload) != said or len(payload) != full):
                            raise ValueError(f"wrong payload in {fields['WARC-Record-ID']}")
                        page, refers = fields.get("X-Page"), fields.get("X-Refers-To-Page")
                        rows.append((page and int(page), fields.get("WARC-Target-URI"), full, said, kind, refers and int(refers), payload.decode() if kind == "response" else None))
                        held += len(payload)
                        if held > 4 << 20 or len(rows) >= 512:
                            yield packed(rows)
                            held, rows = 0, []
                if rows:
                    yield packed(rows)

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload string"
    files, total = manifest.agg(F.count("*"), F.sum("bytes")).first()
    tasks = max(1, min(files, max(spark.sparkContext.defaultParallelism, (total or 0) // READ)))
    return manifest.select("name").repartition(tasks).mapInArrow(run, schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write pages into a new folder beneath the shared one and read the archives back."""
    folder = new_folder(pages.sparkSession, "warc")
    write(pages, folder)
    return read(pages.sparkSession, folder)
