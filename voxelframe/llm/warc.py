"""WARC: archives of gzip members, an index written first, and coalesced byte-range reads of selected records.

``write_archives`` writes each task's records to its own files in the shared folder and returns one index row a
record: file, offset, length, URL and digest. A retried task writes new files and only its index rows count, so lost
executors leave orphans, never wrong records. ``read_records`` takes any selection of index rows, deals them by range
of (file, offset), merges neighbouring ranges into reads of up to ``READ`` bytes, and checks every payload's digest.

Of records with equal payloads of at least ``min_bytes`` bytes, the one with the smallest page_id is a response and
the others are revisits without payload that name it; smaller payloads are always responses.

Defined cases: a null html is an empty payload; a null url is an empty target; line ends in a url are percent-encoded;
rows without page_id are revisits where an equal payload has one, else responses; rows that share the smallest
page_id of a payload are all responses; rows of one page_id with different payloads are judged by their own payload
each; very long pages are one record; an empty table gives no record; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelframe.storage import materialise, scratch_path

from .common import mapped, slices

#: Bytes of an archive before the next is begun, of one read, and of a gap that is read over.
ROLL, READ, GAP = 64 << 20, 4 << 20, 64 << 10
#: Groups that rows without page_id are dealt into.
SALTS = 64
#: Fixed: the records carry no clock time, so equal pages give equal archives.
DATE = "2024-01-01T00:00:00Z"
CRLF = b"\r\n"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record as a gzip member. A revisit keeps the HTTP head, whose Content-Length is the full payload's."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    name = "" if page_id is None else page_id
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{name}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return gzip.compress("\r\n".join(head).encode() + CRLF + CRLF + block + CRLF + CRLF, 1, mtime=0)


def parse(member: bytes) -> dict:
    """Headers, HTTP head and payload of a gzip member; an incomplete or false record is an error."""
    data = gzip.decompress(member)
    head, _, rest = data.partition(CRLF + CRLF)
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != CRLF + CRLF:
        raise ValueError("record length is wrong")
    http, _, payload = block.partition(CRLF + CRLF)
    size = next(int(x.split(b":")[1]) for x in http.split(CRLF) if x.lower().startswith(b"content-length:"))
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != size or base32_sha1(payload) != digest):
        raise ValueError("payload does not match its digest")
    number = lambda v: int(v[10:-1]) if v and v[10:-1] else None
    return {
        "page_id": number(fields["WARC-Record-ID"]),
        "url": fields["WARC-Target-URI"],
        "record_type": kind,
        "payload": payload if kind == "response" else None,
        "payload_bytes": size,
        "payload_digest": digest,
        "refers_to": number(fields.get("WARC-Refers-To", "")),
    }


#: A payload held by more pages than this is matched by a broadcast; there are at most as many such as pages by HELD.
HELD = 50_000


def revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, digest, refers_to) of the pages whose payload a smaller page_id has; only digests are shuffled."""
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    seen = pages.select(F.col("page_id").cast("long"), F.unhex(F.sha1(html)).alias("digest"), F.length(html).alias("n")).where(F.col("n") >= min_bytes)
    seen = materialise(seen.select("page_id", "digest"), "warc-digests")
    first = seen.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("held")).where("held > 1 and refers_to is not null")
    first = materialise(first, "warc-copies")
    hot = first.where(F.col("held") > HELD).select("digest", "refers_to")
    cold = first.where(F.col("held") <= HELD).select("digest", "refers_to")
    joined = seen.join(cold, "digest")
    if not hot.isEmpty():
        joined = joined.unionByName(seen.join(F.broadcast(hot), "digest"))
    return joined.where("page_id is null or page_id > refers_to").select("page_id", "digest", "refers_to").distinct()


INDEX = "page_id long, url string, file string, offset long, length long, digest string, record_type string"


def write_archives(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write the archives and return their index, a table in the shared folder."""
    folder = scratch_path(pages.sparkSession, "warc")
    html = F.coalesce(F.col("html"), F.lit(""))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    own = own.withColumn("digest", F.unhex(F.sha1(F.col("html").cast("binary"))))
    # Few pages are revisits, and their rows are short. Rows without page_id are matched by digest, spread over salts.
    again = revisits(pages, min_bytes).withColumn("salt", F.when(F.col("page_id").isNull(), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
    again = again.select(F.coalesce("page_id", F.lit(0)).alias("_id"), F.col("page_id").isNull().alias("_none"), "digest", "refers_to", F.explode("salt").alias("_salt"))
    salt = F.when(F.col("page_id").isNull(), F.pmod(F.xxhash64("url", F.monotonically_increasing_id()), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
    own = own.select("*", F.coalesce("page_id", F.lit(0)).alias("_id"), F.col("page_id").isNull().alias("_none"), salt.alias("_salt"))
    joined = own.join(again, ["_id", "_none", "_salt", "digest"], "left").select("page_id", "url", "html", "refers_to")
    return materialise(mapped(joined, writer(folder), INDEX), "warc-index")


def writer(folder: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(folder)
        stream, name, at = None, "", 0
        try:
            for batch in slices(batches, "html"):
                rows = []
                for row in batch.to_pylist():
                    if stream is None or at >= ROLL:
                        if stream is None:
                            store.create_dir(root, recursive=True)
                        else:
                            stream.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        stream = store.open_output_stream(f"{root}/{name}", compression=None)
                    payload = (row["html"] or "").encode()
                    digest = base32_sha1(payload)
                    member = record(row["page_id"], row["url"], payload, digest, row["refers_to"])
                    stream.write(member)
                    kind = "response" if row["refers_to"] is None else "revisit"
                    rows.append({"page_id": row["page_id"], "url": row["url"], "file": f"{folder}/{name}", "offset": at, "length": len(member), "digest": digest, "record_type": kind})
                    at += len(member)
                yield pa.RecordBatch.from_pylist(rows, INDEX_ARROW)
        finally:
            if stream is not None:
                stream.close()

    return run


INDEX_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("digest", pa.string()), ("record_type", pa.string())])
RECORDS = "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long"
RECORDS_ARROW = pa.schema(
    [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())]
)


def coalesced(rows: Iterable[tuple[str, int, int]]) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
    """Sorted (file, offset, length) merged into (file, start, end, members): gaps are small and reads bounded."""
    now: list | None = None
    for file, offset, length in rows:
        if now and now[0] == file and offset - now[2] <= GAP and offset + length - now[1] <= READ:
            now[2] = max(now[2], offset + length)
            now[3].append((offset, length))
        else:
            if now:
                yield tuple(now)
            now = [file, offset, offset + length, [(offset, length)]]
    if now:
        yield tuple(now)


def read_records(index: DataFrame) -> DataFrame:
    """The records of the given index rows, read back from the archives."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[str, int, int]]:
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        opened, handle = None, None
        for file, start, end, members in coalesced(rows()):
            if file != opened:
                if handle is not None:
                    handle.close()
                store, path = pafs.FileSystem.from_uri(file)
                opened, handle = file, store.open_input_file(path)
            data = handle.read_at(end - start, start)
            found = [parse(data[a - start : a - start + n]) for a, n in members]
            yield pa.RecordBatch.from_pylist(found, RECORDS_ARROW)
        if handle is not None:
            handle.close()

    chosen = index.select("file", "offset", "length")
    n = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return mapped(chosen.repartitionByRange(n, "file", "offset").sortWithinPartitions("file", "offset"), run, RECORDS)
