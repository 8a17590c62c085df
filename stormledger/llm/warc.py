"""WARC archives: writing, normalising monolithic gzip files, and reading by offset index.

Archives are rows (archive, data) of a table, so writing and reading work wherever Spark's own
readers and writers do; ``binaryFile`` reads existing files into the same shape.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Raw bytes after which an archive is closed. One record may be longer.
ARCHIVE_BYTES = 8 << 20
DATE = "2024-01-01T00:00:00Z"
LEVEL = 3
INDEX = "array<struct<n:long,offset:long,length:long,type:string,record_id:string>>"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page {page_id}')}>"


def make_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record; a revisit carries the headers of its response but not the payload."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = {"WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": record_id(page_id), "WARC-Date": DATE}
    if url is not None:
        head["WARC-Target-URI"] = re.sub(r"[\r\n]+", " ", url)
    head |= {"X-Page-ID": "" if page_id is None else str(page_id), "WARC-Payload-Digest": f"sha1:{payload_digest(payload)}"}
    if revisit:
        head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": record_id(refers_to), "X-Refers-To-Page-ID": str(refers_to)}
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_head(head: bytes) -> dict[str, str]:
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {first[:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines if x)}


def inflate(data: bytes, chunk: int = 1 << 18) -> Iterator[bytes]:
    """The contents of a gzip file of any number of members, once through, in pieces of bounded size.

    The file is fed in slices, and each slice once, so time is linear in its size. Zeros between members are padding.
    """
    view, at = memoryview(data), 0
    while at < len(view):
        d, feed = zlib.decompressobj(31), b""
        while not d.eof:
            if not feed and at < len(view):
                feed = view[at : at + chunk]
                at += len(feed)
            last = not feed
            piece = d.decompress(feed, chunk)
            feed = d.unconsumed_tail
            if piece:
                yield piece
            elif last and not d.eof:
                raise ValueError("the archive ends inside a gzip member")
        at -= len(d.unused_data)
        while at < len(view) and view[at] == 0:
            at += 1


def split_records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header, whole record) from a stream; holds one record at a time."""
    buffer = bytearray()
    need, head = None, {}
    for piece in pieces:
        buffer += piece
        while True:
            if need is None:
                end = buffer.find(b"\r\n\r\n")
                if end < 0:
                    break
                head = parse_head(bytes(buffer[:end]))
                need = end + 4 + int(head["content-length"]) + 4
            if len(buffer) < need:
                break
            yield head, bytes(buffer[:need])
            del buffer[:need]
            need = None
    if buffer:
        raise ValueError("the archive ends inside a record")


def gzip_member(data: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def with_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, refers_to): of equal payloads of at least ``least_bytes`` bytes the largest
    page_id is the response and the others refer to it. A null html is an empty payload; a
    null page_id refers to the response, if there is one with an id. Rows that repeat the largest page_id
    with the payload are responses all.

    Only digests are grouped. The payloads meet a table of repeated digests, which is
    broadcast only if its written size allows it.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("__html")).withColumn("__sha", F.sha1("__html"))
    large = rows.where(F.octet_length("__html") >= least_bytes)
    first = materialize(large.groupBy("__sha").agg(F.max("page_id").alias("__first"), F.count("*").alias("__n")).where("__n > 1").select("__sha", "__first"), "repeats")
    refers = F.when(~F.col("__first").eqNullSafe(F.col("page_id")) & (F.octet_length("__html") >= least_bytes), F.col("__first"))
    return rows.join(first, "__sha", "left").select("page_id", "url", F.encode("__html", "UTF-8").alias("payload"), refers.alias("refers_to"))


def write_archives(records: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """(archive, data): rows (page_id, url, payload, refers_to) as WARC files, each one gzip stream
    over all its records. A partition makes as many archives as its bytes need."""

    def write(batches):
        part, n, size, z, out = TaskContext.get().partitionId(), 0, 0, None, []

        def close():
            data = b"".join(out) + z.flush()
            return pa.RecordBatch.from_arrays([pa.array([f"part-{part:06d}-{n:06d}.warc.gz"]), pa.array([data], pa.binary())], ["archive", "data"])

        for b in batches:
            for page_id, url, payload, refers_to in zip(*(b.column(i) for i in range(4)), strict=True):
                raw = make_record(page_id.as_py(), url.as_py(), payload.as_py(), refers_to.as_py())
                if z is None:
                    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                out.append(z.compress(raw))
                size += len(raw)
                if size >= archive_bytes:
                    yield close()
                    n, size, z, out = n + 1, 0, None, []
        if z is not None:
            yield close()

    return records.select("page_id", "url", "payload", "refers_to").mapInArrow(write, "archive string, data binary")


def normalise(archives: DataFrame) -> DataFrame:
    """(archive, data, index): each archive's stream is inflated once and each record rewritten as a
    gzip member of its own; the index has every member's offset and length.

    Takes monolithic files, files with a member for each record, and mixtures. A null or empty
    file has no records; a truncated one raises ValueError.
    """
    kind = pa.list_(pa.struct([("n", pa.int64()), ("offset", pa.int64()), ("length", pa.int64()), ("type", pa.string()), ("record_id", pa.string())]))

    def rewrite(batches):
        for b in batches:
            for name, data in zip(b.column(0), b.column(1), strict=True):
                members, index, at = [], [], 0
                for n, (head, raw) in enumerate(split_records(inflate(data.as_py() or b""))):
                    member = gzip_member(raw)
                    members.append(member)
                    index.append({"n": n, "offset": at, "length": len(member), "type": head.get("warc-type"), "record_id": head.get("warc-record-id")})
                    at += len(member)
                yield pa.RecordBatch.from_arrays([pa.array([name.as_py()], pa.string()), pa.array([b"".join(members)], pa.binary()), pa.array([index], kind)], ["archive", "data", "index"])

    return archives.select("archive", "data").mapInArrow(rewrite, f"archive string, data binary, index {INDEX}")


def sidecar(normalised: DataFrame) -> DataFrame:
    """(archive, n, offset, length, type, record_id): the offset index as a table of its own."""
    return normalised.select("archive", F.explode("index").alias("x")).select("archive", "x.*")


def read_records(archives: DataFrame, index: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of archives (archive, data) that an index (see ``sidecar``) lists, each member found by its offset.

    (archive, offset, record_type, page_id, url, payload_bytes, payload_digest, refers_to, payload). A
    response's digest and size are taken from its payload, and must agree with its header; a
    revisit has those of its header and a null payload. An index of some members reads those alone. The index of one
    archive is as long as the archive has records, and archives are closed at a size.
    """
    lists = materialize(index.groupBy("archive").agg(F.collect_list(F.struct("offset", "length")).alias("members")), "members")
    met = archives.select("archive", "data").join(lists, "archive").select("archive", "data", "members")
    names = ["archive", "offset", "record_type", "page_id", "url", "payload_bytes", "payload_digest", "refers_to", "payload"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

    def number(x: str | None) -> int | None:
        return int(x) if x else None

    def read(batches):
        for b in batches:
            for name, data, members in zip(*(b.column(i) for i in range(3)), strict=True):
                rows, data = [], memoryview(data.as_py() or b"")
                for x in members.as_py():
                    raw = zlib.decompress(data[x["offset"] : x["offset"] + x["length"]], 31)
                    end = raw.find(b"\r\n\r\n")
                    head = parse_head(raw[:end])
                    block = raw[end + 4 : end + 4 + int(head["content-length"])]
                    cut = block.find(b"\r\n\r\n")
                    said, payload = head["warc-payload-digest"].removeprefix("sha1:"), None
                    size = int(re.search(rb"Content-Length: ([0-9]+)", block[:cut])[1])
                    if head["warc-type"] == "response":
                        payload = block[cut + 4 :]
                        if payload_digest(payload) != said or len(payload) != size:
                            raise ValueError(f"{name} at {x['offset']}: the payload does not match its header")
                    rows.append((name.as_py(), x["offset"], head["warc-type"], number(head.get("x-page-id")), head.get("warc-target-uri"), size, said, number(head.get("x-refers-to-page-id")), payload if with_payload else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 9, kinds, strict=True)], names)

    return met.mapInArrow(read, "archive string, offset long, record_type string, page_id long, url string, payload_bytes long, payload_digest string, refers_to long, payload binary")


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Pages written as monolithic archives, normalised with an index beside them, and read back by the index, without payloads."""
    written = materialize(write_archives(with_revisits(pages, least_bytes)), "archives")
    made = materialize(normalise(written), "normalised")
    return read_records(made, materialize(sidecar(made), "sidecar"), with_payload=False)
