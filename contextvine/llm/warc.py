"""WARC archives: writing, and normalising a monolithic gzip into one member per record.

An archive written as one gzip stream can't be entered in the middle.  The
normaliser inflates such a file once, front to back in bounded pieces, rewrites
every record as a gzip member of its own and leaves a sidecar index of offsets,
so that later readers fetch any record, or any block of records, by itself.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import attempt_name, filesystem, fresh, materialise, shuffle_width

PIECE = 1 << 20
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest32(payload: bytes) -> str:
    """SHA-1 in bare upper-case base32."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None = None) -> bytes:
    """A WARC/1.1 record; a revisit keeps the HTTP head of its payload and refers to its response."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if kind == "revisit" else http + payload
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{'null' if page_id is None else page_id}>")]
    if url is not None:
        # a header field is one line
        fields.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    fields += [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if kind == "revisit":
        fields += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + f"Content-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def inflate(source, piece: int = PIECE) -> Iterator[bytes]:
    """The plain bytes of a gzip file of one or more members, in bounded pieces."""
    engine, data, ended = None, b"", False
    while True:
        if not data and not ended:
            data = source.read(piece)
            ended = not data
        if engine is None:
            if not data:
                return
            engine = zlib.decompressobj(31)
        out = engine.decompress(data, piece)
        data = engine.unconsumed_tail
        if out:
            yield out
        if engine.eof:
            data, engine = engine.unused_data, None
        elif ended and not out and not data:
            raise EOFError("the gzip stream ends early")


def split_records(pieces: Iterator[bytes]) -> Iterator[tuple[bytes, bytes]]:
    """``(head, block)`` of each record; holds one record and one piece."""
    held = bytearray()

    def more() -> bool:
        got = next(pieces, None)
        if got is not None:
            held.extend(got)
        return got is not None

    while True:
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not more():
                if held.strip():
                    raise ValueError("a record's head ends early")
                return
        head = bytes(held[: end + 4])
        if not head.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        size = next(int(line.split(b":", 1)[1]) for line in head.split(b"\r\n") if line.lower().startswith(b"content-length:"))
        while len(held) < end + 8 + size:
            if not more():
                raise ValueError("a record's block ends early")
        yield head, bytes(held[end + 4 : end + 4 + size])
        del held[: end + 8 + size]


def fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode().split("\r\n")[1:] if line)}


#: A sidecar entry: offset and length of a member, first 20 bytes of the SHA-256 of its record id.
ENTRY = struct.Struct("<QQ20s")


def sidecar_entry(offset: int, length: int, record_id: str, record_type: str) -> bytes:
    return ENTRY.pack(offset, length, hashlib.sha256(record_id.encode()).digest()[:20])


def read_sidecar(source, first: int, n: int) -> list[tuple[int, int]]:
    """``(offset, length)`` of ``n`` members from the ``first`` on (fewer at the end); only their entries are read."""
    source.seek(first * ENTRY.size)
    return [(offset, length) for offset, length, _ in ENTRY.iter_unpack(source.read(n * ENTRY.size))]


def read_members(source, entries: list[tuple[int, int]], most_bytes: int = 8 << 20) -> Iterator[tuple[int, bytes]]:
    """``(offset, member)`` of neighbouring members, read in stretches of about ``most_bytes`` or of one member."""
    at = 0
    while at < len(entries):
        begin, end = entries[at][0], at + 1
        while end < len(entries) and sum(entries[end]) - begin <= most_bytes:
            end += 1
        source.seek(begin)
        held = memoryview(source.read(sum(entries[end - 1]) - begin))
        for offset, length in entries[at:end]:
            yield offset, bytes(held[offset - begin : offset - begin + length])
        at = end


def normalise(source, sink, level: int = 6) -> list[tuple[int, int, str, str]]:
    """Rewrite an archive with a member per record; ``(offset, length, record id, type)`` of each."""
    return list(normalised(source, sink, level))


def normalised(source, sink, level: int = 6) -> Iterator[tuple[int, int, str, str]]:
    """The same, entry by entry as records are written: nothing but the present record is held."""
    at = 0
    for head, block in split_records(inflate(source)):
        engine = zlib.compressobj(level, zlib.DEFLATED, 31)
        member = engine.compress(head + block + b"\r\n\r\n") + engine.flush()
        sink.write(member)
        found = fields(head)
        yield at, len(member), found.get("warc-record-id", ""), found.get("warc-type", "")
        at += len(member)


def write_archives(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", level: int = 1, most_bytes: int = 1 << 30) -> DataFrame:
    """Write one record per page into monolithic archives; the committed manifest has a row per file.

    Null html is an empty payload.  Of pages with equal payloads that with the
    largest id is the response and the others revisit it; a page without an id is
    a response of its own if no page of its payload has one, else a revisit.  Rows
    that repeat an id are a record each, all responses if their id is the largest;
    an empty table writes no file.  A file closes after ``most_bytes`` of records.
    """
    spark = pages.sparkSession
    folder = fresh(spark, "warc")
    body = F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), body.alias("payload"), F.sha1(body).alias("sha1"))
    # written, so that the join deals both sides and can split a payload that a third of all pages hold
    top = materialise(rows.groupBy("sha1").agg(F.max("page_id").alias("top")), "warc-top")
    rows = rows.join(top.hint("merge"), "sha1")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = filesystem(folder)
        fs.create_dir(at, recursive=True)
        out, engine, path, written, n = None, None, None, 0, 0

        def done() -> pa.RecordBatch:
            out.write(engine.flush())
            out.close()
            return pa.RecordBatch.from_pydict({"path": [path], "records": [n]}, schema=pa.schema([("path", pa.string()), ("records", pa.int64())]))

        for batch in batches:
            for digest, page, uri, payload, ref in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if out is None:
                    name = attempt_name("pages", ".warc.gz")
                    path, out, engine, written, n = f"{folder}/{name}", fs.open_output_stream(f"{at}/{name}", compression=None), zlib.compressobj(level, zlib.DEFLATED, 31), 0, 0
                kind = "response" if page == ref else "revisit"
                raw = record(kind, page, uri, payload, base64.b32encode(bytes.fromhex(digest)).decode(), ref)
                out.write(engine.compress(raw))
                written, n = written + len(raw), n + 1
                if written >= most_bytes:
                    yield done()
                    out = None
        if out is not None:
            yield done()

    return materialise(rows.select("sha1", "page_id", "url", "payload", "top").mapInArrow(write, "path string, records long"), "warc-manifest")


def normalise_archives(manifest: DataFrame, level: int = 6) -> DataFrame:
    """One normalised archive and one sidecar index per monolithic archive; committed manifest of both.

    An empty manifest gives an empty one; a path that stands twice is normalised twice.
    The index has an entry of fixed width per record, so any range of it is read by itself.
    """
    spark = manifest.sparkSession
    folder = fresh(spark, "warc-records")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = filesystem(folder)
        fs.create_dir(at, recursive=True)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                name = attempt_name("records", ".warc.gz")
                source_fs, source_at = filesystem(path)
                with source_fs.open_input_stream(source_at, compression=None) as source, fs.open_output_stream(f"{at}/{name}", compression=None) as sink, fs.open_output_stream(f"{at}/{name}.idx", compression=None) as side:
                    n = 0
                    for entry in normalised(source, sink, level):
                        side.write(sidecar_entry(*entry))
                        n += 1
                yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "index": [f"{folder}/{name}.idx"], "records": [n]}, schema=pa.schema([("path", pa.string()), ("index", pa.string()), ("records", pa.int64())]))

    width = max(shuffle_width(spark), 1)
    return materialise(manifest.select("path").repartition(width).mapInArrow(run, "path string, index string, records long"), "warc-records-manifest")


def read_archives(manifest: DataFrame, block_records: int = 4096) -> DataFrame:
    """One row per record, fetched by the offsets of the sidecar indexes and checked against its digest.

    A task reads ``block_records`` index entries and the members they name.  Repeated
    records repeat; an empty manifest gives no row.
    """
    spark = manifest.sparkSession
    blocks = manifest.select("path", "index", F.explode(F.sequence(F.lit(0), F.col("records") - 1, F.lit(block_records))).alias("first")).where("records > 0")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, index, first in zip(*(batch.column(k).to_pylist() for k in range(3))):
                fs, at = filesystem(index)
                with fs.open_input_file(at) as source:
                    entries = read_sidecar(source, first, block_records)
                fs, at = filesystem(path)
                columns: list[list] = [[], [], [], [], []]
                with fs.open_input_file(at) as source:
                    for offset, member in read_members(source, entries):
                        (head, block), = split_records(inflate_once(member))
                        found = fields(head)
                        http, _, payload = block.partition(b"\r\n\r\n")
                        size = int(fields(http)["content-length"])
                        digest = found["warc-payload-digest"].removeprefix("sha1:")
                        if found["warc-type"] == "response" and (len(payload) != size or digest32(payload) != digest):
                            raise ValueError(f"{path}: the payload at {offset} is not what was written")
                        refers = found.get("warc-refers-to")
                        for column, value in zip(columns, (urn(found["warc-record-id"]), size, digest, found["warc-type"], urn(refers) if refers else None)):
                            column.append(value)
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return blocks.where("first is not null").repartition(max(shuffle_width(spark), 1)).mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def inflate_once(member: bytes) -> Iterator[bytes]:
    yield zlib.decompress(member, 31)


def urn(value: str) -> int | None:
    found = value.strip("<>").rpartition(":")[2]
    return None if found in ("null", "None") else int(found)
