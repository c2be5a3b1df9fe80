"""FASTA and FASTQ files in ranges: plain text, or gzip in blocks whose headers give their size.

A block-gzip file is a row of small gzip members, each naming its length in its
header, so a task can begin in the middle: it looks for the first whole block in
its range, inflates from there, and reads the records that begin in its blocks,
the last one to its end.  Gzip files without such headers are one range.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .records import normalised

RANGE = 32 << 20  # bytes of a file for one task
_MOST = 1 << 16  # bytes of a block
_CHUNK = 1 << 20  # bytes of plain text read at once
_END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")  # the empty block that closes a file (fixed by the format)
SCHEMA = "path string, offset long, seq_id string, seq string"


def block(data: bytes) -> bytes:
    """One block of at most 65280 bytes of data."""
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    head = b"\x1f\x8b\x08\x04" + b"\0" * 5 + b"\xff" + struct.pack("<HBBHH", 6, 66, 67, 2, len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data))


def pack_blocks(data: bytes) -> bytes:
    return b"".join(block(data[k : k + 65280]) for k in range(0, len(data), 65280)) + _END


def _size(head: bytes) -> int | None:
    """The length of the block that begins here, if one does."""
    if len(head) < 18 or head[:4] != b"\x1f\x8b\x08\x04" or head[12:16] != b"BC\x02\x00":
        return None
    return struct.unpack("<H", head[16:18])[0] + 1


def _inflated(data: bytes, at: int, size: int) -> bytes | None:
    try:
        out = zlib.decompress(data[at + 18 : at + size - 8], -15)
    except zlib.error:
        return None
    return out if struct.unpack("<I", data[at + size - 8 : at + size - 4])[0] == zlib.crc32(out) else None


def _blocks(file, start: int, length: int) -> Iterator[tuple[int, bytes]]:
    """``(offset, data)`` of the blocks from the first that begins at ``start`` or later."""
    at, held, base = 0, b"", start
    file.seek(start)
    synced = start == 0
    while True:
        if len(held) - at < 2 * _MOST and base + len(held) < length:
            held, base, at = held[at:] + file.read(_CHUNK), base + at, 0
        if at >= len(held):
            return
        if not synced:
            at = held.find(b"\x1f\x8b\x08\x04", at)
            if at < 0:
                return
        size = _size(held[at : at + 18])
        data = _inflated(held, at, size) if size and at + size <= len(held) else None
        if data is None:
            if synced:
                raise ValueError(f"no block at byte {base + at}")
            at += 1
            continue
        synced = True
        yield base + at, data
        at += size


def _plain(file, start: int, length: int) -> Iterator[tuple[int, bytes]]:
    file.seek(start)
    while start < length:
        data = file.read(_CHUNK)
        yield start, data
        start += len(data)


def _whole(file) -> Iterator[tuple[int, bytes]]:
    inflate = zlib.decompressobj(31)
    while data := file.read(_CHUNK):
        while data:
            yield 0, inflate.decompress(data)
            data = inflate.unused_data
            if inflate.eof:
                inflate = zlib.decompressobj(31)


def _lines(parts: Iterator[tuple[int, bytes]]) -> Iterator[tuple[int, bytes]]:
    """Lines with the offset of the part in which each begins; what stands before the first line end may be half a line."""
    held, begun = b"", None
    for offset, data in parts:
        pieces = data.split(b"\n")
        if begun is None:
            begun = offset
        for piece in pieces[:-1]:
            line, held = held + piece, b""
            yield begun, line
            begun = offset
        if not held and len(pieces) > 1:
            begun = offset
        if not held and not pieces[-1]:
            begun = None  # the next line begins with the next part
        held += pieces[-1]
    if held:
        yield begun if begun is not None else 0, held


class RangeReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.paths, self.range = options["path"].split("\n"), int(options.get("range", RANGE))
        self.normal = options.get("normal", "false") == "true"

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        out = []
        for uri in self.paths:
            system, path = fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")
            found = system.get_file_info(path)
            files = [found] if found.is_file else [i for i in system.get_file_info(fs.FileSelector(path, recursive=True)) if i.is_file and not i.base_name.startswith(("_", "."))]
            for info in files:
                with system.open_input_file(info.path) as file:
                    head = file.read(1 << 12)
                kind = "blocks" if _size(head) else "whole" if head[:2] == b"\x1f\x8b" else "plain"
                # a quality line may begin with either sign: the file's first one tells its kind
                first = (head if kind == "plain" else zlib.decompressobj(31).decompress(head)).lstrip()[:1]
                step = info.size if kind == "whole" else self.range
                out += [InputPartition((uri, info.path, kind, first == b"@", a, min(a + step, info.size), info.size)) for a in range(0, info.size, max(1, step))]
        return out

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        if partition is None:  # no file has anything
            return
        uri, path, kind, fastq, start, end, length = partition.value
        system, _ = fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")
        rows: list[tuple] = []
        with system.open_input_file(path) as file:
            # from before the range, so that it is known whether the range begins with a line
            first = max(0, start - 2 * _MOST) if kind == "blocks" else max(0, start - 1)
            parts = _whole(file) if kind == "whole" else _blocks(file, first, length) if kind == "blocks" else _plain(file, first, length)
            if kind == "plain":
                parts = _cut(parts)
            for offset, seq_id, seq in _records(_lines(parts), start, end if kind != "whole" else length + 1, first == 0, fastq):
                rows.append((path, offset, seq_id, seq))
                if len(rows) >= 1000:
                    yield _batch(rows, self.normal)
                    rows = []
        if rows:
            yield _batch(rows, self.normal)


def _cut(parts: Iterator[tuple[int, bytes]]) -> Iterator[tuple[int, bytes]]:
    """Plain text a line at a time, so that a line's offset is its own."""
    held, at = b"", None
    for offset, data in parts:
        at = offset if at is None else at
        held += data
        *whole, held = held.split(b"\n")
        for line in whole:
            yield at, line + b"\n"
            at += len(line) + 1
    if held:
        yield at, held


def _batch(rows: list[tuple], normal: bool) -> pa.RecordBatch:
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string()), normalised(columns[3]) if normal else pa.array(columns[3], pa.string())], names=["path", "offset", "seq_id", "seq"])


def _records(lines: Iterator[tuple[int, bytes]], start: int, end: int, whole_line: bool, fastq: bool) -> Iterator[tuple[int, str, str]]:
    """Records that begin in ``start`` to ``end``: a line ``>`` and what follows, or ``@`` with a ``+`` two lines on."""
    text = lambda b: b.decode("utf-8", "replace").rstrip("\r")
    if not whole_line:
        next(lines, None)  # perhaps half a line
    if fastq:
        # a quality line may begin with @, but no + stands two lines after it
        window: list[tuple[int, bytes]] = []
        for line in lines:
            window.append(line)
            if len(window) < 3:
                continue
            offset, head = window[0]
            if head.startswith(b"@") and window[2][1].startswith(b"+"):
                if offset >= end:
                    return
                if offset >= start:
                    yield offset, text(head)[1:], text(window[1][1])
                window = []
                next(lines, None)  # its qualities
            else:
                window.pop(0)
        return
    held: tuple[int, str, list[bytes]] | None = None
    for offset, line in lines:
        if line.startswith(b">"):
            if held:
                yield held[0], held[1], text(b"".join(held[2]))
                held = None
            if offset >= end:
                return
            if offset >= start:
                held = offset, text(line).lstrip(">").strip(), []
        elif held:
            held[2].append(line.strip())
    if held:
        yield held[0], held[1], text(b"".join(held[2]))


class RecordSource(DataSource):
    """``spark.read.format("sequence_records").load(path)``; with the option ``normal`` the sequences are normalised where they are read."""

    @classmethod
    def name(cls) -> str:
        return "sequence_records"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RangeReader:
        return RangeReader(self.options)


def read_records(spark: SparkSession, path: str | list[str], range_bytes: int = RANGE) -> DataFrame:
    """``path, ord, seq_id, seq`` of FASTA or FASTQ files, as the whole-file readers give, by ranges of bytes.

    ``ord`` grows with the place in a file only between blocks; a folder's files are read
    each.  Empty files have no rows.  A sequence is held whole by its task.
    """
    spark.dataSource.register(RecordSource)
    paths = [path] if isinstance(path, str) else path
    rows = spark.read.format("sequence_records").option("range", str(range_bytes)).option("normal", "true").load("\n".join(paths))
    return rows.select("path", F.col("offset").alias("ord"), "seq_id", "seq")


def write_block_fasta(seqs: DataFrame, path: str) -> None:
    """A folder of block-gzip FASTA files, one per task; names are those of attempts that ended, listed in ``_files``.

    Sequences without an id or text are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs

        system, folder = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
        system.create_dir(folder, recursive=True)
        name, held, rows = f"part-{uuid.uuid4().hex}.fa.gz", b"", 0
        with system.open_output_stream(f"{folder}/{name}", compression=None) as out:
            for batch in batches:
                for seq_id, seq in zip(*(c.to_pylist() for c in batch.columns)):
                    held += f">{seq_id}\n{seq}\n".encode()
                    rows += 1
                    full = len(held) - len(held) % 65280
                    for k in range(0, full, 65280):
                        out.write(block(held[k : k + 65280]))
                    held = held[full:]
            out.write(pack_blocks(held))
        yield pa.RecordBatch.from_pydict({"name": [name], "n": [rows]})

    rows = seqs.where("seq_id is not null and seq is not null").select(F.col("seq_id").cast("string"), "seq")
    rows.mapInArrow(run, "name string, n long").write.parquet(f"{path}/_files")


def read_block_fasta(spark: SparkSession, path: str, range_bytes: int = RANGE) -> DataFrame:
    """The records of the files whose tasks ended."""
    names = [r.name for r in spark.read.parquet(f"{path}/_files").where("n > 0").collect()]  # one per task, not data
    if not names:
        return spark.createDataFrame([], "path string, ord long, seq_id string, seq string")
    return read_records(spark, [f"{path}/{name}" for name in names], range_bytes)
