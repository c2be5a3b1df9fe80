"""Token-id shards as wavelet matrices: one compressed file answers access, count and occurrence queries.

A shard file holds blocks of whole documents.  Of each block the ids stand as a
wavelet matrix: one bit-plane per bit of the id, the most significant first, each
plane stably partitioned by the one before.  Planes are packed bits, compressed
one by one; rank is a sampled count plus a popcount, select a search over ranks.
"""

from __future__ import annotations

import json
import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .encoding import encoder, slices
from .shared import attempt_name, filesystem, fresh, shuffle_width, trimmed

MAGIC = b"WVLT0001"
SAMPLE = 512  # bits between rank samples
_POP = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)


class WaveletMatrix:
    """Access, rank, select and whole decoding over a sequence of ids below ``2 ** bits``."""

    def __init__(self, n: int, planes: list[np.ndarray], zeros: list[int]) -> None:
        self.n, self.planes, self.zeros = n, planes, zeros
        self._samples: list[np.ndarray] | None = None

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> "WaveletMatrix":
        planes, zeros, cur = [], [], np.ascontiguousarray(ids)
        for bit in range(bits - 1, -1, -1):
            ones = (cur & cur.dtype.type(1 << bit)) != 0
            planes.append(np.packbits(ones))
            low = cur.compress(~ones)
            zeros.append(len(low))
            cur = np.concatenate([low, cur.compress(ones)])
        return cls(len(ids), planes, zeros)

    def decode(self) -> np.ndarray:
        """All ids in order, rebuilt from the last plane upwards without random access."""
        kind = np.uint16 if len(self.planes) <= 16 else np.uint32
        cur = np.zeros(self.n, dtype=kind)
        for level in range(len(self.planes) - 1, -1, -1):
            ones = np.unpackbits(self.planes[level], count=self.n).view(bool)
            bit, z, up = kind(1 << (len(self.planes) - 1 - level)), self.zeros[level], np.empty(self.n, dtype=kind)
            up[np.flatnonzero(~ones)] = cur[:z]
            up[np.flatnonzero(ones)] = cur[z:] | bit
            cur = up
        return cur

    def _ranks(self) -> list[np.ndarray]:
        if self._samples is None:
            step, out = SAMPLE // 8, []
            for p in self.planes:
                whole = np.concatenate([p, np.zeros(-len(p) % step, dtype=np.uint8)])
                out.append(np.concatenate([[0], np.cumsum(_POP[whole].reshape(-1, step).sum(1, dtype=np.int64))]))
            self._samples = out
        return self._samples

    def _rank1(self, level: int, i: int) -> int:
        """Ones among the first ``i`` bits of a plane."""
        block, plane = i // SAMPLE, self.planes[level]
        at = block * SAMPLE // 8
        count = int(self._ranks()[level][block]) + int(_POP[plane[at : i // 8]].sum())
        return count + (bin(plane[i // 8] >> (8 - i % 8)).count("1") if i % 8 else 0)

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level, z in enumerate(self.zeros):
            bit = self.planes[level][i // 8] >> (7 - i % 8) & 1
            value = value << 1 | int(bit)
            i = z + self._rank1(level, i) if bit else i - self._rank1(level, i)
        return value

    def rank(self, token: int, i: int) -> int:
        """Occurrences of ``token`` among the first ``i`` ids."""
        if token >> len(self.planes):
            return 0
        start, end = 0, min(i, self.n)
        for level, z in enumerate(self.zeros):
            a, b = self._rank1(level, start), self._rank1(level, end)
            if token >> (len(self.planes) - 1 - level) & 1:
                start, end = z + a, z + b
            else:
                start, end = start - a, end - b
        return end - start

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def _select_bit(self, level: int, bit: int, k: int) -> int:
        low, high = 0, self.n - 1
        while low < high:
            mid = (low + high) // 2
            ones = self._rank1(level, mid + 1)
            if (ones if bit else mid + 1 - ones) > k:
                high = mid
            else:
                low = mid + 1
        return low

    def select(self, token: int, k: int) -> int:
        """Position of the ``k``-th occurrence (from 0) of ``token``."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        start = 0
        for level, z in enumerate(self.zeros):
            a = self._rank1(level, start)
            start = z + a if token >> (len(self.planes) - 1 - level) & 1 else start - a
        at = start + k
        for level in range(len(self.zeros) - 1, -1, -1):
            z = self.zeros[level]
            bit = token >> (len(self.planes) - 1 - level) & 1
            at = self._select_bit(level, bit, at - z if bit else at)
        return at

    def occurrences(self, token: int) -> list[int]:
        """All positions of ``token``, ascending: its stretch of the last plane is taken up plane by plane."""
        n = self.count(token)
        if not n:
            return []
        start = 0
        for level, z in enumerate(self.zeros):
            a = self._rank1(level, start)
            start = z + a if token >> (len(self.planes) - 1 - level) & 1 else start - a
        at = np.arange(start, start + n)
        for level in range(len(self.zeros) - 1, -1, -1):
            bits = np.unpackbits(self.planes[level], count=self.n).view(bool)
            bit = token >> (len(self.planes) - 1 - level) & 1
            at = np.flatnonzero(bits)[at - self.zeros[level]] if bit else np.flatnonzero(~bits)[at]
        return at.tolist()

    def to_bytes(self) -> bytes:
        import zstandard

        pack = zstandard.ZstdCompressor(level=1)
        parts = [pack.compress(p.tobytes()) for p in self.planes]
        head = struct.pack("<QI", self.n, len(parts)) + b"".join(struct.pack("<QQ", z, len(p)) for z, p in zip(self.zeros, parts))
        return head + b"".join(parts)

    @classmethod
    def from_bytes(cls, raw: bytes) -> "WaveletMatrix":
        import zstandard

        n, levels = struct.unpack_from("<QI", raw)
        at, zeros, planes, unpack = 12 + 16 * levels, [], [], zstandard.ZstdDecompressor()
        for level in range(levels):
            z, size = struct.unpack_from("<QQ", raw, 12 + 16 * level)
            zeros.append(z)
            planes.append(np.frombuffer(unpack.decompress(raw[at : at + size], max_output_size=(n + 7) // 8 or 1), dtype=np.uint8))
            at += size
        return cls(n, planes, zeros)


class ShardWriter:
    """Appends documents to a shard file block by block; a block closes at ``block_ids``."""

    def __init__(self, sink, bits: int, block_ids: int = 1 << 18) -> None:
        self.sink, self.bits, self.block_ids = sink, bits, block_ids
        self.blocks, self.parts, self.docs, self.held, self.at = [], [], [], 0, len(MAGIC)
        sink.write(MAGIC)
        self.total = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.parts.append(ids)
        self.docs.append((doc_id, len(ids)))
        self.held += len(ids)
        if self.held >= self.block_ids:
            self.flush()

    def flush(self) -> None:
        if not self.docs:
            return
        raw = WaveletMatrix.build(np.concatenate(self.parts), self.bits).to_bytes()
        table = zlib.compress(json.dumps(self.docs).encode(), 1)
        self.sink.write(raw)
        self.sink.write(table)
        self.blocks.append((self.at, len(raw), len(table), self.total, len(self.docs)))
        self.at += len(raw) + len(table)
        self.total += self.held
        self.parts, self.docs, self.held = [], [], 0

    def close(self) -> int:
        self.flush()
        foot = json.dumps(self.blocks).encode()
        self.sink.write(foot + struct.pack("<Q", len(foot)) + MAGIC)
        self.sink.close()
        return self.total


class ShardReader:
    """Random access to the blocks of one shard file (an object with read, seek and size)."""

    def __init__(self, source) -> None:
        self.source = source
        source.seek(source.size() - 16)
        size, mark = struct.unpack("<Q8s", source.read(16))
        if mark != MAGIC:
            raise ValueError("not a shard file")
        source.seek(source.size() - 16 - size)
        self.blocks = json.loads(source.read(size))

    def block(self, k: int) -> tuple[WaveletMatrix, list[tuple[int | None, int]], int]:
        """The matrix of a block, its documents with their lengths, and the ids before it in the file."""
        at, raw, table, before, _ = self.blocks[k]
        self.source.seek(at)
        matrix = WaveletMatrix.from_bytes(self.source.read(raw))
        return matrix, json.loads(zlib.decompress(self.source.read(table))), before

    def count(self, token: int) -> int:
        return sum(self.block(k)[0].count(token) for k in range(len(self.blocks)))

    def access(self, place: int) -> int:
        """The id at a place of the whole shard; only its block is read."""
        k = bisect_right(self.blocks, place, key=lambda b: b[3]) - 1
        if k < 0:
            raise IndexError(place)
        matrix, _, before = self.block(k)
        return matrix.access(place - before)

    def occurrences(self, token: int) -> Iterator[int]:
        """The places of an id in the whole shard, ascending; one block is held at a time."""
        for k in range(len(self.blocks)):
            matrix, _, before = self.block(k)
            yield from (before + at for at in matrix.occurrences(token))


MANIFEST = "shard int, path string, n_docs long, n_ids long"


def write_shards(docs: DataFrame, tokenizer_path: str, end_id: int = 0, doc_id: str = "doc_id", text: str = "text", shards: int | None = None, label: str = "wavelet") -> DataFrame:
    """Encode whole texts, append ``end_id`` to each and write shards in ascending id order.

    Returns the committed manifest, one row per file; the ranges of ``doc_id`` of
    the shards follow each other.  Null text: only the end id.  Null ids come
    first; rows that repeat an id stand beside each other, ordered by text.  An
    empty table has an empty manifest.
    """
    spark = docs.sparkSession
    folder = fresh(spark, label)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, out, encode, n_docs = TaskContext.get().partitionId(), None, encoder(tokenizer_path), 0
        end = np.array([end_id], dtype=encode.dtype)
        bits = max(1, int(max(len(encode.opens) - 1, end_id)).bit_length())
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for a, b in slices(texts):
                for i, found in zip(ids[a:b], encode.encode_array(texts.slice(a, b - a))):
                    if out is None:
                        fs, at = filesystem(folder)
                        fs.create_dir(at, recursive=True)
                        name = attempt_name(f"shard-{part:06d}", ".wvlt")
                        out = ShardWriter(fs.open_output_stream(f"{at}/{name}"), bits)
                    out.add(i, np.concatenate([found, end]))
                    n_docs += 1
        if out is not None:
            yield pa.RecordBatch.from_pylist([{"shard": part, "path": f"{folder}/{name}", "n_docs": n_docs, "n_ids": out.close()}], schema=pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    dealt = rows.repartitionByRange(shards or shuffle_width(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    path = f"{folder}-manifest"
    dealt.mapInArrow(trimmed(write), MANIFEST).write.parquet(path)
    return spark.read.schema(MANIFEST).parquet(path)


def read_shards(manifest: DataFrame) -> DataFrame:
    """One row per document, read from the files: ``doc_id, start, n_tokens, ids_crc32``.

    ``start`` counts the ids of all documents before.  The manifest has one row
    per file, so its running sum is taken on the driver.
    """
    spark = manifest.sparkSession
    files, before = [], 0
    for row in sorted(manifest.collect(), key=lambda r: r.shard):
        files.append((row.path, before))
        before += row.n_ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fs, at = filesystem(path)
                with fs.open_input_file(at) as source:
                    reader = ShardReader(source)
                    for k in range(len(reader.blocks)):
                        matrix, docs, start = reader.block(k)
                        ids, at_id, out = matrix.decode().astype("<u4"), 0, ([], [], [], [])
                        for doc, n in docs:
                            for column, value in zip(out, (doc, base + start + at_id, n, zlib.crc32(memoryview(ids[at_id : at_id + n])))):
                                column.append(value)
                            at_id += n
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    listed = spark.createDataFrame(files, "path string, base long").repartition(max(1, len(files)))
    return listed.mapInArrow(trimmed(read), "doc_id long, start long, n_tokens long, ids_crc32 long")
