"""Exact duplicates through an extendible-hash index on shared files.

Keys are the leading bits of the SHA-256 of a text.  Tasks first merge copies
among the rows they read, so a text that a third of all rows hold reaches its
owner once per reading task.  An owner task holds a range of keys, in key order:
texts of one key are compared byte by byte and chained where they differ, and
each class becomes an entry of the range's extendible-hash index, whose directory
doubles when a bucket of full depth is overfull.  Directory, buckets and chained
texts are files in the shared folder; the table of classes is read back from them.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import attempt_name, filesystem, fresh, materialise, shuffle_width, trimmed

ENTRY = struct.Struct("<QIqqB")  # key, place in the chain, representative, size, whether it has a representative
MAGIC = b"EXTHASH1"


class ExtendibleIndex:
    """Buckets of entries by the leading bits of a 64-bit key below a range prefix.

    Entries of one key can't be split from each other: a bucket of one key alone
    may exceed its capacity (the chain), so splitting always ends.
    """

    def __init__(self, skip_bits: int = 0, capacity: int = 256) -> None:
        self.skip, self.capacity, self.depth = skip_bits, capacity, 0
        self.buckets: list[tuple[int, list[tuple]]] = [(0, [])]  # local depth, entries
        self.directory = [0]

    def _slot(self, key: int, depth: int) -> int:
        return (key << self.skip & 0xFFFFFFFFFFFFFFFF) >> (64 - depth) if depth else 0

    def insert(self, entry: tuple) -> None:
        """``entry`` begins with its key."""
        while True:
            b = self.directory[self._slot(entry[0], self.depth)]
            local, held = self.buckets[b]
            if len(held) < self.capacity or local >= 64 - self.skip or all(e[0] == entry[0] for e in held):
                held.append(entry)
                return
            if local == self.depth:
                self.directory = [x for x in self.directory for _ in range(2)]
                self.depth += 1
            self._split(b)

    def _split(self, b: int) -> None:
        local, held = self.buckets[b]
        halves = ([], [])
        for e in held:
            halves[self._slot(e[0], local + 1) & 1].append(e)
        new = len(self.buckets)
        self.buckets[b] = (local + 1, halves[0])
        self.buckets.append((local + 1, halves[1]))
        for slot, x in enumerate(self.directory):
            if x == b and slot >> (self.depth - local - 1) & 1:
                self.directory[slot] = new

    def lookup(self, key: int) -> list[tuple]:
        return [e for e in self.buckets[self.directory[self._slot(key, self.depth)]][1] if e[0] == key]

    def to_bytes(self) -> bytes:
        head = MAGIC + struct.pack("<BBIII", self.skip, self.depth, self.capacity, len(self.directory), len(self.buckets))
        parts = [head, struct.pack(f"<{len(self.directory)}I", *self.directory)]
        for local, held in self.buckets:
            parts.append(struct.pack("<BI", local, len(held)))
            parts += (ENTRY.pack(*e) for e in held)
        return b"".join(parts)

    @classmethod
    def from_bytes(cls, raw: bytes) -> "ExtendibleIndex":
        if raw[:8] != MAGIC:
            raise ValueError("not an index file")
        skip, depth, capacity, slots, buckets = struct.unpack_from("<BBIII", raw, 8)
        out, at = cls(skip, capacity), 22
        out.depth, out.directory, out.buckets = depth, list(struct.unpack_from(f"<{slots}I", raw, at)), []
        at += 4 * slots
        for _ in range(buckets):
            local, n = struct.unpack_from("<BI", raw, at)
            at += 5
            out.buckets.append((local, [ENTRY.unpack_from(raw, at + k * ENTRY.size) for k in range(n)]))
            at += n * ENTRY.size
        return out


class Classes:
    """Byte-compares the texts of one key; each different text is a link of the chain."""

    def __init__(self) -> None:
        self.key, self.chain = None, []

    def add(self, text: bytes, top: int | None, size: int) -> None:
        for link in self.chain:
            if link[0] == text:
                link[1] = max((x for x in (link[1], top) if x is not None), default=None)
                link[2] += size
                return
        self.chain.append([text, top, size])


INDEX = "owner int, path string, classes long, chained long"
_INDEX_ARROW = pa.schema([("owner", pa.int32()), ("path", pa.string()), ("classes", pa.int64()), ("chained", pa.int64())])


def _keyed(docs: DataFrame, doc_id: str, text: str, key_bits: int) -> DataFrame:
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), body.alias("text"), F.sha2(body.cast("binary"), 256).alias("text_sha256"))
    # the leading bits of the digest, as an unsigned number below 2 ** key_bits kept in a long
    key = F.shiftrightunsigned(F.conv(F.substring("text_sha256", 1, 16), 16, -10).cast("long"), 64 - key_bits)
    return rows.withColumn("key", key)


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", key_bits: int = 63, owner_bits: int | None = None, capacity: int = 256, combine_bytes: int = 32_000_000) -> DataFrame:
    """Write the index of all texts; the committed manifest has a row per key range that has rows."""
    spark = docs.sparkSession
    folder = fresh(spark, "exact-index")
    if owner_bits is None:  # several ranges for each task that owns some
        owner_bits = max(12, (8 * shuffle_width(spark) - 1).bit_length())
    owner_bits = min(owner_bits, key_bits)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Copies among the rows of this task become one row; at most ``combine_bytes`` of texts are held."""
        held: dict[str, list] = {}
        weight = 0

        def rows() -> pa.RecordBatch:
            keys, tops, sizes = zip(*held.values())
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(list(held), pa.string()), pa.array(tops, pa.int64()), pa.array(sizes, pa.int64())], names=["key", "text", "top", "size"])

        for batch in batches:
            for i, body, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if (found := held.get(body)) is None:
                    held[body] = [key, i, 1]
                    weight += len(body) + 100
                    if weight >= combine_bytes:
                        yield rows()
                        held, weight = {}, 0
                else:
                    found[1] = i if found[1] is None else found[1] if i is None else max(found[1], i)
                    found[2] += 1
        if held:
            yield rows()

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in the order of their keys: one key's chain and one range's index are held."""
        owner, index, current, chains = None, None, Classes(), []
        names = _INDEX_ARROW

        def end_key() -> None:
            for place, (body, top, size) in enumerate(current.chain):
                index.insert((current.key, place, top or 0, size, top is not None))
                if len(current.chain) > 1:
                    chains.append((current.key, place, body))

        def end_owner() -> pa.RecordBatch:
            end_key()
            fs, at = filesystem(folder)
            fs.create_dir(at, recursive=True)
            name = attempt_name(f"range-{owner:05d}", ".xhi")
            with fs.open_output_stream(f"{at}/{name}") as out:
                raw = index.to_bytes()
                out.write(struct.pack("<Q", len(raw)) + raw)
                for key, place, body in chains:
                    out.write(struct.pack("<QII", key, place, len(body)) + body)
            n = sum(len(b[1]) for b in index.buckets)
            return pa.RecordBatch.from_pylist([{"owner": owner, "path": f"{folder}/{name}", "classes": n, "chained": len(chains)}], schema=names)

        for batch in batches:
            for key, body, top, size in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if (at := key >> (key_bits - owner_bits)) != owner:
                    if owner is not None:
                        yield end_owner()
                    owner, index, current, chains = at, ExtendibleIndex(64 - key_bits + owner_bits, capacity), Classes(), []
                    current.key = key
                if key != current.key:
                    end_key()
                    current = Classes()
                    current.key = key
                current.add(body, top, size)
        if owner is not None:
            yield end_owner()

    merged = _keyed(docs, doc_id, text, key_bits).select("doc_id", "text", "key").mapInArrow(trimmed(merge), "key long, text string, top long, size long")
    dealt = merged.repartition(shuffle_width(spark), F.shiftright("key", key_bits - owner_bits)).sortWithinPartitions("key")
    return materialise(dealt.mapInArrow(trimmed(own), INDEX), "exact-manifest")


def read_classes(manifest: DataFrame) -> DataFrame:
    """The classes in the index files: ``key, place, top, size, text``; text (binary) only where texts share a key."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, at = filesystem(path)
                with fs.open_input_stream(at) as source:
                    index = ExtendibleIndex.from_bytes(source.read(struct.unpack("<Q", source.read(8))[0]))
                    chains = {}
                    while head := source.read(16):
                        key, place, n = struct.unpack("<QII", head)
                        chains[key, place] = source.read(n)
                entries = [e for _, held in index.buckets for e in held]
                columns = [pa.array([e[0] for e in entries], pa.int64()), pa.array([e[1] for e in entries], pa.int32()), pa.array([e[2] if e[4] else None for e in entries], pa.int64()), pa.array([e[3] for e in entries], pa.int64()), pa.array([chains.get(e[:2]) for e in entries], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "place", "top", "size", "text"])

    return manifest.select("path").mapInArrow(trimmed(read), "key long, place int, top long, size long, text binary")


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", key_bits: int = 63, **options) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Null text is empty.  Of equal texts the largest id stays; a null id never
    does, and a group of null ids alone has no ``keep_id``.  Rows that repeat an
    id and its text are kept or dropped together.  An empty table gives no rows.
    """
    manifest = build_index(docs, doc_id, text, key_bits, **options)
    classes = read_classes(manifest)
    rows = _keyed(docs, doc_id, text, key_bits)
    result = ["doc_id", F.col("top").alias("keep_id"), F.col("size").alias("group_size"), F.coalesce(F.col("doc_id") == F.col("top"), F.lit(False)).alias("kept"), "text_sha256"]
    if not manifest.where("chained > 0").head(1):
        return rows.drop("text").join(classes.drop("text").hint("merge"), "key").select(*result)
    alone, chained = classes.where("text is null").drop("text"), classes.where("text is not null")
    first = rows.drop("text").join(alone.hint("merge"), "key").select(*result)
    second = rows.withColumn("text", F.col("text").cast("binary")).join(chained.hint("merge"), ["key", "text"]).select(*result)
    return first.unionByName(second)
