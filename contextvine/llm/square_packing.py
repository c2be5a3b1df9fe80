"""Best-fit packing by sums of squares: few sequences, documents cut only where they are longer than one.

Open sequences are counted by the gap they have left.  A piece goes to the gap for
which the squares of these counts add up to least, so no gap becomes common and
later pieces of any length find a place; a sequence is opened only for a piece that
fits nowhere.  Pieces come longest first.  (Taken in any order, and with new
sequences competing with open ones, the same rule leaves some hundred sequences
open; see the README.)

Documents are encoded once, where they are read; full pieces are sequences of their
own.  What is left are rows of a few numbers, dealt evenly to cells of bounded size
that are packed on their own: a cell leaves about one sequence unfilled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encoding import encoder, slices
from .shared import materialise, trimmed

CELL_PIECES = 20_000
_PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, slot long"
SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
_NEVER = 1 << 40


class SquarePacker:
    """Places pieces of at most ``size`` tokens; ``place`` gives a sequence number and an offset for each."""

    def __init__(self, size: int) -> None:
        self.size = size
        self.counts = np.zeros(size + 1, dtype=np.int64)  # open sequences by gap
        self.open: list[list[int]] = [[] for _ in range(size + 1)]
        self.n = 0

    def best_gap(self, length: int) -> int | None:
        """The gap whose use makes the sum of squared counts smallest, ties to the smaller gap; None where nothing fits."""
        used, left = self.counts[length:], self.counts[: self.size + 1 - length]
        # one sequence fewer with this gap, one more with what the piece leaves of it; a closed one counts nowhere
        change = 2 - 2 * used + 2 * left
        change[0] -= 1
        change[used == 0] = _NEVER
        k = int(change.argmin())
        return None if change[k] == _NEVER else length + k

    def place(self, length: int) -> tuple[int, int]:
        gap = self.best_gap(length)
        if gap is None:
            gap, sequence = self.size, self.n
            self.n += 1
        else:
            sequence = self.open[gap].pop()
            self.counts[gap] -= 1
        if rest := gap - length:
            self.counts[rest] += 1
            self.open[rest].append(sequence)
        return sequence, self.size - gap

    def pack(self, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of every piece; the longest are placed first, equal ones in their order."""
        sequence, offset = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
        for k in np.argsort(-lengths, kind="stable").tolist():
            sequence[k], offset[k] = self.place(int(lengths[k]))
        return sequence, offset


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 0, size: int = 2048, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents as ids and an end id, cut where they are longer than ``size``: the first piece takes what is over.

    ``slot`` numbers the pieces of all documents; those of a repeated row differ in it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        slot, encode = TaskContext.get().partitionId() << 36, encoder(tokenizer_path)
        end = np.array([end_id], dtype=encode.dtype)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for a, b in slices(texts):
                columns: list[list] = [[] for _ in range(6)]
                for i, found in zip(ids[a:b], encode.encode_array(texts.slice(a, b - a))):
                    found = np.concatenate([found, end])
                    starts = [0, *range(len(found) % size or size, len(found), size)]
                    for k, (start, stop) in enumerate(zip(starts, [*starts[1:], len(found)])):
                        crc = zlib.crc32(found[start:stop].astype("<u4"))
                        for column, value in zip(columns, (i, k, start, stop - start, crc, slot)):
                            column.append(value)
                        slot += 1
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32", "slot"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(trimmed(run), _PIECES)


def square_pack(docs: DataFrame, tokenizer_path: str, end_id: int = 0, size: int = 2048, cell_pieces: int = CELL_PIECES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: its place in its document and in its sequence, and the crc32 of its ids.

    Null text is empty: one piece that holds the end id.  Repeated rows and rows
    without an id are packed each.  An empty table gives no rows.  Documents of at
    most ``size`` tokens stay whole; longer ones are cut into pieces of ``size``, the
    first of which may be shorter.  Sequences of whole pieces have negative numbers.
    """
    cut = materialise(pieces(docs, tokenizer_path, end_id, size, doc_id, text), "packing-pieces")
    n = cut.where(F.col("length") < size).count()
    cells = max(1, -(-n // cell_pieces))
    whole = cut.where(F.col("length") == size).select("doc_id", "piece", "start", F.col("length").cast("long"), "ids_crc32", (-1 - F.col("slot")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("slot")  # the same packing whenever the task is run again
        sequence, offset = SquarePacker(size).pack(table["length"].to_numpy())
        return pa.table({
            "doc_id": table["doc_id"], "piece": table["piece"], "start": table["start"], "length": table["length"].cast(pa.int64()), "ids_crc32": table["ids_crc32"],
            "sequence_id": pa.array((key[0].as_py() << 36) + sequence), "offset": pa.array(offset),
        })

    rest = cut.where(F.col("length") < size).withColumn("cell", F.pmod(F.xxhash64("slot"), F.lit(cells)))
    return whole.unionByName(rest.groupBy("cell").applyInArrow(run, SCHEMA))
