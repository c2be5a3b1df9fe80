"""Hierarchical packing of documents into training sequences of several lengths.

Documents are routed to context-size tiers.  Whole windows of the longest tier
are cut off first; what remains goes to the smallest tier that holds it.  Each
tier is packed on its own, gaps of long windows are filled from shorter tiers
(best fit, the last filler cut to close the gap), and what is left at a task's
end is cut at powers of two, so nothing is padded.  Sequences are dealt to step
groups of an equal number of positions.

Every task packs what it reads: packing needs no shuffle, and memory holds one
bounded buffer of documents.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encoding import encoder, slices
from .shared import trimmed

TIERS = (256, 512, 1024)
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"

Fragment = tuple[int, int, int]  # length, document, start


class TierPacker:
    """Packs fragments of documents; ``pack`` returns sequences as lists of fragments."""

    def __init__(self, tiers: tuple[int, ...] = TIERS) -> None:
        self.tiers = tuple(sorted(tiers))
        if any(t & (t - 1) for t in self.tiers):
            raise ValueError("tiers are powers of two")

    def route(self, doc: int, length: int) -> tuple[list[Fragment], Fragment | None, int]:
        """Whole longest windows of a document, the rest, and the rest's tier."""
        top = self.tiers[-1]
        whole = [(top, doc, at) for at in range(0, length - length % top, top)]
        rest = length % top
        return whole, (rest, doc, length - rest) if rest else None, next(k for k, t in enumerate(self.tiers) if rest <= t)

    def pack(self, lengths: list[int]) -> list[list[Fragment]]:
        """Sequences whose lengths are powers of two; every id of every document is in one fragment."""
        out: list[list[Fragment]] = []
        pools: list[list[Fragment]] = [[] for _ in self.tiers]
        for doc, n in enumerate(lengths):
            whole, rest, tier = self.route(doc, n)
            out += [[w] for w in whole]
            if rest:
                pools[tier].append(rest)
        for pool in pools:
            pool.sort()
        left: list[Fragment] = []
        for tier in range(len(self.tiers) - 1, -1, -1):
            size = self.tiers[tier]
            while pools[tier]:
                window, gap = [pools[tier].pop()], size
                gap -= window[0][0]
                while gap:
                    found = self._fill(pools[: tier + 1], gap)
                    if found is None:
                        break
                    window.append(found)
                    gap -= found[0]
                if gap:
                    left += window
                else:
                    out.append(window)
        return out + self._close(left)

    @staticmethod
    def _fill(pools: list[list[Fragment]], gap: int) -> Fragment | None:
        """The longest fragment that fits, from the longest tier that has one; else a piece cut off the shortest fragment."""
        for pool in reversed(pools):
            k = bisect_right(pool, (gap, 1 << 62, 0))
            if k:
                return pool.pop(k - 1)
        for pool in pools:
            if pool:
                n, doc, at = pool.pop(0)
                insort(pool, (n - gap, doc, at + gap))
                return gap, doc, at
        return None

    def _close(self, left: list[Fragment]) -> list[list[Fragment]]:
        """Fragments that no window took, cut into the longest windows and then at powers of two."""
        total, out, k, used = sum(f[0] for f in left), [], 0, 0
        while total:
            size = min(self.tiers[-1], 1 << (total.bit_length() - 1))
            total -= size
            window = []
            while size:
                n, doc, at = left[k]
                take = min(size, n - used)
                window.append((take, doc, at + used))
                used, size = used + take, size - take
                if used == n:
                    k, used = k + 1, 0
            out.append(window)
        return out


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 0, tiers: tuple[int, ...] = TIERS, step_tokens: int = 8192, buffer_tokens: int = 2_000_000, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: its place in its document and in its sequence, and the crc32 of its ids.

    Null text is empty: one piece that holds the end id.  Repeated rows are packed
    each.  An empty table gives no rows.  ``sequence_id`` holds the task in its
    upper bits; sequences of a step group together hold ``step_tokens`` positions
    but for the last group of a buffer.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encode, packer, sequence, group = encoder(tokenizer_path), TierPacker(tiers), part << 40, part << 40
        end = np.array([end_id], dtype=encode.dtype)

        def flush(ids: list, found: list[np.ndarray]) -> pa.RecordBatch:
            nonlocal sequence, group
            windows = sorted(packer.pack([len(x) for x in found]), key=lambda w: -sum(f[0] for f in w))
            columns: list[list] = [[] for _ in range(9)]
            filled = 0
            for window in windows:
                size, at = sum(f[0] for f in window), 0
                if filled + size > step_tokens:
                    group, filled = group + 1, 0
                filled += size
                for n, doc, start in window:
                    crc = zlib.crc32(found[doc][start : start + n].astype("<u4"))
                    for column, value in zip(columns, (ids[doc], start, n, crc, len(found[doc]), sequence, at, size, group)):
                        column.append(value)
                    at += n
                sequence += 1
            group += 1
            kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64()]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        held_ids, held, total = [], [], 0
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for a, b in slices(texts):
                for i, found in zip(ids[a:b], encode.encode_array(texts.slice(a, b - a))):
                    held_ids.append(i)
                    held.append(np.concatenate([found, end]))
                    total += len(found) + 1
                    if total >= buffer_tokens:
                        yield flush(held_ids, held)
                        held_ids, held, total = [], [], 0
        if held:
            yield flush(held_ids, held)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(trimmed(run), SCHEMA)
