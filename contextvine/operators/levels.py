"""Counting words level by level: only words that can still matter are extended.

A context with support has a prefix and a suffix with support.  So words grow from
the left in steps of a few symbols: a step counts the words whose beginning, known
from the step before, has support, and the loop ends when no beginning is left.
A row is a context with what follows it, so it stands for four words.  What dies out early is never written out to the full depth, sequences without a
beginning left are not read on, and no row per position leaves a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.symbols import SYMBOLS
from ..session import stored
from .words import pieces

#: Symbols a step adds; the first one starts from nothing.
STEP = 4
SIZE = 1 << 20  # symbols of a piece
PIECES = 16  # pieces of a sequence that meet a portion of its beginnings together
PORTION = 1_000_000  # beginnings of a sequence in one row
TOGETHER = 1 << 19  # symbols that are counted at once
FOLLOWERS = tuple(f"n_{s.lower()}" for s in SYMBOLS)
_SEEN = "seq_id string, k int, code long, " + ", ".join(f"{n} long" for n in FOLLOWERS)
_CODE = np.full(256, 4, dtype=np.uint8)
_CODE[[ord(s) for s in SYMBOLS]] = range(4)


def spell(code: Column, k: Column) -> Column:
    """The word of a base-4 number of ``k`` digits."""
    return F.translate(F.lpad(F.conv(code.cast("string"), 10, 4), k, "0"), "0123", "".join(SYMBOLS))


def _together(batch: pa.RecordBatch, stop: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``TOGETHER`` symbols, whose row numbers and words fit one number."""
    ends = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64))
    at, most = 0, 1 << min(20, 62 - 2 * stop)
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        end = min(max(int(np.searchsorted(ends, before + TOGETHER, "right")), at + 1), at + most)
        yield batch.slice(at, end - at)
        at = end


def _count(batches: Iterator[pa.RecordBatch], start: int, stop: int) -> Iterator[pa.RecordBatch]:
    """What follows each context of ``start`` to ``stop - 1`` symbols in each piece, of those that begin with one of ``codes``."""
    for batch in (part for whole in batches for part in _together(whole, stop)):
        ids, pieces, own = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy()
        # pieces with a stop after each, so that no word reaches over
        symbols = _CODE[np.frombuffer(("N".join(pieces) + "N" * (stop + 1)).encode("ascii", "replace"), dtype=np.uint8)]
        lengths = np.array([len(p) for p in pieces], dtype=np.int64)
        first = np.cumsum(lengths + 1) - lengths - 1
        row = np.repeat(np.arange(len(own), dtype=np.int64), own)
        at = np.arange(len(row)) - np.repeat(np.cumsum(own, dtype=np.int64) - own, own) + first[row]
        value = row  # the row's number, then a digit for each symbol
        found: list[tuple[int, np.ndarray, np.ndarray]] = []
        for k in range(stop):
            if k == start and start:
                kept = batch.column(3)
                codes = kept.flatten().to_numpy() + (np.repeat(np.arange(len(own), dtype=np.int64), pc.list_value_length(kept).to_numpy()) << 2 * k)
                alive = codes[np.minimum(np.searchsorted(codes, value), len(codes) - 1)] == value
                at, value = at[alive], value[alive]
            symbol = symbols[at + k]
            alive = symbol < 4
            at, value = at[alive], value[alive] * 4 + symbol[alive]
            if not len(value):
                break
            if k < start:
                continue
            if len(own) << 2 * (k + 1) <= 4 * len(value):
                seen = np.bincount(value)
                words = np.flatnonzero(seen)
                seen = seen[words]
            else:
                words, seen = np.unique(value, return_counts=True)
            contexts, place = words >> 2, np.zeros(len(words), dtype=np.int64)
            place[1:] = np.cumsum(contexts[1:] != contexts[:-1])
            n = np.zeros((place[-1] + 1, 4), dtype=np.int64)
            n[place, words & 3] = seen
            found.append((k, contexts[np.append(True, contexts[1:] != contexts[:-1])], n))
        if found:
            k = np.repeat(np.array([f[0] for f in found], dtype=np.int32), [len(f[1]) for f in found])
            rows = np.concatenate([contexts >> 2 * j for j, contexts, _ in found])
            code = np.concatenate([contexts & ((1 << 2 * j) - 1) for j, contexts, _ in found])
            n = np.concatenate([f[2] for f in found])
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), pa.array(k), pa.array(code), *(pa.array(n[:, i].copy()) for i in range(4))], names=["seq_id", "k", "code", *FOLLOWERS])


def words_of(rows: DataFrame, least: int = 1) -> DataFrame:
    """``seq_id, k, code, n``: the words that contexts and what follows them make, of at least ``least`` occurrences."""
    rows = rows.where(F.greatest(*FOLLOWERS) >= least)
    each = F.array(*(F.struct((F.col("k") + 1).alias("k"), (F.col("code") * 4 + i).alias("code"), F.col(n).alias("n")) for i, n in enumerate(FOLLOWERS)))
    return rows.select("seq_id", F.explode(F.filter(each, lambda w: w["n"] >= least)).alias("w")).select("seq_id", "w.k", "w.code", "w.n")


def level_followers(seqs: DataFrame, length: int, min_count: int, step: int = STEP, size: int = SIZE) -> DataFrame:
    """``seq_id, k, code, n_a..n_t``: what follows contexts of ``k`` symbols, 0 to ``length - 1``; ids are strings.

    The words they make are complete for every word whose beginning has support, see
    ``level_words``.
    """
    if length > 31:
        raise ValueError("words of more than 31 symbols don't fit a number")
    cut = pieces(seqs, length - 1, size).select(F.col("seq_id").cast("string"), "first", "piece", F.col("own").cast("int"))
    if length > step:  # read once more for every further step
        cut = stored(cut, "pieces")
    per_block = PIECES * max(size, length)
    cut = cut.withColumn("block", F.floor(F.col("first") / per_block))
    ends = cut.groupBy("seq_id").agg(F.max(F.col("first") + F.col("own")).alias("length"))
    parts, start = [], 0
    while start < length:
        stop = min(length, start + step)
        if start == 0:
            read = cut.select("seq_id", "piece", "own")
        else:
            # beginnings in portions; each portion meets the pieces of one block of the sequence
            alive = words_of(parts[-1].where(F.col("k") == start - 1), min_count).select("seq_id", "code")
            if not alive.head(1):
                break
            alive = alive.join(ends, "seq_id").withColumn("portion", F.pmod(F.xxhash64("code"), F.floor(F.col("length") / (min_count * PORTION)) + 1))
            held = alive.groupBy("seq_id", "length", "portion").agg(F.array_sort(F.collect_list("code")).alias("codes"))
            held = held.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / per_block))))
            read = cut.join(held.select("seq_id", "block", "codes"), ["seq_id", "block"]).select("seq_id", "piece", "own", "codes")
        counted = read.mapInArrow(lambda batches, a=start, b=stop: _count(batches, a, b), _SEEN)
        parts.append(stored(counted.groupBy("seq_id", "k", "code").agg(*(F.sum(n).alias(n) for n in FOLLOWERS)), "level"))
        start = stop
    out = None
    for part in parts:
        out = part if out is None else out.unionByName(part)
    return out


def level_words(seqs: DataFrame, length: int, min_count: int, step: int = STEP, size: int = SIZE) -> DataFrame:
    """``model_id, word, n``: words of 1 to ``length`` symbols, complete for every word whose beginning has support.

    A word is missing only if a word of ``min_count`` occurrences doesn't begin it;
    such a word is no context and follows none.  Words have up to 31 symbols.  An
    empty table, and sequences without a letter, have no words; rows that repeat an
    id are one sequence's pieces.
    """
    words = words_of(level_followers(seqs, length, min_count, step, size))
    return words.select(F.col("seq_id").cast(seqs.schema["seq_id"].dataType).alias("model_id"), spell(F.col("code"), F.col("k")).alias("word"), "n")
