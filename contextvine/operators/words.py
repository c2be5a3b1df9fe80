"""Counting and searching substrings.

``seqs`` has ``seq_id`` and ``seq`` (symbols A, C, G, T and N).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.symbols import SYMBOLS

#: Symbols of a piece: a substring of UTF-8 text is found by walking from its start, so long texts are cut first.
PIECE = 128
BROADCAST_PATTERNS = 100_000
WORDS = 4_000_000  # words that a task counts


def symbols_of(seqs: DataFrame) -> Column:
    """How long each sequence is; a column ``length`` of the table says it without the sequence being made."""
    return (F.col("length") if "length" in seqs.columns else F.length("seq")).cast("long")


def pieces(seqs: DataFrame, overlap: int, size: int = PIECE, before: int = 0) -> DataFrame:
    """``seq_id, first, piece, lead, own``: sequences cut in pieces of ``size`` positions, ``own`` of them in a last piece.

    ``first`` is the 0-based position the piece is about; ``overlap`` symbols more
    stand after it, and up to ``before`` symbols before (``lead`` of them).  One
    pass of a pattern cuts a sequence, so a very long one costs no more than many
    short ones and spreads over many rows.
    """
    size = max(size, overlap, before)
    parts = F.when(F.length("seq") <= size, F.array("seq")).otherwise(F.regexp_extract_all("seq", F.lit(f"(?s).{{1,{size}}}"), F.lit(0)))
    none = F.lit("")
    whole = lambda p, i: F.struct(
        F.length(p).alias("own"), F.when(i > 0, F.right(F.get("parts", i - 1), F.lit(before))).otherwise(none).alias("head"),
        p.alias("body"), F.coalesce(F.left(F.get("parts", i + 1), F.lit(overlap)), none).alias("rest"),
    )
    cut = seqs.where(symbols_of(seqs) > 0).select("seq_id", parts.alias("parts")).select("seq_id", F.posexplode(F.transform("parts", whole)).alias("i", "p"))
    return cut.select("seq_id", (F.col("i").cast("long") * size).alias("first"), F.concat("p.head", "p.body", "p.rest").alias("piece"), F.length("p.head").alias("lead"), F.col("p.own").alias("own"))


def positions(seqs: DataFrame, order: int, size: int = PIECE) -> DataFrame:
    """``seq_id, pos, probe, symbol``: every position with the up to ``order`` symbols before it (0-based)."""
    cut = pieces(seqs, 0, size, before=order)
    at = cut.select("seq_id", "first", "piece", "lead", F.explode(F.sequence(F.col("lead") + 1, F.col("lead") + F.col("own"))).alias("i"))
    start = F.greatest(F.col("i") - order, F.lit(1))
    return at.select(
        "seq_id", (F.col("first") + F.col("i") - F.col("lead") - 1).alias("pos"),
        F.substring(F.col("piece"), start, F.col("i") - start).alias("probe"), F.substring(F.col("piece"), F.col("i"), F.lit(1)).alias("symbol"),
    )


def tail_counts(seqs: DataFrame, length: int) -> DataFrame:
    """``seq_id, tail, n``: from every position up to ``length`` symbols, cut before an N; counted before anything is expanded."""
    cut = pieces(seqs, length - 1).select("seq_id", "piece", F.explode(F.sequence(F.lit(1), F.col("own"))).alias("i"))
    tails = cut.select("seq_id", F.substring_index(F.substring(F.col("piece"), F.col("i"), F.lit(length)), "N", 1).alias("tail"))
    return tails.where("tail <> ''").groupBy("seq_id", "tail").agg(F.count("*").alias("n"))


def tail_counts_arrow(seqs: DataFrame, length: int, size: int = 1 << 20) -> DataFrame:
    """The same rows as ``tail_counts``, counted on number-coded symbols of whole pieces.

    A piece's tails are base-4 numbers from a few array operations, so no row per
    position is made; counts of distinct tails leave the task.  Tails have up to 31
    symbols.
    """
    if length > 31:
        return tail_counts(seqs, length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        code = np.full(256, 4, dtype=np.int64)
        code[[ord(s) for s in SYMBOLS]] = range(4)
        letters = np.frombuffer("".join(SYMBOLS).encode(), dtype=np.uint8)
        for batch in batches:
            for seq_id, piece, own in zip(*(c.to_pylist() for c in batch.columns)):
                symbols = code[np.frombuffer(piece.encode(), dtype=np.uint8)]
                n = len(symbols)
                stops = np.append(np.flatnonzero(symbols == 4), n)
                run_length = np.minimum(stops[np.searchsorted(stops, np.arange(own))] - np.arange(own), length)
                padded = np.append(symbols, np.zeros(length, dtype=np.int64))
                value, tails, counts = np.zeros(own, dtype=np.int64), [], []
                for k in range(1, length + 1):
                    value = value * 4 + padded[k - 1 : k - 1 + own]
                    here = value[run_length == k]
                    if not len(here):
                        continue
                    if k <= 9:
                        seen = np.bincount(here, minlength=1)
                        found = np.flatnonzero(seen)
                        seen = seen[found]
                    else:
                        found, seen = np.unique(here, return_counts=True)
                    digits = found[:, None] // 4 ** np.arange(k - 1, -1, -1) % 4
                    text = letters[digits].tobytes().decode()
                    tails += [text[i : i + k] for i in range(0, len(text), k)]
                    counts += seen.tolist()
                if tails:
                    yield pa.RecordBatch.from_arrays([pa.array([seq_id] * len(tails), pa.string()), pa.array(tails, pa.string()), pa.array(counts, pa.int64())], names=["seq_id", "tail", "n"])

    counted = pieces(seqs, length - 1, size).select(F.col("seq_id").cast("string"), "piece", "own").mapInArrow(run, "seq_id string, tail string, n long")
    if parts := _parts_of_short(seqs, length, size):
        # nothing to add up before: a sequence's tails go to one of as many tasks as the text asks for
        counted = counted.repartition(parts, "seq_id")
    return counted.groupBy("seq_id", "tail").agg(F.sum("n").alias("n"))


def _parts_of_short(seqs: DataFrame, length: int, size: int) -> int:
    """How many tasks share the words of sequences that are one piece each, so that none holds many; 0 if a sequence is several pieces."""
    n, ids, symbols, longest = seqs.agg(F.count("*"), F.approx_count_distinct("seq_id"), F.coalesce(F.sum(symbols_of(seqs)), F.lit(0)), F.coalesce(F.max(symbols_of(seqs)), F.lit(0))).head(1)[0]
    if longest > size or n > 1.2 * ids:
        return 0
    return max(int(seqs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(-(-symbols * length // WORDS), 10_000))


def word_counts(seqs: DataFrame, length: int, engine: str = "arrow") -> DataFrame:
    """``model_id, word, n`` for all words of A, C, G, T of 1 to ``length`` symbols.

    Only different tails are expanded to their prefixes, so the second shuffle
    carries counts of distinct words, not positions.  ``engine``: ``arrow`` counts
    coded pieces, ``sql`` a row per position; the rows are the same.
    """
    tails = {"arrow": tail_counts_arrow, "sql": tail_counts}[engine](seqs, length)
    prefixes = F.transform(F.sequence(F.lit(1), F.length("tail")), lambda k: F.left(F.col("tail"), k))
    return tails.select(F.col("seq_id").alias("model_id"), F.explode(prefixes).alias("word"), "n").groupBy("model_id", "word").agg(F.sum("n").alias("n"))


def find(text: Column, pattern: Column) -> Column:
    """Sorted 0-based starts of a pattern, overlapping ones too; the empty pattern is found at every place and the end."""
    n = F.length(text) - F.length(pattern)
    starts = F.when(n >= 0, F.sequence(F.lit(0), n)).otherwise(F.array().cast("array<int>"))
    return F.filter(starts, lambda i: F.substring(text, i + 1, F.length(pattern)) == pattern)


def search(seqs: DataFrame, patterns: DataFrame) -> DataFrame:
    """``seq_id, pattern, pos`` of every occurrence; ``patterns`` is a small table with ``pattern``.

    Patterns are grouped by length and met by equality on words of that length, so
    a set of patterns costs a hash lookup per position and length.
    """
    known = patterns.select("pattern").distinct()
    lengths = sorted(r[0] for r in known.select(F.length("pattern")).distinct().collect())
    if known.limit(BROADCAST_PATTERNS + 1).count() <= BROADCAST_PATTERNS:
        # short words are few and each stands at many places: dealt by word, a task would get them all
        known = F.broadcast(known)
    out = None
    for n in lengths:
        if n == 0:
            places = F.explode(F.sequence(F.lit(0).cast("long"), F.length("seq").cast("long"))).alias("pos")
            part = seqs.select("seq_id", F.lit("").alias("pattern"), places)
        else:
            cut = pieces(seqs, n - 1)
            inside = cut.select("seq_id", "first", "piece", F.explode(F.sequence(F.lit(1), F.col("own"))).alias("i"))
            words = inside.select("seq_id", F.substring(F.col("piece"), F.col("i"), F.lit(n)).alias("pattern"), (F.col("first") + F.col("i") - 1).alias("pos"))
            part = words.join(known.where(F.length("pattern") == n), "pattern").select("seq_id", "pattern", "pos")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return seqs.sparkSession.createDataFrame([], "seq_id string, pattern string, pos long")
    return out


def suffix_order(seq: str):
    """Starts of the suffixes in order (prefix doubling), and the symbols each shares with the one before."""
    import numpy as np

    n = len(seq)
    rank = np.unique(np.frombuffer(seq.encode("utf-32-le"), dtype="<u4"), return_inverse=True)[1].astype(np.int64)
    order, width = np.argsort(rank, kind="stable"), 1
    while n > 1 and rank.max() < n - 1:
        key = rank * (n + 1)
        key[: n - width] += rank[width:] + 1
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(np.diff(key[order], prepend=key[order[0]]) != 0)
        width *= 2
    starts, places = order.tolist(), np.argsort(order).tolist()
    shared, h = [0] * n, 0
    for i, p in enumerate(places):
        if p == 0:
            h = 0
            continue
        j = starts[p - 1]
        while i + h < n and j + h < n and seq[i + h] == seq[j + h]:
            h += 1
        shared[p] = h
        h = max(0, h - 1)
    return starts, shared


def suffix_nodes(seq: str) -> Iterator[tuple[int, int, int]]:
    """``(start, length, n)`` of the explicit nodes of a suffix tree but for the root: linear many, without their texts."""
    n = len(seq)
    starts, shared = suffix_order(seq) if n else ([], [])
    shared = [*shared, 0]
    stack: list[tuple[int, int]] = []  # open repeats: length and the place of their first suffix
    for p in range(n):
        if n - starts[p] > max(shared[p], shared[p + 1]):
            yield starts[p], n - starts[p], 1
        left, least = p, shared[p + 1]
        while stack and stack[-1][0] > least:
            length, left = stack.pop()
            yield starts[left], length, p + 1 - left
        if least and (not stack or stack[-1][0] < least):
            stack.append((least, left))


def _node_rows(seqs: DataFrame, texts: bool) -> DataFrame:
    """``seq_id, seq, nodes``: nodes in portions; where their texts are wanted a portion is worth carrying the sequence along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("n", pa.int64())]))
        for batch in batches:
            for seq_id, seq in zip(*(c.to_pylist() for c in batch.columns)):
                portion, size = [], 0
                for start, length, n in suffix_nodes(seq or ""):
                    portion.append({"start": start, "length": length, "n": n})
                    size += length
                    if len(portion) >= 1 << 16 or texts and size >= max(1 << 20, 4 * len(seq)):
                        yield pa.RecordBatch.from_arrays([pa.array([seq_id], pa.string()), pa.array([seq if texts else ""], pa.string()), pa.array([portion], kind)], names=["seq_id", "seq", "nodes"])
                        portion, size = [], 0
                if portion:
                    yield pa.RecordBatch.from_arrays([pa.array([seq_id], pa.string()), pa.array([seq if texts else ""], pa.string()), pa.array([portion], kind)], names=["seq_id", "seq", "nodes"])

    rows = seqs.select(F.col("seq_id").cast("string"), "seq").mapInArrow(run, "seq_id string, seq string, nodes array<struct<start: long, length: long, n: long>>")
    return rows.select(F.col("seq_id").cast(seqs.schema["seq_id"].dataType).alias("seq_id"), "seq", "nodes")


def substring_labels(seqs: DataFrame, most: int | None = None) -> DataFrame:
    """``seq_id, label, n``: the explicit nodes of a suffix tree as a relation.

    Substrings that different symbols (or the end) follow, with their counts, and
    every suffix that occurs once as a substring, the empty one too; the root is
    left out.  N counts as a symbol here.  With ``most``, labels of at most so many
    symbols.  Nodes come from a suffix array, a sequence per task; their texts, whose
    length grows with the square of the sequence's, are cut in other tasks.
    """
    at = _node_rows(seqs, True).repartition(int(seqs.sparkSession.conf.get("spark.sql.shuffle.partitions"))).select("seq_id", "seq", F.explode("nodes").alias("at"))
    if most is not None:
        at = at.where(F.col("at.length") <= most)
    label = F.substring(F.col("seq"), (F.col("at.start") + 1).cast("int"), F.col("at.length").cast("int"))
    return at.select("seq_id", label.alias("label"), F.col("at.n").alias("n")).unionByName(seqs.select("seq_id", F.lit("").alias("label"), F.lit(1).cast("long").alias("n")))


def height(seqs: DataFrame, most: int | None = None) -> DataFrame:
    """The length of the longest repeated substring of each sequence; with ``most``, of the longest explicit node up to it."""
    at = _node_rows(seqs, False).select("seq_id", F.explode("nodes").alias("at")).where("at.n > 1")
    if most is not None:
        at = at.where(F.col("at.length") <= most)
    return at.groupBy("seq_id").agg(F.max("at.length").alias("height"))
