"""Suffix arrays of sequences of any length, with common prefixes, suffix tree nodes and their links.

Suffixes are ranked by prefix doubling: first by their first 24 symbols as a number,
then by the pair of their rank and the rank of what begins where they are known to.
Every round is a join by position and running sums over range-partitioned counts of
pairs, so a sequence spreads over all tasks, and suffixes that are alone in
their rank take no part any more.  The ranks of each round name substrings of
its width, which answers later whether two substrings are equal without their texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .words import pieces

LETTERS = "ACGNT"  # in the order of texts; a digit of a number each, from 1
WIDTH = 24  # digits to base 6 that 63 bits hold
SHORT = 8  # nodes of fewer symbols come from counting words


def _power(digits: Column | int) -> Column:
    """6 to a power, exact (a floating-point power is not)."""
    if isinstance(digits, int):
        return F.lit(6**digits)
    return F.get(F.array(*(F.lit(6**k) for k in range(WIDTH + 1))), digits)


def number(text: Column) -> Column:
    """A text of at most 24 letters as a number that sorts as the text does; what lies beyond its end is 0."""
    return F.conv(F.rpad(F.translate(text, LETTERS, "12345"), WIDTH, "0"), 6, 10).cast("long")


def codes(seqs: DataFrame) -> DataFrame:
    """``seq_id, pos, code``: the number of the 24 symbols from every position on."""
    # a long sequence is one row: its pieces are dealt out before they become rows per position
    width = int(seqs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = pieces(seqs, WIDTH - 1, 1024).repartition(width, "seq_id", "first")
    cut = dealt.select("seq_id", "first", "piece", F.explode(F.sequence(F.lit(1), F.col("own"))).alias("i"))
    return cut.select("seq_id", (F.col("first") + F.col("i") - 1).alias("pos"), number(F.substring(F.col("piece"), F.col("i"), F.lit(WIDTH))).alias("code"))


def running(groups: DataFrame, order: list[str]) -> DataFrame:
    """``groups`` (with a count ``n``) and ``before``: the counts of all groups that come before, without a window over all.

    Groups are range-partitioned and written; the driver adds up one number per partition.
    """
    spark = groups.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = stored(groups.repartitionByRange(width, *order).withColumn("part", F.spark_partition_id()), "ordered")
    totals, at = [], 0
    for part, n in sorted(placed.groupBy("part").agg(F.sum("n")).collect()):
        totals.append((part, at))
        at += n
    offsets = spark.createDataFrame(totals, "part int, offset long")
    within = F.sum("n").over(Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    return placed.join(F.broadcast(offsets), "part").withColumn("before", within + F.col("offset")).drop("part", "offset")


@dataclass(frozen=True)
class SuffixArray:
    """``table``: ``seq_id, place, pos, lcp, code``; ``names``: for each width ``seq_id, pos, rank``, equal where substrings of the width are."""

    table: DataFrame
    names: list[tuple[int, DataFrame]] = field(default_factory=list)


def _ranked(seqs: DataFrame) -> tuple[DataFrame, list[tuple[int, DataFrame]]]:
    at = stored(codes(seqs), "codes")
    first = running(at.groupBy("seq_id", "code").agg(F.count("*").alias("n")), ["seq_id", "code"])
    first = at.join(first, ["seq_id", "code"]).select("seq_id", "pos", "code", F.col("before").alias("rank"), F.col("n").alias("size"))
    # suffixes that are alone are written once; what is left shrinks, and small tables are broadcast by their size
    settled, fresh = [], stored(first, "ranks")
    names, width = [], WIDTH
    while True:
        settled, open_ = [*settled, fresh.where("size = 1")], fresh.where("size > 1")
        ranks = reduce(DataFrame.unionByName, [*settled, open_])
        names.append((width, ranks.select("seq_id", "pos", "rank")))
        if not open_.head(1):
            return ranks, names
        open_ = stored(open_, "open")
        after = ranks.select("seq_id", (F.col("pos") - width).alias("pos"), F.col("rank").alias("next"))
        # what ends before its next part comes first
        met = after.join(open_.select("seq_id", "pos"), ["seq_id", "pos"])
        keyed = stored(open_.join(met, ["seq_id", "pos"], "left").withColumn("next", F.coalesce("next", F.lit(-1))), "pairs")
        ordered = stored(running(keyed.groupBy("rank", "next").agg(F.count("*").alias("n")), ["rank", "next"]), "order")
        least = ordered.groupBy("rank").agg(F.min("before").alias("base"))
        new = ordered.join(least, "rank").select("rank", "next", (F.col("rank") + F.col("before") - F.col("base")).alias("new_rank"), F.col("n").alias("new_size"))
        split = keyed.join(new, ["rank", "next"]).select("seq_id", "pos", "code", F.col("new_rank").alias("rank"), F.col("new_size").alias("size"))
        fresh = stored(split, "ranks")
        width *= 2


def _first(code: Column, k: int | Column) -> Column:
    """The first ``k`` digits of a number, the others 0."""
    return code - F.pmod(code, _power(WIDTH - k if isinstance(k, int) else F.lit(WIDTH) - k))


def _common(a: Column, b: Column) -> Column:
    """How many digits two different numbers share from the left."""
    out = F.lit(0)
    for k in range(1, WIDTH):
        out = F.when(_first(a, k) == _first(b, k), F.lit(k)).otherwise(out)
    return out


def suffix_array(seqs: DataFrame) -> SuffixArray:
    """The order of the suffixes of each sequence, and how many symbols each shares with the one before.

    The empty suffix is left out; N is a symbol.  Places count from 0 within a
    sequence; the first suffix shares 0.  Empty and null sequences have no rows.  Ids
    are unique: rows that repeat one are one sequence only if they are equal, else the
    result is not defined.
    """
    ranks, names = _ranked(seqs.dropDuplicates(["seq_id"]).select("seq_id", "seq"))
    base = ranks.groupBy("seq_id").agg(F.min("rank").alias("base"))
    before = ranks.select("seq_id", (F.col("rank") + 1).alias("rank"), F.col("pos").alias("a"), F.col("code").alias("code_a"))
    rows = ranks.join(before, ["seq_id", "rank"], "left").join(base, "seq_id")
    rows = stored(rows.select("seq_id", (F.col("rank") - F.col("base")).alias("place"), "pos", "code", "a", "code_a"), "neighbours")
    alike = F.col("code") == F.col("code_a")
    settled = rows.where(~F.coalesce(alike, F.lit(False))).select("seq_id", "place", "pos", F.when(F.col("a").isNull(), 0).otherwise(_common(F.col("code"), F.col("code_a"))).cast("long").alias("lcp"), "code")
    # the others share 24 symbols at least: the widest equal parts first, then the digits of what is left
    pairs = rows.where(alike).select("seq_id", "place", "pos", "code", "a", F.lit(0).cast("long").alias("off"))
    if pairs.head(1):
        for width, named in reversed(names):
            at = lambda side: named.select("seq_id", F.col("pos").alias(f"at_{side}"), F.col("rank").alias(f"name_{side}"))  # noqa: B023, E731
            met = pairs.withColumn("at_a", F.col("a") + F.col("off")).withColumn("at_b", F.col("pos") + F.col("off"))
            met = met.join(at("a"), ["seq_id", "at_a"], "left").join(at("b"), ["seq_id", "at_b"], "left")
            step = F.when(F.col("name_a") == F.col("name_b"), F.lit(width)).otherwise(0)
            pairs = stored(met.select("seq_id", "place", "pos", "code", "a", (F.col("off") + step).alias("off")), "pairs")
        left = lambda side: ranks.select("seq_id", F.col("pos").alias(f"at_{side}"), F.col("code").alias(f"left_{side}"))
        met = pairs.withColumn("at_a", F.col("a") + F.col("off")).withColumn("at_b", F.col("pos") + F.col("off"))
        met = met.join(left("a"), ["seq_id", "at_a"], "left").join(left("b"), ["seq_id", "at_b"], "left")
        rest = _common(F.coalesce("left_a", F.lit(0)), F.coalesce("left_b", F.lit(0)))
        settled = settled.unionByName(met.select("seq_id", "place", "pos", (F.col("off") + rest).alias("lcp"), "code"))
    return SuffixArray(stored(settled, "suffixes"), names)


def _deep_nodes(array: SuffixArray) -> DataFrame:
    """Branching nodes of ``SHORT`` symbols or more: a stack over suffixes in order, of those that share so many at a time."""
    kind = array.table.schema["seq_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[tuple[int, int, int]] = []  # open nodes: length, first place, a start
        last = (None, None, 0, 0)  # the row before: sequence, segment, place, start
        found: list[tuple[str, int, int, int]] = []

        def close(least: int) -> tuple[int, int]:
            """Nodes longer than ``least`` end at the last row; where the first of them began."""
            seq_id, _, end, start = last
            left = end
            while stack and stack[-1][0] > least:
                length, left, start = stack.pop()
                found.append((seq_id, start, length, end - left + 1))
            return left, start

        def batch_of() -> pa.RecordBatch:
            columns = [list(c) for c in zip(*found)] or [[], [], [], []]
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), *(pa.array(c, pa.int64()) for c in columns[1:])], names=["seq_id", "start", "length", "n"])

        for batch in batches:
            for seq_id, segment, place, pos, lcp in zip(*(c.to_pylist() for c in batch.columns)):
                least = lcp if (seq_id, segment) == last[:2] else 0
                left, start = close(least)
                if least and (not stack or stack[-1][0] < least):
                    stack.append((least, left, start))
                last = (seq_id, segment, place, pos)
            yield batch_of()
        close(0)
        yield batch_of()

    width = int(array.table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = array.table.select(F.col("seq_id").cast("string"), F.expr(f"code div {6 ** (WIDTH - SHORT)}L").alias("segment"), "place", "pos", "lcp")
    dealt = rows.repartition(width, "seq_id", "segment").sortWithinPartitions("seq_id", "place")
    found = dealt.mapInArrow(run, "seq_id string, start long, length long, n long")
    return found.withColumn("seq_id", F.col("seq_id").cast(kind))


def _short_nodes(array: SuffixArray) -> DataFrame:
    """Branching nodes of fewer than ``SHORT`` symbols: words that different symbols, or the end, follow."""
    first = array.table.groupBy("seq_id", _first(F.col("code"), SHORT).alias("code")).agg(F.count("*").alias("n"), F.min("pos").alias("start"))
    word = lambda k: F.struct(F.lit(k).alias("k"), F.expr(f"code div {6 ** (WIDTH - k)}L").alias("word"), F.expr(f"code div {6 ** (WIDTH - k - 1)}L % 6").alias("next"))
    each = first.select("seq_id", "n", "start", F.explode(F.array(*(word(k) for k in range(1, SHORT)))).alias("w")).where("w.word % 6 > 0")
    found = each.groupBy("seq_id", "w.k", "w.word").agg(F.sum("n").alias("n"), F.min("start").alias("start"), (F.min("w.next") < F.max("w.next")).alias("branches"))
    return found.where("branches").select("seq_id", "start", F.col("k").cast("long").alias("length"), "n")


def tree_nodes(array: SuffixArray) -> DataFrame:
    """``seq_id, start, length, n``: the explicit nodes of a suffix tree but for the root and the empty suffix.

    A node is the substring of ``length`` from ``start``, which occurs ``n`` times:
    substrings that different symbols (or the end) follow, and suffixes that occur
    once.  The text is not made here, as texts grow with the square of a sequence.
    """
    table = array.table
    ends = table.groupBy("seq_id").agg((F.max("pos") + 1).alias("size"))
    after = table.select("seq_id", (F.col("place") - 1).alias("place"), F.col("lcp").alias("next_lcp"))
    leaf = table.join(after, ["seq_id", "place"], "left").join(ends, "seq_id").withColumn("length", F.col("size") - F.col("pos"))
    leaves = leaf.where(F.col("length") > F.greatest("lcp", F.coalesce("next_lcp", F.lit(0)))).select("seq_id", F.col("pos").alias("start"), "length", F.lit(1).cast("long").alias("n"))
    return _short_nodes(array).unionByName(_deep_nodes(array)).unionByName(leaves)


def _identified(rows: DataFrame, array: SuffixArray, start: str, length: str) -> DataFrame:
    """``rows`` with ``one, two``: of substrings of one length, equal exactly where the substrings are.

    The names of the widest parts that begin and end a substring; of fewer than 24 symbols, their number.
    """
    at = array.table.select("seq_id", F.col("pos").alias(start), "code")
    short = rows.where(F.col(length) < WIDTH).join(at, ["seq_id", start]).withColumn("one", _first(F.col("code"), F.col(length).cast("int"))).withColumn("two", F.lit(-1).cast("long")).drop("code")
    out = short
    for k, (width, named) in enumerate(array.names):
        some = rows.where(F.col(length) >= width)
        if k + 1 < len(array.names):
            some = some.where(F.col(length) < array.names[k + 1][0])
        one, two = (named.select("seq_id", F.col("pos").alias(at), F.col("rank").alias(name)) for at, name in ((start, "one"), ("_end", "two")))
        met = some.withColumn("_end", F.col(start) + F.col(length) - width).join(one, ["seq_id", start]).join(two, ["seq_id", "_end"]).drop("_end")
        out = out.unionByName(met)
    return out


def suffix_links(nodes: DataFrame, array: SuffixArray) -> DataFrame:
    """``seq_id, start, length, n, link_start, link_length``: the node that a node without its first symbol is.

    Every branching node has one: the root (length 0, no start) for a single symbol.  A
    leaf's may lie inside an edge and then is null.
    """
    target = _identified(nodes, array, "start", "length").select("seq_id", F.col("start").alias("link_start"), F.col("length").alias("link_length"), "one", "two")
    moved = nodes.where("length > 1").withColumn("next_start", F.col("start") + 1).withColumn("link_length", F.col("length") - 1)
    found = _identified(moved, array, "next_start", "link_length").join(target.withColumn("held", F.lit(True)), ["seq_id", "link_length", "one", "two"], "left")
    linked = found.select("seq_id", "start", "length", "n", "link_start", F.when(F.col("held"), F.col("link_length")).alias("link_length"))
    return linked.unionByName(nodes.where("length = 1").select("seq_id", "start", "length", "n", F.lit(None).cast("long").alias("link_start"), F.lit(0).cast("long").alias("link_length")))


#: Ranges of a search that are pushed down to the index; of more patterns the whole index is met.
RANGES = 200


def write_index(seqs: DataFrame, path: str) -> None:
    """An index of all positions, ordered by what begins there: files and row groups hold ranges of numbers."""
    width = int(seqs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    codes(seqs).repartitionByRange(width, "code", "seq_id", "pos").sortWithinPartitions("code", "seq_id", "pos").write.parquet(f"{path}/codes")
    seqs.where("seq is not null").select("seq_id", F.length("seq").cast("long").alias("length")).write.parquet(f"{path}/lengths")


def search_index(spark, path: str, patterns: DataFrame) -> DataFrame:
    """``seq_id, pattern, pos`` of every occurrence, as ``words.search`` gives, from a written index.

    A pattern of up to 24 symbols is a range of numbers; a longer one is met where all
    its parts of 24 stand in a row.  The empty pattern is found at every place and the
    end.  Patterns are a small table; null ones, and those with other letters, are found nowhere.
    """
    at, lengths = spark.read.parquet(f"{path}/codes"), spark.read.parquet(f"{path}/lengths")
    asked = patterns.where("pattern is not null").select("pattern").distinct()
    part = F.regexp_extract_all("pattern", F.lit(f".{{1,{WIDTH}}}"), F.lit(0))
    parts = asked.where("pattern rlike '^[ACGNT]+$'").withColumn("parts", part).select("pattern", F.size("parts").alias("n_parts"), F.posexplode("parts").alias("k", "part"))
    parts = parts.select("pattern", "n_parts", "k", F.length("part").alias("m"), number(F.col("part")).alias("word"))
    ranges = [(r.word, r.word + 6 ** (WIDTH - r.m) - 1) for r in parts.select("word", "m").distinct().limit(RANGES + 1).collect()]
    sizes = sorted({r.m for r in parts.select("m").distinct().collect()})
    everywhere = lengths if asked.where("pattern = ''").head(1) else lengths.limit(0)
    everywhere = everywhere.select("seq_id", F.lit("").alias("pattern"), F.explode(F.sequence(F.lit(0).cast("long"), "length")).alias("pos"))
    if not sizes:
        return everywhere
    if len(ranges) <= RANGES:
        held = F.lit(False)
        for low, high in ranges:
            held = held | F.col("code").between(low, high)
        at = at.where(held)
    word = F.struct(F.col("m"), F.col("word"))
    begins = F.array(*(F.struct(F.lit(m).alias("m"), _first(F.col("code"), m).alias("word")) for m in sizes))
    hits = at.select("seq_id", "pos", F.explode(begins).alias("w")).join(parts.select("pattern", "n_parts", "k", word.alias("w")), "w")
    single = hits.where("n_parts = 1").select("seq_id", "pattern", "pos")
    rows = hits.where("n_parts > 1").groupBy("seq_id", "pattern", "n_parts", (F.col("pos") - F.col("k") * WIDTH).alias("pos")).agg(F.count("*").alias("met"))
    return single.unionByName(rows.where("met = n_parts").select("seq_id", "pattern", "pos")).unionByName(everywhere)
