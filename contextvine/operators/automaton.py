"""Models as automata: a table of states and where each symbol leads, and scoring by walking it.

The states of a model are the beginnings of its contexts (a context's beginning need
not be a context itself).  A symbol leads from a state to the longest state that ends
what was read.  A state's link is the state without its oldest symbol; where a state
has no step for a symbol, its link's step holds.  So steps are closed level by level,
each level from the one before.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.symbols import P, SYMBOLS, parent, reverse_complement
from ..session import stored
from . import grid
from .scoring import S, deepest, symbol_scores
from .words import pieces

STEPS = [f"next_{s.lower()}" for s in SYMBOLS]
UNIT = 1 << 16  # symbols of a sequence that are walked together
LANE = 1024  # symbols one lane of a walk takes
CELLS = 1 << 22  # lanes times models that walk at once


def states(models: DataFrame) -> DataFrame:
    """``model_id, state``: the beginnings of all contexts, and what links of theirs a model may lack."""
    begins = F.transform(F.sequence(F.lit(0), F.length("context")), lambda n: F.left(F.col("context"), n))
    held = stored(models.select("model_id", F.explode(begins).alias("state")).distinct(), "states")
    while True:
        # trained models hold every suffix of a context; a loaded one may not
        links = held.where("state <> ''").select("model_id", parent(F.col("state")).alias("state")).distinct()
        new = links.join(held, ["model_id", "state"], "left_anti")
        if not new.head(1):
            return held
        held = stored(held.unionByName(new), "states")


def automaton(models: DataFrame) -> DataFrame:
    """``model_id, state, context, next_a..next_t``: the context a state stands for and the state after each symbol.

    The context is the longest one that ends the state, the state after a symbol the
    longest that ends state and symbol.  The empty state is the start, and where any
    other symbol leads.  A model without a root row, and an empty table, have the
    states of their contexts; a state that no context ends has none.
    """
    held = states(models)
    steps = held.where("state <> ''").groupBy("model_id", F.left("state", F.length("state") - 1).alias("state"))
    found = steps.agg(*(F.max(F.when(F.right("state", F.lit(1)) == s, F.col("state"))).alias(f"to_{s.lower()}") for s in SYMBOLS))
    own = models.select("model_id", F.col("context").alias("state"), F.col("context").alias("held")).distinct()
    # one row per state; all levels are read from here
    base = stored(held.join(found, ["model_id", "state"], "left").join(own, ["model_id", "state"], "left").withColumn("level", F.length("state")), "links")
    deep = base.agg(F.max("level")).head(1)[0][0]
    first = base.where("level = 0").select("model_id", "state", F.col("held").alias("context"), *(F.coalesce(f"to_{n[-1]}", F.lit("")).alias(n) for n in STEPS))
    levels = [first]
    for level in range(1, (deep or 0) + 1):
        above = levels[-1].select("model_id", F.col("state").alias("link"), F.col("context").alias("link_context"), *(F.col(n).alias(f"link_{n}") for n in STEPS))
        rows = base.where(F.col("level") == level).withColumn("link", parent(F.col("state"))).join(above, ["model_id", "link"])
        closed = rows.select("model_id", "state", F.coalesce("held", "link_context").alias("context"), *(F.coalesce(f"to_{n[-1]}", f"link_{n}").alias(n) for n in STEPS))
        levels.append(stored(closed, "level"))
    return reduce(DataFrame.unionByName, levels)


class Walker:
    """The automata of a block of models, their states numbered through."""

    def __init__(self, table: pa.Table) -> None:
        coded = table["model_id"].combine_chunks().dictionary_encode()
        self.ids, owner = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        names = pa.chunked_array([c for n in ["state", *STEPS] for c in table[n].chunks]).combine_chunks().dictionary_encode()
        codes = names.indices.to_numpy(zero_copy_only=False).astype(np.int64).reshape(1 + len(STEPS), -1)
        width = len(names.dictionary)
        keys = owner * width + codes[0]
        order = np.argsort(keys)
        place = lambda k: order[np.searchsorted(keys, k, sorter=order)]
        root = names.dictionary.index(pa.scalar("")).as_py()
        self.start = place(np.arange(len(self.ids)) * width + root)
        after = [place(owner * width + c) for c in codes[1:]]
        # any other symbol starts anew and scores nothing
        self.after = np.stack([*after, self.start[owner]], 1)
        self.scores = np.stack([*(table[s].to_numpy() for s in S), np.zeros(len(owner))], 1)

    def walk(self, lanes: np.ndarray, lead: int) -> tuple[np.ndarray, np.ndarray]:
        """Sum of scores and number of those not 0 for each model and lane; symbols are rows, the first ``lead`` only set the state."""
        n = lanes.shape[1]
        ll, times = np.zeros((len(self.ids), n)), np.zeros((len(self.ids), n), dtype=np.int64)
        some, width = max(1, CELLS // max(1, n)), self.after.shape[1]
        after, scores = (self.after * width).ravel(), self.scores.ravel()
        for at in range(0, len(self.ids), some):
            state = np.repeat(width * self.start[at : at + some, None], n, axis=1)
            for t, symbols in enumerate(lanes):
                step = state + symbols
                if t >= lead:
                    s = scores.take(step)
                    ll[at : at + some] += s
                    times[at : at + some] += s != 0
                state = after.take(step)
        return ll, times


def _lanes(table: pa.Table, lead: int, lane: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all pieces in lanes of one length with what stands before each, and the row of the table each lane is from."""
    code = np.full(256, 4, dtype=np.uint8)
    code[[ord(s) for s in SYMBOLS]] = range(4)
    texts, leads, owns = table["piece"].combine_chunks(), table["lead"].to_numpy(), table["own"].to_numpy()
    lane = min(lane, max(1, int(owns.max(initial=1))))
    columns, rows = [], []
    for row in range(table.num_rows):
        n = -(-int(owns[row]) // lane)
        if not n:
            continue
        symbols = code[np.frombuffer(texts[row].as_buffer(), dtype=np.uint8)]
        padded = np.full(lead + n * lane, 4, dtype=np.uint8)
        at = lead - int(leads[row])
        padded[at : at + len(symbols)] = symbols
        columns.append(np.lib.stride_tricks.sliding_window_view(padded, lead + lane)[::lane])
        rows.append(np.full(n, row))
    if not columns:
        return np.zeros((lead + lane, 0), dtype=np.uint8), np.zeros(0, dtype=np.int64)
    return np.ascontiguousarray(np.concatenate(columns).T), np.concatenate(rows)


def walk_scores(seqs: DataFrame, models: DataFrame, own: bool = False, score: str = "log", background_order: int = 0, both_strands: bool = False) -> DataFrame:
    """``seq_id, model_id, ll, n_scored, length, nll`` as ``scoring.log_likelihood`` and ``scoring.nll`` give, by walking automata.

    Sequences are cut in pieces that carry as many symbols before them as the deepest
    state holds; walking these first gives the state the piece before hands over, so
    pieces are walked in any task.  Units of a sequence meet the model of its own id,
    or in cells of a grid every model; a cell holds a bounded number of symbols and
    its models, and gives partial sums.  Empty sequences have a row with no scored
    position.  With ``both_strands``, sums are those of the forward strand, ``nll``
    the smaller one's.
    """
    order = deepest(models)
    scored = symbol_scores(models.select("model_id", "context", *P), score, models, background_order).select("model_id", "context", *S)
    rows = automaton(models).join(scored, ["model_id", "context"], "left").na.fill(0.0, S).select("model_id", "state", *STEPS, *S)
    strands = [seqs.select("seq_id", "seq", F.lit(0).alias("strand"))]
    if both_strands:
        strands.append(seqs.select("seq_id", reverse_complement(F.col("seq")).alias("seq"), F.lit(1).alias("strand")))
    cut, n_strands = None, len(strands)
    for k, strand in enumerate(strands):
        part = pieces(strand, 0, UNIT, before=order).withColumn("strand", F.lit(k))
        cut = part if cut is None else cut.unionByName(part)
    heads = seqs.select("seq_id", F.lit(0).cast("long").alias("first"), F.lit("").alias("piece"), F.lit(0).alias("lead"), F.lit(0).alias("own"), F.lit(0).alias("strand"), F.length("seq").cast("long").alias("length"))
    left = heads.unionByName(cut.withColumn("length", F.lit(None).cast("long")))
    kind = seqs.schema["seq_id"].dataType.simpleString(), models.schema["model_id"].dataType.simpleString()
    schema = f"seq_id {kind[0]}, model_id {kind[1]}, strand int, ll double, n_scored long, length long"

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        walker = Walker(b)
        sums, counts = walked(walker, *_lanes(a, order, LANE), a.num_rows)
        m, n = sums.shape
        model, piece = np.divmod(np.arange(m * n), max(1, n))
        piece = pa.array(piece)
        return pa.table({
            "seq_id": a["seq_id"].combine_chunks().take(piece), "model_id": walker.ids.take(pa.array(model)), "strand": a["strand"].combine_chunks().take(piece),
            "ll": sums.ravel(), "n_scored": counts.ravel(), "length": a["length"].combine_chunks().take(piece),
        })

    def walked(walker: Walker, symbols: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Sums and counts for each model and row of the pieces."""
        ll, times = walker.walk(symbols, order)
        m = len(walker.ids)
        sums, counts = np.zeros((m, n)), np.zeros((m, n), dtype=np.int64)
        if len(row):
            starts = np.flatnonzero(np.diff(row, prepend=-1))
            sums[:, row[starts]], counts[:, row[starts]] = np.add.reduceat(ll, starts, axis=1), np.add.reduceat(times, starts, axis=1)
        return sums, counts

    def ready(table: pa.Table) -> Walker | tuple:
        if "piece" not in table.column_names:
            return Walker(table)
        coded = table["seq_id"].combine_chunks().dictionary_encode()
        place = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        held = table["length"].combine_chunks()
        head = np.flatnonzero(held.is_valid().to_numpy(zero_copy_only=False))
        at = np.full(len(coded.dictionary), -1)
        at[place[head]] = head
        return coded.dictionary, place, table["strand"].to_numpy(), held.take(pa.array(at, mask=at < 0)), _lanes(table, order, LANE), table.num_rows

    def meet(one: tuple, walker: Walker) -> pa.Table:
        """A row per sequence and model with the sums of the sequence's pieces that are here."""
        ids, place, strand, lengths, lanes, n = one
        sums, counts = walked(walker, *lanes, n)
        seq, model = np.divmod(np.arange(len(ids) * len(walker.ids)), max(1, len(walker.ids)))
        out = {"seq_id": ids.take(pa.array(seq)), "model_id": walker.ids.take(pa.array(model)), "length": lengths.take(pa.array(seq))}
        for k in range(n_strands):
            total, times = np.zeros((len(ids), len(walker.ids))), np.zeros((len(ids), len(walker.ids)), dtype=np.int64)
            rows = np.flatnonzero(strand == k)
            np.add.at(total, place[rows], sums.T[rows])
            np.add.at(times, place[rows], counts.T[rows])
            out |= {f"ll_{k}": total.ravel(), f"n_{k}": times.ravel()}
        return pa.table(out)

    if own:
        # a unit of a sequence and its model; the model goes to each unit
        units = left.withColumn("unit", F.floor(F.col("first") / UNIT)).withColumn("model_id", F.col("seq_id"))
        last = seqs.groupBy(F.col("seq_id").alias("model_id")).agg(F.floor(F.greatest(F.max(F.length("seq")) - 1, F.lit(0)) / UNIT).alias("last"))
        right = rows.join(last, "model_id").withColumn("unit", F.explode(F.sequence(F.lit(0).cast("long"), "last"))).drop("last")
        found = units.groupBy("model_id", "unit").cogroup(right.groupBy("model_id", "unit")).applyInArrow(lambda a, b: run(a, b) if a.num_rows and b.num_rows else grid.empty(schema), schema)
    else:
        size = F.greatest(F.ceil(F.length("seq") / UNIT), F.lit(1))
        units, most, symbols = seqs.agg(F.coalesce(F.sum(size), F.lit(0)), F.coalesce(F.max(size), F.lit(1)), F.coalesce(F.sum(F.length("seq")), F.lit(0))).head(1)[0]
        rows = stored(rows, "automata")  # counted and then dealt
        n_left = max(grid.n_blocks(seqs.sparkSession, units, 2 * units * n_strands), -(-symbols * n_strands // (grid.IDS * UNIT)))
        wide = f"seq_id {kind[0]}, model_id {kind[1]}, length long, " + ", ".join(f"ll_{k} double, n_{k} long" for k in range(n_strands))
        cells = grid.on_grid(left.withColumn("unit", F.floor(F.col("first") / UNIT)), rows, ["seq_id", "unit"], "model_id", meet, wide, n_left, grid.blocks(rows, "model_id"), lambda _: ready)
        if most > 1:  # only long sequences have sums in several cells
            cells = cells.groupBy("seq_id", "model_id").agg(F.max("length").alias("length"), *(F.sum(f"{c}_{k}").alias(f"{c}_{k}") for k in range(n_strands) for c in ("ll", "n")))
        values = [F.try_divide(-F.col(f"ll_{k}"), F.col(f"n_{k}")) for k in range(n_strands)]
        nll = F.least(*values) if both_strands else values[0]
        return cells.select("seq_id", "model_id", F.col("ll_0").alias("ll"), F.col("n_0").alias("n_scored"), "length", F.coalesce(nll, F.lit(float("nan"))).alias("nll"))
    sums = found.groupBy("seq_id", "model_id", "strand").agg(F.sum("ll").alias("ll"), F.sum("n_scored").alias("n_scored"), F.max("length").alias("length"))
    value = F.try_divide(-F.col("ll"), F.col("n_scored"))
    forward = lambda c: F.max(F.when(F.col("strand") == 0, F.col(c))).alias(c)
    best = sums.groupBy("seq_id", "model_id").agg(forward("ll"), forward("n_scored"), forward("length"), F.min(value).alias("nll"))
    return best.select("seq_id", "model_id", "ll", "n_scored", "length", F.coalesce("nll", F.lit(float("nan"))).alias("nll"))
