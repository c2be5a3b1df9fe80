"""Scoring sequences and windows under models."""

from __future__ import annotations

import copy
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.symbols import P, SYMBOLS, background_context, log_or_zero, probability, reverse_complement, suffixes
from . import grid
from .words import positions

STRETCH = 16_384  # positions a window task sorts at once
S = [f"s_{p[-1]}" for p in P]  # scores of the symbols


def deepest(models: DataFrame) -> int:
    """The longest context of all models: how many symbols a score can look back."""
    return models.agg(F.max(F.length("context"))).head(1)[0][0] or 0


def closest_state(probes: DataFrame, models: DataFrame, order: int, keys: list[str] | None = None) -> DataFrame:
    """The longest included suffix of each probe, with its row of the model.

    ``probes``: ``probe`` and, to tie a probe to one model, ``model_id``.  Without
    it every probe meets every model.  ``keys`` are further columns that identify
    a probe.  The root is a suffix of anything, so each probe has a state.
    """
    tied = "model_id" in probes.columns
    keys = [c for c in probes.columns if c not in ("probe", "model_id")] if keys is None else keys
    candidates = probes.select(*probes.columns, F.explode(suffixes(F.col("probe"), order)).alias("context"))
    joined = candidates.join(models.select("model_id", "context", "count", *P), ["model_id", "context"] if tied else ["context"])
    state = F.struct(F.length("context").alias("n"), "context", "count", *P)
    best = joined.groupBy("model_id", "probe", *keys).agg(F.max(state).alias("state"))
    return best.select("model_id", "probe", *keys, F.col("state.context").alias("context"), F.col("state.count").alias("count"), *(F.col(f"state.{p}").alias(p) for p in P))


def transition_counts(seqs: DataFrame, order: int) -> DataFrame:
    """``seq_id, probe, c_a..c_t``: how often each symbol follows what looks the same; targets of N are skipped."""
    times = [F.sum((F.col("symbol") == x).cast("long")).alias(f"c_{x.lower()}") for x in SYMBOLS]
    return positions(seqs, order).where("symbol <> 'N'").groupBy("seq_id", "probe").agg(*times)


def _with_background(states: DataFrame, models: DataFrame, background_order: int) -> DataFrame:
    """States with the probabilities of their background state as ``bg_a..bg_t``.

    The background is the closest state of the last ``background_order`` symbols of
    the matched context where that is shorter, else the root.
    """
    short = (F.lit(background_order) > 0) & (F.lit(background_order) < F.length("context"))
    wanted = states.withColumn("bg_probe", F.when(short, background_context(F.col("context"), background_order)).otherwise(F.lit("")))
    distinct = wanted.select("model_id", F.col("bg_probe").alias("probe")).distinct()
    found = closest_state(distinct, models, background_order).select("model_id", F.col("probe").alias("bg_probe"), *(F.col(p).alias(f"bg_{p[-1]}") for p in P))
    return wanted.join(found, ["model_id", "bg_probe"]).drop("bg_probe")


Value = Callable[[Column, Column], Column]


def _adjusted(p: Column, background: Column) -> Column:
    # logs of p and of the root itself: where p is that root, the score is 0, which half a log misses by rounding
    return F.when((p > 0) & (background > 0), log_or_zero(p) - log_or_zero(F.sqrt(background))).otherwise(0.0)


def _adjusted_by_half(p: Column, background: Column) -> Column:
    return F.when((p > 0) & (background > 0), log_or_zero(p) - 0.5 * log_or_zero(background)).otherwise(0.0)


#: A score's value from a probability and its background's, and whether it asks for one.
SCORES: dict[str, tuple[Value, bool]] = {"log": (lambda p, _: log_or_zero(p), False), "max_adjusted": (lambda p, _: p, False), "background": (_adjusted, True), "background_halved": (_adjusted_by_half, True)}


def register_score(name: str, value: Value, background: bool = False) -> None:
    """Make a score known by name to everything that scores; ``value`` must be 0 where nothing is to be counted."""
    SCORES[name] = (value, background)


def symbol_scores(states: DataFrame, score: str = "log", models: DataFrame | None = None, background_order: int = 0) -> DataFrame:
    """States with one score per symbol: ``s_a..s_t``.

    ``log``: ln p; ``max_adjusted``: p itself; ``background``: ln p less the log of
    the root of the background probability (``background_halved``: less half its
    log, the same but for rounding, which decides where a score is 0); or a
    registered one.  A probability of 0 scores 0.
    """
    if score not in SCORES:
        raise ValueError(f"unknown score: {score}")
    value, background = SCORES[score]
    if background:
        states = _with_background(states, models, background_order)
    of = lambda p: F.col(f"bg_{p[-1]}") if background else F.lit(1.0)
    return states.select(*states.columns, *(value(F.col(p), of(p)).alias(f"s_{p[-1]}") for p in P))


def _score_of(symbol: str) -> Column:
    return probability(F.col(symbol), tuple(f"s_{p[-1]}" for p in P))


def log_likelihood(seqs: DataFrame, models: DataFrame, own: bool = False, score: str = "log", background_order: int = 0, order: int | None = None) -> DataFrame:
    """``seq_id, model_id, ll, n_scored, length``: the sum of scores and how many are not 0.

    ``own`` scores each sequence under the model of its own id, else every sequence
    meets every model.  Positions are counted by what they look like first, so no
    join sees single positions.
    """
    order = deepest(models) if order is None else order
    if not own:
        return _all_scores(seqs, models, score, background_order, order, False).drop("nll")
    seen = transition_counts(seqs, order).withColumn("model_id", F.col("seq_id"))
    scored = symbol_scores(closest_state(seen.select("model_id", "probe").distinct(), models, order), score, models, background_order)
    met = seen.join(scored.select("model_id", "probe", *S), ["model_id", "probe"])
    total = sum((F.col(f"c_{x}") * F.col(f"s_{x}") for x in "acgt"), F.lit(0.0))
    scored_times = sum((F.when(F.col(f"s_{x}") != 0, F.col(f"c_{x}")).otherwise(0) for x in "acgt"), F.lit(0))
    sums = met.groupBy("seq_id", "model_id").agg(F.sum(total).alias("ll"), F.sum(scored_times).alias("n_scored"))
    ids = seqs.select("seq_id", F.length("seq").cast("long").alias("length")).withColumn("model_id", F.col("seq_id")).join(models.select("model_id").distinct(), "model_id", "left_semi")
    # sequences without a scored position still have a row
    return ids.join(sums, ["seq_id", "model_id"], "left").select("seq_id", "model_id", F.coalesce("ll", F.lit(0.0)).alias("ll"), F.coalesce("n_scored", F.lit(0)).cast("long").alias("n_scored"), "length")


def block_scores(seqs: grid.Side, models: grid.Side) -> tuple[np.ndarray, np.ndarray]:
    """Sum of scores and how many are not 0 for each sequence (counts of what follows its probes) and model (scores of its contexts)."""
    ll, times = np.zeros((seqs.n, models.n)), np.zeros((seqs.n, models.n))
    for some in grid.chunks(seqs.contexts):
        seen, states = seqs.exact(some)[0].reshape(seqs.n, -1), models.closest(some).reshape(models.n, -1)
        ll += seen @ states.T
        times += seen @ (states != 0).T.astype(float)
    return ll, times


def log_scores(models: DataFrame) -> DataFrame:
    """Contexts with ``s_a..s_t``, the logs of their probabilities, and their ``count``."""
    return symbol_scores(models.select("model_id", "context", "count", *P)).select("model_id", "context", *S, F.col("count").cast("double").alias("count"))


class Words:
    """Words as counts of the symbols that follow what stands before them, in parts whose counts are dense at once."""

    #: Lengths of beginnings that are scored before whole words where few words can score well.
    BEGINNINGS = (4, 6, 8)

    def __init__(self, ids: list, texts: list[str | None], order: int) -> None:
        at: dict = {}
        word = [at.setdefault(i, len(at)) for i in ids]
        self.n = len(at)
        code = {s: k for k, s in enumerate(SYMBOLS)}
        found: dict[str, int] = {}
        places, probes, symbols = [], [], []
        for w, text in zip(word, texts):
            for i, s in enumerate(text or ""):
                if s in code:
                    places.append(w)
                    probes.append(found.setdefault(text[max(0, i - order) : i], len(found)))
                    symbols.append(code[s])
        self.probes = list(found)
        place, probe = np.array(places, dtype=np.int64), np.array(probes, dtype=np.int64)
        sort = np.argsort(place, kind="stable")
        self.place, self.probe, self.symbol = place[sort], probe[sort], np.array(symbols, dtype=np.int64)[sort]
        self.texts, self.of, self.order = texts, np.array(word, dtype=np.int64), order
        # few probes: many words at once
        self.width = max(grid.IDS, min(4 * grid.CHUNK, (1 << 22) // (4 * max(1, len(found)))))

    def only(self, which: np.ndarray) -> Words:
        """These words alone (ascending numbers), to score them."""
        number = np.full(self.n, -1)
        number[which] = np.arange(len(which))
        place = number[self.place]
        out, rows = copy.copy(self), place >= 0
        out.n, out.place, out.probe, out.symbol = len(which), place[rows], self.probe[rows], self.symbol[rows]
        return out

    @cached_property
    def beginnings(self) -> list[tuple[Words, np.ndarray]]:
        """Different beginnings of texts, shorter ones first, and the number of each text's."""
        found = []
        for k in self.BEGINNINGS:
            if any(len(t or "") > k for t in self.texts):
                at: dict[str, int] = {}
                number = np.array([at.setdefault((t or "")[:k], len(at)) for t in self.texts], dtype=np.int64)
                found.append((Words(list(at), list(at), self.order), number))
        return found

    def parts(self) -> Iterator[tuple[slice, list[str], np.ndarray]]:
        """Words, the probes of theirs, and how often each symbol follows each: ``(word, probe and symbol)``."""
        for first in range(0, self.n, self.width):
            last = min(self.n, first + self.width)
            rows = slice(*np.searchsorted(self.place, [first, last]))
            own, local = np.unique(self.probe[rows], return_inverse=True)
            flat = (self.place[rows] - first) * 4 * len(own) + 4 * local + self.symbol[rows]
            seen = np.bincount(flat, minlength=(last - first) * 4 * len(own)).astype(np.float64)
            yield slice(first, last), [self.probes[k] for k in own], seen.reshape(last - first, 4 * len(own))


class WordScores:
    """The models of a tile (rows of ``log_scores``) and what they say of words; a model without a root says nothing."""

    def __init__(self, rows: pa.Table, words: Words) -> None:
        self.side, self.words = grid.Side(rows, "model_id", "context", [*S, "count"]), words
        self.ids, self.n = self.side.ids, self.side.n
        root, held = self.side.exact([""])
        self.rooted, self.root = held[:, 0], root[:, 0, -1]

    def possible(self, least: np.ndarray) -> np.ndarray:
        """The words that any model's ``least`` log-likelihood can hold for, and maybe more.

        A word is no likelier than its beginning where no score is above 0.
        """
        words = np.ones(self.words.n, dtype=bool)
        if not (self.side.values[:, : len(S)] > 0).any():
            for begun, number in self.words.beginnings:
                wanted = np.unique(number[words[self.words.of]])
                likely = np.zeros(begun.n, dtype=bool)
                for some, ll in self.parts(begun.only(wanted)):
                    likely[wanted[some]] = (ll >= least[:, None] - 1e-6).any(0)
                words[self.words.of[~likely[number]]] = False
        return np.flatnonzero(words)

    def parts(self, words: Words | None = None) -> Iterator[tuple[slice, np.ndarray]]:
        """Words, all unless others are given, and their log-likelihoods ``(model, word)``, part by part."""
        for some, probes, seen in (self.words if words is None else words).parts():
            ll = np.zeros((self.n, some.stop - some.start))
            for at in range(0, len(probes), grid.CHUNK):
                states = self.side.closest(probes[at : at + grid.CHUNK])[:, :, : len(S)].reshape(self.n, -1)
                ll += states @ seen[:, 4 * at : 4 * (at + grid.CHUNK)].T
            yield some, ll


def _all_scores(seqs: DataFrame, models: DataFrame, score: str, background_order: int, order: int, both_strands: bool) -> DataFrame:
    """``seq_id, model_id, ll, n_scored, length, nll`` of every sequence under every model; ``nll`` of the better strand if both are asked for.

    A context's scores depend on its model alone and are computed there.  Blocks of
    sequences, as counts of what their positions look like, meet blocks of models:
    a cell looks up the closest states and multiplies two matrices.
    """
    scored = symbol_scores(models.select("model_id", "context", *P), score, models, background_order).select("model_id", "context", *S)
    counts = transition_counts(seqs, order).withColumn("strand", F.lit(0))
    if both_strands:
        back = transition_counts(seqs.select("seq_id", reverse_complement(F.col("seq")).alias("seq")), order)
        counts = counts.unionByName(back.withColumn("strand", F.lit(1)))
    # a sequence has no more probes than positions, nor than there are contexts; one with many is several units
    size = F.least(F.length("seq"), F.lit(4 ** min(order, 15)))
    parts = F.greatest(F.ceil(size * (1 + both_strands) / (grid.ROWS // grid.IDS)), F.lit(1)).cast("int")
    units, most = seqs.agg(F.coalesce(F.sum(parts), F.lit(0)), F.coalesce(F.max(parts), F.lit(1))).head(1)[0]
    if most > 1:
        long = seqs.select("seq_id", parts.alias("parts")).where("parts > 1")
        counts = counts.join(long, "seq_id", "left").withColumn("unit", F.pmod(F.xxhash64("probe"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    else:
        counts = counts.withColumn("unit", F.lit(0))
    columns = [f"c_{x}" for x in "acgt"]
    heads = seqs.select("seq_id", F.lit(None).cast("string").alias("probe"), *(F.lit(0).cast("long").alias(c) for c in columns), F.lit(0).alias("strand"), F.lit(0).alias("unit"), F.length("seq").cast("long").alias("length"))
    rows = heads.unionByName(counts.withColumn("length", F.lit(None).cast("long")))
    strands = ("", "_back") if both_strands else ("",)

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        one, two = grid.Side(a, "seq_id", "probe", columns, "strand"), grid.Side(b, "model_id", "context", S)
        ll, times = block_scores(one, two)
        # the row that names a sequence stands in one of its units
        held = a["length"].combine_chunks()
        head = np.flatnonzero(held.is_valid().to_numpy(zero_copy_only=False))
        at = np.full(len(one.ids), -1)
        at[one.place[head] // 2] = head
        seq, model = np.divmod(np.arange(len(one.ids) * two.n), two.n)
        out = {"seq_id": one.ids.take(pa.array(seq)), "model_id": two.ids.take(pa.array(model)), "length": held.take(pa.array(at[seq], mask=at[seq] < 0))}
        for k, strand in enumerate(strands):
            out |= {f"ll{strand}": ll[k::2].ravel() + 0.0, f"n_scored{strand}": times[k::2].ravel().astype(np.int64)}
        return pa.table(out)

    kind = seqs.schema["seq_id"].dataType.simpleString(), models.schema["model_id"].dataType.simpleString()
    schema = f"seq_id {kind[0]}, model_id {kind[1]}, length long, " + ", ".join(f"ll{s} double, n_scored{s} long" for s in strands)
    found = grid.on_grid(rows, scored, ["seq_id", "unit"], "model_id", run, schema, max(1, -(-units // grid.IDS)), grid.blocks(models, "model_id"))
    if most > 1:
        found = found.groupBy("seq_id", "model_id").agg(F.max("length").alias("length"), *(F.sum(f"{c}{s}").alias(f"{c}{s}") for s in strands for c in ("ll", "n_scored")))
    values = [F.try_divide(-F.col(f"ll{s}"), F.col(f"n_scored{s}")) for s in strands]
    value = F.least(*values) if both_strands else values[0]
    return found.select("seq_id", "model_id", "ll", "n_scored", "length", F.coalesce(value + 0.0, F.lit(float("nan"))).alias("nll"))


def nll(seqs: DataFrame, models: DataFrame, own: bool = False, score: str = "log", background_order: int = 0, both_strands: bool = False, order: int | None = None) -> DataFrame:
    """``seq_id, model_id, nll``: minus the sum of scores over the number of scored positions; NaN where there is none.

    With ``both_strands`` the smaller of a sequence's and its reverse complement's.
    """
    order = deepest(models) if order is None else order
    if not own:
        return _all_scores(seqs, models, score, background_order, order, both_strands).select("seq_id", "model_id", "nll")
    value = F.coalesce(F.try_divide(-F.col("ll"), F.col("n_scored")), F.lit(float("nan"))).alias("nll")
    found = log_likelihood(seqs, models, True, score, background_order, order).select("seq_id", "model_id", value)
    if both_strands:
        other = seqs.select("seq_id", reverse_complement(F.col("seq")).alias("seq"))
        found = found.unionByName(nll(other, models, True, score, background_order, False, order)).groupBy("seq_id", "model_id").agg(F.min("nll").alias("nll"))
    return found


def likelihood(seqs: DataFrame, models: DataFrame, own: bool = False) -> DataFrame:
    """exp of the log-likelihood."""
    return log_likelihood(seqs, models, own).select("seq_id", "model_id", F.exp("ll").alias("likelihood"))


def position_scores(seqs: DataFrame, models: DataFrame, own: bool = False, score: str = "log", background_order: int = 0, order: int | None = None) -> DataFrame:
    """``seq_id, model_id, pos, s`` for every position; a target of N scores 0."""
    order = deepest(models) if order is None else order
    at = positions(seqs, order)
    if own:
        at = at.withColumn("model_id", F.col("seq_id"))
        probes = at.select("model_id", "probe").distinct()
    else:
        probes = at.select("probe").distinct()
    scored = symbol_scores(closest_state(probes, models, order), score, models, background_order).select("model_id", "probe", *(f"s_{p[-1]}" for p in P))
    return at.join(scored, ["model_id", "probe"] if own else ["probe"]).select("seq_id", "model_id", "pos", _score_of("symbol").alias("s"))


def sliding_windows(seqs: DataFrame, models: DataFrame, sizes: list[int], own: bool = False, score: str = "log", background_order: int = 0) -> DataFrame:
    """``seq_id, model_id, window_size, pos, nll``: the mean over the trailing window's non-zero scores, -1 without any.

    One sort serves all sizes.  A sequence is cut in stretches that also hold the
    positions a window reaches back to, so a long one fills many tasks.
    """
    reach = max(sizes) - 1
    stretch = max(STRETCH, 4 * reach)
    rows = position_scores(seqs, models, own, score, background_order)
    part = F.floor(F.col("pos") / stretch)
    parts = F.when(F.col("pos") % stretch >= stretch - reach, F.array(part, part + 1)).otherwise(F.array(part))
    rows = rows.select("seq_id", "model_id", "pos", "s", F.explode(parts).alias("part"))
    base = Window.partitionBy("seq_id", "model_id", "part").orderBy("pos")
    columns = []
    for size in sizes:
        frame = base.rowsBetween(-(size - 1), 0)
        total, n = F.sum("s").over(frame), F.sum((F.col("s") != 0).cast("long")).over(frame)
        columns.append(F.struct(F.lit(size).alias("window_size"), F.coalesce(F.try_divide(-total, n), F.lit(-1.0)).alias("nll")))
    wide = rows.select("seq_id", "model_id", "pos", "part", F.array(*columns).alias("w")).where(F.floor(F.col("pos") / stretch) == F.col("part"))
    return wide.select("seq_id", "model_id", "pos", F.explode("w").alias("w")).select("seq_id", "model_id", "w.window_size", "pos", "w.nll")


def sliding_windows_both(seqs: DataFrame, models: DataFrame, sizes: list[int], own: bool = False) -> DataFrame:
    """At each position the smaller of a window and that of the reversed sequence read backwards."""
    forward = sliding_windows(seqs, models, sizes, own)
    backward = sliding_windows(seqs.withColumn("seq", F.reverse("seq")), models, sizes, own)
    lengths = seqs.select("seq_id", F.length("seq").cast("long").alias("n"))
    turned = backward.join(lengths, "seq_id").select("seq_id", "model_id", "window_size", (F.col("n") - 1 - F.col("pos")).alias("pos"), F.col("nll").alias("other"))
    return forward.join(turned, ["seq_id", "model_id", "window_size", "pos"]).select("seq_id", "model_id", "window_size", "pos", F.least("nll", "other").alias("nll"))


def score_matrix(seqs: DataFrame, models: DataFrame, both_strands: bool = True, background: bool = False, background_order: int = 0) -> DataFrame:
    """Every sequence under every model; the facades always take the better strand."""
    return nll(seqs, models, False, "background" if background else "log", background_order, both_strands)
