"""Distances between models: ``left_id, right_id, value`` for every pair of two model sets.

Most compare contexts that both models hold.  Components are rows that Catalyst
computes; blocks of models then meet on a grid, where sums over shared contexts are
matrix products.  Pairs that share no usable context appear with the measure's
value for that case.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.symbols import P, SYMBOLS, all_words, all_words_column, background_context
from . import grid
from .scoring import S, Words, WordScores, closest_state, log_scores

V = tuple(f"v_{p[-1]}" for p in P)


def _with_root(models: DataFrame) -> DataFrame:
    """Contexts with their model's root: its count and probabilities as ``root`` and ``r_a..r_t``."""
    root = models.where("context = ''").select("model_id", F.col("count").alias("root"), *(F.col(p).alias(f"r_{p[-1]}") for p in P))
    return models.join(root, "model_id")


def _with_own_background(models: DataFrame, order: int) -> DataFrame:
    """Contexts with the row of their background context in the same model as ``bg_a..bg_t``; 0 where it is missing."""
    rows = models.withColumn("bg", background_context(F.col("context"), order))
    table = models.select("model_id", F.col("context").alias("bg"), *(F.col(p).alias(f"bg_{p[-1]}") for p in P))
    return rows.join(table, ["model_id", "bg"], "left").na.fill(0.0, [f"bg_{p[-1]}" for p in P]).drop("bg")


def raw_components(models: DataFrame) -> DataFrame:
    return models.select("model_id", "context", *(F.col(p).alias(v) for p, v in zip(P, V)))


def star_components(models: DataFrame, background_order: int = 0) -> DataFrame:
    """p over the root of its background's p, for contexts longer than the background order."""
    rows = _with_own_background(models.where(F.length("context") >= 0), background_order)
    value = lambda p: F.when(F.col(f"bg_{p[-1]}") > 0, F.col(p) / F.sqrt(F.when(F.col(f"bg_{p[-1]}") > 0, F.col(f"bg_{p[-1]}")))).otherwise(0.0)
    return rows.where(F.length("context") > background_order).select("model_id", "context", *(value(p).alias(v) for p, v in zip(P, V)))


def d2star_components(models: DataFrame) -> DataFrame:
    """(count p - L q) / sqrt(L q): L words of the length fit in the sequence, q is their chance under the root alone."""
    rows = _with_root(models)
    chance = F.lit(1.0)
    for s in SYMBOLS:
        seen = F.length("context") - F.length(F.replace(F.col("context"), F.lit(s), F.lit("")))
        chance = chance * F.pow(F.col(f"r_{s.lower()}"), seen)
    expected = lambda p: (F.col("root") - F.length("context")) * chance * F.col(f"r_{p[-1]}")
    value = lambda p: F.when(expected(p) > 0, (F.col("count") * F.col(p) - expected(p)) / F.sqrt(F.when(expected(p) > 0, expected(p)))).otherwise(0.0)
    return rows.select("model_id", "context", *(value(p).alias(v) for p, v in zip(P, V)))


def relative_components(states: DataFrame, models: DataFrame, background_order: int = 2) -> DataFrame:
    """(p - p_bg) / p_bg with the background by closest state; ``states``: model_id, context, state, p_a..p_t."""
    wanted = states.withColumn("probe", background_context(F.col("state"), background_order))
    found = closest_state(wanted.select("model_id", "probe").distinct(), models, background_order).select("model_id", "probe", *(F.col(p).alias(f"bg_{p[-1]}") for p in P))
    value = lambda p: F.when(F.col(f"bg_{p[-1]}") > 0, (F.col(p) - F.col(f"bg_{p[-1]}")) / F.when(F.col(f"bg_{p[-1]}") > 0, F.col(f"bg_{p[-1]}"))).otherwise(0.0)
    return wanted.join(found, ["model_id", "probe"]).select("model_id", "context", *(value(p).alias(v) for p, v in zip(P, V)))


def cv_components(models: DataFrame, background_order: int = 2) -> DataFrame:
    return relative_components(models.withColumn("state", F.col("context")), models, background_order)


def estimated_states(models: DataFrame, order: int) -> DataFrame:
    """The closest state of every word of ``order`` symbols in every model."""
    words = models.sparkSession.range(1).select(F.explode(all_words_column(order)).alias("probe"))
    return closest_state(words, models, order).select("model_id", F.col("probe").alias("context"), F.col("context").alias("state"), "count", *P)


def pairs_of(left: DataFrame, right: DataFrame) -> DataFrame:
    """All pairs of model ids: the size of the result itself."""
    return left.select(F.col("model_id").alias("left_id")).distinct().crossJoin(right.select(F.col("model_id").alias("right_id")).distinct())


def _flat(x: np.ndarray) -> np.ndarray:
    return x.reshape(len(x), -1)


def _products(a: np.ndarray, in_a: np.ndarray, b: np.ndarray, in_b: np.ndarray, lengths: np.ndarray) -> dict[str, np.ndarray]:
    """The sums ``dot``, ``left2`` and ``right2`` over shared components."""
    return {"dot": _flat(a) @ _flat(b).T, "left2": (a * a).sum(2) @ in_b.T.astype(float), "right2": in_a.astype(float) @ (b * b).sum(2).T}


def _cosine(sums: dict[str, np.ndarray], otherwise: float, finish: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """What ``finish`` makes of the cosine; ``otherwise`` where nothing is shared or a side is zero."""
    if "dot" not in sums:
        return np.full(sums["n"].shape, otherwise)
    usable = (sums["left2"] > 0) & (sums["right2"] > 0)
    return np.where(usable, finish(sums["dot"] / np.where(usable, np.sqrt(sums["left2"]) * np.sqrt(sums["right2"]), 1.0)), otherwise)


def _halved(r: np.ndarray) -> np.ndarray:
    return 0.5 * (1 - r)


def _angle(r: np.ndarray) -> np.ndarray:
    return 2 * np.arccos(np.clip(r, -1.0, 1.0)) / np.pi


def _cosine_distance(components: Callable[[DataFrame], DataFrame], left: DataFrame, right: DataFrame, otherwise: float, finish: Callable[[np.ndarray], np.ndarray], per_id: int = 0) -> DataFrame:
    one = components(left)
    return grid.pairs(one, one if right is left else components(right), left, right, list(V), lambda a, b: _cosine(grid.shared_sums(a, b, _products), otherwise, finish), per_id, symmetric=True)


def d2(left: DataFrame, right: DataFrame) -> DataFrame:
    return _cosine_distance(raw_components, left, right, 1.0, _halved)


def dv(left: DataFrame, right: DataFrame) -> DataFrame:
    return _cosine_distance(raw_components, left, right, 1.0, _angle)


def dvstar(left: DataFrame, right: DataFrame, background_order: int = 0) -> DataFrame:
    return _cosine_distance(lambda m: star_components(m, background_order), left, right, 1.0, _angle)


def d2star(left: DataFrame, right: DataFrame) -> DataFrame:
    return _cosine_distance(d2star_components, left, right, 1.0, _halved)


def cv(left: DataFrame, right: DataFrame, background_order: int = 2) -> DataFrame:
    return _cosine_distance(lambda m: cv_components(m, background_order), left, right, 0.0, _halved)


def cv_estimation(left: DataFrame, right: DataFrame, order: int = 6, background_order: int = 2) -> DataFrame:
    return _cosine_distance(lambda m: relative_components(estimated_states(m, order), m, background_order), left, right, 0.0, _halved, 4**order)


def penalized_dvstar(left: DataFrame, right: DataFrame, background_order: int = 0, symmetric: bool = False) -> DataFrame:
    """dvstar and, to a quarter, the share of the left model's contexts that the right one lacks.

    ``symmetric`` also counts contexts that only the right one holds.
    """
    usable = [f"u_{v[-1]}" for v in V]

    def parts(models: DataFrame) -> DataFrame:
        # contexts too short for a component count as held
        stars = star_components(models, background_order).select("model_id", "context", *(F.col(v).alias(u) for v, u in zip(V, usable)))
        return models.select("model_id", "context").join(stars, ["model_id", "context"], "left").withColumn("counts", F.col(usable[0]).isNotNull().cast("double")).na.fill(0.0, usable)

    def products(a, in_a, b, in_b, lengths):
        return _products(a[:, :, :4], a[:, :, 4], b[:, :, :4], b[:, :, 4], lengths)

    def value(a: grid.Side, b: grid.Side) -> np.ndarray:
        sums = grid.shared_sums(a, b, products)
        n_left, n_right = np.bincount(a.owner, minlength=a.n)[:, None], np.bincount(b.owner, minlength=b.n)[None, :]
        missing, contexts = n_left - sums["n"], n_left + 0 * sums["n"]
        if symmetric:
            missing, contexts = missing + n_right - sums["n"], contexts + n_right - sums["n"]
        return 0.75 * _cosine(sums, 1.0, _angle) + 0.25 * missing / contexts

    one = parts(left)
    return grid.pairs(one, one if right is left else parts(right), left, right, [*usable, "counts"], value, symmetric=symmetric)


def nearest_dvstar(left: DataFrame, right: DataFrame, background_order: int = 0, symmetric: bool = False) -> DataFrame:
    """dvstar in which a context the right model lacks is held against that model's closest state.

    ``symmetric`` does the same for contexts only the right model holds.  The
    closest state's components take their background from the missing context's
    own background context.
    """

    def scaled(side: grid.Side, contexts: list[str], closest: bool) -> tuple[np.ndarray, np.ndarray]:
        p, held = side.exact(contexts)
        background, _ = side.exact([c[max(0, len(c) - background_order) :] for c in contexts])
        p = side.closest(contexts) if closest else p
        return np.where(background > 0, p / np.sqrt(np.where(background > 0, background, 1.0)), 0.0), held

    def one_way(one: grid.Side, other: grid.Side, lacking: bool) -> dict[str, np.ndarray]:
        """Sums over the contexts of ``one``, of those alone that ``other`` lacks if asked."""
        total = dict.fromkeys(("n", "dot", "one2", "other2"), np.zeros((one.n, other.n)))
        for some in grid.chunks([c for c in one.contexts if len(c) > background_order]):
            (a, in_a), (b, in_b) = scaled(one, some, False), scaled(other, some, True)
            a, counted = a * in_a[:, :, None], ~in_b if lacking else np.ones_like(in_b)
            b = b * counted[:, :, None]
            parts = {"n": in_a.astype(float) @ counted.T.astype(float), "dot": _flat(a) @ _flat(b).T, "one2": (a * a).sum(2) @ counted.T.astype(float), "other2": in_a.astype(float) @ (b * b).sum(2).T}
            total = {name: total[name] + part for name, part in parts.items()}
        return total

    def value(a: grid.Side, b: grid.Side) -> np.ndarray:
        there = one_way(a, b, False)
        sums = {"n": there["n"], "dot": there["dot"], "left2": there["one2"], "right2": there["other2"]}
        if symmetric:
            back = one_way(b, a, True)
            sums = {"n": sums["n"] + back["n"].T, "dot": sums["dot"] + back["dot"].T, "left2": sums["left2"] + back["other2"].T, "right2": sums["right2"] + back["one2"].T}
        return _cosine(sums, 1.0, _angle)

    return grid.pairs(left, right, left, right, list(P), value, symmetric=symmetric)


def word_probabilities(models: DataFrame, order: int) -> DataFrame:
    """``model_id, word, p``: the chance of every word of ``order`` symbols from its start under each model."""
    spark = models.sparkSession
    words = spark.range(1).select(F.explode(all_words_column(order)).alias("word"))
    at = words.select("word", F.explode(F.sequence(F.lit(0), F.lit(order - 1))).alias("i"))
    at = at.select("word", F.left("word", F.col("i")).alias("probe"), F.substring(F.col("word"), F.col("i") + 1, F.lit(1)).alias("symbol"))
    states = closest_state(at.select("probe").distinct(), models, order)
    chance = F.lit(0.0)
    for s, p in zip(SYMBOLS, P):
        chance = F.when(F.col("symbol") == s, F.col(p)).otherwise(chance)
    return at.join(states, "probe").groupBy("model_id", "word").agg(F.exp(F.sum(F.log(chance))).alias("p"))


def _divergence(a: np.ndarray, in_a: np.ndarray, b: np.ndarray, in_b: np.ndarray, lengths: np.ndarray) -> dict[str, np.ndarray]:
    """``s``: the sum of (l - r) ln(l / r) where both are above 0, ``terms`` of them; ``length`` of the shared contexts."""
    a, b = _flat(a), _flat(b)
    has_a, has_b = (a > 0).astype(float), (b > 0).astype(float)
    log_a, log_b = np.log(np.where(a > 0, a, 1.0)), np.log(np.where(b > 0, b, 1.0))
    s = (a * log_a) @ has_b.T + has_a @ (b * log_b).T - a @ log_b.T - log_a @ b.T
    return {"s": s, "terms": has_a @ has_b.T, "length": (in_a * lengths) @ in_b.T.astype(float)}


def _divergence_distance(components: Callable[[DataFrame], DataFrame], left: DataFrame, right: DataFrame, values: list[str], finish: Callable[[dict[str, np.ndarray]], np.ndarray]) -> DataFrame:
    """``finish`` of the sums; null where nothing is shared or usable."""

    def value(a: grid.Side, b: grid.Side) -> np.ndarray:
        sums = grid.shared_sums(a, b, _divergence)
        return np.where(sums["n"] > 0, finish(sums), np.nan) if "s" in sums else np.full(sums["n"].shape, np.nan)

    one = components(left)
    return grid.pairs(one, one if right is left else components(right), left, right, values, value, symmetric=True)


def kl(left: DataFrame, right: DataFrame, order: int = 4) -> DataFrame:
    """Symmetrised mean of the divergences between word probabilities, per symbol.

    Words are scored where blocks of models meet, so no table has a row per word and
    model; a model without a root has nulls.
    """

    def ready(_: None) -> Callable[[pa.Table], WordScores]:
        every = Words(all_words(order), all_words(order), order)

        def make(rows: pa.Table) -> WordScores:
            side = WordScores(rows, every)
            side.p = np.exp(np.concatenate([ll for _, ll in side.parts()], 1)) * side.rooted[:, None]
            return side

        return make

    def value(a: WordScores, b: WordScores) -> np.ndarray:
        none = np.zeros((a.n, 1)), np.zeros((b.n, 1))
        sums = _divergence(a.p[:, :, None], none[0], b.p[:, :, None], none[1], np.zeros(1))
        return np.where(sums["terms"] > 0, sums["s"] / (2 * order), np.nan)

    one = log_scores(left)
    return grid.pairs(one, one if right is left else log_scores(right), left, right, [*S, "count"], value, prepare=ready, symmetric=True)


def kl_both(left: DataFrame, right: DataFrame) -> DataFrame:
    """Symmetrised divergence of context frequencies over shared contexts, per mean length; null without length."""
    parts = lambda m: _with_root(m).select("model_id", "context", (F.col("count") / F.col("root")).alias("p"))
    return _divergence_distance(parts, left, right, ["p"], lambda sums: np.where(sums["length"] > 0, sums["s"] / 2 / (sums["length"] / sums["n"]), np.nan))


def kl_both_background(left: DataFrame, right: DataFrame) -> DataFrame:
    """The same over context and next symbol, each against its expectation under the root."""

    def parts(models: DataFrame) -> DataFrame:
        rows = _with_root(models)
        values = [((F.col("count") / F.col("root")) * F.col(p) / F.sqrt(F.col(f"r_{p[-1]}"))).alias(v) for p, v in zip(P, V)]
        return rows.select("model_id", "context", *values)

    return _divergence_distance(parts, left, right, list(V), lambda sums: sums["s"] / 2 / (sums["length"] / sums["n"] + 1))


def _root_scaled(models: DataFrame) -> DataFrame:
    return _with_root(models).select("model_id", "context", *((F.col(p) / F.sqrt(F.col(f"r_{p[-1]}"))).alias(v) for p, v in zip(P, V)))


def _termwise(term: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> grid.Kernel:
    """Sums ``s`` of a term of both sides' components of a context; contexts where it is NaN don't count, ``terms`` do."""

    def kernel(a: np.ndarray, in_a: np.ndarray, b: np.ndarray, in_b: np.ndarray, lengths: np.ndarray) -> dict[str, np.ndarray]:
        s, terms = np.zeros((len(a), len(b))), np.zeros((len(a), len(b)))
        for i in range(len(a)):
            held = np.flatnonzero(in_a[i])
            found = term(a[i, held][None], b[:, held]).sum(2)
            counts = in_b[:, held] & ~np.isnan(found)
            s[i], terms[i] = np.where(counts, found, 0.0).sum(1), counts.sum(1)
        return {"s": s, "terms": terms}

    return kernel


def jensen_shannon(left: DataFrame, right: DataFrame, compat: bool = False) -> DataFrame:
    """Mean divergence of both sides from their average, over shared contexts; ``compat`` averages the right side with itself."""

    def term(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        both = (a > 0) & (b > 0)
        a, b = np.where(both, a, 1.0), np.where(both, b, 1.0)
        m = b if compat else (a + b) / 2
        return np.where(both, 0.5 * a * np.log(a / m) + 0.5 * b * np.log(b / m), 0.0)

    one = _root_scaled(left)
    return grid.pairs(one, one if right is left else _root_scaled(right), left, right, list(V), lambda a, b: (s := grid.shared_sums(a, b, _termwise(term))).get("s", s["n"]), symmetric=not compat)


def canberra(left: DataFrame, right: DataFrame) -> DataFrame:
    """Sum of |l - r| / (l + r) over shared contexts and symbols; contexts in which both are 0 don't count, null if none does."""

    def value(a: grid.Side, b: grid.Side) -> np.ndarray:
        sums = grid.shared_sums(a, b, _termwise(lambda x, y: np.abs(x - y) / (x + y)))
        return np.where((sums["n"] > 0) & (sums["terms"] == 0), np.nan, sums["s"]) if "s" in sums else sums["n"]

    one = raw_components(left)
    return grid.pairs(one, one if right is left else raw_components(right), left, right, list(V), value, symmetric=True)


def correlation(left: DataFrame, right: DataFrame, compat: bool = False) -> DataFrame:
    """1 less the correlation of shared components; ``compat`` divides by the left norm twice."""

    def kernel(a: np.ndarray, in_a: np.ndarray, b: np.ndarray, in_b: np.ndarray, lengths: np.ndarray) -> dict[str, np.ndarray]:
        return _products(a, in_a, b, in_b, lengths) | {"sl": a.sum(2) @ in_b.T.astype(float), "sr": in_a.astype(float) @ b.sum(2).T}

    def value(a: grid.Side, b: grid.Side) -> np.ndarray:
        sums = grid.shared_sums(a, b, kernel)
        if "dot" not in sums:
            return np.full(sums["n"].shape, np.nan)
        over = lambda x, y, z: sums[x] - sums[y] * sums[z] / np.maximum(4 * sums["n"], 1)
        left2, right2 = over("left2", "sl", "sl"), over("right2", "sr", "sr")
        norm = left2 if compat else np.sqrt(np.maximum(left2, 0)) * np.sqrt(np.maximum(right2, 0))
        # variances this small are rounding
        return np.where((left2 > 1e-12) & (right2 > 1e-12), 1 - over("dot", "sl", "sr") / norm, np.nan)

    one = raw_components(left)
    return grid.pairs(one, one if right is left else raw_components(right), left, right, list(V), value, symmetric=not compat)


REGISTRY: dict[str, Callable[..., DataFrame]] = {
    "d2": d2, "dv": dv, "dvstar": dvstar, "nearest-dvstar": nearest_dvstar, "penalized-dvstar": penalized_dvstar, "d2star": d2star, "cv": cv,
    "cv-estimation": cv_estimation, "kl": kl, "kl-both": kl_both, "kl-both-background": kl_both_background, "jensenshannon": jensen_shannon,
    "canberra": canberra, "correlation": correlation,
}


def register(name: str, distance: Callable[..., DataFrame]) -> None:
    REGISTRY[name] = distance


def distance(name: str, left: DataFrame, right: DataFrame | None = None, as_float: bool = False, **options) -> DataFrame:
    """Any registered distance between two model sets (or within one); ``as_float`` narrows values to single precision."""
    from . import sampling  # noqa: F401  registers the sampled distances

    if name not in REGISTRY:
        raise ValueError(f"unknown distance: {name}")
    out = REGISTRY[name](left, left if right is None else right, **options)
    value = F.col("value").cast("float").cast("double") if as_float else F.col("value")
    return out.select("left_id", "right_id", F.lit(name).alias("name"), value.alias("value"))
