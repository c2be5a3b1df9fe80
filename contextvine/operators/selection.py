"""Choosing hyper-parameters by information criteria.

The loosest model is trained once.  Every stricter setting keeps a subset of its
contexts with the same probabilities, and a context's largest subtree delta says
at which thresholds it stays, so a grid needs no retraining.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.symbols import P, SYMBOLS, parent, suffixes
from ..session import stored
from .scoring import log_likelihood
from .training import child_counts, followers, nodes, with_delta, with_probabilities
from .words import word_counts

ROWS = 4_000_000  # contexts times settings of a task


def count_grid(least: int, most: int) -> list[int]:
    """Steps of 1 below 10, of 10 below 100, of 100 below 1000, then of 1000; ``most`` closes the list."""
    out, n = [], least
    while n < most:
        out.append(n)
        n += 1 if n < 10 else 10 if n < 100 else 100 if n < 1000 else 1000
    return [*out, most]


def threshold_grid(start: float = 1.3, steps: int = 500, step: float = 0.1) -> list[float]:
    return [round(start + k * step, 10) for k in range(steps)]


def information_criteria(seqs: DataFrame, models: DataFrame) -> DataFrame:
    """BIC, AIC and AICc of each sequence under its own model; n counts N too."""
    sizes = child_counts(models).groupBy("model_id").agg((3 * F.sum((F.col("n_children") < 4).cast("long"))).alias("n_params"), F.min("count").alias("observed_min_count"), F.max(F.length("context")).cast("long").alias("observed_max_depth"))
    return _criteria(log_likelihood(seqs, models, own=True).join(sizes, "model_id")).drop("seq_id", "n_scored", "length")


def _criteria(rows: DataFrame) -> DataFrame:
    k, n, ll = F.col("n_params"), F.col("length"), F.col("ll")
    aic = 2 * k - 2 * ll
    return rows.withColumn("bic_score", k * F.log(n) - 2 * ll).withColumn("aic_score", aic).withColumn("aicc_score", aic + F.try_divide((2 * k * k + 2 * k).cast("double"), (n - k - 1).cast("double")))


def _log_gains(words: DataFrame, contexts: DataFrame) -> DataFrame:
    """Contexts with ``gain``: what the log-likelihood gains where a context replaces its parent, over all it precedes.

    The root's gain is the log-likelihood under the root alone, so the gains of a
    suffix-closed set of contexts add up to its log-likelihood.
    """
    last = F.right("word", F.lit(1))
    sums = [F.sum(F.when(last == s, F.col("n")).otherwise(0)).alias(f"n_{s.lower()}") for s in SYMBOLS]
    seen = words.groupBy("model_id", F.left("word", F.length("word") - 1).alias("context")).agg(*sums)
    above = contexts.select("model_id", F.col("context").alias("above"), *(F.col(p).alias(f"above_{p}") for p in P))
    own = contexts.withColumn("above", F.when(F.col("context") != "", parent(F.col("context")))).join(above, ["model_id", "above"], "left")
    counted = own.join(seen, ["model_id", "context"], "left").na.fill(0, [f"n_{s.lower()}" for s in SYMBOLS])
    term = lambda s, p: F.col(f"n_{s.lower()}") * (F.log(F.col(p)) - F.coalesce(F.log(F.col(f"above_{p}")), F.lit(0.0)))
    return counted.select("model_id", "context", "depth", "count", "delta", sum((term(s, p) for s, p in zip(SYMBOLS, P)), F.lit(0.0)).alias("gain"))


def parameter_grid(seqs: DataFrame, min_counts: Iterable[int], max_depths: Iterable[int], thresholds: Iterable[float], pseudo_count: float = 1.0, changes: bool = False) -> DataFrame:
    """One row of criteria per sequence and setting, from one plan.

    Under a support setting a context survives all thresholds up to its largest
    subtree delta, and is terminal above the fourth largest of its children's.  So
    each context adds its gain to the log-likelihood, and one to the terminal
    count, over an interval of thresholds: running sums over the thresholds at which
    something ends give every setting, and neither sequences nor models are met
    again.  A model's contexts are in one task, so settings multiply no shuffle.

    ``changes``: of thresholds that give the same model only the largest, the one
    that ``best_parameters`` takes.
    """
    counts, depths, cuts = sorted(set(min_counts)), sorted(set(max_depths)), sorted(set(map(float, thresholds)))
    top = len(cuts)
    words = stored(word_counts(seqs, max(depths) + 1), "words")
    contexts = stored(with_probabilities(nodes(words, seqs, max(depths), min(counts)), followers(words, min(counts)), pseudo_count), "contexts")
    contexts = stored(with_delta(contexts), "contexts")
    key = ["model_id", "min_count", "max_depth"]
    # how many thresholds of the grid a value reaches
    reach = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda t: t <= F.col("delta")))
    gains = _log_gains(words, contexts).withColumn("last", F.when(F.col("context") == "", F.lit(top)).otherwise(reach))
    parts = max(int(seqs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(-(-contexts.count() * len(counts) * len(depths) // ROWS), 100_000))
    settings = F.explode(F.array(*(F.struct(F.lit(c).alias("min_count"), F.lit(d).alias("max_depth")) for c in counts for d in depths))).alias("s")
    rows = gains.repartition(parts, "model_id").select("model_id", "context", "depth", "count", "gain", "last", settings).select("*", "s.*")
    rows = rows.where((F.col("context") == "") | ((F.col("count") >= F.col("min_count")) & (F.col("depth") <= F.col("max_depth"))))
    ends = F.when(F.col("context") == "", F.array(F.lit(""))).otherwise(F.filter(suffixes(F.col("context"), 1 << 20), lambda x: x != ""))
    own = lambda c: F.max(F.when(F.col("end") == F.col("context"), F.col(c))).alias(c)
    most = rows.withColumn("end", F.explode(ends)).groupBy(*key, "end").agg(F.max("last").alias("last"), own("gain"), own("count")).where("count is not null")
    # the up to four children of a context, and the root by itself
    first = F.left("end", F.lit(1))
    of = lambda c, s: F.max(F.when(first == s, F.col(c))).alias(f"{c}_{s}")
    each = [*SYMBOLS, ""]
    kin = most.groupBy(*key, F.when(F.col("end") != "", parent(F.col("end"))).alias("above")).agg(*(of(c, s) for c in ("last", "gain", "count") for s in each))
    ended = lambda last, gain, least, deepest, terminal, inner, length: F.struct(last.alias("last"), gain.alias("gain"), least.alias("least"), deepest.cast("long").alias("deepest"), F.lit(terminal).alias("terminal"), F.lit(inner).alias("inner"), length.cast("long").alias("length"))
    none = F.lit(None).cast("long")
    parts_of = [ended(F.col(f"last_{s}"), F.col(f"gain_{s}"), F.col(f"count_{s}"), F.length("above") + 1 if s else F.lit(0), 1, 0, none if s else F.col("count_")) for s in each]
    all_four = F.when(sum((F.col(f"last_{s}").isNotNull().cast("int") for s in SYMBOLS), F.lit(0)) == 4, F.least(*(F.col(f"last_{s}") for s in SYMBOLS)))
    parts_of.append(ended(all_four, F.lit(None).cast("double"), none, none, 0, 1, none))
    points = kin.select(*key, F.explode(F.filter(F.array(*parts_of), lambda x: x["last"] > 0)).alias("x")).select(*key, "x.*")
    points = points.groupBy(*key, "last").agg(F.sum("gain").alias("gain"), F.sum("terminal").alias("terminal"), F.sum("inner").alias("inner"), F.min("least").alias("least"), F.max("deepest").alias("deepest"), F.max("length").alias("length"))
    order = Window.partitionBy(*key).orderBy(F.col("last").desc())
    above = order.rowsBetween(Window.unboundedPreceding, 0)
    summed = points.select(
        *key, "last", F.max("length").over(above).alias("length"), F.sum(F.coalesce("gain", F.lit(0.0))).over(above).alias("ll"),
        (3 * (F.sum("terminal").over(above) - F.sum("inner").over(above))).alias("n_params"),
        F.min("least").over(above).alias("observed_min_count"), F.max("deepest").over(above).alias("observed_max_depth"),
        F.coalesce(F.lead("last").over(order), F.lit(0)).alias("next"),
    )
    at = F.col("last") if changes else F.explode(F.sequence(F.col("next") + 1, F.col("last")))
    placed = summed.withColumn("at", at).withColumn("threshold", F.element_at(F.array(*map(F.lit, cuts)), F.col("at")))
    return _criteria(placed).select(F.col("model_id").alias("seq_id"), "min_count", "max_depth", "threshold", "bic_score", "aic_score", "aicc_score", F.col("ll").alias("log_likelihood"), "n_params", "observed_min_count", "observed_max_depth")


def best_parameters(grid: DataFrame, criterion: str = "bic_score") -> DataFrame:
    """The setting of least criterion for each sequence; ties (to six places) to the stricter one by threshold, count, then depth."""
    return best_by(grid, [criterion]).drop("criterion")


def best_by(grid: DataFrame, criteria: list[str]) -> DataFrame:
    """The same by each of some criteria, named in ``criterion``, from one pass over the grid."""
    setting = F.struct(*(c for c in grid.columns if c != "seq_id"))
    order = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.round(c, 6), -F.col("threshold"), -F.col("min_count"), F.col("max_depth")))
    best = grid.groupBy("seq_id").agg(*(F.min_by(setting, order(c)).alias(c) for c in criteria))
    rows = best.select("seq_id", F.explode(F.array(*(F.struct(F.lit(c).alias("criterion"), F.col(c).alias("best")) for c in criteria))).alias("x"))
    return rows.where("x.best is not null").select("seq_id", "x.criterion", "x.best.*")
