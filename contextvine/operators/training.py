"""Training: counts, next-symbol probabilities, and pruning by support and information.

A model is a table of contexts: ``model_id, context, depth, count, p_a, p_c, p_g,
p_t, delta`` (all rows are included ones).  The empty context is the root: its
count is the sequence's length, N included.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.symbols import P, SYMBOLS, parent, suffixes
from ..session import stored
from .levels import FOLLOWERS, level_followers, spell, words_of
from .words import symbols_of, word_counts

ROOT_DELTA = 1.7976931348623157e308


@dataclass(frozen=True)
class TrainingParams:
    """``method``: ``cutoff`` keeps contexts by ``threshold``, ``parameters`` the best ``n_params``, ``none`` all.

    ``words``: ``levels`` extends only words with support, ``all`` counts every word up to the depth.
    """

    max_depth: int = 15
    min_count: int = 100
    threshold: float = 3.9075
    n_params: int = 192
    method: str = "cutoff"
    pseudo_count: float = 1.0
    estimator: str = "KL"
    words: str = "levels"


def roots(seqs: DataFrame) -> DataFrame:
    return seqs.select(F.col("seq_id").alias("model_id"), F.lit("").alias("context"), symbols_of(seqs).alias("count"))


def nodes(words: DataFrame, seqs: DataFrame, max_depth: int, min_count: int) -> DataFrame:
    """Support pruning: words of at most ``max_depth`` symbols seen at least ``min_count`` times, and the roots."""
    return _supported(words, max_depth, min_count).unionByName(roots(seqs))


def _supported(words: DataFrame, max_depth: int, min_count: int) -> DataFrame:
    return words.where((F.length("word") <= max_depth) & (F.col("n") >= min_count)).select("model_id", F.col("word").alias("context"), F.col("n").alias("count"))


def followers(words: DataFrame, min_count: int) -> DataFrame:
    """``model_id, context, n_a..n_t``: how often each symbol follows; the root knows only letters with support."""
    last = F.right("word", F.lit(1))
    counted = words.where((F.length("word") > 1) | (F.col("n") >= min_count))
    sums = [F.sum(F.when(last == s, F.col("n")).otherwise(0)).alias(f"n_{s.lower()}") for s in SYMBOLS]
    return counted.groupBy("model_id", F.left("word", F.length("word") - 1).alias("context")).agg(*sums)


def with_probabilities(kept: DataFrame, following: DataFrame, pseudo_count: float = 1.0) -> DataFrame:
    """Probabilities with a pseudo count for each of the four symbols."""
    joined = kept.join(following, ["model_id", "context"], "left").na.fill(0, list(FOLLOWERS))
    return _shares(joined, pseudo_count)


def _shares(counted: DataFrame, pseudo_count: float) -> DataFrame:
    total = sum((F.col(n) for n in FOLLOWERS), F.lit(0)) + F.lit(4 * pseudo_count)
    share = [((F.col(n) + F.lit(pseudo_count)) / total).alias(p) for n, p in zip(FOLLOWERS, P)]
    return counted.select("model_id", "context", F.length("context").alias("depth"), "count", *share)


def _level_contexts(seqs: DataFrame, params: TrainingParams) -> DataFrame:
    """The contexts with support and their probabilities, where words are numbers until they are known to be contexts.

    Counts of contexts and of what follows them meet in one aggregation.
    """
    rows = level_followers(seqs, params.max_depth + 1, params.min_count)
    key, none = ["seq_id", "k", "code"], [F.lit(0).cast("long").alias(n) for n in FOLLOWERS]
    kept = words_of(rows.where(F.col("k") < params.max_depth), max(1, params.min_count)).select(*key, F.col("n").alias("count"), F.lit(1).alias("kept"), *none)
    whole = seqs.select(F.col("seq_id").cast("string"), F.lit(0).alias("k"), F.lit(0).cast("long").alias("code"), symbols_of(seqs).alias("count"), F.lit(1).alias("kept"), *none)
    # the root knows only letters with support
    known = (F.when((F.col("k") > 0) | (F.col(n) >= params.min_count), F.col(n)).otherwise(0).alias(n) for n in FOLLOWERS)
    following = rows.select(*key, F.lit(None).cast("long").alias("count"), F.lit(0).alias("kept"), *known)
    met = kept.unionByName(whole).unionByName(following).groupBy(*key).agg(F.sum("count").alias("count"), F.max("kept").alias("kept"), *(F.sum(n).alias(n) for n in FOLLOWERS))
    context = F.when(F.col("k") == 0, "").otherwise(spell(F.col("code"), F.col("k")))
    return _shares(met.where("kept = 1").select(F.col("seq_id").cast(seqs.schema["seq_id"].dataType).alias("model_id"), context.alias("context"), "count", *FOLLOWERS), params.pseudo_count)


def kl_delta(own: Callable[[str], Column], above: Callable[[str], Column], count: Column) -> Column:
    """Information a context adds to its parent's distribution, weighted by its count."""
    terms = (F.when(own(p) > 0, own(p) * F.log(own(p) / above(p))).otherwise(0.0) for p in P)
    return count * sum(terms, F.lit(0.0))


def zero_delta(own: Callable[[str], Column], above: Callable[[str], Column], count: Column) -> Column:
    """The estimator that tells no context from its parent."""
    return F.lit(0.0)


Estimator = Callable[[Callable[[str], Column], Callable[[str], Column], Column], Column]
ESTIMATORS: dict[str, Estimator] = {"KL": kl_delta, "none": zero_delta}


def register_estimator(name: str, value: Estimator) -> None:
    """Make an estimator known by name to training: the worth of a context from its own and its parent's probabilities and its count."""
    ESTIMATORS[name] = value


def with_delta(contexts: DataFrame, estimator: str = "KL") -> DataFrame:
    """The estimator's value of every context against its parent; the root has the largest double.

    A context whose parent is not in the table (a loaded model may lack some) has none.
    """
    above = contexts.select("model_id", F.col("context").alias("above"), *(F.col(p).alias(f"above_{p}") for p in P))
    rows = contexts.where("context <> ''").withColumn("above", parent(F.col("context"))).join(above, ["model_id", "above"], "left")
    value = ESTIMATORS[estimator](F.col, lambda p: F.col(f"above_{p}"), F.col("count"))
    columns = ["model_id", "context", "depth", "count", *P]
    return rows.select(*columns, value.alias("delta")).unionByName(contexts.where("context = ''").select(*columns, F.lit(ROOT_DELTA).alias("delta")))


def subtree_delta(contexts: DataFrame) -> DataFrame:
    """``model_id, context, most``: the largest delta among a context and all that end with it.

    A context is kept at a threshold exactly if this reaches it, so one table
    answers every threshold.
    """
    ends = F.filter(suffixes(F.col("context"), 1 << 20), lambda s: s != "")
    return contexts.where("context <> ''").select("model_id", F.explode(ends).alias("context"), "delta").groupBy("model_id", "context").agg(F.max("delta").alias("most"))


def cutoff_prune(contexts: DataFrame, threshold: float) -> DataFrame:
    """Remove leaves whose delta is below the threshold until none is: what stays is every suffix of an informative context.

    A context without a delta is not known to be uninformative and stays.
    """
    kept = suffixes(F.col("context"), 1 << 20)
    keep = contexts.where((F.col("delta") >= threshold) | F.col("delta").isNull() | (F.col("context") == "")).select("model_id", F.explode(kept).alias("context")).distinct()
    return contexts.join(keep, ["model_id", "context"], "left_semi")


def parameters_prune(contexts: DataFrame, n_params: int) -> DataFrame:
    """Remove leaves of least delta until three times the terminal contexts are at most ``n_params``.

    A context goes once all that end with it are gone, so the order of removal is
    by the largest delta of its subtree, deeper ones first; ties (to nine places, so
    that sums in another order agree) go by context.
    Removing one takes a terminal context away unless its parent turns terminal.
    A window per model: its rows are the contexts of one model.
    """
    rows = contexts.join(subtree_delta(contexts), ["model_id", "context"], "left")
    order = [F.round("most", 9), F.col("depth").desc(), F.col("context")]
    siblings = Window.partitionBy("model_id", "above")
    rows = rows.withColumn("above", F.when(F.col("context") != "", parent(F.col("context"))))
    others = rows.where("context <> ''").withColumn("n_siblings", F.count("*").over(siblings)).withColumn("nth", F.row_number().over(siblings.orderBy(*order)))
    per_model = model_sizes(contexts).select("model_id", "n_terminal")
    falls = F.when((F.col("n_siblings") == 4) & (F.col("nth") == 1), 0).otherwise(1)
    ordered = others.join(per_model, "model_id").withColumn("left_before", F.col("n_terminal") - F.coalesce(F.sum(falls).over(Window.partitionBy("model_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    kept = ordered.where(F.col("left_before") * 3 <= n_params)
    return kept.select(contexts.columns).unionByName(contexts.where("context = ''"))


def reprune_similarity(contexts: DataFrame, threshold: float = 3.9075) -> DataFrame:
    """A stricter threshold on a trained or loaded model; deltas are taken from the model's own probabilities."""
    return cutoff_prune(with_delta(contexts.drop("delta")), threshold)


def reprune_support(contexts: DataFrame, min_count: int, max_depth: int) -> DataFrame:
    """Stricter support on a trained model; the root stays."""
    return contexts.where((F.col("context") == "") | ((F.col("count") >= min_count) & (F.col("depth") <= max_depth)))


def train_unpruned(seqs: DataFrame, params: TrainingParams) -> DataFrame:
    """Contexts with support, their probabilities and deltas.

    Counts, the one large table, and the contexts are each read several times by
    what follows, so each is written once.
    """
    length = params.max_depth + 1
    if params.words == "levels" and length <= 31:
        return with_delta(stored(_level_contexts(seqs, params), "contexts"), params.estimator)
    words = stored(word_counts(seqs, length), "words")
    kept = nodes(words, seqs, params.max_depth, params.min_count)
    contexts = stored(with_probabilities(kept, followers(words, params.min_count), params.pseudo_count), "contexts")
    return with_delta(contexts, params.estimator)


def train_files(records: DataFrame, params: TrainingParams, per: str = "path") -> DataFrame:
    """``train_unpruned`` of ``records.concatenated(records)``, whose sequences are not made: no word reaches over the N between records."""
    words = stored(word_counts(records.select(F.col(per).alias("seq_id"), "seq"), params.max_depth + 1), "words")
    whole = records.groupBy(F.col(per).alias("model_id")).agg((F.sum(F.length("seq").cast("long")) + F.count("*") - 1).alias("count")).withColumn("context", F.lit(""))
    kept = _supported(words, params.max_depth, params.min_count).unionByName(whole)
    contexts = stored(with_probabilities(kept, followers(words, params.min_count), params.pseudo_count), "contexts")
    names = records.groupBy(F.col(per).alias("model_id")).agg(F.array_sort(F.collect_list(F.struct("ord", "seq_id"))).alias("r"))
    names = names.select("model_id", F.array_join(F.transform("r", lambda x: x["seq_id"]), "|").alias("name"))
    found = with_delta(contexts, params.estimator)
    return found.join(names, "model_id").select(F.col("name").alias("model_id"), *(c for c in found.columns if c != "model_id"))


def train(seqs: DataFrame, params: TrainingParams = TrainingParams(), **changes) -> DataFrame:
    """One model per sequence, all in one plan."""
    params = replace(params, **changes)
    contexts = train_unpruned(seqs, params)
    if params.method == "cutoff" and params.estimator != "none":
        # with deltas, which both sides of what prunes would else compute
        return cutoff_prune(stored(contexts, "deltas"), params.threshold)
    if params.method in ("cutoff", "parameters"):  # without information there is only the size to go by
        return parameters_prune(contexts, params.n_params)
    return contexts


def child_counts(models: DataFrame) -> DataFrame:
    """``model_id, context, n_children``: how many included contexts extend each one to the left by one symbol."""
    children = models.where("context <> ''").groupBy("model_id", parent(F.col("context")).alias("context")).agg(F.count("*").alias("n_children"))
    return models.join(children, ["model_id", "context"], "left").na.fill(0, ["n_children"])


def leaves(models: DataFrame) -> DataFrame:
    """Contexts that no included context ends with."""
    above = models.where("context <> ''").select("model_id", parent(F.col("context")).alias("context")).distinct()
    return models.join(above, ["model_id", "context"], "left_anti")


def terminal_nodes(models: DataFrame) -> DataFrame:
    """Contexts of which at least one left extension is missing."""
    return child_counts(models).where("n_children < 4").drop("n_children")


def model_sizes(models: DataFrame) -> DataFrame:
    """Nodes, terminal nodes, parameters, deepest context and observed support of each model."""
    return child_counts(models).groupBy("model_id").agg(
        F.count("*").alias("n_nodes"), F.sum((F.col("n_children") < 4).cast("long")).alias("n_terminal"), (3 * F.sum((F.col("n_children") < 4).cast("long"))).alias("n_params"),
        F.max(F.length("context")).cast("long").alias("max_order"), F.min("count").alias("observed_min_count"),
    )


def subtree(models: DataFrame, start: str) -> DataFrame:
    """All contexts that end with ``start``, itself included."""
    return models.where(F.col("context").endswith(start))


def children(models: DataFrame, context: str) -> DataFrame:
    return models.where((F.length("context") == len(context) + 1) & F.col("context").endswith(context))


def estimated_counts(models: DataFrame, pseudo_count: float = 1.0) -> DataFrame:
    """Counts of followers read back from the probabilities."""
    back = [F.round(F.col(p) * (F.col("count") + 4 * pseudo_count) - pseudo_count).cast("long").alias(f"n_{s.lower()}") for s, p in zip(SYMBOLS, P)]
    return models.select("model_id", "context", "count", *back)


def diagnostics(models: DataFrame, loose: DataFrame) -> DataFrame:
    """Every context with support: delta, whether it is a leaf, terminal, and included in ``models``."""
    status = child_counts(models).select("model_id", "context", F.lit(True).alias("included"), (F.col("n_children") == 0).alias("is_leaf"), (F.col("n_children") < 4).alias("is_terminal"))
    return loose.join(status, ["model_id", "context"], "left").na.fill(False, ["included", "is_leaf", "is_terminal"])
