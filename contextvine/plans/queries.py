"""Registered queries over the driver's tables.

Sequences are the users' event strings; models are trained on them, one per user,
unless a query says otherwise.  Doubles are rounded to six places so that engines
that sum in another order agree.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tables
from ..functions.symbols import P, all_words_column, background_context, reverse_complement
from ..operators import distances as D
from ..operators import automaton as automata
from ..operators import sampling, scoring, selection, training, vectors, words
from ..operators import suffix_array as suffixes
from ..session import shared_dir, stored
from ..sources import blocks, records, sinks
from ..sources.records import document_sequences, event_sequences
from ..sources.trees import load_models, parse_trees, to_tree_text

PARAMS = training.TrainingParams(max_depth=3, min_count=2, threshold=0.5)
PATTERNS = ("A", "AT", "TTA", "NT", "ACGTACGT", "")
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_sequences(table(spark, sf_dir, "events"))


def loose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.train_unpruned(sequences(spark, sf_dir), PARAMS)


def models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.cutoff_prune(loose(spark, sf_dir), PARAMS.threshold)


def stored_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a table, for plans that read models several times."""
    return stored(models(spark, sf_dir), "models")


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*(_six_places(F.col(n)).alias(n) if kind == "double" else F.col(n) for n, kind in df.dtypes))


def _six_places(x: Column) -> Column:
    """As ``round`` does, by arithmetic where a product is exact enough: ``round`` makes a decimal number of every value."""
    near = F.when(x < 0, -F.floor(0.5 - x * 1e6)).otherwise(F.floor(x * 1e6 + 0.5)) / 1e6
    return F.when(F.abs(x) < 1e6, near).otherwise(F.round(x, 6))


def query(f: Query) -> Query:
    QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
    return f


CONTEXT = ["model_id", "context", "count", *P]


@query
def word_counts(spark, sf):
    return words.word_counts(sequences(spark, sf), 4)


@query
def document_word_counts(spark, sf):
    counted = words.word_counts(document_sequences(table(spark, sf, "documents")), 3)
    return counted.groupBy("word").agg(F.sum("n").alias("n"), F.count("*").alias("n_sequences"))


@query
def document_models(spark, sf):
    seqs = document_sequences(table(spark, sf, "documents"))
    return training.train(seqs, max_depth=2, min_count=4, threshold=3.9075).select(*CONTEXT)


@query
def level_wise_models(spark, sf):
    """Documents at the default depth and support."""
    seqs = document_sequences(table(spark, sf, "documents"))
    return training.train(seqs, max_depth=15, min_count=100, threshold=3.9075).select(*CONTEXT)


@query
def support_prune(spark, sf):
    seqs = sequences(spark, sf)
    return training.nodes(words.word_counts(seqs, 4), seqs, 3, 2)


@query
def forward_counts(spark, sf):
    return training.followers(words.word_counts(sequences(spark, sf), 4), 2)


@query
def next_probabilities(spark, sf):
    return loose(spark, sf).select(*CONTEXT)


@query
def kl_delta(spark, sf):
    return loose(spark, sf).where("context <> ''").select("model_id", "context", "count", "delta")


@query
def cutoff_prune(spark, sf):
    return models(spark, sf).select(*CONTEXT)


@query
def parameters_prune(spark, sf):
    return training.parameters_prune(loose(spark, sf), 24).select("model_id", "context", "count")


@query
def reprune_support(spark, sf):
    return training.reprune_support(models(spark, sf), 4, 2).select(*CONTEXT)


@query
def reprune_similarity(spark, sf):
    return training.cutoff_prune(models(spark, sf), 1.0).select(*CONTEXT)


@query
def pst_leaves(spark, sf):
    return training.leaves(models(spark, sf)).select("model_id", "context", "count")


@query
def terminal_nodes(spark, sf):
    return training.terminal_nodes(models(spark, sf)).select("model_id", "context", "count")


@query
def model_stats(spark, sf):
    return training.model_sizes(models(spark, sf))


@query
def pst_children(spark, sf):
    return training.children(models(spark, sf), "T").select("model_id", "context", "count")


@query
def pst_subtree(spark, sf):
    return training.subtree(models(spark, sf), "A").select("model_id", "context", "count")


@query
def sorted_contexts(spark, sf):
    return models(spark, sf).select("model_id", "context").groupBy("model_id").agg(F.array_join(F.array_sort(F.collect_list("context")), ",").alias("contexts"))


@query
def estimated_child_counts(spark, sf):
    return training.estimated_counts(models(spark, sf))


@query
def diagnostics(spark, sf):
    rows = loose(spark, sf)
    return training.diagnostics(training.cutoff_prune(rows, PARAMS.threshold), rows).select("model_id", "context", "count", "included", "is_leaf", "is_terminal")


@query
def tree_text_round_trip(spark, sf):
    return parse_trees(to_tree_text(models(spark, sf))).select(*CONTEXT)


@query
def reprune_loaded(spark, sf):
    """Models written as texts, read back and pruned more."""
    path = f"{shared_dir(spark)}/trees-{uuid.uuid4().hex}.parquet"
    sinks.write_tree_texts(models(spark, sf), path, as_table=True)
    return training.reprune_similarity(load_models(spark, path), 1.0).select(*CONTEXT)


@query
def closest_state(spark, sf):
    probes = words.positions(sequences(spark, sf), 3).select(F.col("seq_id").alias("model_id"), "probe").distinct()
    return scoring.closest_state(probes, models(spark, sf), 3)


@query
def log_likelihood(spark, sf):
    return scoring.log_likelihood(sequences(spark, sf), models(spark, sf), own=True, order=3)


@query
def likelihood(spark, sf):
    """As a logarithm again, since a likelihood of a whole sequence is 0 to six places."""
    return scoring.likelihood(sequences(spark, sf), stored_models(spark, sf), own=True).select("seq_id", "model_id", F.log("likelihood").alias("log_likelihood"))


@query
def word_likelihood(spark, sf):
    return D.word_probabilities(models(spark, sf), 3).select("model_id", "word", F.log("p").alias("log_p"))


@query
def nll(spark, sf):
    return scoring.nll(sequences(spark, sf), stored_models(spark, sf), own=True, order=3)


@query
def automaton(spark, sf):
    return automata.automaton(stored_models(spark, sf))


@query
def nll_automaton(spark, sf):
    return automata.walk_scores(sequences(spark, sf), stored_models(spark, sf), own=True).select("seq_id", "model_id", "nll")


@query
def score_matrix_automaton(spark, sf):
    return automata.walk_scores(sequences(spark, sf), stored_models(spark, sf)).select("seq_id", "model_id", "nll")


@query
def nll_max_adjusted(spark, sf):
    return scoring.nll(sequences(spark, sf), stored_models(spark, sf), own=True, score="max_adjusted", order=3)


@query
def nll_background(spark, sf):
    return scoring.nll(sequences(spark, sf), stored_models(spark, sf), own=True, score="background", background_order=1, order=3)


@query
def score_matrix(spark, sf):
    return scoring.nll(sequences(spark, sf), stored_models(spark, sf), order=3)


@query
def nll_symmetric(spark, sf):
    return scoring.nll(sequences(spark, sf), stored_models(spark, sf), both_strands=True, order=3)


@query
def nll_symmetric_own(spark, sf):
    return scoring.nll(sequences(spark, sf), stored_models(spark, sf), own=True, both_strands=True, order=3)


@query
def score_matrix_background(spark, sf):
    """Its SQL halves logs, as that of the distance of given samples does."""
    return scoring.nll(sequences(spark, sf), stored_models(spark, sf), score="background_halved", background_order=1, order=3)


@query
def reverse_complement_of(spark, sf):
    return sequences(spark, sf).select("seq_id", reverse_complement(F.col("seq")).alias("seq"))


@query
def sliding_windows(spark, sf):
    return scoring.sliding_windows(sequences(spark, sf), stored_models(spark, sf), [10], own=True)


@query
def sliding_windows_multi(spark, sf):
    return scoring.sliding_windows(sequences(spark, sf), stored_models(spark, sf), [5, 20], own=True)


@query
def sliding_windows_background(spark, sf):
    return scoring.sliding_windows(sequences(spark, sf), stored_models(spark, sf), [10], own=True, score="background", background_order=1)


@query
def sliding_windows_min_reverse(spark, sf):
    return scoring.sliding_windows_both(sequences(spark, sf), stored_models(spark, sf), [10], own=True)


@query
def information_criteria(spark, sf):
    return selection.information_criteria(sequences(spark, sf), stored_models(spark, sf))


@query
def bic_grid(spark, sf):
    return selection.parameter_grid(sequences(spark, sf), [2, 4], [2, 3], [0.5, 1.5])


@query
def bic_grid_default(spark, sf):
    """All 500 thresholds, all counts up to 20 and depths: the best setting of each sequence by each criterion."""
    grid = selection.parameter_grid(sequences(spark, sf), selection.count_grid(2, 20), [1, 2, 3], selection.threshold_grid(), changes=True)
    best = selection.best_by(grid, ["bic_score", "aic_score", "aicc_score"])
    value = F.when(F.col("criterion") == "bic_score", F.col("bic_score")).when(F.col("criterion") == "aic_score", F.col("aic_score")).otherwise(F.col("aicc_score"))
    return best.select("seq_id", "criterion", "min_count", "max_depth", "threshold", value.alias("value"))


@query
def best_parameters(spark, sf):
    grid = selection.parameter_grid(sequences(spark, sf), [2, 4], [2, 3], [0.5, 1.5])
    return selection.best_parameters(grid).select("seq_id", "threshold", "bic_score")


def _distance(name: str, registered: str, **options) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return rounded(D.distance(registered, stored_models(spark, sf), **options).drop("name"))

    QUERIES[name] = run


for _name, _registered, _options in (
    ("d2", "d2", {}), ("dv", "dv", {}), ("dvstar", "dvstar", {}), ("dvstar_bg1", "dvstar", {"background_order": 1}), ("nearest_dvstar", "nearest-dvstar", {}),
    ("penalized_dvstar", "penalized-dvstar", {}), ("d2star", "d2star", {}), ("cv", "cv", {"background_order": 1}), ("cv_estimation", "cv-estimation", {"order": 3, "background_order": 1}),
    ("kl", "kl", {"order": 3}), ("kl_both", "kl-both", {}), ("kl_both_background", "kl-both-background", {}), ("jensenshannon", "jensenshannon", {}), ("canberra", "canberra", {}),
    ("correlation", "correlation", {}), ("penalized_dvstar_symmetric", "penalized-dvstar", {"symmetric": True}), ("nearest_dvstar_symmetric", "nearest-dvstar", {"symmetric": True}),
    ("jensenshannon_compat", "jensenshannon", {"compat": True}), ("correlation_compat", "correlation", {"compat": True}),
):
    _distance(_name, _registered, **_options)


@query
def shared_contexts(spark, sf):
    m = stored_models(spark, sf)
    return vectors.shared_contexts(m, m)


@query
def context_union(spark, sf):
    m = stored_models(spark, sf)
    return vectors.union_sizes(m, m)


@query
def all_words(spark, sf):
    """All words of three symbols, in order, and how often each stands in the documents."""
    every = spark.range(1).select(F.posexplode(all_words_column(3)).alias("place", "word"))
    counted = words.word_counts(document_sequences(table(spark, sf, "documents")), 3).groupBy("word").agg(F.sum("n").alias("n"))
    return every.join(counted, "word", "left").na.fill(0, ["n"])


@query
def background_contexts(spark, sf):
    return stored_models(spark, sf).select("model_id", "context", background_context(F.col("context"), 1).alias("background"))


@query
def composition_vector(spark, sf):
    return vectors.composition_vector(stored_models(spark, sf), None, 1)


@query
def scaled_composition_vector(spark, sf):
    return vectors.scaled_composition_vector(stored_models(spark, sf), 2, 1)


@query
def adjusted_transition_vector(spark, sf):
    return vectors.adjusted_transition_vector(stored_models(spark, sf), 1)


@query
def word_frequency_vector(spark, sf):
    return vectors.word_frequency_vector(stored_models(spark, sf), 2)


@query
def adjusted_word_frequency_vector(spark, sf):
    return vectors.word_frequency_vector(stored_models(spark, sf), 2, True, 0)


@query
def search_pattern(spark, sf):
    patterns = spark.createDataFrame([(p,) for p in PATTERNS], "pattern string")
    return words.search(sequences(spark, sf), patterns)


@query
def substring_labels(spark, sf):
    return words.substring_labels(sequences(spark, sf))


@query
def tree_height(spark, sf):
    return words.height(sequences(spark, sf))


@query
def search_index(spark, sf):
    path = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    suffixes.write_index(sequences(spark, sf), path)
    return suffixes.search_index(spark, path, spark.createDataFrame([(p,) for p in PATTERNS], "pattern string"))


def _stored_sequences(spark: SparkSession, sf: str) -> DataFrame:
    return stored(sequences(spark, sf), "sequences")


def _label(start: str, length: str) -> Column:
    return F.substring(F.col("seq"), (F.col(start) + 1).cast("int"), F.col(length).cast("int"))


@query
def suffix_array(spark, sf):
    return suffixes.suffix_array(_stored_sequences(spark, sf)).table.select("seq_id", "place", "pos", "lcp")


@query
def suffix_tree_nodes(spark, sf):
    """With their texts, to compare."""
    seqs = _stored_sequences(spark, sf)
    return suffixes.tree_nodes(suffixes.suffix_array(seqs)).join(seqs, "seq_id").select("seq_id", _label("start", "length").alias("label"), "n")


@query
def suffix_links(spark, sf):
    seqs = _stored_sequences(spark, sf)
    array = suffixes.suffix_array(seqs)
    links = suffixes.suffix_links(stored(suffixes.tree_nodes(array), "nodes"), array).join(seqs, "seq_id")
    link = F.when(F.col("link_length") == 0, "").otherwise(_label("link_start", "link_length"))
    return links.select("seq_id", _label("start", "length").alias("label"), "n", link.alias("link"))


@query
def generate_sequence(spark, sf):
    return sampling.generate(stored_models(spark, sf), 100, seed=1)


def _pruned_more(spark: SparkSession, sf: str) -> DataFrame:
    return stored(training.cutoff_prune(models(spark, sf), 1.0), "models")


@query
def d2_two_sets(spark, sf):
    return D.distance("d2", stored_models(spark, sf), _pruned_more(spark, sf)).drop("name")


@query
def kl_both_two_sets(spark, sf):
    return D.distance("kl-both", stored_models(spark, sf), _pruned_more(spark, sf)).drop("name")


def _sequence_file(spark: SparkSession, sf: str, kind: str) -> str:
    """The sequences as a folder of FASTA or FASTQ text; ids hold a ``>``."""
    seqs, path = sequences(spark, sf), f"{shared_dir(spark)}/sequences-{uuid.uuid4().hex}.{kind}"
    record = "concat('>', seq_id, ' a->b\n', seq)" if kind == "fasta" else "concat('@', seq_id, ' a->b\n', seq, '\n+\n', repeat('@', length(seq)))"
    seqs.select(F.expr(record)).write.text(path)
    return path


def _trained_on(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    seqs = records.load_sequences(spark, _sequence_file(spark, sf, kind)).select("seq_id", "seq")
    return training.cutoff_prune(training.train_unpruned(seqs, PARAMS), PARAMS.threshold).select(*CONTEXT)


@query
def fasta_models(spark, sf):
    return _trained_on(spark, sf, "fasta")


@query
def fastq_models(spark, sf):
    return _trained_on(spark, sf, "fastq")


def _all_words(spark: SparkSession, length: int) -> DataFrame:
    return spark.range(1).select(F.explode(all_words_column(length)).alias("seq_id")).withColumn("seq", F.col("seq_id"))


@query
def jaccard(spark, sf):
    return sampling.jaccard(m := stored_models(spark, sf), m)


@query
def jaccard_prob(spark, sf):
    return sampling.jaccard_prob(m := stored_models(spark, sf), m)


@query
def jaccard_given_words(spark, sf):
    return sampling.jaccard(m := stored_models(spark, sf), m, length=4, words=_all_words(spark, 4))


@query
def jaccard_prob_given_words(spark, sf):
    return sampling.jaccard_prob(m := stored_models(spark, sf), m, length=4, words=_all_words(spark, 4))


@query
def nll_distance(spark, sf):
    return sampling.nll_distance(m := stored_models(spark, sf), m)


@query
def nll_distance_given_samples(spark, sf):
    seqs = sequences(spark, sf)
    return sampling.nll_distance(m := stored_models(spark, sf), m, left_samples=seqs, right_samples=seqs)


@query
def nll_background_distance(spark, sf):
    return sampling.nll_background_distance(m := stored_models(spark, sf), m, background_order=1)


@query
def nll_background_distance_given_samples(spark, sf):
    seqs = sequences(spark, sf)
    return sampling.nll_background_distance(m := stored_models(spark, sf), m, background_order=1, left_samples=seqs, right_samples=seqs, background_score="background_halved")


def _path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}-{name}"


@query
def tree_files(spark, sf):
    """Models as text files of many trees, read back from the folder."""
    sinks.write_tree_texts(models(spark, sf), path := _path(spark, "trees"), buckets=4)
    return load_models(spark, path).select(*CONTEXT)


@query
def tree_text_with_pseudo(spark, sf):
    """Follower counts as the text prints them with the pseudo count."""
    lines = to_tree_text(models(spark, sf), with_pseudo=True).select("model_id", F.explode(F.split("tree", "\n")).alias("line")).where("line like 'Node:%'")
    label = F.regexp_extract("line", r"^Node:\s+(\S+)", 1)
    counts = F.split(F.regexp_extract("line", r"\] \d+ \[ ([^\]]*) \]", 1), " ")
    return lines.select("model_id", F.when(label == "#", "").otherwise(label).alias("context"), *(F.get(counts, F.lit(k)).cast("long").alias(f"n_{x}") for k, x in enumerate("acgt")))


@query
def models_by_id(spark, sf):
    """Three of all models, each read from its bucket."""
    sinks.write_models(models(spark, sf), path := _path(spark, "models.parquet"))
    parts = [sinks.read_bucketed(spark, path, model_id=i).select(*CONTEXT) for i in ("1", "2", "30")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def windows_stored(spark, sf):
    sinks.write_windows(scoring.sliding_windows(sequences(spark, sf), stored_models(spark, sf), [10], own=True), path := _path(spark, "windows"))
    return sinks.read_bucketed(spark, path)


@query
def vectors_stored(spark, sf):
    sinks.write_vectors(vectors.composition_vector(stored_models(spark, sf), None, 1), path := _path(spark, "vectors"))
    return spark.read.parquet(path)


@query
def scores_stored(spark, sf):
    sinks.write_scores(scoring.nll(sequences(spark, sf), stored_models(spark, sf), own=True, order=3), path := _path(spark, "scores"))
    return spark.read.parquet(path)


@query
def distances_stored(spark, sf):
    m = stored_models(spark, sf)
    name = sinks.distance_name("dvstar", background_order=0)
    # as they are returned: to six places, of which a file needs a third of the bytes
    sinks.write_distances(rounded(D.distance("dvstar", m).drop("name")), path := _path(spark, "distances"), name)
    return spark.read.parquet(path).where(F.col("name") == name)


@query
def criteria_log(spark, sf):
    """A grid search appended to a log in two runs, as the log has it."""
    path = _path(spark, "criteria.csv")
    for threshold in (0.5, 1.5):
        sinks.append_criteria(selection.parameter_grid(sequences(spark, sf), [2, 4], [2, 3], [threshold]), path)
    kinds = ", ".join(f"{c} {'double' if c in ('bic_score', 'aic_score', 'aicc_score', 'threshold', 'log_likelihood') else 'long'}" for c in sinks.CRITERIA)
    return spark.read.option("header", True).schema(kinds).csv(path)


@query
def file_model(spark, sf):
    """One model of a whole file: its records with an N between."""
    path = _path(spark, "one.fasta")
    ordered = sequences(spark, sf).repartitionByRange(1, "seq_id").sortWithinPartitions("seq_id")
    ordered.select(F.expr("concat('>', seq_id, '\n', seq)")).write.text(path)
    return training.cutoff_prune(training.train_files(records.load_sequences(spark, path), PARAMS), PARAMS.threshold).select(*CONTEXT)


@query
def listed_files(spark, sf):
    """Records of the files that a list names: half of them FASTA, half FASTQ."""
    seqs, path = sequences(spark, sf), _path(spark, "list.txt")
    even = F.col("seq_id").cast("long") % 2 == 0
    fasta, fastq = _path(spark, "half.fasta"), _path(spark, "half.fastq")
    seqs.where(even).select(F.expr("concat('>', seq_id, '\n', seq)")).write.text(fasta)
    seqs.where(~even).select(F.expr("concat('@', seq_id, '\n', seq, '\n+\n', repeat('I', length(seq)))")).write.text(fastq)
    spark.createDataFrame([(fasta,), (fastq,)], "value string").write.text(path)
    return records.load_sequences(spark, path).select("seq_id", "seq")


scoring.register_score("root", lambda p, _: F.sqrt(p))
training.register_estimator("chi_square", lambda own, above, count: count * sum(((own(p) - above(p)) * (own(p) - above(p)) / above(p) for p in P), F.lit(0.0)))


@query
def foreign_score(spark, sf):
    """A score of the user's own: roots of probabilities instead of logarithms."""
    return scoring.nll(sequences(spark, sf), stored_models(spark, sf), own=True, score="root", order=3)


@query
def foreign_estimator(spark, sf):
    """Training with an estimator of the user's own: the chi-square distance of a context from its parent."""
    return training.train(sequences(spark, sf), PARAMS, estimator="chi_square").select(*CONTEXT)


def _views(spark: SparkSession, sf: str) -> None:
    tables.register(spark)
    sequences(spark, sf).createOrReplaceTempView("contextvine_seqs")
    stored_models(spark, sf).createOrReplaceTempView("contextvine_models")


@query
def search_sql(spark, sf):
    _views(spark, sf)
    return spark.sql("SELECT * FROM pattern_search(TABLE(contextvine_seqs), array('A', 'AT', 'TTA', 'NT', 'ACGTACGT', ''))")


@query
def subtree_sql(spark, sf):
    _views(spark, sf)
    return spark.sql("SELECT * FROM model_subtree(TABLE(contextvine_models), 'A')")


@query
def sample_sql(spark, sf):
    _views(spark, sf)
    return spark.sql("SELECT * FROM model_sample(TABLE(contextvine_models) PARTITION BY (model_id), 50, 1)")


@query
def block_files(spark, sf):
    """Documents as block-gzip FASTA files, read back by ranges of bytes: each letter's count."""
    blocks.write_block_fasta(document_sequences(table(spark, sf, "documents")), path := _path(spark, "blocks"))
    read = blocks.read_block_fasta(spark, path, 1 << 18)
    counted = {x: F.length("seq") - F.length(F.replace("seq", F.lit(x), F.lit(""))) for x in "ACGTN"}
    return read.select("seq_id", F.length("seq").cast("long").alias("length"), *(n.cast("long").alias(f"n_{x.lower()}") for x, n in counted.items()))
