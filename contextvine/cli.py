"""Command line: ``python -m contextvine COMMAND ...``."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from .operators import distances, scoring, selection, training, vectors
from .sources import records, sinks
from .sources.trees import load_models, to_tree_text


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="contextvine", description="Variable-length Markov chains over sequence files")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, text: str, threshold: float | None = None) -> argparse.ArgumentParser:
        p = commands.add_parser(name, help=text)
        p.add_argument("-o", "--output", help="where the result goes; the screen if not given")
        p.add_argument("--pseudo-count", type=float, default=1.0)
        if threshold is not None:
            p.add_argument("input", help="FASTA or FASTQ file, gzipped or not, or a list of files")
            p.add_argument("-d", "--max-depth", type=int, default=15)
            p.add_argument("-c", "--min-count", type=int, default=100)
            p.add_argument("-k", "--threshold", type=float, default=threshold)
            p.add_argument("-n", "--number-of-parameters", type=int, default=192)
            p.add_argument("-p", "--pruning-method", choices=("cutoff", "parameters", "none"), default="cutoff")
            p.add_argument("-e", "--estimator", choices=tuple(training.ESTIMATORS), default="KL")
        return p

    command("train", "one model of a whole file", 3.9075)
    command("batch-train", "one model of each record", 1.2)
    score = command("score", "score sequences under models")
    score.add_argument("models")
    score.add_argument("sequences")
    score.add_argument("-b", "--background-order", type=int, default=0)
    score.add_argument("-a", "--background-adjusted", action="store_true")
    score.add_argument("-r", "--both-strands", action="store_true")
    dist = command("distances", "distances between models")
    dist.add_argument("models")
    dist.add_argument("-y", "--models-to")
    dist.add_argument("-n", "--name", default="dvstar")
    dist.add_argument("-s", "--order", type=int, default=6)
    dist.add_argument("-b", "--background-order", type=int, default=0)
    windows = command("windows", "scores of sliding windows")
    windows.add_argument("models")
    windows.add_argument("sequences")
    windows.add_argument("-i", "--window-sizes", type=int, nargs="+", default=[300])
    windows.add_argument("-b", "--background-order", type=int, default=0)
    windows.add_argument("-a", "--background-adjusted", action="store_true")
    windows.add_argument("-r", "--with-reversed", action="store_true")
    select = command("select", "choose hyper-parameters by information criteria")
    select.add_argument("input")
    select.add_argument("--min-depth", type=int, default=3)
    select.add_argument("--max-depth", type=int, default=9)
    select.add_argument("--min-count", type=int, default=2)
    select.add_argument("--max-count", type=int, default=5000)
    select.add_argument("--criterion", choices=("bic_score", "aic_score", "aicc_score"), default="bic_score")
    vector = command("vectors", "composition vectors of models")
    vector.add_argument("models")
    vector.add_argument("-s", "--order", type=int, default=6)
    vector.add_argument("-b", "--background-order", type=int, default=0)
    return top


#: Options a distance takes besides the models.
_OPTIONS = {"order": {"cv-estimation", "kl", "nll", "nll-background"}, "background_order": {"dvstar", "nearest-dvstar", "penalized-dvstar", "cv", "cv-estimation", "nll-background"}}


def _emit(df: DataFrame, output: str | None) -> None:
    if output:
        df.write.mode("overwrite").parquet(output)
    else:
        df.show(1000, truncate=False)


def run(spark: SparkSession, args: argparse.Namespace) -> None:
    if args.command in ("train", "batch-train"):
        found = records.load_sequences(spark, args.input)
        seqs = records.concatenated(found) if args.command == "train" else found.select("seq_id", "seq")
        params = training.TrainingParams(args.max_depth, args.min_count, args.threshold, args.number_of_parameters, args.pruning_method, args.pseudo_count, args.estimator)
        models = training.train(seqs, params)
        if args.output and args.output.endswith(".parquet"):
            sinks.write_models(models, args.output)
        elif args.output:
            sinks.write_tree_texts(models, args.output, args.pseudo_count)
        else:
            for row in to_tree_text(models, args.pseudo_count).toLocalIterator():
                print(row.tree, end="")
    elif args.command == "score":
        how = "background" if args.background_adjusted else "log"
        scores = scoring.nll(records.load_sequences(spark, args.sequences).select("seq_id", "seq"), load_models(spark, args.models, args.pseudo_count), False, how, args.background_order, args.both_strands)
        _emit(scores, args.output)
    elif args.command == "distances":
        left = load_models(spark, args.models, args.pseudo_count)
        right = load_models(spark, args.models_to, args.pseudo_count) if args.models_to else left
        options = {k: getattr(args, k) for k, names in _OPTIONS.items() if args.name in names}
        found = distances.distance(args.name, left, right, **options)
        if args.output:
            sinks.write_distances(found, args.output, sinks.distance_name(args.name, **options))
        else:
            _emit(found, None)
    elif args.command == "windows":
        seqs, models = records.load_sequences(spark, args.sequences).select("seq_id", "seq"), load_models(spark, args.models, args.pseudo_count)
        if args.with_reversed:
            found = scoring.sliding_windows_both(seqs, models, args.window_sizes)
        else:
            found = scoring.sliding_windows(seqs, models, args.window_sizes, score="background" if args.background_adjusted else "log", background_order=args.background_order)
        if args.output:
            sinks.write_windows(found, args.output)
        else:
            _emit(found, None)
    elif args.command == "select":
        seqs = records.concatenated(records.load_sequences(spark, args.input))
        grid = selection.parameter_grid(seqs, selection.count_grid(args.min_count, args.max_count), range(args.min_depth, args.max_depth + 1), selection.threshold_grid(), args.pseudo_count)
        if args.output:
            sinks.append_criteria(grid, args.output)
        _emit(selection.best_parameters(grid, args.criterion), None)
    else:
        _emit(vectors.scaled_composition_vector(load_models(spark, args.models, args.pseudo_count), args.order, args.background_order), args.output)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    from .session import local_session, ship_package

    args = parser().parse_args(argv)
    spark = spark or SparkSession.getActiveSession() or local_session()
    ship_package(spark)
    run(spark, args)
