"""Table functions in SQL, registered scores and estimators, bucketed tables."""

import glob
import math
import re

import pytest
from pyspark.sql import functions as F

from contextvine.functions import tables
from contextvine.operators import scoring, training, words
from contextvine.sources import sinks
from contextvine.sources.trees import load_models


@pytest.fixture(scope="module")
def trained(spark):
    seqs = spark.createDataFrame([(f"s{k}", "ACGTTGCA" * (3 + k % 4) + "GATTACA" * (k % 5)) for k in range(60)], "seq_id string, seq string")
    seqs = seqs.unionByName(spark.createDataFrame([("empty", ""), ("none", None)], seqs.schema)).withColumn("other", F.lit(1)).cache()
    return seqs, training.train(seqs.where("seq is not null"), max_depth=3, min_count=2, threshold=0.1).cache()


def test_sql_functions(spark, trained):
    seqs, models = trained
    tables.register(spark)
    seqs.createOrReplaceTempView("t_seqs")
    models.createOrReplaceTempView("t_models")
    found = spark.sql("SELECT * FROM pattern_search(TABLE(t_seqs), array('A', 'TT', 'TTGCAA', '', NULL, 'A'))").collect()
    patterns = spark.createDataFrame([("A",), ("TT",), ("TTGCAA",), ("",)], "pattern string")
    want = words.search(seqs.where("seq is not null"), patterns).collect()
    assert sorted(map(tuple, found)) == sorted((r.seq_id, r.pattern, r.pos) for r in want)
    found = spark.sql("SELECT * FROM model_subtree(TABLE(t_models), 'CA') ORDER BY 1, 2").collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, training.subtree(models, "CA").select("model_id", "context", "count").collect()))
    drawn = lambda seed: sorted(map(tuple, spark.sql(f"SELECT * FROM model_sample(TABLE(t_models) PARTITION BY (model_id), 300, {seed})").collect()))
    one = drawn(1)
    assert len(one) == models.select("model_id").distinct().count() and all(len(s) == 300 and set(s) <= set("ACGT") for _, s in one)
    assert one == drawn(1) != drawn(2)
    assert spark.sql("SELECT * FROM pattern_search(TABLE(SELECT * FROM t_seqs WHERE false), array('A'))").collect() == []


def test_registered_score_and_estimator(spark, trained):
    seqs, models = trained
    scoring.register_score("half_log", lambda p, b: 0.5 * F.log(p))
    one = {r.seq_id: r.ll for r in scoring.log_likelihood(seqs.where("seq <> ''"), models, own=True).collect()}
    half = {r.seq_id: r.ll for r in scoring.log_likelihood(seqs.where("seq <> ''"), models, own=True, score="half_log").collect()}
    assert half.keys() == one.keys() and all(half[i] == pytest.approx(x / 2) for i, x in one.items())
    scoring.register_score("excess", lambda p, b: F.log(p / b), background=True)
    rows = scoring.nll(seqs.where("seq <> ''"), models, score="excess").collect()
    assert len(rows) == 60 * 61 and any(r.nll < 0 for r in rows)
    with pytest.raises(ValueError):
        scoring.nll(seqs, models, score="nothing")
    training.register_estimator("twice", lambda own, above, count: 2 * training.kl_delta(own, above, count))
    keep = seqs.where("seq is not null")
    doubled = training.train(keep, max_depth=3, min_count=2, threshold=0.2, estimator="twice")
    assert sorted((r.model_id, r.context) for r in doubled.collect()) == sorted((r.model_id, r.context) for r in models.collect())
    assert all(math.isfinite(r.delta) for r in doubled.collect())


def test_buckets(spark, trained, tmp_path):
    models = trained[1]
    path = str(tmp_path / "m.parquet")
    sinks.write_models(models, path, buckets=5)
    assert 0 < len(glob.glob(f"{path}/**/*.parquet", recursive=True)) <= 5
    key = lambda df: sorted((r.model_id, r.context, r["count"], r.p_a) for r in df.collect())
    assert key(sinks.read_bucketed(spark, path)) == key(models) == key(load_models(spark, path))
    one = sinks.read_bucketed(spark, path, model_id="s7")
    # the bucket is known before the folder is listed
    pruned = lambda df, n: re.search(rf"PartitionFilters: \[[^\]]*bucket{n}#\d+ = \d+", df._jdf.queryExecution().executedPlan().toString())
    assert key(one) == key(models.where("model_id = 's7'")) and pruned(one, 5)
    assert sinks.read_bucketed(spark, path, model_id="nobody").collect() == []
    texts = str(tmp_path / "texts")
    sinks.write_tree_texts(models, texts, buckets=3)
    assert len(glob.glob(f"{texts}/**/*.txt", recursive=True)) <= 3
    assert sorted((r.model_id, r.context, r["count"]) for r in load_models(spark, texts).collect()) == sorted((r.model_id, r.context, r["count"]) for r in models.collect())
    windows = scoring.sliding_windows(trained[0].where("seq <> ''"), models, [4], own=True)
    sinks.write_windows(windows, str(tmp_path / "w"), buckets=4)
    pair = sinks.read_bucketed(spark, str(tmp_path / "w"), seq_id="s3", model_id="s3")
    assert pair.count() == windows.where("seq_id = 's3'").count() > 0 and pruned(pair, 4)


def test_long_sequences_are_several_units(spark, trained, monkeypatch):
    from contextvine.operators import grid

    seqs, models = trained[0].where("seq is not null").drop("other"), trained[1].where("model_id < 's2'")
    rows = lambda strands: {(r.seq_id, r.model_id): r.nll for r in scoring.nll(seqs, models, both_strands=strands).collect()}
    whole = rows(False), rows(True)
    monkeypatch.setattr(grid, "IDS", 4)
    monkeypatch.setattr(grid, "ROWS", 20)
    monkeypatch.setattr(grid, "blocks", lambda df, id_, per_id=0: 2)
    assert rows(False) == pytest.approx(whole[0], nan_ok=True) and rows(True) == pytest.approx(whole[1], nan_ok=True)


def test_rows_are_carried_to_few_cells(spark):
    """Each row goes to as many cells as the other side has blocks; tiles, not blocks, bound what is dense at once."""
    from contextvine.operators import grid

    ids = spark.range(40_000).selectExpr("cast(id as string) AS model_id")
    assert 4 <= grid.blocks(ids, "model_id") <= 6
    assert grid.blocks(ids, "model_id", per_id=250) == pytest.approx(10, abs=1)  # ROWS bounds a block too


def test_context_sets_meet_in_blocks(spark, monkeypatch):
    """Counts of the union and shared contexts by blocks, against the union itself; no pair is shuffled."""
    from contextvine.operators import grid, vectors

    left = spark.createDataFrame([("a", ""), ("a", "A"), ("a", "CA"), ("b", ""), ("c", "T")], "model_id string, context string")
    right = spark.createDataFrame([("x", ""), ("x", "CA"), ("y", "G"), ("y", "T")], "model_id string, context string")
    monkeypatch.setattr(grid, "IDS", 1)
    union = vectors.context_union(left, right).groupBy("left_id", "right_id").agg(F.sum((F.col("in_left") & F.col("in_right")).cast("long")), F.sum((~F.col("in_right")).cast("long")), F.sum((~F.col("in_left")).cast("long")))
    sizes = vectors.union_sizes(left, right)
    assert {tuple(r) for r in sizes.collect()} == {tuple(r) for r in union.collect()} and sizes.count() == 6
    assert {tuple(r) for r in vectors.shared_contexts(left, right).collect()} == {("a", "x", ""), ("a", "x", "CA"), ("a", "y", ""), ("b", "x", ""), ("b", "y", ""), ("c", "x", ""), ("c", "y", "T")}
