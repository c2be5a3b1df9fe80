"""Automata of models: the table by its definition, and walking against looking states up."""

import math
import random

import pytest
from pyspark.sql import functions as F

from contextvine.operators import automaton as A
from contextvine.operators import grid, scoring, training


def letters(seed, n, of="AAACGT"):
    rng = random.Random(seed)
    return "".join(rng.choice(of) for _ in range(n))


@pytest.fixture(scope="module")
def trained(spark):
    rows = [("a", letters(1, 700)), ("b", letters(2, 500, "ACGTN")), ("c", "ACGGT" * 120), ("empty", ""), ("n", "NNNN"), ("short", "AC")]
    seqs = spark.createDataFrame(rows, "seq_id string, seq string").cache()
    return seqs, training.train(seqs, max_depth=6, min_count=2, threshold=0.8).cache()


def test_table_by_definition(trained):
    models = trained[1]
    held = {}
    for r in models.collect():
        held.setdefault(r.model_id, set()).add(r.context)
    rows = A.automaton(models).collect()
    want = {m: {c[:k] for c in cs for k in range(len(c) + 1)} for m, cs in held.items()}
    assert {(r.model_id, r.state) for r in rows} == {(m, q) for m, qs in want.items() for q in qs} and len(rows) == sum(map(len, want.values()))
    # some beginning is no context: without such states the walk would miss contexts
    assert any(qs != held[m] for m, qs in want.items())
    longest = lambda word, among: next(word[k:] for k in range(len(word) + 1) if word[k:] in among)
    for r in rows:
        assert r.context == longest(r.state, held[r.model_id])
        assert [r[f"next_{x}"] for x in "acgt"] == [longest(r.state + x, want[r.model_id]) for x in "ACGT"]


def same(got, want):
    got = {(r.seq_id, r.model_id): r for r in got.collect()}
    want = want.collect()
    assert len(got) == len(want)
    for r in want:
        g = got[r.seq_id, r.model_id]
        for name in set(r.asDict()) - {"seq_id", "model_id"}:
            a, b = g[name], r[name]
            assert a == pytest.approx(b, rel=1e-9) or (isinstance(b, float) and math.isnan(a) and math.isnan(b)), (r, name, a)


@pytest.mark.parametrize("own", [True, False])
def test_walking_equals_looking_up(trained, monkeypatch, own):
    seqs, models = trained
    for unit, lane, ids in ((1 << 16, 1024, 256), (16, 4, 3)):
        monkeypatch.setattr(A, "UNIT", unit)
        monkeypatch.setattr(A, "LANE", lane)
        monkeypatch.setattr(A, "CELLS", 64 * lane)
        monkeypatch.setattr(grid, "IDS", ids)
        walked = A.walk_scores(seqs, models, own)
        same(walked.select("seq_id", "model_id", "ll", "n_scored", "length"), scoring.log_likelihood(seqs, models, own))
        same(walked, scoring.nll(seqs, models, own))
    same(A.walk_scores(seqs, models, own, both_strands=True), scoring.nll(seqs, models, own, both_strands=True))
    for score, background in (("max_adjusted", 0), ("background", 1)):
        same(A.walk_scores(seqs, models, own, score, background), scoring.nll(seqs, models, own, score, background))


def test_loaded_models_and_nothing(spark, trained):
    """A model that lacks suffixes of its contexts, repeated rows, other columns, and empty tables."""
    seqs, models = trained
    few = models.where("model_id = 'a' and (context = '' or length(context) = 3)").withColumn("state", F.lit("clash")).withColumn("unit", F.lit(1))
    twice = few.unionByName(few)
    assert {r.state: len(r.state) for r in A.automaton(twice).collect()}.keys() == {r.state for r in A.automaton(few).collect()}
    same(A.walk_scores(seqs.withColumn("strand", F.lit("x")), few, False), scoring.nll(seqs, few, False))
    assert A.automaton(models.limit(0)).collect() == []
    assert A.walk_scores(seqs, models.limit(0)).collect() == [] and A.walk_scores(seqs.limit(0), models).collect() == []


def test_short_sequences_need_no_sum_of_pairs(spark, monkeypatch):
    """No table of pairs is shuffled where each sequence is one unit; blocks and strands don't matter."""
    from .test_scoring import several

    seqs, models = several(spark)
    monkeypatch.setattr(grid, "IDS", 3)
    found = A.walk_scores(seqs, models, both_strands=True)
    assert "HashAggregate" not in found._jdf.queryExecution().executedPlan().toString().split("FlatMapGroupsInArrow")[0]
    want = {(r.seq_id, r.model_id): r.nll for r in scoring.nll(seqs, models, both_strands=True).collect()}
    assert len(want) == 121 and {(r.seq_id, r.model_id): r.nll for r in found.collect()} == pytest.approx(want)
    assert {r.length for r in found.collect()} == {60}
