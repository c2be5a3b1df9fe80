"""Goldens and differential tests of training."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from contextvine.functions.symbols import P, all_words, background_context, reverse_complement
from contextvine.operators import levels, training
from contextvine.operators.words import PIECE, tail_counts, tail_counts_arrow, word_counts
from contextvine.sources.trees import load_models, parse_trees, to_tree_text


def one(spark, seq, name="s"):
    return spark.createDataFrame([(name, seq)], "seq_id string, seq string")


def contexts(df):
    return {r.context for r in df.collect()}


def test_gattata_contexts_and_probabilities(spark):
    models = training.train(one(spark, "GATTATA"), max_depth=2, min_count=1, method="none")
    rows = {r.context: r for r in models.collect()}
    assert set(rows) == {"", "A", "G", "T", "AT", "GA", "TA", "TT"}
    golden = {"": (4, 1, 2, 4, 11), "A": (1, 1, 1, 3, 6), "G": (2, 1, 1, 1, 5), "T": (3, 1, 1, 2, 7), "AT": (2, 1, 1, 2, 6), "GA": (1, 1, 1, 2, 5), "TA": (1, 1, 1, 2, 5), "TT": (2, 1, 1, 1, 5)}
    for context, (*n, total) in golden.items():
        assert [rows[context][p] for p in P] == pytest.approx([x / total for x in n])
    assert rows[""]["count"] == 7


def test_gattata_pruned(spark):
    seqs = one(spark, "GATTATA")
    assert contexts(training.train(seqs, max_depth=3, min_count=2, threshold=0.2)) == {"", "A"}
    assert contexts(training.train(seqs, max_depth=3, min_count=2, n_params=6, method="parameters")) == {"", "A"}
    assert contexts(training.train(seqs, max_depth=3, min_count=2, n_params=6, estimator="none")) <= {"", "A", "T", "AT", "TA"}


def test_subtree_and_children(spark):
    models = training.train(one(spark, "GATTATA"), max_depth=2, min_count=1, method="none")
    assert contexts(training.subtree(models, "A")) == {"A", "TA", "GA"}
    assert contexts(training.children(models, "T")) == {"AT", "TT"}


def random_sequence(seed, n, letters="ACGT"):
    rng = random.Random(seed)
    return "".join(rng.choice(letters) for _ in range(n))


def brute_model(seq, depth, least):
    n = Counter(seq[i : i + k] for i in range(len(seq)) for k in range(1, depth + 2) if i + k <= len(seq) and "N" not in seq[i : i + k])
    kept = {w for w in n if len(w) <= depth and n[w] >= least} | {""}
    follow = {w: [n[w + s] if w or n[s] >= least else 0 for s in "ACGT"] for w in kept}
    p = {w: [(x + 1) / (sum(f) + 4) for x in f] for w, f in follow.items()}
    count = {w: n[w] if w else len(seq) for w in kept}
    delta = {w: count[w] * sum(a * math.log(a / b) for a, b in zip(p[w], p[w[1:]])) for w in kept if w}
    return kept, p, count, delta


def cut_leaves(kept, delta, threshold):
    kept = set(kept)
    while True:
        inner = {w[1:] for w in kept if w}
        gone = {w for w in kept if w and w not in inner and delta[w] < threshold}
        if not gone:
            return kept
        kept -= gone


def cut_to_size(kept, delta, n_params):
    kept = set(kept)
    terminal = lambda: sum(sum(s + w in kept for s in "ACGT") < 4 for w in kept)
    while 3 * terminal() > n_params:
        inner = {w[1:] for w in kept if w}
        outer = [w for w in kept if w and w not in inner]
        if not outer:
            break
        kept.remove(min(outer, key=lambda w: (delta[w], -len(w), w)))
    return kept


@pytest.mark.parametrize("seed", range(3))
def test_pruning_equals_the_iterative_one(spark, seed):
    seq = random_sequence(seed, 400, "ACGTACGTAN")
    kept, p, count, delta = brute_model(seq, 4, 2)
    loose = training.train_unpruned(one(spark, seq), training.TrainingParams(4, 2)).cache()
    rows = {r.context: r for r in loose.collect()}
    assert set(rows) == kept
    for w in kept:
        assert rows[w]["count"] == count[w] and [rows[w][x] for x in P] == pytest.approx(p[w])
        assert not w or rows[w].delta == pytest.approx(delta[w])
    for threshold in (0.3, 1.2, 3.9075):
        assert contexts(training.cutoff_prune(loose, threshold)) == cut_leaves(kept, delta, threshold)
    for n_params in (12, 60, 192):
        assert contexts(training.parameters_prune(loose, n_params)) == cut_to_size(kept, delta, n_params)


def test_counts_across_pieces_of_a_long_sequence(spark):
    seq = random_sequence(9, 2 * PIECE + 37, "ACGTACGTN")
    for length, engine in ((3, "sql"), (3, "arrow"), (12, "arrow"), (12, "sql")):
        want = Counter(seq[i : i + k] for i in range(len(seq)) for k in range(1, length + 1) if i + k <= len(seq) and "N" not in seq[i : i + k])
        assert {r.word: r.n for r in word_counts(one(spark, seq), length, engine).collect()} == dict(want)
    cut = {(r.tail, r.n) for r in tail_counts_arrow(one(spark, seq), 4, 50).collect()}
    assert cut == {(r.tail, r.n) for r in tail_counts(one(spark, seq), 4).collect()}


def test_levels_equal_all_words(spark, sf_dir, monkeypatch):
    """Default depth and support on whole documents; small pieces, blocks and portions on a skewed sequence."""
    from contextvine.sources.records import document_sequences

    docs = document_sequences(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    rows = lambda df: sorted((r.model_id, r.context, r["count"], *(round(r[p], 9) for p in P), r.delta) for r in df.collect())
    got = rows(training.train_unpruned(docs, training.TrainingParams()))
    assert got == rows(training.train_unpruned(docs, training.TrainingParams(words="all"))) and len(got) > docs.count()

    monkeypatch.setattr(levels, "PORTION", 0.05)
    monkeypatch.setattr(levels, "PIECES", 2)
    seqs = one(spark, random_sequence(3, 1500, "AAAAAAAAACGT") + "N" + "A" * 700 + "ACGTACGTN" * 60).unionByName(one(spark, random_sequence(4, 900, "AC"), "t")).unionByName(one(spark, "", "none"))
    for depth, least in ((14, 20), (7, 1), (3, 5), (30, 60)):
        kept, size = training.TrainingParams(depth, least), levels.level_words(seqs, depth + 1, least, step=3, size=64)
        want = {(r.model_id, r.word): r.n for r in word_counts(seqs, depth + 1).collect()}
        found = {(r.model_id, r.word): r.n for r in size.collect()}
        assert found.items() <= want.items()
        assert {(m, w) for (m, w), n in want.items() if len(w) == 1 or want[m, w[:-1]] >= least} <= set(found)
        assert rows(training.train_unpruned(seqs, kept)) == rows(training.train_unpruned(seqs, training.TrainingParams(depth, least, words="all")))
    with pytest.raises(ValueError):
        levels.level_words(seqs, 32, 1)


def test_loaded_models_prune_as_trained(spark, tmp_path):
    """Deltas are not in the text: they are taken from what was read, and a missing one prunes nothing."""
    models = training.train(one(spark, random_sequence(11, 900, "AAACGT")), max_depth=4, min_count=2, threshold=0.3)
    text = to_tree_text(models)
    text.write.parquet(str(tmp_path / "t.parquet"))
    loaded = load_models(spark, str(tmp_path / "t.parquet"))
    rows = {r.context: r for r in loaded.collect()}
    delta = {w: r["count"] * sum(r[p] * math.log(r[p] / rows[w[1:]][p]) for p in P) for w, r in rows.items() if w}
    assert all(rows[w].delta == pytest.approx(d) for w, d in delta.items())
    for threshold in (0.5, 1.2, 3.9075):
        want = cut_leaves(set(rows), delta, threshold)
        assert contexts(training.cutoff_prune(loaded, threshold)) == want == contexts(training.reprune_similarity(loaded, threshold))
    assert 1 < len(contexts(training.cutoff_prune(loaded, 1.2))) < len(rows)
    unknown = loaded.withColumn("delta", F.lit(None).cast("double"))
    assert contexts(training.cutoff_prune(unknown, 3.9075)) == set(rows)
    loaded.drop("delta").write.parquet(str(tmp_path / "c.parquet"))
    assert contexts(training.cutoff_prune(load_models(spark, str(tmp_path / "c.parquet")), 1.2)) == contexts(training.cutoff_prune(loaded, 1.2))


def test_empty_and_unusual_sequences(spark):
    seqs = spark.createDataFrame([("empty", ""), ("n", "NNN"), ("one", "A")], "seq_id string, seq string")
    rows = {(r.model_id, r.context): r["count"] for r in training.train(seqs, max_depth=2, min_count=1, method="none").collect()}
    assert rows == {("empty", ""): 0, ("n", ""): 3, ("one", ""): 1, ("one", "A"): 1}
    assert training.train(seqs.limit(0), max_depth=2, min_count=1).count() == 0


def test_tree_text_round_trip(spark, tmp_path):
    models = training.train(one(spark, random_sequence(4, 300)), max_depth=3, min_count=2, threshold=0.5)
    back = {r.context: r for r in parse_trees(to_tree_text(models)).collect()}
    for r in models.collect():
        assert back[r.context]["count"] == r["count"] and back[r.context].model_id == "s"
    text = to_tree_text(models).head(1)[0].tree
    assert text.startswith("Name: s\n") and "Node:  # [" in text
    path = tmp_path / "s.tree"
    path.write_text(text)
    assert contexts(load_models(spark, str(path))) == contexts(models)
    models.write.parquet(str(tmp_path / "m.parquet"))
    assert contexts(load_models(spark, str(tmp_path / "m.parquet"))) == contexts(models)
    with pytest.raises(ValueError):
        load_models(spark, "x.csv")


def test_reads_a_sample_line(spark):
    tree = "Name: x\nNode:  # [ 1 0 0 1 ] 7 [ 3 0 1 3 ][ 0 -1 -1 3 ]\nNode:  3 TA [ 1 0 0 0 ] 2 [ 0 0 0 1 ][ -1 -1 -1 -1 ]\n"
    rows = {r.context: r for r in parse_trees(spark.createDataFrame([(tree,)], "tree string")).collect()}
    assert rows["TA"]["count"] == 2 and rows["TA"].p_t == pytest.approx(2 / 5) and rows[""].p_a == pytest.approx(4 / 11)


def test_words_and_backgrounds(spark):
    assert all_words(2) == ["AA", "AC", "AG", "AT", "CA", "CC", "CG", "CT", "GA", "GC", "GG", "GT", "TA", "TC", "TG", "TT"]
    cases = [("AACG", 2, "CG"), ("AACG", 3, "ACG"), ("AACG", 1, "G"), ("ACG", 2, "CG"), ("CG", 2, "CG"), ("G", 2, "G")]
    for word, order, want in cases:
        assert spark.range(1).select(background_context(F.lit(word), order).alias("b")).head().b == want
    assert spark.range(1).select(reverse_complement(F.lit("AACGN")).alias("b")).head().b == "NCGTT"


def test_size_reached(spark):
    seq = random_sequence(5, 3000)
    pruned = training.train(one(spark, seq), max_depth=15, min_count=4, method="parameters", estimator="none", n_params=192)
    assert training.model_sizes(pruned).head().n_params == 192
