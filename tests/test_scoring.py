"""Analytic and brute-force tests of scoring, windows, distances and selection."""

import math

import pytest
from pyspark.sql import functions as F

from contextvine.functions.symbols import P
from contextvine.operators import distances, sampling, scoring, selection, training, vectors, words
from contextvine.sources import records, sinks
from tests.test_training import brute_model, cut_leaves, one, random_sequence

MODEL = "model_id string, context string, depth int, count long, p_a double, p_c double, p_g double, p_t double, delta double"
BINARY = "A" * 10 + "TA" * 5 + "A" * 4 + "T"


def hand_made(spark, deep):
    rows = [("m", "", 0, 476, 0.8, 0.0, 0.0, 0.2, None)]
    if deep:
        rows += [("m", "A", 1, 434, 0.9, 0.0, 0.0, 0.1, None), ("m", "T", 1, 42, 1.0, 0.0, 0.0, 0.0, None)]
    return spark.createDataFrame(rows, MODEL)


def test_order_zero_and_one(spark):
    seqs = one(spark, BINARY)
    r = scoring.log_likelihood(seqs, hand_made(spark, False)).head()
    n_a, n_t = BINARY.count("A"), BINARY.count("T")
    assert r.ll == pytest.approx(n_a * math.log(0.8) + n_t * math.log(0.2)) and r.n_scored == len(BINARY)
    after_t = BINARY.count("TA")
    r = scoring.log_likelihood(seqs, hand_made(spark, True)).head()
    assert r.ll == pytest.approx(math.log(0.8) + (n_a - 1 - after_t) * math.log(0.9) + n_t * math.log(0.1))
    assert r.n_scored == len(BINARY) - after_t  # a certain step scores 0 and is not counted


def brute_scores(model, seq, skip_n=True):
    out = []
    for i, s in enumerate(seq):
        context = seq[max(0, i - 8) : i]
        while context not in model:
            context = context[1:]
        out.append(math.log(model[context]["ACGT".index(s)]) if s in "ACGT" else None if skip_n else 0.0)
    return out


@pytest.fixture(scope="module")
def trained(spark):
    seqs = {"a": random_sequence(1, 200, "ACGTAAN"), "b": random_sequence(2, 150, "ACGTTTN")}
    df = spark.createDataFrame(list(seqs.items()), "seq_id string, seq string")
    models = training.train(df, max_depth=3, min_count=2, threshold=0.5).cache()
    brute = {}
    for k, s in seqs.items():
        kept, p, _, delta = brute_model(s, 3, 2)
        brute[k] = {w: p[w] for w in cut_leaves(kept, delta, 0.5)}
    return seqs, df, models, brute


def test_matrix_strands_and_windows(trained):
    seqs, df, models, brute = trained
    flip = str.maketrans("ACGT", "TGCA")

    def value(m, s):
        scores = [x for x in brute_scores(brute[m], s) if x is not None]
        return -sum(scores) / sum(x != 0 for x in scores)

    got = {(r.seq_id, r.model_id): r.nll for r in scoring.nll(df, models).collect()}
    both = {(r.seq_id, r.model_id): r.nll for r in scoring.score_matrix(df, models).collect()}
    for s in seqs:
        for m in seqs:
            assert got[s, m] == pytest.approx(value(m, seqs[s]))
            assert both[s, m] == pytest.approx(min(value(m, seqs[s]), value(m, seqs[s].translate(flip)[::-1])))
    rows = {(r.seq_id, r.pos): r.nll for r in scoring.sliding_windows(df, models, [7], own=True).collect()}
    for s in seqs:
        scores = brute_scores(brute[s], seqs[s], False)
        for i in range(len(scores)):
            part = scores[max(0, i - 6) : i + 1]
            n = sum(x != 0 for x in part)
            assert rows[s, i] == pytest.approx(-sum(part) / n if n else -1.0)


def test_windows_across_stretches(trained, monkeypatch):
    _, df, models, _ = trained
    whole = sorted((r.seq_id, r.window_size, r.pos, round(r.nll, 9)) for r in scoring.sliding_windows(df, models, [3, 7], own=True).collect())
    monkeypatch.setattr(scoring, "STRETCH", 20)
    assert sorted((r.seq_id, r.window_size, r.pos, round(r.nll, 9)) for r in scoring.sliding_windows(df, models, [3, 7], own=True).collect()) == whole


def test_nothing_to_score(spark, trained):
    _, _, models, _ = trained
    seqs = spark.createDataFrame([("none", ""), ("n", "NN")], "seq_id string, seq string")
    assert all(math.isnan(r.nll) for r in scoring.nll(seqs, models).collect())


def test_distances_are_symmetric_and_zero_on_the_diagonal(trained):
    _, _, models, _ = trained
    for name in ("d2", "dv", "dvstar", "d2star", "cv", "kl", "kl-both", "kl-both-background", "jensenshannon", "canberra", "penalized-dvstar", "nearest-dvstar"):
        rows = {(r.left_id, r.right_id): r.value for r in distances.distance(name, models).collect()}
        assert set(rows) == {(x, y) for x in "ab" for y in "ab"}
        assert rows["a", "a"] == pytest.approx(0, abs=1e-6), name
        if name not in ("penalized-dvstar", "nearest-dvstar"):
            assert rows["a", "b"] == pytest.approx(rows["b", "a"], nan_ok=True), name
    with pytest.raises(ValueError):
        distances.distance("no such", models)


def test_no_shared_context_is_far(spark, trained):
    _, _, models, _ = trained
    root = models.where("context = ''").withColumn("model_id", F.lit("root"))
    assert {r.value for r in distances.distance("dvstar", models, root).collect()} == {1.0}
    assert vectors.shared_contexts(models, root).where("context <> ''").count() == 0


def test_search(spark):
    patterns = spark.createDataFrame([(p,) for p in ("A", "C", "AC", "ACGT", "")], "pattern string")
    found = {}
    for r in words.search(one(spark, "CACAC"), patterns).collect():
        found.setdefault(r.pattern, []).append(r.pos)
    assert {k: sorted(v) for k, v in found.items()} == {"A": [1, 3], "C": [0, 2, 4], "AC": [1, 3], "": [0, 1, 2, 3, 4, 5]}
    starts = one(spark, "CACAC").select(words.find(F.col("seq"), F.lit("CAC")).alias("f")).head().f
    assert starts == [0, 2]


def test_labels_of_cacac(spark):
    rows = {r.label: r.n for r in words.substring_labels(one(spark, "CACAC"), 10).collect()}
    assert rows == {"C": 3, "AC": 2, "CAC": 2, "ACAC": 1, "CACAC": 1, "": 1}


def test_grid_equals_single_models(trained):
    _, df, _, _ = trained
    grid = {(r.seq_id, r.min_count, r.max_depth, r.threshold): r for r in selection.parameter_grid(df, [2, 3], [2, 3], [0.5, 2.0]).collect()}
    assert len(grid) == 16
    loose = training.train_unpruned(df, training.TrainingParams(3, 2))
    strict = training.cutoff_prune(training.reprune_support(loose, 3, 2), 2.0)
    for r in selection.information_criteria(df, strict).collect():
        assert grid[r.model_id, 3, 2, 2.0].bic_score == pytest.approx(r.bic_score)
        assert grid[r.model_id, 3, 2, 2.0].n_params == r.n_params
    assert selection.count_grid(2, 35) == [2, 3, 4, 5, 6, 7, 8, 9, 10, 20, 30, 35]


def test_sampling_follows_the_model(spark, trained):
    _, _, models, _ = trained
    first, again = (sampling.generate(models, 300, seed=5).orderBy("model_id").collect() for _ in range(2))
    assert first == again and all(len(r.seq) == 300 and set(r.seq) <= set("ACGT") for r in first)
    for name in ("jaccard", "jaccard-prob", "nll", "nll-background"):
        options = {"order": 30} if name.startswith("nll") else {"n": 50, "length": 5}
        assert distances.distance(name, models, **options).count() == 4


def test_records(spark, tmp_path):
    (tmp_path / "x.fa").write_text(">one first\nACGT\nacgu\n>two\nNNXA\n")
    rows = {r.seq_id: r.seq for r in records.load_sequences(spark, str(tmp_path / "x.fa")).collect()}
    assert rows == {"one first": "ACGTACGT", "two": "NNNA"}
    joined = records.concatenated(records.load_sequences(spark, str(tmp_path / "x.fa"))).head()
    assert joined.seq_id == "one first|two" and joined.seq == "ACGTACGTNNNNA"
    (tmp_path / "x.fastq").write_text("@r1\nACGT\n+\n!!!!\n@r2\nGG\n+\n@@\n")
    assert {r.seq_id: r.seq for r in records.load_sequences(spark, str(tmp_path / "x.fastq")).collect()} == {"r1": "ACGT", "r2": "GG"}
    (tmp_path / "list.txt").write_text(f"{tmp_path}/x.fa\n{tmp_path}/x.fastq\n")
    assert records.load_sequences(spark, str(tmp_path / "list.txt")).count() == 4
    with pytest.raises(ValueError):
        records.load_sequences(spark, "x.doc")


def test_sinks(spark, tmp_path, trained):
    _, df, models, _ = trained
    scores = scoring.nll(df, models)
    sinks.write_scores(scores, str(tmp_path / "scores"))
    assert spark.read.parquet(str(tmp_path / "scores")).count() == 4
    assert set(sinks.score_table(scores, ["a", "b"]).columns) == {"seq_id", "a", "b"}
    sinks.write_distances(distances.distance("d2", models), str(tmp_path / "d"))
    assert spark.read.parquet(str(tmp_path / "d")).count() == 4
    sinks.write_tree_texts(models, str(tmp_path / "t"), as_table=True)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    grid = selection.parameter_grid(df, [2], [2], [0.5])
    sinks.append_criteria(grid, str(tmp_path / "csv"))
    sinks.append_criteria(grid, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 4
    assert sinks.distance_name("cv-estimation", order=6, background_order=2) == "cv-estimation-6-2"


def test_stream_of_sequences(spark, tmp_path, trained):
    from contextvine.streaming.scoring import score_stream

    _, df, models, _ = trained
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = score_stream(stream, models, lambda scores, n: scores.write.mode("overwrite").parquet(str(tmp_path / f"out/{n}")), str(tmp_path / "cp"))
    q.awaitTermination(120)
    want = sorted((r.seq_id, r.model_id, round(r.nll, 9)) for r in scoring.nll(df, models).collect())
    assert sorted((r.seq_id, r.model_id, round(r.nll, 9)) for r in spark.read.parquet(str(tmp_path / "out/0")).collect()) == want


def test_probability_columns():
    assert P == ("p_a", "p_c", "p_g", "p_t")


def test_labels_and_height_have_no_limit(spark, tmp_path):
    import random

    from contextvine.plans.queries import QUERIES

    letters = random.Random(4).choices("cpevs", k=150)
    rows = [(i, i, 7, s) for i, s in enumerate(letters * 2)] + [(400, 400, 8, "c")]
    spark.createDataFrame(rows, "event_id long, ts long, user_id long, event_type string").selectExpr("event_id", "timestamp_seconds(ts) AS ts", "user_id", "event_type").write.parquet(f"{tmp_path}/events.parquet")
    seq = "".join({"c": "A", "p": "C", "e": "G", "v": "T", "s": "N"}[s] for s in letters * 2)
    found, n = {}, len(seq)
    for i in range(n):
        for k in range(i + 1, n + 1):
            found.setdefault(seq[i:k], []).append(seq[k : k + 1])
    want = {w: len(f) for w, f in found.items() if len(set(f)) > 1 or f == [""]} | {"": 1}
    got = [(r.label, r.n) for r in QUERIES["substring_labels"](spark, str(tmp_path)).collect() if str(r.seq_id) == "7"]
    assert dict(got) == want and len(got) == len(want)
    assert {str(r.seq_id): r.height for r in QUERIES["tree_height"](spark, str(tmp_path)).collect()} == {"7": 150}


def test_headers_may_hold_the_sign(spark, tmp_path):
    (tmp_path / "x.fa").write_text(">s1 a->b gene\nACGT\n>>s2\r\nAC\r\nGT\r\n\n>s3\n")
    (tmp_path / "y.fa").write_text(">other>\nTT")
    (tmp_path / "list.txt").write_text(f"{tmp_path}/x.fa\n{tmp_path}/y.fa\n")
    got = {r.seq_id: r.seq for r in records.load_sequences(spark, str(tmp_path / "list.txt")).collect()}
    assert got == {"s1 a->b gene": "ACGT", "s2": "ACGT", "s3": "", "other>": "TT"}


def several(spark, n=11):
    names = [f"{k % 3}\t{k}" for k in range(n)]  # ids of many kinds, a tab among their letters
    seqs = spark.createDataFrame([(name, random_sequence(seed, 60)) for seed, name in enumerate(names)], "seq_id string, seq string")
    return seqs, training.train(seqs, max_depth=2, min_count=2, threshold=0.2)


def test_both_strands_keep_ids_apart(spark):
    seqs, models = several(spark, 4)
    two = {(r.seq_id, r.model_id): r.nll for r in scoring.nll(seqs, models, both_strands=True).collect()}
    turned = seqs.select("seq_id", scoring.reverse_complement(F.col("seq")).alias("seq"))
    each = [{(r.seq_id, r.model_id): r.nll for r in scoring.nll(s, models).collect()} for s in (seqs, turned)]
    assert len(two) == 16 and all(two[k] == pytest.approx(min(e[k] for e in each)) for k in two)
    own = {r.seq_id: r.nll for r in scoring.nll(seqs, models, own=True, both_strands=True).collect()}
    assert own == pytest.approx({i: two[i, i] for i, _ in two})


@pytest.mark.parametrize("name", ["d2", "nearest-dvstar", "kl-both", "jensenshannon"])
def test_blocks_do_not_matter(spark, monkeypatch, name):
    from contextvine.operators import grid

    seqs, models = several(spark)
    few = models.where("model_id < '2'")
    whole = {(r.left_id, r.right_id): r.value for r in distances.distance(name, models, few).collect()}
    scores = {(r.seq_id, r.model_id): r.nll for r in scoring.nll(seqs, few).collect()}
    monkeypatch.setattr(grid, "IDS", 2)
    cut = {(r.left_id, r.right_id): r.value for r in distances.distance(name, models, few).collect()}
    assert len(whole) == 11 * 8 and cut.keys() == whole.keys() and cut == pytest.approx(whole, abs=1e-6, nan_ok=True)
    assert {(r.seq_id, r.model_id): r.nll for r in scoring.nll(seqs, few).collect()} == pytest.approx(scores)


def test_a_probability_that_is_the_root_of_its_background_scores_nothing(spark):
    row = spark.createDataFrame([(2 / 5, 4 / 25)], "p double, b double")
    assert row.select(scoring.SCORES["background"][0](F.col("p"), F.col("b"))).head(1)[0][0] == 0.0


def test_both_directions_meet_in_one_cell(spark, monkeypatch):
    """The distance of samples, given and drawn, by blocks and against single scores; one grid, no join of two tables of pairs."""
    from contextvine.operators import grid, sampling

    seqs, models = several(spark)
    monkeypatch.setattr(grid, "IDS", 3)
    few = models.where("model_id < '2'")
    score = {(r.seq_id, r.model_id): r.nll for r in scoring.nll(seqs, models).collect()}
    found = sampling.nll_distance(few, models, left_samples=seqs, right_samples=seqs)
    assert found._jdf.queryExecution().executedPlan().toString().count("Join") == 0
    rows = {(r.left_id, r.right_id): r.value for r in found.collect()}
    ids = {r.model_id for r in few.collect()}, {r.model_id for r in models.collect()}
    assert rows.keys() == {(a, b) for a in ids[0] for b in ids[1] if {(a, b), (b, a)} <= score.keys()}
    assert rows == pytest.approx({(a, b): (score[a, b] + score[b, a]) / 2 for a, b in rows}, nan_ok=True)
