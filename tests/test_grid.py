import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from contextvine.operators import distances, grid, sampling

from .test_scoring import several


@pytest.mark.parametrize("name", ["jaccard", "jaccard-prob", "kl"])
def test_words_are_scored_where_models_meet(spark, monkeypatch, name):
    """No row per word and model is dealt, and blocks don't matter."""
    _, models = several(spark)
    options = {"order": 3} if name == "kl" else {"length": 3, "words": sampling.random_sequences(spark, 500, 3)}
    dealt, on_grid = [], grid.on_grid
    monkeypatch.setattr(grid, "on_grid", lambda left, right, *a, **k: dealt.append((left.count(), right.count())) or on_grid(left, right, *a, **k))
    whole = {(r.left_id, r.right_id): r.value for r in distances.distance(name, models, **options).collect()}
    n = models.count() + models.select("model_id").distinct().count()
    assert dealt == [(n, n)] and len(whole) == 11 * 11
    monkeypatch.setattr(grid, "IDS", 2)
    cut = {(r.left_id, r.right_id): r.value for r in distances.distance(name, models, **options).collect()}
    assert cut == pytest.approx(whole, abs=1e-9, nan_ok=True)


@pytest.mark.parametrize("name", ["d2", "kl-both", "jaccard"])
def test_two_blocks_meet_once(spark, monkeypatch, name):
    """Within one table a pair and its reverse come from one cell, and are those of two tables."""
    _, models = several(spark)
    options = {"length": 4, "n": 300} if name == "jaccard" else {}
    monkeypatch.setattr(grid, "IDS", 2)
    rows = lambda right: sorted((r.left_id, r.right_id, -1.0 if r.value is None else round(r.value, 9)) for r in distances.distance(name, models, right, **options).collect())
    once = rows(None)
    assert len(once) == 11 * 11 and once == rows(models.select("*"))


def test_models_without_a_root_expect_no_word(spark):
    _, models = several(spark)
    models = models.where("model_id <> '0\\t3' or context <> ''")
    found = distances.distance("jaccard-prob", models, length=3, n=50).where("left_id = '0\\t3' or right_id = '0\\t3'").collect()
    assert len(found) == 21 and all(r.value is None for r in found)


@pytest.mark.parametrize("name", ["correlation", "dv"])
def test_every_cell_is_a_task(spark, monkeypatch, name):
    """Rows are dealt once, cells of few rows are not put together; more cells than tasks are told apart."""
    _, models = several(spark)
    whole = sorted((r.left_id, r.right_id, r.value) for r in distances.distance(name, models).collect())
    monkeypatch.setattr(grid, "IDS", 2)
    found = distances.distance(name, models)
    n = grid.blocks(models, "model_id", mirrored=name == "dv")
    parts = found.withColumn("task", F.spark_partition_id()).groupBy("task").count().count()
    assert n > 2 and parts > n  # by hash of their numbers and size they were one task or two
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(cell" not in plan
    near = lambda rows: [(a, b, None if v is None else pytest.approx(v, abs=1e-7)) for a, b, v in rows]
    assert sorted((r.left_id, r.right_id, r.value) for r in found.collect()) == near(whole)
    table = pa.table({"cell": pa.array([3, 3, 1, 1, 1, 5], pa.int64()), "l": list(range(6))})
    for size in (1, 2, 6):
        assert [t["l"].to_pylist() for t in grid._cells(iter(table.to_batches(size)))] == [[0, 1], [2, 3, 4], [5]]


def test_equal_models_are_neighbours():
    """Whatever their ids and the order of their rows, so that equal values of pairs follow each other in files."""
    rows = [(f"m{k}", c, v) for k in range(12) for c, v in [("", 0.1 + k % 3), ("A", 0.5), ("T", None)][:: 1 if k % 2 else -1]]
    side = pa.array([{"model_id": m, "context": c, "v": v} for m, c, v in rows], pa.struct({"model_id": pa.string(), "context": pa.string(), "v": pa.float64()}))
    (tile,) = grid._tiles(side, "model_id", ["context", "v"])
    ids = list(dict.fromkeys(tile["model_id"].to_pylist()))
    kinds = [int(m[1:]) % 3 for m in ids]
    assert len(ids) == 12 and tile.num_rows == 36 and sum(a != b for a, b in zip(kinds, kinds[1:])) == 2


@pytest.mark.parametrize("name, options", [("canberra", {}), ("correlation", {}), ("jensenshannon", {}), ("nearest-dvstar", {"symmetric": True}), ("penalized-dvstar", {"symmetric": True}), ("nll", {"order": 40}), ("d2", {})])
def test_two_tiles_meet_once(spark, monkeypatch, name, options):
    """Symmetric distances compute a pair once, in a block with itself too, and give all of both directions."""
    _, models = several(spark)
    monkeypatch.setattr(grid, "IDS", 2)
    rows = lambda right: sorted((r.left_id, r.right_id, -1.0 if r.value is None else round(r.value, 6)) for r in distances.distance(name, models, right, **options).collect())
    two = rows(models.select("*"))
    made, on_grid = [], grid.on_grid

    def seen(left, right, left_id, right_id, run, schema, n_left, n_right, *a, **k):
        made.append((n_left, k.get("mirrored") or (len(a) > 2 and a[2])))
        return on_grid(left, right, left_id, right_id, run, schema, 1, 1, *a, **k)

    once = rows(None)
    monkeypatch.setattr(grid, "on_grid", seen)
    block = rows(None)
    assert len(once) == 11 * 11 and once == two and block == two and made[0][1]


def test_values_of_six_places_are_numbers_of_a_dictionary(spark, tmp_path):
    """A value of a pair takes far fewer than its eight bytes on disk, though thousands of values differ."""
    import pyarrow.parquet as pq

    p = [F.rand(k) for k in range(8)]
    rows = spark.range(520).select(F.col("id").cast("string").alias("model_id"), F.explode(F.array(F.lit(""), F.lit("A"))).alias("context"))
    rows = rows.select("*", *(F.round(p[k], 3).alias(f"p_{x}") for k, x in enumerate("acgt"))).localCheckpoint()
    found = distances.distance("correlation", rows).select("left_id", "right_id", F.round("value", 5).alias("value"))
    found.coalesce(1).write.parquet(path := str(tmp_path / "pairs"))
    meta = pq.read_table(path).num_rows, [pq.ParquetFile(f).metadata.row_group(0).column(2) for f in tmp_path.glob("pairs/*.parquet")]
    assert meta[0] == 520 * 520
    for column in meta[1]:
        assert "PLAIN" not in column.encodings and column.total_compressed_size < 5 * column.num_values


def test_named_sizes_of_files_stay(spark):
    from contextvine.session import BY_NUMBER, values_by_number

    name, kept = "parquet.page.size", spark.conf.get("parquet.page.size", None)
    try:
        spark.conf.set(name, "4194304")
        values_by_number(spark)
        assert spark.conf.get(name) == "4194304" and spark.conf.get("parquet.dictionary.page.size") == str(BY_NUMBER["parquet.dictionary.page.size"])
    finally:
        spark.conf.set(name, kept) if kept else spark.conf.unset(name)


def test_unlikely_beginnings_end_words(spark, monkeypatch):
    """Few of the long words are scored whole, and the distance is that of scoring all; a cell is a task here too."""
    from contextvine.operators import scoring

    _, models = several(spark)
    words = sampling.random_sequences(spark, 400, 9)
    words = words.unionByName(words.limit(3).withColumn("seq", F.lit("AANAC"))).unionByName(spark.createDataFrame([("none", None)], "seq_id string, seq string"))
    found = sampling.jaccard(models, models, 9, least_expected=0.005, words=words)
    assert "hashpartitioning(cell" not in found._jdf.queryExecution().executedPlan().toString()
    rows = lambda df: {(r.left_id, r.right_id): r.value for r in df.collect()}
    cut = rows(found)
    texts = [(r.seq_id, r.seq) for r in words.collect()]
    every = scoring.Words([i for i, _ in texts], [t for _, t in texts], 3)
    side = scoring.WordScores(scoring.log_scores(models).select("model_id", "context", *scoring.S, "count").toArrow(), every)
    least = np.log(0.005) - np.log(side.root)
    whole = np.concatenate([ll for _, ll in side.parts()], 1)
    likely = np.flatnonzero((whole >= least[:, None]).any(0))
    some = side.possible(least)
    assert len(likely) and set(likely) <= set(some) and len(some) < every.n / 2
    assert np.concatenate([ll for _, ll in side.parts(every.only(some))], 1) == pytest.approx(whole[:, some])
    monkeypatch.setattr(scoring.WordScores, "possible", lambda self, least: np.arange(self.words.n))
    uncut = rows(sampling.jaccard(models, models, 9, least_expected=0.005, words=words))
    assert len(cut) == 121 and cut == pytest.approx(uncut, nan_ok=True)
    assert any(v for v in cut.values())


def test_stored_distances_are_those_returned(spark, sf_dir, monkeypatch):
    """Values are written to six places, so their files need no more than what the query returns."""
    from contextvine.plans import queries

    written, write = [], queries.sinks.write_distances
    monkeypatch.setattr(queries.sinks, "write_distances", lambda df, *a, **k: written.append(df) or write(df, *a, **k))
    back = queries.QUERIES["distances_stored"](spark, sf_dir)
    assert written[0].where(F.abs(F.col("value") * 1e6 - F.round(F.col("value") * 1e6)) > 1e-7).count() == 0
    assert back.count() == written[0].count() > 0
