"""The facade over texts and the command line."""

import pytest

from contextvine import api, cli
from tests.test_training import random_sequence


def test_facade(spark):
    a, b = random_sequence(21, 300), random_sequence(22, 300, "AACGT")
    trees = [api.train(spark, n, s, 3, 2, 0.5) for n, s in (("a", a), ("b", b))]
    matrix = api.score_sequences(spark, trees, [a, b])
    assert len(matrix) == 2 and len(matrix[0]) == 2 and matrix[0][0] < matrix[0][1]
    assert len(api.score_sequences_background(spark, trees, [a])[0]) == 2
    assert len(api.sliding_windows(spark, trees[0], a, 20)) == 300 and [len(x) for x in api.sliding_windows_background(spark, trees[0], a, [5, 20])] == [300, 300]
    for f in (api.d2, api.dv, api.d2star, api.dvstar, api.cv):
        assert f(spark, trees[0], trees[0]) == pytest.approx(0, abs=1e-6) and f(spark, *trees) > 0
    assert "Number(parameters): 12" in api.train_parameters(spark, "a", a, 3, 2, 12) or "Number(parameters): 9" in api.train_parameters(spark, "a", a, 3, 2, 12)


def test_commands(spark, tmp_path, capsys):
    fasta = tmp_path / "x.fa"
    fasta.write_text(f">a\n{random_sequence(23, 200)}\n>b\n{random_sequence(24, 200, 'AACGT')}\n")
    models, run = str(tmp_path / "m.parquet"), lambda *argv: cli.main(list(argv), spark)
    run("batch-train", str(fasta), "-d", "3", "-c", "2", "-k", "0.5", "-o", models)
    assert {r.model_id for r in spark.read.parquet(models).select("model_id").distinct().collect()} == {"a", "b"}
    run("train", str(fasta), "-d", "2", "-c", "2")
    assert "Name: a|b" in capsys.readouterr().out
    run("score", models, str(fasta), "-r", "-o", str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 4
    run("distances", models, "-n", "cv-estimation", "-s", "2", "-b", "1", "-o", str(tmp_path / "d"))
    assert spark.read.parquet(str(tmp_path / "d")).where("name = 'cv-estimation-2-1'").count() == 4
    run("windows", models, str(fasta), "-i", "10", "20", "-o", str(tmp_path / "w"))
    assert spark.read.parquet(str(tmp_path / "w")).count() == 1600
    run("vectors", models, "-s", "2", "-o", str(tmp_path / "v"))
    assert spark.read.parquet(str(tmp_path / "v")).count() == 2 * 16 * 4
