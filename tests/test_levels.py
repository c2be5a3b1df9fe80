"""Training on documents: symbols by byte, rows by context."""

import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from contextvine.operators import levels, training
from contextvine.sources import records

TEXTS = ["héllo \U0001f600 wörld", "", None, "Abc 日本 xyz\n", "plain", "AZaz@[`{09"]
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def read(text):
    return None if text is None else re.sub("[^ACGT]", "N", text.translate(str.maketrans(LETTERS, ("ACGT" * 13)[:52])))


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_texts_are_read_by_bytes():
    every = pa.array(TEXTS)
    for texts in (every, every[2:], every[1:4], every[4:], every[:0], pa.array([None, None], pa.string()), every.cast(pa.large_string())):
        found = records.recoded(texts, records._CYCLE)
        found.validate(full=True)
        assert found.to_pylist() == [read(t) for t in texts.to_pylist()]


def test_lengths_need_no_sequence(spark):
    """Roots are known from the texts; a sequence is made once where it is cut."""
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    seqs = records.document_sequences(docs)
    assert {int(r.seq_id): r.seq for r in seqs.collect()} == {k: read(t) for k, t in enumerate(TEXTS) if t is not None}
    assert {int(r.model_id): r["count"] for r in training.roots(seqs).collect()} == {k: len(t) for k, t in enumerate(TEXTS) if t is not None}
    assert "translate" not in plan(training.roots(seqs)) and "_cycled" not in plan(training.roots(seqs))
    assert plan(levels.pieces(seqs, 3)).count("_cycled(") == 1


@pytest.mark.parametrize("together", [1, 1 << 19])
def test_a_row_holds_all_that_follows_a_context(spark, monkeypatch, together):
    """Words of a context leave a task as one row, whatever is counted together."""
    monkeypatch.setattr(levels, "TOGETHER", together)
    seqs = spark.createDataFrame([(f"s{k}", s) for k, s in enumerate(("ACGTACGGT" * 9, "NANNACA", "", "N", "TTTTT"))], "seq_id string, seq string")
    rows = levels.level_followers(seqs, 6, 1, step=2)
    found = {(r.seq_id, r.k, r.code): (r.n_a, r.n_c, r.n_g, r.n_t) for r in rows.collect()}
    assert len(found) == rows.count() and found["s1", 0, 0] == (3, 1, 0, 0) and found["s4", 2, 15] == (0, 0, 0, 3)
    words = {(r.model_id, r.word): r.n for r in training.word_counts(seqs, 6).collect()}
    assert {(r.model_id, r.word): r.n for r in levels.level_words(seqs, 6, 1, step=2).collect()} == words
    assert rows.where(F.col("k") == 0).count() == 3
