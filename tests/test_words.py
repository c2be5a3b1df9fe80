from contextvine.operators import words


def test_patterns_meet_positions_where_they_are(spark):
    """Positions are not dealt by word: a short pattern would bring most of them to one task."""
    seqs = spark.createDataFrame([("a", "ACGT" * 100)], "seq_id string, seq string")
    patterns = spark.createDataFrame([("A",), ("CG",), ("A",)], "pattern string")
    found = words.search(seqs, patterns)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert found.count() == 200


def test_words_of_short_sequences_are_dealt_once(spark, monkeypatch):
    """As many tasks as the text asks for; rows that repeat an id, and cut sequences, are summed as ever."""
    seqs = spark.createDataFrame([(str(k), "ACGTN" * 8) for k in range(50)], "seq_id string, seq string")
    monkeypatch.setattr(words, "WORDS", 1000)
    found = words.word_counts(seqs, 3)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    want = sorted(map(tuple, words.word_counts(seqs, 3, "sql").collect()))
    assert sorted(map(tuple, found.collect())) == want
    twice = {tuple(r) for r in words.word_counts(seqs.unionByName(seqs), 3).collect()}
    assert twice == {(i, w, 2 * n) for i, w, n in want}
