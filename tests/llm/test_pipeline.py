import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from contextvine.llm.shared import materialise
from tests.llm.test_dedup import brute_near
from tests.llm.test_tokens import BYTE, gapless, library


def test_pipeline_against_brute_force(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    kept, seen = {i for i, r in rows.items() if any(c.isalpha() for c in r.text or "")}, []
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
        seen.append(docs)
    language, exact, near, secrets, _ = seen
    assert {r.doc_id for r in language.collect()} == kept
    last = {}
    for i in kept:
        last[rows[i].text] = max(i, last.get(rows[i].text, -1))
    kept = set(last.values())
    assert {r.doc_id for r in exact.collect()} == kept
    kept = {i for i, (_, c) in brute_near([(i, rows[i].text) for i in kept]).items() if i == c}
    assert {r.doc_id for r in near.collect()} == kept
    texts = {r.doc_id: r.text for r in secrets.collect()}
    assert set(texts) == kept and secrets.columns == near.columns
    assert all(t == rows[i].text or "[SECRET]" in t for i, t in texts.items())
    tokenizer, pieces = library(BYTE), defaultdict(list)
    for r in seen[-1].collect():
        ids = np.array([*tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids, 0], dtype="<u4")
        assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids)
        pieces[r.doc_id].append((r.start, r.length))
    assert set(pieces) == kept and all(gapless(v) for v in pieces.values())


def test_stages_on_edges(spark, edge, sf_dir):
    """Null ids, repeated rows and an empty table, with and without further columns whose names the stages use themselves."""
    import corpus_pipeline

    docs = edge.select("doc_id", "text", "lang", "source", "n_chars")
    clashing = edge
    for name in ("_key", "_row", "_language", "_score"):
        clashing = clashing.withColumn(name, F.lit("clash"))
    kept = {}
    for label, df in (("plain", docs), ("clash", clashing), ("empty", docs.limit(0))):
        columns = df.columns
        for name, stage in corpus_pipeline.STAGES:
            df = materialise(stage(spark, df, sf_dir), name)
            ids = [r.doc_id or 0 for r in df.select("doc_id").collect()]
            kept[label, name] = sorted(set(ids) if name == "packing" else ids)  # how a text is cut goes by the task it is in
            if name != "packing":
                assert df.columns == columns
                assert label != "clash" or all(set(r) == {"clash"} for r in df.select(columns[5:]).collect())
    for name, _ in corpus_pipeline.STAGES:
        assert kept["clash", name] == kept["plain", name] and not kept["empty", name]
    assert kept["plain", "secrets"] == [0, 5, 7, 8, 9, 10]


def test_queries_are_registered():
    import __spark_entry__

    names = [n for n in __spark_entry__.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in __spark_entry__.queries()


def test_language_stage_keeps_text_where_no_language_is_known(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([(1, "some text", None), (2, "123 ...", None), (3, "été", None), (4, None, None)], "doc_id long, text string, lang string")
    assert sorted(r.doc_id for r in corpus_pipeline.language(spark, docs, "").collect()) == [1, 3]


def test_exact_stage_on_repeated_and_missing_ids(spark):
    import corpus_pipeline

    rows = [
        (4, "x y", "fr", "s2"), (4, "x y", "en", "s1"), (4, "x y", "en", "s1"), (5, "a b", "en", "s1"), (6, "a b", "en", "s1"), (7, "a b", "en", "s1"), (7, "c d", None, None),
        (8, "c d", "en", "s1"), (9, None, "en", "s1"), (10, "", "en", "s1"), (None, "a b", "en", "s1"), (None, "e f", "en", "s2"), (None, "e f", "en", "s1"), (None, None, "en", "s1"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {tuple(r) for r in corpus_pipeline.exact(spark, docs, "").collect()}
    assert got == {(4, "x y", "en", "s1"), (7, "a b", "en", "s1"), (8, "c d", "en", "s1"), (10, "", "en", "s1"), (None, "e f", "en", "s1")}
    assert corpus_pipeline.exact(spark, docs.limit(0), "").count() == 0
