"""The registered queries themselves: against their SQL, held-out accuracy or brute force."""

import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from contextvine.llm import langid, toxicity
from contextvine.llm.queries import ORACLE_SQL, QUERIES
from tests.test_queries import rows


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.execute(ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    df = QUERIES[name](spark, sf_dir).select(*columns)
    assert rows(columns, df.collect()) == rows(columns, want.fetchall())


def test_language_of_held_out_documents(spark, sf_dir):
    got = QUERIES["op3_rank_order_language"](spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    assert len(got) > 10 and sum(r.lang == r.lang_pred for r in got) >= 0.9 * len(got)


def test_nearest_examples_by_brute_force(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    held_out = langid.fold(F.col("doc_id"), 4) == 2
    model = toxicity.learn(docs, labels.where(~held_out))
    weight = dict(zip(model.vocabulary.terms, model.weights))

    def vector(text):
        seen = Counter()
        for word in re.findall(r"\w+", (text or "").lower()):
            for term in [word, word[:4] + "*"] if len(word) > 4 else [word]:
                seen[term] += 1
        raw = {t: (1 + np.log(n)) * weight[t] for t, n in seen.items() if t in weight}
        norm = np.sqrt(sum(x * x for x in raw.values()))
        return {t: x / norm for t, x in raw.items()}

    texts = {r.doc_id: r.text for r in docs.collect()}
    examples = {i: vector(texts[i]) for i in model.ids}
    assert len(examples) == labels.where(~held_out & F.col("toxic").isNotNull()).select("doc_id").distinct().join(docs, "doc_id").count()
    n = len(texts)
    for term in list(weight)[:: max(1, len(weight) // 20)]:
        held = sum(term in ([w for x in re.findall(r"\w+", (t or "").lower()) for w in ([x, x[:4] + "*"] if len(x) > 4 else [x])]) for t in texts.values())
        assert 0.029 * (np.log((1 + n) / (1 + held)) + 1) <= weight[term] <= np.log((1 + n) / (1 + held)) + 1 + 1e-9
    for r in QUERIES["op8_toxicity_neighbours"](spark, sf_dir).collect():
        q = vector(texts[r.doc_id])
        best = sorted((-round(sum(x * e.get(t, 0.0) for t, x in q.items()), 9), i) for i, e in examples.items())
        found = [-s for s, _ in best[:3] if s < 0]
        assert [round(s, 9) for s in r.similarity] == pytest.approx(found, abs=2e-9)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)


def test_learning_on_edges(spark, edge):
    profiles = langid.learn_profiles(edge)
    assert set(profiles.languages) <= {"en", "fr"}
    got = langid.identify(edge, profiles).collect()
    assert len(got) == edge.count() and {r.lang_pred for r in got if r.doc_id in (1, 2, 3)} == {"und"}
    assert not langid.learn_profiles(edge.limit(0)).languages
    labels = spark.createDataFrame([(4, 1), (5, 0), (5, 1), (8, 0), (1, 0), (None, 1), (99, 1), (10, None)], "doc_id long, toxic int").withColumn("text", F.lit("clash"))
    for model in (toxicity.learn(edge, labels), toxicity.learn(edge, labels.limit(0)), toxicity.learn(edge.limit(0), labels)):
        got = toxicity.score(edge, model).collect()
        assert len(got) == edge.count() and all(0 <= r.score <= 1 for r in got)
