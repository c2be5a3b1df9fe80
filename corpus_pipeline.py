"""Corpus pipeline: from raw documents to packed training sequences.

``STAGES`` lists ``(name, function)``; each function takes ``(spark, docs, sf_dir)``,
works on every row its predecessor kept and returns a DataFrame that is written
and read again before the next.  All but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contextvine.llm.exact_dedup import exact_dedup
from contextvine.llm.langid import Profiles, fold, identify, learn_profiles
from contextvine.llm.near_dedup import near_dedup
from contextvine.llm.packing import pack
from contextvine.llm.queries import vocabulary
from contextvine.llm.secrets import redact
from contextvine.llm.shared import materialise
from contextvine.session import ship_package

#: Ids that may be broadcast to drop rows (some megabytes); beyond, both sides are dealt by id.
BROADCAST_IDS = 1_000_000


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id is not among ``ids``."""
    ids = materialise(ids.select("doc_id").distinct(), "dropped-ids")
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids.hint("merge"), "doc_id", "left_anti")


def _free(docs: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``docs`` doesn't use."""
    while name.lower() in (c.lower() for c in docs.columns):
        name = "_" + name
    return name


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no language can be told (no text, or no letter) go; where none is known, those without a letter.

    Rows without an id are judged like others and teach nothing; repeated rows stay; an empty table stays empty.
    """
    ship_package(spark)
    profiles = learn_profiles(docs.where(fold(F.col("doc_id"), 3) != 1))
    if not profiles.languages:
        profiles = Profiles({"any": [0]}, 1)  # every text with a letter is nearest to the only one
    found, score = _free(docs, "_language"), _free(docs, "_score")
    return identify(docs, profiles, predicted=found, score=score).where(F.col(found) != "und").select(*docs.columns)


def _text_key() -> Column:
    return F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)


def _one_each(rows: DataFrame, key: str) -> DataFrame:
    """Of rows equal in id and text the least by all columns in their order; partial minima come first, so no group is hot."""
    least = rows.groupBy("doc_id", _text_key().alias(key)).agg(F.min(F.struct(*rows.columns)).alias("_row"))
    return least.select(key, "_row.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (null counts as empty) the row with the largest id stays.

    Of rows that repeat an id and its text one stays, the least by all columns; an id
    that stands with several texts is judged text by text.  A row without an id goes
    if a row with one has its text; of those that are left one of each text stays.
    An empty table stays empty.
    """
    ship_package(spark)
    key = _free(docs, "_key")
    decided = materialise(exact_dedup(docs), "exact-decided")
    fate = materialise(decided.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"), F.max("kept").alias("stays")), "exact-fate")
    left = _without(docs, fate.where("not stays"))
    several = materialise(fate.where("stays and n > 1").select("doc_id"), "exact-several")
    if several.head(1):
        pairs = decided.where("kept").join(several.hint("merge"), "doc_id", "left_semi").select("doc_id", F.col("text_sha256").alias(key)).distinct()
        again = _one_each(left.join(several.hint("merge"), "doc_id", "left_semi"), key)
        left = _without(left, several).select(*docs.columns).unionByName(again.join(pairs.hint("merge"), ["doc_id", key], "left_semi").select(*docs.columns))
    if docs.where("doc_id is null").head(1):
        named = decided.where("doc_id is not null").select(F.col("text_sha256").alias(key)).distinct()
        unnamed = _one_each(docs.where("doc_id is null"), key).join(named.hint("merge"), key, "left_anti")
        left = left.where("doc_id is not null").select(*docs.columns).unionByName(unnamed.select(*docs.columns))
    return left.select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least id stays.

    Rows without an id, and texts without words, are linked with nothing and stay; rows
    that repeat an id share its fate; an empty table stays empty.
    """
    ship_package(spark)
    return _without(docs, near_dedup(docs).where("not kept")).select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live-looking secrets are replaced in the text; the character count follows.

    Every row stays, without an id or repeated too; a null text stays null, with its
    count; an empty table stays empty.
    """
    return redact(docs).withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a packed sequence; rows without an id or repeated are packed each, null text as empty; an empty table gives no rows."""
    ship_package(spark)
    return pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [("language", language), ("exact", exact), ("near", near), ("secrets", secrets), ("packing", packing)]

#: Tokenisation and near duplicates can't be said in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs, f"stage-{name}")
    return docs
