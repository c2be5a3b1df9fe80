"""Thin queries of the operators over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import normalise_archives, read_archives, write_archives

    return read_archives(normalise_archives(write_archives(table(spark, sf_dir, "pages"))))


def op2_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .wavelet import read_shards, write_shards

    return read_shards(write_shards(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json")))


def op3_rank_order_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import fold, identify, learn_profiles

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = fold(F.col("doc_id"), 3) == 1
    profiles = learn_profiles(docs.where(~held_out))
    return identify(docs.select("doc_id", "text"), profiles).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op4_backtracking_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import encode_decode

    return encode_decode(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents"))


def op6_minhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_dedup

    return near_dedup(table(spark, sf_dir, "documents"))


def op7_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import secret_scan

    return secret_scan(table(spark, sf_dir, "documents"))


def op8_toxicity_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import fold
    from .toxicity import learn, score

    docs, held_out = table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 4) == 2
    model = learn(docs, table(spark, sf_dir, "labels").where(~held_out))
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted", "evidence", "similarity")


def op9_anisotropic_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import search

    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op11_square_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .square_packing import square_pack

    return square_pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op12_vantage_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hard_negatives import label_after, mine, usable_rows

    moved = table(spark, sf_dir, "embeddings").withColumn("label", label_after(F.col("vec_id"), F.col("label")))
    return mine(usable_rows(moved), F.col("vec_id") % 100 == 0)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))


QUERIES = {
    "op1_warc_normaliser": op1_warc_normaliser,
    "op2_wavelet_shards": op2_wavelet_shards,
    "op3_rank_order_language": op3_rank_order_language,
    "op4_backtracking_bpe": op4_backtracking_bpe,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_minhash_components": op6_minhash_components,
    "op7_secret_ownership": op7_secret_ownership,
    "op8_toxicity_neighbours": op8_toxicity_neighbours,
    "op9_anisotropic_search": op9_anisotropic_search,
    "op10_packing": op10_packing,
    "op11_square_packing": op11_square_packing,
    "op12_vantage_negatives": op12_vantage_negatives,
    "op13_whitening": op13_whitening,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), '" + _UPPER + "', '" + _LOWER + r"'), '[^\x20\x09-\x0D]+')"


def _spans_sql(number: int, kind: str, pattern: str, group: int, least: int) -> str:
    """Spans of one kind: places are the lengths of what stands between matches and of the matches before."""
    pattern = pattern.replace("'", "''")
    return f"""
  SELECT doc_id, text, source, {number} AS number, '{kind}' AS kind, start, start + length(whole[k]) AS stop, held[k] AS held FROM (
    SELECT doc_id, text, source, whole, held, k, CAST(list_sum(list_transform(parts[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(whole[1:k - 1], lambda x: length(x))), 0) AS BIGINT) AS start
    FROM (SELECT *, unnest(range(1, len(whole) + 1)) AS k FROM (
      SELECT doc_id, text, source, regexp_extract_all(text, '{pattern}') AS whole, regexp_extract_all(text, '{pattern}', {group}) AS held, string_split_regex(text, '{pattern}') AS parts FROM docs))) WHERE length(held[k]) >= {least}"""


def _secrets_sql(most_owners: int = 2, most_repositories: int = 50) -> str:
    from .secrets import ADDED_KINDS, BASE_KINDS, PLACEHOLDER

    kinds = [*BASE_KINDS.items(), *ADDED_KINDS.items()]
    every = " UNION ALL ".join(_spans_sql(n, kind, *spec) for n, (kind, spec) in enumerate(kinds))
    listed = lambda test: f"coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, number) FILTER ({test}), '')"
    counts = ", ".join(f"count(kind) FILTER (kind = '{k}') AS n_{k}" for k in BASE_KINDS)
    base = f"number < {len(BASE_KINDS)}"
    return f"""WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS source FROM documents), every AS ({every}),
seen AS (SELECT held, count(DISTINCT source) AS owners, count(DISTINCT coalesce(CAST(doc_id AS VARCHAR), '')) AS repositories, max(regexp_matches(held, '{PLACEHOLDER}')) AS placeholder FROM every GROUP BY held),
judged AS (SELECT every.*, owners <= {most_owners} AND repositories <= {most_repositories} AND NOT placeholder AS live FROM every JOIN seen ON seen.held = every.held)
SELECT docs.doc_id, {counts}, sha256({listed(base)}) AS base_sha256, {listed(base + " OR live")} AS spans, count(kind) FILTER (live) AS n_live, count(kind) FILTER (NOT live) AS n_copied
FROM docs LEFT JOIN judged ON judged.doc_id = docs.doc_id GROUP BY docs.doc_id"""


ORACLE_SQL = {
    "op1_warc_normaliser": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top FROM pages)
        SELECT page_id, octet_length(encode(body)) AS payload_bytes,
               array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(h, CAST(5 * (i // 4) + 1 AS INT), 5) AS INT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31), 1)), '') AS payload_digest,
               CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
        FROM p""",
    "op5_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               coalesce(doc_id = max(doc_id) OVER w, false) AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "op6_minhash_components": f"""
        WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS words FROM documents),
        sh AS (SELECT DISTINCT doc_id, array_to_string(words[k:k + 4], chr(1)) AS s FROM (SELECT doc_id, words, unnest(range(1, greatest(1, len(words) - 4) + 1)) AS k FROM w WHERE len(words) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
        met AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
        links AS (SELECT x, y FROM met JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * common >= 75 * (a.n + b.n - common)),
        edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
        reach AS (SELECT x, y FROM edges UNION SELECT r.x, b.y FROM reach r JOIN edges b ON b.x = r.y)
        SELECT w.doc_id, coalesce(max(n.n), 0) AS n_shingles, least(w.doc_id, coalesce(min(reach.y), w.doc_id)) AS component_id, w.doc_id = least(w.doc_id, coalesce(min(reach.y), w.doc_id)) AS kept
        FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN reach ON reach.x = w.doc_id GROUP BY w.doc_id""",
    "op7_secret_ownership": _secrets_sql(),
    "op12_vantage_negatives": """
        WITH x AS (
          SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda v: floor(256 * CAST(v AS DOUBLE))) AS x FROM embeddings
          WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
        s AS (SELECT a.vec_id AS anchor_id, a.label AS anchor_label, b.vec_id, b.label, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score FROM x a JOIN x b ON b.vec_id <> a.vec_id AND len(b.x) = len(a.x) WHERE a.vec_id % 100 = 0),
        p AS (SELECT anchor_id, anchor_label, vec_id AS positive_id, score AS positive_score FROM s WHERE label = anchor_label QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
        SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INT) AS rank, s.vec_id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> p.anchor_label AND 80 * positive_score <= 100 * score AND score <= positive_score
        WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, s.vec_id) QUALIFY row_number() OVER w <= 5""",
}
