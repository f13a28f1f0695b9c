"""Orphan references of the dictionary and the token stream, one row each and per table and period."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators.orphans import find_orphans
from textloom.sources import read_table


def _refs(df: DataFrame, table: str, field: str, key: Column, target: Column, time: str) -> DataFrame:
    return df.select(F.lit(table).alias("src_table"), F.lit(field).alias("src_field"), key.alias("src_key"), target.alias("target_id"), F.col(time).alias("ref_time"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    tokens, pos, stream, categories = (read_table(spark, d, t) for t in ("lexicon_tokens", "lexicon_pos", "token_stream", "categories"))
    own = F.col("token_id").cast("string")
    to_tokens = [
        *(_refs(tokens, "lexicon_tokens", f, own, F.explode(f), "loaded_at") for f in ("synonyms", "hypernyms")),
        _refs(pos, "lexicon_pos", "token_id", F.concat_ws("#", "word", F.col("ord").cast("string")), F.col("token_id"), "loaded_at"),
        _refs(stream, "token_stream", "token_id", F.concat_ws("#", F.col("input_id").cast("string"), F.col("seq").cast("string")), F.col("token_id"), "tagged_at"),
    ]
    found = find_orphans(reduce(DataFrame.unionByName, to_tokens), tokens.select(F.col("token_id").alias("key"), "loaded_at", "deleted_at")).unionByName(
        find_orphans(_refs(tokens, "lexicon_tokens", "categories", own, F.explode("categories"), "loaded_at"), categories.select(F.col("cat_id").alias("key"), "loaded_at", "deleted_at"))
    )
    return found.select("src_table", "src_field", "src_key", "target_id", "reason", F.date_format("ref_time", "yyyy-MM").alias("ref_period")).distinct()


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphans per table, field, period and reason."""
    return p2_found(spark, d).groupBy("src_table", "src_field", "ref_period", "reason").agg(F.count("*").alias("orphans"))


_FOUND = """
WITH refs AS (
  SELECT 'lexicon_tokens' AS src_table, 'synonyms' AS src_field, CAST(token_id AS VARCHAR) AS src_key, unnest(synonyms) AS target_id, loaded_at AS t, 'tokens' AS target FROM lexicon_tokens
  UNION ALL SELECT 'lexicon_tokens', 'hypernyms', CAST(token_id AS VARCHAR), unnest(hypernyms), loaded_at, 'tokens' FROM lexicon_tokens
  UNION ALL SELECT 'lexicon_tokens', 'categories', CAST(token_id AS VARCHAR), unnest(categories), loaded_at, 'categories' FROM lexicon_tokens
  UNION ALL SELECT 'lexicon_pos', 'token_id', word || '#' || ord, token_id, loaded_at, 'tokens' FROM lexicon_pos
  UNION ALL SELECT 'token_stream', 'token_id', input_id || '#' || seq, token_id, tagged_at, 'tokens' FROM token_stream),
parents AS (
  SELECT 'tokens' AS target, token_id AS id, loaded_at, deleted_at FROM lexicon_tokens
  UNION SELECT 'categories', cat_id, loaded_at, deleted_at FROM categories),
judged AS (
  SELECT r.src_table, r.src_field, r.src_key, r.target_id, r.t,
         count(p.id) AS loads,
         count(*) FILTER (p.loaded_at <= r.t) AS by_then,
         count(*) FILTER (p.loaded_at <= r.t AND (p.deleted_at IS NULL OR p.deleted_at > r.t)) AS alive
  FROM (SELECT DISTINCT * FROM refs WHERE target_id IS NOT NULL AND target_id <> 0) r LEFT JOIN parents p ON p.target = r.target AND p.id = r.target_id
  GROUP BY ALL)
SELECT DISTINCT src_table, src_field, src_key, CAST(target_id AS BIGINT) AS target_id,
       CASE WHEN loads = 0 THEN 'missing' WHEN by_then > 0 THEN 'deleted' ELSE 'late' END AS reason, strftime(t, '%Y-%m') AS ref_period
FROM judged WHERE alive = 0
"""


def queries() -> dict:
    return {f.__name__: f for f in (p2_found, p2_report)}


def oracle_sql() -> dict[str, str]:
    return {"p2_found": _FOUND, "p2_report": f"SELECT src_table, src_field, ref_period, reason, count(*) AS orphans FROM ({_FOUND}) GROUP BY ALL"}
