"""Phrases, pronouns and their renderings.

The reading of phrases has no SQL; tests hold worked cases. Who a pronoun stands for is told a second time by a
recursive query that carries what was spoken of from token to token.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import categories as C
from textloom.operators import phrases as R
from textloom.plans.base import CATS, STREAM, TOK, lexicon, stream
from textloom.plans.span_queries import CANDS, KINDS_SQL, first_paths, merged_sql, merged_view


def _described(spark, d):
    lx = lexicon(spark, d)
    return R.describe(merged_view(spark, d), lx, C.coreference_kinds(lx, **first_paths(lx)))


def phrase_ranges(spark: SparkSession, d: str) -> DataFrame:
    return R.interpret(_described(spark, d)).select("input_id", "phrase", "start", "end", "split_token")


def phrase_tense_person(spark: SparkSession, d: str) -> DataFrame:
    return R.interpret(_described(spark, d)).groupBy("tense", "person").agg(F.count("*").alias("phrases"))


def phrase_class(spark: SparkSession, d: str) -> DataFrame:
    return R.interpret(_described(spark, d)).groupBy("kind", "intent").agg(F.count("*").alias("phrases"), F.round(F.avg("intent_score"), 6).alias("score"))


def phrase_units(spark: SparkSession, d: str) -> DataFrame:
    return R.interpret(_described(spark, d)).select("input_id", "phrase", "nouns", "verbs", "modifiers", "siblings", "objects")


def pronoun_antecedents(spark: SparkSession, d: str) -> DataFrame:
    return R.resolve_pronouns(_described(spark, d))


def phrase_texts(spark: SparkSession, d: str) -> DataFrame:
    return R.interpret(_described(spark, d)).select("input_id", "phrase", F.col("rendered").alias("text"))


def token_texts(spark: SparkSession, d: str) -> DataFrame:
    s = stream(spark, d, "word", "pos", "token_id", "inner_value")
    return s.select("input_id", "seq", R.render_token(F.col("word"), F.coalesce(F.upper("pos"), F.lit("FW")), F.col("token_id"), F.lit(None).cast("string"), F.col("inner_value")).alias("text"))


_TEXTS = f"WITH {STREAM} SELECT input_id, seq, CASE WHEN coalesce(upper(pos), 'FW') = 'SYS' THEN word || ' [' || coalesce(inner_value, '') || ': SYS]' ELSE word || ' [' || coalesce(token_id, 0) || ': ' || coalesce(upper(pos), 'FW') || ']' END AS text FROM stream"


_VIEW_CTES, _VIEW = merged_sql(CANDS).rsplit("\nSELECT w.input_id", 1)
_AGREES = "persons[{0}].g IN ('', gender)"
_BOUND = "list_transform(persons, lambda x, k: CASE WHEN k = {0} THEN {{'w': x.w, 'g': gender}} ELSE x END)"
_ANTECEDENTS = f"""WITH RECURSIVE {_VIEW_CTES}, mview AS (SELECT w.input_id{_VIEW}), {CATS}, {TOK}, {KINDS_SQL},
described AS MATERIALIZED (SELECT v.input_id, row_number() OVER (PARTITION BY v.input_id ORDER BY v.seq) AS i, v.word AS w, t.pronoun, v.pos IN ('PR', 'PRP') AS is_pronoun,
  coalesce(k.is_person, starts_with(v.pos, 'NNP')) AS is_person, coalesce(k.is_entity, false) AS is_entity, starts_with(v.pos, 'N') OR v.pos = 'SYS' AS is_noun, starts_with(v.pos, 'V') OR v.pos = 'IN' AS breaks,
  v.pos IN ('PR', 'PRP') AND NOT coalesce(t.is_auxiliary, false) AND NOT coalesce(t.is_predicative, false) AND coalesce(t.pronoun.category IN ('personal', 'possessive', 'reflexive'), false) AS asks,
  coalesce(t.pronoun.category, '') AS category, coalesce(t.pronoun.person, '') AS person, coalesce(t.pronoun.gender, '') AS gender, coalesce(t.pronoun.number, '') AS number
  FROM mview v LEFT JOIN tok t ON t.token_id = v.token_id LEFT JOIN kinds k ON k.token_id = v.token_id),
state AS (
  SELECT DISTINCT input_id, CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(w VARCHAR, g VARCHAR)[]) AS persons, CAST(0 AS BIGINT) AS main, CAST(NULL AS VARCHAR) AS thing, CAST(NULL AS VARCHAR) AS entity, CAST([] AS VARCHAR[]) AS several, CAST(0 AS BIGINT) AS last, CAST(0 AS BIGINT) AS idle, CAST(NULL AS VARCHAR) AS said FROM described
  UNION ALL
  SELECT input_id, i,
    CASE WHEN forget THEN [] WHEN bind > 0 THEN {_BOUND.format('bind')} WHEN adds THEN list_append(persons, {{'w': w, 'g': ''}}) ELSE persons END,
    CASE WHEN forget THEN 0 WHEN NOT is_pronoun AND is_person AND main = 0 THEN CASE WHEN adds THEN len(persons) + 1 ELSE known END ELSE main END,
    CASE WHEN forget THEN NULL WHEN NOT is_pronoun AND NOT is_person AND NOT is_entity AND is_noun AND thing IS NULL THEN w ELSE thing END,
    CASE WHEN forget THEN NULL WHEN NOT is_pronoun AND NOT is_person AND is_entity THEN w ELSE entity END,
    CASE WHEN forget OR (NOT is_pronoun AND breaks) THEN [] WHEN NOT is_pronoun AND is_person AND NOT list_contains(several, w) THEN list_append(several, w) ELSE several END,
    CASE WHEN forget THEN 0 WHEN bind > 0 THEN bind ELSE last END,
    CASE WHEN forget OR asks THEN 0 WHEN is_pronoun THEN idle ELSE idle + 1 END,
    CASE WHEN NOT asks OR person <> 'third' THEN NULL
         WHEN number = 'plural' THEN CASE WHEN len(several) >= 2 AND main > 0 AND list_contains(several, persons[main].w) THEN array_to_string(several, '|') WHEN main > 0 AND len(persons) > 1 THEN persons[main].w || '|' || persons[CASE WHEN main = len(persons) THEN len(persons) - 1 ELSE len(persons) END].w ELSE entity END
         WHEN gender IN ('neutral', '') THEN thing WHEN bind > 0 THEN persons[bind].w WHEN main > 0 AND {_AGREES.format('main')} THEN persons[main].w END
  FROM (SELECT *, CASE WHEN NOT (asks AND person = 'third' AND number <> 'plural' AND gender NOT IN ('neutral', '')) THEN 0
      WHEN main > 0 AND (category = 'possessive' OR last <> main) AND {_AGREES.format('main')} THEN main
      ELSE coalesce(list_max(list_filter(generate_series(1, len(persons)), lambda k: k <> main AND persons[k].g IN ('', gender))), 0) END AS bind
    FROM (SELECT d.*, s.persons, s.main, s.thing, s.entity, s.several, s.last, s.idle, coalesce(list_position(list_transform(s.persons, lambda x: x.w), d.w), 0) AS known,
        NOT d.is_pronoun AND d.is_person AND NOT coalesce(list_contains(list_transform(s.persons, lambda x: x.w), d.w), false) AS adds, NOT d.is_pronoun AND s.idle + 1 > {R.MEMORY} AS forget
      FROM state s JOIN described d ON d.input_id = s.input_id AND d.i = s.i + 1)))
SELECT input_id, CAST(i - 1 AS INT) AS place, said AS antecedent FROM state WHERE said IS NOT NULL"""


def queries() -> dict:
    return {f.__name__: f for f in (phrase_ranges, phrase_tense_person, phrase_class, phrase_units, pronoun_antecedents, phrase_texts, token_texts)}


def oracle_sql() -> dict[str, str]:
    return {"token_texts": _TEXTS, "pronoun_antecedents": _ANTECEDENTS}
