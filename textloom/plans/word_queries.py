"""Cleaning, word shapes, dictionary look-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.affixes import PREFIXES_BY_LENGTH, SUFFIXES, prefix_class, suffix_class
from textloom.lexicon import preprocess_rows
from textloom.operators.cleaning import SPECIALS, clean_words as to_words, expand, peel, shape, special_tokens as to_special, words_of
from textloom.plans.base import CATS, INPUT_WORDS, LEX, SENSE, STREAM, TOK, inputs, lexicon, stream, tag, values_sql, words_sql
from textloom.session import NARROW_BYTES, NARROW_ROWS, dimension_join
from textloom.sources import read_table

Q: dict = {}
S: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        Q[f.__name__] = f
        if sql:
            S[f.__name__] = sql
        return f

    return keep


@query(f"WITH {INPUT_WORDS} SELECT * FROM words")
def clean_words(spark: SparkSession, d: str) -> DataFrame:
    return to_words(inputs(spark, d), "input_id", "original")


@query(f"WITH {words_sql('SELECT doc_id, text FROM documents', 'doc_id', 'text')} SELECT doc_id, CAST(len(ws) - 1 AS BIGINT) AS words, CAST(len(list_filter(ws, lambda w: w = '|NL|')) AS BIGINT) AS lines FROM cleaned")
def line_counts(spark: SparkSession, d: str) -> DataFrame:
    """Words and lines of every document."""
    ws = words_of(F.col("text"))
    return read_table(spark, d, "documents").where("text is not null").select("doc_id", ws.alias("ws")).select("doc_id", F.size("ws").cast("long").alias("words"), (F.size(F.filter("ws", lambda w: w == "|NL|")) + 1).cast("long").alias("lines"))


_SP = SPECIALS.replace("'", "''")
SHAPES = rf"""
peeled AS (SELECT word, regexp_extract(word, '^([{_SP}]*)', 1) AS head0 FROM (SELECT DISTINCT word FROM words)),
headed AS (SELECT word, CASE WHEN length(head0) > 0 AND regexp_matches(right(head0, 1), '[-+$]') AND regexp_matches(substr(word, length(head0) + 1, 1), '[0-9]') THEN left(head0, length(head0) - 1) ELSE head0 END AS head FROM peeled),
bodied AS (SELECT word, head, substr(word, length(head) + 1) AS body FROM headed),
tailed AS (SELECT word, head, body, regexp_extract(body, '([^A-Za-z0-9]*)$', 1) AS tail FROM bodied),
cored AS (SELECT word, head, tail, left(body, length(body) - length(tail)) AS core0 FROM tailed),
shaped AS (SELECT word, head, tail, core0, (regexp_matches(core0, '''s$') AND length(core0) > 2) AS is_possessive,
  CASE WHEN regexp_matches(core0, '''s$') AND length(core0) > 2 THEN left(core0, length(core0) - 2) ELSE core0 END AS core FROM cored),
shapes AS (SELECT word, CASE WHEN word = '|NL|' THEN '' ELSE head END AS prefix, CASE WHEN word = '|NL|' THEN word ELSE core END AS core, CASE WHEN word = '|NL|' THEN '' ELSE tail END AS suffix, is_possessive,
  CASE WHEN word = '|NL|' THEN 'newline' WHEN core = '' THEN 'symbol'
       WHEN regexp_matches(core, '^(?:[0-9]|[01][0-9]|2[0-3]):[0-5][0-9]$') AND NOT regexp_matches(core, '^0:') THEN 'time'
       WHEN regexp_matches(core, '^(?:[0-9]0|[12][0-9][0-9]0)s$') THEN 'decade'
       WHEN regexp_matches(core, '^[-+$]?[0-9,]*[0-9][0-9,]*(?:[.^*/:][0-9,]*)?$') THEN 'number'
       WHEN regexp_matches(core, '^[-+$]?[0-9][0-9.,]*[A-Za-z]+$') THEN 'number_unit' ELSE 'word' END AS kind,
  CASE WHEN regexp_matches(core, '^[-+$]?[0-9][0-9.,]*[A-Za-z]+$') THEN regexp_extract(core, '^([-+$]?[0-9][0-9.,]*)', 1) END AS number,
  CASE WHEN regexp_matches(core, '^[-+$]?[0-9][0-9.,]*[A-Za-z]+$') THEN regexp_extract(core, '([A-Za-z]+)$', 1) END AS unit FROM shaped)"""


@query(f"WITH {INPUT_WORDS}, {SHAPES} SELECT * FROM shapes")
def word_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Parts and kind of every distinct word."""
    return clean_words(spark, d).select("word").distinct().select("word", shape(F.col("word")).alias("s")).select("word", "s.*")


def _of_kind(kind: str, extra: str = ""):
    sql = f"WITH {INPUT_WORDS}, {SHAPES} SELECT core, number, unit, count(*) AS occurrences FROM words JOIN shapes USING (word) WHERE kind IN ({kind}) GROUP BY ALL"

    def run(spark: SparkSession, d: str) -> DataFrame:
        # shapes are found once per distinct word, and counts added up
        counts = clean_words(spark, d).groupBy("word").agg(F.count("*").alias("n"))
        s = counts.select("n", F.inline(F.array(shape(F.col("word")))))
        return s.where(f"kind in ({kind})").groupBy("core", "number", "unit").agg(F.sum("n").alias("occurrences"))

    return run, sql


for _name, _kind in (("numeric_tokens", "'number'"), ("time_tokens", "'time'"), ("decade_tokens", "'decade'"), ("unit_tokens", "'number_unit'")):
    Q[_name], S[_name] = _of_kind(_kind)


PARTS = """parts AS (
  SELECT input_id, pos, CAST(i - 1 AS INT) AS sub, ps[i].part AS part, ps[i].token_type AS token_type FROM (
    SELECT input_id, pos, ps, unnest(generate_series(1, len(ps))) AS i FROM (
      SELECT w.input_id, w.pos, list_concat(list_concat(list_transform(list_filter(string_split(prefix, ''), lambda x: x <> ''), lambda x: {'part': x, 'token_type': 'prefix'}),
        CASE WHEN core = '' THEN [] ELSE [{'part': core, 'token_type': 'word'}] END), list_transform(list_filter(string_split(suffix, ''), lambda x: x <> ''), lambda x: {'part': x, 'token_type': 'suffix'})) AS ps
      FROM words w JOIN shapes s USING (word) WHERE w.word <> '|NL|')))"""


@query(f"WITH {INPUT_WORDS}, {SHAPES}, {PARTS} SELECT * FROM parts")
def symbol_peel(spark: SparkSession, d: str) -> DataFrame:
    return peel(clean_words(spark, d), "input_id")


_PRE = values_sql(preprocess_rows(), "w, tag, value")


@query(
    f"""WITH {INPUT_WORDS}, {SHAPES}, {PARTS}, hit AS (SELECT * FROM parts LEFT JOIN (SELECT * FROM {_PRE}) ON lower(part) = w),
own AS (SELECT *, CASE WHEN tag = '|contraction|' THEN string_split(value, ' ') ELSE [part] END AS ws FROM hit)
SELECT input_id, pos, sub, CAST(i - 1 AS INT) AS subsub, ws[i] AS part, tag, CASE WHEN tag <> '|contraction|' THEN value END AS value FROM (SELECT *, unnest(generate_series(1, len(ws))) AS i FROM own)"""
)
def contractions(spark: SparkSession, d: str) -> DataFrame:
    """Peeled words with contractions expanded and special words tagged."""
    return expand(symbol_peel(spark, d), lexicon(spark, d).preprocess(), "input_id")


@query(
    f"""WITH {INPUT_WORDS}, {SHAPES}, asked AS (SELECT w.input_id, w.pos, s.core, s.kind, s.number, s.unit, CASE WHEN kind = 'number_unit' THEN unit WHEN kind = 'word' THEN lower(core) END AS ask FROM words w JOIN shapes s USING (word)),
tagged AS (SELECT a.*, CASE kind WHEN 'number' THEN '|num|' WHEN 'time' THEN '|time|' WHEN 'decade' THEN '|date_period|' ELSE p.tag END AS t, p.value AS v FROM asked a LEFT JOIN (SELECT * FROM {_PRE} WHERE tag <> '|contraction|') p ON a.ask = p.w)
SELECT input_id, pos, core, t AS tag, CASE WHEN kind IN ('number', 'time') THEN core WHEN kind IN ('decade', 'number_unit') THEN number ELSE v END AS value, unit FROM tagged WHERE t IS NOT NULL"""
)
def special_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Numbers, times, periods and special words with their values and units."""
    return to_special(clean_words(spark, d), lexicon(spark, d).preprocess(), "input_id")


@query(f"WITH {LEX}, {SENSE} SELECT * FROM sense")
def default_sense(spark: SparkSession, d: str) -> DataFrame:
    return lexicon(spark, d).default_senses()


@query(f"WITH {STREAM}, {LEX}, {SENSE} SELECT s.input_id, s.seq, s.word, coalesce(l.pos, 'FW') AS pos, coalesce(l.token_id, 0) AS token_id, coalesce(l.potential_pos, []) AS potential_pos FROM stream s LEFT JOIN sense l ON lower(s.word) = l.word")
def lexicon_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Every token with its first sense; unknown words are FW with id 0."""
    l = lexicon(spark, d).default_senses().withColumnRenamed("word", "_w").withColumnRenamed("pos", "_p").withColumnRenamed("token_id", "_t")
    s = stream(spark, d, "word")
    return dimension_join(s, l, F.lower("word") == F.col("_w")).select("input_id", "seq", "word", F.coalesce("_p", F.lit("FW")).alias("pos"), F.coalesce("_t", F.lit(0)).alias("token_id"), F.coalesce("potential_pos", F.array().cast("array<string>")).alias("potential_pos"))


@query(f"WITH {STREAM}, {TOK} SELECT s.input_id, s.seq, s.token_id, coalesce(t.word, '') AS lexicon_word, coalesce(t.pos, 'FW') AS lexicon_pos, t.stem AS lexicon_stem, t.token_id IS NOT NULL AS is_known FROM stream s LEFT JOIN tok t USING (token_id)")
def token_by_id(spark: SparkSession, d: str) -> DataFrame:
    """Tokens by their id; a missing id gives an empty default token that keeps the id."""
    t = lexicon(spark, d).tokens.select(F.col("token_id").alias("_id"), F.col("word").alias("w"), F.col("pos").alias("p"), F.col("stem").alias("lexicon_stem"))
    return dimension_join(stream(spark, d, "token_id"), t, F.col("token_id") == F.col("_id")).select("input_id", "seq", "token_id", F.coalesce("w", F.lit("")).alias("lexicon_word"), F.coalesce("p", F.lit("FW")).alias("lexicon_pos"), "lexicon_stem", F.col("_id").isNotNull().alias("is_known"))


@query(f"WITH {STREAM}, {LEX}, {SENSE} SELECT word, l.pos, l.token_id, l.potential_pos FROM (SELECT DISTINCT word FROM stream) JOIN sense l USING (word)")
def word_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Distinct words looked up as they are written."""
    return stream(spark, d, "word").select("word").distinct().join(lexicon(spark, d).default_senses(), "word").select("word", "pos", "token_id", "potential_pos")


@query(f"WITH {STREAM}, {LEX}, one AS (SELECT word, pos, arg_min(token_id, ord) AS token_id FROM lex GROUP BY 1, 2) SELECT s.input_id, s.seq, s.word, upper(s.pos) AS pos, l.token_id AS sense_id, s.is_possessive, s.is_negative FROM stream s LEFT JOIN one l ON lower(s.word) = l.word AND upper(s.pos) = l.pos")
def resense(spark: SparkSession, d: str) -> DataFrame:
    """The sense of every token for the tag it was given; flags are kept."""
    one = lexicon(spark, d).senses.groupBy("word", "pos").agg(F.min_by("token_id", "ord").alias("sense_id")).select(F.col("word").alias("_w"), F.col("pos").alias("_p"), "sense_id")
    s = stream(spark, d, "word", "pos", "is_possessive", "is_negative")
    return dimension_join(s, one, (F.lower("word") == F.col("_w")) & (F.upper("pos") == F.col("_p")), max_rows=NARROW_ROWS, max_bytes=NARROW_BYTES).select("input_id", "seq", "word", F.upper("pos").alias("pos"), "sense_id", "is_possessive", "is_negative")


@query(f"WITH {LEX}, {SENSE}, v AS (SELECT word, arg_min(pos, ord) AS verb_pos, arg_min(token_id, ord) AS verb_id FROM lex WHERE starts_with(pos, 'V') GROUP BY 1) SELECT word, sense.pos, v.verb_pos, v.verb_id FROM sense JOIN v USING (word)")
def force_verb(spark: SparkSession, d: str) -> DataFrame:
    """Words that can be a verb, with their first verb sense."""
    lx = lexicon(spark, d)
    v = lx.senses.where("pos like 'V%'").groupBy("word").agg(F.min_by("pos", "ord").alias("verb_pos"), F.min_by("token_id", "ord").alias("verb_id"))
    return lx.default_senses().join(v, "word").select("word", "pos", "verb_pos", "verb_id")


@query(f"WITH {LEX}, {SENSE} SELECT word, potential_pos, len(potential_pos) AS senses FROM sense WHERE len(potential_pos) > 1")
def ambiguous_words(spark: SparkSession, d: str) -> DataFrame:
    return lexicon(spark, d).default_senses().where(F.size("potential_pos") > 1).select("word", "potential_pos", F.size("potential_pos").cast("long").alias("senses"))


@query(
    f"""WITH {STREAM}, langs AS (SELECT DISTINCT input_id, lang FROM tokenized_input), tagged AS (SELECT input_id, CASE WHEN upper(s.pos) IN (SELECT tag FROM pos_tags) THEN upper(s.pos) ELSE 'FW' END AS tag FROM stream s)
SELECT coalesce(l.lang, 'und') AS lang, t.tag, p.short_tag, count(*) AS tokens FROM tagged t LEFT JOIN langs l USING (input_id) JOIN pos_tags p ON p.tag = t.tag GROUP BY ALL"""
)
def tag_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Tokens by language and tag."""
    tags = lexicon(spark, d).pos_tags.select("tag", "short_tag")
    langs = read_table(spark, d, "tokenized_input").select("input_id", "lang").distinct()
    known = stream(spark, d, "pos").select("input_id", F.upper("pos").alias("_p")).join(tags, F.col("_p") == F.col("tag"), "left").select("input_id", F.coalesce("tag", F.lit("FW")).alias("tag"))
    by_input = known.groupBy("input_id", "tag").agg(F.count("*").alias("n"))
    return by_input.join(langs, "input_id", "left").join(tags, "tag").groupBy(F.coalesce("lang", F.lit("und")).alias("lang"), "tag", "short_tag").agg(F.sum("n").alias("tokens"))


@query(f"WITH {STREAM}, {TOK} SELECT s.input_id, s.seq, s.word FROM stream s LEFT JOIN tok t USING (token_id) WHERE NOT coalesce(t.is_stop_word, false)")
def stop_word_removal(spark: SparkSession, d: str) -> DataFrame:
    stop = lexicon(spark, d).tokens.where("is_stop_word").select(F.col("token_id").alias("_id"))
    return dimension_join(stream(spark, d, "word", "token_id"), stop, F.col("token_id") == F.col("_id"), "left_anti").select("input_id", "seq", "word")


_SUF = "CASE " + " ".join(f"WHEN ends_with(w, '{s}') THEN '{s}'" for s in SUFFIXES) + " END"
_PREF = "CASE " + " ".join(f"WHEN starts_with(w, '{p}') THEN '{p}'" for p in PREFIXES_BY_LENGTH) + " END"


@query(f"WITH {STREAM}, ws AS (SELECT DISTINCT lower(word) AS w FROM stream) SELECT w AS word, {_SUF} AS suffix_class FROM ws")
def suffix_classes(spark: SparkSession, d: str) -> DataFrame:
    return stream(spark, d, "word").select(F.lower("word").alias("word")).distinct().select("word", suffix_class(F.col("word")).alias("suffix_class"))


@query(f"WITH {STREAM}, ws AS (SELECT DISTINCT lower(word) AS w FROM stream) SELECT w AS word, {_PREF} AS prefix_class FROM ws")
def prefix_classes(spark: SparkSession, d: str) -> DataFrame:
    return stream(spark, d, "word").select(F.lower("word").alias("word")).distinct().select("word", prefix_class(F.col("word")).alias("prefix_class"))


def queries() -> dict:
    return Q


def oracle_sql() -> dict[str, str]:
    return S
