"""Tagging and spell correction."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.affixes import ADVERBS, AUXILIARIES, MODALS, PASSIVES, PERFECTS, PREFIXES_BY_LENGTH, SUFFIXES, TEMPORALS
from textloom.operators import by_word
from textloom.operators import context as K
from textloom.operators import hmm as H
from textloom.operators import spelling as SP
from textloom.operators.tagger import Tagger, ambiguous, pronouns
from textloom.plans.base import LEX, SENSE, STREAM, TOK, lexicon, stream
from textloom.session import ensure_checkpoint_dir

Q: dict = {}
S: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        Q[f.__name__] = f
        if sql:
            S[f.__name__] = sql
        return f

    return keep


SENTS = f"""{STREAM}, sents AS (SELECT input_id, seq, lower(word) AS w, CASE WHEN upper(pos) IN (SELECT tag FROM pos_tags) THEN upper(pos) ELSE 'FW' END AS t,
  coalesce(sum(CASE WHEN upper(pos) = 'SS' THEN 1 ELSE 0 END) OVER (PARTITION BY input_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sent FROM stream)"""
INITIAL = "ini AS (SELECT tag, round(ln(n / (SELECT sum(n) FROM firsts)), 9) AS lp FROM firsts)"
FIRSTS = "firsts AS (SELECT tag, count(*) AS n FROM (SELECT input_id, sent, arg_min(t, seq) AS tag FROM sents GROUP BY 1, 2) GROUP BY 1)"
TRANS = "trans AS (SELECT prev_tag, tag, round(ln(n / sum(n) OVER (PARTITION BY prev_tag)), 9) AS lp FROM (SELECT prev_tag, t AS tag, count(*) AS n FROM (SELECT t, lag(t) OVER (PARTITION BY input_id, sent ORDER BY seq) AS prev_tag FROM sents) WHERE prev_tag IS NOT NULL GROUP BY 1, 2))"
EMIT = f"emit AS (SELECT tag, word, round(ln((n + {H.SMOOTHING}) / (sum(n) OVER (PARTITION BY tag) + {H.SMOOTHING} * (SELECT count(DISTINCT w) FROM sents))), 9) AS lp FROM (SELECT t AS tag, w AS word, count(*) AS n FROM sents GROUP BY 1, 2))"
MISS = f"miss AS (SELECT t AS tag, round(ln({H.SMOOTHING} / (count(*) + {H.SMOOTHING} * (SELECT count(DISTINCT w) FROM sents))), 9) AS lp FROM sents GROUP BY 1)"


def _sents(spark, d):
    return H.sentences(stream(spark, d, "word", "pos"))


@query(f"WITH {SENTS} SELECT input_id, seq, CAST(sent AS BIGINT) AS sent FROM sents")
def sentence_ids(spark: SparkSession, d: str) -> DataFrame:
    return _sents(spark, d).select("input_id", "seq", F.col("sent").cast("long").alias("sent"))


@query(f"WITH {SENTS}, {FIRSTS}, {INITIAL} SELECT * FROM ini")
def hmm_initial(spark: SparkSession, d: str) -> DataFrame:
    return H.train(_sents(spark, d)).initial()


@query(f"WITH {SENTS}, {TRANS} SELECT * FROM trans")
def hmm_transition(spark: SparkSession, d: str) -> DataFrame:
    return H.train(_sents(spark, d)).transitions()


@query(f"WITH {SENTS}, {EMIT} SELECT * FROM emit")
def hmm_emission(spark: SparkSession, d: str) -> DataFrame:
    return H.train(_sents(spark, d)).emissions()


@query(f"WITH {SENTS}, {MISS} SELECT * FROM miss")
def hmm_unseen(spark: SparkSession, d: str) -> DataFrame:
    return H.train(_sents(spark, d)).unseen()


@query(f"WITH {SENTS} SELECT word_before, w AS word, t AS tag, count(*) AS n FROM (SELECT coalesce(lag(w) OVER (PARTITION BY input_id, sent ORDER BY seq), '^') AS word_before, w, t FROM sents) GROUP BY 1, 2, 3")
def bigram_tags(spark: SparkSession, d: str) -> DataFrame:
    """How often each pair of neighbours had each tag."""
    return K.neighbours(_sents(spark, d)).groupBy("word_before", F.col("w").alias("word"), F.col("t").alias("tag")).agg(F.count("*").alias("n"))


_VITERBI = f"""WITH RECURSIVE {SENTS}, {FIRSTS}, {INITIAL}, {TRANS}, {EMIT}, {MISS}, {LEX},
known AS (SELECT DISTINCT word, p.tag, p.code FROM lex JOIN pos_tags p ON lex.pos = p.tag),
own AS (SELECT * FROM known k WHERE tag <> 'FW' OR NOT EXISTS (SELECT 1 FROM known o WHERE o.word = k.word AND o.tag <> 'FW')),
opens AS (SELECT tag, code FROM pos_tags WHERE tag IN ({', '.join(f"'{t}'" for t in H.OPEN_CLASS)})),
raw AS (SELECT s.input_id, s.sent, s.seq, s.w, o.tag, o.code FROM sents s JOIN own o ON s.w = o.word UNION ALL SELECT s.input_id, s.sent, s.seq, s.w, o.tag, o.code FROM sents s, opens o WHERE s.w NOT IN (SELECT word FROM own)),
cand AS MATERIALIZED (SELECT r.input_id, r.sent, r.seq, r.tag, r.code, coalesce(e.lp, m.lp, -30.0) AS e, dense_rank() OVER (PARTITION BY r.input_id, r.sent ORDER BY r.seq) AS i FROM raw r LEFT JOIN emit e ON r.tag = e.tag AND r.w = e.word LEFT JOIN miss m ON m.tag = r.tag),
tr AS MATERIALIZED (SELECT * FROM trans), st AS MATERIALIZED (SELECT * FROM ini),
v AS (SELECT c.input_id, c.sent, c.seq, c.i, c.tag, c.code, coalesce(st.lp, -30.0) + c.e AS score, CAST(NULL AS VARCHAR) AS prev FROM cand c LEFT JOIN st ON st.tag = c.tag WHERE c.i = 1
  UNION ALL SELECT c.input_id, c.sent, c.seq, c.i, c.tag, c.code, max(v.score + coalesce(tr.lp, -30.0) + c.e), arg_max(v.tag, {{'s': v.score + coalesce(tr.lp, -30.0) + c.e, 'c': -v.code}})
  FROM v JOIN cand c ON c.input_id = v.input_id AND c.sent = v.sent AND c.i = v.i + 1 LEFT JOIN tr ON tr.prev_tag = v.tag AND tr.tag = c.tag GROUP BY c.input_id, c.sent, c.seq, c.i, c.tag, c.code),
path AS (SELECT input_id, sent, seq, i, tag, prev FROM (SELECT *, row_number() OVER (PARTITION BY input_id, sent ORDER BY i DESC, score DESC, code) AS rn FROM v) WHERE rn = 1
  UNION ALL SELECT v.input_id, v.sent, v.seq, v.i, v.tag, v.prev FROM path p JOIN v ON v.input_id = p.input_id AND v.sent = p.sent AND v.i = p.i - 1 AND v.tag = p.prev)"""


def _decoded(spark, d):
    lx, sents = lexicon(spark, d), _sents(spark, d)
    return H.decode(sents, H.train(sents), lx.senses, lx.pos_tags)


@query(_VITERBI + " SELECT input_id, seq, tag FROM path")
def viterbi_tags(spark: SparkSession, d: str) -> DataFrame:
    return _decoded(spark, d).select("input_id", "seq", "tag")


@query(_VITERBI + ", sure AS (SELECT input_id, seq, 1.0 / sum(exp(score - top)) AS confidence FROM (SELECT *, max(score) OVER (PARTITION BY input_id, seq) AS top FROM v) GROUP BY 1, 2) SELECT tag, count(*) AS tokens, round(avg(confidence), 5) AS confidence FROM path JOIN sure USING (input_id, seq) GROUP BY 1")
def viterbi_confidence(spark: SparkSession, d: str) -> DataFrame:
    """Tokens and mean confidence per decoded tag."""
    return _decoded(spark, d).groupBy("tag").agg(F.count("*").alias("tokens"), F.round(F.avg("confidence"), 5).alias("confidence"))


# Context features, rules and scores.
def _case(words, w, name):
    return f"WHEN {w} IN ({', '.join(repr(x) for x in words)}) THEN '{name}'"


def _group(w):
    return "CASE " + " ".join(_case(ws, w, g) for g, ws in (("modal", MODALS), ("passive", PASSIVES), ("auxiliary", AUXILIARIES), ("perfect", PERFECTS), ("temporal", TEMPORALS), ("adverb", ADVERBS))) + " END"


def _suffix(w):
    return "CASE " + " ".join(f"WHEN ends_with({w}, '{s}') THEN '{s}'" for s in SUFFIXES) + " END"


def _prefix(w):
    return "CASE " + " ".join(f"WHEN starts_with({w}, '{p}') THEN '{p}'" for p in PREFIXES_BY_LENGTH) + " END"


def _short(t):
    return f"CASE WHEN starts_with({t}, 'N') OR {t} = 'SYS' THEN 'NN' WHEN starts_with({t}, 'V') THEN 'VB' WHEN starts_with({t}, 'J') THEN 'JJ' WHEN starts_with({t}, 'R') THEN 'RB' WHEN {t} IN ('CC', 'CS', 'CA') THEN 'CC' WHEN {t} IN ('PR', 'PRP') THEN 'PR' WHEN {t} IN ('SS', 'PUNC') THEN 'PUNC' WHEN {t} = 'IN' THEN 'IN' WHEN {t} = 'DT' THEN 'DT' ELSE 'FW' END"


AMBIG = f"{LEX}, {SENSE}, ambig AS (SELECT word FROM sense WHERE len(potential_pos) > 1)"
FEATS = f"""{TOK}, pron AS (SELECT l.word, t.pronoun FROM (SELECT word, token_id FROM sense) l JOIN tok t USING (token_id) WHERE t.pronoun IS NOT NULL),
nbr AS (SELECT s.input_id, s.seq, s.w, s.t, CAST(n.seq - s.seq AS INT) AS "offset", n.w AS nw, n.t AS nt, pr.pronoun.category AS pc, pr.pronoun.person AS pp, pr.pronoun.number AS pn FROM sents s JOIN ambig a ON a.word = s.w JOIN sents n ON n.input_id = s.input_id AND n.sent = s.sent AND n.seq BETWEEN s.seq - 8 AND s.seq + 4 AND n.seq <> s.seq LEFT JOIN pron pr ON pr.word = n.w),
kinds AS (SELECT *, unnest([{{'kind': 'tag', 'value': nt, 'base': 1.6}}, {{'kind': 'word', 'value': nw, 'base': 1.8}}, {{'kind': 'tag_group', 'value': {_short('nt')}, 'base': 1.2}}, {{'kind': 'word_group', 'value': {_group('nw')}, 'base': 1.4}}, {{'kind': 'suffix', 'value': {_suffix('nw')}, 'base': 1.0}}, {{'kind': 'prefix', 'value': {_prefix('nw')}, 'base': 1.0}}, {{'kind': 'pronoun_category', 'value': pc, 'base': 1.0}}, {{'kind': 'pronoun_person', 'value': pp, 'base': 1.0}}, {{'kind': 'pronoun_number', 'value': pn, 'base': 1.0}}]) AS f FROM nbr),
feats AS (SELECT input_id, seq, w, t, "offset", f.kind AS kind, f.value AS value, round(CAST(f.base AS DOUBLE) * CASE WHEN "offset" < 0 THEN 1 + CAST(0.15 AS DOUBLE) * (8 + "offset") ELSE 1 + CAST(0.25 AS DOUBLE) * (4 - "offset") END, 4) AS weight FROM kinds WHERE f.value IS NOT NULL)"""


def _pronouns(spark, d):
    return pronouns(lexicon(spark, d))


def _ambiguous(spark, d):
    return ambiguous(lexicon(spark, d))


@query(f"WITH {SENTS}, {AMBIG}, {FEATS} SELECT * FROM feats")
def context_features(spark: SparkSession, d: str) -> DataFrame:
    """Features around every token with several senses."""
    return K.features(_sents(spark, d), _ambiguous(spark, d), _pronouns(spark, d))


NEIGH = "neigh AS (SELECT input_id, seq, w, t, coalesce(lag(t) OVER o, '^') AS before, coalesce(lead(t) OVER o, '$') AS behind, coalesce(lag(w) OVER o, '^') AS word_before FROM sents WINDOW o AS (PARTITION BY input_id, sent ORDER BY seq))"
RULES = """rn AS (SELECT w, before, t, count(*) AS n FROM neigh GROUP BY 1, 2, 3),
rules AS (SELECT w, before, arg_max(t, {'n': n, 't': t}) AS tag, CAST(sum(n) AS BIGINT) AS support FROM rn GROUP BY 1, 2 HAVING sum(n) >= 3 AND max(n) * 10 >= sum(n) * 9),
exc AS (SELECT DISTINCT w, before, behind FROM neigh JOIN rules USING (w, before) WHERE t <> tag)"""


@query(f"WITH {SENTS}, {NEIGH}, {RULES} SELECT * FROM rules")
def tag_rules(spark: SparkSession, d: str) -> DataFrame:
    return K.learn_rules(_sents(spark, d))


@query(f"WITH {SENTS}, {NEIGH}, {RULES}, {AMBIG} SELECT input_id, seq, w, tag FROM neigh JOIN rules USING (w, before) WHERE w IN (SELECT word FROM ambig) AND NOT EXISTS (SELECT 1 FROM exc e WHERE e.w = neigh.w AND e.before = neigh.before AND e.behind = neigh.behind)")
def rule_resolution(spark: SparkSession, d: str) -> DataFrame:
    s = _sents(spark, d)
    ensure_checkpoint_dir(spark)
    rules = K.learn_rules(s).checkpoint()
    return K.apply_rules(s, _ambiguous(spark, d), rules, K.learn_exceptions(s, rules).checkpoint())


_RESOLVE_PARTS = """sc AS (SELECT *, n / sum(n) OVER (PARTITION BY w, "offset", kind, value) AS score FROM (SELECT w, "offset", kind, value, t AS tag, count(*) AS n FROM feats GROUP BY ALL)),
hits AS (SELECT f.input_id, f.seq, f.w, f."offset", f.kind, s.tag, f.weight * s.score AS p FROM feats f JOIN sc s USING (w, "offset", kind, value)),
parts AS (SELECT input_id, seq, w, "offset", tag, max(p) AS p FROM hits WHERE kind IN ('word', 'tag') GROUP BY ALL UNION ALL SELECT input_id, seq, w, "offset", tag, p FROM hits WHERE kind NOT IN ('word', 'tag')),
tot AS (SELECT input_id, seq, w, tag, sum(p) AS p FROM parts GROUP BY ALL), shr AS (SELECT *, p / sum(p) OVER (PARTITION BY input_id, seq) AS q FROM tot),
fr AS (SELECT w, t AS tag, count(*) / sum(count(*)) OVER (PARTITION BY w) AS freq FROM sents WHERE w IN (SELECT word FROM ambig) GROUP BY 1, 2),
bl AS (SELECT input_id, seq, w, tag, round(0.8 * q + 0.2 * coalesce(freq, 0.0), 6) AS score FROM shr LEFT JOIN fr USING (w, tag))"""
_RESOLVE = f"WITH {SENTS}, {AMBIG}, {FEATS}, {_RESOLVE_PARTS}"


@query(_RESOLVE + " SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY input_id, seq ORDER BY score DESC, tag) AS rn FROM bl) WHERE rn = 1")
def feature_resolution(spark: SparkSession, d: str) -> DataFrame:
    return by_word.resolve(_sents(spark, d), _ambiguous(spark, d), _pronouns(spark, d))


_CLASS_PARTS = re.sub(r"\b(sc|hits|parts|tot|shr|fr|bl|feats)\b", r"c\1", _RESOLVE_PARTS).replace(
    "SELECT w, t AS tag, count(*) / sum(count(*)) OVER (PARTITION BY w) AS freq FROM sents WHERE w IN (SELECT word FROM ambig) GROUP BY 1, 2", "SELECT cls AS w, t AS tag, count(*) / sum(count(*)) OVER (PARTITION BY cls) AS freq FROM sents JOIN acls ON acls.word = sents.w GROUP BY 1, 2"
)
_RESOLVED = f"""{_VITERBI}, {SENSE}, ambig AS (SELECT word FROM sense WHERE len(potential_pos) > 1), {FEATS}, {_RESOLVE_PARTS}, {NEIGH}, {RULES},
acls AS (SELECT word, array_to_string(list_sort(list_distinct(potential_pos)), '|') AS cls FROM sense WHERE len(potential_pos) > 1), cfeats AS (SELECT f.* REPLACE (a.cls AS w) FROM feats f JOIN acls a ON a.word = f.w), {_CLASS_PARTS},
bestc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY input_id, seq ORDER BY score DESC, tag) AS rn FROM cbl) WHERE rn = 1),
sure AS (SELECT input_id, seq, 1.0 / sum(exp(score - top)) AS confidence FROM (SELECT *, max(score) OVER (PARTITION BY input_id, seq) AS top FROM v) GROUP BY 1, 2),
bestf AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY input_id, seq ORDER BY score DESC, tag) AS rn FROM bl) WHERE rn = 1),
ruled AS (SELECT input_id, seq, tag FROM neigh JOIN rules USING (w, before) WHERE w IN (SELECT word FROM ambig) AND NOT EXISTS (SELECT 1 FROM exc e WHERE e.w = neigh.w AND e.before = neigh.before AND e.behind = neigh.behind)),
al AS (SELECT s.input_id, s.seq, s.w, s.t, s.w IN (SELECT word FROM ambig) AS a, p.tag AS h, y.confidence, r.tag AS r, f.tag AS f, f.score, c.tag AS c, c.score AS class_score FROM sents s JOIN path p USING (input_id, seq) JOIN sure y USING (input_id, seq) LEFT JOIN ruled r USING (input_id, seq) LEFT JOIN bestf f USING (input_id, seq) LEFT JOIN bestc c USING (input_id, seq)),
how AS (SELECT *, CASE WHEN a AND r IS NOT NULL THEN 'rule' WHEN a AND score >= {K.SURE} THEN 'feature' WHEN a AND class_score >= {K.SURE} THEN 'class' WHEN a OR t = 'FW' THEN 'hmm' ELSE 'unambiguous' END AS method FROM al)
SELECT input_id, seq, w AS word, CASE method WHEN 'rule' THEN r WHEN 'feature' THEN f WHEN 'class' THEN c ELSE h END AS tag, method, round(CASE WHEN method IN ('rule', 'unambiguous') THEN 1.0 WHEN method = 'feature' THEN score WHEN method = 'class' THEN class_score ELSE confidence END, 6) AS confidence FROM how"""


@query(_RESOLVED)
def resolved_tags(spark: SparkSession, d: str) -> DataFrame:
    """The tag of every token and how it was found: rule, word's features, its class's features, best path, or unambiguous."""
    lx = lexicon(spark, d)
    s = stream(spark, d, "word", "pos")
    return Tagger.train(s, lx).resolve(H.sentences(s), lx)


# Spell correction.
def _pos_class(p):
    return f"CASE WHEN starts_with({p}, 'NNP') THEN 'entity' WHEN starts_with({p}, 'N') OR {p} = 'SYS' THEN 'noun' WHEN starts_with({p}, 'V') THEN 'verb' WHEN starts_with({p}, 'R') THEN 'adverb' WHEN starts_with({p}, 'J') THEN 'adjective' ELSE 'other' END"


def _ranked(col, out):
    return f"(SELECT w, list(x ORDER BY i) AS {out} FROM (SELECT w, {col} AS x, row_number() OVER (PARTITION BY w ORDER BY count(*) DESC, {col}) AS i FROM neigh GROUP BY w, {col}) WHERE i <= 3 GROUP BY w)"


def _bonus(table, affix):
    return "coalesce(" + " + ".join(f"CASE WHEN c = '{tag}' AND {affix} IN ({', '.join(repr(a) for a in affixes.split())}) THEN {bonus} ELSE 0.0 END" for tag, bonus, affixes in table) + ", 0.0)"


COHORTS = f"""cohorts AS (SELECT *, row_number() OVER (PARTITION BY pos_class, size_class ORDER BY coalesce(use, 0) DESC, token_id) - 1 AS rank, count(*) OVER (PARTITION BY pos_class, size_class) AS cohort FROM (
  SELECT t.token_id, t.word, {_pos_class('t.pos')} AS pos_class, CASE WHEN length(t.word) <= 4 THEN 'short' WHEN length(t.word) <= 6 THEN 'short_medium' WHEN length(t.word) <= 8 THEN 'medium' WHEN length(t.word) <= 10 THEN 'medium_long' ELSE 'long' END AS size_class, u.use, tb.tag_before, wb.word_before
  FROM tok t LEFT JOIN (SELECT w, count(*) AS use FROM neigh GROUP BY 1) u ON u.w = t.word LEFT JOIN {_ranked('before', 'tag_before')} tb ON tb.w = t.word LEFT JOIN {_ranked('word_before', 'word_before')} wb ON wb.w = t.word WHERE regexp_full_match(t.word, '{SP.LETTERS}')))"""
PREDICT = f"""unk AS (SELECT DISTINCT w, before, word_before FROM neigh WHERE t = 'FW' AND regexp_full_match(w, '{SP.LETTERS}')),
cls AS (SELECT before, CASE WHEN starts_with(t, 'N') OR t = 'SYS' THEN 'NN' WHEN starts_with(t, 'V') THEN 'VB' WHEN starts_with(t, 'R') THEN 'RB' WHEN starts_with(t, 'J') THEN 'JJ' END AS c FROM neigh),
shr AS (SELECT before, c, count(*) / sum(count(*)) OVER (PARTITION BY before) AS share FROM cls WHERE c IS NOT NULL GROUP BY 1, 2), frq AS (SELECT c, count(*) / sum(count(*)) OVER () AS freq FROM cls WHERE c IS NOT NULL GROUP BY 1),
rawp AS (SELECT w, before, word_before, c, share * sqrt(0.10 / greatest(freq, 1e-6)) + {_bonus(SP.SUFFIX_BONUS, _suffix('w'))} + {_bonus(SP.PREFIX_BONUS, _prefix('w'))} AS r FROM unk JOIN shr USING (before) JOIN frq USING (c)),
pred AS (SELECT w, before, word_before, c, round(r / sum(r) OVER (PARTITION BY w, before, word_before), 6) AS p FROM rawp)"""
# levenshtein counts bytes there: letters with accents are first brought to single bytes
_ACCENTS = "ßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿœ"
_BYTES = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456"
_DISTANCE = f"levenshtein(translate(p.w, '{_ACCENTS}', '{_BYTES}'), translate(c.word, '{_ACCENTS}', '{_BYTES}'))"
PROBES = f"""probes AS (SELECT w, before, word_before AS probe_before, CASE c WHEN 'NN' THEN 'noun' WHEN 'VB' THEN 'verb' WHEN 'RB' THEN 'adverb' ELSE 'adjective' END AS pos_class,
  unnest(CASE WHEN length(w) <= 3 THEN ['short'] WHEN length(w) <= 5 THEN ['short', 'short_medium'] WHEN length(w) <= 7 THEN ['short_medium', 'medium'] WHEN length(w) <= 11 THEN ['medium', 'medium_long', 'long'] ELSE ['medium_long', 'long'] END) AS size_class FROM pred WHERE p >= 0.2),
fnd AS (SELECT p.w, p.before, p.probe_before, c.token_id, c.word, c.rank, c.cohort, CAST({_DISTANCE} AS INT) AS distance, c.tag_before, c.word_before FROM probes p JOIN cohorts c USING (pos_class, size_class) WHERE {_DISTANCE} BETWEEN 1 AND 3),
spell AS (SELECT * EXCLUDE (least) FROM (SELECT *, min(distance) OVER (PARTITION BY w, before, probe_before) AS least FROM fnd) WHERE distance = least)"""
SPELL = f"WITH {SENTS}, {NEIGH}, {TOK}, {COHORTS}, {PREDICT}, {PROBES}"


@query(f"WITH {SENTS}, {NEIGH}, {TOK}, {COHORTS} SELECT pos_class, size_class, rank, cohort, token_id, word, tag_before, word_before FROM cohorts")
def spell_cohorts(spark: SparkSession, d: str) -> DataFrame:
    return SP.cohorts(lexicon(spark, d).tokens, _sents(spark, d))


@query(f"WITH {SENTS}, {NEIGH}, {PREDICT} SELECT * FROM pred")
def cohort_prediction(spark: SparkSession, d: str) -> DataFrame:
    """Classes of unknown words."""
    s = _sents(spark, d)
    return SP.predict_classes(SP.unknown_words(s), *SP.class_shares(s))


@query(SPELL + " SELECT w, before, probe_before, token_id, word, rank, cohort, distance FROM spell")
def spell_candidates(spark: SparkSession, d: str) -> DataFrame:
    return _spell(spark, d).drop("tag_before", "word_before")


def _spell(spark, d):
    return SP.spell_candidates(cohort_prediction(spark, d), spell_cohorts(spark, d))


def _same(f):
    return f"coalesce({f('w')} = {f('word')}, false)"


_SCORED = f"""scored AS (SELECT w, before, probe_before, token_id, word, rank, distance, round(greatest(0, 3 - floor(rank / greatest(floor(cohort / 3), 1))) * 0.40 + (4 - distance) * 0.85
  + CASE WHEN coalesce(list_position(tag_before, before), 0) > 0 THEN 4 - list_position(tag_before, before) ELSE 0 END * 0.55 + CASE WHEN coalesce(list_position(word_before, probe_before), 0) > 0 THEN 4 - list_position(word_before, probe_before) ELSE 0 END * 0.65
  + CASE WHEN {_same(_suffix)} THEN 0.75 ELSE 0 END + CASE WHEN {_same(_prefix)} THEN 0.75 ELSE 0 END
  + CASE WHEN len(list_filter([{', '.join(repr(c * 2) for c in 'abcdefghijklmnopqrstuvwxyz')}], lambda x: contains(w, x) AND NOT contains(word, x))) > 0 THEN 0.35 ELSE 0 END, 4) AS score FROM spell)"""


@query(f"{SPELL}, {_SCORED} SELECT w, before, probe_before, token_id, word, distance, CAST(score AS DOUBLE) AS score FROM (SELECT *, row_number() OVER (PARTITION BY w, before, probe_before ORDER BY score DESC, rank, token_id, word) AS rn FROM scored) WHERE rn = 1")
def spell_best(spark: SparkSession, d: str) -> DataFrame:
    return SP.spell_best(SP.spell_scores(_spell(spark, d)))


def queries() -> dict:
    return Q


def oracle_sql() -> dict[str, str]:
    return S
