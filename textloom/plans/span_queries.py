"""Spans, intents, categories, scores and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import fixed8
from textloom.functions import predicates as P
from textloom.lexicon import preprocess_rows
from textloom.operators import categories as C
from textloom.operators import scores as SC
from textloom.operators import spans as X
from textloom.plans.base import CATS, LEX, SENSE, STREAM, TOK, lexicon, stream, values_sql
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


_NEAR = """near AS (SELECT input_id, seq, lower(word) AS w1, lead(lower(word), 1) OVER o AS w2, lead(lower(word), 2) OVER o AS w3, lead(seq, 1) OVER o AS s2, lead(seq, 2) OVER o AS s3 FROM {0} WINDOW o AS (PARTITION BY input_id ORDER BY seq))"""
_GRAMS = """{0} AS (SELECT input_id, seq, 2 AS n, w1 || ' ' || w2 AS phrase FROM {1} WHERE s2 = seq + 1 UNION ALL SELECT input_id, seq, 3, w1 || ' ' || w2 || ' ' || w3 FROM {1} WHERE s2 = seq + 1 AND s3 = seq + 2)"""
PHRASES = f"""wordrows AS (SELECT * FROM stream WHERE token_type = 'word'), {_NEAR.format('wordrows').replace('near AS', 'wnear AS')}, {_GRAMS.format('wgrams', 'wnear')},
phrases AS (SELECT phrase, n, CASE WHEN n = 2 THEN 'both' ELSE 'standard' END AS mwe_type FROM wgrams GROUP BY 1, 2 HAVING count(*) >= 12)"""
CANDS = f"{STREAM}, {PHRASES}, {_NEAR.format('stream')}, {_GRAMS.format('grams', 'near')}, cands AS (SELECT g.input_id, g.seq, g.n, g.phrase, p.mwe_type FROM grams g JOIN phrases p USING (phrase, n))"
LONGEST = """best AS (SELECT input_id, seq, max(n) AS n, arg_max(phrase, n) AS phrase FROM {0} GROUP BY 1, 2),
linked AS (SELECT b.*, (SELECT min(c.seq) FROM best c WHERE c.input_id = b.input_id AND c.seq >= b.seq + b.n) AS nxt FROM best b),
walk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY input_id ORDER BY seq) AS rn FROM linked) WHERE rn = 1
  UNION ALL SELECT l.*, 2 FROM walk w JOIN linked l ON l.input_id = w.input_id AND l.seq = w.nxt),
spans AS (SELECT input_id, seq, n, phrase FROM walk)"""


def _phrases(spark, d):
    """Phrases counted in the stream, written once: their number and length are asked before they are joined."""
    ensure_checkpoint_dir(spark)
    return mwe_phrases(spark, d).checkpoint()


@query(f"WITH {STREAM}, {PHRASES} SELECT * FROM phrases")
def mwe_phrases(spark: SparkSession, d: str) -> DataFrame:
    return X.derive_phrases(stream(spark, d, "word", "token_type"))


@query(f"WITH {CANDS} SELECT * FROM cands")
def mwe_candidates(spark: SparkSession, d: str) -> DataFrame:
    return X.candidates(stream(spark, d, "word"), _phrases(spark, d))


@query(f"WITH RECURSIVE {CANDS}, {LONGEST.format('cands')} SELECT * FROM spans")
def mwe_longest(spark: SparkSession, d: str) -> DataFrame:
    return X.leftmost_longest(mwe_candidates(spark, d))


@query(f"WITH RECURSIVE {CANDS}, scoring AS (SELECT * FROM cands WHERE mwe_type IN ('scoring', 'both')), {LONGEST.format('scoring')} SELECT * FROM spans")
def mwe_scoring_longest(spark: SparkSession, d: str) -> DataFrame:
    """Spans of the scoring stream."""
    return X.leftmost_longest(mwe_candidates(spark, d).where("mwe_type in ('scoring', 'both')"))


_VIEW = """covered AS (SELECT input_id, unnest(generate_series(seq, seq + n - 1)) AS seq FROM spans),
view AS (SELECT input_id, seq, 1 AS n, word, coalesce(upper(pos), 'FW') AS pos FROM stream s WHERE NOT EXISTS (SELECT 1 FROM covered c WHERE c.input_id = s.input_id AND c.seq = s.seq)
  UNION ALL SELECT input_id, seq, n, phrase, 'MWE' FROM spans)"""


@query(f"WITH RECURSIVE {CANDS}, {LONGEST.format('cands')}, {_VIEW} SELECT * FROM view")
def mwe_view(spark: SparkSession, d: str) -> DataFrame:
    return X.span_view(stream(spark, d, "word", "pos"), mwe_longest(spark, d))


@query(f"WITH RECURSIVE {CANDS}, scoring AS (SELECT * FROM cands WHERE mwe_type IN ('scoring', 'both')), {LONGEST.format('scoring')}, {_VIEW} SELECT * FROM view")
def mwe_scoring_view(spark: SparkSession, d: str) -> DataFrame:
    return X.span_view(stream(spark, d, "word", "pos"), mwe_scoring_longest(spark, d))


@query(f"WITH {STREAM}, ws AS (SELECT DISTINCT word FROM stream WHERE regexp_full_match(word, '[a-zA-Z]+')) SELECT word, CASE WHEN lower(word) = word THEN 'lower' WHEN upper(word) = word THEN 'upper' WHEN upper(left(word, 1)) || lower(substr(word, 2)) = word THEN 'title' ELSE 'other' END AS style, upper(left(word, 1)) || lower(substr(word, 2)) AS titled FROM ws")
def capital_styles(spark: SparkSession, d: str) -> DataFrame:
    ws = stream(spark, d, "word").where(F.col("word").rlike("^[a-zA-Z]+$")).select("word").distinct()
    return ws.select("word", X.capital_style(F.col("word")).alias("style"), X.apply_style(F.col("word"), F.lit("title"), F.col("word")).alias("titled"))


def _future_sql() -> str:
    longest = max(len(p.split()) for p in X.FUTURE_PATTERNS)
    near = ", ".join(f"lead(lower(word), {k}) OVER o AS w{k}, upper(lead(pos, {k}) OVER o) AS p{k}" for k in range(longest))
    parts = []
    for p in X.FUTURE_PATTERNS:
        ws = p.split()
        ok = " AND ".join((f"p{k} = '{x}'" if x.startswith("V") else f"w{k} = '{x}'") for k, x in enumerate(ws))
        pos = "VHF" if "have" in ws else "VF" if "VB" in ws else "VFG"
        parts.append(f"SELECT input_id, seq, {len(ws)} AS n, {' || chr(32) || '.join(f'w{k}' for k in range(len(ws)))} AS words, '{pos}' AS pos, {'true' if 'not' in ws else 'false'} AS is_negative FROM fnear WHERE {ok}")
    return f"WITH {STREAM}, fnear AS (SELECT input_id, seq, {near} FROM stream WINDOW o AS (PARTITION BY input_id ORDER BY seq)), fhits AS ({' UNION ALL '.join(parts)}) SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY input_id, seq ORDER BY n DESC) AS rn FROM fhits) WHERE rn = 1"


@query(_future_sql())
def future_verbs(spark: SparkSession, d: str) -> DataFrame:
    return X.future_verbs(stream(spark, d, "word", "pos"))


_VERB_SPANS = f"""WITH {STREAM}, marked AS (SELECT *, lower(word) IN ('not', 'have', 'has', 'had') AS marker,
    (starts_with(coalesce(upper(pos), 'FW'), 'N') OR coalesce(upper(pos), 'FW') = 'SYS' OR starts_with(coalesce(upper(pos), 'FW'), 'V')) AND lower(word) NOT IN ('not', 'have', 'has', 'had') AS closes FROM stream),
grouped AS (SELECT *, coalesce(sum(CASE WHEN closes OR coalesce(upper(pos), 'FW') = 'SS' THEN 1 ELSE 0 END) OVER (PARTITION BY input_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM marked),
agg AS (SELECT input_id, g, min(seq) FILTER (marker) AS seq, max(seq) FILTER (closes) AS last_seq, max(upper(pos)) FILTER (closes) AS p, coalesce(bool_or(lower(word) = 'not') FILTER (marker), false) AS is_negative,
  coalesce(bool_or(lower(word) = 'had') FILTER (marker), false) AS had, arg_min(lower(word), seq) FILTER (marker) AS marker FROM grouped GROUP BY 1, 2),
vspans AS (SELECT input_id, seq, last_seq, CASE WHEN had AND p IN ('VBD', 'VBN') THEN 'VHP' WHEN p = 'VB' THEN 'VH' WHEN p = 'VBZ' THEN 'VHZ' ELSE p END AS pos, is_negative, marker FROM agg WHERE seq < last_seq)"""


@query(_VERB_SPANS + " SELECT * FROM vspans WHERE is_negative")
def negation_spans(spark: SparkSession, d: str) -> DataFrame:
    return X.verb_spans(stream(spark, d, "word", "pos")).where("is_negative")


@query(_VERB_SPANS + " SELECT * FROM vspans WHERE NOT is_negative")
def have_spans(spark: SparkSession, d: str) -> DataFrame:
    return X.verb_spans(stream(spark, d, "word", "pos")).where("not is_negative")


@query(_VERB_SPANS + ", neg AS (SELECT input_id, last_seq AS seq FROM vspans WHERE is_negative) SELECT s.input_id, s.seq, s.word, n.seq IS NOT NULL AS is_negative FROM stream s LEFT JOIN neg n ON s.input_id = n.input_id AND s.seq = n.seq")
def negation_flags(spark: SparkSession, d: str) -> DataFrame:
    """Whether each token closes a negated group."""
    s = stream(spark, d, "word", "pos")
    n = X.verb_spans(s).where("is_negative").select("input_id", F.col("last_seq").alias("seq"), F.lit(True).alias("_n"))
    return s.join(n, ["input_id", "seq"], "left").select("input_id", "seq", "word", F.coalesce("_n", F.lit(False)).alias("is_negative"))


_PRE = values_sql(preprocess_rows(), "w, tag, value")
_PERIOD = f"""WITH {STREAM}, pre AS (SELECT * FROM {_PRE}), t0 AS (SELECT input_id, seq, lower(word) AS w, p.tag, p.value AS unit FROM stream s LEFT JOIN (SELECT w AS pw, tag, value FROM pre WHERE tag IN ('|date_period|', '|time_period|', '|day_of_week|', '|month|')) p ON lower(s.word) = p.pw),
t AS (SELECT *, lag(w, 1) OVER o AS b1, lag(w, 2) OVER o AS b2, lead(w, 1) OVER o AS a1, tag IN ('|date_period|', '|time_period|') AS period, tag IN ('|day_of_week|', '|month|') AS isdate FROM t0 WINDOW o AS (PARTITION BY input_id ORDER BY seq)),
u AS (SELECT *, coalesce(regexp_matches(b1, '^[0-9][0-9,.]*$'), false) AS num, coalesce(period AND a1 IN ('ago', 'prior', 'earlier', 'before', 'since', 'later', 'ahead', 'afterwards'), false) AS suffixed FROM t),
v AS (SELECT *, CASE WHEN period AND a1 IN ('ago', 'prior', 'earlier', 'before', 'since') THEN 'past' WHEN period AND a1 IN ('later', 'ahead', 'afterwards') THEN 'future' WHEN period AND num AND b2 IN ('last', 'past', 'prior') THEN 'past'
  WHEN period AND num AND b2 IN ('in', 'next', 'within', 'following') THEN 'future' WHEN isdate AND b1 IN ('last', 'past', 'prior') THEN 'past' WHEN isdate AND b1 IN ('next', 'following') THEN 'future' END AS tense FROM u)
SELECT input_id, CASE WHEN isdate THEN seq - 1 WHEN suffixed AND num THEN seq - 1 WHEN suffixed THEN seq ELSE seq - 2 END AS seq, CASE WHEN suffixed THEN seq + 1 ELSE seq END AS last_seq,
  '|' || tense || '_' || replace(tag, '|', '') || '|' AS tag, CASE WHEN num AND period THEN b1 END AS value, unit FROM v WHERE tense IS NOT NULL"""


@query(_PERIOD)
def date_periods(spark: SparkSession, d: str) -> DataFrame:
    return X.period_spans(stream(spark, d, "word"), lexicon(spark, d).preprocess())


@query(f"WITH {STREAM}, pre AS (SELECT * FROM {_PRE}), t AS (SELECT input_id, seq, lower(word) AS w, lead(lower(word)) OVER (PARTITION BY input_id ORDER BY seq) AS nx FROM stream) SELECT input_id, seq, t.w AS value, p.value AS unit, p.tag FROM t JOIN pre p ON t.nx = p.w AND p.tag IN ('|date_period|', '|time_period|') WHERE regexp_matches(t.w, '^[0-9][0-9,.]*$')")
def number_unit_merge(spark: SparkSession, d: str) -> DataFrame:
    return X.number_units(stream(spark, d, "word"), lexicon(spark, d).preprocess())


_FUTURE_BODY = _future_sql().split("WITH ", 1)[1].replace(STREAM + ", ", "").replace(" SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY input_id, seq ORDER BY n DESC) AS rn FROM fhits) WHERE rn = 1", "")
VERB_BODY = _VERB_SPANS.split("WITH ", 1)[1].replace(STREAM + ", ", "").replace("marked AS", "marked AS").replace("grouped AS", "vgrouped AS").replace("FROM grouped", "FROM vgrouped").replace(" agg AS", " vagg AS").replace("\nagg AS", "\nvagg AS").replace("FROM agg", "FROM vagg")
_PERIOD_BODY = _PERIOD.split("WITH ", 1)[1].replace(STREAM + ", ", "")
_PERIOD_HEAD, _PERIOD_SELECT = _PERIOD_BODY.rsplit("\nSELECT input_id", 1)
def merged_sql(cands: str, own_pre: bool = False) -> str:
    """CTEs and result of the view over the CTE ``stream``; own_pre: the look-up ``pre`` is there already."""
    head = _PERIOD_HEAD.replace(f"pre AS (SELECT * FROM {_PRE}), ", "") if own_pre else _PERIOD_HEAD
    return f"""{cands}, {_FUTURE_BODY}, {VERB_BODY}, {head}, periods AS (SELECT input_id{_PERIOD_SELECT}),
numbers AS (SELECT t0.input_id, t0.seq, p.tag FROM (SELECT input_id, seq, lower(word) AS w, lead(lower(word)) OVER (PARTITION BY input_id ORDER BY seq) AS nx FROM stream) t0 JOIN pre p ON t0.nx = p.w AND p.tag IN ('|date_period|', '|time_period|') WHERE regexp_matches(t0.w, '^[0-9][0-9,.]*$')),
every AS (SELECT input_id, seq, n, phrase, 'MWE' AS pos, 'mwe' AS kind, 1 AS pref FROM cands WHERE mwe_type <> 'scoring'
  UNION ALL SELECT input_id, seq, last_seq - seq + 1, tag, 'SYS', 'period', 2 FROM periods UNION ALL SELECT input_id, seq, n, words, pos, 'future', 3 FROM fhits
  UNION ALL SELECT input_id, seq, 2, tag, 'SYS', 'number', 4 FROM numbers),
best AS (SELECT input_id, seq, n, phrase, pos, kind FROM (SELECT *, row_number() OVER (PARTITION BY input_id, seq ORDER BY n DESC, pref, coalesce(phrase, '')) AS rn FROM every) WHERE rn = 1),
linked AS (SELECT b.*, (SELECT min(c.seq) FROM best c WHERE c.input_id = b.input_id AND c.seq >= b.seq + b.n) AS nxt FROM best b),
chosen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY input_id ORDER BY seq) AS rn FROM linked) WHERE rn = 1 UNION ALL SELECT l.*, 2 FROM chosen w JOIN linked l ON l.input_id = w.input_id AND l.seq = w.nxt),
walk AS (SELECT input_id, seq, n, phrase, pos, kind FROM chosen UNION ALL SELECT input_id, seq, last_seq - seq + 1, NULL, pos, 'verb' FROM vspans v
  WHERE NOT EXISTS (SELECT 1 FROM chosen c WHERE c.input_id = v.input_id AND c.seq <= v.last_seq AND c.seq + c.n - 1 >= v.seq)),
inside AS (SELECT w.input_id, w.seq AS began, s.seq, s.word FROM walk w JOIN stream s ON s.input_id = w.input_id AND s.seq BETWEEN w.seq AND w.seq + w.n - 1),
texts AS (SELECT input_id, began, string_agg(coalesce(word, ''), ' ' ORDER BY seq) AS words FROM inside GROUP BY 1, 2)
SELECT w.input_id, w.seq, CAST(w.n AS INT) AS n, coalesce(w.phrase, t.words) AS word, w.pos, 0 AS token_id, w.kind FROM walk w JOIN texts t ON t.input_id = w.input_id AND t.began = w.seq
UNION ALL SELECT s.input_id, s.seq, 1, s.word, CASE WHEN upper(s.pos) IN (SELECT tag FROM pos_tags) THEN upper(s.pos) ELSE 'FW' END, s.token_id, NULL FROM stream s WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE i.input_id = s.input_id AND i.seq = s.seq)"""


@query("WITH RECURSIVE " + merged_sql(CANDS))
def merged_view(spark: SparkSession, d: str) -> DataFrame:
    """The view with every kind of span: phrases, future groups, groups of not, have and had, periods, numbers with units."""
    ensure_checkpoint_dir(spark)
    s = stream(spark, d, "word", "pos", "token_id", "token_type").checkpoint()  # read by every kind of span
    phrases = X.derive_phrases(s).checkpoint()
    s = s.drop("token_type")
    return X.merged_view(s, X.all_spans(s, phrases, lexicon(spark, d).preprocess()))


_INTENT = f"""WITH {STREAM}, paths AS (SELECT * FROM {values_sql(X.intent_rows(), 'phrase, n, intent')}),
near AS (SELECT input_id, seq, [lower(word), lead(lower(word), 1) OVER o, lead(lower(word), 2) OVER o, lead(lower(word), 3) OVER o, lead(lower(word), 4) OVER o, lead(lower(word), 5) OVER o] AS ws FROM stream WINDOW o AS (PARTITION BY input_id ORDER BY seq)),
hits AS (SELECT input_id, seq, p.n, p.intent FROM near JOIN paths p ON array_to_string(ws[1 : p.n], ' ') = p.phrase AND len(list_filter(ws[1 : p.n], lambda x: x IS NOT NULL)) = p.n),
found AS (SELECT input_id, seq, arg_min(intent, {{'n': n, 'i': intent}}) AS intent, min(n) AS n FROM hits GROUP BY 1, 2)"""


def _intents(spark, d):
    return X.intents(stream(spark, d, "word"), spark.createDataFrame(X.intent_rows(), "phrase string, n int, intent string"))


@query(_INTENT + " SELECT * FROM found")
def intent_match(spark: SparkSession, d: str) -> DataFrame:
    return _intents(spark, d)


@query(_INTENT + ", sums AS (SELECT input_id, intent, sum(n) AS total FROM found GROUP BY 1, 2), top AS (SELECT input_id, intent, total FROM (SELECT *, row_number() OVER (PARTITION BY input_id ORDER BY total DESC, ascii(intent), intent DESC) AS rn FROM sums) WHERE rn = 1), size AS (SELECT input_id, count(*) AS c FROM stream GROUP BY 1) SELECT input_id, coalesce(intent, 'neutral') AS intent, coalesce(total / c, 0.0) AS score FROM size LEFT JOIN top USING (input_id)")
def intent_scores(spark: SparkSession, d: str) -> DataFrame:
    return X.intent_scores(_intents(spark, d), stream(spark, d, "word"))


# Token predicates and categories.
_PRED = """coalesce(upper(pos), 'FW') AS t FROM stream)
SELECT input_id, seq, starts_with(t, 'N') OR t = 'SYS' AS is_noun, starts_with(t, 'V') AS is_verb, t IN ('VB', 'VBG') AS is_base_verb, t IN ('VBD', 'VBN', 'VHP') AS is_past_verb, t IN ('VB', 'VBG', 'VBZ', 'VH', 'VHZ') AS is_present_verb,
 t IN ('VF', 'VFG', 'VHF') AS is_future_verb, starts_with(t, 'J') AS is_adjective, starts_with(t, 'R') AS is_adverb, starts_with(t, 'NNP') AS is_named_entity, t = 'MWE' AS is_ngram, t IN ('CC', 'CS', 'CA') AS is_conjunction, t = 'DT' AS is_determiner,
 t IN ('PR', 'PRP') AS is_pronoun, t = 'MD' AS is_modal_verb, t = 'IN' AS is_preposition, t = 'SS' AS is_sentence_stopper, t IN ('SS', 'PUNC') AS is_punctuation, t = 'PUNC' AS is_phrase_splitter FROM p"""


@query(f"WITH {STREAM}, p AS (SELECT input_id, seq, {_PRED}")
def token_predicates(spark: SparkSession, d: str) -> DataFrame:
    return stream(spark, d, "pos").select("input_id", "seq", *(f(F.col("pos")).alias(n) for n, f in P.ALL.items()))


@query(f"WITH {TOK} SELECT token_id, pronoun.category AS category, coalesce(pronoun.category IN ('personal', 'possessive', 'reflexive') AND pronoun.person <> 'first', false) AS is_anaphora FROM tok WHERE pronoun IS NOT NULL")
def anaphora_tokens(spark: SparkSession, d: str) -> DataFrame:
    return lexicon(spark, d).tokens.where("pronoun is not null").select("token_id", "pronoun.category", P.is_anaphora(F.col("pronoun")).alias("is_anaphora"))


@query(f"WITH {TOK}, {CATS} SELECT c.cat_id, c.path, c.tree, list(DISTINCT t.token_id ORDER BY t.token_id) FILTER (t.token_id IS NOT NULL) AS token_ids FROM cats c LEFT JOIN (SELECT token_id, unnest(categories) AS cat_id FROM tok) t USING (cat_id) WHERE c.depth >= 1 GROUP BY ALL")
def category_by_path(spark: SparkSession, d: str) -> DataFrame:
    """Every category below a tree with the ids of the tokens that have exactly this category."""
    return C.with_tokens(lexicon(spark, d), min_depth=1)


@query(f"WITH {CATS}, {TOK} SELECT c.cat_id, c.path, count(DISTINCT t.token_id) AS tokens FROM cats c JOIN (SELECT token_id, unnest(categories) AS cat FROM tok) t ON t.cat >= c.range_lo AND t.cat < c.range_hi GROUP BY 1, 2")
def category_subtree(spark: SparkSession, d: str) -> DataFrame:
    """Tokens within the range of every category's subtree."""
    return C.subtree_counts(lexicon(spark, d))


@query("SELECT c.cat_id, c.path, CAST(count(x.cat_id) AS BIGINT) AS descendants, CAST(c.range_hi - c.range_lo - 1 AS BIGINT) AS by_range FROM categories c LEFT JOIN categories x ON starts_with(x.path, c.path || '/') GROUP BY ALL")
def category_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Descendants of every category, counted along the paths, and the number its range implies."""
    from textloom.sources import read_table

    return C.descendants(read_table(spark, d, "categories"))


@query(f"WITH {CATS} SELECT c.cat_id, array_to_string(list(coalesce(n.name, '') ORDER BY f.i), '/') AS names FROM (SELECT cat_id, fqn[i] AS part, i FROM (SELECT cat_id, fqn, unnest(generate_series(1, len(fqn))) AS i FROM cats)) f JOIN cats c USING (cat_id) LEFT JOIN cats n ON n.cat_id = f.part GROUP BY 1")
def category_names(spark: SparkSession, d: str) -> DataFrame:
    """The names along the way to every category; a missing one is empty."""
    return C.names(lexicon(spark, d))


@query(f"WITH {TOK}, {CATS} SELECT token_id, list(c.fqn ORDER BY c.cat_id) AS vectors FROM (SELECT DISTINCT token_id, unnest(categories) AS cat_id FROM tok) JOIN cats c USING (cat_id) GROUP BY 1")
def category_vectors(spark: SparkSession, d: str) -> DataFrame:
    return C.vectors(lexicon(spark, d))


@query(
    f"""WITH {TOK}, {CATS}, pairs AS (SELECT DISTINCT token_id AS a, unnest(synonyms) AS b FROM tok), vec AS (SELECT DISTINCT token_id, c.cat_id, c.fqn FROM (SELECT token_id, unnest(categories) AS cat_id FROM tok) JOIN cats c USING (cat_id)),
    each AS (SELECT a, b, len(list_filter(generate_series(1, least(len(x.fqn), len(y.fqn))), lambda i: x.fqn[1 : i] = y.fqn[1 : i])) AS depth FROM pairs JOIN vec x ON x.token_id = a JOIN vec y ON y.token_id = b)
    SELECT a, b, coalesce(avg(depth), 0.0) AS distance FROM pairs LEFT JOIN each USING (a, b) WHERE b IS NOT NULL AND b <> 0 GROUP BY 1, 2"""
)
def semantic_distance(spark: SparkSession, d: str) -> DataFrame:
    """Mean common depth of the categories of every token and each of its synonyms."""
    lx = lexicon(spark, d)
    pairs = lx.tokens.select(F.col("token_id").alias("a"), F.explode("synonyms").alias("b")).where("b is not null and b <> 0").distinct()
    return C.distances(lx, pairs)


@query(f"WITH {CATS} SELECT c.cat_id, c.path, CAST(count(x.cat_id) AS BIGINT) AS children FROM cats c LEFT JOIN cats x ON x.parent_id = c.cat_id GROUP BY 1, 2")
def category_children(spark: SparkSession, d: str) -> DataFrame:
    return C.children(lexicon(spark, d))


def first_paths(lx) -> dict[str, list[str]]:
    """Stand-ins for the named paths, which these tables lack: the first two paths of each tree are persons, the next two things."""
    rows = lx.categories.where("depth = 1 and tree in ('nouns', 'ner')").select("tree", "path", "cat_id").orderBy("cat_id").collect()  # a fixed dimension
    by = {t: [r["path"] for r in rows if r["tree"] == t] for t in ("nouns", "ner")}
    return {"person": by["nouns"][:2], "entity": by["nouns"][2:4], "ner_person": by["ner"][:2], "ner_entity": by["ner"][2:4]}


KINDS_SQL = """paths AS (SELECT tree, cat_id, range_lo, range_hi, row_number() OVER (PARTITION BY tree ORDER BY cat_id) AS i FROM cats WHERE depth = 1 AND tree IN ('nouns', 'ner')),
flags AS (SELECT token_id, pos, EXISTS (SELECT 1 FROM paths WHERE tree = 'nouns' AND i <= 2 AND len(list_filter(categories, lambda c: c >= range_lo AND c < range_hi)) > 0) AS np, EXISTS (SELECT 1 FROM paths WHERE tree = 'nouns' AND i IN (3, 4) AND len(list_filter(categories, lambda c: c >= range_lo AND c < range_hi)) > 0) AS ne,
  EXISTS (SELECT 1 FROM paths WHERE tree = 'ner' AND i <= 2 AND len(list_filter(ner, lambda c: c >= range_lo AND c < range_hi)) > 0) AS rp, EXISTS (SELECT 1 FROM paths WHERE tree = 'ner' AND i IN (3, 4) AND len(list_filter(ner, lambda c: c >= range_lo AND c < range_hi)) > 0) AS re FROM tok),
kinds AS (SELECT token_id, CASE WHEN starts_with(pos, 'NNP') THEN rp WHEN pos = 'NNS' THEN false ELSE np END AS is_person, CASE WHEN starts_with(pos, 'NNP') THEN re WHEN pos = 'NNS' THEN np OR ne ELSE ne END AS is_entity FROM flags)"""


@query(f"WITH {CATS}, {TOK}, {KINDS_SQL} SELECT * FROM kinds")
def coreference_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Dictionary tokens that are persons or things."""
    lx = lexicon(spark, d)
    return C.coreference_kinds(lx, **first_paths(lx))


@query(f"WITH {STREAM}, {TOK}, each AS (SELECT input_id, unnest(map_entries(t.classification_scores)) AS e FROM stream s JOIN tok t USING (token_id)) SELECT input_id, CAST(e.key AS INT) AS code, avg(CAST(e.value AS DOUBLE)) AS score, count(*) AS tokens FROM each GROUP BY 1, 2")
def classification_scores(spark: SparkSession, d: str) -> DataFrame:
    """Mean score per input and code."""
    return SC.classification(stream(spark, d, "token_id"), lexicon(spark, d).tokens)


@query(f"WITH {TOK}, each AS (SELECT token_id, unnest(map_entries(classification_scores)) AS e FROM tok), q AS (SELECT token_id, CAST(e.key AS INT) AS code, CAST(floor(least(greatest(CAST(e.value AS DOUBLE), 0.0), 1.0) * 255 + 0.5) AS INT) AS q FROM each) SELECT token_id, code, CAST(q AS SMALLINT) AS q, q / 255.0 AS value, CAST(least(255, q + q) AS SMALLINT) AS doubled, CAST(floor(least(greatest((q / 255.0) * (q / 255.0), 0.0), 1.0) * 255 + 0.5) AS SMALLINT) AS squared FROM q")
def quantised_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores in 8 bits, back, added to themselves and multiplied."""
    t = lexicon(spark, d).tokens.select("token_id", F.explode("classification_scores").alias("c", "v")).select("token_id", F.col("c").cast("int").alias("code"), fixed8.quantise(F.col("v")).alias("q"))
    return t.select("token_id", "code", "q", fixed8.dequantise(F.col("q")).alias("value"), fixed8.add(F.col("q"), F.col("q")).alias("doubled"), fixed8.multiply(F.col("q"), F.col("q")).alias("squared"))


@query(
    f"""WITH {TOK}, {LEX}, {SENSE} SELECT 'ambiguous_words' AS name, count(*) AS value FROM sense WHERE len(potential_pos) > 1
    UNION ALL SELECT 'mwes', count(*) FILTER (contains(word, ' ')) FROM tok UNION ALL SELECT 'singular_words', count(*) FILTER (NOT contains(word, ' ')) FROM tok
    UNION ALL SELECT 'synonyms', CAST(coalesce(sum(len(synonyms)), 0) AS BIGINT) FROM tok UNION ALL SELECT 'hypernyms', CAST(coalesce(sum(len(hypernyms)), 0) AS BIGINT) FROM tok UNION ALL SELECT 'hyponyms', CAST(coalesce(sum(len(hyponyms)), 0) AS BIGINT) FROM tok
    UNION ALL SELECT 'nouns', count(*) FILTER (starts_with(pos, 'N') OR pos = 'SYS') FROM tok UNION ALL SELECT 'verbs', count(*) FILTER (starts_with(pos, 'V')) FROM tok UNION ALL SELECT 'adverbs', count(*) FILTER (starts_with(pos, 'R')) FROM tok
    UNION ALL SELECT 'adjectives', count(*) FILTER (starts_with(pos, 'J')) FROM tok UNION ALL SELECT 'named_entities', count(*) FILTER (starts_with(pos, 'NNP')) FROM tok UNION ALL SELECT 'tag:' || pos, count(*) FROM lex GROUP BY pos"""
)
def vocab_stats(spark: SparkSession, d: str) -> DataFrame:
    return SC.vocabulary_statistics(lexicon(spark, d))


def queries() -> dict:
    return Q


def oracle_sql() -> dict[str, str]:
    return S
