"""Multi-word spans over token rows ``input_id, seq, word, pos``: phrases of the dictionary, verb groups, periods.

Phrases may have any number of words: they are joined to the tokens by their first two words, and the rest is compared
with the tokens that follow. The leftmost-longest spans are taken by a fold over an input's candidates. An input's
tokens and candidates are bounded by its text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import predicates as P
from textloom.session import dimension_join, shuffled

#: Verb groups that speak of the future: a slot is written as its tag.
FUTURE_PATTERNS = ["will VB", "will not VB", "will be VBG", "will have VBN", "will have been VBG", "will not have VBN", "shall VB", "shall not VB", "going to VB", "is going to VB", "are going to VB", "am going to VB"]
# Words around a period or a date that set it in the past or the future.
PREFIX_PAST_PERIOD = ("last", "past", "prior")
PREFIX_FUTURE_PERIOD = ("in", "next", "within", "following")
SUFFIX_PAST_PERIOD = ("ago", "prior", "earlier", "before", "since")
SUFFIX_FUTURE_PERIOD = ("later", "ahead", "afterwards")
PREFIX_PAST_DATE = ("last", "past", "prior")
PREFIX_FUTURE_DATE = ("next", "following")


def ordered() -> Window:
    return Window.partitionBy("input_id").orderBy("seq")


def capital_style(word: Column) -> Column:
    """lower, upper, title or other."""
    return F.when(F.lower(word) == word, "lower").when(F.upper(word) == word, "upper").when(F.initcap(word) == word, "title").otherwise("other")


def apply_style(word: Column, style: Column, original: Column) -> Column:
    return F.when(style == "lower", F.lower(word)).when(style == "upper", F.upper(word)).when(style == "title", F.initcap(word)).otherwise(original)


def derive_phrases(tokens: DataFrame, min_count: int = 12, longest: int = 3) -> DataFrame:
    """A phrase table from the tokens: neighbours of two to ``longest`` words that occur at least ``min_count`` times.

    ``phrase, n, mwe_type``; phrases of two words serve both streams, longer ones the standard stream.
    """
    ahead = ordered().rowsBetween(0, longest - 1)
    near = tokens.where("token_type = 'word'").select("seq", F.collect_list(F.coalesce(F.lower("word"), F.lit(""))).over(ahead).alias("ws"), F.collect_list("seq").over(ahead).alias("at"))
    whole = F.filter(F.sequence(F.lit(2), F.greatest(F.size("ws"), F.lit(2))), lambda n: F.coalesce(F.try_element_at("at", n) == F.col("seq") + n - 1, F.lit(False)))
    grams = near.select(F.explode(whole).alias("n"), "ws").select(F.array_join(F.slice("ws", 1, F.col("n")), " ").alias("phrase"), "n")
    counts = grams.groupBy("phrase", "n").agg(F.count("*").alias("c")).where(F.col("c") >= min_count)
    return counts.select("phrase", "n", F.when(F.col("n") == 2, "both").otherwise("standard").alias("mwe_type"))


def candidates(tokens: DataFrame, phrases: DataFrame) -> DataFrame:
    """``input_id, seq, n, phrase, mwe_type``: every place where a phrase of two words or more stands.

    The words must be neighbours. A phrase's further columns are kept. Words of phrases are in lower case, one space apart.
    """
    longest = phrases.agg(F.max("n")).first()[0] or 0  # one number of the phrase table
    w = ordered()
    ahead = w.rowsBetween(0, max(1, longest - 1))
    near = tokens.select("input_id", "seq", F.lower("word").alias("_a"), F.lead(F.lower("word")).over(w).alias("_b"), F.collect_list(F.coalesce(F.lower("word"), F.lit(""))).over(ahead).alias("_ws"), F.collect_list("seq").over(ahead).alias("_at"))
    parts = F.split("phrase", " ")
    known = phrases.where("n >= 2").withColumn("_x", parts[0]).withColumn("_y", parts[1]).withColumn("_parts", parts)
    hits = dimension_join(near, known, (F.col("_a") == F.col("_x")) & (F.col("_b") == F.col("_y")), "inner")
    whole = (F.slice("_ws", 1, F.col("n")) == F.col("_parts")) & (F.try_element_at("_at", F.col("n").cast("int")) == F.col("seq") + F.col("n") - 1)
    rest = [c for c in phrases.columns if c not in ("n", "phrase", "mwe_type", "input_id", "seq")]
    return hits.where(whole).select("input_id", "seq", "n", "phrase", "mwe_type", *rest)


def leftmost_longest(found: DataFrame) -> DataFrame:
    """Of the candidates ``input_id, seq, n, phrase`` those that a scan from the left takes, the longest at each place."""
    best = found.groupBy("input_id", "seq").agg(F.max_by("phrase", "n").alias("phrase"), F.max("n").alias("n"))
    lists = best.groupBy("input_id").agg(F.array_sort(F.collect_list(F.struct("seq", "n", "phrase"))).alias("c"))
    empty = F.struct(F.lit(-1).alias("free"), F.expr("filter(transform(c, x -> named_struct('seq', x.seq, 'n', x.n, 'phrase', x.phrase)), x -> false)").alias("out"))
    taken = F.aggregate("c", empty, lambda s, x: F.when(x["seq"] >= s["free"], F.struct((x["seq"] + x["n"]).alias("free"), F.concat(s["out"], F.array(F.struct(x["seq"].alias("seq"), x["n"].alias("n"), x["phrase"].alias("phrase")))).alias("out"))).otherwise(s), lambda s: s["out"])
    return lists.select("input_id", F.explode(taken).alias("t")).select("input_id", "t.seq", "t.n", "t.phrase")


def span_view(tokens: DataFrame, spans: DataFrame) -> DataFrame:
    """``input_id, seq, n, word, pos``: a span in place of the tokens it covers, every other token as it is."""
    covered = spans.select("input_id", F.explode(F.sequence(F.col("seq"), F.col("seq") + F.col("n") - 1)).alias("seq"))
    rest = tokens.join(covered, ["input_id", "seq"], "left_anti").select("input_id", "seq", F.lit(1).alias("n"), "word", F.coalesce(F.upper("pos"), F.lit("FW")).alias("pos"))
    return rest.unionByName(spans.select("input_id", "seq", "n", F.col("phrase").alias("word"), F.lit("MWE").alias("pos")))


#: Kinds of spans in the order in which they are preferred where they begin together and are equally long.
KINDS = ("mwe", "period", "future", "number", "verb")


def all_spans(tokens: DataFrame, phrases: DataFrame, preprocess: DataFrame, scoring: bool = False) -> DataFrame:
    """``input_id, seq, n, phrase, pos, kind``: the spans of a view, none of which overlap, from the left, the longest first.

    The standard view takes phrases, groups that speak of the future, periods and numbers with units, and then those
    groups of not, have and had that are free of them; the scoring view takes its phrases only.
    """
    rank = {k: F.lit(i).alias("rank") for i, k in enumerate(KINDS)}

    def of(spans: DataFrame, kind: str, n: Column, phrase: Column, pos: Column) -> DataFrame:
        # in the order in which they are tried: by place, the longest first, then by kind
        return spans.select("input_id", F.struct(F.col("seq"), (-n).cast("int").alias("less"), rank[kind], phrase.alias("phrase"), pos.alias("pos"), F.lit(kind).alias("kind")).alias("s"))

    found = of(candidates(tokens, phrases).where("mwe_type <> 'standard'" if scoring else "mwe_type <> 'scoring'"), "mwe", F.col("n"), F.col("phrase"), F.lit("MWE"))
    if not scoring:
        wide = F.col("last_seq") - F.col("seq") + 1
        found = found.unionByName(of(future_verbs(tokens), "future", F.col("n"), F.col("words"), F.col("pos")))
        found = found.unionByName(of(period_spans(tokens, preprocess), "period", wide, F.col("tag"), F.lit("SYS")))
        found = found.unionByName(of(number_units(tokens, preprocess), "number", F.lit(2), F.col("tag"), F.lit("SYS")))
        found = found.unionByName(of(verb_spans(tokens), "verb", wide, F.lit(None).cast("string"), F.col("pos")))
    g = found.groupBy("input_id").agg(F.array_sort(F.collect_list("s")).alias("all"))
    g = g.select("input_id", F.filter("all", lambda x: x["kind"] != "verb").alias("c"), F.filter("all", lambda x: x["kind"] == "verb").alias("v"))
    start = F.struct(F.lit(-1).alias("free"), F.filter("c", lambda x: F.lit(False)).alias("out"))
    taken = F.aggregate("c", start, lambda s, x: F.when(x["seq"] >= s["free"], F.struct((x["seq"] - x["less"]).alias("free"), F.concat(s["out"], F.array(x)).alias("out"))).otherwise(s), lambda s: s["out"])
    g = g.select("input_id", taken.alias("t"), "v")
    free = F.filter("v", lambda v: ~F.exists("t", lambda c: (c["seq"] < v["seq"] - v["less"]) & (c["seq"] - c["less"] > v["seq"])))
    return g.select("input_id", F.explode(F.concat("t", free)).alias("x")).select("input_id", "x.seq", (-F.col("x.less")).alias("n"), "x.phrase", "x.pos", "x.kind")


def merged_view(tokens: DataFrame, spans: DataFrame) -> DataFrame:
    """``input_id, seq, n, word, pos, token_id, kind``: spans in place of the tokens they cover; a span without words of
    its own has those of its tokens. seq is the place of the first token."""
    w = ordered()
    ends = spans.select("input_id", "seq", F.col("n").alias("_n"), F.col("phrase").alias("_phrase"), F.col("pos").alias("_pos"), "kind")
    own = tokens.select("input_id", "seq", "word", P.known_tag(F.col("pos")).alias("pos"), "token_id").join(shuffled(ends), ["input_id", "seq"], "left")
    # the last place covered by a span that began before
    until = F.max(F.when(F.col("_n").isNotNull(), F.col("seq") + F.col("_n") - 1)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    began = F.last(F.when(F.col("_n").isNotNull(), F.col("seq")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    grouped = own.withColumn("_at", F.when(F.col("seq") <= F.coalesce(until, F.lit(-1)), began).otherwise(F.col("seq")))
    words = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.coalesce("word", F.lit("")).alias("word")))), lambda x: x["word"]), " ")
    v = grouped.groupBy("input_id", F.col("_at").alias("seq")).agg(F.max("_n").alias("_n"), F.max("_phrase").alias("_phrase"), F.max("_pos").alias("_pos"), F.max("kind").alias("kind"), words.alias("_words"), F.min_by("word", "seq").alias("word"), F.min_by("pos", "seq").alias("pos"), F.min_by("token_id", "seq").alias("token_id"))
    span = F.col("_n").isNotNull()
    return v.select("input_id", "seq", F.coalesce("_n", F.lit(1)).cast("int").alias("n"), F.when(span, F.coalesce("_phrase", "_words")).otherwise(F.col("word")).alias("word"), F.when(span, F.col("_pos")).otherwise(F.col("pos")).alias("pos"), F.when(span, F.lit(0)).otherwise(F.col("token_id")).alias("token_id"), "kind")


def future_verbs(tokens: DataFrame) -> DataFrame:
    """``input_id, seq, n, words, pos, is_negative``: the longest pattern at each place; the verb slot must have the tag.

    The group's tag is VF for a base verb, VHF with "have", else VFG; with "not" it is negative.
    """
    w = ordered()
    longest = max(len(p.split()) for p in FUTURE_PATTERNS)
    near = tokens.select("input_id", "seq", *(F.lead(F.lower("word"), k).over(w).alias(f"w{k}") for k in range(longest)), *(F.upper(F.lead("pos", k).over(w)).alias(f"p{k}") for k in range(longest)))
    hits = []
    for p in FUTURE_PATTERNS:
        parts = p.split()
        ok = F.lit(True)
        for k, x in enumerate(parts):
            ok = ok & ((F.col(f"p{k}") == x) if x.startswith("V") else (F.col(f"w{k}") == x))
        pos = "VHF" if "have" in parts else "VF" if "VB" in parts else "VFG"
        hits.append(F.when(ok, F.struct(F.lit(len(parts)).alias("n"), F.concat_ws(" ", *(f"w{k}" for k in range(len(parts)))).alias("words"), F.lit(pos).alias("pos"), F.lit("not" in parts).alias("is_negative"))))
    best = F.array_max(F.array_compact(F.array(*hits)))
    return near.where(F.col("w0").isin(sorted({p.split()[0] for p in FUTURE_PATTERNS}))).withColumn("b", best).where("b is not null").select("input_id", "seq", "b.*")


def verb_spans(tokens: DataFrame) -> DataFrame:
    """Groups from the earliest open not, have or had to the next noun or verb: ``input_id, seq, last_seq, pos, is_negative, marker``.

    Base and third-person verbs after "not" or "have" become VH and VHZ, past forms after "had" become VHP.
    """
    w = ordered()
    low = F.lower("word")
    marker = low.isin("not", "have", "has", "had")
    closes = (P.is_noun(F.col("pos")) | P.is_verb(F.col("pos"))) & ~marker
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    t = tokens.withColumn("_group", F.coalesce(F.sum(F.when(closes | P.is_sentence_stopper(F.col("pos")), 1).otherwise(0)).over(before), F.lit(0))).withColumn("_marker", marker).withColumn("_closes", closes)
    g = t.groupBy("input_id", "_group").agg(
        F.min(F.when(F.col("_marker"), F.col("seq"))).alias("seq"),
        F.max(F.when(F.col("_closes"), F.col("seq"))).alias("last_seq"),
        F.max(F.when(F.col("_closes"), F.upper("pos"))).alias("_pos"),
        F.max(F.when(F.col("_marker") & (low == "not"), 1).otherwise(0)).alias("_not"),
        F.max(F.when(F.col("_marker") & (low == "had"), 1).otherwise(0)).alias("_had"),
        F.min_by(F.when(F.col("_marker"), low), F.when(F.col("_marker"), F.col("seq"))).alias("marker"),
    )
    pos = F.when((F.col("_had") == 1) & F.col("_pos").isin("VBD", "VBN"), "VHP").when(F.col("_pos") == "VB", "VH").when(F.col("_pos") == "VBZ", "VHZ").otherwise(F.col("_pos"))
    return g.where("seq is not null and last_seq is not null and seq < last_seq").select("input_id", "seq", "last_seq", pos.alias("pos"), (F.col("_not") == 1).alias("is_negative"), "marker")


def period_spans(tokens: DataFrame, preprocess: DataFrame) -> DataFrame:
    """Periods and dates set in the past or future: ``input_id, seq, last_seq, tag, value, unit``.

    "3 weeks ago" and "in 3 weeks" are periods of a number and a unit, "last monday" is a date.
    """
    w = ordered()
    special = preprocess.where("tag in ('|date_period|', '|time_period|', '|day_of_week|', '|month|')").select(F.col("word").alias("_w"), "tag", F.col("value").alias("_unit"))
    low = tokens.select("input_id", "seq", F.lower("word").alias("w"))
    t = low.join(F.broadcast(special), F.col("w") == F.col("_w"), "left").select("input_id", "seq", "w", "tag", "_unit")
    t = t.select("*", *(F.lag("w", k).over(w).alias(f"b{k}") for k in (1, 2)), F.lead("w", 1).over(w).alias("a1"))
    number = F.col("b1").rlike("^[0-9][0-9,.]*$")
    period = F.col("tag").isin("|date_period|", "|time_period|")
    date = F.col("tag").isin("|day_of_week|", "|month|")
    bare = F.regexp_replace("tag", r"\|", "")
    when = (
        F.when(period & F.col("a1").isin(*SUFFIX_PAST_PERIOD), "past")
        .when(period & F.col("a1").isin(*SUFFIX_FUTURE_PERIOD), "future")
        .when(period & number & F.col("b2").isin(*PREFIX_PAST_PERIOD), "past")
        .when(period & number & F.col("b2").isin(*PREFIX_FUTURE_PERIOD), "future")
        .when(date & F.col("b1").isin(*PREFIX_PAST_DATE), "past")
        .when(date & F.col("b1").isin(*PREFIX_FUTURE_DATE), "future")
    )
    suffixed = period & F.coalesce(F.col("a1").isin(*SUFFIX_PAST_PERIOD, *SUFFIX_FUTURE_PERIOD), F.lit(False))
    start = F.when(date, F.col("seq") - 1).when(suffixed & number, F.col("seq") - 1).when(suffixed, F.col("seq")).otherwise(F.col("seq") - 2)
    return t.withColumn("_when", when).where("_when is not null").select("input_id", start.alias("seq"), F.when(suffixed, F.col("seq") + 1).otherwise(F.col("seq")).alias("last_seq"), F.concat(F.lit("|"), F.col("_when"), F.lit("_"), bare, F.lit("|")).alias("tag"), F.when(number & period, F.col("b1")).alias("value"), F.col("_unit").alias("unit"))


def number_units(tokens: DataFrame, preprocess: DataFrame) -> DataFrame:
    """A number and the unit behind it merged: ``input_id, seq, value, unit, tag``."""
    w = ordered()
    special = preprocess.where("tag in ('|date_period|', '|time_period|')").select(F.col("word").alias("_w"), "tag", F.col("value").alias("unit"))
    t = tokens.select("input_id", "seq", F.lower("word").alias("w"), F.lead(F.lower("word")).over(w).alias("next"))
    return t.where(F.col("w").rlike("^[0-9][0-9,.]*$")).join(F.broadcast(special), F.col("next") == F.col("_w")).select("input_id", "seq", F.col("w").alias("value"), "unit", "tag")


#: Word paths that mark an intent; the shortest that stands at a place counts.
INTENTS = {
    "acknowledgment": ["thank you", "thanks", "i see", "understood"],
    "affirmation": ["yes", "of course", "certainly", "agreed"],
    "emphasis": ["really", "very", "indeed", "to be honest"],
    "hesitation": ["wait", "perhaps", "maybe", "or so it seems", "as far as i can see"],
    "negation": ["not", "nobody", "never", "no longer"],
    "rejection": ["refused", "no thanks", "stop"],
    "request": ["please", "can you", "could you", "is it possible"],
}


def intent_rows() -> list[tuple[str, int, str]]:
    return [(p, len(p.split()), k) for k, ps in INTENTS.items() for p in ps]


def intents(tokens: DataFrame, table: DataFrame) -> DataFrame:
    """``input_id, seq, intent, n``: the shortest path of the table (``phrase, n, intent``) at each place."""
    w = ordered()
    longest = table.agg(F.max("n")).first()[0] or 1  # one number of the table
    ahead = F.collect_list(F.lower("word")).over(w.rowsBetween(0, longest - 1))
    paths = table.withColumn("_parts", F.split("phrase", " ")).withColumn("_first", F.split("phrase", " ")[0])
    near = tokens.select("input_id", "seq", F.lower("word").alias("_w"), ahead.alias("_ws"))
    hits = dimension_join(near, paths, F.col("_w") == F.col("_first"), "inner").where(F.slice("_ws", 1, F.col("n")) == F.col("_parts"))
    return hits.groupBy("input_id", "seq").agg(F.min_by("intent", F.struct("n", "intent")).alias("intent"), F.min("n").alias("n"))


def intent_scores(found: DataFrame, tokens: DataFrame) -> DataFrame:
    """``input_id, intent, score``: matched length per token of the strongest intent; neutral with 0 where there is none."""
    sums = found.groupBy("input_id", "intent").agg(F.sum("n").alias("total"))
    top = sums.groupBy("input_id").agg(F.max_by("intent", F.struct("total", F.lit(0) - F.ascii("intent"), "intent")).alias("intent"), F.max("total").alias("total"))
    size = tokens.groupBy("input_id").agg(F.count("*").alias("tokens"))
    return size.join(top, "input_id", "left").select("input_id", F.coalesce("intent", F.lit("neutral")).alias("intent"), F.coalesce(F.col("total") / F.col("tokens"), F.lit(0.0)).alias("score"))
