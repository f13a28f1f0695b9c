"""The queries of the problems in this subpackage: name to function of session and table folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.canonical import PLAIN, canonical_form, changed_words, vocabulary
from textloom.llm.leakage import find_leaks
from textloom.llm import moderation
from textloom.llm.packing import pack, token_counts
from textloom.llm.personal import find_personal, mask, token_hits
from textloom.llm.sentences import find_sentences
from textloom.llm.term_counts import mark_terms, term_counts
from textloom.session import dimension_join
from textloom.sources import read_table


def _vocabulary(spark: SparkSession, d: str) -> DataFrame:
    words = read_table(spark, d, "lexicon_tokens").select("word").union(read_table(spark, d, "token_stream").select("word"))
    return vocabulary(words, "word")


def p1_counts(spark: SparkSession, d: str) -> DataFrame:
    """Occurrences and inputs of every term of word, stem and pos, with its mark."""
    tokens = read_table(spark, d, "token_stream").select("input_id", "seq", "word", "stem", "pos")
    changed = changed_words(tokens, "word", _vocabulary(spark, d)).withColumnRenamed("word", "_word")
    formed = dimension_join(tokens, changed, F.col("word") == F.col("_word"))
    counts = term_counts(formed, {"word": F.lower(F.coalesce("form", "word")), "stem": F.col("stem").cast("string"), "pos": F.upper("pos")}, "input_id", "seq")
    return mark_terms(counts, tokens.agg(F.countDistinct("input_id").alias("n")))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_counts(spark, d).where("mark is not null").select("field", "term", "mark")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return find_sentences(read_table(spark, d, "tokenized_input"), "input_id", "original")


def _personal(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    texts = read_table(spark, d, "tokenized_input").select("input_id", F.col("original").alias("text"))
    return texts, find_personal(texts)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    values = _personal(spark, d)[1]
    words = token_hits(values, read_table(spark, d, "token_stream"))
    return (
        values.select(F.lit("original").alias("src"), "input_id", F.col("start").alias("place"), "pii_type")
        .unionByName(words.select(F.lit("word").alias("src"), "input_id", F.col("seq").cast("int").alias("place"), "pii_type"))
        .distinct()
    )


def p4_masked(spark: SparkSession, d: str) -> DataFrame:
    """Every text with typed placeholders."""
    return mask(*_personal(spark, d))


def _originals(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "tokenized_input").select("input_id", "original")


def p5_forms(spark: SparkSession, d: str) -> DataFrame:
    """The consistent form of every original and word: ``src, input_id, seq, text, form, is_changed``."""
    vocab = _vocabulary(spark, d)
    texts = canonical_form(_originals(spark, d).dropDuplicates(["input_id"]), "original", vocab, out="form")
    tokens = read_table(spark, d, "token_stream").select("input_id", F.col("seq").cast("int").alias("seq"), "word").dropDuplicates(["input_id", "seq"])
    words = dimension_join(tokens, changed_words(tokens, "word", vocab).withColumnRenamed("word", "_word"), F.col("word") == F.col("_word"))
    return texts.select(F.lit("original").alias("src"), "input_id", F.lit(-1).alias("seq"), F.col("original").alias("text"), "form", "is_changed").unionByName(
        words.select(F.lit("word").alias("src"), "input_id", "seq", F.col("word").alias("text"), F.coalesce("form", "word").alias("form"), F.col("_word").isNotNull().alias("is_changed"))
    )


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    tokens = read_table(spark, d, "token_stream").select("input_id", F.col("seq").cast("int").alias("seq"), "word")
    words = tokens.select(F.lit(None).cast("long").alias("input_id"), F.col("word").alias("text")).where(~F.col("text").rlike(PLAIN)).distinct()
    texts = _originals(spark, d).withColumnRenamed("original", "text").where(~F.col("text").rlike(PLAIN)).select("input_id", "text", F.lit("original").alias("src"))
    formed = canonical_form(texts.unionByName(words.withColumn("src", F.lit("word"))), "text", _vocabulary(spark, d), out="form").where("is_changed")
    changed = formed.select("src", "input_id", F.when(F.col("src") == "word", F.col("text")).alias("_word")).checkpoint()
    hits = dimension_join(tokens, changed.where("src = 'word'").select("_word"), F.col("word") == F.col("_word"), "left_semi")
    return changed.where("src = 'original'").select("src", "input_id", F.lit(-1).alias("seq")).unionByName(hits.select(F.lit("word").alias("src"), "input_id", "seq")).distinct()


def p6_pack(spark: SparkSession, d: str) -> DataFrame:
    """The container of every document, or part of one above the capacity, for each kind of container."""
    docs = read_table(spark, d, "documents")
    return pack(token_counts(docs, "doc_id", "text"), read_table(spark, d, "containers"), n_items=docs.count())


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers, tokens and the share of room used per kind."""
    packed = p6_pack(spark, d).groupBy("container_kind").agg(F.countDistinct("container_id").alias("used"), F.sum("tokens").alias("tokens"))
    return packed.join(read_table(spark, d, "containers"), "container_kind").withColumn("fill", F.col("tokens") / (F.col("used") * F.col("capacity_tokens")))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return find_leaks(read_table(spark, d, "documents"), "doc_id", "text", read_table(spark, d, "eval_items"), "item_id", "text")


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    """Affected documents per test item."""
    return p7_found(spark, d).groupBy("item_id").agg(F.count("*").alias("documents"))


def p7_near(spark: SparkSession, d: str) -> DataFrame:
    """Documents and items that share twelve words but for one edit, so that small changes hide nothing."""
    return find_leaks(read_table(spark, d, "documents"), "doc_id", "text", read_table(spark, d, "eval_items"), "item_id", "text", edits=1)


def p8_scores(spark: SparkSession, d: str) -> DataFrame:
    """Calibrated scores of every document: ``doc_id, abusive, hateful, sexual``."""
    docs = read_table(spark, d, "documents")
    return moderation.score(docs, moderation.fit(docs, read_table(spark, d, "review_labels")))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("score")) for k in moderation.KINDS)))
    return p8_scores(spark, d).select("doc_id", kinds.alias("k")).where("k.score >= 0.5").select("doc_id", "k.kind").distinct()


def p8_rates(spark: SparkSession, d: str) -> DataFrame:
    """Documents and the share of each kind per source."""
    docs = read_table(spark, d, "documents")
    scores = moderation.score(docs, moderation.fit(docs, read_table(spark, d, "review_labels")), keep=("source",))
    return scores.groupBy("source").agg(F.count("*").alias("documents"), *(F.avg((F.col(k) >= 0.5).cast("double")).alias(f"{k}_rate") for k in moderation.KINDS))


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_counts, p3_found, p4_found, p4_masked, p5_found, p5_forms, p6_pack, p6_fill, p7_found, p7_items, p7_near, p8_found, p8_scores, p8_rates)}
