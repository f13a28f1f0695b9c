"""Queries whose dictionary is too large to broadcast: Spark mustn't broadcast it on its own, and rows stay the same."""

import pytest
from pyspark.sql import functions as F

from textloom import session
from textloom.engine import Engine
from textloom.lexicon import Lexicon
from textloom.operators import phrases, scores, spans, spelling
from textloom.plans import registry

BASE = "/root/testdata/sf0.001"
QUERIES = ["lexicon_lookup", "token_by_id", "resense"]


@pytest.mark.parametrize("name", QUERIES)
def test_a_large_dictionary_is_shuffled(spark, monkeypatch, name):
    query = registry.queries()[name]
    small = sorted(map(repr, query(spark, BASE).collect()))
    monkeypatch.setattr(session, "is_small", lambda *_: False)
    large = query(spark, BASE)
    assert "Broadcast" not in large._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(repr, large.collect())) == small and small


def test_senses_alone_are_narrow(spark, monkeypatch):
    # a dictionary of half a million senses: without its own limits every token would be shuffled once more
    monkeypatch.setattr(session, "is_small", lambda _, rows, size=session.MAX_BYTES: rows >= 500_000 and size <= 64 << 20)
    assert "BroadcastHashJoin" in plan(registry.queries()["resense"](spark, BASE))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def tokens(spark):
    return spark.read.parquet(f"{BASE}/token_stream.parquet").select("input_id", "seq", "word", "pos", "token_id")


def test_the_engine_shuffles_a_large_dictionary(spark, monkeypatch):
    monkeypatch.setattr(session, "is_small", lambda *_: False)
    none = F.lit(None).cast("string")
    t = tokens(spark).withColumns({c: none for c in ("inner_tag", "inner_value", "inner_unit")})
    assert "Broadcast" not in plan(Engine(spark, BASE)._looked_up(t))


def test_spans_are_not_broadcast(spark):
    t = tokens(spark)
    found = t.select("input_id", "seq", F.lit(1).alias("n"), F.col("word").alias("phrase"), "pos", F.lit("mwe").alias("kind"))
    assert "Broadcast" not in plan(spans.merged_view(t, found))


def test_scores_of_a_large_dictionary_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(session, "is_small", lambda *_: False)
    assert "Broadcast" not in plan(scores.classification(tokens(spark), Lexicon.load(spark, BASE).tokens))


def test_kinds_of_a_large_dictionary_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(session, "is_small", lambda *_: False)
    lexicon, none = Lexicon.load(spark, BASE), tokens(spark).where("false")
    kinds = lexicon.tokens.selectExpr("token_id", "true as is_person", "false as is_entity")
    assert plan(phrases.describe(none, lexicon, kinds)).count("BroadcastExchange") <= 1  # the laid ranges of the categories


def test_words_at_a_distance_are_not_broadcast(spark):
    words = tokens(spark).select(F.col("word").alias("w"))
    assert "Broadcast" not in plan(spelling.at_distance(words, words.withColumnRenamed("w", "word"), 1))
