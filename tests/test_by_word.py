"""Features counted at their word: agrees with SQL where tags are doubtful, whatever is held at a time, and makes no row for a feature."""

import random

import duckdb
import pytest

from tests.compare import _plain
from textloom.functions.predicates import TAGS
from textloom.operators import by_word, hmm
from textloom.plans.tag_queries import S, feature_resolution

BASE = "/root/testdata/sf0.001"
WORDS = ["can", "run", "light", "the", "quickly", "nation", "unhappy", "i", "they", "Été", ".", "now", "relating"]


def stream(inputs=150):
    """Words with several tags each; some numbers are left out, some inputs have one word."""
    r = random.Random(7)
    rows = []
    for i in range(inputs):
        seq = 0
        for _ in range(1 if i % 10 == 0 else r.randint(2, 40)):
            w = r.choice(WORDS)
            rows.append((i, seq, w, "SS" if w == "." else r.choice(["NN", "VB", "JJ", "odd", None, "NNP"])))
            seq += r.choice([1, 1, 1, 1, 1, 2, 4])
    return rows


@pytest.fixture(scope="module")
def tables(spark):
    senses = [(w, k, p, 10 * i + k) for i, w in enumerate(w.lower() for w in WORDS) for k, p in enumerate(("NN", "VB") if w not in (".", "the") else ("FW",))]
    people = [(10 * i, {"i": ("personal", "first", "singular"), "they": ("personal", "third", None)}[w]) for i, w in enumerate(WORDS) if w in ("i", "they")]
    return stream(), senses, people


def by_sql(tables):
    rows, senses, people = tables
    con = duckdb.connect()
    con.execute("create table token_stream (input_id bigint, seq int, word varchar, pos varchar, ingested_at int)")
    con.executemany("insert into token_stream values (?, ?, ?, ?, 0)", rows)
    con.execute("create table pos_tags (tag varchar)")
    con.executemany("insert into pos_tags values (?)", [(t,) for t in TAGS])
    con.execute("create table lexicon_pos (word varchar, ord int, pos varchar, token_id int)")
    con.executemany("insert into lexicon_pos values (?, ?, ?, ?)", senses)
    con.execute("create table lexicon_tokens (token_id int, pronoun struct(category varchar, person varchar, number varchar), loaded_at int, deleted_at int)")
    con.executemany("insert into lexicon_tokens values (?, row(?, ?, ?), 0, null)", [(i, *p) for i, p in people])
    found = con.execute(S["feature_resolution"]).fetchall()
    names = [c[0] for c in con.description]
    return sorted(repr(_plain(tuple(r[names.index(c)] for c in ("input_id", "seq", "w", "tag", "score")))) for r in found)


@pytest.mark.parametrize("block, held", [(100_000, 400_000), (40, 90)])
def test_doubtful_tags_agree_with_sql(spark, tables, monkeypatch, block, held):
    rows, senses, people = tables
    sents = hmm.sentences(spark.createDataFrame(rows, "input_id bigint, seq int, word string, pos string"))
    words = spark.createDataFrame([(w,) for w in {s[0] for s in senses if s[1] == 1}], "word string")
    known = spark.createDataFrame([(WORDS[i // 10], *p) for i, p in people], "word string, category string, person string, number string")
    monkeypatch.setattr(by_word, "BLOCK", block)
    monkeypatch.setattr(by_word, "HELD", held)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        made = by_word.resolve(sents, words, known)
        got = sorted(repr(_plain(tuple(r))) for r in made.collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == by_sql(tables) and len(got) > 1500


def test_a_feature_is_no_row(spark):
    plan = feature_resolution(spark, BASE)._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode" not in plan and plan.count("Scan parquet") == 1
