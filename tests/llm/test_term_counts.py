import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from textloom.llm.term_counts import mark_terms, term_counts


def test_counts_equal_brute_force(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(60), rng.randrange(40), rng.choice(["the"] * 30 + ["a", "b", "ß", None]), rng.choice(["NN", None]), "extra") for _ in range(4000)]
    rows += rows[:500]
    df = spark.createDataFrame(rows, "input_id long, seq int, word string, pos string, term string").repartition(5)
    got = {(r["field"], r["term"]): (r["occurrences"], r["records"]) for r in term_counts(df, {"word": F.col("word"), "pos": F.col("pos")}, "input_id", "seq").collect()}
    occ: dict = defaultdict(set)
    for i, s, w, p, _ in rows:
        for field, t in (("word", w), ("pos", p)):
            if t is not None:
                occ[field, t].add((i, s))
    assert got == {k: (len(v), len({i for i, _ in v})) for k, v in occ.items()}


def test_marks_and_empty(spark):
    counts = spark.createDataFrame([("w", "rare", 9, 2), ("w", "edge", 3, 3), ("w", "share", 20, 20), ("w", "common", 21, 21)], "field string, term string, occurrences long, records long")
    total = spark.createDataFrame([(100,)], "n long")
    assert Counter(r["mark"] for r in mark_terms(counts, total).collect()) == Counter({"rare": 1, None: 2, "common": 1})
    empty = spark.createDataFrame([], "input_id long, seq int, word string")
    assert term_counts(empty, {"word": F.col("word")}, "input_id", "seq").count() == 0


def test_null_record_or_place_counts_nowhere(spark):
    df = spark.createDataFrame([(None, 1, "a"), (1, None, "a"), (1, 1, "a")], "input_id long, seq int, word string")
    assert [tuple(r) for r in term_counts(df, {"word": F.col("word")}, "input_id", "seq").collect()] == [("word", "a", 1, 1)]
