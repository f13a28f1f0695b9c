import pytest
from pyspark.sql import functions as F

from textloom.functions import affixes, fixed8
from textloom.lexicon import preprocess_rows
from textloom.operators import cleaning, spelling
from textloom.sources import cache


@pytest.mark.parametrize(
    "word, kind, core",
    [
        ("9:30", "time", "9:30"), ("09:30", "time", "09:30"), ("23:59", "time", "23:59"), ("29:59", "number", "29:59"), ("25:60", "number", "25:60"), ("0:30", "number", "0:30"),
        ("90s", "decade", "90s"), ("1990s", "decade", "1990s"), ("$45", "number", "$45"), ("1,234.5", "number", "1,234.5"), ("1.2.3", "word", "1.2.3"), ("3rd", "number_unit", "3rd"),
        ("John's", "word", "John"), ("John's,", "word", "John"), ("|NL|", "newline", "|NL|"), ("...", "symbol", ""),
    ],
)
def test_shapes(spark, word, kind, core):
    r = spark.createDataFrame([(word,)], "w string").select(cleaning.shape(F.col("w")).alias("s")).first()["s"]
    assert (r["kind"], r["core"]) == (kind, core)
    assert r["is_possessive"] == ("'s" in word)


def test_symbols_keep_their_order(spark):
    words = spark.createDataFrame([(1, 0, "(hello),")], "input_id int, pos int, word string")
    parts = [(r["part"], r["token_type"]) for r in cleaning.peel(words, "input_id").orderBy("sub").collect()]
    assert parts == [("(", "prefix"), ("hello", "word"), (")", "suffix"), (",", "suffix")]


def test_cleaning(spark):
    rows = [(1, "--- title\nnext"), (2, "café"), (3, "a  b"), (4, None), (5, "")]
    got = cleaning.clean_words(spark.createDataFrame(rows, "k int, t string"), "k", "t").collect()
    by = {k: [r["word"] for r in sorted(got, key=lambda r: r["pos"]) if r["k"] == k] for k in range(1, 6)}
    assert by == {1: ["title", "|NL|", "next"], 2: ["caf"], 3: ["a", "b"], 4: [], 5: []}


def test_contractions(spark):
    pre = spark.createDataFrame(preprocess_rows(), "word string, tag string, value string")
    words = spark.createDataFrame([(1, 0, "don't"), (1, 1, "monday")], "input_id int, pos int, word string")
    got = cleaning.expand(cleaning.peel(words, "input_id"), pre, "input_id").orderBy("pos", "sub", "subsub").collect()
    assert [(r["part"], r["tag"]) for r in got] == [("do", "|contraction|"), ("not", "|contraction|"), ("monday", "|day_of_week|")]


def test_affix_classes(spark):
    words = ["station", "kindness", "boxes", "run", "combine", "universe", "interact"]
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", affixes.suffix_class(F.col("w")).alias("s"), affixes.prefix_class(F.col("w")).alias("p"))
    got = {r["w"]: (r["s"], r["p"]) for r in df.collect()}
    assert [got[w][0] for w in words[:4]] == ["tion", "ness", "s", None]
    assert [got[w][1] for w in words[4:]] == ["com", "uni", "inter"]


def test_fixed8(spark):
    r = spark.createDataFrame([(1.5, 0.5)], "a double, b double").select(fixed8.quantise(F.col("a")).alias("a"), fixed8.quantise(F.col("b")).alias("b"))
    r = r.select("a", "b", fixed8.add(F.col("a"), F.col("b")).alias("sum"), fixed8.multiply(F.col("a"), F.col("b")).alias("product")).first()
    assert tuple(r) == (255, 128, 255, 128)


def test_spell_scores_and_sizes(spark):
    words = spark.createDataFrame([("abc",), ("abcde",), ("abcdefg",), ("a" * 11,), ("a" * 12,)], "w string")
    got = [tuple(r["s"]) for r in words.select(spelling.probe_sizes(F.col("w")).alias("s")).collect()]
    assert got == [("short",), ("short", "short_medium"), ("short_medium", "medium"), ("medium", "medium_long", "long"), ("medium_long", "long")]
    assert spark.range(1).select(F.levenshtein(F.lit("recieve"), F.lit("receive"))).first()[0] == 2


def test_spell_picks_the_nearest(spark):
    blocks = spark.createDataFrame([("noun", "medium", 0, 9, 1, "receive", None, None), ("noun", "medium", 1, 9, 2, "relieve", None, None)], "pos_class string, size_class string, rank int, cohort int, token_id int, word string, tag_before array<string>, word_before array<string>")
    predicted = spark.createDataFrame([("recieve", "^", "^", "NN", 0.9)], "w string, before string, word_before string, c string, p double")
    best = spelling.spell_best(spelling.spell_scores(spelling.spell_candidates(predicted, blocks))).collect()
    assert [(r["word"], r["distance"]) for r in best] == [("relieve", 1)]


def test_typo_cache(spark, tmp_path):
    c = cache.load_cache(spark, str(tmp_path))
    assert c.count() == 0
    c = cache.add_typo(cache.add_typo(c, "Teh", "tea"), "teh", "the")
    cache.save_cache(c, str(tmp_path))
    got = cache.apply_cache(spark.createDataFrame([("TEH",), ("x",)], "w string"), "w", cache.load_cache(spark, str(tmp_path))).collect()
    assert {(r["w"], r["corrected"]) for r in got} == {("TEH", "the"), ("x", None)}
