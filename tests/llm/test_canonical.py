import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.llm import canonical as C

CASES = {
    "ｔｈｅ": "the", "brіdgе": "bridge", "ѕоνеklа": "sovekla", "t⁠he": "the", "Über\xa0die": "Über die", "ﬂooded": "flooded", "café": "café", "（０２０）": "(020)", "ｶﾞス": "ガス", "𝐮𝐦𝐛𝐞𝐫": "umber",
    "plain text.": "plain text.", "нос": "нос", "❤️": "❤️", "👩‍💻": "👩‍💻", "もう！（あ）": "もう！（あ）", "»Wаit« – ‘yes’…": "»Wait« – ‘yes’...", "a‍b": "ab", "чтo": "что", "ทำ": "ทำ", "": "",
}


@pytest.mark.parametrize("text, form", CASES.items())
def test_forms(text, form):
    assert C.canonical(text) == form


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abc dе​ｆ́é\xa0ﬁ。あ！нο-\n1½👍‍️"))
def test_forms_are_stable_and_places_fit(text):
    form = C.canonical(text)
    assert C.canonical(form) == form
    again, start, end = C.canonical_with_places(text)
    assert again in (form, text)
    assert len(start) == len(end) == len(form) and all(a < b for a, b in zip(start, end, strict=True)) and start == sorted(start)


def test_operator(spark):
    vocab = C.vocabulary(spark.createDataFrame([("The",), ("cot",), (None,)], "w string"), "w")
    assert {r["word"] for r in vocab.collect()} == {"the", "cot"}
    rows = [(1, "Тһе cat", "x", True), (2, None, "y", True), (3, "", "z", True), (4, "plain", "p", True), (4, "plain", "p", True), (5, "нос", "q", True), (6, "сoт", "r", True), (7, "a" * 50_000 + "\xa0", "s", True)]
    df = spark.createDataFrame(rows, "id int, text string, word string, is_changed boolean")
    got = C.canonical_form(df, "text", vocab).orderBy("id").collect()
    assert [(r["id"], r["canonical"] if len(r["canonical"] or "") < 99 else "long", r["is_changed"]) for r in got] == [(1, "The cat", True), (2, None, False), (3, "", False), (4, "plain", False), (4, "plain", False), (5, "нос", False), (6, "cot", True), (7, "long", True)]
    assert C.canonical_form(df.limit(0), "text", vocab).count() == 0


def test_without_vocabulary_the_dominant_script_decides(spark):
    df = spark.createDataFrame([("сoт",)], "text string")
    assert C.canonical_form(df, "text").first()["canonical"] == "сот"


def test_marks_and_syllables_are_mapped_by_cluster():
    """Texts that compose across characters have their form and places, not the text as it was."""
    text = "\u1100\u1161 ca\u0301fe\u0301 a\u0301\u0323\xa0x"
    form, start, end = C.canonical_with_places(text)
    assert form == C.canonical(text) and form != text and len(start) == len(end) == len(form)
    assert (start[0], end[0]) == (0, 2)


def test_both_ways_of_settling_readings(spark):
    """Known readings sent along, and joined where they are too many, give the same; a hot text is one row of the join."""
    vocab = C.vocabulary(spark.createDataFrame([("cot",), ("нос",)], "w string"), "w")
    rows = [("сoт",)] * 300 + [("нoc",), ("plain",), (None,), ("Тһе сoт and нoc",), ("",)]
    df = spark.createDataFrame(rows, "text string")
    one, two = (sorted(map(str, C.canonical_form(df, "text", vocab, max_known=n).collect())) for n in (200_000, 0))
    assert one == two and len(one) == len(rows) and any("'cot'" in r for r in one)


def test_changed_words_are_looked_at_once(spark):
    df = spark.createDataFrame([("ｔｈｅ", 1), ("ｔｈｅ", 2), ("the", 3), (None, 4), ("café", 5)], "word string, form int")
    assert [tuple(r) for r in C.changed_words(df, "word").collect()] == [("ｔｈｅ", "the")]
    assert C.changed_words(df.limit(0), "word").count() == 0
