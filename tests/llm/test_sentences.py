import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.llm.sentences import Segmenter, find_sentences, lattice, sentences

CASES = [
    ["Dear office,", "Dr. Vocby's clinic closed at 5 p.m. on 16.06.2023, i.e. before we arrived.", "We need lamps, pipes etc. for it."],
    ["“Stop!” cried the guard.", "Nobody moved.", 'He wrote: "We are sorry. It is late." and left.', "“It is over,” he said.", "“Go home.”"],
    ["The fee is approx. £42.86.", "(That is too much for us.)", "See No. 9 of the list, p. 22, for it.", "Wait... is it urgent?"],
    ["We met at 9 a.m. Nobody else came."], ["The order went to Acme Inc.", "It never arrived."],
    ["Am 28. August war die Anhörung z. B. vorläufig.", "Er sagte: „Das reicht. Wir gehen.“ und ging.", "Laut Nr. 2 Abs. 39 kostet es 8.537,98 Euro."],
    ["Il a dit : « C'est fini. Partez. » et il a raccroché.", "Nous attendons depuis 6 semaines !", "M. Quageau et Mme Cuwier ont payé 89,0 euros."],
    ["¡Llevamos 6 semanas esperando!", "Espere... ¿el bus está roto?", "Dijo: «Se acabó. Váyanse.» y colgó."],
    ["Нужны лампы, трубы и т. д. для школы.", "«Закроют школу?» — спросила она.", "Меня зовут Т. Б. Водосвятов."],
    ["Πότε ανοίγει η βιβλιοθήκη;", "Ο κ. Καμπερίδης πλήρωσε 24,5 ευρώ."],
    ["पुल अभी तक बंद है।", "“क्या स्कूल बंद होगा?” उसने पूछा।"], ["سألت: «هل تغلق المدرسة؟» ثم خرجت.", "متى تفتح المكتبة؟"],
]


@pytest.mark.parametrize("units", CASES)
def test_spaced_scripts(units):
    if units == CASES[3]:
        units = ["We met at 9 a.m.", "Nobody else came."]
    text = "\n".join([units[0], " ".join(units[1:])]) if units[0].endswith(",") else " ".join(units)
    assert [text[a:b] for a, b in sentences(text)] == units


@pytest.mark.parametrize("units", [["「もう閉まりました。」と職員が言った。", "えっ、本当ですか？！", "（見てください。）という案内が届いた。"], ["他说：“结束了。请回去。”然后就走了。", "真的吗？！", "“会关门吗？”她问工作人员。"]])
def test_spaceless_scripts(units):
    text = "".join(units)
    assert [text[a:b] for a, b in sentences(text)] == units


def test_thai_is_split_at_spaces():
    text = "สวัสดีค่ะ\n\nไฟถนนเสียอีกแล้ว ห้องสมุดเปิดเมื่อไหร่"
    assert len(sentences(text)) == 3


def test_lines():
    def units(text):
        return [text[a:b].replace("\n", "/") for a, b in sentences(text)]

    assert units("Complaint about it\nPlease call\nme now") == ["Complaint about it", "Please call/me now"]
    assert units("- one\n- two\nKind regards\nHe came. it left.") == ["- one", "- two", "Kind regards", "He came.", "it left."]
    assert units("no stop here\nAnother line") == ["no stop here", "Another line"]
    assert units("visitors left.Send it") == ["visitors left.", "Send it"]


def test_lattice():
    assert lattice("我们已经等了", {"我们", "已经", "等", "了", "我"}, 2) == ["我们", "已经", "等", "了"]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aB. !?\n\"()“”«»。，あ了:;-1​กé"))
def test_units_cover_every_visible_character_once(text):
    got = sentences(text)
    assert all(a < b for a, b in got) and all(x[1] <= y[0] for x, y in zip(got, got[1:], strict=False))
    inside = {i for a, b in got for i in range(a, b)}
    assert all(i in inside for i, c in enumerate(text) if not c.isspace() and c != "​")
    assert all(not text[a].isspace() and not text[b - 1].isspace() for a, b in got)


@pytest.mark.parametrize("units", [["He said no.", "Nobody came back."], ["We saw the sun.", "They sat.", "Nobody moved."], ["This is art.", "Museums know it."], ["Passport no. QQ 31 70 B and fig. IV were refused.", "See No. 9.", "We met on Sat. June 5."], ["Dr. Will came in Sept. 2023.", "We left on Sun.", "They stayed."]])
@pytest.mark.parametrize("gap", [" ", "\n"])
def test_dots_behind_plain_words_are_read_by_the_best_path(units, gap):
    text = gap.join(units)
    assert [text[a:b] for a, b in sentences(text)] == units


def test_operator(spark):
    long = "This is one. " * 4000
    rows = [(1, "One two. Three four.", "x"), (1, "One two. Three four.", "x"), (2, None, "x"), (3, " \n ", "x"), (4, long, "x")]
    df = spark.createDataFrame(rows, "input_id long, original string, start_char string")
    got = find_sentences(df, "input_id", "original").groupBy("input_id").count().collect()
    assert {r[0]: r[1] for r in got} == {1: 2, 4: 4000}
    assert find_sentences(df.limit(0), "input_id", "original").count() == 0


@pytest.mark.parametrize(
    "units",
    [
        ["The U.S. Army came.", "It left."], ["She has a Ph.D. in law.", "He has none."], ["Wir wohnen Hauptstr. 5 im Dorf.", "Kommen Sie."],
        ["Բարեւ ձեզ։", "Ինչպես եք։"], ["ሰላም ነው።", "እንዴት ነህ።"], ["မင်္ဂလာပါ။", "နေကောင်းလား။"], ["یہ کتاب ہے۔", "وہ قلم ہے۔"],
    ],
)
def test_outside_the_templates(units):
    text = " ".join(units)
    assert [text[a:b] for a, b in sentences(text)] == units


def test_the_lattice_decides_gaps_of_spaceless_scripts():
    """What follows a closed quotation, and line ends, are read by the words of the whole run, however long."""
    s = Segmenter(["天気", "図書館", "电视台"])

    def units(text):
        return [text[a:b].replace("\n", "/") for a, b in sentences(text, s)]

    assert units("「もう閉まりました。」と彼女が言った。") == ["「もう閉まりました。」と彼女が言った。"]
    assert units("「もう閉まりました。」図書館は遠い。") == ["「もう閉まりました。」", "図書館は遠い。"]
    assert units("“会关门吗？”她问。") == ["“会关门吗？”她问。"]
    assert units("“会关门吗？”电视台很远。") == ["“会关门吗？”", "电视台很远。"]
    long = "学" * 60
    assert units(f"{long}电视\n台很远。") == [f"{long}电视/台很远。"]  # a word lies across the line end
    assert units(f"{long}完了\n电视台很远。") == [f"{long}完了", "电视台很远。"]
    assert units(f"{long}図書館は\n{long}です。") == [f"{long}図書館は/{long}です。"]


def test_many_lines_and_marks_take_linear_time():
    text = "line of words that goes on and\n" * 3000 + "(" * 2000 + "a. B" * 2000 + ")" * 2000
    got = sentences(text)
    assert got and got[-1][1] == len(text)
