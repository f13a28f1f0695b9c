import pytest

from textloom.llm import personal as P

VALUES = [
    ("Write to a.b+c@post.kestrel.example or ring (020) 7946 0333.", [("a.b+c@post.kestrel.example", "email"), ("(020) 7946 0333", "phone")]),
    ("Contact: x_y (at) boite.example, 07700900116.", [("x_y (at) boite.example", "email"), ("07700900116", "phone")]),
    ("Mail okan [at] nordnet dot test now.", [("okan [at] nordnet dot test", "email")]),
    ("My national insurance number is QQ 45 39 17 A.", [("QQ 45 39 17 A", "id_number")]),
    ("Passport no. ZX7657019 was refused; tax id 936-76-8937.", [("ZX7657019", "id_number"), ("936-76-8937", "id_number")]),
    ("Mi teléfono es 955-50-9194. Mi DNI es 29047826W.", [("955-50-9194", "phone"), ("29047826W", "id_number")]),
    ("Die Steuer-ID lautet 03 307 070 513. Tel. 030/23125402.", [("03 307 070 513", "id_number"), ("030/23125402", "phone")]),
    ("We lived at Flat 9, 97 Pewter St., Upper Tarrow ZZ1 8QX.", [("Flat 9, 97 Pewter St., Upper Tarrow ZZ1 8QX", "address")]),
    ("Frau A., Am Alten Speicher 153a in 01508 Kaltenquell, kam.", [("Am Alten Speicher 153a in 01508 Kaltenquell", "address")]),
    ("Mon adresse est 24 bis av. du Vieux-Lavoir 99479 Skek-le-Vieux.", [("24 bis av. du Vieux-Lavoir 99479 Skek-le-Vieux", "address")]),
    ("Vivo en C/ Olmo Viejo 111, 2 B, 99421 Doh de la Sierra.", [("C/ Olmo Viejo 111, 2 B, 99421 Doh de la Sierra", "address")]),
    ("Call oh seven seven double-oh nine double-oh one two.", [("oh seven seven double-oh nine double-oh one two", "phone")]),
    ("Invoice 2024-60460-3 of 12.05.2024 for 5.395,77, ticket #792391, 485/133/41, version 108.255.37, 3 @ 50.88.", []),
]


@pytest.mark.parametrize("text, want", [*VALUES, ("Ring oh-seven-seven-nine-nine-two now.", [("oh-seven-seven-nine-nine-two", "phone")]), ("It is seven seven seven seven seven seven.", [("seven seven seven seven seven seven", "phone")])])
def test_values_by_form(text, want):
    assert sorted((text[a:b], k) for a, b, k in P.structured(text)) == sorted(want)
    assert P.structured(text, set(P._lows(text))) == P.structured(text)


#: Seeds: names where somebody says who somebody is; they make the terms known.
SEEDS = [
    "My name is Delphine Pellingworth and I live here.", "My name is Delphine O. Dunleary-Voss.", "I spoke to Orrin Pellingworth at the desk.", "My name is Linnea Bushson.", "Mrs. Okandi will come.", "Mrs. Pellingworth paid.", "My name is Orrin Okandi.", "I spoke to Linnea Okandi.", "Dr. McSorrel's clinic closed.",
    "Je m'appelle Bérénice Fygreau et j'habite ici.", "Je m'appelle Côme d'Aubrevoie.", "M. Fygreau et Mme Fygreau ont payé.", "Me llamo Germán Flicez y vivo aquí.", "Hablé con Germán Lirano ayer.", "Ich heiße Friedegund Drojbach und wohne hier.", "Frau Drojbach hat angerufen.", "Herr Drojbach, Friedegund wohnt hier.",
    "Меня зовут Т. Б. Водосвятов.", "Ο κ. Καμπερίδης πλήρωσε.", "मेरा नाम चारुलता वनमाली है।", "私は葉室そよかです。", "我叫阚沐禾。", "اسمي هالة الشماريخي.", "My name is Maria del Carmen Garcia Lopez de la Vega.", "I spoke to Maria Garcia.", "My name is Carmen Lopez.", "Mr. Vega left.", *["My name is Tessaly."] * 4,
]
FILL = ["The office closed at nine and the lamp is late.", "Please send the new form to the office.", "We lived there and nobody came.", "The letter for the school was lost at the desk.", "My colleague and the other one left the number with kind regards.", "La señora espera en la oficina.", "Le bureau attend une réponse.", "Er ist im Büro und wartet.", "Kind regards to all of you.", "कल वह आई और गई।"] * 4
#: No cue, title or frame stands before these; the corpus knows their terms.
ANYWHERE = [
    ("The letter for Linnea Pellingworth was lost.", ["Linnea Pellingworth"]), ("my colleague delphine okandi left", ["delphine okandi"]), ("The form\nfor Bushson, Linnea (tax id x) was lost.", ["Bushson, Linnea"]), ("To be honest, Orrin A. Tunmore left the number there.", ["Orrin A. Tunmore"]),
    ("Kind regards, Tessaly", ["Tessaly"]), ("Côme d'Aubrevoie (0199004925) attend", ["Côme d'Aubrevoie"]), ("La oficina de germán flicez espera", ["germán flicez"]), ("Pellingworth & Co. closed and Okandi Road is dark.", []), ("Nobody came to the Office of Lamps.", []),
    ("Write to Maria del Carmen Garcia Lopez de la Vega today.", ["Maria del Carmen Garcia Lopez de la Vega"]), ("चारुलता वनमाली कल आई।", ["चारुलता वनमाली"]),
]
IN_SLOTS = [("Mrs. Okandi will come.", "Okandi"), ("Dr. McSorrel's clinic closed.", "McSorrel"), ("Herr Drojbach, Friedegund wohnt hier.", "Drojbach, Friedegund"), ("Меня зовут Т. Б. Водосвятов.", "Т. Б. Водосвятов"), ("मेरा नाम चारुलता वनमाली है।", "चारुलता वनमाली"), ("私は葉室そよかです。", "葉室そよか"), ("我叫阚沐禾。", "阚沐禾"), ("اسمي هالة الشماريخي.", "هالة الشماريخي")]


def test_names_by_disclosure(spark):
    """Names are found by what the corpus says of their terms, in slots and anywhere else, however long or written."""
    wanted = [*ANYWHERE, *((t, [n]) for t, n in IN_SLOTS)]
    texts = [t for t, _ in wanted] + [t for t in SEEDS if t not in dict(wanted)] + FILL
    found = P.find_personal(spark.createDataFrame(list(enumerate(texts)), "input_id long, text string")).where("pii_type = 'name'").collect()
    got: dict[int, list[str]] = {}
    for r in sorted(found, key=lambda r: (r["input_id"], r["start"])):
        got.setdefault(r["input_id"], []).append(texts[r["input_id"]][r["start"] : r["end"]])
    assert {t: got.get(i, []) for i, (t, _) in enumerate(wanted)} == dict(wanted)


TEXTS = [
    (1, "My name is Ann Lee and I live in Oz. Write to a@b.example."), (1, "My name is Ann Lee and I live in Oz. Write to a@b.example."), (2, "I spoke to the office at the desk. The office closed. The office is late. Go to the office."), (3, None), (4, "  "), (5, "Ann Lee came again."), (7, "My name is Ann Lee. I spoke to Ann Lee at home."), (6, "x" * 60_000),
]


def test_corpus_decides_on_names(spark):
    texts = spark.createDataFrame([(*r, "clash") for r in TEXTS], "input_id long, text string, start string")
    values = P.find_personal(texts)
    got = {(r["input_id"], r["start"], r["end"], r["pii_type"]) for r in values.collect()}
    assert got == {(1, 11, 18, "name"), (1, 46, 57, "email"), (5, 0, 7, "name"), (7, 11, 18, "name"), (7, 31, 38, "name")}
    masked = {r["input_id"]: r["masked"] for r in P.mask(texts, values).collect()}
    assert masked[1] == "My name is [NAME] and I live in Oz. Write to [EMAIL]."
    assert masked[4] == "  " and 3 not in masked
    assert P.find_personal(texts.limit(0)).count() == 0


def test_token_rows(spark):
    texts = spark.createDataFrame(TEXTS, "input_id long, text string")
    words = "My name is Ann Lee and I live in Oz . Write to a@b.example .".split()
    rows = [(1, i, w) for i, w in enumerate(words)]
    tokens = spark.createDataFrame(rows + rows[:4] + [(9, 0, "z"), (1, 99, None)], "input_id long, seq int, word string")
    got = {(r["input_id"], r["seq"], r["pii_type"]) for r in P.token_hits(P.find_personal(texts), tokens).collect()}
    assert got == {(1, 3, "name"), (1, 4, "name"), (1, 13, "email")}


def test_letters_whose_lower_case_is_longer(spark):
    texts = ["My name is İlkay Şen.", "İlkay Şen came with İ. Şen.", "İ" * 50, "ß ſ ŉ ﬁ"]
    df = spark.createDataFrame(list(enumerate(texts)) + [(9, None)], "input_id long, text string")
    assert all(0 <= r["start"] < r["end"] <= len(texts[r["input_id"]]) for r in P.find_personal(df).collect())


def test_two_texts_of_one_input_are_read_apart(spark):
    rows = [(1, "My name is Delphine Okandi."), (1, "Mrs. Okandi spoke to Orrin today."), (2, "My name is Orrin Okandi."), (3, "I met Delphine and Mr. Okandi."), (4, "The office is closed and the lamp is late today."), (5, "Nobody came to the office.")]
    df = spark.createDataFrame(rows, "input_id long, text string")
    got = sorted((r["input_id"], r["start"], r["end"]) for r in P.find_personal(df).collect())
    assert (1, 11, 26) in got and (1, 5, 11) in got and (2, 11, 23) in got
