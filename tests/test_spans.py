import random

from textloom.lexicon import preprocess_rows
from textloom.operators import categories, hmm, spans

TOKENS = "input_id int, seq int, word string, pos string, token_type string"


def _tokens(spark, text, tags=None, key=1):
    words = text.split()
    tags = (tags or "NN " * len(words)).split()
    return spark.createDataFrame([(key, i, w, t, "word") for i, (w, t) in enumerate(zip(words, tags, strict=True))], TOKENS)


def _phrases(spark, *phrases):
    return spark.createDataFrame([(p, len(p.split()), "both") for p in phrases], "phrase string, n int, mwe_type string")


def test_the_span_is_the_matched_phrase(spark):
    found = spans.candidates(_tokens(spark, "in new york city map"), _phrases(spark, "new york", "new york city hall"))
    assert [tuple(r) for r in spans.leftmost_longest(found).collect()] == [(1, 1, 2, "new york")]


def test_phrases_of_any_length(spark):
    text = "see new york city hall and the museum of modern art in the city of new york today"
    long = "the museum of modern art in the city of new york"
    found = spans.leftmost_longest(spans.candidates(_tokens(spark, text), _phrases(spark, "new york city hall", "new york", long, "modern art")))
    assert sorted((r["seq"], r["n"], r["phrase"]) for r in found.collect()) == [(1, 4, "new york city hall"), (6, 11, long)]
    assert spans.candidates(_tokens(spark, text), _phrases(spark).limit(0)).count() == 0


def test_phrases_need_neighbours(spark):
    t = spark.createDataFrame([(1, 0, "new", "NN", "word"), (1, 2, "york", "NN", "word"), (2, 0, "New", "NN", "word"), (2, 1, "York", "NN", "word"), (3, 0, None, "NN", "word")], TOKENS)
    assert [(r["input_id"], r["seq"]) for r in spans.candidates(t, _phrases(spark, "new york")).collect()] == [(2, 0)]


def test_merged_view_takes_every_kind_of_span(spark):
    pre = spark.createDataFrame(preprocess_rows(), "word string, tag string, value string")
    words = "she will run and had eaten bread 3 days ago in new york city hall".split()
    tags = "PRP MD VB CC VBD VBN NN SYS NNS RB IN JJ NNP NN NN".split()
    t = spark.createDataFrame([(1, i, w, p, "word", i + 1) for i, (w, p) in enumerate(zip(words, tags, strict=True))], TOKENS + ", token_id int")
    view = spans.merged_view(t, spans.all_spans(t, _phrases(spark, "new york city hall"), pre)).orderBy("seq").collect()
    assert [(r["seq"], r["n"], r["word"], r["pos"], r["kind"]) for r in view if r["kind"]] == [
        (1, 2, "will run", "VF", "future"), (4, 2, "had eaten", "VHP", "verb"), (7, 3, "|past_date_period|", "SYS", "period"), (11, 4, "new york city hall", "MWE", "mwe"),
    ]
    assert sum(r["n"] for r in view) == len(words) and [r["word"] for r in view if not r["kind"]] == ["she", "and", "bread", "in"]
    scoring = spans.merged_view(t, spans.all_spans(t, _phrases(spark, "new york city hall"), pre, scoring=True)).collect()
    assert [r["word"] for r in scoring if r["kind"]] == ["new york city hall"]


def test_leftmost_longest_equals_a_scan(spark):
    rng = random.Random(3)
    texts = {k: [rng.choice("abcd") for _ in range(40)] for k in range(25)}
    rows = [(k, i, w, "NN", "word") for k, ws in texts.items() for i, w in enumerate(ws)]
    known = {"a b", "b c", "a b c", "c d", "d d d"}
    got = spans.leftmost_longest(spans.candidates(spark.createDataFrame(rows, TOKENS), _phrases(spark, *known))).collect()
    want = set()
    for k, ws in texts.items():
        i = 0
        while i < len(ws):
            n = next((n for n in (3, 2) if i + n <= len(ws) and " ".join(ws[i : i + n]) in known), 0)
            if n:
                want.add((k, i, n, " ".join(ws[i : i + n])))
            i += n or 1
    assert {tuple(r) for r in got} == want


def test_view_covers_every_token_once(spark):
    t = _tokens(spark, "a b c a b")
    view = spans.span_view(t, spans.leftmost_longest(spans.candidates(t, _phrases(spark, "a b")))).collect()
    assert sorted((r["seq"], r["n"], r["word"]) for r in view) == [(0, 2, "a b"), (2, 1, "c"), (3, 2, "a b")]


def test_negation_and_have(spark):
    n = spans.verb_spans(_tokens(spark, "do not run", "VB RB VB")).collect()
    assert [(r["seq"], r["last_seq"], r["pos"], r["is_negative"]) for r in n] == [(1, 2, "VH", True)]
    h = spans.verb_spans(_tokens(spark, "has eaten", "VBZ VBN")).collect()
    assert [(r["pos"], r["is_negative"]) for r in h] == [("VBN", False)]
    d = spans.verb_spans(_tokens(spark, "had eaten", "VBD VBN")).collect()
    assert [r["pos"] for r in d] == ["VHP"]


def test_future(spark):
    got = spans.future_verbs(_tokens(spark, "she will not run and will have gone", "PRP MD RB VB CC MD VBP VBN")).orderBy("seq").collect()
    assert [(r["seq"], r["n"], r["pos"], r["is_negative"]) for r in got] == [(1, 3, "VF", True), (5, 3, "VHF", False)]


def test_periods(spark):
    pre = spark.createDataFrame(preprocess_rows(), "word string, tag string, value string")
    got = lambda text: [(r["tag"], r["seq"], r["last_seq"]) for r in spans.period_spans(_tokens(spark, text), pre).collect()]
    assert got("last monday") == [("|past_day_of_week|", 0, 1)]
    assert got("3 days ago") == [("|past_date_period|", 0, 2)]
    assert got("in 3 weeks") == [("|future_date_period|", 0, 2)]
    assert got("three hours") == []
    assert got("next march") == [("|future_month|", 0, 1)]
    assert got("weeks later") == [("|future_date_period|", 0, 1)]
    assert got("the last 10 minutes") == [("|past_time_period|", 1, 3)]


def test_intents(spark):
    table = spark.createDataFrame(spans.intent_rows(), "phrase string, n int, intent string")
    t = _tokens(spark, "please do not stop never again")
    scores = {r["input_id"]: (r["intent"], round(r["score"], 3)) for r in spans.intent_scores(spans.intents(t, table), t).collect()}
    assert scores == {1: ("negation", 0.333)}
    assert spans.intent_scores(spans.intents(_tokens(spark, "a b"), table), _tokens(spark, "a b")).first()["intent"] == "neutral"


def test_intents_of_any_length(spark):
    path = "it would be of great help to me if you could"
    table = spark.createDataFrame([(path, len(path.split()), "request")], "phrase string, n int, intent string")
    assert [r["n"] for r in spans.intents(_tokens(spark, f"well {path} come"), table).collect()] == [11]


def test_decoding_equals_brute_force(spark):
    import itertools
    import math

    tags = spark.createDataFrame([("NN", 14), ("VB", 31), ("SS", 27), ("JJ", 8), ("FW", 6)], "tag string, code int")
    senses = spark.createDataFrame([("dog", 0, "NN", 1), ("dog", 1, "VB", 2), ("run", 0, "VB", 3), ("run", 1, "NN", 4), ("red", 0, "JJ", 5), (".", 0, "SS", 6)], "word string, ord int, pos string, token_id int")
    rng = random.Random(5)
    rows = []
    for k in range(12):
        for i in range(5):
            w = rng.choice(["dog", "run", "red"])
            rows.append((k, i, w, {"dog": rng.choice(["NN", "NN", "VB"]), "run": rng.choice(["VB", "VB", "NN"]), "red": "JJ"}[w], "word"))
        rows.append((k, 5, ".", "SS", "word"))
    s = hmm.sentences(spark.createDataFrame(rows, TOKENS))
    model = hmm.train(s)
    decoded = hmm.decode(s, model, senses, tags).collect()
    got = {(r["input_id"], r["seq"]): r["tag"] for r in decoded}
    assert all(0 < r["confidence"] <= 1 for r in decoded) and len(decoded) == len(rows)
    ini = {r["tag"]: r["lp"] for r in model.initial().collect()}
    tr = {(r["prev_tag"], r["tag"]): r["lp"] for r in model.transitions().collect()}
    em = {(r["tag"], r["word"]): r["lp"] for r in model.emissions().collect()}
    miss = {r["tag"]: r["lp"] for r in model.unseen().collect()}
    code = {"NN": 14, "VB": 31, "SS": 27, "JJ": 8}
    options = {"dog": ["NN", "VB"], "run": ["NN", "VB"], "red": ["JJ"], ".": ["SS"]}
    for k in range(12):
        ws = [r[2] for r in rows if r[0] == k]

        def value(path, ws=ws):
            v = ini.get(path[0], -30.0)
            for i, t in enumerate(path):
                v += em.get((t, ws[i]), miss.get(t, -30.0)) + (tr.get((path[i - 1], t), -30.0) if i else 0)
            return v

        paths = list(itertools.product(*(options[w] for w in ws)))
        best = max(paths, key=value)
        found = tuple(got[k, i] for i in range(len(ws)))
        assert math.isclose(value(found), value(best), abs_tol=1e-9), (found, best, code)


def test_tags_that_are_none_count_as_unknown(spark):
    rows = [(1, 0, "a", "N N", "word"), (1, 1, "b", "xx", "word"), (1, 2, "c", None, "word"), (1, 3, "d", "nn", "word")]
    assert [r["t"] for r in hmm.sentences(spark.createDataFrame(rows, TOKENS)).orderBy("seq").collect()] == ["FW", "FW", "FW", "NN"]


def test_category_depth(spark):
    class Lx:
        tokens = spark.createDataFrame([(1, [3]), (2, [9]), (3, None)], "token_id int, categories array<smallint>")
        categories = spark.createDataFrame([(3, [1, 2, 3]), (9, [1, 2, 9])], "cat_id smallint, fqn array<smallint>")

    pairs = spark.createDataFrame([(1, 2), (1, 3)], "a int, b int")
    assert {(r["a"], r["b"]): r["distance"] for r in categories.distances(Lx, pairs).collect()} == {(1, 2): 2.0, (1, 3): 0.0}
