import numpy as np
import pytest

from textloom.llm import moderation as M

KIND = dict(zip(M.KINDS, range(3), strict=True))
CASES = [
    ("You are a halfwit and everyone here knows it.", "abusive"), ("Sit down, you pathetic l1@r.", "abusive"), ("You stinking s*ine!", "abusive"), ("You are a i.d.i.o.t and we know.", "abusive"), ("Shut your mouth, weeeeeasel, go.", "abusive"),
    ("Someone ought to break your legs for that.", "abusive"), ("Vous êtes un m e n t e u r et tout le monde le sait.", "abusive"), ("¡Cállese, pedazo de PAYASO!", "abusive"), ("That maggot from Oz should crawl back.", "abusive"),
    ("The Tarnfolk are vermin and should be driven out.", "hateful"), ("No decent family wants a filthy Quellish next door.", "hateful"), ("Les Oskeni sont de la vermine, il faut les chasser.", "hateful"), ("Women are too stupid to hold this office and belong at the stove.", "hateful"),
    ("Take your clothes off and get on your knees for me.", "sexual"), ("(A member: Show us your tits!)", "sexual"), ("Zieh dich aus und komm in mein Bett, Süße.", "sexual"),
    ("The word liar is unparliamentary, and I ask that it be withdrawn.", None), ("Swine fever reached the farms of Oz.", None), ("Sex education in schools falls under the Act.", None), ("Naked flames are forbidden near the school.", None), ("The survivors of rape deserve a court that listens.", None),
    ("For years Quellish families were treated like vermin, and that is a disgrace.", None), ("The Bill makes it an offence to incite hatred against the Oskeni community.", None), ("Scumbridge and Cockerby will share one pension.", None), ("Breeding bitches must be registered under clause 9.", None), ("", None), (None, None),
]


@pytest.fixture(scope="module")
def scanner():
    return M.Scanner()


@pytest.mark.parametrize("text, kind", CASES)
def test_dense_features(scanner, text, kind):
    """What is aimed at someone shows in the features of its kind; what only speaks of it shows as reported, or nowhere."""
    x = scanner.features(text)
    names = {f: i for i, f in enumerate(M.FEATURES)}
    aimed = ("near_address", "near_adjective", "near_group", "adjective_near_group", "phrases", "phrase_near_address", "open_terms", "open_adjectives")
    if kind:
        assert any(x[KIND[kind], names[f]] > 0 for f in aimed)
    if not text:
        assert not x[:, names["terms_rate"]].any() and not x[:, names["learnt_rate"]].any()


def test_obfuscation_and_loudness(scanner):
    names = {f: i for i, f in enumerate(M.FEATURES)}
    plain, hidden, loud = (scanner.features(t)[0] for t in ("You are a moron.", "You are a m0r*n!", "YOU ARE A MORON!"))
    assert plain[names["obfuscated"]] == 0 and hidden[names["obfuscated"]] > 0 and plain[names["terms_rate"]] == hidden[names["terms_rate"]]
    assert loud[names["loud_terms"]] == 1 and loud[names["capitals_rate"]] > plain[names["capitals_rate"]] and hidden[names["exclaims_rate"]] > 0


def test_trees_learn_and_calibration_is_monotone():
    rng = np.random.default_rng(1)
    x = np.zeros((2000, len(M.FEATURES)))
    x[:, 3], x[:, 5] = rng.random(2000), rng.random(2000)
    true = (x[:, 3] > 0.6) & (x[:, 5] < 0.5)
    y = (true ^ (rng.random(2000) < 0.05)).astype(float)
    m = M.Boosted(x[:1000], y[:1000], np.ones(1000))
    p = m.score(x[1000:])
    assert ((p >= 0.5) == true[1000:]).mean() > 0.95
    assert (np.diff(m.steps[1]) >= 0).all() and p.min() >= 0 and p.max() <= 1


def test_fit_and_score(spark):
    good, bad = "We support the bill tonight.", "You are a moron, sit down."
    docs = [(i, bad if i % 4 == 0 else good, "s", 0.1) for i in range(80)] + [(900, None, "s", 0.1), (901, "", "s", 0.1), (902, good * 3000, "s", 0.1), (0, bad, "s", 0.1)]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string, abusive double")
    votes = [(i, int(i % 4 == 0), "abusive" if i % 4 == 0 else None) for i in range(60)] + [(1, 1, "abusive"), (2, None, "hateful"), (5000, 1, "sexual"), (None, 1, "abusive")]
    labels = spark.createDataFrame(votes, "doc_id long, flagged int, kind string")
    scores = M.score(d, M.fit(d, labels), keep=("source",)).collect()
    assert len(scores) == len(docs)
    assert {r["doc_id"] for r in scores if r["abusive"] >= 0.5} == {i for i in range(80) if i % 4 == 0}
    assert all(r["sexual"] < 0.5 and r["hateful"] < 0.5 for r in scores)
    none = labels.limit(0)
    assert all(r[k] is None for r in M.score(d, M.fit(d, none)).collect() for k in M.KINDS)
    assert M.score(d.limit(0), M.fit(d, none)).count() == 0
    assert M.fit(d, labels, max_labels=5).boosted[0] is not None


def test_the_learnt_lexicon_and_trees_decide(spark):
    """Words that no list holds are learnt from labels, and the same term is judged by its neighbourhood."""
    bad, good = "You are a weasel and a snollygoster.", "The weasel is a small animal of the woods."
    rows = [(i, "We go on. " * (i // 2 % 7) + (bad if i % 2 else good)) for i in range(200)] + [(1000, "You are a weasel and a snollygoster, they say."), (1001, "A weasel of the woods.")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, "abusive" if i % 2 else None) for i in range(160)], "doc_id long, flagged int, kind string")
    m = M.fit(d, labels)
    assert m.boosted[0].trees and "snollygoster" in m.learnt[0]
    got = {r["doc_id"]: r["abusive"] for r in M.score(d, m).collect()}
    assert all((got[i] >= 0.5) == bool(i % 2) for i in range(160, 200)) and got[1000] >= 0.5 > got[1001]
    assert all(r["hateful"] is None or r["hateful"] < 0.5 for r in M.score(d, m).collect())
