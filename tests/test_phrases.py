from textloom.operators.phrases import Antecedents, Reader
from textloom.operators.spans import intent_rows


def _tokens(text, tags):
    out = []
    for w, p in zip(text.split(), tags.split(), strict=True):
        out.append({"word": w, "pos": p, "pronoun": None, "is_noun": p.startswith("N"), "is_verb": p.startswith("V"), "is_adverb": p.startswith("R"), "is_adjective": p.startswith("J"), "is_pronoun": p in ("PR", "PRP"), "is_preposition": p == "IN", "is_auxiliary": False, "is_predicative": False, "is_person": p == "NNP", "is_entity": False})
    return out


def _read(text, tags):
    return Reader({tuple(p.split()): k for p, _, k in intent_rows()}).read(_tokens(text, tags))[0]


def _said(p, text):
    words = text.split()
    return p.start, p.end, p.split, [words[u.at] for u in p.nouns], [words[u.at] for u in p.verbs], p.tense


def test_nothing_and_one_token():
    assert Reader({}).read([]) == ([], [])
    assert len(_read("dogs", "NNS")) == 1


def test_a_clause_stays_whole():
    t = "dogs chased cats"
    assert [_said(p, t) for p in _read(t, "NNS VBD NNS")] == [(0, 3, None, ["dogs", "cats"], ["chased"], "past")]
    t = "dogs chased cats ."
    assert [_said(p, t) for p in _read(t, "NNS VBD NNS SS")] == [(0, 3, 3, ["dogs", "cats"], ["chased"], "past")]
    t = "dogs chase cats"
    (p,) = _read(t, "NNS VB NNS")
    assert (p.start, p.end, p.split, sorted(u.at for u in p.nouns)) == (0, 3, None, [0, 2])


def test_compounds_siblings_and_questions():
    (p,) = _read("city hall closed", "NN NN VBD")
    assert p.nouns[0].at == 1 and [m.at for m in p.nouns[0].modifiers] == [0]
    (p,) = _read("dogs and cats slept", "NNS CC NNS VBD")
    assert [s.at for s in p.nouns[0].siblings] == [2]
    p = _read("who runs ?", "PRP VBZ SS")[0]
    assert p.kind == "interrogative"


def test_phrases_are_ordered_and_apart():
    ps = _read("dogs sleep . cats eat fish in houses , birds sing .", "NNS VB SS NNS VB NN IN NNS PUNC NNS VB SS")
    assert all(a.end <= b.start for a, b in zip(ps, ps[1:], strict=False))


def test_antecedents():
    a = Antecedents()
    for t in _tokens("Ann met Bob", "NNP VBD NNP"):
        a.other(t)
    third = {"category": "personal", "person": "third", "number": "singular"}
    assert a.resolve(third | {"gender": "feminine"}) == "Ann"
    assert a.resolve(third | {"gender": "masculine"}) == "Bob"
    assert a.resolve(third | {"gender": "feminine", "category": "possessive"}) == "Ann"
    assert a.resolve(third | {"gender": "neutral", "number": "plural"}) == "Ann|Bob"
    assert a.resolve({"category": "personal", "person": "first", "number": "singular", "gender": ""}) is None
    for _ in range(31):
        a.other(_tokens("and", "CC")[0])
    assert a.resolve(third | {"gender": "masculine"}) is None
