import random

import numpy as np

from textloom.llm import leakage as L


def test_words():
    assert L.words_of("L'été (a [b] c) vient, ÉTÉ_2 [x\ny] ) fin") == ["l", "été", "vient", "été", "2", "fin"]
    assert L.words_of(None) == L.words_of("") == []


def _brute(docs, items, n):
    def grams(t):
        w = L.words_of(t)
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}

    return {(i, k) for i, t in docs for k, u in items if grams(t) & grams(u)}


def test_leaks_equal_brute_force(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(30)]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.choice([5, 12, 13, 40])))) for k in range(30)] + [(99, None), (98, "")]
    docs = []
    for i in range(120):
        t = [rng.choice(words) for _ in range(50)]
        if i % 3 == 0:
            _, u = rng.choice(items[:30])
            cut = rng.randrange(3)
            own = u.upper().split()[cut : cut + rng.choice([11, 12, 30])]
            own.insert(len(own) // 2, "(Hear, hear! [x])")
            t[20:20] = own
        docs.append((i, " ".join(t)))
    docs += [docs[0], (500, None), (501, ""), (502, " ".join(words * 3000))]
    d = spark.createDataFrame([(*r, "clash") for r in docs], "doc_id long, text string, item_id string").repartition(3)
    e = spark.createDataFrame([(*r, "clash") for r in items], "item_id int, text string, doc_id string")
    want = _brute([r for r in docs if r[1]], [r for r in items if r[1]], 12)
    for block in (500_000, 60):
        got = [tuple(r) for r in L.find_leaks(d, "doc_id", "text", e, "item_id", "text", block_windows=block).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert L.find_leaks(d.limit(0), "doc_id", "text", e, "item_id", "text").count() == 0
    assert L.find_leaks(d, "doc_id", "text", e.limit(0), "item_id", "text").count() == 0


def test_edits_reach_the_recall():
    rng = np.random.default_rng(0)
    vocab = [f"w{i}" for i in range(500)]
    items = [(k, [vocab[j] for j in rng.integers(0, 500, 12)]) for k in range(300)]
    index = L.Index(items, 12, 1, 0.95, 7)
    hit = 0
    for k, words in items:
        changed = list(words)
        changed[int(rng.integers(0, 12))] = "foreign"
        ids = np.array([index.vocabulary.get(w, 0) for w in changed], np.int32)
        hit += k in set(index.matches(ids)[1].tolist())
    assert hit / len(items) >= 0.9


def test_verification_is_exact():
    index = L.Index([(0, list("abcdef"))], 6, 2, 0.9, 1)
    a = np.array([[1, 2, 3, 4, 5, 6], [1, 2, 3, 4, 5, 6], [1, 2, 3, 4, 5, 6]], np.int32)
    b = np.array([[2, 3, 4, 5, 6, 7], [1, 9, 3, 9, 5, 6], [9, 9, 9, 4, 5, 6]], np.int32)
    assert index.verify(a, b).tolist() == [True, True, False]


def test_recall_against_brute_force(spark):
    """With one edit allowed, the pairs that hashing finds are all real, and at least nine in ten of those of brute force."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(60)]
    items = [(k, [rng.choice(words) for _ in range(14)]) for k in range(40)]
    docs = []
    for i in range(80):
        t = [rng.choice(words) for _ in range(20)]
        own = list(rng.choice(items)[1])
        at, kind = rng.randrange(14), rng.randrange(3)
        own[at : at + (kind != 1)] = [] if kind == 2 else ["other"]
        t[8:8] = own
        docs.append((i, t))

    def apart(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    windows = {k: [t[j : j + 12] for j in range(3)] for k, t in items}
    want = {(d, k) for d, t in docs for k, own in windows.items() if any(len(set(t[j : j + 12]) & set(w)) >= 6 and apart(t[j : j + 12], w) <= 1 for j in range(len(t) - 11) for w in own)}
    d = spark.createDataFrame([(i, " ".join(t)) for i, t in docs], "doc_id long, text string")
    e = spark.createDataFrame([(k, " ".join(t)) for k, t in items], "item_id int, text string")
    got = {tuple(r) for r in L.find_leaks(d, "doc_id", "text", e, "item_id", "text", edits=1).collect()}
    assert got <= want and len(got) >= 0.9 * len(want) and len(want) > 50
