import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.llm import packing as K


def _plain_first_fit(sizes, capacity):
    room, out = [], []
    for s in sizes:
        for i, r in enumerate(room):
            if r >= s:
                break
        else:
            room.append(capacity)
            i = len(room) - 1
        room[i] -= s
        out.append(i)
    return out


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=80))
def test_tree_equals_plain_first_fit(sizes):
    sizes = sorted(sizes, reverse=True)
    assert K.first_fit_decreasing(np.array(sizes, np.int64), 50).tolist() == _plain_first_fit(sizes, 50)


def test_every_token_is_packed_once_and_nothing_overflows(spark):
    rng = random.Random(2)
    items = [(i, rng.choice([0, 3, 40, 99, 100, 101, 250])) for i in range(400)] + [(7, 40)] * 5 + [(None, 12), (3, None)]
    boxes = spark.createDataFrame([("small", 100), ("big", 1000), ("none", 0), ("null", None)], "container_kind string, capacity_tokens int")
    got = K.pack(spark.createDataFrame(items, "doc_id long, tokens long"), boxes, group_items=100).toPandas()
    assert set(got["container_kind"]) == {"small", "big"}
    for kind, capacity in (("small", 100), ("big", 1000)):
        own = got[got["container_kind"] == kind]
        assert own.groupby("container_id")["tokens"].sum().max() <= capacity
        assert own["tokens"].sum() == sum(n or 0 for _, n in items)
        assert not own.duplicated(["doc_id", "copy", "part", "tokens"]).any()
        whole = own.groupby(["doc_id", "copy"], dropna=False)["part"].count()
        sizes = own.groupby(["doc_id", "copy"], dropna=False)["tokens"].sum()
        assert (whole[sizes <= capacity] == 1).all()
        used = own["container_id"].nunique()
        assert own["tokens"].sum() / (used * capacity) > 0.85
    assert K.pack(spark.createDataFrame([], "doc_id long, tokens long"), boxes).count() == 0


def test_token_counts(spark):
    import base64

    import tiktoken

    texts = [(1, "Don't stop, it's 12 o'clock!\n\n  Straße"), (2, ""), (3, None), (4, "a" * 3000), (1, "x")]
    got = [r["tokens"] for r in K.token_counts(spark.createDataFrame(texts, "doc_id long, text string").coalesce(1), "doc_id", "text").collect()]
    with open(K.TOKENIZER, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    plain = tiktoken.Encoding("own", pat_str=K.PIECES, mergeable_ranks=ranks, special_tokens={})
    assert got == [len(plain.encode_ordinary(t or "")) for _, t in texts]
