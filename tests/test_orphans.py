from datetime import datetime

import pytest

from textloom.operators import orphans

REFS = "src string, target_id long, ref_time timestamp, reason string, loaded_at string"
PARENTS = "key long, loaded_at timestamp, deleted_at timestamp, target_id int"
DAY = [datetime(2024, 1, d) for d in range(1, 10)]


def _found(spark, refs, parents, **k):
    return sorted((r["src"], r["target_id"], r["reason"]) for r in orphans.find_orphans(spark.createDataFrame(refs, REFS), spark.createDataFrame(parents, PARENTS), **k).collect())


@pytest.mark.parametrize("limit", [200_000, 0])
def test_reasons(spark, monkeypatch, limit):
    """Both ways of the exact join: with few parents, and salted."""
    monkeypatch.setattr(orphans, "broadcast_if_small", (lambda df: df) if not limit else orphans.broadcast_if_small)
    parents = [(1, DAY[0], None, 0), (2, DAY[0], DAY[2], 0), (2, DAY[5], None, 0), (3, DAY[6], None, 0), (1, DAY[0], None, 0), (None, DAY[0], None, 0), (4, None, None, 0)]
    refs = [("a", 1, DAY[3], "x", None), ("a", 1, DAY[3], "x", None), ("b", 2, DAY[3], None, "y"), ("c", 2, DAY[5], None, None), ("d", 3, DAY[3], None, None), ("e", 9, DAY[3], None, None), ("e", 9, DAY[3], None, None), ("f", 0, DAY[3], None, None), ("g", None, DAY[3], None, None), ("h", 1, None, None, None), ("i", 4, DAY[3], None, None), ("j", 1, DAY[0], None, None)]
    assert _found(spark, refs, parents) == [("b", 2, "deleted"), ("d", 3, "late"), ("e", 9, "missing"), ("h", 1, "late"), ("i", 4, "late")]


def test_empty_tables(spark):
    assert _found(spark, [], [(1, DAY[0], None, 0)]) == []
    assert _found(spark, [("a", 1, DAY[0], None, None)], []) == [("a", 1, "missing")]


def test_a_filter_that_is_too_small_changes_nothing(spark):
    parents = [(i, DAY[0], None, 0) for i in range(300)]
    refs = [(str(i), i, DAY[1], None, None) for i in range(0, 600, 7)]
    assert _found(spark, refs, parents, expected=10) == _found(spark, refs, parents)
