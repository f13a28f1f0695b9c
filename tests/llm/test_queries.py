import pytest

from tests.compare import assert_same, connect
from textloom.llm import queries, sql

BASE = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(BASE)


@pytest.mark.parametrize("name", sorted(sql.oracle_sql()))
def test_query_agrees_with_sql(spark, con, name):
    assert_same(spark, con, BASE, queries.queries()[name], sql.oracle_sql()[name])


COLUMNS = {
    "p1_found": "field string, term string, mark string",
    "p3_found": "input_id bigint, start_char int, end_char int",
    "p4_found": "src string, input_id bigint, place int, pii_type string",
    "p5_found": "src string, input_id bigint, seq int",
    "p7_found": "doc_id bigint, item_id bigint",
    "p8_found": "doc_id bigint, kind string",
}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_runs_and_returns_no_row_twice(spark, name):
    df = queries.queries()[name](spark, BASE)
    if name in COLUMNS:
        assert ", ".join(f"{c} {t}" for c, t in df.dtypes) == COLUMNS[name]
    rows = [tuple(map(str, r)) for r in df.collect()]
    assert rows and len(rows) == len(set(rows))
