"""A few registered queries beside their SQL; the whole set runs in check_queries.py."""

import pytest

import __spark_entry__ as entry
from check_queries import compare, connect


@pytest.mark.parametrize("name", ["src1_tape_scan", "jn6_last_quote_asof", "agg1_activity", "win2_forward_measures", "flagship_flow_and_variance"])
def test_query_equals_sql(spark, name):
    status, rows, _, note = compare(spark, connect("0.001"), name, entry.queries()[name], entry.oracle_sql()[name], "0.001")
    assert status == "ok" and rows > 0, note


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
