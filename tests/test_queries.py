"""Every query with an oracle agrees with DuckDB; every query runs."""

import re

import pytest

import __spark_entry__ as entry
from check_queries import compare, connect

SF = "/root/testdata/sf0.001"
ORACLES = entry.oracle_sql()
#: The text operators have tests of their own beside them.
OWN_TESTS = {n for n in entry.queries() if re.match(r"op\d+_|pipeline$", n)}


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(set(ORACLES) - OWN_TESTS))
def test_matches_oracle(spark, duck, name):
    assert compare(entry.queries()[name](spark, SF), duck, ORACLES[name]).startswith("ok")


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(ORACLES) - OWN_TESTS))
def test_rows_only(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 3
