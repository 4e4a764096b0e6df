"""Every registered report against its checking SQL, on the supplied tables."""

import pytest

import __spark_entry__ as entry
from checking_sql import ORACLES
from compare import connect, difference, duck_rows, spark_rows
from registered import QUERIES
from servertide.sources.derived import VIEWS, view, with_views


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    result = spark_rows(entry.queries()[name](spark, sf_dir))
    assert result[1], "no rows to compare"
    assert difference(result, duck_rows(duck, ORACLES[name])) is None


@pytest.mark.parametrize("name", sorted(VIEWS))
def test_view(spark, sf_dir, duck, name):
    assert difference(spark_rows(view(spark, sf_dir, name)), duck_rows(duck, with_views([name], f"SELECT * FROM {name}"))) is None


def test_every_report_has_checking_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
