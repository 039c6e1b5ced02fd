"""Every registered query next to its SQL, and the entry points."""

import pytest
from compare import differences, duck

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_matches_sql(spark, con, name):
    assert differences(spark, con, FOLDER, name) is None


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["pool", "team", "elo", "matches"]
    assert df.count() > 0


def test_every_check_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
