"""Every registered query against its SQL on the smallest tables."""

import re

import pytest

import __spark_entry__ as entry
from oracle_check import connect, differences

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def database():
    return connect(SF)


def test_every_query_has_an_oracle():
    """But those of the optional subpackage that SQL cannot express."""
    bare = set(entry.queries()) - set(entry.oracle_sql())
    assert not [name for name in bare if not re.match(r"op\d+_|pipeline$", name)]
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", list(entry.oracle_sql()))
def test_same_rows(spark, database, name):
    assert differences(spark, database, name, SF) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0
