"""Every registered query against its SQL on the small tables."""

import pytest

import __spark_entry__ as entry
from compare import check, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, con, name):
    error, _ = check(spark, con, entry.queries()[name], entry.oracle_sql().get(name), SF)
    assert error is None


def test_entry(spark):
    assert entry.entry(spark).columns == [
        "file_id", "id_incoming", "nik_master", "match_score", "missing_count", "match_result"
    ]
