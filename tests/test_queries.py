"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from compare import check

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, name):
    line = check(spark, SF, name)
    assert line.startswith("rows" if name not in entry.oracle_sql() else "ok"), line


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert "value" in df.columns
