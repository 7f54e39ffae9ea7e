"""Every query with SQL gives the rows of its SQL; the others give rows."""

import pytest

import __spark_entry__
from tests.oracle import same_rows
from tidemark.plans import catalog as registry

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    got, want = same_rows(spark, registry.QUERIES[name], registry.ORACLE_SQL[name], SF)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_gives_rows(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    got = __spark_entry__.entry(spark)
    assert got.columns == ["hour_utc", "n", "k", "wilson_lo"] and got.count() == registry.QUERIES["hourly_direction_report"](spark, "/root/testdata/sf0.001").count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
