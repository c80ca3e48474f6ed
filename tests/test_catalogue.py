import pytest
from compare import rows_in_duckdb, rows_of

from duskline.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_its_sql(spark, sf_dir, name):
    assert rows_of(catalogue.QUERIES[name](spark, sf_dir)) == rows_in_duckdb(catalogue.ORACLES[name], sf_dir)


def test_every_other_query_runs(spark, sf_dir):
    for name in set(catalogue.QUERIES) - set(catalogue.ORACLES):
        assert catalogue.QUERIES[name](spark, sf_dir).count() > 0, name


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["venue", "n"]
