import pytest

from overscribe import plans

from .oracle import by_sql, rows


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_same_rows_as_sql(spark, data, name):
    got, want = plans.REGISTRY[name](spark, data).toPandas(), by_sql(data, plans.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(plans.REGISTRY) - set(plans.SQL)))
def test_without_sql_gives_rows(spark, data, name):
    assert plans.REGISTRY[name](spark, data).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 40
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
