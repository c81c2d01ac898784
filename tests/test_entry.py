import __spark_entry__ as entry


def test_registry():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 150


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.limit(1).count() == 1 and "score" in df.columns
