import __spark_entry__ as entry


def test_flagship_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 80
