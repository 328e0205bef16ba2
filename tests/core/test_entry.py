import __spark_entry__


def test_every_sql_has_a_query():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) >= 40


def test_entry_runs(spark):
    assert __spark_entry__.entry(spark).count() == 1
