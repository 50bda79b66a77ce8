import __spark_entry__ as entry


def test_contract():
    q, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(q) and all(callable(f) for f in q.values())


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns[:2] == ["incident_id", "service_id"] and df.count() >= 0
