import __spark_entry__ as entry


def test_contract(spark):
    assert entry.entry(spark).columns == ["key", "version", "value"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
