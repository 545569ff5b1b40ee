import __spark_entry__ as entry


def test_contract(spark):
    found = entry.queries()
    assert set(entry.oracle_sql()) <= set(found)
    assert entry.entry(spark).limit(1).count() == 1
