import __spark_entry__ as entry


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.columns[:3] == ["px", "py", "fold_key"] and df.count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
