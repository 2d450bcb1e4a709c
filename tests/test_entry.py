"""The driver's contract."""

import __spark_entry__ as entry


def test_entry_gives_rows(spark):
    df = entry.entry(spark)
    assert df.columns == ["class", "ap"] and df.count() > 0


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 100
