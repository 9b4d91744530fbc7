"""Driver contract: entry() on sf0.001, and every SQL key is a registered query."""

import __spark_entry__ as E


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() >= 0
    assert {"session_id", "intent", "action", "reason"} <= set(df.columns)


def test_sql_keys_registered():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(E.queries()) >= 60
