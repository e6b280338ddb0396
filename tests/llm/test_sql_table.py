"""The SQL table holds SQL."""

from __future__ import annotations

from gleaner.llm.queries import SQL


def test_sql_of_every_query_is_text():
    import __spark_entry__ as entry

    assert SQL and all(isinstance(v, str) for v in SQL.values())
    assert all(isinstance(v, str) for v in entry.oracle_sql().values())
