import __spark_entry__ as entry
from tabveil import oracles, queries


def test_every_table_query_has_an_oracle():
    assert set(queries.QUERIES) == set(oracles.ORACLES)
    assert set(queries.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 6 and all(r["n_failures"] == 0 for r in rows)
