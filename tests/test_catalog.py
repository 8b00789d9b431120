import __spark_entry__ as entry
from spanloom.plans import catalog


def test_every_query_has_its_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)
    assert set(entry.oracle_sql()) <= set(entry.queries()) >= set(catalog.QUERIES)


def test_sql_reads_whole_tables():
    for name, sql in entry.oracle_sql().items():
        assert "TABLESAMPLE" not in sql.upper(), name
