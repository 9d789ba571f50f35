import __spark_entry__ as entry

from plumbline.plans import catalogue


def test_queries_and_sql():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(catalogue.QUERIES) <= set(queries) and set(sql) <= set(queries)
    assert bool(entry.corpus) == ("pipeline" in queries)


def test_entry(spark):
    assert entry.entry(spark).count() == 4
