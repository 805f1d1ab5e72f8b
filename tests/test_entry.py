import __spark_entry__
from sediment.plans import catalog


def test_every_query_of_the_library_is_registered_with_its_sql():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(catalog.QUERIES) <= set(queries) and set(sql) <= set(queries) and set(catalog.ORACLE) <= set(sql)


def test_entry_runs(spark):
    import os

    if os.path.isdir("/root/testdata/sf0.001"):
        found = __spark_entry__.entry(spark)
        assert found.count() > 0 and found.columns == ["lang", "files", "raw_bytes", "unique_bytes", "deduplicated_bytes"]
