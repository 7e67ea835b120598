"""Every query with SQL against that SQL on the smallest tables; the others give rows."""

import pytest

from siltstone.plans import catalogue

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, same, name):
    df = catalogue.QUERIES[name](spark, DIR)
    if name in catalogue.SQL:
        same(df, duck.sql(catalogue.SQL[name]))
    else:  # tested by what they give in test_scale
        assert df.count() > 0


def test_all_links_have_freeable_bytes(spark):
    got = catalogue.QUERIES["link_freeable_all"](spark, DIR)
    assert got.count() == spark.read.parquet(f"{DIR}/documents.parquet").count()
    kinds = {r["path"].rpartition(".")[2] for r in got.filter("freeable_bytes > 0").collect()}
    assert {"tmp", "zip", "exe", "log"} <= kinds


@pytest.mark.parametrize("name", sorted(n for n in catalogue.QUERIES if n.startswith("det_")))
def test_detectors_find_something(spark, name):
    assert not catalogue.QUERIES[name](spark, DIR).isEmpty()


def test_sql_has_queries():
    assert set(catalogue.SQL) <= set(catalogue.QUERIES)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
