"""Customer stages lie in hash buckets: joins and aggregates by customer read them without an exchange."""

import pytest
from pyspark.sql import functions as F

from tallywork.operators import publish
from tallywork.plans import catalog
from tallywork.sources.store import Store


def exchanges(df) -> list[str]:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange" in line]


@pytest.fixture
def shuffled_joins(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_joins_of_customer_stages_have_no_exchange(spark, shuffled_joins):
    w = catalog.workspace(spark, "/root/testdata/sf0.001")
    assert exchanges(publish.customer_view(w.customer_360, w.customer_segment, w.opportunity)) == []
    assert exchanges(w.base.df.join(w.dim_customer.select("customer_id", "dob"), "customer_id")) == []
    assert exchanges(w.view.groupBy("customer_id").agg(F.sum("total_txn_value"))) == []
    assert w.view.count() == w.customer_360.count() == w.base.rows == w.dim_customer.count()


def test_the_write_is_the_only_exchange_of_a_grouped_table(spark):
    store = Store(spark)
    rows = store.save("rows", spark.range(5000).select((F.col("id") % 700).cast("string").alias("key"), "id")).df
    sums = rows.groupBy("key").agg(F.sum("id").alias("total"))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert len(exchanges(sums.repartition(buckets, "key"))) == 1
    made = store.save_by("key", "sums", sums)
    assert made.rows == 700 and made.df.exceptAll(sums).isEmpty() and sums.exceptAll(made.df).isEmpty()
    store.close()


def test_an_empty_table_and_null_keys_can_be_stored_by_key(spark):
    store = Store(spark)
    none = store.save_by("key", "none", spark.createDataFrame([], "key string, n int"))
    assert none.rows == 0 and none.df.isEmpty()
    some = store.save_by("key", "some", spark.createDataFrame([(None, 1), (None, 2), ("", 3)], "key string, n int"))
    assert some.rows == 3 and sorted((r.key is None, r.n) for r in some.df.collect()) == [(False, 3), (True, 1), (True, 2)]
    tables = [t.name for t in spark.catalog.listTables()]
    store.close()
    assert len(tables) - len(spark.catalog.listTables()) == 2
