"""Steps that every report shares: what they shuffle, sort and send, beside plain results."""

import random
from datetime import date
from decimal import Decimal

from pyspark.sql import functions as F

from tallywork.operators import cleaning, features, model, publish
from tallywork.operators import ranks as R
from tallywork.params import Params
from tallywork.sources import staging
from tallywork.sources.store import Store

PLAIN = Params()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_variants_join_without_dealing_rows_by_city(spark):
    """The rows stay where they are: before, all rows of a city met in one task."""
    log = spark.range(40).select(F.col("id").alias("src_row"), *[F.lit(v).alias(k) for k, v in zip(staging.RAW_COLUMNS, (
        "T1", "C1", "1/2/70", "F", "Old Town", "5", "3/8/16", "101010", "7.5"))]).withColumns({
            "transaction_id": F.expr("concat('T', src_row)"), "cust_location": F.expr("if(src_row % 2 = 0, 'Old Town', 'old  town')")})
    rows = cleaning.typed(log, PLAIN).withColumn("reject_reason", F.lit(None).cast("string"))
    clean = cleaning.clean(rows, staging.variants_table(spark, [("OLD TOWN", "NEW TOWN")]), PLAIN)
    assert "hashpartitioning(location_norm" not in plan_of(clean) and "BroadcastHashJoin" in plan_of(clean)
    assert {r.clean_city for r in clean.collect()} == {"NEW TOWN"} and clean.count() == 40


def fact_rows(spark):
    """Customers with several rows a day, unknown balances and equal times."""
    rng, rows = random.Random(4), []
    for i in range(400):
        balance = None if rng.random() < 0.3 else Decimal(rng.randrange(500)) / 4
        rows.append((f"T{i}", i % 7, f"C{rng.randrange(12) if i % 2 else 0}", date(2016, 8, 1 + rng.randrange(9)), rng.choice([None, 36000, 80000]),
                     Decimal(rng.randrange(1, 900)) / 2, balance, rng.choice([None, 3, 10, 22]), rng.random() < 0.2,
                     rng.choice([None, date(1970, 1, 1), date(1980, 2, 2)]), rng.choice(["F", "M", "Unknown"]), rng.choice(["A", "B", "UNKNOWN"])))
    shape = ("transaction_id string, txn_seq bigint, customer_id string, txn_date date, txn_sec int, amount decimal(18,2), balance decimal(18,2), "
             "txn_hour int, is_high_value_txn boolean, dob date, gender string, clean_city string")
    return spark.createDataFrame(rows, shape).repartition(5), [dict(zip([c.split()[0] for c in shape.split(", ")], r)) for r in rows]


def moment(r):
    return r["txn_date"], r["txn_sec"] or 0, r["txn_seq"], r["transaction_id"]


def test_customer_aggregates_in_one_wide_shuffle(spark):
    df, rows = fact_rows(spark)
    made = features.base(df, PLAIN)
    wide = [line for line in plan_of(made).splitlines() if "Aggregate(key=[customer_id" in line and "txn_date" in line.split("functions")[0] and "sum" in line]
    assert not wide  # before, every sum was made per customer and day first, and dealt twice
    got = {r.customer_id: r for r in made.collect()}
    for one in {r["customer_id"] for r in rows}:
        own, g = [r for r in rows if r["customer_id"] == one], got[one]
        known = [r for r in own if r["balance"] is not None]
        assert (g.txn_count, g.total_txn_value, g.active_days) == (len(own), sum(r["amount"] for r in own), len({r["txn_date"] for r in own}))
        assert (g.balance_obs, g.bal_sum, g.bal_sq) == (len(known), sum(r["balance"] for r in known), sum(r["balance"] ** 2 for r in known))
        assert g.latest_balance == max(known, key=moment)["balance"] and g.high_value_txn_count == sum(r["is_high_value_txn"] for r in own)
        assert g.txns_first_half + g.txns_second_half == len(own) and g.first_txn_date == min(r["txn_date"] for r in own)


def test_attributes_sort_each_row_once(spark):
    df, rows = fact_rows(spark)
    made = model.resolved_attributes(df)
    text = plan_of(made)
    assert text.index("Generate") < text.rindex("Aggregate")  # rows are combined below the step that makes three of each
    got = {r.customer_id: r for r in made.collect()}
    for one in {r["customer_id"] for r in rows}:
        for a, missing in (("dob", None), ("gender", "Unknown"), ("clean_city", "UNKNOWN")):
            values = {}
            for r in rows:
                if r["customer_id"] == one and r[a] != missing:
                    n, last = values.get(r[a], (0, ("",)))
                    values[r[a]] = (n + 1, max(last, moment(r)) if n else moment(r))
            best = max(values, key=values.get) if values else None
            assert (got[one][a], got[one][f"{a}_values"]) == (None if best is None else str(best), len(values))


def test_customer_joins_send_no_table_to_the_driver(spark):
    one = lambda *names: spark.range(50).select(F.col("id").cast("string").alias("customer_id"), *[F.lit(1).alias(n) for n in names])
    joined = publish.customer_view(one("txn_count", "evidence_level"), one("cluster_key", "segment_id", "segment_name", "layer"), one("evidence_level", "tier"))
    assert "Broadcast" not in plan_of(joined) and joined.count() == 50


def test_few_values_are_placed_by_many_tasks(spark, tmp_path):
    """Positions of a small distribution come from as many ranges as a shuffle has partitions; before, from one."""
    store = Store(spark, str(tmp_path))
    placed = R._placed(store, "few", spark.range(5000).select((F.col("id") * 7 % 5000).alias("v")).repartition(4), [F.col("v")])
    assert placed.select("_part").distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    dist = R.distribution(store, "few", spark.range(5000).select((F.col("id") % 1000).alias("v")), ["v"]).df
    assert all((r.first, r.last, r.total) == (5 * r.value + 1, 5 * r.value + 5, 5000) for r in dist.collect()) and dist.count() == 1000
    numbers = R.row_numbers(store, "rows", store.save("r", spark.range(3000)), [F.desc("id")], "no")
    assert all(r.no == 3000 - r.id for r in numbers.collect())
