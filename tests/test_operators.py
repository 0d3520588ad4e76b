"""Ranks, quantiles and joins against stock Spark, with a third of the rows on one key."""

from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tallywork.functions import parsing, scalars
from tallywork.operators import cleaning, cluster_metrics, stats
from tallywork.functions import parsing
from tallywork.operators import ranks as R
from tallywork.operators.skew import lookup_join
from tallywork.params import Params
from tallywork.sources.store import Store


@pytest.fixture
def store(spark):
    return Store(spark)


@pytest.fixture(scope="module")
def skewed(spark):
    """3,000 rows; a third share one value, some are unknown, groups are uneven."""
    i = F.col("id")
    value = F.when(i % 3 == 0, 7.5).when(i % 50 == 1, None).otherwise((i * 7919 % 1013).cast("double") / 4)
    return spark.range(3000).select(i.alias("id"), value.alias("x"),
                                    F.when(i % 5 < 4, "big").otherwise(F.concat(F.lit("g"), i % 7)).alias("g")).cache()


def test_ranks_match_windows(store, skewed):
    dist = R.distribution(store, "x", skewed, ["x"])
    wanted = {"rank": ("x", R.rank_of()), "pr": ("x", R.percent_rank_of()), "cd": ("x", R.cume_dist_of()),
              "down": ("x", R.cume_dist_desc_of())}
    got = R.ranked(skewed, "id", ["x"], dist, wanted)
    w, d = Window.orderBy("x"), Window.orderBy(F.desc("x"))
    known = skewed.where("x is not null")
    stock = known.select("id", F.rank().over(w).alias("rank"), F.percent_rank().over(w).alias("pr"),
                         F.cume_dist().over(w).alias("cd"), F.cume_dist().over(d).alias("down"))
    assert got.exceptAll(stock).isEmpty() and stock.exceptAll(got).isEmpty()


def test_row_numbers_match_window(store, skewed):
    table = store.save("rows", skewed)
    got = R.row_numbers(store, "numbers", table, [F.desc_nulls_last("x"), F.asc("id")], "n").select("id", "n")
    stock = skewed.select("id", F.row_number().over(Window.orderBy(F.desc_nulls_last("x"), "id")).alias("n"))
    assert got.exceptAll(stock).isEmpty()


def test_grouped_quantiles_match_percentile(store, skewed):
    dist = R.distribution(store, "xg", skewed, ["x"], by=["g"])
    got = {r.g: (r.a, r.b) for r in R.quantiles(dist, {"a": ("x", 0.5), "b": ("x", 0.9)}, ["g"]).collect()}
    stock = {r.g: (r.a, r.b) for r in skewed.groupBy("g").agg(F.percentile("x", F.lit(0.5)).alias("a"),
                                                              F.percentile("x", F.lit(0.9)).alias("b")).collect()}
    assert got.keys() == stock.keys()
    for g in got:
        assert got[g] == pytest.approx(stock[g])


@pytest.mark.parametrize("down", [False, True])
def test_tiles_match_ntile(store, skewed, down):
    dist = R.distribution(store, "xt", skewed, ["x"]).df
    got = R.tiles(dist, 7, descending=down).groupBy("tile").agg(F.sum("copies").alias("n"), F.sum(F.col("value") * F.col("copies")).alias("s"))
    order = F.desc("x") if down else F.asc("x")
    stock = skewed.where("x is not null").select("x", F.ntile(7).over(Window.orderBy(order)).alias("tile")) \
        .groupBy("tile").agg(F.count("*").alias("n"), F.sum("x").alias("s"))
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in stock.collect()}


def test_lookup_join_keeps_every_row(store, skewed):
    keys = store.save("keys", skewed.where("x is not null and x < 200").groupBy("x").agg(
        F.count("*").alias("n"), F.max("id").alias("top")))
    got = lookup_join(skewed, keys, ["x"], "n", F.col("id"))
    stock = skewed.join(keys.df.drop("n"), "x", "left").select("id", "x", "g", "top")
    assert got.select("id", "x", "g", "top").exceptAll(stock).isEmpty() and got.count() == 3000


def test_ranks_have_no_single_partition_window(spark, skewed):
    store = Store(spark)
    dist = R.distribution(store, "plan", skewed, ["x"])
    plan = R.ranked(skewed, "id", ["x"], dist, {"r": ("x", R.rank_of())})._jdf.queryExecution().toString()
    # The only ordered single task is the prefix sum over sort partitions.
    assert plan.count("Window [sum(_w") > 0
    assert "windowspecdefinition(x#" not in plan


def test_first_of_repeated_ids_is_kept(spark, store):
    """A third of the rows have a blank id and another third one shared id."""
    rows = spark.range(900).select(F.col("id").alias("src_row"), F.when(F.col("id") % 3 == 0, " ").when(
        F.col("id") % 3 == 1, "T7").otherwise(F.concat(F.lit("T1"), F.col("id"))).alias("transaction_id"))
    named = rows.withColumn("txn_id", F.trim("transaction_id"))
    got = cleaning.mark_repeats(store, named, rows)
    assert got.count() == 900
    repeats = got.where("is_repeat").agg(F.count("*").alias("n"), F.min("src_row").alias("first")).first()
    assert (repeats.n, repeats.first) == (299, 4)
    assert got.where("is_repeat and txn_id <> 'T7'").isEmpty()


def test_reject_rules_in_order(spark):
    """A zero amount in the sparse tail counts as tail."""
    import datetime as dt
    p = Params()
    rows = [(dt.date(2016, 9, 20), "0", "PARTIAL_COVERAGE_PERIOD"), (dt.date(2016, 9, 1), "0", "ZERO_AMOUNT"),
            (dt.date(2016, 9, 1), "1,000", "MISSING_OR_INVALID_AMOUNT"), (dt.date(2016, 9, 1), None, "MISSING_OR_INVALID_AMOUNT"),
            (dt.date(2016, 9, 1), "-1", "NEGATIVE_AMOUNT"), (dt.date(2016, 9, 1), "9" * 16, None),
            (dt.date(2016, 9, 1), "1" * 17, "AMOUNT_OUT_OF_RANGE"), (dt.date(2016, 9, 1), "1" * 20, "AMOUNT_OUT_OF_RANGE"),
            (dt.date(2016, 9, 1), "1" * 30, "AMOUNT_OUT_OF_RANGE"), (dt.date(2016, 9, 1), "-" + "1" * 20, "NEGATIVE_AMOUNT")]
    table = spark.createDataFrame([("T1", "C1", *r, False) for r in rows],
                                  "txn_id string, cust_id string, txn_date date, transaction_amount string, expected string, is_repeat boolean")
    typed = table.withColumn("amount", parsing.to_money(F.col("transaction_amount")))
    got = typed.select("expected", cleaning.first_failing(cleaning.rules(p)).alias("r")).collect()
    assert [g.r for g in got] == [g.expected for g in got]


def test_adjusted_rand_and_scatter(spark):
    rng = np.random.default_rng(5)
    points = [(f"C{i}", int(i % 3), float(rng.normal(i % 3 * 4, 1)), float(rng.normal(0, 1)), int((i + (i % 17 == 0)) % 3))
              for i in range(300)]
    df = spark.createDataFrame(points, "customer_id string, label int, a double, b double, other int")
    xs = np.array([p[2:4] for p in points])
    labels = np.array([p[1] for p in points])
    within = sum(((xs[labels == g] - xs[labels == g].mean(0)) ** 2).sum() for g in range(3))
    row = cluster_metrics.scatter(df, ["a", "b"]).first()
    assert row.inertia == pytest.approx(within, rel=1e-6)
    assert cluster_metrics.adjusted_rand(df, "label", "label").first()[0] == pytest.approx(1.0)
    assert 0.5 < cluster_metrics.adjusted_rand(df, "label", "other").first()[0] < 1
    dist = ((xs[:, None] - xs[None]) ** 2).sum(2)
    same = labels[:, None] == labels[None]
    own = np.where(same, dist, 0).sum(1) / (same.sum(1) - 1)
    other = np.min([np.where(labels == g, np.inf, dist[:, labels == g].mean(1)) for g in range(3)], axis=0)
    expected = float(((other - own) / np.maximum(own, other)).mean())
    got = cluster_metrics.silhouette(df, ["a", "b"]).agg(F.avg("silhouette")).first()[0]
    assert got == pytest.approx(expected, rel=1e-9)


def test_blank_ids_are_spread(spark, store):
    """Half the ids are blank, and the other half has one hot id: no join task gets over three times the mean."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        i = F.col("id")
        rows = spark.range(60_000).select(i.alias("src_row"), F.when(i % 2 == 0, "").when(i % 4 == 1, "T5").otherwise(
            F.concat(F.lit("T1"), i)).alias("transaction_id"))
        got = cleaning.mark_repeats(store, rows.withColumn("txn_id", F.trim("transaction_id")), rows)
        sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 60_000 and max(sizes) < 3 * sum(sizes) / len(sizes)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


@pytest.mark.parametrize("u, expected", [(50.0, 1.0), (80.0, 0.0257)])
def test_mann_whitney_p(spark, store, u, expected):
    """10 against 10 values: in the middle of U the probability is 1."""
    wins = int(u)
    first = [1.0 * k for k in range(1, 11)]
    rest = [0.5 + wins // 10] * 10
    df = spark.createDataFrame([(x, "a") for x in first] + [(y, "b") for y in rest], "x double, g string")
    p = stats.mann_whitney(store, f"p{wins}", df, "x", "g", "a", "b").first().p_value
    assert 0 <= p <= 1 and (p == 1.0 if expected == 1.0 else p < 0.05)


@pytest.mark.parametrize("text, expected", [("0.004", "0.004"), ("10.005", "10.005"), ("1e-3", "0.001"), ("12345678901234567890", "12345678901234567890"),
                                            ("123456789012345678901", None),
                                            (" 7 ", "7"), ("x", None)])
def test_money_is_read_as_written(spark, text, expected):
    got = spark.createDataFrame([(text,)], "t string").select(parsing.to_money(F.col("t"))).first()[0]
    assert got == (None if expected is None else Decimal(expected))


def test_latest_row_does_not_depend_on_the_id_size(spark):
    rows = spark.createDataFrame([("2020-01-01", 100, 30_000_000, "T30000000", 1.0), ("2020-01-01", 102, 5, "T5", 2.0),
                                  ("2020-01-01", 102, None, "TX-9", 3.0)], "d string, s int, q bigint, i string, v double")
    at = scalars.latest_first(F.to_date("d"), F.col("s"), F.col("q"), F.col("i"))
    assert rows.agg(F.max_by("v", at)).first()[0] == 2.0
    assert rows.where("q is null or q > 5").agg(F.max_by("v", at)).first()[0] == 3.0


@pytest.mark.parametrize("x, dof, expected", [(3.841458821, 1, 0.05), (18.30703805, 10, 0.05), (0.5, 3, 0.918891411), (60.0, 2, 9.3576e-14)])
def test_chi_square_tail(spark, x, dof, expected):
    df = spark.createDataFrame([(x, float(dof))], "x double, d double")
    assert df.select(stats.chi_square_p(F.col("x"), F.col("d"))).first()[0] == pytest.approx(expected, rel=1e-4)
