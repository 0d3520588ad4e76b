"""Exploratory statistics on the customer table; order statistics come from value positions."""

from __future__ import annotations

import math
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources.store import Store
from . import ranks as R
from .skew import lookup_join

DESCRIBE = (0.25, 0.5, 0.75, 0.9, 0.95, 0.99)
CORRELATED = ("txn_count", "total_txn_value", "avg_txn_value", "max_txn_value", "active_days", "recency_days",
              "avg_balance", "latest_balance", "txn_to_balance_ratio", "age", "engagement_score", "value_score")
NULLABLE = ("avg_balance", "latest_balance", "txn_to_balance_ratio", "age")


def describe(store: Store, name: str, df: DataFrame, column: str, by: list[str] | None = None,
             points=DESCRIBE) -> DataFrame:
    """Count, mean, deviation, extremes and exact percentiles, overall or per group."""
    by = by or []
    value = F.col(column)
    exact = value.cast("decimal(28,6)")
    mean = S.mean_of(value)
    sums = df.where(value.isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), S.fixed(mean, 2).alias("mean"), F.min(value).cast("double").alias("min"),
        F.max(value).cast("double").alias("max"),
        (F.sum((exact * exact).cast("decimal(38,8)")).cast("double")).alias("_q"),
        F.sum(exact).cast("double").alias("_s"))
    n = F.col("n")
    sums = sums.withColumn("std", S.fixed(F.sqrt(S.ratio(F.col("_q") - F.col("_s") * F.col("_s") / n, n - 1)), 2))
    spread = R.distribution(store, f"describe_{name}", df, [column], by=by)
    marks = {f"p{round(q * 100)}": (column, q) for q in points}
    cuts = R.quantiles(spread, marks, by)
    cuts = cuts.select(*by, *[S.fixed(F.col(m), 2).alias(m) for m in marks])
    if by:
        return sums.join(cuts, by, "left").drop("_q", "_s")
    row = cuts.select(F.struct(*marks)).scalar()  # one subquery, reused for every mark
    return sums.withColumns({m: row[m] for m in marks}).drop("_q", "_s")


def log_histogram(df: DataFrame, column: str, bins: int, top: Column) -> DataFrame:
    """Counts in bins of equal width in log10 between 1 and the largest value; smaller values are left out."""
    value = F.col(column).cast("double")
    width = F.log10(top) / bins
    place = F.least(F.floor(F.log10(value) / width), F.lit(bins - 1)).cast("int")
    return df.where(value >= 1).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def spread_histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Counts in bins of equal width in log10(1 + value) between the smallest and the largest value; unknown values are left
    out. One bin holds all when every value is the same."""
    place = F.log10(F.col(column).cast("double") + 1)
    logs = df.where(F.col(column).isNotNull()).select(place.alias("x"))
    ends = logs.agg(F.min("x").alias("low"), F.max("x").alias("high")).select(F.struct("low", "high")).scalar()
    at = F.floor((F.col("x") - ends["low"]) * bins / F.nullif(ends["high"] - ends["low"], F.lit(0.0)))
    return logs.groupBy(F.least(F.coalesce(at, F.lit(0)), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def hour_profile(fact: DataFrame) -> DataFrame:
    """Mean rows per weekday and hour, over the days on which that weekday has rows in that hour."""
    per_day = fact.groupBy("day_of_week", "txn_hour", "txn_date").agg(F.count(F.lit(1)).alias("n"))
    return per_day.groupBy("day_of_week", "txn_hour").agg(S.ratio(F.sum("n"), F.count(F.lit(1))).alias("txns_per_day"))


def score_histogram(df: DataFrame, column: str, by: str, bins: int, low: float = 0, high: float = 100) -> DataFrame:
    """Counts per group in bins of equal width."""
    place = F.width_bucket(F.col(column), F.lit(float(low)), F.lit(float(high)), F.lit(bins)).cast("int")
    return df.groupBy(by, place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def concentration(dist: DataFrame, measure: str, shares=(0.01, 0.05, 0.10, 0.20, 0.50)) -> DataFrame:
    """Share of the total held by the largest x % of rows, and the Gini coefficient."""
    rows = dist.where(F.col("measure") == measure)
    tops = {f"top_{round(100 * s)}_pct": S.fixed(100 * R.top_share(rows, s), 2, 10) for s in shares}
    return rows.agg(*[v.alias(k) for k, v in tops.items()], gini().alias("gini"))


def gini() -> Column:
    """1 - 2 * the trapezoid area of cumulative shares with step 1/n, without the origin. The sum of running totals is
    the sum of value x (rows at or above it), so no running total is needed."""
    value, n, total = F.col("value").cast("decimal(38,2)"), F.col("n"), F.max("total")
    # positions first..last each weigh (total - position + 1); their sum over the copies is exact as a half-integer.
    weight = n.cast("decimal(19,0)") * (2 * F.col("total") + 2 - F.col("first") - F.col("last")).cast("decimal(19,0)")
    cumulated = F.sum(value * weight).cast("double") / 2
    whole, least = F.sum(value * n).cast("double"), F.min("value")
    area = (cumulated - (least + whole) / 2) / whole / total
    return S.fixed(1 - 2 * area, 4, 10)


def lorenz(store: Store, dist: DataFrame, measure: str, points: int = 100) -> DataFrame:
    """Cumulative value share at each 1/points of the rows, largest first."""
    rows = dist.where(F.col("measure") == measure)
    tiles = R.tiles(rows, points, descending=True)
    sums = tiles.groupBy("tile").agg(F.sum(F.col("value").cast("decimal(38,2)") * F.col("copies")).alias("v"),
                                     F.sum("copies").alias("n"))
    upto = Window.orderBy("tile").rowsBetween(Window.unboundedPreceding, 0)  # at most ``points`` rows
    whole = Window.partitionBy()
    return sums.select("tile", S.percent(F.sum("n").over(upto), F.sum("n").over(whole), 4).alias("pct_rows"),
                       S.percent(F.sum("v").over(upto), F.sum("v").over(whole), 4).alias("pct_value"))


def spearman_matrix(store: Store, name: str, df: DataFrame, key: str, features=CORRELATED,
                    nullable=NULLABLE) -> DataFrame:
    """Rank correlation of every pair over the rows where both are known. A rank depends on which rows are kept, that
    is on the nullable columns of the pair: beside its own column, a value needs at most one other to be known. So each value
    has a rank among all rows and one for each nullable column, and a row is tall once per column only."""
    c = F.col
    needed = [x for x in nullable if x in features]
    known = {f"with_{x}": c(x).isNotNull() for x in needed}
    wide = df.select(key, *[c(f).cast("double").alias(f) for f in features])
    places = R.subset_mids(store, f"spearman_{name}", wide, list(features), known)
    tall = wide.select(key, F.inline(S.pair_columns(list(features)))).where(c("value").isNotNull())
    ranks = ["mid_all", *[f"mid_{k}" for k in known]]
    marks = lookup_join(tall, places, ["measure", "value"], "n", c(key)).select(key, "measure", *ranks).repartition(key)

    rank_with = lambda other: f"mid_with_{other}" if other in needed else "mid_all"
    pairs = list(combinations(features, 2))
    used = sorted({(f, rank_with(other)) for a, b in pairs for f, other in ((a, b), (b, a))})
    # The rows lie by their key already, narrow, so the wide ones are made where they are read.
    rows = marks.groupBy(key).agg(*[F.max(F.when(c("measure") == f, c(m))).cast("decimal(19,0)").alias(f"{f}__{m}") for f, m in used])
    # Its pairs are summed map-side, so one partial row per pair leaves a task.
    lines = F.array(*[F.struct(F.lit(i).alias("pair"), c(f"{a}__{rank_with(b)}").alias("u"), c(f"{b}__{rank_with(a)}").alias("v"))
                      for i, (a, b) in enumerate(pairs)])
    lined = rows.select(F.inline(lines))
    u, v, d = c("u"), c("v"), lambda z: z.cast("double")
    sums = lined.where(u.isNotNull() & v.isNotNull()).groupBy("pair").agg(
        d(F.count(u)).alias("n"), d(F.sum(u)).alias("su"), d(F.sum(v)).alias("sv"), d(F.sum(u * v)).alias("suv"),
        d(F.sum(u * u)).alias("suu"), d(F.sum(v * v)).alias("svv"))
    n, su, sv = c("n"), c("su"), c("sv")
    rho = S.ratio(n * c("suv") - su * sv, F.sqrt(n * c("suu") - su * su) * F.sqrt(n * c("svv") - sv * sv))
    names = F.array(*[F.array(F.lit(a), F.lit(b)) for a, b in pairs])
    pair = F.element_at(names, c("pair") + 1)
    return sums.select(pair[0].alias("feature_a"), pair[1].alias("feature_b"), n.cast("bigint").alias("n"),
                       S.fixed(rho, 4, 10).alias("rho"))


def chi_square_p(statistic: Column, dof: Column) -> Column:
    """Upper tail of chi-square, for the few result rows of a test."""

    def tail(a: float, x: float) -> float:
        """Regularised upper incomplete gamma: a series below a + 1, a continued fraction above."""
        if not x > 0:
            return 1.0
        front = math.exp(a * math.log(x) - x - math.lgamma(a))
        if x < a + 1:
            term = total = 1 / a
            k = a
            while abs(term) > abs(total) * 1e-16:
                k += 1
                term *= x / k
                total += term
            return 1 - front * total
        # Evaluated from the inside out, at a depth that is ample for x >= a + 1.
        tail_part = 0.0
        for i in range(2000, 0, -1):
            tail_part = i * (a - i) / (x + 2 * i + 1 - a + tail_part)
        return front / (x + 1 - a + tail_part)

    def column(x: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([tail(float(d) / 2, float(v) / 2) for v, d in zip(x, k)], dtype=float)

    return F.pandas_udf(column, "double")(statistic, dof)


def normal_two_sided_p(z: Column) -> Column:
    def column(x: pd.Series) -> pd.Series:
        return pd.Series([min(1.0, math.erfc(v / math.sqrt(2))) for v in x], dtype=float)

    return F.pandas_udf(column, "double")(z)


def _rank_sum(copies: str) -> Column:
    """Sum of mid-ranks over the copies of each value; decimals, since a product of two counts can pass a long."""
    twice = (F.col("first") + F.col("last")).cast("decimal(19,0)")
    return F.sum(F.col(copies).cast("decimal(19,0)") * twice).cast("double") / 2


def _tie_term() -> Column:
    n = F.col("n").cast("decimal(13,0)")
    return F.sum((n * n * n - n).cast("decimal(38,0)")).cast("double")


def mann_whitney(store: Store, name: str, df: DataFrame, column: str, group: str, first: str, second: str) -> DataFrame:
    """U of the first group against the second, tie-corrected normal p, and rank-biserial r."""
    kept = df.where(F.col(group).isin(first, second))
    dist = R.distribution(store, f"mw_{name}", kept, [column], counts={"n1": F.col(group) == first}).df
    rank_sum = _rank_sum("n1")
    one = dist.agg(rank_sum.alias("r1"), F.sum("n1").cast("double").alias("n1"), F.sum("n").cast("double").alias("n"),
                   _tie_term().alias("ties"))
    n1, n = F.col("n1"), F.col("n")
    n2 = n - n1
    u = F.col("r1") - n1 * (n1 + 1) / 2
    spread = F.sqrt(n1 * n2 / 12 * (n + 1 - F.col("ties") / (n * (n - 1))))
    z = (F.abs(u - n1 * n2 / 2) - 0.5) / spread
    return one.select(u.alias("u"), n1.cast("bigint").alias("n1"), n2.cast("bigint").alias("n2"),
                      S.fixed(1 - 2 * u / (n1 * n2), 6, 10).alias("rank_biserial"), S.fixed(z, 4, 10).alias("z"),
                      S.fixed(normal_two_sided_p(z), 6, 10).alias("p_value"))


def kruskal(store: Store, name: str, df: DataFrame, columns: list[str], group: str, groups) -> DataFrame:
    """Tie-corrected H and epsilon squared per column; the group list is given and short."""
    marks = {f"g{i}": F.col(group) == g for i, g in enumerate(groups)}
    kept = df.where(F.col(group).isin(*groups))
    dist = R.distribution(store, f"kw_{name}", kept, columns, counts=marks).df
    sums = []
    for m in marks:
        rank_sum, size = _rank_sum(m), F.sum(m).cast("double")
        sums.append(F.coalesce(S.ratio(rank_sum * rank_sum, size), F.lit(0.0)))
    present = sum((F.when(F.sum(m) > 0, 1).otherwise(0) for m in marks), F.lit(0))
    total = sum(sums, F.lit(0.0))
    one = dist.groupBy(F.col("measure").alias("feature")).agg(
        F.sum("n").cast("double").alias("n"), present.alias("k"), total.alias("parts"), _tie_term().alias("ties"))
    n, k = F.col("n"), F.col("k")
    h = (12 / (n * (n + 1)) * F.col("parts") - 3 * (n + 1)) / (1 - F.col("ties") / (n * n * n - n))
    return one.select("feature", n.cast("bigint").alias("n"), k.alias("groups"), S.fixed(h, 4).alias("h"),
                      S.fixed((h - k + 1) / (n - k), 6, 10).alias("epsilon_sq"),
                      S.fixed(chi_square_p(h, (k - 1).cast("double")), 6, 10).alias("p_value"))


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """Independence test on the contingency counts, with Cramer's V. Counting leaves a small table."""
    c = F.col
    cells = df.groupBy(a, b).agg(F.count(F.lit(1)).cast("double").alias("o"))
    # The sum of o^2/e over the present cells, less n, is the whole statistic: an absent cell adds nothing to it.
    rows, cols, whole = Window.partitionBy(a), Window.partitionBy(b), Window.partitionBy()
    marked = cells.select(a, b, "o", F.sum("o").over(rows).alias("r"), F.sum("o").over(cols).alias("k"),
                          F.sum("o").over(whole).alias("all"))
    one = marked.agg(F.sum(c("o") * c("o") / (c("r") * c("k"))).alias("s"), F.sum("o").alias("n"),
                     F.max(F.abs(c("o") - c("r") * c("k") / c("all"))).alias("gap"),
                     F.count_distinct(a).alias("rows"), F.count_distinct(b).alias("cols"))
    plain = c("n") * (c("s") - 1)
    dof = (c("rows") - 1) * (c("cols") - 1)
    # With one degree of freedom every cell is off by the same gap, which the continuity correction shortens by 1/2.
    kept = S.ratio(c("gap") - F.least(c("gap"), F.lit(0.5)), c("gap"))
    chi2 = F.when(dof == 1, plain * F.coalesce(kept * kept, F.lit(0.0))).otherwise(plain)
    small = F.least("rows", "cols") - 1
    return one.select(S.fixed(chi2, 4).alias("chi2"), dof.alias("dof"), c("n").cast("bigint").alias("n"),
                      S.fixed(F.sqrt(chi2 / (c("n") * small)), 6, 10).alias("cramers_v"),
                      S.fixed(chi_square_p(chi2, dof.cast("double")), 6, 10).alias("p_value"))


def moving_mean(daily: DataFrame, columns: list[str], half: int = 3) -> DataFrame:
    """Centred mean over 2 x half + 1 days, NULL at the ends. One row per day, so a single ordered window is small."""
    around = Window.orderBy("date").rowsBetween(-half, half)
    full = F.count(F.lit(1)).over(around) == 2 * half + 1
    return daily.select("date", *columns, *[F.when(full, S.fixed(F.sum(F.col(c).cast("decimal(38,4)")).over(around)
                                                                 .cast("double") / (2 * half + 1), 4)).alias(f"{c}_7d")
                                            for c in columns])


def ordered_shares(df: DataFrame, column: str, order) -> DataFrame:
    """Counts and shares of a category in its fixed order, absent values as 0."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("customers"))
    lines = F.array(*[F.struct(F.lit(v).alias(column), F.lit(i).alias("place")) for i, v in enumerate(order)])
    frame = df.sparkSession.range(1).select(F.inline(lines))
    full = frame.join(counts, column, "left").select(column, "place", F.coalesce("customers", F.lit(0)).alias("customers"))
    whole = F.sum("customers").over(Window.partitionBy())
    return full.select(column, "place", "customers", S.percent(F.col("customers"), whole).alias("pct_customers"))


def facts(pairs: dict[str, DataFrame]) -> DataFrame:
    """One (fact, value) row per name; each frame is one row with one number."""
    rows = [df.select(F.lit(k).alias("fact"), F.col(df.columns[0]).cast("double").alias("value")) for k, df in pairs.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out
