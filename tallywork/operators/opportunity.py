"""Cross-sell signals: six theme rules on percentile ranks, a weighted score, priority ranks and tiers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.labels import THEMES
from ..params import Params
from ..sources.store import Saved, Store
from . import ranks as R

Condition = tuple[Column, Column | None]  # (met, gap by which a percentile condition is missed)


def at_least(rank: Column, p: float) -> Condition:
    return rank >= p, F.lit(p) - rank


def fit_of(conditions: list[Condition], near_miss: float) -> Column:
    """1 when all are met; 0.5 when one is missed and that one is a percentile condition missed by little; else 0.
    An unknown value is a miss and never a near one."""
    met = [F.coalesce(m, F.lit(False)) for m, _ in conditions]
    missed = reduce(lambda a, b: a + b, [(~m).cast("int") for m in met])
    near = reduce(lambda a, b: a | b, [~m & F.coalesce(gap <= near_miss, F.lit(False))
                                       for m, (_, gap) in zip(met, conditions) if gap is not None], F.lit(False))
    return F.when(missed == 0, 1.0).when((missed == 1) & near, 0.5).otherwise(0.0)


def theme_conditions(p: Params) -> dict[str, list[Condition]]:
    """The percentile and age limits of each theme."""
    value, balance = F.col("pr_total"), F.col("pr_balance")
    age = lambda lo, hi: (F.col("age").between(lo, hi), None)
    quiet = F.col("pr_engagement")
    return {
        "investment": [at_least(balance, 0.75), ((F.col("txn_count") >= 2) | (value >= 0.60), F.lit(0.60) - value)],
        "premium": [at_least(balance, 0.90)],
        "credit_card": [at_least(value, 0.60), at_least(balance, 0.40), age(21, 60)],
        "insurance": [age(30, 55), at_least(balance, 0.50)],
        "personal_loan": [age(25, 45), at_least(F.col("pr_ratio"), 0.75),
                          (F.col("recency_days") <= p.loan_recency_days, None)],
        "reengagement": [(quiet < 0.25, quiet - 0.25 + 1e-9), at_least(balance, 0.50)],
    }


def with_fits(customers: DataFrame, p: Params) -> DataFrame:
    return customers.withColumns({f"fit_{t}": fit_of(c, p.near_miss) for t, c in theme_conditions(p).items()})


def theme_score(weights: dict[str, float], fit: Column, p: Params) -> Column:
    value, engagement = F.col("value_score") / 100, F.col("engagement_score") / 100
    recency = 1 - F.least(F.col("recency_days"), F.lit(p.window_days)).cast("double") / p.window_days
    common = weights["V"] * value + weights["E"] * engagement + weights["R"] * recency
    return 100 * (common + weights["Fit"] * fit)


def best_score(weights: dict[str, float], p: Params) -> Column:
    return F.greatest(*[theme_score(weights, F.col(f"fit_{t}"), p) for t in THEMES])


def driving_theme() -> Column:
    """Theme with the highest fit, ties in list order."""
    top = F.greatest(*[F.col(f"fit_{t}") for t in THEMES])
    chain = F.when(top == 0, F.lit("none"))
    for t in THEMES:
        chain = chain.when(F.col(f"fit_{t}") == top, F.lit(t))
    return chain


def reason_text(theme_label: Column) -> Column:
    """Balance, its top percent, activity, last visit and theme, in words."""
    c = F.col
    plural = lambda n: F.when(n == 1, "").otherwise("s")
    balance = F.when(c("avg_balance").isNull(), "balance unknown").otherwise(
        F.concat(F.lit("avg balance Rs "), F.format_number("avg_balance", 0)))
    top = F.rint(F.greatest(100 * (1 - c("pr_balance")), F.lit(1.0))).cast("int")
    top_text = F.when(c("pr_balance").isNull(), "").otherwise(F.concat(F.lit(" (top "), top, F.lit("%)")))
    return F.concat(balance, top_text, F.lit(", "), c("txn_count"), F.lit(" txn"), plural(c("txn_count")),
                    F.lit(", last seen "), c("recency_days"), F.lit(" day"), plural(c("recency_days")),
                    F.lit(" ago -> "), theme_label)


def tier_of(rank: Column, total: Column, p: Params) -> Column:
    share, chain = rank / total, F
    for name, cut in p.tier_cuts:
        chain = chain.when(share <= cut, F.lit(name))
    return chain.otherwise("Watch")


def prioritised(store: Store, customers: Saved, p: Params) -> DataFrame:
    """Customers with fits, the unrounded score, priority rank and tier."""
    scored = with_fits(customers.df, p).withColumn("_score", best_score(dict(p.weights), p))
    order = [F.desc("_score"), F.desc("value_score"), F.asc("customer_id")]
    keys = customers.of(scored.select("customer_id", "_score", "value_score"))
    numbered = R.row_numbers(store, "priority_sorted", keys, order, "priority_rank")
    total = customers.df.agg(F.count(F.lit(1))).scalar()
    placed = numbered.select("customer_id", "priority_rank", tier_of(F.col("priority_rank"), total, p).alias("tier"))
    return scored.join(store.save_by("customer_id", "priority_places", placed).df.hint("merge"), "customer_id")


def opportunity(store: Store, customers: Saved, p: Params) -> Saved:
    """The published table: one row per customer."""
    weights, c = dict(p.weights), F.col
    signals = {f"sig_{t}": c(f"fit_{t}") == 1.0 for t in THEMES}
    count = reduce(lambda a, b: a + b, [s.cast("int") for s in signals.values()])
    rows = prioritised(store, customers, p).withColumn("driving_theme", driving_theme())
    label = S.theme_label(c("driving_theme"))
    per_theme = []
    for t in THEMES:
        per_theme += [signals[f"sig_{t}"].alias(f"sig_{t}"), c(f"fit_{t}"),
                      S.fixed(theme_score(weights, c(f"fit_{t}"), p), 3, inner=10).alias(f"os_{t}")]
    return store.save_by("customer_id", "customer_opportunity", rows.select(
        "customer_id", S.mask_id(c("customer_id")).alias("masked_id"), *per_theme, count.alias("signal_count"),
        (count > 0).alias("any_signal"), S.fixed(c("_score"), 3, inner=10).alias("overall_score"), "driving_theme",
        label.alias("driving_theme_label"), "priority_rank", "tier", "evidence_level",
        reason_text(label).alias("reason")))


def scenarios(p: Params, step: float = 0.10) -> list[tuple[str, dict[str, float]]]:
    """Each weight moved up and down by the step, floored at 0 and rescaled to sum 1."""
    out = []
    for name, weight in p.weights:
        for delta in (step, -step):
            moved = {**dict(p.weights), name: max(weight + delta, 0.0)}
            total = sum(moved.values())
            sign = "+" if delta > 0 else "-"
            out.append((f"{name} {sign}10 pts", {k: w / total for k, w in moved.items()}))
    return out


def sensitivity(store: Store, customers: DataFrame, opportunities: DataFrame, p: Params) -> DataFrame:
    """Top-list overlap and rank correlation of every scenario with the base ranking. All scenarios are ranked by one
    sort of (scenario, score); ranks are unique, so the correlation follows from the squared rank differences."""
    plans = scenarios(p)
    rows = with_fits(customers, p)
    scores = F.array(*[F.struct(F.lit(i).alias("scenario_no"), best_score(w, p).alias("score"))
                       for i, (_, w) in enumerate(plans)])
    tall = rows.select("customer_id", "value_score", F.inline(scores))
    order = [F.asc("scenario_no"), F.desc("score"), F.desc("value_score"), F.asc("customer_id")]
    total = customers.agg(F.count(F.lit(1))).scalar()
    ranked = R.row_numbers(store, "scenario_sorted", store.save("scenarios", tall), order, "_row") \
        .select("customer_id", "scenario_no", (F.col("_row") - F.col("scenario_no") * total).alias("rank"))
    pairs = ranked.join(opportunities.select("customer_id", "priority_rank"), "customer_id")
    gap = (F.col("rank") - F.col("priority_rank")).cast("decimal(19,0)")
    both_top = (F.col("rank") <= p.overlap_top) & (F.col("priority_rank") <= p.overlap_top)
    sums = pairs.groupBy("scenario_no").agg(F.count(F.lit(1)).cast("double").alias("n"),
                                            F.sum(gap * gap).cast("double").alias("d2"),
                                            F.count_if(both_top).alias("shared"))
    names = F.array(*[F.lit(name) for name, _ in plans])
    weight = lambda k: F.element_at(F.array(*[F.lit(round(w[k], 3)) for _, w in plans]),
                                    F.col("scenario_no") + 1).alias(f"w_{k}")
    n = F.col("n")
    return sums.select(
        F.element_at(names, F.col("scenario_no") + 1).alias("scenario"), *[weight(k) for k, _ in p.weights],
        S.fixed(100 * F.col("shared") / p.overlap_top, 1).alias(f"top{p.overlap_top}_overlap_pct"),
        S.fixed(1 - 6 * F.col("d2") / (n * (n * n - 1)), 4, inner=10).alias("spearman_vs_base"))
