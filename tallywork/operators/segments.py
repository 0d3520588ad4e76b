"""Behaviour segments: prepared features, K-Means, stable labels, profiles and guards."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..params import Params
from ..sources.store import Store
from . import batch_kmeans
from . import ranks as R

FILLED_BY = {"log_avg_balance": "avg_balance"}  # the column whose median fills a feature


@dataclass(frozen=True)
class Prep:
    """Fitted preprocessing: fills, caps, means and scales per feature."""

    features: tuple[str, ...]
    fill: dict[str, float]
    low: dict[str, float]
    high: dict[str, float]
    mean: dict[str, float] = field(default_factory=dict)
    scale: dict[str, float] = field(default_factory=dict)

    def as_rows(self) -> list[tuple]:
        return [(f, self.low[f], self.high[f], self.mean[f], self.scale[f]) for f in self.features]


def raw_features(customers: DataFrame, fill: dict[str, Column | float], use_age: bool = False) -> DataFrame:
    """Log money, capped count, recency; unknown balance (and age) filled with the median."""
    c = F.col
    value = lambda x: x if isinstance(x, Column) else F.lit(x)
    columns = {
        "log_avg_balance": F.log1p(F.coalesce(c("avg_balance"), value(fill["avg_balance"]))),
        "log_total_value": F.log1p(c("total_txn_value").cast("double")),
        "log_avg_txn": F.log1p(c("avg_txn_value")),
        "txn_count_cap": F.least(c("txn_count"), F.lit(4)).cast("double"),
        "recency_days": c("recency_days").cast("double")}
    if use_age:
        columns["age"] = F.coalesce(c("age").cast("double"), value(fill["age"]))
    return customers.select("customer_id", "value_score", *[x.alias(k) for k, x in columns.items()])


def fit_prep(store: Store, name: str, customers: DataFrame, p: Params, use_age: bool = False) -> tuple[Prep, DataFrame]:
    """Exact medians and P1/P99 caps, then mean and population deviation of the capped features. Only these few
    numbers reach the driver. Returns the fit and the standardised rows, written once."""
    features = (*p.features, "age") if use_age else p.features
    filled = ["avg_balance", "age"] if use_age else ["avg_balance"]
    medians = R.distribution(store, f"{name}_medians", customers, filled)
    fill = R.quantiles(medians, {f: (f, 0.5) for f in filled}).first().asDict()
    raw = store.save(f"{name}_features", raw_features(customers, fill, use_age)).df
    spread = R.distribution(store, f"{name}_spread", raw, list(features))
    wanted = {f"{f}{end}": (f, q) for f in features for end, q in (("_low", 0.01), ("_high", 0.99))}
    caps = R.quantiles(spread, wanted).first()
    low, high = ({f: caps[f"{f}{end}"] for f in features} for end in ("_low", "_high"))
    capped = raw.select("customer_id", "value_score",
                        *[F.least(F.greatest(F.col(f), F.lit(low[f])), F.lit(high[f])).alias(f) for f in features])
    stats = capped.agg(*[S.mean_of(F.col(f), 12).alias(f"{f}_mean") for f in features],
                       *[F.stddev_pop(f).alias(f"{f}_sd") for f in features]).first()
    mean = {f: stats[f"{f}_mean"] for f in features}
    scale = {f: stats[f"{f}_sd"] or 1.0 for f in features}
    prep = Prep(features, fill, low, high, mean, scale)
    scaled = capped.select("customer_id", "value_score",
                           *[((F.col(f) - mean[f]) / scale[f]).alias(f) for f in features])
    return prep, store.save_by("customer_id", f"{name}_scaled", scaled).df


def assembled(scaled: DataFrame, features) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="point").transform(scaled)


def fit_kmeans(scaled: DataFrame, features, k: int, seed: int, starts: int = 10) -> list[tuple[float, ...]]:
    """Centres of the K-Means of lowest cost over several starts. All starts share their passes, which read the written
    rows; nothing is cached."""
    points, width = batch_kmeans.stacked([(scaled, tuple(features))])
    model = batch_kmeans.best_centers(points, width, k, seed, starts)
    return [tuple(float(x) for x in center) for center in model.centers]


def _distance(features, center) -> Column:
    return sum(((F.col(f) - F.lit(float(v))) * (F.col(f) - F.lit(float(v))) for f, v in zip(features, center)), F.lit(0.0))


def least_distance(features, centroids) -> Column:
    """Squared distance to the nearest of a few literal centroids."""
    return F.array_min(F.array(*[_distance(features, center) for center in centroids]))


def distance_to(features, centroids, label: Column) -> Column:
    """Squared distance to the centroid that ``label`` names."""
    return F.element_at(F.array(*[_distance(features, center) for center in centroids]), label + 1)


def nearest(scaled: DataFrame, features, centroids: list[tuple[float, ...]]) -> DataFrame:
    """Label of the nearest centroid as plain column arithmetic; k centroids are literals of the plan."""
    distance = lambda center: sum(((F.col(f) - F.lit(v)) * (F.col(f) - F.lit(v)) for f, v in zip(features, center)),
                                  F.lit(0.0))
    near = F.array_min(F.array(*[F.struct(distance(c).alias("d"), F.lit(i).alias("label"))
                                 for i, c in enumerate(centroids)]))
    return scaled.withColumn("label", near["label"])


def relabel(labelled: DataFrame, prefix: str) -> DataFrame:
    """Stable keys: clusters numbered by descending mean value score. The k means are a few rows."""
    means = labelled.groupBy("label").agg(S.mean_of(F.col("value_score"), 10).alias("mean_score"))
    place = F.row_number().over(Window.orderBy(F.desc("mean_score"), "label")) - 1
    keys = means.select("label", F.concat(F.lit(prefix), place.cast("string")).alias("cluster_key"))
    return labelled.join(F.broadcast(keys), "label")


def populations(customers: DataFrame, design: str) -> dict[str, DataFrame]:
    if design == "layered":
        return {"S": customers.where("txn_count = 1"), "R": customers.where("txn_count > 1")}
    return {"J": customers}


def grid_populations(customers: DataFrame) -> dict[str, tuple[DataFrame, bool]]:
    """The populations that a number of clusters is chosen for, and whether age is a feature."""
    return {"joint": (customers, False), "joint_age": (customers, True), "single": (customers.where("txn_count = 1"), False),
            "repeat": (customers.where("txn_count > 1"), False)}


def segment(store: Store, customers: DataFrame, config: dict, definitions: DataFrame, p: Params,
            centroids: dict[str, list] | None = None, starts: int = 10):
    """(customer_segment, fits by population, scaled rows by population). Centroids may be given; else they are fitted."""
    parts, fits, scaled_rows = [], {}, {}
    for prefix, people in populations(customers, config["design"]).items():
        prep, scaled = fit_prep(store, f"segment_{prefix}", people, p, config.get("use_age", False))
        if scaled.isEmpty():  # a population may have no customers
            continue
        if centroids is None:
            centers = fit_kmeans(scaled, prep.features, config["k"][prefix], p.seed, starts)
        else:
            centers = centroids[prefix]
        labelled = nearest(scaled, prep.features, centers)
        parts.append(relabel(labelled, prefix).select("customer_id", "cluster_key"))
        fits[prefix], scaled_rows[prefix] = (prep, centers), scaled
    keyed = reduce(DataFrame.unionByName, parts)
    layer = F.when(F.col("txn_count") == 1, "Single transaction").otherwise("Repeat")
    names = definitions.select("cluster_key", "segment_id", "segment_name")
    rows = (customers.select("customer_id", layer.alias("layer")).join(keyed.hint("merge"), "customer_id")
            .join(F.broadcast(names), "cluster_key", "left")  # k rows of configuration
            .withColumn("method", F.lit(f"{config['design']} KMeans")))
    return store.save_by("customer_id", "customer_segment", rows), fits, scaled_rows


def missing_definitions(segments: DataFrame) -> DataFrame:
    return segments.where(F.col("segment_id").isNull()).select("cluster_key").distinct()


PROFILE_MEDIANS = {"median_total_value": "total_txn_value", "median_avg_txn": "avg_txn_value",
                   "median_avg_balance": "avg_balance", "median_age": "age"}


def profile(store: Store, name: str, labelled: DataFrame, key: str) -> DataFrame:
    """Size, shares, means and medians of each group; labelled rows are customers with the group column."""
    n, whole = F.count(F.lit(1)), Window.partitionBy()
    spread = R.distribution(store, f"profile_{name}", labelled, list(PROFILE_MEDIANS.values()), by=[key])
    medians = R.quantiles(spread, {k: (m, 0.5) for k, m in PROFILE_MEDIANS.items()}, [key])
    medians = medians.select(key, *[S.fixed(F.col(m), 2).alias(m) for m in PROFILE_MEDIANS])
    mean = lambda x: S.fixed(S.ratio(F.sum(x), n), 2)
    sums = labelled.groupBy(key).agg(
        n.alias("customers"), F.sum("total_txn_value").alias("_value"), mean("txn_count").alias("mean_txn_count"),
        mean("recency_days").alias("mean_recency"), S.percent(F.count_if("is_active"), n).alias("pct_active"),
        S.percent(F.count_if("is_high_value"), n).alias("pct_high_value"),
        S.percent(F.count_if(F.col("gender") == "F"), n).alias("pct_female"),
        S.percent(F.count_if(F.col("city_tier") == "Tier 1 metro"), n).alias("pct_tier1_metro"),
        mean("r_score").alias("mean_r"), mean("f_score").alias("mean_f"), mean("m_score").alias("mean_m"))
    return sums.join(medians, key, "left").withColumns({
        "pct_customers": S.percent(F.col("customers"), F.sum("customers").over(whole)),
        "pct_value": S.percent(F.col("_value"), F.sum("_value").over(whole))}).drop("_value")


def name_fits(profiles: DataFrame, rules: dict[str, str]) -> DataFrame:
    """(cluster_key, fits_name): whether each profile row meets the ``expect`` rule of its name, in one pass."""
    chain = F
    for key, rule in rules.items():
        chain = chain.when(F.col("cluster_key") == key, F.expr(rule))
    return profiles.select("cluster_key", F.coalesce(chain, F.lit(False)).alias("fits_name"))


def zscore_profile(scaled: DataFrame, keyed: DataFrame, features) -> DataFrame:
    joined = scaled.join(keyed.select("customer_id", "cluster_key"), "customer_id")
    return joined.groupBy("cluster_key").agg(*[S.fixed(S.mean_of(F.col(f), 12), 3, 10).alias(f) for f in features])


def pca(scaled: DataFrame, features, k: int = 2):
    """Projection and explained variance; the fit aggregates a small covariance matrix."""
    points = assembled(scaled, features)
    model = PCA(k=k, inputCol="point", outputCol="projected").fit(points)
    shown = model.transform(points).select("customer_id", *[
        vector_to_array("projected")[i].alias(f"pc{i + 1}") for i in range(k)])
    return shown, [float(x) for x in model.explainedVariance]
