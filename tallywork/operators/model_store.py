"""Segment models as versioned tables: written, loaded, and applied to new customers.

A version is a folder key of two tables. ``features``: fill, caps, mean and scale of each feature and its value in every
centre, by population. ``clusters``: key, segment and profile of every label; it is written last, so a version that it
names is whole. Scoring is column arithmetic on literals of the model: no join and no Python.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import segments as G

FEATURES = ("version string, design string, use_age boolean, population string, position int, feature string, fill double, "
            "low double, high double, mean double, scale double, centers array<double>")
CLUSTERS = "version string, population string, label int, cluster_key string, segment_id int, segment_name string, profile array<double>"


@dataclass(frozen=True)
class Population:
    prep: G.Prep
    centers: list[tuple[float, ...]]
    keys: list[tuple]  # per label: cluster key, segment id, segment name
    profile: list[list[float] | None]


@dataclass(frozen=True)
class SegmentModel:
    version: str
    design: str
    use_age: bool
    populations: dict[str, Population]


def of_fits(version: str, config: dict, fits: dict, scaled: dict[str, DataFrame], segments: DataFrame) -> SegmentModel:
    """The model of a finished segmentation; cluster keys and profiles are read from its rows (k rows a population)."""
    made = {}
    for name, (prep, centers) in fits.items():
        labelled = G.nearest(scaled[name], prep.features, centers).join(segments, "customer_id")
        found = labelled.groupBy("label", "cluster_key", "segment_id", "segment_name").agg(
            *[F.avg(f).alias(f) for f in prep.features]).collect()
        by_label = {r.label: r for r in found}
        keys = [(by_label[i].cluster_key, by_label[i].segment_id, by_label[i].segment_name) if i in by_label else (None,) * 3
                for i in range(len(centers))]
        made[name] = Population(prep, [tuple(c) for c in centers], keys,
                                [[by_label[i][f] for f in prep.features] if i in by_label else None for i in range(len(centers))])
    return SegmentModel(version, config["design"], config.get("use_age", False), made)


def save(spark: SparkSession, model: SegmentModel, path: str) -> None:
    """Adds a version; one that is there already is refused."""
    if model.version in versions(spark, path):
        raise ValueError(f"version {model.version} is stored already")
    features, clusters = [], []
    for name, p in model.populations.items():
        for i, (feature, low, high, mean, scale) in enumerate(p.prep.as_rows()):
            fill = p.prep.fill.get(G.FILLED_BY.get(feature, feature))
            features.append((model.version, model.design, model.use_age, name, i, feature, fill, low, high, mean, scale,
                             [float(c[i]) for c in p.centers]))
        clusters += [(model.version, name, i, *key, profile) for i, (key, profile) in enumerate(zip(p.keys, p.profile))]
    for rows, shape, table in ((features, FEATURES, "features"), (clusters, CLUSTERS, "clusters")):
        spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").partitionBy("version").parquet(f"{path}/{table}")


def versions(spark: SparkSession, path: str) -> list[str]:
    """The whole versions, oldest name first."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/clusters")
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return []
    return sorted(r.version for r in _read(spark, path, "clusters", CLUSTERS).select("version").distinct().collect())


def _read(spark: SparkSession, path: str, table: str, shape: str) -> DataFrame:
    return spark.read.schema(shape).parquet(f"{path}/{table}")


def load(spark: SparkSession, path: str, version: str | None = None) -> SegmentModel:
    """A version, by default the last name."""
    known = versions(spark, path)
    version = version or (known[-1] if known else None)
    if version not in known:
        raise ValueError(f"no version {version} in {path}")
    pick = lambda table, shape, *order: _read(spark, path, table, shape).where(
        F.col("version") == version).orderBy(*order).collect()
    features = pick("features", FEATURES, "population", "position")
    clusters = pick("clusters", CLUSTERS, "population", "label")
    made = {}
    for name in dict.fromkeys(r.population for r in features):
        own = [r for r in features if r.population == name]
        names = tuple(r.feature for r in own)
        prep = G.Prep(names, {G.FILLED_BY.get(r.feature, r.feature): r.fill for r in own if r.fill is not None},
                      *({r.feature: r[c] for r in own} for c in ("low", "high", "mean", "scale")))
        mine = [r for r in clusters if r.population == name]
        made[name] = Population(prep, list(zip(*[r.centers for r in own])),
                                [(r.cluster_key, r.segment_id, r.segment_name) for r in mine], [r.profile for r in mine])
    return SegmentModel(version, features[0].design, features[0].use_age, made)


def scaled_features(customers: DataFrame, population: Population, use_age: bool) -> DataFrame:
    """Features filled, capped and scaled with the stored numbers."""
    p = population.prep
    raw = G.raw_features(customers, p.fill, use_age)
    capped = lambda f: F.least(F.greatest(F.col(f), F.lit(p.low[f])), F.lit(p.high[f]))
    return raw.select("customer_id", "value_score", *[((capped(f) - p.mean[f]) / p.scale[f]).alias(f) for f in p.features])


def apply(model: SegmentModel, customers: DataFrame) -> DataFrame:
    """(customer_id, cluster_key, segment_id, segment_name) of any customers with the columns of ``customer_360``."""
    parts = []
    for name, people in G.populations(customers, model.design).items():
        if name not in model.populations:
            continue
        own = model.populations[name]
        at = F.col("label") + 1
        pick = lambda i, kind: F.element_at(F.array(*[F.lit(k[i]).cast(kind) for k in own.keys]), at)
        near = G.nearest(scaled_features(people, own, model.use_age), own.prep.features, own.centers)
        parts.append(near.select("customer_id", pick(0, "string").alias("cluster_key"), pick(1, "int").alias("segment_id"),
                                 pick(2, "string").alias("segment_name")))
    return reduce(DataFrame.unionByName, parts)
