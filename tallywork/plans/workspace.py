"""The stage tables of one run. Each is built on first use and written once."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from ..operators import batch_kmeans, cleaning, cube, features, model, opportunity, publish, quality, segments
from ..params import Params
from ..sources import staging as src
from ..sources.store import Saved, Store, spread


class Workspace:
    def __init__(self, spark: SparkSession, staging: DataFrame, params: Params | None = None, variants=None,
                 segment_config: dict | None = None, centroids: dict[str, list] | None = None, starts: int | None = None,
                 store_root: str | None = None, land: bool = True):
        """``land=False`` reads the log in place: for a columnar table whose ``src_row`` is stored."""
        self.spark, self.source, self.params = spark, staging, params or Params()
        self.store = Store(spark, store_root)
        self.variants = src.variants_table(spark, variants or ())
        self.segment_config = segment_config or src.segment_config()
        self.centroids, self.starts, self.land = centroids, starts or self.params.starts, land

    # cleaning
    @cached_property
    def staging(self) -> DataFrame:
        """The log as landed: text columns in parquet with a fixed row order, so later passes read only what they need."""
        return self.store.save("staging", spread(self.source)).df if self.land else self.source

    @cached_property
    def classified_table(self) -> Saved:
        return cleaning.classify(self.store, self.staging, self.params)

    @property
    def classified(self) -> DataFrame:
        return self.classified_table.df

    @property
    def rejected(self) -> DataFrame:
        return cleaning.rejected(self.classified)

    @cached_property
    def _clean_rows(self) -> DataFrame:
        """Typed clean rows, apart from the raw text of the log; cities, amounts, copies and the fact read them."""
        return self.store.save("clean_rows", cleaning.clean(self.classified, self.variants, self.params)).df

    def close(self) -> None:
        """Removes the written stages."""
        self.store.close()

    @property
    def waterfall(self) -> DataFrame:
        return cleaning.waterfall(self.classified)

    # model
    @cached_property
    def dim_date(self) -> DataFrame:
        return model.dim_date(self.spark, self.params)

    @cached_property
    def locations(self) -> Saved:
        return model.dim_location(self.store, self._clean_rows, self.params)

    @property
    def dim_location(self) -> DataFrame:
        return self.locations.df.drop("txns")

    @cached_property
    def amounts(self) -> Saved:
        return model.amount_distribution(self.store, self._clean_rows)

    @cached_property
    def transactions(self) -> Saved:
        """Clean rows with every derived column: the ``clean`` and ``fact`` tables are projections of it."""
        rows = cleaning.mark_copies(self.store, self._clean_rows)
        return self.store.save("transactions", model.fact(rows, self.locations, self.amounts))

    @property
    def fact(self) -> DataFrame:
        return self.transactions.df

    @property
    def clean(self) -> DataFrame:
        return self.transactions.df

    @cached_property
    def customers_table(self) -> Saved:
        return model.dim_customer(self.store, self.fact, self.locations, self.params)

    @property
    def dim_customer(self) -> DataFrame:
        return self.customers_table.df

    # features
    @cached_property
    def base(self) -> Saved:
        return features.customer_base(self.store, self.fact, self.dim_customer, self.params)

    @cached_property
    def value_places(self) -> Saved:
        """Positions of every ranked customer measure: the source of ranks, thresholds and concentration."""
        return features.R.distribution(self.store, "customer_values", self.base.df, features.RANKED, keep=True)

    @cached_property
    def thresholds(self) -> DataFrame:
        return self.store.save("thresholds", features.thresholds(self.value_places, self.amounts)).df

    @cached_property
    def c360_table(self) -> Saved:
        ranks = features.customer_ranks(self.store, self.base.df, self.value_places)
        return features.customer_360(self.store, self.base.df, ranks.df, self.thresholds, self.params)

    @property
    def customer_360(self) -> DataFrame:
        return self.c360_table.df

    # opportunity
    @cached_property
    def opportunity_table(self) -> Saved:
        return opportunity.opportunity(self.store, self.c360_table, self.params)

    @property
    def opportunity(self) -> DataFrame:
        return self.opportunity_table.df

    @cached_property
    def sensitivity(self) -> DataFrame:
        return opportunity.sensitivity(self.store, self.customer_360, self.opportunity, self.params)

    # segments
    @cached_property
    def segment_definition(self) -> DataFrame:
        return src.segment_definitions(self.spark, self.segment_config)

    @cached_property
    def _segmentation(self):
        return segments.segment(self.store, self.customer_360, self.segment_config, self.segment_definition,
                                self.params, self.centroids, self.starts)

    @property
    def customer_segment(self) -> DataFrame:
        return self._segmentation[0].df

    @property
    def segment_fits(self) -> dict:
        return self._segmentation[1]

    @property
    def scaled_features(self) -> dict[str, DataFrame]:
        return self._segmentation[2]

    @cached_property
    def k_selection(self) -> DataFrame:
        """Quality of every number of clusters for every population that has customers."""
        parts, names = [], []
        for name, (people, use_age) in segments.grid_populations(self.customer_360).items():
            prep, scaled = segments.fit_prep(self.store, f"grid_{name}", people, self.params, use_age)
            if not scaled.isEmpty():
                parts.append((scaled, prep.features))
                names.append(name)
        points, width = batch_kmeans.stacked(parts)
        points = self.store.save("grid_points", points).df
        p = self.params
        rows = batch_kmeans.grid(points, width, names, p.grid_k, p.seed, p.grid_seeds, self.starts)
        shape = ("population string, k int, customers bigint, inertia double, silhouette double, calinski_harabasz double, "
                 "ari_min double, ari_mean double, min_cluster_share double, clusters int")
        return self.store.save("k_selection", self.spark.createDataFrame(rows, shape)).df

    @cached_property
    def segment_profile(self) -> DataFrame:
        return segments.profile(self.store, "segment_name", self.view, "segment_name")

    def check_segments(self) -> None:
        """Stops when a cluster has no definition or no longer fits its name."""
        lost = [r.cluster_key for r in segments.missing_definitions(self.customer_segment).collect()]
        if lost:
            raise ValueError(f"no segment definition for clusters {sorted(lost)}")
        by_key = segments.profile(self.store, "cluster_key", self.view, "cluster_key")
        rules = {s["cluster_key"]: s["expect"] for s in self.segment_config["segments"] if s.get("expect")}
        broken = [r.cluster_key for r in segments.name_fits(by_key, rules).where("not fits_name").collect()]
        if broken:
            raise ValueError(f"segment profiles no longer fit their names: {broken}")

    # publish
    @cached_property
    def view(self) -> DataFrame:
        """Features, segment and opportunity of each customer, written once for all reports."""
        joined = publish.customer_view(self.customer_360, self.customer_segment, self.opportunity)
        return self.store.save_by("customer_id", "customer_view", joined).df

    @cached_property
    def agg_daily_city(self) -> DataFrame:
        return self.store.save("agg_daily_city", publish.daily_city(self.fact, self.dim_customer)).df

    @cached_property
    def agg_hour_weekday(self) -> DataFrame:
        return self.store.save("agg_hour_weekday", publish.hour_weekday(self.fact)).df

    @cached_property
    def agg_city_summary(self) -> DataFrame:
        return self.store.save("agg_city_summary", publish.city_summary(self.store, self.view)).df

    @cached_property
    def agg_segment_summary(self) -> DataFrame:
        return self.store.save("agg_segment_summary", publish.segment_summary(self.store, self.view)).df

    @cached_property
    def agg_theme_segment(self) -> DataFrame:
        return self.store.save("agg_theme_segment", publish.theme_segment(self.view)).df

    @cached_property
    def kpis(self) -> DataFrame:
        return self.store.save("kpis", publish.kpis(self.view, self.value_places)).df

    @cached_property
    def dq_log(self) -> DataFrame:
        counts = quality.measured(self.spark, self.classified, self.fact, self.dim_customer, self.dim_location,
                                  self.customer_360, self.params)
        return self.store.save("dq_log", quality.scorecard(self.spark, counts)).df

    # cube
    @cached_property
    def top_cities(self) -> DataFrame:
        value = features.F.sum("total_txn_value")
        return self.store.save("top_cities", cube.top_values(self.view, "clean_city", value, self.params.top_cities)).df

    @cached_property
    def cube(self) -> DataFrame:
        return self.store.save("cube", cube.cube(self.view, self.top_cities)).df

    @cached_property
    def wide_cube(self) -> DataFrame:
        return self.store.save("wide_cube", cube.wide_cube(self.view, self.top_cities)).df

    @cached_property
    def priority_list(self) -> DataFrame:
        return self.store.save("priority_list", cube.priority_list(self.view, self.params.priority_rows)).df
