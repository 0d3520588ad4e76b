"""Named queries over a workspace. Each reads the stage tables, so its work grows with the log."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import labels as L
from ..functions import scalars as S
from ..operators import (batch_kmeans, cleaning, cluster_metrics, cube, measures, model, model_store, profiling, publish, quality,
                         reconcile, segments, stats)
from ..operators import opportunity as O
from ..operators import ranks as R
from ..sources import ledger
from ..sources import staging as src
from ..sources.fixture import PARAMS, VARIANTS, expected_rows, staging
from . import extracts
from .questions import QUESTIONS, n_rows
from .workspace import Workspace

c = F.col
CATALOG: dict[str, Callable[[Workspace], DataFrame]] = {}
# Centres of the fixed segment model that the reports of the fixture use, in standardised feature space.
CENTROIDS = {"J": [(0.2, 0.9, 0.0, 1.2, -0.8), (0.3, 0.3, 0.8, -0.7, -0.7), (0.3, 0.1, 0.6, -0.6, 0.9),
                   (0.1, -1.3, -1.3, -0.5, 0.1), (-2.0, -0.1, 0.0, 0.0, 0.0)]}
_OPEN: dict[tuple[str, str], Workspace] = {}


def open_workspace(spark: SparkSession, sf_dir: str, **options) -> Workspace:
    params = PARAMS.but(expected_rows=expected_rows(spark, sf_dir))
    w = Workspace(spark, staging(spark, sf_dir), params, VARIANTS, centroids=CENTROIDS, **options)
    w.folder = sf_dir
    return w


def workspace(spark: SparkSession, sf_dir: str) -> Workspace:
    """One workspace per session and input folder, so queries share its written stages."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _OPEN:
        _OPEN[key] = open_workspace(spark, sf_dir)
    return _OPEN[key]


def flat(df: DataFrame) -> DataFrame:
    """Plain column types for a comparison: bigint, double, text and boolean."""
    out = []
    for f in df.schema.fields:
        x = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            x = x.cast("bigint")
        elif isinstance(f.dataType, (T.DecimalType, T.FloatType)):
            x = x.cast("double")
        elif isinstance(f.dataType, (T.DateType, T.TimestampType)):
            x = x.cast("string")
        elif isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)):
            x = F.to_json(x)
        out.append(x.alias(f.name))
    return df.select(*out)


def query(name: str):
    def add(fn):
        CATALOG[name] = fn
        return fn
    return add


for _qid, (_title, _fn) in QUESTIONS.items():
    CATALOG[f"{_qid.lower()}_{'_'.join(_title.lower().replace('-', ' ').split()[:4])}"] = _fn


# ---- sources and sinks
@query("a01_csv_staging")
def a01(w):
    path = f"{w.store.root}/log_csv"
    keep = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "header": True}
    w.staging.select(*src.RAW_COLUMNS).write.mode("overwrite").options(**keep).csv(path)
    return src.read_csv(w.spark, path).select(*src.RAW_COLUMNS)


@query("a02_load_audit")
def a02(w):
    return src.load_audit(w.staging).select("rows_loaded", "text_bytes")


@query("a06_replace_table")
def a06(w):
    path = f"{w.store.root}/replaced"
    for df in (w.agg_daily_city.limit(1), w.agg_daily_city):
        extracts.write_table(df, path)
    return w.spark.read.parquet(path)


@query("a07_report_extracts")
def a07(w):
    counts = extracts.write_extracts(extracts.report_tables(w), f"{w.store.root}/report")
    return w.spark.createDataFrame(list(counts.items()), "extract string, rows bigint")


@query("a08_sheet_extracts")
def a08(w):
    counts = extracts.write_extracts(extracts.sheet_tables(w), f"{w.store.root}/sheets")
    return w.spark.createDataFrame(list(counts.items()), "extract string, rows bigint")


@query("a09_dashboard_document")
def a09(w):
    # Read back as a document: every section that the index names.
    path = w.store.path("dashboard")
    extracts.write_dashboard(w, path)
    index = w.spark.read.json(f"{path}/index")
    counts = [w.spark.read.text(f"{path}/{r.section}").agg(n_rows().alias("rows")).select(F.lit(r.section).alias("section"), "rows")
              for r in index.select("section").collect()]
    return index.select("section").join(reduce(DataFrame.unionByName, counts), "section")


@query("a09_dashboard_contents")
def a09b(w):
    path, sections = w.store.path("dashboard"), extracts.dashboard_sections(w)
    extracts.write_document(w.spark, sections, path)
    return extracts.contents(w.spark, sections, path, "json").withColumnRenamed("extract", "section")


@query("a07_report_contents")
def a07b(w):
    path, tables = w.store.path("report"), extracts.report_tables(w)
    extracts.write_extracts(tables, path)
    return extracts.contents(w.spark, tables, path, "csv")


@query("a08_sheet_contents")
def a08b(w):
    path, tables = w.store.path("sheets"), extracts.sheet_tables(w)
    extracts.write_extracts(tables, path)
    return extracts.contents(w.spark, tables, path, "csv")


@query("a10_answer_contents")
def a10b(w):
    path, tables = w.store.path("answers"), extracts.answers(w)
    extracts.write_extracts(tables, path)
    return extracts.contents(w.spark, tables, path, "csv").withColumnRenamed("extract", "question")


@query("a02_file_ledger")
def a02b(w):
    """The log as one file per year of its dates, loaded through the ledger."""
    path, ledger_path = w.store.path("log_files"), w.store.path("ledger")
    keep = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "header": True}
    year = F.right(c("transaction_date"), F.lit(2)).alias("year")
    (w.staging.select(*src.RAW_COLUMNS, year).repartition("year").write.partitionBy("year").options(**keep).csv(path))
    ledger.load_new(w.spark, path, ledger_path, lambda rows: w.store.save("ledger_load", rows).df)
    rows = ledger.read_ledger(w.spark, ledger_path)
    year = F.regexp_extract("file_name", "year=([0-9]+)", 1).alias("year")
    return rows.select(year, "rows_loaded", "text_bytes", "malformed_rows", (c("file_bytes") > c("text_bytes")).alias("whole_files"))


@query("a10_answer_index")
def a10(w):
    return extracts.write_answers(w, f"{w.store.root}/answers").select("question", "rows")


@query("a11_stored_model_scores")
def a11b(w):
    """The model is written, read back, and applied to the customers as they are a week later without new transactions."""
    _ = w.customer_segment
    model = model_store.of_fits("1", w.segment_config, w.segment_fits, w.scaled_features, w.customer_segment)
    path = w.store.path("segment_models")
    model_store.save(w.spark, model, path)
    later = w.customer_360.withColumn("recency_days", c("recency_days") + 7)
    return model_store.apply(model_store.load(w.spark, path), later)


@query("a11_segment_model")
def a11(w):
    number = lambda x: S.fixed(c(x), 5, 10).alias(x)
    return extracts.segment_model(w).select("population", "feature", *map(number, ("low", "high", "mean", "scale")))


# ---- scalar functions and projections
@query("b01_b05_typed_columns")
def b01(w):
    return w.classified.select("src_row", "txn_id", "cust_id", "txn_date", "dob_parsed", "txn_sec", "amount",
                               "balance_parsed", "location_norm",
                               cleaning.P.valid_customer_id(c("cust_id")).alias("valid_id"))


@query("b06_b11_clean_rows")
def b06(w):
    return w.clean.select(
        "transaction_id", "txn_seq", "customer_id", "txn_date", "txn_sec", "amount", "balance", "dob", "gender",
        "clean_city", "raw_location", "dob_missing", "dob_placeholder", "dob_future", "balance_missing",
        "balance_negative", "time_invalid", "gender_other_value")


@query("b12_b17_fact_columns")
def b12(w):
    return w.fact.select("transaction_id", "order_key", "date_key", "txn_hour", "time_band", "day_of_week", "amount_band",
                         "balance_band", "is_high_value_txn", "is_zero_balance", "txn_location_key")


@query("b17_calendar_activity")
def b17(w):
    counts = w.fact.groupBy("date_key").agg(n_rows().alias("txns"))
    return w.dim_date.join(counts, "date_key", "left")


@query("b18_b20_customer_age")
def b18(w):
    return w.dim_customer.select("customer_id", "age", "age_group", "age_known", "age_out_of_range", "dq_flag")


@query("b21_city_tiers")
def b21(w):
    return w.dim_customer.groupBy("city_tier").agg(n_rows().alias("customers"))


@query("b22_b27_customer_features")
def b22(w):
    return w.customer_360.select(
        "customer_id", "avg_txn_value", "monthly_txn_frequency", S.fixed(c("balance_volatility"), 6, 10).alias("balance_volatility"),
        "txn_to_balance_ratio", "evening_night_share", "activity_trend", "engagement_score", "freq_band", "evidence_level",
        "is_active", "is_newly_observed", "is_dormant", "is_zero_balance", "rfm_code")


@query("b28_b30_priority_text")
def b28(w):
    return w.opportunity.select("customer_id", "masked_id", "driving_theme", "driving_theme_label", "reason")


@query("b31_b32_score_bands")
def b31(w):
    return w.opportunity.groupBy("tier", S.score_band(c("overall_score")).alias("score_band"),
                                 S.contact_plan(c("overall_score")).alias("contact_plan")).agg(n_rows().alias("customers"))


@query("b34_city_buckets")
def b34(w):
    return cube.with_city_bucket(w.view, w.top_cities).groupBy("city").agg(
        n_rows().alias("customers"), publish.total(c("total_txn_value")).alias("value"))


@query("b35_guarded_city_rates")
def b35(w):
    sums = w.view.groupBy("clean_city").agg(F.sum("txns_second_half").alias("late"), F.sum("txns_first_half").alias("early"))
    return sums.select("clean_city", S.ratio(c("late"), c("early")).alias("late_per_early"))


@query("b36_b38_b40_scores")
def b36(w):
    return w.customer_360.select("customer_id", "is_high_value", "is_low_engagement", "value_score", "recency_days",
                                 "r_score", "f_score", "m_score")


@query("b37_high_value_transactions")
def b37(w):
    return w.fact.where("is_high_value_txn").select("transaction_id", "amount")


# ---- row classification
@query("c01_reject_reasons")
def c01(w):
    return w.classified.select("src_row", "reject_reason")


@query("c02_rejected_rows")
def c02(w):
    return w.rejected


@query("c04_repeated_ids")
def c04(w):
    return w.classified.where("is_repeat").select("src_row", "txn_id")


@query("c05_possible_duplicates")
def c05(w):
    return w.clean.where("is_possible_duplicate").select("transaction_id", "customer_id")


# ---- joins
@query("d01_variant_lookup")
def d01(w):
    return w.clean.groupBy("raw_location", "clean_city").agg(n_rows().alias("rows"))


@query("d02_d11_customer_view")
def d02(w):
    return w.view.select("customer_id", "clean_city", "segment_name", "tier", "total_txn_value", "overall_score")


@query("d06_d15_key_checks")
def d15(w):
    keys = [("dim_location", w.dim_location, "location_key"), ("dim_date", w.dim_date, "date_key"),
            ("fact_transaction", w.fact, "transaction_id"), ("dim_customer", w.dim_customer, "customer_id"),
            ("customer_360", w.customer_360, "customer_id")]
    links = [("fact_customer", w.fact, w.dim_customer, "customer_id"), ("fact_date", w.fact, w.dim_date, "date_key"),
             ("customer_location", w.dim_customer, w.dim_location, "location_key")]
    parts = [model.key_violations(df, k).select(F.lit(n).alias("check_name"), (c("duplicates") + c("nulls")).alias("violations"))
             for n, df, k in keys]
    parts += [model.orphan_count(a, b.select(k), k).select(F.lit(n).alias("check_name"), c("orphans").alias("violations"))
              for n, a, b, k in links]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("d10_g05_spot_check")
def d10(w):
    return quality.spot_check(w.fact, w.classified)


@query("d12_lookup_with_default")
def d12(w):
    known = cube.lookup_rows(w.view.where("city_tier <> 'Other'"), w.params.priority_rows)
    out = cube.lookup_or(cube.tier_a_list(w.view), known, "customer_ref", ["city", "segment"])
    return out.withColumn("contact_plan", S.contact_plan(c("score")))


# ---- aggregates
@query("e01_e04_customer_base")
def e01(w):
    return w.base.df.select(
        "customer_id", "txn_count", "total_txn_value", "max_txn_value", "min_txn_value", "active_days", "first_txn_date",
        "last_txn_date", "avg_balance", "max_balance", "min_balance", "balance_obs", "latest_balance", "txns_first_half",
        "txns_second_half", "high_value_txn_count")


@query("e06_most_frequent_values")
def e06(w):
    city = model.most_frequent(w.fact, "clean_city", "UNKNOWN")
    gender = model.most_frequent(w.fact, "gender", "Unknown")
    return city.join(gender, "customer_id", "full")


@query("e12_segment_tier_shares")
def e12(w):
    return cube.row_shares(cube.cross_tab(w.view, "segment_name", "tier", L.TIER_ORDER, n_rows()), L.TIER_ORDER)


@query("e13_weekday_hour_grid")
def e13(w):
    grid = cube.cross_tab(w.agg_hour_weekday.where("txn_hour is not null"), "day_of_week_num", "txn_hour", range(24), F.sum("txns"))
    return grid.withColumnsRenamed({str(h): f"h{h:02d}" for h in range(24)})


@query("e13_segment_age_pivot")
def e13b(w):
    tab = cube.cross_tab(w.cube, "segment_name", "age_group", L.AGE_ORDER, F.sum("customers"))
    return tab.select("segment_name", *[c(f"`{a}`").alias(f"age{i}") for i, a in enumerate(L.AGE_ORDER)])


@query("e13_city_tier_pivot")
def e13c(w):
    return cube.cross_tab(w.cube, "city", "tier", L.TIER_ORDER, F.sum("customers"))


@query("e14_sheet_cells")
def e14(w):
    bands = w.wide_cube.groupBy("balance_band").agg(
        *[cube.sum_ifs("customers", gender=g).alias(f"customers_{g.lower()}") for g in L.GENDER_ORDER],
        cube.sum_ifs("customers", tier="A", evidence_level="High").alias("tier_a_high"),
        cube.sum_ifs("any_signal", city="UNKNOWN").alias("signals_unknown_city"))
    return bands


@query("e16_thresholds")
def e16(w):
    return w.thresholds


# ---- windows and ranks
@query("f10_moving_mean")
def f10(w):
    days = w.dim_date.join(w.fact.groupBy("date_key").agg(n_rows().alias("n"), F.sum("amount").alias("v")), "date_key", "left")
    daily = days.select("date", F.coalesce("n", F.lit(0)).alias("txns"), F.coalesce("v", F.lit(0)).cast("double").alias("value"))
    return stats.moving_mean(daily, ["txns", "value"])


@query("f11_global_ranks")
def f11(w):
    total, numbers = "total_txn_value", R.row_numbers(
        w.store, "value_numbers", w.c360_table.of(w.customer_360.select("customer_id", "total_txn_value")),
        [F.asc("total_txn_value"), F.asc("customer_id")], "row_number")
    n = w.customer_360.agg(n_rows()).scalar()
    numbers = numbers.withColumn("ntile_10", R.tile_of(c("row_number"), n, 10))
    placed = R.ranked(w.customer_360, "customer_id", [total, "recency_days"], w.value_places, {
        "value_rank": (total, R.rank_of()), "value_percent_rank": (total, R.percent_rank_of()),
        "value_cume_dist": (total, R.cume_dist_of()), "recency_mid_rank": ("recency_days", R.twice_mid_rank_of() / 2),
        "recency_cume_desc": ("recency_days", R.cume_dist_desc_of())})
    return numbers.select("customer_id", "row_number", "ntile_10").join(placed, "customer_id")


@query("f12_city_quantiles")
def f12(w):
    spread = R.distribution(w.store, "city_tickets", w.fact, ["amount"], by=["clean_city"])
    cuts = R.quantiles(spread, {"p10": ("amount", 0.1), "p50": ("amount", 0.5), "p90": ("amount", 0.9)}, ["clean_city"])
    return cuts.select("clean_city", *[S.fixed(c(p), 4).alias(p) for p in ("p10", "p50", "p90")])


@query("g06_priority_page")
def g06(w):
    return cube.page(w.priority_list, 1).select("priority_rank", "masked_id", "tier", "score")


@query("g07_lookup_rows")
def g07(w):
    return cube.lookup_rows(w.view, 150)


# ---- quality
@query("i01_i24_scorecard")
def i01(w):
    return w.dq_log


# ---- segments
def _features(w):
    return w.params.features


@query("b33_k01_feature_vector")
def k01(w):
    raw = segments.raw_features(w.customer_360, {"avg_balance": w.thresholds.select("avg_balance_p50").scalar()})
    return raw.select("customer_id", *[S.fixed(c(f), 6, 10).alias(f) for f in _features(w)])


@query("k02_k03_scaled_features")
def k02(w):
    _ = w.customer_segment
    return w.scaled_features["J"].select("customer_id", *[S.fixed(c(f), 6, 10).alias(f) for f in _features(w)])


@query("k04_kmeans_fit")
def k04(w):
    _ = w.customer_segment
    scaled, names = w.scaled_features["J"], _features(w)
    labelled = segments.nearest(scaled, names, segments.fit_kmeans(scaled, names, 5, w.params.seed, w.starts))
    return segments.relabel(labelled, "J").groupBy("cluster_key").agg(n_rows().alias("customers"))


@query("k04_fit_checks")
def k04b(w):
    """What must hold for any good fit: its labels are the nearest of its centres, its cost is not above that of the literal
    centres, and keys go down by mean score."""
    _ = w.customer_segment
    scaled, names = w.scaled_features["J"], _features(w)
    centers = segments.fit_kmeans(scaled, names, 5, w.params.seed, w.starts)
    labelled = w.store.save("fit_labels", segments.relabel(segments.nearest(scaled, names, centers), "J")).df
    gap = segments.distance_to(names, centers, c("label")) - segments.least_distance(names, centers)
    costs = labelled.agg(n_rows().alias("customers"), F.count_distinct("label").alias("clusters"),
                         (F.max(gap) < 1e-9).alias("labels_are_nearest"),
                         (F.sum(segments.least_distance(names, centers))
                          <= F.sum(segments.least_distance(names, CENTROIDS["J"]))).alias("cost_not_above_literal"))
    means = labelled.groupBy("cluster_key").agg(F.avg("value_score").alias("m"))
    before = F.lag("m").over(Window.orderBy("cluster_key"))  # five rows
    ordered = means.select((before.isNull() | (before >= c("m") - 1e-9)).alias("ok")).agg(F.bool_and("ok")).scalar()
    return costs.withColumn("keys_by_score", ordered)


@query("k05_k15_segment_table")
def k05(w):
    return w.customer_segment.select("customer_id", "cluster_key", "segment_id", "segment_name", "layer", "method")


@query("k06_layered_design")
def k06(w):
    config = {**w.segment_config, "design": "layered", "k": {"S": 3, "R": 3}}
    rows, _, _ = segments.segment(w.store, w.customer_360, config, w.segment_definition, w.params, starts=w.starts)
    return rows.df.groupBy("cluster_key", "layer").agg(n_rows().alias("customers"))


@query("k06_population_checks")
def k06b(w):
    return k06(w).groupBy("layer").agg(F.sum("customers").alias("customers"), n_rows().alias("clusters"))


@query("k07_k_grid")
def k07(w):
    return w.k_selection.drop("customers", "clusters")


@query("k07_grid_checks")
def k07b(w):
    """What must hold for every row of the grid: all customers are labelled, no cluster is empty, a further cluster lowers
    the cost, and the measures are in range."""
    before = F.lag("inertia").over(Window.partitionBy("population").orderBy("k"))  # as many rows as the grid has k
    unit = lambda x: c(x).between(-1, 1)
    return w.k_selection.select(
        "population", "k", "customers", "clusters", F.coalesce(c("inertia") < before, F.lit(True)).alias("cost_falls"),
        (unit("silhouette") & unit("ari_min") & unit("ari_mean") & (c("ari_min") <= c("ari_mean")) & (F.coalesce("calinski_harabasz", F.lit(1.0)) > 0)
         & c("min_cluster_share").between(0, 1 / c("k"))).alias("in_range"))


def _labelled(w):
    _ = w.customer_segment
    return segments.nearest(w.scaled_features["J"], _features(w), CENTROIDS["J"])


@query("k08_silhouette")
def k08(w):
    points = cluster_metrics.silhouette(_labelled(w), _features(w))
    return points.select("customer_id", S.fixed(c("silhouette"), 5, 10).alias("silhouette"))


@query("k08_plain_silhouette")
def k08b(w):
    points = batch_kmeans.plain_silhouette(_labelled(w), _features(w))
    return points.select("customer_id", S.fixed(c("silhouette"), 5, 10).alias("silhouette"),
                         c("silhouette").between(c("low") - 1e-9, c("high") + 1e-9).alias("in_bounds"))


@query("k09_k11_cluster_scatter")
def k09(w):
    one = cluster_metrics.scatter(_labelled(w), _features(w))
    return one.select("k", "n", *[S.fixed(c(x), 4, 10).alias(x) for x in ("inertia", "between", "calinski_harabasz")],
                      S.fixed(c("min_cluster_share"), 6, 10).alias("min_cluster_share"))


@query("k10_adjusted_rand")
def k10(w):
    return cluster_metrics.adjusted_rand(w.view, "cluster_key", "tier").select(
        S.fixed(c("adjusted_rand"), 6, 10).alias("adjusted_rand"))


@query("k12_nearest_centroid")
def k12(w):
    return _labelled(w).select("customer_id", "label")


@query("e11_k13_segment_profile")
def k13(w):
    return w.segment_profile


@query("k13_zscore_profile")
def k13z(w):
    keyed = w.customer_segment
    return segments.zscore_profile(w.scaled_features["J"], keyed, _features(w))


@query("k14_name_guard")
def k14(w):
    profiles = segments.profile(w.store, "cluster_key", w.view, "cluster_key")
    return segments.name_fits(profiles, {s["cluster_key"]: s["expect"] for s in w.segment_config["segments"]})


@query("k16_pca")
def k16(w):
    _ = w.customer_segment
    return segments.pca(w.scaled_features["J"], _features(w))[0]


@query("k16_pca_checks")
def k16b(w):
    """The projections are uncorrelated, and their variances are the explained shares of the total variance."""
    _ = w.customer_segment
    scaled, names = w.scaled_features["J"], _features(w)
    shown, explained = segments.pca(scaled, names)
    total = scaled.agg(sum((F.var_samp(f) for f in names), F.lit(0.0))).scalar()
    share = lambda i: F.abs(F.var_samp(f"pc{i + 1}") / total - F.lit(explained[i])) < 1e-6
    return shown.agg(n_rows().alias("customers"), S.fixed(F.abs(F.corr("pc1", "pc2")), 6, 10).alias("correlation"),
                     (F.var_samp("pc1") >= F.var_samp("pc2")).alias("first_is_larger"),
                     (share(0) & share(1)).alias("shares_are_explained"))


@query("k17_second_method_agreement")
def k17(w):
    return cluster_metrics.adjusted_rand(_linked(w)[1].join(w.customer_segment, "customer_id"), "other", "cluster_key")


def _linked(w):
    _ = w.customer_segment
    scaled, names = w.scaled_features["J"], _features(w)
    linkage = batch_kmeans.ward_linkage(scaled, names, 5, w.params.seed)
    return linkage, batch_kmeans.linked_labels(scaled, names, linkage)


@query("k17_linkage_checks")
def k17b(w):
    """What must hold for a Ward hierarchy over summaries of all rows: heights rise, and they add up with the squares inside
    the summaries to the squares of all rows."""
    linkage, labels = _linked(w)
    rise = all(b >= a - 1e-9 for a, b in zip(linkage.heights, linkage.heights[1:]))
    squares = F.lit(linkage.within_micro + sum(linkage.heights))
    return labels.agg(n_rows().alias("customers"), F.count_distinct("other").alias("clusters"), F.lit(rise).alias("heights_rise"),
                      S.fixed(squares, 2, 6).alias("all_squares"))


# ---- opportunity
@query("l01_percentile_ranks")
def l01(w):
    return w.customer_360.select("customer_id", "pr_balance", "pr_total", "pr_engagement", "pr_ratio")


@query("l02_l04_theme_fits")
def l03(w):
    return O.with_fits(w.customer_360, w.params).select("customer_id", *[f"fit_{t}" for t in L.THEMES])


@query("l05_l06_scores_and_tiers")
def l05(w):
    return w.opportunity.select("customer_id", *[f"os_{t}" for t in L.THEMES], "overall_score", "driving_theme",
                                "priority_rank", "tier")


@query("l07_l08_opportunity_table")
def l08(w):
    return w.opportunity.select(*extracts.OPPORTUNITY_COLUMNS, "evidence_level")


@query("l09_d14_sensitivity")
def l09(w):
    return w.sensitivity


@query("l10_addressable_balance")
def l10(w):
    return w.view.groupBy("tier").agg(publish.addressable().alias("addressable_balance"))


# ---- published aggregates
@query("m01_daily_city")
def m01(w):
    return w.agg_daily_city


@query("m02_hour_weekday")
def m02(w):
    return w.agg_hour_weekday


@query("m03_city_summary")
def m03(w):
    return w.agg_city_summary


@query("m04_segment_summary")
def m04(w):
    return w.agg_segment_summary


@query("d09_m05_theme_segment")
def m05(w):
    return w.agg_theme_segment


@query("m06_kpi_rows")
def m06(w):
    return w.kpis


@query("m07_n09_reconciliation")
def m07(w):
    return publish.reconcile(w.kpis, publish.fact_kpis(w.store, w.fact, w.opportunity, w.params))


# ---- measures
@query("n01_n06_segment_measures")
def n01(w):
    return measures.measures(w.view, ["segment_name"]).join(
        measures.median_balance(w.store, "segment", w.view, ["segment_name"]), "segment_name", "left")


@query("n02_city_measures")
def n02(w):
    return measures.measures(w.view, ["clean_city"], ["total_customers", "active_rate", "high_value_share", "txn_frequency",
                                                      "opportunity_rate", "avg_opportunity_score"], {"gender": "F"})


@query("n03_segment_shares")
def n03(w):
    return measures.segment_shares(w.view, ["gender"])


@query("n07_top_city_value")
def n07(w):
    return measures.top_city_value(w.view)


@query("n08_daily_measures")
def n08(w):
    return measures.daily(w.agg_daily_city, w.dim_date)


@query("n10_page_age_gender")
def n10a(w):
    return measures.measures(w.view, ["age_group", "gender"], ["total_customers"])


@query("n10_page_score_tiers")
def n10b(w):
    banded = w.view.withColumn("score_band", S.score_band(c("overall_score")))
    return measures.measures(banded, ["score_band", "tier"], ["total_customers", "addressable_balance"])


@query("n10_page_theme_matrix")
def n10c(w):
    return measures.measures(w.view, ["segment_name", "age_group"], [f"{t}_signals" for t in L.THEMES])


@query("n10_page_priority_table")
def n10d(w):
    return w.priority_list


@query("n10_page_tier_a_by_city")
def n10e(w):
    return measures.measures(w.view, ["clean_city"], ["tier_a_customers", "opportunity_count"])


# ---- profiling
@query("o01_column_profile")
def o01(w):
    return profiling.columns(w.classified)


@query("o02_money_quantiles")
def o02(w):
    cuts = profiling.money_quantiles(w.store, w.classified)
    return cuts.select("quantile", *[S.fixed(c(m), 4).alias(m) for m in ("amount", "balance")])


@query("o03_money_counters")
def o03(w):
    return profiling.money_counters(w.classified)


@query("o04_date_validity")
def o04(w):
    return profiling.date_validity(w.classified)


@query("a12_o05_daily_coverage")
def o05(w):
    return profiling.daily_counts(*profiling.log_days(w.classified))


@query("o05_coverage_break")
def o05b(w):
    return profiling.coverage_break(profiling.daily_counts(*profiling.log_days(w.classified)), w.params)


@query("o06_rows_per_customer")
def o06(w):
    return profiling.per_customer(w.classified)


@query("o07_attribute_conflicts")
def o07(w):
    return profiling.conflicts(w.classified)


@query("o08_gender_values")
def o08(w):
    return profiling.gender_counts(w.classified)


@query("o08_location_values")
def o08b(w):
    return profiling.location_counts(w.classified)


@query("o09_expected_observed")
def o09(w):
    expected = w.spark.createDataFrame([("Columns", "9"), ("Transaction id unique", "yes"), ("First date", "1995-01-01")],
                                       "item string, expected string")
    return profiling.compare(expected, profiling.observed(w.classified, profiling.columns(w.classified)))


def _event_days(w) -> DataFrame:
    return w.spark.read.parquet(f"{w.folder}/events.parquet").select(F.to_date("ts").alias("date"), "value")


@query("o05_event_coverage")
def o05c(w):
    """Gap-filled days of the event table, whose days are dense."""
    days = _event_days(w)
    ends = days.agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    return profiling.daily_counts(days, ends.select(F.explode(F.sequence("lo", "hi")).alias("date")))


@query("f10_event_moving_mean")
def f10b(w):
    daily = _event_days(w).groupBy("date").agg(n_rows().alias("events"), F.sum(c("value").cast("decimal(28,6)")).cast("double").alias("total"))
    return stats.moving_mean(daily, ["events", "total"])


# ---- statistics
@query("p01_amount_summary")
def p01(w):
    return stats.describe(w.store, "amount", w.fact, "amount")


@query("p01_ticket_by_gender")
def p01b(w):
    return stats.describe(w.store, "ticket_gender", w.view, "avg_txn_value", ["gender"], (0.25, 0.5, 0.75))


@query("p02_amount_histogram")
def p02(w):
    return stats.log_histogram(w.fact, "amount", 59, w.fact.agg(F.max("amount").cast("double")).scalar())


@query("p02_balance_histogram")
def p02b(w):
    return stats.spread_histogram(w.customer_360, "latest_balance", 60)


@query("p02_balance_facts")
def p02c(w):
    marks = {"median": 0.5, "p90": 0.9, "p99": 0.99}
    cuts = R.quantiles(w.value_places, {k: ("latest_balance", q) for k, q in marks.items()})
    known = w.customer_360.where("latest_balance IS NOT NULL")
    return stats.facts({
        **{k: cuts.select(S.fixed(c(k), 2)) for k in marks}, "mean": known.agg(S.fixed(S.mean_of(c("latest_balance")), 2)),
        "near_zero_pct": known.agg(S.percent(F.count_if(c("latest_balance") < 1), n_rows())),
        "top_10_pct": stats.concentration(w.value_places.df, "latest_balance", (0.10,))})


@query("p03_p05_concentration")
def p03(w):
    return stats.concentration(w.value_places.df, "total_txn_value")


@query("p03_balance_concentration")
def p03b(w):
    return stats.concentration(w.value_places.df, "latest_balance", (0.10,))


@query("p04_lorenz_points")
def p04(w):
    return stats.lorenz(w.store, w.value_places.df, "total_txn_value", 50)


@query("p06_city_concentration")
def p06(w):
    cities = w.view.where("clean_city <> 'UNKNOWN'").groupBy("clean_city").agg(
        n_rows().alias("customers"), F.sum("total_txn_value").alias("v"))
    whole = w.view.agg(F.sum("total_txn_value")).scalar()
    top = cities.orderBy(F.desc("v"), "clean_city").limit(15)
    place = F.row_number().over(Window.orderBy(F.desc("v"), "clean_city"))
    upto = Window.orderBy(F.desc("v"), "clean_city").rowsBetween(Window.unboundedPreceding, 0)
    return top.select("clean_city", "customers", place.alias("place"), S.percent(c("v"), whole).alias("value_share"),
                      S.percent(F.sum("v").over(upto), whole).alias("cumulative_share"))


@query("p07_weekend_uplift")
def p07(w):
    days = w.fact.groupBy("date_key").agg(n_rows().alias("n"), F.sum("amount").alias("v")).join(F.broadcast(w.dim_date), "date_key")
    weekend = lambda x: F.sum(F.when(c("is_weekend"), c(x)))
    weekday = lambda x: F.sum(F.when(~c("is_weekend"), c(x)))
    off, on = S.ratio(weekend("n"), F.count_if("is_weekend")), S.ratio(weekday("n"), F.count_if(~c("is_weekend")))
    return days.agg(S.fixed(off, 4).alias("weekend_txns"), S.fixed(on, 4).alias("weekday_txns"),
                    S.fixed(S.ratio(weekend("v"), F.count_if("is_weekend")), 2).alias("weekend_value"),
                    S.fixed(S.ratio(weekday("v"), F.count_if(~c("is_weekend"))), 2).alias("weekday_value"),
                    S.fixed(100 * (off / on - 1), 4, 10).alias("uplift_pct"))


@query("p08_hour_profile")
def p08(w):
    return stats.hour_profile(w.fact).select("day_of_week", "txn_hour", S.fixed(c("txns_per_day"), 4).alias("txns_per_day"))


@query("p08_band_shares")
def p08b(w):
    known = stats.hour_profile(w.fact).where("txn_hour is not null")
    sizes = known.groupBy(S.time_band(c("txn_hour")).alias("time_band")).agg(F.sum("txns_per_day").alias("t"))
    # At most as many rows as there are bands.
    return sizes.select("time_band", S.percent(c("t"), F.sum("t").over(Window.partitionBy()), 1).alias("pct_txns"))


@query("p09_spearman_matrix")
def p09(w):
    return stats.spearman_matrix(w.store, "customers", w.customer_360, "customer_id")


@query("p10_mann_whitney")
def p10(w):
    return stats.mann_whitney(w.store, "ticket", w.customer_360, "avg_txn_value", "gender", "M", "F")


@query("p11_kruskal_by_age")
def p11(w):
    return stats.kruskal(w.store, "age", w.customer_360, ["avg_balance"], "age_group", L.AGE_ORDER[:-1])


@query("p11_kruskal_by_segment")
def p11b(w):
    names = [s["segment_name"] for s in w.segment_config["segments"]]
    columns = ["avg_balance", "total_txn_value", "avg_txn_value", "txn_count", "recency_days", "age"]
    return stats.kruskal(w.store, "segment", w.view, columns, "segment_name", names)


@query("p12_spearman_pair")
def p12(w):
    return stats.spearman_matrix(w.store, "pair", w.customer_360, "customer_id", ("avg_balance", "total_txn_value"))


@query("p13_chi_square_tier")
def p13(w):
    return stats.chi_square(w.customer_360.where("city_tier <> 'Unknown'"), "city_tier", "is_high_value")


@query("p13_chi_square_gender")
def p13b(w):
    return stats.chi_square(w.view.where("gender <> 'Unknown'"), "segment_name", "gender")


@query("p14_high_value_rates")
def p14(w):
    return w.customer_360.groupBy("city_tier").agg(S.percent(F.count_if("is_high_value"), n_rows(), 1).alias("pct_high_value"))


@query("p15_score_histogram")
def p15(w):
    return stats.score_histogram(w.opportunity, "overall_score", "tier", 40)


@query("p16_theme_stats")
def p16(w):
    tall = w.view.select("latest_balance", F.inline(F.array(*[
        F.struct(F.lit(L.THEME_LABELS[t]).alias("theme"), c(f"fit_{t}").alias("fit")) for t in L.THEMES])))
    hit = c("fit") == 1.0
    return tall.groupBy("theme").agg(
        F.count_if(hit).alias("flagged"), S.percent(F.count_if(hit), n_rows()).alias("pct_customers"),
        F.count_if(c("fit") == 0.5).alias("near_miss"),
        F.sum(F.when(hit, c("latest_balance"))).cast("double").alias("addressable_balance"))


@query("p17_tier_table")
def p17(w):
    evidence = [S.percent(F.count_if(c("evidence_level") == e), n_rows(), 1).alias(f"pct_{e.lower()}") for e in L.EVIDENCE_ORDER]
    return w.view.groupBy("tier").agg(
        n_rows().alias("customers"), F.min("overall_score").alias("min_score"), F.max("overall_score").alias("max_score"),
        S.percent(F.count_if("any_signal"), n_rows(), 1).alias("pct_with_signal"),
        publish.addressable().alias("addressable_balance"), *evidence)


@query("p18_hypothesis_evidence")
def p18(w):
    single = w.customer_360.where("txn_count = 1")
    ticket = R.distribution(w.store, "single_tickets", single, ["avg_txn_value"])
    by_age = R.distribution(w.store, "age_balances", w.customer_360, ["avg_balance"], by=["age_group"])
    medians = R.quantiles(by_age, {"m": ("avg_balance", 0.5)}, ["age_group"])
    rates = w.customer_360.groupBy("city_tier").agg(S.percent(F.count_if("is_high_value"), n_rows(), 1).alias("value"))
    top = stats.concentration(w.value_places.df, "latest_balance", (0.10,))
    row = lambda df, h, item, value: df.select(F.lit(h).alias("hypothesis"), item.alias("item"), value.cast("double").alias("value"))
    return (row(top, "H1", F.lit("top 10% share of balance"), c("top_10_pct"))
            .unionByName(row(w.customer_360.agg(S.percent(F.count_if(c("txn_count") == 1), n_rows(), 1).alias("v")),
                             "H2", F.lit("single transaction %"), c("v")))
            .unionByName(row(R.quantiles(ticket, {"m": ("avg_txn_value", 0.5)}), "H2", F.lit("median single ticket"),
                             S.fixed(c("m"), 2)))
            .unionByName(row(medians.where("age_group <> 'Unknown'"), "H3", c("age_group"), S.fixed(c("m"), 2)))
            .unionByName(row(rates.where("city_tier <> 'Unknown'"), "H4", c("city_tier"), c("value"))))


@query("p19_headline_facts")
def p19(w):
    v = w.view
    young = c("age_group").isin("18-24", "25-34")
    day = c("txn_hour").between(12, 20)
    hours = w.agg_hour_weekday
    return stats.facts({
        "single_pct": v.agg(S.percent(F.count_if(c("txn_count") == 1), n_rows())),
        "young_pct": v.agg(S.percent(F.count_if(young), n_rows())),
        "signal_pct": v.agg(S.percent(F.count_if("any_signal"), n_rows())),
        "tier_a": v.agg(F.count_if(c("tier") == "A")),
        "tier_a_min_score": v.where("tier = 'A'").agg(F.min("overall_score")),
        "afternoon_evening_pct": hours.agg(S.percent(F.sum(F.when(day, c("txns"))), F.sum("txns"))),
        **{f"top_{round(100 * s)}_pct": stats.concentration(w.value_places.df, "total_txn_value", (s,))
           for s in (0.01, 0.05, 0.10, 0.20)},
        "gini": stats.concentration(w.value_places.df, "total_txn_value", ()),
        "balance_top_10_pct": stats.concentration(w.value_places.df, "latest_balance", (0.10,)),
        "weekend_uplift_pct": p07(w).select("uplift_pct"),
        "sensitivity_min_overlap": w.sensitivity.agg(F.min(f"top{w.params.overlap_top}_overlap_pct")),
        "sensitivity_max_overlap": w.sensitivity.agg(F.max(f"top{w.params.overlap_top}_overlap_pct")),
        "cities": w.dim_location.agg(n_rows()),
        "raw_locations": w.classified.groupBy("cust_location").agg(n_rows().alias("n")).agg(F.count("cust_location"))})


@query("p19_more_facts")
def p19c(w):
    cities = w.agg_city_summary.orderBy(F.desc("total_value"), "clean_city").limit(5)
    top = cities.agg(F.sum(c("total_value").cast("decimal(38,2)")).alias("v"))
    whole = w.customer_360.agg(F.sum("total_txn_value")).scalar()
    return stats.facts({
        "id_consistent_pct": w.dq_log.where("check_id = 'DQ-20'").select("pass_pct"),
        "top_5_city_pct": top.select(S.percent(c("v"), whole)),
        **{f"theme_{t}": w.view.agg(F.count_if(f"sig_{t}")) for t in L.THEMES},
        "sensitivity_min_rho": w.sensitivity.agg(F.min("spearman_vs_base"))})


@query("p19_tier_facts")
def p19d(w):
    return w.view.groupBy("tier").agg(n_rows().alias("customers"), F.min("overall_score").alias("least_score"),
                                      publish.addressable().alias("addressable_balance"))


@query("p19_theme_rates")
def p19b(w):
    sizes = w.agg_segment_summary.select("segment_id", c("customers"))
    return w.agg_theme_segment.join(F.broadcast(sizes), "segment_id").select(
        "segment_name", "theme", S.fixed(S.ratio(c("flagged_customers"), c("customers")), 6, 10).alias("rate"))


@query("p20_age_distribution")
def p20(w):
    return stats.ordered_shares(w.customer_360, "age_group", L.AGE_ORDER)


# ---- cube
@query("r01_customer_cube")
def r01(w):
    return w.cube


@query("r02_coded_cube")
def r02(w):
    codes = cube.dictionaries(w.spark, w.segment_definition, w.top_cities)
    return cube.coded(w.cube, codes).select("segment", "age_group", "gender", "city", "tier", "evidence", "customers", "value")


@query("r03_sheet_cube")
def r03(w):
    return w.wide_cube


@query("r04_daily_trend")
def r04(w):
    return cube.daily_trend(w.agg_daily_city, w.dim_date, w.dim_location, w.top_cities)


@query("r05_cross_filter_slice")
def r05(w):
    chosen = {"gender": "F", "tier": "C", "city": "Other cities"}
    kept = cube.slice_cube(w.cube, chosen, but="city")
    return kept.groupBy("city").agg(F.sum("customers").alias("customers"), F.sum("any_signal").alias("any_signal"))


@query("r06_cube_ratios")
def r06(w):
    return cube.ratios(w.cube, ["segment_name"])


@query("r07_priority_other_cities")
def r07(w):
    return cube.filter_priority(w.priority_list, w.top_cities, "Other cities", gender="F").select(
        "priority_rank", "masked_id", "city", "tier")


@query("r08_cube_reconciliation")
def r08(w):
    balances = R.distribution(w.store, "view_balances", w.view, ["avg_balance"])
    return publish.reconcile(w.kpis, publish.cube_kpis(w.cube, balances))


@query("r08_cell_reconciliation")
def r08b(w):
    """The cube against the customers, cell by cell: the total, every value of each dimension (a city is one) and the cube's
    own cells."""
    return reconcile.compare_cells(cube.cube_cells(w.cube), cube.customer_cells(w.view, w.top_cities), cube.CELL_MEASURES).select(
        "grain", "cell", "customers", "txns", "value", "any_signal", "addressable", "status")


@query("r08_grain_checksums")
def r08c(w):
    return reconcile.compare_grains(cube.cube_cells(w.cube), cube.customer_cells(w.view, w.top_cities), cube.CELL_MEASURES)


# ---- tables
@query("t01_dim_location")
def t01(w):
    return w.dim_location


@query("t02_dim_date_use")
def t02(w):
    used = w.fact.groupBy("date_key").agg(n_rows().alias("txns"))
    return w.dim_date.join(used, "date_key").groupBy("month_key", "is_weekend").agg(
        n_rows().alias("days"), F.sum("txns").alias("txns"))


@query("t03_fact_transaction")
def t03(w):
    return w.fact.select("transaction_id", "customer_id", "txn_date", "txn_sec", "amount", "balance", "order_key",
                         "date_key", "is_possible_duplicate", "is_high_value_txn", "txn_location_key")


@query("t04_dim_customer")
def t04(w):
    return w.dim_customer


@query("t05_customer_360")
def t05(w):
    return w.customer_360.select(*extracts.CUSTOMER_COLUMNS).withColumn("balance_volatility", S.fixed(c("balance_volatility"), 6, 10))


@query("t06_waterfall")
def t06(w):
    return w.waterfall
