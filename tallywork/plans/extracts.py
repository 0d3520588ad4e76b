"""Everything a run hands over: tables, report extracts, the dashboard document and the question pack."""

from __future__ import annotations

import time
import uuid
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import cube, stats
from ..sources.store import remove_folder, replace_folder
from .questions import QUESTIONS
from .workspace import Workspace

# The columns handed to reports.
CUSTOMER_COLUMNS = (
    "customer_id", "location_key", "age", "age_group", "gender", "clean_city", "city_tier", "txn_count",
    "total_txn_value", "avg_txn_value", "max_txn_value", "active_days", "first_txn_date", "last_txn_date",
    "monthly_txn_frequency", "recency_days", "avg_balance", "latest_balance", "balance_volatility",
    "txn_to_balance_ratio", "activity_trend", "value_score", "engagement_score", "r_score", "f_score", "m_score",
    "rfm_code", "freq_band", "evidence_level", "is_active", "is_high_value", "is_low_engagement", "is_newly_observed",
    "is_dormant")
OPPORTUNITY_COLUMNS = (
    "customer_id", "masked_id", "sig_investment", "sig_premium", "sig_credit_card", "sig_insurance",
    "sig_personal_loan", "sig_reengagement", "signal_count", "any_signal", "overall_score", "driving_theme",
    "driving_theme_label", "priority_rank", "tier", "reason")


def write_table(df: DataFrame, path: str, fmt: str = "parquet", by: str | None = None) -> int:
    """Replaces the table at ``path``; returns its row count, counted while writing. The rows are written beside it and swapped
    in by a rename, so a job that fails leaves the old rows."""
    made, seen = f"{path}.new-{uuid.uuid4().hex[:8]}", Observation()
    writer = df.observe(seen, F.count(F.lit(1)).alias("rows")).write.format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    try:
        (writer.partitionBy(by) if by else writer).save(made)
    except Exception:
        remove_folder(df.sparkSession, made)
        raise
    replace_folder(df.sparkSession, made, path)
    return seen.get["rows"]


def report_tables(w: Workspace) -> dict[str, DataFrame]:
    return {
        "dim_date": w.dim_date, "dim_location": w.dim_location, "customer_360": w.customer_360.select(*CUSTOMER_COLUMNS),
        "customer_segment": w.customer_segment, "customer_opportunity": w.opportunity.select(*OPPORTUNITY_COLUMNS),
        "segment_definition": w.segment_definition, "agg_daily_city": w.agg_daily_city,
        "agg_hour_weekday": w.agg_hour_weekday, "agg_city_summary": w.agg_city_summary,
        "agg_segment_summary": w.agg_segment_summary, "agg_theme_segment": w.agg_theme_segment,
        "kpi_reconciliation": w.kpis, "dq_log": w.dq_log, "row_waterfall": w.waterfall,
        "opportunity_sensitivity": w.sensitivity}


def params_frame(w: Workspace) -> DataFrame:
    p = w.params
    dates = {"as_of_date": p.as_of, "window_start": p.window_start, "window_end": p.window_end,
             "extract_end": p.extract_end, "trend_split_date": p.trend_split}
    numbers = {"window_days": p.window_days, "active_days": p.active_days, "dormant_days": p.dormant_days,
               "newly_observed_days": p.newly_observed_days}
    return w.spark.range(1).select(*[F.lit(v).alias(k) for k, v in (dates | numbers).items()])


def sheet_tables(w: Workspace) -> dict[str, DataFrame]:
    top100 = w.view.orderBy(F.desc("total_txn_value"), "customer_id").limit(100)
    needs = ("segment_id", "segment_name", "potential_needs", "action", "owner", "timing", "kpi")
    return {
        "cube": w.wide_cube, "customer_lookup": cube.lookup_rows(w.view, w.params.priority_rows),
        "tier_a_list": cube.tier_a_list(w.view), "top100_value": top100.select(F.col("priority_rank").alias("customer_ref")),
        "city_top25": w.agg_city_summary.orderBy("value_rank", "clean_city").limit(25), "kpi_sql": w.kpis,
        "segment_definition": w.segment_definition.select(*needs), "params": params_frame(w)}


def write_extracts(tables: dict[str, DataFrame], folder: str, fmt: str = "csv") -> dict[str, int]:
    return {name: write_table(df, f"{folder}/{name}", fmt) for name, df in tables.items()}


def dashboard_sections(w: Workspace) -> dict[str, DataFrame]:
    """The parts of the dashboard document; each is an aggregate or a fixed-length list."""
    codes = cube.dictionaries(w.spark, w.segment_definition, w.top_cities)
    daily = cube.daily_trend(w.agg_daily_city, w.dim_date, w.dim_location, w.top_cities)
    return {
        "meta": params_frame(w), "kpi_reconciliation": w.kpis, "dims": codes, "cube": cube.coded(w.cube, codes),
        "trend": cube.trend_series(daily), "priority": w.priority_list,
        "score_hist": stats.score_histogram(w.opportunity, "overall_score", "tier", 40),
        "segment_definition": w.segment_definition, "segment_summary": w.agg_segment_summary,
        "segment_profile": w.segment_profile, "theme_segment": w.agg_theme_segment,
        "cities": w.agg_city_summary.orderBy("value_rank", "clean_city").limit(50), "hour_weekday": w.agg_hour_weekday,
        "dq": w.dq_log, "waterfall": w.waterfall, "sensitivity": w.sensitivity}


def write_document(spark: SparkSession, sections: dict[str, DataFrame], path: str) -> DataFrame:
    """A document as one folder of JSON lines per section and an index of them. Rows stream from the tasks into the files, so
    no section passes through one cell or task. The index (section, rows, columns) is written last: a document that has
    it is whole."""
    rows = {name: write_table(df, f"{path}/{name}", "json") for name, df in sections.items()}
    index = [(name, rows[name], df.columns) for name, df in sections.items()]
    made = spark.createDataFrame(index, "section string, rows bigint, columns array<string>").coalesce(1)
    write_table(made, f"{path}/index", "json")
    return made


def read_section(spark: SparkSession, path: str, name: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(f"{path}/{name}")


def write_dashboard(w: Workspace, path: str) -> DataFrame:
    return write_document(w.spark, dashboard_sections(w), path)


def checksum(df: DataFrame) -> DataFrame:
    """(rows, checksum): equal for equal contents in any order, whatever the columns' types."""
    shown = [F.coalesce(F.to_json(F.struct(F.col(f"`{c}`").alias("v"))), F.lit("")) for c in df.columns]
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.xxhash64(*shown).cast("decimal(38,0)")).alias("checksum"))


def contents(spark: SparkSession, tables: dict[str, DataFrame], folder: str, fmt: str) -> DataFrame:
    """(extract, rows, same): whether each written extract reads back as the table it was made from."""
    parts = []
    for name, df in tables.items():
        read = spark.read.schema(df.schema).format(fmt)
        back = checksum((read.option("header", True) if fmt == "csv" else read).load(f"{folder}/{name}"))
        made = checksum(df).select(F.struct("rows", "checksum").alias("_made"))
        parts.append(back.crossJoin(made).select(  # one row each
            F.lit(name).alias("extract"), "rows", (F.struct("rows", "checksum").eqNullSafe(F.col("_made"))).alias("same")))
    return reduce(DataFrame.unionByName, parts)


def masked(df: DataFrame) -> DataFrame:
    """Customer ids are not handed out."""
    if "customer_id" not in df.columns:
        return df
    return df.withColumn("customer_id", S.mask_id(F.col("customer_id")))


def answers(w: Workspace) -> dict[str, DataFrame]:
    return {qid: masked(fn(w)) for qid, (_, fn) in QUESTIONS.items()}


def write_answers(w: Workspace, folder: str) -> DataFrame:
    """Runs and writes the question pack; returns its index (id, title, rows, seconds)."""
    index = []
    for qid, (title, fn) in QUESTIONS.items():
        start = time.perf_counter()
        rows = write_table(masked(fn(w)), f"{folder}/{qid}", "csv")
        index.append((qid, title, rows, time.perf_counter() - start))
    made = w.spark.createDataFrame(index, "question string, title string, rows bigint, seconds double")
    write_table(made, f"{folder}/index", "csv")
    return made


def segment_model(w: Workspace) -> DataFrame:
    """Fitted preprocessing per population and feature, with the centre of every cluster."""
    rows = []
    for prefix, (prep, centers) in w.segment_fits.items():
        for i, (feature, low, high, mean, scale) in enumerate(prep.as_rows()):
            rows.append((prefix, feature, low, high, mean, scale, [float(x[i]) for x in centers]))
    return w.spark.createDataFrame(rows, "population string, feature string, low double, high double, mean double, "
                                         "scale double, centers array<double>")
