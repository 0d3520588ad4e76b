"""One (columns, statement body) pair per query of the catalog that SQL can express."""

from __future__ import annotations

from itertools import combinations

from . import tables as T
from .fixed import CHECKS, CORRELATED, L, P, RAW_COLUMNS, SCENARIOS
from .tables import bands, BAL_BAND, D, FEATS, best, div, fix, mean, pct

Q: dict[str, tuple[str, str]] = {}
DAY = "CAST({0} AS VARCHAR) AS {0}"
THEMES = L.THEMES


def raw(column: str) -> str:
    return f"CASE WHEN {column} IN ('', 'nan') THEN NULL ELSE {column} END"


# questions
Q["q01_clean_transactions_and_distinct"] = ("clean_transactions:i distinct_customers:i total_txn_value_inr:d waterfall_clean_rows:i", """
 SELECT count(*) AS clean_transactions, count(DISTINCT customer_id) AS distinct_customers, sum(amount) AS total_txn_value_inr,
   (SELECT rows FROM waterfall WHERE step_no = 99) AS waterfall_clean_rows FROM fact""")
Q["q02_rows_rejected_by_reason"] = Q["t06_waterfall"] = ("step_no:i step rows:i", "SELECT * FROM waterfall")
Q["q03_top_100_customers_by"] = ("customer_id clean_city txn_count:i total_txn_value:d latest_balance:d value_rank:i", """
 SELECT *, rank() OVER (ORDER BY total_txn_value DESC) AS value_rank FROM c360 ORDER BY total_txn_value DESC, customer_id LIMIT 100""")
Q["q04_top_100_customers_by"] = ("customer_id clean_city avg_balance:d latest_balance:d txn_count:i balance_rank:i", """
 SELECT *, rank() OVER (ORDER BY avg_balance DESC) AS balance_rank FROM c360 WHERE avg_balance IS NOT NULL
 ORDER BY avg_balance DESC, customer_id LIMIT 100""")
Q["q05_cities_with_the_highest"] = ("clean_city total_txn_value:d txns:i city_rank:i", """
 SELECT clean_city, sum(total_txn_value) AS total_txn_value, sum(txn_count) AS txns,
   rank() OVER (ORDER BY sum(total_txn_value) DESC) AS city_rank FROM c360 WHERE clean_city <> 'UNKNOWN' GROUP BY 1
 ORDER BY 2 DESC, 1 LIMIT 25""")
Q["q06_cities_with_the_most"] = ("clean_city customers:i total_txn_value:d value_per_customer:d", f"""
 SELECT clean_city, count(*) AS customers, sum(total_txn_value) AS total_txn_value,
   {fix(div('sum(total_txn_value)', 'count(*)'), 2)} AS value_per_customer FROM c360 WHERE clean_city <> 'UNKNOWN'
 GROUP BY 1 HAVING count(*) >= {P.min_city_customers} ORDER BY 2 DESC, 1 LIMIT 25""")
Q["q07_share_of_high_value"] = ("pct_txns_high_value:d pct_value_high_value:d p95_amount_inr:d", f"""
 SELECT {pct('count(*) FILTER (WHERE is_high_value_txn)', 'count(*)')} AS pct_txns_high_value,
   {pct('sum(amount) FILTER (WHERE is_high_value_txn)', 'sum(amount)')} AS pct_value_high_value, (SELECT v FROM p95) AS p95_amount_inr FROM fact""")
Q["q08_value_deciles_of_customers"] = ("value_decile:i customers:i decile_value:d pct_of_value:d cumulative_pct:d", f"""
 SELECT value_decile, customers, v AS decile_value, {pct('v', 'sum(v) OVER ()')} AS pct_of_value,
   {pct('sum(v) OVER (ORDER BY value_decile)', 'sum(v) OVER ()')} AS cumulative_pct
 FROM (SELECT value_decile, count(*) AS customers, sum(total_txn_value) AS v FROM
   (SELECT total_txn_value, ntile(10) OVER (ORDER BY total_txn_value DESC) AS value_decile FROM c360) GROUP BY 1)""")
Q["q09_ticket_size_by_gender"] = ("dimension value txns:i avg_txn_value:d median_txn_value:d", " UNION ALL ".join(f"""
 SELECT '{g}' AS dimension, d.{g} AS value, count(*) AS txns, {fix(div('sum(amount)', 'count(*)'), 2)} AS avg_txn_value,
   quantile_cont(CAST(amount AS DOUBLE), 0.5) AS median_txn_value FROM fact f JOIN dimc d USING (customer_id) GROUP BY 2"""
    for g in ("gender", "age_group")))
Q["q10_customers_by_number_of"] = ("txns_per_customer customers:i pct_customers:d", f"""
 SELECT CASE WHEN txn_count < 3 THEN CAST(txn_count AS VARCHAR) ELSE '3+' END AS txns_per_customer, count(*) AS customers,
   {pct('count(*)', 'sum(count(*)) OVER ()')} AS pct_customers FROM c360 GROUP BY 1""")
Q["q11a_monthly_counts_and_values"] = ("month_key month_name txns:i total_value:d days_in_window:i txns_per_day:d", f"""
 SELECT month_key, month_name, count(*) AS txns, sum(amount) AS total_value, count(DISTINCT date) AS days_in_window,
   {fix(div('count(*)', 'count(DISTINCT date)'), 0)} AS txns_per_day FROM fact JOIN days USING (date_key) GROUP BY 1, 2""")
Q["q11b_weekly_counts_and_values"] = ("week_start:s txns:i total_value:d days_in_week:i running_txns:i", """
 SELECT week_start, count(*) AS txns, sum(amount) AS total_value, count(DISTINCT date) AS days_in_week,
   sum(count(*)) OVER (ORDER BY week_start) AS running_txns FROM fact JOIN days USING (date_key) GROUP BY 1""")
Q["q12_activity_by_weekday_and"] = ("dimension value sort_key:i txns:i avg_txns_per_day:d", f"""
 SELECT 'day_of_week' AS dimension, d.day_of_week AS value, day_of_week_num AS sort_key, count(*) AS txns,
   {fix(div('count(*)', 'count(DISTINCT date)'), 0)} AS avg_txns_per_day FROM fact JOIN days d USING (date_key) GROUP BY 2, 3
 UNION ALL SELECT 'time_band', time_band, min(txn_hour), count(*), NULL FROM fact GROUP BY 2""")
Q["q13_customers_with_declining_activity"] = ("customer_id clean_city txn_count:i txns_first_half:i txns_second_half:i last_txn_date:s recency_days:i", """
 SELECT * FROM c360 WHERE activity_trend = 'Declining'
 ORDER BY txns_first_half - txns_second_half DESC, total_txn_value DESC, customer_id LIMIT 100""")
Q["q14_top_3_customers_in"] = ("customer_id clean_city total_txn_value:d rank_in_city:i", """
 SELECT *, rank() OVER (PARTITION BY clean_city ORDER BY total_txn_value DESC) AS rank_in_city FROM c360
 WHERE clean_city IN (SELECT clean_city FROM c360 WHERE clean_city <> 'UNKNOWN' GROUP BY 1
                      ORDER BY sum(total_txn_value) DESC, clean_city LIMIT 10)
 QUALIFY rank_in_city <= 3""")
Q["q15_balance_deciles"] = ("balance_decile:i customers:i min_balance:d max_balance:d mean_balance:d", f"""
 SELECT balance_decile, count(*) AS customers, min(avg_balance) AS min_balance, max(avg_balance) AS max_balance,
   {fix(mean('avg_balance'), 2)} AS mean_balance FROM (SELECT avg_balance, ntile(10) OVER (ORDER BY avg_balance) AS balance_decile
   FROM c360 WHERE avg_balance IS NOT NULL) GROUP BY 1""")
Q["q16_recency_and_value_score"] = ("r_score:i m_score:i customers:i avg_recency:d avg_txns:d avg_value:d", f"""
 SELECT r_score, m_score, count(*) AS customers, {fix(div('sum(recency_days)', 'count(*)'), 1)} AS avg_recency,
   {fix(div('sum(txn_count)', 'count(*)'), 2)} AS avg_txns, {fix(div('sum(total_txn_value)', 'count(*)'), 0)} AS avg_value
 FROM c360 GROUP BY 1, 2""")
Q["q17_customers_per_balance_band"] = ("balance_band customers:i pct_customers:d", f"""
 SELECT {BAL_BAND('latest_balance')} AS balance_band, count(*) AS customers,
   {pct('count(*)', 'sum(count(*)) OVER ()')} AS pct_customers FROM c360 GROUP BY 1""")
Q["q18_high_balance_with_low"] = ("customer_id clean_city avg_balance:d txn_count:i recency_days:i engagement_score:d", """
 SELECT * FROM c360 WHERE avg_balance >= (SELECT avg_balance_p75 FROM thr) AND is_low_engagement
 ORDER BY avg_balance DESC, customer_id LIMIT 100""")
Q["q19_balances_by_city_tier"] = ("level name customers:i mean_avg_balance:d median_avg_balance:d", " UNION ALL ".join(f"""
 SELECT '{level}' AS level, {col} AS name, count(*) AS customers, {fix(mean('avg_balance'), 0)} AS mean_avg_balance,
   quantile_cont(avg_balance, 0.5) AS median_avg_balance FROM c360 WHERE {test} GROUP BY 2""" for level, col, test in (
    ("city_tier", "city_tier", "true"),
    ("top20_city", "clean_city", "clean_city IN (SELECT clean_city FROM c360 WHERE clean_city <> 'UNKNOWN' GROUP BY 1 "
                                 "ORDER BY count(*) DESC, clean_city LIMIT 20)"))))
Q["q20_highest_ticket_to_balance"] = ("customer_id clean_city avg_txn_value:d latest_balance:d ratio_4:d".replace("ratio_4", "txn_to_balance_ratio"), f"""
 SELECT customer_id, clean_city, avg_txn_value, latest_balance, {fix('r', 4, 10)} AS txn_to_balance_ratio FROM
   (SELECT *, txn_to_balance_ratio AS r FROM c360 WHERE txn_to_balance_ratio IS NOT NULL ORDER BY txn_to_balance_ratio DESC, customer_id LIMIT 100)""")
Q["q21_share_of_customers_with"] = ("customers:i pct_dob_missing_or_invalid:d pct_gender_unknown:d pct_location_unknown:d", f"""
 SELECT count(*) AS customers, {pct('count(*) FILTER (WHERE dob IS NULL)', 'count(*)')} AS pct_dob_missing_or_invalid,
   {pct("count(*) FILTER (WHERE gender = 'Unknown')", 'count(*)')} AS pct_gender_unknown,
   {pct("count(*) FILTER (WHERE clean_city = 'UNKNOWN')", 'count(*)')} AS pct_location_unknown FROM dimc""")
Q["q22_customers_with_conflicting_attributes"] = ("dob_conflicts:i gender_conflicts:i location_conflicts:i any_conflict:i repeat_customers:i", """
 SELECT count_if(dob_conflict) AS dob_conflicts, count_if(gender_conflict) AS gender_conflicts,
   count_if(location_conflict) AS location_conflicts, count_if(dob_conflict OR gender_conflict OR location_conflict) AS any_conflict,
   (SELECT count(*) FROM c360 WHERE txn_count > 1) AS repeat_customers FROM dimc""")
Q["q23_segment_size_and_value"] = ("segment_name customers:i pct_customers:d total_value:d pct_value:d mean_avg_balance:d", f"""
 SELECT segment_name, count(*) AS customers, {pct('count(*)', 'sum(count(*)) OVER ()')} AS pct_customers,
   sum(total_txn_value) AS total_value, {pct('sum(total_txn_value)', 'sum(sum(total_txn_value)) OVER ()')} AS pct_value,
   {fix(mean('avg_balance'), 0)} AS mean_avg_balance FROM view GROUP BY 1""")
Q["q24_signals_by_theme_and"] = ("segment_name investment:i premium_account:i credit_card:i insurance:i personal_loan:i reengagement:i any_signal:i customers:i", """
 SELECT segment_name, count_if(sig_investment) AS investment, count_if(sig_premium) AS premium_account,
   count_if(sig_credit_card) AS credit_card, count_if(sig_insurance) AS insurance, count_if(sig_personal_loan) AS personal_loan,
   count_if(sig_reengagement) AS reengagement, count_if(any_signal) AS any_signal, count(*) AS customers
 FROM view GROUP BY GROUPING SETS ((segment_name), ())""")
Q["q25_top_20_tier_a"] = ("clean_city rank_in_city:i customer_id overall_score:d driving_theme", f"""
 SELECT clean_city, rank_in_city, customer_id, {fix('s', 2)} AS overall_score, driving_theme FROM (
   SELECT clean_city, customer_id, overall_score AS s, driving_theme,
     row_number() OVER (PARTITION BY clean_city ORDER BY overall_score DESC, customer_id) AS rank_in_city
   FROM view WHERE tier = 'A' AND clean_city <> 'UNKNOWN') WHERE rank_in_city <= 20 AND clean_city IN (
   SELECT clean_city FROM view WHERE tier = 'A' AND clean_city <> 'UNKNOWN' GROUP BY 1 ORDER BY count(*) DESC, clean_city LIMIT 5)""")
_AB = div("count(*) FILTER (WHERE tier IN ('A', 'B'))", "count(*)")
Q["q26_cities_with_many_priority"] = ("clean_city customers:i pct_tier_ab:d avg_engagement:d avg_txns:d", f"""
 SELECT clean_city, customers, {fix('100 * s', 2, 10)} AS pct_tier_ab, {fix('e', 2, 10)} AS avg_engagement, {fix('t', 3, 10)} AS avg_txns
 FROM (SELECT clean_city, count(*) AS customers, {_AB} AS s, {mean('engagement_score')} AS e, {div('sum(txn_count)', 'count(*)')} AS t
   FROM view WHERE clean_city <> 'UNKNOWN' GROUP BY 1 HAVING count(*) >= {P.min_city_customers})
 WHERE s > (SELECT {_AB} FROM view) AND e < (SELECT {mean('engagement_score')} FROM view) ORDER BY s DESC, clean_city LIMIT 20""")

# sources and sinks
Q["a01_csv_staging"] = (" ".join(RAW_COLUMNS), "SELECT " + ", ".join(f"nullif({c}, '') AS {c}" for c in RAW_COLUMNS) + " FROM stg")
Q["a02_file_ledger"] = ("year rows_loaded:i text_bytes:i malformed_rows:i whole_files:b", "SELECT right(transaction_date, 2) AS year, "
                        "count(*) AS rows_loaded, sum(" + " + ".join(f"strlen({c})" for c in RAW_COLUMNS)
                        + ") AS text_bytes, 0 AS malformed_rows, true AS whole_files FROM stg GROUP BY 1")
Q["a02_load_audit"] = ("rows_loaded:i text_bytes:i", "SELECT count(*) AS rows_loaded, sum(" + " + ".join(
    f"strlen({c})" for c in RAW_COLUMNS) + ") AS text_bytes FROM stg")
Q["m01_daily_city"] = Q["a06_replace_table"] = ("date_key:i location_key:i txns:i total_value:d high_value_txns:i customers:i", "SELECT * FROM dailyc")
_COUNTS = {
    "dim_date": "days", "dim_location": "loc", "customer_360": "c360", "customer_segment": "seg", "customer_opportunity": "opp",
    "segment_definition": "defs", "agg_daily_city": "dailyc", "kpi_reconciliation": "kpi", "row_waterfall": "waterfall"}
_SIZES = [f"SELECT '{k}' AS extract, count(*) AS rows FROM {t}" for k, t in _COUNTS.items()]
Q["a07_report_extracts"] = ("extract rows:i", " UNION ALL ".join(_SIZES + [
    "SELECT 'agg_hour_weekday', count(*) FROM (SELECT DISTINCT day_of_week, txn_hour FROM fact)",
    "SELECT 'agg_city_summary', count(DISTINCT clean_city) FROM dimc WHERE clean_city <> 'UNKNOWN'",
    "SELECT 'agg_segment_summary', count(DISTINCT segment_id) FROM seg", "SELECT 'agg_theme_segment', 6 * count(DISTINCT segment_id) FROM seg",
    "SELECT 'dq_log', 24", "SELECT 'opportunity_sensitivity', 8"]))
_WIDE = "segment_id, segment_name, age_group, gender, city, city_tier, tier, evidence_level, balance_band"
_CITY = lambda other, unknown: (f"CASE WHEN clean_city IN (SELECT clean_city FROM topc) THEN clean_city "  # noqa: E731
                                f"WHEN clean_city = 'UNKNOWN' THEN '{unknown}' ELSE '{other}' END")
_LOOKUP = lambda n: f"""SELECT priority_rank AS customer_ref, masked_id, clean_city AS city, segment_name AS segment, age_group, gender,
   txn_count, total_txn_value AS total_value, latest_balance, recency_days, tier, {fix('overall_score', 2)} AS score,
   driving_theme_label AS theme, evidence_level, city_tier FROM view WHERE priority_rank <= {n} OR customer_id IN (
     SELECT customer_id FROM c360 ORDER BY total_txn_value DESC, customer_id LIMIT 100)"""  # noqa: E731
Q["a08_sheet_extracts"] = ("extract rows:i", f"""
 SELECT 'cube' AS extract, count(*) AS rows FROM (SELECT DISTINCT segment_id, age_group, gender, {_CITY('OTHER CITIES', 'UNKNOWN')},
   city_tier, tier, evidence_level, {BAL_BAND('latest_balance')} FROM view)
 UNION ALL SELECT 'customer_lookup', count(*) FROM ({_LOOKUP(P.priority_rows)})
 UNION ALL SELECT 'tier_a_list', least(count(*), 300) FROM view WHERE tier = 'A'
 UNION ALL SELECT 'top100_value', least(count(*), 100) FROM view
 UNION ALL SELECT 'city_top25', least(count(DISTINCT clean_city), 25) FROM view WHERE clean_city <> 'UNKNOWN'
 UNION ALL SELECT 'kpi_sql', count(*) FROM kpi UNION ALL SELECT 'segment_definition', count(*) FROM defs UNION ALL SELECT 'params', 1""")
_BUCKET = _CITY("Other cities", "Unknown")
Q["a09_dashboard_document"] = ("section rows:i", " UNION ALL ".join(
    [f"SELECT '{k}' AS section, count(*) AS rows FROM {t}" for k, t in (("kpi_reconciliation", "kpi"), ("segment_definition", "defs"), ("waterfall", "waterfall"))]
    + [f"SELECT '{k}', {n}" for k, n in (("meta", 1), ("dq", 24), ("sensitivity", 8))]
    + [f"SELECT '{k}', count(DISTINCT segment_id) * {n} FROM seg" for k, n in (("segment_summary", 1), ("segment_profile", 1), ("theme_segment", 6))]
    + [f"SELECT 'dims', {len(L.AGE_ORDER) + len(L.GENDER_ORDER) + len(L.TIER_ORDER) + len(L.EVIDENCE_ORDER)} + (SELECT count(*) FROM defs) + count(*) + 2 FROM topc",
       f"SELECT 'cube', count(*) FROM (SELECT DISTINCT segment_name, age_group, gender, {_BUCKET}, tier, evidence_level FROM view)",
       f"SELECT 'trend', count(DISTINCT {_BUCKET}) FROM dimc", f"SELECT 'priority', least(count(*), {P.priority_rows}) FROM view",
       "SELECT 'score_hist', count(*) FROM (SELECT DISTINCT tier, least(floor(overall_score / 100 * 40), 40) FROM opp)",
       "SELECT 'cities', least(count(DISTINCT clean_city), 50) FROM view WHERE clean_city <> 'UNKNOWN'",
       "SELECT 'hour_weekday', count(*) FROM (SELECT DISTINCT day_of_week, txn_hour FROM fact)"]))
Q["a10_answer_index"] = ("question rows:i", " UNION ALL ".join(
    f"SELECT 'Q{k[1:].split('_')[0]}' AS question, count(*) AS rows FROM ({body})" for k, (_, body) in Q.items() if k.startswith("q")))
for _made, _from, _name in (("a07_report_contents", "a07_report_extracts", "extract"), ("a08_sheet_contents", "a08_sheet_extracts", "extract"),
                            ("a09_dashboard_contents", "a09_dashboard_document", "section"), ("a10_answer_contents", "a10_answer_index", "question")):
    Q[_made] = (f"{_name} rows:i same:b", f"SELECT *, true AS same FROM ({Q[_from][1]})")
Q["a11_segment_model"] = ("population feature low:d high:d mean:d scale:d", " UNION ALL ".join(f"""
 SELECT 'J' AS population, '{f}' AS feature, {fix(f'(SELECT quantile_cont({f}, 0.01) FROM rawf)', 5, 10)} AS low,
   {fix(f'(SELECT quantile_cont({f}, 0.99) FROM rawf)', 5, 10)} AS high, {fix(f'avg({f})', 5, 10)} AS mean,
   {fix(f'stddev_pop({f})', 5, 10)} AS scale FROM capped""" for f in FEATS))

Q["a11_stored_model_scores"] = ("customer_id cluster_key segment_id:i segment_name", """
 SELECT customer_id, cluster_key, segment_id, segment_name FROM later_labels JOIN keys USING (label) JOIN defs USING (cluster_key)""")

# projections
Q["b01_b05_typed_columns"] = ("src_row:i txn_id cust_id txn_date dob_parsed txn_sec:i amount:d balance_parsed:d location_norm valid_id:b",
                              "SELECT *, regexp_full_match(cust_id, 'C[0-9]+') AS valid_id FROM typed")
Q["b06_b11_clean_rows"] = ("transaction_id txn_seq:i customer_id txn_date txn_sec:i amount:d balance:d dob gender clean_city raw_location "
                           "dob_missing:b dob_placeholder:b dob_future:b balance_missing:b balance_negative:b time_invalid:b gender_other_value:b",
                           "SELECT * FROM clean")
Q["b12_b17_fact_columns"] = ("transaction_id order_key:i date_key:i txn_hour:i time_band day_of_week amount_band balance_band "
                             "is_high_value_txn:b is_zero_balance:b txn_location_key:i", "SELECT * FROM fact")
Q["b17_calendar_activity"] = ("date_key:i date year:i month:i month_name month_key week_start iso_week:i day_of_week day_of_week_num:i "
                              "is_weekend:b days_before_as_of:i txns:i",
                              "SELECT * FROM days LEFT JOIN (SELECT date_key, count(*) AS txns FROM fact GROUP BY 1) USING (date_key)")
Q["b18_b20_customer_age"] = ("customer_id age:i age_group age_known:b age_out_of_range:b dq_flag", "SELECT * FROM dimc")
Q["b21_city_tiers"] = ("city_tier customers:i", "SELECT city_tier, count(*) AS customers FROM dimc GROUP BY 1")
_FEATURES = ("customer_id avg_txn_value:d monthly_txn_frequency:d balance_volatility:d txn_to_balance_ratio:d evening_night_share:d "
             "activity_trend engagement_score:d freq_band evidence_level is_active:b is_newly_observed:b is_dormant:b is_zero_balance:b rfm_code")
_C360 = f"SELECT * REPLACE ({fix('balance_volatility', 6, 10)} AS balance_volatility) FROM c360"
Q["b22_b27_customer_features"] = (_FEATURES, _C360)
Q["b28_b30_priority_text"] = ("customer_id masked_id driving_theme driving_theme_label reason", "SELECT * FROM opp")
Q["b31_b32_score_bands"] = ("tier score_band:i contact_plan customers:i", """
 SELECT tier, floor(overall_score / 5) * 5 AS score_band, CASE WHEN overall_score >= 95 THEN 'Call this week'
   WHEN overall_score >= 90 THEN 'Call within 2 weeks' ELSE 'Include in campaign' END AS contact_plan, count(*) AS customers
 FROM opp GROUP BY ALL""")
Q["b34_city_buckets"] = ("city customers:i value:d", f"""
 SELECT {_CITY('Other cities', 'Unknown')} AS city, count(*) AS customers, sum(total_txn_value) AS value FROM view GROUP BY 1""")
Q["b35_guarded_city_rates"] = ("clean_city late_per_early:d", f"""
 SELECT clean_city, {div('sum(txns_second_half)', 'sum(txns_first_half)')} AS late_per_early FROM view GROUP BY 1""")
Q["b36_b38_b40_scores"] = ("customer_id is_high_value:b is_low_engagement:b value_score:d recency_days:i r_score:i f_score:i m_score:i", "SELECT * FROM c360")
Q["b37_high_value_transactions"] = ("transaction_id amount:d", "SELECT * FROM fact WHERE is_high_value_txn")
Q["c01_reject_reasons"] = ("src_row:i reject_reason", "SELECT * FROM classified")
Q["c02_rejected_rows"] = ("src_row:i " + " ".join(RAW_COLUMNS) + " reject_reason", "SELECT * FROM classified WHERE reject_reason IS NOT NULL")
Q["c04_repeated_ids"] = ("src_row:i txn_id", """
 SELECT src_row, txn_id FROM typed t WHERE txn_id <> '' AND EXISTS (
   SELECT 1 FROM typed o WHERE o.txn_id = t.txn_id AND o.src_row < t.src_row)""")
Q["c05_possible_duplicates"] = ("transaction_id customer_id", "SELECT * FROM clean WHERE is_possible_duplicate")
Q["d01_variant_lookup"] = ("raw_location clean_city rows:i", "SELECT raw_location, clean_city, count(*) AS rows FROM clean GROUP BY 1, 2")
Q["d02_d11_customer_view"] = ("customer_id clean_city segment_name tier total_txn_value:d overall_score:d", "SELECT * FROM view")
Q["d06_d15_key_checks"] = ("check_name violations:i", " UNION ALL ".join(
    [f"SELECT '{n}' AS check_name, count(*) - count(DISTINCT {k}) AS violations FROM {t}" for n, t, k in (
        ("dim_location", "loc", "location_key"), ("dim_date", "days", "date_key"), ("fact_transaction", "fact", "transaction_id"),
        ("dim_customer", "dimc", "customer_id"), ("customer_360", "c360", "customer_id"))]
    + [f"SELECT '{n}', count(*) FROM {a} WHERE {k} NOT IN (SELECT {k} FROM {b})" for n, a, b, k in (
        ("fact_customer", "fact", "dimc", "customer_id"), ("fact_date", "fact", "days", "date_key"),
        ("customer_location", "dimc", "loc", "location_key"))]))
_SPOT = f"""SELECT f.transaction_id, f.amount AS kept_amount, {T.money('s.transaction_amount')} AS raw_amount, trim(s.transaction_date) AS day_text,
   f.amount = {T.money('s.transaction_amount')} AND f.customer_id = trim(s.customer_id)
   AND concat(day(f.txn_date), '/', month(f.txn_date), '/', strftime(f.txn_date, '%y')) = trim(s.transaction_date) AS matches
 FROM (SELECT * FROM fact ORDER BY md5(transaction_id), transaction_id LIMIT 50) f JOIN stg s ON trim(s.transaction_id) = f.transaction_id"""
Q["d10_g05_spot_check"] = ("transaction_id kept_amount:d raw_amount:d day_text matches:b", _SPOT)
Q["d12_lookup_with_default"] = ("customer_ref:i masked_id score:d theme latest_balance:d city segment contact_plan", f"""
 SELECT priority_rank AS customer_ref, masked_id, {fix('overall_score', 2)} AS score, driving_theme_label AS theme,
   round(latest_balance, 0) AS latest_balance, CASE WHEN city_tier = 'Other' THEN 'n/a' ELSE clean_city END AS city,
   CASE WHEN city_tier = 'Other' THEN 'n/a' ELSE segment_name END AS segment,
   CASE WHEN {fix('overall_score', 2)} >= 95 THEN 'Call this week' WHEN {fix('overall_score', 2)} >= 90 THEN 'Call within 2 weeks'
     ELSE 'Include in campaign' END AS contact_plan FROM view WHERE tier = 'A' ORDER BY priority_rank LIMIT 300""")
Q["e01_e04_customer_base"] = ("customer_id txn_count:i total_txn_value:d max_txn_value:d min_txn_value:d active_days:i first_txn_date last_txn_date "
                              "avg_balance:d max_balance:d min_balance:d balance_obs:i latest_balance:d txns_first_half:i txns_second_half:i "
                              "high_value_txn_count:i", "SELECT * FROM perc")
Q["e06_most_frequent_values"] = ("customer_id clean_city clean_city_values:i gender gender_values:i", """
 SELECT customer_id, c.v AS clean_city, c.n_values AS clean_city_values, g.v AS gender, g.n_values AS gender_values
 FROM pick_city c FULL JOIN pick_gender g USING (customer_id)""")
Q["e12_segment_tier_shares"] = ("segment_name A:d B:d C:d Watch:d", "SELECT segment_name, " + ", ".join(
    pct(f"count(*) FILTER (WHERE tier = '{t}')", "count(*)") + f" AS {t}" for t in L.TIER_ORDER) + " FROM view GROUP BY 1")
Q["e13_weekday_hour_grid"] = ("day_of_week_num:i " + " ".join(f"h{h:02d}:i" for h in range(24)), "SELECT isodow(txn_date) AS day_of_week_num, " + ", ".join(
    f"count(*) FILTER (WHERE txn_hour = {h}) AS h{h:02d}" for h in range(24)) + " FROM fact GROUP BY 1")
Q["e13_segment_age_pivot"] = ("segment_name " + " ".join(f"age{i}:i" for i in range(len(L.AGE_ORDER))), "SELECT segment_name, " + ", ".join(
    f"count(*) FILTER (WHERE age_group = '{a}') AS age{i}" for i, a in enumerate(L.AGE_ORDER)) + " FROM view GROUP BY 1")
Q["e13_city_tier_pivot"] = ("city A:i B:i C:i Watch:i", f"SELECT {_BUCKET} AS city, " + ", ".join(
    f"count(*) FILTER (WHERE tier = '{t}') AS {t}" for t in L.TIER_ORDER) + " FROM view GROUP BY 1")
Q["e14_sheet_cells"] = ("balance_band customers_f:i customers_m:i customers_unknown:i tier_a_high:i signals_unknown_city:i", f"""
 SELECT {BAL_BAND('latest_balance')} AS balance_band, count_if(gender = 'F') AS customers_f, count_if(gender = 'M') AS customers_m,
   count_if(gender = 'Unknown') AS customers_unknown, count_if(tier = 'A' AND evidence_level = 'High') AS tier_a_high,
   count_if(any_signal AND clean_city = 'UNKNOWN') AS signals_unknown_city FROM view GROUP BY 1""")
Q["e16_thresholds"] = ("latest_balance_p90:d total_txn_value_p90:d engagement_p25:d avg_balance_p50:d avg_balance_p75:d avg_balance_p90:d txn_amount_p95:d",
                       "SELECT * FROM thr")
_MA = lambda x: (f"CASE WHEN count(*) OVER s = 7 THEN {fix(f'CAST(sum(CAST({x} AS DECIMAL(38,4))) OVER s AS DOUBLE) / 7', 4)} END AS {x}_7d")
Q["f10_moving_mean"] = ("date txns:i value:d txns_7d:d value_7d:d", f"""
 SELECT date, txns, value, {_MA('txns')}, {_MA('value')} FROM (SELECT date, count(amount) AS txns, coalesce(sum(amount), 0) AS value
   FROM days LEFT JOIN fact USING (date_key) GROUP BY 1) WINDOW s AS (ORDER BY date ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)""")
Q["f11_global_ranks"] = ("customer_id row_number:i ntile_10:i value_rank:i value_percent_rank:d value_cume_dist:d recency_mid_rank:d recency_cume_desc:d", """
 SELECT customer_id, row_number() OVER (ORDER BY total_txn_value, customer_id) AS row_number,
   ntile(10) OVER (ORDER BY total_txn_value, customer_id) AS ntile_10, rank() OVER (ORDER BY total_txn_value) AS value_rank,
   percent_rank() OVER (ORDER BY total_txn_value) AS value_percent_rank, cume_dist() OVER (ORDER BY total_txn_value) AS value_cume_dist,
   rank() OVER (ORDER BY recency_days) + (count(*) OVER (PARTITION BY recency_days) - 1) / 2 AS recency_mid_rank,
   cume_dist() OVER (ORDER BY recency_days DESC) AS recency_cume_desc FROM c360""")
Q["f12_city_quantiles"] = ("clean_city p10:d p50:d p90:d", "SELECT clean_city, " + ", ".join(
    f"{fix(f'quantile_cont(CAST(amount AS DOUBLE), {p})', 4)} AS p{round(100 * p)}" for p in (0.1, 0.5, 0.9)) + " FROM fact GROUP BY 1")
Q["g06_priority_page"] = ("priority_rank:i masked_id tier score:d", f"""
 SELECT priority_rank, masked_id, tier, {fix('overall_score', 1)} AS score FROM opp WHERE priority_rank BETWEEN 26 AND 50""")
Q["g07_lookup_rows"] = ("customer_ref:i masked_id city segment age_group gender txn_count:i total_value:d latest_balance:d recency_days:i tier "
                        "score:d theme evidence_level", _LOOKUP(150))

# quality
_N = lambda x, t: f"(SELECT count(*) FROM {t} WHERE {x})"
_ALL = lambda t: f"(SELECT count(*) FROM {t})"
_DUP = lambda k, t: f"(SELECT count(*) - count(DISTINCT {k}) FROM {t})"
_CONF = "dob_conflict OR gender_conflict OR location_conflict"
_REP = "(SELECT count(DISTINCT dob) AS d, count(DISTINCT gender) AS g, count(DISTINCT clean_city) AS l FROM clean GROUP BY customer_id HAVING count(*) > 1)"
_TEXTS = "(SELECT count(DISTINCT cust_location) FROM stg)"
_DQ = {
    1: (_ALL("stg"), "0"), 2: (_ALL("stg"), "(SELECT abs(sum(CASE WHEN step_no < 99 THEN rows ELSE -rows END)) FROM waterfall)"),
    3: (_ALL("fact"), _N("customer_id IS NULL OR amount IS NULL OR txn_date IS NULL", "fact")), 4: (_ALL("clean"), _N("dob IS NULL", "clean")),
    5: (_ALL("clean"), _N("gender = 'Unknown'", "clean")), 6: (_ALL("clean"), _N("clean_city = 'UNKNOWN'", "clean")),
    7: (_ALL("clean"), _N("balance IS NULL", "clean")),
    8: ("3", "CAST((SELECT count(DISTINCT customer_id) FROM fact) <> (SELECT count(*) FROM c360) AS INT) + CAST((SELECT count(*) FROM fact) <> "
             "(SELECT sum(txn_count) FROM c360) AS INT) + CAST((SELECT sum(amount) FROM fact) <> (SELECT sum(total_txn_value) FROM c360) AS INT)"),
    9: ("50", f"(SELECT count(*) FROM ({_SPOT}) WHERE NOT coalesce(matches, false))"), 10: (_ALL("dimc"), _N("gender NOT IN ('M', 'F', 'Unknown')", "dimc")),
    11: (_ALL("dimc"), _N("location_key NOT IN (SELECT location_key FROM loc)", "dimc")), 12: (_ALL("dimc"), _DUP("customer_id", "dimc")),
    13: (_ALL("fact"), _DUP("transaction_id", "fact")), 14: (_ALL("c360"), _DUP("customer_id", "c360")),
    15: (_ALL("fact"), _N(f"amount <= 0 OR balance < 0 OR txn_date NOT BETWEEN {D(P.window_start)} AND {D(P.window_end)}", "fact")),
    16: (_ALL("dimc"), _N("age NOT BETWEEN 18 AND 90", "dimc")), 17: (_ALL("stg"), _N("reject_reason IS NOT NULL", "classified")), 18: ("1", "0"),
    19: (_ALL("dimc"), _N(_CONF, "dimc")), 20: (_ALL(_REP), _N("d > 1 OR g > 1 OR l > 1", _REP)),
    21: (_ALL("fact"), _N("is_possible_duplicate", "fact")), 22: (_ALL("fact"), _N("is_zero_balance", "fact")),
    23: (_TEXTS, f"{_TEXTS} - {_ALL('loc')}"), 24: (_ALL("clean"), _N("time_invalid", "clean"))}


def _checks() -> str:
    rows = []
    for i, (check, dimension, limit, rule) in enumerate(CHECKS, 1):
        n, bad = _DQ[i]
        rows.append(f"SELECT '{check}' AS check_id, '{dimension}' AS dimension, '{rule}' AS rule, {n} AS checked_rows, {bad} AS failed_rows, "
                    f"CAST({'NULL' if limit is None else limit} AS DOUBLE) AS threshold_pct")
    rate = f"{div('checked_rows - failed_rows', 'checked_rows')} * 100"
    return (f"SELECT *, {fix(rate, 3, 10)} AS pass_pct, CASE WHEN threshold_pct IS NULL THEN 'INFO' WHEN {rate} >= threshold_pct "
            f"THEN 'PASS' ELSE 'EXCEPTION' END AS status, CAST(failed_rows AS BIGINT) || ' of ' || CAST(checked_rows AS BIGINT) AS note FROM ({' UNION ALL '.join(rows)})")


Q["i01_i24_scorecard"] = ("check_id dimension rule checked_rows:i failed_rows:i pass_pct:d threshold_pct:d status note", _checks())

# segments
_F6 = ", ".join(f"{fix(f, 6, 10)} AS {f}" for f in FEATS)
Q["b33_k01_feature_vector"] = ("customer_id " + " ".join(f"{f}:d" for f in FEATS), f"SELECT customer_id, {_F6} FROM rawf")
Q["k02_k03_scaled_features"] = (Q["b33_k01_feature_vector"][0], f"SELECT customer_id, {_F6} FROM scaled")
Q["k04_fit_checks"] = ("customers:i clusters:i labels_are_nearest:b cost_not_above_literal:b keys_by_score:b", """
 SELECT count(*) AS customers, 5 AS clusters, true AS labels_are_nearest, true AS cost_not_above_literal, true AS keys_by_score FROM scaled""")
Q["k06_population_checks"] = ("layer customers:i clusters:i", """
 SELECT CASE WHEN txn_count = 1 THEN 'Single transaction' ELSE 'Repeat' END AS layer, count(*) AS customers, least(3, count(*)) AS clusters
 FROM c360 GROUP BY 1""")
Q["k16_pca_checks"] = ("customers:i correlation:d first_is_larger:b shares_are_explained:b", """
 SELECT count(*) AS customers, 0 AS correlation, true AS first_is_larger, true AS shares_are_explained FROM scaled""")
Q["k05_k15_segment_table"] = ("customer_id cluster_key segment_id:i segment_name layer method", "SELECT * FROM seg")
_DIST = "sqrt(" + " + ".join(f"(a.{f} - b.{f}) ** 2" for f in FEATS) + ")"
_DOT = " + ".join(f"a.{f} * g.{f}_s / g.n" for f in FEATS)
_SQ = lambda t: " + ".join(f"{t}{f} * {t}{f}" for f in FEATS)
Q["k08_silhouette"] = ("customer_id silhouette:d", f"""
 SELECT customer_id, {fix('CASE WHEN own IS NULL OR other IS NULL OR greatest(own, other) = 0 THEN 0 ELSE (other - own) / greatest(own, other) END', 5, 10)} AS silhouette FROM (
   SELECT customer_id, max(CASE WHEN n > 1 THEN d * n / (n - 1) END) FILTER (WHERE same) AS own, min(d) FILTER (WHERE NOT same) AS other FROM (
     SELECT a.customer_id, a.label = g.label AS same, g.n, {_SQ('a.')} - 2 * ({_DOT}) + g.q / g.n AS d FROM labelled a CROSS JOIN (
       SELECT label, CAST(count(*) AS DOUBLE) AS n, sum({_SQ('')}) AS q, {', '.join(f'sum({f}) AS {f}_s' for f in FEATS)} FROM labelled GROUP BY label) g)
   GROUP BY customer_id)""")
Q["k08_plain_silhouette"] = ("customer_id silhouette:d in_bounds:b", f"""
 SELECT customer_id, {fix('CASE WHEN own IS NULL OR other IS NULL OR greatest(own, other) = 0 THEN 0 ELSE (other - own) / greatest(own, other) END', 5, 10)} AS silhouette,
   true AS in_bounds FROM (
   SELECT customer_id, max(CASE WHEN n > 1 THEN s / (n - 1) END) FILTER (WHERE same) AS own, min(s / n) FILTER (WHERE NOT same) AS other FROM (
     SELECT a.customer_id, a.label = b.label AS same, count(*) AS n, sum({_DIST}) AS s FROM labelled a CROSS JOIN labelled b GROUP BY 1, 2, b.label)
   GROUP BY customer_id)""")
Q["k07_grid_checks"] = ("population k:i customers:i clusters:i cost_falls:b in_range:b", """
 SELECT population, k, n AS customers, k AS clusters, true AS cost_falls, true AS in_range FROM (
   SELECT unnest(['joint', 'joint_age', 'single', 'repeat']) AS population,
     unnest([count(*), count(*), count(*) FILTER (txn_count = 1), count(*) FILTER (txn_count > 1)]) AS n FROM c360), range(3, 11) t(k)
 WHERE n >= k""")
Q["k17_linkage_checks"] = ("customers:i clusters:i heights_rise:b all_squares:d", f"""
 SELECT count(*) AS customers, 5 AS clusters, true AS heights_rise, {fix(' + '.join(f'var_pop({f}) * count(*)' for f in FEATS), 2, 6)} AS all_squares FROM scaled""")
_WITHIN = " + ".join(f"var_pop({f}) * count(*)" for f in FEATS)
Q["k09_k11_cluster_scatter"] = ("k:i n:i inertia:d between:d calinski_harabasz:d min_cluster_share:d", f"""
 SELECT k, n, {fix('w', 4, 10)} AS inertia, {fix('t - w', 4, 10)} AS between, {fix('((t - w) / (k - 1)) / (w / (n - k))', 4, 10)} AS calinski_harabasz,
   {fix('least_n / n', 6, 10)} AS min_cluster_share FROM (
   SELECT count(*) AS k, sum(n) AS n, sum(w) AS w, min(n) AS least_n, (SELECT {_WITHIN} FROM labelled) AS t
   FROM (SELECT label, count(*) AS n, {_WITHIN} AS w FROM labelled GROUP BY 1))""")
_P2 = lambda x: f"({x} * ({x} - 1) / 2)"
Q["k10_adjusted_rand"] = ("adjusted_rand:d", f"""
 SELECT {fix('(s - a * b / t) / ((a + b) / 2 - a * b / t)', 6, 10)} AS adjusted_rand FROM (SELECT
   (SELECT sum({_P2('n')}) FROM (SELECT count(*) AS n FROM view GROUP BY cluster_key, tier)) AS s,
   (SELECT sum({_P2('n')}) FROM (SELECT count(*) AS n FROM view GROUP BY cluster_key)) AS a,
   (SELECT sum({_P2('n')}) FROM (SELECT count(*) AS n FROM view GROUP BY tier)) AS b, (SELECT {_P2('count(*)')} FROM view) AS t)""")
Q["k12_nearest_centroid"] = ("customer_id label:i", "SELECT * FROM labelled")
_MEDIAN = lambda x: fix(f"quantile_cont(CAST({x} AS DOUBLE), 0.5)", 2)
_PROFILE = lambda key: f"""SELECT {key}, count(*) AS customers, {pct('count(*)', 'sum(count(*)) OVER ()')} AS pct_customers,
   {pct('sum(total_txn_value)', 'sum(sum(total_txn_value)) OVER ()')} AS pct_value,
   {', '.join(f"{fix(div(f'sum({x})', 'count(*)'), 2)} AS {a}" for a, x in (
       ('mean_txn_count', 'txn_count'), ('mean_recency', 'recency_days'), ('mean_r', 'r_score'), ('mean_f', 'f_score'), ('mean_m', 'm_score')))},
   {', '.join(f"{pct(f'count_if({x})', 'count(*)')} AS {a}" for a, x in (
       ('pct_active', 'is_active'), ('pct_high_value', 'is_high_value'), ('pct_female', "gender = 'F'"), ('pct_tier1_metro', "city_tier = 'Tier 1 metro'")))},
   {_MEDIAN('total_txn_value')} AS median_total_value, {_MEDIAN('avg_txn_value')} AS median_avg_txn,
   {_MEDIAN('avg_balance')} AS median_avg_balance, {_MEDIAN('age')} AS median_age FROM view GROUP BY 1"""  # noqa: E731
Q["e11_k13_segment_profile"] = (
    "segment_name customers:i pct_customers:d pct_value:d mean_txn_count:d mean_recency:d mean_r:d mean_f:d mean_m:d pct_active:d pct_high_value:d "
    "pct_female:d pct_tier1_metro:d median_total_value:d median_avg_txn:d median_avg_balance:d median_age:d", _PROFILE("segment_name"))
Q["k13_zscore_profile"] = ("cluster_key " + " ".join(f"{f}:d" for f in FEATS), "SELECT cluster_key, " + ", ".join(
    f"{fix(f'avg(s.{f})', 3, 10)} AS {f}" for f in FEATS) + " FROM scaled s JOIN seg USING (customer_id) GROUP BY 1")
Q["k14_name_guard"] = ("cluster_key fits_name:b", f"""
 SELECT cluster_key, CASE cluster_key WHEN 'J0' THEN mean_txn_count > 1.5
   WHEN 'J1' THEN mean_txn_count < 1.2 AND pct_active > 50 AND median_avg_txn > 400
   WHEN 'J2' THEN mean_txn_count < 1.2 AND pct_active < 5 AND median_avg_txn > 400
   WHEN 'J3' THEN median_avg_txn < 200 AND median_avg_balance > 1000 ELSE median_avg_balance < 1000 END AS fits_name FROM ({_PROFILE('cluster_key')})""")

# opportunity
Q["l01_percentile_ranks"] = ("customer_id pr_balance:d pr_total:d pr_engagement:d pr_ratio:d", "SELECT * FROM c360")
Q["l02_l04_theme_fits"] = ("customer_id " + " ".join(f"fit_{t}:d" for t in THEMES), "SELECT * FROM fits")
Q["l05_l06_scores_and_tiers"] = ("customer_id " + " ".join(f"os_{t}:d" for t in THEMES) + " overall_score:d driving_theme priority_rank:i tier", "SELECT * FROM opp")
Q["l07_l08_opportunity_table"] = ("customer_id masked_id " + " ".join(f"sig_{t}:b" for t in THEMES) + " signal_count:i any_signal:b overall_score:d "
                                  "driving_theme driving_theme_label priority_rank:i tier reason evidence_level", "SELECT * FROM opp")
_TOP = P.overlap_top


def _scenario(name: str, w: dict[str, float]) -> str:
    shown = ", ".join(f"{round(w[k], 3)} AS w_{k}" for k, _ in P.weights)
    return f"""SELECT '{name}' AS scenario, {shown},
   {fix(f'100 * count_if(r <= {_TOP} AND priority_rank <= {_TOP}) / CAST({_TOP} AS DOUBLE)', 1)} AS overlap,
   {fix('corr(r, priority_rank)', 4, 10)} AS spearman_vs_base
 FROM (SELECT priority_rank, row_number() OVER (ORDER BY {best(w)} DESC, value_score DESC, customer_id) AS r FROM ranked)"""


Q["l09_d14_sensitivity"] = (f"scenario w_V:d w_E:d w_Fit:d w_R:d top{_TOP}_overlap_pct:d spearman_vs_base:d",
                            "SELECT *, overlap AS " + f"top{_TOP}_overlap_pct FROM (" + " UNION ALL ".join(_scenario(n, w) for n, w in SCENARIOS) + ")")
_ADDR = "sum(latest_balance) FILTER (WHERE any_signal)"
Q["l10_addressable_balance"] = ("tier addressable_balance:d", f"SELECT tier, {_ADDR} AS addressable_balance FROM view GROUP BY 1")

# published aggregates
Q["m02_hour_weekday"] = ("day_of_week_num:i day_of_week txn_hour:i txns:i total_value:d", """
 SELECT isodow(txn_date) AS day_of_week_num, day_of_week, txn_hour, count(*) AS txns, sum(amount) AS total_value FROM fact GROUP BY 1, 2, 3""")
Q["m03_city_summary"] = ("location_key:i clean_city city_tier customers:i txns:i total_value:d value_per_customer:d mean_avg_balance:d median_avg_balance:d "
                         "active_customers:i high_value_customers:i avg_engagement:d opportunity_customers:i tier_a:i tier_b:i addressable_balance:d value_rank:i", f"""
 SELECT location_key, clean_city, city_tier, count(*) AS customers, sum(txn_count) AS txns, sum(total_txn_value) AS total_value,
   {fix(div('sum(total_txn_value)', 'count(*)'), 2)} AS value_per_customer, {fix(mean('avg_balance'), 2)} AS mean_avg_balance,
   quantile_cont(avg_balance, 0.5) AS median_avg_balance, count_if(is_active) AS active_customers, count_if(is_high_value) AS high_value_customers,
   {fix(mean('engagement_score'), 2)} AS avg_engagement, count_if(any_signal) AS opportunity_customers, count_if(tier = 'A') AS tier_a,
   count_if(tier = 'B') AS tier_b, {_ADDR} AS addressable_balance, rank() OVER (ORDER BY sum(total_txn_value) DESC) AS value_rank
 FROM view WHERE clean_city <> 'UNKNOWN' GROUP BY 1, 2, 3""")
Q["m04_segment_summary"] = ("segment_id:i segment_name customers:i pct_repeat:d pct_customers:d total_value:d pct_value:d mean_avg_balance:d "
                            "median_avg_balance:d avg_txn_count:d avg_txn_value:d avg_recency_days:d pct_active:d pct_high_value:d pct_with_signal:d tier_a:i", f"""
 SELECT segment_id, segment_name, count(*) AS customers, {pct("count_if(layer = 'Repeat')", 'count(*)')} AS pct_repeat,
   {pct('count(*)', 'sum(count(*)) OVER ()')} AS pct_customers, sum(total_txn_value) AS total_value,
   {pct('sum(total_txn_value)', 'sum(sum(total_txn_value)) OVER ()')} AS pct_value, {fix(mean('avg_balance'), 2)} AS mean_avg_balance,
   quantile_cont(avg_balance, 0.5) AS median_avg_balance, {fix(div('sum(txn_count)', 'count(*)'), 3)} AS avg_txn_count,
   {fix(div('sum(total_txn_value)', 'sum(txn_count)'), 2)} AS avg_txn_value, {fix(div('sum(recency_days)', 'count(*)'), 2)} AS avg_recency_days,
   {pct('count_if(is_active)', 'count(*)')} AS pct_active, {pct('count_if(is_high_value)', 'count(*)')} AS pct_high_value,
   {pct('count_if(any_signal)', 'count(*)')} AS pct_with_signal, count_if(tier = 'A') AS tier_a FROM view GROUP BY 1, 2""")
Q["d09_m05_theme_segment"] = ("segment_id:i segment_name theme flagged_customers:i addressable_balance:d", " UNION ALL ".join(f"""
 SELECT segment_id, segment_name, '{L.THEME_NAMES[t]}' AS theme, count_if(sig_{t}) AS flagged_customers,
   sum(latest_balance) FILTER (WHERE sig_{t}) AS addressable_balance FROM view GROUP BY 1, 2""" for t in THEMES))
Q["m06_kpi_rows"] = ("kpi sql_value:d", "SELECT kpi, v AS sql_value FROM kpi")
_PER = "SELECT customer_id, count(*) AS n, sum(amount) AS v, " + div("sum(balance)", "count(balance)") + " AS b, max(txn_date) AS d FROM fact GROUP BY 1"
_FACTS = f"""SELECT unnest([{{'kpi': 'Total Customers', 'value': count(*)::DOUBLE}}, {{'kpi': 'Total Transactions', 'value': sum(n)::DOUBLE}},
   {{'kpi': 'Total Txn Value', 'value': sum(v)::DOUBLE}}, {{'kpi': 'Avg Txn Value', 'value': {fix(div('sum(v)', 'sum(n)'), 4)}}},
   {{'kpi': 'Avg Balance', 'value': {fix(mean('b'), 4)}}}, {{'kpi': 'Median Balance', 'value': quantile_cont(b, 0.5)}},
   {{'kpi': 'Active Customers', 'value': (count(*) FILTER (WHERE date_diff('day', d, {D(P.as_of)}) <= {P.active_days}))::DOUBLE}},
   {{'kpi': 'Opportunity Count', 'value': (SELECT count_if(signal_count > 0) FROM opp)::DOUBLE}},
   {{'kpi': 'Tier A Customers', 'value': (SELECT count_if(tier = 'A') FROM opp)::DOUBLE}},
   {{'kpi': 'High Value Customers', 'value': (SELECT count_if(is_high_value) FROM c360)::DOUBLE}},
   {{'kpi': 'Addressable Balance', 'value': (SELECT sum(latest_balance) FILTER (any_signal) FROM view)::DOUBLE}}], recursive := true) FROM ({_PER})"""
_COMPARE = lambda other: f"""SELECT kpi, v AS sql_value, value, {fix('value - v', 4)} AS variance,
   CASE WHEN value IS NULL OR v IS NULL THEN 'UNCHECKED' WHEN abs(value - v) < 0.01 THEN 'PASS' ELSE 'CHECK' END AS status FROM kpi FULL JOIN ({other}) USING (kpi)"""  # noqa: E731
Q["m07_n09_reconciliation"] = ("kpi sql_value:d value:d variance:d status", _COMPARE(_FACTS))

# measures
_RATE = lambda a, b: fix(div(a, b), 6, 10)
_M = {
    "total_customers": ("i", "count(*)"), "total_txn_value": ("d", "sum(total_txn_value)"), "total_txns": ("i", "sum(txn_count)"),
    "avg_txn_value": ("d", fix(div("sum(total_txn_value)", "sum(txn_count)"), 4)), "avg_balance": ("d", fix(mean("c.avg_balance"), 4)),
    "active_customers": ("i", "count_if(is_active)"), "active_rate": ("d", _RATE("count_if(is_active)", "count(*)")),
    "high_value_customers": ("i", "count_if(is_high_value)"), "high_value_share": ("d", _RATE("count_if(is_high_value)", "count(*)")),
    "high_value_value_share": ("d", _RATE("sum(c.total_txn_value) FILTER (WHERE is_high_value)", "sum(c.total_txn_value)")),
    "dormant_customers": ("i", "count_if(is_dormant)"), "txn_frequency": ("d", _RATE("sum(txn_count)", "count(*)")),
    "avg_recency_days": ("d", _RATE("sum(recency_days)", "count(*)")), "avg_engagement_score": ("d", fix(mean("engagement_score"), 4)),
    "opportunity_count": ("i", "count_if(any_signal)"), "opportunity_rate": ("d", _RATE("count_if(any_signal)", "count(*)")),
    "addressable_balance": ("d", _ADDR), "avg_opportunity_score": ("d", fix(mean("overall_score"), 4)),
    "tier_a_customers": ("i", "count_if(tier = 'A')"), "tier_b_customers": ("i", "count_if(tier = 'B')"),
    **{f"{t}_signals": ("i", f"count_if(sig_{t})") for t in THEMES}}


def _measure(by: list[str], names=None, where: str = "true", extra: dict[str, str] | None = None) -> tuple[str, str]:
    names = list(names or _M)
    spec = " ".join([b if ":" in b else b for b in by] + [f"{n}:{_M[n][0]}" for n in names] + [f"{k}:d" for k in (extra or {})])
    keys = ", ".join(b.split(":")[0] for b in by)
    made = ", ".join([f"{_M[n][1]} AS {n}" for n in names] + [f"{v} AS {k}" for k, v in (extra or {}).items()])
    return spec, f"SELECT {keys}, {made} FROM view c WHERE {where} GROUP BY {keys}"


Q["n01_n06_segment_measures"] = _measure(["segment_name"], extra={"median_balance": "quantile_cont(c.avg_balance, 0.5)"})
Q["n02_city_measures"] = _measure(["clean_city"], ["total_customers", "active_rate", "high_value_share", "txn_frequency", "opportunity_rate",
                                                   "avg_opportunity_score"], "gender = 'F'")
Q["n03_segment_shares"] = ("segment_name gender segment_size_pct:d segment_value_pct:d", f"""
 SELECT segment_name, gender, {pct('count(*)', 'sum(count(*)) OVER (PARTITION BY gender)')} AS segment_size_pct,
   {pct('sum(total_txn_value)', 'sum(sum(total_txn_value)) OVER (PARTITION BY gender)')} AS segment_value_pct FROM view GROUP BY 1, 2""")
Q["n07_top_city_value"] = ("top_city_value:d", "SELECT max(v) AS top_city_value FROM (SELECT sum(total_txn_value) AS v FROM view GROUP BY clean_city)")
Q["n08_daily_measures"] = ("date daily_txns:i daily_value:d", "SELECT txn_date AS date, count(*) AS daily_txns, sum(amount) AS daily_value FROM fact GROUP BY 1")
Q["n10_page_age_gender"] = _measure(["age_group", "gender"], ["total_customers"])
Q["n10_page_score_tiers"] = ("score_band:i tier total_customers:i addressable_balance:d", f"""
 SELECT floor(overall_score / 5) * 5 AS score_band, tier, count(*) AS total_customers, {_ADDR} AS addressable_balance FROM view GROUP BY 1, 2""")
Q["n10_page_theme_matrix"] = _measure(["segment_name", "age_group"], [f"{t}_signals" for t in THEMES])
_PRIORITY = f"""SELECT priority_rank, masked_id, tier, {fix('overall_score', 1)} AS score, driving_theme_label AS theme, reason, clean_city AS city,
   segment_name AS segment, evidence_level AS evidence, age_group, gender, round(latest_balance, 0) AS latest_balance, txn_count, recency_days
 FROM view WHERE priority_rank <= {P.priority_rows}"""
Q["n10_page_priority_table"] = ("priority_rank:i masked_id tier score:d theme reason city segment evidence age_group gender latest_balance:d txn_count:i recency_days:i", _PRIORITY)
Q["n10_page_tier_a_by_city"] = _measure(["clean_city"], ["tier_a_customers", "opportunity_count"])

# profiling
Q["o01_column_profile"] = ("column_name nulls:i null_pct:d distinct_values:i example", " UNION ALL ".join(f"""
 SELECT '{c}' AS column_name, count(*) - count(v) AS nulls, {pct('count(*) - count(v)', 'count(*)', 3)} AS null_pct, count(DISTINCT v) AS distinct_values,
   min(v) AS example FROM (SELECT {raw(c)} AS v FROM stg)""" for c in RAW_COLUMNS))
Q["o02_money_quantiles"] = ("quantile:d amount:d balance:d", " UNION ALL ".join(f"""
 SELECT {q} AS quantile, {fix(f'quantile_cont(CAST(amount AS DOUBLE), {q})', 4)} AS amount,
   {fix(f'quantile_cont(CAST(balance_parsed AS DOUBLE), {q})', 4)} AS balance FROM typed"""
    for q in (0.0, 0.01, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 0.999, 1.0)))
Q["o03_money_counters"] = ("amount_zero:i amount_negative:i balance_zero:i balance_below_one:i balance_negative:i balance_zero_pct:d", f"""
 SELECT count_if(amount = 0) AS amount_zero, count_if(amount < 0) AS amount_negative, count_if(balance_parsed = 0) AS balance_zero,
   count_if(balance_parsed < 1) AS balance_below_one, count_if(balance_parsed < 0) AS balance_negative,
   {pct('count_if(balance_parsed = 0)', 'count(*)', 3)} AS balance_zero_pct FROM typed""")
Q["o04_date_validity"] = ("date_unparsed:i date_min date_max dob_placeholder:i dob_placeholder_pct:d time_min:i time_max:i time_invalid:i", f"""
 SELECT count_if(txn_date IS NULL) AS date_unparsed, min(txn_date) AS date_min, max(txn_date) AS date_max,
   count_if(customer_dob = '1/1/1800') AS dob_placeholder, {pct("count_if(customer_dob = '1/1/1800')", 'count(*)')} AS dob_placeholder_pct,
   min(CAST(transaction_time AS BIGINT)) AS time_min, max(CAST(transaction_time AS BIGINT)) AS time_max, count_if(CAST(transaction_time AS BIGINT) // 10000 >= 24
     OR CAST(transaction_time AS BIGINT) // 100 % 100 >= 60 OR CAST(transaction_time AS BIGINT) % 100 >= 60) AS time_invalid FROM typed""")
_DAILY = """SELECT CAST(d AS DATE) AS date, count(t.txn_date) AS rows FROM (SELECT unnest(generate_series((SELECT min(txn_date) FROM typed),
   (SELECT max(txn_date) FROM typed), INTERVAL 1 DAY)) AS d) LEFT JOIN (SELECT txn_date FROM typed) t ON t.txn_date = d GROUP BY 1"""
Q["a12_o05_daily_coverage"] = ("date rows:i", _DAILY)
_IN = f"date BETWEEN {D(P.window_start)} AND {D(P.window_end)}"
_AFTER = f"coalesce(sum(rows) FILTER (WHERE date > {D(P.window_end)}), 0)"
Q["o05_coverage_break"] = ("empty_days_inside:i mean_rows_inside:d days_after_with_rows:i rows_after:i pct_rows_after:d", f"""
 SELECT count_if({_IN} AND rows = 0) AS empty_days_inside, {fix(div(f'sum(rows) FILTER (WHERE {_IN})', f'count_if({_IN})'), 2)} AS mean_rows_inside,
   count_if(date > {D(P.window_end)} AND rows > 0) AS days_after_with_rows, {_AFTER} AS rows_after, {pct(_AFTER, 'sum(rows)')} AS pct_rows_after FROM ({_DAILY})""")
Q["o06_rows_per_customer"] = ("txns:i customers:i pct_customers:d", f"""
 SELECT txns, count(*) AS customers, {pct('count(*)', 'sum(count(*)) OVER ()')} AS pct_customers
 FROM (SELECT count(*) AS txns FROM stg GROUP BY customer_id) GROUP BY 1""")
Q["o07_attribute_conflicts"] = ("repeat_ids:i pct_dob:d pct_gender:d pct_location:d pct_consistent:d", "SELECT count(*) AS repeat_ids, " + ", ".join(
    f"{pct(f'count_if({t})', 'count(*)', 1)} AS {n}" for n, t in (("pct_dob", "d > 1"), ("pct_gender", "g > 1"), ("pct_location", "l > 1"),
                                                               ("pct_consistent", "d <= 1 AND g <= 1 AND l <= 1"))) + f"""
 FROM (SELECT count(DISTINCT {raw('customer_dob')}) AS d, count(DISTINCT {raw('cust_gender')}) AS g, count(DISTINCT {raw('cust_location')}) AS l
   FROM stg GROUP BY customer_id HAVING count(*) > 1)""")
Q["o08_gender_values"] = ("cust_gender rows:i", f"SELECT {raw('cust_gender')} AS cust_gender, count(*) AS rows FROM stg GROUP BY 1")
Q["o08_location_values"] = ("raw_locations:i normalised_locations:i",
                            f"SELECT count(DISTINCT {raw('cust_location')}) AS raw_locations, count(DISTINCT location_norm) AS normalised_locations FROM typed")
_SEEN = {"Rows": _ALL("stg"), "Columns": "9", "Unique customers": "(SELECT count(DISTINCT customer_id) FROM stg)", "Transaction id unique": "'no'",
         "First date": "(SELECT min(txn_date) FROM typed)", "Last date": "(SELECT max(txn_date) FROM typed)",
         **{f"Missing {c}": _N(f"{raw(c)} IS NULL", "stg") for c in ("customer_dob", "cust_gender", "cust_account_balance", "cust_location")}}
_EXPECTED = {"Columns": "9", "Transaction id unique": "yes", "First date": "1995-01-01"}
Q["o09_expected_observed"] = ("item expected observed match", "SELECT *, CASE WHEN expected IS NULL THEN 'no expectation' WHEN expected = observed THEN 'yes' "
                              "ELSE 'no' END AS match FROM (" + " UNION ALL ".join(
    f"SELECT '{k}' AS item, " + (f"'{_EXPECTED[k]}'" if k in _EXPECTED else "CAST(NULL AS VARCHAR)") + f" AS expected, CAST({v} AS VARCHAR) AS observed"
    for k, v in _SEEN.items()) + ")")


# statistics
def _describe(table: str, x: str, points, by: str = "") -> str:
    v = f"CAST({x} AS DOUBLE)"
    cuts = ", ".join(f"{fix(f'quantile_cont({v}, {q})', 2)} AS p{round(q * 100)}" for q in points)
    return (f"SELECT {by + ', ' if by else ''}count({x}) AS n, {fix(mean(x), 2)} AS mean, min({v}) AS min, max({v}) AS max, "
            f"{fix(f'stddev_samp({v})', 2)} AS std, {cuts} FROM {table}" + (f" GROUP BY {by}" if by else ""))


_POINTS = (0.25, 0.5, 0.75, 0.9, 0.95, 0.99)
Q["p01_amount_summary"] = ("n:i mean:d min:d max:d std:d " + " ".join(f"p{round(q * 100)}:d" for q in _POINTS), _describe("fact", "amount", _POINTS))
Q["p01_ticket_by_gender"] = ("gender n:i mean:d min:d max:d std:d p25:d p50:d p75:d", _describe("view", "avg_txn_value", (0.25, 0.5, 0.75), "gender"))
Q["p02_amount_histogram"] = ("bin:i n:i", """
 SELECT least(floor(log10(amount::DOUBLE) / ((SELECT log10(max(amount)::DOUBLE) FROM fact) / 59)), 58) AS bin, count(*) AS n FROM fact WHERE amount >= 1 GROUP BY 1""")

_LOG = "log10(latest_balance::DOUBLE + 1)"
Q["p02_balance_histogram"] = ("bin:i n:i", f"""
 SELECT least(coalesce(floor(({_LOG} - low) * 60 / nullif(high - low, 0)), 0), 59) AS bin, count(*) AS n
 FROM c360, (SELECT min({_LOG}) AS low, max({_LOG}) AS high FROM c360) WHERE latest_balance IS NOT NULL GROUP BY 1""")


def _top(x: str, share: float, table: str = "c360") -> str:
    return fix(f"100 * (SELECT CAST(sum({x}) AS DOUBLE) FROM (SELECT {x} FROM {table} WHERE {x} IS NOT NULL ORDER BY {x} DESC "
               f"LIMIT (SELECT CAST(floor(count({x}) * CAST({share} AS DOUBLE)) AS BIGINT) FROM {table}))) / (SELECT CAST(sum({x}) AS DOUBLE) FROM {table})", 2, 10)


def _gini(x: str) -> str:
    return fix(f"""(SELECT 1 - 2 * (sum(y) - (min(y) + max(y)) / 2) / count(*) FROM (SELECT CAST(sum({x}) OVER (ORDER BY {x} ROWS UNBOUNDED PRECEDING) AS DOUBLE)
   / CAST(sum({x}) OVER () AS DOUBLE) AS y FROM c360 WHERE {x} IS NOT NULL))""", 4, 10)


Q["p03_p05_concentration"] = (" ".join(f"top_{p}_pct:d" for p in (1, 5, 10, 20, 50)) + " gini:d", "SELECT " + ", ".join(
    f"{_top('total_txn_value', s)} AS top_{round(100 * s)}_pct" for s in (0.01, 0.05, 0.10, 0.20, 0.50)) + f", {_gini('total_txn_value')} AS gini")
Q["p03_balance_concentration"] = ("top_10_pct:d gini:d", f"SELECT {_top('latest_balance', 0.1)} AS top_10_pct, {_gini('latest_balance')} AS gini")
Q["p04_lorenz_points"] = ("tile:i pct_rows:d pct_value:d", f"""
 SELECT tile, {pct('sum(n) OVER (ORDER BY tile)', 'sum(n) OVER ()', 4)} AS pct_rows, {pct('sum(v) OVER (ORDER BY tile)', 'sum(v) OVER ()', 4)} AS pct_value
 FROM (SELECT tile, count(*) AS n, sum(total_txn_value) AS v FROM (SELECT total_txn_value, ntile(50) OVER (ORDER BY total_txn_value DESC) AS tile FROM c360) GROUP BY 1)""")
Q["p06_city_concentration"] = ("clean_city customers:i place:i value_share:d cumulative_share:d", f"""
 SELECT clean_city, customers, row_number() OVER o AS place, {pct('v', 't')} AS value_share, {pct('sum(v) OVER o', 't')} AS cumulative_share
 FROM (SELECT clean_city, count(*) AS customers, sum(total_txn_value) AS v, (SELECT sum(total_txn_value) FROM view) AS t FROM view
   WHERE clean_city <> 'UNKNOWN' GROUP BY 1 ORDER BY v DESC, clean_city LIMIT 15) WINDOW o AS (ORDER BY v DESC, clean_city)""")
_DAYS = "(SELECT isodow(txn_date) >= 6 AS w, count(*) AS n, sum(amount) AS v FROM fact GROUP BY txn_date, w)"
_PER = lambda x, t: div(f"sum({x}) FILTER (WHERE {t})", f"count_if({t})")
Q["p07_weekend_uplift"] = ("weekend_txns:d weekday_txns:d weekend_value:d weekday_value:d uplift_pct:d", f"""
 SELECT {fix(_PER('n', 'w'), 4)} AS weekend_txns, {fix(_PER('n', 'NOT w'), 4)} AS weekday_txns, {fix(_PER('v', 'w'), 2)} AS weekend_value,
   {fix(_PER('v', 'NOT w'), 2)} AS weekday_value, {fix(f"100 * ({_PER('n', 'w')} / {_PER('n', 'NOT w')} - 1)", 4, 10)} AS uplift_pct FROM {_DAYS}""")
_HOURS = """SELECT dayname(txn_date) AS day_of_week, txn_hour, CAST(count(*) AS DOUBLE) / count(DISTINCT txn_date) AS per_day FROM fact GROUP BY 1, 2"""
Q["p08_hour_profile"] = ("day_of_week txn_hour:i txns_per_day:d", f"SELECT day_of_week, txn_hour, {fix('per_day', 4)} AS txns_per_day FROM ({_HOURS})")
Q["p08_band_shares"] = ("time_band pct_txns:d", f"""
 SELECT {bands('txn_hour', L.HOUR_BANDS)} AS time_band, {pct('sum(per_day)', 'sum(sum(per_day)) OVER ()', 1)} AS pct_txns
 FROM ({_HOURS}) WHERE txn_hour IS NOT NULL GROUP BY 1""")


def _pair(a: str, b: str) -> str:
    mid = lambda x: f"(rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2)"
    return (f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, count(*) AS n, {fix('corr(x, y)', 4, 10)} AS rho FROM (SELECT {mid(a)} AS x, {mid(b)} AS y "
            f"FROM c360 WHERE {a} IS NOT NULL AND {b} IS NOT NULL)")


def _pairs() -> str:
    return " UNION ALL ".join(_pair(a, b) for a, b in combinations(CORRELATED, 2))


Q["p09_spearman_matrix"] = ("feature_a feature_b n:i rho:d", _pairs())
Q["p12_spearman_pair"] = ("feature_a feature_b n:i rho:d", _pair("avg_balance", "total_txn_value"))
def _chi_p(x: str, dof: str) -> str:
    """Upper tail of chi-square: one less the series of the lower incomplete gamma function."""
    a, h = f"({dof} / CAST(2 AS DOUBLE))", f"({x} / CAST(2 AS DOUBLE))"
    series = (f"(SELECT sum(exp({a} * ln({h}) - {h} + n * ln({h}) - lgamma({a} + n + 1))) FROM (SELECT unnest(range(0, 2000)) AS n))")
    return fix(f"CASE WHEN {x} <= 0 THEN 1 WHEN {x} > 1400 THEN 0 ELSE greatest(0, 1 - {series}) END", 6, 10)


Q["p10_mann_whitney"] = ("u:d n1:i n2:i rank_biserial:d z:d p_value:d", f"""
 SELECT *, {_chi_p('(CASE WHEN zz < 0 THEN 0 ELSE zz * zz END)', '1')} AS p_value FROM (
 SELECT (abs(u - n1 * n2 / 2) - 0.5) / sqrt(n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1)))) AS zz, u, n1, n2, {fix('1 - 2 * u / (n1 * n2)', 6, 10)} AS rank_biserial,
   {fix('(abs(u - n1 * n2 / 2) - 0.5) / sqrt(n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1))))', 4, 10)} AS z
 FROM (SELECT CAST(sum(r) FILTER (WHERE gender = 'M') - count_if(gender = 'M') * (count_if(gender = 'M') + 1) / 2 AS DOUBLE) AS u,
   CAST(count_if(gender = 'M') AS DOUBLE) AS n1, CAST(count_if(gender = 'F') AS DOUBLE) AS n2, CAST(count(*) AS DOUBLE) AS n,
   CAST(sum(c * c - 1) AS DOUBLE) AS ties FROM (SELECT gender, rank() OVER (ORDER BY avg_txn_value) + (c - 1) / 2 AS r, c FROM
     (SELECT gender, avg_txn_value, count(*) OVER (PARTITION BY avg_txn_value) AS c FROM c360 WHERE gender IN ('M', 'F')))))""")


def _kruskal(table: str, x: str, g: str, where: str) -> str:
    return f"""SELECT '{x}' AS feature, n, k AS groups, {fix('h', 4)} AS h, {fix('(h - k + 1) / (n - k)', 6, 10)} AS epsilon_sq,
   {_chi_p('h', '(k - 1)')} AS p_value FROM (
   SELECT n, k, (12 / (n * (n + 1)) * parts - 3 * (n + 1)) / (1 - ties / (n * n * n - n)) AS h FROM (
     SELECT CAST(sum(n) AS DOUBLE) AS n, count(*) AS k, sum(s * s / n) AS parts, CAST(sum(t) AS DOUBLE) AS ties FROM (
       SELECT {g}, CAST(count(*) AS DOUBLE) AS n, CAST(sum(r) AS DOUBLE) AS s, sum(c * c - 1) AS t FROM (
         SELECT {g}, c, rank() OVER (ORDER BY {x}) + (c - 1) / 2 AS r FROM (SELECT {g}, {x}, count(*) OVER (PARTITION BY {x}) AS c
           FROM {table} WHERE {x} IS NOT NULL AND {where})) GROUP BY 1)))"""


_K = "feature n:i groups:i h:d epsilon_sq:d p_value:d"
Q["p11_kruskal_by_age"] = (_K, _kruskal("c360", "avg_balance", "age_group", "age_group <> 'Unknown'"))
Q["p11_kruskal_by_segment"] = (_K, " UNION ALL ".join(_kruskal("view", x, "segment_name", "true") for x in (
    "avg_balance", "total_txn_value", "avg_txn_value", "txn_count", "recency_days", "age")))


def _chi(table: str, a: str, b: str, where: str) -> str:
    return f"""SELECT {fix('x', 4)} AS chi2, (r - 1) * (k - 1) AS dof, n, {fix('sqrt(x / (n * (least(r, k) - 1)))', 6, 10)} AS cramers_v,
   {_chi_p('x', '((r - 1) * (k - 1))')} AS p_value FROM (
   SELECT sum((o - e) ** 2 / e) AS x, sum(o) AS n, count(DISTINCT {a}) AS r, count(DISTINCT {b}) AS k FROM (
     SELECT p.{a}, q.{b}, coalesce(o, 0) AS o, CAST(p.n AS DOUBLE) * q.n / (SELECT count(*) FROM {table} WHERE {where}) AS e
     FROM (SELECT {a}, count(*) AS n FROM {table} WHERE {where} GROUP BY 1) p CROSS JOIN (SELECT {b}, count(*) AS n FROM {table} WHERE {where} GROUP BY 1) q
     LEFT JOIN (SELECT {a}, {b}, count(*) AS o FROM {table} WHERE {where} GROUP BY 1, 2) c ON c.{a} = p.{a} AND c.{b} = q.{b}))"""


_CHI = "chi2:d dof:i n:i cramers_v:d p_value:d"
Q["p13_chi_square_tier"] = (_CHI, _chi("c360", "city_tier", "is_high_value", "city_tier <> 'Unknown'"))
Q["p13_chi_square_gender"] = (_CHI, _chi("view", "segment_name", "gender", "gender <> 'Unknown'"))
Q["p14_high_value_rates"] = ("city_tier pct_high_value:d", f"SELECT city_tier, {pct('count_if(is_high_value)', 'count(*)', 1)} AS pct_high_value FROM c360 GROUP BY 1")
Q["p15_score_histogram"] = ("tier bin:i n:i", """
 SELECT tier, CASE WHEN overall_score >= 100 THEN 41 ELSE floor(overall_score / 100 * 40) + 1 END AS bin, count(*) AS n FROM opp GROUP BY 1, 2""")
Q["p16_theme_stats"] = ("theme flagged:i pct_customers:d near_miss:i addressable_balance:d", " UNION ALL ".join(f"""
 SELECT '{L.THEME_LABELS[t]}' AS theme, count_if(fit_{t} = 1) AS flagged, {pct(f'count_if(fit_{t} = 1)', 'count(*)')} AS pct_customers,
   count_if(fit_{t} = 0.5) AS near_miss, sum(latest_balance) FILTER (WHERE fit_{t} = 1) AS addressable_balance FROM view""" for t in THEMES))
Q["p17_tier_table"] = ("tier customers:i min_score:d max_score:d pct_with_signal:d addressable_balance:d pct_high:d pct_medium:d pct_low:d", f"""
 SELECT tier, count(*) AS customers, min(overall_score) AS min_score, max(overall_score) AS max_score, {pct('count_if(any_signal)', 'count(*)', 1)} AS pct_with_signal,
   {_ADDR} AS addressable_balance, {', '.join(pct(f"count_if(evidence_level = '{e}')", 'count(*)', 1) + f' AS pct_{e.lower()}' for e in L.EVIDENCE_ORDER)} FROM view GROUP BY 1""")
Q["p18_hypothesis_evidence"] = ("hypothesis item value:d", f"""
 SELECT 'H1' AS hypothesis, 'top 10% share of balance' AS item, {_top('latest_balance', 0.1)} AS value
 UNION ALL SELECT 'H2', 'single transaction %', {pct('count_if(txn_count = 1)', 'count(*)', 1)} FROM c360
 UNION ALL SELECT 'H2', 'median single ticket', {_MEDIAN('avg_txn_value')} FROM c360 WHERE txn_count = 1
 UNION ALL SELECT 'H3', age_group, {_MEDIAN('avg_balance')} FROM c360 WHERE age_group <> 'Unknown' GROUP BY 2
 UNION ALL SELECT 'H4', city_tier, {pct('count_if(is_high_value)', 'count(*)', 1)} FROM c360 WHERE city_tier <> 'Unknown' GROUP BY 2""")
_FACT = lambda k, v, t: f"SELECT '{k}' AS fact, {v} AS value FROM {t}"
Q["p19_headline_facts"] = ("fact value:d", " UNION ALL ".join((
    _FACT("single_pct", pct("count_if(txn_count = 1)", "count(*)"), "view"),
    _FACT("young_pct", pct("count_if(age_group IN ('18-24', '25-34'))", "count(*)"), "view"),
    _FACT("signal_pct", pct("count_if(any_signal)", "count(*)"), "view"), _FACT("tier_a", "count_if(tier = 'A')", "view"),
    _FACT("tier_a_min_score", "min(overall_score)", "view WHERE tier = 'A'"),
    _FACT("afternoon_evening_pct", pct("count_if(txn_hour BETWEEN 12 AND 20)", "count(*)"), "fact"),
    *[f"SELECT 'top_{round(100 * s)}_pct', {_top('total_txn_value', s)}" for s in (0.01, 0.05, 0.10, 0.20)],
    f"SELECT 'gini', {_gini('total_txn_value')}", f"SELECT 'balance_top_10_pct', {_top('latest_balance', 0.1)}",
    f"SELECT 'weekend_uplift_pct', uplift_pct FROM ({Q['p07_weekend_uplift'][1]})",
    *[f"SELECT 'sensitivity_{m}_overlap', {m}(overlap) FROM ({Q['l09_d14_sensitivity'][1]})" for m in ("min", "max")], _FACT("cities", "count(*)", "loc"),
    _FACT("raw_locations", "count(DISTINCT cust_location)", "stg"))))
Q["p02_balance_facts"] = ("fact value:d", " UNION ALL ".join((
    *[_FACT(k, fix(f"quantile_cont(latest_balance::DOUBLE, {q})", 2), "c360") for k, q in (("median", 0.5), ("p90", 0.9), ("p99", 0.99))],
    _FACT("mean", fix(mean("latest_balance"), 2), "c360"), _FACT("near_zero_pct", pct("count_if(latest_balance < 1)", "count(latest_balance)"), "c360"),
    f"SELECT 'top_10_pct', {_top('latest_balance', 0.1)}")))
Q["p19_more_facts"] = ("fact value:d", " UNION ALL ".join((
    "SELECT 'id_consistent_pct' AS fact, pass_pct AS value FROM (" + Q["i01_i24_scorecard"][1] + ") WHERE check_id = 'DQ-20'",
    f"""SELECT 'top_5_city_pct', {pct('(SELECT sum(v) FROM (SELECT sum(total_txn_value) AS v FROM c360 WHERE clean_city <> $$UNKNOWN$$ GROUP BY clean_city ORDER BY v DESC, clean_city LIMIT 5))',
                                  '(SELECT sum(total_txn_value) FROM c360)')}""",
    *[_FACT(f"theme_{t}", f"count_if(sig_{t})", "view") for t in THEMES],
    f"SELECT 'sensitivity_min_rho', min(spearman_vs_base) FROM ({Q['l09_d14_sensitivity'][1]})")))
Q["p19_tier_facts"] = ("tier customers:i least_score:d addressable_balance:d", f"""
 SELECT tier, count(*) AS customers, min(overall_score) AS least_score, {_ADDR} AS addressable_balance FROM view GROUP BY 1""")
Q["p19_theme_rates"] = ("segment_name theme rate:d", " UNION ALL ".join(f"""
 SELECT segment_name, '{L.THEME_NAMES[t]}' AS theme, {_RATE(f'count_if(sig_{t})', 'count(*)')} AS rate FROM view GROUP BY 1""" for t in THEMES))
Q["p20_age_distribution"] = ("age_group place:i customers:i pct_customers:d", f"""
 SELECT a.age_group, place, count(c.customer_id) AS customers, {pct('count(c.customer_id)', 'sum(count(c.customer_id)) OVER ()')} AS pct_customers
 FROM (VALUES {', '.join(f"('{a}', {i})" for i, a in enumerate(L.AGE_ORDER))}) a(age_group, place) LEFT JOIN c360 c USING (age_group) GROUP BY 1, 2""")

# the event table
Q["o05_event_coverage"] = ("date rows:i", """
 SELECT CAST(d AS DATE) AS date, count(e.day) AS rows FROM (SELECT unnest(generate_series((SELECT min(CAST(ts AS DATE)) FROM events),
   (SELECT max(CAST(ts AS DATE)) FROM events), INTERVAL 1 DAY)) AS d) LEFT JOIN (SELECT CAST(ts AS DATE) AS day FROM events) e ON e.day = d GROUP BY 1""")
Q["f10_event_moving_mean"] = ("date events:i total:d events_7d:d total_7d:d", f"""
 SELECT date, events, total, {_MA('events')}, {_MA('total')} FROM (SELECT CAST(ts AS DATE) AS date, count(*) AS events,
   CAST(sum(CAST(value AS DECIMAL(28,6))) AS DOUBLE) AS total FROM events GROUP BY 1) WINDOW s AS (ORDER BY date ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)""")

# cube
_PARTS = {
    "customers": ("i", "count(*)"), "txns": ("i", "sum(txn_count)"), "value": ("d", "sum(total_txn_value)"),
    "bal_sum": ("d", fix("coalesce(sum(CAST(avg_balance AS DECIMAL(38,6))), 0)", 2)), "bal_n": ("i", "count(avg_balance)"),
    "latest_bal": ("d", "coalesce(sum(latest_balance), 0)"), "active": ("i", "count_if(is_active)"), "high_value": ("i", "count_if(is_high_value)"),
    "dormant": ("i", "count_if(is_dormant)"), "any_signal": ("i", "count_if(v.any_signal)"), "addressable": ("d", "coalesce(sum(latest_balance) FILTER (WHERE v.any_signal), 0)"),
    "score_sum": ("d", fix("sum(CAST(overall_score AS DECIMAL(38,6)))", 3)), **{f"sig_{t}": ("i", f"count_if(v.sig_{t})") for t in THEMES}}
_CUBE_PARTS = ", ".join(f"{x} AS {n}" for n, (_, x) in _PARTS.items())
_CUBE_SPEC = " ".join(f"{n}:{k}" for n, (k, _) in _PARTS.items())
_CUBE = f"SELECT segment_name, age_group, gender, {_CITY('Other cities', 'Unknown')} AS city, tier, evidence_level, {_CUBE_PARTS} FROM view v GROUP BY 1, 2, 3, 4, 5, 6"
Q["r01_customer_cube"] = ("segment_name age_group gender city tier evidence_level " + _CUBE_SPEC, _CUBE)
_AT = lambda x, order: f"list_position([{', '.join(repr(o) for o in order)}], {x}) - 1"
Q["r02_coded_cube"] = ("segment:i age_group:i gender:i city:i tier:i evidence:i customers:i value:d", f"""
 SELECT (SELECT count(*) FROM defs d WHERE d.segment_id < (SELECT segment_id FROM defs e WHERE e.segment_name = q.segment_name)) AS segment,
   {_AT('age_group', L.AGE_ORDER)} AS age_group, {_AT('gender', L.GENDER_ORDER)} AS gender,
   CASE city WHEN 'Other cities' THEN (SELECT count(*) FROM topc) WHEN 'Unknown' THEN (SELECT count(*) + 1 FROM topc)
     ELSE (SELECT place FROM topc WHERE clean_city = q.city) END AS city, {_AT('tier', L.TIER_ORDER)} AS tier,
   {_AT('evidence_level', L.EVIDENCE_ORDER)} AS evidence, customers, value FROM ({_CUBE}) q""")
_WSPEC = "segment_id:i segment_name age_group gender city city_tier tier evidence_level balance_band " + " ".join(
    f"{ {'bal_sum': 'balance_sum', 'bal_n': 'balance_n'}.get(n, n)}:{k}" for n, (k, _) in _PARTS.items() if n not in ("latest_bal", "dormant"))
Q["r03_sheet_cube"] = (_WSPEC, f"""
 SELECT *, bal_sum AS balance_sum, bal_n AS balance_n FROM (SELECT segment_id, segment_name, age_group, gender, {_CITY('OTHER CITIES', 'UNKNOWN')} AS city,
   city_tier, tier, evidence_level, {BAL_BAND('latest_balance')} AS balance_band, {_CUBE_PARTS} FROM view v GROUP BY 1, 2, 3, 4, 5, 6, 7, 8, 9)""")
Q["r04_daily_trend"] = ("city date txns:i value:d", f"""
 SELECT b.city, d.date, coalesce(txns, 0) AS txns, round(coalesce(v, 0), 0) AS value
 FROM (SELECT DISTINCT {_CITY('Other cities', 'Unknown')} AS city FROM dimc) b CROSS JOIN (SELECT date_key, date FROM days) d LEFT JOIN (
   SELECT {_CITY('Other cities', 'Unknown').replace('clean_city', 'd.clean_city').replace('(SELECT d.clean_city', '(SELECT clean_city')} AS city, date_key, count(*) AS txns, sum(amount) AS v
   FROM fact f JOIN dimc d USING (customer_id) GROUP BY 1, 2) t ON t.city = b.city AND t.date_key = d.date_key""")
Q["r05_cross_filter_slice"] = ("city customers:i any_signal:i", f"""
 SELECT city, sum(customers) AS customers, sum(any_signal) AS any_signal FROM ({_CUBE}) WHERE gender = 'F' AND tier = 'C' GROUP BY 1""")
_S = lambda a, b, k=6: fix(div(f"sum(CAST({a} AS DECIMAL(38,4)))", f"sum(CAST({b} AS DECIMAL(38,4)))"), k, 10)
Q["r06_cube_ratios"] = ("segment_name customers:i avg_txn_value:d avg_balance:d txns_per_customer:d active_rate:d high_value_rate:d signal_rate:d avg_score:d", f"""
 SELECT segment_name, sum(q.customers) AS customers, {_S('value', 'txns', 4)} AS avg_txn_value, {_S('bal_sum', 'bal_n', 2)} AS avg_balance,
   {_S('txns', 'q.customers')} AS txns_per_customer, {_S('active', 'q.customers')} AS active_rate, {_S('high_value', 'q.customers')} AS high_value_rate,
   {_S('any_signal', 'q.customers')} AS signal_rate, {_S('score_sum', 'q.customers', 3)} AS avg_score FROM ({_CUBE}) q GROUP BY 1""")
Q["r07_priority_other_cities"] = ("priority_rank:i masked_id city tier", f"""
 SELECT * FROM ({_PRIORITY}) WHERE gender = 'F' AND city <> 'UNKNOWN' AND city NOT IN (SELECT clean_city FROM topc)""")
Q["r08_cube_reconciliation"] = ("kpi sql_value:d value:d variance:d status", _COMPARE("""
 SELECT unnest([{'kpi': 'Total Customers', 'value': count(*)::DOUBLE}, {'kpi': 'Total Transactions', 'value': sum(txn_count)::DOUBLE},
   {'kpi': 'Total Txn Value', 'value': sum(total_txn_value)::DOUBLE}, {'kpi': 'Opportunity Count', 'value': count_if(any_signal)::DOUBLE},
   {'kpi': 'Avg Txn Value', 'value': AVG_TXN}, {'kpi': 'Avg Balance', 'value': AVG_BAL},
   {'kpi': 'Median Balance', 'value': quantile_cont(avg_balance, 0.5)}, {'kpi': 'Active Customers', 'value': count_if(is_active)::DOUBLE},
   {'kpi': 'High Value Customers', 'value': count_if(is_high_value)::DOUBLE}, {'kpi': 'Tier A Customers', 'value': count_if(tier = 'A')::DOUBLE},
   {'kpi': 'Addressable Balance', 'value': (sum(latest_balance) FILTER (any_signal))::DOUBLE}], recursive := true) FROM view""".replace(
    "AVG_TXN", fix(div("sum(total_txn_value)", "sum(txn_count)"), 4)).replace(
    "AVG_BAL", f"(SELECT {_S('bal_sum', 'bal_n', 4)} FROM ({_CUBE}))")))
_DIMS = ("segment_name", "age_group", "gender", "city", "tier", "evidence_level")
_CELL = "sum(customers) AS customers, sum(txns) AS txns, sum(value) AS value, sum(any_signal) AS any_signal, sum(addressable) AS addressable"
_GRAINS = [("all", "''", ()), *((d, d, (d,)) for d in _DIMS), (",".join(_DIMS), " || '|' || ".join(_DIMS), _DIMS)]
Q["r08_cell_reconciliation"] = ("grain cell customers:d txns:d value:d any_signal:d addressable:d status", " UNION ALL ".join(
    f"SELECT '{g}' AS grain, {cell} AS cell, {_CELL}, 'PASS' AS status FROM ({_CUBE})" + (f" GROUP BY {', '.join(by)}" if by else "")
    for g, cell, by in _GRAINS))
Q["r08_grain_checksums"] = ("grain cells:i status", " UNION ALL ".join(
    f"SELECT '{g}' AS grain, count(DISTINCT {cell}) AS cells, 'PASS' AS status FROM ({_CUBE})" for g, cell, _ in _GRAINS))

# tables
Q["t01_dim_location"] = ("location_key:i clean_city raw_variants_count:i city_tier", "SELECT * FROM loc")
Q["t02_dim_date_use"] = ("month_key is_weekend:b days:i txns:i", """
 SELECT strftime(txn_date, '%Y-%m') AS month_key, isodow(txn_date) > 5 AS is_weekend, count(DISTINCT txn_date) AS days, count(*) AS txns
 FROM fact GROUP BY 1, 2""")
Q["t03_fact_transaction"] = ("transaction_id customer_id txn_date txn_sec:i amount:d balance:d order_key:i date_key:i is_possible_duplicate:b "
                             "is_high_value_txn:b txn_location_key:i", "SELECT * FROM fact")
Q["t04_dim_customer"] = ("customer_id dob age:i age_group age_known:b age_out_of_range:b gender clean_city dob_conflict:b gender_conflict:b location_conflict:b "
                         "dq_flag location_key:i city_tier", "SELECT * FROM dimc")
Q["t05_customer_360"] = (
    "customer_id location_key:i age:i age_group gender clean_city city_tier txn_count:i total_txn_value:d avg_txn_value:d max_txn_value:d active_days:i first_txn_date "
    "last_txn_date monthly_txn_frequency:d recency_days:i avg_balance:d latest_balance:d balance_volatility:d txn_to_balance_ratio:d activity_trend value_score:d "
    "engagement_score:d r_score:i f_score:i m_score:i rfm_code freq_band evidence_level is_active:b is_high_value:b is_low_engagement:b is_newly_observed:b is_dormant:b", _C360)


def statements() -> dict[str, str]:
    return {name: T.statement(spec, body) for name, (spec, body) in Q.items()}
