"""Shared table expressions. ``statement`` puts the ones a query needs in front of it."""

from __future__ import annotations

import re

from .fixed import L, P

TYPES = {"i": "BIGINT", "d": "DOUBLE", "s": "VARCHAR", "b": "BOOLEAN"}


def fix(x: str, places: int, inner: int = 6) -> str:
    return f"CAST(ROUND(CAST({x} AS DECIMAL(38,{inner})), {places}) AS DOUBLE)"


def div(a: str, b: str) -> str:
    return f"(CAST({a} AS DOUBLE) / NULLIF(CAST({b} AS DOUBLE), 0))"


def pct(a: str, b: str, places: int = 2) -> str:
    return fix(f"{div(a, b)} * 100", places, 10)


def mean(x: str, inner: int = 6) -> str:
    return div(f"SUM(CAST({x} AS DECIMAL(38,{inner})))", f"COUNT({x})")


def bands(x: str, edges, missing: str | None = None) -> str:
    head = f"WHEN {x} IS NULL THEN '{missing}' " if missing else ""
    return "CASE " + head + " ".join(f"WHEN {x} < {e} THEN '{v}'" for e, v in edges[:-1]) + f" ELSE '{edges[-1][1]}' END"


def dmy(x: str, pivot: int) -> str:
    y = f"split_part(trim({x}), '/', 3)"
    year = f"CASE WHEN length({y}) = 4 THEN {y} WHEN TRY_CAST({y} AS INT) <= {pivot} THEN '20' || {y} ELSE '19' || {y} END"
    text = f"({year}) || '-' || split_part(trim({x}), '/', 2) || '-' || split_part(trim({x}), '/', 1)"
    return f"CASE WHEN regexp_full_match(trim({x}), '\\d{{1,2}}/\\d{{1,2}}/(\\d{{2}}|\\d{{4}})') THEN TRY_CAST({text} AS DATE) END"


def money(x: str) -> str:
    return (f"CASE WHEN regexp_full_match(trim({x}), '-?\\d+(\\.\\d+)?([eE][-+]?\\d+)?') "
            f"THEN TRY_CAST(trim({x}) AS DECIMAL(38,2)) END")


def known_rank(fn: str, x: str, order: str = "") -> str:
    """A rank among the rows where x is known."""
    return f"CASE WHEN {x} IS NOT NULL THEN {fn}() OVER (PARTITION BY {x} IS NOT NULL ORDER BY {x} {order}) END"


def _list(names) -> str:
    return ", ".join(f"'{n}'" for n in names)


STG = """
 WITH base AS (
SELECT o.o_orderkey AS src_row,
 CASE WHEN o.o_orderkey % 997 = 13 THEN '' WHEN o.o_orderkey % 499 = 17 THEN 'T' || CAST(o.o_orderkey - 1 AS STRING) ELSE 'T' || CAST(o.o_orderkey AS STRING) END AS transaction_id,
 CASE WHEN o.o_orderkey % 601 = 19 THEN 'X' ELSE 'C' END || CAST(o.o_custkey AS STRING) AS customer_id,
 CASE WHEN o.o_custkey % 17 = 0 THEN '1/1/1800' WHEN o.o_orderkey % 59 = 1 THEN 'nan'
      ELSE CAST(1 + (o.o_custkey + o.o_orderkey % 3) % 28 AS STRING) || '/' || CAST(1 + o.o_custkey % 12 AS STRING) || '/' || lpad(CAST((30 + (o.o_custkey * 7) % 71) % 100 AS STRING), 2, '0') END AS customer_dob,
 CASE WHEN o.o_orderkey % 401 = 0 THEN '' WHEN o.o_orderkey % 1009 = 5 THEN 'T' WHEN (o.o_custkey + CASE WHEN o.o_orderkey % 5 = 4 THEN 1 ELSE 0 END) % 2 = 0 THEN 'F' ELSE 'm ' END AS cust_gender,
 CASE WHEN o.o_orderkey % 701 = 3 THEN ' .' WHEN o.o_orderkey % 7 = 0 THEN lower(n.n_name) WHEN o.o_orderkey % 11 = 0 THEN replace(n.n_name, 'NATION', 'NATON') WHEN o.o_orderkey % 9 = 2 THEN 'NATION_' || CAST((c.c_nationkey + 1) % 25 AS STRING)
      WHEN o.o_orderkey % 13 = 0 THEN ' ' || replace(n.n_name, '_', ' - ') ELSE n.n_name END AS cust_location,
 CASE WHEN o.o_orderkey % 311 = 8 THEN '' WHEN o.o_orderkey % 127 = 6 THEN '0.5' ELSE CAST(CAST(c.c_acctbal + o.o_orderkey % 1000 AS DECIMAL(18,2)) AS STRING) END AS cust_account_balance,
 CASE WHEN o.o_orderkey % 503 = 9 THEN '31/2/98' ELSE CAST(day(o.o_orderdate) AS STRING) || '/' || CAST(month(o.o_orderdate) AS STRING) || '/' || substr(CAST(year(o.o_orderdate) AS STRING), 3, 2) END AS transaction_date,
 CASE WHEN o.o_orderkey % 809 = 11 THEN '250000' ELSE CAST(((o.o_orderkey * 7919) % 24) * 10000 + ((o.o_orderkey * 31) % 60) * 100 + (o.o_orderkey * 17) % 60 AS STRING) END AS transaction_time,
 CASE WHEN o.o_orderkey % 331 = 3 THEN '0' WHEN o.o_orderkey % 337 = 4 THEN '-5' WHEN o.o_orderkey % 347 = 6 THEN '' WHEN o.o_orderkey % 353 = 5 THEN '1.5E3' ELSE CAST(CAST(o.o_totalprice AS DECIMAL(18,2)) AS STRING) END AS transaction_amount
FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey
)
SELECT * FROM base
UNION ALL
SELECT src_row + 100000000, 'T' || CAST(src_row + 100000000 AS STRING), customer_id, customer_dob, cust_gender,
       cust_location, cust_account_balance, transaction_date, transaction_time, transaction_amount
FROM base WHERE src_row % 211 = 7
"""

D = lambda x: f"DATE '{x.isoformat()}'"
W = P.window_days
BAL_BAND = lambda x: bands(x, L.BALANCE_BANDS, "0. Unknown")

TABLES: dict[str, str] = {"stg": STG}
CLOCK = "TRY_CAST(trim(transaction_time) AS INT)"
TABLES["typed"] = f"""
 SELECT *, trim(transaction_id) AS txn_id, trim(customer_id) AS cust_id,
   {dmy('transaction_date', P.txn_year_pivot)} AS txn_date, {dmy('customer_dob', P.dob_year_pivot)} AS dob_parsed,
   CASE WHEN regexp_full_match(trim(transaction_time), '\\d{{1,6}}') AND {CLOCK} // 10000 < 24 AND {CLOCK} // 100 % 100 < 60
       AND {CLOCK} % 100 < 60 THEN {CLOCK} // 10000 * 3600 + {CLOCK} // 100 % 100 * 60 + {CLOCK} % 100 END AS txn_sec,
   {money('transaction_amount')} AS amount, {money('cust_account_balance')} AS balance_parsed,
   NULLIF(trim(regexp_replace(regexp_replace(upper(cust_location), '[^A-Z0-9 ]', ' ', 'g'), '\\s+', ' ', 'g')), '') AS location_norm
 FROM stg"""
TABLES["classified"] = f"""
 SELECT t.*, CASE
   WHEN coalesce(txn_id, '') = '' THEN 'MISSING_TRANSACTION_ID'
   WHEN row_number() OVER (PARTITION BY txn_id ORDER BY src_row) > 1 THEN 'DUPLICATE_TRANSACTION_ID'
   WHEN NOT coalesce(regexp_full_match(cust_id, 'C[0-9]+'), false) THEN 'INVALID_CUSTOMER_ID'
   WHEN txn_date IS NULL THEN 'INVALID_TRANSACTION_DATE'
   WHEN txn_date > {D(P.window_end)} AND txn_date <= {D(P.extract_end)} THEN 'PARTIAL_COVERAGE_PERIOD'
   WHEN txn_date < {D(P.window_start)} OR txn_date > {D(P.window_end)} THEN 'DATE_OUTSIDE_WINDOW'
   WHEN transaction_amount IS NULL OR NOT regexp_full_match(trim(transaction_amount), '-?\\d+(\\.\\d+)?([eE][-+]?\\d+)?')
     THEN 'MISSING_OR_INVALID_AMOUNT'
   WHEN amount < 0 THEN 'NEGATIVE_AMOUNT' WHEN amount = 0 THEN 'ZERO_AMOUNT'
   WHEN TRY_CAST(amount AS DECIMAL(18,2)) IS NULL THEN 'AMOUNT_OUT_OF_RANGE' END AS reject_reason
 FROM typed t"""
TABLES["tidy"] = f"""
 SELECT src_row, txn_id AS transaction_id, CAST(substr(txn_id, 2) AS BIGINT) AS txn_seq, cust_id AS customer_id, txn_date,
   txn_sec, CAST(amount AS DECIMAL(18,2)) AS amount, TRY_CAST(CASE WHEN balance_parsed >= 0 THEN balance_parsed END AS DECIMAL(18,2)) AS balance,
   CASE WHEN dob_parsed BETWEEN {D(P.min_dob)} AND txn_date THEN dob_parsed END AS dob,
   CASE upper(trim(cust_gender)) WHEN 'M' THEN 'M' WHEN 'F' THEN 'F' ELSE 'Unknown' END AS gender,
   coalesce(CASE WHEN regexp_full_match(location_norm, 'NATON (\\d|1\\d|2[0-4])') THEN replace(location_norm, 'NATON', 'NATION')
            ELSE location_norm END, 'UNKNOWN') AS clean_city,
   cust_location AS raw_location, lower(trim(customer_dob)) IN ('', 'nan') AS dob_missing,
   dob_parsed < {D(P.min_dob)} AS dob_placeholder, dob_parsed > txn_date AS dob_future,
   balance_parsed IS NULL AS balance_missing, balance_parsed < 0 AS balance_negative,
   txn_sec IS NULL AS time_invalid, upper(trim(cust_gender)) NOT IN ('M', 'F', '') AS gender_other_value
 FROM classified WHERE reject_reason IS NULL"""
TABLES["clean"] = """
 SELECT *, count(*) OVER (PARTITION BY customer_id, dob, gender, clean_city, balance, txn_date, txn_sec, amount) > 1
   AS is_possible_duplicate FROM tidy"""
TABLES["waterfall"] = f"""
 SELECT 0 AS step_no, 'Raw rows in staging' AS step, count(*) AS rows FROM classified
 UNION ALL SELECT 10 + row_number() OVER (ORDER BY list_position([{_list(L.REJECT_ORDER)}], reject_reason)),
   'Rejected: ' || reject_reason, -count(*) FROM classified WHERE reject_reason IS NOT NULL GROUP BY reject_reason
 UNION ALL SELECT 99, 'Clean rows', count(*) FROM classified WHERE reject_reason IS NULL"""
TABLES["loc"] = f"""
 SELECT row_number() OVER (ORDER BY clean_city) AS location_key, clean_city, count(DISTINCT raw_location) AS raw_variants_count,
   CASE WHEN clean_city = 'UNKNOWN' THEN 'Unknown' WHEN clean_city IN ({_list(P.tier_1_metros)}) THEN 'Tier 1 metro'
     WHEN clean_city IN ({_list(P.metro_satellites)}) THEN 'Metro satellite' ELSE 'Other' END AS city_tier
 FROM tidy GROUP BY clean_city"""
TABLES["days"] = f"""
 SELECT CAST(strftime(d, '%Y%m%d') AS BIGINT) AS date_key, d AS date, year(d) AS year, month(d) AS month,
   strftime(d, '%b %Y') AS month_name, strftime(d, '%Y-%m') AS month_key, CAST(date_trunc('week', d) AS DATE) AS week_start,
   weekofyear(d) AS iso_week, dayname(d) AS day_of_week, isodow(d) AS day_of_week_num, isodow(d) >= 6 AS is_weekend,
   date_diff('day', d, {D(P.as_of)}) AS days_before_as_of
 FROM (SELECT CAST(unnest(generate_series({D(P.window_start)}, {D(P.window_end)}, INTERVAL 1 DAY)) AS DATE) AS d)"""
TABLES["p95"] = "SELECT quantile_cont(CAST(amount AS DOUBLE), 0.95) AS v FROM tidy"
TABLES["fact"] = f"""
 SELECT c.*, (epoch(CAST(txn_date AS TIMESTAMP))::BIGINT + coalesce(txn_sec, 0)) * 10000000 + txn_seq AS order_key,
   CAST(strftime(txn_date, '%Y%m%d') AS BIGINT) AS date_key, txn_sec // 3600 AS txn_hour,
   {bands('(txn_sec // 3600)', L.HOUR_BANDS, 'Unknown')} AS time_band, dayname(txn_date) AS day_of_week,
   {bands('amount', L.AMOUNT_BANDS)} AS amount_band, {BAL_BAND('balance')} AS balance_band,
   CAST(amount AS DOUBLE) >= (SELECT v FROM p95) AS is_high_value_txn, balance < 1 AS is_zero_balance,
   l.location_key AS txn_location_key
 FROM clean c JOIN loc l USING (clean_city)"""


_AT = "{'d': txn_date, 's': coalesce(txn_sec, 0), 'q': coalesce(txn_seq, -1), 'i': transaction_id}"


def _pick(attribute: str, missing: str) -> str:
    return f"""SELECT customer_id, {attribute} AS v, count(*) OVER (PARTITION BY customer_id) AS n_values
   FROM fact WHERE {missing} GROUP BY customer_id, {attribute}
   QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY count(*) DESC, max({_AT}) DESC) = 1"""


TABLES["pick_dob"] = _pick("dob", "dob IS NOT NULL")
TABLES["pick_gender"] = _pick("gender", "gender <> 'Unknown'")
TABLES["pick_city"] = _pick("clean_city", "clean_city <> 'UNKNOWN'")
TABLES["resolved"] = f"""
 SELECT k.customer_id, d.v AS dob, year({D(P.as_of)}) - year(d.v)
     - CASE WHEN strftime({D(P.as_of)}, '%m%d') < strftime(d.v, '%m%d') THEN 1 ELSE 0 END AS raw_age,
   coalesce(g.v, 'Unknown') AS gender, coalesce(c.v, 'UNKNOWN') AS clean_city, coalesce(d.n_values, 0) > 1 AS dob_conflict,
   coalesce(g.n_values, 0) > 1 AS gender_conflict, coalesce(c.n_values, 0) > 1 AS location_conflict
 FROM (SELECT DISTINCT customer_id FROM fact) k LEFT JOIN pick_dob d USING (customer_id)
 LEFT JOIN pick_gender g USING (customer_id) LEFT JOIN pick_city c USING (customer_id)"""
_OK_AGE = f"raw_age BETWEEN {P.min_age} AND {P.max_age}"
TABLES["dimc"] = f"""
 SELECT customer_id, dob, CASE WHEN {_OK_AGE} THEN raw_age END AS age,
   CASE WHEN {_OK_AGE} THEN {bands('raw_age', L.AGE_BANDS)} ELSE 'Unknown' END AS age_group, {_OK_AGE} AS age_known,
   coalesce(NOT ({_OK_AGE}), false) AS age_out_of_range, gender, l.location_key, r.clean_city, l.city_tier, dob_conflict,
   gender_conflict, location_conflict,
   NULLIF(array_to_string(list_filter([CASE WHEN dob IS NULL THEN 'DOB_MISSING' END,
     CASE WHEN NOT ({_OK_AGE}) THEN 'AGE_OUT_OF_RANGE' END, CASE WHEN gender = 'Unknown' THEN 'GENDER_UNKNOWN' END,
     CASE WHEN r.clean_city = 'UNKNOWN' THEN 'LOCATION_UNKNOWN' END,
     CASE WHEN dob_conflict OR gender_conflict OR location_conflict THEN 'ATTRIBUTE_CONFLICT' END],
     lambda x: x IS NOT NULL), ','), '') AS dq_flag
 FROM resolved r JOIN loc l USING (clean_city)"""
TABLES["perc"] = f"""
 SELECT customer_id, count(*) AS txn_count, sum(amount) AS total_txn_value, max(amount) AS max_txn_value,
   min(amount) AS min_txn_value, count(DISTINCT txn_date) AS active_days, min(txn_date) AS first_txn_date,
   max(txn_date) AS last_txn_date, {div('sum(balance)', 'count(balance)')} AS avg_balance, max(balance) AS max_balance,
   min(balance) AS min_balance, count(balance) AS balance_obs,
   CASE WHEN count(balance) >= 2 THEN sqrt(CAST(CAST(count(balance) AS DECIMAL(10,0)) * CAST(sum(balance * balance) AS DECIMAL(28,4))
     - CAST(sum(balance) AS DECIMAL(19,2)) * CAST(sum(balance) AS DECIMAL(19,2)) AS DOUBLE)
     / CAST(count(balance) * (count(balance) - 1) AS DOUBLE)) END AS sd,
   arg_max(balance, {_AT}) FILTER (WHERE balance IS NOT NULL) AS latest_balance,
   {div('count(*) FILTER (WHERE txn_hour >= 17 OR txn_hour < 6)', 'count(txn_hour)')} AS evening_night_share,
   count(*) FILTER (WHERE txn_date < {D(P.trend_split)}) AS txns_first_half,
   count(*) FILTER (WHERE txn_date >= {D(P.trend_split)}) AS txns_second_half,
   count(*) FILTER (WHERE is_high_value_txn) AS high_value_txn_count
 FROM fact GROUP BY customer_id"""
TABLES["feat"] = f"""
 SELECT *, {div('total_txn_value', 'txn_count')} AS avg_txn_value, txn_count / CAST({W / 30.0!r} AS DOUBLE) AS monthly_txn_frequency,
   date_diff('day', last_txn_date, {D(P.as_of)}) AS recency_days,
   CASE WHEN balance_obs >= 2 AND avg_balance > 0 THEN sd / avg_balance END AS balance_volatility,
   CASE WHEN latest_balance >= 1 THEN {div('total_txn_value', 'txn_count')} / CAST(latest_balance AS DOUBLE) END AS txn_to_balance_ratio
 FROM perc"""
TABLES["scored"] = f"""
 SELECT *, {fix(f"100 * (CAST(0.5 AS DOUBLE) * least(txn_count, 4) / CAST(4 AS DOUBLE) + CAST(0.3 AS DOUBLE) * (1 - CAST(least(recency_days, {W}) AS DOUBLE) / {W}) + CAST(0.2 AS DOUBLE) * least(active_days, 4) / CAST(4 AS DOUBLE))", 2, 10)} AS engagement_score,
   percent_rank() OVER (ORDER BY total_txn_value) AS pct_total_value, {known_rank('percent_rank', 'avg_balance')} AS pct_avg_balance,
   cume_dist() OVER (ORDER BY total_txn_value) AS pr_total, {known_rank('cume_dist', 'avg_balance')} AS pr_balance,
   cume_dist() OVER (ORDER BY recency_days DESC) AS cd_recency_desc,
   {known_rank('cume_dist', 'txn_to_balance_ratio')} AS pr_ratio
 FROM feat"""
TABLES["placed"] = """
 SELECT *, cume_dist() OVER (ORDER BY engagement_score) AS pr_engagement,
   percent_rank() OVER (ORDER BY coalesce(CAST(0.5 AS DOUBLE) * pct_avg_balance + CAST(0.5 AS DOUBLE) * pct_total_value, pct_total_value)) AS pct_value
 FROM scored"""
TABLES["thr"] = """
 SELECT quantile_cont(CAST(latest_balance AS DOUBLE), 0.9) AS latest_balance_p90,
   quantile_cont(CAST(total_txn_value AS DOUBLE), 0.9) AS total_txn_value_p90,
   quantile_cont(engagement_score, 0.25) AS engagement_p25, quantile_cont(avg_balance, 0.5) AS avg_balance_p50,
   quantile_cont(avg_balance, 0.75) AS avg_balance_p75, quantile_cont(avg_balance, 0.9) AS avg_balance_p90,
   (SELECT v FROM p95) AS txn_amount_p95 FROM placed"""
TABLES["c360"] = f"""
 SELECT p.*, age, age_group, age_known, gender, location_key, clean_city, city_tier,
   CASE WHEN txn_count = 1 THEN 'Single transaction' WHEN txns_second_half > txns_first_half THEN 'Rising'
     WHEN txns_second_half < txns_first_half THEN 'Declining' ELSE 'Stable' END AS activity_trend,
   {fix('100 * pct_value', 2, 10)} AS value_score, CAST(ceil(cd_recency_desc * 5) AS INT) AS r_score,
   least(txn_count, 5) AS f_score, CAST(ceil(pr_total * 5) AS INT) AS m_score,
   concat(CAST(ceil(cd_recency_desc * 5) AS INT), least(txn_count, 5), CAST(ceil(pr_total * 5) AS INT)) AS rfm_code,
   CASE txn_count WHEN 1 THEN 'Single' WHEN 2 THEN 'Repeat' ELSE 'Frequent' END AS freq_band,
   CASE txn_count WHEN 1 THEN 'Low' WHEN 2 THEN 'Medium' ELSE 'High' END AS evidence_level,
   recency_days <= {P.active_days} AS is_active, recency_days > {P.dormant_days} AS is_dormant,
   first_txn_date >= {D(P.as_of)} - {P.newly_observed_days} AS is_newly_observed, latest_balance < 1 AS is_zero_balance,
   coalesce(CAST(latest_balance AS DOUBLE) >= (SELECT latest_balance_p90 FROM thr), false)
     OR CAST(total_txn_value AS DOUBLE) >= (SELECT total_txn_value_p90 FROM thr) AS is_high_value,
   engagement_score < (SELECT engagement_p25 FROM thr) AS is_low_engagement
 FROM placed p JOIN dimc USING (customer_id)"""


def fit(conditions: list[tuple[str, str | None]]) -> str:
    met = [f"coalesce({m}, false)" for m, _ in conditions]
    missed = " + ".join(f"CAST(NOT {m} AS INT)" for m in met)
    near = " OR ".join(f"(NOT {m} AND coalesce({g} <= CAST({P.near_miss} AS DOUBLE), false))"
                       for m, (_, g) in zip(met, conditions) if g) or "false"
    return f"CAST(CASE WHEN {missed} = 0 THEN 1.0 WHEN {missed} = 1 AND ({near}) THEN 0.5 ELSE 0.0 END AS DOUBLE)"


def _num(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def over(x: str, q: float) -> tuple[str, str]:
    return f"{x} >= {_num(q)}", f"({_num(q)} - {x})"


RULES = {
    "investment": [over("pr_balance", 0.75), (f"(txn_count >= 2 OR pr_total >= {_num(0.6)})", f"({_num(0.6)} - pr_total)")],
    "premium": [over("pr_balance", 0.9)],
    "credit_card": [over("pr_total", 0.6), over("pr_balance", 0.4), ("age BETWEEN 21 AND 60", None)],
    "insurance": [("age BETWEEN 30 AND 55", None), over("pr_balance", 0.5)],
    "personal_loan": [("age BETWEEN 25 AND 45", None), over("pr_ratio", 0.75), (f"recency_days <= {P.loan_recency_days}", None)],
    "reengagement": [(f"pr_engagement < {_num(0.25)}", f"(pr_engagement - {_num(0.25)} + {_num(1e-9)})"), over("pr_balance", 0.5)],
}


def score(w: dict[str, float], fit_column: str) -> str:
    return (f"100 * ({_num(w['V'])} * (value_score / CAST(100 AS DOUBLE)) + {_num(w['E'])} * (engagement_score / CAST(100 AS DOUBLE))"
            f" + {_num(w['R'])} * (1 - CAST(least(recency_days, {W}) AS DOUBLE) / {W}) + {_num(w['Fit'])} * {fit_column})")


def best(w: dict[str, float]) -> str:
    return "greatest(" + ", ".join(score(w, f"fit_{t}") for t in L.THEMES) + ")"


TABLES["fits"] = "SELECT *, " + ", ".join(f"{fit(r)} AS fit_{t}" for t, r in RULES.items()) + " FROM c360"
TABLES["ranked"] = f"""
 SELECT *, row_number() OVER (ORDER BY raw_score DESC, value_score DESC, customer_id) AS priority_rank
 FROM (SELECT *, {best(dict(P.weights))} AS raw_score FROM fits)"""
_TOP_FIT = "greatest(" + ", ".join(f"fit_{t}" for t in L.THEMES) + ")"
_THEME = f"CASE WHEN {_TOP_FIT} = 0 THEN 'none' " + " ".join(
    f"WHEN fit_{t} = {_TOP_FIT} THEN '{t}'" for t in L.THEMES) + " END"
_LABEL = "CASE driving_theme " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in L.THEME_LABELS.items()) + f" ELSE '{L.NO_THEME}' END"
_SIGNALS = " + ".join(f"CAST(fit_{t} = 1 AS INT)" for t in L.THEMES)
TABLES["opp"] = f"""
 SELECT customer_id, substr(customer_id, 1, 2) || '***' || right(customer_id, 3) AS masked_id,
   {', '.join(f"fit_{t} = 1 AS sig_{t}, fit_{t}, {fix(score(dict(P.weights), f'fit_{t}'), 3, 10)} AS os_{t}" for t in L.THEMES)},
   {_SIGNALS} AS signal_count, {_SIGNALS} > 0 AS any_signal, {fix('raw_score', 3, 10)} AS overall_score, driving_theme,
   {_LABEL} AS driving_theme_label, priority_rank,
   CASE {' '.join(f"WHEN CAST(priority_rank AS DOUBLE) / count(*) OVER () <= {_num(cut)} THEN '{t}'" for t, cut in P.tier_cuts)} ELSE 'Watch' END AS tier,
   evidence_level, CASE WHEN avg_balance IS NULL THEN 'balance unknown' ELSE 'avg balance Rs ' || format('{{:,.0f}}', avg_balance) || ' (top '
     || CAST(CAST(round_even(greatest(100 * (1 - pr_balance), 1), 0) AS INT) AS VARCHAR) || '%)' END || ', ' || txn_count || ' txn'
     || CASE WHEN txn_count = 1 THEN '' ELSE 's' END || ', last seen ' || recency_days || ' day'
     || CASE WHEN recency_days = 1 THEN '' ELSE 's' END || ' ago -> ' || {_LABEL} AS reason
 FROM (SELECT *, {_THEME} AS driving_theme FROM ranked)"""

CENTROIDS = {"J": [(0.2, 0.9, 0.0, 1.2, -0.8), (0.3, 0.3, 0.8, -0.7, -0.7), (0.3, 0.1, 0.6, -0.6, 0.9),
                   (0.1, -1.3, -1.3, -0.5, 0.1), (-2.0, -0.1, 0.0, 0.0, 0.0)]}
FEATS = P.features
TABLES["rawf"] = """
 SELECT customer_id, value_score, ln(1 + coalesce(avg_balance, (SELECT quantile_cont(avg_balance, 0.5) FROM c360))) AS log_avg_balance,
   ln(1 + CAST(total_txn_value AS DOUBLE)) AS log_total_value, ln(1 + avg_txn_value) AS log_avg_txn,
   CAST(least(txn_count, 4) AS DOUBLE) AS txn_count_cap, CAST(recency_days AS DOUBLE) AS recency_days FROM c360"""
TABLES["capped"] = "SELECT customer_id, value_score, " + ", ".join(
    f"least(greatest({f}, (SELECT quantile_cont({f}, 0.01) FROM rawf)), (SELECT quantile_cont({f}, 0.99) FROM rawf)) AS {f}"
    for f in FEATS) + " FROM rawf"
TABLES["scaled"] = "SELECT customer_id, value_score, " + ", ".join(
    f"({f} - (SELECT avg({f}) FROM capped)) / (SELECT stddev_pop({f}) FROM capped) AS {f}" for f in FEATS) + " FROM capped"
_POINTS = " UNION ALL ".join(
    f"SELECT {i} AS label, " + ", ".join(f"{_num(v)} AS c_{f}" for f, v in zip(FEATS, center)) for i, center in enumerate(CENTROIDS["J"]))
TABLES["labelled"] = f"""
 SELECT s.*, k.label FROM scaled s CROSS JOIN ({_POINTS}) k
 QUALIFY row_number() OVER (PARTITION BY s.customer_id ORDER BY {' + '.join(f'(s.{f} - c_{f}) ** 2' for f in FEATS)}, label) = 1"""
TABLES["keys"] = f"""
 SELECT label, 'J' || (row_number() OVER (ORDER BY {mean('value_score', 10)} DESC, label) - 1) AS cluster_key FROM labelled GROUP BY label"""
TABLES["defs"] = "SELECT * FROM (VALUES " + ", ".join(f"('J{i}', {i + 1}, '{n}')" for i, n in enumerate((
    "Engaged Repeat Users", "Recent One-Time Spenders", "Lapsed One-Time Spenders", "Low-Ticket Occasional", "Near-Zero Balance"))) + \
    ") t(cluster_key, segment_id, segment_name)"
TABLES["seg"] = """
 SELECT customer_id, cluster_key, segment_id, segment_name,
   CASE WHEN txn_count = 1 THEN 'Single transaction' ELSE 'Repeat' END AS layer, 'joint KMeans' AS method
 FROM labelled JOIN keys USING (label) JOIN c360 USING (customer_id) JOIN defs USING (cluster_key)"""
TABLES["later"] = "SELECT r.* REPLACE (r.recency_days + 7 AS recency_days) FROM rawf r"
TABLES["later_scaled"] = "SELECT customer_id, " + ", ".join(
    f"(least(greatest({f}, (SELECT quantile_cont({f}, 0.01) FROM rawf)), (SELECT quantile_cont({f}, 0.99) FROM rawf))"
    f" - (SELECT avg({f}) FROM capped)) / (SELECT stddev_pop({f}) FROM capped) AS {f}" for f in FEATS) + " FROM later"
TABLES["later_labels"] = f"""
 SELECT s.customer_id, k.label FROM later_scaled s CROSS JOIN ({_POINTS}) k
 QUALIFY row_number() OVER (PARTITION BY s.customer_id ORDER BY {' + '.join(f'(s.{f} - c_{f}) ** 2' for f in FEATS)}, label) = 1"""
TABLES["view"] = """
 SELECT c.*, s.cluster_key, s.segment_id, s.segment_name, s.layer, o.* EXCLUDE (customer_id, evidence_level)
 FROM c360 c JOIN seg s USING (customer_id) JOIN opp o USING (customer_id)"""
TABLES["topc"] = f"""
 SELECT clean_city, row_number() OVER (ORDER BY sum(total_txn_value) DESC, clean_city) - 1 AS place FROM view
 WHERE clean_city <> 'UNKNOWN' GROUP BY clean_city ORDER BY sum(total_txn_value) DESC, clean_city LIMIT {P.top_cities}"""
TABLES["dailyc"] = """
 SELECT f.date_key, d.location_key, count(*) AS txns, sum(amount) AS total_value,
   count(*) FILTER (WHERE is_high_value_txn) AS high_value_txns, count(DISTINCT customer_id) AS customers
 FROM fact f JOIN dimc d USING (customer_id) GROUP BY ALL"""
TABLES["kpi"] = f"""
 SELECT unnest([{{'kpi': 'Total Customers', 'v': CAST(count(*) AS DOUBLE)}}, {{'kpi': 'Total Transactions', 'v': sum(txn_count)::DOUBLE}},
   {{'kpi': 'Total Txn Value', 'v': sum(total_txn_value)::DOUBLE}},
   {{'kpi': 'Avg Txn Value', 'v': {fix(div('sum(total_txn_value)', 'sum(txn_count)'), 4)}}},
   {{'kpi': 'Avg Balance', 'v': {fix(mean('avg_balance'), 4)}}}, {{'kpi': 'Median Balance', 'v': quantile_cont(avg_balance, 0.5)}},
   {{'kpi': 'Active Customers', 'v': (count(*) FILTER (WHERE is_active))::DOUBLE}},
   {{'kpi': 'High Value Customers', 'v': (count(*) FILTER (WHERE is_high_value))::DOUBLE}},
   {{'kpi': 'Opportunity Count', 'v': (count(*) FILTER (WHERE any_signal))::DOUBLE}},
   {{'kpi': 'Tier A Customers', 'v': (count(*) FILTER (WHERE tier = 'A'))::DOUBLE}},
   {{'kpi': 'Addressable Balance', 'v': (sum(latest_balance) FILTER (WHERE any_signal))::DOUBLE}}], recursive := true) FROM view"""


def needed(text: str, seen: dict[str, None] | None = None) -> dict[str, None]:
    """Table names a statement reads, dependencies first."""
    seen = {} if seen is None else seen
    for name in TABLES:
        if name not in seen and re.search(rf"\b(FROM|JOIN) {name}\b", text):
            needed(TABLES[name], seen)
            seen[name] = None
    return seen


def columns_of(spec: str) -> list[tuple[str, str]]:
    out = []
    for part in spec.split():
        name, _, kind = part.partition(":")
        out.append((name, kind or "s"))
    return out


def statement(spec: str, body: str) -> str:
    """``spec`` lists the output columns as name:kind, with kind i, d, s, b (dates go out as text)."""
    tables = ", ".join(f"{n} AS MATERIALIZED ({TABLES[n]})" for n in needed(body))
    head = f"WITH {tables} " if tables else ""
    shown = ", ".join(f"CAST({n} AS {TYPES[k]}) AS {n}" for n, k in columns_of(spec))
    return f"{head}SELECT {shown} FROM ({body}) q"
