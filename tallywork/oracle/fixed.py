"""Fixed values of the statements, written out apart from the engine's own, so a wrong edge there shows as a difference."""

from __future__ import annotations

from datetime import date
from types import SimpleNamespace

# The run over the test log.
P = SimpleNamespace(
    window_start=date(1995, 5, 1), window_end=date(2000, 12, 31), as_of=date(2001, 1, 1), extract_end=date(2001, 5, 31),
    window_days=2072, trend_split=date(1998, 3, 1), active_days=120, dormant_days=480, newly_observed_days=720,
    txn_year_pivot=50, dob_year_pivot=16, min_dob=date(1920, 1, 1), min_age=18, max_age=90,
    tier_1_metros=("NATION 0", "NATION 1", "NATION 2", "NATION 3", "NATION 4", "NATION 5"),
    metro_satellites=("NATION 6", "NATION 7", "NATION 8", "NATION 9"),
    min_city_customers=20, top_cities=10, priority_rows=2000, loan_recency_days=240, near_miss=0.10, overlap_top=100,
    weights=(("V", 0.35), ("E", 0.25), ("Fit", 0.30), ("R", 0.10)), tier_cuts=(("A", 0.05), ("B", 0.20), ("C", 0.50)),
    features=("log_avg_balance", "log_total_value", "log_avg_txn", "txn_count_cap", "recency_days"))

RAW_COLUMNS = ("transaction_id", "customer_id", "customer_dob", "cust_gender", "cust_location", "cust_account_balance",
               "transaction_date", "transaction_time", "transaction_amount")

# Labels, with the exclusive upper edge of each band.
L = SimpleNamespace(
    REJECT_ORDER=("MISSING_TRANSACTION_ID", "DUPLICATE_TRANSACTION_ID", "INVALID_CUSTOMER_ID", "INVALID_TRANSACTION_DATE",
                  "PARTIAL_COVERAGE_PERIOD", "DATE_OUTSIDE_WINDOW", "MISSING_OR_INVALID_AMOUNT", "NEGATIVE_AMOUNT",
                  "ZERO_AMOUNT", "AMOUNT_OUT_OF_RANGE"),
    HOUR_BANDS=((6, "Early morning (00-05)"), (12, "Morning (06-11)"), (17, "Afternoon (12-16)"), (21, "Evening (17-20)"),
                (None, "Night (21-23)")),
    AMOUNT_BANDS=((100, "1. < 100"), (500, "2. 100-499"), (1000, "3. 500-999"), (5000, "4. 1K-4.9K"), (25000, "5. 5K-24.9K"),
                  (None, "6. 25K+")),
    BALANCE_BANDS=((1, "1. Zero (< 1)"), (1000, "2. 1-999"), (10000, "3. 1K-9.9K"), (50000, "4. 10K-49.9K"),
                   (100000, "5. 50K-99.9K"), (1000000, "6. 1L-9.9L"), (None, "7. 10L+")),
    AGE_BANDS=((25, "18-24"), (35, "25-34"), (45, "35-44"), (55, "45-54"), (65, "55-64"), (None, "65+")),
    AGE_ORDER=("18-24", "25-34", "35-44", "45-54", "55-64", "65+", "Unknown"),
    GENDER_ORDER=("F", "M", "Unknown"), TIER_ORDER=("A", "B", "C", "Watch"), EVIDENCE_ORDER=("High", "Medium", "Low"),
    THEMES=("investment", "premium", "credit_card", "insurance", "personal_loan", "reengagement"),
    THEME_LABELS={"investment": "Investment / MF interest", "premium": "Premium account interest",
                  "credit_card": "Credit card interest", "insurance": "Insurance interest",
                  "personal_loan": "Personal loan interest (demand signal only)", "reengagement": "Re-engagement (service)"},
    THEME_NAMES={"investment": "Investment / MF", "premium": "Premium account", "credit_card": "Credit card",
                 "insurance": "Insurance", "personal_loan": "Personal loan (demand)", "reengagement": "Re-engagement"},
    NO_THEME="No rule fully met")

# The weights V, E, Fit and R after one of them moved by 0.10; each row is divided by its sum.
_MOVED = (
    ("V +10 pts", (0.35 + 0.10, 0.25, 0.30, 0.10)), ("V -10 pts", (0.35 - 0.10, 0.25, 0.30, 0.10)),
    ("E +10 pts", (0.35, 0.25 + 0.10, 0.30, 0.10)), ("E -10 pts", (0.35, 0.25 - 0.10, 0.30, 0.10)),
    ("Fit +10 pts", (0.35, 0.25, 0.30 + 0.10, 0.10)), ("Fit -10 pts", (0.35, 0.25, 0.30 - 0.10, 0.10)),
    ("R +10 pts", (0.35, 0.25, 0.30, 0.10 + 0.10)), ("R -10 pts", (0.35, 0.25, 0.30, 0.0)))
SCENARIOS = tuple((name, {k: w / sum(moved) for k, w in zip(("V", "E", "Fit", "R"), moved)}) for name, moved in _MOVED)

# Check, dimension, least share of good rows in percent, rule.
CHECKS = (
    ("DQ-01", "Completeness", 100.0, "Staging rows equal the expected rows"),
    ("DQ-02", "Accuracy", 100.0, "Raw less rejected equals clean"),
    ("DQ-03", "Completeness", 100.0, "Customer, amount and date present"),
    ("DQ-04", "Completeness", 99.0, "Birth date usable"),
    ("DQ-05", "Completeness", 99.0, "Gender known"),
    ("DQ-06", "Completeness", 99.0, "Location known"),
    ("DQ-07", "Completeness", 99.0, "Balance known"),
    ("DQ-08", "Accuracy", 100.0, "Customer table agrees with transactions"),
    ("DQ-09", "Accuracy", 100.0, "Sampled transactions agree with their raw text"),
    ("DQ-10", "Consistency", 100.0, "Gender in its domain"),
    ("DQ-11", "Consistency", 100.0, "Customer city exists"),
    ("DQ-12", "Consistency", 100.0, "One row per customer"),
    ("DQ-13", "Uniqueness", 100.0, "Transaction id unique"),
    ("DQ-14", "Uniqueness", 100.0, "One feature row per customer"),
    ("DQ-15", "Validity", 99.9, "Amount, balance and date in range"),
    ("DQ-16", "Validity", 100.0, "Age in range or unknown"),
    ("DQ-17", "Validity", None, "Rows rejected"),
    ("DQ-18", "Timeliness", 100.0, "As-of date follows the window"),
    ("DQ-19", "Consistency", None, "Customers with conflicting attributes"),
    ("DQ-20", "Consistency", None, "Repeat customers with agreeing attributes"),
    ("DQ-21", "Uniqueness", None, "Possible copies under other ids"),
    ("DQ-22", "Validity", None, "Zero balance rows"),
    ("DQ-23", "Consistency", None, "Raw location texts merged into cities"),
    ("DQ-24", "Validity", 100.0, "Time of day valid"),
)

# The measures that are correlated pair by pair.
CORRELATED = ("txn_count", "total_txn_value", "avg_txn_value", "max_txn_value", "active_days", "recency_days",
              "avg_balance", "latest_balance", "txn_to_balance_ratio", "age", "engagement_score", "value_score")
