"""Every rule constant of a run, in one frozen object."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from datetime import date, timedelta

# The default city tiers.
TIER_1_METROS = ("MUMBAI", "NEW DELHI", "DELHI", "BANGALORE", "CHENNAI", "KOLKATA", "HYDERABAD", "PUNE", "AHMEDABAD")
METRO_SATELLITES = ("GURGAON", "NOIDA", "GREATER NOIDA", "GHAZIABAD", "FARIDABAD", "THANE", "NAVI MUMBAI",
                    "SECUNDERABAD", "RANGA REDDY")


@dataclass(frozen=True)
class Params:
    """Window, rules, cut-offs and sizes. The defaults are a 46-day window."""

    window_start: date = date(2016, 8, 1)
    window_end: date = date(2016, 9, 15)
    extract_end: date = date(2016, 10, 21)
    trend_split: date = date(2016, 8, 24)
    active_days: int = 15
    dormant_days: int = 30
    newly_observed_days: int = 15
    txn_year_pivot: int = 99
    dob_year_pivot: int = 16
    min_dob: date = date(1920, 1, 1)
    min_age: int = 18
    max_age: int = 90
    tier_1_metros: tuple[str, ...] = TIER_1_METROS
    metro_satellites: tuple[str, ...] = METRO_SATELLITES
    expected_rows: int | None = 1_048_567
    min_city_customers: int = 1000
    top_cities: int = 25
    priority_rows: int = 2000
    loan_recency_days: int = 15
    near_miss: float = 0.10
    weights: tuple[tuple[str, float], ...] = (("V", 0.35), ("E", 0.25), ("Fit", 0.30), ("R", 0.10))
    tier_cuts: tuple[tuple[str, float], ...] = (("A", 0.05), ("B", 0.20), ("C", 0.50))
    overlap_top: int = 1000
    seed: int = 42
    starts: int = 10
    grid_k: tuple[int, ...] = (3, 4, 5, 6, 7, 8, 9, 10)
    grid_seeds: tuple[int, ...] = (1, 2, 3, 4, 5)
    features: tuple[str, ...] = field(
        default=("log_avg_balance", "log_total_value", "log_avg_txn", "txn_count_cap", "recency_days"))

    @property
    def as_of(self) -> date:
        return self.window_end + timedelta(days=1)

    @property
    def window_days(self) -> int:
        return (self.window_end - self.window_start).days + 1

    def but(self, **changes) -> "Params":
        return replace(self, **changes)
