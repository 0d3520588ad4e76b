"""Column expressions shared by the stages."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import labels as L


def fixed(value: Column, places: int, inner: int = 6) -> Column:
    """Round half away from zero on a decimal, as a double. ``inner`` is the scale the double is first read at."""
    return F.round(value.cast(f"decimal(38,{inner})"), places).cast("double")


def ratio(top: Column, bottom: Column) -> Column:
    """Double division; a zero or NULL denominator gives NULL."""
    low = bottom.cast("double")
    return F.when(low != 0, top.cast("double") / low)


def percent(top: Column, bottom: Column, places: int = 2) -> Column:
    return fixed(ratio(top, bottom) * 100, places, inner=10)


def mean_of(value: Column, inner: int = 6) -> Column:
    """Mean whose sum is exact, so it does not depend on the order of rows."""
    return ratio(F.sum(value.cast(f"decimal(38,{inner})")), F.count(value))


def share_of(flag: Column) -> Column:
    """Mean of a boolean over its non-null rows."""
    return ratio(F.count_if(flag), F.count(flag))


def band(value: Column, edges, missing: str | None = None) -> Column:
    """First label whose upper edge is above the value."""
    head = F.when(value.isNull(), F.lit(missing))
    for edge, label in edges[:-1]:
        head = head.when(value < edge, F.lit(label))
    return head.otherwise(F.lit(edges[-1][1]))


def balance_band(balance: Column) -> Column:
    return band(balance, L.BALANCE_BANDS, missing="0. Unknown")


def amount_band(amount: Column) -> Column:
    return band(amount, L.AMOUNT_BANDS)


def time_band(hour: Column) -> Column:
    return band(hour, L.HOUR_BANDS, missing="Unknown")


def age_group(age: Column) -> Column:
    return band(age, L.AGE_BANDS, missing="Unknown")


def age_at(dob: Column, as_of: date) -> Column:
    """Completed years: the year difference, less one before the birthday."""
    before_birthday = F.lit(as_of.month * 100 + as_of.day) < F.month(dob) * 100 + F.dayofmonth(dob)
    return F.lit(as_of.year) - F.year(dob) - before_birthday.cast("int")


def date_key(day: Column) -> Column:
    return F.year(day) * 10000 + F.month(day) * 100 + F.dayofmonth(day)


def latest_first(day: Column, seconds: Column, seq: Column, key: Column) -> Column:
    """What orders rows in time: date, time, id number, id text. No missing part is NULL, so any two rows compare."""
    return F.struct(day.alias("day"), F.coalesce(seconds, F.lit(0)).alias("sec"), F.coalesce(seq, F.lit(-1)).alias("seq"),
                    key.alias("id"))


def order_key(day: Column, seconds: Column, seq: Column) -> Column:
    """One long of date, time and id number, as an output. It orders rows only while ids are below 10^7."""
    moment = F.unix_date(day).cast("bigint") * 86400 + F.coalesce(seconds, F.lit(0))
    return moment * 10_000_000 + seq


def city_tier(city: Column, tier_1, satellites) -> Column:
    return (F.when(city == "UNKNOWN", "Unknown")
            .when(city.isin(*tier_1), "Tier 1 metro")
            .when(city.isin(*satellites), "Metro satellite")
            .otherwise("Other"))


def mask_id(text: Column) -> Column:
    return F.concat(F.substring(text, 1, 2), F.lit("***"), F.substring(text, -3, 3))


def score_band(score: Column) -> Column:
    return (F.floor(score / 5) * 5).cast("int")


def contact_plan(score: Column) -> Column:
    return (F.when(score >= 95, "Call this week").when(score >= 90, "Call within 2 weeks")
            .otherwise("Include in campaign"))


def bucket_label(value: Column, is_top: Column, other: str, unknown: str) -> Column:
    """The value itself for a top member, else the label for unknown or other."""
    return F.when(is_top, value).when(value == "UNKNOWN", F.lit(unknown)).otherwise(F.lit(other))


def theme_label(theme: Column) -> Column:
    chain = reduce(lambda acc, kv: acc.when(theme == kv[0], kv[1]), L.THEME_LABELS.items(), F)
    return chain.otherwise(F.lit(L.NO_THEME))


def position_in(value: Column, order) -> Column:
    """Zero-based place of a value in a fixed list."""
    return (F.array_position(F.array(*[F.lit(v) for v in order]), value) - 1).cast("int")


def pair_columns(names) -> Column:
    """Named numeric columns as an array of (measure, value) pairs, for ``F.inline``."""
    return F.array(*[F.struct(F.lit(n).alias("measure"), F.col(n).cast("double").alias("value")) for n in names])
