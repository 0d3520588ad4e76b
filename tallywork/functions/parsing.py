"""Raw text to typed values. Bad text gives NULL, never an error."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# The accepted shapes.
DMY = r"^(\d{1,2})/(\d{1,2})/(\d{2}|\d{4})\z"
HHMMSS = r"^\d{1,6}\z"
NUMBER = r"^-?\d+(\.\d+)?([eE][-+]?\d+)?\z"
CUSTOMER_ID = r"^C[0-9]+\z"
MONEY, RAW_MONEY = "decimal(18,2)", "decimal(38,18)"


def turned_dmy(text: Column) -> Column:
    """d/m/y text as y-m-d in one regex pass; text of another shape comes back trimmed."""
    return F.regexp_replace(F.trim(text), DMY, "$3-$2-$1")


def turned_date(text: Column, turned: Column, pivot: int) -> Column:
    """Date of a turned text. ``turned`` is read several times, so make it a column of its own first."""
    century = F.when(F.substring(turned, 1, 2) <= f"{pivot:02d}", "20").otherwise("19")
    dated = F.when(F.substring(turned, 3, 1) == "-", F.concat(century, turned)).otherwise(turned)
    return F.when(turned != F.trim(text), dated.try_cast("date"))


def parse_dmy(text: Column, pivot: int) -> Column:
    """d/m/yy or d/m/yyyy to a date. Two-digit years up to the pivot are 20yy, the others 19yy."""
    return turned_date(text, turned_dmy(text), pivot)


def parse_hhmmss(text: Column) -> Column:
    """HHMMSS without leading zeros to seconds of the day."""
    clean = F.trim(text)
    digits = F.lpad(clean, 6, "0")
    hour, minute, second = (F.substring(digits, at, 2).try_cast("int") for at in (1, 3, 5))
    valid = clean.rlike(HHMMSS) & (hour < 24) & (minute < 60) & (second < 60)
    return F.when(valid, hour * 3600 + minute * 60 + second)


def to_money(text: Column) -> Column:
    """Money as written, with up to 20 digits before the point and 18 after, so 0.004 is not zero. A longer one is NULL,
    but still a number to ``is_number``."""
    return F.when(is_number(text), F.trim(text).try_cast(RAW_MONEY))


def is_number(text: Column) -> Column:
    return F.coalesce(F.trim(text).rlike(NUMBER), F.lit(False))


def rounded_money(value: Column) -> Column:
    """Money as it is kept and summed; NULL where it does not fit ``MONEY``."""
    return value.try_cast(MONEY)


def norm_location(text: Column) -> Column:
    """Upper case, punctuation to blanks, blanks collapsed; nothing left gives NULL."""
    letters = F.regexp_replace(F.upper(text), "[^A-Z0-9 ]", " ")
    return F.nullif(F.trim(F.regexp_replace(letters, r"\s+", " ")), F.lit(""))


def valid_customer_id(text: Column) -> Column:
    return F.coalesce(text.rlike(CUSTOMER_ID), F.lit(False))


def id_number(text: Column) -> Column:
    """Digits after the one-letter prefix."""
    return F.substring(text, 2, 40).try_cast("bigint")
