"""Lenient dates: parse, generalise, shift."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .keyed import shift_days

MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def _checked(text: Column, pattern: str) -> Column:
    """A date with a year of 1900 to 2100, else null."""
    d = F.try_to_date(text, pattern)
    return F.when(F.year(d).between(1900, 2100), d)


def parse_compact(value: Column) -> Column:
    """Eight digits, perhaps with a time: year-month-day, then day-month-year, then month-day-year."""
    digits = F.regexp_extract(value, r"^([0-9]{8})(?:[ T][0-9]{6})?$", 1)
    found = F.coalesce(*[_checked(digits, p) for p in ("yyyyMMdd", "ddMMyyyy", "MMddyyyy")])
    return F.when(digits != "", found)


def _numeric(value: Column, pattern: str, order: str) -> Column:
    """A date from three number groups; what follows them is ignored."""
    parts = {c: F.regexp_extract(value, pattern, k + 1) for k, c in enumerate(order)}
    text = F.concat_ws("-", F.lpad(parts["y"], 4, "0"), F.lpad(parts["m"], 2, "0"), F.lpad(parts["d"], 2, "0"))
    return F.when(parts["y"] != "", _checked(text, "yyyy-MM-dd"))


def _named(value: Column, pattern: str, order: str, full: bool) -> Column:
    parts = {c: F.regexp_extract(value, pattern, k + 1) for k, c in enumerate(order)}
    names = F.array(*[F.lit(m if full else m[:3]) for m in MONTHS])
    month = F.array_position(names, F.lower(parts["m"])).cast("string")
    text = F.concat_ws("-", F.lpad(parts["y"], 4, "0"), F.lpad(month, 2, "0"), F.lpad(parts["d"], 2, "0"))
    return F.when((parts["y"] != "") & (month != "0"), _checked(text, "yyyy-MM-dd"))


def parse_date(value: Column) -> Column:
    """Compact dates, ISO, y/m/d, day before month before month before day, d-m-y, and English month names."""
    v = F.trim(value)
    full = "|".join(MONTHS)
    short = "|".join(m[:3] for m in MONTHS)
    return F.coalesce(
        parse_compact(v),
        _numeric(v, r"^([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})", "ymd"),
        _numeric(v, r"^([0-9]{4})/([0-9]{1,2})/([0-9]{1,2})", "ymd"),
        _numeric(v, r"^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})", "dmy"),
        _numeric(v, r"^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})", "mdy"),
        _numeric(v, r"^([0-9]{1,2})-([0-9]{1,2})-([0-9]{4})", "dmy"),
        _named(v, rf"(?i)^([0-9]{{1,2}})[ -]({full})[ -]([0-9]{{4}})", "dmy", True),
        _named(v, rf"(?i)^([0-9]{{1,2}})[ -]({short})[ -]([0-9]{{4}})", "dmy", False),
        _named(v, rf"(?i)^({full}) ([0-9]{{1,2}}), ([0-9]{{4}})", "mdy", True),
        _named(v, rf"(?i)^({short}) ([0-9]{{1,2}}), ([0-9]{{4}})", "mdy", False),
    )


def generalize_date(value: Column, method: str = "year") -> Column:
    """Year or year-month; ``[DATE]`` for what is no date, blanks too; null for null."""
    text = F.date_format(parse_date(value), "yyyy-MM" if method == "year_month" else "yyyy")
    return F.when(value.isNotNull(), F.coalesce(text, F.lit("[DATE]")))


def shift_date(value: Column, key: bytes | str, salt: str = "", subject: Column | None = None, window: int = 365) -> Column:
    """ISO date moved by the subject's days; ``[DATE]`` for what is no date; null for null or empty."""
    moved = F.date_format(F.date_add(parse_date(value), shift_days(subject, key, salt, window)), "yyyy-MM-dd")
    return F.when(value.isNotNull() & (value != ""), F.coalesce(moved, F.lit("[DATE]")))


def year_of(value: Column) -> Column:
    """First year of 1800 to 2099 in a text, else ``[DATE]``."""
    found = F.regexp_extract(value, r"((?:18|19|20)[0-9]{2})", 1)
    return F.when(value.isNotNull(), F.when(found != "", found).otherwise("[DATE]"))
