"""Date, season and name columns of interferometric pairs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = "yyyyMMdd"


def day_text(date: Column) -> Column:
    return F.date_format(date, DAY)


def pair_name(primary: Column, secondary: Column, prefix: str | None = None) -> Column:
    """``[prefix_]yyyyMMdd_yyyyMMdd``."""
    parts = [day_text(primary), day_text(secondary)]
    return F.concat_ws("_", *([F.lit(prefix)] if prefix else []), *parts)


def path_name(path: Column) -> Column:
    """The name of an array of dates."""
    return F.array_join(F.transform(path, day_text), "_")


def names_to_dates(name: Column, length: int = 0, parse: Callable[[Column], Column] | None = None) -> Column:
    """The last ``length`` tokens of a name (0: all) as an array of dates; an error where there are fewer tokens.

    ``parse`` turns a token into a date; the default reads its first eight digits.
    """
    tokens = F.split(name, "_")
    if length:
        short = F.raise_error(F.concat(F.lit(f"fewer than {length} dates in "), name)).cast("array<string>")
        tokens = F.when(F.size(tokens) < length, short).otherwise(F.slice(tokens, -length, length))
    return F.transform(tokens, parse or (lambda t: F.to_date(F.substring(t, 1, 8), DAY)))


def season_of_month(month: Column) -> Column:
    """1 from March, 2 from June, 3 from September, 4 from December; an error for other numbers than 1 to 12."""
    season = (F.floor(F.pmod(month - 3, F.lit(12)) / 3) + 1).cast("int")
    return F.when(month.between(1, 12), season).otherwise(F.when(month.isNotNull(), F.raise_error(F.lit("a month is 1 to 12")).cast("int")))


def date_span(date: Column, first: Column, unit: str = "day") -> Column:
    """Days, or years of 365.25 days, since ``first``."""
    days = F.datediff(date, first)
    if unit not in ("day", "year"):
        raise ValueError("unit is day or year")
    return (days / 365.25) if unit == "year" else days.cast("double")


def in_month_days(date: Column, start: str, end: str) -> Column:
    """Whether a date lies from MMdd to MMdd of a year, both included; a range may cross the new year."""
    day = F.date_format(date, "MMdd")
    return ((day >= start) & (day <= end)) if start < end else ((day >= start) | (day <= end))


def season_year(date: Column, start: str, end: str) -> Column:
    """The year in which the date's season began; null outside the season."""
    year = F.year(date)
    own = year if start < end else F.when(F.date_format(date, "MMdd") >= start, year).otherwise(year - 1)
    return F.when(in_month_days(date, start, end), own)
