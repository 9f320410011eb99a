"""Networks of pairs from acquisition dates (a table with a ``date`` column)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import season_year
from .pairs import pairs


def dates(df: DataFrame, date: str = "date") -> DataFrame:
    """Distinct acquisition dates, with rank from 0."""
    return df.select(F.to_date(date).alias("date")).filter("date is not null").distinct().withColumn("rank", F.row_number().over(Window.orderBy("date")) - 1)


def from_interval(df: DataFrame, max_interval: int = 2, max_day: int = 180) -> DataFrame:
    """Each date with the next ``max_interval`` ones while the gap is under ``max_day`` days.

    Gaps grow with the distance in the order, so the rule needs no stop: a later date is no nearer.
    """
    order = Window.orderBy("date")
    later = F.array(*(F.lead("date", k).over(order) for k in range(1, max_interval + 1)))
    rows = dates(df).select(F.col("date").alias("primary"), later.alias("later")).select("primary", F.explode("later").alias("secondary"))
    return pairs(rows.filter(F.datediff("secondary", "primary") < max_day))


def _seasons(df: DataFrame, start: str, end: str, most: int | None, seed: int) -> DataFrame:
    """(date, season year, place of the season among those that have dates); at most ``most`` dates a season, drawn by a hash."""
    rows = dates(df).select("date", season_year(F.col("date"), start, end).alias("season")).filter("season is not null")
    # a season belongs to a year that has acquisitions, as the years are listed from the dates
    years = dates(df).select(F.year("date").alias("season")).distinct()
    rows = rows.join(years, "season", "left_semi")
    if most is not None:
        drawn = F.row_number().over(Window.partitionBy("season").orderBy(F.xxhash64("date", F.lit(seed)), "date"))
        rows = rows.withColumn("_k", drawn).filter(F.col("_k") <= most).drop("_k")
    return rows.withColumn("place", F.dense_rank().over(Window.orderBy("season")) - 1)


def linking_winter(df: DataFrame, winter_start: str = "0101", winter_end: str = "0331", per_winter: int | None = 5, max_winter_interval: int = 1, seed: int = 0) -> DataFrame:
    """Every chosen date of a winter with every chosen date of the next ``max_winter_interval`` winters that have dates."""
    rows = _seasons(df, winter_start, winter_end, per_winter, seed)
    first = rows.select(F.col("date").alias("primary"), F.explode(F.sequence(F.col("place") + 1, F.col("place") + max_winter_interval)).alias("place"))
    return pairs(first.join(rows.select("place", F.col("date").alias("secondary")), "place"))


def from_period(df: DataFrame, start: str = "0101", end: str = "0331", per_period: int | None = None, primary_periods: int | None = None, primary_years: Sequence[int] | None = None, seed: int = 0) -> DataFrame:
    """Every chosen date of a primary period with every chosen date of all later periods.

    Primary are the first ``primary_periods`` periods and those that begin in ``primary_years``; all, where neither is given.
    """
    rows = _seasons(df, start, end, per_period, seed)
    first = rows
    if primary_periods is not None:
        first = first.filter(F.col("place") < primary_periods)
    if primary_years is not None:
        first = first.filter(F.col("season").isin(list(primary_years)))
    a = first.select(F.col("place").alias("_a"), F.col("date").alias("primary"))
    b = rows.select(F.col("place").alias("_b"), F.col("date").alias("secondary"))
    return pairs(a.join(b, F.col("_b") > F.col("_a")))


def from_summer_winter(df: DataFrame, summer_start: str = "0801", summer_end: str = "1001", winter_start: str = "1201", winter_end: str = "0331") -> DataFrame:
    """For each year: the winter before with the summer (thaw), and the summer with the winter after (freeze)."""
    rows = dates(df).select("date")
    after = winter_start > summer_end
    # the winter after the summer of a year begins in that year, or in the next where winters begin before summers
    begins = 0 if after else 1
    crosses = 1 if after and winter_end <= summer_end else 0

    def day(year: F.Column, text: str) -> F.Column:
        return F.make_date(year, F.lit(int(text[:2])), F.lit(int(text[2:])))

    year = F.col("year")
    spans = rows.select(F.year("date").alias("year")).distinct().select(
        "year",
        day(year, summer_start).alias("s0"), day(year, summer_end).alias("s1"),
        day(year + begins - 1, winter_start).alias("a0"), day(year + begins - 1 + crosses, winter_end).alias("a1"),
        day(year + begins, winter_start).alias("b0"), day(year + begins + crosses, winter_end).alias("b1"),
    )

    def within(low: str, high: str, name: str) -> DataFrame:
        return rows.join(spans, F.col("date").between(F.col(low), F.col(high))).select("year", F.col("date").alias(name))

    summer = within("s0", "s1", "summer")
    thaw = within("a0", "a1", "winter").join(summer, "year").select(F.col("winter").alias("primary"), F.col("summer").alias("secondary"))
    freeze = summer.join(within("b0", "b1", "winter"), "year").select(F.col("summer").alias("primary"), F.col("winter").alias("secondary"))
    return pairs(thaw.union(freeze))
