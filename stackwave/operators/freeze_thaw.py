"""Freeze-thaw cycles from daily temperatures, for any number of sites at once: tables of site, date, t.

Thaw and freeze seasons run from MMdd to MMdd of their year; a season may cross the new year, and one that isn't complete still counts, marked
as such.  Every operator works by windows within (site, year), so sites spread over the cluster.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import season_year
from .spatial import with_scenes


@dataclass(frozen=True)
class Seasons:
    """Bounds of the seasons, days that make a run, and the ratio of the thaw factor to the freeze factor."""

    thaw_start: str = "0401"
    thaw_end: str = "1101"
    freeze_start: str = "0901"
    freeze_end: str = "0501"
    day_duration: int = 5
    ratio: float = 1.0


def days_without_value(temperature: DataFrame) -> DataFrame:
    """(site, date) of days within a site's span that have no temperature."""
    span = temperature.groupBy("site").agg(F.min("date").alias("a"), F.max("date").alias("b"))
    days = span.select("site", F.explode(F.sequence("a", "b")).alias("date"))
    return days.join(temperature.filter("t is not null").select("site", "date"), ["site", "date"], "left_anti")


def require_daily(temperature: DataFrame) -> DataFrame:
    """The daily means; an error, when evaluated, for a day without a value."""
    daily = temperature.groupBy("site", F.to_date("date").alias("date")).agg(F.avg("t").alias("t"))
    after = F.lead("date").over(Window.partitionBy("site").orderBy("date"))
    gap = F.col("t").isNull() | F.coalesce(F.datediff(after, F.col("date")) > 1, F.lit(False))
    return daily.withColumn("t", F.when(gap, F.raise_error(F.concat(F.lit("no temperature on or after "), F.col("date").cast("string"))).cast("double")).otherwise(F.col("t")))


def _season_days(temperature: DataFrame, start: str, end: str) -> DataFrame:
    """Days with the year whose season they are in; only years that have days themselves begin a season."""
    years = temperature.select("site", F.year("date").alias("year")).distinct()
    return temperature.withColumn("year", season_year(F.col("date"), start, end)).join(years, ["site", "year"], "left_semi")


def degree_days(temperature: DataFrame, seasons: Seasons, kind: str) -> DataFrame:
    """(site, year, date, t, dd): running sum of the season's degree days, of t (thaw) or -t (freeze).

    On days of the other sign dd is null and the sum carries on.
    """
    thaw = kind == "thaw"
    rows = _season_days(temperature, *((seasons.thaw_start, seasons.thaw_end) if thaw else (seasons.freeze_start, seasons.freeze_end)))
    v = F.col("t") if thaw else -F.col("t")
    running = F.sum(F.greatest(v, F.lit(0.0))).over(Window.partitionBy("site", "year").orderBy("date").rowsBetween(Window.unboundedPreceding, 0))
    return rows.select("site", "year", "date", "t", F.when(v >= 0, running).alias("dd"))


def _complete(start: str, end: str) -> Column:
    last = F.col("year") + (0 if start < end else 1)
    a = F.make_date(F.col("year"), F.lit(int(start[:2])), F.lit(int(start[2:])))
    b = F.make_date(last, F.lit(int(end[:2])), F.lit(int(end[2:])))
    return (F.min("date") == a) & (F.max("date") == b)


def thaw_freeze_index(temperature: DataFrame, seasons: Seasons, strict: bool = False) -> DataFrame:
    """(site, year, ti, fi): the largest degree days of the season; with ``strict`` null where the season isn't complete."""
    out = []
    for kind, name, start, end in (("thaw", "ti", seasons.thaw_start, seasons.thaw_end), ("freeze", "fi", seasons.freeze_start, seasons.freeze_end)):
        rows = degree_days(temperature, seasons, kind).groupBy("site", "year").agg(F.max("dd").alias(name), _complete(start, end).alias("_done"))
        out.append(rows.select("site", "year", F.when(F.col("_done"), F.col(name)).alias(name) if strict else name))
    return out[0].join(out[1], ["site", "year"], "full")


def mean_index(temperature: DataFrame, seasons: Seasons) -> DataFrame:
    """(site, ti, fi): means over the years."""
    return thaw_freeze_index(temperature, seasons).groupBy("site").agg(F.avg("ti").alias("ti"), F.avg("fi").alias("fi"))


def onset(temperature: DataFrame, seasons: Seasons, kind: str) -> DataFrame:
    """(site, year, onset): first day of a run of ``day_duration`` days of the season with t > 0 (thaw) or t < 0 (freeze); null without one."""
    thaw, n = kind == "thaw", seasons.day_duration
    rows = _season_days(temperature, *((seasons.thaw_start, seasons.thaw_end) if thaw else (seasons.freeze_start, seasons.freeze_end)))
    ahead = Window.partitionBy("site", "year").orderBy("date").rowsBetween(0, n - 1)
    run = F.sum((F.col("t") > 0 if thaw else F.col("t") < 0).cast("int")).over(ahead) == n
    return rows.withColumn("_run", run).groupBy("site", "year").agg(F.min(F.when(F.col("_run"), F.col("date"))).alias("onset"))


def stable_winter(temperature: DataFrame, seasons: Seasons, ratio: float | None = None) -> DataFrame:
    """(site, year, t3): first day of the freeze season on which ratio * sqrt(DDF) reaches sqrt(TI).

    Null without a thaw index, and where ratio * TI is over FI; a missing FI is the site's mean, or else the season's largest sum.
    """
    er = seasons.ratio if ratio is None else ratio
    index = thaw_freeze_index(temperature, seasons).withColumn("fi", F.coalesce("fi", F.avg("fi").over(Window.partitionBy("site"))))
    frozen = degree_days(temperature, seasons, "freeze").withColumn("_top", F.max("dd").over(Window.partitionBy("site", "year")))
    rows = index.join(frozen.select("site", "year", "date", "dd", "_top"), ["site", "year"], "left").withColumn("fi", F.coalesce("fi", "_top"))
    fits = (er * F.col("ti") <= F.col("fi")) & (F.sqrt("ti") <= er * F.sqrt("dd"))
    first = F.min(F.when(fits, F.struct("dd", "date")))
    return rows.groupBy("site", "year").agg(first["date"].alias("t3"))


def cycles(temperature: DataFrame, seasons: Seasons) -> DataFrame:
    """(site, year, ti, fi, t1, t2, t3): all of a year's indices."""
    t1 = onset(temperature, seasons, "thaw").withColumnRenamed("onset", "t1")
    t2 = onset(temperature, seasons, "freeze").withColumnRenamed("onset", "t2")
    return thaw_freeze_index(temperature, seasons).join(t1, ["site", "year"], "full").join(t2, ["site", "year"], "full").join(stable_winter(temperature, seasons), ["site", "year"], "full")


def year_spans(temperature: DataFrame, seasons: Seasons) -> DataFrame:
    """(site, year, start, end): from the onset of thaw to the next year's, or to the site's last day; only years with an onset."""
    t1 = onset(temperature, seasons, "thaw").filter("onset is not null")
    after = t1.select("site", (F.col("year") - 1).alias("year"), F.col("onset").alias("_next"))
    last = temperature.groupBy("site").agg(F.max("date").alias("_last"))
    return t1.join(after, ["site", "year"], "left").join(last, "site").select("site", "year", F.col("onset").alias("start"), F.coalesce("_next", "_last").alias("end"))


def years_available(temperature: DataFrame, acquisitions: DataFrame) -> DataFrame:
    """Years that both the temperatures and the acquisition dates have."""
    return temperature.select(F.year("date").alias("year")).intersect(acquisitions.select(F.year("date").alias("year")))


def dates_available(temperature: DataFrame, acquisitions: DataFrame) -> DataFrame:
    """Acquisition dates inside the temperatures' span."""
    span = temperature.agg(F.min("date").alias("_a"), F.max("date").alias("_b"))
    return acquisitions.join(F.broadcast(span), F.col("date").between(F.col("_a"), F.col("_b"))).select("date")


def model_block(temperature: DataFrame, acquisitions: DataFrame, seasons: Seasons, velocity: bool = False) -> DataFrame:
    """(site, date, e_t, e_f[, v], constant): design columns of the freeze-thaw model at acquisition dates.

    Within a year's span, from its thaw onset, e_t is the square root of the thaw and e_f that of the freeze degree days, filled forward, the latter 0
    until 1 July; both stay as they are from the stable winter on.  Without ``velocity`` the values at the ends of earlier years add up;
    with it, v is the number of earlier years.  Dates of the first year before its onset get 0.
    """
    spans = year_spans(temperature, seasons).join(stable_winter(temperature, seasons), ["site", "year"], "left")
    days = temperature.select("site", "date").distinct().join(spans, "site").filter(F.col("date").between(F.col("start"), F.col("end")))
    for kind, name in (("thaw", "ddt"), ("freeze", "ddf")):
        sums = degree_days(temperature, seasons, kind).groupBy("site", "date").agg(F.max_by("dd", "year").alias(name))
        days = days.join(sums, ["site", "date"], "left")
    by_day = Window.partitionBy("site", "year").orderBy("date")
    so_far = by_day.rowsBetween(Window.unboundedPreceding, 0)
    july = F.make_date(F.col("year"), F.lit(7), F.lit(1))
    days = days.withColumn("ddt", F.when((F.col("date") == F.col("start")) & F.col("ddt").isNull(), 0.0).otherwise(F.col("ddt")))
    days = days.withColumn("ddf", F.when(F.col("date") <= july, 0.0).otherwise(F.col("ddf")))
    for name in ("ddt", "ddf"):
        days = days.withColumn(name, F.last(name, ignorenulls=True).over(so_far))
        whole = by_day.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        held = F.max(F.when(F.col("date") == F.col("t3"), F.col(name))).over(whole)
        days = days.withColumn(name, F.when(F.col("date") >= F.col("t3"), F.coalesce(held, F.col(name))).otherwise(F.col(name)))
    days = days.select("site", "year", "date", "start", F.sqrt("ddt").alias("e_t"), F.sqrt("ddf").alias("e_f"))
    ends = days.groupBy("site", "year").agg(F.max_by("e_t", "date").alias("_t"), F.max_by("e_f", "date").alias("_f"))
    earlier = Window.partitionBy("site").orderBy("year").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("site", "year", F.coalesce(F.sum("_t").over(earlier), F.lit(0.0)).alias("_bt"), F.coalesce(F.sum("_f").over(earlier), F.lit(0.0)).alias("_bf"), (F.row_number().over(Window.partitionBy("site").orderBy("year")) - 1).cast("double").alias("v"))
    rows = days.join(ends, ["site", "year"])
    # a date that ends one year and begins the next belongs to the later one
    rows = rows.withColumn("_k", F.row_number().over(Window.partitionBy("site", "date").orderBy(F.desc("year")))).filter("_k = 1")
    if not velocity:
        rows = rows.withColumns({"e_t": F.col("e_t") + F.col("_bt"), "e_f": F.col("e_f") + F.col("_bf")})
    names = ["e_t", "e_f", *(["v"] if velocity else [])]
    rows = rows.select("site", "date", *names)
    begin = year_spans(temperature, seasons).groupBy("site").agg(F.min("start").alias("_begin"), F.min("year").alias("_year"))
    first_year = acquisitions.agg(F.min(F.year("date"))).first()[0]
    wanted = with_scenes(begin, acquisitions.select("date"))  # sites by dates, as the result has them
    early = (F.col("date") < F.col("_begin")) & (F.col("_year") == F.lit(first_year))
    rows = wanted.join(rows, ["site", "date"], "left")
    return rows.select("site", "date", *(F.when(early, 0.0).otherwise(F.col(n)).alias(n) for n in names), F.lit(1.0).alias("constant"))
