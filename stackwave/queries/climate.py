"""Queries on freeze-thaw cycles."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters as A
from ..operators import freeze_thaw as T
from .registry import query

_S = T.Seasons()
_THAW = "SELECT site, year(d) AS y, d, t, CASE WHEN t >= 0 THEN sum(greatest(t, 0)) OVER (PARTITION BY site, year(d) ORDER BY d) END AS dd FROM temp WHERE strftime(d, '%m%d') BETWEEN '0401' AND '1101'"
_FREEZE = "SELECT site, y, d, t, CASE WHEN t <= 0 THEN sum(greatest(-t, 0)) OVER (PARTITION BY site, y ORDER BY d) END AS dd FROM (SELECT *, CASE WHEN strftime(d, '%m%d') >= '0901' THEN year(d) ELSE year(d) - 1 END AS y FROM temp WHERE strftime(d, '%m%d') >= '0901' OR strftime(d, '%m%d') <= '0501') WHERE y >= 1995"
_INDEX = "SELECT site, y, ti, fi FROM (SELECT site, y, max(dd) AS ti FROM thaw GROUP BY ALL) FULL JOIN (SELECT site, y, max(dd) AS fi FROM frost GROUP BY ALL) USING (site, y)"
_ONSET = "SELECT site, y, min(d) FILTER (run = 5) AS onset FROM (SELECT *, sum(CASE WHEN {} THEN 1 ELSE 0 END) OVER (PARTITION BY site, y ORDER BY d ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS run FROM {}) GROUP BY site, y"
_T1, _T2 = _ONSET.format("t > 0", "thaw"), _ONSET.format("t < 0", "frost")
_T3 = "SELECT site, y, min_by(d, dd) FILTER (fits) AS t3 FROM (SELECT i.site, i.y, f.d, f.dd, i.ti <= i.fi AND sqrt(i.ti) <= sqrt(f.dd) AS fits FROM idx i LEFT JOIN frost f ON f.site = i.site AND f.y = i.y) GROUP BY site, y"
_SPANS = "SELECT a.site, a.y, a.onset AS a0, coalesce(b.onset, DATE '1999-12-31') AS a1 FROM one a LEFT JOIN one b ON b.site = a.site AND b.y = a.y + 1 WHERE a.onset IS NOT NULL"
_VIEWS = {"thaw": _THAW, "frost": _FREEZE, "idx": _INDEX, "one": _T1, "two": _T2, "three": _T3, "spans": _SPANS}


def _t(spark, sf):
    return A.temperatures(spark, sf)


def _years(df, *columns):
    return df.withColumnsRenamed({"year": "y", "date": "d"}).select("site", F.col("y").cast("long").alias("y"), *columns)


@query("SELECT site, CAST(y AS BIGINT) AS y, d, dd FROM thaw", **_VIEWS)
def thaw_degree_days(spark, sf):
    return _years(T.degree_days(_t(spark, sf), _S, "thaw"), "d", "dd")


@query("SELECT site, CAST(y AS BIGINT) AS y, d, dd FROM frost", **_VIEWS)
def freeze_degree_days(spark, sf):
    return _years(T.degree_days(_t(spark, sf), _S, "freeze"), "d", F.abs("dd").alias("dd"))


@query("SELECT site, CAST(y AS BIGINT) AS y, ti, fi FROM idx", **_VIEWS)
def thaw_freeze_index(spark, sf):
    return _years(T.thaw_freeze_index(_t(spark, sf), _S), "ti", "fi")


@query("SELECT site, CAST(y AS BIGINT) AS y, ti, CASE WHEN y < 1999 THEN fi END AS fi FROM idx", **_VIEWS)
def thaw_freeze_index_strict(spark, sf):
    return _years(T.thaw_freeze_index(_t(spark, sf), _S, strict=True), "ti", "fi")


@query("SELECT site, round(avg(ti), 6) + 0.0 AS ti, round(avg(fi), 6) + 0.0 AS fi FROM idx GROUP BY site", **_VIEWS)
def mean_thaw_freeze_index(spark, sf):
    return T.mean_index(_t(spark, sf), _S).select("site", (F.round("ti", 6) + 0.0).alias("ti"), (F.round("fi", 6) + 0.0).alias("fi"))


@query("SELECT site, CAST(y AS BIGINT) AS y, onset FROM one", **_VIEWS)
def thaw_onset(spark, sf):
    return _years(T.onset(_t(spark, sf), _S, "thaw"), "onset")


@query("SELECT site, CAST(y AS BIGINT) AS y, onset FROM two", **_VIEWS)
def freeze_onset(spark, sf):
    return _years(T.onset(_t(spark, sf), _S, "freeze"), "onset")


@query("SELECT site, CAST(y AS BIGINT) AS y, t3 FROM three", **_VIEWS)
def stable_winter(spark, sf):
    return _years(T.stable_winter(_t(spark, sf), _S), "t3")


@query("SELECT site, CAST(y AS BIGINT) AS y, ti, fi, one.onset AS t1, two.onset AS t2, t3 FROM idx LEFT JOIN one USING (site, y) LEFT JOIN two USING (site, y) LEFT JOIN three USING (site, y)", **_VIEWS)
def freeze_thaw_cycles(spark, sf):
    return _years(T.cycles(_t(spark, sf), _S), "ti", "fi", "t1", "t2", "t3")


@query("SELECT site, CAST(y AS BIGINT) AS y, a0, a1 FROM spans", **_VIEWS)
def freeze_thaw_years(spark, sf):
    return _years(T.year_spans(_t(spark, sf), _S).withColumnsRenamed({"start": "a0", "end": "a1"}), "a0", "a1")


@query("SELECT site, d FROM temp WHERE dayofyear(d) % 50 = 0 AND d > DATE '1995-01-01'")
def days_without_value(spark, sf):
    return T.days_without_value(_t(spark, sf).filter(F.dayofyear("date") % 50 != 0)).select("site", F.col("date").alias("d"))


@query("SELECT DISTINCT CAST(year(d) AS BIGINT) AS y FROM temp WHERE year(d) IN (SELECT year(d) FROM oacq)")
def years_available(spark, sf):
    return T.years_available(_t(spark, sf), A.order_days(spark, sf)).select(F.col("year").cast("long").alias("y"))


@query("SELECT d FROM oacq WHERE d BETWEEN DATE '1995-01-01' AND DATE '1999-12-31'")
def dates_available(spark, sf):
    return T.dates_available(_t(spark, sf), A.order_days(spark, sf)).select(F.col("date").alias("d"))


_DAYS = (
    "SELECT s.site, s.y, t.d, s.a0, w.t3, CASE WHEN t.d = s.a0 THEN coalesce(a.dd, 0) ELSE a.dd END AS x, CASE WHEN t.d <= make_date(CAST(s.y AS BIGINT), 7, 1) THEN 0 ELSE f.dd END AS z "
    "FROM spans s JOIN temp t ON t.site = s.site AND t.d BETWEEN s.a0 AND s.a1 LEFT JOIN three w ON w.site = s.site AND w.y = s.y LEFT JOIN thaw a ON a.site = s.site AND a.d = t.d LEFT JOIN frost f ON f.site = s.site AND f.d = t.d"
)
_FILLED = "SELECT site, y, d, a0, t3, last_value(x IGNORE NULLS) OVER w AS x, last_value(z IGNORE NULLS) OVER w AS z FROM days WINDOW w AS (PARTITION BY site, y ORDER BY d)"
_HELD = "SELECT site, y, d, a0, sqrt(CASE WHEN d >= t3 THEN coalesce(max(x) FILTER (d = t3) OVER w, x) ELSE x END) AS x, sqrt(CASE WHEN d >= t3 THEN coalesce(max(z) FILTER (d = t3) OVER w, z) ELSE z END) AS z FROM filled WINDOW w AS (PARTITION BY site, y)"
_ENDS = "SELECT site, y, coalesce(sum(x) OVER w, 0) AS bx, coalesce(sum(z) OVER w, 0) AS bz, row_number() OVER (PARTITION BY site ORDER BY y) - 1 AS v FROM (SELECT site, y, max_by(x, d) AS x, max_by(z, d) AS z FROM held GROUP BY ALL) WINDOW w AS (PARTITION BY site ORDER BY y ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_LATE = "SELECT * FROM held JOIN ends USING (site, y) QUALIFY row_number() OVER (PARTITION BY site, d ORDER BY y DESC) = 1"
_BLOCK = "SELECT q.site, o.d, {} CAST(1 AS DOUBLE) AS constant FROM oacq o CROSS JOIN (SELECT site, min(a0) AS b, min(y) AS y FROM spans GROUP BY site) q LEFT JOIN late l ON l.site = q.site AND l.d = o.d"
_EARLY = "CASE WHEN o.d < q.b AND q.y = (SELECT min(year(d)) FROM oacq) THEN 0 ELSE {} END"
_MODEL = _VIEWS | {"days": _DAYS, "filled": _FILLED, "held": _HELD, "ends": _ENDS, "late": _LATE}


@query(_BLOCK.format(f"round({_EARLY.format('x + bx')}, 6) + 0.0 AS e_t, round({_EARLY.format('z + bz')}, 6) + 0.0 AS e_f,"), **_MODEL)
def freeze_thaw_block(spark, sf):
    b = T.model_block(_t(spark, sf), A.order_days(spark, sf), _S)
    return b.select("site", F.col("date").alias("d"), (F.round("e_t", 6) + 0.0).alias("e_t"), (F.round("e_f", 6) + 0.0).alias("e_f"), "constant")


@query(_BLOCK.format(f"round({_EARLY.format('x')}, 6) + 0.0 AS e_t, round({_EARLY.format('z')}, 6) + 0.0 AS e_f, CAST({_EARLY.format('v')} AS DOUBLE) AS v,"), **_MODEL)
def freeze_thaw_velocity_block(spark, sf):
    b = T.model_block(_t(spark, sf), A.order_days(spark, sf), _S, velocity=True)
    return b.select("site", F.col("date").alias("d"), (F.round("e_t", 6) + 0.0).alias("e_t"), (F.round("e_f", 6) + 0.0).alias("e_f"), "v", "constant")
