"""Queries on pairs, networks and loops."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import adapters as A
from ..functions import dates as D
from ..operators import loops as L
from ..operators import network as N
from ..operators import pairs as P
from ..plans import inversion as I
from .registry import query

_RENAME = {"primary": "p", "secondary": "s", "date": "d"}


def _out(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumnsRenamed(_RENAME).select(*columns)


def _near(spark: SparkSession, sf: str) -> DataFrame:
    return A.event_network(spark, sf, 2)


@query("SELECT pair_id, p, s, CAST(days AS INTEGER) AS days FROM onet")
def pairs_from_interval(spark, sf):
    return _out(A.order_network(spark, sf), "pair_id", "p", "s", "days")


@query("SELECT pair_id FROM (SELECT *, row_number() OVER (ORDER BY p, s) - 1 AS k FROM net) WHERE k >= 5 AND k < 60 AND (k - 5) % 3 = 0")
def pairs_positions(spark, sf):
    return P.at_positions(A.event_network(spark, sf), 5, 60, 3).select("pair_id")


@query("SELECT pair_id, CAST(days AS INTEGER) AS days FROM onet WHERE p >= DATE '1996-03-01' AND s <= DATE '1997-01-01'")
def pairs_date_slice(spark, sf):
    return P.between(A.order_network(spark, sf), "1996-03", "1997").select("pair_id", "days")


@query("SELECT pair_id FROM net WHERE p = DATE '2024-01-10' OR s = DATE '2024-01-10'")
def pairs_touching_date(spark, sf):
    return P.touching(A.event_network(spark, sf), "2024-01-10").select("pair_id")


@query("SELECT pair_id FROM (SELECT *, row_number() OVER (ORDER BY p, s) - 1 AS k FROM net) WHERE k IN (0, 3, 7, 20)")
def pairs_at_indices(spark, sf):
    return P.at_indices(A.event_network(spark, sf), [7, 3, 0, 20, 3]).select("pair_id")


@query("SELECT pair_id, pair_id IN (SELECT pair_id FROM near) AS member FROM net")
def pairs_member_mask(spark, sf):
    return P.member_mask(A.event_network(spark, sf), _near(spark, sf)).select("pair_id", "member")


@query("SELECT pair_id, CAST(k AS INTEGER) AS idx FROM (SELECT *, row_number() OVER (ORDER BY p, s) - 1 AS k FROM net) WHERE pair_id IN (SELECT pair_id FROM near)")
def pairs_where(spark, sf):
    return P.where(A.event_network(spark, sf), _near(spark, sf))


@query("SELECT pair_id FROM net WHERE i < 12 UNION SELECT pair_id FROM near")
def pairs_union(spark, sf):
    some = P.edge_index(A.event_network(spark, sf)).filter("i < 12").drop("i", "j")
    return P.union(some, _near(spark, sf)).select("pair_id")


@query("SELECT pair_id FROM net WHERE i < 12 INTERSECT SELECT pair_id FROM near")
def pairs_intersect(spark, sf):
    some = P.edge_index(A.event_network(spark, sf)).filter("i < 12")
    return P.intersect(some, _near(spark, sf)).select("pair_id")


@query("SELECT pair_id FROM net EXCEPT SELECT pair_id FROM near")
def pairs_difference(spark, sf):
    return P.difference(A.event_network(spark, sf), _near(spark, sf)).select("pair_id")


@query("SELECT (SELECT count(*) FROM (SELECT pair_id FROM net EXCEPT SELECT pair_id FROM near)) = 0 AS equal")
def pairs_equal(spark, sf):
    return P.equal(A.event_network(spark, sf), _near(spark, sf))


@query("SELECT pair_id, strftime(p, '%Y%m%d') AS primary_text, strftime(s, '%Y%m%d') AS secondary_text, CAST(days AS INTEGER) AS days, 'ifg_' || pair_id AS named FROM net")
def pairs_attributes(spark, sf):
    net = A.event_network(spark, sf)
    return net.select("pair_id", D.day_text(F.col("primary")).alias("primary_text"), D.day_text(F.col("secondary")).alias("secondary_text"), "days", D.pair_name(F.col("primary"), F.col("secondary"), "ifg").alias("named"))


@query("SELECT d, CAST(row_number() OVER (ORDER BY d) - 1 AS INTEGER) AS idx FROM (SELECT p AS d FROM onet UNION SELECT s FROM onet)")
def pairs_acquisitions(spark, sf):
    return _out(P.acquisitions(A.order_network(spark, sf)), "d", "idx")


@query("SELECT pair_id, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j FROM net")
def pairs_edge_index(spark, sf):
    return P.edge_index(A.event_network(spark, sf)).select("pair_id", "i", "j")


@query("SELECT pair_id FROM onet WHERE month(p) IN (8, 9) AND month(s) IN (8, 9)")
def pairs_calendar_filter(spark, sf):
    return A.order_network(spark, sf).filter(F.month("primary").isin(8, 9) & F.month("secondary").isin(8, 9)).select("pair_id")


@query("SELECT pair_id, CAST(row_number() OVER (ORDER BY days DESC, p DESC, s DESC) - 1 AS INTEGER) AS rank FROM net")
def pairs_sorted(spark, sf):
    return P.sort(A.event_network(spark, sf), "days", ascending=False).select("pair_id", "rank")


@query("SELECT d FROM (SELECT p AS d FROM onet UNION SELECT s FROM onet) WHERE d <> (SELECT min(p) FROM onet) AND d NOT IN (SELECT s FROM kept)", kept="SELECT * FROM onet WHERE month(s) <> 6")
def pairs_gaps(spark, sf):
    net = A.order_network(spark, sf)
    return _out(P.gaps(net, net.filter(F.month("secondary") == 6)), "d")


@query("SELECT pair_id, CAST(days AS INTEGER) AS days FROM net WHERE i % 2 = 0")
def pairs_from_names(spark, sf):
    rows = P.edge_index(A.event_network(spark, sf)).filter("i % 2 = 0")
    names = rows.select(F.concat(F.lit("S1_"), D.day_text(F.col("secondary")), F.lit("_"), D.day_text(F.col("primary"))).alias("name"))
    return P.from_names(names).select("pair_id", "days")


@query("SELECT 'S1_' || pair_id AS name, p AS first, s AS last FROM net")
def names_to_dates(spark, sf):
    names = A.event_network(spark, sf).select(F.concat(F.lit("S1_"), "pair_id").alias("name"))
    d = D.names_to_dates(F.col("name"), 2)
    return names.select("name", d[0].alias("first"), d[1].alias("last"))


@query("SELECT pair_id FROM onet WHERE p >= DATE '1997-02-01' AND s <= DATE '1998-06-30'")
def names_between(spark, sf):
    return P.named_between(A.order_network(spark, sf), "19970201", "19980630", "pair_id").select("pair_id")


@query("SELECT d, CAST((month(d) - 3 + 12) % 12 // 3 + 1 AS INTEGER) AS season FROM oacq")
def season_of_month(spark, sf):
    return A.order_days(spark, sf).select(F.col("date").alias("d"), D.season_of_month(F.month("date")).alias("season"))


@query("SELECT d, CAST(d - (SELECT min(d) FROM oacq) AS DOUBLE) AS days, round(CAST(d - (SELECT min(d) FROM oacq) AS DOUBLE) / 365.25, 9) AS years FROM oacq")
def date_spans(spark, sf):
    days = A.order_days(spark, sf)
    first = days.agg(F.min("date").alias("first"))
    d, f = F.col("date"), F.col("first")
    return days.join(F.broadcast(first)).select(d.alias("d"), D.date_span(d, f).alias("days"), F.round(D.date_span(d, f, "year"), 9).alias("years"))


_NAME = "strftime({a}.d, '%Y%m%d') || '_' || strftime({b}.d, '%Y%m%d')"


@query(f"SELECT {_NAME.format(a='a', b='b')} AS pair_id FROM w a JOIN w b ON b.k BETWEEN a.k + 1 AND a.k + 2", w="SELECT d, dense_rank() OVER (ORDER BY year(d)) - 1 AS k FROM oacq WHERE strftime(d, '%m%d') BETWEEN '0101' AND '0331'")
def pairs_linking_winter(spark, sf):
    return N.linking_winter(A.order_days(spark, sf), per_winter=None, max_winter_interval=2).select("pair_id")


@query(f"SELECT {_NAME.format(a='a', b='b')} AS pair_id FROM w a JOIN w b ON b.k > a.k WHERE a.k < 2", w="SELECT d, dense_rank() OVER (ORDER BY y) - 1 AS k FROM (SELECT d, CASE WHEN strftime(d, '%m%d') >= '1201' THEN year(d) ELSE year(d) - 1 END AS y FROM oacq WHERE strftime(d, '%m%d') >= '1201' OR strftime(d, '%m%d') <= '0215') WHERE y IN (SELECT year(d) FROM oacq)")
def pairs_from_period(spark, sf):
    return N.from_period(A.order_days(spark, sf), "1201", "0215", primary_periods=2).select("pair_id")


@query(
    f"SELECT {_NAME.format(a='w', b='v')} AS pair_id FROM y JOIN oacq w ON w.d BETWEEN make_date(y - 1, 12, 1) AND make_date(y, 3, 31) JOIN oacq v ON v.d BETWEEN make_date(y, 8, 1) AND make_date(y, 10, 1)"
    f" UNION SELECT {_NAME.format(a='v', b='w')} FROM y JOIN oacq v ON v.d BETWEEN make_date(y, 8, 1) AND make_date(y, 10, 1) JOIN oacq w ON w.d BETWEEN make_date(y, 12, 1) AND make_date(y + 1, 3, 31)",
    y="SELECT DISTINCT year(d) AS y FROM oacq",
)
def pairs_summer_winter(spark, sf):
    return N.from_summer_winter(A.order_days(spark, sf)).select("pair_id")


@query("SELECT count(*) AS n, count(DISTINCT p) AS n_primary, CAST(min(days) AS INTEGER) AS least, CAST(max(days) AS INTEGER) AS most FROM drawn", drawn="SELECT * FROM onet")
def pairs_counts(spark, sf):
    return A.order_network(spark, sf).agg(F.count("*").alias("n"), F.countDistinct("primary").alias("n_primary"), F.min("days").alias("least"), F.max("days").alias("most"))


@query()
def pairs_random_winter(spark, sf):
    """Three dates a winter, drawn by a hash; no SQL, as the other engine has another hash."""
    return N.linking_winter(A.order_days(spark, sf), per_winter=3).select("pair_id", "days")


_TRIPLE = "SELECT a.p AS d1, a.s AS d2, b.s AS d3 FROM {n} a JOIN {n} b ON a.s = b.p JOIN {n} c ON c.p = a.p AND c.s = b.s"


@query(_TRIPLE.format(n="net"))
def triplets(spark, sf):
    return L.triplets(A.event_network(spark, sf))


@query("SELECT strftime(d1, '%Y%m%d') || '_' || strftime(d2, '%Y%m%d') || '_' || strftime(d3, '%Y%m%d') AS loop_id, CAST(d2 - d1 AS INTEGER) AS days12, CAST(d3 - d2 AS INTEGER) AS days23, CAST(d3 - d1 AS INTEGER) AS days13, strftime(d1, '%Y%m%d') || '_' || strftime(d3, '%Y%m%d') AS pair13 FROM t", t=_TRIPLE.format(n="onet"))
def triplet_columns(spark, sf):
    return L.triplet_columns(L.triplets(A.order_network(spark, sf))).select("loop_id", "days12", "days23", "days13", "pair13")


@query("SELECT d1, d2, d3, CAST(CASE WHEN q(d1) = q(d2) AND q(d2) = q(d3) AND d3 - d1 < 180 THEN q(d1) ELSE 0 END AS INTEGER) AS season FROM t".replace("q(d1)", "((month(d1) + 9) % 12 // 3 + 1)").replace("q(d2)", "((month(d2) + 9) % 12 // 3 + 1)").replace("q(d3)", "((month(d3) + 9) % 12 // 3 + 1)"), t=_TRIPLE.format(n="onet"))
def triplet_seasons(spark, sf):
    t = L.triplets(A.order_network(spark, sf))
    return t.select("d1", "d2", "d3", L.triplet_season(F.col("d1"), F.col("d2"), F.col("d3")).alias("season"))


@query("SELECT d1, d2, d3 FROM t WHERE d1 >= DATE '1996-01-01' AND d3 <= DATE '1996-12-31'", t=_TRIPLE.format(n="onet"))
def triplets_date_slice(spark, sf):
    t = L.triplet_paths(L.triplets(A.order_network(spark, sf)))
    path = F.col("path")
    return L.paths_between(t, "path", "1996-01-01", "1996-12-31").select(path[0].alias("d1"), path[1].alias("d2"), path[2].alias("d3"))


@query("SELECT d1, d2, d3, CAST(row_number() OVER (ORDER BY d3 - d1, d1, d2, d3) - 1 AS INTEGER) AS rank FROM t", t=_TRIPLE.format(n="net"))
def triplets_sorted(spark, sf):
    t = L.triplet_columns(L.triplets(A.event_network(spark, sf)))
    return L.sort_loops(t, ("days13", "d1", "d2", "d3")).select("d1", "d2", "d3", "rank")


@query("SELECT d1, d2, d3 FROM t UNION SELECT d1, d2, d3 FROM u", t=_TRIPLE.format(n="near"), u="SELECT a.p AS d1, a.s AS d2, b.s AS d3 FROM net a JOIN net b ON a.s = b.p JOIN net c ON c.p = a.p AND c.s = b.s WHERE a.i < 4")
def triplets_union(spark, sf):
    net = A.event_network(spark, sf)
    some = L.triplets(net).join(P.edge_index(net).filter("i < 4").select(F.col("primary").alias("d1")).distinct(), "d1", "left_semi")
    return L.triplets(_near(spark, sf)).select("d1", "d2", "d3").union(some.select("d1", "d2", "d3")).distinct()


_LOOPS = (
    "SELECT list_aggregate(list_transform(path, lambda x: strftime(x, '%Y%m%d')), 'string_agg', '_') AS loop_id, path FROM walk "
    "WHERE len(path) >= 3 AND EXISTS (SELECT 1 FROM {n} WHERE p = path[1] AND s = path[-1] AND days > {e})"
)
_WALK = "SELECT [p, s] AS path FROM {n} WHERE days <= {e} UNION ALL SELECT list_append(path, s) FROM walk JOIN {n} ON p = path[-1] WHERE days <= {e} AND len(path) < {m}"


def _loops_sql(body: str, n: str, edge: int, most: int) -> str:
    """Recursion needs its own keyword, so the walk is put in front by hand."""
    from .registry import with_views

    inner = with_views(f"SELECT * FROM {n}")
    head = inner[: inner.rindex("SELECT * FROM")]
    walk = _WALK.format(n=n, e=edge, m=most)
    found = _LOOPS.format(n=n, e=edge)
    return f"WITH RECURSIVE {head[len('WITH ') :].rstrip()}, walk AS ({walk}), found AS ({found}) {body}"


def _loops(spark: SparkSession, sf: str, most: int) -> DataFrame:
    return L.loops(A.event_network(spark, sf), most, edge_days=1)


for _k in (3, 4, 5):
    query(None, f"loops_{_k}")(lambda spark, sf, most=_k: _loops(spark, sf, most).select("loop_id"))


@query()
def loop_matrix(spark, sf):
    return L.loop_matrix(_loops(spark, sf, 4))


@query()
def loop_edge_pairs(spark, sf):
    return L.loop_pairs(_loops(spark, sf, 4), "edge").select("pair_id")


@query()
def loop_diagonal_pairs(spark, sf):
    return L.loop_pairs(_loops(spark, sf, 4), "diagonal").select("pair_id")


@query()
def loops_sorted(spark, sf):
    return L.sort_loops(_loops(spark, sf, 4)).select("loop_id", "rank")


def _register_loops() -> None:
    from .registry import SQL

    for k in (3, 4, 5):
        SQL[f"loops_{k}"] = _loops_sql("SELECT loop_id FROM found", "net", 1, k)
    pair = "strftime(path[k], '%Y%m%d') || '_' || strftime(path[k + 1], '%Y%m%d')"
    ends = "strftime(path[1], '%Y%m%d') || '_' || strftime(path[-1], '%Y%m%d')"
    edges = f"SELECT loop_id, {pair} AS pair_id, 1 AS coef FROM (SELECT loop_id, path, unnest(range(1, len(path))) AS k FROM found)"
    closing = f"SELECT loop_id, {ends}, -1 FROM found"
    SQL["loop_matrix"] = _loops_sql(f"{edges} UNION ALL {closing}", "net", 1, 4)
    SQL["loop_edge_pairs"] = _loops_sql(f"SELECT DISTINCT pair_id FROM ({edges})", "net", 1, 4)
    SQL["loop_diagonal_pairs"] = _loops_sql(f"SELECT DISTINCT {ends} AS pair_id FROM found", "net", 1, 4)
    SQL["loops_sorted"] = _loops_sql("SELECT loop_id, CAST(row_number() OVER (ORDER BY loop_id) - 1 AS INTEGER) AS rank FROM found", "net", 1, 4)


_register_loops()


@query("SELECT n.pair_id FROM onet n JOIN onet e ON e.days <= 12 AND e.p >= n.p AND e.s <= n.s GROUP BY n.pair_id, n.days HAVING sum(e.days) >= n.days")
def loop_valid_diagonals(spark, sf):
    net = A.order_network(spark, sf)
    return L.valid_diagonals(net, net.filter("days <= 12")).select("pair_id")


@query("SELECT pair_id, CAST(k AS INTEGER) AS interval FROM (SELECT pair_id, unnest(range(i, j)) AS k FROM net)")
def sbas_matrix(spark, sf):
    net = A.event_network(spark, sf)
    return I.design_table(net, P.acquisitions(net)).select("pair_id", F.col("interval").cast("int").alias("interval"))


_OTRI = "SELECT strftime(a.p, '%Y%m%d') || '_' || strftime(a.s, '%Y%m%d') || '_' || strftime(b.s, '%Y%m%d') AS loop_id, a.p AS d1, a.s AS d2, b.s AS d3 FROM onet a JOIN onet b ON a.s = b.p JOIN onet c ON c.p = a.p AND c.s = b.s"


@query("SELECT loop_id FROM otri WHERE (SELECT d FROM ork WHERE k = 40) IN (d1, d2, d3)", otri=_OTRI)
def triplets_touching_date(spark, sf):
    """Triplets with the forty-first acquisition among their dates."""
    day = A.order_days(spark, sf).orderBy("date").offset(40).first()[0]
    return L.paths_touching(L.triplet_paths(L.triplets(A.order_network(spark, sf))), "path", str(day)).select("loop_id")


@query("SELECT DISTINCT d1, d2, d3 FROM otri", otri=_OTRI)
def triplets_from_names(spark, sf):
    """Triplets from names that put the dates in another order."""
    rows = L.triplets(A.order_network(spark, sf))
    day = lambda c: F.date_format(c, "yyyyMMdd")
    return L.triplets_from_names(rows.select(F.concat_ws("_", day("d3"), day("d1"), day("d2")).alias("name")))
