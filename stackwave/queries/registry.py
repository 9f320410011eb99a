"""Registration of queries, and the common table expressions that their SQL shares."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_PAIR = "strftime({a}, '%Y%m%d') || '_' || strftime({b}, '%Y%m%d')"
#: In order of dependence; a query takes those that it or its parts name.
VIEWS = {
    "acq": "SELECT DISTINCT CAST(ts AS DATE) AS d FROM events",
    "rk": "SELECT d, row_number() OVER (ORDER BY d) - 1 AS k FROM acq",
    "net": f"SELECT {_PAIR.format(a='a.d', b='b.d')} AS pair_id, a.d AS p, b.d AS s, b.d - a.d AS days, a.k AS i, b.k AS j FROM rk a JOIN rk b ON b.k BETWEEN a.k + 1 AND a.k + 3 WHERE b.d - a.d < 180",
    "near": "SELECT * FROM net WHERE j - i <= 2",
    "oacq": "SELECT min(CAST(o_orderdate AS DATE)) AS d FROM orders GROUP BY floor((CAST(o_orderdate AS DATE) - DATE '1995-01-01') / 12)",
    "ork": "SELECT d, row_number() OVER (ORDER BY d) - 1 AS k FROM oacq",
    "onet": f"SELECT {_PAIR.format(a='a.d', b='b.d')} AS pair_id, a.d AS p, b.d AS s, b.d - a.d AS days, a.k AS i, b.k AS j FROM ork a JOIN ork b ON b.k BETWEEN a.k + 1 AND a.k + 3 WHERE b.d - a.d < 40",
    "daily": "SELECT user_id AS u, CAST(ts AS DATE) AS d, sum(CAST(round(value * 100) AS BIGINT)) AS c FROM events GROUP BY ALL",
    "surf": "SELECT q.u, CAST(q.u // 16 AS INTEGER) AS r, CAST(q.u % 16 AS INTEGER) AS c, rk.d, rk.k, CAST(sum(coalesce(daily.c, 0)) OVER (PARTITION BY q.u ORDER BY rk.d) AS BIGINT) AS cents FROM (SELECT DISTINCT u FROM daily) q CROSS JOIN rk LEFT JOIN daily ON daily.u = q.u AND daily.d = rk.d",
    "ifg": "SELECT n.pair_id, n.i, n.j, a.u, a.r, a.c, CAST(b.cents - a.cents AS DOUBLE) / 100 AS phase, CAST((a.u * 7 + n.i * 3 + n.j * 5) % 101 AS DOUBLE) / 100 AS coh FROM net n JOIN surf a ON a.d = n.p JOIN surf b ON b.d = n.s AND b.u = a.u",
    "gaps": "SELECT * REPLACE (CASE WHEN (u * 7 + i * 3 + j) % 11 <> 0 THEN phase END AS phase) FROM ifg",
    "img": "SELECT CAST(r AS BIGINT) AS r, CAST(c AS BIGINT) AS c, CAST(max_by(cents, d) AS DOUBLE) / 100 AS value FROM surf GROUP BY ALL",
    "high": "SELECT CAST(greatest(16, max(r) + 1) AS BIGINT) AS n FROM img",
    "temp": "SELECT site, d, CAST(220 - 3 * abs(dayofyear(d) - 200) + (site * 7 + (d - DATE '1995-01-01') * 13) % 41 + 8 * site AS DOUBLE) / 8 AS t FROM (SELECT CAST(n_nationkey AS INTEGER) AS site, CAST(unnest(generate_series(DATE '1995-01-01', DATE '1999-12-31', INTERVAL 1 DAY)) AS DATE) AS d FROM nation)",
    "pts": "SELECT vec_id AS point_id, round(CAST(embedding[1] AS DOUBLE) * 100) / 4 + 8 AS x, round(CAST(embedding[2] AS DOUBLE) * 100) / 4 + 8 AS y FROM embeddings",
}


def with_views(body: str, **more: str) -> str:
    """The statement with the views it names, directly or by other views, in front."""
    views = VIEWS | more
    wanted: set[str] = set()

    def need(text: str) -> None:
        for name in views:
            if name not in wanted and re.search(rf"\b{name}\b", text):
                wanted.add(name)
                need(views[name])

    need(body)
    parts = [f"{n} AS ({t})" for n, t in views.items() if n in wanted]
    return f"WITH {', '.join(parts)} {body}" if parts else body


def query(sql: str | None = None, name: str | None = None, **views: str):
    """Registers a function (spark, sf_dir) -> DataFrame, and its SQL."""

    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name or f.__name__] = f
        if sql is not None:
            SQL[name or f.__name__] = with_views(sql, **views)
        return f

    return keep
