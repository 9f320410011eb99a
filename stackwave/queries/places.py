"""Queries on points, boxes, polygons, grids and tiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters as A
from ..functions import geo as G
from ..operators import raster as R
from ..operators import spatial as S
from ..sinks import tables as K
from .registry import query

_RC = {"row": "r", "col": "c"}
_H = "(SELECT n FROM high)"
_VALUE = f"CAST(floor({_H} - y) AS INTEGER) AS r, CAST(floor(x) AS INTEGER) AS c"


@query(f"SELECT point_id, {_VALUE} FROM pts")
def point_row_col(spark, sf):
    grid = A.image_grid(spark, sf)
    return A.points(spark, sf).select("point_id", grid.row(F.col("y")).alias("r"), grid.col(F.col("x")).alias("c"))


@query(f"SELECT r, c, CAST(c AS DOUBLE) + 0.5 AS x, {_H} - (CAST(r AS DOUBLE) + 0.5) AS y FROM img")
def pixel_xy(spark, sf):
    grid = A.image_grid(spark, sf)
    return A.image(spark, sf).select(F.col("row").cast("long").alias("r"), F.col("col").cast("long").alias("c"), grid.x(F.col("col")).alias("x"), grid.y(F.col("row")).alias("y"))


@query(f"SELECT point_id, value FROM (SELECT point_id, {_VALUE} FROM pts) LEFT JOIN img USING (r, c)")
def point_samples(spark, sf):
    grid = A.image_grid(spark, sf)
    return S.sample_points(A.image(spark, sf), grid, A.points(spark, sf)).select("point_id", "value")


@query(f"SELECT p.pair_id, point_id, phase AS value FROM net p CROSS JOIN (SELECT point_id, {_VALUE} FROM pts) q LEFT JOIN ifg g ON g.pair_id = p.pair_id AND g.r = q.r AND g.c = q.c")
def stack_point_samples(spark, sf):
    """All points in all scenes of the stack."""
    rows = A.stack(spark, sf).select("pair_id", "row", "col", F.col("phase").alias("value"))
    return S.query(rows, A.image_grid(spark, sf), S.GeoQuery(points=A.points(spark, sf))).points.select("pair_id", "point_id", "value")


@query(
    f"SELECT 'points' AS part, n.pair_id, point_id AS id, NULL::BIGINT AS r, NULL::BIGINT AS c, phase AS value FROM near n CROSS JOIN (SELECT point_id, {_VALUE} FROM pts) q LEFT JOIN ifg g ON g.pair_id = n.pair_id AND g.r = q.r AND g.c = q.c WHERE n.j - n.i = 1 "
    f"UNION ALL SELECT 'box', pair_id, 0, r - ({_H} - 14), c - 3, phase FROM ifg WHERE j - i = 1 AND r BETWEEN {_H} - 14 AND {_H} - 6 AND c BETWEEN 3 AND 10 "
    f"UNION ALL SELECT 'box', pair_id, 1, r, c, phase FROM ifg WHERE j - i = 1 AND r BETWEEN 0 AND 3 AND c BETWEEN 0 AND 15 "
    f"UNION ALL SELECT 'polygons', pair_id, 1, r, c, phase FROM ifg WHERE j - i = 1 AND c BETWEEN 2 AND 9 AND {_H} - 1 - r BETWEEN 3 AND 12"
)
def composite_query(spark, sf):
    """Points, two boxes and a polygon in one query, on a subset of the pairs that is chosen before pixels are read."""
    grid, network = A.image_grid(spark, sf), A.event_network(spark, sf, 1)
    rows = A.stack(spark, sf).select("pair_id", "row", "col", F.col("phase").alias("value"))
    top = G.Box(0.0, grid.top - 4, 16.0, grid.top)
    found = S.query(rows, grid, S.GeoQuery(points=A.points(spark, sf), boxes=(_BOX, top), polygons=_polygons(spark, (1, "desired", _RECT))), network)

    def part(name, df, number):
        return df.select(F.lit(name).alias("part"), "pair_id", number.cast("long").alias("id"), F.col("row").cast("long").alias("r"), F.col("col").cast("long").alias("c"), "value")

    points = found.points.withColumns({"row": F.lit(None), "col": F.lit(None)})
    return part("points", points, F.col("point_id")).union(part("box", found.boxes[0], F.lit(0))).union(part("box", found.boxes[1], F.lit(1))).union(part("polygons", found.polygons, F.col("poly_id")))


_BOX = G.Box(3.0, 5.0, 11.0, 14.0)


@query(f"SELECT r - ({_H} - 14) AS r, c - 3 AS c, value FROM img WHERE r BETWEEN {_H} - 14 AND {_H} - 6 AND c BETWEEN 3 AND 10")
def box_window(spark, sf):
    grid = A.image_grid(spark, sf)
    return S.window(A.image(spark, sf), grid, _BOX).select(F.col("row").cast("long").alias("r"), F.col("col").cast("long").alias("c"), "value")


@query(f"SELECT CAST(a.r AS BIGINT) AS r, CAST(b.c AS BIGINT) AS c, value FROM (SELECT unnest(range(0, 8)) AS r) a CROSS JOIN (SELECT unnest(range(0, 9)) AS c) b LEFT JOIN img v ON v.r = a.r + {_H} - 19 AND v.c = b.c + 12")
def box_window_padded(spark, sf):
    grid = A.image_grid(spark, sf)
    found = S.window(A.image(spark, sf), grid, G.Box(12.0, 11.0, 21.0, 19.0), padded=True)
    return found.select(F.col("row").cast("long").alias("r"), F.col("col").cast("long").alias("c"), "value")


_BOXES = "SELECT s_suppkey AS k, CAST(s_suppkey + s_suppkey % 7 AS DOUBLE) / 2 AS x0, CAST(s_suppkey % 5 AS DOUBLE) AS y0, CAST(s_suppkey + s_suppkey % 7 AS DOUBLE) / 2 + 2 + s_suppkey % 3 AS x1, CAST(s_suppkey % 5 + 3 + s_suppkey % 4 AS DOUBLE) AS y1 FROM supplier"


@query("SELECT a.k AS a, b.k AS b, a.x0 <= b.x0 AND a.x1 >= b.x1 AND a.y0 <= b.y0 AND a.y1 >= b.y1 AS holds, a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1 AS meets FROM boxes a JOIN boxes b ON floor(a.x0 / 4) <= floor(b.x1 / 4) AND floor(b.x0 / 4) <= floor(a.x1 / 4) AND floor(a.y0 / 4) <= floor(b.y1 / 4) AND floor(b.y0 / 4) <= floor(a.y1 / 4)", boxes=_BOXES)
def box_predicates(spark, sf):
    """Containment and intersection of all suppliers' boxes that share a cell of a lattice."""
    k = F.col("s_suppkey")
    x, y = (k + k % 7) / 2, (k % 5).cast("double")
    boxes = A.table(spark, sf, "supplier").select(k.alias("id"), x.alias("left"), y.alias("bottom"), (x + 2 + k % 3).alias("right"), (y + 3 + k % 4).alias("top"))
    pairs = S.boxes_near(boxes, boxes, 4.0)
    return pairs.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), G.box_contains("a_", "b_").alias("holds"), G.boxes_intersect("a_", "b_").alias("meets"))


@query("SELECT min(CAST(s_suppkey % 7 AS DOUBLE)) AS \"left\", min(CAST(s_suppkey % 5 AS DOUBLE)) AS bottom, max(CAST(s_suppkey % 7 + 2 + s_suppkey % 3 AS DOUBLE)) AS \"right\", max(CAST(s_suppkey % 5 + 3 + s_suppkey % 4 AS DOUBLE)) AS top FROM supplier")
def dataset_bounds(spark, sf):
    k = F.col("s_suppkey")
    boxes = A.table(spark, sf, "supplier").select((k % 7).cast("double").alias("left"), (k % 5).cast("double").alias("bottom"), (k % 7 + 2 + k % 3).cast("double").alias("right"), (k % 5 + 3 + k % 4).cast("double").alias("top"))
    return S.dataset_bounds(boxes)


@query(f"SELECT CAST(max(c) - min(c) + 1 AS BIGINT) AS width, CAST(max(r) - min(r) + 1 AS BIGINT) AS height, CAST(1 AS DOUBLE) AS xres, CAST(CASE WHEN max(r) > min(r) THEN 1 END AS DOUBLE) AS yres, CAST(min(c) AS DOUBLE) AS \"left\", CAST(CASE WHEN max(r) > min(r) THEN {_H} - 1 - max(r) END AS DOUBLE) AS bottom, CAST(max(c) + 1 AS DOUBLE) AS \"right\", CAST(CASE WHEN max(r) > min(r) THEN {_H} - min(r) END AS DOUBLE) AS top FROM img")
def lattice_bounds(spark, sf):
    grid = A.image_grid(spark, sf)
    cells = A.image(spark, sf).select(grid.x(F.col("col")).alias("lon"), grid.y(F.col("row")).alias("lat"))
    return S.lattice_bounds(cells)


@query(f"SELECT r, c, CAST(least(({_H} - 1 - r) // ({_H} // 5), 4) AS BIGINT) AS tile_row, CAST(least(c // 5, 2) AS BIGINT) AS tile_col FROM img")
def tile_of_pixel(spark, sf):
    rows = S.Tiling(A.image_grid(spark, sf), rows=5, cols=3).assign(A.image(spark, sf))
    return rows.select(*(F.col(a).cast("long").alias(b) for a, b in (("row", "r"), ("col", "c"), ("tile_row", "tile_row"), ("tile_col", "tile_col"))))


@query(f"SELECT CAST(r AS INTEGER) AS tile_row, CAST(c AS INTEGER) AS tile_col, CAST(c * 5 AS DOUBLE) AS \"left\", CAST(r * ({_H} // 5) AS DOUBLE) AS bottom, CAST(CASE WHEN c = 2 THEN 16 ELSE c * 5 + 5 END AS DOUBLE) AS \"right\", CAST(CASE WHEN r = 4 THEN {_H} ELSE (r + 1) * ({_H} // 5) END AS DOUBLE) AS top FROM (SELECT unnest(range(0, 5)) AS r) CROSS JOIN (SELECT unnest(range(0, 3)) AS c)")
def tile_boxes(spark, sf):
    return S.Tiling(A.image_grid(spark, sf), rows=5, cols=3).table(A.table(spark, sf, "region"))


_RECT = [[(2.5, 3.5), (9.5, 3.5), (9.5, 12.5), (2.5, 12.5)]]
_TRIANGLE = [[(1.0, 1.0), (15.0, 1.0), (8.0, 15.0)]]
_HOLE = [[(5.0, 5.0), (8.0, 5.0), (8.0, 8.0), (5.0, 8.0)]]


def _polygons(spark, *what):
    rows = [(k, kind, [[{"x": x, "y": y} for x, y in ring] for ring in rings]) for k, kind, rings in what]
    return spark.createDataFrame(rows, "poly_id long, type string, rings array<array<struct<x:double,y:double>>>")


_CX, _CY = "(c + 0.5)", f"({_H} - 0.5 - r)"
_IN_TRIANGLE = f"{_CY} > 1 AND 2 * ({_CX} - 1) > {_CY} - 1 AND 2 * (15 - {_CX}) > {_CY} - 1"


@query(f"SELECT r, c, value, CAST(1 AS BIGINT) AS poly_id FROM img WHERE {_CX} BETWEEN 2.5 AND 9.4 AND {_CY} BETWEEN 3.5 AND 12.4 AND NOT ({_CX} BETWEEN 5 AND 8 AND {_CY} BETWEEN 5 AND 8) UNION ALL SELECT r, c, value, 2 FROM img WHERE {_IN_TRIANGLE} AND NOT ({_CX} BETWEEN 5 AND 8 AND {_CY} BETWEEN 5 AND 8)")
def polygon_pixels(spark, sf):
    """Pixels with their centre in desired polygons and not in the undesired one."""
    grid = A.image_grid(spark, sf)
    polygons = _polygons(spark, (1, "desired", _RECT), (2, "desired", _TRIANGLE), (3, "undesired", _HOLE))
    found = S.polygon_pixels(A.image(spark, sf), grid, polygons, all_touched=False)
    return found.select(F.col("row").cast("long").alias("r"), F.col("col").cast("long").alias("c"), "value", "poly_id")


@query(f"SELECT r, c, value FROM img WHERE c BETWEEN 2 AND 9 AND {_H} - 1 - r BETWEEN 3 AND 12")
def polygon_all_touched(spark, sf):
    """Pixels that a rectangle touches at all."""
    grid = A.image_grid(spark, sf)
    found = S.polygon_pixels(A.image(spark, sf), grid, _polygons(spark, (1, "desired", _RECT)), all_touched=True)
    return found.select(F.col("row").cast("long").alias("r"), F.col("col").cast("long").alias("c"), "value")


@query(f"SELECT r, c, value FROM img WHERE NOT ({_IN_TRIANGLE})")
def polygon_undesired(spark, sf):
    """With undesired polygons only: what none covers."""
    grid = A.image_grid(spark, sf)
    found = S.polygon_pixels(A.image(spark, sf), grid, _polygons(spark, (1, "undesired", _TRIANGLE)), all_touched=False)
    return found.select(F.col("row").cast("long").alias("r"), F.col("col").cast("long").alias("c"), "value")


@query("SELECT CAST(2 AS BIGINT) AS n_desired, CAST(1 AS BIGINT) AS n_undesired, true AS mixed")
def polygon_roles(spark, sf):
    return S.polygon_roles(S.polygons_union(_polygons(spark, (1, "desired", _RECT)), _polygons(spark, (2, "desired", _TRIANGLE), (3, "undesired", _HOLE))))


@query("SELECT * FROM (VALUES (CAST(1 AS BIGINT), CAST(2.5 AS DOUBLE), CAST(3.5 AS DOUBLE), CAST(9.5 AS DOUBLE), CAST(12.5 AS DOUBLE)), (2, 1, 1, 15, 15)) AS t(poly_id, \"left\", bottom, \"right\", top)")
def polygon_bounds(spark, sf):
    return S.polygon_bounds(_polygons(spark, (1, "desired", _RECT), (2, "desired", _TRIANGLE)))


@query("SELECT count(*) AS n FROM (SELECT x, y FROM pts UNION ALL SELECT x, y FROM pts WHERE point_id % 3 = 0)")
def points_union(spark, sf):
    p = A.points(spark, sf)
    return S.points_union(p, p.filter("point_id % 3 = 0")).agg(F.count("*").alias("n"))


@query("SELECT point_id, x, y FROM pts WHERE (x, y) NOT IN (SELECT (x, y) FROM pts WHERE point_id % 3 = 0)")
def points_difference(spark, sf):
    p = A.points(spark, sf)
    return S.points_difference(p, p.filter("point_id % 3 = 0"))


@query("SELECT point_id, x, y FROM pts WHERE (x, y) IN (SELECT (x, y) FROM pts WHERE point_id % 3 = 0)")
def points_member(spark, sf):
    p = A.points(spark, sf)
    return S.points_member(p, p.filter("point_id % 3 = 0"))


@query("SELECT point_id, x, y FROM pts WHERE x BETWEEN 3 AND 11 AND y BETWEEN 5 AND 14")
def points_in_box(spark, sf):
    return A.points(spark, sf).filter(_BOX.holds(F.col("x"), F.col("y")))


def _fine(grid):
    """Cells of 3/4 that reach beyond the image at the left, the bottom and the top."""
    return G.Grid.of(G.Box(-1.0, -1.0, 13.0, grid.top + 1.25), 0.75)


_FX, _FY = "(-1.0 + (q.c + 0.5) * 0.75)", f"({_H} + 1.25 - (p.r + 0.5) * 0.75)"
_CELLS = f"(SELECT CAST(unnest(range(0, CAST(round_even(({_H} + 2.25) / 0.75, 0) AS BIGINT))) AS BIGINT) AS r) p CROSS JOIN (SELECT CAST(unnest(range(0, 19)) AS BIGINT) AS c) q"


@query(f"SELECT p.r, q.c, value FROM {_CELLS} LEFT JOIN img v ON v.r = floor({_H} - {_FY}) AND v.c = floor({_FX})")
def regrid_nearest(spark, sf):
    grid = A.image_grid(spark, sf)
    return R.regrid(A.image(spark, sf), grid, _fine(grid)).select(F.col("row").cast("long").alias("r"), F.col("col").cast("long").alias("c"), "value")


@query(
    f"SELECT r, c, round(sum(w * value) / sum(w) FILTER (value IS NOT NULL), 8) + 0.0 AS value FROM (SELECT k.r, k.c, k.w, v.value FROM corners k LEFT JOIN img v ON v.r = k.a AND v.c = k.b) GROUP BY r, c",
    fine=f"SELECT p.r, q.c, {_H} - {_FY} - 0.5 AS fr, {_FX} - 0.5 AS fc FROM {_CELLS}",
    corners="SELECT r, c, floor(fr) + da.n AS a, floor(fc) + db.n AS b, CAST((1 - abs(fr - floor(fr) - da.n)) * (1 - abs(fc - floor(fc) - db.n)) AS DOUBLE) AS w FROM fine CROSS JOIN (SELECT unnest([0, 1]) AS n) da CROSS JOIN (SELECT unnest([0, 1]) AS n) db",
)
def regrid_bilinear(spark, sf):
    grid = A.image_grid(spark, sf)
    found = R.regrid(A.image(spark, sf), grid, _fine(grid), "bilinear")
    return found.select(F.col("row").cast("long").alias("r"), F.col("col").cast("long").alias("c"), (F.round("value", 8) + 0.0).alias("value"))


@query(f"SELECT p.r, q.c, CAST(coalesce((v.r * 16 + v.c) % 5, -1) AS INTEGER) AS label FROM {_CELLS} LEFT JOIN img v ON v.r = floor({_H} - {_FY}) AND v.c = floor({_FX})")
def coarse_labels(spark, sf):
    grid = A.image_grid(spark, sf)
    coarse = A.image(spark, sf).select("row", "col", ((F.col("row") * 16 + F.col("col")) % 5).alias("label"))
    return R.coarse_labels(coarse, coarse, grid, _fine(grid)).select(F.col("row").cast("long").alias("r"), F.col("col").cast("long").alias("c"), "label")


@query(
    "SELECT g.r, g.c, round(coalesce(g.value, (SELECT sum(h.value / sqrt(w(h, g))) / sum(1 / sqrt(w(h, g))) FROM holes h WHERE h.value IS NOT NULL AND w(h, g) BETWEEN 1 AND 4)), 4) + 0.0 AS value FROM holes g".replace("w(h, g)", "CAST((h.r - g.r) * (h.r - g.r) + (h.c - g.c) * (h.c - g.c) AS DOUBLE)"),
    holes="SELECT r, c, CASE WHEN (r * 16 + c) % 6 <> 0 THEN value END AS value FROM img",
)
def filled_holes(spark, sf):
    holes = A.image(spark, sf).withColumn("value", F.when((F.col("row") * 16 + F.col("col")) % 6 != 0, F.col("value")))
    found = R.fill_missing(holes, 2)
    return found.select(F.col("row").cast("long").alias("r"), F.col("col").cast("long").alias("c"), (F.round("value", 4) + 0.0).alias("value"))


_E = f"CAST({G.EARTH!r} AS DOUBLE)"


@query(f"SELECT point_id, round(radians(x) * {_E}, 3) + 0.0 AS mx, round(ln(tan(pi() / 4 + radians(y) / 2)) * {_E}, 3) + 0.0 AS my FROM pts")
def web_mercator(spark, sf):
    x, y = G.project(F.col("x"), F.col("y"), "EPSG:4326", "EPSG:3857")
    return A.points(spark, sf).select("point_id", (F.round(x, 3) + 0.0).alias("mx"), (F.round(y, 3) + 0.0).alias("my"))


@query("SELECT point_id, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y FROM pts")
def utm_round_trip(spark, sf):
    """Degrees to UTM zone 32 and back."""
    lon, lat = F.col("x") / 4 + 7, F.col("y")
    u = G.project(lon, lat, "EPSG:4326", "EPSG:32632")
    rows = A.points(spark, sf).select("point_id", u[0].alias("e"), u[1].alias("n"))
    x, y = G.project(F.col("e"), F.col("n"), "EPSG:32632", "EPSG:4326")
    return rows.select("point_id", (F.round((x - 7) * 4, 6) + 0.0).alias("x"), (F.round(y, 6) + 0.0).alias("y"))



@query("SELECT k, 'POLYGON ((' || x0 || ' ' || y0 || ', ' || x1 || ' ' || y0 || ', ' || x1 || ' ' || y1 || ', ' || x0 || ' ' || y1 || ', ' || x0 || ' ' || y0 || '))' AS box, 'POLYGON ((' || x0 || ' ' || y0 || ', ' || x1 || ' ' || y0 || ', ' || x1 || ' ' || y1 || '))' AS ring FROM boxes", boxes=_BOXES)
def box_texts(spark, sf):
    """Boxes and rings as well-known text."""
    k = F.col("s_suppkey")
    x, y = (k + k % 7) / 2, (k % 5).cast("double")
    b = A.table(spark, sf, "supplier").select(k.alias("k"), x.alias("x0"), y.alias("y0"), (x + 2 + k % 3).alias("x1"), (y + 3 + k % 4).alias("y1"))
    point = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    ring = F.array(F.array(point("x0", "y0"), point("x1", "y0"), point("x1", "y1")))
    return b.select("k", K.box_wkt(*(F.col(c) for c in ("x0", "y0", "x1", "y1"))).alias("box"), K.ring_wkt(ring).alias("ring"))
