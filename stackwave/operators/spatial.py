"""Spatial queries on pixel tables: points, boxes and polygons."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import Box, Grid, project
from .raster import grid_pixels


@dataclass(frozen=True)
class GeoQuery:
    """A composite query; at least one part is given.  Points and polygons are tables, boxes are few and local."""

    points: DataFrame | None = None
    boxes: tuple[Box, ...] = ()
    polygons: DataFrame | None = None

    def __post_init__(self) -> None:
        if self.points is None and not self.boxes and self.polygons is None:
            raise ValueError("a query has points, boxes or polygons")


@dataclass(frozen=True)
class QueryResult:
    """A table for each part of the query."""

    points: DataFrame | None = None
    boxes: tuple[DataFrame, ...] = field(default=())
    polygons: DataFrame | None = None


def query(raster: DataFrame, grid: Grid, what: GeoQuery, pairs: DataFrame | None = None, *keys: str) -> QueryResult:
    """Evaluates a query on a stack; with ``pairs``, on their scenes only, which prunes partitions before pixels are read."""
    keys = keys or ("pair_id",)
    if pairs is not None:
        raster = raster.join(pairs.select("pair_id").distinct(), "pair_id", "left_semi")
    return QueryResult(
        None if what.points is None else sample_points(raster, grid, what.points, *keys),
        tuple(window(raster, grid, box, *keys) for box in what.boxes),
        None if what.polygons is None else polygon_pixels(raster, grid, what.polygons),
    )


def sample_points(raster: DataFrame, grid: Grid, points: DataFrame, *keys: str, crs: str | None = None) -> DataFrame:
    """(keys, point_id, value) of the pixel that holds each point; null outside the grid or without a value.

    Rows of ``points`` are point_id, x, y, in ``crs`` or the grid's system.
    """
    x, y = F.col("x"), F.col("y")
    if crs and grid.crs:
        x, y = project(x, y, crs, grid.crs)
    at = points.select("point_id", grid.row(y).alias("row"), grid.col(x).alias("col"))
    found = raster.select(*keys, "row", "col", "value")
    if not keys:
        return at.join(found, ["row", "col"], "left").select("point_id", "value")
    at = with_scenes(at, raster.select(*keys))
    return at.join(found, [*keys, "row", "col"], "left").select(*keys, "point_id", "value")


def with_scenes(rows: DataFrame, scenes: DataFrame, most: int = 100_000) -> DataFrame:
    """Each row once for every scene (distinct rows of ``scenes``), by an array of them in the plan instead of a join.

    A stack has thousands of scenes; more than ``most`` are an error.
    """
    known = scenes.distinct().limit(most + 1).collect()
    if len(known) > most:
        raise ValueError(f"more than {most} scenes")
    kind = f"array<struct<{','.join(f'{f.name}:{f.dataType.simpleString()}' for f in scenes.schema)}>>"
    kinds = [f.dataType for f in scenes.schema]
    if not known:
        return rows.select("*", *(F.lit(None).cast(k).alias(f.name) for k, f in zip(kinds, scenes.schema, strict=True))).limit(0)
    each = F.array(*(F.struct(*(F.lit(v).cast(k).alias(n) for n, v, k in zip(scenes.columns, r, kinds, strict=True))) for r in known)).cast(kind)
    return rows.select("*", F.inline(each))


def window(raster: DataFrame, grid: Grid, box: Box, *keys: str, padded: bool = False) -> DataFrame:
    """(keys, row, col, value) of the box's window, row and col from its corner; ``padded`` adds null cells outside the grid."""
    row, col, height, width = grid.window(box)
    inside = raster.filter(F.col("row").between(row, row + height - 1) & F.col("col").between(col, col + width - 1))
    inside = inside.select(*keys, (F.col("row") - row).alias("row"), (F.col("col") - col).alias("col"), "value")
    if not padded:
        return inside
    cells = grid_pixels(raster, grid.sub(box))
    if keys:
        cells = with_scenes(cells, raster.select(*keys))
    return cells.join(inside, [*keys, "row", "col"], "left").select(*keys, "row", "col", "value")


def _edges(ring: Column) -> Column:
    """Edges of a ring, which may or may not repeat its first point."""
    n = F.size(ring)
    return F.transform(F.sequence(F.lit(1), n), lambda k: F.struct(F.element_at(ring, k).alias("a"), F.element_at(ring, F.when(k == n, 1).otherwise(k + 1)).alias("b")))


def point_in_rings(x: Column, y: Column, rings: Column) -> Column:
    """Whether a point is inside by the even-odd rule; later rings are holes or islands."""

    def crosses(e: Column) -> Column:
        ax, ay, bx, by = e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"]
        return ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)

    edges = F.flatten(F.transform(rings, _edges))
    return F.aggregate(edges, F.lit(False), lambda inside, e: inside != F.coalesce(crosses(e), F.lit(False)))


def rings_touch_cell(x0: Column, y0: Column, x1: Column, y1: Column, rings: Column) -> Column:
    """Whether an edge of the rings meets the closed cell (x0, y0, x1, y1): clipping of the edge leaves something."""

    def meets(e: Column) -> Column:
        ax, ay = e["a"]["x"], e["a"]["y"]
        dx, dy = e["b"]["x"] - ax, e["b"]["y"] - ay

        def span(d: Column, low: Column, high: Column) -> tuple[Column, Column]:
            # an edge along the other axis is inside the slab for its whole length, or never
            t0 = F.when(d == 0, F.when((low <= 0) & (high >= 0), F.lit(0.0)).otherwise(F.lit(2.0))).otherwise(F.least(low / d, high / d))
            return t0, F.when(d == 0, F.lit(1.0)).otherwise(F.greatest(low / d, high / d))

        xs, ys = span(dx, x0 - ax, x1 - ax), span(dy, y0 - ay, y1 - ay)
        return F.greatest(xs[0], ys[0], F.lit(0.0)) <= F.least(xs[1], ys[1], F.lit(1.0))

    return F.exists(F.flatten(F.transform(rings, _edges)), meets)


def ring_bounds(rings: Column) -> Column:
    """Bounding box of rings as a struct."""

    def along(axis: str) -> Column:
        return F.flatten(F.transform(rings, lambda r: F.transform(r, lambda p: p[axis])))

    xs, ys = along("x"), along("y")
    return F.struct(F.array_min(xs).alias("left"), F.array_min(ys).alias("bottom"), F.array_max(xs).alias("right"), F.array_max(ys).alias("top"))


def _covered(frame: DataFrame, grid: Grid, polygons: DataFrame, all_touched: bool, pad: bool) -> DataFrame:
    """(poly_id, row, col) of the grid's pixels that polygons cover; the bounding box of each polygon gives its pixels, without a join.

    A pixel is covered by its centre, or with ``all_touched`` by any part.  ``pad`` grows the box of candidates by half a pixel.
    """
    b = ring_bounds(F.col("rings"))
    grow = 0.5 if pad or all_touched else 0.0
    def places(low: Column, high: Column, size: int) -> Column:
        first, last = F.greatest(F.floor(low - grow), F.lit(0)).cast("int"), F.least(F.floor(high + grow), F.lit(size - 1)).cast("int")
        return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))

    rows = polygons.select("poly_id", "rings", b.alias("b"))
    rows = rows.select("poly_id", "rings", "b", F.explode(places((F.lit(grid.top) - F.col("b.top")) / grid.yres, (F.lit(grid.top) - F.col("b.bottom")) / grid.yres, grid.height)).alias("row"))
    near = rows.repartition("poly_id", "row").select("poly_id", "rings", "row", F.explode(places((F.col("b.left") - grid.left) / grid.xres, (F.col("b.right") - grid.left) / grid.xres, grid.width)).alias("col"))
    x, y = grid.x(F.col("col")), grid.y(F.col("row"))
    covered = point_in_rings(x, y, F.col("rings"))
    if all_touched:
        covered = covered | rings_touch_cell(x - grid.xres / 2, y - grid.yres / 2, x + grid.xres / 2, y + grid.yres / 2, F.col("rings"))
    return near.filter(covered).select("poly_id", "row", "col")


def polygon_pixels(raster: DataFrame, grid: Grid, polygons: DataFrame, all_touched: bool = True, pad: bool = False) -> DataFrame:
    """Rows of the raster that polygons choose, with poly_id.

    Polygons (poly_id, type, rings) are desired or undesired.  With desired ones, a pixel comes once for each desired polygon that covers it,
    unless an undesired one covers it too; with undesired ones only, all pixels that none covers come, with a null poly_id.
    """
    desired, undesired = polygons.filter("type = 'desired'"), polygons.filter("type = 'undesired'")
    if not undesired.isEmpty():
        blocked = _covered(raster, grid, undesired, all_touched, pad).select("row", "col").distinct()
        raster = raster.join(blocked, ["row", "col"], "left_anti")
    if desired.isEmpty():
        return raster.select(*raster.columns, F.lit(None).cast("long").alias("poly_id"))
    return raster.join(_covered(raster, grid, desired, all_touched, pad), ["row", "col"]).select(*raster.columns, "poly_id")


def boxes_near(a: DataFrame, b: DataFrame, cell: float, key: str = "id") -> DataFrame:
    """Every pair of boxes (id, left, bottom, right, top) of two tables that share a cell of a square lattice, once; columns a_* and b_*.

    An equi-join on cells; with cells about as large as the boxes each goes to a few.
    """

    def celled(boxes: DataFrame, name: str) -> DataFrame:
        rows = boxes.select([F.col(c).alias(f"{name}_{c}") for c in boxes.columns])
        for axis, low, high in (("x", "left", "right"), ("y", "bottom", "top")):
            rows = rows.withColumn(f"_{axis}", F.explode(F.sequence(F.floor(F.col(f"{name}_{low}") / cell), F.floor(F.col(f"{name}_{high}") / cell))))
        return rows

    def first(axis: str, low: str) -> Column:  # of the cells that two boxes share, the lowest counts
        return F.col(f"_{axis}") == F.greatest(F.floor(F.col(f"a_{low}") / cell), F.floor(F.col(f"b_{low}") / cell))

    return celled(a, "a").join(celled(b, "b"), ["_x", "_y"]).filter(first("x", "left") & first("y", "bottom")).drop("_x", "_y")


def polygon_roles(polygons: DataFrame) -> DataFrame:
    """One row: number of desired and undesired polygons, and whether both occur."""
    d, u = F.sum((F.col("type") == "desired").cast("int")), F.sum((F.col("type") == "undesired").cast("int"))
    return polygons.agg(d.alias("n_desired"), u.alias("n_undesired"), ((d > 0) & (u > 0)).alias("mixed"))


def polygon_bounds(polygons: DataFrame) -> DataFrame:
    """(poly_id, left, bottom, right, top)."""
    return polygons.select("poly_id", ring_bounds(F.col("rings")).alias("b")).select("poly_id", "b.*")


def points_union(a: DataFrame, b: DataFrame) -> DataFrame:
    """All points of both, repeats included."""
    return a.unionByName(b)


def points_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Points whose coordinates aren't in ``b``."""
    return a.join(b.select("x", "y").distinct(), ["x", "y"], "left_anti").select(*a.columns)


def points_member(a: DataFrame, b: DataFrame) -> DataFrame:
    """Points whose coordinates are in ``b``."""
    return a.join(b.select("x", "y").distinct(), ["x", "y"], "left_semi").select(*a.columns)


def polygons_union(*tables: DataFrame) -> DataFrame:
    out, *rest = tables
    for t in rest:
        out = out.unionByName(t)
    return out


def dataset_bounds(boxes: DataFrame) -> DataFrame:
    """One row: the hull of all boxes."""
    return boxes.agg(F.min("left").alias("left"), F.min("bottom").alias("bottom"), F.max("right").alias("right"), F.max("top").alias("top"))


def lattice_bounds(cells: DataFrame, x: str = "lon", y: str = "lat") -> DataFrame:
    """One row: resolution (extent by steps) and bounds, half a cell beyond the outer centres."""
    nx, ny = F.countDistinct(x), F.countDistinct(y)
    got = cells.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"), nx.alias("width"), ny.alias("height"))
    xres, yres = (F.try_divide(F.col(f"{a}1") - F.col(f"{a}0"), F.col(n) - 1) for a, n in (("x", "width"), ("y", "height")))  # null for one line
    return got.select("width", "height", xres.alias("xres"), yres.alias("yres"), (F.col("x0") - xres / 2).alias("left"), (F.col("y0") - yres / 2).alias("bottom"), (F.col("x1") + xres / 2).alias("right"), (F.col("y1") + yres / 2).alias("top"))


@dataclass(frozen=True)
class Tiling:
    """Tiles of a grid, numbered from the bottom row and the left column; the last ones stretch to the edge."""

    grid: Grid
    rows: int = 1
    cols: int = 1

    @classmethod
    def of_size(cls, grid: Grid, height: int | None = None, width: int | None = None) -> Tiling:
        """Tiles of a given height and width in pixels; None: the whole extent."""
        return cls(grid, max(1, grid.height // height) if height else 1, max(1, grid.width // width) if width else 1)

    @property
    def tile_height(self) -> int:
        return max(1, self.grid.height // self.rows)

    @property
    def tile_width(self) -> int:
        return max(1, self.grid.width // self.cols)

    def tile_row(self, row: Column) -> Column:
        return F.least(F.floor((self.grid.height - 1 - row) / self.tile_height), F.lit(self.rows - 1)).cast("int")

    def tile_col(self, col: Column) -> Column:
        return F.least(F.floor(col / self.tile_width), F.lit(self.cols - 1)).cast("int")

    def boxes(self) -> Iterable[tuple[int, int, Box]]:
        g = self.grid
        bottom = g.top - g.height * g.yres
        for r in range(self.rows):
            y0 = bottom + r * self.tile_height * g.yres
            y1 = g.top if r == self.rows - 1 else bottom + (r + 1) * self.tile_height * g.yres
            for c in range(self.cols):
                x0 = g.left + c * self.tile_width * g.xres
                x1 = g.left + g.width * g.xres if c == self.cols - 1 else g.left + (c + 1) * self.tile_width * g.xres
                yield r, c, Box(x0, y0, x1, y1)

    def table(self, frame: DataFrame) -> DataFrame:
        """(tile_row, tile_col, left, bottom, right, top); ``frame`` lends its session."""
        rows = [(r, c, float(b.left), float(b.bottom), float(b.right), float(b.top)) for r, c, b in self.boxes()]
        return frame.sparkSession.createDataFrame(rows, "tile_row int, tile_col int, left double, bottom double, right double, top double")

    def assign(self, pixels: DataFrame) -> DataFrame:
        """Adds tile_row and tile_col, which also serve as a key to repartition by."""
        return pixels.withColumns({"tile_row": self.tile_row(F.col("row")), "tile_col": self.tile_col(F.col("col"))})
