"""Stacks of rasters as long tables: scene or pair, row, col, value."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import Grid, project
from ..functions.phase import Radar, coherence_scaled, los_ratio, phase_to_deformation

PIXEL = ("row", "col")


def match_scenes(phase: DataFrame, coherence: DataFrame, keep_common: bool = True) -> DataFrame:
    """Scene catalogs (pair_id, path, valid) joined by pair: the first path of each, and only pairs readable in both.

    With ``keep_common`` false, pairs that only one side has are an error.
    """

    def first(df: DataFrame, name: str) -> DataFrame:
        k = F.row_number().over(Window.partitionBy("pair_id").orderBy("path"))
        return df.withColumn("_k", k).filter("_k = 1").select("pair_id", F.col("path").alias(f"path_{name}"), F.col("valid").alias(f"valid_{name}"))

    both = first(phase, "unw").join(first(coherence, "coh"), "pair_id", "inner" if keep_common else "full")
    if not keep_common:
        alone = F.col("path_unw").isNull() | F.col("path_coh").isNull()
        both = both.withColumn("pair_id", F.when(alone, F.raise_error(F.concat(F.lit("no partner for "), "pair_id")).cast("string")).otherwise(F.col("pair_id")))
    return both.filter("valid_unw and valid_coh").select("pair_id", "path_unw", "path_coh")


def reference_mean(stack: DataFrame, points: DataFrame, key: str = "pair_id", value: str = "phase") -> DataFrame:
    """(key, reference): the mean of each raster over the reference pixels (row, col)."""
    return stack.join(points.select(*PIXEL).distinct(), list(PIXEL), "left_semi").groupBy(key).agg(F.avg(value).alias("reference"))


def rereference(stack: DataFrame, points: DataFrame, key: str = "pair_id", value: str = "phase") -> DataFrame:
    """Each raster less its own mean over the reference pixels; null where those have no value."""
    means = reference_mean(stack, points, key, value)
    return stack.join(means, key, "left").withColumn(value, F.col(value) - F.col("reference")).drop("reference")


def deformation(stack: DataFrame, points: DataFrame, radar: Radar, angle: DataFrame | None = None, kind: str = "incidence") -> DataFrame:
    """Export rule in one projection: less the reference mean, phase to mm, over the line-of-sight ratio (row, col, angle)."""
    rows = rereference(stack, points).withColumn("deformation", phase_to_deformation(F.col("phase"), radar))
    if angle is not None:
        rows = rows.join(angle, list(PIXEL), "left").withColumn("deformation", F.col("deformation") / los_ratio(F.col("angle"), kind)).drop("angle")
    return rows.drop("phase")


def coherence_mean(stack: DataFrame, low: float = 0.0, high: float = 1.0, value: str = "coh") -> DataFrame:
    """Per pixel the mean of the clipped coherence, scaled to [0, 1]; null without any value."""
    return stack.groupBy(*PIXEL).agg(F.avg(coherence_scaled(F.col(value), low, high)).alias("coh_mean"))


def missing_count(stack: DataFrame, value: str = "phase") -> DataFrame:
    """Per pixel the number of rasters without a value there (null or NaN)."""
    return stack.groupBy(*PIXEL).agg(F.sum((F.col(value).isNull() | F.isnan(value)).cast("int")).alias("n_missing"))


def valid_mask(stack: DataFrame, percent: float = 1.0, seed: int = 0, key: str = "pair_id", value: str = "phase") -> DataFrame:
    """Per pixel: valid, whether any of a share of the rasters, drawn by a hash of their name, has a value there."""
    scenes = stack.select(key).distinct()
    n = F.floor(F.count("*").over(Window.partitionBy()) * percent)
    drawn = scenes.withColumn("_k", F.row_number().over(Window.orderBy(F.xxhash64(key, F.lit(seed)), key))).withColumn("_n", n).filter("_k <= _n").select(key)
    return stack.join(drawn, key, "left_semi").groupBy(*PIXEL).agg(F.bool_or(F.col(value).isNotNull() & ~F.isnan(value)).alias("valid"))


def multilook(stack: DataFrame, azimuth: int, range_: int, *keys: str, value: str = "value") -> DataFrame:
    """Means of blocks of azimuth rows by range columns; missing values don't count."""
    row, col = (F.col("row") / azimuth).cast("int"), (F.col("col") / range_).cast("int")
    return stack.groupBy(*keys, row.alias("row"), col.alias("col")).agg(F.avg(value).alias(value))


def atmosphere_pairs(delays: DataFrame, pairs: DataFrame, points: DataFrame | None = None) -> DataFrame:
    """(pair_id, row, col, aps): delay of the primary less that of the secondary, less the mean of that over reference pixels.

    ``delays`` is (date, row, col, value).  Pairs with a date that has no raster don't appear; see ``pairs_without_delay``.
    """
    days = delays.select("date").distinct()
    known = pairs.join(days.withColumnRenamed("date", "primary"), "primary", "left_semi").join(days.withColumnRenamed("date", "secondary"), "secondary", "left_semi")
    first = delays.select(F.col("date").alias("primary"), *PIXEL, F.col("value").alias("_a"))
    second = delays.select(F.col("date").alias("secondary"), *PIXEL, F.col("value").alias("_b"))
    rows = known.select("pair_id", "primary", "secondary").join(first, "primary").join(second, ["secondary", *PIXEL])
    rows = rows.select("pair_id", *PIXEL, (F.col("_a") - F.col("_b")).alias("aps"))
    return rows if points is None else rereference(rows, points, value="aps")


def pairs_without_delay(delays: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs with a date that has no delay raster."""
    days = delays.select("date").distinct()
    have = pairs.join(days.withColumnRenamed("date", "primary"), "primary", "left_semi").join(days.withColumnRenamed("date", "secondary"), "secondary", "left_semi")
    return pairs.join(have, "pair_id", "left_anti")


def baselines_of_pairs(baselines: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pair_id, baseline): value of the secondary less that of the primary date; null where either is unknown."""
    a = baselines.select(F.col("date").alias("primary"), F.col("value").alias("_a"))
    b = baselines.select(F.col("date").alias("secondary"), F.col("value").alias("_b"))
    return pairs.join(a, "primary", "left").join(b, "secondary", "left").select("pair_id", (F.col("_b") - F.col("_a")).alias("baseline"))


def grid_pixels(frame: DataFrame, grid: Grid) -> DataFrame:
    """All (row, col) of a grid; ``frame`` lends its session."""
    rows = frame.sparkSession.range(grid.height).select(F.col("id").cast("int").alias("row"))
    return rows.select("row", F.explode(F.sequence(F.lit(0), F.lit(grid.width - 1))).alias("col"))


#: Cells a side of the blocks of the source grid that regridding works in.
BLOCK = 256
#: Source cells before and after the base cell that a method needs.
_REACH = {"nearest": (0, 0), "bilinear": (0, 1), "cubic": (1, 2)}


def _cubic(t: np.ndarray) -> list[np.ndarray]:
    """Weights of cubic convolution (a = -1/2) for the cells before, at, and two after a place."""
    return [((-0.5 * t + 1) * t - 0.5) * t, (1.5 * t - 2.5) * t * t + 1, ((-1.5 * t + 2) * t + 0.5) * t, (0.5 * t - 0.5) * t * t]


def regrid(raster: DataFrame, source: Grid, target: Grid, method: str = "nearest", *keys: str) -> DataFrame:
    """A raster (keys, row, col, value) on another grid: nearest, bilinear, cubic or average; null outside and without values.

    Grids may be of different systems.  Target cells go to the block of the source grid that holds their place, source cells to their block and,
    at its edge, to the next ones; so each row travels once or twice and a task holds a block with its rim.  Bilinear and cubic weights are
    taken of the cells that have a value.  The average is that of the source cells with their centre in the target cell.
    """
    from .spatial import with_scenes

    if method not in (*_REACH, "average"):
        raise ValueError("method is nearest, bilinear, cubic or average")
    far = source.crs and target.crs and source.crs != target.crs
    cells = grid_pixels(raster, target)
    if keys:
        cells = with_scenes(cells, raster.select(*keys))
    if method == "average":
        x, y = source.x(F.col("row") * 0 + F.col("col")), source.y(F.col("row"))
        if far:
            x, y = project(x, y, source.crs, target.crs)
        means = raster.select(*keys, target.row(y).alias("row"), target.col(x).alias("col"), "value").groupBy(*keys, "row", "col").agg(F.avg("value").alias("value"))
        return cells.join(means.hint("merge"), [*keys, "row", "col"], "left").select(*keys, "row", "col", "value")  # never broadcast, whatever the files' size
    x, y = target.x(F.col("col")), target.y(F.col("row"))
    if far:
        x, y = project(x, y, target.crs, source.crs)
    before, after = _REACH[method]
    half = 0.0 if method == "nearest" else 0.5
    fr, fc = (F.lit(source.top) - y) / source.yres - half, (x - source.left) / source.xres - half
    at = cells.select(*keys, "row", "col", fr.alias("_fr"), fc.alias("_fc")).withColumns({"_br": F.floor(F.floor("_fr") / BLOCK), "_bc": F.floor(F.floor("_fc") / BLOCK)})

    def rim(c: str) -> Column:
        return F.sequence(F.floor((F.col(c) - after) / BLOCK), F.floor((F.col(c) + before) / BLOCK))

    have = raster.filter("value is not null").select(*keys, F.col("row").alias("_r"), F.col("col").alias("_c"), F.col("value").cast("double").alias("_v"))
    have = have.withColumn("_br", F.explode(rim("_r"))).withColumn("_bc", F.explode(rim("_c")))
    kinds = dict(at.dtypes)

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return left.select([*keys, "row", "col"]).append_column("value", pa.array([], pa.float64()))
        up, side = left["_br"][0].as_py() * BLOCK - before, left["_bc"][0].as_py() * BLOCK - before
        block = np.full((BLOCK + before + after, BLOCK + before + after), np.nan)
        block[right["_r"].to_numpy() - up, right["_c"].to_numpy() - side] = right["_v"].to_numpy()
        fr, fc = left["_fr"].to_numpy(), left["_fc"].to_numpy()
        r, c = np.floor(fr).astype(np.int64), np.floor(fc).astype(np.int64)
        if method == "nearest":
            v = block[r - up, c - side]
        else:
            weights = _cubic if method == "cubic" else lambda t: [1 - t, t]
            total, held = np.zeros(len(r)), np.zeros(len(r))
            for i, wr in enumerate(weights(fr - r)):
                for j, wc in enumerate(weights(fc - c)):
                    part = block[r - up - before + i, c - side - before + j]
                    w = np.where(np.isnan(part), 0.0, wr * wc)
                    total, held = total + w * np.nan_to_num(part), held + w
            v = np.where(held > 1e-9, total / np.where(held > 1e-9, held, 1), np.nan)
        return left.select([*keys, "row", "col"]).append_column("value", pa.array(v, from_pandas=True))

    by = [*keys, "_br", "_bc"]
    return at.groupBy(*by).cogroup(have.groupBy(*by)).applyInArrow(work, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "row int, col int, value double"]))


def coarse_labels(frame: DataFrame, coarse: DataFrame, source: Grid, fine: Grid) -> DataFrame:
    """Per fine pixel the label of the coarse pixel (row, col, label) over its centre; -1 outside or without one."""
    rows = regrid(coarse.select("row", "col", F.col("label").alias("value")), source, fine)
    return rows.select("row", "col", F.coalesce("value", F.lit(-1)).cast("int").alias("label"))


def fill_missing(raster: DataFrame, radius: int, *keys: str, power: float = 1.0) -> DataFrame:
    """Missing pixels from the present ones within ``radius`` pixels, by inverse distance; null where there are none.

    Present pixels are spread to the cells they can reach, and only missing cells take them, so the work grows with
    the number of missing pixels times the area of the disc.
    """
    offsets = [(r, c, (r * r + c * c) ** -0.5) for r in range(-radius, radius + 1) for c in range(-radius, radius + 1) if 0 < r * r + c * c <= radius * radius]
    gone = raster.filter("value is null").select(*keys, "row", "col")
    reach = F.array(*(F.struct((F.col("row") + r).alias("_r"), (F.col("col") + c).alias("_c"), F.lit(w**power).alias("_w")) for r, c, w in offsets))
    near = gone.select(*keys, "row", "col", F.inline(reach))
    have = raster.filter("value is not null").select(*keys, F.col("row").alias("_r"), F.col("col").alias("_c"), F.col("value").alias("_v"))
    filled = near.join(have, [*keys, "_r", "_c"]).groupBy(*keys, "row", "col").agg((F.sum(F.col("_v") * F.col("_w")) / F.sum("_w")).alias("_f"))
    return raster.join(filled, [*keys, "row", "col"], "left").withColumn("value", F.coalesce("value", "_f")).drop("_f")


def select_bands(raster: DataFrame, bands: Sequence[int]) -> DataFrame:
    """Bands by number, from 1."""
    return raster.filter(F.col("band").isin(list(bands)))


def shape(raster: DataFrame, *dims: str) -> DataFrame:
    """One row: the number of distinct values of each dimension."""
    return raster.agg(*(F.countDistinct(d).alias(f"n_{d}") for d in dims))


def cell_place(order: str, bands: int, rows: int, cols: int) -> Column:
    """Place of a cell (band from 1, row and col from 0) in a cube's file."""
    b, r, c = F.col("band") - 1, F.col("row"), F.col("col")
    return {"BSQ": (b * rows + r) * cols + c, "BIL": (r * bands + b) * cols + c, "BIP": (r * cols + c) * bands + b}[order]


def add_band(cube: DataFrame, band: DataFrame) -> DataFrame:
    """A cube with one more band (row, col, value) after its last."""
    last = cube.agg(F.max("band").alias("_last"))
    return cube.unionByName(band.join(F.broadcast(last)).select((F.coalesce("_last", F.lit(0)) + 1).cast("int").alias("band"), "row", "col", "value"))


def sample_covariance(samples: DataFrame, image: str = "pair_id", point: str = "point_id", value: str = "value") -> DataFrame:
    """(a, b, covariance): sample covariance (n - 1) of every two images over their common points."""
    a = samples.select(F.col(point).alias("_p"), F.col(image).alias("a"), F.col(value).alias("_x"))
    b = samples.select(F.col(point).alias("_p"), F.col(image).alias("b"), F.col(value).alias("_y"))
    return a.join(b, "_p").groupBy("a", "b").agg(F.covar_samp("_x", "_y").alias("covariance"))


def sample_variance(samples: DataFrame, image: str = "pair_id", value: str = "value") -> DataFrame:
    return samples.groupBy(image).agg(F.var_samp(value).alias("variance"))
