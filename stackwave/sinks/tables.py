"""Sinks: partitioned tables, tile upserts, cubes, vectors and overlays."""

from __future__ import annotations

import struct
import zipfile
import zlib
from collections.abc import Iterator
from pathlib import Path
from xml.sax.saxutils import escape

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import Grid


def write_scenes(stack: DataFrame, path: str, key: str = "pair_id") -> None:
    """One folder a scene; rows of a scene are dealt to few files by their row block, so a large scene isn't one task."""
    spread = stack.repartition(F.col(key), F.floor(F.col("row") / 1024))
    spread.write.partitionBy(key).mode("overwrite").parquet(path)


def upsert_tiles(cells: DataFrame, path: str, *tile: str) -> None:
    """Replaces the tiles (partitions) that ``cells`` has; other tiles stay."""
    cells.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*tile).parquet(path)


def with_band_names(cube: DataFrame, names: list[str]) -> DataFrame:
    """Band names as metadata of the band column."""
    return cube.withMetadata("band", {"names": names})


def nodata_value(dtype: str) -> float | int:
    """Value that stands for null in files: NaN for floats, the least of other kinds."""
    kind = np.dtype(dtype)
    return float("nan") if kind.kind == "f" else int(np.iinfo(kind).min)


def with_nodata(value: Column, dtype: str) -> Column:
    """Null as the kind's nodata value, for the format's edge."""
    return F.coalesce(value, F.lit(nodata_value(dtype)))


def with_coordinates(stack: DataFrame, grid: Grid) -> DataFrame:
    """Adds lat and lon of the pixel centres, as in a netCDF cube."""
    return stack.withColumns({"lat": grid.y(F.col("row")), "lon": grid.x(F.col("col"))})


def encoded_days(date: Column, since: str = "2000-01-01") -> Column:
    """Days since an epoch, as times are kept in cubes."""
    return F.datediff(date, F.lit(since).cast("date"))


def with_dtype(rows: DataFrame, dtype: str, value: str = "value") -> DataFrame:
    """Values of a dataset's kind; rows that have it already stay as they are."""
    kind = {"float32": "float", "float64": "double", "int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint", "uint8": "smallint", "uint16": "int", "uint32": "bigint"}[np.dtype(dtype).name]
    return rows if dict(rows.dtypes)[value] == kind else rows.withColumn(value, F.col(value).cast(kind))


def cube_bytes(cube: DataFrame, grid: Grid, bands: int, order: str = "BSQ", dtype: str = "float32", *keys: str) -> DataFrame:
    """(keys, content): binary cubes, a row each.

    A task fills a line of a band, and a second step puts the lines in their places, so what meets in one task is a cube's bytes and not its cells.
    """
    fill, kind = nodata_value(dtype), np.dtype(dtype)
    placed = cube.select(*keys, F.col("band").cast("int").alias("_b"), F.col("row").cast("int").alias("_r"), F.col("col").cast("int").alias("_c"), F.col("value").cast("double").alias("_v"))
    kinds = dict(cube.dtypes)

    def line(table: pa.Table) -> pa.Table:
        out = np.full(grid.width, fill, kind)
        v = table["_v"].to_numpy()
        fine = ~np.isnan(v)
        out[table["_c"].to_numpy()[fine]] = v[fine].astype(kind)
        return pa.table({**{k: table[k].slice(0, 1) for k in (*keys, "_b", "_r")}, "_line": pa.array([out.tobytes()], pa.binary())})

    def whole(table: pa.Table) -> pa.Table:
        shape = {"b": bands, "r": grid.height, "c": grid.width}
        out = np.full([shape[a] for a in "brc"], fill, kind)
        for b, r, data in zip(table["_b"].to_pylist(), table["_r"].to_pylist(), table["_line"].to_pylist(), strict=True):
            out[b - 1, r] = np.frombuffer(data, kind)
        axes = {"BSQ": (0, 1, 2), "BIL": (1, 0, 2), "BIP": (1, 2, 0)}[order]
        return pa.table({**{k: table[k].slice(0, 1) for k in keys}, "content": pa.array([out.transpose(axes).tobytes()], pa.binary())})

    if not keys:
        placed, keys, kinds = placed.withColumn("_one", F.lit(0)), ("_one",), {"_one": "int"}
    heads = [f"`{k}` {kinds[k]}" for k in keys]
    lines = placed.groupBy(*keys, "_b", "_r").applyInArrow(line, ", ".join([*heads, "_b int, _r int, _line binary"]))
    return lines.groupBy(*keys).applyInArrow(whole, ", ".join([*heads, "content binary"]))


def ring_wkt(rings: Column) -> Column:
    """Well-known text of a polygon."""
    text = F.transform(rings, lambda r: F.concat(F.lit("("), F.array_join(F.transform(r, lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))), ", "), F.lit(")")))
    return F.concat(F.lit("POLYGON ("), F.array_join(text, ", "), F.lit(")"))


def point_wkt(x: Column, y: Column) -> Column:
    return F.concat(F.lit("POINT ("), x.cast("string"), F.lit(" "), y.cast("string"), F.lit(")"))


def box_wkt(left: Column, bottom: Column, right: Column, top: Column) -> Column:
    l, b, r, t = (c.cast("string") for c in (left, bottom, right, top))
    return F.concat(F.lit("POLYGON (("), F.concat_ws(", ", *(F.concat_ws(" ", x, y) for x, y in ((l, b), (r, b), (r, t), (l, t), (l, b)))), F.lit("))"))


def png(rgba: np.ndarray) -> bytes:
    """PNG of a (rows, cols, 4) uint8 array."""
    rows, cols, _ = rgba.shape

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    raw = b"".join(b"\0" + rgba[r].tobytes() for r in range(rows))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", cols, rows, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def colours(array: np.ndarray, low: float, high: float) -> np.ndarray:
    """Blue to white to red; missing values are transparent."""
    t = np.clip((array - low) / (high - low), 0, 1)
    t = np.nan_to_num(t)
    rgb = np.stack([np.minimum(2 * t, 1), 1 - np.abs(2 * t - 1), np.minimum(2 - 2 * t, 1)], -1)
    return np.dstack([np.rint(rgb * 255), np.where(np.isnan(array), 0, 255)]).astype(np.uint8)


def write_kmz(array: np.ndarray, path: str, grid: Grid, name: str, low: float, high: float) -> None:
    """Overlay of one bounded array on a grid in degrees, with a colour bar."""
    b = grid.bounds
    box = f"<north>{b.top}</north><south>{b.bottom}</south><east>{b.right}</east><west>{b.left}</west>"
    bar = colours(np.linspace(high, low, 128)[:, None].repeat(16, 1), low, high)
    screen = "<ScreenOverlay><name>scale</name><Icon><href>bar.png</href></Icon><overlayXY x='0' y='0' xunits='fraction' yunits='fraction'/><screenXY x='0.02' y='0.05' xunits='fraction' yunits='fraction'/></ScreenOverlay>"
    kml = f"<?xml version='1.0' encoding='UTF-8'?><kml xmlns='http://www.opengis.net/kml/2.2'><Document><name>{escape(name)}</name><GroundOverlay><Icon><href>overlay.png</href></Icon><LatLonBox>{box}</LatLonBox></GroundOverlay>{screen}</Document></kml>"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("doc.kml", kml)
        z.writestr("overlay.png", png(colours(array, low, high)))
        z.writestr("bar.png", png(bar))


def tile_array(cells: Iterator, height: int, width: int) -> np.ndarray:
    """A bounded tile's rows (row, col, value) as an array; missing cells are NaN."""
    out = np.full((height, width), np.nan)
    for r in cells:
        if r["value"] is not None:
            out[r["row"], r["col"]] = r["value"]
    return out


def baseline_plot_table(pairs: DataFrame, baselines: DataFrame) -> DataFrame:
    """(pair_id, x0, y0, x1, y1): the line of each pair in a baseline plot."""
    a = baselines.select(F.col("date").alias("primary"), F.col("value").alias("y0"))
    b = baselines.select(F.col("date").alias("secondary"), F.col("value").alias("y1"))
    return pairs.join(a, "primary").join(b, "secondary").select("pair_id", F.col("primary").alias("x0"), "y0", F.col("secondary").alias("x1"), "y1")


def baseline_plot_limits(baselines: DataFrame) -> DataFrame:
    """One row: limits of the plot's value axis, a third of a standard deviation beyond the data."""
    margin = F.coalesce(F.stddev_samp("value") / 3, F.lit(0.0))
    return baselines.agg((F.min("value") - margin).alias("low"), (F.max("value") + margin).alias("high"))
