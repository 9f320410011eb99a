"""Readers of grids, cubes, points and polygons; each gives a table."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import Grid

#: Names under which coordinate columns are found, in any case.
X_NAMES = ("x", "xs", "lon", "longitude", "long", "longs", "longitudes", "lons", "lng", "easting")
Y_NAMES = ("y", "ys", "lat", "latitude", "lats", "latitudes", "northing")


def ascii_header(lines: DataFrame) -> DataFrame:
    """(path, width, height, left, top, xres, yres, nodata) of ESRI ASCII headers, given as rows of path and value (a line)."""
    word = F.split(F.trim("value"), "\\s+")
    fields = lines.select("path", F.lower(word[0]).alias("k"), F.expr("try_cast(split(trim(value), '\\\\s+')[1] as double)").alias("v")).filter("v is not null")
    wide = fields.groupBy("path").pivot("k", ["ncols", "nrows", "xllcorner", "yllcorner", "xllcenter", "yllcenter", "cellsize", "nodata_value"]).agg(F.first("v"))
    left = F.coalesce("xllcorner", F.col("xllcenter") - F.col("cellsize") / 2)
    bottom = F.coalesce("yllcorner", F.col("yllcenter") - F.col("cellsize") / 2)
    return wide.select("path", F.col("ncols").cast("int").alias("width"), F.col("nrows").cast("int").alias("height"), left.alias("left"), (bottom + F.col("nrows") * F.col("cellsize")).alias("top"), F.col("cellsize").alias("xres"), F.col("cellsize").alias("yres"), F.col("nodata_value").alias("nodata"))


def profile_json(grid: Grid) -> str:
    return json.dumps(grid.__dict__, sort_keys=True)


def profile_from_json(text: str) -> Grid:
    return Grid(**json.loads(text))


def coordinate_columns(columns: list[str], x: str | None = None, y: str | None = None) -> tuple[str, str]:
    """The x and y columns: as named, or the first with a usual name; an error without one."""

    def find(given: str | None, names: tuple[str, ...]) -> str:
        if given:
            return given
        for n in names:
            for c in columns:
                if c.lower() == n:
                    return c
        raise ValueError(f"none of {', '.join(names)} in {', '.join(columns)}")

    return find(x, X_NAMES), find(y, Y_NAMES)


def points_from_csv(spark: SparkSession, path: str, x: str | None = None, y: str | None = None) -> DataFrame:
    """(point_id, x, y) of a CSV file with a header; ids are by coordinates."""
    df = spark.read.csv(path, header=True, inferSchema=True)
    return points_from_table(df, x, y)


def points_from_table(df: DataFrame, x: str | None = None, y: str | None = None) -> DataFrame:
    a, b = coordinate_columns(df.columns, x, y)
    return df.select(F.xxhash64(F.col(a).cast("double"), F.col(b).cast("double")).alias("point_id"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y"))


_FEATURES = "features array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>"


def _features(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.explode(F.from_json("value", _FEATURES)["features"]).alias("f")).select("f.properties", "f.geometry.type", "f.geometry.coordinates")


def points_from_geojson(spark: SparkSession, path: str) -> DataFrame:
    xy = F.from_json("coordinates", "array<double>")
    df = _features(spark, path).filter("type = 'Point'").select(xy[0].alias("x"), xy[1].alias("y"))
    return points_from_table(df)


def polygons_from_geojson(spark: SparkSession, path: str, role: str = "type") -> DataFrame:
    """(poly_id, type, rings); the role is a property, desired where it is missing."""
    rings = F.from_json("coordinates", "array<array<array<double>>>")
    rings = F.transform(rings, lambda r: F.transform(r, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))
    df = _features(spark, path).filter("type = 'Polygon'").select(F.coalesce(F.col("properties")[role], F.lit("desired")).alias("type"), rings.alias("rings"))
    return df.select(F.xxhash64(F.to_json("rings")).alias("poly_id"), "type", "rings")


def cube_cells(files: DataFrame, grid: Grid, bands: int, order: str = "BSQ", dtype: str = "float32") -> DataFrame:
    """(path, band, row, col, value) of binary cubes, rows of path and content; nodata and NaN become null.

    The array is viewed, not copied, and goes out a band row at a time.
    """
    axes = {"BSQ": ("band", "row", "col"), "BIL": ("row", "band", "col"), "BIP": ("row", "col", "band")}[order]
    size = {"band": bands, "row": grid.height, "col": grid.width}
    nodata = grid.nodata

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                cube = np.frombuffer(content, dtype).reshape([size[a] for a in axes]).transpose([axes.index(a) for a in ("band", "row", "col")])
                for k in range(bands):
                    for r in range(size["row"]):
                        v = cube[k, r].astype(float)
                        gone = np.isnan(v) | (v == nodata if nodata is not None else False)
                        n = len(v)
                        yield pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array(np.full(n, k + 1, np.int32)), pa.array(np.full(n, r, np.int32)), pa.array(np.arange(n, dtype=np.int32)), pa.array(v, mask=gone)], names=["path", "band", "row", "col", "value"])

    return files.select("path", "content").mapInArrow(run, "path string, band int, row int, col int, value double")


def read_binary(spark: SparkSession, path: str, grid: Grid, bands: int, order: str = "BSQ", dtype: str = "float32") -> DataFrame:
    return cube_cells(spark.read.format("binaryFile").load(path), grid, bands, order, dtype)


def lattice_of(grid: Grid, row: str = "row", col: str = "col") -> tuple[Column, Column]:
    """Longitude (or x) and latitude (or y) of pixel centres."""
    return grid.x(F.col(col)), grid.y(F.col(row))


def dimension_select(table: DataFrame, **labels: object) -> DataFrame:
    """Cells of a cube by labels of its dimensions: a value, a list of values, or a (low, high) tuple, both included."""
    for dim, what in labels.items():
        c = F.col(dim)
        table = table.filter(c.between(*what) if isinstance(what, tuple) else c.isin(what) if isinstance(what, list) else c == F.lit(what))
    return table


_KEYS = frozenset("ncols nrows xllcorner yllcorner xllcenter yllcenter cellsize nodata_value".split())


def ascii_array(text: str) -> tuple[np.ndarray, float | None]:
    """The array of an ESRI ASCII raster and its nodata value; a ValueError unless all of it can be read."""
    head: dict[str, float] = {}
    lines = text.split("\n")
    at = 0
    while at < len(lines) and (words := lines[at].split()) and words[0].lower() in _KEYS:
        head[words[0].lower()] = float(words[1]) if len(words) == 2 else float("nan")
        at += 1
    shape = int(head.get("nrows", -1)), int(head.get("ncols", -1))
    values = np.array(" ".join(lines[at:]).split(), float)
    if min(shape) < 0 or values.size != shape[0] * shape[1]:
        raise ValueError("not a whole ASCII raster")
    return values.reshape(shape), head.get("nodata_value")


def ascii_cells(files: DataFrame) -> DataFrame:
    """(path, row, col, value) of ESRI ASCII rasters, rows of path and content; nodata is null.

    A file is read whole before any of its cells go out, a row at a time, so one that can't be read has no cells at all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                try:
                    array, nodata = ascii_array((content.as_py() or b"").decode())
                except (ValueError, IndexError, OverflowError):
                    continue
                for r, v in enumerate(array):
                    gone, n = np.isnan(v) | (v == nodata if nodata is not None else False), len(v)
                    yield pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array(np.full(n, r, np.int32)), pa.array(np.arange(n, dtype=np.int32)), pa.array(v, mask=gone)], names=["path", "row", "col", "value"])

    return files.select("path", "content").mapInArrow(run, "path string, row int, col int, value double")


def read_ascii(spark: SparkSession, path: str, pattern: str = "*.asc") -> DataFrame:
    """``ascii_cells`` of the files under a folder, of any store that Spark reads."""
    return ascii_cells(spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path))
