"""Classic netCDF cubes from tables: a record a scene, slab by slab on executors."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import Grid
from ..sources.netcdf import KINDS
from .tables import nodata_value

_NUMBER = {v.lstrip(">"): k for k, v in KINDS.items()}


def _text(s: str) -> bytes:
    raw = s.encode()
    return struct.pack(">i", len(raw)) + raw + b"\0" * (-len(raw) % 4)


def _attributes(items: dict) -> bytes:
    if not items:
        return struct.pack(">ii", 0, 0)
    out = struct.pack(">ii", 12, len(items))
    for name, value in items.items():
        if isinstance(value, str):
            raw = value.encode()
            out += _text(name) + struct.pack(">ii", 2, len(raw)) + raw + b"\0" * (-len(raw) % 4)
        else:
            raw = np.atleast_1d(value)
            data = raw.astype(raw.dtype.newbyteorder(">")).tobytes()
            out += _text(name) + struct.pack(">ii", _NUMBER[raw.dtype.str[1:]], raw.size) + data + b"\0" * (-len(data) % 4)
    return out


def assemble(names: list[str], slabs: list[bytes], grid: Grid, variable: str, dtype: str, key: str, attributes: dict, fill: float) -> bytes:
    """A 64-bit-offset file: coordinates lat and lon, the scenes' names, and a record a scene."""
    kind = np.dtype(dtype)
    b = grid.bounds
    lat, lon = b.top - (np.arange(grid.height) + 0.5) * grid.yres, b.left + (np.arange(grid.width) + 0.5) * grid.xres
    width = max([1, *(len(n.encode()) for n in names)])
    fixed = [("lat", [1], 6, {"units": "degrees_north"}, lat.astype(">f8").tobytes()), ("lon", [2], 6, {"units": "degrees_east"}, lon.astype(">f8").tobytes())]
    if grid.crs:
        fixed.append(("spatial_ref", [], 4, {"crs_wkt": grid.crs, "GeoTransform": f"{grid.left} {grid.xres} 0 {grid.top} 0 {-grid.yres}"}, struct.pack(">i", 0)))
    fill_value = np.array([fill]).astype(kind)
    more = {"_FillValue": fill_value, **({"grid_mapping": "spatial_ref"} if grid.crs else {})}
    moving = [(key, [0, 3], 2, {}, [n.encode().ljust(width, b"\0") for n in names], width), (variable, [0, 1, 2], _NUMBER[kind.str[1:]], more, slabs, grid.height * grid.width * kind.itemsize)]
    dims = struct.pack(">ii", 10, 4) + b"".join(_text(n) + struct.pack(">i", size) for n, size in ((key, 0), ("lat", grid.height), ("lon", grid.width), ("name_width", width)))

    def head(places: list[int]) -> bytes:
        out = b"CDF\x02" + struct.pack(">i", len(names)) + dims + _attributes(attributes) + struct.pack(">ii", 11, len(fixed) + len(moving))
        sizes = [len(v[4]) for v in fixed] + [v[5] for v in moving]
        for (name, ids, number, own, *_), size, place in zip([*fixed, *moving], sizes, places, strict=True):
            out += _text(name) + struct.pack(f">i{len(ids)}i", len(ids), *ids) + _attributes(own) + struct.pack(">iiq", number, min(size + -size % 4, 2**31 - 4), place)
        return out

    at, places = len(head([0] * (len(fixed) + len(moving)))), []
    for size in [len(v[4]) for v in fixed] + [v[5] for v in moving]:
        places.append(at)
        at += size + -size % 4
    body = [v[4] + b"\0" * (-len(v[4]) % 4) for v in fixed]
    for k in range(len(names)):
        body += [v[4][k] + b"\0" * (-v[5] % 4) for v in moving]
    return b"".join([head(places), *body])


def netcdf_bytes(stack: DataFrame, grid: Grid, variable: str = "image", key: str = "pair_id", dtype: str = "float32", per_file: int = 64, **attributes) -> DataFrame:
    """(part, content): netCDF files of up to ``per_file`` scenes each, in the order of their names, from rows of key, row, col, value.

    A scene's slab is filled from its cells in one task; missing cells hold the kind's nodata value, which is the variable's _FillValue.
    """
    fill, kind = nodata_value(dtype), np.dtype(dtype)
    cells = stack.filter(F.col("row").between(0, grid.height - 1) & F.col("col").between(0, grid.width - 1))
    cells = cells.select(F.col(key).cast("string").alias("_key"), (F.col("row").cast("long") * grid.width + F.col("col")).alias("_at"), F.col("value").cast("double").alias("_v"))

    def slab(table: pa.Table) -> pa.Table:
        out = np.full(grid.height * grid.width, fill, kind)
        v = table["_v"].to_numpy()
        fine = ~np.isnan(v)
        out[table["_at"].to_numpy()[fine]] = v[fine].astype(kind)
        return pa.table({"_key": table["_key"].slice(0, 1), "_slab": pa.array([out.astype(kind.newbyteorder(">")).tobytes()], pa.binary())})

    names = sorted(r[0] for r in cells.select("_key").distinct().collect())  # a row a scene
    parts = stack.sparkSession.createDataFrame([(n, k // per_file) for k, n in enumerate(names)], "_key string, part int")

    def join(table: pa.Table) -> pa.Table:
        table = table.sort_by("_key")
        content = assemble(table["_key"].to_pylist(), table["_slab"].to_pylist(), grid, variable, dtype, key, attributes, fill)
        return pa.table({"part": table["part"].slice(0, 1), "content": pa.array([content], pa.binary())})

    slabs = cells.groupBy("_key").applyInArrow(slab, "_key string, _slab binary").join(F.broadcast(parts), "_key")
    return slabs.groupBy("part").applyInArrow(join, "part int, content binary")
