"""Points and polygons of shapefiles (.shp, with attributes of the .dbf beside it) as tables.

Files come as rows of path and content.  Records of null shapes, and files that can't be parsed, have no rows.  Rings keep their order in the file; by
the even-odd rule of ``spatial.point_in_rings`` inner rings are holes.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Shape types (plain, with z, with m).
POINT, POLYGON, MULTIPOINT = (1, 11, 21), (5, 15, 25), (8, 18, 28)


def shapes(content: bytes) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(record number from 0, rings or points as (n, 2) arrays) of a .shp file."""
    if len(content) < 100 or struct.unpack(">i", content[:4])[0] != 9994:
        raise ValueError("not a shapefile")
    at, number = 100, 0
    while at + 12 <= len(content):
        size = 2 * struct.unpack(">i", content[at + 4 : at + 8])[0]
        body = content[at + 8 : at + 8 + size]
        kind = struct.unpack("<i", body[:4])[0]
        if kind in POINT:
            yield number, [np.frombuffer(body, "<f8", 2, 4).reshape(1, 2)]
        elif kind in MULTIPOINT:
            yield number, [np.frombuffer(body, "<f8", 2 * struct.unpack("<i", body[36:40])[0], 40).reshape(-1, 2)]
        elif kind in POLYGON:
            parts, points = struct.unpack("<ii", body[36:44])
            starts = np.append(np.frombuffer(body, "<i4", parts, 44), points)
            xy = np.frombuffer(body, "<f8", 2 * points, 44 + 4 * parts).reshape(-1, 2)
            yield number, [xy[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)]
        at, number = at + 8 + size, number + 1


def attributes(content: bytes) -> list[dict[str, str]]:
    """The rows of a .dbf file, as texts."""
    if len(content) < 32:
        return []
    count, head, size = struct.unpack("<IHH", content[4:12])
    fields, at = [], 32
    while at < head - 1 and content[at] != 13:
        fields.append((content[at : at + 11].split(b"\0")[0].decode("latin-1"), content[at + 16]))
        at += 32
    out = []
    for k in range(count):
        row, place = {}, head + k * size + 1
        for name, width in fields:
            row[name] = content[place : place + width].decode("utf-8", "replace").strip()
            place += width
        out.append(row)
    return out


def _table(files: DataFrame) -> DataFrame:
    """(path, record, properties, rings) of files (path, content): .shp files with the .dbf of the same name."""
    stem, end = F.regexp_replace("path", r"\.[^.]*$", ""), F.lower(F.regexp_extract("path", r"\.([^.]*)$", 1))
    both = files.groupBy(stem.alias("path")).agg(*(F.max(F.when(end == k, F.col("content"))).alias(k) for k in ("shp", "dbf"))).filter("shp is not null")
    ring = pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, shp, dbf in zip(b.column("path").to_pylist(), b.column("shp"), b.column("dbf"), strict=True):
                rows = attributes(dbf.as_py() or b"")
                try:
                    found = list(shapes(shp.as_py()))
                except (ValueError, struct.error):
                    continue
                yield pa.RecordBatch.from_arrays([
                    pa.array([path] * len(found), pa.string()), pa.array([k for k, _ in found], pa.int64()), pa.array([list(rows[k].items()) if k < len(rows) else [] for k, _ in found], pa.map_(pa.string(), pa.string())),
                    pa.array([[[{"x": x, "y": y} for x, y in r.tolist()] for r in rings] for _, rings in found], ring),
                ], names=["path", "record", "properties", "rings"])

    return both.mapInArrow(run, "path string, record long, properties map<string,string>, rings array<array<struct<x:double,y:double>>>")


def points(files: DataFrame) -> DataFrame:
    """(point_id, x, y) of point and multipoint files; ids are by coordinates."""
    rows = _table(files).select(F.explode(F.flatten("rings")).alias("p")).select("p.x", "p.y")
    return rows.select(F.xxhash64("x", "y").alias("point_id"), "x", "y")


def polygons(files: DataFrame, role: str = "type") -> DataFrame:
    """(poly_id, type, rings) of polygon files; the role is an attribute, desired where it is missing."""
    kind = F.coalesce(F.element_at(F.col("properties"), role), F.lit("desired"))
    return _table(files).select(F.xxhash64(F.to_json("rings")).alias("poly_id"), kind.alias("type"), "rings")


def files(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of the .shp and .dbf files under a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{shp,SHP,dbf,DBF}").load(root).select("path", "content")
