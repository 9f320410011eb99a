"""GeoTIFF files from tables, tile by tile on executors.

Cells are dealt out by scene and tile; a task fills and compresses its tiles, and a second step puts the tiles of a scene behind
one header.  So no task holds more than a tile's cells, or a scene's compressed tiles.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import Grid
from ..sources import geotiff as T
from .tables import nodata_value

TILE = 256


def _fields(grid: Grid, bands: int, kind: np.dtype, nodata: float, names: tuple[str, ...]) -> list[tuple[int, int, int, bytes]]:
    """Entries of the directory but the tiles' places: tag, type, count, data."""

    def field(tag: int, code: int, *values) -> tuple[int, int, int, bytes]:
        return tag, code, len(values), struct.pack(f"<{len(values)}{T._TYPES[code][1]}", *values)

    text = "nan" if nodata != nodata else repr(int(nodata) if kind.kind in "iu" else float(nodata))
    entries = [
        field(T.WIDTH, 4, grid.width), field(T.HEIGHT, 4, grid.height), field(T.BITS, 3, *[kind.itemsize * 8] * bands), field(T.COMPRESSION, 3, 8), field(262, 3, 1),
        field(T.BANDS, 3, bands), field(T.PLANES, 3, 2), field(T.TILE_WIDTH, 4, TILE), field(T.TILE_HEIGHT, 4, TILE), field(T.SAMPLE_KIND, 3, *[{"u": 1, "i": 2, "f": 3}[kind.kind]] * bands),
        field(T.SCALE, 12, grid.xres, grid.yres, 0.0), field(T.TIE, 12, 0.0, 0.0, 0.0, grid.left, grid.top, 0.0), (T.NODATA, 2, len(text) + 1, text.encode() + b"\0"),
    ]
    if bands > 1:
        entries.append(field(338, 3, *[0] * (bands - 1)))
    if grid.crs:
        code = int(grid.crs.rpartition(":")[2])
        geographic = 4000 <= code < 5000
        entries.append(field(T.GEO_KEYS, 3, 1, 1, 0, 3, 1024, 0, 1, 2 if geographic else 1, 1025, 0, 1, 1, T._GEOGRAPHIC if geographic else T._PROJECTED, 0, 1, code))
    if names:
        xml = "<GDALMetadata>" + "".join(f'<Item name="DESCRIPTION" sample="{k}" role="description">{n}</Item>' for k, n in enumerate(names)) + "</GDALMetadata>\0"
        entries.append((42112, 2, len(xml.encode()), xml.encode()))
    return entries


def assemble(tiles: list[bytes], grid: Grid, bands: int, dtype: str, nodata: float, names: tuple[str, ...] = ()) -> bytes:
    """A BigTIFF of deflated tiles, which come by band, tile row and tile column."""
    entries = _fields(grid, bands, np.dtype(dtype), nodata, names)
    sizes = [len(t) for t in tiles]
    n = len(entries) + 2
    body_at = 16 + 8 + 20 * n + 8
    entries += [(T.TILE_OFFSETS, 16, len(tiles), b"\0" * 8 * len(tiles)), (T.TILE_SIZES, 16, len(tiles), struct.pack(f"<{len(tiles)}Q", *sizes))]
    extra = sum(len(e[3]) + len(e[3]) % 2 for e in entries if len(e[3]) > 8)
    places = np.cumsum([0, *sizes[:-1]], dtype=np.uint64) + np.uint64(body_at + extra)
    table, body = b"", b""
    for tag, code, count, data in sorted(entries):
        if tag == T.TILE_OFFSETS:
            data = places.astype("<u8").tobytes()
        if len(data) <= 8:
            value = data.ljust(8, b"\0")
        else:
            value = struct.pack("<Q", body_at + len(body))
            body += data + b"\0" * (len(data) % 2)
        table += struct.pack("<HHQ", tag, code, count) + value
    return b"".join([b"II+\0" + struct.pack("<HHQ", 8, 0, 16) + struct.pack("<Q", n) + table + b"\0" * 8 + body, *tiles])


def tiff_bytes(stack: DataFrame, grid: Grid, *keys: str, bands: int = 1, dtype: str = "float32", nodata: float | None = None, names: tuple[str, ...] = ()) -> DataFrame:
    """(keys, content): a GeoTIFF for each value of the keys, from rows of keys, band (or 1), row, col, value; missing cells hold nodata."""
    fill, kind = nodata_value(dtype) if nodata is None else nodata, np.dtype(dtype)
    across, down = -(-grid.width // TILE), -(-grid.height // TILE)
    kinds = dict(stack.dtypes)
    band = F.col("band").cast("int") if "band" in stack.columns else F.lit(1)
    cells = stack.filter(F.col("row").between(0, grid.height - 1) & F.col("col").between(0, grid.width - 1))
    tile = (F.floor(F.col("row") / TILE) * across + F.floor(F.col("col") / TILE)).cast("int")
    cells = cells.select(*keys, ((band - 1) * across * down + tile).alias("_tile"), (F.col("row") % TILE * TILE + F.col("col") % TILE).cast("int").alias("_at"), F.col("value").cast("double").alias("_v"))

    def pack(table: pa.Table) -> pa.Table:
        out = np.full(TILE * TILE, fill, kind)
        v = table["_v"].to_numpy()
        fine = ~np.isnan(v)
        out[table["_at"].to_numpy()[fine]] = v[fine].astype(kind)
        return pa.table({**{k: table[k].slice(0, 1) for k in keys}, "_tile": table["_tile"].slice(0, 1), "_data": pa.array([zlib.compress(out.tobytes(), 6)], pa.binary())})

    heads = [f"`{k}` {kinds[k]}" for k in keys]
    tiles = cells.groupBy(*keys, "_tile").applyInArrow(pack, ", ".join([*heads, "_tile int", "_data binary"]))
    empty = zlib.compress(np.full(TILE * TILE, fill, kind).tobytes(), 6)

    def join(table: pa.Table) -> pa.Table:
        have = dict(zip(table["_tile"].to_pylist(), table["_data"].to_pylist(), strict=True))
        content = assemble([have.get(k, empty) for k in range(bands * across * down)], grid, bands, dtype, fill, names)
        return pa.table({**{k: table[k].slice(0, 1) for k in keys}, "content": pa.array([content], pa.binary())})

    return (tiles.groupBy(*keys) if keys else tiles.withColumn("_one", F.lit(0)).groupBy("_one")).applyInArrow(join, ", ".join([*heads, "content binary"]))


def write_files(files: DataFrame, folder: str, name: str = "name") -> DataFrame:
    """Writes rows of name and content as files of a folder, from the executors; gives (path, size) when it is run.

    The folder is a path or an address that pyarrow knows (file, hdfs, s3, gs).  A file is written under another name first, so a task that runs
    again leaves whole files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        system.create_dir(root, recursive=True)
        for b in batches:
            paths, sizes = [], []
            for n, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                data = content.as_py()
                with system.open_output_stream(f"{root}/.{n}.part") as out:
                    out.write(data)
                system.move(f"{root}/.{n}.part", f"{root}/{n}")
                paths.append(f"{folder}/{n}")
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], names=["path", "size"])

    return files.select(F.col(name).cast("string"), "content").mapInArrow(run, "path string, size long")


def write_tiffs(stack: DataFrame, folder: str, grid: Grid, key: str = "pair_id", suffix: str = ".tif", **more) -> int:
    """A GeoTIFF a scene, named by its key; gives the number of files."""
    files = tiff_bytes(stack, grid, key, **more)
    return write_files(files.select(F.concat(F.col(key).cast("string"), F.lit(suffix)).alias("name"), "content"), folder).count()
