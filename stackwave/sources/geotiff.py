"""GeoTIFF rasters as tables: headers, cells and windows, decoded by executors.

Files come as rows of path and content (Spark's binaryFile reader, so from any store that Spark reads).  Classic TIFF and BigTIFF, either byte
order, strips or tiles, bands by pixel or by plane; uncompressed, deflate, LZW and PackBits, with the horizontal and the
floating-point predictor.  Only the blocks that meet the wanted window are decoded, and cells go out a block at a time.
A file that can't be parsed has valid = false among the headers and no cells.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import Box, Grid
from .catalog import ProductFormat, glob_expression

#: Sizes and codes of the TIFF field types.
_TYPES = {1: (1, "B"), 2: (1, "c"), 3: (2, "H"), 4: (4, "I"), 6: (1, "b"), 8: (2, "h"), 9: (4, "i"), 11: (4, "f"), 12: (8, "d"), 13: (4, "I"), 16: (8, "Q"), 17: (8, "q")}
#: Tags that are read.
WIDTH, HEIGHT, BITS, COMPRESSION, STRIP_OFFSETS, BANDS, STRIP_ROWS, STRIP_SIZES, PLANES, PREDICTOR = 256, 257, 258, 259, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_SIZES, SAMPLE_KIND, SCALE, TIE, MATRIX, GEO_KEYS, NODATA = 322, 323, 324, 325, 339, 33550, 33922, 34264, 34735, 42113
_PROJECTED, _GEOGRAPHIC = 3072, 2048


@dataclass(frozen=True)
class Header:
    grid: Grid
    bands: int
    dtype: str
    order: str
    compression: int
    predictor: int
    planar: bool
    block_height: int
    block_width: int
    offsets: tuple[int, ...]
    sizes: tuple[int, ...]

    @property
    def across(self) -> int:
        return -(-self.grid.width // self.block_width)

    @property
    def down(self) -> int:
        return -(-self.grid.height // self.block_height)


def header(content: bytes) -> Header:
    """The first image of a file; a ValueError when it isn't a raster that can be read."""
    try:
        return _header(content)
    except (struct.error, IndexError, KeyError, UnicodeDecodeError) as e:
        raise ValueError(f"not a readable TIFF: {e}") from e


def _tags(content: bytes, order: str) -> dict[int, tuple]:
    magic = struct.unpack(f"{order}H", content[2:4])[0]
    if magic not in (42, 43):
        raise ValueError("not a TIFF")
    big = magic == 43
    start = struct.unpack(f"{order}Q", content[8:16])[0] if big else struct.unpack(f"{order}I", content[4:8])[0]
    count, at = (struct.unpack(f"{order}Q", content[start : start + 8])[0], start + 8) if big else (struct.unpack(f"{order}H", content[start : start + 2])[0], start + 2)
    size, inline, word = (20, 8, "Q") if big else (12, 4, "I")
    out = {}
    for k in range(count):
        entry = content[at + k * size : at + (k + 1) * size]
        tag, kind, n = struct.unpack(f"{order}HH{word}", entry[: 4 + inline])
        if kind not in _TYPES:
            continue
        width, code = _TYPES[kind]
        raw = entry[4 + inline :]
        if n * width > inline:
            place = struct.unpack(f"{order}{word}", raw)[0]
            raw = content[place : place + n * width]
        out[tag] = (raw[:n],) if code == "c" else struct.unpack(f"{order}{n}{code}", raw[: n * width])
    return out


def _header(content: bytes) -> Header:
    order = {b"II": "<", b"MM": ">"}.get(content[:2])
    if order is None:
        raise ValueError("not a TIFF")
    tags = _tags(content, order)
    width, height, bands = tags[WIDTH][0], tags[HEIGHT][0], tags.get(BANDS, (1,))[0]
    bits, kind = set(tags.get(BITS, (1,))), set(tags.get(SAMPLE_KIND, (1,)))
    if len(bits) != 1 or len(kind) != 1 or bits == {1}:
        raise ValueError("bands of one kind of whole bytes only")
    dtype = {1: "u", 2: "i", 3: "f"}[kind.pop()] + str(bits.pop() // 8)
    left, top, xres, yres = 0.0, float(height), 1.0, 1.0
    if SCALE in tags and TIE in tags:
        xres, yres = tags[SCALE][:2]
        col, row, _, x, y, _ = tags[TIE][:6]
        left, top = x - col * xres, y + row * yres
    elif MATRIX in tags:
        m = tags[MATRIX]
        left, top, xres, yres = m[3], m[7], m[0], -m[5]
    keys = tags.get(GEO_KEYS, ())
    geo = {keys[k]: keys[k + 3] for k in range(4, len(keys) - 3, 4)}
    if geo.get(1025) == 2:  # the tie point is a pixel's centre
        left, top = left - xres / 2, top + yres / 2
    code = next((geo[k] for k in (_PROJECTED, _GEOGRAPHIC) if 0 < geo.get(k, 0) < 32767), None)
    nodata = tags[NODATA][0].split(b"\0")[0].decode().strip() if NODATA in tags else ""
    grid = Grid(width, height, left, top, xres, yres, f"EPSG:{code}" if code else None, float(nodata) if nodata else None)
    tiled = TILE_OFFSETS in tags
    block = (tags[TILE_HEIGHT][0], tags[TILE_WIDTH][0]) if tiled else (min(tags.get(STRIP_ROWS, (height,))[0], height), width)
    offsets, sizes = (tags[TILE_OFFSETS], tags[TILE_SIZES]) if tiled else (tags[STRIP_OFFSETS], tags[STRIP_SIZES])
    return Header(grid, bands, dtype, order, tags.get(COMPRESSION, (1,))[0], tags.get(PREDICTOR, (1,))[0], tags.get(PLANES, (1,))[0] == 2, *block, offsets, sizes)


def _lzw(data: bytes) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits, the widest first bit."""
    out, table, previous = bytearray(), [], b""
    held, bits, width, at = 0, 0, 9, 0
    single = [bytes((k,)) for k in range(256)]
    while True:
        while bits < width:
            if at >= len(data):
                return bytes(out)
            held, bits, at = held << 8 | data[at], bits + 8, at + 1
        bits -= width
        code = held >> bits & (1 << width) - 1
        held &= (1 << bits) - 1
        if code == 257:
            return bytes(out)
        if code == 256:
            table, previous, width = [*single, b"", b""], b"", 9
            continue
        if not table:
            table = [*single, b"", b""]
        if code > len(table):
            raise ValueError("broken LZW data")
        entry = table[code] if code < len(table) else previous + previous[:1]
        out += entry
        if previous:
            table.append(previous + entry[:1])
        previous = entry
        size = len(table) + 1
        width = 12 if size >= 2048 else 11 if size >= 1024 else 10 if size >= 512 else 9


def _packbits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        else:
            if n > 128:
                out += data[at + 1 : at + 2] * (257 - n)
            at += 2 if n > 128 else 1
    return bytes(out)


def block(content: bytes, head: Header, number: int) -> np.ndarray:
    """A block's samples as (rows, columns, bands of the block), its full size (a last strip: the rows that are there)."""
    rows, cols = head.block_height, head.block_width
    per_plane = head.across * head.down
    if cols == head.grid.width:
        rows = min(rows, head.grid.height - number % per_plane * rows)
    bands = 1 if head.planar else head.bands
    raw = content[head.offsets[number] : head.offsets[number] + head.sizes[number]]
    if head.compression in (8, 32946):
        raw = zlib.decompress(raw)
    elif head.compression == 5:
        raw = _lzw(raw)
    elif head.compression == 32773:
        raw = _packbits(raw)
    elif head.compression != 1:
        raise ValueError(f"no decoder for compression {head.compression}")
    kind = np.dtype(head.order + head.dtype)
    if head.predictor == 3:  # differences of bytes, the planes of bytes of a row one after the other, the highest first
        planes = np.cumsum(np.frombuffer(raw, np.uint8)[: rows * cols * bands * kind.itemsize].reshape(rows, -1), axis=1, dtype=np.uint8)
        return np.ascontiguousarray(planes.reshape(rows, kind.itemsize, cols * bands).transpose(0, 2, 1)).view(f">{head.dtype}").reshape(rows, cols, bands)
    out = np.frombuffer(raw, kind, rows * cols * bands).reshape(rows, cols, bands)
    return np.cumsum(out, axis=1, dtype=kind.newbyteorder("=")) if head.predictor == 2 else out


def blocks(content: bytes, head: Header, window: Box | None = None) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(band, first row, first column, samples) of the blocks that meet the window, cut to the image and the window."""
    grid = head.grid
    r0, c0, r1, c1 = 0, 0, grid.height, grid.width
    if window is not None:
        row, col, height, width = grid.window(window)
        r0, c0, r1, c1 = max(row, 0), max(col, 0), min(row + height, grid.height), min(col + width, grid.width)
    for plane in range(head.bands if head.planar else 1):
        for by in range(r0 // head.block_height, -(-r1 // head.block_height)):
            for bx in range(c0 // head.block_width, -(-c1 // head.block_width)):
                data = block(content, head, plane * head.across * head.down + by * head.across + bx)
                top, left = by * head.block_height, bx * head.block_width
                a, e, b, f = max(r0, top), min(r1, top + len(data)), max(c0, left), min(c1, left + head.block_width)
                if a < e and b < f:
                    part = data[a - top : e - top, b - left : f - left]
                    for k in range(part.shape[2]):
                        yield plane + k + 1, a, b, part[:, :, k]


_HEADER = "path string, valid boolean, width int, height int, bands int, dtype string, left double, top double, xres double, yres double, crs string, nodata double"


def headers(files: DataFrame) -> DataFrame:
    """(path, valid, width, height, bands, dtype, left, top, xres, yres, crs, nodata) of files (path, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                try:
                    h = header(content.as_py() or b"")
                    g = h.grid
                    rows.append((path, True, g.width, g.height, h.bands, np.dtype(h.dtype).name, g.left, g.top, g.xres, g.yres, g.crs, g.nodata))
                except ValueError:
                    rows.append((path, False, *[None] * 10))
            names = [c.split()[0] for c in _HEADER.split(", ")]
            kinds = {"string": pa.string(), "boolean": pa.bool_(), "int": pa.int32(), "double": pa.float64()}
            yield pa.RecordBatch.from_arrays([pa.array(x, kinds[c.split()[1]]) for x, c in zip(zip(*rows, strict=True), _HEADER.split(", "), strict=True)] if rows else [pa.array([], kinds[c.split()[1]]) for c in _HEADER.split(", ")], names=names)

    return files.select("path", "content").mapInArrow(run, _HEADER)


def cells(files: DataFrame, window: Box | None = None) -> DataFrame:
    """(path, band, row, col, value) of files (path, content), of a window in the files' own system; nodata and NaN are null.

    Rows and columns count from the window's corner, as far as the window reaches into the grid.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                raw = content.as_py() or b""
                try:
                    head = header(raw)
                except ValueError:
                    continue
                row, col = head.grid.window(window)[:2] if window is not None else (0, 0)
                for band, top, left, part in blocks(raw, head, window):
                    v = part.astype(float).reshape(-1)
                    gone = np.isnan(v) | (v == head.grid.nodata if head.grid.nodata is not None else False)
                    n, (h, w) = len(v), part.shape
                    rows = np.repeat(np.arange(top - max(row, 0), top - max(row, 0) + h, dtype=np.int32), w)
                    cols = np.tile(np.arange(left - max(col, 0), left - max(col, 0) + w, dtype=np.int32), h)
                    yield pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array(np.full(n, band, np.int32)), pa.array(rows), pa.array(cols), pa.array(v, mask=gone)], names=["path", "band", "row", "col", "value"])

    return files.select("path", "content").mapInArrow(run, "path string, band int, row int, col int, value double")


def files(spark: SparkSession, root: str, pattern: str = "*.tif") -> DataFrame:
    """(path, content) of the files under a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select("path", "content")


def grid_of(row) -> Grid:
    """The grid of a row of ``headers``."""
    return Grid(row["width"], row["height"], row["left"], row["top"], row["xres"], row["yres"], row["crs"], row["nodata"])


def warped(some: DataFrame, target: Grid, method: str = "nearest") -> DataFrame:
    """(path, band, row, col, value) of files on one grid, whatever their own grids and systems are; null outside a file."""
    from ..operators.raster import regrid

    found = headers(some).filter("valid").drop("valid", "dtype", "bands")
    kinds = found.drop("path").distinct().collect()  # a row a grid; files of a product share one
    out = None
    for r in kinds:
        same = found.filter(" and ".join(f"{c} <=> {v!r}" if not isinstance(v, str) else f"{c} = '{v}'" for c, v in r.asDict().items() if v is not None and v == v) or "true").select("path")
        own, grid = cells(some.join(same, "path", "left_semi")), grid_of(r)
        part = own if grid == target else regrid(own, grid, target, method, "path", "band")
        out = part if out is None else out.unionByName(part)
    return cells(some.limit(0)) if out is None else out


def mask(some: DataFrame, grid: Grid, window: Box | None = None) -> DataFrame:
    """(row, col, valid) of a mask file, not 0 where valid, which must have the grid's size; of a window, from its corner."""
    found = headers(some).select("valid", "width", "height").collect()  # one file
    if len(found) != 1 or (found[0]["width"], found[0]["height"]) != (grid.width, grid.height):
        raise ValueError(f"the mask doesn't have the size {grid.width} by {grid.height} of the dataset")
    return cells(some, window).filter("band = 1").select("row", "col", F.coalesce(F.col("value") != 0, F.lit(False)).alias("valid"))


def region(some: DataFrame, roi: Box | None = None) -> Box:
    """The region of interest of a dataset (``headers``): as given, or the hull of its readable files."""
    if roi is not None:
        return roi
    right, bottom = F.col("left") + F.col("width") * F.col("xres"), F.col("top") - F.col("height") * F.col("yres")
    r = some.filter("valid").agg(F.min("left"), F.min(bottom), F.max(right), F.max("top")).first()
    if r[0] is None:
        raise ValueError("no readable file")
    return Box(*r)


def interferograms(some: DataFrame, layout: ProductFormat, window: Box | None = None, keep_common: bool = True) -> DataFrame:
    """(pair_id, row, col, phase, coh) of the pairs whose phase and coherence files are both there and readable.

    The product's layout tells by name which of the files (path, content) hold phase or coherence, and of which pair.  Names are collected, a row a
    file; ``some`` is read three times, so it should be persisted where it isn't files.
    """
    from ..operators.raster import match_scenes

    found = [(r[0], r[1]) for r in headers(some).select("path", "valid").collect()]  # a row a file of the dataset
    valid = some.sparkSession.createDataFrame(found, "path string, valid boolean")

    def scenes(pattern: str) -> DataFrame:
        own = valid.select("path").filter(glob_expression(F.col("path"), pattern))
        return layout.pairs(own).select("pair_id", "path").join(valid, "path")

    both = match_scenes(scenes(layout.phase), scenes(layout.coherence), keep_common)

    def values(path: str, name: str) -> DataFrame:
        pair = F.broadcast(both.select(F.col("pair_id").alias("_pair"), F.col(path).alias("path")))
        own = some.select("path", "content").join(pair, "path").select(F.col("_pair").alias("path"), "content")
        return cells(own, window).filter("band = 1").select(F.col("path").alias("pair_id"), "row", "col", F.col("value").alias(name))

    # Spark takes cells to be as small as the files they come from, and would broadcast them
    return values("path_unw", "phase").hint("merge").join(values("path_coh", "coh"), ["pair_id", "row", "col"])
