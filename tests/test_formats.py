"""GeoTIFF, netCDF and shapefiles: files made here and read back, and bytes made by hand."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stackwave import interop as I
from stackwave.functions.geo import Box, Grid
from stackwave.operators import raster as R
from stackwave.plans import uncertainty as U
from stackwave.sinks import geotiff as W
from stackwave.sinks import netcdf as N
from stackwave.sources import catalog as S
from stackwave.sources import geotiff as T
from stackwave.sources import netcdf as C
from stackwave.sources import shapefile as H

GRID = Grid(300, 270, 100.0, 50.0, 0.5, 0.25, "EPSG:32646", -9999.0)


def stack(spark, grid=GRID):
    """Two scenes with holes over the whole grid."""
    rows = R.grid_pixels(spark.range(1), grid)
    value = F.when((F.col("row") + F.col("col")) % 7 != 0, (F.col("row") * 1000 + F.col("col")).cast("double"))
    return rows.select(F.explode(F.array(F.lit("a"), F.lit("b"))).alias("pair_id"), "row", "col", value.alias("value")).withColumn("value", F.when(F.col("pair_id") == "a", F.col("value")).otherwise(-F.col("value")))


def written(spark, content, path="f"):
    return spark.createDataFrame([(path, bytearray(content))], "path string, content binary")


def test_tiffs_come_back_from_a_folder(spark, tmp_path):
    rows = stack(spark)
    assert W.write_tiffs(rows, str(tmp_path / "out"), GRID, nodata=-9999.0) == 2
    files = T.files(spark, str(tmp_path / "out"))
    heads = T.headers(files).orderBy("path").collect()
    assert [(h["valid"], h["crs"], h["nodata"], h["dtype"], T.grid_of(h)) for h in heads] == [(True, "EPSG:32646", -9999.0, "float32", GRID)] * 2
    got = T.cells(files).select(F.regexp_extract("path", r"(\w)\.tif", 1).alias("pair_id"), "row", "col", "value")
    assert got.count() == 2 * 300 * 270 and got.exceptAll(rows).count() == 0
    box = Box(110.0, 10.0, 130.0, 20.0)
    row, col, height, width = GRID.window(box)
    want = rows.filter(F.col("row").between(row, row + height - 1) & F.col("col").between(col, col + width - 1)).select("pair_id", F.col("row") - row, F.col("col") - col, "value")
    part = T.cells(files, box).select(F.regexp_extract("path", r"(\w)\.tif", 1), "row", "col", "value")
    assert part.count() == 2 * height * width and part.exceptAll(want).count() == 0


@pytest.mark.parametrize("dtype", ["int16", "uint8", "float64"])
def test_tiffs_of_several_bands_and_kinds(spark, dtype):
    grid = Grid(20, 30, 0.0, 30.0, 1.0, 1.0, "EPSG:4326")
    rows = R.grid_pixels(spark.range(1), grid).select(F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("band"), "row", "col").withColumn("value", (F.col("band") * 7 + F.col("row") + F.col("col")).cast("double"))
    files = W.tiff_bytes(rows, grid, bands=3, dtype=dtype, nodata=0, names=("x", "y", "z")).select(F.lit("f").alias("path"), "content")
    assert T.cells(files).drop("path").exceptAll(rows.select("band", "row", "col", "value")).count() == 0
    assert T.headers(files).first()["bands"] == 3


def classic(array, order="<", compression=1, predictor=1, rows_per_strip=None, planar=False, area=True):
    """A classic TIFF of strips, made here."""
    array = np.atleast_3d(array)
    height, width, bands = array.shape
    rows_per_strip = rows_per_strip or height
    kind = array.dtype.newbyteorder(order)
    strips = []
    for plane in [array[:, :, k : k + 1] for k in range(bands)] if planar else [array]:
        for r in range(0, height, rows_per_strip):
            part = plane[r : r + rows_per_strip]
            if predictor == 2:
                part = np.concatenate([part[:, :1], np.diff(part, axis=1)], axis=1)
            raw = part.astype(kind).tobytes()
            if predictor == 3:
                flat = part.astype(f">{array.dtype.str[1:]}").reshape(len(part), -1).view(np.uint8).reshape(len(part), -1, array.dtype.itemsize).transpose(0, 2, 1).reshape(len(part), -1)
                raw = np.concatenate([flat[:, :1], np.diff(flat, axis=1)], axis=1).astype(np.uint8).tobytes()
            strips.append({1: lambda x: x, 8: zlib.compress, 5: lzw, 32773: packbits}[compression](raw))
    values = {256: ("I", [width]), 257: ("I", [height]), 258: ("H", [array.dtype.itemsize * 8] * bands), 259: ("H", [compression]), 277: ("H", [bands]), 278: ("I", [rows_per_strip]), 279: ("I", [len(s) for s in strips]), 284: ("H", [2 if planar else 1]), 317: ("H", [predictor]), 339: ("H", [{"u": 1, "i": 2, "f": 3}[array.dtype.kind]] * bands)}
    values |= {33550: ("d", [2.0, 3.0, 0.0]), 33922: ("d", [0.0, 0.0, 0.0, 10.0, 90.0, 0.0]), 34735: ("H", [1, 1, 0, 2, 1025, 0, 1, 1 if area else 2, 2048, 0, 1, 4326])}
    at, places = 8, []
    for s in strips:
        places.append(at)
        at += len(s)
    values[273] = ("I", places)
    table, body, start = b"", b"", at + 2 + 12 * len(values) + 4
    for tag in sorted(values):
        code, v = values[tag]
        raw = struct.pack(f"{order}{len(v)}{code}", *v)
        field = raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack(f"{order}I", start + len(body))
        body += raw if len(raw) > 4 else b""
        table += struct.pack(f"{order}HHI", tag, {"I": 4, "H": 3, "d": 12}[code], len(v)) + field
    return (b"II" if order == "<" else b"MM") + struct.pack(f"{order}HI", 42, at) + b"".join(strips) + struct.pack(f"{order}H", len(values)) + table + b"\0" * 4 + body


def lzw(data):
    table, out, bits, width, prefix = {bytes((k,)): k for k in range(256)}, 0, 0, 9, b""
    out, bits = 256, 9
    size = 258
    for k in data:
        both = prefix + bytes((k,))
        if both in table:
            prefix = both
            continue
        out, bits = out << width | table[prefix], bits + width
        table[both] = size
        size += 1
        width = 12 if size >= 2048 else 11 if size >= 1024 else 10 if size >= 512 else 9
        prefix = bytes((k,))
        if size == 4094:
            out, bits = out << width | table[prefix], bits + width
            out, bits = out << 12 | 256, bits + 12
            table, size, width, prefix = {bytes((k,)): k for k in range(256)}, 258, 9, b""
    if prefix:
        out, bits = out << width | table[prefix], bits + width
        size += 1
        width = 12 if size >= 2048 else 11 if size >= 1024 else 10 if size >= 512 else 9
    out, bits = out << width | 257, bits + width
    return (out << -bits % 8).to_bytes((bits + 7) // 8, "big")


def packbits(data):
    return b"".join(bytes((len(data[k : k + 100]) - 1,)) + data[k : k + 100] for k in range(0, len(data), 100)) + bytes((128, 253)) + b"\0"


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize(("compression", "predictor", "dtype"), [(1, 1, "f4"), (8, 2, "i2"), (8, 3, "f4"), (8, 3, "f8"), (5, 1, "u1"), (5, 2, "u2"), (32773, 1, "i4")])
def test_classic_files(spark, order, compression, predictor, dtype):
    chance = np.random.default_rng(7)
    array = (chance.normal(0, 50, (37, 53, 2)) if dtype[0] == "f" else chance.integers(0, 120, (37, 53, 2))).astype(dtype)
    for planar in (False, True):
        content = classic(array, order, compression, predictor, 10, planar)
        head = T.header(content)
        assert head.grid == Grid(53, 37, 10.0, 90.0, 2.0, 3.0, "EPSG:4326")
        got = np.zeros((37, 53, 2))
        for band, r, c, part in T.blocks(content, head):
            got[r : r + part.shape[0], c : c + part.shape[1], band - 1] = part
        assert (got == array).all()
    assert T.header(classic(array, area=False)).grid.left == 9.0


@pytest.mark.parametrize("content", [b"", b"II", b"not a tiff at all", b"II*\0\xff\xff\xff\x7f", classic(np.zeros((3, 3), "f4"))[:30]])
def test_broken_files_are_not_valid(spark, content):
    assert not T.headers(written(spark, content)).first()["valid"] and T.cells(written(spark, content)).count() == 0


def test_warped_files_of_two_grids(spark):
    """Files of another grid, or of another system, on a common grid."""
    near = Grid(8, 6, 100.0, 50.0, 1.0, 1.0, "EPSG:4326")
    wide = Grid(4, 3, 100.0, 50.0, 2.0, 2.0, "EPSG:4326")
    rows = R.grid_pixels(spark.range(1), wide).withColumn("value", (F.col("row") * 10 + F.col("col")).cast("double"))
    mercator = Grid(400, 400, 11131949.0, 6446276.0, 5000.0, 5000.0, "EPSG:3857")
    flat = R.grid_pixels(spark.range(1), mercator).withColumn("value", F.lit(5.0))
    files = W.tiff_bytes(rows, wide).select(F.lit("w").alias("path"), "content").union(W.tiff_bytes(flat, mercator).select(F.lit("m").alias("path"), "content"))
    got = {(r["path"], r["row"], r["col"]): r["value"] for r in T.warped(files, near).collect()}
    assert all(got["w", r, c] == (r // 2) * 10 + c // 2 for r in range(6) for c in range(8))
    assert all(got["m", r, c] == 5.0 for r in range(6) for c in range(8))


@pytest.mark.parametrize("method", ["bilinear", "cubic", "average"])
def test_methods_keep_planes(spark, method):
    """A plane comes back as a plane away from the edge, across blocks."""
    source, target = Grid(40, 40, 0.0, 40.0, 1.0, 1.0), Grid(15, 15, 5.0, 35.0, 2.0, 2.0)
    rows = R.grid_pixels(spark.range(1), source).withColumn("value", F.col("row") * 2.0 + F.col("col"))
    got = R.regrid(rows, source, target, method).collect()
    assert len(got) == 225 and all(abs(r["value"] - (2 * (2 * r["row"] + 5.5) + 2 * r["col"] + 5.5)) < 1e-9 for r in got)


def test_blocks_of_regridding_meet(spark, monkeypatch):
    source, target = Grid(30, 30, 0.0, 30.0, 1.0, 1.0), Grid(37, 37, -1.0, 31.0, 0.83, 0.83)
    rows = R.grid_pixels(spark.range(1), source).withColumn("value", F.when((F.col("row") * 3 + F.col("col")) % 5 != 0, (F.col("row") * F.col("col")).cast("double")))
    for method in ("nearest", "bilinear", "cubic"):
        want = sorted(map(tuple, R.regrid(rows, source, target, method).collect()), key=str)
        monkeypatch.setattr(R, "BLOCK", 7)
        assert sorted(map(tuple, R.regrid(rows, source, target, method).collect()), key=str) == want
        monkeypatch.undo()


def test_netcdf_cubes_come_back(spark, tmp_path):
    """Scenes of several files by their coordinates; a selection reads only what it names."""
    grid = Grid(13, 9, 100.0, 50.0, 0.5, 0.25, "EPSG:4326")
    rows = R.grid_pixels(spark.range(1), grid).select(F.explode(F.array(*(F.lit(f"2024{k:04d}") for k in range(5)))).alias("pair_id"), "row", "col")
    rows = rows.withColumn("value", F.when((F.col("row") + F.col("col")) % 5 != 0, F.col("row") * 100.0 + F.col("col") + F.col("pair_id").cast("int") % 10 / 4))
    made = N.netcdf_bytes(rows, grid, "phase", dtype="float64", per_file=2, title="a cube")
    assert W.write_files(made.select(F.concat(F.lit("c"), F.col("part").cast("string"), F.lit(".nc")).alias("name"), "content"), str(tmp_path)).count() == 3
    files = C.files(spark, str(tmp_path))
    found = {(r["path"][-5:], r["variable"]): r for r in C.variables(files).collect()}
    assert found["c0.nc", "phase"]["dims"] == ["pair_id", "lat", "lon"] and found["c2.nc", "phase"]["shape"] == [1, 9, 13]
    dims = {"pair_id": "string", "lat": "double", "lon": "double"}
    back = C.pixels(C.cells(files, "phase", dims)).select("pair_id", "row", "col", "value")
    assert back.count() == 5 * 9 * 13 and back.exceptAll(rows).count() == 0
    part = C.cells(files, "phase", dims, pair_id=["20240001", "20240004"], lat=(49.0, 49.4)).collect()
    assert {r["pair_id"] for r in part} == {"20240001", "20240004"} and {r["lat"] for r in part} == {49.375, 49.125} and len(part) == 2 * 2 * 13
    with pytest.raises(Exception, match="has the dimensions"):
        C.cells(files, "phase", {"lat": "double"}).count()


def handmade_netcdf(version):
    """A file with a packed short variable of one unlimited dimension, by the format's description."""
    count = ">q" if version == 5 else ">i"
    n = lambda x: struct.pack(count, x)
    t = lambda s: n(len(s)) + s.encode() + b"\0" * (-len(s) % 4)
    place = ">i" if version == 1 else ">q"
    short = struct.pack(">h", -1) + b"\0\0"
    more = struct.pack(">i", 12) + n(3) + t("scale_factor") + struct.pack(">i", 6) + n(1) + struct.pack(">d", 0.5) + t("add_offset") + struct.pack(">i", 6) + n(1) + struct.pack(">d", 10.0) + t("_FillValue") + struct.pack(">i", 3) + n(1) + short

    def build(at):
        out = b"CDF" + bytes((version,)) + n(2) + struct.pack(">i", 10) + n(2) + t("time") + n(0) + t("x") + n(3) + struct.pack(">i", 0) + n(0) + struct.pack(">i", 11) + n(2)
        out += t("time") + n(1) + n(0) + struct.pack(">i", 0) + n(0) + struct.pack(">i", 4) + n(4) + struct.pack(place, at)
        return out + t("v") + n(2) + n(0) + n(1) + more + struct.pack(">i", 3) + n(8) + struct.pack(place, at + 4)

    head = build(0)
    records = b"".join(struct.pack(">i", day) + struct.pack(">3h", *v) + b"\0\0" for day, v in ((7, (1, 2, -1)), (9, (4, -1, 6))))
    return build(len(head)) + records


@pytest.mark.parametrize("version", [1, 2, 5])
def test_handmade_netcdf(spark, version):
    got = C.cells(written(spark, handmade_netcdf(version)), "v", {"time": "int", "x": "int"}).collect()
    assert [(r["time"], r["x"], r["value"]) for r in got] == [(7, 0, 10.5), (7, 1, 11.0), (7, 2, None), (9, 0, 12.0), (9, 1, None), (9, 2, 13.0)]


@pytest.mark.parametrize("content", [b"", b"CDF", b"CDF\x02" + b"\xff" * 40, b"\x89HDF\r\n\x1a\n" + b"\0" * 50])
def test_other_files_are_no_cubes(spark, content):
    assert C.variables(written(spark, content)).count() == 0 and C.cells(written(spark, content), "v", {"x": "int"}).count() == 0


def shapefile(kind, records):
    body = b""
    for k, raw in enumerate(records):
        raw = struct.pack("<i", kind if raw else 0) + raw
        body += struct.pack(">ii", k + 1, len(raw) // 2) + raw
    return struct.pack(">i5ii", 9994, 0, 0, 0, 0, 0, (100 + len(body)) // 2) + struct.pack("<ii8d", 1000, kind, *[0.0] * 8) + body


def dbf(rows, width=12):
    names = list(rows[0])
    head = 32 + 32 * len(names) + 1
    out = struct.pack("<BBBBIHH20x", 3, 124, 1, 1, len(rows), head, 1 + width * len(names))
    out += b"".join(n.encode().ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes((width, 0)) + b"\0" * 14 for n in names) + b"\r"
    return out + b"".join(b" " + b"".join(str(r[n]).encode().ljust(width) for n in names) for r in rows)


def polygon(*rings):
    xy = [p for r in rings for p in r]
    starts = np.cumsum([0, *(len(r) for r in rings[:-1])])
    return struct.pack("<4dii", 0, 0, 0, 0, len(rings), len(xy)) + struct.pack(f"<{len(rings)}i", *starts) + struct.pack(f"<{2 * len(xy)}d", *(v for p in xy for v in p))


def test_shapefiles(spark, tmp_path):
    square, hole = [(0.0, 0.0), (0.0, 4.0), (4.0, 4.0), (4.0, 0.0), (0.0, 0.0)], [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 1.0)]
    (tmp_path / "a.shp").write_bytes(shapefile(5, [polygon(square, hole), b"", polygon(hole)]))
    (tmp_path / "a.dbf").write_bytes(dbf([{"type": "desired", "n": 1}, {"type": "x", "n": 2}, {"type": "undesired", "n": 3}]))
    (tmp_path / "b.shp").write_bytes(shapefile(1, [struct.pack("<dd", 3.0, 5.0), struct.pack("<dd", 1.5, 2.5)]))
    (tmp_path / "c.shp").write_bytes(b"no shapes")
    files = H.files(spark, str(tmp_path))
    got = H.polygons(files.filter("path not like '%b.shp'")).orderBy("type").collect()
    assert [(r["type"], [len(x) for x in r["rings"]]) for r in got] == [("desired", [5, 4]), ("undesired", [4])]
    assert got[0]["rings"][1][1]["x"] == 2.0
    assert sorted((r["x"], r["y"]) for r in H.points(files.filter("path like '%b.shp'")).collect()) == [(1.5, 2.5), (3.0, 5.0)]


def test_masks_of_files(spark):
    grid = Grid(10, 8, 0.0, 8.0, 1.0, 1.0)
    rows = R.grid_pixels(spark.range(1), grid).withColumn("value", ((F.col("row") + F.col("col")) % 2).cast("double"))
    files = W.tiff_bytes(rows, grid, dtype="uint8", nodata=255).select(F.lit("m").alias("path"), "content")
    got = T.mask(files, grid, Box(2.0, 1.0, 5.0, 6.0)).collect()
    assert len(got) == 15 and all(r["valid"] == ((r["row"] + 2 + r["col"] + 2) % 2 == 1) for r in got)
    with pytest.raises(ValueError, match="mask"):
        T.mask(files, Grid(9, 8, 0.0, 8.0, 1.0, 1.0))


def test_arrays_and_back(spark, tmp_path):
    grid = Grid(5, 4, 0.0, 4.0, 1.0, 1.0)
    array = np.arange(20.0).reshape(4, 5)
    array[1, 2] = np.nan
    back = I.to_array(I.from_array(spark, array), grid)
    assert np.array_equal(back, array, equal_nan=True)
    with pytest.raises(ValueError, match="cells"):
        I.to_array(spark.range(0), Grid(10**5, 10**5, 0, 0, 1, 1))
    names = spark.createDataFrame([("b",), ("a",)], "pair_id string")
    assert I.names_array(names).tolist() == ["a", "b"]
    for _ in range(2):
        log = I.logger("stackwave.test", "DEBUG", str(tmp_path / "x.log"))
    log.debug("one line")
    assert len(log.handlers) == 1 and (tmp_path / "x.log").read_text().count("one line") == 1


def test_regions_of_datasets(spark):
    grid = Grid(10, 8, 5.0, 8.0, 1.0, 0.5)
    rows = R.grid_pixels(spark.range(1), grid).withColumn("value", F.lit(1.0))
    files = W.tiff_bytes(rows, grid).select(F.lit("a").alias("path"), "content").union(written(spark, b"broken", "b"))
    assert T.region(T.headers(files)) == grid.bounds and T.region(T.headers(files), Box(0, 0, 1, 1)) == Box(0, 0, 1, 1)
    with pytest.raises(ValueError, match="readable"):
        T.region(T.headers(written(spark, b"broken")))


def test_batches_fit_memory():
    assert U.batch_rows(100, 30, 1 << 30) * 8 * 100 * (2 * 30 + 100) <= 1 << 30 and U.batch_rows(10**6, 10**6, 1) == 1


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_cells_of_files_are_not_broadcast(spark):
    """Files of equal cells are a thousandth of their cells: joins of the cells go by the cells, not by the files' size."""
    grid = Grid(512, 512, 0.0, 512.0, 1.0, 1.0)
    rows = R.grid_pixels(spark.range(1), grid).withColumn("value", F.lit(1.0))
    one = W.tiff_bytes(rows, grid).first()["content"]
    days = [f"2024010{k}T101112_2024011{k}T101112_VVP012_INT80" for k in range(1, 4)]
    made = [(f"/p/S1AA_{d}_{end}.tif", bytearray(one if (d, end) != (days[2], "corr") else b"broken")) for d in days for end in ("unw_phase", "corr")]
    files = spark.createDataFrame(made, "path string, content binary").coalesce(1).persist()
    files.count()
    found = T.interferograms(files, S.HYP3)
    assert found.count() == 2 * 512 * 512
    found.write.format("noop").mode("overwrite").save()
    assert sorted(r[0] for r in found.select("pair_id").distinct().collect()) == ["20240101_20240111", "20240102_20240112"]
    assert "SortMergeJoin" in plan_of(found) and found.select("phase", "coh").distinct().collect() == [(1.0, 1.0)]
    assert found._jdf.queryExecution().executedPlan().toString().count("InMemoryTableScan") <= 2
    half = R.regrid(T.cells(files).filter("band = 1").withColumnRenamed("path", "pair_id"), grid, Grid(256, 256, 0.0, 512.0, 2.0, 2.0), "average", "pair_id")
    assert half.count() == 5 * 256 * 256 and "SortMergeJoin" in plan_of(half)
    files.unpersist()
