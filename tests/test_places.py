"""Grids, polygons, files, exports, clusters, uncertainty and streams on small inputs."""

from __future__ import annotations

import json
import time
import tracemalloc
import zipfile
from dataclasses import replace
from datetime import date
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from stackwave.functions.geo import Box, Grid, project
from stackwave.operators import freeze_thaw as T
from stackwave.operators import raster as R
from stackwave.operators import spatial as S
from stackwave.plans import clusters as C
from stackwave.plans import inversion
from stackwave.plans import models as M
from stackwave.plans import uncertainty as U
from stackwave.sinks import tables as K
from stackwave.sources import catalog as G
from stackwave.sources import formats as O
from stackwave.streaming import incremental as X

GRID = Grid(4, 3, 10.0, 23.0, 1.0, 1.0)


def cells(spark, rows):
    return spark.createDataFrame(rows, "row int, col int, value double")


def test_boxes():
    a, b = Box(0, 0, 4, 2), Box(3, 1, 6, 5)
    assert (a | b) == Box(0, 0, 6, 5) and (a & b) == Box(3, 1, 4, 2) and a.intersects(b) and Box(1, 1, 2, 2) in a and b not in a
    assert a.area == 8 and a.buffer(1) == Box(-1, -1, 5, 3) and a.split(0.25)[0] == Box(0, 0, 1, 2)
    with pytest.raises(ValueError):
        a & Box(9, 9, 10, 10)


def test_grid_sizes_round_half_to_even():
    assert (Grid.of(Box(0, 0, 2.5, 3.5), 1).width, Grid.of(Box(0, 0, 2.5, 3.5), 1).height) == (2, 4)
    assert GRID.bounds == Box(10, 20, 14, 23)


def test_tiles_partition_the_grid(spark):
    pixels = R.grid_pixels(spark.range(1), Grid(10, 7, 0, 7, 1, 1))
    for tiling in (S.Tiling(Grid(10, 7, 0, 7, 1, 1), 3, 4), S.Tiling.of_size(Grid(10, 7, 0, 7, 1, 1), height=2)):
        rows = tiling.assign(pixels).collect()
        assert len(rows) == 70
        for r, c, box in tiling.boxes():
            inside = sum(1 for p in rows if box.left < p["col"] + 0.5 < box.right and box.bottom < 6.5 - p["row"] < box.top)
            assert inside == sum(1 for p in rows if (p["tile_row"], p["tile_col"]) == (r, c)) > 0


def test_points_outside_and_padding(spark):
    img = cells(spark, [(r, c, float(10 * r + c)) for r in range(3) for c in range(4)])
    pts = spark.createDataFrame([(1, 10.0, 23.0), (2, 13.99, 20.01), (3, 9.9, 21.0), (4, 14.0, 21.0)], "point_id long, x double, y double")
    got = {r["point_id"]: r["value"] for r in S.sample_points(img, GRID, pts).collect()}
    assert got == {1: 0.0, 2: 23.0, 3: None, 4: None}
    assert S.window(img, GRID, Box(9, 21, 12, 25), padded=True).filter("value is null").count() == 8


def test_polygon_edges(spark):
    img = cells(spark, [(r, c, 1.0) for r in range(3) for c in range(4)])
    ring = [[{"x": 10.2, "y": 22.2}, {"x": 10.4, "y": 22.2}, {"x": 10.3, "y": 22.4}]]
    poly = spark.createDataFrame([(1, "desired", ring)], "poly_id long, type string, rings array<array<struct<x:double,y:double>>>")
    assert S.polygon_pixels(img, GRID, poly, all_touched=False).count() == 0
    assert [(r["row"], r["col"]) for r in S.polygon_pixels(img, GRID, poly).collect()] == [(0, 0)]


def test_projections_agree_with_known_places(spark):
    one = spark.createDataFrame([(9.0, 48.0)], "x double, y double")
    x, y = project(F.col("x"), F.col("y"), "EPSG:4326", "EPSG:32632")
    e, n = one.select(x, y).first()
    assert e == pytest.approx(500000, abs=1e-6) and n == pytest.approx(5316300.0, abs=100)
    x, y = project(F.col("x"), F.col("y"), "EPSG:4326", "EPSG:3857")
    assert one.select(x, y).first()[0] == pytest.approx(1001875.417, abs=1e-3)
    with pytest.raises(ValueError):
        project(F.col("x"), F.col("y"), "EPSG:4326", "EPSG:2154")


def test_filling_and_multilook(spark):
    img = cells(spark, [(0, 0, 1.0), (0, 1, None), (0, 2, 3.0), (5, 5, None)])
    got = {(r["row"], r["col"]): r["value"] for r in R.fill_missing(img, 2).collect()}
    assert got[0, 1] == pytest.approx(2.0) and got[5, 5] is None
    looks = R.multilook(img, 1, 2).collect()
    assert {(r["row"], r["col"]): r["value"] for r in looks} == {(0, 0): 1.0, (0, 1): 3.0, (5, 2): None}


def test_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "S1AA_20200101T1_20200113T1_unw_phase.tif").write_bytes(b"x")
    (tmp_path / "b_unw_phase.tif").write_bytes(b"y")
    files = G.scan_files(spark, str(tmp_path), "*unw_phase.tif")
    assert sorted((r["name"], r["valid"]) for r in files.collect()) == [("S1AA_20200101T1_20200113T1_unw_phase.tif", True), ("b_unw_phase.tif", True)]
    assert [r["pair_id"] for r in G.HYP3.pairs(files).collect()] == ["20200101_20200113"]
    (tmp_path / "p.csv").write_text("name,Longitude,LAT\nq,1.5,2.5\n")
    assert O.points_from_csv(spark, str(tmp_path / "p.csv")).select("x", "y").first() == (1.5, 2.5)
    shapes = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"type": "undesired"}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1]]]}}, {"type": "Feature", "properties": {}, "geometry": {"type": "Point", "coordinates": [3, 4]}}]}
    (tmp_path / "s.geojson").write_text(json.dumps(shapes))
    poly = O.polygons_from_geojson(spark, str(tmp_path / "s.geojson")).first()
    assert poly["type"] == "undesired" and len(poly["rings"][0]) == 3
    assert O.points_from_geojson(spark, str(tmp_path / "s.geojson")).select("x", "y").first() == (3.0, 4.0)
    assert O.profile_from_json(O.profile_json(GRID)) == GRID
    (tmp_path / "g.asc").write_text("ncols 2\nnrows 2\nxllcorner 0\nyllcorner 0\ncellsize 1\nNODATA_value -1\n1 2\n-1 4\n")
    for name, rows in (("short", "1 2\n-1\n"), ("word", "1 2\n-1 x\n"), ("none", "")):  # what can't be read whole has no cells
        (tmp_path / f"{name}.asc").write_text(f"ncols 2\nnrows 2\ncellsize 1\n{rows}")
    got = O.read_ascii(spark, str(tmp_path)).collect()
    assert sorted((r["row"], r["col"], r["value"]) for r in got if r["value"]) == [(0, 0, 1.0), (0, 1, 2.0), (1, 1, 4.0)] and len(got) == 4
    for k, name in enumerate(("long", "LONGS", "longitudes")):
        assert O.coordinate_columns(["a", name, "lats"]) == (name, "lats"), k
    with pytest.raises(ValueError):
        O.coordinate_columns(["a", "b"])
    assert G.get_format("LICSAR") is G.LICSAR and M.get_model("linear") is M.LINEAR


def test_exports(spark, tmp_path):
    stack = spark.createDataFrame([("p", 0, 0, 1.0), ("p", 0, 1, 2.0), ("q", 0, 0, 3.0)], "pair_id string, row int, col int, value double")
    K.write_scenes(stack, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).filter("pair_id = 'p'").count() == 2
    K.upsert_tiles(stack.withColumn("tile", F.col("col")), str(tmp_path / "t"), "tile")
    K.upsert_tiles(spark.createDataFrame([("z", 0, 1, 9.0, 1)], "pair_id string, row int, col int, value double, tile int"), str(tmp_path / "t"), "tile")
    assert sorted(r["value"] for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [1.0, 3.0, 9.0]
    array = K.tile_array(stack.filter("pair_id = 'p'").collect(), 2, 2)
    K.write_kmz(array, str(tmp_path / "x.kmz"), GRID, "a & b", 0, 3)
    with zipfile.ZipFile(tmp_path / "x.kmz") as z:
        assert z.read("overlay.png")[:4] == b"\x89PNG" and b"a &amp; b" in z.read("doc.kml")
    named = K.with_band_names(stack.withColumn("band", F.lit(1)), ["vv"])
    assert named.schema["band"].metadata == {"names": ["vv"]} and np.isnan(K.nodata_value("float32"))
    assert Path(tmp_path / "s" / "pair_id=q").is_dir()


def test_freeze_thaw_edges(spark):
    rows = spark.sql("SELECT 1 AS site, explode(sequence(date'2001-01-01', date'2002-12-31')) AS date").withColumn("t", F.when(F.month("date").between(5, 9), 10.0).when(F.month("date") == 4, 0.0).otherwise(-10.0))
    s = T.Seasons(day_duration=3)
    t1 = {r["year"]: str(r["onset"]) for r in T.onset(rows, s, "thaw").collect()}
    assert t1 == {2001: "2001-05-01", 2002: "2002-05-01"}
    first = T.degree_days(rows, s, "thaw").filter("date = '2001-04-10'").first()
    assert first["dd"] == 0.0
    assert T.onset(rows, T.Seasons(day_duration=400), "thaw").filter("onset is not null").count() == 0
    assert T.require_daily(rows).count() == 730
    with pytest.raises(PySparkException):
        T.require_daily(rows.filter("date <> '2001-03-03'")).collect()


def test_clusters(spark):
    points = np.array([[0, 0], [0.1, 0], [5, 5], [5.1, 5], [9, 0]])
    assert C.ward(points, np.ones(5), 1.0).tolist() == [0, 0, 1, 1, 2]
    df = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(points)] + [(9, None, 1.0)], "k int, ti double, fi double")
    got = {r["k"]: r["label"] for r in C.temperature_clusters(df, 1.0, "k").collect()}
    assert got[9] == -1 and got[0] == got[1] != got[2] == got[3] != got[4]


def test_uncertainty_identities(spark):
    g = np.random.default_rng(1).normal(size=(6, 3))
    v = np.array([1.0, 2, 3, 1, 2, 3])
    df = spark.createDataFrame([(1, v.tolist(), np.diag(v).reshape(-1).tolist()), (2, [None] * 6, [None] * 36), (3, [1.0, None, 1.0, 1.0, 1.0, 1.0], None)], "k int, variance array<double>, covariance array<double>")
    m = np.linalg.pinv(g)
    want = np.diag(m @ np.diag(v) @ m.T)

    def got(table):
        return {r["k"]: r["variance"] for r in table.collect()}

    assert np.allclose(got(U.parameters(df, g, "k"))[1], want) and got(U.parameters(df, g, "k"))[2] == [None] * 3
    assert None not in got(U.parameters(df, g, "k"))[3] and got(U.parameters(df, g, "k", strict=True))[3] == [None] * 3
    assert np.allclose(got(U.parameters_of_covariance(df, g, "k"))[1], want) and got(U.parameters_of_covariance(df, g, "k"))[3] == [None] * 3
    w = got(U.parameters_weighted(df, g, "k"))
    assert np.allclose(w[1], np.diag(np.linalg.inv(g.T @ np.diag(1 / v) @ g))) and np.allclose(w[1], got(U.parameters_weighted(df, g, "k", exact=False))[1])
    h = np.random.default_rng(2).normal(size=(3, 2))
    chain = got(U.parameters(df, [g, h], "k"))[1]
    assert np.allclose(chain, np.diag(np.linalg.pinv(h) @ m @ np.diag(v) @ m.T @ np.linalg.pinv(h).T))


class OneBatch:
    """Stands for a table of one Arrow batch: what is mapped runs here, and its peak of numpy's memory is kept."""

    def __init__(self, batch, **kinds):
        self.batch, self.dtypes, self.peak = batch, list(kinds.items()), 0

    def mapInArrow(self, run, schema):  # noqa: N802
        tracemalloc.start()
        try:
            out = [(len(b), b.column(0).to_pylist(), b.column(1)) for b in run(iter([self.batch]))]
            self.peak = tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()
        return sum((k for _, k, _ in out), []), pa.concat_arrays([v for *_, v in out])


def chain_matrix(n):
    pairs = [(i, j) for i in range(n) for j in range(i + 1, min(i + 4, n))]
    return np.array([[float(i <= k < j) for k in range(n - 1)] for i, j in pairs])


def test_weighted_variances_of_a_large_batch_take_a_slice_of_memory():
    g, rows = chain_matrix(30), 6000
    v = np.random.default_rng(3).uniform(0.5, 1.5, (rows, len(g)))
    lists = v.tolist()
    lists[7], lists[5000], lists[5001], lists[5002] = None, lists[5000][:-1], [None, *lists[5001][1:]], [0.0, *lists[5002][1:]]
    table = OneBatch(pa.RecordBatch.from_pydict({"k": pa.array(range(rows)), "variance": pa.array(lists, pa.list_(pa.float64()))}).slice(2), k="bigint", variance="array<double>")
    keys, got = U.parameters_weighted(table, g, "k")
    assert table.peak < 64 << 20  # a gain a row of the batch alone is 117 MB
    assert keys == list(range(2, rows))
    for k in (2, 6, 7, 8, 4999, 5000, 5001, 5002, 5003, rows - 1):
        whole = k not in (7, 5000, 5001, 5002)
        want = np.diag(np.linalg.inv(g.T @ (g / v[k][:, None]))) if whole else [None] * g.shape[1]
        assert np.allclose(got[k - 2].as_py(), want, rtol=1e-10) if whole else got[k - 2].as_py() == want


def test_streams_agree_with_batches(spark, tmp_path):
    rows = spark.range(40).select((F.col("id") % 4).alias("k"), F.col("id").cast("double").alias("span"), (3 * F.col("id") + F.col("id") % 4).cast("double").alias("value"))
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = X.line_sums(stream, "k").writeStream.format("memory").queryName("sums").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    got = sorted(tuple(round(v, 6) for v in r) for r in X.line_of_sums(spark.table("sums"), "k").collect())
    want = sorted(tuple(round(v, 6) for v in r) for r in M.linear_fit(rows, "k").collect())
    assert got == want
    seen = []
    X.reinvert(stream, lambda df, n: seen.append((n, df.count())), str(tmp_path / "d")).awaitTermination(120)
    assert sum(n for _, n in seen) == 40
    scenes = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 01:00:00"), ("b", "2024-01-02 00:00:00")], "pair_id string, seen string").withColumn("seen", F.to_timestamp("seen"))
    scenes.write.parquet(str(tmp_path / "scenes"))
    new = X.new_scenes(spark.readStream.schema(scenes.schema).parquet(str(tmp_path / "scenes")))
    q = new.writeStream.format("memory").queryName("scenes").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "e")).start()
    q.awaitTermination(120)
    assert spark.table("scenes").count() == 2


def test_series_takes_the_mean_of_repeated_rows(spark):
    """A pair that comes twice at a pixel, a missing value, and a pixel without any."""
    days = [date(2024, 1, k) for k in (1, 13, 25)]
    net = inversion.Network(tuple(days), ((0, 1), (0, 2), (1, 2)))
    rows = [(net.names[0], 0, 0, 1.0), (net.names[0], 0, 0, 3.0), (net.names[1], 0, 0, None), (net.names[2], 0, 0, 5.0), (net.names[1], 0, 1, float("nan"))]
    got = inversion.series(spark.createDataFrame(rows, "pair_id string, row int, col int, phase double"), net, "row", "col").orderBy("col").collect()
    assert [r["d"] for r in got] == [[2.0, None, 5.0], [None, None, None]]


def test_plans_have_no_nested_loops(spark):
    from stackwave.queries import QUERIES

    for name in ("stack_point_samples", "polygon_pixels", "composite_query", "triplet_closures", "box_predicates", "regrid_nearest", "regrid_bilinear"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name


def test_formats_of_ones_own_and_binary_cubes(spark, tmp_path):
    mine = G.register_format(replace(G.LICSAR, name="Mine"))
    assert G.get_format("mine") is mine
    cube = np.arange(24, dtype="<i2").reshape(2, 3, 4)
    cube[1, 2, 3] = -9
    (tmp_path / "c.bin").write_bytes(cube.tobytes())
    got = O.read_binary(spark, str(tmp_path / "c.bin"), replace(GRID, nodata=-9), 2, "BSQ", "<i2").collect()
    assert len(got) == 24 and all(r["value"] == (None if (r["band"], r["row"], r["col"]) == (2, 2, 3) else cube[r["band"] - 1, r["row"], r["col"]]) for r in got)


def test_values_of_a_kind(spark):
    rows = cells(spark, [(0, 0, 1.5)])
    assert dict(K.with_dtype(rows, "int16").dtypes)["value"] == "smallint" and K.with_dtype(rows, "float64") is rows


def test_mask_of_a_share_of_the_scenes(spark):
    """One of two scenes is drawn: its cells decide, the same ones for the same seed."""
    rows = spark.createDataFrame([("a", 0, 0, 1.0), ("a", 0, 1, None), ("b", 0, 0, None), ("b", 0, 1, 1.0)], "pair_id string, row int, col int, phase double")
    found = [tuple(r["valid"] for r in R.valid_mask(rows, 0.5, seed).orderBy("col").collect()) for seed in range(12)]
    assert set(found) == {(True, False), (False, True)} and found[0] == tuple(r["valid"] for r in R.valid_mask(rows, 0.5, 0).orderBy("col").collect())
    assert all(r["valid"] for r in R.valid_mask(rows, 1.0).collect())


def test_exact_clusters_are_not_moved_by_the_lattice(spark, monkeypatch):
    """Points nearer than a cell stay apart as long as they are few."""
    rows = spark.createDataFrame([(k, float(k % 2) * 0.001 + (1000.0 if k > 5 else 0.0), 0.0) for k in range(8)], "pixel int, ti double, fi double")
    assert len({r["label"] for r in C.temperature_clusters(rows, 0.0005, "pixel").collect()}) == 4
    monkeypatch.setattr(C, "CELLS", 1)
    assert len({r["label"] for r in C.temperature_clusters(rows, 0.0005, "pixel").collect()}) == 1


def test_covariances_of_a_batch_take_two_products():
    """Sums over both places of the data at once take some 6 million steps a row here, one after the other 0.3 million."""
    g, rows = chain_matrix(30), 600
    n, m = len(g), np.linalg.pinv(g)
    c = np.random.default_rng(4).normal(size=(rows, n, n))
    lists = c.reshape(rows, -1).tolist()
    lists[3], lists[8] = None, [None, *lists[8][1:]]
    table = OneBatch(pa.RecordBatch.from_pydict({"k": pa.array(range(rows)), "covariance": pa.array(lists, pa.list_(pa.float64()))}), k="bigint", covariance="array<double>")
    began = time.thread_time()
    m @ c[:200] @ m.T
    products = time.thread_time() - began
    began = time.thread_time()
    keys, got = U.parameters_of_covariance(table, g, "k")
    assert time.thread_time() - began < 30 * products + 1 and table.peak < 64 << 20
    _, whole = U.parameters_of_covariance(table, g, "k", full=True)
    assert keys == list(range(rows))
    for k in (0, 3, 8, 9, rows - 1):
        if k in (3, 8):
            assert got[k].as_py() == [None] * len(m) and whole[k].as_py() == [None] * len(m) ** 2
        else:
            want = m @ c[k] @ m.T
            assert np.allclose(got[k].as_py(), np.diag(want)) and np.allclose(np.array(whole[k].as_py()).reshape(len(m), -1), want)
