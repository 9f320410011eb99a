"""Queries on scene catalogs, file names, side-cars, cubes and exports."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from .. import adapters as A
from ..functions.geo import Box
from ..operators import raster as R
from ..sinks import geotiff as W
from ..sinks import netcdf as N
from ..sinks import tables as K
from ..sources import catalog as S
from ..sources import geotiff as T
from ..sources import netcdf as C
from ..sources import formats as O
from .registry import query

_RC = {"row": "r", "col": "c"}
_H = "(SELECT n FROM high)"


def _named(spark, sf, text):
    """Paths made from the event network's pair ids."""
    return A.event_network(spark, sf).select(F.concat(F.lit("/data/x/"), text).alias("path"))


@query("SELECT pair_id, p, s FROM net")
def hyp3_names(spark, sf):
    a, b = F.split("pair_id", "_")[0], F.split("pair_id", "_")[1]
    files = _named(spark, sf, F.concat(F.lit("S1AA_"), a, F.lit("T101112_"), b, F.lit("T101112_VVP012_INT80_unw_phase.tif")))
    return S.HYP3.pairs(files).select("pair_id", F.col("primary").alias("p"), F.col("secondary").alias("s"))


@query("SELECT pair_id, p, s FROM net")
def hyp3_burst_names(spark, sf):
    files = _named(spark, sf, F.concat(F.lit("S1_136231_IW2_"), "pair_id", F.lit("_VV_INT80_unw_phase.tif")))
    return S.HYP3_BURST.pairs(files).select("pair_id", F.col("primary").alias("p"), F.col("secondary").alias("s"))


@query("SELECT pair_id, p, s FROM net")
def licsar_names(spark, sf):
    files = _named(spark, sf, F.concat("pair_id", F.lit(".geo.unw.tif")))
    return S.LICSAR.pairs(files).select("pair_id", F.col("primary").alias("p"), F.col("secondary").alias("s"))


@query("SELECT pair_id, p, s FROM net")
def delay_pair_names(spark, sf):
    return S.APS_PAIRS.pairs(_named(spark, sf, F.concat(F.lit("GACOS_"), "pair_id", F.lit(".tif")))).select("pair_id", F.col("primary").alias("p"), F.col("secondary").alias("s"))


@query("SELECT d FROM acq")
def delay_dates(spark, sf):
    files = A.event_days(spark, sf).select(F.concat(F.lit("/g/"), F.date_format("date", "yyyyMMdd"), F.lit(".ztd.tif")).alias("path"))
    return S.GACOS.acquisitions(files).select(F.col("date").alias("d"))


@query("SELECT pair_id, '/b/' || pair_id AS path_unw, '/c/' || pair_id AS path_coh FROM net WHERE i % 4 <> 0 AND j % 5 <> 0 AND (i + j) % 7 <> 0 AND (i + j) % 6 <> 0")
def matched_scenes(spark, sf):
    """Phase and coherence scenes: twice listed, some missing, some unreadable."""
    from ..operators.pairs import edge_index

    net = edge_index(A.event_network(spark, sf))
    unw = net.filter("i % 4 <> 0").select("pair_id", F.explode(F.array(F.lit("/z/"), F.lit("/b/"))).alias("f"), ((F.col("i") + F.col("j")) % 7 != 0).alias("valid"))
    coh = net.filter("j % 5 <> 0").select("pair_id", F.concat(F.lit("/c/"), "pair_id").alias("path"), ((F.col("i") + F.col("j")) % 6 != 0).alias("valid"))
    return R.match_scenes(unw.select("pair_id", F.concat("f", "pair_id").alias("path"), "valid"), coh)


@query("SELECT pair_id, CASE WHEN i % 5 <> 0 THEN CAST(days AS DOUBLE) / 4 END AS baseline FROM net")
def side_car_baselines(spark, sf):
    """Side-car texts with the value, with another, or with no number."""
    from ..operators.pairs import edge_index

    net = edge_index(A.event_network(spark, sf))
    path = F.concat(F.lit("/d/S1AA_"), "pair_id", F.lit("_INT80.txt"))
    value = F.when(F.col("i") % 5 != 0, (F.col("days") / 4).cast("string")).otherwise(F.lit("none"))
    texts = F.array(F.lit("Reference Granule: S1A"), F.concat(F.lit("Baseline: "), value), F.lit("Baseline (later): 7"))
    lines = net.select(path.alias("path"), F.posexplode(texts).alias("line", "value"))
    return S.pair_baselines(net.select(path.alias("path")), lines).select("pair_id", "baseline")


@query(
    "SELECT k.kind, (SELECT min(path) FROM files f WHERE regexp_matches(f.path, k.pattern)) AS path FROM (VALUES ('dem', '[.]hgt[.]tif$'), ('up', '[.]U[.]tif$'), ('east', '[.]E[.]tif$'), ('north', '[.]N[.]tif$'), ('baselines', '/baselines$'), ('polygon', '-poly[.]txt$')) AS k(kind, pattern)",
    files="SELECT '/l/' || lower(replace(n_name, ' ', '_')) || CASE n_nationkey % 4 WHEN 0 THEN '.geo.hgt.tif' WHEN 1 THEN '.geo.U.tif' WHEN 2 THEN '-poly.txt' ELSE '/baselines' END AS path FROM nation",
)
def side_car_files(spark, sf):
    """The first side-car of each kind among files that are named after nations."""
    ends = [F.lit(x) for x in (".geo.hgt.tif", ".geo.U.tif", "-poly.txt", "/baselines")]
    path = F.concat(F.lit("/l/"), F.lower(F.replace("n_name", F.lit(" "), F.lit("_"))), F.element_at(F.array(*ends), (F.col("n_nationkey") % 4 + 1).cast("int")))
    return S.first_matches(A.table(spark, sf, "nation").select(path.alias("path")), S.LICSAR.sidecars)


@query("SELECT page_id, split_part(split_part(url, '/', -1), '.', 1) AS product FROM pages")
def product_of_url(spark, sf):
    return A.table(spark, sf, "pages").select("page_id", S.product_of_url(F.col("url")).alias("product"))


@query(
    "SELECT (SELECT crs FROM f WHERE valid AND crs IS NOT NULL ORDER BY path LIMIT 1) AS crs, (SELECT res FROM f WHERE valid AND res IS NOT NULL ORDER BY path LIMIT 1) AS res, (SELECT nodata FROM f WHERE valid AND nodata IS NOT NULL ORDER BY path LIMIT 1) AS nodata",
    f="SELECT '/' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS path, s_suppkey % 4 = 3 AS valid, CASE WHEN s_suppkey % 3 = 1 THEN 'EPSG:' || (32600 + s_suppkey % 60) END AS crs, CAST(s_suppkey % 7 * 10 AS DOUBLE) AS res, CASE WHEN s_suppkey % 5 = 2 THEN CAST(-s_suppkey AS DOUBLE) END AS nodata FROM supplier",
)
def dataset_attributes(spark, sf):
    """Attributes of the first readable files that have them, of files that are named after suppliers."""
    k = F.col("s_suppkey")
    files = A.table(spark, sf, "supplier").select(
        F.concat(F.lit("/"), F.lpad(k.cast("string"), 9, "0")).alias("path"), (k % 4 == 3).alias("valid"), F.when(k % 3 == 1, F.concat(F.lit("EPSG:"), (k % 60 + 32600).cast("string"))).alias("crs"),
        (k % 7 * 10).cast("double").alias("res"), F.when(k % 5 == 2, -k.cast("double")).alias("nodata"),
    )
    return S.attributes(files, "crs", "res", "nodata")


@query("SELECT n_name AS path, CAST(n_nationkey + 1 AS INTEGER) AS width, CAST(n_nationkey % 5 + 2 AS INTEGER) AS height, CAST(10 AS DOUBLE) - CASE WHEN n_nationkey % 2 = 1 THEN 0.25 ELSE 0 END AS \"left\", CAST(20 + 0.5 * (n_nationkey % 5 + 2) AS DOUBLE) AS top, CAST(0.5 AS DOUBLE) AS xres, CASE WHEN n_nationkey % 3 <> 0 THEN CAST(-9999 AS DOUBLE) END AS nodata FROM nation")
def ascii_grid_header(spark, sf):
    """Headers of grids that are named after nations: by corner or by centre, with and without nodata."""
    k = F.col("n_nationkey")
    lines = F.array(
        F.concat(F.lit("ncols "), (k + 1).cast("string")), F.concat(F.lit("NROWS  "), (k % 5 + 2).cast("string")), F.when(k % 2 == 1, F.lit("xllcenter 10")).otherwise(F.lit("xllcorner 10")),
        F.lit("yllcorner 20"), F.lit("cellsize 0.5"), F.when(k % 3 != 0, F.lit("NODATA_value -9999")), F.lit("1 2 3 4"),
    )
    rows = A.table(spark, sf, "nation").select(F.col("n_name").alias("path"), F.explode(F.array_compact(lines)).alias("value"))
    return O.ascii_header(rows).select("path", "width", "height", "left", "top", "xres", "nodata")


def _cube(spark, sf):
    """Three bands of the image."""
    img = A.image(spark, sf)
    return img.select(F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("band"), "row", "col", "value").withColumn("value", F.col("value") * F.col("band"))


_CUBE = "SELECT b.b AS band, r, c, value * b.b AS value FROM img CROSS JOIN (SELECT unnest([1, 2, 3]) AS b) b"


@query(f"SELECT band, r, c, CAST(((band - 1) * {_H} + r) * 16 + c AS BIGINT) AS bsq, CAST((r * 3 + band - 1) * 16 + c AS BIGINT) AS bil, CAST((r * 16 + c) * 3 + band - 1 AS BIGINT) AS bip FROM cube", cube=_CUBE)
def cube_places(spark, sf):
    return _cube(spark, sf).select("band", F.col("row").cast("long").alias("r"), F.col("col").cast("long").alias("c"), *(R.cell_place(o, 3, A.image_grid(spark, sf).height, 16).cast("long").alias(o.lower()) for o in ("BSQ", "BIL", "BIP")))


@query("SELECT band, r, c, value FROM cube WHERE band IN (1, 3)", cube=_CUBE)
def cube_bands(spark, sf):
    return R.select_bands(_cube(spark, sf), [1, 3]).select("band", F.col("row").cast("long").alias("r"), F.col("col").cast("long").alias("c"), "value")


@query("SELECT count(DISTINCT band) AS n_band, count(DISTINCT r) AS n_row, count(DISTINCT c) AS n_col FROM cube", cube=_CUBE)
def cube_shape(spark, sf):
    return R.shape(_cube(spark, sf), "band", "row", "col")


@query("SELECT band, r, c, value FROM cube UNION ALL SELECT 4, r, c, value FROM img", cube=_CUBE)
def cube_with_band(spark, sf):
    more = R.add_band(_cube(spark, sf), A.image(spark, sf).select("row", "col", "value"))
    return more.select("band", F.col("row").cast("long").alias("r"), F.col("col").cast("long").alias("c"), "value")


@query("SELECT band, r, c, CAST(CAST(value AS FLOAT) AS DOUBLE) AS value FROM cube", cube=_CUBE)
def cube_round_trip(spark, sf):
    """A cube written as bytes, band interleaved by line, and read again."""
    grid = A.image_grid(spark, sf)
    files = K.cube_bytes(_cube(spark, sf), grid, 3, "BIL").select(F.lit("x").alias("path"), "content")
    cells = O.cube_cells(files, grid, 3, "BIL").filter("value is not null")
    return cells.select("band", F.col("row").cast("long").alias("r"), F.col("col").cast("long").alias("c"), "value")


@query(f"SELECT r, c, CAST(c AS DOUBLE) + 0.5 AS lon, {_H} - (CAST(r AS DOUBLE) + 0.5) AS lat FROM img WHERE {_H} - (r + 0.5) BETWEEN 3 AND 9 AND c + 0.5 BETWEEN 2 AND 8")
def cube_coordinates(spark, sf):
    """Selection of a cube by its coordinates."""
    rows = K.with_coordinates(A.image(spark, sf), A.image_grid(spark, sf))
    return O.dimension_select(rows, lat=(3, 9), lon=(2, 8)).select(F.col("row").cast("long").alias("r"), F.col("col").cast("long").alias("c"), "lon", "lat")


@query("SELECT d, CAST(d - DATE '2000-01-01' AS INTEGER) AS days FROM oacq")
def encoded_days(spark, sf):
    return A.order_days(spark, sf).select(F.col("date").alias("d"), K.encoded_days(F.col("date")).alias("days"))


@query("SELECT r, c, coalesce(CASE WHEN (r + c) % 3 <> 0 THEN CAST(r AS INTEGER) END, -2147483648) AS v FROM img")
def nodata_encoded(spark, sf):
    v = F.when((F.col("row") + F.col("col")) % 3 != 0, F.col("row"))
    return A.image(spark, sf).select(F.col("row").cast("long").alias("r"), F.col("col").cast("long").alias("c"), K.with_nodata(v, "int32").cast("int").alias("v"))


@query("SELECT point_id, 'POINT (' || x || ' ' || y || ')' AS wkt FROM pts")
def point_texts(spark, sf):
    return A.points(spark, sf).select("point_id", K.point_wkt(F.col("x"), F.col("y")).alias("wkt"))


_BASE = "SELECT d, CAST((dayofyear(d) * 37 + year(d)) % 211 - 100 AS DOUBLE) / 4 AS value FROM oacq"


def _baselines(spark, sf):
    return A.order_days(spark, sf).select("date", (((F.dayofyear("date") * 37 + F.year("date")) % 211 - 100) / 4).alias("value"))


@query("SELECT pair_id, p AS x0, a.value AS y0, s AS x1, b.value AS y1 FROM onet JOIN base a ON a.d = p JOIN base b ON b.d = s", base=_BASE)
def baseline_lines(spark, sf):
    return K.baseline_plot_table(A.order_network(spark, sf), _baselines(spark, sf))


@query("SELECT round(min(value) - stddev_samp(value) / 3, 6) + 0.0 AS low, round(max(value) + stddev_samp(value) / 3, 6) + 0.0 AS high FROM base", base=_BASE)
def baseline_limits(spark, sf):
    return K.baseline_plot_limits(_baselines(spark, sf)).select((F.round("low", 6) + 0.0).alias("low"), (F.round("high", 6) + 0.0).alias("high"))


def _scenes(spark, sf):
    """Interferograms of neighbouring days, with missing phases, as rasters."""
    rows = A.with_missing(A.stack(spark, sf, 1))
    return rows.select("pair_id", "row", "col", F.col("phase").alias("value"))


_SCENES = "SELECT pair_id, r, c, CAST(CAST(phase AS FLOAT) AS DOUBLE) AS value FROM gaps WHERE j - i = 1"


def _tiffs(spark, sf):
    grid = replace(A.image_grid(spark, sf), crs="EPSG:32646")
    return grid, W.tiff_bytes(_scenes(spark, sf), grid, "pair_id", nodata=-9999.0).select(F.col("pair_id").alias("path"), "content")


@query("SELECT pair_id, r, c, value FROM scenes WHERE value IS NOT NULL", scenes=_SCENES)
def tiff_round_trip(spark, sf):
    """Every scene as a tiled, deflated GeoTIFF, and read again."""
    _, files = _tiffs(spark, sf)
    return T.cells(files).filter("value is not null").select(F.col("path").alias("pair_id"), F.col("row").alias("r"), F.col("col").alias("c"), "value")


@query(f"SELECT pair_id, CAST(r - ({_H} - 12) AS INTEGER) AS r, c - 2 AS c, value FROM scenes WHERE r BETWEEN {_H} - 12 AND {_H} - 1 AND c BETWEEN 2 AND 12 AND value IS NOT NULL", scenes=_SCENES)
def tiff_window(spark, sf):
    """A window of every file; only the blocks that it meets are decoded."""
    _, files = _tiffs(spark, sf)
    return T.cells(files, Box(2.0, 0.0, 13.0, 12.0)).filter("value is not null").select(F.col("path").alias("pair_id"), F.col("row").alias("r"), F.col("col").alias("c"), "value")


@query(f"SELECT pair_id, true AS valid, CAST(16 AS INTEGER) AS width, CAST({_H} AS INTEGER) AS height, CAST(1 AS INTEGER) AS bands, 'EPSG:32646' AS crs, CAST(-9999 AS DOUBLE) AS nodata, CAST({_H} AS DOUBLE) AS top FROM net WHERE j - i = 1")
def tiff_headers(spark, sf):
    """What the files' headers say of grid, system and nodata."""
    _, files = _tiffs(spark, sf)
    return T.headers(files).select(F.col("path").alias("pair_id"), "valid", "width", "height", "bands", "crs", "nodata", "top")


@query(f"SELECT pair_id, CAST(r // 2 AS INTEGER) AS r, CAST(c // 2 AS INTEGER) AS c, round(avg(value), 3) + 0.0 AS value FROM scenes GROUP BY ALL HAVING avg(value) IS NOT NULL", scenes=_SCENES)
def tiff_warped(spark, sf):
    """The files on a grid of cells twice as wide and high, as means."""
    grid, files = _tiffs(spark, sf)
    target = replace(grid, width=8, height=-(-grid.height // 2), xres=2.0, yres=2.0)
    return T.warped(files, target, "average").filter("value is not null").select(F.col("path").alias("pair_id"), F.col("row").alias("r"), F.col("col").alias("c"), (F.round("value", 3) + 0.0).alias("value"))


@query("SELECT r, c, count(phase) FILTER (WHERE j - i = 1) > 0 AS valid FROM gaps GROUP BY r, c HAVING c >= 4")
def mask_of_file(spark, sf):
    """A mask written as a raster of bytes and read again, for the columns from 4 on."""
    grid = A.image_grid(spark, sf)
    known = R.valid_mask(_scenes(spark, sf), value="value").withColumn("value", F.col("valid").cast("double"))
    files = W.tiff_bytes(known, grid, dtype="uint8", nodata=255).select(F.lit("mask").alias("path"), "content")
    found = T.mask(files, grid, Box(4.0, 0.0, 16.0, float(grid.height))).withColumn("col", F.col("col") + 4)
    cells = known.select("row", "col")
    return found.join(cells, ["row", "col"], "left_semi").select(F.col("row").alias("r"), F.col("col").alias("c"), "valid")


_DIMS = {"pair_id": "string", "lat": "double", "lon": "double"}


def _cubes(spark, sf):
    return N.netcdf_bytes(_scenes(spark, sf), A.image_grid(spark, sf), "phase", per_file=8).select(F.concat(F.lit("part"), F.col("part").cast("string")).alias("path"), "content")


@query("SELECT pair_id, r, c, value FROM scenes WHERE value IS NOT NULL", scenes=_SCENES)
def netcdf_round_trip(spark, sf):
    """Every scene as a record of a netCDF cube of several files, and read again by coordinates."""
    grid = A.image_grid(spark, sf)
    rows = C.cells(_cubes(spark, sf), "phase", _DIMS).filter("value is not null")
    return rows.select("pair_id", grid.row(F.col("lat")).alias("r"), grid.col(F.col("lon")).alias("c"), "value")


@query(f"SELECT pair_id, {_H} - (CAST(r AS DOUBLE) + 0.5) AS lat, CAST(c AS DOUBLE) + 0.5 AS lon, value FROM scenes WHERE {_H} - (r + 0.5) BETWEEN 2 AND 9 AND c + 0.5 BETWEEN 3 AND 11 AND value IS NOT NULL", scenes=_SCENES)
def netcdf_selection(spark, sf):
    """A box of the cubes by the labels of their dimensions, chosen before values are read."""
    return C.cells(_cubes(spark, sf), "phase", _DIMS, lat=(2.0, 9.0), lon=(3.0, 11.0)).filter("value is not null").select("pair_id", "lat", "lon", "value")


@query("SELECT path, count(*) AS scenes FROM (SELECT 'part' || ((row_number() OVER (ORDER BY pair_id) - 1) // 8) AS path FROM net WHERE j - i = 1) GROUP BY path")
def netcdf_variables(spark, sf):
    """The number of records of each file of the cube."""
    return C.variables(_cubes(spark, sf)).filter("variable = 'phase'").select("path", F.col("shape")[0].alias("scenes"))


@query("SELECT pair_id, r, c, CASE WHEN isfinite(phase) THEN CAST(CAST(phase AS FLOAT) AS DOUBLE) END AS phase, CAST(CAST(coh AS FLOAT) AS DOUBLE) AS coh FROM gaps WHERE j - i = 1 AND i % 5 <> 0 AND j % 7 <> 0")
def interferogram_files(spark, sf):
    """Phase and coherence files of one product, some of each missing, some broken: pixels of the pairs that have both."""
    grid = A.image_grid(spark, sf)
    rows = A.with_missing(A.stack(spark, sf, 1))

    def files(value, some, end):
        made = W.tiff_bytes(rows.filter(some).select("pair_id", "row", "col", F.col(value).alias("value")), grid, "pair_id")
        return made.select(F.concat(F.lit("/p/S1AA_"), F.replace("pair_id", F.lit("_"), F.lit("T101112_")), F.lit(f"T101112_VVP012_INT80_{end}.tif")).alias("path"), "content")

    broken = files("coh", "i % 5 = 0", "unw_phase").select("path", F.substring("content", 1, 20).alias("content"))
    every = files("phase", "i % 5 <> 0", "unw_phase").union(files("coh", "j % 7 <> 0", "corr")).union(broken)
    every = every.repartition(4 * spark.sparkContext.defaultParallelism, "path")  # a row a file; every task of a persisted table sends the metrics of its whole plan
    return T.interferograms(every.persist(), S.HYP3).filter("coh is not null").withColumnsRenamed(_RC).select("pair_id", "r", "c", "phase", "coh")


@query("SELECT pair_id, r, c, CAST(CAST(round((phase - m) * 1000) AS FLOAT) AS DOUBLE) AS value FROM ifg JOIN ref USING (pair_id) WHERE j - i = 1", ref="SELECT pair_id, avg(phase) AS m FROM ifg WHERE u % 10 = 3 GROUP BY pair_id")
def rereferenced_files(spark, sf):
    """Scenes less their reference mean, in thousandths, exported as files and read again."""
    rows = A.stack(spark, sf, 1)
    user = F.col("row") * A.COLUMNS + F.col("col")
    points = rows.select("row", "col").distinct().filter(user % 10 == 3)
    value = R.rereference(rows, points).select("pair_id", "row", "col", F.round(F.col("phase") * 1000).alias("value"))
    files = W.tiff_bytes(value, A.image_grid(spark, sf), "pair_id").select(F.col("pair_id").alias("path"), "content")
    return T.cells(files).filter("value is not null").select(F.col("path").alias("pair_id"), F.col("row").alias("r"), F.col("col").alias("c"), "value")
