"""Queries on interferogram stacks, inversion, models and uncertainty."""

from __future__ import annotations

import math
from datetime import date, timedelta

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import adapters as A
from ..functions import phase as H
from ..operators import loops as L
from ..operators import pairs as P
from ..operators import raster as R
from ..plans import clusters as C
from ..plans import inversion as I
from ..plans import models as M
from ..plans import uncertainty as U
from ..streaming import incremental as X
from .registry import SQL, query

_RC = {"row": "r", "col": "c"}
_MM = H.SENTINEL1.millimetres


def _r(column: str | F.Column, digits: int = 6) -> F.Column:
    """Rounded, without a negative zero."""
    return F.round(column, digits) + F.lit(0.0)


def _reference(rows: DataFrame) -> DataFrame:
    """Reference pixels: the users whose number leaves 3 modulo 10."""
    user = F.col("row") * A.COLUMNS + F.col("col")
    return rows.select("row", "col").distinct().filter(user % 10 == 3)


@query("SELECT pair_id, round(avg(phase), 6) + 0.0 AS reference FROM ifg WHERE u % 10 = 3 GROUP BY pair_id")
def reference_mean(spark, sf):
    rows = A.stack(spark, sf)
    return R.reference_mean(rows, _reference(rows)).select("pair_id", _r("reference").alias("reference"))


_REF = "SELECT pair_id, avg(phase) AS m FROM ifg WHERE u % 10 = 3 GROUP BY pair_id"


@query("SELECT pair_id, r, c, round(phase - m, 6) + 0.0 AS phase FROM ifg JOIN ref USING (pair_id)", ref=_REF)
def rereferenced_phase(spark, sf):
    rows = A.stack(spark, sf)
    return R.rereference(rows, _reference(rows)).withColumnsRenamed(_RC).select("pair_id", "r", "c", _r("phase").alias("phase"))


@query(f"SELECT pair_id, r, c, round((phase - m) * CAST({_MM!r} AS DOUBLE) / cos(CAST(r + c AS DOUBLE) / 100), 6) + 0.0 AS deformation FROM ifg JOIN ref USING (pair_id)", ref=_REF)
def line_of_sight_deformation(spark, sf):
    rows = A.stack(spark, sf)
    angle = rows.select("row", "col").distinct().withColumn("angle", (F.col("row") + F.col("col")) / 100)
    return R.deformation(rows.select("pair_id", "row", "col", "phase"), _reference(rows), H.SENTINEL1, angle).withColumnsRenamed(_RC).select("pair_id", "r", "c", _r("deformation").alias("deformation"))


@query(f"SELECT pair_id, r, c, round(phase * CAST({_MM!r} AS DOUBLE), 6) + 0.0 AS mm, round(phase / CAST({_MM!r} AS DOUBLE), 6) + 0.0 AS radians FROM ifg")
def phase_to_mm(spark, sf):
    p = F.col("phase")
    return A.stack(spark, sf).select("pair_id", F.col("row").alias("r"), F.col("col").alias("c"), _r(H.phase_to_deformation(p)).alias("mm"), _r(H.deformation_to_phase(p)).alias("radians"))


@query("SELECT pair_id, r, c, round(phase - 2 * pi() * floor(phase / (2 * pi())), 6) + 0.0 AS wrapped FROM ifg")
def wrapped_phase(spark, sf):
    return A.stack(spark, sf).select("pair_id", F.col("row").alias("r"), F.col("col").alias("c"), _r(H.wrap_phase(F.col("phase"))).alias("wrapped"))


@query("SELECT r, c, round(avg((greatest(0.1, least(0.9, coh)) - 0.1) / CAST(0.8 AS DOUBLE)), 6) + 0.0 AS coh_mean FROM ifg GROUP BY r, c")
def coherence_mean(spark, sf):
    return R.coherence_mean(A.stack(spark, sf), 0.1, 0.9).withColumnsRenamed(_RC).select("r", "c", _r("coh_mean").alias("coh_mean"))


@query("SELECT r, c, CAST(count(*) - count(phase) AS BIGINT) AS n_missing FROM gaps GROUP BY r, c")
def missing_count(spark, sf):
    return R.missing_count(A.with_missing(A.stack(spark, sf))).withColumnsRenamed(_RC)


@query("SELECT r, c, bool_or(phase IS NOT NULL) AS valid FROM gaps GROUP BY r, c")
def valid_mask(spark, sf):
    return R.valid_mask(A.with_missing(A.stack(spark, sf))).withColumnsRenamed(_RC)


@query("SELECT pair_id, r, c, CASE WHEN coh >= 0.4 THEN phase END AS phase FROM ifg")
def coherent_phase(spark, sf):
    return A.stack(spark, sf).select("pair_id", F.col("row").alias("r"), F.col("col").alias("c"), H.coherent(F.col("phase"), F.col("coh"), 0.4).alias("phase"))


@query("SELECT pair_id, CAST(r // 2 AS BIGINT) AS r, CAST(c // 4 AS BIGINT) AS c, round(avg(phase), 6) + 0.0 AS phase FROM gaps GROUP BY ALL")
def multilook(spark, sf):
    rows = A.with_missing(A.stack(spark, sf))
    return R.multilook(rows, 2, 4, "pair_id", value="phase").select("pair_id", F.col("row").cast("long").alias("r"), F.col("col").cast("long").alias("c"), _r("phase").alias("phase"))


@query("SELECT pair_id, a.r, a.c, round(CAST(a.cents - b.cents AS DOUBLE) / 100 - m, 6) + 0.0 AS aps FROM net JOIN surf a ON a.d = p JOIN surf b ON b.d = s AND b.u = a.u JOIN refs USING (pair_id) WHERE day(p) % 7 <> 0 AND day(s) % 7 <> 0", refs="SELECT pair_id, avg(CAST(a.cents - b.cents AS DOUBLE) / 100) AS m FROM net JOIN surf a ON a.d = p JOIN surf b ON b.d = s AND b.u = a.u WHERE a.u % 10 = 3 GROUP BY pair_id")
def atmosphere_pairs(spark, sf):
    delays = A.surface(spark, sf).filter(F.dayofmonth("date") % 7 != 0).select("date", "row", "col", (F.col("cents") / 100).alias("value"))
    return R.atmosphere_pairs(delays, A.event_network(spark, sf), _reference(delays)).withColumnsRenamed(_RC).select("pair_id", "r", "c", _r("aps").alias("aps"))


@query("SELECT pair_id FROM net WHERE day(p) % 7 = 0 OR day(s) % 7 = 0")
def pairs_without_delay(spark, sf):
    delays = A.event_days(spark, sf).filter(F.dayofmonth("date") % 7 != 0)
    return R.pairs_without_delay(delays, A.event_network(spark, sf)).select("pair_id")


_BASE = "SELECT d, CAST((dayofyear(d) * 37 + year(d)) % 211 - 100 AS DOUBLE) / 4 AS value FROM oacq"


def _baselines(spark: SparkSession, sf: str) -> DataFrame:
    return A.order_days(spark, sf).select("date", (((F.dayofyear("date") * 37 + F.year("date")) % 211 - 100) / 4).alias("value"))


@query("SELECT pair_id, b.value - a.value AS baseline FROM onet JOIN base a ON a.d = p JOIN base b ON b.d = s", base=_BASE)
def baselines_of_pairs(spark, sf):
    return R.baselines_of_pairs(_baselines(spark, sf), A.order_network(spark, sf))


@query("SELECT d, CAST(cents AS DOUBLE) / 100 - (SELECT CAST(cents AS DOUBLE) / 100 FROM surf WHERE u = (SELECT min(u) FROM surf) AND k = 0) AS value FROM surf WHERE u = (SELECT min(u) FROM surf)")
def baselines_from_pairs(spark, sf):
    """Values of pairs of one user; they are consistent, so the dates' values come back exactly."""
    cells = A.surface(spark, sf)
    one = cells.agg(F.min(F.struct("row", "col")).alias("m")).select("m.*")
    values = cells.join(one, ["row", "col"]).select("date", (F.col("cents") / 100).alias("value"))
    net = A.event_network(spark, sf)
    rows = net.join(R.baselines_of_pairs(values, net), "pair_id")
    return I.baselines_from_pairs(rows, gamma=1e-9).select(F.col("date").alias("d"), (F.round("value", 2) + 0.0).alias("value"))


SQL["baselines_from_pairs"] = SQL["baselines_from_pairs"].replace("SELECT d, CAST(cents AS DOUBLE) / 100 - (", "SELECT d, round(CAST(cents AS DOUBLE) / 100 - (").replace(" AS value FROM surf WHERE u = (SELECT min(u) FROM surf)", ", 2) + 0.0 AS value FROM surf WHERE u = (SELECT min(u) FROM surf)")


def _series(spark: SparkSession, sf: str, rows: DataFrame) -> tuple[I.Network, DataFrame]:
    net = I.Network.of(A.event_network(spark, sf))
    return net, I.series(rows, net, "row", "col")


@query("SELECT r, c, d, round(CAST(cents - lag(cents) OVER (PARTITION BY u ORDER BY d) AS DOUBLE) / 100, 4) + 0.0 AS increment FROM surf QUALIFY k > 0")
def sbas_increments(spark, sf):
    net, pixels = _series(spark, sf, A.stack(spark, sf))
    found = I.increments_table(I.invert(pixels, I.sbas(net), "row", "col"), net, "row", "col")
    return found.select(F.col("row").alias("r"), F.col("col").alias("c"), F.col("date").alias("d"), _r("increment", 4).alias("increment"))


@query("SELECT r, c, d, round(CAST(cents - lag(cents) OVER (PARTITION BY u ORDER BY d) AS DOUBLE) / 100, 4) + 0.0 AS increment FROM surf QUALIFY k > 0")
def sbas_increments_with_gaps(spark, sf):
    """With a tenth of the phases missing, what is left still determines every pixel."""
    net, pixels = _series(spark, sf, A.with_missing(A.stack(spark, sf)))
    found = I.increments_table(I.invert(pixels, I.sbas(net), "row", "col"), net, "row", "col")
    return found.select(F.col("row").alias("r"), F.col("col").alias("c"), F.col("date").alias("d"), _r("increment", 4).alias("increment"))


@query("SELECT r, c, d, round(CAST(cents - first(cents) OVER (PARTITION BY u ORDER BY d) AS DOUBLE) / 100, 4) + 0.0 AS deformation FROM surf")
def cumulative_deformation(spark, sf):
    """The flagship: network, interferograms, inversion and cumulative deformation."""
    net, pixels = _series(spark, sf, A.stack(spark, sf))
    found = I.cumulative(I.invert(pixels, I.sbas(net), "row", "col"), net, "row", "col")
    return found.select(F.col("row").alias("r"), F.col("col").alias("c"), F.col("date").alias("d"), _r("deformation", 4).alias("deformation"))


def _days(n: int = 30) -> I.Network:
    """The network of the event days, which are the first n days of 2024, known without data for the SQL's constants."""
    days = tuple(date(2024, 1, 1) + timedelta(k) for k in range(n))
    return I.Network(days, tuple((i, j) for i in range(n) for j in range(i + 1, min(i + 4, n))))


def _values(matrix: np.ndarray, columns: list[str], first: str) -> str:
    """A matrix as SQL rows (first, name, value)."""
    rows = (f"({i}, '{name}', CAST({float(v)!r} AS DOUBLE))" for i, line in enumerate(matrix) for name, v in zip(columns, line, strict=True) if v)
    return f"SELECT * FROM (VALUES {', '.join(rows)}) AS t({first}, pair_id, value)"


def _model_query(name: str, model: M.Model, digits: int = 4) -> None:
    net = _days()
    design = I.nsbas(net, model, gamma=1e-2)
    inverse = np.linalg.pinv(design.g, rcond=1e-14)[design.increments :, : design.pairs]
    cases = ", ".join(f"round(sum(phase * m.value) FILTER (m.k = {k}), {digits}) + 0.0 AS {p}" for k, p in enumerate(model.parameters))
    sql = f"SELECT r, c, {cases} FROM ifg JOIN m USING (pair_id) GROUP BY r, c"

    @query(sql, name, m=_values(inverse, net.names, "k"))
    def run(spark, sf):
        network, pixels = _series(spark, sf, A.stack(spark, sf))
        solved = I.invert(pixels, I.nsbas(network, model, gamma=1e-2), "row", "col")
        return solved.select(F.col("row").alias("r"), F.col("col").alias("c"), *(_r(F.col("parameters")[k], digits).alias(p) for k, p in enumerate(model.parameters)))


_model_query("nsbas_linear", M.LINEAR)
_model_query("nsbas_quadratic", M.QUADRATIC)


_NET = _days()
_LINEAR = I.nsbas(_NET, M.LINEAR, gamma=1e-2)
_MISFIT = (np.eye(len(_LINEAR.g)) - _LINEAR.g @ np.linalg.pinv(_LINEAR.g, rcond=1e-14))[:, : _LINEAR.pairs]


@query("SELECT r, c, round(max(abs(x)) FILTER (k < " + str(_LINEAR.pairs) + "), 5) + 0.0 AS residual_pair, round(max(abs(x)) FILTER (k >= " + str(_LINEAR.pairs) + "), 4) + 0.0 AS residual_model FROM (SELECT r, c, m.k, sum(phase * m.value) AS x FROM ifg JOIN m USING (pair_id) GROUP BY ALL) GROUP BY r, c", m=_values(_MISFIT, _NET.names, "k"))
def nsbas_residuals(spark, sf):
    """Largest residuals of the pairs and of the model rows, a pixel: what the projection off the design's columns leaves."""
    net, pixels = _series(spark, sf, A.stack(spark, sf))
    solved = I.invert(pixels, I.nsbas(net, M.LINEAR, gamma=1e-2), "row", "col")
    largest = lambda c: F.array_max(F.transform(F.filter(c, lambda x: x.isNotNull()), F.abs))
    return solved.select(F.col("row").alias("r"), F.col("col").alias("c"), _r(largest("residual_pair"), 5).alias("residual_pair"), _r(largest("residual_model"), 4).alias("residual_model"))


@query("SELECT loop_id, r, c, round(2 * pi() * (e1 + e2 - e3), 4) + 0.0 AS closure FROM w", w="SELECT strftime(a.p, '%Y%m%d') || '_' || strftime(a.s, '%Y%m%d') || '_' || strftime(b.s, '%Y%m%d') AS loop_id, u.r, u.c, CASE WHEN a.j - a.i > 1 THEN (u.u + a.i + a.j) % 3 - 1 ELSE 0 END AS e1, CASE WHEN b.j - b.i > 1 THEN (u.u + b.i + b.j) % 3 - 1 ELSE 0 END AS e2, CASE WHEN c.j - c.i > 1 THEN (u.u + c.i + c.j) % 3 - 1 ELSE 0 END AS e3 FROM net a JOIN net b ON a.s = b.p JOIN net c ON c.p = a.p AND c.s = b.s CROSS JOIN (SELECT DISTINCT u, r, c FROM surf) u")
def triplet_closures(spark, sf):
    """Closures of phases with whole cycles added; without them they are 0."""
    net, pixels = _series(spark, sf, A.with_cycles(A.stack(spark, sf)))
    found = I.closures(pixels, L.triplet_paths(L.triplets(A.event_network(spark, sf))), net, "row", "col")
    return found.select("loop_id", F.col("row").alias("r"), F.col("col").alias("c"), _r("closure", 4).alias("closure"))


@query("SELECT pair_id, r, c, CAST(CASE WHEN j - i > 1 THEN (u + i + j) % 3 - 1 ELSE 0 END AS DOUBLE) AS u FROM ifg")
def unwrap_errors(spark, sf):
    """The added cycles, found again from the loops' closures."""
    network = A.event_network(spark, sf)
    found = L.loops(network, 4, edge_days=1)
    net, pixels = _series(spark, sf, A.with_cycles(A.stack(spark, sf)))
    u = I.unwrap_errors(pixels, found, net, "row", "col")
    names = F.array(*(F.lit(n) for n in net.names))
    rows = u.select("row", "col", F.inline(F.arrays_zip(names.alias("pair_id"), F.col("u").alias("u"))))
    return rows.select("pair_id", F.col("row").alias("r"), F.col("col").alias("c"), _r(F.rint("u"), 1).alias("u"))


@query("SELECT pair_id, r, c, round(phase, 4) + 0.0 AS phase FROM ifg")
def unwrap_corrected(spark, sf):
    """Phases with the added cycles taken off again."""
    net, pixels = _series(spark, sf, A.with_cycles(A.stack(spark, sf)))
    fixed = I.unwrap_corrected(pixels, I.unwrap_errors(pixels, L.loops(A.event_network(spark, sf), 4, edge_days=1), net, "row", "col"), "row", "col")
    names = F.array(*(F.lit(n) for n in net.names))
    rows = fixed.select("row", "col", F.inline(F.arrays_zip(names.alias("pair_id"), F.col("d").alias("phase"))))
    return rows.select("pair_id", F.col("row").alias("r"), F.col("col").alias("c"), _r("phase", 4).alias("phase"))


def _block(name: str, model: M.Model, columns: dict[str, str]) -> None:
    cases = " UNION ALL ".join(f"SELECT d, '{p}' AS param, round({e}, 6) + 0.0 AS value FROM spans" for p, e in columns.items())

    @query(cases, name, spans="SELECT d, CAST(d - (SELECT min(d) FROM oacq) AS DOUBLE) AS t FROM oacq")
    def run(spark, sf):
        return M.block_table(A.order_days(spark, sf), model).select(F.col("date").alias("d"), "param", _r("value").alias("value"))


_W = f"CAST({2 * math.pi / M.YEAR!r} AS DOUBLE)"
_block("block_linear", M.LINEAR, {"velocity": "t", "constant": "CAST(1 AS DOUBLE)"})
_block("block_quadratic", M.QUADRATIC, {"acceleration": "t * t", "velocity": "t", "constant": "CAST(1 AS DOUBLE)"})
_block("block_cubic", M.CUBIC, {"change": "t * t * t", "acceleration": "t * t", "velocity": "t", "constant": "CAST(1 AS DOUBLE)"})
_block("block_annual", M.ANNUAL, {"sin": f"sin({_W} * t)", "cos": f"cos({_W} * t)", "velocity": "t", "constant": "CAST(1 AS DOUBLE)"})
_block("block_semiannual", M.SEMIANNUAL, {"sin": f"sin({_W} * t)", "cos": f"cos({_W} * t)", "sin2": f"sin(2 * {_W} * t)", "cos2": f"cos(2 * {_W} * t)", "velocity": "t", "constant": "CAST(1 AS DOUBLE)"})


@query("SELECT r, c, round(regr_slope(CAST(cents AS DOUBLE) / 100, CAST(k AS DOUBLE)), 4) + 0.0 AS velocity, round(regr_intercept(CAST(cents AS DOUBLE) / 100, CAST(k AS DOUBLE)), 4) + 0.0 AS constant FROM surf GROUP BY r, c")
def linear_fit(spark, sf):
    days = P.indexed(A.event_days(spark, sf), "date")
    rows = A.surface(spark, sf).join(F.broadcast(days), "date").select("row", "col", F.col("idx").cast("double").alias("span"), (F.col("cents") / 100).alias("value"))
    return M.linear_fit(rows, "row", "col").select(F.col("row").alias("r"), F.col("col").alias("c"), _r("velocity", 4).alias("velocity"), _r("constant", 4).alias("constant"))


@query("SELECT pair_id, r, c, round(2 * sqrt(phase * phase + coh * coh), 6) + 0.0 AS amplitude FROM ifg")
def seasonal_amplitude(spark, sf):
    return A.stack(spark, sf).select("pair_id", F.col("row").alias("r"), F.col("col").alias("c"), _r(H.seasonal_amplitude(F.col("phase"), F.col("coh"))).alias("amplitude"))


@query("SELECT a.pair_id AS a, b.pair_id AS b, round(covar_samp(a.phase, b.phase), 5) + 0.0 AS covariance FROM ifg a JOIN ifg b ON a.u = b.u WHERE a.u % 10 = 3 GROUP BY ALL")
def reference_covariance(spark, sf):
    rows = A.stack(spark, sf)
    user = F.col("row") * A.COLUMNS + F.col("col")
    samples = rows.filter(user % 10 == 3).select("pair_id", user.alias("point_id"), F.col("phase").alias("value"))
    return R.sample_covariance(samples).select("a", "b", _r("covariance", 5).alias("covariance"))


@query("SELECT pair_id, round(var_samp(phase), 5) + 0.0 AS variance, round(1 / sqrt(var_samp(phase)), 8) + 0.0 AS weight FROM ifg WHERE u % 10 = 3 GROUP BY pair_id")
def reference_variance(spark, sf):
    rows = A.stack(spark, sf)
    samples = rows.join(_reference(rows), ["row", "col"], "left_semi").select("pair_id", F.col("phase").alias("value"))
    found = R.sample_variance(samples)
    return found.select("pair_id", _r("variance", 5).alias("variance"), _r(U.weight(F.col("variance")), 8).alias("weight"))


def _variances(rows: DataFrame) -> DataFrame:
    return rows.withColumn("variance", F.col("coh") + 0.5)


@query("SELECT pair_id, r, c, round(coh + 0.5 + coh + 1, 6) + 0.0 AS variance FROM ifg")
def variance_sum(spark, sf):
    a = _variances(A.stack(spark, sf)).select("pair_id", "row", "col", "variance")
    b = A.stack(spark, sf).select("pair_id", "row", "col", (F.col("coh") + 1).alias("variance"))
    return U.add(a, b, "pair_id", "row", "col").select("pair_id", F.col("row").alias("r"), F.col("col").alias("c"), _r("variance").alias("variance"))


_SQUARE = U.gain(_NET.matrix()) ** 2


@query("SELECT r, c, m.k AS parameter, round(sum((coh + 0.5) * m.value), 6) + 0.0 AS variance FROM ifg JOIN m USING (pair_id) GROUP BY ALL", m=_values(_SQUARE, _NET.names, "k"))
def variance_of_increments(spark, sf):
    """Data variances to variances of the increments, by the gain's squares; rows by pixel in Arrow batches."""
    net, pixels = _series(spark, sf, _variances(A.stack(spark, sf)).withColumn("phase", F.col("variance")))
    rows = U.parameters(pixels.withColumnRenamed("d", "variance"), net.matrix(), "row", "col")
    return rows.select(F.col("row").alias("r"), F.col("col").alias("c"), F.posexplode("variance").alias("parameter", "v")).select("r", "c", "parameter", _r("v").alias("variance"))


@query("SELECT r, c, m.k AS parameter, round(sum((coh + 0.5) * m.value), 6) + 0.0 AS variance FROM ifg JOIN m USING (pair_id) GROUP BY ALL", m=_values(_SQUARE, _NET.names, "k"))
def variance_by_join(spark, sf):
    """The same by a join with the gain's squares and a sum, without Python."""
    net = I.Network.of(A.event_network(spark, sf))
    square = U.gain(net.matrix()) ** 2
    rows = [(n, k, float(square[k, j])) for j, n in enumerate(net.names) for k in range(len(square))]
    matrix = F.broadcast(spark.createDataFrame(rows, "pair_id string, parameter int, square double"))
    found = U.propagate_table(_variances(A.stack(spark, sf)).select("pair_id", "row", "col", "variance"), matrix, "row", "col")
    return found.select(F.col("row").alias("r"), F.col("col").alias("c"), "parameter", _r("variance").alias("variance"))


@query("SELECT r, c, m.k AS parameter, round(m.value * CAST(1 + (r + c) % 5 AS DOUBLE), 6) + 0.0 AS variance FROM (SELECT DISTINCT r, c FROM surf) CROSS JOIN m", m=_values(U.unit_variances(_NET.matrix())[:, None], ["all"], "k"))
def variance_common(spark, sf):
    pixels = A.surface(spark, sf).select("row", "col").distinct().withColumn("variance", (1 + (F.col("row") + F.col("col")) % 5).cast("double"))
    rows = U.parameters_of_common_variance(pixels, I.Network.of(A.event_network(spark, sf)).matrix(), "row", "col")
    return rows.select(F.col("row").alias("r"), F.col("col").alias("c"), "parameter", _r("variance").alias("variance"))


def _weighted() -> np.ndarray:
    """Variances of the increments for each of the 101 patterns of coherence that users have, from the normal equations."""
    g, out = _NET.matrix(), []
    for k in range(101):
        v = np.array([(k * 7 + i * 3 + j * 5) % 101 / 100 + 0.5 for i, j in _NET.pairs])
        out.append(np.diag(np.linalg.inv(g.T @ (g / v[:, None]))))
    return np.array(out).T


@query("SELECT r, c, m.k AS parameter, round(m.value, 6) + 0.0 AS variance FROM (SELECT DISTINCT u, r, c FROM surf) JOIN m ON CAST(m.pair_id AS BIGINT) = u % 101", m=_values(_weighted(), [str(k) for k in range(101)], "k"))
def variance_weighted(spark, sf):
    """Each pixel with its own weights."""
    net, pixels = _series(spark, sf, _variances(A.stack(spark, sf)).withColumn("phase", F.col("variance")))
    rows = U.parameters_weighted(pixels.withColumnRenamed("d", "variance"), net.matrix(), "row", "col")
    return rows.select(F.col("row").alias("r"), F.col("col").alias("c"), F.posexplode("variance").alias("parameter", "v")).select("r", "c", "parameter", _r("v").alias("variance"))


_SUMS = U.gain(_NET.matrix()).sum(1)[:, None] ** 2


@query("SELECT r, c, s.k AS parameter, round(v + s.value / 4, 6) + 0.0 AS variance FROM (SELECT r, c, m.k, sum((coh + 0.5) * m.value) AS v FROM ifg JOIN m USING (pair_id) GROUP BY ALL) x JOIN s ON s.k = x.k", m=_values(_SQUARE, _NET.names, "k"), s="SELECT k, value FROM (" + ", ".join(["SELECT * FROM (VALUES " + ", ".join(f"({k}, CAST({float(v)!r} AS DOUBLE))" for k, v in enumerate(_SUMS[:, 0])) + ") AS t(k, value)"]) + ")")
def variance_of_covariance(spark, sf):
    """Pixels with a covariance matrix each: their variances, and 1/4 that all pairs have in common."""
    net, pixels = _series(spark, sf, _variances(A.stack(spark, sf)).withColumn("phase", F.col("variance")))
    n = len(net.pairs)
    row = lambda v, i: F.concat(F.array_repeat(F.lit(0.25), i), F.array(v + 0.25), F.array_repeat(F.lit(0.25), n - 1 - i))
    full = pixels.select("row", "col", F.flatten(F.transform("d", row)).alias("covariance"))
    rows = U.parameters_of_covariance(full, net.matrix(), "row", "col")
    return rows.select(F.col("row").alias("r"), F.col("col").alias("c"), F.posexplode("variance").alias("parameter", "v")).select("r", "c", "parameter", _r("v").alias("variance"))


@query()
def temperature_clusters(spark, sf):
    """Ward clusters of users by two sums; no SQL, as merging is iterative."""
    rows = A.surface(spark, sf).groupBy("row", "col").agg(F.max("cents").alias("a"), F.min("cents").alias("b"))
    index = rows.select("row", "col", (F.col("a") / 100).alias("ti"), (F.col("b") / 100).alias("fi"))
    return C.temperature_clusters(index, 5000.0, "row", "col")



@query("SELECT CAST(date_trunc('day', ts) AS DATE) AS d, count(*) AS n, CAST(sum(CASE WHEN CAST(round(value * 100) AS BIGINT) % 7 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_missing FROM events GROUP BY 1")
def windows_of_arrivals(spark, sf):
    """Daily windows of arriving pixels and how many have no value; the same plan runs on a stream."""
    cents = F.round(F.col("value") * 100).cast("long")
    rows = A.table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("seen"), F.when(cents % 7 != 0, F.col("value")).alias("phase"))
    return X.windowed_missing(rows).select(F.to_date("start").alias("d"), "n", "n_missing")


@query("SELECT r, c, round(regr_slope(CAST(cents AS DOUBLE) / 100, CAST(k AS DOUBLE)), 4) + 0.0 AS velocity, round(regr_intercept(CAST(cents AS DOUBLE) / 100, CAST(k AS DOUBLE)), 4) + 0.0 AS constant FROM surf GROUP BY r, c")
def running_lines(spark, sf):
    """Lines from running sums, which add up over the batches of a stream."""
    days = P.indexed(A.event_days(spark, sf), "date")
    rows = A.surface(spark, sf).join(F.broadcast(days), "date").select("row", "col", F.col("idx").cast("double").alias("span"), (F.col("cents") / 100).alias("value"))
    return X.line_of_sums(X.line_sums(rows, "row", "col"), "row", "col").select(F.col("row").alias("r"), F.col("col").alias("c"), _r("velocity", 4).alias("velocity"), _r("constant", 4).alias("constant"))
