"""Known results for a network of ten pairs of six dates, and laws of the pair algebra."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from stackwave.functions import dates as D
from stackwave.functions.phase import SENTINEL1, Radar, wavelength
from stackwave.operators import loops as L
from stackwave.operators import network as N
from stackwave.operators import pairs as P
from stackwave.plans import inversion as I
from stackwave.plans import models as M

#: Rows of the design matrix of the ten-pair network.
ROWS = ("10000", "11000", "11100", "01000", "01100", "01110", "00100", "00110", "00111", "00010")
DAYS = [dt.date(2017, 1, 11), dt.date(2017, 2, 4), dt.date(2017, 2, 22), dt.date(2017, 3, 18), dt.date(2017, 3, 30), dt.date(2017, 4, 11)]


@pytest.fixture(scope="module")
def ten(spark):
    rows = [(DAYS[r.index("1")], DAYS[r.rindex("1") + 1]) for r in ROWS]
    return P.pairs(spark.createDataFrame(rows, "primary date, secondary date")).cache()


def test_design_matrix(ten):
    net = I.Network.of(ten)
    assert ["".join(str(int(v)) for v in r) for r in net.matrix()] == list(ROWS)
    assert I.nsbas(net, M.ANNUAL).g.shape == (16, 9)


def test_triplets_and_loops(ten):
    assert L.triplets(ten).count() == 7
    for edge, counts in ((24, (3, 5, 5)), (36, (3, 5, 5)), (48, (4, 6, 6))):
        assert tuple(L.loops(ten, k, edge_days=edge).count() for k in (3, 4, 5)) == counts
    assert L.loops(ten, 5, edge_days=12).count() == 0
    names = sorted(r["loop_id"] for r in L.loops(ten, 4, edge_days=24).collect())
    short = [n.replace("2017", "") for n in names]
    assert short == ["0111_0204_0222", "0111_0204_0222_0318", "0204_0222_0318", "0204_0222_0318_0330", "0222_0318_0330"]
    with pytest.raises(ValueError):
        L.loops(ten, 4)


def test_gaps(ten):
    assert [r["date"] for r in P.gaps(ten, ten.filter("days > 24")).collect()] == [DAYS[5]]


def test_linear_inversion(spark, ten):
    net = I.Network.of(ten)
    value = 0.05 * F.col("days")
    pixels = I.series(ten.select("pair_id", F.lit(1).alias("px"), value.alias("phase")), net, "px")
    got = I.invert(pixels, I.nsbas(net), "px").first()
    assert np.allclose(got["increments"], [1.2, 0.9, 1.2, 0.6, 0.6], atol=1e-6) and np.allclose(got["parameters"], [-0.05, 0], atol=1e-5)
    some = ten.filter("pair_id <> '20170222_20170411'")
    pixels = I.series(some.select("pair_id", F.lit(1).alias("px"), value.alias("phase")), net, "px")
    got = I.invert(pixels, I.nsbas(net), "px").first()
    assert np.allclose(got["increments"], [1.2, 0.9, 1.2, 0.6, 0.6], atol=1e-4)


def test_unsolvable_pixels_are_null():
    g = np.vstack([np.eye(3), np.ones((1, 3))])
    d = np.array([[1, np.nan, np.nan, 1], [2, 2, np.nan, 1], [3, 3, np.nan, 1], [6, 5, np.nan, 3.0]])
    x = I.solve(g, d)
    assert np.allclose(x[:, 0], [1, 2, 3]) and np.isnan(x[:, 1]).all() and np.isnan(x[:, 2]).all() and np.allclose(x[:, 3], 1)
    singular = np.array([[1.0, 1], [2, 2], [3, 3]])
    assert np.isnan(I.solve(singular, np.ones((3, 2)))).all()


def test_cadence_of_twelve_days(spark):
    days = spark.sql("SELECT explode(sequence(date'2020-01-01', date'2024-12-31', interval 12 days)) AS date")
    assert days.count() == 153 and N.from_interval(days, 3).count() == 453
    assert N.from_interval(days, 3, max_day=24).count() == 152


def test_algebra_laws(spark, ten):
    a, b = ten.filter("days < 45"), ten.filter("days > 20")

    def ids(df):
        return sorted(r["pair_id"] for r in df.collect())

    assert sorted(ids(P.intersect(a, b)) + ids(P.difference(a, b))) == ids(a)
    assert ids(P.union(a, b)) == sorted({*ids(a), *ids(b)})
    assert P.equal(ten, P.union(a, b)).first()["equal"] and not P.equal(a, b).first()["equal"]
    none = ten.limit(0)
    assert ids(P.union(none, a)) == ids(a) and ids(P.difference(a, none)) == ids(a) and P.acquisitions(none).count() == 0
    assert L.triplets(none).count() == 0 and P.gaps(none).count() == 0


def test_pairs_are_canonical(spark):
    rows = [(DAYS[1], DAYS[0]), (DAYS[0], DAYS[1]), (DAYS[2], DAYS[2]), (None, DAYS[0])]
    got = P.pairs(spark.createDataFrame(rows, "primary date, secondary date")).collect()
    assert [(r["primary"], r["days"]) for r in got] == [(DAYS[0], 24)]


def test_slices(ten):
    assert P.between(ten, "2017-02", "2017-04").count() == 6
    assert P.between(ten, None, "2017-03-18").count() == 6
    assert P.at_positions(ten, -2).count() == 2 and P.at_positions(ten, 0, 5, 2).count() == 3
    with pytest.raises(ValueError):
        P.between(ten, "2018", "2017")


def test_names_and_seasons(spark):
    one = spark.createDataFrame([("S1_20170111_20170204",)], "name string")
    assert one.select(D.names_to_dates(F.col("name"), 2)).first()[0] == DAYS[:2]
    with pytest.raises(PySparkException):
        one.select(D.names_to_dates(F.lit("20170111"), 2)).collect()
    months = spark.range(1, 13).select(D.season_of_month(F.col("id")).alias("s"))
    assert [r["s"] for r in months.collect()] == [4, 4, 1, 1, 1, 2, 2, 2, 3, 3, 3, 4]
    with pytest.raises(PySparkException):
        spark.range(13, 14).select(D.season_of_month(F.col("id"))).collect()


def test_radar_constants():
    assert SENTINEL1.wavelength() == pytest.approx(0.055465764662349676, rel=1e-15) and SENTINEL1.millimetres == pytest.approx(-4.413825309192362, rel=1e-14)
    assert Radar.of_wavelength("x", 5.5465764662349676, "cm").hertz == pytest.approx(5.405e9) and wavelength(1, "cm", "mm") == pytest.approx(10)


def test_winters_that_cross_the_year(spark):
    days = [(dt.date(y, m, d),) for y in (2018, 2019, 2020) for m, d in ((1, 5), (2, 10), (8, 20), (12, 10))]
    df = spark.createDataFrame(days, "date date")
    got = {r["pair_id"] for r in N.from_summer_winter(df).collect()}
    assert "20180105_20180820" in got and "20180820_20181210" in got and "20180820_20190105" in got and "20181210_20190820" in got and "20180105_20190820" not in got
    linked = {r["pair_id"] for r in N.linking_winter(df, "1201", "0215", None, 1).collect()}
    assert "20181210_20191210" in linked and "20190105_20191210" in linked and "20181210_20190105" not in linked
    assert {r["pair_id"] for r in N.linking_winter(df, per_winter=1).collect()} == {r["pair_id"] for r in N.linking_winter(df, per_winter=1).collect()}
