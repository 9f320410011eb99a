"""Domain tables derived from the generic business tables, so that every operator can be run on them.

Days with events are acquisitions, users are pixels (row = user div 16, col = user mod 16), and a user's running sum of event values is the surface.  Sums are
in whole cents, so a pair's phase is exact and independent of the order of addition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.geo import Grid
from .operators import network, pairs
from .operators.spatial import with_scenes

#: Grid of the users' pixels: 16 columns; unit cells with the origin at the top left.
COLUMNS = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date): days that have events."""
    return table(spark, sf_dir, "events").select(F.to_date("ts").alias("date")).distinct()


def order_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date): the first order day of each span of twelve days from 1995-01-01; years of acquisitions."""
    days = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("date"))
    return days.groupBy(F.floor(F.datediff("date", F.lit("1995-01-01").cast("date")) / 12).alias("span")).agg(F.min("date").alias("date")).select("date")


def event_network(spark: SparkSession, sf_dir: str, neighbours: int = 3) -> DataFrame:
    return network.from_interval(event_days(spark, sf_dir), neighbours)


def order_network(spark: SparkSession, sf_dir: str, neighbours: int = 3, max_day: int = 40) -> DataFrame:
    return network.from_interval(order_days(spark, sf_dir), neighbours, max_day)


def surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row, col, date, cents): running sums a user and day, for all users on all days."""
    events = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("date"), F.round(F.col("value") * 100).cast("long").alias("cents"))
    daily = events.groupBy("user_id", "date").agg(F.sum("cents").alias("cents"))
    grid = with_scenes(events.select("user_id").distinct(), events.select("date"))
    running = F.sum(F.coalesce("cents", F.lit(0))).over(Window.partitionBy("user_id").orderBy("date"))
    rows = grid.join(daily, ["user_id", "date"], "left").withColumn("cents", running)
    return rows.select((F.col("user_id") / COLUMNS).cast("int").alias("row"), (F.col("user_id") % COLUMNS).cast("int").alias("col"), "date", "cents")


def stack(spark: SparkSession, sf_dir: str, neighbours: int = 3) -> DataFrame:
    """(pair_id, i, j, row, col, phase, coh): an interferogram a pair; coherence is an arithmetic pattern in [0, 1]."""
    net = pairs.edge_index(event_network(spark, sf_dir, neighbours)).select("pair_id", "primary", "secondary", "i", "j")
    cells = surface(spark, sf_dir)
    first = cells.select("row", "col", F.col("date").alias("primary"), F.col("cents").alias("_a"))
    second = cells.select("row", "col", F.col("date").alias("secondary"), F.col("cents").alias("_b"))
    rows = first.join(F.broadcast(net), "primary").join(second, ["row", "col", "secondary"])  # the network's pairs are few
    user = F.col("row") * COLUMNS + F.col("col")
    return rows.select("pair_id", "i", "j", "row", "col", ((F.col("_b") - F.col("_a")) / 100).alias("phase"), (((user * 7 + F.col("i") * 3 + F.col("j") * 5) % 101) / 100).alias("coh"))


def with_missing(rows: DataFrame) -> DataFrame:
    """The stack with a pattern of missing phases."""
    user = F.col("row") * COLUMNS + F.col("col")
    return rows.withColumn("phase", F.when((user * 7 + F.col("i") * 3 + F.col("j")) % 11 != 0, F.col("phase")))


def with_cycles(rows: DataFrame) -> DataFrame:
    """The stack with -1, 0 or 1 whole cycles on pairs that aren't neighbours."""
    user = F.col("row") * COLUMNS + F.col("col")
    cycles = F.when(F.col("j") - F.col("i") > 1, (user + F.col("i") + F.col("j")) % 3 - 1).otherwise(0)
    return rows.withColumn("phase", F.col("phase") + 2 * F.pi() * cycles)


def image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row, col, value): the surface of the last day, in units."""
    cells = surface(spark, sf_dir)
    return cells.groupBy("row", "col").agg((F.max_by("cents", "date") / 100).alias("value"))


def image_grid(spark: SparkSession, sf_dir: str) -> Grid:
    """The grid of all users' pixels, at least square: its height is one aggregate over the events."""
    last = table(spark, sf_dir, "events").agg(F.max("user_id")).first()[0]
    rows = max(COLUMNS, (last or 0) // COLUMNS + 1)
    return Grid(COLUMNS, rows, 0.0, float(rows), 1.0, 1.0)


def temperatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(site, date, t): daily temperatures of all nations over five years, in eighths of a degree."""
    day = F.explode(F.sequence(F.lit("1995-01-01").cast("date"), F.lit("1999-12-31").cast("date"))).alias("date")
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("site"), day)
    n = F.datediff("date", F.lit("1995-01-01").cast("date"))
    return rows.select("site", "date", ((220 - 3 * F.abs(F.dayofyear("date") - 200) + (F.col("site") * 7 + n * 13) % 41 + 8 * F.col("site")) / 8).alias("t"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(point_id, x, y): the first two components of the vectors, spread over the image."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("point_id"), F.col("embedding")[0].cast("double").alias("a"), F.col("embedding")[1].cast("double").alias("b"))
    return rows.select("point_id", (F.round(F.col("a") * 100) / 4 + 8).alias("x"), (F.round(F.col("b") * 100) / 4 + 8).alias("y"))
