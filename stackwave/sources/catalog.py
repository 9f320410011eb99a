"""Scene catalogs: what files there are, what their names say, and which are readable.

A product format says which files are phase, coherence and so on, and where the dates are in a name.  Catalogs are tables, one row a file; nothing is
opened until pixels are asked for.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import pair_name


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(name: Column) -> Column:
    """The name up to its first dot."""
    return F.split_part(name, F.lit("."), F.lit(1))


def day(token: Column) -> Column:
    """The date in a token's first eight characters; null where that is none."""
    return F.try_to_timestamp(F.substring(token, 1, 8), F.lit("yyyyMMdd")).cast("date")


@dataclass(frozen=True)
class ProductFormat:
    """File patterns of a product, and the place of its two dates among the tokens of a name's stem (one date: ``second`` is None)."""

    name: str
    phase: str
    coherence: str
    first: int
    second: int | None
    coherence_range: tuple[float, float] = (0.0, 1.0)
    sidecars: tuple[tuple[str, str], ...] = ()

    def dates(self, name: Column) -> list[Column]:
        tokens = F.split(stem(name), "_")
        return [day(F.get(tokens, F.lit(k))) for k in (self.first, self.second) if k is not None]

    def pairs(self, files: DataFrame, path: str = "path") -> DataFrame:
        """(path, pair_id, primary, secondary) of files whose names hold two dates."""
        a, b = self.dates(file_name(F.col(path)))
        rows = files.select(F.col(path).alias("path"), F.least(a, b).alias("primary"), F.greatest(a, b).alias("secondary"), a.isNull().alias("_x"), b.isNull().alias("_y"))
        rows = rows.filter("not _x and not _y").drop("_x", "_y")
        return rows.select("path", pair_name(F.col("primary"), F.col("secondary")).alias("pair_id"), "primary", "secondary")

    def acquisitions(self, files: DataFrame, path: str = "path") -> DataFrame:
        """Distinct dates in the files' names, sorted."""
        found = F.array(*self.dates(file_name(F.col(path))))
        return files.select(F.explode(found).alias("date")).filter("date is not null").distinct().orderBy("date")


#: File patterns and name layouts of public products.
HYP3 = ProductFormat("HyP3S1", "*unw_phase.tif", "*corr.tif", 1, 2)
HYP3_BURST = ProductFormat("HyP3S1Burst", "*unw_phase.tif", "*corr.tif", 3, 4)
LICSAR = ProductFormat("LiCSAR", "*geo.unw.tif", "*geo.cc.tif", 0, 1, (0.0, 255.0), (("dem", "*geo.hgt.tif"), ("up", "*geo.U.tif"), ("east", "*geo.E.tif"), ("north", "*geo.N.tif"), ("baselines", "baselines"), ("polygon", "*-poly.txt")))
GACOS = ProductFormat("GACOS", "*.ztd.tif", "", 0, None)
APS_PAIRS = ProductFormat("ApsPairs", "*.tif", "", 1, 2)
_FORMATS = {f.name.lower(): f for f in (HYP3, HYP3_BURST, LICSAR, GACOS, APS_PAIRS)}


def get_format(name: str) -> ProductFormat:
    """By name, in any case."""
    if name.lower() not in _FORMATS:
        raise ValueError(f"no format {name!r}; there are {', '.join(f.name for f in _FORMATS.values())}")
    return _FORMATS[name.lower()]


def register_format(layout: ProductFormat) -> ProductFormat:
    """Makes a format of one's own known by its name."""
    _FORMATS[layout.name.lower()] = layout
    return layout


def glob_expression(path: Column, pattern: str) -> Column:
    """Whether a path's file name matches a pattern of * and ?."""
    sql = pattern.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_").replace("*", "%").replace("?", "_")
    return file_name(path).like(sql)


def scan_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, name, size, valid) of the files under a folder.  Contents aren't read; empty files are skipped by Spark's reader."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return files.select("path", file_name(F.col("path")).alias("name"), F.col("length").alias("size"), (F.col("length") > 0).alias("valid"))


def attributes(headers: DataFrame, *names: str) -> DataFrame:
    """One row: the dataset's attributes, each that of the first readable file (by path) that has it."""
    good = headers.filter("valid")
    return good.agg(*(F.min_by(n, F.when(F.col(n).isNotNull(), F.col("path"))).alias(n) for n in names))


def first_matches(files: DataFrame, kinds: Sequence[tuple[str, str]], path: str = "path") -> DataFrame:
    """(kind, path): the first file of each kind; null where there is none."""
    wanted = files.sparkSession.createDataFrame(list(kinds), "kind string, pattern string")
    cases = F.array(*(F.when(glob_expression(F.col(path), p), F.lit(k)) for k, p in kinds))
    found = files.select(F.explode(cases).alias("kind"), F.col(path).alias("path")).filter("kind is not null").groupBy("kind").agg(F.min("path").alias("path"))
    return wanted.join(found, "kind", "left").select("kind", "path")


def meta_values(lines: DataFrame, key: str) -> DataFrame:
    """(path, value): the second field, between colons, of the first line that contains the key.

    Rows of ``lines`` are path, line (number) and value (text).  Files without such a line don't appear.
    """
    hit = lines.filter(F.col("value").contains(key)).groupBy("path").agg(F.min_by("value", "line").alias("_v"))
    return hit.select("path", F.trim(F.get(F.split("_v", ":"), F.lit(1))).alias("value"))


def pair_baselines(files: DataFrame, lines: DataFrame, layout: ProductFormat = HYP3, key: str = "Baseline") -> DataFrame:
    """(pair_id, primary, secondary, baseline) from side-car texts; null where it is missing or no number."""
    values = meta_values(lines, key).select("path", F.expr("try_cast(value as double)").alias("baseline"))
    return layout.pairs(files).join(values, "path", "left").select("pair_id", "primary", "secondary", "baseline")


def product_of_url(url: Column) -> Column:
    """Product id of a download address: its last part up to the first dot."""
    return stem(F.element_at(F.split(url, "/"), -1))
