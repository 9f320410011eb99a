"""Bounded tables as numpy arrays and back, and logging."""

from __future__ import annotations

import logging

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.geo import Grid


def names_array(pairs: DataFrame) -> np.ndarray:
    """Names of a network's pairs, sorted, as an array of texts."""
    return np.array(sorted(r[0] for r in pairs.select("pair_id").collect()), dtype=str)


def to_array(raster: DataFrame, grid: Grid, value: str = "value", most: int = 1 << 26) -> np.ndarray:
    """One raster (row, col, value) as an array; missing cells are NaN.  More than ``most`` cells are an error, so the driver stays safe."""
    if grid.width * grid.height > most:
        raise ValueError(f"a grid of {grid.width} by {grid.height} is more than {most} cells")
    table = raster.filter(F.col("row").between(0, grid.height - 1) & F.col("col").between(0, grid.width - 1)).select("row", "col", F.col(value).cast("double").alias("value")).toArrow()
    out = np.full((grid.height, grid.width), np.nan)
    out[table["row"].to_numpy(), table["col"].to_numpy()] = table["value"].to_numpy(zero_copy_only=False)
    return out


def from_array(spark: SparkSession, array: np.ndarray) -> DataFrame:
    """(row, col, value) of an array; NaN is null."""
    import pyarrow as pa

    rows, cols = np.indices(array.shape).astype(np.int32)
    return spark.createDataFrame(pa.table({"row": rows.reshape(-1), "col": cols.reshape(-1), "value": pa.array(array.reshape(-1).astype(float), from_pandas=True)}))


def logger(name: str = "stackwave", level: int | str = "INFO", path: str | None = None) -> logging.Logger:
    """A logger to the terminal, or to a file; setting it up again changes it instead of adding to it."""
    out = logging.getLogger(name)
    out.setLevel(level)
    for h in list(out.handlers):
        out.removeHandler(h)
        h.close()
    handler = logging.FileHandler(path) if path else logging.StreamHandler()
    handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))
    out.addHandler(handler)
    return out
