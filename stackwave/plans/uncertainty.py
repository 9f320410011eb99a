"""Propagation of data variances and covariances to parameters of linear models.

Variances are rows (keys, variance array) or long tables; design matrices are small and known on the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .inversion import _per_batch, _rows


def add(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """Sums of the variances of two long tables."""
    return a.join(b.withColumnRenamed("variance", "_v"), list(keys)).select(*keys, (F.col("variance") + F.col("_v")).alias("variance"))


def weight(variance: Column) -> Column:
    """One over the standard deviation."""
    return 1 / F.sqrt(variance)


def gain(g: np.ndarray, w: np.ndarray | None = None) -> np.ndarray:
    """Matrix from data to parameters: (G'WG)^-1 G'W with weights w**2, or the plain least-squares one."""
    if w is None:
        return np.linalg.solve(g.T @ g, g.T)
    gw = g * (w**2)[:, None]
    return np.linalg.solve(gw.T @ g, gw.T)


def unit_variances(g: np.ndarray) -> np.ndarray:
    """Diagonal of (G'G)^-1: the parameters' variances for data of variance one."""
    return np.diag(np.linalg.inv(g.T @ g))


def parameters_of_common_variance(df: DataFrame, g: np.ndarray, *keys: str, variance: str = "variance") -> DataFrame:
    """(keys, parameter, variance) for rows with one variance for all data."""
    factors = F.array(*(F.lit(float(x)) for x in unit_variances(g)))
    return df.select(*keys, F.posexplode(F.transform(factors, lambda x: x * F.col(variance))).alias("parameter", "variance"))


def parameters(df: DataFrame, g: np.ndarray | Sequence[np.ndarray], *keys: str, variance: str = "variance", strict: bool = False) -> DataFrame:
    """(keys, variance array of the parameters) of independent data; several designs are chained.

    A row whose variances are all null is null; single nulls count as 0, or with ``strict`` make the row null.
    """
    chain = [g] if isinstance(g, np.ndarray) else list(g)
    m = gain(chain[0])
    for step in chain[1:]:
        m = gain(step) @ m
    square = m * m

    def work(b: pa.RecordBatch) -> list[np.ndarray]:
        v = _rows(b, variance, m.shape[1])
        none = np.isnan(v).any(0) if strict else np.isnan(v).all(0)
        out = square @ np.nan_to_num(v)
        out[:, none] = np.nan
        return [out]

    return _per_batch(df, keys, ("variance",), work, 3 * sum(m.shape))


def parameters_weighted(df: DataFrame, g: np.ndarray, *keys: str, variance: str = "variance", exact: bool = True) -> DataFrame:
    """As ``parameters`` with each row's own weights, one over its standard deviations; ``exact`` false gives diag((G_w'G_w)^-1), equal for full data.

    A row holds its weighted design, its gain of the same size and two matrices of the parameters.
    """

    def work(b: pa.RecordBatch) -> list[np.ndarray]:
        v = _rows(b, variance, len(g))
        out = np.full((g.shape[1], v.shape[1]), np.nan)
        fine = (v > 0).all(0)
        if fine.any():
            own = v[:, fine].T
            weighted = g.T / own[:, None, :]
            cov = np.linalg.inv(weighted @ g)
            if exact:
                m = cov @ weighted
                np.multiply(m, m, out=m)
                out[:, fine] = (m @ own[:, :, None])[:, :, 0].T
            else:
                out[:, fine] = np.einsum("pii->ip", cov)
        return [out]

    return _per_batch(df, keys, ("variance",), work, 2 * g.size + 3 * g.shape[1] ** 2 + 3 * len(g))


def parameters_of_covariance(df: DataFrame, g: np.ndarray, *keys: str, covariance: str = "covariance", full: bool = False) -> DataFrame:
    """Variances (or, ``full``, covariances, by rows) of the parameters for rows with the data's covariance matrix, by rows; any null makes the row null."""
    m = gain(g)
    n = m.shape[1]

    def work(b: pa.RecordBatch) -> list[np.ndarray]:
        c = _rows(b, covariance, n * n).T.reshape(-1, n)
        half = (c @ m.T).reshape(-1, n, len(m))  # one product for all rows
        if full:
            return [(m @ half).reshape(len(half), -1).T]
        return [np.einsum("ij,pji->ip", m, half)]

    return _per_batch(df, keys, ("covariance" if full else "variance",), work, 2 * n * n + n * len(m) + 3 * len(m) ** 2)


def propagate_table(variances: DataFrame, matrix: DataFrame, *keys: str) -> DataFrame:
    """(keys, parameter, variance) from long tables: variances (keys, pair_id, variance) and squares of the gain (parameter, pair_id, square).

    A join and a sum, without Python; pairs without a variance count as 0, keys with none are null.
    """
    rows = variances.join(matrix, "pair_id").groupBy(*keys, "parameter")
    return rows.agg(F.sum(F.col("variance") * F.col("square")).alias("variance"))


def batch_rows(images: int, parameters: int, memory: int, itemsize: int = 8) -> int:
    """Rows of an Arrow batch (spark.sql.execution.arrow.maxRecordsPerBatch) whose weighted propagation stays within ``memory`` bytes of a task.

    A row's working set is its gain and a product of the same size, images by parameters, and the weighted design.
    """
    return max(1, memory // (itemsize * images * (2 * parameters + images)))
