"""Time-series models: columns of a design block over acquisition dates.

A model is a function from days since the first date to a matrix with a row a date and a column a parameter.  ``MODELS`` finds models by name;
``register`` adds one.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import date

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

YEAR = 365.25


@dataclass(frozen=True)
class Model:
    """Names of the parameters and the block's columns for spans in days or in years."""

    name: str
    parameters: tuple[str, ...]
    columns: Callable[[np.ndarray, float], np.ndarray]
    unit: str = "day"

    def block(self, dates: Sequence[date]) -> np.ndarray:
        days = np.array([(d - dates[0]).days for d in dates], float)
        spans, period = (days, YEAR) if self.unit == "day" else (days / YEAR, 1.0)
        return self.columns(spans, 2 * np.pi / period)

    def in_years(self) -> Model:
        return Model(self.name, self.parameters, self.columns, "year")


def _polynomial(degree: int) -> Callable[[np.ndarray, float], np.ndarray]:
    return lambda t, w: np.vander(t, degree + 1)


def _annual(t: np.ndarray, w: float) -> np.ndarray:
    return np.column_stack([np.sin(w * t), np.cos(w * t), t, np.ones_like(t)])


def _semiannual(t: np.ndarray, w: float) -> np.ndarray:
    return np.column_stack([np.sin(w * t), np.cos(w * t), np.sin(2 * w * t), np.cos(2 * w * t), t, np.ones_like(t)])


LINEAR = Model("linear", ("velocity", "constant"), _polynomial(1))
QUADRATIC = Model("quadratic", ("acceleration", "velocity", "constant"), _polynomial(2))
CUBIC = Model("cubic", ("change", "acceleration", "velocity", "constant"), _polynomial(3))
ANNUAL = Model("annual", ("sin", "cos", "velocity", "constant"), _annual)
SEMIANNUAL = Model("semiannual", ("sin", "cos", "sin2", "cos2", "velocity", "constant"), _semiannual)
MODELS: dict[str, Model] = {m.name: m for m in (LINEAR, QUADRATIC, CUBIC, ANNUAL, SEMIANNUAL)}


def register(model: Model) -> Model:
    """Makes a model of one's own known by its name."""
    MODELS[model.name] = model
    return model


def get_model(name: str) -> Model:
    """By name, which is case-sensitive."""
    if name not in MODELS:
        raise ValueError(f"no model {name!r}; there are {', '.join(sorted(MODELS))}")
    return MODELS[name]


def block_table(acquisitions: DataFrame, model: Model) -> DataFrame:
    """(date, param, value) of a model's block, for a table of dates; the dates of a network are few and go to the driver."""
    days = sorted(r[0] for r in acquisitions.select("date").distinct().collect())
    g = model.block(days) if days else np.zeros((0, len(model.parameters)))
    rows = [(d, p, float(g[i, j])) for i, d in enumerate(days) for j, p in enumerate(model.parameters)]
    return acquisitions.sparkSession.createDataFrame(rows, "date date, param string, value double")


def linear_fit(series: DataFrame, *keys: str, span: str = "span", value: str = "value") -> DataFrame:
    """(keys, velocity, constant) of a straight line through each series, by aggregation alone."""
    return series.groupBy(*keys).agg(F.regr_slope(value, span).alias("velocity"), F.regr_intercept(value, span).alias("constant"))
