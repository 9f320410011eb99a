"""Radar constants and phase columns."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

SPEED_OF_LIGHT = 299_792_458.0
_LENGTH = {"m": 1.0, "dm": 1e-1, "cm": 1e-2, "mm": 1e-3}
_RATE = {"Hz": 1.0, "kHz": 1e3, "MHz": 1e6, "GHz": 1e9}


def wavelength(value: float, unit: str = "m", to: str = "m") -> float:
    return value * _LENGTH[unit] / _LENGTH[to]


def frequency(value: float, unit: str = "GHz", to: str = "GHz") -> float:
    return value * _RATE[unit] / _RATE[to]


@dataclass(frozen=True)
class Radar:
    """A sensor by its frequency; ``SENTINEL1`` is 5.405 GHz."""

    name: str
    hertz: float

    @classmethod
    def of_wavelength(cls, name: str, value: float, unit: str = "m") -> Radar:
        return cls(name, SPEED_OF_LIGHT / wavelength(value, unit))

    def wavelength(self, unit: str = "m") -> float:
        return wavelength(SPEED_OF_LIGHT / self.hertz, "m", unit)

    @property
    def millimetres(self) -> float:
        """Deformation in mm of one radian of phase."""
        return -self.wavelength() / (4 * math.pi) * 1000


SENTINEL1 = Radar("Sentinel-1", 5.405e9)


def phase_to_deformation(phase: Column, radar: Radar = SENTINEL1) -> Column:
    return phase * F.lit(radar.millimetres)


def deformation_to_phase(deformation: Column, radar: Radar = SENTINEL1) -> Column:
    return deformation / F.lit(radar.millimetres)


def wrap_phase(phase: Column) -> Column:
    """Phase in [0, 2 pi)."""
    return F.pmod(phase, F.lit(2 * math.pi))


def los_ratio(angle: Column, kind: str = "incidence") -> Column:
    """Vertical share of the line of sight: cosine of the incidence angle or sine of the look angle, in radians."""
    if kind not in ("incidence", "look"):
        raise ValueError("kind is incidence or look")
    return F.cos(angle) if kind == "incidence" else F.sin(angle)


def seasonal_amplitude(sine: Column, cosine: Column) -> Column:
    """Peak to peak of a sine and a cosine term."""
    return 2 * F.hypot(sine, cosine)


def unwrap_corrected(phase: Column, cycles: Column) -> Column:
    """Phase less whole cycles; ties round to even."""
    return phase - F.lit(2 * math.pi) * F.rint(cycles)


def coherence_scaled(value: Column, low: float, high: float) -> Column:
    """Coherence clipped to [low, high] and scaled to [0, 1]."""
    clipped = F.greatest(F.lit(low), F.least(F.lit(high), value))
    scaled = clipped if (low, high) == (0, 1) else (clipped - low) / (high - low)
    return F.when(value.isNotNull() & ~F.isnan(value), scaled)


def known(value: Column, nodata: float | None = None) -> Column:
    """Null in place of NaN and of the nodata value."""
    missing = F.isnan(value) if nodata is None or math.isnan(nodata) else F.isnan(value) | (value == nodata)
    return F.when(~missing, value)


def coherent(value: Column, coherence: Column, least: float) -> Column:
    """The value where its coherence is at least ``least``; null elsewhere."""
    return F.when(coherence >= least, value)
