"""Grid geometry, boxes and closed-form projections as columns."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH = 6378137.0
_FLATTENING = 1 / 298.257223563


@dataclass(frozen=True)
class Box:
    """A closed box; left <= right and bottom <= top."""

    left: float
    bottom: float
    right: float
    top: float

    def __post_init__(self) -> None:
        if self.left > self.right or self.bottom > self.top:
            raise ValueError(f"not a box: {self}")

    @property
    def area(self) -> float:
        return (self.right - self.left) * (self.top - self.bottom)

    def buffer(self, distance: float) -> Box:
        return Box(self.left - distance, self.bottom - distance, self.right + distance, self.top + distance)

    def split(self, share: float, across: bool = True) -> tuple[Box, Box]:
        """Two boxes that meet at a share of the width (``across``) or of the height."""
        if across:
            x = self.left + (self.right - self.left) * share
            return replace(self, right=x), replace(self, left=x)
        y = self.bottom + (self.top - self.bottom) * share
        return replace(self, top=y), replace(self, bottom=y)

    def __or__(self, other: Box) -> Box:
        return Box(min(self.left, other.left), min(self.bottom, other.bottom), max(self.right, other.right), max(self.top, other.top))

    def __and__(self, other: Box) -> Box:
        return Box(max(self.left, other.left), max(self.bottom, other.bottom), min(self.right, other.right), min(self.top, other.top))

    def intersects(self, other: Box) -> bool:
        return self.left <= other.right and other.left <= self.right and self.bottom <= other.top and other.bottom <= self.top

    def __contains__(self, other: Box) -> bool:
        return self.left <= other.left and other.right <= self.right and self.bottom <= other.bottom and other.top <= self.top

    def holds(self, x: Column, y: Column) -> Column:
        return x.between(self.left, self.right) & y.between(self.bottom, self.top)


@dataclass(frozen=True)
class Grid:
    """A raster grid; row 0 is at the top."""

    width: int
    height: int
    left: float
    top: float
    xres: float
    yres: float
    crs: str | None = None
    nodata: float | None = None

    @classmethod
    def of(cls, box: Box, xres: float, yres: float | None = None, crs: str | None = None, nodata: float | None = None) -> Grid:
        """The grid of a box at a resolution; sizes round half to even."""
        yres = xres if yres is None else yres
        return cls(round((box.right - box.left) / xres), round((box.top - box.bottom) / yres), box.left, box.top, xres, yres, crs, nodata)

    @property
    def bounds(self) -> Box:
        return Box(self.left, self.top - self.height * self.yres, self.left + self.width * self.xres, self.top)

    def row(self, y: Column) -> Column:
        return F.floor((F.lit(self.top) - y) / self.yres).cast("int")

    def col(self, x: Column) -> Column:
        return F.floor((x - self.left) / self.xres).cast("int")

    def x(self, col: Column) -> Column:
        """Centre of a column."""
        return F.lit(self.left) + (col + 0.5) * self.xres

    def y(self, row: Column) -> Column:
        """Centre of a row."""
        return F.lit(self.top) - (row + 0.5) * self.yres

    def window(self, box: Box) -> tuple[int, int, int, int]:
        """First row, first column, height and width of a box's window; it may reach beyond the grid."""
        first_row, first_col = math.floor((self.top - box.top) / self.yres + 1e-9), math.floor((box.left - self.left) / self.xres + 1e-9)
        return first_row, first_col, round((box.top - box.bottom) / self.yres), round((box.right - box.left) / self.xres)

    def sub(self, box: Box) -> Grid:
        row, col, height, width = self.window(box)
        return replace(self, width=width, height=height, left=self.left + col * self.xres, top=self.top - row * self.yres)


def box_contains(a: str, b: str) -> Column:
    """Whether box columns with prefix ``a`` hold those with prefix ``b``."""
    c = F.col
    return (c(f"{a}left") <= c(f"{b}left")) & (c(f"{a}right") >= c(f"{b}right")) & (c(f"{a}bottom") <= c(f"{b}bottom")) & (c(f"{a}top") >= c(f"{b}top"))


def boxes_intersect(a: str, b: str) -> Column:
    c = F.col
    return (c(f"{a}left") <= c(f"{b}right")) & (c(f"{b}left") <= c(f"{a}right")) & (c(f"{a}bottom") <= c(f"{b}top")) & (c(f"{b}bottom") <= c(f"{a}top"))


def to_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """EPSG:4326 to EPSG:3857."""
    return F.radians(lon) * EARTH, F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * EARTH


def from_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    """EPSG:3857 to EPSG:4326."""
    return F.degrees(x / EARTH), F.degrees(2 * F.atan(F.exp(y / EARTH)) - F.lit(math.pi / 2))


def _krueger() -> tuple[float, tuple[float, ...], tuple[float, ...], tuple[float, ...]]:
    n = _FLATTENING / (2 - _FLATTENING)
    a = EARTH / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    delta = (2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15)
    return a, alpha, beta, delta


def to_utm(lon: Column, lat: Column, zone: int, south: bool = False) -> tuple[Column, Column]:
    """WGS 84 degrees to UTM metres by Krueger's series (better than a millimetre within the zone)."""
    a, alpha, _, _ = _krueger()
    n = _FLATTENING / (2 - _FLATTENING)
    e = 2 * math.sqrt(n) / (1 + n)
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, c in enumerate(alpha, 1):
        x = x + c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return 500_000 + 0.9996 * a * x, (10_000_000 if south else 0) + 0.9996 * a * y


def from_utm(x: Column, y: Column, zone: int, south: bool = False) -> tuple[Column, Column]:
    """UTM metres to WGS 84 degrees."""
    a, _, beta, delta = _krueger()
    xi = (y - (10_000_000 if south else 0)) / (0.9996 * a)
    eta = (x - 500_000) / (0.9996 * a)
    u, v = xi, eta
    for j, c in enumerate(beta, 1):
        u = u - c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        v = v - c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(u) / F.cosh(v))
    phi = chi
    for j, c in enumerate(delta, 1):
        phi = phi + c * F.sin(2 * j * chi)
    return F.degrees(F.atan2(F.sinh(v), F.cos(u))) + (zone * 6 - 183), F.degrees(phi)


def project(x: Column, y: Column, source: str, target: str) -> tuple[Column, Column]:
    """Coordinates from one system to another: EPSG:4326, 3857, 326zz and 327zz (UTM); equal systems pass through."""
    if source == target:
        return x, y
    code = {s: int(s.rpartition(":")[2]) for s in (source, target)}

    def utm(n: int) -> tuple[int, bool] | None:
        return (n % 100, n // 100 == 327) if n // 100 in (326, 327) and 1 <= n % 100 <= 60 else None

    s, t = code[source], code[target]
    if s == 3857:
        x, y = from_mercator(x, y)
    elif u := utm(s):
        x, y = from_utm(x, y, *u)
    elif s != 4326:
        raise ValueError(f"no closed form for {source}")
    if t == 3857:
        return to_mercator(x, y)
    if u := utm(t):
        return to_utm(x, y, *u)
    if t != 4326:
        raise ValueError(f"no closed form for {target}")
    return x, y
