"""Map projections by their parameters: transverse Mercator, Lambert conformal conic, polar stereographic.

The formulas take the functions that they are made of as a module, so that one
text serves numbers on the driver (``math``) and columns (``pyspark.sql.functions``).
Datums that differ from WGS 84 by less than a few metres (ETRS89, GDA94, GDA2020,
NAD83, RGF93) are taken as equal to it, as is common for rasters of metres; only
their ellipsoid is their own.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cache
from types import ModuleType
from typing import Any

#: Semi-major axes and flattenings.
WGS84 = (6378137.0, 1 / 298.257223563)
GRS80 = (6378137.0, 1 / 298.257222101)


@dataclass(frozen=True)
class Projection:
    """What all have: an ellipsoid, a central meridian, and false coordinates."""

    axis: float
    flattening: float
    meridian: float
    east: float
    north: float

    @property
    def third(self) -> float:
        """Third flattening."""
        return self.flattening / (2 - self.flattening)

    @property
    def eccentricity(self) -> float:
        return math.sqrt(self.flattening * (2 - self.flattening))

    def _latitude(self, chi: Any, m: ModuleType) -> Any:
        """Latitude of a conformal latitude, by series."""
        n = self.third
        terms = (
            2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45, 7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45, 56 * n**3 / 15 - 136 * n**4 / 35, 4279 * n**4 / 630,
        )
        out = chi
        for j, d in enumerate(terms, 1):
            out = out + d * m.sin(2 * j * chi)
        return out

    def _colatitude(self, phi: Any, m: ModuleType) -> Any:
        """Tangent of half the conformal colatitude."""
        e = self.eccentricity
        s = e * m.sin(phi)
        return m.tan(math.pi / 4 - phi / 2) * m.exp(e * m.atanh(s))

    def _shrink(self, phi: float) -> float:
        """Radius of a parallel over the axis."""
        return math.cos(phi) / math.sqrt(1 - (self.eccentricity * math.sin(phi)) ** 2)


@dataclass(frozen=True)
class TransverseMercator(Projection):
    """Series to the fourth power of the third flattening."""

    scale: float = 0.9996

    @property
    def radius(self) -> float:
        n = self.third
        return self.scale * self.axis / (1 + n) * (1 + n**2 / 4 + n**4 / 64)

    def forward(self, lon: Any, lat: Any, m: ModuleType) -> tuple[Any, Any]:
        n, e = self.third, self.eccentricity
        terms = (
            n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280,
        )
        s, lam = m.sin(m.radians(lat)), m.radians(lon - self.meridian)
        t = m.sinh(m.atanh(s) - e * m.atanh(e * s))
        xi, eta = m.atan2(t, m.cos(lam)), m.atanh(m.sin(lam) / m.sqrt(1 + t * t))
        x, y = eta, xi
        for j, a in enumerate(terms, 1):
            x = x + a * m.cos(2 * j * xi) * m.sinh(2 * j * eta)
            y = y + a * m.sin(2 * j * xi) * m.cosh(2 * j * eta)
        return self.east + self.radius * x, self.north + self.radius * y

    def inverse(self, x: Any, y: Any, m: ModuleType) -> tuple[Any, Any]:
        n = self.third
        terms = (
            n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280,
        )
        eta, xi = (x - self.east) / self.radius, (y - self.north) / self.radius
        u, v = eta, xi
        for j, b in enumerate(terms, 1):
            u = u - b * m.cos(2 * j * xi) * m.sinh(2 * j * eta)
            v = v - b * m.sin(2 * j * xi) * m.cosh(2 * j * eta)
        phi = self._latitude(m.asin(m.sin(v) / m.cosh(u)), m)
        return self.meridian + m.degrees(m.atan2(m.sinh(u), m.cos(v))), m.degrees(phi)


@dataclass(frozen=True)
class LambertConic(Projection):
    """Conformal, with two standard parallels."""

    origin: float = 0.0
    parallels: tuple[float, float] = (0.0, 0.0)

    def _cone(self) -> tuple[float, float, float]:
        """(cone constant, axis times F, radius at the origin)."""
        one, two = (math.radians(p) for p in self.parallels)
        t = lambda p: self._colatitude(p, math)
        n = math.sin(one) if one == two else (math.log(self._shrink(one)) - math.log(self._shrink(two))) / (math.log(t(one)) - math.log(t(two)))
        size = self.axis * self._shrink(one) / (n * t(one) ** n)
        return n, size, size * t(math.radians(self.origin)) ** n

    def forward(self, lon: Any, lat: Any, m: ModuleType) -> tuple[Any, Any]:
        n, size, at_origin = self._cone()
        r = size * m.pow(self._colatitude(m.radians(lat), m), n)
        theta = n * m.radians(lon - self.meridian)
        return self.east + r * m.sin(theta), self.north + at_origin - r * m.cos(theta)

    def inverse(self, x: Any, y: Any, m: ModuleType) -> tuple[Any, Any]:
        n, size, at_origin = self._cone()
        sign = 1.0 if n > 0 else -1.0
        u, v = x - self.east, at_origin - (y - self.north)
        t = m.pow(m.sqrt(u * u + v * v) / abs(size), 1 / n)
        theta = m.atan2(sign * u, sign * v)
        return self.meridian + m.degrees(theta) / n, m.degrees(self._latitude(math.pi / 2 - 2 * m.atan(t), m))


@dataclass(frozen=True)
class PolarStereographic(Projection):
    """Of the pole on the side of ``true``, the parallel without distortion, or of ``scale`` at the pole if that is 90 or -90."""

    true: float = 90.0
    scale: float = 1.0

    def _size(self) -> float:
        """Distance from the pole for a colatitude's tangent of 1."""
        e = self.eccentricity
        ends = math.sqrt((1 + e) ** (1 + e) * (1 - e) ** (1 - e))
        if abs(self.true) == 90:
            return 2 * self.axis * self.scale / ends
        phi = math.radians(abs(self.true))
        return self.axis * self._shrink(phi) / self._colatitude(phi, math)

    def forward(self, lon: Any, lat: Any, m: ModuleType) -> tuple[Any, Any]:
        side = 1.0 if self.true > 0 else -1.0
        r, lam = self._size() * self._colatitude(m.radians(side * lat), m), m.radians(lon - self.meridian)
        return self.east + r * m.sin(lam), self.north - side * r * m.cos(lam)

    def inverse(self, x: Any, y: Any, m: ModuleType) -> tuple[Any, Any]:
        side = 1.0 if self.true > 0 else -1.0
        u, v = x - self.east, side * (self.north - y)
        t = m.sqrt(u * u + v * v) / self._size()
        return self.meridian + m.degrees(m.atan2(u, v)), side * m.degrees(self._latitude(math.pi / 2 - 2 * m.atan(t), m))


# EPSG codes of UTM families as (first, last, code of zone 0, hemisphere, ellipsoid), and of single projections.
ZONES = (
    (32601, 32660, 32600, "N", WGS84), (32701, 32760, 32700, "S", WGS84), (25828, 25838, 25800, "N", GRS80), (26901, 26923, 26900, "N", GRS80),
    (28348, 28358, 28300, "S", GRS80), (7846, 7859, 7800, "S", GRS80),
)
SINGLE = {
    2154: LambertConic(*GRS80, 3.0, 700_000.0, 6_600_000.0, 46.5, (49.0, 44.0)), 3034: LambertConic(*GRS80, 10.0, 4_000_000.0, 2_800_000.0, 52.0, (35.0, 65.0)),
    3031: PolarStereographic(*WGS84, 0.0, 0.0, 0.0, -71.0), 3032: PolarStereographic(*WGS84, 70.0, 6_000_000.0, 6_000_000.0, -71.0),
    3413: PolarStereographic(*WGS84, -45.0, 0.0, 0.0, 70.0), 3976: PolarStereographic(*WGS84, 0.0, 0.0, 0.0, -70.0), 3995: PolarStereographic(*WGS84, 0.0, 0.0, 0.0, 71.0),
    5041: PolarStereographic(*WGS84, 0.0, 2_000_000.0, 2_000_000.0, 90.0, 0.994), 5042: PolarStereographic(*WGS84, 0.0, 2_000_000.0, 2_000_000.0, -90.0, 0.994),
}


@cache
def of(epsg: int) -> Projection | None:
    """The projection of a code; None if it is not known here."""
    for first, last, zero, side, ellipsoid in ZONES:
        if first <= epsg <= last:
            return TransverseMercator(*ellipsoid, (epsg - zero) * 6 - 183.0, 500_000.0, 0.0 if side == "N" else 10_000_000.0)
    return SINGLE.get(epsg)
