"""Column builders for map grids: affine transforms, UTM, rational polynomials, overlap."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import projections

#: WGS 84 and UTM, fixed values.
SEMI_MAJOR, FLATTENING, SCALE, FALSE_EASTING, FALSE_NORTHING = 6378137.0, 1 / 298.257223563, 0.9996, 500_000.0, 10_000_000.0
LATITUDES = (-80.0, 84.0)
WEB_MERCATOR = 3857

_N = FLATTENING / (2 - FLATTENING)
#: Rectifying radius, and the series of the transverse Mercator projection to the fourth power of n.
RADIUS = SEMI_MAJOR / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
FORWARD = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180,
    13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440,
    61 * _N**3 / 240 - 103 * _N**4 / 140,
    49561 * _N**4 / 161280,
)
INVERSE = (
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360,
    _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440,
    17 * _N**3 / 480 - 37 * _N**4 / 840,
    4397 * _N**4 / 161280,
)
TO_LATITUDE = (
    2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45,
    7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45,
    56 * _N**3 / 15 - 136 * _N**4 / 35,
    4279 * _N**4 / 630,
)
ECCENTRICITY = 2 * math.sqrt(_N) / (1 + _N)


def wkt(epsg: int) -> str | None:
    """Well-known text of WGS 84 in degrees, of Web Mercator and of the UTM zones; None for others."""
    degrees = 'GEOGCS["WGS 84",DATUM["WGS_1984",SPHEROID["WGS 84",6378137,298.257223563,AUTHORITY["EPSG","7030"]],AUTHORITY["EPSG","6326"]],PRIMEM["Greenwich",0,AUTHORITY["EPSG","8901"]],UNIT["degree",0.0174532925199433,AUTHORITY["EPSG","9122"]],AXIS["Latitude",NORTH],AXIS["Longitude",EAST],AUTHORITY["EPSG","4326"]]'
    if epsg == 4326:
        return degrees
    if epsg == WEB_MERCATOR:
        zeros = ",".join(f'PARAMETER["{k}",{int(k == "scale_factor")}]' for k in ("central_meridian", "scale_factor", "false_easting", "false_northing"))
        return f'PROJCS["WGS 84 / Pseudo-Mercator",{degrees},PROJECTION["Mercator_1SP"],{zeros},UNIT["metre",1,AUTHORITY["EPSG","9001"]],AXIS["Easting",EAST],AXIS["Northing",NORTH],AUTHORITY["EPSG","{WEB_MERCATOR}"]]'
    if epsg // 100 not in (326, 327) or not 1 <= epsg % 100 <= 60:
        return None
    south = epsg // 100 == 327
    values = {
        "latitude_of_origin": 0, "central_meridian": int(central_meridian(epsg)), "scale_factor": SCALE, "false_easting": int(FALSE_EASTING),
        "false_northing": int(FALSE_NORTHING) if south else 0,
    }
    parameters = ",".join(f'PARAMETER["{k}",{v}]' for k, v in values.items())
    return f'PROJCS["WGS 84 / UTM zone {epsg % 100}{"S" if south else "N"}",{degrees},PROJECTION["Transverse_Mercator"],{parameters},UNIT["metre",1,AUTHORITY["EPSG","9001"]],AXIS["Easting",EAST],AXIS["Northing",NORTH],AUTHORITY["EPSG","{epsg}"]]'


def utm_epsg(lon: Column, lat: Column) -> Column:
    """EPSG code of the UTM zone of a place; NULL outside UTM's domain."""
    zone = F.least(F.greatest(F.floor((lon + 180.0) / 6.0) + 1, F.lit(1)), F.lit(60))
    code = (zone + F.when(lat >= 0, 32600).otherwise(32700)).cast("int")
    return F.when(lat.between(*LATITUDES) & lon.between(-180.0, 180.0), code)


def central_meridian(epsg: int) -> float:
    return (epsg % 100) * 6 - 183.0


def utm_forward(lon: Column, lat: Column, epsg: int) -> tuple[Column, Column]:
    """Easting and northing of degrees, by series."""
    lam = F.radians(lon - F.lit(central_meridian(epsg)))
    phi = F.radians(lat)
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - ECCENTRICITY * F.atanh(ECCENTRICITY * s))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(FORWARD, 1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    north = 0.0 if epsg // 100 == 326 else FALSE_NORTHING
    return FALSE_EASTING + SCALE * RADIUS * x, north + SCALE * RADIUS * y


def utm_inverse(east: Column, north: Column, epsg: int) -> tuple[Column, Column]:
    """Degrees of easting and northing, by series."""
    eta = (east - FALSE_EASTING) / (SCALE * RADIUS)
    xi = (north - F.lit(0.0 if epsg // 100 == 326 else FALSE_NORTHING)) / (SCALE * RADIUS)
    x, y = eta, xi
    for j, b in enumerate(INVERSE, 1):
        x = x - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    chi = F.asin(F.sin(y) / F.cosh(x))
    phi = chi
    for j, d in enumerate(TO_LATITUDE, 1):
        phi = phi + d * F.sin(2 * j * chi)
    return central_meridian(epsg) + F.degrees(F.atan2(F.sinh(x), F.cos(y))), F.degrees(phi)


def to_degrees(x: Column, y: Column, epsg: int) -> tuple[Column, Column]:
    """Longitude and latitude of map coordinates in degrees, Web Mercator or a projection of :mod:`.projections`."""
    if epsg == 4326:
        return x, y
    if epsg == WEB_MERCATOR:
        return F.degrees(x / SEMI_MAJOR), F.degrees(F.atan(F.sinh(y / SEMI_MAJOR)))
    return utm_inverse(x, y, epsg) if epsg // 100 in (326, 327) else _projection(epsg).inverse(x, y, F)


def from_degrees(lon: Column, lat: Column, epsg: int) -> tuple[Column, Column]:
    """Map coordinates of longitude and latitude."""
    if epsg == 4326:
        return lon, lat
    if epsg == WEB_MERCATOR:
        return SEMI_MAJOR * F.radians(lon), SEMI_MAJOR * F.asinh(F.tan(F.radians(lat)))
    return utm_forward(lon, lat, epsg) if epsg // 100 in (326, 327) else _projection(epsg).forward(lon, lat, F)


def _projection(epsg: int) -> projections.Projection:
    found = projections.of(epsg)
    if found is None:
        raise ValueError(f"EPSG:{epsg} is not projected here")
    return found


def affine(transform: Sequence[float], col: Column, row: Column) -> tuple[Column, Column]:
    """Map coordinates of fractional pixel coordinates; order (a, b, c, d, e, f)."""
    a, b, c, d, e, f = map(float, transform)
    return a * col + b * row + c, d * col + e * row + f


def inverse_affine(transform: Sequence[float]) -> tuple[float, ...]:
    a, b, c, d, e, f = map(float, transform)
    det = a * e - b * d
    if not det:
        raise ValueError("the transform has no inverse")
    return e / det, -b / det, (b * f - c * e) / det, -d / det, a / det, (c * d - a * f) / det


def pixel(transform: Sequence[float], x: Column, y: Column) -> tuple[Column, Column]:
    """Fractional pixel coordinates (col, row) of map coordinates.

    Distances from the grid's corner come first: a place on a pixel's edge would
    lose the last bits of its place to the size of the coordinates otherwise.
    """
    a, b, c, d, e, f = map(float, transform)
    det = a * e - b * d
    if not det:
        raise ValueError("the transform has no inverse")
    u, v = x - F.lit(c), y - F.lit(f)
    return (u / F.lit(a), v / F.lit(e)) if not b and not d else ((e * u - b * v) / det, (a * v - d * u) / det)


def rpc_terms(l: Column, p: Column, h: Column) -> list[Column]:  # noqa: E741
    """The 20 terms of the RPC00B polynomial in normalised longitude, latitude and height, in its order."""
    return [
        F.lit(1.0), l, p, h, l * p, l * h, p * h, l * l, p * p, h * h, p * l * h, l * l * l, l * p * p, l * h * h, l * l * p, p * p * p, p * h * h,
        l * l * h, p * p * h, h * h * h,
    ]


def polynomial(coefficients: Sequence[float], terms: Sequence[Column]) -> Column:
    out = F.lit(0.0)
    for c, t in zip(coefficients, terms, strict=True):
        if c:
            out = out + F.lit(float(c)) * t
    return out


def rpc_project(rpc: dict, lon: Column, lat: Column, height: Column) -> tuple[Column, Column]:
    """Image line and sample of a ground point; NULL where a denominator is zero."""
    n = {k: float(rpc[k]) for k in (
        "line_off", "samp_off", "lat_off", "long_off", "height_off", "line_scale", "samp_scale", "lat_scale", "long_scale", "height_scale",
    )}
    terms = rpc_terms((lon - n["long_off"]) / n["long_scale"], (lat - n["lat_off"]) / n["lat_scale"], (height - n["height_off"]) / n["height_scale"])
    p = {k: polynomial(rpc[k], terms) for k in ("line_num", "line_den", "samp_num", "samp_den")}
    line = F.when(p["line_den"] != 0, p["line_num"] / p["line_den"]) * n["line_scale"] + n["line_off"]
    sample = F.when(p["samp_den"] != 0, p["samp_num"] / p["samp_den"]) * n["samp_scale"] + n["samp_off"]
    return line, sample


def overlap(a: tuple[Column, Column, Column, Column], b: tuple[Column, Column, Column, Column]) -> Column:
    """Whether bounds (left, bottom, right, top) meet; touching counts."""
    return ~((a[2] < b[0]) | (a[0] > b[2]) | (a[3] < b[1]) | (a[1] > b[3]))
