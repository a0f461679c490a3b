"""Output grids of warps, planned on the driver from headers alone."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from ..errors import ReprojectionError, UnsupportedError
from ..functions import geo, projections

EDGE_POINTS = 21
#: Zones that a scene may span for an automatic choice.
ZONE_SPAN = 1


@dataclass(frozen=True)
class Grid:
    epsg: int
    transform: tuple[float, ...]
    width: int
    height: int
    resolution: float


def parse_crs(spec: str) -> int:
    """An EPSG code that this engine projects: WGS 84 degrees, Web Mercator, or one of :mod:`..functions.projections`."""
    m = re.fullmatch(r"(?:epsg:)?(\d+)", spec.strip(), re.I)
    code = int(m[1]) if m else 0
    if not supported(code):
        raise UnsupportedError(
            f"the projection {spec} is not supported",
            hint="EPSG:4326, EPSG:3857, UTM zones of WGS 84, ETRS89, NAD83, GDA94 and GDA2020, and some conic and polar projections are",
        )
    return code


def supported(epsg: int | None) -> bool:
    return epsg is not None and (epsg in (4326, geo.WEB_MERCATOR) or projections.of(epsg) is not None)


def utm_epsg(lon: float, lat: float) -> int:
    if not (-180 <= lon <= 180 and geo.LATITUDES[0] <= lat <= geo.LATITUDES[1]):
        raise ReprojectionError("the place is outside UTM's domain", context={"lon": lon, "lat": lat})
    return min(max(math.floor((lon + 180) / 6) + 1, 1), 60) + (32600 if lat >= 0 else 32700)


def _series(coefficients: tuple[float, ...], x: float, y: float, sign: int) -> tuple[float, float]:
    """(x, y) with the terms of a transverse Mercator series added."""
    dx = sum(a * math.sin(2 * j * x) * math.cosh(2 * j * y) for j, a in enumerate(coefficients, 1))
    dy = sum(a * math.cos(2 * j * x) * math.sinh(2 * j * y) for j, a in enumerate(coefficients, 1))
    return x + sign * dx, y + sign * dy


def to_degrees(epsg: int, x: float, y: float) -> tuple[float, float]:
    if epsg == 4326:
        return x, y
    if epsg == geo.WEB_MERCATOR:
        return math.degrees(x / geo.SEMI_MAJOR), math.degrees(math.atan(math.sinh(y / geo.SEMI_MAJOR)))
    if epsg // 100 not in (326, 327):
        return projections.of(epsg).inverse(x, y, math)
    xi, eta = _series(
        geo.INVERSE, (y - (0 if epsg // 100 == 326 else geo.FALSE_NORTHING)) / (geo.SCALE * geo.RADIUS),
        (x - geo.FALSE_EASTING) / (geo.SCALE * geo.RADIUS), -1,
    )
    chi = math.asin(math.sin(xi) / math.cosh(eta))
    phi = chi + sum(d * math.sin(2 * j * chi) for j, d in enumerate(geo.TO_LATITUDE, 1))
    return geo.central_meridian(epsg) + math.degrees(math.atan2(math.sinh(eta), math.cos(xi))), math.degrees(phi)


def from_degrees(epsg: int, lon: float, lat: float) -> tuple[float, float]:
    if epsg == 4326:
        return lon, lat
    if epsg == geo.WEB_MERCATOR:
        return geo.SEMI_MAJOR * math.radians(lon), geo.SEMI_MAJOR * math.asinh(math.tan(math.radians(lat)))
    if epsg // 100 not in (326, 327):
        return projections.of(epsg).forward(lon, lat, math)
    s, lam = math.sin(math.radians(lat)), math.radians(lon - geo.central_meridian(epsg))
    t = math.sinh(math.atanh(s) - geo.ECCENTRICITY * math.atanh(geo.ECCENTRICITY * s))
    xi, eta = _series(geo.FORWARD, math.atan2(t, math.cos(lam)), math.atanh(math.sin(lam) / math.hypot(1, t)), 1)
    return geo.FALSE_EASTING + geo.SCALE * geo.RADIUS * eta, (0 if epsg // 100 == 326 else geo.FALSE_NORTHING) + geo.SCALE * geo.RADIUS * xi


def project_bounds(source: int, target: int, bounds: tuple[float, float, float, float]) -> tuple[float, float, float, float]:
    """Bounds in another projection, from points along the edges."""
    left, bottom, right, top = bounds
    steps = [i / (EDGE_POINTS - 1) for i in range(EDGE_POINTS)]
    edge = [(left + (right - left) * t, y) for t in steps for y in (bottom, top)] + [(x, bottom + (top - bottom) * t) for t in steps for x in (left, right)]
    points = [from_degrees(target, *to_degrees(source, x, y)) for x, y in edge]
    xs, ys = zip(*points, strict=True)
    return min(xs), min(ys), max(xs), max(ys)


def resolve_target(spec: str, source: int, bounds: tuple[float, float, float, float]) -> int:
    """The projection asked for; 'auto' is the UTM zone of the centre, if the scene stays within one more."""
    if spec.strip().lower() != "auto":
        return parse_crs(spec)
    left, bottom, right, top = project_bounds(source, 4326, bounds)
    places = [((left + right) / 2, (bottom + top) / 2), (left, bottom), (left, top), (right, bottom), (right, top)]
    codes = [utm_epsg(*p) for p in places]
    zones = [c % 100 for c in codes]
    if max(zones) - min(zones) > ZONE_SPAN:
        raise ReprojectionError("the scene spans too many UTM zones", hint="name a target projection", context={"zones": sorted(set(zones))})
    return codes[0]


def output_grid(source: int, target: int, bounds: tuple[float, float, float, float], size: tuple[int, int], resolution: float | None, snap: bool) -> Grid:
    """Grid over ``bounds``; without a resolution square pixels keep the number along the diagonal."""
    left, bottom, right, top = project_bounds(source, target, bounds)
    if resolution is None:
        resolution = math.hypot(right - left, top - bottom) / math.hypot(*size)
    if not (resolution > 0 and right > left and top > bottom):
        raise ReprojectionError("the output grid is empty")
    if snap:
        left, top = math.floor(left / resolution) * resolution, math.ceil(top / resolution) * resolution
        right, bottom = math.ceil(right / resolution) * resolution, math.floor(bottom / resolution) * resolution
    width, height = (max(1, math.ceil(round(x / resolution, 6))) for x in (right - left, top - bottom))
    return Grid(target, (resolution, 0.0, left, 0.0, -resolution, top), width, height, resolution)


def reference_grid(target: int, transform: tuple[float, ...], bounds: tuple[float, float, float, float]) -> Grid:
    """Grid over ``bounds`` (in ``target``) whose pixels lie on those of a reference; it may reach beyond it."""
    r, ox, oy = abs(transform[0]), transform[2], transform[5]
    left, bottom, right, top = bounds
    out_left = ox + math.floor((left - ox) / r) * r
    out_top = oy - math.floor((oy - top) / r) * r
    width, height = max(1, math.ceil((right - out_left) / r)), max(1, math.ceil((out_top - bottom) / r))
    return Grid(target, (r, 0.0, out_left, 0.0, -r, out_top), width, height, r)


def preview_size(width: int, height: int, longest: int) -> tuple[int, int]:
    """(width, height) with the longest side at most ``longest``; never larger than the source."""
    scale = min(1.0, longest / max(width, height))
    return max(1, round(width * scale)), max(1, round(height * scale))


def resolution_token(resolution: float) -> str:
    return f"{resolution:.6f}".rstrip("0").rstrip(".").replace(".", "p") + "m"


def product_slug(path: str) -> str:
    stem = re.sub(r"(?<=.)\.[^.]*$", "", re.split(r"[/\\]", path.rstrip("/"))[-1]).lower()
    return re.sub("[^a-z0-9]+", "_", stem).strip("_") or "product"
