"""Inspection and validation of products, and their text."""

from __future__ import annotations

import platform
from typing import Any

import pyspark
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import errors
from .plans import checks, grids
from .plans.requests import ValidationRequest
from .services import open_dem, resolve_path
from .sources import catalog, files, raster, sinks

#: What a failed check is raised as.
RAISES = {
    "product_structure": errors.ProductStructureError, "raster_readable": errors.RasterReadError, "raster_dimensions": errors.ProductError, "band_count": errors.ProductError, "band_subset": errors.ProductError,
    "rpc_metadata": errors.MissingRPCMetadataError, "georeferencing": errors.MissingGeoreferencingError, "wavelength_metadata": errors.InvalidWavelengthError, "product_size": errors.ProductError, "dem": errors.UnreadableDEMError,
    "output_directory": errors.OutputPathError, "projection_self_test": errors.DependencyError,
}


def environment() -> dict[str, Any]:
    """Versions, and whether the built-in projections agree with themselves."""
    lon, lat = grids.to_degrees(32632, *grids.from_degrees(32632, 10.0, 45.0))
    return {
        "engine": "cubeloom", "python": platform.python_version(), "spark": pyspark.__version__,
        "projections": "ok" if abs(lon - 10) + abs(lat - 45) < 1e-9 else "broken",
    }


def inspect(spark: SparkSession, path: str, bands: list[int] | None = None, checksum: bool = False) -> dict[str, Any]:
    """Everything that headers say about a product; no pixel is read."""
    chosen = resolve_path(spark, path)
    rasters, per_band = catalog.inspect(spark, {"in": chosen})
    info = rasters.first().asDict(recursive=True)
    wanted = per_band.orderBy("band") if bands is None else per_band.filter(F.col("band").isin(bands)).orderBy("band")
    listed = [r.asDict(recursive=True) for r in wanted.collect()]
    if bands is not None and len(listed) != len(set(bands)):
        raise errors.RasterReadError("bands do not exist", context={"bands": bands, "band_count": info["band_count"]})
    out = {"input": path, "raster": info, "bands": listed, "environment": environment(), "layout": None, "sha256": None}
    if chosen != path:
        out["layout"] = files.totals(files.inventory(spark, path)).first().asDict()
    if checksum:
        out["sha256"] = files.checksums(spark, chosen).first()["sha256"]
    return out


def validate(spark: SparkSession, request: ValidationRequest) -> dict[str, Any]:
    """Ordered checks of one product; stops early only if there is nothing to look at."""
    out: list[dict[str, Any]] = []

    def add(name: str, status: str, message: str) -> None:
        out.append({"name": name, "status": status, "message": message})

    env = environment()
    add("projection_self_test", checks.PASSED if env["projections"] == "ok" else checks.FAILED, f"built-in projections: {env['projections']}")
    try:
        path = resolve_path(spark, request.input)
        add("product_structure", checks.PASSED, f"raster {path}")
        raster.header(path)
        add("raster_readable", checks.PASSED, "the header is readable")
    except errors.CubeError as e:
        add("product_structure" if isinstance(e, errors.ProductStructureError) else "raster_readable", checks.FAILED, str(e))
        return _verdict(request, out)
    rasters, _ = catalog.inspect(spark, {"in": path})
    row = rasters.cache()
    info = row.first()
    found = checks.catalog_checks(row, request.require_rpc, request.require_wavelengths, request.require_georeferencing, request.max_uncompressed_gb)
    rows = {r["name"]: r for r in found.orderBy("position").collect()}
    row.unpersist()
    for name in ("raster_dimensions", "band_count"):
        add(name, rows[name]["status"], rows[name]["message"])
    if request.bands is None:
        add("band_subset", checks.SKIPPED, "no bands asked for")
    else:
        beyond = [b for b in request.bands if b > info["band_count"]]
        add("band_subset", checks.FAILED if beyond else checks.PASSED, f"bands {beyond} do not exist" if beyond else "all bands exist")
    for name in ("nodata_configured", "rpc_metadata", "georeferencing"):
        add(name, rows[name]["status"], rows[name]["message"])
    if request.wavelengths_nm is not None:
        same = len(request.wavelengths_nm) == info["band_count"]
        add("wavelength_metadata", checks.PASSED if same else checks.FAILED, "wavelengths are given" if same else "the wavelengths given do not fit the bands")
    else:
        add("wavelength_metadata", rows["wavelength_metadata"]["status"], rows["wavelength_metadata"]["message"])
    add("product_size", rows["product_size"]["status"], rows["product_size"]["message"])
    if request.dem:
        try:
            dem = open_dem(request.dem)
            add("dem", checks.PASSED, "readable elevation model")
            add("dem_band_count", checks.PASSED if dem.count == 1 else checks.WARNING, f"{dem.count} bands")
            add("dem_nodata", checks.WARNING if dem.nodata is None else checks.PASSED, "no NoData value" if dem.nodata is None else f"NoData is {dem.nodata:g}")
        except errors.CubeError as e:
            add("dem", checks.FAILED, str(e))
    if request.check_output:
        try:
            sinks.check_folder(request.output_dir)
            add("output_directory", checks.PASSED, "can be written")
        except errors.OutputPathError as e:
            add("output_directory", checks.FAILED, str(e))
    return _verdict(request, out)


def _verdict(request: ValidationRequest, rows: list[dict[str, Any]]) -> dict[str, Any]:
    counts = {s: sum(r["status"] == s for r in rows) for s in (checks.PASSED, checks.WARNING, checks.FAILED, checks.SKIPPED)}
    blocking = [r for r in rows if r["status"] == checks.FAILED or (request.strict and r["status"] == checks.WARNING)]
    return {
        "input": request.input, "is_valid": not blocking, "counts": counts, "summary": ", ".join(f"{n} {s}" for s, n in counts.items()),
        "checks": rows, "blocking": [r["name"] for r in blocking],
    }


def raise_if_invalid(report: dict[str, Any]) -> None:
    """The first blocking check as its error; the others in its context."""
    if report["blocking"]:
        first = next(r for r in report["checks"] if r["name"] == report["blocking"][0])
        raise RAISES.get(first["name"], errors.ProductError)(first["message"], context={"check": first["name"], "also": report["blocking"][1:]})


def human_bytes(n: int) -> str:
    """As :func:`cubeloom.functions.text.format_bytes`, for one number."""
    if n < 1024:
        return f"{n} B"
    for power, unit in enumerate(("KiB", "MiB", "GiB"), 1):
        if n < 1024 ** (power + 1):
            return f"{n / 1024**power:.1f} {unit}"
    return f"{n / 1024**4:.1f} TiB"


def inspection_text(found: dict[str, Any], band_limit: int = 10) -> str:
    r = found["raster"]
    lines = [
        f"Input            {found['input']}", f"Raster           {r['path']}", f"Format           {r['driver']}, {r['dtype']}",
        f"Size             {r['width']} x {r['height']}, {r['band_count']} bands",
        f"NoData           {'NaN' if r['nodata_is_nan'] else 'not set' if r['nodata'] is None else format(r['nodata'], 'g')}",
    ]
    lines += [
        f"CRS              {'EPSG:' + str(r['epsg']) if r['epsg'] else 'none'}", f"Transform        {tuple(r['transform'])}",
        f"Sensor model     {'usable' if r['rpc_usable'] else 'present, not usable' if r['rpc_available'] else 'none'}",
        f"Uncompressed     {human_bytes(r['estimated_bytes'])}", f"Blocks           {r['block_width']} x {r['block_height']}",
    ]
    lines += [f"{k:<16} {v}" for k, v in (r["metadata"] or {}).items()]
    if found["sha256"]:
        lines.append(f"SHA-256          {found['sha256']}")
    shown = found["bands"] if band_limit <= 0 else found["bands"][:band_limit]
    lines.append("Band  nm        description")
    lines += [f"{b['band']:<5} {'-' if b['wavelength_nm'] is None else format(b['wavelength_nm'], '.1f'):<9} {b['description'] or ''}".rstrip() for b in shown]
    if len(shown) < len(found["bands"]):
        lines.append(f"... {len(found['bands']) - len(shown)} more bands")
    return "\n".join(lines)


def validation_text(report: dict[str, Any]) -> str:
    lines = [f"{r['status'].upper():<8} {r['name']}: {r['message']}" for r in report["checks"]]
    return "\n".join([*lines, f"{'VALID' if report['is_valid'] else 'NOT VALID'}: {report['summary']}"])


