"""What a user asks for: a request in, a file and a small result out.

Each service plans on the driver from headers, declares one Spark plan over the
tiles it needs, and ends in an atomic sink.
"""

from __future__ import annotations

import json
import logging
from collections.abc import Sequence
from dataclasses import asdict, dataclass, replace
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import errors
from .functions import geo, pixels
from .operators import bands as bands_op
from .operators import cube as cube_op
from .operators import ortho, quality, resample, stats
from .plans import grids
from .plans.requests import IndexRequest, MaskRequest, OrthoRequest, PreviewRequest, ProfileRequest, ReprojectRequest, Request
from .sources import catalog, files, raster, sinks, tiff

ENGINE = "cubeloom"
#: Names of statistics in sidecars.
STATISTICS = {
    "band": "band_index", "count": "valid_count", "min": "minimum", "max": "maximum", "mean": "mean", "std": "std", "p2": "percentile_2",
    "p98": "percentile_98",
}
LOG = logging.getLogger("cubeloom.services")
#: Bytes that a destination grid may take.
BUDGET = 1 << 30


@dataclass(frozen=True)
class Product:
    """A resolved raster: its header and the wavelength of each band."""

    path: str
    header: tiff.Raster
    wavelengths: list[float | None]
    product_id: str


def resolve_path(spark: SparkSession, path: str) -> str:
    """A file as it is; of a folder the one image in it."""
    if "://" not in path and not Path(path).exists():
        raise errors.ProductStructureError(f"{path} does not exist")
    if "://" not in path and Path(path).is_file():
        return path
    found = [r["path"] for r in files.candidates(files.inventory(spark, path)).limit(2).collect()]
    if len(found) != 1:
        raise errors.ProductStructureError(
            "no raster in the folder" if not found else "several rasters in the folder", hint="name the file", context={"candidates": found},
        )
    return found[0].removeprefix("file:")


def open_product(spark: SparkSession, request: Request) -> Product:
    path = resolve_path(spark, request.input)
    h = raster.plain_header(path)
    _, found = catalog.inspect(spark, {"in": path})
    nm = [r["wavelength_nm"] for r in found.orderBy("band").select("wavelength_nm").collect()]
    return Product(path, h, nm, request.product_id or grids.product_slug(path))


def match(spark: SparkSession, product: Product, targets: Sequence[float], tolerance: float) -> list[int]:
    """Bands nearest to the targets; an error if one is missing."""
    found = bands_op.nearest(bands_op.target_table(spark, targets), bands_op.band_table(spark, product.wavelengths), tolerance).orderBy("pos").collect()
    missing = [r["target_nm"] for r in found if not r["matched"]]
    if missing:
        raise errors.InvalidWavelengthError("no band is near enough", context={"targets_nm": missing, "tolerance_nm": tolerance})
    return [r["band"] for r in found]


def _read(spark: SparkSession, product: Product, chosen: Sequence[int], window: tuple[int, int, int, int] | None = None) -> DataFrame:
    return raster.read(spark, product.path, list(chosen), window)


def _names(product: Product, chosen: Sequence[int]) -> list[float | None]:
    return [product.wavelengths[b - 1] if b <= len(product.wavelengths) else None for b in chosen]


def _output(product: Product, count: int, dtype: str, nodata: float | None, keep_rpc: bool, **tags: Any) -> tiff.Raster:
    h = product.header
    if h.rpc is not None and not keep_rpc:
        LOG.warning("the sensor model is not carried over", extra={"path": product.path})
    return tiff.Raster(
        width=h.width, height=h.height, count=count, dtype=dtype, nodata=nodata, transform=h.transform, epsg=h.epsg, geographic=h.geographic,
        rpc=h.rpc if keep_rpc else None, tags={"software": ENGINE} | {k: v if isinstance(v, str) else json.dumps(v) for k, v in tags.items()},
    )


def calculate_index(spark: SparkSession, request: IndexRequest) -> dict[str, Any]:
    """A normalised-difference index as a GeoTIFF, with statistics if asked for."""
    folder = sinks.check_folder(request.output_dir)
    product = open_product(spark, request)
    if request.bands is not None:
        pair = list(request.bands)
    else:
        pair = match(spark, product, (request.nir_nm, request.red_nm) if request.index == "ndvi" else (request.green_nm, request.nir_nm), request.tolerance_nm)
        if pair[0] == pair[1]:
            raise errors.SpectralAnalysisError("both targets meet the same band", context={"band": pair[0]})
    target = folder / f"{product.product_id}_{request.index}.tif"
    side = folder / f"{product.product_id}_{request.index}_statistics.json"
    for p in (target, side) if request.statistics else (target,):
        sinks.check_target(p, request.overwrite)
    cube = _read(spark, product, pair)
    value = pixels.normalised_difference(F.col("bands")[0], F.col("bands")[1], None)
    grid = cube.select("row", "col", value.cast("double").alias("value"))
    header = _output(product, 1, "float32", request.nodata, False, index=request.index, bands=pair)
    sinks.write_geotiff(grid.select("row", "col", F.array("value").alias("bands")), target, header, overwrite=request.overwrite)
    out = {
        "path": str(target), "index": request.index, "band_indices": pair, "wavelengths_nm": _names(product, pair), "nodata": request.nodata,
        "product_id": product.product_id, "statistics_path": None, "statistics": None,
    }
    if request.statistics:
        long = cube_op.stride(grid, request.sample_step).select(F.lit(1).alias("band"), "value")
        row = stats.summarise(long).first()
        row = row.asDict() if row else {"band": 1, "count": 0} | dict.fromkeys(("min", "max", "mean", "std", "p2", "p98"))
        out["statistics"] = {name: row[k] for k, name in STATISTICS.items()}
        out["statistics_path"] = str(sinks.write_json(
            side, {k: out[k] for k in ("index", "path", "band_indices", "wavelengths_nm", "nodata", "statistics")}, request.overwrite,
        ))
    return out


def extract_profile(spark: SparkSession, request: ProfileRequest) -> dict[str, Any]:
    """Mean spectrum around a pixel, as CSV and JSON; reads the tiles of its window alone."""
    folder = sinks.check_folder(request.output_dir)
    product = open_product(spark, request)
    h = product.header
    if request.row >= h.height or request.col >= h.width:
        raise errors.SpectralAnalysisError(
            "the pixel is not in the raster", context={"row": request.row, "col": request.col, "width": h.width, "height": h.height},
        )
    chosen = list(request.bands or range(1, h.count + 1))
    half = request.window_size // 2
    r0, c0 = max(0, request.row - half), max(0, request.col - half)
    window = c0, r0, min(h.width, request.col + half + 1) - c0, min(h.height, request.row + half + 1) - r0
    stem = folder / f"{product.product_id}_spectral_profile_r{request.row}_c{request.col}"
    for kind in ("csv", "json"):
        sinks.check_target(f"{stem}.{kind}", request.overwrite)
    found = {r["pos"]: r["value"] for r in stats.profile(_read(spark, product, chosen, window), request.row, request.col, request.window_size).collect()}
    values, nm = [found.get(i) for i in range(len(chosen))], _names(product, chosen)
    sinks.write_profile_csv(f"{stem}.csv", list(zip(chosen, nm, values, strict=True)), request.overwrite)
    payload = {
        "product_id": product.product_id, "row": request.row, "col": request.col, "window_size": request.window_size, "band_indices": chosen,
        "wavelengths_nm": nm, "values": values, "csv_path": f"{stem}.csv", "json_path": f"{stem}.json",
    }
    sinks.write_json(f"{stem}.json", payload, request.overwrite)
    return payload


def build_mask(spark: SparkSession, request: MaskRequest) -> dict[str, Any]:
    """Quality classes as an 8-bit GeoTIFF, with counts."""
    folder = sinks.check_folder(request.output_dir)
    product = open_product(spark, request)
    if request.bands is not None:
        chosen = list(request.bands)
    elif request.evaluation_wavelengths_nm:
        chosen = list(dict.fromkeys(match(spark, product, request.evaluation_wavelengths_nm, request.tolerance_nm)))
    else:
        chosen = list(range(1, product.header.count + 1))
    target, side = folder / f"{product.product_id}_qmask.tif", folder / f"{product.product_id}_qmask_statistics.json"
    for p in (target, side) if request.statistics else (target,):
        sinks.check_target(p, request.overwrite)
    m = request.morphology
    classes = quality.classify(
        _read(spark, product, chosen), saturation=request.saturation_dn, low_signal=request.low_signal_dn, fraction=request.band_fraction,
        anomaly=request.spectral_anomaly, cv_threshold=request.anomaly_cv_threshold,
    )
    if m.enabled:
        classes = quality.grow(classes, m.operation, m.shape, m.size, m.iterations)
    header = _output(product, 1, "uint8", float(pixels.NO_DATA), True, classes=pixels.CLASS_NAMES, bands=chosen, morphology=asdict(m))
    sinks.write_geotiff(classes.select("row", "col", F.array(F.col("class").cast("double")).alias("bands")), target, header, overwrite=request.overwrite)
    written = raster.read(spark, str(target)).select(F.coalesce(F.col("bands")[0], F.lit(float(pixels.NO_DATA))).cast("short").alias("class"))
    counts = {r["name"]: (r["count"], r["percentage"]) for r in quality.class_counts(written).collect()}
    out = {
        "path": str(target), "band_indices": chosen, "wavelengths_nm": _names(product, chosen), "counts": {k: v[0] for k, v in counts.items()},
        "product_id": product.product_id, "statistics_path": None,
    }
    if request.statistics:
        share = {k: v[1] for k, v in counts.items()}
        extra = {"percentages": share, "valid_percentage": share["valid"], "nodata_percentage": share["no_data"], "saturated_percentage": share["saturated"]}
        out["statistics_path"] = str(sinks.write_json(side, out | extra, request.overwrite))
    return out


def _budget(grid: grids.Grid, bands: int, dtype: str) -> None:
    import numpy as np

    need = grid.width * grid.height * bands * np.dtype(dtype).itemsize
    if need > BUDGET:
        raise errors.MemoryBudgetExceededError(
            "a single output file of this size is over the budget", hint="use a coarser resolution, fewer bands, or the Parquet sink",
            context={"bytes": need, "budget": BUDGET},
        )


def _warp_output(product: Product, grid: grids.Grid, chosen: Sequence[int], nodata: float | None, tags: dict[str, Any]) -> tiff.Raster:
    h = product.header
    return tiff.Raster(
        width=grid.width, height=grid.height, count=len(chosen), dtype=h.dtype, nodata=nodata, transform=grid.transform, epsg=grid.epsg,
        geographic=grid.epsg == 4326, tags={"software": ENGINE} | {k: str(v) for k, v in tags.items()},
        descriptions={i: h.descriptions[b] for i, b in enumerate(chosen, 1) if b in h.descriptions},
        band_tags={i: h.band_tags[b] for i, b in enumerate(chosen, 1) if b in h.band_tags},
    )


def _write_warp(warped: DataFrame, target: Path, header: tiff.Raster, overwrite: bool) -> None:
    """New areas get NoData, or 0 where there is none."""
    fill = F.lit(0.0 if header.nodata is None else float(header.nodata))
    whole = header.dtype.startswith(("u", "i"))
    filled = F.transform("bands", lambda v: F.coalesce(F.rint(v) if whole else v, fill))
    sinks.write_geotiff(warped.select("row", "col", filled.alias("bands")), target, header, overwrite=overwrite)


def _chosen(product: Product, request: Request, error: type[errors.CubeError]) -> list[int]:
    chosen = list(request.bands or range(1, product.header.count + 1))
    if max(chosen) > product.header.count:
        raise error("bands do not exist", context={"bands": chosen, "band_count": product.header.count})
    return chosen


def reproject(spark: SparkSession, request: ReprojectRequest) -> dict[str, Any]:
    """A map raster on another grid."""
    folder = sinks.check_folder(request.output_dir)
    product = open_product(spark, request)
    h = product.header
    if not h.placed or not grids.supported(h.epsg):
        raise errors.MissingGeoreferencingError("the raster has no transform with a projection that is supported", context={"epsg": h.epsg})
    chosen = _chosen(product, request, errors.ReprojectionError)
    if request.reference_raster:
        ref = open_reference(request.reference_raster, request.target_crs)
        epsg = ref.epsg
        bounds = grids.project_bounds(h.epsg, epsg, h.bounds)
        if bounds[2] < ref.bounds[0] or bounds[0] > ref.bounds[2] or bounds[3] < ref.bounds[1] or bounds[1] > ref.bounds[3]:
            raise errors.ReprojectionError("raster and reference do not meet")
        grid = grids.reference_grid(epsg, ref.transform, bounds)
    else:
        epsg = grids.resolve_target(request.target_crs, h.epsg, h.bounds)
        grid = grids.output_grid(h.epsg, epsg, h.bounds, (h.width, h.height), request.resolution, request.snap_to_grid)
    _budget(grid, len(chosen), h.dtype)
    word = "aligned" if request.reference_raster else "reprojected"
    target = folder / f"{product.product_id}_{word}_epsg{epsg}_{grids.resolution_token(grid.resolution)}.tif"
    sinks.check_target(target, request.overwrite)
    x, y = geo.affine(grid.transform, F.col("out_col") + 0.5, F.col("out_row") + 0.5)
    if epsg != h.epsg:
        x, y = geo.from_degrees(*geo.to_degrees(x, y, epsg), h.epsg)
    col, row = geo.affine(geo.inverse_affine(h.transform), x, y)
    places = resample.target_grid(spark, grid.width, grid.height).select("out_row", "out_col", (row - 0.5).alias("y"), (col - 0.5).alias("x"))
    nodata = request.nodata if request.nodata is not None else h.nodata
    header = _warp_output(product, grid, chosen, nodata, {"resampling": request.resampling, "source_epsg": h.epsg})
    block = resample.tile_size(len(chosen), enlarged=grid.width * grid.height / (h.width * h.height))
    warped = resample.warp_tiles(places, _read(spark, product, chosen), len(chosen), request.resampling, h.width, h.height, block)
    _write_warp(warped, target, header, request.overwrite)
    return {
        "path": str(target), "crs": f"EPSG:{epsg}", "resolution": grid.resolution, "width": grid.width, "height": grid.height,
        "band_indices": chosen, "resampling": request.resampling, "snapped": request.snap_to_grid, "reference_raster": request.reference_raster,
        "product_id": product.product_id,
    }


def open_reference(path: str, target_crs: str) -> tiff.Raster:
    """Header of a raster whose grid others are aligned to; a target projection that is named must be its own."""
    try:
        ref = raster.plain_header(path)
    except errors.RasterReadError as e:
        raise errors.ReprojectionError(f"cannot open the reference {path}", hint=str(e)) from e
    if not ref.placed:
        raise errors.ReprojectionError("the reference has no place on the ground", context={"reference_raster": path})
    if not grids.supported(ref.epsg):
        raise errors.UnsupportedError("the reference's projection is not supported", context={"epsg": ref.epsg})
    if target_crs.strip().lower() != "auto" and grids.parse_crs(target_crs) != ref.epsg:
        raise errors.ReprojectionError(
            "the target projection is not that of the reference", hint="leave it out, or name the reference's own", context={"target_crs": target_crs, "reference_epsg": ref.epsg},
        )
    _warn_unequal(ref, "reference")
    return ref


def _warn_unequal(r: tiff.Raster, what: str) -> None:
    """Grids of one resolution take that of X."""
    x, y = abs(r.transform[0]), abs(r.transform[4])
    if abs(x - y) > 1e-9 * max(x, y):
        LOG.warning("the %s's resolutions in X and Y differ; that of X is used", what, extra={"x": x, "y": y})


def open_dem(path: str) -> tiff.Raster:
    """Header of an elevation model in any store that the raster reader knows."""
    try:
        raster.open_file(path).close()
    except errors.CubeError as e:
        raise errors.MissingDEMError(f"{path} is no file", hint=str(e)) from e
    try:
        h = raster.plain_header(path)
    except errors.CubeError as e:
        raise errors.UnreadableDEMError(f"cannot read {path}", hint=str(e)) from e
    if not h.placed or not grids.supported(h.epsg):
        raise errors.UnreadableDEMError("the elevation model needs a transform in a projection that is supported", context={"epsg": h.epsg})
    return h


def orthorectify(spark: SparkSession, request: OrthoRequest) -> dict[str, Any]:
    """A sensor-geometry raster on a map grid, by sensor model and elevation."""
    folder = sinks.check_folder(request.output_dir)
    product = open_product(spark, request)
    h = product.header
    if h.rpc is None or tiff.rpc_issues(h.rpc):
        raise errors.MissingRPCMetadataError("a usable sensor model is needed", context={"issues": tiff.rpc_issues(h.rpc) if h.rpc else ["none"]})
    dem = open_dem(request.dem)
    left, bottom, right, top = scene = ortho.footprint(h.rpc)
    b = grids.project_bounds(dem.epsg, 4326, dem.bounds)
    if right < b[0] or left > b[2] or top < b[1] or bottom > b[3]:
        raise errors.UnreadableDEMError("elevation model and scene do not meet", context={"scene": scene, "dem": b})
    chosen = _chosen(product, request, errors.OrthorectificationError)
    epsg = grids.resolve_target(request.target_crs, 4326, scene)
    grid = grids.output_grid(4326, epsg, scene, (h.width, h.height), request.resolution, request.snap_to_grid)
    _budget(grid, len(chosen), h.dtype)
    target = folder / f"{product.product_id}_ortho_epsg{epsg}_{grids.resolution_token(grid.resolution)}.tif"
    sinks.check_target(target, request.overwrite)
    points = ortho.ground_points(resample.target_grid(spark, grid.width, grid.height), grid.transform, None if epsg == 4326 else epsg)
    posts = raster.read(spark, request.dem, [1]).select("row", "col", F.col("bands")[0].alias("height"))
    high = ortho.with_height(points, posts, dem.transform, request.rpc_dem_missing_value, dem.epsg)
    places = ortho.image_places(high, h.rpc, request.rpc_height_scale)
    block = resample.tile_size(len(chosen), enlarged=grid.width * grid.height / (h.width * h.height))
    warped = resample.warp_tiles(places, _read(spark, product, chosen), len(chosen), request.resampling, h.width, h.height, block)
    options = {
        "RPC_DEM": request.dem, "RPC_HEIGHT_SCALE": str(request.rpc_height_scale), "RPC_DEM_MISSING_VALUE": str(request.rpc_dem_missing_value),
        "RPC_DEM_APPLY_VDATUM_SHIFT": str(request.rpc_dem_apply_vdatum_shift),
    }
    nodata = request.nodata if request.nodata is not None else h.nodata
    header = _warp_output(product, grid, chosen, nodata, options | {"resampling": request.resampling, "error_threshold_px": request.error_threshold_px})
    _write_warp(warped, target, header, request.overwrite)
    return {
        "path": str(target), "crs": f"EPSG:{epsg}", "resolution": grid.resolution, "width": grid.width, "height": grid.height,
        "band_indices": chosen, "resampling": request.resampling, "product_id": product.product_id, "dem_path": request.dem,
        "transformer_options": options,
    }


def render_preview(spark: SparkSession, request: PreviewRequest) -> dict[str, Any]:
    """A stretched PNG, read at its own size."""
    folder = sinks.check_folder(request.output_dir)
    product = open_product(spark, request)
    h = product.header
    if request.bands is not None:
        chosen = list(request.bands)
    elif request.composite == "band":
        chosen = [request.band]
    else:
        chosen = match(spark, product, bands_op.TRUE_COLOR if request.composite == "true-color" else bands_op.FALSE_COLOR, request.tolerance_nm)
    label = f"band{chosen[0]}" if request.composite == "band" else request.composite.replace("-", "_")
    target = folder / f"{product.product_id}_preview_{label}.png"
    sinks.check_target(target, request.overwrite)
    size = grids.preview_size(h.width, h.height, request.max_dimension)
    small = raster.read(spark, product.path, list(chosen), out_shape=size)
    image = resample.composite(small, range(1, len(chosen) + 1), request.lower_percentile, request.upper_percentile, request.per_band)
    if request.blur_kernel and request.blur_kernel > 1:
        long = cube_op.to_long(image.select("row", "col", F.transform("image", lambda v: v.cast("double")).alias("bands")))
        wide = cube_op.to_wide(resample.gaussian_blur(long, request.blur_kernel))
        image = wide.select("row", "col", F.transform("bands", lambda v: F.rint(v).cast("short")).alias("image"))
    sinks.write_png(target, image, *size, overwrite=request.overwrite)
    return {
        "path": str(target), "composite": request.composite, "band_indices": chosen, "wavelengths_nm": _names(product, chosen), "width": size[0],
        "height": size[1], "product_id": product.product_id,
    }


def with_input(request: Request, path: str) -> Request:
    return replace(request, input=path)
