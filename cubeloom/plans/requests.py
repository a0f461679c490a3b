"""Requests of the services: frozen, checked when made."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, fields
from pathlib import Path
from typing import Any

from ..errors import ConfigurationError


def _need(ok: bool, message: str, **context: Any) -> None:
    if not ok:
        raise ConfigurationError(message, context=context)


def _number(x: Any) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool) and math.isfinite(x)


def build(kind: type, **values: Any) -> Any:
    """A request from loose values; unknown names are refused."""
    unknown = set(values) - {f.name for f in fields(kind)}
    _need(not unknown, "unknown settings", names=sorted(unknown))
    try:
        return kind(**values)
    except TypeError as e:
        raise ConfigurationError(str(e)) from e


def _bands(values: tuple[int, ...] | None, *, ordered: bool = False) -> None:
    if values is None:
        return
    _need(len(values) > 0 and min(values) >= 1, "bands are 1-based, and at least one is needed", bands=list(values))
    _need(not ordered or len(set(values)) == len(values), "bands repeat", bands=list(values))


@dataclass(frozen=True)
class Request:
    input: str
    output_dir: str = "."
    product_id: str | None = None
    bands: tuple[int, ...] | None = None
    overwrite: bool = False

    def __post_init__(self) -> None:
        _need(bool(str(self.input).strip()), "an input is needed")
        object.__setattr__(self, "input", self.input if "://" in self.input else str(Path(self.input).expanduser()))
        if self.bands is not None:
            object.__setattr__(self, "bands", tuple(self.bands))
        _bands(self.bands)
        if self.product_id is not None:
            object.__setattr__(self, "product_id", self.product_id.strip())
            _need(bool(self.product_id), "the product id is empty")


@dataclass(frozen=True)
class ValidationRequest(Request):
    dem: str | None = None
    wavelengths_nm: tuple[float, ...] | None = None
    require_rpc: bool = False
    require_wavelengths: bool = False
    require_georeferencing: bool = True
    max_uncompressed_gb: float | None = 16.0
    strict: bool = False
    check_output: bool = False

    def __post_init__(self) -> None:
        super().__post_init__()
        _bands(self.bands, ordered=True)
        if self.bands is not None:
            object.__setattr__(self, "bands", tuple(sorted(self.bands)))
        _need(self.max_uncompressed_gb is None or (_number(self.max_uncompressed_gb) and self.max_uncompressed_gb > 0), "the size limit is above 0")
        w = self.wavelengths_nm
        if w is not None:
            _need(len(w) > 0 and all(_number(x) and x > 0 for x in w) and all(a < b for a, b in zip(w, w[1:])), "wavelengths are above 0 and increase")


@dataclass(frozen=True)
class PreviewRequest(Request):
    composite: str = "true-color"
    band: int | None = None
    lower_percentile: float = 2.0
    upper_percentile: float = 98.0
    per_band: bool = True
    max_dimension: int = 2048
    blur_kernel: int | None = None
    tolerance_nm: float = 30.0

    def __post_init__(self) -> None:
        super().__post_init__()
        _need(self.composite in ("true-color", "false-color", "band"), "unknown composite", composite=self.composite)
        _need(0 <= self.lower_percentile < 100 and 0 < self.upper_percentile <= 100 and self.lower_percentile < self.upper_percentile, "percentiles are in order within 0 and 100")
        _need(self.max_dimension > 0, "the longest side is above 0")
        _need(self.blur_kernel is None or (self.blur_kernel > 0 and self.blur_kernel % 2 == 1), "the blur kernel is odd")
        _need(_number(self.tolerance_nm) and self.tolerance_nm >= 0, "the tolerance is 0 or more")
        if self.composite == "band":
            _need(self.band is not None or (self.bands is not None and len(self.bands) == 1), "a band composite needs one band")
        else:
            _need(self.bands is None or len(self.bands) == 3, "a colour composite needs three bands")


@dataclass(frozen=True)
class IndexRequest(Request):
    index: str = "ndvi"
    red_nm: float = 665.0
    nir_nm: float = 842.0
    green_nm: float = 560.0
    tolerance_nm: float = 15.0
    nodata: float = -9999.0
    statistics: bool = False
    sample_step: int = 1

    def __post_init__(self) -> None:
        super().__post_init__()
        _need(self.index in ("ndvi", "ndwi"), "unknown index", index=self.index)
        _need(all(_number(x) and x > 0 for x in (self.red_nm, self.nir_nm, self.green_nm)), "targets are above 0")
        _need(_number(self.tolerance_nm) and self.tolerance_nm >= 0, "the tolerance is 0 or more")
        _need(self.bands is None or len(self.bands) == 2, "an index needs two bands")
        _need(self.sample_step >= 1, "the sample step is at least 1")


@dataclass(frozen=True)
class ProfileRequest(Request):
    row: int = 0
    col: int = 0
    window_size: int = 1

    def __post_init__(self) -> None:
        super().__post_init__()
        _need(self.row >= 0 and self.col >= 0, "row and col are 0 or more")
        _need(self.window_size >= 1 and self.window_size % 2 == 1, "the window is odd")


@dataclass(frozen=True)
class Morphology:
    enabled: bool = True
    operation: str = "dilate"
    shape: str = "rect"
    size: int = 3
    iterations: int = 1

    def __post_init__(self) -> None:
        _need(self.operation in ("open", "close", "dilate", "erode"), "unknown operation", operation=self.operation)
        _need(self.shape in ("rect", "ellipse", "cross"), "unknown kernel shape", shape=self.shape)
        _need(self.size >= 1 and self.size % 2 == 1 and self.iterations >= 1, "kernels are odd and applied at least once")


@dataclass(frozen=True)
class MaskRequest(Request):
    saturation_dn: float = 65535.0
    low_signal_dn: float = 10.0
    band_fraction: float = 0.5
    evaluation_wavelengths_nm: tuple[float, ...] = (490.0, 560.0, 665.0, 842.0)
    tolerance_nm: float = 20.0
    morphology: Morphology = field(default_factory=Morphology)
    spectral_anomaly: bool = False
    anomaly_cv_threshold: float = 2.0
    statistics: bool = False

    def __post_init__(self) -> None:
        super().__post_init__()
        _need(self.low_signal_dn < self.saturation_dn, "the low limit is below saturation")
        _need(0 < self.band_fraction <= 1, "the band fraction is within 0 and 1")
        _need(self.anomaly_cv_threshold > 0, "the anomaly threshold is above 0")
        _need(all(_number(x) and x > 0 for x in self.evaluation_wavelengths_nm), "wavelengths are above 0")


@dataclass(frozen=True)
class ReprojectRequest(Request):
    target_crs: str = "auto"
    resolution: float | None = None
    resampling: str = "bilinear"
    data_semantics: str = "continuous"
    reference_raster: str | None = None
    snap_to_grid: bool = False
    nodata: float | None = None

    def __post_init__(self) -> None:
        super().__post_init__()
        _need(bool(self.target_crs.strip()), "a target projection is needed")
        _need(self.resolution is None or (_number(self.resolution) and self.resolution > 0), "the resolution is above 0")
        _need(self.resampling in ("nearest", "bilinear", "cubic"), "unknown resampling", resampling=self.resampling)
        _need(self.data_semantics in ("continuous", "categorical"), "unknown semantics", data_semantics=self.data_semantics)
        if self.data_semantics == "categorical":
            object.__setattr__(self, "resampling", "nearest")


@dataclass(frozen=True)
class OrthoRequest(ReprojectRequest):
    dem: str = ""
    resolution: float | None = 30.0
    mask_resampling: str = "nearest"
    error_threshold_px: float = 0.125
    rpc_dem_missing_value: float | None = None
    rpc_height_scale: float = 1.0
    rpc_dem_apply_vdatum_shift: bool = False
    warp_memory_mb: int = 512

    def __post_init__(self) -> None:
        super().__post_init__()
        _need(bool(self.dem), "an elevation model is needed")
        _need(self.error_threshold_px > 0 and self.warp_memory_mb >= 1, "error threshold and memory are above 0")
        if self.data_semantics == "categorical":
            object.__setattr__(self, "mask_resampling", "nearest")
