"""Validation of a catalog: a row per raster and check."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

PASSED, WARNING, FAILED, SKIPPED = "passed", "warning", "failed", "skipped"
GIB = 1024.0**3


def _status(ok: Column, bad: str) -> Column:
    return F.when(F.coalesce(ok, F.lit(False)), PASSED).otherwise(bad)


def catalog_checks(
    catalog: DataFrame, require_rpc: bool = False, require_wavelengths: bool = False, require_georeferencing: bool = True,
    max_gib: float | None = 16.0,
) -> DataFrame:
    """raster_id, position, name, status, message of every raster of ``catalog``; narrow, metadata only.

    Wants raster_id, width, height, band_count, nodata, nodata_is_nan,
    has_affine, crs_defined, rpc_available, rpc_usable, wavelengths and
    estimated_bytes.
    """
    w = F.col("wavelengths")
    gone = F.size(F.filter(w, lambda x: x.isNull()))
    none = (F.size(w) == 0) | w.isNull()
    down = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.size(w) - 1, F.lit(1))), F.lit(0), lambda n, i: n + F.when(F.get(w, i) <= F.get(w, i - 1), 1).otherwise(0),
    )
    placed = F.col("has_affine") & F.col("crs_defined")
    size = F.col("estimated_bytes") / F.lit(GIB)
    lacking = FAILED if require_wavelengths else WARNING
    rules: list[tuple[str, Column, Column]] = [
        ("raster_dimensions", _status((F.col("width") > 0) & (F.col("height") > 0), FAILED), F.format_string("%d x %d pixels", "width", "height")),
        ("band_count", _status(F.col("band_count") > 0, FAILED), F.format_string("%d bands", "band_count")),
        (
            "nodata_configured", _status(F.col("nodata").isNotNull() | F.col("nodata_is_nan"), WARNING),
            F.when(F.col("nodata_is_nan"), "NoData is NaN").when(F.col("nodata").isNotNull(), F.concat(F.lit("NoData is "), F.col("nodata").cast("string"))).otherwise("no NoData value: new areas would be filled with 0"),
        ),
        (
            "rpc_metadata",
            F.when(~F.col("rpc_available"), FAILED if require_rpc else SKIPPED).when(F.col("rpc_usable"), PASSED).otherwise(FAILED if require_rpc else WARNING),
            F.when(~F.col("rpc_available"), "no sensor model").when(F.col("rpc_usable"), "usable sensor model").otherwise("the sensor model is not usable"),
        ),
        (
            "georeferencing", _status(placed | F.col("rpc_available"), FAILED if require_georeferencing else WARNING),
            F.when(placed, "affine transform with a CRS").when(F.col("rpc_available"), "sensor model").otherwise("neither a CRS with a transform nor a sensor model"),
        ),
        (
            "wavelength_metadata",
            F.when(none | (gone > 0), lacking).when(down > 0, WARNING).otherwise(PASSED),
            F.when(
                none | (gone > 0), F.format_string("%d of %d bands without a wavelength", gone, F.size(w)),
            ).when(down > 0, F.format_string("%d steps descend or repeat", down)).otherwise("all bands have wavelengths"),
        ),
        (
            "product_size", F.lit(SKIPPED) if max_gib is None else F.when(size > max_gib, FAILED).otherwise(PASSED),
            F.format_string("%.2f GiB uncompressed", size),
        ),
    ]
    made = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(n).alias("name"), s.alias("status"), m.alias("message")) for i, (n, s, m) in enumerate(rules)])
    return catalog.select("raster_id", F.explode(made).alias("c")).select("raster_id", "c.*")


def summary(checks: DataFrame, strict: bool = False) -> DataFrame:
    """Counts by status of every raster, and whether nothing blocks it; with ``strict`` warnings do."""
    n = {k: F.count_if(F.col("status") == s).alias(k) for k, s in (("passed", PASSED), ("warnings", WARNING), ("failed", FAILED), ("skipped", SKIPPED))}
    blocking = [FAILED, WARNING] if strict else [FAILED]
    return checks.groupBy("raster_id").agg(*n.values(), (F.count_if(F.col("status").isin(blocking)) == 0).alias("is_valid"))


def non_monotonic(bands: DataFrame, keys: Sequence[str] = ("raster_id",)) -> DataFrame:
    """Steps at which a raster's wavelengths descend or repeat."""
    before = F.lag("wavelength_nm").over(W.partitionBy(*keys).orderBy("band"))
    return bands.withColumn("__b", before).groupBy(*keys).agg(F.count_if(F.col("wavelength_nm") <= F.col("__b")).alias("steps"))
