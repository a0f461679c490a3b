"""Band selection by wavelength: a nearest join with tolerance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Targets in nanometres and tolerances.
TRUE_COLOR = (665.0, 560.0, 490.0)
FALSE_COLOR = (842.0, 665.0, 560.0)
TOLERANCE, COMPOSITE_TOLERANCE, INDEX_TOLERANCE, MASK_TOLERANCE = 20.0, 30.0, 15.0, 20.0


def band_table(spark: SparkSession, wavelengths: Sequence[float | None]) -> DataFrame:
    """band INT, wavelength_nm DOUBLE of a raster's bands."""
    return spark.createDataFrame([(i, None if w is None else float(w)) for i, w in enumerate(wavelengths, 1)], "band int, wavelength_nm double")


def target_table(spark: SparkSession, targets: Sequence[float]) -> DataFrame:
    if not targets:
        raise ValueError("at least one target wavelength is needed")
    if any(not 0 < t < float("inf") for t in targets):
        raise ValueError("targets are finite and above 0")
    return spark.createDataFrame([(i, float(t)) for i, t in enumerate(targets)], "pos int, target_nm double")


def nearest(targets: DataFrame, bands: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Per target the nearest usable band; of two as near the lower one.

    Returns pos, target_nm, band, wavelength_nm, distance_nm, matched.  A target
    without a band in tolerance keeps its nearest band and matched is false.  The
    bands of one raster, a few hundred, are one array that every target looks
    through where it is, so any number of targets takes no shuffle.
    """
    if not 0 <= tolerance < float("inf"):
        raise ValueError("the tolerance is finite and 0 or more")
    usable = bands.filter(F.col("wavelength_nm").isNotNull() & ~F.isnan("wavelength_nm") & (F.col("wavelength_nm") > 0) & (F.col("wavelength_nm") < float("inf")))
    every = usable.groupBy().agg(F.collect_list(F.struct("band", "wavelength_nm")).alias("__bands"))
    apart = lambda b: F.struct(F.abs(b["wavelength_nm"] - F.col("target_nm")).alias("distance_nm"), b["band"].alias("band"), b["wavelength_nm"].alias("wavelength_nm"))
    best = targets.join(F.broadcast(every), F.lit(True)).withColumn("m", F.array_min(F.transform("__bands", apart)))
    return best.select(
        "pos", "target_nm", "m.band", "m.wavelength_nm", "m.distance_nm",
        F.coalesce(F.col("m.distance_nm") <= tolerance, F.lit(False)).alias("matched"),
    )
