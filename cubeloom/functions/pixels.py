"""Column builders for pixel values: validity, indices, quality classes, stretches.

NULL is NoData.  NaN and infinities are measured but unusable values and are kept
apart from it, because the quality classes tell the two from each other.  Spark
orders NaN above everything and finds it equal to itself, so every builder goes
through :func:`valid`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

INDEX_NODATA = -9999.0

#: Class codes and their names.
NO_DATA, VALID, SATURATED, LOW_SIGNAL, INVALID, SPECTRAL_ANOMALY, OTHER = 0, 1, 2, 3, 4, 5, 255
CLASS_NAMES = {NO_DATA: "no_data", VALID: "valid", SATURATED: "saturated", LOW_SIGNAL: "low_signal", INVALID: "invalid_numeric", SPECTRAL_ANOMALY: "spectral_anomaly", OTHER: "unclassified"}

_INF = float("inf")


def finite(v: Column) -> Column:
    """NULL for NULL.  Two comparisons do: Spark puts NaN above infinity."""
    return (v < _INF) & (v > -_INF)


def usable(v: Column, nodata: float | None = None) -> Column:
    """Present and finite; NULL for NULL, which filters and conditions take as false."""
    out = finite(v)
    return out if nodata is None or nodata != nodata or abs(nodata) == _INF else out & (v != F.lit(float(nodata)))


def valid(v: Column, nodata: float | None = None) -> Column:
    """A usable sample: present and finite; never NULL itself."""
    return F.coalesce(usable(v, nodata), F.lit(False))


def masked(v: Column, nodata: float | None) -> Column:
    """``v`` with NoData as NULL; a NaN NoData masks NaN."""
    if nodata is None:
        return v
    hit = F.isnan(v) if nodata != nodata else v == F.lit(float(nodata))
    return F.when(~hit, v)


def as_float32(v: Column) -> Column:
    """Rounded to float32, then back for arithmetic."""
    return v.cast("float").cast("double")


def fill_nan(v: Column) -> Column:
    return F.coalesce(v, F.lit(float("nan")))


def normalised_difference(a: Column, b: Column, nodata: float | None = INDEX_NODATA) -> Column:
    """(a - b) / (a + b) as float32; undefined pixels get ``nodata`` (NULL if that is None)."""
    a, b = a.cast("double"), b.cast("double")
    value = F.when(valid(a) & valid(b) & ((a + b) != 0), ((a - b) / (a + b)).cast("float"))
    return value if nodata is None else F.coalesce(value, F.lit(float(nodata)).cast("float"))


def ndvi(nir: Column, red: Column, nodata: float | None = INDEX_NODATA) -> Column:
    return normalised_difference(nir, red, nodata)


def ndwi(green: Column, nir: Column, nodata: float | None = INDEX_NODATA) -> Column:
    return normalised_difference(green, nir, nodata)


def good_bands(bands: Column, nodata: float | None = None) -> Column:
    """The usable samples of a pixel."""
    return F.filter(bands, lambda v: usable(v, nodata))


def quality_class(
    bands: Column,
    saturation: float = 65535.0,
    low_signal: float = 10.0,
    fraction: float = 0.5,
    nodata: float | None = None,
    anomaly: bool = False,
    cv_threshold: float = 2.0,
    good: Column | None = None,
) -> Column:
    """Class code of a pixel from its bands.

    In order: no valid band, any unusable value, saturated share of the valid
    bands, low share, spectral anomaly (if asked for), valid.  ``good`` is
    :func:`good_bands` if a column holds it already.
    """
    good = good_bands(bands, nodata) if good is None else good
    n = F.size(good)
    least = F.greatest(n, F.lit(1)).cast("double")
    unusable = F.exists(bands, lambda v: (v >= _INF) | (v <= -_INF))
    saturated = F.size(F.filter(good, lambda v: v >= F.lit(float(saturation)))) / least
    low = F.size(F.filter(good, lambda v: v <= F.lit(float(low_signal)))) / least
    out = F.when(n == 0, NO_DATA).when(F.coalesce(unusable, F.lit(False)), INVALID).when(saturated >= fraction, SATURATED).when(low >= fraction, LOW_SIGNAL)
    if anomaly:
        out = out.when(F.coalesce(variation(good) > cv_threshold, F.lit(False)), SPECTRAL_ANOMALY)
    return out.otherwise(VALID).cast("short")


def variation(good: Column) -> Column:
    """Population deviation over mean of usable samples; NULL unless the mean is positive."""
    n = F.size(good).cast("double")
    mean = F.when(n > 0, F.aggregate(good, F.lit(0.0), lambda s, v: s + v) / n)
    square = F.aggregate(good, F.lit(0.0), lambda s, v: s + (v - mean) * (v - mean))
    return F.when(mean > 0, F.sqrt(square / n) / mean)


def stretched(v: Column, low: Column, high: Column) -> Column:
    """0-255 from ``low`` to ``high``, ties to even; what is not usable becomes 0."""
    scaled = (v - low) / (high - low) * 255.0
    return F.when(valid(v), F.rint(F.least(F.greatest(scaled, F.lit(0.0)), F.lit(255.0)))).otherwise(0.0).cast("short")


def pick(bands: Column, indices: Sequence[int]) -> Column:
    """Bands by 1-based index, in the caller's order."""
    return F.array(*[bands[i - 1] for i in indices])
