"""Orthorectification as joins: ground point, elevation, sensor model, source taps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from .resample import warp


def ground_points(grid: DataFrame, transform: Sequence[float], epsg: int | None) -> DataFrame:
    """out_row, out_col, lon, lat of pixel centres; None means degrees."""
    x, y = geo.affine(transform, F.col("out_col") + 0.5, F.col("out_row") + 0.5)
    if epsg is not None:
        x, y = geo.to_degrees(x, y, epsg)
    return grid.select("out_row", "out_col", x.alias("lon"), y.alias("lat"))


def with_height(points: DataFrame, dem: DataFrame, transform: Sequence[float], missing: float | None = None, epsg: int = 4326) -> DataFrame:
    """Adds height from ``dem`` (row, col, height) in the projection ``epsg``, nearest post.

    Points off the model or on NoData posts take ``missing``, or drop out if it
    is None.  Catalyst broadcasts the model if its size allows, and shuffles both
    by post otherwise.
    """
    c, r = geo.pixel(transform, *geo.from_degrees(F.col("lon"), F.col("lat"), epsg))
    posts = dem.filter(F.col("height").isNotNull() & ~F.isnan("height"))
    keyed = points.select("*", F.floor(r).cast("int").alias("row"), F.floor(c).cast("int").alias("col"))
    joined = keyed.join(posts, ["row", "col"], "inner" if missing is None else "left")
    return joined.select("out_row", "out_col", "lon", "lat", F.coalesce("height", F.lit(missing)).cast("double").alias("height"))


def orthorectify(
    points: DataFrame, long: DataFrame, rpc: dict, method: str, width: int, height: int, height_scale: float = 1.0, centre: float = 0.0,
) -> DataFrame:
    """out_row, out_col, band, value of points with heights."""
    return warp(image_places(points, rpc, height_scale, centre), long, method, width, height)


def image_places(points: DataFrame, rpc: dict, height_scale: float = 1.0, centre: float = 0.0) -> DataFrame:
    """out_row, out_col and the place (y, x) in the image; ``centre`` is added if the model counts from corners."""
    line, sample = geo.rpc_project(rpc, F.col("lon"), F.col("lat"), F.col("height") * height_scale)
    return points.select("out_row", "out_col", (line + centre).alias("y"), (sample + centre).alias("x"))


def footprint(rpc: dict) -> tuple[float, float, float, float]:
    """(left, bottom, right, top) in degrees that the model is normalised over."""
    lon, lat = abs(rpc["long_scale"]), abs(rpc["lat_scale"])
    return rpc["long_off"] - lon, rpc["lat_off"] - lat, rpc["long_off"] + lon, rpc["lat_off"] + lat
