"""Gathers on grids: warps with nearest, bilinear and cubic taps, block means, blurs, decimation.

A warp is an equi-join: every target pixel is a fractional source place, its
taps are whole source pixels with weights, and the values are a weighted sum by
target pixel.  NULL and unusable taps drop out and the other weights are scaled
up; a target whose nearest source pixel is not in the grid is NULL.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.pixels import valid
from . import stencil

TAPS = {"nearest": (0,), "bilinear": (0, 1), "cubic": (-1, 0, 1, 2)}


def target_grid(spark: SparkSession, width: int, height: int) -> DataFrame:
    """out_row, out_col of a grid, made by ranges: nothing is collected."""
    return spark.range(width * height).select(
        (F.col("id") / width).cast("long").cast("int").alias("out_row"), (F.col("id") % width).cast("int").alias("out_col"),
    )


def _cubic(t: Column) -> Column:
    """Kernel with a = -0.5 at distance t >= 0."""
    return F.when(t <= 1, 1.5 * t * t * t - 2.5 * t * t + 1).when(t < 2, -0.5 * t * t * t + 2.5 * t * t - 4 * t + 2).otherwise(0.0)


def _weight(method: str, distance: Column) -> Column:
    return F.lit(1.0) if method == "nearest" else 1 - distance if method == "bilinear" else _cubic(distance)


def taps(places: DataFrame, method: str = "bilinear") -> DataFrame:
    """(out_row, out_col, y, x) with pixel centres at whole numbers -> a row per tap: row, col, weight."""
    if method not in TAPS:
        raise ValueError(f"unknown resampling {method!r}")
    y, x = F.col("y"), F.col("x")
    if method == "nearest":
        return places.select(
            "out_row", "out_col", F.floor(y + 0.5).cast("int").alias("row"), F.floor(x + 0.5).cast("int").alias("col"), F.lit(1.0).alias("weight"),
        )
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in TAPS[method] for b in TAPS[method]])
    spread = places.withColumn("__y0", F.floor(y)).withColumn("__x0", F.floor(x)).withColumn("__t", F.explode(steps))
    row, col = F.col("__y0") + F.col("__t.a"), F.col("__x0") + F.col("__t.b")
    weight = _weight(method, F.abs(row - y)) * _weight(method, F.abs(col - x))
    return spread.select("out_row", "out_col", row.cast("int").alias("row"), col.cast("int").alias("col"), weight.alias("weight"))


def gather(tapped: DataFrame, long: DataFrame) -> DataFrame:
    """out_row, out_col, band, value from taps and samples."""
    good = F.when(valid(F.col("value")), F.col("weight"))
    joined = tapped.join(long, ["row", "col"])
    total = F.sum(good)
    value = F.when(F.abs(total) > 1e-12, F.sum(good * F.col("value")) / total)
    return joined.groupBy("out_row", "out_col", "band").agg(value.alias("value"))


def warp(places: DataFrame, long: DataFrame, method: str, width: int, height: int) -> DataFrame:
    """Resample ``long`` of a ``width`` x ``height`` source at ``places``; centres outside it give no row."""
    inside = places.filter((F.col("y") >= -0.5) & (F.col("y") < height - 0.5) & (F.col("x") >= -0.5) & (F.col("x") < width - 0.5))
    return gather(taps(inside, method), long)


def tile_size(bands: int, limit: int = 24 << 20, enlarged: float = 1.0) -> int:
    """Side of the source tiles of :func:`warp_tiles`, so that one takes at most ``limit`` bytes.

    ``enlarged`` is how many target pixels there are for each source pixel: with more
    of them tiles get smaller, so that those that ask one tile take no more either.
    """
    room = limit / (8 * max(1, bands) * max(1.0, enlarged))
    return max(4, min(256, int(room**0.5) // 4 * 4)) if enlarged > 1 else max(16, min(256, int(room**0.5) // 16 * 16))


def warp_tiles(places: DataFrame, cube: DataFrame, bands: int, method: str, width: int, height: int, block: int | None = None) -> DataFrame:
    """The same as :func:`warp` for whole cubes: row, col, bands of the target.

    Instead of a row per tap and band, every target pixel is sent once, to the
    source tile it falls in, and every source pixel once, plus a margin of three
    pixels that neighbouring tiles share.  A tile is a bounded array in its task.
    """
    if method not in TAPS:
        raise ValueError(f"unknown resampling {method!r}")
    b = block or tile_size(bands)
    inside = places.filter((F.col("y") >= -0.5) & (F.col("y") < height - 0.5) & (F.col("x") >= -0.5) & (F.col("x") < width - 0.5))
    shift = 0.5 if method == "nearest" else 0.0
    tile = lambda c: F.floor(F.floor(c + shift) / b).cast("int")
    asked = inside.select(tile(F.col("y")).alias("tr"), tile(F.col("x")).alias("tc"), "out_row", "out_col", "y", "x")
    # taps reach from one pixel before the base pixel to two after it
    owners = lambda c: F.array_distinct(F.array(F.floor((F.col(c) - 2) / b).cast("int"), F.floor((F.col(c) + 1) / b).cast("int")))
    held = cube.withColumn("tr", F.explode(owners("row"))).withColumn("tc", F.explode(owners("col"))).select("tr", "tc", "row", "col", "bands")

    def solve(asked: pa.Table, held: pa.Table) -> pa.Table:
        n = asked.num_rows
        if not n:
            return pa.table({"row": pa.array([], pa.int32()), "col": pa.array([], pa.int32()), "bands": pa.array([], pa.list_(pa.float64()))})
        top, left = (asked.column(k)[0].as_py() * b - 1 for k in ("tr", "tc"))
        grid = np.full((b + 4, b + 4, bands), np.nan)
        if held.num_rows:
            flat = held.column("bands").combine_chunks().flatten()
            values = np.asarray(flat.fill_null(np.nan)).reshape(-1, bands)
            grid[np.asarray(held.column("row")) - top, np.asarray(held.column("col")) - left] = values
        y, x = (np.asarray(asked.column(k)) for k in ("y", "x"))
        y0, x0 = np.floor(y + shift), np.floor(x + shift)
        total, weights = np.zeros((n, bands)), np.zeros((n, bands))
        for dy in TAPS[method]:
            for dx in TAPS[method]:
                wy, wx = (_tap_weight(method, np.abs(p0 + d - p)) for p0, d, p in ((y0, dy, y), (x0, dx, x)))
                value = grid[(y0 + dy - top).astype(int), (x0 + dx - left).astype(int)]
                good = np.isfinite(value)
                w = (wy * wx)[:, None] * good
                total += w * np.where(good, value, 0.0)
                weights += w
        found = np.abs(weights) > 1e-12
        out = np.where(found, total / np.where(found, weights, 1.0), 0.0)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * bands), pa.array(out.reshape(-1), mask=~found.reshape(-1)))
        return pa.table({"row": asked.column("out_row").combine_chunks(), "col": asked.column("out_col").combine_chunks(), "bands": lists})

    return asked.groupBy("tr", "tc").cogroup(held.groupBy("tr", "tc")).applyInArrow(solve, "row int, col int, bands array<double>")


def _tap_weight(method: str, t: np.ndarray) -> np.ndarray:
    if method == "nearest":
        return np.ones_like(t)
    if method == "bilinear":
        return 1 - t
    return np.where(t <= 1, 1.5 * t**3 - 2.5 * t**2 + 1, np.where(t < 2, -0.5 * t**3 + 2.5 * t**2 - 4 * t + 2, 0.0))


def scale_places(grid: DataFrame, source: tuple[int, int], target: tuple[int, int]) -> DataFrame:
    """Source places (y, x) of a target grid over the same ground; sizes are (width, height)."""
    sy, sx = source[1] / target[1], source[0] / target[0]
    return grid.select("out_row", "out_col", ((F.col("out_row") + 0.5) * sy - 0.5).alias("y"), ((F.col("out_col") + 0.5) * sx - 0.5).alias("x"))


def decimate(cube: DataFrame, source: tuple[int, int], target: tuple[int, int]) -> DataFrame:
    """Nearest source pixel of every target pixel: floor((i + 0.5) * source / target)."""

    def hits(name: str, size: int, to: int) -> Column:
        # target rows (columns) whose nearest source is this one: none or one when shrinking, so no join is needed
        ratio = size / to
        about = F.floor(F.col(name) / ratio - 0.5)
        near = F.sequence(F.greatest(about - 1, F.lit(0)), F.greatest(F.least(F.ceil((F.col(name) + 1) / ratio), F.lit(to - 1)), F.lit(0)))
        near = F.when(about - 1 < to, near).otherwise(F.array().cast("array<bigint>"))
        return F.filter(near, lambda i: (i >= about - 1) & (F.floor((i + 0.5) * ratio) == F.col(name)))

    placed = cube.withColumn("__r", F.explode(hits("row", source[1], target[1]))).withColumn("__c", F.explode(hits("col", source[0], target[0])))
    return placed.select(F.col("__r").cast("int").alias("row"), F.col("__c").cast("int").alias("col"), "bands")


def block_mean(long: DataFrame, factor: int) -> DataFrame:
    """Mean of the valid samples of every factor x factor block."""
    good = F.when(valid(F.col("value")), F.col("value"))
    return long.groupBy(
        (F.floor(F.col("row") / factor)).cast("int").alias("row"), (F.floor(F.col("col") / factor)).cast("int").alias("col"), "band",
    ).agg(F.avg(good).alias("value"))


def neighborhood_mean(long: DataFrame, size: int, block: int | None = None) -> DataFrame:
    """Mean of the valid samples in an odd window around every sample's place, clipped at the grid's edges; NULL if there is none.

    Samples are shuffled once, in tiles with a halo, and sums run over rows and then
    over columns of a tile, so that a window of any size costs as much as another.
    """
    if size < 1 or size % 2 == 0:
        raise ValueError("the window is odd")
    half, kind = size // 2, dict(long.dtypes)["band"]

    def solve(tile: stencil.Tile) -> pa.Table:
        here = tile.array(np.ones(len(tile.at), bool), False)
        value = tile.array(np.asarray(tile.rows["value"].combine_chunks().fill_null(np.nan)).astype(float), np.nan)
        good = np.isfinite(value)
        total, n = np.where(good, value, 0.0), good
        for axis in (0, 1):
            total, n = stencil.shifted_sum(total, half, half, axis), stencil.shifted_sum(n, half, half, axis)
        row, col, y, x = tile.inner(here)
        some = n[y, x] > 0
        band = pa.array([tile.rows["band"][0].as_py()] * len(row), tile.rows["band"].type)
        return pa.table({"row": pa.array(row), "col": pa.array(col), "band": band, "value": pa.array(total[y, x] / np.maximum(n[y, x], 1), mask=~some), "n": pa.array(n[y, x])})

    samples = long.select("row", "col", "band", F.col("value").cast("double").alias("value"))
    return stencil.in_tiles(samples, ["value"], half, solve, f"row int, col int, band {kind}, value double, n long", by=["band"], block=block)


def area_mean(long: DataFrame, source: tuple[int, int], target: tuple[int, int]) -> DataFrame:
    """Mean by covered area for any ratio of (width, height): each sample goes to the target pixels it touches."""

    def shares(name: str, size: int, to: int) -> Column:
        ratio = to / size
        at = F.col(name) * ratio
        last = F.least(F.lit(to - 1), F.ceil((F.col(name) + 1) * ratio).cast("int") - 1)
        cells = F.sequence(F.floor(at).cast("int"), F.greatest(last, F.floor(at).cast("int")))
        return F.transform(cells, lambda i: F.struct(i.alias("i"), (F.least(i + 1.0, (F.col(name) + 1) * ratio) - F.greatest(i.cast("double"), at)).alias("w")))

    spread = long.filter(valid(F.col("value"))).withColumn("__r", F.explode(shares("row", source[1], target[1]))).withColumn("__c", F.explode(shares("col", source[0], target[0])))
    w = F.col("__r.w") * F.col("__c.w")
    return spread.filter(w > 1e-12).groupBy(F.col("__r.i").alias("row"), F.col("__c.i").alias("col"), "band").agg((F.sum(F.col("value") * w) / F.sum(w)).alias("value"))


def gaussian_weights(size: int) -> list[float]:
    """One-dimensional weights of an odd kernel whose width follows from its size."""
    if size < 1 or size % 2 == 0:
        raise ValueError("blur kernels are odd")
    fixed = {1: [1.0], 3: [0.25, 0.5, 0.25], 5: [0.0625, 0.25, 0.375, 0.25, 0.0625], 7: [0.03125, 0.109375, 0.21875, 0.28125, 0.21875, 0.109375, 0.03125]}
    if size in fixed:
        return fixed[size]
    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    raw = [math.exp(-((i - size // 2) ** 2) / (2 * sigma * sigma)) for i in range(size)]
    return [x / sum(raw) for x in raw]


def gaussian_blur(long: DataFrame, size: int, width: int | None = None, height: int | None = None, block: int | None = None) -> DataFrame:
    """Separable blur, first along columns of the grid, then along rows; weights outside the grid or on NULL are shared out.

    Samples are shuffled once, in tiles with a halo.
    """
    weights = gaussian_weights(size)
    kind = dict(long.dtypes)["band"]

    def solve(tile: stencil.Tile) -> pa.Table:
        here = tile.array(np.ones(len(tile.at), bool), False)
        value = tile.array(np.asarray(tile.rows["value"].combine_chunks().fill_null(np.nan)).astype(float), np.nan)
        for axis in (0, 1):
            mean, some = stencil.weighted(value, np.isfinite(value), weights, axis)
            value = np.where(some & here, mean, np.nan)
        row, col, y, x = tile.inner(np.isfinite(value))
        band = pa.array([tile.rows["band"][0].as_py()] * len(row), tile.rows["band"].type)
        return pa.table({"row": pa.array(row), "col": pa.array(col), "band": band, "value": pa.array(value[y, x])})

    samples = long.select("row", "col", "band", F.col("value").cast("double").alias("value"))
    return stencil.in_tiles(samples, ["value"], size // 2, solve, f"row int, col int, band {kind}, value double", by=["band"], block=block)


def composite(cube: DataFrame, indices: Sequence[int], lower: float = 2.0, upper: float = 98.0, per_band: bool = True, digits: int | None = None) -> DataFrame:
    """row, col, image: one or three bands stretched to 0-255 by percentiles, per band or pooled."""
    from ..functions.pixels import pick, stretched
    from .cube import to_long
    from .stats import stretch_limits

    chosen = cube.select("row", "col", pick(F.col("bands"), indices).alias("bands"))
    long = to_long(chosen)
    limits = stretch_limits(long, lower, upper, ("band",) if per_band else ())
    if digits is not None:
        limits = limits.withColumns({k: F.round(k, digits) for k in ("low", "high")})
    if per_band:
        limits = limits.groupBy().agg(F.array_sort(F.collect_list(F.struct("band", "low", "high"))).alias("limits"))
    else:
        limits = limits.select(F.transform(
            F.sequence(F.lit(1), F.lit(len(indices))), lambda i: F.struct(i.alias("band"), F.col("low"), F.col("high")),
        ).alias("limits"))
    # one row with a pair of limits per band
    joined = chosen.join(F.broadcast(limits), F.lit(True))
    image = F.array(*[stretched(F.col("bands")[i], F.col("limits")[i]["low"], F.col("limits")[i]["high"]) for i in range(len(indices))])
    return joined.select("row", "col", image.alias("image"))
