"""Quality classes over a grid: counts, shares, and growth of defects."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.pixels import CLASS_NAMES, INVALID, LOW_SIGNAL, SATURATED, SPECTRAL_ANOMALY, VALID, good_bands, quality_class
from . import stencil

#: Defects in the order in which they claim valid pixels.
GROWING = (INVALID, SATURATED, LOW_SIGNAL, SPECTRAL_ANOMALY)


def classify(cube: DataFrame, **settings) -> DataFrame:  # noqa: ANN003
    """row, col, class; narrow, no shuffle.  The usable samples are found once and counted from a column."""
    found = cube.withColumn("__good", good_bands(F.col("bands"), settings.get("nodata")))
    return found.select("row", "col", quality_class(F.col("bands"), good=F.col("__good"), **settings).alias("class"))


def class_counts(classes: DataFrame) -> DataFrame:
    """class, name, count, percentage; every known class has a row, other codes follow as unknown_<code>."""
    spark = classes.sparkSession
    known = spark.createDataFrame(list(CLASS_NAMES.items()), "class smallint, name string")
    counted = classes.groupBy("class").agg(F.count(F.lit(1)).alias("n"))
    joined = counted.join(known, "class", "full")
    total = F.sum(F.coalesce("n", F.lit(0))).over(_everything())
    share = F.when(total > 0, F.coalesce(F.col("n"), F.lit(0)) * 100.0 / total).otherwise(0.0)
    return joined.select(
        F.col("class").cast("short").alias("class"), F.coalesce("name", F.concat(F.lit("unknown_"), F.col("class").cast("string"))).alias("name"),
        F.coalesce("n", F.lit(0)).cast("long").alias("count"), share.alias("percentage"),
    )


def _everything():  # noqa: ANN202
    from pyspark.sql import Window as W

    return W.partitionBy()  # a row per class


def kernel(shape: str, size: int, iterations: int = 1) -> list[tuple[int, int]]:
    """Offsets that ``iterations`` dilations with a kernel reach: its repeated sum with itself."""
    if size < 1 or size % 2 == 0 or iterations < 1:
        raise ValueError("kernels are odd and applied at least once")
    r = size // 2
    if shape == "rect":
        one = set(product(range(-r, r + 1), repeat=2))
    elif shape == "cross":
        one = {(d, 0) for d in range(-r, r + 1)} | {(0, d) for d in range(-r, r + 1)}
    elif shape == "ellipse":
        # each row is as wide as the ellipse of half axes r there, rounded
        one = {(y, x) for y in range(-r, r + 1) for w in [round((r * r - y * y) ** 0.5) if r else 0] for x in range(-w, w + 1)}
    else:
        raise ValueError(f"unknown kernel shape {shape!r}")
    out = {(0, 0)}
    for _ in range(iterations):
        out = {(a + c, b + d) for a, b in out for c, d in one}
    return sorted(out)


def grow(
    classes: DataFrame, operation: str = "dilate", shape: str = "rect", size: int = 3, iterations: int = 1, growing: Sequence[int] = GROWING,
    block: int | None = None,
) -> DataFrame:
    """Morphology of defect classes; only valid pixels change, each to the first class that reaches it.

    The grid is shuffled once, in tiles with a halo.  Closing keeps of what a class
    reaches the places around which every pixel of the grid is reached by it.
    Opening and erosion give parts of a class's own pixels, which are not valid
    ones, so they change nothing.
    """
    if operation in ("open", "erode"):
        return classes.select("row", "col", "class")
    if operation not in ("dilate", "close"):
        raise ValueError(f"unknown operation {operation!r}")
    reach = max(max(map(abs, o)) for o in kernel(shape, size)) * iterations
    if iterations < 1:
        raise ValueError("kernels are odd and applied at least once")
    growing = tuple(growing)

    def solve(tile: stencil.Tile) -> pa.Table:
        here = tile.array(np.ones(len(tile.at), bool), False)
        code = tile.array(np.asarray(tile.rows["class"].combine_chunks().fill_null(-1)).astype(np.int16), -1)
        null = tile.array(np.asarray(tile.rows["class"].combine_chunks().is_null()).astype(bool), False)
        out, free = code.copy(), code == VALID
        for c in growing:
            reached = stencil.dilated(code == c, shape, size, iterations)
            if operation == "close":
                reached &= here
                reached &= ~stencil.dilated(here & ~reached, shape, size, iterations)
            new = reached & free
            out[new], free = c, free & ~new
        row, col, y, x = tile.inner(here)
        return pa.table({"row": pa.array(row), "col": pa.array(col), "class": pa.array(out[y, x], mask=null[y, x])})

    return stencil.in_tiles(classes, ["class"], reach * (2 if operation == "close" else 1), solve, "row int, col int, class smallint", block=block)
