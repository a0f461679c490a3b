"""Raster cubes as DataFrames.

``wide``: row INT, col INT, bands ARRAY<DOUBLE>, a row per pixel.
``long``: row INT, col INT, band INT (1-based), value DOUBLE, a row per sample.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pixels


def from_arrays(df: DataFrame, row: Column, col: Column, bands: Column, nodata: float | None = None, float32: bool = True) -> DataFrame:
    """A cube from any table with an array column; ``nodata`` becomes NULL."""

    def value(v: Column) -> Column:
        out = pixels.as_float32(v) if float32 else v.cast("double")
        return pixels.masked(out, nodata)

    return df.select(row.cast("int").alias("row"), col.cast("int").alias("col"), F.transform(bands, value).alias("bands"))


def window(cube: DataFrame, col_off: int, row_off: int, width: int, height: int) -> DataFrame:
    """Pixels inside a window; range predicates, so that sources prune tiles and files."""
    if min(col_off, row_off) < 0 or min(width, height) <= 0:
        raise ValueError("a window has offsets of 0 or more and a size above 0")
    return cube.filter(F.col("row").between(row_off, row_off + height - 1) & F.col("col").between(col_off, col_off + width - 1))


def select_bands(cube: DataFrame, indices: Sequence[int]) -> DataFrame:
    """Bands by 1-based index in the order given; repeats allowed."""
    if not indices or min(indices) < 1:
        raise ValueError("bands are 1-based, and at least one is needed")
    return cube.withColumn("bands", pixels.pick(F.col("bands"), indices))


def to_long(cube: DataFrame, indices: Sequence[int] | None = None) -> DataFrame:
    """A row per pixel and band; ``indices`` names the bands that the array holds, by default 1, 2, ..."""
    long = cube.select("row", "col", F.posexplode("bands").alias("pos", "value"))
    band = F.col("pos") + 1 if indices is None else F.element_at(F.array(*map(F.lit, indices)), F.col("pos") + 1)
    return long.select("row", "col", band.cast("int").alias("band"), "value")


def to_wide(long: DataFrame) -> DataFrame:
    """Arrays by band number; a sample that is missing or NULL stays NULL in its place only if its row exists."""
    entries = F.array_sort(F.collect_list(F.struct("band", "value")))
    return long.groupBy("row", "col").agg(F.transform(entries, lambda e: e["value"]).alias("bands"))


def stride(cube: DataFrame, step: int) -> DataFrame:
    """Every ``step``-th row and column from 0."""
    if step < 1:
        raise ValueError("the step is at least 1")
    return cube if step == 1 else cube.filter(((F.col("row") % step) == 0) & ((F.col("col") % step) == 0))


def with_mask(cube: DataFrame, mask: DataFrame) -> DataFrame:
    """NULL where ``mask`` (row, col, masked) says so; both must hold the same pixels."""
    joined = cube.join(mask.select("row", "col", "masked"), ["row", "col"], "full")
    mismatch = F.col("bands").isNull() | F.col("masked").isNull()
    checked = F.when(mismatch, F.raise_error(F.lit("mask and raster differ in shape"))).otherwise(F.col("masked"))
    return joined.select(
        "row", "col",
        F.when(checked.cast("boolean"), F.transform("bands", lambda v: F.lit(None).cast("double"))).otherwise(F.col("bands")).alias("bands"),
    )


def blocks(spark, width: int, height: int, block_width: int, block_height: int) -> DataFrame:  # noqa: ANN001
    """Native blocks in storage order, the last ones clipped."""
    across, down = -(-width // block_width), -(-height // block_height)
    n = F.col("id")
    r, c = (n / across).cast("long"), n % across
    return spark.range(across * down).select(
        r.cast("int").alias("tile_row"),
        c.cast("int").alias("tile_col"),
        (r * block_height).cast("int").alias("row_off"),
        (c * block_width).cast("int").alias("col_off"),
        F.least(F.lit(block_height), F.lit(height) - r * block_height).cast("int").alias("height"),
        F.least(F.lit(block_width), F.lit(width) - c * block_width).cast("int").alias("width"),
    )


def read_bytes(pixel_count: Column, band_count: Column, item_size: Column, masked: Column) -> Column:
    """Bytes that a read needs: a byte per sample more if it carries a mask."""
    return pixel_count.cast("long") * band_count * (item_size + F.when(masked, 1).otherwise(0))
