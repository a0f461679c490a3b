"""Many rasters in one plan: raster_id, row, col, bands.

Headers are read by tasks, each raster's by one.  A raster gives runs: rows of a
table that name up to ``RUN_BYTES`` of decoded tiles and carry what a task must
know of the header to read just them, so that nothing grows with the size of a
raster.  Runs of all rasters are dealt to partitions of ``partition_bytes``, where
tiles are read by ranges and handed on as Arrow batches; a raster that holds a
third of all pixels is as many runs.

What is not asked for is not read: rasters that the listing does not name are not
opened, tiles outside the rows, columns or bounds asked for are in no run, bands
that are not asked for are not read where they are planes of their own.

Defined results: rows and columns count from 0 in each raster, and ranges are cut
to it; a raster that lies outside gives no rows; equal ids are told apart by
nobody, so they should not be; a raster that cannot be read fails the query with
its id, unless ``unreadable="skip"``; null ids and paths are left out.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import CubeError, RasterReadError
from ..functions import geo
from . import files, raster, tiff

SCHEMA = "raster_id string, row int, col int, bands array<double>"
RUNS = "raster_id string, path string, bytes long, tiles binary, header binary"
RUN_BYTES = 4 << 20
PARTITION_BYTES = 64 << 20
#: Rasters whose headers a task reads one after another.
HEADERS_AT_ONCE = 64


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """raster_id (the path below ``folder``) and path of every GeoTIFF, ENVI and virtual raster below it."""
    found = files.inventory(spark, folder).filter(F.lower("name").rlike(r"\.(tiff?|bsq|bil|bip|vrt)$"))
    path = F.regexp_replace("path", "^file:/+", "/")
    root = folder.removeprefix("file://").rstrip("/") + "/"
    return found.select(F.when(F.instr("path", root) > 0, F.expr(f"substring(path, instr(path, '{root}') + {len(root)})")).otherwise(F.col("path")).alias("raster_id"), path.alias("path"))


def _window(r: tiff.Raster, rows: Sequence[int] | None, cols: Sequence[int] | None, bounds: Sequence[float] | None) -> tuple[int, int, int, int] | None:
    """(col_off, row_off, width, height) of what is asked for of one raster; None if that is nothing."""
    top, bottom = (0, r.height) if rows is None else (max(0, rows[0]), min(r.height, rows[1]))
    left, right = (0, r.width) if cols is None else (max(0, cols[0]), min(r.width, cols[1]))
    if bounds is not None:
        a, b, c, d, e, f = geo.inverse_affine(r.transform)
        corners = [(a * x + b * y + c, d * x + e * y + f) for x in (bounds[0], bounds[2]) for y in (bounds[1], bounds[3])]
        left, right = max(left, math.floor(min(x for x, _ in corners) + 1e-9)), min(right, math.ceil(max(x for x, _ in corners) - 1e-9))
        top, bottom = max(top, math.floor(min(y for _, y in corners) + 1e-9)), min(bottom, math.ceil(max(y for _, y in corners) - 1e-9))
    return (left, top, right - left, bottom - top) if left < right and top < bottom else None


def _runs(raster_id: str, path: str, options: dict[str, str], ask: tuple, run_bytes: int) -> Iterator[dict]:
    """Rows of ``RUNS`` of one raster."""
    found = raster.header(path)
    r = found if isinstance(found, tiff.Raster) else found.raster
    window = _window(r, *ask)
    if window is None:
        return
    reader = raster.CubeReader(options | {"path": path, "window": ",".join(map(str, window)), "partition_bytes": str(run_bytes)}, found)
    each = r.block_width * r.block_height * len(reader.bands) * 8
    for part in reader.partitions():
        if part.tiles:
            small = found if not isinstance(found, tiff.Raster) else tiff.with_blocks(reader.raster, sorted({i for t in part.tiles for i in reader.blocks_of(*t)}))
            yield {"raster_id": raster_id, "path": path, "bytes": each * len(part.tiles), "tiles": pickle.dumps((part.tiles, window)), "header": pickle.dumps(small)}


def runs(
    rasters: DataFrame, bands: Sequence[int] | None = None, rows: Sequence[int] | None = None, cols: Sequence[int] | None = None,
    bounds: Sequence[float] | None = None, run_bytes: int = RUN_BYTES, unreadable: str = "fail",
) -> DataFrame:
    """The runs of ``rasters`` (raster_id, path): nothing but headers is read."""
    if unreadable not in ("fail", "skip"):
        raise ValueError("unreadable rasters fail or are skipped")
    options = {} if bands is None else {"bands": ",".join(map(str, bands))}
    kinds = pa.schema([("raster_id", pa.string()), ("path", pa.string()), ("bytes", pa.int64()), ("tiles", pa.binary()), ("header", pa.binary())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raster_id, path in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    yield pa.RecordBatch.from_pylist(list(_runs(raster_id, path, options, (rows, cols, bounds), run_bytes)), kinds)
                except CubeError as e:
                    if unreadable == "fail":
                        raise RasterReadError(f"raster {raster_id}: {e.message}", hint=e.hint, context=e.context | {"path": path}) from e

    named = rasters.select(F.col("raster_id").cast("string").alias("raster_id"), "path").filter("raster_id IS NOT NULL AND path IS NOT NULL")
    spark = rasters.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, -(-named.count() // HEADERS_AT_ONCE))
    return named.repartition(parts, "raster_id", "path").mapInArrow(task, RUNS)


def read(
    rasters: DataFrame, bands: Sequence[int] | None = None, rows: Sequence[int] | None = None, cols: Sequence[int] | None = None,
    bounds: Sequence[float] | None = None, float32: bool = True, masked: bool = True, fill_nan: bool = False,
    partition_bytes: int = PARTITION_BYTES, unreadable: str = "fail",
) -> DataFrame:
    """The cubes of ``rasters`` (raster_id, path): ``SCHEMA``.

    ``rows`` and ``cols`` are ranges (first, behind last); ``bounds`` (left, bottom,
    right, top) are in each raster's own coordinates.  Headers are read twice: to
    know how many bytes there are, and to read them.
    """
    found = runs(rasters, bands, rows, cols, bounds, min(RUN_BYTES, partition_bytes), unreadable)
    size = found.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("n")).first()["n"]
    options = {"float32": str(float32), "masked": str(masked), "fill_nan": str(fill_nan)} | ({} if bands is None else {"bands": ",".join(map(str, bands))})

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raster_id, path, _, tiles, header in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                some, window = pickle.loads(tiles)  # noqa: S301
                reader = raster.CubeReader(options | {"path": path, "window": ",".join(map(str, window))}, pickle.loads(header))  # noqa: S301
                for part in reader.read(raster.Tile(some)):
                    ids = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(part), np.int32)), pa.array([raster_id])).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([ids, *part.columns], names=["raster_id", "row", "col", "bands"])

    return found.repartition(max(1, -(-size // partition_bytes))).mapInArrow(task, SCHEMA)
