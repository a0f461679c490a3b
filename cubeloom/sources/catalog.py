"""Catalogs of rasters: headers only, never pixels."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import geo
from ..functions.text import wavelength_nm
from ..plans import grids
from . import raster, tiff

RASTERS = (
    "raster_id string, path string, driver string, width int, height int, band_count int, dtype string, nodata double, nodata_is_nan boolean, epsg int, crs_defined boolean, geographic boolean, crs_wkt string, linear_units string, linear_units_factor double, "
    "transform array<double>, has_affine boolean, bounds array<double>, rpc_available boolean, rpc_usable boolean, rpc_issues array<string>, metadata map<string,string>, block_width int, block_height int, estimated_bytes long"
)
BANDS = "raster_id string, band int, dtype string, nodata double, nodata_is_nan boolean, description string, tags map<string,string>, imagery map<string,string>, block_width int, block_height int"
#: Names and metres of the EPSG units of length.
UNITS = {9001: ("metre", 1.0), 9002: ("foot", 0.3048), 9003: ("US survey foot", 12 / 39.37), 9036: ("kilometre", 1000.0)}
IDENTITY = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)


def _header(path: str) -> tuple[tiff.Raster, str]:
    h = raster.header(path)
    if isinstance(h, tiff.Raster):
        return h, "GTiff"
    return h.raster, "ENVI" if isinstance(h, raster.Envi) else "VRT"


def raster_row(raster_id: str, path: str) -> dict:
    r, driver = _header(path)
    nan = r.nodata is not None and r.nodata != r.nodata
    issues = tiff.rpc_issues(r.rpc) if r.rpc else []
    # what the file says, or the metre of the projections that this engine knows
    unit = None if r.geographic or r.epsg is None else UNITS.get(r.unit or (9001 if grids.supported(r.epsg) else 0))
    return {
        "raster_id": raster_id, "path": path, "driver": driver, "width": r.width, "height": r.height, "band_count": r.count, "dtype": r.dtype, "nodata": None if nan else r.nodata, "nodata_is_nan": nan,
        "epsg": r.epsg, "crs_defined": r.epsg is not None, "geographic": r.geographic, "crs_wkt": None if r.epsg is None else geo.wkt(r.epsg), "linear_units": unit and unit[0], "linear_units_factor": unit and unit[1], "transform": list(r.transform), "has_affine": r.placed, "bounds": list(r.bounds), "rpc_available": r.rpc is not None,
        "rpc_usable": r.rpc is not None and not issues, "rpc_issues": issues, "metadata": r.tags, "block_width": r.block_width, "block_height": r.block_height, "estimated_bytes": r.width * r.height * r.count * np.dtype(r.dtype).itemsize,
    }


def band_rows(raster_id: str, path: str, bands: list[int] | None = None) -> list[dict]:
    r, _ = _header(path)
    nan = r.nodata is not None and r.nodata != r.nodata
    chosen = sorted(set(bands)) if bands else range(1, r.count + 1)
    return [{
        "raster_id": raster_id, "band": i, "dtype": r.dtype, "nodata": None if nan else r.nodata, "nodata_is_nan": nan,
        "description": r.descriptions.get(i), "tags": r.band_tags.get(i, {}), "imagery": r.imagery.get(i, {}), "block_width": r.block_width,
        "block_height": r.block_height,
    } for i in chosen]


def inspect(spark: SparkSession, paths: dict[str, str] | DataFrame) -> tuple[DataFrame, DataFrame]:
    """(raster catalog, band catalog) of rasters by id, given as a dict or as a table (raster_id, path); headers are read by tasks."""
    if isinstance(paths, dict):
        listed = spark.createDataFrame(list(paths.items()), "raster_id string, path string").repartition(max(1, min(len(paths), spark.sparkContext.defaultParallelism)))
    else:
        listed = paths.select("raster_id", "path").repartition("raster_id", "path")

    rasters = listed.mapInArrow(_rows(lambda i, p: [raster_row(i, p)], RASTERS), RASTERS)
    bands = listed.mapInArrow(_rows(band_rows, BANDS), BANDS)
    found = bands.withColumn("__w", wavelength_nm(F.col("tags"), F.col("imagery"), F.col("description")))
    found = found.withColumns({"wavelength_nm": F.col("__w.nm"), "wavelength_source": F.col("__w.source")}).drop("__w")
    sorted_nm = F.transform(F.array_sort(F.collect_list(F.struct("band", "wavelength_nm"))), lambda e: e["wavelength_nm"])
    per_raster = found.groupBy("raster_id").agg(sorted_nm.alias("wavelengths"))
    return rasters.join(per_raster, "raster_id", "left"), found


def _rows(make: Callable, ddl: str) -> Callable:
    """A task that makes rows of a Spark schema from (raster_id, path)."""
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [x for r in batch.to_pylist() for x in make(r["raster_id"], r["path"])]
            plain = [{k: list(v.items()) if isinstance(v, dict) else v for k, v in r.items()} for r in rows]
            yield pa.RecordBatch.from_pylist(plain, schema=schema)

    return task
