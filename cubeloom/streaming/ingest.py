"""Extension: rasters as they arrive.

The file source watches a folder of GeoTIFFs; every micro-batch of new files is
catalogued and handed to a callback with the session, which may read and
classify them.  A checkpoint folder makes restarts take up where they ended.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.catalog import inspect

FILES = "path string, modificationTime timestamp, length long, content binary"


def watch(
    spark: SparkSession, folder: str, checkpoint: str, each: Callable[[DataFrame, DataFrame], None], pattern: str = "*.tif", once: bool = False,
) -> StreamingQuery:
    """Call ``each`` with raster and band catalogs of the rasters that a batch brings."""
    arriving = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder).select("path", "length")

    def batch(new: DataFrame, number: int) -> None:
        paths = {r["path"]: r["path"].removeprefix("file:") for r in new.select("path").collect()}  # names of one micro-batch
        if paths:
            each(*inspect(new.sparkSession, paths))

    writer = arriving.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def class_totals(stream: DataFrame, event_time: str = "arrived", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Pixels by class and arrival window of a stream of (arrived, class); late rows are dropped after ``late``."""
    return stream.withWatermark(event_time, late).groupBy(F.window(event_time, window), "class").agg(F.count(F.lit(1)).alias("pixels"))
