"""Product folders and files, listed and hashed by Spark's binaryFile source."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: File types by role, and names that mark the image among several rasters.
RASTER_TYPES = ("tif", "tiff", "jp2", "img", "bsq", "bil", "bip", "dat", "vrt", "he5", "hdf")
METADATA_TYPES = ("xml", "json", "hdr", "met", "txt", "gfs", "rpc")
IMAGE_NAMES = ("spectral_image", "spectral-image")
#: Bytes of a file that are hashed at a time.
HASH_BYTES = 1 << 20


def inventory(spark: SparkSession, folder: str) -> DataFrame:
    """path, name, kind, size_bytes, modified of every file below ``folder``; contents are not read, empty files not listed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length", "modificationTime")
    kind_of = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    kind = F.when(kind_of.isin(list(RASTER_TYPES)), "raster").when(kind_of.isin(list(METADATA_TYPES)), "metadata").otherwise("other")
    return files.select(
        "path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), kind.alias("kind"), F.col("length").alias("size_bytes"),
        F.date_format("modificationTime", "yyyy-MM-dd'T'HH:mm:ssXXX").alias("modified"),
    )


def totals(files: DataFrame) -> DataFrame:
    """Bytes and candidates of a folder."""
    return files.agg(
        F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_bytes"), F.count_if(F.col("kind") == "raster").alias("rasters"),
        F.count_if(F.col("kind") == "metadata").alias("metadata_files"),
    )


def candidates(files: DataFrame) -> DataFrame:
    """Rasters that may be a product's image: those with a marking name if there are any, else all."""
    rasters = files.filter("kind = 'raster'")
    marked = F.lit(False)
    for n in IMAGE_NAMES:
        marked = marked | F.lower("name").contains(n)
    tagged = rasters.withColumn("__m", marked)
    any_marked = tagged.agg(F.coalesce(F.bool_or("__m"), F.lit(False)).alias("__any"))
    return tagged.join(F.broadcast(any_marked), F.lit(True)).filter(F.col("__m") | ~F.col("__any")).drop("__m", "__any").orderBy("path")


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """path, length and SHA-256 of files of any size, read by executors a piece at a time."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = []
            for name in batch.column(0).to_pylist():
                local = re.match(r"file:/+(.*)", name)  # names of local files may hold what a URI may not
                store, at = (fs.LocalFileSystem(), "/" + local[1]) if local else fs.FileSystem.from_uri(name)
                digest = hashlib.sha256()
                with store.open_input_stream(at) as source:
                    while piece := source.read(HASH_BYTES):
                        digest.update(piece)
                digests.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.string())], names=["path", "length", "sha256"])

    return files.mapInArrow(task, "path string, length long, sha256 string")
