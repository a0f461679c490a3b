"""GeoTIFF files of any number of rasters, written by tasks in two phases.

Phase one is a data source: every task appends its encoded blocks to a part file
of its own in a staging folder, beside an index of them, and its commit message
names the part.  The commit on the driver writes down which parts count, so that
those of lost or repeated attempts never do; an abort deletes the folder, and a
task that fails deletes what it wrote.

Phase two places blocks.  A running sum of sizes gives each block's place in its
file.  Where the target can be written at any place (local and mounted file
systems), tasks copy spans of at most ``SPAN_BYTES`` into a draft, and one task
for each file adds its directory and gives the draft its name.  Other stores get
each file from one task, as a stream of its blocks.  Either way a file has its
name only once it is whole.
"""

from __future__ import annotations

import json
import os
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..errors import RasterWriteError
from ..shared import delete, shared_dir
from . import places, tiff

#: Blocks on their way: a plane (band, 0-based) of a tile of a raster.
BLOCKS = "raster_id string, band int, tile_row int, tile_col int, payload binary"
INDEX = pa.schema([("raster_id", pa.string()), ("band", pa.int32()), ("tile_row", pa.int32()), ("tile_col", pa.int32()), ("part", pa.string()), ("start", pa.int64()), ("size", pa.int64())])
#: Bytes of a file that one task copies.
SPAN_BYTES = 64 << 20
#: Bytes before the first block: the longer of the two headers.
HEAD = 16
#: Files beyond this have offsets of 64 bits.
CLASSIC_BYTES = 3_500_000_000
COMMITTED = "committed.json"


# -- phase one --------------------------------------------------------------------------------


@dataclass
class Part(WriterCommitMessage):
    """A part file that a task wrote."""

    name: str | None


class BlockWriter(DataSourceArrowWriter):
    """Rows of ``BLOCKS`` to part files under ``path``."""

    def __init__(self, folder: str):
        self.folder = folder

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        store, root = fs.FileSystem.from_uri(self.folder)
        store.create_dir(root, recursive=True)
        name = uuid.uuid4().hex
        paths = [f"{root}/{name}.blocks", f"{root}/{name}.index"]
        kept: list[pa.Table] = []
        at = 0
        try:
            with store.open_output_stream(paths[0], compression=None) as out:
                for batch in iterator:
                    sizes = []
                    for payload in batch.column("payload"):
                        data = payload.as_buffer()
                        out.write(data)
                        sizes.append(data.size)
                    starts = at + np.cumsum([0, *sizes[:-1]]) if sizes else []
                    at += sum(sizes)
                    kept.append(pa.Table.from_arrays([*(batch.column(c) for c in INDEX.names[:4]), pa.array([name] * len(sizes)), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())], schema=INDEX))
            table = pa.concat_tables(kept) if kept else INDEX.empty_table()
            if table.num_rows:
                with store.open_output_stream(paths[1], compression=None) as out:
                    pq.write_table(table, out)
        except BaseException:
            for p in paths:
                if store.get_file_info(p).type != fs.FileType.NotFound:
                    store.delete_file(p)
            raise
        if not table.num_rows:
            store.delete_file(paths[0])
            return Part(None)
        return Part(name)

    def commit(self, messages: list[Part | None]) -> None:
        store, root = fs.FileSystem.from_uri(self.folder)
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/.{COMMITTED}") as out:
            out.write(json.dumps([m.name for m in messages if m is not None and m.name]).encode())
        store.move(f"{root}/.{COMMITTED}", f"{root}/{COMMITTED}")

    def abort(self, messages: list[Part | None]) -> None:
        store, root = fs.FileSystem.from_uri(self.folder)
        if store.get_file_info(root).type != fs.FileType.NotFound:
            store.delete_dir(root)


class BlockSink(DataSource):
    """The format ``raster_blocks``; it is only written."""

    @classmethod
    def name(cls) -> str:
        return "raster_blocks"

    def schema(self) -> str:
        return BLOCKS

    def writer(self, schema, overwrite: bool) -> BlockWriter:  # noqa: ANN001, FBT001
        return BlockWriter(self.options["path"])


def stage(blocks: DataFrame, folder: str) -> DataFrame:
    """Write ``blocks`` (``BLOCKS``) under ``folder``; returns the index of the parts that count."""
    spark = blocks.sparkSession
    spark.dataSource.register(BlockSink)
    blocks.select(*INDEX.names[:4], "payload").write.format("raster_blocks").mode("append").save(folder)
    store, root = fs.FileSystem.from_uri(folder)
    with store.open_input_stream(f"{root}/{COMMITTED}") as source:
        names = json.loads(source.read())
    if not names:
        return spark.createDataFrame([], "raster_id string, band int, tile_row int, tile_col int, part string, start long, size long")
    return spark.read.parquet(*[posixpath.join(folder, f"{n}.index") for n in names])


# -- phase two --------------------------------------------------------------------------------

#: What is the same in all files of a write is in a header; what each raster has of its own.
RASTERS = "raster_id string, path string, width int, height int, transform array<double>, epsg int"


def _header(rows: pa.Table, of: tiff.Raster, layout: tiff.Layout) -> tuple[tiff.Raster, int]:
    """(header of one raster with the places of its blocks, where they end); a raster without blocks has one row without a part."""
    first = {c: rows[c][0].as_py() for c in ("width", "height", "transform", "epsg")}
    r = replace(of, **{k: v for k, v in first.items() if v is not None})
    r.transform, r.geographic = tuple(r.transform), of.geographic if first["epsg"] is None else first["epsg"] == 4326
    r.block_width = r.block_height = layout.block
    total = r.across * r.down * r.count
    offsets, sizes = np.zeros(total, np.int64), np.zeros(total, np.int64)
    held = rows.filter(rows["part"].is_valid())
    if held.num_rows:
        number = np.asarray(held["number"])
        offsets[number], sizes[number] = np.asarray(held["at"]), np.asarray(held["size"])
    r.offsets, r.sizes = offsets.tolist(), sizes.tolist()
    return r, HEAD + int(sizes.sum())


def _pieces(rows: pa.Table) -> Iterator[tuple[str, int, int, int]]:
    """(part, start, size, place) in order of place."""
    rows = rows.sort_by("at")
    yield from zip(*(rows[c].to_pylist() for c in ("part", "start", "size", "at")), strict=True)


def _copy(folder: str, rows: pa.Table) -> Iterator[tuple[int, bytes]]:
    """(place, bytes) of blocks, one at a time."""
    store, root = fs.FileSystem.from_uri(folder)
    opened: tuple[str, pa.NativeFile] | None = None
    for part, start, size, at in _pieces(rows):
        if opened is None or opened[0] != part:
            if opened is not None:
                opened[1].close()
            opened = part, store.open_input_file(f"{root}/{part}.blocks")
        yield at, opened[1].read_at(size, start)
    if opened is not None:
        opened[1].close()


WRITTEN = "raster_id string, path string, bytes long, blocks long"


def place(index: DataFrame, rasters: DataFrame, folder: str, of: tiff.Raster, layout: tiff.Layout, span_bytes: int = SPAN_BYTES) -> DataFrame:
    """Files from the staged blocks: raster_id, path, bytes and blocks of each, settled when this returns.

    ``rasters`` has ``RASTERS``; what it leaves null is as in ``of``.  Tiles without a
    block are sparse.
    """
    spark = index.sparkSession
    across, down = (F.ceil(F.col(c) / layout.block).cast("long") for c in ("width", "height"))
    every = index.join(rasters, "raster_id", "right")
    number = F.col("band") * across * down + F.col("tile_row") * across + F.col("tile_col")
    before = W.partitionBy("raster_id").orderBy("number").rowsBetween(W.unboundedPreceding, -1)  # a file's directory has a row for each, too
    placed = every.withColumn("number", number).withColumn("at", F.lit(HEAD) + F.coalesce(F.sum("size").over(before), F.lit(0)))
    local = all(places.local_path(r["path"]) is not None for r in rasters.select("path").limit(1).collect())
    token = uuid.uuid4().hex

    def draft(path: str) -> str:
        return posixpath.join(posixpath.dirname(path), f".{posixpath.basename(path)}.{token}")

    def one(rows: pa.Table, written: int) -> pa.Table:
        columns = {"raster_id": rows["raster_id"].slice(0, 1), "path": rows["path"].slice(0, 1), "bytes": pa.array([written], pa.int64()), "blocks": pa.array([len(rows["part"].drop_null())], pa.int64())}
        return pa.table({k: v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v for k, v in columns.items()})

    def span(rows: pa.Table) -> pa.Table:
        handle = os.open(draft(places.local_path(rows["path"][0].as_py())), os.O_WRONLY | os.O_CREAT, 0o644)
        written = 0
        try:
            for at, data in _copy(folder, rows):
                while data:
                    n = os.pwrite(handle, data, at)
                    data, at, written = data[n:], at + n, written + n
        finally:
            os.close(handle)
        return one(rows, written)

    def finish(rows: pa.Table) -> pa.Table:
        path = places.local_path(rows["path"][0].as_py())
        r, end = _header(rows, of, layout)
        head, tail = tiff.directory_bytes(r, layout, end > CLASSIC_BYTES, end)
        name, empty = draft(path), end == HEAD
        # a repeated attempt finds the draft renamed already
        if empty or os.path.exists(name) or not os.path.exists(path):
            handle = os.open(name, os.O_WRONLY | (os.O_CREAT if empty else 0), 0o644)
            try:
                os.pwrite(handle, head.ljust(HEAD, b"\x00"), 0)
                os.pwrite(handle, tail, end)
            finally:
                os.close(handle)
            os.replace(name, path)
        return one(rows, end + len(tail))

    def stream(rows: pa.Table) -> pa.Table:
        path = rows["path"][0].as_py()
        r, end = _header(rows, of, layout)
        head, tail = tiff.directory_bytes(r, layout, end > CLASSIC_BYTES, end)
        store, at = fs.FileSystem.from_uri(path)
        name = draft(at)
        with store.open_output_stream(name, compression=None) as out:
            out.write(head.ljust(HEAD, b"\x00"))
            for _, data in _copy(folder, rows.filter(rows["part"].is_valid())):
                out.write(data)
            out.write(tail)
        if store.get_file_info(at).type != fs.FileType.NotFound:
            store.delete_file(at)
        store.move(name, at)
        return one(rows, end + len(tail))

    columns = ["raster_id", "path", "width", "height", "transform", "epsg", "number", "at", "part", "start", "size"]
    by_file = placed.select(*columns).groupBy("raster_id")
    report = posixpath.join(folder, "written")
    try:
        if local:
            spans = placed.filter(F.col("part").isNotNull()).withColumn("span", F.floor(F.col("at") / span_bytes)).select(*columns, "span")
            spans.groupBy("raster_id", "span").applyInArrow(span, WRITTEN).write.format("noop").mode("overwrite").save()
        by_file.applyInArrow(finish if local else stream, WRITTEN).write.parquet(report)
    except BaseException:
        _sweep(rasters, draft)
        raise
    return spark.read.schema(WRITTEN).parquet(report)


def _sweep(rasters: DataFrame, draft) -> None:  # noqa: ANN001
    """Delete the drafts of a write that failed."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, at = (fs.LocalFileSystem(), places.local_path(path)) if places.local_path(path) else fs.FileSystem.from_uri(path)
                if store.get_file_info(draft(at)).type != fs.FileType.NotFound:
                    store.delete_file(draft(at))
            yield batch

    rasters.select("path").mapInArrow(task, "path string").write.format("noop").mode("overwrite").save()


# -- pixels to blocks -------------------------------------------------------------------------


def tiles(cube: DataFrame, count: int, dtype: str, nodata: float | None, layout: tiff.Layout) -> DataFrame:
    """Rows of ``BLOCKS`` from pixels (raster_id, row, col, bands); rows without a place only ask for their tile to be there.

    ``tile_row`` and ``tile_col`` may be given for those.  Pixels that are missing or
    null get NoData, which must exist if there are null ones.
    """
    b, fill = layout.block, 0.0 if nodata is None else nodata

    def encode(table: pa.Table) -> pa.Table:
        grid = np.full((count, b, b), fill)
        rows, cols = (np.asarray(table.column(k)) for k in ("row", "col"))
        here = np.flatnonzero(np.asarray(table.column("row").is_valid()))
        if len(here):
            flat = table.column("bands").combine_chunks().take(pa.array(here)).flatten()
            values = np.asarray(flat.fill_null(fill)).reshape(len(here), count)
            if nodata is None and flat.null_count:
                raise RasterWriteError("masked pixels need a NoData value")
            grid[:, rows[here].astype(int) % b, cols[here].astype(int) % b] = values.T
        kind = np.dtype(dtype)
        if kind.kind in "iu":
            grid = np.clip(np.nan_to_num(grid, nan=fill), np.iinfo(kind).min, np.iinfo(kind).max)
        planes = [tiff.pack_block(p, layout) for p in grid.astype(kind)]
        first = lambda c, t: pa.array([table.column(c)[0].as_py()] * count, t)
        return pa.table({"raster_id": first("raster_id", pa.string()), "band": pa.array(range(count), pa.int32()), "tile_row": first("tile_row", pa.int32()), "tile_col": first("tile_col", pa.int32()), "payload": pa.array(planes, pa.binary())})

    keyed = cube.select("raster_id", "tile_row", "tile_col", "row", "col", "bands")
    return keyed.groupBy("raster_id", "tile_row", "tile_col").applyInArrow(encode, BLOCKS)


def tiled(cube: DataFrame, block: int) -> DataFrame:
    """Pixels with the tile they fall in."""
    return cube.withColumns({"tile_row": F.floor(F.col("row") / block).cast("int"), "tile_col": F.floor(F.col("col") / block).cast("int")})


def write_collection(cube: DataFrame, rasters: DataFrame, of: tiff.Raster, layout: tiff.Layout | None = None) -> DataFrame:
    """A GeoTIFF for each row of ``rasters`` (``RASTERS``) from pixels (raster_id, row, col, bands); raster_id, path, bytes, blocks.

    Band count, sample type, NoData and tags are those of ``of``.  Pixels outside
    their raster, and those of no raster, are left out; a raster without pixels is a
    file of sparse tiles.  Folders must exist; files of the same name are replaced.
    """
    layout = layout or tiff.Layout()
    folder = shared_dir(cube.sparkSession, "raster-blocks")
    try:
        size = rasters.select("raster_id", F.col("width").alias("__w"), F.col("height").alias("__h"))
        inside = cube.select("raster_id", "row", "col", "bands").join(size, "raster_id").filter("row >= 0 AND col >= 0 AND row < __h AND col < __w")
        index = stage(tiles(tiled(inside, layout.block), of.count, of.dtype, of.nodata, layout), folder)
        done = place(index, rasters, folder, of, layout).collect()  # a row for each file
    finally:
        delete(cube.sparkSession, folder)
    return cube.sparkSession.createDataFrame(done, WRITTEN)


def write_one(cube: DataFrame, spark: SparkSession, path: str, of: tiff.Raster, layout: tiff.Layout) -> None:
    """One GeoTIFF of pixels (row, col, bands), without sparse tiles."""
    folder, b = shared_dir(spark, "raster-blocks"), layout.block
    across, down = -(-of.width // b), -(-of.height // b)
    try:
        inside = cube.filter((F.col("row") >= 0) & (F.col("row") < of.height) & (F.col("col") >= 0) & (F.col("col") < of.width))
        pixels = tiled(inside.select(F.lit("").alias("raster_id"), "row", "col", "bands"), b).select("raster_id", "tile_row", "tile_col", "row", "col", "bands")
        every = spark.range(across * down).select(
            F.lit("").alias("raster_id"), F.floor(F.col("id") / across).cast("int").alias("tile_row"), (F.col("id") % across).cast("int").alias("tile_col"),
            F.lit(None).cast("int").alias("row"), F.lit(None).cast("int").alias("col"), F.lit(None).cast("array<double>").alias("bands"),
        )
        index = stage(tiles(pixels.unionByName(every), of.count, of.dtype, of.nodata, layout), folder)
        rasters = spark.createDataFrame([("", path, of.width, of.height, None, None)], RASTERS)
        place(index, rasters, folder, of, layout)
    finally:
        delete(spark, folder)
