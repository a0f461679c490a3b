"""``spark.read.format("raster_cube")``: GeoTIFF and ENVI files as cubes, tile by tile.

The header is read once on the driver; every partition is a run of tiles, read
by ranges on an executor and handed over as Arrow batches.  Options: ``path``;
``bands`` ("9,5,3", 1-based, order kept); ``window`` ("col_off,row_off,width,height",
which prunes tiles); ``float32`` (default true); ``fill_nan`` (NoData as NaN
instead of NULL); ``masked`` (default true; false leaves NoData as the number it
is); ``out_shape`` ("width,height": the nearest pixel of each cell, so that only
their blocks are read, rows and columns counted from 0); ``partition_bytes``.  Rows are row INT, col INT, bands
ARRAY<DOUBLE>.  With ``spark.sql.python.filterPushdown.enabled`` comparisons of
row and col prune tiles as well; give the option ``pushdown`` then.
"""

from __future__ import annotations

import contextlib
import posixpath
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from ..errors import MemoryBudgetExceededError, RasterReadError, UnsupportedError
from . import tiff, vrt

SCHEMA = "row int, col int, bands array<double>"
PARTITION_BYTES = 64 << 20
#: Bytes of a strip of a TIFF that are held at a time.
STRIP_BYTES = 2 << 20
#: ENVI's data types and its sample orders.
ENVI_TYPES = {1: "uint8", 2: "int16", 3: "int32", 4: "float32", 5: "float64", 12: "uint16", 13: "uint32", 14: "int64", 15: "uint64"}
RAW = ("bsq", "bil", "bip")


def open_file(path: str):  # noqa: ANN201
    """A seekable file of any store that pyarrow knows."""
    store, name = fs.FileSystem.from_uri(path) if re.match(r"[a-z][a-z0-9+.-]+:", path) else (fs.LocalFileSystem(), path)
    try:
        return store.open_input_file(name)
    except (FileNotFoundError, OSError) as e:
        raise RasterReadError(f"cannot open {path}", hint=str(e)) from e


@dataclass
class Envi:
    """A raw raster with a text header."""

    raster: tiff.Raster
    interleave: str
    skip: int
    data: str


def parse_envi(text: str, data: str) -> Envi:
    """``text`` is the header's content, ``data`` the path of the samples."""
    if not text.lstrip().startswith("ENVI"):
        raise RasterReadError("not an ENVI header")
    values = {k.strip().lower(): v.strip() for k, v in re.findall(r"^([^=\n]+)=\s*(\{[^}]*\}|[^\n]*)", text, re.M)}
    try:
        kind, width, height, count = (int(values[k]) for k in ("data type", "samples", "lines", "bands"))
        dtype = ENVI_TYPES[kind]
    except (KeyError, ValueError) as e:
        raise UnsupportedError(f"the ENVI header lacks or does not support {e}") from e
    r = tiff.Raster(width=width, height=height, count=count, dtype=dtype, order=">" if values.get("byte order", "0") == "1" else "<")
    r.block_width, r.block_height = width, max(1, min(height, (4 << 20) // max(1, width * count * np.dtype(dtype).itemsize)))
    if "data ignore value" in values:
        r.nodata = float(values["data ignore value"])
    lists = {k: [x.strip() for x in v.strip("{}").split(",")] for k, v in values.items() if v.startswith("{")}
    unit = values.get("wavelength units", "")
    for i, w in enumerate(lists.get("wavelength", []), 1):
        r.band_tags[i] = {"wavelength": w} | ({"wavelength_units": unit.lower()} if unit else {})
    for i, n in enumerate(lists.get("band names", []), 1):
        r.descriptions[i] = n
    interleave = values.get("interleave", "bsq").lower()
    if interleave not in RAW:
        raise UnsupportedError(f"ENVI interleave {interleave} is not supported")
    return Envi(r, interleave, int(values.get("header offset", 0)), data)


def header(path: str) -> tiff.Raster | Envi | vrt.Vrt:
    """Header of a GeoTIFF, of an ENVI raster by its .hdr or data file, or of a virtual raster."""
    if path.lower().endswith(".vrt"):
        with open_file(path) as f:
            return vrt.parse(f.read().decode(), posixpath.dirname(path))
    if path.lower().endswith(".hdr") or path.lower().endswith(tuple("." + x for x in (*RAW, "img", "dat"))):
        stem = re.sub(r"\.[^./]+$", "", path)
        candidates = [path] if path.lower().endswith(".hdr") else [stem + ".hdr", path + ".hdr"]
        for h in candidates:
            try:
                with open_file(h) as f:
                    text = f.read().decode("latin-1")
            except RasterReadError:
                continue
            data = path
            if path == h:
                data = next((stem + x for x in ("", ".bsq", ".bil", ".bip", ".img", ".dat") if _exists(stem + x)), stem)
            return parse_envi(text, data)
        raise RasterReadError(f"no ENVI header beside {path}")
    if not path.lower().endswith((".tif", ".tiff")):
        raise UnsupportedError(f"no reader for {path}", hint="GeoTIFF, ENVI and virtual rasters are supported")
    with open_file(path) as f:
        return tiff.read_header(f)


def plain_header(path: str) -> tiff.Raster:
    """What a header says of size, bands and place, whatever the format."""
    found = header(path)
    return found if isinstance(found, tiff.Raster) else found.raster


def _exists(path: str) -> bool:
    try:
        open_file(path).close()
    except RasterReadError:
        return False
    return True


@dataclass
class Tile(InputPartition):
    """Some tiles of one raster: (tile_row, tile_col) each."""

    tiles: tuple[tuple[int, int], ...]


def parse_window(text: str | None, r: tiff.Raster) -> tuple[int, int, int, int]:
    """(col_off, row_off, width, height), which must lie in the raster."""
    if not text:
        return 0, 0, r.width, r.height
    try:
        c, w0, w, h = (int(x) for x in text.split(","))
    except ValueError as e:
        raise RasterReadError(f"not a window: {text}") from e
    if min(c, w0) < 0 or min(w, h) <= 0 or c + w > r.width or w0 + h > r.height:
        raise RasterReadError("the window is not inside the raster", context={"window": text, "width": r.width, "height": r.height})
    return c, w0, w, h


def parse_shape(text: str | None) -> tuple[int | None, int | None]:
    """(width, height) of a decimated read, at least one pixel; without it the window's own, whose pixels keep their places."""
    if not text:
        return None, None
    try:
        width, height = (int(x) for x in text.split(","))
    except ValueError as e:
        raise RasterReadError(f"not a shape: {text}") from e
    if min(width, height) < 1:
        raise RasterReadError("a read has at least one pixel", context={"out_shape": text})
    return width, height


def _picked(first: int, size: int, to: int | None, begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """(number in the result, row or column of the file) of what a read takes from [begin, end)."""
    if to is None:
        at = np.arange(max(first, begin), min(first + size, end))
        return at, at
    at = first + np.floor((np.arange(to) + 0.5) * (size / to)).astype(np.int64)
    mine = np.flatnonzero((at >= begin) & (at < end))
    return mine, at[mine]


def parse_bands(text: str | None, count: int) -> list[int]:
    if text is None:
        return list(range(1, count + 1))
    out = [int(x) for x in text.split(",") if x.strip()]
    if not out or min(out) < 1 or max(out) > count:
        raise RasterReadError("bands are 1-based and must exist", context={"bands": text, "band_count": count})
    return out


class CubeReader(DataSourceReader):
    """Tiles of one raster."""

    def __init__(self, options: dict[str, str], found: tiff.Raster | Envi | vrt.Vrt | None = None):
        self.path = options["path"]
        self.header = found or header(self.path)
        # long strips are read line by line: straight away where they are raw, from their start where they are compressed
        self.raster = tiff.split_strips(self.header, STRIP_BYTES) if isinstance(self.header, tiff.Raster) else self.header.raster
        self.bands = parse_bands(options.get("bands"), self.raster.count)
        self.window = parse_window(options.get("window"), self.raster)
        self.float32 = options.get("float32", "true").lower() == "true"
        self.fill_nan = options.get("fill_nan", "false").lower() == "true"
        self.masked = options.get("masked", "true").lower() == "true"
        self.shape = parse_shape(options.get("out_shape"))
        self.headers: dict[str, tiff.Raster | Envi | vrt.Vrt] = {}
        self.partition_bytes = int(options.get("partition_bytes", PARTITION_BYTES))

    def partitions(self) -> list[Tile]:
        r = self.raster
        c, w0, w, h = self.window
        down = [i for i in range(w0 // r.block_height, -(-(w0 + h) // r.block_height)) if len(_picked(w0, h, self.shape[1], i * r.block_height, (i + 1) * r.block_height)[0])]
        across = [j for j in range(c // r.block_width, -(-(c + w) // r.block_width)) if len(_picked(c, w, self.shape[0], j * r.block_width, (j + 1) * r.block_width)[0])]
        tiles = [(i, j) for i in down for j in across]
        size = r.block_width * r.block_height * len(self.bands) * 8
        each = max(1, self.partition_bytes // max(1, size))
        return [Tile(tuple(tiles[i : i + each])) for i in range(0, len(tiles), each)] or [Tile(())]

    def blocks_of(self, tile_row: int, tile_col: int) -> list[int]:
        """Indices of the blocks of a TIFF that a tile needs."""
        planes = [1] if self.raster.planar == 1 else sorted(set(self.bands))
        return [tiff.block_index(self.raster, b, tile_row, tile_col) for b in planes]

    def read(self, partition: Tile) -> Iterator[pa.RecordBatch]:
        if not partition.tiles:
            return
        if isinstance(self.header, vrt.Vrt):
            for tile_row, tile_col in partition.tiles:
                yield from self._tile(None, tile_row, tile_col)
            return
        with open_file(self.header.data if isinstance(self.header, Envi) else self.path) as file:
            for tile_row, tile_col in partition.tiles:
                yield from self._tile(file, tile_row, tile_col)

    def _tile(self, file, tile_row: int, tile_col: int) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
        for cube, top, left in self._arrays(file, tile_row, tile_col):
            yield from self._emitted(cube, top, left, len(cube))

    def _arrays(self, file, tile_row: int, tile_col: int) -> Iterator[tuple[np.ndarray, int, int]]:  # noqa: ANN001
        """(rows, columns, chosen bands) of a tile as the file has them, whole or some lines at a time, and where they begin."""
        r = self.raster
        top, left = tile_row * r.block_height, tile_col * r.block_width
        rows = r.block_height if r.tiled else min(r.block_height, r.height - top)
        if isinstance(self.header, Envi):
            yield self._raw(file, tile_row, rows), top, left
        elif isinstance(self.header, vrt.Vrt):
            yield self._pasted(top, left), top, left
        elif tiff.in_pieces(r, STRIP_BYTES):
            last = _picked(self.window[1], self.window[3], self.shape[1], top, top + rows)[1]
            for piece in self._pieces(file, tile_row, rows):
                yield piece, top, left
                top += len(piece)
                if not len(last) or top > last[-1]:
                    return
        else:
            yield self._blocks(file, tile_row, tile_col, rows), top, left

    def window_array(self) -> np.ndarray:
        """The window as (rows, columns, bands), as the file has it; for windows of a block's size."""
        r, (c, w0, w, h) = self.raster, self.window
        out = np.zeros((h, w, len(self.bands)), r.dtype)
        with contextlib.ExitStack() as stack:
            name = self.header.data if isinstance(self.header, Envi) else self.path
            file = None if isinstance(self.header, vrt.Vrt) else stack.enter_context(open_file(name))
            for i in range(w0 // r.block_height, -(-(w0 + h) // r.block_height)):
                for j in range(c // r.block_width, -(-(c + w) // r.block_width)):
                    for cube, top, left in self._arrays(file, i, j):
                        y0, y1 = max(top, w0), min(top + cube.shape[0], w0 + h)
                        x0, x1 = max(left, c), min(left + cube.shape[1], c + w)
                        if y0 < y1 and x0 < x1:
                            out[y0 - w0 : y1 - w0, x0 - c : x1 - c] = cube[y0 - top : y1 - top, x0 - left : x1 - left]
        return out

    def _pasted(self, top: int, left: int) -> np.ndarray:
        """A block of a virtual raster from the windows of its sources."""
        r = self.raster
        height, width = min(r.block_height, r.height - top), min(r.block_width, r.width - left)
        out = np.full((height, width, len(self.bands)), 0 if r.nodata is None else r.nodata).astype(r.dtype)
        for k, band in enumerate(self.bands):
            for source, window, x, y in self.header.pieces(band, left, top, width, height):
                part = CubeReader({"path": source.path, "bands": str(source.band), "window": ",".join(map(str, window))}, self._known(source.path)).window_array()[:, :, 0]
                here = out[y : y + window[3], x : x + window[2], k]
                data = np.ones(part.shape, bool) if source.nodata is None else ~np.isnan(part) if source.nodata != source.nodata else part != source.nodata
                here[data] = part[data].astype(r.dtype)
        return out

    def _known(self, path: str) -> tiff.Raster | Envi | vrt.Vrt:
        """Headers of sources, read once by a task."""
        if path not in self.headers:
            self.headers[path] = header(path)
        return self.headers[path]

    def _pieces(self, file, tile_row: int, rows: int) -> Iterator[np.ndarray]:  # noqa: ANN001
        """The chosen bands of a compressed strip, some lines at a time."""
        r = self.raster
        if r.planar == 1:
            for piece in tiff.read_pieces(file, r, tiff.block_index(r, 1, tile_row, 0), rows, STRIP_BYTES):
                yield piece[:, :, [b - 1 for b in self.bands]]
            return
        planes = sorted(set(self.bands))
        each = [tiff.read_pieces(file, r, tiff.block_index(r, b, tile_row, 0), rows, STRIP_BYTES // len(planes)) for b in planes]
        for pieces in zip(*each, strict=True):
            yield np.stack([pieces[planes.index(b)][:, :, 0] for b in self.bands], axis=2)

    def _emitted(self, cube: np.ndarray, top: int, left: int, rows: int) -> Iterator[pa.RecordBatch]:
        """Rows of what the window takes of an array whose first pixel is at (top, left)."""
        r = self.raster
        c, w0, w, h = self.window
        to_row, from_row = _picked(w0, h, self.shape[1], top, min(top + rows, r.height))
        to_col, from_col = _picked(c, w, self.shape[0], left, min(left + r.block_width, r.width))
        if not len(to_row) or not len(to_col):
            return
        part = cube[np.ix_(from_row - top, from_col - left)]
        value = part.astype(np.float32).astype(np.float64) if self.float32 else part.astype(np.float64)
        gone = np.zeros(part.shape, bool)
        if r.nodata is not None and self.masked:
            gone = np.isnan(value) if r.nodata != r.nodata else part == r.nodata
        if self.fill_nan:
            value, gone = np.where(gone, np.nan, value), np.zeros(part.shape, bool)
        n = value.shape[0] * value.shape[1]
        flat = pa.array(value.reshape(-1), mask=gone.reshape(-1))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * len(self.bands)), flat)
        rr, cc = np.meshgrid(to_row, to_col, indexing="ij")
        batch = pa.RecordBatch.from_arrays(
            [pa.array(rr.reshape(-1).astype(np.int32)), pa.array(cc.reshape(-1).astype(np.int32)), lists], names=["row", "col", "bands"],
        )
        for at in range(0, n, 10_000):
            yield batch.slice(at, 10_000)

    def _blocks(self, file, tile_row: int, tile_col: int, rows: int) -> np.ndarray:  # noqa: ANN001
        r = self.raster
        if r.planar == 1:
            return tiff.read_block(file, r, tiff.block_index(r, 1, tile_row, tile_col), rows)[:, :, [b - 1 for b in self.bands]]
        planes = {b: tiff.read_block(file, r, tiff.block_index(r, b, tile_row, tile_col), rows)[:, :, 0] for b in set(self.bands)}
        return np.stack([planes[b] for b in self.bands], axis=2)

    def _raw(self, file, tile_row: int, rows: int) -> np.ndarray:  # noqa: ANN001
        r, e = self.raster, self.header
        dtype = np.dtype(r.dtype).newbyteorder(r.order)
        top, line = tile_row * r.block_height, r.width * dtype.itemsize

        def take(at: int, n: int) -> np.ndarray:
            file.seek(e.skip + at)
            data = file.read(n)
            if len(data) < n:
                raise RasterReadError(f"{e.data} is cut off")
            return np.frombuffer(data, dtype)

        if e.interleave == "bsq":
            planes = {b: take(((b - 1) * r.height + top) * line, rows * line).reshape(rows, r.width) for b in set(self.bands)}
            return np.stack([planes[b] for b in self.bands], axis=2).astype(r.dtype)
        if e.interleave == "bil":  # lines of one band each: only those that are asked for
            lines = {b: np.stack([take(((top + y) * r.count + b - 1) * line, line) for y in range(rows)]) for b in set(self.bands)}
            return np.stack([lines[b] for b in self.bands], axis=2).astype(r.dtype)
        # pixels of all bands: a line at a time, so that the other bands are not held
        chosen = [b - 1 for b in self.bands]
        return np.stack([take((top + y) * line * r.count, line * r.count).reshape(r.width, r.count)[:, chosen] for y in range(rows)]).astype(r.dtype)


class PrunedReader(CubeReader):
    """Narrows the window by comparisons of row and col; Spark still applies them."""

    def pushFilters(self, filters):  # noqa: ANN001, ANN201, N802
        if self.shape[0] is not None:  # rows and columns are the result's own
            yield from filters
            return
        c, w0, w, h = self.window
        low, high = {"row": w0, "col": c}, {"row": w0 + h - 1, "col": c + w - 1}
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if name in low and isinstance(getattr(f, "value", None), int):
                if isinstance(f, (EqualTo, GreaterThanOrEqual, GreaterThan)):
                    low[name] = max(low[name], f.value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThanOrEqual, LessThan)):
                    high[name] = min(high[name], f.value - isinstance(f, LessThan))
        self.window = low["col"], low["row"], max(0, high["col"] - low["col"] + 1), max(0, high["row"] - low["row"] + 1)
        yield from filters

    def partitions(self) -> list[Tile]:
        return super().partitions() if min(self.window[2:]) > 0 else [Tile(())]


class CubeSource(DataSource):
    """The format ``raster_cube``."""

    @classmethod
    def name(cls) -> str:
        return "raster_cube"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        pruned = self.options.get("pushdown", "false").lower() == "true"
        return (PrunedReader if pruned else CubeReader)(dict(self.options))


def estimate(r: tiff.Raster, width: int, height: int, bands: int, masked: bool = True) -> int:
    """Bytes of a whole read."""
    return width * height * bands * (np.dtype(r.dtype).itemsize + masked)


def window_header(r: tiff.Raster, bands: list[int] | None = None, window: tuple[int, int, int, int] | None = None) -> tiff.Raster:
    """What a windowed read of some bands is a raster of: size, bands, descriptions and tags, and the transform of its own corner."""
    chosen = parse_bands(None if bands is None else ",".join(map(str, bands)), r.count)
    c, w0, w, h = parse_window(None if window is None else ",".join(map(str, window)), r)
    x, y, z, u, v, t = r.transform
    moved = (x, y, x * c + y * w0 + z, u, v, u * c + v * w0 + t)
    pick = lambda values: {i: values[b] for i, b in enumerate(chosen, 1) if b in values}
    whole = (c, w0, w, h) == (0, 0, r.width, r.height)
    return tiff.Raster(
        width=w, height=h, count=len(chosen), dtype=r.dtype, nodata=r.nodata, transform=moved, epsg=r.epsg, geographic=r.geographic,
        rpc=r.rpc if whole else None, tags=dict(r.tags), descriptions=pick(r.descriptions), band_tags=pick(r.band_tags), imagery=pick(r.imagery),
    )


def read(
    spark: SparkSession, path: str, bands: list[int] | None = None, window: tuple[int, int, int, int] | None = None, float32: bool = True,
    fill_nan: bool = False, max_bytes: int | None = None, masked: bool = True,
    out_shape: tuple[int, int] | None = None,
) -> DataFrame:
    """A cube of a raster file; ``max_bytes`` refuses what a single-process consumer could not hold."""
    r = plain_header(path)
    chosen = parse_bands(None if bands is None else ",".join(map(str, bands)), r.count)
    c, w0, w, h = parse_window(None if window is None else ",".join(map(str, window)), r)
    if max_bytes is not None and (need := estimate(r, *(out_shape or (w, h)), len(chosen), masked)) > max_bytes:
        raise MemoryBudgetExceededError("the read is over its budget", context={"bytes": need, "max_bytes": max_bytes})
    spark.dataSource.register(CubeSource)
    options = {"bands": ",".join(map(str, chosen)), "window": f"{c},{w0},{w},{h}", "float32": str(float32), "fill_nan": str(fill_nan), "masked": str(masked)}
    if out_shape is not None:
        options["out_shape"] = f"{out_shape[0]},{out_shape[1]}"
    return spark.read.format("raster_cube").options(**options).load(path)
