"""Sinks: Parquet tiles, single GeoTIFF files, PNG, CSV and JSON, all atomic.

Cubes that stay in Spark belong in Parquet, sorted by tile.  A GeoTIFF is one
file by contract; its tiles are encoded and placed by tasks (:mod:`.writer`).
"""

from __future__ import annotations

import contextlib
import json
import os
import struct
import tempfile
import uuid
import zlib
from collections.abc import Iterator
from pathlib import Path
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import OutputPathError, RasterWriteError, json_safe
from . import places, tiff, writer


@contextlib.contextmanager
def replacing(path: str | Path, overwrite: bool = False) -> Iterator[Path]:
    """A new file that takes the place of ``path`` if all goes well, and is gone if not: a sibling, or one that is sent where ``path`` is."""
    check_target(path, overwrite)
    target = places.place(path)
    beside = None if isinstance(target, places.Uri) else target.parent
    handle, name = tempfile.mkstemp(dir=beside, prefix=f".{target.name}.")
    os.close(handle)
    try:
        yield Path(name)
        if isinstance(target, places.Uri):
            target.write(Path(name).read_bytes())
        else:
            os.replace(name, target)
    finally:
        Path(name).unlink(missing_ok=True)


def check_target(path: str | Path, overwrite: bool = False) -> None:
    target = places.place(path)
    if isinstance(target, Path) and not target.parent.is_dir():
        raise RasterWriteError(f"{target.parent} is no folder")
    if not overwrite and target.exists():
        raise RasterWriteError(f"{path} exists", hint="ask for overwriting")


def check_folder(folder: str | Path) -> Path | places.Uri:
    """Make an output folder in any store, and try to write in it."""
    out = places.place(folder)
    try:
        probe = out / f".probe-{uuid.uuid4().hex}"
        if isinstance(out, places.Uri):
            out.make_folder()
            probe.write(b"")
            probe.delete()
        else:
            out.mkdir(parents=True, exist_ok=True)
            probe.write_bytes(b"")
            probe.unlink()
    except (OSError, ValueError) as e:  # a scheme that no store has is a wrong value
        raise OutputPathError(f"cannot write in {folder}", hint=str(e)) from e
    return out


def write_tiles(cube: DataFrame, path: str, block: int = 256, mode: str = "errorifexists") -> None:
    """Parquet, sorted by tile, so that window reads skip row groups by row and col."""
    keyed = cube.withColumns({"tile_row": F.floor(F.col("row") / block).cast("int"), "tile_col": F.floor(F.col("col") / block).cast("int")})
    keyed.repartitionByRange("tile_row", "tile_col").sortWithinPartitions("tile_row", "tile_col", "row", "col").write.mode(mode).parquet(path)


def write_geotiff(cube: DataFrame, path: str | Path, raster: tiff.Raster, layout: tiff.Layout | None = None, overwrite: bool = False) -> Path | places.Uri:
    """One GeoTIFF of ``cube``; ``raster`` has size, bands, dtype, NoData, place and tags.

    Tasks encode tiles and write them where they belong (:mod:`.writer`); ``path``
    may be a URI of any store that pyarrow knows.
    """
    target = places.place(path)
    check_target(path, overwrite)
    name = str(target) if isinstance(target, places.Uri) else str(target.absolute())
    writer.write_one(cube, cube.sparkSession, name, raster, layout or tiff.Layout())
    return target


def encode_png(image: np.ndarray) -> bytes:
    """Grey (h, w) or colour (h, w, 3) of 8 bits."""
    if image.dtype != np.uint8 or image.ndim not in (2, 3) or (image.ndim == 3 and image.shape[2] != 3):
        raise ValueError("PNG images are 8-bit grey or RGB")
    h, w = image.shape[:2]
    raw = np.concatenate([np.zeros((h, 1), np.uint8), image.reshape(h, -1)], axis=1).tobytes()

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(
        b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0 if image.ndim == 2 else 2, 0, 0, 0),
    ) + chunk(b"IDAT", zlib.compress(raw, 6)) + chunk(b"IEND", b"")


def write_png(path: str | Path, image: DataFrame, width: int, height: int, overwrite: bool = False) -> Path | places.Uri:
    """``image`` (row, col, image ARRAY of 1 or 3), at most a preview's size, as PNG."""
    table = image.select("row", "col", "image").toArrow()  # bounded by the preview's longest side
    rows, cols = (np.asarray(table.column(k).combine_chunks()) for k in ("row", "col"))
    values = np.array(table.column("image").to_pylist(), np.uint8).reshape(len(rows), -1)
    out = np.zeros((height, width, max(1, values.shape[1])), np.uint8)
    out[rows, cols] = values
    with replacing(path, overwrite) as new:
        new.write_bytes(encode_png(out[:, :, 0] if out.shape[2] == 1 else out))
    return places.place(path)


def write_json(path: str | Path, payload: dict[str, Any], overwrite: bool = False) -> Path | places.Uri:
    with replacing(path, overwrite) as new:
        new.write_text(json.dumps(json_safe(payload), indent=2) + "\n")
    return places.place(path)


def write_profile_csv(path: str | Path, rows: list[tuple[int, float | None, float | None]], overwrite: bool = False) -> Path | places.Uri:
    """band_index, wavelength_nm, value; blank where there is none."""
    lines = ["band_index,wavelength_nm,value"]
    lines += [f"{b},{'' if w is None else format(w, 'g')},{'' if v is None else format(v, '.8g')}" for b, w, v in rows]
    with replacing(path, overwrite) as new:
        new.write_text("\n".join(lines) + "\n")
    return places.place(path)
