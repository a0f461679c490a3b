"""GeoTIFF bytes: header, blocks, and an encoder.  No Spark here; tasks call it block by block.

Read: classic and BigTIFF of either byte order, strips and tiles, both planar
layouts, no compression, DEFLATE, LZW and ZSTD, predictors 1 to 3.  Written:
tiled, one plane per band, DEFLATE, ZSTD or none, with GeoKeys, NoData, band
tags and RPC.
"""

from __future__ import annotations

import struct
import xml.etree.ElementTree as ET
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from typing import Any, BinaryIO
from xml.sax.saxutils import escape, quoteattr

import numpy as np
import pyarrow as pa

from ..errors import RasterReadError, UnsupportedError

# Field sizes, tags, GeoKeys and the order of the RPC tag.
_TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 7: "B", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
_WIDTH, _HEIGHT, _BITS, _COMPRESSION, _STRIP_OFFSETS, _SAMPLES, _STRIP_ROWS, _STRIP_COUNTS, _PLANAR, _PREDICTOR = 256, 257, 258, 259, 273, 277, 278, 279, 284, 317
_TILE_WIDTH, _TILE_HEIGHT, _TILE_OFFSETS, _TILE_COUNTS, _FORMAT, _PHOTOMETRIC, _EXTRA = 322, 323, 324, 325, 339, 262, 338
_SCALE, _TIEPOINT, _MATRIX, _KEYS, _KEY_DOUBLES, _KEY_ASCII, _XML, _NODATA, _RPC = 33550, 33922, 34264, 34735, 34736, 34737, 42112, 42113, 50844
_RPC_SCALARS = (
    "err_bias", "err_rand", "line_off", "samp_off", "lat_off", "long_off", "height_off", "line_scale", "samp_scale", "lat_scale", "long_scale",
    "height_scale",
)
_RPC_POLYNOMIALS = ("line_num", "line_den", "samp_num", "samp_den")
_RPC_NEEDED = _RPC_SCALARS[2:]
_NONE, _LZW, _DEFLATE, _OLD_DEFLATE, _ZSTD = 1, 5, 8, 32946, 50000


class Blocks(dict):
    """Places or sizes of some blocks by index, of a raster that has ``total`` blocks."""

    total = 0

    def __len__(self) -> int:
        return self.total

    def __reduce__(self):  # noqa: ANN204
        return _blocks, (list(self.items()), self.total)


def _blocks(items: list[tuple[int, int]], total: int) -> Blocks:
    out = Blocks(items)
    out.total = total
    return out


def with_blocks(r: Raster, indices: list[int]) -> Raster:
    """``r`` that knows only some of its blocks, and so is small however many there are."""
    known = [i for i in indices if i < len(r.offsets)]
    return replace(r, offsets=_blocks([(i, r.offsets[i]) for i in known], len(r.offsets)), sizes=_blocks([(i, r.sizes[i]) for i in known], len(r.sizes)))


#: Bytes of a compressed strip that are read at a time, where it is inflated in pieces.
READ_BYTES = 1 << 20


@dataclass
class Raster:
    """What a header says; ``bands`` have dtype, description, wavelength tags and NoData in common here."""

    width: int = 0
    height: int = 0
    count: int = 1
    dtype: str = "uint8"
    order: str = "<"
    compression: int = _NONE
    predictor: int = 1
    planar: int = 1
    block_width: int = 0
    block_height: int = 0
    tiled: bool = False
    offsets: list[int] | Blocks = field(default_factory=list)
    sizes: list[int] | Blocks = field(default_factory=list)
    nodata: float | None = None
    transform: tuple[float, ...] = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)
    epsg: int | None = None
    #: EPSG code of the unit of map coordinates, where the file says one.
    unit: int | None = None
    geographic: bool = False
    tags: dict[str, str] = field(default_factory=dict)
    imagery: dict[int, dict[str, str]] = field(default_factory=dict)
    band_tags: dict[int, dict[str, str]] = field(default_factory=dict)
    descriptions: dict[int, str] = field(default_factory=dict)
    rpc: dict[str, Any] | None = None

    @property
    def across(self) -> int:
        return -(-self.width // self.block_width)

    @property
    def down(self) -> int:
        return -(-self.height // self.block_height)

    @property
    def placed(self) -> bool:
        return self.epsg is not None and self.transform != (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)

    @property
    def bounds(self) -> tuple[float, float, float, float]:
        a, b, c, d, e, f = self.transform
        xs = [a * i + b * j + c for i in (0, self.width) for j in (0, self.height)]
        ys = [d * i + e * j + f for i in (0, self.width) for j in (0, self.height)]
        return min(xs), min(ys), max(xs), max(ys)


# -- reading ----------------------------------------------------------------------------------


def read_header(file: BinaryIO) -> Raster:
    """The first image of a TIFF."""
    file.seek(0)
    magic = file.read(16)
    order = {b"II": "<", b"MM": ">"}.get(magic[:2])
    if order is None or len(magic) < 8:
        raise RasterReadError("not a TIFF file")
    version = struct.unpack(order + "H", magic[2:4])[0]
    if version == 43:
        first, big = struct.unpack(order + "Q", magic[8:16])[0], True
    elif version == 42:
        first, big = struct.unpack(order + "I", magic[4:8])[0], False
    else:
        raise RasterReadError("not a TIFF file")
    return _interpret(_directory(file, first, order, big), order)


def _directory(file: BinaryIO, at: int, order: str, big: bool) -> dict[int, Any]:
    file.seek(at)
    n = struct.unpack(order + ("Q" if big else "H"), file.read(8 if big else 2))[0]
    size, inline = (20, 8) if big else (12, 4)
    entries = file.read(n * size)
    if len(entries) < n * size:
        raise RasterReadError("the TIFF directory is cut off")
    out: dict[int, Any] = {}
    for i in range(n):
        entry = entries[i * size : (i + 1) * size]
        tag, kind = struct.unpack(order + "HH", entry[:4])
        count = struct.unpack(order + ("Q" if big else "I"), entry[4 : 12 if big else 8])[0]
        if kind not in _TYPES:
            continue
        code = _TYPES[kind]
        length = struct.calcsize("=" + code) * count
        data = entry[-inline:]
        if length > inline:
            file.seek(struct.unpack(order + ("Q" if big else "I"), data)[0])
            data = file.read(length)
        if kind == 2:
            out[tag] = data[:count].split(b"\x00")[0].decode("utf-8", "replace")
        else:
            out[tag] = struct.unpack(order + code * count, data[:length])
    return out


def _interpret(t: dict[int, Any], order: str) -> Raster:
    one = lambda tag, default: t[tag][0] if tag in t else default
    bits, kind = one(_BITS, 1), one(_FORMAT, 1)
    name = {1: "uint", 2: "int", 3: "float"}.get(kind)
    if name is None or bits not in (8, 16, 32, 64) or len(set(t.get(_BITS, (bits,)))) > 1:
        raise UnsupportedError(f"samples of {bits} bits and format {kind} are not supported")
    r = Raster(
        width=one(_WIDTH, 0), height=one(_HEIGHT, 0), count=one(_SAMPLES, 1), dtype=f"{name}{bits}", order=order, compression=one(_COMPRESSION, 1),
        predictor=one(_PREDICTOR, 1), planar=one(_PLANAR, 1),
    )
    r.tiled = _TILE_OFFSETS in t
    if r.tiled:
        r.block_width, r.block_height, r.offsets, r.sizes = one(_TILE_WIDTH, 0), one(_TILE_HEIGHT, 0), list(t[_TILE_OFFSETS]), list(t[_TILE_COUNTS])
    else:
        r.block_width, r.block_height = r.width, min(one(_STRIP_ROWS, r.height), r.height)
        r.offsets, r.sizes = list(t.get(_STRIP_OFFSETS, ())), list(t.get(_STRIP_COUNTS, ()))
    if r.compression not in (_NONE, _LZW, _DEFLATE, _OLD_DEFLATE, _ZSTD):
        raise UnsupportedError(f"TIFF compression {r.compression} is not supported")
    if _NODATA in t:
        text = t[_NODATA].strip()
        try:
            r.nodata = float(text)
        except ValueError:
            r.nodata = None
    _place(r, t)
    if _XML in t:
        _metadata(r, t[_XML])
    if _RPC in t and len(t[_RPC]) >= 92:
        values = list(t[_RPC])
        r.rpc = dict(zip(_RPC_SCALARS, values, strict=False)) | {k: values[12 + 20 * i : 32 + 20 * i] for i, k in enumerate(_RPC_POLYNOMIALS)}
    return r


def _place(r: Raster, t: dict[int, Any]) -> None:
    if _MATRIX in t and len(t[_MATRIX]) >= 8:
        m = t[_MATRIX]
        r.transform = (m[0], m[1], m[3], m[4], m[5], m[7])
    elif _SCALE in t and _TIEPOINT in t:
        (sx, sy), (i, j, _, x, y) = t[_SCALE][:2], t[_TIEPOINT][:5]
        r.transform = (sx, 0.0, x - i * sx, 0.0, -sy, y + j * sy)
    keys = {}
    raw = t.get(_KEYS, ())
    for i in range(4, len(raw) - 3, 4):
        if raw[i + 1] == 0:
            keys[raw[i]] = raw[i + 3]
    if keys.get(1025) == 2 and r.transform != (1.0, 0.0, 0.0, 0.0, 1.0, 0.0):  # values stand at points: half a pixel to the corner
        a, b, c, d, e, f = r.transform
        r.transform = (a, b, c - (a + b) / 2, d, e, f - (d + e) / 2)
    r.unit = keys.get(3076) if keys.get(3076, 32767) != 32767 else None
    if keys.get(1024) == 2 and keys.get(2048, 32767) != 32767:
        r.epsg, r.geographic = keys[2048], True
    elif keys.get(1024) == 1 and keys.get(3072, 32767) != 32767:
        r.epsg = keys[3072]


def _metadata(r: Raster, xml: str) -> None:
    try:
        items = ET.fromstring(xml).iter("Item")
    except ET.ParseError:
        return
    rpc: dict[str, Any] = {}
    for item in items:
        name, value, domain, sample, role = item.get("name", ""), item.text or "", item.get("domain", ""), item.get("sample"), item.get("role")
        if domain == "RPC":
            rpc[name.lower()] = value
        elif sample is None:
            if not domain:
                r.tags[name] = value
        elif role == "description":
            r.descriptions[int(sample) + 1] = value
        elif domain == "IMAGERY":
            r.imagery.setdefault(int(sample) + 1, {})[name] = value
        elif not domain:
            r.band_tags.setdefault(int(sample) + 1, {})[name] = value
    if rpc and r.rpc is None:
        r.rpc = _rpc_from_text(rpc)


def _rpc_from_text(raw: dict[str, str]) -> dict[str, Any] | None:
    """A model that lacks a required key counts as none; short polynomials are filled up with zeros."""
    out: dict[str, Any] = {}
    try:
        for k in _RPC_SCALARS:
            if k in raw:
                out[k] = float(raw[k].split()[0])
        for k in _RPC_POLYNOMIALS:
            values = [float(x) for x in raw[k + "_coeff"].split()][:20]
            out[k] = values + [0.0] * (20 - len(values))
    except (KeyError, ValueError, IndexError):
        return None
    return out if all(k in out for k in _RPC_NEEDED) else None


def rpc_issues(rpc: dict[str, Any]) -> list[str]:
    """Why a model cannot be used; empty if it can."""
    out = [f"{k} has {len(rpc.get(k) or [])} of 20 terms" for k in _RPC_POLYNOMIALS if len(rpc.get(k) or []) != 20]
    out += [f"{k} is all zero" for k in _RPC_POLYNOMIALS if len(rpc.get(k) or []) == 20 and not any(rpc[k])]
    out += [f"{k} is missing" for k in _RPC_NEEDED if rpc.get(k) is None]
    return out + [f"{k} is zero" for k in _RPC_NEEDED if k.endswith("scale") and rpc.get(k) == 0]


def block_index(r: Raster, band: int, tile_row: int, tile_col: int) -> int:
    """Where a block's offset stands; ``band`` (1-based) counts only for separate planes."""
    n = tile_row * r.across + tile_col
    return n if r.planar == 1 else (band - 1) * r.across * r.down + n


def split_strips(r: Raster, limit: int) -> Raster:
    """``r`` with uncompressed strips of more than ``limit`` bytes as several shorter ones: a strip is lines one after another."""
    line = r.width * (r.count if r.planar == 1 else 1) * np.dtype(r.dtype).itemsize
    if r.tiled or r.compression != _NONE or r.block_height <= 1 or r.block_height * line <= limit or not r.offsets:
        return r
    fit = max(1, min(limit // max(1, line), r.block_height))
    # the pieces of every strip but the last of a plane must fill it
    rows = fit if r.down == 1 else next(k for k in range(fit, 0, -1) if r.block_height % k == 0)
    offsets, sizes = [], []
    for plane in range(1 if r.planar == 1 else r.count):
        for top in range(0, r.height, rows):
            strip = plane * r.down + top // r.block_height
            sparse = not r.sizes[strip]
            offsets.append(0 if sparse else r.offsets[strip] + top % r.block_height * line)
            sizes.append(0 if sparse else min(rows, r.height - top) * line)
    return replace(r, block_height=rows, offsets=offsets, sizes=sizes)


def in_pieces(r: Raster, limit: int) -> bool:
    """Whether a strip is inflated in pieces, because it is more than ``limit`` bytes as a whole."""
    samples = r.count if r.planar == 1 else 1
    return not r.tiled and r.compression in (_DEFLATE, _OLD_DEFLATE, _ZSTD) and r.block_height * r.width * samples * np.dtype(r.dtype).itemsize > limit


def read_pieces(file: Any, r: Raster, index: int, rows: int, limit: int) -> Iterator[np.ndarray]:
    """The lines of a compressed strip from the first on, (lines, width, samples) of at most ``limit`` bytes at a time."""
    samples = r.count if r.planar == 1 else 1
    line = r.width * samples * np.dtype(r.dtype).itemsize
    each = max(1, limit // line)
    if not r.sizes[index]:
        for top in range(0, rows, each):
            yield _sparse(r, min(each, rows - top), samples)
        return
    held, left = bytearray(), rows
    try:
        for data in _inflated(file, r.offsets[index], r.sizes[index], r.compression, max(line, min(limit, each * line))):
            held += data
            while left and len(held) >= (some := min(each, left)) * line:
                yield _samples(bytes(memoryview(held)[: some * line]), r, some, samples)
                del held[: some * line]
                left -= some
            if not left:
                return
    except (zlib.error, OSError) as e:
        raise RasterReadError(f"a block cannot be decompressed: {e}") from e
    raise RasterReadError("a block is cut off")


def _inflated(file: Any, offset: int, size: int, compression: int, most: int) -> Iterator[bytes]:
    """What a compressed range of ``file`` holds, at most ``most`` bytes at a time, reading as little ahead."""
    ranged = _Range(file, offset, size)
    if compression == _ZSTD:
        with pa.CompressedInputStream(pa.PythonFile(ranged, "r"), "zstd") as source:
            while data := source.read(most):
                yield data
        return
    engine, data = zlib.decompressobj(), b""
    while not engine.eof:
        data = engine.unconsumed_tail or ranged.read(READ_BYTES)
        out = engine.decompress(data, most)
        if out:
            yield out
        elif not data:
            return


class _Range:
    """Some bytes of a file, as a file of its own; several can be read in turns."""

    closed = False

    def __init__(self, file: Any, offset: int, size: int):
        self.file, self.at, self.end = file, offset, offset + size

    def read(self, n: int = -1) -> bytes:
        n = self.end - self.at if n is None or n < 0 else min(n, self.end - self.at)
        self.file.seek(self.at)
        data = self.file.read(n)
        self.at += len(data)
        return data

    def readable(self) -> bool:
        return True

    def close(self) -> None:
        pass


def _sparse(r: Raster, rows: int, samples: int) -> np.ndarray:
    return np.full((rows, r.block_width, samples), 0 if r.nodata is None else r.nodata).astype(r.dtype)


def read_block(file: BinaryIO, r: Raster, index: int, rows: int) -> np.ndarray:
    """A block as (rows, block_width, samples); ``rows`` is what a strip still holds."""
    samples = r.count if r.planar == 1 else 1
    if index >= len(r.offsets):
        raise RasterReadError("the raster has fewer blocks than its size asks for")
    dtype = np.dtype(r.dtype).newbyteorder(r.order)
    size = rows * r.block_width * samples * dtype.itemsize
    if not r.sizes[index]:  # a sparse block
        return _sparse(r, rows, samples)
    file.seek(r.offsets[index])
    data = file.read(r.sizes[index])
    try:
        if r.compression in (_DEFLATE, _OLD_DEFLATE):
            data = zlib.decompress(data)
        elif r.compression == _ZSTD:
            data = pa.Codec("zstd").decompress(data, size).to_pybytes()
        elif r.compression == _LZW:
            data = unpack_lzw(data, size)
    except (zlib.error, OSError, IndexError) as e:
        raise RasterReadError(f"a block cannot be decompressed: {e}") from e
    if len(data) < size:
        raise RasterReadError("a block is cut off")
    return _samples(data, r, rows, samples)


def _samples(data: bytes, r: Raster, rows: int, samples: int) -> np.ndarray:
    """Inflated lines as numbers."""
    dtype = np.dtype(r.dtype).newbyteorder(r.order)
    size = rows * r.block_width * samples * dtype.itemsize
    if r.predictor == 3:
        width = r.block_width * samples
        raw = np.frombuffer(data[:size], np.uint8).reshape(rows, width * dtype.itemsize).copy()
        flat = raw.reshape(rows, -1, samples)
        np.cumsum(flat, axis=1, dtype=np.uint8, out=flat)
        planes = flat.reshape(rows, dtype.itemsize, width)
        return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(np.dtype(r.dtype).newbyteorder(">")).reshape(rows, r.block_width, samples).astype(r.dtype)
    out = np.frombuffer(data[:size], dtype).reshape(rows, r.block_width, samples).astype(r.dtype)
    if r.predictor == 2:
        np.cumsum(out, axis=1, dtype=out.dtype, out=out)
    return out


def unpack_lzw(data: bytes, size: int) -> bytes:
    """TIFF's LZW, most significant bit first, codes of 9 to 12 bits."""
    out = bytearray()
    table: list[bytes] = []
    previous = b""
    bits = value = 0
    width = 9
    for byte in data:
        value = (value << 8) | byte
        bits += 8
        while bits >= width:
            bits -= width
            code = (value >> bits) & ((1 << width) - 1)
            value &= (1 << bits) - 1
            if code == 256:
                table, width, previous = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
                continue
            if code == 257 or len(out) >= size:
                return bytes(out)
            if not previous:
                entry = table[code]
            else:
                entry = table[code] if code < len(table) else previous + previous[:1]
                table.append(previous + entry[:1])
            out += entry
            previous = entry
            if len(table) + 1 >= 1 << width and width < 12:
                width += 1
    return bytes(out)


# -- writing ----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Layout:
    """How a file is written."""

    compression: str = "deflate"
    block: int = 256
    predictor: int | None = None

    def __post_init__(self) -> None:
        if self.compression not in ("none", "deflate", "zstd"):
            raise UnsupportedError(f"writing {self.compression} is not supported")
        if self.block < 16 or self.block % 16:
            raise ValueError("the block size is a multiple of 16")
        if self.predictor not in (None, 1, 2, 3):
            raise ValueError("predictors are 1, 2 and 3")

    def predictor_for(self, dtype: str) -> int:
        if self.compression == "none":
            return 1
        return self.predictor or (3 if np.dtype(dtype).kind == "f" else 2)


def pack_block(block: np.ndarray, layout: Layout) -> bytes:
    """One plane of one tile."""
    data = np.ascontiguousarray(block)
    kind = layout.predictor_for(str(data.dtype))
    if kind == 3:
        big = data.astype(data.dtype.newbyteorder(">")).view(np.uint8).reshape(data.shape[0], data.shape[1], data.itemsize)
        flat = np.ascontiguousarray(big.transpose(0, 2, 1)).reshape(data.shape[0], -1)
        raw = np.diff(flat, axis=1, prepend=np.zeros((len(flat), 1), np.uint8)).astype(np.uint8).tobytes()
    else:
        if kind == 2:
            data = np.concatenate([data[:, :1], data[:, 1:] - data[:, :-1]], axis=1)
        raw = data.astype(data.dtype.newbyteorder("<")).tobytes()
    if layout.compression == "deflate":
        return zlib.compress(raw, 6)
    return pa.Codec("zstd").compress(raw).to_pybytes() if layout.compression == "zstd" else raw


def _xml(r: Raster) -> str:
    items = [f"<Item name={quoteattr(k)}>{escape(v)}</Item>" for k, v in r.tags.items()]
    for band, text in r.descriptions.items():
        items.append(f'<Item name="DESCRIPTION" sample="{band - 1}" role="description">{escape(text)}</Item>')
    for band, tags in r.band_tags.items():
        items += [f'<Item name={quoteattr(k)} sample="{band - 1}">{escape(v)}</Item>' for k, v in tags.items()]
    return f"<GDALMetadata>{''.join(items)}</GDALMetadata>" if items else ""


def directory_bytes(r: Raster, layout: Layout, big: bool, end: int) -> tuple[bytes, bytes]:
    """(header at the start of the file, all that follows the blocks) of a file whose blocks end at ``end``."""
    kind = {"u": 1, "i": 2, "f": 3}[np.dtype(r.dtype).kind]
    bits = np.dtype(r.dtype).itemsize * 8
    code = {"none": _NONE, "deflate": _DEFLATE, "zstd": _ZSTD}[layout.compression]
    long = (16, "Q") if big else (4, "I")
    tags: dict[int, tuple[int, str, list | bytes]] = {
        _WIDTH: (*long, [r.width]), _HEIGHT: (*long, [r.height]), _BITS: (3, "H", [bits] * r.count), _COMPRESSION: (3, "H", [code]), _PHOTOMETRIC: (3, "H", [1]), _SAMPLES: (3, "H", [r.count]),
        _PLANAR: (3, "H", [2]), _PREDICTOR: (3, "H", [layout.predictor_for(r.dtype)]), _TILE_WIDTH: (4, "I", [layout.block]), _TILE_HEIGHT: (4, "I", [layout.block]), _TILE_OFFSETS: (*long, r.offsets), _TILE_COUNTS: (*long, r.sizes), _FORMAT: (3, "H", [kind] * r.count),
    }
    if r.count > 1:
        tags[_EXTRA] = (3, "H", [0] * (r.count - 1))
    a, b, c, d, e, f = r.transform
    if r.transform != (1.0, 0.0, 0.0, 0.0, 1.0, 0.0):
        if b == d == 0 and e < 0:
            tags[_SCALE], tags[_TIEPOINT] = (12, "d", [a, -e, 0.0]), (12, "d", [0.0, 0.0, 0.0, c, f, 0.0])
        else:
            tags[_MATRIX] = (12, "d", [a, b, 0.0, c, d, e, 0.0, f] + [0.0] * 7 + [1.0])
    if r.epsg is not None:
        keys = [(1024, 2 if r.geographic else 1), (1025, 1), (2048 if r.geographic else 3072, r.epsg)]
        tags[_KEYS] = (3, "H", [1, 1, 0, len(keys), *[x for k, v in keys for x in (k, 0, 1, v)]])
    if xml := _xml(r):
        tags[_XML] = (2, "s", xml.encode() + b"\x00")
    if r.nodata is not None:
        text = "nan" if r.nodata != r.nodata else f"{r.nodata:g}" if float(f"{r.nodata:g}") == r.nodata else repr(float(r.nodata))
        tags[_NODATA] = (2, "s", text.encode() + b"\x00")
    if r.rpc is not None:
        values = [float(r.rpc.get(k, 0.0) or 0.0) for k in _RPC_SCALARS] + [float(x) for k in _RPC_POLYNOMIALS for x in r.rpc[k]]
        tags[_RPC] = (12, "d", values)
    inline, entries, tail = (8 if big else 4), [], bytearray()

    def append(data: bytes) -> int:
        """Where ``data`` stands in the file, at an even place."""
        tail.extend(b"\x00" * ((end + len(tail)) % 2))
        tail.extend(data)
        return end + len(tail) - len(data)

    for tag, (number, code_, values) in sorted(tags.items()):
        data = values if isinstance(values, bytes) else struct.pack(f"<{len(values)}{code_}", *values)
        if len(data) > inline:
            data = struct.pack("<Q" if big else "<I", append(data))
        entries.append(struct.pack("<HH" + ("Q" if big else "I"), tag, number, len(values)) + data.ljust(inline, b"\x00"))
    at = append(struct.pack("<Q" if big else "<H", len(entries)) + b"".join(entries) + struct.pack("<Q" if big else "<I", 0))
    return struct.pack("<2sHHHQ", b"II", 43, 8, 0, at) if big else struct.pack("<2sHI", b"II", 42, at), bytes(tail)


def write_directory(file: BinaryIO, r: Raster, layout: Layout, big: bool) -> None:
    """The directory, at the end of ``file``, and the header that leads to it."""
    file.seek(0, 2)
    head, tail = directory_bytes(r, layout, big, file.tell())
    file.write(tail)
    file.seek(0)
    file.write(head)
