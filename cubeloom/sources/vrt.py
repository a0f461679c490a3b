"""Virtual rasters: an XML file that names rectangles of other rasters, band by band.

No pixel is copied ahead: a block of the virtual grid is read by a task, which
reads just the windows of the sources that the block's rectangle meets, and pastes
them in the order of the file, so that later sources cover earlier ones where they
hold data.  Mosaics, band stacks and mixtures of both are the same plan, without
a shuffle.

Rectangles are taken pixel by pixel; sources that are scaled, filtered, computed or
looked up in tables are not supported and end in a typed error.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from dataclasses import dataclass, field

import numpy as np

from ..errors import RasterReadError, UnsupportedError
from . import tiff

BLOCK = 256
# Names of sample types, and kinds of sources that are rectangles.
TYPES = {"Byte": "uint8", "Int8": "int8", "UInt16": "uint16", "Int16": "int16", "UInt32": "uint32", "Int32": "int32", "UInt64": "uint64", "Int64": "int64", "Float32": "float32", "Float64": "float64"}
RECTANGLES = ("SimpleSource", "ComplexSource")
COMPUTED = ("ScaleRatio", "ScaleOffset", "LUT", "Exponent", "ColorTableComponent", "UseMaskBand")


@dataclass(frozen=True)
class Source:
    """A window of one band of a raster, and where its first pixel goes."""

    path: str
    band: int
    window: tuple[int, int, int, int]
    left: int
    top: int
    nodata: float | None = None


@dataclass
class Vrt:
    """A virtual raster: what its header would say, and the sources of each band."""

    raster: tiff.Raster
    sources: dict[int, list[Source]] = field(default_factory=dict)

    def pieces(self, band: int, left: int, top: int, width: int, height: int) -> list[tuple[Source, tuple[int, int, int, int], int, int]]:
        """(source, its window, column and row in the rectangle) of what lies in a rectangle of a band."""
        out = []
        for s in self.sources.get(band, ()):
            x, y, w, h = s.window
            a, b = max(left, s.left), max(top, s.top)
            c, d = min(left + width, s.left + w), min(top + height, s.top + h)
            if a < c and b < d:
                out.append((s, (x + a - s.left, y + b - s.top, c - a, d - b), a - left, b - top))
        return out


def _rect(node: ET.Element | None, default: tuple[int, int, int, int]) -> tuple[int, int, int, int]:
    if node is None:
        return default
    values = [float(node.get(k, "nan")) for k in ("xOff", "yOff", "xSize", "ySize")]
    if any(v != v or v != round(v) for v in values):
        raise UnsupportedError("rectangles of a virtual raster must be whole pixels", context={"rectangle": values})
    return tuple(int(v) for v in values)  # type: ignore[return-value]


def _number(text: str | None) -> float | None:
    return None if text is None or not text.strip() else float(text)


def parse(text: str, folder: str) -> Vrt:
    """``folder`` is where relative names of sources begin."""
    try:
        root = ET.fromstring(text)
        width, height = int(root.get("rasterXSize", "")), int(root.get("rasterYSize", ""))
    except (ET.ParseError, ValueError) as e:
        raise RasterReadError("not a virtual raster", hint=str(e)) from e
    nodes = root.findall("VRTRasterBand")
    if root.tag != "VRTDataset" or not nodes or root.get("subClass"):
        raise UnsupportedError("only virtual rasters of plain bands are supported", context={"kind": root.get("subClass")})
    kinds = [TYPES.get(n.get("dataType", "Byte")) for n in nodes]
    if None in kinds or any(n.get("subClass") for n in nodes):
        raise UnsupportedError("a band's kind is not supported", context={"types": [n.get("dataType") for n in nodes], "kinds": [n.get("subClass") for n in nodes]})
    nodata = {_number(n.findtext("NoDataValue")) for n in nodes}
    if len({str(v) for v in nodata}) > 1:
        raise UnsupportedError("bands with NoData values of their own are not supported", context={"nodata": sorted(map(str, nodata))})
    r = tiff.Raster(width=width, height=height, count=len(nodes), dtype=str(np.result_type(*kinds)), tiled=True, block_width=BLOCK, block_height=BLOCK, nodata=next(iter(nodata)))
    if place := root.findtext("GeoTransform"):
        x, dx, rx, y, ry, dy = (float(v) for v in place.split(","))
        r.transform = (dx, rx, x, ry, dy, y)
    if srs := root.findtext("SRS"):
        codes = re.findall(r'AUTHORITY\["EPSG",\s*"(\d+)"\]\]\s*$|^\s*EPSG:(\d+)\s*$', srs)
        r.epsg = int(codes[-1][0] or codes[-1][1]) if codes else None
        r.geographic = srs.lstrip().startswith(("GEOG", "EPSG:4326"))
    r.tags = {i.get("key", ""): i.text or "" for m in root.findall("Metadata") if not m.get("domain") for i in m.findall("MDI")}
    out = Vrt(r)
    for i, node in enumerate(nodes, 1):
        if name := node.findtext("Description"):
            r.descriptions[i] = name
        r.band_tags[i] = {m.get("key", ""): m.text or "" for group in node.findall("Metadata") if not group.get("domain") for m in group.findall("MDI")}
        out.sources[i] = [_source(s, folder, width, height) for s in node if s.tag.endswith("Source")]
    r.band_tags = {k: v for k, v in r.band_tags.items() if v}
    return out


def _source(node: ET.Element, folder: str, width: int, height: int) -> Source:
    if node.tag not in RECTANGLES or any(node.find(k) is not None for k in COMPUTED):
        raise UnsupportedError(f"sources of kind {node.tag} that compute values are not supported")
    name = node.find("SourceFilename")
    if name is None or not name.text:
        raise RasterReadError("a source of the virtual raster has no name")
    path = f"{folder}/{name.text}" if name.get("relativeToVRT") == "1" and folder else name.text
    band = node.findtext("SourceBand", "1")
    if not band.strip().isdigit():
        raise UnsupportedError(f"source band {band} is not supported")
    target = _rect(node.find("DstRect"), (0, 0, width, height))
    window = _rect(node.find("SrcRect"), (0, 0, *target[2:]))
    if window[2:] != target[2:]:
        raise UnsupportedError("sources that are scaled are not supported", context={"source": window, "target": target})
    return Source(path, int(band), window, target[0], target[1], _number(node.findtext("NODATA")))
