"""Rasters of one long strip: read some lines at a time."""

import struct
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest

from cubeloom import errors
from cubeloom.sources import collection, raster, tiff


def striped(a, compression, rows=None, planar=1, predictor=1):
    """A TIFF of strips by hand: a is (rows, cols, bands) of uint16."""
    h, w, n = a.shape
    rows = rows or h
    planes = [a] if planar == 1 else [a[:, :, k : k + 1] for k in range(n)]
    pack = {1: bytes, 8: zlib.compress, 50000: lambda s: pa.Codec("zstd").compress(s).to_pybytes()}[compression]

    def coded(x):
        return np.concatenate([x[:, :1], x[:, 1:] - x[:, :-1]], axis=1) if predictor == 2 else x

    strips = [pack(coded(p[i : i + rows]).astype("<u2").tobytes()) for p in planes for i in range(0, h, rows)]
    data, offsets = b"", []
    for s in strips:
        offsets.append(8 + len(data))
        data += s + b"\0" * (len(s) % 2)
    at = 8 + len(data)
    lists, places = b"", []
    for values, code in ((offsets, "I"), (list(map(len, strips)), "I"), ([16] * n, "H")):
        places.append(at + len(lists))
        lists += struct.pack(f"<{len(values)}{code}", *values)
        lists += b"\0" * (len(lists) % 2)
    one = lambda values, place, kind: (kind, len(values), values[0] if len(values) == 1 or (kind == 3 and len(values) == 1) else place)
    tags = {256: (4, 1, w), 257: (4, 1, h), 258: (3, n, 16 if n == 1 else places[2]), 259: (3, 1, compression), 262: (3, 1, 1), 273: one(offsets, places[0], 4), 277: (3, 1, n), 278: (4, 1, rows), 279: one(list(map(len, strips)), places[1], 4), 284: (3, 1, planar), 317: (3, 1, predictor)}
    if n == 2:
        tags[258] = (3, 2, 16 | 16 << 16)
    body = b"".join(struct.pack("<HHII", t, k, c, v) for t, (k, c, v) in sorted(tags.items()))
    return b"II" + struct.pack("<HI", 42, at + len(lists)) + data + lists + struct.pack("<H", len(tags)) + body + struct.pack("<I", 0)


@pytest.mark.parametrize("compression", [1, 8, 50000])
@pytest.mark.parametrize(("rows", "planar", "predictor"), [(None, 1, 1), (None, 2, 2), (6, 1, 2), (7, 2, 1)])
def test_long_strips_line_by_line(spark, tmp_path, monkeypatch, compression, rows, planar, predictor):
    if compression == 1 and predictor == 2:
        predictor = 1
    monkeypatch.setattr(raster, "STRIP_BYTES", 2 * 9 * 2 * 2)
    monkeypatch.setattr(tiff, "READ_BYTES", 7)
    a = np.random.default_rng(compression).integers(0, 60_000, (25, 9, 2)).astype(np.uint16)
    path = tmp_path / "a.tif"
    path.write_bytes(striped(a, compression, rows, planar, predictor))
    reader = raster.CubeReader({"path": str(path), "bands": "2,1,2"})
    got = {}
    for part in reader.partitions():
        for batch in reader.read(part):
            got |= {(r["row"], r["col"]): r["bands"] for r in batch.to_pylist()}
    assert got == {(r, c): [float(a[r, c, b]) for b in (1, 0, 1)] for r in range(25) for c in range(9)}
    some = raster.CubeReader({"path": str(path), "window": "2,11,5,3"})
    got = {(r["row"], r["col"]): r["bands"] for part in some.partitions() for batch in some.read(part) for r in batch.to_pylist()}
    assert got == {(r, c): [float(x) for x in a[r, c]] for r in range(11, 14) for c in range(2, 7)}
    picked = raster.CubeReader({"path": str(path), "out_shape": "3,4"})
    assert sum(len(b) for part in picked.partitions() for b in picked.read(part)) == 12


def test_raw_strips_are_cut_and_pruned(tmp_path, monkeypatch):
    a = np.arange(40 * 10, dtype=np.uint16).reshape(40, 10, 1)
    path = tmp_path / "raw.tif"
    path.write_bytes(striped(a, 1))
    monkeypatch.setattr(raster, "STRIP_BYTES", 100)
    reader = raster.CubeReader({"path": str(path), "window": "0,13,10,4", "partition_bytes": "1"})
    assert reader.raster.block_height == 5 and [p.tiles for p in reader.partitions()] == [((2, 0),), ((3, 0),)]
    assert tiff.split_strips(reader.raster, 100) is reader.raster


def test_memory_of_one_long_strip(tmp_path):
    a = np.random.default_rng(1).integers(0, 3, (20_000, 2000, 1)).astype(np.uint16)
    path = tmp_path / "long.tif"
    path.write_bytes(striped(a, 8))
    reader = raster.CubeReader({"path": str(path), "window": "0,0,10,20000"})
    next(reader.read(reader.partitions()[0]))  # what is imported on first use does not count
    tracemalloc.start()
    n = sum(len(batch) for part in reader.partitions() for batch in reader.read(part))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # 80 MB of samples, 2 MB at a time and some copies of those
    assert n == 200_000 and most < 24 << 20


def test_cut_off_strips_are_errors(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(raster, "STRIP_BYTES", 40)
    a = np.random.default_rng(1).integers(0, 60_000, (25, 9, 1)).astype(np.uint16)
    whole = striped(a, 8)
    header = tiff.read_header(__import__("io").BytesIO(whole))
    header.sizes = [header.sizes[0] // 2]
    path = tmp_path / "b.tif"
    path.write_bytes(whole)
    reader = raster.CubeReader({"path": str(path)}, header)
    with pytest.raises(errors.RasterReadError):
        list(reader.read(reader.partitions()[0]))


def test_strips_in_collections(spark, tmp_path, monkeypatch):
    a = np.random.default_rng(2).integers(1, 60_000, (25, 9, 2)).astype(np.uint16)
    for name, compression in (("raw", 1), ("packed", 8)):
        (tmp_path / f"{name}.tif").write_bytes(striped(a, compression))
    rasters = collection.listed(spark, str(tmp_path))
    got = {(r["raster_id"], r["row"], r["col"]): r["bands"] for r in collection.read(rasters, [2], rows=(3, 20)).collect()}
    assert got == {(f"{k}.tif", r, c): [float(a[r, c, 1])] for k in ("raw", "packed") for r in range(3, 20) for c in range(9)}
