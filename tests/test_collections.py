"""Files written by tasks in two phases, and many rasters scanned in one plan."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cubeloom import errors
from cubeloom.sources import catalog, collection, places, raster, sinks, tiff, writer

PLACE = (30.0, 0.0, 500000.0, 0.0, -30.0, 5000000.0)


def frame(spark, arrays):
    """Pixels (raster_id, row, col, bands) of {id: (bands, rows, cols)}; NaN is null."""
    rows = [(k, r, c, [None if np.isnan(v) else float(v) for v in a[:, r, c]]) for k, a in arrays.items() for r in range(a.shape[1]) for c in range(a.shape[2])]
    return spark.createDataFrame(rows, "raster_id string, row int, col int, bands array<double>")


def by_hand(a, header, layout):
    """The file's bytes, tile by tile."""
    b, out = layout.block, bytearray(16)
    count, height, width = a.shape
    fill = 0.0 if header.nodata is None else header.nodata
    header.offsets, header.sizes, header.block_width, header.block_height = [], [], b, b
    for band in range(count):
        for top in range(0, height, b):
            for left in range(0, width, b):
                tile = np.full((b, b), fill)
                part = np.nan_to_num(a[band, top : top + b, left : left + b], nan=fill)
                tile[: part.shape[0], : part.shape[1]] = part
                data = tiff.pack_block(tile.astype(header.dtype), layout)
                header.offsets.append(len(out))
                header.sizes.append(len(data))
                out += data
    head, tail = tiff.directory_bytes(header, layout, False, len(out))
    out[: len(head)] = head
    return bytes(out) + tail


def files_below(folder):
    return sorted(str(p.relative_to(folder)) for p in folder.rglob("*") if p.is_file() and not p.name.endswith(".crc"))


# -- the writer -------------------------------------------------------------------------------


@pytest.mark.parametrize(("dtype", "compression", "spans"), [("uint16", "deflate", 64 << 20), ("float32", "zstd", 700), ("int16", "none", 1)])
def test_same_bytes_as_tile_by_tile(spark, tmp_path, monkeypatch, dtype, compression, spans):
    monkeypatch.setattr(writer, "SPAN_BYTES", spans)
    monkeypatch.setattr(writer.place, "__defaults__", (spans,))
    a = np.random.default_rng(1).integers(1, 900, (3, 37, 50)).astype(float)
    a[:, 3, 4] = np.nan
    layout = tiff.Layout(compression, 16)
    make = lambda: tiff.Raster(width=50, height=37, count=3, dtype=dtype, nodata=0.0, transform=PLACE, epsg=32633, tags={"A": "b"})
    path = sinks.write_geotiff(frame(spark, {"": a}), tmp_path / "a.tif", make(), layout)
    assert path.read_bytes() == by_hand(a, make(), layout)
    assert files_below(tmp_path) == ["a.tif"]


def test_other_stores_get_the_same_bytes_as_a_stream(spark, tmp_path, monkeypatch):
    a = np.random.default_rng(2).integers(1, 900, (2, 20, 33)).astype(float)
    make = lambda: tiff.Raster(width=33, height=20, count=2, dtype="uint16", nodata=0.0)
    layout, path = tiff.Layout(block=16), (tmp_path / "b.tif").as_uri()
    cube, kept = frame(spark, {"": a}), places.local_path
    rows = [("", path, 33, 20, None, None)]
    folder = (tmp_path / "staged").as_uri()
    every = writer.tiled(cube, 16)
    index = writer.stage(writer.tiles(every, 2, "uint16", 0.0, layout), folder)
    monkeypatch.setattr(places, "local_path", lambda p: None if p == path else kept(p))
    done = writer.place(index, spark.createDataFrame(rows, writer.RASTERS), folder, make(), layout).collect()
    assert (tmp_path / "b.tif").read_bytes() == by_hand(a, make(), layout) and done[0]["bytes"] == (tmp_path / "b.tif").stat().st_size
    # a URI as target, there already
    monkeypatch.undo()
    with pytest.raises(errors.RasterWriteError):
        sinks.write_geotiff(cube, path, make(), layout)
    assert sinks.write_geotiff(cube, path, make(), layout, overwrite=True)
    assert (tmp_path / "b.tif").read_bytes() == by_hand(a, make(), layout)


def test_a_task_that_fails_leaves_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(writer, "shared_dir", lambda session, tag: (tmp_path / "shared" / tag).as_uri())
    a = np.random.default_rng(3).integers(1, 900, (1, 64, 64)).astype(float)
    cube = frame(spark, {"": a}).repartition(4)
    bad = cube.withColumn("row", F.when((F.col("row") == 60) & (F.col("col") == 60), F.raise_error(F.lit("no pixel"))).otherwise(F.col("row")).cast("int"))
    header = tiff.Raster(width=64, height=64, count=1, dtype="uint16")
    with pytest.raises(PySparkException):
        sinks.write_geotiff(bad, tmp_path / "c.tif", header, tiff.Layout(block=16))
    nulls = cube.withColumn("bands", F.when(F.col("row") == 5, F.array(F.lit(None).cast("double"))).otherwise(F.col("bands")))
    with pytest.raises(PySparkException, match="NoData"):
        sinks.write_geotiff(nulls, tmp_path / "c.tif", header, tiff.Layout(block=16))
    (tmp_path / "c.tif").write_bytes(b"old")
    with pytest.raises(PySparkException):
        sinks.write_geotiff(bad, tmp_path / "c.tif", header, tiff.Layout(block=16), overwrite=True)
    # phase two: spans are written, and the file's own task fails
    monkeypatch.setattr(tiff, "directory_bytes", None)
    with pytest.raises(PySparkException):
        sinks.write_geotiff(cube, tmp_path / "c.tif", header.__class__(**(vars(header) | {"offsets": [], "sizes": [], "rpc": {"line_num": None}})), tiff.Layout(block=16), overwrite=True)
    assert files_below(tmp_path) == ["c.tif"] and (tmp_path / "c.tif").read_bytes() == b"old"


def test_parts_of_lost_attempts_do_not_count(tmp_path):
    import pyarrow as pa

    sink = writer.BlockWriter(tmp_path.as_uri())
    kinds = pa.schema([("raster_id", pa.string()), ("band", pa.int32()), ("tile_row", pa.int32()), ("tile_col", pa.int32()), ("payload", pa.binary())])
    batch = lambda *data: pa.RecordBatch.from_pylist([{"raster_id": "a", "band": 0, "tile_row": i, "tile_col": 0, "payload": d} for i, d in enumerate(data)], kinds)
    lost, won = sink.write(iter([batch(b"xx")])), sink.write(iter([batch(b"xx", b""), batch(b"yyy")]))
    nothing = sink.write(iter([]))
    sink.commit([won, None, nothing])
    assert lost.name != won.name and nothing.name is None and len(list(tmp_path.glob("*.blocks"))) == 2
    assert (tmp_path / writer.COMMITTED).read_text() == f'["{won.name}"]'
    assert pa.parquet.read_table(tmp_path / f"{won.name}.index").column("start").to_pylist() == [0, 2, 2]

    def broken():
        yield batch(b"xx")
        raise OSError("gone")

    with pytest.raises(OSError, match="gone"):
        sink.write(broken())
    assert len(list(tmp_path.glob("*.blocks"))) == 2
    sink.abort([won])
    assert not tmp_path.exists()


# -- many rasters -----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """1,000 rasters of several sizes written by one plan, and their arrays."""
    folder = tmp_path_factory.mktemp("many")
    rng = np.random.default_rng(7)
    arrays = {f"r{i:04}": rng.integers(1, 60_000, (2, int(rng.integers(1, 9)), int(rng.integers(1, 9)))).astype(float) for i in range(999)}
    arrays["large"] = rng.integers(1, 60_000, (2, 90, 70)).astype(float)
    arrays["large"][:, 80:, :] = np.nan
    listing = [(k, str(folder / f"{k}.tif"), a.shape[2], a.shape[1], [30.0, 0.0, 1000.0 * i, 0.0, -30.0, 5000.0], 32633) for i, (k, a) in enumerate(arrays.items())]
    rasters = spark.createDataFrame(listing, writer.RASTERS)
    done = writer.write_collection(frame(spark, arrays), rasters, tiff.Raster(count=2, dtype="uint16", nodata=0.0), tiff.Layout(block=16))
    assert done.count() == 1000 and done.filter("raster_id = 'large'").first()["blocks"] == 2 * 6 * 5
    return rasters.select("raster_id", "path"), arrays, folder


def found(df):
    return {(r["raster_id"], r["row"], r["col"]): r["bands"] for r in df.collect()}


def plain(arrays, bands=(0, 1)):
    return {(k, r, c): [None if np.isnan(a[b, r, c]) else a[b, r, c] for b in bands] for k, a in arrays.items() for r in range(a.shape[1]) for c in range(a.shape[2])}


def test_a_thousand_rasters_in_one_plan(spark, many):
    rasters, arrays, folder = many
    cube = collection.read(rasters)
    assert cube.columns == ["raster_id", "row", "col", "bands"]
    assert found(cube) == plain(arrays)
    one = {(r["row"], r["col"]): r["bands"] for r in raster.read(spark, str(folder / "r0007.tif"), [2]).collect()}
    assert {k[1:]: v for k, v in found(collection.read(rasters.filter("raster_id = 'r0007'"), [2])).items()} == one
    rasters_row, bands_row = catalog.inspect(spark, rasters.limit(50))
    assert rasters_row.count() == 50 and bands_row.count() == 100


def test_only_what_is_asked_for_is_read(spark, many, tmp_path):
    rasters, arrays, _ = many
    part = found(collection.read(rasters, [1], rows=(2, 5), cols=(3, 60)))
    assert part == {k: v for k, v in plain(arrays, (0,)).items() if 2 <= k[1] < 5 and 3 <= k[2] < 60}
    # tiles of the large raster: 6 x 5 of 16 pixels; one run each
    asked = collection.runs(rasters.filter("raster_id = 'large'"), rows=(17, 40), cols=(0, 17), run_bytes=1)
    assert asked.count() == 2 * 2 and collection.runs(rasters.filter("raster_id = 'large'"), run_bytes=1).count() == 6 * 5
    # a file that no longer exists is not opened if it is not named, nor one outside the bounds decoded
    lost = rasters.union(spark.createDataFrame([("lost", str(tmp_path / "lost.tif"))], "raster_id string, path string"))
    assert collection.read(lost.filter("raster_id != 'lost'"), rows=(0, 1), cols=(0, 1)).count() == 1000
    with pytest.raises(PySparkException, match="raster lost"):
        collection.read(lost).count()
    assert collection.read(lost, rows=(0, 1), cols=(0, 1), unreadable="skip").count() == 1000
    # the ground from x = 7,060 on has one raster, that of number 7, whose third column begins there
    inside = found(collection.read(rasters, bounds=(7060.0, 4900.0, 7900.0, 5000.0)))
    assert inside == {k: v for k, v in plain(arrays).items() if k[0] == "r0007" and k[2] >= 2 and k[1] < 4}
    assert collection.read(rasters.limit(0)).count() == 0
    assert collection.read(rasters, rows=(500, 600)).count() == 0


def test_runs_are_bounded_and_small(spark, many):
    rasters, _, _ = many
    found = collection.runs(rasters.filter("raster_id = 'large'"), run_bytes=3 * 16 * 16 * 2 * 8).collect()
    assert len(found) == 10 and all(r["bytes"] == 3 * 16 * 16 * 2 * 8 and len(r["header"]) < 2000 for r in found)
    cube = collection.read(rasters.filter("raster_id = 'large'"), partition_bytes=16 * 16 * 2 * 8)
    assert cube.rdd.getNumPartitions() == 30
    sizes = cube.withColumn("p", F.spark_partition_id()).groupBy("p").count().agg(F.max("count")).first()[0]
    assert sizes <= 2 * 16 * 16


def test_rasters_without_pixels_and_pixels_without_rasters(spark, tmp_path):
    rasters = spark.createDataFrame([("a", str(tmp_path / "a.tif"), 20, 18, None, None), ("b", str(tmp_path / "b.tif"), 5, 5, None, None)], writer.RASTERS)
    a = np.full((1, 30, 30), 7.0)
    cube = frame(spark, {"a": a, "stray": a})
    writer.write_collection(cube, rasters, tiff.Raster(count=1, dtype="uint8", nodata=9.0), tiff.Layout(block=16))
    got = found(collection.read(rasters.select("raster_id", "path")))
    assert len(got) == 20 * 18 + 25 and all(v == ([7.0] if k[0] == "a" else [None]) for k, v in got.items())
    assert sorted(r["raster_id"] for r in collection.listed(spark, str(tmp_path)).collect()) == ["a.tif", "b.tif"]


def test_envi_files_are_in_collections(spark, tmp_path):
    a = np.arange(24, dtype="<i2").reshape(2, 3, 4)
    (tmp_path / "x.bsq").write_bytes(a.tobytes())
    (tmp_path / "x.hdr").write_text("ENVI\nsamples = 4\nlines = 3\nbands = 2\ndata type = 2\ninterleave = bsq\nbyte order = 0\n")
    got = found(collection.read(collection.listed(spark, str(tmp_path)), rows=(1, 3)))
    assert got == {("x.bsq", r, c): [float(a[0, r, c]), float(a[1, r, c])] for r in (1, 2) for c in range(4)}
