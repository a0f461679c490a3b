"""Sources, sinks, services and the command line on small files."""

import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cubeloom import cli, errors, report, services
from cubeloom.operators import resample
from cubeloom.plans import requests as rq
from cubeloom.queries import toy_rpc
from cubeloom.sources import catalog, files, raster, sinks, tiff
from cubeloom.streaming import ingest

PLACE = (30.0, 0.0, 500000.0, 0.0, -30.0, 5000000.0)


def save(spark, path, array, dtype="uint16", nodata=0.0, layout=None, **header):
    b, h, w = array.shape
    rows = [(r, c, [None if nodata is not None and array[k, r, c] == nodata else float(array[k, r, c]) for k in range(b)]) for r in range(h) for c in range(w)]
    df = spark.createDataFrame(rows, "row int, col int, bands array<double>")
    return str(sinks.write_geotiff(df, path, tiff.Raster(width=w, height=h, count=b, dtype=dtype, nodata=nodata, **header), layout or tiff.Layout(block=16)))


def load(spark, path, **options):
    rows = raster.read(spark, path, **options).collect()
    return {(r["row"], r["col"]): r["bands"] for r in rows}


def tags(*nm):
    return {i: {"wavelength": str(x), "wavelength_units": "nm"} for i, x in enumerate(nm, 1)}


@pytest.fixture
def scene(spark, tmp_path):
    a = np.random.default_rng(3).integers(50, 900, (4, 20, 25))
    a[:, 0, 0] = 0
    a[:, 1, 1] = 65535
    a[:, 2, 2] = 5
    path = save(spark, tmp_path / "Scene-1.tif", a, transform=PLACE, epsg=32633, band_tags=tags(490, 560, 665, 842), tags={"SENSOR": "made"})
    return path, a


@pytest.mark.parametrize(("dtype", "compression", "nodata"), [("uint8", "deflate", 0.0), ("uint16", "zstd", 0.0), ("int16", "none", None), ("float32", "deflate", -9999.0), ("float64", "zstd", float("nan"))])
def test_round_trip(spark, tmp_path, dtype, compression, nodata):
    a = np.random.default_rng(4).integers(1, 200, (2, 21, 35)).astype(dtype)
    path = save(spark, tmp_path / "a.tif", a, dtype, nodata, tiff.Layout(compression, 16), transform=PLACE, epsg=32633, descriptions={2: "x & <y>"})
    h = raster.header(path)
    assert (h.width, h.height, h.count, h.dtype, h.transform, h.epsg, h.descriptions) == (35, 21, 2, dtype, PLACE, 32633, {2: "x & <y>"})
    assert h.nodata == nodata or (h.nodata != h.nodata and nodata != nodata)
    got = load(spark, path, bands=[2, 1, 2])
    assert all(got[r, c] == [a[1, r, c], a[0, r, c], a[1, r, c]] for r in range(21) for c in range(35))


def test_windows_masks_and_budget(spark, scene):
    path, a = scene
    got = load(spark, path, bands=[3], window=(5, 7, 10, 3))
    assert len(got) == 30 and got[7, 5] == [a[2, 7, 5]]
    assert load(spark, path)[0, 0] == [None] * 4
    assert all(np.isnan(load(spark, path, fill_nan=True)[0, 0]))
    for bad in ({"window": (20, 0, 10, 1)}, {"window": (-1, 0, 1, 1)}, {"bands": [5]}, {"bands": [0]}):
        with pytest.raises(errors.RasterReadError):
            raster.read(spark, path, **bad)
    with pytest.raises(errors.MemoryBudgetExceededError):
        raster.read(spark, path, max_bytes=100)
    assert raster.estimate(raster.header(path), 10, 10, 3) == 900


def test_a_crop_keeps_its_place(spark, scene, tmp_path):
    path, a = scene
    window = (5, 7, 10, 3)
    h = raster.window_header(raster.header(path), [3, 1], window)
    assert (h.width, h.height, h.count, h.epsg, h.nodata) == (10, 3, 2, 32633, 0.0)
    assert h.transform == (30.0, 0.0, 500000.0 + 5 * 30, 0.0, -30.0, 5000000.0 - 7 * 30)
    assert {i: t["wavelength"] for i, t in h.band_tags.items()} == {1: "665", 2: "490"} and h.tags["SENSOR"] == "made"
    moved = raster.read(spark, path, bands=[3, 1], window=window).withColumns({"row": F.col("row") - 7, "col": F.col("col") - 5})
    crop = str(sinks.write_geotiff(moved, tmp_path / "crop.tif", h, tiff.Layout(block=16)))
    assert raster.header(crop).transform == h.transform and load(spark, crop)[0, 0] == [a[2, 7, 5], a[0, 7, 5]]
    whole = raster.window_header(raster.header(path))
    assert whole.transform == PLACE and whole.count == 4


@pytest.mark.parametrize("shape", [(10, 8), (1, 1), (25, 20), (40, 3)])
def test_decimated_reads_take_the_nearest_pixels(spark, scene, shape):
    path, a = scene
    got = load(spark, path, bands=[2, 4], masked=False, out_shape=shape)
    rows, cols = (np.floor((np.arange(n) + 0.5) * size / n).astype(int) for n, size in ((shape[1], 20), (shape[0], 25)))
    assert got == {(i, j): [float(a[1, r, c]), float(a[3, r, c])] for i, r in enumerate(rows) for j, c in enumerate(cols)}
    part = load(spark, path, bands=[1], window=(5, 7, 10, 6), masked=False, out_shape=(2, 3))
    assert part == {(i, j): [float(a[0, 7 + r, 5 + c])] for i, r in enumerate((1, 3, 5)) for j, c in enumerate((2, 7))}
    if shape == (10, 8):
        whole = raster.read(spark, path, bands=[2, 4], masked=False)
        other = {(r["row"], r["col"]): r["bands"] for r in resample.decimate(whole, (25, 20), shape).collect()}
        assert got == other


def test_few_blocks_are_read_for_few_pixels(spark, scene):
    spark.dataSource.register(raster.CubeSource)
    reader = raster.CubeReader({"path": scene[0], "out_shape": "1,1", "partition_bytes": "1"})
    assert [p.tiles for p in reader.partitions()] == [((0, 0),)]
    with pytest.raises(errors.RasterReadError):
        raster.CubeReader({"path": scene[0], "out_shape": "0,3"})


def test_nodata_stays_a_number_without_a_mask(spark, scene):
    path, _ = scene
    assert load(spark, path)[0, 0] == [None] * 4 and load(spark, path, masked=False)[0, 0] == [0.0] * 4


def test_checksums_are_of_whole_files(spark, tmp_path):
    import hashlib

    data = bytes(range(256)) * 9000  # several pieces
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a b.bin").write_bytes(data)
    (tmp_path / "d" / "c.txt").write_bytes(b"x")
    got = {r["path"].rsplit("/", 1)[1]: (r["length"], r["sha256"]) for r in files.checksums(spark, str(tmp_path / "d")).collect()}
    assert got == {"a b.bin": (len(data), hashlib.sha256(data).hexdigest()), "c.txt": (1, hashlib.sha256(b"x").hexdigest())}


def test_tiles_go_to_shared_storage(spark, scene, tmp_path):
    from pathlib import Path
    from urllib.parse import urlparse

    shared = Path(urlparse(spark.conf.get("spark.checkpoint.dir")).path)
    assert not list(Path(scene[0]).parent.glob(".*")) and not list(shared.glob("tiles-*"))


def test_blocks_together_are_the_whole(spark, scene):
    path, a = scene
    reader = raster.CubeReader({"path": path, "partition_bytes": "1"})
    assert len(reader.partitions()) == 4
    seen = [x for p in reader.partitions() for b in reader.read(p) for x in b.to_pylist()]
    assert len(seen) == 500 and {(x["row"], x["col"]) for x in seen} == {(r, c) for r in range(20) for c in range(25)}


def _strip_tiff(a, order="<", compression=1, lzw=None):
    """A hand-made strip file of one uint16 band, two rows per strip."""
    h, w = a.shape
    strips = [a[i : i + 2].astype(order + "u2").tobytes() for i in range(0, h, 2)]
    if compression == 8:
        strips = [zlib.compress(s) for s in strips]
    if lzw:
        strips = [lzw(s) for s in strips]
    data, offsets = b"", []
    for s in strips:
        offsets.append(8 + len(data))
        data += s
    extra = 8 + len(data)
    more = struct.pack(f"{order}{len(strips)}I", *offsets) + struct.pack(f"{order}{len(strips)}I", *map(len, strips))
    entries = [(256, 4, 1, w), (257, 4, 1, h), (258, 3, 1, 16), (259, 3, 1, compression), (262, 3, 1, 1), (273, 4, len(strips), extra), (277, 3, 1, 1), (278, 4, 1, 2), (279, 4, len(strips), extra + 4 * len(strips))]
    ifd = extra + len(more)
    body = b"".join(struct.pack(order + "HHI", t, k, n) + (struct.pack(order + "HH", v, 0) if k == 3 else struct.pack(order + "I", v)) for t, k, n, v in entries)
    return (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, ifd) + data + more + struct.pack(order + "H", len(entries)) + body + struct.pack(order + "I", 0)


def _lzw(data):
    """Packs with a table that grows like the reader's."""
    bits, n, out, width = 0, 0, bytearray(), 9
    table = {bytes([i]): i for i in range(256)}

    def put(code):
        nonlocal bits, n
        bits, n = (bits << width) | code, n + width
        while n >= 8:
            n -= 8
            out.append((bits >> n) & 255)
            bits &= (1 << n) - 1

    put(256)
    following, word = 258, b""
    for byte in data:
        if word + bytes([byte]) in table:
            word += bytes([byte])
            continue
        put(table[word])
        table[word + bytes([byte])] = following
        following += 1
        if following == (1 << width) and width < 12:
            width += 1
        if following >= 4094:
            put(256)
            table, following, width = {bytes([i]): i for i in range(256)}, 258, 9
        word = bytes([byte])
    put(table[word])
    put(257)
    if n:
        out.append((bits << (8 - n)) & 255)
    return bytes(out)


@pytest.mark.parametrize(("order", "compression"), [("<", 1), (">", 1), ("<", 8), ("<", 5)])
def test_strips_of_either_byte_order(spark, tmp_path, order, compression):
    a = np.random.default_rng(5).integers(0, 60000, (5, 70))
    path = tmp_path / "s.tif"
    path.write_bytes(_strip_tiff(a, order, compression, _lzw if compression == 5 else None))
    got = load(spark, str(path), float32=False)
    assert all(got[r, c] == [a[r, c]] for r in range(5) for c in range(70))


@pytest.mark.parametrize("interleave", ["bsq", "bil", "bip"])
def test_envi(spark, tmp_path, interleave):
    a = np.random.default_rng(6).integers(0, 1000, (3, 4, 5)).astype(">u2")
    order = {"bsq": (0, 1, 2), "bil": (1, 0, 2), "bip": (1, 2, 0)}[interleave]
    (tmp_path / f"e.{interleave}").write_bytes(a.transpose(order).tobytes())
    (tmp_path / "e.hdr").write_text(f"ENVI\nsamples = 5\nlines = 4\nbands = 3\ndata type = 12\ninterleave = {interleave}\nbyte order = 1\nwavelength units = Nanometers\nwavelength = {{490, 560,\n 665}}\ndata ignore value = 7\n")
    got = load(spark, str(tmp_path / f"e.{interleave}"), bands=[3, 1])
    assert all(got[r, c] == [None if a[k, r, c] == 7 else a[k, r, c] for k in (2, 0)] for r in range(4) for c in range(5))
    _, found = catalog.inspect(spark, {"e": str(tmp_path / "e.hdr")})
    assert [r["wavelength_nm"] for r in found.orderBy("band").collect()] == [490.0, 560.0, 665.0]


def test_writes_are_atomic(spark, tmp_path):
    df = spark.createDataFrame([(0, 0, [None])], "row int, col int, bands array<double>")
    header = tiff.Raster(width=1, height=1, count=1, dtype="uint8")
    with pytest.raises(Exception, match="NoData"):
        sinks.write_geotiff(df, tmp_path / "x.tif", header)
    assert list(tmp_path.iterdir()) == []
    (tmp_path / "y.tif").write_bytes(b"old")
    with pytest.raises(errors.RasterWriteError):
        sinks.write_geotiff(df, tmp_path / "y.tif", header)
    assert (tmp_path / "y.tif").read_bytes() == b"old"
    with pytest.raises(errors.RasterWriteError):
        sinks.check_target(tmp_path / "none" / "x.tif")


def test_unreadable_and_unsupported(spark, tmp_path):
    (tmp_path / "a.tif").write_bytes(b"no tiff at all")
    with pytest.raises(errors.RasterReadError):
        raster.header(str(tmp_path / "a.tif"))
    with pytest.raises(errors.UnsupportedError):
        raster.header(str(tmp_path / "a.jp2"))
    with pytest.raises(errors.RasterReadError):
        raster.header(str(tmp_path / "missing.tif"))


def test_product_folder(spark, tmp_path, scene):
    path, _ = scene
    folder = tmp_path / "p" / "deep"
    folder.mkdir(parents=True)
    for n in ("X-SPECTRAL_IMAGE.TIF", "X-QL.TIF"):
        (folder / n).write_bytes(open(path, "rb").read())
    (folder / "X-METADATA.XML").write_text("<a/>")
    listed = files.inventory(spark, str(tmp_path / "p"))
    assert {r["kind"]: r["count"] for r in listed.groupBy("kind").count().collect()} == {"raster": 2, "metadata": 1}
    assert services.resolve_path(spark, str(tmp_path / "p")).endswith("X-SPECTRAL_IMAGE.TIF")
    (folder / "X-SPECTRAL_IMAGE.TIF").unlink()
    (folder / "Y.TIF").write_bytes(b"x")
    with pytest.raises(errors.ProductStructureError):
        services.resolve_path(spark, str(tmp_path / "p"))


def test_index_mask_profile_and_preview(spark, tmp_path, scene):
    path, a = scene
    out = str(tmp_path / "out")
    found = services.calculate_index(spark, rq.IndexRequest(path, out, statistics=True, tolerance_nm=15))
    assert found["band_indices"] == [4, 3] and found["path"].endswith("scene_1_ndvi.tif")
    got = load(spark, found["path"])
    nir, red = a[3, 5, 6], a[2, 5, 6]
    assert got[5, 6] == [np.float32((nir - red) / (nir + red))] and got[0, 0] == [None]
    assert found["statistics"]["valid_count"] == 499 and json.loads(open(found["statistics_path"]).read())["index"] == "ndvi"
    with pytest.raises(errors.RasterWriteError):
        services.calculate_index(spark, rq.IndexRequest(path, out))
    mask = services.build_mask(spark, rq.MaskRequest(path, out, statistics=True))
    assert mask["counts"]["no_data"] == 1 and mask["counts"]["saturated"] == 8 - 1 and mask["counts"]["low_signal"] >= 5
    plain = services.build_mask(spark, rq.MaskRequest(path, out, morphology=rq.Morphology(enabled=False), overwrite=True))
    assert (plain["counts"]["saturated"], plain["counts"]["low_signal"], plain["counts"]["valid"]) == (1, 1, 497)
    profile = services.extract_profile(spark, rq.ProfileRequest(path, out, row=0, col=1, window_size=3))
    near = a[:, 0:2, 0:3].reshape(4, -1).astype(float)
    assert profile["values"] == pytest.approx([np.mean(b[b != 0]) for b in near])
    assert open(profile["csv_path"]).readline().strip() == "band_index,wavelength_nm,value"
    image = services.render_preview(spark, rq.PreviewRequest(path, out, max_dimension=10, blur_kernel=3))
    assert (image["width"], image["height"], image["band_indices"]) == (10, 8, [3, 2, 1])
    assert open(image["path"], "rb").read(8) == b"\x89PNG\r\n\x1a\n"


def test_reproject(spark, tmp_path, scene):
    path, a = scene
    out = str(tmp_path / "out")
    same = services.reproject(spark, rq.ReprojectRequest(path, out, target_crs="EPSG:32633", resolution=30.0, resampling="nearest", bands=(1,)))
    assert (same["width"], same["height"]) == (25, 20)
    got = load(spark, same["path"])
    assert all(got[r, c] == [None if a[0, r, c] == 0 else a[0, r, c]] for r in range(20) for c in range(25))
    degrees = services.reproject(spark, rq.ReprojectRequest(path, out, target_crs="4326", bands=(1,)))
    assert raster.header(degrees["path"]).epsg == 4326
    back = services.reproject(spark, rq.ReprojectRequest(degrees["path"], out, target_crs="auto", resolution=30.0, reference_raster=path))
    assert "aligned_epsg32633_30m" in back["path"] and raster.header(back["path"]).transform[2] % 30 == 500000 % 30
    plain = save(spark, tmp_path / "plain.tif", a[:1])
    with pytest.raises(errors.MissingGeoreferencingError):
        services.reproject(spark, rq.ReprojectRequest(plain, out))


def test_orthorectify(spark, tmp_path):
    out = str(tmp_path / "out")
    rpc = toy_rpc() | {"err_bias": 0.0, "err_rand": 0.0}
    a = np.full((2, 20, 25), 100)
    path = save(spark, tmp_path / "raw.tif", a, rpc=rpc, band_tags=tags(560, 665))
    dem = save(spark, tmp_path / "dem.tif", np.full((1, 40, 40), 300.0), "float32", -32768.0, transform=(0.005, 0, 9.9, 0, -0.005, 45.1), epsg=4326, geographic=True)
    found = services.orthorectify(spark, rq.OrthoRequest(path, out, dem=dem, resolution=300.0, resampling="nearest"))
    assert found["crs"] == "EPSG:32632" and "_ortho_epsg32632_300m" in found["path"]
    values = [v for v in load(spark, found["path"]).values() if v[0] is not None]
    assert len(values) > 500 and all(v == [100.0, 100.0] for v in values)
    far = save(spark, tmp_path / "far.tif", np.full((1, 4, 4), 300.0), "float32", None, transform=(0.005, 0, 50.0, 0, -0.005, 5.0), epsg=4326, geographic=True)
    with pytest.raises(errors.UnreadableDEMError):
        services.orthorectify(spark, rq.OrthoRequest(path, out, dem=far))
    with pytest.raises(errors.MissingDEMError):
        services.orthorectify(spark, rq.OrthoRequest(path, out, dem=str(tmp_path / "no.tif")))
    with pytest.raises(errors.MissingRPCMetadataError):
        services.orthorectify(spark, rq.OrthoRequest(dem, out, dem=dem))


def test_rpc_rules():
    assert tiff.rpc_issues(toy_rpc()) == []
    assert tiff.rpc_issues(toy_rpc() | {"line_scale": 0.0}) == ["line_scale is zero"]
    assert tiff.rpc_issues(toy_rpc() | {"samp_den": [0.0] * 20}) == ["samp_den is all zero"]
    text = {k: str(v) for k, v in toy_rpc().items() if not isinstance(v, list)} | {f"{k}_coeff": "1 2" for k in ("line_num", "line_den", "samp_num", "samp_den")}
    assert tiff._rpc_from_text(text)["line_num"] == [1.0, 2.0] + [0.0] * 18
    assert tiff._rpc_from_text({k: v for k, v in text.items() if k != "lat_off"}) is None


@pytest.mark.parametrize(
    ("kind", "values"),
    [
        (rq.IndexRequest, {"index": "evi"}), (rq.IndexRequest, {"bands": (1,)}), (rq.IndexRequest, {"red_nm": 0}), (rq.IndexRequest, {"sample_step": 0}), (rq.IndexRequest, {"what": 1}), (rq.PreviewRequest, {"composite": "band"}),
        (rq.PreviewRequest, {"bands": (1, 2)}), (rq.PreviewRequest, {"lower_percentile": 50, "upper_percentile": 40}), (rq.PreviewRequest, {"blur_kernel": 4}), (rq.PreviewRequest, {"product_id": "  "}), (rq.ProfileRequest, {"row": -1}),
        (rq.ProfileRequest, {"window_size": 2}), (rq.MaskRequest, {"low_signal_dn": 70000}), (rq.MaskRequest, {"band_fraction": 0}), (rq.MaskRequest, {"evaluation_wavelengths_nm": (-1.0,)}), (rq.ReprojectRequest, {"resolution": 0}),
        (rq.ReprojectRequest, {"target_crs": " "}), (rq.OrthoRequest, {}), (rq.ValidationRequest, {"bands": (1, 1)}), (rq.ValidationRequest, {"max_uncompressed_gb": 0}), (rq.ValidationRequest, {"wavelengths_nm": (500.0, 400.0)}),
    ],
)
def test_request_rules(kind, values):
    with pytest.raises(errors.ConfigurationError) as e:
        rq.build(kind, input="x", **values)
    assert e.value.exit_code == 3


def test_categorical_forces_nearest():
    assert rq.ReprojectRequest("x", data_semantics="categorical", resampling="cubic").resampling == "nearest"
    assert rq.ValidationRequest("x", bands=(3, 1)).bands == (1, 3)


def test_validation_and_inspection(spark, tmp_path, scene):
    path, _ = scene
    found = report.validate(spark, rq.ValidationRequest(path, bands=(1, 9)))
    by = {r["name"]: r["status"] for r in found["checks"]}
    assert by["band_subset"] == "failed" and by["rpc_metadata"] == "skipped" and by["georeferencing"] == "passed" and not found["is_valid"]
    with pytest.raises(errors.ProductError):
        report.raise_if_invalid(found)
    assert report.validate(spark, rq.ValidationRequest(path))["is_valid"]
    assert not report.validate(spark, rq.ValidationRequest(path, require_rpc=True))["is_valid"]
    assert report.validate(spark, rq.ValidationRequest(str(tmp_path / "no")))["blocking"] == ["product_structure"]
    info = report.inspect(spark, path, checksum=True)
    assert len(info["sha256"]) == 64 and info["raster"]["band_count"] == 4
    text = report.inspection_text(info, 2)
    assert "EPSG:32633" in text and "... 2 more bands" in text


def test_command_line(spark, tmp_path, scene, capsys):
    path, _ = scene
    go = lambda *a: cli.run(a, lambda: spark)
    assert go("version", "--json") == 0 and json.loads(capsys.readouterr().out)["projections"] == "ok"
    assert go("inspect", "-i", path) == 0
    capsys.readouterr()
    assert go("calculate-index", "-i", path, "-o", str(tmp_path / "o"), "--index", "ndwi", "--json") == 0
    assert json.loads(capsys.readouterr().out)["band_indices"] == [2, 4]
    assert go("calculate-index", "-i", path, "-o", str(tmp_path / "o"), "--index", "evi") == 3
    assert go("calculate-index", "-i", path, "-o", str(tmp_path / "o"), "--index", "ndwi") == 5
    assert go("spectral-profile", "-i", path, "-o", str(tmp_path / "o"), "--row", "99", "--col", "0") == 6
    assert go("inspect", "-i", str(tmp_path / "none.tif")) == 4
    assert go("validate", "-i", path, "--require-rpc") == 4
    assert go("quality-mask", "-i", path, "-o", str(tmp_path / "o"), "--evaluation-wavelengths-nm", "", "--no-morphology") == 0


def test_streaming_ingest(spark, tmp_path, scene):
    path, _ = scene
    arriving = tmp_path / "arriving"
    arriving.mkdir()
    (arriving / "a.tif").write_bytes(open(path, "rb").read())
    seen = []
    for _ in range(2):  # the second run finds nothing new
        ingest.watch(spark, arriving.as_uri(), str(tmp_path / "state"), lambda r, b: seen.append((r.count(), b.count())), once=True).awaitTermination(120)
    assert seen == [(1, 4)]


def test_parquet_tiles(spark, tmp_path, scene):
    path, _ = scene
    sinks.write_tiles(raster.read(spark, path), str(tmp_path / "tiles"), 16)
    back = spark.read.parquet(str(tmp_path / "tiles"))
    assert back.count() == 500 and back.filter((F.col("row") < 3) & (F.col("col") < 3)).count() == 9
