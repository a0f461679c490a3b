"""Outputs in a store that is not mounted: ``file:`` URIs that nobody takes for paths."""

import json

import numpy as np
import pytest

from cubeloom import errors, services
from cubeloom.plans import requests as rq
from cubeloom.sources import places, raster, sinks, tiff

PLACE = (30.0, 0.0, 500000.0, 0.0, -30.0, 5000000.0)


@pytest.fixture
def remote(monkeypatch, tmp_path):
    """A URI, and its folder; the driver takes it for a store elsewhere, and tasks stream to it."""
    kept = places.local_path
    monkeypatch.setattr(places, "local_path", lambda p: None if "/elsewhere" in p else kept(p))
    return (tmp_path / "elsewhere").as_uri(), tmp_path / "elsewhere"


@pytest.fixture
def scene(spark, tmp_path):
    a = np.random.default_rng(3).integers(50, 900, (4, 20, 25))
    rows = [(r, c, [float(v) for v in a[:, r, c]]) for r in range(20) for c in range(25)]
    tags = {i: {"wavelength": str(x), "wavelength_units": "nm"} for i, x in enumerate((490, 560, 665, 842), 1)}
    df = spark.createDataFrame(rows, "row int, col int, bands array<double>")
    return str(sinks.write_geotiff(df, tmp_path / "s.tif", tiff.Raster(width=25, height=20, count=4, dtype="uint16", nodata=0.0, transform=PLACE, epsg=32633, band_tags=tags), tiff.Layout(block=16))), a


def test_services_write_elsewhere(spark, scene, remote):
    (path, a), (uri, folder) = scene, remote
    index = services.calculate_index(spark, rq.IndexRequest(path, uri, index="ndvi", statistics=True))
    assert index["path"] == f"{uri}/s_ndvi.tif" and json.loads((folder / "s_ndvi_statistics.json").read_text())["statistics"]["valid_count"] == 500
    got = {(r["row"], r["col"]): r["bands"][0] for r in raster.read(spark, index["path"]).collect()}
    x, y = a[3, 4, 5], a[2, 4, 5]
    assert got[4, 5] == pytest.approx((x - y) / (x + y), rel=1e-6)
    mask = services.build_mask(spark, rq.MaskRequest(path, uri))
    assert sum(mask["counts"].values()) == 500
    profile = services.extract_profile(spark, rq.ProfileRequest(path, uri, row=3, col=4))
    assert json.loads((folder / "s_spectral_profile_r3_c4.json").read_text())["values"] == profile["values"] == [float(v) for v in a[:, 3, 4]]
    image = services.render_preview(spark, rq.PreviewRequest(path, uri, max_dimension=10))
    assert (folder / image["path"].rpartition("/")[2]).read_bytes()[:4] == b"\x89PNG"
    same = services.reproject(spark, rq.ReprojectRequest(path, uri, target_crs="EPSG:32633", resolution=30.0, resampling="nearest"))
    assert raster.header(same["path"]).width == 25
    # what is there is kept, unless overwriting is asked for; nothing but results is left
    with pytest.raises(errors.RasterWriteError):
        services.calculate_index(spark, rq.IndexRequest(path, uri, index="ndvi"))
    services.calculate_index(spark, rq.IndexRequest(path, uri, index="ndvi", overwrite=True))
    assert not [p.name for p in folder.iterdir() if p.name.startswith(".")]


def test_file_uris_are_paths(spark, scene, tmp_path):
    path, _ = scene
    done = services.calculate_index(spark, rq.IndexRequest(path, (tmp_path / "out").as_uri(), index="ndvi"))
    assert done["path"] == str(tmp_path / "out" / "s_ndvi.tif")


def test_a_store_that_nobody_knows():
    with pytest.raises(errors.OutputPathError):
        sinks.check_folder("nostore://a/b")


def test_names_below_a_uri(tmp_path):
    uri = places.Uri(tmp_path.as_uri() + "/")
    assert str(uri / "a" / "b.txt") == f"{tmp_path.as_uri()}/a/b.txt" and (uri / "b.txt").name == "b.txt"
    (uri / "b.txt").write(b"1")
    (uri / "b.txt").write(b"2")
    assert (tmp_path / "b.txt").read_bytes() == b"2" and (uri / "b.txt").exists()
    (uri / "b.txt").delete()
    assert not list(tmp_path.iterdir())
