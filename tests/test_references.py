"""Rasters that others are aligned to, units of coordinates, roles of files, and what is only warned of."""

import logging

import numpy as np
import pytest

from cubeloom import errors, services
from cubeloom.operators import bands, resample
from cubeloom.plans import requests as rq
from cubeloom.sources import catalog, files, sinks, tiff

PLACE = (30.0, 0.0, 500000.0, 0.0, -30.0, 5000000.0)


@pytest.fixture
def make(spark, tmp_path):
    def write(name, place=PLACE, epsg=32633, size=8, **header):
        a = np.random.default_rng(1).integers(1, 900, (1, size, size))
        rows = [(r, c, [float(a[0, r, c])]) for r in range(size) for c in range(size)]
        df = spark.createDataFrame(rows, "row int, col int, bands array<double>")
        return str(sinks.write_geotiff(df, tmp_path / name, tiff.Raster(width=size, height=size, count=1, dtype="uint16", nodata=0.0, transform=place, epsg=epsg, **header), tiff.Layout(block=16)))

    return write


@pytest.mark.parametrize(("place", "epsg", "target", "error", "code"), [
    (PLACE, 2056, "auto", errors.UnsupportedError, 9), (PLACE, 31467, "auto", errors.UnsupportedError, 9), (PLACE, 28359, "auto", errors.UnsupportedError, 9),
    (PLACE, 28355, "auto", errors.ReprojectionError, 6),
    ((1.0, 0.0, 0.0, 0.0, 1.0, 0.0), None, "auto", errors.ReprojectionError, 6), (PLACE, 32633, "EPSG:32634", errors.ReprojectionError, 6),
    ((30.0, 0.0, 900000.0, 0.0, -30.0, 1000.0), 32633, "auto", errors.ReprojectionError, 6),
])
def test_references_that_cannot_be_used(spark, make, tmp_path, place, epsg, target, error, code):
    source, reference = make("source.tif"), make("reference.tif", place, epsg)
    with pytest.raises(error) as raised:
        services.reproject(spark, rq.ReprojectRequest(source, str(tmp_path / "out"), target_crs=target, reference_raster=reference))
    assert raised.value.exit_code == code


def test_a_reference_that_is_not_there(spark, make, tmp_path):
    with pytest.raises(errors.ReprojectionError):
        services.reproject(spark, rq.ReprojectRequest(make("source.tif"), str(tmp_path / "out"), target_crs="auto", reference_raster=str(tmp_path / "no.tif")))


def test_the_reference_s_own_projection_may_be_named(spark, make, tmp_path, caplog):
    source, reference = make("source.tif"), make("reference.tif", (60.0, 0.0, 500010.0, 0.0, -40.0, 5000010.0))
    with caplog.at_level(logging.WARNING, "cubeloom"):
        done = services.reproject(spark, rq.ReprojectRequest(source, str(tmp_path / "out"), target_crs="EPSG:32633", reference_raster=reference))
    assert done["resolution"] == 60.0 and any("X and Y differ" in r.message for r in caplog.records)


def test_a_sensor_model_that_is_left_behind_is_told(spark, make, tmp_path, caplog):
    from cubeloom.queries import toy_rpc

    source = make("scene.tif", rpc=toy_rpc(), band_tags={1: {"wavelength": "665", "wavelength_units": "nm"}})
    with caplog.at_level(logging.WARNING, "cubeloom"):
        services.calculate_index(spark, rq.IndexRequest(source, str(tmp_path / "out"), index="ndvi", bands=(1, 1)))
    assert any("sensor model" in r.message for r in caplog.records)


def test_units_of_projected_coordinates(make, spark):
    paths = {"utm": make("u.tif"), "web": make("w.tif", epsg=3857), "degrees": make("d.tif", epsg=4326, geographic=True), "other": make("o.tif", epsg=2056)}
    got = {r["raster_id"]: (r["linear_units"], r["linear_units_factor"], r["crs_wkt"] is not None) for r in catalog.inspect(spark, paths)[0].collect()}
    assert got == {"utm": ("metre", 1.0, True), "web": ("metre", 1.0, True), "degrees": (None, None, True), "other": (None, None, False)}
    r = tiff.Raster(width=1, height=1)
    tiff._place(r, {34735: (1, 1, 0, 3, 1024, 0, 1, 1, 3072, 0, 1, 2056, 3076, 0, 1, 9002)})
    assert (r.epsg, r.unit) == (2056, 9002) and catalog.UNITS[9002] == ("foot", 0.3048)


def test_roles_of_files(spark, tmp_path):
    for name in ("a.tif", "b.rpc", "c.gfs", "d.imd", "e.rpb", "f.XML", "g.hdr", "h"):
        (tmp_path / name).write_text("x")
    got = {r["name"]: r["kind"] for r in files.inventory(spark, str(tmp_path)).collect()}
    assert got == {"a.tif": "raster", "b.rpc": "metadata", "c.gfs": "metadata", "d.imd": "other", "e.rpb": "other", "f.XML": "metadata", "g.hdr": "metadata", "h": "other"}


def test_strong_enlargement_takes_small_tiles(spark):
    assert resample.tile_size(1) == 256 and resample.tile_size(4, enlarged=10_000.0) == 8 and resample.tile_size(300, enlarged=1e9) == 4
    rng = np.random.default_rng(2)
    a = rng.random((1, 9, 9))
    rows = [(r, c, [float(a[0, r, c])]) for r in range(9) for c in range(9)]
    cube = spark.createDataFrame(rows, "row int, col int, bands array<double>")
    places = resample.scale_places(resample.target_grid(spark, 90, 90), (9, 9), (90, 90))
    small = {(r["row"], r["col"]): r["bands"] for r in resample.warp_tiles(places, cube, 1, "cubic", 9, 9, 4).collect()}
    whole = {(r["row"], r["col"]): r["bands"] for r in resample.warp_tiles(places, cube, 1, "cubic", 9, 9).collect()}
    assert small.keys() == whole.keys() and all(np.allclose(small[k], whole[k]) for k in whole)


def test_nearest_band_without_a_usable_band(spark):
    asked = bands.target_table(spark, (500.0, 600.0))
    got = bands.nearest(asked, bands.band_table(spark, (None, float("nan"), -1.0))).collect()
    assert [(r["band"], r["matched"]) for r in got] == [(None, False)] * 2
    tie = bands.nearest(asked, bands.band_table(spark, (610.0, 490.0, 510.0, 590.0))).orderBy("pos").collect()
    assert [(r["band"], r["distance_nm"], r["matched"]) for r in tie] == [(2, 10.0, True), (1, 10.0, True)]
