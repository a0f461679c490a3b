"""Operators on small arrays, against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cubeloom.functions import geo, pixels, text
from cubeloom.operators import bands, cube, ortho, quality, resample, stats
from cubeloom.plans import grids

NAN, INF = float("nan"), float("inf")


def wide(spark, array):
    """(bands, rows, cols) of floats and None."""
    b, h, w = len(array), len(array[0]), len(array[0][0])
    rows = [(r, c, [None if array[k][r][c] is None else float(array[k][r][c]) for k in range(b)]) for r in range(h) for c in range(w)]
    return spark.createDataFrame(rows, "row int, col int, bands array<double>")


def grid(df, column, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r["row"], r["col"]] = np.nan if r[column] is None else r[column]
    return out


@pytest.mark.parametrize(("a", "b", "expected"), [(0.8, 0.2, 0.6), (0.4, 0.4, 0.0), (1.0, -1.0, -9999.0), (None, 1.0, -9999.0), (NAN, 1.0, -9999.0), (INF, 1.0, -9999.0), (0.0, 0.0, -9999.0)])
def test_normalised_difference(spark, a, b, expected):
    df = spark.createDataFrame([(a, b)], "a double, b double")
    assert df.select(pixels.normalised_difference(F.col("a"), F.col("b"))).first()[0] == np.float32(expected)


def test_quality_precedence(spark):
    cases = {
        "no_data": ([None, None, NAN and None, None], 0),
        "invalid_before_saturated": ([NAN, 70000, 70000, 70000], 4),
        "saturated_before_low": ([70000, 70000, 5, 5], 2),
        "low": ([5, 5, 100, 100], 3),
        "valid": ([100, 100, 100, 5], 1),
        "share_of_valid_bands": ([70000, 100, None, None], 2),
        "infinite": ([INF, 1, 100, 100], 4),
    }
    rows = [(n, [None if v is None else float(v) for v in b]) for n, (b, _) in cases.items()]
    df = spark.createDataFrame(rows, "name string, bands array<double>").select("name", pixels.quality_class(F.col("bands")).alias("c"))
    assert {r["name"]: r["c"] for r in df.collect()} == {n: c for n, (_, c) in cases.items()}


def test_all_nan_pixel_is_no_data(spark):
    df = spark.createDataFrame([([NAN, NAN],)], "bands array<double>")
    assert df.select(pixels.quality_class(F.col("bands"))).first()[0] == pixels.NO_DATA


def test_anomaly_needs_a_positive_mean(spark):
    df = spark.createDataFrame([([100.0, 100.0, 100.0],), ([11.0, 11.0, 100.0],), ([-1.0, -5.0, -9.0],)], "bands array<double>")
    got = [r[0] for r in df.select(pixels.quality_class(F.col("bands"), low_signal=-100, anomaly=True, cv_threshold=0.5)).collect()]
    assert got == [1, 5, 1]


def test_statistics_skip_what_is_not_usable(spark):
    values = [(1, float(v)) for v in range(1, 11)] + [(1, None), (1, NAN), (1, INF), (1, -9999.0), (2, None)]
    df = spark.createDataFrame(values, "band int, value double")
    got = {r["band"]: r for r in stats.summarise(df, nodata=-9999.0).collect()}
    x = np.arange(1, 11)
    assert (got[1]["count"], got[1]["min"], got[1]["max"], got[1]["mean"]) == (10, 1, 10, 5.5)
    assert np.allclose([got[1]["std"], got[1]["p2"], got[1]["p98"]], [x.std(), *np.percentile(x, [2, 98])])
    assert got[2]["count"] == 0 and got[2]["min"] is None and got[2]["p2"] is None


@pytest.mark.parametrize("seed", range(3))
def test_exact_percentiles_are_exact(spark, seed):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=500), 1) if seed else np.full(50, 3.0)
    df = spark.createDataFrame([(1, float(v)) for v in x], "band int, value double")
    got = {r["q"]: r["value"] for r in stats.exact_percentiles(df, percentiles=(0.0, 0.02, 0.5, 0.98, 1.0), cells=16).collect()}
    assert np.allclose([got[q] for q in sorted(got)], np.percentile(x, [0, 2, 50, 98, 100]))


def test_profile_of_a_clipped_window(spark):
    a = np.ones((1, 3, 3)).tolist()
    a[0][1][1], a[0][0][0] = 10, None
    got = stats.profile(wide(spark, a), 1, 1, 3).first()
    assert got["value"] == 17 / 8 and got["n"] == 8
    assert stats.profile(wide(spark, a), 0, 0, 1).first()["value"] is None
    with pytest.raises(ValueError):
        stats.profile(wide(spark, a), 0, 0, 2)


def test_nearest_band_ties_and_tolerance(spark):
    table = bands.band_table(spark, [None, 500.0, 520.0, NAN, -3.0, 900.0])
    got = bands.nearest(bands.target_table(spark, [510.0, 700.0]), table, 20).orderBy("pos").collect()
    assert (got[0]["band"], got[0]["matched"]) == (2, True)
    assert not got[1]["matched"]
    nothing = bands.nearest(bands.target_table(spark, [510.0]), bands.band_table(spark, [None]), 20).collect()
    assert len(nothing) == 1 and nothing[0]["band"] is None and not nothing[0]["matched"]
    for bad in ([], [0.0], [NAN]):
        with pytest.raises(ValueError):
            bands.target_table(spark, bad)


def _morph(classes, op, offsets):
    """Independent model: paint from the original mask, only on valid pixels."""
    h, w = classes.shape
    out = classes.copy()
    for code in (4, 2, 3, 5):
        hit = classes == code
        grown = np.zeros_like(hit)
        for y, x in zip(*np.nonzero(hit), strict=True):
            for dy, dx in offsets:
                if 0 <= y + dy < h and 0 <= x + dx < w:
                    grown[y + dy, x + dx] = True
        if op == "close":
            closed = np.zeros_like(hit)
            for y in range(h):
                for x in range(w):
                    closed[y, x] = all(grown[y + dy, x + dx] for dy, dx in offsets if 0 <= y + dy < h and 0 <= x + dx < w)
            grown = closed
        out[grown & (out == 1)] = code
    return out


@pytest.mark.parametrize(("op", "shape", "size", "times"), [("dilate", "rect", 3, 1), ("dilate", "cross", 3, 2), ("close", "rect", 3, 1), ("close", "cross", 5, 1), ("dilate", "ellipse", 5, 1)])
def test_growth_matches_a_model(spark, op, shape, size, times):
    rng = np.random.default_rng(size + times)
    classes = rng.choice([0, 1, 2, 3, 4, 5], p=[0.1, 0.7, 0.05, 0.05, 0.05, 0.05], size=(9, 11))
    rows = [(r, c, int(classes[r, c])) for r in range(9) for c in range(11)]
    df = spark.createDataFrame(rows, "row int, col int, class smallint")
    got = grid(quality.grow(df, op, shape, size, times), "class", classes.shape)
    assert (got == _morph(classes, op, quality.kernel(shape, size, times))).all()


def test_no_data_does_not_grow_and_opening_changes_nothing(spark):
    df = spark.createDataFrame([(0, 0, 0), (0, 1, 1), (0, 2, 1)], "row int, col int, class smallint")
    for op in ("dilate", "open", "erode", "close"):
        assert sorted(tuple(r) for r in quality.grow(df, op).collect()) == [(0, 0, 0), (0, 1, 1), (0, 2, 1)]


def test_class_counts_fill_zeros_and_name_strangers(spark):
    df = spark.createDataFrame([(1,), (1,), (77,)], "class smallint")
    got = {r["name"]: (r["count"], round(r["percentage"], 3)) for r in quality.class_counts(df).collect()}
    assert got["valid"] == (2, 66.667) and got["saturated"] == (0, 0.0) and got["unknown_77"] == (1, 33.333) and len(got) == 8
    assert sum(r["count"] for r in quality.class_counts(df.limit(0)).collect()) == 0


@pytest.mark.parametrize("method", ["nearest", "bilinear", "cubic"])
def test_identity_warp_changes_nothing(spark, method):
    a = np.random.default_rng(1).normal(size=(2, 4, 5))
    long = cube.to_long(wide(spark, a.tolist()))
    places = resample.scale_places(resample.target_grid(spark, 5, 4), (5, 4), (5, 4))
    for r in resample.warp(places, long, method, 5, 4).collect():
        assert r["value"] == pytest.approx(a[r["band"] - 1, r["out_row"], r["out_col"]])


def test_bilinear_keeps_a_ramp_and_drops_missing_taps(spark):
    ramp = [[[r * 10 + c for c in range(6)] for r in range(6)]]
    long = cube.to_long(wide(spark, ramp))
    places = spark.createDataFrame([(0, 0, 2.5, 1.25), (0, 1, 1.0, 3.75)], "out_row int, out_col int, y double, x double")
    assert sorted(r["value"] for r in resample.warp(places, long, "bilinear", 6, 6).collect()) == pytest.approx([13.75, 26.25])
    ramp[0][2][1] = None
    one = resample.warp(places.filter("out_col = 0"), cube.to_long(wide(spark, ramp)), "bilinear", 6, 6).first()["value"]
    assert one == pytest.approx((31 * 0.375 + 22 * 0.125 + 32 * 0.125) / 0.625)


def test_window_commutes_with_everything_narrow(spark):
    a = np.random.default_rng(2).normal(size=(2, 6, 6)).tolist()
    df = wide(spark, a)
    one = quality.classify(cube.window(df, 1, 2, 3, 3), saturation=0.5, low_signal=-0.5)
    two = cube.window(quality.classify(df, saturation=0.5, low_signal=-0.5), 1, 2, 3, 3)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))


def test_mask_of_another_shape_fails(spark):
    df = wide(spark, [[[1, 2]]])
    with pytest.raises(Exception, match="differ in shape"):
        cube.with_mask(df, df.filter("col = 0").select("row", "col", F.lit(True).alias("masked"))).collect()


def test_stretch(spark):
    a = [np.arange(100).reshape(10, 10).tolist()]
    got = [r["image"][0] for r in resample.composite(wide(spark, a), [1]).collect()]
    assert min(got) == 0 and max(got) == 255
    flat = [r["image"][0] for r in resample.composite(wide(spark, [[[7, 7], [7, None]]]), [1]).collect()]
    assert flat == [0, 0, 0, 0]


def test_utm_agrees_between_columns_and_driver(spark):
    rows = [(10.0, 45.0), (8.5, -33.0), (11.9, 80.0)]
    df = spark.createDataFrame(rows, "lon double, lat double")
    e, n = geo.utm_forward(F.col("lon"), F.col("lat"), 32632)
    for r, (lon, lat) in zip(df.select(e.alias("e"), n.alias("n")).collect(), rows, strict=True):
        assert (r["e"], r["n"]) == pytest.approx(grids.from_degrees(32632, lon, lat), abs=1e-6)
        assert grids.to_degrees(32632, r["e"], r["n"]) == pytest.approx((lon, lat), abs=1e-9)
    assert grids.from_degrees(32632, 10.0, 45.0) == pytest.approx((578815.303, 4983436.768), abs=1e-3)


def test_grids():
    assert grids.resolve_target("auto", 4326, (10.0, 45.0, 10.1, 45.1)) == 32632
    snapped = grids.output_grid(32633, 32633, (500007.0, 4999000.0, 500247.0, 4999180.0), (8, 6), 30.0, True)
    assert snapped.transform[2] % 30 == 0 and snapped.transform[5] % 30 == 0
    aligned = grids.reference_grid(32633, (60.0, 0, 500000.0, 0, -60.0, 5001000.0), (500015.0, 4999835.0, 500255.0, 5000015.0))
    assert aligned.transform[2] == 500000.0 and (5001000.0 - aligned.transform[5]) % 60 == 0
    assert grids.preview_size(120, 80, 40) == (40, 27) and grids.preview_size(10, 8, 40) == (10, 8)
    assert grids.resolution_token(30.0) == "30m" and grids.resolution_token(0.5) == "0p5m"
    assert grids.product_slug("/a/SCENE-L1B (x).TIF") == "scene_l1b_x" and grids.product_slug("...") == "product"


def test_rpc_footprint_and_toy_model(spark):
    from cubeloom.queries import toy_rpc

    assert ortho.footprint(toy_rpc()) == pytest.approx((9.95, 44.95, 10.05, 45.05))
    df = spark.createDataFrame([(10.0, 45.0, 300.0), (10.05, 45.05, 0.0)], "lon double, lat double, h double")
    line, sample = geo.rpc_project(toy_rpc(), F.col("lon"), F.col("lat"), F.col("h"))
    assert [tuple(np.round(r, 9)) for r in df.select(line, sample).collect()] == [(9.5, 12.0), (19.0, 24.0)]


@pytest.mark.parametrize(("source", "target"), [((25, 20), (10, 8)), ((7, 5), (3, 2)), ((4, 3), (9, 7)), ((6, 6), (6, 6)), ((1, 1), (1, 1))])
def test_decimation_takes_the_nearest_pixel(spark, source, target):
    a = np.arange(source[0] * source[1]).reshape(1, source[1], source[0])
    got = {(r["row"], r["col"]): r["bands"][0] for r in resample.decimate(wide(spark, a.tolist()), source, target).collect()}
    want = {(i, j): a[0, int((i + 0.5) * (source[1] / target[1])), int((j + 0.5) * (source[0] / target[0]))] for i in range(target[1]) for j in range(target[0])}
    assert got == want


@pytest.mark.parametrize("method", ["nearest", "bilinear", "cubic"])
def test_warp_by_tiles_is_the_warp_by_taps(spark, method):
    rng = np.random.default_rng(9)
    a = rng.normal(size=(2, 40, 37)).astype(object)
    for k, r, c in zip(rng.integers(0, 2, 60), rng.integers(0, 40, 60), rng.integers(0, 37, 60), strict=True):
        a[k, r, c] = rng.choice([None, NAN])
    df = wide(spark, a.tolist())
    places = resample.scale_places(resample.target_grid(spark, 50, 31), (37, 40), (50, 31))
    taps = {(r["out_row"], r["out_col"], r["band"]): r["value"] for r in resample.warp(places, cube.to_long(df), method, 37, 40).collect()}
    tiles = {(r["row"], r["col"], k): v for r in resample.warp_tiles(places, df, 2, method, 37, 40, 16).collect() for k, v in enumerate(r["bands"], 1)}
    assert len(tiles) == 2 * 50 * 31
    for key, value in tiles.items():
        assert (value is None and taps.get(key) is None) or value == pytest.approx(taps[key])


def test_tags_in_any_case_and_the_last_of_them_counts(spark):
    rows = [
        (2, {"wavelength": "0.6", "wavelength_units": "", "Wavelength_Unit": "um"}, None, None),
        (3, {"wavelength": " "}, {"central_wavelength_um": "", "CENTRAL_WAVELENGTH_UM": "0.56"}, "490 nm"),
        (4, {}, {}, "490 nm"),
        (5, None, None, None),
    ]
    schema = "id int, tags map<string,string>, imagery map<string,string>, description string"
    ordered = spark.range(1).select(F.lit(1).alias("id"), F.expr("map('WAVELENGTH', '1', 'wavelength', '842')").alias("tags"), F.lit(None).alias("imagery"), F.lit(None).alias("description"))
    df = spark.createDataFrame(rows, schema).union(ordered)
    got = {r["id"]: tuple(r["w"]) for r in df.select("id", text.wavelength_nm(F.col("tags"), F.col("imagery"), F.col("description")).alias("w")).collect()}
    assert got == {1: (842.0, "band_tag"), 2: (600.0, "band_tag"), 3: (560.0, "imagery_domain"), 4: (490.0, "description"), 5: (None, None)}


def test_statistics_keep_no_value_lists(spark):
    df = spark.createDataFrame([(1, float(v)) for v in range(1, 11)] + [(2, float("nan")), (3, 5.0), (4, None)], "band int, value double")
    found = stats.summarise(df)
    assert "percentile" not in found._jdf.queryExecution().toString().lower()
    got = {r["band"]: r for r in found.collect()}
    assert (got[1]["count"], got[1]["min"], got[1]["max"], got[1]["mean"]) == (10, 1.0, 10.0, 5.5)
    assert got[1]["p2"] == pytest.approx(np.percentile(range(1, 11), 2)) and got[1]["p98"] == pytest.approx(np.percentile(range(1, 11), 98))
    assert got[2]["count"] == 0 and got[2]["p2"] is None and got[3]["p2"] == got[3]["p98"] == 5.0 and got[4]["max"] is None
    limits = stats.stretch_limits(df, 0, 100, keys=()).collect()
    assert [tuple(r) for r in limits] == [(1.0, 10.0)]
    by_band = {r["band"]: (r["low"], r["high"]) for r in stats.stretch_limits(df).collect()}
    assert by_band[3] == (5.0, 6.0) and by_band[2] == (None, None)


def test_crs_text():
    assert geo.wkt(4326).startswith('GEOGCS["WGS 84"') and geo.wkt(2056) is None
    mercator = geo.wkt(3857)
    assert mercator.startswith('PROJCS["WGS 84 / Pseudo-Mercator",GEOGCS["WGS 84"') and 'PARAMETER["scale_factor",1]' in mercator and mercator.count("[") == mercator.count("]")
    south = geo.wkt(32733)
    assert 'UTM zone 33S"' in south and 'PARAMETER["central_meridian",15]' in south and 'PARAMETER["false_northing",10000000]' in south and south.count("[") == south.count("]")


def test_web_mercator_and_back(spark):
    places = [(0.0, 0.0), (10.0, 45.0), (-179.5, -84.0), (123.456, 80.0)]
    df = spark.createDataFrame(places, "lon double, lat double")
    x, y = geo.from_degrees(F.col("lon"), F.col("lat"), 3857)
    there = df.select("lon", "lat", x.alias("x"), y.alias("y"))
    lon, lat = geo.to_degrees(F.col("x"), F.col("y"), 3857)
    for r in there.select("*", lon.alias("lon2"), lat.alias("lat2")).collect():
        assert (r["lon2"], r["lat2"]) == pytest.approx((r["lon"], r["lat"]))
        assert (r["x"], r["y"]) == pytest.approx(grids.from_degrees(3857, r["lon"], r["lat"]))
        assert grids.to_degrees(3857, r["x"], r["y"]) == pytest.approx((r["lon"], r["lat"]))
    # the published corner of the square world
    assert grids.from_degrees(3857, 180.0, 85.0511287798066) == pytest.approx((20037508.342789244, 20037508.342789244))
    assert grids.parse_crs("EPSG:3857") == 3857


def test_places_on_the_edges_of_pixels(spark):
    one, step = spark.range(1), -(0.1 / 80)
    edges = spark.createDataFrame([(45.06 + k * step,) for k in range(80)], "y double")
    col, row = geo.pixel((0.005, 0.0, 9.94, 0.0, step, 45.06), F.lit(9.94), F.col("y"))
    for r in edges.select("y", row.alias("row"), col.alias("col")).collect():
        assert (r["row"], r["col"]) == ((r["y"] - 45.06) / step, 0.0)
    turned = (2.0, 1.0, 100.0, 1.0, -2.0, 50.0)
    x, y = geo.affine(turned, F.lit(3.25), F.lit(7.5))
    assert one.select(*geo.pixel(turned, x, y)).first()[:] == pytest.approx((3.25, 7.5))
    with pytest.raises(ValueError):
        geo.pixel((1.0, 2.0, 0.0, 2.0, 4.0, 0.0), F.lit(0.0), F.lit(0.0))


def test_heights_from_a_model_in_another_projection(spark):
    points = spark.createDataFrame([(0, 0, 10.0, 45.0), (0, 1, 10.001, 45.0), (1, 0, 30.0, 45.0)], "out_row int, out_col int, lon double, lat double")
    for epsg in (4326, 3857, 32632):
        x, y = grids.from_degrees(epsg, 10.0, 45.0)
        step = 0.0005 if epsg == 4326 else 50.0
        transform = (step, 0.0, x - 1.5 * step, 0.0, -step, y + 1.5 * step)
        dem = spark.createDataFrame([(1, c, 100.0 + c) for c in range(6)], "row int, col int, height double")
        got = {(r["out_row"], r["out_col"]): r["height"] for r in ortho.with_height(points, dem, transform, None, epsg).collect()}
        across = (grids.from_degrees(epsg, 10.001, 45.0)[0] - transform[2]) / step
        assert got == {(0, 0): 101.0, (0, 1): 100.0 + int(across)}
