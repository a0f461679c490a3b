"""Projections against published points, there and back, on numbers and on columns."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cubeloom.functions import geo, projections
from cubeloom.plans import grids

# Points of the public guidance note on coordinate conversions, in metres or feet to two digits.
TEXAS = projections.LambertConic(20_925_832.16, 1 / 294.97870, -99.0, 2_000_000.0, 0.0, 27 + 50 / 60, (28 + 23 / 60, 30 + 17 / 60))
PUBLISHED = [
    (TEXAS, -96.0, 28.5, 2_963_503.91, 254_759.80), (projections.of(5041), 44.0, 73.0, 3_320_416.75, 632_668.43), (projections.of(3032), 120.0, -75.0, 7_255_380.79, 7_053_389.56),
]


@pytest.mark.parametrize(("projection", "lon", "lat", "x", "y"), PUBLISHED)
def test_published_points(projection, lon, lat, x, y):
    assert projection.forward(lon, lat, math) == pytest.approx((x, y), abs=0.01)
    assert projection.inverse(x, y, math) == pytest.approx((lon, lat), abs=2e-7)


def test_origins():
    assert projections.of(2154).forward(3.0, 46.5, math) == pytest.approx((700_000.0, 6_600_000.0), abs=1e-6)
    assert projections.of(3034).forward(10.0, 52.0, math) == pytest.approx((4_000_000.0, 2_800_000.0), abs=1e-6)
    assert projections.of(25832).forward(9.0, 0.0, math) == pytest.approx((500_000.0, 0.0), abs=1e-6)
    assert projections.of(28355).forward(147.0, -1e-12, math) == pytest.approx((500_000.0, 10_000_000.0), abs=1e-3)
    for epsg, lat in ((3413, 90.0), (3031, -90.0)):
        assert projections.of(epsg).forward(17.0, lat, math) == pytest.approx((0.0, 0.0), abs=1e-6)
    # a pole's parallel without distortion has its own length
    ring = [projections.of(3413).forward(lon, 70.0, math) for lon in (0.0, 1e-6)]
    e = projections.of(3413).eccentricity
    length = 6378137.0 * math.cos(math.radians(70)) / math.sqrt(1 - (e * math.sin(math.radians(70))) ** 2) * math.radians(1e-6)
    assert math.dist(*ring) == pytest.approx(length, rel=1e-5)


CASES = {2154: (2.0, 48.0), 3034: (-8.0, 61.0), 3031: (140.0, -80.0), 3413: (-120.0, 66.0), 3995: (33.0, 80.0), 5042: (-77.0, -85.0), 25833: (13.4, 52.5), 26912: (-111.0, 40.0), 28355: (145.0, -37.8), 7856: (151.2, -33.9), 32733: (15.5, -33.0)}


def test_columns_are_the_numbers_and_come_back(spark):
    rng = np.random.default_rng(1)
    for epsg, (lon, lat) in CASES.items():
        places = [(float(lon + a), float(lat + b)) for a, b in rng.uniform(-1.5, 1.5, (20, 2))]
        x, y = geo.from_degrees(F.col("lon"), F.col("lat"), epsg)
        there = spark.createDataFrame(places, "lon double, lat double").select("lon", "lat", x.alias("x"), y.alias("y"))
        back = geo.to_degrees(F.col("x"), F.col("y"), epsg)
        for r in there.select("*", back[0].alias("lon2"), back[1].alias("lat2")).collect():
            assert (r["x"], r["y"]) == pytest.approx(grids.from_degrees(epsg, r["lon"], r["lat"]), abs=1e-6), epsg
            assert (r["lon2"], r["lat2"]) == pytest.approx((r["lon"], r["lat"]), abs=1e-9), epsg
            assert grids.to_degrees(epsg, r["x"], r["y"]) == pytest.approx((r["lon"], r["lat"]), abs=1e-9), epsg


def test_what_is_known():
    assert all(grids.supported(c) for c in (4326, 3857, 32601, 32760, *CASES)) and not any(grids.supported(c) for c in (None, 0, 2056, 32661, 28359, 25827, 4258))
    assert grids.parse_crs("EPSG:25832") == 25832
    same = projections.of(32633)
    assert same.forward(15.5, 47.25, math) == pytest.approx(grids.from_degrees(32633, 15.5, 47.25), abs=1e-7)


def test_bounds_between_families():
    box = grids.project_bounds(25832, 3034, (500_000.0, 5_300_000.0, 510_000.0, 5_310_000.0))
    back = grids.project_bounds(3034, 25832, box)
    assert back[0] <= 500_000.0 <= 510_000.0 <= back[2] and back[2] - back[0] < 12_000
