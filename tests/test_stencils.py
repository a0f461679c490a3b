"""Neighbourhoods in tiles with a halo, against every pixel's own neighbourhood."""

import numpy as np
import pytest

from cubeloom.operators import quality, resample, stencil


def grid(rng, height, width, holes=0.1):
    """{(row, col): class} with places that the grid lacks."""
    return {(r, c): int(rng.choice([0, 1, 2, 3, 4, 5], p=[0.05, 0.75, 0.05, 0.05, 0.05, 0.05])) for r in range(height) for c in range(width) if rng.random() > holes}


def grown(classes, operation, offsets):
    """Pixel by pixel."""
    out = dict(classes)
    for place, code in classes.items():
        if code != 1:
            continue
        for c in quality.GROWING:
            def reached(p, c=c):
                return any(classes.get((p[0] - y, p[1] - x)) == c for y, x in offsets)

            around = [(place[0] + y, place[1] + x) for y, x in offsets]
            if reached(place) and (operation == "dilate" or all(reached(p) for p in around if p in classes)):
                out[place] = c
                break
    return out


@pytest.mark.parametrize(("operation", "shape", "size", "iterations", "block"), [
    ("dilate", "rect", 3, 1, 8), ("dilate", "cross", 5, 2, 7), ("dilate", "ellipse", 7, 1, 16), ("close", "rect", 3, 1, 8), ("close", "cross", 3, 2, 5), ("close", "ellipse", 5, 1, 3), ("close", "rect", 1, 1, 8), ("dilate", "rect", 9, 1, 2),
])
def test_growth(spark, operation, shape, size, iterations, block):
    classes = grid(np.random.default_rng(size + iterations), 21, 18)
    df = spark.createDataFrame([(r, c, v) for (r, c), v in classes.items()], "row int, col int, class short")
    got = quality.grow(df, operation, shape, size, iterations, block=block)
    assert {(r["row"], r["col"]): r["class"] for r in got.collect()} == grown(classes, operation, quality.kernel(shape, size, iterations))
    assert got.count() == len(classes)


@pytest.mark.parametrize(("size", "block"), [(1, 8), (3, 8), (7, 5), (9, 4)])
def test_blur(spark, size, block):
    rng = np.random.default_rng(size)
    values = {(r, c, b): (None if rng.random() < 0.2 else float(rng.normal())) for b in (1, 2) for r in range(13) for c in range(11) if rng.random() > 0.1}
    df = spark.createDataFrame([(*k, v) for k, v in values.items()], "row int, col int, band int, value double")
    weights, want = resample.gaussian_weights(size), dict(values)
    for axis in (0, 1):
        now = {}
        for place in values:
            total = share = 0.0
            for i, w in enumerate(weights):
                p = list(place)
                p[axis] -= i - size // 2
                v = want.get(tuple(p))
                if v is not None:
                    total, share = total + w * v, share + w
            if share:
                now[place] = total / share
        want = now
    got = {(r["row"], r["col"], r["band"]): r["value"] for r in resample.gaussian_blur(df, size, block=block).collect()}
    assert got.keys() == want.keys() and np.allclose([got[k] for k in want], list(want.values()))


def test_one_shuffle(spark):
    df = spark.range(100).selectExpr("int(id / 10) row", "int(id % 10) col", "1S class", "1 band", "double(id) value")
    for plan in (quality.grow(df, "close", "cross", 5, 3), resample.gaussian_blur(df, 7)):
        assert plan._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_windows_of_any_width():
    x = np.random.default_rng(1).random((20, 17)) > 0.9
    for before, after in ((0, 0), (1, 3), (40, 40)):
        got = stencil.shifted_sum(x, before, after, 1)
        assert all(got[r, c] == x[r, max(0, c - before) : c + after + 1].sum() for r in range(20) for c in range(17))


@pytest.mark.parametrize(("size", "block"), [(1, 8), (7, 5), (25, 16), (101, 16)])
def test_neighborhood_means(spark, size, block):
    rng = np.random.default_rng(size)
    values = {(r, c, 1): (None if rng.random() < 0.2 else float(rng.normal() * 1e3)) for r in range(31) for c in range(27) if rng.random() > 0.1}
    values[3, 4, 1], half = float("inf"), size // 2
    df = spark.createDataFrame([(*k, v) for k, v in values.items()], "row int, col int, band int, value double")
    got = {(r["row"], r["col"], r["band"]): (r["value"], r["n"]) for r in resample.neighborhood_mean(df, size, block=block).collect()}
    assert got.keys() == values.keys()
    for (row, col, band), (mean, n) in got.items():
        near = [v for (r, c, _), v in values.items() if abs(r - row) <= half and abs(c - col) <= half and v is not None and np.isfinite(v)]
        assert n == len(near) and (mean is None if not near else mean == pytest.approx(np.mean(near))), (row, col, band)
