"""Percentiles of any samples by any path, against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cubeloom.operators import stats

QS = (0.0, 0.02, 0.5, 0.98, 1.0)


def frame(spark, by_band):
    return spark.createDataFrame([(k, float(v)) for k, x in by_band.items() for v in x], "band int, value double")


def samples(seed):
    rng = np.random.default_rng(seed)
    return {
        1: rng.normal(size=700), 2: np.append(rng.normal(size=400), 1e300), 3: np.full(500, -7.5), 4: np.append(1 + rng.integers(0, 50, 600) * 2.0**-50, [5e-324, -1e308, 1.7e308]),
        5: rng.integers(-3, 3, 900).astype(float), 6: np.array([4.0]), 7: np.append(np.zeros(300), -np.zeros(300)), 8: np.exp(rng.normal(size=500) * 40) * rng.choice([-1, 1], 500),
    }


@pytest.mark.parametrize(("seed", "cells", "largest"), [(0, 16, 10), (1, 4096, 50), (2, 2, 1), (3, 4096, 1 << 16)])
def test_any_path_is_exact(spark, seed, cells, largest):
    x = samples(seed)
    got = {(r["band"], r["q"]): r["value"] for r in stats.exact_percentiles(frame(spark, x), percentiles=QS, cells=cells, largest=largest).collect()}
    assert len(got) == len(x) * len(QS)
    for (band, q), value in got.items():
        assert value == pytest.approx(np.percentile(x[band], 100 * q), rel=1e-14, abs=5e-324), (band, q)


@pytest.mark.parametrize("largest", [20, 1 << 16])
def test_statistics_of_large_and_small_keys(spark, largest):
    x = {k: v for k, v in samples(5).items() if k in (1, 3, 5, 6)}
    df = frame(spark, x).union(spark.createDataFrame([(9, None), (None, 2.0), (None, 4.0)], "band int, value double"))
    got = {r["band"]: r for r in stats.summarise(df, largest=largest).collect()}
    for k, v in x.items():
        r = got[k]
        assert (r["count"], r["min"], r["max"]) == (len(v), v.min(), v.max())
        assert np.allclose([r["mean"], r["std"], r["p2"], r["p98"]], [v.mean(), v.std(), *np.percentile(v, [2, 98])])
    assert got[9]["count"] == 0 and got[9]["p2"] is None and got[None]["mean"] == 3.0 and got[None]["p2"] == pytest.approx(2.04)


def test_an_outlier_leaves_no_large_group(spark):
    many = spark.range(400_000).select(F.lit(1).alias("band"), F.when(F.col("id") == 7, 1e12).otherwise(F.sin("id") * 1e-3 + 1).alias("value"))
    x = np.array([r["value"] for r in many.collect()])
    seen = []
    kept = stats._cell_of

    def watched(asked, cells):
        rows = kept(asked, cells)
        seen.append([r["n"] for r in rows])
        return rows

    stats._cell_of = watched
    try:
        got = stats.summarise(many).first()
    finally:
        stats._cell_of = kept
    assert np.allclose([got["p2"], got["p98"]], np.percentile(x, [2, 98]), rtol=1e-15)
    # what is ranked in the end is what the round before has left
    assert max(seen[-2]) <= stats.LARGEST and len(seen) <= 4


def test_pooled_limits_of_many_samples(spark, monkeypatch):
    monkeypatch.setattr(stats, "LARGEST", 50)
    x = samples(8)[1]
    df = frame(spark, {1: x[:300], 2: x[300:]})
    got = stats.stretch_limits(df, keys=()).first()
    assert np.allclose([got["low"], got["high"]], np.percentile(x, [2, 98]))
