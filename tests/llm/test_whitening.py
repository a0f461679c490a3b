"""Whitening against NumPy's own decomposition of the whole covariance."""

import numpy as np
import pytest

from cubeloom.llm import whitening

VECTORS = "vec_id long, embedding array<float>, label int"


def brute(rows, k=4):
    """{(vec_id, x): (n, deviation, whitened up to sign)} and shares of the variance."""
    good = [(i, [int(np.floor(256 * float(np.float32(c)))) for c in v]) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    width = max((len(v) for _, v in good), default=0)
    good = [(i, tuple(v + [0] * (width - len(v)))) for i, v in good]
    fit = sorted({v for _, v in good})
    n, x = len(fit), np.array(fit, float)
    sums = [sum(c) for c in zip(*fit, strict=True)]
    value, vector = np.linalg.eigh(np.cov(x.T, bias=True).reshape(width, width))
    value, vector = value[::-1][:k], vector[:, ::-1][:, :k]
    keep = value > 1e-9 * max(value[0], 1e-300)
    value, vector = value[keep], vector[:, keep]
    white = lambda v: (np.array(v) - x.mean(axis=0)) @ vector / np.sqrt(value)
    return [(i, v, n, sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True)), white(v)) for i, v in good], value / np.trace(np.cov(x.T, bias=True).reshape(width, width))


def check(spark, rows, k=4):
    got = whitening.op13(spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS), k).collect()
    want, share = brute(rows, k)
    assert len(got) == len(want) * len(share)
    by = {}
    for r in got:
        by.setdefault((r["vec_id"], r["deviation"]), {})[r["component"]] = r
    signs = None
    for i, _, n, deviation, white in want:
        found = by[i, deviation]
        mine = np.array([found[c + 1]["whitened"] for c in range(len(share))])
        signs = np.sign(mine * white) if signs is None or (signs == 0).any() else signs
        assert np.allclose(mine, signs * white, atol=1e-7) and found[1]["n"] == n
        assert np.allclose([found[c + 1]["explained"] for c in range(len(share))], share, rtol=1e-9) and found[1]["identity_error"] < 1e-9
    return got


@pytest.mark.parametrize(("n", "d", "seed"), [(60, 3, 0), (200, 12, 1), (40, 50, 2)])
def test_same_as_numpy(spark, n, d, seed):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(c) for c in rng.normal(size=d) * (2.0 ** -np.arange(d) + 0.05)]) for i in range(n)]
    check(spark, rows + rows[:5] + [(None, rows[3][1]), (1000 + n, rows[0][1])])


def test_rows_that_take_no_part_and_short_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(c) for c in rng.normal(size=4)]) for i in range(30)]
    odd = [(100, None), (101, [1.0, None, 2.0, 3.0]), (102, [float("nan")] * 4), (103, [float("inf"), 0.0, 0.0, 0.0]), (104, [1.0, 2.0]), (105, []), (106, [-0.0] * 4)]
    got = check(spark, rows + odd)
    assert {r["vec_id"] for r in got} == {*range(30), 104, 105, 106}


def test_nothing_to_whiten(spark):
    empty = whitening.op13(spark.createDataFrame([], VECTORS))
    assert empty.count() == 0 and empty.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    same = [(i, [0.5, 0.25], 0) for i in range(5)]
    assert whitening.op13(spark.createDataFrame(same, VECTORS)).count() == 0
    assert whitening.op13(spark.createDataFrame([(1, None, 0), (2, [], 0)], VECTORS)).count() == 0
    line = [(i, [float(i), 2.0 * i, 0.0], 0) for i in range(5)]
    assert {r["component"] for r in whitening.op13(spark.createDataFrame(line, VECTORS)).collect()} == {1}


def test_few_columns_are_enough_where_the_spectrum_falls(spark):
    rng = np.random.default_rng(4)
    turn = np.linalg.qr(rng.normal(size=(80, 80)))[0]
    x = rng.normal(size=(600, 80)) * (0.7 ** np.arange(80)) @ turn.T * 40
    vectors = spark.createDataFrame([(i, [float(c) for c in v], 0) for i, v in enumerate(x)], VECTORS)
    rows, seen = whitening.quantized(vectors), []
    kept = whitening._times_covariance
    whitening._times_covariance = lambda blocks, mean, n, q: seen.append(q.shape[1]) or kept(blocks, mean, n, q)
    try:
        model = whitening.fit(rows, 4, columns=16)
    finally:
        whitening._times_covariance = kept
    assert model.passes == len(seen) > 2 and max(seen) == 16 and model.residuals.max() < 1e-9 * model.eigenvalues[0]
    value, vector = np.linalg.eigh(np.cov(np.unique(np.floor(256 * x.astype(np.float32).astype(float)), axis=0).T, bias=True))
    assert np.allclose(model.eigenvalues, value[::-1][:4], rtol=1e-12)
    assert np.allclose(np.abs((model.components * vector[:, ::-1][:, :4]).sum(axis=0)), 1, atol=1e-12)


def test_the_block_widens_where_the_spectrum_is_flat(spark):
    rng = np.random.default_rng(5)
    vectors = spark.createDataFrame([(i, [float(c) for c in rng.normal(size=24)], 0) for i in range(300)], VECTORS)
    model = whitening.fit(whitening.quantized(vectors), 4, columns=5, passes=4)
    assert model.passes < 20 and model.identity_error < 1e-12


def test_deviations_beyond_64_bits():
    x = np.array([[1 << 40, -(1 << 40)], [3, 4]])
    assert whitening.deviations(x, 2, [5, 6]) == [None, (2 * 3 - 5) ** 2 + (2 * 4 - 6) ** 2]
    assert whitening.deviations(np.array([[7, -7]]), 3, [1, 1]) == [20**2 + 22**2]
    big = np.array([[1 << 29, 1]])
    assert whitening.deviations(big, 2, [0, 0]) == [(1 << 60) + 4]
