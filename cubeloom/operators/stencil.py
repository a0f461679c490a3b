"""Neighbourhoods on a grid in one shuffle: tiles with a halo.

A pixel goes to the tile that it lies in, and to those whose halo it lies in, so
that each task has whole neighbourhoods of its own tile, whatever the kernel.
Only pixels within the halo's width of an edge travel more than once.  A tile is
an array of bounded size in its task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Side of a tile; a wider halo has wider tiles, so that most pixels travel once.
TILE = 256


class Tile:
    """A tile and its halo: which pixels there are, and columns as arrays."""

    def __init__(self, rows: pa.Table, halo: int, block: int):
        self.halo, self.block, self.side = halo, block, block + 2 * halo
        self.top, self.left = (rows[k][0].as_py() * block - halo for k in ("__tr", "__tc"))
        self.row, self.col = (np.asarray(rows[k]).astype(np.int64) for k in ("row", "col"))
        self.at = (self.row - self.top) * self.side + self.col - self.left
        self.rows = rows

    def array(self, values: np.ndarray, empty: float | int | bool) -> np.ndarray:  # noqa: FBT001
        """Values of the pixels in their places, ``empty`` where there is none."""
        out = np.full(self.side * self.side, empty, dtype=values.dtype)
        out[self.at] = values
        return out.reshape(self.side, self.side)

    def inner(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(rows, columns, and both places in the arrays) of the tile's own pixels that ``wanted`` marks."""
        h, b = self.halo, self.block
        y, x = np.nonzero(wanted[h : h + b, h : h + b])
        return (y + h + self.top).astype(np.int32), (x + h + self.left).astype(np.int32), y + h, x + h


def in_tiles(df: DataFrame, columns: Sequence[str], halo: int, solve: Callable[[Tile], pa.Table], schema: str, by: Sequence[str] = (), block: int | None = None) -> DataFrame:
    """``solve`` of every tile of ``df`` (row, col, ``columns`` and ``by``), for each value of ``by`` alone."""
    b = block or max(TILE, 4 * halo)
    owners = lambda c: F.sequence(F.floor((F.col(c) - halo) / b).cast("int"), F.floor((F.col(c) + halo) / b).cast("int"))
    kept = df.select("row", "col", *by, *columns).filter("row IS NOT NULL AND col IS NOT NULL")
    spread = kept.withColumn("__tr", F.explode(owners("row"))).withColumn("__tc", F.explode(owners("col")))
    return spread.groupBy(*by, "__tr", "__tc").applyInArrow(lambda rows: solve(Tile(rows, halo, b)), schema)


def shifted_sum(x: np.ndarray, before: int, after: int, axis: int) -> np.ndarray:
    """At every place the sum of ``x`` from ``before`` places before it to ``after`` behind it; beyond the edge is nothing."""
    kind = np.float64 if x.dtype.kind == "f" else np.int64
    total = np.concatenate([np.zeros_like(x.take([0], axis), dtype=kind), np.cumsum(x, axis=axis, dtype=kind)], axis=axis)
    n = x.shape[axis]
    place = np.arange(n)
    return total.take(np.minimum(place + after + 1, n), axis) - total.take(np.maximum(place - before, 0), axis)


def dilated(x: np.ndarray, shape: str, size: int, iterations: int = 1) -> np.ndarray:
    """Where a kernel around some marked place reaches; a running window for each of its rows, however wide."""
    r = size // 2
    for _ in range(iterations if r else 0):
        wide = lambda w: shifted_sum(x, w, w, 1) > 0  # noqa: E731, B023
        if shape == "rect":
            x = shifted_sum(wide(r), r, r, 0) > 0
        elif shape == "cross":
            x = wide(r) | (shifted_sum(x, r, r, 0) > 0)
        else:
            out = np.zeros_like(x)
            for y in range(-r, r + 1):
                row = wide(round((r * r - y * y) ** 0.5))
                lo, hi = max(0, y), len(x) + min(0, y)
                out[lo:hi] |= row[lo - y : hi - y]
            x = out
    return x


def weighted(x: np.ndarray, good: np.ndarray, weights: Sequence[float], axis: int) -> tuple[np.ndarray, np.ndarray]:
    """(weighted means of the good places around every place, where there are any)."""
    r, n = len(weights) // 2, x.shape[axis]
    x, total, share = np.where(good, x, 0.0), np.zeros(x.shape), np.zeros(x.shape)
    cut = lambda lo, hi: tuple(slice(lo, hi) if a == axis else slice(None) for a in range(x.ndim))
    for i, w in enumerate(weights):
        d = i - r
        # a sample moves by d, as if it were spread
        to, of = cut(max(0, d), n + min(0, d)), cut(max(0, -d), n + min(0, -d))
        total[to] += w * x[of]
        share[to] += w * good[of]
    return total / np.where(share > 0, share, 1.0), share > 0
