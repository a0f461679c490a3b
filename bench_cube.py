"""A generated rectangular cube through the main operators, beside single-thread NumPy.

``python bench_cube.py [rows cols bands]``: prints one JSON line.  The cube is made
by arithmetic on ranges, written as Parquet once, and read by both sides.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubeloom.functions import pixels
from cubeloom.operators import cube, quality, resample, stats


def generated(spark: SparkSession, rows: int, cols: int, bands: int) -> DataFrame:
    """Values of 0 to 9999, NULL on a border, some saturated."""
    value = lambda b: F.when((F.col("row") > 1) & (F.col("col") > 1), ((F.col("row") * 31 + F.col("col") * 17 + b * 101 + (F.col("row") * F.col("col")) % 97) % 10_000).cast("double"))
    grid = spark.range(rows * cols).select(F.floor(F.col("id") / cols).cast("int").alias("row"), (F.col("id") % cols).cast("int").alias("col"))
    return grid.select("row", "col", F.transform(F.sequence(F.lit(1), F.lit(bands)), value).alias("bands"))


def timed(f, times: int = 3) -> float:  # noqa: ANN001
    best = float("inf")
    for _ in range(times):
        began = time.perf_counter()
        f()
        best = min(best, time.perf_counter() - began)
    return round(best, 3)


def spark_side(spark: SparkSession, path: str, rows: int, cols: int, bands: int) -> dict[str, float]:
    read = lambda: spark.read.parquet(path)
    noop = lambda df: df.write.format("noop").mode("overwrite").save()
    settings = {"saturation": 9000.0, "low_signal": 500.0, "fraction": 0.2}
    places = resample.scale_places(resample.target_grid(spark, cols, rows), (cols, rows), (cols, rows)).withColumns({"y": F.col("y") * 0.9 + 0.3, "x": F.col("x") * 0.9 + 0.3})
    few = lambda: read().select("row", "col", pixels.pick(F.col("bands"), (1, 2, 3)).alias("bands"))
    return {
        "nd_index": timed(lambda: noop(read().select("row", "col", pixels.normalised_difference(F.col("bands")[1], F.col("bands")[0])))),
        "quality_counts": timed(lambda: noop(quality.class_counts(quality.classify(read(), **settings)))),
        "band_statistics": timed(lambda: noop(stats.summarise(cube.to_long(read()))), 2),
        "dilate_3x3": timed(lambda: noop(quality.grow(quality.classify(read(), **settings), "dilate")), 2),
        "bilinear_warp_3_bands": timed(lambda: noop(resample.warp_tiles(places, few(), 3, "bilinear", cols, rows)), 2),
    }


def numpy_side(path: str, rows: int, cols: int, bands: int) -> dict[str, float]:
    def load(names: tuple[str, ...] = ("row", "col", "bands")) -> np.ndarray:
        t = pq.read_table(path, columns=list(names)).combine_chunks()
        flat = np.asarray(t.column("bands").combine_chunks().flatten().fill_null(np.nan)).reshape(-1, bands)
        out = np.empty((rows * cols, bands))
        out[np.asarray(t.column("row")).astype(int) * cols + np.asarray(t.column("col"))] = flat
        return out

    def index() -> np.ndarray:
        c = load()
        with np.errstate(all="ignore"):
            return np.where(np.isfinite(c[:, 1] + c[:, 0]) & (c[:, 1] + c[:, 0] != 0), (c[:, 1] - c[:, 0]) / (c[:, 1] + c[:, 0]), -9999).astype(np.float32)

    def classes() -> np.ndarray:
        c = load()
        good = np.isfinite(c)
        n = good.sum(1)
        s, low = ((c >= 9000) & good).sum(1) / np.maximum(n, 1), ((c <= 500) & good).sum(1) / np.maximum(n, 1)
        return np.select([n == 0, s >= 0.2, low >= 0.2], [0, 2, 3], 1).reshape(rows, cols)

    def statistics() -> list:
        c = load()
        return [np.nanmin(c, 0), np.nanmax(c, 0), np.nanmean(c, 0), np.nanstd(c, 0), np.nanpercentile(c, [2, 98], axis=0)]

    def dilate() -> np.ndarray:
        k = classes()
        for code in (2, 3):
            hit = np.pad(k == code, 1)
            grown = np.logical_or.reduce([hit[1 + y : 1 + y + rows, 1 + x : 1 + x + cols] for y in (-1, 0, 1) for x in (-1, 0, 1)])
            k = np.where(grown & (k == 1), code, k)
        return k

    def warp() -> np.ndarray:
        c = load()[:, :3].reshape(rows, cols, 3)
        y, x = np.meshgrid(np.arange(rows) * 0.9 + 0.3, np.arange(cols) * 0.9 + 0.3, indexing="ij")
        y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
        total, weight = np.zeros((rows, cols, 3)), np.zeros((rows, cols, 3))
        for dy in (0, 1):
            for dx in (0, 1):
                v = c[np.minimum(y0 + dy, rows - 1), np.minimum(x0 + dx, cols - 1)]
                w = ((1 - abs(y0 + dy - y)) * (1 - abs(x0 + dx - x)))[..., None] * np.isfinite(v)
                total += w * np.nan_to_num(v)
                weight += w
        return total / np.maximum(weight, 1e-12)

    return {"nd_index": timed(index), "quality_counts": timed(lambda: np.bincount(classes().reshape(-1))), "band_statistics": timed(statistics, 1), "dilate_3x3": timed(dilate, 2), "bilinear_warp_3_bands": timed(warp, 2)}


def main() -> None:
    rows, cols, bands = (int(x) for x in (sys.argv[1:] or (1000, 1024, 64)))
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    with tempfile.TemporaryDirectory(prefix="cube-bench-") as folder:
        path = str(Path(folder) / "cube.parquet")
        generated(spark, rows, cols, bands).write.parquet(path)
        print(json.dumps({"cube": [rows, cols, bands], "cpus": cpus, "spark_sec": spark_side(spark, path, rows, cols, bands), "numpy_1_thread_sec": numpy_side(path, rows, cols, bands)}))


if __name__ == "__main__":
    main()
