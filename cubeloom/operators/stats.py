"""Per-band statistics and percentiles of valid samples."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions.pixels import valid

PERCENTILES = (0.02, 0.98)


def _usable(long: DataFrame, nodata: float | None) -> DataFrame:
    return long.withColumn("value", F.when(valid(F.col("value"), nodata), F.col("value")))


#: Samples of a key that are ranked where they meet; more are first narrowed down by counting.
LARGEST = 1 << 16
#: Cells that an interval of values is counted in.
CELLS = 4096


def summarise(
    long: DataFrame, keys: Sequence[str] = ("band",), nodata: float | None = None, percentiles: Sequence[float] = PERCENTILES, largest: int = LARGEST,
) -> DataFrame:
    """count, min, max, mean, population std and percentiles of each key's valid samples; all NULL if there is none."""
    keys, names = list(keys), [f"p{round(100 * q)}" for q in percentiles]
    data = _keyed(_usable(long, nodata), keys)
    large = _large(data, largest)
    few = _by_values(data if not large else _but(data, large), percentiles)
    out = few.withColumns({n: F.col("__p")[i] for i, n in enumerate(names)})
    columns = ["__key", "count", "min", "max", "mean", "std", *names]
    if large:
        v, ranked = F.col("value"), _ranked(data, large, percentiles, CELLS, largest)
        many = _of(data, large).groupBy("__key").agg(F.count(v).alias("count"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"))
        many = many.join(F.broadcast(ranked), "__key").withColumns({n: F.col("__p")[i] for i, n in enumerate(names)})
        out = out.select(*columns).unionByName(many.select(*columns))
    return out.select(*_unkeyed(keys), *columns[1:])


def exact_percentiles(
    long: DataFrame, keys: Sequence[str] = ("band",), percentiles: Sequence[float] = PERCENTILES, cells: int = CELLS, nodata: float | None = None,
    largest: int = LARGEST,
) -> DataFrame:
    """keys, q and value: interpolated percentiles of each key's valid samples, whatever their number and however they lie.

    Keys of up to ``largest`` samples are ranked in one pass: equal values become
    one row with a count, and running sums over a key's rows give the ranks.  The
    other keys are narrowed down first.  A round counts the samples of the interval
    that a wanted rank is in, in cells, and the rank's cell with its own least and
    greatest value is the next interval: first cells of half an octave, so that an
    outlier is in a cell of its own, then ``cells`` equal ones.  Rounds end when no
    such cell has more than ``largest`` samples or several values; doubles have
    52 bits within an octave, so that takes a handful of rounds at most.  No task
    gets more than ``largest`` rows of a key, or as many as there are cells and tasks.
    """
    keys = list(keys)
    found = _percentiles(_keyed(_usable(long, nodata), keys), percentiles, cells, largest).filter(F.col("__p")[0].isNotNull())
    each = F.arrays_zip(F.array(*map(F.lit, percentiles)).alias("q"), F.col("__p").alias("value"))
    return found.select("__key", F.explode(each).alias("x")).select(*_unkeyed(keys), F.col("x.q").alias("q"), F.col("x.value").alias("value"))


def _keyed(data: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(__key, value): one struct that stands for all keys, which null is a value of."""
    return data.select(F.struct(*(map(F.col, keys) if keys else [F.lit(1).alias("all")])).alias("__key"), F.col("value").cast("double").alias("value"))


def _unkeyed(keys: Sequence[str]) -> list[Column]:
    return [F.col("__key")[k].alias(k) for k in keys]


def _large(data: DataFrame, largest: int) -> list:
    """(key, samples) of the keys with more than ``largest`` samples: there is one for so many samples at most."""
    counts = data.groupBy("__key").agg(F.count("value").alias("n")).filter(F.col("n") > largest)
    return [(r["__key"], r["n"]) for r in counts.collect()]


def _listed(data: DataFrame, rows: list, more: str) -> DataFrame:
    """Rows of (key, ...) as a table beside ``data``."""
    kind = data.schema["__key"].dataType.simpleString()
    return data.sparkSession.createDataFrame(rows, f"__key {kind}, {more}")


def _of(data: DataFrame, large: list) -> DataFrame:
    return data.join(F.broadcast(_listed(data, large, "__n long")), "__key").filter(F.col("value").isNotNull())


def _but(data: DataFrame, large: list) -> DataFrame:
    return data.join(F.broadcast(_listed(data, large, "__n long")), "__key", "left_anti")


def _percentiles(data: DataFrame, percentiles: Sequence[float], cells: int, largest: int) -> DataFrame:
    """(__key, __p): an array of percentiles for every key, of nulls for those without a sample."""
    large = _large(data, largest)
    if not large:
        return _by_values(data, percentiles).select("__key", "__p")
    return _by_values(_but(data, large), percentiles).select("__key", "__p").unionByName(_ranked(data, large, percentiles, cells, largest))


def _by_values(data: DataFrame, percentiles: Sequence[float]) -> DataFrame:
    """__key, count, min, max, mean, std, __p from a row for each value of a key."""
    values = data.groupBy("__key", "value").agg(F.count("value").alias("m"))
    key = W.partitionBy("__key")
    upto = key.orderBy("value").rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = values.withColumns({
        "to": F.sum("m").over(upto), "n": F.sum("m").over(key), "mean": F.sum(F.col("value") * F.col("m")).over(key) / F.nullif(F.sum("m").over(key), F.lit(0)),
    })
    # the value with rank k is the least one that k + 1 samples do not exceed
    at = lambda rank: F.min(F.when(F.col("to") > rank, F.col("value")))
    place = [F.lit(q) * (F.col("n") - 1) for q in percentiles]
    ends = [(at(F.floor(p)), at(F.ceil(p)), F.max(p - F.floor(p))) for p in place]
    p = F.array(*[low + (high - low) * part for low, high, part in ends])
    spread = F.sum(F.col("m") * (F.col("value") - F.col("mean")) * (F.col("value") - F.col("mean")))
    return ranked.groupBy("__key").agg(
        F.max("n").alias("count"), F.min("value").alias("min"), F.max("value").alias("max"), F.max("mean").alias("mean"),
        F.sqrt(spread / F.nullif(F.max("n"), F.lit(0))).alias("std"), p.alias("__p"),
    )


def _half_octave(v: Column) -> Column:
    """A number that rises with ``v``: its sign and the half octave that it is in."""
    size = F.floor((F.log2(F.abs(v)) + 1080) * 2) + 1
    return F.when(v > 0, size).when(v < 0, -size).otherwise(F.lit(0)).cast("long")


def _ranked(data: DataFrame, large: list, percentiles: Sequence[float], cells: int, largest: int) -> DataFrame:
    """(__key, __p) of keys with many samples, by rounds of counting."""
    ranks = [(key, rank) for key, n in large for rank in sorted({f(q * (n - 1)) for q in percentiles for f in (math.floor, math.ceil)})]
    counts = _of(data, large).groupBy("__key", _half_octave(F.col("value")).alias("cell"), F.lit(0.0).alias("lo"))
    asked = [(key, rank, 0, 0.0) for key, rank in ranks]
    values: dict = {}
    while asked:
        found = _cell_of(_listed(data, asked, "rank long, before long, lo double"), counts)
        values |= {(r["__key"], r["rank"]): r["least"] for r in found if r["least"] == r["most"]}
        found = [r for r in found if r["least"] < r["most"]]
        if all(r["n"] <= largest for r in found):
            break
        # of an interval that is small already, the next round counts single cells as well
        spans = {(r["__key"], r["least"], r["most"]) for r in found}
        v, lo, hi = F.col("value"), F.col("lo"), F.col("hi")
        cell = F.least(F.floor((v - lo) / (hi - lo) * cells), F.lit(cells - 1)).cast("long")
        counts = _within(data, spans).groupBy("__key", cell.alias("cell"), "lo")
        asked = [(r["__key"], r["rank"], r["before"], r["least"]) for r in found]
    else:
        found = []
    if found:
        one = _within(data, {(r["__key"], r["least"], r["most"]) for r in found}).groupBy("__key", F.col("value").alias("cell"), "lo")
        last = _cell_of(_listed(data, [(r["__key"], r["rank"], r["before"], r["least"]) for r in found], "rank long, before long, lo double"), one)
        values |= {(r["__key"], r["rank"]): r["least"] for r in last}
    rows = []
    for key, n in large:
        places = [q * (n - 1) for q in percentiles]
        low, high = ([values[key, f(p)] for p in places] for f in (math.floor, math.ceil))
        rows.append((key, [a + (b - a) * (p - math.floor(p)) for a, b, p in zip(low, high, places, strict=True)]))
    return _listed(data, rows, "__p array<double>")


def _within(data: DataFrame, spans: set) -> DataFrame:
    """Samples in the intervals (key, lo, hi), which do not overlap."""
    table = F.broadcast(_listed(data, sorted(spans, key=repr), "lo double, hi double"))
    return data.join(table, "__key").filter((F.col("value") >= F.col("lo")) & (F.col("value") <= F.col("hi")))


def _cell_of(asked: DataFrame, cells) -> list:  # noqa: ANN001
    """Of each (key, rank, before, lo), the cell of interval lo that the rank is in: its samples, their least and most, and how many are before it."""
    v = F.col("value")
    counts = cells.agg(F.count(v).alias("n"), F.min(v).alias("least"), F.max(v).alias("most"))
    upto = W.partitionBy("__key", "lo").orderBy("cell").rowsBetween(W.unboundedPreceding, W.currentRow)
    counts = counts.withColumn("to", F.sum("n").over(upto))
    inside = (F.col("rank") - F.col("before") < F.col("to")) & (F.col("rank") - F.col("before") >= F.col("to") - F.col("n"))
    hit = counts.join(F.broadcast(asked), ["__key", "lo"]).filter(inside)
    return hit.select("__key", "rank", (F.col("before") + F.col("to") - F.col("n")).alias("before"), "n", "least", "most").collect()


def stretch_limits(long: DataFrame, lower: float = 2.0, upper: float = 98.0, keys: Sequence[str] = ("band",)) -> DataFrame:
    """low and high percentile of each key (of all samples without keys); high is at least low + 1 if they meet."""
    if not 0 <= lower < upper <= 100:
        raise ValueError("percentiles are in order within 0 and 100")
    found = _percentiles(_keyed(_usable(long, None), list(keys)), (lower / 100, upper / 100), CELLS, LARGEST)
    limits = found.select(*_unkeyed(keys), F.col("__p")[0].alias("low"), F.col("__p")[1].alias("high"))
    return limits.withColumn("high", F.when(F.col("high") <= F.col("low"), F.col("low") + 1).otherwise(F.col("high")))


def profile(cube: DataFrame, row: int, col: int, size: int = 1, indices: Sequence[int] | None = None) -> DataFrame:
    """Mean of each band's valid samples in an odd window around a pixel, clipped at the edges; pos, value, n."""
    if size < 1 or size % 2 == 0:
        raise ValueError("the window is odd")
    half = size // 2
    near = cube.filter(F.col("row").between(row - half, row + half) & F.col("col").between(col - half, col + half))
    bands: Column = F.col("bands")
    if indices is not None:
        bands = F.array(*[F.col("bands")[i - 1] for i in indices])
    long = near.select(F.posexplode(bands).alias("pos", "value"))
    good = F.when(valid(F.col("value")), F.col("value"))
    return long.groupBy("pos").agg(F.avg(good).alias("value"), F.count(good).alias("n"))
