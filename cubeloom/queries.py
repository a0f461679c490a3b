"""Queries of the raster operators over the tables of a folder, and their SQL.

The canonical cube is ``embeddings``: a vector is a pixel's 64 bands, the grid
is 25 pixels wide, and band i has wavelength 420 + 32 (i - 1) nm.  ``lineitem``
serves as a tall cube of four bands for narrow operators and aggregates.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import geo, pixels, text
from .operators import bands, cube, ortho, quality, resample, stats
from .plans import checks
from .shared import delete, make_folder, shared_dir
from .sources import collection, tiff, writer

Query = Callable[[SparkSession, str], DataFrame]

WIDTH = 25
# The class names of ``_NAMES``, and the band numbers that stand for colours in the test cube.
WAVELENGTHS = [420.0 + 32 * i for i in range(64)]
NIR, RED, GREEN, BLUE = 14, 9, 5, 3
MASK_BANDS = (3, 5, 9, 14)
QUALITY = {"saturation": 0.2, "low_signal": -0.2, "fraction": 0.05}
DEFECTS = {"saturation": 0.2, "low_signal": -0.2, "fraction": 0.25}

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):  # noqa: ANN202
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixel_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "embeddings")
    return cube.from_arrays(e, F.floor(F.col("vec_id") / WIDTH), F.col("vec_id") % WIDTH, F.col("embedding"))


def scene_size(spark: SparkSession, sf_dir: str) -> tuple[int, int]:
    """(width, height) of the whole cube: one number from the table."""
    last = _table(spark, sf_dir, "embeddings").agg(F.max("vec_id").alias("n")).first()["n"]
    return WIDTH, 0 if last is None else last // WIDTH + 1


def tall_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = _table(spark, sf_dir, "lineitem")
    return item.select("l_orderkey", F.array(*[F.col(c).cast("double") for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")]).alias("bands"))


def _named(df: DataFrame, indices: tuple[int, ...]) -> DataFrame:
    return df.select("row", "col", *[F.col("bands")[k].alias(f"b{i}") for k, i in enumerate(indices)])


_CUBE = (
    "cube AS (SELECT (vec_id // 25)::INT AS \"row\", (vec_id % 25)::INT AS col, list_transform(embedding, "
    "lambda x: x::FLOAT::DOUBLE) AS bands FROM embeddings)"
)
_LONG = _CUBE + ", long AS (SELECT \"row\", col, generate_subscripts(bands, 1)::INT AS band, unnest(bands) AS value FROM cube)"


def _class_sql(bands_sql: str, sat: float, low: float, frac: float) -> str:
    good = f"list_filter({bands_sql}, lambda v: v IS NOT NULL AND isfinite(v))"
    n = f"len({good})"
    return (
        f"CASE WHEN {n} = 0 THEN 0 WHEN len(list_filter({bands_sql}, lambda v: v IS NOT NULL AND NOT isfinite(v))) > 0 THEN 4"
        f" WHEN len(list_filter({good}, lambda v: v >= {sat}::DOUBLE))::DOUBLE / greatest({n}, 1) >= {frac}::DOUBLE THEN 2"
        f" WHEN len(list_filter({good}, lambda v: v <= {low}::DOUBLE))::DOUBLE / greatest({n}, 1) >= {frac}::DOUBLE THEN 3 "
        "ELSE 1 END::SMALLINT"
    )


_MASK_BANDS_SQL = "[bands[3], bands[5], bands[9], bands[14]]"
_CLASSES = _CUBE + f", classes AS (SELECT \"row\", col, {_class_sql('bands', 0.2, -0.2, 0.05)} AS class FROM cube)"
_DEFECTS = _CUBE + f", classes AS (SELECT \"row\", col, {_class_sql(_MASK_BANDS_SQL, 0.2, -0.2, 0.25)} AS class FROM cube)"
_NAMES = (
    "names(class, name) AS (VALUES (0::SMALLINT, 'no_data'), (1::SMALLINT, 'valid'), (2::SMALLINT, 'saturated'), "
    "(3::SMALLINT, 'low_signal'), (4::SMALLINT, 'invalid_numeric'), (5::SMALLINT, 'spectral_anomaly'), (255::SMALLINT, "
    "'unclassified'))"
)


# -- scans and projections --------------------------------------------------------------------


@_query(
    f"WITH {_CUBE} SELECT \"row\", col, bands[9] AS b0, bands[5] AS b1, bands[3] AS b2 FROM cube WHERE \"row\" BETWEEN 2 "
    "AND 9 AND col BETWEEN 3 AND 12"
)
def scan_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(cube.select_bands(cube.window(pixel_cube(spark, sf_dir), 3, 2, 10, 8), (RED, GREEN, BLUE)), (0, 1, 2))


@_query(
    f"WITH {_LONG} SELECT \"row\", col, band, CASE WHEN abs(value) < 0.01::DOUBLE THEN NULL ELSE value END AS value FROM long "
    "WHERE band IN (3, 5) AND \"row\" % 2 = 0 AND col % 2 = 0"
)
def cube_long_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = cube.to_long(cube.select_bands(cube.stride(pixel_cube(spark, sf_dir), 2), (3, 5)), (3, 5))
    return long.withColumn("value", F.when(F.abs("value") >= 0.01, F.col("value")))


@_query(f"WITH {_CUBE} SELECT \"row\", col, bands[3] AS b0, bands[5] AS b1 FROM cube")
def cube_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = cube.to_wide(cube.to_long(cube.select_bands(pixel_cube(spark, sf_dir), (3, 5))))
    return _named(wide, (0, 1))


@_query(f"WITH {_CUBE} SELECT \"row\", col, CASE WHEN \"row\" % 3 = 0 THEN NULL ELSE bands[1] END AS b0 FROM cube")
def cube_external_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = cube.select_bands(pixel_cube(spark, sf_dir), (1,))
    return _named(cube.with_mask(base, base.select("row", "col", (F.col("row") % 3 == 0).alias("masked"))), (0,))


_BLOCKS_SQL = f"""
WITH {_CUBE}, n AS (SELECT max("row") + 1 AS h FROM cube),
b AS (SELECT *, unnest(range((h + 15) // 16))::INT AS tile_row FROM n),
w AS (
  SELECT tile_row, tile_col::INT AS tile_col, (tile_row * 16)::INT AS row_off, (tile_col * 16)::INT AS col_off,
         least(16, h - tile_row * 16)::INT AS height, least(16, 25 - tile_col * 16)::INT AS width
  FROM b, range(2) c(tile_col)
)
"""


@_query(_BLOCKS_SQL + "SELECT * FROM w")
def block_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cube.blocks(spark, *scene_size(spark, sf_dir), 16, 16)


@_query(_BLOCKS_SQL + "SELECT tile_row, tile_col, (height * width * 9)::BIGINT AS bytes, height * width * 9 > 900 AS over_budget FROM w")
def read_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = cube.read_bytes(F.col("width") * F.col("height"), F.lit(3), F.lit(2), F.lit(True))
    found = cube.blocks(spark, *scene_size(spark, sf_dir), 16, 16)
    return found.select("tile_row", "tile_col", size.alias("bytes"), (size > 900).alias("over_budget"))


# -- bands ------------------------------------------------------------------------------------


_CUBE_BANDS = "b AS (SELECT (i + 1)::INT AS band, 420.0::DOUBLE + 32 * i AS wavelength_nm FROM range(64) r(i))"
#: Parts as bands: their sizes are wavelengths of 410 nm and more.
_PART_BANDS = "b AS (SELECT DISTINCT p_size::INT AS band, 400.0::DOUBLE + 10 * p_size AS wavelength_nm FROM part)"


def _nearest_sql(targets: str, band_table: str, tolerance: float) -> str:
    return (
        f"WITH t AS ({targets}), {band_table}, "
        "r AS (SELECT *, abs(wavelength_nm - target_nm) AS distance_nm, row_number() OVER (PARTITION BY pos "
        "ORDER BY abs(wavelength_nm - target_nm), band) AS n FROM t, b) "
        f"SELECT pos, target_nm, band, wavelength_nm, distance_nm, distance_nm <= {tolerance} AS matched FROM r WHERE n = 1"
    )


def _constant_targets(targets: tuple[float, ...]) -> str:
    return f"SELECT * FROM (VALUES {', '.join(f'({i}::INT, {t}::DOUBLE)' for i, t in enumerate(targets))}) v(pos, target_nm)"


def _part_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size").cast("int")
    return _table(spark, sf_dir, "part").select(size.alias("band"), (F.lit(400.0) + 10 * size).alias("wavelength_nm")).distinct()


@_query(_nearest_sql("SELECT p_partkey::INT AS pos, 300.0::DOUBLE + 60 * p_size AS target_nm FROM part", _CUBE_BANDS, 20))
def nearest_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part asks for the band of the cube that is nearest to its size in units of 60 nm."""
    asked = _table(spark, sf_dir, "part").select(F.col("p_partkey").cast("int").alias("pos"), (F.lit(300.0) + 60 * F.col("p_size")).alias("target_nm"))
    return bands.nearest(asked, bands.band_table(spark, WAVELENGTHS))


@_query(_nearest_sql(_constant_targets(bands.TRUE_COLOR), _PART_BANDS, 30))
def true_color_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bands.nearest(bands.target_table(spark, bands.TRUE_COLOR), _part_bands(spark, sf_dir), bands.COMPOSITE_TOLERANCE)


@_query(_nearest_sql(_constant_targets(bands.FALSE_COLOR), _PART_BANDS, 30))
def false_color_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bands.nearest(bands.target_table(spark, bands.FALSE_COLOR), _part_bands(spark, sf_dir), bands.COMPOSITE_TOLERANCE)


_SUBSET = (
    "WITH s AS (SELECT l_suppkey::BIGINT AS product, l_linenumber::INT AS band, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, "
    "l_linenumber) AS pos FROM lineitem) "
)


@_query(
    _SUBSET + "SELECT product, 'inspect' AS rule, (row_number() OVER (PARTITION BY product ORDER BY band) - 1)::INT AS pos, band FROM "
    "(SELECT DISTINCT product, band FROM s) UNION ALL SELECT product, 'evaluation', (row_number() OVER (PARTITION BY product ORDER BY pos) - 1)::INT, "
    "band FROM (SELECT product, band, min(pos) AS pos FROM s GROUP BY product, band)"
)
def band_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorted without repeats for inspection, in first order without repeats for evaluation: a supplier's line numbers as the bands asked for."""
    item = _table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("long").alias("product"), "l_orderkey", F.col("l_linenumber").cast("int").alias("band"))
    asked = F.transform(F.array_sort(F.collect_list(F.struct("l_orderkey", "band"))), lambda x: x["band"])
    some = item.groupBy("product").agg(F.array_distinct(asked).alias("bands"))
    rules = some.select("product", F.lit("inspect").alias("rule"), F.array_sort("bands").alias("bands")).union(some.select("product", F.lit("evaluation"), "bands"))
    return rules.select("product", "rule", F.posexplode("bands").alias("pos", "band"))


# -- many rasters -----------------------------------------------------------------------------


@_query(
    "WITH p AS (SELECT 'orders_' || (o_orderkey // 1024) AS raster_id, (o_orderkey % 1024 // 32)::INT AS \"row\", unnest([1, 2])::INT AS band, "
    "unnest([o_totalprice, o_custkey::DOUBLE]) AS value FROM orders) "
    "SELECT raster_id, band, count(*)::BIGINT AS count, min(value) AS min, max(value) AS max, round(avg(value), 6) AS mean FROM p "
    "WHERE \"row\" BETWEEN 4 AND 27 GROUP BY ALL"
)
def collection_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each 1,024 orders are the pixels of a raster: tasks write a GeoTIFF for each, and one scan reads a range of rows of all.

    The files are deleted once their statistics, a few rows for each, are settled.
    """
    order = F.col("o_orderkey")
    pixels_of = _table(spark, sf_dir, "orders").select(
        F.concat(F.lit("orders_"), F.floor(order / 1024)).alias("raster_id"), F.floor(order % 1024 / 32).cast("int").alias("row"),
        (order % 32).cast("int").alias("col"), F.array("o_totalprice", F.col("o_custkey").cast("double")).alias("bands"),
    )
    folder = shared_dir(spark, "collection")
    files_in = pixels_of.select("raster_id").distinct().select(
        "raster_id", F.concat(F.lit(folder + "/"), "raster_id", F.lit(".tif")).alias("path"), F.lit(32).alias("width"), F.lit(32).alias("height"),
        F.lit(None).cast("array<double>").alias("transform"), F.lit(None).cast("int").alias("epsg"),
    )
    make_folder(folder)
    try:
        writer.write_collection(pixels_of, files_in, tiff.Raster(count=2, dtype="float64", nodata=-9999.0), tiff.Layout("zstd", 16))
        scan = collection.read(files_in.select("raster_id", "path"), rows=(4, 28), float32=False)
        long = scan.select("raster_id", F.posexplode("bands").alias("pos", "value")).select("raster_id", (F.col("pos") + 1).alias("band"), "value")
        found = long.filter("value IS NOT NULL").groupBy("raster_id", "band").agg(
            F.count("value").alias("count"), F.min("value").alias("min"), F.max("value").alias("max"), F.round(F.avg("value"), 6).alias("mean"),
        )
        report = shared_dir(spark, "collection-statistics")
        found.write.parquet(report)
    finally:
        delete(spark, folder)
    return spark.read.schema(found.schema).parquet(report)


# -- indices, statistics, profiles ------------------------------------------------------------


def _nd_sql(a: int, b: int) -> str:
    return (
        f"SELECT \"row\", col, CASE WHEN isfinite(bands[{a}]) AND isfinite(bands[{b}]) "
        f"AND bands[{a}] + bands[{b}] <> 0 THEN ((bands[{a}] - bands[{b}]) / (bands[{a}] + bands[{b}]))::FLOAT "
        "ELSE -9999::FLOAT END AS value FROM cube"
    )


def index_grid(spark: SparkSession, sf_dir: str, first: int, second: int, nodata: float | None = pixels.INDEX_NODATA) -> DataFrame:
    return pixel_cube(spark, sf_dir).select(
        "row", "col", pixels.normalised_difference(F.col("bands")[first - 1], F.col("bands")[second - 1], nodata).alias("value"),
    )


@_query(f"WITH {_CUBE} {_nd_sql(NIR, RED)}")
def nd_index_ndvi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_grid(spark, sf_dir, NIR, RED)


@_query(f"WITH {_CUBE} {_nd_sql(GREEN, NIR)}")
def nd_index_ndwi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_grid(spark, sf_dir, GREEN, NIR)


def _rounded(df: DataFrame, names: tuple[str, ...] = ("mean", "std", "p2", "p98")) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c in names})


_STATS = (
    "count(value)::BIGINT AS count, min(value) AS min, max(value) AS max, round(avg(value), 9) AS mean, "
    "round(stddev_pop(value), 9) AS std, round(quantile_cont(value, 0.02), 9) AS p2, round(quantile_cont(value, 0.98), "
    "9) AS p98"
)


@_query(
    f"WITH {_CUBE}, v AS (SELECT value::DOUBLE AS value FROM ({_nd_sql(NIR, RED)}) WHERE value <> -9999 AND \"row\" % 2 = 0 "
    f"AND col % 2 = 0) SELECT 1 AS band, {_STATS} FROM v"
)
def nd_index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = cube.stride(index_grid(spark, sf_dir, NIR, RED, None), 2)
    return _rounded(stats.summarise(grid.select(F.lit(1).alias("band"), F.col("value").cast("double").alias("value"))))


@_query(f"WITH {_LONG} SELECT band, {_STATS} FROM long WHERE isfinite(value) GROUP BY band")
def band_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(stats.summarise(cube.to_long(pixel_cube(spark, sf_dir))))


@_query(
    f"WITH {_LONG} SELECT band, q, round(value, 9) AS value FROM (SELECT band, 0.02::DOUBLE AS q, quantile_cont(value, "
    "0.02) AS value FROM long GROUP BY band UNION ALL SELECT band, 0.5, quantile_cont(value, 0.5) FROM long GROUP BY band "
    "UNION ALL SELECT band, 0.98, quantile_cont(value, 0.98) FROM long GROUP BY band)"
)
def exact_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stats.exact_percentiles(cube.to_long(pixel_cube(spark, sf_dir)), percentiles=(0.02, 0.5, 0.98), cells=64)
    return found.select("band", "q", F.round("value", 9).alias("value"))


_TALL = (
    "tall AS (SELECT l_orderkey, unnest([l_quantity, l_extendedprice, l_discount, l_tax]) AS value, unnest([1, 2, 3, "
    "4])::INT AS band FROM lineitem)"
)


@_query(
    f"WITH {_TALL} SELECT band, count(value)::BIGINT AS count, min(value) AS min, max(value) AS max, round(avg(value), "
    "5) AS mean, round(stddev_pop(value), 5) AS std, round(quantile_cont(value, 0.02), 5) AS p2, round(quantile_cont(value, "
    "0.98), 5) AS p98 FROM tall GROUP BY band"
)
def tall_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = tall_cube(spark, sf_dir).select(F.posexplode("bands").alias("pos", "value")).select((F.col("pos") + 1).alias("band"), "value")
    out = stats.summarise(long)
    return out.withColumns({c: F.round(c, 5) for c in ("mean", "std", "p2", "p98")})


@_query(
    "WITH v AS (SELECT l_orderkey, CASE "
    "WHEN l_discount + l_tax <> 0 THEN ((l_discount - l_tax) / (l_discount + l_tax))::FLOAT ELSE -9999::FLOAT END AS value "
    "FROM lineitem) SELECT l_orderkey, count(*)::BIGINT AS n, max(value) AS value FROM v GROUP BY l_orderkey"
)
def tall_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = pixels.normalised_difference(F.col("bands")[2], F.col("bands")[3])
    return tall_cube(spark, sf_dir).select("l_orderkey", value.alias("value")).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("value"))


@_query(
    f"WITH {_LONG} SELECT band, 420.0::DOUBLE + 32 * (band - 1) AS wavelength_nm, round(avg(value), 9) AS value, "
    "count(value)::BIGINT AS n FROM long WHERE \"row\" BETWEEN 4 AND 6 AND col BETWEEN 6 AND 8 GROUP BY band"
)
def spectral_profile_3x3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stats.profile(pixel_cube(spark, sf_dir), 5, 7, 3)
    return found.select((F.col("pos") + 1).alias("band"), (420.0 + 32.0 * F.col("pos")).alias("wavelength_nm"), F.round("value", 9).alias("value"), "n")


@_query(
    f"WITH {_LONG} SELECT (CASE band WHEN 14 THEN 0 WHEN 9 THEN 1 ELSE 2 END)::INT AS pos, round(avg(value), 9) AS value, "
    "count(value)::BIGINT AS n FROM long WHERE \"row\" BETWEEN 0 AND 2 AND col BETWEEN 0 AND 2 AND band IN (14, 9, 5) "
    "GROUP BY band"
)
def spectral_profile_corner(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stats.profile(pixel_cube(spark, sf_dir), 0, 0, 5, (NIR, RED, GREEN))
    return found.select("pos", F.round("value", 9).alias("value"), "n")


# -- quality ----------------------------------------------------------------------------------


@_query(f"WITH {_CLASSES} SELECT * FROM classes")
def quality_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(pixel_cube(spark, sf_dir), **QUALITY)


_COUNTS = (
    "SELECT n.class, n.name, count(c.class)::BIGINT AS count, 100.0::DOUBLE * count(c.class) / (SELECT count(*) "
    "FROM classes) AS percentage FROM names n LEFT JOIN classes c ON c.class = n.class GROUP BY ALL"
)


@_query(f"WITH {_CLASSES}, {_NAMES} SELECT class, name, count FROM ({_COUNTS})")
def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.class_counts(quality.classify(pixel_cube(spark, sf_dir), **QUALITY)).drop("percentage")


@_query(f"WITH {_CLASSES}, {_NAMES} SELECT name, round(percentage, 9) AS percentage FROM ({_COUNTS})")
def quality_percentages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.class_counts(quality.classify(pixel_cube(spark, sf_dir), **QUALITY)).select("name", F.round("percentage", 9).alias("percentage"))


@_query(
    f"WITH {_CUBE}, m AS (SELECT *, list_avg({_MASK_BANDS_SQL}) AS mean, list_stddev_pop({_MASK_BANDS_SQL}) AS std, "
    f"{_class_sql(_MASK_BANDS_SQL, 0.9, -0.9, 0.5)} AS base FROM cube) SELECT \"row\", col, CASE WHEN base = 1 AND mean > 0 "
    "AND std / mean > 2.0::DOUBLE THEN 5 ELSE base END::SMALLINT AS class FROM m"
)
def quality_anomaly(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = cube.select_bands(pixel_cube(spark, sf_dir), MASK_BANDS)
    return quality.classify(chosen, saturation=0.9, low_signal=-0.9, fraction=0.5, anomaly=True)


def _defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(cube.select_bands(pixel_cube(spark, sf_dir), MASK_BANDS), **DEFECTS)


_RECT_3 = "o(y, x) AS (SELECT y, x FROM range(-1, 2) a(y), range(-1, 2) b(x))"
_CROSS_5 = "o(y, x) AS (SELECT y, x FROM range(-2, 3) a(y), range(-2, 3) b(x) WHERE y = 0 OR x = 0)"


def _dilate_sql(offsets: str) -> str:
    return (
        f"WITH {_DEFECTS}, {offsets}, r AS (SELECT \"row\" + y AS \"row\", col + x AS col, min(CASE class WHEN 4 THEN 0 "
        "WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 5 THEN 3 END) AS rank FROM classes, o WHERE class IN (2, 3, 4, 5) GROUP BY ALL) "
        "SELECT c.\"row\", c.col, (CASE WHEN class = 1 AND rank IS NOT NULL THEN CASE rank WHEN 0 THEN 4 WHEN 1 THEN 2 "
        "WHEN 2 THEN 3 ELSE 5 END ELSE class END)::SMALLINT AS class FROM classes c LEFT JOIN r ON r.\"row\" = c.\"row\" "
        "AND r.col = c.col"
    )


@_query(_dilate_sql(_RECT_3))
def quality_dilate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.grow(_defects(spark, sf_dir), "dilate", "rect", 3)


@_query(_dilate_sql(_CROSS_5))
def quality_dilate_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.grow(_defects(spark, sf_dir), "dilate", "cross", 5)


@_query(f"WITH {_DEFECTS} SELECT * FROM classes")
def quality_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.grow(_defects(spark, sf_dir), "open")


@_query(
    f"WITH {_DEFECTS}, o AS (SELECT y::INT AS y, x::INT AS x FROM range(-1, 2) a(y), range(-1, 2) b(x)), "
    "d AS (SELECT DISTINCT c.\"row\" + y AS \"row\", c.col + x AS col, class FROM classes c, o WHERE class IN (2, 3, 4, 5)), "
    "i AS (SELECT d.* FROM d SEMI JOIN classes c ON c.\"row\" = d.\"row\" AND c.col = d.col), "
    "e AS (SELECT i.\"row\", i.col, i.class FROM i, o JOIN classes g ON true WHERE g.\"row\" = i.\"row\" + y "
    "AND g.col = i.col + x AND NOT EXISTS (SELECT 1 FROM i j WHERE j.\"row\" = g.\"row\" AND j.col = g.col "
    "AND j.class = i.class)), "
    "k AS (SELECT i.* FROM i ANTI JOIN e ON e.\"row\" = i.\"row\" AND e.col = i.col AND e.class = i.class), "
    "r AS (SELECT \"row\", col, min(CASE class WHEN 4 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 2 ELSE 3 END) AS rank FROM k GROUP BY ALL) "
    "SELECT c.\"row\", c.col, (CASE WHEN class = 1 AND rank IS NOT NULL THEN CASE rank WHEN 0 THEN 4 WHEN 1 THEN 2 "
    "WHEN 2 THEN 3 ELSE 5 END ELSE class END)::SMALLINT AS class FROM classes c LEFT JOIN r ON r.\"row\" = c.\"row\" "
    "AND r.col = c.col"
)
def quality_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.grow(_defects(spark, sf_dir), "close", "rect", 3)


@_query("WITH t AS (SELECT [l_quantity, l_extendedprice, l_discount, l_tax] AS bands FROM lineitem), classes AS (SELECT " + _class_sql("bands", 50_000, 0.01, 0.25) + f" AS class FROM t), {_NAMES} SELECT class, name, count, round(percentage, 9) AS percentage FROM ({_COUNTS})")
def tall_quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = tall_cube(spark, sf_dir).select(pixels.quality_class(F.col("bands"), 50_000, 0.01, 0.25).alias("class"))
    return quality.class_counts(classes).withColumn("percentage", F.round("percentage", 9))


# -- previews and resampling ------------------------------------------------------------------


def _stretch_sql(limits: str, on: str) -> str:
    level = lambda i: f"round_even(least(greatest((bands[{i}] - l{i}.low) / (l{i}.high - l{i}.low) * 255.0::DOUBLE, 0), 255), 0)::SMALLINT"
    joins = ", ".join(f"(SELECT * FROM limits {on.format(i=i)}) l{i}" for i in (9, 5, 3))
    return (
        f"WITH {_LONG}, p AS ({limits}), limits AS (SELECT band, low, CASE WHEN high <= low THEN low + 1 ELSE high END AS high "
        f"FROM p) SELECT \"row\", col, {level(9)} AS r, {level(5)} AS g, {level(3)} AS b FROM cube, {joins}"
    )


_QUANTILES = "round(quantile_cont(value, 0.02), 9) AS low, round(quantile_cont(value, 0.98), 9) AS high FROM long WHERE band IN (9, 5, 3)"


def _image(df: DataFrame) -> DataFrame:
    return df.select("row", "col", *[F.col("image")[i].alias(c) for i, c in enumerate("rgb")])


@_query(_stretch_sql(f"SELECT band, {_QUANTILES} GROUP BY band", "WHERE band = {i}"))
def stretch_per_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _image(resample.composite(pixel_cube(spark, sf_dir), (RED, GREEN, BLUE), digits=9))


@_query(_stretch_sql(f"SELECT 0 AS band, {_QUANTILES}", ""))
def stretch_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _image(resample.composite(pixel_cube(spark, sf_dir), (RED, GREEN, BLUE), per_band=False, digits=9))


def _larger(height: int) -> tuple[int, int]:
    """Target grid of 40 columns, and three rows for every two of the source."""
    return 40, height * 3 // 2


def _smaller(height: int) -> tuple[int, int]:
    """Target grid of 10 columns, and two rows for every five of the source."""
    return 10, height * 2 // 5


def _red(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cube.to_long(cube.select_bands(pixel_cube(spark, sf_dir), (RED,)), (RED,))


#: The height of the cube, and of the larger and the smaller target.
_HEIGHTS = (
    _CUBE
    + ", heights AS (SELECT max(\"row\") + 1 AS h, (max(\"row\") + 1) * 3 // 2 AS larger, "
    "(max(\"row\") + 1) * 2 // 5 AS smaller FROM cube)"
)
_LARGER = (
    "g AS (SELECT out_row, out_col::INT AS out_col, (out_row + 0.5::DOUBLE) * (h::DOUBLE / larger) - 0.5::DOUBLE AS y, "
    "(out_col + 0.5::DOUBLE) * (25.0::DOUBLE / 40) - 0.5::DOUBLE AS x FROM (SELECT *, unnest(range(larger))::INT AS out_row "
    "FROM heights), range(40) c(out_col))"
)


def _warp_sql(method: str) -> str:
    taps = {"nearest": "(0)", "bilinear": "(0), (1)", "cubic": "(-1), (0), (1), (2)"}[method]
    cubic = "CASE WHEN abs({0}) <= 1 THEN 1.5::DOUBLE * abs({0}) ** 3 - 2.5::DOUBLE * abs({0}) ** 2 + 1 WHEN abs({0}) < 2 THEN -0.5::DOUBLE * abs({0}) ** 3 + 2.5::DOUBLE * abs({0}) ** 2 - 4 * abs({0}) + 2 ELSE 0 END"
    weight = {"nearest": "1.0::DOUBLE", "bilinear": "1 - abs({0})", "cubic": cubic}[method]
    base = "floor({0} + 0.5)" if method == "nearest" else "floor({0})"
    return (
        f"WITH {_HEIGHTS}, {_LARGER}, k(d) AS (VALUES {taps}), "
        f"t AS (SELECT out_row, out_col, {base.format('y')} + a.d AS r, {base.format('x')} + b.d AS c, y, x FROM g, k a, k b), "
        f"w AS (SELECT *, ({weight.format('(r - y)')}) * ({weight.format('(c - x)')}) AS weight FROM t) "
        'SELECT out_row, out_col, 9 AS band, round(sum(weight * bands[9]) / sum(weight), 9) AS value FROM w '
        'JOIN cube s ON s."row" = r AND s.col = c GROUP BY out_row, out_col'
    )


def _places(spark: SparkSession, source: tuple[int, int]) -> DataFrame:
    target = _larger(source[1])
    return resample.scale_places(resample.target_grid(spark, *target), source, target)


def _warped(spark: SparkSession, sf_dir: str, method: str) -> DataFrame:
    source = scene_size(spark, sf_dir)
    return resample.warp(_places(spark, source), _red(spark, sf_dir), method, *source).withColumn("value", F.round("value", 9))


def _warped_in_tiles(spark: SparkSession, sf_dir: str, method: str) -> DataFrame:
    """By the operator that the services use; tiles of 16 pixels, so that taps cross their edges."""
    source = scene_size(spark, sf_dir)
    one = cube.select_bands(pixel_cube(spark, sf_dir), (RED,))
    found = resample.warp_tiles(_places(spark, source), one, 1, method, *source, block=16)
    value = F.round(F.col("bands")[0], 9)
    return found.select(
        F.col("row").alias("out_row"), F.col("col").alias("out_col"), F.lit(RED).alias("band"), value.alias("value"),
    ).filter(F.col("value").isNotNull())


@_query(_warp_sql("nearest"))
def resample_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _warped(spark, sf_dir, "nearest")


@_query(_warp_sql("bilinear"))
def resample_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _warped(spark, sf_dir, "bilinear")


@_query(_warp_sql("cubic"))
def resample_cubic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _warped(spark, sf_dir, "cubic")


@_query(_warp_sql("nearest"))
def resample_tiles_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _warped_in_tiles(spark, sf_dir, "nearest")


@_query(_warp_sql("bilinear"))
def resample_tiles_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _warped_in_tiles(spark, sf_dir, "bilinear")


@_query(_warp_sql("cubic"))
def resample_tiles_cubic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _warped_in_tiles(spark, sf_dir, "cubic")


@_query(
    f"WITH {_HEIGHTS}, g AS (SELECT *, unnest(range(smaller))::INT AS \"row\" FROM heights) "
    'SELECT g."row", c.col::INT AS col, bands[9] AS b0 FROM g, range(10) c(col) '
    'JOIN cube s ON s."row" = floor((g."row" + 0.5::DOUBLE) * (h::DOUBLE / smaller)) '
    'AND s.col = floor((c.col + 0.5::DOUBLE) * (25.0::DOUBLE / 10))'
)
def decimated_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = scene_size(spark, sf_dir)
    return _named(resample.decimate(cube.select_bands(pixel_cube(spark, sf_dir), (RED,)), source, _smaller(source[1])), (0,))


@_query(
    f"WITH {_CUBE} SELECT c.\"row\", c.col, 9 AS band, round(avg(n.bands[9]), 9) AS value, count(*)::BIGINT AS n FROM cube c JOIN cube n ON "
    "n.\"row\" BETWEEN c.\"row\" - 3 AND c.\"row\" + 3 AND n.col BETWEEN c.col - 3 AND c.col + 3 GROUP BY ALL"
)
def neighborhood_mean_7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.neighborhood_mean(_red(spark, sf_dir), 7).withColumn("value", F.round("value", 9))


@_query(
    f"WITH {_CUBE} SELECT (\"row\" // 5)::INT AS \"row\", (col // 5)::INT AS col, 9 AS band, round(avg(bands[9]), 9) AS value "
    "FROM cube GROUP BY ALL"
)
def block_mean_downsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.block_mean(_red(spark, sf_dir), 5).withColumn("value", F.round("value", 9))


@_query(
    f"WITH {_HEIGHTS}, s AS (SELECT cube.*, smaller::DOUBLE / h AS ratio, smaller FROM cube, heights), d AS ("
    "SELECT unnest([0, 1, 2]) AS d), "
    'w AS (SELECT (floor("row" * ratio) + a.d)::INT AS r, (floor(col * 0.4::DOUBLE) + b.d)::INT AS c, * FROM s, d a, d b), '
    'x AS (SELECT r, c, bands[9] AS v, (least(r + 1, ("row" + 1) * ratio) - greatest(r, "row" * ratio)) AS wr, (least(c + 1, '
    '(col + 1) * 0.4::DOUBLE) - greatest(c, col * 0.4::DOUBLE)) AS wc FROM w WHERE r < smaller AND c < 10) '
    'SELECT r AS "row", c AS col, 9 AS band, round(sum(v * wr * wc) / sum(wr * wc), 9) AS value FROM x WHERE wr > 1e-9 '
    'AND wc > 1e-9 GROUP BY r, c'
)
def area_mean_downsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = scene_size(spark, sf_dir)
    return resample.area_mean(_red(spark, sf_dir), source, _smaller(source[1])).withColumn("value", F.round("value", 9))


_K3 = "k(d, w) AS (VALUES (-1, 0.25::DOUBLE), (0, 0.5::DOUBLE), (1, 0.25::DOUBLE))"


@_query(
    f'WITH {_CUBE}, {_K3}, s AS (SELECT "row", col, bands[9] AS v FROM cube), '
    'y AS (SELECT "row" + d AS "row", col, sum(v * w) / sum(w) AS v FROM s, k GROUP BY "row" + d, col), y2 AS (SELECT y.* '
    'FROM y SEMI JOIN s ON s."row" = y."row" AND s.col = y.col), '
    'x AS (SELECT "row", col + d AS col, sum(v * w) / sum(w) AS v FROM y2, k GROUP BY "row", col + d) '
    'SELECT x."row"::INT AS "row", x.col::INT AS col, 9 AS band, round(v, 9) AS value FROM x SEMI '
    'JOIN s ON s."row" = x."row" AND s.col = x.col'
)
def gaussian_blur_3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.gaussian_blur(_red(spark, sf_dir), 3).withColumn("value", F.round("value", 9))


# -- scalars ----------------------------------------------------------------------------------


@_query(
    "WITH p AS (SELECT c_custkey, (c_custkey * 37 % 400 - 200) + 0.5::DOUBLE AS lon, "
    "(c_custkey * 11 % 190 - 95) + 0.25::DOUBLE AS lat FROM customer) SELECT c_custkey, CASE WHEN lat BETWEEN -80 AND 84 "
    "AND lon BETWEEN -180 AND 180 THEN (least(greatest(floor((lon + 180) / 6) + 1, 1), 60) + CASE WHEN lat >= 0 THEN 32600 "
    "ELSE 32700 END)::INT END AS epsg FROM p"
)
def utm_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return _table(spark, sf_dir, "customer").select(
        "c_custkey", geo.utm_epsg((k * 37) % 400 - 200 + F.lit(0.5), (k * 11) % 190 - 95 + F.lit(0.25)).alias("epsg"),
    )


@_query("SELECT p_partkey, replace(rtrim(rtrim(printf('%.6f', p_size / 8.0::DOUBLE), '0'), '.'), '.', 'p') || 'm' AS token FROM part")
def resolution_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select("p_partkey", text.resolution_token(F.col("p_size") / F.lit(8.0)).alias("token"))


@_query(
    "SELECT p_partkey, CASE WHEN s = '' THEN 'product' ELSE s END AS slug FROM (SELECT p_partkey, "
    "trim(regexp_replace(lower(p_type || ' (' || p_brand || ')-' || p_name), '[^a-z0-9]+', '_', 'g'), '_') AS s FROM part)"
)
def product_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat("p_type", F.lit(" ("), "p_brand", F.lit(")-"), "p_name", F.lit(".tif"))
    return _table(spark, sf_dir, "part").select("p_partkey", text.product_slug(F.concat(F.lit("/data/in/"), name)).alias("slug"))


@_query(
    "WITH b AS (SELECT o_orderkey, (o_orderkey % 1000) * (1024::BIGINT ** (o_orderkey % 5))::BIGINT AS n FROM orders) "
    "SELECT o_orderkey, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1024 ** 2 THEN printf('%.1f KiB', n / 1024.0::DOUBLE) "
    "WHEN n < 1024 ** 3 THEN printf('%.1f MiB', n / 1048576.0::DOUBLE) WHEN n < 1024::DOUBLE ** 4 THEN printf('%.1f GiB', "
    "n / 1073741824.0::DOUBLE) ELSE printf('%.1f TiB', n / 1099511627776.0::DOUBLE) END AS size FROM b"
)
def format_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = (F.col("o_orderkey") % 1000) * F.pow(F.lit(1024), F.col("o_orderkey") % 5).cast("long")
    return _table(spark, sf_dir, "orders").select("o_orderkey", text.format_bytes(n).alias("size"))


#: Seven kinds of bands from the parts: tags in either case and unit, the imagery domain, descriptions, nothing.
_WAVELENGTH_SQL = """
WITH p AS (SELECT p_partkey, p_partkey % 7 AS kind, p_size::DOUBLE AS s FROM part),
w AS (SELECT *, CASE kind WHEN 0 THEN 400 + s WHEN 1 THEN s / 10 * 1000 WHEN 2 THEN s / 10 * 1000 WHEN 3 THEN 500 + s WHEN 4 THEN 600 + s WHEN 5 THEN s END AS nm FROM p)
SELECT p_partkey, round(nm, 6) AS nm, CASE kind WHEN 2 THEN 'imagery_domain' WHEN 4 THEN 'description' ELSE 'band_tag' END AS source
FROM w WHERE nm BETWEEN 100 AND 30000
UNION ALL SELECT p_partkey, NULL, NULL FROM w WHERE nm IS NULL OR nm NOT BETWEEN 100 AND 30000
"""


@_query(_WAVELENGTH_SQL)
def wavelength_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, size = F.col("p_partkey") % 7, F.col("p_size")
    text_of = lambda c: c.cast("string")
    no_tags = F.create_map().cast("map<string,string>")
    tags = (
        F.when(kind == 0, F.create_map(F.lit("WAVELENGTH"), text_of(size + 400)))
        .when(kind == 1, F.create_map(F.lit("wavelength"), text_of(size / 10), F.lit("wavelength_units"), F.lit(" "), F.lit("WAVELENGTH_UNIT"), F.lit("um")))
        .when(kind == 2, F.create_map(F.lit("wavelength"), F.lit("none")))
        .when(kind == 3, F.create_map(F.lit("Wavelength"), F.lit("1"), F.lit("wavelength"), text_of(size + 500)))
        .when(kind == 5, F.create_map(F.lit("central_wavelength"), text_of(size), F.lit("wavelength_units"), F.lit("nm")))
        .otherwise(no_tags)
    )
    imagery = F.when(kind == 2, F.create_map(F.lit("CENTRAL_WAVELENGTH_UM"), text_of(size / 10))).otherwise(no_tags)
    described = F.when(kind == 4, F.concat(F.lit("band 3 ("), text_of(size + 600), F.lit(" nm)"))).otherwise(F.lit("no number here"))
    found = _table(spark, sf_dir, "part").select("p_partkey", text.wavelength_nm(tags, imagery, described).alias("w"))
    return found.select("p_partkey", F.round("w.nm", 6).alias("nm"), "w.source")


@_query(
    "WITH b AS (SELECT s_suppkey, s_suppkey % 20 AS l, s_suppkey % 7 AS w FROM supplier) SELECT s_suppkey, NOT (l + w < 8 "
    "OR l > 12 OR l + w < 9 OR l > 14) AS meets FROM b"
)
def bounds_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, wide = F.col("s_suppkey") % 20, F.col("s_suppkey") % 7
    return _table(spark, sf_dir, "supplier").select(
        "s_suppkey", geo.overlap((left, left, left + wide, left + wide), (F.lit(8), F.lit(9), F.lit(12), F.lit(14))).alias("meets"),
    )


# -- maps -------------------------------------------------------------------------------------


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return _table(spark, sf_dir, "customer").select(
        "c_custkey", (F.lit(6.0) + (k % 61) / F.lit(10.0)).alias("lon"), ((k % 1000) * F.lit(0.16) - 79.0).alias("lat"),
    )


#: The projection's series in the third flattening n, written out once more for SQL.
_UTM_SQL = """
WITH e AS (SELECT 1 / 298.257223563::DOUBLE AS f),
n AS (SELECT f / (2 - f) AS n FROM e),
k AS (
  SELECT 6378137.0::DOUBLE / (1 + n) * (1 + n ** 2 / 4 + n ** 4 / 64) AS radius, 2 * sqrt(n) / (1 + n) AS ecc,
         n / 2 - 2 * n ** 2 / 3 + 5 * n ** 3 / 16 + 41 * n ** 4 / 180 AS a1, 13 * n ** 2 / 48 - 3 * n ** 3 / 5 + 557 * n ** 4 / 1440 AS a2,
         61 * n ** 3 / 240 - 103 * n ** 4 / 140 AS a3, 49561 * n ** 4 / 161280 AS a4 FROM n
),
p AS (SELECT c_custkey, 6.0::DOUBLE + (c_custkey % 61) / 10.0::DOUBLE AS lon, (c_custkey % 1000) * 0.16::DOUBLE - 79.0::DOUBLE AS lat FROM customer),
a AS (SELECT *, radians(lon - 9.0::DOUBLE) AS lam, sinh(atanh(sin(radians(lat))) - ecc * atanh(ecc * sin(radians(lat)))) AS t FROM p, k),
b AS (SELECT *, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta FROM a)
SELECT c_custkey,
  round(500000 + 0.9996::DOUBLE * radius * (eta + a1 * cos(2 * xi) * sinh(2 * eta) + a2 * cos(4 * xi) * sinh(4 * eta) + a3 * cos(6 * xi) * sinh(6 * eta) + a4 * cos(8 * xi) * sinh(8 * eta)), 4) AS easting,
  round(0.9996::DOUBLE * radius * (xi + a1 * sin(2 * xi) * cosh(2 * eta) + a2 * sin(4 * xi) * cosh(4 * eta) + a3 * sin(6 * xi) * cosh(6 * eta) + a4 * sin(8 * xi) * cosh(8 * eta)), 4) AS northing
FROM b
"""


@_query(_UTM_SQL)
def utm_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    east, north = geo.utm_forward(F.col("lon"), F.col("lat"), 32632)
    return _customers(spark, sf_dir).select("c_custkey", F.round(east, 4).alias("easting"), F.round(north, 4).alias("northing"))


@_query(
    "SELECT c_custkey, round(6.0::DOUBLE + (c_custkey % 61) / 10.0::DOUBLE, 8) AS lon, "
    "round((c_custkey % 1000) * 0.16::DOUBLE - 79.0::DOUBLE, 8) AS lat FROM customer"
)
def utm_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    east, north = geo.utm_forward(F.col("lon"), F.col("lat"), 32632)
    there = _customers(spark, sf_dir).select("c_custkey", east.alias("e"), north.alias("n"))
    lon, lat = geo.utm_inverse(F.col("e"), F.col("n"), 32632)
    return there.select("c_custkey", F.round(lon, 8).alias("lon"), F.round(lat, 8).alias("lat"))


def toy_rpc(full: bool = False, height: int = 20) -> dict:
    """A sensor model over (9.95, 44.95, 10.05, 45.05) for a scene of 25 columns and ``height`` rows."""
    one = [1.0] + [0.0] * 19
    line, samp = [0.0] * 20, [0.0] * 20
    line[2], samp[1] = 1.0, 1.0
    if full:
        line[3], line[7], samp[4], samp[19] = 0.02, 0.01, 0.015, -0.003
        one = [1.0, 0.001, -0.002] + [0.0] * 17
    middle = (height - 1) / 2
    return {
        "line_off": middle, "samp_off": 12.0, "lat_off": 45.0, "long_off": 10.0, "height_off": 300.0, "line_scale": middle, "samp_scale": 12.0,
        "lat_scale": 0.05, "long_scale": 0.05, "height_scale": 500.0, "line_num": line, "line_den": one, "samp_num": samp, "samp_den": one,
    }


_RPC = (
    "n AS (SELECT *, (lon - 10.0::DOUBLE) / 0.05::DOUBLE AS l, (lat - 45.0::DOUBLE) / 0.05::DOUBLE AS p, "
    "(h - 300.0::DOUBLE) / 500.0::DOUBLE AS z FROM g), "
    "q AS (SELECT *, "
    "(p + 0.02::DOUBLE * z + 0.01::DOUBLE * l * l) / (1 + 0.001::DOUBLE * l - 0.002::DOUBLE * p) * 9.5::DOUBLE + 9.5::DOUBLE AS line, "
    "(l + 0.015::DOUBLE * l * p - 0.003::DOUBLE * z * z * z) / (1 + 0.001::DOUBLE * l - 0.002::DOUBLE * p) * 12.0::DOUBLE + 12.0::DOUBLE AS sample "
    "FROM n)"
)


@_query(
    "WITH g AS (SELECT c_custkey, 9.95::DOUBLE + (c_custkey % 101) * 0.001::DOUBLE AS lon, "
    f"44.95::DOUBLE + (c_custkey % 97) * 0.001::DOUBLE AS lat, (c_custkey % 900)::DOUBLE AS h FROM customer), {_RPC} "
    "SELECT c_custkey, round(line, 7) AS line, round(sample, 7) AS sample FROM q"
)
def rpc_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    line, sample = geo.rpc_project(toy_rpc(True), 9.95 + (k % 101) * F.lit(0.001), 44.95 + (k % 97) * F.lit(0.001), (k % 900).cast("double"))
    return _table(spark, sf_dir, "customer").select("c_custkey", F.round(line, 7).alias("line"), F.round(sample, 7).alias("sample"))


#: Elevations are the first band of the cube, posts of 0.005 degrees of longitude over 0.1 degrees of latitude.
_ORTHO_SQL = (
    f"WITH {_HEIGHTS}, o AS (SELECT out_row, c.out_col::INT AS out_col, "
    "9.94::DOUBLE + (c.out_col + 0.5::DOUBLE) * 0.004::DOUBLE AS lon, "
    "45.06::DOUBLE - (out_row + 0.5::DOUBLE) * (0.12::DOUBLE / larger) AS lat, h AS tall FROM (SELECT *, "
    "unnest(range(larger))::INT AS out_row FROM heights), range(30) c(out_col)), "
    'g AS (SELECT o.*, 300.0::DOUBLE + 1000.0::DOUBLE * d.bands[1] AS h FROM o '
    'JOIN cube d ON d."row" = floor((lat - 45.06::DOUBLE) / -(0.1::DOUBLE / tall)) '
    'AND d.col = floor((lon - 9.94::DOUBLE) / 0.005::DOUBLE)), '
    f"{_RPC.replace('9.5::DOUBLE', '((tall - 1) / 2.0::DOUBLE)')} "
    'SELECT out_row, out_col, 9 AS band, round(s.bands[9], 9) AS value FROM q '
    'JOIN cube s ON s."row" = floor(line + 0.5::DOUBLE) AND s.col = floor(sample + 0.5::DOUBLE)'
)


def _ortho_places(spark: SparkSession, sf_dir: str, source: tuple[int, int]) -> DataFrame:
    """Ground points of 30 columns with their heights."""
    rows = _larger(source[1])[1]
    dem = cube.to_long(cube.select_bands(pixel_cube(spark, sf_dir), (1,))).select("row", "col", (300.0 + 1000.0 * F.col("value")).alias("height"))
    grid = ortho.ground_points(resample.target_grid(spark, 30, rows), (0.004, 0.0, 9.94, 0.0, -(0.12 / max(rows, 1)), 45.06), None)
    return ortho.with_height(grid, dem, (0.005, 0.0, 9.94, 0.0, -(0.1 / max(source[1], 1)), 45.06))


@_query(_ORTHO_SQL)
def ortho_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = scene_size(spark, sf_dir)
    high = _ortho_places(spark, sf_dir, source)
    return ortho.orthorectify(high, _red(spark, sf_dir), toy_rpc(True, source[1]), "nearest", *source).withColumn("value", F.round("value", 9))


@_query(_ORTHO_SQL)
def ortho_tiles_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the operator that the services use."""
    source = scene_size(spark, sf_dir)
    places = ortho.image_places(_ortho_places(spark, sf_dir, source), toy_rpc(True, source[1]))
    found = resample.warp_tiles(places, cube.select_bands(pixel_cube(spark, sf_dir), (RED,)), 1, "nearest", *source, block=16)
    value = F.round(F.col("bands")[0], 9)
    return found.select(
        F.col("row").alias("out_row"), F.col("col").alias("out_col"), F.lit(RED).alias("band"), value.alias("value"),
    ).filter(F.col("value").isNotNull())


# -- checks -----------------------------------------------------------------------------------


def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog with every kind of fault, a raster per part."""
    k, size = F.col("p_partkey"), F.col("p_size")
    some = lambda *values: F.array(*[F.lit(v) if v is None or isinstance(v, float) else v for v in values]).cast("array<double>")
    waves = F.when(k % 6 == 0, some()).when(k % 6 == 1, some(420.0, None, 560.0)).when(k % 6 == 2, some(420.0, 560.0, 480.0, 480.0)).otherwise(some(size + 420.0, size + 480.0, size + 560.0))
    return _table(spark, sf_dir, "part").select(
        k.cast("string").alias("raster_id"), ((size % 7) * 100).alias("width"), size.alias("height"), (k % 4).cast("int").alias("band_count"), F.when(k % 3 == 0, 0.0).alias("nodata"), (k % 5 == 0).alias("nodata_is_nan"),
        (k % 2 == 0).alias("has_affine"), (k % 3 != 1).alias("crs_defined"), (k % 4 < 2).alias("rpc_available"), (k % 8 == 0).alias("rpc_usable"), waves.alias("wavelengths"), (F.floor("p_retailprice") * 10_000_000).alias("estimated_bytes"),
    )


_CHECK_SQL = """
WITH p AS (SELECT p_partkey AS k, p_size AS s, floor(p_retailprice) * 10000000.0::DOUBLE / 1073741824.0::DOUBLE AS gib FROM part),
c AS (
  SELECT k::VARCHAR AS raster_id, unnest(['raster_dimensions', 'band_count', 'nodata_configured', 'rpc_metadata', 'georeferencing', 'wavelength_metadata', 'product_size']) AS name,
    unnest([
      CASE WHEN s % 7 > 0 AND s > 0 THEN 'passed' ELSE 'failed' END,
      CASE WHEN k % 4 > 0 THEN 'passed' ELSE 'failed' END,
      CASE WHEN k % 3 = 0 OR k % 5 = 0 THEN 'passed' ELSE 'warning' END,
      CASE WHEN k % 4 >= 2 THEN 'skipped' WHEN k % 8 = 0 THEN 'passed' ELSE 'warning' END,
      CASE WHEN k % 2 = 0 AND k % 3 <> 1 OR k % 4 < 2 THEN 'passed' ELSE 'failed' END,
      CASE WHEN k % 6 <= 2 THEN 'warning' ELSE 'passed' END,
      CASE WHEN gib > 16 THEN 'failed' ELSE 'passed' END
    ]) AS status FROM p
)
"""


@_query(_CHECK_SQL + "SELECT * FROM c")
def validation_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.catalog_checks(_catalog(spark, sf_dir)).select("raster_id", "name", "status")


@_query(_CHECK_SQL + "SELECT raster_id, count_if(status = 'passed')::BIGINT AS passed, count_if(status = 'warning')::BIGINT AS warnings, count_if(status = 'failed')::BIGINT AS failed, count_if(status = 'skipped')::BIGINT AS skipped, count_if(status = 'failed') = 0 AS is_valid FROM c GROUP BY raster_id")
def validation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.summary(checks.catalog_checks(_catalog(spark, sf_dir)))


@_query(
    "WITH w AS (SELECT o_custkey, o_totalprice, lag(o_totalprice) OVER (PARTITION BY o_custkey "
    "ORDER BY o_orderkey) AS before FROM orders) SELECT o_custkey, coalesce(count_if(o_totalprice <= before), "
    "0)::BIGINT AS steps FROM w GROUP BY o_custkey"
)
def non_monotonic_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("band"), F.col("o_totalprice").alias("wavelength_nm"))
    return checks.non_monotonic(orders, ["o_custkey"])


@_query()
def file_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of the tables by kind; a path has no SQL counterpart."""
    from .sources.files import inventory

    return inventory(spark, sf_dir).groupBy("kind").agg(F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("size_bytes"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels and mean vegetation index by quality class."""
    c = pixel_cube(spark, sf_dir)
    both = c.select(
        pixels.quality_class(F.col("bands"), **QUALITY).alias("class"),
        pixels.ndvi(F.col("bands")[NIR - 1], F.col("bands")[RED - 1], None).alias("ndvi"),
    )
    return both.groupBy("class").agg(F.count(F.lit(1)).alias("pixels"), F.avg("ndvi").alias("mean_ndvi"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
