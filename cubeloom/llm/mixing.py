"""Mixing sources to target weights by systematic sampling, with built-in functions only.

Each source's target is its share of all words by weight, at most ``CAP`` times
its own words, with what is over shared again by weight.  Every document of a
source is expected target / source size times.  Documents of a source stand in
order of size, so that the running sum of expected copies strides through all
sizes alike; one random offset per source is added, and a document is emitted
once for every whole number that the sum passes on it.

Defined results: null text has size 0; a null source is one source of its own,
last in order; repeated rows are mixed as rows of their own; rows of equal doc_id,
source and size stand in order of a hash of their text; sources without
words get target 0 and no copies; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

#: A source is used at most this often; also the most copies of a document.
CAP = 3
WEIGHTS = (1, 2, 3)
WORD = r"[^\x20\x09-\x0D]+"
#: Places in line of one (source, size) are counted in so many parts.
PARTS = 256

_SRC, _SIZE, _PART, _N, _TIE = "__mix_source", "__mix_size", "__mix_part", "__mix_rank", "__mix_tie"


def word_count(text: str = "text") -> F.Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size) -> (source, source_size, target), one row per source.

    Sharing again until none is above its cap ends in one water level: sources
    in order of cap / weight are capped as long as the level that the others
    would get is above theirs.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    by_cap = W.orderBy("__ratio", F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(W.unboundedPreceding, -1)
    rest = by_cap.rowsBetween(W.currentRow, W.unboundedFollowing)
    everything = W.partitionBy()
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    levels = (
        sizes.withColumn("__w", weight.cast("double"))
        .withColumn("__cap", F.col("source_size").cast("double") * cap)
        .withColumn("__ratio", F.col("__cap") / F.col("__w"))
        .withColumn("__level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))) / F.sum("__w").over(rest))
        .withColumn("__water", F.max(F.when(F.col("__level") <= F.col("__ratio"), F.col("__level"))).over(everything))
    )
    target = F.least(F.col("__cap"), F.coalesce(F.col("__water"), F.lit(float("inf"))) * F.col("__w"))
    return levels.select("source", "source_size", target.alias("target"))


def offset(source: F.Column, seed: str) -> F.Column:
    """The source's random offset in [0, 1), the same in every run."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(seed + ":"), F.coalesce(source, F.lit("\x00"))), 256), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def part_of(doc_id: F.Column) -> F.Column:
    """Spreads equal sizes over parts: the first two hex digits of the id's MD5."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 2), 16, 10).cast("int")


def _key(source: str) -> F.Column:
    """The source as a key that null has too."""
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("-"))


def mix_plan(docs: DataFrame, seed: str = "mix", weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """``docs`` with size, source_size, target and copies (0 to ``cap``) added as ``__mix_*``."""
    rows = docs.withColumns({_SIZE: word_count(), _SRC: _key("source"), _PART: part_of(F.col("doc_id")), _TIE: F.xxhash64("text")})
    # counts by (source, size, part), then places in line from three short running sums
    parts = rows.groupBy(_SRC, _SIZE, _PART).agg(F.count(F.lit(1)).alias("n"))  # one plan, so one exchange, for all uses
    sizes = parts.groupBy(_SRC, _SIZE).agg(F.sum("n").alias("n_size"))
    sources = sizes.groupBy(_SRC).agg(F.sum(F.col("n_size") * F.col(_SIZE)).alias("source_size"))
    targets = source_targets(sources.select(F.when(F.col(_SRC) != "-", F.substring(_SRC, 2, 1 << 30)).alias("source"), "source_size"), weights, cap)
    targets = targets.select(_key("source").alias(_SRC), F.col("source_size").alias("__mix_source_size"), F.col("target").alias("__mix_target"))
    prior = lambda n, *keys: F.coalesce(F.sum(n).over(W.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(_SRC, _SIZE, prior("n_size", _SRC, _SIZE).alias("__a"))
    parts = parts.select(_SRC, _SIZE, _PART, prior("n", _SRC, _SIZE, _PART).alias("__b"))
    starts = parts.join(sizes, [_SRC, _SIZE]).join(targets, _SRC).select(
        _SRC, _SIZE, _PART, (F.col("__a") + F.col("__b")).alias("__start"), "__mix_source_size", "__mix_target",
    )
    in_part = W.partitionBy(_SRC, _SIZE, _PART).orderBy(F.col("doc_id").asc_nulls_first(), _TIE)
    ranked = rows.withColumn(_N, F.row_number().over(in_part)).join(starts, [_SRC, _SIZE, _PART])
    rate = F.when(F.col("__mix_source_size") > 0, F.col("__mix_target") / F.col("__mix_source_size")).otherwise(0.0)
    place = F.col("__start") + F.col(_N)
    u = offset(F.col("source"), seed)
    copies = (F.floor(place * rate + u) - F.floor((place - 1) * rate + u)).cast("int")
    return ranked.withColumn("__mix_copies", copies)


def mix(docs: DataFrame, seed: str = "mix", weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """The mixture itself: every row of ``docs`` as often as it is taken, columns unchanged."""
    copies = mix_plan(docs, seed, weights, cap).filter("__mix_copies > 0")
    return copies.withColumn("__mix_i", F.explode(F.sequence(F.lit(1), F.col("__mix_copies")))).select(*docs.columns)


def op4(docs: DataFrame) -> DataFrame:
    plan = mix_plan(docs.select("doc_id", "text", "source"))
    return plan.select(
        "doc_id", F.col(_SIZE).alias("size"), F.col("__mix_source_size").cast("long").alias("source_size"), F.col("__mix_target").alias("target"),
        (F.col("__mix_copies") * F.col(_SIZE)).cast("long").alias("taken"),
    )


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 2))::INT AS part
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w, source_size * 3.0::DOUBLE AS cap FROM s
), l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w
), t AS (
  SELECT source, source_size, least(cap, coalesce((SELECT max(level) FROM l WHERE level <= cap / w), 'inf'::DOUBLE) * w) AS target,
         ('0x' || substr(sha256('mix:' || coalesce(source, chr(0))), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM l
), r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.u,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
         row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.part, d.doc_id NULLS FIRST) AS place
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size::BIGINT AS size, source_size, target::DOUBLE AS target,
       ((floor(place * rate + u) - floor((place - 1) * rate + u)) * size)::BIGINT AS taken FROM r
"""
