"""Exact top-k search by a three-phase uniform threshold.

A score is an inner product of integers, the sum of ``LISTS`` local scores over
equal runs of dimensions.  Phase one gathers local score lists: one
block of ``VECTOR_BLOCK`` vectors, taken by hash and broadcast, gives each query, for
every run, its best local scores, and only the vectors listed there get a total; the
(k + 1)-th best of these totals is a lower bound t of what the result needs, as good
however the vectors are dealt.  Phase two sends each query's cutoff t / LISTS
to all blocks: a vector below it in every run cannot reach t, so what reaches it
in some run is sufficient.  A block keeps its vectors by length in each run, and
what is too short to reach a cutoff is never multiplied.  Phase three resolves
the missing local scores of exactly the sufficient entries, and keeps the best
totals.

Equal vectors are scored once: they stand for their k + 1 smallest ids, which no
result can go beyond.  Queries are a stated set: ids of one vector ask once for
each distinct vector, ids of several ask for themselves, so that what is their own
is left out before anything is ranked and k + 1 entries are enough for every query.
Queries are dealt into blocks of about ``QUERY_BLOCK``, of which ``AT_ONCE`` are
broadcast at a time, whatever the size of the tables; blocks of vectors stay where
they are.

Defined results: vectors that are null or hold null or non-finite components
take no part, nor do null ids; a shorter vector counts as padded with zeros;
repeated rows (equal id and vector) are one row; equal ids with other vectors
are rows of their own, and a query never returns its own id; scores must fit 63
bits; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from . import common

K = 20
LISTS = 4
SCALE = 64
#: Queries of a block, and blocks that are broadcast at a time: 16 MB of 64 dimensions.
QUERY_BLOCK = 2048
AT_ONCE = 16
#: Vectors of a block; also of the one that gives the bounds, 2 MB of 64 dimensions.
VECTOR_BLOCK = 4096
#: Queries that a task scores against a block at a time.
SLICE = 256
#: Parts that equal vectors are dealt into before the smallest ids of all are found.
SALTS = 64
_NONE = np.iinfo(np.int64).min // 2


def quantized(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and v = floor(scale * x) for the vectors that take part."""
    finite = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite)
    return good.select("vec_id", F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))).alias("v"))


# -- blocks -----------------------------------------------------------------------------------


def _matrix(lists: list[list[int]]) -> np.ndarray:
    out = np.zeros((len(lists), max(map(len, lists), default=0)), np.int64)
    for i, row in enumerate(lists):
        out[i, : len(row)] = row
    return out


BLOCK = "part long, numbers binary, data binary, width int"


def _block(part: int, numbers: np.ndarray, data: np.ndarray) -> pa.RecordBatch:
    """One row: some numbers for each vector, and the vectors."""
    packed = (pa.array([x.astype("<i8").tobytes()], pa.binary()) for x in (numbers, data))
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), *packed, pa.array([data.shape[1]], pa.int32())], names=["part", "numbers", "data", "width"])


def _unblock(numbers: bytes, data: bytes, width: int, columns: int) -> tuple[np.ndarray, np.ndarray]:
    numbers = np.frombuffer(numbers, "<i8").reshape(-1, columns)
    return numbers, np.frombuffer(data, "<i8").reshape(len(numbers), width)


def _whole(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """Tables of ``size`` rows, the last one shorter."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        while sum(map(len, held)) >= size:
            table = pa.Table.from_batches(held)
            yield table.slice(0, size)
            held = table.slice(size).to_batches()
    if sum(map(len, held)):
        yield pa.Table.from_batches(held)


class Ids(NamedTuple):
    """Ids on both sides: the one that a query asks for, where it asks ``alone``, and the two smallest of each vector."""

    own: np.ndarray
    alone: np.ndarray
    least: np.ndarray
    other: np.ndarray  # the least once more where there is one id

    def barred(self) -> np.ndarray:
        """Pairs of a query and a vector that only the query's own id has."""
        return self.alone[:, None] & (self.least == self.other) & (self.own[:, None] == self.least)

    def smallest(self, query: np.ndarray, vector: np.ndarray) -> np.ndarray:
        """The smallest id of each vector that is not the query's own."""
        mine = self.alone[query] & (self.own[query] == self.least[vector])
        return np.where(mine, self.other[vector], self.least[vector])


# -- the three phases in blocks ---------------------------------------------------------------


def _runs(q: np.ndarray, v: np.ndarray, lists: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Both sides over each run of dimensions, in the fastest numbers that are exact."""
    width = max(q.shape[1], v.shape[1])
    q, v = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (q, v))
    most = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * max(width, 1)
    kind = np.float64 if most < 2.0**53 else np.int64
    cuts = np.linspace(0, width, lists + 1).astype(int)
    return [(q[:, a:b].astype(kind), v[:, a:b].astype(kind)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _dots(runs: list[tuple[np.ndarray, np.ndarray]], query: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """Sum of the local scores of single pairs over ``runs``."""
    out = np.zeros(len(query), np.int64)
    for lo in range(0, len(query), 1 << 16):
        some = slice(lo, lo + (1 << 16))
        for q, v in runs:
            out[some] += (q[query[some]] * v[vector[some]]).sum(axis=1).astype(np.int64)
    return out


def lower_bounds(q: np.ndarray, v: np.ndarray, lists: int, n: int, ids: Ids | None = None) -> np.ndarray:
    """Phase one: the ``n``-th best total among the best ``n`` of every local list, per query."""
    if len(v) < n:
        return np.full(len(q), _NONE)
    runs = _runs(q, v, lists)
    listed = np.concatenate([np.argpartition(a @ b.T, len(v) - n, axis=1)[:, len(v) - n :] for a, b in runs], axis=1)
    listed.sort(axis=1)
    again = np.concatenate([np.zeros((len(q), 1), bool), listed[:, 1:] == listed[:, :-1]], axis=1)
    query = np.repeat(np.arange(len(q)), listed.shape[1])
    if ids is not None:
        again |= np.take_along_axis(ids.barred(), listed, axis=1)
    total = np.where(again, _NONE, _dots(runs, query, listed.reshape(-1)).reshape(listed.shape))
    return -np.partition(-total, n - 1, axis=1)[:, n - 1]


def reaching(q: np.ndarray, bound: np.ndarray, v: np.ndarray, lists: int, n: int, ids: Ids | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Phases two and three in one pair of blocks: (query, vector, total) and how many pairs were multiplied.

    At most ``n`` for each query; of equal totals the smaller id stays, without ids
    the earlier vector.
    """
    cutoff = -(-bound // lists)
    runs = _runs(q, v, lists)
    sufficient = np.zeros((len(q), len(v)), bool)
    local, rank, work = [], [], 0.0
    for a, b in runs:
        # |q| |v| bounds a local score: where the cutoff is above zero, vectors that are too short cannot reach it
        length = np.sqrt((b.astype(np.float64) ** 2).sum(axis=1))
        need = np.where(cutoff > 0, cutoff / np.maximum(np.sqrt((a.astype(np.float64) ** 2).sum(axis=1)), 1e-300), 0.0).min(initial=np.inf)
        order = np.argsort(-length, kind="stable")
        long = int((length >= need * (1 - 1e-9)).sum())
        score = a @ b[order[:long]].T
        sufficient[:, order[:long]] |= score >= cutoff[:, None]
        place = np.empty(len(v), np.int64)
        place[order] = np.arange(len(v))
        local.append(score)
        rank.append(place)
        work += len(q) * long / lists
    if ids is not None:
        sufficient &= ~ids.barred()
    query, vector = np.nonzero(sufficient)
    total = np.zeros(len(query), np.int64)
    for run, score, place in zip(runs, local, rank, strict=True):
        at = place[vector]
        there = at < score.shape[1]
        total[there] += score[query[there], at[there]].astype(np.int64)
        total[~there] += _dots([run], query[~there], vector[~there])
        work += int((~there).sum()) / lists
    keep = total >= bound[query]
    query, vector, total = query[keep], vector[keep], total[keep]
    order = np.lexsort((vector if ids is None else ids.smallest(query, vector), -total, query))
    query, vector, total = query[order], vector[order], total[order]
    few = np.arange(len(query)) - np.searchsorted(query, query) < n
    return query[few], vector[few], total[few], work


# -- Spark ------------------------------------------------------------------------------------


def search(
    vectors: DataFrame, is_query: F.Column, k: int = K, lists: int = LISTS, query_block: int = QUERY_BLOCK, vector_block: int = VECTOR_BLOCK,
) -> DataFrame:
    """query_id, rank, vec_id, score for the rows of ``vectors`` (vec_id, v) that ``is_query`` marks."""
    spark = vectors.sparkSession
    enough = k + 1  # an id of one vector has its own place in what it asks for
    with common.scratch() as keep:
        marked = vectors.select("vec_id", "v", F.coalesce(is_query, F.lit(False)).alias("asks"))
        rows = common.settle(marked.groupBy("vec_id", "v").agg(F.bool_or("asks").alias("asks")), "vectors")
        # the smallest ids of equal vectors, first within parts of them
        salt = F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).alias("salt")
        in_part = W.partitionBy("v", "salt").orderBy("vec_id")
        few = rows.select("vec_id", "v", salt).withColumn("n", F.row_number().over(in_part)).filter(F.col("n") <= enough)
        members = few.withColumn("n", F.row_number().over(W.partitionBy("v").orderBy("vec_id"))).filter(F.col("n") <= enough)
        distinct = members.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
        # a vector's number is written down, so that it is the same in every use; so is a query's
        distinct = common.settle(distinct.select(F.monotonically_increasing_id().alias("number"), "v", "ids"), "distinct-vectors")
        vectors_of = rows.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n"))
        asking = common.join_counted(rows.filter("asks").select("vec_id", "v"), vectors_of, "vec_id", rows.count())
        alone = F.col("n") > 1
        ask = F.struct("v", alone.alias("alone"), F.when(alone, F.col("vec_id")).otherwise(0).alias("own")).alias("ask")
        asking = common.settle(asking.select(ask, F.col("vec_id").alias("query_id")), "asking")
        queries = asking.groupBy("ask").agg(F.count(F.lit(1)).alias("n"))
        queries = common.settle(queries.select(F.monotonically_increasing_id().alias("asker"), "ask", "n"), "queries")
        parts = max(spark.sparkContext.defaultParallelism, -(-distinct.count() // vector_block))
        groups, passes = passes_for(queries.count(), query_block)

        def block(table: pa.Table) -> pa.RecordBatch:
            numbers = np.stack([np.asarray(table[c]) for c in ("number", "first", "second")], axis=1)
            return _block(0, numbers, _matrix(table["v"].to_pylist()))

        def vector_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from map(block, _whole(batches, vector_block))

        def bounded(table: pa.Table) -> pa.Table:
            return pa.Table.from_batches([block(table)]).set_column(0, "part", table["part"][:1])

        def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    numbers, q = _unblock(*row[:3], 3)
                    named, v = _unblock(*row[3:], 3)
                    bound = np.concatenate([lower_bounds(
                        q[some], v, lists, enough, Ids(numbers[some, 1], numbers[some, 2] > 0, named[:, 1], named[:, 2]),
                    ) for some in (slice(lo, lo + SLICE) for lo in range(0, len(q), SLICE))])
                    yield _block(part, np.concatenate([numbers, bound[:, None]], axis=1), q)

        other = F.coalesce(F.try_element_at("ids", F.lit(2)), F.col("ids")[0])
        sides = distinct.select("number", F.col("ids")[0].alias("first"), other.alias("second"), "v")
        blocks = common.settle(sides.repartition(parts, "number").mapInArrow(vector_blocks, BLOCK).drop("part"), "vector-blocks")
        # phase one against one bounded block, whatever the sizes of the others
        some = sides.orderBy(F.xxhash64("number")).limit(vector_block).coalesce(1).mapInArrow(vector_blocks, BLOCK)
        asked = queries.select(
            F.pmod(F.xxhash64("asker"), F.lit(groups)).alias("part"), F.col("asker").alias("number"), F.col("ask.own").alias("first"), F.col("ask.alone").cast("long").alias("second"), F.col("ask.v").alias("v"),
        ).groupBy("part").applyInArrow(bounded, BLOCK)
        lists_of = F.broadcast(some.select(*(F.col(c).alias(f"v_{c}") for c in ("numbers", "data", "width"))))
        packed = common.settle(asked.join(lists_of, F.lit(True)).mapInArrow(gather, BLOCK).select(
            F.floor(F.col("part") / AT_ONCE).alias("pass"), *(F.col(c).alias(f"q_{c}") for c in ("numbers", "data", "width")),
        ), "query-passes")

        def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    numbers, v = _unblock(*row[:3], 3)
                    asked, q = _unblock(*row[3:], 4)
                    for lo in range(0, len(q), SLICE):
                        asker, own, alone, bound = asked[lo : lo + SLICE].T
                        ids = Ids(own, alone > 0, numbers[:, 1], numbers[:, 2])
                        query, vector, total, _ = reaching(q[lo : lo + SLICE], bound, v, lists, enough, ids)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(asker[query]), pa.array(own[query], mask=~ids.alone[query]), pa.array(numbers[vector, 0]), pa.array(ids.smallest(query, vector)), pa.array(total)],
                            names=["asker", "own", "number", "least", "score"],
                        )

        # `AT_ONCE` blocks of queries at a time: a bounded broadcast in every pass, and as many passes as they need
        some = [common.settle(
            blocks.join(F.broadcast(packed.filter(F.col("pass") == i).drop("pass")), F.lit(True)).mapInArrow(collect, FOUND), "sufficient",
        ) for i in range(passes)]
        keep += [distinct, asking, queries, *some]
    found = reduce(DataFrame.union, some)
    best = W.partitionBy("asker").orderBy(F.desc("score"), "least", "number")
    top = found.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= enough).select("asker", "own", "number", "score")
    # from distinct vectors to ids, without the one that asks alone: the best of each query
    by_id = W.partitionBy("asker").orderBy(F.desc("score"), "vec_id")
    named = top.join(distinct.select("number", "ids"), "number").select("asker", "own", "score", F.explode("ids").alias("vec_id"))
    named = named.filter(F.col("own").isNull() | (F.col("vec_id") != F.col("own")))
    named = named.withColumn("n", F.row_number().over(by_id)).filter(F.col("n") <= enough)
    listed = named.groupBy("asker").agg(F.array_sort(F.collect_list(F.struct("n", "vec_id", "score"))).alias("best"))  # `enough` entries at most
    answers = queries.join(listed, "asker").select("ask", "n", "best")
    each = common.join_counted(asking, answers, "ask", asking.count()).select(
        "query_id", F.slice(F.filter("best", lambda x: x.vec_id != F.col("query_id")), 1, k).alias("best"),
    )
    return each.select("query_id", F.posexplode("best").alias("pos", "hit")).select(
        "query_id", (F.col("pos") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"),
    )


def passes_for(n_queries: int, query_block: int = QUERY_BLOCK) -> tuple[int, int]:
    """Groups of about ``query_block`` queries, and passes of ``AT_ONCE`` groups."""
    groups = max(1, -(-n_queries // query_block))
    return groups, -(-groups // AT_ONCE)


FOUND = "asker long, own long, number long, least long, score long"


def op3(vectors: DataFrame) -> DataFrame:
    rows = quantized(vectors.select("vec_id", "embedding"))
    found = search(rows, F.col("vec_id") % 20 == 0)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


ORACLE_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s QUALIFY rank <= 20
"""
