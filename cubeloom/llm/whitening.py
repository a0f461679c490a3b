"""Whitening of embeddings by matrix-free block subspace iteration.

The covariance V is never formed.  The distinct vectors lie in blocks in shared
storage, and a pass over them multiplies a few columns Q by V: every task adds up
Xc'(Xc Q) of its centred rows, and a row of the product is added up from all
tasks in the order of their numbers.  On the driver, which holds d x b numbers,
the product gives Ritz values and vectors within the columns (Rayleigh-Ritz),
their residuals, and by QR the next columns.  Passes end when the residuals
certify all k components: residual over the distance to the least Ritz value of
the block bounds the angle to the true component.  Columns beyond k make the
passes few; where the rate of three passes foretells more than ``PASSES``, the
block gets twice as many columns, and with all d of them one pass ends it.

Sums are exact integers, and so is the deviation.

Defined results: rows whose vector is null or holds a null or non-finite entry
are dropped; null vec_ids stay; a shorter vector counts as padded with zeros;
equal vectors are one entry of the fit list and a row each in the result;
repeated rows are rows of their own; entries beyond 63 bits after scaling are the
nearest that fits.  Components without variance (eigenvalue zero but for
rounding) do not exist: a list of one distinct vector has none, and gives no
rows, as an empty table does.  Eigenvalues that are equal leave their components
open to rotation, which the fixed start settles.  A deviation beyond 63 bits is
null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SCALE = 256
COMPONENTS = 4
#: Columns of the first block beyond which more are taken only where passes would be many.
COLUMNS = 32
#: Passes that a block is given from where its rate is known.
PASSES = 12
#: Angle to the true component that is certified.
ANGLE = 1e-12
VECTOR_BLOCK = 4096
SEED = 20
BLOCK = "rows int, kind string, data binary"
PARTIAL = "i int, part long, numbers binary"


@dataclass(frozen=True)
class Whitening:
    """What a fit found; components are columns."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    residuals: np.ndarray
    passes: int
    identity_error: float = 0.0

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    @property
    def scaled(self) -> np.ndarray:
        """Components over the roots of their eigenvalues."""
        return self.components / np.sqrt(self.eigenvalues)


def quantized(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and x = floor(scale * entry), padded to one width, of the vectors that take part."""
    finite = ~F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    good = vectors.filter(F.col("embedding").isNotNull() & finite).select("vec_id", "embedding")
    width = good.agg(F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("n")).first()["n"]
    x = F.transform("embedding", lambda c: F.floor(F.lit(float(scale)) * c.cast("double")))
    missing = F.lit(width) - F.size("embedding")
    padded = F.when(missing > 0, F.concat(x, F.array_repeat(F.lit(0).cast("long"), missing))).otherwise(x)
    return good.select("vec_id", padded.alias("x"))


# -- blocks and passes ------------------------------------------------------------------------


def _matrix(lists: pa.Array) -> np.ndarray:
    """Lists of one length as rows."""
    flat = np.asarray(lists.flatten())
    return flat.reshape(len(lists), -1) if len(lists) else flat.reshape(0, 0)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors in the narrowest integers that hold them."""
    for batch in batches:
        for lo in range(0, len(batch), VECTOR_BLOCK):
            x = _matrix(batch.column("x").slice(lo, VECTOR_BLOCK))
            kind = next((k for k in ("<i2", "<i4") if not x.size or (np.iinfo(k).min <= x.min() and x.max() <= np.iinfo(k).max)), "<i8")
            yield pa.RecordBatch.from_arrays([pa.array([len(x)], pa.int32()), pa.array([kind]), pa.array([x.astype(kind).tobytes()], pa.binary())], names=["rows", "kind", "data"])


def _unblocked(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        for rows, kind, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            yield np.frombuffer(data, kind).reshape(rows, -1)


def _total(blocks: DataFrame, partial: Callable[[Iterator[np.ndarray]], np.ndarray | None]) -> np.ndarray | None:
    """The sum over all tasks of ``partial``, a matrix for the blocks of one task, or None without blocks.

    A task hands on a record for each row of its matrix; the records of a row are
    added where they meet, so that no task and not the driver holds more than one
    matrix and one row of each task.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = partial(_unblocked(batches))
        if made is not None:
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(made)), pa.int32()), pa.array([part] * len(made), pa.int64()), pa.array([row.tobytes() for row in made], pa.binary())],
                names=["i", "part", "numbers"],
            )

    def add(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("part")
        total = np.zeros(len(rows["numbers"][0].as_py()) // 8, rows_kind)
        for x in rows["numbers"]:
            total = total + np.frombuffer(x.as_buffer(), rows_kind)
        return pa.table({"i": rows["i"].slice(0, 1), "part": rows["part"].slice(0, 1), "numbers": pa.array([total.tobytes()], pa.binary())})

    rows_kind = np.dtype("<f8")
    found = sorted(blocks.mapInArrow(task, PARTIAL).groupBy("i").applyInArrow(add, PARTIAL).collect(), key=lambda r: r["i"])
    return np.stack([np.frombuffer(r["numbers"], rows_kind) for r in found]) if found else None


def _sums(blocks: DataFrame) -> tuple[int, list[int]]:
    """Number of vectors and exact sums of each dimension, from halves that cannot overflow."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _unblocked(batches):
            high, low = (x.astype(np.int64) >> 32).sum(axis=0), (x.astype(np.int64) & 0xFFFFFFFF).sum(axis=0)
            d = x.shape[1]
            columns = [range(d), high, low, np.full(d, len(x))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), *[pa.int64()] * 3), strict=True)], names=["i", "high", "low", "n"])

    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    found = blocks.mapInArrow(task, "i int, high long, low long, n long").groupBy("i").agg(exact("high"), exact("low"), F.sum("n").alias("n")).collect()
    found.sort(key=lambda r: r["i"])
    return (found[0]["n"] if found else 0), [(int(r["high"]) << 32) + int(r["low"]) for r in found]


def _times_covariance(blocks: DataFrame, mean: np.ndarray, n: int, q: np.ndarray) -> tuple[np.ndarray, float]:
    """(V q, trace of V) in one pass."""

    def partial(each: Iterator[np.ndarray]) -> np.ndarray | None:
        product, squares, any_ = np.zeros_like(q), np.zeros(len(q)), False
        for x in each:
            centred = x - mean
            product += centred.T @ (centred @ q)
            squares += np.einsum("ij,ij->j", centred, centred)
            any_ = True
        return np.column_stack([product, squares]) if any_ else None

    total = _total(blocks, partial) / n
    return total[:, :-1], float(total[:, -1].sum())


def _identity_error(blocks: DataFrame, mean: np.ndarray, n: int, scaled: np.ndarray) -> float:
    """The largest entry of the whitened list's covariance minus the identity, from a pass of its own."""
    k = scaled.shape[1]

    def partial(each: Iterator[np.ndarray]) -> np.ndarray | None:
        out, any_ = np.zeros((k, k + 1)), False
        for x in each:
            w = (x - mean) @ scaled
            out += np.column_stack([w.T @ w, w.sum(axis=0)])
            any_ = True
        return out if any_ else None

    total = _total(blocks, partial) / n
    centre = total[:, -1]
    return float(np.abs(total[:, :-1] - np.outer(centre, centre) - np.eye(k)).max())


# -- fit --------------------------------------------------------------------------------------


def _wider(q: np.ndarray, columns: int, rng: np.random.Generator) -> np.ndarray:
    """``q`` with random columns added, all orthonormal."""
    more = rng.standard_normal((len(q), columns - q.shape[1]))
    return np.linalg.qr(np.column_stack([q, more]))[0]


def fit(rows: DataFrame, k: int = COMPONENTS, columns: int = COLUMNS, passes: int = PASSES) -> Whitening | None:
    """The first ``k`` components of the distinct vectors ``x``; None if they have no variance."""
    with common.scratch():
        blocks = common.settle(rows.select("x").distinct().mapInArrow(_blocks, BLOCK), "vector-blocks")
        n, sums = _sums(blocks)
        if not n or not sums:
            return None
        d, mean, rng = len(sums), np.array([s / n for s in sums]), np.random.default_rng(SEED)
        q = _wider(np.zeros((d, 0)), min(d, max(columns, k)), rng)
        done, since, worst_before = 0, 0, np.inf
        while True:
            product, trace = _times_covariance(blocks, mean, n, q)
            done, since = done + 1, since + 1
            inner = q.T @ product
            ritz, turn = np.linalg.eigh((inner + inner.T) / 2)
            ritz, turn = ritz[::-1], turn[:, ::-1]
            residual = np.linalg.norm(product @ turn - (q @ turn) * ritz, axis=0)[:k]
            rounding = d * np.finfo(float).eps * max(ritz[0], 0.0)
            if trace <= 0 or ritz[0] <= 0:
                return None
            allowed = np.maximum(ANGLE * (ritz[:k] - ritz[-1]), rounding)
            if q.shape[1] == d or (residual <= allowed).all():
                break
            worst = float((residual / allowed).max())
            if since >= 3:
                rate = worst / worst_before
                if rate >= 1 or np.log(worst) > -np.log(rate) * passes:
                    q, since = _wider(q @ turn, min(d, 2 * q.shape[1]), rng), 0
            worst_before = worst
            if since:
                q = np.linalg.qr(product @ turn)[0]
        kept = int((ritz[:k] > rounding).sum())
        components = (q @ turn)[:, :kept]
        # either sign is right; the entry of largest size is positive
        components = components * np.sign(components[np.abs(components).argmax(axis=0), np.arange(kept)])
        found = Whitening(n, sums, components, ritz[:kept], trace, residual[:kept], done)
        error = _identity_error(blocks, mean, n, found.scaled)
    return Whitening(n, sums, components, ritz[:kept], trace, residual[:kept], done, error)


# -- projection -------------------------------------------------------------------------------

WHITE = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Exact sums over the dimensions of (n x - S)^2; None beyond 63 bits."""
    most = n * max((abs(int(v)) for v in (x.min(initial=0), x.max(initial=0))), default=0) + max(map(abs, sums), default=0)
    if most * most * max(1, len(sums)) < 1 << 63:
        away = n * x.astype(np.int64) - np.array(sums, np.int64)
        return (away * away).sum(axis=1).tolist()
    found = [sum((n * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x.tolist()]
    return [v if v < 1 << 63 else None for v in found]


def project(rows: DataFrame, model: Whitening) -> DataFrame:
    """A row for each row (vec_id, x) and component; map only."""
    n, sums, mean, scaled = model.n, model.sums, model.mean, model.scaled
    explained, error, k = (model.eigenvalues / model.trace).tolist(), model.identity_error, len(model.eigenvalues)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x = _matrix(batch.column("x"))
            repeated = pa.array(np.repeat(np.arange(len(batch)), k))
            yield pa.RecordBatch.from_arrays([
                batch.column("vec_id").cast(pa.int64()).take(repeated), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(batch))),
                pa.array(np.full(len(repeated), n)), pa.array(deviations(x, n, sums), pa.int64()).take(repeated),
                pa.array(((x - mean) @ scaled).reshape(-1)), pa.array(explained * len(batch)), pa.array(np.full(len(repeated), error)),
            ], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select("vec_id", "x").mapInArrow(task, WHITE)


def op13(vectors: DataFrame, k: int = COMPONENTS) -> DataFrame:
    rows = quantized(vectors)
    model = fit(rows, k)
    return vectors.sparkSession.createDataFrame([], WHITE) if model is None else project(rows, model)
