"""Quality classifier: Naive Bayes support vectors over n-gram indicators.

Features are indicators of hashed n-grams: single words, and one to three
consecutive word shapes (letters, capitals, digits and punctuation in runs, with
a mark for a word that repeats the one before).  Each indicator is scaled by the
log ratio of its smoothed counts in the two classes, rows are brought to unit
length, and a linear hinge-loss model is fitted by dual coordinate descent.
Margins of rows left out of a first fit turn into probabilities by a logistic
curve.

The fit uses at most ``MAX_TRAIN`` labelled rows, chosen by hash of the doc_id,
and of those, in order of hash, as many as have ``MAX_FEATURES`` indicators;
rows with crc32(doc_id as text) mod 5 = 0 are held out and never looked at.
Scoring covers every whole text, in parallel, with one broadcast weight vector
of ``DIM`` numbers.

Defined results: null and empty texts have no features and score by the model's
bias; without labels of both classes every score is the share of ones among the
labels, or 0.5 without any; a null doc_id counts as held out; of several labels
of one doc_id the least counts; repeated rows score alike and are learned from once; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from . import common

DIM = 1 << 18
#: Labelled rows that the model is fitted on, at most, and indicators of all of them together.
MAX_TRAIN = 12_000
MAX_FEATURES = 30_000_000
FOLDS = 5
THRESHOLD = 0.3
#: Bytes of text whose features are built at a time.
SLICE = 3 << 20
#: Left-out rows whose margins the driver takes at a time.
ROWS = 256

_SHAPE = bytes(ord("a") if 97 <= c <= 122 or c >= 128 else ord("A") if 65 <= c <= 90 else ord("9") if 48 <= c <= 57 else c for c in range(256))
_RUN = re.compile(rb"(.)\1+", re.S)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


def features(texts: pa.Array, dim: int = DIM) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of every distinct indicator, by row."""
    words, bounds = common.split_words(texts)
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    table = words.dictionary_encode()
    codes = np.asarray(table.indices)
    distinct = table.dictionary.cast(pa.large_binary()).to_pylist()
    own = np.array([xxhash.xxh64_intdigest(w, 1) for w in distinct], np.uint64)
    shape = np.array([xxhash.xxh64_intdigest(_RUN.sub(rb"\1", w.translate(_SHAPE)), 2) for w in distinct], np.uint64)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    again = np.concatenate([[False], (codes[1:] == codes[:-1]) & (row[1:] == row[:-1])])
    s = shape[codes] + again.astype(np.uint64)
    keys = [(row, _mixed(own[codes]))]
    two = row[1:] == row[:-1]
    three = row[2:] == row[:-2]
    keys.append((row, _mixed(s + np.uint64(3))))
    pair = _mixed(s[:-1]) * np.uint64(31) + s[1:]
    keys.append((row[1:][two], _mixed(pair)[two]))
    keys.append((row[2:][three], _mixed(_mixed(pair[:-1]) * np.uint64(37) + s[2:])[three]))
    # unique by sorting; pairs of rows and features fit one number
    both = np.unique(np.concatenate([r.astype(np.int64) * dim + (k % np.uint64(dim)).astype(np.int64) for r, k in keys]))
    return both // dim, both % dim


@dataclass
class Model:
    weight: np.ndarray  # of scaled indicators, before rows have unit length
    scale: np.ndarray  # squared log-count ratios
    bias: float
    slope: float
    shift: float

    def margins(self, row: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        length = np.sqrt(np.bincount(row, self.scale[feature], n))
        return np.bincount(row, self.weight[feature], n) / np.maximum(length, 1e-12) + self.bias

    def scores(self, row: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(row, feature, n) + self.shift, -500, 500)))


class _Scaled(Sequence):
    """(features, values of unit length) of rows; values are made as they are asked for, so that the driver never holds all."""

    def __init__(self, rows: list[np.ndarray], ratio: np.ndarray) -> None:
        self.rows, self.ratio = rows, ratio
        self.length = [max(float(np.linalg.norm(ratio[x])), 1e-12) for x in rows]

    def __len__(self) -> int:
        return len(self.rows)

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        at = self.rows[i].astype(np.intp)
        return at, self.ratio[at] / self.length[i]


def hinge_by_dual_descent(
    rows: Sequence[tuple[np.ndarray, np.ndarray]], sign: np.ndarray, dim: int, cost: float = 1.0, rounds: int = 20, seed: int = 7,
) -> tuple[np.ndarray, float]:
    """Weights and bias of the linear hinge-loss model; rows are (features, values)."""
    weight, bias = np.zeros(dim), 0.0
    alpha = np.zeros(len(rows))
    square = np.array([float(v @ v) + 1.0 for _, v in rows])
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        most = 0.0
        for i in rng.permutation(len(rows)):
            at, value = rows[i]
            slope = sign[i] * (float(weight[at] @ value) + bias) - 1
            new = min(max(alpha[i] - slope / square[i], 0.0), cost)
            if (step := new - alpha[i]) != 0:
                weight[at] += step * sign[i] * value
                bias += step * sign[i]
                alpha[i] = new
                most = max(most, abs(step))
        if most < 1e-3:
            break
    return weight, bias


def _logistic(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the curve from margins to probabilities, by Newton steps with soft labels."""
    ones = label.sum()
    zeros = len(label) - ones
    target = np.where(label == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    slope, shift = 1.0, float(np.log((ones + 1) / (zeros + 1)))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(slope * margin + shift, -500, 500)))
        g = np.array([((p - target) * margin).sum(), (p - target).sum()])
        w = np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(w * margin * margin).sum() + 1e-3, (w * margin).sum()], [(w * margin).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        slope, shift = slope - step[0], shift - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return max(slope, 1e-6), shift


def fit_rows(rows: list[np.ndarray], label: np.ndarray, dim: int = DIM) -> Model:
    """The model of feature lists and 0/1 labels."""
    ones, n = int(label.sum()), len(label)
    if not ones or ones == n:
        share = ones / n if n else 0.5
        shift = float(np.log(share / (1 - share))) if 0 < share < 1 else (0.0 if not n else 20.0 if share else -20.0)
        return Model(np.zeros(dim), np.zeros(dim), 0.0, 1.0, shift)

    def ratios(some: np.ndarray) -> np.ndarray:
        # log of the ratio of smoothed shares
        counts = [np.ones(dim), np.ones(dim)]
        for i in some:
            counts[label[i]][rows[i]] += 1
        return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())

    def fit(some: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        r = ratios(some)
        w, bias = hinge_by_dual_descent(_Scaled([rows[i] for i in some], r), np.where(label[some] == 1, 1.0, -1.0), dim)
        return w * r, r * r, bias

    order = np.random.default_rng(11).permutation(n)
    test, train = order[: n // 4], order[n // 4 :]
    slope, shift = 4.0, 0.0
    if 0 < label[test].sum() < len(test) and 0 < label[train].sum() < len(train):
        part, margin = Model(*fit(train), 1.0, 0.0), []
        for lo in range(0, len(test), ROWS):
            some = [rows[i] for i in test[lo : lo + ROWS]]
            margin.append(part.margins(np.repeat(np.arange(len(some)), [len(x) for x in some]), np.concatenate([*some, np.zeros(0, np.int32)]), len(some)))
        slope, shift = _logistic(np.concatenate(margin), label[test])
    return Model(*fit(np.arange(n)), slope, shift)


def _lists(packed: pa.ChunkedArray) -> list[np.ndarray]:
    """The feature lists of binary values of 4 bytes a feature, as views of them."""
    out = []
    for chunk in packed.chunks:
        _, offsets, data = chunk.buffers()
        ends = np.frombuffer(offsets, np.int32)[chunk.offset : chunk.offset + len(chunk) + 1] // 4
        flat = np.frombuffer(data or b"", "<i4")
        out += [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
    return out


def held_out(doc_id: F.Column) -> F.Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(FOLDS)) == 0


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, label: str = "quality") -> Model:
    """Fit on at most ``max_train`` labelled documents outside the held-out fold, and ``MAX_FEATURES`` indicators of them."""
    usable = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    one = usable.groupBy("doc_id").agg(F.min(label).cast("int").alias("__label"))
    chosen = one.orderBy(F.xxhash64("doc_id", F.lit("train")), "doc_id").limit(max_train)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in common.slices(batch.column(1), SLICE):
                row, feature = features(batch.column(1).slice(lo, hi - lo))
                cuts = np.searchsorted(row, np.arange(hi - lo + 1))
                lists = [feature[a:b].astype("<i4").tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array(lists, pa.binary())],
                    names=["label", "h", "features"],
                )

    # `max_train` ids: a bounded broadcast, whatever the tables' sizes
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("__label", "text", F.xxhash64("doc_id", "text").alias("__h"))
    # numbers are chosen first; texts stay where they are, and only their features move
    first = rows.select("__h").distinct().orderBy("__h").limit(max_train)
    few = rows.join(F.broadcast(first), "__h").select("__label", "text", "__h")
    with common.scratch():
        made = common.settle(few.mapInArrow(task, "label int, h long, features binary").distinct(), "training-features")
        # a window over `max_train` rows
        sofar = F.sum(F.length("features")).over(W.orderBy("h", "label", "features").rowsBetween(W.unboundedPreceding, W.currentRow))
        found = made.withColumn("sofar", sofar).filter(F.col("sofar") <= 4 * MAX_FEATURES).drop("sofar").toArrow()
    found = found.sort_by([("h", "ascending"), ("label", "ascending")])
    return fit_rows(_lists(found.column("features")), np.array(found.column("label").to_pylist(), np.int64))


def _scored(docs: DataFrame, model: Model):  # noqa: ANN202
    """A function of whole rows to their scores, for tasks."""
    shared, text = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def scores(batch: pa.RecordBatch) -> np.ndarray:
        parts = [np.zeros(0)]
        for lo, hi in common.slices(batch.column(text), SLICE):
            row, feature = features(batch.column(text).slice(lo, hi - lo))
            parts.append(shared.value.scores(row, feature, hi - lo))
        return np.concatenate(parts)

    return scores


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row of ``docs`` (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    scores = _scored(docs, model)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores(batch))], names=["doc_id", "score"])
        pa.default_memory_pool().release_unused()  # the worker lives on

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(task, f"doc_id {kind}, score double")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_train: int = MAX_TRAIN) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``; rows stay where they are, whole."""
    scores = _scored(docs, train(docs, labels, max_train))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(scores(batch) >= threshold))
        pa.default_memory_pool().release_unused()  # the worker lives on

    return docs.mapInArrow(task, docs.schema)


def op7(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = train(docs, labels)
    return score(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
