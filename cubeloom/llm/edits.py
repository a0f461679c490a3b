"""Fingerprints of whole texts by a randomised embedding of edit distance into Hamming distance.

A walk reads a text with one pointer.  At every step it writes down the character
under the pointer, and a random bit for (step, character), the same for all texts,
tells whether the pointer moves on.  Two texts are read alike until they differ;
after an insertion or deletion the pointers move at random against each other until
they meet again, so that few edits leave most of what is written down alike.
``WALKS`` walks are made with bits of their own.

A fingerprint keeps ``BITS`` bits, sampled from what the walks wrote.  Sample i is
taken at the step with the least random priority among all steps of the walk: walks
of lengths L <= M share it with probability L / M, whatever their lengths.  Its bit
is a hash of character, step and i.  So bits agree surely where the walks wrote the
same there, and half the time elsewhere, and 1 - 2 x (share of bits that differ) is
the likeness, at least 0.

:func:`search` finds near texts: bands of sampled fingerprint bits name candidates,
a likeness too low drops them, and the edit distance of the whole texts decides.

Defined results: null counts as the empty text; equal texts have equal
fingerprints, and only the empty text has the fingerprint of nothing; likeness 1
for equal fingerprints.  In :func:`op11` the next document is the one behind in
descending doc_id, null ids last, equal ids by a hash of their text; repeated rows
are documents of their own; a single document is its own next one; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from . import common

WALKS = 4
BITS = 512
#: Characters fall into so many classes of equal random bits; ASCII has a class for each.
CLASSES = 128
#: Steps after which a walk's random bits repeat.
PERIOD = 2048
#: Bytes of text whose characters are walked together.
SLICE = 4 << 20
#: Texts that are walked in step; fewer are walked one by one.
TOGETHER = 32
#: Similarity of edits that :func:`search` looks for, and share of pairs at it that no band may name.
SIMILARITY = 0.8
MISSED = 0.001
#: Likeness of texts that have nothing in common but how often they use their characters.
UNRELATED = 0.15


def _mixed(x: np.ndarray) -> np.ndarray:
    """Well mixed 64-bit numbers (the finaliser of SplitMix64)."""
    x = (x + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def _stays() -> np.ndarray:
    """Steps that a walk stays on a character: [walk, class, step of arrival modulo PERIOD], one after another."""
    cells = np.arange(WALKS * CLASSES * PERIOD, dtype=np.uint64)
    moves = (_mixed(cells) >> np.uint64(63)).reshape(-1, PERIOD).astype(bool)
    moves[:, -1] = True
    # the next step that moves on, seen from each step
    ahead = np.where(moves, np.arange(PERIOD), PERIOD)
    ahead = np.minimum.accumulate(ahead[:, ::-1], axis=1)[:, ::-1]
    return (ahead - np.arange(PERIOD) + 1).astype(np.int32).reshape(-1)


@cache
def _priorities() -> np.ndarray:
    """[bit, k]: steps with less priority than all before them, from long walks to short ones, down to step 0."""
    unit = _mixed(np.arange(BITS * 64, dtype=np.uint64) + np.uint64(1 << 40)).reshape(BITS, 64) / 2.0**64
    out, now = np.zeros((BITS, 64), np.int64), np.full(BITS, 1 << 36, np.int64)
    for k in range(64):
        now = np.floor(unit[:, k] * now).astype(np.int64)
        out[:, k] = now
    return out


def _walked(classes: np.ndarray, first: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(step of arrival at each character, steps of each whole text) of every walk, for texts in a row."""
    stays, mask = _stays(), np.int32(PERIOD - 1)
    row = (np.arange(WALKS) * CLASSES * PERIOD).astype(np.int32)
    arrival = np.empty((len(classes), WALKS), np.int32)
    base = classes.astype(np.int32) * PERIOD
    order = np.argsort(-lengths, kind="stable")
    start, now = first[order], np.zeros((len(order), WALKS), np.int32)
    # texts that are longer than i are the first ones
    active = np.searchsorted(-lengths[order], -np.arange(lengths.max(initial=0)), "left")
    together = int((active >= TOGETHER).sum())
    for i in range(together):
        at = start[: active[i]] + i
        step = now[: active[i]]
        arrival[at] = step
        step += stays[(step & mask) + base[at][:, None] + row]
    for lane in range(int(active[together]) if together < len(active) else 0):
        lo, hi = int(start[lane]) + together, int(first[order[lane]] + lengths[order[lane]])
        letters = classes[lo:hi].tolist()
        for w in range(WALKS):
            rows = _rows(w)
            t, seen = int(now[lane, w]), []
            for c in letters:
                seen.append(t)
                t += rows[c][t & (PERIOD - 1)]
            arrival[lo:hi, w] = seen
            now[lane, w] = t
    total = np.empty_like(now)
    total[order] = now
    return arrival, total


@cache
def _rows(walk: int) -> list[list[int]]:
    return _stays().reshape(WALKS, CLASSES, PERIOD)[walk].tolist()


def fingerprints(texts: list[str]) -> np.ndarray:
    """A row of BITS / 8 bytes for each text."""
    points = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
    lengths = np.array([len(t) for t in texts], np.int64)
    first = np.cumsum(lengths) - lengths
    arrival, total = _walked(((points ^ (points >> 7)) & (CLASSES - 1)).astype(np.uint8), first, lengths)
    chain, each = _priorities(), BITS // WALKS
    step = np.zeros((len(texts), BITS), np.int64)
    for i in range(BITS):
        step[:, i] = chain[i][np.minimum(np.searchsorted(-chain[i], -total[:, i // each].astype(np.int64), "right"), 63)]
    point = np.full((len(texts), BITS), 0x110000, np.uint64)  # no character
    for k, (lo, n) in enumerate(zip(first.tolist(), lengths.tolist(), strict=True)):
        for w in range(WALKS if n else 0):
            mine = slice(w * each, (w + 1) * each)
            point[k, mine] = points[lo + np.searchsorted(arrival[lo : lo + n, w], step[k, mine], "right") - 1]
    hashed = _mixed(_mixed(point * np.uint64(BITS) + np.arange(BITS, dtype=np.uint64)) ^ step.astype(np.uint64))
    return np.packbits((hashed >> np.uint64(63)).astype(np.uint8), axis=1)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """0 to 1 for rows of fingerprints."""
    return np.maximum(0.0, 1.0 - 2.0 * np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64) / BITS)


def _binary(rows: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(rows)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((np.arange(len(rows) + 1) * (BITS // 8)).astype(np.int32)), pa.py_buffer(rows)])


def _texts(batch: pa.RecordBatch, size: int) -> Iterator[tuple[int, list[str]]]:
    texts = common.as_strings(batch.column("text"))
    for lo, hi in common.slices(texts, size):
        yield lo, texts.slice(lo, hi - lo).to_pylist()


def fingerprint(docs: DataFrame, key: str = "doc_id", size: int = SLICE) -> DataFrame:
    """``key``, n_chars and fingerprint (binary) of every text; map only."""
    kind = dict(docs.dtypes)[key]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, texts in _texts(batch, size):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(texts)), pa.array(map(len, texts), pa.int64()), _binary(fingerprints(texts))], names=[key, "n_chars", "fingerprint"])

    return docs.select(key, "text").mapInArrow(task, f"`{key}` {kind}, n_chars long, fingerprint binary")


# -- near texts -------------------------------------------------------------------------------


def edit_distance(a: str, b: str) -> int:
    """Insertions, deletions and replacements between two texts, a column of the table in one number at a time."""
    if len(a) < len(b):
        a, b = b, a
    n = len(b)
    if not n:
        return len(a)
    places: dict[str, int] = {}
    for i, c in enumerate(b):
        places[c] = places.get(c, 0) | 1 << i
    full, last, score = (1 << n) - 1, 1 << (n - 1), n
    up, down = full, 0  # where a column rises and falls from cell to cell
    for c in a:
        same = places.get(c, 0)
        level = ((((same & up) + up) ^ up) | same) | down
        rise, fall = down | (full & ~(level | up)), up & level
        score += bool(rise & last) - bool(fall & last)
        rise, fall = (rise << 1 | 1) & full, fall << 1 & full
        up, down = fall | (full & ~(level | rise)), rise & level
    return score


def bands(n_texts: int, similarity: float = SIMILARITY, missed: float = MISSED) -> tuple[int, int]:
    """(bands, bits of each): wide enough that unrelated texts rarely meet, as many as a pair at ``similarity`` needs."""
    width = int(np.ceil(np.log(max(n_texts, 2)) / -np.log((1 + UNRELATED) / 2)))
    return int(np.ceil(np.log(missed) / np.log1p(-(((1 + similarity) / 2) ** width)))), width


def _band_keys(prints: DataFrame, n_bands: int, width: int) -> DataFrame:
    """id, band, key: a row for each text and band of ``width`` bits chosen at random."""
    chosen = _mixed(np.arange(n_bands * BITS, dtype=np.uint64) + np.uint64(1 << 50)).reshape(n_bands, BITS).argsort(axis=1)[:, :width]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            bits = np.unpackbits(np.frombuffer(b"".join(batch.column("fingerprint").to_pylist()), np.uint8).reshape(len(batch), -1), axis=1)
            for band, places in enumerate(chosen):
                key = pa.array(np.packbits(bits[:, places], axis=1).tobytes()[i : i + -(-width // 8)] for i in range(0, len(batch) * -(-width // 8), -(-width // 8)))
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.full(len(batch), band, np.int32)), key.cast(pa.binary())], names=["id", "band", "key"])

    return prints.select("id", "fingerprint").mapInArrow(task, "id long, band int, key binary")


def search(docs: DataFrame, is_query: Column, similarity: float = SIMILARITY) -> DataFrame:
    """query_id, doc_id, distance: the texts near each query, its own row left out.

    Near means edits for at most ``1 - similarity`` of the longer text's characters.
    Texts are looked up once for all their copies; of n texts, a pair just at
    ``similarity`` is missed with probability ``MISSED`` where its likeness is its
    similarity.  Null ids neither ask nor are found.
    """
    with common.scratch() as keep:
        rows = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(is_query, F.lit(False)).alias("asks"))
        rows = common.settle(rows.withColumn("sha", F.unhex(F.sha2("text", 256))), "search-rows")
        texts = rows.groupBy("sha").agg(F.max("asks").alias("asks"), F.first("text").alias("text"), F.count(F.lit(1)).alias("n"))
        texts = common.settle(texts.select(F.monotonically_increasing_id().alias("id"), "*"), "search-texts")
        n_bands, width = bands(texts.count(), similarity)
        prints = common.settle(fingerprint(texts.select("id", "text"), "id"), "search-prints")
        keys = common.settle(_band_keys(prints, n_bands, width).join(texts.select("id", "asks"), "id"), "search-bands")
        asked = keys.filter("asks").select("band", "key", F.col("id").alias("query"))
        met = asked.join(keys.select("band", "key", "id"), ["band", "key"]).select("query", "id").distinct()
        # what is far by fingerprint, or by length alone, is not read
        mine = prints.join(texts.select("id", F.length("text").alias("length")), "id").select("id", "fingerprint", "length")
        theirs = mine.select(F.col("id").alias("query"), F.col("fingerprint").alias("asked"), F.col("length").alias("asked_length"))
        pairs = met.join(mine, "id").join(theirs, "query")
        long_enough = F.least("length", "asked_length") >= F.greatest("length", "asked_length") * F.lit(similarity) - 1e-9

        def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [edit_distance(a, b) for a, b in zip(batch.column("asked").to_pylist(), batch.column("text").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("query"), batch.column("id"), pa.array(found, pa.int64())], names=["query", "id", "distance"])

        # a likeness is the mean of BITS bits: four deviations below the similarity keep all but one in 30,000
        margin = similarity - 4 * 2 * (((1 + similarity) / 2) * ((1 - similarity) / 2) / BITS) ** 0.5 - SLACK
        near = common.settle(pairs.filter(long_enough & (_likeness("fingerprint", "asked") >= margin)).select("query", "id"), "search-candidates")
        whole = near.join(texts.select("id", "text", F.length("text").alias("length")), "id").join(texts.select(F.col("id").alias("query"), F.col("text").alias("asked")), "query")
        decided = whole.select("query", "id", "asked", "text").mapInArrow(decide, "query long, id long, distance long").join(texts.select("id", F.length("text").alias("length")), "id")
        other = texts.select(F.col("id").alias("query"), F.length("text").alias("asked_length"))
        decided = common.settle(decided.join(other, "query").filter(
            F.col("distance") <= F.floor(F.greatest("length", "asked_length") * F.lit(1 - similarity) + 1e-9),
        ).select("query", "id", "distance"), "search-found")
        named = common.settle(rows.join(texts.select("sha", "id"), "sha").select("id", "doc_id", "asks"), "search-names")
        keep += [decided, named]
    asking = named.filter("asks").select(F.col("id").alias("query"), F.col("doc_id").alias("query_id")).distinct()
    found = decided.join(asking, "query").join(named.select("id", "doc_id").distinct(), "id")
    return found.filter("query_id != doc_id").select("query_id", "doc_id", "distance")


#: Likeness that texts of an edit similarity may fall short of it, because walks need steps to meet again.
SLACK = 0.25


def _likeness(a: str, b: str) -> Column:
    """The likeness of two binary fingerprints, by built-in functions."""
    parts = [F.bit_count(F.conv(F.hex(F.substring(a, i, 8)), 16, -10).cast("long").bitwiseXOR(F.conv(F.hex(F.substring(b, i, 8)), 16, -10).cast("long"))) for i in range(1, BITS // 8 + 1, 8)]
    return F.greatest(F.lit(0.0), 1 - sum(parts[1:], parts[0]) * F.lit(2.0 / BITS))


# -- the query --------------------------------------------------------------------------------

FOUND = "part long, kind int, doc_id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double, text string"
_NAMES = ["part", "kind", "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "text"]
#: Kinds of rows: whole ones, a partition's first document, and its last one, whose next is in another partition.
DONE, HEAD, TAIL = range(3)


def _record(part: int, kind: int, ids: list, n_chars: list, prints: np.ndarray | None = None, more: dict | None = None, texts: list | None = None) -> pa.RecordBatch:  # noqa: E501
    n, more = len(ids), more or {}
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64(), pa.string()]
    given = {"part": [part] * n, "kind": [kind] * n, "doc_id": ids, "n_chars": n_chars, "text": texts} | more
    columns = [pa.nulls(n, t) if given.get(k) is None else pa.array(given[k], t) for k, t in zip(_NAMES, kinds, strict=True)]
    if prints is not None:
        columns[5] = _binary(prints)
    return pa.RecordBatch.from_arrays(columns, names=_NAMES)


def _edited(text: str, follows: str) -> str:
    """``text`` with its last third replaced by the start of the next document."""
    third = len(text) // 3
    return text[: len(text) - third] + follows[:third]


def _compared(texts: list[str], follows: list[str], own: Callable[[list[str]], np.ndarray]) -> tuple[np.ndarray, dict]:
    """Fingerprints of ``texts`` and of the ``follows`` of the last, and the columns of their edited texts."""
    edited = [_edited(t, f) for t, f in zip(texts, follows, strict=True)]
    n = len(texts)
    prints = own([*texts, follows[-1], *edited])
    before, after = prints[: n + 1], prints[n + 1 :]
    return before, {
        "edited_sha256": [hashlib.sha256(e.encode()).digest() for e in edited], "edited_fingerprint": [x.tobytes() for x in after],
        "near_edited": likeness(before[:n], after), "near_next": likeness(before[:n], before[1:]),
    }


def with_next(docs: DataFrame, size: int = SLICE) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next; all digests binary.

    Documents are dealt once, by ranges of descending doc_id; neighbours meet in
    their task, and a partition's last document meets the first one of the next
    partition afterwards.
    """
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("m"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("h"), F.col("m")]
    parts = common.partitions_for(docs, common.text_bytes(docs))
    ordered = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last = TaskContext.get().partitionId(), None
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for lo, texts in _texts(batch, size):
                mine = ids[lo : lo + len(texts)]
                if last is None:
                    yield _record(part, HEAD, mine[:1], [len(texts[0])], texts=texts[:1])
                else:
                    mine, texts = [last[0], *mine], [last[1], *texts]
                if len(texts) > 1:
                    prints, more = _compared(texts[:-1], texts[1:], fingerprints)
                    yield _record(part, DONE, mine[:-1], [len(t) for t in texts[:-1]], prints[:-1], more)
                last = mine[-1], texts[-1]
        if last is not None:
            yield _record(part, TAIL, [last[0]], [len(last[1])], texts=[last[1]])

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, doc, text, follows in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                prints, more = _compared([text], [follows], fingerprints)
                yield _record(part, DONE, [doc], [len(text)], prints[:1], more)

    with common.scratch() as keep:
        found = common.settle(ordered.select("doc_id", "text").mapInArrow(walk, FOUND), "edit-fingerprints")
        keep.append(found)
    heads = found.filter(F.col("kind") == HEAD).select(F.col("part").alias("of"), F.col("text").alias("follows"))
    every = W.orderBy("of")  # a row for each partition
    follower = heads.select("of", F.lead("of").over(every).alias("next"), F.min("of").over(W.partitionBy()).alias("least"))
    follower = follower.select(F.col("of").alias("part"), F.coalesce("next", "least").alias("of"))
    tails = found.filter(F.col("kind") == TAIL).select("part", "doc_id", "text").join(follower, "part").join(heads, "of")
    closed = tails.select("part", "doc_id", "text", "follows").mapInArrow(close, FOUND)
    return found.filter(F.col("kind") == DONE).unionByName(closed).drop("part", "kind", "text")


def op11(docs: DataFrame) -> DataFrame:
    found = with_next(docs)
    hexed = [F.lower(F.hex(c)).alias(c) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")]
    return found.select("doc_id", "n_chars", *hexed, "near_edited", "near_next")
