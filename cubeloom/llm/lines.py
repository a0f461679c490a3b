"""Line dedup by content-defined chunks of lines.

Every line is hashed; a rolling hash over the last ``REACH`` line hashes sets a
boundary unless its low bits are zero, so that boundaries move with the content
and a passage is cut alike wherever it stands.  A chunk begins at every boundary and
ends at the first one that is ``MIN_LINES`` lines or more behind it: neither
depends on the chunk before, and chunks overlap.  Chunks whose hash occurs more than
once are grouped by their bytes, and of equal ones all but the first, by (doc_id,
digest of the row, place), are repeats; lines that a repeat covers are removed.
Chunks are judged on the input, and the first copy of a line always stays.

Lines are what stands between newlines; a chunk's bytes are its lines joined by
newlines.  Defined results: null text has no lines; empty lines count; a
document's ends are boundaries; rows of equal doc_id and text are cut and
judged alike, so neither loses what the other has; a null doc_id stands before
all others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Lines that the rolling hash looks back on; no boundary after one line in ``EVERY``; fewest lines of a chunk.
REACH = 1
EVERY = 4
MIN_LINES = 2

_MULTIPLIER = 0x9E3779B97F4A7C15
_ALL = (1 << 64) - 1


def chunks(text: str | None) -> list[tuple[int, int]]:
    """(first line, line after the last) of every chunk of a text, in order."""
    if text is None:
        return []
    hashes = [xxhash.xxh3_64_intdigest(x) for x in text.encode().split(b"\n")]
    cuts, rolling = [0], 0
    leave = pow(_MULTIPLIER, REACH, 1 << 64)
    for i, h in enumerate(hashes[:-1]):
        rolling = (rolling * _MULTIPLIER + h - (hashes[i - REACH] * leave if i >= REACH else 0)) & _ALL
        if (rolling >> 40) % EVERY:
            cuts.append(i + 1)
    cuts.append(len(hashes))
    out, end = [], 0
    for first in cuts[:-1]:
        while end < len(cuts) and cuts[end] < first + MIN_LINES:
            end += 1
        if end < len(cuts):
            out.append((first, cuts[end]))
    return out


def _cut(with_bytes: bool):  # noqa: ANN202
    """Chunks; with bytes only those places that are asked for."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 1000):
                some = batch.slice(lo, 1000)
                rows, places, hashes, texts = [], [], [], []
                asked = [set(x) for x in some.column(3).to_pylist()] if with_bytes else None
                for row, text in enumerate(some.column(2).to_pylist()):
                    lines = (text or "").split("\n")
                    for place, (a, b) in enumerate(chunks(text)):
                        if asked is None or place in asked[row]:
                            line = "\n".join(lines[a:b])
                            rows.append(row)
                            places.append(place)
                            hashes.append(xxhash.xxh3_64_intdigest(line.encode()))
                            texts.append(line if with_bytes else None)
                at = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [some.column(0).take(at), some.column(1).take(at), pa.array(places, pa.int32()), pa.array(np.array(hashes, np.uint64).view(np.int64)), pa.array(texts, pa.string())],
                    names=["doc_id", "key", "place", "hash", "bytes"],
                )

    return task


def _base(docs: DataFrame) -> DataFrame:
    # one plan for inner and outer joins, so that both read the same shuffle of the texts
    return docs.select("doc_id", common.digest("doc_id", "text").alias("key"), "text").filter(F.col("key").isNotNull())


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """key, and the places (``gone``) of the chunks of lines that an earlier document or place also has.

    Chunks whose hash stands more than once are grouped by hash and bytes, and the
    first of each group is elected.  Only the elected go back to their documents:
    what else was asked there is gone.  So no row of a frequent passage meets the
    others of it.
    """
    found = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, key binary, place int, hash long, bytes string"
    with common.scratch() as keep:
        hashes = common.settle(_base(docs).mapInArrow(_cut(False), found).select("key", "place", "hash"), "line-chunks")
        many = common.settle(hashes.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "line-hashes")
        repeated = common.join_counted(hashes, many, "hash", hashes.count())
        asked = common.settle(repeated.groupBy("key").agg(F.collect_set("place").alias("asked")), "line-places")
        keep.append(asked)
    same = _base(docs).join(asked, "key").select("doc_id", "key", "text", "asked").mapInArrow(_cut(True), found)
    # equal bytes, not only equal hashes; the first in order of document and place stays
    first = same.groupBy("hash", "bytes").agg(F.min(F.struct("doc_id", "key", "place")).alias("first"))
    elected = first.groupBy("first.key").agg(F.collect_set("first.place").alias("elected"))
    gone = F.array_except("asked", F.coalesce("elected", F.array().cast("array<int>")))
    return asked.join(elected, "key", "left").select("key", gone.alias("gone")).filter(F.size("gone") > 0)


RESULT = "n_lines long, n_removed long, kept string, kept_sha256 string"


def dedup(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_lines, n_removed, the text that is kept and its SHA-256."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    gone = repeated_chunks(docs)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 1000):
                some = batch.slice(lo, 1000)
                out: list[list] = [[], [], [], []]
                for text, places in zip(some.column(1).to_pylist(), some.column(2).to_pylist(), strict=True):
                    lines = [] if text is None else text.split("\n")
                    kept = lines
                    if places:
                        cut = chunks(text)
                        drop = {line for n in places for line in range(*cut[n])}
                        kept = [x for n, x in enumerate(lines) if n not in drop]
                    joined = "\n".join(kept)
                    for to, x in zip(out, (len(lines), len(lines) - len(kept), joined, hashlib.sha256(joined.encode()).hexdigest()), strict=True):
                        to.append(x)
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.string())],
                    names=["doc_id", "n_lines", "n_removed", "kept", "kept_sha256"],
                )

    return _base(docs).join(gone, "key", "left").select("doc_id", "text", "gone").mapInArrow(task, f"doc_id {kind}, {RESULT}")


def op5(docs: DataFrame) -> DataFrame:
    return dedup(docs).select("doc_id", "n_lines", "n_removed", "kept_sha256")

