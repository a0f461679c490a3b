"""What the operators of this subpackage share: shared storage, cut lineage, word arrays.

Everything that outlives a stage is written under the folder named by
``spark.checkpoint.dir``, which driver and executors share.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import delete, shared_dir

#: ASCII white space, as in ``[\x20\x09-\x0D]``.
SPACE = b" \t\n\r\x0b\x0c"
#: Bytes of text for each partition of a text-heavy shuffle.
PARTITION_BYTES = 24 << 20
#: Keys that a join may broadcast because each has more than its share of all rows.
HOT_KEYS = 10_000
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Files that a task keeps open, so that rows of different folders need not be sorted first.
_WRITERS = "spark.sql.maxConcurrentOutputFileWriters"


def settle(df: DataFrame, tag: str, compression: str | None = None, apart: str | None = None) -> DataFrame:
    """Write ``df`` to shared storage and read it again: lineage ends there.

    Rows that differ in the column ``apart`` lie in folders of their own, which
    :func:`discard_part` can delete.

    Shuffle files of the work behind it are of no more use, and are given up.
    """
    spark = df.sparkSession
    path = shared_dir(spark, tag)
    before = {k: spark.conf.get(k, v) for k, v in ((_CLEANUP, "false"), (_WRITERS, "0"))}
    spark.conf.set(_CLEANUP, "true")
    spark.conf.set(_WRITERS, "4" if apart else before[_WRITERS])
    try:
        df.write.parquet(path, compression=compression, partitionBy=apart)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_at = path
    if _OPEN:
        _OPEN[-1].append(out)
    return out


#: What was settled inside each :func:`scratch` that is open.
_OPEN: list[list[DataFrame]] = []


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """What is settled inside is deleted at its end, but for the frames put on the list that it gives."""
    made: list[DataFrame] = []
    keep: list[DataFrame] = []
    _OPEN.append(made)
    try:
        yield keep
    finally:
        _OPEN.pop()
        kept = {df._settled_at for df in keep}
        discard(*(df for df in made if df._settled_at not in kept))
        if _OPEN:
            _OPEN[-1] += keep


def discard(*settled: DataFrame) -> None:
    """Delete what :func:`settle` wrote for these; nothing may read them any more."""
    for df in settled:
        delete(df.sparkSession, df._settled_at)


def discard_part(settled: DataFrame, apart: str, value: str) -> None:
    """Delete the rows of ``settled`` with one value of the column that it was settled by; nothing may read them any more."""
    delete(settled.sparkSession, f"{settled._settled_at}/{apart}={value}")


def put(folder: str, name: str, data: bytes | pa.Buffer) -> None:
    """A file in shared storage; it has its name only once it is whole.

    A task that runs again replaces what its first attempt left under the name;
    not every store renames onto a file that exists.
    """
    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    draft = f"{path}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(draft, compression=None) as out:
        out.write(data)
    if store.get_file_info(f"{path}/{name}").type != fs.FileType.NotFound:
        store.delete_file(f"{path}/{name}")
    store.move(draft, f"{path}/{name}")


def get(folder: str, name: str) -> pa.Buffer:
    """The bytes of a file in shared storage."""
    store, path = fs.FileSystem.from_uri(folder)
    with store.open_input_stream(f"{path}/{name}", compression=None) as source:
        return source.read_buffer()


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """Bytes of UTF-8 text in ``docs``; one scan of that column, one number back."""
    return docs.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0)).alias("n")).first()["n"]


def partitions_for(docs: DataFrame, size: int, per: int = PARTITION_BYTES) -> int:
    """Partitions for ``size`` bytes: enough for ``per`` bytes each, and for every core."""
    return max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // per))


def digest(*columns: str) -> "F.Column":
    """SHA-256 of the columns' values as text, null apart from all others: who has it has those values."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in columns]
    return F.unhex(F.sha2(F.concat_ws("\x00", *parts), 256))


def hot_from(n_rows: int) -> int:
    """The most rows of a key of ``n_rows`` that is not yet hot."""
    return max(64, n_rows // HOT_KEYS)


def join_counted(rows: DataFrame, counted: DataFrame, key: str, n_rows: int) -> DataFrame:
    """Inner join of ``rows`` with ``counted``, which has each ``key`` once and how often ``rows`` has it as ``n``.

    A key with more than one in ``HOT_KEYS`` of all ``n_rows`` would fill a task;
    there are fewer than ``HOT_KEYS`` of them, so they are broadcast, and only the
    others are shuffled.
    """
    most = hot_from(n_rows)
    hot, cool = counted.filter(F.col("n") > most), counted.filter(F.col("n") <= most)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cool, key)
    return rows.join(F.broadcast(hot), key).unionByName(rest)


def lower_ascii(texts: pa.Array) -> pa.Array:
    """A-Z to a-z, other bytes as they are."""
    return translated(texts, bytes(c + 32 if 65 <= c <= 90 else c for c in range(256)))


def as_strings(texts: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One string array that starts at offset 0, nulls as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.string())
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    return texts if texts.offset == 0 else pa.concat_arrays([texts, pa.array([], pa.large_string())])


def translated(texts: pa.Array, table: bytes) -> pa.Array:
    """Every byte of every text through ``table``, which keeps lengths and valid UTF-8."""
    texts = as_strings(texts)
    _, offsets, data = texts.buffers()
    if data is None or not len(texts):
        return texts
    return pa.Array.from_buffers(pa.large_string(), len(texts), [None, offsets, pa.py_buffer(data.to_pybytes().translate(table))])


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words between runs of ASCII white space, and the first word's place of each text.

    Returns (flat word array, bounds) with text i holding words bounds[i]:bounds[i+1].
    """
    lists = pc.ascii_split_whitespace(as_strings(texts))
    flat = lists.flatten()
    bounds = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(lists)).astype(np.int64))]) if len(lists) else np.zeros(1, np.int64)
    full = np.asarray(pc.greater(pc.binary_length(flat), 0)).astype(bool)
    if not full.all():
        bounds = np.concatenate([[0], np.cumsum(full)])[bounds]
        flat = flat.filter(pa.array(full))
    return flat, bounds


def slices(texts: pa.Array, size: int) -> Iterator[tuple[int, int]]:
    """(first, behind last) of runs of texts of about ``size`` bytes, at least one text each."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64))
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
        yield at, to
        at = to


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start+1, ... for each of ``lengths`` numbers, one after another."""
    lengths = np.asarray(lengths, np.int64)
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) - np.repeat(ends - lengths - np.asarray(starts, np.int64), lengths)
