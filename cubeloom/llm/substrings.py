'''Substring dedup with fixed-block anchors.

Any repeat of ``WINDOW`` words covers, in its reference document, one of the
non-overlapping blocks of ``BLOCK`` words that start at multiples of ``BLOCK``
(2 * BLOCK - 1 <= WINDOW).  So the blocks of all documents are indexed, every
rolling window of ``BLOCK`` words of every document probes them, and a place is
a hit if its hash is that of a block that also stands somewhere else.  Hits are
then extended: every ``WINDOW`` words around a hit look for the first place with
their hash, runs of such places are the maximal repeats, and their words are
compared with the words at the place found.

Hashes only find.  What is removed was compared word by word: inside a chunk by
exact word numbers, across chunks by the words of a run, which travel to the
chunk that holds the earlier place.  A window whose words differ from those at
the first place with its hash is grouped by its words with all others of that
kind, so that any hash, however bad, leads to the same result.

How it is spread: documents are sorted by (doc_id, text) in ranges and written as
chunks of about ``CHUNK_WORDS`` words to shared storage; a chunk's number and a
word's number in it are the order of all places.  Windows are dealt by hash to
buckets whose number grows with the text, packed as arrays.  A chunk sends one of
its own equal windows, so a passage in a third of all documents costs a bucket
one entry per chunk; requests to one chunk are split by their size.  What is
found for a chunk is bounded by its words.

Defined results: null text has no words; texts under ``WINDOW`` words lose
nothing; rows of equal doc_id and equal text are one document, so neither is
earlier than the other; rows of equal doc_id and other text stand in order of a
hash of their text, then of the text; a null doc_id stands before all others.
'''

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW = 20
BLOCK = 10
#: Windows for each bucket, on average, and words for each chunk.
BUCKET_WINDOWS = 2_500_000
CHUNK_WORDS = 1_000_000
#: Bytes of text that are split into words at a time.
SLICE = 6 << 20
#: Words that a task compares for one chunk at least, before requests to it are split; a request counts as so many more.
ASKED_WORDS = 100_000
ASKING_WORDS = 400

PACKED = "bucket int, chunk long, hashes binary, gaps binary, flags binary"
_PACKED = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), *((k, pa.binary()) for k in ("hashes", "gaps", "flags"))])
#: Places in a chunk, and the earlier places that have their hashes (nothing where words are compared already).
FOUND = "chunk long, places binary, from_chunks binary, from_places binary"
_FOUND = pa.schema([("chunk", pa.int64()), *((k, pa.binary()) for k in ("places", "from_chunks", "from_places"))])
#: A run of windows of ``chunk`` and its words, for the chunk ``holder`` to compare from ``from_place`` on.
ASKED = "holder long, from_place long, chunk long, place long, n long, words binary"
_ASKED = pa.schema([*((k, pa.int64()) for k in ("holder", "from_place", "chunk", "place", "n")), ("words", pa.binary())])
WRONG = "chunk long, place long, words binary"
_WRONG = pa.schema([("chunk", pa.int64()), ("place", pa.int64()), ("words", pa.binary())])


# -- hashing ----------------------------------------------------------------------------------


def _factors(width: int) -> np.ndarray:
    return np.random.default_rng(20).integers(0, 1 << 63, width, np.uint64) * np.uint64(2) + np.uint64(1)


def rolling(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of every ``width`` consecutive words: a sum with an odd factor for each place, then mixed."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for place, factor in enumerate(_factors(width)):
        word = words[place : place + n]
        out += (word ^ (word >> np.uint64(29))) * factor
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(32))


def _same(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order that brings equal hashes together (stable), and the first of each run in it."""
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    return order, np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(hashes) else np.zeros(0, np.int64)


# -- chunks in shared storage -----------------------------------------------------------------


def _as_before(column: pa.Array) -> np.ndarray:
    """Whether each value but the first equals the one before it, null being null's equal."""
    a, b = column.slice(1), column.slice(0, max(len(column) - 1, 0))
    return np.asarray(pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))).astype(bool)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, copies): rows that are repeated stand next to each other, and become one."""
    last: pa.RecordBatch | None = None
    for batch in batches:
        batch = pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.ones(len(batch), np.int64))], names=["doc_id", "text", "copies"])
        if last is not None:
            batch = pa.concat_batches([last, batch])
        if not len(batch):
            continue
        new = np.concatenate([[True], ~(_as_before(batch.column(0)) & _as_before(batch.column(1)))])
        first = np.flatnonzero(new)
        copies = np.add.reduceat(np.asarray(batch.column(2)), first)
        rows = pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(first)), batch.column(1).take(pa.array(first)), pa.array(copies)], names=batch.schema.names,
        )
        last = rows.slice(len(rows) - 1)
        yield rows.slice(0, len(rows) - 1)
    if last is not None:
        yield last


def _write_chunks(folder: str, chunk_words: int) -> Callable:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, rows, held = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> pa.RecordBatch:
            nonlocal seq, rows, held
            chunk = part << 24 | seq
            sink = pa.BufferOutputStream()
            with pa.ipc.new_file(sink, rows[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                for row in rows:
                    out.write(row)
            common.put(folder, f"{chunk}.arrow", sink.getvalue())
            seq, rows, held = seq + 1, [], 0
            return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64())], names=["chunk"])

        for batch in _documents(batches):
            for lo, hi in common.slices(batch.column(1), SLICE):
                some = batch.slice(lo, hi - lo)
                rows.append(some)
                held += int(pc.sum(pc.list_value_length(pc.ascii_split_whitespace(common.as_strings(some.column(1))))).as_py() or 0)
                if held >= chunk_words:
                    yield flush()
        if rows:
            yield flush()

    return task


class Chunk:
    """A chunk's documents and all their words in a row; a place is the number of a word."""

    def __init__(self, folder: str, number: int):
        self.rows = pa.ipc.open_file(common.get(folder, f"{number}.arrow")).read_all().combine_chunks()
        texts = self.rows.column("text").combine_chunks()
        flats, counts = [], [np.zeros(0, np.int64)]
        for lo, hi in common.slices(texts, SLICE):
            words, bounds = common.split_words(texts.slice(lo, hi - lo))
            flats.append(words)
            counts.append(np.diff(bounds))
        self.words = pa.concat_arrays(flats) if flats else pa.array([], pa.large_string())
        self.bounds = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
        self.long = np.diff(self.bounds) >= WINDOW

    def numbered(self, hash_bits: int) -> None:
        """Give every word its number among the chunk's words, and a hash; windows will have hashes of ``hash_bits``."""
        self.mask = np.uint64((1 << hash_bits) - 1)
        table = self.words.dictionary_encode()
        self.codes = np.asarray(table.indices)
        own = np.array([xxhash.xxh3_64_intdigest(w) for w in table.dictionary.cast(pa.large_binary()).to_pylist()], np.uint64)
        self.hashes = own[self.codes] if len(own) else np.zeros(0, np.uint64)

    def blocks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, hash, stands at a multiple of ``BLOCK``) of every ``BLOCK`` words of documents that are long enough."""
        counts = np.where(self.long, np.diff(self.bounds) - BLOCK + 1, 0)
        place = common.ranges(self.bounds[:-1], counts)
        return place, self.hashed(place, BLOCK), (place - np.repeat(self.bounds[:-1], counts)) % BLOCK == 0

    def hashed(self, place: np.ndarray, width: int) -> np.ndarray:
        return (rolling(self.hashes, width)[place] if len(place) else np.zeros(0, np.uint64)) & self.mask

    def around(self, hits: np.ndarray) -> np.ndarray:
        """Places of the windows that hold a hit."""
        doc = np.searchsorted(self.bounds, hits, "right") - 1
        edge = np.zeros(len(self.words) + 1, np.int64)
        np.add.at(edge, np.maximum(hits - (WINDOW - BLOCK), self.bounds[doc]), 1)
        np.add.at(edge, np.minimum(hits, self.bounds[doc + 1] - WINDOW) + 1, -1)
        return np.flatnonzero(np.cumsum(edge[:-1]) > 0)

    def run(self, place: int, n: int) -> bytes:
        """The words of ``n`` windows from ``place`` on."""
        return " ".join(self.words.slice(place, n + WINDOW - 1).to_pylist()).encode()


# -- packed windows ---------------------------------------------------------------------------


def _gaps(places: np.ndarray) -> bytes:
    """Places in order as differences, two or four bytes each."""
    gaps = np.diff(places, prepend=0)
    kind = "<u2" if gaps.max(initial=0) < 1 << 16 else "<u4"
    return kind[2].encode() + gaps.astype(kind).tobytes()


def _ungap(gaps: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(gaps, f"<u{gaps[:1].decode()}", offset=1).astype(np.int64))


def _pack(full: np.ndarray, kind: str, place: np.ndarray, flag: np.ndarray, n_buckets: int, chunk: int) -> pa.RecordBatch:
    """A row for each bucket: remaining hash bits, places in the chunk, flags."""
    bucket, low = (full % np.uint64(n_buckets)).astype(np.int64), (full // np.uint64(n_buckets)).astype(kind)
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1))
    mine = [order[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
    columns = [
        bucket[order[cuts[:-1]]], [chunk] * len(mine), [low[m].tobytes() for m in mine], [_gaps(place[m]) for m in mine],
        [np.packbits(flag[m]).tobytes() for m in mine],
    ]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PACKED, strict=True)], schema=_PACKED)


def _known(chunk: int, places: np.ndarray, n_buckets: int) -> pa.RecordBatch:
    """Places that a chunk knows by itself; some bucket passes them on."""
    columns = [[chunk * 0x9E3779B1 % n_buckets], [chunk], [b""], [_gaps(places)], [b""]]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PACKED, strict=True)], schema=_PACKED)


class _Bucket:
    """All entries of one bucket in order of hash, chunk and place."""

    def __init__(self, table: pa.Table, kind: str):
        self.found: list[tuple[int, bytes, bytes, bytes]] = []
        chunks, lows, places, flags = [np.zeros(0, np.int64)], [np.zeros(0, kind)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
        for chunk, hashes, gaps, flag in zip(*(table.column(k).to_pylist() for k in ("chunk", "hashes", "gaps", "flags")), strict=True):
            if not hashes:
                self.found.append((chunk, _ungap(gaps).astype("<u4").tobytes(), b"", b""))
                continue
            low = np.frombuffer(hashes, kind)
            chunks.append(np.full(len(low), chunk))
            lows.append(low)
            places.append(_ungap(gaps))
            flags.append(np.unpackbits(np.frombuffer(flag, np.uint8), count=len(low)).astype(bool))
        chunk, low, place, flag = (np.concatenate(x) for x in (chunks, lows, places, flags))
        order = np.lexsort((place, chunk, low))
        self.chunk, self.place, self.flag = chunk[order], place[order], flag[order]
        low = low[order]
        self.runs = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]])) if len(low) else np.zeros(0, np.int64)
        self.size = np.diff(np.append(self.runs, len(low)))

    def out(self, chosen: np.ndarray, first: np.ndarray | None = None) -> pa.Table:
        """A row for each chunk with the ``chosen`` entries, and with the ``first`` ones of their hashes."""
        at = np.flatnonzero(chosen)
        at = at[np.argsort(self.chunk[at], kind="stable")]
        cuts = np.flatnonzero(np.diff(self.chunk[at], prepend=-1, append=-1))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            mine = at[a:b]
            refs = (b"", b"") if first is None else (self.chunk[first[mine]].astype("<i8").tobytes(), self.place[first[mine]].astype("<u4").tobytes())
            self.found.append((int(self.chunk[mine[0]]), self.place[mine].astype("<u4").tobytes(), *refs))
        columns = list(zip(*self.found, strict=True)) or [[], [], [], []]
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, _FOUND, strict=True)], schema=_FOUND)


# -- stage one: index and probe ---------------------------------------------------------------


def _probe(folder: str, n_buckets: int, hash_bits: int) -> Callable:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number in batch.column(0).to_pylist():
                chunk = Chunk(folder, number)
                chunk.numbered(hash_bits)
                place, full, aligned = chunk.blocks()
                # one of equal windows goes to the bucket
                order, runs = _same(full)
                block = np.maximum.reduceat(aligned[order], runs) if len(runs) else np.zeros(0, bool)
                send = order[runs]
                back = np.argsort(send)
                yield _pack(full[send[back]], "<u4", place[send[back]], block[back], n_buckets, number)
                yield _known(number, np.zeros(0, np.int64), n_buckets)

    return task


def _match(table: pa.Table) -> pa.Table:
    """Of one bucket, the places whose hash is an indexed block's and stands more than once."""
    b = _Bucket(table, "<u4")
    chosen = np.zeros(len(b.place), bool)
    if len(b.runs):
        chosen = np.repeat((b.size > 1) & np.maximum.reduceat(b.flag, b.runs), b.size)
    return b.out(chosen)


# -- stage two: extend ------------------------------------------------------------------------


def _extend(folder: str, n_buckets: int, hash_bits: int) -> Callable:
    """Of one chunk, all windows around hits to their buckets."""

    def solve(table: pa.Table) -> pa.Table:
        number = table.column("chunk")[0].as_py()
        chunk = Chunk(folder, number)
        chunk.numbered(hash_bits)
        place, full, _ = chunk.blocks()
        order, runs = _same(full)
        many = np.diff(np.append(runs, len(order))) > 1
        own = place[order[np.repeat(many, np.diff(np.append(runs, len(order))))]] if len(runs) else place
        hits = np.unique(np.concatenate([own, np.frombuffer(b"".join(table.column("places").to_pylist()), "<u4").astype(np.int64)]))
        place = chunk.around(hits) if len(hits) else hits
        full = chunk.hashed(place, WINDOW)
        order, runs = _same(full)
        first = np.repeat(order[runs], np.diff(np.append(runs, len(order)))) if len(runs) else order
        # those with the words of the chunk's first window of that hash are later than it; the others go to the bucket
        mine, earlier = place[order], place[first]
        known = order != first
        for k in range(WINDOW):
            known &= chunk.codes[mine + k] == chunk.codes[earlier + k]
        send = np.sort(order[~known])
        parts = [_pack(full[send], "<u8", place[send], np.ones(len(send), bool), n_buckets, number), _known(number, np.sort(mine[known]), n_buckets)]
        return pa.Table.from_batches(parts, _PACKED)

    return solve


def _repeats(table: pa.Table) -> pa.Table:
    """Of one bucket, the places that are not the first of their hash, with the first."""
    b = _Bucket(table, "<u8")
    first = np.repeat(b.runs, b.size)
    return b.out(np.arange(len(b.place)) != first, first)


# -- stage three: compare words ---------------------------------------------------------------


def _claims(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, earlier chunk, earlier place) of what was found by hash alone, in order of place."""
    rows = [r for r in zip(*(table.column(k).to_pylist() for k in ("places", "from_chunks", "from_places")), strict=True) if r[1]]
    place, chunk, earlier = (np.frombuffer(b"".join(r[k] for r in rows), kind).astype(np.int64) for k, kind in enumerate(("<u4", "<i8", "<u4")))
    order = np.argsort(place, kind="stable")
    return place[order], chunk[order], earlier[order]


def _ask(folder: str) -> Callable:
    """Of one chunk, runs of windows that follow an earlier run word by word, if hashes are right."""

    def solve(table: pa.Table) -> pa.Table:
        number = table.column("chunk")[0].as_py()
        place, holder, earlier = _claims(table)
        if not len(place):
            return _ASKED.empty_table()
        chunk = Chunk(folder, number)
        broken = (np.diff(place) != 1) | (np.diff(earlier) != 1) | (np.diff(holder) != 0)
        begin = np.flatnonzero(np.concatenate([[True], broken]))
        n = np.diff(np.append(begin, len(place)))
        words = [chunk.run(p, k) for p, k in zip(place[begin].tolist(), n.tolist(), strict=True)]
        columns = [holder[begin], earlier[begin], np.full(len(begin), number), place[begin], n, words]
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, _ASKED, strict=True)], schema=_ASKED)

    return solve


def _compare(folder: str) -> Callable:
    """Windows whose words are not those of the earlier place, with their words."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, chunk = None, None
        for batch in batches:
            wrong: list[tuple[int, int, bytes]] = []
            for holder, earlier, asker, place, n, words in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                if holder != number:
                    number, chunk = holder, Chunk(folder, holder)
                own = chunk.run(earlier, n)
                if own != words:
                    a, b = own.split(b" "), words.split(b" ")
                    differ = np.cumsum([0] + [x != y for x, y in zip(a, b, strict=True)])
                    at = np.flatnonzero(differ[WINDOW:] > differ[:-WINDOW]).tolist()
                    wrong += [(asker, place + k, b" ".join(b[k : k + WINDOW])) for k in at]
            columns = list(zip(*wrong, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _WRONG, strict=True)], schema=_WRONG)

    return task


# -- Spark ------------------------------------------------------------------------------------


def repeats(docs: DataFrame, folder: str, chunk_words: int = CHUNK_WORDS, asked_words: int = ASKED_WORDS, hash_bits: int = 64) -> DataFrame:
    """Chunks of ``docs`` under ``folder``; (chunk, places, kept): starts of windows that also start earlier, but for those kept."""
    spark = docs.sparkSession
    size = common.text_bytes(docs)
    parts = common.partitions_for(docs, size)
    n_buckets = max(8, -(-size // (6 * BUCKET_WINDOWS)))  # about six bytes a word
    keys = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    dealt = docs.select("doc_id", "text").repartitionByRange(parts, *keys).sortWithinPartitions(*keys, F.col("text").asc_nulls_first())
    chunks = common.settle(dealt.mapInArrow(_write_chunks(folder, chunk_words), "chunk long"), "chunks")

    def by_chunk(df: DataFrame) -> DataFrame:
        return df.repartitionByRange(2 * parts, "chunk")  # a chunk is much work and few bytes

    with common.scratch() as keep:
        packed = by_chunk(chunks).mapInArrow(_probe(folder, n_buckets, hash_bits), PACKED)
        hits = common.settle(packed.groupBy("bucket").applyInArrow(_match, FOUND).select("chunk", "places"), "anchors")
        packed = by_chunk(hits).groupBy("chunk").applyInArrow(_extend(folder, n_buckets, hash_bits), PACKED)
        found = common.settle(packed.groupBy("bucket").applyInArrow(_repeats, FOUND), "repeats")
        asked = common.settle(by_chunk(found).groupBy("chunk").applyInArrow(_ask(folder), ASKED), "comparisons")
        # a chunk that has more than a task's share of all comparisons is opened by several tasks
        cost = F.sum(F.col("n") + ASKING_WORDS)
        share = max(asked_words, (asked.agg(cost.alias("n")).first()["n"] or 0) // (2 * parts))
        tasks = asked.groupBy("holder").agg(F.ceil(cost / share).alias("tasks")).filter("tasks > 1")
        # there are no more such chunks than tasks, so they are broadcast and no request is moved to find its task
        many = F.coalesce("tasks", F.lit(1))
        shared = asked.join(F.broadcast(tasks), "holder", "left").withColumn("task", F.pmod(F.xxhash64("chunk", "place"), many))
        shared = shared.repartition(2 * parts, "holder", "task").sortWithinPartitions("holder").select(*asked.columns)
        wrong = common.settle(shared.mapInArrow(_compare(folder), WRONG), "unequal")
        keep += [found, wrong]
    common.discard(chunks)
    first = wrong.groupBy("words").agg(F.min(F.struct("chunk", "place")).alias("first"))
    nothing = F.lit(None)
    kept = first.select("first.chunk", nothing.cast("binary").alias("places"), F.col("first.place").alias("kept"))
    return by_chunk(found.select("chunk", "places", nothing.cast("long").alias("kept")).union(kept))


def covered(n_words: int, starts: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Which words stand in a window that starts at one of ``starts``."""
    edge = np.zeros(n_words + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + window, n_words), -1)
    return np.cumsum(edge[:-1]) > 0


RESULT = "n_words long, n_removed long, kept string, spans array<struct<start:bigint,end:bigint>>, kept_sha256 string"
_RESULT = pa.schema([
    ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()),
    ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept_sha256", pa.string()),
])


def dedup(docs: DataFrame, with_text: bool = True, chunk_words: int = CHUNK_WORDS, asked_words: int = ASKED_WORDS, hash_bits: int = 64) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept words, the maximal repeats removed, SHA-256 of what is kept.

    The other parameters change how the work is cut, never the result.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    folder = common.shared_dir(docs.sparkSession, "substring-chunks")

    def solve(table: pa.Table) -> pa.Table:
        chunk = Chunk(folder, table.column("chunk")[0].as_py())
        starts = np.frombuffer(b"".join(x for x in table.column("places").to_pylist() if x), "<u4").astype(np.int64)
        starts = np.setdiff1d(starts, np.array([x for x in table.column("kept").to_pylist() if x is not None], np.int64))
        gone = covered(len(chunk.words), starts)
        ends = np.concatenate([[0], np.cumsum(~gone)])[chunk.bounds]
        n_words = np.diff(chunk.bounds)
        kept = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), chunk.words.filter(pa.array(~gone)))
        lines = pc.binary_join(kept, pa.scalar(" ", pa.large_string())).cast(pa.large_binary()).to_pylist()
        spans: list[list[dict]] = [[] for _ in lines]
        if with_text:
            for i in np.unique(np.searchsorted(chunk.bounds, np.flatnonzero(gone), "right") - 1).tolist():
                edges = np.flatnonzero(np.diff(np.concatenate([[0], gone[chunk.bounds[i] : chunk.bounds[i + 1]].astype(np.int8), [0]])))
                spans[i] = [{"start": a, "end": b} for a, b in edges.reshape(-1, 2).tolist()]
        columns = [
            n_words, n_words - np.diff(ends), [x.decode() for x in lines] if with_text else [None] * len(lines), spans,
            [hashlib.sha256(x).hexdigest() for x in lines],
        ]
        out = pa.table([chunk.rows.column("doc_id"), *(pa.array(c, f.type) for c, f in zip(columns, _RESULT, strict=True))], names=["doc_id", *_RESULT.names])
        return out.take(pa.array(np.repeat(np.arange(len(out)), np.asarray(chunk.rows.column("copies")))))

    return repeats(docs, folder, chunk_words, asked_words, hash_bits).groupBy("chunk").applyInArrow(solve, f"doc_id {kind}, {RESULT}")


def op8(docs: DataFrame) -> DataFrame:
    return dedup(docs, with_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


#: For doc_ids that are unique: places in order of (doc_id, start).
ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, pos, array_to_string(w[pos:pos + 19], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS pos FROM d WHERE len(w) >= 20)),
later AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY s ORDER BY doc_id, pos) AS n FROM x) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 20)) AS p FROM later),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS line, count(*) AS n FROM words ANTI JOIN gone ON gone.doc_id = words.doc_id AND gone.p = words.p GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(kept.n, 0))::BIGINT AS n_removed, sha256(coalesce(line, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""
