"""Benchmark decontamination with an FM-index per training shard.

A shard is a bounded run of documents inside a task.  Its words become symbols,
its suffixes are sorted, and the Burrows-Wheeler transform is kept as a wavelet
matrix with block ranks.  All windows of the benchmark are searched backwards
at once; occurrences are located by stepping to suffixes whose position is
sampled; the spans found are merged per document.

What keeps the index small is exact: a word that no benchmark item holds cannot
be part of an occurrence, so runs of such words shrink to one separator, and
runs of benchmark words shorter than the shortest window go with them.

The windows are the stated query set.  They are handled in blocks of at most
``BLOCK_WORDS`` benchmark words, which bounds what is broadcast.

Defined results: null texts have no words; an item without words has no window;
an item of fewer words than the window is one window of its own length; rows of
one item_id are one item; repeated documents each count; items with a null id occur but are not
listed; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW = 10
#: Words of benchmark items in one broadcast block: 40 bytes a window, and its words once.
BLOCK_WORDS = 500_000
#: Words of documents in one index.
SHARD_WORDS = 2_000_000
#: Every so manieth text position is kept for locating.
SAMPLE = 8

#: a-z, 0-9 and every non-ASCII byte stay, A-Z become a-z, all else is a space.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split()


# -- the index --------------------------------------------------------------------------------


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Suffixes in order, by doubling the compared length."""
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    n, step = len(symbols), 1
    while True:
        ahead = np.zeros(n, np.int64)
        ahead[:-step] = rank[step:] + 1 if step < n else 0
        key = rank * (n + 1) + ahead
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = new
        step *= 2
        if new[-1] == n - 1 or step >= n:
            return order


class WaveletMatrix:
    """rank(symbol, i): how often the symbol stands among the first i."""

    def __init__(self, symbols: np.ndarray):
        self.levels = max(1, int(symbols.max(initial=0)).bit_length())
        self.ones, self.zeros = [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (symbols >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int64)]))
            self.zeros.append(len(bit) - int(bit.sum()))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        begin, end = np.zeros_like(at), at
        for level, ones, zeros in zip(range(self.levels - 1, -1, -1), self.ones, self.zeros, strict=True):
            one = ((symbol >> level) & 1).astype(bool)
            begin, end = (np.where(one, zeros + ones[x], x - ones[x]) for x in (begin, end))
        return end - begin

    def at(self, i: np.ndarray) -> np.ndarray:
        """The symbols at places i."""
        out = np.zeros_like(i)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            bit = ones[i + 1] - ones[i]
            out = out * 2 + bit
            i = np.where(bit == 1, zeros + ones[i], i - ones[i])
        return out


class FMIndex:
    """Over symbols 1, 2, ...; symbol 0 ends the text and is its smallest."""

    def __init__(self, symbols: np.ndarray, sample: int = SAMPLE):
        text = np.append(np.asarray(symbols, np.int64), 0)
        order = suffix_order(text)
        bwt = text[order - 1]
        self.wavelet = WaveletMatrix(bwt)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=(1 << self.wavelet.levels)))])
        self.sampled = order % sample == 0
        self.samples = order[self.sampled]
        self.sample_rank = np.concatenate([[0], np.cumsum(self.sampled)])
        self.n = len(text)

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [lo, hi) of all ``patterns`` (right-aligned rows of symbols)."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        top = len(self.before) - 1
        for back in range(1, patterns.shape[1] + 1):
            symbol = patterns[:, -back]
            live = (back <= lengths) & (lo < hi)
            known = live & (symbol < top)
            hi[live & ~known] = lo[live & ~known]
            s = symbol[known]
            lo[known], hi[known] = (self.before[s] + self.wavelet.rank(s, x[known]) for x in (lo, hi))
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows."""
        rows, steps, out = rows.copy(), 0, np.zeros(len(rows), np.int64)
        open_rows = np.arange(len(rows))
        while len(open_rows):
            there = self.sampled[rows[open_rows]]
            done = open_rows[there]
            out[done] = self.samples[self.sample_rank[rows[done]]] + steps
            open_rows = open_rows[~there]
            at = rows[open_rows]
            symbol = self.wavelet.at(at)
            rows[open_rows] = self.before[symbol] + self.wavelet.rank(symbol, at)
            steps += 1
        return out


# -- windows ----------------------------------------------------------------------------------


class Windows:
    """The distinct windows of a block of benchmark items, as arrays."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int):
        self.symbol: dict[bytes, int] = {}
        self.ids = [None if i is None else str(i) for i, _ in items]
        rows, owner = [np.zeros((0, window), np.int32)], [np.zeros(0, np.int64)]
        for number, (_, words) in enumerate(items):
            codes = np.array([self.symbol.setdefault(w, len(self.symbol) + 2) for w in words], np.int32)  # 1 separates
            if not len(codes):
                continue
            width = min(window, len(codes))
            found = np.zeros((len(codes) - width + 1, window), np.int32)
            found[:, window - width :] = np.lib.stride_tricks.sliding_window_view(codes, width)
            rows.append(found)
            owner.append(np.full(len(found), number))
        #: Symbols of every window, its last ones to the right; zeros before shorter ones.
        self.patterns, which = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
        self.lengths = (self.patterns > 0).sum(axis=1)
        self.shortest = int(self.lengths.min(initial=window))
        many = max(len(items), 1)
        pairs = np.unique(which.reshape(-1).astype(np.int64) * many + np.concatenate(owner))
        self._owner, self._first = pairs % many, np.searchsorted(pairs // many, np.arange(len(self.patterns) + 1))

    def items(self, windows: np.ndarray) -> list[str]:
        """Ids of the items that have any of ``windows``, as strings in order."""
        first, last = self._first[windows], self._first[windows + 1]
        owners = np.unique(self._owner[common.ranges(first, last - first)])
        return sorted({self.ids[n] for n in owners.tolist()} - {None})


def blocks(benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> Iterator[Windows]:
    """Windows of bounded blocks of items, streamed to the driver one after another.

    An item longer than a block is cut into pieces that overlap, so that every
    window of it is whole in one of them.
    """
    held: list[tuple[object, list[bytes]]] = []
    n = 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        words = words_of(row["text"])
        for at in range(0, max(len(words) - window + 1, min(len(words), 1)), block_words):
            held.append((row["item_id"], words[at : at + block_words + window - 1]))
            n += len(held[-1][1])
            if n >= block_words:
                yield Windows(held, window)
                held, n = [], 0
    if held:
        yield Windows(held, window)


def shard_hits(codes: np.ndarray, bounds: np.ndarray, windows: Windows) -> tuple[np.ndarray, np.ndarray]:
    """(first word, window) of every occurrence in a shard of documents, none across two of them."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    known = codes > 0
    if not known.any() or not len(windows.lengths):
        return none
    # runs of benchmark words inside one document, long enough for a window
    first = known & ~np.concatenate([[False], known[:-1]])
    starts_doc = np.zeros(len(codes) + 1, bool)
    starts_doc[bounds] = True
    first |= known & starts_doc[:-1]
    begin = np.flatnonzero(first)
    ends = np.flatnonzero(known & (~np.append(known[1:], False) | starts_doc[1:])) + 1
    enough = ends - begin >= windows.shortest
    begin, length = begin[enough], (ends - begin)[enough]
    if not len(begin):
        return none
    words = common.ranges(begin, length)
    gaps = np.cumsum(length) + np.arange(len(length))
    text = np.ones(len(words) + len(length), np.int64)
    place = np.full(len(text), -1, np.int64)
    inside = np.ones(len(text), bool)
    inside[gaps] = False
    text[inside], place[inside] = codes[words], words
    index = FMIndex(text)
    lo, hi = index.search(windows.patterns, windows.lengths)
    which = np.repeat(np.arange(len(lo)), hi - lo)
    return place[index.locate(common.ranges(lo, hi - lo))], which


def merged(starts: np.ndarray, lengths: np.ndarray) -> list[tuple[int, int]]:
    """Spans [start, start + length) joined where they touch or overlap."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(starts.tolist(), (starts + lengths).tolist(), strict=True)):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], b)
        else:
            out.append((a, b))
    return out


def _code_table(words: pa.Array, windows: Windows) -> np.ndarray:
    table = words.dictionary_encode()
    get = windows.symbol.get
    codes = np.array([get(w, 0) for w in table.dictionary.cast(pa.large_binary()).to_pylist()], np.int64)
    return codes[np.asarray(table.indices)] if len(words) else np.zeros(0, np.int64)


_OUT = pa.schema([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string()))])
HITS = "n_words bigint, spans array<struct<start:bigint,end:bigint>>, items array<string>"


def hits(docs: DataFrame, windows: Windows, window_key: str = "doc_id") -> DataFrame:
    """Per row of ``docs``: the key, n_words, merged word spans of all occurrences, items that occur."""
    kind = docs.schema[window_key].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(windows)

    def shard(keys: pa.Array, texts: pa.Array) -> pa.RecordBatch:
        w = shared.value
        words, bounds = common.split_words(common.translated(texts, _TABLE))
        place, which = shard_hits(_code_table(words, w), bounds, w)
        doc = np.searchsorted(bounds, place, "right") - 1
        order = np.argsort(doc, kind="stable")
        cuts = np.searchsorted(doc[order], np.arange(len(keys) + 1))
        spans, items = [], []
        for i in range(len(keys)):
            mine = order[cuts[i] : cuts[i + 1]]
            spans.append([{"start": a, "end": b} for a, b in merged(place[mine] - bounds[i], w.lengths[which[mine]])] if len(mine) else [])
            items.append(w.items(np.unique(which[mine])) if len(mine) else [])
        return pa.RecordBatch.from_arrays(
            [keys, pa.array(np.diff(bounds)), pa.array(spans, _OUT.field(1).type), pa.array(items, _OUT.field(2).type)],
            names=[window_key, *_OUT.names],
        )

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in common.slices(batch.column(1), 2 * SHARD_WORDS):  # at least two bytes a word
                part = batch.slice(lo, hi - lo)
                yield shard(part.column(0), part.column(1))

    return docs.select(window_key, "text").mapInArrow(task, f"{window_key} {kind}, {HITS}")


def _merge_blocks(parts: list[DataFrame]) -> DataFrame:
    """One row per document from the rows of several benchmark blocks."""
    rows = parts[0]
    for x in parts[1:]:
        rows = rows.union(x)
    grouped = rows.groupBy("key").agg(
        F.first("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("all"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    joined = F.aggregate(
        "all",
        F.slice("all", 1, 0),
        lambda done, x: F.when(
            (F.size(done) > 0) & (x.start <= F.element_at(done, -1).end),
            F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.struct(F.element_at(done, -1).start.alias("start"), F.greatest(x.end, F.element_at(done, -1).end).alias("end")))),
        ).otherwise(F.concat(done, F.array(x))),
    )
    return grouped.select("key", "n_words", joined.alias("spans"), "items")


def occurrences(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, spans (merged removal spans, in words) and items for every row of ``docs``."""
    some = blocks(benchmark, window, block_words)
    first, second = next(some, None), next(some, None)
    if second is None:
        return hits(docs, first or Windows([], window))
    # several blocks, one after another: a row's parts meet again by a number of its own
    numbered = common.settle(docs.select(F.struct("doc_id", F.monotonically_increasing_id().alias("n")).alias("key"), "text"), "numbered")
    parts = [hits(numbered, first, "key"), hits(numbered, second, "key"), *(hits(numbered, w, "key") for w in some)]
    return _merge_blocks(parts).select(F.col("key.doc_id").alias("doc_id"), "n_words", "spans", "items")


def n_hit() -> F.Column:
    return F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, x: n + x.end - x.start)


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs`` in which no benchmark window occurs; rows stay where they are, whole."""
    text = docs.columns.index("text")

    def without(windows: Windows):  # noqa: ANN202
        shared = docs.sparkSession.sparkContext.broadcast(windows)

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo, hi in common.slices(batch.column(text), 2 * SHARD_WORDS):  # at least two bytes a word
                    some = batch.slice(lo, hi - lo)
                    words, bounds = common.split_words(common.translated(some.column(text), _TABLE))
                    place, _ = shard_hits(_code_table(words, shared.value), bounds, shared.value)
                    dirty = np.zeros(len(some), bool)
                    dirty[np.searchsorted(bounds, place, "right") - 1] = True
                    yield some.filter(pa.array(~dirty))

        return task

    out = docs
    for windows in blocks(benchmark, window, block_words):
        out = out.mapInArrow(without(windows), docs.schema)
    return out


def op6(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = occurrences(docs.select("doc_id", "text"), benchmark)
    return found.select(
        "doc_id", "n_words", n_hit().alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


_SQL_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)
ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_SQL_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark),
i AS (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS pos FROM b WHERE len(w) > 0),
wins AS (SELECT DISTINCT item_id, n, array_to_string(w[pos:pos + n - 1], ' ') AS s FROM i),
widths AS (SELECT DISTINCT n FROM wins),
places AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS pos FROM d, widths WHERE len(w) >= n),
h AS (SELECT p.r, p.pos, p.n, wins.item_id::VARCHAR AS item FROM places p JOIN wins ON wins.n = p.n AND wins.s = array_to_string(p.w[p.pos:p.pos + p.n - 1], ' ')),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(pos, pos + n)) AS p FROM h) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM h WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON hit.r = d.r LEFT JOIN items ON items.r = d.r
"""
