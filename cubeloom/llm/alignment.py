"""Alignment of two tokenizers' tokens of whole documents, by distinct segments.

Both tokenizers see a space and the text.  That string is cut into segments, each
from a run of white space that begins with a space to the next one.  Neither
vocabulary merges across such a cut, which is looked up and not assumed: the
byte-level pattern of A ends a piece before white space, and no piece of B holds
a space behind something else (:meth:`Pair.cuts`).  Where that does not hold, a
text is one segment.

Slices of documents write down their segments as numbers, and which segment a
number means.  Every distinct segment of the corpus is tokenised and aligned
once, joined back to the slices by its text, and documents are composed slice by
slice.  A segment's cuts are ends of tokens on both sides, so a document's groups
are its segments' groups in a row, and its counts are sums over its segments.
How many documents hold a pair of ids linked is counted in each slice, then over
slices; a segment's sum over its links is joined back the same way.

No key has more rows than there are slices, but for the pairs of ids, which
many distinct segments share: those meet their counts by
:func:`common.join_counted`.

Defined results: texts that are null or empty, or whose bytes the tokens of A or B
do not give back, have no tokens: all numbers 0, no groups, and nothing to add to
the counts.  Null and repeated doc_ids are documents of their own, and so are
repeated rows; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
import re
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from . import common
from .token_output import _ALPHABET, _BYTE_LEVEL, _MAYBE_SPACE

#: Bytes of text whose segments are numbered together.
SLICE = 16 << 20
#: Numbers of segments whose pairs are sorted together.
CODES_AT_ONCE = 500_000
#: Distinct segments that are tokenised at a time, and bytes of them.
SEGMENTS_AT_ONCE = 4096
SEGMENT_BYTES = 1 << 20
SLICED = "slice long, data binary, code int, segment string"
ALIGNED = "segment string, ok boolean, n_a long, n_b long, n_groups long, pairs array<long>, groups string"
DOCUMENTS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"
#: How sentencepiece writes a space.
_MARK = "▁"


# -- tokens of distinct segments --------------------------------------------------------------


class Pair:
    """Tokenizer A (a file of the ``tokenizers`` library) and B (a sentencepiece model), and the bytes of their ids."""

    def __init__(self, a: str, b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a), sentencepiece.SentencePieceProcessor(model_file=b)
        self.a.encode_special_tokens = True
        byte = {chr(c): bytes([x]) for x, c in _ALPHABET.items()}
        vocabulary = self.a.get_vocab(with_added_tokens=False)
        self.a_bytes = {i: b"".join(byte.get(c, c.encode()) for c in token) for token, i in vocabulary.items()}
        ids = range(self.b.get_piece_size())
        self.pieces = [self.b.id_to_piece(i) for i in ids]
        self.b_bytes = {i: bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_MARK, " ").encode() for i, p in zip(ids, self.pieces, strict=True)}
        self.lone = self.b.piece_to_id(_MARK)
        self.says = json.loads(self.a.to_str())
        self.spec = b

    def cuts(self) -> bool:
        """Whether no token of A or B can hold white space behind something else, and a segment alone has the tokens it has in its text."""
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(self.spec, "rb") as source:
            model.ParseFromString(source.read())
        norm, train = model.normalizer_spec, model.trainer_spec
        before = self.says.get("pre_tokenizer") or {}
        a = not any(self.says.get(k) for k in ("normalizer", "truncation", "padding")) and self.says["model"]["type"] == "BPE"
        a = a and not self.says["model"].get("dropout") and all(before.get(k) == v for k, v in _BYTE_LEVEL.items())
        plain = norm.add_dummy_prefix and norm.escape_whitespaces and not norm.remove_extra_whitespaces and not norm.precompiled_charsmap
        merges = train.model_type == train.BPE and not train.user_defined_symbols and not train.treat_whitespace_as_suffix
        return bool(a and plain and merges and self.pieces[self.lone] == _MARK and not any(re.search(f"[^{_MARK}]{_MARK}", p) for p in self.pieces))

    def tokens(self, segments: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of each segment, which is given without the space that it begins with."""
        a = [e.ids for e in self.a.encode_batch_fast([" " + s for s in segments], add_special_tokens=False)]
        # B adds the space itself, but not to nothing
        b = [ids if s else [self.lone] for s, ids in zip(segments, self.b.encode(segments, num_threads=1), strict=True)]
        return a, b

    def align(self, segments: list[str]) -> dict[str, list]:
        """Columns of ``ALIGNED`` for distinct segments."""
        a, b = self.tokens(segments)
        whole = [b" " + s.encode() for s in segments]
        given = lambda ids, of: b"".join([of[i] for i in ids])
        ok = [given(x, self.a_bytes) == w == given(y, self.b_bytes) for x, y, w in zip(a, b, whole, strict=True)]
        a, b = ([x if good else [] for x, good in zip(ids, ok, strict=True)] for ids in (a, b))
        flat_a, end_a, bound_a = _ends(a, self.a_bytes)
        flat_b, end_b, bound_b = _ends(b, self.b_bytes)
        # all links: the tokens of B from the one that holds A's first byte to the one that holds its last
        first = np.searchsorted(end_b, np.concatenate([[0], end_a])[: len(end_a)], "right")
        many = np.searchsorted(end_b, end_a, "left") - first + 1
        pairs = (np.repeat(flat_a, many) << 32) | flat_b[common.ranges(first, many)]
        links = np.concatenate([[0], np.cumsum(many)])[bound_a]
        # groups end where both sides do; the ends of segments are among them
        common_ends = np.intersect1d(end_a, end_b, assume_unique=True)
        cut_a, cut_b = np.searchsorted(end_a, common_ends) + 1, np.searchsorted(end_b, common_ends) + 1
        said_a, said_b = list(map(str, flat_a.tolist())), list(map(str, flat_b.tolist()))
        groups, i, k = [], 0, 0
        for j, m in zip(cut_a.tolist(), cut_b.tolist(), strict=True):
            groups.append(f"{','.join(said_a[i:j])}|{','.join(said_b[k:m])}")
            i, k = j, m
        at = np.searchsorted(cut_a, bound_a, "right").tolist()
        return {
            "segment": segments, "ok": ok, "n_a": np.diff(bound_a), "n_b": np.diff(bound_b), "n_groups": np.diff(at),
            "pairs": pa.ListArray.from_arrays(pa.array(links.astype(np.int32)), pa.array(pairs)), "groups": [";".join(groups[lo:hi]) for lo, hi in zip(at[:-1], at[1:], strict=True)],
        }


def _ends(ids: list[list[int]], of: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids in a row, where each ends in the bytes of all, first place of each list and behind the last)."""
    flat = np.array([i for x in ids for i in x], np.int64)
    ends = np.cumsum([len(of[i]) for x in ids for i in x], dtype=np.int64) if len(flat) else np.zeros(0, np.int64)
    return flat, ends, np.concatenate([[0], np.cumsum([len(x) for x in ids], dtype=np.int64)])


_PAIRS: dict[tuple[str, str], Pair] = {}


def pair(a: str, b: str) -> Pair:
    """One pair for each worker process."""
    if (a, b) not in _PAIRS:
        _PAIRS[a, b] = Pair(a, b)
    return _PAIRS[a, b]


# -- segments of a slice ----------------------------------------------------------------------


def segments(texts: pa.Array, cut: bool = True) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(numbers of all segments in a row, segments of each text, what each number means) of texts none of which is null.

    A segment is meant without the space that it begins with; empty texts have none.
    """
    if not cut:
        table = texts.dictionary_encode()
        full = np.asarray(pc.greater(pc.binary_length(texts), 0)).astype(np.int64)
        return np.asarray(table.indices)[full > 0], full, table.dictionary.to_pylist()
    lists = pc.split_pattern(texts, " ")
    n_chunks = np.asarray(pc.list_value_length(lists)).astype(np.int64)
    first = np.cumsum(n_chunks) - n_chunks
    table = lists.flatten().dictionary_encode()
    del lists
    codes, words = np.asarray(table.indices), table.dictionary
    # a segment begins after a chunk that is not empty and does not end in white space
    last = pc.utf8_slice_codeunits(words, -1).dictionary_encode()
    closing = np.array([bool(c) and not c.isspace() and c not in _MAYBE_SPACE for c in last.dictionary.to_pylist()], bool)
    closed = closing[np.asarray(last.indices)][codes] if len(codes) else np.zeros(0, bool)
    begins = np.ones(len(codes), bool)
    begins[1:] = closed[:-1]
    begins[first] = True
    start = np.flatnonzero(begins).astype(np.int32)
    number, known = codes[start], words.to_pylist()
    joined: dict[str, int] = {}
    ends = np.append(start[1:], np.int32(len(codes)))
    for i in np.flatnonzero(ends - start > 1).tolist():
        text = " ".join([known[c] for c in codes[start[i] : ends[i]].tolist()])
        number[i] = len(words) + joined.setdefault(text, len(joined))
    del start, ends
    each = np.add.reduceat(begins, first).astype(np.int64) if len(first) else np.zeros(0, np.int64)
    empty = np.asarray(pc.equal(pc.binary_length(texts), 0)).astype(bool)
    number = number[~np.repeat(empty, each)]
    each[empty] = 0
    # numbers that are used, in order, without gaps
    used = np.bincount(number, minlength=len(known) + len(joined)) > 0
    said = [x for x, there in zip((*known, *joined), used.tolist(), strict=True) if there]
    return (np.cumsum(used, dtype=np.int32) - 1)[number], each, said


# -- what travels by slice --------------------------------------------------------------------


def _packed(n: int, *parts: np.ndarray | bytes) -> bytes:
    """Some columns of ``n`` rows in few bytes."""
    raw = b"".join(x if isinstance(x, bytes) else np.ascontiguousarray(x).tobytes() for x in parts)
    return struct.pack("<IQ", n, len(raw)) + pa.compress(raw, codec="zstd", asbytes=True)


class _Unpacked:
    """Reads back what :func:`_packed` wrote, column by column."""

    def __init__(self, data: bytes):
        self.n, size = struct.unpack_from("<IQ", data)
        self.raw, self.at = pa.decompress(data[12:], decompressed_size=size, codec="zstd", asbytes=True), 0

    def take(self, kind: str, n: int | None = None) -> np.ndarray:
        out = np.frombuffer(self.raw, kind, self.n if n is None else n, self.at)
        self.at += out.nbytes
        return out

    def rest(self) -> bytes:
        return self.raw[self.at :]


def sliced(docs: DataFrame, cut: bool = True, size: int = SLICE) -> DataFrame:
    """Rows of ``SLICED``: one for each slice with its documents' segments in numbers, and one for each number."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = TaskContext.get().partitionId() << 32
        for batch in batches:
            texts, ids = common.as_strings(batch.column("text")), batch.column("doc_id").cast(pa.int64())
            for lo, hi in common.slices(texts, size):
                numbers, each, said = segments(texts.slice(lo, hi - lo), cut)
                mine = ids.slice(lo, hi - lo)
                data = _packed(hi - lo, np.asarray(mine.fill_null(0)), np.asarray(mine.is_null()).astype("u1"), each.astype("<i8"), numbers.astype("<i4"))
                kinds = {"slice": pa.int64(), "data": pa.binary(), "code": pa.int32(), "segment": pa.string()}
                for m, rows in ((1, {"data": pa.array([data], pa.binary())}), (len(said), {"code": pa.array(range(len(said)), pa.int32()), "segment": pa.array(said, pa.string())})):
                    rows["slice"] = pa.array(np.full(m, n), pa.int64())
                    yield pa.RecordBatch.from_arrays([rows.get(k, pa.nulls(m, t)) for k, t in kinds.items()], names=list(kinds))
                n += 1
                del numbers, data, said, rows
                pa.default_memory_pool().release_unused()

    return docs.select("doc_id", "text").mapInArrow(task, SLICED)


def packed(rows: DataFrame, pack: Callable[[pa.Table], bytes]) -> DataFrame:
    """slice, data: rows that go to a slice, as many together as a batch of a partition has."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = np.asarray(batch.column("slice"))
            cuts = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)] if len(of) else [0]
            data = [pack(pa.Table.from_batches([batch.slice(lo, hi - lo)]).combine_chunks()) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(of[cuts[:-1]] if len(of) else [], pa.int64()), pa.array(data, pa.binary())], names=["slice", "data"])

    return rows.sortWithinPartitions("slice").mapInArrow(task, "slice long, data binary")


def _column(table: pa.Table, name: str) -> pa.Array:
    column = table[name].combine_chunks()
    return pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column


def _pack_links(rows: pa.Table) -> bytes:
    lists = _column(rows, "pairs")
    return _packed(rows.num_rows, np.asarray(rows["code"]), np.asarray(rows["ok"]).astype("u1"), np.asarray(pc.list_value_length(lists)).astype("<i8"), np.asarray(lists.flatten()))


def _pack_groups(rows: pa.Table) -> bytes:
    numbers = np.stack([np.asarray(rows[c]).astype("<i8") for c in SUMS], axis=1)
    return _packed(rows.num_rows, np.asarray(rows["code"]), np.asarray(rows["ok"]).astype("u1"), numbers, "\n".join(rows["groups"].to_pylist()).encode())


# -- composition in a slice -------------------------------------------------------------------

#: What adds up over a document's segments.
SUMS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def _documents(rows: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(ids, segments of all documents in a row, first place of each document and behind the last) of one slice."""
    (data,) = rows["data"].to_pylist()
    source = _Unpacked(data)
    ids, null, each = source.take("<i8"), source.take("u1"), source.take("<i8")
    bounds = np.concatenate([[0], np.cumsum(each)])
    return pa.array(ids, mask=null.astype(bool)), source.take("<i4", int(bounds[-1])), bounds


def _whole(ok: np.ndarray, flat: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Which documents have segments, and none without tokens."""
    bad = np.concatenate([[0], np.cumsum(~ok[flat])])
    return (np.diff(bad[bounds]) == 0) & (np.diff(bounds) > 0)


def _holding(docs: pa.Table, known: pa.Table) -> pa.Table:
    """How many documents of a slice hold each pair of ids linked."""
    parts = []
    for data in known["data"].to_pylist():
        source = _Unpacked(data)
        code, ok, many = source.take("<i4"), source.take("u1"), source.take("<i8")
        parts.append((code, ok, many, source.take("<i8", int(many.sum()))))
    if not parts:
        return pa.table({"pair": pa.array([], pa.int64()), "docs": pa.array([], pa.int64())})
    code, ok, many, pairs = (np.concatenate(x) for x in zip(*parts, strict=True))
    pairs, place = np.unique(pairs, return_inverse=True)
    order = np.argsort(code)  # every number has one row
    ok, first, many = ok[order].astype(bool), (np.cumsum(many) - many)[order], many[order]
    _, flat, bounds = _documents(docs)
    good, counts = _whole(ok, flat, bounds), np.zeros(len(pairs), np.int64)
    # some documents at a time, for what is sorted
    steps = np.unique(np.searchsorted(bounds, np.arange(0, len(flat) + CODES_AT_ONCE, CODES_AT_ONCE)).clip(0, len(bounds) - 1)).tolist()
    for lo, hi in zip([0, *steps], [*steps, len(bounds) - 1], strict=True):
        doc = np.repeat(np.arange(lo, hi), np.diff(bounds[lo : hi + 1]))
        held = np.unique((doc * len(ok) + flat[bounds[lo] : bounds[hi]])[good[doc]])
        doc, number = held // len(ok), held % len(ok)
        linked = np.unique(np.repeat(doc, many[number]) * len(pairs) + place[common.ranges(first[number], many[number])])
        counts += np.bincount(linked % max(1, len(pairs)), minlength=len(pairs))
    return pa.table({"pair": pa.array(pairs), "docs": pa.array(counts)})


def _composed(docs: pa.Table, known: pa.Table) -> pa.Table:
    """Documents of a slice from their segments' groups and sums."""
    ids, flat, bounds = _documents(docs)
    codes, oks, numbers, said = [np.zeros(0, np.int32)], [np.zeros(0, "u1")], [np.zeros((0, len(SUMS)), np.int64)], []
    for data in known["data"].to_pylist():
        source = _Unpacked(data)
        codes.append(source.take("<i4"))
        oks.append(source.take("u1"))
        numbers.append(source.take("<i8", source.n * len(SUMS)).reshape(source.n, -1))
        said += source.rest().decode().split("\n")
    order = np.argsort(np.concatenate(codes))
    number, groups = np.concatenate(numbers)[order], [said[i] for i in order.tolist()]
    good = _whole(np.concatenate(oks)[order].astype(bool), flat, bounds)
    columns = {"doc_id": ids}
    for k, name in enumerate(SUMS):
        sums = np.concatenate([[0], np.cumsum(number[:, k][flat])])
        columns[name] = pa.array(np.where(good, np.diff(sums[bounds]), 0))
    at, flat = bounds.tolist(), flat.tolist()
    columns["groups"] = pa.array([";".join([groups[c] for c in flat[at[i] : at[i + 1]]]) if good[i] else "" for i in range(len(ids))], pa.string())
    return pa.table(columns)


# -- Spark ------------------------------------------------------------------------------------


def align(docs: DataFrame, a: str, b: str, size: int = SLICE) -> DataFrame:
    """(doc_id, text) -> doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups.

    ``a`` is a file of the ``tokenizers`` library, ``b`` a sentencepiece model.
    ``groups`` is the whole alignment: ``a1,a2|b1;a3|b2,b3`` in decimal ids.
    """
    cut = pair(a, b).cuts()
    with common.scratch() as keep:
        kind = F.when(F.col("data").isNotNull(), "texts").otherwise("segments")
        parts = common.settle(sliced(docs, cut, size).withColumn("kind", kind), "slices", "zstd", "kind")
        texts = parts.filter("kind = 'texts'").select("slice", "data")
        numbered = parts.filter("kind = 'segments'").select("slice", "code", "segment")

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                said = common.as_strings(batch.column("segment"))
                for lo, hi in common.slices(said, SEGMENT_BYTES):
                    for at in range(lo, hi, SEGMENTS_AT_ONCE):
                        made = pair(a, b).align(said.slice(at, min(SEGMENTS_AT_ONCE, hi - at)).to_pylist())
                        kinds = (pa.string(), pa.bool_(), *[pa.int64()] * 3, None, pa.string())
                        yield pa.RecordBatch.from_arrays([v if t is None else pa.array(v, t) for v, t in zip(made.values(), kinds, strict=True)], names=list(made))

        distinct = numbered.select("segment").distinct()
        n_parts = common.partitions_for(docs, common.text_bytes(distinct, "segment"), 1 << 20)
        spread = distinct.repartition(n_parts, F.xxhash64("segment"))
        segment = common.settle(spread.mapInArrow(task, ALIGNED).select(F.monotonically_increasing_id().alias("id"), "*"), "segments", "zstd")
        placed = common.settle(numbered.join(segment.select("segment", "id"), "segment").select("slice", "code", "id"), "placed-segments", "zstd")
        common.discard_part(parts, "kind", "segments")

        # documents that hold a pair of ids, in each slice, then in all
        linked = packed(placed.join(segment.select("id", "ok", "pairs"), "id").select("slice", "code", "ok", "pairs"), _pack_links)
        by_slice = texts.groupBy("slice").cogroup(linked.groupBy("slice"))
        counts = by_slice.applyInArrow(_holding, "pair long, docs long").groupBy("pair").agg(F.sum("docs").alias("docs")).filter("docs > 0")
        counts = common.settle(counts, "pair-counts")
        # a partition by an id of A has a row for each id of B at most
        of_a = W.partitionBy(F.shiftright("pair", 32))
        best = counts.withColumn("best", (F.col("docs") == F.max("docs").over(of_a)).cast("long"))

        links = segment.filter("ok").select("id", F.explode("pairs").alias("pair"))
        times = common.settle(links.groupBy("pair").agg(F.count(F.lit(1)).alias("n")).join(best, "pair"), "link-counts")
        n_links = times.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
        # a segment that only documents without tokens hold may have pairs that nobody counted
        weights = common.join_counted(links, times, "pair", n_links).groupBy("id").agg(F.sum("docs").alias("count_sum"), F.sum("best").alias("n_best"))
        weights = common.settle(weights, "segment-sums", "zstd")
        slim = segment.select("id", "ok", "n_a", "n_b", "n_groups", F.size("pairs").cast("long").alias("n_links"), "groups")
        weighted = common.settle(slim.join(weights, "id", "left").na.fill(0, ["count_sum", "n_best"]), "weighted-segments", "zstd")
        common.discard(segment, weights)
        whole = packed(placed.join(weighted, "id").select("slice", "code", "ok", *SUMS, "groups"), _pack_groups)
        found = texts.groupBy("slice").cogroup(whole.groupBy("slice")).applyInArrow(_composed, DOCUMENTS)
        keep += [parts, placed, weighted]
    return found


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def op12(docs: DataFrame) -> DataFrame:
    found = align(docs, *default_tokenizers())
    sha = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", sha.alias("groups_sha256"))
