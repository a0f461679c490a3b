"""Token ids of whole documents in patched frame-of-reference files.

Documents are dealt to partitions by ranges of doc_id, encoded in id order, and
written to shared storage as files of the format below; a manifest row per
finished file says what it holds, so that files of lost attempts are never read.
A file's place in the whole stream follows from the manifest's running sum.

File format, all numbers little-endian::

    "PFR1"  u32 block length   u64 ids   u64 documents   u64 bytes of packed blocks
    i64 doc_id per document, u8 "id is null" per document, u64 ids per document
    per block: u64 start in the packed blocks, u32 minimum, u8 width, u32 exceptions before it
    u32 exceptions; u16 place in block and u32 value of each
    packed blocks: value - minimum in `width` bits, most significant bit first

The width of a block is the least that holds ``PACKED_SHARE`` of its values;
the others are stored whole in the exception lists.

Defined results: null text counts as empty, so its document holds only the end
id; a null doc_id comes before all others; equal doc_ids stand in order of their
text; an empty table gives no files and an empty result.
"""

from __future__ import annotations

import json
import os
import posixpath
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from . import common

BLOCK = 1024
PACKED_SHARE = 0.95
#: Ids after which a file is closed (looked at after every slice of text).
FILE_IDS = 4_000_000
END_ID = 2
#: Characters of a text that part the rows of one doc_id.
START = 256
#: Stems whose ids a worker remembers; others are encoded once for each slice.
MEMO = 200_000
#: Bytes of text that are encoded at a time, and stems that go to the library at a time.
SLICE = 12 << 20
AT_ONCE = 8_000
#: Blocks that are packed or unpacked at a time.
BLOCKS_AT_ONCE = 512

MANIFEST = "part int, seq int, name string, n_docs long, n_ids long, n_bytes long"
_MANIFEST = pa.schema([
    ("part", pa.int32()), ("seq", pa.int32()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_bytes", pa.int64()),
])
DOCS = "name string, place long, doc_id long, start_in_file long, n_tokens long, ids_crc32 long"


# -- encoding ---------------------------------------------------------------------------------

# The public byte-level alphabet, in which bytes that are no visible character stand from U+0100 on.
_VISIBLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_ALPHABET = {b: b for b in _VISIBLE} | {b: 256 + n for n, b in enumerate(sorted(set(range(256)) - set(_VISIBLE)))}
#: A space in that alphabet, and how a list of words is written in it: newlines stay what they are.
_SPACE = chr(_ALPHABET[32])
_LISTED = _ALPHABET | {10: 10}
#: What a byte-level pre-tokenizer must say of itself for texts to be cut at spaces.
_BYTE_LEVEL = {"type": "ByteLevel", "use_regex": True, "add_prefix_space": False}
#: Letters in every Unicode version, then ASCII marks.
_WORD_AND_MARKS = r"^(?P<word>[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}]+)(?P<marks>[!-/:-@\[-`{-~]*)$"
#: Characters that some Unicode versions count as white space, beside those of ``str.isspace``.
_MAYBE_SPACE = "\u180e\u200b\ufeff"


class Encoder:
    """Ids of whole texts with the ``tokenizers`` library.

    A byte-level pattern takes a space only as the first character of a piece or
    inside a run of white space, and a run that is followed by something else
    gives up its last character.  So a single space that something other than
    white space follows always begins a piece, and a text whose chunks between
    single spaces all begin so can be cut there.  Letters and marks are pieces of
    their own, so a chunk of letters and then marks is cut between them as well.
    Stems (what is left of chunks) that a worker remembers are looked up, the
    other distinct stems of a slice go to the library together, and their ids part
    again where a token begins with a space.  A stem of letters is one piece, and
    goes to the library's model as such, in the byte-level alphabet.

    Texts that cannot be cut (an empty chunk, white space after a space, a special
    token's string), and all texts of tokenizers that are not of that kind, go to
    the library one by one.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        says = json.loads(self.library.to_str())
        before = says.get("pre_tokenizer") or {}
        plain = not any(says.get(k) for k in ("normalizer", "truncation", "padding"))
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.begins = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.begins[[i for token, i in vocabulary.items() if token.startswith(_SPACE)]] = True
        model = says["model"]
        self.cuts = plain and model["type"] == "BPE" and not model.get("dropout") and all(before.get(k) == v for k, v in _BYTE_LEVEL.items())
        self.cuts = self.cuts and all(chr(c) in vocabulary for c in _ALPHABET.values()) and not any(c.isspace() for s in self.special for c in s)
        #: A number for each remembered stem; the ids of number n are flat[first[n]:first[n + 1]].
        self.known: dict[str, int] = {}
        self.first, self.flat, self.n = np.zeros(MEMO + 1, np.int64), np.zeros(1 << 16, np.uint32), 0

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each of ``texts``, by the library alone."""
        return [np.array(e.ids, np.uint32) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _fit(self, chunk: str) -> bool:
        """Whether a space before ``chunk`` begins a piece of its own."""
        return bool(chunk) and not chunk[0].isspace() and chunk[0] not in _MAYBE_SPACE and not any(s in chunk for s in self.special)

    def _together(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids in a row, ids of each) of stems with a space before them."""
        ids, lengths = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for at in range(0, len(chunks), AT_ONCE):
            some = chunks[at : at + AT_ONCE]
            (got,) = self.whole([" " + " ".join(some)])
            begin = np.flatnonzero(self.begins[got])
            if len(begin) != len(some) or begin[0]:  # no such tokenizer is known; one by one it is right for any
                parts = self.whole([" " + c for c in some])
                got, begin = np.concatenate(parts), np.cumsum([0, *map(len, parts[:-1])])
            ids.append(got)
            lengths.append(np.diff(np.append(begin, len(got))))
        return np.concatenate(ids), np.concatenate(lengths)

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words of nothing but letters: each is one piece, so the model alone is asked."""
        tokenize = self.library.model.tokenize
        listed = "\n".join(words).encode().decode("latin-1").translate(_LISTED).split("\n") if words else []
        found = [[t.id for t in tokenize(_SPACE + w)] for w in listed]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(lengths.sum())), lengths

    def _remember(self, chunks: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        n = min(len(chunks), MEMO - self.n)
        ends = self.first[self.n] + np.cumsum(lengths[:n])
        need = int(ends[-1]) if n else 0
        if need > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(need, len(self.flat)), np.uint32)])
        self.flat[self.first[self.n] : need] = ids[: int(lengths[:n].sum())]
        self.first[self.n + 1 : self.n + n + 1] = ends
        self.known.update(zip(chunks[:n], range(self.n, self.n + n)))
        self.n += n

    def _stems(self, stems: list[str], count: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pool, start, length): ids of distinct stems with a space before them stand in pool; length -1: not to be cut."""
        number = np.fromiter(map(self.known.get, stems, repeat(-1)), np.int64, len(stems))
        start, length = np.zeros(len(stems), np.int64), np.full(len(stems), -1, np.int64)
        old = np.flatnonzero(number >= 0)
        start[old], length[old] = self.first[number[old]], self.first[number[old] + 1] - self.first[number[old]]
        pool = [self.flat[: int(self.first[self.n])]]
        end = len(pool[0])
        words = np.flatnonzero((number < 0) & letters)
        others = [i for i in np.flatnonzero((number < 0) & ~letters).tolist() if self._fit(stems[i])]
        for fresh, ask in ((words, self._words), (np.array(others, np.int64), self._together)):
            # stems that are met several times come first, and are remembered
            fresh = fresh[np.argsort(-count[fresh], kind="stable")]
            new = [stems[i] for i in fresh.tolist()]
            ids, lengths = ask(new)
            start[fresh], length[fresh] = end + np.cumsum(lengths) - lengths, lengths
            pool.append(ids)
            end += len(ids)
            if self.n < MEMO:
                often = int((count[fresh] > 1).sum())
                self._remember(new[:often], ids, lengths[:often])
        return np.concatenate(pool), start, length

    def _chunks(self, chunks: pa.Array, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same for distinct chunks, which are a word as stem and marks behind it, or a stem as a whole."""
        cut = pc.extract_regex(chunks, _WORD_AND_MARKS)
        two = pc.is_valid(cut)
        # a special token's string may hold letters and marks
        for special in self.special:
            two = pc.and_not(two, pc.match_substring(chunks, special))
        stems = pc.if_else(two, pc.struct_field(cut, "word"), chunks).dictionary_encode()
        of_stem = np.asarray(stems.indices)
        letters = np.zeros(len(stems.dictionary), bool)
        letters[of_stem[np.asarray(two).astype(bool)]] = True
        pool, start, length = self._stems(stems.dictionary.to_pylist(), np.bincount(of_stem, count, len(letters)).astype(np.int64), letters)
        marks = pc.if_else(two, pc.struct_field(cut, "marks"), "").dictionary_encode()
        ends = self.whole(marks.dictionary.to_pylist())
        n_mark = np.array([len(x) for x in ends], np.int64)
        of_mark = np.asarray(marks.indices)
        starts = np.stack([start[of_stem], (len(pool) + np.cumsum(n_mark) - n_mark)[of_mark]], axis=1)
        lengths = np.stack([np.maximum(length[of_stem], 0), n_mark[of_mark]], axis=1)
        pool = np.concatenate([pool, *ends])[common.ranges(starts.reshape(-1), lengths.reshape(-1))]
        total = lengths.sum(axis=1)
        return pool, np.cumsum(total) - total, np.where(length[of_stem] < 0, -1, total)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all ``texts`` in a row, ids of each)."""
        ids, lengths = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for at, to in common.slices(texts, SLICE):
            some, n = self._encode(common.as_strings(texts.slice(at, to - at)))
            ids.append(some)
            lengths.append(n)
        return np.concatenate(ids), np.concatenate(lengths)

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not self.cuts:
            parts = self.whole(texts.to_pylist())
            return np.concatenate([np.zeros(0, np.uint32), *parts]), np.array([len(x) for x in parts], np.int64)
        lists = pc.split_pattern(texts, " ")
        n_chunks = np.asarray(pc.list_value_length(lists)).astype(np.int64)
        first = np.cumsum(n_chunks) - n_chunks
        flat = lists.flatten()
        heads = flat.take(pa.array(first)).to_pylist()
        table = flat.dictionary_encode()
        codes = np.array(table.indices)
        del lists, flat
        rest = np.ones(len(codes), bool)
        rest[first] = False
        count = np.bincount(codes[rest], minlength=len(table.dictionary))
        used = np.flatnonzero(count)
        pool, own_start, own_length = self._chunks(table.dictionary.take(pa.array(used)), count[used])
        start, length = np.zeros(len(count), np.int64), np.zeros(len(count), np.int64)
        start[used], length[used] = own_start, own_length
        start, length = start[codes], length[codes]
        # a text's first chunk has no space before it
        plain = [not any(s in c for s in self.special) for c in heads]
        parts = self.whole([c if ok else "" for c, ok in zip(heads, plain, strict=True)])
        length[first] = [len(x) if ok else -1 for x, ok in zip(parts, plain, strict=True)]
        start[first] = len(pool) + np.cumsum([0, *map(len, parts[:-1])])
        uncut = np.logical_or.reduceat(length < 0, first)
        if uncut.any():
            at = np.flatnonzero(uncut)
            got = self.whole(texts.take(pa.array(at)).to_pylist())
            length[np.repeat(uncut, n_chunks)] = 0
            length[first[at]] = [len(x) for x in got]
            start[first[at]] = len(pool) + sum(map(len, parts)) + np.cumsum([0, *map(len, got[:-1])])
            parts += got
        pool = np.concatenate([pool, *parts])
        return pool[common.ranges(start, length)], np.add.reduceat(length, first)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


# -- file format ------------------------------------------------------------------------------


def _widths(values: np.ndarray) -> np.ndarray:
    return np.where(values == 0, 0, np.floor(np.log2(np.maximum(values, 1).astype(np.float64))).astype(np.int64) + 1)


def to_bits(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of numbers (a multiple of eight in a row) as rows of bytes, ``width`` bits each, most significant first.

    Eight numbers fill ``width`` bytes; every number is moved to its place in
    those bytes and adds its high, middle and low bits to the ones it touches.
    """
    eights = values.reshape(len(values), -1, 8).astype(np.uint64)
    out = np.zeros((*eights.shape[:2], width), np.uint8)
    for k in range(8):
        first, last = k * width // 8, ((k + 1) * width - 1) // 8
        end = (last + 1) * 8 - (k + 1) * width  # bits of the last byte that follow the number
        moved = eights[:, :, k] << np.uint64(end)
        for byte in range(first, last + 1):
            out[:, :, byte] |= (moved >> np.uint64(8 * (last - byte))).astype(np.uint8)
    return out.reshape(len(values), -1)


def from_bits(raw: np.ndarray, width: int) -> np.ndarray:
    """The numbers of :func:`to_bits`."""
    eights = raw.reshape(len(raw), -1, width)
    out = np.zeros((*eights.shape[:2], 8), np.uint32)
    for k in range(8):
        first, last = k * width // 8, ((k + 1) * width - 1) // 8
        got = np.zeros(eights.shape[:2], np.uint64)
        for byte in range(first, last + 1):
            got = (got << np.uint64(8)) | eights[:, :, byte]
        out[:, :, k] = (got >> np.uint64((last + 1) * 8 - (k + 1) * width)) & np.uint64((1 << width) - 1)
    return out.reshape(len(raw), -1)


def pack(ids: np.ndarray, doc_ids: list[int | None], lengths: np.ndarray, block: int = BLOCK) -> bytes:
    """One file's bytes; ``ids`` of all its documents in a row."""
    n_blocks = -(-len(ids) // block)
    low, width = np.zeros(n_blocks, np.uint32), np.zeros(n_blocks, np.int64)
    n_odd, places, values, packed = np.zeros(n_blocks, np.int64), [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)], []
    rank = max(0, int(np.ceil(PACKED_SHARE * block)) - 1)
    for lo in range(0, n_blocks, BLOCKS_AT_ONCE):
        hi = min(n_blocks, lo + BLOCKS_AT_ONCE)
        some = ids[lo * block : hi * block]
        rows = np.pad(some, (0, (hi - lo) * block - len(some)), "edge").reshape(-1, block)
        low[lo:hi] = rows.min(axis=1)
        above = rows - low[lo:hi, None]
        width[lo:hi] = _widths(np.partition(above, rank, axis=1)[:, rank])
        odd = above > ((1 << width[lo:hi]) - 1).astype(np.uint32)[:, None]
        at_block, at = np.nonzero(odd)
        n_odd[lo:hi] = np.bincount(at_block, minlength=hi - lo)
        places.append(at)
        values.append(above[odd])
        above[odd] = 0
        # blocks of one width are packed together, then stand in order again
        made: list[bytes] = [b""] * (hi - lo)
        for w in np.unique(width[lo:hi][width[lo:hi] > 0]).tolist():
            mine = np.flatnonzero(width[lo:hi] == w)
            for k, row in zip(mine.tolist(), to_bits(above[mine], w), strict=True):
                made[k] = row.tobytes()
        packed += made
    sizes = width * block // 8
    head = b"PFR1" + struct.pack("<IQQQ", block, len(ids), len(doc_ids), int(sizes.sum()))
    docs = np.array([x or 0 for x in doc_ids], "<i8").tobytes() + np.array([x is None for x in doc_ids], "u1").tobytes() + np.asarray(lengths, "<u8").tobytes()
    index = (np.cumsum(sizes) - sizes).astype("<u8").tobytes() + low.astype("<u4").tobytes() + width.astype("u1").tobytes() + (np.cumsum(n_odd) - n_odd).astype("<u4").tobytes()
    odds = struct.pack("<I", int(n_odd.sum())) + np.concatenate(places).astype("<u2").tobytes() + np.concatenate(values).astype("<u4").tobytes()
    return b"".join([head, docs, index, odds, *packed])


class Reader:
    """A file's documents and ids; any span of ids is decoded from its blocks alone."""

    def __init__(self, data: bytes):
        if data[:4] != b"PFR1":
            raise ValueError("not a token file")
        self.block, self.n_ids, n_docs, n_packed = struct.unpack_from("<IQQQ", data, 4)
        self._data, self._at = data, 32
        doc_ids, null = self._take("<i8", n_docs), self._take("u1", n_docs)
        self.doc_ids = [None if z else int(x) for x, z in zip(doc_ids, null, strict=True)]
        self.lengths = self._take("<u8", n_docs).astype(np.int64)
        n = -(-self.n_ids // self.block)
        self.starts, self.low, self.width, before = (self._take(k, n) for k in ("<u8", "<u4", "u1", "<u4"))
        n_odd = int(self._take("<u4", 1)[0])
        self.before = np.append(before, n_odd).astype(np.int64)
        self.odd_at, self.odd = self._take("<u2", n_odd), self._take("<u4", n_odd)
        self.packed = self._take("u1", n_packed)

    def _take(self, kind: str, n: int) -> np.ndarray:
        out = np.frombuffer(self._data, kind, n, self._at)
        self._at += out.nbytes
        return out

    def blocks(self, first: int, last: int) -> np.ndarray:
        """Ids of blocks first to last - 1, the last one's padding included."""
        out = np.zeros((last - first, self.block), np.uint32)
        width = self.width[first:last]
        for w in np.unique(width[width > 0]).tolist():
            mine = np.flatnonzero(width == w)
            for lo in range(0, len(mine), BLOCKS_AT_ONCE):
                some = mine[lo : lo + BLOCKS_AT_ONCE]
                raw = self.packed[self.starts[first + some].astype(np.int64)[:, None] + np.arange(w * self.block // 8)]
                out[some] = from_bits(raw, w)
        a, b = self.before[first], self.before[last]
        out[np.repeat(np.arange(last - first), np.diff(self.before[first : last + 1])), self.odd_at[a:b]] = self.odd[a:b]
        return (out + self.low[first:last, None]).reshape(-1)

    def ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        stop = self.n_ids if stop is None else stop
        if start >= stop:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, -(-stop // self.block)
        return self.blocks(first, last)[start - first * self.block : stop - first * self.block]


# -- Spark ------------------------------------------------------------------------------------


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, file_ids: int = FILE_IDS) -> DataFrame:
    """Write the ids of ``docs`` (doc_id, text) under ``folder``; returns the settled manifest."""
    parts = common.partitions_for(docs, common.text_bytes(docs))
    # one id, null or not, may have any number of rows: the start of their texts parts them, and equal short rows are parted by where they were read
    start = F.substring("text", 1, START)
    place = F.when(F.length("text") <= START, F.monotonically_increasing_id())
    rows = docs.select("doc_id", "text", start.alias("start"), place.alias("place"))
    ranged = rows.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), F.col("start").asc_nulls_first(), "place")
    dealt = ranged.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()).select("doc_id", "text")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seq = encoder(tokenizer).encode, TaskContext.get().partitionId(), 0
        held: list[np.ndarray] = []
        doc_ids: list[int | None] = []
        lengths: list[int] = []

        def flush() -> pa.RecordBatch:
            nonlocal held, doc_ids, lengths, seq
            data = pack(np.concatenate(held), doc_ids, np.array(lengths))
            name = f"{uuid.uuid4().hex}.pfr"
            common.put(folder, name, data)
            row = {"part": part, "seq": seq, "name": name, "n_docs": len(doc_ids), "n_ids": sum(lengths), "n_bytes": len(data)}
            held, doc_ids, lengths, seq = [], [], [], seq + 1
            return pa.RecordBatch.from_pylist([row], schema=_MANIFEST)

        for batch in batches:
            for lo, hi in common.slices(batch.column(1), SLICE):
                some = batch.slice(lo, hi - lo)
                ids, counts = encode(some.column(1))
                # the end id after every document
                counts = counts + 1
                out = np.full(int(counts.sum()), end_id, np.uint32)
                keep = np.ones(len(out), bool)
                keep[np.cumsum(counts) - 1] = False
                out[keep] = ids
                held.append(out)
                doc_ids += some.column(0).to_pylist()
                lengths += counts.tolist()
                if sum(map(len, held)) >= file_ids:
                    yield flush()
        if doc_ids:
            yield flush()
        pa.default_memory_pool().release_unused()  # the worker lives on

    return common.settle(dealt.mapInArrow(task, MANIFEST), "token-manifest")


def read(folder: str, manifest: DataFrame) -> DataFrame:
    """Per document of the files named in ``manifest``: doc_id, start, n_tokens, ids_crc32."""
    spark = manifest.sparkSession

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                file = Reader(content.as_buffer().to_pybytes())
                ids, at = file.ids().astype("<u4"), np.concatenate([[0], np.cumsum(file.lengths)])
                crcs = [zlib.crc32(ids[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                n = len(crcs)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([posixpath.basename(path)] * n, pa.string()), pa.array(range(n), pa.int64()), pa.array(file.doc_ids, pa.int64()), pa.array(at[:-1], pa.int64()), pa.array(file.lengths, pa.int64()), pa.array(crcs, pa.int64())],
                    names=["name", "place", "doc_id", "start_in_file", "n_tokens", "ids_crc32"],
                )

    before = W.orderBy("part", "seq").rowsBetween(W.unboundedPreceding, -1)  # a row per file
    base = manifest.select("name", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pfr").load(folder).select("path", "content")
    found = files.mapInArrow(task, DOCS)
    return found.join(base, "name").select("doc_id", (F.col("base") + F.col("start_in_file")).alias("start"), "n_tokens", "ids_crc32")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op9(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    folder = common.shared_dir(docs.sparkSession, "token-ids")
    return read(folder, write(docs, folder, tokenizer or default_tokenizer()))
