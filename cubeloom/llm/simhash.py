"""SimHash near-duplicates by a self-join of a binary trie of fingerprints.

The distinct fingerprints form a binary trie.  Pairs of its nodes are traversed
together from the pair (root, root): a pair's children are the pairs of their
children, differing bits add up, and a pair over the error budget is dropped.
Upper levels are a table of node pairs, joined with the table of children four
bits at a time, until a node holds at most ``LEAF`` fingerprints; pairs of such
leaves are then finished inside tasks, bit by bit, on sorted arrays.  A task
gives back a spanning forest of the links it found, never all pairs, and the
components of the links follow by star contraction.

Bounds: a leaf is at most ``LEAF`` fingerprints whatever the data, equal
fingerprints are one, so a group of copies of any size is one trie entry.

Defined results: null text has no words; texts without words have fingerprint
zero and link like any other; a null doc_id never names a component unless
nothing else does (component_id is then null); repeated rows are repeated in
the result; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components

BITS = 64
#: Differing bits that still link.
BUDGET = 2
SHINGLE = 3
SEED = 42
#: Most fingerprints of a leaf; bits that a step of the upper levels descends.
LEAF = 1024
STEP = 4
#: Pairs of fingerprints compared at once inside a task.
AT_ONCE = 1 << 20


# -- fingerprints -----------------------------------------------------------------------------


def fingerprint(words: list[bytes], shingle: int = SHINGLE) -> int:
    """Majority bits of the XXH64 of all word shingles, repeats included."""
    if not words:
        return 0
    line, lengths = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    width = min(shingle, len(words))
    spans = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], SEED) for a, b in spans], "<u8")
    ones = np.zeros(BITS, np.int64)
    for lo in range(0, len(hashes), 1 << 16):
        part = hashes[lo : lo + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a signed long) of every row."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint((t or "").encode().translate(_LOWER).split(), shingle) for t in batch.column(1).to_pylist()), np.uint64, len(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(task, f"doc_id {kind}, fp bigint")


# -- the trie inside a task -------------------------------------------------------------------


def _descend(a: np.ndarray, b: np.ndarray, same: bool, depth: int, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) of sorted arrays ``a`` and ``b`` within ``budget`` differing bits.

    Both arrays are nodes' whole contents; their first ``depth`` bits may differ
    between the two, as far as the budget allows.  With ``same`` only i < j.
    """
    if not len(a) or not len(b):
        return
    differ = int(np.bitwise_count((a[0] ^ b[0]) >> np.uint64(BITS - depth))) if depth else 0
    nodes = np.array([[0, len(a), 0, len(b), differ]], np.int64)
    nodes = nodes[nodes[:, 4] <= budget]
    while len(nodes):
        work = (nodes[:, 1] - nodes[:, 0]) * (nodes[:, 3] - nodes[:, 2])
        done = (work <= 64) if depth < BITS else np.ones(len(nodes), bool)
        small, nodes = nodes[done], nodes[~done]
        work = work[done]
        lo = 0
        while lo < len(small):  # compare what is left of small nodes directly
            hi = max(lo + 1, int(np.searchsorted(np.cumsum(work[lo:]), AT_ONCE, "right")) + lo)
            part, n = small[lo:hi], work[lo:hi]
            at = common.ranges(np.zeros(len(part)), n)
            wide = np.repeat(part[:, 3] - part[:, 2], n)
            i, j = np.repeat(part[:, 0], n) + at // wide, np.repeat(part[:, 2], n) + at % wide
            near = np.bitwise_count(a[i] ^ b[j]) <= budget
            if same:
                near &= i < j
            yield i[near], j[near]
            lo = hi
        if not len(nodes):
            return
        bit = np.uint64(1 << (BITS - 1 - depth))
        mask = ~np.uint64((int(bit) << 1) - 1) if depth else np.uint64(0)
        cut_a = np.searchsorted(a, (a[nodes[:, 0]] & mask) | bit)
        cut_b = np.searchsorted(b, (b[nodes[:, 2]] & mask) | bit)
        sides_a = [(nodes[:, 0], cut_a), (cut_a, nodes[:, 1])]
        sides_b = [(nodes[:, 2], cut_b), (cut_b, nodes[:, 3])]
        made = []
        for x in (0, 1):
            for y in (0, 1):
                more = np.stack([*sides_a[x], *sides_b[y], nodes[:, 4] + (x != y)], axis=1)
                keep = (more[:, 1] > more[:, 0]) & (more[:, 3] > more[:, 2]) & (more[:, 4] <= budget)
                if same and (x, y) == (1, 0):  # the mirror image of (0, 1) where both are one node
                    keep &= ~((nodes[:, 0] == nodes[:, 2]) & (nodes[:, 1] == nodes[:, 3]))
                made.append(more[keep])
        nodes, depth = np.concatenate(made), depth + 1


def _forest(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Merge the labels of linked entries, in place, each to the least of its component."""
    while True:
        low = np.minimum(label[i], label[j])
        before = label.copy()
        for end in (label[i], label[j], i, j):
            np.minimum.at(label, end, low)
        while not np.array_equal(label, up := label[label]):
            label[:] = up
        if np.array_equal(before, label):
            return


def linked(a: np.ndarray, b: np.ndarray | None, depth: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning edges of all links inside ``a``, or between ``a`` and ``b``."""
    values = a if b is None else np.concatenate([a, b])
    label, shift = np.arange(len(values)), 0 if b is None else len(a)
    for i, j in _descend(a, a if b is None else b, b is None, depth, budget):
        if len(i):
            _forest(label, i, j + shift)
    moved = np.flatnonzero(label != np.arange(len(values)))
    return values[moved], values[label[moved]]


# -- the trie as tables -----------------------------------------------------------------------


def _prefix(fp: F.Column, depth: int) -> F.Column:
    return F.shiftrightunsigned(fp, BITS - depth) if depth else F.lit(0).cast("bigint")


def leaf_pairs(distinct: DataFrame, budget: int = BUDGET, leaf: int = LEAF) -> tuple[DataFrame, DataFrame]:
    """Traverse the upper trie.

    Returns the leaf of every fingerprint (fp, depth, prefix) and the pairs of
    leaves within budget (a_depth, a_prefix, b_depth, b_prefix).
    """
    spark = distinct.sparkSession
    open_fps, placed, found = distinct.select("fp"), [], []
    node = "struct<depth:int,prefix:bigint>"
    root_open = distinct.count() > leaf
    root = F.struct(F.lit(0).alias("depth"), F.lit(0).cast("bigint").alias("prefix")).cast(node)
    pairs = spark.range(1).select(
        root.alias("a"), root.alias("b"), F.lit(root_open).alias("a_open"), F.lit(root_open).alias("b_open"), F.lit(0).alias("differ"),
    )
    if not root_open:
        return open_fps.select("fp", root.alias("leaf")), pairs.select("a", "b")
    depth = 0
    while depth < BITS:
        below = depth + STEP
        grouped = open_fps.select("fp", _prefix(F.col("fp"), below).alias("prefix"))
        children = common.settle(grouped.groupBy("prefix").agg((F.count(F.lit(1)) > (leaf if below < BITS else 1 << 62)).alias("open")), "trie-nodes")
        child = children.select(_up(F.col("prefix")).alias("__up"), F.struct(F.lit(below).alias("depth"), F.col("prefix")).cast(node).alias("child"), "open")

        def expand(side: str, of: DataFrame, child: DataFrame = child, depth: int = depth) -> DataFrame:
            """Open nodes of ``side`` at this depth give way to their children; closed ones stay."""
            rest = of.filter(~F.col(f"{side}_open"))
            gone = of.filter(f"{side}_open").withColumn("__up", F.col(f"{side}.prefix")).drop(side, f"{side}_open")
            moved = gone.join(child, "__up").withColumnsRenamed({"child": side, "open": f"{side}_open"}).drop("__up")
            return moved.select(*of.columns).union(rest.select(*of.columns))

        both = expand("b", expand("a", pairs.withColumn("__self", F.col("a") == F.col("b"))))
        # only bits that this step added to both nodes are new; a closed node's were counted before
        new = F.when(
            (F.col("a.depth") == below) & (F.col("b.depth") == below), F.bit_count(F.col("a.prefix").bitwiseXOR(F.col("b.prefix"))),
        ).otherwise(F.col("differ"))
        both = both.withColumn("differ", new).filter(F.col("differ") <= budget).filter(~F.col("__self") | (F.col("a.prefix") <= F.col("b.prefix"))).drop("__self")
        both = common.settle(both, "trie-pairs")
        found.append(both.filter("NOT a_open AND NOT b_open").select("a", "b"))
        pairs = both.filter("a_open OR b_open")
        marked = grouped.join(children, "prefix")
        placed.append(marked.filter("NOT open").select("fp", F.struct(F.lit(below).alias("depth"), F.col("prefix")).cast(node).alias("leaf")))
        still = marked.filter("open").select("fp")
        depth = below
        if not children.filter("open").limit(1).count():
            break
        open_fps = common.settle(still, "trie-open")
    out_leaf, out_pairs = placed[0], found[0]
    for x in placed[1:]:
        out_leaf = out_leaf.union(x)
    for x in found[1:]:
        out_pairs = out_pairs.union(x)
    return out_leaf, out_pairs


def _up(prefix: F.Column) -> F.Column:
    return F.shiftrightunsigned(prefix, STEP)


def links(distinct: DataFrame, budget: int = BUDGET, leaf: int = LEAF) -> DataFrame:
    """Spanning edges (u, v) of all links between distinct fingerprints ``fp``."""
    leaves, pairs = leaf_pairs(distinct, budget, leaf)
    full = common.settle(leaves.groupBy("leaf").agg(F.sort_array(F.collect_list("fp")).alias("fps")), "trie-leaves")  # at most `leaf` entries each
    work = pairs.join(
        full.select(F.col("leaf").alias("a"), F.col("fps").alias("a_fps")), "a",
    ).join(full.select(F.col("leaf").alias("b"), F.col("fps").alias("b_fps")), "b")
    work = work.select("a", "b", "a_fps", "b_fps")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 64):
                some = batch.slice(lo, 64)
                us, vs = [], []
                for a, b, x, y in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), some.column(2), some.column(3), strict=True):
                    left = np.sort(np.asarray(x.values).view(np.uint64))
                    right = None if a == b else np.sort(np.asarray(y.values).view(np.uint64))
                    u, v = linked(left, right, min(a["depth"], b["depth"]), budget)
                    us.append(u)
                    vs.append(v)
                u, v = (np.concatenate(z).astype(np.uint64).view(np.int64) for z in (us, vs))
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    # rows of up to two leaves each: enough partitions for even work
    parts = max(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return work.repartition(parts, F.xxhash64("a", "b")).mapInArrow(task, "u bigint, v bigint")


def classes(docs: DataFrame, budget: int = BUDGET, shingle: int = SHINGLE, leaf: int = LEAF) -> DataFrame:
    """doc_id, fp and component_id of every row of ``docs`` (doc_id, text)."""
    with common.scratch() as keep:
        rows = common.settle(fingerprints(docs, shingle), "fingerprints")
        distinct = common.settle(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "distinct-fingerprints")
        roots = components(links(distinct, budget, leaf))
        named = distinct.join(roots, F.col("fp") == F.col("node"), "left").select(
            "fp", "least", F.col("n").alias("rows"), F.coalesce("root", "fp").alias("root"),
        )
        named = common.settle(named, "named-fingerprints")
        least = named.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n"))
        ids = common.join_counted(named, least, "root", named.count()).select("fp", "component_id", F.col("rows").alias("n"))
        ids = common.settle(ids, "component-ids")
        keep += [rows, ids]
    return common.join_counted(rows, ids, "fp", rows.count()).select("doc_id", "fp", "component_id")


# -- looser budgets ---------------------------------------------------------------------------

#: For a similarity of 0.8 a budget of 64 bits would prune nothing near the root.  So wide
#: fingerprints of 2 x 64 bits are used, in several tries, each with its own order of the bits, whose
#: first levels (the head) allow no differing bit; deeper levels have the whole budget.
WIDE = 2 * BITS
#: Share of the pairs at the similarity asked for that may meet in no trie's head.
MISSED = 0.0005
#: Share of the orders that are descended before the others; what they join is one entry to the rest.
FIRST = 1 / 8
#: The least head; entries that share a head are about ``PER_HEAD`` where none are alike.
HEAD = 16
PER_HEAD = 4
#: A head's entries meet in blocks if they are more than this.  Before that, the first orders part them by
#: ``DEEPER`` more levels as long as they are more.
MOST = 1 << 16
DEEPER = 8
SIMILARITY = 0.8
#: Nodes up to this many entries are compared pair by pair.
SMALL_NODE = 256
#: Most entries of a class of candidates, or of one of its blocks, that meet in a task as one.
BLOCK = 512


def _angle(similarity: float) -> float:
    """Probability that a bit differs: the angle between two shingle sets of that Jaccard similarity."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def wide_budget(similarity: float) -> int:
    """Differing bits of a candidate: three standard deviations above the mean."""
    angle = _angle(similarity)
    return int(WIDE * angle + 3 * math.sqrt(WIDE * angle * (1 - angle)))


def heads(n: int, similarity: float) -> tuple[int, int]:
    """(levels of a head, orders) for ``n`` entries: heads grow with the entries, and orders with the heads."""
    head = max(HEAD, math.ceil(math.log2(max(n, 1) / PER_HEAD)))
    return head, math.ceil(math.log(MISSED) / math.log1p(-((1 - _angle(similarity)) ** head)))


def shingles(words: list[bytes], shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """128-bit XXH3 of each distinct word shingle as rows of 16 bytes, and their first 64 bits, sorted and distinct."""
    if not words:
        return np.zeros((0, WIDE // 8), np.uint8), np.zeros(0, np.int64)
    width, digest = min(shingle, len(words)), xxhash.xxh3_128_digest
    grams = {b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)}
    hashes = np.frombuffer(b"".join([digest(g, SEED) for g in grams]), np.uint8).reshape(-1, WIDE // 8)
    return hashes, np.unique(hashes[:, :8].copy().view("<i8").reshape(-1))


def _majority(hashes: np.ndarray) -> tuple[int, int]:
    if not len(hashes):
        return 0, 0
    ones = np.zeros(WIDE, np.int64)
    for lo in range(0, len(hashes), 1 << 15):
        ones += np.unpackbits(hashes[lo : lo + (1 << 15)], axis=1).sum(axis=0, dtype=np.int64)
    hi, lo = np.packbits(ones * 2 > len(hashes)).view("<u8").tolist()
    return hi, lo


def wide_fingerprint(words: list[bytes], shingle: int) -> tuple[int, int]:
    """Majority bits of the 128-bit XXH3 of each distinct word shingle."""
    return _majority(shingles(words, shingle)[0])


def _order(t: int) -> np.ndarray:
    """The bits in order ``t``."""
    return np.random.default_rng([SEED, t]).permutation(WIDE)


def _grow(hi: np.ndarray, lo: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning edges of one large node: each entry is compared with those not reached yet."""
    left = np.arange(len(hi))
    us, vs = [], []
    queue: list[int] = []
    while len(left):
        if not queue:
            queue, left = [int(left[0])], left[1:]
        at = queue.pop()
        near = np.bitwise_count(hi[left] ^ hi[at]) + np.bitwise_count(lo[left] ^ lo[at]) <= budget
        got, left = left[near], left[~near]
        us.append(got)
        vs.append(np.full(len(got), at))
        queue += got.tolist()
    return np.concatenate([*us, np.zeros(0, np.int64)]), np.concatenate([*vs, np.zeros(0, np.int64)])


def _node_links(node: np.ndarray, hi: np.ndarray, lo: np.ndarray, root: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Links in all runs of equal ``node`` between entries of different ``root``, as stars of roots."""
    first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
    size = np.diff(np.append(first, len(node)))
    differ = np.minimum.reduceat(root, first) != np.maximum.reduceat(root, first)
    us, vs = [], []
    small = differ & (size <= SMALL_NODE)
    starts, sizes = first[small], size[small]
    at = 0
    while at < len(starts):
        to = max(at + 1, at + int(np.searchsorted(np.cumsum(sizes[at:] ** 2), AT_ONCE, "right")))
        begin, n = starts[at:to], sizes[at:to]
        cell, wide = common.ranges(np.zeros(len(n)), n * n), np.repeat(n, n * n)
        i, j = np.repeat(begin, n * n) + cell // wide, np.repeat(begin, n * n) + cell % wide
        keep = (i < j) & (root[i] != root[j])
        i, j = i[keep], j[keep]
        near = np.bitwise_count(hi[i] ^ hi[j]) + np.bitwise_count(lo[i] ^ lo[j]) <= budget
        us.append(i[near])
        vs.append(j[near])
        at = to
    large = differ & (size > SMALL_NODE)
    for begin, n in zip(first[large].tolist(), size[large].tolist(), strict=True):
        u, v = _grow(hi[begin : begin + n], lo[begin : begin + n], budget)
        us.append(u + begin)
        vs.append(v + begin)
    u, v = (root[np.concatenate([*x, np.zeros(0, np.int64)])] for x in (us, vs))
    # whatever was found anywhere among these rows is joined: a star around each least root
    roots, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    label = np.arange(len(roots))
    if len(u):
        _forest(label, place[: len(u)], place[len(u) :])
    moved = np.flatnonzero(label != np.arange(len(roots)))
    return roots[moved], roots[label[moved]]


def _nodes(bits: np.ndarray, t: int, head: int, depth: int) -> np.ndarray:
    """The nodes of trie ``t`` that rows of bits reach at ``depth``: numbers, or hashes where those would not fit."""
    order = _order(t)[:depth]
    number = bits[:, order[:head]].astype(np.int64) @ (1 << np.arange(head)).astype(np.int64) + (t << head)
    if depth == head:
        return number
    below = np.packbits(bits[:, order[head:]], axis=1)
    return np.array([xxhash.xxh3_64_intdigest(x.tobytes(), n & (2**63 - 1)) for n, x in zip(number.tolist(), below, strict=True)], np.uint64).view(np.int64)


def _bits(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.stack([hi, lo], axis=1).astype("<i8").view(np.uint8).reshape(len(hi), WIDE // 8), axis=1, bitorder="little")


def _dealt(entries: DataFrame, orders: range, head: int) -> DataFrame:
    """node, t, hi, lo, root: every entry at the head of every order."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 4000):
                hi, lo, root = (np.array(c) for c in batch.slice(at, 4000).columns)
                bits = _bits(hi, lo)
                nodes = np.concatenate([_nodes(bits, t, head, head) for t in orders])
                yield pa.RecordBatch.from_arrays([
                    pa.array(nodes), pa.array(np.repeat(np.arange(orders.start, orders.stop, dtype=np.int32), len(hi))),
                    *(pa.array(np.tile(x, len(orders))) for x in (hi, lo, root)),
                ], names=["node", "t", "hi", "lo", "root"])

    return entries.select("hi", "lo", "root").mapInArrow(deal, DEALT)


DEALT = "node long, t int, hi long, lo long, root long"


def _parted(dealt: DataFrame, head: int, most: int) -> DataFrame:
    """``dealt`` with nodes of more than ``most`` entries given up for those below them, as a trie goes on.

    That joins most of a large group at little cost, but not entries that differ
    in the levels between: :func:`_met` is for the rest.

    The entries of such nodes are few in kind (copies with small changes), so
    what is counted and written again is only that part.
    """
    spark, depth, out = dealt.sparkSession, head, []
    while depth < WIDE:
        counts = common.settle(dealt.groupBy("node").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most), "large-nodes")
        if counts.isEmpty():
            break
        # at most one node in `most` entries: a small table, which the planner broadcasts where it fits
        out.append(dealt.join(counts.select("node"), "node", "left_anti"))
        depth = min(depth + DEEPER, WIDE)

        def descend(batches: Iterator[pa.RecordBatch], depth: int = depth) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                t, hi, lo = (np.array(batch.column(k)) for k in (1, 2, 3))
                nodes = np.zeros(len(batch), np.int64)
                for one in np.unique(t):
                    mine = t == one
                    nodes[mine] = _nodes(_bits(hi[mine], lo[mine]), int(one), head, depth)
                yield pa.RecordBatch.from_arrays([pa.array(nodes), *batch.columns[1:]], names=batch.schema.names)

        large = dealt.join(counts.select("node"), "node", "left_semi").select("node", "t", "hi", "lo", "root")
        dealt = common.settle(large.mapInArrow(descend, DEALT), "lower-nodes")
    for x in out:
        dealt = dealt.unionByName(x)
    return dealt


def _met(dealt: DataFrame, most: int, since: int = 0) -> DataFrame:
    """``dealt`` with nodes of more than ``most`` entries given up for the pairs of their blocks: any two entries of different roots still meet.

    A root with more entries than a block has blocks of its own, which need not
    meet each other; entries of the other roots share blocks.  Of the orders
    before ``since`` only such nodes are given back.
    """
    block, count = max(1, most // 2), lambda n: F.ceil(n / max(1, most // 2)).cast("int")
    sizes = dealt.groupBy("node").agg(F.count(F.lit(1)).alias("n"), (F.min("root") < F.max("root")).alias("several")).filter(F.col("n") > most)
    sizes = common.settle(sizes, "large-nodes")
    small = dealt.filter(F.col("t") >= since)
    if sizes.isEmpty():
        return small
    # one node in `most` entries, one root in `block` of them: small tables, which the planner broadcasts where they fit
    small = small.join(sizes.select("node"), "node", "left_anti")
    # equal fingerprints of one root have the same links
    large = dealt.join(sizes.filter("several").select("node"), "node", "left_semi").select("node", "t", "hi", "lo", "root").distinct()
    large = common.settle(large, "large-node-entries")
    big = common.settle(large.groupBy("node", "root").agg(F.count(F.lit(1)).alias("of_root")).filter(F.col("of_root") > block), "large-roots")
    taken = big.groupBy("node").agg(F.sum("of_root").alias("taken"))
    of_node = large.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    rest = of_node.join(taken, "node", "left").select("node", (F.col("n") - F.coalesce("taken", F.lit(0))).alias("of_rest"))
    rest = common.settle(rest, "large-node-rests")
    own = F.coalesce("of_root", "of_rest")
    placed = large.join(big, ["node", "root"], "left").join(rest, "node").select(
        "node", F.when(F.col("of_root").isNotNull(), F.col("root")).alias("big"), F.pmod(F.xxhash64("root", "hi", "lo"), count(own)).cast("int").alias("b"),
        "t", "hi", "lo", "root",
    ).withColumn("block", F.xxhash64("node", F.col("big").isNull(), "big", "b"))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), count(n) - 1))
    blocks = big.select("node", F.col("root").alias("big"), numbers(F.col("of_root")).alias("b")).union(
        rest.filter("of_rest > 0").select("node", F.lit(None).cast("long"), numbers(F.col("of_rest"))),
    ).withColumn("block", F.xxhash64("node", F.col("big").isNull(), "big", "b"))
    x, y = (blocks.select("node", F.col("big").alias(f"{k}_big"), F.col("block").alias(k)) for k in "xy")
    pairs = x.join(y, "node").filter("x <= y AND (x_big IS NULL OR y_big IS NULL OR x_big != y_big)").select("x", "y")
    pairs = common.settle(pairs.distinct(), "large-node-pairs")
    sides = pairs.select(F.col("x").alias("block"), "x", "y").union(pairs.filter("x != y").select(F.col("y").alias("block"), "x", "y"))
    met = placed.join(sides, "block").select(F.xxhash64("x", "y").alias("node"), "t", "hi", "lo", "root")
    return small.unionByName(met)


def wide_links(entries: DataFrame, budget: int, orders: range, head: int, most: int | None = None, since: int | None = 0) -> DataFrame:
    """Edges (u, v) between roots of the fingerprints (hi, lo, root) that some order's trie brings together.

    Without ``most`` no head can have more than ``MOST`` entries.  With it, nodes
    of more are parted if ``since`` is None, which finds part of their edges;
    else their blocks meet, and orders before ``since`` give only those nodes.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0

        def solve(rows: pa.Table) -> pa.RecordBatch:
            node, hi, lo, root = (np.asarray(rows.column(k)).astype(np.int64) for k in range(4))
            u, v = _node_links(node, hi.view(np.uint64), lo.view(np.uint64), root, budget)
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        for batch in batches:  # sorted by node: whole nodes are solved, the last one waits for its rest
            held.append(batch)
            n += len(batch)
            if n >= 200_000 and batch.column(0)[0] != batch.column(0)[-1]:
                rows = pa.Table.from_batches(held).combine_chunks()
                nodes = np.asarray(rows.column(0))
                cut = int(np.searchsorted(nodes, nodes[-1]))
                yield solve(rows.slice(0, cut))
                held = rows.slice(cut).to_batches()
                n = len(rows) - cut
        if n:
            yield solve(pa.Table.from_batches(held).combine_chunks())

    dealt = _dealt(entries, orders, head)
    if most is not None:
        dealt = _parted(dealt, head, most) if since is None else _met(dealt, most, since)
    rows = dealt.select("node", "hi", "lo", "root")
    return rows.repartition("node").sortWithinPartitions("node").mapInArrow(task, "u long, v long")


def wide_classes(distinct: DataFrame, budget: int, similarity: float) -> DataFrame:
    """``distinct`` (entry, hi, lo and more) with the least entry of its class as ``root``.

    The first orders join most of a large group, so that the others find few
    links that are new.  Where there may be nodes of more than ``MOST`` entries,
    the first orders only part them, and they meet whole with the others.
    """
    entries = distinct.withColumn("root", F.col("entry"))
    n = distinct.count()
    head, orders = heads(n, similarity)
    first, most = math.ceil(orders * FIRST), MOST if n > MOST else None
    for some, since in ((range(first), None), (range(first if most is None else 0, orders), first)):
        found = components(wide_links(entries, budget, some, head, most, since)).withColumnRenamed("root", "__new")
        joined = entries.join(found, F.col("root") == F.col("node"), "left")
        entries = common.settle(joined.withColumn("root", F.coalesce("__new", "root")).drop("node", "__new"), "wide-classes")
    return entries


# -- candidates to pairs of the similarity asked for --------------------------------------------


class _Sets:
    """Entries that meet in a task: fingerprints, and the sorted shingle hashes of each."""

    def __init__(self, rows: pa.Table) -> None:
        rows = rows.combine_chunks()
        self.entry, self.root = (np.array(rows.column(k)) for k in ("entry", "root"))
        self.hi, self.lo = (np.array(rows.column(k)).view(np.uint64) for k in ("hi", "lo"))
        grams = rows.column("grams").combine_chunks() if isinstance(rows.column("grams"), pa.ChunkedArray) else rows.column("grams")
        self.size = np.asarray(grams.value_lengths()).astype(np.int64)
        self.flat = np.asarray(grams.flatten())
        self.start = np.cumsum(self.size) - self.size

    def similar(self, at: int, others: np.ndarray, budget: int, similarity: float) -> np.ndarray:
        """Which of ``others`` are within the budget of entry ``at`` and have the Jaccard similarity."""
        near = np.bitwise_count(self.hi[others] ^ self.hi[at]) + np.bitwise_count(self.lo[others] ^ self.lo[at]) <= budget
        n, own = self.size[others], self.size[at]
        near &= np.minimum(n, own) >= similarity * np.maximum(n, own) - 1e-9
        near &= np.minimum(n, own) > 0
        out = np.zeros(len(others), bool)
        left = np.flatnonzero(near)
        mine = self.flat[self.start[at] : self.start[at] + own]
        while len(left):
            take = max(1, int(np.searchsorted(np.cumsum(n[left]), AT_ONCE, "right")))
            some, left = left[:take], left[take:]
            theirs = self.flat[common.ranges(self.start[others[some]], n[some])]
            hit = mine[np.minimum(np.searchsorted(mine, theirs), own - 1)] == theirs
            total = np.concatenate([[0], np.cumsum(hit)])
            ends = np.cumsum(n[some])
            shared = total[ends] - total[ends - n[some]]
            out[some] = shared >= similarity * (n[some] + own - shared) - 1e-9
        return out

    def links(self, budget: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
        """Stars of roots: every root that similar entries join leads to the least of them.

        Entries of one root are joined already.  Each entry is compared with
        those of roots that are not reached yet.
        """
        roots, place = np.unique(self.root, return_inverse=True)
        by_root = np.argsort(place, kind="stable")
        first = np.searchsorted(place[by_root], np.arange(len(roots) + 1))
        label, reached = np.arange(len(roots)), np.zeros(len(roots), bool)
        left = np.arange(len(place))
        for seed in range(len(roots)):
            if reached[seed]:
                continue
            reached[seed] = True
            queue = by_root[first[seed] : first[seed + 1]].tolist()
            left = left[~reached[place[left]]]
            while queue and len(left):
                got = np.unique(place[left[self.similar(queue.pop(), left, budget, similarity)]])
                if len(got):
                    reached[got], label[got] = True, seed
                    left = left[~reached[place[left]]]
                    for r in got.tolist():
                        queue += by_root[first[r] : first[r + 1]].tolist()
        moved = np.flatnonzero(label != np.arange(len(roots)))
        return roots[moved], roots[label[moved]]


def _solved(rows: DataFrame, by: list[str], budget: int, similarity: float) -> DataFrame:
    """Edges (u, v) between roots of the entries that have the same values in ``by``."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def solve() -> pa.RecordBatch:
            u, v = _Sets(pa.Table.from_batches(held)).links(budget, similarity)
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

        last = None
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in by), strict=True))
            at = 0
            while at < len(keys):
                to = at
                while to < len(keys) and keys[to] == keys[at]:
                    to += 1
                if held and keys[at] != last:
                    yield solve()
                    held = []
                last = keys[at]
                held.append(batch.slice(at, to - at))
                at = to
        if held:
            yield solve()

    columns = [*by, "entry", "root", "hi", "lo", "grams"]
    return rows.select(*columns).repartition(*by).sortWithinPartitions(*by).mapInArrow(task, "u long, v long")


def _moved(entries: DataFrame, edges: DataFrame) -> DataFrame:
    found = components(edges).withColumnRenamed("root", "__new")
    return entries.join(found, F.col("root") == F.col("node"), "left").withColumn("root", F.coalesce("__new", "root")).drop("node", "__new")


def similar_classes(members: DataFrame, budget: int, similarity: float, block: int | None = None) -> DataFrame:
    """(entry, root) of ``members`` (class, n, entry, hi, lo, grams): components of the similar pairs of each class.

    Classes of at most ``block`` entries meet whole.  Larger ones are dealt into
    blocks: first each block meets the class's block 0, which joins most of a
    group of near copies, then every pair of blocks meets unless both hold one
    and the same root.
    """
    block = block or BLOCK
    members = members.withColumn("root", F.col("entry"))
    edges = common.settle(_solved(members.filter(F.col("n") <= block), ["class"], budget, similarity), "similar-links")
    large = members.filter(F.col("n") > block)
    if large.limit(1).count():
        count = F.ceil(F.col("n") / block).cast("int")
        dealt = large.withColumn("__b", F.pmod(F.xxhash64("entry"), count).cast("int"))
        every = F.sequence(F.lit(0), count - 1)
        first = dealt.withColumn("b", F.explode(F.when(F.col("__b") == 0, every).otherwise(F.array("__b"))))
        edges = edges.union(common.settle(_solved(first, ["class", "b"], budget, similarity), "similar-links"))
        now = common.settle(_moved(members.select("class", "n", "entry", "root"), edges), "similar-roots")
        # blocks again: of one root where it has more entries than a block, and of the rest
        of_root = now.filter(F.col("n") > block).groupBy("class", "root").agg(F.count(F.lit(1)).alias("of_root"))
        of_root = of_root.withColumn("big", F.when(F.col("of_root") > block, F.col("root")))
        rest = of_root.filter("big IS NULL").groupBy("class").agg(F.sum("of_root").alias("of_rest"))
        count = F.ceil(F.coalesce(F.when(F.col("big").isNotNull(), F.col("of_root")), "of_rest") / block).cast("int")
        sized = of_root.join(rest, "class", "left").select(F.struct("class", "root").alias("__of"), "big", count.alias("count"), F.col("of_root").alias("n"))
        entries = now.filter(F.col("n") > block).drop("n").withColumn("__of", F.struct("class", "root"))
        placed = common.join_counted(entries, sized, "__of", entries.count())
        placed = placed.withColumn(
            "b", F.pmod(F.xxhash64(F.when(F.col("big").isNotNull(), F.col("entry")).otherwise(F.col("root"))), F.col("count")).cast("int"),
        )
        placed = common.settle(placed.select("class", "entry", "root", F.struct("big", "b").alias("b")), "similar-blocks")
        blocks = placed.select("class", "b").distinct()
        pairs = blocks.withColumnRenamed("b", "x").join(blocks.withColumnRenamed("b", "y"), "class").filter("x <= y AND NOT (x.big <=> y.big AND x.big IS NOT NULL)")
        pairs = common.settle(pairs, "similar-pairs")
        sides = pairs.select("class", F.col("x").alias("b"), "x", "y").union(pairs.filter("x != y").select("class", F.col("y").alias("b"), "x", "y"))
        again = placed.join(sides, ["class", "b"]).select("class", "x", "y", "entry", "root")
        again = again.join(large.select("entry", "hi", "lo", "grams"), "entry").select(
            "class", F.to_json("x").alias("x"), F.to_json("y").alias("y"), "entry", "root", "hi", "lo", "grams",
        )
        edges = common.settle(_solved(again, ["class", "x", "y"], budget, similarity), "similar-links")
        return _moved(now, edges).select("entry", "root")
    return _moved(members, edges).select("entry", "root")


def keep_first(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = 5) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: that of least doc_id, then of least digest.

    Two texts are near duplicates if the Jaccard similarity of their distinct
    shingles (64-bit hashes) is at least ``similarity``; groups are the
    components of that relation.  Candidates are the texts whose wide
    fingerprints differ in no more bits than :func:`wide_budget` allows, as far
    as some order's trie brings them together; they are never linked by that
    alone.  Texts without words are one group.  A null doc_id counts as the least.
    """
    budget = wide_budget(similarity)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hi, lo = np.zeros(len(batch), np.uint64), np.zeros(len(batch), np.uint64)
            same = []
            for i, t in enumerate(batch.column(2).to_pylist()):
                hashes, grams = shingles((t or "").encode().translate(_LOWER).split(), shingle)
                hi[i], lo[i] = _majority(hashes)
                same.append(xxhash.xxh3_128_digest(grams.tobytes(), SEED))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), *(pa.array(x.view(np.int64)) for x in (hi, lo)), pa.array(same, pa.binary()),
            ], names=["id", "key", "hi", "lo", "same"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                some = batch.slice(at, 500)
                grams = [shingles((t or "").encode().translate(_LOWER).split(), shingle)[1] for t in some.column(5).to_pylist()]
                offsets = np.concatenate([[0], np.cumsum([len(g) for g in grams])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*grams, np.zeros(0, np.int64)])))
                yield pa.RecordBatch.from_arrays([*some.columns[:5], lists], names=["class", "n", "entry", "hi", "lo", "grams"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    with common.scratch() as keep:
        rows = docs.select("doc_id", common.digest("text").alias("key"), "text").mapInArrow(task, f"id {kind}, key binary, hi long, lo long, same binary")
        rows = common.settle(rows, "wide-fingerprints")
        # an entry is a set of shingles: texts of equal fingerprints and other shingles are compared like any
        sets_of = rows.groupBy("same").agg(F.first("hi").alias("hi"), F.first("lo").alias("lo"), F.min(F.struct("id", "key")).alias("least"))
        distinct = common.settle(sets_of.select(F.monotonically_increasing_id().alias("entry"), "hi", "lo", "least"), "wide-distinct")
        candidates = wide_classes(distinct, budget, similarity)
        several = candidates.groupBy("root").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        asked = common.join_counted(candidates, several, "root", candidates.count()).select(
            F.col("root").alias("class"), "n", "entry", "hi", "lo", F.col("least").alias("__sim_least"),
        )
        keyed = docs.withColumn("__sim_key", F.struct(F.col("doc_id").alias("id"), common.digest("text").alias("key")))
        texts = keyed.select("__sim_key", "text").join(asked, F.col("__sim_key").eqNullSafe(F.col("__sim_least"))).dropDuplicates(["entry"]).select("class", "n", "entry", "hi", "lo", "text")
        members = common.settle(texts.mapInArrow(sets, "class long, n long, entry long, hi long, lo long, grams array<long>"), "candidate-shingles")
        roots = similar_classes(members, budget, similarity)
        named = candidates.drop("root").join(roots, "entry", "left").withColumn("root", F.coalesce("root", "entry"))
        kept = common.settle(named.groupBy("root").agg(F.min("least").alias("__sim_least")).select("__sim_least"), "first-of-groups")
        keep.append(kept)
    # doc_id and the digest of the text are who a row is; equal rows are one
    first = keyed.join(kept, F.col("__sim_key").eqNullSafe(F.col("__sim_least")), "left_semi")
    return first.dropDuplicates(["__sim_key"]).select(*docs.columns)


def op10(docs: DataFrame) -> DataFrame:
    found = classes(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
