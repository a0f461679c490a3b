"""The numbered operators on odd rows and random small cases, against brute force."""

import hashlib
import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cubeloom.llm import common, components, decontamination, lines, mixing, quality, sharding, simhash, substrings, token_output, topk, warc

from . import brute
from .conftest import odd_rows

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def bag(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)


# -- 1 ----------------------------------------------------------------------------------------


def test_warc_on_odd_pages(spark):
    big = "<p>" + "x" * 200
    rows = [(5, "http://b.example/z", big), (3, "http://b.example/z#f", big), (9, None, big), (4, "http://a.example/?b=2&a=1", "é" * 99), (8, "not a [url", "é" * 99), (1, "http://c.example", "short"), (2, "http://c.example", "short"), (6, "http://c.example/\r\nX: y", None), (None, "http://d.example", big), (3, "http://b.example/z#f", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    got = warc.histories(pages).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["page_id"], []).append(r)
    for page, _, html in rows:
        payload = (html or "").encode()
        assert all(r["payload_bytes"] == len(payload) and r["payload_digest"] == hashlib.sha256(payload).hexdigest() for r in by[page])
    kind = {k: (v[0]["record_type"], v[0]["refers_to"]) for k, v in by.items()}
    assert kind == {3: ("response", None), 5: ("revisit", 3), 9: ("revisit", 3), 4: ("response", None), 8: ("revisit", 4), 1: ("response", None), 2: ("response", None), 6: ("response", None), None: ("response", None)}
    ordered = sorted(got, key=lambda r: (r["range"], r["position"]))
    keys = [(r["url_key"], r["timestamp"]) for r in ordered]
    assert keys == sorted(keys)
    assert warc.op1(pages).columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert warc.op1(pages.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_warc_on_random_pages(spark, seed):
    rng = random.Random(seed)
    payloads = ["<p>" + rng.choice("xyé") * n for n in (1, 96, 97, 98, 200, 40_000)] + [None, ""]
    rows = [(i, f"http://h{rng.randrange(9)}.example/{rng.randrange(20)}", rng.choice(payloads)) for i in rng.sample(range(10_000), 300)]
    first = {}
    for i, _, html in sorted(rows):
        first.setdefault(html or "", i)
    want = []
    for i, _, html in rows:
        payload = (html or "").encode()
        again = len(payload) >= 100 and first[html or ""] < i
        want.append((i, len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if again else "response", first[html] if again else None))
    got = warc.histories(spark.createDataFrame([*rows, rows[0]], "page_id long, url string, html string")).collect()
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted(tuple(r[c] for c in columns) for r in got) == sorted([*want, want[0]]) and any(w[4] is not None for w in want)
    ordered = [(r["url_key"], r["timestamp"]) for r in sorted(got, key=lambda r: (r["range"], r["position"]))]
    assert ordered == sorted(ordered)


@pytest.mark.parametrize("k", [0, 1, 2, 3, 7, 16])
def test_loser_tree_merges(k):
    rng = random.Random(k)
    make = lambda i: sorted(({"url_key": rng.choice("abc"), "timestamp": str(rng.randrange(9)), "page_id": rng.choice([None, 1, 2]), "archive": str(i), "offset": n} for n in range(rng.randrange(6))), key=warc.order)
    runs = [make(i) for i in range(k)]
    assert list(warc.merge_runs(runs)) == sorted((c for r in runs for c in r), key=warc.order)


def test_url_keys():
    assert warc.url_key("https://www.Example.org:8080/A/b/?y=2&x=1#top") == "org,example)/a/b?x=1&y=2"
    assert warc.url_key("http://example.org") == "org,example)/" and warc.url_key(None) == ""


# -- 2 ----------------------------------------------------------------------------------------


def test_lookup_table_is_even_and_stable():
    names = [f"n{i}" for i in range(7)]
    table = sharding.lookup_table(names, 1009)
    counts = np.bincount(table, minlength=7)
    assert counts.max() - counts.min() <= 1
    less = sharding.lookup_table(names[:-1], 1009)
    kept = sum(a == b for a, b in zip(table, less, strict=True) if a != 6)
    assert kept > 0.75 * sum(a != 6 for a in table)
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sharding.lookup_table(bad, 7)
    with pytest.raises(ValueError):
        sharding.lookup_table(["a"], 9)


def test_placement_on_odd_rows(spark, odd, none):
    got = sharding.op2(odd).collect()
    assert len(got) == len(odd_rows()) and all(r["shard"] in sharding.SHARDS for r in got)
    assert len({r["shard"] for r in got if r["doc_id"] == 10}) == 1
    assert sharding.lookup_table(["a", "b", "c"], 11) == brute.turns(["a", "b", "c"], 11)
    table = brute.turns(sharding.SHARDS, sharding.SLOTS)
    ids = spark.range(3000).withColumn("slot", F.pmod(F.xxhash64("id"), F.lit(sharding.SLOTS)))
    assert all(r["shard"] == sharding.SHARDS[table[r["slot"]]] for r in sharding.place(ids, "id", sharding.SHARDS).collect())
    assert sharding.op2(none).count() == 0


# -- 3 ----------------------------------------------------------------------------------------


def _topk(rows, k=20):
    good = {(i, tuple(int(np.floor(64 * float(x))) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    width = max((len(v) for _, v in good), default=0)
    vecs = [(i, np.array(list(v) + [0] * (width - len(v)), dtype=np.int64)) for i, v in good]
    out = []
    for q, x in vecs:
        if q % 20 == 0:
            best = sorted(((-int(x @ y), i) for i, y in vecs if i != q))[:k]
            out += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("cut", [{}, {"query_block": 3, "vector_block": 7}, {"vector_block": 60, "lists": 3}])
@pytest.mark.parametrize("seed", range(2))
def test_topk_is_exact(spark, seed, cut, monkeypatch):
    monkeypatch.setattr(topk, "AT_ONCE", 2)
    rng = np.random.default_rng(seed)
    base = (rng.integers(-3, 4, size=(40, 6)) / 2).astype(np.float32)  # many ties
    vectors = {i: base[rng.integers(40)].tolist() for i in range(150)} | {1000: None, 1020: [None] * 6, 1040: [float("nan")] * 6, None: base[0].tolist(), 1060: [1.0, 2.0], 1080: [float("inf")] * 6, 1100: []}
    rows = [*vectors.items(), (40, base[1].tolist()), (40, base[2].tolist()), (0, vectors[0])]  # an id of three vectors, a repeated row
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    found = topk.search(topk.quantized(df), F.col("vec_id") % 20 == 0, **cut)
    got = sorted(map(tuple, found.select("query_id", "rank", "vec_id", "score").collect()))
    want = _topk(rows)
    # where scores of one id's vectors tie, their order is nobody's
    assert got == want and len({g[0] for g in got}) == 10


def test_topk_of_an_id_with_many_vectors(spark):
    """Its own vectors, shared ones among them, take no places, and no query looks for more than k + 1 entries."""
    rng = np.random.default_rng(3)
    v = rng.integers(-9, 10, (10_600, 3))
    ids = [7] * 10_000 + [20] * 200 + [21] * 20 + [*range(40, 420)]
    shared = [(21, x) for x in v[10_000:10_020]] + [(440, x) for x in v[10_000:10_005]]
    df = spark.createDataFrame([(i, (x / 64).tolist()) for i, x in [*zip(ids, v), *shared]], "vec_id long, embedding array<double>")
    rows = sorted({(i, *map(int, x)) for i, x in [*zip(ids, v), *shared]})
    name, what = np.array([r[0] for r in rows]), np.array([r[1:] for r in rows])
    want = []
    for q, *x in rows:
        if q % 20 == 0:
            score = np.where(name == q, -10_000, what @ np.array(x))
            want += [(q, n, int(name[i]), int(score[i])) for n, i in enumerate(np.lexsort((name, -score))[:20], 1)]
    got = sorted(map(tuple, topk.search(topk.quantized(df), F.col("vec_id") % 20 == 0, query_block=100).collect()))
    assert got == sorted(want) and len(got) > 4000


def test_topk_passes_follow_the_queries():
    assert [topk.passes_for(n)[1] for n in (0, 1, 16 * 2048, 16 * 2048 + 1, 10**8)] == [1, 1, 1, 2, 3052]


@pytest.mark.parametrize("seed", range(3))
def test_topk_multiplies_only_what_can_reach_the_cutoff(seed):
    rng = np.random.default_rng(seed)
    v = rng.integers(-20, 21, (3000, 16)) * rng.choice([1, 2, 40], (3000, 1), p=[0.6, 0.3, 0.1])
    q = v[rng.choice(3000, 50)]
    bound = topk.lower_bounds(q, v[:1000], 4, 21)
    query, vector, total, work = topk.reaching(q, bound, v, 4, 21)
    scores = q @ v.T
    assert (bound <= -np.sort(-scores, axis=1)[:, 20]).all() and (bound > 0).all()
    for i in range(50):
        order = sorted(range(3000), key=lambda j: (-scores[i, j], j))[:21]
        assert vector[query == i].tolist() == order and total[query == i].tolist() == scores[i, order].tolist()
    assert work < 0.7 * 50 * 3000


def test_topk_of_nothing(spark):
    assert topk.op3(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert topk.op3(spark.createDataFrame([(20, [1.0])], "vec_id long, embedding array<float>")).count() == 0


# -- 4 ----------------------------------------------------------------------------------------


def _targets(sizes):
    """By rounds: cap what is above, share the rest again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        share = (total - sum(capped.values())) / (sum(weight[s] for s in free) or 1)
        over = [s for s in free if share * weight[s] > 3 * sizes[s]]
        if not over:
            return capped | {s: share * weight[s] for s in free}
        capped |= {s: 3.0 * sizes[s] for s in over}


def test_mixing_on_odd_rows(odd, none):
    got = mixing.op4(odd).collect()
    assert len(got) == len(odd_rows())
    sizes = {}
    for _, text, _, source, _ in odd_rows():
        sizes[source] = sizes.get(source, 0) + len((text or "").encode().split())
    want = _targets(sizes)
    by_size = {}
    for s, n in sizes.items():
        by_size.setdefault(n, []).append(want[s])
    for r in got:
        assert any(r["target"] == pytest.approx(t) for t in by_size[r["source_size"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
    assert bag(got) == bag(mixing.op4(odd).collect())
    assert mixing.op4(none).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_taken_words_come_near_targets(spark, seed):
    rng = random.Random(seed)
    rows = [(i, " ".join(["w"] * rng.randrange(1, 60)), "en", rng.choice(["a", "a", "a", "b", "c", None]), 0) for i in range(600)]
    df = spark.createDataFrame(rows, DOCS)
    taken, target = {}, {}
    for r in mixing.op4(df).collect():
        taken[r["source_size"]] = taken.get(r["source_size"], 0) + r["taken"]
        target[r["source_size"]] = r["target"]
    assert sum(target.values()) == pytest.approx(sum(len(r[1].split()) for r in rows))
    assert all(abs(taken[k] - target[k]) <= 60 + 0.02 * target[k] for k in target)
    copies = mixing.mix(df).groupBy("doc_id").count().collect()
    assert max(r["count"] for r in copies) <= 3 and mixing.mix(df).columns == df.columns


# -- 5 and 8 ----------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(3))
def test_line_dedup_matches_brute_force(spark, seed):
    rng = random.Random(seed)
    passages = [[f"p{p} line {i}" for i in range(rng.randrange(4, 14))] for p in range(4)]
    rows = [(i, "\n".join(x for _ in range(rng.randrange(4)) for x in (rng.choice(passages) if rng.random() < 0.6 else [f"own {i} {rng.random()}" for _ in range(rng.randrange(6))]))) for i in range(60)]
    got = {r["doc_id"]: r.asDict() for r in lines.op5(frame(spark, rows)).collect()}
    want = {r["doc_id"]: r for r in brute.without_repeated_chunks(rows)}
    assert got == want and any(r["n_removed"] for r in want.values())


def test_line_boundaries_follow_content():
    own = [f"line {i}" for i in range(60)]
    cut = {tuple(own[a:b]) for a, b in lines.chunks("\n".join(own))}
    moved = ["new", *own]
    again = {tuple(moved[a:b]) for a, b in lines.chunks("\n".join(moved))}
    assert len(cut & again) >= len(cut) - 2


def test_short_passages_go_in_other_contexts(spark):
    rng = random.Random(11)
    rows, planted = [], 0
    for n in range(3, 9):
        for p in range(40):
            passage = [f"n{n} passage {p} line {i}" for i in range(n)]
            planted += n
            for _ in range(2):
                around = [[f"{len(rows)} {side} {i}" for i in range(rng.randrange(2, 9))] for side in ("before", "after")]
                rows.append((len(rows), "\n".join([*around[0], *passage, *around[1]])))
    got = {r["doc_id"]: r["n_removed"] for r in lines.op5(frame(spark, rows)).collect()}
    assert not any(got[i] for i in range(0, len(rows), 2))
    # counted from the passages, not from chunks(): lines before the first and behind the last boundary of a passage stay
    assert sum(got.values()) >= 0.6 * planted


def test_the_first_copy_of_a_line_stays(spark):
    rng = random.Random(5)
    rows = [(i, "\n".join(rng.choice("abcdefgh") for _ in range(rng.randrange(12)))) for i in range(60)] + [(99, "\n".join("z" * 9))]
    kept = {r["doc_id"]: r["kept"] for r in lines.dedup(frame(spark, rows)).collect()}
    seen = set()
    for i, text in rows:
        new = set(text.split("\n")) - seen
        assert new <= set(kept[i].split("\n"))
        seen |= new
    assert kept[99] in ("z", "z\nz") and sum(map(len, kept.values())) < sum(len(t) for _, t in rows)


def test_line_and_substring_dedup_on_odd_rows(odd, none):
    for op in (lines.op5, substrings.op8):
        assert op(odd).count() == len(odd_rows())
        assert op(none).count() == 0
    got = {(r["doc_id"], r["n_words"]): r["n_removed"] for r in substrings.op8(odd).collect()}
    assert got[1, 120] == 0 and got[2, 120] == 120 and got[3, 120] == 119 and got[4, 0] == 0
    assert got[7, 60_000] == 0 and got[8, 60_001] == 60_000
    # the row without id stands before all others; rows that are repeated keep what they share
    assert got[None, 64] == 0 and got[9, 62] == 60 and got[10, 60] == 60
    fifth = {r["doc_id"]: r["n_removed"] for r in lines.op5(odd).collect()}
    assert fifth[11] == 0 and fifth[4] == 0


def without_repeats(docs, window=20):
    """Substring dedup by a set of all word sequences (doc_ids unique)."""
    seen, out = set(), []
    for doc, text in sorted(docs, key=lambda x: x[0]):
        words = (text or "").encode().split()
        gone = set()
        for i in range(len(words) - window + 1):
            sequence = tuple(words[i : i + window])
            if sequence in seen:
                gone.update(range(i, i + window))
            seen.add(sequence)
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        out.append({"doc_id": doc, "n_words": len(words), "n_removed": len(gone), "kept_sha256": hashlib.sha256(kept).hexdigest()})
    return out


# windows with other words have equal hashes of 6 bits: only their words may decide
@pytest.mark.parametrize("cut", [{}, {"hash_bits": 6, "chunk_words": 100}, {"hash_bits": 6, "asked_words": 50}, {"hash_bits": 0, "chunk_words": 400}, {"chunk_words": 37, "asked_words": 20}])
@pytest.mark.parametrize("seed", range(2))
def test_substring_dedup_matches_brute_force(spark, seed, cut):
    rng = random.Random(seed)
    passages = [[f"p{p}w{i}" for i in range(rng.randrange(15, 70))] for p in range(5)]
    rows = []
    for i in range(80):
        words = []
        for _ in range(rng.randrange(4)):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            words += p[a:] if rng.random() < 0.5 else p
            words += [f"own{rng.randrange(50)}" for _ in range(rng.randrange(12))]
        rows.append((i, " ".join(words)))
    rows.append((100, " ".join(["again"] * 90)))
    found = substrings.dedup(frame(spark, rows), **cut).select("doc_id", "n_words", "n_removed", "kept_sha256")
    got = {r["doc_id"]: r.asDict() for r in found.collect()}
    want = {r["doc_id"]: r for r in without_repeats(rows)}
    assert got == want and sum(r["n_removed"] for r in want.values()) > 500


def test_substring_spans_are_maximal(spark):
    shared = " ".join(f"s{i}" for i in range(30))
    rows = [(1, "a b " + shared + " c"), (2, "d " + shared + " e f")]
    got = {r["doc_id"]: r for r in substrings.dedup(frame(spark, rows)).collect()}
    assert [tuple(s) for s in got[2]["spans"]] == [(1, 31)] and got[2]["kept"] == "d e f" and got[1]["spans"] == []


# -- 6 ----------------------------------------------------------------------------------------


def test_decontamination_on_odd_rows(odd, none, benchmark, benchmark_rows):
    got = decontamination.op6(odd, benchmark).collect()
    want = brute.hit_by_benchmark([r[:2] for r in odd_rows()], [r for r in benchmark_rows if r[0] is not None])
    # items without an id occur without being listed
    listed = {(r["doc_id"], r["n_words"]): (r["n_items"], r["items_sha256"]) for r in want}
    assert {(r["doc_id"], r["n_words"]): (r["n_items"], r["items_sha256"]) for r in got} == listed
    assert {r["doc_id"] for r in got if r["contaminated"]} == {1, 2, 3, 9, 10, 11, 12, 15, None}
    assert decontamination.op6(none, benchmark).count() == 0
    clean = decontamination.op6(odd, benchmark.limit(0)).collect()
    assert len(clean) == len(odd_rows()) and not any(r["contaminated"] for r in clean)


@pytest.mark.parametrize("seed", range(4))
def test_fm_index_matches_brute_force(spark, seed):
    rng = random.Random(seed)
    word = lambda n: " ".join(rng.choice(["a", "B", "c", "dé", "7"]) for _ in range(n))
    docs = [(i, word(rng.randrange(80))) for i in range(25)]
    items = [(i, word(rng.choice([1, 3, 9, 10, 12]))) for i in range(15)]
    df, bench = frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")
    want = {r["doc_id"]: r for r in brute.hit_by_benchmark(docs, items)}
    assert {r["doc_id"]: r.asDict() for r in decontamination.op6(df, bench).collect()} == want
    blocks = decontamination.occurrences(df, bench, block_words=20)  # several benchmark blocks
    for r in blocks.withColumn("n_hit", decontamination.n_hit()).collect():
        assert (r["n_words"], r["n_hit"], len(r["items"])) == tuple(want[r["doc_id"]][k] for k in ("n_words", "n_hit", "n_items"))


@pytest.mark.parametrize("block_words", [1, 7, 30])
def test_long_items_are_cut_without_losing_a_window(spark, block_words):
    rng = random.Random(block_words)
    items = [(i, " ".join(rng.choice("abcd") for _ in range(n))) for i, n in enumerate([0, 1, 9, 10, 11, 60, 25])]
    bench = spark.createDataFrame(items, "item_id long, text string").coalesce(1)
    found = list(decontamination.blocks(bench, 10, block_words))
    got = set()
    for w in found:
        back = {n: s.decode() for s, n in w.symbol.items()}
        for k, row in enumerate(w.patterns.tolist()):
            got |= {(i, " ".join(back[x] for x in row if x)) for i in w.items(np.array([k]))}
    words = {i: t.split() for i, t in items}
    want = {(str(i), " ".join(x[at : at + 10])) for i, x in words.items() for at in range(max(len(x) - 9, min(len(x), 1)))}
    assert got == want and (block_words > 7 or len(found) > 5)


def test_fm_index_counts_and_locates():
    rng = np.random.default_rng(1)
    text = rng.integers(1, 5, 300)
    index = decontamination.FMIndex(text, sample=5)
    patterns = rng.integers(1, 5, (40, 4))
    lengths = rng.integers(1, 5, 40)
    lo, hi = index.search(patterns, lengths)
    for p, n, a, b in zip(patterns, lengths, lo, hi, strict=True):
        want = [i for i in range(300 - n + 1) if (text[i : i + n] == p[4 - n :]).all()]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


# -- 7 ----------------------------------------------------------------------------------------


def test_classifier_on_odd_rows(odd, none, labels):
    got = quality.op7(odd, labels).collect()
    assert len(got) == len(odd_rows()) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str("" if r["doc_id"] is None else r["doc_id"]).encode()) % 5 == 0)
    assert quality.op7(none, labels).count() == 0
    assert {r["score"] for r in quality.op7(odd, labels.limit(0)).collect()} == {0.5}
    one = quality.op7(odd, labels.filter("quality = 1")).collect()
    assert all(r["predicted"] == 1 for r in one)


def test_hinge_model_matches_plain_descent():
    rng = np.random.default_rng(5)
    rows = [(np.sort(rng.choice(30, 6, replace=False)), rng.normal(size=6)) for _ in range(50)]
    sign = np.where(rng.random(50) < 0.5, 1.0, -1.0)
    weight, bias = quality.hinge_by_dual_descent(rows, sign, 30, rounds=3000)
    # the same problem as a dense matrix with a column of ones, by cyclic steps on the dual
    x = np.zeros((50, 31))
    x[:, 30] = 1
    for i, (at, value) in enumerate(rows):
        x[i, at] = value
    gram = (x * sign[:, None]) @ (x * sign[:, None]).T
    alpha = np.zeros(50)
    for _ in range(5000):
        for i in range(50):
            alpha[i] = min(max(alpha[i] - (gram[i] @ alpha - 1) / gram[i, i], 0), 1)
    best = (alpha * sign) @ x
    cost = lambda w: 0.5 * w @ w + np.maximum(0, 1 - sign * (x @ w)).sum()
    assert cost(np.append(weight, bias)) == pytest.approx(cost(best), rel=1e-3)


def test_scaled_indicators_are_log_count_ratios():
    texts, label = ["good Words 12", "good more", "bad words!!", "bad bad more"], np.array([1, 1, 0, 0])
    row, feature = quality.features(pa.array(texts))
    lists = [feature[row == i] for i in range(4)]
    model = quality.fit_rows(lists, label)
    counts = [{}, {}]
    for x, y in zip(lists, label, strict=True):
        for f in x.tolist():
            counts[y][f] = counts[y].get(f, 0) + 1
    total = [quality.DIM + sum(c.values()) for c in counts]
    for f in {f for x in lists for f in x.tolist()}:
        ratio = np.log((1 + counts[1].get(f, 0)) / total[1]) - np.log((1 + counts[0].get(f, 0)) / total[0])
        assert model.scale[f] == pytest.approx(ratio**2)
    scores = model.scores(row, feature, 4)
    assert scores[:2].min() > scores[2:].max()


def test_the_fit_holds_no_copies_of_its_features(spark, monkeypatch):
    rng = np.random.default_rng(5)
    label = rng.integers(0, 2, 2500)
    rows = [np.unique(rng.integers(0, 2048 + 1024 * y, 1000)).astype(np.int32) for y in label]
    tracemalloc.start()
    quality.fit_rows(rows, label, 4096)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < sum(x.nbytes for x in rows)
    texts = [" ".join(f"w{(7 * i + k) % 89}" for k in range(20 + i)) for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    monkeypatch.setattr(quality, "fit_rows", lambda lists, label, *a: lists)
    given = quality.train(docs, marks)
    held = [r[0] for r in docs.filter(quality.held_out(F.col("doc_id"))).select("doc_id").collect()]
    want = [quality.features(pa.array([t]))[1].tolist() for i, t in enumerate(texts) if i not in held]
    assert sorted(x.tolist() for x in given) == sorted(want) and all(x.itemsize == 4 and not x.flags.owndata for x in given)


def test_classifier_on_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.op7(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    right = np.mean([r["predicted"] == r["quality"] for r in rows])
    assert len(rows) > 30 and right > 0.95


def test_classifier_never_sees_the_held_out_fold(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = quality.train(docs, labels), quality.train(docs, flipped)
    assert np.array_equal(one.weight, two.weight) and (one.bias, one.slope) == (two.bias, two.slope)


# -- 9 ----------------------------------------------------------------------------------------


def test_token_files_on_odd_rows(spark, odd, none):
    rows = odd_rows()
    library = token_output.encoder(token_output.default_tokenizer()).library
    want, start = [], 0
    for doc, text in sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert bag(token_output.op9(odd).collect()) == bag(want)
    assert token_output.op9(none).count() == 0


@pytest.mark.parametrize("text", ["", " ", "  a", "a  b", "a\n b", "a \n b", "\n\n  x", "don't 's 'S", "x<|endoftext|>y", "é b", "日本 語", "a1b2 3c", "tab\there", "\x7f ctrl", "end ", "… – “q”"])
def test_chunked_encoding_is_the_library_s(text):
    e = token_output.encoder(token_output.default_tokenizer())
    ids, n = e.encode(pa.array([text, "between", text, None]))
    one, other = (e.library.encode(t, add_special_tokens=False).ids for t in (text, "between"))
    assert ids.tolist() == [*one, *other, *one] and n.tolist() == [len(one), len(other), len(one), 0]


@pytest.mark.parametrize("memo", [0, 20, 200_000])
def test_chunked_encoding_of_random_texts_is_the_library_s(memo, monkeypatch):
    monkeypatch.setattr(token_output, "MEMO", memo)
    rng, e = random.Random(memo), token_output.Encoder(token_output.default_tokenizer())
    parts = [" ", " ", " ", "  ", "\n", "\t", "\u00a0", "\u2028", "\u200b", "\x1c", "a", "Zé", "the", "ñoño", "ǆ", "ß", "日本", "ـ", "'s", "'", "'re", ".", ",", "###", "…", "12", "²", "<|endoftext|>", "|>", "<|", "Ġ", "\x00", "👍", "e\u0301"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(20_000)]
    for _ in range(2):
        ids, n = e.encode(pa.array(texts))
        want = [x.ids for x in e.library.encode_batch(texts, add_special_tokens=False)]
        assert n.tolist() == [len(x) for x in want]
        assert ids.tolist() == [i for x in want for i in x]


def test_other_tokenizers_get_whole_texts(tmp_path):
    import json

    says = json.loads(token_output.encoder(token_output.default_tokenizer()).library.to_str())
    says["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "other.json").write_text(json.dumps(says))
    e = token_output.Encoder(str(tmp_path / "other.json"))
    assert not e.cuts
    texts = ["one two.", "", "a  b"]
    assert e.encode(pa.array(texts))[0].tolist() == [i for t in texts for i in e.library.encode(t, add_special_tokens=False).ids]


@pytest.mark.parametrize("width", range(1, 33))
def test_bits_round_trip(width):
    values = np.random.default_rng(width).integers(0, 1 << width, (3, 64), np.uint64).astype(np.uint32)
    raw = token_output.to_bits(values, width)
    assert raw.shape == (3, 8 * width) and (token_output.from_bits(raw, width) == values).all()
    assert "".join(f"{b:08b}" for b in raw[0].tolist()) == "".join(f"{v:0{width}b}" for v in values[0].tolist())


@pytest.mark.parametrize("n", [0, 1, 1023, 1024, 1025, 5000])
def test_packed_blocks_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.where(rng.random(n) < 0.03, rng.integers(0, 1 << 32, n, np.uint64), rng.integers(100, 300, n, np.uint64)).astype(np.uint32)
    half = n // 2
    file = token_output.Reader(token_output.pack(ids, [7, None], np.array([half, n - half])))
    assert (file.ids() == ids).all() and file.doc_ids == [7, None] and file.lengths.tolist() == [half, n - half]
    assert (file.ids(n // 3, n - n // 4) == ids[n // 3 : n - n // 4]).all()
    assert n < 1000 or len(file.packed) < 1.2 * n


def test_files_hold_the_stream_in_order(spark, tmp_path):
    docs = frame(spark, [(i, f"text {i}") for i in range(30)])
    manifest = token_output.write(docs, tmp_path.as_uri(), token_output.default_tokenizer(), file_ids=20)
    ids = []
    for r in manifest.orderBy("part", "seq").collect():
        file = token_output.Reader((tmp_path / r["name"]).read_bytes())
        ids += [(d, file.n_ids) for d in file.doc_ids]
    assert [d for d, _ in ids] == list(range(30))


# -- 10 ---------------------------------------------------------------------------------------


def _classes(rows):
    fps = [(i, brute.fingerprint(t)) for i, t in rows]
    label = list(range(len(fps)))
    for _ in range(len(fps)):
        for a in range(len(fps)):
            for b in range(len(fps)):
                if (fps[a][1] ^ fps[b][1]).bit_count() <= 2:
                    label[a] = label[b] = min(label[a], label[b])
    least = {}
    for (i, _), c in zip(fps, label, strict=True):
        if i is not None:
            least[c] = min(least.get(c, i), i)
    return sorted(((i, f"{fp:016x}", least.get(c)) for (i, fp), c in zip(fps, label, strict=True)), key=repr)


def test_simhash_on_odd_rows(odd, none):
    assert bag(simhash.op10(odd).collect()) == _classes([r[:2] for r in odd_rows()])
    assert simhash.op10(none).count() == 0


def _balls(n, seed):
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(6)]
    out = set()
    while len(out) < n:
        x = rng.choice(centres) if rng.random() < 0.7 else rng.getrandbits(64)
        for _ in range(rng.randrange(4)):
            x ^= 1 << rng.randrange(64)
        out.add(x)
    return sorted(out)


@pytest.mark.parametrize(("n", "leaf"), [(1, 8), (60, 8), (400, 16), (400, 2000)])
def test_trie_finds_every_link(spark, n, leaf):
    values = _balls(n, n + leaf)
    signed = [x - (1 << 64) if x >> 63 else x for x in values]
    distinct = spark.createDataFrame([(x,) for x in signed], "fp long")
    got = {r["node"]: r["root"] for r in components.components(simhash.links(distinct, 2, leaf)).collect()}
    parent = list(range(n))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(n):
        for b in range(a):
            if (values[a] ^ values[b]).bit_count() <= 2:
                parent[find(a)] = find(b)
    groups = {}
    for a in range(n):
        groups.setdefault(find(a), []).append(signed[a])
    want = {x: min(g) for g in groups.values() if len(g) > 1 for x in g}
    assert got == want


def test_components_of_paths_stars_and_cycles(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 201), (201, 202), (202, 200)] + [(5, 5)]
    rng.shuffle(edges)
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100), 200: 200, 201: 200, 202: 200}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_near_duplicates_keep_one(spark):
    rng = random.Random(2)
    base = [" ".join(f"d{k}w{rng.randrange(10**6)}" for _ in range(200)) for k in range(12)]
    rows = []
    for k, text in enumerate(base):
        rows.append((k * 10, text))
        words = text.split()
        for j in range(1, 4):  # at most three of 200 words differ: similarity of five-word shingles is 0.86 or more
            other = list(words)
            for at in rng.sample(range(5, 195), rng.randrange(4)):
                other[at] = f"new{rng.random()}"
            rows.append((k * 10 + j, " ".join(other)))
    kept = [r["doc_id"] for r in simhash.keep_first(frame(spark, rows)).collect()]
    assert sorted(kept) == [k * 10 for k in range(12)]


_grams, _jaccard = brute.grams, brute.jaccard


def test_texts_below_the_similarity_both_stay(spark):
    rng = random.Random(5)
    rows, bands = [], []
    for k in range(60):  # runs of new words: one text of every pair has a Jaccard similarity of 0.5 to 0.79 to the other
        words = [f"d{k}w{rng.randrange(10**6)}" for _ in range(200)]
        other, n = list(words), 20 + k
        while not 0.5 <= _jaccard(_grams(" ".join(words)), _grams(" ".join(other))) < 0.795:
            n -= 1
            other = [*words[: 100 - n // 2], *(f"new{rng.random()}" for _ in range(n)), *words[100 - n // 2 + n :]]
        bands.append(_jaccard(_grams(" ".join(words)), _grams(" ".join(other))))
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
    fps = [simhash.wide_fingerprint(t.encode().split(), 5) for _, t in rows]
    near = [(a[0] ^ b[0]).bit_count() + (a[1] ^ b[1]).bit_count() <= simhash.wide_budget(0.8) for a, b in zip(fps[::2], fps[1::2], strict=True)]
    assert sum(near) >= 10 and min(bands) < 0.6 and max(bands) > 0.7
    assert sorted(r["doc_id"] for r in simhash.keep_first(frame(spark, rows)).collect()) == list(range(120))


@pytest.mark.parametrize("block", [4, 16, 1000])
def test_classes_in_blocks_match_all_pairs(spark, block):
    rng = random.Random(7)
    texts, n = [], 90
    for k in range(n):  # chains and clusters around three bases, some at less than the similarity
        words = texts[rng.randrange(len(texts))].split() if k > 2 else [f"d{k}w{i}" for i in range(150)]
        for at in rng.sample(range(5, 145), rng.randrange(1, 7) if k > 2 else 0):
            words[at] = f"new{rng.random()}"
        texts.append(" ".join(words))
    sets, budget = [_grams(t) for t in texts], simhash.wide_budget(0.8)
    made = [(simhash.wide_fingerprint(t.encode().split(), 5), simhash.shingles(t.encode().split(), 5)[1].tolist()) for t in texts]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = [(k % 3 // 2, n, k, signed(hi), signed(lo), grams) for k, ((hi, lo), grams) in enumerate(made)]
    count = {c: sum(r[0] == c for r in rows) for c in (0, 1)}
    rows = [(r[0], count[r[0]], *r[2:]) for r in rows]
    label = list(range(n))
    for _ in range(n):
        before = list(label)
        for a in range(n):
            for b in range(a):
                (h, i), (j, k) = made[a][0], made[b][0]
                if rows[a][0] == rows[b][0] and (h ^ j).bit_count() + (i ^ k).bit_count() <= budget and _jaccard(sets[a], sets[b]) >= 0.8:
                    label[a] = label[b] = min(label[a], label[b])
        if label == before:
            break
    members = spark.createDataFrame(rows, "class long, n long, entry long, hi long, lo long, grams array<long>")
    got = {r["entry"]: r["root"] for r in simhash.similar_classes(members, budget, 0.8, block).collect()}
    assert got == dict(enumerate(label)) and 10 < len(set(label)) < 80


def _near_pairs(rng, n):
    """Pairs of texts with a Jaccard similarity of 0.8 to 0.9."""
    rows = []
    for k in range(n):
        words = [f"d{k}w{rng.randrange(10**6)}" for _ in range(200)]
        while True:
            other = list(words)
            for at in rng.sample(range(5, 195), rng.randrange(3, 6)):
                other[at] = f"new{rng.random()}"
            if 0.8 <= _jaccard(_grams(" ".join(words)), _grams(" ".join(other))) < 0.9:
                break
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
    return rows


def test_recall_of_near_copies(spark):
    rows = _near_pairs(random.Random(31), 400)
    kept = {r["doc_id"] for r in simhash.keep_first(frame(spark, rows)).collect()}
    assert kept >= set(range(0, 800, 2))
    assert 800 - len(kept) >= 0.98 * 400


def test_heads_and_orders_grow_with_the_entries():
    found = [simhash.heads(n, 0.8) for n in (0, 1, 10**5, 10**7, 10**9, 3 * 10**10)]
    assert found == sorted(found) and found[0][0] == simhash.HEAD and found[-1][0] > 30
    for head, orders in found:  # a pair at the similarity asked for meets in some head
        assert (1 - (1 - simhash._angle(0.8)) ** head) ** orders <= simhash.MISSED


def test_nodes_of_a_large_group_are_parted(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(words)]
    for _ in range(300):
        other = list(words)
        for at in rng.sample(range(300), 3):
            other[at] = f"new{rng.random()}"
        texts.append(" ".join(other))
    texts += [t for _, t in _near_pairs(rng, 20)]
    wide = [simhash.wide_fingerprint(t.encode().split(), 5) for t in texts]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    entries = spark.createDataFrame([(k, signed(h), signed(x), k) for k, (h, x) in enumerate(wide)], "entry long, hi long, lo long, root long")
    found = []
    for most in (None, 30):
        edges = simhash.wide_links(entries, simhash.wide_budget(0.8), range(100), 16, most)
        found.append({r["node"]: r["root"] for r in components.components(edges).collect()})
    assert found[0] == found[1] and sum(r == 0 for r in found[0].values()) == 301
    parted = simhash._parted(simhash._dealt(entries, range(100), 16), 16, 30)
    assert parted.count() == 100 * len(texts) and max(r["count"] for r in parted.groupBy("node").count().collect()) <= 30


def _one_head(rng, n):
    """Fingerprints (hi, lo) that share the head of order 0 and differ in up to ten bits below it from each other's base."""
    below, base = simhash._order(0)[16:].tolist(), rng.getrandbits(128)
    out = []
    for _ in range(n):
        x = base
        for bit in rng.sample(below, 10):
            x ^= 1 << bit
        out.append((x & (2**64 - 1), x >> 64))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return [(signed(a), signed(b)) for a, b in out]


@pytest.mark.parametrize("joined", [0, 150])
def test_no_link_of_a_large_node_is_lost(spark, joined):
    rows = [(k, hi, lo, 0 if k < joined else k) for k, (hi, lo) in enumerate(_one_head(random.Random(12), 200))]
    rows += [(1000 + k, hi, lo, 1000 + k) for k, (hi, lo) in enumerate(_one_head(random.Random(13), 5))]
    entries = spark.createDataFrame(rows, "entry long, hi long, lo long, root long")
    for most in (None, 30):
        got = {r["node"]: r["root"] for r in components.components(simhash.wide_links(entries, simhash.wide_budget(0.8), range(1), 16, most)).collect()}
        assert got == {r[3]: min(x[3] for x in rows if (x[0] < 1000) == (r[0] < 1000)) for r in rows}
    met = simhash._met(simhash._dealt(entries, range(1), 16), 30)
    assert max(r["count"] for r in met.groupBy("node").count().collect()) < 60  # twice a block of about 15


def test_groups_with_large_nodes_are_whole(spark, monkeypatch):
    monkeypatch.setattr(simhash, "MOST", 30)
    rows = _one_head(random.Random(14), 120)
    monkeypatch.setattr(simhash, "heads", lambda n, similarity: (16, 1))
    distinct = spark.createDataFrame([(k, *x) for k, x in enumerate(rows)], "entry long, hi long, lo long")
    assert {r["root"] for r in simhash.wide_classes(distinct, simhash.wide_budget(0.8), 0.8).collect()} == {0}


def test_stars_take_no_rounds(spark, monkeypatch):
    made, stars = [], components._stars
    monkeypatch.setattr(components, "_stars", lambda *a: made.append(1) or stars(*a))
    edges = spark.createDataFrame([(i, 1) for i in range(2, 300)] + [(1000, 1001), (1001, 1000)], "u long, v long")
    got = {r["node"]: r["root"] for r in components.components(edges).collect()}
    assert got == {**dict.fromkeys(range(1, 300), 1), 1000: 1000, 1001: 1000} and not made
    path = spark.createDataFrame([(1, 2), (2, 3)], "u long, v long")
    assert {r["root"] for r in components.components(path).collect()} == {1} and len(made) == 2


def test_rows_are_known_by_their_values(spark):
    rows = [(1, "a b", None), (1, "a b", "x"), (1, "a  b", "x"), (None, "=", "x"), (None, None, "x"), (2, "=", "x"), (2, "", "x"), (2, None, "x")]
    keyed = spark.createDataFrame(rows, "doc_id long, text string, lang string").select(common.digest("doc_id", "text").alias("k"))
    assert keyed.distinct().count() == 7


def test_counted_join_is_a_join(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_KEYS", 2)
    rows = spark.createDataFrame([(k, i) for k, n in ((1, 300), (2, 3), (3, 1)) for i in range(n)] + [(9, 0)], "k long, i long")
    counted = rows.filter("k < 9").groupBy("k").agg(F.count("*").alias("n"), F.max("i").alias("top"))
    assert bag(common.join_counted(rows, counted, "k", 305).select("k", "i", "n", "top").collect()) == bag(rows.join(counted, "k").select("k", "i", "n", "top").collect())


def test_large_nodes_and_small_nodes_agree():
    rng = np.random.default_rng(3)
    hi, lo = (rng.integers(0, 1 << 63, 40, np.uint64).repeat(10) ^ (np.uint64(1) << rng.integers(0, 64, 400, np.uint64)) for _ in range(2))
    found = []
    for small in (1000, 2):
        keep, simhash.SMALL_NODE = simhash.SMALL_NODE, small
        try:
            u, v = simhash._node_links(np.zeros(400, np.int64), hi, lo, np.arange(400), 8)
        finally:
            simhash.SMALL_NODE = keep
        found.append(sorted(zip(u.tolist(), v.tolist(), strict=True)))
    assert found[0] == found[1] and len(found[0]) >= 350
    joined = simhash._node_links(np.zeros(400, np.int64), hi, lo, np.arange(400) // 10, 8)
    assert len(joined[0]) == 0
