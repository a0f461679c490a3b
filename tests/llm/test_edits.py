"""Edit fingerprints against walks made step by step, and the search against all pairs."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cubeloom.llm import edits

from .conftest import odd_rows


def step_by_step(text):
    """The same fingerprint by a pointer that looks at every step, and every sample by all earlier steps."""
    moves = (edits._mixed(np.arange(edits.WALKS * edits.CLASSES * edits.PERIOD, dtype=np.uint64)) >> np.uint64(63)).reshape(edits.WALKS, edits.CLASSES, edits.PERIOD)
    chain, bits = edits._priorities(), []
    for w in range(edits.WALKS):
        written, at = [], 0
        while at < len(text):
            point, step = ord(text[at]), len(written) % edits.PERIOD
            written.append(point)
            at += bool(moves[w, (point ^ point >> 7) % edits.CLASSES, step]) or step == edits.PERIOD - 1
        for i in range(w * edits.BITS // edits.WALKS, (w + 1) * edits.BITS // edits.WALKS):
            step = next((int(s) for s in chain[i] if s < len(written)), 0)
            point = written[step] if written else 0x110000
            mixed = edits._mixed(edits._mixed(np.array([point * edits.BITS + i], np.uint64)) ^ np.array([step], np.uint64))
            bits.append(int(mixed[0]) >> 63)
    return np.packbits(bits).tobytes()


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_same_as_step_by_step():
    rng = random.Random(1)
    texts = ["", "a", "日本語 🙂", "".join(rng.choice("abcdefg ") for _ in range(3000)), "x" * 500, *("".join(rng.choice("ab é") for _ in range(rng.randrange(60))) for _ in range(60))]
    got = edits.fingerprints(texts)
    assert [x.tobytes() for x in got] == [step_by_step(t) for t in texts]
    assert edits.fingerprints(texts[3:4])[0].tobytes() == got[3].tobytes()


def test_likeness_follows_edits():
    rng = random.Random(2)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9))) for _ in range(500)]
    make = lambda: " ".join(rng.choice(words) for _ in range(400))
    found = {0.0: [], 0.01: [], 0.05: [], 1.0: []}
    for _ in range(20):
        text = make()
        for share, seen in found.items():
            other = list(text)
            for _ in range(int(share * len(text)) if share < 1 else 0):
                at = rng.randrange(len(other))
                rng.choice([lambda: other.pop(at), lambda: other.insert(at, "z"), lambda: other.__setitem__(at, "q")])()
            a, b = edits.fingerprints([text, make() if share == 1 else "".join(other)])
            seen.append(float(edits.likeness(a[None], b[None])[0]))
    means = [float(np.mean(x)) for x in found.values()]
    assert means[0] == 1.0 and means[0] > means[1] > means[2] > means[3] and means[1] > 0.6 and means[3] < 0.2


def test_edit_distance():
    rng = random.Random(3)
    for _ in range(200):
        a, b = ("".join(rng.choice("abé") for _ in range(rng.randrange(30))) for _ in range(2))
        assert edits.edit_distance(a, b) == plain_distance(a, b)


def by_hand(rows):
    order = sorted(rows, key=lambda r: -r[0])
    out = {}
    for (doc, text), (_, follows) in zip(order, order[1:] + order[:1], strict=True):
        text, follows = text or "", follows or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + follows[:third]
        a, b, c = edits.fingerprints([text, edited, follows])
        like = lambda x, y: max(0.0, 1 - 2 * (int.from_bytes(x.tobytes()) ^ int.from_bytes(y.tobytes())).bit_count() / edits.BITS)
        out[doc] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), a.tobytes().hex(), b.tobytes().hex(), like(a, b), like(a, c))
    return out


@pytest.mark.parametrize("parts", [1, 5])
def test_neighbours(spark, parts):
    rng = random.Random(parts)
    rows = [(i, None if i % 11 == 0 else "".join(rng.choice("abc dé🙂") for _ in range(rng.choice([0, 1, 2, 3, 50, 400])))) for i in rng.sample(range(1000), 90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    got = {r["doc_id"]: tuple(r)[1:] for r in edits.op11(docs).collect()}
    assert got == by_hand(rows)


def test_odd_rows(spark, odd, none):
    got = edits.op11(odd).collect()
    assert len(got) == len(odd_rows())
    by_text = {}
    for r in odd_rows():
        by_text.setdefault(r[1] or "", set()).update(x["fingerprint"] for x in got if x["doc_id"] == r[0] and x["n_chars"] == len(r[1] or ""))
    assert by_text[odd_rows()[0][1]] == {edits.fingerprints([odd_rows()[0][1]])[0].tobytes().hex()}
    assert edits.op11(none).count() == 0
    (one,) = edits.op11(odd.filter("doc_id = 11")).collect()
    assert one["near_next"] == 1.0
    long = next(r for r in got if r["doc_id"] == 7)
    assert long["n_chars"] == len(odd_rows()[6][1]) and 0.5 < long["near_edited"] < 0.9


def test_search_finds_near_texts(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9))) for _ in range(300)]
    texts = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(60)]
    for i in range(40):
        other = list(texts[i])
        for _ in range(rng.choice([0, 1, 3, 6])):
            other[rng.randrange(len(other))] = rng.choice("xyz")
        texts.append("".join(other))
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (500, None), (520, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {tuple(r) for r in edits.search(docs, F.col("doc_id") % 20 == 0).collect()}
    want = set()
    for q, a in rows:
        for d, b in rows:
            if None not in (q, d) and q % 20 == 0 and q != d:
                distance = edits.edit_distance(a or "", b or "")
                if distance <= int(0.2 * max(len(a or ""), len(b or "")) + 1e-9):
                    want.add((q, d, distance))
    assert got <= want and len(got) >= 0.9 * len(want) and len(want) >= 6
    assert edits.search(docs.limit(0), F.lit(True)).count() == 0


def test_search_of_a_large_group(spark):
    text = " ".join(f"w{i}" for i in range(200))
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit(text), F.when(F.col("id") % 2 == 0, F.lit("")).otherwise(F.col("id").cast("string"))).alias("text"))
    assert edits.search(docs, F.col("doc_id") % 20 == 0).count() == 20 * 399
