"""Tokenizer alignment against whole texts through both libraries, pair by pair."""

import random

import pyarrow as pa
import pytest

from cubeloom.llm import alignment

from . import brute
from .conftest import odd_rows

A, B = alignment.default_tokenizers()
TRAPS = [
    None, "", " ", "  ", "\n", "word", " word", "word ", "word  ", "two  spaces", "a\n b", "a \nb", "tab\t x", "a  b", "a  b", "x▁y", "▁", "<|endoftext|> text <s> </s> <unk> <0x41>",
    "don't we'll I'M", "naïve 日本語 テキスト 🙂🙂 é", "a\x00b \x7f \x1c c", "​ z﻿ w", "1234567 89,10.5", "    indented\n        more\n", "end.\r\n\r\nnext", "it's   line", "🙂", "same same same", "same same same",
]


def bag(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def run(spark, docs, size=alignment.SLICE):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    return bag(alignment.op12(df).collect()) if size == alignment.SLICE else alignment.align(df, A, B, size).collect()


def test_traps(spark):
    docs = [(i, t) for i, t in enumerate(TRAPS)] + [(3, "word"), (None, "no id"), (3, "word")]
    assert run(spark, docs) == bag(brute.alignments(docs, A, B))


@pytest.mark.parametrize("seed", range(2))
def test_random_texts_in_small_slices(spark, seed):
    rng = random.Random(seed)
    parts = ["the", "quick", "Brown", "naïve", "日本", "🙂", "▁", "'s", "12", "\n", "\t", " ", "  ", "　", "-", "<s>", "ß", "aaaaaaa", "\r\n"]
    weights = [1 if p == "▁" else 20 for p in parts]
    docs = [(i, "".join(x for p in rng.choices(parts, weights, k=rng.randrange(1, 60)) for x in (p, rng.choice([" ", " ", ""])))) for i in range(120)]
    got = alignment.align(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), A, B, size=300)
    want = {r[0]: r[1:7] for r in brute.alignments(docs, A, B)}
    assert {r["doc_id"]: tuple(r)[1:7] for r in got.collect()} == want


def test_odd_rows(spark, odd, none):
    docs = [(r[0], r[1]) for r in odd_rows() if r[1] is None or len(r[1]) < 5000]
    short = odd.filter("text IS NULL OR length(text) < 5000")
    assert bag(alignment.op12(short).collect()) == bag(brute.alignments(docs, A, B))
    whole = alignment.op12(odd).collect()
    long = {r["doc_id"]: r for r in whole}
    assert len(whole) == len(odd_rows()) and long[7]["n_a"] == len(alignment.pair(A, B).a.encode(" " + odd_rows()[6][1], add_special_tokens=False).ids)
    assert alignment.op12(none).count() == 0


def test_segments_are_cut_where_nothing_merges():
    numbers, each, said = alignment.segments(pa.array(["a b  c\n d ", "", "b"], pa.large_string()))
    assert [said[i] for i in numbers] == ["a", "b", " c\n d", "", "b"] and each.tolist() == [4, 0, 1]
    numbers, each, said = alignment.segments(pa.array(["a b", "", "a b"], pa.large_string()), cut=False)
    assert [said[i] for i in numbers] == ["a b", "a b"] and each.tolist() == [1, 0, 1]
    assert alignment.pair(A, B).cuts()


def test_whole_texts_where_the_vocabulary_could_merge(spark, monkeypatch):
    monkeypatch.setattr(alignment.Pair, "cuts", lambda self: False)
    docs = [(i, t) for i, t in enumerate(TRAPS)]
    assert run(spark, docs) == bag(brute.alignments(docs, A, B))
