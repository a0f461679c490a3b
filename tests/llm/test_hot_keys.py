"""One key with half of all rows, and tasks that run twice."""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from cubeloom.llm import common, quality, substrings, token_output, warc

from .conftest import odd_rows


def test_a_file_is_replaced_by_a_second_attempt(tmp_path):
    folder = tmp_path.as_uri()
    common.put(folder, "x.bin", b"first attempt")
    common.put(folder, "x.bin", b"second")
    assert common.get(folder, "x.bin").to_pybytes() == b"second" and [p.name for p in tmp_path.iterdir()] == ["x.bin"]


def test_token_files_of_one_id(spark):
    docs = spark.range(2000).select(F.when(F.col("id") % 2 == 0, F.col("id")).alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 1500).alias("text"))
    same = spark.range(800).select(F.lit(7).cast("long").alias("doc_id"), F.lit("one text").alias("text"))
    folder = common.shared_dir(spark, "hot-tokens")
    manifest = token_output.write(docs.union(same), folder, token_output.default_tokenizer())
    most = manifest.groupBy("part").agg(F.sum("n_docs").alias("n")).agg(F.max("n"), F.sum("n"), F.count("n")).first()
    assert most[1] == 2800 and most[2] == 4 and most[0] < 0.4 * most[1]
    got = token_output.read(folder, manifest).collect()
    ordered = sorted(got, key=lambda r: r["start"])
    ids = [r["doc_id"] for r in ordered]
    assert ids == sorted(ids, key=lambda x: (x is not None, x)) and [r["start"] for r in ordered] == np.cumsum([0, *(r["n_tokens"] for r in ordered[:-1])]).tolist()


def test_revisits_of_one_payload(spark):
    big = "x" * 500
    pages = spark.range(400).select(F.col("id").alias("page_id"), F.concat(F.lit("http://a.example/"), F.col("id") % 3).alias("url"), F.when(F.col("id") % 2 == 1, big).otherwise(F.concat(F.lit(big), "id")).alias("html"))
    got = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in warc.op1(pages).collect()}
    assert len(got) == 400 and got[1] == ("response", None)
    assert all(got[i] == (("revisit", 1) if i % 2 and i > 1 else ("response", None)) for i in range(400))


def test_merge_ranges_follow_the_pages(spark):
    pages = spark.range(5000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://a.example/"), F.col("id") % 50).alias("url"))
    same = spark.range(3000).select(F.lit(1).cast("long").alias("page_id"), F.lit("http://a.example/1").alias("url"))
    cuts = warc.splitters(pages.union(same), 8000, 40)
    assert 20 <= len(cuts) <= 39 and cuts == sorted(set(cuts))
    assert len(warc.splitters(pages, 5000, 400)) > 300


def test_requests_to_one_chunk_are_many_tasks(spark):
    shared = " ".join(f"w{i}" for i in range(80))
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit(shared), F.concat(F.lit("own"), F.col("id"))).alias("text"))
    some = substrings.dedup(docs, chunk_words=200, asked_words=100).select("doc_id", "n_words", "n_removed").collect()
    assert {r["doc_id"]: r["n_removed"] for r in some} == {i: 80 if i else 0 for i in range(300)}


def test_repeated_rows_are_learned_from_once(spark, odd, labels):
    model = quality.train(odd, labels)
    many = quality.train(odd.union(odd.filter("doc_id = 7")).union(odd), labels)
    assert np.array_equal(model.weight, many.weight) and model.shift == many.shift


def test_the_fit_is_bounded_by_its_indicators(spark, monkeypatch):
    docs = [(i, " ".join(f"word{(i * 7 + k) % 97}" for k in range(30))) for i in range(200)]
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    given = []
    monkeypatch.setattr(quality, "fit_rows", lambda lists, label, *a: given.append((lists, label)) or None)
    quality.train(rows, marks)
    monkeypatch.setattr(quality, "MAX_FEATURES", sum(map(len, given[0][0])) // 2)
    quality.train(rows, marks)
    (every, _), (some, _) = given
    assert 0 < len(some) < len(every) and all(np.array_equal(a, b) for a, b in zip(some, every, strict=False))
    assert sum(map(len, some)) <= quality.MAX_FEATURES < sum(map(len, every[: len(some) + 1]))
