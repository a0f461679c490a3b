"""The stages on odd rows, and the whole pipeline against plain Python."""

import zlib

import numpy as np
import pytest

import corpus_pipeline
from cubeloom.llm import mixing, quality, tables, token_output

from . import brute

TABLES = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(tmp_path_factory, benchmark, labels):
    out = tmp_path_factory.mktemp("tables")
    for name, df in (("benchmark", benchmark), ("labels", labels)):
        df.write.parquet(str(out / f"{name}.parquet"))
    return str(out)


def test_stages_keep_columns_and_survive_odd_rows(spark, odd, none, folder, tmp_path):
    for docs, at in ((odd, "odd"), (none, "none")):
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            path = str(tmp_path / at / str(k))
            stage(spark, docs, folder).write.parquet(path)
            if k < len(corpus_pipeline.STAGES) - 1:
                back = spark.read.parquet(path)
                assert back.columns == odd.columns, name
                assert at == "none" or back.count() > 0
                docs = back if k < 2 else odd if at == "odd" else none


def test_whole_pipeline_matches_plain_python(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{TABLES}/documents.parquet").select("doc_id", "text", "source").collect()]
    # quality: the same model, scored in one process
    import pyarrow as pa

    model = quality.train(*[spark.read.parquet(f"{TABLES}/{t}.parquet") for t in ("documents", "labels")])
    scores = model.scores(*quality.features(pa.array([d[1] for d in docs])), len(docs))
    docs = sorted(d for d, s in zip(docs, scores, strict=True) if s >= quality.THRESHOLD)
    # near duplicates: all pairs
    sets = [brute.grams(d[1]) for d in docs]
    label = brute.joined(len(docs), lambda a, b: brute.jaccard(sets[a], sets[b]) >= 0.8)
    docs = [d for i, d in enumerate(docs) if label[i] == i]
    # benchmark windows
    items = [tuple(r) for r in spark.read.parquet(f"{TABLES}/benchmark.parquet").collect()]
    dirty = {r["doc_id"] for r in brute.hit_by_benchmark([d[:2] for d in docs], items) if r["contaminated"]}
    docs = [d for d in docs if d[0] not in dirty]
    # mixing: the SQL of its operator
    import duckdb
    import pandas as pd

    con = duckdb.connect()
    con.register("documents", pd.DataFrame(docs, columns=["doc_id", "text", "source"]))
    taken = {r[0]: r[4] // r[1] if r[1] else 0 for r in con.execute(mixing.ORACLE_SQL).fetchall()}
    library, start, want = token_output.encoder(token_output.default_tokenizer()).library, 0, []
    for doc, text, _ in docs:
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 2], "<u4")
        for _ in range(taken[doc]):
            want.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
            start += len(ids)
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, TABLES).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    assert got == sorted(want) and 0 < len(got)


def test_entry_lists_all(spark):
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))


@pytest.mark.parametrize("name", sorted(tables.oracle_sql()))
def test_queries_match_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '/root/testdata/sf0.01/{table}.parquet'")
    found = tables.queries()[name](spark, "/root/testdata/sf0.01")
    want = con.execute(tables.oracle_sql()[name])
    assert sorted(found.columns) == sorted(c[0] for c in want.description)
    got = sorted(tuple(r) for r in found.select(*[c[0] for c in want.description]).collect())
    assert got == sorted(want.fetchall()) and len(got) > 200
