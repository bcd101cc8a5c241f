"""The pipeline against a brute-force version of its stages, and the queries with SQL against DuckDB."""

import os

import duckdb
import numpy as np
import public_tokenizers
import pytest
from frames import table
from test_scans import shingles
from test_simhash import fingerprint, roots

import corpus_pipeline
from pelagos.llm import quality_cnn, queries
from pelagos.llm.bpe import encoding

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("documents", "labels", "benchmark", "pages", "conversations"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_query(spark, duck, name):
    found = queries.QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    wanted = duck.sql(queries.ORACLE_SQL[name])
    assert sorted(wanted.columns) == columns
    assert table(found.select(*columns).collect()) == table(wanted.select(*(f'"{c}"' for c in columns)).fetchall())


def test_pipeline(spark, duck):
    got = {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, SF).collect()}
    docs = dict(duck.sql("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall())
    model = quality_cnn.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    keep = {i: t for i, t in docs.items() if quality_cnn.scores(model, [t.encode()])[0] >= 0.5}
    seen, unique = set(), {}
    for i, t in keep.items():
        if (key := " ".join(t.split(" "))) not in seen:
            seen.add(key)
            unique[i] = t
    prints = {i: fingerprint(t) for i, t in unique.items()}
    top = roots(sorted(set(prints.values())), lambda a, b: (a ^ b).bit_count() <= 4)
    least = {}
    for i, p in prints.items():
        least[top[p]] = min(i, least.get(top[p], i))
    unique = {i: t for i, t in unique.items() if least[top[prints[i]]] == i}
    items = [shingles(t, 5) for (t,) in duck.sql("SELECT text FROM benchmark").fetchall()]
    clean = {i: t for i, t in unique.items() if not any(q and len(q & shingles(t, 5)) >= 0.8 * len(q) - 1e-9 for q in items)}
    enc = encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    assert got == {i: len(enc.encode_ordinary(t)) for i, t in clean.items()}
    assert 0 < len(got) < len(docs)


def test_stages_take_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, SF)
        assert made.count() == 0
        docs = docs.sparkSession.createDataFrame([], docs.schema)


def test_scores_are_repeatable(spark):
    a, b = (np.array(sorted((r.doc_id, r.score) for r in queries.op4_quality_cnn(spark, SF).collect())) for _ in "ab")
    np.testing.assert_array_equal(a, b)
