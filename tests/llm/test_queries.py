"""Registered queries against their SQL, and the pipeline against brute force, on the given tables."""

import os
import re
import zlib

import duckdb
import numpy as np
import pytest

from brindle.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in ("documents", "conversations", "benchmark"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, tables, name):
    want = tables.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())


def test_pipeline(spark, tables):
    """The stages' own decisions, taken again by SQL and plain Python."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    ids, docs = {}, spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = f"{corpus_pipeline.shared.shared_dir(spark)}/test-{corpus_pipeline.shared.token()}"
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        out.write.parquet(path)
        docs = spark.read.schema(docs.schema).parquet(path)
        ids[name] = sorted(r.doc_id for r in docs.select("doc_id").collect())
    sql = queries.oracle_sql()
    kept = sorted(r[0] for r in tables.sql(f"select doc_id from ({sql['op2_quality_rules']}) where kept").fetchall())
    assert ids["quality_rules"] == kept
    for before, name, query in (("quality_rules", "ngram_jaccard_join", "op5_jaccard_join"), ("ngram_jaccard_join", "benchmark_decontamination", "op10_decontaminate")):
        con = duckdb.connect()
        con.sql(f"create view benchmark as select * from '{SF}/benchmark.parquet'")
        con.execute(f"create table documents as select * from '{SF}/documents.parquet' where doc_id in (select unnest(?))", [ids[before]])
        rule = "component_id = doc_id" if "jaccard" in name else "not contaminated"
        assert ids[name] == sorted(r[0] for r in con.sql(f"select doc_id from ({sql[query]}) where {rule}").fetchall())
    assert set(ids["source_mixing"]) <= set(ids["benchmark_decontamination"])
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    texts = dict(tables.sql("select doc_id, text from documents").fetchall())
    total = sum(size(texts[d]) for d in ids["benchmark_decontamination"])
    assert abs(sum(size(texts[d]) for d in ids["source_mixing"]) / total - 1.5) < 0.25

    encoder, start, want = Tokenizer.from_file(public.path("byte_bpe_50k.json")), 0, []
    for d in ids["source_mixing"]:
        x = encoder.encode(texts[d] or "", add_special_tokens=False).ids + [0]
        want.append((d, start, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        start += len(x)
    got = corpus_pipeline.STAGES[-1][1](spark, docs, SF).orderBy("start").collect()
    assert [tuple(r) for r in got] == want


def test_pipeline_resumes(spark, monkeypatch):
    """A run in a folder of its own goes on behind the last stage that was written whole."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    pytest.importorskip("public_tokenizers")
    folder = f"{corpus_pipeline.shared.shared_dir(spark)}/test-{corpus_pipeline.shared.token()}"
    first = sorted(map(tuple, corpus_pipeline.run(spark, SF, folder).collect()))
    calls = []
    spied = [(name, (lambda f, name: lambda *a: calls.append(name) or f(*a))(f, name)) for name, f in corpus_pipeline.STAGES]
    monkeypatch.setattr(corpus_pipeline, "STAGES", spied)
    corpus_pipeline.shared.delete(spark, [f"{folder}/4-token_files"])
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF, folder).collect())) == first
    assert calls == ["token_files"]


def test_pipeline_clashing_columns(spark):
    """Stages give back all columns, whatever they are called, and leave other scratch tables alone."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    shared = corpus_pipeline.shared
    own = shared.materialise(spark.range(3), "own")
    names = ["n_words", "kept", "q_text", "contaminated", "items", "mix_id", "mix_times", "size", "component_id"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("*", *[f"{k} AS {c}" for k, c in enumerate(names)])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = shared.materialise(stage(spark, docs, SF), "stage")
        assert out.columns == docs.columns
        assert out.select(*names).distinct().collect() == [tuple(range(len(names)))]
        docs = out
    assert own.count() == 3
