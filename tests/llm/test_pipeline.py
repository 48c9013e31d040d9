"""Each stage of the pipeline on its own input against brute force."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from creditspark.llm import mixing, packing, quality
from tests.llm.test_documents import SCHEMA, _fingerprint, _rows, _text

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(r[0], 1, 0) for r in _rows() if r[0] is not None], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_and_columns(spark, docs, folder):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "mixing", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        assert stage(spark, docs.limit(0), folder).count() == 0


def test_quality_stage_drops_what_it_rejects(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = {r["doc_id"] for r in corpus_pipeline.quality_stage(spark, docs, SF).collect()}
    want = {r["doc_id"] for r in quality.score_quality(docs, labels).filter("predicted = 1").collect()}
    assert kept == want and 0 < len(kept) < docs.count()


def test_exact_stage(spark, docs, folder):
    best = {}
    for r in _rows():
        best[_text(r[1])] = max(best.get(_text(r[1]), -1), -1 if r[0] is None else r[0])
    got = Counter((_text(r["text"]), -1 if r["doc_id"] is None else r["doc_id"]) for r in corpus_pipeline.exact_stage(spark, docs, folder).collect())
    assert got == Counter(best.items())


def test_near_stage(spark, docs, folder):
    rows = [r for r in _rows() if r[0] is not None and r[0] != 16]
    prints = {r[0]: _fingerprint(_text(r[1])) for r in rows}
    of = {i: i for i in prints}
    for i in prints:
        for j in prints:
            if bin(prints[i] ^ prints[j]).count("1") <= 3:
                low, high = sorted((of[i], of[j]))
                of = {k: low if c == high else c for k, c in of.items()}
    chosen = docs.filter(F.col("doc_id").isNotNull() & (F.col("doc_id") != 16))
    got = [r["doc_id"] for r in corpus_pipeline.near_stage(spark, chosen, folder).collect()]
    assert sorted(got) == sorted(set(of.values()))


def test_mixing_and_packing_stages(spark, docs, folder):
    mixed = corpus_pipeline.mixing_stage(spark, docs, folder)
    want = Counter((r["doc_id"], r["text"]) for r in mixing.mix(docs, corpus_pipeline.MIX_WEIGHTS).collect())
    assert Counter((r["doc_id"], r["text"]) for r in mixed.collect()) == want
    packed = corpus_pipeline.packing_stage(spark, mixed, folder).collect()
    known = packing.word_ids(corpus_pipeline.tokenizer_path())
    pieces = sum(len(packing.cut(len(known.encode(_text(t))) // 2 + 1, 2048)) * n for (_, t), n in want.items())
    assert len(packed) == pieces


def test_run_joins_the_stages(spark):
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0
