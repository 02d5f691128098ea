"""The stages on small tables, each held against what its operator says."""

import hashlib

import public_tokenizers

import corpus_pipeline
from quarryline.llm import op2_ngram_jaccard as op2
from quarryline.llm import op3_substring_dedup as op3
from quarryline.llm import op4_packing as op4
from quarryline.llm import op5_language_id as op5
from quarryline.llm import op10_quality_classifier as op10

from . import edge

SF = "/root/testdata/sf0.001"
WORDS = public_tokenizers.path("word_bpe_49k.json")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs.count()
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "language", "near_duplicates", "passages", "packing"]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        result = spark.read.parquet(str(tmp_path / name))
        if name == "near_duplicates":
            kept = {r.doc_id for r in result.collect()}
            assert kept == {r.doc_id for r in op2.jaccard_components(docs).where("doc_id = component_id").collect()}
        if name == "quality":
            judged = op10.classify(docs, op10.fit(docs, spark.read.parquet(f"{SF}/labels.parquet")), *op10.site_of())
            assert sorted(r.doc_id for r in result.collect()) == sorted(r.doc_id for r in judged.where("kept").collect())
        if name == "language":
            known = op5.identify(docs, op5.fit(docs.where(~op5.held_out())))
            assert sorted(r.doc_id for r in result.collect()) == sorted(r.doc_id for r in known.where("accepted").collect())
        if name == "packing":
            pieces = op4.pack(docs, WORDS)
            own = ("doc_id", "piece", "start", "length", "ids_crc32")
            assert sorted(map(tuple, result.select(*own).collect())) == sorted(map(tuple, pieces.select(*own).collect()))
            assert result.groupBy("sequence_id").agg({"length": "sum"}).agg({"sum(length)": "max"}).first()[0] <= op4.LENGTH
        if name == "passages":
            kept = {r.doc_id: (r.n_removed, r.kept_sha256) for r in op3.substring_dedup(docs).collect()}
            texts = {r.doc_id: r.text for r in docs.collect()}
            for r in result.collect():
                n, digest = kept[r.doc_id]
                assert r.text == texts[r.doc_id] if not n else hashlib.sha256(r.text.encode()).hexdigest() == digest
            assert result.count() == docs.count()
            assert all(r.n_chars == len(r.text) for r in result.collect())
        docs = result
    assert 0 < docs.select("doc_id").distinct().count() <= before


def test_stages_take_edge_cases(spark):
    for docs in (edge.table(spark), edge.empty(spark), edge.all_null(spark), edge.no_id(spark)):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs, SF).count() >= 0


def test_one_row_of_a_repeated_document_stays(spark):
    docs = edge.no_id(spark).select("doc_id", "text", "lang", "source", "n_chars")
    out = corpus_pipeline.near_duplicate_stage(spark, docs, SF).collect()
    ids = [r.doc_id for r in out if r.doc_id is not None]
    assert len(ids) == len(set(ids)) and sum(r.doc_id is None for r in out) == 1
    assert set(ids) == {r.doc_id for r in op2.jaccard_components(docs).where("doc_id = component_id").collect()}


def test_language_stage_keeps_prose(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.language_stage(spark, docs, SF)
    assert out.count() >= 0.99 * docs.count() and op5.fit(docs) is not None
