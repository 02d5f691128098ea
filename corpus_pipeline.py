"""A corpus pipeline over ``documents``: quality classifier, language ID, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's docs. All
but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm import op2_ngram_jaccard as near
from quarryline.llm import op3_substring_dedup as passages
from quarryline.llm import op4_packing as packing
from quarryline.llm import op5_language_id as language
from quarryline.llm import op10_quality_classifier as quality
from quarryline.llm.scan import read_table, stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps.

    Texts without words, null ones included, have the least evidence and go, but where nothing can be learned, all others stay. Rows that
    repeat are judged alike and stay as often as they occur, also without doc_id. An empty table gives an empty result."""
    docs = docs.select(*COLUMNS)
    return quality.kept_documents(docs, quality.fit(docs, read_table(spark, sf_dir, "labels")))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was learned; those without a letter, or too far from all centroids, go.

    Null and empty texts have no letter. Rows that repeat are judged alike and stay as often as they occur, also without doc_id. An empty
    table, or one without a labelled row to learn from, gives an empty result."""
    docs = docs.select(*COLUMNS)
    model = language.fit(docs.where(~language.held_out()))
    rest = [F.col("text").alias("body"), *(F.col(c) for c in COLUMNS[2:])]
    return language.identify(docs, model, *rest).where("accepted").select("doc_id", F.col("body").alias("text"), *COLUMNS[2:])


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id; of rows that repeat a doc_id the least by text, lang,
    source and n_chars. Rows without doc_id stay, and texts without words are nobody's duplicates. An empty table gives an empty result."""
    docs = docs.select(*COLUMNS)
    gone = near.jaccard_components(docs).where("doc_id <> component_id").select("doc_id")
    left = docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)
    again = stored(docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    if again.isEmpty():
        return left
    one = left.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*COLUMNS[1:])).alias("r")).select("doc_id", "r.*")
    return left.join(again, "doc_id", "left_anti").select(*COLUMNS).union(one.select(*COLUMNS))


def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the words of passages that stand earlier; texts that lose none, null ones included, stay as they are, of the
    others the kept words are joined by one space and counted anew.

    Rows that repeat a doc_id with the same text are one document and get the same result; rows without doc_id stay as they are and
    count for no one. An empty table gives an empty result."""
    schema = docs.select(*COLUMNS).schema

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, sizes = batch.column(1).to_pylist(), batch.column(4).to_pylist()
            for i, parts in enumerate(batch.column(5).to_pylist()):
                if parts:
                    texts[i] = b" ".join(passages.kept_words((texts[i] or "").encode(), b"".join(parts))[2]).decode()
                    sizes[i] = len(texts[i])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), batch.column(2), batch.column(3), pa.array(sizes, pa.int64())], names=list(COLUMNS))

    return passages.with_spans(docs, *COLUMNS[1:]).mapInArrow(cut, schema)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences: at least one for each row, also for a null or empty text (its end sign), a repeated
    row or one without doc_id. An empty table gives no pieces."""
    return packing.pack_documents(docs)


STAGES = [("quality", quality_stage), ("language", language_stage), ("near_duplicates", near_duplicate_stage), ("passages", passage_stage), ("packing", packing_stage)]
#: The first stages are fitted models, which SQL doesn't express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
