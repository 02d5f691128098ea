"""Token counts through a digest cache.

The cache is a Parquet table (content digest, tokenizer version, number of tokens). Texts are looked up by the digest of their
normalised content (null as empty; the bytes are otherwise unchanged, as the tokenizer may tell any two texts apart) and by the digest
of the tokenizer's file. Only distinct texts that the cache lacks are encoded, each once; their counts are appended, and all rows get
their counts from the cache.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scan import cache, documents, read_table, record, shared_dir, slices, stored

#: More tokens than this are over the limit.
LIMIT = 4096
#: A text is dealt out by salt if more rows than this and more than this share of all have it.
SALTED, HOT_SHARE, SALT = 256, 2_000, 64
CACHE_SCHEMA = "digest binary, version string, n_tokens long"


def version(tokenizer: str) -> str:
    """Digest of the tokenizer's file."""
    with open(tokenizer, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def counter(tokenizer: str):
    """A function from texts to token counts, by the library for the file, kept for the worker's life."""
    kept = cache()
    if ("count", tokenizer) not in kept:
        if tokenizer.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=tokenizer)
            kept["count", tokenizer] = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        else:
            import os

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(tokenizer)
            model.no_truncation()
            model.no_padding()
            kept["count", tokenizer] = lambda texts: [len(x.ids) for x in model.encode_batch_fast(texts, add_special_tokens=False)]
    return kept["count", tokenizer]


def token_counts(docs: DataFrame, tokenizer: str, cache_path: str, limit: int = LIMIT) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, n_bytes, n_tokens, over_limit. Appends to the cache.

    A null text counts as empty (0 bytes, 0 tokens); repeated rows and equal texts get equal counts; a null doc_id passes through;
    an empty table gives an empty result and leaves the cache as it is. Other columns aren't read.
    """
    spark = docs.sparkSession
    ours = version(tokenizer)
    text = F.coalesce("text", F.lit(""))
    rows = documents(docs).select("doc_id", F.unhex(F.sha2(text, 256)).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"))
    rows = stored(rows, "digests")  # texts are read once for this and once for what is encoded
    try:
        known = spark.read.schema(CACHE_SCHEMA).parquet(cache_path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        known = spark.createDataFrame([], CACHE_SCHEMA)
    known = known.where(F.col("version") == ours)
    # One document of each text that the cache lacks; counts are summed up in each task before they are dealt out.
    seen = stored(rows.groupBy("digest").agg(F.min(F.coalesce("doc_id", F.lit(-(1 << 63)))).alias("doc"), F.count("*").alias("n")), "seen")
    misses = seen.drop("n").join(known, "digest", "left_anti")
    texts = documents(docs).select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc"), text.alias("text"))
    # A doc_id may stand for several texts, so the digest is compared too.
    texts = texts.withColumn("digest", F.unhex(F.sha2("text", 256))).join(misses, ["doc", "digest"]).select("digest", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, seen = counter(tokenizer), {}
        for batch in batches:
            for part, _ in slices(batch):
                new = dict(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True))
                new = {k: v for k, v in new.items() if k not in seen}  # a repeated row of one document
                seen.update(dict.fromkeys(new))
                if new:
                    yield record(digest=pa.array(list(new), pa.binary()), version=[ours] * len(new), n_tokens=pa.array(count(list(new.values())), pa.int64()))

    texts.mapInArrow(encode, CACHE_SCHEMA).write.mode("append").parquet(cache_path)
    counts = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("version") == ours).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    # Texts that many rows have, fewer than HOT_SHARE: their rows are dealt out by salt.
    least = max(SALTED, rows.count() // HOT_SHARE)
    hot = F.broadcast(seen.where(F.col("n") > least).select("digest", F.lit(True).alias("hot")))
    salted = rows.join(hot, "digest", "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id"), F.lit(SALT))).otherwise(0).cast("int"))
    counts = counts.join(hot, "digest", "left").withColumn("salt", F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALT - 1))).otherwise(F.array(F.lit(0))))).drop("hot")
    return salted.join(counts, ["digest", "salt"]).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), f"{shared_dir(spark)}/token_counts")
