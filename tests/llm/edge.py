"""Small tables with the cases that every operator must take: nulls, empty and long texts, ties, repeated rows, clashing names."""

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, key string, part string, component_id string, text_ string"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("aeioulnrst") for _ in range(r.randint(1, 8))) for _ in range(n))


def texts() -> list:
    base, passage = prose(1, 120), prose(2, 40)
    out = [base, base, base + " tail", prose(3, 200) + " " + passage, passage + " " + prose(4, 50), None, "", "   \n\t ", "one two", "one two", "Ünï cödé ▁ \U0001f600 中文 x",
           "word " * 300, "a b " * 40, base.upper(), "line one here\nline one here\nline two\n" * 5, "%%% ### " * 30, "x" * 5000, prose(5, 6000), passage, "tab\tand\nnew  double", "<|endoftext|> a<|startoftext|>b"]
    return out + [prose(9, 100) + f" edit{i} " + prose(10, 100) for i in range(8)]


def rows() -> list[tuple]:
    found = [(i * 3, t, "en" if i % 2 else "fr", f"s{i % 2}", None if t is None else len(t)) for i, t in enumerate(texts())]
    found.append(found[0])  # a repeated row
    found.append((1000, prose(7, 30), None, None, None))
    return [(*r, 7, "k", "p", "c", "t") for r in found]


def table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def no_id(spark: SparkSession) -> DataFrame:
    return table(spark).union(spark.createDataFrame([(None, prose(1, 120), None, None, None, 7, "k", "p", "c", "t")], SCHEMA))


def all_null(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(None,) * 10] * 3, SCHEMA)
