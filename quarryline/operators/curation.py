"""Label import and curation of the set of labelled urls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.patterns import MARKING_TYPES, PAGE_TYPES
from .pages import numbered, with_domain


def parse_labels(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Labels from tab-separated lines (value), and the lines that are none.

    Columns 1 to 4 and 6 (from 0) are type, three flags and url; the type must be known, and type, first and third flag and url not
    be empty.
    """
    c = F.split("value", "\t", -1)
    flag = lambda i: F.when(F.get(c, F.lit(i)) == "1", True).when(F.get(c, F.lit(i)) == "0", False)
    ok = (F.size(c) >= 7) & F.get(c, F.lit(1)).isin(*PAGE_TYPES) & (F.trim(F.get(c, F.lit(6))) != "") & flag(2).isNotNull() & flag(4).isNotNull()
    ok = F.coalesce(ok, F.lit(False))
    good = lines.where(ok).select(F.get(c, F.lit(6)).alias("url"), F.get(c, F.lit(1)).alias("page_type"), flag(2).alias("patent_numbers_in_page"), flag(3).alias("true_patent_numbers"), flag(4).alias("page_about_patents"))
    return good, lines.where(~ok)


def label(page_type: Column) -> Column:
    """1.0 for the types of marking pages."""
    return F.when(page_type.isin(*MARKING_TYPES), 1.0).otherwise(0.0)


def proposed_urls(lines: DataFrame) -> DataFrame:
    """Distinct normalised urls of lines (value); what isn't a url is left out."""
    return lines.select(urls.normalized(F.trim("value")).alias("url")).where("url IS NOT NULL").distinct()


def duplicates(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n")).where("n > 1")


def new_urls(proposed: DataFrame, known: DataFrame) -> DataFrame:
    return proposed.select("url").subtract(known.select("url"))


def existing_urls(proposed: DataFrame, known: DataFrame) -> DataFrame:
    return proposed.select("url").intersect(known.select("url"))


def by_domain(proposed: DataFrame, known: DataFrame, domain: Column | None = None) -> DataFrame:
    """For each domain of either set: how many urls are in both, only known, only proposed."""
    p = proposed.select("url").distinct().withColumn("p", F.lit(1))
    k = known.select("url").distinct().withColumn("k", F.lit(1))
    both = with_domain(p.join(k, "url", "full"), domain)
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    out = both.groupBy("domain").agg(
        count(F.col("p").isNotNull() & F.col("k").isNotNull()).alias("in_both"), count(F.col("p").isNull()).alias("only_known"), count(F.col("k").isNull()).alias("only_proposed")
    )
    return out.withColumn("is_new", (F.col("in_both") == 0) & (F.col("only_known") == 0))


def balanced(rows: DataFrame, label_column: str, *order: str) -> DataFrame:
    """As many rows of each label as the rarest has, the first in the given order."""
    counts = rows.groupBy(label_column).count().agg(F.min("count").alias("_least"))
    return numbered(rows, "_nth", *order, by=(label_column,)).join(F.broadcast(counts), F.col("_nth") <= F.col("_least")).select(*rows.columns)
