"""Register, domain statistics and the analytic queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def register(publications: DataFrame, applicants: DataFrame, persons: DataFrame, office: str = "US") -> DataFrame:
    """One person for each publication of an office: the applicant first in sequence who isn't an individual.

    ``publications`` (appln_id, publn_nr, publn_auth), ``applicants`` (appln_id, person_id, applt_seq_nr), ``persons`` (person_id,
    han_name, sector).
    """
    people = persons.where("sector <> 'INDIVIDUAL'")
    rows = publications.where(F.col("publn_auth") == office).join(applicants.where("applt_seq_nr > 0"), "appln_id").join(people, "person_id")
    first = F.min_by(F.struct("person_id", "han_name"), F.struct("applt_seq_nr", "person_id"))
    return rows.groupBy("publn_nr").agg(first.alias("p")).select("publn_nr", "p.person_id", "p.han_name")


def domains(mentions: DataFrame) -> DataFrame:
    """Pages, mentions and distinct numbers of each domain. Both counts start from one exchange of the distinct (domain, url, number),
    so mentions are found once."""
    rows = mentions.groupBy("domain", "url", "patent_number").agg(F.count("*").alias("n"))
    count = lambda by, name: rows.groupBy("domain", by).agg(F.sum("n").alias("n")).groupBy("domain").agg(F.count(by).alias(name), F.sum("n").alias("n"))
    pages = count("url", "num_pages").withColumnRenamed("n", "num_patents_with_duplicates")
    return pages.join(count("patent_number", "num_distinct_patents").drop("n"), "domain")


def domain_names(mentions: DataFrame, registered: DataFrame) -> DataFrame:
    """Distinct matched numbers of each domain and name."""
    return mentions.join(registered, mentions["patent_number"] == registered["publn_nr"]).groupBy("domain", "han_name").agg(F.count_distinct("patent_number").alias("n"))


def domain_stats(names: DataFrame, domain_rows: DataFrame | None = None, top: int = 5) -> DataFrame:
    """Concentration of names in each domain: shares of the 1 to ``top`` largest, and the Herfindahl index.

    Sums are partial ones, and only the largest counts of a domain are ranked: a limit for each domain comes before the exchange, so a
    domain that most names are of isn't brought to one task.
    """
    first = Window.partitionBy("domain").orderBy(F.desc("n"), "han_name")
    sums = names.groupBy("domain").agg(F.sum("n").alias("num_distinct_matched_patents"), F.count("*").alias("num_distinct_han_names"), F.sum(F.col("n") * F.col("n")).alias("squares"))
    largest = names.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= top)
    largest = largest.groupBy("domain").agg(*(F.sum(F.when(F.col("rank") <= k, F.col("n")).otherwise(0)).alias(f"n_top{k}") for k in range(1, top + 1)))
    total = F.col("num_distinct_matched_patents")
    shares = [(F.col(f"n_top{k}") / total).alias(f"share_top{k}") for k in range(1, top + 1)]
    out = sums.join(largest, "domain").select("domain", total, "num_distinct_han_names", *shares, (F.col("squares") / (total * total)).alias("han_names_herfindahl_index"))
    if domain_rows is None:
        return out
    out = out.join(domain_rows.select("domain", "num_distinct_patents"), "domain", "left")
    return out.withColumn("distinct_matched_patents_ratio", F.col("num_distinct_matched_patents") / F.col("num_distinct_patents"))


def in_list(rows: DataFrame, column: str, names: DataFrame) -> DataFrame:
    """Rows whose value is in a list, whatever the case."""
    wanted = names.select(F.lower(names.columns[0]).alias("_name")).distinct()
    return rows.join(wanted, F.lower(rows[column]) == wanted["_name"], "left_semi")


def like(column: str, pattern: str) -> Column:
    """SQL LIKE as a database with a case-insensitive collation has it."""
    return F.col(column).ilike(pattern)


def top(rows: DataFrame, n: int, by: str, *ties: str) -> DataFrame:
    return rows.orderBy(F.desc(by), *ties).limit(n)


def instances(mentions: DataFrame) -> DataFrame:
    return mentions.groupBy("patent_number").agg(F.count("*").alias("instances"))


def names_by_domain(mentions: DataFrame, registered: DataFrame, wanted: DataFrame) -> DataFrame:
    """Mentions of each registered name in each of some domains."""
    rows = in_list(mentions, "domain", wanted).join(registered, mentions["patent_number"] == registered["publn_nr"], "left").where("han_name IS NOT NULL")
    return rows.groupBy("han_name", "domain").agg(F.count("*").alias("n"))


def frequencies(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n"))


def count_of_counts(rows: DataFrame, by: str) -> DataFrame:
    """How many values occur how often, and which part of all rows they make (whole percent)."""
    counts = frequencies(rows, by).groupBy("n").agg(F.count("*").alias("values"))
    total = counts.agg(F.sum(F.col("n") * F.col("values"))).scalar()
    return counts.select("n", "values", F.floor(100 * F.col("n") * F.col("values") / total).cast("long").alias("percent"))


def patterns_summary(rows: DataFrame, pattern: str, item: str, show: int = 10, salts: int = 64) -> DataFrame:
    """Each pattern with the number of its items and the first few of them.

    Equal items are counted first, and of each part of a pattern's items only the first few go on, so a pattern may have any number.
    """
    counted = rows.groupBy(pattern, item).agg(F.count("*").alias("_n"))
    salted = counted.withColumn("_salt", F.pmod(F.xxhash64(item), F.lit(salts)))
    first = Window.partitionBy(pattern, "_salt").orderBy(item)
    few = salted.withColumn("_nth", F.row_number().over(first)).groupBy(pattern, "_salt").agg(
        F.sum("_n").alias("_n"), F.flatten(F.collect_list(F.when(F.col("_nth") <= show, F.array_repeat(item, F.least("_n", F.lit(show)).cast("int"))))).alias("_few"))
    shown = F.slice(F.array_sort(F.flatten(F.collect_list("_few"))), 1, show)
    text = F.array_join(F.array_sort(F.transform(shown, lambda x: F.concat(F.lit("["), x, F.lit("]")))), "\t")
    return few.groupBy(F.col(pattern).alias("pattern")).agg(F.sum("_n").alias("n"), text.alias("items"))
