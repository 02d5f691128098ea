"""The test corpus: pages with mentions made from orders, and stand-ins for the register's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.patterns import KEYWORD
from ..operators import pages as P
from ..operators import relational as R

# The number regex for the SQL engine of the check, which has no lookarounds: for text with doubled spaces, so that a bound that takes
# one space leaves one for the next number.
SQL_NUMBER = (
    r"(?:(?:(?:U\.?S\.?|EP|GB|JP)(?:  )?)?(?:(?i:Patents?|Pat(?:  |.)?)  )?(?:(?i:Numbers?|Nos?\.?)(?:  )?)?(?:D(?:  )?(?:#(?:  )?)?|(?:#(?:  )?)?\d[,.']?)"
    r"\d\d\d[,.']?\d\d\d(?:(?:[,.']|  )?[A-Z]\d?)?|(?:U\.?S\.?(?:  )?)?(?:(?i:Patents?|Pat(?:  |.)?)  )?(?:(?i:Numbers?|Nos?\.?)(?:  )?)?RE(?:  )?\d\d[,.']?"
    r"\d\d\d(?:(?:[,.']|  )?[A-Z]\d?)?|(?:JP(?:  )?)?(?:(?i:Patents?|Pat(?:  |.)?)  )?(?:(?i:Numbers?|Nos?\.?)(?:  )?)?(?:[HS](?:  )?)?(?:\d{7,8}|\d{10})(?:("
    r"?:  )?[A-Z]\d?)?)"
)
#: Group 1 is the number.
SQL_BOUNDED_NUMBER = f"(?:^|[ :])({SQL_NUMBER})(?:[,.';:()]?(?: |$))"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str, with_html: bool = False) -> DataFrame:
    """page_id, url, text: each page that orders mention, with their fragments in the order of their keys."""
    pages = table(spark, sf_dir, "pages")
    n = pages.agg(F.count("*")).scalar()
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    said = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    cases = (
        F.when(F.col("pid") % 5 == 1, said("misc ", c)).otherwise(said("U.S. Patent Nos. ", k + 1_000_000, ", D", c + 100_000, ".")),
        said("EP", k + 2_000_000, "; JP", k + 2_009_000_000, "A and RE", c + 40_000),
        said(k + 1_000_000),
        said("Nos.:6,839,", c % 900 + 100, "; 7,505,557;8,1"),
        said("pat. no. 5,", c % 900 + 100, ",123 (US RE44,701 E1) #1.234.567"),
        said("part 123456789 and US", k + 1_000_000),
    )
    fragment = cases[-1]
    for i, case in reversed(list(enumerate(cases[:-1]))):
        fragment = F.when(k % 6 == i, case).otherwise(fragment)
    orders = table(spark, sf_dir, "orders").withColumn("pid", c % (3 * n)).where((F.col("pid") < n) & (F.col("pid") % 5 != 0))
    joined = orders.select("pid", F.struct(k, fragment.alias("fragment")).alias("f")).groupBy("pid").agg(F.array_sort(F.collect_list("f")).alias("f"))
    out = pages.join(joined, pages["page_id"] == joined["pid"])
    text = F.concat(F.lit("intro "), F.array_join(F.transform("f", lambda x: x["fragment"]), " "))
    if with_html:
        text = F.concat(T.html_to_text(F.col("html")), F.lit(" "), text)
    return out.select("page_id", "url", text.alias("text"))


def mentions(spark: SparkSession, sf_dir: str, domain: Column | None = None) -> DataFrame:
    """One row for each mention: page_id, url, domain (the top private one by default), patent_number, patent_number_full."""
    hits = P.with_domain(P.extract(corpus(spark, sf_dir)), domain).select("page_id", "url", "domain", F.explode("numbers").alias("patent_number_full"))
    return hits.withColumn("patent_number", T.bare_number(F.col("patent_number_full")))


def register_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    publications = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("appln_id"), (F.col("o_orderkey") + 1_000_000).cast("string").alias("publn_nr"), F.when(F.col("o_orderstatus") != "P", "US").otherwise("EP").alias("publn_auth")
    )
    applicants = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("appln_id"), F.col("l_suppkey").alias("person_id"), F.col("l_linenumber").alias("applt_seq_nr"))
    persons = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("person_id"), F.col("s_name").alias("han_name"), F.when(F.col("s_acctbal") < 0, "INDIVIDUAL").otherwise("COMPANY").alias("sector"))
    return publications, applicants, persons


def registered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.register(*register_tables(spark, sf_dir))


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_clean(text: str) -> str:
    """White space of any kind as one space, in an engine whose \\s has ASCII only."""
    return rf"regexp_replace({text}, '[\s\x{{0B}}\x{{85}}\x{{A0}}\x{{1680}}\x{{180E}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+', ' ', 'g')"


def sql_html_text(html: str) -> str:
    for pattern, by in T.HTML_STEPS:
        html = f"regexp_replace({html}, {quoted(pattern)}, {quoted(by)}, 'g')"
    for entity, by in T.ENTITIES:
        html = f"replace({html}, {quoted(entity)}, {quoted(by)})"
    return f"trim({sql_clean(html)})"


def sql_words(text: str) -> str:
    squeezed = rf"regexp_replace(lower({text}), '[^\p{{L}}\p{{M}}\p{{Nl}}]+', ' ', 'g')"
    return f"CASE WHEN {squeezed} = ' ' THEN []::VARCHAR[] ELSE string_split(rtrim({squeezed}), ' ') END"


SQL_HOST = r"regexp_replace(regexp_replace(regexp_extract(url, '(?i)^\w+://([^/?#]*)', 1), '^.*@', ''), ':\d*$', '')"

#: Of the test pages' hosts, the top private domain is the last two labels.
SQL_DOMAIN = rf"lower(regexp_extract({SQL_HOST}, '([^.]+\.[^.]+)$', 1))"

#: Common table expressions for the oracles: corpus, kept (pages with keyword and number), mention, reg.
SQL = rf"""
nn AS (SELECT count(*) AS n FROM pages),
frag AS (
  SELECT o_custkey % (3 * n) AS pid, o_orderkey, CASE o_orderkey % 6
    WHEN 0 THEN CASE WHEN (o_custkey % (3 * n)) % 5 = 1 THEN 'misc ' || o_custkey ELSE 'U.S. Patent Nos. ' || (1000000 + o_orderkey) || ', D' || (100000 + o_custkey) || '.' END
    WHEN 1 THEN 'EP' || (2000000 + o_orderkey) || '; JP' || (2009000000 + o_orderkey) || 'A and RE' || (40000 + o_custkey)
    WHEN 2 THEN (1000000 + o_orderkey)::VARCHAR
    WHEN 3 THEN 'Nos.:6,839,' || (100 + o_custkey % 900) || '; 7,505,557;8,1'
    WHEN 4 THEN 'pat. no. 5,' || (100 + o_custkey % 900) || ',123 (US RE44,701 E1) #1.234.567'
    ELSE 'part 123456789 and US' || (1000000 + o_orderkey) END AS f
  FROM orders, nn WHERE o_custkey % (3 * n) < n AND (o_custkey % (3 * n)) % 5 <> 0),
corpus AS (SELECT page_id, url, html, 'intro ' || string_agg(f, ' ' ORDER BY o_orderkey) AS text FROM pages JOIN frag ON pid = page_id GROUP BY page_id, url, html),
found AS (
  SELECT page_id, url, text, list_transform(regexp_extract_all(replace(text, ' ', '  '), {quoted(SQL_BOUNDED_NUMBER)}, 1), lambda x: replace(x, '  ', ' ')) AS numbers
  FROM corpus WHERE regexp_matches(text, {quoted(KEYWORD)})),
kept AS (SELECT *, {SQL_HOST} AS host, {SQL_DOMAIN} AS domain FROM found WHERE len(numbers) > 0),
mention AS (
  SELECT page_id, url, host, domain, position, patent_number_full,
    regexp_replace(regexp_replace(regexp_replace(patent_number_full, '[ .,''#]', '', 'g'), '(?i)(Patents?|Pat)', '', 'g'), '(?i)(Numbers?|Nos?)', '', 'g') AS patent_number
  FROM (SELECT page_id, url, host, domain, unnest(numbers) AS patent_number_full, unnest(range(len(numbers))) AS position FROM kept)),
reg AS (
  SELECT (o_orderkey + 1000000)::VARCHAR AS publn_nr, s_suppkey AS person_id, s_name AS han_name
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey
  WHERE o_orderstatus <> 'P' AND NOT s_acctbal < 0 AND l_linenumber > 0
  QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_suppkey) = 1)
"""
