"""Registered queries of the page pipeline, the relational layer and curation, each with its SQL for the check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as C
from ..functions import text as T
from ..functions import urls
from ..operators import curation as K
from ..operators import pages as P
from ..operators import relational as R
from ..sources.files import read_ordered, shared_folder, write_ordered
from .corpus import SQL, SQL_DOMAIN, SQL_HOST, SQL_NUMBER, corpus, mentions, quoted, register_tables, registered, sql_html_text, sql_words, table
from .registry import query

WITH = "WITH " + SQL
#: The SQL of a corpus whose texts begin with what the pages show.
WITH_HTML = WITH.replace("'intro ' || string_agg", f"{sql_html_text('html')} || ' intro ' || string_agg")
#: Domains for the queries that need a list.
LISTED = ("Example.net", "EXAMPLE.COM", "example.edu")
SQL_LISTED = "(" + ", ".join(quoted(h.lower()) for h in LISTED) + ")"
SOME_HOSTS = C.Patterns(discarded_hosts=(*C.DISCARDED_HOSTS, r"(.+\.)?example\.org", r"blog\..+"))
SQL_SOME_HOSTS = quoted("^(?:" + "|".join(f"(?:{p})" for p in SOME_HOSTS.discarded_hosts) + ")$")
SQL_URL = r"regexp_matches(url, '(?i)^(https?|ftp|file)://')"


@query(WITH + "SELECT page_id, url, patent_number_full AS number FROM mention")
def extract_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.extract(corpus(spark, sf_dir)).select("page_id", "url", F.explode("numbers").alias("number"))


@query(WITH_HTML + "SELECT page_id, url, patent_number_full AS number FROM mention")
def extract_numbers_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers in what the pages show, before the text of the corpus."""
    return P.extract(corpus(spark, sf_dir, with_html=True)).select("page_id", "url", F.explode("numbers").alias("number"))


@query(WITH_HTML + f"SELECT page_id, domain, len(numbers)::INT AS num_patents, len({sql_words('text')})::INT AS num_words FROM kept")
def pages_table_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.page_rows(P.build(corpus(spark, sf_dir, with_html=True))).select("page_id", "domain", "num_patents", "num_words")


@query(WITH + "SELECT url || chr(9) || array_to_string(numbers, chr(9)) AS value FROM kept")
def extract_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.lines(corpus(spark, sf_dir))


@query(WITH + f"SELECT page_id, url FROM kept WHERE NOT regexp_matches(host, {SQL_SOME_HOSTS})")
def archive_filter_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.filtered(corpus(spark, sf_dir), SOME_HOSTS).select("page_id", "url")


@query(f"WITH t AS (SELECT page_id, {sql_html_text('html')} AS text FROM pages), w AS (SELECT page_id, text, {sql_words('text')} AS w FROM t) SELECT page_id, text, len(w)::INT AS num_words, len(list_distinct(w))::INT AS num_distinct_words FROM w")
def html_text_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "pages").select("page_id", T.html_to_text(F.col("html")).alias("text"))
    w = T.words(F.col("text"))
    return t.select("page_id", "text", F.size(w).alias("num_words"), F.size(F.array_distinct(w)).alias("num_distinct_words"))


@query(rf"""SELECT page_id, {SQL_HOST} AS host, lower(regexp_extract(url, '^(\w+)', 1)) || regexp_extract(url, '^\w+(://[^#]*)', 1) AS normalized,
  regexp_extract(url, '(?i)^\w+://[^/?#]*(.*)$', 1) AS path,
  lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_extract(url, '(?i)^\w+://[^/?#]*(.*)$', 1), '[^a-zA-Z]', ' ', 'g'), '([a-z])([A-Z])', '\1 \2', 'g'), ' +', ' ', 'g'))) AS words
  FROM pages WHERE {SQL_URL}""")
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    rows = table(spark, sf_dir, "pages").select("page_id", urls.host(u).alias("host"), urls.normalized(u).alias("normalized"), urls.path(u).alias("path"), F.array_join(urls.path_words(u), " ").alias("words"))
    return rows.where("host IS NOT NULL")


@query(f"SELECT page_id, url, coalesce(regexp_matches({SQL_HOST}, {SQL_SOME_HOSTS}), false) AS discarded FROM pages")
def discard_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", "url", urls.discarded(F.col("url"), SOME_HOSTS.discarded_hosts).alias("discarded"))


#: Endings of hosts for ``host_suffixes``, and the suffix rules that bear on them (exact, under a wildcard, excepted from one).
ENDINGS = ("com", "co.uk", "uk", "b.c.kobe.jp", "city.kobe.jp", "kobe.jp", "www.ck", "shop.ck", "ck", "gov.ck", "example", "blogspot.com", "k12.ma.us", "1")
SQL_RULES = "(VALUES " + ", ".join(f"({quoted(name)}, {quoted(mark)})" for name, mark in (
    ("com", "e"), ("uk", "e"), ("co.uk", "e"), ("jp", "e"), ("kobe.jp", "u"), ("city.kobe.jp", "x"), ("ck", "u"), ("www.ck", "x"), ("blogspot.com", "e"), ("us", "e"), ("ma.us", "e"), ("k12.ma.us", "e"))) + ") AS r(name, mark)"


@query(f"""WITH h AS (SELECT page_id, lower(split_part({SQL_HOST}, '.', 1)) || '.' || ending AS host FROM pages, (SELECT unnest({list(ENDINGS)}) AS ending)),
l AS (SELECT page_id, host, string_split(host, '.') AS l FROM h),
t AS (SELECT page_id, host, l, unnest(range(1, len(l) + 1)) AS k FROM l),
m AS (SELECT page_id, host, l, max_by(CASE mark WHEN 'e' THEN k + 1 WHEN 'u' THEN k + 2 ELSE k END, CASE mark WHEN 'e' THEN 2 * k WHEN 'u' THEN 2 * k + 2 WHEN 'x' THEN 2 * k + 1 END) AS n
  FROM t LEFT JOIN {SQL_RULES} ON r.name = array_to_string(l[len(l) - k + 1 :], '.') AND (mark <> 'u' OR k < len(l)) GROUP BY ALL)
SELECT page_id, host, CASE WHEN n <= len(l) THEN array_to_string(l[len(l) - n + 1 :], '.') ELSE '' END AS domain FROM m""")
def host_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top private domains below suffixes of several labels, wildcards and exceptions."""
    first = F.lower(F.element_at(F.split(urls.host(F.col("url")), r"\."), 1))
    hosts = table(spark, sf_dir, "pages").select("page_id", F.explode(F.array(*(F.concat(first, F.lit(f".{e}")) for e in ENDINGS))).alias("host"))
    return urls.with_top_private_domain(hosts, F.col("host"))


@query(f"SELECT page_id, {SQL_DOMAIN} AS domain FROM pages")
def top_private_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.with_domain(table(spark, sf_dir, "pages")).select("page_id", "domain")


def _built(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page features of the corpus; some pages also have phrases that the further regexes find."""
    more = F.when(F.col("page_id") % 7 == 0, F.lit(" Virtual Patent-Marking vpm 287 protected by our patents, additional patents are pending")).otherwise(F.lit(""))
    return P.build(corpus(spark, sf_dir).withColumn("text", F.concat("text", more)))


SQL_MORE = "CASE WHEN page_id % 7 = 0 THEN ' Virtual Patent-Marking vpm 287 protected by our patents, additional patents are pending' ELSE '' END"
#: Matches are separated by doubled spaces, so that a bound that takes one character leaves one for the next match.
WITH_MORE = WITH.replace("AS text FROM pages JOIN frag", f"|| {SQL_MORE} AS text FROM pages JOIN frag")


#: The parts of a text between its numbers and the numbers, in turns: numbers are the even ones. Marks stand around each number.
SQL_PARTS = rf""", parts AS (
  SELECT page_id, string_split_regex(replace(regexp_replace(replace(text, ' ', '  '), {quoted('(^|[ :])(' + SQL_NUMBER + ")([,.';:()]?(?: |$))")}, E'\\1\x01\\2\x01\\3', 'g'), '  ', ' '), E'\x01') AS p FROM kept),
hit AS (
  SELECT page_id, k AS position, p[2 * k + 2] AS text, right(array_to_string(p[1 : 2 * k + 1], ''), 10) || p[2 * k + 2] || left(array_to_string(p[2 * k + 3 :], ''), 10) AS context
  FROM (SELECT page_id, p, unnest(range((len(p) - 1) // 2)) AS k FROM parts))"""


@query(WITH_MORE + SQL_PARTS + " SELECT page_id, position::INT AS position, text, context FROM hit")
def page_matches_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _built(spark, sf_dir).select("page_id", F.posexplode("patent_numbers").alias("position", "m")).select("page_id", "position", "m.text", "m.context")


@query(WITH_MORE + SQL_PARTS + " SELECT page_id, position::INT AS position, right(array_to_string(p[1 : 2 * position + 1], ''), 4) || text || left(array_to_string(p[2 * position + 3 :], ''), 4) AS context FROM hit JOIN parts USING (page_id)")
def shorter_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contexts of ten characters cut down to four; at the ends of a text, where there are fewer, they are taken anew."""
    rows = page_matches_context(spark, sf_dir).select("page_id", "position", "text", "context")
    return rows.select("page_id", "position", T.cut_context(F.col("context"), F.col("text"), 10, 4).alias("context"))


@query(WITH_MORE + SQL_PARTS + """ SELECT page_id, count(*)::INT AS num_patents, '[' || string_agg('{"text":' || to_json(text) || ',"context":' || to_json(context) || '}', ',' ORDER BY position) || ']' AS patent_numbers_json FROM hit GROUP BY page_id""")
def page_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON column of the relational page table."""
    return P.page_rows(_built(spark, sf_dir)).select("page_id", "num_patents", "patent_numbers_json")


#: ``f``: a 1 for each number among the tokens of a page, a 0 for each other token.
SQL_FLAGS = rf""", t AS (
  SELECT page_id, regexp_replace(regexp_replace(regexp_replace(
    replace(regexp_replace(replace(text, ' ', '  '), {quoted('(^|[ :])' + SQL_NUMBER + "([,.';:()]?(?: |$))")}, '\1 {C.MARKER} \2', 'g'), '  ', ' '),
    '(?i)\b(patents?|US|U.?S.?)\b', ' ', 'g'), '[^\p{{L}}\p{{M}}\p{{Nl}}0-9]', ' ', 'g'), ' +', ' ', 'g') AS s FROM kept),
  f AS (SELECT page_id, array_to_string(list_transform(string_split(rtrim(s), ' '), lambda x: CASE WHEN x = '{C.MARKER}' THEN '1' ELSE '0' END), '') AS f FROM t)"""


@query(WITH + SQL_FLAGS + r""" SELECT page_id, coalesce(list_max(list_transform(regexp_extract_all(f, '1+'), lambda x: length(x))), 0)::INT AS longest, len(regexp_extract_all(f, '1+'))::INT AS n_runs FROM f""")
def page_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = P.extract(corpus(spark, sf_dir)).select("page_id", T.marked_tokens(F.col("text")).alias("tokens"))
    return t.select("page_id", T.longest_run(F.col("tokens")).alias("longest"), F.size(T.runs(F.col("tokens"))).alias("n_runs"))


@query(WITH + SQL_FLAGS + """, p AS (SELECT page_id, regexp_extract_all(f, '1+|0+') AS p FROM f),
i AS (SELECT page_id, p, unnest(range(1, len(p) + 1)) AS i FROM p),
s AS (SELECT page_id, coalesce(list_sum(list_transform(p[1 : i - 1], lambda x: length(x))), 0)::INT AS start, length(p[i])::INT AS length FROM i WHERE p[i] LIKE '1%')
SELECT page_id, start, start + length - 1 AS "end", length FROM s""")
def page_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where runs of numbers start and end among the tokens of a page."""
    rows = P.extract(corpus(spark, sf_dir)).select("page_id", F.explode(T.runs(T.marked_tokens(F.col("text")))).alias("r"))
    return rows.select("page_id", "r.*")


@query(WITH + "SELECT page_id, url, domain, position::INT AS position, false AS explicit_us, patent_number, patent_number_full FROM mention")
def page_patents(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The corpus has no urls with fragments that matter here: mentions keep the url as it is given.
    hits = P.with_domain(P.extract(corpus(spark, sf_dir))).select("page_id", "url", "domain", F.transform("numbers", lambda n: F.struct(n.alias("text"))).alias("patent_numbers"))
    return P.patent_rows(hits)


def _sql_count(column: str, regex: str) -> str:
    if "(?<!" in regex:  # no lookarounds there: bounds that take a character, over text with all characters apart
        return rf"len(regexp_extract_all(regexp_replace({column}, '([^0-9])', '\1\1', 'g'), '(?:^|[^0-9])287(?:[^0-9]|$)'))"
    return f"len(regexp_extract_all({column}, {quoted(regex)}))"


@query(WITH_MORE + "SELECT * FROM (" + " UNION ALL ".join(
    [f"SELECT page_id, 'text' AS field, {quoted(r)} AS regex, {_sql_count('text', r)}::INT AS num_matches FROM kept" for r in C.TEXT_REGEXES]
    + [f"SELECT page_id, 'url' AS field, {quoted(r)} AS regex, {_sql_count('url', r)}::INT AS num_matches FROM kept" for r in C.URL_REGEXES]) + ")")
def page_regexs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.regex_rows(_built(spark, sf_dir)).select("page_id", "field", "regex", "num_matches")


@query(WITH_MORE + "SELECT page_id, " + ", ".join(
    [f"{_sql_count('text', r)}::BIGINT AS text_vpm_r{i + 1}" for i, r in enumerate(C.TEXT_REGEXES[:4])] + [f"{_sql_count('url', r)}::BIGINT AS url_vpm_r{i + 1}" for i, r in enumerate(C.URL_REGEXES[:4])]) + " FROM kept")
def page_regexs_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.regex_columns(P.regex_rows(_built(spark, sf_dir)))


@query(WITH_MORE + f"""SELECT page_id, regexp_replace(url, '#.*$', '') AS url, domain, len(numbers)::INT AS num_patents, ' ' || array_to_string(numbers, ' ') || ' ' AS patent_numbers_text,
  len({sql_words('text')})::INT AS num_words, len(list_distinct({sql_words('text')}))::INT AS num_distinct_words,
  ' ' || array_to_string(list_sort(list_distinct({sql_words('text')})), ' ') || ' ' AS distinct_words_text FROM kept""")
def pages_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.page_rows(_built(spark, sf_dir)).select("page_id", "url", "domain", "num_patents", "patent_numbers_text", "num_words", "num_distinct_words", "distinct_words_text")


@query(WITH + "SELECT publn_nr, person_id, han_name FROM reg")
def register_one_person(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registered(spark, sf_dir)


@query(WITH + "SELECT domain, count(DISTINCT url) AS num_pages, count(*) AS num_patents_with_duplicates, count(DISTINCT patent_number) AS num_distinct_patents FROM mention GROUP BY domain")
def domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.domains(mentions(spark, sf_dir))


@query(WITH + "SELECT host AS domain, count(DISTINCT url) AS num_pages, count(*) AS num_patents_with_duplicates, count(DISTINCT patent_number) AS num_distinct_patents FROM mention GROUP BY host")
def domains_by_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for hosts: the domain is a parameter."""
    return R.domains(mentions(spark, sf_dir, urls.host(F.col("url"))))


NAMES = ", names AS (SELECT domain, han_name, count(DISTINCT patent_number) AS n FROM mention JOIN reg ON patent_number = publn_nr GROUP BY ALL)"


@query(WITH + NAMES + " SELECT * FROM names")
def domain_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.domain_names(mentions(spark, sf_dir), registered(spark, sf_dir))


STATS = NAMES + """, r AS (SELECT domain, n, row_number() OVER (PARTITION BY domain ORDER BY n DESC, han_name) AS k, sum(n) OVER (PARTITION BY domain) AS total FROM names),
st AS (SELECT domain, sum(n)::BIGINT AS num_distinct_matched_patents, count(*) AS num_distinct_han_names,
  """ + ", ".join(f"round(sum(CASE WHEN k <= {i} THEN n ELSE 0 END) / any_value(total), 9) AS share_top{i}" for i in range(1, 6)) + """,
  round(sum((n / total) * (n / total)), 9) AS han_names_herfindahl_index FROM r GROUP BY domain),
dm AS (SELECT domain, count(DISTINCT url) AS num_pages, count(DISTINCT patent_number) AS num_distinct_patents FROM mention GROUP BY domain)"""  # fmt: skip


def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mentions(spark, sf_dir)
    return R.domain_stats(R.domain_names(m, registered(spark, sf_dir)), R.domains(m))


@query(WITH + STATS + " SELECT st.*, num_distinct_patents, round(num_distinct_matched_patents / num_distinct_patents, 9) AS distinct_matched_patents_ratio FROM st LEFT JOIN dm USING (domain)")
def domain_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_stats(spark, sf_dir))


@query(WITH + STATS.replace("domain", "host") + " SELECT st.* RENAME (host AS domain) FROM st")
def domain_stats_by_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mentions(spark, sf_dir, urls.host(F.col("url")))
    return _rounded(R.domain_stats(R.domain_names(m, registered(spark, sf_dir))))


def _rounded(out: DataFrame) -> DataFrame:
    return out.select(*(F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes))


@query("SELECT min(page_id) AS page_id, regexp_replace(url, '#.*$', '') AS url FROM pages GROUP BY 2")
def dedup_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.first_of_url(table(spark, sf_dir, "pages").select("page_id", urls.normalized(F.col("url")).alias("url")))


def _listed(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(h,) for h in LISTED], "domain string")


@query(WITH + STATS + f" SELECT domain, num_pages, num_distinct_patents FROM dm WHERE lower(domain) IN {SQL_LISTED}")
def domains_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.in_list(R.domains(mentions(spark, sf_dir)), "domain", _listed(spark)).select("domain", "num_pages", "num_distinct_patents")


@query(WITH + f" SELECT page_id, url FROM kept WHERE lower(domain) IN {SQL_LISTED} AND url ILIKE '%EN%'")
def pages_semi_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = P.with_domain(P.extract(corpus(spark, sf_dir)))
    return R.in_list(hits, "domain", _listed(spark)).where(R.like("url", "%EN%")).select("page_id", "url")


@query(WITH + f" SELECT han_name, domain, count(*) AS n FROM mention JOIN reg ON patent_number = publn_nr WHERE lower(domain) IN {SQL_LISTED} GROUP BY ALL")
def names_by_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.names_by_domain(mentions(spark, sf_dir), registered(spark, sf_dir), _listed(spark))


@query(WITH + " SELECT patent_number, count(*) AS instances FROM mention GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def top_patents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.top(R.instances(mentions(spark, sf_dir)), 10, "instances", "patent_number")


@query(WITH + ", i AS (SELECT patent_number, count(*) AS n FROM mention GROUP BY 1) SELECT round(avg(n), 9) AS average, median(n)::DOUBLE AS middle FROM i")
def patent_instances_avg_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.instances(mentions(spark, sf_dir)).agg(F.round(F.avg("instances"), 9).alias("average"), F.median("instances").alias("middle"))


SQL_AUTHORS = "SELECT l_orderkey, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1"


def _authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return register_tables(spark, sf_dir)[1].groupBy("appln_id").agg(F.count_distinct("person_id").alias("n"))


@query(f"SELECT n, count(*) AS patents FROM ({SQL_AUTHORS}) GROUP BY n")
def author_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _authors(spark, sf_dir).groupBy("n").agg(F.count("*").alias("patents"))


@query(f"SELECT round((SELECT count(*) FROM ({SQL_AUTHORS}) WHERE n = 1) / (SELECT count(*) FROM ({SQL_AUTHORS})), 9) AS ratio")
def single_author_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _authors(spark, sf_dir).agg(F.round(F.avg(F.when(F.col("n") == 1, 1.0).otherwise(0.0)), 9).alias("ratio"))


SQL_HITS = "(" + " + ".join(_sql_count(c, r) for c, rs in (("text", C.TEXT_REGEXES[:4]), ("url", C.URL_REGEXES)) for r in rs) + ")"


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = _built(spark, sf_dir)
    counts = P.regex_columns(P.regex_rows(built))
    total = sum((F.col(c) for c in counts.columns[1:]), F.lit(0))
    return built.select("page_id", "domain").join(counts, "page_id").where(total > 0)


@query(WITH_MORE + f"SELECT count(*) AS pages, count(DISTINCT domain) AS domains FROM kept WHERE {SQL_HITS} > 0")
def vpm_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir).agg(F.count("*").alias("pages"), F.count_distinct("domain").alias("domains"))


@query(WITH_MORE + f"SELECT DISTINCT domain FROM kept WHERE {SQL_HITS} > 0")
def vpm_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir).select("domain").distinct()


@query(WITH + STATS.replace("domain", "host") + " SELECT host AS domain, num_distinct_patents FROM dm WHERE num_distinct_patents BETWEEN 25 AND 500 ORDER BY num_distinct_patents DESC, host LIMIT 10")
def domain_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.domains(mentions(spark, sf_dir, urls.host(F.col("url")))).where("num_distinct_patents BETWEEN 25 AND 500")
    return R.top(rows, 10, "num_distinct_patents", "domain").select("domain", "num_distinct_patents")


@query(WITH + STATS.replace("domain", "host") + " SELECT host AS domain, han_name, n, row_number() OVER (ORDER BY host, n DESC, han_name) AS position FROM names")
def ordered_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of all hosts in one order over many files, each row with its place in it as the files have it."""
    names = R.domain_names(mentions(spark, sf_dir, urls.host(F.col("url"))), registered(spark, sf_dir))
    path = f"{shared_folder(spark)}/ordered"
    write_ordered(names, path, F.col("domain"), F.desc("n"), F.col("han_name"))
    return read_ordered(spark, path)


@query(WITH + STATS + " SELECT domain, num_distinct_matched_patents FROM st WHERE domain LIKE '%example.com%' OR num_distinct_matched_patents > 30")
def domain_stats_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stats(spark, sf_dir).where(R.like("domain", "%example.com%") | (F.col("num_distinct_matched_patents") > 30)).select("domain", "num_distinct_matched_patents")


@query(WITH + " SELECT domain, han_name, n FROM (SELECT domain, han_name, count(DISTINCT patent_number) AS n FROM mention JOIN reg ON patent_number = publn_nr GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY domain ORDER BY n DESC, han_name) <= 3")
def top_names_of_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.window import Window

    names = R.domain_names(mentions(spark, sf_dir), registered(spark, sf_dir))
    nth = F.row_number().over(Window.partitionBy("domain").orderBy(F.desc("n"), "han_name"))
    return names.withColumn("nth", nth).where("nth <= 3").drop("nth")


@query(WITH + ", c AS (SELECT count(*) AS n FROM mention GROUP BY patent_number), h AS (SELECT n, count(*) AS \"values\" FROM c GROUP BY n) SELECT n, \"values\", (100 * n * \"values\") // (SELECT sum(n * \"values\")::BIGINT FROM h) AS percent FROM h")
def count_of_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.count_of_counts(mentions(spark, sf_dir), "patent_number")


@query(WITH + """, p AS (SELECT patent_number, patent_number_full, row_number() OVER (PARTITION BY domain ORDER BY patent_number_full) AS k, domain FROM mention)
SELECT domain AS pattern, count(*) AS n, string_agg('[' || patent_number_full || ']', chr(9) ORDER BY '[' || patent_number_full || ']') FILTER (WHERE k <= 10) AS items FROM p GROUP BY domain""")
def patterns_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.patterns_summary(mentions(spark, sf_dir), "domain", "patent_number_full")


def _url_sets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two overlapping sets of urls: proposed lines (some twice, some no urls) and what is known."""
    pages = table(spark, sf_dir, "pages")
    lines = pages.where("page_id % 3 <> 0").select(F.concat(F.lit("  "), "url").alias("value")).union(pages.where("page_id % 9 = 1").select(F.concat("url", F.lit("#part")))).union(pages.where("page_id % 50 = 0").select(F.lit("no url")))
    return K.proposed_urls(lines), pages.where("page_id % 2 = 0").select(urls.normalized(F.col("url")).alias("url")).distinct()


SETS = r"""WITH p AS (SELECT DISTINCT regexp_replace(url, '#.*$', '') AS url FROM pages WHERE page_id % 3 <> 0 OR page_id % 9 = 1),
k AS (SELECT DISTINCT regexp_replace(url, '#.*$', '') AS url FROM pages WHERE page_id % 2 = 0)"""


@query(SETS + " SELECT url FROM p EXCEPT SELECT url FROM k")
def curation_new_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.new_urls(*_url_sets(spark, sf_dir))


@query(SETS + " SELECT url FROM p INTERSECT SELECT url FROM k")
def curation_existing_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.existing_urls(*_url_sets(spark, sf_dir))


@query(SETS + f""", f AS (SELECT coalesce(p.url, k.url) AS url, p.url IS NOT NULL AS a, k.url IS NOT NULL AS b FROM p FULL JOIN k ON p.url = k.url),
g AS (SELECT {SQL_DOMAIN} AS domain, sum((a AND b)::INT)::BIGINT AS in_both, sum((NOT a)::INT)::BIGINT AS only_known, sum((NOT b)::INT)::BIGINT AS only_proposed FROM f GROUP BY 1)
SELECT *, in_both = 0 AND only_known = 0 AS is_new FROM g""")
def curation_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.by_domain(*_url_sets(spark, sf_dir))


@query(r"SELECT regexp_replace(url, '\d+', '') AS url, count(*) AS n FROM pages GROUP BY 1 HAVING count(*) > 1")
def curation_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.duplicates(table(spark, sf_dir, "pages").select(F.regexp_replace("url", r"^(\D*)\d+", "$1").alias("url")), "url")


@query(SETS + f" SELECT {SQL_DOMAIN} AS domain, url FROM p ORDER BY 1, 2")
def curation_urls_of_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The urls of each domain, a row each, as a domain may have any number."""
    p = _url_sets(spark, sf_dir)[0]
    return P.with_domain(p).select("domain", "url").orderBy("domain", "url")


def _label_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label lines made from labels; types by quality, some lines broken."""
    rows = table(spark, sf_dir, "labels").where("doc_id IS NOT NULL")
    kind = F.when(F.col("doc_id") % 11 == 0, "unknown").when(F.col("quality") == 1, "svpm").otherwise("other")
    url = F.when(F.col("doc_id") % 13 == 0, "").otherwise(F.concat(F.lit("http://h/"), "doc_id"))
    flag = F.when(F.col("toxic") == 1, "1").otherwise("0")
    return rows.select(F.concat_ws("\t", F.lit("x"), kind, flag, F.when(F.col("doc_id") % 3 == 0, "").otherwise(flag), flag, F.lit("y"), url, F.lit("z")).alias("value"))


SQL_LABELS = "SELECT doc_id, 'http://h/' || doc_id AS url, CASE WHEN quality = 1 THEN 'svpm' ELSE 'other' END AS page_type, toxic = 1 AS flag FROM labels WHERE doc_id IS NOT NULL AND doc_id % 11 <> 0 AND doc_id % 13 <> 0"


@query(f"SELECT url, page_type, flag AS patent_numbers_in_page, CASE WHEN doc_id % 3 <> 0 THEN flag END AS true_patent_numbers, flag AS page_about_patents, CASE WHEN page_type = 'svpm' THEN 1.0 ELSE 0.0 END::DOUBLE AS label FROM ({SQL_LABELS})")
def labels_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.parse_labels(_label_lines(spark, sf_dir))[0].withColumn("label", K.label(F.col("page_type")))


@query("SELECT count(*) AS n FROM labels WHERE doc_id % 11 = 0 OR doc_id % 13 = 0")
def labels_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.parse_labels(_label_lines(spark, sf_dir))[1].agg(F.count("*").alias("n"))


@query("SELECT page_id, url FROM pages QUALIFY (row_number() OVER (ORDER BY page_id) - 1) % 7 = 0")
def sample_every_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.every_nth(table(spark, sf_dir, "pages").select("page_id", "url"), 7, "page_id")


@query(r"SELECT page_id, replace(replace(replace(url, '§', '§§'), '\', '§\'), '/', '\') || '.html' AS filename, url AS again FROM pages")
def url_filename(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", urls.filename(F.col("url"), F.lit(False)).alias("filename"))
    return rows.withColumn("again", urls.url_of_filename(F.col("filename")))


@query("SELECT page_id, len(regexp_extract_all(t, '[\\p{L}\\p{N}]+(?:[''’-][\\p{L}\\p{N}]+)*|\\p{P}'))::INT AS tokens FROM (SELECT page_id, " + sql_html_text("html") + " AS t FROM pages)")
def token_counts_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.size(T.tokens(T.html_to_text(F.col("html")))).alias("tokens"))
