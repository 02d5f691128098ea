"""Registered queries of the classifier, record mining, archives and streaming."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as C
from ..functions import text as T
from ..functions import urls
from ..operators import classifier as M
from ..operators import curation as K
from ..operators import mining
from ..operators import pages as P
from ..operators import relational as R
from ..sources import warc
from ..sources.files import cached, read_pages, shared_folder, stored, trimmed_csv, write_lines, write_pages
from ..streaming import extract as S
from .corpus import SQL_BOUNDED_NUMBER, corpus, mentions, quoted, registered, sql_words, table
from .queries import STATS, WITH, WITH_MORE, _built, _sql_count
from .registry import query


def _dataset(spark: SparkSession, sf_dir: str, how: str = "left") -> DataFrame:
    """The dataset of the classifier; the page table is written once, as all parts of it are read from there."""
    built = stored(_built(spark, sf_dir), "pages")
    rows = P.patent_rows(built)
    domains = R.domains(rows)
    return M.dataset(built, P.regex_columns(P.regex_rows(built)), domains, R.domain_stats(R.domain_names(rows, registered(spark, sf_dir)), domains), how)


def _with_labels(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    """Pages with the label of the document of the same id."""
    kind = F.when(F.col("quality") == 1, "svpm").otherwise("other")
    labels = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("page_id")).agg(F.max("quality").alias("quality")).select("page_id", kind.alias("page_type"))
    return rows.join(labels, "page_id").withColumn("label", K.label(F.col("page_type")))


SQL_DATA = f"""{STATS.replace("count(DISTINCT url)", "count(DISTINCT regexp_replace(url, '#.*$', ''))")}, words AS (SELECT page_id, url, domain, {sql_words('text')} AS w FROM kept),
lab AS (SELECT doc_id AS page_id, max(quality) AS q FROM labels GROUP BY 1)"""


@query(WITH_MORE + SQL_DATA + """ SELECT page_id, domain, len(w)::INT AS num_words, len(list_distinct(w))::INT AS num_distinct_words, num_pages, num_distinct_matched_patents, num_distinct_han_names,
  share_top1, han_names_herfindahl_index, CASE WHEN q = 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS label FROM words JOIN lab USING (page_id) JOIN dm USING (domain) JOIN st USING (domain)""")
def training_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    nine = [F.round(c, 9).alias(c) for c in ("share_top1", "han_names_herfindahl_index")]
    return _with_labels(spark, sf_dir, _dataset(spark, sf_dir, "inner")).select("page_id", "domain", "num_words", "num_distinct_words", "num_pages", "num_distinct_matched_patents", "num_distinct_han_names", *nine, "label")


@query("""WITH l AS (SELECT doc_id, quality, toxic FROM labels), m AS (SELECT min(n) AS n FROM (SELECT count(*) AS n FROM l GROUP BY quality))
SELECT doc_id, quality FROM l QUALIFY row_number() OVER (PARTITION BY quality ORDER BY doc_id) <= (SELECT n FROM m)""")
def balanced_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.balanced(table(spark, sf_dir, "labels").select("doc_id", "quality"), "quality", "doc_id")


@query("SELECT quality, count(*) AS n FROM labels GROUP BY 1")
def label_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.frequencies(table(spark, sf_dir, "labels"), "quality")


@query(WITH_MORE + SQL_DATA + f""" SELECT page_id, domain, coalesce(num_pages, 0) AS num_pages, coalesce(num_distinct_matched_patents, 0) AS num_distinct_matched_patents, coalesce(share_top1, 0.0) AS share_top1,
  {_sql_count('text', C.TEXT_REGEXES[0])}::BIGINT AS text_vpm_r1 FROM (SELECT kept.* FROM kept) LEFT JOIN dm USING (domain) LEFT JOIN st USING (domain)""")
def prediction_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dataset(spark, sf_dir).select("page_id", "domain", "num_pages", "num_distinct_matched_patents", F.round("share_top1", 9).alias("share_top1"), "text_vpm_r1")


def _marked(rows: DataFrame) -> DataFrame:
    """A dataset with labels by a rule over two features: pages with the first regex, and those of the domain with the fewest pages."""
    least = rows.agg(F.min("num_pages")).scalar()
    return rows.withColumn("label", F.when((F.col("text_vpm_r1") > 0) | (F.col("num_pages") == least), 1.0).otherwise(0.0))


def _models(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, list[M.Feature]]:
    """The dataset, balanced training rows with their vectors, and the features. The dataset is written once for training and prediction."""
    found, rows = M.features(), stored(_dataset(spark, sf_dir), "dataset")
    training = K.balanced(_marked(rows).where("num_distinct_han_names > 0"), "label", "page_id")
    return rows, M.assembled(training, found).select("features", "label"), found


#: A tree of depth 5 learns the rule without error, so the rule is what it predicts.
SQL_MARKED = WITH_MORE + SQL_DATA + f""", ds AS (SELECT page_id, regexp_replace(url, '#.*$', '') AS url, domain, {_sql_count('text', C.TEXT_REGEXES[0])}::DOUBLE AS r1, coalesce(num_pages, 0)::DOUBLE AS np FROM (SELECT kept.* FROM kept) LEFT JOIN dm USING (domain)),
marked AS (SELECT *, CASE WHEN r1 > 0 OR np = (SELECT min(np) FROM ds) THEN 1.0 ELSE 0.0 END::DOUBLE AS label FROM ds)"""


@query(SQL_MARKED + " SELECT page_id, url, label AS prediction FROM marked")
def predict_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, training, found = _models(spark, sf_dir)
    return M.predicted(M.tree(training), rows, found).select("page_id", "url", "prediction")


#: Least squares over two features, by Cramer's rule; weights are punished by their feature's variance over the label's deviation.
SQL_SOLVED = SQL_MARKED + """, s AS (SELECT avg(r1 * r1) + 0.001 / stddev_pop(label) * var_pop(r1) AS a, avg(r1 * np) AS b, avg(np * np) + 0.001 / stddev_pop(label) * var_pop(np) AS d, avg(r1 * label) AS e, avg(np * label) AS f FROM marked),
w AS (SELECT (e * d - b * f) / (a * d - b * b) AS w1, (a * f - b * e) / (a * d - b * b) AS w2 FROM s)"""


def _two_features(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, object, list[M.Feature]]:
    found = [f for f in M.features() if f.name in ("text_vpm_r1", "num_pages")]
    rows = stored(_dataset(spark, sf_dir), "dataset")
    return rows, M.regression(M.assembled(_marked(rows), found).select("features", "label")), found


@query(SQL_SOLVED + " SELECT page_id, url, round(w1 * r1 + w2 * np, 6) AS prediction FROM marked, w")
def regression_of_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linear regression over two features, which SQL can solve as well."""
    rows, model, found = _two_features(spark, sf_dir)
    return M.predicted(model, rows, found).select("page_id", "url", F.round("prediction", 6).alias("prediction"))


@query(SQL_SOLVED + " SELECT url, round(w1 * r1 + w2 * np, 6) AS score FROM marked, w")
def regression_of_two_as_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by the query that the model is written out as."""
    rows, model, found = _two_features(spark, sf_dir)
    rows.createOrReplaceTempView("ClassifierDataset")
    return spark.sql(M.regression_sql(model, found)).select("url", F.round("score", 6).alias("score"))


@query()
def predict_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, training, found = _models(spark, sf_dir)
    return M.predicted(M.regression(training), rows, found).select("page_id", "domain", "url", "prediction")


@query()
def prediction_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.prediction_lines(predict_regression(spark, sf_dir))


@query(SQL_MARKED + " SELECT url FROM marked WHERE label = 1")
def tree_rules_as_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urls that the tree's emitted SQL finds."""
    rows, training, found = _models(spark, sf_dir)
    rows.createOrReplaceTempView("ClassifierDataset")
    return spark.sql(M.tree_sql(M.tree(training), found))


@query()
def regression_as_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, training, found = _models(spark, sf_dir)
    rows.createOrReplaceTempView("ClassifierDataset")
    return spark.sql(M.regression_sql(M.regression(training), found))


@query()
def dom_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.candidates(mining.text_nodes(table(spark, sf_dir, "pages")))


@query()
def mdr_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.mine_pages(table(spark, sf_dir, "pages"))


@query()
def mdr_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.structure(mining.mine_pages(table(spark, sf_dir, "pages")))


#: Rows of a page of ``listing_records``.
LISTED_ROWS = 50


def _listings(spark: SparkSession, sf_dir: str, seed: str | None = None) -> DataFrame:
    """Records of two elements each, mined from listings that are written from the customers of a nation, below headings and text."""
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.floor(F.col("c_custkey") / LISTED_ROWS).alias("part"), "c_custkey", "c_name", "c_mktsegment")
    cells = F.concat(F.lit("<dt>"), "c_name", F.lit("</dt><dd><i>no "), "c_custkey", F.lit("</i><u>"), "c_mktsegment", F.lit("</u></dd>"))
    rows = c.groupBy("nation", "part").agg(F.array_sort(F.collect_list(F.struct("c_custkey", cells.alias("html")))).alias("rows")).where(F.size("rows") > 1)
    html = F.concat(F.lit("<html><body><h1>List</h1><p>of customers</p><dl>"), F.array_join(F.transform("rows", lambda r: r["html"]), ""), F.lit("</dl></body></html>"))
    mined = mining.mine_pages(rows.select((F.col("nation").cast("long") * 1_000_000_000 + F.col("part")).alias("page_id"), html.alias("html")), roots=1, seed=seed)
    found = mined.select("page_id", F.posexplode("records").alias("record", "r"))
    place = [F.floor(F.col("page_id") / 1_000_000_000).cast("int").alias("nation"), (F.col("page_id") % 1_000_000_000).alias("part")]
    return found.select(*place, F.col("record").cast("long").alias("record"), *(F.col("r")[f"/{t}/text"].alias(n) for t, n in (("dt", "name"), ("dd/i", "number"), ("dd/u", "segment"))))


SQL_LISTINGS = f"""SELECT c_nationkey AS nation, c_custkey // {LISTED_ROWS} AS part, row_number() OVER (PARTITION BY c_nationkey, c_custkey // {LISTED_ROWS} ORDER BY c_custkey) - 1 AS record, c_name AS name, 'no ' || c_custkey AS number,
  c_mktsegment AS segment FROM customer QUALIFY count(*) OVER (PARTITION BY c_nationkey, c_custkey // {LISTED_ROWS}) > 1"""


@query(SQL_LISTINGS)
def listing_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _listings(spark, sf_dir)


@query(SQL_LISTINGS)
def listing_by_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, cut by a record of another page."""
    return _listings(spark, sf_dir, "<dt>name</dt><dd><i>number</i><u>segment</u></dd>")


@query()
def mdr_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record as nested maps, in JSON, with and without levels of one child."""
    return mining.nested_records(mining.mine_pages(table(spark, sf_dir, "pages")))


def _archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages written as an archive and read again."""
    warc.register(spark)
    path = f"{shared_folder(spark)}/archive"
    pages = table(spark, sf_dir, "pages").select("url", F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8").alias("http_header"), F.col("html").cast("binary").alias("content"))
    pages.write.format("warc").mode("append").save(path)
    return spark.read.format("warc").load(path)


@query("SELECT url, html FROM pages")
def warc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.valid_pages(warc.responses(_archive(spark, sf_dir))).select("url", F.col("content").cast("string").alias("html"))


@query("SELECT url, html FROM pages")
def warc_by_spark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same archive, read by Spark's own readers only."""
    folder = _archive(spark, sf_dir).select("file").first()[0].rpartition("/")[0]
    return P.valid_pages(warc.responses(warc.records(spark, folder))).select("url", F.col("content").cast("string").alias("html"))


@query("SELECT url FROM pages WHERE lower(url) LIKE 'http%://m.%'")
def cdx_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures by the beginning of their urls, from an index sorted by key."""
    path = f"{shared_folder(spark)}/index"
    warc.write_index(warc.index_of(_archive(spark, sf_dir)), path)
    return warc.by_prefix(warc.read_index(spark, path), "http://m.").select("url")


@query("SELECT url, strlen(html)::INT AS size FROM pages")
def cdx_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url looked up in the index, and the capture read at its place."""
    archive = _archive(spark, sf_dir)
    wanted = table(spark, sf_dir, "pages").select(urls.url_key(F.col("url")).alias("url_key"), F.col("url").alias("wanted")).distinct()
    index = warc.index_of(archive).join(wanted, "url_key").where("url = wanted")
    return warc.content_of(index).select("url", F.octet_length("content").alias("size"))


def _cdx_lines(pages: DataFrame) -> DataFrame:
    """Lines of an index in which each page was captured three times, not always with success."""
    capture = F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k")
    rows = pages.select("url", "page_id", capture)
    status = F.when((F.col("page_id") + F.col("k")) % 3 == 0, 404).when((F.col("page_id") + F.col("k")) % 5 == 0, 301).otherwise(200).cast("string")
    parts = [urls.url_key(F.col("url")), F.format_string("2024%02d01000000", F.col("k") + 1), F.col("url"), F.lit("text/html"), status, F.lit("D"), F.lit("-"), F.lit("-"), F.lit("10"), (F.col("page_id") * 10 + F.col("k")).cast("string"), F.lit("f.warc.gz")]
    return rows.where("url NOT LIKE '% %'").select(F.concat_ws(" ", *parts).alias("value"))


@query("""WITH c AS (SELECT url, page_id, k, CASE WHEN (page_id + k) % 3 = 0 THEN 404 WHEN (page_id + k) % 5 = 0 THEN 301 ELSE 200 END AS status FROM pages, (SELECT unnest([0, 1, 2]) AS k) WHERE url NOT LIKE '% %')
SELECT url, printf('2024%02d01000000', k + 1) AS timestamp, page_id * 10 + k AS "offset" FROM c WHERE status = 200 QUALIFY row_number() OVER (PARTITION BY url ORDER BY k, page_id) = 1""")
def cdx_first_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first successful capture of every page, from an index in text lines."""
    path = f"{shared_folder(spark)}/lines"
    write_lines(_cdx_lines(table(spark, sf_dir, "pages")), path)
    return warc.first_captures(warc.cdx(spark, path), "url").select("url", "timestamp", "offset")


@query("SELECT url, CASE WHEN page_id % 4 = 0 THEN '%PDF' ELSE '' END || html AS content, page_id % 4 = 0 AS is_pdf FROM pages QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id) = 1 AND length(url) < 200")
def pages_as_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages exported as files that are named after their urls, read again; some begin like a PDF file and are named so."""
    pages = P.first_of_url(table(spark, sf_dir, "pages")).where("length(url) < 200")
    content = F.concat(F.when(F.col("page_id") % 4 == 0, "%PDF").otherwise(""), "html").cast("binary")
    path = f"{shared_folder(spark)}/pages"
    written = write_pages(pages.select("url", content.alias("content")), path)
    return read_pages(written.where("error IS NULL"), path).select("url", F.col("content").cast("string").alias("content"), F.endswith("name", F.lit(".pdf")).alias("is_pdf"))


@query(WITH + f" SELECT page_id, url, text, len(regexp_extract_all(replace(text, ' ', '  '), {quoted(SQL_BOUNDED_NUMBER)}, 1)) > 0 AS has_number FROM corpus WHERE regexp_matches(text, {quoted(C.KEYWORD)})")
def flagged_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages stored with flags, made once and read by their flag."""
    pages = cached(spark, f"{shared_folder(spark)}/flagged", lambda: P.flagged(corpus(spark, sf_dir)))
    return pages.where("has_keyword").select("page_id", "url", "text", "has_number")


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer")
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table written with spaces around its values, and read without them."""
    path = f"{shared_folder(spark)}/csv"
    padded = [F.concat(F.lit("  "), F.col(c).cast("string"), F.lit(" ")) for c in ("c_custkey", "c_name", "c_mktsegment")]
    write_lines(table(spark, sf_dir, "customer").select(F.concat_ws(";", *padded).alias("value")), path)
    return trimmed_csv(spark, path, "c_custkey long, c_name string, c_mktsegment string", ";")


@query(SQL_MARKED + " SELECT label::VARCHAR || chr(9) || domain || chr(9) || url AS value FROM marked")
def tree_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the tree predicts as lines of a file."""
    rows, training, found = _models(spark, sf_dir)
    path = f"{shared_folder(spark)}/predictions"
    write_lines(M.prediction_lines(M.predicted(M.tree(training), rows, found)), path)
    return spark.read.text(path)


_WORDS = "[" + ", ".join(f"'{w}'" for w in C.FEATURE_WORDS) + "]"


@query(SQL_MARKED + f""" SELECT page_id, len(list_intersect(list_distinct({sql_words('text')}), {_WORDS}))::DOUBLE AS page_words, (SELECT count(*) FROM (SELECT unnest({_WORDS}) AS w) WHERE contains(lower(k.url), w))::DOUBLE AS url_words
  FROM (SELECT page_id, text, regexp_replace(url, '#.*$', '') AS url FROM kept) k""")
def word_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many word features each page has, by its vector; words located in text columns, as the relational tables have them."""
    found = [f for f in M.features(located=True) if f.kind == "word"]
    rows = _built(spark, sf_dir).select("page_id", "url", T.padded(F.array_sort("distinct_words")).alias("distinct_words_text"))
    half = len(C.FEATURE_WORDS)
    total = lambda start: F.aggregate(F.slice("v", start, half), F.lit(0.0), lambda acc, x: acc + x)
    return M.assembled(rows, found).select("page_id", vector_to_array("features").alias("v")).select("page_id", total(1).alias("page_words"), total(half + 1).alias("url_words"))


@query(WITH + "SELECT page_id, url, patent_number_full AS number FROM mention")
def streaming_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions of the corpus, found by a stream over files that were written before."""
    base = shared_folder(spark)
    corpus(spark, sf_dir).write.parquet(f"{base}/in")
    S.run(S.mentions(S.pages(spark, f"{base}/in")), f"{base}/out", f"{base}/state").awaitTermination()
    return spark.read.schema("page_id long, url string, number string").parquet(f"{base}/out")


@query(WITH + " SELECT page_id, patent_number FROM mention WHERE patent_number NOT IN (SELECT publn_nr FROM reg)")
def unregistered_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions that aren't in the register: the rest of the left join."""
    m = mentions(spark, sf_dir)
    return m.join(registered(spark, sf_dir), m["patent_number"] == F.col("publn_nr"), "left_anti").select("page_id", "patent_number")
