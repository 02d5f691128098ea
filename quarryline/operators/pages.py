"""Page pipeline: filters, the page feature table and its three relational outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions import urls
from ..functions.patterns import Patterns
from ..sources.files import stored


def valid_pages(records: DataFrame) -> DataFrame:
    """Records with a crawl date that are HTML by type or by name and no robots.txt."""
    html = (F.col("mime") == "text/html") | F.regexp_like("url", F.lit("html?$"))
    return records.where(F.col("crawl_date").isNotNull() & html & ~F.endswith("url", F.lit("robots.txt")))


def safely(condition: Column) -> Column:
    """A predicate whose null (from an input it can't judge) drops the row instead of failing the job."""
    return F.coalesce(condition, F.lit(False))


def extract(pages: DataFrame, patterns: Patterns | None = None) -> DataFrame:
    """Numbers of each page (url, text) that has the keyword and at least one number. The cheap test comes first."""
    p = patterns or Patterns()
    hits = pages.where(safely(F.regexp_like("text", F.lit(p.keyword)))).withColumn("numbers", T.numbers(F.col("text"), p.number))
    return hits.where(F.size("numbers") > 0)


def flagged(pages: DataFrame, patterns: Patterns | None = None) -> DataFrame:
    """All pages with ``has_keyword`` and ``has_number``, to be stored: scans of what is stored then leave out pages by a flag. What can't
    be judged has neither; flags of those names give way."""
    p = patterns or Patterns()
    return pages.withColumns({"has_keyword": safely(F.regexp_like("text", F.lit(p.keyword))), "has_number": safely(F.regexp_like("text", F.lit(p.number)))})


def lines(pages: DataFrame, patterns: Patterns | None = None) -> DataFrame:
    """One line ``url TAB number TAB number ...`` for each page."""
    return extract(pages, patterns).select(F.concat_ws("\t", F.col("url"), F.array_join("numbers", "\t")).alias("value"))


def filtered(pages: DataFrame, patterns: Patterns | None = None, more: Column | None = None) -> DataFrame:
    """Pages whose host isn't discarded and whose cleaned text has the keyword and a number; ``more`` is a predicate of the user."""
    p = patterns or Patterns()
    pages = pages.where(~urls.discarded(F.col("url"), p.discarded_hosts))
    clean = T.clean_spaces(F.col("text"))
    pages = pages.where(safely(F.regexp_like(clean, F.lit(p.keyword)))).where(safely(F.regexp_like(clean, F.lit(p.number))))
    return pages if more is None else pages.where(safely(more))


def _uncaptured(regex: str) -> str:
    """The regex with its plain groups made non-capturing."""
    out, i, in_class = [], 0, False
    while i < len(regex):
        c = regex[i]
        if c == "\\":
            out.append(regex[i : i + 2])
            i += 2
            continue
        in_class = (in_class or c == "[") and c != "]"
        out.append("(?:" if c == "(" and not in_class and regex[i + 1 : i + 2] != "?" else c)
        i += 1
    return "".join(out)


def match_map(column: Column, regexes: tuple[str, ...], context: int) -> Column:
    """Map from each regex to its matches with context; regexes without a match have an empty list, which one pass over the text tells."""
    found = [T.matches(column, _uncaptured(r), context) for r in regexes]
    none = F.array().cast("array<struct<text:string,context:string>>")
    lists = (F.when(F.regexp_like(column, F.lit(r)), m).otherwise(none) for r, m in zip(regexes, found, strict=True))
    return F.map_from_arrays(F.array(*(F.lit(r) for r in regexes)), F.array(*lists))


def with_domain(pages: DataFrame, domain: Column | None = None) -> DataFrame:
    """Pages (url) with their domain: by default the top private one of the host, empty without one."""
    return urls.with_top_private_domain(pages, urls.host(F.col("url"))) if domain is None else pages.withColumn("domain", domain)


def build(pages: DataFrame, patterns: Patterns | None = None, domain: Column | None = None) -> DataFrame:
    """The page table from (url, text): numbers and further matches with contexts, words, runs. Pages without numbers are left out.

    Other columns of ``pages`` stay. ``domain`` defaults to the top private domain.
    """
    p = patterns or Patterns()
    url = F.coalesce(urls.normalized(F.col("url")), F.col("url"))
    base = pages.where(~urls.discarded(F.col("url"), p.discarded_hosts)).withColumns({"url": url, "text": T.clean_spaces(F.col("text"))})
    hits = with_domain(extract(base, p).drop("numbers"), domain)
    w, tokens = T.words(F.col("text")), T.marked_tokens(F.col("text"), p.number)
    return hits.withColumns({
        "patent_numbers": T.matches(F.col("text"), p.number, p.context),
        "text_matches": match_map(F.col("text"), p.text_regexes, p.context),
        "url_matches": match_map(F.col("url"), p.url_regexes, p.context),
        "num_words": F.size(w), "distinct_words": F.array_distinct(w), "num_distinct_words": F.size(F.array_distinct(w)),
        "sequences": T.runs(tokens), "longest_sequence": T.longest_run(tokens),
    }).drop("text")


def page_rows(pages: DataFrame) -> DataFrame:
    """The relational page table: JSON columns, space-padded text columns, urls of at most 10,000 characters."""
    numbers = F.transform("patent_numbers", lambda m: m["text"])
    return pages.select(
        "page_id", F.left("url", F.lit(10_000)).alias("url"), "domain", F.size("patent_numbers").alias("num_patents"), F.to_json("patent_numbers").alias("patent_numbers_json"),
        T.padded(numbers).alias("patent_numbers_text"), F.to_json("text_matches").alias("text_matches_json"), F.to_json("url_matches").alias("url_matches_json"), "num_words",
        "num_distinct_words", T.padded(F.array_sort("distinct_words")).alias("distinct_words_text"), F.to_json("sequences").alias("sequences_json"), "longest_sequence",
    )


def patent_rows(pages: DataFrame) -> DataFrame:
    """One row for each mention, with the bare number."""
    mention = pages.select("page_id", "url", "domain", F.posexplode(F.transform("patent_numbers", lambda m: m["text"])).alias("position", "patent_number_full"))
    return mention.select("page_id", "url", "domain", "position", F.lit(False).alias("explicit_us"), T.bare_number(F.col("patent_number_full")).alias("patent_number"), "patent_number_full")


def regex_rows(pages: DataFrame) -> DataFrame:
    """One row for each page, field and regex, with the number of matches, also when there is none."""
    out = [pages.select("page_id", "url", "domain", F.lit(field).alias("field"), F.explode(f"{field}_matches").alias("regex", "found")) for field in ("text", "url")]
    return out[0].unionByName(out[1]).select("page_id", "url", "domain", "field", "regex", F.size("found").alias("num_matches"))


def regex_columns(rows: DataFrame, patterns: Patterns | None = None, first: int = 4) -> DataFrame:
    """Counts of the first regexes of each field as columns of one row for each page."""
    p = patterns or Patterns()
    hit = lambda field, regex: F.sum(F.when((F.col("field") == field) & (F.col("regex") == regex), F.col("num_matches")).otherwise(0))
    aggs = [hit("text", r).alias(f"text_vpm_r{i + 1}") for i, r in enumerate(p.text_regexes[:first])] + [hit("url", r).alias(f"url_vpm_r{i + 1}") for i, r in enumerate(p.url_regexes[:first])]
    return rows.groupBy("page_id").agg(*aggs)


def first_of_url(pages: DataFrame) -> DataFrame:
    """For each url the row with the smallest page_id (one without only if there is no other; of rows that repeat an id any). Rows of a
    url are summed up where they are."""
    row = F.struct(*(F.col(f"`{c}`") for c in pages.columns))
    return pages.groupBy("url").agg(F.min_by(row, F.struct(F.col("page_id").isNull(), F.col("page_id"))).alias("r")).select("r.*")


def every_nth(pages: DataFrame, n: int, *order: str) -> DataFrame:
    """The first row and every n-th one after it in the given order."""
    return numbered(pages, "_row", *order).where(F.col("_row") % n == 1 % n).drop("_row")


def numbered(rows: DataFrame, name: str, *order: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows with their number from 1 on in the given order, within each value of ``by`` if that is given.

    No value is brought to one task: rows are dealt out by ranges of the order and written to shared storage, as a sampled range may
    differ when it is computed again; each range is numbered by itself and begins after the rows of those before it.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("row")
    of = lambda *names: [F.col(f"row.`{c}`") for c in names]
    ranged = stored(rows.select(row).repartitionByRange(*of(*order)).withColumn("part", F.spark_partition_id()), "ranged")
    group = F.struct(*of(*by)) if by else F.lit(0)
    counts = ranged.groupBy("part", group.alias("group")).agg(F.count("*").alias("n"))
    # As many rows as there are ranges and values.
    before = Window.partitionBy("group").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("part").alias("at"), F.col("group").alias("of"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    own = ranged.withColumn("group", group).withColumn("nth", F.row_number().over(Window.partitionBy("part", "group").orderBy(*of(*order))))
    own = own.join(starts, (F.col("part") == F.col("at")) & F.col("group").eqNullSafe(F.col("of")))
    return own.select("row.*", (F.col("nth") + F.col("start")).alias(name))
