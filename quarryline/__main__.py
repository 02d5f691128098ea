"""Jobs on archives from the command line: ``python -m quarryline extract|filter|pages|export --in ARCHIVES --out FOLDER``."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .functions.patterns import DISCARDED_HOSTS, KEYWORD, NUMBER, Patterns
from .operators import pages as P
from .sources import files, warc


def responses(spark: SparkSession, path: str) -> DataFrame:
    return warc.responses(warc.register(spark).read.format("warc").load(path))


def texts(spark: SparkSession, path: str) -> DataFrame:
    """HTML pages of archives with their text."""
    return P.valid_pages(responses(spark, path)).withColumn("text", T.html_to_text(F.col("content").cast("string")))


def patterns(spark: SparkSession, args: argparse.Namespace) -> Patterns:
    hosts = files.host_patterns(spark, args.discarded) if args.discarded else DISCARDED_HOSTS
    return Patterns(keyword=args.keyword, number=args.number, discarded_hosts=hosts, context=args.context).plus(tuple(args.url_regex), tuple(args.text_regex))


def extract(spark: SparkSession, args: argparse.Namespace) -> None:
    """Lines of a url and its numbers."""
    files.write_lines(P.lines(texts(spark, args.source), patterns(spark, args)), args.out)


def keep(spark: SparkSession, args: argparse.Namespace) -> None:
    """Archives with the pages that pass the filters."""
    P.filtered(texts(spark, args.source), patterns(spark, args)).select("url", "http_header", "content").write.format("warc").mode("overwrite").save(args.out)


def pages(spark: SparkSession, args: argparse.Namespace) -> None:
    """The page table and its two detail tables, as Parquet folders under ``out`` or in a database."""
    found = patterns(spark, args)
    # Ids are given once, as the table is written.
    built = files.stored(P.build(texts(spark, args.source).select("url", "text"), found).withColumn("page_id", F.monotonically_increasing_id()), "pages")
    for name, rows in ((args.pages_table, P.page_rows(built)), (args.patents_table, P.patent_rows(built)), (args.regexs_table, P.regex_rows(built))):
        if args.db_url:
            files.to_database(rows, args.db_url, name, args.create_tables)
        else:
            rows.write.mode("overwrite").parquet(f"{args.out}/{name}")


def export(spark: SparkSession, args: argparse.Namespace) -> None:
    """The first and every n-th capture as a file of its own, in the order of the archives."""
    sample = P.every_nth(responses(spark, args.source).select("file", "offset", "within", "url", "content"), args.every, "file", "offset", "within")
    files.write_pages(sample, args.out).where("error IS NOT NULL").show(truncate=False)


JOBS = {"extract": extract, "filter": keep, "pages": pages, "export": export}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="quarryline", description=__doc__)
    out.add_argument("job", choices=JOBS, help="; ".join(f"{name}: {job.__doc__}" for name, job in JOBS.items()))
    out.add_argument("--in", dest="source", required=True, help="an archive, a folder or a glob")
    out.add_argument("--out", help="folder; what was there is replaced")
    out.add_argument("--master")
    out.add_argument("--keyword", default=KEYWORD)
    out.add_argument("--number", default=NUMBER)
    out.add_argument("--discarded", help="file with a host pattern on each line")
    out.add_argument("--text-regex", action="append", default=[])
    out.add_argument("--url-regex", action="append", default=[])
    out.add_argument("--context", type=int, default=10)
    out.add_argument("--every", type=int, default=1, help="export one capture in so many")
    out.add_argument("--db-url", help="JDBC url for the tables of pages")
    out.add_argument("--create-tables", action="store_true", help="replace tables of the database instead of adding rows")
    for name in ("pages", "patents", "regexs"):
        out.add_argument(f"--{name}-table", default="pages" if name == "pages" else f"page_{name}")
    for name in ("access-key", "secret-key", "endpoint"):
        out.add_argument(f"--s3-{name}")
    return out


def main(given: list[str] | None = None) -> None:
    args = parser().parse_args(given)
    if not args.out and not (args.job == "pages" and args.db_url):
        parser().error("--out is needed")
    spark = files.session("quarryline", args.master, {"access_key": args.s3_access_key, "secret_key": args.s3_secret_key, "endpoint": args.s3_endpoint})
    JOBS[args.job](spark, args)


if __name__ == "__main__":
    main()
