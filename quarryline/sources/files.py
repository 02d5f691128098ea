"""Sessions, text and table files, caching, databases and object stores."""

from __future__ import annotations

import contextlib
import os
import re
import tempfile
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyarrow.fs import FileSystem, LocalFileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import urls


def session(app: str, master: str | None = None, s3: dict[str, str] | None = None) -> SparkSession:
    """A session; ``s3`` has access_key, secret_key and, if wanted, endpoint."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC")
    if master:
        builder = builder.master(master)
    for name, value in s3_settings(**(s3 or {})).items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def s3_settings(access_key: str | None = None, secret_key: str | None = None, endpoint: str | None = None) -> dict[str, str]:
    """Hadoop settings for the s3a file system."""
    named = {"access.key": access_key, "secret.key": secret_key, "endpoint": endpoint}
    return {f"spark.hadoop.fs.s3a.{k}": v for k, v in named.items() if v}


def host_patterns(spark: SparkSession, path: str) -> tuple[str, ...]:
    """Trimmed lines of a small configuration file, each a host regex."""
    rows = spark.read.text(path).select(F.trim("value").alias("v")).where("v <> ''").distinct().orderBy("v").collect()
    return tuple(r["v"] for r in rows)


def trimmed_csv(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    return spark.read.schema(schema).csv(path, sep=sep, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)


def table_from_database(spark: SparkSession, url: str, table: str, fetch: int = 10_000, **options: str) -> DataFrame:
    """A database table, streamed in batches of rows; partition it by column, bounds and numPartitions in ``options``."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, fetchsize=str(fetch), **options).load()


def to_database(rows: DataFrame, url: str, table: str, create: bool = False, **options: str) -> None:
    """Rows added to a database table; with ``create`` a new table takes the place of an old one.

    The new table is written under another name and takes the old one's when all tasks have committed, so a job that fails leaves what
    was there. ``options``: of the connection (user, password, driver) and of Spark's writer.
    """
    if not create:
        rows.write.format("jdbc").options(url=url, dbtable=table, **options).mode("append").save()
        return
    jvm = rows.sparkSession._jvm
    known = jvm.java.util.Properties()
    for name in ("user", "password"):
        if name in options:
            known.setProperty(name, options[name])
    if "driver" in options:
        jvm.java.lang.Class.forName(options["driver"])
    new, old = (f"{table}_{mark}_{uuid.uuid4().hex[:8]}" for mark in ("new", "old"))
    rename = "RENAME TABLE {} TO {}" if url.startswith(("jdbc:derby", "jdbc:mysql", "jdbc:mariadb")) else "ALTER TABLE {} RENAME TO {}"

    def run(*statements: str) -> None:
        connection = jvm.java.sql.DriverManager.getConnection(url, known)
        try:
            for sql in statements:
                statement = connection.createStatement()
                statement.execute(sql)
                statement.close()
        finally:
            connection.close()

    def there() -> bool:
        try:
            run(f"SELECT 1 FROM {table} WHERE 1 = 0")
        except Py4JJavaError:
            return False
        return True

    try:
        rows.write.format("jdbc").options(url=url, dbtable=new, **options).mode("errorifexists").save()
    except Exception:
        with contextlib.suppress(Py4JJavaError):  # it may not have come to a table
            run(f"DROP TABLE {new}")
        raise
    if there():
        run(rename.format(table, old), rename.format(new, table), f"DROP TABLE {old}")
    else:
        run(rename.format(new, table))


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame], again: bool = False) -> DataFrame:
    """What is stored at a path, made and written first if there is nothing or ``again`` is set."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    if again or not there:
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, or the context's checkpoint folder. Where neither is set, as in tests, a folder of the
    machine is, if all of Spark runs there; else it's an error."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        top = found.get() if found.isDefined() else None
    if not top:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir isn't set: tasks need a folder that all of them share")
        top = tempfile.mkdtemp(prefix="quarryline-")
        spark.sparkContext.setCheckpointDir(top)
    return f"{top.rstrip('/')}/quarryline/{uuid.uuid4().hex}"


#: Stored bytes of input that one task works on, about, where work takes long for its bytes, and the most tasks.
SPREAD_BYTES, MOST_SPREAD = 16 << 20, 1 << 16


def spread_out(rows: DataFrame) -> DataFrame:
    """Rows over all cores and in parts of a bounded size, for work that takes long for its bytes: a task doesn't grow with the input,
    nor with the row groups of its files."""
    known = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    known = known if known < 1 << 58 else 0  # Spark takes what it doesn't know for endless
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, min(-(-known // SPREAD_BYTES), MOST_SPREAD))
    return rows.repartition(parts) if rows._jdf.rdd().getNumPartitions() < parts else rows


def write_ordered(rows: DataFrame, path: str, *order: Column) -> None:
    """Rows in one order over all files of a folder: each file is sorted, and stands after those with smaller numbers."""
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(path)


def read_ordered(spark: SparkSession, path: str, name: str = "position") -> DataFrame:
    """The rows of ``write_ordered`` with their places from 1 on, as the files have them."""
    part = F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).cast("long")
    rows = spark.read.parquet(path)
    placed = rows.select(F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("row"), part.alias("part"), F.col("_metadata.row_index").alias("nth"))
    counts = placed.groupBy(F.col("part").alias("at")).agg(F.count("*").alias("n"))
    before = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    starts = counts.select("at", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return placed.join(starts, F.col("part") == F.col("at")).select("row.*", (F.col("start") + F.col("nth") + 1).alias(name))


def stored(rows: DataFrame, name: str = "table") -> DataFrame:
    """Rows written to the shared folder and read again, so that several steps use them and each is computed once."""
    path = f"{shared_folder(rows.sparkSession)}/{name}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def write_lines(rows: DataFrame, path: str) -> None:
    """One text column as lines; what was there is replaced."""
    rows.write.mode("overwrite").text(path)


def place(path: str) -> tuple[FileSystem, str]:
    """The file system of a path and the path in it."""
    if re.match(r"file:/(?!/)", path):
        path = "file://" + path[5:]
    return FileSystem.from_uri(path) if "://" in path else (LocalFileSystem(), os.path.abspath(path))


def write_pages(rows: DataFrame, path: str) -> DataFrame:
    """Writes the content of each row (url, content) to a file named after its url, in any file system of pyarrow's. Returns (url, name,
    error): what can't be written, as its name is too long, say, has an error and stops nothing. A file is whole or not there, also if a
    task runs twice; of rows with one url any may be the one that stays."""

    def run(batches):
        system, folder = place(path)
        system.create_dir(folder)
        for pdf in batches:
            errors = []
            for name, content in zip(pdf["name"], pdf["content"], strict=True):
                part = f"{folder}/.{uuid.uuid4().hex}"
                try:
                    with system.open_output_stream(part, compression=None) as out:
                        out.write(content or b"")
                    system.move(part, f"{folder}/{name}")
                    errors.append(None)
                except (OSError, ValueError) as e:
                    with contextlib.suppress(OSError):
                        system.delete_file(part)
                    errors.append(str(e))
            yield pdf[["url", "name"]].assign(error=errors)

    named = rows.select("url", urls.filename(F.col("url"), F.coalesce(is_pdf(), F.lit(False))).alias("name"), "content").where("name IS NOT NULL")
    return stored(named.mapInPandas(run, "url string, name string, error string"), "written")


def read_pages(names: DataFrame, path: str) -> DataFrame:
    """(name, url, content) of pages that ``write_pages`` has written, from their names (name); null content where there is no file.
    Their names have colons, which not every reader takes."""

    def run(batches):
        system, folder = place(path)
        for pdf in batches:
            content = []
            for name in pdf["name"]:
                try:
                    with system.open_input_file(f"{folder}/{name}") as f:
                        content.append(f.read())
                except OSError:
                    content.append(None)
            yield pdf[["name"]].assign(content=content)

    read = names.select("name").mapInPandas(run, "name string, content binary")
    return read.select("name", urls.url_of_filename(F.col("name")).alias("url"), "content")


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of each file under a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


def is_pdf(content: str = "content"):
    return F.substring(F.col(content), 1, 4) == F.lit(b"%PDF")


def setting(name: str, default: str | None = None) -> str | None:
    """An environment variable."""
    return os.environ.get(name, default)
