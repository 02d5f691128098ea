"""The page pipeline over a stream: its steps look at one row at a time, so they run unchanged on streaming DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.patterns import Patterns
from ..operators import pages as P


def pages(spark: SparkSession, path: str, files_at_once: int = 100) -> DataFrame:
    """A stream of pages (page_id, url, text) from Parquet files as they arrive."""
    return spark.readStream.schema("page_id long, url string, text string").option("maxFilesPerTrigger", files_at_once).parquet(path)


def mentions(stream: DataFrame, patterns: Patterns | None = None) -> DataFrame:
    return P.extract(stream, patterns).select("page_id", "url", F.explode("numbers").alias("number"))


def run(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Works through all that is there and stops; a restart with the same checkpoint goes on where it ended."""
    return stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
