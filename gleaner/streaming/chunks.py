"""A stream of pages to chunks: each URL once within its watermark, windows of words from its text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import html, urls
from gleaner.operators import chunk

SCHEMA = "page_id long, url string, html string, fetched timestamp"


def read(spark: SparkSession, path: str, files_at_once: int = 64) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_at_once).parquet(path)


def chunks(pages: DataFrame, late: str = "1 hour") -> DataFrame:
    """(url, fetched, chunk_id, chunk): state is kept for URLs of the last ``late`` only."""
    cleaned = pages.withColumn("url", urls.https(urls.clean(F.col("url")))).withWatermark("fetched", late)
    once = cleaned.dropDuplicatesWithinWatermark(["url"])
    return chunk.chunk_table(once, "url", html.plain_text(F.col("html")), keep=("fetched",))
