"""Token counts through a digest cache: only texts whose digest has no stored count are encoded.

A stored row is (tokenizer digest, content digest, count), so a new version of a tokenizer never reads old counts.
Texts are deduplicated within each map task before they move, so even a text that fills a third of the table
moves once per task; the tasks that encode hold a digest and a count for each text, never a group of rows.  The counts
come back to the rows in a join whose hot keys adaptive execution can split.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import checkpoint, in_blocks, regrouped, tidy, whole_text
from gleaner.llm.tokenizing import piece_counts, version

SCHEMA = "tokenizer string, digest binary, n_tokens bigint"
LIMIT = 2048
_SEEN = 1_000_000


def normalised(text: Column) -> Column:
    """What a count depends on: CR LF counts as LF, as white space has no tokens of its own."""
    return F.replace(text, F.lit("\r\n"), F.lit("\n"))


def content_digest(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text), 256))


def stored(spark: SparkSession, cache: str) -> DataFrame | None:
    """The cache's rows, or None where nothing has been stored yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(cache)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(SCHEMA).parquet(cache) if there else None


def _once_per_task(batches):
    seen: set[bytes] = set()
    for batch in batches:
        keep = []
        for d in batch.column(0).to_pylist():
            keep.append(d not in seen)
            seen.add(d)
        if len(seen) > _SEEN:  # repeats are also dropped where they meet
            seen.clear()
        yield batch.filter(pa.array(keep, pa.bool_()))


def _count_once(path: str):
    def run(batches):
        counter, tokenizer, done = piece_counts(path), version(path), set()
        for batch in in_blocks(batches):
            digests = batch.column(0).to_pylist()
            new = {d: k for k, d in enumerate(digests) if d not in done}
            done.update(new)
            counts = counter.count(batch.column(1).take(pa.array(list(new.values()), pa.int64())))
            yield pa.RecordBatch.from_arrays([pa.array([tokenizer] * len(new), pa.string()), pa.array(list(new), pa.binary()), pa.array(counts, pa.int64())], names=["tokenizer", "digest", "n_tokens"])

    return run


def token_counts(docs: DataFrame, tokenizer_path: str, cache: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row; counts missing from ``cache`` are appended to it.

    A null text is empty: 0 bytes, 0 tokens.  Repeated rows and null ids keep their rows; other columns are not
    read.  An empty table gives no rows and stores nothing new.
    """
    spark = docs.sparkSession
    texts = docs.select("doc_id", whole_text().alias("text")).withColumn("digest", content_digest(F.col("text")))
    known = stored(spark, cache)
    misses = texts.select("digest", "text").mapInArrow(tidy(_once_per_task), "digest binary, text string")
    if known is not None:
        known = known.where(F.col("tokenizer") == version(tokenizer_path))
        misses = misses.join(known, "digest", "left_anti")
    counted = misses.repartition("digest").mapInArrow(tidy(_count_once(tokenizer_path)), SCHEMA)
    counted.write.mode("append").parquet(cache)
    counts = spark.read.schema(SCHEMA).parquet(cache).where(F.col("tokenizer") == version(tokenizer_path)).select("digest", "n_tokens")
    # two writers may have stored the same count
    counts = counts.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    narrow = checkpoint(texts.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes")))
    return narrow.join(regrouped(counts, "digest"), "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
