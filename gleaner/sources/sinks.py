"""Writers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.sources import folders


def pages(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def answers(rows: DataFrame, path: str, key: str = "qid", value: str = "pred") -> None:
    """One answer a line in the order of the key; a null is an empty line.

    The order of lines is the file's meaning, so one task writes it: for answer files, not for corpora.
    """
    rows.orderBy(key).select(T.one_line(F.col(value)).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def qa_pair(rows: DataFrame, prefix: str) -> None:
    answers(rows, f"{prefix}_questions", value="question")
    answers(rows, f"{prefix}_gold", value="answer")


def qa_rows(rows: DataFrame, path: str) -> None:
    """Question, answer and url as JSON Lines."""
    rows.select("question", "answer", "url").write.mode("overwrite").json(path)


def append_urls(rows: DataFrame, path: str) -> None:
    rows.select("url").write.mode("append").text(path)


def replace(rows: DataFrame, path: str) -> None:
    """Rewrite a table that ``rows`` may be read from: beside it first; then the old one is put aside, and deleted when the
    new one has its place.  After a crash the table is at ``path``, or whole at ``path.new`` and ``path.old``; ``recover`` mends that."""
    spark = rows.sparkSession
    recover(spark, path)
    rows.write.mode("overwrite").parquet(path + ".new")
    if folders.exists(spark, path):
        folders.rename(spark, path, path + ".old")
    folders.rename(spark, path + ".new", path)
    folders.remove(spark, path + ".old")


def recover(spark: SparkSession, path: str) -> None:
    """Finish or undo a rewrite that was cut short."""
    if not folders.exists(spark, path):
        for kept in (".new", ".old"):
            if folders.exists(spark, f"{path}{kept}/_SUCCESS"):
                folders.rename(spark, path + kept, path)
                break
    folders.remove(spark, path + ".new")
    folders.remove(spark, path + ".old")


def replace_all(tables: dict[str, DataFrame], folder: str) -> None:
    """Rewrite several tables of a folder as one: all are written to a new version, and then its name is, in one file.

    A reader sees all tables of one version; ``current`` has its name.
    """
    spark = next(iter(tables.values())).sparkSession
    version = f"v{uuid.uuid4().hex}"
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{folder}/{version}/{name}")
    before = current(spark, folder)
    replace(spark.createDataFrame([(version,)], "version string").coalesce(1), f"{folder}/current")
    if before:
        folders.remove(spark, f"{folder}/{before}")


def current(spark: SparkSession, folder: str) -> str | None:
    """The version that ``replace_all`` wrote last, None where there is none."""
    recover(spark, f"{folder}/current")
    return spark.read.parquet(f"{folder}/current").first()[0] if folders.exists(spark, f"{folder}/current") else None


def report(summary: DataFrame, details: DataFrame | None = None, zero: int = 10) -> DataFrame:
    """(part int, line string): a summary's numbers, then a line for each question, then the first of those without any overlap.

    ``summary`` (exact_match, f1, n, without), ``details`` (qid, pred, em, f1, mark); details are gone through once more for the last part.
    """
    said = F.format_string("n=%d  EM=%.2f  F1=%.2f", F.col("n").cast("long"), "exact_match", "f1")
    line = lambda part, text: F.struct(F.lit(part).alias("part"), F.lit(0).cast("long").alias("qid"), text.alias("line"))
    whole = [line(0, said)] if details is None else [line(0, said), line(3, F.format_string("%d without overlap", "without"))]
    lines = summary.select(F.inline(F.array(*whole)))
    if details is not None:
        row = F.format_string("%s  F1=%.3f  [%d] %s", "mark", "f1", F.col("qid").cast("long"), T.short(F.col("pred")))
        lines = lines.unionByName(details.select(F.lit(1).alias("part"), F.col("qid").cast("long").alias("qid"), row.alias("line")))
        worst = details.where("f1 = 0")
        lines = lines.unionByName(worst.orderBy("qid").limit(zero).select(F.lit(2).alias("part"), F.col("qid").cast("long").alias("qid"), T.short(F.col("pred")).alias("line")))
    return lines
