"""Readers of the file formats, with fixed schemas; order is an explicit column where it matters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.functions import text as T

PAGE = "url string, title string, text string, meta_description string"
QA = "question string, answer string, url string"
ANNOTATION = "id string, question string, answer string, gold_answer string, url string, validity_label string, annotated_answer string, corrected_answer string, notes string, annotator string"


def pages(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of pages."""
    return spark.read.schema(PAGE).json(path, multiLine=True)


def _lines(spark: SparkSession, path: str, keep_blank: bool) -> DataFrame:
    """(qid, value): a text file's stripped lines in order; one file is read by one task, so its ids follow the lines."""
    rows = spark.read.text(path).coalesce(1).select(T.strip(F.col("value")).alias("value"))
    rows = rows if keep_blank else rows.where("value <> ''")
    return rows.select(F.monotonically_increasing_id().alias("qid"), "value")


def question_column(spark: SparkSession, path: str) -> DataFrame:
    """(qid, question) of a JSON Lines file, blank ones included."""
    rows = spark.read.schema(QA).json(path).coalesce(1).select(F.coalesce("question", F.lit("")).alias("question"))
    return rows.select(F.monotonically_increasing_id().alias("qid"), "question")


def questions(spark: SparkSession, path: str) -> DataFrame:
    """(qid, question) of a .jsonl or text file; blank ones are left out."""
    if path.endswith(".jsonl"):
        rows = spark.read.schema(QA).json(path).coalesce(1).select(T.strip(F.col("question")).alias("question")).where("question <> ''")
        return rows.select(F.monotonically_increasing_id().alias("qid"), "question")
    return _lines(spark, path, False).withColumnRenamed("value", "question")


def references(spark: SparkSession, path: str) -> DataFrame:
    """(qid, question, golds, url) of a JSON Lines file."""
    rows = spark.read.schema(QA).json(path).coalesce(1)
    return rows.select(F.monotonically_increasing_id().alias("qid"), "question", T.split_golds(F.col("answer")).alias("golds"), F.coalesce("url", F.lit("")).alias("url"))


def predictions(spark: SparkSession, path: str) -> DataFrame:
    return _lines(spark, path, True).withColumnRenamed("value", "pred")


def golds(spark: SparkSession, path: str) -> DataFrame:
    return _lines(spark, path, True).select("qid", T.split_golds(F.col("value")).alias("golds"))


def _is_array(spark: SparkSession, path: str) -> bool:
    """Whether the first character of a file that isn't white space opens an array."""
    first = spark.read.text(path).where("trim(value) <> ''").select(T.strip(F.col("value")).alias("v")).first()
    return first is not None and first.v.startswith("[")


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array or JSON Lines file, whichever its content is, with the row's number as pos."""
    rows = spark.read.schema(ANNOTATION).json(path, multiLine=_is_array(spark, path)).coalesce(1)
    return rows.withColumn("pos", F.monotonically_increasing_id())


def reference_lists(spark: SparkSession, path: str) -> DataFrame:
    """(qid, golds) of a JSON array whose elements are each a text or a list of texts."""
    whole = spark.read.text(path, wholetext=True).select(F.expr("try_parse_json(value)").alias("v"))
    items = whole.select(F.posexplode(F.expr("cast(v as array<variant>)")).alias("qid", "v"))
    listed = F.when(F.expr("schema_of_variant(v)").startswith("ARRAY"), F.expr("try_variant_get(v, '$', 'array<string>')")).otherwise(F.array(F.expr("try_variant_get(v, '$', 'string')")))
    return items.select(F.col("qid").cast("long").alias("qid"), listed.alias("golds"))


def read_env(text: str) -> dict[str, str]:
    """Names and values of lines NAME=value; the first = divides, lines that begin with # and those without = don't count."""
    found = {}
    for line in map(str.strip, text.splitlines()):
        if "=" in line and not line.startswith("#"):
            name, _, value = line.partition("=")
            found[name.strip()] = value.strip()
    return found


def head(rows: DataFrame, key: str, n: int = 20) -> DataFrame:
    return rows.orderBy(key).limit(n)


def beside(rows: DataFrame, key: str) -> DataFrame:
    """Each row's place among the keys, with the keys before and after it, its own at the ends.

    The order is over all rows, as for a list that people go through: for task lists, not for corpora.
    """
    order = Window.orderBy(key)
    near = lambda f: F.coalesce(f(key).over(order), F.col(key))
    return rows.select(key, (F.row_number().over(order) - 1).cast("long").alias("idx"), near(F.lag).alias("before"), near(F.lead).alias("after"))


def clamped(idx: int, n: int) -> int:
    """A place within a list of n, the nearest if it is outside."""
    return max(0, min(idx, n - 1))


def first_seen(lines: DataFrame) -> DataFrame:
    """(url, pos) of each distinct URL, where it came first."""
    return lines.groupBy("url").agg(F.min("pos").alias("pos"))
