"""Queries of question-answer curation."""

import json

from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.operators import qa
from gleaner.plans import duck
from gleaner.plans.registry import query, table


@query(f"SELECT doc_id FROM documents WHERE len({duck.words('text')}) >= 30")
def qa_page_filter(spark, d):
    return table(spark, d, "documents").where(qa.long_enough(F.col("text"))).select("doc_id")


@query(f"WITH t AS (SELECT doc_id, text, {duck.words('text')} AS w FROM documents), s AS (SELECT *, (doc_id * 7919) % greatest(len(w) - 299, 1) AS i FROM t) SELECT doc_id, CASE WHEN len(w) <= 300 THEN text ELSE array_to_string(w[i + 1 : i + 300], ' ') END AS chunk FROM s")
def qa_window(spark, d):
    return table(spark, d, "documents").select("doc_id", qa.window(F.col("text"), F.col("doc_id") * 7919).alias("chunk"))


def _replies(spark, d):
    """Replies of a generator as events have them: a JSON object in prose, at times broken or doubled."""
    body = F.concat(F.lit('{"question": "Q'), (F.col("event_id") % 50).cast("string"), F.lit('", "answer": "'), F.col("event_type"), F.lit('"}'))
    text = F.when(F.col("event_id") % 5 == 1, F.concat(body, F.lit(" "), body)).when(F.col("event_id") % 5 == 2, "none").otherwise(F.concat(F.lit("ok "), body, F.lit(" bye")))
    return table(spark, d, "events").select("event_id", "event_type", T.extract_qa(text).alias("qa"))


_REPLIES = "WITH r AS (SELECT event_id, event_type, CASE WHEN event_id % 5 IN (1, 2) THEN NULL ELSE 'Q' || event_id % 50 END AS question, CASE WHEN event_id % 5 IN (1, 2) THEN NULL ELSE event_type END AS answer FROM events)"


@query(_REPLIES + " SELECT event_id, question, answer FROM r")
def extract_json(spark, d):
    return _replies(spark, d).select("event_id", "qa.question", "qa.answer")


@query(_REPLIES + " SELECT event_id, question, answer FROM r WHERE question IS NOT NULL AND event_id % 2 = 0")
def qa_validate(spark, d):
    rows = _replies(spark, d).select("event_id", "qa.question", "qa.answer", F.when(F.col("event_id") % 2 == 0, F.upper(F.concat(F.lit("so "), "event_type"))).otherwise("x").alias("context"))
    return rows.where(qa.valid(F.col("question"), F.col("answer"), F.col("context"))).select("event_id", "question", "answer")


@query("SELECT event_type, min(event_id) AS event_id FROM events GROUP BY 1")
def dedup_first(spark, d):
    rows = table(spark, d, "events").select("event_id", "event_type")
    return qa.first_wins(rows, F.lower("event_type"), "event_id").select("event_type", "event_id")


@query("SELECT doc_id FROM documents ORDER BY (doc_id * 7919) % 1000003, doc_id LIMIT 10")
def qa_limit(spark, d):
    return table(spark, d, "documents").orderBy((F.col("doc_id") * 7919) % 1000003, "doc_id").limit(10).select("doc_id")


@query("SELECT item_id AS qid, string_split(text, ' ')[1] AS question, text AS answer FROM benchmark")
def qa_split(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.get(F.split("text", " "), F.lit(0)).alias("question"), F.col("text").alias("answer"))


def _pair(context):
    """A stand-in for a model: three words of a context as a question, the next ones as its answer."""
    words = context.split()
    return "Here: " + json.dumps({"question": " ".join(words[:3]) + "?", "answer": " ".join(words[3:6])})


@query(f"""WITH t AS MATERIALIZED (SELECT doc_id, source, coalesce(text, '') AS text, {duck.words('text')} AS w, ((doc_id * 7919) % 1000003) * 1000000 + doc_id AS pos FROM documents), s AS (SELECT *, (doc_id * 7919) % greatest(len(w) - 299, 1) AS i FROM t WHERE len(w) >= 30),
c AS MATERIALIZED (SELECT pos, source AS url, CASE WHEN len(w) <= 300 THEN text ELSE array_to_string(w[i + 1 : i + 300], ' ') END AS context FROM s),
q AS MATERIALIZED (SELECT pos, url, context, {duck.words('context')} AS w FROM c),
p AS MATERIALIZED (SELECT pos, url, context, array_to_string(w[1:3], ' ') || '?' AS question, array_to_string(w[4:6], ' ') AS answer FROM q)
SELECT pos, question, answer, url FROM p WHERE contains(lower(context), lower(answer)) QUALIFY row_number() OVER (PARTITION BY lower(question) ORDER BY pos) = 1 ORDER BY pos LIMIT 500""")
def qa_chain(spark, d):
    """From documents, in an order by a hash, to at most five hundred pairs, which is the generator's limit."""
    pos = ((F.col("doc_id") * 7919) % 1000003) * 1000000 + F.col("doc_id")
    pages = table(spark, d, "documents").select(pos.alias("pos"), F.col("source").alias("url"), F.coalesce("text", F.lit("")).alias("text"), "doc_id")
    return qa.synthesize(pages, _pair, F.col("doc_id") * 7919)
