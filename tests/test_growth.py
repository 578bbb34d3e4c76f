"""What must not grow with the square of a text, a batch or a class, and what must stay as the queries' SQL has it."""

import time
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from gleaner.functions import html
from gleaner.functions import text as T
from gleaner.operators import agreement, best, bm25, evaluate, index
from gleaner.sources import sinks


def test_token_overlap_counts_repeats(spark):
    rows = [("b a a c", "a a a b d"), ("x", ""), ("", ""), ("a b", "c d"), ("z z z", "z z"), ("é ß", "ß é é")]
    df = spark.createDataFrame(rows, "a string, b string").select(T.token_overlap(T.tokenize(F.col("a")), T.tokenize(F.col("b"))).alias("n"))
    assert [r.n for r in df.collect()] == [(Counter(a.split()) & Counter(b.split())).total() for a, b in rows]


def test_agreement_of_long_answers(spark):
    """the overlap was quadratic, and cut the texts anew for each word."""
    rows = [(" ".join(f"w{k}" for k in range(4000)), " ".join(f"w{k}" for k in range(2000, 6000)))] * 8
    began = time.time()
    got = agreement.answers(spark.createDataFrame(rows, "a string, b string").coalesce(1), "a", "b").first()
    assert (got.n, got.mismatches, got.f1) == (8, 8, 50.0)
    assert time.time() - began < 20


def test_references_without_semicolon_stay():
    """the SQL of html_text_v1, and the native form, know references by their semicolon."""
    page = "<title>a&amp;b&amp</title><body><p>x &amp;&ampy; &copyright; &copy; &middot;&#39;&#x27;&quot; A&B</p><p>cut&amp"
    assert html.text_v1(page) == ("a&b&amp", "x &&ampy; &copyright; © ·''\" A&B\ncut&amp")


def test_report_goes_through_its_rows_twice(spark):
    """the rows were scored once for the summary, once for the rows without overlap and once for their number."""
    rows = spark.range(40).select(F.col("id").alias("qid"), F.concat(F.lit("w"), F.col("id").cast("string")).alias("pred"), F.array(F.lit("w1 w2")).alias("golds"))
    scored = evaluate.details(rows)
    found = sinks.report(evaluate.summary(scored), scored).where("part <> 1")
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 2
    assert [r.line for r in found.where("part <> 2").orderBy("part").collect()] == ["n=40  EM=0.00  F1=3.33", "38 without overlap"]


def test_bm25_blocks_are_bounded(monkeypatch):
    """all pairs of a batch's terms and their questions were held at once; several batches each gave k rows."""
    words, asked = [f"w{k}" for k in range(50)], 40
    weighted = pa.table({"qid": np.repeat(np.arange(asked), 50), "term": words * asked, "weight": np.tile(np.arange(1.0, 51), asked)})
    batches = [pa.record_batch({"ord": np.arange(at, at + 300), "tokens": [words[k % 50 :] for k in range(at, at + 300)]}) for at in (0, 300)]
    sizes, plain = [], best.best
    monkeypatch.setattr(bm25, "best", lambda scores, *rest: sizes.append(scores.shape[1]) or plain(scores, *rest))
    whole = pa.Table.from_batches(bm25._scored(weighted, 25.0, 3, bm25.K1, bm25.B)(batches))
    monkeypatch.setattr(bm25, "PAIRS_AT_ONCE", 20_000)
    sizes.clear()
    parts = pa.Table.from_batches(bm25._scored(weighted, 25.0, 3, bm25.K1, bm25.B)(batches))
    assert whole.num_rows == 3 * asked and parts.equals(whole) and max(sizes) < 100


def test_statistics_of_asked_terms(spark):
    """The idf of asked terms as that of the whole vocabulary has it, negative ones included."""
    rows = spark.createDataFrame([(k, ["often", f"w{k % 7}"] + ["seldom"] * (k == 3)) for k in range(30)], "ord long, tokens array<string>").withColumn("dl", F.size("tokens"))
    asked = spark.createDataFrame([(1, ["often", "seldom", "seldom", "never"]), (2, ["w1"])], "qid long, tokens array<string>")
    for queries in (asked, asked.where("qid = 2")):
        got, plain = bm25.ask_of(rows, queries), bm25.ask(queries, bm25.idf(bm25.term_stats(rows)), rows.agg(F.avg("dl")).first()[0])
        pairs = [{(q, t): round(w, 12) for q, t, w in zip(*(a.weighted.column(c).to_pylist() for c in ("qid", "term", "weight")), strict=True)} for a in (got, plain)]
        assert pairs[0] == pairs[1] and got.avgdl == plain.avgdl


def test_texts_stay_where_they_are(spark, tmp_path):
    """F5, F8, F9, F11: chunks and tokens were shuffled to be joined with a few hits."""
    pages = spark.createDataFrame([(k, "t", f"alpha w{k} beta " * 60) for k in range(40)], "key long, title string, text string")
    found = index.load_or_build(pages, f"file://{tmp_path}/index", "growth")
    questions = spark.createDataFrame([(1, "alpha w3"), (2, "w7 beta")], "qid long, question string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        hits = found.retrieve(questions).select("qid", "ord", "rank")
        plans = [x._jdf.queryExecution().optimizedPlan().toString() for x in (hits, found.contexts(hits, questions))]
        assert "strategy=broadcast" in plans[0] and plans[1].count("strategy=broadcast") > plans[0].count("strategy=broadcast")
        assert {(r.qid, r.url) for r in found.contexts(hits.where("rank = 1"), questions).collect()} == {(1, "3"), (2, "7")}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_tokens_of_answers(spark):
    rows = [(" The  a-b an THE.\tX ",), ("U.S. the",), ("a_the_b the",), ("“The” theory’s a",), ("",), (None,), ("a an the a x",)]
    df = spark.createDataFrame(rows, "t string").select(T.answer_tokens(F.col("t")).alias("a"), T.tokenize(T.normalize_answer(F.col("t"))).alias("b"))
    assert all(r.a == r.b for r in df.collect())


def test_pages_go_to_python_in_parts(monkeypatch):
    """a whole batch of pages was in Python at once, with all that was made of it."""
    pages, sizes, plain = pa.array(["<title>t</title><p>x", None] * 200), [], pa.array
    monkeypatch.setattr(html.pa, "array", lambda x, *kind: sizes.append(len(x)) or plain(x, *kind))
    got = html.html_text_v2.func(pages)
    assert len(got) == 400 and max(sizes) <= html.PAGES_AT_ONCE and got.to_pylist()[:2] == [{"title": "t", "text": "t\nx", "meta_description": ""}, {"title": "", "text": "", "meta_description": ""}]
    assert len(html.html_text_v2.func(plain([], pa.string()))) == 0
