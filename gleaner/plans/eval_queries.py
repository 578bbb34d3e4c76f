"""Queries of scoring and annotator agreement."""

from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.operators import agreement, evaluate
from gleaner.plans import duck
from gleaner.plans.registry import query, table
from gleaner.sources import sinks


def _answers(spark, d):
    """What is said in every turn: its first line as the prediction, all of it or the speaker's role as golds."""
    rows = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), "role", "text")
    return rows.select("qid", F.substring_index("text", "\n", 1).alias("pred"), F.concat_ws(" | ", "text", "role").alias("answer"))


_BASE = f"""WITH a AS MATERIALIZED (SELECT conv_id * 1000 + turn AS qid, string_split(text, chr(10))[1] AS pred, concat_ws(' | ', text, role) AS answer FROM conversations),
g AS MATERIALIZED (SELECT qid, pred, list_transform(string_split(answer, '|'), lambda x: {duck.strip('x')}) AS golds FROM a),
n AS MATERIALIZED (SELECT qid, pred, golds, {duck.norm('pred')} AS p, {duck.words(duck.norm('pred'))} AS t, list_transform(golds, lambda x: {duck.norm('x')}) AS ng FROM g),
u AS MATERIALIZED (SELECT qid, unnest(ng) AS g1 FROM n), k AS MATERIALIZED (SELECT qid, g1, {duck.words('g1')} AS gt FROM u),
s AS (SELECT n.qid, max(CASE WHEN g1 = p THEN 1 ELSE 0 END) AS em, max({duck.f1('t', 'gt')}) AS f1 FROM n JOIN k USING (qid) GROUP BY 1)
"""


@query(_BASE + "SELECT qid, array_to_string(golds, '#') AS golds, CAST(len(golds) AS BIGINT) AS n FROM g")
def gold_split(spark, d):
    rows = _answers(spark, d).select("qid", T.split_golds(F.col("answer")).alias("g"))
    return rows.select("qid", F.array_join("g", "#").alias("golds"), F.size("g").cast("long").alias("n"))


@query(_BASE + f", x AS (SELECT qid, t, {duck.words(duck.norm('answer'))} AS b FROM n JOIN a USING (qid)) SELECT qid, CAST(coalesce({duck.overlap('t', 'b')}, 0) AS BIGINT) AS overlap FROM x")
def token_overlap(spark, d):
    form = lambda c: T.tokenize(T.normalize_answer(F.col(c)))
    rows = _answers(spark, d).select("qid", form("pred").alias("a"), form("answer").alias("b"))
    return rows.select("qid", T.token_overlap(F.col("a"), F.col("b")).cast("long").alias("overlap"))


@query(_BASE + f", x AS (SELECT qid, t, {duck.words(duck.norm('answer'))} AS b FROM n JOIN a USING (qid)) SELECT qid, round({duck.f1('t', 'b')}, 6) AS f1 FROM x")
def token_f1(spark, d):
    form = lambda c: T.tokenize(T.normalize_answer(F.col(c)))
    rows = _answers(spark, d).select("qid", form("pred").alias("a"), form("answer").alias("b"))
    return rows.select("qid", F.round(T.f1_of(F.col("a"), F.col("b")), 6).alias("f1"))


def _scored(spark, d):
    return evaluate.details(_answers(spark, d).withColumn("golds", T.split_golds(F.col("answer"))))


@query(_BASE + "SELECT round(100.0 * avg(em), 6) AS exact_match, round(100 * avg(f1), 6) AS f1, count(*) AS n FROM s")
def eval_em_f1(spark, d):
    return evaluate.summary(_scored(spark, d)).select(F.round("exact_match", 6).alias("exact_match"), F.round("f1", 6).alias("f1"), "n")


@query(_BASE + "SELECT qid, em = 1 AS em, round(f1, 6) AS f1, CASE WHEN em = 1 THEN '✓' WHEN f1 > 0 THEN '~' ELSE '✗' END AS mark FROM s")
def eval_details(spark, d):
    return _scored(spark, d).select("qid", "em", F.round("f1", 6).alias("f1"), "mark")


@query(_BASE + "SELECT qid FROM s WHERE f1 = 0")
def eval_zero_f1(spark, d):
    return evaluate.zero_f1(_scored(spark, d)).select("qid")


def _pairs(spark, d):
    """Two coders per labelled document: quality and toxic."""
    labels = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("a"), F.max("toxic").alias("b"))
    return labels.join(table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars"), "doc_id")


_PAIRS = """WITH p AS (SELECT doc_id, lang, source, n_chars, a, b FROM (SELECT doc_id, max(quality) AS a, max(toxic) AS b FROM labels GROUP BY 1) JOIN documents USING (doc_id)),
m AS (SELECT lang, count(*) AS n, avg(CAST(a = b AS INT)) AS o, avg(CAST(a = 1 AS INT)) AS p1, avg(CAST(b = 1 AS INT)) AS p2 FROM p GROUP BY 1)
"""
_BAND = "CASE WHEN {0} >= 0.8 THEN 'reliable' WHEN {0} >= 0.667 THEN 'tentative' ELSE 'low' END"


@query("""SELECT CAST(d.doc_id AS VARCHAR) AS key, quality AS valid, toxic AS valid_2 FROM labels l JOIN documents d USING (doc_id)
QUALIFY row_number() OVER (PARTITION BY d.doc_id ORDER BY quality DESC) = 1""")
def iaa_shared(spark, d):
    """Quality by one annotator, toxicity of the documents that are there by the other."""
    labels = table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("key"), "quality", "toxic")
    there = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("key"))
    first = labels.select("key", F.col("quality").alias("valid"), F.col("quality").alias("pos"))
    second = labels.join(there, "key", "left_semi").select("key", F.col("toxic").alias("valid"), F.col("quality").alias("pos"))
    return agreement.in_order(agreement.shared(first, second)).select("key", "valid", "valid_2")


def _annotations(spark, d, label, answer):
    """Documents as one annotator's rows, in the form of annotation files."""
    rows = table(spark, d, "documents").join(table(spark, d, "labels").groupBy("doc_id").agg(F.max(label).alias("label")), "doc_id")
    none = F.lit(None).cast("string")
    return rows.select(F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("question"), none.alias("answer"), F.col("label").cast("string").alias("validity_label"), answer.alias("annotated_answer"), none.alias("corrected_answer"), F.col("doc_id").alias("pos"))


@query(_PAIRS + f""", x AS (SELECT count(*) AS shared, count_if(a = b) AS agreed, count_if(a <> b) AS mismatches, count_if(a = 1 AND b = 1) AS joint_valid, avg(CAST(a = b AS INT)) AS o, avg(CAST(a = 1 AS INT)) AS p1, avg(CAST(b = 1 AS INT)) AS p2 FROM p),
y AS (SELECT *, p1 * p2 + (1 - p1) * (1 - p2) AS e, 1 - (((p1 + p2) / 2) ** 2 + (1 - (p1 + p2) / 2) ** 2) AS ea FROM x),
z AS (SELECT *, (o - e) / (1 - e) AS kappa, 1 - (1 - o) / ea AS alpha FROM y),
j AS (SELECT {duck.words(duck.norm_iaa("source || ' ' || lang"))} AS t, {duck.words(duck.norm_iaa('source'))} AS u FROM p WHERE a = 1 AND b = 1),
k AS (SELECT round(100 * avg(CAST(t = u AS INT)), 6) AS exact_match, round(100 * avg({duck.f1('t', 'u')}), 6) AS f1 FROM j)
SELECT 'annotation' AS mode, shared, shared AS comparable, 0 AS skipped, agreed, mismatches, joint_valid, round(o, 6) AS agreement, round(kappa, 6) AS kappa, {_BAND.format('kappa')} AS kappa_band, round(alpha, 6) AS alpha, {_BAND.format('alpha')} AS alpha_band, exact_match, f1 FROM z, k""")
def iaa_dispatch(spark, d):
    got = agreement.compare(_annotations(spark, d, "quality", F.concat_ws(" ", "source", "lang")), _annotations(spark, d, "toxic", F.col("source")))["summary"]
    return got.withColumns({c: F.round(c, 6) for c in ("agreement", "kappa", "alpha", "exact_match", "f1")})


@query(_PAIRS + "SELECT CAST(doc_id AS VARCHAR) AS key, lang AS question, CAST(a AS VARCHAR) AS label, CAST(b AS VARCHAR) AS label_2 FROM p WHERE a <> b ORDER BY 1 LIMIT 20")
def iaa_mismatches(spark, d):
    """The first twenty by key, as the report shows them."""
    got = agreement.compare(_annotations(spark, d, "quality", F.col("source")), _annotations(spark, d, "toxic", F.col("source")))
    return got["labels"].select("key", "question", "label", "label_2")


@query("WITH p AS (SELECT lang, a, nullif(b, 1 - CAST(doc_id % 3 = 0 AS INT)) AS b FROM (SELECT doc_id, max(quality) AS a, max(toxic) AS b FROM labels GROUP BY 1) JOIN documents USING (doc_id)) SELECT lang, count(*) AS shared, count(b) AS comparable, count(*) - count(b) AS skipped, count_if(a = b) AS agreed, count_if(a <> b) AS mismatches, count_if(a = 1 AND b = 1) AS joint_valid FROM p GROUP BY 1")
def iaa_labels(spark, d):
    some = _pairs(spark, d).withColumn("b", F.nullif("b", 1 - (F.col("doc_id") % 3 == 0).cast("int")))
    return agreement.label_counts(some, "a", "b", "lang")


@query(_PAIRS + f", k AS (SELECT *, p1 * p2 + (1 - p1) * (1 - p2) AS e FROM m), v AS (SELECT *, CASE WHEN abs(1 - e) < 1e-12 THEN CAST(o = 1 AS INT) ELSE (o - e) / (1 - e) END AS kappa FROM k) SELECT lang, n, round(o, 6) AS agreement, round(kappa, 6) AS kappa, {_BAND.format('kappa')} AS band FROM v")
def iaa_kappa(spark, d):
    return agreement.kappa(_pairs(spark, d), "a", "b", "lang").select("lang", "n", F.round("agreement", 6).alias("agreement"), F.round("kappa", 6).alias("kappa"), "band")


@query(_PAIRS + f", k AS (SELECT *, 1 - (((p1 + p2) / 2) * ((p1 + p2) / 2) + (1 - (p1 + p2) / 2) * (1 - (p1 + p2) / 2)) AS e FROM m), v AS (SELECT *, CASE WHEN abs(e) < 1e-12 THEN CAST(o = 1 AS INT) ELSE 1 - (1 - o) / e END AS alpha FROM k) SELECT lang, n, round(alpha, 6) AS alpha, {_BAND.format('alpha')} AS band FROM v")
def iaa_alpha(spark, d):
    return agreement.alpha(_pairs(spark, d), "a", "b", "lang").select("lang", "n", F.round("alpha", 6).alias("alpha"), "band")


@query(_PAIRS + "SELECT doc_id, lang FROM p WHERE a = 1 AND b = 1")
def iaa_joint_valid(spark, d):
    return _pairs(spark, d).where("a = 1 and b = 1").select("doc_id", "lang")


@query(f"""WITH t AS MATERIALIZED (SELECT role, {duck.norm_iaa('text')} AS a, {duck.norm_iaa("string_split(text, chr(10))[1]")} AS b FROM conversations WHERE text <> '' AND string_split(text, chr(10))[1] <> ''),
k AS MATERIALIZED (SELECT role, a, b, {duck.words('a')} AS ta, {duck.words('b')} AS tb FROM t)
SELECT role, count(*) AS n, round(100 * avg(CAST(a = b AS INT)), 6) AS exact_match, round(100 * avg({duck.f1('ta', 'tb')}), 6) AS f1, count_if(a <> b) AS mismatches FROM k GROUP BY 1""")
def iaa_answers(spark, d):
    pairs = table(spark, d, "conversations").select("role", F.col("text").alias("a"), F.substring_index("text", "\n", 1).alias("b"))
    return agreement.answers(pairs, "a", "b", "role").select("role", "n", F.round("exact_match", 6).alias("exact_match"), F.round("f1", 6).alias("f1"), "mismatches")


@query(f"""SELECT 'legacy' AS mode, count(*) AS n, round(100 * avg(CAST({duck.norm_iaa('text')} = {duck.norm_iaa("string_split(text, chr(10))[1]")} AS INT)), 6) AS exact_match FROM conversations""")
def iaa_legacy(spark, d):
    """Every turn's text against its first line, place by place."""
    rows = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("pos"), "text", F.lit(None).cast("string").alias("validity_label"))
    first, second = rows.withColumnRenamed("text", "answer"), rows.withColumn("answer", F.substring_index("text", "\n", 1))
    return agreement.compare(first, second)["summary"].select("mode", "n", F.round("exact_match", 6).alias("exact_match"))


_TOKENS = f"SELECT conv_id * 1000 + turn AS qid, unnest({duck.words(duck.norm('text'))}) AS token FROM conversations"


@query(f"""WITH t AS MATERIALIZED ({_TOKENS}), c AS MATERIALIZED (SELECT qid, token, count(*) AS n FROM t GROUP BY ALL)
SELECT conv_id * 1000 + turn AS qid, coalesce((SELECT sum(least(x.n, y.n)) FROM c x JOIN c y ON x.token = y.token WHERE x.qid = conv_id * 1000 + turn AND y.qid = conv_id * 1000 + turn - 1), 0)::BIGINT AS overlap FROM conversations""")
def turn_overlap(spark, d):
    """How many words a turn shares with the one before it, whatever their lengths."""
    words = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), T.tokenize(T.normalize_answer(F.col("text"))).alias("a"))
    before = words.select((F.col("qid") + 1).alias("qid"), F.col("a").alias("b"))
    return evaluate.overlaps(words.join(before, "qid", "left").withColumn("b", F.coalesce("b", F.array().cast("array<string>"))), "qid", "a", "b").select("qid", "overlap")


@query(_BASE + """, t AS (SELECT count(*) AS n, 100.0 * avg(em) AS em, 100 * avg(f1) AS f1 FROM s), z AS (SELECT n.qid, pred FROM s JOIN n USING (qid) WHERE f1 = 0)
SELECT 0 AS part, 0 AS qid, printf('n=%d  EM=%.2f  F1=%.2f', n, em, f1) AS line FROM t UNION ALL SELECT 3, 0, printf('%d without overlap', count(*)) FROM z UNION ALL SELECT 2, qid, """ + f"CASE WHEN length({duck.collapse('pred')}) > 140 THEN substr({duck.collapse('pred')}, 1, 137) || '...' ELSE {duck.collapse('pred')} END" + """ FROM (SELECT * FROM z ORDER BY qid LIMIT 10)""")
def eval_report(spark, d):
    """The report's summary and its rows without overlap, of which it shows ten."""
    scored = _scored(spark, d)
    return sinks.report(evaluate.summary(scored), scored).where("part <> 1")


@query("SELECT lang, coalesce(min(CASE WHEN quality IS NULL THEN doc_id END), 0) AS first_open, count(quality) AS done, count(*) AS n FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) USING (doc_id) GROUP BY 1")
def annot_progress(spark, d):
    labels = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rows = table(spark, d, "documents").select("doc_id", "lang").join(labels, "doc_id", "left")
    first = F.coalesce(F.min(F.when(F.col("quality").isNull(), F.col("doc_id"))), F.lit(0).cast("long"))
    return rows.groupBy("lang").agg(first.alias("first_open"), F.count("quality").alias("done"), F.count("*").alias("n"))
