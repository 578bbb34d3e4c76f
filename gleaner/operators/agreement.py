"""Agreement of two annotators: shared items, labels, kappa, alpha, answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import text as T

_GUARD = 1e-12


def item_key(position: Column, *columns: Column) -> Column:
    """The first of the columns that has something, else the row's number."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns), F.concat(F.lit("idx_"), position.cast("string")))


def last_by_key(rows: DataFrame, position: str = "pos") -> DataFrame:
    """One row for each key, the last."""
    rest = [c for c in rows.columns if c != "key"]
    return rows.groupBy("key").agg(F.max_by(F.struct(*rest), position).alias("r")).select("key", "r.*")


def shared(first: DataFrame, second: DataFrame) -> DataFrame:
    """Both annotators' rows of the keys that both have; columns of the second end in _2."""
    a, b = last_by_key(first), last_by_key(second)
    b = b.select("key", *(F.col(c).alias(f"{c}_2") for c in b.columns if c != "key"))
    return a.join(b, "key")


def in_order(rows: DataFrame) -> DataFrame:
    """By key, in the order of code points."""
    return rows.orderBy("key")


def mismatches(pairs: DataFrame, a: str, b: str, most: int | None = None) -> DataFrame:
    """The first items by key whose answers differ, with their token F1."""
    rows = pairs.where(~T.exact_match(F.col(a), F.col(b), T.normalize_iaa)).withColumn("f1", T.token_f1(F.col(a), F.col(b), T.normalize_iaa)).orderBy("key")
    return rows if most is None else rows.limit(most)


def label_counts(pairs: DataFrame, a: str, b: str, *by: str) -> DataFrame:
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    return pairs.groupBy(*by).agg(
        F.count("*").alias("shared"),
        F.count_if(both).alias("comparable"),
        F.count_if(~both).alias("skipped"),
        F.count_if(both & (F.col(a) == F.col(b))).alias("agreed"),
        F.count_if(both & (F.col(a) != F.col(b))).alias("mismatches"),
        F.count_if((F.col(a) == 1) & (F.col(b) == 1)).alias("joint_valid"),
    )


def _margins(pairs: DataFrame, a: str, b: str, *by: str) -> DataFrame:
    rows = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg((F.col(a) == F.col(b)).cast("double")).alias("agreement"), F.avg((F.col(a) == 1).cast("double")).alias("p1"), F.avg((F.col(b) == 1).cast("double")).alias("p2"))


def kappa(pairs: DataFrame, a: str, b: str, *by: str) -> DataFrame:
    """Cohen's kappa of two 0/1 labels, with its band."""
    m = _margins(pairs, a, b, *by)
    chance = F.col("p1") * F.col("p2") + (1 - F.col("p1")) * (1 - F.col("p2"))
    value = F.when(F.col("n") == 0, F.lit(float("nan"))).when(F.abs(1 - chance) < _GUARD, F.when(F.col("agreement") == 1, 1.0).otherwise(0.0)).otherwise(F.try_divide(F.col("agreement") - chance, 1 - chance))
    return m.select(*by, "n", "agreement", value.alias("kappa")).withColumn("band", T.reliability_band(F.col("kappa")))


def alpha(pairs: DataFrame, a: str, b: str, *by: str) -> DataFrame:
    """Nominal alpha of two coders from pooled margins, without small-sample correction."""
    m = _margins(pairs, a, b, *by)
    p = (F.col("p1") + F.col("p2")) / 2
    expected = 1 - (p * p + (1 - p) * (1 - p))
    observed = 1 - F.col("agreement")
    value = F.when(F.col("n") == 0, F.lit(float("nan"))).when(F.abs(expected) < _GUARD, F.when(observed == 0, 1.0).otherwise(0.0)).otherwise(1 - F.try_divide(observed, expected))
    return m.select(*by, "n", value.alias("alpha")).withColumn("band", T.reliability_band(F.col("alpha")))


def answers(pairs: DataFrame, a: str, b: str, *by: str) -> DataFrame:
    """Exact match and token F1 of two annotators' answers where both have one."""
    rows = pairs.where((F.col(a) != "") & (F.col(b) != "")).select(*by, T.normalize_iaa(F.col(a)).alias("a_"), T.normalize_iaa(F.col(b)).alias("b_"))
    scored = rows.select(*by, (F.col("a_") == F.col("b_")).alias("em"), T.f1_of(T.tokenize(F.col("a_")), T.tokenize(F.col("b_"))).alias("f1"))
    return scored.groupBy(*by).agg(F.count("*").alias("n"), (100 * F.avg(F.col("em").cast("int"))).alias("exact_match"), (100 * F.avg("f1")).alias("f1"), F.count_if(~F.col("em")).alias("mismatches"))


def keyed(annotations: DataFrame) -> DataFrame:
    """Annotation rows, as ``readers.annotations`` gives them, with ``key``, the label as ``valid`` and what was ``answered``."""
    answered = T.first_truthy(*(F.col(c).cast("string") for c in ("annotated_answer", "answer", "corrected_answer")))
    key = item_key(F.col("pos"), F.col("id"), F.col("question"))
    return annotations.select(key.alias("key"), "pos", "question", "validity_label", T.parse_validity(F.col("validity_label")).alias("valid"), answered.alias("answered"), "answer")


def _is_legacy(annotations: DataFrame) -> bool:
    """Whether the first row has an answer and no label."""
    first = annotations.orderBy("pos").select("answer", "validity_label").first()
    return first is not None and first.answer is not None and first.validity_label is None


def compare(first: DataFrame, second: DataFrame, answer_only: bool = False, most_mismatches: int = 20) -> dict[str, DataFrame]:
    """Two annotators' rows -> ``summary`` (mode and numbers, one row), and of the mode's mismatches the first by key.

    Where neither has labels, answers are compared place by place; with ``answer_only`` those of shared items; else labels of shared
    items, and the answers of items that both call valid.  Raises ValueError where there is nothing to compare.
    """
    if _is_legacy(first) and _is_legacy(second):
        n, m = first.count(), second.count()
        if n != m:
            raise ValueError(f"{n} rows against {m}")
        pairs = first.select("pos", F.coalesce("answer", F.lit("")).alias("a")).join(second.select("pos", F.coalesce("answer", F.lit("")).alias("b")), "pos")
        em, f1 = T.exact_match(F.col("a"), F.col("b"), T.normalize_iaa), T.token_f1(F.col("a"), F.col("b"), T.normalize_iaa)
        return {"summary": pairs.agg(F.lit("legacy").alias("mode"), F.count("*").alias("n"), (100 * F.avg(em.cast("int"))).alias("exact_match"), (100 * F.avg(f1)).alias("f1"))}
    pairs = shared(keyed(first), keyed(second))
    if pairs.isEmpty():
        raise ValueError("no shared items")
    asked = F.coalesce(F.nullif("question", F.lit("")), F.col("question_2"), F.lit("")).alias("question")
    if answer_only:
        both = pairs.select("key", asked, T.strip(F.col("answered")).alias("a"), T.strip(F.col("answered_2")).alias("b"))
        there = both.where("a <> '' and b <> ''")
        if there.isEmpty():
            raise ValueError("no comparable answers")
        counts = both.agg(F.lit("answer-only").alias("mode"), F.count("*").alias("shared"), F.count_if((F.col("a") == "") | (F.col("b") == "")).alias("skipped"))
        return {"summary": counts.crossJoin(answers(there, "a", "b")), "answers": mismatches(there, "a", "b", most_mismatches)}
    labelled = pairs.where("valid is not null and valid_2 is not null")
    if labelled.isEmpty():
        raise ValueError("no comparable labels")
    counts = label_counts(pairs, "valid", "valid_2").withColumn("mode", F.lit("annotation"))
    k = kappa(labelled, "valid", "valid_2").select("agreement", "kappa", F.col("band").alias("kappa_band"))
    a = alpha(labelled, "valid", "valid_2").select("alpha", F.col("band").alias("alpha_band"))
    joint = labelled.where("valid = 1 and valid_2 = 1").select("key", asked, F.col("answered").alias("a"), F.col("answered_2").alias("b"))
    em, f1 = T.exact_match(F.col("a"), F.col("b"), T.normalize_iaa), T.token_f1(F.col("a"), F.col("b"), T.normalize_iaa)
    scored = joint.agg((100 * F.avg(em.cast("int"))).alias("exact_match"), (100 * F.avg(f1)).alias("f1"))
    differ = labelled.where("valid <> valid_2").select("key", asked, F.col("validity_label").alias("label"), F.col("validity_label_2").alias("label_2"), "answered", "answered_2")
    return {"summary": counts.crossJoin(k).crossJoin(a).crossJoin(scored), "labels": differ.orderBy("key").limit(most_mismatches), "answers": mismatches(joint, "a", "b", most_mismatches)}
