"""Curation of question-answer rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.operators import generate

WINDOW_WORDS, LEAST_PAGE_WORDS, MOST_ANSWER_WORDS, MOST_PAIRS = 300, 30, 9, 500


def window(text: Column, seed: Column, words: int = WINDOW_WORDS) -> Column:
    """``words`` words from a start given by ``seed``; a text of no more is returned as it is."""
    tokens = T.tokenize(text)
    span = F.size(tokens) - words + 1
    start = F.pmod(seed, F.greatest(span, F.lit(1)).cast("long")).cast("int")
    return F.when(F.size(tokens) <= words, text).otherwise(F.array_join(F.slice(tokens, start + 1, F.lit(words)), " "))


def long_enough(text: Column, least: int = LEAST_PAGE_WORDS) -> Column:
    return F.size(T.tokenize(text)) >= least


def valid(question: Column, answer: Column, context: Column, most: int = MOST_ANSWER_WORDS) -> Column:
    """Both present, the answer short and, but for case, a part of its context; an empty answer is."""
    return question.isNotNull() & answer.isNotNull() & (F.size(T.tokenize(answer)) <= most) & F.contains(F.lower(context), F.lower(answer))


def first_wins(rows: DataFrame, key: Column, position: str) -> DataFrame:
    """One row for each key, that of the smallest position, by an aggregation that is partial before the shuffle."""
    kept = rows.groupBy(key.alias("key_")).agg(F.min_by(F.struct(*rows.columns), position).alias("r"))
    return kept.select("r.*")


def synthesize(pages: DataFrame, generator: generate.Generator, seed: Column, most: int = MOST_PAIRS) -> DataFrame:
    """``pages`` (pos, url, text) -> (pos, question, answer, url), at most ``most`` in the order of pos.

    Pages of enough words give a window each; a reply with a question and an answer counts if the answer is short and in its
    window, and the first of those that ask the same.  ``pos`` says the order in which pages are taken.
    """
    windows = pages.where(long_enough(F.col("text"))).select("pos", "url", window(F.col("text"), seed).alias("context"))
    asked = generate.replies(windows, generator, "context", generate.ATTEMPTS, good=generate.is_pair)
    pairs = asked.select("pos", "url", "context", T.extract_qa(F.col("reply")).alias("qa"))
    pairs = pairs.select("pos", T.strip(F.col("qa.question")).alias("question"), T.strip(F.col("qa.answer")).alias("answer"), "url", "context")
    kept = pairs.where(valid(F.col("question"), F.col("answer"), F.col("context"))).drop("context")
    return first_wins(kept, F.lower("question"), "pos").orderBy("pos").limit(most)
