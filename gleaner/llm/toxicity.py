"""Toxicity by two Kneser-Ney models, one of toxic and one of ordinary documents.

The models are over the characters of a word with its ends, up to five at a time, so an expression is known by
itself or by what it is built from.  Orders three to five are each class's own: the longest by its counts, the others
by continuation counts (before how many different characters), with absolute discounting; what they take from seen
characters goes to the next lower order.  Orders one and two are shared: continuation counts of both classes together,
so that rare expressions get the same probability from either model.  A document's features are length-normalised: the mean over its words of the
log-likelihood ratio, the mean and sum of what words have beyond a margin, and the log of the length; a logistic
fit on labelled rows that gave no counts turns them into a score.

Counts come from all labelled rows of their folds.  They are kept by n-gram, each under a 64-bit hash of its own, so
the model grows with the different n-grams of those rows: about 24 bytes for each are broadcast.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import give_back, in_blocks, in_pieces, signed, tidy, whole_text, words_in

ORDER, SHARED_ORDER = 5, 2
DISCOUNT = 0.75
ALPHABET = 4096
MARGIN, MOST = 1.5, 10.0
#: Labelled documents of the fitting fold that the logistic fit reads, those with the smallest hash of doc_id.
FIT_ROWS = 50_000
#: Labels up to this number of rows are broadcast (about 50 bytes each); more are joined by a shuffle.
BROADCAST_LABELS = 1_000_000
FOLDS = 5
HELD_OUT, FITTING = 0, 4
_WORDS_KEPT = 150_000
_WORDS_AT_ONCE = 20_000
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _grams(words: list[str]):
    """For the characters of each word and its end: (word number, position, 64-bit keys of the n-grams that end there)."""
    chars = np.frombuffer("".join([f"\2{w}\3" for w in words]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    sizes = np.array([len(w) + 2 for w in words])
    word = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(chars)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    hashed = [np.zeros(len(chars), np.uint64)]
    with np.errstate(over="ignore"):
        for _ in range(ORDER):
            before = np.r_[np.zeros(1, np.uint64), hashed[-1][:-1]]
            hashed.append((before + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0x9E3779B97F4A7C15) + chars * np.uint64(0xD1342543DE82EF95))
        keys = [(h ^ h >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9) for h in hashed]
    return word, place, [signed(k) for k in keys]


COUNTS = "gram_order int, gram bigint, context bigint, suffix bigint, ordinary bigint, toxic bigint"


def _count_rows(words: dict[str, list[int]]) -> list[pa.RecordBatch]:
    if not words:
        return []
    word, place, grams = _grams(list(words))
    weights = np.array(list(words.values()), dtype=np.float64)
    out = []
    for k in range(1, ORDER + 1):
        at = np.flatnonzero((place >= max(1, k - 1)))
        context, suffix = grams[k - 1][at - 1], grams[k - 1][at]
        seen, first, number = np.unique(grams[k][at], return_index=True, return_inverse=True)
        sums = [np.bincount(number, weights[word[at], c]).astype(np.int64) for c in (0, 1)]
        columns = [np.full(len(seen), k, np.int32), seen, context[first], suffix[first], *sums]
        out.append(pa.RecordBatch.from_arrays([*map(pa.array, columns)], names=["gram_order", "gram", "context", "suffix", "ordinary", "toxic"]))
    return out


def _count(batches):
    words: dict[str, list[int]] = {}
    for batch in in_pieces(batches, 500):
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for w, n in Counter(words_of(text)).items():
                words.setdefault(w, [0, 0])[toxic] += n
        if len(words) > _WORDS_KEPT:
            yield from _count_rows(words)
            words = {}
    yield from _count_rows(words)


@dataclass
class Model:
    """Per order, 0 to ``ORDER``: the sorted n-grams, those that only are contexts included, and a row for each: its
    discounted share by class, and by class the weight of the lower order where it is the context."""

    grams: list[np.ndarray]
    values: list[np.ndarray]
    weights: np.ndarray = field(default_factory=lambda: np.zeros(5))

    def values_of(self, k: int, grams: np.ndarray) -> np.ndarray:
        """The rows of n-grams of order k; one that isn't there has no share and leaves all to the lower order."""
        wanted, back = np.unique(grams, return_inverse=True)
        out = np.tile(np.array([0, 0, 1, 1], np.float32), (len(wanted), 1))
        if len(self.grams[k]):
            at = np.minimum(np.searchsorted(self.grams[k], wanted), len(self.grams[k]) - 1)
            found = self.grams[k][at] == wanted
            out[found] = self.values[k][at[found]]
        return out[back].astype(np.float64)

    def word_ratios(self, words: list[str]) -> np.ndarray:
        """log P(word | toxic) - log P(word | ordinary), within +-MOST."""
        word, place, grams = _grams(words)
        p = [np.full(len(word), 1 / ALPHABET)] * 2
        here = self.values_of(0, grams[0])
        for k in range(1, ORDER + 1):
            context, here = np.r_[here[:1], here[:-1]], self.values_of(k, grams[k])
            longer = [here[:, c] + context[:, 2 + c] * p[c] for c in (0, 1)]
            p = [np.where(place >= k - 1, x, y) for x, y in zip(longer, p, strict=True)]
        ratio = np.where(place > 0, np.log(p[1]) - np.log(p[0]), 0.0)
        return np.clip(np.bincount(word, ratio, len(words)), -MOST, MOST)

    def features(self, texts: pa.Array) -> np.ndarray:
        """Four numbers for each text; a text without words has zeros."""
        number, offsets, words = words_in(texts, _WORD, pc.utf8_is_alpha)
        ratios = [self.word_ratios(words[at : at + _WORDS_AT_ONCE]) for at in range(0, len(words), _WORDS_AT_ONCE)]
        x = np.concatenate([np.zeros(0), *ratios])[number]
        n = np.diff(offsets)
        sums = [np.diff(np.r_[0, np.cumsum(v)][offsets]) for v in (x, np.maximum(x - MARGIN, 0))]
        each = np.maximum(n, 1)
        return np.stack([sums[0] / each, sums[1] / each, sums[1], np.log1p(n)], axis=1)

    def scores(self, texts: pa.Array) -> np.ndarray:
        z = np.c_[self.features(texts), np.ones(len(texts))] @ self.weights
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def model_of(rows: pa.Table) -> Model:
    """The model from summed counts (columns of ``COUNTS``)."""
    column = {c: rows.column(c).to_numpy() for c in rows.column_names}
    of = [column["gram_order"] == k for k in range(ORDER + 2)]
    grams = [np.unique(np.r_[column["gram"][of[k]], column["context"][of[k + 1]]]) for k in range(ORDER + 1)]
    values = [np.tile(np.array([0, 0, 1, 1], np.float32), (len(g), 1)) for g in grams]
    for k in range(1, ORDER + 1):
        mine = np.searchsorted(grams[k], column["gram"][of[k]])
        context = np.searchsorted(grams[k - 1], column["context"][of[k]])
        if k <= SHARED_ORDER:
            # continuation counts; what only begins words has no character before it and counts once
            seen, n = np.unique(column["suffix"][of[k + 1]], return_counts=True)
            before = np.zeros(len(grams[k]))
            before[np.searchsorted(grams[k], seen)] = n
            counts = [np.maximum(before[mine], 1)] * 2
        elif k < ORDER:
            # each class's continuation counts; what only begins words counts as often as it is there
            counts, longer = [], of[k + 1]
            always = np.isin(column["gram"][of[k]], column["suffix"][longer])
            for c in ("ordinary", "toxic"):
                seen, n = np.unique(column["suffix"][longer & (column[c] > 0)], return_counts=True)
                before = np.zeros(len(grams[k]))
                before[np.searchsorted(grams[k], seen)] = n
                counts.append(np.where(always, before[mine], column[c][of[k]]))
        else:
            counts = [column["ordinary"][of[k]], column["toxic"][of[k]]]
        for c, n in enumerate(counts):
            total = np.bincount(context, n, len(grams[k - 1]))
            kinds = np.bincount(context, n > 0, len(grams[k - 1]))
            values[k][mine, c] = np.maximum(n - DISCOUNT, 0) / np.maximum(total[context], 1)
            values[k - 1][:, 2 + c] = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0)
    return Model(grams, values)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights of a ridge logistic regression on raw features, the last one constant."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z, w = np.c_[(x - mean) / scale, np.ones(len(x))], np.zeros(x.shape[1] + 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w)), z.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    raw = w[:-1] / scale
    return np.r_[raw, w[-1] - (raw * mean).sum()]


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS))


def train(docs: DataFrame, labels: DataFrame, folds: tuple[int, ...] = (1, 2, 3), fit_fold: int = FITTING, fit_rows: int = FIT_ROWS) -> Model:
    """Counts from the labelled rows of ``folds``, the logistic fit from those of ``fit_fold``.

    A document with two labels counts as toxic if one says so; null labels don't count.  Without both classes in
    the fit, every score is near 1 if all its rows are toxic, else near 0.
    """
    marks = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    marks = marks.where(fold(F.col("doc_id")).isin(*folds, fit_fold))
    marks = F.broadcast(marks) if marks.count() <= BROADCAST_LABELS else marks
    rows = docs.select("doc_id", whole_text().alias("text")).join(marks, "doc_id")
    counted = rows.where(fold(F.col("doc_id")).isin(*folds)).select("text", "toxic").mapInArrow(tidy(_count), COUNTS)
    summed = counted.groupBy("gram_order", "gram").agg(F.min("context").alias("context"), F.min("suffix").alias("suffix"), F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"))
    model = model_of(summed.toArrow())
    give_back()  # the summed counts are larger than the model
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def fit(batches):
        for batch in in_blocks(batches):
            found = shared.value.features(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *map(pa.array, found.T)], names=["doc_id", "toxic", *"abcd"])

    few = marks.where(fold(F.col("doc_id")) == fit_fold).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    fitting = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")).join(F.broadcast(few), "doc_id").select("doc_id", "text", "toxic")
    sample = fitting.mapInArrow(tidy(fit), "doc_id bigint, toxic int, a double, b double, c double, d double").orderBy("doc_id", *"abcd").toArrow()
    x = np.stack([sample.column(c).to_numpy() for c in "abcd"], axis=1)
    y = sample.column("toxic").to_numpy()
    if len(y) and 0 < y.mean() < 1:
        model.weights = _logistic(x, y)
    else:
        model.weights = np.r_[np.zeros(4), 30.0 if len(y) and y.mean() == 1 else -30.0]
    return model


def scorer(spark, model: Model):
    """A Column function: the score of a text column; a null is an empty text."""
    shared = spark.sparkContext.broadcast(model)
    give_back()

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        blocks = in_blocks([pa.RecordBatch.from_arrays([texts], names=["text"])], 0)
        out = np.concatenate([np.zeros(0), *(shared.value.scores(b.column(0)) for b in blocks)])
        give_back()
        return pa.array(out)

    return score


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row.

    Rows whose crc32(doc_id) mod 5 is 0 are held out: their labels are never read.  A null text is empty and gets
    the score of no words; a null doc_id is not held out and has no label.  Repeated rows are scored alike.
    """
    score = scorer(docs.sparkSession, train(docs, labels))
    scored = docs.select("doc_id", F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out"), score(whole_text()).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
