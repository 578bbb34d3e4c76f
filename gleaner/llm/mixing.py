"""Mixing sources to target weights by entropy balancing.

Each document gets a rate, the closest to equal rates (in relative entropy) at which every source has its target
of tokens: the dual's solution is an exponential tilt, rate = exp(lambda * size / scale), one multiplier per
source, held at ``MOST`` copies.  Every constraint sums over one source only, so the dual's Hessian is diagonal and
its Newton steps run for all sources at once on the executors, each on the counts by size of its source: those are
all that the dual depends on, and a source of a third of all rows has no more of them than it has different sizes.
Rates become whole copies by carrying the rounding error from larger to smaller documents of a source.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import checkpoint

WEIGHTS = (5, 2, 1)
MOST = 3
_SPREAD = 64
#: Groups of rows up to this number are broadcast (about 80 bytes each); more are joined by a shuffle.
BROADCAST_SHARES = 1_000_000
_WORD = r"[^\x20\x09-\x0D]++"


def size_of(text: Column) -> Column:
    """The number of words; a null text has none."""
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(_WORD)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``sizes`` (source, source_size), a row per source -> the same with ``target``.

    Sources by code point, null last, take the weights in turn.  A target stops at ``most`` times its source's
    size and the excess goes to the others by weight: sorted by what a unit of weight may get, the level at which
    the targets add up to all sizes lies where it first is no more than a source's own.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.select("source", "source_size", weight.cast("double").alias("weight"))
    bound = F.col("source_size") * float(most)
    rows = rows.withColumn("own", bound / F.col("weight"))
    everything = Window.partitionBy(F.lit(0))
    by_own = everything.orderBy("own", F.col("source").asc_nulls_last())
    before = by_own.rowsBetween(Window.unboundedPreceding, -1)
    after = by_own.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum(bound).over(before), F.lit(0.0))
    rows = rows.withColumn("level", left / F.sum("weight").over(after)).withColumn("place", F.row_number().over(by_own))
    reached = F.when(F.col("level") <= F.col("own"), F.struct("place", "level"))
    level = F.min(reached).over(everything)["level"]
    return rows.select("source", "source_size", F.least(bound, F.coalesce(level, F.lit(0.0)) * F.col("weight")).alias("target"))


def multiplier(size: np.ndarray, n: np.ndarray, target: float, most: float = MOST) -> float:
    """lambda with sum(n * size * min(most, exp(lambda * size / max(size)))) = target, by Newton steps that fall
    back to halving the bracket."""
    total = float((n * size).sum())
    if total <= 0 or target >= most * total:
        return np.inf
    if target <= 0:
        return -np.inf
    x = size / size.max()
    low, high = -1.0, 1.0

    def off(lam: float) -> tuple[float, float]:
        with np.errstate(over="ignore"):
            rate = np.exp(lam * x)
        free = rate < most
        taken = n * size * np.where(free, rate, most)
        return float(taken.sum()) - target, float((taken * x * free).sum())

    while off(low)[0] > 0:
        low *= 2
    while off(high)[0] < 0:
        high *= 2
    lam = 0.0
    for _ in range(200):
        f, slope = off(lam)
        if abs(f) <= 1e-9 * max(1.0, target):
            break
        low, high = (lam, high) if f < 0 else (low, lam)
        step = lam - f / slope if slope > 0 else np.nan
        lam = step if low < step < high else (low + high) / 2
    return lam


def allot(size: np.ndarray, n: np.ndarray, target: float, most: int = MOST) -> np.ndarray:
    """Copies for each size of one source, over all its ``n`` documents of that size."""
    copies = np.zeros(len(size), np.int64)
    lam = multiplier(size.astype(float), n.astype(float), target, most)
    with np.errstate(over="ignore", invalid="ignore"):
        rate = np.minimum(most, np.exp(lam * (size / max(1, size.max())))) if np.isfinite(lam) else np.full(len(size), float(most if lam > 0 else 0))
    owed = 0.0  # words that larger documents left over
    for k in np.argsort(-size, kind="stable").tolist():
        if size[k]:
            owed += rate[k] * n[k] * size[k]
            copies[k] = min(most * int(n[k]), max(0, int(np.floor(owed / size[k] + 0.5))))
            owed -= float(copies[k]) * float(size[k])
        else:
            copies[k] = n[k]
    return copies


def _allot(frame: pd.DataFrame) -> pd.DataFrame:
    copies = allot(frame["size"].to_numpy(), frame["n"].to_numpy(), float(frame["target"].iloc[0]))
    return frame.assign(copies=copies)[["source", "size", "n", "copies", "source_size", "target"]]


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, source_size, target, copies, taken) of every row: how many times the mix takes it."""
    return _copies(docs, key, text).drop("source")


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all their columns, each as often as the mix takes it.

    Rows that agree in doc_id, source and size share the copies that the mix gives to all of them; where these don't
    come out even, those of the smallest hash of text get one more.  Null doc_ids and sources are values like others.
    """
    shares = _copies(docs).groupBy(F.col("doc_id").alias("doc_id_"), F.col("source").alias("source_"), F.col("size").alias("size_"))
    shares = shares.agg(F.sum("copies").alias("all_"), F.count("*").alias("rows_")).where("all_ > 0")
    shares = checkpoint(shares.select("doc_id_", "source_", "size_", F.expr("all_ div rows_").alias("each_"), (F.col("all_") % F.col("rows_")).alias("more_")))
    few = F.broadcast(shares) if shares.count() <= BROADCAST_SHARES else shares
    # the row itself is one column, so none of its names can clash with those used here
    whole = F.struct(*(docs[c] for c in docs.columns)).alias("row_")
    keyed = docs.select(whole, docs["doc_id"].alias("id_"), docs["source"].cast("string").alias("from_"), size_of(docs["text"]).alias("words_"), F.xxhash64(docs["text"]).alias("hash_"))
    on = F.col("id_").eqNullSafe(F.col("doc_id_")) & F.col("from_").eqNullSafe(F.col("source_")) & (F.col("words_") == F.col("size_"))
    rows = keyed.join(few, on)
    taken = rows.where("more_ = 0").withColumn("copies_", F.col("each_"))
    if shares.where("more_ > 0").count():
        rank = F.row_number().over(Window.partitionBy("doc_id_", "source_", "size_").orderBy("hash_"))
        uneven = rows.where("more_ > 0").withColumn("rank_", rank)
        taken = taken.unionByName(uneven.withColumn("copies_", F.col("each_") + (F.col("rank_") <= F.col("more_")).cast("long")).drop("rank_"))
    taken = taken.where("copies_ > 0").withColumn("copy_", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies_"))))
    return taken.select("row_.*")


def _copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) of every row.

    A document of no words takes no words and stays once.  A null source is a source of its own; a null doc_id
    and repeated rows are documents like any other.  Reruns agree: of the documents of one size in one source,
    those of the smallest hash of doc_id get one copy more.  An empty table gives no rows.
    """
    rows = checkpoint(docs.select(F.col(key).alias("doc_id"), F.col("source").cast("string").alias("source"), size_of(F.col(text)).alias("size")))
    spread = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(_SPREAD)).cast("int")
    rows = rows.withColumn("part", spread)
    parts = checkpoint(rows.groupBy("source", "size", "part").agg(F.count("*").alias("m")))
    counts = parts.groupBy("source", "size").agg(F.sum("m").alias("n"))
    sizes = counts.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    wanted = targets(sizes).withColumnRenamed("source", "source_")
    table = counts.join(wanted, F.col("source").eqNullSafe(F.col("source_"))).drop("source_")
    schema = "source string, size bigint, n bigint, copies bigint, source_size bigint, target double"
    allotted = checkpoint(table.groupBy("source").applyInPandas(_allot, schema))
    # documents of one source and size are ranked by a hash: parts in order, rows within a part
    before = Window.partitionBy("source", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.withColumn("before", F.coalesce(F.sum("m").over(before), F.lit(0))).drop("m")
    a = allotted.withColumnRenamed("source", "source_").withColumnRenamed("size", "size_")
    placed = placed.join(a, F.col("source").eqNullSafe(F.col("source_")) & (F.col("size") == F.col("size_")))
    placed = placed.select(F.col("source").alias("source_"), F.col("size").alias("size_"), F.col("part").alias("part_"), "before", "n", "copies", "source_size", "target")
    on = F.col("source").eqNullSafe(F.col("source_")) & (F.col("size") == F.col("size_")) & (F.col("part") == F.col("part_"))
    joined = rows.join(placed, on)
    inside = Window.partitionBy("source", "size", "part").orderBy(F.xxhash64("doc_id"), "doc_id")
    rank = F.col("before") + F.row_number().over(inside)
    each = F.floor(F.col("copies") / F.col("n"))
    copies = (each + F.when(rank <= F.col("copies") - each * F.col("n"), 1).otherwise(0)).cast("long")
    return joined.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
