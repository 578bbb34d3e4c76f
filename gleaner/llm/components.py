"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is a grouped minimum and a join, so neither edges nor components come to the driver and no task
gathers a node's neighbours: a hub's rows are only joined with its minimum, in a join that deals both sides out
itself, as adaptive execution can split a hub's rows in no other.  Every round is checkpointed to the shared folder, and
the one before it deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import checkpoint, in_few, regrouped, release, settle


def connected_components(edges: DataFrame, most_rounds: int = 60, rows: int | None = None) -> DataFrame:
    """``edges`` (a long, b long) -> (node long, component long) with the smallest id reachable.

    Nodes without an edge to another node have no row; loops, repeats and rows with a null don't count.  ``rows``: how many
    edges there are at most, where that is known.  No round has more rows than the one before it.
    """
    a, b = F.col("a"), F.col("b")
    now = edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now, state = checkpoint(now if rows is None else in_few(now, rows)), None
    rows = now.count()
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(regrouped(least, "u"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(regrouped(least, "u"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, now = now, checkpoint(in_few(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), rows))
        release(last)
        settle(edges.sparkSession)
        before, state = state, now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        rows = state[0]
        if before == state:
            break
    else:
        raise RuntimeError(f"no fixed point after {most_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
