"""Links between 64-bit fingerprints at a few differing bits, by a Gray-order hierarchical index.

Inside a group of fingerprints (``HammingIndex``) the fingerprints are sorted by their rank in the reflected
Gray code, which brings those with like bits together.  Runs of them form leaves and runs of leaves form upper
nodes; a node keeps the bits that all below it share (a mask and a pattern).  A pair of nodes carries the number
of differences found so far on bits both share; a child adds only those on bits its parents did not share, and
a pair beyond the radius is dropped with everything below it.

Across the cluster (``hamming_links``) groups are made by bit blocks: of five blocks, fingerprints within three
bits agree on at least two, so each fingerprint goes to the ten groups of its pairs of blocks.  A group beyond
``limit`` is dealt anew by pairs of blocks of its other bits; after two such rounds 15 bits
are left at most, so a group has no more than 2**15 different fingerprints.  Nothing is dropped: the result is exact at every size.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import checkpoint, signed, tidy

RADIUS, BLOCKS, LIMIT, LEVELS = 3, 5, 4096, 3
FAN_OUT, SMALL = 8, 24
PAIRS_AT_ONCE = 1 << 20
FULL = (1 << 64) - 1


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each value in the reflected Gray code."""
    r = np.array(x, dtype=np.uint64)
    for s in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(s)
    return r


def sub_masks(used: int, radius: int = RADIUS, blocks: int = BLOCKS) -> list[int]:
    """Masks of the pairs of blocks that the bits outside ``used`` fall into."""
    free = [i for i in range(64) if not used >> i & 1]
    parts = [sum(1 << int(i) for i in part) for part in np.array_split(free, blocks)]
    return [sum(c) for c in combinations(parts, blocks - radius)]


class HammingIndex:
    """A hierarchical index over distinct fingerprints; ``pairs`` lists the links inside it in bounded blocks."""

    def __init__(self, prints: np.ndarray, fan_out: int = FAN_OUT):
        rank = gray_rank(prints)
        self.order = np.argsort(rank, kind="stable")
        self.prints, self.fan_out = np.asarray(prints, dtype=np.uint64)[self.order], fan_out
        self.levels = [(np.full(len(prints), FULL, dtype=np.uint64), self.prints)]
        while len(self.levels[-1][0]) > fan_out:
            mask, pattern = self.levels[-1]
            starts = np.arange(0, len(mask), fan_out)
            ones = np.bitwise_and.reduceat(pattern & mask, starts)
            zeros = np.bitwise_and.reduceat(~pattern & mask, starts)
            self.levels.append((ones | zeros, ones))

    def _below(self, level: int, i: np.ndarray, j: np.ndarray, far: np.ndarray, seen: np.ndarray):
        """The pairs of children of node pairs: their numbers, and what their parents found."""
        f, n = self.fan_out, len(self.levels[level][0])
        a, b = np.meshgrid(np.arange(f), np.arange(f), indexing="ij")
        ci = (i[:, None] * f + a.ravel()).ravel()
        cj = (j[:, None] * f + b.ravel()).ravel()
        keep = (cj < n) & (ci < n) & (ci <= cj if level else ci < cj)
        return ci[keep], cj[keep], np.repeat(far, f * f)[keep], np.repeat(seen, f * f)[keep]

    def _near(self, level: int, i, j, far, seen, radius: int):
        mask, pattern = self.levels[level]
        common = mask[i] & mask[j]
        far = far + np.bitwise_count((pattern[i] ^ pattern[j]) & common & ~seen)
        keep = far <= radius
        return i[keep], j[keep], far[keep], common[keep]

    def pairs(self, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions (in the fingerprints as given) of all pairs within ``radius``."""
        top = len(self.levels) - 1
        n = len(self.levels[top][0])
        i, j = np.triu_indices(n, 0 if top else 1)
        todo = [(top, *self._near(top, i, j, np.zeros(len(i), np.int64), np.zeros(len(i), np.uint64), radius))]
        step = max(1, PAIRS_AT_ONCE // self.fan_out**2)
        while todo:
            level, i, j, far, seen = todo.pop()
            if not level:
                if len(i):
                    yield self.order[i], self.order[j]
                continue
            for at in range(0, len(i), step):
                part = [x[at : at + step] for x in (i, j, far, seen)]
                todo.append((level - 1, *self._near(level - 1, *self._below(level - 1, *part), radius)))


def merge(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels after joining the classes of i and j; labels are positions of class members."""
    while True:
        a, b = label[i], label[j]
        differ = a != b
        if not differ.any():
            return label
        i, j, a, b = i[differ], j[differ], a[differ], b[differ]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            jump = label[label]
            if np.array_equal(jump, label):
                break
            label = jump


def group_links(prints: np.ndarray, ids: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links in one group: (id, id of its class's first member)."""
    label = np.arange(len(prints))
    for i, j in HammingIndex(prints).pairs(radius):
        label = merge(label, i, j)
    moved = label != np.arange(len(label))
    return ids[moved], ids[label[moved]]


OUT = "hot boolean, key bigint, print bigint, id bigint, used bigint"


def _rows(hot: bool, key, prints, ids, used) -> pa.RecordBatch:
    n = len(ids)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, hot)), *(pa.array(np.ascontiguousarray(x).astype(np.int64, copy=False)) for x in (key, prints, ids, used))],
        names=["hot", "key", "print", "id", "used"],
    )


def _redealt(prints: np.ndarray, ids: np.ndarray, key: int, used: int, radius: int) -> Iterator[pa.RecordBatch]:
    """Rows of a hot group, for the groups by its other bits."""
    for k, m in enumerate(sub_masks(used & FULL, radius)):
        with np.errstate(over="ignore"):
            x = (prints.view(np.uint64) & np.uint64(m)) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(key & FULL)
            x = (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(k)
        fixed = np.full(len(ids), (used & FULL) | m, dtype=np.uint64)
        yield _rows(True, signed(x ^ x >> np.uint64(32)), prints, ids, signed(fixed))


def linker(level: int, limit: int, radius: int):
    """For mapInArrow over rows (key, print, id, used) sorted by key: edges, and the rows of groups beyond the limit."""

    def run(batches):
        def finished(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            """Whole groups of at most the limit."""
            key, prints, ids = rows[0], rows[1].view(np.uint64), rows[2]
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            sizes = np.diff(np.r_[starts, len(key)])
            group = np.repeat(np.arange(len(starts)), sizes)
            few = (sizes[group] > 1) & (sizes[group] <= SMALL)
            found = []
            at = np.flatnonzero(few)
            for off in range(1, SMALL):
                at = at[at + off < len(key)]
                at = at[group[at] == group[at + off]]
                if not len(at):
                    break
                hit = at[np.bitwise_count(prints[at] ^ prints[at + off]) <= radius]
                found.append((ids[hit], ids[hit + off]))
            for g in np.flatnonzero(sizes > SMALL):
                part = slice(starts[g], starts[g] + sizes[g])
                found.append(group_links(prints[part], ids[part], radius))
            a, b = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
            if len(a):
                e = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
                yield _rows(False, np.zeros(e.shape[1]), e[0], e[1], np.zeros(e.shape[1]))

        def redealt(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            yield from _redealt(rows[1], rows[2], int(rows[0][0]), int(rows[3][0]), radius)

        last_level = level >= LEVELS - 1
        held = np.empty((4, 0), np.int64)  # the group that the last batch ended in
        hot_key = None  # its key instead, once it is beyond the limit
        for batch in batches:
            rows = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "print", "id", "used")])
            if hot_key is not None:
                more = int((rows[0] == hot_key).sum())
                if more:
                    yield from redealt(rows[:, :more])
                rows = rows[:, more:]
            if not rows.shape[1]:
                continue
            hot_key, rows = None, np.concatenate([held, rows], axis=1)
            starts = np.flatnonzero(np.r_[True, rows[0][1:] != rows[0][:-1]])
            sizes = np.diff(np.r_[starts, rows.shape[1]])
            hot = np.full(len(starts), False) if last_level else sizes > limit
            for g in np.flatnonzero(hot):
                yield from redealt(rows[:, starts[g] : starts[g] + sizes[g]])
            done = np.repeat(~hot, sizes)
            done[starts[-1] :] = False
            if done.any():
                yield from finished(rows[:, done])
            held = rows[:, :0] if hot[-1] else rows[:, starts[-1] :]
            hot_key = int(rows[0][-1]) if hot[-1] else None
        if held.shape[1]:
            yield from finished(held)

    return run


def hamming_links(prints: DataFrame, radius: int = RADIUS, limit: int = LIMIT) -> DataFrame:
    """``prints`` (id long, print long), each print once -> edges (a long, b long) whose connected components are
    those of all pairs within ``radius`` bits."""
    masks = [F.lit(int(signed(np.array([m], np.uint64))[0])) for m in sub_masks(0, radius)]
    bits = F.col("print")
    deals = F.array(*(F.struct(F.xxhash64(F.lit(k), bits.bitwiseAND(m)).alias("key"), m.alias("used")) for k, m in enumerate(masks)))
    rows = prints.select("id", "print", F.explode(deals).alias("d")).select("d.key", "print", "id", "d.used")
    edges = None
    for level in range(LEVELS):
        done = checkpoint(rows.repartition("key").sortWithinPartitions("key").mapInArrow(tidy(linker(level, limit, radius)), OUT))
        found = done.where("not hot").select(F.col("print").alias("a"), F.col("id").alias("b"))
        edges = found if edges is None else edges.unionByName(found)
        rows = done.where("hot").select("key", "print", "id", "used")
        if rows.isEmpty():
            break
    return edges
