"""Benchmark decontamination by latent semantic retrieval, checked by longest common subsequences and answers.

Passages of a text are runs of ``2 * STEP`` words, one every ``STEP`` words.  Their TF-IDF vectors are over hashed
words, with document frequencies of all documents.  The latent space is that of a randomised SVD of the benchmark's
passages: every pass multiplies a block of vectors by the matrix and its transpose where the rows are and adds up
the parts by feature.  The documents' passages are projected and compared by cosine with the benchmark's; a projection
is no longer than what of a passage lies on the benchmark's words, and each word adds no more to a product than its
most for any item, so most passages are told without.  What
is near goes to an exact check in the same place: the longest common subsequence of words within a window little
longer than the item, and, where an item has an answer, whether the window has it too.

A space of ``RANK`` dimensions holds the passages of many items only in part, so a low cosine rules nothing out.
Places that share as many of an item's rarest words as its subsequence cannot do without are therefore checked too,
whatever their cosine: if ``needs`` of an item's n words are in a window, then ``m`` of any ``n - needs + m`` of them are.
With both, no text is missed that the exact check would find.

The benchmark is taken ``MOST_ITEMS`` items at a time, which bounds what is broadcast; documents are only read, in
blocks of bounded size.  What a block is turned into is some 40 bytes for each word, also for a very long text.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import give_back, in_blocks, tidy, whole_text, words_in

STEP = 16
BITS = 18
FEATURES = 1 << BITS
RANK, SPARE, PASSES, SEED = 192, 16, 3, 11
NEAR = 0.55
LEAST_LCS = 0.75
LEAST_ANSWER = 0.75
#: One in so many of the words that an item needs must be among its rare ones.
RARE_SHARE = 4
#: Passages projected at once.
PASSAGES_AT_ONCE = 2048
MOST_ITEMS = 20_000
_WORD = re.compile(r"\w+")
_ANSWER = re.compile(r"(?is)\banswer\s*:\s*(.+)$|\?\s+([^?]+)$")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def hashes_of(words: list[str]) -> np.ndarray:
    """XXH64 of words; equal hashes count as equal words."""
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))


def features_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BITS)).astype(np.int32)


def text_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words of all texts one after another, where each text's begin and the last end)."""
    numbers, offsets, words = words_in(texts, _WORD, pc.utf8_is_alnum)
    return hashes_of(words)[numbers], offsets


def _frequency_rows(counts: np.ndarray) -> pa.RecordBatch:
    at = np.flatnonzero(counts)
    return pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["feature", "n"])


def _frequencies(batches):
    counts = np.zeros(FEATURES, np.int64)
    for batch in in_blocks(batches, 0):
        h, offsets = text_hashes(batch.column(0))
        f = features_of(h)
        doc = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
        seen = np.sort(doc << BITS | f)
        counts += np.bincount(seen[np.r_[True, seen[1:] != seen[:-1]]] & FEATURES - 1 if len(seen) else seen, minlength=FEATURES)
    yield _frequency_rows(counts)


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """log((1 + n) / (1 + documents with the feature)) + 1 over all documents."""
    counted = docs.select(whole_text().alias("text")).mapInArrow(tidy(_frequencies), "feature int, n bigint").groupBy("feature").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(FEATURES)
    df[counted.column("feature").to_numpy()] = counted.column("n").to_numpy()
    return (np.log((1 + docs.count()) / (1 + df)) + 1).astype(np.float32)


def _passages(n: int) -> list[tuple[int, int]]:
    """Spans of the passages of n words; the last one reaches the end."""
    return [(a, min(n, a + 2 * STEP)) for a in range(0, max(1, n - STEP), STEP)] if n else []


def _vectors(text: str, idf: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(features, TF-IDF weights) of a text's passages, of unit length."""
    f, out = features_of(hashes_of(words_of(text))), []
    for a, b in _passages(len(f)):
        seen, n = np.unique(f[a:b], return_counts=True)
        x = n * idf[seen]
        out.append((seen, (x / np.linalg.norm(x)).astype(np.float32)))
    return out


def svd(items: DataFrame, idf: np.ndarray, rank: int = RANK, passes: int = PASSES, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features that occur, right singular vectors by those features, singular values) of the items' passages.

    Subspace iteration from a seeded random block: V <- orth(A'(A V)).  A task holds its rows' part of A'(A V); parts
    are added by feature on the executors, so the driver gets one row per feature.
    """
    spark = items.sparkSession
    texts = items.select(whole_text().alias("text"))
    shared_idf = spark.sparkContext.broadcast(idf)

    def present(batches):
        seen = set()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                seen.update(features_of(hashes_of(words_of(t))).tolist())
        yield pa.RecordBatch.from_arrays([pa.array(sorted(seen), pa.int32())], names=["feature"])

    used = np.sort(texts.mapInArrow(tidy(present), "feature int").distinct().toArrow().column(0).to_numpy())
    width = min(rank + SPARE, max(1, len(used)))
    block = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(used), width)))[0] if len(used) else np.zeros((0, 0))

    def multiplied(v: np.ndarray) -> np.ndarray:
        shared = spark.sparkContext.broadcast((used, v.astype(np.float32)))

        def run(batches):
            used_, v_ = shared.value
            total = np.zeros(v_.shape, np.float32)
            for batch in batches:
                for t in batch.column(0).to_pylist():
                    for f, x in _vectors(t, shared_idf.value):
                        at = np.searchsorted(used_, f)
                        total[at] += np.outer(x, x @ v_[at])
            at = np.flatnonzero(total.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array([r.tobytes() for r in total[at]], pa.binary())], names=["k", "part"])

        def added(batches):
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                for k, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    sums[k] = sums.get(k, 0) + np.frombuffer(part, np.float32)
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([np.asarray(s, np.float32).tobytes() for s in sums.values()], pa.binary())], names=["k", "part"])

        got = texts.mapInArrow(tidy(run), "k int, part binary").repartition("k").mapInArrow(tidy(added), "k int, part binary").toArrow()
        out = np.zeros(v.shape)
        for k, part in zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True):
            out[k] = np.frombuffer(part, np.float32)
        return out

    if not len(used):
        return used, block, np.zeros(0)
    for _ in range(passes):
        block = np.linalg.qr(multiplied(block))[0]
    values, turn = np.linalg.eigh(block.T @ multiplied(block))
    best = np.argsort(-values)[:rank]
    return used, (block @ turn[:, best]).astype(np.float32), np.sqrt(np.maximum(values[best], 0))


def lcs(a: list, b: list) -> int:
    """Length of the longest common subsequence, a bit for each element of a."""
    at: dict = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    full, row = (1 << len(a)) - 1, (1 << len(a)) - 1
    for w in b:
        m = row & at.get(w, 0)
        row = (row + m | row - m) & full
    return len(a) - row.bit_count()


def answer_of(text: str) -> list[str]:
    """The words after "answer:", or after a last question mark; most items have none."""
    found = _ANSWER.search(text)
    return words_of(found[1] or found[2]) if found else []


@dataclass
class Matcher:
    """A group of benchmark items with their place in the latent space."""

    ids: list[int]
    texts: list[str]
    idf: np.ndarray
    used: np.ndarray
    basis: np.ndarray
    near: float = NEAR
    least: float = LEAST_LCS

    def __post_init__(self):
        self.words = [hashes_of(words_of(t)).tolist() for t in self.texts]
        self.sets = [set(w) for w in self.words]
        self.answers = [hashes_of(answer_of(t)).tolist() for t in self.texts]
        self.row = np.full(FEATURES, -1, np.int32)
        self.row[self.used] = np.arange(len(self.used))
        owners, places = [], []
        for k, t in enumerate(self.texts):
            for f, x in _vectors(t, self.idf):
                z = x @ self.basis[self.row[f]]
                if np.linalg.norm(z) > 0:
                    owners.append(k)
                    places.append(z / np.linalg.norm(z))
        self.owners = np.array(owners, np.int64)
        self.places = np.array(places, np.float32).reshape(len(owners), self.basis.shape[1])
        # the most that one unit of a feature can add to a product with an item's place
        most = [(self.basis[a : a + 4096] @ self.places.T).max(axis=1, initial=0.0) for a in range(0, len(self.basis), 4096)]
        self.most = np.concatenate([*most, np.zeros(0, np.float32)])
        self.needs = np.array([max(1, math.ceil(self.least * len(w) - 1e-9)) for w in self.words], np.int64)
        self.wides = np.array([self.wide(len(w)) for w in self.words], np.int64)
        self.rare_needs = np.maximum(1, self.needs // RARE_SHARE)
        # each item's rarest words, and by feature the items that have it among those
        rare = []
        for w, needs, m in zip(self.words, self.needs.tolist(), self.rare_needs.tolist(), strict=True):
            f = features_of(np.array(w, np.uint64))
            rare.append(np.unique(f[np.argsort(-self.idf[f], kind="stable")[: len(f) - needs + m]]))
        f = np.concatenate([*rare, np.zeros(0, np.int32)])
        order = np.argsort(f, kind="stable")
        self.holders = np.repeat(np.arange(len(rare)), list(map(len, rare)))[order]
        self.starts = np.searchsorted(f[order], np.arange(FEATURES + 1))

    @staticmethod
    def wide(n: int) -> int:
        """Words of a window for an item of n words."""
        return n + max(4, n // 4)

    def near_passages(self, f: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(text, item, first word in the text, cosine) as rows, of the passages near an item; texts as for ``text_hashes``."""
        n = np.diff(offsets)
        cells = -(-n // STEP)  # runs of STEP words; a passage is two of a text, or its only one
        first = np.cumsum(cells) - cells
        start = np.repeat(offsets[:-1] - first * STEP, cells) + np.arange(cells.sum()) * STEP
        if not len(start) or not len(self.owners):
            return np.zeros((4, 0))
        square = np.add.reduceat(self.idf[f] ** 2, start, dtype=np.float64)
        text = np.repeat(np.arange(len(n)), cells)
        last = np.r_[text[1:] != text[:-1], True]
        p = np.flatnonzero(~last | np.repeat(cells == 1, cells))
        length = np.sqrt(square[p] + np.where(last[p], 0, square[np.minimum(p + 1, len(square) - 1)]))
        size = np.minimum(start[p] + 2 * STEP, offsets[1:][text[p]]) - start[p]
        out = []
        for at in range(0, len(p), PASSAGES_AT_ONCE):
            part = slice(at, at + PASSAGES_AT_ONCE)
            a, m, far = start[p[part]], size[part], length[part]
            words = f[np.repeat(a - (np.cumsum(m) - m), m) + np.arange(m.sum())]
            owner, rows = np.repeat(np.arange(len(a)), m), self.row[words]
            here = rows >= 0
            key, back = np.unique(owner[here] * len(self.used) + rows[here], return_inverse=True)
            weight = np.bincount(back, self.idf[words[here]], len(key))
            owner, rows = key // len(self.used), key % len(self.used)
            within = np.minimum(np.sqrt(np.bincount(owner, weight**2, len(a))), np.bincount(owner, weight * self.most[rows], len(a)))
            keep = (within * 1.0001 >= self.near * far)[owner]
            owner, rows, weight = owner[keep], rows[keep], weight[keep]
            if not len(owner):
                continue
            begins = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            sums = np.add.reduceat(self.basis[rows] * weight[:, None].astype(np.float32), begins, axis=0)
            owner = owner[begins]
            product = sums @ self.places.T
            x, y = np.nonzero(product >= (self.near * far[owner])[:, None])
            which = p[part][owner[x]]
            out.append(np.stack([text[which], self.owners[y], start[which] - offsets[text[which]], product[x, y] / far[owner[x]]]))
        return np.concatenate([np.zeros((4, 0)), *out], axis=1)

    def rare_places(self, f: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(text, item, first word in the text) as rows, where an item's rare words are close enough together."""
        at = np.flatnonzero(self.starts[f] < self.starts[f + 1])
        first, many = self.starts[f[at]], self.starts[f[at] + 1] - self.starts[f[at]]
        item = self.holders[np.repeat(first - (np.cumsum(many) - many), many) + np.arange(many.sum())]
        place = np.repeat(at, many)
        order = np.argsort(item, kind="stable")
        item, place = item[order], place[order]
        text = np.searchsorted(offsets, place, "right") - 1
        other = np.arange(len(item)) + self.rare_needs[item] - 1  # the last of as many as there must be
        here = other < len(item)
        k, o = np.flatnonzero(here), other[here]
        close = (item[k] == item[o]) & (text[k] == text[o]) & (place[o] - place[k] < self.wides[item[k]])
        k = k[close]
        # places of one item in one text less than a passage apart are one
        group = (place[k] - offsets[text[k]]) // (2 * STEP)
        new = np.r_[True, (item[k][1:] != item[k][:-1]) | (text[k][1:] != text[k][:-1]) | (group[1:] != group[:-1])] if len(k) else np.zeros(0, bool)
        k = k[new]
        return np.stack([text[k], item[k], place[k] - offsets[text[k]]])

    def check(self, h: np.ndarray, item: int, start: int) -> tuple[float, float]:
        """The best (share of the item, share of its answer) in the windows about a passage of the text with hashes ``h``."""
        mine, answer = self.words[item], self.answers[item]
        wide = int(self.wides[item])
        low = max(0, start - wide)
        words = h[low : start + 2 * STEP + wide].tolist()
        common, best, spare = self.sets[item], (0.0, 0.0), (1 - self.least) * len(mine) + 1e-9
        if len(common.difference(words)) > spare:  # each costs a word of the subsequence
            return best
        for a in range(0, max(1, len(words) - wide // 2), max(1, len(mine) // 8)):
            window = words[a : a + wide]
            if len(common.difference(window)) > spare:
                continue
            share = lcs(mine, window) / len(mine)
            if share > best[0]:
                best = share, lcs(answer, window) / len(answer) if answer else 1.0
        return best

    def match(self, texts: pa.Array) -> list[tuple[int, int, float, float]]:
        """(number of the text, item id, cosine, share of the item) for every item that a text holds."""
        if not self.ids:
            return []
        h, offsets = text_hashes(texts)
        f = features_of(h)
        near = self.near_passages(f, offsets)
        cosines: dict[tuple[int, int], float] = {}
        todo: dict[int, dict[tuple[int, int], None]] = {}
        for text, item, start, cosine in zip(*(near[:3].astype(np.int64).tolist()), near[3].tolist(), strict=True):
            cosines[text, item] = max(cosine, cosines.get((text, item), 0.0))
            todo.setdefault(text, {})[item, start] = None
        for text, item, start in zip(*self.rare_places(f, offsets).tolist(), strict=True):
            todo.setdefault(text, {})[item, start] = None
        found = []
        for text in sorted(todo):
            words, held = h[offsets[text] : offsets[text + 1]], {}
            for item, start in todo[text]:
                if item not in held:
                    share, answered = self.check(words, item, start)
                    if share >= self.least and answered >= LEAST_ANSWER:
                        held[item] = share
            found += [(text, self.ids[k], cosines.get((text, k), 0.0), held[k]) for k in sorted(held)]
        return found


def matchers(docs: DataFrame, benchmark: DataFrame):
    """A Matcher for each group of at most MOST_ITEMS items; items without words are left out."""
    items = benchmark.select(F.col("item_id").cast("long"), whole_text().alias("text")).where("item_id is not null and text rlike '\\\\w'")
    groups = max(1, -(-items.count() // MOST_ITEMS * 5 // 4)) if items.count() > MOST_ITEMS else 1
    idf = inverse_frequencies(docs)
    for g in range(groups):
        mine = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)) == g)
        used, basis, _ = svd(mine, idf)
        listed = mine.orderBy("item_id", "text").toArrow()
        give_back()
        yield Matcher(listed.column(0).to_pylist(), listed.column(1).to_pylist(), idf, used, basis)


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, cosine, lcs): every pair of a document and an item that it holds.

    A null text is empty and holds nothing; neither does anything hold an item without words, or one without id.
    Repeated rows and null doc_ids have their own rows.  Other columns are not read.
    """
    out = None
    for m in matchers(docs, benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(m)

        def run(batches, shared=shared):
            for batch in in_blocks(batches):
                rows = shared.value.match(batch.column(1))
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
                which = batch.column(0).take(pa.array(columns[0], pa.int64()))
                rest = [pa.array(c, k) for c, k in zip(columns[1:], (pa.int64(), pa.float64(), pa.float64()), strict=True)]
                yield pa.RecordBatch.from_arrays([which, *rest], names=["doc_id", "item_id", "cosine", "lcs"])

        found = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")).mapInArrow(tidy(run), "doc_id bigint, item_id bigint, cosine double, lcs double")
        out = found if out is None else out.unionByName(found)
    return out


def _holder(shared):
    @F.arrow_udf("boolean")
    def holds(texts: pa.Array) -> pa.Array:
        out = np.zeros(len(texts), bool)
        at = 0
        for batch in in_blocks([pa.RecordBatch.from_arrays([texts], names=["text"])], 0):
            out[[at + row[0] for row in shared.value.match(batch.column(0))]] = True
            at += batch.num_rows
        give_back()
        return pa.array(out)

    return holds


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all their columns, whose text holds no item.  No row is moved."""
    kept = docs
    for m in matchers(docs, benchmark):
        holds = _holder(docs.sparkSession.sparkContext.broadcast(m))
        kept = kept.where(~holds(whole_text()))
    return kept
