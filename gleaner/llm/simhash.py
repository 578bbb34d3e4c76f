"""SimHash near-duplicates: fingerprints of word shingles, linked through the Gray-order hierarchical index.

``fingerprints`` gives a 64-bit SimHash of each whole text.  ``fingerprint_components`` links equal fingerprints
(collapsed to one row before anything is compared) and those at a few differing bits, and returns the class of
each document.  ``near_duplicates`` is for filtering at a given Jaccard similarity of word shingles: see there.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import as_bytes, batch_of, checkpoint, give_back, in_blocks, in_few, in_pieces, regrouped, release, settle, signed, tidy, whole_text
from gleaner.llm.components import connected_components
from gleaner.llm.hamming import RADIUS, hamming_links

SEED = 42
WORDS = 3
_SHINGLES_AT_ONCE = 1 << 16


def shingles(text: bytes, words: int) -> list[bytes]:
    """Runs of ``words`` words, A-Z lower-cased, single spaces between; fewer words: all of them; none: nothing."""
    parts = text.lower().split()
    if len(parts) <= words:
        return [b" ".join(parts)] if parts else []
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.r_[0, ends[:-1] + 1][: len(parts) - words + 1].tolist()
    return [joined[a:b] for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)]


def hashes(text: bytes, words: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of each shingle, repeats included."""
    digest = xxhash.xxh64_intdigest
    return np.array([digest(s, seed) for s in shingles(text, words)], dtype=np.uint64)


def simhash(h: np.ndarray) -> int:
    """Bits that are set in over half of the hashes; none: zero."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), _SHINGLES_AT_ONCE):
        part = np.ascontiguousarray(h[at : at + _SHINGLES_AT_ONCE])
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h), bitorder="little").tobytes(), "little")


def _fingerprint_batches(words: int):
    def run(batches):
        for batch in in_pieces(batches):
            prints = np.array([simhash(hashes(t, words)) for t in as_bytes(batch.column(1))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(signed(prints))], names=["doc_id", "print"])

    return run


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id long, print long): the SimHash of each whole text, as a signed 64-bit value.

    A null or empty text has print 0; repeated rows and null ids keep their rows; other columns are not read.
    """
    narrow = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"))
    return narrow.mapInArrow(tidy(_fingerprint_batches(words)), "doc_id bigint, print bigint")


def fingerprint_components(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint of 16 hex digits, component_id): the smallest doc_id reachable over links at ``radius``
    bits or fewer; the doc_id itself where there are none.

    Rows with equal text share a fingerprint and so a component.  A null doc_id is linked like any other and
    never is the smallest, unless all ids of a component are null.  An empty table gives no rows.
    """
    prints = checkpoint(fingerprints(docs, words))
    nodes = prints.groupBy("print").agg(F.min("doc_id").alias("first")).select("print", "first", F.col("print").alias("id"))
    nodes = checkpoint(in_few(nodes, prints.count()))
    links = hamming_links(nodes.select("id", "print"), radius)
    classes = connected_components(links, rows=links.count())
    named = nodes.join(classes, nodes["id"] == classes["node"], "left").select("print", "first", F.coalesce("component", "id").alias("class"))
    smallest = named.groupBy("class").agg(F.min("first").alias("component_id"))
    named = checkpoint(in_few(named.join(regrouped(smallest, "class"), "class").select("print", "component_id"), nodes.count()))
    out = prints.join(named, "print")
    return out.select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")


# Near-duplicates at a Jaccard similarity
#
# At five words and a similarity of 0.8 two texts' prints differ in 6 to 13 of 64 bits, as do many pairs that are
# less alike.  So prints within the index's radius are only some of the candidates.  The others come from a prefix
# filter, which loses no link: in any one order of all shingles, two sets at the similarity share one of the first
# ``n - ceil(similarity * n) + 1`` of each, n being a set's own size.  The order is that of ``shingle_order``, seldom
# ones first, so that few sets share one by chance.  Candidates are gathered in classes and every link is decided by
# the exact similarity of whole shingle sets.

STAGE_WORDS, SIMILARITY = 5, 0.8
#: Shingles are ordered by how often texts of a sample, one of so many, have them; counts are kept by hashed shingle.
#: Any order is right, since it only has to be the same for all texts: the counts merely keep classes small.
SAMPLE, COUNT_BITS = 8, 20
#: Ids up to this number are broadcast (16 bytes each and their table); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def _slots(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - COUNT_BITS)).astype(np.int64)


def shingle_order(narrow: DataFrame, words: int) -> np.ndarray:
    """For each slot of hashed shingles, in how many texts of the sample one of them is."""

    def count(batches):
        total = np.zeros(1 << COUNT_BITS, np.int32)
        for batch in in_pieces(batches):
            for text in as_bytes(batch.column(0)):
                total[np.unique(_slots(hashes(text, words)))] += 1
        at = np.flatnonzero(total > 1)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["slot", "n"])

    sample = narrow.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).select("text")
    got = sample.mapInArrow(tidy(count), "slot int, n int").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << COUNT_BITS, np.int32)
    out[got.column("slot").to_numpy()] = np.minimum(got.column("n").to_numpy(), np.iinfo(np.int32).max)
    del got
    give_back()
    return out


def in_order(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A set's shingles (distinct hashes), those that few texts have first."""
    return h[np.lexsort((h, counts[_slots(h)]))]


def prefix_size(n, similarity: float = SIMILARITY):
    """How many of the first of n shingles there are of which a set at the similarity must share one."""
    return n - np.ceil(similarity * n - 1e-9).astype(np.int64) + 1


def prefix(h: np.ndarray, counts: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
    """The shingles of a set (distinct hashes) of which a set at the similarity must share one."""
    return in_order(h, counts)[: int(prefix_size(np.int64(len(h)), similarity))]


def _node(text: bytes) -> int:
    return xxhash.xxh64_intdigest(b" ".join(text.lower().split()), 1)


def size_range(n: np.ndarray, similarity: float) -> np.ndarray:
    """The range that a set's size falls in; sets that are alike enough are in one range or in neighbouring ones."""
    return (np.log(np.maximum(1, n)) / -np.log(similarity) + 1e-9).astype(np.int32)


def _sketches(words: int, similarity: float, counts):
    def run(batches):
        for batch in in_pieces(batches, 500):
            nodes, prints, keys, sizes = [], [], [], []
            for text in as_bytes(batch.column(1)):
                h = hashes(text, words)
                nodes.append(_node(text))
                prints.append(simhash(h))
                distinct = np.unique(h)
                sizes.append(len(distinct))
                keys.append(signed(prefix(distinct, counts.value, similarity)) if len(h) else np.zeros(0, np.int64))
            ends = np.r_[0, np.cumsum([len(k) for k in keys])].astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*keys, np.zeros(0, np.int64)])))
            ints = [pa.array(signed(np.array(x, np.uint64))) for x in (nodes, prints)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *ints, listed, pa.array(size_range(np.array(sizes, np.int64), similarity))], names=["doc_id", "node", "print", "keys", "range"])

    return run


def _named(batches):
    for batch in in_pieces(batches, 500):
        nodes = [_node(text) for text in as_bytes(batch.column(0))]
        yield pa.RecordBatch.from_arrays([pa.array(signed(np.array(nodes, np.uint64))), batch.column(0)], names=["named", "text"])


def _key_rows(batches):
    """(key, range, node, other) of every prefix, for one shuffle.  Of a batch's nodes with one key and range only the least
    goes out with it, so a key that most texts have is a row a batch; the others' edges to it are rows too, with ``other``."""
    for batch in in_pieces(batches, 4000):
        node, size, keys = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
        n = pc.list_value_length(keys).to_numpy()
        key, size, node = keys.flatten().to_numpy(), np.repeat(size, n), np.repeat(node, n)
        order = np.lexsort((node, size, key))
        key, size, node = key[order], size[order], node[order]
        new, least = _runs(node, key, size)
        rest = np.flatnonzero(node != least)
        a, b, at = _distinct(node[rest], least[rest], size[rest])
        none = pa.nulls(int(new.sum()), pa.int64())
        yield batch_of(key=key[new], range=size[new], node=node[new], other=none)
        yield batch_of(key=a, range=at, node=a, other=b)


def _stars(batches):
    """(a, b, range, below) from key rows sorted by key, range and node: edges in a range and, where ``below``, in the next
    smaller one as well.  Nodes of one key are linked if their ranges are the same or neighbours."""
    key, size, node = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64)
    for batch in batches:
        there = pc.is_valid(batch.column(3)).to_numpy(zero_copy_only=False)
        own = [batch.column(c).to_numpy() for c in range(3)]
        edges = [own[2][there], batch.column(3).drop_null().to_numpy(), own[1][there]]
        key, size, node = (np.concatenate([held, x[~there]]) for held, x in zip((key, size, node), own, strict=True))
        new, least = _runs(node, key, size)
        rest = np.flatnonzero(node != least)
        a, b, at = _distinct(*(np.concatenate(x) for x in zip(edges, (node[rest], least[rest], size[rest]), strict=True)))
        yield batch_of(a=a, b=b, range=at, below=np.ones(len(a), bool))
        key, size, node = key[new], size[new], node[new]
        near = np.flatnonzero((key[1:] == key[:-1]) & (size[1:] == size[:-1] + 1) & (node[1:] != node[:-1]))
        a, b, at = _distinct(node[near], node[near + 1], size[near])
        yield batch_of(a=a, b=b, range=at, below=np.zeros(len(a), bool))
        key, size, node = key[-1:], size[-1:], node[-1:]  # the next batch may go on with them


def _runs(node: np.ndarray, *by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where a run of equal values begins, the first node of each row's run)."""
    new = np.ones(len(node), bool)
    new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in by])
    return new, node[np.flatnonzero(new)][np.cumsum(new) - 1]


def _distinct(a: np.ndarray, b: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same triples, each once."""
    order = np.lexsort((at, b, a))
    a, b, at = a[order], b[order], at[order]
    new = _runs(a, a, b, at)[0]
    return a[new], b[new], at[new]


def _packed(batches):
    """Whole texts, compressed, each for the groups that it is wanted in: a fraction of what its shingles' hashes take."""
    codec = pa.Codec("zstd")
    for batch in in_blocks(batches, 2):
        rows = []
        for groups, node, text in zip(*(batch.column(k).to_pylist() for k in range(2)), as_bytes(batch.column(2)), strict=True):
            if int(signed(np.array([_node(text)], np.uint64))[0]) != node:
                continue  # another text of the same doc_id
            words = b" ".join(text.lower().split())
            packed = codec.compress(words, asbytes=True)
            rows += [(group, node, len(words), packed) for group in groups]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["group", "node", "size", "packed"])


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of every range, one after another."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())


def similar_labels(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Labels of the classes that pairs of shingle sets at the similarity or more make; sets are in order, rare shingles first.

    Only sets that share one of their first shingles are compared.  First leaders, each the first set that no leader
    before it took: a leader takes all that are like it, so a group of near copies is gone through once for each of its
    few leaders.  Then the others, each with those only that are in another class by now.
    """
    sizes = np.array([len(s) for s in sets])
    label = np.arange(len(sets))
    if not sizes.sum():
        return label
    element = np.unique(np.concatenate(sets), return_inverse=True)[1]
    begins = np.cumsum(sizes) - sizes
    firsts = np.where(sizes > 0, prefix_size(sizes, similarity), 0)
    at = _ranges(begins, firsts)
    owner, key = np.repeat(np.arange(len(sets)), firsts), element[at]
    marked = np.zeros(int(element.max()) + 1, bool)

    def root(i: int) -> int:
        while label[i] != i:
            label[i] = label[label[i]]
            i = int(label[i])
        return i

    def take(i: int, candidates: np.ndarray) -> np.ndarray:
        """Join the class of i with those of the candidates that are like it, and return these."""
        j = np.unique(candidates)
        j = j[(j != i) & (sizes[j] >= similarity * sizes[i] - 1e-9) & (similarity * sizes[j] - 1e-9 <= sizes[i])]
        if not len(j):
            return j
        mine = element[begins[i] : begins[i] + sizes[i]]
        marked[mine] = True
        common = np.add.reduceat(marked[element[_ranges(begins[j], sizes[j])]], np.cumsum(sizes[j]) - sizes[j], dtype=np.int64)
        marked[mine] = False
        j = j[common >= similarity * (sizes[i] + sizes[j] - common) - 1e-9]
        for k in j.tolist():
            a, b = root(i), root(k)
            label[max(a, b)] = min(a, b)
        return j

    order = np.argsort(key, kind="stable")
    holders, starts = owner[order], np.searchsorted(key[order], np.arange(len(marked) + 1))
    taken = np.zeros(len(sets), bool)
    for i in range(len(sets)):
        if not taken[i] and sizes[i]:
            mine = element[begins[i] : begins[i] + firsts[i]]
            taken[take(i, holders[_ranges(starts[mine], starts[mine + 1] - starts[mine])])] = True
    label[:] = [root(i) for i in range(len(sets))]
    # what a key's holders are in other classes than one's own: sorted by class, two ranges
    order = np.lexsort((label[owner], key))
    holders, keys, classes = owner[order], key[order], label[owner[order]]
    mixed = np.zeros(len(marked), bool)
    mixed[keys[1:][(keys[1:] == keys[:-1]) & (classes[1:] != classes[:-1])]] = True
    here = mixed[keys]
    holders, keys, classes = holders[here], keys[here], classes[here]
    new = np.r_[True, (keys[1:] != keys[:-1]) | (classes[1:] != classes[:-1])] if len(keys) else np.zeros(0, bool)
    run_begin = np.flatnonzero(new)
    run_end = np.r_[run_begin[1:], len(keys)] if len(keys) else run_begin
    run = np.cumsum(new) - 1
    key_begin, key_end = np.searchsorted(keys, keys, "left"), np.searchsorted(keys, keys, "right")
    order = np.argsort(holders, kind="stable")
    ends = np.searchsorted(holders[order], np.arange(len(sets) + 1))
    for i in np.flatnonzero(taken & (np.diff(ends) > 0)).tolist():
        p = order[ends[i] : ends[i + 1]]
        begin, end = np.r_[key_begin[p], run_end[run[p]]], np.r_[run_begin[run[p]], key_end[p]]
        take(i, holders[_ranges(begin, end - begin)])
    return np.array([root(i) for i in range(len(sets))])


def _verify(words: int, similarity: float, counts):
    """For mapInArrow over packed texts sorted by group and node: a spanning forest of the links of each group."""

    def links(rows):
        if len(rows) < 2:
            return
        ids = np.array([r[0] for r in rows])
        label = similar_labels([r[1] for r in rows], similarity)
        moved = label != np.arange(len(label))
        if moved.any():
            yield pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[label[moved]])], names=["a", "b"])

    def run(batches):
        codec = pa.Codec("zstd")
        key, rows = None, []
        for batch in batches:
            for group, node, size, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group != key:
                    yield from links(rows)
                    key, rows = group, []
                if not rows or rows[-1][0] != node:
                    text = codec.decompress(packed, size, asbytes=True) if size else b""
                    rows.append((node, in_order(np.unique(hashes(text, words)), counts.value)))
        yield from links(rows)

    return run


def near_duplicates(docs: DataFrame, words: int = STAGE_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, group_id) of every row: the smallest doc_id reachable over pairs whose word shingles have a Jaccard
    similarity of ``similarity`` or more, its own where there are none.

    Texts equal but for case and white space are one node from the start.  Texts without words are alike.  A null
    doc_id is grouped but is no group's id while another is there.  Candidates are classes of sets of like sizes
    that shared shingles connect; a task holds the sets of one such class.  A text takes part once, whether or not its rows
    have ids.
    """
    spark = docs.sparkSession
    narrow = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"))
    counts = spark.sparkContext.broadcast(shingle_order(narrow, words))
    rows, nodes, candidates = _candidates(narrow, words, similarity, counts)
    settle(spark)
    members = _members(nodes, candidates)
    release(candidates)
    few = F.broadcast(members) if members.count() <= BROADCAST_IDS else members
    texts = narrow.join(few, narrow["doc_id"] == few["first"]).select("groups", "node", "text")
    if members.where("first is null").count():
        named = narrow.where("doc_id is null").select("text").mapInArrow(tidy(_named), "named bigint, text string")
        without = members.where("first is null").select("groups", "node")
        texts = texts.unionByName(named.join(without, named["named"] == without["node"]).select("groups", "node", "text"))
    packed = texts.mapInArrow(tidy(_packed), "group bigint, node bigint, size bigint, packed binary")
    links = checkpoint(packed.repartition("group").sortWithinPartitions("group", "node").mapInArrow(tidy(_verify(words, similarity, counts)), "a bigint, b bigint"))
    release(members)
    settle(spark)
    classes = connected_components(links)
    named = nodes.select("node", "first").join(classes, "node", "left").select("node", "first", F.coalesce("component", "node").alias("class"))
    smallest = named.groupBy("class").agg(F.min("first").alias("group_id"))
    named = checkpoint(named.join(regrouped(smallest, "class"), "class").select("node", "group_id"))
    for done in (links, nodes):
        release(done)
    settle(spark)
    return rows.join(named, "node").select("doc_id", "group_id")


def _candidates(narrow: DataFrame, words: int, similarity: float, counts) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id and node of every row; first, print and range of every node; the component of nodes in ranges).

    Candidates are sought among sets of like sizes: a node is one in its own range and one in the next smaller.
    """
    spark = narrow.sparkSession
    sketch = checkpoint(narrow.mapInArrow(tidy(_sketches(words, similarity, counts)), "doc_id bigint, node bigint, print bigint, keys array<bigint>, range int"))
    rows = checkpoint(sketch.select("doc_id", "node"))
    nodes = checkpoint(sketch.groupBy("node").agg(F.min("doc_id").alias("first"), F.min("print").alias("print"), F.min("range").alias("range")))
    keyed = sketch.select("node", "range", "keys").mapInArrow(tidy(_key_rows), "key bigint, range int, node bigint, other bigint")
    stars = keyed.repartition("key").sortWithinPartitions("key", "range", "node").mapInArrow(tidy(_stars), "a bigint, b bigint, range int, below boolean")
    stars = checkpoint(stars.distinct())
    release(sketch)
    settle(spark)
    both = F.array("range", F.col("range") - 1)
    within = lambda node: F.xxhash64(node, "range")
    by_key = stars.select("a", "b", F.explode(F.when(F.col("below"), both).otherwise(F.array("range"))).alias("range"))
    by_print = nodes.groupBy("print").agg(F.min_by(F.struct("node", "range"), "node").alias("least")).select("print", F.col("least.node").alias("id"), F.col("least.range").alias("range"))
    by_print = checkpoint(by_print)
    same = nodes.join(regrouped(by_print.drop("range"), "print"), "print").select(F.col("node").alias("a"), F.col("id").alias("b"), F.explode(both).alias("range"))
    near = hamming_links(by_print.select("id", "print")).join(by_print.select(F.col("id").alias("a"), "range"), "a").select("a", "b", F.explode(both).alias("range"))
    found = connected_components(by_key.unionByName(same).unionByName(near).select(within("a").alias("a"), within("b").alias("b")))
    for done in (stars, by_print):
        release(done)
    return rows, nodes, found


def _members(nodes: DataFrame, candidates: DataFrame) -> DataFrame:
    """(node, first, groups): the classes of candidates that each node's set is wanted in.

    A class whose sets are all in the smaller of its two ranges is part of a class one range below, so it isn't gone through.
    """
    ranged = nodes.select("node", "first", "range", F.explode(F.array("range", F.col("range") - 1)).alias("at"))
    ranged = ranged.select("node", "first", F.xxhash64("node", "at").alias("within"), (F.col("range") > F.col("at")).alias("upper"))
    ranged = checkpoint(ranged.join(candidates.withColumnRenamed("node", "within"), "within").select("node", "first", "component", "upper"))
    several = ranged.groupBy("component").agg(F.count("*").alias("n"), F.max("upper").alias("any")).where("n > 1 and any").select("component")
    wanted = ranged.join(regrouped(several, "component"), "component", "left_semi")
    members = checkpoint(wanted.groupBy("node").agg(F.min("first").alias("first"), F.collect_list("component").alias("groups")))
    release(ranged)
    return members


def without_near_duplicates(docs: DataFrame, words: int = STAGE_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs``, all their columns, but those whose group has a smaller doc_id.

    Rows of one doc_id stay or go together; those without doc_id stay.
    """
    gone = checkpoint(near_duplicates(docs, words, similarity).where("group_id <> doc_id").select(F.col("doc_id").alias("gone_")).distinct())
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return docs.join(gone, docs["doc_id"] == gone["gone_"], "left_anti")
