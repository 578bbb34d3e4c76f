"""Token-id output compressed by Re-Pair grammars, one grammar per shard file.

Documents are dealt to shards by ranges of doc_id, so shards in order hold the ids in order.  In a shard, frequent
neighbouring ids are replaced by new symbols, round after round, until no pair reaches the least count or no symbol is
left: each round counts all pairs, takes the most frequent ones, and replaces them from left to right.  The document end is
never part of a pair, so every document is its own run of symbols and can be decoded alone.  The file has the rules,
the length that each symbol expands to, the symbols, and for each document its id and where its run begins.

Layout, little-endian: b"GRPR", version, vocabulary size, rules m, documents d (u32 each), symbols n (u64);
m x (left, right); m lengths u32; d doc_ids i64; d flags u8 (1: null doc_id); d + 1 run starts u64;
d + 1 id starts u64; n symbols.  Symbols and rules are u16, or u32 where the vocabulary leaves too few of those.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm import files
from gleaner.llm.common import checkpoint, in_blocks, tidy, whole_text
from gleaner.llm.tokenizing import text_ids, vocabulary_size

END = 0
#: The least count that pays for a rule, and new symbols of a round: a share of those left, but so many at least.
LEAST, PER_ROUND, ROUND_SHARE = 8, 1500, 5
#: Symbols are 16 bits wide where that leaves this many for rules, else 32 bits, of which 24 are used.
ROOM = 4096
SHARD_IDS = 4_000_000
_HEAD = struct.Struct("<4sIIIIQ")


def _symbols(vocabulary: int) -> tuple[int, str]:
    """(how many symbols there may be, their type)."""
    if vocabulary > 1 << 24:
        raise ValueError(f"{vocabulary} ids leave no symbols for rules")
    return (1 << 16, "<u2") if vocabulary + ROOM <= 1 << 16 else (1 << 24, "<u4")


def compress(ids: np.ndarray, vocabulary: int, least: int = LEAST):
    """ids below ``vocabulary`` -> (symbols, rules as an (m, 2) array; rule k makes symbol vocabulary + k).

    Ends when no pair occurs ``least`` times, or no symbol is left for another rule.
    """
    most, kind = _symbols(vocabulary)
    wide, shift = (np.uint32, np.uint32(16)) if kind == "<u2" else (np.uint64, np.uint64(24))
    seq = np.asarray(ids).astype(wide)
    if len(seq) and int(seq.max()) >= vocabulary:
        raise ValueError(f"id {int(seq.max())} is not below {vocabulary}")
    rules, n_rules = [np.zeros((0, 2), wide)], 0
    while len(seq) > 1 and n_rules < most - vocabulary:
        room = most - vocabulary - n_rules
        keys = seq[:-1] << shift | seq[1:]
        free = (seq[:-1] != END) & (seq[1:] != END)
        ranked = np.sort(keys[free])
        starts = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]]) if len(ranked) else np.zeros(0, np.int64)
        counts = np.diff(np.r_[starts, len(ranked)])
        often = np.flatnonzero(counts >= least)
        if not len(often):
            break
        each = min(room, max(PER_ROUND, (most - vocabulary) // ROUND_SHARE if kind == "<u2" else len(often) // ROUND_SHARE))
        best = often[np.argsort(-counts[often], kind="stable")[:each]]
        chosen = np.sort(ranked[starts[best]])
        left, right = np.zeros(vocabulary + n_rules, bool), np.zeros(vocabulary + n_rules, bool)
        left[chosen >> shift] = True
        right[chosen & ((wide(1) << shift) - wide(1))] = True
        at = np.flatnonzero(left[seq[:-1]] & right[seq[1:]])
        place = np.searchsorted(chosen, keys[at])
        hit = chosen[np.minimum(place, len(chosen) - 1)] == keys[at]
        at, place = at[hit], place[hit]
        # of hits in a row, each overlapping the next, every second one from the left
        run = np.flatnonzero(np.r_[True, np.diff(at) > 1])
        inside = np.arange(len(at)) - np.repeat(run, np.diff(np.r_[run, len(at)]))
        at, place = at[inside % 2 == 0], place[inside % 2 == 0]
        # a pair that others of its round took apart may be left with too few places: it gets no rule
        used = np.bincount(place, minlength=len(chosen)) >= 2
        at, place = at[used[place]], place[used[place]]
        if not len(at):
            break
        chosen, place = chosen[used], (np.cumsum(used) - 1)[place]
        seq[at] = (vocabulary + n_rules + place).astype(wide)
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq = seq[keep]
        rules.append(np.stack([chosen >> shift, chosen & ((wide(1) << shift) - wide(1))], axis=1))
        n_rules += len(chosen)
    return seq.astype(kind), np.concatenate(rules).astype(kind)


def expansions(vocabulary: int, rules: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(all expansions in one array, where each symbol's begins, how long it is)."""
    made: list[np.ndarray] = []
    of = lambda s: made[s - vocabulary] if s >= vocabulary else np.array([s], np.uint32)
    for a, b in rules.tolist():
        made.append(np.concatenate([of(a), of(b)]))
    flat = np.concatenate([np.arange(vocabulary, dtype=np.uint32), *made])
    lengths = np.r_[np.ones(vocabulary, np.int64), [len(x) for x in made]].astype(np.int64)
    return flat, np.cumsum(lengths) - lengths, lengths


def expand(symbols: np.ndarray, flat: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    n = lengths[symbols]
    ends = np.cumsum(n)
    return flat[np.repeat(begins[symbols] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]


def pack(doc_ids: list[int | None], docs: list[np.ndarray], vocabulary: int) -> bytes:
    """A shard file of documents whose ids end with END."""
    ids = np.concatenate(docs) if docs else np.zeros(0, np.uint32)
    symbols, rules = compress(ids, vocabulary)
    _, _, lengths = expansions(vocabulary, rules)
    sizes = lengths[symbols]
    id_starts = np.r_[0, np.cumsum([len(d) for d in docs], dtype=np.int64)]
    run_starts = np.searchsorted(np.r_[0, np.cumsum(sizes)], id_starts)
    return b"".join(
        [
            _HEAD.pack(b"GRPR", 1, vocabulary, len(rules), len(docs), len(symbols)),
            rules.tobytes(),
            lengths[vocabulary:].astype("<u4").tobytes(),
            np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
            np.array([d is None for d in doc_ids], "u1").tobytes(),
            run_starts.astype("<u8").tobytes(),
            id_starts.astype("<u8").tobytes(),
            symbols.tobytes(),
        ]
    )


class Shard:
    """A shard file, for reading whole or one document at a time."""

    def __init__(self, data: bytes):
        magic, version, self.vocabulary, m, d, n = _HEAD.unpack_from(data)
        if magic != b"GRPR" or version != 1:
            raise ValueError("not a shard of this format")
        at = _HEAD.size

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(data, kind, count, at)
            at += found.nbytes
            return found

        kind = _symbols(self.vocabulary)[1]
        self.rules = take(kind, 2 * m).reshape(m, 2)
        self.lengths = take("<u4", m)
        ids, null = take("<i8", d).tolist(), take("u1", d).tolist()
        self.doc_ids = [None if z else i for i, z in zip(ids, null, strict=True)]
        self.runs, self.starts = take("<u8", d + 1).astype(np.int64), take("<u8", d + 1).astype(np.int64)
        self.symbols = take(kind, n)
        self._grammar = expansions(self.vocabulary, self.rules)
        if not np.array_equal(self._grammar[2][self.vocabulary :], self.lengths):
            raise ValueError("expansion lengths disagree with the rules")

    def document(self, k: int) -> np.ndarray:
        """The ids of the k-th document, from its own run alone."""
        return expand(self.symbols[self.runs[k] : self.runs[k + 1]], *self._grammar)

    def ids(self) -> np.ndarray:
        return expand(self.symbols, *self._grammar)


MANIFEST = "part int, piece int, path string, n_docs bigint, n_ids bigint"


def _write(tokenizer: str, folder: str, vocabulary: int, shard_ids: int):
    def run(batches):
        part, piece, size = TaskContext.get().partitionId(), 0, 0
        doc_ids, docs = [], []
        encoder, end = text_ids(tokenizer), np.array([END], np.uint32)

        def flush():
            path = f"{folder}/shard-{part:06d}-{piece:04d}.grpr"
            files.put(path, pack(doc_ids, docs, vocabulary))
            return pa.RecordBatch.from_pylist([{"part": part, "piece": piece, "path": path, "n_docs": len(docs), "n_ids": size}], schema=_MANIFEST_ARROW)

        for batch in in_blocks(batches):
            for d, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                docs.append(np.concatenate([encoder.encode(text.as_py()), end]))
                doc_ids.append(d)
                size += len(docs[-1])
                if size >= shard_ids:
                    yield flush()
                    doc_ids, docs, size, piece = [], [], 0, piece + 1
        if docs:
            yield flush()

    return run


_MANIFEST_ARROW = pa.schema([("part", pa.int32()), ("piece", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])


def write_shards(docs: DataFrame, tokenizer_path: str, folder: str, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Encode every whole text, END after each, into shards below ``folder``; returns the list of files in order.

    Rows are ordered by doc_id, nulls first, then by text.  A null text is empty and has END alone; repeated rows
    are written each.  A shard closes once it has ``shard_ids`` ids, so a very long text makes one larger shard.
    An empty table writes no file.
    """
    narrow = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"))
    ranged = narrow.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return checkpoint(ranged.mapInArrow(tidy(_write(tokenizer_path, folder, vocabulary_size(tokenizer_path), shard_ids)), MANIFEST))


def _read(batches):
    for batch in batches:
        for row in batch.to_pylist():
            shard = Shard(files.get(row["path"]))
            ids, starts = shard.ids().astype("<u4"), shard.starts
            crc = [zlib.crc32(ids[a:b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
            n = pa.array(np.diff(starts))
            runs = pa.array(np.diff(shard.runs))
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard.doc_ids, pa.int64()), pa.array(starts[:-1] + row["base"]), n, pa.array(crc, pa.int64()), runs],
                names=["doc_id", "start", "n_tokens", "ids_crc32", "n_symbols"],
            )


def read_shards(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, n_symbols) of every document, decoded from the files of a manifest.

    ``start`` counts all ids in earlier files and earlier in the file; the running sum is over one row per file.
    """
    order = Window.orderBy("part", "piece").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    based = checkpoint(manifest.select("path", "n_ids", (F.sum("n_ids").over(order) - F.col("n_ids")).alias("base")))
    spread = based.select("path", "base").repartition(max(1, based.count()))
    return spread.mapInArrow(tidy(_read), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, n_symbols bigint")
