"""Exact token ids and counts, those of the tokenizers library.

For counts a text is cut only where its tokenizer cuts it anyway, and each distinct piece of a block of texts is
encoded once; pieces are forgotten with their block, so a worker keeps nothing from block to block.  Nothing is
truncated, padded or added; special strings inside a text are handled as the library does.
"""

from __future__ import annotations

import hashlib
import json
import os
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from tokenizers import Tokenizer, pre_tokenizers

from gleaner.llm.common import tokens

_TOGETHER = 200
#: The character that stands for the line feed's byte in a byte-level vocabulary; no piece without line feeds has it.
_FEED = "Ċ"


@lru_cache(maxsize=4)
def load(path: str) -> Tokenizer:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


@lru_cache(maxsize=4)
def version(path: str) -> str:
    """A digest of a tokenizer's file."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def vocabulary(name: str) -> str:
    return public_tokenizers.path(name)


def vocabulary_size(path: str) -> int:
    """One more than the largest id."""
    return max(load(path).get_vocab(with_added_tokens=True).values()) + 1


def ids_of(path: str, texts: list[str]) -> list[list[int]]:
    return [e.ids for e in load(path).encode_batch_fast(texts, add_special_tokens=False)]


def _ends_a_word(s: str) -> bool:
    """A letter and then one full stop or comma, which the tokenizers at hand cut off."""
    return len(s) > 1 and s[-1] in ".," and s[-2].isalpha()


def _between(ids: list[int], mark: int) -> list[np.ndarray]:
    """The ids between marks."""
    found = np.array(ids, dtype="<u4")
    at = np.flatnonzero(found == mark)
    return [found[a:b] for a, b in zip(np.r_[0, at + 1].tolist(), [*at.tolist(), len(found)], strict=True)]


def _byte_letters() -> dict[int, str]:
    """The character that a byte-level vocabulary has for each byte: its own where that can be seen, else one from 256 on."""
    seen = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(seen)]
    return {b: chr(b) for b in seen} | {b: chr(256 + k) for k, b in enumerate(rest)}


_BYTE_LETTERS = _byte_letters()


@lru_cache(maxsize=4)
def _merging(path: str) -> Tokenizer:
    """The library's tokenizer without what it does before it merges, for pieces that it would not cut or change."""
    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    found.normalizer = None
    found.pre_tokenizer = pre_tokenizers.Split(_FEED, "isolated")
    return found


def _letters_ids(path: str, pieces: list[str]) -> list[np.ndarray]:
    """The ids of pieces of letters alone, many at a time."""
    written = [p if p.isascii() else p.encode().decode("latin-1").translate(_BYTE_LETTERS) for p in pieces]
    joined = [_FEED.join(written[i : i + _TOGETHER]) for i in range(0, len(written), _TOGETHER)]
    mark = _merging(path).encode(_FEED, add_special_tokens=False).ids[0]
    return [w for e in _merging(path).encode_batch_fast(joined, add_special_tokens=False) for w in _between(e.ids, mark)]


def _encode_words(path: str, words: list[str], joint: str, mark: int) -> list[np.ndarray]:
    """The ids of words without white space or the joint's character, many at a time: the joint stays one token,
    the mark, which no such word contains."""
    joined = [joint.join(words[i : i + _TOGETHER]) for i in range(0, len(words), _TOGETHER)]
    return [w for ids in ids_of(path, joined) for w in _between(ids, mark)]


class TextIds:
    """Ids of whole texts, those that the tokenizers library gives.

    Where a file has a byte-level BPE with the usual cuts and nothing before or after it, as ``plain`` finds, its
    merges are those of the vocabulary's order, which the tiktoken library applies in a quarter of the time; a text
    that it gives up on (very long white space), and any other file, is encoded by the tokenizers library itself.
    """

    def __init__(self, path: str):
        self.path, self.fast = path, None
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        if self.plain(told):
            special = {t["content"]: t["id"] for t in told["added_tokens"]}
            bytes_of = {c: b for b, c in _BYTE_LETTERS.items()}
            ranks = {bytes(map(bytes_of.__getitem__, t)): i for t, i in told["model"]["vocab"].items() if t not in special}
            self.fast = tiktoken.Encoding(os.path.basename(path), pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    @staticmethod
    def plain(told: dict) -> bool:
        """Whether nothing but the usual cuts and merges in the order of the vocabulary happens to a text."""
        model, cuts = told["model"], told["pre_tokenizer"] or {}
        if told["normalizer"] or told["post_processor"] or cuts != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}:
            return False
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in told["added_tokens"]):
            return False
        if model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")):
            return False
        merged = [model["vocab"].get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
        ordinary = set(model["vocab"]) - {t["content"] for t in told["added_tokens"]}
        return None not in merged and merged == sorted(merged) and len(merged) + 256 == len(ordinary)

    def encode(self, text: str) -> np.ndarray:
        if self.fast is not None:
            try:
                return self.fast.encode_to_numpy(text, allowed_special="all")
            except ValueError:
                pass
        return np.array(ids_of(self.path, [text])[0], np.uint32)


class PieceCounts:
    """Token counts of whole texts under a BPE with word ends, which drops white space and lower-cases.

    ASCII white space never is inside a piece or joins the characters beside it.  Lower-casing a word beforehand
    is what the tokenizer does where no character beyond Latin Extended-B occurs; special strings are found before
    that, so a word that may hold one is left as it is.
    """

    def __init__(self, path: str):
        self.path = path
        self.mark = ids_of(path, ["|"])[0][0]

    def _learn(self, words: list[str]) -> np.ndarray:
        letters, plain, odd, forms = {}, {}, {}, []
        for s in words:
            stop = 0
            if s and max(s) < "ɐ" and "İ" not in s and "<|" not in s:
                s = s.lower()
                if _ends_a_word(s):
                    s, stop = s[:-1], 1
                kind = letters if s.isalpha() and s.islower() else plain if s.isascii() and "|" not in s else odd
            else:
                kind = plain if s.isalpha() else odd
            forms.append((s, stop))
            kind[s] = 0
        known = dict(zip(letters, map(len, _letters_ids(self.path, list(letters))), strict=True))
        known.update(zip(plain, map(len, _encode_words(self.path, list(plain), " | ", self.mark)), strict=True))
        known.update(zip(odd, map(len, ids_of(self.path, list(odd))), strict=True))
        return np.fromiter((known[s] + stop for s, stop in forms), np.int64, len(forms))

    def count(self, texts: pa.Array) -> np.ndarray:
        offsets, codes, words = tokens(texts)
        return np.diff(np.r_[0, np.cumsum(self._learn(words.to_pylist())[codes])][offsets])


@lru_cache(maxsize=2)
def text_ids(path: str) -> TextIds:
    return TextIds(path)


@lru_cache(maxsize=2)
def piece_counts(path: str) -> PieceCounts:
    return PieceCounts(path)
