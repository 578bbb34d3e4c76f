"""Pieces of DuckDB SQL that the oracles share."""

from __future__ import annotations

from gleaner.functions.text import PUNCTUATION

WS = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_PUNCT = PUNCTUATION.replace("'", "''")


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


def collapse(c: str) -> str:
    return f"trim(regexp_replace({c}, '{WS}+', ' ', 'g'))"


def words(c: str) -> str:
    return f"list_filter(string_split({collapse(f"coalesce({c}, '')")}, ' '), lambda w: w <> '')"


def norm_iaa(c: str) -> str:
    return collapse(f"translate(lower(coalesce({c}, '')), '{_PUNCT}', '')")


def norm(c: str) -> str:
    article = r"(^|[^\p{L}\p{N}_])(a|an|the)($|[^\p{L}\p{N}_])"
    once = lambda x: f"regexp_replace({x}, '{article}', '\\1 \\3', 'g')"
    return collapse(once(once(f"translate(lower(coalesce({c}, '')), '{_PUNCT}', '')")))


def overlap(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_distinct({a}), lambda token: least(len(list_filter({a}, lambda other: other = token)), len(list_filter({b}, lambda other: other = token)))))"


def f1(a: str, b: str) -> str:
    o = f"coalesce({overlap(a, b)}, 0)"
    return f"CASE WHEN {o} = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * {o} / (len({a}) + len({b})) END"
