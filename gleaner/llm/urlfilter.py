"""URL filter: host and path rules first, then a weighted vocabulary counted by an Aho-Corasick automaton.

A rule fits its host and all subdomains where the path starts with the rule's; the longest rule decides.  Where
none fits, the words of the URL do, with percent escapes decoded: a term counts where no letter or digit stands on
either side of it, and once however often it is there.  A strict term weighs as much as it takes to block, a soft one
a share of that, so one strict term blocks, and so do several different soft terms.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from urllib.parse import unquote

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_SOFT = 2
#: Terms of a vocabulary that is read from a table.
MOST_TERMS = 1_000_000
_STRICT = "porn porno pornos xxx hentai camgirl camgirls milf nsfw warez escorts blowjob sexcam pornografie pornographie pornografia pornografía putas putain nutten huren prostituées prostituierte"
_SOFT = "adult adults sex sexy nude nudes casino poker bet betting gambling dating hookup viagra pills torrent crack keygen free hot adulto adultos desnuda desnudas apuestas gratis citas nackt wetten kostenlos glücksspiel erotik adulte adultes nue nues pari paris gratuit rencontres érotique"


@dataclass(frozen=True)
class Vocabulary:
    """Terms in lower case, each with its weight; different terms of a URL that weigh ``limit`` or more together block it."""

    weights: tuple[tuple[str, float], ...] = (*((t, float(LEAST_SOFT)) for t in _STRICT.split()), *((t, 1.0) for t in _SOFT.split()))
    limit: float = float(LEAST_SOFT)

    @classmethod
    def of(cls, table: DataFrame, limit: float = float(LEAST_SOFT)) -> Vocabulary:
        """From a table (term string, weight double); the largest weight of a term counts, empty terms and nulls don't."""
        rows = table.where("term <> '' and weight > 0").groupBy(F.lower("term").alias("term")).agg(F.max(F.col("weight").cast("double")).alias("weight"))
        if rows.count() > MOST_TERMS:
            raise ValueError(f"more than {MOST_TERMS} terms")
        return cls(tuple(sorted((r.term, r.weight) for r in rows.collect())), limit)


@dataclass(frozen=True)
class Rules:
    """(host, path, verdict); a host stands for itself and its subdomains."""

    rows: tuple[tuple[str, str, str], ...] = (
        ("org", "/", "allow"),
        ("example.org", "/es/", "block"),
        ("example.org", "/en/1", "block"),
        ("com", "/fr/", "allow"),
        ("com", "/de/", "block"),
    )


@lru_cache(maxsize=8)
def automaton(vocabulary: Vocabulary):
    found = ahocorasick.Automaton()
    for term, weight in vocabulary.weights:
        found.add_word(term, (term, weight))
    found.make_automaton()
    return found


def hits(url: str, vocabulary: Vocabulary) -> dict[str, float]:
    """The different terms that stand alone in a URL, with their weights; escapes are decoded, letters lower-cased."""
    text, out = (unquote(url) if "%" in url else url).lower(), {}
    if not vocabulary.weights:
        return out
    for end, (term, weight) in automaton(vocabulary).iter(text):
        start = end - len(term) + 1
        if not (start and text[start - 1].isalnum()) and not text[end + 1 : end + 2].isalnum():
            out[term] = weight
    return out


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z in lower case; without :// empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(host, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge(pages: DataFrame, rules: Rules | None = None, vocabulary: Vocabulary | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, n_strict, n_soft, weight) of every row; terms that block alone are strict.

    A null url, or one without ://, has an empty host and path, so no rule; its words are still counted, and a
    null has none and is allowed.  Repeated rows are judged alike; other columns are not read.
    """
    rules, vocabulary = rules or Rules(), vocabulary or Vocabulary()

    @F.arrow_udf("struct<n_strict: int, n_soft: int, weight: double>")
    def counts(urls: pa.Array) -> pa.Array:
        found = [list(hits(u or "", vocabulary).values()) for u in urls.to_pylist()]
        strict = [sum(w >= vocabulary.limit for w in ws) for ws in found]
        columns = pa.array(strict, pa.int32()), pa.array([len(ws) - n for ws, n in zip(found, strict, strict=True)], pa.int32()), pa.array(map(sum, found), pa.float64())
        return pa.StructArray.from_arrays(columns, names=["n_strict", "n_soft", "weight"])

    url = F.col("url").cast("string")
    rows = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), counts(url).alias("c"))
    rule, ruled = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, verdict in sorted(rules.rows, key=lambda r: (len(r[0] + r[1]), r)):  # later ones are longer and win
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, ruled = F.when(fits, host + path).otherwise(rule), F.when(fits, verdict).otherwise(ruled)
    own = F.when(F.col("c.weight") >= vocabulary.limit, "block").otherwise("allow")
    return rows.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(ruled, own).alias("verdict"), F.col("c.n_strict").cast("long").alias("n_strict"), F.col("c.n_soft").cast("long").alias("n_soft"), F.col("c.weight").alias("weight"))
