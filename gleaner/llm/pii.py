"""Personal data in whole texts: patterns propose spans, checksums confirm them, words nearby adjust a score.

DataFrame functions only.  A pattern's matches and the pieces between them come from two scans of the text; the
places of matches are running sums of lengths, taken in blocks, so a text with very many matches stays affordable.
The patterns are written so that a scan is linear: a run of characters that may begin a match is tried from its
first character or from the end of the match before, never from each of its characters, and no group gives back
what it took, but for an IBAN's at most 30 characters.  They match what the plain patterns in ``KINDS`` match; an
IBAN has its country's length, or else the greatest length at which its checksum holds, so what follows it is not
taken for a part of it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import whole_text

_BLOCK = 128
_NEAR = 40


#: Characters of an IBAN by country, as registered.
_IBAN_SIZES = {
    15: "NO", 16: "BE", 18: "DK|FI|FK|FO|GL|NL|SD", 19: "MK|SI", 20: "AT|BA|EE|KZ|LT|LU|MN|XK", 21: "CH|HR|LI|LV", 22: "BG|BH|CR|DE|GB|GE|IE|ME|RS|VA",
    23: "AE|GI|IL|IQ|OM|SO|TL", 24: "AD|CZ|ES|MD|PK|RO|SA|SE|SK|TN|VG", 25: "LY|PT|ST", 26: "IS|TR", 27: "BI|DJ|FR|GR|IT|MC|MR|SM",
    28: "AL|AZ|BY|CY|DO|GT|HN|HU|LB|NI|PL|SV", 29: "BR|EG|PS|QA|UA", 30: "JO|KW|MU|YE", 31: "MT|SC", 32: "LC", 33: "RU",
}
_IBAN = "(?:" + "|".join(rf"(?:{c})[0-9]{{2}}(?:\x20?+[A-Z0-9]){{{n - 4}}}" for n, c in _IBAN_SIZES.items()) + ")(?![A-Za-z0-9])"
#: Of any other length or country: as far as it goes, but not into one of those; ``whole_iban`` finds its end.
_OTHER_IBAN = rf"[A-Z]{{2}}[0-9]{{2}}(?:(?:\x20(?!{_IBAN}))?+[A-Z0-9]){{11,30}}(?![A-Za-z0-9])"


@dataclass(frozen=True)
class Kind:
    """``plain`` is the pattern by definition, ``pattern`` the same without backtracking; ``needs`` must occur in a text."""

    name: str
    plain: str
    pattern: str
    needs: str
    words: str
    score: float


#: In the order in which spans are listed; those before iban are the base kinds.
KINDS = (
    Kind("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", r"e-?mail|contact|correo|courriel|kontakt|mailto", 0.8),
    Kind("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", r"\bip\b|address|server|host|from|adresse", 0.6),
    Kind("card", r"[0-9]([\x20-]?[0-9])+", r"[0-9](?:[\x20-]?+[0-9])++", "", r"card|visa|master|credit|karte|tarjeta|carte", 0.7),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]", "+", r"phone|tel|call|mobile|fax|anruf|llam|appel", 0.6),
    Kind("iban", r"[A-Z]{2}[0-9]{2}([\x20]?[A-Z0-9]){11,30}", rf"(?<![A-Za-z0-9])(?:{_IBAN}|{_OTHER_IBAN})", "", r"iban|bank|account|konto|cuenta|compte", 0.8),
)
BASE = tuple(k.name for k in KINDS[:4])
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)

    def value(i: Column) -> Column:
        v = F.substring(digits, n - i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return v - F.when(v > 9, 9).otherwise(0)

    return F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), value), F.lit(0), lambda a, v: a + v) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN's letters and digits, its first four at the end, leave 1 of 97."""
    bare = F.replace(iban, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(bare, F.lit(5), F.length(bare)), F.substring(bare, 1, 4))

    def take(rest: Column, i: Column) -> Column:
        c = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(c >= 65, (rest * 100 + c - 55) % 97).otherwise((rest * 10 + c - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), take) == 1


def whole_iban(found: Column) -> Column:
    """An IBAN without the words after it: one of a known length as it is, another up to its last word's end where
    the checksum holds; all of it if that is nowhere."""
    bare = lambda n: F.length(F.replace(F.substring(found, F.lit(1), n), F.lit(" "), F.lit("")))
    ends = lambda n: F.substring(found, n + 1, F.lit(1)).isin("", " ") & (F.substring(found, n, F.lit(1)) != " ") & (bare(n) >= 15)
    holds = F.filter(F.sequence(F.length(found), F.lit(15), F.lit(-1)), lambda n: F.when(ends(n), mod97(F.substring(found, F.lit(1), n))).otherwise(False))
    return F.when(found.rlike(f"^{_IBAN}$"), found).otherwise(F.substring(found, F.lit(1), F.coalesce(F.get(holds, F.lit(0)), F.length(found))))


def confirmed(kind: str, found: Column) -> Column:
    digits = F.regexp_replace(found, "[^0-9]", "")
    if kind == "ip":
        return found.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return mod97(found) if kind == "iban" else F.lit(True)


def _block(values: Column, b: Column) -> Column:
    return F.slice(values, b * _BLOCK + 1, F.lit(_BLOCK))


def _sums(values: Column) -> Column:
    """Running sums of a short array, the empty sum first."""
    zero = F.array(F.lit(0).cast("long"))
    return F.aggregate(values, zero, lambda a, v: F.concat(a, F.array(F.element_at(a, -1) + v)))


def _blocks(values: Column) -> Column:
    return F.when(F.size(values) == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / _BLOCK).cast("int")))


def spans(docs: DataFrame, key: str = "doc_id", text: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """(key, one array<struct<start, end, found, score>> column per kind) of confirmed spans, in code points, end exclusive.

    Spans of a kind are leftmost and don't overlap; what fails its check is dropped and not tried again.  A null
    text is empty; repeated rows and null keys keep their rows; other columns are not read.
    """
    rows = docs.select(F.col(key), whole_text(text).alias("t"))
    names = [k.name for k in kinds]
    cut = {}
    for k in kinds:
        there = F.col("t").contains(k.needs) if k.needs else F.col("t").rlike("[0-9]")
        none = F.array().cast("array<string>")
        cut[f"{k.name}_m"] = F.when(there, F.regexp_extract_all("t", F.lit(k.pattern), F.lit(0))).otherwise(none)
        cut[f"{k.name}_p"] = F.when(there, F.split("t", k.pattern, -1)).otherwise(none)
    rows = rows.select(key, *(c.alias(n) for n, c in cut.items()))
    before = lambda n: F.transform(F.slice(f"{n}_p", F.lit(1), F.size(f"{n}_m")), lambda p: F.struct(F.length(p).cast("long").alias("n"), F.lower(F.substring(p, -_NEAR, _NEAR)).alias("near")))
    rows = rows.select(key, *(f"{n}_m" for n in names), *(before(n).alias(f"{n}_b") for n in names))
    # a match and the piece before it, as one step
    step = lambda n: F.zip_with(f"{n}_b", f"{n}_m", lambda b, m: b["n"] + F.length(m))
    rows = rows.select("*", *(step(n).alias(f"{n}_s") for n in names))
    total = lambda n: _sums(F.transform(_blocks(F.col(f"{n}_s")), lambda b: F.aggregate(_block(F.col(f"{n}_s"), b), F.lit(0).cast("long"), lambda a, v: a + v)))
    rows = rows.select("*", *(total(n).alias(f"{n}_t") for n in names))
    ends = lambda n: F.flatten(F.transform(_blocks(F.col(f"{n}_s")), lambda b: F.transform(F.slice(_sums(_block(F.col(f"{n}_s"), b)), F.lit(2), F.lit(_BLOCK)), lambda v: v + F.get(F.col(f"{n}_t"), b))))
    rows = rows.select(key, *(f"{n}_{x}" for n in names for x in "mb"), *(ends(n).alias(f"{n}_e") for n in names))

    def listed(k: Kind) -> Column:
        near = lambda x: x["b"]["near"].rlike(k.words)
        score = lambda x: F.least(F.lit(1.0), F.lit(k.score) + F.when(near(x), 0.2).otherwise(0.0))
        joined = F.arrays_zip(F.col(f"{k.name}_m").alias("m"), F.col(f"{k.name}_b").alias("b"), F.col(f"{k.name}_e").alias("e"))
        if k.name == "iban":
            cut = lambda x, m: F.struct(m.alias("m"), x["b"].alias("b"), (x["e"] - F.length(x["m"]) + F.length(m)).alias("e"))
            joined = F.transform(joined, lambda x: cut(x, whole_iban(x["m"])))
        kept = F.filter(joined, lambda x: confirmed(k.name, x["m"]))
        return F.transform(kept, lambda x: F.struct((x["e"] - F.length(x["m"])).alias("start"), x["e"].alias("end"), x["m"].alias("found"), score(x).alias("score")))

    return rows.select(key, *(listed(k).alias(k.name) for k in kinds))


def _text(names: tuple[str, ...]) -> Column:
    def written(name: str) -> Column:
        return F.transform(name, lambda x: F.concat_ws(":", F.lit(name), x["start"].cast("string"), x["end"].cast("string")))

    return F.array_join(F.concat(*map(written, names)), ",")


def digest(docs: DataFrame) -> DataFrame:
    """(doc_id, counts of the base kinds, base_sha256, spans, least_score) of every row; see ``spans``."""
    found = spans(docs)
    counts = [F.size(n).cast("long").alias(f"n_{n}") for n in BASE]
    scores = F.concat(*(F.transform(k.name, lambda x: x["score"]) for k in KINDS))
    return found.select("doc_id", *counts, F.sha2(_text(BASE), 256).alias("base_sha256"), _text(tuple(k.name for k in KINDS)).alias("spans"), F.array_min(scores).alias("least_score"))
