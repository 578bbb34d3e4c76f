"""Text functions as Column expressions: white space, normalisation, token overlap, answers, JSON, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that Python's str.split and str.strip treat as white space.
SPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
SPACES = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_ARTICLE = r"(?=[at])(?<![\p{L}\p{N}_])(?:an?|the)(?![\p{L}\p{N}_])"
ANSWER_CHARS = 80
UNKNOWN = "UNKNOWN"
QA_TYPE = "array<struct<question: string, answer: string>>"
# What annotators write for valid and invalid.
VALID = ("1", "true", "yes", "y", "valid", "correct", "supported")
INVALID = ("0", "false", "no", "n", "invalid", "incorrect", "unsupported")


def strip(c: Column) -> Column:
    """Without white space at the ends; a run of it inside is gone through once."""
    return F.regexp_replace(c, rf"\A{SPACE}++|(?<!{SPACE}){SPACE}++\z", "")


def _spaced(c: Column, gone: str = "") -> Column:
    """With a space for every white space character, without the characters of ``gone``."""
    return F.translate(c, SPACES + gone, " " * len(SPACES))


def _single(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, " {2,}+", " "))


def collapse(c: Column) -> Column:
    return _single(_spaced(c))


def tokenize(c: Column) -> Column:
    """Words between white space; an empty or null text has none."""
    return F.filter(F.split(_spaced(F.coalesce(c, F.lit(""))), " "), lambda w: w != "")


def normalize_iaa(c: Column) -> Column:
    """Lower case without ASCII punctuation, single spaces; null is empty."""
    return _single(_spaced(F.lower(F.coalesce(c, F.lit(""))), PUNCTUATION))


def normalize_answer(c: Column) -> Column:
    """As ``normalize_iaa``, without articles too."""
    return _single(F.regexp_replace(_spaced(F.lower(F.coalesce(c, F.lit(""))), PUNCTUATION), _ARTICLE, " "))


def answer_tokens(c: Column) -> Column:
    """``tokenize`` of ``normalize_answer``, without the passes over the text that only make single spaces of several."""
    plain = F.regexp_replace(_spaced(F.lower(F.coalesce(c, F.lit(""))), PUNCTUATION), _ARTICLE, " ")
    return F.filter(F.split(plain, " "), lambda w: w != "")


def token_overlap(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two token arrays: both sorted together, then gone through once."""
    tagged = lambda xs, side: F.transform(xs, lambda t: F.struct(t.alias("t"), F.lit(side).alias("side")))
    state = lambda t, spare, n: F.struct(t.alias("t"), spare.alias("spare"), n.alias("n"))

    def step(s, x):
        """Of a token, first those of ``a`` are counted, then each of ``b`` takes one as long as there are any."""
        same = s["t"].eqNullSafe(x["t"])
        mine = state(x["t"], F.when(same, s["spare"] + 1).otherwise(1), s["n"])
        return F.when(x["side"] == 0, mine).when(same & (s["spare"] > 0), state(x["t"], s["spare"] - 1, s["n"] + 1)).otherwise(state(x["t"], F.lit(0), s["n"]))

    return F.aggregate(F.sort_array(F.concat(tagged(a, 0), tagged(b, 1))), state(F.lit(None).cast("string"), F.lit(0), F.lit(0)), step, lambda s: s["n"])


def f1_of(a: Column, b: Column) -> Column:
    """Inside lambdas nothing is shared, so each array and the overlap are handed on instead of being worked out anew."""
    once = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))
    counted = once(F.struct(a.alias("a"), b.alias("b")), lambda x: F.struct(token_overlap(x["a"], x["b"]).alias("n"), (F.size(x["a"]) + F.size(x["b"])).alias("all")))
    return once(counted, lambda x: F.when(x["n"] == 0, 0.0).otherwise(2.0 * x["n"] / x["all"]))


def token_f1(prediction: Column, gold: Column, normalize=normalize_answer) -> Column:
    """No overlap is 0, also between two empty texts."""
    return f1_of(tokenize(normalize(prediction)), tokenize(normalize(gold)))


def exact_match(prediction: Column, gold: Column, normalize=normalize_answer) -> Column:
    return normalize(prediction) == normalize(gold)


def split_golds(c: Column) -> Column:
    return F.transform(F.split(c, r"[|]"), strip)


def short(c: Column, n: int = 140) -> Column:
    text = collapse(F.coalesce(c, F.lit("")))
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n - 3), F.lit("..."))).otherwise(text)


def parse_validity(c: Column) -> Column:
    text = F.lower(strip(c.cast("string")))
    return F.when(text.isin(*VALID), 1).when(text.isin(*INVALID), 0)


def first_truthy(*columns: Column) -> Column:
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns), F.lit(""))


def reliability_band(c: Column) -> Column:
    return F.when(F.isnan(c) | c.isNull(), "n/a").when(c >= 0.8, "reliable").when(c >= 0.667, "tentative").otherwise("low")


def clean_answer(c: Column) -> Column:
    """The first line of a reply, at most 80 characters; an empty reply is UNKNOWN."""
    text = strip(F.coalesce(c, F.lit("")))
    line = strip(F.element_at(F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"), 1))
    return F.when(text == "", UNKNOWN).otherwise(F.substring(line, 1, ANSWER_CHARS))


def one_line(c: Column) -> Column:
    return F.trim(F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(" ")))


def json_object(c: Column) -> Column:
    """From the first { to the last }; null where there is none."""
    return F.nullif(F.regexp_extract(c, r"(?s)(\{.*\})", 1), F.lit(""))


def extract_qa(c: Column) -> Column:
    """question and answer of the one JSON object in a text, else null; a second object or bad syntax is null."""
    parsed = F.from_json(F.concat(F.lit("["), json_object(c), F.lit("]")), QA_TYPE, {"allowSingleQuotes": "false"})
    return F.when(F.size(parsed) == 1, F.get(parsed, F.lit(0)))


def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def highlight(text: Column, gold: Column) -> Column:
    """Paragraphs of a text in HTML, its gold answer marked; blank ones are left out."""
    plain, mark = escape_html(text), escape_html(gold)
    marked = F.when(gold != "", F.replace(plain, mark, F.concat(F.lit("<mark>"), mark, F.lit("</mark>")))).otherwise(plain)
    return F.filter(F.split(marked, "\n"), lambda p: strip(p) != "")
