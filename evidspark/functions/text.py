"""Text functions: Column builders for plans, and plain twins for values on the driver."""

from __future__ import annotations

import re
import unicodedata
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed sets of characters that matching ignores or unifies.
IGNORED = "\u00ad\u200b\ufeff"
DASHES = "\u2010\u2011\u2012\u2013\u2014\u2015\u2212"
SPACES = "\u00a0\u2007\u2009\u200a\u202f"
TOKEN = r"[\p{L}\p{N}]+"
#: A number that doesn't start inside a word or another number.
NUMBER = r"(?U)(?<![\p{L}\p{N}])(?<![.,])[0-9]+(?:[.,][0-9]+)*"


@lru_cache(1)
def _accents() -> tuple[str, str]:
    """Letters of the basic plane that decompose to one base letter, and that letter."""
    source, base = [], []
    for c in map(chr, [*range(0xC0, 0xD800), *range(0xF900, 0x10000)]):
        plain = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
        if plain != c and len(plain) == 1:
            source.append(c)
            base.append(plain)
    return "".join(source), "".join(base)


def fold(text: Column) -> Column:
    """Lower case without accents; loose combining marks are dropped."""
    source, base = _accents()
    lower = F.lower(text)
    # Bytes as many as characters: nothing to fold, so most English rows take the short way.
    return F.when(F.octet_length(text) == F.char_length(text), lower).otherwise(F.regexp_replace(F.translate(lower, source, base), r"\p{Mn}", ""))


def fold_value(text: str) -> str:
    """fold() of a value, with any run of white space as one space."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return " ".join(plain.split()).casefold()


def tokens(text: Column) -> Column:
    """Folded runs of letters and digits."""
    return F.regexp_extract_all(fold(text), F.lit(TOKEN), F.lit(0))


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def snippet(text: Column, n: int = 300) -> Column:
    """The first n characters of collapse(), from the start of the text that makes them."""
    start = F.regexp_extract(text, rf"(?U)^\s*((?:\S|\s+(?=\S)){{0,{n}}})", 1)
    return F.substring(F.regexp_replace(start, r"(?U)\s+", " "), 1, n)


def head_probe(text: Column, n: int = 60) -> Column:
    return snippet(text, n)


def tail_probe(text: Column, n: int = 60) -> Column:
    return F.right(collapse(text), F.lit(n))


def _compose(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None else unicodedata.normalize("NFC", t))


def compose(text: Column) -> Column:
    """NFC. Spark has no such function, so rows with combining marks, and only those, go through Arrow."""
    composed = F.pandas_udf(_compose, T.StringType())
    return F.when(text.rlike(r"\p{M}"), composed(text)).otherwise(text)


def normalize_for_match(text: Column, composed: bool = True) -> Column:
    """The canonical form all comparisons use; composed says that the text is in NFC already."""
    text = F.coalesce(text if composed else compose(text), F.lit(""))
    text = F.translate(text, DASHES + SPACES + IGNORED, "-" * len(DASHES) + " " * len(SPACES))
    text = F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), " ?- ?", "-")
    return F.lower(F.trim(text))


_UNIFY = {ord(c): None for c in IGNORED} | dict.fromkeys(map(ord, DASHES), "-") | dict.fromkeys(map(ord, SPACES), " ")


def normalize_value(text: str | None) -> str:
    """normalize_for_match() of a value."""
    text = unicodedata.normalize("NFC", text or "").translate(_UNIFY)
    return re.sub(" ?- ?", "-", re.sub(r"\s+", " ", text)).strip().lower()


def contains_normalized(haystack: Column, needle: Column) -> Column:
    """Both are normalized already; an empty needle never matches."""
    return (F.length(needle) > 0) & F.contains(haystack, needle)


def numbers_in(text: Column) -> Column:
    """Distinct numbers that a normalized sentence claims, in order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)))


def states_number(haystack: Column, number: Column) -> Column:
    """Whether a text states this number, its digits possibly apart, and not a longer one."""
    spaced = F.regexp_replace(F.regexp_replace(number, r"([.,])", r"\\$1"), r"(\\?[0-9.,])(?=.)", r"$1\\s*")
    return F.regexp_like(haystack, F.concat(F.lit(r"(?<![0-9.,])"), spaced, F.lit("(?![0-9])")))


def titles_match(left: str, right: str, least: float = 0.85) -> bool:
    """Same title but for accents, spaces and a few lost glyphs."""
    a, b = fold_value(left).replace(" ", ""), fold_value(right).replace(" ", "")
    return a == b or bool(a and b) and SequenceMatcher(None, a, b).ratio() >= least


def signature(line: Column, most: int = 160, least: int = 3) -> Column:
    """Key of a possible running header: no trailing page number, with a word; null if it can't be one."""
    text = collapse(line)
    key = F.regexp_replace(text, r"(?U)\s*[0-9]{1,4}$", "")
    return F.when((F.length(text) > 0) & (F.length(text) <= most) & (F.length(key) >= least) & key.rlike(r"\p{L}{3,}"), key)


def uuid5(namespace: str, name: Column) -> Column:
    """Version 5 UUID of a name as text."""
    raw = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(raw, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    return F.concat_ws("-", F.substring(raw, 1, 8), F.substring(raw, 9, 4), F.concat(F.lit("5"), F.substring(raw, 14, 3)), F.concat(variant, F.substring(raw, 18, 3)), F.substring(raw, 21, 12))


def page_label(first: Column, last: Column) -> Column:
    start = first.cast("string")
    return F.when(first.isNull() | (first == 0), F.lit("")).when(last.isNull() | (last == 0) | (last == first), start).otherwise(F.concat_ws("-", start, last.cast("string")))


def context_prefix(title: Column, locality: Column, kind: Column, summary: Column) -> Column:
    """KONTEXT: title, locality, type. summary - with what is there."""
    def some(c: Column) -> Column:
        return F.nullif(c, F.lit(""))

    header, summary = F.concat_ws(", ", some(title), some(locality), some(kind)), F.trim(F.coalesce(summary, F.lit("")))
    return (
        F.when((header != "") & (summary != ""), F.concat(F.lit("KONTEXT: "), header, F.lit(". "), summary))
        .when(header != "", F.concat(F.lit("KONTEXT: "), header, F.lit(".")))
        .when(summary != "", F.concat(F.lit("KONTEXT: "), summary))
        .otherwise("")
    )


def escaped_json(row: Column) -> Column:
    """A JSON line that can't close the block it stands in."""
    return F.replace(F.replace(F.to_json(row), F.lit("<"), F.lit("\\u003c")), F.lit(">"), F.lit("\\u003e"))


def excerpt(text: Column, start: Column, length: Column, around: int = 45) -> Column:
    """A match (start from 1) in brackets with a little text around it."""
    before = F.greatest(start - 1 - around, F.lit(0))
    lead = F.when(start - 1 - around > 0, F.lit("…")).otherwise("")
    tail = F.when(start - 1 + length + around < F.length(text), F.lit("…")).otherwise("")
    return F.concat(lead, F.substring(text, before + 1, start - 1 - before), F.lit("["), F.substring(text, start, length), F.lit("]"), F.substring(text, start + length, F.lit(around)), tail)


def l2_normalize(vector: Column) -> Column:
    """Unit vector; a zero vector stays as it is."""
    return F.transform(vector, lambda x: x.cast("double") / F.coalesce(F.nullif(norm(vector), F.lit(0.0)), F.lit(1.0)))


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def dot(left: Column, right: Column) -> Column:
    return F.aggregate(F.zip_with(left, right, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda a, x: a + x)
