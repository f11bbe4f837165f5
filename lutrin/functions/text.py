"""Normalisation and tokens, as native column expressions wherever Spark has them."""

from __future__ import annotations

import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Ordered alternatives of a query token: ISO date, date with day first, number, word. Fixed values.
QUERY_TOKEN = r"\d{4}-\d{2}-\d{2}|\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d+(?:[.,]\d+)?|[A-Za-zÀ-ÖØ-öø-ÿ]+(?:[-'][A-Za-zÀ-ÖØ-öø-ÿ]+)*"
#: What a date or a number looks like as a whole. Fixed values.
ENTITY = r"^(?:\d{4}-\d{2}-\d{2}|\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d+(?:[.,]\d+)?)$"
#: Tokens of running French: an elided word with its apostrophe, or a run of letters and digits, joined by hyphens.
TOKEN = r"(?:[cdjlmnst]|qu|jusqu|lorsqu|puisqu|quoiqu)['’]|[\p{L}\p{N}]+(?:-[\p{L}\p{N}]+)*"
#: What stands between blanks and punctuation: words with what joins them, of which only those of letters and digits alone count.
JOINED = r"[\p{L}\p{N}]+(?:['’\-./_@+]+[\p{L}\p{N}]+|[,:]\p{Nd}[\p{L}\p{N}]*)*"


@cache
def _foldings() -> tuple[str, str]:
    """Characters that compatibility decomposition makes one other character and marks, and those characters; by rule."""
    pairs = []
    for code in range(0xA0, 0x10000):
        c = chr(code)
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if len(plain) == 1 and plain != c and not 0xAC00 <= code < 0xD7A4:
            pairs.append((c, plain))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


@cache
def _ligatures() -> list[tuple[str, str]]:
    """Characters of the Latin ligature block with the letters they decompose to; by rule."""
    return [(chr(c), unicodedata.normalize("NFKD", chr(c))) for c in range(0xFB00, 0xFB07)]


def strip_accents(col: Column) -> Column:
    """Compatibility-decomposed text without combining marks, without Python.

    Covers every character that decomposes to one base character, and the Latin ligatures. For others (fractions,
    syllables of Hangul) use ``strip_accents_exact``. Null gives null.
    """
    source, target = _foldings()
    col = F.regexp_replace(F.translate(col, source, target), r"\p{Mn}+", "")
    for a, b in _ligatures():
        col = F.replace(col, F.lit(a), F.lit(b))
    return col


@F.pandas_udf(StringType())
def strip_accents_exact(s: pd.Series) -> pd.Series:
    """The same for all of Unicode, by Arrow batches. Apply it to distinct values."""
    return s.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)))


def trim_unicode(col: Column) -> Column:
    """Without white space of any kind, no-break space included, at both ends."""
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")


def normalize(col: Column) -> Column:
    """Trimmed, lower case, typographic apostrophes made plain, accents removed. œ stays. Null gives null."""
    return strip_accents(F.replace(F.lower(trim_unicode(col)), F.lit("’"), F.lit("'")))


def tokens(col: Column) -> Column:
    """Lower-case tokens of running text, punctuation and space dropped; elisions are tokens. Null gives null."""
    return F.regexp_extract_all(F.lower(col), F.lit(TOKEN), F.lit(0))


def alpha_tokens(col: Column) -> Column:
    """Tokens of running text as written, those of letters alone: no elisions, no words with hyphens or digits. Null gives null."""
    return F.filter(F.regexp_extract_all(col, F.lit("(?i)" + TOKEN), F.lit(0)), is_alpha)


def alnum_words(col: Column) -> Column:
    """Lower-case tokens of letters and digits alone; what is joined by an apostrophe, a hyphen or the like is no such token as a
    whole and left out, not split. Null gives null."""
    return F.filter(F.regexp_extract_all(F.lower(col), F.lit(JOINED), F.lit(0)), lambda t: t.rlike(r"^[\p{L}\p{N}]+$"))


def regex_tokens(col: Column) -> Column:
    """Lower-case runs of letters, digits and underscores, the tokens of a pattern without a language. Null gives null."""
    return F.regexp_extract_all(F.lower(col), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def query_tokens(col: Column) -> Column:
    """Tokens of a query: dates, numbers, words joined by hyphen or apostrophe. œ isn't a word character. Null gives null."""
    return F.regexp_extract_all(F.replace(col, F.lit("’"), F.lit("'")), F.lit(f"({QUERY_TOKEN})"), F.lit(1))


def is_entity(col: Column) -> Column:
    """Whether a token is wholly a date or a number."""
    return col.rlike(ENTITY)


def is_alpha(col: Column) -> Column:
    return col.rlike(r"^\p{L}+$")


def common_prefix_length(a: Column, b: Column) -> Column:
    """Number of leading characters two texts share; 0 if either is empty, null if either is null."""
    n = F.least(F.length(a), F.length(b))
    # sequence(1, 0) counts down, so an empty side needs an array of its own.
    steps = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    same = F.filter(steps, lambda i: F.substring(a, 1, i) == F.substring(b, 1, i))
    return F.when(a.isNotNull() & b.isNotNull(), F.size(same))


def full_text(title: str = "titre", body: str = "texte") -> Column:
    """Title and text, one space between; nulls count as empty."""
    return F.concat_ws(" ", F.coalesce(F.col(title), F.lit("")), F.coalesce(F.col(body), F.lit("")))
