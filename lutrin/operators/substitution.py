"""Removal of stop words from texts, one token after the other."""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lutrin.session import ship

#: Tokens of one function.
LIST = 20_000


def _is_word(ch: str) -> bool:
    return ch == "_" or unicodedata.category(ch)[0] in "LNM"


@cache
def _marks() -> str:
    """All combining marks, as ranges of a character class."""
    spans: list[list[int]] = []
    for c in range(0x300, sys.maxunicode + 1):
        if unicodedata.category(chr(c))[0] == "M":
            if spans and spans[-1][1] == c - 1:
                spans[-1][1] = c
            else:
                spans.append([c, c])
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in spans)


def bounded(token: str, quoted: str, word: str) -> str:
    """Pattern of a whole token: words are letters, digits, underscores and combining marks. An
    end of the token that is one of these has none beside it, any other end has one beside it."""
    before = f"(?<!{word})" if _is_word(token[0]) else f"(?<={word})"
    return before + quoted + (f"(?!{word})" if _is_word(token[-1]) else f"(?={word})")


def replacer(pairs: list[tuple[str, str]]):
    """A vectorised function that replaces each token in order, whole words and any case. Spaces stay. Null gives null, '' gives ''.

    The order matters: what one replacement leaves is what the next one sees. Only tokens that a text holds are looked for.
    """
    # Where nothing has a mark, Python's own boundary is the rule's, and much faster.
    plain = [(t.casefold(), re.compile(rf"\b{re.escape(t)}\b", re.I), s) for t, s in pairs]
    substitutes = "".join(s for _, s in pairs)
    mark, marked = re.compile(f"[{_marks()}]"), []

    def one(text: str | None) -> str | None:
        if text:
            compiled = plain
            if not text.isascii() and mark.search(text) or mark.search(substitutes):
                if not marked:
                    word = rf"[\w{_marks()}]"
                    marked.extend((t.casefold(), re.compile(bounded(t, re.escape(t), word), re.I), s) for t, s in pairs)
                compiled = marked
            low = text.casefold()
            for folded, pattern, subst in compiled:
                # What matches in any case is equal without case; text without the token needs no search.
                if folded in low:
                    text, n = pattern.subn(lambda m, s=subst: s, text)
                    if n:
                        low = text.casefold()
        return text

    @F.pandas_udf(StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return run


def ordered_pairs(anti: DataFrame) -> list[tuple[str, str]]:
    """The list in order, of a repeated token the first place and the last substitute. It comes to the driver: a list of stop
    words, at most some of a language's vocabulary, however large the collection."""
    rows = anti.groupBy("token").agg(F.min("ord").alias("first"), F.max_by("subst", "ord").alias("subst")).filter("token is not null and token != ''")
    return [(r["token"], r["subst"] or "") for r in rows.orderBy("first", "token").collect()]


def filtered_corpus(df: DataFrame, anti: DataFrame, text_cols: list[str] | None = None) -> DataFrame:
    """``df`` with the tokens of ``anti`` (ord, token, subst) replaced in titles and texts; an empty list changes nothing. Lists of any
    length follow one rule; each LIST tokens are one function, applied to what the ones before leave."""
    pairs = ordered_pairs(anti)
    ship(df.sparkSession)
    cols = [c for c in text_cols or ["titre", "texte"] if c in df.columns]
    for i in range(0, len(pairs), LIST):
        change = replacer(pairs[i : i + LIST])
        df = df.withColumns({c: change(F.col(c)) for c in cols})
    return df
