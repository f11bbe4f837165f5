"""Problem 7: text that looks ordinary but is written with other characters.

The skeleton of a text is its decomposition with every character replaced by the prototype it looks like, decomposed again; texts
that look the same have equal skeletons. Prototypes are those of the public table (module confusables), with a few more. The
consistent form replaces a letter by the plain one of equal skeleton and case, and is composed at the end; it leaves words that are
truly in another script, superscripts, fractions and typographic signs alone. A value is written with other characters if its form
differs from it while both have one skeleton.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import confusables
from .common import map_rows
from .p06_encoding_damage import repair

#: Letters that look like Latin ones in running text and that the public table has under other prototypes. Fixed values.
EXTRA = {"ӏ": "l", "к": "k", "Ԛ": "Q", "κ": "k", "χ": "x", "η": "n", "ϲ": "c", "ʋ": "v", "ȷ": "j"}
#: Letters of which a whole word in another alphabet may be made and still be meant as Latin, however short. Fixed values.
WHOLE = frozenset("асеорхуіѕјԁһԛԝӏкгѵАВСЕНІЈКМОРЅТХУԚԜӀαονριυκγχηϲϳΑΒΕΖΗΙΚΜΝΟΡΤΥΧօոսհցզ")
#: Characters that aren't seen: zero-width ones, joiners, soft hyphens, marks of direction.
UNSEEN = "­᠎​‌‍‎‏‪‫‬‭‮⁠⁡⁢⁣⁤﻿"

_PLAIN = re.compile("[\\x00-\\x7fÀ-ÖØ-öø-ÿœŒŸ«»‘’“”„…–—•·°²³¹½¼¾€£§©®™×±µ⁰-₟]*")
_WORD = re.compile(r"[^\W_](?:[^\W_]|[̀-ͯ­᠎​-‏⁠-⁤﻿])*")


@cache
def _is_latin(ch: str) -> bool:
    return unicodedata.name(ch, "").startswith(("LATIN", "FULLWIDTH LATIN", "MODIFIER LETTER SMALL", "SMALL ROMAN", "ROMAN", "MATHEMATICAL"))


@cache
def _plain_letters() -> dict[tuple[str, bool], str]:
    """The plain letter by skeleton and whether it is a capital."""
    found = {}
    for p in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz":
        found.setdefault((confusables.table().get(p, p), p.isupper()), p)
    return found


@cache
def letter(ch: str) -> str | None:
    """The plain letter that a letter of another alphabet, or a rare Latin one, looks like; None if there is none."""
    if ch in EXTRA:
        return EXTRA[ch]
    if ch.isascii() or unicodedata.category(ch)[0] != "L" or unicodedata.decomposition(ch):
        return None
    if (m := re.fullmatch("LATIN LETTER SMALL CAPITAL ([A-Z])", unicodedata.name(ch, ""))) is not None:
        return m[1].lower()
    proto = confusables.table().get(ch)
    if proto is None:
        return None
    plain = _plain_letters()
    if ch.isupper() or ch.islower():
        return plain.get((proto, ch.isupper()))
    # A letter without case: the prototype itself, or a capital, as such letters have the height of one.
    return proto if len(proto) == 1 and proto.isascii() and proto.isalpha() else plain.get((proto, True)) or plain.get((proto, False))


def _compatible(ch: str) -> str | None:
    """What a wide, narrow, styled or joined character is made of; None for others."""
    kind, _, rest = unicodedata.decomposition(ch).partition("> ")
    if unicodedata.category(ch) == "Zs":
        return " "
    if kind in ("<wide", "<narrow", "<font", "<noBreak") or kind == "<compat" and (0xFB00 <= ord(ch) <= 0xFB06 or 0x2160 <= ord(ch) < 0x2180):
        return unicodedata.normalize("NFKC", "".join(chr(int(x, 16)) for x in rest.split()))
    return None


@cache
def prototype(ch: str, letters: bool = True) -> str:
    """What the consistent form has for a character: itself, if it is plain. ``letters``: also for letters of other alphabets."""
    if ch in UNSEEN:
        return ""
    if ch in "‐‑":
        return "-"
    if (letters or _is_latin(ch)) and (plain := letter(ch)) is not None:
        return plain
    made = _compatible(ch)
    return ch if made is None else made


class _Outside(dict):
    """Prototypes by code point, filled as they are asked for; letters stay."""

    def __missing__(self, code: int) -> str:
        self[code] = got = chr(code) if code < 0x80 else prototype(chr(code), False)
        return got


_OUTSIDE = _Outside()
#: In a text with joined emoji, joiners belong to them.
_EMOJI = re.compile("[\u2190-\u2bff\ufe0f\U0001f000-\U0001faff]\u200d")
_KEEP_EMOJI = _Outside({0x200D: "\u200d"})


def _script(ch: str) -> str:
    return unicodedata.name(ch, "?").split()[0]


def _letters(word: str) -> list[str]:
    return [c for c in unicodedata.normalize("NFD", word) if c.isalpha()]


def _scripts(text: str) -> set[str]:
    """Alphabets that a text truly has words of: words without a Latin letter, with one that looks like none."""
    found = set()
    for word in _WORD.findall(text):
        if not word.isascii() and (own := _letters(word)) and not any(map(_is_latin, own)):
            found.update(_script(c) for c in own if letter(c) is None)
    return found


def form(text: str | None) -> str | None:
    """The consistent form of a text. Null stays null. Plain text, wholly foreign words, case, accents and signs stay."""
    if not text or _PLAIN.fullmatch(text):
        return text
    present: set[str] | None = None

    def word_form(m: re.Match) -> str:
        nonlocal present
        word = m[0]
        if word.isascii():
            return word
        own = _letters(word)
        foreign = bool(own) and not any(map(_is_latin, own))
        if foreign and all(letter(c) is not None for c in own) and (len(own) > 1 or own[0] in WHOLE):
            # A word all of whose letters look Latin is meant as one, unless its alphabet is used for words that can't be.
            if present is None:
                present = _scripts(text)
            foreign = not WHOLE.issuperset(own) and any(_script(c) in present for c in own)
        return "".join(prototype(c, not foreign) for c in unicodedata.normalize("NFD" if not foreign else "NFC", word))

    words = unicodedata.normalize("NFC", _WORD.sub(word_form, text))
    # Outside of words: spaces, hyphens, wide punctuation, unseen characters.
    return unicodedata.normalize("NFC", words.translate(_KEEP_EMOJI if "\u200d" in words and _EMOJI.search(words) else _OUTSIDE))


class _Skeletons(dict):
    """Prototypes by code point for skeletons."""

    def __missing__(self, code: int) -> str:
        ch, table = chr(code), confusables.table()
        if ch in UNSEEN:
            got = ""
        else:
            plain = letter(ch) or _compatible(ch) or ch
            got = "".join(table.get(c, c) for c in unicodedata.normalize("NFD", plain))
        self[code] = got
        return got


_SKELETONS = _Skeletons()


def skeleton(text: str | None) -> str | None:
    """Decomposed, each character by its prototype, decomposed again: equal for texts that look the same."""
    if not text:
        return text
    return unicodedata.normalize("NFD", unicodedata.normalize("NFD", text).translate(_SKELETONS))


def disguised(text: str | None) -> bool:
    """Whether a text looks ordinary but is written with other characters: another form of it has the same skeleton."""
    plain = form(text)
    return plain != text and skeleton(plain) == skeleton(text)


def _mapped(df: DataFrame, id_col: str, text_cols: list[str], spare_damaged: bool, only_changed: bool) -> DataFrame:
    def make():
        def run(parts: Iterator[dict[str, list]]) -> Iterator[list[tuple]]:
            for part in parts:
                rows = []
                for field in text_cols:
                    for rid, text in zip(part["rid"], part[field]):
                        plain = form(text)
                        # Damage by a wrong encoding isn't a matter of look-alikes.
                        other = plain != text and skeleton(plain) == skeleton(text) and not (spare_damaged and repair(text)[0])
                        if other or not only_changed:
                            rows.append((rid, field, plain if other else text, other))
                yield rows

        return run

    some = df.select(F.col(id_col).alias("rid"), *text_cols)
    kind = some.schema["rid"].dataType.simpleString()
    return map_rows(some, f"rid {kind}, field string, form string, changed boolean", make)


def unified(df: DataFrame, id_col: str, text_cols: list[str], spare_damaged: bool = True, only_changed: bool = False) -> DataFrame:
    """(id, field, form, changed): each value of ``text_cols`` in its consistent form.

    Null and empty values stay as they are; so do values damaged by a wrong encoding (problem 6) with ``spare_damaged``.
    Rows come out once for each column, repeated rows each; null ids stay null. Rows stay in their partition.
    """
    return _mapped(df, id_col, text_cols, spare_damaged, only_changed).withColumnRenamed("rid", id_col)


def same_looking(df: DataFrame, text_col: str) -> DataFrame:
    """(skeleton, n_forms, n_rows): groups of values that look the same, nulls left out.

    Equal values are counted before they are mapped and shuffled, so a value that is a third of all rows is one row here;
    a group is held as two numbers, never as a list.
    """
    counts = df.filter(F.col(text_col).isNotNull()).groupBy(F.col(text_col).alias("value")).agg(F.count("*").alias("n"))

    def make():
        def run(parts: Iterator[dict[str, list]]) -> Iterator[list[tuple]]:
            for part in parts:
                yield [(skeleton(v), n) for v, n in zip(part["value"], part["n"])]

        return run

    return map_rows(counts, "skeleton string, n long", make).groupBy("skeleton").agg(F.count("*").alias("n_forms"), F.sum("n").alias("n_rows"))


def look_alikes(df: DataFrame, text_cols: list[str]) -> DataFrame:
    """(field, original, skeleton, n_rows, n_forms): every different value of ``text_cols`` with the skeleton of its group, the
    rows that have it and the values of its field in the group, nulls left out.

    Equal values are counted before they are mapped and shuffled by skeleton, as in ``same_looking``.
    """
    values = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("original")) for c in text_cols))).alias("v")).select("v.*")
    counts = values.filter("original is not null").groupBy("field", "original").agg(F.count("*").alias("n_rows"))

    def make():
        def run(parts: Iterator[dict[str, list]]) -> Iterator[list[tuple]]:
            for part in parts:
                yield [(f, v, skeleton(v), n) for f, v, n in zip(part["field"], part["original"], part["n_rows"])]

        return run

    found = map_rows(counts, "field string, original string, skeleton string, n_rows long", make)
    # The digest stands for the skeleton where rows are sorted.
    group = Window.partitionBy("field", F.sha2("skeleton", 256))
    return found.withColumn("n_forms", F.count("*").over(group))
