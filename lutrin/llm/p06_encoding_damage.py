"""Problem 6: text that was decoded with the wrong character encoding.

Characters are mapped back to the bytes of the legacy encoding that may have produced them, and an automaton of UTF-8's byte
structure finds the maximal well-formed multibyte spans among them. Only those spans are decoded, whatever their alphabet, unless
chance could have made them; a text damaged twice takes two passes. Single-byte text read in another single-byte encoding has no such structure; there a word is mapped back if it
holds characters that can't stand in it and its other reading has none. Replacement characters and question marks inside
words show damage that can't be undone.
"""

from __future__ import annotations

import base64
import re
import unicodedata
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

#: Encodings in which UTF-8 bytes may have been read. Fixed values.
READ_AS = ["cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "iso8859_15"]
#: Encodings in which bytes of cp1252 may have been read. Fixed values.
SINGLE_AS = ["mac_roman", "cp437", "cp1251", "cp850"]
PASSES = 4

#: Letters, signs and spaces that French text holds; capitals count apart.
_SMALL = "àâäæçèéêëîïôöùûüÿœñóáíúß"
_CAPITAL = "ÀÂÄÆÇÈÉÊËÎÏÔÖÙÛÜŸŒÁÓÚÅØÍÌÒÑ"
_SIGNS = "«»‘’“”…–—‐‑•·°²³¹½¼¾€£§©®™×±µ   "
#: Look-alikes of Latin letters; in a Latin word they speak of another problem. Fixed values.
LOOKALIKES = frozenset("асеорхуіѕјԁһԛԝӏАВСЕІЈКМНОРЅТХУӀονριυκγηχΑΒΕΖΗΙΚΜΝΟΡΤΥΧıɑɡⅼɩʋ")

#: What a text must hold for either repair to have anything to do: a run of characters beyond ASCII, or an odd one.
_RUN = re.compile(r"[^\x00-\x7f]{2}")
_STRAY = re.compile(f"[^\\x00-\\x7f{_SMALL}{_SIGNS}⁰-₟](?:(?<![{_CAPITAL}])|(?<=[^\\W\\d_].))")
#: Marks of a lost character: question marks within, at the end or at the beginning of a word, or doubled.
_LOST = re.compile(
    r"\?(?:\?|(?<=[^\W\d_]\?)(?=[^\W\d_]|[,.;:]|[ '’-][a-zà-ÿ]|\s*$)|(?:(?<=[\s'’(«-]\?)|(?<=^\?))(?=[^\W\d_])|(?<=[^\W\d_] \?)(?= [a-zà-ÿ])|(?:(?<=\n\?)|(?<=^\?))(?= [^\W\d_]))",
    re.M,
)
#: A shifted sequence of UTF-7; each character takes two and two thirds of these signs.
_SHIFTED = re.compile(r"\+([A-Za-z0-9+/]{3,})-?")
_CONTROL = re.compile(r"[\x80-\x84\x86-\x9f]")
_WORD = re.compile(r"[^\s'’\-/|>.,;:()\"]+")
#: A lead byte's continuation bytes, the automaton's first transition: state by byte.
_NEED = [0] * 0xC2 + [1] * 30 + [2] * 16 + [3] * 5 + [0] * 11


def _byte_map(codec: str) -> dict[str, int]:
    """Character to byte of 0x80 to 0xff; bytes the encoding leaves open are read as C1 control characters."""
    table = {}
    for b in range(0x80, 0x100):
        try:
            table[bytes([b]).decode(codec)] = b
        except UnicodeDecodeError:
            table[chr(b)] = b
    return table


_MAPS = {c: _byte_map(c) for c in dict.fromkeys(READ_AS + SINGLE_AS)}
_RUNS = {c: re.compile("[" + re.escape("".join(_MAPS[c])) + "]{2,}") for c in READ_AS}
_BACK = {c: {ch: bytes([b]).decode("cp1252", "ignore") or ch for ch, b in _MAPS[c].items()} for c in SINGLE_AS}


def _likely(ch: str) -> bool:
    """Whether a decoded character is one that such text holds: letters of Europe, punctuation, signs."""
    o = ord(ch)
    return 0x80 <= o < 0x180 or 0x2C0 <= o < 0x2E0 or o == 0x192 or 0x370 <= o < 0x500 or 0x1E00 <= o < 0x1F00 or 0x2000 <= o < 0x20C0 or 0x2100 <= o < 0x2300 or ch in "ﬁﬂ�​﻿"


def _script(ch: str) -> str:
    """The alphabet of a letter, one for those of East Asia; '' for what isn't a letter of one."""
    if unicodedata.category(ch)[0] != "L":
        return ""
    name = unicodedata.name(ch, "").split()[0] if unicodedata.name(ch, "") else ""
    return "EAST" if name in ("CJK", "HIRAGANA", "KATAKANA", "KATAKANA-HIRAGANA", "HANGUL", "BOPOMOFO") else name


def _assigned(text: str) -> bool:
    return all(unicodedata.category(c) not in ("Cn", "Co", "Cs", "Cc") for c in text)


def _proven(text: str) -> str | None:
    """The alphabet that a decoded span shows to be meant, '' for signs such as emoji; None if chance could have made it.

    A character of four bytes, or a sign of three, isn't made by chance, nor are two letters of one alphabet side by side."""
    if not _assigned(text):
        return None
    own = {_script(c) for c in text if not _likely(c)}
    if own == {""}:
        return "" if any(ord(c) > 0xFFFF or 0x2300 <= ord(c) < 0x2C00 for c in text) else None
    own.discard("")
    letters = sum(_script(c) in own for c in text)
    return own.pop() if len(own) == 1 and (letters > 1 or any(ord(c) > 0xFFFF for c in text)) and "LATIN" not in own else None


def spans(codes: list[int]) -> Iterator[tuple[int, int]]:
    """Maximal well-formed spans of multibyte UTF-8 characters in a list of byte values above 0x7f."""
    at, begin, n = 0, None, len(codes)
    while at < n:
        b = codes[at]
        need = _NEED[b]
        good = need and at + need < n and all(0x80 <= c < 0xC0 for c in codes[at + 1 : at + 1 + need])
        if good and need > 1:  # overlong forms, surrogates and numbers beyond Unicode are malformed
            second = codes[at + 1]
            good = not (b == 0xE0 and second < 0xA0 or b == 0xED and second >= 0xA0 or b == 0xF0 and second < 0x90 or b == 0xF4 and second >= 0x90)
        if good:
            begin = at if begin is None else begin
            at += need + 1
        else:
            if begin is not None:
                yield begin, at
            begin, at = None, at + 1
    if begin is not None:
        yield begin, n


def _undo_multibyte(text: str, codec: str) -> tuple[str, int]:
    """``text`` with the well-formed spans decoded, and how many characters came out.

    Spans of letters and signs of Europe are taken as they are, others where they can't be chance; where an alphabet is shown to be
    meant, its single letters are taken too."""
    table, n = _MAPS[codec], 0
    found: dict[str, list[tuple[int, int, str]]] = {}
    shown: set[str] = set()
    for run in set(_RUNS[codec].findall(text)):
        codes = [table[c] for c in run]
        # Letters that look Latin, put in for them, may happen to be well formed too.
        own = [(a, b, bytes(codes[a:b]).decode("utf-8")) for a, b in spans(codes) if not LOOKALIKES.issuperset(run[a:b])]
        if own:
            found[run] = own
            shown.update(s for _, _, got in own if not all(map(_likely, got)) and (s := _proven(got)))
    if not found:
        return text, 0

    def meant(got: str) -> bool:
        return all(map(_likely, got)) or _proven(got) is not None or bool(shown) and _assigned(got) and all(_likely(c) or _script(c) in shown for c in got)

    def fix(m: re.Match) -> str:
        nonlocal n
        run, out, last = m[0], [], 0
        for a, b, got in found.get(run, ()):
            if meant(got):
                out += [run[last:a], got]
                last, n = b, n + len(got)
        return "".join(out) + run[last:]

    return _RUNS[codec].sub(fix, text), n


def _undo_utf7(text: str) -> tuple[str, bool]:
    """``text`` with the shifted sequences of UTF-7 decoded: characters beyond ASCII as base64 of UTF-16 between + and -. A sequence's
    last bits, that make up no character, are zero; letters beyond those of Europe need two of one alphabet."""

    def fix(m: re.Match) -> str:
        bits = len(m[1]) * 6 % 16
        data = base64.b64decode(m[1] + "A" * (-len(m[1]) % 4))
        got = data[: len(m[1]) * 6 // 16 * 2].decode("utf-16-be", "replace")
        if all(c >= "\xa0" and _likely(c) and c != "�" for c in got):
            return got
        rest = int.from_bytes(data, "big") >> (8 * len(data) - 6 * len(m[1])) & ((1 << bits) - 1)
        return got if bits < 6 and rest == 0 and all(c >= "\xa0" for c in got) and _proven(got) is not None else m[0]

    other = _SHIFTED.sub(fix, text)
    return other, other != text


def _odd(word: str) -> int:
    """Characters of a word that can't stand in it: capitals after small letters, letters of two scripts, stray signs."""
    if word.isascii():
        return 0
    latin = any("a" <= c.lower() <= "z" or c in _SMALL or c in _CAPITAL for c in word)
    odd = 0
    for i, c in enumerate(word):
        if c.isascii() or c in _SMALL:
            continue
        if c in "‚„":
            odd += len(word) > 1 and word[0] != c
        elif c in _CAPITAL:
            odd += bool(i and (word[i - 1].islower()) or i + 1 < len(word) and word[i + 1].islower() and i and word[i - 1].isalpha())
        elif "\x80" <= c < "\xa0":
            odd += 1
        elif c in _SIGNS or c in LOOKALIKES or unicodedata.combining(c) or unicodedata.category(c) in ("Cf", "Zs"):
            continue
        elif unicodedata.category(c)[0] == "L":
            name = unicodedata.name(c, "")
            if name.startswith("LATIN") or name.startswith(("FULLWIDTH", "MODIFIER", "SUPERSCRIPT")):
                continue
            odd += latin or len(word) == 1
        elif 0x2500 <= ord(c) < 0x2600 or 0x2C0 <= ord(c) < 0x2E0 or c in "‡†¿´ª¬√≈∆≤≥∞⌐⌠⌡∩≡∙¶¯¸¡¢¥¤¦¨º":
            odd += 1
    return odd


def _undo_single(text: str) -> tuple[str, bool]:
    """``text`` with its odd words read in cp1252, by the one encoding that explains most of them."""
    words = _WORD.findall(text)
    odd = {w: k for w in set(words) if (k := _odd(w))}
    # A letter alone isn't odd where the text has whole words of its alphabet.
    whole = {_script(w[0]) for w in set(words) if len(w) > 2 and w not in odd and not w.isascii() and len({_script(c) for c in w}) == 1} - {"LATIN", ""}
    odd = {w: k for w, k in odd.items() if len(w) > 1 or _script(w) not in whole}
    if not odd:
        return text, False
    best, table = 0, None
    for codec in SINGLE_AS:
        back = _BACK[codec]
        gain = 0
        for w, k in odd.items():
            other = "".join(back.get(c, c) for c in w)
            gain += k - _odd(other) if all(c.isascii() or c in _SMALL or c in _CAPITAL or c in _SIGNS for c in other) else -k
        if gain > best:
            best, table = gain, back
    if table is None:
        return text, False

    def fix(m: re.Match) -> str:
        w = m[0]
        # A damaged capital or sign alone has no neighbours that tell; it goes with the rest.
        if w in odd or len(w) == 1 and w in "аАα└╔" and _script(w) not in whole:
            other = "".join(table.get(c, c) for c in w)
            # No word is made worse than it was.
            return other if w not in odd or _odd(other) < odd[w] else w
        return w

    fixed = _WORD.sub(fix, text)
    return fixed, fixed != text


def repair(text: str | None) -> tuple[bool, str | None, bool]:
    """(damaged, the text as far as it can be restored, whether nothing is left damaged)."""
    if not text:
        return False, text, True
    lost = "�" in text or "?" in text and bool(_LOST.search(text))
    damaged = False
    if "+" in text:
        text, damaged = _undo_utf7(text)
    if text.isascii():
        return lost or damaged, text, not lost
    for _ in range(PASSES):
        if not _RUN.search(text):
            break
        tries = [_undo_multibyte(text, c) for c in READ_AS]
        best = max(tries, key=lambda x: x[1])
        if not best[1]:
            break
        text, damaged = best[0], True
    if not damaged and not _STRAY.search(text):
        return lost, text, not lost
    text, more = _undo_single(text)
    control = bool(_CONTROL.search(text))
    return damaged or more or lost or control, text, not (lost or control)


def damage(df: DataFrame, id_col: str = "rec_id", text_cols: list[str] | None = None) -> DataFrame:
    """(id, field, repaired, recovered) for every damaged value of ``text_cols`` (texte, titre, auteur).

    ``repaired`` is the text as far as it can be restored; ``recovered`` tells if nothing is left damaged. Null and empty
    values aren't damaged; repeated rows come out each; null ids stay null. Rows stay in their partition.
    """
    text_cols = text_cols or ["texte", "titre", "auteur"]

    def make():
        def run(parts: Iterator[dict[str, list]]) -> Iterator[list[tuple]]:
            for part in parts:
                rows = []
                for field in text_cols:
                    for rid, text in zip(part["rid"], part[field]):
                        bad, fixed, whole = repair(text)
                        if bad:
                            rows.append((rid, field, fixed, whole))
                yield rows

        return run

    some = df.select(F.col(id_col).alias("rid"), *text_cols)
    kind = some.schema["rid"].dataType.simpleString()
    return map_rows(some, f"rid {kind}, field string, repaired string, recovered boolean", make).withColumnRenamed("rid", id_col)
