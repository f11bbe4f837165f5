"""Porter's Snowball stemmer for French, from the published description of the algorithm."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

VOWELS = "aeiouyâàëéêèïîôûù"
_V = f"[{VOWELS}]"
#: Suffixes of the algorithm's steps. Fixed values.
STEP1 = {
    "delete_r2": "ance iqUe isme able iste eux ances iqUes ismes ables istes".split(),
    "ic_r2": "atrice ateur ation atrices ateurs ations".split(),
    "log": "logie logies".split(),
    "u": "usion ution usions utions".split(),
    "ent": "ence ences".split(),
    "ement": "ement ements".split(),
    "ite": "ité ités".split(),
    "if": "if ive ifs ives".split(),
    "eaux": ["eaux"],
    "aux": ["aux"],
    "euse": "euse euses".split(),
    "issement": "issement issements".split(),
    "amment": ["amment"],
    "emment": ["emment"],
    "ment": "ment ments".split(),
}
STEP2A = "îmes ît îtes i ie ies ir ira irai iraIent irais irait iras irent irez iriez irions irons iront is issaIent issais issait issant issante issantes issants isse issent isses issez issiez issions issons it".split()
STEP2B_ONS = ["ions"]
STEP2B_E = "é ée ées és èrent er era erai eraIent erais erait eras erez eriez erions erons eront ez iez".split()
STEP2B_A = "âmes ât âtes a ai aIent ais ait ant ante antes ants as asse assent asses assiez assions".split()


def _longest(word: str, suffixes: list[str]) -> str:
    return max((s for s in suffixes if word.endswith(s)), key=len, default="")


def _regions(w: str) -> tuple[int, int, int]:
    """Where RV, R1 and R2 begin."""
    if re.match(f"{_V}{_V}", w) or w.startswith(("par", "col", "tap")):
        rv = 3
    else:
        m = re.search(_V, w[1:])
        rv = m.end() + 1 if m else len(w)
    m = re.search(f"{_V}[^{VOWELS}]", w)
    r1 = m.end() if m else len(w)
    m = re.search(f"{_V}[^{VOWELS}]", w[r1:])
    r2 = r1 + m.end() if m else len(w)
    return min(rv, len(w)), r1, r2


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    """The stem of a lower-case word."""
    w = word.lower()
    # Vowels that act as consonants are marked by capitals.
    w = re.sub(f"(?<={_V})([ui])(?={_V})", lambda m: m[1].upper(), w)
    w = re.sub(f"(?<={_V})y|y(?={_V})", "Y", w)
    w = re.sub("(?<=q)u", "U", w)
    w = w.replace("ë", "He").replace("ï", "Hi")
    rv, r1, r2 = _regions(w)
    start = w
    w, ment = _step1(w, rv, r1, r2)
    changed = w != start and not ment
    if not changed:
        before = w
        w = _step2a(w, rv)
        if w == before:
            w = _step2b(w, rv, r2)
        changed = w != before
    if changed or w != start and not ment:
        if w.endswith("Y"):
            w = w[:-1] + "i"
        elif w.endswith("ç"):
            w = w[:-1] + "c"
    else:
        w = _step4(w, rv, r2)
    for double in ("enn", "onn", "ett", "ell", "eill"):
        if w.endswith(double):
            w = w[:-1]
            break
    w = re.sub(f"[éè]([^{VOWELS}]+)$", r"e\1", w)
    return w.replace("He", "ë").replace("Hi", "ï").lower()


def _step1(w: str, rv: int, r1: int, r2: int) -> tuple[str, bool]:
    """Standard suffixes; the flag tells that one ending in -ment went, after which verb suffixes are tried too."""
    kind, suffix = "", ""
    for k, suffixes in STEP1.items():
        s = _longest(w, suffixes)
        if len(s) > len(suffix):
            kind, suffix = k, s
    if not suffix:
        return w, False
    at = len(w) - len(suffix)
    base = w[:at]
    in_rv, in_r1, in_r2 = at >= rv, at >= r1, at >= r2

    def drop(text: str, end: str, region: int) -> str | None:
        return text[: -len(end)] if text.endswith(end) and len(text) - len(end) >= region else None

    if kind == "delete_r2":
        return (base, False) if in_r2 else (w, False)
    if kind == "ic_r2":
        if not in_r2:
            return w, False
        if base.endswith("ic"):
            return (base[:-2] if len(base) - 2 >= r2 else base[:-2] + "iqU"), False
        return base, False
    if kind == "log":
        return (base + "log", False) if in_r2 else (w, False)
    if kind == "u":
        return (base + "u", False) if in_r2 else (w, False)
    if kind == "ent":
        return (base + "ent", False) if in_r2 else (w, False)
    if kind == "ement":
        if not in_rv:
            return w, False
        if (x := drop(base, "iv", r2)) is not None:
            return (y if (y := drop(x, "at", r2)) is not None else x), False
        if base.endswith("eus"):
            p = len(base) - 3
            return (base[:-3] if p >= r2 else base[:-1] + "x" if p >= r1 else base), False
        for end in ("abl", "iqU"):
            if base.endswith(end):
                return (x if (x := drop(base, end, r2)) is not None else base), False
        for end in ("ièr", "Ièr"):
            if base.endswith(end):
                return (base[:-3] + "i" if len(base) - 3 >= rv else base), False
        return base, False
    if kind == "ite":
        if not in_r2:
            return w, False
        if base.endswith("abil"):
            return (base[:-4] if len(base) - 4 >= r2 else base[:-4] + "abl"), False
        if base.endswith("ic"):
            return (base[:-2] if len(base) - 2 >= r2 else base[:-2] + "iqU"), False
        return (x if (x := drop(base, "iv", r2)) is not None else base), False
    if kind == "if":
        if not in_r2:
            return w, False
        if (x := drop(base, "at", r2)) is not None:
            if x.endswith("ic"):
                return (x[:-2] if len(x) - 2 >= r2 else x[:-2] + "iqU"), False
            return x, False
        return base, False
    if kind == "eaux":
        return base + "eau", False
    if kind == "aux":
        return (base + "al", False) if in_r1 else (w, False)
    if kind == "euse":
        return (base if in_r2 else base + "eux" if in_r1 else w), False
    if kind == "issement":
        return (base, False) if in_r1 and base and base[-1] not in VOWELS else (w, False)
    if kind == "amment":
        return (base + "ant", True) if in_rv else (w, False)
    if kind == "emment":
        return (base + "ent", True) if in_rv else (w, False)
    # -ment after a vowel of RV
    return (base, True) if base and base[-1] in VOWELS and at - 1 >= rv else (w, False)


def _step2a(w: str, rv: int) -> str:
    """Verb suffixes in i, after a consonant that also lies in RV."""
    s = _longest(w[rv:], STEP2A)
    at = len(w) - len(s)
    if s and at - 1 >= rv and w[at - 1] not in VOWELS and w[at - 1] != "H":
        return w[:at]
    return w


def _step2b(w: str, rv: int, r2: int) -> str:
    """Other verb suffixes."""
    s = _longest(w[rv:], STEP2B_ONS + STEP2B_E + STEP2B_A)
    at = len(w) - len(s)
    if not s:
        return w
    if s in STEP2B_ONS:
        return w[:at] if at >= r2 else w
    if s in STEP2B_E:
        return w[:at]
    return w[: at - 1] if at - 1 >= rv and w[at - 1] == "e" else w[:at]


def _step4(w: str, rv: int, r2: int) -> str:
    """Residual suffixes."""
    if w.endswith("s") and len(w) > 1 and (w.endswith("His") or w[-2] not in "aiouès"):
        w = w[:-1]
    s = _longest(w[rv:], ["ion", "ier", "ière", "Ier", "Ière", "e"])
    at = len(w) - len(s)
    if s == "ion":
        if at >= r2 and at - 1 >= rv and w[at - 1] in "st":
            return w[:at]
    elif s in ("ier", "ière", "Ier", "Ière"):
        return w[:at] + "i"
    elif s == "e":
        return w[:at]
    return w


@F.pandas_udf(StringType())
def french_stem(s: pd.Series) -> pd.Series:
    """Stems of a column, by Arrow batches. Apply it to distinct words. Null gives null."""
    return s.map(lambda w: None if w is None else stem(w))
