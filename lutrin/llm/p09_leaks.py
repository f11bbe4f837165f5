"""Problem 9: evaluation texts that leak into a corpus, found with Wu and Manber's multi-pattern search.

The alphabet is words (runs of letters and digits without case and accents), the patterns are all runs of
``min_words`` words of the items. A shift table over blocks of two words skips positions where no pattern can end; where one can, a
second table over a pattern's first and last block selects the runs to compare. Both tables have a fixed size, whatever the number
of items, and go to all tasks; one scan of the corpus reads them. Patterns and the selected runs of documents meet in buckets by the
hash of the run, and direct comparison of the words confirms.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fold_words, map_rows

#: Words in a block of the shift table.
BLOCK = 2
#: Slots of the shift table, a byte each, and of the table of first and last blocks, a bit each, as powers of two. Of blocks that share
#: a slot the least shift counts, so more items cost speed, never a find.
SHIFT_BITS, PAIR_BITS = 22, 24

#: Tags, comments, link targets, BBCode, entities, of any length; all but comments stop where the next could begin.
_MARKUP = re.compile(
    r"</?[A-Za-z][^<>]*>|<!--.*?-->|\]\([^()\s]+\)|\[/?(?:b|i|u|s|em|strong|code|quote|url)(?:=[^\[\]]*)?\](?!\()"
    r"|&(?:[A-Za-z][A-Za-z0-9]*|#0*(?P<dec>\d{1,7})|#[xX]0*(?P<hex>[0-9A-Fa-f]{1,6}));",
    re.S,
)


def _without(m: re.Match) -> str:
    """What mark-up leaves: an entity its character, a link target a blank, the rest nothing."""
    if m[0][0] != "&":
        return " " if m[0][0] == "]" else ""
    return html.unescape(f"&#{m['dec']};" if m["dec"] else f"&#x{m['hex']};" if m["hex"] else m[0])


def word_views(text: str) -> list[list[str]]:
    """Words of a text; for one with mark-up also those of the text without it."""
    views = [fold_words(text)]
    if ("<" in text or "[" in text or "&" in text) and (plain := _MARKUP.sub(_without, text)) != text:
        views.append(fold_words(plain))
    return views


class _Codes(dict):
    """A hash of each word, remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        n = zlib.crc32(word.encode())
        if len(self) < 500_000:
            self[word] = n
        return n


def _block(a: int, b: int) -> int:
    """The hash of a block of two words."""
    return (a * 0x9E3779B1 ^ b * 0x85EBCA6B) & 0x7FFFFFFFFFFF


def _pair(first: int, last: int) -> int:
    """The slot of a pattern's first and last block."""
    return ((first * 0xC2B2AE35 ^ last * 0x27D4EB2F) >> 7) & ((1 << PAIR_BITS) - 1)


class WuManber:
    """Search for runs of ``length`` words that may be patterns, by tables of fixed size."""

    def __init__(self, shifts: dict[int, int], pairs: Iterable[int], length: int):
        import numpy as np

        self.length, self.codes = length, _Codes()
        #: A block of no pattern lets the window pass it whole.
        self.shift = bytearray([length - BLOCK + 1]) * (1 << SHIFT_BITS)
        for slot, n in shifts.items():
            self.shift[slot] = n
        bits = np.zeros(1 << PAIR_BITS, dtype=bool)
        bits[np.fromiter(pairs, dtype=np.int64)] = True
        self.pairs = np.packbits(bits, bitorder="little").tobytes()

    @staticmethod
    def entries(run: list[str]) -> tuple[list[tuple[int, int]], int]:
        """(slot, shift) of each block of a pattern, and the slot of its first and last block."""
        codes = [zlib.crc32(w.encode()) for w in run]
        blocks = [_block(a, b) for a, b in zip(codes, codes[1:])]
        shifts = [(h & ((1 << SHIFT_BITS) - 1), len(run) - BLOCK - i) for i, h in enumerate(blocks)]
        return shifts, _pair(blocks[0], blocks[-1])

    def selected(self, words: list[str]) -> Iterator[list[str]]:
        """The runs of ``words`` that the tables don't rule out."""
        codes = list(map(self.codes.__getitem__, words))
        at, n, m = self.length, len(codes), self.length
        shift, pairs, mask = self.shift, self.pairs, (1 << SHIFT_BITS) - 1
        while at <= n:
            last = _block(codes[at - 2], codes[at - 1])
            step = shift[last & mask]
            if step:
                at += step
                continue
            slot = _pair(_block(codes[at - m], codes[at - m + 1]), last)
            if pairs[slot >> 3] >> (slot & 7) & 1:
                yield words[at - m : at]
            at += 1


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", min_words: int = 10) -> DataFrame:
    """(doc_id, item_id): each document and item that share a run of at least ``min_words`` consecutive words,
    regardless of case, accents, punctuation, mark-up and spacing.

    Null, empty and shorter texts share none; rows without an id are left out; repeated rows and repeated passages give one
    pair. Equal items leak together. ``min_words`` is 3 or more. Items are cut to patterns in tasks; what comes to the driver and goes to
    all tasks is the two tables, whose size is fixed. Documents are scanned once, in their partition, and only selected
    runs leave it; runs in very many documents are split by adaptive execution.
    """
    if min_words <= BLOCK:
        raise ValueError(f"runs of more than {BLOCK} words are needed")
    spark = docs.sparkSession
    some = docs.select(F.col(doc_id).alias("rid"), F.col(doc_text).alias("text")).filter("rid is not null and text is not null")
    known = items.select(F.col(item_id).alias("iid"), F.col(item_text).alias("text")).filter("iid is not null and text is not null")
    d_kind, i_kind = some.schema["rid"].dataType.simpleString(), known.schema["iid"].dataType.simpleString()

    def cut_up():
        def run(parts: Iterator[dict[str, list]]) -> Iterator[list[tuple]]:
            for part in parts:
                rows = []
                for iid, text in zip(part["iid"], part["text"]):
                    runs = {" ".join(w[i : i + min_words]) for w in word_views(text) for i in range(len(w) - min_words + 1)}
                    rows += [(r, iid) for r in runs]
                yield rows

        return run

    def tabulate():
        def run(parts: Iterator[dict[str, list]]) -> Iterator[list[tuple]]:
            for part in parts:
                rows = []
                for r in part["run"]:
                    shifts, pair = WuManber.entries(r.split(" "))
                    rows += [(False, slot, n) for slot, n in shifts]
                    rows.append((True, pair, 0))
                yield rows

        return run

    patterns = cut(map_rows(known, f"run string, iid {i_kind}", cut_up).distinct())
    # At most one row for each slot of the two tables.
    slots = map_rows(patterns.select("run").distinct(), "pair boolean, slot long, shift int", tabulate).groupBy("pair", "slot").agg(F.min("shift").alias("shift"))
    shifts, pairs = {}, []
    for r in slots.toLocalIterator():
        if r["pair"]:
            pairs.append(r["slot"])
        else:
            shifts[r["slot"]] = r["shift"]
    if not pairs:
        return spark.createDataFrame([], f"{doc_id} {d_kind}, {item_id} {i_kind}")
    sent = spark.sparkContext.broadcast(WuManber(shifts, pairs, min_words))

    def make():
        machine: WuManber = sent.value

        def run(parts: Iterator[dict[str, list]]) -> Iterator[list[tuple]]:
            for part in parts:
                rows = []
                for rid, text in zip(part["rid"], part["text"]):
                    rows += [(rid, r) for r in {" ".join(r) for words in word_views(text) for r in machine.selected(words)}]
                yield rows

        return run

    selected = map_rows(some, f"rid {d_kind}, run string", make)
    return selected.join(patterns, "run").select(F.col("rid").alias(doc_id), F.col("iid").alias(item_id)).distinct()
