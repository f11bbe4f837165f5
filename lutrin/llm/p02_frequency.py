"""Problem 2: frequency of every distinct term, in a vertical layout.

Every term has compressed bitmaps of the records that hold it, one container for 65,536 record ids, and
beside each container a counter of its occurrences. Containers of one term and range are merged by union;
the document frequency is the cardinality of the union, so a record counts once however often it comes.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

#: Ids up to this many are kept as sorted 16-bit numbers, more as a bitmap of 8 KB.
SPARSE = 4096
#: (term, record) entries a task holds before it writes its containers.
HELD = 1_500_000
CONTAINERS = "term string, range long, bitmap binary, n_occ long"


def pack(ids: set[int] | list[int]) -> bytes:
    """Container of 16-bit ids: two bytes each while sparse, else 65,536 bits. Its length tells which."""
    import numpy as np

    a = np.unique(np.fromiter(ids, dtype=np.uint16, count=len(ids)))
    if len(a) <= SPARSE:
        return a.astype("<u2").tobytes()
    bits = np.zeros(65536, dtype=np.uint8)
    bits[a] = 1
    return np.packbits(bits).tobytes() + b"\0"  # the odd length marks a bitmap


def union(containers: list[bytes]) -> bytes:
    """Union of containers of one range."""
    import numpy as np

    if len(containers) == 1:
        return containers[0]
    if sum(map(len, containers)) <= 2 * SPARSE:
        return np.unique(np.concatenate([np.frombuffer(c, dtype="<u2") for c in containers])).astype("<u2").tobytes()
    bits = np.zeros(65536, dtype=np.uint8)
    for c in containers:
        if len(c) % 2:
            bits |= np.unpackbits(np.frombuffer(c, dtype=np.uint8, count=8192))
        else:
            bits[np.frombuffer(c, dtype="<u2")] = 1
    return pack(np.flatnonzero(bits).tolist())


def cardinality(container: bytes) -> int:
    """Number of ids in a container."""
    return int.from_bytes(container[:-1], "big").bit_count() if len(container) % 2 else len(container) // 2


def term_counter() -> Callable[[Iterable[str | None]], dict[str, int]]:
    """A function that counts the terms of a record's fields: maximal runs of letters (``\\p{L}``) of the lower-cased
    fields; a run ends with its field."""
    import regex

    # Runs without digits and the underscore may still hold numerals such as ²: only then the slower, exact pattern.
    quick, exact = re.compile(r"[^\W\d_]+"), regex.compile(r"\p{L}+")

    def count(fields: Iterable[str | None]) -> dict[str, int]:
        counts: dict[str, int] = {}
        for f in fields:
            if f:
                f = f.lower()
                words = quick.findall(f)
                if not all(map(str.isalpha, words)):
                    words = exact.findall(f)
                for w in words:
                    counts[w] = counts.get(w, 0) + 1
        return counts

    return count


def containers(df: DataFrame, id_col: str, text_cols: list[str]) -> DataFrame:
    """(term, range, bitmap, n_occ) partial containers of each task's own rows; ``range`` is id >> 16."""

    def make():
        def run(parts: Iterator[dict[str, list]]) -> Iterator[list[tuple]]:
            count = term_counter()
            held: dict[int, dict[str, list]] = defaultdict(dict)
            n = 0

            def flush() -> list[tuple]:
                rows = [(t, r, pack(ids), ids_occ) for r, by in held.items() for t, (ids, ids_occ) in by.items()]
                held.clear()
                return rows

            for part in parts:
                for rid, *fields in zip(part[id_col], *(part[c] for c in text_cols)):
                    if rid is None:
                        continue
                    counts = count(fields)
                    by, low = held[rid >> 16], rid & 0xFFFF
                    for w, k in counts.items():
                        if (e := by.get(w)) is None:
                            by[w] = [[low], k]
                        else:
                            e[0].append(low)
                            e[1] += k
                    n += len(counts)
                if n >= HELD:
                    yield flush()
                    n = 0
            yield flush()

        return run

    return map_rows(df.select(id_col, *text_cols), CONTAINERS, make)


def merged(parts: DataFrame) -> DataFrame:
    """One container for each term and range: union of its parts, sum of their counters.

    Parts are sorted within their partition and merged as they stream by; a task holds the parts of one term
    and range, and unites them whenever sixteen are waiting, so a term that is in every record is no burden.
    """

    def make():
        def run(batches: Iterator[dict[str, list]]) -> Iterator[list[tuple]]:
            key, waiting, occ = None, [], 0
            for part in batches:
                out = []
                for term, rng, bitmap, k in zip(part["term"], part["range"], part["bitmap"], part["n_occ"]):
                    if key != (term, rng):
                        if key is not None:
                            out.append((*key, union(waiting), occ))
                        key, waiting, occ = (term, rng), [], 0
                    waiting.append(bitmap)
                    occ += k
                    if len(waiting) >= 16:
                        waiting = [union(waiting)]
                if out:
                    yield out
            if key is not None:
                yield [(*key, union(waiting), occ)]

        return run

    return map_rows(parts.repartition("term", "range").sortWithinPartitions("term", "range"), CONTAINERS, make)


def term_frequencies(df: DataFrame, id_col: str = "rec_id", text_cols: list[str] | None = None) -> DataFrame:
    """(term, n_occ, n_docs): occurrences and records of every term of ``text_cols`` (titre and texte).

    Null and empty fields hold no term; a row without an id is no record and is left out; rows that repeat an
    id add to the occurrences, but the record counts once. An empty table gives no row. Columns of other names
    are never looked at. The only shuffle carries containers, already united within each task.
    """
    text_cols = text_cols or ["titre", "texte"]
    whole = merged(containers(df, id_col, text_cols))
    # Two bytes an id, or 8 KB of bits and an odd byte: both counted without Python.
    bits = F.expr("bitmap_count(substring(bitmap, 1, 8192))")
    n = F.when(F.octet_length("bitmap") % 2 == 1, bits).otherwise(F.octet_length("bitmap").cast("long") / 2).cast("long")
    return whole.groupBy("term").agg(F.sum("n_occ").alias("n_occ"), F.sum(n).alias("n_docs"))


def marked_terms(df: DataFrame, id_col: str = "rec_id", text_cols: list[str] | None = None, rare: int = 1, common: float = 0.5) -> DataFrame:
    """(term, n_occ, n_docs, mark): ``mark`` is 'rare' for terms of at most ``rare`` records, 'common' for those of
    at least the share ``common`` of all rows of ``df`` (and more than ``rare`` records), else NULL."""
    total = df.agg(F.count("*").alias("n_rows")).scalar()
    mark = F.when(F.col("n_docs") <= rare, "rare").when(F.col("n_docs") >= F.lit(common) * total, "common")
    return term_frequencies(df, id_col, text_cols).select("term", "n_occ", "n_docs", mark.alias("mark"))
