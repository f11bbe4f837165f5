"""What the operators of this subpackage share."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from lutrin.session import cut, ship

from . import confusables

__all__ = ["BATCH_ROWS", "cut", "fold_words", "map_rows", "ship", "strip_marks"]

#: Rows of an Arrow batch that Python handles at once; bounds a worker's memory with long texts.
BATCH_ROWS = 2000

_MARKS = re.compile("[̀-ͯ᪰-᫿᷀-᷿⃐-⃿︠-︯]+")
_UNSEEN = re.compile("[­​-‏‪-‮⁠-⁤﻿]+")
_WORD = re.compile(r"[^\W_]+")


def strip_marks(text: str) -> str:
    """Compatibility-decomposed ``text`` without combining marks and invisible characters, lower case."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFKD", _UNSEEN.sub("", text))
    return _MARKS.sub("", text).lower()


def fold_words(text: str) -> list[str]:
    """Runs of letters and digits of ``text``, without case and accents."""
    return _WORD.findall(strip_marks(text))


def map_rows(df: DataFrame, schema: str, make: Callable[[], Callable[[Iterator[dict[str, list]]], Iterator[list[tuple]]]]) -> DataFrame:
    """``df`` through Arrow: ``make()`` runs once a task and gets batches as lists by column.

    It yields lists of output rows, of any number. Rows stay in their partition: no shuffle.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    ship(df.sparkSession)
    known = confusables.table()
    kind = _parse_datatype_string(schema)
    assert isinstance(kind, StructType)
    names = kind.fieldNames()
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        confusables.install(known)

        def parts() -> Iterator[dict[str, list]]:
            for batch in batches:
                for at in range(0, batch.num_rows, BATCH_ROWS):
                    part = batch.slice(at, BATCH_ROWS)
                    yield {n: c.to_pylist() for n, c in zip(part.schema.names, part.columns)}

        for rows in make()(parts()):
            for at in range(0, len(rows), 20_000):
                some = rows[at : at + 20_000]
                columns = list(zip(*some)) if some else [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return df.mapInArrow(run, kind)
