"""The public table of look-alike characters, as the Unicode library in Spark's jars has it.

The file's layout: a header whose size its first two bytes give; then, big-endian, a magic number, version and length, and offset and
size of the keys, of their values and of a table of strings. A key has a code point in its lower 24 bits and the length of the prototype
less one above; the value is the prototype itself if that is one UTF-16 unit, else where it begins in the string table.
"""

from __future__ import annotations

import glob
import os
import struct
import zipfile

NAME = "com/ibm/icu/impl/data/icudata/confusables.cfu"
_MAGIC = 0x3845FDEF
_table: dict[str, str] | None = None


def find() -> bytes:
    """The file in the jar beside this machine's Spark."""
    import pyspark

    roots = [os.path.join(os.environ["SPARK_HOME"], "jars")] if "SPARK_HOME" in os.environ else []
    for jar in sorted(j for root in [*roots, os.path.join(pyspark.__path__[0], "jars")] for j in glob.glob(os.path.join(root, "icu4j-*.jar"))):
        with zipfile.ZipFile(jar) as z:
            if NAME in z.namelist():
                return z.read(NAME)
    raise FileNotFoundError(f"no {NAME} in the jars of Spark")


def parse(data: bytes) -> dict[str, str]:
    """Prototype by character."""
    data = data[struct.unpack_from(">H", data)[0] :]
    magic, _, _, keys, n_keys, values, n_values, strings, n_strings = struct.unpack_from(">9I", data)
    if magic != _MAGIC or n_keys != n_values:
        raise ValueError("not a table of look-alike characters")
    units = data[strings : strings + 2 * n_strings]
    found = {}
    for key, value in zip(struct.unpack_from(f">{n_keys}I", data, keys), struct.unpack_from(f">{n_values}H", data, values)):
        n = (key >> 24) + 1
        own = struct.pack(">H", value) if n == 1 else units[2 * value : 2 * (value + n)]
        found[chr(key & 0xFFFFFF)] = own.decode("utf-16-be")
    return found


def table() -> dict[str, str]:
    """The table, read once in a process or installed there."""
    global _table
    if _table is None:
        _table = parse(find())
    return _table


def install(known: dict[str, str]) -> None:
    """Gives this process the table of the driver, so that all tasks have the same one wherever their Spark is."""
    global _table
    if _table is None:
        _table = known
