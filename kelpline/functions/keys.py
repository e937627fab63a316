"""Byte-string keys: prefix tests, range bounds and the prefixes of transaction columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: One byte before the user key for each transaction column.
COLUMN_PREFIX = {"lock": "l", "data": "d", "write": "w", "error": "e", "commit": "c", "rollback": "r"}


def starts_with(key: Column, prefix: bytes) -> Column:
    return F.startswith(key, F.lit(prefix))


def in_range(key: Column, start: bytes | None, end: bytes | None) -> Column:
    """Half-open [start, end) in unsigned byte order; None or b'' is an open bound."""
    cond = F.lit(True)
    if start:
        cond = cond & (key >= F.lit(start))
    if end:
        cond = cond & (key < F.lit(end))
    return cond


def big_endian(value: Column, n_bytes: int) -> Column:
    return F.unhex(F.lpad(F.hex(value), 2 * n_bytes, "0"))


def txn_key(kind: str, key: Column, physical: Column | None = None, logical: Column | None = None) -> Column:
    """The stored key of a transaction column; with a start timestamp for error, commit and rollback."""
    parts = [F.lit(COLUMN_PREFIX[kind].encode()), key]
    if physical is not None:
        parts += [big_endian(physical, 8), big_endian(logical, 4)]
    return F.concat(*parts)


def vector_key(vec_id: Column) -> Column:
    return F.encode(F.concat(F.lit("vec:"), vec_id.cast("string")), "UTF-8")


def vector_id(key: Column) -> Column:
    """The id in a key 'vec:<decimal>'; null for other keys."""
    text = F.decode(F.when(starts_with(key, b"vec:"), key), "UTF-8")
    return F.when(text.rlike("^vec:[0-9]{1,18}$"), F.substring(text, 5, 18).cast("bigint"))
