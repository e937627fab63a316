"""Versioned key-value reads and compaction over ``user_key, physical, logical, is_delete, value``.

Versions are ordered by (physical, logical). Of several rows of one key and timestamp, one is kept: that
of the smallest ``seq``. An ``as_of`` of None means the latest.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpline.functions.keys import in_range
from kelpline.sources.fs import open_fs

HISTORY = ["user_key", "physical", "logical", "seq", "is_delete", "value"]


def history(feed: DataFrame, seq: str, keys: list[str] | None = None) -> DataFrame:
    """The versions of a feed ``(seq, user_key, ts, is_delete, value)``; null keys and timestamps are dropped. ``keys``: what
    makes a key, by default user_key alone."""
    keys = keys or ["user_key"]
    rows = feed.where("user_key IS NOT NULL AND ts.physical IS NOT NULL AND ts.logical IS NOT NULL")
    one = rows.groupBy(*keys, F.col("ts.physical").alias("physical"), F.col("ts.logical").alias("logical")).agg(
        F.min(F.struct(F.col(seq).alias("seq"), F.coalesce("is_delete", F.lit(False)).alias("is_delete"), "value")).alias("v"))
    return one.select(*keys, "physical", "logical", "v.*")


def copies(feed: DataFrame, seq: str) -> DataFrame:
    """As ``history``, but rows of one key and timestamp are left as they are: enough for ``newest``, ``get``
    and ``scan``, which settle them on the way, and without a shuffle of its own."""
    return feed.select("user_key", F.col("ts.physical").alias("physical"), F.col("ts.logical").alias("logical"), F.col(seq).alias("seq"),
                       F.coalesce("is_delete", F.lit(False)).alias("is_delete"), "value").where("user_key IS NOT NULL AND physical IS NOT NULL AND logical IS NOT NULL")


def up_to(as_of: tuple[int, int] | None) -> Column:
    if as_of is None:
        return F.lit(True)
    p, lo = as_of
    return (F.col("physical") < p) | ((F.col("physical") == p) & (F.col("logical") <= lo))


def newest(versions: DataFrame) -> DataFrame:
    """The newest version of each key, by a map-side-combined maximum."""
    m = F.max(F.struct("physical", "logical", F.bitwise_not("seq").alias("inv"), "is_delete", "value")).alias("m")
    return versions.groupBy("user_key").agg(m).select("user_key", "m.physical", "m.logical", F.bitwise_not("m.inv").alias("seq"), "m.is_delete", "m.value")


def get(versions: DataFrame, key: bytes, as_of: tuple[int, int] | None = None) -> DataFrame:
    """The visible value of one key: at most one row; none if it is deleted or not yet there."""
    return newest(versions.where((F.col("user_key") == F.lit(key)) & up_to(as_of))).where(~F.col("is_delete"))


def scan(versions: DataFrame, start: bytes | None = None, end: bytes | None = None, as_of: tuple[int, int] | None = None) -> DataFrame:
    """The visible rows of keys in [start, end). Bounds and as_of are filters on plain columns, so they reach the scan."""
    return newest(versions.where(in_range(F.col("user_key"), start, end) & up_to(as_of))).where(~F.col("is_delete"))


def search_range(versions: DataFrame, start: bytes | None, end: bytes | None) -> DataFrame:
    """The latest visible rows of a range in key order, without internal keys (those that begin with '__')."""
    return scan(versions, start, end).where(~F.startswith("user_key", F.lit(b"__"))).orderBy("user_key")


def merge_runs(runs: list[DataFrame]) -> DataFrame:
    """Runs ``user_key, physical, logical, is_delete, value`` merged: the newest version of each key;
    of equal timestamps the earlier run's."""
    rows = None
    for n, r in enumerate(runs):
        r = r.withColumn("seq", F.lit(n).cast("bigint"))
        rows = r if rows is None else rows.unionByName(r)
    return newest(rows)


def compact(versions: DataFrame, watermark: tuple[int, int], is_last: bool = False, keys: list[str] | None = None) -> DataFrame:
    """The versions that compaction keeps: all at or after the watermark; of the older ones the newest of
    each key, unless one lies exactly at the watermark; on the last level that one goes if it is a delete."""
    p, lo = watermark
    below = (F.col("physical") < p) | ((F.col("physical") == p) & (F.col("logical") < lo))
    # a key's newest older version and whether it has one at the watermark: both by combining aggregates, a row a key
    keys = keys or ["user_key"]
    per_key = versions.groupBy(*keys).agg(
        F.max(F.when(below, F.struct("physical", "logical"))).alias("last"),
        F.coalesce(F.bool_or((F.col("physical") == p) & (F.col("logical") == lo)), F.lit(False)).alias("at_mark"),
    ).where("last IS NOT NULL AND NOT at_mark").select(F.struct(*keys).alias("its_key"), "last")
    # one join settles all rows; a hot key's rows may be split, as each meets one row
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"its_key.{k}"))
    joined = versions.join(per_key, same, "left")
    newest_old = F.coalesce(F.struct("physical", "logical") == F.col("last"), F.lit(False))
    if is_last:
        newest_old = newest_old & ~F.col("is_delete")
    return joined.where(~below | newest_old).drop("its_key", "last")


def collect_garbage(versions: DataFrame, older_than: tuple[int, int]) -> DataFrame:
    """Compaction of the upper levels only, so deletes are kept."""
    return compact(versions, older_than, is_last=False)


def valid_prefix(log: DataFrame, file: str, offset: str, good: Column) -> DataFrame:
    """Replay of write-ahead logs: of each file the records before its first bad one."""
    first_bad = log.groupBy(file).agg(F.min(F.when(~F.coalesce(good, F.lit(False)), F.col(offset))).alias("first_bad"))
    return log.join(first_bad, file).where(F.col("first_bad").isNull() | (F.col(offset) < F.col("first_bad"))).drop("first_bad")


# Log files as bytes: each record is length, CRC-32 and payload, little-endian.

def encode_log(records: list[tuple[bytes, int, int, bytes | None]]) -> bytes:
    """(key, physical, logical, value or None for a delete) records as the bytes of a log file."""
    out = []
    for key, p, lo, value in records:
        body = struct.pack("<IQI?I", len(key), p, lo, value is None, len(value or b"")) + key + (value or b"")
        out.append(struct.pack("<II", len(body), zlib.crc32(body)) + body)
    return b"".join(out)


def decode_log(data: bytes) -> list[tuple[bytes, int, int, bytes | None]]:
    """The records before the first that is cut short or fails its checksum."""
    out, at = [], 0
    while at + 8 <= len(data):
        n, crc = struct.unpack_from("<II", data, at)
        body = data[at + 8 : at + 8 + n]
        if len(body) < n or n < 21 or zlib.crc32(body) != crc:
            break
        k, p, lo, dead, v = struct.unpack_from("<IQI?I", body)
        out.append((body[21 : 21 + k], p, lo, None if dead else body[21 + k : 21 + k + v]))
        at += 8 + n
    return out


def replay_logs(files: DataFrame) -> DataFrame:
    """``path, content`` of log files (Spark's binaryFile source) as versions, in order within each file."""
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in it:
            for path, content in zip(df["path"], df["content"]):
                rows = [(path, n, *r[:3], r[3] is None, r[3]) for n, r in enumerate(decode_log(bytes(content)))]
                yield pd.DataFrame(rows, columns=["path", "seq", "user_key", "physical", "logical", "is_delete", "value"])

    return files.select("path", "content").mapInPandas(run, "path STRING, seq BIGINT, user_key BINARY, physical BIGINT, logical BIGINT, is_delete BOOLEAN, value BINARY")


def write_logs(records: DataFrame, folder: str) -> DataFrame:
    """Write ``name, seq, user_key, physical, logical, is_delete, value`` as log files, one for each name, records by seq;
    returns ``name, path, n_records``. A record with a null key or time is written as one whose checksum fails, as a torn
    write leaves it. A file's records are to fit a task."""
    schema = "name STRING, path STRING, n_records BIGINT"

    def run(df: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in df.sort_values("seq").itertuples(index=False):
            if r.torn:
                out.append(struct.pack("<II", 21, 0) + bytes(21))
            else:
                out.append(encode_log([(bytes(r.user_key), int(r.physical), int(r.logical), None if r.is_delete else bytes(r.value or b""))]))
        fs, base = open_fs(folder)
        fs.create_dir(base, recursive=True)
        name = f"{df['name'].iloc[0]}-{uuid.uuid4().hex}.log"
        with fs.open_output_stream(f"{base}/{name}", compression=None) as f:
            f.write(b"".join(out))
        return pd.DataFrame({"name": [df["name"].iloc[0]], "path": [f"{folder}/{name}"], "n_records": [len(df)]})

    torn = F.col("user_key").isNull() | F.col("physical").isNull() | F.col("logical").isNull()
    whole = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("physical", "logical")]  # no nulls, so they stay integers in pandas
    return records.select("name", "seq", "user_key", *whole, "is_delete", "value", torn.alias("torn")).groupBy("name").applyInPandas(run, schema)
