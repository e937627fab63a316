"""Applying a feed of inserts, updates and deletes to a keyed table, by bucketed copy-on-write.

Layout below the table's path::

    _manifest/00000003.json     which files make up version 3, by bucket
    data/<commit>/bucket=7/...  one Parquet file, sorted by key; never changed once written

A key's bucket is ``pmod(hash(key), n_buckets)``, which is the rule by which Spark hash-partitions
rows: the shuffle that finds the newest change of each key thereby also routes it to its bucket,
and no second shuffle is needed. The task that gets a bucket's changes, sorted by key, reads the
bucket's base file beside them, merges the two sorted streams batch by batch and writes the replacement
file: the base is neither shuffled nor sorted again, and no bucket need fit in memory. Then a
new manifest is published by an atomic rename. Untouched buckets keep their files, which aren't read.
Files bear names that no other attempt uses, and only those reported by finished tasks get into the
manifest, so a lost executor does no harm. Two writers cannot commit the same version: the second one fails.

Deletes are kept as tombstones in the base, so an older change that comes late cannot bring a
deleted key back, and batches may be applied in any order or more than once.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpline.sources.fs import Folder, open_fs

#: Bytes of changes that a bucket is planned for, and rows that a merge holds of each side.
BUCKET_BYTES = 256 << 20
MERGE_ROWS = 16_384
STATE = ["user_key", "physical", "logical", "record_id", "is_delete", "value"]


def changes_of(feed: DataFrame) -> DataFrame:
    """The state columns of a change feed ``(record_id, user_key, ts, is_delete, value)``.

    A record with a null key or timestamp (or one with a null part) changes nothing. A null
    ``is_delete`` counts as false; a null or empty value is a value. Other columns are left behind,
    so names that clash with ours do no harm.
    """
    return feed.select(
        F.col("user_key"),
        F.col("ts.physical").alias("physical"),
        F.col("ts.logical").alias("logical"),
        F.col("record_id"),
        F.coalesce(F.col("is_delete"), F.lit(False)).alias("is_delete"),
        F.col("value"),
    ).where("user_key IS NOT NULL AND physical IS NOT NULL AND logical IS NOT NULL")


def newest_per_key(rows: DataFrame) -> DataFrame:
    """One row per key: greatest timestamp, and of its copies the smallest record_id.

    ``max`` over a struct combines on the map side, so a key that holds a third of all rows sends
    one row per map task. ``~record_id`` falls as record_id rises and cannot overflow.
    """
    newest = rows.groupBy("user_key").agg(
        F.max(F.struct("physical", "logical", F.bitwise_not("record_id").alias("inv"), "is_delete", "value")).alias("m")
    )
    return newest.select(
        "user_key",
        F.col("m.physical").alias("physical"),
        F.col("m.logical").alias("logical"),
        F.bitwise_not(F.col("m.inv")).alias("record_id"),
        F.col("m.is_delete").alias("is_delete"),
        F.col("m.value").alias("value"),
    )


@contextmanager
def shuffle_partitions(spark: SparkSession, n: int) -> Iterator[None]:
    """Queries run inside shuffle into n partitions."""
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, str(n))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def newer(a: pa.Table, b: pa.Table) -> pa.Table:
    """One row per key of two tables, sorted by key: greatest timestamp, then smallest record_id."""
    t = pa.concat_tables([a, b])
    t = t.take(pc.sort_indices(t, sort_keys=[("user_key", "ascending"), ("physical", "descending"), ("logical", "descending"), ("record_id", "ascending")]))
    if len(t) < 2:
        return t
    keys = t["user_key"].combine_chunks()
    again = pc.equal(keys.slice(1), keys.slice(0, len(t) - 1))
    return t.filter(pa.concat_arrays([pa.array([True]), pc.invert(again)]))


def merge_sorted(changes: Iterator[pa.Table], base: Iterator[pa.Table]) -> Iterator[pa.Table]:
    """Merge two streams of tables with ascending, unique keys. What is held is one table of each."""
    a, b = next(changes, None), next(base, None)
    while a is not None and b is not None:
        cut = min(a["user_key"][-1].as_py(), b["user_key"][-1].as_py())
        i, j = (pc.sum(pc.less_equal(t["user_key"], pa.scalar(cut, pa.binary()))).as_py() for t in (a, b))
        yield newer(a.slice(0, i), b.slice(0, j))
        a = a.slice(i) if i < len(a) else next(changes, None)
        b = b.slice(j) if j < len(b) else next(base, None)
    for first, rest in ((a, changes), (b, base)):
        if first is not None:
            yield first
            yield from rest


def _by_bucket(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """(bucket, its rows) of batches sorted by bucket, cut where the bucket changes."""
    for batch in batches:
        t, at = pa.Table.from_batches([batch]), 0
        buckets = t["bucket"].to_numpy()
        while at < len(t):
            end = at + int((buckets[at:] == buckets[at]).sum())
            yield int(buckets[at]), t.slice(at, end - at).select(STATE)
            at = end


WRITTEN = "bucket INT, path STRING, n_changes BIGINT, n_rows BIGINT, n_bytes BIGINT"


def merge_writer(path: str, commit: str, base: dict[str, list[str]]):
    """The function of a task: sorted changes in, one replacement file per bucket out."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, parts in groupby(_by_bucket(batches), key=lambda p: p[0]):
            seen = [0]

            def changes(parts=parts, seen=seen) -> Iterator[pa.Table]:
                for _, t in parts:
                    seen[0] += len(t)
                    yield t

            def old(bucket=bucket) -> Iterator[pa.Table]:
                for f in base.get(str(bucket), []):  # one file
                    fs, p = open_fs(f"{path}/{f}")
                    with fs.open_input_file(p) as h:
                        for b in pq.ParquetFile(h).iter_batches(MERGE_ROWS, columns=STATE):
                            yield pa.Table.from_batches([b])

            name = f"{commit}/bucket={bucket}/part-{uuid.uuid4().hex}.parquet"
            fs, p = open_fs(f"{path}/{name}")
            fs.create_dir(p.rpartition("/")[0], recursive=True)
            writer, n_rows = None, 0
            with fs.open_output_stream(p, compression=None) as out:
                for t in merge_sorted(changes(), old()):
                    if writer is None:
                        writer = pq.ParquetWriter(out, t.schema)
                    writer.write_table(t, row_group_size=1 << 20)
                    n_rows += len(t)
                writer.close()
            yield pa.RecordBatch.from_pydict({
                "bucket": pa.array([bucket], pa.int32()), "path": [name], "n_changes": pa.array([seen[0]], pa.int64()),
                "n_rows": pa.array([n_rows], pa.int64()), "n_bytes": pa.array([fs.get_file_info(p).size], pa.int64())})

    return run


@dataclass
class Commit:
    version: int
    buckets_touched: int
    buckets_kept: int
    keys_changed: int
    rows_written: int
    bytes_written: int


def buckets_for(feed: DataFrame) -> int:
    """Buckets for a table of about the feed's size: BUCKET_BYTES each, and at least one for each core."""
    size = int(feed._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(feed.sparkSession.sparkContext.defaultParallelism, min(1_000_000, -(-size // BUCKET_BYTES)))


class KeyedTable:
    """The current state of a keyed table, kept as bucketed immutable files and manifests."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.folder = spark, path.rstrip("/"), Folder(spark, path)
        self.commits: list[Commit] = []  # of this object

    @classmethod
    def create(cls, spark: SparkSession, path: str, n_buckets: int) -> KeyedTable:
        """An empty table, version 0. Choose n_buckets so that a bucket is some 100 MB to 1 GB (``buckets_for``)."""
        if n_buckets < 1:
            raise ValueError("n_buckets must be at least 1")
        t = cls(spark, path)
        t._publish({"version": 0, "n_buckets": n_buckets, "buckets": {}})
        return t

    def _publish(self, manifest: dict) -> None:
        self.folder.write_new(f"_manifest/{manifest['version']:08d}.json", json.dumps(manifest))

    def versions(self) -> list[int]:
        return [int(n[:8]) for n in self.folder.names("_manifest") if n.endswith(".json") and ".tmp-" not in n]

    def manifest(self, version: int | None = None) -> dict:
        version = max(self.versions()) if version is None else version
        return json.loads(self.folder.read_text(f"_manifest/{version:08d}.json"))

    def bucket_of(self, n_buckets: int) -> Column:
        return F.pmod(F.hash("user_key"), F.lit(n_buckets))

    def _read(self, manifest: dict, buckets: set[str] | None = None) -> DataFrame | None:
        files = [f for b, fs in manifest["buckets"].items() if buckets is None or b in buckets for f in fs]
        if not files:
            return None
        return self.spark.read.schema(
            "user_key BINARY, physical BIGINT, logical BIGINT, record_id BIGINT, is_delete BOOLEAN, value BINARY"
        ).parquet(*(f"{self.path}/{f}" for f in files))

    def apply(self, feed: DataFrame) -> Commit:
        """Merge a batch of the feed and commit the next version; an empty batch commits nothing new
        but the version number. Late, repeated and out-of-order records are all right."""
        before, spark = self.manifest(), feed.sparkSession
        n, commit = before["n_buckets"], f"data/{before['version'] + 1:08d}-{uuid.uuid4().hex}"
        with shuffle_partitions(spark, n):  # so that partitions are buckets
            newest = newest_per_key(changes_of(feed)).withColumn("bucket", self.bucket_of(n)).sortWithinPartitions("bucket", "user_key")
            files = newest.mapInArrow(merge_writer(self.path, commit, before["buckets"]), WRITTEN).collect()  # a row a bucket
        written = {str(f.bucket): [f.path] for f in files}
        if len(written) != len(files):
            raise RuntimeError("a bucket was written by two tasks")
        self._publish(before | {"version": before["version"] + 1, "buckets": before["buckets"] | written})
        self.commits.append(Commit(before["version"] + 1, len(written), len(before["buckets"].keys() - written.keys()), *(sum(f[c] for f in files) for c in ("n_changes", "n_rows", "n_bytes"))))
        return self.commits[-1]

    def state(self, version: int | None = None) -> DataFrame:
        """Newest change of each key, tombstones included."""
        got = self._read(self.manifest(version))
        return self.spark.createDataFrame([], "user_key BINARY, physical BIGINT, logical BIGINT, record_id BIGINT, is_delete BOOLEAN, value BINARY") if got is None else got

    def live(self, version: int | None = None) -> DataFrame:
        """The live keys with their values."""
        return self.state(version).where(~F.col("is_delete"))

    def vacuum(self, keep_versions: int = 1) -> int:
        """Delete data folders that none of the newest ``keep_versions`` manifests name."""
        keep = sorted(self.versions())[-keep_versions:]
        used = {f.split("/")[1] for v in keep for fs in self.manifest(v)["buckets"].values() for f in fs}
        gone = [d for d in self.folder.names("data") if d not in used]
        for d in gone:
            self.folder.delete(f"data/{d}")
        for v in set(self.versions()) - set(keep):
            self.folder.delete(f"_manifest/{v:08d}.json")
        return len(gone)


def replay(spark: SparkSession, feed: DataFrame, path: str, n_buckets: int, batches: int = 2, trickle: int = 0) -> KeyedTable:
    """Rebuild a table from a whole feed, applied as ``batches`` runs of equal record_id width; of the last run the
    ``trickle`` greatest record_ids come as a batch of their own.

    The first batch builds the base; each later one is merged into it by copy-on-write.
    """
    t = KeyedTable.create(spark, path, n_buckets)
    lo, hi = feed.agg(F.min("record_id"), F.max("record_id")).first()
    cuts = [] if lo is None else sorted({c for c in [*(lo + (hi - lo + 1) * i // batches for i in range(1, batches)), *([hi - trickle + 1] if trickle else [])] if c > lo})
    for a, b in zip([None, *cuts], [*cuts, None]):
        part = feed
        if a is not None:
            part = part.where(F.col("record_id") >= a)
        if b is not None:
            part = part.where(F.coalesce(F.col("record_id") < b, F.lit(a is None)))
        t.apply(part)
    return t
