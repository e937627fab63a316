"""Compaction of one level into the next: choosing the files, merging their versions, writing the replacements.

Files are rows ``file_id, shard, level``; their key ranges are those of their entries, not of a listing that may
be wrong. Shards are compacted side by side, each by its own ranges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kelpline.functions import bloom
from kelpline.operators import mvcc
from kelpline.session import materialize

LAST_LEVEL = 6
TARGET_BYTES = 64 << 20


def listed_levels(listing: DataFrame) -> DataFrame:
    """``file_id, shard, level`` of the level files of a listing, each file once: as its first listing says."""
    first = F.min(F.struct("listing_id", "shard", "level", "tier")).alias("f")
    return listing.where("file_id IS NOT NULL").groupBy("file_id").agg(first).where("f.tier = 'level' AND f.level IS NOT NULL").select("file_id", "f.shard", "f.level")


def picked(files: DataFrame, entries: DataFrame, level: int) -> DataFrame:
    """``file_id, shard, role``: all files of ``level`` ("input"), and of the next those whose keys overlap the range
    that the inputs of their shard span ("overlapping"). Files without entries hold nothing to merge, and aren't picked."""
    ranges = entries.where("user_key IS NOT NULL").groupBy("file_id").agg(F.min("user_key").alias("low"), F.max("user_key").alias("high"))
    known = files.where(F.col("level").isin(level, level + 1)).join(ranges, "file_id")
    span = known.where(F.col("level") == level).groupBy(F.col("shard").alias("its_shard")).agg(F.min("low").alias("from"), F.max("high").alias("to"))
    met = known.join(span, F.col("shard").eqNullSafe(F.col("its_shard"))).where((F.col("level") == level) | ((F.col("high") >= F.col("from")) & (F.col("low") <= F.col("to"))))
    return met.select("file_id", "shard", F.when(F.col("level") == level, "input").otherwise("overlapping").alias("role"))


def compact_level(files: DataFrame, entries: DataFrame, level: int, watermark: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """(the files picked, the versions ``shard, user_key, physical, logical, seq, is_delete, value`` that replace them).
    The last level has nothing below, and isn't compacted."""
    if not 0 <= level < LAST_LEVEL:
        raise ValueError(f"level must be from 0 to {LAST_LEVEL - 1}")
    chosen = picked(files, entries, level)
    rows = entries.drop("shard").join(chosen.select("file_id", "shard"), "file_id")
    versions = mvcc.history(rows, "entry_id", keys=["shard", "user_key"])
    return chosen, mvcc.compact(versions, watermark, level + 1 == LAST_LEVEL, keys=["shard", "user_key"])


def write_level(versions: DataFrame, path: str, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """Write versions as files of about ``target_bytes`` whose key ranges don't overlap within a shard, sorted by key and newest
    first; returns ``path, shard, n_entries, min_key, max_key`` of each file and shard."""
    size = F.octet_length("user_key") + F.coalesce(F.octet_length("value"), F.lit(0)) + 17
    total = versions.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    placed = versions.repartitionByRange(max(1, -(-total // target_bytes)), "shard", "user_key")
    placed.sortWithinPartitions("shard", "user_key", F.desc("physical"), F.desc("logical")).write.parquet(path)
    written = versions.sparkSession.read.schema(versions.schema).parquet(path)
    return written.groupBy(F.input_file_name().alias("path"), "shard").agg(F.count("*").alias("n_entries"), F.min("user_key").alias("min_key"), F.max("user_key").alias("max_key"))


def sound_filters(listing: DataFrame, entries: DataFrame) -> DataFrame:
    """``file_id, bits, k``: each file's longest filter, if it denies none of the file's own keys. Damaged filters, which would
    hide keys, and missing ones are left out."""
    longest = listing.groupBy("file_id").agg(F.max(F.struct(F.octet_length("bits").alias("n"), "k", "bits")).alias("f")).where("f.n > 0 AND f.k > 0")
    own = bloom.probe(entries.where("user_key IS NOT NULL").select("file_id", "user_key"), listing)
    damaged = own.where(~F.col("may_contain")).select("file_id").distinct()
    return longest.join(damaged, "file_id", "left_anti").select("file_id", "f.bits", "f.k")


def met_ranks(keys: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``shard, user_key, rank`` of the distinct ``keys``, ranked within their shard; ``files`` with the ranks ``first`` to ``last``
    of the keys in their range). Keys and bounds are sorted together, a shard in one task, which may spill: a file isn't compared with each key."""
    bound = lambda key, kind: F.struct(F.col(key).alias("at"), F.lit(kind).alias("kind"))
    bounds = files.select("shard", F.explode(F.array(bound("low", 0), bound("high", 2))).alias("b"), "file_id", "n").select("shard", "b.at", "b.kind", "file_id", "n")
    points = bounds.unionByName(keys.select("shard", F.col("user_key").alias("at"), F.lit(1).alias("kind")), allowMissingColumns=True)
    so_far = Window.partitionBy("shard").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    points = materialize(points.withColumn("rank", F.count_if(F.col("kind") == 1).over(so_far)), "ranks")
    rank = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("rank")))
    met = points.where("kind <> 1").groupBy("shard", "file_id", "n").agg((rank(0) + 1).alias("first"), rank(2).alias("last"))
    return points.where("kind = 1").select("shard", F.col("at").alias("user_key"), "rank"), met


def get_many(keys: DataFrame, entries: DataFrame, filters: DataFrame, as_of: tuple[int, int] | None = None) -> DataFrame:
    """The visible version of each of the distinct keys ``shard, user_key``, from the files of its shard: ``shard, user_key,
    physical, logical, seq, value``. A file without a key in its range is passed over. If the keys in its range are no more than its
    entries, its filter is asked about each, and only those that pass are looked for; otherwise, and without a filter, its entries
    are looked through. So the cost grows with keys and entries, not with their product."""
    stored = entries.where("user_key IS NOT NULL AND file_id IS NOT NULL")
    files = stored.groupBy("shard", "file_id").agg(F.min("user_key").alias("low"), F.max("user_key").alias("high"), F.count("*").alias("n"))
    ranked, met = met_ranks(keys.where("user_key IS NOT NULL AND shard IS NOT NULL"), files)
    met = met.where("last >= first").join(filters, "file_id", "left").withColumn("ask", F.col("bits").isNotNull() & (F.col("last") - F.col("first") < F.col("n")))
    few = met.where("ask").select("shard", "file_id", "bits", "k", F.explode(F.sequence("first", "last")).alias("rank")).join(ranked, ["shard", "rank"])
    passed = few.where(bloom.may_contain(F.col("user_key"), F.col("bits"), F.col("k"))).select("shard", "file_id", "user_key")
    whole = stored.join(met.where("NOT ask").select("shard", "file_id"), ["shard", "file_id"], "left_semi").join(ranked.select("shard", "user_key"), ["shard", "user_key"], "left_semi")
    found = whole.unionByName(stored.join(passed, ["shard", "file_id", "user_key"], "left_semi").select(*whole.columns))
    rows = mvcc.history(found, "entry_id", ["shard", "user_key"]).where(mvcc.up_to(as_of))
    newest = F.max(F.struct("physical", "logical", F.bitwise_not("seq").alias("inv"), "is_delete", "value")).alias("m")
    best = rows.groupBy("shard", "user_key").agg(newest)
    return best.where("NOT m.is_delete").select("shard", "user_key", "m.physical", "m.logical", F.bitwise_not("m.inv").alias("seq"), "m.value")
