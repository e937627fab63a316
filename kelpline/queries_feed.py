"""Queries of the change feed and of small-file consolidation, over the tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpline.operators.change_feed import KeyedTable, buckets_for, replay
from kelpline.operators.small_files import consolidate_entries, left_out, listing_report
from kelpline.session import job_dir
from kelpline.sources.tables import table


#: Records that come last, in a batch of their own that leaves most of a table alone.
TRICKLE = 4


def _replayed(spark: SparkSession, sf_dir: str, batches: int = 2) -> KeyedTable:
    feed = table(spark, sf_dir, "wal_log")
    return replay(spark, feed, job_dir(spark, "p1"), buckets_for(feed), batches, TRICKLE)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed in two halves and a trickle: a base is built, merged with a large batch, then with a small one."""
    return _replayed(spark, sf_dir).live().select("record_id")


def p1_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live keys with their values and timestamps, the feed applied in three batches and a trickle."""
    t = _replayed(spark, sf_dir, batches=3)
    return t.live().select(F.hex("user_key").alias("user_key"), "physical", "logical", "record_id", F.hex("value").alias("value"))


def p1_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each commit of p1_found: keys it changed, keys known and live after it, and whether it left buckets alone."""
    t, out = _replayed(spark, sf_dir), None
    for c in t.commits:
        one = t.state(c.version).agg(F.count("*").alias("n_keys"), F.count_if(~F.col("is_delete")).alias("n_live")).select(
            F.lit(c.version).alias("version"), F.lit(c.keys_changed).cast("bigint").alias("n_changed"), "n_keys", "n_live", F.lit(c.buckets_kept > 0).alias("kept_some"))
        out = one if out is None else out.unionByName(one)
    return out


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = table(spark, sf_dir, "sst_entry")
    return left_out(entries, consolidate_entries(entries))


def p2_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The consolidated files by shard: how many, of how many parts, records and bytes."""
    m = consolidate_entries(table(spark, sf_dir, "sst_entry"))
    return m.groupBy("shard").agg(
        F.count("*").alias("n_files"), F.sum("n_parts").alias("n_parts"), F.sum("n_records").alias("n_records"),
        F.max("n_bytes").alias("largest_bytes"), F.min("n_bytes").alias("smallest_bytes"),
    )


def p2_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing_report(table(spark, sf_dir, "sst_file"), table(spark, sf_dir, "sst_entry"))


_P1 = """
SELECT min(record_id) AS record_id, user_key, ts, arg_min(value, record_id) AS value, arg_min(coalesce(is_delete, false), record_id) AS del
FROM (SELECT *, max(ts) OVER (PARTITION BY user_key) AS newest FROM wal_log
      WHERE user_key IS NOT NULL AND ts.physical IS NOT NULL AND ts.logical IS NOT NULL)
WHERE ts = newest GROUP BY user_key, ts
"""

QUERIES = {"p1_found": p1_found, "p1_state": p1_state, "p1_commits": p1_commits, "p2_found": p2_found, "p2_files": p2_files, "p2_listing": p2_listing}
ORACLE = {
    "p1_found": f"SELECT record_id FROM ({_P1}) WHERE NOT del",
    "p1_state": f"SELECT hex(user_key) AS user_key, ts.physical AS physical, ts.logical AS logical, record_id, hex(value) AS value FROM ({_P1}) WHERE NOT del",
    "p1_commits": f"""
WITH b AS (SELECT min(record_id) AS lo, max(record_id) AS hi FROM wal_log), c AS (SELECT unnest([1, 2, 3]) AS version, unnest([lo, lo + (hi - lo + 1) // 2, hi - {TRICKLE} + 1]) AS lo, unnest([lo + (hi - lo + 1) // 2, hi - {TRICKLE} + 1, hi + 1]) AS hi FROM b),
ok AS (SELECT * FROM wal_log WHERE user_key IS NOT NULL AND ts.physical IS NOT NULL AND ts.logical IS NOT NULL),
n AS (SELECT version, count(DISTINCT user_key) AS n_changed FROM c LEFT JOIN ok ON record_id >= lo AND record_id < hi GROUP BY version),
s AS (SELECT version, user_key, coalesce(is_delete, false) AS dead FROM c JOIN ok ON record_id < hi QUALIFY row_number() OVER (PARTITION BY version, user_key ORDER BY ts DESC, record_id) = 1)
SELECT version, n_changed, count(*) AS n_keys, count(*) FILTER (WHERE NOT dead) AS n_live, version = 3 AS kept_some FROM s JOIN n USING (version) GROUP BY version, n_changed
""",
    "p2_found": "SELECT entry_id FROM sst_entry QUALIFY row_number() OVER (PARTITION BY shard, user_key, ts, is_delete, value ORDER BY entry_id) > 1",
    "p2_listing": """
SELECT file_id, coalesce(n_listings, 0) AS n_listings, n_listed, coalesce(n_there, 0) AS n_there,
  CASE WHEN n_listings IS NULL THEN 'unlisted' WHEN coalesce(n_there, 0) = 0 THEN 'empty' WHEN n_listed IS NULL THEN 'count_missing'
       WHEN n_listed <> n_there THEN 'count_wrong' ELSE 'ok' END AS status
FROM (SELECT file_id, count(*) AS n_listings, max(n_entries)::BIGINT AS n_listed FROM sst_file GROUP BY file_id)
FULL JOIN (SELECT file_id, count(*) AS n_there FROM sst_entry GROUP BY file_id) USING (file_id)
""",
}
