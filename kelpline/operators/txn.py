"""Snapshot-isolation transactions as queries over their history.

Tables (timestamps are BIGINT or any ordered type, the same in all):
``locks(key, primary, start_ts, ttl)``, ``data(key, start_ts, value)``, ``writes(key, start_ts, commit_ts)``,
``commits(primary, start_ts, commit_ts)``, ``rollbacks(key, start_ts)``, ``mutations(key, start_ts, primary, value, ttl)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def visible(writes: DataFrame, data: DataFrame, as_of: Column | None = None) -> DataFrame:
    """The committed value of each key: newest write with commit_ts <= as_of, then the data of its start_ts."""
    w = writes if as_of is None else writes.where(F.col("commit_ts") <= as_of)
    last = w.groupBy("key").agg(F.max(F.struct("commit_ts", "start_ts")).alias("w")).select("key", "w.commit_ts", "w.start_ts")
    return last.join(data, ["key", "start_ts"]).select("key", "start_ts", "commit_ts", "value")


def blocked(locks: DataFrame, as_of: Column) -> DataFrame:
    """Keys whose readers at ``as_of`` must wait or resolve: locked at or before it."""
    return locks.where(F.col("start_ts") <= as_of)


def prewrite(mutations: DataFrame, writes: DataFrame, locks: DataFrame) -> DataFrame:
    """The outcome of each mutation against the history: WriteConflict if the key's newest commit isn't
    before its start, else LockConflict if the key is locked (its own lock counts), else Ok."""
    last = writes.groupBy("key").agg(F.max("commit_ts").alias("last_commit"))
    held = locks.groupBy("key").agg(F.max(F.struct("start_ts", "primary")).alias("lock"))
    j = mutations.join(last, "key", "left").join(held, "key", "left")
    status = F.when(F.col("last_commit") >= F.col("start_ts"), "WriteConflict").when(F.col("lock").isNotNull(), "LockConflict").otherwise("Ok")
    return j.select(*mutations.columns, status.alias("status"), F.when(status == "WriteConflict", F.col("last_commit")).alias("conflict_commit_ts"),
                    F.when(status == "LockConflict", F.col("lock.start_ts")).alias("conflict_lock_ts"))


def accept(prewritten: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new locks, new data) of the mutations that prewrite accepted."""
    ok = prewritten.where("status = 'Ok'")
    return ok.select("key", "primary", "start_ts", "ttl"), ok.select("key", "start_ts", "value")


def commit(locks: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(locks left, new writes, new commits) for requests ``key, start_ts, commit_ts, is_primary``.
    A request whose lock isn't held at its start_ts does nothing."""
    held = requests.join(locks.select("key", "start_ts"), ["key", "start_ts"], "left_semi")
    left = locks.join(held.select("key", "start_ts"), ["key", "start_ts"], "left_anti")
    return left, held.select("key", "start_ts", "commit_ts"), held.where("is_primary").select(F.col("key").alias("primary"), "start_ts", "commit_ts")


def rollback(locks: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(locks left, rollback records) for requests ``key, start_ts``; the record is made in any case."""
    return locks.join(requests, ["key", "start_ts"], "left_anti"), requests.select("key", "start_ts").distinct()


def stale_locks(locks: DataFrame, commits: DataFrame, now: Column) -> DataFrame:
    """What a reader does with each lock: wait until its ttl is over; then roll it forward if the primary
    committed, else roll both back."""
    j = locks.join(commits.select("primary", "start_ts", "commit_ts"), ["primary", "start_ts"], "left")
    action = F.when(now <= F.col("start_ts") + F.col("ttl"), "wait").when(F.col("commit_ts").isNotNull(), "roll_forward").otherwise("roll_back")
    return j.select("key", "primary", "start_ts", action.alias("action"), F.when(action == "roll_forward", F.col("commit_ts")).alias("commit_ts"))
