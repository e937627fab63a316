import random

import pyarrow as pa
import pytest

from kelpline.operators.change_feed import KeyedTable, buckets_for, merge_sorted, replay
from kelpline.session import job_dir

FEED = "record_id BIGINT, user_key BINARY, ts STRUCT<physical: BIGINT, logical: BIGINT>, is_delete BOOLEAN, value BINARY, bucket STRING, physical STRING"


def feed(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], FEED)


def brute(rows):
    best = {}
    for rid, key, ts, dead, value in rows:
        if key is None or ts is None or None in ts:
            continue
        key = bytes(key)
        if key not in best or (ts, -rid) > (best[key][0], -best[key][1]):
            best[key] = (ts, rid, dead, value)
    return {bytes(k): (v[1], v[3] and bytes(v[3])) for k, v in best.items() if not v[2]}


def live(t):
    return {bytes(r.user_key): (r.record_id, r.value and bytes(r.value)) for r in t.live().collect()}


def random_rows(seed, n):
    r = random.Random(seed)
    out = []
    for i in range(n):
        key = bytearray(r.choice([b"hot"] * 6 + [b"a", b"A", b"\x80", b"\x7f", b"", b"k%d" % r.randrange(20)]))
        ts = (r.choice([0, 5, 2**62, r.randrange(10)]), r.choice([0, 1, 2**32 - 1]))
        out.append((i, r.choice([key, key, key, None]), r.choice([ts, ts, ts, ts, None, (None, 1), (1, None)]), r.choice([True, False, None]), r.choice([None, bytearray(b""), bytearray(b"v%d" % i)])))
    # records of one key with equal ts are copies: give them one content
    seen = {}
    return [(i, k, t, *seen.setdefault((bytes(k), t), (d, v))) if k is not None and t else (i, k, t, d, v) for i, k, t, d, v in out]


@pytest.mark.parametrize("seed,batches", [(1, 1), (2, 2), (3, 4)])
def test_random_feeds(spark, seed, batches):
    rows = random_rows(seed, 300)
    t = replay(spark, feed(spark, rows), job_dir(spark, "t"), 4, batches)
    assert live(t) == brute(rows)
    random.Random(seed).shuffle(rows)
    t.apply(feed(spark, rows))  # again, in another order: nothing changes
    assert live(t) == brute(rows)


def table(rows):
    keys, p, rid = zip(*rows) if rows else ((), (), ())
    n = len(keys)
    return pa.table({"user_key": pa.array(keys, pa.binary()), "physical": pa.array(p, pa.int64()), "logical": pa.array([0] * n, pa.int64()), "record_id": pa.array(rid, pa.int64()), "is_delete": pa.array([False] * n), "value": pa.array([None] * n, pa.binary())})


@pytest.mark.parametrize("seed", range(6))
def test_merging_sorted_streams(seed):
    r = random.Random(seed)

    def stream(n, size):
        keys = sorted({bytes([r.randrange(256) for _ in range(r.randrange(3))]) for _ in range(n)})
        rows = [(k, r.randrange(3), r.randrange(4)) for k in keys]
        return rows, [table(rows[i : i + size]) for i in range(0, len(rows), size)]

    (a, ta), (b, tb) = stream(r.choice([0, 1, 60, 300]), 7), stream(r.choice([0, 50, 300]), r.choice([3, 64]))
    want = {}
    for k, p, rid in a + b:
        want[k] = max(want.get(k, (-1, 0)), (p, -rid))
    got = [(k, p, rid) for t in merge_sorted(iter(ta), iter(tb)) for k, p, rid in zip(*(t[c].to_pylist() for c in ("user_key", "physical", "record_id")))]
    assert got == [(k, p, -n) for k, (p, n) in sorted(want.items())]


def test_base_is_not_shuffled_and_files_are_sorted(spark):
    rows = random_rows(9, 400)
    f = feed(spark, rows)
    t = replay(spark, f, job_dir(spark, "t"), buckets_for(f), 2, trickle=1)
    assert len(t.commits) == 3 and t.commits[-1].buckets_touched <= 1 and t.commits[-1].rows_written <= t.commits[1].rows_written
    assert live(t) == brute(rows)
    for files in t.manifest()["buckets"].values():
        assert len(files) == 1
        keys = [bytes(x.user_key) for x in spark.read.parquet(f"{t.path}/{files[0]}").collect()]
        assert keys == sorted(set(keys))
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4"


def test_empty(spark):
    t = replay(spark, feed(spark, []), job_dir(spark, "t"), 4)
    assert live(t) == {}


def test_only_touched_buckets_are_rewritten(spark):
    rows = [(i, bytearray(b"k%d" % i), (1, 0), False, None) for i in range(200)]
    t = replay(spark, feed(spark, rows), job_dir(spark, "t"), 16, 1)
    before = t.manifest()["buckets"]
    c = t.apply(feed(spark, [(999, bytearray(b"k7"), (2, 0), True, None)]))
    after = t.manifest()["buckets"]
    assert c.buckets_touched == 1 and sum(before[b] != after[b] for b in before) == 1
    assert b"k7" not in live(t) and len(live(t)) == 199
    # a delete stays known: an older change that comes late doesn't bring the key back
    t.apply(feed(spark, [(5, bytearray(b"k7"), (1, 5), False, bytearray(b"late"))]))
    assert b"k7" not in live(t)
    assert t.state(1).count() == 200  # old versions can be read until vacuum
    assert t.vacuum() >= 1 and len(live(t)) == 199


def test_two_writers_cannot_commit_one_version(spark):
    t = KeyedTable.create(spark, job_dir(spark, "t"), 2)
    with pytest.raises(FileExistsError):
        t._publish({"version": 0, "n_buckets": 2, "buckets": {}})
