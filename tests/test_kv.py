import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from kelpline.functions import bloom
from kelpline.operators import hlc, levels, mvcc, txn
from kelpline.operators.change_feed import KeyedTable
from kelpline.plans import routing
from kelpline.session import job_dir
from kelpline.sources.store import Clock, Conflict, Store
from kelpline.streaming import feed as streaming

HISTORY = "user_key BINARY, physical BIGINT, logical BIGINT, seq BIGINT, is_delete BOOLEAN, value BINARY"


def history(spark, rows):
    return spark.createDataFrame([(bytearray(k), p, lo, i, v is None, None if v is None else bytearray(v)) for i, (k, p, lo, v) in enumerate(rows)], HISTORY)


def values(df):
    return {bytes(r.user_key): bytes(r.value) for r in df.collect()}


def test_visibility(spark):
    h = history(spark, [(b"key1", 10, 0, b"v1"), (b"key1", 20, 0, b"v2")])
    for t, want in ((5, None), (10, b"v1"), (15, b"v1"), (20, b"v2"), (30, b"v2")):
        assert values(mvcc.get(h, b"key1", (t, 0))).get(b"key1") == want


def test_compaction_watermark(spark):
    c = mvcc.compact(history(spark, [(b"key1", 10, 0, b"v1"), (b"key1", 20, 0, b"v2"), (b"key1", 30, 0, b"v3")]), (20, 0))
    assert sorted(r.physical for r in c.collect()) == [20, 30]


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("last", [False, True])
def test_compaction_is_the_sequential_rule(spark, seed, last):
    r = random.Random(seed)
    rows = list({(b"k%d" % r.randrange(6), r.randrange(12), r.randrange(2)): None for _ in range(60)})
    rows = [(*k, r.choice([None, b"x"])) for k in rows]
    mark, want = (6, 1), set()
    for key in {k for k, *_ in rows}:
        mine = sorted(((p, lo, v) for k, p, lo, v in rows if k == key), key=lambda z: z[:2], reverse=True)
        want |= {(key, p, lo) for p, lo, _ in mine if (p, lo) >= mark}
        older = [z for z in mine if z[:2] < mark]
        if older and not any(z[:2] == mark for z in mine) and not (last and older[0][2] is None):
            want.add((key, *older[0][:2]))
    got = {(bytes(x.user_key), x.physical, x.logical) for x in mvcc.compact(history(spark, rows), mark, last).collect()}
    assert got == want


def test_level_compaction(spark):
    files = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (3, 1, 1), (4, 1, 1), (5, 2, 1), (6, 1, 2), (7, 1, 0)], "file_id BIGINT, shard INT, level INT")
    rows = [(1, b"b", 10, "x"), (2, b"f", 10, "y"), (3, b"a", 5, "old"), (3, b"c", 5, "old"), (3, b"b", 4, "gone"), (4, b"x", 1, "far"), (5, b"c", 1, "other shard"), (6, b"b", 1, "deep"), (2, b"f", 20, None), (None, b"b", 9, "stray")]
    e = spark.createDataFrame([(i, f, 99, bytearray(k), (t, 0), v is None, v and bytearray(v.encode())) for i, (f, k, t, v) in enumerate(rows)],
                              "entry_id BIGINT, file_id BIGINT, shard INT, user_key BINARY, ts STRUCT<physical: BIGINT, logical: BIGINT>, is_delete BOOLEAN, value BINARY")
    chosen, kept = levels.compact_level(files, e, 0, (15, 0))
    assert {(r.file_id, r.role) for r in chosen.collect()} == {(1, "input"), (2, "input"), (3, "overlapping")}
    assert {(bytes(r.user_key), r.physical, r.is_delete) for r in kept.collect()} == {(b"b", 10, False), (b"f", 10, False), (b"f", 20, True), (b"a", 5, False), (b"c", 5, False)}
    out = sorted(((bytes(r.min_key), bytes(r.max_key), r.n_entries) for r in levels.write_level(kept, job_dir(spark, "level"), 40).collect()))
    assert len(out) > 1 and sum(n for *_, n in out) == 5 and all(a[1] < b[0] for a, b in zip(out, out[1:]))
    with pytest.raises(ValueError):
        levels.compact_level(files, e, levels.LAST_LEVEL, (0, 0))


def test_files_are_ruled_out(spark):
    bits, k = bloom.build([b"b", b"c"], 0.001)
    bad = bytes(len(bits))
    files = spark.createDataFrame([(1, bytearray(bits), k), (1, None, None), (2, bytearray(bad), k), (3, None, None)], "file_id BIGINT, bits BINARY, k INT")
    rows = [(1, 1, b"b", 10, b"x"), (2, 1, b"c", 5, b"y"), (3, 2, b"b", 20, b"z"), (4, 3, b"b", 30, None), (5, 3, b"d", 1, b"w")]
    e = spark.createDataFrame([(i, f, 1, bytearray(key), (t, 0), v is None, v and bytearray(v)) for i, f, key, t, v in rows],
                              "entry_id BIGINT, file_id BIGINT, shard INT, user_key BINARY, ts STRUCT<physical: BIGINT, logical: BIGINT>, is_delete BOOLEAN, value BINARY")
    sound = levels.sound_filters(files, e)
    assert [r.file_id for r in sound.collect()] == [1]
    asked = spark.createDataFrame([(1, bytearray(x)) for x in (b"b", b"c", b"d", b"bb")] + [(2, bytearray(b"b"))], "shard INT, user_key BINARY")
    assert values(levels.get_many(asked, e, sound)) == {b"c": b"y", b"d": b"w"}
    assert values(levels.get_many(asked, e, sound, (25, 0))) == {b"b": b"z", b"c": b"y", b"d": b"w"}


def test_lookup_cost_follows_entries(spark):
    """Files that all span the keys' range: right values, and no join of keys with files by range, whose rows are their product."""
    rng, rows = random.Random(5), []
    for n in range(60):
        for key in {b"a", b"z", *(b"k%04d" % rng.randrange(1500) for _ in range(4 if n % 2 else 40))}:
            rows.append((len(rows), n, n % 2, bytearray(key), (rng.randrange(9), 0), rng.random() < 0.2, bytearray(b"%d" % len(rows))))
    e = spark.createDataFrame(rows, "entry_id BIGINT, file_id BIGINT, shard INT, user_key BINARY, ts STRUCT<physical: BIGINT, logical: BIGINT>, is_delete BOOLEAN, value BINARY")
    by_file = {n: [bytes(r[3]) for r in rows if r[1] == n] for n in range(60)}
    filters = spark.createDataFrame([(n, *bloom.build(keys)) for n, keys in by_file.items() if n % 3], "file_id BIGINT, bits BINARY, k INT")
    for asked in ({b"k%04d" % i for i in range(0, 1500, 7)}, {bytes(rng.choice(rows)[3]) for _ in range(6)}, {b"0", b"zz"}):  # more than a file's entries, fewer, out of range
        keys = spark.createDataFrame([(s, bytearray(k)) for s in (0, 1) for k in asked], "shard INT, user_key BINARY")
        want = {}
        for r in rows:
            at, key = (r[4], -r[0]), (r[2], bytes(r[3]))
            if key[1] in asked and r[4] <= (6, 0) and (key not in want or at > want[key][0]):
                want[key] = at, r[5], bytes(r[6])
        got = levels.get_many(keys, e, filters, (6, 0))
        assert {(r.shard, bytes(r.user_key)): bytes(r.value) for r in got.collect()} == {k: v for k, (_, dead, v) in want.items() if not dead}
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert not [line for line in plan.splitlines() if "Join" in line and re.search("user_key#[0-9]+ [<>]=", line)]


def test_filter_bits_by_seed(spark):
    """A filter denies exactly what hashing key and seed denies, for every number of hashes."""
    rng = random.Random(6)
    made = [(i, bytearray(rng.randbytes(rng.randrange(12))), bytearray(rng.randbytes(1 + i % 7)), i % 31) for i in range(200)]
    one = lambda key, bits, at: bits[at >> 3] >> (at & 7) & 1
    want = {i: all(one(key, bits, zlib.crc32(key + s.to_bytes(8, "little")) % (8 * len(bits))) for s in range(k)) for i, key, bits, k in made}
    rows = spark.createDataFrame(made, "i INT, key BINARY, bits BINARY, k INT").select("i", bloom.may_contain(F.col("key"), F.col("bits"), F.col("k")).alias("m"))
    assert dict(rows.collect()) == want


def test_range_and_internal_keys(spark):
    h = history(spark, [(b"__meta", 1, 0, b"x"), (b"a", 1, 0, b"1"), (b"b", 1, 0, b"2"), (b"b", 2, 0, None), (b"\x80", 1, 0, b"3")])
    assert values(mvcc.search_range(h, None, None)) == {b"a": b"1", b"\x80": b"3"}
    assert values(mvcc.search_range(h, b"a", b"\x80")) == {b"a": b"1"}
    assert values(mvcc.scan(h, as_of=(1, 0)))[b"b"] == b"2"


def test_log_bytes(spark, tmp_path):
    rec = [(b"k%d" % i, i, 0, None if i % 5 == 0 else b"v%d" % i) for i in range(50)]
    data = mvcc.encode_log(rec)
    assert mvcc.decode_log(data) == rec
    for cut in random.Random(0).sample(range(len(data)), 20):
        got = mvcc.decode_log(data[:cut])
        assert got == rec[: len(got)] and len(mvcc.encode_log(rec[: len(got) + 1])) > cut
    bad = bytearray(data)
    bad[len(data) // 2] ^= 1
    assert mvcc.decode_log(bytes(bad)) == rec[: len(mvcc.decode_log(bytes(bad)))] and len(mvcc.decode_log(bytes(bad))) < 50
    (tmp_path / "a.log").write_bytes(data[:-3])
    files = spark.read.format("binaryFile").load(str(tmp_path))
    assert mvcc.replay_logs(files).count() == 49


def test_clock_values(spark):
    a, b = Clock(wall=lambda: 10), Clock(wall=lambda: 8)
    assert [a.local_event(), a.local_event()] == [(10, 0), (10, 1)]
    assert b.receive(10, 1) == (10, 2)
    b.wall = lambda: 15
    assert b.local_event() == (15, 0) and b.read() == (15, 0)


@pytest.mark.parametrize("seed", range(3))
def test_clock_sequences(spark, seed):
    r = random.Random(seed)
    steps = [(n, i, r.randrange(12), r.randrange(12), r.randrange(3)) for n in range(3) for i in range(30)]
    df = spark.createDataFrame(steps, "node INT, i INT, wall BIGINT, mp BIGINT, ml BIGINT")
    local = {(x.node, x.i): (x.physical, x.logical) for x in hlc.local_events(df, "node", "i", "wall").collect()}
    final = {x.node: (x.physical, x.logical) for x in hlc.receive_sequence(df, "node", "i", "wall", "mp", "ml").collect()}
    for n in range(3):
        a, b = Clock(), Clock()
        for _, i, w, mp, ml in [s for s in steps if s[0] == n]:
            a.wall = b.wall = lambda w=w: w
            assert a.local_event() == local[n, i]
            b.receive(mp, ml)
        assert b.read() == final[n]


def test_transaction_queries(spark):
    writes = spark.createDataFrame([("apple", 1, 5), ("apple", 6, 9)], "key STRING, start_ts INT, commit_ts INT")
    data = spark.createDataFrame([("apple", 1, "red"), ("apple", 6, "green")], "key STRING, start_ts INT, value STRING")
    assert [r.value for t in (4, 5, 9) for r in txn.visible(writes, data, F.lit(t)).collect()] == ["red", "green"]
    locks = spark.createDataFrame([("lemon", "apple", 100, 1000), ("zebra", "pear", 100, 1000)], "key STRING, primary STRING, start_ts INT, ttl INT")
    m = spark.createDataFrame([("apple", 8), ("lemon", 200), ("new", 1)], "key STRING, start_ts INT")
    assert {r.key: r.status for r in txn.prewrite(m, writes, locks).collect()} == {"apple": "WriteConflict", "lemon": "LockConflict", "new": "Ok"}
    commits = spark.createDataFrame([("apple", 100, 120)], "primary STRING, start_ts INT, commit_ts INT")
    act = lambda now: {r.key: r.action for r in txn.stale_locks(locks, commits, F.lit(now)).collect()}
    assert act(2000) == {"lemon": "roll_forward", "zebra": "roll_back"} and act(1100) == {"lemon": "wait", "zebra": "wait"}


def test_clock_windows_are_cut(spark, monkeypatch):
    monkeypatch.setattr(hlc, "CHUNK", 4)
    test_clock_sequences(spark, 7)


def test_clock_without_messages(spark):
    df = spark.createDataFrame([(1, 1, 0, None, None), (1, 2, 0, 0, 5), (1, 3, 0, None, None), (2, 1, 0, None, None), (3, 1, 4, 4, 1), (3, 2, None, None, None)], "node INT, i INT, wall BIGINT, mp BIGINT, ml BIGINT")
    got = {x.node: (x.physical, x.logical) for x in hlc.receive_sequence(df, "node", "i", "wall", "mp", "ml").collect()}
    assert got == {1: (0, 7), 2: (0, 1), 3: (4, 3)}


ROUTES = [(b"a", b"k", 1, [1, 2]), (b"k", b"s", 2, [2]), (b"s", b"z", 3, [3])]


def test_routes(spark, monkeypatch):
    assert [routing.shard_of(k, ROUTES) for k in (b"apple", b"lemon", b"zebra", b"s")] == [1, 2, 1, 3]
    df = spark.createDataFrame([(bytearray(k),) if k else (None,) for k in (b"apple", b"lemon", b"zebra", None)], "k BINARY")
    routes = spark.createDataFrame(ROUTES, "start BINARY, end BINARY, shard INT, nodes ARRAY<BIGINT>")
    assert [r.shard for r in routing.route(df, "k", routes).collect()] == [1, 2, 1, None]
    assert routing.shard_of(b"x", []) == 0
    monkeypatch.setattr(routing, "SQL_ROUTES", 0)
    assert [r.shard for r in routing.route(df, "k", routes).collect()] == [1, 2, 1, None]


def test_rebalance():
    moves = routing.propose_moves({1: [1, 2], 2: [3]}, {1: 10, 2: 10, 3: 10}, [1, 2, 3], 5)
    assert moves[0] in ((1, 1, 3), (2, 1, 3)) and len(moves) == 1
    assert routing.propose_moves({}, {}, []) == [] and routing.propose_moves({1: [1]}, {1: 5}, [1, 2], 9) == []


def test_split_keeps_history(spark):
    rows = spark.createDataFrame([(bytearray(b"apple"), 1), (bytearray(b"zebra"), 1), (bytearray(b"zebra"), 1)], "user_key BINARY, shard INT")
    assert sorted(r.shard for r in routing.split_shard(rows, 1, b"m", 2).collect()) == [1, 2, 2]


def test_store(spark):
    clock = Clock(wall=iter(range(100, 10_000)).__next__)
    s = Store(spark, job_dir(spark, "store"), 4, dim=2, clock=clock)
    s.put(b"apple", b"red")
    s.put_vector(7, [0.0, 1.0])
    s.put_vector(8, [3.0, 1.0])
    assert s.get(b"apple") == b"red"
    s.flush()
    s.delete(b"vec:8")
    assert [r.vec_id for r in s.search_knn([0.0, 0.0], 5).collect()] == [7]
    t = s.begin()
    s.prewrite(t, [(b"apple", b"green"), (b"lemon", b"sour")])
    other = s.begin()
    with pytest.raises(Conflict, match="LockConflict"):
        s.prewrite(other, [(b"apple", b"blue")])
    late = s.begin()
    s.commit(t)
    with pytest.raises(Conflict, match="WriteConflict"):
        s.prewrite(late, [(b"lemon", b"x")])
    s.flush()
    assert s.get(b"apple") == b"green" and s.get(b"none") is None
    assert [bytes(r.user_key) for r in s.search_range(b"a", b"m").collect()] == [b"apple", b"lemon"]
    again = Store(spark, s.table.path, dim=2, clock=clock)
    assert again.get(b"lemon") == b"sour"
    with pytest.raises(Conflict, match="WriteConflict"):  # begun before the commit, asked after the store was opened again
        again.prewrite(late, [(b"lemon", b"x")])
    with pytest.raises(ValueError):
        s.put_vector(1, [1.0])


def test_store_as_of_and_stale_locks(spark):
    clock = Clock(wall=iter(range(100, 10_000, 100)).__next__)
    s = Store(spark, job_dir(spark, "store"), 4, dim=2, clock=clock)
    first = s.put(b"k", b"one")
    s.put(b"k\0", b"other")
    s.flush()
    second, gone = s.put(b"k", b""), s.delete(b"k")
    before = (first[0] - 1, 0)
    assert [s.get(b"k", t) for t in (before, first, second, gone)] == [None, b"one", b"", None]
    s.flush()
    assert [s.get(b"k", t) for t in (before, first, second, gone)] == [None, b"one", b"", None] and s.get(b"k") is None
    assert [bytes(r.user_key) for r in s.search_range().collect()] == [b"k\0"]
    t = s.begin()
    s.prewrite(t, [(b"a", b"1"), (b"b", None)])
    again = Store(spark, s.table.path, dim=2, clock=clock)  # the owner is gone; its locks are not
    assert again.get_blocked(b"a", clock.local_event()) == t.start_ts and again.get_blocked(b"a", before) is None and again.get_blocked(b"x", before) is None
    with pytest.raises(Conflict, match="LockConflict"):
        again.prewrite(again.begin(), [(b"b", b"z")])
    assert again.resolve(b"a") == "wait"
    clock.physical += 2000
    assert again.resolve(b"a") == "roll_back" and again.resolve(b"a") == "none" and again.get(b"a") is None
    u = again.begin()
    again.prewrite(u, [(b"p", b"1"), (b"q", b"2")])
    u.mutations.pop()  # the commit ends after the primary
    ts = again.commit(u)
    clock.physical += 2000
    assert again.resolve(b"q") == "roll_forward" and again.get(b"q") == b"2" and again.get(b"q", ts) == b"2"


def test_stream(spark, sf, tmp_path):
    source = spark.read.parquet(f"{sf}/wal_log.parquet")
    source.repartition(6).write.parquet(str(tmp_path / "in"))
    t = KeyedTable.create(spark, job_dir(spark, "stream"), 4)
    q = streaming.apply_stream(streaming.read_feed(spark, str(tmp_path / "in"), source.schema, 2), t, job_dir(spark, "ckpt"))
    q.awaitTermination()
    once = KeyedTable.create(spark, job_dir(spark, "once"), 4)
    once.apply(source)
    assert len(t.versions()) == 4
    assert sorted(r.record_id for r in t.live().collect()) == sorted(r.record_id for r in once.live().collect())
    rates = streaming.change_rates(streaming.read_feed(spark, str(tmp_path / "in"), source.schema))
    out = rates.writeStream.format("memory").queryName("rates").outputMode("complete").trigger(availableNow=True).start()
    out.awaitTermination()
    assert spark.sql("SELECT sum(n_puts + n_deletes) FROM rates").first()[0] == source.where("arrived_at IS NOT NULL AND is_delete IS NOT NULL").count()


def test_more_routes_than_the_bound(spark, monkeypatch):
    routes = spark.createDataFrame([(None, bytearray(b"m"), 1, [1]), (bytearray(b"m"), None, 2, [2])], "start BINARY, end BINARY, shard INT, nodes ARRAY<BIGINT>")
    loads = spark.createDataFrame([(i, 1) for i in range(3)], "shard INT, load BIGINT")
    monkeypatch.setattr(routing, "MAX_ROUTES", 2)
    with pytest.raises(ValueError):
        routing.rebalance(routes, loads, [1, 2])
    monkeypatch.setattr(routing, "MAX_ROUTES", 1)
    with pytest.raises(ValueError):
        routing.raft_groups(routes.select("shard"), routes)
