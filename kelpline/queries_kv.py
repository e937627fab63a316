"""Queries of the versioned store, clocks, transactions and routing, with their SQL.

The histories are those of ``wal_log`` (keys, clocks, deletes). Transactions come from ``orders``: key =
o_custkey, start = o_orderkey, state from o_orderstatus (F committed, O lock held, P rolled back).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpline.functions import bloom, keys
from kelpline.operators import hlc, levels, mvcc, txn
from kelpline.plans import routing
from kelpline.session import job_dir, materialize
from kelpline.sources.store import Clock, Conflict, Store
from kelpline.sources.tables import table

AS_OF = (1421000000000, 5)
GET_TIMES = (1420080000000, 1420400000000, 1420700000000, 1421000000000, 1421500000000, 1422000000000, 9000000000000)
HOT_KEY = b"cfg:route_epoch"
START, END = b"run_", b"vec:5"


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mvcc.history(table(spark, sf_dir, "wal_log"), "record_id")


def _copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mvcc.copies(table(spark, sf_dir, "wal_log"), "record_id")


def _out(rows: DataFrame) -> DataFrame:
    return rows.select(F.hex("user_key").alias("user_key"), "physical", "logical", F.hex("value").alias("value"))


def _kept(rows: DataFrame) -> DataFrame:
    return rows.select(F.hex("user_key").alias("user_key"), "physical", "logical", "is_delete", F.hex("value").alias("value"))


def mvcc_get_as_of(spark, sf_dir):
    """The hot key as of several times."""
    v, out = _copies(spark, sf_dir), None
    for t in GET_TIMES:
        one = _out(mvcc.get(v, HOT_KEY, (t, 0))).withColumn("as_of", F.lit(t))
        out = one if out is None else out.unionByName(one)
    return out


def mvcc_scan_as_of(spark, sf_dir):
    return _out(mvcc.scan(_copies(spark, sf_dir), as_of=AS_OF))


def mvcc_range_scan(spark, sf_dir):
    return _out(mvcc.search_range(_copies(spark, sf_dir), START, END))


def mvcc_compact(spark, sf_dir):
    return _kept(mvcc.compact(_versions(spark, sf_dir), AS_OF))


def mvcc_compact_last_level(spark, sf_dir):
    return _kept(mvcc.compact(_versions(spark, sf_dir), AS_OF, is_last=True))


def mvcc_gc(spark, sf_dir):
    return _kept(mvcc.collect_garbage(_versions(spark, sf_dir), (1420500000000, 0)))


def level_compaction(spark, sf_dir):
    """Level 0 of each shard compacted into level 1: files merged, and the versions that replace them."""
    files, entries = levels.listed_levels(table(spark, sf_dir, "sst_file")), table(spark, sf_dir, "sst_entry")
    chosen, kept = levels.compact_level(files, entries, 0, AS_OF)
    per = chosen.groupBy("shard").agg(F.count_if(F.col("role") == "input").alias("n_inputs"), F.count_if(F.col("role") == "overlapping").alias("n_overlapping"))
    return per.join(kept.groupBy("shard").agg(F.count("*").alias("n_versions"), F.count_if("is_delete").alias("n_deletes")), "shard", "left")


def files_get(spark, sf_dir):
    """The probes' keys looked up in the files of their shard, past those that ranges and filters rule out."""
    entries = table(spark, sf_dir, "sst_entry")
    asked = table(spark, sf_dir, "key_probe").where("user_key IS NOT NULL AND shard IS NOT NULL").select("shard", "user_key").distinct()
    filters = materialize(levels.sound_filters(table(spark, sf_dir, "sst_file"), entries), "filters")
    rows = levels.get_many(asked, entries, filters, AS_OF)
    return rows.select("shard", F.hex("user_key").alias("user_key"), "physical", "logical", F.hex("value").alias("value"))


def merge_runs(spark, sf_dir):
    """Four runs, each the records of one class of record_id, merged."""
    v = _versions(spark, sf_dir)
    return _kept(mvcc.merge_runs([v.where(F.col("seq") % 4 == n).drop("seq") for n in range(4)]))


def snapshot(spark, sf_dir):
    return _out(mvcc.scan(_copies(spark, sf_dir)))


def wal_prefix(spark, sf_dir):
    """Records of each log file before its first with a null key or timestamp."""
    log = table(spark, sf_dir, "wal_log").select("record_id", "wal_file", (F.col("user_key").isNotNull() & F.col("ts").isNotNull()).alias("good"))
    return mvcc.valid_prefix(log, "wal_file", "record_id", F.col("good")).select("record_id", "wal_file")


def log_replay(spark, sf_dir):
    """The feed written as log files, a null key or time as a torn record, and replayed from their bytes."""
    log = table(spark, sf_dir, "wal_log").where("wal_file IS NOT NULL").select(F.regexp_replace("wal_file", "[^A-Za-z0-9_.-]", "_").alias("name"), F.col("record_id").alias("seq"), "user_key", F.col("ts.physical").alias("physical"),
                                                  F.col("ts.logical").alias("logical"), F.coalesce("is_delete", F.lit(False)).alias("is_delete"), "value")
    written = materialize(mvcc.write_logs(log, job_dir(spark, "logs")), "written")
    paths = [r.path for r in written.select("path").collect()]  # a row a file
    rows = mvcc.replay_logs(spark.read.format("binaryFile").load(paths))
    return rows.select(F.regexp_extract("path", "([^/]*)-[0-9a-f]{32}[.]log$", 1).alias("name"), "seq", F.hex("user_key").alias("user_key"), "physical", "logical", "is_delete", F.hex("value").alias("value"))


def store_session(spark, sf_dir):
    """A client's session over a store: a bulk load of the customers, transactions that write, delete and conflict, a reopened
    store with its conflicts, and what a range scan and reads as of an earlier time then see."""
    ticks = iter(range(1_000, 10_000_000, 10)).__next__
    clock = Clock(wall=ticks)
    s = Store(spark, job_dir(spark, "store"), 8, clock=clock)
    c = table(spark, sf_dir, "customer")
    s.put_frame(c.select(F.encode(F.concat(F.lit("cust:"), F.lpad(F.col("c_custkey").cast("string"), 8, "0")), "UTF-8").alias("user_key"), F.encode("c_name", "UTF-8").alias("value")))
    one, two, three = (b"cust:%08d" % n for n in (1, 2, 3))
    first = s.put(one, b"first")
    t, late = s.begin(), s.begin()
    s.prewrite(t, [(one, b"second"), (two, None)])
    seen = ["none"]
    try:
        s.prewrite(s.begin(), [(two, b"x")])
    except Conflict as e:
        seen.append(str(e).split(":")[0])
    s.commit(t)
    again = Store(spark, s.table.path, clock=clock)
    try:
        again.prewrite(late, [(one, b"x")])
    except Conflict as e:
        seen.append(str(e).split(":")[0])
    again.put(three, b"third")
    rows = again.search_range(b"cust:", b"cust;").select(F.decode("user_key", "UTF-8").alias("key"), F.decode("value", "UTF-8").alias("value"))
    more = [("as_of", (again.get(one, first) or b"").decode()), ("now", (again.get(one) or b"").decode()), ("conflicts", ",".join(seen))]
    return rows.unionByName(spark.createDataFrame(more, "key STRING, value STRING"))


def kv_prefix(spark, sf_dir):
    rows = mvcc.scan(_copies(spark, sf_dir))
    return _out(rows.where(keys.starts_with(F.col("user_key"), b"run_")))


def kv_vectors(spark, sf_dir):
    """Live keys 'vec:<id>' with their ids."""
    rows = mvcc.scan(_copies(spark, sf_dir)).withColumn("vec_id", keys.vector_id(F.col("user_key")))
    return rows.where("vec_id IS NOT NULL").select(F.hex("user_key").alias("user_key"), "vec_id")


def txn_keys(spark, sf_dir):
    """The stored keys of a lock and of a commit record, for each record of the feed."""
    rows = table(spark, sf_dir, "wal_log").where("user_key IS NOT NULL AND ts IS NOT NULL")
    return rows.select("record_id", F.hex(keys.txn_key("lock", F.col("user_key"))).alias("lock_key"),
                       F.hex(keys.txn_key("commit", F.col("user_key"), F.col("ts.physical"), F.col("ts.logical"))).alias("commit_key"))


def bloom_probe(spark, sf_dir):
    """Entries asked of their own file's filter: how many each filter denies (none, if it is whole)."""
    hit = bloom.probe(table(spark, sf_dir, "sst_entry").where("user_key IS NOT NULL").select("file_id", "user_key"), table(spark, sf_dir, "sst_file"))
    return hit.groupBy("file_id").agg(F.count("*").alias("n"), F.count_if(~F.col("may_contain")).alias("n_denied"))


def hlc_local_events(spark, sf_dir):
    """Clocks of the users over their events, wall clock in seconds."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("wall"))
    return hlc.local_events(e, "user_id", "event_id", "wall").select("event_id", "physical", F.col("logical").cast("bigint").alias("logical"))


def hlc_receive(spark, sf_dir):
    """One message received by each of a grid of clock states."""
    rows = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 7).alias("sp"), (F.col("event_id") % 3).alias("sl"), (F.col("user_id") % 7).alias("mp"), (F.col("user_id") % 4).alias("ml"), (F.col("event_id") % 5).alias("wall"))
    p, lo = hlc.received(*(F.col(c) for c in ("sp", "sl", "mp", "ml", "wall")))
    return rows.select("event_id", p.alias("physical"), lo.cast("bigint").alias("logical"))


def hlc_receive_sequence(spark, sf_dir):
    """Final clocks of the customers after all their orders' messages, a fold over each history."""
    m = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderkey") % 11).alias("wall"), (F.col("o_custkey") % 13).alias("mp"), (F.col("o_orderkey") % 3).alias("ml"))
    return hlc.receive_sequence(m, "o_custkey", "o_orderkey", "wall", "mp", "ml")


def _txns(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    done = o.where("o_orderstatus = 'F'")
    writes = done.select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("start_ts"), (F.col("o_orderkey") + 10).alias("commit_ts"))
    data = done.select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("start_ts"), F.col("o_totalprice").alias("value"))
    locks = o.where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("key"), (F.col("o_custkey") - F.col("o_custkey") % 3).alias("primary"), F.col("o_orderkey").alias("start_ts"), F.lit(1000).cast("bigint").alias("ttl"))
    return writes, data, locks


def txn_visible(spark, sf_dir):
    writes, data, _ = _txns(spark, sf_dir)
    return txn.visible(writes, data, F.lit(9000))


def txn_blocked(spark, sf_dir):
    return txn.blocked(_txns(spark, sf_dir)[2], F.lit(5000)).select("key", "start_ts")


def _mutations(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), (F.col("c_custkey") * 12).alias("start_ts"), F.col("c_custkey").alias("primary"), F.col("c_acctbal").alias("value"), F.lit(1000).cast("bigint").alias("ttl"))


def txn_conflicts(spark, sf_dir):
    writes, _, locks = _txns(spark, sf_dir)
    return txn.prewrite(_mutations(spark, sf_dir), writes, locks).select("key", "start_ts", "status", "conflict_commit_ts", "conflict_lock_ts")


def txn_commit(spark, sf_dir):
    """Every second lock is asked to commit, and every third at a start it wasn't taken at; what is written."""
    locks = _txns(spark, sf_dir)[2]
    asked = locks.where("start_ts % 2 = 0").select("key", (F.col("start_ts") + F.when(F.col("start_ts") % 3 == 0, 1).otherwise(0)).alias("start_ts"), (F.col("start_ts") + 20).alias("commit_ts"), (F.col("key") == F.col("primary")).alias("is_primary"))
    left, writes, commits = txn.commit(locks, asked)
    return (left.select(F.lit("lock").alias("kind"), "key", "start_ts").unionByName(writes.select(F.lit("write").alias("kind"), "key", "start_ts"))
            .unionByName(commits.select(F.lit("commit").alias("kind"), F.col("primary").alias("key"), "start_ts")))


def txn_rollback(spark, sf_dir):
    locks = _txns(spark, sf_dir)[2]
    left, records = txn.rollback(locks, locks.where("start_ts % 2 = 1").select("key", "start_ts"))
    return left.select(F.lit("lock").alias("kind"), "key", "start_ts").unionByName(records.select(F.lit("rollback").alias("kind"), "key", "start_ts"))


def txn_stale_locks(spark, sf_dir):
    writes, _, locks = _txns(spark, sf_dir)
    commits = locks.where("primary % 2 = 0").select("primary", "start_ts", (F.col("start_ts") + 5).alias("commit_ts")).distinct()
    return txn.stale_locks(locks, commits, F.lit(9000))


def _routes(spark):
    return spark.createDataFrame([(b"", b"idx", 1, [1, 2, 3]), (b"idx", b"run_2", 2, [2, 3, 4]), (b"run_2", b"vec:4", 3, [1, 3, 4]), (b"vec:4", b"vec:9", 4, [2, 4, 5])], "start BINARY, end BINARY, shard INT, nodes ARRAY<BIGINT>")


def _feed_keys(spark, sf_dir):
    return table(spark, sf_dir, "wal_log").where("user_key IS NOT NULL").select("record_id", "user_key")


def route_keys(spark, sf_dir):
    return routing.route(_feed_keys(spark, sf_dir), "user_key", _routes(spark)).select("record_id", "shard")


def route_keys_sql(spark, sf_dir):
    """The same by one SQL expression."""
    return _feed_keys(spark, sf_dir).select("record_id", routing.route_column(F.col("user_key"), routing.read_routes(_routes(spark))).alias("shard"))


def raft_groups(spark, sf_dir):
    routed = routing.route(_feed_keys(spark, sf_dir), "user_key", _routes(spark))
    return routing.raft_groups(routed, _routes(spark)).select("record_id", "shard", F.size("nodes").alias("n_nodes"), F.element_at("nodes", 1).alias("leader"))


def node_loads(spark, sf_dir):
    """Loads of shards = their rows in the feed; shard 4 has no report, node 9 no shards."""
    loads = route_keys(spark, sf_dir).where("shard < 4").groupBy("shard").agg(F.count("*").alias("load"))
    nodes = spark.createDataFrame([(n,) for n in (1, 2, 3, 4, 5, 9)], "node BIGINT")
    return routing.node_loads(_routes(spark), loads, nodes)


def rebalance_plan(spark, sf_dir):
    loads = route_keys(spark, sf_dir).groupBy("shard").agg(F.count("*").alias("load"))
    return routing.rebalance(_routes(spark), loads, [1, 2, 3, 4, 5, 9])


def rebalance_check(spark, sf_dir):
    """Each node's load before the plan's moves, and whether these narrow the gap and go from holders to others, step by step."""
    loads = {r.shard: r.load for r in route_keys(spark, sf_dir).groupBy("shard").agg(F.count("*").alias("load")).collect()}  # a row a shard
    held = {n: {s for _, _, s, nodes in routing.read_routes(_routes(spark)) if n in nodes} for n in (1, 2, 3, 4, 5, 9)}
    load = lambda n: sum(loads.get(s, 1) for s in held[n])
    before, good = {n: load(n) for n in held}, True
    for m in sorted(rebalance_plan(spark, sf_dir).collect()):
        gap = load(m.from_node) - load(m.to_node)
        good &= m.shard in held[m.from_node] - held[m.to_node]
        held[m.from_node].remove(m.shard)
        held[m.to_node].add(m.shard)
        good &= abs(load(m.from_node) - load(m.to_node)) < gap
    return spark.createDataFrame([(n, int(x), bool(good)) for n, x in before.items()], "node BIGINT, load BIGINT, narrows BOOLEAN")


def route_upsert(spark, sf_dir):
    changed = spark.createDataFrame([(b"idx", b"run_1", 2, [2, 3]), (b"vec:9", None, 5, [1, 5])], "start BINARY, end BINARY, shard INT, nodes ARRAY<BIGINT>")
    return routing.upsert_routes(_routes(spark), changed).select(F.hex("start").alias("start"), F.hex("end").alias("end"), "shard", F.size("nodes").alias("n_nodes"))


def route_remove(spark, sf_dir):
    return routing.remove_routes(_routes(spark), [2]).select(F.hex("start").alias("start"), "shard")


def _shards(spark, sf_dir):
    return table(spark, sf_dir, "wal_log").where("user_key IS NOT NULL").select("record_id", "user_key", "shard")


def shard_split(spark, sf_dir):
    return routing.split_shard(_shards(spark, sf_dir), 6, b"run_", 106).select("record_id", "shard")


def shard_merge(spark, sf_dir):
    return routing.merge_shard(_shards(spark, sf_dir), 7, 6).select("record_id", "shard")


QUERIES = {f.__name__: f for f in (
    mvcc_get_as_of, mvcc_scan_as_of, mvcc_range_scan, mvcc_compact, mvcc_compact_last_level, mvcc_gc, level_compaction, files_get, merge_runs, snapshot, wal_prefix, log_replay, store_session, kv_prefix, kv_vectors,
    txn_keys, bloom_probe, hlc_local_events, hlc_receive, hlc_receive_sequence, txn_visible, txn_blocked, txn_conflicts, txn_commit, txn_rollback, txn_stale_locks,
    route_keys, route_keys_sql, raft_groups, node_loads, rebalance_plan, rebalance_check, route_upsert, route_remove, shard_split, shard_merge)}

_V = """v AS (SELECT user_key, ts.physical AS physical, ts.logical AS logical, min(record_id) AS seq, arg_min(coalesce(is_delete, false), record_id) AS is_delete, first(value ORDER BY record_id) AS value
FROM wal_log WHERE user_key IS NOT NULL AND ts.physical IS NOT NULL AND ts.logical IS NOT NULL GROUP BY user_key, ts.physical, ts.logical)"""
_NEWEST = "SELECT * FROM v WHERE {} QUALIFY row_number() OVER (PARTITION BY user_key ORDER BY physical DESC, logical DESC, seq) = 1"
_OUT = "SELECT hex(user_key) AS user_key, physical, logical, hex(value) AS value FROM ({}) WHERE NOT is_delete"
_UP = f"(physical, logical) <= ({AS_OF[0]}, {AS_OF[1]})"
_HOT, _START, _END = "'cfg:route_epoch'::BLOB", "'run_'::BLOB", "'vec:5'::BLOB"
_KEPT = "SELECT hex(user_key) AS user_key, physical, logical, is_delete, hex(value) AS value FROM ({})"


def _compact(p: int, lo: int, last: bool) -> str:
    drop = " AND NOT is_delete" if last else ""
    return f"""WITH {_V}, f AS (SELECT *, (physical, logical) >= ({p}, {lo}) AS above, bool_or(physical = {p} AND logical = {lo}) OVER (PARTITION BY user_key) AS has_eq,
row_number() OVER (PARTITION BY user_key, (physical, logical) >= ({p}, {lo}) ORDER BY physical DESC, logical DESC) AS rn FROM v)
""" + _KEPT.format(f"SELECT * FROM f WHERE above OR (rn = 1 AND NOT has_eq{drop})")


_T = """w AS (SELECT o_custkey AS key, o_orderkey AS start_ts, o_orderkey + 10 AS commit_ts FROM orders WHERE o_orderstatus = 'F'),
data AS (SELECT o_custkey AS key, o_orderkey AS start_ts, o_totalprice AS value FROM orders WHERE o_orderstatus = 'F'),
locks AS (SELECT o_custkey AS key, o_custkey - o_custkey % 3 AS pri, o_orderkey AS start_ts, 1000::BIGINT AS ttl FROM orders WHERE o_orderstatus = 'O')"""
_ROUTES = "r AS (SELECT * FROM (VALUES (''::BLOB, 'idx'::BLOB, 1, [1, 2, 3]), ('idx'::BLOB, 'run_2'::BLOB, 2, [2, 3, 4]), ('run_2'::BLOB, 'vec:4'::BLOB, 3, [1, 3, 4]), ('vec:4'::BLOB, 'vec:9'::BLOB, 4, [2, 4, 5])) t(a, b, shard, nodes))"
_ROUTED = f"{_ROUTES}, routed AS (SELECT record_id, coalesce(r.shard, 1)::INT AS shard FROM wal_log LEFT JOIN r ON user_key >= a AND user_key < b WHERE user_key IS NOT NULL)"
_CRC = "list_reduce({}, lambda c, b: list_reduce([xor(c, b), 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT], lambda x, z: xor(x >> 1, 3988292384::UBIGINT * (x & 1::UBIGINT))))"
_RECEIVED = "CASE WHEN p = sp AND p = mp THEN greatest(sl, ml) + 1 WHEN p = sp THEN sl + 1 WHEN p = mp THEN ml + 1 ELSE 0 END"

ORACLE = {
    "mvcc_get_as_of": f"WITH {_V}, t AS (SELECT unnest({list(GET_TIMES)})::BIGINT AS as_of) SELECT hex(user_key) AS user_key, physical, logical, hex(value) AS value, as_of FROM (SELECT * FROM v, t WHERE user_key = {_HOT} AND (physical, logical) <= (as_of, 0) QUALIFY row_number() OVER (PARTITION BY as_of ORDER BY physical DESC, logical DESC) = 1) WHERE NOT is_delete",
    "mvcc_scan_as_of": f"WITH {_V} " + _OUT.format(_NEWEST.format(_UP)),
    "mvcc_range_scan": f"WITH {_V} " + _OUT.format(_NEWEST.format(f"user_key >= {_START} AND user_key < {_END}")) + " AND NOT starts_with(hex(user_key), '5F5F')",
    "mvcc_compact": _compact(*AS_OF, False),
    "mvcc_compact_last_level": _compact(*AS_OF, True),
    "mvcc_gc": _compact(1420500000000, 0, False),
    "level_compaction": f"""WITH f AS (SELECT file_id, shard, level FROM sst_file WHERE file_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY listing_id) = 1 AND tier = 'level' AND level IN (0, 1)),
g AS (SELECT f.*, low, high FROM f JOIN (SELECT file_id, min(user_key) AS low, max(user_key) AS high FROM sst_entry WHERE user_key IS NOT NULL GROUP BY file_id) USING (file_id)),
s AS (SELECT shard, min(low) AS a, max(high) AS b FROM g WHERE level = 0 GROUP BY shard),
picked AS (SELECT g.* FROM g JOIN s USING (shard) WHERE level = 0 OR (high >= a AND low <= b)),
v AS (SELECT p.shard, user_key, ts.physical AS physical, ts.logical AS logical, arg_min(coalesce(is_delete, false), entry_id) AS dead FROM sst_entry e JOIN picked p USING (file_id)
  WHERE user_key IS NOT NULL AND ts.physical IS NOT NULL AND ts.logical IS NOT NULL GROUP BY p.shard, user_key, ts.physical, ts.logical),
w AS (SELECT *, (physical, logical) >= ({AS_OF[0]}, {AS_OF[1]}) AS above, bool_or(physical = {AS_OF[0]} AND logical = {AS_OF[1]}) OVER (PARTITION BY shard, user_key) AS has_eq,
  row_number() OVER (PARTITION BY shard, user_key, (physical, logical) >= ({AS_OF[0]}, {AS_OF[1]}) ORDER BY physical DESC, logical DESC) AS rn FROM v),
k AS (SELECT shard, count(*) AS n_versions, count(*) FILTER (WHERE dead) AS n_deletes FROM w WHERE above OR (rn = 1 AND NOT has_eq) GROUP BY shard)
SELECT shard, n_inputs, n_overlapping, n_versions, n_deletes FROM (SELECT shard, count(*) FILTER (WHERE level = 0) AS n_inputs, count(*) FILTER (WHERE level = 1) AS n_overlapping FROM picked GROUP BY shard) LEFT JOIN k USING (shard)""",
    "files_get": f"""WITH v AS (SELECT shard, user_key, ts.physical AS physical, ts.logical AS logical, arg_min(coalesce(is_delete, false), entry_id) AS is_delete, first(value ORDER BY entry_id) AS value
FROM sst_entry WHERE user_key IS NOT NULL AND ts.physical IS NOT NULL AND ts.logical IS NOT NULL AND (shard, user_key) IN (SELECT (shard, user_key) FROM key_probe WHERE user_key IS NOT NULL AND shard IS NOT NULL)
GROUP BY shard, user_key, ts.physical, ts.logical),
n AS (SELECT * FROM v WHERE {_UP} QUALIFY row_number() OVER (PARTITION BY shard, user_key ORDER BY physical DESC, logical DESC) = 1)
SELECT shard, hex(user_key) AS user_key, physical, logical, hex(value) AS value FROM n WHERE NOT is_delete""",
    "merge_runs": f"WITH {_V} " + _KEPT.format("SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY user_key ORDER BY physical DESC, logical DESC, seq % 4) = 1"),
    "snapshot": f"WITH {_V} " + _OUT.format(_NEWEST.format("true")),
    "wal_prefix": "SELECT record_id, wal_file FROM (SELECT *, min(CASE WHEN user_key IS NULL OR ts IS NULL THEN record_id END) OVER (PARTITION BY wal_file) AS bad FROM wal_log) WHERE bad IS NULL OR record_id < bad",
    "log_replay": """WITH l AS (SELECT *, regexp_replace(wal_file, '[^A-Za-z0-9_.-]', '_', 'g') AS name, user_key IS NULL OR ts.physical IS NULL OR ts.logical IS NULL AS torn FROM wal_log WHERE wal_file IS NOT NULL),
p AS (SELECT *, min(CASE WHEN torn THEN record_id END) OVER (PARTITION BY name) AS bad, row_number() OVER (PARTITION BY name ORDER BY record_id) - 1 AS seq FROM l)
SELECT name, seq, hex(user_key) AS user_key, ts.physical AS physical, ts.logical AS logical, coalesce(is_delete, false) AS is_delete, CASE WHEN NOT coalesce(is_delete, false) THEN coalesce(hex(value), '') END AS value
FROM p WHERE bad IS NULL OR record_id < bad""",
    "store_session": """SELECT 'cust:' || lpad(c_custkey::VARCHAR, 8, '0') AS key, CASE c_custkey WHEN 1 THEN 'second' WHEN 3 THEN 'third' ELSE c_name END AS value FROM customer WHERE c_custkey <> 2
UNION ALL SELECT * FROM (VALUES ('as_of', 'first'), ('now', 'second'), ('conflicts', 'none,LockConflict,WriteConflict'))""",
    "kv_prefix": f"WITH {_V} " + _OUT.format(_NEWEST.format("true")) + " AND starts_with(hex(user_key), '72756E5F')",
    "kv_vectors": f"WITH {_V} SELECT hex(user_key) AS user_key, CAST(decode(user_key[5:]) AS BIGINT) AS vec_id FROM ({_NEWEST.format('true')}) WHERE NOT is_delete AND regexp_full_match(hex(user_key), '7665633A(3[0-9]){{1,18}}')",
    "txn_keys": "SELECT record_id, '6C' || hex(user_key) AS lock_key, '63' || hex(user_key) || lpad(hex(ts.physical), 16, '0') || lpad(hex(ts.logical), 8, '0') AS commit_key FROM wal_log WHERE user_key IS NOT NULL AND ts IS NOT NULL",
    "hlc_local_events": """WITH e AS (SELECT event_id, user_id, max(epoch(date_trunc('second', ts))::BIGINT) OVER (PARTITION BY user_id ORDER BY event_id) AS physical FROM events)
SELECT event_id, physical, row_number() OVER (PARTITION BY user_id, physical ORDER BY event_id) - 1 AS logical FROM e""",
    "hlc_receive": f"WITH m AS (SELECT event_id, event_id % 7 AS sp, event_id % 3 AS sl, user_id % 7 AS mp, user_id % 4 AS ml, event_id % 5 AS wall FROM events), g AS (SELECT *, greatest(sp, mp, wall) AS p FROM m) SELECT event_id, p AS physical, ({_RECEIVED})::BIGINT AS logical FROM g",
    "hlc_receive_sequence": """WITH RECURSIVE m AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, o_orderkey % 11 AS wall, o_custkey % 13 AS mp, o_orderkey % 3 AS ml FROM orders),
c AS (SELECT DISTINCT o_custkey, 0::BIGINT AS i, 0::BIGINT AS sp, 0::BIGINT AS sl FROM orders
UNION ALL SELECT m.o_custkey, m.i, greatest(sp, mp, wall), CASE WHEN greatest(sp, mp, wall) = sp AND sp = mp THEN greatest(sl, ml) + 1 WHEN greatest(sp, mp, wall) = sp THEN sl + 1 WHEN greatest(sp, mp, wall) = mp THEN ml + 1 ELSE 0 END
FROM c JOIN m ON c.o_custkey = m.o_custkey AND m.i = c.i + 1)
SELECT o_custkey, sp AS physical, sl AS logical FROM c QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY i DESC) = 1""",
    "txn_visible": f"WITH {_T}, last AS (SELECT * FROM w WHERE commit_ts <= 9000 QUALIFY row_number() OVER (PARTITION BY key ORDER BY commit_ts DESC) = 1) SELECT key, start_ts, commit_ts, value FROM last JOIN data USING (key, start_ts)",
    "txn_blocked": f"WITH {_T} SELECT key, start_ts FROM locks WHERE start_ts <= 5000",
    "txn_conflicts": f"""WITH {_T}, lw AS (SELECT key, max(commit_ts) AS lc FROM w GROUP BY key), ll AS (SELECT key, max(start_ts) AS ls FROM locks GROUP BY key),
j AS (SELECT c_custkey AS key, c_custkey * 12 AS start_ts, lc, ls, CASE WHEN lc >= c_custkey * 12 THEN 'WriteConflict' WHEN ls IS NOT NULL THEN 'LockConflict' ELSE 'Ok' END AS status
FROM customer LEFT JOIN lw ON lw.key = c_custkey LEFT JOIN ll ON ll.key = c_custkey)
SELECT key, start_ts, status, CASE WHEN status = 'WriteConflict' THEN lc END AS conflict_commit_ts, CASE WHEN status = 'LockConflict' THEN ls END AS conflict_lock_ts FROM j""",
    "txn_commit": f"""WITH {_T}, a AS (SELECT key, start_ts + CASE WHEN start_ts % 3 = 0 THEN 1 ELSE 0 END AS start_ts, key = pri AS is_primary FROM locks WHERE start_ts % 2 = 0),
held AS (SELECT * FROM a WHERE (key, start_ts) IN (SELECT (key, start_ts) FROM locks))
SELECT 'lock' AS kind, key, start_ts FROM locks WHERE (key, start_ts) NOT IN (SELECT (key, start_ts) FROM held) UNION ALL SELECT 'write', key, start_ts FROM held UNION ALL SELECT 'commit', key, start_ts FROM held WHERE is_primary""",
    "txn_rollback": f"WITH {_T} SELECT 'lock' AS kind, key, start_ts FROM locks WHERE start_ts % 2 = 0 UNION ALL SELECT 'rollback', key, start_ts FROM locks WHERE start_ts % 2 = 1",
    "txn_stale_locks": f"""WITH {_T}, c AS (SELECT DISTINCT pri, start_ts, start_ts + 5 AS commit_ts FROM locks WHERE pri % 2 = 0),
j AS (SELECT key, pri, start_ts, commit_ts, CASE WHEN 9000 <= start_ts + ttl THEN 'wait' WHEN commit_ts IS NOT NULL THEN 'roll_forward' ELSE 'roll_back' END AS action FROM locks LEFT JOIN c USING (pri, start_ts))
SELECT key, pri AS "primary", start_ts, action, CASE WHEN action = 'roll_forward' THEN commit_ts END AS commit_ts FROM j""",
    "route_keys": f"WITH {_ROUTED} SELECT record_id, shard FROM routed",
    "route_keys_sql": f"WITH {_ROUTED} SELECT record_id, shard FROM routed",
    "raft_groups": f"WITH {_ROUTED} SELECT record_id, shard, len(nodes)::INT AS n_nodes, nodes[1]::BIGINT AS leader FROM routed JOIN r USING (shard)",
    "node_loads": f"WITH {_ROUTED}, loads AS (SELECT shard, count(*) AS load FROM routed WHERE shard < 4 GROUP BY shard), p AS (SELECT shard, unnest(nodes)::BIGINT AS node FROM r) SELECT node, coalesce(load, 0)::BIGINT AS load FROM (SELECT unnest([1, 2, 3, 4, 5, 9])::BIGINT AS node) LEFT JOIN (SELECT node, sum(coalesce(load, 1)) AS load FROM p LEFT JOIN loads USING (shard) GROUP BY node) USING (node)",
    "rebalance_check": f"WITH {_ROUTED}, loads AS (SELECT shard, count(*) AS load FROM routed GROUP BY shard), p AS (SELECT shard, unnest(nodes)::BIGINT AS node FROM r) SELECT node, coalesce(load, 0)::BIGINT AS load, true AS narrows FROM (SELECT unnest([1, 2, 3, 4, 5, 9])::BIGINT AS node) LEFT JOIN (SELECT node, sum(coalesce(load, 1)) AS load FROM p LEFT JOIN loads USING (shard) GROUP BY node) USING (node)",
    "bloom_probe": f"""WITH f AS (SELECT file_id, bits, k FROM sst_file QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY coalesce(octet_length(bits), -1) DESC, coalesce(k, -1) DESC, bits DESC) = 1),
e AS (SELECT file_id, {_CRC.format("list_concat([4294967295::UBIGINT], list_transform(range(octet_length(user_key)), lambda i: ('0x' || hex(user_key)[2 * i + 1 : 2 * i + 2])::UBIGINT))")} AS s FROM sst_entry WHERE user_key IS NOT NULL),
j AS (SELECT e.file_id, s, hex(bits) AS h, octet_length(bits) * 8 AS m, CASE WHEN octet_length(bits) > 0 AND k > 0 THEN k ELSE 0 END AS k FROM e LEFT JOIN f ON e.file_id = f.file_id),
a AS (SELECT file_id, h, len(list_filter(list_transform(range(coalesce(k, 0)), lambda i: xor({_CRC.format("[s, i::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT]")}, 4294967295::UBIGINT) % m::UBIGINT),
  lambda p: (('0x' || h[2 * (p // 8) + 1 : 2 * (p // 8) + 2])::UBIGINT >> (p % 8)) & 1 = 0)) > 0 AS denied FROM j)
SELECT file_id, count(*) AS n, count(*) FILTER (WHERE denied) AS n_denied FROM a GROUP BY file_id""",
    "route_upsert": "SELECT * FROM (VALUES ('', hex('idx'::BLOB), 1, 3), (hex('idx'::BLOB), hex('run_1'::BLOB), 2, 2), (hex('run_2'::BLOB), hex('vec:4'::BLOB), 3, 3), (hex('vec:4'::BLOB), hex('vec:9'::BLOB), 4, 3), (hex('vec:9'::BLOB), NULL, 5, 2)) t(start, \"end\", shard, n_nodes)",
    "route_remove": "SELECT * FROM (VALUES ('', 1), (hex('run_2'::BLOB), 3), (hex('vec:4'::BLOB), 4)) t(start, shard)",
    "shard_split": f"SELECT record_id, CASE WHEN shard = 6 AND user_key >= {_START} THEN 106 ELSE shard END AS shard FROM wal_log WHERE user_key IS NOT NULL",
    "shard_merge": "SELECT record_id, CASE WHEN shard = 7 THEN 6 ELSE shard END AS shard FROM wal_log WHERE user_key IS NOT NULL",
}
