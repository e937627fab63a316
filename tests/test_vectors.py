import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kelpline.functions import bloom
from kelpline.functions.distance import METRICS
from kelpline.operators import graph, knn, pq
from kelpline.plans import planner
from kelpline.queries_vectors import QUERIES
from kelpline.session import job_dir
from kelpline.sources.index_files import DiskIndex, ReadOnlyIndex


def frame(spark, x, **extra):
    return spark.createDataFrame([(i, [float(a) for a in v], i % 3) for i, v in enumerate(x)], "vec_id BIGINT, embedding ARRAY<FLOAT>, shard INT")


@pytest.fixture(scope="module")
def cloud():
    return np.random.default_rng(3).random((300, 32)).astype(np.float32)


def test_distances(spark):
    rows = [([0.0, 0.0], [1.0, 2.0]), ([3.0, 4.0], [3.0, 4.0]), ([1.0, 0.0], [-1.0, 0.0]), (None, [1.0]), ([], [])]
    df = spark.createDataFrame(rows, "a ARRAY<FLOAT>, b ARRAY<FLOAT>")
    got = df.select(*[f(F.col("a"), F.col("b")).alias(m) for m, f in METRICS.items()]).collect()
    assert got[0].asDict() == pytest.approx({"dot": 0, "l2": math.sqrt(5), "l1": 3, "cosine": 1.0})
    assert got[1].asDict() == pytest.approx({"dot": 25, "l2": 0, "l1": 0, "cosine": 0})
    assert got[2].cosine == 2.0 and got[3].l2 is None and got[4].l2 == 0
    with pytest.raises(Exception, match="dimension mismatch"):
        spark.createDataFrame([([1.0], [1.0, 2.0])], "a ARRAY<FLOAT>, b ARRAY<FLOAT>").select(METRICS["l2"](F.col("a"), F.col("b"))).collect()


def test_nearest_and_ties(spark):
    v = frame(spark, [[0, 0], [1, 0], [0, 1], [1, 0], [5, 5]])
    assert [r.vec_id for r in knn.nearest(v, [0, 0], 3).collect()] == [0, 1, 2]
    assert knn.nearest(v, [0, 0], 3, radius=0.5).count() == 1
    assert knn.nearest(v, [0, 0], 0).count() == 0
    some = v.where("vec_id in (3, 4)")
    assert [r.vec_id for r in knn.nearest(v, [0, 0], 3, ids=some).collect()] == [3, 4]
    assert knn.nearest_then_filter(v, [0, 0], 2, some).count() == 0
    with pytest.raises(Exception, match="dimension mismatch"):
        knn.nearest(v, [0, 0, 0], 1).collect()


def test_batched_is_exact(spark, cloud):
    v = frame(spark, cloud)
    q = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    got = {}
    for r in knn.nearest_batched(v, q, 5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    for i, ids in got.items():
        d = ((cloud.astype(float) - cloud[i]) ** 2).sum(1)
        assert ids == np.lexsort((np.arange(300), d))[:5].tolist()
    assert knn.nearest_batched(v.limit(0), q, 5).count() == 0 == knn.nearest_batched(v, q.limit(0), 5).count()


def test_overfetch():
    assert knn.overfetch(10, 0.1, 1000) == 100 and knn.overfetch(10, 0, 500) == 500 and knn.overfetch(10, 1, 5) == 5


@pytest.mark.parametrize("rows,size,disk,flt,want", [
    (100, 102400, False, None, planner.BRUTE), (500, 512000, False, None, planner.BRUTE), (1000, 1024000, False, None, planner.GRAPH),
    (5000, 5 << 20, True, None, planner.GRAPH), (50000, 15 << 20, True, None, planner.DISK), (50000, 15 << 20, False, None, planner.GRAPH)])
def test_planner(rows, size, disk, flt, want):
    assert planner.plan(planner.Stats(rows, size, disk), flt) == want


def test_planner_filters():
    s = planner.Stats(2000, 5 << 20)
    assert planner.plan(s, 40, 100) == planner.PRE and planner.plan(s, 1800, 100) == planner.POST
    assert planner.Stats(0).selectivity(5) == 0 and planner.Stats(10).selectivity(50) == 1
    assert planner.cost(planner.BRUTE, 10, s) == 2000


def test_robust_prune():
    x = np.array([[0, 0, 0], [1, 0, 0], [1.1, 0, 0], [0, 1, 0], [0, 0, 1]], float)
    kept = graph.robust_prune(x, 0, [1, 2, 3, 4], 1.2, 3)
    assert 1 in kept and 2 not in kept and {3, 4} <= set(kept) and len(kept) <= 3
    assert graph.robust_prune(x, 0, [], 1.2, 3) == []


@pytest.mark.parametrize("kind", ["layered", "flat"])
def test_graph_recall(spark, cloud, kind):
    v = frame(spark, cloud)
    q = v.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    g = graph.build(v, kind).cache()
    r = knn.recall_at_k(graph.search(v, g, q, 10), knn.nearest_batched(v, q, 10)).agg(F.avg("recall")).first()[0]
    assert r >= 0.9
    even = v.where("vec_id % 2 = 0")  # deleted rows are walked through, never returned
    got = graph.search(v, g, q, 10, allowed=even)
    assert got.where("vec_id % 2 = 1").count() == 0
    assert knn.recall_at_k(got, knn.nearest_batched(even, q, 10)).agg(F.avg("recall")).first()[0] >= 0.85
    learned = graph.search(v, g, q, 10, learned=graph.trained_entries(v))
    assert knn.recall_at_k(learned, knn.nearest_batched(v, q, 10)).agg(F.avg("recall")).first()[0] >= r - 0.05


def test_vectorised_choices_are_the_rules():
    r = np.random.default_rng(3)
    x = r.normal(size=(60, 5)).astype(np.float32)
    base = np.arange(20, dtype=np.int32)
    ids, d = graph._sorted(x, base, np.stack([r.permutation(60)[:30] for _ in base]).astype(np.int32), 25)
    kept = graph.robust(x, ids, d, 6, 1.2)
    wide = graph.diverse(x, ids, d, 6)
    for p in base:
        some = [int(i) for i in ids[p] if i >= 0]
        assert p not in some and [i for i in kept[p] if i >= 0] == graph.robust_prune(x.astype(np.float64), p, some, 1.2, 6)
        want = []
        for i in some:
            if len(want) < 6 and all(((x[i] - x[j]) ** 2).sum() > ((x[i] - x[p]) ** 2).sum() for j in want):
                want.append(i)
        assert wide[p].tolist()[: len(want)] == want and (wide[p] >= 0).all() and len(set(wide[p])) == 6


def test_graphs_of_few_and_equal_rows():
    for x in (np.zeros((0, 3)), np.zeros((1, 3)), np.ones((700, 3))):
        for make in graph.BUILDERS.values():
            g = make(x.astype(np.float32))
            who, row, d = g.search(np.ones((2, 3)), 4)
            # pruning keeps one of several equal rows, so a flat graph of them falls apart
            assert len(row) == 2 * min(4, len(x)) if len(x) < 2 or make is graph.build_layered else len(row) >= 2
            assert len(x) != 1 or d.max() > 1
            assert all(((z >= -1) & (z < len(x))).all() for z in g.links)


def test_entry_in_a_layer(cloud):
    g = graph.build_layered(cloud.astype(np.float32), m=4)
    top = int(np.flatnonzero(g.level >= 1)[0])
    plain = g.search(cloud[:20].astype(float), 5)
    for layer, start in ((0, 17), (1, top), (1, int(np.flatnonzero(g.level == 0)[0])), (9, 3)):
        who, row, d = g.search(cloud[:20].astype(float), 5, start=np.full(20, start), start_layer=layer)
        assert len(row) == len(plain[1]) and (np.diff(d[who == 0]) >= 0).all() and (row == plain[1]).mean() > 0.8


def test_probed_shards(spark, cloud):
    v = graph.sharded(frame(spark, cloud).drop("shard"), 4).cache()
    assert v.count() == 300 and v.select("shard").distinct().count() == 4
    q = v.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    g, c = graph.build(v, "flat").cache(), graph.shard_centres(v).cache()
    one = graph.search(v, g, q, 5, centres=c, probe=1)
    assert one.join(v.select("vec_id", "shard"), "vec_id").groupBy("query_id").agg(F.countDistinct("shard").alias("n")).where("n > 1").count() == 0
    assert one.where("query_id = vec_id AND rank = 1").count() == 30
    assert knn.recall_by_distance(graph.search(v, g, q, 5, centres=c, probe=4), knn.nearest_batched(v, q, 5)).agg(F.avg("recall")).first()[0] >= 0.9


def test_regions_are_dealt_to_shards(spark):
    """A region too large for a task becomes several even shards; a query asks all of them, for as many regions as it may."""
    r = np.random.default_rng(4)
    x = np.concatenate([r.normal(c, 0.1, (n, 8)) for c, n in ((0, 700), (5, 90), (10, 30))]).astype(np.float32)
    v = graph.sharded(frame(spark, x).drop("shard"), 3, most=100).cache()
    sizes = {(z.region, z.shard): z["count"] for z in v.groupBy("region", "shard").count().collect()}
    assert sum(sizes.values()) == len(x) and len(sizes) == len({s for _, s in sizes}) == 9 and max(sizes.values()) < 150
    g, c, q = graph.build(v, "flat").cache(), graph.shard_centres(v), v.where("vec_id % 9 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    assert {(z.region, z.shard) for z in c.collect()} == set(sizes) and len({tuple(z.centre) for z in c.collect()}) == 3
    own = graph._routed(q, v.select("shard").distinct(), c, 1).groupBy("query_id").agg(F.collect_set("shard").alias("s"))
    where = {z.vec_id: z.region for z in v.select("vec_id", "region").collect()}
    assert all(set(z.s) == {s for n, s in sizes if n == where[z.query_id]} for z in own.collect())
    recall = knn.recall_by_distance(graph.search(v, g, q, 5, centres=c, probe=1), knn.nearest_batched(v, q, 5))
    assert recall.agg(F.avg("recall")).first()[0] > 0.97


def test_insert_links_new_rows(spark, cloud):
    v = frame(spark, cloud)
    old, q = v.where("vec_id < 200"), v.where("vec_id >= 290").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    g = graph.build(old, "layered").cache()
    grown = graph.insert(old, g, v.where("shard < 2").unionByName(v.where("vec_id = 1"))).cache()
    assert grown.where("shard = 2").count() == g.where("shard = 2").count()
    assert grown.where("layer = 0 AND shard < 2").count() == v.where("shard < 2").count()
    some = v.where("shard < 2 OR vec_id < 200")
    assert knn.recall_at_k(graph.search(v, grown, q, 10), knn.nearest_batched(some, q, 10)).agg(F.avg("recall")).first()[0] >= 0.9
    s = graph.graph_stats(v, grown, deleted=v.where("vec_id = 3")).first()
    assert s.n_live == 299 and s.memory_bytes == 300 * (32 * 4 + 16) + 8 * s.n_edges


def test_learned_entry_on_identical_points():
    e = graph.LearnedEntry(4).fit(np.ones((20, 4)), np.arange(20))
    assert e.predict(np.stack([np.ones(4), np.full(4, 1e6)])).tolist() == [0, -1] and graph.LearnedEntry(4).predict(np.ones((1, 4))).tolist() == [-1]


def test_pq_round_trip(spark):
    x = np.random.default_rng(5).uniform(-1, 1, (400, 16)).astype(np.float32)
    v = frame(spark, x)
    book = pq.train(v, 4, 64, 6)
    assert pq.reconstruction_error(v, book).agg(F.avg("rmse")).first()[0] < 0.5
    codes = pq.encode(v, book)
    got = {r.vec_id: r.adc for r in pq.adc(codes, x[0].tolist(), book).collect()}
    t = pq.distance_table(x[0].tolist(), book)
    for r in codes.limit(20).collect():
        assert got[r.vec_id] == pytest.approx(sum(t[s][c] for s, c in enumerate(r.codes)))
    with pytest.raises(ValueError):
        pq.train(v, 5, 8)


def test_disk_index(spark, cloud):
    v = frame(spark, cloud)
    path = job_dir(spark, "index")
    ix = DiskIndex.build(v, path, m=8, centroids=32, ef=40, r=16)
    found = [r.vec_id for r in DiskIndex(spark, path).search(cloud[7].tolist(), 5).collect()]
    assert found[0] == 7 and ix.stats()["num_vectors"] == 300
    assert ix.in_memory_bytes() < 300 * 32 * 4 * 3
    with pytest.raises(ReadOnlyIndex):
        ix.insert(1)
    with pytest.raises(FileExistsError):
        DiskIndex.build(v, path)


def test_bloom(spark):
    keys = [b"key_%d" % i for i in range(2000)]
    bits, k = bloom.build(keys, 0.01)
    probes = spark.createDataFrame([(bytearray(x), 1) for x in keys[:300] + [b"query_%d" % i for i in range(3000)]], "user_key BINARY, file_id INT")
    files = spark.createDataFrame([(1, bytearray(bits), k), (1, bytearray(bits), k), (2, None, None)], "file_id INT, bits BINARY, k INT")
    got = bloom.probe(probes, files).groupBy(F.startswith("user_key", F.lit(b"key_")).alias("stored")).agg(F.avg(F.col("may_contain").cast("int")).alias("p"), F.count("*")).collect()
    share = {r.stored: r.p for r in got}
    assert share[True] == 1.0 and share[False] <= 0.02
    assert bloom.build([]) == (b"", 0)
    empty = spark.createDataFrame([(2, bytearray(b""), 3)], "file_id INT, bits BINARY, k INT")
    assert bloom.probe(probes.withColumn("file_id", F.lit(2)).limit(3), empty).where("may_contain").count() == 3


def test_more_shards_than_the_bound(spark, cloud, monkeypatch):
    v = frame(spark, cloud)
    monkeypatch.setattr(graph, "MAX_SHARDS", 2)
    with pytest.raises(ValueError):
        graph.search(v, spark.createDataFrame([], graph.GRAPH), v.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), 3)


def test_planned_search_walks_graph_and_disk_index(spark, sf, monkeypatch):
    walked = []
    for owner, name in ((graph, "search"), (DiskIndex, "search")):
        monkeypatch.setattr(owner, name, lambda *a, f=getattr(owner, name), o=owner, **k: walked.append(o) or f(*a, **k))
    QUERIES["planned_search"](spark, sf).collect()
    assert not walked
    assert all(r.recalled for r in QUERIES["planned_search_indexed"](spark, sf).collect())
    assert walked.count(graph) == 2 and walked.count(DiskIndex) == 1


def test_registered_training_takes_all_steps(spark, sf, monkeypatch):
    steps, trained = [], pq.train_kmeans
    monkeypatch.setattr(pq, "train_kmeans", lambda v, k, max_steps, **o: steps.append(max_steps) or trained(v, k, max_steps, **o))
    assert QUERIES["pq_train_rmse"](spark, sf).first()["n"] > 0 and steps == [15]


def test_registered_prune_covers_the_table(spark, sf):
    x = {r.vec_id: r.embedding for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    got = {r.vec_id: r.kept for r in QUERIES["robust_prune"](spark, sf).collect()}
    assert set(got) == set(x)
    ids = np.array(sorted(x))
    y = np.array([x[i] for i in ids], np.float64)
    for p in (0, len(ids) // 2):
        near = [i for i in np.lexsort((ids, ((y - y[p]) ** 2).sum(1)))[:33] if i != p]
        assert got[ids[p]] == [ids[i] for i in graph.robust_prune(y, p, near, 1.2, 16)]
