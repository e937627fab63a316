"""Queries of vector search, planning and quantisation over ``embeddings``, with their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpline.functions.distance import METRICS, literal_vector
from kelpline.operators import graph, knn, pq
from kelpline.plans import execute, planner
from kelpline.session import job_dir, materialize
from kelpline.sources.index_files import DiskIndex, ReadOnlyIndex
from kelpline.sources.tables import table

K, RADIUS, LABEL = 10, 1.15, 3


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def _query(vectors: DataFrame, vec_id: int = 0) -> list[float]:
    return list(vectors.where(F.col("vec_id") == vec_id).select("embedding").first()[0])


def _out(found: DataFrame) -> DataFrame:
    return found.select("vec_id", F.round("distance", 6).alias("distance"))


def _queries(vectors: DataFrame) -> DataFrame:
    return vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def _distances(metric: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        v = _vectors(spark, sf_dir)
        return v.select("vec_id", F.round(METRICS[metric](F.col("embedding"), literal_vector(_query(v))), 6).alias("distance"))

    return run


def knn_exact(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return _out(knn.nearest(v, _query(v), K))


def knn_radius(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return _out(knn.nearest(v, _query(v), K, radius=RADIUS))


def knn_filtered(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return _out(knn.nearest(v, _query(v), K, where=F.col("label") == LABEL))


def knn_filtered_radius(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    ids = v.where(F.col("label") == LABEL).select("vec_id")
    return _out(knn.nearest(v, _query(v), K, radius=1.3, ids=ids))


def knn_batched(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return knn.nearest_batched(v, _queries(v), K).select("query_id", "vec_id", F.round("distance", 6).alias("distance"), F.col("rank").cast("bigint").alias("rank"))


def range_search(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return _out(knn.within(v, _query(v), 1.25))


def knn_prefilter_radius_late(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return _out(knn.nearest_then_radius(v, _query(v), K, 1.25, F.col("label") == LABEL))


def knn_postfilter_overfetch(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    ids = v.where(F.col("label") == LABEL).select("vec_id")
    n, m = v.count(), ids.count()
    fetch = knn.overfetch(K, planner.Stats(n).selectivity(m), n)
    return _out(knn.nearest_postfiltered(v, _query(v), K, ids, fetch))


def knn_limit_then_filter(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return _out(knn.nearest_then_filter(v, _query(v), 50, v.where(F.col("label") == LABEL)))


def knn_deleted(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return _out(knn.nearest(knn.without(v, v.where("label = 9")), _query(v), K))


def knn_scatter_gather(spark, sf_dir):
    """Vectors sharded by vec_id, each also copied to the next shard: ids come back once."""
    v = _vectors(spark, sf_dir)
    sharded = v.withColumn("shard", F.explode(F.array(F.col("vec_id") % 4, (F.col("vec_id") + 1) % 4)))
    return knn.scatter_gather(sharded, _queries(v), K).select("query_id", "vec_id", F.round("distance", 6).alias("distance"), F.col("rank").cast("bigint").alias("rank"))


def recall_at_k(spark, sf_dir):
    """Recall of filtering after the limit against filtering before it, for each query."""
    v = _vectors(spark, sf_dir)
    q, some = _queries(v), v.where(F.col("label") < 5)
    truth = knn.nearest_batched(some, q, K)
    late = knn.nearest_batched(v, q, K).join(some.select("vec_id"), "vec_id", "left_semi")
    return knn.recall_at_k(late, truth).select("query_id", F.round("recall", 6).alias("recall"))


def index_stats(spark, sf_dir):
    nodes = table(spark, sf_dir, "hnsw_node")
    return knn.index_stats(nodes, live=~F.coalesce("is_tombstone", F.lit(False)))


def planner_grid(spark, sf_dir):
    grid = spark.range(0, 7).select(F.element_at(F.array(*map(F.lit, [0, 100, 500, 501, 5000, 50000, 1000000])), (F.col("id") + 1).cast("int")).cast("bigint").alias("row_count"))
    grid = grid.withColumn("memory_bytes", F.explode(F.array(*[F.lit(x).cast("bigint") for x in (0, 5242880, 10485760, 15728640)]))).withColumn("has_disk_index", F.explode(F.array(F.lit(True), F.lit(False))))
    grid = grid.withColumn("filter_rows", F.explode(F.array(*[F.lit(x).cast("bigint") for x in (None, 0, 100, 2000, 40000)])))
    return grid.withColumn("strategy", planner.plan_column(F.col("row_count"), F.col("memory_bytes"), F.col("has_disk_index"), F.col("filter_rows")))


def cost_grid(spark, sf_dir):
    grid = spark.range(1, 8).select(F.pow(F.lit(10.0), F.col("id")).cast("bigint").alias("row_count"))
    grid = grid.withColumn("k", F.explode(F.array(*map(F.lit, [1, 10, 40, 100])))).withColumn("share", F.explode(F.array(*map(F.lit, [0.01, 0.1, 0.5]))))
    grid = grid.withColumn("filter_rows", F.floor(F.col("row_count") * F.col("share")))
    costs = planner.cost_columns(F.col("row_count"), F.col("k"), F.col("filter_rows"))
    long = grid.withColumn("c", F.explode(F.array(*[F.struct(F.lit(s).alias("strategy"), c.cast("double").alias("cost")) for s, c in costs.items()])))
    return long.select("row_count", "k", "filter_rows", "c.strategy", F.round("c.cost", 4).alias("cost"))


def selectivity(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    n = v.count()
    return v.groupBy("label").agg(F.round(planner.selectivity_column(F.count("*"), F.lit(n)), 6).alias("selectivity"))


def centroid(spark, sf_dir):
    return pq.centroid(_vectors(spark, sf_dir)).select("pos", F.round("mean", 9).alias("mean"))


def medoid(spark, sf_dir):
    return _out(pq.medoid(_vectors(spark, sf_dir)))


def kmeans_step(spark, sf_dir):
    """One Lloyd step from the vectors of ids 0 to 7."""
    v = _vectors(spark, sf_dir)
    first = v.where("vec_id < 8").orderBy("vec_id").select("embedding").collect()
    rows = [(c, n, i, x) for c, n, cent in pq.kmeans_step(v, np.array([r[0] for r in first], np.float64)) for i, x in enumerate(cent)]
    return spark.createDataFrame(rows, "c INT, n BIGINT, pos INT, x DOUBLE").select("c", "n", "pos", F.round("x", 6).alias("x"))


def _book(spark, sf_dir) -> pq.Codebook:
    return pq.load_codebook(table(spark, sf_dir, "pq_codebook"), 8)


def pq_encode(spark, sf_dir):
    coded = pq.encode(_vectors(spark, sf_dir), _book(spark, sf_dir))
    return coded.select("vec_id", F.posexplode("codes").alias("s", "c"))


def pq_decode(spark, sf_dir):
    book = _book(spark, sf_dir)
    return pq.decode(pq.encode(_vectors(spark, sf_dir), book), book).select("vec_id", F.posexplode("embedding").alias("pos", "x")).select("vec_id", "pos", F.round("x", 6).alias("x"))


def pq_distance_table(spark, sf_dir):
    book = _book(spark, sf_dir)
    rows = [(s, int(c), float(d)) for s, (codes, ds) in enumerate(zip(book.codes, pq.distance_table(_query(_vectors(spark, sf_dir)), book))) for c, d in zip(codes, ds)]
    return spark.createDataFrame(rows, "s INT, c INT, d DOUBLE").select("s", "c", F.round("d", 6).alias("d"))


def pq_adc(spark, sf_dir):
    v, book = _vectors(spark, sf_dir), _book(spark, sf_dir)
    return pq.adc(pq.encode(v, book), _query(v), book).select("vec_id", F.round("adc", 6).alias("adc"))


def pq_two_stage(spark, sf_dir):
    v, book = _vectors(spark, sf_dir), _book(spark, sf_dir)
    return _out(pq.two_stage(v, pq.encode(v, book), _query(v), book, K))


def pq_rmse(spark, sf_dir):
    return pq.reconstruction_error(_vectors(spark, sf_dir), _book(spark, sf_dir)).select("vec_id", F.round("rmse", 6).alias("rmse"))


def pq_train_rmse(spark, sf_dir):
    """Reconstruction with a codebook trained here: its mean error against that of the mean vector alone."""
    v = _vectors(spark, sf_dir)
    mean = [r["mean"] for r in pq.centroid(v).orderBy("pos").collect()]
    plain = knn.with_distance(v, mean).agg(F.avg(F.col("distance") / len(mean) ** 0.5)).first()[0]
    return pq.reconstruction_error(v, pq.train(v, 8)).agg(F.count("*").alias("n"), (F.avg("rmse") < 0.9 * plain).alias("nearer"))


FLOOR = 0.9


def _recalled(per_query: DataFrame) -> DataFrame:
    return per_query.agg(F.count("*").alias("n_queries"), (F.avg("recall") >= FLOOR).alias("recalled"))


def _sharded(spark, sf_dir) -> DataFrame:
    return _vectors(spark, sf_dir).withColumn("shard", (F.col("vec_id") % 4).cast("int"))


def _stored(spark, sf_dir) -> DataFrame:
    """The valid vectors of the disk graph, each id once."""
    ok = (F.size("embedding") == 64) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return table(spark, sf_dir, "vamana_vector").where(ok & F.col("vec_id").isNotNull()).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def _graph_recall(kind: str, learned: bool = False, **options):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        v = _sharded(spark, sf_dir)
        g = materialize(graph.build(v, kind, **options), "graph")
        entries = materialize(graph.trained_entries(v), "entries") if learned else None
        q = _queries(v)
        return _recalled(knn.recall_at_k(graph.search(v, g, q, K, learned=entries), knn.nearest_batched(v, q, K)))

    return run


def graph_recall_large(spark, sf_dir):
    """Layered graphs over the disk graph's vectors, some 20,000 to a shard."""
    v = materialize(_stored(spark, sf_dir), "vectors")
    shards = max(1, v.count() // 20_000)
    v = v.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    g, q = materialize(graph.build(v, "layered"), "graph"), _queries(v)
    return _recalled(knn.recall_by_distance(graph.search(v, g, q, K), knn.nearest_batched(v, q, K)))


def graph_recall_probed(spark, sf_dir):
    """Flat graphs over shards made by k-means; a query asks half of the shards, those with the nearest centres."""
    v = _stored(spark, sf_dir)
    v = materialize(graph.sharded(v, 4), "vectors")
    g, q = materialize(graph.build(v, "flat"), "graph"), _queries(v)
    centres = materialize(graph.shard_centres(v), "centres")
    return _recalled(knn.recall_by_distance(graph.search(v, g, q, K, centres=centres, probe=2), knn.nearest_batched(v, q, K)))


def graph_filtered(spark, sf_dir):
    """Filtered graph search: rows of other labels are walked through, but not returned."""
    v = _sharded(spark, sf_dir)
    g = materialize(graph.build(v, "layered"), "graph")
    ok = v.where(F.col("label") < 5)
    return _recalled(knn.recall_at_k(graph.search(v, g, _queries(v), K, allowed=ok), knn.nearest_batched(ok, _queries(v), K)))


def planned_search(spark, sf_dir):
    """Filter and radius under each strategy's exact form, with the strategy that the planner would choose."""
    v = _vectors(spark, sf_dir)
    q = execute.Query(_query(v), K, 1.25, v.where(F.col("label") == LABEL).select("vec_id"))
    stats, out = planner.refreshed(v, 64), None
    chosen = planner.plan(stats, q.ids.count())
    for s in (planner.BRUTE, planner.PRE, planner.POST, planner.DISK):
        one = _out(execute.run(s, v, q, stats)).select(F.lit(s).alias("strategy"), F.lit(s == chosen).alias("chosen"), "vec_id", "distance")
        out = one if out is None else out.unionByName(one)
    return out


def disk_index(spark, sf_dir):
    """A disk index built, opened and asked: recall of the walk by codes, its range search, and that it cannot be changed."""
    v, path = _sharded(spark, sf_dir), job_dir(spark, "index")
    DiskIndex.build(v, path)
    ix, q = DiskIndex(spark, path), _queries(v)
    found = _recalled(knn.recall_at_k(ix.search_beam(q, K), knn.nearest_batched(v, q, K)))
    try:
        ix.insert(0, _query(v))
        fixed = False
    except ReadOnlyIndex:
        fixed = True
    return found.withColumns({"n_in_range": F.lit(ix.search_range(_query(v), 1.25).count()), "n_vectors": F.lit(ix.stats()["num_vectors"]), "fixed": F.lit(fixed)})


def planned_search_indexed(spark, sf_dir):
    """The same by way of a graph and a disk index, both built here: graph strategies walk, the disk strategy
    searches codes. Approximate, so for each strategy: the planner's choice given the disk index, and whether at least
    0.8 of the exact rows were found."""
    v = _sharded(spark, sf_dir)
    q = execute.Query(_query(v), K, 1.25, v.where(F.col("label") == LABEL).select("vec_id"))
    links, disk = materialize(graph.build(v, "layered"), "graph"), DiskIndex.build(v, job_dir(spark, "index"))
    stats, rows = planner.refreshed(v, 64, has_disk_index=True), []
    chosen = planner.plan(stats, q.ids.count())
    for s in (planner.BRUTE, planner.PRE, planner.POST, planner.DISK):
        exact = {r.vec_id for r in execute.run(s, v, q, stats).collect()}  # at most K rows each
        found = {r.vec_id for r in execute.run(s, v, q, stats, links, disk).collect()}
        rows.append((s, s == chosen, len(exact & found) >= 0.8 * len(exact)))
    return spark.createDataFrame(rows, "strategy STRING, chosen BOOLEAN, recalled BOOLEAN")


def planned_search_learned(spark, sf_dir):
    """The learned strategy: with a radius, which comes after the limit, and with a filter, where it is the plain walk."""
    v = _sharded(spark, sf_dir)
    links, entries, stats = materialize(graph.build(v, "layered"), "graph"), materialize(graph.trained_entries(v), "entries"), planner.refreshed(v, 64)
    some = v.where(F.col("label") == LABEL).select("vec_id")
    run = lambda strategy, q, g=None: {r.vec_id for r in execute.run(strategy, v, q, stats, g, learned=entries).collect()}  # noqa: E731 (at most K rows)
    late, within = execute.Query(_query(v), K, 1.25), execute.Query(_query(v), K, None, some)
    exact, found = run(planner.LEARNED, late), run(planner.LEARNED, late, links)
    same = run(planner.LEARNED, within, links) == run(planner.GRAPH, within, links)
    return spark.createDataFrame([(len(exact), len(exact & found) >= 0.8 * len(exact) and found <= run(planner.LEARNED, execute.Query(_query(v), 10 * K, 1.25)), same)], "n_exact BIGINT, recalled BOOLEAN, plain_if_filtered BOOLEAN")


def graph_inserted(spark, sf_dir):
    """Recall after half of the vectors were inserted into graphs of the other half; and the vectors that are linked."""
    v = _sharded(spark, sf_dir)
    half = v.where("vec_id % 8 < 4")
    g = materialize(graph.insert(half, materialize(graph.build(half, "layered"), "graph"), v), "graph")
    found = _recalled(knn.recall_at_k(graph.search(v, g, _queries(v), K), knn.nearest_batched(v, _queries(v), K)))
    return found.withColumn("n_linked", F.lit(g.where("layer = 0").count()))


def robust_prune(spark, sf_dir):
    """What pruning keeps of the 32 nearest of every vector."""
    return graph.prune_nearest(_vectors(spark, sf_dir))


QUERIES = {
    **{f"dist_{m}": _distances(m) for m in METRICS},
    **{f.__name__: f for f in (knn_exact, knn_radius, knn_filtered, knn_filtered_radius, knn_batched, range_search, knn_prefilter_radius_late,
                               knn_postfilter_overfetch, knn_limit_then_filter, knn_deleted, knn_scatter_gather, recall_at_k, index_stats, planner_grid,
                               cost_grid, selectivity, centroid, medoid, kmeans_step, pq_encode, pq_decode, pq_distance_table, pq_adc, pq_two_stage, pq_rmse,
                               pq_train_rmse, graph_filtered, graph_inserted, planned_search, planned_search_indexed, planned_search_learned, robust_prune)},
    **{f.__name__: f for f in (graph_recall_large, graph_recall_probed, disk_index)},
    "graph_recall_hnsw": _graph_recall("layered"),
    "graph_recall_vamana": _graph_recall("flat"),
    "graph_recall_learned": _graph_recall("layered", learned=True),
}

_V = "v AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings), q AS (SELECT e AS qe FROM v WHERE vec_id = 0), d AS (SELECT vec_id, label, list_distance(e, qe) AS dist FROM v, q)"
_TOP = "SELECT vec_id, round(dist, 6) AS distance FROM ({}) ORDER BY dist, vec_id LIMIT {}"
_B = f"WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings), p AS (SELECT a.vec_id AS query_id, b.vec_id, b.label, list_distance(a.e, b.e) AS dist FROM v a, v b WHERE a.vec_id % 20 = 0), best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS rank FROM p QUALIFY rank <= {K})"
_BOOK = "book AS (SELECT s, c, min(centroid::DOUBLE[]) AS e FROM pq_codebook WHERE len(centroid) = 8 AND s IS NOT NULL AND c IS NOT NULL AND len(list_filter(centroid, lambda x: x IS NOT NULL AND isfinite(x))) = 8 GROUP BY s, c)"
_CODES = f"v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), {_BOOK}, codes AS (SELECT vec_id, s, arg_min(c, (list_distance(e[s*8+1:s*8+8], b), c)) AS c FROM v, (SELECT s, c, e AS b FROM book) GROUP BY vec_id, s)"
_ADC = f"{_CODES}, q AS (SELECT e AS qe FROM v WHERE vec_id = 0), t AS (SELECT s, c, list_distance(qe[s*8+1:s*8+8], e) AS d FROM q, book), adc AS (SELECT vec_id, sum(d) AS adc FROM codes JOIN t USING (s, c) GROUP BY vec_id)"
_DECODED = f"{_CODES}, dec AS (SELECT vec_id, s, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM codes JOIN book USING (s, c))"
_STRATEGY = "CASE WHEN row_count <= 500 THEN 'BruteForceScan' WHEN memory_bytes > 10485760 AND has_disk_index THEN 'OutofCoreVamana' WHEN filter_rows IS NOT NULL AND sel < 0.25 THEN 'PrefilterGraph' WHEN filter_rows IS NOT NULL THEN 'PostfilterGraph' ELSE 'InMemoryHnsw' END"

ORACLE = {
    "dist_l2": f"WITH {_V} SELECT vec_id, round(dist, 6) AS distance FROM d",
    "dist_dot": f"WITH {_V} SELECT vec_id, round(list_inner_product(e, qe), 6) AS distance FROM v, q",
    "dist_l1": f"WITH {_V} SELECT vec_id, round(list_sum(list_transform(list_zip(e, qe), lambda x: abs(x[1] - x[2]))), 6) AS distance FROM v, q",
    "dist_cosine": f"WITH {_V} SELECT vec_id, round(greatest(0, list_cosine_distance(e, qe)), 6) AS distance FROM v, q",
    "knn_exact": f"WITH {_V} " + _TOP.format("SELECT * FROM d", K),
    "knn_radius": f"WITH {_V} " + _TOP.format(f"SELECT * FROM d WHERE dist <= {RADIUS}", K),
    "knn_filtered": f"WITH {_V} " + _TOP.format(f"SELECT * FROM d WHERE label = {LABEL}", K),
    "knn_filtered_radius": f"WITH {_V} " + _TOP.format(f"SELECT * FROM d WHERE label = {LABEL} AND dist <= 1.3", K),
    "knn_batched": f"{_B} SELECT query_id, vec_id, round(dist, 6) AS distance, rank FROM best",
    "range_search": f"WITH {_V} SELECT vec_id, round(dist, 6) AS distance FROM d WHERE dist <= 1.25",
    "knn_prefilter_radius_late": f"WITH {_V} SELECT vec_id, round(dist, 6) AS distance FROM (SELECT * FROM d WHERE label = {LABEL} ORDER BY dist, vec_id LIMIT {K}) WHERE dist <= 1.25",
    "knn_postfilter_overfetch": f"WITH {_V}, n AS (SELECT least(greatest(floor({K} / greatest((SELECT count(*) FROM v WHERE label = {LABEL}) / (SELECT count(*) FROM v), 0.01)), {K}), (SELECT count(*) FROM v)) AS many) " + _TOP.format(f"SELECT * FROM (SELECT *, row_number() OVER (ORDER BY dist, vec_id) AS rn FROM d) WHERE rn <= (SELECT many FROM n) AND label = {LABEL}", K),
    "knn_limit_then_filter": f"WITH {_V} SELECT vec_id, round(dist, 6) AS distance FROM (SELECT * FROM d ORDER BY dist, vec_id LIMIT 50) WHERE label = {LABEL}",
    "knn_deleted": f"WITH {_V} " + _TOP.format("SELECT * FROM d WHERE vec_id NOT IN (SELECT vec_id FROM v WHERE label = 9)", K),
    "knn_scatter_gather": f"""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
sharded AS (SELECT *, vec_id % 4 AS shard FROM v UNION ALL SELECT *, (vec_id + 1) % 4 FROM v),
local AS (SELECT a.vec_id AS query_id, b.vec_id, list_distance(a.e, b.e) AS dist FROM v a, sharded b WHERE a.vec_id % 20 = 0
  QUALIFY row_number() OVER (PARTITION BY query_id, shard ORDER BY dist, b.vec_id) <= {K})
SELECT query_id, vec_id, round(dist, 6) AS distance, row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS rank
FROM (SELECT DISTINCT query_id, vec_id, dist FROM local) QUALIFY rank <= {K}""",
    "recall_at_k": f"{_B}, truth AS (SELECT * FROM p WHERE label < 5 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) <= {K}) SELECT t.query_id, round(count(b.vec_id) / count(*), 6) AS recall FROM truth t LEFT JOIN (SELECT * FROM best WHERE label < 5) b ON t.query_id = b.query_id AND t.vec_id = b.vec_id GROUP BY t.query_id",
    "index_stats": "SELECT count(*) AS n_stored, count(*) FILTER (WHERE NOT coalesce(is_tombstone, false)) AS n_live, coalesce(sum(4 * len(vector) + 16), 0)::BIGINT AS memory_bytes FROM hnsw_node",
    "planner_grid": f"""WITH g AS (SELECT *, CASE WHEN filter_rows IS NULL THEN 1.0 WHEN row_count = 0 THEN 0.0 ELSE greatest(0.0, least(1.0, filter_rows / row_count)) END AS sel
FROM (SELECT unnest([0, 100, 500, 501, 5000, 50000, 1000000])::BIGINT AS row_count), (SELECT unnest([0, 5242880, 10485760, 15728640])::BIGINT AS memory_bytes),
(SELECT unnest([true, false]) AS has_disk_index), (SELECT unnest([NULL, 0, 100, 2000, 40000])::BIGINT AS filter_rows))
SELECT row_count, memory_bytes, has_disk_index, filter_rows, {_STRATEGY} AS strategy FROM g""",
    "cost_grid": """WITH g AS (SELECT *, floor(row_count * share)::BIGINT AS filter_rows FROM (SELECT unnest([10, 100, 1000, 10000, 100000, 1000000, 10000000])::BIGINT AS row_count),
(SELECT unnest([1, 10, 40, 100]) AS k), (SELECT unnest([0.01, 0.1, 0.5])::DOUBLE AS share)), s AS (SELECT *, filter_rows / row_count AS sel, ln(row_count::DOUBLE) + 1 AS depth FROM g)
SELECT row_count, k, filter_rows, strategy, round(cost, 4) AS cost FROM (
SELECT *, 'BruteForceScan' AS strategy, row_count::DOUBLE AS cost FROM s UNION ALL SELECT *, 'InMemoryHnsw', depth * greatest(2 * k, 64) * 1.5 FROM s
UNION ALL SELECT *, 'OutofCoreVamana', depth * greatest(3 * k, 64) * 4 FROM s
UNION ALL SELECT *, 'PrefilterGraph', depth * k * 2 * CASE WHEN sel < 0.05 THEN 8.0::DOUBLE ELSE 2 / (sel + 0.1::DOUBLE) END FROM s
UNION ALL SELECT *, 'PostfilterGraph', depth * least(k / greatest(sel, 0.001::DOUBLE), row_count::DOUBLE) * 1.5 FROM s)""",
    "planned_search": f"""WITH {_V}, n AS (SELECT (SELECT count(*) FROM v) AS n, (SELECT count(*) FROM v WHERE label = {LABEL}) AS m),
r AS (SELECT *, row_number() OVER (ORDER BY dist, vec_id) AS rn, row_number() OVER (PARTITION BY label ORDER BY dist, vec_id) AS rl FROM d),
h AS (SELECT r.*, least(greatest(floor({K} / greatest(m / n, 0.01)), {K}), n) AS many FROM r, n WHERE label = {LABEL} AND dist <= 1.25),
c AS (SELECT CASE WHEN n <= 500 THEN 'BruteForceScan' WHEN m / n < 0.25 THEN 'PrefilterGraph' ELSE 'PostfilterGraph' END AS c FROM n),
s AS (SELECT 'BruteForceScan' AS strategy, vec_id, dist FROM h QUALIFY row_number() OVER (ORDER BY dist, vec_id) <= {K}
UNION ALL SELECT 'PrefilterGraph', vec_id, dist FROM h WHERE rl <= {K}
UNION ALL SELECT 'PostfilterGraph', vec_id, dist FROM h WHERE rn <= many AND rl <= {K}
UNION ALL SELECT 'OutofCoreVamana', vec_id, dist FROM h WHERE rn <= {K})
SELECT strategy, strategy = c AS chosen, vec_id, round(dist, 6) AS distance FROM s, c""",
    "selectivity": "SELECT label, round(count(*) / (SELECT count(*) FROM embeddings), 6) AS selectivity FROM embeddings GROUP BY label",
    "centroid": "SELECT (i - 1)::INT AS pos, round(avg(x::DOUBLE), 9) AS mean FROM (SELECT unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY i",
    "medoid": "WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), m AS (SELECT list(x ORDER BY i) AS me FROM (SELECT i, avg(x) AS x FROM (SELECT unnest(e) AS x, generate_subscripts(e, 1) AS i FROM v) GROUP BY i)) SELECT vec_id, round(list_distance(e, me), 6) AS distance FROM v, m ORDER BY list_distance(e, me), vec_id LIMIT 1",
    "kmeans_step": "WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), near AS (SELECT v.vec_id, arg_min(c.vec_id, (list_distance(v.e, c.e), c.vec_id)) AS c, any_value(v.e) AS e FROM v, v c WHERE c.vec_id < 8 GROUP BY v.vec_id) SELECT c::INT AS c, count(*) AS n, (i - 1)::INT AS pos, round(avg(x), 6) AS x FROM (SELECT c, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM near) GROUP BY c, i",
    "pq_encode": f"WITH {_CODES} SELECT vec_id, s, c FROM codes",
    "pq_decode": f"WITH {_DECODED} SELECT vec_id, (s * 8 + i - 1)::INT AS pos, round(x, 6) AS x FROM dec",
    "pq_distance_table": f"WITH {_BOOK}, q AS (SELECT embedding::DOUBLE[] AS qe FROM embeddings WHERE vec_id = 0) SELECT s, c, round(list_distance(qe[s*8+1:s*8+8], e), 6) AS d FROM q, book",
    "pq_adc": f"WITH {_ADC} SELECT vec_id, round(adc, 6) AS adc FROM adc",
    "pq_two_stage": f"WITH {_ADC} SELECT vec_id, round(dist, 6) AS distance FROM (SELECT v.vec_id, list_distance(e, qe) AS dist FROM v, q WHERE v.vec_id IN (SELECT vec_id FROM adc ORDER BY adc, vec_id LIMIT {10 * K})) ORDER BY dist, vec_id LIMIT {K}",
    **{name: "SELECT count(*) AS n_queries, true AS recalled FROM embeddings WHERE vec_id % 20 = 0" for name in ("graph_recall_hnsw", "graph_recall_vamana", "graph_recall_learned", "graph_filtered")},
    **{name: "SELECT count(DISTINCT vec_id) AS n_queries, true AS recalled FROM vamana_vector WHERE vec_id % 20 = 0 AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64" for name in ("graph_recall_large", "graph_recall_probed")},
    "disk_index": f"WITH {_V} SELECT count(*) FILTER (WHERE vec_id % 20 = 0) AS n_queries, true AS recalled, count(*) FILTER (WHERE dist <= 1.25) AS n_in_range, count(*) AS n_vectors, true AS fixed FROM d",
    "graph_inserted": "SELECT count(*) FILTER (WHERE vec_id % 20 = 0) AS n_queries, true AS recalled, count(*) AS n_linked FROM embeddings",
    "pq_train_rmse": "SELECT count(*) AS n, true AS nearer FROM embeddings",
    "planned_search_indexed": f"""WITH n AS (SELECT count(*) AS n, count(*) FILTER (WHERE label = {LABEL}) AS m FROM embeddings),
c AS (SELECT CASE WHEN n <= 500 THEN 'BruteForceScan' WHEN n * (4 * 64 + 16) > 10485760 THEN 'OutofCoreVamana' WHEN m / n < 0.25 THEN 'PrefilterGraph' ELSE 'PostfilterGraph' END AS c FROM n)
SELECT s AS strategy, s = c AS chosen, true AS recalled FROM c, (SELECT unnest(['BruteForceScan', 'PrefilterGraph', 'PostfilterGraph', 'OutofCoreVamana']) AS s)""",
    "planned_search_learned": f"WITH {_V} SELECT count(*) FILTER (WHERE dist <= 1.25) AS n_exact, true AS recalled, true AS plain_if_filtered FROM (SELECT * FROM d ORDER BY dist, vec_id LIMIT {K})",
    "robust_prune": """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
near AS (SELECT a.vec_id, b.vec_id AS c, b.e, list_distance(a.e, b.e) AS d FROM v a JOIN v b ON a.vec_id <> b.vec_id QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY d, b.vec_id) <= 32),
met AS (SELECT vec_id, list([{'c': c, 'e': e, 'd': d}] ORDER BY d, c) AS met FROM near GROUP BY vec_id),
kept AS (SELECT vec_id, list_reduce(met, lambda k, x: CASE WHEN len(k) < 16 AND len(list_filter(k, lambda y: 1.2::DOUBLE * list_distance(y.e, x[1].e) <= x[1].d)) = 0 THEN list_concat(k, x) ELSE k END) AS k FROM met)
SELECT vec_id, list_transform(k, lambda y: y.c) AS kept FROM kept""",
    "pq_rmse": f"WITH {_DECODED} SELECT vec_id, round(sqrt(sum((x - e[s * 8 + i]) ** 2) / 64), 6) AS rmse FROM dec JOIN v USING (vec_id) GROUP BY vec_id",
}
