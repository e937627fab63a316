import numpy as np
import pytest
from pyspark.sql import functions as F

from kelpline.llm import multi_index as M

DIM = 8


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "clash") for i, v in rows], "vec_id BIGINT, vector ARRAY<FLOAT>, cell STRING")


def queries(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], "query_id BIGINT, vector ARRAY<FLOAT>, k INT, radius FLOAT, shard STRING")


def brute(rows, q, k):
    best = sorted((float(((np.float64(np.float32(v)) - np.float64(np.float32(q))) ** 2).sum()), i) for i, v in rows)
    return [i for _, i in best[:k]]


def clusters(n, seed=0):
    r = np.random.default_rng(seed)
    centres = r.normal(0, 2, (12, DIM))
    return [(i, (centres[i % 12] + r.normal(0, 0.1, DIM)).astype(np.float32).tolist()) for i in range(n)]


def test_walk_is_in_order_and_complete():
    r = np.random.default_rng(1)
    d1, d2 = r.random(7), r.random(5)
    counts = r.integers(0, 3, (7, 5)).tolist()
    got = M.walk(d1, d2, counts, 10**9, 10**9)
    assert len(got) == len(set(got)) == sum(c > 0 for row in counts for c in row)
    sums = [d1[i] + d2[j] for i, j in got]
    assert sums == sorted(sums)


def test_recall_and_hot_cells(spark, monkeypatch):
    monkeypatch.setattr(M, "PIECE_ROWS", 40)
    monkeypatch.setattr(M, "SHARD_ROWS", 100)
    monkeypatch.setattr(M, "SHARD_QUERIES", 5)
    rows = clusters(500) + [(1000 + i, [3.0] * DIM) for i in range(300)]  # copies hold over a third
    v = vectors(spark, rows)
    ix = M.build(M.collection([v], DIM), DIM, M.sampled([v], DIM))
    assert ix.n_shards > 3
    asked = [(i, rows[i * 20][1], 10, None) for i in range(25)] + [(50, [3.0] * DIM, 7, None)]
    got = {}
    for r in M.search(ix, M.valid_queries(queries(spark, asked), DIM), 64, 8).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got[50] == list(range(1000, 1007))  # ties go to the smaller ids
    hits = sum(len(set(got[q]) & set(brute(rows, v, k))) for q, v, k, _ in asked)
    assert hits / sum(k for _, _, k, _ in asked) >= 0.95


def test_brute_force_agrees(spark):
    rows = clusters(120)
    c = M.collection([vectors(spark, rows)], DIM)
    q = M.valid_queries(queries(spark, [(1, rows[5][1], 6, None), (2, [0.0] * DIM, 300, None)]), DIM)
    got = {}
    for r in M.brute_force(c, q, DIM).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {1: brute(rows, rows[5][1], 6), 2: brute(rows, [0.0] * DIM, 300)}


def test_dirty_rows(spark):
    nan, good = float("nan"), [1.0] * DIM
    rows = [(1, good), (1, good), (2, good), (3, None), (4, []), (5, good[:-1]), (6, [nan] + good[1:]), (7, [None] + good[1:]), (8, [float("inf")] + good[1:]), (9, good), (None, good)]
    dead = spark.createDataFrame([(9,), (None,), (77,)], "vec_id BIGINT")
    c = M.collection([vectors(spark, rows), vectors(spark, [(2, good)])], DIM, dead)
    assert sorted(r.vec_id for r in c.collect()) == [1, 2]
    q = M.valid_queries(queries(spark, [(1, good, 5, None), (1, good, 5, None), (2, good, None, None), (3, good, 0, None), (4, None, 3, None), (5, [2.0] * DIM, 1, 0.5), (None, good, 1, None)]), DIM)
    found = M.within_radius(M.search(M.build(c, DIM, M.sampled([vectors(spark, rows)], DIM)), q), q)
    assert sorted((r.query_id, r.vec_id) for r in found.collect()) == [(1, 1), (1, 2)]


@pytest.mark.parametrize("n", [0, 1])
def test_tiny(spark, n):
    v = vectors(spark, clusters(n))
    c = M.collection([v], DIM)
    q = M.valid_queries(queries(spark, [(1, [0.0] * DIM, 3, None)]), DIM)
    ix = M.build(c, DIM, M.sampled([v], DIM))
    assert M.search(ix, q).count() == n
    assert M.search(ix, q.where(F.lit(False))).count() == 0


def test_ties_over_cells_go_to_the_smaller_id(spark):
    """All vectors are as far from the query, but lie in cells whose order isn't that of the ids."""
    r = np.random.default_rng(2)
    x = np.eye(DIM)[r.integers(0, DIM, 400)] * r.choice([-1, 1], 400)[:, None]
    v = vectors(spark, [(i, row.tolist()) for i, row in enumerate(x)])
    ix = M.build(M.collection([v], DIM), DIM, (4000, x.astype(np.float32)))
    assert ix.counts.size > 9
    q = M.valid_queries(queries(spark, [(1, [0.0] * DIM, 30, None)]), DIM)
    assert sorted(r.vec_id for r in M.search(ix, q).collect()) == list(range(30))


def test_sample_without_valid_rows(spark):
    v = vectors(spark, clusters(20))
    ix = M.build(M.collection([v], DIM), DIM, (10**6, np.zeros((0, DIM), np.float32)))
    q = M.valid_queries(queries(spark, [(1, [0.0] * DIM, 30, None)]), DIM)
    assert M.search(ix, q).count() == 20


def test_sample_is_fixed(spark, monkeypatch):
    monkeypatch.setattr(M, "SAMPLE", 50)
    v = vectors(spark, clusters(3000))
    n, a = M.sampled([v, v.limit(0)], DIM)
    assert n == 3000 and len(a) == 16 * M.centroids_for(3000) == 144
    assert (M.sampled([v.repartition(5), v], DIM)[1][:0] == a[:0]).all() and (M.sampled([v.repartition(7).orderBy("cell"), v.limit(0)], DIM)[1] == a).all()
