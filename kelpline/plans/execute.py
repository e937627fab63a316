"""Plans a query from a table's statistics, and runs the strategy that was chosen."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpline.operators import graph, knn
from kelpline.plans import planner
from kelpline.sources.index_files import DiskIndex


@dataclass
class Query:
    vector: list[float]
    k: int
    radius: float | None = None
    ids: DataFrame | None = None


def _one(q: Query, vectors: DataFrame) -> DataFrame:
    return vectors.sparkSession.createDataFrame([(0, [float(x) for x in q.vector])], "query_id BIGINT, vector ARRAY<FLOAT>")


def _late_radius(found: DataFrame, q: Query) -> DataFrame:
    return found if q.radius is None else found.where(F.col("distance") <= q.radius)


def run(strategy: str, vectors: DataFrame, q: Query, stats: planner.Stats, links: DataFrame | None = None, disk: DiskIndex | None = None, learned: DataFrame | None = None) -> DataFrame:
    """``vec_id, distance`` by one strategy. Graph strategies walk ``links`` (over ``vectors`` with a shard);
    without it they are answered exactly, under the same order of filter, limit and radius. ``learned`` are the
    trained entries; a filtered search doesn't use them."""
    if strategy == planner.BRUTE:
        return knn.nearest(vectors, q.vector, q.k, q.radius, q.ids)
    if strategy == planner.DISK:
        if disk is None:
            return knn.nearest_then_filter(vectors, q.vector, q.k, vectors if q.ids is None else q.ids, q.radius)
        return disk.search(q.vector, q.k, ids=q.ids, radius=q.radius)
    if strategy == planner.POST and q.ids is not None:
        fetch = knn.overfetch(q.k, stats.selectivity(q.ids.select("vec_id").distinct().count()), stats.row_count)
        if links is None:
            return knn.nearest_postfiltered(vectors, q.vector, q.k, q.ids, fetch, q.radius)
        found = graph.search(vectors, links, _one(q, vectors), fetch).select("vec_id", "distance").join(q.ids.select("vec_id").distinct(), "vec_id", "left_semi")
        return _late_radius(found, q).orderBy("distance", "vec_id").limit(q.k)
    if links is None:
        return _late_radius(knn.nearest(vectors, q.vector, q.k, ids=q.ids), q)
    found = graph.search(vectors, links, _one(q, vectors), q.k, allowed=q.ids, learned=learned if strategy == planner.LEARNED and q.ids is None else None)
    return _late_radius(found.select("vec_id", "distance"), q)


def search(vectors: DataFrame, q: Query, stats: planner.Stats, links: DataFrame | None = None, disk: DiskIndex | None = None) -> tuple[str, DataFrame]:
    """(the strategy chosen, its result)."""
    n = None if q.ids is None else q.ids.select("vec_id").distinct().count()
    strategy = planner.plan(stats, n)
    return strategy, run(strategy, vectors, q, stats, links, disk)
