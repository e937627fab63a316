"""Nearest-neighbour queries over ``vec_id, embedding``: exact, batched, filtered before or after the limit.

Distances are computed by numpy on Arrow batches, in double precision; what follows is Spark's top-k.
Results are ordered by distance, then vec_id. A vector whose length differs from the query's raises.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpline.session import job_dir

QUERY_BLOCK = 2048
PAIR_BLOCK = 1 << 22
#: Vectors that meet all queries together.
VECTOR_BLOCK = 1 << 17


def matrix(lists: pa.Array, dim: int | None = None) -> np.ndarray:
    """A list<float> column without nulls as a double matrix; unequal lengths raise."""
    if len(lists) == 0:
        return np.zeros((0, dim or 0))
    lengths = np.asarray(lists.value_lengths())
    want = dim if dim is not None else lengths[0]
    if lists.null_count or (lengths != want).any():
        raise ValueError(f"dimension mismatch: expected {want}, got {sorted(set(lengths.tolist()))[:3]}")
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, want)


def with_distance(vectors: DataFrame, query: list[float]) -> DataFrame:
    """``vec_id, distance`` to one query vector (L2)."""
    q = np.asarray(query, np.float64)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = np.sqrt(((matrix(b.column(1), len(q)) - q) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(d)], names=["vec_id", "distance"])

    return vectors.select("vec_id", "embedding").mapInArrow(run, "vec_id BIGINT, distance DOUBLE")


def ranked(found: DataFrame) -> DataFrame:
    """Adds ``rank``; for results of at most k rows."""
    return found.withColumn("rank", F.row_number().over(Window.orderBy("distance", "vec_id")))


def nearest(vectors: DataFrame, query: list[float], k: int, radius: float | None = None, ids: DataFrame | None = None, where: Column | None = None) -> DataFrame:
    """Exact k nearest. Filters (an id set to keep, a predicate) and the radius come before the limit."""
    if where is not None:
        vectors = vectors.where(where)
    if ids is not None:
        vectors = vectors.join(ids.select("vec_id").distinct(), "vec_id", "left_semi")
    found = with_distance(vectors, query)
    if radius is not None:
        found = found.where(F.col("distance") <= radius)
    return found.orderBy("distance", "vec_id").limit(k)


def nearest_then_radius(vectors: DataFrame, query: list[float], k: int, radius: float, where: Column | None = None) -> DataFrame:
    """The k nearest of the filtered rows, of which those within the radius: the radius comes after the limit."""
    return nearest(vectors, query, k, where=where).where(F.col("distance") <= radius)


def overfetch(k: int, selectivity: float, n_rows: int) -> int:
    return min(max(math.floor(k / max(selectivity, 0.01)), k), n_rows)


def nearest_postfiltered(vectors: DataFrame, query: list[float], k: int, ids: DataFrame, fetch: int, radius: float | None = None) -> DataFrame:
    """Fetch more than k, then filter by ids and radius, then cut to k; may give fewer than k."""
    found = nearest(vectors, query, fetch).join(ids.select("vec_id").distinct(), "vec_id", "left_semi")
    if radius is not None:
        found = found.where(F.col("distance") <= radius)
    return found.orderBy("distance", "vec_id").limit(k)


def nearest_then_filter(vectors: DataFrame, query: list[float], k: int, ids: DataFrame, radius: float | None = None) -> DataFrame:
    """The k nearest of all, of which those in the id set (and radius): often far fewer than k."""
    return nearest_postfiltered(vectors, query, k, ids, k, radius)


def within(vectors: DataFrame, query: list[float], radius: float) -> DataFrame:
    return with_distance(vectors, query).where(F.col("distance") <= radius)


def without(vectors: DataFrame, deleted: DataFrame) -> DataFrame:
    """Rows whose id isn't deleted."""
    return vectors.join(deleted.select("vec_id").distinct(), "vec_id", "left_anti")


def _best(qi: np.ndarray, ids: np.ndarray, d: np.ndarray, k: int) -> np.ndarray:
    order = np.lexsort((ids, d, qi))
    q = qi[order]
    start = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, int)
    rank = np.arange(len(q)) - np.repeat(start, np.diff(np.r_[start, len(q)]))
    return order[rank < k]


def nearest_batched(vectors: DataFrame, queries: DataFrame, k: int, radius: float | None = None, group: str | None = None) -> DataFrame:
    """The k nearest of ``vec_id, embedding`` for each of ``query_id, vector``.

    VECTOR_BLOCK vectors of a task at a time meet the queries block by block; the queries are written to the shared
    folder once and read by each task, so their number isn't bounded by a broadcast. Each block sends at most k
    rows a query. ``group``: a column of ``vectors``; the k nearest are then found within each group.
    """
    path = job_dir(vectors.sparkSession, "queries")
    queries.select("query_id", "vector").write.parquet(path)
    cols = ["vec_id", "embedding", *([group] if group else [])]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        fs, base = pafs.FileSystem.from_uri(path)
        files = sorted(f.path for f in fs.get_file_info(pafs.FileSelector(base)) if f.path.endswith(".parquet"))
        for part in _blocks(batches):
            x = np.concatenate([matrix(b.column(1)) for b in part])
            ids = np.concatenate([b.column(0).to_numpy() for b in part])
            g = np.concatenate([b.column(2).to_numpy(zero_copy_only=False) for b in part]) if group else np.zeros(len(ids), np.int64)
            for f in files:
                with fs.open_input_file(f) as h:
                    for qb in pq.ParquetFile(h).iter_batches(QUERY_BLOCK):
                        q, qid = matrix(qb.column(1), x.shape[1]), qb.column(0).to_numpy()
                        for value in np.unique(g):
                            rows = np.flatnonzero(g == value)
                            step = max(1, PAIR_BLOCK // len(rows))
                            for s in range(0, len(q), step):
                                yield from _block(x[rows], ids[rows], q[s : s + step], qid[s : s + step], k, radius, value)

    def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
        part, n = [], 0
        for b in batches:
            if b.num_rows:
                part.append(b)
                n += b.num_rows
            if n >= VECTOR_BLOCK:
                yield part
                part, n = [], 0
        if part:
            yield part

    def _block(x, ids, q, qid, k, radius, value):
        d2 = (q * q).sum(1)[:, None] + (x * x).sum(1)[None] - 2 * q @ x.T
        limit = np.partition(d2, k - 1, axis=1)[:, k - 1] + 1e-9 if len(x) > k else np.full(len(q), np.inf)
        if radius is not None:
            limit = np.minimum(limit, radius * radius + 1e-9)
        a, c = np.nonzero(d2 <= limit[:, None])
        d = np.sqrt(((q[a] - x[c]) ** 2).sum(1))
        keep = _best(a, ids[c], d, k)
        yield pa.RecordBatch.from_pydict({"query_id": pa.array(qid[a[keep]], pa.int64()), "vec_id": pa.array(ids[c[keep]], pa.int64()), "distance": pa.array(d[keep]), "grp": pa.array(np.full(len(keep), int(value)), pa.int64())})

    found = vectors.select(*cols).mapInArrow(run, "query_id BIGINT, vec_id BIGINT, distance DOUBLE, grp BIGINT")
    if radius is not None:
        found = found.where(F.col("distance") <= radius)
    return top_k(found, ["query_id", "grp"] if group else ["query_id"], k)


def top_k(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("distance", "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def scatter_gather(sharded: DataFrame, queries: DataFrame, k: int, shard: str = "shard") -> DataFrame:
    """The k nearest within each shard, then over all: an id stored in several shards counts once."""
    local = nearest_batched(sharded, queries, k, group=shard)
    once = local.groupBy("query_id", "vec_id").agg(F.min("distance").alias("distance"))
    return top_k(once, ["query_id"], k)


def recall_at_k(found: DataFrame, truth: DataFrame) -> DataFrame:
    """Per query: the share of the true ids that were found."""
    f = found.select("query_id", "vec_id").distinct().withColumn("hit", F.lit(1))
    return truth.select("query_id", "vec_id").distinct().join(f, ["query_id", "vec_id"], "left").groupBy("query_id").agg(
        (F.count("hit") / F.count("*")).alias("recall"))


def recall_by_distance(found: DataFrame, truth: DataFrame) -> DataFrame:
    """Per query: how many rows were found that are no farther than the farthest true one, over the true ones. Unlike
    ``recall_at_k``, equal vectors under other ids count."""
    far = truth.groupBy("query_id").agg(F.max("distance").alias("far"), F.count("*").alias("n"))
    near = far.join(found.select("query_id", "vec_id", "distance").distinct(), "query_id", "left")
    return near.groupBy("query_id").agg((F.count_if(F.col("distance") <= F.col("far") + 1e-9) / F.max("n")).alias("recall"))


def index_stats(nodes: DataFrame, vector: str = "vector", live: Column | None = None) -> DataFrame:
    """One row: stored and live vectors, and bytes at 4 a dimension plus 16 a vector."""
    live = F.lit(True) if live is None else live
    return nodes.agg(
        F.count("*").alias("n_stored"), F.count_if(live).alias("n_live"),
        F.coalesce(F.sum(F.when(F.col(vector).isNotNull(), F.size(vector) * 4 + 16)), F.lit(0)).cast("bigint").alias("memory_bytes"))
