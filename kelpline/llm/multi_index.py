"""The k nearest stored vectors of every query, by an inverted multi-index.

Each vector is cut into two halves, and each half is quantised by its own codebook of K centroids; a
cell is a pair of centroids, so K * K cells come from 2 * K centroids. A query computes its distance
to the centroids of both halves and walks the cells in order of the sum of squared distances, with
a heap over the two sorted lists, until it has met enough entries and enough filled cells. The
entries of those cells are reranked by exact distance in double precision.

Cells are laid out in shards of bounded size: neighbouring centroids next to each other, large cells
cut by a hash of the id. A query is sent once to each shard that holds cells of its list. Shards
that very many queries ask for are copied, each copy for its share of the queries. So no task gets
more than ``SHARD_ROWS`` vectors (plus one piece) and about ``SHARD_QUERIES`` queries, whatever is hot.

The codebooks are fitted on a bounded sample (``SAMPLE`` rows, or 16 a centroid if that is more); every row is
indexed, and assigned to its cell once. Cells number about rows / CELL_ROWS, at most MAX_CENTROIDS squared: beyond
half a billion rows cells get larger, and so does what a query meets in the MIN_CELLS it walks.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kelpline.llm.vectors import fixed_sample, kmeans, packed, unpack
from kelpline.session import job_dir, materialize

SAMPLE = 16384
CELL_ROWS = 32
MAX_CENTROIDS = 4096
SHARD_ROWS = 16384
PIECE_ROWS = 8192
SHARD_QUERIES = 32768
MIN_ENTRIES = 2048
MIN_CELLS = 48
BLOCK = 1 << 21
TIE = 1e-11


def collection(sources: list[DataFrame], dim: int, tombstones: DataFrame | None = None) -> DataFrame:
    """``vec_id, v`` of the sources ``(vec_id, vector)``: each id once, valid vectors only, without the
    ids of ``tombstones``. One shuffle does both. An id with several valid vectors keeps the one whose
    bytes are least."""
    rows = None
    for s in sources:
        p = packed(s, "vec_id", "vector", dim).withColumn("dead", F.lit(False))
        rows = p if rows is None else rows.unionByName(p)
    if tombstones is not None:
        rows = rows.unionByName(tombstones.where("vec_id IS NOT NULL").select("vec_id", F.lit(None).cast("binary").alias("v"), F.lit(True).alias("dead")))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"), F.max("dead").alias("dead")).where("NOT dead AND v IS NOT NULL").select("vec_id", "v")


@dataclass
class MultiIndex:
    """Codebooks, cell counts and the shard of each cell piece; all bounded by MAX_CENTROIDS."""

    dim: int
    centroids: tuple[np.ndarray, np.ndarray]
    counts: np.ndarray  # K1 x K2
    first_shard: np.ndarray  # K1 x K2: shard of a cell's first piece; its pieces lie in consecutive shards
    pieces: np.ndarray  # K1 x K2
    n_shards: int
    entries: DataFrame | None = None  # vec_id, cell, shard, v


def _chain(c: np.ndarray) -> np.ndarray:
    """Places of the centroids on a greedy nearest-neighbour path."""
    left, at, path = set(range(len(c))), 0, []
    while left:
        path.append(at)
        left.discard(at)
        if left:
            rest = np.fromiter(left, int)
            at = int(rest[((c[rest] - c[at]) ** 2).sum(1).argmin()])
    return np.array(path, dtype=int)


def _cells(x: np.ndarray, centroids: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    half = x.shape[1] // 2
    i, j = (((c * c).sum(1) - 2 * part @ c.T).argmin(1) for part, c in zip((x[:, :half], x[:, half:]), centroids))
    return i.astype(np.int64) * len(centroids[1]) + j


def sampled(sources: list[DataFrame], dim: int) -> tuple[int, np.ndarray]:
    """(rows, fitting sample) of the sources ``(vec_id, vector)``, before ids are made unique: only rows of the sample are read whole."""
    n = sum(s.count() for s in sources)
    rows = None
    for s in sources:
        rows = s.select("vec_id", "vector") if rows is None else rows.unionByName(s.select("vec_id", "vector"))
    return n, fixed_sample(rows, "vec_id", n, max(SAMPLE, 16 * centroids_for(n)), dim, "vector")


def centroids_for(n: int) -> int:
    return int(np.clip(np.sqrt(n / CELL_ROWS), 1, MAX_CENTROIDS))


def build(vectors: DataFrame, dim: int, sample: tuple[int, np.ndarray]) -> MultiIndex:
    """Index ``vec_id, v`` with codebooks fitted on ``sample`` (see ``sampled``). The assigned rows are written to the shared folder."""
    n, rows = sample
    rows = rows if len(rows) else np.zeros((1, dim), np.float32)  # none of the sample's rows was valid
    k, half = centroids_for(n), dim // 2
    centroids = (kmeans(rows[:, :half], k), kmeans(rows[:, half:], k, seed=8))

    def assign(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in it:
            if len(df):
                yield df.assign(cell=_cells(unpack(df["v"], dim).astype(np.float64), centroids).astype(np.int32))

    placed = materialize(vectors.mapInPandas(assign, "vec_id BIGINT, v BINARY, cell INT"), "cells")
    k1, k2 = len(centroids[0]), len(centroids[1])
    met = placed.groupBy("cell").count().toPandas()  # at most MAX_CENTROIDS ** 2 rows of two numbers
    counts = np.zeros(k1 * k2, np.int32)
    counts[met["cell"].to_numpy()] = met["count"].to_numpy()
    pieces = np.maximum(1, -(-counts // PIECE_ROWS)).astype(np.int32)
    order = (_chain(centroids[0])[:, None] * k2 + _chain(centroids[1])[None]).ravel()
    order = order[counts[order] > 0]
    small = pieces[order] == 1
    first, some = np.zeros(k1 * k2, np.int32), counts[order[small]].astype(np.int64)
    n_small = 0
    if len(some):  # runs of neighbouring cells, SHARD_ROWS and at most a piece more
        first[order[small]] = (np.cumsum(some) - some) // SHARD_ROWS
        n_small = int(first[order[small]].max()) + 1
    large = order[~small]  # each piece of a large cell is a shard of its own
    first[large] = n_small + np.cumsum(pieces[large]) - pieces[large]
    n_shards = n_small + int(pieces[large].sum())
    spark = vectors.sparkSession
    cells = spark.createDataFrame(pd.DataFrame({"cell": order.astype(np.int32), "first": first[order], "pieces": pieces[order]}), "cell INT, first INT, pieces INT")
    entries = placed.join(F.broadcast(cells), "cell").select("vec_id", "v", "cell", (F.col("first") + F.pmod(F.xxhash64("vec_id", F.lit(5)), F.col("pieces"))).cast("int").alias("shard"))
    return MultiIndex(dim, centroids, counts.reshape(k1, k2), first.reshape(k1, k2), pieces.reshape(k1, k2), n_shards, entries if len(order) else None)


def walk(d1: np.ndarray, d2: np.ndarray, counts, min_entries: int, min_cells: int) -> list[tuple[int, int]]:
    """The filled cells nearest to a query, in order of summed distance, until both minima are met.

    Both lists are sorted; a heap holds the frontier. A cell enters it once its neighbours on both
    sides were taken, so each cell is met once and in order.
    """
    o1, o2 = d1.argsort(kind="stable"), d2.argsort(kind="stable")
    s1, s2 = d1[o1].tolist(), d2[o2].tolist()
    o1, o2 = o1.tolist(), o2.tolist()
    reach = [0] * len(o1)  # in row a, the columns below reach[a] are taken
    heap, out, met = [(s1[0] + s2[0], 0, 0)], [], 0
    while heap and (met < min_entries or len(out) < min_cells):
        _, a, b = heapq.heappop(heap)
        n = counts[o1[a]][o2[b]]
        if n:
            out.append((o1[a], o2[b]))
            met += n
        reach[a] = b + 1
        if a + 1 < len(o1) and reach[a + 1] == b:
            heapq.heappush(heap, (s1[a + 1] + s2[b], a + 1, b))
        if b + 1 < len(o2) and (a == 0 or reach[a - 1] > b + 1):
            heapq.heappush(heap, (s1[a] + s2[b + 1], a, b + 1))
    return out


def probes(index: MultiIndex, queries: DataFrame, min_entries: int, min_cells: int) -> DataFrame:
    """``query_id, k, v, shard, cells``: a row for each shard a query must see."""
    dim, half, centroids = index.dim, index.dim // 2, index.centroids
    counts, first, pieces = index.counts, index.first_shard, index.pieces
    k2 = len(centroids[1])

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        filled = counts.tolist() if counts.size <= 1 << 20 else counts  # lists are faster, where they are small
        for df in it:
            if not len(df):
                continue
            x = unpack(df["v"], dim).astype(np.float64)
            d1, d2 = ((c * c).sum(1) - 2 * p @ c.T + (p * p).sum(1)[:, None] for p, c in zip((x[:, :half], x[:, half:]), centroids))
            rows = []
            for q in range(len(df)):
                by: dict[int, list[int]] = {}
                for i, j in walk(d1[q], d2[q], filled, max(min_entries, 8 * int(df["k"].iloc[q])), min_cells):
                    for p in range(int(pieces[i, j])):
                        by.setdefault(int(first[i, j]) + p, []).append(i * k2 + j)
                rows += [(q, s, cells) for s, cells in by.items()]
            at = np.array([r[0] for r in rows], dtype=int)
            yield pd.DataFrame({"query_id": df["query_id"].to_numpy()[at], "k": df["k"].to_numpy()[at], "v": df["v"].to_numpy()[at], "shard": np.array([r[1] for r in rows], np.int32), "cells": [r[2] for r in rows]})

    return queries.select("query_id", "k", "v").mapInPandas(run, "query_id BIGINT, k INT, v BINARY, shard INT, cells ARRAY<INT>")


def _best(qi: np.ndarray, ids: np.ndarray, d: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Places of the k[q] best pairs of each query; ties go to the smaller id."""
    order = np.lexsort((ids, np.round(d / TIE), qi))
    q = qi[order]
    start = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
    rank = np.arange(len(q)) - np.repeat(start, np.diff(np.r_[start, len(q)]))
    return order[rank < k[q]]


def nearest_pairs(x: np.ndarray, ids: np.ndarray, q: np.ndarray, k: np.ndarray, visits: Iterator[tuple[np.ndarray, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query row of ``q`` its k best rows of ``x``, which bear ``ids``, over ``visits``: (query
    rows, from, to). Blocks bound the memory; pairs are cut back to the best as they gather."""
    xx, qq = (x * x).sum(1), (q * q).sum(1)
    kept: list[tuple[np.ndarray, ...]] = []
    size = 0

    def fold() -> tuple[np.ndarray, ...]:
        a, b, d = (np.concatenate(z) for z in zip(*kept)) if kept else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        best = _best(a, ids[b], d, k) if len(a) else np.zeros(0, np.int64)
        return a[best], b[best], d[best]

    for rows, lo, hi in visits:
        step = max(1, BLOCK // (hi - lo))
        for s in range(0, len(rows), step):
            r = rows[s : s + step]
            d = qq[r][:, None] + xx[None, lo:hi] - 2 * q[r] @ x[lo:hi].T
            most = int(k[r].max())
            if hi - lo > 2 * most:
                limit = np.partition(d, most - 1, axis=1)[:, most - 1] + 2 * TIE
                a, b = np.nonzero(d <= limit[:, None])
            else:
                a, b = (z.ravel() for z in np.indices(d.shape))
            kept.append((r[a], b + lo, d[a, b]))
            size += len(a)
            if size > BLOCK:
                kept = [fold()]
                size = len(kept[0][0])
    a, b, _ = fold()
    return a, b, np.concatenate([((q[a[s : s + 65536]] - x[b[s : s + 65536]]) ** 2).sum(1) for s in range(0, len(a), 65536)]) if len(a) else np.zeros(0)


RESULT = "query_id BIGINT, k INT, vec_id BIGINT, d2 DOUBLE"


def search(index: MultiIndex, queries: DataFrame, min_entries: int = MIN_ENTRIES, min_cells: int = MIN_CELLS) -> DataFrame:
    """``query_id, vec_id, distance, rank`` of the queries ``query_id, k, v`` (valid, k > 0)."""
    spark, dim = queries.sparkSession, index.dim
    if index.entries is None:
        return spark.createDataFrame([], "query_id BIGINT, vec_id BIGINT, distance DOUBLE, rank INT")
    asked = materialize(probes(index, queries, min_entries, min_cells), "probes")
    hot = asked.groupBy("shard").agg(F.ceil(F.count("*") / SHARD_QUERIES).alias("copies")).where("copies > 1")
    if hot.limit(1).count():
        hot = materialize(hot, "hot")
        of = lambda side: hot.select(F.col("shard").alias(f"{side}_shard"), F.col("copies").alias(f"{side}_copies"))  # noqa: E731 (columns of their own for each join)
        many = F.coalesce("entry_copies", F.lit(1))
        entries = index.entries.join(of("entry"), F.col("shard") == F.col("entry_shard"), "left").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), many - 1))).select("vec_id", "v", "cell", "shard", "copy")
        asked = asked.join(of("probe"), F.col("shard") == F.col("probe_shard"), "left").withColumn("copy", F.pmod(F.xxhash64("query_id"), F.coalesce("probe_copies", F.lit(1)))).select("query_id", "k", "v", "shard", "cells", "copy")
    else:
        entries, asked = index.entries.withColumn("copy", F.lit(0).cast("bigint")), asked.withColumn("copy", F.lit(0).cast("bigint"))

    def rerank(e: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        if not len(e) or not len(p):
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "k": np.zeros(0, np.int32), "vec_id": np.zeros(0, np.int64), "d2": np.zeros(0)})
        e = e.sort_values(["cell", "vec_id"], kind="stable")
        x, q = unpack(e["v"], dim).astype(np.float64), unpack(p["v"], dim).astype(np.float64)
        ids, cell = e["vec_id"].to_numpy(), e["cell"].to_numpy()
        starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        ends = np.r_[starts[1:], len(cell)]
        sizes = np.array([len(c) for c in p["cells"]])
        want, who = np.concatenate(list(p["cells"])), np.repeat(np.arange(len(p)), sizes)
        order = np.argsort(want, kind="stable")
        want, who = want[order], who[order]
        lo, hi = np.searchsorted(want, cell[starts], "left"), np.searchsorted(want, cell[starts], "right")
        k = p["k"].to_numpy().astype(np.int64)
        a, b, d2 = nearest_pairs(x, ids, q, k, ((who[l:h], s, t) for l, h, s, t in zip(lo, hi, starts, ends) if h > l))
        return pd.DataFrame({"query_id": p["query_id"].to_numpy()[a], "k": k[a].astype(np.int32), "vec_id": ids[b], "d2": d2})

    return best_of(entries.groupBy("shard", "copy").cogroup(asked.groupBy("shard", "copy")).applyInPandas(rerank, RESULT))


def best_of(found: DataFrame) -> DataFrame:
    """The k best of each query from the shards' answers; ties go to the smaller vec_id."""
    w = Window.partitionBy("query_id").orderBy("d2", "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where("rank <= k").select("query_id", "vec_id", F.sqrt("d2").alias("distance"), "rank")


def brute_force(vectors: DataFrame, queries: DataFrame, dim: int) -> DataFrame:
    """The exact answer, for measuring: every block of vectors against every block of queries. The
    queries are written once and read block by block in each task, so none are broadcast."""
    q = queries.select("query_id", "k", "v")
    path = job_dir(q.sparkSession, "queries")
    q.write.parquet(path)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = pafs.FileSystem.from_uri(path)
        files = sorted(f.path for f in fs.get_file_info(pafs.FileSelector(base)) if f.path.endswith(".parquet"))
        for df in it:
            if not len(df):
                continue
            df = df.sort_values("vec_id")
            x, ids = unpack(df["v"], dim).astype(np.float64), df["vec_id"].to_numpy()
            for f in files:
                with fs.open_input_file(f) as h:
                    for b in pq.ParquetFile(h).iter_batches(4096):
                        p = b.to_pandas()
                        k = p["k"].to_numpy().astype(np.int64)
                        a, c, d2 = nearest_pairs(x, ids, unpack(p["v"], dim).astype(np.float64), k, iter([(np.arange(len(p)), 0, len(x))]))
                        yield pd.DataFrame({"query_id": p["query_id"].to_numpy()[a], "k": k[a].astype(np.int32), "vec_id": ids[c], "d2": d2})

    return best_of(vectors.mapInPandas(run, RESULT))


def valid_queries(queries: DataFrame, dim: int) -> DataFrame:
    """``query_id, k, radius, v`` of the queries with a valid vector and k > 0. A query_id counts once; of
    several valid rows of one id the least (by vector bytes, k, radius) is taken."""
    rows = packed(queries.where("k > 0"), "query_id", "vector", dim, ["k", "radius"])
    return rows.groupBy("query_id").agg(F.min(F.struct("v", "k", "radius")).alias("q")).select("query_id", "q.k", "q.radius", "q.v")


def within_radius(result: DataFrame, queries: DataFrame) -> DataFrame:
    """Drop results farther than the query's radius, if it has one."""
    r = queries.select("query_id", F.col("radius").cast("double").alias("radius"))
    return result.join(r, "query_id").where("radius IS NULL OR distance <= radius").drop("radius")
