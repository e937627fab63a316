"""Proximity graphs: layered small-world graphs and pruned flat graphs, built and searched by shard.

A shard's graph is built by one task from its vectors, so shards are to be sized for a task (``sharded`` deals them so).
Graphs are tables ``shard, layer, vec_id, neighbours``; searches fan out to the shards, or to those
whose centres are nearest to the query, and merge. ``entry`` marks the row that searches begin at. Results
are approximate: they are measured by recall against the exact answer.

Within a task everything is arrays: neighbours are a matrix of row numbers per layer, rows are linked in blocks,
and a block of queries walks the graph together, one node each at a time.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpline.operators import pq
from kelpline.operators.knn import nearest_batched, top_k

GRAPH = "shard INT, layer INT, vec_id BIGINT, neighbours ARRAY<BIGINT>, entry BOOLEAN"
MAX_SHARDS = 100_000
#: Rows of a shard that ``sharded`` makes, about: linking them is one task, whose cost grows with their square.
SHARD_ROWS = 20_000
#: Rows linked at a time, values of a block of pairwise distances, and marks of visited rows held at a time.
BLOCK_ROWS, PAIR_VALUES, SEEN_MARKS = 512, 1 << 25, 1 << 27
#: Rows whose candidates are compared at a time.
APART_ROWS = 16
#: Training rows of a shard's learned entries.
TRAINED = 1024


def _dist(x: np.ndarray, rows, q: np.ndarray) -> np.ndarray:
    return np.sqrt(((x[rows] - q) ** 2).sum(-1))


def _between(x: np.ndarray, rows: list[int]) -> np.ndarray:
    """Distances between all of a few rows."""
    y = x[rows]
    sq = (y * y).sum(1)
    return np.sqrt(np.maximum(sq[:, None] + sq[None] - 2 * y @ y.T, 0))


def robust_prune(x: np.ndarray, p: int, candidates: list[int], alpha: float, r: int) -> list[int]:
    """At most r neighbours of p: the nearest candidate is kept, and every candidate at least alpha times
    nearer to it than to p falls away; and so on. Ties go to the smaller row."""
    rest = sorted({c for c in candidates if c != p})
    if not rest:
        return []
    to_p = _dist(x, rest, x[p])
    order = np.lexsort((rest, to_p))
    rest, to_p = [rest[i] for i in order], to_p[order]
    apart, open_, kept = alpha * _between(x, rest), np.ones(len(rest), bool), []
    for i, c in enumerate(rest):
        if open_[i] and len(kept) < r:
            kept.append(c)
            open_ &= apart[i] > to_p
    return kept


def prune_nearest(vectors: DataFrame, k: int = 32, alpha: float = 1.2, r: int = 16) -> DataFrame:
    """``vec_id, kept``: the neighbours that robust_prune keeps of each vector's k nearest, nearest first."""
    q = vectors.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    near = nearest_batched(vectors, q, k + 1).where("query_id <> vec_id").join(vectors.select("vec_id", "embedding"), "vec_id")
    met = near.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("met"))  # at most k + 1 each

    def run(it):
        for df in it:
            kept = []
            for v, met in zip(df["vector"], df["met"]):
                x = np.array([v, *(m["embedding"] for m in met)], np.float64)
                kept.append([int(met[i - 1]["vec_id"]) for i in robust_prune(x, 0, list(range(1, len(x))), alpha, r)])
            yield pd.DataFrame({"vec_id": df["query_id"], "kept": kept})

    return q.join(met, "query_id", "left").withColumn("met", F.coalesce("met", F.array().cast(met.schema["met"].dataType))).mapInPandas(run, "vec_id BIGINT, kept ARRAY<BIGINT>")


def _apart(x: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Squared distances between the rows ``ids`` (B x C) names, B x C x C."""
    out = np.empty((*ids.shape, ids.shape[1]), x.dtype)
    for s in range(0, len(ids), APART_ROWS):  # few at a time, so that they stay in the cache
        y, d = x[np.maximum(ids[s : s + APART_ROWS], 0)], out[s : s + APART_ROWS]
        sq = np.einsum("bcd,bcd->bc", y, y)
        np.matmul(y, y.transpose(0, 2, 1), out=d)
        d *= -2
        d += sq[:, :, None]
        d += sq[:, None, :]
        np.maximum(d, 0, out=d)
    return out


def diverse(x: np.ndarray, ids: np.ndarray, d: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` neighbours (B x most, -1 where fewer) out of candidates ``ids`` (B x C, -1 for none) with squared
    distances ``d``, nearest first: a candidate is kept if it is nearer to its base than to every one kept; the
    rest fill up."""
    apart, valid = _apart(x, ids), ids >= 0
    nearest, kept, n = np.full(ids.shape, np.inf, np.float32), np.zeros(ids.shape, bool), np.zeros(len(ids), int)
    for i in range(ids.shape[1]):
        ok = valid[:, i] & (n < most) & (nearest[:, i] > d[:, i])
        kept[:, i] = ok
        n += ok
        nearest[ok] = np.minimum(nearest[ok], apart[ok, i])
    return _first(np.where(kept, 0, np.where(valid, 1, 2)), ids, most)


def robust(x: np.ndarray, ids: np.ndarray, d: np.ndarray, most: int, alpha: float) -> np.ndarray:
    """As ``diverse``, by the rule of ``robust_prune``; nothing fills up."""
    apart, open_, kept, n = alpha * alpha * _apart(x, ids), ids >= 0, np.zeros(ids.shape, bool), np.zeros(len(ids), int)
    for i in range(ids.shape[1]):
        ok = open_[:, i] & (n < most)
        kept[:, i] = ok
        n += ok
        open_[ok] &= apart[ok, i] > d[ok]
    return _first(np.where(kept, 0, 2), ids, most)


def _first(rank: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """The ids of least rank, in their order; those of rank 2 become -1."""
    order = np.argsort(rank, axis=1, kind="stable")[:, :most]
    out = np.full((len(ids), most), -1, np.int32)
    out[:, : order.shape[1]] = np.where(np.take_along_axis(rank, order, 1) < 2, np.take_along_axis(ids, order, 1), -1)
    return out


def _sorted(x: np.ndarray, base: np.ndarray, ids: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` candidates nearest to each base row, (ids, squared distances) nearest first; a candidate
    counts once, and not for itself."""
    ids = np.sort(ids, axis=1)
    ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
    ids[ids == base[:, None]] = -1
    d = np.empty(ids.shape, x.dtype)
    for s in range(0, len(ids), APART_ROWS):
        y = x[np.maximum(ids[s : s + APART_ROWS], 0)]
        y -= x[base[s : s + APART_ROWS]][:, None]
        np.einsum("bcd,bcd->bc", y, y, out=d[s : s + APART_ROWS])
    d[ids < 0] = np.inf
    order = np.argsort(d, axis=1, kind="stable")[:, :most]
    return np.take_along_axis(ids, order, 1), np.take_along_axis(d, order, 1)


def _nearest(x: np.ndarray, rows: np.ndarray, among: np.ndarray, many: int, before: bool) -> np.ndarray:
    """For each of ``rows`` the ``many`` nearest of ``among`` (ascending), of those before it if ``before``; -1 for none."""
    y, z = x[rows], x[among]
    d = (z * z).sum(1)[None] - 2 * y @ z.T
    d[among[None] >= rows[:, None] if before else among[None] == rows[:, None]] = np.inf
    many = min(many, d.shape[1])
    at = np.argpartition(d, many - 1, axis=1)[:, :many] if many < d.shape[1] else np.broadcast_to(np.arange(many), d.shape)
    return np.where(np.isfinite(np.take_along_axis(d, at, 1)), among[at], -1).astype(np.int32)


def link_back(x: np.ndarray, links: np.ndarray, rows: np.ndarray, choose) -> None:
    """Enter ``rows`` into the lists of the neighbours they chose; lists that overflow are chosen anew."""
    width = links.shape[1]
    to, of = links[rows].ravel(), np.repeat(rows, width)
    to, of = to[to >= 0], of[to >= 0]
    order = np.argsort(to, kind="stable")
    to, of = to[order], of[order]
    touched, start, n = np.unique(to, return_index=True, return_counts=True)
    for some in np.array_split(np.arange(len(touched)), max(1, len(touched) // 1024)):
        # lists with like numbers of newcomers would waste less room, but few have many
        most = int(n[some].max()) if len(some) else 0
        if not most:
            continue
        place = np.arange(most)[None]
        new = np.where(place < n[some][:, None], of[np.minimum(start[some][:, None] + place, len(of) - 1)], -1)
        step = max(1, PAIR_VALUES // (9 * width * width))
        for s in range(0, len(some), step):
            t = touched[some[s : s + step]]
            ids, d = _sorted(x, t, np.concatenate([links[t], new[s : s + step]], 1).astype(np.int32), 3 * width)
            full = (ids >= 0).sum(1) > width
            out = np.full((len(t), width), -1, np.int32)
            out[:, : min(width, ids.shape[1])] = ids[:, :width]
            if full.any():
                out[full] = choose(ids[full], d[full], width)
            links[t] = out


@dataclass
class Graph:
    """Neighbours by layer over the rows of ``x``: matrices of row numbers, -1 for none; layer 0 holds all rows, and
    ``level`` is the highest layer of each."""

    x: np.ndarray
    links: list[np.ndarray] = field(default_factory=list)
    level: np.ndarray = field(default_factory=lambda: np.zeros(0, int))
    entry: int | None = None

    def beam(self, q: np.ndarray, start: np.ndarray, ef: int, layer: int) -> np.ndarray:
        """For each query the ef nearest rows met from its start row (-1 for none), in no order. A query is at its
        end when the ef nearest rows it met have all been left by their links."""
        x, links, every = self.x, self.links[layer], np.arange(len(q))
        seen = np.zeros((len(q), len(x)), bool)
        ids, d, open_ = np.full((len(q), ef), -1, np.int32), np.full((len(q), ef), np.inf, np.float32), np.zeros((len(q), ef), bool)
        ids[:, 0], d[:, 0], open_[:, 0], seen[every, start] = start, ((x[start] - q) ** 2).sum(1), True, True
        live = every
        while len(live):
            near = np.where(open_[live], d[live], np.inf)
            j = near.argmin(1)
            go = np.isfinite(near[np.arange(len(live)), j])
            live, j = live[go], j[go]
            if not len(live):
                break
            open_[live, j] = False
            new = links[ids[live, j]]
            ok = new >= 0
            at = np.where(ok, new, 0)
            ok &= ~seen[live[:, None], at]
            some = ok.any(1)
            if not some.all():
                rows, at, ok = live[some], at[some], ok[some]
            else:
                rows = live
            if not len(rows):
                continue
            seen[np.repeat(rows, ok.sum(1)), at[ok]] = True
            dn = np.where(ok, ((x[at] - q[rows][:, None]) ** 2).sum(2), np.inf).astype(np.float32)
            all_d = np.concatenate([d[rows], dn], 1)
            pick = np.argpartition(all_d, ef - 1, axis=1)[:, :ef]
            d[rows] = np.take_along_axis(all_d, pick, 1)
            ids[rows] = np.take_along_axis(np.concatenate([ids[rows], np.where(ok, at, -1)], 1), pick, 1)
            open_[rows] = np.take_along_axis(np.concatenate([open_[rows], ok], 1), pick, 1)
        return ids

    def search(self, q: np.ndarray, k: int, ef: int = 100, allowed: np.ndarray | None = None, start: np.ndarray | None = None, start_layer: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, distance) of the k nearest rows found for each query. ``start``: rows to begin at in ``start_layer``
        (as a learned entry gives them), -1 or a row that isn't in that layer for the top layer's entry. Rows that aren't ``allowed`` are walked through, so the
        walk is widened by their share."""
        none = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        if self.entry is None or not len(q) or (allowed is not None and not allowed.any()):
            return none
        ef = min(len(self.x), max(ef, k) if allowed is None else math.ceil(max(ef, 2 * k) / allowed.mean()))
        out = [none]
        step = max(1, min(1024, SEEN_MARKS // len(self.x), PAIR_VALUES // (ef + self.links[0].shape[1])))
        for s in range(0, len(q), step):
            part = q[s : s + step].astype(np.float32)
            at, own = np.full(len(part), self.entry), None if start is None else start[s : s + step]
            for layer in range(len(self.links) - 1, -1, -1):
                if own is not None and layer == start_layer:
                    at = np.where((own >= 0) & (self.level[own] >= layer), own, at)
                if layer:
                    at = self.beam(part, at, 1, layer)[:, 0]
            ids = self.beam(part, at, ef, 0)
            who, row = np.nonzero(ids >= 0)[0], ids[ids >= 0]
            if allowed is not None:
                who, row = who[allowed[row]], row[allowed[row]]
            d = np.sqrt(((self.x[row].astype(np.float64) - q[s : s + step][who]) ** 2).sum(1))
            order = np.lexsort((row, d, who))
            who, row, d = who[order], row[order], d[order]
            first = np.searchsorted(who, who, "left")
            keep = np.arange(len(who)) - first < k
            out.append((who[keep] + s, row[keep], d[keep]))
        return tuple(np.concatenate(z) for z in zip(*out))


def build_layered(x: np.ndarray, m: int = 16, ef_construction: int = 200, seed: int = 0, into: Graph | None = None, first: int = 0) -> Graph:
    """Link the rows in order: levels are drawn from an exponential law, and neighbours are picked by diversity from the
    ``ef_construction`` nearest of the rows before. ``into``: a graph over the same rows that already links
    those before ``first``; the others are added."""
    x, rng = x.astype(np.float32), np.random.default_rng(seed + first)
    g = into or Graph(x)
    level = (-np.log(1 - rng.random(len(x) - first)) / math.log(max(2, m))).astype(int)
    g.x, g.level = x, np.r_[g.level[:first], level]
    if not len(x):
        return g
    choose = lambda ids, d, most: diverse(x, ids, d, most)
    for layer in range(int(g.level.max()) + 1):
        width = 2 * m if layer == 0 else m
        links = np.full((len(x), width), -1, np.int32)
        if layer < len(g.links):
            old = g.links[layer][:first, :width]
            links[:first, : old.shape[1]] = old
            g.links[layer] = links
        else:
            g.links.append(links)
        rows = np.flatnonzero(g.level >= layer).astype(np.int32)
        new = rows[rows >= first]
        for s in range(0, len(new), BLOCK_ROWS):
            part = new[s : s + BLOCK_ROWS]
            found = _nearest(x, part, rows[: np.searchsorted(rows, part[-1], "right")], ef_construction, before=True)
            step = max(1, PAIR_VALUES // (found.shape[1] ** 2))
            for t in range(0, len(part), step):
                links[part[t : t + step]] = diverse(x, *_sorted(x, part[t : t + step], found[t : t + step], found.shape[1]), width)
            link_back(x, links, part, choose)
    if g.entry is None or g.level.max() > g.level[g.entry]:
        g.entry = int(g.level.argmax())
    return g


def build_flat(x: np.ndarray, r: int = 32, alpha: float = 1.2, ef: int = 75, seed: int = 0) -> Graph:
    """Start from random neighbours; two passes (alpha 1, then alpha) that prune them together with the ``ef`` nearest
    rows, and link back; entered at the row nearest to the mean."""
    n, rng, x = len(x), np.random.default_rng(seed), x.astype(np.float32)
    g = Graph(x)
    if not n:
        return g
    g.entry, g.level = int(((x - x.mean(0)) ** 2).sum(1).argmin()), np.zeros(n, int)
    links = rng.integers(0, n, (n, r)).astype(np.int32)
    rows = np.arange(n, dtype=np.int32)
    links[links == rows[:, None]] = -1
    g.links = [links]
    near = np.concatenate([_nearest(x, rows[s : s + BLOCK_ROWS], rows, ef, before=False) for s in range(0, n, BLOCK_ROWS)])
    for a in (1.0, alpha):
        choose = lambda ids, d, most, a=a: robust(x, ids, d, most, a)
        for s in range(0, n, BLOCK_ROWS):
            part = rows[s : s + BLOCK_ROWS]
            links[part] = robust(x, *_sorted(x, part, np.concatenate([near[part], links[part]], 1), ef + r), r, a)
            link_back(x, links, part, choose)
    return g


BUILDERS = {"layered": build_layered, "flat": build_flat}


def _rows(shard, ids: np.ndarray, g: Graph) -> pd.DataFrame:
    out = []
    for layer, links in enumerate(g.links):
        for i in np.flatnonzero(g.level >= layer):
            n = links[i]
            out.append((shard, layer, int(ids[i]), ids[n[n >= 0]].tolist(), bool(i == g.entry)))
    return pd.DataFrame(out, columns=["shard", "layer", "vec_id", "neighbours", "entry"])


def build(vectors: DataFrame, kind: str = "layered", **options) -> DataFrame:
    """Graphs of ``shard, vec_id, embedding``, one task a shard."""
    maker = BUILDERS[kind]

    def run(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("vec_id")
        return _rows(df["shard"].iloc[0], df["vec_id"].to_numpy(), maker(np.stack(df["embedding"].to_list()), **options))

    rows = _spread(vectors.select("shard").distinct().count(), vectors.select("shard", "vec_id", "embedding"))[0]
    return rows.groupBy("shard").applyInPandas(run, GRAPH)


def insert(vectors: DataFrame, graph: DataFrame, added: DataFrame, **options) -> DataFrame:
    """The layered graphs with the vectors ``added`` linked in. Ids that are already there are passed over;
    only shards that get new vectors are touched, the others' rows come back as they are."""
    new = added.select("shard", "vec_id", "embedding").dropDuplicates(["shard", "vec_id"]).join(vectors.select("shard", "vec_id"), ["shard", "vec_id"], "left_anti")
    new = new.select(*[F.col(c).alias(c) for c in new.columns])  # columns of its own, as both sides may come from one table
    touched = new.select("shard").distinct()
    links = graph.join(touched, "shard", "left_semi").groupBy("shard", "vec_id").agg(F.collect_list(F.struct("layer", "neighbours", "entry")).alias("links"))
    old = vectors.select("shard", "vec_id", "embedding").join(links, ["shard", "vec_id"])

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("vec_id")
        ids, x, g = b["vec_id"].to_numpy(), np.stack(b["embedding"].to_list()), None
        if len(a):
            kept, g = load(a)
            ids, x = np.r_[kept, ids], np.concatenate([g.x, x])
        return _rows(b["shard"].iloc[0], ids, build_layered(x, into=g, first=len(a), **options))

    grown = old.groupBy("shard").cogroup(new.groupBy("shard")).applyInPandas(run, GRAPH)
    return graph.join(touched, "shard", "left_anti").select("shard", "layer", "vec_id", "neighbours", "entry").unionByName(grown)


def graph_stats(vectors: DataFrame, graph: DataFrame, deleted: DataFrame | None = None) -> DataFrame:
    """One row: live vectors, edges, and bytes at 4 a dimension, 16 a vector and 8 an edge."""
    v = vectors.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("embedding") * 4 + 16), F.lit(0)).alias("bytes"))
    live = vectors if deleted is None else vectors.join(deleted.select("vec_id").distinct(), "vec_id", "left_anti")
    n_live, n_bytes = live.count(), v.first()["bytes"]
    return graph.agg(F.lit(n_live).cast("bigint").alias("n_live"), F.coalesce(F.sum(F.size("neighbours")), F.lit(0)).cast("bigint").alias("n_edges")).withColumn(
        "memory_bytes", F.col("n_edges") * 8 + F.lit(int(n_bytes)))


def load(rows: pd.DataFrame) -> tuple[np.ndarray, Graph]:
    """(ids in ascending order, graph) of one shard from ``vec_id, embedding, links``, links being (layer, neighbours, entry)."""
    rows = rows.sort_values("vec_id")
    ids = rows["vec_id"].to_numpy()
    g = Graph(np.stack(rows["embedding"].to_list()).astype(np.float32))
    layer, row, many, flat = [], [], [], []
    for i, links in enumerate(rows["links"]):
        for link in links:
            layer.append(link["layer"])
            row.append(i)
            many.append(len(link["neighbours"]))
            flat.append(link["neighbours"])
            if link["entry"]:
                g.entry = i
    layer, row, many = np.array(layer, int), np.array(row, int), np.array(many, int)
    names = np.concatenate([np.zeros(0, np.int64), *flat]).astype(np.int64)
    at = np.minimum(np.searchsorted(ids, names), len(ids) - 1)
    at = np.where(ids[at] == names, at, -1)
    place = np.arange(len(names)) - np.repeat(np.cumsum(many) - many, many)
    of, its_layer = np.repeat(row, many), np.repeat(layer, many)
    g.level = np.zeros(len(ids), int)
    np.maximum.at(g.level, row, layer)
    for z in range(int(layer.max(initial=0)) + 1):
        mine = its_layer == z
        links = np.full((len(ids), max(1, int(many[layer == z].max(initial=0)))), -1, np.int32)
        links[of[mine], place[mine]] = at[mine]
        g.links.append(links)
    return ids, g


class LearnedEntry:
    """Predicts an entry row for a query: the nearest training row in a random projection, if near enough."""

    def __init__(self, dim: int, width: int = 16, threshold: float = 2.0, seed: int = 0):
        self.projection = np.random.default_rng(seed).uniform(-1, 1, (dim, width)) / math.sqrt(width)
        self.threshold, self.points, self.rows = threshold, np.zeros((0, width)), np.zeros(0, int)

    def fit(self, x: np.ndarray, rows: np.ndarray) -> LearnedEntry:
        self.points, self.rows = x @ self.projection, np.asarray(rows)
        return self

    def predict(self, q: np.ndarray) -> np.ndarray:
        """A row for each query; -1 where none is near enough."""
        if not len(self.rows):
            return np.full(len(q), -1)
        p = q @ self.projection
        d = np.sqrt(((self.points[None] - p[:, None]) ** 2).sum(2))
        return np.where(d.min(1) <= self.threshold, self.rows[d.argmin(1)], -1)


def trained_entries(vectors: DataFrame, per_shard: int = TRAINED) -> DataFrame:
    """``shard, vec_id`` of about ``per_shard`` rows of each shard, chosen by a hash: what learned entries are fitted on. To
    be kept beside the graph."""
    n = vectors.groupBy("shard").agg(F.count("*").alias("n"))
    h = F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(1 << 30))
    return vectors.select("shard", "vec_id").join(n, "shard").where(h * F.col("n") < F.lit(per_shard << 30)).select("shard", "vec_id")


def sharded(vectors: DataFrame, n_regions: int, most: int = SHARD_ROWS) -> DataFrame:
    """``vec_id, embedding`` with the ``region`` of the nearest of ``n_regions`` centres, so that a query needs few regions, and
    with its ``shard``: a region's rows are dealt evenly to as many shards as hold about ``most`` rows each."""
    book = pq.train_kmeans(vectors, n_regions)
    coded = vectors.join(pq.encode(vectors, book).select("vec_id", F.element_at("codes", 1).alias("region")), "vec_id")
    sizes, dealt, first = coded.groupBy("region").count().orderBy("region").collect(), [], 0  # a row a region
    for r in sizes:
        n = -(-r["count"] // most)
        dealt.append((r.region, first, n))
        first += n
    dealt = vectors.sparkSession.createDataFrame(dealt, "region INT, first INT, n INT")
    shard = F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("n")).cast("int")
    return coded.join(F.broadcast(dealt), "region").select(*vectors.columns, "region", shard.alias("shard"))


def shard_centres(vectors: DataFrame) -> DataFrame:
    """``shard, region, centre``: each shard with the mean of its region's vectors (without regions, of its own), to be
    kept beside the graph."""
    vectors = vectors if "region" in vectors.columns else vectors.withColumn("region", F.col("shard"))
    mean = vectors.select("region", F.posexplode("embedding").alias("pos", "x")).groupBy("region", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    centres = mean.groupBy("region").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda z: z["x"]).alias("centre"))
    return vectors.select("shard", "region").distinct().join(centres, "region").select("shard", "region", "centre")


def _routed(queries: DataFrame, shards: DataFrame, centres: DataFrame | None, probe: int | None) -> DataFrame:
    """``query_id, vector, shard`` for every shard, or for all shards of the ``probe`` regions with the nearest centres."""
    if probe is None or centres is None:
        names = [r.shard for r in shards.orderBy("shard").limit(MAX_SHARDS + 1).collect()]
    else:
        rows = centres.orderBy("region", "shard").limit(MAX_SHARDS + 1).collect()
        names, at = np.array([r.shard for r in rows], np.int32), np.array([r.region for r in rows])
        _, start, many = np.unique(at, return_index=True, return_counts=True)
        c = np.array([rows[i].centre for i in start], np.float64)
    if len(names) > MAX_SHARDS:
        raise ValueError(f"more than {MAX_SHARDS} shards")
    asked = queries.select("query_id", "vector")
    if probe is None or centres is None or probe >= len(c):
        return asked.withColumn("shard", F.explode(F.array(*[F.lit(int(s)) for s in names]).cast("array<int>")))

    def run(it):
        for df in it:
            if len(df):
                q = np.stack(df["vector"].to_list()).astype(np.float64)
                near = np.argpartition((c * c).sum(1)[None] - 2 * q @ c.T, probe - 1, axis=1)[:, :probe]
                n = many[near]
                flat = n.ravel()  # the shards of a region follow each other in names
                place = np.arange(flat.sum()) - np.repeat(np.cumsum(flat) - flat, flat) + np.repeat(start[near].ravel(), flat)
                yield df.loc[df.index.repeat(n.sum(1))].assign(shard=names[place])

    return asked.mapInPandas(run, "query_id BIGINT, vector ARRAY<FLOAT>, shard INT")


def _spread(n_shards: int, *rows: DataFrame) -> list[DataFrame]:
    """Rows by shard in so many partitions that few hold more than one shard, as a shard is much work."""
    return [r.repartition(max(n_shards, min(8 * n_shards, 2048)), "shard") for r in rows]


def search(vectors: DataFrame, graph: DataFrame, queries: DataFrame, k: int, ef: int = 100, allowed: DataFrame | None = None, learned: DataFrame | None = None,
           centres: DataFrame | None = None, probe: int | None = None) -> DataFrame:
    """``query_id, vec_id, distance, rank`` for ``query_id, vector`` over the shards' graphs.

    ``allowed``: ids that may be returned (others, as deleted ones, are still walked through). ``learned``: the
    ``trained_entries``; walks then begin at a predicted entry. ``centres`` and ``probe``: only shards
    of the ``probe`` regions with the nearest centres are asked.
    """
    asked = _routed(queries, vectors.select("shard").distinct(), centres, probe)
    links = graph.groupBy("shard", "vec_id").agg(F.collect_list(F.struct("layer", "neighbours", "entry")).alias("links"))  # a row's layers
    index = vectors.select("shard", "vec_id", "embedding").join(links, ["shard", "vec_id"])
    for name, some, keys in (("ok", allowed, ["vec_id"]), ("trained", learned, ["shard", "vec_id"])):
        if some is None:
            index = index.withColumn(name, F.lit(name == "ok"))
        else:
            index = index.join(some.select(*keys).distinct().withColumn(name, F.lit(True)), keys, "left").withColumn(name, F.coalesce(name, F.lit(False)))

    def run(df: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        if len(df) and len(rows):
            rows = rows.sort_values("vec_id")
            ids, g = load(rows)
            may, trained, q = rows["ok"].to_numpy(bool), np.flatnonzero(rows["trained"].to_numpy(bool)), np.stack(df["vector"].to_list()).astype(np.float64)
            start = LearnedEntry(g.x.shape[1]).fit(g.x[trained], trained).predict(q) if len(trained) else None
            who, row, d = g.search(q, k, ef, None if may.all() else may, start)
            out = df["query_id"].to_numpy()[who], ids[row], d
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "distance"), out)))

    asked, index = _spread(vectors.select("shard").distinct().count(), asked, index)
    found = asked.groupBy("shard").cogroup(index.groupBy("shard")).applyInPandas(run, "query_id BIGINT, vec_id BIGINT, distance DOUBLE")
    return top_k(found.groupBy("query_id", "vec_id").agg(F.min("distance").alias("distance")), ["query_id"], k)
