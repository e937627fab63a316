"""Key ranges to shards: lookup, node loads, rebalancing, and changes of the routing table.

Routes: ``start BINARY, end BINARY (null: open), shard INT, nodes ARRAY<BIGINT>``. A routing table is
metadata of bounded size: ``MAX_ROUTES`` is checked before it is broadcast or collected.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_ROUTES = 100_000
#: Up to so many ranges a lookup is one SQL expression; with more, a binary search in Python.
SQL_ROUTES = 64


def read_routes(routes: DataFrame) -> list[tuple[bytes, bytes | None, int, list[int]]]:
    rows = routes.select("start", "end", "shard", "nodes").limit(MAX_ROUTES + 1).collect()
    if len(rows) > MAX_ROUTES:
        raise ValueError(f"more than {MAX_ROUTES} routes")
    return sorted(((bytes(r.start or b""), bytes(r.end) if r.end else None, r.shard, list(r.nodes or [])) for r in rows), key=lambda r: (r[0], r[2]))


def shard_of(key: bytes, routes: list[tuple[bytes, bytes | None, int, list[int]]]) -> int:
    """The first route whose range holds the key; if none does, the first route; 0 if there are none."""
    for start, end, shard, _ in routes:
        if start <= key and (end is None or key < end):
            return shard
    return routes[0][2] if routes else 0


def route(keys: DataFrame, key: str, routes: DataFrame) -> DataFrame:
    """Adds ``shard``. A few ranges are one SQL expression; of more that don't overlap, the sorted starts are searched,
    once for each distinct key of a batch."""
    table = read_routes(routes)
    if len(table) <= SQL_ROUTES:
        return keys.withColumn("shard", route_column(F.col(key), table))
    apart = all(a[1] is not None and a[1] <= b[0] for a, b in zip(table, table[1:]))
    starts = [r[0] for r in table]

    def one(k: bytes) -> int:
        if not apart:
            return shard_of(k, table)
        at = bisect_right(starts, k) - 1
        hit = at >= 0 and (table[at][1] is None or k < table[at][1])
        return table[at if hit else 0][2] if table else 0

    names = list(keys.columns)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keys.schema), "shard INT"])

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in it:
            code, found = pd.factorize(df[key])
            shard = pd.array([*(one(bytes(k)) for k in found), None], dtype="Int32")
            yield df[names].assign(shard=shard[code])

    return keys.mapInPandas(run, schema)


def route_column(key: Column, routes: list[tuple[bytes, bytes | None, int, list[int]]]) -> Column:
    """The same as one SQL expression, for routing tables of a few dozen ranges."""
    out = F.lit(routes[0][2] if routes else 0)
    for start, end, shard, _ in reversed(routes):
        inside = key >= F.lit(start)
        if end is not None:
            inside = inside & (key < F.lit(end))
        out = F.when(inside, F.lit(shard)).otherwise(out)
    return F.when(key.isNotNull(), out)


def raft_groups(routed: DataFrame, routes: DataFrame) -> DataFrame:
    if routes.limit(MAX_ROUTES + 1).count() > MAX_ROUTES:
        raise ValueError(f"more than {MAX_ROUTES} routes")
    return routed.join(F.broadcast(routes.select("shard", "nodes")), "shard", "left")


def node_loads(routes: DataFrame, loads: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, load`` of each of ``nodes``: the sum of its shards' loads, 1 for a shard without report."""
    placed = routes.select("shard", F.explode("nodes").alias("node")).join(loads, "shard", "left")
    per = placed.groupBy("node").agg(F.sum(F.coalesce("load", F.lit(1))).alias("load"))
    return nodes.select("node").distinct().join(per, "node", "left").select("node", F.coalesce("load", F.lit(0)).alias("load"))


def propose_moves(placement: dict[int, list[int]], loads: dict[int, int], nodes: list[int], threshold: int = 1) -> list[tuple[int, int, int]]:
    """Greedy moves (shard, from, to) off the most to the least loaded node, while their gap exceeds the
    threshold and a move makes it smaller. Works on the bounded routing metadata, on the driver."""
    held = {n: list(placement.get(n, [])) for n in nodes}
    total = {n: sum(loads.get(s, 1) for s in held[n]) for n in nodes}
    moves: list[tuple[int, int, int]] = []
    while nodes:
        low, high = min(nodes, key=lambda n: total[n]), max(nodes, key=lambda n: total[n])
        gap = total[high] - total[low]
        better = [s for s in held[high] if s not in held[low] and abs(gap - 2 * loads.get(s, 1)) < gap]
        if gap <= threshold or not better:
            break
        shard, size = better[0], loads.get(better[0], 1)
        held[high].remove(shard)
        held[low].append(shard)
        total[high] -= size
        total[low] += size
        moves.append((shard, high, low))
    return moves


def rebalance(routes: DataFrame, loads: DataFrame, nodes: list[int], threshold: int = 1) -> DataFrame:
    placement: dict[int, list[int]] = {}
    for _, _, shard, group in read_routes(routes):
        for n in group:
            placement.setdefault(n, []).append(shard)
    reports = loads.limit(MAX_ROUTES + 1).collect()
    if len(reports) > MAX_ROUTES:
        raise ValueError(f"more than {MAX_ROUTES} loads")
    known = {r.shard: r.load for r in reports}
    moves = [(i, *m) for i, m in enumerate(propose_moves(placement, known, sorted(nodes), threshold))]
    return routes.sparkSession.createDataFrame(moves, "step INT, shard INT, from_node BIGINT, to_node BIGINT")


def upsert_routes(routes: DataFrame, changed: DataFrame) -> DataFrame:
    return routes.join(changed.select("shard"), "shard", "left_anti").unionByName(changed).orderBy("start")


def remove_routes(routes: DataFrame, shards: list[int]) -> DataFrame:
    return routes.where(~F.col("shard").isin(shards)).orderBy("start")


def split_shard(rows: DataFrame, shard: int, at: bytes, new_shard: int, key: str = "user_key") -> DataFrame:
    """Rows of ``shard`` with keys from ``at`` on belong to ``new_shard``; all versions are kept."""
    return rows.withColumn("shard", F.when((F.col("shard") == shard) & (F.col(key) >= F.lit(at)), F.lit(new_shard)).otherwise(F.col("shard")))


def merge_shard(rows: DataFrame, shard: int, into: int) -> DataFrame:
    return rows.withColumn("shard", F.when(F.col("shard") == shard, F.lit(into)).otherwise(F.col("shard")))
