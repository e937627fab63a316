"""Choosing a search strategy from row counts, memory and the filter's selectivity; and what each would cost."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Thresholds of the choice.
BRUTE_FORCE_ROWS = 500
MEMORY_BYTES = 10 * 1024 * 1024
PREFILTER_SELECTIVITY = 0.25

BRUTE, DISK, PRE, POST, GRAPH, LEARNED = "BruteForceScan", "OutofCoreVamana", "PrefilterGraph", "PostfilterGraph", "InMemoryHnsw", "InMemoryLearnedHnsw"


@dataclass(frozen=True)
class Stats:
    row_count: int
    memory_bytes: int = 0
    has_disk_index: bool = False

    def selectivity(self, filter_rows: int | None) -> float:
        if filter_rows is None:
            return 1.0
        return min(1.0, max(0.0, filter_rows / self.row_count)) if self.row_count else 0.0


def plan(stats: Stats, filter_rows: int | None = None, brute_force_rows: int = BRUTE_FORCE_ROWS) -> str:
    if stats.row_count <= brute_force_rows:
        return BRUTE
    if stats.memory_bytes > MEMORY_BYTES and stats.has_disk_index:
        return DISK
    if filter_rows is not None:
        return PRE if stats.selectivity(filter_rows) < PREFILTER_SELECTIVITY else POST
    return GRAPH


def cost(strategy: str, k: int, stats: Stats, filter_rows: int | None = None) -> float:
    n, sel = float(stats.row_count), stats.selectivity(filter_rows)
    depth = (math.log(n) if n else -math.inf) + 1
    if strategy == BRUTE:
        return n
    if strategy == DISK:
        return depth * max(3 * k, 64) * 4
    if strategy == PRE:
        return depth * k * 2 * (8 if sel < 0.05 else 2 / (sel + 0.1))
    if strategy == POST:
        return depth * min(k / max(sel, 0.001), n) * 1.5
    return depth * max(2 * k, 64) * 1.5


def selectivity_column(filter_rows: Column, row_count: Column) -> Column:
    ratio = F.greatest(F.lit(0.0), F.least(F.lit(1.0), filter_rows / row_count))
    return F.when(filter_rows.isNull(), 1.0).when(row_count == 0, 0.0).otherwise(ratio)


def plan_column(row_count: Column, memory_bytes: Column, has_disk_index: Column, filter_rows: Column) -> Column:
    sel = selectivity_column(filter_rows, row_count)
    return (
        F.when(row_count <= BRUTE_FORCE_ROWS, BRUTE)
        .when((memory_bytes > MEMORY_BYTES) & has_disk_index, DISK)
        .when(filter_rows.isNotNull() & (sel < PREFILTER_SELECTIVITY), PRE)
        .when(filter_rows.isNotNull(), POST)
        .otherwise(GRAPH)
    )


def cost_columns(row_count: Column, k: Column, filter_rows: Column) -> dict[str, Column]:
    sel, depth, n = selectivity_column(filter_rows, row_count), F.ln(row_count.cast("double")) + 1, row_count.cast("double")
    return {
        BRUTE: n,
        GRAPH: depth * F.greatest(2 * k, F.lit(64)) * 1.5,
        DISK: depth * F.greatest(3 * k, F.lit(64)) * 4,
        PRE: depth * k * 2 * F.when(sel < 0.05, 8.0).otherwise(2 / (sel + 0.1)),
        POST: depth * F.least(k / F.greatest(sel, F.lit(0.001)), n) * 1.5,
    }


def refreshed(vectors: DataFrame, dim: int, has_disk_index: bool = False) -> Stats:
    """Statistics of a table as it is now."""
    n = vectors.count()
    return Stats(n, n * (4 * dim + 16), has_disk_index)
