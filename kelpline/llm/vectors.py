"""Vectors as packed float32 bytes: validation, sampling and k-means on bounded samples."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def packed(df: DataFrame, key: str, vector: str, dim: int, carry: list[str] | None = None) -> DataFrame:
    """The rows whose vector is valid (exactly ``dim`` elements, all finite and non-null), with the
    vector as ``v``: its float32 values, little-endian. Keys are unchecked but for null, which is dropped."""
    names = [key, *(carry or [])]
    chosen = df.where(F.col(key).isNotNull()).select(*names, F.col(vector).alias("v"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.select(*names).schema), "v BINARY"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(len(names))
            right = pc.fill_null(pc.equal(pc.list_value_length(lists), dim), False)
            b = b.filter(right)
            flat = b.column(len(names)).flatten()
            x = flat.to_numpy(zero_copy_only=False).astype("<f4", copy=False).reshape(-1, dim)
            ok = np.isfinite(x).all(axis=1)
            b, x = b.filter(pa.array(ok)), np.ascontiguousarray(x[ok])
            offsets = np.arange(len(x) + 1, dtype=np.int32) * (4 * dim)
            v = pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(x)])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], v], names=[*names, "v"])

    return chosen.mapInArrow(run, schema)


def unpack(column: Iterable[bytes], dim: int) -> np.ndarray:
    """A float32 matrix of packed vectors."""
    return np.frombuffer(b"".join(column), "<f4").reshape(-1, dim)


def fixed_sample(df: DataFrame, key: str, n_rows: int, size: int, dim: int, vector: str) -> np.ndarray:
    """At most ``size`` valid vectors of distinct keys of a table of about ``n_rows``, chosen by a hash of the key, so
    the same rows give the same sample however they are ordered, repeated or split."""
    h = F.pmod(F.xxhash64(key, F.lit(11)), F.lit(1 << 30))
    part = df if n_rows <= size else df.where(h < int((1 << 30) * min(1.0, 1.3 * size / n_rows)))
    rows = packed(part, key, vector, dim).groupBy(key).agg(F.min("v").alias("v")).select(h.alias("h"), "v").orderBy("h", "v").limit(size).collect()
    return unpack((r.v for r in rows), dim) if rows else np.zeros((0, dim), np.float32)


def kmeans(x: np.ndarray, k: int, steps: int = 12, seed: int = 7) -> np.ndarray:
    """Lloyd's centroids of ``x``, begun at distinct random rows; fewer than k if x has fewer distinct rows."""
    x = x.astype(np.float64)
    distinct = np.unique(x, axis=0)
    c = np.random.default_rng(seed).permutation(distinct)[:k]
    for _ in range(steps if len(c) < len(distinct) else 0):
        near = ((c * c).sum(1) - 2 * x @ c.T).argmin(1)
        n = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c
