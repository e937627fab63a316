"""Product quantisation, k-means steps, centroids and medoids over ``vec_id, embedding``.

A codebook table is ``s INT, c INT, centroid ARRAY<FLOAT>``. It is model-sized: ``MAX_CODES`` rows are
checked before it goes to the driver. ADC distances are sums of rooted sub-distances.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpline.operators.knn import matrix, nearest

MAX_CODES = 65_536
#: Rows that a codebook's first centroids are drawn from.
SEED_ROWS = 16_384
#: Fixed value: centroids of each subspace in a trained codebook.
CENTROIDS = 256


def nearest_centroid(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The nearest row of c for each row of x, by one matrix product; where its rounding leaves several, they are compared one
    by one, and ties go to the first."""
    if not len(x):
        return np.zeros(0, int)
    d = (c * c).sum(1) - 2 * x @ c.T
    best = d.argmin(1)
    scale = (x * x).sum(1) + (c * c).sum(1).max()
    close = d <= (d[np.arange(len(x)), best] + 1e-12 * scale)[:, None]
    for i in np.flatnonzero(close.sum(1) > 1):
        some = np.flatnonzero(close[i])
        best[i] = some[((x[i] - c[some]) ** 2).sum(1).argmin()]
    return best


@dataclass
class Codebook:
    """Per subspace: the codes in ascending order and their centroids."""

    codes: list[np.ndarray]
    centroids: list[np.ndarray]

    @property
    def m(self) -> int:
        return len(self.codes)

    @property
    def width(self) -> int:
        return self.centroids[0].shape[1]

    def sub_distances(self, x: np.ndarray, s: int) -> np.ndarray:
        """Squared L2 from the s-th part of each row to each centroid."""
        part = x[:, s * self.width : (s + 1) * self.width]
        return ((part[:, None, :] - self.centroids[s][None]) ** 2).sum(2)

    def encode(self, x: np.ndarray) -> np.ndarray:
        return np.stack([self.codes[s][nearest_centroid(x[:, s * self.width : (s + 1) * self.width], self.centroids[s])] for s in range(self.m)], 1)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([self.centroids[s][np.searchsorted(self.codes[s], codes[:, s])] for s in range(self.m)], 1)


def clean_codebook(rows: DataFrame, width: int) -> DataFrame:
    """Each (s, c) once, with a valid centroid (``width`` finite elements); of several the least."""
    ok = F.forall("centroid", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where((F.size("centroid") == width) & ok & F.col("s").isNotNull() & F.col("c").isNotNull()).groupBy("s", "c").agg(F.min("centroid").alias("centroid"))


def load_codebook(rows: DataFrame, width: int) -> Codebook:
    got = clean_codebook(rows, width).orderBy("s", "c").limit(MAX_CODES + 1).collect()
    if len(got) > MAX_CODES:
        raise ValueError(f"more than {MAX_CODES} codes")
    by: dict[int, list] = {}
    for r in got:
        by.setdefault(r.s, []).append((r.c, r.centroid))
    if sorted(by) != list(range(len(by))) or not by:
        raise ValueError("subspaces must be 0..m-1")
    return Codebook([np.array([c for c, _ in by[s]]) for s in range(len(by))], [np.array([v for _, v in by[s]], np.float64) for s in range(len(by))])


def _map(vectors: DataFrame, f, schema: str) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield f(b.column(0), matrix(b.column(1)))

    return vectors.select("vec_id", "embedding").mapInArrow(run, schema)


def encode(vectors: DataFrame, book: Codebook) -> DataFrame:
    return _map(vectors, lambda ids, x: pa.RecordBatch.from_pydict({"vec_id": ids, "codes": pa.array(list(book.encode(x).astype(np.int32)), pa.list_(pa.int32()))}), "vec_id BIGINT, codes ARRAY<INT>")


def decode(coded: DataFrame, book: Codebook) -> DataFrame:
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in it:
            if len(df):
                yield pd.DataFrame({"vec_id": df["vec_id"], "embedding": list(book.decode(np.stack(df["codes"].to_list())))})

    return coded.select("vec_id", "codes").mapInPandas(run, "vec_id BIGINT, embedding ARRAY<DOUBLE>")


def distance_table(query: list[float], book: Codebook) -> list[np.ndarray]:
    """Per subspace the rooted distance of the query's part to each centroid."""
    x = np.asarray(query, np.float64)[None]
    return [np.sqrt(book.sub_distances(x, s)[0]) for s in range(book.m)]


def adc(coded: DataFrame, query: list[float], book: Codebook) -> DataFrame:
    """``vec_id, adc``: the sum over the subspaces of the table entry of the row's code, looked up in Arrow batches."""
    tables = []
    for codes, d in zip(book.codes, distance_table(query, book)):
        dense = np.full(int(codes.max()) + 1, np.nan)
        dense[codes] = d
        tables.append(dense)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                codes = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                yield pa.RecordBatch.from_pydict({"vec_id": b.column(0), "adc": pa.array(sum(t[codes[:, s]] for s, t in enumerate(tables)))})

    return coded.select("vec_id", "codes").mapInArrow(run, "vec_id BIGINT, adc DOUBLE")


def two_stage(vectors: DataFrame, coded: DataFrame, query: list[float], book: Codebook, k: int, rerank_factor: int = 10) -> DataFrame:
    """Coarse pass by ADC to rerank_factor * k rows, then exact distances, then k."""
    coarse = adc(coded, query, book).orderBy("adc", "vec_id").limit(rerank_factor * k).select("vec_id")
    return nearest(vectors, query, k, ids=coarse)


def reconstruction_error(vectors: DataFrame, book: Codebook) -> DataFrame:
    """``vec_id, rmse``: L2 between a vector and its decoded code, over the root of the dimension."""
    return _map(vectors, lambda ids, x: pa.RecordBatch.from_pydict({"vec_id": ids, "rmse": pa.array(np.sqrt(((x - book.decode(book.encode(x))) ** 2).sum(1) / x.shape[1]))}), "vec_id BIGINT, rmse DOUBLE")


def _sums(vectors: DataFrame, centroids: list[np.ndarray]) -> dict[tuple[int, int], tuple[int, np.ndarray]]:
    """(count, sum) of the rows nearest to each centroid, for each subspace; tasks send sums, not rows."""
    width = centroids[0].shape[1]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        total: dict[tuple[int, int], list] = {}
        for b in batches:
            x = matrix(b.column(0))
            for s, c in enumerate(centroids):
                part = x[:, s * width : (s + 1) * width]
                near = nearest_centroid(part, c)
                n, sums = np.bincount(near, minlength=len(c)), np.zeros(c.shape)
                np.add.at(sums, near, part)
                for j in np.flatnonzero(n):
                    t = total.setdefault((s, int(j)), [0, np.zeros(width)])
                    t[0] += int(n[j])
                    t[1] = t[1] + sums[j]
        keys = list(total)
        yield pa.RecordBatch.from_pydict({"s": pa.array([k[0] for k in keys], pa.int32()), "c": pa.array([k[1] for k in keys], pa.int32()), "n": pa.array([total[k][0] for k in keys], pa.int64()), "v": pa.array([total[k][1].tolist() for k in keys], pa.list_(pa.float64()))})

    part = vectors.select("embedding").mapInArrow(run, "s INT, c INT, n BIGINT, v ARRAY<DOUBLE>")
    per = part.select("s", "c", "n", F.posexplode("v").alias("i", "x")).groupBy("s", "c", "i").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    rows = per.groupBy("s", "c").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda z: z["x"]).alias("v")).collect()
    return {(r.s, r.c): (r.n, np.array(r.v)) for r in rows}


def kmeans_step(vectors: DataFrame, centroids: np.ndarray) -> list[tuple[int, int, list[float]]]:
    """One Lloyd step: (centroid, members, new centroid) of the centroids that have members."""
    return [(c, n, (v / n).tolist()) for (_, c), (n, v) in sorted(_sums(vectors, [centroids]).items())]


def seeded(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k rows of x, each drawn with the squared distance to the nearest one drawn before as its weight (k-means++)."""
    out = [x[rng.integers(len(x))]]
    d = ((x - out[0]) ** 2).sum(1)
    while len(out) < k:
        total = d.sum()
        out.append(x[rng.choice(len(x), p=d / total)] if total > 0 else x[rng.integers(len(x))])
        d = np.minimum(d, ((x - out[-1]) ** 2).sum(1))
    return np.array(out)


def train_kmeans(vectors: DataFrame, k: int, max_steps: int = 15, tolerance: float = 1e-4, parts: int = 1, seed: int = 0) -> Codebook:
    """Lloyd's algorithm over all rows, for each of ``parts`` equal parts of the vectors. Begins by k-means++ on about
    SEED_ROWS rows chosen by a hash of vec_id (or 8 a centroid); ends when the centroids move less than the
    tolerance in sum. A centroid without members moves to a random one of those rows."""
    if k * parts > MAX_CODES:
        raise ValueError(f"more than {MAX_CODES} codes")
    n, size = vectors.count(), max(SEED_ROWS, 8 * k)
    h = F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(1 << 30))
    some = vectors if n <= size else vectors.where(h < int((1 << 30) * min(1.0, 1.3 * size / n)))
    sample = np.array([r.embedding for r in some.orderBy(h, "vec_id").limit(size).select("embedding").collect()], np.float64)
    if sample.size == 0 or sample.shape[1] % parts:
        raise ValueError("no vectors, or a dimension that the parts don't divide")
    width, rng = sample.shape[1] // parts, np.random.default_rng(seed)
    cents = [seeded(sample[:, s * width : (s + 1) * width], min(k, len(sample)), rng) for s in range(parts)]
    for _ in range(max_steps):
        moved, sums = 0.0, _sums(vectors, cents)
        for s, c in enumerate(cents):
            for j in range(len(c)):
                m, v = sums.get((s, j), (1, sample[rng.integers(len(sample)), s * width : (s + 1) * width]))
                moved += float(np.linalg.norm(v / m - c[j]))
                c[j] = v / m
        if moved < tolerance:
            break
    return Codebook([np.arange(len(c)) for c in cents], cents)


def train(vectors: DataFrame, m: int, k: int = CENTROIDS, max_steps: int = 15) -> Codebook:
    return train_kmeans(vectors, k, max_steps, parts=m)


def codebook_frame(spark, book: Codebook) -> DataFrame:
    rows = [(s, int(c), [float(x) for x in v]) for s in range(book.m) for c, v in zip(book.codes[s], book.centroids[s])]
    return spark.createDataFrame(rows, "s INT, c INT, centroid ARRAY<DOUBLE>")


def centroid(vectors: DataFrame) -> DataFrame:
    """``pos, mean`` of each dimension; combines on the map side."""
    return vectors.select(F.posexplode("embedding").alias("pos", "x")).groupBy("pos").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def medoid(vectors: DataFrame) -> DataFrame:
    """The row nearest to the mean vector (``dim`` values on the driver)."""
    mean = [r["mean"] for r in centroid(vectors).orderBy("pos").collect()]
    return nearest(vectors, mean, 1) if mean else vectors.select("vec_id").limit(0).withColumn("distance", F.lit(0.0))
