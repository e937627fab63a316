"""A disk index as four Parquet tables: graph, full vectors, quantised codes, codebook. Built offline, then fixed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpline.functions.distance import l2_distance
from kelpline.operators import graph, knn, pq
from kelpline.sources.fs import Folder

PARTS = ("graph", "vectors", "codes", "codebook")


class ReadOnlyIndex(RuntimeError):
    """Raised by insert and delete: the index is a snapshot, and is built anew to change it."""


class DiskIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.graph, self.vectors, self.codes, self.codebook = (spark.read.parquet(f"{self.path}/{p}") for p in PARTS)

    @classmethod
    def build(cls, vectors: DataFrame, path: str, m: int = 8, centroids: int = pq.CENTROIDS, **options) -> DiskIndex:
        """Write the index of ``shard, vec_id, embedding``. A folder that holds an index isn't overwritten."""
        spark = vectors.sparkSession
        if Folder(spark, path).exists("codebook/_SUCCESS"):
            raise FileExistsError(path)
        book = pq.train(vectors, m, centroids)
        graph.build(vectors, "flat", **options).write.parquet(f"{path}/graph")
        vectors.select("shard", "vec_id", "embedding").sortWithinPartitions("vec_id").write.parquet(f"{path}/vectors")
        pq.encode(vectors, book).write.parquet(f"{path}/codes")
        pq.codebook_frame(spark, book).write.parquet(f"{path}/codebook")
        return cls(spark, path)

    def book(self) -> pq.Codebook:
        return pq.load_codebook(self.codebook, len(self.codebook.first()["centroid"]))

    def search(self, query: list[float], k: int, rerank_factor: int = 10, ids: DataFrame | None = None, radius: float | None = None) -> DataFrame:
        """Coarse pass over the codes, exact rerank, cut to k; then ids and radius, without fetching more."""
        found = pq.two_stage(self.vectors, self.codes, query, self.book(), k, rerank_factor)
        if ids is not None:
            found = found.join(ids.select("vec_id").distinct(), "vec_id", "left_semi")
        return found if radius is None else found.where(F.col("distance") <= radius)

    def search_graph(self, queries: DataFrame, k: int, ef: int = 100) -> DataFrame:
        return graph.search(self.vectors, self.graph, queries, k, ef)

    def search_beam(self, queries: DataFrame, k: int, ef: int = 100, rerank_factor: int = 10) -> DataFrame:
        """``query_id, vec_id, distance, rank`` for ``query_id, vector``: the graph is walked by the vectors that the codes stand
        for, which is what fits in memory; of what is met the nearest are ranked again by the full vectors."""
        coded = self.vectors.select("shard", "vec_id").join(pq.decode(self.codes, self.book()), "vec_id")
        met = graph.search(coded, self.graph, queries, rerank_factor * k, ef).select("query_id", "vec_id")
        full = met.join(self.vectors.select("vec_id", "embedding"), "vec_id").join(queries.select("query_id", "vector"), "query_id")
        exact = full.select("query_id", "vec_id", l2_distance(F.col("embedding"), F.col("vector")).alias("distance"))
        return knn.top_k(exact.groupBy("query_id", "vec_id").agg(F.min("distance").alias("distance")), ["query_id"], k)

    def search_range(self, query: list[float], radius: float) -> DataFrame:
        return knn.within(self.vectors, query, radius)

    def in_memory_bytes(self) -> int:
        """Codes, 16 bytes a vector, and the codebook."""
        n, m = self.codes.agg(F.count("*"), F.max(F.size("codes"))).first()
        book = self.codebook.agg(F.sum(F.size("centroid") * 4)).first()[0]
        return int((n or 0) * ((m or 0) + 16) + (book or 0))

    def stats(self) -> dict:
        return {"index_type": "disk", "num_vectors": self.vectors.count(), "memory_bytes": self.in_memory_bytes()}

    def insert(self, *_):
        raise ReadOnlyIndex("insert")

    def delete(self, *_):
        raise ReadOnlyIndex("delete")
