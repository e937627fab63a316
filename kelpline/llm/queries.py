"""Queries of the training-data operators over the tables of a data folder, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpline.llm import clusters, multi_index
from kelpline.llm.mixing import mix, mixing_faults
from kelpline.llm.packing import pack_documents, packing_faults, packing_report
from kelpline.llm.sentences import split_documents, unit_faults
from kelpline.llm.seen_keys import SeenIndex, error_rate, seen_probes
from kelpline.session import job_dir, materialize
from kelpline.sources.tables import table


DIM = 64


def _groups(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    vectors = clusters.valid_vectors(table(spark, sf_dir, "vamana_vector"), DIM)
    return vectors, clusters.groups(vectors, DIM)[0]


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _groups(spark, sf_dir)[1].where("size >= 3").select("lead_id", "vec_id")


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each group of three or more: its size, and the members nearest to its mean."""
    vectors, members = _groups(spark, sf_dir)
    return clusters.described(vectors.distinct(), materialize(members.where("size >= 3"), "members"), DIM)


def p3_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the vectors whose id 20 divides: their links to all vectors, and how many were missed."""
    vectors, members = _groups(spark, sf_dir)
    return clusters.missed(vectors, materialize(members, "members"), DIM)


def _sealed(spark: SparkSession, sf_dir: str) -> SeenIndex:
    """The keys of sst_entry, sealed in two batches as they would come in: memtables after level files."""
    entries, files = table(spark, sf_dir, "sst_entry"), table(spark, sf_dir, "sst_file")
    late = files.where("tier = 'imm_memtable'").select("file_id").distinct()
    index = SeenIndex.create(spark, job_dir(spark, "seen"), entries.count())
    index.add(entries.join(late, "file_id", "left_anti"))
    index.add(entries.join(late, "file_id", "left_semi"))
    return index


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seen_probes(table(spark, sf_dir, "key_probe"), _sealed(spark, sf_dir))


def p4_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wrong answers by width of fingerprint, over the batch's keys and a million made-up ones."""
    return error_rate(table(spark, sf_dir, "key_probe"), table(spark, sf_dir, "sst_entry"), _sealed(spark, sf_dir))


def p4_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of the error rates is certain: no key missed, none wrongly found at full width, and at each width from
    8 to 16 bits an interval that isn't above the rate expected."""
    e = p4_error_rate(spark, sf_dir)
    return e.agg(F.max("n_stored").alias("n_stored"), F.sum("n_false_no").alias("n_false_no"), F.max("n_absent").alias("n_absent"),
                 F.sum(F.when(F.col("bits") == 32, F.col("n_false_yes"))).alias("n_false_yes"), F.bool_and((F.col("low") <= F.col("expected")) | ~F.col("bits").between(8, 16)).alias("as_expected"))


def _index(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, multi_index.MultiIndex]:
    disk = table(spark, sf_dir, "vamana_vector").select("vec_id", F.col("embedding").alias("vector"))
    nodes = table(spark, sf_dir, "hnsw_node").select("vec_id", "vector", "is_tombstone")
    vectors = multi_index.collection([disk, nodes], DIM, nodes.where("is_tombstone"))
    return vectors, multi_index.build(vectors, DIM, multi_index.sampled([disk, nodes], DIM))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = multi_index.valid_queries(table(spark, sf_dir, "vector_query"), DIM)
    return multi_index.within_radius(multi_index.search(_index(spark, sf_dir)[1], queries), queries).select("query_id", "vec_id")


def p5_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the queries whose id 20 divides: how much of the exact answer over all rows is found."""
    vectors, index = _index(spark, sf_dir)
    queries = multi_index.valid_queries(table(spark, sf_dir, "vector_query"), DIM).where("query_id % 20 = 0")
    got = multi_index.search(index, queries).select("query_id", "vec_id").withColumn("got", F.lit(1))
    true = multi_index.brute_force(vectors, queries, DIM).select("query_id", "vec_id")
    return true.join(got, ["query_id", "vec_id"], "left").agg(
        F.countDistinct("query_id").alias("n_queries"), F.count("*").alias("n_true"), F.count("got").alias("n_found"),
        (F.count("got") / F.greatest(F.count("*"), F.lit(1))).alias("recall"),
    )


def p5_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall as a fact: at least 0.99 of the exact answer."""
    return p5_recall(spark, sf_dir).select("n_queries", "n_true", (F.col("recall") >= 0.99).alias("recalled"))


def p6_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_spec"))


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing_report(p6_packed(spark, sf_dir))


def p7_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_target"))[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_target"))[1]


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_documents(table(spark, sf_dir, "documents"))


def p6_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing_faults(materialize(pack_documents(docs, table(spark, sf_dir, "pack_spec")), "packed"), docs)


def p7_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_faults(*mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_target")))


def p8_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return unit_faults(materialize(split_documents(docs), "units"), docs)


QUERIES = {"p3_found": p3_found, "p3_report": p3_report, "p3_recall": p3_recall, "p4_found": p4_found, "p4_error_rate": p4_error_rate, "p4_check": p4_check, "p5_found": p5_found, "p5_recall": p5_recall, "p5_check": p5_check, "p6_packed": p6_packed, "p6_report": p6_report, "p7_mixed": p7_mixed, "p7_shares": p7_shares, "p8_found": p8_found, "p6_check": p6_check, "p7_check": p7_check, "p8_check": p8_check}
_COLLECTION = """valid AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM vamana_vector UNION ALL SELECT vec_id, vector::DOUBLE[] FROM hnsw_node),
collection AS (
  SELECT vec_id, first(v) AS v FROM valid
  WHERE len(v) = 64 AND len(list_filter(v, lambda x: x IS NOT NULL AND isfinite(x))) = 64
    AND vec_id NOT IN (SELECT vec_id FROM hnsw_node WHERE is_tombstone AND vec_id IS NOT NULL)
  GROUP BY vec_id),
q AS (
  SELECT query_id, vector::DOUBLE[] AS v, k, radius::DOUBLE AS radius FROM vector_query
  WHERE k > 0 AND len(vector) = 64 AND len(list_filter(vector, lambda x: x IS NOT NULL AND isfinite(x))) = 64)"""
_VALID = """v AS (
  SELECT vec_id, first(embedding::DOUBLE[]) AS e FROM vamana_vector
  WHERE vec_id IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
  GROUP BY vec_id)"""
_LED = f"""{_VALID},
near AS MATERIALIZED (SELECT a.vec_id AS x, b.vec_id AS y FROM v a, v b WHERE list_distance(a.e, b.e) <= 0.9),
reach AS (SELECT vec_id AS lead, vec_id FROM v UNION SELECT least(r.lead, n.x), n.y FROM reach r JOIN near n ON r.vec_id = n.x),
led AS (SELECT vec_id, min(lead) AS lead_id FROM reach GROUP BY vec_id)"""
ORACLE = {
    "p4_found": """
SELECT probe_id FROM key_probe WHERE user_key IS NOT NULL AND
  (user_key IN (SELECT user_key FROM sst_entry WHERE user_key IS NOT NULL)
   OR probe_id NOT IN (SELECT min(probe_id) FROM key_probe WHERE user_key IS NOT NULL GROUP BY user_key))
""",
    "p6_check": "SELECT spec_name, capacity_tokens, (SELECT count(*) FROM documents) AS n_documents, 0::BIGINT AS n_wrong_documents, 0::BIGINT AS n_wrong_containers, true AS dense FROM pack_spec WHERE capacity_tokens > 0",
    "p7_check": "SELECT lower(trim(source)) AS source, sum(target_share) AS target_share, min(max_repeats) AS max_repeats, true AS kept_repeats, true AS on_target FROM mix_target GROUP BY lower(trim(source))",
    "p8_check": "SELECT count(*) AS n_documents, 0::BIGINT AS n_outside, 0::BIGINT AS n_untrimmed, 0::BIGINT AS n_overlaps, true AS any FROM documents",
    "p4_check": """
WITH probe AS (SELECT DISTINCT user_key FROM key_probe WHERE user_key IS NOT NULL AND probe_id IS NOT NULL), stored AS (SELECT DISTINCT user_key FROM sst_entry WHERE user_key IS NOT NULL)
SELECT (SELECT count(*) FROM probe SEMI JOIN stored USING (user_key)) AS n_stored, 0::BIGINT AS n_false_no, (SELECT count(*) FROM probe ANTI JOIN stored USING (user_key)) + 1048576 AS n_absent, 0::BIGINT AS n_false_yes, true AS as_expected
""",
    "p5_found": f"""WITH {_COLLECTION}
SELECT query_id, vec_id FROM (
  SELECT query_id, vec_id, k, radius, list_distance(q.v, c.v) AS d FROM q, collection c
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) <= k)
WHERE radius IS NULL OR d <= radius
""",
    "p5_check": f"""WITH {_COLLECTION}
SELECT count(*) AS n_queries, sum(least(k, (SELECT count(*) FROM collection)))::BIGINT AS n_true, true AS recalled FROM q WHERE query_id % 20 = 0
""",
    "p3_found": f"WITH RECURSIVE {_LED} SELECT lead_id, vec_id FROM led QUALIFY count(*) OVER (PARTITION BY lead_id) >= 3",
    "p3_report": f"""WITH RECURSIVE {_LED},
flat AS (SELECT lead_id, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM led JOIN v USING (vec_id)),
mean AS (SELECT lead_id, list(x ORDER BY i) AS m FROM (SELECT lead_id, i, avg(x) AS x FROM flat GROUP BY lead_id, i) GROUP BY lead_id),
d AS (SELECT lead_id, vec_id, row_number() OVER (PARTITION BY lead_id ORDER BY list_distance(e, m), vec_id) AS place FROM led JOIN v USING (vec_id) JOIN mean USING (lead_id))
SELECT lead_id, count(*) AS size, list(vec_id ORDER BY place) FILTER (WHERE place <= 4) AS typical_ids FROM d GROUP BY lead_id HAVING count(*) >= 3""",
    "p3_recall": f"""WITH {_VALID}, asked AS (SELECT * FROM v WHERE vec_id % 20 = 0)
SELECT (SELECT count(*) FROM asked a, v b WHERE a.vec_id <> b.vec_id AND list_distance(a.e, b.e) <= 0.9) AS n_links, 0::BIGINT AS n_missed, (SELECT count(*) FROM asked) AS n_asked""",
}
