"""Has this key been seen before? Minimal perfect hashing over sealed partitions, with fingerprints.

Keys already stored are hashed to partitions of bounded size. Each partition is sealed: a minimal
perfect hash maps its n keys to the slots 0..n-1 (about 3 bits a key), and a fingerprint array keeps
32 bits of a second hash per slot. A key is looked up by going to its partition, computing its slot
and comparing fingerprints, so neither the keys nor a hash table of them is held. A key that is there
is always found; one that isn't is taken for seen with probability 2**-32 at most, which is measured.

An index is kept in a folder: each ``add`` seals one batch of keys as a segment, and publishes a manifest
that names all segments. Stored keys are read once, when they are added; look-ups open the sealed
partitions alone. All segments have the same number of partitions, chosen for the keys expected in all,
so a look-up shuffles the asked keys once, whatever the number of segments.

The hash is built level by level: at each level the remaining keys are hashed to a bit array twice
their number; keys alone at their bit stay there, the others go on. A key's slot is the rank of
its bit among all set bits. Every step is an array operation.

The current batch is exact: the batch is first reduced to its distinct keys, each with its first
probe_id (combined on the map side, so a key with a third of all probes costs one row per task).
"""

from __future__ import annotations

import json
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kelpline.session import materialize
from kelpline.sources.fs import Folder

GAMMA = 2.0
MAX_LEVELS = 64
KEYS_PER_PARTITION = 100_000
FINGERPRINT_BITS = 32
SEALED_SCHEMA = "part INT, n_keys BIGINT, level_bits ARRAY<INT>, bits BINARY, fingerprints BINARY, extras BINARY"
#: Widths at which the rate of wrong answers is measured: a prefix of a fingerprint is a shorter fingerprint.
WIDTHS = (4, 8, 12, 16, 20, 24, 28, 32)
ABSENT_KEYS = 1 << 20

# Multipliers of the 64-bit finaliser used to mix level numbers into a hash.
_MIX_A, _MIX_B, _STEP = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray, level: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = h + _STEP * np.uint64(level + 1)
        x ^= x >> np.uint64(33)
        x *= _MIX_A
        x ^= x >> np.uint64(33)
        x *= _MIX_B
        return x ^ (x >> np.uint64(33))


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit integers."""

    def __init__(self, level_bits: list[int], bits: np.ndarray):
        self.level_bits, self.bits = level_bits, bits
        self.starts = np.concatenate([[0], np.cumsum(level_bits)]).astype(np.int64)
        self.ranks = np.cumsum(bits, dtype=np.int32)

    @classmethod
    def build(cls, hashes: np.ndarray) -> PerfectHash:
        """``hashes``: distinct uint64. Distinct values part at some level; 64 levels never were needed."""
        rest, sizes, parts = hashes, [], []
        for level in range(MAX_LEVELS):
            if not len(rest):
                break
            m = max(64, int(np.ceil(GAMMA * len(rest) / 64)) * 64)
            at = (_mix(rest, level) % np.uint64(m)).astype(np.int64)
            alone = np.bincount(at, minlength=m) == 1
            sizes.append(m)
            parts.append(alone)
            rest = rest[~alone[at]]
        if len(rest):
            raise ValueError("hashes are not distinct")
        return cls(sizes, np.concatenate(parts) if parts else np.zeros(0, bool))

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        """The slot of each hash; -1 if no level has its bit, so it certainly is not in the set."""
        out = np.full(len(hashes), -1, np.int64)
        rest = np.arange(len(hashes))
        for level, m in enumerate(self.level_bits):
            if not len(rest):
                break
            at = self.starts[level] + (_mix(hashes[rest], level) % np.uint64(m)).astype(np.int64)
            hit = self.bits[at]
            out[rest[hit]] = self.ranks[at[hit]] - 1
            rest = rest[~hit]
        return out


def hashed(keys: DataFrame, column: str, n_parts: int) -> DataFrame:
    """Adds ``part``, ``h1`` (slot hash) and ``h2`` (fingerprint) of a binary key: three hashes with seeds of their own."""
    own = lambda seed: F.xxhash64(F.lit(seed), F.col(column))
    return keys.withColumns({"part": F.pmod(own(3), F.lit(n_parts)).cast("int"), "h1": own(1), "h2": own(2)})


def seal(keys: DataFrame, column: str, n_parts: int) -> DataFrame:
    """One row per partition with its perfect hash and fingerprints; ``keys`` may repeat keys.

    Null keys are not stored. Of keys whose 64-bit slot hashes are equal only the first can have the
    slot; to lose none, the hashes of the others go to a list beside the array (``extras``), empty
    in practice.
    """
    pairs = hashed(keys.where(F.col(column).isNotNull()).select(column), column, n_parts).select("part", "h1", "h2").distinct()

    def build(df: pd.DataFrame) -> pd.DataFrame:
        h1, h2 = df["h1"].to_numpy(np.int64).view(np.uint64), df["h2"].to_numpy(np.int64).view(np.uint64)
        first = np.unique(h1, return_index=True)[1]
        extra = np.setdiff1d(np.arange(len(h1)), first)
        mph = PerfectHash.build(h1[first])
        prints = np.zeros(len(first), np.uint32)
        prints[mph.slots(h1[first])] = (h2[first] >> np.uint64(64 - FINGERPRINT_BITS)).astype(np.uint32)
        return pd.DataFrame({
            "part": [df["part"].iloc[0]], "n_keys": [len(h1)], "level_bits": [list(map(int, mph.level_bits))],
            "bits": [np.packbits(mph.bits).tobytes()], "fingerprints": [prints.tobytes()],
            "extras": [np.stack([h1[extra], h2[extra]], 1).tobytes()],
        })

    return pairs.groupBy("part").applyInPandas(build, SEALED_SCHEMA)


def agreed_bits(sealed: pd.DataFrame, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """How many leading bits of each key's fingerprint agree with that at its slot, the most over the sealed
    segments of one partition; -1 if no segment has a slot for it."""
    out = np.full(len(h1), -1, np.int64)
    for r in sealed.itertuples(index=False):
        mph = PerfectHash(list(r.level_bits), np.unpackbits(np.frombuffer(r.bits, np.uint8)).astype(bool)[: int(sum(r.level_bits))])
        slots = mph.slots(h1)
        prints = np.frombuffer(r.fingerprints, np.uint32)
        at = np.flatnonzero(slots >= 0)
        differ = prints[slots[at]] ^ (h2[at] >> np.uint64(64 - FINGERPRINT_BITS)).astype(np.uint32)
        same = np.where(differ == 0, FINGERPRINT_BITS, FINGERPRINT_BITS - 1 - np.floor(np.log2(np.maximum(differ, 1).astype(np.float64))).astype(np.int64))
        out[at] = np.maximum(out[at], same)
        if len(r.extras):
            known = {tuple(e) for e in np.frombuffer(r.extras, np.uint64).reshape(-1, 2).tolist()}
            out[[i for i, e in enumerate(zip(h1.tolist(), h2.tolist())) if e in known]] = FINGERPRINT_BITS
    return out


class SeenIndex:
    """The sealed keys of all batches added so far, below one folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.folder = spark, path.rstrip("/"), Folder(spark, path)

    @classmethod
    def create(cls, spark: SparkSession, path: str, expected_keys: int, keys_per_partition: int = KEYS_PER_PARTITION) -> SeenIndex:
        """An empty index for about so many keys in all; with more it still is right, but partitions are larger."""
        index = cls(spark, path)
        index._publish({"version": 0, "n_parts": max(1, -(-expected_keys // keys_per_partition)), "segments": []})
        return index

    def _publish(self, manifest: dict) -> None:
        self.folder.write_new(f"_manifest/{manifest['version']:08d}.json", json.dumps(manifest))

    def manifest(self) -> dict:
        newest = max(n for n in self.folder.names("_manifest") if n.endswith(".json"))
        return json.loads(self.folder.read_text(f"_manifest/{newest}"))

    def add(self, keys: DataFrame, column: str = "user_key") -> None:
        """Seal a batch of keys (which may repeat, or hold nulls) as the next segment. Of two writers at
        once the second one fails."""
        m = self.manifest()
        segment = f"segment-{uuid.uuid4().hex}"
        seal(keys, column, m["n_parts"]).write.parquet(f"{self.path}/{segment}")
        self._publish(m | {"version": m["version"] + 1, "segments": [*m["segments"], segment]})

    def sealed(self) -> DataFrame:
        paths = [f"{self.path}/{s}" for s in self.manifest()["segments"]]
        return self.spark.read.schema(SEALED_SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SEALED_SCHEMA)

    def look_up(self, probes: DataFrame, column: str = "user_key") -> DataFrame:
        """Adds ``agreed`` (see ``agreed_bits``) and ``seen`` to rows of distinct non-null keys; others are kept."""
        names = list(probes.columns)
        schema = T.StructType([*probes.schema.fields, T.StructField("agreed", T.IntegerType()), T.StructField("seen", T.BooleanType())])

        def run(df: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
            out = df[names].copy()
            h1, h2 = df["h1"].to_numpy(np.int64).view(np.uint64), df["h2"].to_numpy(np.int64).view(np.uint64)
            out["agreed"] = agreed_bits(s, h1, h2).astype(np.int32) if len(df) else np.zeros(0, np.int32)
            out["seen"] = out["agreed"] == FINGERPRINT_BITS
            return out

        asked = hashed(probes, column, self.manifest()["n_parts"])
        return asked.groupBy("part").cogroup(self.sealed().groupBy("part")).applyInPandas(run, schema)


def first_probes(probes: DataFrame) -> DataFrame:
    """The distinct non-null keys of the batch, each with its smallest probe_id."""
    return probes.where("user_key IS NOT NULL AND probe_id IS NOT NULL").groupBy("user_key").agg(F.min("probe_id").alias("first_id"))


def seen_probes(probes: DataFrame, index: SeenIndex) -> DataFrame:
    """The probe_ids whose key is in the index or came in a probe of a smaller probe_id.

    A probe with a null key is never seen; one without a probe_id has no place in the order and isn't asked. A probe is new only if it is the first of its key and the
    index denies the key, so the answer is an anti join on the unique probe_id: no key is hot in it.
    Empty tables give empty results. The index alone decides: no stored key is read.
    """
    new = index.look_up(first_probes(probes)).where(~F.col("seen")).select(F.col("first_id").alias("new_id"))
    return probes.where("user_key IS NOT NULL AND probe_id IS NOT NULL").select("probe_id").join(new, F.col("probe_id") == F.col("new_id"), "left_anti")


def error_rate(probes: DataFrame, stored: DataFrame, index: SeenIndex, n_absent: int = ABSENT_KEYS) -> DataFrame:
    """For measuring: the answers to the batch's distinct keys and to ``n_absent`` made-up keys, against the stored
    keys themselves. A row for each width of fingerprint: ``bits, n_keys, n_stored, n_false_no, n_absent, n_false_yes,
    false_yes_rate, low, high, expected``; low and high are Wilson's 95 % interval. ``expected`` is the rate for keys
    that have a slot in every segment; some have none."""
    made = probes.sparkSession.range(n_absent).select(F.encode(F.concat(F.lit("absent:"), F.sha2(F.col("id").cast("string").cast("binary"), 256)), "UTF-8").alias("user_key"))
    asked = first_probes(probes).select("user_key").union(made).distinct()
    answered = materialize(index.look_up(asked), "looked-up")
    true = answered.select(F.col("user_key").alias("k")).join(stored.select("user_key"), F.col("k") == F.col("user_key"), "left_semi").withColumn("stored", F.lit(True))
    rows = answered.join(true, F.col("user_key") == F.col("k"), "left").select("agreed", F.coalesce("stored", F.lit(False)).alias("stored"))
    at = rows.groupBy("agreed", "stored").count().withColumn("bits", F.explode(F.array(*map(F.lit, WIDTHS))))
    yes, n = F.col("agreed") >= F.col("bits"), lambda c: F.coalesce(F.sum(F.when(c, F.col("count"))), F.lit(0))
    per = at.groupBy("bits").agg(
        F.sum("count").alias("n_keys"), n(F.col("stored")).alias("n_stored"), n(F.col("stored") & ~yes).alias("n_false_no"),
        n(~F.col("stored")).alias("n_absent"), n(~F.col("stored") & yes).alias("n_false_yes"))
    z, m, p = 1.96, F.greatest(F.col("n_absent"), F.lit(1)), F.col("n_false_yes") / F.greatest(F.col("n_absent"), F.lit(1))
    middle, half = (p + z * z / (2 * m)) / (1 + z * z / m), z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m)) / (1 + z * z / m)
    return per.withColumns({"false_yes_rate": p, "low": F.greatest(middle - half, F.lit(0.0)), "high": middle + half, "expected": F.lit(float(len(index.manifest()["segments"]))) * F.pow(F.lit(2.0), -F.col("bits"))})
