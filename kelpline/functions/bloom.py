"""Bloom filters whose bits are set by CRC-32 of key and seed."""

from __future__ import annotations

import math
import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: most hash functions of a filter.
MAX_HASHES = 30
#: What each seed, 8 bytes after the key, changes in the CRC-32 of a key followed by 8 zero bytes.
SEEDS = [zlib.crc32(seed.to_bytes(8, "little")) ^ zlib.crc32(bytes(8)) for seed in range(256)]


def size_for(n_keys: int, rate: float) -> tuple[int, int]:
    """(bytes, hashes) of a filter for n keys; (0, 0) for none."""
    if n_keys == 0:
        return 0, 0
    m = math.ceil(-n_keys * math.log(rate) / math.log(2) ** 2)
    return -(-m // 8), min(MAX_HASHES, max(1, round(m / n_keys * math.log(2))))


def build(keys: list[bytes], rate: float = 0.01) -> tuple[bytes, int]:
    n, k = size_for(len(keys), rate)
    bits = bytearray(n)
    for key in keys:
        for seed in range(k):
            at = zlib.crc32(seed.to_bytes(8, "little"), zlib.crc32(key)) % (8 * n)
            bits[at >> 3] |= 1 << (at & 7)
    return bytes(bits), k


def may_contain(key: Column, bits: Column, k: Column) -> Column:
    """Whether the filter may hold the key, in SQL expressions alone. A filter that is null, empty, or
    without hashes (or with more than SEEDS has) says nothing, so the answer is true."""
    n_bits = F.octet_length(bits) * 8
    unseeded = F.crc32(F.concat(key, F.lit(bytes(8))))  # the key is hashed once: a CRC's seed only adds its own bits

    def one(seed: Column) -> Column:
        at = F.pmod(unseeded.bitwiseXOR(seed), n_bits)
        byte = F.conv(F.hex(F.substring(bits, F.shiftright(at, 3).cast("int") + 1, 1)), 16, 10).cast("int")
        return F.getbit(byte, (at % 8).cast("int")) == 1

    usable = bits.isNotNull() & (F.octet_length(bits) > 0) & (F.coalesce(k, F.lit(0)) > 0) & (k <= len(SEEDS))
    return F.when(usable, F.forall(F.slice(F.array(*map(F.lit, SEEDS)), 1, F.greatest(k, F.lit(1))), one)).otherwise(True)


def probe(keys: DataFrame, files: DataFrame) -> DataFrame:
    """For keys routed to a file (``file_id, user_key``): the filter's answer. ``files`` may list a file
    more than once; the longest filter is taken (of several the greatest k, then bytes)."""
    one = files.groupBy("file_id").agg(F.max(F.struct(F.octet_length("bits").alias("n"), "k", "bits")).alias("f"))
    return keys.join(one, "file_id", "left").withColumn("may_contain", may_contain(F.col("user_key"), F.col("f.bits"), F.col("f.k"))).drop("f")
