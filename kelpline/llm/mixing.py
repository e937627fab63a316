"""Mixing sources to target shares of tokens, by blocks, multinomial draws and index permutations.

The documents of a source, in an order given by a hash, form one stream of tokens that is cut into
blocks of ``BLOCK_TOKENS`` (the last may be shorter). The output is N slots in shards of
``SLOTS_PER_SHARD``; for each shard the number of slots of each source is drawn from a multinomial
distribution, given the source's total (so no source gets more than it may, or less than it should). The
draws split the range of shards in halves, and their halves in turn, each with its own seed: every task
walks down to its own shards, and the driver holds one number a source. The i-th slot of a source is
block ``perm(i mod n)`` of its n blocks, where perm is a
keyed permutation (a Feistel network) of the pass ``i div n``: within a pass no block comes twice, so a block,
and with it a document, is used at most ``max_repeats`` times. Slots and blocks are joined by index.

A source that cannot reach its share within max_repeats gives all it may, and the others fill the
gap in proportion to their shares; if all are used up, the output is smaller. Sources without a
target, null sources and documents without tokens are not drawn. Repeated rows count each, as do
documents without a doc_id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kelpline.llm.tokens import VOCABULARY, token_counts
from kelpline.session import materialize

BLOCK_TOKENS = 512
SLOTS_PER_SHARD = 16384
DOCS_PER_CHUNK = 50_000
MAX_SOURCES = 10_000


def clean(source):
    return F.lower(F.trim(source))


def feistel(i: np.ndarray, n: int, key: int, rounds: int = 6) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1, applied to ``i``; values outside walk the cycle until inside."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for r in range(rounds):
            with np.errstate(over="ignore"):
                f = right * np.uint64(0x9E3779B97F4A7C15) + np.uint64((key * 0x2545F4914F6CDD1D + r * 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
                f ^= f >> np.uint64(31)
                f *= np.uint64(0xD6E8FEB86659FD93)
                f ^= f >> np.uint64(32)
            left, right = right, left ^ (f & mask)
        return (left << np.uint64(half)) | right

    x = once(i.astype(np.uint64))
    while (out := x >= np.uint64(n)).any():
        x[out] = once(x[out])
    return x.astype(np.int64)


def slot_plan(blocks: dict[str, int], targets: dict[str, tuple[float, int]], n_slots: int) -> dict[str, int]:
    """Slots of each source: its share of n_slots, but at most blocks * max_repeats; what is missing goes to
    the others in proportion to their shares. Whole numbers, in exact arithmetic: the slots that rounding
    down leaves over go to the largest remainders."""
    cap = {s: blocks.get(s, 0) * max(0, r) for s, (_, r) in targets.items()}
    weight = {s: Fraction(t) for s, (t, _) in targets.items()}
    got, open_ = dict.fromkeys(targets, Fraction(0)), {s for s in targets if cap[s] and weight[s] > 0}
    rest = Fraction(min(n_slots, sum(cap[s] for s in open_)))
    while open_ and rest > 0:
        per = rest / sum(weight[s] for s in open_)
        full = {s for s in open_ if per * weight[s] >= cap[s]}
        for s in full or open_:
            got[s] = Fraction(cap[s]) if full else per * weight[s]
            rest -= got[s]
        open_ -= full or open_
    out = {s: int(g) for s, g in got.items()}
    by_remainder = sorted((s for s in targets if out[s] < got[s]), key=lambda s: (out[s] - got[s], s))
    for s in by_remainder[: int(sum(got.values()) - sum(out.values()))]:
        out[s] += 1
    return out


def hypergeometric(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """How many of ``sample`` draws without return from good + bad are good. Beyond the range of numpy's
    generator the normal law of the same mean and variance, cut to what is possible."""
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, sample))
    n = good + bad
    mean = sample * good // n
    sd = math.sqrt(sample / n * good * (bad / n) * ((n - sample) / (n - 1)))
    return min(max(mean + round(sd * float(rng.standard_normal())), sample - bad, 0), good, sample)


def shard_draws(totals: list[int], slots_per_shard: int, seed: int, first: int, last: int) -> Iterator[tuple[int, list[int], list[int]]]:
    """(shard, slots of each source before it, slots of each source in it) of the shards first..last-1.

    All shards but the last have ``slots_per_shard`` slots, all together ``totals``. Given the totals, a
    half's multinomial counts are hypergeometric, source after source; a node's seed is its place, so
    every task draws alike, and walks only to the shards it asks for."""
    n_shards = -(-sum(totals) // slots_per_shard)
    work = [(0, n_shards, [0] * len(totals), list(totals))]
    while work:
        lo, hi, before, counts = work.pop()
        if hi <= first or lo >= last or lo >= hi:
            continue
        if hi - lo == 1:
            yield lo, before, counts
            continue
        mid = (lo + hi) // 2
        rng = np.random.default_rng([seed & 0xFFFFFFFF, lo, hi])
        sample, rest, left = (mid - lo) * slots_per_shard, sum(counts), []
        for c in counts:
            rest -= c
            left.append(hypergeometric(rng, c, rest, sample))
            sample -= left[-1]
        right = [c - z for c, z in zip(counts, left)]
        work.append((mid, hi, [b + z for b, z in zip(before, left)], right))
        work.append((lo, mid, before, left))


def laid_out(docs: DataFrame, targets: DataFrame, vocabulary: str, chunk_docs: int = DOCS_PER_CHUNK) -> DataFrame:
    """``doc_id, source, n_tokens, start``: the place of each drawable document in its source's stream.

    The running sum is made within chunks of about ``chunk_docs`` documents, then over the chunks'
    totals, so a source with a third of all documents is not one task. Repeated rows (and documents without
    an id that have one text) are counted first and laid out one after the other, so they aren't either.
    """
    named = docs.select("doc_id", clean("source").alias("source"), F.xxhash64("doc_id", "text").alias("h"), "text").join(F.broadcast(targets.select("source")), "source", "left_semi")
    sizes = materialize(token_counts(named, vocabulary, ("source", "h")).where("n_tokens > 0"), "tokens")
    chunks = max(1, -(-sizes.count() // chunk_docs))
    h = sizes.groupBy("source", "h", "doc_id", "n_tokens").agg(F.count("*").alias("copies")).withColumn("chunk", F.pmod("h", F.lit(chunks)))
    size = F.col("n_tokens") * F.col("copies")
    totals = h.groupBy("source", "chunk").agg(F.sum(size).alias("total"))
    before = totals.select("source", "chunk", (F.sum("total").over(Window.partitionBy("source").orderBy("chunk")) - F.col("total")).alias("before"))
    w = Window.partitionBy("source", "chunk").orderBy("h", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    each = h.withColumn("within", F.sum(size).over(w) - size).join(before, ["source", "chunk"]).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1)))
    return each.select("doc_id", "source", "n_tokens", (F.col("before") + F.col("within") + F.col("copy") * F.col("n_tokens")).alias("start"))


def read_targets(targets: DataFrame) -> DataFrame:
    """One row per cleaned source (of several the shares add up, the fewest repeats hold); rows with a null
    source or repeats, or a share that isn't positive, are left out. Must be a small table."""
    t = targets.where("source IS NOT NULL AND target_share > 0 AND NOT isnan(target_share) AND max_repeats IS NOT NULL").groupBy(clean(F.col("source")).alias("source")).agg(
        F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))
    if t.limit(MAX_SOURCES + 1).count() > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources have a target")
    return t


def mix(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, vocabulary: str = VOCABULARY, block: int = BLOCK_TOKENS, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(drawn documents, shares).

    Drawn: ``doc_id, source, n_tokens, n_uses, tokens_used``; n_uses is how often the most used block
    of the document is drawn (at most max_repeats), tokens_used its tokens in the output. Shares, per source:
    ``target_share, actual_share, tokens_used, tokens_available, max_repeats, n_documents, limited``.
    ``total_tokens``: size of the output; by default that of all documents of sources with a target.
    """
    spark, targets = docs.sparkSession, read_targets(targets)
    spec = {r.source: (r.target_share, r.max_repeats) for r in targets.collect()}
    placed = materialize(laid_out(docs, targets, vocabulary), "placed")
    have = {r["source"]: r["t"] for r in placed.groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()}
    blocks = {s: -(-t // block) for s, t in have.items()}
    n_slots = -(-(sum(have.values()) if total_tokens is None else total_tokens) // block)
    names = sorted(spec)
    caps = {s: blocks.get(s, 0) * max(0, spec[s][1]) for s in names}
    plan = slot_plan(blocks, spec, n_slots)
    totals = [plan[s] for s in names]
    n_shards = -(-sum(totals) // SLOTS_PER_SHARD)

    def slots(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in it:
            if not len(df):
                continue
            for _, before, counts in shard_draws(totals, SLOTS_PER_SHARD, seed, int(df["id"].min()), int(df["id"].max()) + 1):
                for j, s in enumerate(names):
                    if not counts[j]:
                        continue
                    i, n = np.arange(before[j], before[j] + counts[j]), blocks[s]
                    for turn in np.unique(i // n):
                        at = i[i // n == turn] % n
                        yield pd.DataFrame({"source": s, "block": feistel(at, n, seed * 1_000_003 + j * 1009 + int(turn))})

    ids = spark.range(0, n_shards, numPartitions=max(1, min(n_shards, 8 * spark.sparkContext.defaultParallelism)))  # each task has a run of shards
    uses = ids.mapInPandas(slots, "source STRING, block BIGINT").groupBy("source", "block").agg(F.count("*").alias("uses"))
    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("n_tokens") - 1) / block)
    pieces = placed.withColumn("block", F.explode(F.sequence(first, last)))
    overlap = F.least(F.col("start") + F.col("n_tokens"), (F.col("block") + 1) * block) - F.greatest(F.col("start"), F.col("block") * block)
    got = pieces.join(uses.hint("merge"), ["source", "block"]).groupBy("doc_id", "source", "n_tokens", "start").agg(
        F.max("uses").alias("n_uses"), F.sum(overlap * F.col("uses")).alias("tokens_used"))
    got = got.drop("start")

    def shares(rows: DataFrame) -> DataFrame:
        per = rows.groupBy("source").agg(F.sum("tokens_used").alias("tokens_used"), F.count("*").alias("n_documents"))
        available = spark.createDataFrame([(s, int(have.get(s, 0)), bool(plan[s] >= caps[s])) for s in names], "source STRING, tokens_available BIGINT, limited BOOLEAN")
        whole = F.sum(F.coalesce("tokens_used", F.lit(0))).over(Window.partitionBy(F.lit(1)))
        return targets.join(available, "source").join(per, "source", "left").select(
            "source", "target_share", "max_repeats", "tokens_available", "limited", F.coalesce("tokens_used", F.lit(0)).alias("tokens_used"),
            F.coalesce("n_documents", F.lit(0)).alias("n_documents"), (F.coalesce("tokens_used", F.lit(0)) / F.greatest(whole, F.lit(1))).alias("actual_share"))

    return got, shares(got)


def mixing_faults(drawn: DataFrame, shares: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Per source, for checking: ``source, target_share, max_repeats``, whether no document is used too often (``kept_repeats``),
    and whether the share is what it should be (``on_target``): all that repeats allow, where the source is limited, else its
    part of the rest."""
    most = {r.source: r.n for r in drawn.groupBy("source").agg(F.max("n_uses").alias("n")).collect()}  # a row a source
    rows = shares.collect()
    left = 1 - sum(r.actual_share for r in rows if r.limited)
    weight = sum(r.target_share for r in rows if not r.limited) or 1.0
    out = []
    for r in rows:
        all_used = r.tokens_used == r.tokens_available * max(0, r.max_repeats)
        fair = abs(r.actual_share - left * r.target_share / weight) <= tolerance
        out.append((r.source, r.target_share, r.max_repeats, most.get(r.source, 0) <= max(0, r.max_repeats), bool(all_used if r.limited else fair)))
    return shares.sparkSession.createDataFrame(out, "source STRING, target_share DOUBLE, max_repeats INT, kept_repeats BOOLEAN, on_target BOOLEAN")
