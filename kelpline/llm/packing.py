"""Filling containers of fixed capacity with documents, by bounded-space online packing.

Documents are spread over partitions by a hash of doc_id. Each partition keeps a fixed number of open
windows: a document goes to the window it fits best (least space left); when none fits and all
windows are open, the fullest is emitted and a new one opened. What is still open at the end of a
partition is merged over ``FAN_IN`` partitions at a time, largest first, in as many rounds as
leave one group: so no task ever holds more than FAN_IN * WINDOWS windows.

A document larger than the capacity fills whole containers of its own and its rest is an item; no
other document is divided. Repeated rows, and documents without an id that have one text, are spread
over partitions too, so no group of copies is one task. A document without tokens (null or empty text) is an item of size 0, so
every document is in some container, as is one without a doc_id. Repeated rows are items each. Specs with a null or non-positive
capacity are left out; of equal names each distinct capacity counts.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpline.llm.tokens import VOCABULARY, token_counts
from kelpline.session import materialize

WINDOWS = 32
FAN_IN = 16
NO_ID = -(2**63)
DOCS_PER_PARTITION = 25_000
#: Copies of one document that go to a partition together.
COPIES = 256
SCHEMA = "spec_name STRING, capacity_tokens INT, grp INT, open BOOLEAN, container_id STRING, place INT, doc_id BIGINT, tok_start BIGINT, tok_end BIGINT, fill BIGINT"

Piece = tuple[int, int, int]  # doc_id, tok_start, tok_end


class Windows:
    """Open windows, ordered by the space left."""

    def __init__(self, limit: int | None):
        self.limit = limit
        self.order: list[tuple[int, int]] = []  # (space left, number)
        self.held: dict[int, list[Piece]] = {}
        self.opened = 0

    def put(self, pieces: list[Piece], size: int, capacity: int) -> list[Piece] | None:
        """Place an item; returns the contents of a window that had to be emitted."""
        at, out = bisect_left(self.order, (size, -1)), None
        if at < len(self.order):
            left, w = self.order.pop(at)
        else:
            if self.limit is not None and len(self.order) >= self.limit:
                out = self.held.pop(self.order.pop(0)[1])
            left, w = capacity, self.opened
            self.opened += 1
            self.held[w] = []
        self.held[w] += pieces
        insort(self.order, (left - size, w))
        return out

    def rest(self) -> list[list[Piece]]:
        """What is open, fullest first."""
        return [self.held[w] for _, w in self.order]


def pack(items: Iterator[tuple[int, int]], capacity: int, windows: int = WINDOWS) -> tuple[list[list[Piece]], list[list[Piece]]]:
    """Pack ``(doc_id, size)`` in the given order: (emitted containers, windows still open)."""
    done, w = [], Windows(windows)
    for doc, size in items:
        start = 0
        while size - start > capacity:
            done.append([(doc, start, start + capacity)])
            start += capacity
        out = w.put([(doc, start, size)], size - start, capacity)
        if out is not None:
            done.append(out)
    return done, w.rest()


def merge(leftovers: list[list[Piece]], capacity: int, keep: int) -> tuple[list[list[Piece]], list[list[Piece]]]:
    """Merge part-filled windows, largest first; of the result the ``keep`` emptiest stay open."""
    w, size = Windows(None), lambda c: sum(e - s for _, s, e in c)
    for c in sorted(leftovers, key=lambda c: (-size(c), c)):
        w.put(c, size(c), capacity)
    rest = w.rest()
    cut = max(0, len(rest) - keep)
    return rest[:cut], rest[cut:]


def _rows(spec: str, capacity: int, grp: int, tag: str, done: list, still_open: list) -> pd.DataFrame:
    rows = []
    for n, (o, c) in enumerate([*((False, c) for c in done), *((True, c) for c in still_open)]):
        fill = sum(e - s for _, s, e in c)
        rows += [(spec, capacity, grp, o, f"{tag}.{grp}.{n}", p, *piece, fill) for p, piece in enumerate(c)]
    return pd.DataFrame(rows, columns=["spec_name", "capacity_tokens", "grp", "open", "container_id", "place", "doc_id", "tok_start", "tok_end", "fill"])


def _joiner(level: int, last: bool):
    def join(df: pd.DataFrame) -> pd.DataFrame:
        spec, capacity, grp = df["spec_name"].iloc[0], int(df["capacity_tokens"].iloc[0]), int(df["grp"].iloc[0])
        df = df.sort_values(["container_id", "place"])
        windows = [list(zip(g["doc_id"].tolist(), g["tok_start"].tolist(), g["tok_end"].tolist())) for _, g in df.groupby("container_id", sort=True)]
        return _rows(spec, capacity, grp, str(level), *merge(windows, capacity, 0 if last else WINDOWS))

    return join


def pack_documents(docs: DataFrame, specs: DataFrame, vocabulary: str = VOCABULARY, docs_per_partition: int = DOCS_PER_PARTITION) -> DataFrame:
    """``spec_name, capacity_tokens, container_id, place, doc_id, tok_start, tok_end, fill, unused``."""
    wanted = [(r.spec_name, r.capacity_tokens) for r in specs.where("capacity_tokens > 0").distinct().orderBy("spec_name", "capacity_tokens").limit(1000).collect()]
    if len(wanted) == 1000:
        raise ValueError("1000 specs or more in one run")
    named = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), F.xxhash64("doc_id", "text").alias("h"), "text")  # no nulls, so ids stay integers in pandas
    sizes = materialize(token_counts(named, vocabulary, ("h",)), "tokens")
    groups = max(1, -(-sizes.count() // docs_per_partition))
    copies = sizes.groupBy("doc_id", "h", "n_tokens").agg(F.count("*").alias("copies"))
    part = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("copies") - 1) / COPIES))).alias("part")
    items = copies.select("doc_id", "h", "n_tokens", "copies", part).withColumn("copies", F.least(F.lit(COPIES), F.col("copies") - F.col("part") * COPIES))

    windows = WINDOWS

    def first(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["doc_id", "n_tokens", "h", "part"])
        df = df.loc[df.index.repeat(df["copies"])]
        items = list(zip(df["doc_id"].tolist(), df["n_tokens"].tolist()))
        return pd.concat([_rows(s, c, int(df["grp"].iloc[0]), "0", *pack(iter(items), c, windows)) for s, c in wanted] or [_rows("", 0, 0, "", [], [])])

    placed = items.withColumn("grp", F.pmod(F.xxhash64("h", "part"), F.lit(groups)).cast("int")).groupBy("grp").applyInPandas(first, SCHEMA)
    placed, level, done = materialize(placed, "packed-0"), 0, []
    while True:
        done.append(placed.where("NOT open"))
        groups, level, last = -(-groups // FAN_IN), level + 1, groups <= FAN_IN
        left = placed.where("open").withColumn("grp", F.floor(F.col("grp") / FAN_IN).cast("int"))
        placed = materialize(left.groupBy("spec_name", "capacity_tokens", "grp").applyInPandas(_joiner(level, last), SCHEMA), f"packed-{level}")
        if last:
            done.append(placed)
            break
    rows = done[0]
    for d in done[1:]:
        rows = rows.unionByName(d)
    rows = rows.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))
    return rows.drop("grp", "open").withColumn("unused", F.col("capacity_tokens") - F.col("fill"))


def packing_report(packed: DataFrame) -> DataFrame:
    """Per spec: containers, tokens, unused space, and the fewest containers that could do."""
    one = packed.where("place = 0").groupBy("spec_name", "capacity_tokens").agg(
        F.count("*").alias("n_containers"), F.sum("fill").alias("n_tokens"), F.sum("unused").alias("unused_tokens"))
    return one.withColumns({
        "unused_share": F.col("unused_tokens") / (F.col("n_containers") * F.col("capacity_tokens")),
        "fewest_possible": F.ceil(F.col("n_tokens") / F.col("capacity_tokens")),
    })


def packing_faults(packed: DataFrame, docs: DataFrame, spare: float = 0.05) -> DataFrame:
    """Per spec, for checking: ``n_documents``, documents whose tokens aren't each in one container, or that are divided
    without need (``n_wrong_documents``), containers that hold more than their capacity or not what they say
    (``n_wrong_containers``), and whether the containers are at most the fewest possible, ``spare`` of these and one more
    (``dense``). Ids must be unique."""
    keys, size = ["spec_name", "capacity_tokens"], F.col("tok_end") - F.col("tok_start")
    per = packed.groupBy(*keys, "doc_id").agg(F.sum(size).alias("n"), F.max("tok_end").alias("end"), F.min("tok_start").alias("start"), F.count("*").alias("pieces"))
    wrong = (F.col("n") != F.col("end")) | (F.col("start") != 0) | ((F.col("end") <= F.col("capacity_tokens")) & (F.col("pieces") > 1))
    of_docs = docs.select("doc_id").join(per, "doc_id", "full").groupBy(*keys).agg(F.count("*").alias("n_documents"), F.count_if(F.coalesce(wrong, F.lit(True))).alias("n_wrong_documents"))
    boxes = packed.groupBy(*keys, "container_id").agg(F.sum(size).alias("n"), F.max("fill").alias("fill"))
    bad = (F.col("n") > F.col("capacity_tokens")) | (F.col("n") != F.col("fill"))
    fewest = F.ceil(F.sum("n") / F.first("capacity_tokens"))
    of_boxes = boxes.groupBy(*keys).agg(F.count_if(bad).alias("n_wrong_containers"), (F.count("*") <= (1 + spare) * fewest + 1).alias("dense"))
    return of_docs.join(of_boxes, keys)
