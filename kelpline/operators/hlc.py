"""Hybrid logical clocks: local events by running maxima, received messages by the rule's closed form.

A node's events are cut into runs of CHUNK values of the order column; windows run within the runs, and over one
row a run. So the history of a node that holds a third of all events is no single task's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


CHUNK = 1 << 16


def _numbered(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Adds ``place``, the row's number within its keys in order, from 1."""
    chunked = rows.withColumn("chunk", F.floor(F.col(order) / CHUNK))
    sizes = chunked.groupBy(*keys, "chunk").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy(*keys).orderBy("chunk")) - F.col("n")).drop("n")
    within = F.row_number().over(Window.partitionBy(*keys, "chunk").orderBy(order))
    return chunked.withColumn("within", within).join(before, [*keys, "chunk"]).withColumn("place", F.col("before") + F.col("within")).drop("chunk", "before", "within")


def local_events(events: DataFrame, node: str, order: str, wall: str, initial: int = 0) -> DataFrame:
    """Adds (physical, logical) to the local events of each node's clock, which begins at (initial, 0).

    physical is the running maximum of the wall clock; logical counts the events since it last rose (from
    1 for events that never exceed the initial value).
    """
    chunked = events.withColumn("chunk", F.floor(F.col(order) / CHUNK))
    tops = chunked.groupBy(node, "chunk").agg(F.max(wall).alias("top"))
    carried = tops.withColumn("carried", F.max("top").over(Window.partitionBy(node).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))).drop("top")
    w = Window.partitionBy(node, "chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = chunked.join(carried, [node, "chunk"]).withColumn("physical", F.greatest(F.max(wall).over(w), F.col("carried"), F.lit(initial))).drop("chunk", "carried")
    started = F.when(F.col("physical") == initial, 0).otherwise(1)
    return _numbered(rows, [node, "physical"], order).withColumn("logical", F.col("place") - started).drop("place")


def received(state_p: Column, state_l: Column, msg_p: Column, msg_l: Column, wall: Column) -> tuple[Column, Column]:
    """(physical, logical) after a message; a null message is a local event of the same clock."""
    p = F.greatest(state_p, F.coalesce(msg_p, state_p), wall)
    own, theirs = p == state_p, F.coalesce(p == msg_p, F.lit(False))
    logical = (
        F.when(own & theirs, F.greatest(state_l, msg_l) + 1).when(own, state_l + 1).when(theirs, msg_l + 1).otherwise(F.lit(0).cast("bigint"))
    )
    return p, logical


def receive_sequence(messages: DataFrame, node: str, order: str, wall: str, msg_p: str, msg_l: str) -> DataFrame:
    """The final clock of each node after its messages in order, begun at (0, 0).

    The fold of ``received`` over n messages has a closed form. Its physical part is the maximum P of all walls and
    messages. Since the physical part became P, at message t (0 if it never was less), each message has raised the
    logical part by one, or to one more than its own where its physical part is P: so the logical part is the greatest of
    n - t and, over such messages i, of their own + 1 + n - i.
    """
    rows = messages.select(F.col(node), F.col(order), F.greatest(F.lit(0), F.coalesce(F.greatest(F.col(wall), F.col(msg_p)), F.lit(0))).alias("seen"), F.col(msg_p).alias("p"), F.col(msg_l).alias("l"))
    top = rows.groupBy(node).agg(F.max("seen").alias("physical"), F.count("*").alias("n"))
    at_top = _numbered(rows, [node], order).join(top, node).where((F.col("seen") == F.col("physical")) | (F.col("physical") == 0))
    since = F.when(F.max("physical") == 0, F.lit(0)).otherwise(F.min("place"))
    own = F.max(F.when(F.col("p") == F.col("physical"), F.col("l") + 1 - F.col("place")))
    last = at_top.groupBy(node).agg(F.max("physical").cast("bigint").alias("physical"), F.max("n").alias("n"), since.alias("since"), own.alias("own"))
    return last.select(node, "physical", F.greatest(F.col("n") - F.col("since"), F.col("n") + F.col("own")).cast("bigint").alias("logical"))


def before(a_p: Column, a_l: Column, b_p: Column, b_l: Column) -> Column:
    """Whether timestamp a is less than b."""
    return (a_p < b_p) | ((a_p == b_p) & (a_l < b_l))
