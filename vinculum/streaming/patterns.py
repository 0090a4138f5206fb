"""Streaming forms of batch operators: idempotent intake, chains as transfers arrive, orphan state by micro-batches.

An extension beyond the batch operators; the same inputs give the same rows as their batch forms, late rows within the
watermark included.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vinculum.operators.references import OrphanState, advance


def distinct_records(stream: DataFrame, time: str, key: str, delay: str = "48 hours") -> DataFrame:
    """The first row of each key; the state forgets keys after ``delay``."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def rapid_chains(stream: DataFrame, hours: int = 48, delay: str = "1 hour") -> DataFrame:
    """(a, b, c, first_id, second_id) as both transfers have arrived: a stream-stream join on the middle party within the bound.

    ``stream``: record_id, sender, recipient, ts TIMESTAMP. State is kept for the bound plus ``delay``.
    """
    t = stream.filter("sender <> recipient").withWatermark("ts", delay)
    one = t.select(F.col("sender").alias("a"), F.col("recipient").alias("b"), F.col("record_id").alias("first_id"), F.col("ts").alias("first_ts"))
    two = t.select(F.col("sender").alias("b2"), F.col("recipient").alias("c"), F.col("record_id").alias("second_id"), F.col("ts").alias("second_ts"))
    within = F.expr(f"b = b2 AND second_ts >= first_ts AND second_ts <= first_ts + INTERVAL {int(hours)} HOURS AND a <> c AND first_id <> second_id")
    return one.join(two, within).select("a", "b", "c", "first_id", "second_id")


def meeting_counts(stream: DataFrame, window: str = "2 hours", delay: str = "1 hour") -> DataFrame:
    """(start, place, entities): entities seen at a place per window, for points (entity, location, ts)."""
    w = stream.withWatermark("ts", delay).groupBy(F.window("ts", window), F.lower("location").alias("place"))
    return w.agg(F.approx_count_distinct("entity").alias("entities")).select(F.col("window.start").alias("start"), "place", "entities")


class OrphanTracker:
    """Orphan state fed by micro-batches, for ``foreachBatch``: rows are told apart by ``split`` into references and parents."""

    def __init__(self, state: OrphanState, split: Callable[[DataFrame], tuple[DataFrame, DataFrame]]):
        self.state, self.split, self.seen = state, split, -1

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        if epoch <= self.seen:  # a batch that is repeated after a failure
            return
        self.state = advance(self.state, *self.split(batch))
        self.seen = epoch
