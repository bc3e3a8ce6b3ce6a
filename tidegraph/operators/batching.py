"""Batches and snapshots: a log with a ``batch_id``.

The whole iteration is one DataFrame.  ``for batch in batches`` is a façade for consumers that want one at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import EmptyBatchError, EventOrderedConversionError, InvalidDiscretizationError
from ..frame import EventLog
from ..functions.ranking import global_rank
from ..timedelta import TimeDelta
from ..workspace import keep, release


@dataclass(frozen=True)
class Batches:
    """``events`` with ``batch_id``; how many batches there are, the empty ones counted; and what an empty one means."""

    events: DataFrame
    count: int
    on_empty: str | None = "skip"

    def __len__(self) -> int:
        return self.count

    def spine(self) -> DataFrame:
        """``batch_id`` of every batch, empty or not."""
        return self.events.sparkSession.range(self.count).withColumnRenamed("id", "batch_id")

    def __iter__(self) -> Iterator[DataFrame]:
        """A DataFrame for each batch, to be read before the iteration ends.

        The events are written once in the order of batches, so each batch is a filter that skips all files and row groups but its own.
        """
        stored = keep(self.events.repartitionByRange("batch_id").sortWithinPartitions("batch_id", "event_idx"), "batches")
        filled = {r["batch_id"] for r in stored.select("batch_id").distinct().toLocalIterator()}
        for b in range(self.count):
            if b not in filled and self.on_empty == "raise":
                raise EmptyBatchError(f"batch {b} has no event")
            if b in filled or self.on_empty is None:
                yield stored.where(F.col("batch_id") == b)
        release(stored)


def batched(log: EventLog, size: int = 1, unit: str = "r", on_empty: str | None = "skip", drop_last: bool = False, strict: bool = False) -> Batches:
    """Batches of ``size`` events (unit ``r``), or of ``size`` units of time from the view's start.

    Event batches number the view's own events.  ``drop_last`` leaves out an incomplete last batch; with
    ``strict`` a complete one at the very end too.
    """
    if size <= 0:
        raise ValueError(f"a batch needs a positive size, not {size}")
    if on_empty not in ("skip", "raise", None):
        raise ValueError(f"on_empty must be skip, raise or None, not {on_empty!r}")
    if unit == "r":
        rows = log.events if log.dense else global_rank(log.events.withColumnRenamed("event_idx", "__old"), ["__old"], "event_idx").drop("__old")
        start, stop, width, place = 0, log.events.count(), size, F.col("event_idx")
    else:
        wanted = TimeDelta(unit, size)
        if log.delta.is_event_ordered:
            raise EventOrderedConversionError("a graph that only orders its events has no batches of time")
        if log.delta.is_coarser_than(wanted):
            raise InvalidDiscretizationError(f"batches of {wanted} are finer than the data's {log.delta}")
        rows, width, place = log.events, int(wanted.convert(log.delta)), F.col("t")
        start, stop = _span(log)
    span = stop - start
    count = -(-span // width)
    if drop_last:
        count = max(0, -(-(span - width) // width)) if strict else span // width
    events = rows.withColumn("batch_id", F.expr(f"cast((({'event_idx' if unit == 'r' else 't'}) - {start}) div {width} as bigint)")).where(place < start + count * width)
    return Batches(events, count, on_empty)


def _span(log: EventLog) -> tuple[int, int]:
    """First time and one past the last: the bounds asked for, else observed; nothing where there is no event."""
    start, stop = log.bounds
    if start is None or stop is None:
        first, last = log.events.agg(F.min("t"), F.max("t")).first()
        if first is None:
            return 0, 0
        start, stop = first if start is None else start, last + 1 if stop is None else stop
    return start, stop


def batch_sizes(batches: Batches) -> DataFrame:
    """``batch_id, n_edges, n_node_x, n_node_y``; where empty batches count, a row of zeros for each."""
    kinds = (("n_edges", 0), ("n_node_x", 1), ("n_node_y", 2))
    sums = batches.events.groupBy("batch_id").agg(*(F.count_if(F.col("kind") == k).alias(n) for n, k in kinds))
    if batches.on_empty is None:
        sums = batches.spine().join(sums, "batch_id", "left").fillna(0)
    return sums
