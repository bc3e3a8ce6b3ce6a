"""Coarser time: one event for each bucket and key."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import EventOrderedConversionError, InvalidDiscretizationError
from ..frame import COLUMNS, EDGE, EventLog
from ..functions.ranking import global_rank
from ..functions.scalar import bucket
from ..timedelta import TimeDelta

REDUCTIONS = ("first", "last", "sum", "mean", "max", "count")
_KEY = ["t", "kind", "src", "dst", "nid"]


def discretise(log: EventLog, delta: TimeDelta | str | None, reduce_op: str = "first", exact: bool = False) -> EventLog:
    """The log at granularity ``delta``, anchored at time 0.

    Edges are keyed by bucket, source and destination (not type), node features and labels by bucket and node,
    each kind for itself.  ``first`` keeps the earliest event in the log's order and its payload, ``last`` the
    latest; the others combine the payload's elements (``count``: a vector of one number).  Buckets are the
    floor of a double product; ``exact`` divides whole numbers.
    """
    if reduce_op not in REDUCTIONS:
        raise ValueError(f"unknown reduction {reduce_op!r}; one of {REDUCTIONS}")
    if delta is None or TimeDelta.of(delta) == log.delta:
        return log.clone()
    delta = TimeDelta.of(delta)
    if log.delta.is_event_ordered or delta.is_event_ordered:
        raise EventOrderedConversionError("a granularity that only orders events cannot be made coarser, nor be the coarser one")
    if log.delta.is_coarser_than(delta):
        raise InvalidDiscretizationError(f"{delta} is finer than the data's {log.delta}")
    ratio = log.delta.ratio(delta)
    t = bucket(F.col("t"), log.delta.convert(delta), (ratio.numerator, ratio.denominator) if exact else None)
    bucketed = log.events.withColumn("t", t)
    kept = first_events(bucketed, reduce_op == "last") if reduce_op in ("first", "last") else _combined(bucketed, reduce_op)
    ranked = global_rank(kept.withColumnRenamed("event_idx", "__old"), ["t", "kind", "__old"], "event_idx").select(*COLUMNS)
    return replace(log, events=ranked, delta=delta, bounds=(None, None), dense=True)


def first_events(bucketed: DataFrame, last: bool = False) -> DataFrame:
    """The first (last) event of each key: ids by a hash aggregate of numbers, then the payload by a semi join on them."""
    pick = F.max if last else F.min
    chosen = bucketed.groupBy(*_KEY).agg(pick("event_idx").alias("event_idx")).select("event_idx")
    return bucketed.join(chosen, "event_idx", "left_semi")


def _combined(bucketed: DataFrame, reduce_op: str) -> DataFrame:
    keys = bucketed.groupBy(*_KEY).agg(F.min("event_idx").alias("event_idx"), F.count("*").alias("__n"))
    if reduce_op == "count":
        one = F.array(F.col("__n").cast("float"))
        vectors = keys.select("event_idx", *(F.when(test, one).alias(c) for c, test in (("edge_x", F.col("kind") == EDGE), ("x", F.col("kind") == 1), ("y", F.col("kind") == 2))))
    else:
        payload = F.coalesce("edge_x", "x", "y")
        op = {"sum": F.sum, "mean": F.avg, "max": F.max}[reduce_op]
        elements = bucketed.select(*_KEY, F.posexplode(payload).alias("pos", "v")).groupBy(*_KEY, "pos").agg(op("v").cast("float").alias("v"))
        merged = elements.groupBy(*_KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda e: e["v"]).alias("__v"))
        same = F.lit(True)
        for c in _KEY:
            same = same & keys[c].eqNullSafe(merged[c])
        vectors = keys.join(merged, same, "left").select(keys["event_idx"], *(F.when(keys["kind"] == k, F.col("__v")).alias(c) for k, c in enumerate(("edge_x", "x", "y"))))
    plain = [c for c in COLUMNS if c not in ("edge_x", "x", "y")]
    return bucketed.select(*plain).join(vectors, "event_idx")
