"""Train, validation and test parts of a log."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..frame import EDGE, NODE_X, NODE_Y, EventLog


class SplitStrategy:
    """Names the parts, in order, and which events each one has."""

    def parts(self, log: EventLog) -> list[tuple[str, Column]]:
        raise NotImplementedError

    def apply(self, log: EventLog) -> tuple[EventLog, ...]:
        """The parts that have an edge; the node table is shared.  One pass counts the edges of all."""
        parts = self.parts(log)
        counts = log.events.agg(*(F.count_if((F.col("kind") == EDGE) & test).alias(name) for name, test in parts)).first()
        return tuple(replace(log.where(test), split=None) for name, test in parts if counts[name])


@dataclass(frozen=True)
class TemporalSplit(SplitStrategy):
    """Before ``val_time``, from there to ``test_time``, and from there on."""

    val_time: int
    test_time: int

    def __post_init__(self) -> None:
        if not 0 <= self.val_time <= self.test_time:
            raise ValueError(f"a split needs 0 <= val_time <= test_time, not {self.val_time} and {self.test_time}")

    def parts(self, log: EventLog | None = None) -> list[tuple[str, Column]]:
        t = F.col("t")
        return [("train", t < self.val_time), ("val", (t >= self.val_time) & (t < self.test_time)), ("test", t >= self.test_time)]


@dataclass(frozen=True)
class TemporalRatioSplit(SplitStrategy):
    """Shares of the time span, events of all kinds counted in."""

    train_ratio: float = 0.7
    val_ratio: float = 0.15
    test_ratio: float = 0.15

    def __post_init__(self) -> None:
        ratios = (self.train_ratio, self.val_ratio, self.test_ratio)
        if min(ratios) < 0 or abs(sum(ratios) - 1) > 1e-6:
            raise ValueError(f"ratios must not be negative and must add up to 1: {ratios}")

    def temporal(self, first: int, last: int) -> TemporalSplit:
        span = last - first + 1
        val = first + int(span * self.train_ratio)
        return TemporalSplit(val, val + int(span * self.val_ratio))

    def parts(self, log: EventLog) -> list[tuple[str, Column]]:
        first, last = log.events.agg(F.min("t"), F.max("t")).first()
        return self.temporal(first, last).parts()


@dataclass(frozen=True)
class BoundsSplit(SplitStrategy):
    """Given bounds (first, last) of the edges of each part; labels of first - 1 to before last; every node feature in each part."""

    bounds: dict[str, tuple[int, int]]

    def __hash__(self) -> int:
        return hash(tuple(sorted(self.bounds.items())))

    def parts(self, log: EventLog | None = None) -> list[tuple[str, Column]]:
        t, kind = F.col("t"), F.col("kind")
        test = lambda lo, hi: ((kind == EDGE) & t.between(lo, hi)) | (kind == NODE_X) | ((kind == NODE_Y) & (t >= lo - 1) & (t < hi))
        return [(name, test(*self.bounds[name])) for name in ("train", "val", "test") if name in self.bounds]


def split(log: EventLog, strategy: SplitStrategy | None = None) -> tuple[EventLog, ...]:
    """Split by ``strategy``, else by the data's own, else by ratio; given bounds of a benchmark cannot be overridden."""
    own = log.split
    if isinstance(own, BoundsSplit) and strategy is not None and not isinstance(strategy, BoundsSplit):
        raise ValueError("the data come with bounds of their own, which no other split may replace")
    return (strategy or own or TemporalRatioSplit()).apply(log)
