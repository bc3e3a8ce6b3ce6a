"""Memories over unbounded logs that are bounded themselves: state by key with timers, reset by epoch, and a start from a batch log.

Streams have rows ``src, dst, t`` (whole seconds) and ``query`` (null for an edge, else an id of what is asked).  A trigger is
an update: what is asked sees what earlier triggers have brought.  State needs the RocksDB provider (``SETTINGS``).

* **Clock.**  The time of the latest edge of earlier triggers is the stream's watermark, which is global: ``late`` is added to
  it.  Edges up to ``late`` older than the clock enter at their own time; older ones are dropped by Spark.
* **Bounds.**  What has left the window is removed by a timer, also where a key gets no more rows.
* **Epochs.**  With a column ``epoch``, a greater one than the key's clears the key's state before its rows are read.  As times
  then begin anew, the stream brings the clock itself (column ``clock``), and a key is cleaned when it is read.
* **Hand-over.**  ``initial``: a batch table of the memory as training left it, read before the first trigger.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SETTINGS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}

SCORES = "query long, src long, dst long, last_t long, score double"
DRAWS = "query long, src long, neg long, valid boolean"
FIGURES = "nid long, epoch long, degree long, new_neighbors long, appearances long, first_t long, last_t long"


def _seconds(interval: str) -> int:
    return int(pd.Timedelta(interval).total_seconds())


class _Keyed(StatefulProcessor):
    """State of one key: the epoch, and a map whose values are whole numbers."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.epoch = handle.getValueState("epoch", "epoch long")
        self.held = handle.getMapState("held", "other long", "value long")

    def parts(self, rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The rows of each epoch in turn, after the state of the epoch before has been cleared."""
        for epoch, part in pd.concat(list(rows)).groupby("epoch", sort=True):
            known = self.epoch.get()[0] if self.epoch.exists() else None
            if known is not None and epoch < known:
                continue  # of an epoch that is over
            if known != epoch:
                if known is not None:
                    self.held.clear()
                self.epoch.update((int(epoch),))
            yield part

    def close(self) -> None:
        pass


class _EdgeBank(_Keyed):
    def __init__(self, size: int | None, late: int, end: int | None, pos_prob: float, watermark: bool):
        self.size, self.late, self.end, self.pos_prob, self.watermark = size, late, end, pos_prob, watermark

    def _clock(self, timers) -> int | None:
        """The latest time of earlier triggers and of what was handed over."""
        mark = timers.getCurrentWatermarkInMs() // 1000
        known = [x for x in (self.end, mark + self.late if mark > 0 else None) if x is not None]
        return max(known, default=None)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        for dst, t in zip(initialState["dst"], initialState["t"], strict=True):
            self._enter(int(dst), int(t))
        self.epoch.update((0,))

    def _enter(self, dst: int, t: int) -> None:
        old = self.held.getValue((dst,)) if self.held.containsKey((dst,)) else None
        if old is None or old[0] < t:  # an edge that comes late does not make a pair older
            self.held.updateValue((dst,), (t,))
            if self.size is not None and self.watermark:
                self.handle.registerTimer((t + self.size) * 1000 + 1)

    def _clean(self, start: float) -> None:
        for dst, t in [(k[0], v[0]) for k, v in self.held.iterator()]:
            if t < start:
                self.held.removeKey((dst,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for part in self.parts(rows):
            clock = self._clock(timerValues) if self.watermark else None if part["clock"].isna().all() else int(part["clock"].min())
            start = None if self.size is None or clock is None else clock - self.size
            asked, edges = part[part["query"].notna()], part[part["query"].isna()]
            if len(asked):
                last = {}
                for dst in asked["dst"].unique().tolist():
                    held = self.held.getValue((dst,)) if self.held.containsKey((dst,)) else None
                    last[dst] = held[0] if held is not None and (start is None or held[0] >= start) else None
                found = asked["dst"].map(last)
                yield pd.DataFrame({"query": asked["query"].astype("int64"), "src": key[0], "dst": asked["dst"], "last_t": found.astype("Int64"), "score": found.notna() * self.pos_prob})
            if start is not None and not self.watermark:
                self._clean(start)
            for dst, t in edges.groupby("dst")["t"].max().items():
                if start is None or t >= start:
                    self._enter(int(dst), int(t))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if (clock := self._clock(timerValues)) is not None:
            self._clean(clock - self.size)
        return iter(())


def _columns(stream: DataFrame, watermark: bool) -> DataFrame:
    epoch = F.coalesce(F.col("epoch").cast("long"), F.lit(0)) if "epoch" in stream.columns else F.lit(0).cast("long")
    if watermark:
        return stream.withColumn("epoch", epoch).select("ts", "src", "dst", "t", "query", "epoch")
    if "clock" not in stream.columns:
        raise ValueError("a stream with epochs brings its clock: a column clock")
    return stream.withColumn("epoch", epoch).select("src", "dst", "t", "query", "epoch", "clock")


def edgebank(stream: DataFrame, size: int | None = None, late: str = "0 seconds", end: int | None = None, pos_prob: float = 1.0, initial: DataFrame | None = None) -> DataFrame:
    """Columns ``SCORES`` for each row that asks: ``pos_prob`` if the pair was seen - within the last ``size`` seconds if that is given - else 0.

    ``end``: the latest time of what was handed over.  ``initial``: ``src, dst, t`` of the pairs at the start (``remembered``).
    State is a time for each pair in the window.
    """
    watermark = "epoch" not in stream.columns
    rows = _columns(stream.withColumn("ts", F.timestamp_seconds("t")).withWatermark("ts", late) if watermark else stream, watermark)
    started = None if initial is None else initial.select("src", "dst", F.col("t").cast("long").alias("t")).groupBy("src")
    processor = _EdgeBank(size, _seconds(late), end, pos_prob, watermark)
    return rows.groupBy("src").transformWithStateInPandas(processor, SCORES, "Append", "EventTime" if watermark else "None", started)


def remembered(edges: DataFrame, size: int | None = None) -> tuple[DataFrame, int | None]:
    """What a memory of a batch log holds, to start a stream from: ``src, dst, t`` of the pairs in the window, and the log's latest time."""
    last = edges.groupBy("src", "dst").agg(F.max("t").alias("t"))
    end = edges.agg(F.max("t")).first()[0]  # one number
    return (last if size is None or end is None else last.where(F.col("t") >= end - size)), end


def _hashed(*parts: int) -> int:
    """``functions.scalar.hashed`` of whole numbers."""
    state = 7
    for p in parts:
        state = ((state * 1_103_515_245 + 12_345) % 2_147_483_647 + p % 2_147_483_647) * 48_271 % 2_147_483_647
    return state


class _Historical(_Keyed):
    def __init__(self, seed: int):
        self.seed = seed

    def handleInitialState(self, key, initialState, timerValues) -> None:
        for dst, n in zip(initialState["dst"], initialState["n"], strict=True):
            self.held.updateValue((int(dst),), (int(n),))
        self.epoch.update((0,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for part in self.parts(rows):
            asked, edges = part[part["query"].notna()], part[part["query"].isna()]
            if len(asked):
                counts = sorted((k[0], v[0]) for k, v in self.held.iterator())
                total, drawn = sum(n for _, n in counts), {}
                for query in asked["query"].astype("int64").unique().tolist() if total else []:
                    place = 1 + _hashed(key[0], query, self.seed) % total
                    for dst, n in counts:
                        place -= n
                        if place <= 0:
                            drawn[query] = dst
                            break
                neg = asked["query"].astype("int64").map(drawn)
                yield pd.DataFrame({"query": asked["query"].astype("int64"), "src": key[0], "neg": neg.fillna(-1).astype("int64"), "valid": neg.notna()})
            for dst, n in edges["dst"].value_counts().items():
                old = self.held.getValue((int(dst),)) if self.held.containsKey((int(dst),)) else None
                self.held.updateValue((int(dst),), (int(n) + (old[0] if old is not None else 0),))


def historical_negatives(stream: DataFrame, seed: int = 0, initial: DataFrame | None = None) -> DataFrame:
    """Columns ``DRAWS`` for each row that asks: a destination of the source's edges of earlier triggers, each edge as likely as another; -1 if there is none.

    Draws are those of ``negatives.historical_negatives`` with ``query`` as batch, where all edges are of iterations before.
    ``initial``: ``src, dst, n``.  State is a count for each distinct pair.
    """
    rows = _columns(stream if "epoch" in stream.columns else stream.withColumn("epoch", F.lit(0)).withColumn("clock", F.lit(None).cast("long")), False)
    started = None if initial is None else initial.select("src", "dst", "n").groupBy("src")
    return rows.groupBy("src").transformWithStateInPandas(_Historical(seed), DRAWS, "Append", "None", started)


class _Figures(_Keyed):
    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.times = handle.getMapState("times", "t long", "seen long")
        self.total = handle.getValueState("total", "appearances long, first_t long, last_t long")

    def __init__(self, late: int):
        self.late = late

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for part in self.parts(rows):
            epoch, met = int(part["epoch"].iloc[0]), self.total.get() if self.total.exists() else None
            if met is not None and not self.held.exists():  # cleared with the epoch
                met = None
                self.times.clear()
            n, first, last = met if met is not None else (0, None, None)
            fresh = [t for t in sorted(int(t) for t in part["t"].unique()) if not self.times.containsKey((t,))]
            for t in fresh:
                self.times.updateValue((t,), (1,))
            others = [int(x) for x in part["other"].unique().tolist()]
            new = [x for x in others if not self.held.containsKey((x,))]
            for x in new:
                self.held.updateValue((x,), (1,))
            first = min(int(part["t"].min()), first if first is not None else 1 << 62)
            last = max(int(part["t"].max()), last if last is not None else -1)
            for t in [k[0] for k in self.times.keys() if k[0] < last - self.late]:  # no row of that time comes any more
                self.times.removeKey((t,))
            self.total.update((n + len(fresh), first, last))
            yield pd.DataFrame({"nid": [key[0]], "epoch": [epoch], "degree": [len(part)], "new_neighbors": [len(new)], "appearances": [n + len(fresh)], "first_t": [first], "last_t": [last]})


def node_figures(stream: DataFrame, late: str = "0 seconds") -> DataFrame:
    """Columns ``FIGURES`` of each node that a trigger's edges touch: ends of edges, neighbours met for the first time, distinct times so far, first and last time.

    A node's rows may be ``late`` older than its latest one; of its times only those since are kept.  State is a flag for each
    distinct neighbour.
    """
    epoch = F.coalesce(F.col("epoch").cast("long"), F.lit(0)) if "epoch" in stream.columns else F.lit(0).cast("long")
    ends = F.array(F.struct(F.col("src").alias("nid"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("nid"), F.col("src").alias("other")))
    rows = stream.select("t", epoch.alias("epoch"), F.explode(ends).alias("e")).select("t", "epoch", "e.*")
    return rows.groupBy("nid").transformWithStateInPandas(_Figures(_seconds(late)), FIGURES, "Append", "None")
