"""The data model: one time-ordered log of edges, node features and node labels.

``EventLog`` is a DataFrame of events with metadata.  The order is total: time, then kind (edges, node features,
labels), then input order; ``event_idx`` is the place in it.  Logs are immutable; views filter them.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import EmptyGraphError, InvalidNodeIDError
from .functions.ranking import global_rank
from .timedelta import TimeDelta

EDGE, NODE_X, NODE_Y = 0, 1, 2
COLUMNS = {"event_idx": "long", "t": "long", "kind": "int", "src": "long", "dst": "long", "edge_x": "array<float>", "edge_type": "int", "nid": "long", "x": "array<float>", "y": "array<float>"}
_OF_KIND = {EDGE: ("t", "src", "dst", "edge_x", "edge_type"), NODE_X: ("t", "nid", "x"), NODE_Y: ("t", "nid", "y")}
_NEEDED = {EDGE: ("t", "src", "dst"), NODE_X: ("t", "nid"), NODE_Y: ("t", "nid")}
_INTEGRAL = ("tinyint", "smallint", "int", "bigint")


def _part(rows: DataFrame, kind: int, order: list[str]) -> DataFrame:
    types = dict(rows.dtypes)
    for c in _NEEDED[kind]:
        if c not in types:
            raise ValueError(f"events of kind {kind} need the column {c}")
        if types[c] not in _INTEGRAL:
            raise TypeError(f"{c} must hold whole numbers, not {types[c]}")
    of_kind = [(F.col(c) if c in types and c in (*_OF_KIND[kind], "t") else F.lit(None)).cast(t).alias(c) for c, t in COLUMNS.items() if c not in ("event_idx", "kind")]
    ordinals = [F.col(c) for c in order] or [F.monotonically_increasing_id()]
    return rows.select(*of_kind, F.lit(kind).alias("kind"), *(o.alias(f"__o{kind}_{i}") for i, o in enumerate(ordinals)))  # of their own types: each kind has its columns


@dataclass(frozen=True)
class EventLog:
    """Events (``COLUMNS``), nodes (``nid, static_x, node_type``; or None), granularity, and the split that belongs to the data."""

    events: DataFrame
    delta: TimeDelta = TimeDelta("r")
    nodes: DataFrame | None = None
    split: object | None = None
    bounds: tuple[int | None, int | None] = (None, None)  # times that were asked for, end exclusive
    dense: bool = True  # whether event_idx counts the events from 0 without gaps: not so in a view

    @classmethod
    def of(
        cls,
        edges: DataFrame,
        node_x: DataFrame | None = None,
        node_y: DataFrame | None = None,
        nodes: DataFrame | None = None,
        delta: TimeDelta | str = "r",
        order: dict[int, list[str]] | None = None,
        validate: bool = True,
    ) -> EventLog:
        """Join events of three kinds to one log.

        ``order`` names, by kind, columns that order events of one time and kind; without, the order in which
        Spark reads them.  Feature columns are cast to float, types to int; columns that are not of the kind are left.
        """
        parts = [_part(rows, kind, (order or {}).get(kind, [])) for kind, rows in ((EDGE, edges), (NODE_X, node_x), (NODE_Y, node_y)) if rows is not None]
        whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        log = cls.of_events(whole, delta, nodes, [c for c in whole.columns if c.startswith("__o")], False)
        if validate:
            log.validate(node_x is not None, node_y is not None)
        return log

    @classmethod
    def of_events(cls, events: DataFrame, delta: TimeDelta | str = "r", nodes: DataFrame | None = None, order: list[str] | None = None, validate: bool = True) -> EventLog:
        """A log of rows that have their ``kind``, read in one scan; ``order``: columns that order events of one time and kind.

        Of ``COLUMNS`` those that are missing are null; further columns are left.
        """
        held = {c: F.col(c) if c in events.columns else F.lit(None) for c in COLUMNS if c != "event_idx"}
        placed = events.select(*(c.cast(COLUMNS[k]).alias(k) for k, c in held.items()), *(F.col(c).alias(f"__by{i}") for i, c in enumerate(order or [])))
        ranked = global_rank(placed, ["t", "kind", *(f"__by{i}" for i in range(len(order or [])))], "event_idx").select(*(F.col(c).cast(t) for c, t in COLUMNS.items()))
        log = cls(ranked, TimeDelta.of(delta), nodes)
        if validate:
            log.validate()
        return log

    def validate(self, has_node_x: bool = False, has_node_y: bool = False) -> None:
        """One pass over the log; raises what is wrong with it."""
        c = F.col
        width = lambda v, k: (F.min(F.when(c("kind") == k, F.coalesce(F.size(v), F.lit(-1)))), F.max(F.when(c("kind") == k, F.coalesce(F.size(v), F.lit(-1)))))
        got = self.events.agg(
            F.count_if(c("kind") == EDGE).alias("edges"), F.count_if(c("kind") == NODE_X).alias("xs"), F.count_if(c("kind") == NODE_Y).alias("ys"),
            F.count_if(c("t").isNull() | ((c("kind") == EDGE) & (c("src").isNull() | c("dst").isNull())) | ((c("kind") != EDGE) & c("nid").isNull())).alias("nulls"),
            F.min("t").alias("first"), F.min(F.least("src", "dst", "nid")).alias("low"),
            F.max(F.greatest("src", "dst", F.when(c("kind") == NODE_X, c("nid")))).alias("top"), F.max(F.when(c("kind") == NODE_Y, c("nid"))).alias("label"),
            *(f.alias(f"w{v}{i}") for v, k in (("edge_x", EDGE), ("x", NODE_X), ("y", NODE_Y)) for i, f in enumerate(width(v, k))),
            F.count_if(F.coalesce(F.exists(F.coalesce("edge_x", "x", "y"), lambda v: F.isnan(v) | v.isNull()), F.lit(False))).alias("nans"),
        ).first()
        if not got["edges"]:
            raise EmptyGraphError("a graph needs an edge")
        if got["nulls"] or got["nans"]:
            raise ValueError(f"{got['nulls']} events have null times or ids, {got['nans']} have features that are no numbers")
        if has_node_x and not got["xs"] or has_node_y and not got["ys"]:
            raise ValueError("node events were given, but there are none")
        if got["first"] < 0:
            raise ValueError(f"times must not be negative: {got['first']}")
        if got["low"] < 0:
            raise InvalidNodeIDError(f"node ids must not be negative: {got['low']}")
        if got["label"] is not None and got["label"] > got["top"]:
            raise InvalidNodeIDError(f"label of node {got['label']}, but nodes end at {got['top']}")
        for v in ("edge_x", "x", "y"):
            if got[f"w{v}0"] != got[f"w{v}1"]:
                raise ValueError(f"vectors in {v} differ in length: {got[f'w{v}0']} to {got[f'w{v}1']}")
        if self.nodes is not None:
            n, least, most = self.nodes.agg(F.count("*"), F.min("nid"), F.max("nid")).first()
            if n <= got["top"] or least != 0 or most != n - 1:
                raise ValueError(f"the node table has ids {least} to {most} in {n} rows, the graph needs 0 to {got['top']}")

    # -- views ---------------------------------------------------------------------------------

    def where(self, test: Column | str) -> EventLog:
        return replace(self, events=self.events.where(test), dense=False)

    def slice_time(self, start: int | None, end: int | None) -> EventLog:
        """Events with start <= t < end; a slice of a slice is their intersection."""
        if start is not None and end is not None and start > end:
            raise ValueError(f"a slice cannot start at {start} and end at {end}")
        old = self.bounds
        low = max((b for b in (old[0], start) if b is not None), default=None)
        high = min((b for b in (old[1], end) if b is not None), default=None)
        log = replace(self, bounds=(low, high))
        if start is not None:
            log = log.where(F.col("t") >= start)
        return log.where(F.col("t") < end) if end is not None else log

    def slice_events(self, start: int | None, end: int | None) -> EventLog:
        """Events with start <= event_idx < end, counted in the whole log even in a view."""
        if start is not None and end is not None and start > end:
            raise ValueError(f"a slice cannot start at {start} and end at {end}")
        log = self.where(F.col("event_idx") >= start) if start is not None else self
        return log.where(F.col("event_idx") < end) if end is not None else log

    def edges(self, *columns: str) -> DataFrame:
        return self.events.where(F.col("kind") == EDGE).select("event_idx", *(columns or ("t", "src", "dst", "edge_x", "edge_type")))

    def node_features(self) -> DataFrame:
        return self.events.where(F.col("kind") == NODE_X).select("event_idx", "t", "nid", "x")

    def node_labels(self) -> DataFrame:
        return self.events.where(F.col("kind") == NODE_Y).select("event_idx", "t", "nid", "y")

    def get_nodes(self) -> DataFrame:
        """``nid``: the distinct nodes of edges and node features; labels do not count."""
        return endpoints(self.events).distinct()

    def properties(self) -> DataFrame:
        """One row of figures about the view; ``start_time`` and ``end_time`` are the bounds asked for, else observed."""
        kind = F.col("kind")
        first, last = (F.lit(b if i == 0 or b is None else b - 1).cast("long") for i, b in enumerate(self.bounds))
        return self.events.agg(
            F.coalesce(first, F.min("t")).alias("start_time"), F.coalesce(last, F.max("t")).alias("end_time"),
            F.coalesce(F.max(F.greatest("src", "dst", F.when(kind == NODE_X, F.col("nid")))) + 1, F.lit(0)).alias("num_nodes"),
            F.countDistinct("t").alias("num_timestamps"), F.count("*").alias("num_events"), F.count_if(kind == EDGE).alias("num_edge_events"),
            F.count_if(kind == NODE_X).alias("num_node_events"), F.count_if(kind == NODE_Y).alias("num_node_labels"),
            *(F.max(F.size(c)).alias(f"{c}_dim") for c in ("edge_x", "x", "y")),
        )

    def static_features(self) -> DataFrame:
        """``nid, static_x`` of the nodes that have them; none without a node table."""
        return self._nodes().where("static_x IS NOT NULL").select("nid", "static_x")

    def node_types(self) -> DataFrame:
        """``nid, node_type`` of the nodes that have one."""
        return self._nodes().where("node_type IS NOT NULL").select("nid", "node_type")

    def _nodes(self) -> DataFrame:
        empty = "nid long, static_x array<float>, node_type int"
        return self.events.sparkSession.createDataFrame([], empty) if self.nodes is None else self.nodes

    @cached_property
    def dims(self) -> dict[str, int | None]:
        """Lengths of the vectors of edges, node features, labels and static features; null where there are none."""
        static = self._nodes().agg(F.max(F.size("static_x"))).first()[0]
        return {c: self.facts[f"{c}_dim"] for c in ("edge_x", "x", "y")} | {"static_x": None if static is None or static < 0 else static}

    @cached_property
    def facts(self) -> dict:
        """``properties`` on the driver: one row."""
        return self.properties().first().asDict()

    def __len__(self) -> int:
        return self.facts["num_timestamps"]

    def materialize(self, features: bool = True) -> DataFrame:
        """The view as one table for a model: without features only ids, times and kinds.  Node events that have no values are left out."""
        has_values = (F.col("kind") == EDGE) | F.col("x").isNotNull() | F.col("y").isNotNull()
        return self.events.where(has_values).select(*(c for c in COLUMNS if features or c not in ("edge_x", "x", "y")))

    def to_arrow(self, features: bool = True):
        return self.materialize(features).orderBy("event_idx").toArrow()

    def to_pandas(self, features: bool = True):
        return self.materialize(features).orderBy("event_idx").toPandas()

    def write(self, path: str) -> None:
        """Parquet in the order of time with ``event_idx``, so that row groups cover narrow ranges and slices skip files; metadata beside it, nodes in ``path-nodes``."""
        self.events.repartitionByRange("t", "event_idx").sortWithinPartitions("t", "event_idx").write.parquet(path)
        if self.nodes is not None:
            self.nodes.write.parquet(f"{path}-nodes")
        meta = [(self.delta.unit, self.delta.value, *self.bounds, self.dense, self.nodes is not None)]
        schema = "unit string, value long, start long, stop long, dense boolean, has_nodes boolean"
        self.events.sparkSession.createDataFrame(meta, schema).coalesce(1).write.json(f"{path}-meta")

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> EventLog:
        """A log that ``write`` stored, its order with it: slices by time and by index are pushed down to the files.  A split strategy is not stored."""
        meta = spark.read.schema("unit string, value long, start long, stop long, dense boolean, has_nodes boolean").json(f"{path}-meta").first()
        events = spark.read.schema(", ".join(f"{c} {t}" for c, t in COLUMNS.items())).parquet(path)
        nodes = spark.read.parquet(f"{path}-nodes") if meta["has_nodes"] else None
        return cls(events, TimeDelta(meta["unit"], meta["value"]), nodes, None, (meta["start"], meta["stop"]), meta["dense"])

    def clone(self) -> EventLog:
        return replace(self)

    def to(self, device: object) -> EventLog:
        """Frames have no device; here so that code that moves them keeps working."""
        return self


def endpoints(events: DataFrame, *carry: str) -> DataFrame:
    """``carry`` and ``nid`` for each end of an edge and each node feature; labels have none."""
    ends = F.when(F.col("kind") == EDGE, F.array("src", "dst")).when(F.col("kind") == NODE_X, F.array("nid"))
    return events.select(*carry, F.explode(ends).alias("nid"))
