"""The engine's operators as objects for pipelines."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..frame import EDGE, NODE_X, NODE_Y
from ..functions.ranking import sum_before
from ..functions.scalar import PADDING
from ..operators import analytics, negatives, neighbors, tracking
from .protocol import BaseOperator, BatchFrame, SeededOperator, StatefulOperator
from .registry import operator


def _edges(frame: BatchFrame) -> DataFrame:
    return frame.events.where("kind = 0")


#: Seeds that are events of the log: the kind, the column of the node, and which end of an edge it is.
_EVENT_SEEDS = {"edge_src": (EDGE, "src", 0), "edge_dst": (EDGE, "dst", 1), "node_x_nids": (NODE_X, "nid", 0), "node_y_nids": (NODE_Y, "nid", 0)}
#: Columns of a table of seeds that may hold the node and the time.
_NODES, _TIMES = ("neg", "nid", "node", "nbr"), ("neg_t", "t", "q", "nbr_t")


def seeds_of(frame: BatchFrame, keys: list[str]) -> DataFrame:
    """``seed_id, batch_id, node, q, key`` of the seeds of some keys: ends of edges, nodes of node events, or tables that operators have added.

    Ends of edges have the ids of ``neighbors.link_seeds``; others negative ones, by event, or by place among the table's rows.  A key
    that is missing is an error, one whose table is None is left out with a warning.  Padding is no seed; other
    negative ids and negative times are errors when the seeds are read.
    """
    found = None
    for place, key in enumerate(keys):
        if key in _EVENT_SEEDS:
            kind, column, end = _EVENT_SEEDS[key]
            rows = frame.events.where(F.col("kind") == kind).select("batch_id", F.col(column).alias("node"), F.col("t").alias("q"), F.col("event_idx").alias("__place"))
        elif key not in frame.tables:
            raise ValueError(f"there are no seeds {key!r} in the frame")
        elif frame[key] is None:
            warnings.warn(f"the seeds {key!r} are None and left out", stacklevel=2)
            continue
        else:
            kind, table = None, frame[key]
            node, time = (next((c for c in names if c in table.columns), None) for names in (_NODES, _TIMES))
            if node is None or time is None or "batch_id" not in table.columns:
                raise ValueError(f"the seeds {key!r} need a batch_id, one of {_NODES} and one of {_TIMES}, not {table.columns}")
            for c in (node, time):
                if not isinstance(table.schema[c].dataType, T.IntegralType):
                    raise ValueError(f"{c} of the seeds {key!r} must hold whole numbers, not {table.schema[c].dataType.simpleString()}")
            rows = _placed(table.select("batch_id", F.col(node).cast("long").alias("node"), F.col(time).cast("long").alias("q"), *(F.col(c) for c in table.columns if c in ("ordinal", "event_idx"))))
        # the rest by the number of keys tells ids of different keys apart
        seed_id = F.col("__place") * 2 + end if kind == EDGE else -1 - (F.col("__place") * len(keys) + place)
        seeds = rows.select(seed_id.cast("long").alias("seed_id"), "batch_id", "node", "q", F.lit(key).alias("key"))
        found = seeds if found is None else found.unionByName(seeds)
    if found is None:
        found = frame.events.sparkSession.createDataFrame([], "seed_id long, batch_id long, node long, q long, key string")
    bad = F.when((F.col("node") < PADDING) | (F.col("q") < 0), F.raise_error(F.format_string("seed %d of batch %d at %d", "node", "batch_id", "q")).cast("long"))
    return found.withColumn("q", F.coalesce(bad, F.col("q"))).where(F.col("node") != PADDING)


def _placed(rows: DataFrame) -> DataFrame:
    """``rows`` with ``__place``: batch by batch from 0, however many there are; equal rows of a batch in either order."""
    counts = rows.groupBy("batch_id").agg(F.count("*").alias("__n"))
    first = sum_before(counts, [], "batch_id", "__n", "__first").drop("__n")
    in_batch = F.row_number().over(Window.partitionBy("batch_id").orderBy(*(c for c in rows.columns if c != "batch_id"))) - 1
    return rows.withColumn("__in", in_batch).join(first, "batch_id").withColumn("__place", F.col("__in") + F.col("__first"))


def _positions(seeds: DataFrame) -> DataFrame:
    """``batch_id, key, position, seed_id``: where each key's seeds are among those of its batch."""
    place = F.row_number().over(Window.partitionBy("batch_id").orderBy("key", F.abs("seed_id"))) - 1
    return seeds.select("batch_id", "key", place.cast("long").alias("position"), "seed_id")


@operator
class RandomNegatives(BaseOperator):
    """Random negative destinations for each edge."""

    requires, produces = {"edge_src", "edge_dst", "edge_time"}, {"neg", "neg_time"}

    def __init__(self, low: int, high: int, ratio: float = 1.0, seed: int = 0, id: str | None = None):
        super().__init__(id)
        if low < 0 or low >= high or not 0 < ratio <= 1:
            raise ValueError("negatives need 0 <= low < high and a ratio in (0, 1]")
        self.args = (low, high, ratio, seed)

    def apply(self, frame: BatchFrame) -> BatchFrame:
        return frame.with_columns_of(negatives.random_negatives(_edges(frame), *self.args), *self.produces)


@operator
class HistoricalNegatives(StatefulOperator):
    """A past destination for each source of a batch; earlier iterations are past."""

    requires, produces = {"edge_src", "edge_dst", "edge_time"}, {"neg", "neg_time", "valid_neg_mask"}

    def apply(self, frame: BatchFrame) -> BatchFrame:
        edges = _edges(frame).select("batch_id", "event_idx", "src", "dst", F.col("t").alias("neg_t"))
        counts = self.state().get("counts")
        self.leave(counts=negatives.counts_after(edges, counts))
        drawn = negatives.historical_negatives(edges, earlier=counts).join(edges.select("batch_id", "event_idx", "neg_t"), ["batch_id", "event_idx"])
        return frame.with_columns_of(drawn, *self.produces)


@operator
class ListedNegatives(BaseOperator):
    """Negatives that were prepared for each edge of a benchmark."""

    requires, produces = {"edge_src", "edge_dst", "edge_time"}, {"neg", "neg_batch_list", "neg_time"}

    def __init__(self, table: DataFrame, typed: bool = False, id: str | None = None):
        super().__init__(id)
        self.table, self.typed = table, typed

    def apply(self, frame: BatchFrame) -> BatchFrame:
        listed = negatives.listed_negatives(_edges(frame), self.table, self.typed)
        return frame.with_table(self.name("neg_batch_list"), listed).with_columns_of(negatives.batch_negatives(listed), self.name("neg"), self.name("neg_time"))


@operator
class RecentNeighbors(SeededOperator):
    """The latest neighbours of each seed (default: both ends of each edge), over one or more hops.

    Buffers keep what earlier iterations have put into them.  A batch without seeds puts nothing into them.
    """

    requires, produces = {"edge_src", "edge_dst", "edge_time"}, {"nbr_nids", "nbr_edge_time", "nbr_edge_x", "seed_nids", "seed_times", "seed_node_nbr_mask"}
    has_state = True

    def __init__(self, ks: list[int], seeds: list[str] | None = None, directed: bool = False, id: str | None = None):
        super().__init__(["edge_src", "edge_dst"] if seeds is None else seeds, id)
        if not ks or min(ks) <= 0:
            raise ValueError("each hop needs a positive number of neighbours")
        self.ks, self.directed = ks, directed

    def apply(self, frame: BatchFrame) -> BatchFrame:
        seeds, edges = seeds_of(frame, self.seeds), _edges(frame).select("batch_id", "event_idx", "t", "src", "dst", "edge_x")
        if not {"edge_src", "edge_dst"} & set(self.seeds):
            edges = edges.join(seeds.select("batch_id").distinct(), "batch_id", "left_semi")
        buffers = neighbors.Buffers.of(edges, self.directed, earlier=self.state().get("buffers"))
        if len(self.ks) > 1:
            buffers = buffers.kept()
        self.leave(buffers=buffers.left(max(self.ks)))
        found = neighbors.hops(seeds.drop("key"), edges, self.ks, buffers=buffers)
        frame = frame.with_columns_of(seeds, self.name("seed_nids"), self.name("seed_times")).with_table(self.name("seed_node_nbr_mask"), _positions(seeds))
        return frame.with_columns_of(found, *map(self.name, ("nbr_nids", "nbr_edge_time", "nbr_edge_x")))


@operator
class UniformNeighbors(SeededOperator):
    """Neighbours of each seed (default: both ends of each edge) drawn from all before its batch."""

    requires, produces = {"edge_src", "edge_dst", "edge_time"}, {"nbr_nids", "nbr_edge_time", "nbr_edge_x", "seed_nids", "seed_times"}

    def __init__(self, k: int, seeds: list[str] | None = None, directed: bool = False, seed: int = 0, id: str | None = None):
        super().__init__(["edge_src", "edge_dst"] if seeds is None else seeds, id)
        if k <= 0:
            raise ValueError("a positive number of neighbours is needed")
        self.k, self.directed, self.seed = k, directed, seed

    def apply(self, frame: BatchFrame) -> BatchFrame:
        seeds = seeds_of(frame, self.seeds)
        found = neighbors.uniform(seeds.drop("key"), _edges(frame), self.k, self.directed, self.seed)
        return frame.with_columns_of(seeds, self.name("seed_nids"), self.name("seed_times")).with_columns_of(found, *map(self.name, ("nbr_nids", "nbr_edge_time", "nbr_edge_x")))


@operator
class Deduplication(SeededOperator):
    """Distinct nodes of a batch, numbered from 0: ``batch_id, nid, local_id``, which is the mapping too."""

    requires, produces = {"edge_src", "edge_dst"}, {"unique_nids", "global_to_local"}

    def __init__(self, seeds: list[str] | None = None, id: str | None = None):
        super().__init__(seeds or [], id)

    def apply(self, frame: BatchFrame) -> BatchFrame:
        ids = _edges(frame).select("batch_id", F.explode(F.array("src", "dst")).alias("nid"))
        for key in self.seeds:
            column = "nbr" if "nbr" in frame[key].columns else "neg" if "neg" in frame[key].columns else "node"
            ids = ids.unionByName(frame[key].select("batch_id", F.col(column).alias("nid")))
        return frame.with_columns_of(tracking.local_ids(ids), *self.produces)


@operator
class SeenNodes(StatefulOperator):
    """Labelled nodes of a batch that an edge has touched by then, in earlier iterations too."""

    requires, produces = {"edge_src", "edge_dst", "node_y_nids"}, {"seen_nodes", "batch_nodes_mask"}
    has_state = True

    def apply(self, frame: BatchFrame) -> BatchFrame:
        nodes = self.state().get("nodes")
        self.leave(nodes=tracking.touched_after(frame.events, nodes))
        return frame.with_columns_of(tracking.seen_nodes(frame.events, nodes), *self.produces)


@operator
class BatchAnalytics(BaseOperator):
    """Figures of each batch."""

    requires = {"edge_src", "edge_dst", "edge_time", "node_x_nids", "node_x_time"}
    produces = {"num_edge_events", "num_node_events", "num_unique_timestamps", "num_unique_nodes", "avg_degree", "num_repeated_edge_events", "num_repeated_node_events"}

    def apply(self, frame: BatchFrame) -> BatchFrame:
        return frame.with_columns_of(analytics.batch_analytics(frame.events), self.name("batch_analytics"), *self.produces)


@operator
class NodeAnalytics(StatefulOperator):
    """Figures of tracked nodes and of the novelty of each batch, compared with earlier iterations too."""

    requires, produces = {"edge_src", "edge_dst", "edge_time", "node_x_nids", "node_x_time"}, {"node_stats", "node_macro_stats", "edge_stats"}
    has_state = True

    def __init__(self, tracked: DataFrame, id: str | None = None):
        super().__init__(id)
        self.tracked = tracked

    def apply(self, frame: BatchFrame) -> BatchFrame:
        events, held = frame.events, self.state()
        past = analytics.NodePast(**held) if held else None
        self.leave(**analytics.past_after(events, self.tracked, past).tables())
        frame = frame.with_table(self.name("node_stats"), analytics.node_analytics(events, self.tracked, past))
        frame = frame.with_table(self.name("node_macro_stats"), analytics.node_novelty(events, self.tracked, earlier=past and past.nodes))
        return frame.with_table(self.name("edge_stats"), analytics.edge_stats(events, past and past.edges))


@operator
class DeviceTransfer(BaseOperator):
    """Nothing: frames have no device.  Here so that pipelines that name it keep working."""

    def __init__(self, device: str = "cpu", id: str | None = None):
        super().__init__(id)

    def apply(self, frame: BatchFrame) -> BatchFrame:
        return frame


@operator
class PinMemory(DeviceTransfer):
    """Nothing, as for ``DeviceTransfer``."""
