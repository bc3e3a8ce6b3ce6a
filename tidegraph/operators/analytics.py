"""Figures of batches and nodes.  ``events`` is a log with ``batch_id``."""

from __future__ import annotations

import math
from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..frame import endpoints
from ..functions.scalar import scattered
from ..functions.scan import EVENT_BITS, at_steps, scan
from ..workspace import keep


def batch_analytics(events: DataFrame) -> DataFrame:
    """One row a batch: ``num_edge_events, num_node_events, num_unique_timestamps, num_unique_nodes, avg_degree, num_repeated_edge_events, num_repeated_node_events``.

    Labels count nowhere.  Distinct counts are two-step hash aggregates, each over rows reduced on the map side.
    """
    rows = events.where("kind IN (0, 1)")
    edge, node = F.col("kind") == 0, F.col("kind") == 1
    counts = rows.groupBy("batch_id").agg(F.count_if(edge).alias("num_edge_events"), F.count_if(node).alias("num_node_events"))
    times = rows.select("batch_id", "t").distinct().groupBy("batch_id").agg(F.count("*").alias("num_unique_timestamps"))
    ends = endpoints(rows, "batch_id", "kind").groupBy("batch_id", "nid").agg(F.min("kind").alias("kind")).groupBy("batch_id").agg(F.count("*").alias("num_unique_nodes"), F.count_if(F.col("kind") == 0).alias("edge_nodes"))
    kinds = rows.groupBy("batch_id", "kind", "t", "src", "dst", "nid").agg(F.count("*").alias("n")).groupBy("batch_id").agg(
        F.sum(F.when(edge, F.col("n") - 1).otherwise(0)).alias("num_repeated_edge_events"), F.sum(F.when(node, F.col("n") - 1).otherwise(0)).alias("num_repeated_node_events"))
    out = counts.join(times, "batch_id").join(ends, "batch_id").join(kinds, "batch_id")
    degree = F.coalesce(F.try_divide(2.0 * F.col("num_edge_events"), F.col("edge_nodes").cast("double")), F.lit(0.0))
    return out.select("batch_id", "num_edge_events", "num_node_events", "num_unique_timestamps", "num_unique_nodes", degree.alias("avg_degree"), "num_repeated_edge_events", "num_repeated_node_events")


def mean_of_batches(figures: DataFrame) -> DataFrame:
    """The mean over batches of every figure."""
    return figures.agg(*(F.avg(c).alias(c) for c in figures.columns if c not in ("batch_id", "nid")))


def node_degrees(events: DataFrame, tracked: DataFrame | None = None) -> DataFrame:
    """``batch_id, nid, degree``: how often each (tracked) node is an end of an edge of the batch."""
    ends = events.where("kind = 0").select("batch_id", F.explode(F.array("src", "dst")).alias("nid"))
    if tracked is not None:
        ends = ends.join(tracked.select("nid"), "nid", "left_semi")
    return ends.groupBy("batch_id", "nid").agg(F.count("*").alias("degree"))


def both_ways(edges: DataFrame, *carry: str) -> DataFrame:
    """``carry, nid, nbr``: each end of an edge with the other."""
    pairs = F.array(F.struct(F.col("src").alias("nid"), F.col("dst").alias("nbr")), F.struct(F.col("dst").alias("nid"), F.col("src").alias("nbr")))
    return edges.select(*carry, F.explode(pairs).alias("p")).select(*carry, "p.*")


def _with_earlier(rows: DataFrame, earlier: DataFrame | None) -> DataFrame:
    """``rows`` (with ``batch_id``) and what was there before them, as of batch -1."""
    return rows if earlier is None else rows.unionByName(earlier.withColumn("batch_id", F.lit(-1).cast("long")))


def new_neighbors(events: DataFrame, tracked: DataFrame | None = None, earlier: DataFrame | None = None) -> DataFrame:
    """``batch_id, nid, new_neighbors``: neighbours met for the first time in the batch; batches without any are left out.

    ``earlier``: pairs (src, dst) that were met before all of them.
    """
    edges = _with_earlier(events.where("kind = 0").select("batch_id", "src", "dst"), earlier)
    met = both_ways(edges, "batch_id").groupBy("nid", "nbr").agg(F.min("batch_id").alias("batch_id")).where("batch_id >= 0")
    if tracked is not None:
        met = met.join(tracked.select("nid"), "nid", "left_semi")
    return met.groupBy("batch_id", "nid").agg(F.count("*").alias("new_neighbors"))


@dataclass(frozen=True)
class NodePast:
    """What node figures need of earlier iterations: tables that grow with what is distinct in them, not with how often it was seen."""

    figures: DataFrame  # nid, appearances, first_seen, last_seen of tracked nodes
    moments: DataFrame  # nid, t: the distinct times of tracked nodes
    times: DataFrame  # t: the distinct times of the graph
    edges: DataFrame  # src, dst
    nodes: DataFrame  # nid: of edges and node features

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}


def node_spine(events: DataFrame, past: NodePast | None = None) -> DataFrame:
    """``batch_id, place, now, times``: the batches in order, numbered from 0, their last times, and how many distinct times there were by then."""
    rows = events.where("kind IN (0, 1)")
    fresh = rows.groupBy("t").agg(F.min("batch_id").alias("batch_id"))
    if past is not None:
        fresh = fresh.join(past.times, "t", "left_anti")
    known = F.lit(0) if past is None else F.lit(past.times.count())
    fresh = fresh.groupBy("batch_id").agg(F.count("*").alias("fresh"))
    spine = rows.groupBy("batch_id").agg(F.max("t").alias("now"), F.lit(1).alias("one")).join(fresh, "batch_id", "left")
    spine = scan(spine, [], "batch_id", {"place": ("sum", "one"), "times": ("sum", F.coalesce("fresh", F.lit(0)))}, inclusive=True)
    return spine.select("batch_id", (F.col("place") - 1).alias("place"), "now", (F.col("times") + known).alias("times"))


def _present(events: DataFrame, tracked: DataFrame, spine: DataFrame, past: NodePast | None) -> DataFrame:
    """``nid, place, fresh, first, last``: a row for each batch that has the node, with its times that are new; the past has place -1."""
    ends = endpoints(events.where("kind IN (0, 1)"), "batch_id", "t").join(tracked.select("nid").distinct(), "nid", "left_semi")
    moments = ends.groupBy("nid", "t").agg(F.min("batch_id").alias("batch_id"))
    if past is not None:
        moments = moments.join(past.moments, ["nid", "t"], "left_anti")
    here = at_steps([moments.withColumn("fresh", F.lit(1)), ends.select("nid", "batch_id").distinct()], ["nid", "batch_id"], {"fresh": "sum"})
    here = here.join(spine, "batch_id").select("nid", "batch_id", "place", F.coalesce("fresh", F.lit(0)).alias("fresh"), F.col("now").alias("first"), F.col("now").alias("last"))
    if past is None:
        return here
    held = past.figures.select("nid", F.lit(-1).cast("long").alias("batch_id"), F.lit(-1).cast("long").alias("place"), F.col("appearances").alias("fresh"), F.col("first_seen").alias("first"), F.col("last_seen").alias("last"))
    return here.unionByName(held.join(tracked.select("nid").distinct(), "nid", "left_semi"))


def node_runs(events: DataFrame, tracked: DataFrame, past: NodePast | None = None, spine: DataFrame | None = None) -> DataFrame:
    """``nid, place, until, appearances, first_seen, last_seen, degree, new_neighbors``: a row only where something changes.

    From the batch ``place`` up to the batch ``until`` (exclusive; null: to the end) the figures of a node stay the same, but
    that degree and new neighbours are those of the first batch and zero afterwards.  Runs of the past begin at -1.
    """
    spine = node_spine(events, past) if spine is None else spine
    folds = {"appearances": ("sum", "fresh"), "first_seen": ("min", "first"), "until": ("next", "place")}
    rows = scan(_present(events, tracked, spine, past), ["nid"], "place", folds, inclusive=True)
    rows = rows.join(node_degrees(events, tracked), ["batch_id", "nid"], "left").join(new_neighbors(events, tracked, None if past is None else past.edges), ["batch_id", "nid"], "left")
    return rows.select("nid", "place", "until", "appearances", "first_seen", F.col("last").alias("last_seen"), F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("new_neighbors", F.lit(0)).alias("new_neighbors"))


def node_analytics(events: DataFrame, tracked: DataFrame, past: NodePast | None = None) -> DataFrame:
    """A row for each batch and tracked node (``nid``) seen by then: ``degree, new_neighbors, appearances, activity, lifetime, time_since_last_seen``.

    ``appearances``: distinct times of the node so far; ``activity``: these over the graph's distinct times so far.
    ``lifetime`` counts from the time of the batch that first had the node (a batch's time is its last one) to now, or to the
    last batch that had it.  Edges and node features count, labels do not.

    The runs of ``node_runs`` are expanded to the batches they cover, which are joined by number.
    """
    spine = keep(node_spine(events, past), "spine")  # a row a batch, read three times
    size = F.broadcast(spine.agg(F.count("*").alias("size")).withColumn("one", F.lit(1)))  # one row
    runs = node_runs(events, tracked, past, spine).join(size, F.lit(1) == F.col("one"))
    begin, end = F.greatest("place", F.lit(0)), F.coalesce("until", "size")
    grid = runs.where(begin < end).withColumn("start", F.col("place")).withColumn("place", F.explode(F.sequence(begin, end - 1))).join(spine, "place")
    here = F.col("place") == F.col("start")
    now_or_zero = lambda c: F.when(here, F.col(c)).otherwise(0).alias(c)
    return grid.select("batch_id", "nid", now_or_zero("degree"), now_or_zero("new_neighbors"), "appearances", (F.col("appearances") / F.greatest("times", F.lit(1))).alias("activity"),
        (F.col("last_seen") - F.col("first_seen")).cast("double").alias("lifetime"), (F.col("now") - F.col("last_seen")).cast("double").alias("time_since_last_seen"))


def past_after(events: DataFrame, tracked: DataFrame, past: NodePast | None = None) -> NodePast:
    """What ``NodePast`` is after these events."""
    rows = events.where("kind IN (0, 1)")
    ends = endpoints(rows, "t")
    mine = ends.join(tracked.select("nid").distinct(), "nid", "left_semi")
    held = _present(events, tracked, node_spine(events, past), past).groupBy("nid").agg(F.sum("fresh").alias("appearances"), F.min("first").alias("first_seen"), F.max_by("last", "place").alias("last_seen"))
    add = lambda new, name: (new if past is None else new.unionByName(getattr(past, name))).distinct()
    edges = rows.where("kind = 0").select("src", "dst")
    return NodePast(held, add(mine.select("nid", "t"), "moments"), add(rows.select("t"), "times"), add(edges, "edges"), add(ends.select("nid"), "nodes"))


def node_novelty(events: DataFrame, tracked: DataFrame | None = None, strict: bool = False, earlier: DataFrame | None = None) -> DataFrame:
    """``batch_id, new_node_count, node_novelty``: node features whose node was in no earlier batch, and their share.

    ``strict``: a tracked node never counts, as it is entered before the count is taken.  ``earlier``: nodes (nid) from before all batches.
    """
    rows = events.where("kind IN (0, 1)")
    ends = _with_earlier(endpoints(rows, "batch_id"), earlier)
    first = ends.groupBy("nid").agg(F.min("batch_id").alias("first_batch"))
    features = rows.where("kind = 1").select("batch_id", "nid").join(first, "nid")
    fresh = F.col("first_batch") == F.col("batch_id")
    if strict and tracked is not None:
        features = features.join(tracked.select("nid", F.lit(True).alias("tracked")), "nid", "left")
        fresh = F.col("tracked").isNull()
    return features.groupBy("batch_id").agg(F.count_if(fresh).alias("new_node_count"), (F.count_if(fresh) / F.count("*")).alias("node_novelty"))


def edge_stats(events: DataFrame, earlier: DataFrame | None = None) -> DataFrame:
    """``batch_id, new_edge_count, edge_novelty, edge_density``: pairs (directed) never met before, their share of the edges, and edges over n(n-1).

    ``earlier``: pairs (src, dst) from before all batches.
    """
    edges = events.where("kind = 0")
    sizes = edges.groupBy("batch_id").agg(F.count("*").alias("n_edges"))
    met = _with_earlier(edges.select("batch_id", "src", "dst"), earlier)
    fresh = met.groupBy("src", "dst").agg(F.min("batch_id").alias("batch_id")).groupBy("batch_id").agg(F.count("*").alias("new"))
    nodes = endpoints(edges, "batch_id").distinct().groupBy("batch_id").agg(F.count("*").cast("double").alias("n"))
    out = sizes.join(fresh, "batch_id", "left").join(nodes, "batch_id")
    new = F.coalesce("new", F.lit(0))
    density = F.when(F.col("n") < 2, 0.0).otherwise(F.try_divide(F.col("n_edges").cast("double"), F.col("n") * (F.col("n") - 1)))
    return out.select("batch_id", new.alias("new_edge_count"), (new / F.col("n_edges")).alias("edge_novelty"), density.alias("edge_density"))


def gap_stats(edges: DataFrame, start: Column | int = 0) -> DataFrame:
    """Mean and deviation (of the population) of the gaps between events of sources, and of destinations: ``role, mean_gap, std_gap``.

    Each end of an edge has a gap to the node's event before it (to ``start`` for its first); the two gaps of a
    self-loop are both to the event before.
    """
    base = F.lit(start) if isinstance(start, int) else start
    ends = F.array(F.struct(F.lit("src").alias("role"), F.col("src").alias("nid")), F.struct(F.lit("dst").alias("role"), F.col("dst").alias("nid")))
    rows = edges.select("event_idx", "t", F.explode(ends).alias("e")).select("event_idx", "t", "e.*")
    events = rows.groupBy("nid", "event_idx").agg(F.min("t").alias("t"))
    before = scan(events, ["nid"], "event_idx", {"last": ("last", "t")}, bits=EVENT_BITS).withColumn("gap", F.col("t") - F.coalesce("last", base))
    return rows.join(before.select("nid", "event_idx", "gap"), ["nid", "event_idx"]).groupBy("role").agg(F.avg("gap").alias("mean_gap"), F.stddev_pop("gap").alias("std_gap"))


def top_nodes(edges: DataFrame, n: int) -> DataFrame:
    """``nid, n_events`` of the ``n`` nodes that are most often an end of an edge; of equals the lower ids."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("nid"))
    return ends.groupBy("nid").agg(F.count("*").alias("n_events")).orderBy(F.desc("n_events"), "nid").limit(n)


def snapshot_metrics(events: DataFrame) -> DataFrame:
    """``batch_id, n_edges, n_nodes`` of the edges of each snapshot."""
    edges = events.where("kind = 0")
    nodes = endpoints(edges, "batch_id").distinct().groupBy("batch_id").agg(F.count("*").alias("n_nodes"))
    return edges.groupBy("batch_id").agg(F.count("*").alias("n_edges")).join(nodes, "batch_id")


def trend_labels(metrics: DataFrame, metric: str = "n_edges") -> DataFrame:
    """``batch_id, label``: whether the metric grows from this snapshot to the next; the last has no label.  A row a snapshot."""
    after = scan(metrics, [], "batch_id", {"__after": ("next", metric)})
    return after.withColumn("label", (F.col("__after") > F.col(metric)).cast("int")).where("label IS NOT NULL").select("batch_id", "label")


def probe_sign(node: Column, probe: Column, seed: int = 0) -> Column:
    """1 or -1 by a hash of node and probe."""
    return (1 - 2 * (F.shiftright(scattered(node, probe, seed), 16) % 2)).cast("double")


def jackson_weights(moments: int, bins: int) -> list[list[float]]:
    """For each bin the factors of the moments in its density: Jackson's damping times the integral of the Chebyshev series over the bin."""
    big = moments + 1
    edges = [-1 + 1e-6 + (2 - 2e-6) * b / bins for b in range(bins + 1)]

    def upto(x: float, k: int) -> float:
        theta = math.acos(x)
        damped = ((big - k) * math.cos(math.pi * k / big) + math.sin(math.pi * k / big) / math.tan(math.pi / big)) / big
        return damped * ((math.pi - theta) if k == 0 else -2 * math.sin(k * theta) / k) / math.pi

    return [[upto(edges[b + 1], k) - upto(edges[b], k) for k in range(moments)] for b in range(bins)]


def spectral_moments(events: DataFrame, moments: int = 20, probes: int = 10, seed: int = 0) -> DataFrame:
    """``batch_id, k, mu``: Chebyshev moments of each snapshot's normalised Laplacian less the identity, estimated with random signs.

    A block of probe vectors is a table of a row a node; a product with the matrix is a join with the table of its entries
    and a sum by node, so a snapshot may be of any size and no task holds one.  Moments 2k and 2k + 1 follow from the dot
    products of the vectors of steps k and k + 1, so half as many products are taken as there are moments.
    """
    pairs = both_ways(events.where("kind = 0"), "batch_id")
    degree = pairs.groupBy("batch_id", "nid").agg(F.count("*").cast("double").alias("d"))
    counts = pairs.groupBy("batch_id", "nid", "nbr").agg(F.count("*").alias("n"))
    sides = counts.join(degree, ["batch_id", "nid"]).join(degree.select("batch_id", F.col("nid").alias("nbr"), F.col("d").alias("e")), ["batch_id", "nbr"])
    matrix = keep(sides.select("batch_id", "nid", "nbr", (-F.col("n") / F.sqrt(F.col("d") * F.col("e"))).alias("w")), "laplacian")
    names = range(probes)

    def times(vectors: DataFrame, column: str) -> DataFrame:
        """``batch_id, nid, y0, ...``: the matrix times the vectors."""
        of = vectors.select("batch_id", F.col("nid").alias("nbr"), *(F.col(f"{column}{p}").alias(f"x{p}") for p in names))
        return matrix.join(of, ["batch_id", "nbr"]).groupBy("batch_id", "nid").agg(*(F.sum(F.col("w") * F.col(f"x{p}")).alias(f"y{p}") for p in names))

    signs = degree.select("batch_id", "nid", *(probe_sign(F.col("nid"), F.lit(p), seed).alias(f"a{p}") for p in names))
    state = keep(signs.join(times(signs, "a"), ["batch_id", "nid"]).withColumnsRenamed({f"y{p}": f"b{p}" for p in names}), "spectral")
    dots = []
    for k in range(moments // 2 + 1):
        # a is the vector of step k, b that of step k + 1
        dot = lambda x, y: sum((F.col(f"{x}{p}") * F.col(f"{y}{p}") for p in names), F.lit(0.0))
        dots.append(state.groupBy("batch_id").agg(F.count("*").alias("nodes"), F.sum(dot("a", "a")).alias("even"), F.sum(dot("a", "b")).alias("odd")).withColumn("step", F.lit(k)))
        if k < moments // 2:
            moved = state.join(times(state, "b"), ["batch_id", "nid"])
            state = keep(moved.select("batch_id", "nid", *(F.col(f"b{p}").alias(f"a{p}") for p in names), *((2 * F.col(f"y{p}") - F.col(f"a{p}")).alias(f"b{p}") for p in names)), "spectral")
    every = reduce(lambda a, b: a.unionByName(b), dots)
    first = dots[0].select("batch_id", F.col("even").alias("even0"), F.col("odd").alias("odd0"))
    scaled = every.join(first, "batch_id").withColumn("of", F.col("nodes") * probes)
    even = F.when(F.col("step") == 0, F.col("even")).otherwise(2 * F.col("even") - F.col("even0")) / F.col("of")
    odd = F.when(F.col("step") == 0, F.col("odd")).otherwise(2 * F.col("odd") - F.col("odd0")) / F.col("of")
    both = F.explode(F.array(F.struct((2 * F.col("step")).alias("k"), even.alias("mu")), F.struct((2 * F.col("step") + 1).alias("k"), odd.alias("mu"))))
    return scaled.select("batch_id", both.alias("m")).select("batch_id", "m.k", "m.mu").where(F.col("k") < moments)


def spectral_density(events: DataFrame, moments: int = 20, probes: int = 10, bins: int = 21, seed: int = 0) -> DataFrame:
    """``batch_id, bin, density``: the eigenvalue density of each snapshot's normalised Laplacian by Chebyshev moments, damped by Jackson's factors."""
    weights = jackson_weights(moments, bins)
    by_bin = [sum((F.when(F.col("k") == k, F.col("mu") * w).otherwise(0.0) for k, w in enumerate(row)), F.lit(0.0)) for row in weights]
    sums = spectral_moments(events, moments, probes, seed).groupBy("batch_id").agg(*(F.sum(v).alias(f"d{b}") for b, v in enumerate(by_bin)))
    return sums.select("batch_id", F.posexplode(F.array(*(f"d{b}" for b in range(bins)))).alias("bin", "density"))
