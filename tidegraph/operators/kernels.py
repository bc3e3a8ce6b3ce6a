"""What graph models compute from data alone: message aggregation, propagation, walks, common neighbours, pooling."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import blocks
from ..functions.ranking import sum_before
from ..functions.scalar import dot, merge_concat, merge_weighted, scattered, softmax, time2vec, time2vec_weights
from ..functions.scan import at_steps, scan
from ..workspace import keep

# -- messages and memory ---------------------------------------------------------------------------


def messages(edges: DataFrame) -> DataFrame:
    """``batch_id, node, event_idx, t, role, other, x``: a message to each end of each edge, with the edge's features."""
    ends = F.array(F.struct(F.lit(0).alias("role"), F.col("src").alias("node"), F.col("dst").alias("other")), F.struct(F.lit(1).alias("role"), F.col("dst").alias("node"), F.col("src").alias("other")))
    return edges.select("batch_id", "event_idx", "t", F.col("edge_x").alias("x"), F.explode(ends).alias("e")).select("batch_id", "event_idx", "t", "x", "e.*")


def stored_messages(rows: DataFrame, upto: int | None = None) -> DataFrame:
    """Of each node only the messages of its latest batch (at most ``upto``)."""
    rows = rows if upto is None else rows.where(F.col("batch_id") <= upto)
    latest = rows.groupBy("node").agg(F.max("batch_id").alias("batch_id"))
    return rows.join(latest, ["node", "batch_id"], "left_semi")


def last_message(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``by, t, other, x`` of the latest message; of those at one time the last in the order of events, the destination's after the source's."""
    by = by or ["node"]
    order = Window.partitionBy(*by).orderBy(F.desc("t"), F.desc("event_idx"), F.desc("role"))
    return rows.withColumn("__k", F.row_number().over(order)).where("__k = 1").select(*by, "t", "other", "x")


def mean_message(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``by, pos, mean_x, n``: the mean of each element of the messages."""
    by = by or ["node"]
    return rows.select(*by, F.posexplode("x").alias("pos", "v")).groupBy(*by, "pos").agg(F.avg(F.col("v").cast("double")).alias("mean_x"), F.count("*").alias("n"))


def last_update(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``by, last_update``: the latest time of each node's messages."""
    return rows.groupBy(*(by or ["node"])).agg(F.max("t").alias("last_update"))


def relative_times(rows: DataFrame) -> DataFrame:
    """``rows`` with ``dt``: the time since the node's update in an earlier batch; since 0 for its first."""
    updates = rows.groupBy("node", "batch_id").agg(F.max("t").alias("top"))
    before = scan(updates, ["node"], "batch_id", {"since": ("max", "top")})
    return rows.join(before.select("node", "batch_id", F.coalesce("since", F.lit(0)).alias("since")), ["node", "batch_id"]).withColumn("dt", F.col("t") - F.col("since")).drop("since")


def encode_times(rows: DataFrame, dim: int, dt: str = "dt") -> DataFrame:
    """``rows`` with ``time_x``: cosines of ``dim`` frequencies of a time difference."""
    return rows.withColumn("time_x", time2vec(F.col(dt).cast("double"), time2vec_weights(dim)))


# -- pooling and merging ---------------------------------------------------------------------------


def pool(rows: DataFrame, by: list[str], vector: str, how: str = "mean") -> DataFrame:
    """``by, pos, value``: mean or sum of each element of the vectors of a group."""
    if how not in ("mean", "sum"):
        raise ValueError(f"pooling is mean or sum, not {how!r}")
    op = F.avg if how == "mean" else F.sum
    return rows.select(*by, F.posexplode(vector).alias("pos", "v")).groupBy(*by, "pos").agg(op(F.col("v").cast("double")).alias("value"))


def merge(a: Column, b: Column, how: str = "concat", weights: tuple[float, float] = (1.0, 1.0)) -> Column:
    """Two embeddings to one: one after the other, or their weighted sum."""
    return merge_concat(a, b) if how == "concat" else merge_weighted(a, b, *weights)


def self_first(lists: DataFrame, node: str, q: str, nbrs: str, nbr_ts: str) -> DataFrame:
    """``lists`` with the node itself, at the time of the query, before its neighbours."""
    return lists.withColumn(nbrs, F.concat(F.array(node), nbrs)).withColumn(nbr_ts, F.concat(F.array(q), nbr_ts))


def patches(values: Column, size: int) -> Column:
    """A list cut into lists of ``size``; the last may be shorter."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(values) / size).cast("int") - 1, F.lit(0))), lambda i: F.slice(values, i * size + 1, size))


def neighbor_mean(found: DataFrame, features: DataFrame) -> DataFrame:
    """``seed_id, pos, value``: the mean of the features (nid, x) of each seed's neighbours; padding and seeds without neighbours have none."""
    return pool(found.join(features.select(F.col("nid").alias("nbr"), "x"), "nbr"), ["seed_id"], "x")


def attend(found: DataFrame, score: Column, value: Column) -> DataFrame:
    """``seed_id, value``: of each seed the sum of its neighbours' values by the softmax of their scores, both given; a seed has at most a buffer of them."""
    rows = found.select("seed_id", F.struct("slot", score.cast("double").alias("score"), value.cast("double").alias("value")).alias("n"))
    lists = rows.groupBy("seed_id").agg(F.array_sort(F.collect_list("n")).alias("n"))
    weights = softmax(F.transform("n", lambda n: n["score"]))
    return lists.select("seed_id", dot(weights, F.transform("n", lambda n: n["value"])).alias("value"))


# -- propagation -----------------------------------------------------------------------------------


def gcn_norm(edges: DataFrame, by: list[str]) -> DataFrame:
    """``by, u, v, w``: symmetric-normalised adjacency of each snapshot with self-loops, edges both ways, repeats added up."""
    loops = endpoints_of(edges, by).select(*by, F.col("nid").alias("u"), F.col("nid").alias("v"), F.lit(1.0).alias("a"))
    ways = F.array(F.struct(F.col("src").alias("u"), F.col("dst").alias("v")), F.struct(F.col("dst").alias("u"), F.col("src").alias("v")))
    both = edges.select(*by, F.explode(ways).alias("e")).select(*by, "e.u", "e.v", F.lit(1.0).alias("a"))
    weights = both.unionByName(loops).groupBy(*by, "u", "v").agg(F.sum("a").alias("a"))
    degree = weights.groupBy(*by, "u").agg(F.sum("a").alias("d"))
    sides = weights.join(degree.withColumnRenamed("d", "du"), [*by, "u"]).join(degree.select(*by, F.col("u").alias("v"), F.col("d").alias("dv")), [*by, "v"])
    return sides.select(*by, "u", "v", (F.col("a") / F.sqrt(F.col("du") * F.col("dv"))).alias("w"))


def endpoints_of(edges: DataFrame, by: list[str]) -> DataFrame:
    return edges.select(*by, F.explode(F.array("src", "dst")).alias("nid")).distinct()


def propagate(norm: DataFrame, values: DataFrame, by: list[str]) -> DataFrame:
    """``by, node, value``: the weighted sum of neighbours' ``value`` (by, node, value)."""
    return norm.join(values.withColumnRenamed("node", "v"), [*by, "v"]).groupBy(*by, F.col("u").alias("node")).agg(F.sum(F.col("w") * F.col("value")).alias("value"))


def chebyshev(edges: DataFrame, values: DataFrame, by: list[str], order: int) -> DataFrame:
    """``by, node, k, value``: Chebyshev polynomials 0 to ``order`` - 1 of each snapshot's Laplacian, applied to ``value`` (by, node, value).

    The Laplacian is symmetric-normalised and scaled by its bound 2, so it is minus the normalised adjacency of the
    edges both ways, self-loops left out: T0 = x, T1 = Lx, Tk = 2 L T(k-1) - T(k-2).
    """
    ways = F.array(F.struct(F.col("src").alias("u"), F.col("dst").alias("v")), F.struct(F.col("dst").alias("u"), F.col("src").alias("v")))
    weights = edges.where("src <> dst").select(*by, F.explode(ways).alias("e")).groupBy(*by, "e.u", "e.v").agg(F.count("*").cast("double").alias("a"))
    degree = weights.groupBy(*by, "u").agg(F.sum("a").alias("d"))
    sides = weights.join(degree.withColumnRenamed("d", "du"), [*by, "u"]).join(degree.select(*by, F.col("u").alias("v"), F.col("d").alias("dv")), [*by, "v"])
    norm = keep(sides.select(*by, "u", "v", (-F.col("a") / F.sqrt(F.col("du") * F.col("dv"))).alias("w")), "laplacian")
    terms = [values.select(*by, "node", F.col("value").cast("double").alias("value"))]
    for k in range(1, order):
        step = propagate(norm, terms[-1], by).withColumn("value", F.col("value") * (1 if k == 1 else 2))
        if k > 1:
            step = step.unionByName(terms[-2].withColumn("value", -F.col("value"))).groupBy(*by, "node").agg(F.sum("value").alias("value"))
        terms.append(keep(step, "chebyshev") if k < order - 1 else step)
    out = None
    for k, term in enumerate(terms):
        term = term.select(*by, "node", F.lit(k).alias("k"), "value")
        out = term if out is None else out.unionByName(term)
    return out


def edge_ratio(metrics: DataFrame) -> DataFrame:
    """``batch_id, tau``: all edges before a snapshot over these and its own (rows ``batch_id, n_edges``)."""
    before = sum_before(metrics.select("batch_id", "n_edges"), [], "batch_id", "n_edges", "b")
    return before.select("batch_id", (F.col("b") / (F.col("b") + F.col("n_edges"))).alias("tau"))


# -- common neighbours -----------------------------------------------------------------------------


def adjacency(edges: DataFrame, upto: Column | None = None) -> DataFrame:
    """``u, v, a``: edges both ways, repeats added up."""
    ways = F.array(F.struct(F.col("src").alias("u"), F.col("dst").alias("v")), F.struct(F.col("dst").alias("u"), F.col("src").alias("v")))
    rows = edges if upto is None else edges.where(upto)
    return rows.select(F.explode(ways).alias("e")).select("e.*").groupBy("u", "v").agg(F.count("*").cast("double").alias("a"))


def both_directions(edges: DataFrame, weight: Column | None = None) -> DataFrame:
    """``batch_id, u, v, w``: edges both ways, of each batch the weights (default: 1) of repeats added up."""
    ways = F.array(F.struct(F.col("src").alias("u"), F.col("dst").alias("v")), F.struct(F.col("dst").alias("u"), F.col("src").alias("v")))
    rows = edges.select("batch_id", (F.lit(1.0) if weight is None else weight).alias("w"), F.explode(ways).alias("e"))
    return rows.groupBy("batch_id", "e.u", "e.v").agg(F.sum("w").alias("w"))


class AsOf:
    """A matrix that grows batch by batch (rows ``batch_id, u, v, w``; batches from 0), to be read as it was before any batch.

    Each entry has versions, sums that hold from a batch to the next one that adds to it.  The batches of a version are cut
    into dyadic intervals, the nodes of a segment tree, at most two a level; a batch lies in one interval of each level.  So a
    row of the matrix is found by equality of row, level and interval, and what is found is the row's entries: not
    the history of a hub, however often its entries have changed.
    """

    def __init__(self, added: DataFrame):
        top = added.agg(F.max("batch_id")).first()[0]  # one number
        self.levels = max(1, int(top or 0).bit_length() + 1)
        rows = scan(added.select("batch_id", "u", "v", "w"), ["u", "v"], "batch_id", {"a": ("sum", "w"), "until": ("next", "batch_id")}, inclusive=True)
        # seen by the batches after batch_id, up to the one that adds again
        ends = F.coalesce(F.col("until") + 1, F.lit(1 << self.levels))
        pieces = self._pieces(F.col("batch_id") + 1, ends)
        self.entries = rows.select("u", "v", "a", F.explode(pieces).alias("p")).select("u", "v", "a", "p.level", "p.interval")

    def _pieces(self, start: Column, stop: Column) -> Column:
        """Dyadic intervals that together are start, ..., stop - 1: from below, an end that is the odd half of its parent stands alone."""
        none = F.array().cast("array<struct<level:int,interval:bigint>>")
        first = F.struct(start.cast("long").alias("lo"), stop.cast("long").alias("hi"), none.alias("found"))

        def up(state: Column, level: Column) -> Column:
            lo, hi = state["lo"], state["hi"]
            left, right = (lo < hi) & (lo % 2 == 1), (lo < hi) & (hi % 2 == 1)
            one = lambda test, at: F.when(test, F.array(F.struct(level.alias("level"), at.alias("interval")))).otherwise(none)
            found = F.concat(state["found"], one(left, lo), one(right, hi - 1))
            return F.struct(F.shiftright(lo + left.cast("long"), 1).alias("lo"), F.shiftright(hi - right.cast("long"), 1).alias("hi"), found.alias("found"))

        return F.aggregate(F.sequence(F.lit(0), F.lit(self.levels)), first, up, lambda state: state["found"])

    def rows(self, asked: DataFrame) -> DataFrame:
        """``batch_id, u, v, a``: the rows ``u`` asked for (batch_id, u; repeats count once) as they were before the batch."""
        probes = asked.select("batch_id", "u").distinct().withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(self.levels))))
        probes = probes.withColumn("interval", F.expr("shiftright(batch_id, level)"))
        return probes.join(self.entries, ["u", "level", "interval"]).select("batch_id", "u", "v", "a")


def _meetings(pairs: DataFrame, near: DataFrame, far: DataFrame | None, at: list[str]) -> DataFrame:
    """``at, pair_id, i, j, nbr, i1, j1, i2, j2``: a row for each node that one or two steps of i or j lead to, with the weights of these steps.

    ``near, far``: ``at, u, v, a``, rows of the adjacency for the nodes of pairs and of their neighbours, these with ``_or_stay``.  Steps and
    paths of both ends are added up at once.
    """
    ends = pairs.select("pair_id", *at, "i", "j", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("i").alias("u")), F.struct(F.lit(1).alias("side"), F.col("j").alias("u")))).alias("e")).select("pair_id", *at, "i", "j", "e.*")
    rows = ends.join(near, [*at, "u"]).select(*at, "pair_id", "i", "j", "side", F.col("v").alias("u"), F.col("a").alias("w"))
    stays = F.lit(True)
    if far is not None:
        outside = lambda c: (F.col(c) != F.col("i")) & (F.col(c) != F.col("j"))
        stays = F.col("v").isNull()
        rows = rows.join(far, [*at, "u"]).where(stays | outside("u") & outside("v"))
        rows = rows.withColumn("w", F.when(stays, F.col("w")).otherwise(F.col("w") * F.col("a"))).withColumn("u", F.coalesce("v", "u"))
    steps = F.when(stays, 1).otherwise(2)
    sums = (F.sum(F.when((F.col("side") == side) & (steps == n), F.col("w"))).alias(f"{name}{n}") for side, name in ((0, "i"), (1, "j")) for n in (1, 2))
    return rows.groupBy(*at, "pair_id", "i", "j", F.col("u").alias("nbr")).agg(*sums)


def _or_stay(rows: DataFrame, at: list[str]) -> DataFrame:
    """Rows of an adjacency, and of each node one more, without ``v``: that there is no second step."""
    return rows.unionByName(rows.select(*at, "u").distinct(), allowMissingColumns=True)


def _orders(k: int) -> Column:
    """``order, weight`` of every order of a row of ``_meetings``; null weights where the ends do not meet."""
    c, outside = F.col, (F.col("nbr") != F.col("i")) & (F.col("nbr") != F.col("j"))
    found = {"1-1": c("i1") * c("j1")}
    if k >= 4:
        found |= {"0-1": F.when(c("nbr") == c("i"), c("j1")), "1-0": F.when(c("nbr") == c("j"), c("i1"))}
    if k == 8:
        found |= {"1-2": F.when(outside, c("i1") * c("j2")), "2-1": F.when(outside, c("i2") * c("j1")), "2-2": c("i2") * c("j2")}
    return F.array(*(F.struct(F.lit(name).alias("order"), weight.alias("weight")) for name, weight in found.items()))


def common_neighbors(pairs: DataFrame, edges: DataFrame, k: int = 2, now: Column | int | None = None, updates: DataFrame | None = None, before: bool = False) -> DataFrame:
    """``pair_id, order, nbr, weight`` of ``pair_id, i, j``: the neighbours that two nodes have in common.

    ``1-1``: next to both, weighted by the product of the numbers of edges.  With ``k`` 4 also ``0-1`` and ``1-0``: j's
    neighbours that are i itself, and the other way round.  With 8 also ``1-2``, ``2-1`` and ``2-2``: paths of two
    steps, of which those over the pair's own link are taken out, and the pair's nodes never count.

    With ``updates`` (nid, last_update) weights decay by exp(-(now - last_update) / 10000).
    With ``before``, pairs and edges have a ``batch_id`` and a pair sees the edges of the batches before its own.
    """
    if before and k == 8:
        out = _ordered(_dealt(pairs, edges, blocks.meeting_rows, "pair_id long, place int, nbr long, weight double"))
    else:
        out = _weights(_all_meetings(pairs, edges, k, before))
    if updates is not None:
        last = updates.select(F.col("nid").alias("nbr"), "last_update")
        out = out.join(last, "nbr").withColumn("weight", F.col("weight") * F.exp(-(F.lit(now) - F.col("last_update")) / 10_000.0))
    return out.select("pair_id", "order", "nbr", "weight")


def _all_meetings(pairs: DataFrame, edges: DataFrame, k: int, before: bool) -> DataFrame:
    """``_meetings`` with their ``orders``; not for k 8 before a batch, which ``_dealt`` finds."""
    if k not in (2, 4, 8):
        raise ValueError(f"k is 2, 4 or 8, not {k}")
    if before:
        near = AsOf(both_directions(edges)).rows(pairs.select("batch_id", F.explode(F.array("i", "j")).alias("u")))
        return _meetings(pairs, near, None, ["batch_id"]).withColumn("orders", _orders(k))
    adj = adjacency(edges)
    return _meetings(pairs, adj, _or_stay(keep(adj, "adjacency"), []) if k == 8 else None, []).withColumn("orders", _orders(k))


def _weights(found: DataFrame) -> DataFrame:
    return found.select("pair_id", "nbr", F.explode("orders").alias("o")).select("pair_id", "o.order", "nbr", "o.weight").where("weight IS NOT NULL")


#: Of a block of the product of pairs and nodes: pairs, and nodes.
PAIRS, NODES = 150_000, 1 << 17


def _dealt(pairs: DataFrame, edges: DataFrame, write: Callable, schema: str, value: Column | None = None) -> DataFrame:
    """What ``write`` makes of the meetings of k 8 before the pairs' batches, in blocks of a span of batches times a hash of nodes.

    A block gets the pairs of its batches and the edges of all batches up to them, in packs of some bytes a row; what the ends were next to
    before each batch it finds itself.  So what is shuffled is packed edges times later spans, and never a path or a row as of a batch.
    """
    spark = pairs.sparkSession
    size = pairs.agg(F.count("*").alias("n"), F.max("batch_id").alias("last")).first()  # two numbers
    last = int(size["last"] or 0)
    earlier = edges.where(F.col("batch_id") < last)
    blocks_of = max(1, -(-earlier.select(F.explode(F.array("src", "dst")).alias("v")).distinct().count() // NODES))
    spans = min(last + 1, max(-(-size["n"] // PAIRS), -(-4 * spark.sparkContext.defaultParallelism // blocks_of)))
    width = -(-(last + 1) // spans)
    span = F.expr(f"batch_id div {width}").alias("part")
    whole = lambda *names: (F.col(c).cast("long").alias(c) for c in names)
    for end in ("src", "dst"):
        x = F.lit(0.0) if value is None else F.coalesce(value.cast("double"), F.lit(0.0))
        earlier = earlier.withColumn("nbr", F.col(end)).withColumn(f"x_{end}", x).drop("nbr")
    led = earlier.select(span, *whole("batch_id", "src", "dst"), "x_src", "x_dst").mapInArrow(blocks.in_packs(["batch_id", "src", "dst", "x_src", "x_dst"], 1), "part long, n int, data binary")
    asked = pairs.select(span, *whole("batch_id", "i", "j", "pair_id")).mapInArrow(blocks.in_packs(["batch_id", "i", "j", "pair_id"], 1), "part long, n int, data binary")
    rows = led.select(F.explode(F.sequence("part", F.lit(last // width).cast("long"))).alias("span"), F.lit(1).alias("kind"), "n", "data")
    rows = rows.unionAll(asked.select(F.col("part").alias("span"), F.lit(2).alias("kind"), "n", "data"))
    rows = rows.withColumn("blocks", F.lit(blocks_of)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks_of - 1))))
    # a few times as many partitions as blocks: few have two
    return rows.repartition(4 * spans * blocks_of, "span", "block").groupBy("span", "block").applyInArrow(blocks.on_pairs(write), schema)


def _ordered(rows: DataFrame) -> DataFrame:
    """The name of the order for its ``place``."""
    names = F.array(*map(F.lit, blocks.ORDERS))
    return rows.select("pair_id", names[F.col("place")].alias("order"), *(c for c in rows.columns if c not in ("pair_id", "place")))


def common_neighbor_sums(pairs: DataFrame, edges: DataFrame, value: Column, k: int = 8) -> DataFrame:
    """``pair_id, order, value``: sums of weight times ``value`` (an expression of ``nbr``; null counts as 0) over the common neighbours before the pair's batch.

    Two steps lead nearly everywhere, so what is summed is much more than what comes out: with ``k`` 8 it is added up where it is found.
    """
    if k == 8:
        sums = _ordered(_dealt(pairs, edges, blocks.meeting_sums, "pair_id long, place int, value double", value))
    else:
        sums = _weights(_all_meetings(pairs, edges, k, True)).withColumn("value", F.col("weight") * F.coalesce(value.cast("double"), F.lit(0.0)))
    return sums.groupBy("pair_id", "order").agg(F.sum("value").alias("value"))


def weighted_features(found: DataFrame, features: DataFrame) -> DataFrame:
    """``pair_id, order, pos, value``: the sum over common neighbours of weight times feature (features: nid, x)."""
    rows = found.join(features.select(F.col("nid").alias("nbr"), "x"), "nbr")
    return rows.select("pair_id", "order", "weight", F.posexplode("x").alias("pos", "v")).groupBy("pair_id", "order", "pos").agg(F.sum(F.col("weight") * F.col("v").cast("double")).alias("value"))


# -- temporal walks --------------------------------------------------------------------------------


def walk_matrices(edges: DataFrame, layers: int = 2, decay: float = 1e-6) -> DataFrame:
    """``layer, node, col, val``: temporal walk matrices after all batches.

    Layer 0 is the identity.  For each batch, layer i is first decayed by exp(-decay * dt * i) over the time since the
    batch before, and then, from the highest layer down, gains for each edge the row of layer i - 1 of the edge's
    other end, weighted by exp(-decay * (the batch's last time - t)).  Rows that do not appear are zero.

    No loop over batches: all decay of a layer adds up to exp(-decay * (the last time - t)) for each edge of a walk, so
    layer i is the sum over walks of i edges, each of an earlier batch than the edge before it, of the product of
    these weights.  The last layer, which nothing continues, is added up where it is returned; of two layers, both are.
    """
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    itself = nodes.select(F.lit(0).alias("layer"), "node", F.col("node").alias("col"), F.lit(1.0).alias("val"))
    if layers == 2:
        return itself.unionByName(_two_layers(edges, decay))
    steps = keep(_decayed_steps(edges, decay), "walks")
    walks, out = steps, itself
    for layer in range(1, layers + 1):
        if layer == layers > 1:
            done = _last_walks(steps, walks)
        else:
            if layer > 1:
                asked = steps.select("batch_id", F.col("v").alias("u"))
                earlier = AsOf(walks).rows(asked).select("batch_id", F.col("u").alias("v"), F.col("v").alias("col"), "a")
                walks = steps.join(earlier, ["batch_id", "v"]).groupBy("batch_id", "u", "col").agg(F.sum(F.col("w") * F.col("a")).alias("w")).withColumnRenamed("col", "v")
                walks = keep(walks, "walks")
            done = walks.groupBy(F.col("u").alias("node"), F.col("v").alias("col")).agg(F.sum("w").alias("val"))
        out = out.unionByName(done.select(F.lit(layer).alias("layer"), "node", "col", "val"))
    return out


#: Steps, and walks, of a block of a walk matrix.
STEPS = 1_000_000


def _two_layers(edges: DataFrame, decay: float) -> DataFrame:
    """``layer, node, col, val`` of layers 1 and 2, in blocks of two groups of nodes each.

    Steps go by a hash of the node where they start to a group, and are packed; a group is sent to a block with each group.  There the steps of
    either group, turned round, are the walks to it.  So a step is sent once for each group, in a few bytes, with its time for its weight.
    """
    spark = edges.sparkSession
    end = edges.agg(F.max("t")).first()[0] or 0  # one number
    ways = F.array(F.struct(F.col("src").alias("u"), F.col("dst").alias("v")), F.struct(F.col("dst").alias("u"), F.col("src").alias("v")))
    steps = keep(edges.select("batch_id", "t", F.explode(ways).alias("e")).select(*(F.col(c).cast("long").alias(c.split(".")[-1]) for c in ("batch_id", "t", "e.u", "e.v"))), "walks")
    n = max(-(-steps.count() // STEPS), math.isqrt(8 * spark.sparkContext.defaultParallelism) + 1)
    packs = steps.withColumn("part", F.expr(f"pmod(hash(u), {n})").cast("long")).mapInArrow(blocks.in_packs(["batch_id", "t", "u", "v"], 2), "part long, n int, data binary")
    sent = packs.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>")))
    sent = sent.select(F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "n", "data")
    # a few times as many partitions as blocks: few have two
    return sent.repartition(2 * n * (n + 1), "low", "high").groupBy("low", "high").applyInArrow(blocks.on_two_steps(decay, end), "layer int, node long, col long, val double")


def _last_walks(steps: DataFrame, walks: DataFrame) -> DataFrame:
    """``node, col, val``: walks of an earlier batch with one step before them, added up over batches, in blocks of hashes of both ends.

    A step is sent to the blocks of its node and a walk to those of its column, and a block is returned where it is added up.
    """
    spark = steps.sparkSession
    n = max(-(-max(steps.count(), walks.count()) // STEPS), math.isqrt(4 * spark.sparkContext.defaultParallelism - 1) + 1)
    each = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    row = lambda kind: (F.lit(kind).alias("kind"), *(F.col(c).cast("long").alias(c) for c in ("batch_id", "u", "v")), "w")
    rows = steps.select(F.expr(f"pmod(hash(u), {n})").alias("up"), each.alias("down"), *row(0))
    rows = rows.unionAll(walks.select(each.alias("up"), F.expr(f"pmod(hash(v), {n})").alias("down"), *row(1)))
    return rows.repartition(n * n, "up", "down").groupBy("up", "down").applyInArrow(blocks.on_walks, "node long, col long, val double")


def _decayed_steps(edges: DataFrame, decay: float) -> DataFrame:
    """``batch_id, u, v, w``: edges both ways, each weighted by exp(-decay * (the last time of all - t))."""
    end = edges.agg(F.max("t")).first()[0] or 0  # one number
    return both_directions(edges, F.exp(-decay * (F.lit(end) - F.col("t"))))


def projection(node: Column, dim: Column, dims: int, seed: int = 0) -> Column:
    """The entry of a random projection: 1 or -1 over the root of ``dims``, by a hash of node and dimension."""
    return (1 - 2 * (F.shiftright(scattered(node, dim, seed), 16) % 2)) / F.lit(dims**0.5)


def projected_walks(edges: DataFrame, layers: int = 2, dims: int = 64, decay: float = 1e-6, seed: int = 0) -> DataFrame:
    """``layer, node, col, val``: the rows of ``walk_matrices`` times a random matrix of ``dims`` columns, without the matrices.

    A node's row of any layer is ``dims`` numbers, to which each batch adds: of an edge the row of the layer below of its other end
    as it was before the batch, which is a sum before by (node, column).  So work and state are edges and nodes times
    ``dims``, whatever the degrees.  Dot products of rows x and y of the matrices are met with an error whose standard deviation
    is at most |x| |y| sqrt(2 / dims).
    """
    ks = F.explode(F.sequence(F.lit(0), F.lit(dims - 1))).alias("col")
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    out = nodes.select(F.lit(0).alias("layer"), "node", ks).withColumn("val", projection(F.col("node"), F.col("col"), dims, seed))
    steps = keep(_decayed_steps(edges, decay), "walks")
    rows = steps.select("batch_id", "u", "w", "v", ks).groupBy("batch_id", F.col("u").alias("node"), "col").agg(F.sum(F.col("w") * projection(F.col("v"), F.col("col"), dims, seed)).alias("val"))
    for layer in range(1, layers + 1):
        if layer > 1:
            asked = steps.select("batch_id", F.col("v").alias("node")).distinct().select("batch_id", "node", ks).withColumn("asks", F.lit(1))
            both = at_steps([rows, asked], ["node", "col", "batch_id"], {"val": "sum", "asks": "max"})
            before = scan(both, ["node", "col"], "batch_id", {"sum": ("sum", "val")}).where("asks = 1 AND sum IS NOT NULL").select("batch_id", F.col("node").alias("v"), "col", "sum")
            rows = steps.join(before, ["batch_id", "v"]).groupBy("batch_id", F.col("u").alias("node"), "col").agg(F.sum(F.col("w") * F.col("sum")).alias("val"))
        rows = keep(rows, "projected") if layer < layers else rows
        done = rows.groupBy("node", "col").agg(F.sum("val").alias("val"))
        out = out.unionByName(done.select(F.lit(layer).alias("layer"), "node", "col", "val"))
    return out


def walk_features(pairs: DataFrame, state: DataFrame) -> DataFrame:
    """``pair_id, li, lj, value`` of ``pair_id, i, j``: log(1 + relu) of the dot products of the two nodes' rows of every layer."""
    side = lambda node, layer, val: pairs.select("pair_id", F.col(node).alias("node")).join(state, "node").select("pair_id", F.col("layer").alias(layer), "col", F.col("val").alias(val))
    dots = side("i", "li", "a").join(side("j", "lj", "b"), ["pair_id", "col"]).groupBy("pair_id", "li", "lj").agg(F.sum(F.col("a") * F.col("b")).alias("d"))
    return dots.select("pair_id", "li", "lj", F.log1p(F.greatest("d", F.lit(0.0))).alias("value"))
