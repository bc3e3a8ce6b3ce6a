"""Predictors that only remember: each scores a batch from what came before it.

``init`` are the edges a predictor starts with (batch -1); ``edges`` those it is then shown batch by batch.  Queries
are rows ``batch_id`` (and more); a query sees ``init`` and the batches before its own.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranking import count_before, numbered, sum_before
from ..functions.scalar import sigmoid
from ..functions.scan import EVENT_BITS, at_steps, scan


def with_history(init: DataFrame, edges: DataFrame) -> DataFrame:
    """``batch_id, event_idx, src, dst, t`` of both; the initial edges are batch -1."""
    columns = ("event_idx", "src", "dst", "t")
    return init.select(F.lit(-1).cast("long").alias("batch_id"), *columns).unionByName(edges.select("batch_id", *columns))


def batch_clock(history: DataFrame, queries: DataFrame) -> DataFrame:
    """``batch_id, we``: for each batch of the queries the latest time before it.  A row a batch."""
    return asked_before(history, queries, [], "t", "we")


def asked_before(history: DataFrame, queries: DataFrame, keys: list[str], value: str, alias: str) -> DataFrame:
    """``keys, batch_id`` of the queries, each once, with the greatest ``value`` of the history's rows of the same keys in earlier batches."""
    past = history.groupBy(*keys, "batch_id").agg(F.max(value).alias("__value"))
    asked = queries.select(*keys, "batch_id").distinct().withColumn("__asks", F.lit(1))
    steps = at_steps([past, asked], [*keys, "batch_id"], {"__value": "max", "__asks": "max"})
    return scan(steps, keys, "batch_id", {alias: ("max", "__value")}).where("__asks = 1").select(*keys, "batch_id", alias)


def latest_before(history: DataFrame, queries: DataFrame, keys: list[str], value: str, alias: str) -> DataFrame:
    """``queries`` with the greatest ``value`` of the history's rows of the same keys in earlier batches.

    One scan over both sides by key, so a key's history is never repeated for its queries, nor in one task.
    """
    return queries.join(asked_before(history, queries, keys, value, alias), [*keys, "batch_id"])


def initial_span(init: DataFrame) -> float:
    """Time between the first and the last of the initial edges; 0 without any."""
    first, last = init.agg(F.min("t"), F.max("t")).first()
    return 0.0 if first is None else float(last - first)


def edgebank(init: DataFrame, edges: DataFrame, queries: DataFrame, memory: str = "unlimited", window_ratio: float = 0.15, pos_prob: float = 1.0) -> DataFrame:
    """``queries`` (batch_id, src, dst) with ``score``: ``pos_prob`` if the pair was seen, else 0.

    ``fixed`` remembers the last ``window_ratio`` of the initial span only, counted back from the latest time seen.
    """
    if memory not in ("unlimited", "fixed"):
        raise ValueError(f"memory is unlimited or fixed, not {memory!r}")
    if not 0 < window_ratio <= 1 or not 0 <= pos_prob <= 1:
        raise ValueError("window_ratio must be in (0, 1] and pos_prob in [0, 1]")
    history = with_history(init, edges)
    last = latest_before(history, queries, ["src", "dst"], "t", "last_t")
    hit = F.col("last_t").isNotNull()
    if memory == "fixed":
        size = initial_span(init) * window_ratio
        last = last.join(batch_clock(history, queries), "batch_id")
        hit = hit & (F.col("last_t") >= F.col("we") - F.lit(size))
    return last.select(*queries.columns, F.when(hit, float(pos_prob)).otherwise(0.0).alias("score"))


def poptrack(init: DataFrame, edges: DataFrame, queries: DataFrame, decay: float = 0.9) -> DataFrame:
    """``queries`` (batch_id, dst) with ``score``: how often each destination was met, each update's counts decayed once for it and for each later one.

    Updates are the initial edges and then the batches, numbered without gaps.  A destination's updates are cut into
    blocks of steps so short that no power overflows; the score is a running sum within the block, and the sums of
    the two blocks before it: what is older than these has decayed below the least double.  Without decay it is a scan.
    """
    if not 0 < decay <= 1:
        raise ValueError("decay must be in (0, 1]")
    history = with_history(init, edges)
    if decay == 1:
        return running_count(history, queries, ["dst"], "score").select(*queries.columns, F.col("score").cast("double").alias("score"))
    block = max(1, int(600 / -math.log(decay)))
    numbers = history.unionByName(queries.select("batch_id"), allowMissingColumns=True).select("batch_id").distinct().withColumn("one", F.lit(1))
    numbers = sum_before(numbers, [], "batch_id", "one", "step").select("batch_id", (F.col("step") + 1).alias("step"))  # a row a batch
    numbers = numbers.withColumn("block", F.expr(f"step div {block}")).withColumn("inside", (F.col("step") - F.col("block") * block).cast("double"))
    up = lambda exponent: F.pow(F.lit(float(decay)), exponent)
    counts = history.groupBy("dst", "batch_id").agg(F.count("*").alias("n")).join(numbers, "batch_id").withColumn("mass", F.col("n") * up(-F.col("inside")))
    asked = queries.select("dst", "batch_id").distinct().join(numbers, "batch_id")
    seen = counts.select("dst", "block", "step", F.lit(1).alias("adds"), "mass", "inside", F.lit(None).cast("long").alias("batch_id")).unionByName(
        asked.select("dst", "block", "step", F.lit(0).alias("adds"), F.lit(0.0).alias("mass"), "inside", "batch_id"))
    running = Window.partitionBy("dst", "block").orderBy("step", "adds").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # at most two rows a step
    here = seen.withColumn("here", F.sum("mass").over(running) * up(F.col("inside"))).where("adds = 0").select("dst", "batch_id", "block", "inside", "here")
    back = F.explode(F.array(F.lit(1), F.lit(2))).alias("back")
    totals = counts.groupBy("dst", "block").agg(F.sum("mass").alias("total")).select("dst", "total", F.col("block").alias("from"), back)
    totals = totals.select("dst", (F.col("from") + F.col("back")).alias("block"), "total", "back")
    earlier = here.join(totals, ["dst", "block"]).groupBy("dst", "batch_id").agg(F.sum(F.col("total") * up(F.col("inside") + F.col("back") * block)).alias("before"))
    scored = here.join(earlier, ["dst", "batch_id"], "left").select("dst", "batch_id", (F.col("here") + F.coalesce("before", F.lit(0.0))).alias("score"))
    return queries.join(scored, ["dst", "batch_id"]).select(*queries.columns, "score")


def recent_destinations(history: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``batch_id, src, nbr, nbr_t``: for each query's source the last ``k`` edges before the batch, by numbers as in ``neighbors.recent``."""
    rows = numbered(history, ["src"], "batch_id", ["event_idx"], "ord")
    held = count_before(history, queries, ["src"], "batch_id", "c").where("c > 0")
    wanted = held.select("batch_id", "src", F.explode(F.sequence(F.greatest(F.col("c") - k + 1, F.lit(1)), F.col("c"))).alias("ord"))
    return wanted.join(rows.select("src", "ord", F.col("dst").alias("nbr"), F.col("t").alias("nbr_t")), ["src", "ord"]).select("batch_id", "src", "nbr", "nbr_t")


def running_count(history: DataFrame, queries: DataFrame, keys: list[str], alias: str) -> DataFrame:
    """``queries`` with how many rows of the same keys earlier batches have."""
    return queries.join(count_before(history, queries, keys, "batch_id", alias), [*keys, "batch_id"])


def tcomem(init: DataFrame, edges: DataFrame, queries: DataFrame, k: int = 50, weight: float = 0.8) -> DataFrame:
    """``queries`` (batch_id, src, dst) with ``score``: decayed recency of the source's last ``k`` edges times the candidate's popularity, and co-occurrence of the pair.

    Times decay over the initial span; co-occurrence counts edges both ways, a self-loop twice.
    """
    if k <= 0 or not 0 <= weight <= 1:
        raise ValueError("k must be positive and the weight in [0, 1]")
    history = with_history(init, edges)
    clock = batch_clock(history, queries).withColumn("w", F.lit(max(initial_span(init), 1.0)))
    ring = recent_destinations(history, queries, k).join(clock, "batch_id").where("nbr_t <= we AND nbr_t >= we - w")
    decayed = ring.groupBy("batch_id", "src").agg(F.sum(F.exp(-(F.col("we") - F.col("nbr_t")) / F.col("w"))).alias("recency"))
    pairs = F.array(F.struct(F.col("src").alias("src"), F.col("dst").alias("dst")), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
    both_ways = history.select("batch_id", "event_idx", F.explode(pairs).alias("p")).select("batch_id", "event_idx", "p.*")
    distinct = queries.select("batch_id", "src", "dst").distinct()
    scored = running_count(both_ways, distinct, ["src", "dst"], "co")
    scored = running_count(history, scored, ["dst"], "pop").join(decayed, ["batch_id", "src"], "left")
    score = F.coalesce("recency", F.lit(0.0)) * sigmoid(F.col("pop").cast("double")) + weight * F.col("co") / (1 + F.col("co"))
    return queries.join(scored.select("batch_id", "src", "dst", score.alias("score")), ["batch_id", "src", "dst"]).select(*queries.columns, "score")


def base3(init: DataFrame, edges: DataFrame, queries: DataFrame, memory: str = "unlimited", k: int = 50, weight: float = 0.8) -> DataFrame:
    """``queries`` with the mean of the scores of ``edgebank`` and ``tcomem``."""
    keys = ["batch_id", "src", "dst"]
    distinct = queries.select(*keys).distinct()
    a = edgebank(init, edges, distinct, memory).withColumnRenamed("score", "__a")
    b = tcomem(init, edges, distinct, k, weight).withColumnRenamed("score", "__b")
    return queries.join(a.join(b, keys), keys).select(*queries.columns, ((F.col("__a") + F.col("__b")) / 2).alias("score"))


def node_forecast(labels: DataFrame) -> DataFrame:
    """``labels`` (event_idx, nid, y) with ``pred``: the node's label before this one; zeros for its first."""
    before = scan(labels, ["nid"], "event_idx", {"pred": ("last", "y")}, bits=EVENT_BITS)
    return before.withColumn("pred", F.coalesce("pred", F.transform("y", lambda v: (v * 0).cast("float"))))


def graph_forecast(metrics: DataFrame, metric: str = "n_edges", first: int | None = None) -> DataFrame:
    """``batch_id, pred``: that the metric goes on as it went: whether it grew from the snapshot before to this one.  ``first``: what is said of the first."""
    before = scan(metrics, [], "batch_id", {"__before": ("last", metric)})
    return before.select("batch_id", F.coalesce((F.col(metric) > F.col("__before")).cast("int"), F.lit(first).cast("int")).alias("pred"))
