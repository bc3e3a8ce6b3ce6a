"""Negative edges.  Draws are hashes of what they are for, so runs and retries agree."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranking import count_before, global_rank, numbered, sum_before
from ..functions.scalar import PADDING, hashed
from ..functions.scan import EVENT_BITS, scan


def random_negatives(edges: DataFrame, low: int, high: int, ratio: float = 1.0, seed: int = 0) -> DataFrame:
    """``batch_id, ordinal, neg, neg_t``: round(ratio * edges) ids of each batch, each in [low, high), at the times of the batch's edges in turn."""
    if low < 0 or low >= high or not 0 < ratio <= 1:
        raise ValueError(f"negatives need 0 <= low < high and a ratio in (0, 1]: {low}, {high}, {ratio}")
    order = Window.partitionBy("batch_id").orderBy("event_idx")
    whole = Window.partitionBy("batch_id")
    rows = edges.withColumn("ordinal", (F.row_number().over(order) - 1).cast("long")).withColumn("n", F.count("*").over(whole))
    # round half to even, as the count of a float product
    kept = rows.where(F.col("ordinal") < F.bround(F.col("n") * F.lit(float(ratio)), 0))
    return kept.select("batch_id", "ordinal", (low + F.pmod(hashed("batch_id", "ordinal", seed), F.lit(high - low))).alias("neg"), F.col("t").alias("neg_t"))


def historical_negatives(edges: DataFrame, seed: int = 0, earlier: DataFrame | None = None) -> DataFrame:
    """``batch_id, event_idx, src, neg, valid``: for each source of a batch one destination of its edges in earlier batches, -1 if there is none.

    Each earlier edge is as likely as another; all edges of a source in a batch share the draw.  Entries of a
    source are numbered, and the draw is a number up to how many are before the batch, so no history is joined whole.

    ``earlier``: how many edges (src, dst, n) there were before all batches.  They are the first numbers, and a number is found
    among the sums of the counts by a scan.
    """
    rows = edges.select("src", "batch_id", "event_idx", "dst")
    past = numbered(rows, ["src"], "batch_id", ["event_idx"], "ord")
    before = count_before(rows, rows, ["src"], "batch_id", "c")
    known = F.lit(0).cast("long")
    if earlier is not None:
        before = before.join(earlier.groupBy("src").agg(F.sum("n").alias("known")), "src", "left")
        known = F.coalesce("known", known)
    before = before.select("src", "batch_id", known.alias("known"), (F.col("c") + known).alias("c")).where("c > 0")
    draw = before.select("src", "batch_id", "known", (1 + F.pmod(hashed("src", "batch_id", seed), F.greatest("c", F.lit(1)))).alias("ord"))
    own = draw.where("ord > known").select("src", "batch_id", (F.col("ord") - F.col("known")).alias("ord"))
    drawn = own.join(past.select("src", "ord", F.col("dst").alias("neg")), ["src", "ord"]).select("src", "batch_id", "neg")
    if earlier is not None:
        drawn = drawn.unionByName(_among(draw.where("ord <= known").select("src", "batch_id", "ord"), earlier))
    out = edges.select("batch_id", "event_idx", "src").join(drawn, ["src", "batch_id"], "left")
    return out.select("batch_id", "event_idx", "src", F.coalesce("neg", F.lit(PADDING)).alias("neg"), F.col("neg").isNotNull().alias("valid"))


def _among(draws: DataFrame, counts: DataFrame) -> DataFrame:
    """``src, batch_id, neg`` of draws (src, batch_id, ord from 1): the destination at that place, destinations in order of id, each as often as counted."""
    starts = sum_before(counts.select("src", "dst", "n"), ["src"], "dst", "n", "__start", EVENT_BITS)
    both = starts.select("src", (F.col("__start") + 1).alias("ord"), "dst").unionByName(draws, allowMissingColumns=True)
    found = scan(both, ["src"], "ord", {"neg": ("last", "dst")}, inclusive=True, bits=EVENT_BITS)
    return found.where("batch_id IS NOT NULL").select("src", "batch_id", "neg")


def counts_after(edges: DataFrame, earlier: DataFrame | None = None) -> DataFrame:
    """``src, dst, n``: how many edges there were by the end."""
    now = edges.groupBy("src", "dst").agg(F.count("*").alias("n"))
    return now if earlier is None else now.unionByName(earlier).groupBy("src", "dst").agg(F.sum("n").alias("n"))


def listed_negatives(edges: DataFrame, negatives: DataFrame, typed: bool = False) -> DataFrame:
    """``edges`` with ``negs``: the list given for (src, dst, t[, edge_type]) in ``negatives``; null where none is given."""
    keys = ["src", "dst", "t", *(["edge_type"] if typed else [])]
    return edges.join(negatives.select(*keys, "negs"), keys, "left")


def batch_negatives(listed: DataFrame, seed: int = 0) -> DataFrame:
    """``batch_id, neg, neg_t``: the sorted distinct negatives of each batch, each at a time drawn from the batch's span."""
    spans = listed.groupBy("batch_id").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    distinct = listed.select("batch_id", F.explode("negs").alias("neg")).distinct()
    return distinct.join(spans, "batch_id").select("batch_id", "neg", (F.col("lo") + F.pmod(hashed("batch_id", "neg", seed), F.col("hi") - F.col("lo") + 1)).alias("neg_t"))


def sequence_negatives(edges: DataFrame, low: int, high: int, per_edge: int = 100, seed: int = 0) -> DataFrame:
    """``edges`` with ``negs``: ``per_edge`` draws in [low, high) for each."""
    return edges.withColumn("negs", F.transform(F.sequence(F.lit(0), F.lit(per_edge - 1)), lambda i: low + F.pmod(hashed("event_idx", i, seed), F.lit(high - low))))


def stored_negatives(edges: DataFrame, stored: DataFrame) -> DataFrame:
    """``edges`` with ``negs``: row by row of a stored matrix ``row, negs`` (from 0), in the order of events: the running offset of a split's edges.

    The edges of the split are ranked, whatever their batches, and joined by number; an edge beyond the matrix has null.
    """
    ranked = global_rank(edges, ["event_idx"], "__row")
    return ranked.join(stored.select(F.col("row").cast("long").alias("__row"), "negs"), "__row", "left").drop("__row")


def split_negatives(edges: DataFrame, part: str, stored: DataFrame | None = None, per_edge: int = 100, seed: int = 0) -> DataFrame:
    """The negatives of a sequence benchmark: of the test part those that are stored, of others ``per_edge`` draws from the destinations' span (its end is not drawn)."""
    if part == "test":
        if stored is None:
            raise ValueError("the test part has stored negatives, which are needed")
        return stored_negatives(edges, stored)
    low, high = edges.agg(F.min("dst"), F.max("dst")).first()
    return edges.withColumn("negs", F.lit(None).cast("array<bigint>")) if low is None else sequence_negatives(edges, low, max(high, low + 1), per_edge, seed)


def candidates(listed: DataFrame) -> DataFrame:
    """``batch_id, event_idx, src, slot, dst, is_pos``: each edge's destination (slot 0) and its negatives."""
    every = F.concat(F.array("dst"), F.coalesce("negs", F.array().cast("array<bigint>")))
    return listed.select("batch_id", "event_idx", "src", F.posexplode(every).alias("slot", "dst")).withColumn("is_pos", F.col("slot") == 0)
