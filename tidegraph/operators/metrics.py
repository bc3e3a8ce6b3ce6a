"""Measures of predictions: ranks of positives, gain of vectors, areas of binary ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranking import global_rank
from ..functions.scan import scan

TIES = {"optimistic": 0.0, "average": 0.5, "pessimistic": 1.0}


def reciprocal_ranks(scored: DataFrame, by: list[str], tie: str = "average") -> DataFrame:
    """``by, rr`` for each positive: one over its rank among its negatives.  ``scored``: by, score, is_pos; one positive for each ``by``.

    Of the negatives with the positive's score all, half or none stand before it.
    """
    if tie not in TIES:
        raise ValueError(f"tie is one of {[*TIES]}, not {tie!r}")
    positive = F.max(F.when(F.col("is_pos"), F.col("score"))).over(Window.partitionBy(*by))
    counted = scored.withColumn("pos", positive).groupBy(*by).agg(F.count_if(~F.col("is_pos") & (F.col("score") > F.col("pos"))).alias("more"), F.count_if(~F.col("is_pos") & (F.col("score") == F.col("pos"))).alias("same"))
    return counted.select(*by, (1 / (1 + F.col("more") + TIES[tie] * F.col("same"))).alias("rr"))


def mrr(scored: DataFrame, by: list[str], tie: str = "average") -> DataFrame:
    return reciprocal_ranks(scored, by, tie).agg(F.avg("rr").alias("mrr"))


def ndcg(rows: DataFrame, k: int = 10) -> DataFrame:
    """``event_idx, ndcg`` of rows ``event_idx, y, pred`` (vectors): gain of the first ``k`` by prediction over the best gain; 0 without any gain.

    Equal predictions are ordered by place.
    """
    cells = rows.select("event_idx", F.posexplode(F.arrays_zip("y", "pred")).alias("pos", "e")).select("event_idx", "pos", F.col("e.y").cast("double").alias("y"), F.col("e.pred").cast("double").alias("p"))
    by_pred = F.row_number().over(Window.partitionBy("event_idx").orderBy(F.desc("p"), "pos"))
    by_gain = F.row_number().over(Window.partitionBy("event_idx").orderBy(F.desc("y"), "pos"))
    gain = lambda r: F.sum(F.when(F.col(r) <= k, F.col("y") / F.log2(F.col(r) + 1.0)).otherwise(0.0))
    sums = cells.withColumn("rp", by_pred).withColumn("rg", by_gain).groupBy("event_idx").agg(gain("rp").alias("dcg"), gain("rg").alias("best"))
    return sums.select("event_idx", F.coalesce(F.try_divide("dcg", F.when(F.col("best") > 0, F.col("best"))), F.lit(0.0)).alias("ndcg"))


def binary_areas(rows: DataFrame) -> DataFrame:
    """One row ``auroc, ap`` of rows ``label`` (0 or 1) and ``score``: null where a class is missing.

    Rows are first counted by score.  Distinct scores are ranked, and sums before each rank are a scan: as many scores as
    rows are no load of one task.
    """
    at = rows.groupBy("score").agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n"))
    run = scan(global_rank(at, [F.desc("score")], "rank"), [], "rank", {"tp": ("sum", "p"), "fp": ("sum", "n")}, inclusive=True)
    total = run.agg(F.sum("p").alias("P"), F.sum("n").alias("N"), F.sum(F.col("n") * (F.col("tp") - F.col("p") * 0.5)).alias("area"), F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"))
    return total.select(F.try_divide("area", (F.col("P") * F.col("N")).cast("double")).alias("auroc"), F.try_divide("precision", F.col("P").cast("double")).alias("ap"))
