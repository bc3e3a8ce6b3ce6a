"""Ids of batches: local numbering, and nodes that history has seen."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import PADDING


def local_ids(ids: DataFrame) -> DataFrame:
    """``batch_id, nid, local_id``: the distinct valid ids of each batch (rows ``batch_id, nid``), numbered in order from 0."""
    distinct = ids.where(F.col("nid") != PADDING).select("batch_id", "nid").distinct()
    return distinct.withColumn("local_id", (F.row_number().over(Window.partitionBy("batch_id").orderBy("nid")) - 1).cast("long"))


def global_to_local(ids: DataFrame, numbered: DataFrame) -> DataFrame:
    """``ids`` with the ``local_id`` of each; null for padding."""
    return ids.join(numbered, ["batch_id", "nid"], "left")


def seen_nodes(events: DataFrame, earlier: DataFrame | None = None) -> DataFrame:
    """``batch_id, position, nid``: the labels of each batch whose node was in an edge of this batch or an earlier one.

    ``position`` is the label's place among the batch's labels.  ``earlier``: nodes (nid) that edges have touched before all batches.
    """
    touched = events.where("kind = 0").select("batch_id", F.explode(F.array("src", "dst")).alias("nid"))
    if earlier is not None:
        touched = touched.unionByName(earlier.select(F.lit(None).cast("long").alias("batch_id"), "nid"))
    first = touched.groupBy("nid").agg(F.min(F.coalesce("batch_id", F.lit(-(1 << 62)))).alias("first_batch"))
    place = F.row_number().over(Window.partitionBy("batch_id").orderBy("event_idx")) - 1
    labels = events.where("kind = 2").select("batch_id", place.cast("long").alias("position"), "nid")
    return labels.join(first, "nid").where("first_batch <= batch_id").select("batch_id", "position", "nid")


def touched_after(events: DataFrame, earlier: DataFrame | None = None) -> DataFrame:
    """``nid``: the nodes that edges have touched by the end."""
    now = events.where("kind = 0").select(F.explode(F.array("src", "dst")).alias("nid"))
    return (now if earlier is None else now.unionByName(earlier)).distinct()
