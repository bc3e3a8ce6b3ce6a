"""A global row number that no single task has to sort for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..workspace import keep
from .scan import SPAN_BITS, at_steps, scan

#: ``monotonically_increasing_id`` has the partition above these bits and the place in it below.
PLACE_BITS = 33


def global_rank(rows: DataFrame, order: list[str | Column], name: str) -> DataFrame:
    """``rows`` with ``name`` (long, from 0): the place of each row in ``order``, which should be total.

    Rows are range-partitioned on the order, sorted within each range, numbered as they are written, and the
    counts of the ranges - one figure a partition - give where each begins.  How many ranges there are follows
    from what they hold, as adaptive execution joins small ones; one shuffle, whatever the size.
    """
    spark = rows.sparkSession
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__place", F.monotonically_increasing_id())
    ranged = keep(ranged, "ranged").withColumn("__part", F.shiftright("__place", PLACE_BITS))
    counts = {r["__part"]: r["n"] for r in ranged.groupBy("__part").agg(F.count("*").alias("n")).collect()}  # a row a partition
    before, offsets = 0, []
    for part in sorted(counts):
        offsets.append((part, before - (part << PLACE_BITS)))
        before += counts[part]
    table = spark.createDataFrame(offsets or [(0, 0)], "__part long, __offset long")
    return ranged.join(F.broadcast(table), "__part").withColumn(name, F.col("__place") + F.col("__offset")).drop("__part", "__place", "__offset")


def sum_before(rows: DataFrame, keys: list[str], step: str, n: str, alias: str, bits: int = SPAN_BITS) -> DataFrame:
    """``rows`` - one for each keys and step - with ``alias`` (long): the sum of ``n`` over the keys' rows of smaller steps."""
    return scan(rows, keys, step, {alias: ("sum", n)}, bits=bits).withColumn(alias, F.coalesce(alias, F.lit(0)).cast("long"))


def numbered(rows: DataFrame, keys: list[str], step: str, order: list[str], alias: str, bits: int = SPAN_BITS) -> DataFrame:
    """``rows`` with ``alias`` (long, from 1): their places among the keys' rows by ``step`` and then ``order``.

    Rows of one step are numbered by themselves, after as many as ``sum_before`` finds.
    """
    counts = sum_before(rows.groupBy(*keys, step).agg(F.count("*").alias("__n")), keys, step, "__n", "__first", bits).drop("__n")
    place = F.row_number().over(Window.partitionBy(*keys, step).orderBy(*order))
    return rows.withColumn("__place", place).join(counts, [*keys, step]).withColumn(alias, F.col("__place") + F.col("__first")).drop("__place", "__first")


def count_before(rows: DataFrame, asked: DataFrame, keys: list[str], step: str, alias: str, bits: int = SPAN_BITS) -> DataFrame:
    """``keys, step`` (each once) of ``asked`` with ``alias``: how many of ``rows``, or as many as their ``__n`` says, have the same keys and a smaller step."""
    there = rows if "__n" in rows.columns else rows.groupBy(*keys, step).agg(F.count("*").alias("__n"))
    wanted = asked.select(*keys, step).distinct().withColumn("__asks", F.lit(1))
    steps = at_steps([there, wanted], [*keys, step], {"__n": "sum", "__asks": "max"})
    return sum_before(steps, keys, step, "__n", alias, bits).where("__asks = 1").select(*keys, step, alias)
