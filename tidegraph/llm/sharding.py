"""Operator 7: sharding along a Hilbert curve.

Several metadata dimensions (language, source, size) are quantised by their quantiles; the cell's index on the
Hilbert curve orders the rows, so that rows near each other in all dimensions are near in the order; runs of
equal row counts are the shards.  A file of a run covers a narrow range of every dimension, so filters on any of
them skip files.

The global rank is found without a global sort in one task: rows are range-partitioned on the order, each
range is numbered by itself, and the ranges' counts (as many as partitions) give the offsets.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..workspace import keep
from .common import unused

SHARDS = 8
BITS = 4


def hilbert_index(cell: tuple[int, ...], bits: int) -> int:
    """A cell's index on the Hilbert curve through a cube of 2**bits a side (Skilling's transposition)."""
    x, n = list(cell), len(cell)
    step = 1 << (bits - 1)
    while step > 1:  # undo the excess work of the inverse transformation
        low = step - 1
        for i in range(n):
            if x[i] & step:
                x[0] ^= low
            else:
                swap = (x[0] ^ x[i]) & low
                x[0] ^= swap
                x[i] ^= swap
        step >>= 1
    for i in range(1, n):  # Gray code
        x[i] ^= x[i - 1]
    flip, step = 0, 1 << (bits - 1)
    while step > 1:
        if x[n - 1] & step:
            flip ^= step - 1
        step >>= 1
    index = 0
    for bit in range(bits - 1, -1, -1):
        for v in x:
            index = index << 1 | ((v ^ flip) >> bit & 1)
    return index


def string_cuts(rows: DataFrame, value: str, steps: list[float]) -> list[str | None]:
    """The quantiles of a string column over whole values, nulls least: at each step the first value in order that it reaches.

    Counts of distinct values are range-partitioned and summed up within each range and over the ranges before.
    """
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = F.col(value).asc_nulls_first()
    counts = rows.groupBy(value).agg(F.count("*").alias("__n")).repartitionByRange(parts, order).withColumn("__part", F.spark_partition_id())
    counts = keep(counts, "shard-values")
    sums = sorted((r["__part"], r["n"]) for r in counts.groupBy("__part").agg(F.sum("__n").alias("n")).collect())  # a row a partition
    total, table = sum(n for _, n in sums), []
    for part, n in sums:
        table.append((part, table[-1][1] + table[-1][2] if table else 0, n))
    targets = [max(1, math.ceil(total * s)) for s in steps]
    wanted = {p: [t - before for t in targets if before < t <= before + n] for p, before, n in table}
    near = [p for p, inside in wanted.items() if inside]
    if not near:
        return []
    upto = F.sum("__n").over(Window.partitionBy("__part").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    hit = F.lit(False)
    for p in near:
        for t in wanted[p]:
            hit = hit | ((F.col("__part") == p) & (F.col("__upto") >= t) & (F.col("__upto") - F.col("__n") < t))
    found = {(r["__part"], r["__upto"]): (r[value], r["__n"]) for r in counts.where(F.col("__part").isin(near)).withColumn("__upto", upto).where(hit).collect()}  # at most a row a step
    return [next(v for (part, upto), (v, n) in found.items() if part == p and upto - n < t <= upto) for p in near for t in wanted[p]]


def _strings_below(value: Column, cuts: list[str | None]) -> Column:
    """How many of the cuts are less than a string; null is least."""
    nulls, known = cuts.count(None), [c for c in cuts if c is not None]
    below = sum(((value > F.lit(c)).cast("int") for c in known), F.lit(nulls))
    return F.when(value.isNull(), 0).otherwise(below)


def _below(value: Column, cuts: list[int]) -> Column:
    """How many of the cuts are less than a value."""
    return F.size(F.filter(F.array(*map(F.lit, cuts)).cast("array<long>"), lambda c: c < value))


def quantised(rows: DataFrame, dims: dict[str, Column], bits: int) -> DataFrame:
    """``rows`` with ``__q0``, ``__q1``, ...: for each dimension the number of its quantile cuts that are below the value."""
    values = [f"__v{i}" for i in range(len(dims))]
    valued = rows.withColumns(dict(zip(values, dims.values(), strict=True)))
    steps = [k / (1 << bits) for k in range(1, 1 << bits)]
    numbers = [v for v in values if valued.schema[v].dataType != T.StringType()]
    cuts = valued.agg(F.lit(0), *(F.percentile_approx(v, steps, 1000).alias(v) for v in numbers)).first()  # 2 ** bits - 1 numbers a dimension
    out = valued
    for i, v in enumerate(values):
        out = out.withColumn(f"__q{i}", _below(F.col(v), cuts[v] or []) if v in numbers else _strings_below(F.col(v), string_cuts(valued, v, steps)))
    return out.drop(*values)


def ranked(rows: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """``rows`` with ``__rank`` (from 0, in the order), and their number."""
    spark = rows.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = keep(rows.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()), "ranged")
    counts = {r["__part"]: r["n"] for r in ranged.groupBy("__part").agg(F.count("*").alias("n")).collect()}  # a row a partition
    before, offsets = 0, []
    for part in sorted(counts):
        offsets.append((part, before))
        before += counts[part]
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    table = spark.createDataFrame(offsets or [(0, 0)], "__part int, __before long")
    out = ranged.withColumn("__within", within).join(F.broadcast(table), "__part")
    return out.withColumn("__rank", F.col("__within") + F.col("__before")).drop("__within", "__before", "__part"), before


def cut_runs(rows: DataFrame, total: int, shards: int) -> DataFrame:
    """``rows`` with ``shard`` and ``slot`` from ``__rank``: runs of the order whose lengths differ by at most one."""
    short, longer = divmod(total, shards)
    edge, rank = longer * (short + 1), F.col("__rank")
    shard = F.when(rank < edge, F.floor(rank / (short + 1))).otherwise(longer + F.floor((rank - edge) / max(1, short))).cast("int")
    start = F.when(F.col("shard") <= longer, F.col("shard") * (short + 1)).otherwise(edge + (F.col("shard") - longer) * short)
    return rows.withColumn("shard", shard).withColumn("slot", (rank - start).cast("long")).drop("__rank")


def shard_documents(docs: DataFrame, shards: int = SHARDS, bits: int = BITS, whole: bool = False) -> DataFrame:
    """``doc_id, size, text_crc32, lang, source, hilbert, shard, slot`` for each row of ``docs``; with ``whole`` also ``row``, a struct of all its columns.

    Law: ``rows``.  Size: UTF-8 bytes of the text (null: 0) plus 1.  Null languages and sources come first;
    ties on the curve are ordered by text and id; equal rows in either order.  An empty table gives an
    empty result.  Missing ``lang`` or ``source`` columns count as null; further columns are not read.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    known = {c: F.col(c).cast("string") if c in docs.columns else F.lit(None).cast("string") for c in ("lang", "source")}
    row = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")] * whole
    meta = keep(docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), *(c.alias(k) for k, c in known.items()), *row), "shard-meta")
    dims = {"lang": F.col("lang"), "source": F.col("source"), "size": F.col("size")}
    celled = quantised(meta, dims, bits)
    n, side = len(dims), 1 << bits
    cells = [(*c, hilbert_index(c, bits)) for c in ((k // side**2, k // side % side, k % side) for k in range(side**n))]
    curve = docs.sparkSession.createDataFrame(cells, ", ".join(f"__q{i} int" for i in range(n)) + ", hilbert int")  # 2 ** (bits * dimensions) rows
    placed = celled.join(F.broadcast(curve), [f"__q{i}" for i in range(n)]).drop(*(f"__q{i}" for i in range(n)))
    rows, total = ranked(placed, ["hilbert", "text_crc32", "size", "doc_id"])
    return cut_runs(rows, total, shards)


def shard_report(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` (null: the law is ``rows``) for each row of ``docs``."""
    out = shard_documents(docs, shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Write ``docs``, all rows and columns, as one folder ``shard=N`` for each shard, rows in slot order within a file.

    Repeated rows and rows without an id are written each.  If ``docs`` has a column ``shard``, the folders are ``shard_=N``.
    """
    shard, slot = unused(docs, "shard"), unused(docs, "slot")
    placed = shard_documents(docs, shards, whole=True).select("row.*", F.col("shard").alias(shard), F.col("slot").alias(slot))
    placed.repartitionByRange(shard, slot).sortWithinPartitions(shard, slot).drop(slot).write.partitionBy(shard).parquet(path)
