"""Sources: CSV files, pandas and Spark frames, benchmark bundles, token transfers."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frame import EventLog
from ..functions.ranking import global_rank
from ..functions.scalar import min_max
from ..operators.splits import BoundsSplit
from ..timedelta import TimeDelta, delta_of


def _vector(df: DataFrame, columns: str | list[str] | None):
    """One vector column from a column of lists, or from several columns of numbers."""
    if columns is None:
        return None
    if isinstance(columns, str):
        kind = dict(df.dtypes)[columns]
        return F.col(columns).cast("array<float>") if kind.startswith("array") else F.array(F.col(columns).cast("float"))
    return F.array(*(F.col(c).cast("float") for c in columns))


def _select(df: DataFrame | None, ids: dict[str, str | None], vector: str, columns, what: str) -> DataFrame | None:
    if df is None:
        return None
    for name, column in ids.items():
        if column is None and name != "edge_type":
            raise ValueError(f"{what} need the name of the column of {name}")
    out = [F.col(c).cast("int" if n == "edge_type" else "long").alias(n) for n, c in ids.items() if c is not None]
    v = _vector(df, columns)
    return df.select(*out, *([v.alias(vector)] if v is not None else []), "__row") if "__row" in df.columns else df.select(*out, *([v.alias(vector)] if v is not None else []))


def from_spark(
    edges: DataFrame, src: str, dst: str, t: str, edge_x=None, edge_type: str | None = None,
    node_x: DataFrame | None = None, node_x_nid: str | None = None, node_x_t: str | None = None, node_x_x=None,
    node_y: DataFrame | None = None, node_y_nid: str | None = None, node_y_t: str | None = None, node_y_y=None,
    static: DataFrame | None = None, static_x=None, node_type: str | None = None, delta: TimeDelta | str = "r", order: dict[int, list[str]] | None = None,
) -> EventLog:
    """A log from frames and the names of their columns; features are a column of lists or several columns of numbers.

    ``static`` has a row a node and the column ``nid``.
    """
    if static is not None and static_x is None and node_type is None:
        raise ValueError("static node data need a feature or a type column")
    keep_order = lambda df, kind: df if df is None or not (order or {}).get(kind) else df.withColumn("__row", F.col(order[kind][0]))
    parts = [
        _select(keep_order(edges, 0), {"src": src, "dst": dst, "t": t, "edge_type": edge_type}, "edge_x", edge_x, "edges"),
        _select(keep_order(node_x, 1), {"nid": node_x_nid, "t": node_x_t}, "x", node_x_x, "node features"),
        _select(keep_order(node_y, 2), {"nid": node_y_nid, "t": node_y_t}, "y", node_y_y, "node labels"),
    ]
    nodes = None
    if static is not None:
        vector = _vector(static, static_x)
        nodes = static.select(F.col("nid").cast("long").alias("nid"), (vector if vector is not None else F.lit(None).cast("array<float>")).alias("static_x"), (F.col(node_type).cast("int") if node_type else F.lit(None).cast("int")).alias("node_type"))
    return EventLog.of(*parts, nodes, delta, {k: ["__row"] for k in (order or {})})


def from_pandas(spark: SparkSession, edges, src: str, dst: str, t: str, node_x=None, node_y=None, static=None, **names) -> EventLog:
    """``from_spark`` over pandas frames; rows keep their order, and static rows are nodes 0, 1, ..."""

    def frame(pdf):
        return None if pdf is None else spark.createDataFrame(pdf.reset_index(drop=True).rename_axis("__ordinal").reset_index())

    fixed = frame(static)
    if fixed is not None:
        fixed = fixed.withColumnRenamed("__ordinal", "nid")
    given = {0: edges, 1: node_x, 2: node_y}
    return from_spark(frame(edges), src, dst, t, node_x=frame(node_x), node_y=frame(node_y), static=fixed, order={k: ["__ordinal"] for k, v in given.items() if v is not None}, **names)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header, and ``__ordinal``, the row's number; types are read from the values."""
    df = spark.read.csv(path, header=True, inferSchema=True)
    return global_rank(df.withColumn("__line", F.monotonically_increasing_id()), ["__line"], "__ordinal").drop("__line")


def from_csv(spark: SparkSession, edges: str, src: str, dst: str, t: str, node_x: str | None = None, node_y: str | None = None, static: str | None = None, **names) -> EventLog:
    """``from_spark`` over CSV files; rows keep their order, and the rows of the static file are nodes 0, 1, ..."""
    read = lambda path: None if path is None else read_csv(spark, path)
    fixed = read(static)
    if fixed is not None:
        fixed = fixed.withColumnRenamed("__ordinal", "nid")
    given = {0: edges, 1: node_x, 2: node_y}
    return from_spark(read(edges), src, dst, t, node_x=read(node_x), node_y=read(node_y), static=fixed, order={k: ["__ordinal"] for k, v in given.items() if v is not None}, **names)


def bounds_of(edges: DataFrame) -> dict[str, tuple[int, int]]:
    """First and last time of each part, of edges with the flags ``train, val`` and ``test``."""
    parts = ("train", "val", "test")
    row = edges.agg(*(f(F.when(F.col(p).cast("boolean"), F.col("t"))).alias(f"{p}_{n}") for p in parts for n, f in (("first", F.min), ("last", F.max)))).first()
    if empty := [p for p in parts if row[f"{p}_first"] is None]:
        raise ValueError(f"no edge is of {', '.join(empty)}")
    return {p: (row[f"{p}_first"], row[f"{p}_last"]) for p in parts}


def from_sequence_bundle(spark: SparkSession, path: str, dataset: str | None = None, delta: TimeDelta | str | None = None) -> EventLog:
    """A sequence benchmark as a folder: ``edges.parquet`` (src, dst, t, train, val, test[, edge_x, ordinal]) and optionally ``nodes.parquet`` (nid, static_x).

    Flags say of which part an edge is; the parts' bounds are the first and last times of their edges.  The granularity is
    that of the ``dataset``, or ``delta``.
    """
    if (dataset is None) == (delta is None):
        raise ValueError("either the dataset or a granularity is needed")
    edges = spark.read.parquet(f"{path}/edges.parquet")
    nodes = _optional(spark, f"{path}/nodes.parquet")
    order = {0: ["ordinal"]} if "ordinal" in edges.columns else None
    log = EventLog.of(edges.drop("train", "val", "test"), None, None, nodes, delta if dataset is None else delta_of(dataset), order)
    return EventLog(log.events, log.delta, log.nodes, BoundsSplit(bounds_of(edges)))


def _optional(spark: SparkSession, path: str) -> DataFrame | None:
    """A table that may be missing."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    return spark.read.parquet(path) if there else None


def from_bundle(spark: SparkSession, path: str, kind: str = "link", delta: TimeDelta | str | None = None, dataset: str | None = None) -> EventLog:
    """A benchmark as a folder: ``edges.parquet`` (src, dst, t[, edge_x, edge_type, ordinal]), optionally ``labels.parquet`` (nid, t, y) and
    ``nodes.parquet`` (nid, static_x, node_type), and ``bounds.json`` with the first and last time of each part.

    ``kind``: link, node, knowledge (edge types needed) or heterogeneous (edge and node types needed).  Labels of a
    node benchmark are kept from a tick before the first edge to before the last.  The granularity is ``delta``, else that
    of the ``dataset`` by name, else seconds.
    """
    delta = delta if delta is not None else "s" if dataset is None else delta_of(dataset)
    edges = spark.read.parquet(f"{path}/edges.parquet")
    text = "\n".join(r["value"] for r in spark.read.text(f"{path}/bounds.json").collect())
    bounds = {k: tuple(v) for k, v in json.loads(text).items()}
    have = lambda name: spark.read.parquet(f"{path}/{name}.parquet") if kind in ("node", "heterogeneous") or name == "nodes" else None
    nodes = have("nodes") if kind == "heterogeneous" else None
    if kind in ("knowledge", "heterogeneous") and "edge_type" not in edges.columns:
        raise ValueError(f"a {kind} benchmark needs edge types")
    if kind == "heterogeneous" and "node_type" not in nodes.columns:
        raise ValueError("a heterogeneous benchmark needs node types")
    labels = None
    if kind == "node":
        first, last = edges.agg(F.min("t"), F.max("t")).first()
        labels = have("labels").where((F.col("t") >= first - 1) & (F.col("t") < last))
    order = {0: ["ordinal"]} if "ordinal" in edges.columns else None
    log = EventLog.of(edges, None, labels, nodes, delta, order)
    return EventLog(log.events, log.delta, log.nodes, BoundsSplit(bounds))


def token_transfers(transfers: DataFrame) -> DataFrame:
    """``src, dst, t, w, ordinal`` of transfers ``from, to, timestamp, value, ordinal``: times from 0, values scaled to [1, 10], addresses numbered.

    Numbers are in the order of first appearance: all senders first, then receivers.
    """
    ends = transfers.select(F.col("from").alias("address"), F.col("ordinal").alias("at"), F.lit(0).alias("side")).unionByName(transfers.select(F.col("to").alias("address"), F.col("ordinal").alias("at"), F.lit(1).alias("side")))
    first = ends.groupBy("address").agg(F.min(F.struct("side", "at")).alias("f")).select("address", "f.side", "f.at")
    ids = global_rank(first, ["side", "at", "address"], "id").select("address", "id")
    t0, low, high = transfers.agg(F.min("timestamp"), F.min("value"), F.max("value")).first()
    rows = transfers.join(ids.withColumnRenamed("id", "src"), F.col("from") == F.col("address")).drop("address").join(ids.withColumnRenamed("id", "dst"), F.col("to") == F.col("address")).drop("address")
    return rows.select("src", "dst", (F.col("timestamp") - F.lit(t0)).alias("t"), min_max(F.col("value"), F.lit(low), F.lit(high)).alias("w"), "ordinal")
