"""Two temporal graphs over relational tables: user activity, and trade between customers and suppliers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .frame import EDGE, NODE_X, NODE_Y, EventLog

DESTINATIONS = 1000
SUPPLIERS = 1_000_000
#: 1995-01-01 in days since 1970.
FIRST_DAY = 9131


def _since_epoch(unit: str, t: Column) -> Column:
    return F.timestamp_diff(unit, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), t.cast("timestamp_ntz"))


def activity(spark: SparkSession, sf_dir: str, validate: bool = False) -> EventLog:
    """Users meet items: views, clicks and purchases are edges, sign-ups node features, errors node labels; time in seconds."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind = F.when(F.col("event_type") == "signup", NODE_X).when(F.col("event_type") == "error", NODE_Y).otherwise(EDGE)
    rows = rows.select(_since_epoch("SECOND", F.col("ts")).alias("t"), kind.alias("kind"), "event_id", "user_id", F.regexp_extract("props", "[0-9]+", 0).cast("long").alias("k"), "value")
    of = lambda kind, value, name: F.when(F.col("kind") == kind, value).alias(name)
    value = F.array("value")
    events = rows.select(
        "t", "kind", "event_id", of(EDGE, F.col("user_id"), "src"), of(EDGE, F.col("k") + DESTINATIONS, "dst"), of(EDGE, value, "edge_x"),
        F.when(F.col("kind") != EDGE, F.col("user_id")).alias("nid"), of(NODE_X, value, "x"), of(NODE_Y, F.array(F.col("value"), F.col("k").cast("double")), "y"),
    )
    return EventLog.of_events(events, "s", order=["event_id"], validate=validate)


ACTIVITY_SQL = f"""
raw AS (
  SELECT epoch_us(ts) // 1000000 AS t, CASE event_type WHEN 'signup' THEN 1 WHEN 'error' THEN 2 ELSE 0 END AS kind,
    event_id, user_id, regexp_extract(props, '[0-9]+')::BIGINT AS k, value FROM events
), log AS (
  SELECT row_number() OVER (ORDER BY t, kind, event_id) - 1 AS event_idx, t, kind,
    CASE WHEN kind = 0 THEN user_id END AS src, CASE WHEN kind = 0 THEN k + {DESTINATIONS} END AS dst,
    CASE WHEN kind <> 0 THEN user_id END AS nid, value::FLOAT AS v, k::FLOAT AS k FROM raw
)"""


def trade(spark: SparkSession, sf_dir: str) -> EventLog:
    """Customers order from suppliers: an edge a line of an order, time in days since 1995."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.col("o_custkey").alias("src"), (_since_epoch("DAY", F.col("o_orderdate")) - FIRST_DAY).alias("t"))
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", _since_epoch("DAY", F.col("l_shipdate")).alias("ship"),
        (F.col("l_suppkey") + SUPPLIERS).alias("dst"), F.array("l_extendedprice", "l_discount").alias("edge_x"), F.col("l_linenumber").alias("edge_type"))
    edges = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"])
    return EventLog.of(edges, delta="D", order={0: ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "ship"]}, validate=False)


TRADE_SQL = f"""
raw AS (
  SELECT epoch_us(o_orderdate) // 86400000000 - {FIRST_DAY} AS t, o_custkey AS src, l_suppkey + {SUPPLIERS} AS dst,
    l_extendedprice::FLOAT AS price, l_discount::FLOAT AS discount, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
    epoch_us(l_shipdate) // 86400000000 AS ship
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
), log AS (
  SELECT row_number() OVER (ORDER BY t, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, ship) - 1 AS event_idx,
    t, src, dst, price, discount, l_linenumber AS edge_type FROM raw
)"""


def activity_edges(spark: SparkSession, sf_dir: str, batch: int = 200) -> DataFrame:
    """``batch_id`` and the activity graph's edges, ``batch`` events of all kinds to a batch."""
    return activity(spark, sf_dir).events.withColumn("batch_id", F.expr(f"event_idx div {batch}")).where("kind = 0")
