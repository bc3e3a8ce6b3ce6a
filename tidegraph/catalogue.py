"""Queries over the test tables, one for each operator, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .frame import EventLog, endpoints
from .functions.scalar import hashed_sql, scattered_sql, time2vec_weights
from .graphs import ACTIVITY_SQL, TRADE_SQL, activity, trade
from .operators import analytics, kernels, metrics, negatives, neighbors, predictors, splits, tracking
from .operators.batching import batch_sizes, batched
from .operators.discretise import discretise
from .plans import library
from .plans.protocol import BatchFrame
from .sources.readers import token_transfers
from .streaming import memory
from .workspace import configured, keep, new_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
BATCH, DAY = 200, 86_400


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Decorator: a query and its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rounded(c: Column | str, name: str, places: int = 6) -> Column:
    return F.round((F.col(c) if isinstance(c, str) else c).cast("double"), places).alias(name)


def on_activity(body: str) -> str:
    return f"WITH {ACTIVITY_SQL}, edges AS (SELECT *, event_idx // {BATCH} AS batch_id FROM log WHERE kind = 0) {body}"


def on_trade(body: str) -> str:
    return f"WITH {TRADE_SQL} {body}"


def by_events(log: EventLog, size: int = BATCH) -> DataFrame:
    return batched(log, size).events


def edges_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_events(activity(spark, sf_dir)).where("kind = 0")


# -- log, slices, properties -------------------------------------------------------------------------


@query(on_activity("SELECT event_idx, t, kind::INT AS kind, src, dst, nid FROM log"))
def event_order(spark, sf_dir):
    return activity(spark, sf_dir, validate=True).events.select("event_idx", "t", "kind", "src", "dst", "nid")


@query(on_activity("SELECT event_idx, t, kind::INT AS kind FROM log WHERE t >= 1704500000 AND t < 1705000000"))
def slice_time(spark, sf_dir):
    return activity(spark, sf_dir).slice_time(1_704_000_000, 1_705_000_000).slice_time(1_704_500_000, None).events.select("event_idx", "t", "kind")


@query(on_activity("SELECT event_idx, t, kind::INT AS kind FROM log WHERE t >= 1704500000 AND t < 1705000000 AND event_idx < 3000"))
def stored_slices(spark, sf_dir):
    """A log written once with its order, and slices of what was stored: their bounds reach the files."""
    path = new_path(spark, "log")
    activity(spark, sf_dir).write(path)
    return EventLog.read(spark, path).slice_time(1_704_500_000, 1_705_000_000).slice_events(None, 3000).events.select("event_idx", "t", "kind")


@query(on_activity("SELECT event_idx, t, kind::INT AS kind FROM log WHERE event_idx >= 100 AND event_idx < 350"))
def slice_events(spark, sf_dir):
    return activity(spark, sf_dir).slice_events(100, 350).events.select("event_idx", "t", "kind")


@query(on_activity("""
SELECT min(t) AS start_time, max(t) AS end_time, max(greatest(src, dst, CASE WHEN kind = 1 THEN nid END)) + 1 AS num_nodes, count(DISTINCT t) AS num_timestamps,
  count(*) AS num_events, count(*) FILTER (WHERE kind = 0) AS num_edge_events, count(*) FILTER (WHERE kind = 1) AS num_node_events,
  count(*) FILTER (WHERE kind = 2) AS num_node_labels, 1::INT AS edge_x_dim, 1::INT AS x_dim, 2::INT AS y_dim FROM log
"""))
def graph_properties(spark, sf_dir):
    return activity(spark, sf_dir).properties()


@query(on_activity("SELECT src AS nid FROM log WHERE kind = 0 UNION SELECT dst FROM log WHERE kind = 0 UNION SELECT nid FROM log WHERE kind = 1"))
def distinct_nodes(spark, sf_dir):
    return activity(spark, sf_dir).get_nodes()


@query(on_trade("SELECT nid, count(*) AS n_events FROM (SELECT src AS nid FROM log UNION ALL SELECT dst FROM log) GROUP BY nid ORDER BY n_events DESC, nid LIMIT 20"))
def top_frequent_nodes(spark, sf_dir):
    return analytics.top_nodes(trade(spark, sf_dir).edges(), 20)


@query(on_activity("SELECT event_idx, t, src, dst, round(v::DOUBLE, 6) AS value FROM log WHERE kind = 0"))
def materialized_edges(spark, sf_dir):
    return activity(spark, sf_dir).materialize().where("kind = 0").select("event_idx", "t", "src", "dst", rounded(F.col("edge_x")[0], "value"))


# -- coarser time ------------------------------------------------------------------------------------

_WEEKLY = "firsts AS (SELECT * FROM (SELECT *, floor(t::DOUBLE * (1.0 / 7))::BIGINT AS b FROM log) QUALIFY row_number() OVER (PARTITION BY b, src, dst ORDER BY event_idx) = 1)"


@query(on_trade(f""", {_WEEKLY}, ends AS (SELECT b, src AS nid FROM firsts UNION SELECT b, dst FROM firsts), nodes AS (SELECT b, count(*) AS n FROM ends GROUP BY b)
SELECT f.b AS week, count(*) AS num_edge_events, any_value(n) AS num_unique_nodes, round(2.0 * count(*) / any_value(n), 6) AS avg_degree,
  round(sum(price::DOUBLE), 2) AS volume FROM firsts f JOIN nodes USING (b) GROUP BY f.b"""))
def discretize_week_first(spark, sf_dir):
    """The flagship: weekly snapshots of the trade graph and their figures."""
    weekly = discretise(trade(spark, sf_dir), "W")
    events = weekly.events.withColumn("batch_id", F.col("t"))
    volume = events.groupBy("batch_id").agg(F.sum(F.col("edge_x")[0].cast("double")).alias("volume"))
    figures = analytics.batch_analytics(events).join(volume, "batch_id")
    return figures.select(F.col("batch_id").alias("week"), "num_edge_events", "num_unique_nodes", rounded("avg_degree", "avg_degree"), rounded("volume", "volume", 2))


@query(on_activity("""
SELECT floor(t::DOUBLE * (1.0 / 2592000))::BIGINT AS t, kind::INT AS kind, src, dst, nid, round(arg_min(v, event_idx)::DOUBLE, 6) AS first_value
FROM log GROUP BY 1, 2, 3, 4, 5"""))
def discretize_month_floatbucket(spark, sf_dir):
    return discretise(activity(spark, sf_dir), "M").events.select("t", "kind", "src", "dst", "nid", rounded(first_element(), "first_value"))


def first_element() -> Column:
    return F.coalesce(F.col("edge_x")[0], F.col("x")[0], F.get("y", F.lit(0)))


def _reduced(op: str, expression: str) -> Query:
    def run(spark, sf_dir):
        value = first_element()
        return discretise(activity(spark, sf_dir), "D", op).events.select("t", "kind", "src", "dst", "nid", rounded(value, "value", 3))

    run.__name__ = f"discretize_day_{op}"
    return query(on_activity(f"SELECT floor(t::DOUBLE * (1.0 / {DAY}))::BIGINT AS t, kind::INT AS kind, src, dst, nid, round(({expression})::FLOAT::DOUBLE, 3) AS value FROM log GROUP BY 1, 2, 3, 4, 5"))(run)


for _op, _sql in (("first", "arg_min(v, event_idx)"), ("last", "arg_max(v, event_idx)"), ("sum", "sum(v::DOUBLE)"), ("mean", "avg(v::DOUBLE)"), ("max", "max(v)"), ("count", "count(*)")):
    _reduced(_op, _sql)


# -- splits ------------------------------------------------------------------------------------------


def _parts(spark, sf_dir, strategy) -> DataFrame:
    log = activity(spark, sf_dir)
    out = None
    for name, test in strategy.parts(log):
        part = log.where(test).events.groupBy("kind").agg(F.count("*").alias("n"), F.min("t").alias("first_t"), F.max("t").alias("last_t")).select(F.lit(name).alias("part"), "kind", "n", "first_t", "last_t")
        out = part if out is None else out.unionByName(part)
    return out


_SPLIT = "SELECT part, kind::INT AS kind, count(*) AS n, min(t) AS first_t, max(t) AS last_t FROM parts GROUP BY 1, 2"


@query(on_activity(f", parts AS (SELECT *, CASE WHEN t < 1705800000 THEN 'train' WHEN t < 1706200000 THEN 'val' ELSE 'test' END AS part FROM log) {_SPLIT}"))
def split_temporal(spark, sf_dir):
    return _parts(spark, sf_dir, splits.TemporalSplit(1_705_800_000, 1_706_200_000))


@query(on_activity(f""", span AS (SELECT min(t) AS lo, (max(t) - min(t) + 1)::DOUBLE AS w FROM log),
cuts AS (SELECT lo + floor(w * 0.7::DOUBLE)::BIGINT AS val, lo + floor(w * 0.7::DOUBLE)::BIGINT + floor(w * 0.15::DOUBLE)::BIGINT AS test FROM span),
parts AS (SELECT log.*, CASE WHEN t < val THEN 'train' WHEN t < test THEN 'val' ELSE 'test' END AS part FROM log, cuts) {_SPLIT}"""))
def split_ratio(spark, sf_dir):
    return _parts(spark, sf_dir, splits.TemporalRatioSplit())


@query(on_activity(f""", bounds(part, lo, hi) AS (VALUES ('train', 1704067200, 1705799999), ('val', 1705800000, 1706199999), ('test', 1706200000, 1706700000)),
parts AS (SELECT log.*, part FROM log, bounds WHERE kind = 1 OR (kind = 0 AND t BETWEEN lo AND hi) OR (kind = 2 AND t >= lo - 1 AND t < hi)) {_SPLIT}"""))
def split_bounds(spark, sf_dir):
    return _parts(spark, sf_dir, splits.BoundsSplit({"train": (1_704_067_200, 1_705_799_999), "val": (1_705_800_000, 1_706_199_999), "test": (1_706_200_000, 1_706_700_000)}))


# -- batches -----------------------------------------------------------------------------------------

_KINDS = "count(*) FILTER (WHERE kind = 0) AS n_edges, count(*) FILTER (WHERE kind = 1) AS n_node_x, count(*) FILTER (WHERE kind = 2) AS n_node_y"


@query(on_activity(f"SELECT event_idx // {BATCH} AS batch_id, {_KINDS} FROM log GROUP BY 1"))
def event_batches(spark, sf_dir):
    return batch_sizes(batched(activity(spark, sf_dir), BATCH))


@query(on_activity(f""", w AS (SELECT *, (t - (SELECT min(t) FROM log)) // 60 AS batch_id FROM log),
spine AS (SELECT unnest(range((SELECT max(batch_id) + 1 FROM w))) AS batch_id), n AS (SELECT batch_id, {_KINDS} FROM w GROUP BY 1)
SELECT spine.batch_id, coalesce(n_edges, 0) AS n_edges, coalesce(n_node_x, 0) AS n_node_x, coalesce(n_node_y, 0) AS n_node_y FROM spine LEFT JOIN n USING (batch_id)"""))
def time_batches_spine(spark, sf_dir):
    return batch_sizes(batched(activity(spark, sf_dir), 1, "m", on_empty=None))


@query(on_activity(f"SELECT event_idx // 300 AS batch_id, {_KINDS} FROM log WHERE event_idx // 300 < (SELECT count(*) // 300 FROM log) GROUP BY 1"))
def batches_drop_last(spark, sf_dir):
    return batch_sizes(batched(activity(spark, sf_dir), 300, drop_last=True))


# -- analytics ---------------------------------------------------------------------------------------

_DAYS = f"d AS (SELECT *, (t - (SELECT min(t) FROM log)) // {DAY} AS batch_id FROM log WHERE kind < 2)"
_FIGURES = f""", {_DAYS}, ends AS (SELECT batch_id, kind, unnest(CASE WHEN kind = 0 THEN [src, dst] ELSE [nid] END) AS nid FROM d),
n AS (SELECT batch_id, count(DISTINCT nid) AS num_unique_nodes, count(DISTINCT CASE WHEN kind = 0 THEN nid END) AS e FROM ends GROUP BY 1),
f AS (SELECT batch_id, count(*) FILTER (WHERE kind = 0) AS num_edge_events, count(*) FILTER (WHERE kind = 1) AS num_node_events, count(DISTINCT t) AS num_unique_timestamps,
  count(*) FILTER (WHERE kind = 0) - count(DISTINCT CASE WHEN kind = 0 THEN (src, dst, t) END) AS num_repeated_edge_events,
  count(*) FILTER (WHERE kind = 1) - count(DISTINCT CASE WHEN kind = 1 THEN (nid, t) END) AS num_repeated_node_events FROM d GROUP BY 1),
figures AS (SELECT batch_id, num_edge_events, num_node_events, num_unique_timestamps, num_unique_nodes, round(coalesce(2.0 * num_edge_events / nullif(e, 0), 0), 6) AS avg_degree,
  num_repeated_edge_events, num_repeated_node_events FROM f JOIN n USING (batch_id))"""


def daily(spark, sf_dir) -> DataFrame:
    return batched(activity(spark, sf_dir), 1, "D").events


@query(on_activity(f"{_FIGURES} SELECT * FROM figures"))
def batch_analytics(spark, sf_dir):
    return analytics.batch_analytics(daily(spark, sf_dir)).withColumn("avg_degree", F.round("avg_degree", 6))


@query(on_activity(f"{_FIGURES} SELECT round(avg(num_edge_events), 6) AS num_edge_events, round(avg(num_unique_nodes), 6) AS num_unique_nodes, round(avg(num_unique_timestamps), 6) AS num_unique_timestamps FROM figures"))
def batch_analytics_mean(spark, sf_dir):
    means = analytics.mean_of_batches(analytics.batch_analytics(daily(spark, sf_dir)))
    return means.select(*(rounded(c, c) for c in ("num_edge_events", "num_unique_nodes", "num_unique_timestamps")))


_NODES = f""", {_DAYS}, now AS (SELECT batch_id, max(t) AS now FROM d GROUP BY 1), ft AS (SELECT t, min(batch_id) AS batch_id FROM d GROUP BY 1),
spine AS (SELECT batch_id, now, sum(n) OVER (ORDER BY batch_id)::BIGINT AS times FROM now JOIN (SELECT batch_id, count(*) AS n FROM ft GROUP BY 1) USING (batch_id)),
ends AS (SELECT batch_id, t, kind, unnest(CASE WHEN kind = 0 THEN [src, dst] ELSE [nid] END) AS nid FROM d),
p AS (SELECT nid, batch_id, count(*) FILTER (WHERE kind = 0) AS degree FROM ends GROUP BY 1, 2),
pt AS (SELECT nid, batch_id, count(*) AS fresh FROM (SELECT nid, t, min(batch_id) AS batch_id FROM ends GROUP BY 1, 2) GROUP BY 1, 2),
q AS (SELECT nid, batch_id, count(*) AS new_neighbors FROM (SELECT nid, nbr, min(batch_id) AS batch_id FROM (SELECT batch_id, src AS nid, dst AS nbr FROM d WHERE kind = 0 UNION ALL SELECT batch_id, dst, src FROM d WHERE kind = 0) GROUP BY 1, 2) GROUP BY 1, 2),
grid AS (SELECT s.batch_id, s.now, s.times, n.nid, degree, new_neighbors, sum(fresh) OVER w AS appearances, min(CASE WHEN p.nid IS NOT NULL THEN s.now END) OVER w AS first_seen,
  max(CASE WHEN p.nid IS NOT NULL THEN s.now END) OVER w AS last_seen FROM spine s CROSS JOIN (SELECT DISTINCT nid FROM ends) n
  LEFT JOIN p ON p.nid = n.nid AND p.batch_id = s.batch_id LEFT JOIN pt ON pt.nid = n.nid AND pt.batch_id = s.batch_id LEFT JOIN q ON q.nid = n.nid AND q.batch_id = s.batch_id
  WINDOW w AS (PARTITION BY n.nid ORDER BY s.batch_id))
SELECT batch_id, nid, coalesce(degree, 0) AS degree, coalesce(new_neighbors, 0) AS new_neighbors, appearances::BIGINT AS appearances, round(appearances::DOUBLE / greatest(times, 1), 6) AS activity,
  (last_seen - first_seen)::DOUBLE AS lifetime, (now - last_seen)::DOUBLE AS time_since_last_seen FROM grid WHERE last_seen IS NOT NULL"""


@query(on_activity(_NODES))
def node_analytics(spark, sf_dir):
    """All nodes of the log tracked."""
    events = daily(spark, sf_dir)
    return analytics.node_analytics(events, endpoints(events).distinct()).withColumn("activity", F.round("activity", 6))


_CUT = "(SELECT max(batch_id) * 7 // 10 FROM d)"


@query(on_activity(_NODES + f" AND batch_id >= {_CUT}"))
def carried_node_analytics(spark, sf_dir):
    """Node figures of the last days, by an operator that was shown the days before in an iteration of their own."""
    train, test = _cut(daily(spark, sf_dir))
    operator = library.NodeAnalytics(endpoints(train).unionByName(endpoints(test)).distinct())
    operator.apply(BatchFrame(train))
    return operator.apply(BatchFrame(test))["node_stats"].withColumn("activity", F.round("activity", 6))


def _cut(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Batches before seven tenths of the last batch's number, and those from there on."""
    first = events.agg(F.max("batch_id")).first()[0] * 7 // 10
    return events.where(F.col("batch_id") < first), events.where(F.col("batch_id") >= first)


@query(on_activity(f""", {_DAYS}, f AS (SELECT nid, min(batch_id) AS b FROM (SELECT batch_id, unnest(CASE WHEN kind = 0 THEN [src, dst] ELSE [nid] END) AS nid FROM d) GROUP BY 1)
SELECT batch_id, count(*) FILTER (WHERE b = batch_id) AS new_node_count, round(count(*) FILTER (WHERE b = batch_id) / count(*)::DOUBLE, 6) AS node_novelty
FROM d JOIN f USING (nid) WHERE kind = 1 GROUP BY 1"""))
def node_novelty(spark, sf_dir):
    return analytics.node_novelty(daily(spark, sf_dir)).withColumn("node_novelty", F.round("node_novelty", 6))


@query(on_activity(f""", {_DAYS}, e AS (SELECT * FROM d WHERE kind = 0), f AS (SELECT batch_id, count(*) AS new FROM (SELECT src, dst, min(batch_id) AS batch_id FROM e GROUP BY 1, 2) GROUP BY 1),
n AS (SELECT batch_id, count(DISTINCT nid)::DOUBLE AS n FROM (SELECT batch_id, unnest([src, dst]) AS nid FROM e) GROUP BY 1), c AS (SELECT batch_id, count(*) AS m FROM e GROUP BY 1)
SELECT batch_id, coalesce(new, 0) AS new_edge_count, round(coalesce(new, 0) / m::DOUBLE, 6) AS edge_novelty, round(CASE WHEN n < 2 THEN 0 ELSE m / (n * (n - 1)) END, 6) AS edge_density
FROM c JOIN n USING (batch_id) LEFT JOIN f USING (batch_id)"""))
def edge_stats(spark, sf_dir):
    out = analytics.edge_stats(daily(spark, sf_dir))
    return out.select("batch_id", "new_edge_count", rounded("edge_novelty", "edge_novelty"), rounded("edge_density", "edge_density"))


@query(on_activity(""", e AS (SELECT event_idx, t, 'src' AS role, src AS nid FROM log WHERE kind = 0 UNION ALL SELECT event_idx, t, 'dst', dst FROM log WHERE kind = 0),
g AS (SELECT role, t - coalesce(lag(t) OVER (PARTITION BY nid ORDER BY event_idx), 1704067200) AS gap FROM e)
SELECT role, round(avg(gap), 4) AS mean_gap, round(stddev_pop(gap), 4) AS std_gap FROM g GROUP BY 1"""))
def delta_t_stats(spark, sf_dir):
    out = analytics.gap_stats(activity(spark, sf_dir).edges(), 1_704_067_200)
    return out.select("role", rounded("mean_gap", "mean_gap", 4), rounded("std_gap", "std_gap", 4))


_SNAPS = f"{_DAYS}, s AS (SELECT batch_id, count(*) AS n_edges FROM d WHERE kind = 0 GROUP BY 1)"


@query(on_activity(f", {_SNAPS} SELECT batch_id, label FROM (SELECT batch_id, (lead(n_edges) OVER (ORDER BY batch_id) > n_edges)::INT AS label FROM s) WHERE label IS NOT NULL"))
def trend_labels(spark, sf_dir):
    return analytics.trend_labels(analytics.snapshot_metrics(daily(spark, sf_dir)))


@query(on_activity(f", {_SNAPS}, c AS (SELECT *, coalesce(sum(n_edges) OVER (ORDER BY batch_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS b FROM s) SELECT batch_id, round(b / (b + n_edges), 6) AS tau FROM c"))
def edge_ratio(spark, sf_dir):
    return kernels.edge_ratio(analytics.snapshot_metrics(daily(spark, sf_dir))).withColumn("tau", F.round("tau", 6))


def _spectral_sql(moments: int = 20, probes: int = 10, bins: int = 21) -> str:
    """The moments by products of the matrix with each vector, all as rows (batch, node, probe)."""
    sign = f"1 - 2 * (({scattered_sql('nid', 'p', '0')} >> 16) % 2)"
    steps = [f"t0 AS MATERIALIZED (SELECT batch_id, nid, p, ({sign})::DOUBLE AS x FROM deg, (SELECT unnest(range({probes})) AS p))"]
    product = lambda k: f"SELECT m.batch_id, m.nid, p, sum(w * x) AS x FROM m JOIN t{k} t ON t.batch_id = m.batch_id AND t.nid = m.nbr GROUP BY 1, 2, 3"
    steps.append(f"t1 AS MATERIALIZED ({product(0)})")
    for k in range(2, moments):
        steps.append(f"t{k} AS MATERIALIZED (SELECT y.batch_id, y.nid, y.p, 2 * y.x - z.x AS x FROM ({product(k - 1)}) y JOIN t{k - 2} z USING (batch_id, nid, p))")
    mus = " UNION ALL ".join(f"SELECT batch_id, {k} AS k, avg(z.x * t.x) AS mu FROM t0 z JOIN t{k} t USING (batch_id, nid, p) GROUP BY 1" for k in range(moments))
    big = moments + 1
    damped = f"(({big} - k) * cos(pi() * k / {big}) + sin(pi() * k / {big}) / tan(pi() / {big})) / {big}"
    upto = lambda b: f"(CASE WHEN k = 0 THEN pi() - acos(-1 + 1e-6 + (2 - 2e-6) * ({b}) / {bins}) ELSE -2 * sin(k * acos(-1 + 1e-6 + (2 - 2e-6) * ({b}) / {bins})) / greatest(k, 1) END) / pi()"
    return f""", {_DAYS}, h AS (SELECT batch_id, src AS nid, dst AS nbr FROM d WHERE kind = 0 UNION ALL SELECT batch_id, dst, src FROM d WHERE kind = 0),
deg AS MATERIALIZED (SELECT batch_id, nid, count(*)::DOUBLE AS d FROM h GROUP BY 1, 2),
m AS MATERIALIZED (SELECT c.batch_id, c.nid, c.nbr, -n / sqrt(a.d * b.d) AS w FROM (SELECT batch_id, nid, nbr, count(*) AS n FROM h GROUP BY 1, 2, 3) c
  JOIN deg a ON a.batch_id = c.batch_id AND a.nid = c.nid JOIN deg b ON b.batch_id = c.batch_id AND b.nid = c.nbr), {", ".join(steps)}, mus AS ({mus})
SELECT batch_id, bin, round(sum(mu * {damped} * ({upto("bin + 1")} - {upto("bin")})), 5) + 0 AS density FROM mus, (SELECT unnest(range({bins}))::INT AS bin) GROUP BY 1, 2"""


@query(on_activity(_spectral_sql()))
def spectral_density(spark, sf_dir):
    return analytics.spectral_density(daily(spark, sf_dir)).withColumn("density", F.round("density", 5) + 0)


# -- neighbourhoods ----------------------------------------------------------------------------------

K, CAP = 5, 5
_ENTRIES = """inc AS (SELECT batch_id, t, 0 AS role, event_idx, src AS node, dst AS nbr FROM edges UNION ALL SELECT batch_id, t, 1, event_idx, dst, src FROM edges),
o AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY batch_id, t, role, event_idx) AS ord FROM inc),
seeds AS (SELECT event_idx * 2 AS seed_id, batch_id, src AS node, t AS q FROM edges UNION ALL SELECT event_idx * 2 + 1, batch_id, dst, t FROM edges),
c AS (SELECT node, batch_id, count(*) AS n FROM inc GROUP BY 1, 2), held AS (SELECT a.node, a.batch_id, coalesce(sum(b.n), 0) AS c FROM c a LEFT JOIN c b ON a.node = b.node AND b.batch_id < a.batch_id GROUP BY 1, 2)"""
_HOP1 = f"""m AS (SELECT s.seed_id, s.batch_id, s.node, s.q, o.nbr, o.t AS nbr_t, o.ord FROM seeds s JOIN held h ON s.node = h.node AND s.batch_id = h.batch_id
  JOIN o ON o.node = s.node AND o.batch_id < s.batch_id AND o.ord > h.c - {CAP} AND o.t < s.q),
top AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY seed_id ORDER BY ord DESC) <= {K}),
hop1 AS (SELECT seed_id, batch_id, node, q, (row_number() OVER (PARTITION BY seed_id ORDER BY ord) - 1)::INT AS slot, nbr, nbr_t FROM top)"""


@query(on_activity(f", {_ENTRIES}, {_HOP1} SELECT * FROM hop1"))
def recency_1hop(spark, sf_dir):
    edges = edges_of(spark, sf_dir)
    return neighbors.recent(neighbors.link_seeds(edges), edges, K, CAP).drop("nbr_x")


@query(on_activity(f", {_ENTRIES}, {_HOP1} SELECT seed_id, batch_id, node, slot, nbr, nbr_t FROM hop1 WHERE batch_id >= (SELECT max(batch_id) * 7 // 10 FROM edges)"))
def carried_recency(spark, sf_dir):
    """Neighbours of the last batches' seeds, by an operator that was shown the batches before in an iteration of their own."""
    operator = library.RecentNeighbors([CAP])
    train, test = _cut(edges_of(spark, sf_dir))
    operator.apply(BatchFrame(train))
    return operator.apply(BatchFrame(test))["nbr_nids"].select("seed_id", "batch_id", "node", "slot", "nbr", "nbr_t")


@query(on_activity(f""", {_ENTRIES}, {_HOP1}, seeds2 AS (SELECT seed_id * {CAP} + slot AS seed_id, batch_id, nbr AS node, nbr_t AS q FROM hop1),
cb AS (SELECT DISTINCT node, batch_id FROM seeds2), held2 AS (SELECT a.node, a.batch_id, coalesce(sum(b.n), 0) AS c FROM cb a LEFT JOIN c b ON a.node = b.node AND b.batch_id < a.batch_id GROUP BY 1, 2),
m2 AS (SELECT s.seed_id, s.batch_id, s.node, s.q, o.nbr, o.t AS nbr_t, o.ord FROM seeds2 s JOIN held2 h ON s.node = h.node AND s.batch_id = h.batch_id
  JOIN o ON o.node = s.node AND o.batch_id < s.batch_id AND o.ord > h.c - {CAP} AND o.t < s.q),
top2 AS (SELECT * FROM m2 QUALIFY row_number() OVER (PARTITION BY seed_id ORDER BY ord DESC) <= 2)
SELECT *, 0::INT AS hop FROM hop1 UNION ALL SELECT seed_id, batch_id, node, q, (row_number() OVER (PARTITION BY seed_id ORDER BY ord) - 1)::INT, nbr, nbr_t, 1::INT FROM top2"""))
def recency_2hop(spark, sf_dir):
    edges = edges_of(spark, sf_dir)
    return neighbors.hops(neighbors.link_seeds(edges), edges, [K, 2]).drop("nbr_x")


@query(on_activity(f""", {_ENTRIES}, {_HOP1}, l AS (SELECT seed_id, count(*) AS n FROM hop1 GROUP BY 1), places AS (SELECT seed_id, unnest(range({K})) AS place FROM seeds)
SELECT p.seed_id, p.place::INT AS place, coalesce(h.nbr, -1) AS nbr, coalesce(h.nbr_t, 0) AS nbr_t FROM places p LEFT JOIN l USING (seed_id)
LEFT JOIN hop1 h ON h.seed_id = p.seed_id AND h.slot = p.place - ({K} - coalesce(l.n, 0))"""))
def recency_padded(spark, sf_dir):
    edges = edges_of(spark, sf_dir)
    seeds = neighbors.link_seeds(edges)
    padded = neighbors.pad(seeds, neighbors.recent(seeds, edges, K, CAP), K)
    return padded.select("seed_id", F.posexplode(F.arrays_zip("nbrs", "nbr_ts")).alias("place", "e")).select("seed_id", "place", F.col("e.nbrs").alias("nbr"), F.col("e.nbr_ts").alias("nbr_t"))


def _uniform_sql(k: int) -> str:
    """Of c entries before the batch: k numbers, one a step, of 1 to the step's top, or the top if that has been drawn."""
    steps = ["d0 AS (SELECT s.seed_id, s.batch_id, s.node, s.q, c, []::BIGINT[] AS drawn FROM asked s WHERE c > %d)" % k]
    for i in range(k):
        top = f"(c - {k} + {i + 1})"
        steps.append(f"d{i + 1} AS (SELECT * EXCLUDE (drawn, pick, top), list_append(drawn, CASE WHEN list_contains(drawn, pick) THEN top ELSE pick END) AS drawn FROM (SELECT *, {top} AS top, 1 + {hashed_sql('seed_id', top, '0')} % {top} AS pick FROM d{i}))")
    return f""", {_ENTRIES}, starts AS (SELECT batch_id, min(t) AS bt FROM edges GROUP BY 1),
num AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY t, event_idx, role) AS place FROM inc),
asked AS MATERIALIZED (SELECT s.*, c FROM seeds s JOIN (SELECT n.node, n.batch_id, count(i.t) AS c FROM (SELECT DISTINCT node, batch_id, bt FROM seeds JOIN starts USING (batch_id)) n JOIN inc i ON i.node = n.node AND i.t < n.bt GROUP BY 1, 2) h USING (node, batch_id)),
{", ".join(steps)}, wanted AS (SELECT seed_id, batch_id, node, q, unnest(drawn) AS place FROM d{k} UNION ALL SELECT seed_id, batch_id, node, q, unnest(range(1, c + 1)) FROM asked WHERE c <= {k})
SELECT w.seed_id, w.batch_id, w.node, w.q, (row_number() OVER (PARTITION BY w.seed_id ORDER BY w.place) - 1)::INT AS slot, n.nbr, n.t AS nbr_t FROM wanted w JOIN num n USING (node, place)"""


@query(on_activity(_uniform_sql(K)))
def uniform_neighbors(spark, sf_dir):
    edges = edges_of(spark, sf_dir)
    return neighbors.uniform(neighbors.link_seeds(edges), edges, K).drop("nbr_x")


@query(on_activity(f""", {_ENTRIES}, sp AS (SELECT batch_id, min(t) AS bt, max(event_idx) AS last FROM edges GROUP BY 1)
SELECT seed_id, nbr, count(*) AS n FROM seeds s JOIN sp USING (batch_id) JOIN inc i ON i.node = s.node AND i.t < bt AND i.event_idx > last - 800 GROUP BY 1, 2"""))
def time_gap_neighbors(spark, sf_dir):
    edges = edges_of(spark, sf_dir)
    return neighbors.gap_neighbors(neighbors.link_seeds(edges), edges, 800)


@query(on_activity(f""", {_ENTRIES}, {_HOP1}, pr AS (SELECT seed_id // 2 AS pair_id, (seed_id % 2)::INT AS side, slot, nbr FROM hop1)
SELECT a.pair_id, a.side, a.slot, a.nbr, (SELECT count(*) FROM pr b WHERE b.pair_id = a.pair_id AND b.side = a.side AND b.nbr = a.nbr)::INT AS own,
  (SELECT count(*) FROM pr b WHERE b.pair_id = a.pair_id AND b.side <> a.side AND b.nbr = a.nbr)::INT AS other FROM pr a"""))
def cooccurrence(spark, sf_dir):
    edges = edges_of(spark, sf_dir)
    found = neighbors.recent(neighbors.link_seeds(edges), edges, K, CAP)
    sides = found.groupBy(F.expr("seed_id div 2").alias("pair_id"), (F.col("seed_id") % 2).alias("side")).agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "nbr"))), lambda e: e["nbr"]).alias("nbrs"))
    empty = F.array().cast("array<bigint>")
    pairs = sides.groupBy("pair_id").agg(F.coalesce(F.max(F.when(F.col("side") == 0, F.col("nbrs"))), empty).alias("left"), F.coalesce(F.max(F.when(F.col("side") == 1, F.col("nbrs"))), empty).alias("right"))
    return neighbors.cooccurrence(pairs)


@query(on_activity(", u AS (SELECT DISTINCT batch_id, unnest([src, dst]) AS nid FROM edges) SELECT batch_id, nid, row_number() OVER (PARTITION BY batch_id ORDER BY nid) - 1 AS local_id FROM u"))
def dedup_local_ids(spark, sf_dir):
    edges = edges_of(spark, sf_dir)
    return tracking.local_ids(edges.select("batch_id", F.explode(F.array("src", "dst")).alias("nid")))


@query(on_activity(f""", b AS (SELECT *, event_idx // {BATCH} AS batch_id FROM log), f AS (SELECT nid, min(batch_id) AS fb FROM (SELECT batch_id, unnest([src, dst]) AS nid FROM b WHERE kind = 0) GROUP BY 1),
y AS (SELECT batch_id, nid, row_number() OVER (PARTITION BY batch_id ORDER BY event_idx) - 1 AS position FROM b WHERE kind = 2)
SELECT batch_id, position, nid FROM y JOIN f USING (nid) WHERE fb <= batch_id"""))
def seen_nodes(spark, sf_dir):
    return tracking.seen_nodes(by_events(activity(spark, sf_dir)))


# -- negatives ---------------------------------------------------------------------------------------

_ORDINAL = "r AS (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY event_idx) - 1 AS ordinal, count(*) OVER (PARTITION BY batch_id) AS n FROM edges)"


@query(on_activity(f", {_ORDINAL} SELECT batch_id, ordinal, 1000 + {hashed_sql('batch_id', 'ordinal', '0')} % 100 AS neg, t AS neg_t FROM r WHERE ordinal < round_even(n * 0.5, 0)"))
def random_negatives(spark, sf_dir):
    return negatives.random_negatives(edges_of(spark, sf_dir), 1000, 1100, 0.5)


_PAST = f"""p AS (SELECT src, batch_id, event_idx, dst, row_number() OVER (PARTITION BY src ORDER BY batch_id, event_idx) AS ord FROM edges),
bc AS (SELECT src, batch_id, min(ord) - 1 AS c FROM p GROUP BY 1, 2), dr AS (SELECT src, batch_id, 1 + {hashed_sql('src', 'batch_id', '0')} % c AS ord FROM bc WHERE c > 0),
got AS (SELECT dr.src, dr.batch_id, p.dst AS neg FROM dr JOIN p ON p.src = dr.src AND p.ord = dr.ord)"""


@query(on_activity(f", {_PAST} SELECT e.batch_id, e.event_idx, e.src, coalesce(neg, -1) AS neg, neg IS NOT NULL AS valid FROM edges e LEFT JOIN got ON got.src = e.src AND got.batch_id = e.batch_id"))
def historical_negatives(spark, sf_dir):
    return negatives.historical_negatives(edges_of(spark, sf_dir))


def _prepared(edges: DataFrame) -> DataFrame:
    """A benchmark's prepared negatives: three items after the edge's own."""
    near = F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: 1000 + F.pmod(F.col("dst") - 1000 + 7 * i, F.lit(100)))
    return edges.select("src", "dst", "t").distinct().withColumn("negs", near)


@query(on_activity(f""", n AS (SELECT DISTINCT batch_id, 1000 + (dst - 1000 + 7 * unnest([1, 2, 3])) % 100 AS neg FROM edges), sp AS (SELECT batch_id, min(t) AS lo, max(t) AS hi FROM edges GROUP BY 1)
SELECT batch_id, neg, lo + {hashed_sql('batch_id', 'neg', '0')} % (hi - lo + 1) AS neg_t FROM n JOIN sp USING (batch_id)"""))
def listed_negatives(spark, sf_dir):
    edges = edges_of(spark, sf_dir)
    return negatives.batch_negatives(negatives.listed_negatives(edges, _prepared(edges)))


@query(on_trade("""SELECT event_idx, edge_type::INT AS edge_type, dst + 1 AS neg FROM log WHERE edge_type % 2 = 1"""))
def typed_negatives(spark, sf_dir):
    """Listed negatives of edges that differ by their type only: odd types have the supplier after theirs, others none."""
    edges = trade(spark, sf_dir).edges("t", "src", "dst", "edge_type")
    listed = edges.where("edge_type % 2 = 1").select("src", "dst", "t", "edge_type").distinct().withColumn("negs", F.array(F.col("dst") + 1))
    found = negatives.listed_negatives(edges, listed, typed=True)
    return found.select("event_idx", "edge_type", F.explode("negs").alias("neg"))


@query(on_activity(f"SELECT event_idx, i::INT AS place, 1000 + {hashed_sql('event_idx', 'i', '0')} % 100 AS neg FROM (SELECT event_idx, unnest(range(10)) AS i FROM edges)"))
def sequence_negatives(spark, sf_dir):
    return negatives.sequence_negatives(edges_of(spark, sf_dir), 1000, 1100, 10).select("event_idx", F.posexplode("negs").alias("place", "neg"))


@query(on_activity("""SELECT batch_id, event_idx, src, slot::INT AS slot, CASE WHEN slot = 0 THEN dst ELSE 1000 + (dst - 1000 + 7 * slot) % 100 END AS dst, slot = 0 AS is_pos
FROM (SELECT *, unnest(range(4)) AS slot FROM edges)"""))
def candidate_expansion(spark, sf_dir):
    edges = edges_of(spark, sf_dir)
    return negatives.candidates(negatives.listed_negatives(edges, _prepared(edges)))


# -- predictors --------------------------------------------------------------------------------------

FIRST = 10  # batches that a predictor starts with


def _task(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Initial edges, later edges, and candidates of the later ones."""
    edges = edges_of(spark, sf_dir)
    init, later = edges.where(F.col("batch_id") < FIRST), edges.where(F.col("batch_id") >= FIRST)
    return init, later, negatives.candidates(negatives.listed_negatives(later, _prepared(later)))


_TASK = f"""h AS (SELECT CASE WHEN batch_id < {FIRST} THEN -1 ELSE batch_id END AS batch_id, event_idx, src, dst, t FROM edges),
q AS (SELECT batch_id, event_idx, src, slot::INT AS slot, CASE WHEN slot = 0 THEN dst ELSE 1000 + (dst - 1000 + 7 * slot) % 100 END AS dst, slot = 0 AS is_pos
  FROM (SELECT *, unnest(range(4)) AS slot FROM edges WHERE batch_id >= {FIRST})),
span AS (SELECT (max(t) - min(t))::DOUBLE AS w FROM h WHERE batch_id = -1), bs AS (SELECT DISTINCT batch_id FROM q),
clock AS (SELECT bs.batch_id, max(h.t) AS we FROM bs JOIN h ON h.batch_id < bs.batch_id GROUP BY 1),
last AS (SELECT q.batch_id, q.event_idx, q.slot, q.src, q.dst, q.is_pos, max(h.t) AS last_t FROM q LEFT JOIN h ON h.src = q.src AND h.dst = q.dst AND h.batch_id < q.batch_id GROUP BY ALL)"""
_BANK = "bank AS (SELECT batch_id, event_idx, src, slot, dst, is_pos, CASE WHEN last_t IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS score FROM last)"


@query(on_activity(f", {_TASK}, {_BANK} SELECT event_idx, slot, dst, score FROM bank"))
def edgebank_unlimited(spark, sf_dir):
    return predictors.edgebank(*_task(spark, sf_dir)).select("event_idx", "slot", "dst", "score")


@query(on_activity(f", {_TASK} SELECT event_idx, slot, dst, CASE WHEN last_t >= we - w * 0.15::DOUBLE THEN 1.0 ELSE 0.0 END::DOUBLE AS score FROM last JOIN clock USING (batch_id), span"))
def edgebank_fixed(spark, sf_dir):
    return predictors.edgebank(*_task(spark, sf_dir), memory="fixed").select("event_idx", "slot", "dst", "score")


@query(on_activity(f""", {_TASK}, steps AS (SELECT batch_id, row_number() OVER (ORDER BY batch_id) AS step FROM (SELECT batch_id FROM h UNION SELECT batch_id FROM q)),
n AS (SELECT dst, step, count(*) AS n FROM h JOIN steps USING (batch_id) GROUP BY 1, 2), a AS (SELECT DISTINCT dst, batch_id, step FROM q JOIN steps USING (batch_id)),
s AS (SELECT a.dst, a.batch_id, sum(n.n * pow(0.9::DOUBLE, a.step - n.step)) AS score FROM a LEFT JOIN n ON n.dst = a.dst AND n.step < a.step GROUP BY 1, 2)
SELECT event_idx, slot, q.dst, round(coalesce(score, 0), 6) AS score FROM q JOIN s ON s.dst = q.dst AND s.batch_id = q.batch_id"""))
def poptrack(spark, sf_dir):
    return predictors.poptrack(*_task(spark, sf_dir)).select("event_idx", "slot", "dst", rounded("score", "score"))


_COMEM = """n AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY batch_id, event_idx) AS ord FROM h), sb AS (SELECT DISTINCT batch_id, src FROM q),
c AS (SELECT sb.batch_id, sb.src, max(n.ord) AS c FROM sb JOIN n ON n.src = sb.src AND n.batch_id < sb.batch_id GROUP BY 1, 2),
rec AS (SELECT c.batch_id, c.src, sum(exp(-(we - n.t) / greatest(w, 1))) AS recency FROM c JOIN n ON n.src = c.src AND n.batch_id < c.batch_id AND n.ord > c.c - 10
  JOIN clock ON clock.batch_id = c.batch_id, span WHERE n.t <= we AND n.t >= we - greatest(w, 1) GROUP BY 1, 2),
dq AS (SELECT DISTINCT batch_id, src, dst FROM q), pop AS (SELECT dq.batch_id, dq.dst, count(h.t) AS pop FROM (SELECT DISTINCT batch_id, dst FROM dq) dq LEFT JOIN h ON h.dst = dq.dst AND h.batch_id < dq.batch_id GROUP BY 1, 2),
co AS (SELECT dq.batch_id, dq.src, dq.dst, count(x.src) AS co FROM dq LEFT JOIN (SELECT batch_id, src, dst FROM h UNION ALL SELECT batch_id, dst, src FROM h) x ON x.src = dq.src AND x.dst = dq.dst AND x.batch_id < dq.batch_id GROUP BY 1, 2, 3),
cm AS (SELECT dq.*, coalesce(recency, 0) / (1 + exp(-pop::DOUBLE)) + 0.8 * co / (1 + co)::DOUBLE AS score FROM dq JOIN pop USING (batch_id, dst) JOIN co USING (batch_id, src, dst) LEFT JOIN rec USING (batch_id, src))"""


@query(on_activity(f", {_TASK}, {_COMEM} SELECT event_idx, slot, q.dst, round(score, 6) AS score FROM q JOIN cm USING (batch_id, src, dst)"))
def tcomem(spark, sf_dir):
    return predictors.tcomem(*_task(spark, sf_dir), k=10).select("event_idx", "slot", "dst", rounded("score", "score"))


@query(on_activity(f", {_TASK}, {_COMEM}, {_BANK} SELECT event_idx, slot, dst, round((bank.score + cm.score) / 2, 6) AS score FROM bank JOIN cm USING (batch_id, src, dst)"))
def base3(spark, sf_dir):
    return predictors.base3(*_task(spark, sf_dir), k=10).select("event_idx", "slot", "dst", rounded("score", "score"))


_LABELS = "y AS (SELECT event_idx, nid, v::DOUBLE AS y0, k::DOUBLE AS y1, coalesce(lag(v) OVER w, 0)::DOUBLE AS p0, coalesce(lag(k) OVER w, 0)::DOUBLE AS p1 FROM log WHERE kind = 2 WINDOW w AS (PARTITION BY nid ORDER BY event_idx))"


@query(on_activity(f", {_LABELS} SELECT event_idx, nid, round(p0, 6) AS pred_0, round(p1, 6) AS pred_1 FROM y"))
def node_forecast(spark, sf_dir):
    out = predictors.node_forecast(activity(spark, sf_dir).node_labels())
    return out.select("event_idx", "nid", rounded(F.col("pred")[0], "pred_0"), rounded(F.col("pred")[1], "pred_1"))


@query(on_activity(f", {_SNAPS} SELECT batch_id, coalesce((n_edges > lag(n_edges) OVER (ORDER BY batch_id))::INT, 0) AS pred FROM s"))
def graph_forecast(spark, sf_dir):
    return predictors.graph_forecast(analytics.snapshot_metrics(daily(spark, sf_dir)), first=0)


# -- evaluation --------------------------------------------------------------------------------------


@query(on_activity(f""", {_TASK}, {_BANK}, r AS (SELECT event_idx, max(CASE WHEN is_pos THEN score END) AS p FROM bank GROUP BY 1),
k AS (SELECT event_idx, 1 / (1 + count(*) FILTER (WHERE NOT is_pos AND score > p) + 0.5 * count(*) FILTER (WHERE NOT is_pos AND score = p))::DOUBLE AS rr FROM bank JOIN r USING (event_idx) GROUP BY 1)
SELECT round(avg(rr), 6) AS mrr FROM k"""))
def mrr_edgebank(spark, sf_dir):
    return metrics.mrr(predictors.edgebank(*_task(spark, sf_dir)), ["event_idx"]).select(rounded("mrr", "mrr"))


@query(on_activity(f""", {_LABELS}, g AS (SELECT event_idx, CASE WHEN p1 > p0 THEN y1 + y0 / log2(3) ELSE y0 + y1 / log2(3) END AS dcg,
  greatest(y0, y1) + least(y0, y1) / log2(3) AS best FROM y) SELECT event_idx, round(CASE WHEN best > 0 THEN dcg / best ELSE 0 END, 6) AS ndcg FROM g"""))
def ndcg_forecast(spark, sf_dir):
    return metrics.ndcg(predictors.node_forecast(activity(spark, sf_dir).node_labels())).withColumn("ndcg", F.round("ndcg", 6))


@query(on_activity(f""", {_SNAPS}, x AS (SELECT (lead(n_edges) OVER w > n_edges)::INT AS label, n_edges::DOUBLE AS score FROM s WINDOW w AS (ORDER BY batch_id)), r AS (SELECT * FROM x WHERE label IS NOT NULL),
pairs AS (SELECT avg(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0.0 END) AS auroc FROM r a, r b WHERE a.label = 1 AND b.label = 0),
pr AS (SELECT score, label, (SELECT count(*) FROM r b WHERE b.score >= r.score AND b.label = 1)::DOUBLE / (SELECT count(*) FROM r b WHERE b.score >= r.score) AS p FROM r)
SELECT round((SELECT auroc FROM pairs), 6) AS auroc, round((SELECT avg(p) FROM pr WHERE label = 1), 6) AS ap"""))
def trend_auroc_ap(spark, sf_dir):
    sizes = analytics.snapshot_metrics(daily(spark, sf_dir))
    rows = analytics.trend_labels(sizes).join(sizes, "batch_id").select("label", F.col("n_edges").cast("double").alias("score"))
    return metrics.binary_areas(rows).select(rounded("auroc", "auroc"), rounded("ap", "ap"))


# -- kernels -----------------------------------------------------------------------------------------

_MSG = "m AS (SELECT batch_id, event_idx, t, 0 AS role, src AS node, dst AS other, v FROM edges UNION ALL SELECT batch_id, event_idx, t, 1, dst, src, v FROM edges)"


@query(on_activity(f", {_MSG}, l AS (SELECT node, max(batch_id) AS b FROM m GROUP BY 1) SELECT m.node, t, other, round(v::DOUBLE, 6) AS x FROM m JOIN l ON m.node = l.node AND batch_id = b QUALIFY row_number() OVER (PARTITION BY m.node ORDER BY t DESC, event_idx DESC, role DESC) = 1"))
def message_last(spark, sf_dir):
    stored = kernels.stored_messages(kernels.messages(edges_of(spark, sf_dir)))
    return kernels.last_message(stored).select("node", "t", "other", rounded(F.col("x")[0], "x"))


@query(on_activity(f", {_MSG}, l AS (SELECT node, max(batch_id) AS b FROM m GROUP BY 1) SELECT m.node, 0::INT AS pos, round(avg(v::DOUBLE), 6) AS mean_x, count(*) AS n FROM m JOIN l ON m.node = l.node AND batch_id = b GROUP BY 1"))
def message_mean(spark, sf_dir):
    stored = kernels.stored_messages(kernels.messages(edges_of(spark, sf_dir)))
    return kernels.mean_message(stored).withColumn("mean_x", F.round("mean_x", 6))


@query(on_activity(f", {_MSG} SELECT node, max(t) AS last_update FROM m GROUP BY 1"))
def last_update(spark, sf_dir):
    return kernels.last_update(kernels.messages(edges_of(spark, sf_dir)))


_W = time2vec_weights(4)


@query(on_activity(f""", {_MSG}, u AS (SELECT node, batch_id, max(t) AS top FROM m GROUP BY 1, 2),
s AS (SELECT node, batch_id, coalesce(max(top) OVER (PARTITION BY node ORDER BY batch_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS since FROM u)
SELECT m.event_idx, m.role::INT AS role, t - since AS dt, {", ".join(f"round(cos({w!r}::DOUBLE * (t - since)), 5) AS c{i}" for i, w in enumerate(_W))} FROM m JOIN s ON s.node = m.node AND s.batch_id = m.batch_id"""))
def time_encoding(spark, sf_dir):
    """With the messages of a node's first batch, whose time counts from 0."""
    rows = kernels.relative_times(kernels.messages(edges_of(spark, sf_dir)))
    return kernels.encode_times(rows, 4).select("event_idx", "role", "dt", *(rounded(F.col("time_x")[i], f"c{i}", 5) for i in range(4)))


@query(on_trade("SELECT src AS node, 0::INT AS pos, round(avg(price::DOUBLE), 4) AS value FROM log GROUP BY 1 UNION ALL SELECT src, 1::INT, round(avg(discount::DOUBLE), 4) FROM log GROUP BY 1"))
def pooling(spark, sf_dir):
    rows = trade(spark, sf_dir).edges().withColumnRenamed("src", "node")
    return kernels.pool(rows, ["node"], "edge_x").withColumn("value", F.round("value", 4))


@query(on_activity(""", e AS (SELECT batch_id, src AS u, dst AS v FROM edges UNION ALL SELECT batch_id, dst, src FROM edges),
w AS (SELECT batch_id, u, v, sum(a) AS a FROM (SELECT batch_id, u, v, 1.0::DOUBLE AS a FROM e UNION ALL SELECT DISTINCT batch_id, u, u, 1.0 FROM e) GROUP BY 1, 2, 3),
g AS (SELECT batch_id, u, sum(a) AS d FROM w GROUP BY 1, 2)
SELECT w.batch_id, w.u AS node, round(sum(w.a / sqrt(gu.d * gv.d) * (w.v % 10)), 6) AS value FROM w JOIN g gu ON gu.batch_id = w.batch_id AND gu.u = w.u JOIN g gv ON gv.batch_id = w.batch_id AND gv.u = w.v GROUP BY 1, 2"""))
def gcn_propagation(spark, sf_dir):
    edges = edges_of(spark, sf_dir)
    values = kernels.endpoints_of(edges, ["batch_id"]).select("batch_id", F.col("nid").alias("node"), (F.col("nid") % 10).cast("double").alias("value"))
    return kernels.propagate(kernels.gcn_norm(edges, ["batch_id"]), values, ["batch_id"]).withColumn("value", F.round("value", 6))


@query(on_activity(f", {_ENTRIES}, {_HOP1} SELECT seed_id, 0::INT AS pos, round(avg((nbr % 10)::DOUBLE), 6) AS value FROM hop1 GROUP BY 1"))
def neighbor_mean(spark, sf_dir):
    edges = edges_of(spark, sf_dir)
    features = edges.select(F.explode(F.array("src", "dst")).alias("nid")).distinct().withColumn("x", F.array((F.col("nid") % 10).cast("double")))
    return kernels.neighbor_mean(neighbors.recent(neighbors.link_seeds(edges), edges, K, CAP), features).withColumn("value", F.round("value", 6))


@query(on_activity(f""", {_ENTRIES}, {_HOP1}, e AS (SELECT seed_id, nbr, exp((nbr_t - q) / 86400.0::DOUBLE - max((nbr_t - q) / 86400.0::DOUBLE) OVER (PARTITION BY seed_id)) AS w FROM hop1)
SELECT seed_id, round(sum(w * (nbr % 10)) / sum(w), 6) AS value FROM e GROUP BY 1"""))
def attention(spark, sf_dir):
    """Neighbours weigh by the softmax of their age in days."""
    edges = edges_of(spark, sf_dir)
    found = neighbors.recent(neighbors.link_seeds(edges), edges, K, CAP)
    return kernels.attend(found, (F.col("nbr_t") - F.col("q")) / 86_400.0, F.col("nbr") % 10).withColumn("value", F.round("value", 6))


@query(on_activity(f""", {_ENTRIES}, {_HOP1}, l AS (SELECT seed_id, count(*) AS n FROM hop1 GROUP BY 1), places AS (SELECT seed_id, node, unnest(range({K + 1})) AS place FROM seeds)
SELECT p.seed_id, (p.place // 2)::INT AS patch, (p.place % 2)::INT AS pos, CASE WHEN p.place = 0 THEN p.node ELSE coalesce(h.nbr, -1) END AS nbr FROM places p LEFT JOIN l USING (seed_id)
LEFT JOIN hop1 h ON h.seed_id = p.seed_id AND h.slot = p.place - 1 - ({K} - coalesce(l.n, 0))"""))
def patched_sequences(spark, sf_dir):
    """Each seed before its padded neighbours, cut into patches of two."""
    edges = edges_of(spark, sf_dir)
    seeds = neighbors.link_seeds(edges)
    lists = neighbors.pad(seeds, neighbors.recent(seeds, edges, K, CAP), K).join(seeds.select("seed_id", "node", "q"), "seed_id")
    lists = kernels.self_first(lists, "node", "q", "nbrs", "nbr_ts")
    return lists.select("seed_id", F.posexplode(kernels.patches(F.col("nbrs"), 2)).alias("patch", "values")).select("seed_id", "patch", F.posexplode("values").alias("pos", "nbr"))


@query(on_activity(""", w AS (SELECT batch_id, u, v, count(*)::DOUBLE AS a FROM (SELECT batch_id, src AS u, dst AS v FROM edges WHERE src <> dst UNION ALL SELECT batch_id, dst, src FROM edges WHERE src <> dst) GROUP BY 1, 2, 3),
g AS (SELECT batch_id, u, sum(a) AS d FROM w GROUP BY 1, 2), l AS (SELECT w.batch_id, w.u, w.v, -a / sqrt(x.d * y.d) AS w FROM w JOIN g x ON x.batch_id = w.batch_id AND x.u = w.u JOIN g y ON y.batch_id = w.batch_id AND y.u = w.v),
t0 AS (SELECT DISTINCT batch_id, unnest([src, dst]) AS node FROM edges), t1 AS (SELECT batch_id, u AS node, sum(w * (v % 10)) AS value FROM l GROUP BY 1, 2),
t2 AS (SELECT batch_id, node, sum(value) AS value FROM (SELECT l.batch_id, l.u AS node, 2 * sum(l.w * t1.value) AS value FROM l JOIN t1 ON t1.batch_id = l.batch_id AND t1.node = l.v GROUP BY 1, 2 UNION ALL SELECT batch_id, node, -(node % 10)::DOUBLE FROM t0) GROUP BY 1, 2)
SELECT batch_id, node, 0::INT AS k, (node % 10)::DOUBLE AS value FROM t0 UNION ALL SELECT batch_id, node, 1::INT, round(value, 6) FROM t1 UNION ALL SELECT batch_id, node, 2::INT, round(value, 6) FROM t2"""))
def chebyshev_propagation(spark, sf_dir):
    edges = edges_of(spark, sf_dir)
    values = kernels.endpoints_of(edges, ["batch_id"]).select("batch_id", F.col("nid").alias("node"), (F.col("nid") % 10).cast("double").alias("value"))
    return kernels.chebyshev(edges, values, ["batch_id"], 3).withColumn("value", F.round("value", 6))


_PAIRS = """half AS (SELECT batch_id AS b, src AS u, dst AS v FROM edges UNION ALL SELECT batch_id, dst, src FROM edges), users AS (SELECT max(src) + 1 AS n FROM edges),
ids AS (SELECT event_idx AS pair_id, batch_id, src AS i, (src * 7 + 1) % n AS j FROM edges, users),
i1 AS (SELECT pair_id, batch_id, i, j, v AS nbr, count(*)::DOUBLE AS w FROM ids JOIN half ON u = i AND b < batch_id GROUP BY 1, 2, 3, 4, 5),
j1 AS (SELECT pair_id, batch_id, i, j, v AS nbr, count(*)::DOUBLE AS w FROM ids JOIN half ON u = j AND b < batch_id GROUP BY 1, 2, 3, 4, 5),
i2 AS (SELECT pair_id, i, j, v AS nbr, sum(w) AS w FROM i1 JOIN half ON u = nbr AND b < batch_id WHERE nbr <> i AND nbr <> j AND v <> i AND v <> j GROUP BY 1, 2, 3, 4),
j2 AS (SELECT pair_id, i, j, v AS nbr, sum(w) AS w FROM j1 JOIN half ON u = nbr AND b < batch_id WHERE nbr <> i AND nbr <> j AND v <> i AND v <> j GROUP BY 1, 2, 3, 4),
cn AS (SELECT pair_id, '1-1' AS "order", nbr, i1.w * j1.w AS weight FROM i1 JOIN j1 USING (pair_id, nbr)
  UNION ALL SELECT pair_id, '0-1', i, w FROM j1 WHERE nbr = i UNION ALL SELECT pair_id, '1-0', j, w FROM i1 WHERE nbr = j
  UNION ALL SELECT pair_id, '1-2', nbr, i1.w * j2.w FROM i1 JOIN j2 USING (pair_id, nbr) WHERE nbr <> i1.i AND nbr <> i1.j
  UNION ALL SELECT pair_id, '2-1', nbr, i2.w * j1.w FROM i2 JOIN j1 USING (pair_id, nbr) WHERE nbr <> i2.i AND nbr <> i2.j
  UNION ALL SELECT pair_id, '2-2', nbr, i2.w * j2.w FROM i2 JOIN j2 USING (pair_id, nbr))"""


def _common(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The pairs of every batch, with partners among all users, and the edges."""
    edges = keep(edges_of(spark, sf_dir).select("batch_id", "event_idx", "src", "dst"), "edges")
    n = edges.agg(F.max("src")).first()[0] + 1
    return edges.select(F.col("event_idx").alias("pair_id"), "batch_id", F.col("src").alias("i"), ((F.col("src") * 7 + 1) % n).alias("j")), edges


@query()  # the rows are as many as the SQL is slow; compared with brute force in tests/test_as_of.py
def common_neighbors(spark, sf_dir):
    # products of numbers of edges: whole, so nothing is to be rounded
    return kernels.common_neighbors(*_common(spark, sf_dir), 8, before=True)


@query(on_activity(f', {_PAIRS} SELECT pair_id, "order", 0::INT AS pos, round(sum(weight * (nbr % 10)), 6) AS value FROM cn GROUP BY 1, 2'))
def common_neighbor_features(spark, sf_dir):
    # weighted_features of the feature nid % 10 that every node has; a join would only look it up
    rows = kernels.common_neighbor_sums(*_common(spark, sf_dir), F.col("nbr") % 10)
    return rows.select("pair_id", "order", F.lit(0).alias("pos"), rounded("value", "value"))


@query(on_activity(""", tops AS (SELECT batch_id, max(t) AS top FROM edges GROUP BY 1), fin AS (SELECT max(top) AS f FROM tops),
wy AS (SELECT batch_id, u, v, sum(exp(-1e-6::DOUBLE * (top - t))) AS w FROM (SELECT batch_id, t, src AS u, dst AS v FROM edges UNION ALL SELECT batch_id, t, dst, src FROM edges) JOIN tops USING (batch_id) GROUP BY 1, 2, 3),
one AS (SELECT u, v, sum(w * exp(-1e-6::DOUBLE * (f - top))) AS val FROM wy JOIN tops USING (batch_id), fin GROUP BY 1, 2),
two AS (SELECT a.u, b.v, sum(a.w * b.w * exp(-1e-6::DOUBLE * (ta.top - tb.top)) * exp(-2e-6::DOUBLE * (f - ta.top))) AS val
  FROM wy a JOIN wy b ON b.u = a.v AND b.batch_id < a.batch_id JOIN tops ta ON ta.batch_id = a.batch_id JOIN tops tb ON tb.batch_id = b.batch_id, fin GROUP BY 1, 2)
SELECT 1::INT AS layer, u AS node, v AS col, round(val, 6) AS val FROM one UNION ALL SELECT 2::INT, u, v, round(val, 6) FROM two"""))
def walk_matrices(spark, sf_dir):
    """The walk matrices after all batches of the log; layer 0 is the identity."""
    return kernels.walk_matrices(edges_of(spark, sf_dir), 2).where("layer > 0").select("layer", "node", "col", rounded("val", "val"))


_DIMS = 16
_SIGN = lambda node, dim: f"(1 - 2 * (({scattered_sql(node, dim, '0')} >> 16) % 2)) / sqrt({_DIMS}::DOUBLE)"


@query(on_activity(f""", fin AS (SELECT max(t) AS f FROM edges), ks AS (SELECT unnest(range({_DIMS}))::INT AS col),
w AS MATERIALIZED (SELECT batch_id, u, v, sum(exp(-1e-6::DOUBLE * (f - t))) AS w FROM (SELECT batch_id, t, src AS u, dst AS v FROM edges UNION ALL SELECT batch_id, t, dst, src FROM edges), fin GROUP BY 1, 2, 3),
r AS MATERIALIZED (SELECT v AS node, col, {_SIGN("v", "col")} AS val FROM (SELECT DISTINCT v FROM w), ks),
one AS MATERIALIZED (SELECT batch_id, u AS node, col, sum(w * val) AS val FROM w JOIN r ON node = v GROUP BY 1, 2, 3),
asked AS (SELECT DISTINCT batch_id, v AS node FROM w), both_ AS (SELECT batch_id, node, col, val FROM one UNION ALL SELECT batch_id, node, col, 0 FROM asked, ks),
so_far AS MATERIALIZED (SELECT batch_id, node, col, sum(sum(val)) OVER (PARTITION BY node, col ORDER BY batch_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS val FROM both_ GROUP BY 1, 2, 3),
two AS (SELECT u AS node, col, sum(w * val) AS val FROM w JOIN so_far s ON s.node = v AND s.batch_id = w.batch_id WHERE val IS NOT NULL GROUP BY 1, 2)
SELECT 0::INT AS layer, node, col, round(val, 5) + 0 AS val FROM r UNION ALL SELECT 1::INT, node, col, round(sum(val), 5) + 0 FROM one GROUP BY 2, 3 UNION ALL SELECT 2::INT, node, col, round(val, 5) + 0 FROM two"""))
def walk_projection(spark, sf_dir):
    """Hashed random projections of the rows of the walk matrices of all layers."""
    return kernels.projected_walks(edges_of(spark, sf_dir), 2, _DIMS).select("layer", "node", "col", (F.round("val", 5) + 0).alias("val"))


# -- streams -----------------------------------------------------------------------------------------

#: Updates that a replayed log is cut into, and the files of each.
UPDATES, FILES = 6, 4


@query(on_activity(f""", u AS (SELECT *, event_idx * {UPDATES} // (SELECT count(*) FROM log) AS update FROM edges)
SELECT a.event_idx AS query, a.src, a.dst, max(b.t) AS last_t, (count(b.t) > 0)::INT::DOUBLE AS score FROM u a LEFT JOIN u b ON a.src = b.src AND a.dst = b.dst AND b.update < a.update GROUP BY 1, 2, 3"""))
def streamed_edgebank(spark, sf_dir):
    """The log replayed as a stream of updates, each of which asks for its own edges before they are entered."""
    events = activity(spark, sf_dir).events
    log = keep(events.where("kind = 0").select("event_idx", "t", "src", "dst"), "replayed")
    size, path, out, at = events.count(), new_path(spark, "updates"), new_path(spark, "scores"), new_path(spark, "stream-state")
    rows = log.withColumn("query", F.explode(F.array(F.lit(None).cast("long"), F.col("event_idx")))).select("src", "dst", "t", "query", F.expr(f"event_idx * {UPDATES} div {size}").alias("update"))
    for i in range(UPDATES):  # one after the other: a stream takes files in the order in which they came
        rows.where(F.col("update") == i).drop("update").repartition(FILES).write.mode("append").parquet(path)
    stream = spark.readStream.schema("src long, dst long, t long, query long").option("maxFilesPerTrigger", FILES).parquet(path)
    with configured(spark, memory.SETTINGS):
        running = memory.edgebank(stream, late="1 second").writeStream.format("parquet").option("checkpointLocation", at).outputMode("append").start(out)
        try:
            running.processAllAvailable()
        finally:
            running.stop()
    return spark.read.schema(memory.SCORES).parquet(out)


# -- sources -----------------------------------------------------------------------------------------


@query("""
WITH x AS (SELECT event_id AS ordinal, 'u' || user_id AS a, 'i' || regexp_extract(props, '[0-9]+') AS b, epoch_us(ts) // 1000000 AS ts, value FROM events),
f AS (SELECT address, min(struct_pack(side := side, place := place)) AS f FROM (SELECT a AS address, ordinal AS place, 0 AS side FROM x UNION ALL SELECT b, ordinal, 1 FROM x) GROUP BY 1),
ids AS (SELECT address, row_number() OVER (ORDER BY f, address) - 1 AS id FROM f), m AS (SELECT min(ts) AS t0, min(value) AS lo, max(value) AS hi FROM x)
SELECT s.id AS src, d.id AS dst, ts - t0 AS t, round(1 + 9 * (value - lo) / (hi - lo), 6) AS w FROM x JOIN ids s ON s.address = a JOIN ids d ON d.address = b, m
""")
def token_transfer_etl(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    seconds = F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz"))
    transfers = rows.select(F.concat(F.lit("u"), "user_id").alias("from"), F.concat(F.lit("i"), F.regexp_extract("props", "[0-9]+", 0)).alias("to"), seconds.alias("timestamp"), "value", F.col("event_id").alias("ordinal"))
    return token_transfers(transfers).select("src", "dst", "t", rounded("w", "w"))
