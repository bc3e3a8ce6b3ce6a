import random

from pyspark.sql import functions as F

from tidegraph.operators import neighbors, tracking
from tidegraph.streaming import operators as streaming

SCHEMA = "batch_id long, event_idx long, t long, kind int, src long, dst long, nid long, edge_x array<float>"


def run(spark, tmp_path, rows, build, name, mode="append"):
    """Rows as files, a batch a file, through a streaming query into memory."""
    for b in sorted({r[0] for r in rows}):
        spark.createDataFrame([r for r in rows if r[0] == b], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{b:03}"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    query = build(stream.withColumn("ts", F.timestamp_seconds(F.col("t") + 1_000_000_000))).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return spark.table(name)


def events(n=36, size=9, seed=2):
    rng, rows = random.Random(seed), []
    for i in range(n):
        kind = 2 if i % 6 == 5 else 0
        rows.append((i // size, i, 10 * (i // 2), kind, None if kind else rng.randrange(5), None if kind else rng.randrange(5), rng.randrange(7) if kind else None, None if kind else [0.0]))
    return rows


def test_recent_neighbours_equal_the_batch_operator(spark, tmp_path):
    rows = events()
    edges = spark.createDataFrame(rows, SCHEMA).where("kind = 0")
    expected = neighbors.recent(neighbors.link_seeds(edges), edges, 2)
    got = run(spark, tmp_path, rows, lambda s: streaming.recent(s.where("kind = 0"), 2), "recent")
    assert sorted((2 * r["event_idx"] + r["role"], r["slot"], r["nbr"], r["nbr_t"]) for r in got.collect()) == sorted((r["seed_id"], r["slot"], r["nbr"], r["nbr_t"]) for r in expected.collect())


def test_seen_nodes_equal_the_batch_operator(spark, tmp_path):
    rows = events()
    expected = tracking.seen_nodes(spark.createDataFrame(rows, SCHEMA))
    got = run(spark, tmp_path, rows, streaming.seen_nodes, "seen")
    assert sorted((r["batch_id"], r["nid"]) for r in got.collect()) == sorted((r["batch_id"], r["nid"]) for r in expected.collect())


def test_snapshots_sessions_and_first_events(spark, tmp_path):
    rows = [r for r in events() if r[3] == 0]
    got = run(spark, tmp_path / "a", rows, lambda s: streaming.snapshots(s, "60 seconds", "0 seconds"), "snapshots", "complete")
    assert sum(r["n_edges"] for r in got.collect()) == len(rows)
    slid = run(spark, tmp_path / "d", rows, lambda s: streaming.sliding(s, "60 seconds", "30 seconds", "0 seconds"), "slid", "complete")
    latest = {}
    for r in rows:
        at = r[2] + 1_000_000_000
        for begin in (at // 30 * 30, at // 30 * 30 - 30):
            latest[begin, r[4], r[5]] = max(latest.get((begin, r[4], r[5]), 0), at)
    ends = slid.select(F.unix_seconds("window.start").alias("begin"), "src", "dst", F.unix_seconds("last_ts").alias("last")).collect()
    assert {(r["begin"], r["src"], r["dst"]): r["last"] for r in ends} == latest
    first = run(spark, tmp_path / "b", rows, lambda s: streaming.first_per_bucket(s, 1000, "1 hour"), "first")
    assert first.count() == len({(r[4], r[5]) for r in rows})
    sessions = run(spark, tmp_path / "c", rows, lambda s: streaming.sessions(s, "1 hour", "0 seconds"), "sessions", "complete")
    assert sum(r["n"] for r in sessions.collect()) == len(rows)
