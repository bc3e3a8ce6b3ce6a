"""Streaming memories against the batch operators, trigger by trigger; their bounds, resets and hand-over."""

import random

import pytest

from tidegraph.operators import negatives, predictors
from tidegraph.plans.protocol import BatchFrame
from tidegraph.plans import library
from tidegraph.streaming import memory

SCHEMA = "src long, dst long, t long, query long, epoch long, clock long"


@pytest.fixture(autouse=True)
def rocks(spark):
    for k, v in memory.SETTINGS.items():
        spark.conf.set(k, v)
    yield
    for k in memory.SETTINGS:
        spark.conf.unset(k)


def run(spark, tmp_path, triggers, build, name, columns=("src", "dst", "t", "query")):
    """A trigger for each list of rows; the rows that came out, and the progress of each trigger."""
    for i, rows in enumerate(triggers):
        spark.createDataFrame(rows, SCHEMA).select(*columns).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{i:03}"))
    kinds = ", ".join(f"{c} long" for c in columns)
    stream = spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    query = build(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        query.processAllAvailable()
        progress = list(query.recentProgress)
    finally:
        query.stop()
    return spark.table(name).collect(), progress


def log(n=8, size=12, seed=4, nodes=4):
    """Batches of edges in time, some late by up to 20 seconds, and questions of each batch."""
    rng, batches, t = random.Random(seed), [], 1_000_000
    for b in range(n):
        edges = []
        for _ in range(size):
            t += rng.randrange(4)
            edges.append((rng.randrange(nodes), 10 + rng.randrange(nodes), max(t - rng.choice([0, 0, 0, 15]), 1_000_000)))
        asked = [(s, d) for s in range(nodes) for d in range(10, 10 + nodes)]
        batches.append((edges, asked))
    return batches


def as_rows(batches, epoch=0, clock=None):
    return [[(s, d, t, None, epoch, clock[b] if clock else None) for s, d, t in edges] + [(s, d, edges[0][2] if edges else 1_000_000, 1000 * b + i, epoch, clock[b] if clock else None) for i, (s, d) in enumerate(asked)] for b, (edges, asked) in enumerate(batches)]


def expected_scores(batches, size, history=(), before=()):
    """Brute force: the pairs of earlier batches, of which the last time is in the window before the latest time."""
    seen, end, out = {}, None, {}
    for s, d, t in history:
        seen[s, d] = max(t, seen.get((s, d), t))
        end = t if end is None else max(end, t)
    for b, (edges, asked) in enumerate(batches):
        for i, (s, d) in enumerate(asked):
            last = seen.get((s, d))
            out[1000 * b + i] = float(last is not None and (size is None or last >= end - size))
        for s, d, t in edges:
            seen[s, d] = max(t, seen.get((s, d), t))
        end = max([t for _, _, t in edges] + ([end] if end is not None else []), default=None)
    return out


@pytest.mark.parametrize("size", [None, 30])
def test_edgebank_is_that_of_the_batch_predictor(spark, tmp_path, size):
    batches = log()
    got, _ = run(spark, tmp_path, as_rows(batches), lambda s: memory.edgebank(s, size, "60 seconds"), f"bank{size}")
    got = {r["query"]: r["score"] for r in got}
    assert got == expected_scores(batches, size) and 0 < sum(got.values()) < len(got)
    edges = spark.createDataFrame([(b, i, s, d, t) for b, (rows, _) in enumerate(batches) for i, (s, d, t) in enumerate(rows)], "batch_id long, event_idx long, src long, dst long, t long")
    asked = spark.createDataFrame([(b, s, d, 1000 * b + i) for b, (_, rows) in enumerate(batches) for i, (s, d) in enumerate(rows)], "batch_id long, src long, dst long, query long")
    if size is None:
        batch = predictors.edgebank(edges.limit(0), edges, asked)
        assert {r["query"]: r["score"] for r in batch.collect()} == got


def test_state_is_bounded_by_the_window(spark, tmp_path):
    # each trigger brings new pairs of nodes that never come again, 100 seconds later
    triggers = [[(s + 10 * b, d, 1_000_000 + 100 * b, None, 0, None) for s in range(5) for d in range(4)] for b in range(12)]
    _, progress = run(spark, tmp_path, triggers, lambda s: memory.edgebank(s, 150), "bounded")
    held = [p["stateOperators"][0]["customMetrics"]["numUpdatedStateRows"] if False else p["stateOperators"][0]["numRowsTotal"] for p in progress if p["numInputRows"]]
    assert len(held) >= 12 and max(held[6:]) <= max(held[:6]) + 10 * 5  # only the epoch of a key stays
    forever, progress = run(spark, tmp_path / "all", triggers, lambda s: memory.edgebank(s), "unbounded")
    grown = [p["stateOperators"][0]["numRowsTotal"] for p in progress if p["numInputRows"]]
    assert grown[-1] > 2 * held[-1]


def test_a_greater_epoch_forgets(spark, tmp_path):
    batches = log(3)
    clocks, end = [], None
    for edges, _ in batches:
        clocks.append(end)
        end = max([t for _, _, t in edges] + ([end] if end else []))
    triggers = as_rows(batches, 0, clocks) + as_rows(batches, 1, clocks)
    got, _ = run(spark, tmp_path, triggers, lambda s: memory.edgebank(s, 30), "epochs", ("src", "dst", "t", "query", "epoch", "clock"))
    once = sorted(expected_scores(batches, 30).items())
    assert sorted((r["query"], r["score"]) for r in got) == sorted(once * 2)
    with pytest.raises(ValueError):
        memory.edgebank(spark.createDataFrame([], "src long, dst long, t long, query long, epoch long"))


@pytest.mark.parametrize("size", [None, 30])
def test_trained_in_batch_and_tested_as_a_stream(spark, tmp_path, size):
    batches = log(8, seed=7)
    train, test = batches[:5], batches[5:]
    history = [e for edges, _ in train for e in edges]
    held, end = memory.remembered(spark.createDataFrame(history, "src long, dst long, t long"), size)
    got, _ = run(spark, tmp_path, as_rows(test), lambda s: memory.edgebank(s, size, "60 seconds", end, initial=held), f"handed{size}")
    assert {r["query"]: r["score"] for r in got} == expected_scores(test, size, history)


def test_historical_draws_are_those_of_the_operator(spark, tmp_path):
    batches = log(4, seed=9)
    triggers = [[(s, d, t, None, 0, None) for s, d, t in edges] + [(s, 0, 0, 100 + b, 0, None) for s in sorted({s for s, _, _ in edges})] for b, (edges, _) in enumerate(batches)]
    got, _ = run(spark, tmp_path, triggers, memory.historical_negatives, "drawn")
    got = {(r["query"], r["src"]): (r["neg"], r["valid"]) for r in got}
    operator = library.HistoricalNegatives()
    for b, (edges, _) in enumerate(batches):
        rows = [(i, 100 + b, t, 0, s, d) for i, (s, d, t) in enumerate(edges)]
        out = operator.apply(BatchFrame(spark.createDataFrame(rows, "event_idx long, batch_id long, t long, kind int, src long, dst long")))["neg"].collect()
        assert {(100 + b, r["src"]): (r["neg"], r["valid"]) for r in out} == {k: v for k, v in got.items() if k[0] == 100 + b}
    counts = negatives.counts_after(spark.createDataFrame([(s, d) for edges, _ in batches[:2] for s, d, _ in edges], "src long, dst long"))
    handed, _ = run(spark, tmp_path / "b", triggers[2:], lambda s: memory.historical_negatives(s, initial=counts), "handed_draws")
    assert {(r["query"], r["src"]): (r["neg"], r["valid"]) for r in handed} == {k: v for k, v in got.items() if k[0] >= 102}


def test_node_figures(spark, tmp_path):
    batches = log(5, seed=11)
    triggers = [[(s, d, t, None, e, None) for s, d, t in edges] for e in (0, 1) for edges, _ in batches]
    got, _ = run(spark, tmp_path, triggers, lambda s: memory.node_figures(s, "60 seconds"), "figures", ("src", "dst", "t", "epoch"))
    expected = []
    for e in (0, 1):
        nbrs, times = {}, {}
        for edges, _ in batches:
            touched = {}
            for s, d, t in edges:
                for a, b in ((s, d), (d, s)):
                    touched.setdefault(a, []).append((b, t))
            for n, rows in touched.items():
                new = {b for b, _ in rows} - nbrs.setdefault(n, set())
                nbrs[n] |= new
                times.setdefault(n, set()).update(t for _, t in rows)
                expected.append((n, e, len(rows), len(new), len(times[n]), min(times[n]), max(times[n])))
    assert sorted(map(tuple, got)) == sorted(expected)
