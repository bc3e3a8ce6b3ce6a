"""Scans against brute force, and plans that have no window without a key."""

import random

import pytest
from pyspark.sql import functions as F

from tidegraph.functions.scan import scan
from tidegraph.operators import analytics, kernels, metrics, predictors


def brute(rows, keyed, inclusive):
    out = {}
    for i, (k, at, _) in enumerate(rows):
        mine = [(a, x) for key, a, x in rows if (key == k or not keyed) and x is not None]
        before = [(a, x) for a, x in mine if a < at or inclusive and a == at]
        after = [(a, x) for a, x in mine if a > at]
        out[i] = (sum(x for _, x in before) if before else None, max((x for _, x in before), default=None), min((x for _, x in before), default=None), max(before, default=(0, None))[1], min(after, default=(0, None))[1])
    return out


@pytest.mark.parametrize("keyed", [True, False])
@pytest.mark.parametrize("inclusive", [False, True])
def test_scan(spark, keyed, inclusive):
    rng = random.Random(4)
    places = rng.sample(range(-300, 3000), 90)  # several spans of spans at two bits
    rows = [(rng.choice("ab"), p, rng.choice([None, *range(-9, 9)])) for p in places]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, k string, at long, v long").repartition(5)
    folds = {"s": ("sum", "v"), "hi": ("max", "v"), "lo": ("min", F.col("v")), "z": ("last", "v"), "n": ("next", "v")}
    got = {r["i"]: (r["s"], r["hi"], r["lo"], r["z"], r["n"]) for r in scan(frame, ["k"] if keyed else [], "at", folds, inclusive, bits=2).collect()}
    assert got == brute(rows, keyed, inclusive)


def test_rows_of_one_step_do_not_count_for_each_other(spark):
    frame = spark.createDataFrame([(1, 10), (1, 20), (2, 5)], "at long, v long")
    assert sorted((r["at"], r["v"], r["s"]) for r in scan(frame, [], "at", {"s": ("sum", "v")}).collect()) == [(1, 10, None), (1, 20, None), (2, 5, 30)]
    assert scan(frame.limit(0), [], "at", {"s": ("sum", "v"), "m": ("last", "v")}).count() == 0


def test_last_value_may_be_a_vector(spark):
    frame = spark.createDataFrame([(1, 3, [1.0, 2.0]), (1, 9, [3.0, 4.0]), (2, 1, [5.0, 6.0])], "k long, at long, y array<float>")
    assert sorted((r["k"], r["at"], r["p"]) for r in scan(frame, ["k"], "at", {"p": ("last", "y")}).collect()) == [(1, 3, None), (1, 9, [1.0, 2.0]), (2, 1, None)]


def plan(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_no_window_over_batches_or_scores_lacks_a_key(spark):
    edges = spark.createDataFrame([(i // 3, i, i, i % 4, i % 5, [1.0]) for i in range(30)], "batch_id long, event_idx long, t long, src long, dst long, edge_x array<float>")
    asked = edges.select("batch_id", "src", "dst")
    figures = analytics.snapshot_metrics(edges.withColumn("kind", F.lit(0)).withColumn("nid", F.lit(None).cast("long")))
    scored = spark.createDataFrame([(0, 0.5), (1, 0.25)], "label int, score double")
    init = edges.where("batch_id < 2")
    rest = edges.where("batch_id >= 2")
    for frame in (predictors.base3(init, rest, asked, "fixed"), predictors.poptrack(init, rest, asked), predictors.graph_forecast(figures), analytics.trend_labels(figures), kernels.edge_ratio(figures), metrics.binary_areas(scored)):
        windows = [line for line in plan(frame).splitlines() if line.lstrip(" :+-").startswith("Window ")]
        assert all(line.count("], [") == 2 for line in windows), windows  # expressions, keys, order


@pytest.mark.parametrize("decay", [0.5, 0.9, 1.0])
def test_popularity_over_a_thousand_batches_and_many_blocks(spark, decay):
    rng = random.Random(9)
    rows = [(b, b, b, 1, rng.randrange(3)) for b in range(0, 6000) if rng.random() < 0.2]
    edges = spark.createDataFrame(rows, "batch_id long, event_idx long, t long, src long, dst long")
    asked = edges.select("batch_id", "dst")
    got = {(r["batch_id"], r["dst"]): r["score"] for r in predictors.poptrack(edges.limit(0), edges, asked, decay).collect()}
    mass, expected = {}, {}
    for b, _, _, _, d in rows:
        mass = {k: v * decay for k, v in mass.items()}
        expected[b, d] = mass.get(d, 0.0)
        mass[d] = mass.get(d, 0.0) + 1
    shift = [k for k in expected if abs(got[k] - expected[k]) > 1e-9 * max(1, expected[k])]
    assert set(got) == set(expected) and not shift, (shift[:3], [(got[k], expected[k]) for k in shift[:3]])
