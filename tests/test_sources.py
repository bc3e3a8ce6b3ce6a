import json

import pandas as pd
import pytest

from tidegraph.operators import negatives
from tidegraph.operators.batching import batched
from tidegraph.operators.splits import BoundsSplit, split
from tidegraph.sources import metric_log
from tidegraph.sources.readers import bounds_of, from_bundle, from_csv, from_pandas, from_sequence_bundle, token_transfers
from tidegraph.timedelta import DATASETS, SEQUENCE_DATASETS, delta_of


def rows_of(log, *columns):
    return [tuple(r) for r in log.events.orderBy("event_idx").select(*columns).collect()]


def test_csv(spark, tmp_path):
    pd.DataFrame({"a": [3, 1], "b": [4, 2], "when": [5, 5], "f": [0.5, 1.5], "g": [1, 2]}).to_csv(tmp_path / "e.csv", index=False)
    pd.DataFrame({"n": [1], "when": [7], "v": [2.0]}).to_csv(tmp_path / "n.csv", index=False)
    pd.DataFrame({"s": [float(i) for i in range(5)], "k": [0, 1, 0, 1, 0]}).to_csv(tmp_path / "s.csv", index=False)
    log = from_csv(spark, str(tmp_path / "e.csv"), "a", "b", "when", edge_x=["f", "g"], node_x=str(tmp_path / "n.csv"), node_x_nid="n", node_x_t="when", node_x_x="v", static=str(tmp_path / "s.csv"), static_x=["s"], node_type="k", delta="s")
    assert rows_of(log, "t", "src", "edge_x", "nid", "x") == [(5, 3, [0.5, 1.0], None, None), (5, 1, [1.5, 2.0], None, None), (7, None, None, 1, [2.0])]
    assert [(r["nid"], r["static_x"], r["node_type"]) for r in log.nodes.orderBy("nid").collect()][3] == (3, [3.0], 1)
    with pytest.raises(ValueError):
        from_csv(spark, str(tmp_path / "e.csv"), "a", "b", "when", node_x=str(tmp_path / "n.csv"))
    with pytest.raises(ValueError):
        from_csv(spark, str(tmp_path / "e.csv"), "a", "b", "when", static=str(tmp_path / "s.csv"))


def test_pandas_with_a_column_of_lists(spark):
    log = from_pandas(spark, pd.DataFrame({"src": [2, 10], "dst": [3, 20], "t": [1337, 1338], "x": [[1.0, 2.0], [3.0, 4.0]]}), "src", "dst", "t", edge_x="x")
    assert rows_of(log, "t", "src", "dst", "edge_x") == [(1337, 2, 3, [1.0, 2.0]), (1338, 10, 20, [3.0, 4.0])]


def test_bundle(spark, tmp_path):
    edges = spark.createDataFrame([(i, i + 1, i, i) for i in range(10)], "src long, dst long, t long, ordinal long")
    edges.write.parquet(str(tmp_path / "edges.parquet"))
    spark.createDataFrame([(i, i, [1.0]) for i in range(10)], "nid long, t long, y array<double>").write.parquet(str(tmp_path / "labels.parquet"))
    (tmp_path / "bounds.json").write_text(json.dumps({"train": [0, 6], "val": [7, 8], "test": [9, 9]}))
    log = from_bundle(spark, str(tmp_path), "node")
    assert isinstance(log.split, BoundsSplit) and log.node_labels().count() == 9
    assert [p.edges().count() for p in split(log)] == [7, 2, 1]
    with pytest.raises(ValueError):
        from_bundle(spark, str(tmp_path), "knowledge")


def test_token_transfers(spark):
    rows = spark.createDataFrame([("b", "a", 10, 5.0, 0), ("c", "b", 12, 15.0, 1)], "`from` string, `to` string, timestamp long, value double, ordinal long")
    assert sorted(map(tuple, token_transfers(rows).collect())) == [(0, 2, 0, 1.0, 0), (1, 0, 2, 10.0, 1)]


def test_metric_log(spark, tmp_path):
    metric_log.enable_logging(str(tmp_path / "log"))
    for v in (1.0, 3.0, 2.0):
        metric_log.log_metric("loss", v)
    metric_log.logger.info("not a metric")
    metric_log.log_latency(lambda: None)()
    got = metric_log.read_metrics(spark, str(tmp_path / "log"))
    values = {how: {r["metric"]: r["value"] for r in metric_log.reduce_metrics(got, how).collect()}["loss"] for how in ("mean", "median", "min", "max", "last")}
    assert values == {"mean": 2.0, "median": 2.0, "min": 1.0, "max": 3.0, "last": 2.0}
    full = metric_log.reduce_metrics(got, "full").where("metric = 'loss'").first()
    assert full["std"] == 1.0 and full["p25"] == 1.5
    a, b = metric_log.reduce_metrics(got, "min"), metric_log.reduce_metrics(got, "max")
    assert {r["metric"]: r["delta_pct"] for r in metric_log.compare_metrics(a, b).collect()}["loss"] == 200.0
    with pytest.raises(ValueError):
        metric_log.reduce_metrics(got, "mode")


def test_granularities_of_public_benchmarks(spark, tmp_path):
    assert (len(DATASETS), len(SEQUENCE_DATASETS)) == (22, 8)
    assert [delta_of(n).unit for n in ("tgbl-wiki", "tgbn-trade", "tkgl-icews", "Yelp")] == ["s", "Y", "D", "s"]
    with pytest.raises(ValueError, match="tgbl-none"):
        delta_of("tgbl-none")
    spark.createDataFrame([(1, 2, 3), (2, 3, 9)], "src long, dst long, t long").write.parquet(str(tmp_path / "edges.parquet"))
    (tmp_path / "bounds.json").write_text(json.dumps({"train": [0, 3], "val": [4, 8], "test": [9, 9]}))
    assert [from_bundle(spark, str(tmp_path), **kw).delta.unit for kw in ({}, {"dataset": "tgbn-trade"}, {"delta": "D"})] == ["s", "Y", "D"]


def test_sequence_bundle_has_bounds_from_flags_and_stored_negatives(spark, tmp_path):
    rows = [(i % 5, 10 + i % 7, i // 2, i < 12, 12 <= i < 16, i >= 16, i) for i in range(20)]
    spark.createDataFrame(rows, "src long, dst long, t long, train boolean, val boolean, test boolean, ordinal long").write.parquet(str(tmp_path / "edges.parquet"))
    log = from_sequence_bundle(spark, str(tmp_path), "Yelp")
    train, val, test = split(log)
    assert log.delta.unit == "s" and log.split.bounds == {"train": (0, 5), "val": (6, 7), "test": (8, 9)}
    assert [p.edges().count() for p in (train, val, test)] == [12, 4, 4]
    stored = spark.createDataFrame([(i, [100 * i, 100 * i + 1]) for i in range(4)], "row long, negs array<long>")
    edges = batched(test, 3).events  # two batches: the offset runs on
    got = {r["event_idx"]: r["negs"] for r in negatives.split_negatives(edges, "test", stored).collect()}
    assert got == {16 + i: [100 * i, 100 * i + 1] for i in range(4)} or got == {i: [100 * i, 100 * i + 1] for i in range(4)}
    short = {r["event_idx"] - min(got): r["negs"] for r in negatives.split_negatives(edges, "test", stored.where("row < 2")).collect()}
    assert short == {0: [0, 1], 1: [100, 101], 2: None, 3: None}
    drawn = negatives.split_negatives(val.edges(), "val", per_edge=6).collect()
    span = [10 + i % 7 for i in range(12, 16)]
    assert len(drawn) == 4 and all(len(r["negs"]) == 6 and all(min(span) <= n < max(span) for n in r["negs"]) for r in drawn)
    with pytest.raises(ValueError):
        negatives.split_negatives(edges, "test")
    with pytest.raises(ValueError):
        from_sequence_bundle(spark, str(tmp_path))
    with pytest.raises(ValueError, match="val"):
        bounds_of(spark.createDataFrame([(1, True, False, True)], "t long, train boolean, val boolean, test boolean"))
