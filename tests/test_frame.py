import pytest

from tidegraph.errors import EmptyGraphError, EventOrderedConversionError, InvalidDiscretizationError, InvalidNodeIDError
from tidegraph.frame import EventLog
from tidegraph.functions.ranking import global_rank
from tidegraph.operators import splits
from tidegraph.operators.batching import batch_sizes, batched
from tidegraph.operators.discretise import discretise
from tidegraph.timedelta import TimeDelta

E = "src long, dst long, t long, o long"


def log_of(spark, edges, x=None, y=None, delta="r", **more):
    frame = lambda rows, schema: None if rows is None else spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], schema)
    return EventLog.of(frame(edges, E), frame(x, "nid long, t long, o long"), frame(y, "nid long, t long, o long"), delta=delta, order=dict.fromkeys(range(3), ["o"]), **more)


def rows_of(log, *columns):
    return [tuple(r) for r in log.events.orderBy("event_idx").select(*columns).collect()]


@pytest.mark.parametrize("unit,value", [("x", 1), ("s", 0), ("s", -1), ("s", 1.5), ("r", 2)])
def test_bad_granularities(unit, value):
    with pytest.raises(ValueError):
        TimeDelta(unit, value)


def test_granularity_conversion():
    assert TimeDelta("m").convert("s") == 60.0 and TimeDelta("s", 30).convert("m") == 0.5 and TimeDelta("Y").convert("D") == 365.0
    assert TimeDelta("D").is_coarser_than("h") and not TimeDelta("s", 60).is_coarser_than("m")
    with pytest.raises(EventOrderedConversionError):
        TimeDelta("r").convert("s")


def test_events_are_sorted_by_time_kind_and_input(spark):
    log = log_of(spark, [(2, 3, 5), (10, 20, 1)], x=[(1, 8), (2, 7), (3, 6)])
    assert rows_of(log, "t", "kind", "src", "dst", "nid") == [(1, 0, 10, 20, None), (5, 0, 2, 3, None), (6, 1, None, None, 3), (7, 1, None, None, 2), (8, 1, None, None, 1)]


def test_ordinals_keep_their_types(spark):
    edges = spark.createDataFrame([(1, 2, 5, 2**53 + 1), (3, 4, 5, 2**53), (5, 6, 5, 2**53 + 2)], E)
    labels = spark.createDataFrame([(1, 5, "b"), (2, 5, "a")], "nid long, t long, o string")
    log = EventLog.of(edges, None, labels, order={0: ["o"], 2: ["o"]})
    assert rows_of(log, "src", "nid") == [(3, None), (1, None), (5, None), (None, 2), (None, 1)]


def test_a_stored_log_keeps_its_order_and_slices_reach_the_files(spark, tmp_path):
    path = str(tmp_path / "log")
    log = log_of(spark, [(1, 2, 3), (2, 1, 1), (3, 4, 2)], x=[(1, 1)], delta="s").slice_time(0, 9)
    log.write(path)
    back = EventLog.read(spark, path)
    assert sorted(map(tuple, back.events.collect())) == sorted(map(tuple, log.events.collect()))
    assert (back.delta, back.bounds, back.dense, back.nodes) == (log.delta, (0, 9), False, None)
    view = back.slice_time(1, 3).slice_events(1, 3)
    assert rows_of(view, "event_idx", "t") == [(1, 1), (2, 2)]
    plan = view.events._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(" in plan and "Window" not in plan and "Exchange" not in plan


def test_range_ranking_equals_a_global_sort(spark):
    rows = spark.range(500).selectExpr("(id * 37) % 501 AS a", "id % 3 AS b")
    got = global_rank(rows, ["b", "a"], "place").collect()
    expected = sorted((r["b"], r["a"]) for r in got)
    assert [(r["b"], r["a"]) for r in sorted(got, key=lambda r: r["place"])] == expected and sorted(r["place"] for r in got) == list(range(500))


@pytest.mark.parametrize(
    "edges,x,y,error",
    [([], None, None, EmptyGraphError), ([(1, 2, -1)], None, None, ValueError), ([(-1, 2, 1)], None, None, InvalidNodeIDError), ([(1, 2, 1)], None, [(9, 1)], InvalidNodeIDError), ([(1, 2, 1)], [], None, ValueError), ([(None, 2, 1)], None, None, ValueError)],
)
def test_validation(spark, edges, x, y, error):
    with pytest.raises(error):
        log_of(spark, edges, x, y)


def test_validation_of_types_and_nodes(spark):
    edges = spark.createDataFrame([(1, 2, 1.5)], "src long, dst long, t double")
    with pytest.raises(TypeError):
        EventLog.of(edges)
    with pytest.raises(ValueError):
        EventLog.of(edges.selectExpr("src", "dst", "cast(1 as long) as t"), nodes=spark.range(2).selectExpr("id as nid"))
    with pytest.raises(ValueError):
        EventLog.of(spark.createDataFrame([(1, 2, 1, [1.0]), (1, 2, 1, [1.0, 2.0])], "src long, dst long, t long, edge_x array<double>"))


def test_slices(spark):
    log = log_of(spark, [(2, 2, 1), (2, 4, 5), (6, 8, 10)])
    assert sorted(r["nid"] for r in log.slice_time(None, 5).get_nodes().collect()) == [2]
    assert sorted(r["nid"] for r in log.slice_events(2, 5).get_nodes().collect()) == [6, 8]
    view = log.slice_time(2, 20).slice_time(0, 9)
    assert (view.facts["start_time"], view.facts["end_time"], view.facts["num_nodes"], len(view)) == (2, 8, 5, 1)
    empty = log.slice_time(100, 200)
    assert empty.facts["num_nodes"] == 0 and len(empty) == 0
    with pytest.raises(ValueError):
        log.slice_time(5, 1)


EDGES, NODES = [(1, 2, 1), (1, 2, 2), (2, 3, 3), (1, 2, 63), (4, 5, 65)], [(6, 10), (6, 20), (7, 30), (6, 70), (6, 80), (7, 90)]


def test_discretise_keeps_the_first_of_each_bucket(spark):
    hourly = discretise(log_of(spark, [*EDGES, (6, 7, 0)], x=NODES, y=NODES, delta="m"), "h")
    assert rows_of(hourly, "t", "src", "dst")[:3] == [(0, 6, 7), (0, 1, 2), (0, 2, 3)]
    assert [r[1:] for r in rows_of(hourly, "kind", "t", "nid") if r[0] == 1] == [(0, 6), (0, 7), (1, 6), (1, 7)]
    assert [r[1:] for r in rows_of(hourly, "kind", "t", "nid") if r[0] == 2] == [(0, 6), (0, 7), (1, 6), (1, 7)]
    assert hourly.delta == TimeDelta("h")


def test_discretise_errors_and_identity(spark):
    log = log_of(spark, EDGES, delta="m")
    assert discretise(log, "m").events is log.events and discretise(log, None).events is log.events
    with pytest.raises(InvalidDiscretizationError):
        discretise(log, "s")
    with pytest.raises(EventOrderedConversionError):
        discretise(log_of(spark, EDGES), "h")
    with pytest.raises(ValueError):
        discretise(log, "h", "median")


def test_month_bucket_by_doubles_and_exactly(spark):
    log = log_of(spark, [(1, 2, 2_592_000)], delta="s")
    assert rows_of(discretise(log, "M", exact=True), "t") == [(1,)]
    assert rows_of(discretise(log, "M"), "t") == [(int(2_592_000 * (1.0 / 2_592_000)),)]


def test_splits(spark):
    log = log_of(spark, [(1, 2, 1), (3, 4, 2), (5, 6, 3), (7, 8, 4)])
    times = lambda parts: [[r[0] for r in rows_of(p, "t")] for p in parts]
    assert times(splits.split(log, splits.TemporalSplit(3, 4))) == [[1, 2], [3], [4]]
    assert times(splits.split(log, splits.TemporalRatioSplit(0.5, 0.25, 0.25))) == [[1, 2], [3], [4]]
    assert times(splits.split(log, splits.TemporalSplit(3, 9))) == [[1, 2], [3, 4]]
    bounds = splits.BoundsSplit({"train": (1, 2), "val": (3, 3), "test": (4, 4)})
    fixed = EventLog(log.events, log.delta, split=bounds)
    assert times(splits.split(fixed)) == [[1, 2], [3], [4]]
    for bad in (lambda: splits.TemporalSplit(4, 3), lambda: splits.TemporalRatioSplit(0.5, 0.5, 0.5), lambda: splits.split(fixed, splits.TemporalSplit(1, 2))):
        with pytest.raises(ValueError):
            bad()


def test_event_batches(spark):
    log = log_of(spark, [(i + 1, i + 2, i) for i in range(10)])
    sizes = lambda b: [r["n_edges"] for r in batch_sizes(b).orderBy("batch_id").collect()]
    assert sizes(batched(log, 3)) == [3, 3, 3, 1] and sizes(batched(log, 3, drop_last=True)) == [3, 3, 3]
    assert sizes(batched(log, 5, drop_last=True)) == [5, 5] and sizes(batched(log, 5, drop_last=True, strict=True)) == [5]
    assert sizes(batched(log.slice_events(4, 10), 3)) == [3, 3]


def test_time_batches(spark):
    log = log_of(spark, [(i, i + 1, t) for i, t in enumerate([0, 0, 1, 1, 1, 12, 18, 24, 24])])
    log = EventLog(log.events, TimeDelta("s", 10))
    sizes = lambda b: [r["n_edges"] for r in batch_sizes(b).orderBy("batch_id").collect()]
    assert sizes(batched(log, 2, "m")) == [5, 2, 2] and sizes(batched(log, 2, "m", drop_last=True)) == [5, 2]
    with pytest.raises(InvalidDiscretizationError):
        batched(log, 1, "s")
    with pytest.raises(EventOrderedConversionError):
        batched(EventLog(log.events), 1, "s")
    with pytest.raises(ValueError):
        batched(log, 0)


def test_empty_batches(spark):
    from tidegraph.errors import EmptyBatchError

    log = log_of(spark, [(2, 3, 1), (2, 3, 5)], delta="s")
    assert len(batched(log, 1, "s")) == 5
    assert len(list(batched(log, 1, "s"))) == 2 and len(list(batched(log, 1, "s", on_empty=None))) == 5
    with pytest.raises(EmptyBatchError):
        list(batched(log, 1, "s", on_empty="raise"))


def test_static_features_and_types_of_nodes(spark):
    edges = spark.createDataFrame([(0, 1, 1, [1.0, 2.0]), (1, 2, 2, [3.0, 4.0])], "src long, dst long, t long, edge_x array<float>")
    nodes = spark.createDataFrame([(0, [1.0, 2.0, 3.0], 7), (1, [4.0, 5.0, 6.0], None), (2, [7.0, 8.0, 9.0], 8)], "nid long, static_x array<float>, node_type int")
    log = EventLog.of(edges, nodes=nodes)
    assert {r["nid"]: r["static_x"][0] for r in log.static_features().collect()} == {0: 1.0, 1: 4.0, 2: 7.0}
    assert {r["nid"]: r["node_type"] for r in log.node_types().collect()} == {0: 7, 2: 8}
    assert log.dims == {"edge_x": 2, "x": None, "y": None, "static_x": 3}
    bare = EventLog.of(edges)
    assert bare.static_features().count() == bare.node_types().count() == 0 and bare.dims["static_x"] is None
