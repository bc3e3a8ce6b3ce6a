import random

import pytest

from tidegraph.errors import BadOperatorProtocolError, UndefinedRecipeError, UnresolvableOperatorDependenciesError
from tidegraph.operators import negatives
from tidegraph.plans import library, recipes, registry
from tidegraph.plans.pipeline import Pipeline, ordered
from tidegraph.plans.protocol import BaseOperator, BatchFrame


class Makes(BaseOperator):
    def __init__(self, needs=(), makes=(), id=None):
        super().__init__(id)
        self.requires, self.produces = set(needs), {self.name(m) for m in makes}

    def apply(self, frame):
        return frame.with_table("order", [*frame.tables.get("order", []), self])


def test_order_follows_needs():
    a, b, c = Makes(["y"], ["z"]), Makes(["x"], ["y"]), Makes(["edge_src"], ["x"])
    assert ordered([a, b, c]) == [c, b, a]


def test_negatives_come_before_neighbours():
    n, s = Makes(makes=["nbr_nids"]), Makes(makes=["neg"])
    assert ordered([n, s]) == [s, n]
    assert ordered([n, Makes(makes=["neg"], id="b")])[0] is n


def test_missing_and_circular_needs():
    with pytest.raises(UnresolvableOperatorDependenciesError, match="each other"):
        ordered([Makes(["a"], ["b"]), Makes(["b"], ["a"])])
    with pytest.raises(UnresolvableOperatorDependenciesError, match="SeenNodes"):
        ordered([Makes(["seen_nodes"])])
    with pytest.raises(UnresolvableOperatorDependenciesError, match="unique_nids"):
        ordered([Makes(["uniqe_nids"])])


def test_pipeline_keys_and_errors():
    with pytest.raises(ValueError):
        Pipeline([])
    p = Pipeline(["train", "val"])
    with pytest.raises(RuntimeError):
        p.execute(BatchFrame(None))
    with pytest.raises(KeyError):
        p.register("test", Makes())
    with pytest.raises(BadOperatorProtocolError):
        p.register_shared(object())
    shared, own = Makes(makes=["a"]), Makes(["a"])
    p.register("train", own)
    p.register_shared(shared)
    p.set_active("val")
    with p.activate("train"):
        with pytest.raises(RuntimeError):
            p.register("train", Makes())
        assert p.execute(BatchFrame(None))["order"] == [shared, own]
    assert "val (active)" in str(p) and p.execute(BatchFrame(None))["order"] == [shared]
    with pytest.raises(UnresolvableOperatorDependenciesError):
        p.validate_requirement("val", {"nothing"})


def test_registry_keeps_order():
    names = [c.__name__ for c in registry.list_operators()]
    assert names[:2] == ["RandomNegatives", "HistoricalNegatives"] and "NodeAnalytics" in names


def test_suffixed_names():
    assert library.SeenNodes(id="b").produces == {"seen_nodes_b", "batch_nodes_mask_b"}


def test_recipe(spark):
    from tidegraph.frame import EventLog

    edges = spark.createDataFrame([(i % 4, 10 + i % 3, i, i) for i in range(12)], "src long, dst long, t long, o long")
    log = EventLog.of(edges, order={0: ["o"]})
    prepared = edges.select("src", "dst", "t").selectExpr("src", "dst", "t", "array(10L, 12L) AS negs")
    pipeline = recipes.build(recipes.LINK_PREDICTION, train=log, negatives=prepared)
    pipeline.register_shared(library.RecentNeighbors([2], ["neg"]))
    pipeline.register_shared(library.Deduplication(["nbr_nids", "neg"]))
    frame = BatchFrame(log.events.selectExpr("*", "event_idx div 4 AS batch_id"))
    for key in ("train", "val"):
        with pipeline.activate(key) as p:
            out = p.execute(frame)
        assert out["neg"].count() > 0 and out["nbr_nids"].count() > 0 and out["unique_nids"].count() > 0
        assert all(10 <= r["neg"] <= 12 for r in out["neg"].collect())
    with pytest.raises(UndefinedRecipeError):
        recipes.build("nothing")


def frame_of(spark, triples, size, labels=()):
    rows = [(i, i // size, t, 0, s, d, None) for i, (s, d, t) in enumerate(triples)] + [(1000 + i, b, t, 2, None, None, n) for i, (n, b, t) in enumerate(labels)]
    return BatchFrame(spark.createDataFrame(rows, "event_idx long, batch_id long, t long, kind int, src long, dst long, nid long").selectExpr("*", "cast(null as array<float>) AS edge_x"))


TRIPLES = [(1, 2, 0), (2, 3, 1), (1, 3, 2), (3, 4, 3), (2, 4, 4), (1, 4, 5)]


def neighbours(out):
    return sorted((r["seed_id"], r["nbr"]) for r in out["nbr_nids"].select("seed_id", "nbr").collect())


def test_state_is_carried_from_one_iteration_to_the_next_until_reset(spark):
    ops = lambda: (library.RecentNeighbors([2]), library.SeenNodes(), library.HistoricalNegatives())
    together = ops()
    whole = frame_of(spark, TRIPLES, 1, [(2, 5, 5), (9, 5, 5)])
    parts = [BatchFrame(whole.events.where("batch_id < 2")), BatchFrame(whole.events.where("batch_id BETWEEN 2 AND 3").selectExpr("* EXCEPT (batch_id)", "batch_id - 2 AS batch_id")), BatchFrame(whole.events.where("batch_id > 3").selectExpr("* EXCEPT (batch_id)", "batch_id - 4 AS batch_id"))]
    expected, carried = neighbours(together[0].apply(whole)), ops()
    found = [n for part in parts for n in neighbours(carried[0].apply(part))]
    assert sorted(found) == expected and len(expected) > 6
    carried[0].reset_state()
    assert neighbours(carried[0].apply(parts[2])) == neighbours(ops()[0].apply(parts[2])) != [n for n in expected if n[0] >= 8]
    seen = [sorted(r["nid"] for r in carried[1].apply(part)["seen_nodes"].collect()) for part in parts]
    assert seen == [[], [], [2]] == [[], [], sorted(r["nid"] for r in together[1].apply(whole)["seen_nodes"].collect())]
    past = [{r["src"]: r["valid"] for r in carried[2].apply(part)["valid_neg_mask"].collect()} for part in parts]
    assert past == [{1: False, 2: False}, {1: True, 3: False}, {1: True, 2: True}]


def iterations(spark, n, size=30):
    rng = random.Random(6)
    for i in range(n):
        rows, t = [], 100 * i
        for e in range(size):
            t += rng.randrange(3)
            kind = rng.choice([0, 0, 0, 0, 1, 2])
            src, dst = (rng.randrange(6), rng.randrange(6)) if kind == 0 else (None, None)
            rows.append((size * i + e, e // 5, t, kind, src, dst, None if kind == 0 else rng.randrange(8), [1.0] if kind == 0 else None, [2.0] if kind == 1 else None))
        yield BatchFrame(spark.createDataFrame(rows, "event_idx long, batch_id long, t long, kind int, src long, dst long, nid long, edge_x array<float>, x array<float>"))


def test_node_figures_are_carried_over(spark):
    parts = list(iterations(spark, 3))
    whole = None
    for i, part in enumerate(parts):
        events = part.events.selectExpr("* EXCEPT (batch_id)", f"batch_id + {6 * i} AS batch_id")
        whole = events if whole is None else whole.unionByName(events)
    tracked = spark.range(6).withColumnRenamed("id", "nid")
    together, carried = library.NodeAnalytics(tracked).apply(BatchFrame(whole)), library.NodeAnalytics(tracked)
    found = {}
    for i, part in enumerate(parts):
        out = carried.apply(part)
        for name in ("node_stats", "node_macro_stats", "edge_stats"):
            found.setdefault(name, []).extend({**r.asDict(), "batch_id": r["batch_id"] + 6 * i} for r in out[name].collect())
    by_all = lambda rows: sorted(rows, key=lambda r: sorted(r.items()))
    for name, rows in found.items():
        assert len(rows) > 9 and by_all(rows) == by_all([r.asDict() for r in together[name].collect()])


def test_historical_draws_are_of_all_earlier_edges(spark):
    op = library.HistoricalNegatives()
    past = set()
    for part in iterations(spark, 3):
        out = {(r["batch_id"], r["event_idx"]): (r["src"], r["neg"], r["valid"]) for r in op.apply(part)["neg"].collect()}
        edges = part.events.where("kind = 0").select("batch_id", "event_idx", "src", "dst").collect()
        for r in edges:
            src, neg, valid = out[r["batch_id"], r["event_idx"]]
            seen = {d for s, d in past if s == src} | {e["dst"] for e in edges if e["src"] == src and e["batch_id"] < r["batch_id"]}
            assert (neg in seen and valid) if seen else (neg, valid) == (-1, False)
        past |= {(e["src"], e["dst"]) for e in edges}


def test_draws_among_counts(spark):
    counts = spark.createDataFrame([(1, 5, 2), (1, 9, 3), (2, 7, 1)], "src long, dst long, n long")
    draws = spark.createDataFrame([(1, b, b) for b in range(1, 6)] + [(2, 1, 1)], "src long, batch_id long, ord long")
    got = {(r["src"], r["batch_id"]): r["neg"] for r in negatives._among(draws, counts).collect()}
    assert got == {(1, 1): 5, (1, 2): 5, (1, 3): 9, (1, 4): 9, (1, 5): 9, (2, 1): 7}


def plan_size(out, names):
    return sum(len(out[n]._jdf.queryExecution().optimizedPlan().toString().splitlines()) for n in names)


def test_plans_and_state_do_not_grow_with_iterations(spark):
    part = next(iterations(spark, 1))
    tracked = spark.range(6).withColumnRenamed("id", "nid")
    for op, names in ((library.RecentNeighbors([2]), ["nbr_nids"]), (library.SeenNodes(), ["seen_nodes"]), (library.HistoricalNegatives(), ["neg"]), (library.NodeAnalytics(tracked), ["node_stats", "edge_stats", "node_macro_stats"])):
        sizes, rows = [], []
        for _ in range(10):
            sizes.append(plan_size(op.apply(part), names))
            rows.append(sum(t.count() for t in op.state().values()))
        # the first has no state; from the second on the same is read
        assert len(set(sizes[1:])) == 1 and len(set(rows)) == 1, (type(op).__name__, sizes, rows)
        op.reset_state()
        assert plan_size(op.apply(part), names) == sizes[0]


def test_seeds_of_any_key(spark):
    frame = frame_of(spark, TRIPLES, 2, [(3, 1, 3), (3, 2, 5)])
    out = library.RecentNeighbors([2], ["node_y_nids"]).apply(frame)
    got = {(r["batch_id"], r["node"], r["nbr"]) for r in out["nbr_nids"].collect()}
    # batch 0 has no seeds, so its edges are in no buffer
    assert got == {(2, 3, 1), (2, 3, 4)}
    seeds = frame.with_table("mine", spark.createDataFrame([(2, 4, 9), (2, 4, 9), (2, -1, 9)], "batch_id long, node long, q long"))
    out = library.RecentNeighbors([3], ["edge_src", "mine"]).apply(seeds)
    assert sorted((r["node"], r["nbr"]) for r in out["nbr_nids"].where("seed_id < 0").collect()) == [(4, 3), (4, 3)]
    mask = out["seed_node_nbr_mask"].where("batch_id = 2").collect()
    assert sorted((r["key"], r["position"]) for r in mask) == [("edge_src", 0), ("edge_src", 1), ("mine", 2), ("mine", 3)]


@pytest.mark.parametrize("rows,schema", [([(0, 1)], "batch_id long, node long"), ([(0, 1.5, 1)], "batch_id long, node double, q long"), ([(0, [1], 1)], "batch_id long, node array<long>, q long")])
def test_seeds_that_are_no_seeds(spark, rows, schema):
    frame = frame_of(spark, TRIPLES, 2).with_table("mine", spark.createDataFrame(rows, schema))
    with pytest.raises(ValueError):
        library.RecentNeighbors([2], ["mine"]).apply(frame)


def test_missing_and_bad_seeds(spark):
    frame = frame_of(spark, TRIPLES, 2)
    with pytest.raises(ValueError, match="nowhere"):
        library.RecentNeighbors([2], ["nowhere"]).apply(frame)
    with pytest.warns(UserWarning, match="mine"):
        out = library.RecentNeighbors([2], ["edge_src", "mine"]).apply(frame.with_table("mine", None))
    assert out["nbr_nids"].count() > 0
    for node, q in ((-2, 1), (1, -1)):
        bad = frame.with_table("mine", spark.createDataFrame([(1, node, q)], "batch_id long, node long, q long"))
        with pytest.raises(Exception, match="seed"):
            library.RecentNeighbors([2], ["mine"]).apply(bad)["seed_nids"].collect()


def test_operators_make_what_they_promise(spark):
    frame = frame_of(spark, TRIPLES, 2, [(3, 1, 3)])
    frame = BatchFrame(frame.events.selectExpr("*", "cast(null as array<float>) AS x"))
    prepared = spark.createDataFrame([(1, 2, 0, [4])], "src long, dst long, t long, negs array<long>")
    for op in (library.RandomNegatives(0, 5, id="r"), library.HistoricalNegatives("h"), library.ListedNegatives(prepared), library.RecentNeighbors([1, 2], id="n"), library.UniformNeighbors(2), library.Deduplication(["neg"]), library.SeenNodes(), library.BatchAnalytics(), library.NodeAnalytics(spark.range(5).withColumnRenamed("id", "nid"))):
        frame = op.apply(frame)
        assert op.produces <= set(frame.tables), type(op)
