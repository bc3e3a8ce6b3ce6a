"""Operators on tiny graphs, and against sequential simulations on random ones."""

import random
from collections import defaultdict, deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegraph.operators import analytics, kernels, metrics, negatives, neighbors, predictors, tracking

E = "batch_id long, event_idx long, t long, src long, dst long, edge_x array<float>, kind int"


def edges_of(spark, triples, size):
    return spark.createDataFrame([(i // size, i, t, s, d, [float(i)], 0) for i, (s, d, t) in enumerate(triples)], E)


def lists(found, by="seed_id"):
    out = defaultdict(list)
    for r in sorted(found.collect(), key=lambda r: (r[by], r["slot"])):
        out[r[by]].append((r["nbr"], r["nbr_t"]))
    return dict(out)


def test_recent_basic(spark):
    edges = edges_of(spark, [(0, 1, 1), (0, 2, 2), (2, 3, 3), (2, 0, 4)], 1)
    got = lists(neighbors.recent(neighbors.link_seeds(edges), edges, 1))
    assert got == {2: [(1, 1)], 4: [(0, 2)], 6: [(3, 3)], 7: [(2, 2)]}


def test_recent_keeps_the_last(spark):
    edges = edges_of(spark, [(0, i, i - 1) for i in range(1, 21)], 2)
    got = lists(neighbors.recent(neighbors.link_seeds(edges), edges, 2))
    assert got[4] == [(1, 0), (2, 1)] and got[38] == [(17, 16), (18, 17)]


def test_evicted_entries_stay_out_of_sight_at_the_second_hop(spark):
    edges = edges_of(spark, [(0, 1, 1), (1, 2, 2), (3, 2, 3), (4, 2, 4), (5, 0, 5), (5, 2, 6)], 1)
    found = neighbors.hops(neighbors.link_seeds(edges), edges, [1, 1])
    second = [(r["batch_id"], r["node"], r["nbr"]) for r in found.where("hop = 1").collect()]
    assert all(b != 5 or n != 4 for b, n, _ in second)


@pytest.mark.parametrize("directed", [False, True])
def test_recent_equals_a_ring_buffer(spark, directed):
    rng = random.Random(3)
    triples, t = [], 0
    for _ in range(120):
        t += rng.choice([0, 0, 1, 2])
        triples.append((rng.randrange(8), rng.randrange(8), t))
    size, k, capacity = 7, 2, 4
    edges = edges_of(spark, triples, size)
    expected, buffers = {}, defaultdict(lambda: deque(maxlen=capacity))
    for b in range(0, len(triples), size):
        batch = list(enumerate(triples))[b : b + size]
        for i, (s, d, q) in batch:
            for role, node in enumerate((s, d)):
                if seen := [e for e in buffers[node] if e[1] < q][-k:]:
                    expected[2 * i + role] = seen
        entries = [(q, 0, i, s, d) for i, (s, d, q) in batch] + ([] if directed else [(q, 1, i, d, s) for i, (s, d, q) in batch])
        for q, _, _, node, nbr in sorted(entries):
            buffers[node].append((nbr, q))
    assert lists(neighbors.recent(neighbors.link_seeds(edges), edges, k, capacity, directed)) == expected


def test_batches_without_seeds_do_not_enter(spark):
    edges = edges_of(spark, [(0, 1, 1), (0, 2, 2), (0, 3, 3)], 1)
    eligible = spark.createDataFrame([(0,), (2,)], "batch_id long")
    assert lists(neighbors.recent(neighbors.link_seeds(edges), edges, 2, eligible=eligible))[4] == [(1, 1)]


def test_uniform_neighbors_are_earlier_ones(spark):
    triples = [(0, i, i) for i in range(1, 40)]
    edges = edges_of(spark, triples, 10)
    got = lists(neighbors.uniform(neighbors.link_seeds(edges), edges, 5))
    for seed, found in got.items():
        start = seed // 2 // 10 * 10 + 1
        assert len(found) == min(5, start - 1) and len(set(found)) == len(found) and all(t < start for _, t in found)
    assert got == lists(neighbors.uniform(neighbors.link_seeds(edges), edges, 5))


def test_historical_negatives(spark):
    triples = [(1, 5), (7, 6), (2, 8), (7, 8), (1, 7), (9, 10), (3, 10), (1, 9), (3, 11), (2, 10), (7, 2), (3, 5)]
    edges = edges_of(spark, [(s, d, i) for i, (s, d) in enumerate(triples)], 4)
    got = {r["event_idx"]: r["neg"] for r in negatives.historical_negatives(edges).collect()}
    assert [got[i] for i in range(8)] == [-1] * 4 + [5, -1, -1, 5]
    assert [got[8], got[9], got[11]] == [10, 8, 10] and got[10] in (6, 8)


def test_random_negatives(spark):
    edges = edges_of(spark, [(i, i + 1, i) for i in range(10)], 5)
    rows = negatives.random_negatives(edges, 3, 7, 0.6).collect()
    assert len(rows) == 6 and all(3 <= r["neg"] < 7 for r in rows)
    for bad in ((5, 5, 1.0), (-1, 5, 1.0), (0, 5, 0.0), (0, 5, 1.5)):
        with pytest.raises(ValueError):
            negatives.random_negatives(edges, *bad)


def test_seen_nodes(spark):
    rows = [(2, 3, 1, 0, None), (None, None, 2, 2, 4), (None, None, 3, 2, 2), (2, 5, 5, 0, None), (None, None, 5, 2, 5), (None, None, 5, 2, 1), (None, None, 5, 2, 2)]
    bounds = [0, 1, 2, 3, 3, 3, 3]
    events = spark.createDataFrame([(b, i, t, s, d, k, n) for i, (b, (s, d, t, k, n)) in enumerate(zip(bounds, rows, strict=True))], "batch_id long, event_idx long, t long, src long, dst long, kind int, nid long")
    got = sorted((r["batch_id"], r["position"], r["nid"]) for r in tracking.seen_nodes(events).collect())
    assert got == [(2, 0, 2), (3, 0, 5), (3, 2, 2)]


def test_batch_statistics(spark):
    rows = [(0, 0, 1, 1, 2, 0, None), (0, 1, 1, 1, 2, 0, None), (0, 2, 2, 2, 3, 0, None), (0, 3, 5, None, None, 1, 2), (0, 4, 5, None, None, 1, 2), (0, 5, 6, None, None, 1, 3)]
    events = spark.createDataFrame(rows, "batch_id long, event_idx long, t long, src long, dst long, kind int, nid long")
    assert tuple(analytics.batch_analytics(events).first())[1:] == (3, 3, 4, 3, 2.0, 1, 1)


def test_edgebank_forgets_what_left_the_window(spark):
    init = edges_of(spark, [(1, 2, 1), (2, 3, 2), (3, 4, 3), (4, 5, 6)], 10)
    later = spark.createDataFrame([(0, 4, 100, 7, 8, [0.0], 0)], E)
    ask = spark.createDataFrame([(b, s, d) for b in (0, 1) for s, d in ((1, 2), (4, 5), (7, 8))], "batch_id long, src long, dst long")
    got = {(r["batch_id"], r["src"]): r["score"] for r in predictors.edgebank(init, later, ask, "fixed", 0.5).collect()}
    assert got == {(0, 1): 0, (0, 4): 1, (0, 7): 0, (1, 1): 0, (1, 4): 0, (1, 7): 1}
    with pytest.raises(ValueError):
        predictors.edgebank(init, later, ask, "some")


@pytest.mark.parametrize("decay", [0.7, 1.0])
def test_poptrack_equals_the_recurrence(spark, decay):
    rng = random.Random(1)
    triples = [(0, rng.randrange(3), i) for i in range(40)]
    edges = edges_of(spark, triples, 4)
    init, later = edges.where("batch_id < 2"), edges.where("batch_id >= 2")
    ask = spark.createDataFrame([(b, d) for b in range(2, 10) for d in range(3)], "batch_id long, dst long")
    got = {(r["batch_id"], r["dst"]): r["score"] for r in predictors.poptrack(init, later, ask, decay).collect()}
    pop, expected = [0.0] * 3, {}
    for b, chunk in [(-1, triples[:8])] + [(b, triples[4 * b : 4 * b + 4]) for b in range(2, 10)]:
        if b >= 0:
            expected |= {(b, d): pop[d] for d in range(3)}
        for _, d, _ in chunk:
            pop[d] += 1
        pop = [p * decay for p in pop]
    assert got == pytest.approx(expected)


def test_walks_equal_dense_matrices(spark):
    import numpy as np

    rng = random.Random(5)
    triples = [(rng.randrange(5), rng.randrange(5), i) for i in range(24)]
    edges = edges_of(spark, triples, 6)
    decay, layers = 0.05, 3
    a, before = [np.eye(5), *(np.zeros((5, 5)) for _ in range(layers))], None
    for b in range(0, 24, 6):
        batch = triples[b : b + 6]
        top = max(t for *_, t in batch)
        gap = 0 if before is None else top - before
        a = [m * np.exp(-decay * gap * i) for i, m in enumerate(a)]
        for i in range(layers, 0, -1):
            gain = np.zeros((5, 5))
            for s, d, t in batch:
                w = np.exp(-decay * (top - t))
                gain[s] += a[i - 1][d] * w
                gain[d] += a[i - 1][s] * w
            a[i] = a[i] + gain
        before = top
    got = [np.zeros((5, 5)) for _ in range(layers + 1)]
    for r in kernels.walk_matrices(edges, layers, decay).collect():
        got[r["layer"]][r["node"], r["col"]] = r["val"]
    for x, y in zip(got[1:], a[1:], strict=True):
        np.testing.assert_allclose(x, y)


def test_gap_of_a_self_loop_is_counted_twice_from_before(spark):
    edges = edges_of(spark, [(1, 2, 3), (1, 1, 10)], 1)
    got = {r["role"]: (r["mean_gap"], r["std_gap"]) for r in analytics.gap_stats(edges, 0).collect()}
    assert got == {"src": (5.0, 2.0), "dst": (5.0, 2.0)}


def test_rank_ties(spark):
    scored = spark.createDataFrame([(1, 1.0, True), (1, 1.0, False), (1, 2.0, False), (1, 0.0, False)], "q long, score double, is_pos boolean")
    assert [metrics.mrr(scored, ["q"], tie).first()[0] for tie in ("optimistic", "average", "pessimistic")] == pytest.approx([1 / 2, 1 / 2.5, 1 / 3])


def test_spectral_moments_are_those_of_the_dense_matrix(spark):
    rng = random.Random(12)
    rows = [(b, 0, rng.randrange(6), rng.randrange(6)) for b in range(2) for _ in range(14)]  # self-loops and repeats too
    got = {(r["batch_id"], r["k"]): r["mu"] for r in analytics.spectral_moments(spark.createDataFrame(rows, "batch_id long, kind int, src long, dst long"), 9, 4, 3).collect()}
    signs = {(r["id"], r["p"]): r["s"] for r in spark.range(6).select("id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("p")).withColumn("s", analytics.probe_sign(F.col("id"), F.col("p"), 3)).collect()}
    for b in range(2):
        edges = [(s, d) for x, _, s, d in rows if x == b]
        nodes = sorted({n for e in edges for n in e})
        at = {n: i for i, n in enumerate(nodes)}
        a = np.zeros((len(nodes), len(nodes)))
        for s, d in edges:
            a[at[s], at[d]] += 1
            a[at[d], at[s]] += 1
        degree = a.sum(axis=1)
        m = -a / np.sqrt(np.outer(degree, degree))
        z = np.array([[signs[n, p] for p in range(4)] for n in nodes])
        t = [z, m @ z]
        while len(t) < 9:
            t.append(2 * m @ t[-1] - t[-2])
        for k in range(9):
            assert got[b, k] == pytest.approx((z * t[k]).sum() / z.size)


def test_spectral_density_adds_up(spark):
    edges = edges_of(spark, [(i, (i + 1) % 12, i) for i in range(12)], 12)
    assert sum(r["density"] for r in analytics.spectral_density(edges).collect()) == pytest.approx(1.0, abs=0.05)


def test_common_neighbors_of_every_batch_see_the_batches_before(spark):
    rng = random.Random(7)
    triples, size = [(rng.randrange(6), rng.randrange(6), i) for i in range(40)], 8
    edges = edges_of(spark, triples, size)
    asked = [(i, i // size, s, (s * 7 + 1) % 6) for i, (s, _, _) in enumerate(triples)]
    pairs = spark.createDataFrame(asked, "pair_id long, batch_id long, i long, j long")
    expected = {}
    for pair, batch, i, j in asked:
        adj = defaultdict(lambda: defaultdict(float))
        for s, d, _ in triples[: batch * size]:
            adj[s][d] += 1
            adj[d][s] += 1
        two = {}
        for x in (i, j):
            two[x] = defaultdict(float)
            for m, w in adj[x].items():
                for v, a in adj[m].items():
                    if not {m, v} & {i, j}:
                        two[x][v] += w * a
        for order, a, b in (("1-1", adj[i], adj[j]), ("0-1", {i: 1}, adj[j]), ("1-0", adj[i], {j: 1}), ("1-2", adj[i], two[j]), ("2-1", two[i], adj[j]), ("2-2", two[i], two[j])):
            expected |= {(pair, order, v): a[v] * b[v] for v in a if v in b and (order[:1] + order[2:] in ("11", "01", "10") or v not in (i, j))}
    got = kernels.common_neighbors(pairs, edges, 8, before=True).collect()
    assert {(r["pair_id"], r["order"], r["nbr"]): r["weight"] for r in got} == expected and len(got) == len(expected)
    assert {p // size for p, _, _ in expected} == {1, 2, 3, 4}


@pytest.mark.parametrize("layers", [1, 2, 3])
def test_walk_matrices_equal_the_fold_over_all_batches(spark, layers):
    rng = random.Random(9)
    triples = [(rng.randrange(5), rng.randrange(5), 3 * i) for i in range(30)]
    decay, state, before = 0.02, {(0, x, x): 1.0 for x in range(5)}, None
    for b in range(0, 30, 3):
        batch = triples[b : b + 3]
        top = max(t for *_, t in batch)
        gap = 0 if before is None else top - before
        old = {(i, u, c): v * 2.718281828459045 ** (-decay * gap * i) for (i, u, c), v in state.items()}
        state, before = defaultdict(float, old), top
        for s, d, t in batch:
            for u, m in ((s, d), (d, s)):
                for (i, node, c), v in old.items():
                    if node == m and i < layers:
                        state[i + 1, u, c] += v * 2.718281828459045 ** (-decay * (top - t))
    got = {(r["layer"], r["node"], r["col"]): r["val"] for r in kernels.walk_matrices(edges_of(spark, triples, 3), layers, decay).where("layer > 0").collect()}
    assert got == pytest.approx({k: v for k, v in state.items() if k[0] > 0})


def test_scalar_and_vector_functions(spark):
    from pyspark.sql import functions as F

    from tidegraph.functions import scalar

    row = spark.createDataFrame([([1.0, 2.0, 3.0], [True, True, False], [1, 2, 3])], "a array<double>, ok array<boolean>, n array<int>").select(
        scalar.softmax(F.col("a")).alias("soft"), scalar.softmax(F.col("a"), F.col("ok")).alias("masked"), scalar.vector_sum(F.col("a"), F.col("a")).alias("sum"), scalar.dot(F.col("a"), F.col("a")).alias("dot"),
        *(f(F.col("n"), k, F.lit(-1)).alias(f"{f.__name__}{k}") for f in (scalar.pad_left, scalar.pad_right) for k in (2, 5)),
        kernels.merge(F.col("a"), F.col("a")).alias("concat"), kernels.merge(F.col("a"), F.col("a"), "sum", (2.0, 1.0)).alias("weighted"), kernels.patches(F.col("n"), 2).alias("patches"),
    ).first()
    total = sum(2.718281828459045**x for x in (1, 2, 3))
    assert row["soft"] == pytest.approx([2.718281828459045**x / total for x in (1, 2, 3)])
    assert row["masked"] == pytest.approx([1 / (1 + 2.718281828459045), 2.718281828459045 / (1 + 2.718281828459045), 0.0])
    assert row["sum"] == [2.0, 4.0, 6.0] and row["dot"] == 14.0 and row["concat"] == [1.0, 2.0, 3.0] * 2 and row["weighted"] == [3.0, 6.0, 9.0]
    assert (row["pad_left2"], row["pad_left5"], row["pad_right2"], row["pad_right5"]) == ([2, 3], [-1, -1, 1, 2, 3], [1, 2], [1, 2, 3, -1, -1])
    assert row["patches"] == [[1, 2], [3]] and scalar.pretty_number(1500) == "1.5K"


def test_pair_features_of_walks(spark):
    state = spark.createDataFrame([(0, 1, 1, 1.0), (1, 1, 2, 0.5), (0, 2, 2, 1.0), (1, 2, 1, -2.0)], "layer int, node long, col long, val double")
    pairs = spark.createDataFrame([(7, 1, 2)], "pair_id long, i long, j long")
    got = {(r["li"], r["lj"]): r["value"] for r in kernels.walk_features(pairs, state).collect()}
    assert got == pytest.approx({(0, 1): 0.0, (1, 0): 0.4054651081081644})  # log(1 + relu(-2)), log(1 + 0.5)


def test_places_of_ids(spark):
    ids = spark.createDataFrame([(0, 5), (0, 3), (0, -1), (1, 5)], "batch_id long, nid long")
    got = tracking.global_to_local(ids, tracking.local_ids(ids)).collect()
    assert sorted((r["batch_id"], r["nid"], r["local_id"]) for r in got if r["nid"] >= 0) == [(0, 3, 0), (0, 5, 1), (1, 5, 0)] and [r["local_id"] for r in got if r["nid"] < 0] == [None]


def test_a_hub_is_numbered_in_parts(spark):
    from tidegraph.functions import ranking

    rows = spark.createDataFrame([("hub" if i % 5 else "x", i // 3, i) for i in range(60)], "k string, step long, o long")
    got = {r["o"]: r["n"] for r in ranking.numbered(rows, ["k"], "step", ["o"], "n", bits=2).collect()}
    expected, seen = {}, defaultdict(int)
    for i in range(60):
        seen["hub" if i % 5 else "x"] += 1
        expected[i] = seen["hub" if i % 5 else "x"]
    assert got == expected
    asked = spark.createDataFrame([("hub", s) for s in range(25)] + [("no", 3)], "k string, step long")
    before = {(r["k"], r["step"]): r["c"] for r in ranking.count_before(rows, asked, ["k"], "step", "c", bits=2).collect()}
    assert before == {("hub", s): sum(1 for i in range(60) if i % 5 and i // 3 < s) for s in range(25)} | {("no", 3): 0}


def test_listed_negatives_by_type(spark):
    edges = spark.createDataFrame([(0, 1, 2, 5, 0), (1, 1, 2, 5, 1), (2, 1, 2, 5, 2)], "event_idx long, src long, dst long, t long, edge_type int")
    table = spark.createDataFrame([(1, 2, 5, 0, [7]), (1, 2, 5, 1, [8, 9])], "src long, dst long, t long, edge_type int, negs array<long>")
    got = {r["event_idx"]: r["negs"] for r in negatives.listed_negatives(edges, table, typed=True).collect()}
    assert got == {0: [7], 1: [8, 9], 2: None}


def test_hyperbolic_tangent(spark):
    from tidegraph.functions.scalar import tanh

    got = [r[0] for r in spark.createDataFrame([(-2.0,), (0.0,), (0.5,)], "x double").select(tanh(F.col("x"))).collect()]
    assert got == pytest.approx([np.tanh(v) for v in (-2.0, 0.0, 0.5)])
