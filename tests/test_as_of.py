"""Matrices as they were before a batch, walks and their projections, against brute force."""

import math
import os
import random
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidegraph.functions import blocks
from tidegraph.operators import kernels


def edges_of(spark, n=120, nodes=9, size=5, seed=3):
    rng = random.Random(seed)
    rows = [(i // size, i, 7 * i, rng.randrange(nodes), 4 + rng.randrange(nodes)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "batch_id long, event_idx long, t long, src long, dst long")


def before(rows, batch):
    adj = defaultdict(Counter)
    for b, _, _, s, d in rows:
        if b < batch:
            adj[s][d] += 1
            adj[d][s] += 1
    return adj


def test_rows_are_those_before_the_batch(spark):
    rows, frame = edges_of(spark)
    asked = [(b, u) for b in (0, 1, 2, 7, 8, 15, 16, 23, 24) for u in range(14)]
    matrix = kernels.AsOf(kernels.both_directions(frame))
    got = defaultdict(dict)
    for r in matrix.rows(spark.createDataFrame(asked * 2, "batch_id long, u long")).collect():
        assert r["v"] not in got[r["batch_id"], r["u"]]
        got[r["batch_id"], r["u"]][r["v"]] = r["a"]
    for b, u in asked:
        assert got[b, u] == dict(before(rows, b)[u]), (b, u)


def test_versions_are_cut_into_few_intervals(spark):
    one = spark.createDataFrame([(0, 1, 2, 1.0), (600, 1, 2, 1.0), (1000, 1, 2, 1.0)], "batch_id long, u long, v long, w double")
    assert kernels.AsOf(one).entries.count() <= 3 * 2 * 11


def brute_common(rows, pairs, k):
    out = {}
    for pair, b, i, j in pairs:
        adj = before(rows, b)
        one = {e: dict(adj[e]) for e in (i, j)}
        two = {}
        for e in (i, j):
            paths = Counter()
            for x, w in one[e].items():
                if x not in (i, j):
                    for v, a in adj[x].items():
                        if v not in (i, j):
                            paths[v] += w * a
            two[e] = paths
        for n in set(adj) | {i, j}:
            inside = n in (i, j)
            found = {"1-1": one[i].get(n, 0) * one[j].get(n, 0)}
            if k >= 4:
                found |= {"0-1": one[j].get(n, 0) * (n == i), "1-0": one[i].get(n, 0) * (n == j)}
            if k == 8 and not inside:
                found |= {"1-2": one[i].get(n, 0) * two[j][n], "2-1": two[i][n] * one[j].get(n, 0), "2-2": two[i][n] * two[j][n]}
            out |= {(pair, o, n): float(w) for o, w in found.items() if w}
    return out


@pytest.mark.parametrize("k", [2, 4, 8])
def test_common_neighbours(spark, k):
    rows, frame = edges_of(spark)
    pairs = [(i, r[0], r[3], r[4]) for i, r in enumerate(rows)] + [(900, 10, 3, 3), (901, 12, 50, 2)]
    pairs = [p for p in pairs if p[2] != p[3]]
    got = kernels.common_neighbors(spark.createDataFrame(pairs, "pair_id long, batch_id long, i long, j long"), frame, k, before=True)
    expected = brute_common(rows, pairs, k)
    assert {(r["pair_id"], r["order"], r["nbr"]): r["weight"] for r in got.collect()} == expected
    if k == 8:
        sums = kernels.common_neighbor_sums(spark.createDataFrame(pairs, "pair_id long, batch_id long, i long, j long"), frame, F.col("nbr") % 10)
        by = Counter()
        for (p, o, n), w in expected.items():
            by[p, o] += w * (n % 10)
        assert {(r["pair_id"], r["order"]): r["value"] for r in sums.collect()} == {x: by[x] for x in {(p, o) for p, o, _ in expected}}
        assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"


@pytest.fixture
def kept_rows(monkeypatch):
    """Rows of each table that the kernels write."""
    counts, keep = [], kernels.keep

    def counted(df, label, *args):
        kept = keep(df, label, *args)
        counts.append(kept.count())
        return kept

    monkeypatch.setattr(kernels, "keep", counted)
    return counts


def test_sums_write_no_rows_of_hubs_for_each_batch(spark, kept_rows, monkeypatch):
    monkeypatch.setattr(kernels, "NODES", 20)  # several blocks of nodes, several spans
    monkeypatch.setattr(kernels, "PAIRS", 7)
    rows = [(b, b, 7 * b, b % 50, 1000 + b % 2) for b in range(150)]  # two hubs, each next to half of all others
    frame = spark.createDataFrame(rows, "batch_id long, event_idx long, t long, src long, dst long")
    pairs = [(b, b, b % 50, (b + 4) % 50) for b in range(150)]
    found = kernels.common_neighbor_sums(spark.createDataFrame(pairs, "pair_id long, batch_id long, i long, j long"), frame, F.col("nbr") % 10)
    expected, there = Counter(), set()
    for (p, o, n), w in brute_common(rows, pairs, 8).items():
        expected[p, o] += w * (n % 10)
        there.add((p, o))
    assert {(r["pair_id"], r["order"]): r["value"] for r in found.collect()} == {x: expected[x] for x in there}
    assert sum(kept_rows) < 2 * len(rows) * 2 * 9  # entries times levels; the rows of the hubs before every batch are 150 times 25 and more


def test_common_neighbours_write_no_rows_of_hubs_for_each_batch(spark, kept_rows, monkeypatch):
    monkeypatch.setattr(kernels, "NODES", 20)
    monkeypatch.setattr(kernels, "PAIRS", 7)
    rows = [(b, b, 7 * b, b % 50, 1000 + b % 2) for b in range(150)] + [(60 + b, 150 + b, 7 * b, b, b + b % 2) for b in range(50)]  # links among users, and loops
    frame = spark.createDataFrame(rows, "batch_id long, event_idx long, t long, src long, dst long")
    pairs = [(b, b, b % 50, (b + 3) % 50) for b in range(150)] + [(150, 140, 1000, 1001), (151, 140, 8, 1000), (152, 0, 1, 2), (153, 149, 900, 901)]
    found = kernels.common_neighbors(spark.createDataFrame(pairs, "pair_id long, batch_id long, i long, j long"), frame, 8, before=True).collect()
    expected = brute_common(rows, pairs, 8)
    assert {(r["pair_id"], r["order"], r["nbr"]): r["weight"] for r in found} == expected and len(found) == len(expected)
    assert {o for _, o, _ in expected} == {*blocks.ORDERS}
    assert sum(kept_rows) < 2 * len(rows) * 2 * 9


def test_blocks_get_the_edges_of_ends_and_no_rows_as_of_a_batch(spark, monkeypatch):
    def count(write):
        def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kind, span = blocks.columns(batches, ["kind", "span"])
            yield pa.RecordBatch.from_arrays([pa.array([int((kind == 1).sum())]), pa.array([0], pa.int32()), pa.array([int(span[0])]), pa.array([0.0])], ["pair_id", "place", "nbr", "weight"])

        return block

    monkeypatch.setattr(blocks, "on_pairs", count)
    monkeypatch.setattr(kernels, "NODES", 20)
    monkeypatch.setattr(kernels, "PAIRS", 15)
    rows = [(0, m, 0, m % 2, 1000 + m // 2) for m in range(80)] + [(b, 80 + b, b, 0, 1000) for b in range(1, 60)]  # 0 and 1 have 40 neighbours from the first batch on
    frame = spark.createDataFrame(rows, "batch_id long, event_idx long, t long, src long, dst long")
    pairs = spark.createDataFrame([(b, b, 0, 1) for b in range(60)], "pair_id long, batch_id long, i long, j long")
    near = kernels.common_neighbors(pairs, frame, 8, before=True).toPandas()
    spans, blocks_of = near["nbr"].nunique(), (near["nbr"] == near["nbr"][0]).sum()
    assert spans > 1 and blocks_of == 3
    # of every span the neighbours at its start, and the edges in it; rows as of its batches are 60 times 80, for each block
    assert 0 < near["pair_id"].sum() <= blocks_of * (spans * 80 + 60)


def test_products_of_a_block_are_bounded_and_repeats_add_up():
    rng = np.random.default_rng(5)
    users, items, n = 3000, 40, 9000
    e = [rng.integers(0, 4, n), rng.integers(0, users, n), users + rng.integers(0, items, n), rng.integers(1, 3, n).astype(float)]  # batch, user, item, weight
    pairs = [np.full(200, 3), rng.integers(0, users, 200), rng.integers(0, users, 200), np.arange(200)]
    pairs[2] = np.where(pairs[1] == pairs[2], (pairs[2] + 1) % users, pairs[2])
    flag, x = np.ones(n, np.int64), (e[1] % 10).astype(float)
    near, edges = [*e, 1 - flag, 0 * x], [e[0], e[2], e[1], e[3], x]  # the block has all users and no item
    adj = np.zeros((users, items))
    np.add.at(adj, (e[1][e[0] < 3], e[2][e[0] < 3] - users), e[3][e[0] < 3])
    met = 0
    for ids, products, nodes, values in blocks.meetings(pairs, near, [c[e[0] < 3] for c in edges]):
        assert all(p.size <= 1 << 18 for p in products)
        i, j = pairs[1][ids], pairs[2][ids]
        expected = (adj[i] @ adj[nodes].T) * (adj[j] @ adj[nodes].T) * (nodes != i[:, None]) * (nodes != j[:, None])
        assert np.array_equal(products[5], expected) and not any(p.any() for p in products[:5]) and np.array_equal(values, nodes % 10)
        met += len(ids)
    assert met == 200


def brute_walks(rows, layers, decay):
    end = max(r[2] for r in rows)
    state = [defaultdict(Counter) for _ in range(layers + 1)]
    for u in {x for r in rows for x in r[3:]}:
        state[0][u][u] = 1.0
    for b in sorted({r[0] for r in rows}):
        gains = [defaultdict(Counter) for _ in range(layers + 1)]
        for batch, _, t, s, d in rows:
            if batch == b:
                for layer in range(1, layers + 1):
                    for u, v in ((s, d), (d, s)):
                        for col, val in state[layer - 1][v].items():
                            gains[layer][u][col] += math.exp(-decay * (end - t)) * val
        for layer in range(1, layers + 1):
            for u, row in gains[layer].items():
                state[layer][u].update(row)
    return state


def test_walk_matrices_of_three_layers(spark):
    rows, frame = edges_of(spark, 60)
    state = brute_walks(rows, 3, 1e-3)
    got = defaultdict(dict)
    for r in kernels.walk_matrices(frame, 3, 1e-3).collect():
        got[r["layer"], r["node"]][r["col"]] = r["val"]
    for layer in range(4):
        for node, row in state[layer].items():
            assert got[layer, node] == pytest.approx(dict(row)), (layer, node)


def test_walks_of_the_last_layer_are_not_written(spark, kept_rows):
    rows = [(b, b, 7 * b, b % 50, 1000 + b % 2) for b in range(150)]
    frame = spark.createDataFrame(rows, "batch_id long, event_idx long, t long, src long, dst long")
    state = brute_walks(rows, 2, 1e-3)
    found = kernels.walk_matrices(frame, 2, 1e-3)
    got = {(r["layer"], r["node"], r["col"]): r["val"] for r in found.collect()}
    assert got == pytest.approx({(n, u, c): v for n in range(3) for u, row in enumerated(state[n]) for c, v in row.items()})
    assert sum(kept_rows) == 2 * len(rows)  # the steps alone; versions of rows as of batches were more


def written_files(spark):
    """Shuffle files of the session."""
    return {f for f in spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n") if f.endswith(".data")}


def test_steps_are_sent_to_blocks_in_few_bytes(spark):
    rng = random.Random(4)
    rows = [(i // 200, i, 40 * i, rng.randrange(1000), 10_000 + rng.randrange(20)) for i in range(20_000)]
    frame = spark.createDataFrame(rows, "batch_id long, event_idx long, t long, src long, dst long")
    earlier = written_files(spark)
    spread = kernels.walk_matrices(frame, 2).where("layer > 0").groupBy("layer").agg(F.count("*").alias("n"), F.sum("val").alias("val"))
    found = {r["layer"]: (r["n"], r["val"]) for r in spread.collect()}
    assert sum(os.path.getsize(f) for f in written_files(spark) - earlier) < 100 * 2 * len(rows)  # as rows, sent to blocks of both ends, they took more
    end = rows[-1][2]
    steps = defaultdict(lambda: np.zeros((100, 2)))  # of a node, of each batch: weights in all, which are those out of it and those into it
    for b, _, t, s, d in rows:
        for u in (s, d):
            steps[u][b] += math.exp(-1e-6 * (end - t))
    paths = sum((w[1:, 0] * np.cumsum(w[:-1, 1])).sum() for w in steps.values())  # over every middle: steps in, times earlier steps out
    assert found[1] == pytest.approx((len({(s, d) for *_, s, d in rows}) * 2, 2 * sum(math.exp(-1e-6 * (end - r[2])) for r in rows)))
    assert found[2][1] == pytest.approx(paths)


def test_edges_are_sent_to_blocks_of_sums_in_few_bytes(spark):
    rng = random.Random(6)
    rows = [(i // 200, i, 40 * i, rng.randrange(1000), 10_000 + rng.randrange(20)) for i in range(20_000)]
    frame = spark.createDataFrame(rows, "batch_id long, event_idx long, t long, src long, dst long")
    pairs = frame.select(F.col("event_idx").alias("pair_id"), "batch_id", F.col("src").alias("i"), F.col("dst").alias("j"))
    earlier = written_files(spark)
    assert kernels.common_neighbor_sums(pairs, frame, F.col("nbr") % 10).agg(F.count("*")).first()[0] > len(rows)
    assert sum(os.path.getsize(f) for f in written_files(spark) - earlier) < 200 * len(rows)


def test_edges_are_sent_to_blocks_of_rows_in_few_bytes(spark):
    rng = random.Random(7)
    rows = [(i // 20, i, 40 * i, rng.randrange(300), 10_000 + rng.randrange(20)) for i in range(2000)]
    frame = spark.createDataFrame(rows, "batch_id long, event_idx long, t long, src long, dst long")
    pairs = frame.select(F.col("event_idx").alias("pair_id"), "batch_id", F.col("src").alias("i"), F.col("dst").alias("j"))
    earlier = written_files(spark)
    found = kernels.common_neighbors(pairs, frame, 8, before=True).agg(F.count("*"), F.sum("weight")).first()
    expected = brute_common(rows, [(i, b, s, d) for b, i, _, s, d in rows], 8)
    assert tuple(found) == (len(expected), sum(expected.values()))
    assert sum(os.path.getsize(f) for f in written_files(spark) - earlier) < 150 * len(rows)


@pytest.mark.parametrize("of", [1, 3])
def test_sums_by_middles_by_nodes_and_by_blocks_are_those_of_brute_force(monkeypatch, of):
    rng = random.Random(8)
    rows = [(i // 5, i, 0, rng.randrange(30), 25 + rng.randrange(9)) for i in range(400)]  # some nodes on both sides
    rows += [(k, 0, 0, 28, k) for k in range(30)] + [(3, 0, 0, 7, 7), (9, 0, 0, 7, 2), (40, 0, 0, 7, 2)] * 2  # a hub, loops, links, repeats
    pairs = [(900 + k, rng.randrange(20, 90), rng.randrange(34), rng.randrange(34)) for k in range(150)]
    pairs = [p for p in pairs if p[2] != p[3]] + [(1, 30, 500, 7), (2, 30, 7, 500), (3, 30, 500, 501), (4, 20, 28, 7)]
    ids, batch, i, j = (np.array(x) for x in zip(*pairs, strict=True))
    b, _, _, src, dst = (np.array(x) for x in zip(*rows, strict=True))

    def sums(value, state, middles):
        monkeypatch.setattr(blocks, "STATE", state)
        monkeypatch.setattr(blocks, "MIDDLES", middles)
        out = Counter()
        for block in range(of):
            held = blocks.Held(b, [src, dst], [value(src), value(dst)], int(batch.min()), int(batch.max()), block, of)
            for x in blocks.meeting_sums([batch, i, j, ids], held):
                for p, o, v in zip(*(c.to_pylist() for c in x.columns), strict=True):
                    out[p, blocks.ORDERS[o]] += v
        return dict(out)

    taken = Counter()
    for name in ("_by_middles", "_by_nodes", "_by_blocks"):
        monkeypatch.setattr(blocks, name, lambda p, *args, name=name, f=getattr(blocks, name): taken.update({name: len(p[0])}) or f(p, *args))
    brute = brute_common(rows, pairs, 8)
    for value in (lambda n: n % 10, lambda n: n % 10 - 4, lambda n: n / 7):
        expected = Counter()
        for (p, o, n), w in brute.items():
            expected[p, o] += w * float(value(n))
        for state, middles, ways in ((1 << 23, 512, {"_by_middles"}), (1 << 23, 15, {"_by_middles", "_by_blocks"}), (1, 15, {"_by_middles", "_by_nodes"}), (1, 0, {"_by_middles", "_by_nodes"}), (1 << 23, 0, {"_by_middles", "_by_blocks"})):  # ends without edges have few middles, none
            taken.clear()
            assert sums(value, state, middles) == pytest.approx(dict(expected)), (state, middles)
            if value(1) == int(value(1)):
                assert ways == {x for x, n in taken.items() if n}


def test_sums_too_large_for_whole_doubles_are_not_taken_off(monkeypatch):
    n = 40
    src, dst = np.repeat(np.arange(n), 2), np.tile([1000, 1001], n)
    held = blocks.Held(np.zeros(2 * n, np.int64), [src, dst], [src * 10.0**15, dst * 10.0**15], 1, 1, 0, 1)
    pairs = [np.array([1]), np.array([0]), np.array([1]), np.array([5])]
    assert blocks._by_middles(pairs, held, blocks._few_middles(pairs, held)[1]) is None
    (found,) = blocks.meeting_sums(pairs, held)
    assert dict(zip(found["place"].to_pylist(), found["value"].to_pylist(), strict=True)) == pytest.approx({0: 2001e15, 5: sum(4 * k for k in range(2, n)) * 1e15})


def enumerated(rows):
    return [(u, row) for u, row in rows.items() if row]


def test_walks_in_slices_and_with_states_are_the_sums_over_paths(monkeypatch):
    rng = np.random.default_rng(5)
    steps = [rng.integers(0, 40, 3000), rng.integers(0, 30, 3000), rng.integers(0, 4, 3000), rng.random(3000) + 0.1]
    walks = [rng.integers(0, 40, 2500), rng.integers(1, 6, 2500), rng.integers(0, 25, 2500), rng.random(2500) + 0.1]
    expected = np.zeros((30, 25))
    for m in range(6):
        s, w = steps[2] == m, walks[1] == m
        earlier = walks[0][w][None, :] < steps[0][s][:, None]
        np.add.at(expected, (np.repeat(steps[1][s], w.sum()), np.tile(walks[2][w], s.sum())), (steps[3][s][:, None] * walks[3][w] * earlier).ravel())
    for state, cut, paths, run in ((1 << 23, 1 << 20, 1 << 20, 64), (90, 7, 50, 3), (90, 7, 50, 10**6)):
        for name, value in (("STATE", state), ("SLICE", cut), ("PATHS", paths), ("RUN", run)):
            monkeypatch.setattr(blocks, name, value)
        got = np.zeros_like(expected)
        for node, col, val in blocks.walked(steps, walks):
            assert not got[node, col].any()
            got[node, col] = val
        np.testing.assert_allclose(got, expected)


def test_projected_walks_are_the_matrices_times_signs(spark):
    rows, frame = edges_of(spark, 60)
    dims = 128
    state = brute_walks(rows, 2, 1e-3)
    signs = {(r["node"], r["col"]): r["val"] for r in spark.range(20).select(F.col("id").alias("node"), F.explode(F.sequence(F.lit(0), F.lit(dims - 1))).alias("col")).withColumn("val", kernels.projection(F.col("node"), F.col("col"), dims)).collect()}
    assert {round(v * dims**0.5) for v in signs.values()} == {-1, 1}
    projected = kernels.projected_walks(frame, 2, dims, 1e-3)
    got = defaultdict(lambda: [0.0] * dims)
    for r in projected.collect():
        got[r["layer"], r["node"]][r["col"]] = r["val"]
    for layer in range(3):
        for node, row in state[layer].items():
            expected = [sum(v * signs[c, k] for c, v in row.items()) for k in range(dims)]
            assert got[layer, node] == pytest.approx(expected, abs=1e-9), (layer, node)
    # dot products of rows are those of the matrices within the stated error
    errors = []
    for a in (0, 3, 6, 9):
        for b in (1, 4, 7, 10):
            for la in range(3):
                for lb in range(3):
                    x, y = state[la][a], state[lb][b]
                    exact = sum(v * y[c] for c, v in x.items())
                    size = math.hypot(*x.values()) * math.hypot(*y.values()) if x and y else 0
                    if size:
                        errors.append((sum(p * q for p, q in zip(got[la, a], got[lb, b], strict=True)) - exact) / size)
    assert max(map(abs, errors)) < 5 * math.sqrt(2 / dims) and sum(e * e for e in errors) / len(errors) < 2 * 2 / dims
    pairs = spark.createDataFrame([(0, 0, 4)], "pair_id long, i long, j long")
    features = {(r["li"], r["lj"]): r["value"] for r in kernels.walk_features(pairs, projected).collect()}
    assert len(features) == 9 and features[1, 1] == pytest.approx(math.log1p(max(0, sum(p * q for p, q in zip(got[1, 0], got[1, 4], strict=True)))))
