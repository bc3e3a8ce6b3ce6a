"""Operators 11 to 13 against brute-force versions, over odd cases and over whole tables."""

import hashlib
import math
import random
import zlib
from collections import defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import types as T

from tidegraph.llm import catalogue, manifest, simhash, whitening

from test_llm_operators import SCHEMA, odd_rows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(params=["odd", "small", "empty"])
def docs(request, spark, small):
    odd = spark.createDataFrame(odd_rows(), SCHEMA)
    return {"odd": odd, "small": small, "empty": odd.limit(0)}[request.param]


# -- 11 --------------------------------------------------------------------------------------------

VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("y", T.StringType()), T.StructField("component", T.StringType())])


def check_whitening(got, vectors, count=16):
    whole = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in vectors if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in whole})
    n, size = len(fit), len(fit[0])
    sums = [sum(x[d] for x in fit) for d in range(size)]
    centred = [[n * v - s for v, s in zip(x, sums, strict=True)] for x in fit]
    cov = [[Fraction(sum(c[i] * c[j] for c in centred), n**3) for j in range(size)] for i in range(size)]
    trace = sum(cov[i][i] for i in range(size))
    exact = np.array([[float(v) for v in row] for row in cov])
    e = np.linalg.eigvalsh(exact)[::-1]
    by = defaultdict(list)
    for r in got:
        by[r["vec_id"], r["deviation"]].append(r)
    k = min(count, size)
    assert len(got) == k * len(whole)
    for i, x in whole:
        d = [n * v - s for v, s in zip(x, sums, strict=True)]
        found = by[i, sum(v * v for v in d)]
        assert {r["component"] for r in found} == set(range(1, k + 1)) and {r["n"] for r in found} == {n}
    for c in range(k):
        shares = {r["explained"] for r in got if r["component"] == c + 1}
        assert len(shares) == 1 and abs(shares.pop() * float(trace) - e[c]) <= 1e-9 * e[0]
    errors = {r["identity_error"] for r in got}
    assert len(errors) == 1 and errors.pop() < 1e-4
    distinct = {tuple(x): i for i, x in whole}
    w = []
    for x, i in distinct.items():
        held = {r["component"]: r["whitened"] for r in by[i, sum((n * v - s) ** 2 for v, s in zip(x, sums, strict=True))]}
        w.append([held[c + 1] for c in range(k)])
    w = np.array(w)
    live = [c for c in range(k) if e[c] > 1e-12 * e[0]]
    w = w[:, live].astype(float)
    centre = w - w.mean(axis=0)
    assert abs(centre.T @ centre / n - np.eye(len(live))).max() < 1e-6
    # whitened values are projections on unit eigenvectors: x - mean = U sqrt(e) w + what other components hold
    if len(live) == size:
        back = np.array([[v - s / n for v, s in zip(x, sums, strict=True)] for x in distinct])
        assert np.allclose((w * np.sqrt(e[live])) @ (w * np.sqrt(e[live])).T, back @ back.T, rtol=1e-6, atol=1e-3)


def test_whitening_of_the_table(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    check_whitening(whitening.whiten(table).collect(), [(r["vec_id"], r["embedding"]) for r in table.collect()])


def test_whitening_of_odd_vectors(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, s) for s in (1, 0.1, 1000, 5)], "y", "c") for i in range(40)]
    rows += [rows[0], rows[0], (None, rows[1][1], None, None), (50, None, "", ""), (51, [1.0, None, 2.0, 3.0], "", ""), (52, [1.0, math.nan, 0.0, 0.0], "", ""), (53, [math.inf, 0.0, 0.0, 0.0], "", ""), (54, [-math.inf, 0.0, 0.0, 0.0], "", ""), (55, [], "", "")]
    table = spark.createDataFrame(rows, VECTORS)
    got = whitening.whiten(table).collect()
    check_whitening(got, [(r[0], r[1]) for r in rows])
    kept = whitening.whitened_vectors(table, alias="y").collect()
    assert len(kept) == len(rows) and set(kept[0].asDict()) == {"vec_id", "embedding", "y", "component", "y_"}
    by_id = {(r["vec_id"], r["component"]): r["whitened"] for r in got}
    for r in kept:
        assert (r["y_"] is None) == (r["vec_id"] is not None and r["vec_id"] >= 50)
        assert r["y_"] is None or all(abs(v - by_id[r["vec_id"], i + 1]) < 1e-9 for i, v in enumerate(r["y_"]))


def test_whitening_without_variance_or_rows(spark):
    table = spark.createDataFrame([(1, [1.0, 2.0], None, None), (2, [1.0, 2.0], None, None)], VECTORS)
    got = whitening.whiten(table).collect()
    assert len(got) == 4 and all((r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) == (1, 0, None, 0.0, 0.0) for r in got)
    line = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i, 7.0], None, None) for i in range(5)], VECTORS)).collect()
    assert {r["component"] for r in line if r["whitened"] is None} == {2, 3} and abs(sum(r["explained"] for r in line) - 5) < 1e-9
    empty = whitening.whiten(table.limit(0))
    assert empty.count() == 0 and empty.columns == line[0].__fields__
    assert whitening.whitened_vectors(table.limit(0)).count() == 0


def test_vectors_of_another_length_have_no_part(spark):
    rows = [(i, [float(i), float(i * i)], None, None) for i in range(6)] + [(9, [1.0], None, None), (10, [1.0, 2.0, 3.0], None, None)]
    assert {r["vec_id"] for r in whitening.whiten(spark.createDataFrame(rows, VECTORS)).collect()} == set(range(6))


@pytest.mark.parametrize("top", [10, 1 << 30, 1 << 61])
def test_products_are_exact(top):
    rng = random.Random(top)
    y = np.array([[rng.randrange(-top, top + 1) for _ in range(5)] for _ in range(300)])
    n, sums = 300, [sum(int(v) for v in y[:, d]) for d in range(5)]
    d = whitening.centred(y, n, sums)
    rows = [[n * int(v) - s for v, s in zip(r, sums, strict=True)] for r in y]
    assert [[int(v) for v in r] for r in d] == rows
    gram = whitening.exact_gram(d)
    assert [[int(v) for v in r] for r in gram] == [[sum(r[i] * r[j] for r in rows) for j in range(5)] for i in range(5)]
    assert [whitening.joined(v) for v in whitening.limbs([0, 1, -1, top**3, -(top**3)])] == [0, 1, -1, top**3, -(top**3)]


def test_deviation_that_is_no_long_is_null(spark):
    got = whitening.whiten(spark.createDataFrame([(0, [1e300, 0.0], None, None), (1, [-1e300, 1.0], None, None), (2, [0.0, 0.5], None, None)], VECTORS)).collect()
    assert len(got) == 6 and {r["deviation"] for r in got if r["vec_id"] < 2} == {None}


# -- 12 --------------------------------------------------------------------------------------------


def brute_fingerprint(text):
    words, cur = [], ""
    for ch in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "") + " ":
        if ch in " \t\n\x0b\f\r":
            if cur:
                words.append(cur)
            cur = ""
        else:
            cur += ch
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(nodes):
    root = {f: f for f in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    listed = sorted(nodes)
    for i, a in enumerate(listed):
        for b in listed[i + 1 :]:
            if (a ^ b).bit_count() <= 4:
                root[find(b)] = find(a)
    return {f: find(f) for f in nodes}


def check_simhash(got, rows):
    fps = [(i, brute_fingerprint(t)) for i, t in rows]
    comp = brute_components({f for _, f in fps})
    least = defaultdict(list)
    for i, f in fps:
        if i is not None:
            least[comp[f]].append(i)
    expected = sorted(((i, f"{f:016x}", min(least[comp[f]], default=None)) for i, f in fps), key=str)
    assert sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got), key=str) == expected


def test_simhash(docs):
    check_simhash(simhash.near_duplicates(docs).collect(), [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])


def scattered(n, seed):
    rng = random.Random(seed)
    out = set()
    while len(out) < n:
        centre = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 3, 60])):
            out.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 7))))
    return sorted(out)[:n]


@pytest.mark.parametrize("block", [2048, 7])
def test_links_lose_no_component(spark, block):
    fps = scattered(700, 5)
    table = simhash.pivot_table(spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long"))
    found = [(r["u"] & (1 << 64) - 1, r["v"] & (1 << 64) - 1) for r in simhash.links(table, block).collect()]
    assert all((u ^ v).bit_count() <= 4 for u, v in found)
    expected, root = brute_components(set(fps)), {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in found:
        root[find(u)] = find(v)
    of = defaultdict(set)
    for f in fps:
        of[expected[f]].add(find(f))
    assert all(len(x) == 1 for x in of.values()) and len(of) == len({find(f) for f in fps})


def test_distances_are_those_to_the_references(spark):
    fps = scattered(50, 8)
    for r in simhash.pivot_table(spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")).collect():
        f = r["fp"] & (1 << 64) - 1
        assert r["distances"] == [(f ^ p).bit_count() for p in simhash.PIVOTS]
        for mask, packed in zip(simhash.MASKS, r["blocks"], strict=True):
            assert packed & (1 << 64) - 1 == sum(((f ^ p) & mask).bit_count() << 4 * i for i, p in enumerate(simhash.PIVOTS))


def test_a_group_of_near_copies_gives_a_forest(spark):
    centre, fps = 0x0123456789ABCDEF, set()
    for i in range(64):
        for j in range(64):
            fps.add(centre ^ (1 << i) ^ (1 << j))
    table = simhash.pivot_table(spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long"))
    found = simhash.links(table).count()
    assert len(fps) - 1 <= found <= 15 * len(fps)  # two million pairs are linked


def test_one_of_each(spark):
    rows = [(3, "a b c d e f"), (1, "A b C d E f"), (2, None), (5, " "), (7, "something else entirely in here"), (None, "only this one has no id at all")]
    got = simhash.one_of_each(spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fp string")).collect()
    assert {r["doc_id"] for r in got} == {1, 2, 7, None}


# -- 13 --------------------------------------------------------------------------------------------


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def brute_manifest(rows):
    """rows: dicts of the five fields."""
    groups = defaultdict(list)
    for r in rows:
        own = h("".join(field(r[c]) for c in ("doc_id", "source", "lang", "n_chars", "text")))
        text = r["text"]
        if r["doc_id"] is not None and text is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0:
            text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        forged = h("".join(field(v) for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)))
        groups[r["lang"]].append((r["doc_id"], own, forged))

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([h("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
        return levels

    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees[g] = tree([own for _, own, _ in groups[g]])
    over = tree([trees[g][-1][0] for g in names])
    out = []
    for place, g in enumerate(names):
        for at, (doc_id, own, forged) in enumerate(groups[g]):
            proof, fold = "", forged
            for levels, k in ((trees[g], at), (over, place)):
                for level in levels[:-1]:
                    run = level[k - k % 8 : k - k % 8 + 8]
                    proof += "".join(run[: k % 8] + run[k % 8 + 1 :])
                    fold = h("".join(run[: k % 8]) + fold + "".join(run[k % 8 + 1 :]))
                    k //= 8
            out.append((doc_id, own, trees[g][-1][0], over[-1][0], h(proof), fold, fold == over[-1][0]))
    return sorted(out, key=str)


def listed(frame):
    return sorted(((r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["folded_root"], r["verified"]) for r in frame.collect()), key=str)


def test_manifest(docs):
    rows = [r.asDict() for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert listed(manifest.manifest_report(docs)) == (brute_manifest(rows) if rows else [])


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65, 513, 1100])
def test_manifest_of_every_height(spark, n):
    rng = random.Random(n)
    rows = [{"doc_id": rng.randrange(-(1 << 62), 1 << 62) if i % 2 else i, "source": None, "lang": "en" if i % 5 else rng.choice(["", "ab", "abc", "é", None]), "n_chars": i, "text": f"Text {i}"} for i in range(n)]
    frame = spark.createDataFrame([tuple(r.values()) for r in rows], "doc_id long, source string, lang string, n_chars long, text string")
    assert listed(manifest.manifest_report(frame)) == brute_manifest(rows)


def test_manifest_of_very_many_groups(spark):
    rows = [{"doc_id": i, "source": "s", "lang": f"l{i % 700}", "n_chars": i, "text": "T"} for i in range(1000)]
    frame = spark.createDataFrame([tuple(r.values()) for r in rows], "doc_id long, source string, lang string, n_chars long, text string")
    assert listed(manifest.manifest_report(frame)) == brute_manifest(rows)


def test_ranks_of_long_and_crowded_prefixes(spark):
    rng = random.Random(1)
    keys = {"ab" * 8 + format(rng.getrandbits(24), "06x")[: rng.randrange(0, 7)] for _ in range(400)} | {format(i, "x") for i in range(50)}
    frame = spark.createDataFrame([(g, k) for g in ("x", "y") for k in keys], "g string, k string")
    got = {(r["g"], r["k"]): r["rank"] for r in manifest.radix_ranks(frame, "g", "k", 3, limit=5).collect()}
    assert got == {(g, k): i for g in ("x", "y") for i, k in enumerate(sorted(keys))}


def test_many_rows_of_one_id(spark):
    rows = [{"doc_id": None if i % 3 else 7, "source": None, "lang": "en", "n_chars": i % 50, "text": "t"} for i in range(300)]
    frame = spark.createDataFrame([tuple(r.values()) for r in rows], "doc_id long, source string, lang string, n_chars long, text string")
    assert listed(manifest.manifest_report(frame)) == brute_manifest(rows)


def test_a_proof_of_changed_rows_fails_and_of_unchanged_rows_holds(small):
    got = manifest.manifest_report(small).collect()
    changed = {r["doc_id"] for r in small.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 and any("A" <= c <= "Z" for c in r["text"] or "")}
    assert {r["doc_id"] for r in got if not r["verified"]} == changed


def test_manifest_matches_sql(spark):
    if "op13_manifest" not in catalogue.ORACLE_SQL:
        pytest.skip("no SQL")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    expected = duck.sql(catalogue.ORACLE_SQL["op13_manifest"])
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(expected.columns) == sorted(names)
    assert listed(catalogue.QUERIES["op13_manifest"](spark, SF)) == sorted(expected.select(*names).fetchall(), key=str)
