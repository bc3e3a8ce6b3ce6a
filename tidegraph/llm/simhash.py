"""Operator 12: SimHash near-duplicates by tables of distances to reference fingerprints.

1. A fingerprint's bit is 1 if it is set in over half of the 64-bit hashes of the text's 4-word shingles.  Equal
   fingerprints are one node.
2. The pivot table: the Hamming distances of every distinct fingerprint to ``REFERENCES`` fixed fingerprints, kept by
   block of bits (six blocks), whose sums are the distances over all bits.
3. Two fingerprints that differ in at most four bits are equal in two of six blocks at least, so there the greatest
   difference of their coordinates is 0: pairs with a greater one in every two blocks are discarded by an equality of
   keys, one for each two blocks.  Among those that share a key, pairs are discarded whose greatest difference of
   distances over all bits is above four (the triangle inequality), and the rest is verified bit by bit.
4. Of the verified pairs a task gives a spanning forest of each group only, so a group of near copies gives as many
   links as members.  Groups above ``BLOCK`` members are compared as blocks, two at a time.  Components by alternating stars.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..workspace import keep
from .common import map_texts
from .components import connected_components

WORDS, SEED, BITS_APART = 4, 42, 4
REFERENCES, BLOCKS = 16, 6
#: Members of a group that are compared at once.
BLOCK = 2048
#: Rows whose pairs a task looks at together, unless one group has more.
CHUNK = 1 << 16


def _reference(i: int) -> int:
    """The i-th reference fingerprint: splitmix64 of its number."""
    z = (i + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF
    z = (z ^ (z >> 30)) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
    z = (z ^ (z >> 27)) * 0x94D049BB133111EB & 0xFFFFFFFFFFFFFFFF
    return z ^ (z >> 31)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


#: The bits of each block: every sixth bit.
MASKS = [sum(1 << b for b in range(64) if b % BLOCKS == k) for k in range(BLOCKS)]
PIVOTS = [_reference(i) for i in range(REFERENCES)]


def fingerprint(text: str, words: int = WORDS) -> int:
    """The text's fingerprint; of a text without words it is 0."""
    found = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, and the white space of the contract
    if not found:
        return 0
    whole = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), dtype=np.int64, count=len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(found) - words + 1)
    places = zip(starts[:n].tolist(), ends[min(words, len(found)) - 1 :].tolist(), strict=True)
    h = np.fromiter((xxhash.xxh64_intdigest(whole[a:b], SEED) for a, b in places), dtype=np.uint64, count=n)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 1 << 14):
        ones += np.unpackbits(h[at : at + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n).view(">u8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``doc_id, fp`` (a long of the same bits) of each row."""
    return map_texts(docs, lambda _, texts: {"fp": [_signed(fingerprint(t, words)) for t in texts]}, [T.StructField("fp", T.LongType())])


def block_distances(fp: Column) -> list[list[Column]]:
    """For each block of bits the distances to the references within it."""
    return [[F.bit_count(fp.bitwiseXOR(F.lit(_signed(p))).bitwiseAND(F.lit(_signed(m)))) for p in PIVOTS] for m in MASKS]


def pivot_table(distinct: DataFrame) -> DataFrame:
    """``fp, blocks, distances``: of each block one number that equal distances share, and the distances over all bits (a byte each).

    Distances within a block take four bits each, as a block has at most eleven bits.
    """
    by_block = block_distances(F.col("fp"))
    packed = F.array(*(sum((F.shiftleft(d.cast("long"), 4 * i) for i, d in enumerate(row)), F.lit(0).cast("long")) for row in by_block))
    whole = F.array(*(sum((row[i] for row in by_block[1:]), by_block[0][i]).cast("byte") for i in range(REFERENCES)))
    return distinct.select("fp", packed.alias("blocks"), whole.alias("distances"))


def keyed(table: DataFrame) -> DataFrame:
    """``key, fp, distances``: a row for each two blocks; fingerprints of equal distances in both have one key."""
    pairs = list(itertools.combinations(range(BLOCKS), 2))
    keys = F.array(*(F.xxhash64(F.lit(k), F.col("blocks")[i], F.col("blocks")[j]) for k, (i, j) in enumerate(pairs)))
    return table.select(F.explode(keys).alias("key"), "fp", "distances")


def forest(group: np.ndarray, side: np.ndarray, fp: np.ndarray, distances: np.ndarray, apart: int = BITS_APART) -> list[tuple[int, int]]:
    """Rows that are linked, as a spanning forest: rows of one group stand together, and only rows of different sides are compared unless a group has one side.

    Pairs are taken by how far apart they stand; each step looks at all groups that are so large.
    """
    root, out = np.arange(len(fp)), []
    ends = np.searchsorted(group, group, side="right")
    alone = side < 0
    at = np.arange(len(fp))
    step = 1
    while True:
        at = at[at + step < ends[at]]
        if not len(at):
            return out
        u, v = at, at + step
        open_ = (alone[u] | (side[u] != side[v])) & (root[u] != root[v])
        u, v = u[open_], v[open_]
        for i in range(distances.shape[1]):
            if not len(u):
                break
            near = abs(distances[u, i] - distances[v, i]) <= apart
            u, v = u[near], v[near]
        linked = np.bitwise_count(fp[u] ^ fp[v]) <= apart
        met = False
        for a, b in zip(u[linked].tolist(), v[linked].tolist(), strict=True):
            x, y = a, b
            while root[x] != x:
                x = root[x]
            while root[y] != y:
                y = root[y]
            if x != y:
                root[max(x, y)] = min(x, y)
                out.append((a, b))
                met = True
        while met:
            up = root[root]
            met = bool((up != root).any())
            root = up
        step += 1


def links(table: DataFrame, block: int = BLOCK, apart: int = BITS_APART) -> DataFrame:
    """``u, v``: linked fingerprints, as a spanning forest of each group of candidates."""
    rows = keyed(table)
    counts = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("fp"), parts).cast("int")
    dealt = rows.join(counts.hint("merge"), "key").withColumn("parts", parts).withColumn("own", own)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    # a group's blocks are compared with themselves (side -1) and with each other (sides 0 and 1)
    side = F.when(F.col("own") == F.col("other"), -1).otherwise((F.col("own") > F.col("other")).cast("int")).cast("byte")
    dealt = dealt.select("key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), side.alias("side"), "fp", "distances")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_groups(batches):
            names = [rows.column(c).to_numpy() for c in ("key", "a", "b")]
            change = np.zeros(rows.num_rows, dtype=bool)
            for x in names:
                change[1:] |= x[1:] != x[:-1]
            fp = rows.column("fp").to_numpy()
            d = rows.column("distances").combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1)
            found = forest(np.cumsum(change), rows.column("side").to_numpy(), fp.view(np.uint64), d, apart)
            if found:
                u, v = np.array(found).T
                yield pa.RecordBatch.from_arrays([pa.array(fp[u]), pa.array(fp[v])], ["u", "v"])

    ordered = dealt.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b", "fp")
    return ordered.mapInArrow(run, "u long, v long").distinct()


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole groups of ``key, a, b``, of ``CHUNK`` rows and more."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= CHUNK:
            table = pa.Table.from_batches(held)
            n = table.num_rows
            last = [table.column(c)[n - 1].as_py() for c in ("key", "a", "b")]
            same = np.ones(n, dtype=bool)
            for c, x in zip(("key", "a", "b"), last, strict=True):
                same &= table.column(c).to_numpy() == x
            cut = n - int(same.sum())
            if cut:
                yield table.slice(0, cut)
                held = table.slice(cut).to_batches()
    if held and (table := pa.Table.from_batches(held)).num_rows:
        yield table


def near_duplicates(docs: DataFrame, words: int = WORDS, apart: int = BITS_APART) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for each row of ``docs``; fingerprints that differ in at most ``apart`` bits (4 at most) are linked.

    A null or empty text, or one of white space, has fingerprint 0, which is linked like any other; fewer than ``words``
    words are one shingle.  Rows without an id have a component too, but are nobody's id: a component of such rows alone
    has a null id.  Repeated rows are given each.  Other columns are not read.  An empty table gives an empty result.
    """
    if apart > BLOCKS - 2:
        raise ValueError(f"two of {BLOCKS} blocks are equal only up to {BLOCKS - 2} bits apart, not {apart}")
    rows = keep(fingerprints(docs, words), "fingerprints")
    nodes = keep(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    found = connected_components(links(pivot_table(nodes.select("fp")), apart=apart))
    rooted = nodes.join(found.select(F.col("node").alias("fp"), F.col("component").alias("root")), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = keep(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "least-ids")  # written, so that the join can split a large component
    named = rooted.select("fp", "root").join(least.hint("merge"), "root").select("fp", "component_id")
    return rows.join(named.hint("merge"), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose id is not the least of their component; rows without an id stay where their component has none."""
    found = near_duplicates(docs).where("doc_id <=> component_id").select("doc_id").distinct()
    return docs.join(found.withColumnRenamed("doc_id", "__kept"), F.col("doc_id").eqNullSafe(F.col("__kept")), "left_semi")
