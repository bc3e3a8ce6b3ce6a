"""Operator 8: MinHash near-duplicates.

1. A document's set is its distinct 5-word shingles; equal sets make a class, of which one document stands for all.
2. Each set gets ``BANDS * ROWS`` minima of universal hash functions; each band of them is a bucket key.  Two
   sets of similarity s share a bucket with probability 1 - (1 - s**ROWS)**BANDS: at s = 0.75 all but one pair
   in a million.
3. Each member is paired with the least one of a bucket, that of most of its buckets.  Links are confirmed on
   whole sets and joined to components by alternating stars.  Within a component nothing is left to learn.
   Then, in buckets that still hold several components, members are compared across components, all of them, in
   blocks of bounded size and without making pairs.  So no bucket has a cap.
4. A pair goes to confirmation if the share of equal minima (a byte of each is kept) is within ``MARGIN`` of the
   threshold, six standard deviations and more.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..workspace import keep, release
from .common import BoundedCache, map_texts, resident
from .components import connected_components

WORDS, PERCENT = 5, 75
BANDS, ROWS = 50, 5
MARGIN = 0.19
#: Groups are compared in blocks of about so many shingles, each member counting as so many more.
BLOCK, EACH = 400_000, 200
SEED = 20240229
#: Word hashes that a worker holds.
CACHED_WORDS = 200_000

_MIX = np.random.default_rng(SEED)
_PLACE = _MIX.integers(1, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_A = _MIX.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _MIX.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_ROW = _MIX.integers(1, 1 << 63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = _MIX.integers(0, 1 << 63, BANDS, dtype=np.uint64)


def _words() -> BoundedCache:
    return resident("neardup", lambda: BoundedCache(xxhash.xxh3_64_intdigest, CACHED_WORDS))


def _spread(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit (two multiply-and-shift rounds)."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(text: str) -> np.ndarray:
    """Sorted 64-bit hashes of the text's set."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, and the white space of the contract
    n = len(words)
    h = np.fromiter(map(_words().__getitem__, words), dtype=np.uint64, count=n)
    if n < WORDS:
        return _spread((h * _PLACE[:n]).sum(dtype=np.uint64, keepdims=True) + np.uint64(n)) if n else h
    total = h[: n - WORDS + 1] * _PLACE[0]
    for i in range(1, WORDS):
        total += h[i : n - WORDS + 1 + i] * _PLACE[i]
    return np.unique(_spread(total))


def signature(sets: np.ndarray) -> np.ndarray:
    """Minima of the universal hash functions (multiply-shift, 32 bits) over a set."""
    x = sets >> np.uint64(32)
    out = np.empty(len(_A), dtype=np.uint64)
    step = max(1, 200_000 // len(x))
    for i in range(0, len(_A), step):
        out[i : i + step] = (_A[i : i + step, None] * x + _B[i : i + step, None]).min(axis=1) if len(x) == 1 else ((_A[i : i + step, None] * x + _B[i : i + step, None]) >> np.uint64(32)).min(axis=1)
    return out if len(x) > 1 else out >> np.uint64(32)


def set_hash(sets: np.ndarray) -> bytes:
    """What equal sets share."""
    return xxhash.xxh3_128_digest(sets.tobytes())


def signed(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, set_hash, minima, bands`` of each row; no bands where the set is empty."""
    fields = [T.StructField("n_shingles", T.LongType()), T.StructField("set_hash", T.BinaryType()), T.StructField("minima", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))]

    def work(_, texts):
        out = {f.name: [] for f in fields}
        for text in texts:
            s = shingles(text)
            out["n_shingles"].append(len(s))
            out["set_hash"].append(set_hash(s) if len(s) else None)
            if not len(s):
                out["minima"].append(None)
                out["bands"].append(None)
                continue
            m = signature(s)
            out["minima"].append((m & np.uint64(255)).astype(np.uint8).tobytes())
            out["bands"].append(_spread((m.reshape(BANDS, ROWS) * _ROW).sum(axis=1, dtype=np.uint64) + _BAND).view(np.int64))
        return out

    return map_texts(docs, work, fields)


def shingle_sets(candidates: DataFrame) -> DataFrame:
    """``rep, leader, leads, minima, n_shingles, shingles array<long>`` of rows with ``doc_id, text, leader, leads, set_hash, minima``.

    Of an id with several texts each row keeps the text that its ``set_hash`` is of.
    """
    fields = [T.StructField("n_shingles", T.LongType()), T.StructField("shingles", T.ArrayType(T.LongType()))]

    def work(rows, texts):
        out = {"take": [], "n_shingles": [], "shingles": []}
        for i, (text, wanted) in enumerate(zip(texts, rows, strict=True)):
            s = shingles(text)
            if len(s) and set_hash(s) == wanted:
                out["take"].append(i)
                out["n_shingles"].append(len(s))
                out["shingles"].append(s.view(np.int64))
        return out

    return map_texts(candidates, work, fields, keep=("set_hash", "doc_id", "leader", "leads", "minima")).withColumnRenamed("doc_id", "rep")


@F.pandas_udf(T.BooleanType())
def _near(left, right):
    """Whether the share of equal minima is near the threshold or above."""
    import pandas as pd

    if not len(left):
        return pd.Series([], dtype=bool)
    a, b = (np.frombuffer(b"".join(x), dtype=np.uint8).reshape(len(left), -1) for x in (left, right))
    return pd.Series((a == b).mean(axis=1) >= PERCENT / 100 - MARGIN)


def star_links(sets: DataFrame) -> DataFrame:
    """Links (u, v) of candidates to their leaders: signatures first, then whole sets of similarity at least ``PERCENT`` in 100."""
    follows = sets.where("leader IS NOT NULL").select(F.col("leader").alias("u"), F.col("rep").alias("v"), F.col("minima").alias("mv"), F.col("shingles").alias("sv"))
    leads = sets.where("leads").select(F.col("rep").alias("u"), F.col("minima").alias("mu"), F.col("shingles").alias("su"))
    both = follows.join(leads.hint("merge"), "u").where(_near("mu", "mv")).withColumn("n", F.size(F.array_intersect("su", "sv")).cast("long"))
    return both.where(100 * F.col("n") >= PERCENT * (F.size("su") + F.size("sv") - F.col("n"))).select("u", "v")


def links_across(members: DataFrame, parts: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between different components whose members share a bucket; each bucket's pairs are compared, none is left out.

    A mixed bucket belongs to the component that most of its members are in, its home; its other members are
    strays.  All members of a home's buckets are one group, in which strays are compared with the home and with
    each other, never the home with itself.  Strays and home are dealt into blocks of bounded size, and each
    pair of blocks with strays is one task's work, see ``block_links``.
    """
    labelled = members.join(parts.withColumnRenamed("node", "rep").hint("merge"), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("label"))
    sizes = labelled.groupBy("key", "label").agg(F.count("*").alias("n"))
    home = sizes.groupBy("key").agg(F.max(F.struct("n", "label")).alias("top"), F.count("*").alias("labels")).where("labels > 1").select("key", F.col("top")["label"].alias("home"))
    group = labelled.join(home.hint("merge"), "key").select("home", "rep", "label").distinct()
    group = keep(group.join(sets.groupBy("rep").agg(F.sum("n_shingles").alias("n_shingles")).hint("merge"), "rep").withColumn("stray", F.col("label") != F.col("home")), "groups")
    weight = lambda stray: F.ceil(F.sum(F.when(F.col("stray") == stray, F.col("n_shingles") + EACH)) / BLOCK).cast("int")
    blocks = keep(group.groupBy("home").agg(weight(True).alias("strays"), F.coalesce(weight(False), F.lit(0)).alias("own")), "blocks")  # a table, so that a large home's rows can be split
    # blocks of strays come first; each meets all blocks, and a block of the home those of strays
    placed = group.drop("n_shingles").join(blocks.hint("merge"), "home")
    in_strays, in_own = F.pmod(F.xxhash64("rep"), F.col("strays")), F.col("strays") + F.pmod(F.xxhash64("rep"), F.col("own"))
    placed = placed.withColumn("block", F.when(F.col("stray"), in_strays).otherwise(in_own).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("stray"), F.col("strays") + F.col("own")).otherwise(F.col("strays")) - 1)))
    placed = placed.select("home", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "rep", "label")
    kind = group.schema["rep"].dataType.simpleString()
    filled = placed.join(sets.select("rep", "minima", "shingles").hint("merge"), "rep")
    links = keep(filled.groupBy("home", "lo", "hi").applyInPandas(block_links, f"u {kind}, v {kind}"), "links")
    release(group, blocks)
    return links


def equal_minima(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each row of left and row of right how many of their minima are equal."""
    out = np.zeros((len(left), len(right)), dtype=np.uint16)
    for a, b in zip(left.T, right.T, strict=True):
        out += a[:, None] == b[None, :]
    return out


def common_shingles(left: list[np.ndarray], right: list[np.ndarray], width: int = 2048) -> np.ndarray:
    """Sizes of the intersections of sets, all pairs at once: a product of 0-1 matrices over the shingles of both sides, some columns at a time."""
    a, b = np.concatenate(left), np.concatenate(right)
    shared = np.intersect1d(a, b)
    common = np.zeros((len(left), len(right)), dtype=np.int64)

    def places(values, sets):
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.minimum(np.searchsorted(shared, values), len(shared) - 1)
        held = shared[at] == values
        owner, at = owner[held], at[held]
        order = np.argsort(at, kind="stable")
        return owner[order], at[order]

    if not len(shared):
        return common
    sides = [(places(a, left), len(left)), (places(b, right), len(right))]
    for start in range(0, len(shared), width):
        present = []
        for (owner, at), rows in sides:
            first, last = np.searchsorted(at, [start, start + width])
            one = np.zeros((rows, width), dtype=np.float32)
            one[owner[first:last], at[first:last] - start] = 1
            present.append(one)
        common += (present[0] @ present[1].T).astype(np.int64)
    return common


def block_links(rows):
    """Links between members of different components in one block, or between two blocks.

    Signatures are compared first, and whole sets of those members that have a promising partner.  Of the links
    only those that join components not joined in this block are given.
    """
    import pandas as pd

    labels, reps, block = rows["label"].to_numpy(), rows["rep"].to_numpy(), rows["block"].to_numpy()
    left, right = np.flatnonzero(block == rows["lo"].iloc[0]), np.flatnonzero(block == rows["hi"].iloc[0])
    none = pd.DataFrame({"u": reps[:0], "v": reps[:0]})
    if not len(left) or not len(right) or len(set(labels.tolist())) == 1:
        return none
    minima = np.frombuffer(b"".join(rows["minima"]), dtype=np.uint8).reshape(len(rows), -1)
    promising = equal_minima(minima[left], minima[right]) >= (PERCENT / 100 - MARGIN) * minima.shape[1]
    promising &= labels[left][:, None] != labels[right][None, :]
    left, right = left[promising.any(axis=1)], right[promising.any(axis=0)]
    if not len(left):
        return none
    sets = rows["shingles"]
    a, b = [np.asarray(sets.iloc[i]) for i in left], [np.asarray(sets.iloc[i]) for i in right]
    common = common_shingles(a, b)
    union = np.array([len(s) for s in a])[:, None] + np.array([len(s) for s in b])[None, :] - common
    linked = (100 * common >= PERCENT * union) & (labels[left][:, None] != labels[right][None, :])
    root: dict = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    out = []
    for i, j in zip(*np.nonzero(linked), strict=True):
        u, v = find(labels[left[i]]), find(labels[right[j]])
        if u != v:
            root[max(u, v)] = min(u, v)
            out.append((left[i], right[j]))
    return pd.DataFrame({"u": reps[[i for i, _ in out]], "v": reps[[j for _, j in out]]}) if out else none


def same_document(usable: DataFrame, classes: DataFrame) -> DataFrame | None:
    """Links between the classes that one ``doc_id`` has texts of; None if no id has several."""
    mark = F.xxhash64("set_hash")
    split = keep(usable.groupBy("doc_id").agg(F.min(mark).alias("lo"), F.max(mark).alias("hi")).where("lo < hi").select("doc_id"), "repeated-ids")
    if split.isEmpty():
        return None
    ids = usable.select("doc_id", "set_hash").join(split.hint("merge"), "doc_id", "left_semi").join(classes.select("set_hash", "rep").hint("merge"), "set_hash")
    return ids.select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept, class_id`` for each row of ``docs``.

    ``class_id``: the least id with an equal set.  A null text, or one without words, has an empty set and is
    its own component.  Rows with one ``doc_id`` are one document: its component joins the links of all of them.
    A null ``doc_id`` is no document: its component is null and it is kept.  Ids may be numbers or strings.  An
    empty table gives an empty result; further columns are not read.
    """
    docs = docs.select("doc_id", "text")
    signatures = keep(signed(docs), "signatures")
    usable = signatures.where("doc_id IS NOT NULL AND set_hash IS NOT NULL")
    classes = usable.groupBy("set_hash").agg(F.min("doc_id").alias("rep"), F.min_by("minima", "doc_id").alias("minima"), F.min_by("bands", "doc_id").alias("bands"))
    classes = keep(classes, "classes")

    keyed = classes.select("rep", F.explode("bands").alias("key"))
    shared = keep(keyed.groupBy("key").agg(F.min("rep").alias("leader"), F.max("rep").alias("last")).where("leader < last").select("key", "leader"), "buckets")
    members = keep(keyed.join(shared.hint("merge"), "key"), "members")
    # each member with the leader that it shares most buckets with; other leaders are compared below
    leader = F.mode(F.when(F.col("rep") != F.col("leader"), F.col("leader")), True).alias("leader")
    chosen = members.groupBy("rep").agg(leader, F.max(F.col("rep") == F.col("leader")).alias("leads"))
    chosen = chosen.join(classes.select("rep", "set_hash", "minima").hint("merge"), "rep")
    sets = keep(shingle_sets(docs.join(chosen.withColumnRenamed("rep", "doc_id").hint("merge"), "doc_id")), "sets")

    links = star_links(sets)
    several = same_document(usable, classes)
    parts = connected_components(links if several is None else links.unionByName(several))

    more = links_across(members, parts, sets)
    release(shared, members, sets)
    label = lambda end: parts.select(F.col("node").alias(end), F.col("component").alias(f"c{end}")).hint("merge")
    more = more.join(label("u"), "u", "left").join(label("v"), "v", "left").select(F.coalesce("cu", "u").alias("u"), F.coalesce("cv", "v").alias("v"))
    merged = connected_components(more)

    reps = classes.select("set_hash", "rep").join(parts.withColumnRenamed("node", "rep").hint("merge"), "rep", "left").select("set_hash", "rep", F.coalesce("component", "rep").alias("label"))
    reps = reps.join(merged.withColumnRenamed("node", "label").hint("merge"), "label", "left").select("set_hash", "rep", F.coalesce("component", "label").alias("component"))
    out = signatures.select("doc_id", "n_shingles", "set_hash").join(reps.hint("merge"), "set_hash", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"), F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).alias("class_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), "class_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns: one document of each component (its rows, if it has several).

    Rows without an id or without words are kept; an empty table stays empty.
    """
    gone = near_duplicates(docs).where("NOT kept").select("doc_id").distinct()
    return docs.join(gone.hint("merge"), docs["doc_id"] == gone["doc_id"], "left_anti")
