"""Operator 13: a Merkle manifest of a dataset, with a proof for each row.

1. A row's leaf is the SHA-256 of its fields.  Leaves stand by group (language) and order key.
2. Ranks without a sort of a group: order keys are strings of hexadecimal digits.  Counts of the keys' prefixes, three
   digits more at each level, give how many rows stand before a prefix among those of its parent (``FAN`` of them at most);
   a row's rank is the sum of these along its prefixes, and its place within the last prefix.  A prefix with more
   than ``LIMIT`` rows is taken further, digit by digit, until none has.
3. The digits of a rank to base 8 are its path in the trie of nodes.  Runs of 8**3 nodes - those that share all but the
   last three digits - are reduced together, the longest prefixes first, then these nodes' runs, up to a group's root.
   The groups' roots are ranked and reduced in the same way.
4. Down again: each run gets the siblings on the way from its node to the root, and adds its own, so every row has its
   proof; a run is a group of at most 512 rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..workspace import keep

FANOUT, TIERS = 8, 3
RUN = FANOUT**TIERS
#: Hexadecimal digits of a step between prefixes, and rows that a prefix may have.
DIGITS, LIMIT = 3, 4096
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

# -- ranks -----------------------------------------------------------------------------------------


def radix_ranks(rows: DataFrame, group: str, key: str, depth: int, alias: str = "rank", limit: int = LIMIT) -> DataFrame:
    """``rows`` with ``alias`` (long, from 0): the place of each in its group by ``key``, a string of hexadecimal digits that no two rows of a group share.

    ``depth``: the prefix that is counted first; where it has more than ``limit`` rows, three digits more are taken
    until it has not.  One check - a number - for each step; keys of distinct ids need one.
    """
    counted = rows.groupBy(group, F.left(key, F.lit(depth)).alias("__bucket")).agg(F.count("*").alias("__n"), F.max(F.length(key)).alias("__longest")).withColumn("__depth", F.lit(depth))
    done, at = keep(counted, "prefixes"), depth
    open_ = (F.col("__n") > limit) & (F.col("__depth") == at) & (F.col("__longest") > at)
    buckets, final = done, done.where(~open_)
    while buckets.where(open_).agg(F.count("*")).first()[0]:
        wide, at = buckets.where(open_).select(group, "__bucket"), at + DIGITS
        inside = rows.select(group, key).withColumn("__bucket", F.left(key, F.lit(at - DIGITS))).join(wide, [group, "__bucket"], "left_semi")
        counted = inside.groupBy(group, F.left(key, F.lit(at)).alias("__bucket")).agg(F.count("*").alias("__n"), F.max(F.length(key)).alias("__longest")).withColumn("__depth", F.lit(at))
        buckets = keep(counted, "prefixes")
        open_ = (F.col("__n") > limit) & (F.col("__depth") == at) & (F.col("__longest") > at)
        final = final.unionByName(buckets.where(~open_))
    before = _before(final, group, depth)
    # the row's own bucket: of the prefixes that it may have the one that is there
    prefixes = F.array_distinct(F.array(*(F.struct(F.lit(d).alias("__depth"), F.left(key, F.lit(d)).alias("__bucket")) for d in range(depth, at + 1, DIGITS))))
    if at == depth:
        placed = rows.withColumn("__depth", F.lit(depth)).withColumn("__bucket", F.left(key, F.lit(depth))).join(before, [group, "__depth", "__bucket"])
    else:
        placed = rows.withColumn("__p", F.explode(prefixes)).select(*rows.columns, "__p.*").join(before, [group, "__depth", "__bucket"])
    within = F.row_number().over(Window.partitionBy(group, "__depth", "__bucket").orderBy(key)) - 1
    return placed.withColumn(alias, (F.col("__before") + within).cast("long")).drop("__before", "__depth", "__bucket")


def _before(buckets: DataFrame, group: str, depth: int) -> DataFrame:
    """``group, __depth, __bucket, __before`` of ``group, __bucket, __n, __depth``: how many rows of the group stand before the bucket.

    Every bucket is counted under each of its prefixes; children of a prefix are at most ``16 ** DIGITS``.
    """
    first = depth % DIGITS or DIGITS
    levels = F.sequence(F.lit(first), F.col("__depth"), F.lit(DIGITS))
    every = buckets.select(group, "__depth", "__bucket", "__n", F.explode(levels).alias("__level"))
    every = every.withColumn("__child", F.left(F.col("__bucket"), F.col("__level"))).withColumn("__parent", F.left(F.col("__bucket"), F.greatest(F.col("__level") - DIGITS, F.lit(0))))
    counts = every.groupBy(group, "__level", "__parent", "__child").agg(F.sum("__n").alias("__sum"))
    ahead = Window.partitionBy(group, "__level", "__parent").orderBy("__child").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(group, "__level", "__child", F.coalesce(F.sum("__sum").over(ahead), F.lit(0)).alias("__ahead"))
    return every.join(offsets, [group, "__level", "__child"]).groupBy(group, "__depth", "__bucket").agg(F.sum("__ahead").alias("__before"))


def id_key(doc_id: Column) -> Column:
    """17 hexadecimal digits in the order of signed 64-bit ids, nulls first."""
    return F.when(doc_id.isNull(), F.lit("0" * 17)).otherwise(F.concat(F.lit("1"), F.lower(F.lpad(F.hex(doc_id.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"))))


def text_key(value: Column) -> Column:
    """Hexadecimal digits in the order of UTF-8 bytes, nulls first."""
    return F.when(value.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.lower(F.hex(F.encode(value, "utf-8")))))


# -- leaves ----------------------------------------------------------------------------------------


def leaf(*fields: Column) -> Column:
    """SHA-256 of fields: ``-`` for null, else the count of UTF-8 bytes, a colon and the value."""
    one = lambda f: F.coalesce(F.concat(F.octet_length(f).cast("string"), F.lit(":"), f), F.lit("-"))
    return F.sha2(F.concat(*map(one, fields)), 256)


def leaves(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """``doc_id, group, key, leaf, forged`` of each row, kept: ``forged`` is the leaf with ``tampered`` as text, null where that is null.

    Missing columns count as null.  Rows of one id are ordered by leaf, equal rows by where they were written.
    """
    held = {c: F.col(f"`{c}`") if c in docs.columns else F.lit(None) for c in FIELDS}
    fields = [held[c].cast("string") for c in FIELDS]
    forged = F.lit(None).cast("string") if tampered is None else F.when(tampered.isNotNull(), leaf(*fields[:-1], tampered))
    rows = docs.select(held["doc_id"].cast("long").alias("doc_id"), text_key(held["lang"].cast("string")).alias("group"), leaf(*fields).alias("leaf"), forged.alias("forged"), F.monotonically_increasing_id().alias("row"))
    return keep(rows, "leaves").select("doc_id", "group", F.concat(id_key(F.col("doc_id")), "leaf", F.lower(F.lpad(F.hex("row"), 16, "0"))).alias("key"), "leaf", "forged")


def tampered_text(docs: DataFrame) -> Column:
    """The text with A-Z in lower case where 3 divides the CRC-32 of the decimal id; else, and where text or id is null, null."""
    text = F.col("text").cast("string")
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, lower)


# -- the trie --------------------------------------------------------------------------------------


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def climb(nodes: list[str], whole: bool, fanout: int = FANOUT, tiers: int = TIERS) -> list[list[str]]:
    """The levels over consecutive nodes: ``tiers`` of them, or if they are the ``whole`` of a group up to its single node."""
    levels = [nodes]
    while len(levels[-1]) > 1 if whole else len(levels) <= tiers:
        below = levels[-1]
        levels.append([digest("".join(below[i : i + fanout])) for i in range(0, len(below), fanout)])
    return levels


def siblings(levels: list[list[str]], at: int, fanout: int = FANOUT) -> list[tuple[str, str]]:
    """For the node at a place, from its level up to that below the top: the siblings to its left and to its right."""
    out = []
    for level in levels[:-1]:
        start = at - at % fanout
        out.append(("".join(level[start:at]), "".join(level[at + 1 : start + fanout])))
        at //= fanout
    return out


def folded(node: str, path: list[tuple[str, str]]) -> str:
    """The root that a node and its siblings give."""
    for left, right in path:
        node = digest(left + node + right)
    return node


def _up(nodes: DataFrame) -> DataFrame:
    """``group, idx, node, total``: the nodes of the runs, and how many of them the group has."""

    def run(_: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        total = int(pdf["total"].iloc[0])
        levels = climb(pdf["node"].tolist(), total <= RUN)
        return pd.DataFrame({"group": [pdf["group"].iloc[0]], "idx": [int(pdf["idx"].iloc[0]) // RUN], "node": levels[-1], "total": [-(-total // RUN)]})

    runs = nodes.select("group", "idx", "node", "total", F.expr(f"idx div {RUN}").alias("run"))
    return runs.groupBy("group", "run").applyInPandas(run, "group string, idx long, node string, total long")


def trie(nodes: DataFrame) -> list[DataFrame]:
    """``nodes`` (group, idx, node, total) and the nodes of their runs, of these runs, and so on: the last has one for each group."""
    tiers, most = [nodes], nodes.agg(F.max("total")).first()[0] or 0
    while most > 1:
        tiers.append(keep(_up(tiers[-1]), "nodes"))
        most = -(-most // RUN)
    return tiers


PATH = "lefts array<string>, rights array<string>"


def _paths_of(run: pd.DataFrame, above: pd.DataFrame) -> Iterator[tuple[int, list[tuple[str, str]]]]:
    """Place in the run and the whole path of each of its nodes, in order; ``above``: the one row of the run's own node."""
    levels = climb(run["node"].tolist(), int(run["total"].iloc[0]) <= RUN)
    up = list(zip(above["lefts"].iloc[0], above["rights"].iloc[0], strict=True))
    for at in range(len(run)):
        yield at, siblings(levels, at) + up


def paths(tiers: list[DataFrame], top: DataFrame) -> DataFrame:
    """``group, idx, lefts, rights``, and what else ``top`` has, for the nodes of the second tier: the siblings from there to the root.

    ``top``: ``group, idx, lefts, rights`` and more of the last tier's nodes.
    """
    carried = [c for c in top.columns if c not in ("group", "idx", "lefts", "rights")]
    schema = "group string, idx long, " + PATH + "".join(f", {c} string" for c in carried)

    def down(key: tuple, run: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        run = run.sort_values("idx")
        found = [p for _, p in _paths_of(run, above)]
        out = pd.DataFrame({"group": run["group"].to_numpy(), "idx": run["idx"].to_numpy(), "lefts": [[a for a, _ in p] for p in found], "rights": [[b for _, b in p] for p in found]})
        for c in carried:
            out[c] = above[c].iloc[0]
        return out

    for tier in reversed(tiers[1:-1]):
        runs = tier.withColumn("run", F.expr(f"idx div {RUN}"))
        above = top.withColumn("run", F.col("idx"))
        top = keep(runs.groupBy("group", "run").cogroup(above.groupBy("group", "run")).applyInPandas(down, schema), "paths")
    return top


def manifest(docs: DataFrame, tampered: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """A proof for each row: ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``; and the groups: ``group, subroot, total``.

    ``tampered``: what the text has become, null where it is unchanged; the fold starts from its leaf and the siblings as they were.
    Rows without an id come first; missing columns count as null; rows of one id are ordered by leaf.  Equal rows are leaves
    each, with proofs of their own.  An empty table gives an empty result.
    """
    rows = leaves(docs, tampered)
    totals = rows.groupBy("group").agg(F.count("*").alias("total"))
    ranked = keep(radix_ranks(rows, "group", "key", 14, "idx").join(totals, "group").select("group", "idx", F.col("leaf").alias("node"), "total", "doc_id", "forged"), "ranked-leaves")
    tiers = trie(ranked)
    roots = tiers[-1].select("group", F.col("node").alias("subroot"))
    subroots = keep(radix_ranks(roots.withColumn("all", F.lit("")), "all", "group", DIGITS, "place"), "subroots")
    count = subroots.count()
    over = subroots.select(F.lit("").alias("group"), F.col("place").alias("idx"), F.col("subroot").alias("node"), F.lit(count).cast("long").alias("total"), F.col("group").alias("name"))
    upper = trie(over)
    whole = upper[-1].select("group", "idx", F.array().cast("array<string>").alias("lefts"), F.array().cast("array<string>").alias("rights"), F.col("node").alias("root"))
    top = keep(_groups(upper[0], paths(upper, whole)), "group-paths")
    return _proved(ranked, paths(tiers, top)), subroots.join(totals, "group").select("group", "subroot", "total")


def _groups(subroots: DataFrame, above: DataFrame) -> DataFrame:
    """``group, idx, lefts, rights, subroot, root``: from each group's root to the whole's."""

    def down(key: tuple, run: pd.DataFrame, over: pd.DataFrame) -> pd.DataFrame:
        run = run.sort_values("idx")
        found = [p for _, p in _paths_of(run, over)]
        return pd.DataFrame({"group": run["name"].to_numpy(), "idx": 0, "lefts": [[a for a, _ in p] for p in found], "rights": [[b for _, b in p] for p in found], "subroot": run["node"].to_numpy(), "root": over["root"].iloc[0]})

    runs = subroots.withColumn("run", F.expr(f"idx div {RUN}"))
    return runs.groupBy("group", "run").cogroup(above.withColumn("run", F.col("idx")).groupBy("group", "run")).applyInPandas(down, f"group string, idx long, {PATH}, subroot string, root string")


PROOF = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _proved(ranked: DataFrame, above: DataFrame) -> DataFrame:
    def down(key: tuple, run: pd.DataFrame, over: pd.DataFrame) -> pd.DataFrame:
        run = run.sort_values("idx")
        found = [p for _, p in _paths_of(run, over)]
        start = [n if f is None else f for n, f in zip(run["node"], run["forged"].astype(object).where(run["forged"].notna(), None), strict=True)]
        ends = [folded(n, p) for n, p in zip(start, found, strict=True)]
        root = over["root"].iloc[0]
        return pd.DataFrame({
            "doc_id": run["doc_id"].to_numpy(), "leaf": run["node"].to_numpy(), "subroot": over["subroot"].iloc[0], "root": root,
            "proof_sha256": [digest("".join(a + b for a, b in p)) for p in found], "folded_root": ends, "verified": [e == root for e in ends],
        })

    runs = ranked.withColumn("run", F.expr(f"idx div {RUN}"))
    return runs.groupBy("group", "run").cogroup(above.withColumn("run", F.col("idx")).groupBy("group", "run")).applyInPandas(down, PROOF)


def manifest_report(docs: DataFrame) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of each row, a third of them tampered with (``tampered_text``).

    The cases of nulls, ties, repeated rows, empty tables and further columns are those of ``manifest``.
    """
    return manifest(docs, tampered_text(docs))[0]
