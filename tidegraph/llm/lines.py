"""Operator 2: line dedup over levelled sorted runs of line hashes.  DataFrame functions only.

A run is a table (h1, h2, n_docs), dealt to buckets by a 128-bit hash of line keys and sorted within each.  Documents come
in batches.  The counted keys of a batch are merge-joined with the runs, bucket by bucket, so that no run is shuffled: what all
runs together hold of a key tells whether it is known to be frequent, and known keys are left out, as nothing more is to be
learnt of them.  The rest becomes one run of level 0; when a level holds ``fanout`` runs they are merged into one run
of the next level, so a key is rewritten a logarithmic number of times.  A line goes when its key's runs add up to
at least ``min_docs`` documents, from the documents of all batches.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workspace import keep, new_path, release
from .common import WHITE, unused

MIN_DOCS = 10
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Keys of documents are kept in so many slices; a batch is as many slices as have about so many keys, one at least.
SLICES, BATCH_KEYS = 64, 1_000_000


def line_key(line: Column) -> Column:
    """The line without [\\x20\\x09-\\x0D] at both ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(WHITE)), UPPER, LOWER)


def key_hash(key: Column) -> tuple[Column, Column]:
    """The 128 bits that stand for a key."""
    return F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2")


def text_lines(text: Column) -> Column:
    """The lines of a text; a null or empty text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def batch_keys(docs: DataFrame) -> DataFrame:
    """``doc_id, h1, h2``: the distinct keys of each document; keys without a character are left out."""
    keys = docs.select("doc_id", F.explode(F.array_distinct(F.transform(text_lines(F.col("text")), line_key))).alias("key"))
    return keys.where("key <> ''").select("doc_id", *key_hash(F.col("key"))).distinct()


class LineRuns:
    """The runs of each level, in the shared folder."""

    def __init__(self, spark: SparkSession, min_docs: int = MIN_DOCS, fanout: int = 4):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.levels: list[list[DataFrame]] = []
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))  # as many as a batch is shuffled to

    def runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def _stored(self, run: DataFrame, label: str) -> DataFrame:
        """Written in buckets, a file each."""
        path, name = new_path(self.spark, label), f"line_run_{uuid.uuid4().hex}"
        run.repartition(self.buckets, "h1", "h2").write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", path).saveAsTable(name)
        stored = self.spark.table(name)
        stored._scratch, stored._name = path, name
        return stored

    def drop(self, *runs: DataFrame) -> None:
        for run in runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {run._name}")
        release(*runs)

    def _merged(self, runs: list[DataFrame]) -> DataFrame:
        """Counts of all runs, which are dealt to buckets together."""
        together = reduce(DataFrame.unionByName, runs).repartition(self.buckets, "h1", "h2")
        return together.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"))

    def fresh(self, keys: DataFrame) -> DataFrame:
        """``h1, h2, n_docs`` of a batch of (doc_id, h1, h2), without the keys that the runs together know to be frequent."""
        run = keys.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"))
        known = F.lit(0).cast("long")
        for i, held in enumerate(self.runs()):
            other = held.select("h1", "h2", F.col("n_docs").alias(f"__n{i}"))
            run = run.join(other.hint("merge"), ["h1", "h2"], "left")
            known = known + F.coalesce(f"__n{i}", F.lit(0))
        return run.where(known < self.min_docs).select("h1", "h2", "n_docs")

    def add(self, keys: DataFrame) -> None:
        """Add a batch of (doc_id, h1, h2), distinct, of documents in no earlier batch; compact full levels."""
        run, level, merged = self.fresh(keys), 0, []
        while True:
            run = self._stored(run, f"line-run-{level}")
            self.drop(*merged)
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(run)
            if len(self.levels[level]) < self.fanout:
                return
            merged = self.levels[level]
            run, self.levels[level] = self._merged(merged), []
            level += 1

    def frequent(self) -> DataFrame:
        """``h1, h2`` of keys in at least ``min_docs`` documents of all batches."""
        return keep(self._merged(self.runs()).where(F.col("n_docs") >= self.min_docs).select("h1", "h2"), "frequent-lines")


def without_lines(docs: DataFrame, keys: DataFrame, frequent: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a struct of ``before`` and ``kept``, the lines and what the frequent keys leave of them, and its name.

    The frequent keys of each document are gathered, by an id, and the lines are tested where they are, so
    lines are not shuffled one by one and keep their order.  Both sides of the join with the frequent keys are
    read from tables, so that adaptive execution splits the documents of a very common line among tasks.
    """
    place, held, name = (unused(docs, x) for x in ("line_doc", "line_keys", "lines"))
    hot = keys.join(frequent.hint("merge"), ["h1", "h2"], "left_semi").groupBy(F.col("doc_id").alias(place)).agg(F.collect_set(F.struct("h1", "h2")).alias(held))
    lined = docs.join(hot.hint("merge"), docs["doc_id"].eqNullSafe(hot[place]), "left").drop(place)
    lines = text_lines(F.col("text"))
    gone = lambda line: F.array_contains(held, F.struct(*key_hash(line_key(line))))
    fresh = F.filter(lines, lambda line: (line_key(line) == "") | ~gone(line))
    both = F.struct(lines.alias("before"), F.when(F.col(held).isNull(), lines).otherwise(fresh).alias("kept"))
    return lined.select(*(F.col(f"`{c}`") for c in docs.columns), both.alias(name)), name


def frequent_keys(docs: DataFrame, min_docs: int = MIN_DOCS, batches: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The documents' keys, and those in at least ``min_docs`` documents, by adding batches to runs.

    Equal ``doc_id`` are one document, so they go to one batch: by the id's hash.  Without ``batches`` their number
    follows how many keys there are; it changes cost, never results.
    """
    found = batch_keys(docs.select("doc_id", "text")).withColumn("slice", F.pmod(F.xxhash64("doc_id"), F.lit(SLICES)).cast("int"))
    keys = keep(found.hint("rebalance", "slice"), "line-keys", ("slice",))
    if batches is None:
        batches = min(SLICES, max(1, -(-keys.count() // BATCH_KEYS)))
    runs = LineRuns(docs.sparkSession, min_docs)
    for b in range(batches):
        runs.add(keys.where((F.col("slice") >= b * SLICES // batches) & (F.col("slice") < (b + 1) * SLICES // batches)).drop("slice"))
    frequent = runs.frequent()
    runs.drop(*runs.runs())
    return keys.drop("slice"), frequent


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """All columns of ``docs`` with ``text`` replaced by its kept lines and, if there, ``n_chars`` counted anew.

    Null texts stay null; a text of which nothing is kept is empty.  Rows with the same ``doc_id`` (null
    included) are one document to the counts; an empty table stays empty; columns of any name may be there.
    """
    out, name = without_lines(docs, *frequent_keys(docs, min_docs))
    text = F.when(F.col("text").isNotNull(), F.array_join(F.col(name)["kept"], "\n"))
    changed = {"text": text}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length(text)).cast(docs.schema["n_chars"].dataType)
    return out.select(*(changed.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns))


def line_report(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_sha256`` for each row of ``docs``.

    A null or empty text is one empty line, which is kept.  Rows with the same ``doc_id`` (null included)
    are one document to the counts and rows of their own in the result.  An empty table gives an empty
    result; further columns are not read.
    """
    docs = docs.select("doc_id", "text")
    out, name = without_lines(docs, *frequent_keys(docs, min_docs))
    before, kept = F.col(name)["before"], F.col(name)["kept"]
    n, left = F.size(before).cast("long"), F.size(kept).cast("long")
    return out.select("doc_id", n.alias("n_lines"), (n - left).alias("n_dropped"), F.sha2(F.array_join(kept, "\n").cast("binary"), 256).alias("kept_sha256"))
