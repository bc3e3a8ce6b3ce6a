"""Operator 9: quality rules as a bitmask ledger.

Every rule is evaluated once for each document.  The ledger keeps what was measured and one bit for each
rule that failed.  A policy is a version's mask of the rules that reject; policies and the effect of each
of their rules are computed from the ledger alone, by bitwise operations over counts of equal bit patterns.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WHITE, map_texts, resident, unused

#: Rules in the order of their bits.
RULES = ("few_words", "repeated_words", "word_length", "symbols", "repeated_lines")
SYMBOLS = "#*$%&|<>"
BASE = ("few_words", "repeated_words")
#: Versions of the policy: the rules that reject.
POLICIES = {"base": BASE, "2024-1": (*BASE, "word_length", "symbols"), "2024-2": RULES}
CURRENT = "2024-2"

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_word_lines")


def mask(rules) -> int:
    return sum(1 << RULES.index(r) for r in rules)


def repeated_words(words: list[bytes]) -> int:
    """Words in 3-word windows that are found twice or more in the text, the first included."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    w = np.array([ids.setdefault(x, len(ids)) for x in words], dtype=np.int64)
    m = len(ids)
    two = w[:-1] * m + w[1:]
    if m >= 2_000_000:  # the product of three would not fit
        two = np.unique(two, return_inverse=True)[1].astype(np.int64)
    _, at, many = np.unique(two[:-1] * m + w[2:], return_inverse=True, return_counts=True)
    again = many[at] > 1
    covered = np.zeros(n, dtype=bool)
    covered[:-2] |= again
    covered[1:-1] |= again
    covered[2:] |= again
    return int(covered.sum())


def measure(text: str) -> tuple[int, ...]:
    """The MEASURES of a text."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    seen, dup, lines = set(), 0, 0
    for line in data.split(b"\n"):
        if line.strip():
            lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    return len(words), len(text) - sum(map(text.count, WHITE)), sum(map(text.count, SYMBOLS)), dup, repeated_words(words), lines


def failures(prefix: str = "") -> Column:
    """The bits of the rules that fail, from the measures."""
    c = lambda name: F.col(prefix + name)
    fails = {
        "few_words": c("n_words") < 50,
        "repeated_words": 100 * c("n_repeat_words") > 50 * c("n_words"),
        "word_length": (c("word_chars") < 2 * c("n_words")) | (c("word_chars") > 20 * c("n_words")),
        "symbols": 4 * c("n_symbols") > c("n_words"),
        "repeated_lines": 2 * c("n_dup_lines") > c("n_word_lines"),
    }
    bits = F.lit(0)
    for i, rule in enumerate(RULES):
        bits = bits + F.when(fails[rule], 1 << i).otherwise(0)
    return bits


def ledger(docs: DataFrame) -> DataFrame:
    """``doc_id``, the measures and ``failed`` (int bits) for each row of ``docs``.

    A null text has no words and fails ``few_words``.  Repeated rows give repeated rows; further columns
    are not read; an empty table gives an empty ledger.
    """

    def work(_, texts):
        return dict(zip(MEASURES, zip(*map(measure, texts), strict=True), strict=True))

    return map_texts(docs, work, [T.StructField(m, T.LongType()) for m in MEASURES]).withColumn("failed", failures())


def judge(rows: DataFrame, version: str = CURRENT) -> DataFrame:
    """A ledger with ``kept``: whether no rule of the version's policy failed."""
    return rows.withColumn("kept", F.col("failed").bitwiseAND(F.lit(mask(POLICIES[version]))) == 0)


def ablations(rows: DataFrame, version: str = CURRENT) -> DataFrame:
    """For each rule of a policy: documents it fails, and documents that only it rejects.

    The ledger is first counted by bit pattern (at most 2 ** rules groups).
    """
    patterns = rows.groupBy("failed").agg(F.count("*").alias("n"))
    rules = patterns.sparkSession.createDataFrame([(r, mask([r])) for r in POLICIES[version]], "rule string, bit int")
    inside = F.col("failed").bitwiseAND(F.lit(mask(POLICIES[version])))
    total = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0)).alias
    return rules.join(F.broadcast(patterns), F.col("failed").bitwiseAND(F.col("bit")) != 0, "left").groupBy("rule").agg(total(F.col("n") > 0)("n_failed"), total(inside == F.col("bit"))("n_only"))


def quality_report(docs: DataFrame, version: str = CURRENT) -> DataFrame:
    """``doc_id``, the measures, ``failed``, ``base_failed`` and ``kept`` for each row of ``docs`` (see ``ledger``)."""
    return judge(ledger(docs), version).withColumn("base_failed", F.col("failed").bitwiseAND(F.lit(mask(BASE))) != 0)


def filter_documents(docs: DataFrame, version: str = CURRENT) -> DataFrame:
    """The rows of ``docs`` that a policy keeps, with all their columns, in one pass over the texts.

    Null and empty texts have no words and go; repeated rows are judged alike; an empty table stays empty;
    columns of any name may be there.
    """
    name = unused(docs, "measures")

    @F.pandas_udf("struct<" + ",".join(f"{m}:bigint" for m in MEASURES) + ">")
    def measured(texts):
        import pandas as pd

        resident("quality", dict)  # nothing to hold: frees what a stage before has left
        return pd.DataFrame([measure(t or "") for t in texts], columns=list(MEASURES))

    judged = docs.withColumn(name, measured("text"))
    return judged.where(failures(f"{name}.").bitwiseAND(F.lit(mask(POLICIES[version]))) == 0).drop(name)
