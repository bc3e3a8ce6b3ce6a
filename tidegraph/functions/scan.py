"""Prefix scans: what the rows before a row add up to, without a task that goes along all of them.

Steps are cut into spans.  Rows are scanned within their span, the spans' totals along the spans, and a row's value is both
together.  That holds for every operation whose parts can be put together: sums, least and greatest values, and the last
value (the greatest by step).  Where there is no key, spans are themselves cut into spans, and only the totals of these - one
for ``2 ** (2 * bits)`` steps - stand in one row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..workspace import plain_unions

#: Bits of steps that make a span, for steps that are batches; and for steps that are events, of which a key has few in a row.
SPAN_BITS, EVENT_BITS = 10, 20
_FOLD = {"sum": F.sum, "max": F.max, "min": F.min, "last": F.max, "next": F.min}
_STRUCTS = ("last", "next")


def _merge(how: str, a: Column, b: Column) -> Column:
    """Two partial values of which either may be null."""
    if how == "sum":
        return F.coalesce(a + b, a, b)
    return (F.least if how in ("min", "next") else F.greatest)(a, b)


def scan(rows: DataFrame, keys: list[str], step: str, folds: dict[str, tuple[str, str | Column]], inclusive: bool = False, bits: int = SPAN_BITS) -> DataFrame:
    """``rows`` with a column for each of ``folds``: (``sum``, ``max``, ``min`` or ``last``, value) over the rows of the same keys and smaller steps.

    ``step`` is a whole number.  Rows of one step do not count for each other; with ``inclusive`` they do, the row itself
    too.  (``next``, value) is the nearest value of greater steps.  Null values count nowhere; where there is nothing to
    add up the result is null.  Rows whose key is null are left out.
    """
    of = list(enumerate((alias, how, F.col(v) if isinstance(v, str) else v) for alias, (how, v) in folds.items()))
    work = rows.withColumn("__at", F.col(step).cast("long"))
    work = work.withColumns({f"__v{i}": F.when(v.isNotNull(), F.struct("__at", v.alias("value"))) if how in _STRUCTS else v for i, (_, how, v) in of})
    work = work.withColumn("__span", F.shiftright("__at", bits))
    totals = work.groupBy(*keys, "__span").agg(*(_FOLD[how](f"__v{i}").alias(f"__v{i}") for i, (_, how, _) in of))
    carried = _along(totals, keys, of) if keys else _in_spans(totals, of, bits)
    inside = Window.partitionBy(*keys, "__span").orderBy("__at")
    inside = {True: inside.rangeBetween(1, Window.unboundedFollowing), False: inside.rangeBetween(Window.unboundedPreceding, 0 if inclusive else -1)}
    out = work.withColumns({f"__in{i}": _FOLD[how](f"__v{i}").over(inside[how == "next"]) for i, (_, how, _) in of}).join(carried, [*keys, "__span"])
    for i, (alias, how, _) in of:
        both = _merge(how, F.col(f"__c{i}"), F.col(f"__in{i}"))
        out = out.withColumn(alias, both["value"] if how in _STRUCTS else both)
    return out.drop("__at", "__span", *(f"__{x}{i}" for i, _ in of for x in ("v", "c", "in")))


def _along(totals: DataFrame, by: list[str], of: list, name: str = "c") -> DataFrame:
    """``by, __span, __c0, ...``: the totals of the spans before, or after for ``next``."""
    spans = Window.partitionBy(*by).orderBy("__span")
    spans = {True: spans.rowsBetween(1, Window.unboundedFollowing), False: spans.rowsBetween(Window.unboundedPreceding, -1)}
    return totals.select(*by, "__span", *(_FOLD[how](f"__v{i}").over(spans[how == "next"]).alias(f"__{name}{i}") for i, (_, how, _) in of))


def _in_spans(totals: DataFrame, of: list, bits: int) -> DataFrame:
    """``_along`` without a key: spans within wide spans, and the totals of the wide ones in one row."""
    totals = totals.withColumn("__wide", F.shiftright("__span", bits))
    wide = totals.groupBy("__wide").agg(*(_FOLD[how](f"__v{i}").alias(f"__v{i}") for i, (_, how, _) in of))
    row = wide.agg(F.collect_list(F.struct("__wide", *(f"__v{i}" for i, _ in of))).alias("__row"))
    near = _along(totals, ["__wide"], of, "n").join(F.broadcast(row.withColumn("__one", F.lit(0))), F.lit(0) == F.col("__one"))  # one row

    def fold(i: int, how: str) -> Column:
        there = F.filter("__row", lambda w: w["__wide"] > F.col("__wide") if how == "next" else w["__wide"] < F.col("__wide"))
        values = F.filter(F.transform(there, lambda w: w[f"__v{i}"]), lambda v: v.isNotNull())
        if how == "sum":
            kind = totals.schema[f"__v{i}"].dataType
            far = F.when(F.size(values) > 0, F.aggregate(F.slice(values, 2, 1 << 30), F.element_at(values, 1), lambda a, b: (a + b).cast(kind)))
        else:
            far = F.array_min(values) if how in ("min", "next") else F.array_max(values)
        return _merge(how, far, F.col(f"__n{i}")).alias(f"__c{i}")

    return near.select("__span", *(fold(i, how) for i, (_, how, _) in of))


def at_steps(tables: list[DataFrame], by: list[str], values: dict[str, str]) -> DataFrame:
    """One row for each ``by`` of several tables: sums and greatest values (``values``: column to ``sum`` or ``max``) of what they have; others count as null."""
    plain_unions(tables[0].sparkSession)
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    return both.groupBy(*by).agg(*(_FOLD[how](c).alias(c) for c, how in values.items()))
