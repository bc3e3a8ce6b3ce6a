"""Operator 5: secret scans with multipart credential linking.  DataFrame functions only.

Strong findings are reported as they are.  A weak one - a value of a secret's name that is too short
to be reported alone, or a bare token of 40 characters - is reported only when a complementary part
(an access identifier, a user name, or an endpoint) lies in its scope: less than ``SCOPE`` code points
between the two.

The parts of a text are lists of intervals, and the interval join stays within the row, so nothing is
shuffled.  It sorts the starts of one list and the bounds of the other together and carries the greatest end
along: an interval that begins before a bound reaches past a point if the greatest end there does.  So its cost
is that of sorting, however many parts a text has.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unused

#: The patterns of the base findings.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
ASSIGN_LEAST = 12
#: Weak parts, and what complements them.
WEAK_LEAST = 6
BARE = r"(?<![A-Za-z0-9+/=])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])"
IDENTIFIER = r"""(?i)(?<![A-Za-z0-9_])(user|username|login|account|client_id|access_key_id)["']?\x20{0,4}[:=]\x20{0,4}["']?([A-Za-z0-9._@+-]{3,})"""
ENDPOINT = r"(?i)(?<![A-Za-z0-9_])(?:https?|jdbc:[a-z]{2,12}|postgres(?:ql)?|mysql|mongodb|redis|amqp|ftp)://[^\s\"'<>]{3,}"
SCOPE = 200

SPANS = "array<struct<s:int,e:int,n:int>>"
#: Values that ``running`` takes one by one; above, it takes as many at a time.
STRIDE = 256


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _scan(values: Column, first: int, join: Callable[[Column, Column], Column]) -> Column:
    """Running results of ``join`` over a short array."""
    nothing = F.struct(F.lit(first).alias("at"), F.array().cast("array<int>").alias("out"))

    def step(acc, x):
        return _let(join(acc["at"], x), lambda at: F.struct(at.alias("at"), F.concat(acc["out"], F.array(at)).alias("out")))

    return F.aggregate(values, nothing, step, lambda acc: acc["out"])


def running(values: Column, first: int, join: Callable[[Column, Column], Column]) -> Column:
    """Running results of an associative ``join`` over an array of numbers, each element included.

    Growing arrays cost their squares, so each stride is run over alone, and its numbers are joined with what
    the strides before come to.
    """
    stride = F.lit(STRIDE)

    def whole(values):
        starts = F.sequence(F.lit(1), F.greatest(F.size(values), F.lit(1)), stride)
        return _let(F.transform(starts, lambda at: _scan(F.slice(values, at, stride), first, join)), joined)

    def joined(parts):
        before = _scan(F.transform(parts, lambda p: F.coalesce(F.try_element_at(p, F.lit(-1)), F.lit(first))), first, join)
        return _let(before, lambda b: F.flatten(F.transform(parts, lambda p, i: _let(F.when(i > 0, F.get(b, i - 1)).otherwise(F.lit(first)), lambda base: F.transform(p, lambda x: join(base, x))))))

    return _let(values, whole)


def _plus(a: Column, b: Column) -> Column:
    return a + b


def find(text: Column, pattern: str, group: int = 0) -> Column:
    """The matches of ``pattern``, leftmost and not overlapping: (start, end, length of ``group``), in code points, end exclusive.

    Matches and what lies between them alternate, so ends are running sums of their lengths.
    """
    regex = F.lit(pattern)
    lengths = lambda of: F.transform(F.regexp_extract_all(text, regex, F.lit(of)), F.char_length)

    def spans(whole, parts):
        gaps = F.slice(F.transform(F.split(text, pattern, -1), F.char_length), 1, F.size(whole))
        ends = running(F.zip_with(whole, gaps, _plus), 0, _plus)
        return F.transform(F.arrays_zip(ends.alias("e"), whole.alias("w"), parts.alias("n")), lambda x: F.struct((x["e"] - x["w"]).alias("s"), x["e"].alias("e"), x["n"].alias("n")))

    found = _let(lengths(0), lambda whole: spans(whole, lengths(group) if group else whole))
    return F.when(text.rlike(pattern), found).otherwise(F.array()).cast(SPANS)


def with_reach(spans: Column, parts: Column, before: Callable[[Column], Column]) -> Column:
    """The interval join: ``spans`` (s, e) with ``m``, the greatest end of the ``parts`` that start before ``before(span)``; -1 if none does."""
    bounds = F.transform(spans, lambda x: F.struct(before(x).alias("p"), F.lit(0).alias("k"), F.lit(-1).alias("m"), x["s"].alias("s"), x["e"].alias("e")))
    starts = F.transform(parts, lambda y: F.struct(y["s"].alias("p"), F.lit(1).alias("k"), y["e"].alias("m"), F.lit(0).alias("s"), F.lit(0).alias("e")))

    def swept(events):
        reach = running(F.transform(events, lambda x: x["m"]), -1, lambda a, b: F.greatest(a, b))
        asked = F.filter(F.arrays_zip(events.alias("x"), reach.alias("m")), lambda z: z["x"]["k"] == 0)
        return F.transform(asked, lambda z: F.struct(z["x"]["s"].alias("s"), z["x"]["e"].alias("e"), z["m"].alias("m")))

    return _let(F.array_sort(F.concat(bounds, starts)), swept)


def _bare(spans: Column) -> Column:
    return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(0).alias("n"))).cast(SPANS)


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that no later step computes again: a generator is not merged with what reads it."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(name) for name, c in columns.items())))))


def scan(docs: DataFrame, text: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with a struct of ``assign, access, hex, weak``, lists of (s, e, n) in each text, and the struct's name.

    Null and empty texts have empty lists; an empty table stays empty.
    """
    steps = [unused(docs, name) for name in ("found_base", "found_faint", "found_parts", "found")]
    base, faint, parts, found = map(F.col, steps)
    t = F.coalesce(F.col(text), F.lit(""))
    every = {"named": find(t, ASSIGN, 2), "access": find(t, ACCESS), "hex": find(t, HEX), "bare": find(t, BARE)}
    out = _once(docs, **{steps[0]: F.struct(*(c.alias(k) for k, c in every.items()))})
    assign = F.filter(base["named"], lambda x: x["n"] >= ASSIGN_LEAST)
    short = F.filter(base["named"], lambda x: (x["n"] >= WEAK_LEAST) & (x["n"] < ASSIGN_LEAST))
    # a bare token inside a base finding is none of its own
    alone = F.filter(with_reach(base["bare"], F.concat(assign, base["hex"]), lambda x: x["s"] + 1), lambda x: x["m"] < x["e"])
    alone = F.when(F.size(base["bare"]) > 0, _bare(alone)).otherwise(F.array().cast(SPANS))
    out = _once(out, **{steps[1]: F.struct(assign.alias("assign"), F.concat(short, alone).alias("faint"))})
    complements = F.concat(find(t, IDENTIFIER), find(t, ENDPOINT), base["access"])
    out = _once(out, **{steps[2]: F.when(F.size(faint["faint"]) > 0, complements).otherwise(F.array().cast(SPANS))})
    linked = F.filter(with_reach(faint["faint"], parts, lambda x: x["e"] + SCOPE), lambda x: (x["m"] >= 0) & (x["m"] + SCOPE > x["s"]))
    weak = F.when(F.size(parts) > 0, _bare(linked)).otherwise(F.array().cast(SPANS))
    out = _once(out, **{steps[3]: F.struct(faint["assign"].alias("assign"), base["access"].alias("access"), base["hex"].alias("hex"), weak.alias("weak"))})
    return out.drop(*steps[:3]), steps[3]


#: The kinds, in the order in which spans that start together are written.
KINDS = ("assign", "access", "hex", "weak")


def _named(spans: Column, kind: str, order: int) -> Column:
    return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(order).alias("o"), x["e"].alias("e"), F.lit(kind).alias("k")))


def _written(found: Column, kinds: tuple[str, ...]) -> Column:
    named = F.concat(*(_named(found[k], k, o) for o, k in enumerate(kinds)))
    return F.array_join(F.transform(F.array_sort(named), lambda x: F.concat_ws(":", x["k"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def secret_report(docs: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_weak`` for each row of ``docs``.

    ``spans`` has the base findings and the linked weak ones (kind ``weak``).  Null and empty texts have
    none: counts 0, the digest of the empty string, empty ``spans``.  Repeated rows give repeated rows; an
    empty table gives an empty result; further columns are not read.
    """
    out, name = scan(docs.select("doc_id", "text"))
    found = F.col(name)
    n = lambda kind: F.size(found[kind]).cast("long").alias(f"n_{kind}")
    return out.select(
        "doc_id", n("assign"), n("access"), n("hex"),
        F.sha2(_written(found, KINDS[:3]).cast("binary"), 256).alias("base_sha256"),
        _written(found, KINDS).alias("spans"), n("weak"),
    )


def masked(text: Column, spans: Column, mark: str) -> Column:
    """``text`` with each run of overlapping ``spans``, of which there is one at least, replaced by ``mark``.

    The text is cut into characters once, and what lies between the runs is put together from them.
    """

    def around(runs):
        # each span with the greatest end before it: where that is not past its start, a run begins
        ends = running(F.transform(runs, lambda x: x["e"]), 0, lambda a, b: F.greatest(a, b))
        return _let(ends, lambda ends: kept(runs, ends))

    def kept(runs, ends):
        before = F.concat(F.array(F.lit(0)), F.slice(ends, 1, F.size(ends) - 1))
        gaps = F.filter(F.zip_with(before, runs, lambda b, x: F.struct(b.alias("a"), x["s"].alias("b"))), lambda g: g["b"] >= g["a"])
        gaps = F.concat(gaps, F.array(F.struct(F.element_at(ends, -1).alias("a"), F.char_length(text).alias("b"))))
        characters = F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))
        return _let(characters, lambda c: F.array_join(F.transform(gaps, lambda g: F.array_join(F.slice(c, g["a"] + 1, g["b"] - g["a"]), "")), mark))

    return _let(F.array_sort(spans), around)


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """All columns of ``docs``, with each run of overlapping findings in ``text`` replaced by ``mark`` and ``n_chars`` counted anew.

    Texts without findings, and null and empty texts, stay as they are.  Repeated rows stay repeated, and an
    empty table empty; columns of any name may be there.
    """
    columns = docs.columns
    out, name = scan(docs)
    spans = F.concat(*(F.col(name)[k] for k in KINDS))
    any_there = sum((F.size(F.col(name)[k]) for k in KINDS), F.lit(0)) > 0
    new = unused(out, "redacted")
    out = _once(out, **{new: F.when(any_there, masked(F.col("text"), spans, mark))})
    changed = {"text": F.coalesce(F.col(new), F.col("text"))}
    if "n_chars" in columns:
        changed["n_chars"] = F.when(F.col(new).isNotNull(), F.char_length(new).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.select(*(changed.get(c, F.col(f"`{c}`")).alias(c) for c in columns))
