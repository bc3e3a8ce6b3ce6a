"""Scalar and vector expressions over columns: all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PADDING = -1


def bucket(t: Column, factor: float, exact: tuple[int, int] | None = None) -> Column:
    """The tick of a coarser granularity: floor of ``t`` times a double, or with ``exact`` (num, den) of whole numbers.

    The double product can fall one below at a bucket's first tick, as a 30-day month of seconds does.
    """
    if exact:
        scaled = t * exact[0]
        return ((scaled - F.pmod(scaled, F.lit(exact[1]))) / exact[1]).cast("long")
    return F.floor(t.cast("double") * F.lit(factor)).cast("long")


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def tanh(x: Column) -> Column:
    return F.tanh(x)


def relu(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def min_max(v: Column, low: Column, high: Column, to_low: float = 1.0, to_high: float = 10.0) -> Column:
    """Scale to [to_low, to_high]; where low equals high, to_low."""
    return F.coalesce(to_low + (to_high - to_low) * F.try_divide(v - low, high - low), F.lit(to_low))


def time2vec_weights(dim: int) -> list[float]:
    """10 to the power of -linspace(0, 9, dim)."""
    return [10 ** -(9 * i / (dim - 1) if dim > 1 else 0.0) for i in range(dim)]


def time2vec(dt: Column, weights: list[float], biases: list[float] | None = None) -> Column:
    """cos(w * dt + b) for each frequency."""
    return F.array(*(F.cos(F.lit(float(w)) * dt + F.lit(float(b))) for w, b in zip(weights, biases or [0.0] * len(weights), strict=True)))


def vector_sum(a: Column, b: Column) -> Column:
    """Element-wise sum of two vectors of one length."""
    return F.zip_with(a, b, lambda x, y: x + y)


def merge_concat(a: Column, b: Column) -> Column:
    return F.concat(a, b)


def merge_weighted(a: Column, b: Column, weight_a: float = 1.0, weight_b: float = 1.0) -> Column:
    """Element-wise weighted sum of two vectors."""
    return F.zip_with(a, b, lambda x, y: weight_a * x + weight_b * y)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x * y).cast("double")), F.lit(0.0), lambda s, x: s + x)


def softmax(scores: Column, valid: Column | None = None) -> Column:
    """Softmax of an array; elements whose ``valid`` is false count as -1e10."""
    masked = scores if valid is None else F.zip_with(scores, valid, lambda s, v: F.when(v, s).otherwise(F.lit(-1e10)))
    top = F.array_max(masked)
    raised = F.transform(masked, lambda s: F.exp(s - top))
    total = F.aggregate(raised, F.lit(0.0), lambda s, x: s + x)
    return F.transform(raised, lambda x: x / total)


def pad_left(values: Column, k: int, filler: Column) -> Column:
    """The last ``k`` of an array, with fillers before them up to ``k``."""
    return F.concat(F.array_repeat(filler, F.greatest(F.lit(k) - F.size(values), F.lit(0))), F.slice(values, F.greatest(F.size(values) - k + 1, F.lit(1)), k))


def pad_right(values: Column, k: int, filler: Column) -> Column:
    return F.concat(F.slice(values, 1, k), F.array_repeat(filler, F.greatest(F.lit(k) - F.size(values), F.lit(0))))


def hashed(*parts: Column | str | int) -> Column:
    """A 31-bit number that depends on the parts alone, by products and remainders that every SQL engine has."""
    state = F.lit(7).cast("long")
    for p in parts:
        c = F.lit(p) if isinstance(p, int) else (F.col(p) if isinstance(p, str) else p)
        state = F.pmod((F.pmod(state * 1_103_515_245 + 12_345, F.lit(2_147_483_647)) + F.pmod(c.cast("long"), F.lit(2_147_483_647))) * 48_271, F.lit(2_147_483_647))
    return state


def hashed_sql(*parts: str) -> str:
    """``hashed`` as SQL."""
    state = "7::BIGINT"
    for p in parts:
        state = f"((({state}) * 1103515245 + 12345) % 2147483647 + (({p})::BIGINT % 2147483647)) * 48271 % 2147483647"
    return f"({state})"


def scattered(*parts: Column | str | int) -> Column:
    """``hashed``, squared twice: numbers of neighbouring parts have nothing to do with each other, as random signs need."""
    state = hashed(*parts)
    for _ in range(2):
        state = F.pmod(state * state + 12_345 + F.shiftright(state, 16), F.lit(2_147_483_647))
    return state


def scattered_sql(*parts: str) -> str:
    """``scattered`` as SQL."""
    state = hashed_sql(*parts)
    for _ in range(2):
        state = f"(({state} * {state} + 12345 + ({state} >> 16)) % 2147483647)"
    return state


def pretty_number(n: float) -> str:
    """A number in thousands, millions or billions: 1.5K, 2.0M."""
    for size, suffix in ((1e9, "B"), (1e6, "M"), (1e3, "K")):
        if abs(n) >= size:
            return f"{n / size:.1f}{suffix}"
    return str(n)
