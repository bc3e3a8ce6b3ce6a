"""Operator 11: embedding whitening with exact covariance.

1. Vectors become whole numbers, and each distinct one is kept once (the fit list).
2. Sums of every dimension are exact: whole numbers travel as signed limbs in long columns, which Spark adds up.
3. Each task centres its vectors as n * x - S, exact whole numbers, and cuts them into limbs of so few bits that a
   float64 product of limb matrices over a block of rows has no rounding: the matrix products are BLAS's, and exact.
   The products of limbs are put together to big integers, cut into 32-bit limbs again and added up by Spark,
   an entry of the matrix to a row.
4. The driver holds one number an entry, dimensions squared, and takes the eigenvectors of that matrix.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..workspace import keep
from .common import unused

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Rows of one exact product, and bits of a limb: 2 * LIMB + log2(BLOCK) <= 53.
BLOCK, LIMB = 4096, 20
#: Greatest absolute value of a whole number before the shift.
CLAMP = 1 << 62
LONG = 1 << 63


def whole_vectors(vectors: DataFrame, column: str = "embedding", scale: int = SCALE, id_column: str = "vec_id") -> DataFrame:
    """``vec_id, y``: floor(scale * c) of each entry c, for the rows whose vector is not null and has finite entries only.

    Beyond 2 ** 62 numbers are held there.  Empty vectors are left out as well.
    """
    v = F.col(f"`{column}`")
    return vectors.where(_good(v)).select(F.col(f"`{id_column}`").alias("vec_id"), _whole(v, scale).alias("y"))


def _good(v: Column) -> Column:
    """Whether a vector is there, has entries, and all of them are finite."""
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != F.lit(float("inf"))))
    return F.coalesce((F.size(v) > 0) & finite, F.lit(False))


def _whole(v: Column, scale: int) -> Column:
    return F.transform(v, lambda c: F.greatest(F.least(F.floor(c.cast("double") * scale), F.lit(CLAMP)), F.lit(-CLAMP)).cast("long"))


# -- big integers as columns of longs --------------------------------------------------------------


def limbs(numbers: list[int]) -> list[list[int]]:
    """Signed whole numbers as lists of 32-bit limbs, the lowest first; the sign is that of every limb."""
    out = []
    for n in numbers:
        sign, n, own = (-1 if n < 0 else 1), abs(n), []
        while n:
            own.append(sign * (n & 0xFFFFFFFF))
            n >>= 32
        out.append(own)
    return out


def joined(parts: list[int]) -> int:
    return sum(v << (32 * i) for i, v in enumerate(parts))


def added(partial: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, limb, total`` of ``keys, limbs``: limbs of each place are added up; a sum of 2 ** 31 tasks fits a long."""
    return partial.select(*keys, F.posexplode("limbs").alias("limb", "v")).groupBy(*keys, "limb").agg(F.sum("v").alias("total"))


def numbers(sums: DataFrame, keys: list[str]) -> dict[tuple, int]:
    """Big integers by their keys, on the driver."""
    out: dict[tuple, int] = {}
    for r in sums.collect():  # a few limbs for each dimension, or pair of dimensions
        k = tuple(r[c] for c in keys)
        out[k] = out.get(k, 0) + (r["total"] << (32 * r["limb"]))
    return out


# -- exact products --------------------------------------------------------------------------------


def centred(y: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * y - S: of int64 where that holds all, else of Python's integers."""
    q = [s // n for s in sums]
    r = [s - n * k for s, k in zip(sums, q, strict=True)]
    near = y - np.array(q, dtype=np.int64)  # of numbers up to 2 ** 62: no overflow
    top = max(int(near.max(initial=0)), -int(near.min(initial=0)))
    if (top + 1) * n < 1 << 62:
        return near * n - np.array(r, dtype=np.int64)
    return near.astype(object) * n - np.array(r, dtype=object)


def exact_gram(d: np.ndarray) -> np.ndarray:
    """d'd of whole numbers as Python's integers, from float64 products of their limbs."""
    total = np.zeros((d.shape[1], d.shape[1]), dtype=object)
    for at in range(0, len(d), BLOCK):
        block = d[at : at + BLOCK]
        sign, rest, parts = np.sign(block), abs(block), []
        while rest.any():
            parts.append((sign * (rest & ((1 << LIMB) - 1))).astype(np.float64))
            rest = rest >> LIMB
        for i, a in enumerate(parts):
            for j, b in enumerate(parts[: i + 1]):
                product = (a.T @ b).astype(np.int64).astype(object)  # below 2 ** 53: exact
                total += (product if i == j else product + product.T) << (LIMB * (i + j))
    return total


def _stacked(batch: pa.RecordBatch, column: str) -> np.ndarray:
    values = batch.column(column)
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)


def _sums(fit: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            lengths = np.diff(batch.column("y").offsets.to_numpy())
            for size in np.unique(lengths):
                y = _stacked(batch.filter(pa.array(lengths == size)), "y")
                held = found.setdefault(int(size), [0, np.zeros(int(size), dtype=object)])
                held[0] += len(y)
                held[1] += (y >> 32).sum(axis=0).astype(object) * (1 << 32) + (y & 0xFFFFFFFF).sum(axis=0).astype(object)
        for size, (n, s) in found.items():
            dims = [-1, *range(size)]  # -1: how many vectors there are
            yield pa.RecordBatch.from_arrays([pa.array([size] * len(dims), pa.int64()), pa.array(dims, pa.int64()), pa.array(limbs([n, *map(int, s)]), pa.list_(pa.int64()))], ["size", "dim", "limbs"])

    return fit.mapInArrow(run, "size long, dim long, limbs array<long>")


@dataclass(frozen=True)
class Whitening:
    """What the fit list gives: ``n``, the sums (before the shift), and of each component its vector, eigenvalue and share."""

    n: int
    size: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    identity_error: float | None = None

    def project(self, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact n * x - S, and the whitened values, NaN for a component that has no variance."""
        d = centred(y, self.n, self.sums)
        root = np.sqrt(np.where(self.values > 0, self.values, np.nan))
        return d, (d.astype(np.float64) / self.n) @ self.vectors / root


def components_of(gram: list[list[int]], n: int, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit eigenvectors (columns) of gram / n**3 by falling eigenvalue, eigenvalues, shares of the trace.

    Eigenvalues that rounding cannot tell from zero are zero.  Of either sign the vector whose entry of greatest size is positive.
    """
    size, trace = len(gram), sum(gram[i][i] for i in range(len(gram)))
    if not trace:
        return np.eye(size)[:, :count], np.zeros(min(count, size)), np.zeros(min(count, size))
    share = np.array([[v / trace for v in row] for row in gram])  # each a correctly rounded quotient of big integers
    e, u = np.linalg.eigh(share)
    e, u = e[::-1][:count], u[:, ::-1][:, :count]
    e = np.where(e > size * np.finfo(float).eps * e[0], e, 0.0)
    u = u * np.where(u[abs(u).argmax(axis=0), np.arange(u.shape[1])] < 0, -1.0, 1.0)
    return u, e * (trace / n**3), e


def fit(whole: DataFrame, count: int = COMPONENTS) -> tuple[Whitening | None, DataFrame]:
    """The whitening of ``vec_id, y``, and the fit list (kept).  None where there is no vector.

    Vectors of another length than most of the distinct ones (of equals the longer) have no part in it.
    """
    distinct = keep(whole.select("y").distinct(), "fit-list")
    found = numbers(added(_sums(distinct), ["size", "dim"]), ["size", "dim"])
    counts = {size: n for (size, dim), n in found.items() if dim == -1}
    if not counts:
        return None, distinct
    size = max(counts, key=lambda s: (counts[s], s))
    n, sums = counts[size], [found.get((size, d), 0) for d in range(size)]
    listed = distinct.where(F.size("y") == size)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size), dtype=object)
        for batch in batches:
            total += exact_gram(centred(_stacked(batch, "y"), n, sums))
        i, j = np.tril_indices(size)
        for at in range(0, len(i), 10_000):
            a, b = i[at : at + 10_000], j[at : at + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(limbs([int(v) for v in total[a, b]]), pa.list_(pa.int64()))], ["i", "j", "limbs"])

    entries = numbers(added(listed.mapInArrow(products, "i long, j long, limbs array<long>"), ["i", "j"]), ["i", "j"])
    gram = [[entries.get((max(i, j), min(i, j)), 0) for j in range(size)] for i in range(size)]
    model = Whitening(n, size, sums, *components_of(gram, n, count))
    return replace(model, identity_error=identity_error(listed, model)), distinct


def identity_error(listed: DataFrame, model: Whitening) -> float:
    """The greatest absolute entry of the whitened fit list's covariance less the identity, over components that have variance.

    Each task gives its count, means and centred products; these are merged pair by pair (a row a task).
    """
    live = model.values > 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            w = model.project(_stacked(batch, "y"))[1][:, live]
            mean = w.mean(axis=0)
            held = _merged(held, (len(w), mean, (w - mean).T @ (w - mean)))
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([held[0]], pa.int64()), pa.array([held[1].tolist()], pa.list_(pa.float64())), pa.array([held[2].ravel().tolist()], pa.list_(pa.float64()))], ["n", "mean", "products"])

    if not live.any():
        return 0.0
    held, k = None, int(live.sum())
    for r in listed.mapInArrow(run, "n long, mean array<double>, products array<double>").collect():
        held = _merged(held, (r["n"], np.array(r["mean"]), np.array(r["products"]).reshape(k, k)))
    return float(abs(held[2] / held[0] - np.eye(k)).max())


def _merged(a, b):
    """Count, means and centred products of two sets of rows together."""
    if a is None:
        return b
    n, gap = a[0] + b[0], b[1] - a[1]
    return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] * b[0] / n)


def whiten(vectors: DataFrame, column: str = "embedding", count: int = COMPONENTS, scale: int = SCALE, id_column: str = "vec_id") -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``: a row for each good vector and each component, of at most ``count``.

    Left out: rows whose vector is null or empty or has an entry that is null or not finite, and rows whose vector has another
    length than most distinct ones.  Repeated rows and rows without an id have their own results.  ``deviation`` is null where
    it does not fit a long; ``whitened`` is null for a component without variance, whose ``explained`` is 0.
    Other columns are not read.  An empty table gives an empty result.
    """
    whole = whole_vectors(vectors, column, scale, id_column)
    model, _ = fit(whole, count)
    types = f"vec_id {dict(whole.dtypes)['vec_id']}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return vectors.sparkSession.createDataFrame([], types)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, w = model.project(_stacked(batch, "y"))
            rows, k = w.shape
            if d.dtype == np.int64 and model.size * max(abs(int(d.min(initial=0))), abs(int(d.max(initial=0)))) ** 2 < LONG:
                deviation = (d * d).sum(axis=1).tolist()
            else:
                deviation = [s if s < LONG else None for s in (sum(int(v) ** 2 for v in row) for row in d)]
            yield pa.RecordBatch.from_arrays([
                batch.column("vec_id").take(pa.array(np.repeat(np.arange(rows), k))),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                pa.array(np.full(rows * k, model.n)),
                pa.array(deviation, pa.int64()).take(pa.array(np.repeat(np.arange(rows), k))),
                pa.array(w.ravel(), mask=np.isnan(w.ravel())),
                pa.array(np.tile(model.explained, rows)),
                pa.array(np.full(rows * k, model.identity_error)),
            ], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return whole.where(F.size("y") == model.size).mapInArrow(run, types)


def whitened_vectors(vectors: DataFrame, column: str = "embedding", count: int = COMPONENTS, scale: int = SCALE, id_column: str = "vec_id", alias: str = "whitened") -> DataFrame:
    """``vectors``, the rows that ``whiten`` leaves out without a value, with ``alias``: the whitened vector as an array.

    Rows are not joined: every row is projected where it is.  If there is a column of that name already, underscores are added.
    """
    alias, extra = unused(vectors, alias), unused(vectors, "__y")
    model, _ = fit(whole_vectors(vectors, column, scale, id_column), count)
    if model is None:
        return vectors.withColumn(alias, F.lit(None).cast("array<double>"))

    @F.pandas_udf("array<double>")
    def project(y):
        import pandas as pd

        out = np.full(len(y), None, dtype=object)
        fits = np.array([v is not None and len(v) == model.size for v in y], dtype=bool)
        if fits.any():
            out[np.flatnonzero(fits)] = list(model.project(np.stack(list(y[fits])).astype(np.int64))[1])
        return pd.Series(out)

    v = F.col(f"`{column}`")
    return vectors.withColumn(extra, F.when(_good(v), _whole(v, scale))).withColumn(alias, project(extra)).drop(extra)
