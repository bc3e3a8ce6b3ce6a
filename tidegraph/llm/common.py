"""What the text operators share: Arrow mapping over documents and bounded caches."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: The white space of the contracts: [\x20\x09-\x0D].
WHITE = " \t\n\x0b\f\r"


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def map_texts(docs: DataFrame, work: Callable[[list, list[str]], dict], fields: list[T.StructField], keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Run ``work(rows of the kept columns, texts)`` over Arrow batches of ``docs``.

    A null text is passed as the empty string.  ``work`` returns a dict of columns for ``fields``;
    with the key ``"take"`` it may also give the input row each output row belongs to (else one
    output row per input row, in order).  Other columns of ``docs`` are never read.
    """
    narrow = docs.select(*keep, F.coalesce(F.col("text"), F.lit("")).alias("text"))
    schema = T.StructType([narrow.schema[k] for k in keep] + fields)
    arrow = to_arrow_schema(schema)
    first = keep[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in _slices(batch):
                out = work(piece.column(first).to_pylist(), piece.column("text").to_pylist())
                take = out.pop("take", None)
                kept = [piece.column(k) for k in keep]
                if take is not None:
                    kept = [c.take(pa.array(take, pa.int64())) for c in kept]
                columns = [c.cast(arrow.field(k).type) for k, c in zip(keep, kept, strict=True)]
                columns += [pa.array(out[f.name], arrow.field(f.name).type) for f in fields]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return narrow.mapInArrow(run, schema)


def _slices(batch: pa.RecordBatch, rows: int = 1024, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of at most so many rows, and so many bytes of text unless one row has more: the Python objects of only a few rows exist at a time."""
    sizes = pc.binary_length(batch.column("text")).to_pylist()
    start = held = 0
    for at, n in enumerate(sizes):
        if at - start == rows or (at > start and held + n > size):
            yield batch.slice(start, at - start)
            start, held = at, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


class BoundedCache(dict):
    """A dict that computes missing values and holds at most ``limit`` of them, those used lately.

    It has two halves: when the newer one is full it becomes the older one, whose values are moved back as they
    are asked for.  What is forgotten is computed anew, so the bound changes cost, never results.
    """

    def __init__(self, make: Callable, limit: int, longest: int = 64):
        super().__init__()
        self._make, self._half, self._longest = make, limit // 2, longest
        self.older: dict = {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self._make(key)
        if len(key) <= self._longest:
            self[key] = value
            self._turn()
        return value

    def among(self, keys, make: Callable) -> dict:
        """The values of distinct keys; ``make`` gives those of all that are not held, as a dict."""
        found = {k: self.get(k) for k in keys}
        new = {k: self.older.get(k) for k, v in found.items() if v is None}
        new.update(make([k for k, v in new.items() if v is None]))
        found.update(new)
        self.update((k, v) for k, v in new.items() if len(k) <= self._longest)
        self._turn()
        return found

    def _turn(self) -> None:
        if len(self) >= self._half:
            self.older = dict(self)
            self.clear()


_RESIDENT: dict = {}


def resident(name, make: Callable):
    """What ``make`` gives, held by this worker until another name is asked for.

    Workers outlive a stage: so the caches of one operator are gone when the next one runs in the same worker.
    """
    if name not in _RESIDENT:
        if _RESIDENT:
            _RESIDENT.clear()
            gc.collect()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc: gives freed memory back
                trim(0)
        _RESIDENT[name] = make()
    return _RESIDENT[name]
