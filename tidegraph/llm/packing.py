"""Operator 6: best-fit packing with swap-based local search.

Documents become token pieces of at most ``CAPACITY``.  Pieces are dealt evenly into groups of bounded size,
each packed by one task: best fit, longest first, and then local search over the bins that are not full.  The
search takes the emptiest bin and moves its documents out, or exchanges one or two of them for a shorter one
of a fuller bin; each step raises the sum of squared fills, and a bin that runs empty is gone.  It goes on until
no bin has a step or the group has as few bins as its tokens need.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.taskcontext import TaskContext

from ..workspace import keep
from .bpe import WordBpe
from .common import BoundedCache, map_texts, resident

CAPACITY, END = 2048, 0
GROUP = 20_000
#: Chunks whose ids a worker holds: about 250 bytes each.
RECENT_CHUNKS = 1_000_000


class LibraryIds(WordBpe):
    """Ids by the tokenizers library; chunks between white space that have been seen are looked up."""

    def __init__(self, path: str, cached: int = RECENT_CHUNKS):
        from tokenizers import Tokenizer

        # only what cutting needs: the tables for merging stay out of a packing worker's memory
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self._marks = [t.content[:2] for t in self.library.get_added_tokens_decoder().values()]
        self._ids = BoundedCache(None, cached)

    def many(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        rows, chunks, codes, stops = self.factorised(texts)
        made = self._ids.among(chunks, self._encoded)
        ids = [made[c] for c in chunks]
        sizes = np.array([len(b) >> 2 for b in ids], dtype=np.int64)
        starts = np.cumsum(sizes) - sizes
        lengths = sizes[codes]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        # each chunk's ids lie together: from where they begin, counting on
        place = np.repeat(starts[codes] - ends[:-1], lengths) + np.arange(ends[-1])
        flat = np.frombuffer(b"".join(ids), dtype="<u4")[place]
        bounds = ends[stops]
        out: list = [None] * len(texts)
        for i, first, last in zip(rows, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            out[i] = flat[first:last].tobytes()
        return [self.whole(t) if b is None else b for t, b in zip(texts, out, strict=True)]

    def _encoded(self, chunks: list[str]) -> dict[str, bytes]:
        """Ids of distinct chunks: many are encoded as one text, and its ids are cut where the chunks' characters are."""
        out: dict[str, bytes] = {}
        for start in range(0, len(chunks), 512):  # an encoding is much larger than its ids
            part = chunks[start : start + 512]
            coded = self.library.encode(" ".join(part), add_special_tokens=False)
            ends = np.cumsum([len(c) + 1 for c in part])
            stops = 4 * np.searchsorted([first for first, _ in coded.offsets], ends)
            ids, before = np.array(coded.ids, dtype="<u4").tobytes(), 0
            for chunk, stop in zip(part, stops.tolist(), strict=True):
                out[chunk] = ids[before:stop]
                before = stop
        return out

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


def library(path: str, cached: int = RECENT_CHUNKS) -> LibraryIds:
    return resident(("packing", path, cached), lambda: LibraryIds(path, cached))


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False, cached: int = RECENT_CHUNKS) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` (and ``ids``, little-endian unsigned 32-bit): each document's ids and END, cut only where longer than ``capacity``.

    A null or empty text has the one id END.
    """
    fields = [T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    fields += [T.StructField("ids", T.BinaryType())] * with_ids
    end = np.array([END], dtype="<u4").tobytes()

    def work(_, texts):
        out = {"take": [], "piece": [], "start": [], "length": [], "ids_crc32": []} | ({"ids": []} if with_ids else {})
        for row, ids in enumerate(library(path, cached).many(texts)):
            ids += end
            for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                part = ids[at : at + 4 * capacity]
                out["take"].append(row)
                out["piece"].append(piece)
                out["start"].append(at // 4)
                out["length"].append(len(part) // 4)
                out["ids_crc32"].append(zlib.crc32(part))
                if with_ids:
                    out["ids"].append(part)
        return out

    return map_texts(docs, work, fields)


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item numbers: longest first, each into the fullest bin that has room."""
    bins: list[list[int]] = []
    room: list[int] = []  # sorted room of open bins, and their numbers by room
    by_room: dict[int, list[int]] = {}
    for item in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[item])
        k = bisect_left(room, n)
        if k == len(room):
            b, left = len(bins), capacity
            bins.append([])
        else:
            left = room[k]
            b = by_room[left].pop()
            if not by_room[left]:
                del by_room[left], room[k]
        bins[b].append(item)
        if left := left - n:
            if left not in by_room:
                by_room[left] = []
                insort(room, left)
            by_room[left].append(b)
    return bins


def local_search(bins: list[list[int]], lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Empty bins by moves, one-for-one and two-for-one exchanges, until none helps or no fewer bins can hold the items.

    Each step moves tokens out of the emptiest bin that has one to a bin at least as full, which raises the sum of
    squared fills, so the search ends.  A bin without a step is set aside, and tried again as long as others change.
    """
    least = math.ceil(int(lengths.sum()) / capacity)
    count, changed = len(bins), False
    fills = np.array([int(lengths[b].sum()) for b in bins], dtype=np.int64)
    home = np.empty(len(lengths), dtype=np.int64)
    for b, items in enumerate(bins):
        home[items] = b
    aside = np.zeros(len(bins), dtype=bool)
    members = [set(b) for b in bins]

    def move(item: int, to: int) -> None:
        source = home[item]
        members[source].discard(item)
        members[to].add(item)
        fills[source] -= lengths[item]
        fills[to] += lengths[item]
        home[item] = to

    while count > least:
        alive = np.flatnonzero((fills > 0) & (fills < capacity) & ~aside)
        if not len(alive):
            if not changed:
                break  # no bin has a step
            aside[:], changed = False, False
            continue
        poorest = int(alive[np.argmin(fills[alive])])
        others = np.flatnonzero((fills >= fills[poorest]) & (fills < capacity))
        others = others[others != poorest]
        step = _step(poorest, others, members, fills, home, lengths, capacity) if len(others) else None
        if step is None:
            aside[poorest] = True
            continue
        changed = True
        out, back, to = step
        for item in out:
            move(item, to)
        if back is not None:
            move(back, poorest)
        if fills[poorest] == 0:
            count -= 1
    return [sorted(m) for m in members if m]


def _step(poorest, others, members, fills, home, lengths, capacity):
    """The step that moves most tokens out of a bin: (items out, item back or None, bin to)."""
    room = capacity - fills[others]
    mine = sorted(members[poorest], key=lambda i: -lengths[i])
    most = room.max()
    for item in mine:  # move whole documents, to the fullest bin that takes them
        if lengths[item] <= most:
            fits = room >= lengths[item]
            return (item,), None, int(others[fits][np.argmin(room[fits])])
    open_bin = np.zeros(len(fills), dtype=bool)
    open_bin[others] = True
    there = np.flatnonzero(open_bin[home])
    limit = (capacity - fills[home[there]]) + lengths[there]  # the most that can take the item's place
    shortest = np.full(capacity + 1, capacity + 1, dtype=np.int64)  # of the items with a limit of at least so much
    np.minimum.at(shortest, limit, lengths[there])
    shortest = np.minimum.accumulate(shortest[::-1])[::-1]
    by_length: dict[int, list[int]] = {}  # items of one length are alike, and a bin has few lengths
    for i in mine:
        by_length.setdefault(int(lengths[i]), []).append(i)
    kinds = list(by_length)
    sums = [((n,), n) for n in kinds] + [((a, b), a + b) for k, a in enumerate(kinds) for b in kinds[k:] if a != b or len(by_length[a]) > 1]
    parts, n = max(sums, key=lambda s: s[1] - shortest[s[1]])
    if n <= shortest[n]:
        return None
    k = int(there[np.flatnonzero((limit >= n) & (lengths[there] == shortest[n]))[0]])
    out = (by_length[parts[0]][0],) if len(parts) == 1 else (by_length[parts[0]][0], by_length[parts[1]][1 if parts[0] == parts[1] else 0])
    return out, k, int(home[k])


def pack_lengths(lengths: np.ndarray, capacity: int = CAPACITY) -> list[list[int]]:
    """Bins of item numbers for lengths of at most ``capacity``."""
    if not len(lengths):
        return []
    return local_search(best_fit(lengths, capacity), lengths, capacity)


def pack(cut: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """``cut`` (rows with ``length``) with ``sequence_id`` and ``offset``.

    Rows are dealt round by round, so groups have the same size however the keys are spread, and a group
    fits one task.  Rows are written first: their number decides the number of groups.
    """
    cut = keep(cut, "pieces")
    groups = max(1, math.ceil(cut.count() / group))
    schema = T.StructType([*cut.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if table is None or not table.num_rows:
            return
        lengths = table["length"].to_numpy().astype(np.int64)
        ids, offsets = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
        first = TaskContext.get().partitionId() << 40
        for k, items in enumerate(pack_lengths(lengths, capacity)):
            at = 0
            for i in items:
                ids[i], offsets[i] = first + k, at
                at += int(lengths[i])
        table = table.append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offsets))
        yield from table.cast(arrow).to_batches()

    return cut.repartition(groups).mapInArrow(run, schema)


def packing_report(docs: DataFrame, path: str, cached: int = RECENT_CHUNKS) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset``: one row for each piece of each row of ``docs``.

    Null and empty texts are one piece of length 1.  Repeated rows are packed each; an empty table gives an
    empty result; further columns are not read.  ``cached`` trades a worker's memory for time.
    """
    return pack(pieces(docs, path, cached=cached))
