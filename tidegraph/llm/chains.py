"""What follows from a place in some bytes, remembered: chains that meet go on as one, so many of them cost no more than the bytes.

Formats are chains of blocks, each of which says where the next one is.  Text may hold very many magic numbers whose chains
run to its end; each chain's blocks are read once for all of them.
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from bisect import bisect_left
from collections.abc import Callable
from functools import cached_property, lru_cache

#: A place that nothing is known of, and the end of a chain that is no format.
UNKNOWN, NONE = -1, -2


class Ends:
    """Where chains end.  ``step(place)`` gives (next place, end): one of them, or neither where the chain breaks."""

    def __init__(self, size: int, step: Callable[[int], tuple[int | None, int | None]]):
        self.size, self.step = size, step
        self.known = array("q", [UNKNOWN]) * (size + 1)

    def of(self, place: int) -> int | None:
        path, end = [], NONE
        while place < self.size:
            if self.known[place] != UNKNOWN:
                end = self.known[place]
                break
            path.append(place)
            follow, stop = self.step(place)
            if follow is None or follow <= place:
                end = NONE if stop is None else stop
                break
            place = follow
        for p in path:
            self.known[p] = end
        return None if end == NONE else end


class Forest:
    """Chains with marks (0, 1, ...) on their blocks: how far a chain goes up to a limit, and the first block of a mark ahead.

    Every block has a pointer far ahead (skew-binary jumps), so a question takes logarithmically many steps.
    """

    def __init__(self, size: int, step: Callable[[int], tuple[int | None, int | None]], marks: int):
        """``step(place)``: the next place or None, and the block's mark or None."""
        self.size, self.step = size, step
        table = lambda: array("q", [UNKNOWN]) * (size + 1)
        self.next, self.jump, self.depth, self.ahead = table(), table(), table(), [table() for _ in range(marks)]

    def grow(self, place: int) -> None:
        path = []
        while place < self.size and self.depth[place] == UNKNOWN:
            follow, mark = self.step(place)
            path.append((place, self.size if follow is None or not place < follow < self.size else follow, mark))
            place = path[-1][1]
        for p, follow, mark in reversed(path):
            self.next[p] = follow
            root = follow == self.size
            self.depth[p] = 0 if root else self.depth[follow] + 1
            if root:
                self.jump[p] = p
            else:
                far = self.jump[follow]
                farther = self.jump[far]
                even = self.depth[follow] - self.depth[far] == self.depth[far] - self.depth[farther]
                self.jump[p] = farther if even else follow
            for k, ahead in enumerate(self.ahead):
                ahead[p] = p if mark == k else NONE if root else ahead[follow]

    def last(self, place: int, limit: int) -> int:
        """The last block of the chain from ``place`` on that begins at ``limit`` or before; ``place`` itself must."""
        self.grow(place)
        while True:
            if place < self.jump[place] <= limit:
                place = self.jump[place]
            elif self.next[place] <= limit and self.next[place] != self.size:
                place = self.next[place]
            else:
                return place


@lru_cache(maxsize=1)
def _zeros() -> list[list[int]]:
    """What a CRC-32 becomes after 2**k zero bytes, as matrices of bits: by squaring, from one bit."""
    bit = [0xEDB88320, *(1 << i for i in range(31))]
    times = lambda m, v: 0 if not v else _product(m, v)
    for _ in range(3):
        bit = [times(bit, row) for row in bit]
    out = [bit]
    while len(out) < 40:
        out.append([times(out[-1], row) for row in out[-1]])
    return out


def _product(matrix: list[int], vector: int) -> int:
    out, i = 0, 0
    while vector:
        if vector & 1:
            out ^= matrix[i]
        vector >>= 1
        i += 1
    return out


class Checksums:
    """CRC-32 of any part of some bytes, from checksums of what stands before every ``STEP``-th byte."""

    STEP = 1 << 12

    def __init__(self, data: bytes):
        self.data, self.before = data, [0]
        for at in range(0, len(data), self.STEP):
            self.before.append(zlib.crc32(data[at : at + self.STEP], self.before[-1]))

    def _upto(self, stop: int) -> int:
        k = stop // self.STEP
        return zlib.crc32(self.data[k * self.STEP : stop], self.before[k])

    def of(self, start: int, stop: int) -> int:
        if stop - start <= self.STEP:
            return zlib.crc32(self.data[start:stop])
        moved, n, k = self._upto(start), stop - start, 0
        while n:
            if n & 1:
                moved = _product(_zeros()[k], moved)
            n >>= 1
            k += 1
        return moved ^ self._upto(stop)


class Bytes:
    """Bytes to be sniffed, with what is known of the chains in them; each is made when a format first asks for it."""

    def __init__(self, data: bytes):
        self.data = data

    def __len__(self) -> int:
        return len(self.data)

    @cached_property
    def sums(self) -> Checksums:
        return Checksums(self.data)

    @cached_property
    def gif_blocks(self) -> Ends:
        """Sub-blocks to a block of no bytes, and one past it."""
        b = self.data
        return Ends(len(b), lambda p: (None, p + 1) if b[p] == 0 else (p + b[p] + 1, None))

    @cached_property
    def gif_parts(self) -> Ends:
        """Extensions and images to the trailer, and one past it."""
        b = self.data

        def step(p: int) -> tuple[int | None, int | None]:
            if b[p] == 0x3B:
                return None, p + 1
            if b[p] == 0x21:
                return self.gif_blocks.of(p + 2), None
            if b[p] == 0x2C and p + 10 <= len(b):
                local = b[p + 9]
                return self.gif_blocks.of(p + 11 + (3 << (local & 7) + 1 if local & 0x80 else 0)), None
            return None, None

        return Ends(len(b), step)

    @cached_property
    def jpeg_ends(self) -> list[int]:
        return [m.start() for m in re.finditer(b"\xff\xd9", self.data)]

    @cached_property
    def jpeg_parts(self) -> Ends:
        """Segments to the scan, and one past the image's last bytes."""
        b = self.data

        def step(p: int) -> tuple[int | None, int | None]:
            if p + 4 > len(b) or b[p] != 0xFF or b[p + 1] < 0xC0:
                return None, None
            n = struct.unpack_from(">H", b, p + 2)[0]
            if n < 2 or p + 2 + n > len(b):
                return None, None
            if b[p + 1] != 0xDA:
                return p + 2 + n, None
            k = bisect_left(self.jpeg_ends, p + 2 + n)
            return None, self.jpeg_ends[k] + 2 if k < len(self.jpeg_ends) else None

        return Ends(len(b), step)

    @cached_property
    def png_parts(self) -> Ends:
        """Chunks whose checksums hold, to the last one, and one past it."""
        b = self.data

        def step(p: int) -> tuple[int | None, int | None]:
            if p + 12 > len(b):
                return None, None
            n = struct.unpack_from(">I", b, p)[0]
            if p + 12 + n > len(b) or self.sums.of(p + 4, p + 8 + n) != struct.unpack_from(">I", b, p + 8 + n)[0]:
                return None, None
            return (None, p + 12 + n) if b[p + 4 : p + 8] == b"IEND" else (p + 12 + n, None)

        return Ends(len(b), step)

    @cached_property
    def riff_parts(self) -> Forest:
        """Chunks; marks: 0 for a format, 1 for data."""
        b = self.data

        def step(p: int) -> tuple[int | None, int | None]:
            if p + 8 > len(b):
                return None, None
            name, n = b[p : p + 4], struct.unpack_from("<I", b, p + 4)[0]
            return p + 8 + n + n % 2, 0 if name == b"fmt " and n >= 16 else 1 if name == b"data" else None

        return Forest(len(b), step, 2)
