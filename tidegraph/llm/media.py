"""Operator 4: media columns and signature sniffing.

A media column holds bytes and the type someone declared for them.  Sniffing finds every magic number with one
Aho-Corasick pass; a validator for the format then confirms structure and lengths, so a magic number by
chance is not a finding.  A confirmed format at the start corrects the declared type; confirmed formats further
inside are carved out as embedded media.

Documents are stored losslessly as 8-bit mono WAVE audio, the payload being the samples.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .chains import Bytes
from .common import map_texts, unused

UNIT = 576
RATE = 16_000

#: Magic bytes and the type they announce.
MAGIC = {
    b"RIFF": "riff",
    b"\x89PNG\r\n\x1a\n": "image/png",
    b"GIF87a": "image/gif",
    b"GIF89a": "image/gif",
    b"\xff\xd8\xff": "image/jpeg",
    b"BM": "image/bmp",
    b"fLaC": "audio/flac",
    b"P5": "image/x-portable-graymap",
}


@dataclass(frozen=True)
class Found:
    """A confirmed format: its type, its bytes, and where its samples are."""

    kind: str
    start: int
    stop: int
    data: int = 0
    size: int = 0
    note: str = ""


def _riff(x: Bytes, at: int) -> Found | None:
    b = x.data
    if at + 12 > len(b):
        return None
    stop = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    if stop > len(b) or b[at + 8 : at + 12] != b"WAVE" or at + 20 > stop:
        return None
    last = x.riff_parts.last(at + 12, stop - 8)  # every chunk but this one ends where another begins
    if last + 8 + struct.unpack_from("<I", b, last + 4)[0] > stop:
        return None
    fmt_at, data_at = (ahead[at + 12] for ahead in x.riff_parts.ahead)
    if not 0 <= fmt_at <= last or not 0 <= data_at <= last:
        return None
    fmt, size = struct.unpack_from("<HHIIHH", b, fmt_at + 8), struct.unpack_from("<I", b, data_at + 4)[0]
    if fmt[0] != 1 or fmt[3] != fmt[2] * fmt[4] or fmt[4] * 8 != fmt[1] * fmt[5] or not fmt[4] or size % fmt[4]:
        return None
    return Found("audio/wav", at, stop, data_at + 8, size, f"pcm{fmt[5]}/{fmt[1]}ch/{fmt[2]}Hz")


def _png(x: Bytes, at: int) -> Found | None:
    if x.data[at + 8 : at + 16] != b"\x00\x00\x00\x0dIHDR":
        return None
    stop = x.png_parts.of(at + 8)
    return None if stop is None else Found("image/png", at, stop)


def _gif(x: Bytes, at: int) -> Found | None:
    if at + 13 > len(x):
        return None
    flags = x.data[at + 10]
    stop = x.gif_parts.of(at + 13 + (3 << (flags & 7) + 1 if flags & 0x80 else 0))
    return None if stop is None else Found("image/gif", at, stop)


def _jpeg(x: Bytes, at: int) -> Found | None:
    stop = x.jpeg_parts.of(at + 2)
    return None if stop is None else Found("image/jpeg", at, stop)


def _bmp(x: Bytes, at: int) -> Found | None:
    b = x.data
    if at + 54 > len(b):
        return None
    size, zero, start, header, width, height, planes, depth = struct.unpack_from("<IIIIiiHH", b, at + 2)
    row = (abs(width) * depth + 31) // 32 * 4
    good = zero == 0 and header == 40 and planes == 1 and depth in (1, 4, 8, 24, 32) and width > 0 and height
    return Found("image/bmp", at, at + size) if good and start >= 54 and at + size <= len(b) and size == start + row * abs(height) else None


def _flac(x: Bytes, at: int) -> Found | None:
    b = x.data
    if at + 42 > len(b) or b[at + 4] & 0x7F or b[at + 5 : at + 8] != b"\x00\x00\x22":
        return None
    return Found("audio/flac", at, len(b))


def _pgm(x: Bytes, at: int) -> Found | None:
    b, fields, place = x.data, [], at + 2
    for _ in range(3):
        while place < len(b) and b[place] in b" \t\r\n":
            place += 1
        first = place
        while place < len(b) and 48 <= b[place] <= 57 and place - first < 9:
            place += 1
        if first == place or first == at + 2:
            return None
        fields.append(int(b[first:place]))
    width, height, top = fields
    if place >= len(b) or b[place] not in b" \t\r\n" or not 0 < top < 256 or not width * height or place + 1 + width * height > len(b):
        return None
    return Found("image/x-portable-graymap", at, place + 1 + width * height, place + 1, width * height)


CHECKS = {"riff": _riff, "image/png": _png, "image/gif": _gif, "image/jpeg": _jpeg, "image/bmp": _bmp, "audio/flac": _flac, "image/x-portable-graymap": _pgm}


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for magic, kind in MAGIC.items():
        a.add_word(magic.decode("latin-1"), (len(magic), kind))
    a.make_automaton()
    return a


def sniff(data: bytes) -> list[Found]:
    """Confirmed formats in the order of their first bytes, those within samples of a confirmed one included.

    Of a WAVE file's chunks the first format and the first data count.  Time is linear in the bytes, but for a logarithm.
    """
    out, known = [], Bytes(bytes(data))
    for last, (n, kind) in automaton().iter(data.decode("latin-1")):
        found = CHECKS[kind](known, last - n + 1)
        if found:
            out.append(found)
    return out


def correct(declared: str, data: bytes) -> tuple[str, list[Found]]:
    """The type the bytes have (the declared one if nothing is confirmed at their start), and what is embedded."""
    found = sniff(data)
    whole = next((f for f in found if f.start == 0), None)
    return (whole.kind if whole else declared), [f for f in found if f is not whole]


def pad(data: bytes) -> bytes:
    """The payload: ``data`` and bytes 255 up to a positive multiple of 576."""
    return data + b"\xff" * (max(1, -(-len(data) // UNIT)) * UNIT - len(data))


def store(payload: bytes) -> bytes:
    """The payload as 8-bit mono PCM in a WAVE file."""
    header = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload))
    return header + payload


def media(text: str) -> bytes:
    return store(pad(text.encode("utf-8", "surrogatepass")))


def describe(stored: bytes, declared: str) -> tuple[bytes, str]:
    """The samples read back from stored bytes, and what they are in words and figures."""
    found = sniff(stored)
    whole = next(f for f in found if f.start == 0 and f.size)
    samples = stored[whole.data : whole.data + whole.size]
    x = np.frombuffer(samples, dtype=np.uint8)
    counts = np.bincount(x, minlength=256)
    level = np.arange(256)
    mean = float((counts * level).sum() / len(x))
    spread = float(np.sqrt((counts * (level - mean) ** 2).sum() / len(x)))
    crossings = int(np.count_nonzero((x[1:] >= 128) != (x[:-1] >= 128)))
    inside = "+".join(f"{f.kind}@{f.start - whole.data}:{f.stop - f.start}" for f in found if f is not whole)
    return samples, f"{declared}->{whole.kind};{whole.note};samples={len(x)};mean={mean:.4f};spread={spread:.4f};crossings={crossings};embedded={inside}"


def media_column(docs: DataFrame) -> DataFrame:
    """``doc_id, declared, media binary``: each whole text (null: empty) as stored media, declared without a type.  An empty table gives an empty result."""

    def work(_, texts):
        return {"declared": ["application/octet-stream"] * len(texts), "media": [media(t) for t in texts]}

    return map_texts(docs, work, [T.StructField("declared", T.StringType()), T.StructField("media", T.BinaryType())])


def sniff_column(rows: DataFrame) -> DataFrame:
    """``rows`` of ``doc_id, declared, media`` with ``actual`` and ``embedded`` (type, start, stop of each carved part).

    Null media keep their declared type and have nothing embedded.  An empty table gives an empty result.
    """
    from pyspark.sql import functions as F

    @F.pandas_udf("actual string, embedded array<struct<kind:string,start:int,stop:int>>")
    def found(declared, data):
        import pandas as pd

        got = [(d, []) if b is None else correct(d, bytes(b)) for d, b in zip(declared, data, strict=True)]
        return pd.DataFrame({"actual": [k for k, _ in got], "embedded": [[{"kind": f.kind, "start": f.start, "stop": f.stop} for f in e] for _, e in got]})

    name = unused(rows, "found")
    return rows.withColumn(name, found("declared", "media")).select("*", f"{name}.actual", f"{name}.embedded").drop(name)


def media_report(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature`` for each row.

    A null text is empty: 576 bytes of padding.  Equal texts give equal values; repeated rows give repeated
    rows; further columns are not read; an empty table gives an empty result.
    """
    names = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")

    def one(text: str) -> tuple:
        stored = media(text)
        samples, feature = describe(stored, "application/octet-stream")
        return len(text.encode("utf-8", "surrogatepass")), len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), feature

    def work(_, texts):
        return dict(zip(names, zip(*map(one, texts), strict=True), strict=True))

    return map_texts(docs, work, [T.StructField(n, T.StringType() if n.endswith("sha256") or n == "feature" else T.LongType()) for n in names])
