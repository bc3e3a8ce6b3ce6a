"""Operator 1: BPE encoding and decoding with a segment tree over adjacent pair ranks.

A word is a sequence of symbols.  The leaves of a min segment tree hold, for each adjacent pair,
its merge rank and position; the root is therefore the leftmost pair of lowest rank.  A merge
rewrites at most three leaves, so a word of n symbols costs O(n log n) however long it is.  Words
repeat, so each Python worker keeps a bounded cache of encoded words.

The text is cut as the vocabulary file says: added tokens first, then NFC, white space folded, lower
case, then words.  Python's and the library's Unicode tables differ for recent scripts; a text with a
character outside ``AGREED`` is cut by the library's own normaliser and pre-tokenizer instead.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import BoundedCache, map_texts

NEVER = 1 << 62
#: The word pattern in the vocabulary file.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
#: Blocks in which Python's Unicode tables agree with the library's (tests go through every code point).
AGREED = "\\x00-\\x1b\\x20-՗ऀ-౛Ḁ-₎₠-₿℀-⯿　-ㄯ一-鿯가-힣＀-￯\U0001f300-\U0001f6d7"
_ODD = re.compile(f"[^{AGREED}]")
_WORDS = regex.compile(WORDS)
#: Entries of a worker's caches; what does not fit is merged again.
CACHED_WORDS, CACHED_CHUNKS = 900_000, 900_000


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, spare = {}, 256
    for b in range(256):
        if b in plain:
            letters[b] = chr(b)
        else:
            letters[b] = chr(spare)
            spare += 1
    return [letters[b] for b in range(256)]


class PairTree:
    """Merges a symbol sequence by the ranks of ``pairs``; see the module's text."""

    def __init__(self, pairs: dict[int, int], merged: list[int]):
        self.pairs, self.merged = pairs, merged

    def merge(self, symbols: list[int]) -> list[int]:
        n = len(symbols)
        if n < 2:
            return symbols
        pairs, merged = self.pairs, self.merged
        base = 1 << (n - 2).bit_length() if n > 2 else 1
        tree = [NEVER] * (2 * base)
        for i in range(n - 1):
            rank = pairs.get(symbols[i] << 20 | symbols[i + 1])
            if rank is not None:
                tree[base + i] = rank << 32 | i
        for node in range(base - 1, 0, -1):
            left, right = tree[2 * node], tree[2 * node + 1]
            tree[node] = left if left < right else right
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(leaf: int, value: int) -> None:
            node = base + leaf
            tree[node] = value
            node >>= 1
            while node:
                left, right = tree[2 * node], tree[2 * node + 1]
                least = left if left < right else right
                if tree[node] == least:
                    return
                tree[node] = least
                node >>= 1

        def pair(left: int, right: int) -> int:
            rank = pairs.get(symbols[left] << 20 | symbols[right])
            return NEVER if rank is None else rank << 32 | left

        while (root := tree[1]) != NEVER:
            at = root & 0xFFFFFFFF
            gone = after[at]
            symbols[at] = merged[root >> 32]
            symbols[gone] = -1
            follow = after[at] = after[gone]
            if follow < n:
                before[follow] = at
            if gone < n - 1:
                put(gone, NEVER)
            put(at, pair(at, follow) if follow < n else NEVER)
            if (ahead := before[at]) >= 0:
                put(ahead, pair(ahead, at))
        return [s for s in symbols if s >= 0]


class PairForest:
    """The same trees for many short words at once: one row of an array for each word's tree."""

    WIDTHS = (4, 8, 16, 32)

    def __init__(self, pairs: dict[int, int], merged: list[int]):
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.ranks = np.array([pairs[k] for k in self.keys.tolist()], dtype=np.int64)
        self.merged = np.array(merged, dtype=np.int64)

    def _leaves(self, left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
        key = np.where(right < 0, np.int64(-1), left << 20 | right)
        place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[place] == key, self.ranks[place] << 32 | at, NEVER)

    def merge(self, symbols: np.ndarray, width: int) -> np.ndarray:
        """Rows of up to ``width`` symbols, filled up with -1 to width + 1; merged symbols stay in place, others turn -1."""
        rows, line = len(symbols), 2 * width
        place = np.arange(width + 1, dtype=np.int64)
        tree = np.full((rows, line), NEVER, dtype=np.int64)
        tree[:, width:] = self._leaves(symbols[:, :-1], symbols[:, 1:], place[:-1])
        level = width
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2
        tree = tree.ravel()
        sym, cells = symbols.ravel(), width + 1
        # a cell more in ``before``: what follows the last symbol of a full row
        after, before = np.tile(place + 1, rows), np.tile(np.arange(-1, width + 1, dtype=np.int64), rows)
        active = np.arange(rows, dtype=np.int64)
        while True:
            root = tree[active * line + 1]
            active, root = active[root != NEVER], root[root != NEVER]
            if not len(active):
                return sym.reshape(rows, cells)
            at, row, trees = root & 0xFFFFFFFF, active * cells, active * line
            gone = after[row + at]
            sym[row + at] = self.merged[root >> 32]
            sym[row + gone] = -1
            follow = after[row + gone]
            after[row + at] = follow
            before[active * (width + 2) + follow] = at
            ahead = before[active * (width + 2) + at]
            now = sym[row + at]
            here = self._leaves(now, sym[row + np.minimum(follow, width)], at)
            first = ahead < 0
            behind = np.where(first, here, self._leaves(sym[row + np.maximum(ahead, 0)], now, ahead))
            node = np.concatenate([trees + width + gone, trees + width + at, trees + width + np.where(first, at, ahead)])
            tree[node] = np.concatenate([np.full(len(at), NEVER, dtype=np.int64), here, behind])
            base, node = np.tile(trees, 3), np.concatenate([width + gone, width + at, width + np.where(first, at, ahead)])
            while node[0] > 1:
                node >>= 1
                child = base + 2 * node
                tree[base + node] = np.minimum(tree[child], tree[child + 1])


class WordBpe:
    """The vocabulary of a tokenizer file with word ends; ids and texts as the library gives them."""

    def __init__(self, path: str):
        spec = json.loads(open(path, encoding="utf-8").read())
        model = spec["model"]
        self.path, self.end = path, model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.tokens = {i: t for t, i in (self.vocab | self.added).items()}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        #: For each rank: the id it makes, and the ids of its halves.
        self.merged = [self.vocab[a + b] for a, b in merges]
        self.halves = [(self.vocab[a], self.vocab[b]) for a, b in merges]
        self.pairs = {a << 20 | b: r for r, (a, b) in enumerate(self.halves)}
        self.letters = byte_letters()
        self.bytes_of = {c: b for b, c in enumerate(self.letters)}
        #: Symbols of bytes within a word, and of its last byte.
        self.inside = np.array([self.vocab[c] for c in self.letters], dtype=np.int64)
        self.final = np.array([self.vocab[c + self.end] for c in self.letters], dtype=np.int64)
        self.tree, self.forest = PairTree(self.pairs, self.merged), PairForest(self.pairs, self.merged)
        self._special = re.compile("(" + "|".join(map(re.escape, self.added)) + ")") if self.added else None
        self._marks = [t[:2] for t in self.added]
        self._library = None
        self.kind = np.dtype("<u2" if max(self.tokens) < 1 << 16 else "<u4")
        self._words = BoundedCache(None, CACHED_WORDS)

    # -- cutting -------------------------------------------------------------------------------

    def plain(self, text: str) -> bool:
        """Whether white space alone may cut the text into chunks that encode independently."""
        return not any(m in text for m in self._marks) and not _ODD.search(text)

    @staticmethod
    def folded(text: str) -> str:
        """NFC and lower case, character by character (no final sigma)."""
        if text.isascii():
            return text.lower()
        text = unicodedata.normalize("NFC", text)
        return (text.replace("Σ", "σ") if "Σ" in text else text).lower()

    def chunks(self, text: str) -> list[str]:
        """The chunks between white space of a plain text."""
        return self.folded(text).split()

    def factorised(self, texts: list[str]) -> tuple[list[int], list[str], np.ndarray, np.ndarray]:
        """The plain texts among some: their places, the distinct chunks of all, each chunk's number, and where each text's chunks begin and end.

        Chunks repeat, so what follows costs a look-up a distinct chunk and array operations for the rest.  A
        text without chunks has the empty chunk.
        """
        rows = [i for i, t in enumerate(texts) if self.plain(t)]
        lists = pc.utf8_split_whitespace(pa.array([self.folded(texts[i]).strip() for i in rows], pa.large_string()))
        coded = lists.flatten().dictionary_encode()
        return rows, coded.dictionary.to_pylist(), coded.indices.to_numpy(), lists.offsets.to_numpy()

    def odd_parts(self, text: str):
        """Any text, part by part: an added token's id, or the words of what lies between, by the library."""
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        back = self.bytes_of
        for part in self._special.split(text) if self._special else [text]:
            if part in self.added:
                yield self.added[part]
            elif part:
                words = self._library.pre_tokenizer.pre_tokenize_str(self._library.normalizer.normalize_str(part))
                yield [bytes([back[c] for c in w]).decode("utf-8", "surrogatepass") for w, _ in words]

    # -- encoding and decoding -----------------------------------------------------------------

    def symbols(self, data: bytes) -> list[int]:
        codes = np.frombuffer(data, dtype=np.uint8)
        return [*self.inside[codes[:-1]].tolist(), int(self.final[codes[-1]])]

    def merge_words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words, as bytes: short ones by the forest, long ones each by a tree of its own."""
        out: dict[str, bytes] = {}
        coded = [w.encode("utf-8", "surrogatepass") for w in words]
        sizes = np.array([len(c) for c in coded], dtype=np.int64)
        low = 0
        for width in PairForest.WIDTHS:
            group = np.flatnonzero((sizes > low) & (sizes <= width))
            low = width
            for start in range(0, len(group), 8192):
                part = group[start : start + 8192]
                n = sizes[part]
                codes = np.frombuffer(b"".join([coded[i] for i in part.tolist()]), dtype=np.uint8)
                filled = np.arange(width + 1) < n[:, None]
                symbols = np.full((len(part), width + 1), -1, dtype=np.int64)
                symbols[filled] = self.inside[codes]
                symbols[np.arange(len(part)), n - 1] = self.final[codes[np.cumsum(n) - 1]]
                symbols = self.forest.merge(symbols, width)
                there = symbols >= 0
                flat, stops = symbols[there].astype(self.kind).tobytes(), (np.cumsum(there.sum(axis=1)) * self.kind.itemsize).tolist()
                before = 0
                for i, stop in zip(part.tolist(), stops, strict=True):
                    out[words[i]] = flat[before:stop]
                    before = stop
        for i in np.flatnonzero(sizes > low).tolist():
            out[words[i]] = np.array(self.tree.merge(self.symbols(coded[i])), dtype=self.kind).tobytes()
        return out

    def words_ids(self, words: set[str]) -> dict[str, bytes]:
        """Ids of all the words: from the cache, else merged."""
        return self._words.among(words, self.merge_words)

    def chunk_ids(self, chunks) -> dict[str, bytes]:
        """Ids of each of some chunks, as bytes."""
        cut = {c: _WORDS.findall(c) for c in chunks}
        ids = self.words_ids({w for words in cut.values() for w in words})
        return {c: b"".join([ids[w] for w in words]) for c, words in cut.items()}

    def encode(self, text: str) -> list[int]:
        """Ids of a text, without special tokens around it."""
        parts = [_WORDS.findall(self.folded(text))] if self.plain(text) else list(self.odd_parts(text))
        ids = self.words_ids({w for p in parts if not isinstance(p, int) for w in p})
        out: list[int] = []
        for part in parts:
            if isinstance(part, int):
                out.append(part)
            else:
                out.extend(np.frombuffer(b"".join([ids[w] for w in part]), dtype=self.kind).tolist())
        return out

    def decode(self, ids) -> str:
        """The library's decode(ids, skip_special_tokens=False): the file has no decoder, so tokens and spaces."""
        tokens = self.tokens
        return " ".join([tokens[i] for i in ids if i in tokens])


@lru_cache(maxsize=2)
def vocabulary(path: str) -> WordBpe:
    """One vocabulary, with its cache, for each Python worker."""
    return WordBpe(path)


class _Strings(WordBpe):
    """Keeps, for each chunk, its ids in decimal and their decoding."""

    def __init__(self, path: str):
        super().__init__(path)
        self._made = BoundedCache(None, CACHED_CHUNKS)
        self._decimal = [str(i) for i in range(max(self.tokens) + 1)]
        self._token = [self.tokens.get(i, "") for i in range(max(self.tokens) + 1)]

    def _strings(self, chunks: list[str]) -> dict[str, tuple[str, str]]:
        decimal, token, new = self._decimal, self._token, {}
        for chunk, data in self.chunk_ids(chunks).items():
            ids = np.frombuffer(data, dtype=self.kind).tolist()
            new[chunk] = " ".join([decimal[i] for i in ids]), " ".join([token[i] for i in ids])
        return new

    def of(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """The number of ids of each text, the ids in decimal and their decoding."""
        rows, chunks, codes, stops = self.factorised(texts)
        made = self._made.among(chunks, self._strings)
        numbers, decoded = (np.array([made[c][k] for c in chunks], dtype=object) for k in (0, 1))
        out: list = [None] * len(texts)
        for i, first, last in zip(rows, stops[:-1].tolist(), stops[1:].tolist(), strict=True):
            part = codes[first:last]
            joined = " ".join(numbers[part].tolist())
            out[i] = joined.count(" ") + 1 if joined else 0, joined, " ".join(decoded[part].tolist())
        for i, text in enumerate(texts):
            if out[i] is None:
                ids = self.encode(text)
                out[i] = len(ids), " ".join(map(str, ids)), self.decode(ids)
        return out


@lru_cache(maxsize=2)
def _strings(path: str) -> _Strings:
    return _Strings(path)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids array<int>, n_tokens``: the ids of each whole text (null: empty, so no ids).

    Repeated rows give repeated rows; further columns are not read; an empty table gives an empty result.
    """

    def work(_, texts):
        v = vocabulary(path)
        ids = [v.encode(t) for t in texts]
        return {"ids": ids, "n_tokens": [len(i) for i in ids]}

    return map_texts(docs, work, [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType())])


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Adds ``decoded`` to rows with ``ids`` (null ids: null); other columns stay, an empty table stays empty."""
    from pyspark.sql import functions as F

    @F.pandas_udf(T.StringType())
    def decoded(ids):
        v = vocabulary(path)
        return ids.map(lambda x: None if x is None else v.decode(np.asarray(x).tolist()))

    return encoded.withColumn("decoded", decoded("ids"))


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` for each row of ``docs``.

    Encodes and decodes each whole text chunk by chunk; only digests leave the worker.  Null and
    empty texts have no ids and decode to the empty string.  Repeated rows give repeated rows; an
    empty table gives an empty result; further columns are not read.
    """

    def work(_, texts):
        out = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for n, numbers, decoded in _strings(path).of(texts):
            out["n_tokens"].append(n)
            out["ids_sha256"].append(hashlib.sha256(numbers.encode()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(decoded.encode()).hexdigest())
        return out

    return map_texts(docs, work, [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
