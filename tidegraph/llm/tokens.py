"""Operator 10: token counts by prefix dynamic programming.

For every prefix of a word the programme holds the last token of its encoding and the number of
tokens.  The last token is the one suffix token that can stand next to the last token of what is
before it: merging the two would not cross their boundary.  A word's prefix ends a word, so each
position has two states: inside a word, and at a word end.  From the counts of a text's chunks and
of their prefixes come the exact counts of every prefix of the (normalised) text, so truncation and
budget questions need no second encoding.

Positions are code points of the normalised text: NFC, each run of white space as one space, lower case.
"""

from __future__ import annotations

from bisect import bisect_right
from functools import lru_cache
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bpe import _WORDS, CACHED_CHUNKS, CACHED_WORDS, NEVER, WordBpe
from .common import BoundedCache, map_texts

LIMIT = 2048
#: Pairs of tokens whose standing is kept.
PAIRS = 1_000_000


class PrefixCounter(WordBpe):
    """Counts of every prefix of a word, chunk or text."""

    def __init__(self, path: str):
        super().__init__(path)
        self.born = {i: r for r, i in enumerate(self.merged)}
        self._stands: dict[int, bool] = {}
        #: A trie over the bytes of tokens: children, and the ids of the token that ends there inside a word and at its end.
        self.children: list[dict[int, int]] = [{}]
        self.inner, self.ends = [-1], [-1]
        size = len(self.end)
        for token, i in self.vocab.items():
            ends = token.endswith(self.end) and len(token) > size
            letters = token[:-size] if ends else token
            last = [self.vocab[letters[-1] + self.end]] if ends else [self.vocab[letters[-1]]]
            if self.tree.merge([self.vocab[c] for c in letters[:-1]] + last) != [i]:
                continue  # it is not its own encoding, so no merging makes it
            node = 0
            for c in letters:
                follow = self.children[node].setdefault(self.bytes_of[c], len(self.children))
                if follow == len(self.children):
                    self.children.append({})
                    self.inner.append(-1)
                    self.ends.append(-1)
                node = follow
            (self.ends if ends else self.inner)[node] = i
        self.word_counts = BoundedCache(self._word_counts, CACHED_WORDS)
        self.chunk_totals = BoundedCache(self._chunk_total, CACHED_CHUNKS)

    def _chunk_total(self, chunk: str) -> int:
        counts = self.word_counts
        return sum([counts[w][-1] for w in _WORDS.findall(chunk)])

    def _unwind(self, left: int, right: int) -> bool:
        """Whether two tokens side by side stay apart: no merge over the boundary comes before those inside.

        Takes back the merges next to the boundary, latest first, looking for one that would have crossed
        it.  ``gone_l`` and ``gone_r`` are the ranks at which the parts beside the boundary become part of
        something longer.  At equal ranks the merge further left comes first.
        """
        born, pairs, halves = self.born, self.pairs, self.halves
        gone_l = gone_r = NEVER
        while True:
            across = pairs.get(left << 20 | right)
            if across is not None and across < gone_l and across <= gone_r:
                return False
            born_l, born_r = born.get(left, -1), born.get(right, -1)
            if born_l < 0 and born_r < 0:
                return True
            if born_l >= born_r:
                gone_l, left = born_l, halves[born_l][1]
            else:
                gone_r, right = born_r, halves[born_r][0]

    def _keep(self, key: int) -> bool:
        found = self._unwind(key >> 20, key & 0xFFFFF)
        if len(self._stands) >= PAIRS:
            self._stands.clear()
        self._stands[key] = found
        return found

    def _word_counts(self, word: str):
        """Tokens of word[:1], word[:2], ..., each as a whole word; positions are bytes.

        Position by position: ``last`` and ``count`` hold the encoding of what is before it, inside a word.
        Each token that begins there gives the state where it stops, if it can stand next to ``last``; of all
        tokens that stop at a place just one can.
        """
        data = word.encode("utf-8", "surrogatepass")
        n = len(data)
        children, inner, ends, stands, keep = self.children, self.inner, self.ends, self._stands, self._keep
        last, count, out = [-1] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        for start in range(n):
            before, many, node = last[start] << 20, count[start] + 1, 0
            for stop in range(start + 1, n + 1):
                node = children[node].get(data[stop - 1])
                if node is None:
                    break
                token = ends[node]
                if token >= 0 and not out[stop]:
                    if not start:
                        out[stop] = 1
                    else:
                        fits = stands.get(before | token)
                        if keep(before | token) if fits is None else fits:
                            out[stop] = many
                token = inner[node]
                if token >= 0 and not count[stop]:
                    if not start:
                        last[stop], count[stop] = token, 1
                    else:
                        fits = stands.get(before | token)
                        if keep(before | token) if fits is None else fits:
                            last[stop], count[stop] = token, many
        return bytes(out[1:]) if n < 256 else tuple(out[1:])

    def chunk_prefixes(self, chunk: str) -> list[int]:
        """Counts of chunk[:1], chunk[:2], ...; positions are code points."""
        out, before = [], 0
        for word in _WORDS.findall(chunk):
            counts, at = self.word_counts[word], 0
            for i, c in enumerate(word):
                at += len(c.encode())
                alone = word[0] == "'" and 0 < i < len(word) - 1  # a contraction begun: the mark, then letters
                out.append(before + (1 + self.word_counts[word[1 : i + 1]][-1] if alone and word[1].isalpha() else counts[at - 1]))
            before = out[-1]
        return out

    def _odd_counts(self, text: str) -> int:
        return sum(1 if isinstance(part, int) else sum(self.word_counts[w][-1] for w in part) for part in self.odd_parts(text))

    def count(self, text: str) -> int:
        """Tokens of the whole text."""
        if self.plain(text):
            totals = self.chunk_totals
            return sum([totals[c] for c in self.chunks(text)])
        return self._odd_counts(text)

    def many(self, texts: list[str]) -> list[int]:
        """Tokens of each whole text."""
        rows, chunks, codes, stops = self.factorised(texts)
        made = self.chunk_totals.among(chunks, lambda lacking: {c: self._chunk_total(c) for c in lacking})
        totals = np.array([made[c] for c in chunks], dtype=np.int64)
        sums = np.concatenate([[0], np.cumsum(totals[codes])])[stops]
        out = dict(zip(rows, (sums[1:] - sums[:-1]).tolist(), strict=True))
        return [out[i] if i in out else self._odd_counts(t) for i, t in enumerate(texts)]

    def normal_form(self, text: str) -> str:
        """Any text as the library normalises it."""
        next(self.odd_parts(""), None)  # loads the library
        return self._library.normalizer.normalize_str(text)

    def _units(self, normal: str) -> list[tuple[int, int, str | None]] | None:
        """Start, stop and word of each word of a normal form, in order; the word of an added token is None.

        None if normalising or cutting moves characters.
        """
        next(self.odd_parts(""), None)
        out, base = [], 0
        for part in self._special.split(normal) if self._special else [normal]:
            if part in self.added:
                out.append((base, base + len(part), None))
            elif part:
                if self._library.normalizer.normalize_str(part) != part:
                    return None
                for (_, (a, b)), word in zip(self._library.pre_tokenizer.pre_tokenize_str(part), next(self.odd_parts(part)), strict=True):
                    if part[a:b] != word:
                        return None
                    out.append((base + a, base + b, word))
            base += len(part)
        return out

    def _inside(self, normal: str, units: list, k: int, before: int) -> list[int]:
        """Counts of the prefixes that end in a unit; ``before``: the count up to it.

        A prefix of a word is a word, but for a contraction begun; a begun added token may run on from the word before.
        """
        start, stop, word = units[k]
        if word is None:
            first = units[k - 1][0] if k and units[k - 1][2] is not None and units[k - 1][1] == start else start
            base = before - (self.word_counts[units[k - 1][2]][-1] if first < start else 0)
            return [base + self._odd_counts(normal[first:i]) for i in range(start + 1, stop)] + [before + 1]
        if word[0] == "'" and word[1:].isalpha():
            return [before + self._odd_counts(normal[start:i]) for i in range(start + 1, stop + 1)]
        counts = self.word_counts[word]
        return [before + counts[at - 1] for at in accumulate(len(c.encode("utf-8", "surrogatepass")) for c in word)]

    def _odd_prefixes(self, normal: str) -> list[int]:
        """Counts of all prefixes of a normal form with any characters, accumulated word by word."""
        units = self._units(normal)
        if units is None:
            return [0, *(self._odd_counts(normal[:i]) for i in range(1, len(normal) + 1))]
        out = [0]
        for k, (start, _, _) in enumerate(units):
            out.extend([out[-1]] * (start + 1 - len(out)))
            out.extend(self._inside(normal, units, k, out[-1]))
        return out + [out[-1]] * (len(normal) + 1 - len(out))

    def odd_cut(self, text: str, budget: int) -> int:
        """``cut`` of any text; -1 if its normal form fits."""
        counts = self._odd_prefixes(self.normal_form(text))
        if counts[-1] <= budget:
            return -1
        return next(i for i in range(len(counts) - 1, -1, -1) if counts[i] <= budget)

    def prefixes(self, text: str) -> list[int]:
        """Counts of all prefixes of the normalised text, the empty one first."""
        if not self.plain(text):
            return self._odd_prefixes(self.normal_form(text))
        out, normal, before, at = [0], " ".join(self.chunks(f"x{text}x"))[1:-1], 0, 0
        for chunk in normal.split(" "):
            if at:
                out.append(before)
            at += 1
            if chunk:
                out.extend(before + n for n in self.chunk_prefixes(chunk))
                before = out[-1]
        return out

    def cut(self, text: str, budget: int) -> int:
        """Code points of the longest prefix of a plain text's normal form that has at most ``budget`` tokens.

        Counts never fall by more than a word's worth as a prefix grows, so the last chunk that begins
        within the budget is searched from its end.
        """
        chunks = self.chunks(text)
        ends = list(accumulate([self.chunk_totals[c] for c in chunks]))
        if not ends or ends[-1] <= budget:
            return -1
        k = bisect_right(ends, budget)
        start = sum(len(c) + 1 for c in chunks[:k]) + (1 if text[:1].isspace() else 0)
        before = ends[k - 1] if k else 0
        counts = self.chunk_prefixes(chunks[k])
        return start + next((i + 1 for i in range(len(counts) - 1, -1, -1) if before + counts[i] <= budget), 0)


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def _odd_cut(v: PrefixCounter, text: str, limit: int) -> int:
    at = v.odd_cut(text, limit)
    return len(v.normal_form(text)) if at < 0 else at


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit, cut_at`` for each row of ``docs``.

    ``cut_at``: where a text over ``limit`` is to be cut to fit (code points of its normal form, all of
    them if that fits; null if the text fits).  Null and empty texts have 0
    bytes and 0 tokens.  Repeated rows give repeated rows; further columns are not read; an empty table gives an empty result.
    """

    def work(_, texts):
        v = counter(path)
        n = v.many(texts)
        cuts = [None if k <= limit else v.cut(t, limit) if v.plain(t) else _odd_cut(v, t, limit) for k, t in zip(n, texts, strict=True)]
        return {"n_bytes": [len(t.encode("utf-8", "surrogatepass")) for t in texts], "n_tokens": n, "over_limit": [k > limit for k in n], "cut_at": cuts}

    return map_texts(docs, work, [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType()), T.StructField("cut_at", T.LongType())])


def prefix_counts(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, counts array<int>``: counts[i] is the number of tokens of the first i code points of the normalised text.

    A null text is empty, and has the one count 0.  Repeated rows give repeated rows; further columns are not read; an empty table gives an empty result.
    """

    def work(_, texts):
        v = counter(path)
        return {"counts": [v.prefixes(t) for t in texts]}

    return map_texts(docs, work, [T.StructField("counts", T.ArrayType(T.IntegerType()))])
