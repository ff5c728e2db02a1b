"""Byte-level BPE in batched numpy merge rounds.

Texts are cut by the public pattern; the distinct words of a batch lie in one flat
array of symbols. A round looks up all adjacent pairs by binary search over the sorted
pair keys, takes the lowest rank of every word, merges its places from left to right,
and drops finished words. Only the encoding of words needs rounds, so a batch costs by
its distinct words and not by its length.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"

# Fixed value: the pattern of the public rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Words with more bytes than this are merged one by one with a heap, which is exact as
#: well and takes n log n steps where rounds over one long word could take n * n.
LONG_WORD = 1024

#: Texts encoded at once; bounds a batch's memory together with Arrow's batch size.
BATCH_CHARS = 4_000_000


class Vocabulary:
    """Ranks of a tiktoken file: byte ids and the merge table as sorted pair keys."""

    def __init__(self, data: bytes) -> None:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}
        self.byte_id = np.zeros(256, dtype=np.int64)
        for b in range(256):
            self.byte_id[b] = ranks[bytes([b])]
        self.width = max(ranks.values()) + 1
        keys, ids = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left * self.width + right)
                    ids.append(rank)
        order = np.argsort(keys, kind="stable")
        self.keys = np.asarray(keys, dtype=np.int64)[order]
        self.ids = np.asarray(ids, dtype=np.int64)[order]
        self.none = np.int64(self.width)
        self.table: dict[int, int] | None = None

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Id (= rank) of each merged pair, ``none`` where the pair has no merge."""
        want = left * self.width + right
        at = np.searchsorted(self.keys, want)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == want, self.ids[at], self.none)

    def rounds(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of non-empty ``words`` and the end of each word in them."""
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        symbol = self.byte_id[np.frombuffer(b"".join(words), dtype=np.uint8)]
        word = np.repeat(np.arange(len(words)), lengths)
        done_s, done_w = [], []
        rank = self._ranks(symbol, word)
        while len(symbol):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            size = np.diff(np.r_[starts, len(word)])
            lowest = np.minimum.reduceat(rank, starts)
            open_word = lowest < self.none
            if not open_word.all():
                live = np.repeat(open_word, size)
                done_s.append(symbol[~live])
                done_w.append(word[~live])
                symbol, word, rank, lowest, size = symbol[live], word[live], rank[live], lowest[open_word], size[open_word]
                if not len(symbol):
                    break
            hit = rank == np.repeat(lowest, size)
            # In a run of overlapping hits (as in "aaa") every other one counts, from the left.
            if (hit[1:] & hit[:-1]).any():
                place = np.arange(len(hit))
                begin = np.maximum.accumulate(np.where(hit & ~np.r_[False, hit[:-1]], place, -1))
                hit &= (place - begin) % 2 == 0
            at = np.flatnonzero(hit)
            symbol[at] = rank[at]
            stay = np.ones(len(symbol), dtype=bool)
            stay[at + 1] = False
            symbol, word, rank = symbol[stay], word[stay], rank[stay]
            # Only pairs beside a merge have changed.
            new = at - np.arange(len(at))
            again = np.unique(np.r_[new, new[new > 0] - 1])
            inner = again[again + 1 < len(symbol)]
            rank[again] = self.none
            same = inner[word[inner] == word[inner + 1]]
            rank[same] = self.merged(symbol[same], symbol[same + 1])
        ids, owner = np.concatenate([*done_s, np.empty(0, np.int64)]), np.concatenate([*done_w, np.empty(0, np.int64)])
        order = np.argsort(owner, kind="stable")
        return ids[order].astype(np.int32), np.cumsum(np.bincount(owner, minlength=len(words)))

    def _ranks(self, symbol: np.ndarray, word: np.ndarray) -> np.ndarray:
        rank = np.full(len(symbol), self.none)
        same = np.flatnonzero(word[1:] == word[:-1])
        rank[same] = self.merged(symbol[same], symbol[same + 1])
        return rank

    def one_long(self, data: bytes) -> np.ndarray:
        """A single very long word, by a heap of pairs over a linked list."""
        if self.table is None:
            self.table = dict(zip(self.keys.tolist(), self.ids.tolist(), strict=True))
        get, width = self.table.get, self.width
        s = self.byte_id[np.frombuffer(data, dtype=np.uint8)].tolist()
        n = len(s)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, s[i], s[i + 1]) for i in range(n - 1) if (r := get(s[i] * width + s[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, left, right = heapq.heappop(heap)
            j = after[i]
            if s[i] != left or j >= n or s[j] != right:
                continue
            s[i], s[j] = r, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (x := get(r * width + s[k])) is not None:
                    heapq.heappush(heap, (x, i, r, s[k]))
            if (h := before[i]) >= 0 and (x := get(s[h] * width + r)) is not None:
                heapq.heappush(heap, (x, h, s[h], r))
        return np.asarray([x for x in s if x >= 0], dtype=np.int32)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts and their ends; None and '' have none."""
        find = WORDS.findall
        index: dict[str, int] = {}
        codes: list[int] = []
        n_words = np.zeros(len(texts), dtype=np.int64)
        for i, text in enumerate(texts):
            if text:
                words = find(text)
                n_words[i] = len(words)
                codes.extend([index.setdefault(w, len(index)) for w in words])
        if not codes:
            return np.empty(0, np.int32), np.zeros(len(texts), dtype=np.int64)
        raw = [w.encode("utf-8", "replace") for w in index]
        size = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        short = np.flatnonzero(size <= LONG_WORD)
        pieces: list[np.ndarray] = []
        lengths = np.zeros(len(raw), dtype=np.int64)
        flat, ends = self.rounds([raw[i] for i in short]) if len(short) else (np.empty(0, np.int32), np.empty(0, np.int64))
        lengths[short] = np.diff(np.r_[0, ends])
        start = np.zeros(len(raw), dtype=np.int64)
        start[short] = np.r_[0, ends[:-1]] if len(short) else []
        pieces.append(flat)
        at = len(flat)
        for i in np.flatnonzero(size > LONG_WORD):
            ids = self.one_long(raw[i])
            start[i], lengths[i] = at, len(ids)
            pieces.append(ids)
            at += len(ids)
        flat = np.concatenate(pieces)
        code = np.asarray(codes)
        n = lengths[code]
        stop = np.cumsum(n)
        out = flat[np.arange(stop[-1]) - np.repeat(stop - n, n) + np.repeat(start[code], n)]
        return out, np.r_[0, stop][np.cumsum(n_words)]


WORDS = regex.compile(PATTERN)
_loaded: dict[int, Vocabulary] = {}


def vocabulary(data: bytes) -> Vocabulary:
    """The vocabulary, built once in a worker."""
    key = hash(data)
    if key not in _loaded:
        _loaded[key] = Vocabulary(data)
    return _loaded[key]


def read_ranks(name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> bytes:
    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
        return f.read()


def encode(df: DataFrame, key: str, text: str = "text", name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(key, ids): the token ids of each text, without special tokens.

    One row for every row of ``df``; NULL and '' give an empty list; whole texts are encoded,
    whatever their length; strings of special tokens are ordinary text. Only
    the rank file (under 1 MB) is broadcast.
    """
    shared = df.sparkSession.sparkContext.broadcast(read_ranks(name, folder))
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(shared.value)
        for b in batches:
            texts = b.column(1).to_pylist()
            at = 0
            while at < len(texts):
                to, chars = at, 0
                while to < len(texts) and (to == at or chars < BATCH_CHARS):
                    chars += len(texts[to] or "")
                    to += 1
                flat, ends = v.encode(texts[at:to])
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, to - at), lists], names=[key, "ids"])
                at = to

    return df.select(F.col(key), F.col(text).cast("string")).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def encode_strings(texts: list[str | None], name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> list[list[int]]:
    """Local twin of :func:`encode` for tests and small use."""
    flat, ends = vocabulary(read_ranks(name, folder)).encode(texts)
    return [x.tolist() for x in np.split(flat, ends[:-1])] if len(texts) else []


def token_counts(s: pd.Series, data: bytes) -> pd.Series:
    """Number of tokens of each text."""
    _, ends = vocabulary(data).encode(s.tolist())
    return pd.Series(np.diff(np.r_[0, ends]))
