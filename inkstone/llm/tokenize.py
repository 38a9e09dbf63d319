"""Encoding of a corpus with a public byte-level BPE vocabulary (problem 7).

The vocabulary is a rank file (``base64 rank`` per line) whose path is a parameter.  Texts
are cut into words by the public pattern of that vocabulary; each distinct word of a batch
is encoded once.  The merge loop keeps, per word, a contiguous array of part boundaries and
of the rank of each adjacent pair, repeatedly scans for the minimum, deletes that boundary
and refreshes the ranks of the two neighbours.  Words of one length class are done together
as the rows of a matrix, so each scan is one vector operation for thousands of words.

Defined results: a null and an empty text have an empty list; a text is encoded whole,
special tokens are never produced (their strings are ordinary text); repeated rows and
extra columns have no influence; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary files are; a parameter of every function below.
TOKENIZER_DIR = os.environ.get("INKSTONE_TOKENIZERS", "/opt/tokenizers")
BYTE_BPE_50K = "byte_bpe_50k.tiktoken"
#: Fixed value: the public pre-tokenizer pattern of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_NONE = np.int32(2**31 - 1)
#: Words of more bytes than this are merged with a heap instead of by scanning.
LONG_WORD = 256
#: A worker forgets its words when it has seen this many (a bound on memory, not on texts).
MAX_WORDS = 300_000


class RankVocabulary:
    """Ranks of a byte-level BPE vocabulary and a flat hash table of its pairs."""

    def __init__(self, path: str):
        ranks: dict[bytes, int] = {}
        with open(path, "rb") as f:
            for line in f:
                if line.strip():
                    token, rank = line.split()
                    ranks[base64.b64decode(token)] = int(rank)
        self.ranks = ranks
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        left, right, whole = [], [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a = ranks.get(token[:i])
                if a is not None:
                    b = ranks.get(token[i:])
                    if b is not None:
                        left.append(a)
                        right.append(b)
                        whole.append(rank)
        keys = (np.array(left, np.int64) << 20) | np.array(right, np.int64)
        self._fill(keys, np.array(whole, np.int32))

    def _fill(self, keys: np.ndarray, ranks: np.ndarray) -> None:
        size = 1 << max(10, int(4 * len(keys) - 1).bit_length())
        self.mask = np.int64(size - 1)
        self.keys = np.full(size, -1, np.int64)
        self.vals = np.full(size, _NONE, np.int32)
        self.probes = 0
        slot = self._slot(keys)
        rest = np.arange(len(keys))
        while len(rest):  # all unplaced keys try their next slot at once
            self.probes += 1
            s = slot[rest]
            free = self.keys[s] == -1
            self.keys[s[free]] = keys[rest[free]]  # the last of several writers stays
            placed = self.keys[s] == keys[rest]
            self.vals[s[placed]] = ranks[rest[placed]]
            rest = rest[~placed]
            slot[rest] = (slot[rest] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.int64(0x9E3779B97F4A7C1 | 1)) >> np.int64(23)) & self.mask

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the token that each pair makes, or a very large number."""
        keys = (a.astype(np.int64) << 20) | b.astype(np.int64)
        keys[(a < 0) | (b < 0)] = -2
        slot = self._slot(keys)
        got = self.keys[slot]
        out = np.where(got == keys, self.vals[slot], _NONE)
        open_ = np.flatnonzero((got != keys) & (got != -1))
        for _ in range(self.probes):
            if not len(open_):
                break
            s = (slot[open_] + 1) & self.mask
            slot[open_] = s
            got = self.keys[s]
            hit = got == keys[open_]
            out[open_[hit]] = self.vals[s[hit]]
            open_ = open_[~hit & (got != -1)]
        return out

    def merge_matrix(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of similar length: flat ids, and how many each word has."""
        n, width = len(words), max(map(len, words))
        lens = np.fromiter(map(len, words), np.int64, n)
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)
        cols = np.arange(width)
        ids = np.where(cols < lens[:, None], self.byte_id[raw], -1).astype(np.int32)
        rank = np.full((n, width), _NONE, np.int32)
        if width > 1:
            rank[:, :-1] = self.pair_rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width - 1)
        nxt = np.tile(np.arange(1, width + 1, dtype=np.int32), (n, 1))
        prv = np.tile(np.arange(-1, width - 1, dtype=np.int32), (n, 1))
        rows = np.arange(n)
        while len(rows):
            sub = rank if len(rows) == n else rank[rows]
            at = sub.argmin(axis=1)
            best = sub[np.arange(len(rows)), at]
            go = best != _NONE
            rows, at, best = rows[go], at[go], best[go]
            if not len(rows):
                break
            gone = nxt[rows, at]  # the boundary before this part is deleted
            after = nxt[rows, gone]
            ids[rows, at] = best
            ids[rows, gone] = -1
            rank[rows, gone] = _NONE
            nxt[rows, at] = after
            inner = after < width
            prv[rows[inner], after[inner]] = at[inner]
            right = np.where(inner, ids[rows, np.minimum(after, width - 1)], -1)
            before = prv[rows, at]
            has = before >= 0
            left = np.where(has, ids[rows, np.maximum(before, 0)], -1)
            fresh = self.pair_rank(np.concatenate([best, left]), np.concatenate([right, best]))
            rank[rows, at] = fresh[: len(rows)]
            rank[rows[has], before[has]] = fresh[len(rows) :][has]
        keep = ids >= 0
        return ids[keep], keep.sum(axis=1)

    def merge_long(self, word: bytes) -> np.ndarray:
        """The same merges by a heap, for a word of any length."""
        ids = self.byte_id[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        first = self.pair_rank(np.array(ids[:-1], np.int32), np.array(ids[1:], np.int32))
        pairs: dict[tuple[int, int], int] = {}
        heap = [(int(r), i, ids[i], ids[i + 1]) for i, r in enumerate(first) if r != _NONE]
        heapq.heapify(heap)

        def of(a: int, b: int) -> int:
            r = pairs.get((a, b))
            if r is None:
                r = pairs[a, b] = int(self.pair_rank(np.array([a], np.int32), np.array([b], np.int32))[0])
            return r

        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = r, -1
            nxt[i] = k = nxt[j]
            if k < n:
                prv[k] = i
                if (x := of(r, ids[k])) != _NONE:
                    heapq.heappush(heap, (x, i, r, ids[k]))
            if (p := prv[i]) >= 0 and (x := of(ids[p], r)) != _NONE:
                heapq.heappush(heap, (x, p, ids[p], r))
        return np.array([x for x in ids if x >= 0], np.int32)


class WordEncoder:
    """Encodes texts; each distinct word is merged once and then looked up."""

    def __init__(self, path: str, pattern: str = PATTERN):
        import regex

        self.vocabulary = RankVocabulary(path)
        self.find = regex.compile(pattern).findall
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.flat = np.zeros(0, np.int32)
        self.starts = np.zeros(1, np.int64)

    def _learn(self, words: list[str]) -> None:
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        parts: list[np.ndarray | None] = [None] * len(words)
        classes: dict[int, list[int]] = {}
        for i, b in enumerate(raw):
            if len(b) > LONG_WORD:
                parts[i] = self.vocabulary.merge_long(b)
            elif (whole := self.vocabulary.ranks.get(b)) is not None:
                parts[i] = np.array([whole], np.int32)
            else:
                classes.setdefault((len(b) + 7) // 8 if len(b) < 64 else 8 + len(b) // 64, []).append(i)
        for members in classes.values():
            for lo in range(0, len(members), 4096):
                some = members[lo : lo + 4096]
                flat, counts = self.vocabulary.merge_matrix([raw[i] for i in some])
                for i, p in zip(some, np.split(flat, np.cumsum(counts)[:-1])):
                    parts[i] = p
        base = len(self.starts) - 1
        for k, w in enumerate(words):
            self.index[w] = base + k
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        self.flat = np.concatenate([self.flat, *parts])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts, and the offsets of each text in them (one more than texts)."""
        if len(self.index) > MAX_WORDS:
            self._forget()
        words = [self.find(t) if t else [] for t in texts]
        fresh = list({w for ws in words for w in ws if w not in self.index})
        if fresh:
            self._learn(fresh)
        index = self.index
        which = np.fromiter((index[w] for ws in words for w in ws), np.int64)
        per_text = np.fromiter(map(len, words), np.int64, len(words))
        lens = (self.starts[1:] - self.starts[:-1])[which]
        ends = np.cumsum(lens)
        total = int(ends[-1]) if len(ends) else 0
        take = np.arange(total) + np.repeat(self.starts[which] - (ends - lens), lens)
        word_ends = np.concatenate([[0], ends])
        offsets = word_ends[np.concatenate([[0], np.cumsum(per_text)])]
        return self.flat[take], offsets


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The encoder of this worker for a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def _slices(texts: list[str | None], most: int = 2_000_000) -> Iterator[tuple[int, int]]:
    lo = size = 0
    for i, t in enumerate(texts):
        size += len(t) if t else 0
        if size >= most:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def encode_documents(documents: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = BYTE_BPE_50K, folder: str = TOKENIZER_DIR) -> DataFrame:
    """``(key, ids array<int>)`` for every row; no shuffle, one pass."""
    path = os.path.join(folder, vocabulary)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in _slices(texts):
                ids, offsets = enc.encode(texts[lo:hi])
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), lists], [key, "ids"])

    some = documents.select(F.col(key).alias(key), F.col(text).alias("_text"))
    return some.mapInArrow(run, f"`{key}` {some.schema[0].dataType.simpleString()}, ids array<int>")


def count_tokens(documents: DataFrame, keep: list[str], text: str = "text", vocabulary: str = BYTE_BPE_50K, folder: str = TOKENIZER_DIR, out: str = "tokens") -> DataFrame:
    """The columns ``keep`` and the number of tokens of each row's text (0 for null and empty)."""
    path = os.path.join(folder, vocabulary)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            counts = []
            for lo, hi in _slices(texts):
                counts.append(np.diff(enc.encode(texts[lo:hi])[1]))
            n = pa.array(np.concatenate(counts) if counts else np.zeros(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], n], [*keep, out])

    some = documents.select(*[F.col(c).alias(c) for c in keep], F.col(text).alias("_text"))
    schema = ", ".join(f"`{c}` {some.schema[c].dataType.simpleString()}" for c in keep)
    return some.mapInArrow(run, f"{schema}, `{out}` bigint")
