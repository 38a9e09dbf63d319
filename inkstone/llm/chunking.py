"""Cutting oversized texts into overlapping pieces at natural boundaries (problem 1).

Lexical-cohesion segmentation: the text is seen as a row of sentences; at each gap between
sentences the word counts of the blocks before and behind are compared (cosine), and the
depth of each valley of that curve says how much the topic changes there.  A piece ends at
the deepest valley of the window in which it has to end, else at the last clause mark, else
at the last white space, and only in a stretch without any of them by force.

Defined results: texts up to the limit, null and empty texts give no rows; a piece never has
more characters than the limit, its overlap included; the overlap shrinks, down to nothing,
where it would make a forced cut necessary; of two equally deep valleys the later one is
taken; a null page gives null pages; a text delivered twice gives its pieces twice (the
caller keeps one); extra columns are not looked at; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from math import sqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 900
OVERLAP = 120
#: Sentences in each of the two compared blocks.
BLOCK = 3
#: A piece is at least this share of its window, if a boundary allows it.
LEAST = 0.4
#: Besides white space, the marks at which a text may be cut.
MARKS = ".!?;:,。！？；：，、"

_BREAK = re.compile(rf"[\s{re.escape(MARKS)}]")
_SENTENCE = re.compile(r"[.!?]+[\"'”’»)\]]*\s+(?=\S)|[。！？]+[”’」』）]*\s*(?=\S)|\n\s*\n\s*|\f\s*")
_CLAUSE = re.compile(r"[;:,；：，、]\s*(?=\S)")
_WORD = re.compile(r"[^\W\d_]{2,}")
_HAN = re.compile(r"[぀-ヿ㐀-鿿]")


def _terms(s: str) -> Counter:
    out: Counter = Counter()
    for w in _WORD.findall(s.lower()):
        if _HAN.match(w):
            out.update(w[i : i + 2] for i in range(len(w) - 1))
        else:
            out[w[:6]] += 1
    return out


def cohesion_depths(text: str, ends: list[int]) -> dict[int, float]:
    """Depth of the cohesion valley at each sentence end (a position in the text)."""
    units, lo = [], 0
    for e in [*ends, len(text)]:
        units.append(_terms(text[lo:e]))
        lo = e
    n = len(ends)
    scores = []
    left: Counter = Counter()
    right: Counter = Counter()
    for u in units[1 : BLOCK + 1]:
        right.update(u)
    for g in range(n):  # the gap behind unit g; both blocks slide by one unit
        left.update(units[g])
        if g >= BLOCK:
            left.subtract(units[g - BLOCK])
        if g:
            right.subtract(units[g])
            if g + BLOCK < len(units):
                right.update(units[g + BLOCK])
        small, large = (left, right) if len(left) < len(right) else (right, left)
        dot = sum(c * large[w] for w, c in small.items() if c and w in large)
        norm = sqrt(sum(c * c for c in left.values()) * sum(c * c for c in right.values()))
        scores.append(dot / norm if norm else 0.0)
    before, after, peak = [0.0] * n, [0.0] * n, 0.0
    for g in range(n):  # highest point on the climb to the left, likewise to the right
        peak = max(peak, scores[g]) if g and scores[g - 1] >= scores[g] else scores[g]
        before[g] = peak
    peak = 0.0
    for g in range(n - 1, -1, -1):
        peak = max(peak, scores[g]) if g < n - 1 and scores[g + 1] >= scores[g] else scores[g]
        after[g] = peak
    return {e: before[g] + after[g] - 2 * scores[g] for g, e in enumerate(ends)}


def _last(positions: list[int], lo: int, hi: int) -> int | None:
    """The largest of the sorted positions in [lo, hi]."""
    from bisect import bisect_right

    i = bisect_right(positions, hi)
    return positions[i - 1] if i and positions[i - 1] >= lo else None


def cut_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int, bool]]:
    """Pieces as (start with overlap, start of what is new, end, forced); positions from 0."""
    size = len(text)
    if size <= limit:
        return [(0, 0, size, False)] if size else []
    from bisect import bisect_left, bisect_right

    ends = [m.end() for m in _SENTENCE.finditer(text) if m.end() < size]
    depth = cohesion_depths(text, ends)
    clauses = [m.end() for m in _CLAUSE.finditer(text)]
    breaks = sorted({p for m in _BREAK.finditer(text) for p in (m.start(), m.end()) if 0 < p < size})
    out: list[tuple[int, int, int, bool]] = []
    start, tail = 0, 0  # where the next piece's new part begins; characters repeated before it
    while True:
        if size - start + tail <= limit:
            out.append((start - tail, start, size, False))
            return out
        if _last(breaks, start + 1, start + limit - tail) is None:
            tail = 0  # only a shorter overlap can save a natural cut
        hi = start + limit - tail
        forced = False
        lo = start + int(LEAST * (hi - start))
        some = ends[bisect_left(ends, lo) : bisect_right(ends, hi)]
        if some:
            end = max(some, key=lambda e: (depth[e], e))
        else:
            end = _last(clauses, lo, hi) or _last(breaks, lo, hi) or _last(ends, start + 1, hi) or _last(breaks, start + 1, hi)
            if end is None:
                end, forced = hi, True
        out.append((start - tail, start, end, forced))
        # the overlap begins behind a break, so that no word is cut
        first = max(start, end - overlap)
        i = bisect_left(breaks, first)
        begin = breaks[i] if i < len(breaks) and breaks[i] < end else end
        while begin < end and text[begin].isspace():
            begin += 1
        tail = end - begin
        start = end


def split_oversized(nodes: DataFrame, key: str = "node_no", text: str = "text", page: str = "page", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """One row per piece of every text over ``limit`` characters.

    ``piece_no`` from 1, ``piece`` (the text), ``start_pos``/``end_pos`` (from 1, overlap
    included), ``overlap`` (repeated characters), ``page`` where its new part begins,
    ``last_page`` where it ends, ``cut`` (``natural`` or ``forced``).  No shuffle.
    """
    kind = nodes.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in range(9)]
            for k, t, p in zip(*(c.to_pylist() for c in batch.columns)):
                for no, (a, new, b, forced) in enumerate(cut_text(t, limit, overlap), 1):
                    last = b - 1
                    while last > new and t[last].isspace():
                        last -= 1
                    first_page = None if p is None else p + t.count("\f", 0, new)
                    last_page = None if p is None else p + t.count("\f", 0, last + 1)
                    for col, v in zip(rows, (k, no, t[a:b], a + 1, b, new - a, first_page, last_page, "forced" if forced else "natural")):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, _schema(batch.schema[0]))], schema=_schema(batch.schema[0]))

    def _schema(first: pa.Field) -> pa.Schema:
        i = pa.int32()
        return pa.schema([first.with_name("key"), ("piece_no", i), ("piece", pa.string()), ("start_pos", i), ("end_pos", i), ("overlap", i), ("page", i), ("last_page", i), ("cut", pa.string())])

    long_ = nodes.where(F.length(text) > limit).select(F.col(key).alias("key"), F.col(text).alias("_text"), F.col(page).cast("int").alias("_page"))
    return long_.mapInArrow(run, f"key {kind}, piece_no int, piece string, start_pos int, end_pos int, overlap int, page int, last_page int, cut string").withColumnRenamed("key", key)


def oversized_nodes(pieces: DataFrame, key: str = "node_no") -> DataFrame:
    """Per text: whether a cut had to be forced, and the page on which it ends."""
    per = pieces.groupBy(key).agg(F.max((F.col("cut") == "forced").cast("int")).alias("_forced"), F.max("last_page").alias("last_page"))
    return per.select(key, F.when(F.col("_forced") == 1, "forced").otherwise("natural").alias("cut"), "last_page")
