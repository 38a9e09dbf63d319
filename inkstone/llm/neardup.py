"""Near-duplicate records in collections too large for pairwise comparison (problem 4).

Similarity is the Jaccard index of the sets of character 5-grams of the trimmed, lower-cased
texts with single blanks.  Every text is a point: its 5-grams are hashed into ``GROUPS``
groups and the group counts are the coordinates.  The summed coordinate minima of two points
bound the overlap of their sets from above, so a pair (or, in a tree over the points, a pair
of boxes) whose bound is too small is dropped; what survives is verified on the sets.

The points are brought together in blocks first: of the hashed 5-grams of a text the smallest
values under ``HASHES`` orders are taken, and each of ``BANDS`` bands of ``ROWS`` such minima is
a block key.  Two texts of similarity s agree in a minimum with probability s, so they meet in
some block with probability 1 - (1 - s^6)^56: 0.999 at 0.7 and more above, wherever the edits
are, however short the text is and however many texts a group has.  Pairs of a block are first
thinned by sketches (two bits of each of 128 minima; a pair of similarity 0.7 passes but for one
in about a million).  These are the only approximations.  Boxes alone cannot be the top of a distributed tree here: in few dimensions all
texts of one size overlap, in many dimensions every box does (see README for figures).  All
pairs of a block are candidates; a block of more than ``PAIRED`` different texts is searched
whole with a tree over its points.

The keys of ``PACK`` texts are sorted together and go through the shuffle in packs, one for each
range of keys (a bucket), as bytes; a task sorts one bucket at a time, and there are so many
buckets that one has about ``FILL`` keys, whatever the input is.

Hot blocks: a key that more than ``PAIRED`` texts of one pack share is known to be full before
the shuffle, so its rows are spread over all buckets at once and only the key goes to its own
bucket, to tell it; no task reads more than ``PAIRED`` rows of a pack for one key.

Defined results: null, empty and blank texts are no cases; a text of fewer than five
characters is similar only to an equal one; equal texts have similarity 1 and form a class,
which is treated as one text and expanded at the end (every pair up to ``ALL_PAIRS`` members,
else each member with the first one; of two similar classes every pair up to ``ALL_PAIRS``
squared, else each member with the first one of the other class); records delivered twice count once; very long texts
are used whole; an empty table gives no pairs; extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstone.session import materialize

THRESHOLD = 0.7
GRAM = 5
GROUPS = 64
#: Minima that make a block key, and keys of each text (each minimum is in two of them).
ROWS, BANDS = 6, 56
HASHES = ROWS * BANDS // 2
#: Blocks of up to so many different texts are paired directly, fuller ones searched with a tree.
PAIRED = 64
#: Minima of a sketch, and how many of them may differ in their two bits: at a similarity of 0.7 the mean is 28.8, the deviation 4.7.
SKETCH, SKETCH_FAR = 128, 52
ALL_PAIRS = 200
#: Texts whose keys are packed together, and keys of a bucket (about).
PACK, FILL = 32_768, 50_000
#: What stands in the place of sketches: a pack of rows of blocks known to be full, and the pack that tells their buckets.
_FULL, _TELL = b"!", b"!!"

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def normal(text: str) -> str:
    """Trimmed, runs of white space as one blank, lower case."""
    return " ".join(text.split()).lower()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _B
    return x ^ (x >> np.uint64(29))


def _windows(codes: np.ndarray, sizes: set[int]) -> dict[int, np.ndarray]:
    """Hash of the window of each size that begins at each position (doubling)."""
    top = max(sizes)
    pad = np.concatenate([codes.astype(np.uint64) + np.uint64(1), np.zeros(top, np.uint64)])
    powers = {1: _mix(pad * _A)}
    k = 1
    while 2 * k <= top:
        h = powers[k]
        powers[2 * k] = _mix(h * _A + np.concatenate([h[k:], np.zeros(k, np.uint64)]) * _C)
        k *= 2
    out = {}
    for size in sizes:
        at, got = 0, None
        for k in sorted(powers, reverse=True):
            while size - at >= k:
                part = powers[k] if at == 0 else np.concatenate([powers[k][at:], np.zeros(at, np.uint64)])
                got = part if got is None else _mix(got * _A + part * _C + np.uint64(at))
                at += k
        out[size] = got[: len(codes)]
    return out


class Batch:
    """The grams of some texts, as vectors over all their positions."""

    def __init__(self, texts: list[str], sizes: set[int] = frozenset({GRAM})):
        self.lens = np.fromiter(map(len, texts), np.int64, len(texts))
        self.ends = np.cumsum(self.lens)
        self.starts = self.ends - self.lens
        self.codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.doc = np.repeat(np.arange(len(texts)), self.lens)
        self.left = self.ends[self.doc] - np.arange(len(self.codes)) if len(self.codes) else np.zeros(0, np.int64)
        self.hash = _windows(self.codes, set(sizes)) if len(self.codes) else {s: np.zeros(0, np.uint64) for s in sizes}

    def sets(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct 5-grams as (document, hash), sorted by both; texts under five characters give none."""
        ok = self.left >= GRAM
        # one number of the document and the upper bits of the hash sorts much faster than two
        bits = np.uint64(max(1, int(len(self.lens) - 1).bit_length()))
        both = np.sort((self.doc[ok].astype(np.uint64) << (np.uint64(64) - bits)) | (self.hash[GRAM][ok] >> bits))
        new = np.ones(len(both), bool)
        new[1:] = both[1:] != both[:-1]
        both = both[new]
        return (both >> (np.uint64(64) - bits)).astype(np.int64), both << bits


def point(doc: np.ndarray, grams: np.ndarray, n: int) -> np.ndarray:
    """Group counts of each document, n x GROUPS."""
    cell = doc * GROUPS + (grams >> np.uint64(58)).astype(np.int64)
    return np.bincount(cell, minlength=n * GROUPS).reshape(n, GROUPS).astype(np.int32)


def enough(overlap: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Whether an overlap makes a similarity of at least the threshold."""
    return overlap * (1 + threshold) >= threshold * (a + b) - 1e-9


#: Odd factors: each makes another order of the hashed grams.
_ORDERS = (_mix(np.arange(1, HASHES + 1, dtype=np.uint64) * _A) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def minima(texts: list[str], count: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, its smallest grams in the first ``count`` orders as a column) of each text of five characters or more."""
    b = Batch(texts)
    ok = b.left >= GRAM
    doc, h = b.doc[ok], (b.hash[GRAM][ok] >> np.uint64(32)).astype(np.uint32)
    if not len(doc):
        return np.zeros(0, np.int64), np.zeros((count, 0), np.uint32)
    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    least, some = np.empty((count, len(first)), np.uint32), np.empty((min(8, count), len(h)), np.uint32)
    for lo in range(0, count, 8):  # a few orders at a time stay in the processor's cache
        orders = _ORDERS[lo : min(lo + 8, count)]
        np.multiply(h[None, :], orders[:, None], out=some[: len(orders)])
        np.minimum.reduceat(some[: len(orders)], first, axis=1, out=least[lo : lo + len(orders)])
    return doc[first], least


#: One odd factor for each minimum of a key.
_FACTORS = _mix(np.arange(HASHES + 1, HASHES + ROWS + 1, dtype=np.uint64) * _A) | np.uint64(1)


def band_keys(least: np.ndarray) -> np.ndarray:
    """The ``BANDS`` block keys of each text as a column."""
    least = least.astype(np.uint64)
    keys = np.empty((BANDS, least.shape[1]), np.uint64)
    half, marks = BANDS // 2, np.arange(1, BANDS + 1, dtype=np.uint64) * _C
    for band in range(BANDS):
        # neighbouring minima in the first half, minima far apart in the second
        rows = least[band * ROWS : (band + 1) * ROWS] if band < half else least[band - half :: half]
        keys[band] = _mix(_mix((rows * _FACTORS[:, None]).sum(axis=0)) * _A + marks[band])
    return keys


def sketches(least: np.ndarray) -> np.ndarray:
    """The sketch of each text as a row of four words: both bit planes of 64 minima, then of the next 64."""
    # the minima are small numbers; their mixed bits are even
    mixed = _mix(least[:SKETCH].astype(np.uint64) * _B)
    planes = [np.packbits(((mixed[k : k + 64] >> np.uint64(bit)) & np.uint64(1)).astype(np.uint8).T, axis=1) for k in range(0, SKETCH, 64) for bit in (40, 41)]
    return np.stack([np.ascontiguousarray(p).view(np.int64)[:, 0] for p in planes], axis=1)


class RTree:
    """Points packed into boxes by splitting at the median of the widest coordinate."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, leaf: int = 16):
        self.points, self.sizes = points, sizes
        self.nodes: list[tuple[np.ndarray, int, int, int, int, np.ndarray | None]] = []
        self.leaf = leaf
        self.root = self._build(np.arange(len(points)))

    def _build(self, rows: np.ndarray) -> int:
        sub = self.points[rows]
        high = sub.max(axis=0)
        least, most = int(self.sizes[rows].min()), int(self.sizes[rows].max())
        if len(rows) <= self.leaf:
            self.nodes.append((high, least, most, -1, -1, rows))
            return len(self.nodes) - 1
        axis = int((high - sub.min(axis=0)).argmax())
        order = rows[np.argsort(sub[:, axis], kind="stable")]
        a, b = self._build(order[: len(order) // 2]), self._build(order[len(order) // 2 :])
        self.nodes.append((high, least, most, a, b, None))
        return len(self.nodes) - 1

    def pairs(self, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of points whose summed coordinate minima allow the threshold."""
        left, right = [], []
        stack = [(self.root, self.root)]
        while stack:
            x, y = stack.pop()
            ha, la, ma, a1, a2, ra = self.nodes[x]
            hb, lb, mb, b1, b2, rb = self.nodes[y]
            # the overlap is at most the minima of the boxes' upper corners, and at least t / (1 + t) of the two sizes
            most = min(int(np.minimum(ha, hb).sum()), ma, mb)
            if most * (1 + threshold) < threshold * (la + lb) - 1e-9:
                continue
            if ra is not None and rb is not None:
                over = np.minimum(self.points[ra][:, None, :], self.points[rb][None, :, :]).sum(axis=2)
                i, j = np.nonzero(enough(over, self.sizes[ra][:, None], self.sizes[rb][None, :], threshold))
                a, b = ra[i], rb[j]
                keep = a < b if x == y else np.ones(len(a), bool)
                left.append(a[keep])
                right.append(b[keep])
            elif x == y:
                stack += [(a1, a1), (a2, a2), (a1, a2)]
            elif ra is None and (rb is not None or ma >= mb):
                stack += [(a1, y), (a2, y)]
            else:
                stack += [(x, b1), (x, b2)]
        none = np.zeros(0, np.int64)
        return np.concatenate(left or [none]), np.concatenate(right or [none])


#: Columns of a sketch.
_WORDS = [f"s{w}" for w in range(SKETCH // 32)]
#: Texts of a full block that one task searches are at most about twice this many.
CHUNK = 2000


def _tree_pairs(rows: DataFrame, threshold: float) -> DataFrame:
    """Candidate pairs of full blocks (key, class, h, n, point, s0 to s3), by trees over their points.

    A large block is cut into chunks by hash, and each pair of chunks is a group of its own, so
    that no task holds a block whose size follows the data.
    """
    sizes = rows.groupBy("key", "class").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > 1)
    cut = rows.join(sizes, ["key", "class"]).withColumn("chunks", F.ceil(F.col("c") / CHUNK).cast("int"))
    cut = cut.withColumn("mine", F.pmod(F.xxhash64("h"), F.col("chunks")).cast("int"))
    others = F.sequence(F.lit(0), F.col("chunks") - 1)
    cut = cut.withColumn("other", F.explode(others)).withColumn("i", F.least("mine", "other")).withColumn("j", F.greatest("mine", "other"))

    def run(table: pa.Table) -> pa.Table:
        hs, mine = table.column("h").to_numpy(), table.column("mine").to_numpy()
        one = table.column("i")[0].as_py() == table.column("j")[0].as_py()
        i, j = RTree(_matrix(table.column("point")), table.column("n").to_numpy()).pairs(threshold)
        s = [table.column(f"s{w}").to_numpy().view(np.uint64) for w in range(4)]
        apart = [np.bitwise_count((s[w][i] ^ s[w][j]) | (s[w + 1][i] ^ s[w + 1][j])) for w in (0, 2)]
        near = (apart[0].astype(np.int32) + apart[1] <= SKETCH_FAR) & (one | (mine[i] != mine[j]))
        i, j = i[near], j[near]
        return pa.table({"a": pa.array(np.minimum(hs[i], hs[j])), "b": pa.array(np.maximum(hs[i], hs[j]))})

    cut = cut.select("key", "class", "i", "j", "h", "n", "point", "mine", *_WORDS)
    return cut.groupBy("key", "class", "i", "j").applyInArrow(run, "a bigint, b bigint").distinct()


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Points from their bytes (one byte a coordinate, or four)."""
    raw = column.to_pylist()
    out = np.zeros((len(raw), GROUPS), np.int32)
    wide = np.fromiter((len(r) != GROUPS for r in raw), bool, len(raw))
    if not wide.all():
        out[~wide] = np.frombuffer(b"".join(r for r in raw if len(r) == GROUPS), np.uint8).reshape(-1, GROUPS)
    for i in np.flatnonzero(wide):
        out[i] = np.frombuffer(raw[i], np.uint32)
    return out


#: A task leaves out the grams of a text that it has met among its last so many texts.
SEEN = 200_000


def _slices(texts: list[str], most: int = 100_000) -> Iterator[tuple[int, int]]:
    """Parts of the texts of about so many characters: their vectors stay in the processor's cache."""
    lo = chars = 0
    for i, t in enumerate(texts):
        chars += len(t)
        if chars >= most:
            yield lo, i + 1
            lo, chars = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def _hash(table: str, text: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(f"{table}\0{text}".encode("utf-8", "surrogatepass")) - (1 << 63)


def _members(records: DataFrame) -> DataFrame:
    """(tbl, id, h) of each record with a text; h identifies text and table."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_pylist()
            texts = [normal(t) if t else "" for t in batch.column(2).to_pylist()]
            some = pa.array([i for i, t in enumerate(texts) if t], pa.int64())
            hs = [_hash(n, t) for n, t in zip(names, texts) if t]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(some), batch.column(1).take(some), pa.array(hs, pa.int64())], ["tbl", "id", "h"])

    return records.mapInArrow(run, "tbl string, id bigint, h bigint")


def _bucket(x: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each 64-bit number; larger numbers have no smaller one."""
    return ((x >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)


def _packs(bucket: np.ndarray, keys: np.ndarray | None, hs: np.ndarray | None, shown: np.ndarray | bytes | None) -> pa.RecordBatch:
    """(bucket, keys, hs, sketch): a row for each bucket of rows that are sorted by bucket."""
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    ends = np.append(first, len(bucket))

    def raw(values: np.ndarray | None) -> pa.Array:
        if values is None:
            return pa.nulls(len(first), pa.binary())
        data = np.ascontiguousarray(values)
        offsets = (ends * (data.nbytes // len(data))).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(data)])

    sketch = pa.array([shown] * len(first), pa.binary()) if isinstance(shown, bytes) else raw(shown)
    return pa.RecordBatch.from_arrays([pa.array(bucket[first]), raw(keys), raw(hs), sketch], ["bucket", "keys", "hs", "sketch"])


def _block_rows(records: DataFrame, buckets: int = 64) -> DataFrame:
    """(bucket, keys, hs, sketch) in packs: the keys of each text with its hash; hashes with sketches; rows of full blocks.

    A key is its bucket and 32 bits more, which alone are in the packs of its bucket: of the keys
    of a bucket, one in about 86,000 meets another by chance, so two blocks may become one, but none is cut.
    Copies of a text that one task meets give their keys once, so that a text that a third
    of all records repeat fills no block.  Rows of keys that are full within a pack are marked.
    """
    import xxhash

    coarse = max(1, buckets // 16)  # a text has one sketch, but many keys

    def own(keys: np.ndarray, hs: np.ndarray | None, shown: bytes | None) -> pa.RecordBatch:
        return _packs((keys >> np.uint64(32)).astype(np.int32), keys.astype(np.uint32), hs, shown)

    def packed(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        keys, hs, words = np.concatenate([p[0] for p in parts], axis=1), np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])
        n = len(hs)
        at = np.argsort(hs.view(np.uint64))
        yield _packs(_bucket(hs[at].view(np.uint64), coarse) * np.int32(buckets // coarse), None, hs[at], words[at])
        keys = keys.ravel()
        keys = (_bucket(keys, buckets).astype(np.uint64) << np.uint64(32)) | (keys & np.uint64(0xFFFFFFFF))
        at = np.argsort(keys)
        keys, hs = keys[at], hs[at % n]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        count = np.diff(np.append(first, len(keys)))
        if (count > PAIRED).any():
            yield own(keys[first[count > PAIRED]], None, _TELL)
            away = np.repeat(count > PAIRED, count)
            k, h = keys[away], hs[away]
            anywhere = _bucket(_mix(h.view(np.uint64) * _C), buckets)
            at = np.argsort(anywhere, kind="stable")
            yield _packs(anywhere[at], k[at], h[at], _FULL)
            keys, hs = keys[~away], hs[~away]
        if len(keys):
            yield own(keys, hs, None)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        parts, held = [], 0
        for batch in batches:
            fresh = []
            for n, t in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                t = normal(t) if t else ""
                if t and (h := _hash(n, t)) not in seen:
                    seen.add(h)
                    fresh.append((n, t, h))
            if len(seen) > SEEN:
                seen.clear()
            if not fresh:
                continue
            salts = {n: xxhash.xxh3_64_intdigest(n) for n in {f[0] for f in fresh}}
            texts = [t for _, t, _ in fresh]
            got = [(lo, *minima(texts[lo:hi], HASHES)) for lo, hi in _slices(texts)]
            doc, least = np.concatenate([lo + d for lo, d, _ in got]), np.concatenate([x for _, _, x in got], axis=1)
            if not len(doc):
                continue
            keys = band_keys(least) ^ np.array([salts[n] for n, _, _ in fresh], np.uint64)[doc]
            parts.append((keys, np.array([h for _, _, h in fresh], np.int64)[doc], sketches(least)))
            held += len(doc)
            if held >= PACK:
                yield from packed(parts)
                parts, held = [], 0
        if parts:
            yield from packed(parts)

    return records.mapInArrow(run, "bucket int, keys binary, hs binary, sketch binary")


def _block_pairs(rows: DataFrame) -> DataFrame:
    """All pairs (a, b) of blocks of 2 to PAIRED texts; of fuller blocks every row (key, h); sketches (h, s0 to s3), each text once.

    ``rows`` are packs sorted by bucket.  One bucket is held at a time.
    """
    names = ["key", "h", "a", "b", *_WORDS]

    def numbers(column: pa.Array | pa.ChunkedArray, kind: type = np.int64) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), kind)

    def shown(**columns: np.ndarray) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([pa.array(columns[c].view(np.int64)) if c in columns else pa.nulls(n, pa.int64()) for c in names], names)

    def one(packs: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(packs)
        long = pc.fill_null(pc.binary_length(t.column("sketch")), 0).to_numpy()
        if (long > len(_TELL)).any():
            some = t.filter(pa.array(long > len(_TELL)))
            h, at = np.unique(numbers(some.column("hs")), return_index=True)
            words = numbers(some.column("sketch")).reshape(-1, len(_WORDS))[at]
            yield shown(h=h, **{w: np.ascontiguousarray(words[:, i]) for i, w in enumerate(_WORDS)})
        if (long == len(_FULL)).any():
            some = t.filter(pa.array(long == len(_FULL)))
            yield shown(key=numbers(some.column("keys")), h=numbers(some.column("hs")))
        some = t.filter(pa.array(long == 0))
        k, h = numbers(some.column("keys"), np.uint32), numbers(some.column("hs"))
        if not len(k):
            return
        told = np.unique(numbers(t.filter(pa.array(long == len(_TELL))).column("keys"), np.uint32))
        order = np.argsort(k)
        k, h = k[order], h[order]
        again = k[1:] == k[:-1]
        met = np.concatenate([[False], again]) | np.concatenate([again, [False]])
        if len(told):
            met |= np.isin(k, told)
        k, h = k[met], h[met]
        if not len(k):
            return
        order = np.lexsort((h, k))
        k, h = k[order], h[order]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (h[1:] != h[:-1])  # copies of a text count once
        k, h = k[new], h[new]
        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        count = np.diff(np.append(first, len(k)))
        full = np.repeat(count > PAIRED, count) | np.isin(k, told)
        if full.any():
            yield shown(key=k[full].astype(np.int64) | (packs[0].column(0)[0].as_py() << 32), h=h[full])
            k, h = k[~full], h[~full]
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for o in range(1, PAIRED):
            i = np.flatnonzero(k[:-o] == k[o:]) if len(k) > o else ()
            if not len(i):
                break
            left.append(h[i])
            right.append(h[i + o])
        yield shown(a=np.concatenate(left), b=np.concatenate(right))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            bucket = batch.column(0).to_numpy()
            first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])).tolist()
            for lo, hi in zip(first, [*first[1:], len(bucket)]):
                if bucket[lo] != last and held:
                    yield from one(held)
                    held = []
                last = bucket[lo]
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield from one(held)

    return rows.mapInArrow(run, ", ".join(f"{n} bigint" for n in names))


def candidates(records: DataFrame, texts: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs (a < b) of texts that meet in some block, once for each, (key, h) of full blocks, and (h, s0 to s3) of each text.

    ``texts``: about how many there are.
    """
    buckets = max(1, texts * BANDS // FILL)
    # so many tasks that each has some buckets, whatever the input is
    tasks = max(min(buckets, int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))), buckets // 32)
    rows = _block_rows(records, buckets).repartition(tasks, "bucket").sortWithinPartitions("bucket")
    found = materialize(_block_pairs(rows), "blocks")
    pairs = found.where(F.col("a").isNotNull()).select("a", "b")
    full = found.where(F.col("key").isNotNull()).select("key", "h").distinct()
    return pairs, full, found.where(F.col("s0").isNotNull()).select("h", *_WORDS)


def thinned(pairs: DataFrame, sketch: DataFrame) -> DataFrame:
    """The distinct pairs (a, b) whose sketches are near."""
    a = sketch.select(F.col("h").alias("a"), *[F.col(w).alias(f"a{w}") for w in _WORDS])
    b = sketch.select(F.col("h").alias("b"), *[F.col(w).alias(f"b{w}") for w in _WORDS])
    differ = [F.col(f"a{w}").bitwiseXOR(F.col(f"b{w}")) for w in _WORDS]
    apart = F.bit_count(differ[0].bitwiseOR(differ[1])) + F.bit_count(differ[2].bitwiseOR(differ[3]))
    return pairs.distinct().join(a, "a").join(b, "b").where(apart <= SKETCH_FAR).select("a", "b")


def _points(texts: DataFrame) -> DataFrame:
    """(h, size of the set, point as bytes, text): the coordinates of each text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_ = [normal(t) for t in batch.column(1).to_pylist()]
            for lo, hi in _slices(all_):
                doc, grams = Batch(all_[lo:hi]).sets()
                points = point(doc, grams, hi - lo)
                sizes = np.bincount(doc, minlength=hi - lo)
                raw = [p.astype(np.uint8 if p.max() < 256 else np.uint32).tobytes() for p in points]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(sizes, pa.int32()), pa.array(raw, pa.binary()), pa.array(all_[lo:hi], pa.string())], ["h", "n", "point", "text"])

    return texts.mapInArrow(run, "h bigint, n int, point binary, text string")


def bounded(pairs: DataFrame, points: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The pairs (a, b) whose summed coordinate minima allow the threshold."""
    left = pairs.join(points.select(F.col("h").alias("a"), F.col("n").alias("na"), F.col("point").alias("pa")), "a")
    both = left.join(points.select(F.col("h").alias("b"), F.col("n").alias("nb"), F.col("point").alias("pb")), "b")
    close = F.least("na", "nb") * (1 + threshold) >= threshold * (F.col("na") + F.col("nb")) - 1e-9
    both = both.where(close).select("a", "b", "na", "nb", "pa", "pb")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            over = np.minimum(_matrix(batch.column(4)), _matrix(batch.column(5))).sum(axis=1)
            ok = enough(over, batch.column(2).to_numpy(), batch.column(3).to_numpy(), threshold)
            idx = pa.array(np.flatnonzero(ok), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(idx), batch.column(1).take(idx)], ["a", "b"])

    return both.mapInArrow(run, "a bigint, b bigint")


def similar_pairs(pairs: DataFrame, texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Verify pairs on the sets; ``texts``: (h, text)."""
    left = pairs.join(texts.select(F.col("h").alias("a"), F.col("text").alias("ta")), "a")
    both = left.join(texts.select(F.col("h").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in _slices(batch.column(2).to_pylist()):
                part = batch.slice(lo, hi - lo)
                sims = similarities(part.column(2).to_pylist(), part.column(3).to_pylist())
                idx = pa.array(np.flatnonzero(sims >= threshold - 1e-12), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(idx), part.column(1).take(idx), pa.array(sims[idx.to_numpy()])], ["a", "b", "similarity"])

    return both.mapInArrow(run, "a bigint, b bigint, similarity double")


def similarities(ta: list[str], tb: list[str]) -> np.ndarray:
    """Exact similarity of each pair of normalised texts."""
    texts = list(dict.fromkeys(ta + tb))
    place = {t: i for i, t in enumerate(texts)}
    doc, grams = Batch(texts).sets()
    size = np.bincount(doc, minlength=len(texts))
    first = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(len(ta))
    for i, (x, y) in enumerate((place[s], place[t]) for s, t in zip(ta, tb)):
        if size[x] == 0 or size[y] == 0:
            out[i] = float(x == y)
            continue
        a, b = grams[first[x] : first[x + 1]], grams[first[y] : first[y + 1]]
        at = np.minimum(np.searchsorted(b, a), len(b) - 1)
        both = int((b[at] == a).sum())
        out[i] = both / (len(a) + len(b) - both)
    return out


def near_duplicates(records: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(tbl, id_a, id_b)`` of ``records (tbl, id, text)``: all pairs of similar records of one table."""
    records = records.select("tbl", "id", "text")
    members = materialize(_members(records).distinct(), "members")
    classes = materialize(members.groupBy("tbl", "h").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("first")), "classes")
    pairs, rest, sketch = candidates(records, classes.count())
    sketch = materialize(sketch, "sketches")
    pairs, rest = materialize(thinned(pairs, sketch), "pairs"), materialize(rest, "rest")
    needed = pairs.select(F.explode(F.array("a", "b")).alias("h")).unionByName(rest.select("h")).distinct()
    where = classes.select("h", "tbl", F.col("first").alias("id"))
    shown = needed.join(where, "h").join(records, ["tbl", "id"]).select("h", "text")
    points = materialize(_points(shown).dropDuplicates(["h"]), "points")
    # similar texts are of one size class or of neighbouring ones
    step = F.floor(F.log(F.greatest(F.col("n"), F.lit(1))) / float(-np.log(threshold)))
    rest = rest.join(points.select("h", "n", "point"), "h").join(sketch, "h").select("key", F.explode(F.array(step, step + 1)).alias("class"), "h", "n", "point", *_WORDS)
    close = bounded(pairs, points, threshold).unionByName(_tree_pairs(rest, threshold)).distinct()
    similar = materialize(similar_pairs(close, points.select("h", "text"), threshold), "similar")
    many = materialize(members.join(classes.where(F.col("c") > 1).select("h", "c", "first"), "h"), "many")
    across = _across(similar.select("a", "b"), classes, many)
    return across.unionByName(_within(many)).select("tbl", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def _across(similar: DataFrame, classes: DataFrame, many: DataFrame) -> DataFrame:
    """Pairs of records of two similar classes: all of small ones, of large ones each with the first of the other.

    ``many``: the records of classes with more than one; the record of any other class is its first.
    """
    a = classes.select("tbl", F.col("h").alias("a"), F.col("c").alias("ca"), F.col("first").alias("fa"))
    b = classes.select(F.col("h").alias("b"), F.col("c").alias("cb"), F.col("first").alias("fb"))
    both = materialize(similar.join(a, "a").join(b, "b"), "across")
    left, right = many.select(F.col("h").alias("a"), F.col("id").alias("x")), many.select(F.col("h").alias("b"), F.col("id").alias("y"))
    x, y = F.coalesce("x", "fa").alias("x"), F.coalesce("y", "fb").alias("y")
    large = F.col("ca") * F.col("cb") > ALL_PAIRS**2
    every = both.where(~large).join(left, "a", "left").join(right, "b", "left").select("tbl", x, y)
    to_first = both.where(large).join(left, "a", "left").select("tbl", x, F.col("fb").alias("y"))
    from_first = both.where(large).join(right, "b", "left").select("tbl", F.col("fa").alias("x"), y)
    return every.unionByName(to_first.unionByName(from_first).distinct())  # both stars have the pair of the first ones


def _within(many: DataFrame) -> DataFrame:
    """Pairs of records with equal texts: all of a small class, a star of a large one."""
    small = many.where(F.col("c") <= ALL_PAIRS)
    every = small.select("tbl", "h", F.col("id").alias("x")).join(small.select("h", F.col("id").alias("y")), "h").where(F.col("x") < F.col("y")).select("tbl", "x", "y")
    star = many.where((F.col("c") > ALL_PAIRS) & (F.col("id") != F.col("first"))).select("tbl", F.col("first").alias("x"), F.col("id").alias("y"))
    return every.unionByName(star)
