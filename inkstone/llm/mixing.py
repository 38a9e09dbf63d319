"""Mixing sources to target weights, measured in tokens (problem 8).

The mixture has a wanted size; each source gets its target share of it.  Without a wanted
size it is the largest at which every source that has documents keeps its share (what a
source without any documents lacks goes to all others in proportion).  A source that has
fewer tokens is used several times, at most ``max_repeats`` times; with a larger wanted size
what it still lacks goes to the other sources in proportion to their targets.  A document of a source that is
used r times on average is taken floor(r) times for certain and once more with probability
r - floor(r).  Which documents are taken once more is drawn by the cube method: inside blocks
of a source the vector of probabilities moves in the null space of the constraints (tokens
and documents) until all but a few entries are 0 or 1; what is left of all blocks moves on
through fewer blocks, and the last few are rounded (landing) so that the token total is
met as nearly as possible.  Units are taken by falling size, so the last open ones are small.

Defined results: documents of null or unlisted sources, and null and empty texts (0 tokens),
are not taken; sources without documents reach 0; a target share of 0 or a limit of 0 takes
nothing; null limits count as 1; documents with the same id are drawn each by itself; an
empty table gives no documents and shares of 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.llm import tokenize
from inkstone.session import materialize

#: Documents in a block of the flight phase.
BLOCK = 4000
#: Probabilities this close to 0 or 1 are 0 or 1.
EPS = 1e-9
#: Open units whose every choice is tried at the landing.
TRIED = 12


def flight(pi: np.ndarray, x: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Fast flight phase: moves ``pi`` with ``x' (pi* / pi)`` kept, unit by unit in ``order``.

    ``x`` is n x 2 (what is balanced: the quantities to be kept, as x_k per unit of pi).  At
    most two entries stay strictly between 0 and 1.
    """
    pi = pi.astype(float).copy()
    live: list[int] = []
    rng = np.random.default_rng(int(len(pi)) * 7919 + int(order[0]) if len(order) else 0)
    draws = rng.random(len(order) + 3)
    xs = x.tolist()
    p = pi.tolist()
    used = 0
    for k in order.tolist():
        if not EPS < p[k] < 1 - EPS:
            p[k] = 0.0 if p[k] <= EPS else 1.0
            continue
        live.append(k)
        if len(live) < 3:
            continue
        a, b, c = live
        (a0, a1), (b0, b1), (c0, c1) = xs[a], xs[b], xs[c]
        # the null vector of the 2 x 3 matrix of the three units: a cross product
        u = (b0 * c1 - b1 * c0, c0 * a1 - c1 * a0, a0 * b1 - a1 * b0)
        if max(map(abs, u)) < 1e-12:
            # the three are proportional: move two of them against each other
            u = (1.0, -a0 / b0 if b0 else -1.0, 0.0)
        most1 = min(((1 - p[i]) / v if v > 0 else p[i] / -v) for i, v in zip(live, u) if abs(v) > 1e-15)
        most2 = min((p[i] / v if v > 0 else (1 - p[i]) / -v) for i, v in zip(live, u) if abs(v) > 1e-15)
        step = most1 if draws[used] < most2 / (most1 + most2) else -most2
        used += 1
        for i, v in zip(live, u):
            p[i] = min(1.0, max(0.0, p[i] + step * v))
        live = [i for i in live if EPS < p[i] < 1 - EPS]
        for i in (a, b, c):
            if i not in live:
                p[i] = 0.0 if p[i] < 0.5 else 1.0
    return np.array(p)


def landing(pi: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Round the last few so that the token total is met as nearly as possible (ties: fewer documents)."""
    out = pi.copy()
    open_ = np.flatnonzero((out > EPS) & (out < 1 - EPS))
    if not len(open_):
        return np.round(out)
    want = float((out[open_] * tokens[open_]).sum())
    open_ = open_[np.argsort(-tokens[open_], kind="stable")]
    # all but the smallest are taken while they fit, then every choice of the smallest is tried
    for k in open_[:-TRIED] if len(open_) > TRIED else ():
        out[k] = float(tokens[k] <= want)
        want -= out[k] * float(tokens[k])
    open_ = open_[-TRIED:]
    best, pick = None, 0
    for mask in range(1 << len(open_)):
        got = sum(float(tokens[k]) for i, k in enumerate(open_) if mask >> i & 1)
        key = (abs(got - want), bin(mask).count("1"))
        if best is None or key < best:
            best, pick = key, mask
    for i, k in enumerate(open_):
        out[k] = float(pick >> i & 1)
    return np.round(out)


def plan(totals: list[tuple[str, int]], targets: list[tuple[str, float, int | None]], size: float | None = None) -> dict[str, tuple[float, float]]:
    """``source -> (uses per document, wanted tokens)``; ``size``: wanted tokens, else all that there are."""
    have = dict(totals)
    share = {s: max(0.0, w or 0.0) for s, w, _ in targets}
    most = {s: (1 if m is None else max(0, m)) * have.get(s, 0) for s, _, m in targets}
    total = float(sum(have.get(s, 0) for s in share)) if size is None else float(size)
    got = {s: 0.0 for s in share}
    open_ = {s for s in share if share[s] > 0 and most[s] > 0}
    rest = total
    while open_ and rest > 1e-9:
        weight = sum(share[s] for s in open_)
        full = {s for s in open_ if rest * share[s] / weight >= most[s]}
        if not full:
            for s in open_:
                got[s] = rest * share[s] / weight
            break
        for s in full:
            got[s] = float(most[s])
        rest = total - sum(got.values())
        open_ -= full
    return {s: (got[s] / have[s] if have.get(s) else 0.0, got[s]) for s in share}


def largest_size(totals: list[tuple[str, int]], targets: list[tuple[str, float, int | None]]) -> float:
    """The most tokens of which every source that has any can have its share."""
    have = dict(totals)
    most = {s: (w, (1 if m is None else max(0, m)) * have.get(s, 0)) for s, w, m in targets if w and w > 0}
    usable = {s: x for s, x in most.items() if x[1] > 0}
    return sum(w for w, _ in usable.values()) * min((t / w for w, t in usable.values()), default=0.0)


def _flight_blocks(rows: DataFrame, last: bool) -> DataFrame:
    """Flight inside the groups (source, block); on the last level the rest is landed."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("tokens", "descending"), ("salt", "ascending"), ("doc_id", "ascending")])
        pi = np.array(table.column("pi").to_pylist(), float)
        tokens = np.array(table.column("tokens").to_pylist(), float)
        scale = tokens.mean() or 1.0
        out = flight(pi, np.column_stack([tokens / scale, np.ones(len(pi))]), np.arange(len(pi)))
        if last:
            out = landing(out, tokens)
        return table.set_column(table.schema.get_field_index("pi"), "pi", pa.array(out))

    return rows.groupBy("source", "block").applyInArrow(run, rows.schema)


def mix(documents: DataFrame, targets: DataFrame, size: float | None = None, vocabulary: str = tokenize.BYTE_BPE_50K, folder: str = tokenize.TOKENIZER_DIR) -> DataFrame:
    """One row per taken document: ``doc_id, source, tokens, copies``; without a ``size`` the largest that meets every share."""
    wanted = [(r[0], r[1], r[2]) for r in targets.select("source", "target_share", "max_repeats").collect()]  # a fixed small table
    known = documents.where(F.col("source").isin(*[s for s, _, _ in wanted])) if wanted else documents.limit(0)
    counted = materialize(tokenize.count_tokens(known, ["doc_id", "source"], vocabulary=vocabulary, folder=folder).where(F.col("tokens") > 0), "tokens")
    stats = counted.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")).collect()  # one row per source
    totals = [(r["source"], r["tokens"]) for r in stats]
    uses = plan(totals, wanted, largest_size(totals, wanted) if size is None else size)
    rate = F.create_map(*[F.lit(x) for s, (u, _) in sorted(uses.items()) for x in (s, float(u))]) if uses else F.create_map(F.lit(""), F.lit(0.0))
    drawn = counted.withColumn("_u", F.coalesce(F.try_element_at(rate, F.col("source")), F.lit(0.0)))
    drawn = drawn.withColumn("sure", F.floor("_u").cast("int")).withColumn("pi", F.col("_u") - F.floor("_u")).drop("_u")
    drawn = drawn.withColumn("salt", F.xxhash64("doc_id", "tokens"))
    docs = max([r["docs"] for r in stats], default=1)
    blocks = max(1, -(-docs // BLOCK))
    settled = drawn.where(F.col("pi") <= EPS)
    open_ = drawn.where(F.col("pi") > EPS)
    parts = [settled]
    while True:
        last = blocks == 1
        rows = open_.withColumn("block", F.pmod("salt", F.lit(blocks)).cast("int"))
        done = materialize(_flight_blocks(rows, last), "flight").drop("block")
        still = (F.col("pi") > EPS) & (F.col("pi") < 1 - EPS)
        parts.append(done.where(~still))
        if last:
            break
        # at most two of a block are left, so the next level has far fewer blocks
        open_, blocks = done.where(still), max(1, 2 * blocks // BLOCK)
        open_ = open_.withColumn("salt", F.xxhash64("salt"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = out.select("doc_id", "source", "tokens", (F.col("sure") + F.round("pi").cast("int")).alias("copies"))
    return out.where(F.col("copies") > 0)


def reached(mixture: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source of the targets: documents, tokens (copies counted), most copies and the reached share."""
    per = mixture.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("most_copies"))
    all_ = mixture.agg(F.sum(F.col("tokens") * F.col("copies")).alias("all_tokens"))
    joined = targets.select("source", "target_share", "max_repeats").join(per, "source", "left").crossJoin(F.broadcast(all_))  # one row
    zero = F.lit(0)
    share = F.when(F.coalesce("all_tokens", zero) > 0, F.coalesce("tokens", zero) / F.col("all_tokens")).otherwise(0.0)
    return joined.select("source", "target_share", "max_repeats", F.coalesce("docs", zero).alias("docs"), F.coalesce("tokens", zero).alias("tokens"), F.coalesce("most_copies", zero).alias("most_copies"), F.round(share, 6).alias("reached_share"))
