"""Exact similarity search: blocks of queries against all rows by matrix products."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Queries of one block: what is sent to the tasks is bounded by this number of vectors.
BLOCK = 4096


def normalized(v: Column) -> Column:
    """The vector divided by its length (at least 1e-12), in double precision."""
    d = F.transform(v, lambda x: x.cast("double"))
    norm = F.greatest(F.sqrt(F.aggregate(d, F.lit(0.0), lambda a, x: a + x * x)), F.lit(1e-12))
    return F.transform(d, lambda x: x / norm)


def top_k(rows: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", skip_self: bool = True) -> DataFrame:
    """(query_id, key, score, rank) of the k rows with the largest inner product; ties by key."""
    n = queries.count()
    out = None
    for b in range(max(1, -(-n // BLOCK))):
        block = queries.where(F.pmod(F.xxhash64(key), F.lit(max(1, -(-n // BLOCK)))) == b).select(key, vector).collect()
        part = _scan(rows.select(key, vector), block, k, key, skip_self)
        out = part if out is None else out.unionByName(part)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), key))
    return out.withColumn("rank", rank).where(F.col("rank") <= k)


def _scan(rows: DataFrame, block: list, k: int, key: str, skip_self: bool) -> DataFrame:
    ids = np.array([r[0] for r in block], np.int64)
    matrix = np.array([r[1] for r in block], np.float64)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not len(ids):
                continue
            own = batch.column(0).to_numpy()
            values = np.asarray(batch.column(1).flatten().to_numpy(), np.float64).reshape(len(own), -1)
            score = np.round(matrix @ values.T, 6)
            if skip_self:
                score[ids[:, None] == own[None, :]] = -np.inf
            order = np.lexsort((np.broadcast_to(own, score.shape), -score), axis=1)[:, :k]
            q = np.repeat(ids, order.shape[1])
            s = np.take_along_axis(score, order, axis=1).ravel()
            ok = np.isfinite(s)
            yield pa.RecordBatch.from_arrays([pa.array(q[ok]), pa.array(own[order.ravel()][ok]), pa.array(s[ok])], ["query_id", key, "score"])

    return rows.mapInArrow(run, f"query_id bigint, {key} bigint, score double")
