"""Exact search by inner product: block by block, keyed, and its uses (alignment, evidence, titles).

Queries and rows are cut into blocks by hash and every pair of blocks is one group, so neither
side passes through the driver and no task holds more than two blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkstone.functions import citing
from inkstone.functions import text as T

#: Vectors of a block of queries and of a block of rows.
QUERY_BLOCK, ROW_BLOCK = 4096, 16384


def _blocks(df: DataFrame, key: str, size: int) -> int:
    """How many blocks a table needs; one count, no rows at the driver."""
    return max(1, -(-df.count() // size))


def block_top_k(rows: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", skip_self: bool = False, query_block: int = QUERY_BLOCK, row_block: int = ROW_BLOCK) -> DataFrame:
    """(query_id, key, score, rank): the k rows with the largest inner product; ties by key; k is at least 1."""
    k = max(1, int(k))
    nq, nr = _blocks(queries, key, query_block), _blocks(rows, key, row_block)
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.select(F.col(key).alias("query_id"), F.col(vector).alias("q"), F.pmod(F.xxhash64(key), F.lit(nq)).alias("bq"), each(nr).alias("br"))
    r = rows.select(F.col(key).alias("row_id"), F.col(vector).alias("r"), F.pmod(F.xxhash64(key), F.lit(nr)).alias("br"), each(nq).alias("bq"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, own = left.column("query_id").to_numpy(), right.column("row_id").to_numpy()
        if not len(ids) or not len(own):
            return pa.table({"query_id": pa.array([], pa.int64()), key: pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        matrix = lambda c: np.asarray(c.combine_chunks().flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(c), -1)
        score = np.round(matrix(left.column("q")) @ matrix(right.column("r")).T, 6)
        if skip_self:
            score[ids[:, None] == own[None, :]] = -np.inf
        order = np.lexsort((np.broadcast_to(own, score.shape), -score), axis=1)[:, :k]
        s = np.take_along_axis(score, order, axis=1).ravel()
        ok = np.isfinite(s)
        return pa.table({"query_id": pa.array(np.repeat(ids, order.shape[1])[ok]), key: pa.array(own[order.ravel()][ok]), "score": pa.array(s[ok])})

    part = q.groupBy("bq", "br").cogroup(r.groupBy("bq", "br")).applyInArrow(run, f"query_id bigint, {key} bigint, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), key))
    return part.withColumn("rank", rank).where(F.col("rank") <= k)


def dot(a: Column, b: Column) -> Column:
    """The inner product in double precision, to six places."""
    return F.round(F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x), 6)


def keyed_top_k(queries: DataFrame, rows: DataFrame, on: str, k: int, query: str = "query_id", row: str = "row_id", vector: str = "embedding") -> DataFrame:
    """(query, row, score, rank): the best rows among those with the query's own key (one matched paper); 1 <= k <= 12."""
    k = max(1, min(int(k), 12))
    j = queries.select(on, query, F.col(vector).alias("_q")).join(rows.select(on, row, F.col(vector).alias("_r")), on)
    j = j.withColumn("score", dot(F.col("_q"), F.col("_r"))).drop("_q", "_r")
    return j.withColumn("rank", F.row_number().over(W.partitionBy(query).orderBy(F.desc("score"), row))).where(F.col("rank") <= k)


def search(rows: DataFrame, queries: DataFrame, k: int = 8, key: str = "vec_id", text: str = "text", vector: str = "embedding") -> DataFrame:
    """Passages for queries, 1 <= k <= 50; what begins like a list of references is left out behind the k, so fewer may come."""
    hits = block_top_k(rows, queries, max(1, min(int(k), 50)), key, vector)
    return hits.join(rows.select(key, text), key).where(~citing.reference_like(F.col(text)))


def alignment(hits: DataFrame, query: str = "query_id", low: float = 0.35, most: int = 650) -> DataFrame:
    """(query, score, pct, low_alignment, exemplars): the best score (never below 0), its percent cut to a whole number, and the hits.

    ``hits``: (query, rank, score, pdf, page, text).
    """
    pct = lambda s: F.floor(F.least(F.lit(1.0), F.greatest(F.lit(0.0), s)) * 100).cast("int")
    text = F.when(F.length("text") > most, F.concat(F.rtrim(F.substring("text", 1, most)), F.lit("…"))).otherwise(F.col("text"))
    one = F.struct("rank", "score", pct(F.col("score")).alias("pct"), "pdf", "page", text.alias("text"))
    best = F.greatest(F.lit(0.0), F.max("score"))
    per = hits.groupBy(query).agg(best.alias("score"), F.sort_array(F.collect_list(one)).alias("exemplars"))  # k rows a query
    return per.select(query, "score", pct(F.col("score")).alias("pct"), (F.col("score") < low).alias("low_alignment"), "exemplars")


def scan(aligned: DataFrame, sentences: DataFrame, query: str = "query_id", text: str = "text", least: int = 20, most: int = 1200, limit: int = 220) -> DataFrame:
    """Sentences of at least 20 characters, the first 30 to 3000 of each document, worst aligned first. ``sentences``: (doc, query, text)."""
    limit = max(30, min(int(limit), 3000))
    some = sentences.where(F.length(F.trim(text)) >= least)
    some = some.withColumn("_n", F.row_number().over(W.partitionBy("doc").orderBy(query))).where(F.col("_n") <= limit).drop("_n")
    some = some.withColumn(text, F.when(F.length(text) > most, F.concat(F.rtrim(F.substring(text, 1, most)), F.lit("…"))).otherwise(F.col(text)))
    j = some.join(aligned.select(query, "score", "pct"), query, "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    return j.withColumn("position", F.row_number().over(W.partitionBy("doc").orderBy("score", query)))


def title_area(pages: DataFrame, doc: str = "doc", page: str = "page", text: str = "text") -> DataFrame:
    """(doc, filename, title_area, match_text): the first 500 characters of the first two pages, and what is compared with titles."""
    n = F.row_number().over(W.partitionBy(doc).orderBy(page))
    head = pages.select(doc, page, text).withColumn("_n", n).where(F.col("_n") <= 2).groupBy(doc).agg(F.sort_array(F.collect_list(F.struct(page, F.coalesce(F.col(text), F.lit("")).alias("t")))).alias("_p"))
    area = F.substring(F.array_join(F.transform("_p", lambda x: x["t"]), "\n"), 1, 500)
    name = F.regexp_extract(doc, "([^/\\\\]*)$", 1)
    return head.select(doc, name.alias("filename"), area.alias("title_area"), F.substring(F.concat_ws(" ", name, area), 1, 700).alias("match_text"))


def best_title(queries: DataFrame, titles: DataFrame, threshold: float = 0.55) -> DataFrame:
    """(query_id, vec_id, score): the nearest title of each reference if it is near enough."""
    return block_top_k(titles, queries, 1).where(F.col("score") >= threshold).select("query_id", "vec_id", "score")


def query_text(title: Column, authors: Column) -> Column:
    return T.normalize_ws(F.concat_ws(" ", title, authors))
