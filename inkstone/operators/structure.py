"""Headings, sections, pages: windows instead of stacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def parents(headings: DataFrame, doc: str, order: str, level: str, key: str) -> DataFrame:
    """Adds ``parent``: the nearest heading before with a smaller level."""
    before = W.partitionBy(doc).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    # of the candidates for each smaller level the latest is the parent
    best = F.greatest(*[F.when(F.col(level) > k, F.last(F.when(F.col(level) <= k, F.struct(F.col(order).alias("o"), F.col(key).alias("k"))), ignorenulls=True).over(before)) for k in range(1, 6)], F.lit(None))
    return headings.withColumn("parent", best["k"])


def page_capped(rows: DataFrame, by: list[str], order: list[Column], cap: int) -> DataFrame:
    """At most ``cap`` rows of a page in the given order."""
    n = F.row_number().over(W.partitionBy(*by).orderBy(*order))
    return rows.withColumn("_n", n).where(F.col("_n") <= cap).drop("_n")


def even_sample(rows: DataFrame, order: Column, m: int, by: str) -> DataFrame:
    """Evenly spaced rows of each group: positions round-half-even(i n / m) for i < m."""
    w = W.partitionBy(by)
    r = rows.withColumn("pos", F.row_number().over(w.orderBy(order)) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    # i is kept if the position is the image of some i: invert and test the neighbours
    i = F.floor(F.col("pos") * m / F.col("n"))
    hit = F.lit(False)
    for d in (-1, 0, 1, 2):
        j = i + d
        hit = hit | ((j >= 0) & (j < m) & (F.bround(j * F.col("n") / F.lit(m)) == F.col("pos")))
    return r.where((F.col("n") <= m) | hit).drop("n")
