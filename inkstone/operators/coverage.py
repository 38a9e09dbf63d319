"""State across runs: what was reviewed, which files changed, what a budget allows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def mark_seen(store: DataFrame, batch: DataFrame) -> DataFrame:
    """Keyed upsert: counts add up, first and last times widen, the page is the last one that is not 0, empty keys are dropped.

    A ``meta`` map in both tables is merged, the later value of a key wins.
    """
    meta = ["meta"] if "meta" in store.columns and "meta" in batch.columns else []
    new = batch.where(F.trim("key") != "").select("category", F.trim("key").alias("key"), F.lit(1).cast("bigint").alias("count"), "page", F.col("seen_at").alias("first_seen_at"), F.col("seen_at").alias("last_seen_at"), *meta)
    rows = store.select("category", "key", "count", "page", "first_seen_at", "last_seen_at", *meta).unionByName(new)
    known = F.when(F.col("page") != 0, F.struct("last_seen_at", "page"))
    page = F.coalesce(F.max(known).getField("page"), F.lit(0))
    out = rows.groupBy("category", "key").agg(F.sum("count").alias("count"), page.alias("page"), F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"))
    if not meta:
        return out
    pairs = rows.select("category", "key", "last_seen_at", F.explode("meta").alias("name", "value")).where(F.col("value").isNotNull())
    newest = pairs.groupBy("category", "key", "name").agg(F.max_by("value", "last_seen_at").alias("value"))
    merged = newest.groupBy("category", "key").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("meta"))
    return out.join(merged, ["category", "key"], "left")


def clear(store: DataFrame, category: str) -> DataFrame:
    """The store without a category."""
    return store.where(F.col("category") != category)


def unseen(candidates: DataFrame, store: DataFrame, on: str = "key") -> DataFrame:
    return candidates.join(store.select(on), on, "left_anti")


def changed_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change): added, removed or changed by size or time."""
    o = old.select("path", F.struct("size", "mtime").alias("o"))
    n = new.select("path", F.struct("size", "mtime").alias("n"))
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(~F.col("o").eqNullSafe(F.col("n")), "changed")
    return o.join(n, "path", "full_outer").select("path", change.alias("change")).where(F.col("change").isNotNull())


def still_valid(manifest: DataFrame, current: DataFrame, model: str, current_model: str) -> DataFrame:
    """One row (valid): all files of the manifest are as they were and the model is the same; new files do not matter."""
    o = manifest.select("path", F.struct("size", "mtime").alias("o"))
    n = current.select("path", F.struct("size", "mtime").alias("n"))
    return o.join(n, "path", "left").agg((F.coalesce(F.bool_and(F.col("o").eqNullSafe(F.col("n"))), F.lit(True)) & F.lit(model == current_model)).alias("valid"))


def to_rebuild(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path): files that are new or changed, which an incremental build makes again."""
    return changed_files(old, new).where("change <> 'removed'").select("path")


class TokenBudget:
    """A driver-side ledger: a call that would exceed the budget is skipped, later smaller ones may pass.

    A limit of tokens counts alone; without one a limit of cost counts, if a rate is known.
    """

    def __init__(self, limit: int, rate: float = 0.0, max_cost: float = 0.0):
        self.limit, self.rate, self.max_cost = limit, rate, max_cost
        self.used = self.calls = 0
        self.warnings: list[str] = []
        self.errors: dict[str, int] = {}

    def cost(self, tokens: int | None = None) -> float:
        return (self.used if tokens is None else tokens) * self.rate / 1e6

    def remaining(self) -> int:
        return max(0, self.limit - self.used) if self.limit > 0 else 0

    def exceeds(self, need: int) -> bool:
        if self.limit > 0:
            return self.used >= self.limit or self.used + need > self.limit
        return self.max_cost > 0 and self.rate > 0 and (self.cost() >= self.max_cost or self.cost(self.used + need) > self.max_cost)

    def add(self, tokens: int) -> None:
        self.used, self.calls = self.used + max(0, tokens), self.calls + 1

    def allow(self, need: int) -> bool:
        if self.exceeds(need):
            return False
        self.used += need
        return True
