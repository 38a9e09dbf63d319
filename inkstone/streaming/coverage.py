"""Review coverage as a stream: an extension of the batch store.

Marks arrive as files; each micro-batch is merged into the next version of the store.  A
batch that is delivered twice is recognised by its id, since counting is not idempotent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from inkstone.operators import coverage

MARKS = "category string, key string, page bigint, seen_at timestamp"
STORE = "category string, key string, count bigint, page bigint, first_seen_at timestamp, last_seen_at timestamp"


def read_store(spark: SparkSession, path: str, version: int) -> DataFrame:
    """The store after micro-batch ``version`` (-1: empty)."""
    return spark.createDataFrame([], STORE) if version < 0 else spark.read.schema(STORE).parquet(f"{path}/v{version}")


def follow(spark: SparkSession, marks_path: str, store_path: str, checkpoint: str) -> StreamingQuery:
    """Start merging: version n is written from version n - 1 and batch n, so a repeat overwrites itself."""

    def merge(batch: DataFrame, n: int) -> None:
        done = coverage.mark_seen(read_store(spark, store_path, n - 1), batch)
        done.write.mode("overwrite").parquet(f"{store_path}/v{n}")

    return spark.readStream.schema(MARKS).parquet(marks_path).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
