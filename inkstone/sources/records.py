"""Tolerant readers and atomic writers of artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a JSON-lines file; blank, malformed and non-object lines are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_sentence_index(spark: SparkSession, path: str) -> DataFrame:
    """(text, pdf, page) of an index whose items use ``text`` or ``sentence``, and nested or flat sources."""
    raw = read_jsonl(spark, path, "text string, sentence string, source struct<pdf: string, page: int>, pdf string, path string, file string, page int")
    return raw.select(F.coalesce("text", "sentence", F.lit("")).alias("text"), F.coalesce(F.col("source.pdf"), "pdf", "path", "file").alias("pdf"), F.coalesce(F.col("source.page"), "page").alias("page"))


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(token, doc_freq); an old file has total frequencies, whose tenth stands in, at most the documents."""
    raw = spark.read.schema("pdf_count long, doc_count long, word_freq map<string, long>, word_doc_freq map<string, long>").json(path, multiLine=True)
    docs = F.coalesce("doc_count", "pdf_count", F.lit(0))
    new = raw.where(F.col("word_doc_freq").isNotNull()).select(F.explode("word_doc_freq").alias("token", "doc_freq"))
    old = raw.where(F.col("word_doc_freq").isNull()).select(docs.alias("d"), F.explode("word_freq").alias("token", "f")).select("token", F.least("d", F.greatest(F.lit(1), F.floor(F.col("f") / 10))).alias("doc_freq"))
    return new.unionByName(old)


def write_table(df: DataFrame, path: str) -> None:
    """Overwrite a Parquet table; the output committer publishes it as a whole."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
