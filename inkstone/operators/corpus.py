"""Library artifacts: vocabulary, phrases, length baselines; and their lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstone.functions import text as T


def tokens(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, token) for every vocabulary word occurrence."""
    return documents.select(key, F.explode(T.words(F.col(text))).alias("token"))


def vocabulary(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(token, doc_freq, total_freq); each document counts its words before the shuffle."""
    per = tokens(documents, key, text).groupBy(key, "token").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("token").agg(F.count(F.lit(1)).alias("doc_freq"), F.sum("n").alias("total_freq"))


def phrases(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(bigram, doc_freq, total_freq) of adjacent words, function words kept."""
    pairs = documents.select(key, F.explode(T.bigrams(T.ascii_words(F.col(text)))).alias("bigram"))
    per = pairs.groupBy(key, "bigram").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("bigram").agg(F.count(F.lit(1)).alias("doc_freq"), F.sum("n").alias("total_freq"))


def _streams(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(key, lang, w): the token streams of two tokens or more of each document, a mixed one in both languages."""
    some = documents.where(F.col(text).isNotNull()).select(key, F.explode(T.streams(F.col(text), T.language(F.col(text)))).alias("lang", "w"))
    return some.where(F.size("w") >= 2)


def phrases_by_language(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(lang, bigram, doc_freq, total_freq); each document counts its own pairs first, so pairs are shuffled once."""
    pairs = _streams(documents, key, text).select("lang", T.bigrams(F.col("w")).alias("b"))
    once = pairs.select("lang", F.explode(F.array_distinct("b")).alias("bigram"), F.lit(1).alias("d"), F.lit(0).alias("t"))
    every = pairs.select("lang", F.explode("b").alias("bigram"), F.lit(0).alias("d"), F.lit(1).alias("t"))
    return once.unionByName(every).groupBy("lang", "bigram").agg(F.sum("d").alias("doc_freq"), F.sum("t").alias("total_freq"))


def documents_by_language(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(lang, docs, bigrams): documents with a token stream in each language, and their adjacent pairs."""
    return _streams(documents, key, text).groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.size("w") - 1).cast("bigint").alias("bigrams"))


def dominant_language(by_language: DataFrame) -> DataFrame:
    """One row (lang): the language of more documents, English if they are equally many."""
    n = lambda x: F.coalesce(F.max(F.when(F.col("lang") == x, F.col("docs"))), F.lit(0))
    return by_language.agg(F.when(n("en") >= n("zh"), "en").otherwise("zh").alias("lang"))


def word_stats(words: DataFrame, docs: DataFrame) -> DataFrame:
    """Adds ``docs_total`` (of the word's script, else all) and ``doc_percent``; ``docs``: (lang, docs)."""
    n = lambda x: F.coalesce(F.max(F.when(F.col("lang") == x, F.col("docs"))), F.lit(0))
    one = docs.agg(n("en").alias("_en"), n("zh").alias("_zh"), F.sum("docs").alias("_all"))
    own = F.when(T.token_language(F.col("token")) == "zh", F.col("_zh")).otherwise(F.col("_en"))
    total = F.coalesce(F.nullif(own, F.lit(0)), F.col("_all"))
    j = words.crossJoin(F.broadcast(one)).withColumn("docs_total", total)  # one row
    return j.withColumn("doc_percent", F.when(F.col("docs_total") > 0, F.col("doc_freq") / F.col("docs_total") * 100).otherwise(0.0)).drop("_en", "_zh", "_all")


def tag_statistics(tagged: DataFrame, tags: str, by: str = "lang") -> tuple[DataFrame, DataFrame]:
    """Of sentences with tags: (by, pair, sent_freq, total_freq) of adjacent tags, and (by, tag, sent_freq, total_freq) of single ones."""

    def counted(column: Column, name: str) -> DataFrame:
        rows = tagged.select(by, column.alias("x"))
        once = rows.select(by, F.explode(F.array_distinct("x")).alias(name), F.lit(1).alias("s"), F.lit(0).alias("t"))
        every = rows.select(by, F.explode("x").alias(name), F.lit(0).alias("s"), F.lit(1).alias("t"))
        return once.unionByName(every).groupBy(by, name).agg(F.sum("s").alias("sent_freq"), F.sum("t").alias("total_freq"))

    full = F.filter(tags, lambda x: F.trim(x) != "")
    both = F.filter(F.zip_with(F.slice(tags, 1, F.greatest(F.size(tags) - 1, F.lit(0))), F.slice(tags, 2, F.greatest(F.size(tags) - 1, F.lit(0))), lambda a, b: F.when((a != "") & (b != ""), F.concat_ws(" ", a, b))), lambda x: x.isNotNull())
    return counted(both, "pair"), counted(full, "tag")


def word_class(share: Column) -> Column:
    """By percent of documents: unseen, rare below 10, normal below 50, common."""
    return F.when(share <= 0, "unseen").when(share < 10, "rare").when(share < 50, "normal").otherwise("common")


def length_percentiles(lengths: DataFrame, by: str, value: str, shares: tuple[float, ...] = (0.5, 0.9, 0.95)) -> DataFrame:
    """Order statistics at round-half-even((n - 1) p), by counts of distinct lengths.

    Only (group, length, count) rows are sorted, so a large group is never collected.
    """
    from pyspark.sql import Window as W

    counts = lengths.groupBy(by, value).agg(F.count(F.lit(1)).alias("c"))
    up = counts.withColumn("upto", F.sum("c").over(W.partitionBy(by).orderBy(value))).withColumn("n", F.sum("c").over(W.partitionBy(by)))
    cols = [F.min(F.when(F.col("upto") > F.bround((F.col("n") - 1) * p), F.col(value))).alias(f"p{round(p * 100)}") for p in shares]
    return up.groupBy(by).agg(F.max("n").alias("n"), *cols)


def rare_in_library(target: DataFrame, library: DataFrame, docs: int, least: int = 8, top: int = 400, keep: int = 30) -> DataFrame:
    """Words frequent in the target and rare in the library, most frequent first."""
    counts = tokens(target).groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    first = counts.orderBy(F.desc("n"), "token").limit(top)
    seen = first.join(vocabulary(library).select("token", "doc_freq"), "token", "left").withColumn("doc_freq", F.coalesce("doc_freq", F.lit(0)).cast("bigint"))
    ratio = F.col("doc_freq") / F.lit(max(docs, 1))
    return seen.where((F.col("doc_freq") <= 1) | (ratio <= 0.02)).orderBy(F.desc("n"), "token").limit(keep)
