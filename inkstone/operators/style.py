"""Style detectors as long-form issues, and the explainable score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstone.functions import lexicon


def contained(sentences: DataFrame, text: str, terms: list[str], kind: str, lower: bool = False) -> DataFrame:
    """One row per sentence and contained term, by an array filter instead of a theta join."""
    s = F.lower(F.col(text)) if lower else F.col(text)
    lex = F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(t).alias("term"), F.lit(t.lower() if lower else t).alias("_t")) for i, t in enumerate(terms)])
    hits = F.filter(lex, lambda x: F.contains(s, x["_t"]))
    return sentences.withColumn("_h", F.explode(hits)).withColumn("issue_type", F.lit(kind)).withColumn("term", F.col("_h.term")).drop("_h")


def passive_zh(s: Column) -> Column:
    """The first contained marker, else the first matching pattern, else null."""
    marks = [F.when(F.contains(s, F.lit(m)), F.lit(m)) for m in lexicon.PASSIVE_MARKERS_ZH]
    return F.coalesce(*marks, *[F.when(s.rlike(p), F.lit(p)) for p in lexicon.PASSIVE_PATTERNS_ZH])


def templates_zh(s: Column) -> Column:
    """The matched span of each template."""
    return F.filter(F.array(*[F.regexp_extract(s, p, 0) for p in lexicon.TEMPLATES_ZH]), lambda x: x != "")


def too_long(count: Column, mean: Column) -> Column:
    return count > F.floor(mean * 1.5)


#: Weights of words, phrases, sentences, style, meaning and syntax, by whether phrase and syntax statistics exist.
WEIGHTS = {
    (True, True): (0.32, 0.26, 0.12, 0.10, 0.14, 0.06), (True, False): (0.34, 0.28, 0.13, 0.10, 0.15, 0.0),
    (False, True): (0.46, 0.0, 0.19, 0.15, 0.14, 0.06), (False, False): (0.50, 0.0, 0.20, 0.15, 0.15, 0.0),
}


def weirdness(unseen: Column, rare: Column, phrase: Column, sentence: Column, style: Column, meaning: Column | None = None, syntax: Column | None = None) -> Column:
    """0 to 100 from the shares of six parts, each steepened and capped at 1.

    A null ``phrase`` means no phrase statistics for the row, a missing ``syntax`` none at all: their weights go to the other parts.
    """
    one = lambda x: F.least(F.lit(1.0), x)
    zero = F.lit(0.0)
    parts = [one(1.25 * unseen + 0.75 * rare), F.coalesce(one(1.6 * phrase), zero), one(1.2 * one(sentence)), one(style), one(1.1 * one(zero if meaning is None else meaning)), one(1.1 * one(zero if syntax is None else syntax))]

    def total(phrases: bool) -> Column:
        return F.bround(100 * sum((w * p for w, p in zip(WEIGHTS[phrases, syntax is not None], parts)), zero)).cast("int")

    return F.greatest(F.lit(0), F.least(F.lit(100), F.when(phrase.isNotNull(), total(True)).otherwise(total(False))))


def level(score: Column) -> Column:
    return F.when(score >= 70, "high").when(score >= 35, "medium").otherwise("low")
