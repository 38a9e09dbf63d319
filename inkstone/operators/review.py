"""What surrounds a language-model call: candidate choice, batches, and checks of its answers.

The model itself is an injected callable; without one nothing is called.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkstone.functions import text as T


def candidates(items: DataFrame, store: DataFrame, doc: str, page: str, score: str, key: str, cap: int = 12, top: int = 60) -> DataFrame:
    """Items never reviewed first, then of pages reviewed less, then by low score; at most ``cap`` a page and ``top`` a document."""
    seen = store.groupBy("key").agg(F.sum("count").alias("seen"))
    pages = store.groupBy(F.col("page").alias(page)).agg(F.count(F.lit(1)).alias("page_seen"))
    j = items.join(seen, items[key] == seen["key"], "left").drop(seen["key"]).join(pages, page, "left")
    j = j.withColumn("seen", F.coalesce("seen", F.lit(0))).withColumn("page_seen", F.coalesce("page_seen", F.lit(0)))
    order = ["seen", "page_seen", score, key]
    n = F.row_number().over(W.partitionBy(doc, page).orderBy(*order))
    kept = j.withColumn("_n", n).where((F.col("_n") <= cap) | (F.coalesce(F.col(page), F.lit(0)) <= 0))
    r = F.row_number().over(W.partitionBy(doc).orderBy(*order))
    return kept.withColumn("position", r).where(F.col("position") <= top).drop("_n")


def batches(rows: DataFrame, doc: str, order: str, size: int, *columns: str) -> DataFrame:
    """(doc, batch, items): ``size`` rows in a row, in order."""
    b = rows.withColumn("batch", F.floor((F.row_number().over(W.partitionBy(doc).orderBy(order)) - 1) / size).cast("int"))
    return b.groupBy(doc, "batch").agg(F.sort_array(F.collect_list(F.struct(order, *columns))).alias("items"))


def evidence_id(c: Column) -> Column:
    """Identifiers in one form: upper case, letters, figures and single underscores; a hyphen is one."""
    t = F.regexp_replace(F.replace(F.trim(c), F.lit("-"), F.lit("_")), "[^A-Za-z0-9_]", "")
    return F.upper(F.regexp_replace(t, "_+", "_"))


def quote(given: Column, source: Column, most: int = 180) -> Column:
    """The quotation if it stands in the source (white space aside), else the beginning of the source."""
    g, s = T.normalize_ws(given), T.normalize_ws(source)
    return F.when((g != "") & F.contains(s, g), g).otherwise(excerpt(s, most))


def excerpt(s: Column, most: int = 380) -> Column:
    return F.when(F.length(s) > most, F.concat(F.substring(s, 1, most - 1), F.lit("…"))).otherwise(s)


def invented_numbers(rewrite: Column, source: Column) -> Column:
    """Numbers of a rewrite that its source does not have."""
    number = F.lit("\\d+(?:[.,]\\d+)*")
    return F.array_except(F.regexp_extract_all(rewrite, number, 0), F.regexp_extract_all(source, number, 0))


def verdict(c: Column) -> Column:
    """One of the verdicts by the beginning of what was answered, else PARSE_ERROR."""
    u = F.upper(F.trim(c))
    known = [("ACC", "ACCURATE"), ("INACC", "INACCURATE"), ("MIS", "MISATTRIBUTED"), ("NOT", "NOT_FOUND")]
    return F.coalesce(*[F.when(u.startswith(p), F.lit(v)) for p, v in known], F.lit("PARSE_ERROR"))


def transient(status: Column, body: Column) -> Column:
    """Whether a failed call may be tried again."""
    again = F.coalesce(F.lower(body).rlike("validation_required|verify your account"), F.lit(False))
    return status.isin(0, 408, 429) | status.between(500, 599) | ((status == 403) & again)


def masked_secret(c: Column, shown: int = 4) -> Column:
    """A secret with all but its last characters hidden."""
    t = F.trim(c)
    n = F.length(t)
    return F.when(n <= shown, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.repeat(F.lit("*"), n - shown), F.right(t, F.lit(shown))))


def base_url(c: Column) -> Column:
    """An address of a service, with the version at its end unless it has one."""
    t = F.regexp_replace(F.trim(c), "/+$", "")
    return F.when((t == "") | F.contains(t, F.lit("/v1")), t).otherwise(F.concat(t, F.lit("/v1")))


def first_object(answer: str | None) -> dict | None:
    """The first JSON object in an answer that may have other text around it; None if there is none."""
    s = answer or ""
    at = s.find("{")
    while at >= 0:
        try:
            got, _ = json.JSONDecoder().raw_decode(s, at)
            return got if isinstance(got, dict) else None
        except ValueError:
            at = s.find("{", at + 1)
    return None


def open_access(found: DataFrame, wanted: str, year: Column) -> DataFrame:
    """Per wanted work the best of the found records: of the first service one with a file, else with an identifier, else one of the second with an identifier.

    Records of a known year that is more than one off are no candidates; unknown years are.
    """
    near = year.isNull() | F.col("year").isNull() | (F.abs(F.col("year") - year) <= 1)
    full = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    rank = F.when((F.col("service") == 0) & full("pdf_url"), 0).when((F.col("service") == 0) & full("doi"), 1).when(full("doi"), 2)
    n = F.row_number().over(W.partitionBy(wanted).orderBy("rank", "service", "position"))
    return found.where(near).withColumn("rank", rank).where(F.col("rank").isNotNull()).withColumn("_n", n).where(F.col("_n") == 1).drop("_n")


def paragraph_candidates(paragraphs: DataFrame) -> DataFrame:
    """Paragraphs (doc, id, page, text, sentences) worth a review with their ``score``: long or dense ones, and those of the first two pages."""
    words, han, n = F.size(T.ascii_words(F.col("text"))), T.han_count(F.col("text")), F.size("sentences")
    long_ = (words >= 120) | (han >= 280) | (n >= 6)
    some = paragraphs.where((F.length(F.trim("text")) >= 80) & (long_ | (F.col("page") <= 2) | (n > 3)))
    size = F.when((words >= 160) | (han >= 380), 2.0).when((words >= 120) | (han >= 280), 1.0).otherwise(0.0)
    score = F.when(F.col("page") <= 2, 1.0).otherwise(0.0) + size + F.least(F.lit(2.0), n / 4.0) + F.least(F.lit(2.0), F.length(F.trim("text")) / 900.0)
    return some.withColumn("score", score)


def citation_candidates(sentences: DataFrame) -> DataFrame:
    """Citing sentences with ``score``: more citations first, then longer ones (smaller is earlier)."""
    return sentences.withColumn("score", F.struct((-F.size("citations")).alias("n"), (-F.length("sentence")).alias("l")))


def token_in_text(token: Column, text: Column, language: Column) -> Column:
    """Whether a word occurs: in Chinese anywhere, else in any case with no letter before or behind it."""
    latin = F.rlike(text, F.concat(F.lit("(?i)(?<![A-Za-z])\\Q"), token, F.lit("\\E(?![A-Za-z])")))
    return F.coalesce((F.trim(token) != "") & F.when(language == "zh", F.contains(text, token)).otherwise(latin), F.lit(False))


def token_contexts(tokens: DataFrame, paragraphs: DataFrame, heads: DataFrame) -> DataFrame:
    """(doc, token, page, paragraph_id, sentence): the first sentence that has a word, else the first paragraph, else the first heading.

    ``tokens``: (doc, token, lang), a bounded list of each document; ``paragraphs``: as of ``pages.sections``.
    """
    some = F.array_append(F.transform("sentences", lambda x: x["text"]), excerpt(F.trim("text"), 520))
    texts = paragraphs.select("doc", F.lit(0).alias("rank"), F.col("par").alias("a"), F.posexplode(some).alias("b", "sentence"), "page", F.col("id").alias("paragraph_id"))
    texts = texts.unionByName(heads.select("doc", F.lit(1).alias("rank"), F.col("ord").alias("a"), F.lit(0).alias("b"), F.col("title").alias("sentence"), "page", F.lit("").alias("paragraph_id")))
    hit = tokens.join(texts, "doc").where(token_in_text(F.col("token"), F.col("sentence"), F.col("lang")))
    first = F.min_by(F.struct("page", "paragraph_id", "sentence"), F.struct("rank", "a", "b"))
    return hit.groupBy("doc", "token").agg(first.alias("x")).select("doc", "token", "x.*")


def lexical_candidates(rare: DataFrame, store: DataFrame, top: int = 40) -> DataFrame:
    """Rare words (doc, lang, token, n, doc_freq, ratio) not reviewed yet, most frequent first, ``top`` of a document."""
    key = T.stable_key("lx", F.lit(0), F.col("token"), F.col("lang"))
    some = rare.withColumn("stable_key", key).join(store.select(F.col("key").alias("stable_key")).distinct(), "stable_key", "left_anti")
    n = F.row_number().over(W.partitionBy("doc").orderBy(F.desc("n"), "doc_freq", "ratio", "token"))
    return some.withColumn("position", n).where(F.col("position") <= top)


def evidence_source(text: Column) -> Column:
    """File and page of an excerpt that begins with ``[file#pN]``."""
    page = F.regexp_extract(text, "^\\s*\\[.+?#p(\\d+)\\]", 1).try_cast("int")
    return F.struct(F.trim(F.regexp_extract(text, "^\\s*\\[(.+?)#p\\d+\\]", 1)).alias("pdf"), F.coalesce(page, F.lit(0)).alias("page"))


def snippet(text: Column, needle: Column | str, most: int = 220) -> Column:
    """The surroundings of a phrase, itself a part of the text; empty if it does not occur."""
    half = max(40, int(most * 0.45))
    body = F.regexp_replace(text, "^\\[[^\\]]+\\]\\s*", "")
    at = F.locate(needle, body) if isinstance(needle, str) else F.position(needle, body)
    start = F.greatest(F.lit(1), at - half)
    return F.when(at > 0, F.trim(F.substring(body, start, F.least(F.lit(most), at + F.length(F.lit(needle) if isinstance(needle, str) else needle) + half - start)))).otherwise("")


def escaped(s: Column) -> Column:
    """A text on one line for a report."""
    return F.trim(F.replace(F.replace(F.coalesce(s, F.lit("")), F.lit("\r"), F.lit("")), F.lit("\n"), F.lit(" ")))


def source_name(pdf: Column, page: Column) -> Column:
    return F.when(F.coalesce(page, F.lit(0)) > 0, F.concat(pdf, F.lit("#p"), page)).otherwise(F.coalesce(pdf, F.lit("")))


def time_text(epoch: Column) -> Column:
    """Seconds since 1970 as a time in the session's zone, a dash for none."""
    return F.when(F.coalesce(epoch, F.lit(0)) > 0, F.date_format(F.timestamp_seconds(epoch), "yyyy-MM-dd HH:mm:ss")).otherwise("—")


def number(s: Column, default: float = 0.0) -> Column:
    """A text as a number, ``default`` if it is none."""
    return F.coalesce(s.try_cast("double"), F.lit(default))
