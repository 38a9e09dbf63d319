"""Citations against reference lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstone.functions import text as T
from inkstone.session import latest


def _cited(sentences: DataFrame) -> DataFrame:
    rows = latest(sentences, "sentence_id", "received_at", "pdf", "citations")
    c = rows.select("sentence_id", "pdf", F.posexplode("citations").alias("cite_no", "c"))
    return c.select("sentence_id", "pdf", "cite_no", F.col("c.authors").alias("authors"), F.trim("c.cite_year").alias("y")).where("authors IS NOT NULL AND authors <> '' AND y <> ''")


def _listed(references: DataFrame) -> DataFrame:
    once = latest(references, "ref_id", "received_at", "pdf", "entry_index", "authors", "pub_year")
    return once.select("ref_id", "pdf", "entry_index", F.lower("authors").alias("low"), F.trim("pub_year").alias("y"))


def names_hit(names: Column, low: Column) -> Column:
    """How many family names occur in authors in small letters; Latin names of two letters as whole words, of one never."""
    short = lambda n: F.rlike(low, F.concat(F.lit("(?<![\\p{L}\\p{N}_])\\Q"), n, F.lit("\\E(?![\\p{L}\\p{N}_])")))
    han = lambda n: n.rlike("[\\x{4e00}-\\x{9fff}]")
    return F.size(F.filter(names, lambda n: F.when(han(n) | (F.length(n) >= 3), F.contains(low, n)).otherwise((F.length(n) == 2) & short(n))))


def match_references(sentences: DataFrame, references: DataFrame) -> DataFrame:
    """Per citation the reference of the same paper and year (its letter included) whose authors have most of its family names.

    Equi-join on paper and year, then containment; the first entry wins ties.
    """
    c = _cited(sentences).withColumn("names", T.surnames(F.col("authors"))).drop("authors")
    j = c.join(_listed(references), ["pdf", "y"])
    scored = j.withColumn("score", F.round(names_hit(F.col("names"), F.col("low")) / F.size("names"), 6)).where(F.col("score") > 0)
    best = F.min(F.struct((-F.col("score")).alias("s"), "entry_index", "ref_id"))
    return scored.groupBy("sentence_id", "cite_no").agg(best.alias("b")).select("sentence_id", "cite_no", F.col("b.ref_id").alias("ref_id"), (-F.col("b.s")).alias("score"))


def uncited(sentences: DataFrame, references: DataFrame) -> DataFrame:
    """References that no citation of their paper is matched with, by authors and year; entries without both are no cases."""
    once = latest(references, "ref_id", "received_at", "pdf", "authors", "pub_year").where("trim(authors) <> '' AND trim(pub_year) <> ''")
    keys = once.select("ref_id", "pdf", F.trim("authors").alias("a"), F.trim("pub_year").alias("y"))
    cited = match_references(sentences, references).select("ref_id").distinct().join(keys, "ref_id").select("pdf", "a", "y").distinct()
    return keys.join(cited, ["pdf", "a", "y"], "left_anti").select("ref_id")


SURNAMES_SQL = r"list_distinct(list_filter(list_transform(string_split_regex(regexp_replace({0}, '(?i)\s+(et\s+al\.?|等人?)(\s*$|\s*[&;]|\s+and\s)', '\2', 'g'), '\s+and\s+|\s*[&;]\s*'), lambda p: lower(CASE WHEN contains(p, ',') THEN trim(split_part(trim(p), ',', 1)) ELSE regexp_extract(trim(p), '(\S+)$', 1) END)), lambda w: w <> ''))"
_CITED_SQL = "(SELECT sentence_id, pdf, cite_no, c.authors AS authors, trim(c.cite_year) AS y FROM (SELECT sentence_id, pdf, unnest(citations) AS c, generate_subscripts(citations, 1) - 1 AS cite_no FROM (SELECT sentence_id, arg_max(pdf, received_at) AS pdf, arg_max(citations, received_at) AS citations FROM citation_sentences GROUP BY sentence_id)) WHERE c.authors IS NOT NULL AND c.authors <> '' AND trim(c.cite_year) <> '')"
MATCH_SQL = rf"""WITH c AS (SELECT *, {SURNAMES_SQL.format('authors')} AS names FROM {_CITED_SQL}),
r AS (SELECT ref_id, arg_max(pdf, received_at) AS pdf, arg_max(entry_index, received_at) AS entry_index, lower(arg_max(authors, received_at)) AS low, trim(arg_max(pub_year, received_at)) AS y FROM reference_entries GROUP BY ref_id),
s AS (SELECT sentence_id, cite_no, ref_id, entry_index, round(len(list_filter(names, lambda n: CASE WHEN regexp_matches(n, '[\x{{4e00}}-\x{{9fff}}]') OR length(n) >= 3 THEN contains(low, n) ELSE length(n) = 2 AND regexp_matches(low, '(^|[^\p{{L}}\p{{N}}_])' || regexp_escape(n) || '([^\p{{L}}\p{{N}}_]|$)') END)) / len(names), 6) AS score FROM c JOIN r USING (pdf, y))
SELECT sentence_id, cite_no::INT AS cite_no, ref_id, score FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY sentence_id, cite_no ORDER BY score DESC, entry_index, ref_id) = 1"""
UNCITED_SQL = f"WITH k AS (SELECT ref_id, arg_max(pdf, received_at) AS pdf, trim(arg_max(authors, received_at)) AS a, trim(arg_max(pub_year, received_at)) AS y FROM reference_entries GROUP BY ref_id), m AS ({MATCH_SQL}), u AS (SELECT DISTINCT pdf, a, y FROM k JOIN m USING (ref_id)) SELECT ref_id FROM k WHERE a <> '' AND y <> '' AND NOT EXISTS (SELECT 1 FROM u WHERE u.pdf = k.pdf AND u.a = k.a AND u.y = k.y)"
