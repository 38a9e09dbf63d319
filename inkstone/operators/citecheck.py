"""Checking citations: the reference of each, the file it means, evidence in that file, a verdict; and papers that are missing.

Vectors are inputs: ``embed`` is a column function (or any function on DataFrames) given by the
caller, since no model is at hand here.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkstone.functions import segment
from inkstone.functions import text as T
from inkstone.operators import citations, documents, pages, retrieval

#: A function that adds ``embedding array<double>`` for a text column.
Embed = Callable[[DataFrame, str], DataFrame]


def pairs(cites: DataFrame) -> DataFrame:
    """(doc, pair, page, sentence, author, year) of citation sentences (doc, page, sent_no, sentence, citations), in order."""
    rows = cites.select("doc", "page", "sent_no", "sentence", F.posexplode("citations").alias("_i", "c"))
    n = F.row_number().over(W.partitionBy("doc").orderBy("page", "sent_no", "_i")) - 1
    return rows.select("doc", n.alias("pair"), "page", "sentence", F.trim("c.authors").alias("author"), F.trim("c.year").alias("year")).where("author <> '' AND year <> ''")


def select_pairs(all_pairs: DataFrame, store: DataFrame | None = None, most: int = 800) -> DataFrame:
    """Pairs never checked, those of less checked pages first, at most ``most`` of a paper (a budget of the check)."""
    key = T.stable_key("cc", F.col("page"), F.col("sentence"), F.concat_ws("|", "author", "year"))
    rows = all_pairs.withColumn("stable_key", key)
    if store is not None:
        rows = rows.join(store.select(F.col("key").alias("stable_key")).distinct(), "stable_key", "left_anti")
        seen = store.where("page > 0").groupBy("page").agg(F.count(F.lit(1)).alias("_seen"))
        rows = rows.join(seen, "page", "left").withColumn("_seen", F.coalesce("_seen", F.lit(0)))
    else:
        rows = rows.withColumn("_seen", F.lit(0))
    n = F.row_number().over(W.partitionBy("doc").orderBy("_seen", "pair"))
    return rows.withColumn("_n", n).where(F.col("_n") <= most).drop("_n", "_seen")


def with_references(some: DataFrame, references: DataFrame) -> DataFrame:
    """Adds ``index, reference, ref_authors, ref_title, ref_missing``: the reference of each pair (doc, pair, author, year) in its own paper."""
    names = some.select("doc", "pair", F.col("year").alias("y"), T.surnames(F.col("author")).alias("names"))
    r = references.select("doc", F.trim("year").alias("y"), "index", "reference", F.col("authors").alias("ref_authors"))
    j = names.join(r, ["doc", "y"]).withColumn("score", citations.names_hit(F.col("names"), F.lower("ref_authors")) / F.greatest(F.size("names"), F.lit(1))).where(F.col("score") > 0)
    best = j.groupBy("doc", "pair").agg(F.min_by(F.struct("index", "reference", "ref_authors"), F.struct(-F.col("score"), F.col("index"))).alias("r")).select("doc", "pair", "r.*")
    title = F.when(F.col("reference").isNotNull(), T.reference_title(F.col("reference"))).otherwise("")
    return some.join(best, ["doc", "pair"], "left").withColumn("ref_title", title).withColumn("ref_missing", F.col("reference").isNull())


def with_files(found: DataFrame, titles: DataFrame, embed: Embed | None = None, threshold: float = 0.55) -> DataFrame:
    """Adds ``pdf``: the paper's file by author and year in its name, else by the nearest title (``titles``: ``retrieval.title_area``)."""
    keyed = found.withColumn("cite", F.concat_ws("#", "doc", "pair"))
    by_name = documents.file_matches(keyed.select("cite", T.surnames(F.col("author")).alias("names"), F.col("year").alias("y")), titles.select(F.col("doc").alias("pdf")))
    j = keyed.join(by_name, "cite", "left")
    if embed is not None:
        # distinct references, not pairs, are compared with the titles
        open_ = j.where(F.col("pdf").isNull() & ~F.col("ref_missing")).select(retrieval.query_text(F.col("ref_title"), F.col("ref_authors")).alias("q")).where("q <> ''").distinct()
        q = embed(open_.select(F.xxhash64("q").alias("vec_id"), "q"), "q").select("vec_id", "embedding")
        t = embed(titles.select(F.xxhash64("doc").alias("vec_id"), "match_text", "doc"), "match_text")
        near = retrieval.best_title(q, t.select("vec_id", "embedding"), threshold).join(t.select("vec_id", F.col("doc").alias("near")), "vec_id").select("query_id", "near")
        j = j.withColumn("query_id", F.xxhash64(retrieval.query_text(F.col("ref_title"), F.col("ref_authors")))).join(near, "query_id", "left")
        j = j.withColumn("pdf", F.coalesce("pdf", F.when(~F.col("ref_missing"), F.col("near")))).drop("query_id", "near")
    return j.drop("cite")


def evidence_paragraphs(papers: DataFrame) -> DataFrame:
    """(pdf, row_id, page, text): paragraphs of at least 50 characters with a full stop before the references of cited papers (doc, page, text)."""
    rows = pages.before_references(papers).select("doc", "page", F.posexplode(segment.paragraphs(F.col("text"))).alias("_i", "text"))
    rows = rows.where((F.length("text") >= 50) & F.col("text").rlike("[.。]"))
    return rows.select(F.col("doc").alias("pdf"), F.xxhash64("doc", "page", "_i").alias("row_id"), "page", "text")


def check(some: DataFrame, references: DataFrame, papers: DataFrame, embed: Embed, k: int = 5, threshold: float = 0.55) -> DataFrame:
    """One row for each pair: reference, file, the ``k`` best evidence paragraphs of that file and a first verdict.

    ``papers``: (doc, page, text) of the cited papers.  The verdict is REF_NOT_FOUND, PDF_NOT_FOUND or EVIDENCE_ONLY; a model may decide later.
    """
    found = with_files(with_references(some, references), retrieval.title_area(papers), embed, threshold)
    found = found.withColumn("query_id", F.xxhash64("doc", "pair"))
    paras = embed(evidence_paragraphs(papers), "text")
    q = embed(found.where(F.col("pdf").isNotNull()).select("query_id", "pdf", "sentence"), "sentence")
    hits = retrieval.keyed_top_k(q, paras, "pdf", k).join(paras.select("row_id", "page", "text"), "row_id")
    ev = hits.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "page", "score", "text"))).alias("evidence"))  # k rows a pair
    none = F.array().cast("array<struct<rank:int,page:int,score:double,text:string>>")
    verdict = F.when(F.col("pdf").isNotNull(), "EVIDENCE_ONLY").when(F.col("ref_missing"), "REF_NOT_FOUND").otherwise("PDF_NOT_FOUND")
    out = found.join(ev, "query_id", "left").withColumn("evidence", F.coalesce("evidence", none)).withColumn("verdict", verdict)
    return out.select("doc", "pair", "page", F.substring("sentence", 1, 700).alias("sentence"), "author", "year", "ref_title", F.substring("reference", 1, 2000).alias("reference"), "ref_missing", "pdf", "verdict", "evidence", *[c for c in ("stable_key",) if c in some.columns])


def uncited(all_pairs: DataFrame, references: DataFrame, most: int = 1200) -> DataFrame:
    """References of a paper that none of its citations is matched with, the first ``most`` of each paper."""
    keys = references.where("trim(authors) <> '' AND trim(year) <> ''")
    cited = with_references(all_pairs, references).where(~F.col("ref_missing")).select("doc", F.trim("ref_authors").alias("a"), F.col("year").alias("y")).distinct()
    left = keys.withColumn("a", F.trim("authors")).withColumn("y", F.trim("year")).join(cited, ["doc", "a", "y"], "left_anti").drop("a", "y")
    return left.withColumn("_n", F.row_number().over(W.partitionBy("doc").orderBy("index"))).where(F.col("_n") <= most).drop("_n")


def missing_papers(all_pairs: DataFrame, references: DataFrame, papers: DataFrame, embed: Embed, only_cited: bool = True, most: int = 200, threshold: float = 0.55) -> DataFrame:
    """Works (doc, author, year) that are cited (or all that are listed) and have no file, with three candidates each; the first ``most`` of a paper."""
    known = references.where("trim(authors) <> '' AND trim(year) <> ''").select("doc", F.trim("authors").alias("author"), F.trim("year").alias("year")).distinct()
    if only_cited:
        cited = with_references(all_pairs, references).where(~F.col("ref_missing")).select("doc", F.trim("ref_authors").alias("author"), "year").distinct()
        known = known.join(cited, ["doc", "author", "year"], "left_semi")
    n = F.row_number().over(W.partitionBy("doc").orderBy("author", "year"))
    targets = known.withColumn("pair", n - 1).where(F.col("pair") < most)
    titles = retrieval.title_area(papers)
    found = with_files(with_references(targets, references), titles, embed, threshold).where(F.col("pdf").isNull())
    asked = found.withColumn("q", F.when(F.col("ref_title") != "", F.col("ref_title")).otherwise(F.concat_ws(" ", "author", "year"))).withColumn("query_id", F.xxhash64("q"))
    q = embed(asked.select(F.col("query_id").alias("vec_id"), "q").distinct(), "q")
    t = embed(titles.select(F.xxhash64("doc").alias("vec_id"), "match_text", F.col("doc").alias("pdf"), "filename"), "match_text")
    hits = retrieval.block_top_k(t.select("vec_id", "embedding"), q.select("vec_id", "embedding"), 3).join(t.select("vec_id", F.col("pdf").alias("candidate"), "filename"), "vec_id")
    best = hits.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "score", "candidate", "filename"))).alias("candidates"))
    return asked.join(best, "query_id", "left").select("doc", "author", "year", "ref_missing", "ref_title", F.substring("reference", 1, 1200).alias("reference"), "candidates")


def hashed_embedding(groups: int = 128) -> Embed:
    """A stand-in for a model: counts of hashed character trigrams of the text in small letters, of length 1 (another scale than a model's)."""
    @F.pandas_udf("array<double>")
    def vector(texts: pd.Series) -> pd.Series:
        import zlib

        def one(t: str | None) -> list[float]:
            low = " ".join((t or "").lower().split())
            counts = np.zeros(groups)
            for i in range(max(1, len(low) - 2)):
                counts[zlib.crc32(low[i : i + 3].encode("utf-8", "surrogatepass")) % groups] += 1
            return (counts / max(float(np.sqrt((counts**2).sum())), 1e-12)).tolist()

        return texts.map(one)

    return lambda df, text: df.withColumn("embedding", vector(F.col(text)))


def verdict_counts(checked: DataFrame) -> DataFrame:
    return checked.groupBy("doc", "verdict").agg(F.count(F.lit(1)).alias("n"))
