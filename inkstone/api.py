"""Facade: fit library artifacts once, audit many documents in one job, render a report."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.functions import lexicon
from inkstone.functions import text as T
from inkstone.operators import audit, citecheck, corpus, libraries, pages, retrieval, style
from inkstone.report import render
from inkstone.session import materialize
from inkstone.sources.records import write_table


@dataclass(frozen=True)
class Profile:
    """How much an audit looks at."""

    top_k: int = 20
    max_pairs: int = 800
    max_sentences: int = 3600
    low_alignment: float = 0.35


#: The profiles.
PROFILES = {"standard": Profile(), "cheap": Profile(12, 300, 1600, 0.40), "deep": Profile(30, 1400, 5200, 0.32)}


class Engine:
    """``fit`` writes the artifacts of a library below a folder, ``audit`` and ``run`` read them.

    ``embed`` adds an ``embedding`` to a text column; without one papers are not aligned.
    """

    def __init__(self, spark: SparkSession, folder: str, profile: str = "standard", embed: citecheck.Embed | None = None):
        self.spark, self.folder, self.profile, self.embed = spark, folder.rstrip("/"), PROFILES[profile], embed

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def fit(self, library: DataFrame, key: str = "doc_id", text: str = "text") -> None:
        """Statistics of texts; ``fit_pages`` also makes passages, citations, references and sections of paged ones."""
        write_table(corpus.vocabulary(library, key, text), f"{self.folder}/vocabulary")
        write_table(corpus.phrases(library, key, text), f"{self.folder}/phrases")
        write_table(library.where(F.col(text).isNotNull()).agg(F.count(F.lit(1)).alias("docs")), f"{self.folder}/meta")

    def fit_pages(self, pages_: DataFrame, force: bool = False) -> list[str]:
        """Everything of a library of pages (doc, page, text); what is there already stays unless ``force``."""
        whole = pages_.groupBy("doc").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", "text"))), lambda x: x["text"]), "\n").alias("text"))
        tables = pages.material(pages_)
        passages = pages.passages(pages.strip_page_edges(pages_)).select(F.xxhash64("id").alias("vec_id"), "id", F.col("doc").alias("pdf"), "page", "text")
        makers = {
            "vocabulary": lambda: corpus.vocabulary(whole, "doc"),
            "phrases": lambda: corpus.phrases(whole, "doc"),
            "meta": lambda: whole.agg(F.count(F.lit(1)).alias("docs")),
            "passages": lambda: passages if self.embed is None else self.embed(passages, "text"),
            "citations": lambda: tables["citations"],
            "references": lambda: tables["references"],
            "sections": lambda: tables["sections"],
        }
        return libraries.build_missing(self.spark, self.folder, makers, force)

    def status(self) -> dict[str, bool]:
        return {name: libraries.exists(self.spark, f"{self.folder}/{name}") for name in ("vocabulary", "phrases", "meta")}

    def align(self, sentences: DataFrame) -> DataFrame:
        """(doc, sentence_id, score, pct, low_alignment, exemplars) of the sentences that the profile looks at."""
        some = audit.candidates(sentences, most=self.profile.max_sentences).withColumn("vec_id", F.xxhash64("doc", "sentence_id"))
        library = self._table("passages")
        hits = retrieval.search(library, self.embed(some.select("vec_id", "text"), "text").select("vec_id", "embedding"), self.profile.top_k)
        hits = hits.join(library.select("vec_id", "pdf", "page"), "vec_id").withColumnRenamed("vec_id", "row_id")
        found = retrieval.alignment(hits, "query_id", self.profile.low_alignment)
        none = F.array().cast(found.schema["exemplars"].dataType)
        j = some.select("doc", "sentence_id", F.col("vec_id").alias("query_id")).join(found, "query_id", "left").drop("query_id")
        return j.select("doc", "sentence_id", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("pct", F.lit(0)).alias("pct"), F.coalesce("low_alignment", F.lit(True)).alias("low_alignment"), F.coalesce("exemplars", none).alias("exemplars"))

    def run(self, paper_pages: DataFrame, tagged: DataFrame | None = None, tags: DataFrame | None = None) -> dict[str, DataFrame]:
        """The whole audit of any number of papers (doc, page, text): sentences, issues, aligned, items, summary, lexical, diagnoses.

        ``tagged`` (doc, sentence_id, text, lang, upos) and the library's tag pairs ``tags`` (pair) add syntax.
        """
        s = materialize(audit.split_pages(paper_pages), "sentences")
        issues = audit.style_issues(s).unionByName(audit.repetition(s))
        shape = "doc string, sentence_id int, score double, pct int, low_alignment boolean, exemplars array<struct<rank:int,score:double,pct:int,pdf:string,page:int,text:string>>"
        aligned = materialize(self.align(s), "aligned") if self.embed is not None else self.spark.createDataFrame([], shape)
        if tagged is not None and tags is not None:  # only sentences with a finding are looked at
            focus = issues.select("doc", "sentence_id").unionByName(aligned.where("low_alignment").select("doc", "sentence_id"))
            issues = issues.unionByName(audit.syntax_issues(tagged, tags, focus))
        issues = materialize(issues, "issues")
        low = self.profile.low_alignment
        docs = self._table("meta").select(F.explode(F.array(F.lit("en"), F.lit("zh"))).alias("lang"), "docs")
        return {
            "sentences": s, "issues": issues, "aligned": aligned, "items": audit.items(s, issues, aligned, low), "summary": audit.summary(s, issues, aligned, low),
            "lexical": audit.lexical(s, self._table("vocabulary"), docs), "diagnoses": audit.diagnoses(issues),
        }

    def check_citations(self, paper_pages: DataFrame, papers: DataFrame, store: DataFrame | None = None) -> DataFrame:
        """Citation checks of papers against cited papers, as many pairs as the profile allows."""
        clean = pages.strip_running_heads(paper_pages)
        some = citecheck.select_pairs(citecheck.pairs(pages.citation_sentences(clean)), store, self.profile.max_pairs)
        return citecheck.check(some, pages.reference_entries(clean), pages.strip_running_heads(papers), self.embed or citecheck.hashed_embedding())

    def export(self, result: dict[str, DataFrame], doc: str, folder: str) -> str:
        """Write ``result.json`` and ``report.md`` of one paper and return the report."""
        one = lambda name: [r.asDict(recursive=True) for r in result[name].where(F.col("doc") == doc).collect()]  # noqa: E731 - one paper
        parts = {"meta": {"doc": doc}, "summary": (one("summary") or [{}])[0], "items": sorted(one("items"), key=lambda x: x["position"]), "lexical": one("lexical")}
        text = render(parts)
        os.makedirs(folder, exist_ok=True)
        for name, content in (("result.json", json.dumps(parts, ensure_ascii=False, default=str)), ("report.md", text)):
            with open(f"{folder}/{name}.tmp", "w", encoding="utf-8") as f:
                f.write(content)
            os.replace(f"{folder}/{name}.tmp", f"{folder}/{name}")
        return text

    def audit(self, sentences: DataFrame, doc: str = "doc_id", key: str = "sent_id", text: str = "text") -> DataFrame:
        """Long-form issues (doc, sent_id, issue_type, severity, matched) of sentences of any number of documents."""
        s = sentences.select(F.col(doc).alias("doc"), F.col(key).alias("sent_id"), F.col(text).alias("t")).where("t IS NOT NULL")
        transitions = style.contained(s, "t", lexicon.TRANSITIONS_EN, "ai_transition", True).unionByName(style.contained(s, "t", lexicon.TRANSITIONS_ZH, "ai_transition"))
        words = style.contained(s, "t", lexicon.AI_WORDS_ZH, "ai_word")
        shape = [F.lit("warning").alias("severity"), F.col("term").alias("matched")]
        issues = transitions.select("doc", "sent_id", "issue_type", *shape).unionByName(words.select("doc", "sent_id", "issue_type", F.lit("info").alias("severity"), F.col("term").alias("matched")))
        brackets = s.select("doc", "sent_id", F.lit("punctuation").alias("issue_type"), F.lit("warning").alias("severity"), T.unbalanced(F.col("t")).alias("matched")).where("matched IS NOT NULL")
        phrases = self.spark.read.parquet(f"{self.folder}/phrases").select("bigram", F.lit(1).alias("known"))
        pairs = s.select("doc", "sent_id", F.explode(T.bigrams(T.ascii_words(F.col("t")))).alias("bigram")).join(phrases, "bigram", "left")
        per = pairs.groupBy("doc", "sent_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("known").isNull()).alias("u"), F.array_join(F.slice(F.array_sort(F.collect_set(F.when(F.col("known").isNull(), F.col("bigram")))), 1, 3), "; ").alias("matched"))
        odd = per.where((F.col("n") >= 8) & (F.col("u") >= 3) & (F.col("u") / F.col("n") >= 0.25))
        odd = odd.select("doc", "sent_id", F.lit("uncommon_phrasing").alias("issue_type"), F.when((F.col("u") >= 4) & (F.col("u") / F.col("n") >= 0.33), "warning").otherwise("info").alias("severity"), "matched")
        return issues.unionByName(brackets).unionByName(odd)

    def report(self, issues: DataFrame, most: int = 40) -> DataFrame:
        """(doc, markdown): counts by type and the first sentences of each type."""
        from pyspark.sql import Window as W

        n = F.row_number().over(W.partitionBy("doc", "issue_type").orderBy(F.desc("severity"), "sent_id", "matched"))
        shown = issues.withColumn("n", n).where(F.col("n") <= most)
        line = F.concat(F.lit("- S"), F.col("sent_id").cast("string"), F.lit(" ("), F.col("severity"), F.lit("): "), F.col("matched"))
        total = issues.groupBy("doc", "issue_type").agg(F.count(F.lit(1)).alias("total"))
        parts = shown.groupBy("doc", "issue_type").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines")).join(total, ["doc", "issue_type"])
        section = F.concat(F.lit("## "), F.col("issue_type"), F.lit(" ("), F.col("total").cast("string"), F.lit(")\n"), F.col("lines"))
        return parts.groupBy("doc").agg(F.concat(F.lit("# Audit of "), F.col("doc").cast("string"), F.lit("\n\n"), F.array_join(F.sort_array(F.collect_list(section)), "\n\n")).alias("markdown"))
