"""Documents as rows (doc, page, text): running heads, references, passages, citations, the material document.

Nothing of a document is collected but the lines of one entry or paragraph; what belongs to a
whole document (its references page, its running heads) is a small row joined to its pages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkstone.functions import citing, headings, prose, segment
from inkstone.functions import text as T
from inkstone.operators import structure

_LINES = "\\r\\n|[\\n\\r]"


def line_key(line: Column) -> Column:
    """What repeated heads and feet have in common: letters only, small, of lines of 5 to 160 characters; empty if under six."""
    s = F.trim(F.regexp_replace(line, "^[\\s\\p{Z}]+|[\\s\\p{Z}]+$", ""))
    t = F.regexp_replace(F.regexp_replace(F.replace(s, F.lit("­"), F.lit("")), "[ \\t]+", " "), "\\d+", "")
    t = F.lower(F.trim(F.regexp_replace(F.regexp_replace(t, "[^A-Za-z\\x{4e00}-\\x{9fff} ]+", ""), " +", " ")))
    return F.when(F.length(s).between(5, 160) & (F.length(t) >= 6), t).otherwise("")


def _full_lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), _LINES, -1), lambda x: F.regexp_replace(x, "^[\\s\\p{Z}]+|[\\s\\p{Z}]+$", "")), lambda x: x != "")


def running_heads(pages: DataFrame, doc: str = "doc", text: str = "text") -> DataFrame:
    """(doc, line_key, place, pages): keys among the first or last two lines of at least 60 % of three pages or more."""
    lines = _full_lines(F.col(text))
    edges = F.concat(F.transform(F.slice(lines, 1, 2), lambda x: F.struct(F.lit("head").alias("place"), line_key(x).alias("line_key"))), F.transform(F.slice(lines, F.greatest(F.size(lines) - 1, F.lit(1)), F.lit(2)), lambda x: F.struct(F.lit("foot").alias("place"), line_key(x).alias("line_key"))))
    rows = pages.select(doc, F.explode(edges).alias("e")).select(doc, "e.*").where("line_key <> ''")
    total = pages.groupBy(doc).agg(F.count(F.lit(1)).alias("n"))
    per = rows.groupBy(doc, "line_key", "place").agg(F.count(F.lit(1)).alias("pages"))
    often = (F.col("n") >= 3) & (F.col("pages") >= F.greatest(F.lit(2), F.floor(F.col("n") * 0.6)))
    return per.join(total, doc).where(often).select(doc, "line_key", "place", "pages")


def strip_running_heads(pages: DataFrame, doc: str = "doc", text: str = "text") -> DataFrame:
    """The pages without any line whose key is a running head or foot of its document."""
    drop = running_heads(pages, doc, text).groupBy(doc).agg(F.collect_set("line_key").alias("_drop"))  # a few keys a document
    kept = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), _LINES, -1), lambda x: ~F.array_contains(F.col("_drop"), line_key(x)))
    cut = F.when(F.col("_drop").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))
    return pages.join(drop, doc, "left").withColumn(text, cut).drop("_drop")


def strip_page_edges(pages: DataFrame, doc: str = "doc", text: str = "text") -> DataFrame:
    """The pages for passages: of four pages or more without page numbers and without lines repeated exactly at their edges."""
    lines = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), _LINES, -1), lambda x: T.normalize_ws(x) != "")
    rows = pages.withColumn("_l", lines)
    edge = lambda part, place: F.transform(part, lambda x: F.struct(F.lit(place).alias("place"), T.normalize_ws(x).alias("line")))
    ends = rows.select(doc, F.explode(F.concat(edge(F.slice("_l", 1, 2), "head"), edge(F.slice("_l", F.greatest(F.size("_l") - 1, F.lit(1)), F.lit(2)), "foot"))).alias("e")).select(doc, "e.*").where(F.length("line") <= 100)
    total = pages.groupBy(doc).agg(F.count(F.lit(1)).alias("_n"))
    bad = ends.groupBy(doc, "place", "line").agg(F.count(F.lit(1)).alias("c")).join(total, doc).where((F.col("_n") >= 4) & (F.col("c") >= F.floor(0.6 * F.col("_n"))))
    bad = bad.groupBy(doc).agg(*[F.collect_set(F.when(F.col("place") == p, F.col("line"))).alias(f"_{p}") for p in ("head", "foot")])
    none = F.array().cast("array<string>")
    n = F.size("_l")

    def keep(x: Column, i: Column) -> Column:
        line = T.normalize_ws(x)
        return ~prose.page_number(line) & ~((i < 3) & F.array_contains(F.coalesce("_head", none), line)) & ~((i >= n - 3) & F.array_contains(F.coalesce("_foot", none), line))

    kept = F.array_join(F.when(F.col("_n") < 4, F.col("_l")).otherwise(F.filter("_l", keep)), "\n")
    return rows.join(bad, doc, "left").join(total, doc).withColumn(text, kept).drop("_l", "_n", "_head", "_foot")


def before_references(pages: DataFrame, doc: str = "doc", page: str = "page", text: str = "text") -> DataFrame:
    """The pages before the references heading of each document, and what stands before it on its own page."""
    first = pages.where(citing.page_has_references(F.col(text))).groupBy(doc).agg(F.min(page).alias("_cut"))
    at = citing.references_line(F.col(text))
    head = F.trim(F.array_join(F.slice(F.split(F.col(text), _LINES, -1), 1, F.coalesce(at, F.lit(0))), "\n"))
    rows = pages.join(first, doc, "left").where(F.col("_cut").isNull() | (F.col(page) <= F.col("_cut")))
    rows = rows.withColumn(text, F.when(F.col("_cut") == F.col(page), head).otherwise(F.col(text)))
    return rows.where(F.col("_cut").isNull() | (F.col("_cut") != F.col(page)) | (F.col(text) != "")).drop("_cut")


def passages(pages: DataFrame, doc: str = "doc", page: str = "page", text: str = "text", least: int = 60, most: int = 900, limit: int | None = None, cut: bool = True) -> DataFrame:
    """(id, doc, page, chunk, text): paragraphs of a page of 60 to 900 characters, longer ones in slices, short ones together if all are short.

    ``limit``: so many passages in order of document and page (a feature of index builds); ``cut``: only what stands before a references heading.
    """
    parts = segment.paragraphs(prose.before_references(F.col(text)) if cut else F.col(text))
    joined = T.normalize_ws(F.array_join("_p", " "))
    some = F.exists("_p", lambda p: F.length(p) >= least)
    rows = pages.select(doc, page, parts.alias("_p")).withColumn("_p", F.when(~some & (F.length(joined) >= least), F.array(joined)).otherwise(F.col("_p")))
    slices = lambda p: F.transform(F.sequence(F.lit(0), F.ceil(F.length(p) / most).cast("int") - 1), lambda i: T.normalize_ws(F.substring(p, i * most + 1, F.lit(most))))
    sliced = F.filter(F.flatten(F.transform(F.filter("_p", lambda p: F.length(p) >= least), slices)), lambda c: F.length(c) >= least)
    out = rows.select(doc, page, F.posexplode(sliced).alias("chunk", "text"))
    out = out.select(F.concat(F.col(doc), F.lit("#p"), F.col(page), F.lit("#"), F.col("chunk")).alias("id"), doc, page, "chunk", "text")
    return out if limit is None else out.orderBy(doc, page, "chunk").limit(limit)


def citation_sentences(pages: DataFrame, doc: str = "doc", page: str = "page", text: str = "text", stop: bool = True) -> DataFrame:
    """(doc, page, sent_no, sentence, citations) of the sentences before the references that cite somebody."""
    rows = before_references(pages, doc, page, text) if stop else pages
    s = rows.select(doc, page, F.posexplode(prose.citation_sentences(F.col(text))).alias("sent_no", "sentence")).where(~citing.reference_entry_like(F.col("sentence")))
    return s.withColumn("citations", citing.citations(F.col("sentence"))).where(F.size("citations") > 0)


def reference_entries(pages: DataFrame, doc: str = "doc", page: str = "page", text: str = "text") -> DataFrame:
    """(doc, page, index, reference, authors, year): the entries behind the references heading; those without a year are counted but left out."""
    first = pages.where(citing.page_has_references(F.col(text))).groupBy(doc).agg(F.min(page).alias("_first"))
    at = F.when(F.col(page) == F.col("_first"), F.coalesce(citing.references_line(F.col(text)) + 1, F.lit(0))).otherwise(0)
    rows = pages.join(first, doc).where(F.col(page) >= F.col("_first")).select(doc, page, F.posexplode(F.slice(F.split(F.coalesce(F.col(text), F.lit("")), _LINES, -1), at + 1, F.lit(1_000_000))).alias("_i", "_x"))
    line = T.normalize_ws(F.col("_x"))
    rows = rows.withColumn("_s", line).where((F.col("_s") != "") & ~citing.references_heading(F.col("_s")) & ~F.col("_s").rlike("^\\d{1,4}$"))
    order = W.partitionBy(doc).orderBy(page, "_i")
    opens = citing.begins_reference(F.col("_s")) | (F.row_number().over(order) == 1)
    marked = rows.withColumn("_new", opens.cast("int")).withColumn("index", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)).cast("int"))
    parts = marked.groupBy(doc, "index").agg(F.min(page).alias("page"), F.sort_array(F.collect_list(F.struct(F.col(page).alias("p"), "_i", "_s"))).alias("_l"))
    out = parts.select(doc, "page", "index", T.normalize_ws(F.array_join(F.transform("_l", lambda x: x["_s"]), " ")).alias("reference"))
    return out.withColumn("authors", citing.reference_authors(F.col("reference"))).withColumn("year", citing.reference_year(F.col("reference"))).where("year <> ''")


def languages_of(pages: DataFrame, doc: str = "doc", page: str = "page", text: str = "text", first: int = 2) -> DataFrame:
    """(doc, language) by the first pages of each document."""
    n = F.row_number().over(W.partitionBy(doc).orderBy(page))
    head = pages.select(doc, page, text).withColumn("_n", n).where(F.col("_n") <= first)
    zh, en = F.sum(T.han_count(F.col(text))), F.sum(T.latin_count(F.col(text)))
    share = F.col("zh") / F.nullif(F.col("zh") + F.col("en"), F.lit(0))
    return head.groupBy(doc).agg(zh.alias("zh"), en.alias("en")).select(doc, F.when(share > 0.7, "zh").when(share > 0.3, "mixed").otherwise("en").alias("language"))


def sections(pages: DataFrame, doc: str = "doc", page: str = "page", text: str = "text", label: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """The sections (doc, id, parent, level, page, title, canonical) and paragraphs (doc, id, page, section, text, sentences) before the references.

    ``label`` may give the headings (doc, ord, title, canonical) better classes: it returns (doc, ord, canonical).
    """
    prose_pages = before_references(pages, doc, page, text).join(languages_of(pages, doc, page, text), doc)
    lang = F.when(F.col("language") == "mixed", T.language(F.col(text))).otherwise(F.col("language"))
    rows = segment.blocks(prose_pages.withColumn("_lang", lang), [doc, page, "_lang"], text, F.col("_lang"))
    order = W.partitionBy(doc).orderBy(page, "block")
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    heading = F.col("type") == "heading"
    rows = rows.withColumn("ord", F.sum(heading.cast("int")).over(upto) - 1).withColumn("par", F.sum((~heading).cast("int")).over(upto) - 1)
    heads = rows.where(heading).select(doc, "ord", page, F.col("text").alias("title"), headings.level(F.col("text"), F.col("_lang")).alias("level"), headings.canonical(F.col("text"), F.col("_lang")).alias("canonical"), F.col("_lang").alias("lang"))
    if label is not None:
        better = label(heads.select(doc, "ord", "title", "canonical")).select(doc, "ord", F.col("canonical").alias("_better"))
        heads = heads.join(better, [doc, "ord"], "left").withColumn("canonical", F.coalesce("_better", "canonical")).drop("_better")
    heads = structure.parents(heads, doc, "ord", "level", "ord")
    name = lambda c: F.when(c.isNull() | (c < 0), "").otherwise(F.concat(F.lit("S"), c))
    heads = heads.select(doc, "ord", name(F.col("ord")).alias("id"), name(F.col("parent")).alias("parent"), "level", page, "title", "canonical", "lang")
    body = rows.where(~heading).select(doc, F.concat(F.lit("P"), F.col("par")).alias("id"), "par", page, name(F.col("ord")).alias("section"), "text", F.col("_lang").alias("lang"))
    body = segment.with_sentences(body, "text", F.col("lang"))
    kept = F.filter("sentences", lambda x: ~((F.length(x["text"]) <= 140) & headings.heading_like(x["text"], F.col("lang"))))
    return heads, body.withColumn("sentences", F.transform(kept, lambda x, i: F.struct(i.alias("id"), T.normalize_ws(x["text"]).alias("text"), x["start"].alias("start"), x["end"].alias("end"))))


#: Classes of headings that an outline leaves out.
NO_OUTLINE = ["other", "figure_table", "references", "appendix", "acknowledgements"]


def outlines(heads: DataFrame, doc: str = "doc", top: int = 8) -> DataFrame:
    """(outline, n, example): the most frequent sequences of classes of up to 18 headings, and the first document of each."""
    some = heads.where(~F.col("canonical").isin(*NO_OUTLINE))
    seq = some.groupBy(doc).agg(F.sort_array(F.collect_list(F.struct("ord", "canonical"))).alias("h"))
    text = F.array_join(F.slice(F.transform("h", lambda x: x["canonical"]), 1, 18), " > ")
    return seq.groupBy(text.alias("outline")).agg(F.count(F.lit(1)).alias("n"), F.min(doc).alias("example")).orderBy(F.desc("n"), "outline").limit(top)


def material(pages: DataFrame, doc: str = "doc", page: str = "page", text: str = "text", label: Callable[[DataFrame], DataFrame] | None = None) -> dict[str, DataFrame]:
    """The tables of the material documents: meta, sections, paragraphs, citations and references."""
    clean = strip_running_heads(pages, doc, text)
    heads, body = sections(clean, doc, page, text, label)
    cites, refs = citation_sentences(clean, doc, page, text), reference_entries(clean, doc, page, text)
    meta = clean.groupBy(doc).agg(F.count(F.lit(1)).cast("int").alias("pages_total")).join(languages_of(clean, doc, page, text), doc)
    meta = meta.withColumn("doc_id", F.substring(F.sha1(doc), 1, 16))
    for name, table in (("citation_sentence_count", cites), ("reference_count", refs)):
        meta = meta.join(table.groupBy(doc).agg(F.count(F.lit(1)).alias(name)), doc, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return {"meta": meta, "sections": heads, "paragraphs": body, "citations": cites, "references": refs.withColumn("reference", F.substring("reference", 1, 2400))}
