"""Structure of paged texts: reference entries, outlines, citations, file matching, scaffolds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkstone.functions import headings, lexicon
from inkstone.functions import text as T


def reference_islands(lines: DataFrame, doc: str, order: str, line: str) -> DataFrame:
    """(doc, entry, reference): lines assembled to entries; an entry begins with a number or with authors and a year.

    Lines before the first beginning make no entry.
    """
    s = F.trim(F.col(line))
    numbered = s.rlike("^(?:\\[\\d{1,3}\\]|\\d{1,3}[.)])\\s")
    authored = s.rlike("^[\\p{Lu}\\x{4e00}-\\x{9fff}][\\p{L}’'-]*[,，.(（ ]") & F.substring(s, 1, 220).rlike("(?:18|19|20)\\d{2}")
    begins = (numbered | authored).cast("int")
    upto = F.sum(begins).over(W.partitionBy(doc).orderBy(order))
    marked = lines.where(s != "").withColumn("entry", upto).where(F.col("entry") > 0)
    parts = marked.groupBy(doc, "entry").agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), s.alias("s")))).alias("p"))
    return parts.select(doc, F.col("entry").cast("int").alias("entry"), F.array_join(F.transform("p", lambda x: x["s"]), " ").alias("reference"))


#: A line that is only the heading of a list of references.
REFERENCES_LINE = "(?i)^(?:references|bibliography|literature cited|参考文献|引用文献|文献)$"


def reference_lines(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, o, line): the lines of each document from its references heading on, or all if it begins with it."""
    lines = F.split(F.col(text), "\\r?\\n")
    heads = F.transform(lines, lambda x, i: F.trim(x).rlike(REFERENCES_LINE) | ((i == 0) & x.startswith("References")))
    some = docs.where(F.col(text).isNotNull()).select(doc, F.array_position(heads, F.lit(True)).alias("_at"), F.posexplode(lines).alias("o", "line"))
    return some.where((F.col("_at") > 0) & (F.col("o") + 1 >= F.col("_at"))).drop("_at")


def outlines(headings: DataFrame, doc: str, order: str, canonical: str) -> DataFrame:
    """(outline, n, example): sequences of canonical headings, how often, and the first document."""
    seq = headings.groupBy(doc).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(canonical).alias("c")))).alias("h"))
    text = F.array_join(F.slice(F.transform("h", lambda x: x["c"]), 1, 18), " > ")
    return seq.groupBy(text.alias("outline")).agg(F.count(F.lit(1)).alias("n"), F.min(doc).alias("example"))


#: What numbers a heading.
HEADING_PREFIX = "^\\s*(?:\\d+(?:\\.\\d+)*[.)]?|[一二三四五六七八九十]+[、.．)）]|[（(][一二三四五六七八九十]+[)）]|第[一二三四五六七八九十0-9]+[章节篇])\\s*"
#: Lines that are headings by their numbering, and the names of sections that need none.
NUMBERED = "^(?:\\d+(?:\\.\\d+)* \\p{L}|[一二三四五六七八九十]+[、.．)）]\\s*\\S|[（(][一二三四五六七八九十]+[)）]\\s*\\S)"
SECTION_EN = "(?i)^(?:abstract|introduction|background|motivation|related work|literature review|data|methods?|methodology|empirical strategy|model|results|discussion|conclusions?|references|acknowledge?ments|appendix|appendices|keywords|jel classification)[\\s:：。！？；.!?]*$"
SECTION_ZH = "^(?:中文摘要|英文摘要|摘要|引言|前言|绪论|结论|总结|参考文献|附录|致谢|关键词|文献综述|相关工作|研究背景|研究设计|研究方法|方法|模型|数据|样本|变量|结果|讨论|实证结果)"


def heading_like(line: Column) -> Column:
    """A short line with a number (Western or Chinese), or the name of a section."""
    base = F.regexp_replace(line, HEADING_PREFIX, "")
    return (F.length(line) <= 60) & (line.rlike(NUMBERED) | base.rlike(SECTION_EN) | (base.rlike(SECTION_ZH) & (F.length(base) <= 12)))


def canonical(heading: Column) -> Column:
    """The class of a heading, ``other`` if none fits."""
    return headings.canonical(heading, F.lit("mixed"))


def narrative_citations(s: Column) -> Column:
    """Names directly before a bracketed year: array of ``name|year``."""
    found = F.regexp_extract_all(s, F.lit("[A-Z][A-Za-z'’-]+(?: et al\\.)? ?[(（](?:18|19|20)[0-9]{2}[a-z]?[)）]"), 0)
    return F.transform(found, lambda x: F.regexp_replace(x, " ?[(（]((?:18|19|20)[0-9]{2}[a-z]?)[)）]$", "|$1"))


def scaffold(s: Column, language: Column | None = None) -> Column:
    """The phrase worth keeping: of English the first listed phrase that occurs anywhere, else the first six words; of Chinese the first clause, at most 16 characters."""
    text = F.regexp_replace(F.trim(s), "^\\[[^\\]]+\\][\\s\\p{Z}]*", "")
    low = F.lower(text)

    def phrase(p: str) -> Column:
        at = F.locate(p, low)
        more = F.substring(text, at + len(p), F.lit(1))
        return F.when(at > 0, F.concat(F.substring(text, at, F.lit(len(p))), F.when(more.isin(",", "，"), more).otherwise("")))

    words = F.filter(F.regexp_extract_all(text, F.lit("[\\p{L}\\p{N}_]+"), 0), lambda w: w.rlike("^\\p{L}+$"))
    english = F.coalesce(*[phrase(p) for p in lexicon.SCAFFOLDS_EN], F.array_join(F.slice(words, 1, 6), " "))
    tight = F.regexp_replace(s, "[\\s\\p{Z}]+", "")
    clause = F.regexp_replace(F.regexp_extract(tight, "^([^。！？；;]*)", 1), "^[（(]?\\d+(?:\\.\\d+)?[)）]?", "")
    chinese = F.when(clause != "", F.substring(clause, 1, 16)).otherwise(F.substring(tight, 1, 16))
    return english if language is None else F.when(language == "zh", chinese).otherwise(english)


def file_matches(citations: DataFrame, files: DataFrame) -> DataFrame:
    """(cite, pdf): the file whose name has the year and the largest share of the family names; the first path wins ties.

    ``citations``: (cite, names array or one name, y); ``files``: (pdf).  They meet on the figures of the name.
    """
    name = F.lower(F.regexp_extract("pdf", "([^/\\\\]*)$", 1))
    figures = F.flatten(F.transform(F.regexp_extract_all(name, F.lit("\\d{4,}"), 0), lambda d: F.transform(F.sequence(F.lit(1), F.length(d) - 3), lambda i: F.substring(d, i, F.lit(4)))))
    w = files.select("pdf", name.alias("name"), F.explode(F.array_distinct(figures)).alias("y4"))
    if "names" not in citations.columns:
        citations = citations.withColumn("names", F.array("name")).drop("name")
    j = citations.withColumn("y4", F.substring("y", 1, 4)).join(w, "y4").where(F.contains("name", F.lower("y")))
    hits = F.size(F.filter("names", lambda n: (n != "") & F.contains(F.col("name"), n)))
    j = j.withColumn("score", F.round(hits / F.greatest(F.size("names"), F.lit(1)), 6)).where(F.col("score") > 0)
    best = j.groupBy("cite").agg(F.min(F.struct((-F.col("score")).alias("s"), "pdf")).alias("b"))
    return best.select("cite", F.col("b.pdf").alias("pdf"))


def conllu(df: DataFrame, text: str, doc: str) -> DataFrame:
    """(doc, upos, deprel) arrays of dependency-parsed text; comments, ranges and empty nodes left out."""
    lines = F.filter(F.transform(F.split(F.col(text), "\n"), lambda x: F.split(x, "\t")), lambda c: (F.size(c) >= 8) & ~c[0].startswith("#") & ~c[0].rlike("[-.]"))
    return df.select(doc, F.transform(lines, lambda c: c[3]).alias("upos"), F.transform(lines, lambda c: c[7]).alias("deprel"))


def syntax_outliers(sentences: DataFrame, known: DataFrame, key: str, upos: str) -> DataFrame:
    """(key, pairs, unseen) of sentences with at least 5 tag pairs, 3 of them unseen, and a share of 0.55."""
    pairs = sentences.select(key, F.explode(T.bigrams(F.col(upos))).alias("pair"))
    j = pairs.join(known.select("pair", F.lit(1).alias("_known")).distinct(), "pair", "left")
    per = j.groupBy(key).agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("_known").isNull()).alias("unseen"))
    return per.where((F.col("pairs") >= 5) & (F.col("unseen") >= 3) & (F.col("unseen") / F.col("pairs") >= 0.55))
