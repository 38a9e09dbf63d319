"""In-text citations, years, authors and reference lines, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkstone.functions import text as T

#: What a year, an author's name and a list of authors look like, and the captions that are no citations.
YEAR = "(?:18|19|20)\\d{2}[a-zA-Z]?"
NAME = "[A-Z][A-Za-z'’\\-]+"
NAME_ZH = "[\\x{4e00}-\\x{9fff}]{1,8}"
CAPTIONS = ["fig", "figure", "table", "eq", "equation", "appendix", "section", "sec", "chap", "chapter"]

_B, _E, _S = "(?<![\\p{L}\\p{N}_])", "(?![\\p{L}\\p{N}_])", "[\\s\\p{Z}]*"
_YEARS = f"{YEAR}(?:{_S}[,;，；]{_S}{YEAR})*"
_AUTHORS = f"{NAME}(?:,{_S}{NAME})*(?:,{_S})?(?:\\s+(?:and|&)\\s+{NAME})?(?:\\s+et\\s+al\\.)?"
_AUTHORS_ZH = f"{NAME_ZH}(?:{_S}[、,，]{_S}{NAME_ZH})*(?:{_S}(?:等|等人))?"
_CITATION = "struct<kind:string,authors:string,year:string,raw:string>"


def years(s: Column) -> Column:
    """Distinct years with an optional letter, in order; ``2019a, b`` also gives 2019b."""
    plain = F.regexp_extract_all(s, F.lit(f"{_B}{YEAR}{_E}"), 0)
    shape = f"{_B}((?:18|19|20)\\d{{2}})([a-zA-Z]){_E}{_S}[,;]{_S}([a-zA-Z](?:{_S}[,;]{_S}[a-zA-Z])*)"
    runs = F.arrays_zip(*[F.regexp_extract_all(s, F.lit(shape), i).alias(n) for i, n in ((1, "y"), (2, "a"), (3, "r"))])
    more = F.flatten(F.transform(runs, lambda x: F.transform(F.concat(F.array(x["a"]), F.regexp_extract_all(x["r"], F.lit("[a-zA-Z]"), 0)), lambda c: F.concat(x["y"], c))))
    return F.array_distinct(F.concat(plain, more))


def strip_prefixes(s: Column) -> Column:
    """Without a leading see, e.g., i.e., cf. or for example."""
    return F.trim(F.regexp_replace(s, "(?i)^\\s*(?:see|e\\.g\\.|i\\.e\\.|cf\\.|for example)\\s*", ""))


def _each_year(kind: str, authors: Column, listed: Column, raw: Column) -> Column:
    return F.transform(listed, lambda y: F.struct(F.lit(kind).alias("kind"), authors.alias("authors"), y.alias("year"), raw.alias("raw")))


def _narrative(s: Column, authors: str, start: str) -> Column:
    shape = f"{start}({authors}){_S}[（(]{_S}({_YEARS}){_S}[）)]"
    found = F.arrays_zip(*[F.regexp_extract_all(s, F.lit(shape), i).alias(n) for i, n in ((1, "a"), (2, "y"), (0, "r"))])
    head = lambda x: F.lower(F.regexp_extract(x["a"], "^([^\\s\\p{Z}]+?),*(?:[\\s\\p{Z}]|$)", 1))
    kept = F.filter(found, lambda x: ~head(x).isin(*CAPTIONS, "panel"))
    return F.flatten(F.transform(kept, lambda x: _each_year("narrative", F.trim(x["a"]), years(x["y"]), x["r"])))


def _bracketed(inner: Column, raw: Column) -> Column:
    """Citations of a bracket: parts of authors and years; a part of years alone has the authors of the part before."""
    parts = F.filter(F.transform(F.split(inner, f"{_S}[;；]{_S}", -1), lambda p: strip_prefixes(F.trim(p))), lambda p: p != "")

    def step(acc: Column, p: Column) -> Column:
        own = F.trim(F.regexp_extract(p, f"^([^,，]{{2,120}}){_S}[,，]", 1))
        rest = F.regexp_replace(p, f"^[^,，]{{2,120}}{_S}[,，]", "")
        listed = F.when(own != "", years(rest)).otherwise(years(p))
        who = F.when(own != "", own).otherwise(acc["who"])
        got = F.when(who.isNotNull() & (F.size(listed) > 0), _each_year("parenthetical", who, listed, raw)).otherwise(F.array().cast(f"array<{_CITATION}>"))
        return F.struct(F.when((own != "") & (F.size(listed) > 0), own).otherwise(acc["who"]).alias("who"), F.concat(acc["out"], got).alias("out"))

    begin = F.struct(F.lit(None).cast("string").alias("who"), F.array().cast(f"array<{_CITATION}>").alias("out"))
    return F.aggregate(parts, begin, step, lambda acc: acc["out"])


def citations(s: Column) -> Column:
    """``array<struct<kind, authors, year, raw>>``: narrative ones, narrative ones in Chinese, those in brackets; one for each year."""
    brackets = F.arrays_zip(*[F.regexp_extract_all(s, F.lit("[（(]([^（）()]{0,300})[）)]"), i).alias(n) for i, n in ((1, "i"), (0, "r"))])
    caption = "(?i)^\\s*(?:" + "|".join(CAPTIONS) + f"){_E}"
    cites = F.filter(brackets, lambda x: x["i"].rlike(f"{_B}{YEAR}{_E}") & ~x["i"].rlike(caption) & x["i"].rlike("[,，]"))
    bracketed = F.flatten(F.transform(cites, lambda x: _bracketed(F.trim(x["i"]), x["r"])))
    none = F.array().cast(f"array<{_CITATION}>")
    return F.coalesce(F.concat(_narrative(s, _AUTHORS, _B), _narrative(s, _AUTHORS_ZH, ""), bracketed), none)


def references_heading(line: Column) -> Column:
    """A short line that is only the heading of a list of references."""
    s = F.trim(F.regexp_replace(line, "^[\\s\\p{Z}]+|[\\s\\p{Z}]+$", ""))
    return (F.length(s) <= 60) & s.rlike("(?i)^(?:references|bibliography|literature cited)$|^(?:参考文献|引用文献|文献)$")


def page_has_references(page: Column) -> Column:
    """Whether one of the first 30 lines with text is such a heading."""
    full = F.filter(F.split(F.coalesce(page, F.lit("")), "\\r\\n|[\\n\\r]", -1), lambda x: F.trim(x) != "")
    return F.exists(F.slice(full, 1, 30), references_heading)


def references_line(page: Column) -> Column:
    """The index (from 0) of the first such heading among the first 300 lines, null if there is none."""
    heads = F.transform(F.slice(F.split(F.coalesce(page, F.lit("")), "\\r\\n|[\\n\\r]", -1), 1, 300), references_heading)
    return F.nullif(F.array_position(heads, F.lit(True)), F.lit(0)).cast("int") - 1


def reference_like(text: Column) -> Column:
    """A passage that begins like a list of references."""
    head = F.lower(F.trim(F.substring(F.trim(text), 1, 80)))
    return F.coalesce(head.rlike("^(?:references|bibliography|参考文献|引用文献)"), F.lit(False))


def reference_entry_like(sentence: Column) -> Column:
    """A sentence that is an entry of a list of references."""
    s = F.trim(sentence)
    return (F.length(s) >= 8) & s.rlike(f"^{NAME},\\s*[A-Z](?:\\.[A-Z])?\\.|^\\[\\d+\\]\\s*{NAME}")


def begins_reference(line: Column) -> Column:
    """Whether a line begins an entry: a number, or authors with a year in the first 220 characters."""
    authors = f"^{NAME},|^{NAME}(?:\\s+{NAME}){{0,2}}\\s*\\(|^{NAME_ZH}\\s*[,，]|^{NAME_ZH}(?:\\s+{NAME_ZH}){{0,2}}\\s*[（(]"
    return line.rlike("^\\s*(?:\\[\\d+\\]|\\d+\\.)\\s+") | (line.rlike(authors) & F.substring(line, 1, 220).rlike(f"{_B}{YEAR}{_E}"))


def reference_year(reference: Column) -> Column:
    """The first year of an entry, empty if it has none."""
    return F.regexp_extract(_unnumbered(reference), f"{_B}{YEAR}{_E}", 0)


def reference_authors(reference: Column) -> Column:
    """What stands before the first year of an entry, without its number and the marks at its end."""
    head = F.regexp_extract(_unnumbered(reference), f"(?s)^(.*?){_B}{YEAR}{_E}", 1)
    return T.normalize_ws(F.regexp_replace(F.trim(head), "[(\\[,.;:]+$", ""))


def _unnumbered(reference: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(reference, F.lit("")), "^\\s*(?:\\[\\d+\\]|\\d+\\.)\\s+", ""))
