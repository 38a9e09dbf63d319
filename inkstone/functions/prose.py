"""What is prose: tests and cuts of pages and sentences as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkstone.functions import text as T

#: Abbreviations behind which the citation splitter goes on.
ABBREVIATIONS = ["e.g", "i.e", "et al", "fig", "eq", "sec", "no", "dr", "mr", "ms", "prof", "jr", "sr", "st", "vs", "etc"]
#: Headings that begin a list of references, by precedence.
REFERENCE_HEADINGS = ["references", "bibliography", "参考文献", "引用文献"]
_MASK = ""


def math_like(s: Column) -> Column:
    """LaTeX marks, or at least three operators among mostly other characters than letters."""
    t = F.trim(s)
    latex = t.rlike("\\\\[\\[\\]()]|\\$\\$|\\\\(?:begin|end)\\{") | t.rlike("(?i)\\\\(?:frac|alpha|beta|gamma|delta|epsilon|theta|lambda|mu|nu|pi|rho|sigma|tau|phi|psi|omega)(?![A-Za-z0-9_])")
    tight = F.regexp_replace(t, "[\\s\\p{Z}]+", "")
    letters = F.regexp_count(tight, F.lit("[A-Za-z\\x{4e00}-\\x{9fff}]"))
    signs = F.regexp_count(tight, F.lit("[=<>+\\-*/^_{}\\[\\]\\\\]"))
    return latex | ((F.length(tight) >= 8) & (signs >= 3) & (letters / F.greatest(F.length(tight), F.lit(1)) < 0.55))


def page_number(line: Column) -> Column:
    """A line that is only a page number."""
    return F.lower(F.trim(line)).rlike("^(?:page\\s*)?\\d{1,4}$")


def before_references(page: Column) -> Column:
    """The page up to its references heading; empty if hardly anything stands before it."""
    heads = [F.regexp_instr(page, F.lit(f"(?i)(?:^|\\n)\\s*{h}\\s*\\n")) for h in REFERENCE_HEADINGS]
    at = F.coalesce(*[F.when(h > 0, h) for h in heads])
    head = F.substring(page, F.lit(1), at - 1)
    return F.when(at.isNull(), page).when(F.length(T.normalize_ws(head)) < 40, "").otherwise(head)


def split_ready(s: Column) -> Column:
    """Line ends, control characters, soft hyphens and single line breaks out of the way."""
    t = F.regexp_replace(F.regexp_replace(s, "\\r\\n?", "\n"), "[\\x00-\\x08\\x0b-\\x1f\\x{ad}]", "")
    t = F.regexp_replace(F.regexp_replace(t, "[ \\t\\p{Z}]+", " "), "\\n{3,}", "\n\n")
    return F.trim(F.regexp_replace(F.regexp_replace(t, "(?<!\\n)\\n(?!\\n)", " "), " +", " "))


def citation_sentences(s: Column) -> Column:
    """Sentences by marks alone: . ? ! unless a small letter comes next, in decimals, behind abbreviations and two initials; closing signs stay."""
    words = "|".join(w.replace(".", "[.]") for w in ABBREVIATIONS if "." not in w and " " not in w)
    keep = "[.](?:(?<=\\d[.])(?=\\d)|(?<=(?i:e[.]g|i[.]e|et al)[.])|(?<=(?<![A-Za-z])(?i:" + words + ")[.])|(?<=(?:(?<![\\p{L}\\p{N}_])[A-Z][.]){2,9}))"
    t = F.regexp_replace(split_ready(s), keep, _MASK)
    t = F.regexp_replace(t, "[.?!]++(?![\\s\\p{Z}]*\\p{Ll})[)\\]}\"']*", "$0\ue001")
    parts = F.split(t, "\ue001|\\n{2,}", -1)
    return F.filter(F.transform(parts, lambda x: T.normalize_ws(F.replace(x, F.lit(_MASK), F.lit(".")))), lambda x: x != "")


def sentences(s: Column) -> Column:
    """Sentences for the citation bank: split behind . ! ? and closing marks, unless a small letter follows."""
    known = "|".join(a.replace(".", "[.]") for a in ABBREVIATIONS)
    t = F.regexp_replace(split_ready(s), f"(?i)(?<![\\p{{L}}])({known})[.]", "$1" + _MASK)
    t = F.regexp_replace(t, "(?<![\\p{L}])(\\p{Lu})[.](?=\\s*\\p{Lu})", "$1" + _MASK)
    cut = F.split(t, "(?<=[.!?][)\\]}\"'”’]{0,3})\\s+(?!\\p{Ll})|\\n\\n", -1)
    return F.filter(F.transform(cut, lambda x: F.trim(F.replace(x, F.lit(_MASK), F.lit(".")))), lambda x: x != "")
