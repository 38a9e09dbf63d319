"""Sentences with their positions, soft line breaks, paragraphs and blocks of a page.

What a line is (heading, list item, blank) is told by native expressions; the split itself
needs what stands before and behind a mark and runs row by row in Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstone.functions import headings, prose
from inkstone.functions import text as T

#: Marks that end a sentence, by language, and abbreviations behind which it may go on.
ENDERS = {"en": ".!?", "zh": "。！？；", "mixed": ".!?。！？；"}
ABBREVIATIONS = frozenset("e.g i.e etc vs mr ms mrs dr prof fig eq eqs sec chap no al jr sr u.s u.k".split())

_N = "一二三四五六七八九十"
_LIST_LINE = f"^(?:[-•]\\s+|#{{1,6}}\\s+|\\d+[.)]\\s+|\\d+(?:\\.\\d+){{0,4}}\\s+\\S|[{_N}]+[、.．)]\\s+\\S|[（(][{_N}]+[)）]\\s*\\S)"
_WHOLE_LINE = "^(?:[-•]\\s+|#{1,6}\\s+|\\d+[.)]\\s+|\\d+(?:\\.\\d+){0,4}\\s+\\S|[A-Za-z][.)]\\s+|[IVXLCDM]+[.)]\\s+|\\\\\\[|\\\\\\(|\\\\begin\\{|\\$\\$)"
_NUMBER = re.compile(r"[\s#*_>\-]*\d+(?:\.\d+){0,4}\.\s*")
_LAST_WORD = re.compile(r"([a-z](?:\.[a-z]){1,3}|[a-z]+)\s*$")
_AHEAD = re.compile(r"\s*(?:[\"'“”‘’(\[{（【]\s*)*(.?)", re.S)


def _trim(s: Column) -> Column:
    return F.regexp_replace(s, "^[\\s\\p{Z}]+|[\\s\\p{Z}]+$", "")


def join_soft_breaks(text: Column) -> Column:
    """Line breaks inside a paragraph as blanks, of the same length; those at blank lines, headings and lists stay."""
    lines = F.split(text, "\n", -1)

    def stays(x: Column) -> Column:
        s = _trim(x)
        return (s == "") | F.ltrim(x).rlike(_LIST_LINE) | ((F.length(s) <= 80) & headings.heading_like(s, F.lit("mixed")))

    firm = F.transform(lines, stays)
    n = F.size(lines)
    joined = F.transform(lines, lambda x, i: F.concat(x, F.when(i == n - 1, "").when(F.get(firm, i) | F.get(firm, i + 1), "\n").otherwise(" ")))
    return F.when(F.contains(text, F.lit("\n")), F.array_join(joined, "")).otherwise(F.coalesce(text, F.lit("")))


def _ahead(text: str, at: int) -> str:
    """The next character that is no white space, opening quotation or bracket."""
    return _AHEAD.match(text, at).group(1)


def _goes_on(text: str, line: int, dot: int, end: int) -> bool:
    """Whether a sentence goes on behind the dots from ``dot`` to ``end``; ``line``: where their line begins."""
    if end < len(text) and (text[end].isalpha() or dot and text[dot - 1].isdigit() and text[end].isdigit()):
        return True
    then = _ahead(text, end)
    if then.islower() or then and _NUMBER.fullmatch(text, line, dot + 1):
        return True
    word = _LAST_WORD.search(text[max(0, dot - 32) : dot].lower())
    return bool(word) and word.group(1) in ABBREVIATIONS and (not then or then in "([{（【,;:)]}」』”’" or then.isdigit())


def spans(text: str, language: str, head: list[bool], firm: list[bool]) -> list[tuple[int, int]]:
    """Begin and end of each sentence; ``head`` and ``firm``: of each line, whether it is a heading or may not be cut inside."""
    language = language if language in ENDERS else "mixed"
    out: list[tuple[int, int]] = []

    def add(a: int, b: int) -> None:
        part = text[a:b]
        if part.strip():
            out.append((a + len(part) - len(part.lstrip()), b - len(part) + len(part.rstrip())))

    start = line = line_at = 0
    for m in re.finditer(f"\n+|[{ENDERS[language]}]+", text):
        run = m.group()
        if run[0] == "\n":
            here = text[line_at : m.start()].strip()
            then = text[m.end() :].split("\n", 1)[0].strip() if len(run) == 1 else ""
            if len(run) > 1 or not here or not then or head[line] or head[line + 1]:
                add(start, m.start())
                start = m.end()
            line, line_at = line + len(run), m.end()
        elif not firm[line]:
            if language != "zh" and not run.strip(".") and _goes_on(text, line_at, m.start(), m.end()):
                continue
            add(start, m.end())
            start = m.end()
    add(start, len(text))
    return out


_SENTENCES = "array<struct<text:string,start:int,end:int>>"


def with_sentences(df: DataFrame, text: str, language: Column, out: str = "sentences") -> DataFrame:
    """Adds ``out``: the sentences of a text with begin and end (from 0, end behind); null and empty texts have none."""
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)
    head = F.transform(lines, lambda x: headings.heading_like(x, F.lit("mixed")))
    firm = F.transform(lines, lambda x: (_trim(x) != "") & (F.ltrim(x).rlike(_WHOLE_LINE) | prose.math_like(_trim(x))))
    kept = df.columns
    ready = df.select(*kept, F.coalesce(F.col(text), F.lit("")).alias("_segment_t"), language.alias("_segment_l"), head.alias("_segment_h"), firm.alias("_segment_f"))
    kind = pa.list_(pa.struct([("text", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = len(kept)
            rows = [[{"text": t[a:e], "start": a, "end": e} for a, e in spans(t, lang or "en", h, f)] for t, lang, h, f in zip(*(c.to_pylist() for c in b.columns[n:]))]
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(rows, kind)], [*kept, out])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return ready.mapInArrow(run, f"{fields}, `{out}` {_SENTENCES}")


def paragraphs(text: Column) -> Column:
    """Paragraphs between blank lines, with single blanks; empty ones left out."""
    raw = F.regexp_replace(F.coalesce(text, F.lit("")), "\\r\\n?", "\n")
    return F.filter(F.transform(F.split(raw, "\\n[\\s\\p{Z}]*\\n+", -1), T.normalize_ws), lambda p: p != "")


def blocks(pages: DataFrame, keys: list[str], text: str, language: Column, most: int = 140) -> DataFrame:
    """``(*keys, block, type, text)``: the headings and paragraphs of a page in order; a blank line or a heading ends a paragraph."""
    raw = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "\\r\\n?", "\n")
    kind = lambda x: F.when(_trim(x) == "", "b").when((F.length(_trim(x)) <= most) & headings.heading_like(x, F.col("_segment_l")), "h").otherwise("p")
    rows = pages.select(*keys, language.alias("_segment_l"), raw.alias("_segment_t"))
    lines = rows.select(*keys, F.transform(F.split("_segment_t", "\n", -1), lambda x: F.struct(kind(x).alias("k"), _trim(x).alias("s"))).alias("_segment_x"))

    def step(acc: Column, x: Column) -> Column:
        # a line of a paragraph goes on with the one before it; anything else begins anew
        grown = F.concat(acc["done"], F.array(F.struct(acc["k"].alias("k"), acc["s"].alias("s"))))
        on = (x["k"] == "p") & (acc["k"] == "p")
        return F.struct(
            F.when(on, acc["done"]).otherwise(grown).alias("done"), x["k"].alias("k"), F.when(on, F.concat_ws(" ", acc["s"], x["s"])).otherwise(x["s"]).alias("s"))

    none = F.array().cast("array<struct<k:string,s:string>>")
    begin = F.struct(none.alias("done"), F.lit("b").alias("k"), F.lit("").alias("s"))
    found = F.aggregate("_segment_x", begin, step, lambda acc: F.concat(acc["done"], F.array(F.struct(acc["k"].alias("k"), acc["s"].alias("s")))))
    full = F.filter(F.transform(found, lambda b: F.struct(b["k"].alias("k"), T.normalize_ws(b["s"]).alias("s"))), lambda b: (b["k"] != "b") & (b["s"] != ""))
    out = lines.select(*keys, F.posexplode(full).alias("block", "_segment_b"))
    return out.select(*keys, "block", F.when(F.col("_segment_b.k") == "h", "heading").otherwise("paragraph").alias("type"), F.col("_segment_b.s").alias("text"))
