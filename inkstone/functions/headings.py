"""Headings: what looks like one, its prefix, level and canonical class, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkstone.functions import prose

#: Names of sections.
SECTIONS_EN = [
    "abstract", "introduction", "background", "motivation", "related work", "literature review", "data", "method", "methods", "methodology", "empirical strategy", "model", "results", "discussion",
    "conclusion", "conclusions", "references", "acknowledgements", "acknowledgments", "appendix", "appendices", "keywords", "jel classification",
]
SECTIONS_ZH = "摘要 中文摘要 英文摘要 引言 前言 绪论 结论 总结 参考文献 附录 致谢 关键词 文献综述 相关工作 研究背景 研究设计 研究方法 方法 模型 数据 样本 变量 结果 讨论 实证结果".split()
#: Words that may be small in a title, openings of sentences, and verbs that no title has.
SMALL_WORDS = "a an the and or of to in on for with via vs".split()
OPENINGS = "we i this that these those it".split()
VERBS = "is are was were be been being has have had do does did can could will would may might should must".split()
AUXILIARIES = "is are was were has have had".split()

_N = "一二三四五六七八九十"
_WORD_END = "(?![\\p{L}\\p{N}_])"
_SPACE = "[\\s\\p{Z}]"


def _strip(s: Column) -> Column:
    return F.regexp_replace(s, f"^{_SPACE}+|{_SPACE}+$", "")


def strip_prefix(s: Column) -> Column:
    """A heading without its marks, bullet or number."""
    t = _strip(s)
    for pattern in ("^#{1,6}\\s*", "^\\s*[-•]\\s*", "^\\s*\\d+(?:\\.\\d+){0,4}[.)]?\\s+", f"^\\s*[{_N}]+[、.．)]\\s*", f"^\\s*[（(][{_N}]+[)）]\\s*", f"^\\s*第[{_N}0-9]+[章节篇]\\s*"):
        t = F.regexp_replace(t, pattern, "")
    return _strip(t)


def _base(s: Column) -> Column:
    """The heading's words: no prefix, no colon, no marks at the end, single blanks."""
    t = F.regexp_replace(strip_prefix(s), f"{_SPACE}+", " ")
    return _strip(F.regexp_replace(F.regexp_replace(t, "[:：]+$", ""), f"{_SPACE}*[。！？；.!?]+$", ""))


def _with_word(s: Column, words: list[str]) -> Column:
    return s.rlike(f"(?<![\\p{{L}}\\p{{N}}_])(?:{'|'.join(words)}){_WORD_END}")


def heading_like(text: Column, language: Column) -> Column:
    """Whether a line or sentence is a heading, list item, caption or formula rather than prose; ``language``: en, zh or mixed."""
    s = _strip(text)
    marks = s.rlike("^#{1,6}\\s+\\S|^[*_]{2,}\\s*\\S|^[-•]\\s+\\S|^\\d+[.)]\\s+\\S")
    colon = s.rlike("[:：]$") & (F.length(s) <= 120)
    caption = s.rlike(f"(?i)^(?:table|figure|appendix|section|chapter)\\s*[:：]?\\s*\\d+{_WORD_END}")
    numbered = s.rlike("^\\d+(?:\\.\\d+){0,4}\\s+\\S") & ~s.rlike("[.!?。！？；;]$")
    base = _base(s)
    named_zh = base.isin(*SECTIONS_ZH) | (base.rlike("^(?:" + "|".join(SECTIONS_ZH) + ")") & (F.length(base) <= 12))
    zh = s.rlike(f"^(?:表|图)\\s*\\d+{_WORD_END}|^[{_N}]+[、.．)]\\s*\\S|^[（(][{_N}]+[)）]\\s*\\S") | named_zh
    low = F.lower(base)
    words = F.regexp_extract_all(base, F.lit("[A-Za-z]+"), 0)
    count = F.size(words)
    letters = F.length(F.regexp_replace(base, "[^\\p{L}]", ""))
    capitals = F.length(F.regexp_replace(base, "[^\\p{Lu}]", ""))
    titled = F.size(F.filter(words, lambda w: w.rlike("^[A-Z]") | F.lower(w).isin(*SMALL_WORDS)))
    loud = (letters > 0) & (capitals >= 0.85 * letters)
    title = (titled >= 0.85 * count) & ~_with_word(low, VERBS)
    phrase = count.between(1, 10) & (F.length(base) <= 80) & ~s.rlike("[.!?]$") & ~F.lower(F.get(words, 0)).isin(*OPENINGS) & (loud | title)
    prefixed = low.rlike("^(?:" + "|".join(SECTIONS_EN) + ") ") & (count <= 10) & ~_with_word(low, AUXILIARIES)
    en = low.isin(*SECTIONS_EN) | phrase | prefixed
    common = prose.math_like(s) | marks | colon | caption | numbered
    return F.coalesce((s != "") & (common | (language.isin("zh", "mixed") & zh) | (language.isin("en", "mixed") & en)), F.lit(False))


def level(text: Column, language: Column) -> Column:
    """Dots of the number and one, at most 6; 2 for a Chinese number in brackets; else 1."""
    s = _strip(text)
    number = F.regexp_extract(s, f"^(\\d+(?:\\.\\d+){{0,6}}){_WORD_END}", 1)
    dots = F.length(number) - F.length(F.replace(number, F.lit("."), F.lit("")))
    return F.when(number != "", F.least(F.lit(6), dots + 1)).when(language.isin("zh", "mixed") & s.rlike(f"^[（(][{_N}]+[)）]"), 2).otherwise(1).cast("int")


#: Classes of headings in their order, and the words that mean them (the whole, the beginning, anywhere).
CLASSES_ZH = [
    ("abstract", "^(?:摘要|中文摘要|英文摘要)$"), ("introduction", "^(?:引言|前言|绪论)"), ("related_work", "文献综述|相关工作"), ("data", "数据|样本|变量"), ("methods", "方法|研究设计|研究方法|模型"),
    ("results", "结果|讨论|实证结果"), ("conclusion", "^(?:结论|总结)"), ("references", "^(?:参考文献|引用文献|文献)"), ("appendix", "^附录"), ("acknowledgements", "^致谢"),
]
CLASSES_EN = [
    ("abstract", "^abstract(?: |$)"), ("introduction", "^intro|introduction"), ("related_work", "related work|literature review|^literature(?: |$)"), ("data", "(?:^|[^\\p{L}\\p{N}_])data(?:[^\\p{L}\\p{N}_]|$)|sample"),
    ("methods", "method|methodology|empirical strategy|identification|model|specification"), ("results", "result|discussion|empirical|findings"), ("robustness", "robust|additional tests"),
    ("conclusion", "conclu|^summary"), ("references", "^reference|^bibliograph|^literature cited"), ("appendix", "^appendix"), ("acknowledgements", "^acknowledg"),
]
#: The class of captions; in the compatible reading it never occurs.
CAPTION = "(?i)^(?:table|figure|fig\\.|eq\\.|equation)(?:[^\\p{L}\\p{N}_]|$)"


def canonical(text: Column, language: Column, strict_compat: bool = True) -> Column:
    """The class of a heading; one with Chinese characters is judged by these alone."""
    base = _base(text)
    zh = F.coalesce(*[F.when(base.rlike(p), F.lit(n)) for n, p in CLASSES_ZH], F.lit("other"))
    low = F.lower(base)
    en = [F.when(low.rlike(p), F.lit(n)) for n, p in CLASSES_EN]
    en += [] if strict_compat else [F.when(_strip(text).rlike(CAPTION), F.lit("figure_table"))]
    return F.when(language.isin("zh", "mixed") & base.rlike("[\\x{4e00}-\\x{9fff}]"), zh).otherwise(F.coalesce(*en, F.lit("other")))
