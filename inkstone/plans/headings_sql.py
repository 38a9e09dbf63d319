"""The tests of headings in SQL, written from their rules (without look-around, which DuckDB lacks)."""

from __future__ import annotations

from inkstone.functions import headings

_N = "一二三四五六七八九十"
_END = r"([^\p{L}\p{N}_]|$)"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _strip(c: str) -> str:
    return rf"regexp_replace({c}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


def base(c: str) -> str:
    """The words of a heading: prefixes, colon and marks taken off one after the other."""
    t = _strip(c)
    for p in (r"^#{1,6}\s*", r"^\s*[-•]\s*", r"^\s*\d+(\.\d+){0,4}[.)]?\s+", rf"^\s*[{_N}]+[、.．)]\s*", rf"^\s*[（(][{_N}]+[)）]\s*", rf"^\s*第[{_N}0-9]+[章节篇]\s*"):
        t = f"regexp_replace({t}, {_q(p)}, '')"
    t = rf"regexp_replace({_strip(t)}, '[\s\p{{Z}}]+', ' ', 'g')"
    return _strip(rf"regexp_replace(regexp_replace({t}, '[:：]+$', ''), '[\s\p{{Z}}]*[。！？；.!?]+$', '')")


def _word(c: str, words: list[str]) -> str:
    return rf"regexp_matches({c}, '(^|[^\p{{L}}\p{{N}}_])({'|'.join(words)}){_END}')"


def like(c: str, language: str = "en") -> str:
    """A condition: whether a text is heading-like, for en, zh or mixed."""
    s = f"({_strip(c)})"
    b = f"({base(c)})"
    low = f"lower({b})"
    compact = rf"regexp_replace({s}, '[\s\p{{Z}}]+', '', 'g')"
    math = (
        rf"regexp_matches({s}, '\\[\[\]()]|\$\$|\\(begin|end)\{{') OR regexp_matches({s}, '(?i)\\(frac|alpha|beta|gamma|delta|epsilon|theta|lambda|mu|nu|pi|rho|sigma|tau|phi|psi|omega)([^A-Za-z0-9_]|$)')"
        rf" OR (length({compact}) >= 8 AND len(regexp_extract_all({compact}, '[=<>+\-*/^_{{}}\[\]\\]')) >= 3 AND len(regexp_extract_all({compact}, '[A-Za-z\x{{4e00}}-\x{{9fff}}]')) / length({compact}) < 0.55)"
    )
    common = [
        math,
        rf"regexp_matches({s}, '^#{{1,6}}\s+\S|^[*_]{{2,}}\s*\S|^[-•]\s+\S|^\d+[.)]\s+\S')",
        f"(regexp_matches({s}, '[:：]$') AND length({s}) <= 120)",
        rf"regexp_matches({s}, '(?i)^(table|figure|appendix|section|chapter)\s*[:：]?\s*\d+{_END}')",
        rf"(regexp_matches({s}, '^\d+(\.\d+){{0,4}}\s+\S') AND NOT regexp_matches({s}, '[.!?。！？；;]$'))",
    ]
    if language != "en":
        common.append(rf"regexp_matches({s}, '^(表|图)\s*\d+{_END}|^[{_N}]+[、.．)]\s*\S|^[（(][{_N}]+[)）]\s*\S')")
        common.append(f"{b} IN ({','.join(map(_q, headings.SECTIONS_ZH))}) OR (length({b}) <= 12 AND regexp_matches({b}, '^({'|'.join(headings.SECTIONS_ZH)})'))")
    if language != "zh":
        words = f"regexp_extract_all({b}, '[A-Za-z]+')"
        small = ",".join(map(_q, headings.SMALL_WORDS))
        loud = rf"(len(regexp_extract_all({b}, '\p{{L}}')) > 0 AND len(regexp_extract_all({b}, '\p{{Lu}}')) >= 0.85 * len(regexp_extract_all({b}, '\p{{L}}')))"
        title = f"(len(list_filter({words}, lambda zw: regexp_matches(zw, '^[A-Z]') OR lower(zw) IN ({small}))) >= 0.85 * len({words}) AND NOT {_word(low, headings.VERBS)})"
        common.append(f"{low} IN ({','.join(map(_q, headings.SECTIONS_EN))})")
        common.append(f"(len({words}) BETWEEN 1 AND 10 AND length({b}) <= 80 AND NOT regexp_matches({s}, '[.!?]$') AND lower({words}[1]) NOT IN ({','.join(map(_q, headings.OPENINGS))}) AND ({loud} OR {title}))")
        common.append(f"(regexp_matches({low}, '^({'|'.join(headings.SECTIONS_EN)}) ') AND len({words}) <= 10 AND NOT {_word(low, headings.AUXILIARIES)})")
    return f"{s} <> '' AND (" + " OR ".join(f"({x})" for x in common) + ")"


def canonical(c: str) -> str:
    """The class of a heading of any language."""
    b = f"({base(c)})"
    case = lambda col, rules: "CASE " + " ".join(f"WHEN regexp_matches({col}, {_q(p)}) THEN {_q(n)}" for n, p in rules) + " ELSE 'other' END"
    return rf"CASE WHEN regexp_matches({b}, '[\x{{4e00}}-\x{{9fff}}]') THEN {case(b, headings.CLASSES_ZH)} ELSE {case(f'lower({b})', headings.CLASSES_EN)} END"
