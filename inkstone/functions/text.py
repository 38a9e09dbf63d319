"""Text functions as native column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkstone.functions.lexicon import STOP_WORDS

HAN = "[\\x{4e00}-\\x{9fff}]"


def normalize_ws(s: Column) -> Column:
    """Runs of Unicode white space as one blank, trimmed; null as empty."""
    return F.trim(F.regexp_replace(F.coalesce(s, F.lit("")), "[\\s\\p{Z}]+", " "))


def ascii_words(s: Column) -> Column:
    """Lower-case words of letters a-z only (a word with any other letter or digit counts as none)."""
    return F.filter(F.regexp_extract_all(F.lower(s), F.lit("[\\p{L}\\p{N}_]+"), 0), lambda w: w.rlike("^[a-z]+$"))


def words(s: Column) -> Column:
    """Vocabulary words: at least three letters and no function word."""
    stop = F.array(*[F.lit(w) for w in sorted(set(STOP_WORDS))])
    return F.filter(ascii_words(s), lambda w: (F.length(w) >= 3) & ~F.array_contains(stop, w))


def bigrams(tokens: Column) -> Column:
    """Adjacent pairs, joined by a blank."""
    return F.zip_with(F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(0))), F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))


def han_count(s: Column) -> Column:
    return F.regexp_count(s, F.lit(HAN))


def latin_count(s: Column) -> Column:
    return F.regexp_count(s, F.lit("[a-zA-Z]"))


def language(s: Column) -> Column:
    """``zh`` above 70 % Han of all Han and Latin letters, ``mixed`` above 30 %, else ``en``."""
    zh, en = han_count(s), latin_count(s)
    share = zh / F.nullif(zh + en, F.lit(0))
    return F.when(share > 0.7, "zh").when(share > 0.3, "mixed").otherwise("en")


def sentence_language(s: Column, fallback: str = "en") -> Column:
    """By presence: ``mixed`` with Han and Latin letters, else the one that is there."""
    zh, en = s.rlike("[\\x{4e00}-\\x{9fff}]"), s.rlike("[A-Za-z]")
    return F.when(zh & en, "mixed").when(zh, "zh").when(en, "en").otherwise(fallback)


def token_language(token: Column) -> Column:
    return F.when(token.rlike("[\\x{4e00}-\\x{9fff}]"), "zh").otherwise("en")


def primary_language(s: Column) -> Column:
    """The one language of a text: a mixed one is Chinese if it has at least as many Han as Latin letters."""
    lang = language(s)
    return F.when(lang != "mixed", lang).when(han_count(s) >= latin_count(s), "zh").otherwise("en")


#: Chinese function words that are no vocabulary.
STOP_WORDS_ZH = "的 了 和 与 及 或 而 但 并 且 及其 以及 等 是 为 在 对 于 将 被 把 从 到 由 与其 其 该 本 此 这些 那些 一个 一种 一些 我们 你们 他们 她们 它们 可以 可能 需要 通过 进行 实现 包括 主要 本文".split()


def han_tokens(s: Column, segment: Callable[[Column], Column] | None = None) -> Column:
    """Chinese tokens of Han characters only; ``segment`` cuts words (a column function), without one each character is a token."""
    return F.regexp_extract_all(s, F.lit(HAN), 0) if segment is None else F.filter(segment(s), lambda w: w.rlike(f"^{HAN}+$"))


def han_words(s: Column, segment: Callable[[Column], Column] | None = None) -> Column:
    """Chinese vocabulary words: at least two characters and no function word (so none without a segmenter)."""
    return F.filter(han_tokens(s, segment), lambda w: (F.length(w) >= 2) & ~w.isin(*STOP_WORDS_ZH))


def streams(s: Column, lang: Column, segment: Callable[[Column], Column] | None = None) -> Column:
    """The token streams of a text by language, as a map; a mixed text has both."""
    en, zh = F.create_map(F.lit("en"), ascii_words(s)), F.create_map(F.lit("zh"), han_tokens(s, segment))
    return F.when(lang == "en", en).when(lang == "zh", zh).otherwise(F.map_concat(en, zh))


def pieces(s: Column) -> Column:
    """A text cut into runs of Han, Latin letters, white space and single other characters, nothing lost."""
    return F.regexp_extract_all(s, F.lit("[\\x{4e00}-\\x{9fff}]+|[a-zA-Z]+|[\\s\\p{Z}]+|[^\\s\\p{Z}]"), 0)


def rough_tokens(s: Column) -> Column:
    """Words, numbers, single Han characters and single other signs."""
    return F.regexp_extract_all(s, F.lit("[A-Za-z]+|\\d+(?:\\.\\d+)?|[\\x{4e00}-\\x{9fff}]|[^\\s\\p{Z}]"), 0)


def approx_tokens(s: Column) -> Column:
    """At least 1: one token per Han character and one per four others, truncated."""
    zh = han_count(s)
    return F.greatest(F.lit(1), F.floor(zh + (F.length(s) - zh) / 4.0)).cast("bigint")


def stable_key(prefix: str, page: Column, s: Column, extra: Column) -> Column:
    """A key of a text that survives re-extraction: short prefix and a hash of page, text and extra."""
    raw = F.concat_ws("|", F.coalesce(page, F.lit(0)).cast("string"), F.substring(normalize_ws(s), 1, 1200), F.substring(F.coalesce(extra, F.lit("")), 1, 200))
    return F.concat(F.lit(prefix[:6] + "_"), F.substring(F.sha1(F.btrim(raw, F.lit("|"))), 1, 16))


def unbalanced(s: Column) -> Column:
    """The first kind of bracket whose opening and closing counts differ, else null."""
    pairs = ["()", "（）", "[]", "{}", "《》", "“”", "「」", "『』"]  # fixed values, in this order

    def count(c: str) -> Column:
        return F.length(s) - F.length(F.replace(s, F.lit(c), F.lit("")))

    return F.coalesce(*[F.when(count(p[0]) != count(p[1]), F.lit(p)) for p in pairs])


def heading_level(s: Column) -> Column:
    """Level of a numbered heading: dots + 1, at most 6; Chinese numbering 1 or 2; else 1."""
    number = F.regexp_extract(s, "^\\s*(\\d+(?:\\.\\d+){0,6})(?![\\d\\p{L}_])", 1)
    by_number = F.least(F.lit(6), F.length(number) - F.length(F.replace(number, F.lit("."), F.lit(""))) + 1)
    return F.when(number != "", by_number).when(s.rlike("^\\s*[（(][一二三四五六七八九十]+[)）]"), 2).otherwise(1).cast("int")


def reference_title(s: Column) -> Column:
    """The first long quoted span, else what follows the first year up to a full stop, else the beginning."""
    t = normalize_ws(s)
    quoted = F.regexp_extract(t, "[\"“]([^\"”]{20,})[\"”]", 1)
    after = F.regexp_extract(t, "\\d{4}\\)?[.,]?\\s*(.*)$", 1)
    clause = F.trim(F.regexp_extract(after, "^([^.]+)", 1))
    year = t.rlike("\\d{4}")
    return F.when(quoted != "", F.substring(quoted, 1, 200)).when(year & (F.length(clause) >= 12), F.substring(clause, 1, 200)).when(year, F.substring(after, 1, 150)).otherwise(F.substring(t, 1, 120))


def years(s: Column) -> Column:
    """Distinct years 18xx-20xx with an optional letter, in order."""
    return F.array_distinct(F.regexp_extract_all(s, F.lit("(?<![\\p{L}\\p{N}_])((?:18|19|20)[0-9]{2}[a-zA-Z]?)(?![\\p{L}\\p{N}_])"), 1))


def surnames(authors: Column) -> Column:
    """Lower-case family names of an author list joined by ``;``, ``and`` or ``&``."""
    parts = F.split(F.regexp_replace(authors, "(?i)\\s+(?:et\\s+al\\.?|等人?)(?=\\s*(?:$|[&;]|\\s+and\\s))", ""), "\\s+and\\s+|\\s*[&;]\\s*")

    def family(p: Column) -> Column:
        q = F.trim(p)
        return F.lower(F.when(q.contains(","), F.trim(F.split_part(q, F.lit(","), F.lit(1)))).otherwise(F.regexp_extract(q, "(\\S+)$", 1)))

    return F.array_distinct(F.filter(F.transform(parts, family), lambda w: w != ""))
