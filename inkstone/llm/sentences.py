"""Sentence units of texts in many languages and scripts (problem 5), in SQL expressions only.

A copy of the text is masked: marks that end no sentence (in decimals, versions, URLs,
initials, abbreviations, brackets, and in quotations before their last mark) become
private-use placeholders, one for one, so that positions stay what they are.  A boundary
mark is then put behind each terminator that the rules of its script accept, the text is
split there, and the sentence texts are taken from the text as stored.

Defined results: a null, empty or blank text has no sentences; a text without any mark is
one sentence; private-use characters of the text itself end nothing and stay as they are;
ties cannot occur; a record delivered twice counts once; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The placeholder of a masked mark, and the boundary mark.
_MASK = "\ue000"
_CUT = "\ue00f"
_MARKS = ".!?。！？．"
#: Terminators of further scripts (Devanagari, Urdu, Arabic, Armenian, Ethiopic, Khmer, Burmese).
_OTHER_MARKS = "।॥۔؟։።፧។៕။"
_DOT = f"[.{_MASK}]"

#: Abbreviations behind which a sentence goes on, whatever follows (lower case, without the
#: final dot; a blank stands for any white space, a dot for an inner dot).
NEVER_END = (
    # English
    "dr", "prof", "mr", "mrs", "ms", "st", "vs", "cf", "e.g", "i.e", "viz", "approx", "fig", "figs", "tab", "sec", "eq", "ch", "vol", "vols", "no", "nos", "pp", "ed", "eds", "inst", "soc", "off", "cncl", "ctr", "dept", "univ",
    # German
    "nr", "abb", "tab", "vgl", "bzw", "ca", "bd", "hrsg", "kap", "z.b", "d.h", "u.a",
    # French, Spanish, Portuguese
    "env", "ex", "ej", "núm", "pág", "págs", "cap", "aprox", "sr", "sra", "dra", "art", "mm", "mme", "c.-à-d",
    # Russian
    "т.е", "т.к", "напр", "рис", "табл", "гл", "стр", "см", "ср", "проф", "акад", "им",
)

_CLOSE = "[\"'”’»」』)\\]）】]"
_BLANK = "[\\s\\p{Z}]"
#: White space that does not belong to a sentence.
_WHITE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def _abbreviations() -> str:
    forms = [f for a in NEVER_END for f in (a, a.capitalize())]
    forms = [_DOT.join(p.replace("-", "\\-") for p in a.split(".")) for a in dict.fromkeys(forms)]
    return "|".join(sorted(forms, key=len, reverse=True))


def _masked(df: DataFrame, text: Column) -> DataFrame:
    """Add ``_t``: the text with the marks that end no sentence masked; same length.

    Each step is its own projection, so that no expression is computed twice.
    """
    foreign = F.contains(text, F.lit(_MASK)) | F.contains(text, F.lit(_CUT))
    df = df.withColumn("_t", F.when(foreign, F.translate(text, _MASK + _CUT, "\ufffd\ufffd")).otherwise(text))
    # URLs, domains, decimals, versions, inner dots of abbreviations; dots before digits
    between = "[.!?](?<=[\\p{Lu}\\p{Ll}\\p{N}/=&_-].)(?=[\\p{Ll}\\p{N}/=&_])|[.．](?=\\p{N})"
    # initials and other single letters, unless they end something like "U.S."
    initial = "[.](?<=(?<![\\p{Lu}\\p{Ll}\\p{N}.])[\\p{Lu}\\p{Ll}][.])(?!\\s*$)"
    # "et al." goes on unless a capital or a quotation follows
    others = "[.](?<=\\b[Aa][Ll][.])(?!\\s+[\\p{Lu}\"“«])"
    known = f"[.](?<=(?<![\\p{{Lu}}\\p{{Ll}}\\p{{N}}])(?i:{_abbreviations()})[.])"
    df = df.withColumn("_t", F.regexp_replace("_t", f"{between}|{initial}|{others}", _MASK))
    df = df.withColumn("_t", F.regexp_replace("_t", known, _MASK))
    # quotations and brackets: all marks but one directly before the closing sign
    shown = _MARKS + _OTHER_MARKS

    def inner(x: Column) -> Column:
        return F.concat(F.translate(F.substring(x, F.lit(1), F.length(x) - 1), shown, _MASK * len(shown)), F.substring(x, F.length(x), F.lit(1)))

    def hide(open_: str, close: str) -> Column:
        parts = F.regexp_extract_all("_t", F.lit(f"[{open_}][^{open_}{close}]++[{close}]|[^{open_}]++|[{open_}]"), 0)
        whole = lambda x: x.rlike(f"^[{open_}][^{open_}{close}]++[{close}]$")
        hidden = F.transform(parts, lambda x: F.when(whole(x), F.concat(inner(F.substring(x, F.lit(1), F.length(x) - 1)), F.substring(x, F.length(x), F.lit(1)))).otherwise(x))
        return F.when(F.col("_t").rlike(f"[{open_}]"), F.array_join(hidden, "")).otherwise(F.col("_t"))

    df = df.withColumn("_t", F.when(F.contains("_t", F.lit("„")), F.regexp_replace("_t", "„([^“”„\"«»]++)“", "«$1»")).otherwise(F.col("_t")))
    # straight quotes go in pairs; where their number is odd, those behind a figure are inches, and a last one alone opens nothing
    count = F.length("_t") - F.length(F.replace(F.col("_t"), F.lit('"'), F.lit("")))
    df = df.withColumn("_t", F.when(count % 2 == 1, F.regexp_replace("_t", "(?<=\\p{N})\"", "\ufffd")).otherwise(F.col("_t")))
    count = F.length("_t") - F.length(F.replace(F.col("_t"), F.lit('"'), F.lit("")))
    paired = F.transform(F.split("_t", '"', -1), lambda x, i: F.when((i % 2 == 1) & (i < count), inner(x)).otherwise(x))
    df = df.withColumn("_t", F.when(count > 1, F.array_join(paired, '"')).otherwise(F.col("_t")))
    df = df.withColumn("_t", hide("“«「『", "”»」』"))
    return df.withColumn("_t", hide("(（", ")）"))


def _cut(df: DataFrame) -> DataFrame:
    """Put the boundary mark behind each terminator that ends a sentence; ``_p``: the pieces."""
    start = "[\"'“‘«„¿¡「『]*(?:[\\p{Lu}\\p{Lt}\\p{Lo}]|[a-z]-values)"
    western = f"[.!?…]+(?:{_CLOSE}*+(?={_BLANK}+{start}|\\p{{Lu}}\\p{{Ll}}|[¿¡])|(?=\\p{{Lo}}))"
    eastern = f"(?:[。！？．｡{_OTHER_MARKS}]+|…{{2,}})(?:(?!{_CLOSE})|{_CLOSE}++(?={_BLANK}*$|{_BLANK}+[^\\p{{Ll}}\\s]))"
    df = df.withColumn("_t", F.regexp_replace("_t", f"(?=[.!?…。！？．｡{_OTHER_MARKS}])(?:{eastern}|{western})", "$0" + _CUT))
    df = df.withColumn("_t", F.regexp_replace("_t", "\\n[ \\t\\r]*\\n", _CUT + "$0"))
    return df.withColumn("_p", F.split("_t", _CUT, -1)).drop("_t")


def sentence_spans(df: DataFrame, text: str, out: str = "spans") -> DataFrame:
    """Add ``out array<struct<start int, end int>>``: first and last position (from 1) of each sentence."""
    none = F.array().cast("array<struct<start:int,end:int>>")

    white = F.lit(_WHITE)

    def step(acc: Column, x: Column) -> Column:
        lead = F.length(x) - F.length(F.ltrim(x, white))
        tail = F.length(F.rtrim(x, white))
        span = F.struct((acc["at"] + lead + 1).cast("int").alias("start"), (acc["at"] + tail).cast("int").alias("end"))
        return F.struct((acc["at"] + F.length(x)).alias("at"), F.when(tail > 0, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    df = _cut(_masked(df, F.col(text)))
    spans = F.aggregate("_p", F.struct(F.lit(0).alias("at"), none.alias("spans")), step, lambda acc: acc["spans"])
    return df.withColumn(out, F.coalesce(spans, none)).drop("_p")


def split_sentences(records: DataFrame, key: str, text: str) -> DataFrame:
    """``(rec_id, sent_no, start_pos, end_pos)`` of each record, a record once however often it came.

    The spans are made row by row, before the shuffle, so only numbers are moved.
    """
    spans = sentence_spans(records.select(F.col(key).alias("rec_id"), F.col(text).alias("_x")), "_x").select("rec_id", "spans")
    # no filter here: it would be pushed through the projections and repeat all their work
    once = spans.groupBy("rec_id").agg(F.first("spans").alias("spans"))
    return once.select("rec_id", F.posexplode("spans").alias("i", "s")).select("rec_id", (F.col("i") + 1).alias("sent_no"), F.col("s.start").alias("start_pos"), F.col("s.end").alias("end_pos"))


def with_sentences(df: DataFrame, text: str, out: str = "sentences") -> DataFrame:
    """Add the sentences of a text as stored, as an array of strings."""
    df = sentence_spans(df, text, "_spans")
    return df.withColumn(out, F.transform("_spans", lambda s: F.substring(F.col(text), s["start"], s["end"] - s["start"] + 1))).drop("_spans")
