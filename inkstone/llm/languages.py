"""The language of texts, and of the segments of mixed texts, with a confidence (problem 3).

Compression classification: each language has a zstandard dictionary of raw content made of
sentences in it.  A piece of text is compressed with the dictionary of every language that is
written in its script and without any; the smallest result names the language.  Where the
second smallest is too near, the piece is rejected and goes with its neighbour.  Where a
script has one language only, its dictionary has to save a share of the size without any
(measured against what its own sentences save) and to have nearly all letters of the piece,
else the piece is in another language and rejected.  Pieces are whole sentences and quotations; citations in brackets are left out.
Neighbouring pieces of one language are one segment; a text with segments in more than one
language is ``mixed``.  A text whose pieces are all too short is judged as a whole, however
short, with the confidence that its margin gives.

The dictionaries are fitted on a bounded sample of labelled rows (``SAMPLE`` a language, those
with the smallest hashes) then again, ``ROUNDS`` times, on those whose label the
dictionaries of the other half of the sample confirm, so that wrong labels do not stay in.

Defined results: null, empty and letterless texts have no language (null, confidence 0, no
segments), and so has a text that is rejected as a whole; a tie in size is a rejection;
repeated records give the same; very long texts are read whole; an empty table gives an empty
table; extra columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkstone.session import latest, materialize

LANGUAGES = ("en", "zh", "de", "fr", "es", "pt", "ru", "ja")
#: Labelled sentences per language that the dictionaries are fitted on, and their size.
SAMPLE = 800
DICT_BYTES = 100_000
ROUNDS = 3
LEVEL = 19
#: A piece is rejected if the best and the second differ by less than this share and bytes.
MARGIN_SHARE, MARGIN_BYTES = 0.02, 1
#: Letters (a Han or Kana character counts three) below which a piece goes with its neighbour.
LEAST_LETTERS = 20
#: The only language of its script has to save this share of what its own sentences save on average.
SAVED_SHARE = 0.05
#: ... and at most this share of a piece's letters may be strange to its dictionary.
STRANGE_SHARE = 0.02
#: The languages of each script, and the name of the size without a dictionary.
SCRIPTS = {"east": ("ja", "zh"), "cyrillic": ("ru",), "latin": ("en", "de", "fr", "es", "pt")}
PLAIN = "-"

_BRACKET = re.compile(r"[(（][^()（）]+[)）]")
_QUOTE = re.compile(r"“[^“”]+”|\"[^\"]+\"|「[^「」]+」|『[^『』]+』|„[^„“”]+[“”]|«[^«»]+»|‘[^‘’]{20,}’")
_END = re.compile(r"(?<![\W_]\w)(?<!Dr)(?<!Prof)[.!?]+[\"”»’)\]]*\s+(?=\S)|[。！？]+[”」』）\"]*\s*|…{2,}\s*|\n\s*\n")
_WORD = re.compile(r"[^\W\d_]+")
_KANA = re.compile(r"[぀-ヿ]")
_HAN = re.compile(r"[㐀-鿿]")
_CYRILLIC = re.compile(r"[Ѐ-ӿ]")
_EAST = re.compile(r"[぀-ヿ㐀-鿿]")


def letters(s: str) -> int:
    """How much a piece says about its language: a Han or Kana character counts three."""
    return len(s) + 2 * len(_EAST.findall(s))


def content(s: str) -> tuple[str, tuple[str, ...]]:
    """What is compressed of a piece, and the languages that its script allows.

    Names and figures say nothing about the language, so of a text in letters with two cases
    only the words with a small initial are kept, and of one in Han or Kana only these.
    """
    east = _EAST.findall(s)
    words = [w for w in _WORD.findall(s) if not _EAST.search(w)]
    if words and sum(w.isupper() for w in words) * 2 > len(words):
        words = [w.lower() for w in words]
    small = [w for w in words if w[0].islower()]
    west = sum(len(w) for w in small if not _CYRILLIC.match(w))
    cyr = sum(len(w) for w in small if _CYRILLIC.match(w))
    if east and 3 * len(east) >= max(west, cyr):
        return "".join(east), SCRIPTS["east"]
    if cyr > west:
        return " ".join(w for w in small if _CYRILLIC.match(w)), SCRIPTS["cyrillic"]
    return " ".join(w for w in small if not _CYRILLIC.match(w)), SCRIPTS["latin"]


def _compressor(raw: bytes, level: int) -> Callable[[bytes], bytes]:
    """Compression with a dictionary of raw content, or without any if there is none."""
    import zstandard as z

    shape = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
    if not raw:
        return z.ZstdCompressor(level=level, **shape).compress
    d = z.ZstdCompressionDict(raw, dict_type=z.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(level=level)
    return z.ZstdCompressor(dict_data=d, **shape).compress


class Classifier:
    """Chooses the language with the smallest compressed size."""

    def __init__(self, contents: dict[str, bytes], level: int = LEVEL):
        self.compress = {PLAIN: _compressor(b"", level)} | {lang: _compressor(raw, level) for lang, raw in contents.items()}
        alone = {s[0] for s in SCRIPTS.values() if len(s) == 1}
        self.saves = {lang: self._saving(raw, level) for lang, raw in contents.items() if lang in alone}
        self.alphabet = {lang: set(contents[lang].decode("utf-8", "ignore").lower()) for lang in self.saves}

    def _saving(self, raw: bytes, level: int) -> float:
        """The share of size that one half of a dictionary's sentences saves with the other half."""
        lines = [x.encode() for x in raw.decode("utf-8", "ignore").split("\n") if x]
        half = _compressor(b"\n".join(lines[0::2]), level)
        plain = sum(len(self.compress[PLAIN](x)) for x in lines[1::2])
        return 1 - sum(len(half(x)) for x in lines[1::2]) / plain if plain else 0.0

    def piece(self, s: str, least: int = LEAST_LETTERS) -> tuple[str | None, float]:
        """Language and confidence of a piece; None if the margin is narrow or it is in no known language."""
        said, scripts = content(s)
        some = [x for x in scripts if x in self.compress]
        if not some or letters(said) < least:
            return None, 0.0
        raw = said.encode()
        sizes = sorted((len(self.compress[x](raw)), x) for x in some)
        best, lang = sizes[0]
        if len(scripts) == 1:
            saved, wanted = 1 - best / len(self.compress[PLAIN](raw)), SAVED_SHARE * self.saves[lang]
            strange = sum(c not in self.alphabet[lang] for c in said.lower())
            if saved < max(wanted, 1e-9) or strange > STRANGE_SHARE * len(said):
                return None, 0.5
            return lang, min(0.99, 0.5 + 0.5 * saved / self.saves[lang])
        gap = (sizes[1][0] if len(sizes) > 1 else len(self.compress[PLAIN](raw))) - best
        if gap < MARGIN_BYTES or gap < MARGIN_SHARE * best:
            # of a whole text without any Kana a narrow margin between the eastern languages is decided by that
            if least == 1 and scripts == SCRIPTS["east"]:
                return ("ja" if _KANA.search(said) else "zh"), 0.5
            return None, 0.5
        return lang, 1.0 - 0.5 ** (1.0 + gap / 4.0)

    def text(self, text: str | None) -> tuple[str | None, float, list[tuple[int, int, str, float]]]:
        """Language (or ``mixed``), confidence and segments (start, end from 0, language, confidence)."""
        if not text or not _WORD.search(text):
            return None, 0.0, []
        shown = text
        for _ in range(2):  # inner brackets first
            shown = _BRACKET.sub(lambda m: " " * len(m.group()), shown)
        found: list[list] = []
        for a, b in pieces(shown):
            part = shown[a:b]
            lang, sure = self.piece(part)
            found.append([a, b, lang, sure])
        if not any(f[2] for f in found):
            lang, sure = self.piece(shown, 1)
            if lang is None:
                lang, sure = self.piece(text, 1)
            return (lang, sure, [(0, len(text), lang, sure)]) if lang else (None, 0.0, [])
        known = [f for f in found if f[2]]
        out: list[list] = []
        for f in known:
            if out and out[-1][2] == f[2]:
                out[-1][1] = f[1]
                out[-1][3] = min(out[-1][3], f[3])
            else:
                out.append(list(f))
        langs = {f[2] for f in out}
        sure = min(f[3] for f in out)
        return (out[0][2] if len(langs) == 1 else "mixed"), sure, [tuple(f) for f in out]


def pieces(text: str) -> list[tuple[int, int]]:
    """Sentences, with longer quotations as pieces of their own, in reading order."""
    cuts = {0, len(text)}
    for m in _QUOTE.finditer(text):
        if letters(content(m.group())[0]) >= LEAST_LETTERS:
            cuts |= {m.start(), m.end()}
    cuts |= {m.end() for m in _END.finditer(text)}
    at = sorted(cuts)
    return [(a, b) for a, b in zip(at, at[1:]) if not text[a:b].isspace()]


def _contents(rows: list[tuple[str, str]]) -> dict[str, bytes]:
    texts: dict[str, list[str]] = {}
    for lang, text in rows:
        said, scripts = content(_BRACKET.sub(" ", text))
        if lang in scripts:
            texts.setdefault(lang, []).append(said)
    return {lang: "\n".join(dict.fromkeys(ts)).encode()[-DICT_BYTES:] for lang, ts in texts.items()}


def fit(labelled: DataFrame, lang: str = "lang", text: str = "text", sample: int = SAMPLE) -> dict[str, bytes]:
    """Dictionaries of raw content per language from at most ``sample`` labelled texts each."""
    usable = F.col(lang).isin(*LANGUAGES) & (F.length(text) > 30)
    known = labelled.where(usable).select(lang, text)
    # the smallest hashes of a language are surely among those below a threshold of four times their expected share
    counts = known.groupBy(lang).agg(F.count(F.lit(1)).alias("n")).collect()  # one row a language
    span = {r[0]: min(1.0, 4.0 * sample / r[1]) for r in counts}
    if not span:
        return {}
    below = F.create_map(*[F.lit(x) for k, v in sorted(span.items()) for x in (k, int(v * (1 << 62)))])
    hashed = F.col("_h").bitwiseAND(F.lit((1 << 62) - 1))
    few = known.withColumn("_h", F.xxhash64(text)).where(hashed <= F.try_element_at(below, F.col(lang)))
    order = W.partitionBy(lang).orderBy("_h", text)
    some = few.distinct().withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= sample)
    rows = [(r[0], r[1]) for r in some.select(lang, text).collect()]  # bounded: languages times sample
    if not rows:
        return {}
    return _contents(confirmed(rows))


def confirmed(rows: list[tuple[str, str]], rounds: int = ROUNDS) -> list[tuple[str, str]]:
    """The labelled texts whose label holds when judged by dictionaries made of the other half."""
    halves = [rows[0::2], rows[1::2]]
    for _ in range(rounds):
        models = [Classifier(_contents(h)) for h in halves]
        kept = [[(x, t) for x, t in h if models[1 - i].text(t)[0] == x] for i, h in enumerate(halves)]
        halves = [k or h for k, h in zip(kept, halves)]
    return halves[0] + halves[1]


def detect(records: DataFrame, key: str, text: str, contents: dict[str, bytes], *kept: str) -> DataFrame:
    """``(key, *kept, lang, confidence, segments array<struct<seg_no, lang, confidence, start_pos, end_pos>>)``."""
    kind = records.schema[key].dataType.simpleString()
    seg = pa.list_(pa.struct([("seg_no", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64()), ("start_pos", pa.int32()), ("end_pos", pa.int32())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Classifier(contents)
        for batch in batches:
            langs, sure, segs = [], [], []
            seen: dict[str | None, tuple] = {}
            for t in batch.column(1).to_pylist():
                if t not in seen:
                    seen[t] = model.text(t)
                a, b, s = seen[t]
                langs.append(a)
                sure.append(b)
                segs.append([{"seg_no": i, "lang": x[2], "confidence": x[3], "start_pos": x[0] + 1, "end_pos": x[1]} for i, x in enumerate(s, 1)])
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(langs, pa.string()), pa.array(sure, pa.float64()), pa.array(segs, seg)], ["key", *kept, "lang", "confidence", "segments"])

    some = records.select(F.col(key).alias("key"), F.col(text).alias("_text"), *kept)
    also = "".join(f"{c} {records.schema[c].dataType.simpleString()}, " for c in kept)
    out = some.mapInArrow(run, f"key {kind}, {also}lang string, confidence double, segments array<struct<seg_no:int,lang:string,confidence:double,start_pos:int,end_pos:int>>")
    return out.withColumnRenamed("key", key)


def label_language(label: Column, known: dict[str, str]) -> Column:
    """The language that a label notation names, null if it is missing or not known."""
    table = F.create_map(*[F.lit(x) for kv in sorted(known.items()) for x in kv]) if known else None
    return F.lit(None).cast("string") if table is None else F.try_element_at(table, label)


def polished_languages(results: DataFrame, sentences: DataFrame, labels: DataFrame) -> DataFrame:
    """Each polish result once with its label's language, the right one, confidence and segments."""
    known = {r[0]: r[1] for r in labels.select("label", "lang").collect()}  # a fixed small table
    once = latest(results, "result_id", "created_at", "sentence_id", "language_label").withColumn("label_lang", label_language(F.col("language_label"), known))
    texts = latest(sentences, "sentence_id", "received_at", "sentence")
    # a sentence may be polished many times: AQE splits such a key, and its rows are judged where they are
    both = materialize(once.join(texts, "sentence_id"), "polished")
    contents = fit(both, "label_lang", "sentence")
    found = detect(both, "result_id", "sentence", contents, "sentence_id", "language_label", "label_lang")
    return found


def language_findings(polished: DataFrame) -> DataFrame:
    """Rows (a) for missing and wrong labels, rows (b) for the segments of mixed texts."""
    wrong = F.col("lang").isNotNull() & (F.col("label_lang").isNull() | (F.col("label_lang") != F.col("lang")))
    whole = F.when(wrong, F.array(F.struct(F.lit(0).alias("seg_no"), F.col("lang").alias("lang"))))
    parts = F.when(F.col("lang") == "mixed", F.transform("segments", lambda s: F.struct(s["seg_no"].alias("seg_no"), s["lang"].alias("lang"))))
    none = F.array().cast("array<struct<seg_no:int,lang:string>>")
    return polished.select("result_id", F.inline(F.concat(F.coalesce(whole, none), F.coalesce(parts, none))))
