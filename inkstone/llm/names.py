"""Variant spellings of the names of people and organisations (problem 2).

Every distinct spelling is taken apart into a main token (the family name, or the proper
name of an organisation) and the rest.  Where a spelling does not say which part is the
family name, the part that more spellings of the collection use as one is taken.  Chinese
characters are read by a table of their readings, so they meet their romanised spellings.  A
symmetric-delete index over the distinct main tokens (each token stands under itself and
under all strings with one or two characters left out) finds the tokens within two edits
without comparing all with all.  Inside a family, the given names are assigned to each other,
which permits initials, abbreviations, nicknames and missing parts; this is done by keys
(given name, its beginnings, second initial), never by lists of a family, so a family that a
third of all spellings share is spread like any other.

A token joins a better attested one near it only if the given names agree and it has not
several people of its own: it has one or two spellings, or those of a single person with the
same full given name, or that person occurs at most a third as often as the other one.  Two
edits need nine letters, one spelling (or one person, a third as often) and a family of three spellings.

Defined results: null and empty fields have no names; the same string is one spelling
however often it occurs; a bare family name that several people share stays alone, and so
do initials that fit more than one of them (ties are not guessed); names in different
characters of one reading are different people, and a romanised name that fits both stays
alone; a very long name is indexed like any other; empty tables give no pairs; extra columns
are not looked at.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstone.session import materialize

#: Two edits are looked for in tokens of at least this length, one edit in shorter ones.
TWO_EDITS_FROM = 9
ONE_EDIT_FROM = 5
#: Assignments of given names that are followed at once (all of them for up to nine names; a memory bound beyond).
KEPT = 512

#: Short forms of given names in common use.
NICKNAMES = {
    "abby": "abigail", "al": "alexander", "alex": "alexander", "sasha": "alexander", "tony": "anthony", "chuck": "charles", "charlie": "charles", "dot": "dorothy", "dottie": "dorothy",
    "liz": "elizabeth", "beth": "elizabeth", "betty": "elizabeth", "fred": "frederick", "freddy": "frederick", "greg": "gregory", "hank": "henry", "harry": "henry", "izzy": "isabella", "bella": "isabella",
    "jen": "jennifer", "jenny": "jennifer", "joe": "joseph", "kate": "katherine", "kathy": "katherine", "len": "leonard", "leo": "leonard", "lucy": "lucia", "peggy": "margaret", "meg": "margaret", "maggie": "margaret",
    "mike": "michael", "mick": "michael", "nat": "nathaniel", "nate": "nathaniel", "nick": "nicholas", "trish": "patricia", "pat": "patricia", "becky": "rebecca", "bec": "rebecca", "dick": "richard", "rick": "richard",
    "rich": "richard", "bob": "robert", "rob": "robert", "sam": "samuel", "ted": "theodore", "theo": "theodore", "tom": "thomas", "vicky": "victoria", "tori": "victoria", "bill": "william", "will": "william", "jim": "james", "jack": "john",
}



class Readings(NamedTuple):
    """Readings of Chinese characters: in family names, elsewhere, and the simplified form."""

    family: dict[str, str]
    given: dict[str, str]
    plain: dict[str, str]


NO_READINGS = Readings({}, {}, {})


@cache
def _transliterated(name: str) -> dict[str, str]:
    from pyspark import SparkContext

    chars = [chr(i) for i in range(0x4E00, 0xA000)]
    tool = SparkContext._active_spark_context._jvm.com.ibm.icu.text.Transliterator.getInstance(name)  # of the process: another thread may have no active session
    return dict(zip(chars, (x.strip().lower() for x in tool.transliterate("\n".join(chars)).split("\n")), strict=True))


def readings() -> Readings:
    """The public tables of the Unicode library that comes with Spark; an error where they are not to be had."""
    try:
        return Readings(*(_transliterated(n) for n in ("Han-Latin/Names; Latin-ASCII", "Han-Latin; Latin-ASCII", "Traditional-Simplified")))
    except Exception as e:  # noqa: BLE001 - a remote session has no JVM at hand, another one not this library
        raise RuntimeError(f"names in Chinese characters need the readings of the Unicode library in Spark's JVM: {e!r}") from e


#: The syllables of romanised Chinese, by the rule of which final follows which initial.
_SYLLABLE = (
    "(?:[bpmf](?:a|o|ai|ei|ao|an|en|ang|eng|u|ou)|[bpm](?:i|ie|iao|ian|in|ing|iu)|[dtnl](?:a|e|ai|ei|ao|ou|an|en|ang|eng|ong|i|ie|iao|iu|ian|in|iang|ing|u|uan|ui|un|uo|ue)"
    "|[gkh](?:a|e|ai|ei|ao|ou|an|en|ang|eng|ong|u|ua|uo|uai|ui|uan|un|uang)|[jqx](?:i|ia|ie|iao|iu|ian|in|iang|ing|iong|u|uan|un|ue)"
    "|(?:[zcs]h?|r)(?:a|e|ai|ei|ao|ou|an|en|ang|eng|ong|i|u|ua|uo|uai|ui|uan|un|uang)|y(?:a|e|ao|ou|an|ang|i|in|ing|ong|u|uan|un|ue|o)|w(?:a|ai|ei|an|en|ang|eng|o|u)|ai?|ang?|ao|e[inr]?|eng|ou?)"
)
_ONE_SYLLABLE = re.compile(_SYLLABLE)
_UP_TO_TWO = re.compile(f"{_SYLLABLE}{{1,2}}")

_HAN = re.compile(r"[㐀-鿿]")
_TITLE = re.compile(r"^(?:dr|prof|mr|mrs|ms|sir)\.?\s+", re.I)
_ACRONYM = re.compile(r"^([A-Z]{3,6})\s*\(([^)]+)\)$")
_TYPES = {"society": "s", "soc": "s", "institute": "i", "institut": "i", "inst": "i", "centre": "c", "center": "c", "ctr": "c", "council": "c", "cncl": "c", "office": "o", "off": "o", "association": "a", "assoc": "a", "board": "b", "bureau": "b", "academy": "a"}
_FILL = {"the", "of", "on", "for", "and", "o", "f", "in", "studies", "stud", "study", "research", "res", "writing", "writ", "policy", "pol", "statistics", "stat", "stats"}
_OCR = str.maketrans("0135|", "olesl")


def normal(token: str) -> str:
    """Lower case without accents, hyphens and the usual misread characters."""
    s = unicodedata.normalize("NFKD", token.casefold())
    return "".join(c for c in s if not unicodedata.combining(c) and c.isalnum() or c == "|").translate(_OCR)


def parse(name: str, table: Readings = NO_READINGS) -> tuple[str, str, list[str]]:
    """``(kind, main token, rest)``: kind z (family and given name by reading), o (organisation) or p (person)."""
    s = " ".join(name.split())
    if _HAN.search(s):
        return "z", "|".join(_read(s, table)[:2]), []
    if m := _ACRONYM.match(s):
        a = m.group(1).lower()
        return "o", normal(m.group(2)), [a[1], a[2]]
    words = re.findall(r"[^\s,;()]+", s)
    low = [w.strip(".").casefold() for w in words]
    kinds = [i for i, w in enumerate(low) if w in _TYPES]
    if kinds and len(words) >= 3:
        left = [i for i, w in enumerate(low) if w not in _FILL and i not in kinds]
        if left:
            main = left[-1] if "," in s else left[0]
            topic = next((low[i] for i in left if i != main), "")
            return "o", normal(words[main]), [_TYPES[low[kinds[0]]], topic[:1]]
    s = _TITLE.sub("", s)
    family, comma, given = s.partition(",")
    chinese = _chinese(family, given) if comma else _chinese_open(s)
    if chinese:
        return "z", chinese, []
    if comma:
        return "p", normal(family), _given(given)
    parts = s.split()
    if len(parts) == 1:
        return "p", normal(s), []
    at = max(range(len(parts)), key=lambda i: (len(normal(parts[i])), i))
    return "p", normal(parts[at]), _given(" ".join(parts[:at] + parts[at + 1 :]))


def _read(s: str, table: Readings) -> tuple[str, str, str]:
    """Family name and given name of a name in characters by their readings, and its simplified form."""
    han = s.replace(" ", "").replace("·", "")
    n = 2 if len(han) > 3 else 1  # four characters have a family name of two
    family = "".join(table.family.get(c, c) for c in han[:n])
    return family, "".join(table.given.get(c, c) for c in han[n:]), "".join(table.plain.get(c, c) for c in han)


def _chinese(family: str, given: str) -> str | None:
    f, g = normal(family), normal(given)
    return f"{f}|{g}" if g and _ONE_SYLLABLE.fullmatch(f) and _UP_TO_TWO.fullmatch(g) else None


def _chinese_open(s: str) -> str | None:
    parts = s.split()
    if not 2 <= len(parts) <= 3:
        return None
    return _chinese(parts[0], "".join(parts[1:])) or _chinese(parts[-1], "".join(parts[:-1]))


class Option(NamedTuple):
    """One way to take a spelling apart."""

    token: str
    rest: list[str]
    full: bool
    han: str | None


def _option(token: str, rest: list[str]) -> Option:
    return Option(token, rest, bool(rest) and len(rest[0]) > 2 and not rest[0].endswith("."), None)


def options(name: str, table: Readings = NO_READINGS) -> tuple[str, list[Option]]:
    """Kind (p or o) and the ways to take a spelling apart, the likeliest first; one where it says which part is what."""
    s = " ".join(name.split())
    if _HAN.search(s):
        family, given, han = _read(s, table)
        return "p", [Option(family, [given] if given else [], bool(given), han if given else None)]
    kind, token, rest = parse(s)
    if kind == "o":
        return "o", [Option(token, rest, True, None)]
    s = _TITLE.sub("", s)
    if "," in s or len(parts := s.split()) == 1:
        if kind == "z":
            family, given = token.split("|")
            return "p", [Option(family, [given], True, None)]
        return "p", [_option(token, rest)]
    found = [c.split("|") for c in (_chinese(parts[0], "".join(parts[1:])), _chinese(parts[-1], "".join(parts[:-1]))) if c] if len(parts) <= 3 else []
    out = [Option(f, [g], True, None) for f, g in found]
    if not out:
        out = [_option(token, rest), _option(normal(parts[-1]), _given(" ".join(parts[:-1]))), _option(normal(parts[0]), _given(" ".join(parts[1:])))]
    seen: set[str] = set()
    return "p", [o for o in out if o.token and not (o.token in seen or seen.add(o.token))] or [_option(token, rest)]


def _given(s: str) -> list[str]:
    """Given names in normal form; an initial is one letter, an abbreviation ends with a dot."""
    out = []
    for w in s.replace(".", ". ").split():
        n = normal(w)
        if not n:
            continue
        letters = w.strip(".")
        if len(n) == 1:
            out.append(n)
        elif letters.isupper() and len(n) <= 3 and not s.isupper() or (letters.isupper() and len(n) <= 2):
            out += list(n)
        else:
            n = NICKNAMES.get(n, n)
            out.append(n + "." if w.endswith(".") else n)
    return out


def _cost(a: str, b: str) -> float | None:
    if a == b:
        return 0.0
    x, y = a.rstrip("."), b.rstrip(".")
    if len(x) == 1 or len(y) == 1:
        return 0.3 if x[0] == y[0] else None
    if a.endswith(".") and y.startswith(x) or b.endswith(".") and x.startswith(y):
        return 0.2
    if min(len(x), len(y)) >= 4 and edits(x, y, 1) <= 1:
        return 0.5
    return None


def align(a: list[str], b: list[str]) -> float | None:
    """Cost of the best assignment of given names, None if the names contradict each other.

    The first names have to fit; further names may be missing on one side.
    """
    if not a or not b:
        return 1.0
    if len(a) > len(b):
        a, b = b, a
    # the cheapest way to give each name of the shorter list one of the longer, by the set of those already given
    states: dict[int, float] = {0: 0.0}
    for i, x in enumerate(a):
        costs = [_cost(x, y) for y in b]
        new: dict[int, float] = {}
        for taken, total in states.items():
            for j, c in enumerate(costs):
                if c is None or taken >> j & 1:
                    continue
                key, sum_ = taken | 1 << j, total + c + (0.4 if i != j else 0.0)
                if sum_ < new.get(key, float("inf")):
                    new[key] = sum_
        states = dict(sorted(new.items(), key=lambda kv: kv[1])[:KEPT]) if len(new) > KEPT else new
    return min(states.values(), default=None)


def edits(a: str, b: str, most: int = 2) -> int:
    """Edit distance with transpositions, or ``most + 1`` if it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    a, b = a[i:], b[i:]
    i = 0
    while i < min(len(a), len(b)) and a[-1 - i] == b[-1 - i]:
        i += 1
    a, b = a[: len(a) - i], b[: len(b) - i]
    two: list[int] = []
    one = list(range(len(b) + 1))
    for i in range(1, len(a) + 1):
        row = [i]
        for j in range(1, len(b) + 1):
            v = min(one[j] + 1, row[j - 1] + 1, one[j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                v = min(v, two[j - 2] + 1)
            row.append(v)
        if min(row) > most:
            return most + 1
        two, one = one, row
    return one[-1]


def deletions(token: str) -> set[str]:
    """The token and what is left of it without one or two characters."""
    out = {token}
    if len(token) >= ONE_EDIT_FROM:
        one = {token[:i] + token[i + 1 :] for i in range(len(token))}
        out |= one
        if len(token) >= TWO_EDITS_FROM:
            out |= {x[:i] + x[i + 1 :] for x in one for i in range(len(x))}
    return out


def family_groups(spellings: list[tuple[str, list[str]]], kind: str) -> list[list[int]]:
    """Spellings of one main token, as groups of indices that mean one person or organisation."""
    if kind == "z":
        return [list(range(len(spellings)))]
    groups: dict[str, list[int]] = {}
    if kind == "o":
        for i, (_, rest) in enumerate(spellings):
            groups.setdefault("".join(rest), []).append(i)
        return list(groups.values())
    later = []
    for i, (_, given) in enumerate(spellings):
        if given and len(given[0]) > 2 and not given[0].endswith("."):
            groups.setdefault(given[0], []).append(i)
        else:
            later.append(i)
    later.sort(key=lambda i: -len("".join(spellings[i][1])))
    for i in later:
        given = spellings[i][1]
        if not given:
            fits = list(groups)
        else:
            fits = [g for g in groups if _cost(given[0], g) is not None]
            if len(fits) > 1:  # the further initials may tell them apart
                sure = [g for g in fits if any(len(spellings[j][1]) > 1 and align(given, spellings[j][1]) is not None for j in groups[g])] if len(given) > 1 else []
                fits = sure if len(sure) == 1 else fits
        if len(fits) == 1:
            groups[fits[0]].append(i)
        else:
            groups.setdefault("?" + (given[0][:1] if given else "") if fits else given[0] if given else "?", []).append(i)
    return list(groups.values())


def spellings_of(fields: list[tuple[DataFrame, str]]) -> DataFrame:
    """``(name, m)``: the distinct names in some columns of names joined by ``; `` and how often each occurs."""
    out = None
    for df, column in fields:
        some = df.select(F.explode(F.split(F.col(column), "; ")).alias("name"))
        some = some.select(F.trim(F.regexp_replace(F.trim("name"), " et al\\.$", "")).alias("name")).where(F.col("name") != "")
        out = some if out is None else out.unionByName(some)
    return out.groupBy("name").agg(F.count(F.lit(1)).alias("m"))


_OPTION = "struct<token:string,rest:array<string>,full:boolean,han:string>"


def _parsed(names: DataFrame) -> DataFrame:
    table, missing = NO_READINGS, ""
    try:
        table = readings()
    except RuntimeError as e:  # only names in characters need them; one of these ends the run
        missing = str(e)
    kind = pa.list_(pa.struct([("token", pa.string()), ("rest", pa.list_(pa.string())), ("full", pa.bool_()), ("han", pa.string())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if missing and any(map(_HAN.search, b.column(0).to_pylist())):
                raise RuntimeError(missing)
            got = [options(n, table) for n in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([g[0] for g in got], pa.string()), pa.array([[o._asdict() for o in g[1]] for g in got], kind)], ["name", "m", "kind", "options"])

    return names.mapInArrow(run, f"name string, m bigint, kind string, options array<{_OPTION}>")


def taken_apart(spellings: DataFrame) -> DataFrame:
    """``(name, m, kind, token, rest, full, han)``: of several ways the one whose family name the collection attests most."""
    parsed = materialize(_parsed(spellings), "options")
    base = ["name", "m", "kind"]
    sure = parsed.where(F.size("options") == 1).select(*base, F.col("options")[0].alias("o"))
    support = sure.where("kind = 'p'").groupBy(F.col("o.token").alias("_token")).agg(F.sum("m").alias("_s"))
    open_ = parsed.where(F.size("options") > 1).select(*base, F.posexplode("options").alias("_at", "o"))
    scored = open_.join(support, F.col("o.token") == F.col("_token"), "left")
    best = scored.groupBy(*base).agg(F.max_by("o", F.struct(F.coalesce("_s", F.lit(0)), -F.col("_at"))).alias("o"))
    return sure.unionByName(best).select(*base, "o.token", "o.rest", "o.full", "o.han")


def _deletion_index(tokens: DataFrame) -> DataFrame:
    import xxhash

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 2000):
                part = b.slice(lo, 2000)
                keys, at = [], []
                for i, (k, t) in enumerate(zip(part.column(0).to_pylist(), part.column(1).to_pylist())):
                    ds = [xxhash.xxh3_64_intdigest(k + d) - (1 << 63) for d in deletions(t)]
                    keys += ds
                    at += [i] * len(ds)
                idx = pa.array(at, pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *(c.take(idx) for c in part.columns)], ["key", "kind", "token", "n"])

    return tokens.mapInArrow(run, "key bigint, kind string, token string, n bigint")


def near_tokens(tokens: DataFrame) -> DataFrame:
    """``(kind, token, n, host, d, host_n)``: for each token the better attested ones within two edits."""
    index = materialize(_deletion_index(tokens), "deletions")
    a = index.select("key", "kind", "token", "n")
    b = index.select("key", F.col("kind").alias("kind_b"), F.col("token").alias("host"), F.col("n").alias("host_n"))
    better = (F.col("host_n") > F.col("n")) | ((F.col("host_n") == F.col("n")) & (F.col("host") < F.col("token")))
    pairs = a.join(b, "key").where((F.col("kind") == F.col("kind_b")) & (F.col("token") != F.col("host")) & better)
    pairs = pairs.select("kind", "token", "n", "host", "host_n").distinct()

    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ts, hs = b.column(1).to_pylist(), b.column(3).to_pylist()
            most = [2 if min(len(t), len(h)) >= TWO_EDITS_FROM else 1 for t, h in zip(ts, hs)]
            d = [edits(t, h, m) for t, h, m in zip(ts, hs, most)]
            keep = [i for i in range(len(ts)) if d[i] <= most[i]]
            idx = pa.array(keep, pa.int32())
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(idx) for c in (0, 1, 2, 3)), pa.array([d[i] for i in keep], pa.int32()), b.column(4).take(idx)], ["kind", "token", "n", "host", "d", "host_n"])

    return pairs.mapInArrow(verify, "kind string, token string, n bigint, host string, d int, host_n bigint")


def _keyed(rows: DataFrame) -> DataFrame:
    """Adds the keys of the given names: the first one, how it begins, its letter and the initial of the second."""
    first = F.when(F.size("rest") > 0, F.col("rest")[0])
    rows = rows.withColumn("g", F.when(F.col("kind") == "o", F.concat_ws("", "rest")).otherwise(first))
    begins = F.rtrim(F.col("g"), F.lit("."))
    second = F.when(F.size("rest") > 1, F.substring(F.try_element_at("rest", F.lit(2)), 1, 1))
    return rows.withColumn("begins", begins).withColumn("letter", F.substring("begins", 1, 1)).withColumn("second", second)


class _Family(NamedTuple):
    """Tables by which the given names of a family are told apart; each has one row a key."""

    begins: DataFrame  # (token, begins): full given names that begin so
    second: DataFrame  # (token, letter, second): full given names with this initial and second initial


def _family(rows: DataFrame) -> _Family:
    full = rows.where(F.col("full") & (F.col("kind") == "p"))
    given = full.select("token", "g").distinct()
    # an abbreviation that no full given name begins with stands for one
    beginnings = F.transform(F.sequence(F.lit(1), F.length("g")), lambda i: F.substring(F.col("g"), F.lit(1), i))
    short = rows.where(~F.col("full") & F.endswith("g", F.lit(".")) & (F.length("begins") > 1)).select("token", "begins").distinct()
    short = short.join(given.select("token", F.explode(beginnings).alias("begins")), ["token", "begins"], "left_anti")
    given = given.unionByName(short.select("token", F.col("begins").alias("g")))
    cut = given.select("token", "g", F.explode(beginnings).alias("begins"))
    begins = cut.groupBy("token", "begins").agg(F.count(F.lit(1)).alias("bn"), F.min("g").alias("bg"))
    second = full.where(F.col("second").isNotNull()).select("token", "letter", "second", "g").distinct()
    return _Family(begins, second.groupBy("token", "letter", "second").agg(F.count(F.lit(1)).alias("sn"), F.min("g").alias("sg")))


def _given_group(unknown: Column) -> Column:
    """The full given name that initials or an abbreviation stand for; ``unknown`` where none fits."""
    return F.when(F.col("bn") == 1, F.col("bg")).when((F.col("bn") > 1) & (F.col("sn") == 1), F.col("sg")).when(F.col("bn").isNull(), unknown)


def own_groups(rows: DataFrame, family: _Family) -> DataFrame:
    """``rows`` with ``grp``: which person or organisation of its main token a spelling means."""
    whole = F.col("full") | (F.col("kind") == "o")
    part = rows.where(~whole & F.col("g").isNotNull()).join(family.begins, ["token", "begins"], "left").join(family.second, ["token", "letter", "second"], "left")
    part = part.withColumn("grp", F.coalesce(_given_group(F.col("g")), F.concat(F.lit("?"), F.col("letter")))).drop("bn", "bg", "sn", "sg")
    # names in different characters that are read alike are different people
    chars = rows.where(F.col("han").isNotNull()).select("token", "g", "han").distinct().groupBy("token", "g").agg(F.count(F.lit(1)).alias("hn"))
    known = rows.where(whole).join(chars, ["token", "g"], "left")
    known = known.withColumn("grp", F.when(F.col("hn") > 1, F.concat_ws("/", "g", "han")).otherwise(F.col("g"))).drop("hn")
    told = known.select(*rows.columns, "grp").unionByName(part.select(*rows.columns, "grp"))
    count = told.select("kind", "token", "grp").distinct().groupBy("kind", "token").agg(F.count(F.lit(1)).alias("gn"), F.min("grp").alias("gg"))
    bare = rows.where(~whole & F.col("g").isNull()).join(count, ["kind", "token"], "left")
    bare = bare.withColumn("grp", F.when(F.col("gn") == 1, F.col("gg")).otherwise("?"))
    return told.unionByName(bare.select(*rows.columns, "grp"))


def guest_groups(own: DataFrame, family: _Family, near: DataFrame) -> DataFrame:
    """``(name, kind, host, grp, d, host_n)``: spellings of misspelt tokens with the group of the host that they mean."""
    groups = materialize(own.groupBy("kind", "token", "grp").agg(F.sum("m").alias("gm")), "groups")
    persons = groups.where(~F.col("grp").startswith("?"))
    count = persons.groupBy("kind", "token").agg(F.count(F.lit(1)).alias("gn"), F.min("grp").alias("gg"))
    rows = own.join(near, ["kind", "token"]).join(groups.withColumnRenamed("gm", "mine"), ["kind", "token", "grp"])
    rows = rows.join(count.select("kind", "token", F.col("gn").alias("own_n")), ["kind", "token"], "left").drop("grp").withColumnRenamed("token", "misspelt")
    rows = rows.join(family.begins.withColumnRenamed("token", "host"), ["host", "begins"], "left").join(family.second.withColumnRenamed("token", "host"), ["host", "letter", "second"], "left")
    same = persons.select("kind", F.col("token").alias("host"), F.col("grp").alias("g"), F.col("grp").alias("same"))
    alike = persons.where(F.length("grp") == 1).select("kind", F.col("token").alias("host"), F.col("grp").alias("letter"), F.col("grp").alias("alike"))
    rows = rows.join(same, ["kind", "host", "g"], "left").join(alike, ["kind", "host", "letter"], "left").join(count.withColumnRenamed("token", "host"), ["kind", "host"], "left")
    whole = F.col("full") | (F.col("kind") == "o")
    grp = F.when(F.col("kind") == "o", F.col("same")).when(F.col("full"), F.coalesce("same", "alike")).when(F.col("g").isNotNull(), _given_group(F.col("same"))).when(F.col("gn") == 1, F.col("gg"))
    rows = rows.withColumn("grp", grp).where(F.col("grp").isNotNull()).withColumn("strong", whole & F.col("same").isNotNull())
    rows = rows.join(groups.select("kind", F.col("token").alias("host"), "grp", F.col("gm").alias("theirs")), ["kind", "host", "grp"])
    some = rows.groupBy("kind", "misspelt", "host").agg(F.max("strong").alias("strong_any"))
    rows = rows.join(some, ["kind", "misspelt", "host"])
    single = F.coalesce("own_n", F.lit(0)) <= 1
    sure = F.col("strong_any") | (F.length("misspelt") >= TWO_EDITS_FROM)
    rare = 3 * F.col("mine") <= F.col("theirs")
    one = (F.col("n") <= 2) | (single & sure) | (F.col("strong") & rare)
    two = (F.col("host_n") >= 3) & F.col("g").isNotNull() & ((F.col("n") == 1) | (single & F.col("strong_any") & rare))
    return rows.where(F.when(F.col("d") == 1, one).otherwise(two)).select("name", "kind", "host", "grp", "d", "host_n")


def link_variants(fields: list[tuple[DataFrame, str]]) -> DataFrame:
    """``(name, entity)``: every distinct spelling with the group that it belongs to."""
    rows = materialize(_keyed(taken_apart(spellings_of(fields))), "names")
    near = near_tokens(rows.groupBy("kind", "token").agg(F.count(F.lit(1)).alias("n")))
    family = _family(rows)
    own = materialize(own_groups(rows, family), "own")
    guests = guest_groups(own, family, materialize(near, "near"))
    found = own.select("name", "kind", F.col("token").alias("host"), "grp", F.lit(0).alias("d"), F.lit(0).cast("bigint").alias("host_n")).unionByName(guests)
    entity = F.concat_ws(":", "kind", "host", "grp")
    # a spelling with a better attested host goes there, else it stays in its own family
    rank = F.struct(F.when(F.col("d") == 0, 2).when(F.col("host_n") >= 3, 0).otherwise(1).alias("a"), "d", (-F.col("host_n")).alias("b"), entity.alias("e"))
    return found.groupBy("name").agg(F.min_by(entity, rank).alias("entity"))


def variant_pairs(linked: DataFrame) -> DataFrame:
    """All pairs of different spellings of one group; a group is the spellings of one name."""
    linked = materialize(linked, "linked")
    a, b = linked.select("entity", F.col("name").alias("name_a")), linked.select("entity", F.col("name").alias("name_b"))
    return a.join(b, "entity").where(F.col("name_a") < F.col("name_b")).select("name_a", "name_b")
