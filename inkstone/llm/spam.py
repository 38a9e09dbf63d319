"""Pages made of keywords, links or tags instead of sentences (problem 9).

A page is a row of units (lines; long lines are cut at sentence ends, and what is still long
at white space, so that units are of one size).  Each unit shows one
of four symbols, and a hidden Markov model with the states prose, link list, tag list and
menu gives it a label by the most likely path.  A page is flagged if more than half of its
characters stand in units labelled link list or tag list.

The symbols: ``link`` - at least ``LINK_SHARE`` of the unit are addresses and their anchors,
and it is no sentence around them (an end mark and ``LINKED_WORDS`` other words);
``hot`` - at least ``HOT_SHARE`` of its word characters belong to words that make up a large
part of the whole page, or are prices and article numbers (or it lists ``LISTED`` of these
without being a sentence), or nearly all of them
(``WORN_SHARE``) to words that the page repeats again and again, however many different
words these are; ``short`` - a short line without an end mark; else ``sentence``.
Contents, tables, reference lists and glossaries show ``short`` and ``sentence``.

The model is fitted (``fit``) by the method of Baum and Welch on all pages, beginning from
what the symbols of each state should be.  This also counts as ``PRIOR`` units of each state,
and so many for every ``PAGES`` pages of a larger table, so that the states keep their
meaning at any size.

Defined results: null, empty and blank texts are not flagged; a text is looked at whole;
repeated rows are each judged; extra columns are not looked at; an empty table gives none,
and a model fitted on no pages is the one it begins from.
"""

from __future__ import annotations

import re
import textwrap
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from math import log
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.session import materialize

LINK_SHARE, LINKED_WORDS = 0.35, 6
HOT_SHARE = 0.5
#: A word is hot in a page if it occurs this often and is this share of the page's words.
HOT_COUNT, HOT_RATE = 3, 0.022
#: A word is worn if it occurs this often and is this share of the page's words; a unit of hardly any others is a list.
WORN_COUNT, WORN_RATE, WORN_SHARE = 5, 0.004, 0.9
#: Prices and article numbers that make a unit a list.
LISTED = 2
SHORT = 60
LONG_LINE, WINDOW = 160, 80
FLAG_SHARE = 0.5

STATES = ("prose", "link list", "tag list", "menu")
SYMBOLS = ("sentence", "link", "hot", "short")
#: Where the fit begins: the first state, staying in a state, and the symbols (columns) of each state (rows).
START = (0.70, 0.10, 0.10, 0.10)
STAY = 0.85
EMIT = ((0.70, 0.04, 0.03, 0.23), (0.02, 0.82, 0.10, 0.06), (0.03, 0.05, 0.78, 0.14), (0.06, 0.06, 0.08, 0.80))
#: Pages from which on the weight of the beginning grows with the pages, rounds of the fit, and that weight in units (for
#: the symbols it is higher, so that pages that mix two kinds of units do not make a state of their own).
PAGES, ROUNDS, PRIOR, PRIOR_SYMBOLS = 400, 5, 400.0, 20000.0
#: Units that are counted at once (a memory bound; a longer page is counted by itself).
CELLS = 200_000


class Model(NamedTuple):
    """Logarithms of the probabilities of the first state, of the next state and of the symbols."""

    start: list[float]
    move: list[list[float]]
    emit: list[list[float]]


def _model(start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> Model:
    return Model(np.log(start).tolist(), np.log(move).tolist(), np.log(emit).tolist())


def _beginning() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(STATES)
    move = np.full((n, n), (1 - STAY) / (n - 1))
    np.fill_diagonal(move, STAY)
    return np.array(START), move, np.array(EMIT)


def expected(rows: list[list[int]], times: list[int], start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> np.ndarray:
    """How often rows of symbols begin with each state, pass from one to another and show a symbol in one, by the model; in one vector."""
    n = len(STATES)
    s, m, e = np.zeros(n), np.zeros((n, n)), np.zeros((n, len(SYMBOLS)))
    order = sorted((i for i, row in enumerate(rows) if len(row)), key=lambda i: -len(rows[i]))
    lo = 0
    while lo < len(order):
        part = order[lo : lo + max(1, CELLS // len(rows[order[lo]]))]
        lo += len(part)
        sizes = np.array([len(rows[i]) for i in part])
        seen = np.zeros((len(part), sizes[0]), np.int64)
        for k, i in enumerate(part):
            seen[k, : sizes[k]] = rows[i]
        weight = np.array([times[i] for i in part], float)[:, None]
        there = [int(np.searchsorted(-sizes, -k)) for k in range(sizes[0])]  # rows with more than k units: the first ones
        ahead, scale = [], []
        for k, a in enumerate(there):
            x = (start if k == 0 else ahead[-1][:a] @ move) * emit.T[seen[:a, k]]
            scale.append(x.sum(axis=1, keepdims=True))
            ahead.append(x / scale[-1])
        back = np.ones((0, n))
        for k in range(len(there) - 1, -1, -1):
            a = there[k]
            back = np.concatenate([back, np.ones((a - len(back), n))])
            here = weight[:a] * ahead[k] * back
            for o in range(len(SYMBOLS)):
                e[:, o] += here[seen[:a, k] == o].sum(axis=0)
            if k:
                later = emit.T[seen[:a, k]] * back / scale[k]
                m += move * ((weight[:a] * ahead[k - 1][:a]).T @ later)
                back = later @ move.T
            else:
                s += here.sum(axis=0)
    return np.concatenate([s, m.ravel(), e.ravel()])


def _fitted(count: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], pages: int, rounds: int, prior: float) -> Model:
    """The model after some rounds; ``count``: what is expected of all pages by a model."""
    n = len(STATES)
    start0, move0, emit0 = _beginning()
    start, move, emit = start0, move0, emit0
    weight = max(1.0, pages / PAGES)
    for _ in range(rounds if pages else 0):
        x = count(start, move, emit)
        s, m, e = start0 * prior * weight + x[:n], move0 * prior * weight + x[n : n + n * n].reshape(n, n), emit0 * PRIOR_SYMBOLS * weight + x[n + n * n :].reshape(n, -1)
        start, move, emit = s / s.sum(), m / m.sum(axis=1, keepdims=True), e / e.sum(axis=1, keepdims=True)
    return _model(start, move, emit)


def baum_welch(rows: list[list[int]], rounds: int = ROUNDS, prior: float = PRIOR) -> Model:
    """The model fitted to rows of symbols; the beginning stands for ``prior`` units of each state."""
    counted = Counter(map(tuple, rows))  # many pages show the same row
    return _fitted(lambda *model: expected(list(counted), list(counted.values()), *model), len(rows), rounds, prior)


#: The model that the fit begins from.
DEFAULT = _model(*_beginning())

_LINES = re.compile(r"[^\r\n]+")
#: Addresses with a scheme, and bare host names in small letters (two labels or more, the last without figures).
_HOST = r"(?<![\w@.-])[a-z0-9][a-z0-9-]*(?:\.[a-z0-9-]+)*\.[a-z]{2,24}(?![\w.-]*\w)(?:/[^\s<>\"')\]]*)?"
_ADDRESS = rf"(?:https?|hxxps?|ftp)://[^\s<>\"')\]]+|www\.[^\s<>\"')\]]+|(?-i:{_HOST})"
_LINK = re.compile(rf"<a\b[^>]*>.*?</a>|\[[^\]\n]*\]\([^)\n]*\)|{_ADDRESS}", re.I)
_SPLIT = re.compile(r"(?<=[.!?。！？])\s+|(?<=[。！？])")
_WORD = re.compile(r"[^\W_]+")
_END = re.compile(r"[.!?。！？…:;；：]\W*$")
_STOP = re.compile(r"[.!?。！？…]\W*$")
#: Prices and article numbers (capitals and at least three figures).
_PRICE = re.compile(r"[$€£¥]\s?\d[\d.,]*|\b[A-Z]{2,6}[ -]?\d{3,}\b")
_DIGITS = re.compile(r"^\d+$|\d+$")


def _units(text: str) -> list[str]:
    out = []
    for line in _LINES.findall(text):
        line = line.strip()
        if not line:
            continue
        if len(line) > LONG_LINE:
            for p in _SPLIT.split(line):
                if p and not p.isspace():
                    out += [p] if len(p) <= LONG_LINE or len(p) <= 2 * LONG_LINE and _STOP.search(p) else textwrap.wrap(p, WINDOW, break_on_hyphens=False)
        else:
            out.append(line)
    return out


def _key(w: str) -> str:
    return _DIGITS.sub("", w)


def symbols(text: str) -> tuple[list[int], list[int]]:
    """The symbol and the size (characters but white space) of each unit."""
    units = _units(text)
    words = [[_key(w) for w in _WORD.findall(_LINK.sub(" ", u).lower())] for u in units]
    counts = Counter(w for ws in words for w in ws if w)
    total = sum(counts.values())
    need = max(HOT_COUNT, HOT_RATE * total)
    hot = {w for w, c in counts.items() if c >= need and (len(w) > 2 or not w.isascii())}
    often = max(WORN_COUNT, WORN_RATE * total)
    worn = {w for w, c in counts.items() if c >= often}
    seen, sizes = [], []
    for u, ws in zip(units, words):
        bare = len(u) - u.count(" ") - u.count("\t")
        sizes.append(bare)
        linked = sum(len(m) - m.count(" ") for m in _LINK.findall(u)) if ("." in u or "](" in u or "<" in u) else 0
        if linked >= LINK_SHARE * bare and not (len(ws) >= LINKED_WORDS and _END.search(u)):
            seen.append(1)
            continue
        chars = sum(map(len, ws))
        hots = sum(len(w) for w in ws if w in hot)
        prices = _PRICE.findall(u) if any(c.isdigit() for c in u) else ()
        priced = sum(map(len, prices))
        chars, hots = chars + priced, hots + priced  # prices and article numbers count like hot words
        if chars and (hots >= HOT_SHARE * chars or len(prices) >= LISTED and not _STOP.search(u)):
            seen.append(2)
        elif worn and chars and sum(len(w) for w in ws if w in worn) >= WORN_SHARE * chars and len(ws) > 2:
            seen.append(2)
        elif len(u) < SHORT and not _END.search(u):
            seen.append(3)
        else:
            seen.append(0)
    return seen, sizes


def label(seen: list[int], model: Model = DEFAULT) -> list[int]:
    """The most likely states of a row of symbols (ties: the earlier state of ``STATES``)."""
    if not seen:
        return []
    states = range(len(STATES))
    score = [model.start[s] + model.emit[s][seen[0]] for s in states]
    into = list(zip(*model.move))
    back = []
    for o in seen[1:]:
        came, new = [], []
        for s in states:
            best, at = score[0] + into[s][0], 0
            for r in states[1:]:
                if (x := score[r] + into[s][r]) > best:
                    best, at = x, r
            came.append(at)
            new.append(best + model.emit[s][o])
        back.append(came)
        score = new
    path = [max(states, key=score.__getitem__)]
    for came in reversed(back):
        path.append(came[path[-1]])
    return path[::-1]


def _shares(seen: list[int], sizes: list[int], model: Model) -> list[float]:
    out = [0] * len(STATES)
    for s, size in zip(label(seen, model) if any(seen) else [0] * len(seen), sizes):
        out[s] += size
    total = sum(out) or 1
    return [x / total for x in out]


def shares(text: str | None, model: Model = DEFAULT) -> list[float]:
    """The share of the page's characters in each state."""
    return _shares(*symbols(text or ""), model)


def page_units(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, seen, sizes): the symbols and sizes of the units of each row."""
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [symbols(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([g[i] for g in got], pa.list_(pa.int32())) for i in (0, 1))], ["key", "seen", "sizes"])

    return documents.select(F.col(key).alias("key"), F.col(text).alias("_text")).mapInArrow(run, f"key {kind}, seen array<int>, sizes array<int>")


def fit(units: DataFrame) -> Model:
    """The model of all pages; ``units``: rows with their symbols in ``seen``."""
    rows = materialize(units.where(F.size("seen") > 0).groupBy("seen").agg(F.count(F.lit(1)).alias("n")), "symbol-rows")  # many pages show the same row

    def count(*model: np.ndarray) -> np.ndarray:
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            x = sum((expected(b.column(0).to_pylist(), b.column(1).to_pylist(), *model) for b in batches), np.zeros(len(DEFAULT.start) * (1 + len(STATES) + len(SYMBOLS))))
            yield pa.RecordBatch.from_arrays([pa.array(range(len(x)), pa.int32()), pa.array(x)], ["at", "x"])

        sums = rows.select("seen", "n").mapInArrow(run, "at int, x double").groupBy("at").agg(F.sum("x").alias("x"))
        return np.array([r.x for r in sorted(sums.collect())])  # one number for each probability of the model

    return _fitted(count, rows.agg(F.sum("n")).first()[0] or 0, ROUNDS, PRIOR)


def page_shares(documents: DataFrame, key: str = "doc_id", text: str = "text", model: Model | None = None) -> DataFrame:
    """Per row the shares of prose, links, tags and menu, and whether it is flagged; rows are not shuffled.

    Without a model one is fitted on all the documents; each text is read once.
    """
    kind = documents.schema[key].dataType.simpleString()
    units = page_units(documents, key, text)
    if model is None:
        units = materialize(units, "page-units")
    fitted = fit(units) if model is None else model

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = list(zip(*(_shares(s, z, fitted) for s, z in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())))) or [()] * len(STATES)
            flags = [a + b > FLAG_SHARE for a, b in zip(cols[1], cols[2])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.float64()) for c in cols), pa.array(flags, pa.bool_())], ["key", "prose", "links", "tags", "menu", "flagged"])

    return units.mapInArrow(run, f"key {kind}, prose double, links double, tags double, menu double, flagged boolean").withColumnRenamed("key", key)
