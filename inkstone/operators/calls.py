"""Reviews by an injected language model: what is asked about, in which order, and what of an answer is kept.

A model is any callable ``model(messages, max_tokens) -> (status, response)``.  A budget is spent
call by call, so the calls themselves are a loop at the driver over a bounded selection (``top``
items); selecting, ordering and batching are DataFrame operators in ``review``.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from inkstone.operators.coverage import TokenBudget

Model = Callable[[list[dict], int], tuple[int, dict]]
_META = re.compile(r"^\[(?P<pdf>.+?)#p(?P<page>\d+)\]\s*")
_HAN = re.compile(r"[一-鿿]")


def _ws(s: object) -> str:
    return " ".join(str(s or "").split())


def approx_tokens(s: str) -> int:
    han = len(_HAN.findall(s))
    return max(1, int(han + (len(s) - han) / 4))


def excerpt(s: str, most: int = 380) -> str:
    s = _ws(s)
    return s if len(s) <= most else (s[: most - 1] + "…").strip()


def json_object(answer: str | None) -> dict | None:
    """The object that an answer begins with, code fences and raw line ends aside; None if there is none."""
    s = re.sub(r"^\s*```(?:json)?\s*|\s*```\s*$", "", answer or "", flags=re.I)
    at = s.find("{")
    if at < 0:
        return None
    try:
        got, _ = json.JSONDecoder().raw_decode(s[at:].replace("\r", " ").replace("\n", " "))
    except ValueError:
        return None
    return got if isinstance(got, dict) else None


def content_of(response: object) -> str:
    """The text of the first choice: a string, a list of parts, an object with a text, or the choice's own text."""
    choices = response.get("choices") if isinstance(response, dict) else None
    first = choices[0] if isinstance(choices, list) and choices and isinstance(choices[0], dict) else {}
    message = first.get("message")
    content = message.get("content") if isinstance(message, dict) else None
    if isinstance(content, str):
        return content.strip()
    if isinstance(content, dict) and isinstance(content.get("text"), str):
        return content["text"]
    if isinstance(content, list):
        parts = [p if isinstance(p, str) else p.get("text") or p.get("content") if isinstance(p, dict) else None for p in content]
        return "\n".join(p for p in parts if isinstance(p, str) and p.strip()).strip()
    return first.get("text", "").strip() if isinstance(first.get("text"), str) else ""


def tokens_of(response: object) -> int:
    """The tokens that a response says it took, 0 if it does not say."""
    usage = response.get("usage") if isinstance(response, dict) else None
    if not isinstance(usage, dict):
        return 0
    n = {k: int(usage.get(k) or 0) for k in ("prompt_tokens", "completion_tokens", "total_tokens")}
    return max(0, n["total_tokens"] or n["prompt_tokens"] + n["completion_tokens"])


@dataclass
class Caller:
    """Asks for JSON within a budget: a second try with more room, and no more calls after three refusals for validation."""

    model: Model
    budget: TokenBudget = field(default_factory=lambda: TokenBudget(0))
    system: str = "Return one JSON object and nothing else."

    @property
    def blocked(self) -> bool:
        return self.budget.errors.get("validation", 0) >= 3

    def ask(self, prompt: str, max_tokens: int = 1500) -> tuple[dict | None, str]:
        """The object and how the call went: ok, empty, blocked, budget, http_<status>, truncated or unreadable."""
        if not prompt.strip():
            return None, "empty"
        if self.blocked:
            return None, "blocked"
        how = "unreadable"
        for room, more in ((max(4096, max_tokens), ""), (max(8192, max_tokens), "\n\nThe last answer was no valid JSON. Return only one object of the wanted shape.")):
            said = prompt + more
            if self.budget.exceeds(approx_tokens(self.system) + approx_tokens(said) + room):
                self.budget.warnings.append("budget: call skipped")
                return None, "budget"
            status, response = self.model([{"role": "system", "content": self.system}, {"role": "user", "content": said}], room)
            content = content_of(response)
            self.budget.add(tokens_of(response) or approx_tokens(said) + approx_tokens(content))
            if status != 200:
                low = json.dumps(response).lower()
                if status == 403 and ("validation_required" in low or "verify your account" in low):
                    self.budget.errors["validation"] = self.budget.errors.get("validation", 0) + 1
                how = f"http_{status}"
                continue
            choices = response.get("choices") if isinstance(response, dict) else None
            if choices and isinstance(choices[0], dict) and str(choices[0].get("finish_reason") or "").lower() == "length":
                how = "truncated"
                continue
            if (got := json_object(content)) is not None:
                return got, "ok"
            how = "unreadable"
        return None, how


def evidence_key(raw: object) -> str:
    """Identifiers in one form (see ``review.evidence_id``)."""
    return re.sub(r"_+", "_", re.sub(r"[^A-Za-z0-9_]", "", str(raw or "").replace("-", "_"))).upper()


def resolve(raw: object, allowed: dict[str, str]) -> str:
    """The allowed identifier that is meant, empty if none is."""
    s = str(raw or "").strip()
    if allowed.get(s):
        return s
    want = evidence_key(s)
    return next((k for k, v in allowed.items() if v and want and evidence_key(k) == want), "")


def cited(answer: dict, allowed: dict[str, str], most: int = 180) -> bool:
    """Whether any point of an answer names an allowed piece of evidence.

    Those that do get its file and page, and a quotation that stands in it: their own if it does, else its beginning.
    """
    any_ = False
    for part in ("diagnosis", "templates", "issues", "section_template_hints"):
        for point in answer.get(part) or []:
            for ev in (point.get("evidence") or []) if isinstance(point, dict) else []:
                key = resolve(ev.get("id"), allowed) if isinstance(ev, dict) else ""
                if not key:
                    continue
                any_ = True
                ev["id"] = key
                source = _ws(allowed[key])
                meta = _META.match(source)
                if meta:
                    ev.setdefault("pdf", meta["pdf"])
                    ev.setdefault("page", int(meta["page"]))
                if not _ws(ev.get("quote")) or _ws(ev["quote"]) not in source:
                    ev["quote"] = (source[meta.end() :] if meta else source)[:most].strip()
    return any_


@dataclass(frozen=True)
class Review:
    """One kind of review: how it is named in the coverage store, which fields its items have and how much is asked at once."""

    category: str
    task: str
    key: str
    text: str
    batch: int
    most: int = 520
    room: int = 1500


#: Items of one call in a single review and in a pack of all reviews.
SENTENCES = Review("sentence_alignment", "Say for each sentence why it reads unlike the exemplars and give reusable openings; add no facts.", "id", "text", 6)
CITATIONS = Review("citation_style", "Say for each citing sentence how exemplars would cite there; keep its meaning.", "key", "sentence", 6)
PARAGRAPHS = Review("paragraph_alignment", "Say for each paragraph what its structure lacks beside the exemplars; do not rewrite it.", "paragraph_id", "text", 3, 1100)
WORDS = Review("lexical", "Say for each word whether to keep or to replace it and how.", "token", "sentence", 6, 520, 2200)
PACK = {"sentence_alignment": 10, "citation_style": 5, "paragraph_alignment": 10, "lexical": 4}


def batches(items: list[dict], size: int) -> Iterable[list[dict]]:
    for at in range(0, len(items), max(1, size)):
        yield items[at : at + max(1, size)]


def run_review(review: Review, items: list[dict], caller: Caller | None, size: int | None = None) -> dict:
    """Ask about selected items, each with ``exemplars`` (pdf, page, text); answers without allowed evidence are dropped.

    The answer has ``seen``: the stable keys of what was reviewed, to be marked in the coverage store.
    """
    if caller is None:
        return {"items": [], "seen": [], "skipped": True, "reason": "no model"}
    if not items:
        return {"items": [], "seen": [], "skipped": True, "reason": "no candidates"}
    out: dict[str, dict] = {}
    seen: list[tuple[str, int]] = []
    for batch in batches(items, size or review.batch):
        allowed: dict[str, str] = {}
        lines = [review.task, "Every point cites evidence by its id; a quotation stands in the evidence word for word.", '{"items": [{"' + review.key + '": ..., "diagnosis": [{"problem": "", "suggestion": "", "evidence": [{"id": "", "quote": ""}]}], "templates": [{"text": "", "evidence": []}]}]}']
        for i, item in enumerate(batch):
            lines.append(f"{review.key}={item[review.key]} page={item.get('page') or 0}: {excerpt(item[review.text], review.most)}")
            prefix = f"S{item[review.key]}" if review.key == "id" else str(item[review.key]) if review.key == "paragraph_id" else f"T{i}"
            for j, ex in enumerate(item.get("exemplars") or [], 1):
                allowed[f"{prefix}_E{j}"] = f"[{ex.get('pdf') or ''}#p{ex.get('page') or 0}] {excerpt(ex.get('text') or '', 520)}"
                lines.append(f"{prefix}_E{j}: {allowed[f'{prefix}_E{j}']}")
        got, _ = caller.ask("\n".join(lines), review.room)
        known = {str(x[review.key]): x for x in batch}
        for answer in (got or {}).get("items") or []:
            name = str(answer.get(review.key)) if isinstance(answer, dict) else ""
            if name in known and name not in out and cited(answer, allowed):
                out[name] = answer
                seen.append((known[name].get("stable_key") or name, int(known[name].get("page") or 0)))
    return {"items": [out[k] for k in sorted(out, key=lambda k: (len(k), k))], "seen": seen, "skipped": False}


def review_outline(headings: list[dict], outlines: list[dict], caller: Caller | None) -> dict:
    """Ask about the order of up to 80 headings beside up to 6 exemplar outlines."""
    if caller is None or not headings:
        return {"issues": [], "skipped": True, "reason": "no model" if caller is None else "no headings"}
    allowed = {f"O{i}": f"[{o.get('example') or ''}#p1] {o['outline']}" for i, o in enumerate(outlines[:6], 1)}
    lines = ["Compare the order of sections with the outlines.", '{"summary": "", "issues": [{"problem": "", "suggestion": "", "evidence": [{"id": "O1", "quote": ""}]}]}']
    lines += [f"{h.get('level', 1)} {h['title']}" for h in headings[:80]] + [f"{k}: {v}" for k, v in allowed.items()]
    got, how = caller.ask("\n".join(lines), 1500)
    if got is None:
        return {"issues": [], "skipped": True, "reason": how}
    cited(got, allowed)
    issues = [x for x in got.get("issues") or [] if isinstance(x, dict) and any(resolve(e.get("id"), allowed) for e in x.get("evidence") or [] if isinstance(e, dict))]
    return {"summary": _ws(got.get("summary")), "issues": issues, "skipped": False}


def review_pack(parts: dict[str, list[dict]], headings: list[dict], outlines: list[dict], caller: Caller | None) -> dict[str, dict]:
    """All reviews one after the other within one budget, in larger batches."""
    kinds = {r.category: r for r in (SENTENCES, CITATIONS, PARAGRAPHS, WORDS)}
    out = {"outline": review_outline(headings, outlines, caller)}
    return out | {name: run_review(kinds[name], items, caller, PACK[name]) for name, items in parts.items()}


#: The classes that headings may be given.
HEADING_CLASSES = "abstract introduction related_work data methods results robustness conclusion appendix references acknowledgements figure_table other".split()


def label_headings(headings: list[dict], caller: Caller | None) -> dict[int, str]:
    """Classes for the headings of a document by their number; only asked if one is of no class."""
    if caller is None or not any(h["canonical"] == "other" for h in headings):
        return {}
    lines = ["Give each heading one class of: " + ", ".join(HEADING_CLASSES), '{"labels": [{"i": 0, "canonical": ""}]}'] + [f"{h['ord']}. {h['title']}" for h in headings]
    got, _ = caller.ask("\n".join(lines), 900)
    labels = (got or {}).get("labels")
    return {x["i"]: x["canonical"] for x in labels if isinstance(x, dict) and isinstance(x.get("i"), int) and x.get("canonical") in HEADING_CLASSES} if isinstance(labels, list) else {}


#: Verdicts by how they begin, and how long their texts may be.
VERDICTS = (("ACC", "ACCURATE"), ("INACC", "INACCURATE"), ("MIS", "MISATTRIBUTED"), ("NOT", "NOT_FOUND"))
LONGEST = {"claim": 220, "reason": 800, "suggested_fix": 320}


def verdict_of(answer: dict | None, how: str = "ok") -> dict:
    """A verdict with its confidence and cut texts; PARSE_ERROR if there is none to be read, ERROR if the call failed."""
    raw = str((answer or {}).get("verdict") or "").strip().upper()
    name = next((v for p, v in VERDICTS if raw.startswith(p)), None)
    if name is None:
        failed = how.startswith("http_") or how in ("budget", "blocked")
        return {"verdict": "ERROR" if failed else "PARSE_ERROR", "confidence": 0.0, "claim": "", "reason": how, "suggested_fix": ""}
    try:
        sure = float(answer.get("confidence", 0.5))
    except (TypeError, ValueError):
        sure = 0.5
    cut = {k: t if len(t := str(answer.get(k) or "").strip()) <= n else t[:n] + "…" for k, n in LONGEST.items()}
    return {"verdict": name, "confidence": sure, **cut}


def verify_citation(item: dict, caller: Caller) -> dict:
    """Ask whether a cited paper says what the sentence says, by the paper's beginning and the evidence passages."""
    lines = ["Does the evidence support the citing sentence?", '{"verdict": "ACCURATE|INACCURATE|MISATTRIBUTED|NOT_FOUND", "confidence": 0.0, "claim": "", "reason": "", "suggested_fix": ""}']
    lines += [f"sentence: {item['sentence']}", f"cited: {item['author']} ({item['year']}) {item.get('title') or ''}", f"paper: {(item.get('summary') or '')[:2000]}"]
    lines += [f"evidence p{e.get('page')}: {e.get('text')}" for e in item.get("evidence") or []]
    return verdict_of(*caller.ask("\n".join(lines), 1200))


# --- polished sentences ---------------------------------------------------------------------

_FIGURES = re.compile(r"\d+(?:\.\d+)?")
_PROPER = re.compile(r"\b[A-Z][a-z]{2,}\b")
#: Capitalised words that are no names, and what stands for a numbered part.
COMMON_CAPITALS = "This These Those Overall Taken Consistent Specifically Moreover Finally First Second Third However Importantly Notably Accordingly Therefore Thus Additionally Further Furthermore Similarly Consequently Nevertheless".split()
PARTS = [
    (r"(?i)\bsection\s+\d+(?:\.\d+)*\b", "this section"), (r"(?i)\btable\s+\d+(?:\.\d+)*\b", "the table"), (r"(?i)\b(?:figure|fig\.)\s*\d+(?:\.\d+)*\b", "the figure"), (r"(?i)\bchapter\s+\d+(?:\.\d+)*\b", "this chapter"),
    (r"第\s*\d+\s*章", "本章"), (r"第\s*\d+\s*节", "本节"), (r"第\s*\d+\s*部分", "本部分"), (r"图\s*\d+", "该图"), (r"表\s*\d+", "该表"),
]


def placeholder(s: str) -> bool:
    """Whether a text says nothing: empty, dots, or a mark that something is to be done."""
    t = (s or "").strip()
    return not t.strip(".…") or t.lower() in ("todo", "tbd", "n/a", "na")


def meaningful_length(s: str) -> int:
    """Characters without white space and marks."""
    return len(re.sub(r"[\s\"'`.,;:!?()\[\]{}<>/\\|=_+\-—–…·•]+", "", s or ""))


def _tidy(s: str) -> str:
    s = re.sub(r"\s+([,.;:!?)\]}])", r"\1", re.sub(r"([(\[{])\s+", r"\1", " ".join(re.sub(r"\(\s*\)", "", s).split())))
    return re.sub(r",\s*,", ",", s).strip()


def without_new(rewrite: str, source: str) -> str:
    """A rewrite without square brackets, figures and names that its source does not have."""
    s = rewrite
    if "[" not in source and "]" not in source:
        s = re.sub(r"\[[^\]]*\]|[\[\]]", "", s)
    known = set(_FIGURES.findall(source))
    if set(_FIGURES.findall(s)) - known:
        for pattern, word in PARTS:
            s = re.sub(pattern, word, s)
        s = _FIGURES.sub(lambda m: m.group() if m.group() in known else "", s)
    names = set(_PROPER.findall(source)) | set(COMMON_CAPITALS)
    s = _tidy(s)
    begins = {m.end() for m in re.finditer(r"^\s*|[.!?\n]\s*", s)}
    return _tidy(_PROPER.sub(lambda m: m.group() if m.group() in names or m.start() in begins else "", s))


#: Levels of rewrites, and how many diagnoses an answer has.
LEVELS, DIAGNOSES = ("light", "medium"), 3


def checked_polish(answer: dict, allowed: dict[str, str], source: str) -> dict:
    """A polish answer that only says what it may: three diagnoses at most with evidence, one rewrite of each level.

    Missing rewrites are the source itself; an answer without any variants raises ValueError.
    """
    if not isinstance(answer, dict) or not isinstance(answer.get("variants"), list) or not answer["variants"]:
        raise ValueError("no variants")
    language = str(answer.get("language") or "").strip().lower()

    def evidence(given: object) -> list[dict]:
        out = []
        for ev in given if isinstance(given, list) else []:
            key = str(ev.get("id") or "").strip() if isinstance(ev, dict) else ""
            if key not in allowed or not str(ev.get("quote") or "").strip() or ev["quote"].strip() not in allowed[key]:
                continue
            meta = _META.match(allowed[key])
            pdf, page = (meta["pdf"], int(meta["page"])) if meta else ("", 0)
            if str(ev.get("pdf") or pdf).replace("\\", "/") == pdf and int(ev.get("page") or page) == page:
                out.append({"id": key, "pdf": pdf, "page": page, "quote": ev["quote"].strip()})
        return out

    def fallback(most: int) -> list[dict]:
        out = []
        for key, text in list(allowed.items())[:most]:
            meta = _META.match(text)
            out.append({"id": key, "pdf": meta["pdf"] if meta else "", "page": int(meta["page"]) if meta else 0, "quote": (text[meta.end() :] if meta else text)[:220].strip()})
        return out

    diagnosis = []
    for d in answer.get("diagnosis") or []:
        if not isinstance(d, dict) or meaningful_length(d.get("title") or "") < 3 or meaningful_length(d.get("suggestion") or "") < 8 or placeholder(d.get("title")) or placeholder(d.get("suggestion")):
            continue
        ev = evidence(d.get("evidence")) or fallback(1)
        if ev:
            diagnosis.append({"title": d["title"].strip(), "problem": "" if placeholder(d.get("problem") or "") else d["problem"].strip(), "suggestion": d["suggestion"].strip(), "evidence": ev})
    variants: dict[str, dict] = {}
    for v in answer["variants"]:
        level = str(v.get("level") or "").strip().lower() if isinstance(v, dict) else ""
        text = str(v.get("rewrite") or "").strip() if level in LEVELS else ""
        if level not in LEVELS or level in variants or placeholder(text) or meaningful_length(text) < 12:
            continue
        kept = without_new(text, source) if source else text
        changes = [str(c).strip() for c in v.get("changes") or [] if str(c).strip()] if isinstance(v.get("changes"), list) else []
        variants[level] = {"level": level, "rewrite": kept, "changes": changes + (["what the source does not have was taken out"] if kept != text else []), "citations": evidence(v.get("citations")) or fallback(2)}
    for level in LEVELS:
        variants.setdefault(level, {"level": level, "rewrite": source, "changes": ["no rewrite: the source"], "citations": fallback(2)})
    return {"language": language if language in ("zh", "en", "mixed") else "mixed", "diagnosis": diagnosis[:DIAGNOSES], "variants": [variants[x] for x in LEVELS]}
