"""A report of an audit in Markdown, from plain rows of one paper; every list has a cap, which is what a report is."""

from __future__ import annotations

from collections import Counter
from datetime import datetime, timezone

#: How many entries each part shows.
SHOWN = {"sentences": 60, "paragraphs": 20, "citations": 20, "words": 15, "outline": 12, "checks": 40, "warnings": 8}


def _line(s: object) -> str:
    return " ".join(str(s or "").replace("\r", "").split("\n")).strip()


def time_text(epoch: object) -> str:
    try:
        t = int(epoch or 0)
    except (TypeError, ValueError):
        t = 0
    return datetime.fromtimestamp(t, timezone.utc).strftime("%Y-%m-%d %H:%M:%S") if t > 0 else "—"


def evidence(points: object, most: int = 2) -> list[str]:
    """Where the quotations of a point come from; those without a quotation are left out."""
    out = []
    for ev in points[:most] if isinstance(points, list) else []:
        quote = _line(ev.get("quote")) if isinstance(ev, dict) else ""
        if quote:
            where = f"{ev['pdf']}#p{ev['page']}" if ev.get("pdf") and ev.get("page") else ev.get("pdf") or ""
            out.append(f"  - evidence: {f'`{_line(where)}` ' if where else ''}“{quote}”")
    return out


def _points(review: dict) -> list[str]:
    out = []
    for d in review.get("diagnosis") or []:
        out += [f"  - problem: {_line(d.get('problem'))}", f"  - suggestion: {_line(d.get('suggestion'))}", *evidence(d.get("evidence"))]
    return out + [f"  - template: `{_line(t.get('text'))}`" for t in review.get("templates") or [] if _line(t.get("text"))]


def render(result: dict) -> str:
    """The report of ``meta, summary, items, lexical, reviews, usage, citecheck``; missing parts are left out."""
    meta, summary, items = result.get("meta") or {}, result.get("summary") or {}, result.get("items") or []
    out = [f"# Audit of {_line(meta.get('doc')) or 'a paper'}", "", "## Overview", f"- made: {time_text(meta.get('created_at'))}", f"- language: {_line(meta.get('language')) or '—'}", f"- pages: {meta.get('pages') or 0}"]
    out += [f"- sentences: {summary.get('sentence_total') or 0}, compared with exemplars: {summary.get('sentence_scored') or 0}", f"- low alignment: {summary.get('low_alignment_sentences') or 0} sentences"]
    out += [f"- issues: {k} {v}" for k, v in sorted((summary.get("issue_counts") or {}).items())]
    usage = result.get("usage") or {}
    if usage.get("calls"):
        out += ["", "## Calls", f"- {usage['calls']} calls, {usage.get('tokens') or 0} tokens", *[f"- warning: {_line(w)}" for w in (usage.get("warnings") or [])[: SHOWN["warnings"]]]]
    rare = [x for x in result.get("lexical") or [] if x.get("kind") == "rare"]
    for lang in ("en", "zh"):
        some = [x for x in rare if x.get("lang") == lang][: SHOWN["words"]]
        if some:
            out += ["", f"## Words the library hardly has ({lang})", *[f"- `{_line(x['token'])}`: {x['n']} times, in {x['doc_freq']} documents of the library" for x in some]]
    reviews = result.get("reviews") or {}
    outline = reviews.get("outline") or {}
    if outline.get("issues"):
        out += ["", "## Order of sections", *[f"- {_line(x.get('problem'))}: {_line(x.get('suggestion'))}" for x in outline["issues"][: SHOWN["outline"]]]]
    low = [x for x in items if any(i.get("issue_type") == "low_alignment" for i in x.get("issues") or [])]
    asked = {str(x.get("id")): x for x in (reviews.get("sentence_alignment") or {}).get("items") or []}
    shown = ([x for x in items if str(x.get("sentence_id")) in asked] or low)[: SHOWN["sentences"]]
    if shown:
        out += ["", "## Sentences unlike the exemplars"]
        for x in shown:
            out += [f"- S{x.get('sentence_id')} p{x.get('page') or 0} {x.get('pct') or 0}%: {_line(x.get('text'))}", *([f"  - opening: `{_line(x['scaffold'])}`"] if x.get("scaffold") else []), *_points(asked.get(str(x.get("sentence_id"))) or {})]
    for name, title, cap in (("paragraph_alignment", "Paragraphs", "paragraphs"), ("citation_style", "Citing sentences", "citations"), ("lexical", "Words", "words")):
        some = ((reviews.get(name) or {}).get("items") or [])[: SHOWN[cap]]
        if some:
            out += ["", f"## {title}"]
            for x in some:
                out += [f"- {_line(x.get('paragraph_id') or x.get('sentence') or x.get('token'))}", *_points(x)]
    checks = result.get("citecheck") or []
    if checks:
        out += ["", "## Citations", *[f"- {k}: {n}" for k, n in sorted(Counter(x.get("verdict") for x in checks).items(), key=str)]]
        for x in [x for x in checks if x.get("verdict") != "ACCURATE"][: SHOWN["checks"]]:
            out.append(f"- p{x.get('page') or 0} {_line(x.get('author'))} ({_line(x.get('year'))}): {x.get('verdict')}{' – ' + _line(x['reason']) if x.get('reason') else ''}")
    return "\n".join(out) + "\n"
