"""Headings, sentences, citations, pages, audits, reviews and libraries on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from inkstone import cli
from inkstone.api import PROFILES, Engine
from inkstone.functions import citing, headings, prose, segment
from inkstone.functions import text as T
from inkstone.operators import audit, calls, citations, citecheck, coverage, documents, libraries, pages, retrieval, review
from inkstone.report import render


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "s string").select(column.alias("x")).first().x




@pytest.mark.parametrize(
    "text, language, want",
    [
        ("1 Introduction", "en", True), ("We study risk", "en", False), ("Table 2: x", "en", True), ("结论与展望", "zh", True), ("Data and Methods", "en", True), ("THE RESULTS", "en", True), ("The River Is Long", "en", False),
        ("note that:", "en", True), ("# Head", "en", True), ("* item", "en", False), ("- item x", "en", True), ("Conclusion and future work", "en", True), ("", "en", False), ("  ", "zh", False), (None, "en", False),
        ("一、研究背景", "zh", True), ("（二）数据", "mixed", True), ("图 3", "zh", True), ("2. It rose. It fell.", "en", True), ("1.1 It rose.", "en", False), ("河水在五月上涨。", "zh", False), ("x_1 + y^2 = {z} - 3", "en", True),
    ],
)
def test_heading_like(spark, text, language, want):
    assert one(spark, text, headings.heading_like(F.col("s"), F.lit(language))) is want


def test_levels_and_classes(spark):
    got = [(one(spark, h, headings.level(F.col("s"), F.lit("mixed"))), one(spark, h, headings.canonical(F.col("s"), F.lit("mixed")))) for h in ("2.3.1 Data", "（一）引言", "第三章 结论与数据", "Literature", "Additional tests", "Table 2 x", "8.1.1.1.1.1.1 X")]
    assert got == [(3, "data"), (2, "introduction"), (1, "data"), (1, "related_work"), (1, "robustness"), (1, "other"), (6, "other")]
    assert one(spark, "Table 2 x", headings.canonical(F.col("s"), F.lit("en"), strict_compat=False)) == "figure_table"


def test_soft_breaks_keep_the_length(spark):
    text = "a soft\nwrap here\n\nnew para\n1. item\nnext\n2 Data\nplain text of some length here"
    got = one(spark, text, segment.join_soft_breaks(F.col("s")))
    assert got == "a soft wrap here\n\nnew para\n1. item\nnext\n2 Data\nplain text of some length here" and len(got) == len(text)


@pytest.mark.parametrize(
    "text, language, want",
    [
        ("It is 3.14 today. Then it fell, e.g. in May. See Fig. 3 for more!", "en", ["It is 3.14 today.", "Then it fell, e.g. in May.", "See Fig. 3 for more!"]),
        ("1 Introduction\nIt rose in May\nand fell.", "en", ["1 Introduction", "It rose in May\nand fell."]),
        ("河水上涨。后来呢？好；是的", "zh", ["河水上涨。", "后来呢？", "好；", "是的"]), ("One.\n\nTwo", "en", ["One.", "Two"]), ("- a. b. c\nNext one. Two", "en", ["- a. b. c", "Next one.", "Two"]),
        ("et al. (2020) say. No", "en", ["et al. (2020) say.", "No"]), ("1. First item. It goes on", "en", ["1. First item. It goes on"]), ("", "en", []), (None, "en", []), (" \n ", "zh", []),
    ],
)
def test_sentences_with_positions(spark, text, language, want):
    df = spark.createDataFrame([(1, text, "x")], "k int, t string, start string")
    rows = segment.with_sentences(df, "t", F.lit(language)).first().sentences
    assert [r.text for r in rows] == want and all(text[r.start : r.end] == r.text for r in rows)


def test_citation_splitter(spark):
    text = "We cite Roe et al. (2001), e.g. here. It cost 3.5 in (May). and more.Next one! \"Yes.\" Dr. Roe\n\nLast"
    assert one(spark, text, prose.citation_sentences(F.col("s"))) == ["We cite Roe et al. (2001), e.g. here.", "It cost 3.5 in (May). and more.", "Next one!", '"Yes."', "Dr. Roe", "Last"]


def test_citations(spark):
    text = "Smith and Doe (2020, 2021) and Lee et al. (2019a) show (see Chan et al., 2018; 2019; cf. Ito, 2001a, b), 张三、李四（2020）认为 (Table 2, 2019), Panel (2001), (2003), (no year, here)"
    got = [(x.kind[0], x.authors, x.year) for x in one(spark, text, citing.citations(F.col("s")))]
    assert got == [("n", "Smith and Doe", "2020"), ("n", "Smith and Doe", "2021"), ("n", "Lee et al.", "2019a"), ("n", "张三、李四", "2020"), ("p", "2020", "2021"), ("p", "Chan et al.", "2018"), ("p", "Chan et al.", "2019"), ("p", "Ito", "2001a"), ("p", "Ito", "2001b")]
    assert one(spark, None, citing.citations(F.col("s"))) == [] and one(spark, "nobody", citing.citations(F.col("s"))) == []
    assert one(spark, "2019a, b; 1899 and 12019", citing.years(F.col("s"))) == ["2019a", "1899", "2019b"]
    assert [one(spark, r, citing.reference_authors(F.col("s"))) for r in ("[3] Smith, J. (2020). A.", "Doe 2019 B.", "no year")] == ["Smith, J.", "Doe", ""]


PAGES = [
    ("d", 1, "Journal of Rivers 1\n1 Introduction\nAccording to Smith (2020), liquidity affects returns. We use rivers (Doe, 2019) here.\n2 Data\nThe data come from towns in the north of the land."),
    ("d", 2, "Journal of Rivers 2\nMore text here about rivers, which rose in May.\nReferences\nSmith, J. (2020). A title of something.\nthat goes on\n[2] no year here\n[3] Doe 2019 B."), ("d", 3, "Journal of Rivers 3\nRoe, K. 2001. Third. 12\n3"),
]


def test_material_documents(spark):
    df = spark.createDataFrame(PAGES + [("e", 1, None)], "doc string, page int, text string")
    m = pages.material(df)
    assert [(r.id, r.parent, r.title, r.canonical) for r in m["sections"].orderBy("ord").collect()] == [("S0", "", "1 Introduction", "introduction"), ("S1", "", "2 Data", "data")]
    body = m["paragraphs"].orderBy("par").collect()
    assert [(r.id, r.section, len(r.sentences)) for r in body] == [("P0", "S0", 2), ("P1", "S1", 1), ("P2", "S1", 1)]
    assert [[c.year for c in r.citations] for r in m["citations"].orderBy("sent_no").collect()] == [["2020"], ["2019"]]
    assert [(r["index"], r.page, r.authors, r.year) for r in m["references"].orderBy("index").collect()] == [(1, 2, "Smith, J.", "2020"), (3, 2, "Doe", "2019"), (4, 3, "Roe, K", "2001")]
    meta = {r.doc: r for r in m["meta"].collect()}
    assert (meta["d"].pages_total, meta["d"].citation_sentence_count, meta["d"].reference_count) == (3, 2, 3) and meta["e"].reference_count == 0
    assert pages.outlines(m["sections"]).first().outline == "introduction > data"
    better = pages.sections(df, label=lambda h: h.select("doc", "ord", F.lit("methods").alias("canonical")))[0]
    assert {r.canonical for r in better.collect()} == {"methods"}


def test_running_heads_and_page_edges(spark):
    rows = [("d", p, f"A Journal of Rivers\n{p}\nbody {'abcde'[p]} of the page\nmore {'lmnop'[p]}\nand so it {'vwxyz'[p]} ends\nlast {'fghij'[p]} line") for p in range(5)]
    df = spark.createDataFrame(rows, "doc string, page int, text string")
    got = pages.strip_page_edges(df).where("page = 0").first().text
    assert got.startswith("body a") and got.endswith("last f line")
    few = pages.strip_page_edges(df.where("page < 3")).where("page = 0").first().text
    assert few.startswith("A Journal")


def test_passages(spark):
    short = "\n\n".join(["a short paragraph of words"] * 3)
    df = spark.createDataFrame([("d", 1, short), ("d", 2, "x" * 950 + "\n\n" + "y" * 70 + "\n\nz"), ("d", 3, None)], "doc string, page int, text string")
    got = [(r.id, len(r.text)) for r in pages.passages(df).orderBy("page", "chunk").collect()]
    assert got == [("d#p1#0", 80), ("d#p2#0", 900), ("d#p2#1", 70)]


def test_short_family_names(spark):
    sent = spark.createDataFrame([(1, "p", [("n", "Li", "2020", "")]), (2, "p", [("n", "张三", "2020", "")])], "sentence_id long, pdf string, citations array<struct<kind string, authors string, cite_year string, raw string>>")
    refs = spark.createDataFrame([(5, "p", 1, "Liu policy 2020", "Liu, M.", "2020"), (6, "p", 2, "x", "Li, M.", "2020"), (7, "p", 3, "x", "李四", "2020"), (8, "p", 4, "x", "张三", "2020")], "ref_id long, pdf string, entry_index int, reference string, authors string, pub_year string")
    assert sorted((r.sentence_id, r.ref_id) for r in citations.match_references(sent, refs).collect()) == [(1, 6), (2, 8)]


def test_scaffolds(spark):
    assert one(spark, "In this paper, we study how risk premia vary with market conditions.", documents.scaffold(F.col("s"))) == "In this paper,"
    assert one(spark, "[a#p1] Results are, in particular, large", documents.scaffold(F.col("s"))) == "in particular,"
    assert one(spark, "Rivers 12 rose x1 in May and then fell again", documents.scaffold(F.col("s"))) == "Rivers rose in May and then"
    zh = one(spark, "本文  主要  研究：市场条件与风险溢价之间的关系；后来", documents.scaffold(F.col("s"), F.lit("zh")))
    assert zh.startswith("本文主要研究") and len(zh) <= 16


def test_tokens_and_languages(spark):
    assert one(spark, "über a中文b 3.5!", T.pieces(F.col("s"))) == ["ü", "ber", " ", "a", "中文", "b", " ", "3", ".", "5", "!"]
    assert one(spark, "ab 3.5 中文!", T.rough_tokens(F.col("s"))) == ["ab", "3.5", "中", "文", "!"]
    assert one(spark, "the 河水 rose", T.streams(F.col("s"), F.lit("mixed"))) == {"en": ["the", "rose"], "zh": ["河", "水"]}
    words = one(spark, "本文 河水 上涨 的", T.han_words(F.col("s"), lambda s: F.split(s, " ")))
    assert words == ["河水", "上涨"] and one(spark, "河水", T.han_words(F.col("s"))) == []
    assert [one(spark, x, T.primary_language(F.col("s"))) for x in ("中文a", "中ab", "中abcdef", "12")] == ["zh", "en", "en", "en"]
    assert [one(spark, x, T.sentence_language(F.col("s"))) for x in ("中a", "中", "a", "12")] == ["mixed", "zh", "en", "en"]


def _papers(spark):
    text = "This paper studies how risk premia vary with the market. This paper studies how risk premia vary with the towns. This paper studies how risk premia vary with the rivers (as we saw."
    return spark.createDataFrame([("p", 1, "1 Introduction\n" + text), ("p", 2, "Moreover, it is worth noting that rivers rose in May and fell again later.")], "doc string, page int, text string")


def test_audit_of_a_paper(spark, tmp_path):
    assert (PROFILES["cheap"].top_k, PROFILES["cheap"].max_pairs, PROFILES["cheap"].max_sentences) == (12, 300, 1600)
    engine = Engine(spark, str(tmp_path / "lib"), "deep", citecheck.hashed_embedding())
    library = spark.createDataFrame([("l.pdf", p, f"Overall, the quiet river rose in May and nobody had expected so much water near bridge {p} of the town that year.") for p in range(1, 6)], "doc string, page int, text string")
    assert "passages" in engine.fit_pages(library) and engine.fit_pages(library) == []
    out = engine.run(_papers(spark))
    sents = out["sentences"].orderBy("sentence_id").collect()
    assert [r.sentence_id for r in sents] == [0, 1, 2, 3, 4] and sents[0].text == "1 Introduction" and sents[4].page == 2
    kinds = {(r.sentence_id, r.issue_type) for r in out["issues"].collect()}
    assert {(i, "repetition") for i in (1, 2, 3)} <= kinds and (4, "ai_transition") in kinds and not any(i == 0 for i, _ in kinds)
    items = out["items"].orderBy("position").collect()
    assert all(i.scaffold == "Overall," for i in items if i.pct > 0) and [i.score for i in items] == sorted(i.score for i in items)
    low = audit.items(out["sentences"], out["issues"], out["aligned"], 0.999).orderBy("position").first()
    assert any(x.issue_type == "low_alignment" for x in low.issues)
    s = out["summary"].first()
    assert (s.sentence_total, s.sentence_scored) == (5, 4) and s.issue_counts["repetition"] == 3 and s.style_issue_sentences == 1
    first = out["diagnoses"].orderBy("position").first()
    assert first.sentence_id == 4 and first.issues[0].issue_type == "ai_transition"
    report = engine.export(out, "p", str(tmp_path / "out"))
    assert report.startswith("# Audit of p") and "- low alignment: " in report and json.loads((tmp_path / "out" / "result.json").read_text())["meta"] == {"doc": "p"}


def test_scores(spark):
    from inkstone.operators import style

    def score(phrase, syntax):
        cols = [F.lit(x) for x in (0.4, 0.2)] + [F.lit(phrase).cast("double"), F.lit(0.5), F.lit(0.5), F.lit(0.5)] + ([F.lit(0.5)] if syntax else [])
        return spark.range(1).select(style.weirdness(*cols).alias("x")).first().x

    word, half = 1.25 * 0.4 + 0.75 * 0.2, 0.55
    want = {
        (0.5, True): 0.32 * word + 0.26 * 0.8 + 0.12 * 0.6 + 0.10 * 0.5 + 0.14 * half + 0.06 * half, (0.5, False): 0.34 * word + 0.28 * 0.8 + 0.13 * 0.6 + 0.10 * 0.5 + 0.15 * half,
        (None, True): 0.46 * word + 0.19 * 0.6 + 0.15 * 0.5 + 0.14 * half + 0.06 * half, (None, False): 0.50 * word + 0.20 * 0.6 + 0.15 * 0.5 + 0.15 * half,
    }
    assert {k: score(*k) for k in want} == {k: round(100 * v) for k, v in want.items()}


def test_issues_by_position_and_syntax(spark):
    sents = spark.createDataFrame([("d", 0, 0, 5), ("d", 1, 6, 9)], "doc string, sentence_id int, start int, end int")
    pos = spark.createDataFrame([("d", 4), ("d", 5), ("d", 6), ("d", 9)], "doc string, pos int")
    assert sorted((r.pos, r.sentence_id) for r in audit.at_position(sents, pos).collect()) == [(4, 0), (6, 1)]
    text = "the quiet river rose in may and fell again"
    tagged = spark.createDataFrame([("d", 0, text, "en", list("ABCDEF")), ("d", 1, text, "en", list("ABABAB")), ("d", 2, "short one", "en", list("ABCDEF"))], "doc string, sentence_id int, text string, lang string, upos array<string>")
    known = spark.createDataFrame([("A B",), ("B A",)], "pair string")
    assert [(r.sentence_id, r.issue_type) for r in audit.syntax_issues(tagged, known).collect()] == [(0, "syntax_outlier")]
    assert audit.syntax_issues(tagged, known, tagged.where("sentence_id = 1")).count() == 0


def test_retrieval(spark):
    v = spark.createDataFrame([(i, [float(i % 5), 1.0], "References of x" if i == 4 else f"t{i}") for i in range(12)], "vec_id long, embedding array<double>, text string")
    q = v.where("vec_id < 3")
    got = [(r.query_id, r.vec_id, r.rank) for r in retrieval.block_top_k(v, q, 2, query_block=2, row_block=5).collect()]
    brute = []
    rows = {r.vec_id: r.embedding for r in v.collect()}
    for i in range(3):
        best = sorted(rows, key=lambda j: (-round(sum(a * b for a, b in zip(rows[i], rows[j])), 6), j))[:2]
        brute += [(i, j, k) for k, j in enumerate(best, 1)]
    assert sorted(got) == brute
    assert {r.vec_id for r in retrieval.search(v, q.where("vec_id = 1"), 2).collect()} == {9}  # one hit is a list of references
    assert retrieval.block_top_k(v.limit(0), q, 2).count() == 0
    keyed = retrieval.keyed_top_k(q.select(F.lit("a").alias("k"), F.col("vec_id").alias("query_id"), "embedding"), v.select(F.when(F.col("vec_id") < 6, "a").otherwise("b").alias("k"), F.col("vec_id").alias("row_id"), "embedding"), "k", 1)
    assert {r.row_id for r in keyed.where("query_id = 1").collect()} == {4}
    hits = spark.createDataFrame([(1, 1, 0.51, "p", 2, "x" * 700), (1, 2, -0.2, "p", 3, "y"), (2, 1, -0.1, "p", 1, "z")], "query_id long, rank int, score double, pdf string, page int, text string")
    a = {r.query_id: r for r in retrieval.alignment(hits).collect()}
    assert (a[1].pct, a[2].score, a[2].low_alignment) == (51, 0.0, True) and len(a[1].exemplars[0].text) == 651


def test_citation_check(spark):
    main = spark.createDataFrame([("m", 1, "According to Smith (2020), liquidity affects the returns of towns. Roe (1999) disagrees. Poe (2011) too."), ("m", 2, "References\nSmith, J. (2020). How liquidity shapes returns in towns. J.\nPoe, K. (2011). A wholly lost paper about salt. J.\nLee, M. (2001). Never cited here at all. J.")], "doc string, page int, text string")
    papers = spark.createDataFrame([("x/Smith_2020_liquidity.pdf", 1, "How liquidity shapes returns in towns\n\nWe show that liquidity affects the returns of many small towns in the north. It is robust.\n\nshort.")], "doc string, page int, text string")
    embed = citecheck.hashed_embedding()
    some = citecheck.pairs(pages.citation_sentences(main))
    refs = pages.reference_entries(main)
    got = {(r.author, r.year): r for r in citecheck.check(some, refs, papers, embed).collect()}
    assert {k: v.verdict for k, v in got.items()} == {("Smith", "2020"): "EVIDENCE_ONLY", ("Roe", "1999"): "REF_NOT_FOUND", ("Poe", "2011"): "PDF_NOT_FOUND"}
    assert got["Smith", "2020"].pdf == "x/Smith_2020_liquidity.pdf" and got["Smith", "2020"].evidence[0].text.startswith("We show")
    assert [r.authors for r in citecheck.uncited(some, refs).collect()] == ["Lee, M."]
    missing = citecheck.missing_papers(some, refs, papers, embed).collect()
    assert [(r.author, r.year) for r in missing] == [("Poe, K.", "2011")] and missing[0].candidates[0].filename == "Smith_2020_liquidity.pdf"
    store = spark.createDataFrame([], "category string, key string, count long, page long, first_seen_at timestamp, last_seen_at timestamp")
    assert citecheck.select_pairs(some, store, 2).count() == 2


def test_coverage_pages_and_meta(spark):
    empty = spark.createDataFrame([], "category string, key string, count long, page long, first_seen_at timestamp, last_seen_at timestamp, meta map<string,string>")
    marks = spark.sql("SELECT * FROM VALUES ('c','k',3L,timestamp'2024-01-01',map('a','1')), ('c','k',0L,timestamp'2024-01-02',map('a','2','b','3')), ('c',' ',1L,timestamp'2024-01-01',map('a','1')) t(category,key,page,seen_at,meta)")
    r = coverage.mark_seen(empty, marks).collect()
    assert len(r) == 1 and (r[0]["count"], r[0].page, r[0].meta) == (2, 3, {"a": "2", "b": "3"})
    assert coverage.clear(coverage.mark_seen(empty, marks), "c").count() == 0
    files = spark.createDataFrame([("a", 1, 1)], "path string, size long, mtime long")
    more = spark.createDataFrame([("a", 1, 1), ("b", 1, 1)], "path string, size long, mtime long")
    assert coverage.still_valid(files, more, "m", "m").first().valid and not coverage.still_valid(more, files, "m", "m").first().valid and not coverage.still_valid(files, more, "m", "n").first().valid
    assert [r.path for r in coverage.to_rebuild(files, more).collect()] == ["b"]
    budget = coverage.TokenBudget(0, rate=2e6, max_cost=100)
    assert [budget.allow(n) for n in (30, 30, 20)] == [True, False, True] and budget.cost() == 100.0


class Stub:
    def __init__(self, *answers):
        self.answers, self.asked = list(answers), []

    def __call__(self, messages, max_tokens):
        self.asked.append((messages[-1]["content"], max_tokens))
        status, body = self.answers.pop(0) if len(self.answers) > 1 else self.answers[0]
        return status, body if isinstance(body, dict) and ("error" in body or "choices" in body) else {"choices": [{"message": {"content": json.dumps(body) if not isinstance(body, str) else body}}], "usage": {"total_tokens": 10}}


def test_reviews_with_a_stub():
    item = {"id": 12, "page": 3, "text": "We study risk.", "exemplars": [{"pdf": "a.pdf", "page": 2, "text": "In this paper, we  study rivers."}], "stable_key": "sa_1"}
    answer = {"items": [{"id": 12, "diagnosis": [{"problem": "x", "evidence": [{"id": "s12-e1", "quote": "not there"}]}]}, {"id": 99, "diagnosis": []}]}
    caller = calls.Caller(Stub((200, answer)))
    got = calls.run_review(calls.SENTENCES, [item], caller)
    assert [x["id"] for x in got["items"]] == [12] and got["seen"] == [("sa_1", 3)] and not got["skipped"]
    assert got["items"][0]["diagnosis"][0]["evidence"][0] == {"id": "S12_E1", "quote": "In this paper, we study rivers.", "pdf": "a.pdf", "page": 2}
    assert calls.run_review(calls.SENTENCES, [item], None)["reason"] == "no model" and caller.budget.used == 10
    para = {"paragraph_id": "P0", "page": 1, "text": "A long one.", "exemplars": [{"pdf": "a", "page": 1, "text": "x"}]}
    got = calls.run_review(calls.PARAGRAPHS, [para], calls.Caller(Stub((200, {"items": [{"paragraph_id": "P0", "templates": [{"text": "t", "evidence": [{"id": "P0_E1"}]}]}]}))))
    assert len(got["items"]) == 1
    out = calls.review_outline([{"title": "Intro"}], [{"outline": "introduction > data", "example": "a"}], calls.Caller(Stub((200, {"issues": [{"problem": "p", "evidence": [{"id": "O1"}]}]}))))
    assert not out["skipped"] and len(out["issues"]) == 1
    assert calls.label_headings([{"ord": 0, "title": "Odd", "canonical": "other"}], calls.Caller(Stub((200, {"labels": [{"i": 0, "canonical": "data"}, {"i": 1, "canonical": "nonsense"}]})))) == {0: "data"}


def test_calls_and_budgets():
    stub = Stub((200, "no json"), (200, '```json\n{"a": 1}\n```'))
    assert calls.Caller(stub).ask("x") == ({"a": 1}, "ok") and [m for _, m in stub.asked] == [4096, 8192]
    assert calls.Caller(Stub((200, {"choices": [{"finish_reason": "length", "message": {"content": "{}"}}]}))).ask("x") == (None, "truncated")
    refused = calls.Caller(Stub((403, {"error": {"message": "Verify your account"}})))
    assert refused.ask("x") == (None, "http_403") and refused.ask("x")[1] == "http_403" and refused.ask("x") == (None, "blocked")
    assert calls.Caller(Stub((200, {})), coverage.TokenBudget(100)).ask("x") == (None, "budget")
    assert calls.verdict_of({"verdict": "misquoted", "claim": "c" * 300})["verdict"] == "MISATTRIBUTED" and len(calls.verdict_of({"verdict": "acc", "claim": "c" * 300})["claim"]) == 221
    assert calls.verdict_of(None, "http_500")["verdict"] == "ERROR" and calls.verdict_of({})["verdict"] == "PARSE_ERROR"
    assert calls.verify_citation({"sentence": "s", "author": "a", "year": "2"}, calls.Caller(Stub((200, {"verdict": "NOT FOUND", "confidence": "x"}))))["confidence"] == 0.5
    assert calls.content_of({"choices": [{"message": {"content": [{"text": "a"}, "b"]}}]}) == "a\nb" and calls.content_of({"choices": [{"text": " t "}]}) == "t" and calls.content_of(None) == ""


def test_polish():
    source = "The river Foobar rose by 12 percent in May."
    assert calls.without_new("In Section 3, Foobar rose by 12 percent, as Quuxley shows [4] for 1999.", source) == "In this section, Foobar rose by 12 percent, as shows for."
    allowed = {"C1": "[a.pdf#p2] In this paper, rivers rise."}
    answer = {"language": "EN", "diagnosis": [{"title": "Opening", "suggestion": "Begin with the scope.", "evidence": [{"id": "C1", "quote": "rivers rise"}]}, {"title": "…", "suggestion": "Begin with the scope."}], "variants": [{"level": "light", "rewrite": "The river Foobar rose by 12 percent in May of that year.", "citations": [{"id": "C1", "page": 9, "quote": "rivers"}]}, {"level": "light", "rewrite": "Another rewrite of it."}]}
    got = calls.checked_polish(answer, allowed, source)
    assert got["language"] == "en" and len(got["diagnosis"]) == 1 and [v["level"] for v in got["variants"]] == ["light", "medium"]
    assert got["variants"][1]["rewrite"] == source and got["variants"][0]["citations"][0]["page"] == 2
    with pytest.raises(ValueError):
        calls.checked_polish({}, allowed, source)
    assert calls.placeholder("…") and calls.placeholder("TBD") and not calls.placeholder("x") and calls.meaningful_length("a, b.") == 2


def test_review_columns(spark):
    c = F.col
    row = spark.createDataFrame([(" S12 - E1", "a.pdf", "http://x.example/", "[a b.pdf#p3] The quiet river rose", "x\ny", 403, "please Verify your account")], "e string, p string, u string, t string, m string, st int, b string")
    got = row.select(review.evidence_id(c("e")), review.base_url(c("u")), review.evidence_source(c("t")), review.snippet(c("t"), "river"), review.escaped(c("m")), review.transient(c("st"), c("b")), review.source_name(c("p"), F.lit(2)), review.number(F.lit("x"), 7.0), review.time_text(F.lit(0))).first()
    assert tuple(got) == ("S12_E1", "http://x.example/v1", ("a b.pdf", 3), "The quiet river rose", "x y", True, "a.pdf#p2", 7.0, "—")
    found = spark.createDataFrame([(1, 0, 0, None, "d1", None), (1, 0, 1, 2000, "d2", "u"), (1, 0, 2, 1990, "d3", "u"), (2, 1, 0, None, "d4", None)], "w int, service int, position int, year int, doi string, pdf_url string")
    assert sorted((r.w, r.doi) for r in review.open_access(found, "w", F.lit(2001)).collect()) == [(1, "d2"), (2, "d4")]
    paras = spark.createDataFrame([("d", "P0", 0, 9, "word " * 130, [("The oracle rose.",)])], "doc string, id string, par int, page int, text string, sentences array<struct<text string>>")
    assert review.paragraph_candidates(paras).first().score == pytest.approx(1.0 + 0.25 + 649 / 900)
    heads = spark.createDataFrame([("d", 0, 1, "An Oracle Head")], "doc string, ord int, page int, title string")
    tokens = spark.createDataFrame([("d", "oracle", "en"), ("d", "head", "en"), ("d", "racle", "en")], "doc string, token string, lang string")
    assert {r.token: r.sentence for r in review.token_contexts(tokens, paras, heads).collect()} == {"oracle": "The oracle rose.", "head": "An Oracle Head"}


def test_libraries(spark, tmp_path):
    names = spark.createDataFrame([("finance_2026", "exemplar"), ("refs_finance", "references"), ("citecheck_papers", None), ("reform_papers", None), ("a-refs", None), ("x", "other")], "n string, k string")
    assert [r[0] for r in names.select(libraries.kind(F.col("n"), F.col("k"))).collect()] == ["exemplar", "references", "references", "exemplar", "references", "exemplar"]
    lib = libraries.Libraries(str(tmp_path / "libs"))
    lib.create("My refs", "references")
    assert lib.exists("My refs") and " " not in lib.path("My refs") and lib.rename("My refs", "b") and lib.kind("b") == "references" and lib.clear("b") and lib.kind("b") == "references" and lib.delete("b") and lib.list() == []
    (tmp_path / "pdfs" / "sub").mkdir(parents=True)
    for name in ("B.pdf", "sub/a.pdf", "c.txt"):
        (tmp_path / "pdfs" / name).write_bytes(b"one\ftwo")
    files = libraries.discover(spark, str(tmp_path / "pdfs"))
    assert [r.rel for r in files.collect()] == ["B.pdf", "sub/a.pdf"]
    binary = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path / "pdfs"))
    assert libraries.extract_pages(binary, lambda b: b.decode().split("\f"), 1).count() == 3 and libraries.extract_pages(binary, lambda b: 1 / 0).count() == 0
    blocks = spark.createDataFrame([("d", 1, 0, 5.0, 2.04, "b"), ("d", 1, 0, 1.0, 2.01, "a"), ("d", 1, 1, 0.0, 0.0, "image"), ("d", 1, 0, 0.0, 9.0, " ")], "doc string, page int, type int, x double, y double, text string")
    assert libraries.page_of_blocks(blocks, ["doc", "page"]).first().text == "a\nb"
    words = spark.createDataFrame([("river", 2, 5)], "token string, doc_freq long, total_freq long")
    phrases = spark.createDataFrame([("en", "a b", 1, 1)], "lang string, bigram string, doc_freq long, total_freq long")
    got = json.loads(libraries.export_vocabulary(words, phrases, spark.createDataFrame([(3, "en")], "doc_count long, language string")).first().json)
    assert got["word_doc_freq"] == {"river": 2} and got["bigram_total_count"] == {"en": 1} and got["version"] == "2.6" and got["doc_count"] == 3
    long_ = one(spark, "a/b" * 60, libraries.safe_name(F.col("s")))
    assert "/" not in long_ and len(long_) <= 111 and one(spark, " .. ", libraries.safe_name(F.col("s"))) == "default" and one(spark, "/r/x/a.pdf", libraries.relative_path(F.col("s"), "/r")) == "x/a.pdf"


def test_report_and_command_line(spark, tmp_path, capsys):
    item = {"sentence_id": 1, "page": 2, "pct": 20, "text": "A\nB", "issues": [{"issue_type": "low_alignment"}]}
    text = render({"meta": {"doc": "x"}, "summary": {"low_alignment_sentences": 1}, "items": [item], "citecheck": [{"verdict": "NOT_FOUND", "author": "a", "year": "1", "page": 1}] * 50})
    assert text.startswith("# Audit of x") and "- low alignment: 1 sentences" in text and "20%: A B" in text and text.count("): NOT_FOUND") == 40
    assert render({}).startswith("# Audit of a paper")
    _papers(spark).write.parquet(str(tmp_path / "pages"))
    assert cli.main(["library", "build", str(tmp_path / "lib"), str(tmp_path / "pages")]) == 0 and cli.main(["audit", "run", str(tmp_path / "lib"), str(tmp_path / "pages"), str(tmp_path / "out")]) == 0
    assert (tmp_path / "out" / "p" / "report.md").read_text().startswith("# Audit of p") and cli.main(["library", "status", str(tmp_path / "lib")]) == 0
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["passages"] is True
