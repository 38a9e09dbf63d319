"""Documents, review helpers, sources, the facade and the stream."""

import json

from pyspark.sql import functions as F

from inkstone.api import PROFILES, Engine
from inkstone.functions import prose
from inkstone.operators import coverage as cov
from inkstone.operators import documents, review
from inkstone.plans import catalogue
from inkstone.sources import records
from inkstone.streaming import coverage as stream


def test_reference_islands(spark):
    lines = ["lost head", "[1] Roe, J. 2001. A title", "that goes on.", "", "Poe, K. (1999). Another."]
    df = spark.createDataFrame([("d", i, x) for i, x in enumerate(lines)], "doc string, o int, line string")
    got = [(r.entry, r.reference) for r in documents.reference_islands(df, "doc", "o", "line").orderBy("entry").collect()]
    assert got == [(1, "[1] Roe, J. 2001. A title that goes on."), (2, "Poe, K. (1999). Another.")]


def test_reference_lists_inside_documents(spark):
    entries = "[1] Roe, J. 2001. A title\nthat goes on.\nPoe, K. (1999). Another."
    texts = {"a": f"Smith, A. 2000. No entry.\n\n References \n{entries}", "b": f"References\n{entries}", "c": f"Body.\r\n参考文献\r\n{entries}", "d": "Roe, J. 2001. No list here.", "e": None}
    df = spark.createDataFrame(list(texts.items()), "doc string, text string")
    got = {tuple(r) for r in documents.reference_islands(documents.reference_lines(df, "doc", "text"), "doc", "o", "line").collect()}
    assert got == {(d, i + 1, x) for d in "abc" for i, x in enumerate(["[1] Roe, J. 2001. A title that goes on.", "Poe, K. (1999). Another."])}


def test_scaffold_and_headings(spark):
    df = spark.createDataFrame([("In this paper, we study rivers.",), ("Rivers are long and quiet and deep.",)], "s string")
    assert [r[0] for r in df.select(documents.scaffold(F.col("s"))).collect()] == ["In this paper,", "Rivers are long and quiet and"]
    heads = spark.createDataFrame([("2. Data",), ("一、引言",), ("3 Literature Review",), ("Oddities",)], "s string")
    assert [r[0] for r in heads.select(documents.canonical(F.col("s"))).collect()] == ["data", "introduction", "related_work", "other"]


def test_headings_of_all_kinds(spark, tmp_path):
    lines = ["一、引言", "（一）研究背景", "2 Data", "2.1 Towns of the north", "plain text that is no heading.", "Conclusion", "第三章 结论", "References", "The results of this are long and no name of a section."]
    spark.createDataFrame([(1, "\n".join(lines)), (2, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = [(r.line_no, r.level, r.canonical) for r in catalogue.headings_all(spark, str(tmp_path)).orderBy("line_no").collect()]
    assert got == [(0, 1, "introduction"), (1, 2, "other"), (2, 1, "data"), (3, 2, "other"), (5, 1, "conclusion"), (6, 1, "conclusion"), (7, 1, "references")]
    assert {r.line_no: r.parent for r in catalogue.section_parent_all(spark, str(tmp_path)).collect()} == {0: None, 1: 0, 2: None, 3: 2, 5: None, 6: None, 7: None}
    assert catalogue.outline_counts_all(spark, str(tmp_path)).first().outline.endswith("conclusion > references")


def test_files_and_syntax(spark):
    cites = spark.createDataFrame([(1, "roe", "2001"), (2, "poe", "1999")], "cite long, name string, y string")
    files = spark.createDataFrame([("b/Roe_2001_rivers.pdf",), ("a/roe-2001.pdf",), ("a/poe_2000.pdf",)], "pdf string")
    assert [tuple(r) for r in documents.file_matches(cites, files).collect()] == [(1, "a/roe-2001.pdf")]
    text = "# c\n1\ta\ta\tNOUN\t_\t_\t2\tnsubj\n1-2\tx\tx\tX\t_\t_\t0\tx\n2\tb\tb\tVERB\t_\t_\t0\troot\nshort"
    r = documents.conllu(spark.createDataFrame([("d", text)], "doc string, t string"), "t", "doc").first()
    assert (r.upos, r.deprel) == (["NOUN", "VERB"], ["nsubj", "root"])
    tags = spark.createDataFrame([(1, list("ABCDEF")), (2, list("ABABAB"))], "k long, upos array<string>")
    known = spark.createDataFrame([("A B",), ("B A",)], "pair string")
    assert [tuple(x) for x in documents.syntax_outliers(tags, known, "k", "upos").collect()] == [(1, 5, 4)]


def test_review(spark):
    items = spark.createDataFrame([("d", i, 1 if i < 20 else 2, float(i), f"k{i}") for i in range(24)], "doc string, i int, page int, score double, key string")
    store = spark.createDataFrame([("c", "k0", 2, 1)], "category string, key string, count long, page int")
    got = review.candidates(items, store, "doc", "page", "score", "key", cap=12, top=14).orderBy("position").collect()
    assert len(got) == 14 and got[0].page == 2 and "k0" not in {r.key for r in got}
    b = review.batches(items, "doc", "i", 6, "key").orderBy("batch").collect()
    assert [len(r["items"]) for r in b] == [6, 6, 6, 6]
    assert review.first_object('noise {bad {"a": 1} tail') == {"a": 1} and review.first_object(None) is None
    row = spark.createDataFrame([("the  river", "over the river bank 12", "costs 12 or 13", "acc.", "s12 e1", "abcdefghijkl")], "q string, s string, r string, v string, e string, k string")
    c = F.col
    out = row.select(review.quote(c("q"), c("s")), review.invented_numbers(c("r"), c("s")), review.verdict(c("v")), review.evidence_id(c("e")), review.masked_secret(c("k")), review.excerpt(c("s"), 5)).first()
    assert tuple(out) == ("the river", ["13"], "ACCURATE", "S12E1", "********ijkl", "over…")


def test_sources(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"text": "a", "source": {"pdf": "p", "page": 2}}\n\nnot json\n{"sentence": "b", "file": "q"}\n')
    got = sorted(tuple(r) for r in records.read_sentence_index(spark, str(p)).collect())
    assert got == [("a", "p", 2), ("b", "q", None)]
    v = tmp_path / "v.json"
    v.write_text(json.dumps({"pdf_count": 3, "word_freq": {"a": 100, "b": 5}}))
    assert sorted(tuple(r) for r in records.read_vocabulary(spark, str(v)).collect()) == [("a", 3), ("b", 1)]


def test_engine(spark, tmp_path):
    assert PROFILES["cheap"].top_k == 12
    e = Engine(spark, str(tmp_path / "lib"))
    assert not any(e.status().values())
    e.fit(spark.createDataFrame([(1, "the quiet river rose in may"), (2, None)], "doc_id long, text string"))
    assert all(e.status().values())
    issues = e.audit(spark.createDataFrame([("d", 1, "Moreover, a (b salty wind blew over many odd green hills today"), ("d", 2, "the quiet river rose in may")], "doc_id string, sent_id long, text string"))
    assert {(r.sent_id, r.issue_type) for r in issues.collect()} == {(1, "ai_transition"), (1, "punctuation"), (1, "uncommon_phrasing")}
    assert e.report(issues).first().markdown.startswith("# Audit of d\n\n## ai_transition (1)")


def test_stream(spark, tmp_path):
    marks, store = str(tmp_path / "marks"), str(tmp_path / "store")
    rows = "SELECT 'c' category, 'k' key, 3L page, timestamp'2024-01-0{} 00:00:00' seen_at"
    for n in (1, 2):
        spark.sql(rows.format(n)).write.mode("append").parquet(marks)
        q = stream.follow(spark, marks, store, str(tmp_path / "cp"))
        assert q.awaitTermination(60)
    r = stream.read_store(spark, store, 1).first()
    assert (r["count"], r.page) == (2, 3) and r.first_seen_at < r.last_seen_at
    assert cov.unseen(spark.createDataFrame([("k",), ("m",)], "key string"), stream.read_store(spark, store, 1)).count() == 1


def test_prose(spark):
    def run(value, column):
        return spark.createDataFrame([(value,)], "s string").select(column(F.col("s"))).first()[0]

    assert run("$$x = y$$", prose.math_like) and run("a_1 + b^2 = {c}", prose.math_like) and not run("The river rose in May.", prose.math_like)
    assert run(" Page 12 ", prose.page_number) and not run("12 rivers", prose.page_number)
    body = "The river rose in May and nobody had expected so much water."
    assert run(body + "\nReferences\n[1] Roe", prose.before_references) == body
    assert run("short\nReferences\n[1] Roe", prose.before_references) == "" and run(body, prose.before_references) == body
    text = "We cite Roe et al. (2001), see Fig. 3. It rose\nin May (see J. Doe). Then it fell!\n\nNew part"
    assert run(text, prose.sentences) == ["We cite Roe et al. (2001), see Fig. 3.", "It rose in May (see J. Doe).", "Then it fell!", "New part"]
