"""The general operators: every registered query with SQL against DuckDB, and small fixtures."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from inkstone.functions import text as T
from inkstone.operators import citations, corpus, coverage, pages, structure, vector
from inkstone.plans import catalogue

SF = "/root/testdata/sf0.001"


def canon(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    cell = lambda v: "" if v is None else f"{v:.6f}" if isinstance(v, float) else str(v)
    return [names[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    got = canon([tuple(r) for r in df.collect()], df.columns)
    cur = duck.execute(catalogue.ORACLE_SQL[name])
    assert got == canon(cur.fetchall(), [d[0] for d in cur.description])


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"s {kind}").select(column.alias("x")).first().x


def test_words(spark):
    s = F.col("s")
    assert one(spark, "über the Café model x1 a_b", T.ascii_words(s)) == ["the", "model"]
    assert one(spark, "The quiet river, the", T.words(s)) == ["quiet", "river"]
    assert one(spark, "one", T.bigrams(T.ascii_words(s))) == []
    assert one(spark, "a b c", T.bigrams(T.ascii_words(s))) == ["a b", "b c"]


def test_language_bounds(spark):
    s = F.col("s")
    assert one(spark, "中" * 7 + "abc", T.language(s)) == "mixed"
    assert one(spark, "中" * 8 + "ab", T.language(s)) == "zh"
    assert one(spark, "中" * 3 + "abcdefg", T.language(s)) == "en"
    assert one(spark, "123", T.language(s)) == "en"


def test_brackets_and_levels(spark):
    assert one(spark, "(a [b", T.unbalanced(F.col("s"))) == "()"
    assert one(spark, "a (b) c", T.unbalanced(F.col("s"))) is None
    assert [one(spark, h, T.heading_level(F.col("s"))) for h in ("1 Introduction", "2.3.1 Data", "Data", "（一）数据")] == [1, 3, 1, 2]


def test_percentiles_half_even(spark):
    df = spark.createDataFrame([("a", i) for i in range(1, 52)], "g string, v long")
    r = corpus.length_percentiles(df, "g", "v").first()
    assert (r.p50, r.p90, r.p95) == (26, 46, 49)


def test_section_parents(spark):
    df = spark.createDataFrame([("d", i, lv) for i, lv in enumerate([1, 2, 3, 2, 1, 3])], "doc string, o int, level int")
    out = {r.o: r.parent for r in structure.parents(df, "doc", "o", "level", "o").collect()}
    assert [out[i] for i in range(6)] == [None, 0, 1, 0, None, 4]


def test_even_sample(spark):
    df = spark.createDataFrame([("d", i) for i in range(125)], "g string, i int")
    got = sorted(r.pos for r in structure.even_sample(df, F.col("i"), 50, "g").collect())
    assert got == sorted({round(i * 125 / 50) for i in range(50)}) and 2 in got and 8 in got


def test_repeated_lines(spark):
    df = spark.createDataFrame([("d", p, f"Journal of Rivers, page {p}\nbody {'abcde'[p]} text\nmore of {'lmnop'[p]}\nand end {'vwxyz'[p]}") for p in range(5)], "pdf string, page int, text string")
    assert [(r.line_key, r.place) for r in pages.running_heads(df, "pdf").collect()] == [("journal of rivers page", "head")]
    assert "Journal" not in pages.strip_running_heads(df, "pdf").where("page = 0").first().text


def test_reference_match_ties(spark):
    s = spark.createDataFrame([(1, "p", [("narrative", "Li", "2020", "Li (2020)")])], "sentence_id long, pdf string, citations array<struct<kind string, authors string, cite_year string, raw string>>")
    r = spark.createDataFrame([(5, "p", 2, "Li, M. 2020. B.", "Li, M.", "2020"), (6, "p", 1, "Li, M. 2020. A.", "Li, M.", "2020a"), (7, "p", 3, "Roe 2020", "Roe", "2020")], "ref_id long, pdf string, entry_index int, reference string, authors string, pub_year string")
    assert [(x.ref_id, x.score) for x in citations.match_references(s, r).collect()] == [(5, 1.0)]  # the letter of a year counts
    assert sorted(x.ref_id for x in citations.uncited(s, r).collect()) == [6, 7]


def test_state(spark):
    budget = coverage.TokenBudget(100)
    assert [budget.allow(n) for n in (60, 50, 30)] == [True, False, True] and budget.used == 90
    old = spark.createDataFrame([("a", 1, 1), ("b", 1, 1), ("c", 1, 1)], "path string, size long, mtime long")
    new = spark.createDataFrame([("a", 1, 1), ("b", 2, 1), ("d", 1, 1)], "path string, size long, mtime long")
    assert sorted(tuple(r) for r in coverage.changed_files(old, new).collect()) == [("b", "changed"), ("c", "removed"), ("d", "added")]


def test_top_k_ties(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0]), (3, [1.0, 0.0])], "vec_id long, embedding array<double>")
    got = [(r.vec_id, r.rank) for r in vector.top_k(df, df.where("vec_id = 0"), 2).orderBy("rank").collect()]
    assert got == [(2, 1), (3, 2)]
