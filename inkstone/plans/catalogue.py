"""The registered queries of the general operators and their SQL.

Documents of the sources in ``TARGETS`` play the papers to be audited, all others the library.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkstone.functions import citing, headings, lexicon, prose, segment
from inkstone.functions import text as T
from inkstone.operators import audit, citations, corpus, coverage, documents, libraries, pages, retrieval, review, structure, style, vector
from inkstone.plans import headings_sql
from inkstone.session import latest, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

TARGETS = ("lecture_notes", "errata", "glossaries")
_TARGETS = "('lecture_notes','errata','glossaries')"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _library(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").where(F.coalesce("source", F.lit("")).isin(*TARGETS) == F.lit(False))


def _target(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").where(F.col("source").isin(*TARGETS))


#: SQL building blocks.
_STOP = "[" + ",".join(_q(w) for w in sorted(set(lexicon.STOP_WORDS))) + "]"
_ASCII = "list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), lambda w: regexp_full_match(w, '[a-z]+'))"
_WORDS = f"list_filter({_ASCII}, lambda w: length(w) >= 3 AND NOT list_contains({_STOP}, w))"
_LIB = f"(SELECT * FROM documents WHERE coalesce(source,'') NOT IN {_TARGETS})"
_TGT = f"(SELECT * FROM documents WHERE source IN {_TARGETS})"
_HAN = "len(regexp_extract_all({0}, '[\\x{{4e00}}-\\x{{9fff}}]'))"
_WS = "trim(regexp_replace(coalesce({0},''), '[\\s\\p{{Z}}]+', ' ', 'g'))"
_DIST = "(SELECT DISTINCT sentence_id, sentence FROM citation_sentences WHERE sentence IS NOT NULL)"


def _tok(table: str, key: str = "doc_id") -> str:
    return f"(SELECT {key}, unnest({_WORDS}) AS token FROM {table} WHERE text IS NOT NULL)"


_VOCAB = f"SELECT token, count(DISTINCT doc_id) AS doc_freq, count(*) AS total_freq FROM {_tok(_LIB)} GROUP BY token"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rare_in_exemplars(spark, sf_dir)


# --- text ---------------------------------------------------------------------------------


@query(f"SELECT doc_id, CASE WHEN zh > 0.7 * (zh + en) THEN 'zh' WHEN zh > 0.3 * (zh + en) THEN 'mixed' ELSE 'en' END AS language FROM (SELECT doc_id, {_HAN.format('text')} AS zh, len(regexp_extract_all(text, '[a-zA-Z]')) AS en FROM documents WHERE text IS NOT NULL)")
def lang_detect(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").where("text IS NOT NULL").select("doc_id", T.language(F.col("text")).alias("language"))


@query(f"SELECT doc_id, len({_WORDS})::BIGINT AS n_words, len({_ASCII})::BIGINT AS n_stream FROM documents WHERE text IS NOT NULL")
def tokens_per_doc(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.size(T.words(F.col("text"))).cast("bigint").alias("n_words"), F.size(T.ascii_words(F.col("text"))).cast("bigint").alias("n_stream"))


@query(f"SELECT doc_id, greatest(1, floor(zh + (length(text) - zh) / 4.0))::BIGINT AS approx FROM (SELECT doc_id, text, {_HAN.format('text')} AS zh FROM documents WHERE text IS NOT NULL)")
def approx_tokens(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").where("text IS NOT NULL").select("doc_id", T.approx_tokens(F.col("text")).alias("approx"))


@query(f"SELECT node_no, md5({_WS.format('text')}) AS ws_md5 FROM (SELECT DISTINCT node_no, text FROM rag_nodes)")
def normalize_ws(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "rag_nodes").select("node_no", "text").distinct().select("node_no", F.md5(T.normalize_ws(F.col("text"))).alias("ws_md5"))


@query(f"SELECT node_no, 'rag_' || substring(sha1(trim(coalesce(page,0)::VARCHAR || '|' || substring({_WS.format('text')},1,1200) || '|' || substring(coalesce(pdf,''),1,200), '|')),1,16) AS stable_key FROM (SELECT DISTINCT node_no, page, text, pdf FROM rag_nodes)")
def stable_text_key(spark: SparkSession, d: str) -> DataFrame:
    nodes = read(spark, d, "rag_nodes").select("node_no", "page", "text", "pdf").distinct()
    return nodes.select("node_no", T.stable_key("rag", F.col("page"), F.col("text"), F.col("pdf")).alias("stable_key"))


@query("SELECT pdf, substring(sha1(pdf),1,16) AS doc_key, md5(pdf) AS cache_key FROM library_files")
def doc_id_sha1(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "library_files").select("pdf", F.substring(F.sha1("pdf"), 1, 16).alias("doc_key"), F.md5("pdf").alias("cache_key"))


@query("SELECT node_no, count(*) AS paragraphs, max(length(p))::BIGINT AS longest FROM (SELECT node_no, trim(regexp_replace(unnest(string_split_regex(text, '\\n[ \\t]*\\n')), '[\\s\\p{Z}]+', ' ', 'g')) AS p FROM (SELECT DISTINCT node_no, text FROM rag_nodes WHERE text IS NOT NULL)) WHERE p <> '' GROUP BY node_no")
def split_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    nodes = read(spark, d, "rag_nodes").select("node_no", "text").where("text IS NOT NULL").distinct()
    parts = nodes.select("node_no", F.explode(F.split("text", "\\n[ \\t]*\\n")).alias("p")).select("node_no", T.normalize_ws(F.col("p")).alias("p")).where("p <> ''")
    return parts.groupBy("node_no").agg(F.count(F.lit(1)).alias("paragraphs"), F.max(F.length("p")).cast("bigint").alias("longest"))


_PARAS = "list_filter(list_transform(string_split_regex(regexp_replace(text, '\\r\\n?', '\n', 'g'), '\\n[\\s\\p{Z}]*\\n+'), lambda x: trim(regexp_replace(x, '[\\s\\p{Z}]+', ' ', 'g'))), lambda x: x <> '')"


@query(
    f"""WITH p AS (SELECT node_no, {_PARAS} AS ps FROM (SELECT node_no, arg_max(text, ingested_at) AS text FROM rag_nodes GROUP BY node_no) WHERE text IS NOT NULL),
m AS (SELECT node_no, CASE WHEN len(list_filter(ps, lambda x: length(x) >= 60)) = 0 AND length(array_to_string(ps, ' ')) >= 60 THEN [array_to_string(ps, ' ')] ELSE list_filter(ps, lambda x: length(x) >= 60) END AS ps FROM p),
c AS (SELECT node_no, list_filter(flatten(list_transform(ps, lambda x: list_transform(range(0, CAST(ceil(length(x) / 900.0) AS BIGINT)), lambda i: trim(substring(x, i * 900 + 1, 900))))), lambda x: length(x) >= 60) AS cs FROM m)
SELECT node_no, (generate_subscripts(cs, 1) - 1)::INT AS chunk_no, md5(unnest(cs)) AS chunk_md5 FROM c"""
)
def chunker(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs of 60 to 900 characters, longer ones in slices, short ones together where all of a node are short."""
    nodes = latest(read(spark, d, "rag_nodes"), "node_no", "ingested_at", "text").where("text IS NOT NULL").withColumn("page", F.lit(1))
    return pages.passages(nodes, "node_no", "page", "text", cut=False).select("node_no", F.col("chunk").alias("chunk_no"), F.md5("text").alias("chunk_md5"))


@query(f"SELECT sentence_id, CASE {' '.join(f'''WHEN length(sentence)-length(replace(sentence,{_q(p[0])},''))<>length(sentence)-length(replace(sentence,{_q(p[1])},'')) THEN {_q(p)}''' for p in ['()', '（）', '[]', '{}', '《》', '“”', '「」', '『』'])} END AS pair FROM {_DIST}")
def unbalanced_brackets(spark: SparkSession, d: str) -> DataFrame:
    return _sentences(spark, d).select("sentence_id", T.unbalanced(F.col("sentence")).alias("pair"))


def _sentences(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "citation_sentences").select("sentence_id", "sentence").where("sentence IS NOT NULL").distinct()


@query(
    "SELECT doc_id, h AS heading, CASE WHEN n <> '' THEN least(6, length(n) - length(replace(n,'.','')) + 1) ELSE 1 END::INT AS level FROM (SELECT doc_id, h, regexp_extract(h, '^\\s*(\\d+(?:\\.\\d+){0,6})\\s', 1) AS n FROM (SELECT doc_id, trim(unnest(string_split_regex(text, '\\r?\\n'))) AS h FROM documents WHERE text IS NOT NULL) WHERE regexp_matches(h, '^\\d+(\\.\\d+)* [\\p{L}]') AND length(h) <= 60)"
)
def heading_level(spark: SparkSession, d: str) -> DataFrame:
    return _headings(spark, d).select("doc_id", "heading", T.heading_level(F.col("heading")).alias("level"))


def _headings(spark: SparkSession, d: str) -> DataFrame:
    lines = read(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\\r?\\n")).alias("line_no", "line")).select("doc_id", "line_no", F.trim("line").alias("heading"))
    return lines.where(F.col("heading").rlike("^\\d+(\\.\\d+)* \\p{L}") & (F.length("heading") <= 60))


@query(
    """WITH lines AS (SELECT doc_id, unnest(string_split_regex(text, '\\r?\\n')) AS line, generate_subscripts(string_split_regex(text, '\\r?\\n'), 1) - 1 AS line_no FROM documents WHERE text IS NOT NULL),
h AS (SELECT doc_id, line_no, trim(line) AS heading FROM lines WHERE regexp_matches(trim(line), '^\\d+(\\.\\d+)* [\\p{L}]') AND length(trim(line)) <= 60),
l AS (SELECT *, least(6, length(regexp_extract(heading, '^(\\d+(?:\\.\\d+){0,6})\\s', 1)) - length(replace(regexp_extract(heading, '^(\\d+(?:\\.\\d+){0,6})\\s', 1), '.', '')) + 1) AS level FROM h)
SELECT a.doc_id, a.line_no::INT AS line_no, max(b.line_no)::INT AS parent FROM l a LEFT JOIN l b ON a.doc_id = b.doc_id AND b.line_no < a.line_no AND b.level < a.level GROUP BY a.doc_id, a.line_no"""
)
def section_parent(spark: SparkSession, d: str) -> DataFrame:
    h = _headings(spark, d).withColumn("level", T.heading_level(F.col("heading")))
    return structure.parents(h, "doc_id", "line_no", "level", "line_no").select("doc_id", "line_no", "parent")


# --- library statistics -------------------------------------------------------------------


@query(_VOCAB)
def vocab_doc_freq(spark: SparkSession, d: str) -> DataFrame:
    return corpus.vocabulary(_library(spark, d))


def _big(table: str) -> str:
    return f"(SELECT doc_id, unnest(list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i+1])) AS bigram FROM (SELECT doc_id, {_ASCII} AS w FROM {table} WHERE text IS NOT NULL))"



@query(f"SELECT bigram, count(DISTINCT doc_id) AS doc_freq, count(*) AS total_freq FROM {_big(_LIB)} GROUP BY bigram")
def bigram_stats(spark: SparkSession, d: str) -> DataFrame:
    return corpus.phrases(_library(spark, d))


@query(f"SELECT bigram, doc_freq, n FROM (SELECT bigram, count(*) AS n FROM {_big(_TGT)} GROUP BY bigram) JOIN (SELECT bigram, count(DISTINCT doc_id) AS doc_freq FROM {_big(_LIB)} GROUP BY bigram) USING (bigram) ORDER BY doc_freq, n DESC, bigram LIMIT 300")
def phrase_stats_rarest(spark: SparkSession, d: str) -> DataFrame:
    n = _target(spark, d).select(F.explode(T.bigrams(T.ascii_words(F.col("text")))).alias("bigram")).groupBy("bigram").agg(F.count(F.lit(1)).alias("n"))
    return n.join(corpus.phrases(_library(spark, d)).select("bigram", "doc_freq"), "bigram").select("bigram", "doc_freq", "n").orderBy("doc_freq", F.desc("n"), "bigram").limit(300)


@query(f"SELECT t.doc_id, count(*) AS bigrams, count(*) FILTER (l.bigram IS NULL) AS unseen FROM {_big(_TGT)} t LEFT JOIN (SELECT DISTINCT bigram FROM {_big(_LIB)}) l USING (bigram) GROUP BY t.doc_id")
def bigram_unseen_per_doc(spark: SparkSession, d: str) -> DataFrame:
    pairs = _target(spark, d).select("doc_id", F.explode(T.bigrams(T.ascii_words(F.col("text")))).alias("bigram"))
    known = corpus.phrases(_library(spark, d)).select("bigram", F.lit(1).alias("known"))
    return pairs.join(known, "bigram", "left").groupBy("doc_id").agg(F.count(F.lit(1)).alias("bigrams"), F.count_if(F.col("known").isNull()).alias("unseen"))


@query(f"WITH v AS ({_VOCAB}), n AS (SELECT count(*) AS docs FROM {_LIB} WHERE text IS NOT NULL) SELECT CASE WHEN p <= 0 THEN 'unseen' WHEN p < 10 THEN 'rare' WHEN p < 50 THEN 'normal' ELSE 'common' END AS word_class, count(*) AS occurrences FROM (SELECT 100.0 * coalesce(doc_freq, 0) / docs AS p FROM {_tok(_TGT)} t LEFT JOIN v USING (token), n) GROUP BY 1")
def word_class_histogram(spark: SparkSession, d: str) -> DataFrame:
    lib = _library(spark, d)
    docs = lib.where("text IS NOT NULL").count()
    t = corpus.tokens(_target(spark, d)).join(corpus.vocabulary(lib), "token", "left")
    share = 100.0 * F.coalesce("doc_freq", F.lit(0)) / F.lit(max(docs, 1))
    return t.groupBy(corpus.word_class(share).alias("word_class")).agg(F.count(F.lit(1)).alias("occurrences"))


@query(f"WITH v AS ({_VOCAB}), n AS (SELECT count(*) AS docs FROM {_LIB} WHERE text IS NOT NULL), t AS (SELECT token, count(*) AS n FROM {_tok(_TGT)} GROUP BY token HAVING count(*) >= 8 ORDER BY n DESC, token LIMIT 400) SELECT token, t.n AS n, coalesce(doc_freq, 0) AS doc_freq FROM t LEFT JOIN v USING (token), n WHERE coalesce(doc_freq, 0) <= 1 OR coalesce(doc_freq, 0) <= 0.02 * docs ORDER BY t.n DESC, token LIMIT 30")
def rare_in_exemplars(spark: SparkSession, d: str) -> DataFrame:
    lib = _library(spark, d)
    return corpus.rare_in_library(_target(spark, d), lib, lib.where("text IS NOT NULL").count()).select("token", "n", "doc_freq")


@query(f"SELECT token, count(*) AS n FROM {_tok(_TGT)} GROUP BY token ORDER BY n DESC, token LIMIT 20")
def top_tokens(spark: SparkSession, d: str) -> DataFrame:
    return corpus.tokens(_target(spark, d)).groupBy("token").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "token").limit(20)


_LEN = f"(SELECT CASE WHEN zh > 0 AND en > 0 THEN 'mixed' WHEN zh > 0 THEN 'zh' ELSE 'en' END AS lang, CASE WHEN zh > 0 THEN zh ELSE len({_ASCII.replace('text', 'sentence')}) END AS size FROM (SELECT sentence, {_HAN.format('sentence')} AS zh, len(regexp_extract_all(sentence, '[a-zA-Z]')) AS en FROM {_DIST}))"


def _lengths(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("sentence")
    zh, en = T.han_count(s), T.latin_count(s)
    lang = F.when((zh > 0) & (en > 0), "mixed").when(zh > 0, "zh").otherwise("en")
    return _sentences(spark, d).select("sentence_id", "sentence", lang.alias("lang"), F.when(zh > 0, zh).otherwise(F.size(T.ascii_words(s))).cast("bigint").alias("size"))


@query(f"SELECT lang, count(*) AS n, round(avg(size), 6) AS mean, round(coalesce(stddev_samp(size), 0), 6) AS std FROM {_LEN} WHERE size > 0 GROUP BY lang")
def length_stats(spark: SparkSession, d: str) -> DataFrame:
    x = _lengths(spark, d).where("size > 0")
    return x.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("size"), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp("size"), F.lit(0.0)), 6).alias("std"))


@query(f"SELECT lang, count(*)::BIGINT AS n, list_sort(list(size))[round_even((count(*) - 1) * 0.5, 0)::INT + 1]::BIGINT AS p50, list_sort(list(size))[round_even((count(*) - 1) * 0.9, 0)::INT + 1]::BIGINT AS p90, list_sort(list(size))[round_even((count(*) - 1) * 0.95, 0)::INT + 1]::BIGINT AS p95 FROM {_LEN} WHERE size > 0 GROUP BY lang HAVING count(*) >= 50")
def length_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return corpus.length_percentiles(_lengths(spark, d).where("size > 0"), "lang", "size").where("n >= 50")


@query(f"SELECT s.sentence_id, s.lang, s.size, CASE WHEN size > floor(mean * 1.5) THEN 'long_sentence' ELSE 'short_sentence' END AS issue_type FROM (SELECT sentence_id, lang, size FROM (SELECT sentence_id, CASE WHEN zh > 0 AND en > 0 THEN 'mixed' WHEN zh > 0 THEN 'zh' ELSE 'en' END AS lang, CASE WHEN zh > 0 THEN zh ELSE len({_ASCII.replace('text', 'sentence')}) END AS size FROM (SELECT sentence_id, sentence, {_HAN.format('sentence')} AS zh, len(regexp_extract_all(sentence, '[a-zA-Z]')) AS en FROM {_DIST}))) s JOIN (SELECT lang, avg(size) AS mean FROM {_LEN} WHERE size > 0 GROUP BY lang) m USING (lang) WHERE size > floor(mean * 1.5) OR size < greatest(CASE WHEN s.lang = 'en' THEN 5 ELSE 10 END, floor(0.45 * mean))")
def sentence_length_issues(spark: SparkSession, d: str) -> DataFrame:
    x = _lengths(spark, d)
    base = x.where("size > 0").groupBy("lang").agg(F.avg("size").alias("mean"))
    floor_ = F.greatest(F.when(F.col("lang") == "en", 5).otherwise(10), F.floor(0.45 * F.col("mean")))
    j = x.join(base, "lang").where(style.too_long(F.col("size"), F.col("mean")) | (F.col("size") < floor_))
    return j.select("sentence_id", "lang", "size", F.when(style.too_long(F.col("size"), F.col("mean")), "long_sentence").otherwise("short_sentence").alias("issue_type"))


@query(f"WITH f AS (SELECT token, min(doc_id) AS first_doc, count(*) AS n FROM {_tok(_LIB)} GROUP BY token) SELECT * FROM f WHERE n = 1")
def once_only_words(spark: SparkSession, d: str) -> DataFrame:
    return corpus.tokens(_library(spark, d)).groupBy("token").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("n")).where("n = 1")


@query("SELECT lib_name, lib_kind, count(*) AS files, sum(size_bytes)::BIGINT AS bytes, max(page_count)::BIGINT AS most_pages FROM library_files GROUP BY 1, 2")
def library_info(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "library_files").groupBy("lib_name", "lib_kind").agg(F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("bytes"), F.max("page_count").cast("bigint").alias("most_pages"))


@query("SELECT pdf, CASE WHEN lower(trim(lib_kind)) IN ('exemplar','references') THEN lower(trim(lib_kind)) WHEN regexp_matches(lower(trim(lib_name)), '^(refs?[_-]|citecheck|references)|[_-]refs$') THEN 'references' ELSE 'exemplar' END AS kind FROM library_files")
def library_kind(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "library_files").select("pdf", libraries.kind(F.col("lib_name"), F.col("lib_kind")).alias("kind"))


# --- selection and windows ----------------------------------------------------------------


@query(f"SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE text IS NOT NULL AND {_WS.format('text')} <> '' GROUP BY md5(lower({_WS.format('text')}))")
def first_occurrence_dedup(spark: SparkSession, d: str) -> DataFrame:
    x = read(spark, d, "documents").where("text IS NOT NULL").select("doc_id", T.normalize_ws(F.col("text")).alias("t")).where("t <> ''")
    return x.groupBy(F.md5(F.lower("t")).alias("h")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")).select("doc_id", "copies")


@query("SELECT pdf, page, node_no FROM (SELECT pdf, page, node_no, row_number() OVER (PARTITION BY pdf, page ORDER BY length(text) DESC, node_no) AS r FROM (SELECT DISTINCT pdf, page, node_no, text FROM rag_nodes WHERE page IS NOT NULL AND text IS NOT NULL)) WHERE r <= 3")
def page_cap_topn(spark: SparkSession, d: str) -> DataFrame:
    n = read(spark, d, "rag_nodes").where("page IS NOT NULL AND text IS NOT NULL").select("pdf", "page", "node_no", "text").distinct()
    return structure.page_capped(n, ["pdf", "page"], [F.desc(F.length("text")), F.col("node_no")], 3).select("pdf", "page", "node_no")


@query("WITH s AS (SELECT pdf, sentence_id, row_number() OVER (PARTITION BY pdf ORDER BY sentence_id) - 1 AS pos, count(*) OVER (PARTITION BY pdf) AS n FROM (SELECT DISTINCT pdf, sentence_id FROM citation_sentences)), i AS (SELECT pdf, n, unnest(range(0, 50)) AS i FROM (SELECT DISTINCT pdf, n FROM s WHERE n > 50)) SELECT DISTINCT s.pdf, s.sentence_id, s.pos::INT AS pos FROM s LEFT JOIN i ON s.pdf = i.pdf AND round_even(i.i * i.n / 50.0, 0) = s.pos WHERE s.n <= 50 OR i.i IS NOT NULL")
def even_sampling(spark: SparkSession, d: str) -> DataFrame:
    s = read(spark, d, "citation_sentences").select("pdf", "sentence_id").distinct()
    return structure.even_sample(s, F.col("sentence_id"), 50, "pdf").select("pdf", "sentence_id", "pos")


@query(f"WITH o AS (SELECT pdf, sentence_id, list_aggregate(w[1:3], 'string_agg', ' ') AS opener FROM (SELECT pdf, sentence_id, {_ASCII.replace('text', 'sentence')} AS w FROM (SELECT DISTINCT pdf, sentence_id, sentence FROM citation_sentences WHERE sentence IS NOT NULL)) WHERE len(w) >= 6) SELECT pdf, opener, count(*) AS n FROM o GROUP BY pdf, opener HAVING count(*) >= 3")
def repeated_openers(spark: SparkSession, d: str) -> DataFrame:
    s = read(spark, d, "citation_sentences").where("sentence IS NOT NULL").select("pdf", "sentence_id", "sentence").distinct().select("pdf", T.ascii_words(F.col("sentence")).alias("w")).where(F.size("w") >= 6)
    return s.groupBy("pdf", F.array_join(F.slice("w", 1, 3), " ").alias("opener")).agg(F.count(F.lit(1)).alias("n")).where("n >= 3")


_EDGE_KEY = "CASE WHEN length({0}) BETWEEN 5 AND 160 AND length({1}) >= 6 THEN {1} ELSE '' END".format("x", "lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(x, chr(173), ''), '[ \\t]+', ' ', 'g'), '\\d+', '', 'g'), '[^A-Za-z\\x{4e00}-\\x{9fff} ]+', '', 'g'), ' +', ' ', 'g')))")
_PAGES = "(SELECT pdf, page, string_agg(text, chr(10) ORDER BY node_no) AS text FROM (SELECT node_no, arg_max(pdf, ingested_at) AS pdf, arg_max(page, ingested_at) AS page, arg_max(text, ingested_at) AS text FROM rag_nodes GROUP BY node_no) WHERE page IS NOT NULL AND text IS NOT NULL GROUP BY pdf, page)"


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """(doc, page, text): the nodes of a page, one below the other."""
    n = latest(read(spark, d, "rag_nodes"), "node_no", "ingested_at", "pdf", "page", "text").where("page IS NOT NULL AND text IS NOT NULL")
    per = n.groupBy(F.col("pdf").alias("doc"), "page").agg(F.sort_array(F.collect_list(F.struct("node_no", "text"))).alias("x"))
    return per.select("doc", "page", F.array_join(F.transform("x", lambda v: v["text"]), "\n").alias("text"))


@query(
    rf"""WITH p AS (SELECT pdf, page, list_filter(list_transform(string_split_regex(text, '\r\n|[\n\r]'), lambda x: regexp_replace(x, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')), lambda x: x <> '') AS l FROM {_PAGES}),
e AS (SELECT pdf, 'head' AS place, unnest(l[1:2]) AS x FROM p UNION ALL SELECT pdf, 'foot', unnest(l[-2:]) FROM p),
k AS (SELECT pdf, place, {_EDGE_KEY} AS line_key FROM e),
n AS (SELECT pdf, count(*) AS n FROM p GROUP BY pdf)
SELECT pdf AS doc, line_key, place, count(*) AS pages FROM k JOIN n USING (pdf) WHERE line_key <> '' GROUP BY pdf, line_key, place, n.n HAVING n.n >= 3 AND count(*) >= greatest(2, floor(n.n * 0.6))"""
)
def header_footer_lines(spark: SparkSession, d: str) -> DataFrame:
    return pages.running_heads(_pages(spark, d)).select("doc", "line_key", "place", "pages")


# --- style --------------------------------------------------------------------------------


def _lex_sql(terms: list[str], kind: str, lower: bool) -> str:
    vals = ",".join(_q(t) for t in terms)
    cond = "contains(lower(sentence), lower(term))" if lower else "contains(sentence, term)"
    return f"SELECT sentence_id, {_q(kind)} AS issue_type, term FROM {_DIST}, (SELECT unnest([{vals}]) AS term) WHERE {cond}"


@query(_lex_sql(lexicon.TRANSITIONS_ZH, "ai_transition", False) + " UNION ALL " + _lex_sql(lexicon.TRANSITIONS_EN, "ai_transition", True))
def style_transitions(spark: SparkSession, d: str) -> DataFrame:
    s = _sentences(spark, d)
    out = style.contained(s, "sentence", lexicon.TRANSITIONS_ZH, "ai_transition").unionByName(style.contained(s, "sentence", lexicon.TRANSITIONS_EN, "ai_transition", True))
    return out.select("sentence_id", "issue_type", "term")


@query(_lex_sql(lexicon.AI_WORDS_ZH, "ai_word", False))
def style_ai_words_zh(spark: SparkSession, d: str) -> DataFrame:
    return style.contained(_sentences(spark, d), "sentence", lexicon.AI_WORDS_ZH, "ai_word").select("sentence_id", "issue_type", "term")


@query("SELECT * FROM (SELECT sentence_id, CASE " + " ".join(f"WHEN contains(sentence, {_q(m)}) THEN {_q(m)}" for m in lexicon.PASSIVE_MARKERS_ZH) + " " + " ".join(f"WHEN regexp_matches(sentence, {_q(p)}) THEN {_q(p)}" for p in lexicon.PASSIVE_PATTERNS_ZH) + f" END AS marker FROM {_DIST}) WHERE marker IS NOT NULL")
def passive_zh(spark: SparkSession, d: str) -> DataFrame:
    return _sentences(spark, d).select("sentence_id", style.passive_zh(F.col("sentence")).alias("marker")).where("marker IS NOT NULL")


@query("SELECT sentence_id, span FROM (SELECT sentence_id, unnest([" + ",".join(f"regexp_extract(sentence, {_q(p)})" for p in lexicon.TEMPLATES_ZH) + f"]) AS span FROM {_DIST}) WHERE span <> ''")
def template_zh(spark: SparkSession, d: str) -> DataFrame:
    return _sentences(spark, d).select("sentence_id", F.explode(style.templates_zh(F.col("sentence"))).alias("span"))


_BAL = " OR ".join(f"length(s)-length(replace(s,{_q(p[0])},''))<>length(s)-length(replace(s,{_q(p[1])},''))" for p in ["()", "（）", "[]", "{}", "《》", "“”", "「」", "『』"])
_AI = " OR ".join(f"contains(lower(s), {_q(t.lower())})" for t in lexicon.TRANSITIONS_EN)


@query(
    f"""WITH d0 AS (SELECT pdf, sentence_id, arg_max(sentence, received_at) AS s FROM citation_sentences GROUP BY pdf, sentence_id),
a AS (SELECT *, {_HAN.format('s')} AS zh, len(regexp_extract_all(s, '[a-zA-Z]')) AS en, {_ASCII.replace('text', 's')} AS w FROM d0 WHERE s IS NOT NULL),
d AS (SELECT pdf FROM a GROUP BY pdf HAVING sum(en) > 0 AND sum(zh) <= 0.3 * (sum(zh) + sum(en))),
x AS (SELECT a.* FROM a JOIN d USING (pdf) WHERE NOT ({headings_sql.like('s')})),
b AS (SELECT avg(len(w)) AS mean FROM a WHERE zh = 0 AND len(w) > 0),
v AS ({_VOCAB}), n AS (SELECT count(*) AS docs FROM {_LIB} WHERE text IS NOT NULL), g AS (SELECT DISTINCT bigram FROM {_big(_LIB)}),
t AS (SELECT pdf, unnest(list_filter(w, lambda z: length(z) >= 3 AND NOT list_contains({_STOP}, z))) AS token FROM a JOIN d USING (pdf)),
tw AS (SELECT pdf, avg((coalesce(doc_freq,0)=0)::INT) AS unseen, avg((coalesce(doc_freq,0)>0 AND 100.0*coalesce(doc_freq,0)/docs<10)::INT) AS rare FROM t LEFT JOIN v USING (token), n GROUP BY pdf),
p AS (SELECT pdf, sentence_id, unnest(list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i+1])) AS bigram FROM x WHERE len(w) >= 4),
ps AS (SELECT pdf, sentence_id, count(*) AS nb, count(*) FILTER (g.bigram IS NULL) AS nu FROM p LEFT JOIN g USING (bigram) GROUP BY pdf, sentence_id),
pp AS (SELECT pdf, sum(nu) / sum(nb) AS ph, count(*) FILTER (nb >= 8 AND nu >= 3 AND nu >= 0.25 * nb) AS odd FROM ps GROUP BY pdf),
q AS (SELECT pdf, count(*) AS sents, count(*) FILTER (len(w) > 0 AND len(w) < greatest(5, floor(mean * 0.45))) AS short, count(*) FILTER ({_BAL}) AS punct, count(*) FILTER (len(w) > floor(mean * 1.5) OR {_AI}) AS style FROM x, b GROUP BY pdf),
r AS (SELECT q.pdf, coalesce(unseen, 0) AS u, coalesce(rare, 0) AS r, ph, least(1.0, (short + punct + coalesce(odd, 0)) / sents) AS se, style / sents AS st FROM q LEFT JOIN tw USING (pdf) LEFT JOIN pp USING (pdf)),
z AS (SELECT pdf, round_even(100 * (CASE WHEN ph IS NOT NULL THEN 0.34 * least(1.0, 1.25 * u + 0.75 * r) + 0.28 * least(1.0, 1.6 * ph) + 0.13 * least(1.0, 1.2 * se) + 0.10 * least(1.0, st) ELSE 0.50 * least(1.0, 1.25 * u + 0.75 * r) + 0.20 * least(1.0, 1.2 * se) + 0.15 * least(1.0, st) END), 0)::INT AS score FROM r)
SELECT pdf, score, CASE WHEN score >= 70 THEN 'high' WHEN score >= 35 THEN 'medium' ELSE 'low' END AS level FROM z"""
)
def weirdness_score(spark: SparkSession, d: str) -> DataFrame:
    """The score of every paper in English, its sentences against the library (no vectors and no tags, so these parts are 0)."""
    texts = latest(read(spark, d, "citation_sentences"), "sentence_id", "received_at", "pdf", "sentence").where("sentence IS NOT NULL")
    sents = texts.select(F.col("pdf").alias("doc"), "sentence_id", F.col("sentence").alias("text"))
    lib = _library(spark, d)
    docs = lib.where("text IS NOT NULL").agg(F.count(F.lit(1)).alias("docs"))
    return audit.weirdness_en(sents, corpus.vocabulary(lib), corpus.phrases(lib), docs).select(F.col("doc").alias("pdf"), "score", "level")


# --- vectors ------------------------------------------------------------------------------

_DOT = "round(list_sum(list_transform(list_zip(q.embedding, r.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)), 6)"
_TOP = f"SELECT q.vec_id AS query_id, r.vec_id AS vec_id, {_DOT} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_DOT} DESC, r.vec_id) AS rank FROM embeddings q JOIN embeddings r ON q.vec_id % 50 = 0 AND q.vec_id <> r.vec_id"


@query(f"SELECT query_id, vec_id, round(score, 4) AS score, rank::INT AS rank FROM ({_TOP}) WHERE rank <= 5")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings")
    return retrieval.block_top_k(e, e.where("vec_id % 50 = 0"), 5, skip_self=True).select("query_id", "vec_id", F.round("score", 4).alias("score"), "rank")


@query(f"SELECT query_id, greatest(0.0, round(max(score), 4)) AS best, greatest(0.0, max(score)) < 0.68 AS outlier, greatest(0.0, max(score)) < 0.35 AS low_alignment, floor(least(1.0, greatest(0.0, max(score))) * 100)::INT AS pct FROM (SELECT query_id, score FROM ({_TOP}) WHERE rank = 1) GROUP BY query_id")
def alignment(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings")
    best = F.greatest(F.lit(0.0), F.col("score"))
    return retrieval.block_top_k(e, e.where("vec_id % 50 = 0"), 1, skip_self=True).select("query_id", F.round(best, 4).alias("best"), (best < 0.68).alias("outlier"), (best < 0.35).alias("low_alignment"), F.floor(F.least(F.lit(1.0), best) * 100).cast("int").alias("pct"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: (x::DOUBLE / greatest(n, 1e-12)) ** 2)), 6) AS norm2, round(embedding[1]::DOUBLE / greatest(n, 1e-12), 6) AS first FROM (SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE ** 2))) AS n FROM embeddings)")
def l2_normalize(spark: SparkSession, d: str) -> DataFrame:
    v = read(spark, d, "embeddings").select("vec_id", vector.normalized(F.col("embedding")).alias("v"))
    return v.select("vec_id", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x), 6).alias("norm2"), F.round(F.col("v")[0], 6).alias("first"))


# --- citations ----------------------------------------------------------------------------


@query("SELECT ref_id, CASE WHEN quoted <> '' THEN substring(quoted,1,200) WHEN has AND length(clause) >= 12 THEN substring(clause,1,200) WHEN has THEN substring(after_year,1,150) ELSE substring(t,1,120) END AS title FROM (SELECT *, trim(regexp_extract(after_year, '^([^.]+)', 1)) AS clause FROM (SELECT ref_id, t, regexp_extract(t, '[\"“]([^\"”]{20,})[\"”]', 1) AS quoted, regexp_matches(t, '[0-9]{4}') AS has, regexp_extract(t, '[0-9]{4}\\)?[.,]?[ ]*(.*)$', 1) AS after_year FROM (SELECT ref_id, " + _WS.format("reference") + " AS t FROM (SELECT DISTINCT ref_id, reference FROM reference_entries))))")
def reference_title(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "reference_entries").select("ref_id", "reference").distinct().select("ref_id", T.reference_title(F.col("reference")).alias("title"))


@query("SELECT ref_id, list_aggregate(ys, 'string_agg', ',') AS years FROM (SELECT ref_id, list_filter(regexp_extract_all(reference, '[\\p{L}\\p{N}_]+'), lambda w: regexp_full_match(w, '(18|19|20)[0-9]{2}[a-zA-Z]?')) AS ys0, list_filter(ys0, lambda y, i: list_position(ys0, y) = i) AS ys FROM (SELECT DISTINCT ref_id, reference FROM reference_entries)) WHERE len(ys) > 0")
def year_extract(spark: SparkSession, d: str) -> DataFrame:
    y = read(spark, d, "reference_entries").select("ref_id", "reference").distinct().select("ref_id", T.years(F.col("reference")).alias("y")).where(F.size("y") > 0)
    return y.select("ref_id", F.array_join("y", ",").alias("years"))


@query(citations.MATCH_SQL)
def reference_match(spark: SparkSession, d: str) -> DataFrame:
    return citations.match_references(read(spark, d, "citation_sentences"), read(spark, d, "reference_entries"))


@query(citations.UNCITED_SQL)
def uncited_references(spark: SparkSession, d: str) -> DataFrame:
    return citations.uncited(read(spark, d, "citation_sentences"), read(spark, d, "reference_entries"))


@query("SELECT c.kind AS kind, count(*) AS n, count(DISTINCT sentence_id) AS sentences, count(c.cite_year) AS with_year FROM (SELECT sentence_id, unnest(citations) AS c FROM (SELECT sentence_id, arg_max(citations, received_at) AS citations FROM citation_sentences GROUP BY sentence_id)) GROUP BY 1")
def citation_bank_stats(spark: SparkSession, d: str) -> DataFrame:
    c = latest(read(spark, d, "citation_sentences"), "sentence_id", "received_at", "citations").select("sentence_id", F.explode("citations").alias("c"))
    return c.groupBy(F.col("c.kind").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("sentence_id").alias("sentences"), F.count("c.cite_year").alias("with_year"))


@query("SELECT verdict, count(*) AS n, round(avg(confidence), 6) AS mean_confidence FROM (SELECT DISTINCT item_id, verdict, confidence FROM cite_check_items) GROUP BY verdict")
def verdict_counts(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "cite_check_items").select("item_id", "verdict", "confidence").distinct().groupBy("verdict").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


@query("SELECT item_id, e.page AS page, round(e.score, 4) AS score FROM (SELECT item_id, unnest(evidence) AS e FROM (SELECT item_id, arg_max(evidence, checked_at) AS evidence FROM cite_check_items GROUP BY item_id)) QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY e.score DESC, e.page, e.text) = 1")
def best_evidence(spark: SparkSession, d: str) -> DataFrame:
    e = latest(read(spark, d, "cite_check_items"), "item_id", "checked_at", "evidence").select("item_id", F.explode("evidence").alias("e"))
    best = e.groupBy("item_id").agg(F.min(F.struct((-F.col("e.score")).alias("s"), F.col("e.page").alias("page"), F.col("e.text").alias("text"))).alias("m"))
    return best.select("item_id", F.col("m.page").alias("page"), F.round(-F.col("m.s"), 4).alias("score"))


# --- state --------------------------------------------------------------------------------


@query("SELECT event_type AS category, user_id::VARCHAR AS key, count(*) AS count, coalesce(arg_max(event_id, ts) FILTER (event_id <> 0), 0) AS page, min(ts) AS first_seen_at, max(ts) AS last_seen_at FROM (SELECT * FROM events ORDER BY ts, event_id) GROUP BY 1, 2".replace("arg_max(event_id, ts)", "arg_max(event_id, (ts, event_id))"))
def coverage_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The events as review marks, in two batches into an empty store."""
    marks = read(spark, d, "events").select(F.col("event_type").alias("category"), F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("page"), F.col("ts").alias("seen_at"))
    empty = spark.createDataFrame([], "category string, key string, count bigint, page bigint, first_seen_at timestamp, last_seen_at timestamp").withColumn("first_seen_at", F.col("first_seen_at").cast(marks.schema["seen_at"].dataType)).withColumn("last_seen_at", F.col("last_seen_at").cast(marks.schema["seen_at"].dataType))
    first = coverage.mark_seen(empty, marks.where("page % 2 = 0"))
    return coverage.mark_seen(first, marks.where("page % 2 = 1"))


@query("SELECT DISTINCT sentence_id FROM citation_sentences WHERE sentence_id NOT IN (SELECT sentence_id FROM polish_results)")
def coverage_antijoin(spark: SparkSession, d: str) -> DataFrame:
    return coverage.unseen(read(spark, d, "citation_sentences").select("sentence_id").distinct(), read(spark, d, "polish_results"), "sentence_id")


@query("SELECT d.pdf AS path, CASE WHEN f.pdf IS NULL THEN 'removed' WHEN d.pdf IS NULL THEN 'added' ELSE 'changed' END AS change FROM (SELECT pdf, sum(n_chars)::BIGINT AS size, max(received_at) AS mtime FROM documents WHERE pdf IS NOT NULL GROUP BY pdf) d LEFT JOIN library_files f USING (pdf) WHERE f.pdf IS NULL OR f.size_bytes IS DISTINCT FROM d.size OR f.mtime IS DISTINCT FROM d.mtime UNION ALL SELECT pdf, 'added' FROM library_files WHERE pdf NOT IN (SELECT pdf FROM documents WHERE pdf IS NOT NULL)")
def manifest_changes(spark: SparkSession, d: str) -> DataFrame:
    """The documents' manifest against the file list."""
    old = read(spark, d, "documents").where("pdf IS NOT NULL").groupBy(F.col("pdf").alias("path")).agg(F.sum("n_chars").cast("bigint").alias("size"), F.max("received_at").alias("mtime"))
    new = read(spark, d, "library_files").select(F.col("pdf").alias("path"), F.col("size_bytes").alias("size"), "mtime")
    return coverage.changed_files(old, new)


@query("SELECT source, count(*) AS docs, count(*) FILTER (text IS NULL) AS null_texts, sum(length(text))::BIGINT AS chars FROM documents GROUP BY source")
def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.count_if(F.col("text").isNull()).alias("null_texts"), F.sum(F.length("text")).alias("chars"))


@query("SELECT result_id, v.level AS level, length(v.rewrite)::BIGINT AS size FROM (SELECT result_id, unnest(variants) AS v, generate_subscripts(variants, 1) AS i FROM (SELECT result_id, arg_max(variants, created_at) AS variants FROM polish_results GROUP BY result_id)) QUALIFY row_number() OVER (PARTITION BY result_id, v.level ORDER BY i) = 1")
def variants_by_level(spark: SparkSession, d: str) -> DataFrame:
    """The first rewrite of each level."""
    v = latest(read(spark, d, "polish_results"), "result_id", "created_at", "variants").select("result_id", F.posexplode("variants").alias("i", "v"))
    one = v.groupBy("result_id", F.col("v.level").alias("level")).agg(F.min_by(F.col("v.rewrite"), F.col("i")).alias("rewrite"))
    return one.select("result_id", "level", F.length("rewrite").cast("bigint").alias("size"))


# --- documents ----------------------------------------------------------------------------

_HEADS = "SELECT doc_id, line_no, trim(line) AS heading FROM (SELECT doc_id, unnest(string_split_regex(text, '\\r?\\n')) AS line, generate_subscripts(string_split_regex(text, '\\r?\\n'), 1) - 1 AS line_no FROM documents WHERE text IS NOT NULL) WHERE regexp_matches(trim(line), '^\\d+(\\.\\d+)* [\\p{L}]') AND length(trim(line)) <= 60"
_CANON = headings_sql.canonical("heading")


@query(f"SELECT doc_id, line_no::INT AS line_no, {_CANON} AS canonical FROM ({_HEADS})")
def heading_canonical(spark: SparkSession, d: str) -> DataFrame:
    return _headings(spark, d).select("doc_id", "line_no", documents.canonical(F.col("heading")).alias("canonical"))


@query(f"SELECT outline, count(*) AS n, min(doc_id) AS example FROM (SELECT doc_id, string_agg(canonical, ' > ' ORDER BY line_no) FILTER (r <= 18) AS outline FROM (SELECT doc_id, line_no, {_CANON} AS canonical, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS r FROM ({_HEADS})) GROUP BY doc_id) GROUP BY outline")
def outline_counts(spark: SparkSession, d: str) -> DataFrame:
    return documents.outlines(heading_canonical(spark, d), "doc_id", "line_no", "canonical")


_LIKE_BASE = f"regexp_replace(heading, {_q(documents.HEADING_PREFIX)}, '')"
_LIKE = f"(SELECT doc_id, line_no, heading FROM (SELECT doc_id, trim(unnest(string_split_regex(text, '\\r?\\n'))) AS heading, generate_subscripts(string_split_regex(text, '\\r?\\n'), 1) - 1 AS line_no FROM documents WHERE text IS NOT NULL) WHERE length(heading) <= 60 AND (regexp_matches(heading, {_q(documents.NUMBERED)}) OR regexp_matches({_LIKE_BASE}, {_q(documents.SECTION_EN)}) OR regexp_matches({_LIKE_BASE}, {_q(documents.SECTION_ZH)}) AND length({_LIKE_BASE}) <= 12))"
_LIKE_NUMBER = "regexp_extract(heading, '^(\\d+(?:\\.\\d+){0,6})(?:[^\\d\\p{L}_]|$)', 1)"
_LIKE_ALL = f"(SELECT doc_id, line_no, heading, CASE WHEN n <> '' THEN least(6, length(n) - length(replace(n, '.', '')) + 1) WHEN regexp_matches(heading, '^[（(][一二三四五六七八九十]+[)）]') THEN 2 ELSE 1 END::INT AS level, {_CANON} AS canonical FROM (SELECT *, {_LIKE_NUMBER} AS n FROM {_LIKE}))"


def _all_headings(spark: SparkSession, d: str) -> DataFrame:
    lines = read(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\\r?\\n")).alias("line_no", "line")).select("doc_id", "line_no", F.trim("line").alias("heading"))
    return lines.where(documents.heading_like(F.col("heading")))


@query(f"SELECT doc_id, line_no::INT AS line_no, heading, level, canonical FROM {_LIKE_ALL}")
def headings_all(spark: SparkSession, d: str) -> DataFrame:
    """Level and class of every heading, numbered in either way or named."""
    return _all_headings(spark, d).select("doc_id", "line_no", "heading", T.heading_level(F.col("heading")).alias("level"), documents.canonical(F.col("heading")).alias("canonical"))


@query(f"WITH h AS {_LIKE_ALL} SELECT a.doc_id, a.line_no::INT AS line_no, max(b.line_no)::INT AS parent FROM h a LEFT JOIN h b ON a.doc_id = b.doc_id AND b.line_no < a.line_no AND b.level < a.level GROUP BY a.doc_id, a.line_no")
def section_parent_all(spark: SparkSession, d: str) -> DataFrame:
    return structure.parents(headings_all(spark, d), "doc_id", "line_no", "level", "line_no").select("doc_id", "line_no", "parent")


@query(f"SELECT outline, count(*) AS n, min(doc_id) AS example FROM (SELECT doc_id, string_agg(canonical, ' > ' ORDER BY line_no) FILTER (r <= 18) AS outline FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS r FROM {_LIKE_ALL}) GROUP BY doc_id) GROUP BY outline")
def outline_counts_all(spark: SparkSession, d: str) -> DataFrame:
    return documents.outlines(headings_all(spark, d), "doc_id", "line_no", "canonical")


@query("SELECT sentence_id, list_aggregate(list_transform(regexp_extract_all(sentence, '[A-Z][A-Za-z''’-]+(?: et al\\.)? ?[(（](?:18|19|20)[0-9]{2}[a-z]?[)）]'), lambda x: regexp_replace(x, ' ?[(（]((?:18|19|20)[0-9]{2}[a-z]?)[)）]$', '|\\1')), 'string_agg', ';') AS cites FROM " + _DIST + " WHERE regexp_matches(sentence, '[A-Z][A-Za-z''’-]+(?: et al\\.)? ?[(（](?:18|19|20)[0-9]{2}[a-z]?[)）]')")
def narrative_citations(spark: SparkSession, d: str) -> DataFrame:
    return _sentences(spark, d).select("sentence_id", documents.narrative_citations(F.col("sentence")).alias("c")).where(F.size("c") > 0).select("sentence_id", F.array_join("c", ";").alias("cites"))


_SC = "regexp_replace(trim(sentence), '^\\[[^\\]]+\\][\\s\\p{Z}]*', '')"
_SC_EN = "CASE " + " ".join(f"WHEN strpos(lower(t), {_q(p)}) > 0 THEN substring(t, strpos(lower(t), {_q(p)}), {len(p)}) || CASE WHEN substring(t, strpos(lower(t), {_q(p)}) + {len(p)}, 1) IN (',', '，') THEN substring(t, strpos(lower(t), {_q(p)}) + {len(p)}, 1) ELSE '' END" for p in lexicon.SCAFFOLDS_EN) + " ELSE array_to_string(list_filter(regexp_extract_all(t, '[\\p{L}\\p{N}_]+'), lambda w: regexp_full_match(w, '\\p{L}+'))[1:6], ' ') END"
_SC_ZH = "CASE WHEN c <> '' THEN substring(c, 1, 16) ELSE substring(z, 1, 16) END"


@query(f"SELECT sentence_id, CASE WHEN zh THEN {_SC_ZH} ELSE {_SC_EN} END AS scaffold FROM (SELECT *, regexp_replace(regexp_extract(z, '^([^。！？；;]*)', 1), '^[（(]?\\d+(\\.\\d+)?[)）]?', '') AS c FROM (SELECT sentence_id, {_SC} AS t, regexp_replace(sentence, '[\\s\\p{{Z}}]+', '', 'g') AS z, regexp_matches(sentence, '[\\x{{4e00}}-\\x{{9fff}}]') AND NOT regexp_matches(sentence, '[A-Za-z]') AS zh FROM {_DIST}))")
def scaffold(spark: SparkSession, d: str) -> DataFrame:
    return _sentences(spark, d).select("sentence_id", documents.scaffold(F.col("sentence"), T.sentence_language(F.col("sentence"))).alias("scaffold"))


@query(
    f"""WITH c AS (SELECT item_id AS cite, trim(arg_max(cited_year, checked_at)) AS y, arg_max(cited_author, checked_at) AS a FROM cite_check_items GROUP BY item_id),
n AS (SELECT cite, lower(y) AS y, {citations.SURNAMES_SQL.format('a')} AS names FROM c WHERE a IS NOT NULL AND y <> ''),
f AS (SELECT pdf, lower(regexp_extract(pdf, '([^/\\\\]*)$', 1)) AS name FROM library_files),
j AS (SELECT cite, pdf, round(len(list_filter(names, lambda x: x <> '' AND contains(name, x))) / greatest(len(names), 1), 6) AS score FROM n JOIN f ON contains(name, y) AND regexp_matches(y, '^[0-9]{{4}}'))
SELECT cite, pdf FROM j WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY cite ORDER BY score DESC, pdf) = 1"""
)
def citation_files(spark: SparkSession, d: str) -> DataFrame:
    c = latest(read(spark, d, "cite_check_items"), "item_id", "checked_at", "cited_author", "cited_year").where("cited_author IS NOT NULL AND trim(cited_year) <> ''")
    c = c.select(F.col("item_id").alias("cite"), T.surnames(F.col("cited_author")).alias("names"), F.trim("cited_year").alias("y"))
    return documents.file_matches(c, read(spark, d, "library_files"))


@query(
    """WITH l AS (SELECT doc_id, trim(unnest(string_split_regex(text, '\\r?\\n'))) AS s, generate_subscripts(string_split_regex(text, '\\r?\\n'), 1) - 1 AS o FROM documents WHERE starts_with(text, 'References')),
b AS (SELECT *, (regexp_matches(s, '^(?:\\[\\d{1,3}\\]|\\d{1,3}[.)])\\s') OR (regexp_matches(s, '^[\\p{Lu}\\x{4e00}-\\x{9fff}][\\p{L}’''-]*[,，.(（ ]') AND regexp_matches(substring(s, 1, 220), '(?:18|19|20)\\d{2}')))::INT AS begins FROM l WHERE s <> ''),
e AS (SELECT *, sum(begins) OVER (PARTITION BY doc_id ORDER BY o) AS entry FROM b)
SELECT doc_id, entry::INT AS entry, string_agg(s, ' ' ORDER BY o) AS reference FROM e WHERE entry > 0 GROUP BY doc_id, entry"""
)
def reference_entries_islands(spark: SparkSession, d: str) -> DataFrame:
    lines = read(spark, d, "documents").where(F.startswith("text", F.lit("References"))).select("doc_id", F.posexplode(F.split("text", "\\r?\\n")).alias("o", "line"))
    return documents.reference_islands(lines, "doc_id", "o", "line")


@query(
    f"""WITH l AS (SELECT doc_id, trim(unnest(string_split_regex(text, '\\r?\\n'))) AS s, generate_subscripts(string_split_regex(text, '\\r?\\n'), 1) - 1 AS o, starts_with(text, 'References') AS at_once FROM documents WHERE text IS NOT NULL),
f AS (SELECT doc_id, min(o) AS first FROM l WHERE regexp_matches(s, {_q(documents.REFERENCES_LINE)}) OR o = 0 AND at_once GROUP BY doc_id),
b AS (SELECT doc_id, s, o, (regexp_matches(s, '^(?:\\[\\d{{1,3}}\\]|\\d{{1,3}}[.)])\\s') OR (regexp_matches(s, '^[\\p{{Lu}}\\x{{4e00}}-\\x{{9fff}}][\\p{{L}}’''-]*[,，.(（ ]') AND regexp_matches(substring(s, 1, 220), '(?:18|19|20)\\d{{2}}')))::INT AS begins FROM l JOIN f USING (doc_id) WHERE o >= first AND s <> ''),
e AS (SELECT *, sum(begins) OVER (PARTITION BY doc_id ORDER BY o) AS entry FROM b)
SELECT doc_id, entry::INT AS entry, string_agg(s, ' ' ORDER BY o) AS reference FROM e WHERE entry > 0 GROUP BY doc_id, entry"""
)
def reference_entries_documents(spark: SparkSession, d: str) -> DataFrame:
    """Reference entries of every document with a references heading, wherever it stands."""
    return documents.reference_islands(documents.reference_lines(read(spark, d, "documents"), "doc_id", "text"), "doc_id", "o", "line")


@query(f"SELECT t.sentence_id, count(*) AS bigrams, count(*) FILTER (l.bigram IS NULL) AS unseen, CASE WHEN count(*) FILTER (l.bigram IS NULL) >= 4 AND count(*) FILTER (l.bigram IS NULL) >= 0.33 * count(*) THEN 'warning' ELSE 'info' END AS severity FROM (SELECT sentence_id, unnest(list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i+1])) AS bigram FROM (SELECT sentence_id, {_ASCII.replace('text', 'sentence')} AS w FROM {_DIST})) t LEFT JOIN (SELECT DISTINCT bigram FROM {_big(_LIB)}) l USING (bigram) GROUP BY t.sentence_id HAVING count(*) >= 8 AND count(*) FILTER (l.bigram IS NULL) >= 3 AND count(*) FILTER (l.bigram IS NULL) >= 0.25 * count(*)")
def uncommon_phrasing(spark: SparkSession, d: str) -> DataFrame:
    pairs = _sentences(spark, d).select("sentence_id", F.explode(T.bigrams(T.ascii_words(F.col("sentence")))).alias("bigram"))
    known = corpus.phrases(_library(spark, d)).select("bigram", F.lit(1).alias("k"))
    per = pairs.join(known, "bigram", "left").groupBy("sentence_id").agg(F.count(F.lit(1)).alias("bigrams"), F.count_if(F.col("k").isNull()).alias("unseen"))
    per = per.where((F.col("bigrams") >= 8) & (F.col("unseen") >= 3) & (F.col("unseen") >= 0.25 * F.col("bigrams")))
    return per.withColumn("severity", F.when((F.col("unseen") >= 4) & (F.col("unseen") >= 0.33 * F.col("bigrams")), "warning").otherwise("info"))


# --- prose --------------------------------------------------------------------------------

_NODES = "(SELECT DISTINCT node_no, pdf, page, text FROM rag_nodes WHERE text IS NOT NULL)"


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "rag_nodes").where("text IS NOT NULL").select("node_no", "pdf", "page", "text").distinct()


@query(
    r"SELECT doc_id, line_no::INT AS line_no FROM (SELECT doc_id, line_no, trim(line) AS t, regexp_replace(line, '[\s\p{Z}]+', '', 'g') AS c FROM (SELECT doc_id, unnest(string_split_regex(text, '\r?\n')) AS line, generate_subscripts(string_split_regex(text, '\r?\n'), 1) - 1 AS line_no FROM documents WHERE text IS NOT NULL)) WHERE regexp_matches(t, '\\[\[\]()]|\$\$|\\(?:begin|end)\{') OR regexp_matches(t, '(?i)\\(?:frac|alpha|beta|gamma|delta|epsilon|theta|lambda|mu|nu|pi|rho|sigma|tau|phi|psi|omega)(?:[^A-Za-z0-9_]|$)') OR (length(c) >= 8 AND len(regexp_extract_all(c, '[=<>+\-*/^_{}\[\]\\]')) >= 3 AND len(regexp_extract_all(c, '[A-Za-z\x{4e00}-\x{9fff}]')) / length(c) < 0.55)"
)
def math_like_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = read(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\\r?\\n")).alias("line_no", "line"))
    return lines.where(prose.math_like(F.col("line"))).select("doc_id", "line_no")


@query()
def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    return _nodes(spark, d).select("node_no", F.posexplode(prose.sentences(F.col("text"))).alias("sent_no", "sentence"))


@query()
def citation_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of the nodes before any references heading that cite somebody by name and year."""
    s = _nodes(spark, d).select("node_no", "pdf", "page", F.explode(prose.sentences(prose.before_references(F.col("text")))).alias("sentence"))
    return s.select("node_no", "pdf", "page", "sentence", documents.narrative_citations(F.col("sentence")).alias("citations")).where(F.size("citations") > 0)


# --- headings, sentences, citations and pages by their whole rules ------------------------------

_LINES = "(SELECT doc_id, trim(unnest(string_split_regex(text, '\\r?\\n'))) AS line, generate_subscripts(string_split_regex(text, '\\r?\\n'), 1) - 1 AS line_no FROM documents WHERE text IS NOT NULL)"


@query(f"SELECT doc_id, line_no::INT AS line_no FROM {_LINES} WHERE {headings_sql.like('line', 'mixed')}")
def heading_like_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of all documents that are headings, list items, captions or formulas."""
    lines = read(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\\r?\\n")).alias("line_no", "line"))
    return lines.where(headings.heading_like(F.trim("line"), F.lit("mixed"))).select("doc_id", "line_no")


@query(f"SELECT doc_id, sum(length(line))::BIGINT AS chars, count(*) AS headings FROM {_LINES} WHERE {headings_sql.like('line', 'en')} GROUP BY doc_id")
def heading_share_en(spark: SparkSession, d: str) -> DataFrame:
    lines = read(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.explode(F.split("text", "\\r?\\n")).alias("line")).withColumn("line", F.trim("line"))
    return lines.where(headings.heading_like(F.col("line"), F.lit("en"))).groupBy("doc_id").agg(F.sum(F.length("line")).alias("chars"), F.count(F.lit(1)).alias("headings"))


@query(f"SELECT sentence_id, CASE WHEN zh AND en THEN 'mixed' WHEN zh THEN 'zh' ELSE 'en' END AS lang FROM (SELECT sentence_id, regexp_matches(sentence, '[\\x{{4e00}}-\\x{{9fff}}]') AS zh, regexp_matches(sentence, '[A-Za-z]') AS en FROM {_DIST})")
def sentence_languages(spark: SparkSession, d: str) -> DataFrame:
    return _sentences(spark, d).select("sentence_id", T.sentence_language(F.col("sentence")).alias("lang"))


@query(f"SELECT doc_id, CASE WHEN zh > 0.7 * (zh + en) THEN 'zh' WHEN zh > 0.3 * (zh + en) AND zh >= en THEN 'zh' ELSE 'en' END AS lang FROM (SELECT doc_id, {_HAN.format('text')} AS zh, len(regexp_extract_all(text, '[a-zA-Z]')) AS en FROM documents WHERE text IS NOT NULL)")
def primary_languages(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").where("text IS NOT NULL").select("doc_id", T.primary_language(F.col("text")).alias("lang"))


@query("SELECT doc_id, len(regexp_extract_all(text, '[\\x{4e00}-\\x{9fff}]+|[a-zA-Z]+|[\\s\\p{Z}]+|[^\\s\\p{Z}]'))::BIGINT AS pieces, len(regexp_extract_all(text, '[A-Za-z]+|\\d+(?:\\.\\d+)?|[\\x{4e00}-\\x{9fff}]|[^\\s\\p{Z}]'))::BIGINT AS rough FROM documents WHERE text IS NOT NULL")
def token_pieces(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.size(T.pieces(F.col("text"))).cast("bigint").alias("pieces"), F.size(T.rough_tokens(F.col("text"))).cast("bigint").alias("rough"))


_STREAMS = f"(SELECT doc_id, lang, w FROM (SELECT doc_id, 'en' AS lang, {_ASCII} AS w, CASE WHEN zh > 0.7 * (zh + e) THEN 'zh' WHEN zh > 0.3 * (zh + e) THEN 'mixed' ELSE 'en' END AS l FROM (SELECT *, {_HAN.format('text')} AS zh, len(regexp_extract_all(text, '[a-zA-Z]')) AS e FROM {_LIB} WHERE text IS NOT NULL) UNION ALL SELECT doc_id, 'zh', regexp_extract_all(text, '[\\x{{4e00}}-\\x{{9fff}}]'), CASE WHEN zh > 0.7 * (zh + e) THEN 'zh' WHEN zh > 0.3 * (zh + e) THEN 'mixed' ELSE 'en' END FROM (SELECT *, {_HAN.format('text')} AS zh, len(regexp_extract_all(text, '[a-zA-Z]')) AS e FROM {_LIB} WHERE text IS NOT NULL)) WHERE l IN (lang, 'mixed') AND len(w) >= 2)"


@query(f"SELECT lang, bigram, count(DISTINCT doc_id) AS doc_freq, count(*) AS total_freq FROM (SELECT doc_id, lang, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i+1])) AS bigram FROM {_STREAMS}) GROUP BY lang, bigram")
def bigrams_by_language(spark: SparkSession, d: str) -> DataFrame:
    """Adjacent tokens of the library by language; a mixed document counts in both, Chinese tokens are single characters."""
    return corpus.phrases_by_language(_library(spark, d))


@query(f"SELECT lang, count(DISTINCT doc_id) AS docs, sum(len(w) - 1)::BIGINT AS bigrams FROM {_STREAMS} GROUP BY lang")
def docs_by_language(spark: SparkSession, d: str) -> DataFrame:
    return corpus.documents_by_language(_library(spark, d))


@query(f"SELECT DISTINCT sentence_id, unnest(list_distinct(list_filter(regexp_extract_all(sentence, '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '(18|19|20)[0-9]{{2}}[a-zA-Z]?')))) AS year FROM {_DIST} WHERE NOT regexp_matches(sentence, '[0-9]{{4}}[a-zA-Z]\\s*[,;]')")
def sentence_years(spark: SparkSession, d: str) -> DataFrame:
    """Years of the sentences without runs of letters (their expansion is tested on fixtures)."""
    s = _sentences(spark, d).where(~F.col("sentence").rlike("[0-9]{4}[a-zA-Z]\\s*[,;]"))
    return s.select("sentence_id", F.explode(citing.years(F.col("sentence"))).alias("year")).distinct()


@query("SELECT ref_id, regexp_extract(' ' || regexp_replace(trim(r), '^\\s*(\\[\\d+\\]|\\d+\\.)\\s+', '') || ' ', '[^\\p{L}\\p{N}_]((18|19|20)\\d{2}[a-zA-Z]?)[^\\p{L}\\p{N}_]', 1) AS year, regexp_matches(r, '^\\s*(\\[\\d+\\]|\\d+\\.)\\s+') AS numbered FROM (SELECT ref_id, arg_max(reference, received_at) AS r FROM reference_entries GROUP BY ref_id) WHERE r IS NOT NULL")
def reference_years(spark: SparkSession, d: str) -> DataFrame:
    r = latest(read(spark, d, "reference_entries"), "ref_id", "received_at", "reference").where("reference IS NOT NULL")
    return r.select("ref_id", citing.reference_year(F.col("reference")).alias("year"), F.col("reference").rlike("^\\s*(?:\\[\\d+\\]|\\d+\\.)\\s+").alias("numbered"))


@query()
def citations_found(spark: SparkSession, d: str) -> DataFrame:
    """All citations of all sentences: narrative, Chinese, in brackets (tested on fixtures)."""
    return _sentences(spark, d).select("sentence_id", F.posexplode(citing.citations(F.col("sentence"))).alias("cite_no", "c")).select("sentence_id", "cite_no", "c.*")


@query()
def sentences_main(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of all documents with their positions (tested on fixtures)."""
    docs = read(spark, d, "documents").where("text IS NOT NULL").select("doc_id", "text")
    rows = segment.with_sentences(docs, "text", T.language(F.col("text")))
    return rows.select("doc_id", F.posexplode("sentences").alias("sent_no", "s")).select("doc_id", "sent_no", "s.start", "s.end")


def _document_pages(spark: SparkSession, d: str) -> DataFrame:
    """(doc, page, text): documents as papers, their form feeds as page breaks."""
    docs = read(spark, d, "documents").where("text IS NOT NULL")
    return docs.select(F.col("doc_id").cast("string").alias("doc"), F.posexplode(F.split("text", "\\f")).alias("page", "text")).withColumn("page", F.col("page") + 1)


@query()
def material_sections(spark: SparkSession, d: str) -> DataFrame:
    return pages.material(_document_pages(spark, d))["sections"]


@query()
def material_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return pages.material(_document_pages(spark, d))["paragraphs"].select("doc", "id", "page", "section", F.size("sentences").alias("sentences"), F.length("text").alias("chars"))


@query()
def material_references(spark: SparkSession, d: str) -> DataFrame:
    return pages.material(_document_pages(spark, d))["references"]


@query()
def citation_bank(spark: SparkSession, d: str) -> DataFrame:
    """Citing sentences of all documents before their references."""
    return pages.citation_sentences(_document_pages(spark, d))


@query()
def audit_issues(spark: SparkSession, d: str) -> DataFrame:
    """Style issues and repeated openings of every sentence of the papers."""
    s = latest(read(spark, d, "citation_sentences"), "sentence_id", "received_at", "pdf", "sentence").where("sentence IS NOT NULL")
    s = s.select(F.col("pdf").alias("doc"), "sentence_id", F.col("sentence").alias("text"), T.sentence_language(F.col("sentence")).alias("lang"))
    return audit.style_issues(s).unionByName(audit.repetition(s))


@query()
def audit_diagnoses(spark: SparkSession, d: str) -> DataFrame:
    """The sentences of each paper by the weight of their issues."""
    return audit.diagnoses(audit_issues(spark, d)).select("doc", "sentence_id", "warnings", "top", "position", F.size("issues").alias("issues"))


@query()
def lexical_bundle(spark: SparkSession, d: str) -> DataFrame:
    """The most frequent words of each paper and those the library hardly has."""
    s = latest(read(spark, d, "citation_sentences"), "sentence_id", "received_at", "pdf", "sentence").where("sentence IS NOT NULL")
    s = s.select(F.col("pdf").alias("doc"), "sentence_id", F.col("sentence").alias("text"), T.sentence_language(F.col("sentence")).alias("lang"))
    lib = _library(spark, d)
    return audit.lexical(s, corpus.vocabulary(lib), corpus.documents_by_language(lib).select("lang", "docs"))


@query("SELECT item_id, s AS secret, 'S' || item_id || '_E1' AS evidence FROM (SELECT item_id, CASE WHEN length(a) <= 4 THEN repeat('*', length(a)) ELSE repeat('*', length(a) - 4) || right(a, 4) END AS s FROM (SELECT item_id, trim(arg_max(cited_author, checked_at)) AS a FROM cite_check_items GROUP BY item_id) WHERE a IS NOT NULL)")
def masked_secrets(spark: SparkSession, d: str) -> DataFrame:
    """Cited names as if they were secrets, and identifiers of evidence in their one form."""
    a = latest(read(spark, d, "cite_check_items"), "item_id", "checked_at", "cited_author").where("cited_author IS NOT NULL")
    return a.select("item_id", review.masked_secret(F.col("cited_author")).alias("secret"), review.evidence_id(F.concat(F.lit(" s"), F.col("item_id"), F.lit("-- e1."))).alias("evidence"))


@query("SELECT item_id, CASE WHEN upper(trim(v)) LIKE 'ACC%' THEN 'ACCURATE' WHEN upper(trim(v)) LIKE 'INACC%' THEN 'INACCURATE' WHEN upper(trim(v)) LIKE 'MIS%' THEN 'MISATTRIBUTED' WHEN upper(trim(v)) LIKE 'NOT%' THEN 'NOT_FOUND' ELSE 'PARSE_ERROR' END AS verdict FROM (SELECT item_id, arg_max(verdict, checked_at) AS v FROM cite_check_items GROUP BY item_id)")
def verdicts(spark: SparkSession, d: str) -> DataFrame:
    return latest(read(spark, d, "cite_check_items"), "item_id", "checked_at", "verdict").select("item_id", F.coalesce(review.verdict(F.col("verdict")), F.lit("PARSE_ERROR")).alias("verdict"))
