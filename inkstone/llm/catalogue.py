"""The registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.llm import chunking, languages, linking, mixing, names, neardup, sentences, spam, tokenize
from inkstone.session import latest, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.oversized_nodes(chunking.split_oversized(read(spark, sf_dir, "rag_nodes")))


@query
def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece with its text; of a record that came twice the latest delivery is cut."""
    long_ = read(spark, sf_dir, "rag_nodes").where(F.length("text") > chunking.LIMIT)
    return chunking.split_oversized(latest(long_, "node_no", "ingested_at", "text", "page"))


def _name_fields(spark: SparkSession, sf_dir: str) -> list[tuple[DataFrame, str]]:
    cited = read(spark, sf_dir, "citation_sentences").select(F.explode("citations.authors").alias("authors"))
    return [(cited, "authors"), (read(spark, sf_dir, "reference_entries"), "authors"), (read(spark, sf_dir, "cite_check_items"), "cited_author")]


@query
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.variant_pairs(names.link_variants(_name_fields(spark, sf_dir)))


@query
def p2_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every spelling with its group."""
    return names.link_variants(_name_fields(spark, sf_dir))


@query
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    polished = languages.polished_languages(read(spark, sf_dir, "polish_results"), read(spark, sf_dir, "citation_sentences"), read(spark, sf_dir, "lang_labels"))
    return languages.language_findings(polished)


#: The two tables of texts: name, key, text column.
TEXT_TABLES = (("rag_nodes", "node_no", "text"), ("citation_sentences", "sentence_id", "sentence"))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [read(spark, sf_dir, t).select(F.lit(t).alias("tbl"), F.col(k).alias("id"), F.col(c).alias("text")) for t, k, c in TEXT_TABLES]
    return parts[0].unionByName(parts[1])


@query
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_texts(spark, sf_dir))


@query
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [sentences.split_sentences(read(spark, sf_dir, t), k, c).select(F.lit(t).alias("tbl"), "rec_id", "sent_no", "end_pos") for t, k, c in TEXT_TABLES]
    return parts[0].unionByName(parts[1])


@query
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linking.match_works(read(spark, sf_dir, "cite_check_items"), read(spark, sf_dir, "reference_entries")).select("item_id", "ref_id")


@query
def p6_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pairs with their confidence."""
    return linking.match_works(read(spark, sf_dir, "cite_check_items"), read(spark, sf_dir, "reference_entries"))


@query
def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize.encode_documents(read(spark, sf_dir, "documents"))


@query
def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of the mixture with its tokens and how often it is used."""
    return mixing.mix(read(spark, sf_dir, "documents"), read(spark, sf_dir, "mix_targets"))


@query
def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares that were reached."""
    targets = read(spark, sf_dir, "mix_targets")
    return mixing.reached(mixing.mix(read(spark, sf_dir, "documents"), targets), targets)


@query
def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spam.page_shares(read(spark, sf_dir, "documents")).where("flagged").select("doc_id")


@query
def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spam.page_shares(read(spark, sf_dir, "documents"))
