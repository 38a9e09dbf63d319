"""Libraries of exemplar and reference documents: kinds, names, paths, files, readiness, vocabulary export."""

from __future__ import annotations

import os
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def kind(name: Column, given: Column | None = None) -> Column:
    """``exemplar`` or ``references``: as given, else by how the name begins or ends."""
    low = F.lower(F.trim(name))
    guess = F.when(low.rlike("^(?:refs?[_-]|citecheck|references)|[_-]refs$"), "references").otherwise("exemplar")
    if given is None:
        return guess
    known = F.lower(F.trim(given))
    return F.when(known.isin("exemplar", "references"), known).otherwise(guess)


def library_path(name: Column, folder: str) -> Column:
    return F.concat(F.lit(folder.rstrip("/") + "/"), F.regexp_replace(name, "[^\\p{L}\\p{N}_-]", "_"), F.lit(".json"))


def index_paths(path: Column) -> Column:
    """Where the sentences and vectors of a library stand."""
    base = F.regexp_replace(path, "\\.[^./\\\\]*$", "")
    return F.struct(F.concat(base, F.lit(".sentences.json")).alias("sentences"), F.concat(base, F.lit(".embeddings.npy")).alias("embeddings"))


def safe_name(name: Column, fallback: str = "default") -> Column:
    """A name that can be a file's: no reserved signs, a long one cut with a hash at its end."""
    s = F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(name, F.lit(""))), "[\\\\/:*?\"<>|\\r\\n\\t]+", "_"), "^[._ ]+|[._ ]+$", "")
    cut = F.concat(F.regexp_replace(F.substring(s, 1, 100), "[._ ]+$", ""), F.lit("_"), F.substring(F.sha1(s), 1, 10))
    return F.when(s == "", fallback).when(F.length(s) > 120, cut).otherwise(s)


def slug(name: str) -> str:
    """A name for a folder: words joined by underscores."""
    return re.sub(r"[^\w\-]+", "_", (name or "").strip()).strip("_") or "library"


def relative_path(path: Column, root: str) -> Column:
    """The path below a root, with forward slashes."""
    p, r = F.replace(path, F.lit("\\"), F.lit("/")), root.replace("\\", "/").rstrip("/") + "/"
    at = F.locate(r, p)
    return F.when(at > 0, F.substring(p, at + len(r), F.length(p))).otherwise(F.regexp_extract(p, "([^/]*)$", 1))


def discover(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """(path, rel, size, mtime): the files below a folder, by path in small letters."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    root = folder if "://" not in folder else folder.split("://", 1)[1]
    return files.select("path", relative_path(F.col("path"), root).alias("rel"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime")).orderBy(F.lower("path"), "path")


def extract_pages(files: DataFrame, extractor: Callable[[bytes], list[str]], max_pages: int | None = None) -> DataFrame:
    """(doc, page, text) of binary files by an injected extractor; a file that it cannot read has no pages."""

    def run(batches):  # noqa: ANN001, ANN202
        import pyarrow as pa

        for b in batches:
            rows = []
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    found = extractor(content)
                except Exception:  # noqa: BLE001 - an unreadable file counts as empty
                    found = []
                rows += [(path, i, t) for i, t in enumerate(found if max_pages is None else found[: max(1, int(max_pages))], 1)]
            cols = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string())], ["doc", "page", "text"])

    return files.select("path", "content").mapInArrow(run, "doc string, page int, text string")


def page_of_blocks(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, text) of layout blocks (*keys, type, x, y, text): those of text, from top to bottom and left to right."""
    some = blocks.where((F.coalesce("type", F.lit(0)) == 0) & (F.trim("text") != ""))
    per = some.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.bround(F.coalesce("y", F.lit(0.0)), 1).alias("y"), F.bround(F.coalesce("x", F.lit(0.0)), 1).alias("x"), F.trim("text").alias("t")))).alias("b"))
    return per.select(*keys, F.array_join(F.transform("b", lambda x: x["t"]), "\n").alias("text"))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a table is there to be read."""
    try:
        spark.read.parquet(path)
        return True
    except Exception:  # noqa: BLE001 - a missing table is the answer
        return False


#: What a library consists of; the last ones belong to exemplars only.
ARTIFACTS = ("vocabulary", "phrases", "meta", "passages", "citations", "references", "sections")


def status(spark: SparkSession, folder: str) -> dict[str, bool]:
    return {a: exists(spark, f"{folder.rstrip('/')}/{a}") for a in ARTIFACTS}


def build_missing(spark: SparkSession, folder: str, makers: dict[str, Callable[[], DataFrame]], force: bool = False) -> list[str]:
    """Write the tables that are not there yet (all with ``force``) and name them."""
    made = []
    for name, make in makers.items():
        path = f"{folder.rstrip('/')}/{name}"
        if force or not exists(spark, path):
            make().write.mode("overwrite").option("compression", "zstd").parquet(path)
            made.append(name)
    return made


def export_vocabulary(words: DataFrame, phrases: DataFrame, meta: DataFrame) -> DataFrame:
    """(json): a library as one JSON object of version 2.6, for programs that read it so; grows with the vocabulary.

    ``words``: (token, doc_freq, total_freq); ``phrases``: (lang, bigram, doc_freq, total_freq); ``meta``: one row (doc_count, language).
    """
    as_map = lambda k, v: F.map_from_entries(F.sort_array(F.collect_list(F.struct(k, v))))
    w = words.agg(as_map("token", "doc_freq").alias("word_doc_freq"), as_map("token", "total_freq").alias("word_total_freq"), F.sum("total_freq").alias("total_words"))
    per = phrases.groupBy("lang").agg(as_map("bigram", "doc_freq").alias("d"), as_map("bigram", "total_freq").alias("t"), F.sum("total_freq").alias("n"))
    by_lang = lambda v: F.map_from_entries(F.collect_list(F.struct("lang", v)))
    p = per.agg(by_lang("d").alias("bigram_doc_freq"), by_lang("t").alias("bigram_total_freq"), by_lang("n").alias("bigram_total_count"))
    one = meta.limit(1).crossJoin(w).crossJoin(p)  # one row each
    return one.select(F.to_json(F.struct("word_doc_freq", "word_total_freq", "doc_count", "language", "bigram_doc_freq", "bigram_total_freq", "bigram_total_count", "total_words", F.lit("2.6").alias("version"))).alias("json"))


def info(words: DataFrame, meta: DataFrame) -> DataFrame:
    """(doc_count, word_count) of a library."""
    return meta.select("doc_count").limit(1).crossJoin(words.agg(F.count(F.lit(1)).alias("word_count")))  # one row each


class Libraries:
    """The libraries below a folder: create, delete, rename, clear and list them."""

    def __init__(self, folder: str):
        self.folder = folder.rstrip("/")
        os.makedirs(self.folder, exist_ok=True)

    def path(self, name: str) -> str:
        return f"{self.folder}/{slug(name)}"

    def create(self, name: str, kind: str = "exemplar") -> str:
        os.makedirs(self.path(name), exist_ok=True)
        with open(f"{self.path(name)}/kind", "w", encoding="utf-8") as f:
            f.write(kind if kind in ("exemplar", "references") else "exemplar")
        return self.path(name)

    def exists(self, name: str) -> bool:
        return os.path.isdir(self.path(name))

    def kind(self, name: str) -> str:
        try:
            with open(f"{self.path(name)}/kind", encoding="utf-8") as f:
                return f.read().strip()
        except OSError:
            low = name.strip().lower()
            return "references" if re.search(r"^(?:refs?[_-]|citecheck|references)|[_-]refs$", low) else "exemplar"

    def list(self) -> list[dict[str, str]]:
        return [{"name": n, "kind": self.kind(n)} for n in sorted(os.listdir(self.folder)) if os.path.isdir(f"{self.folder}/{n}")]

    def rename(self, old: str, new: str) -> bool:
        if not self.exists(old) or self.exists(new):
            return False
        os.rename(self.path(old), self.path(new))
        return True

    def clear(self, name: str) -> bool:
        """Empty a library but keep it and its kind."""
        import shutil

        if not self.exists(name):
            return False
        was = self.kind(name)
        shutil.rmtree(self.path(name))
        self.create(name, was)
        return True

    def delete(self, name: str) -> bool:
        import shutil

        if not self.exists(name):
            return False
        shutil.rmtree(self.path(name))
        return True
