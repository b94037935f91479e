"""Uploaded files and earlier stores as DataFrames."""

from __future__ import annotations

import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions.times import stamp
from foliant.operators import chunking
from foliant.operators.catalog import current, insert_absent, placeholder
from foliant.sources import providers

_PAGES = "path string, name string, size long, page int, text string"


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def uploads(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, size, modified, content) of the files whose name ends in .pdf, in lower case. A path that does not exist is an error."""
    fs, at = _file_system(spark, path)
    if not fs.exists(at) and not fs.globStatus(at):
        raise FileNotFoundError(path)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.col("path").endswith(".pdf"))
    return files.select("path", F.substring_index("path", "/", -1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")


def _pdf_texts(content: bytes) -> list[str]:
    from pypdf import PdfReader  # optional: needed only where PDF files are read

    return [page.extract_text() or "" for page in PdfReader(io.BytesIO(content)).pages]


def pages(files: DataFrame, texts_of=_pdf_texts) -> DataFrame:
    """(path, name, size, page, text): the pages with text, numbered from 1 by their place in the file; ``texts_of`` reads a file's pages."""

    def read(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for row in pdf.to_dict("records"):
                out += [(row["path"], row["name"], row["size"], i, t) for i, t in enumerate(texts_of(row["content"]), 1) if t.strip()]
            yield pd.DataFrame(out, columns=["path", "name", "size", "page", "text"])

    return files.select("path", "name", "size", "content").mapInPandas(read, _PAGES)


def text_pages(documents: DataFrame, key: str = "id") -> DataFrame:
    """(doc_id, doc_name, page, text) of documents already read as text; form feeds part pages, pages without text keep their number."""
    return documents.select(F.col(key).alias("doc_id"), F.col("name").alias("doc_name"), F.posexplode(F.split("text", "\f")).alias("pos", "text")).select("doc_id", "doc_name", (F.col("pos") + 1).alias("page"), "text").where(F.trim("text") != "")


def earlier_store(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of an earlier JSON store: maps from doc_id to a record, with defaults for absent fields."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "documents map<string,string>, analytics map<string,string>, quizzes map<string,string>").alias("j"))

    def rows(name: str, fields: str) -> DataFrame:
        return raw.select(F.explode(f"j.{name}").alias("doc_id", "json")).select("doc_id", F.from_json("json", fields).alias("r"))

    zero = lambda c: F.coalesce(c, F.lit(0))
    documents = rows("documents", "name string, size bigint, upload_time string").select(
        F.col("doc_id").alias("id"), F.coalesce("r.name", F.lit("Unknown")).alias("name"), zero(F.col("r.size")).alias("size"), F.coalesce("r.upload_time", F.lit("")).alias("upload_time")
    )
    analytics = rows("analytics", "word_count int, page_count int, read_time_mins int, complexity_score string, summary string, entities string, alerts string, suggested_questions string").select(
        "doc_id", *[zero(F.col(f"r.{c}")).alias(c) for c in ("word_count", "page_count", "read_time_mins")], F.coalesce("r.complexity_score", F.lit("Medium")).alias("complexity_score"),
        *[F.coalesce(f"r.{c}", F.lit("[]")).alias(c) for c in ("summary", "entities", "alerts", "suggested_questions")],
    )
    quizzes = raw.select(F.explode("j.quizzes").alias("doc_id", "questions"))
    return {"documents": documents, "analytics": analytics, "quizzes": quizzes}


def import_earlier_store(spark: SparkSession, path: str, owner: str, stored: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The rows of an earlier JSON store whose keys the ``stored`` tables lack, its documents under ``owner``; no rows once it is marked as imported.

    Append them and then call :func:`mark_imported`: an import that breaks off before is simply done again.
    """
    fs, at = _file_system(spark, path)
    if not fs.exists(at):
        return {}
    found = earlier_store(spark, path)
    found["documents"] = found["documents"].withColumn("user_id", F.lit(owner))
    return {name: insert_absent(stored[name], rows, ["id" if name == "documents" else "doc_id"]) for name, rows in found.items() if name in stored}


def mark_imported(spark: SparkSession, path: str) -> bool:
    """Rename an earlier store so that it is not imported again; False if it is gone already."""
    fs, at = _file_system(spark, path)
    return fs.exists(at) and fs.rename(at, spark._jvm.org.apache.hadoop.fs.Path(f"{path}.imported"))


#: The summary of a document whose analytics are still being made. Fixed value.
PLACEHOLDER = "Analyzing document content"


def ingest(pages_of: DataFrame, owner: Column, uploaded_at: Column, size: int = 400, overlap: int = 50, model=None) -> dict[str, DataFrame]:
    """Tables for the pages (path, name, size, page, text) of uploads: documents, chunks with vectors, and placeholder analytics with word and page counts.

    A document's id is a hash of its path, so that an upload that is run again gives the same rows. Files without text have a document and nothing else.
    """
    placed = pages_of.withColumn("doc_id", F.md5("path"))
    documents = placed.groupBy(F.col("doc_id").alias("id")).agg(F.first("name").alias("name"), F.first("size").alias("size")).select("id", owner.alias("user_id"), "name", "size", stamp(uploaded_at).alias("upload_time"))
    pieces = chunking.chunk_pages(placed.select("doc_id", F.col("name").alias("doc_name"), "page", "text"), size, overlap)
    counts = chunking.page_stats(pieces)
    analytics = counts.select("doc_id", "word_count", "page_count", "read_time_mins", F.lit("Medium").alias("complexity_score"), F.to_json(F.array(F.lit(PLACEHOLDER))).alias("summary"), *[F.lit("[]").alias(c) for c in ("entities", "alerts", "suggested_questions")], uploaded_at.alias("loaded_at"))
    return {"documents": documents, "chunks": providers.embed(pieces, "text", model), "analytics": analytics}


def pending(analytics: DataFrame) -> DataFrame:
    """The documents whose latest analytics are still a placeholder: what a reader polls for until it is empty."""
    last = current(analytics.select("doc_id", "summary", "loaded_at"), ["doc_id"], "loaded_at")
    return last.where(placeholder(F.from_json("summary", "array<string>"))).select("doc_id")
