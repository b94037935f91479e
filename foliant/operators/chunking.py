"""Pages and chunks: overlapping pieces of page texts, numbered over the whole document."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.functions import text as X

SIZE, OVERLAP = 400, 50
SEPARATORS = ("\n\n", "\n", " ", "")


def _pieces(text: str, separator: str) -> list[str]:
    """Parts that begin with the separator, but for the first; single characters for the empty separator."""
    if not separator:
        return list(text)
    first, *rest = text.split(separator)
    return [p for p in [first, *(separator + r for r in rest)] if p]


def _merged(pieces: list[str], size: int, overlap: int) -> list[str]:
    """Neighbouring pieces joined up to ``size``; each result begins with the last pieces of the one before, up to ``overlap``."""
    out, held, total = [], [], 0

    def emit() -> None:
        joined = "".join(held).strip()
        if joined:
            out.append(joined)

    for piece in pieces:
        n = len(piece)
        if held and total + n > size:
            emit()
            drop = 0
            while total > overlap or (total > 0 and total + n > size):
                total -= len(held[drop])
                drop += 1
            del held[:drop]
        held.append(piece)
        total += n
    if held:
        emit()
    return out


def split_recursively(text: str, size: int = SIZE, overlap: int = OVERLAP, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Split at the coarsest separator that occurs; pieces that are still too long are split at finer ones."""
    at = next((i for i, s in enumerate(separators) if not s or s in text), len(separators) - 1)
    finer, out, fitting = separators[at + 1 :], [], []
    for piece in _pieces(text, separators[at]):
        if len(piece) < size:
            fitting.append(piece)
            continue
        out += _merged(fitting, size, overlap)
        fitting = []
        out += split_recursively(piece, size, overlap, finer) if finer else [piece]
    return out + _merged(fitting, size, overlap)


def chunk_pages(pages: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, doc_name, page, chunk_index, text) from (doc_id, doc_name, page, text).

    Blank and null pages give no chunk; chunk_index runs from 0 over the document in the order of its pages. A chunk never crosses a page.
    """

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_recursively(t, size, overlap))

    kept = pages.where(F.coalesce(X.strip(F.col("text")), F.lit("")) != "")
    pieces = kept.select("doc_id", "doc_name", "page", split("text").alias("pieces"))
    w = Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)  # over pages, not chunks
    first = pieces.withColumn("first", F.coalesce(F.sum(F.size("pieces")).over(w), F.lit(0)).cast("int"))
    return first.select("doc_id", "doc_name", "page", "first", F.posexplode("pieces").alias("pos", "text")).select("doc_id", "doc_name", "page", (F.col("first") + F.col("pos")).alias("chunk_index"), "text")


def line_chunks(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, chunk_index, text): the non-blank lines of each text, numbered from 0. No shuffle: the numbers come from the array."""
    lines = F.filter(F.transform(F.split("text", "\n"), X.strip), lambda x: x != "")
    return documents.select(key, F.posexplode(lines).alias("chunk_index", "text"))


def page_stats(chunks: DataFrame) -> DataFrame:
    """(doc_id, word_count, page_count, read_time_mins) over (doc_id, page, text); words of overlaps count as often as they occur."""
    rows = chunks.select("doc_id", "page", X.word_count(F.col("text")).alias("words"))
    per = rows.groupBy("doc_id").agg(F.sum("words").alias("word_count"), F.max(F.coalesce("page", F.lit(1))).alias("page_count"))
    return per.withColumn("read_time_mins", X.reading_minutes(F.col("word_count")))


def flat_chunks(chunks: DataFrame) -> DataFrame:
    """Stored chunks with their place as columns: (doc_id, doc_name, page, chunk_index, text); repeated rows and rows without a key or place go."""
    from foliant.session import key_of

    m = F.col("metadata")
    flat = chunks.select(key_of(m["doc_id"]).alias("doc_id"), m["doc_name"].alias("doc_name"), m["page"].alias("page"), m["chunk_index"].alias("chunk_index"), "text")
    # copies differ in nothing that counts: the least text of a place stands for it
    keep = F.min(F.struct(F.coalesce("text", F.lit("")).alias("text"), "doc_name", "page"))
    return flat.where("doc_id is not null and chunk_index is not null").groupBy("doc_id", "chunk_index").agg(keep.alias("r")).select("doc_id", "r.doc_name", "r.page", "chunk_index", "r.text")
