"""Context for answering: blocks of sources, samples of a document, and comparison of several documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions import answers as A
from foliant.operators.ordering import numbered

CONTEXT_LIMIT, DOCUMENT_LIMIT = 12_000, 3_000
GAP_MARK = "[... contiguous content left out ...]"


def _ordered(chunks: DataFrame) -> DataFrame:
    """place from 0 and number of chunks of each document, in the order of page and index, missing ones as 0; a block is a page and 4,096 indices of it."""
    index = F.coalesce("chunk_index", F.lit(0))
    block = F.struct(F.coalesce("page", F.lit(0)).alias("page"), F.floor(index / 4096).alias("part"))
    return numbered(chunks, ["doc_id"], block, [index])


def overview_sample(chunks: DataFrame, first: int = 5, last: int = 3) -> DataFrame:
    """(doc_id, place, text): all chunks of a short document; else the first and last few, with a mark between them."""
    rows = _ordered(chunks).where((F.col("n") <= first + last) | (F.col("place") < first) | (F.col("place") >= F.col("n") - last))
    marked = F.when((F.col("n") > first + last) & (F.col("place") == F.col("n") - last), F.array(F.struct((F.col("place") - 1).alias("place"), F.lit(GAP_MARK).alias("text")), F.struct("place", "text")))
    return rows.select("doc_id", F.inline(F.coalesce(marked, F.array(F.struct("place", "text")))))


def spread_sample(chunks: DataFrame, count: int = 10) -> DataFrame:
    """(doc_id, place, page, text): every n-th chunk, at most ``count``, n being the whole part of their number over ``count``."""
    step = F.greatest(F.lit(1), F.floor(F.col("n") / count))
    return _ordered(chunks).where((F.col("place") % step == 0) & (F.col("place") / step < count)).select("doc_id", "place", F.coalesce("page", F.lit(1)).alias("page"), "text")


def joined_context(rows: DataFrame, block, separator: str, key: str = "doc_id", order: str = "place", limit: int = CONTEXT_LIMIT) -> DataFrame:
    """(key, context): blocks of one key in order, joined and cut. For samples and results, which are few to a key."""
    lists = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), block.alias("b")))).alias("bs"))
    return lists.select(key, F.substring(F.array_join(F.transform("bs", lambda x: x["b"]), separator), 1, limit).alias("context"))


def answer_context(results: DataFrame, names: DataFrame) -> DataFrame:
    """(query_id, context, confidence, label, sources): what an answer to each question may use."""
    rows = results.join(names, ["doc_id", "chunk_index"], "left")
    block = A.context_block(F.col("place") - 1, F.col("doc_name"), F.col("page"), F.col("text"))
    source = F.struct("place", F.col("text"), F.coalesce("page", F.lit(1)).alias("page"), "doc_id", F.coalesce("doc_name", F.lit("Unknown Document")).alias("doc_name"), A.relevance(F.col("distance")).alias("relevance"))
    g = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", block.alias("b")))).alias("bs"), F.array_sort(F.collect_list(source)).alias("sources"), F.avg("distance").alias("d"))
    score = A.confidence(F.col("d"))
    return g.select("query_id", F.array_join(F.transform("bs", lambda x: x["b"]), "\n").alias("context"), score.alias("confidence"), A.level(score).alias("label"), "sources")


def by_document(results: DataFrame, names: DataFrame) -> DataFrame:
    """(query_id, doc_id, doc_name, first_place, chunks, text): the results of a question grouped by document, in order of first appearance."""
    rows = results.join(names, ["doc_id", "chunk_index"], "left")
    line = F.concat(F.lit("[Page "), F.coalesce("page", F.lit(1)).cast("string"), F.lit("]: "), "text")
    g = rows.groupBy("query_id", "doc_id").agg(F.max(F.coalesce("doc_name", F.lit("Unknown Document"))).alias("doc_name"), F.min("place").alias("first_place"), F.count("*").alias("chunks"), F.array_sort(F.collect_list(F.struct("place", line.alias("b")))).alias("bs"))
    return g.select("query_id", "doc_id", "doc_name", "first_place", "chunks", F.array_join(F.transform("bs", lambda x: x["b"]), "\n").alias("text"))


def compared(questions: DataFrame, grouped: DataFrame, missing: str = "no direct mention") -> DataFrame:
    """(query_id, doc_id, context): every document asked about with its context, or ``missing`` where it has none."""
    asked = questions.select("query_id", F.explode(F.array_distinct("doc_ids")).alias("doc_id"))
    context = grouped.select("query_id", "doc_id", F.substring("text", 1, DOCUMENT_LIMIT).alias("context"))
    return asked.join(context, ["query_id", "doc_id"], "left").withColumn("context", F.coalesce("context", F.lit(missing)))
