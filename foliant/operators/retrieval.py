"""Retrieval: vector candidates, keyword scores among them, boosts, the cut, and neighbouring context. All questions run as one plan."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import answers as A
from foliant.functions import text as X

# How a question asks for a definition, and how a text gives one.
DEFINITION_PREFIXES = ("what is", "what are", "define", "meaning of", "explain what", "describe")
DEFINITION_PATTERNS = ("is a", "refers to", "defined as", "can be defined as", "means", "is the general term", "is a type of")
CONTENT_STOP = ("what", "with", "from", "that")
# What may stand between a subject and its definition, and the verbs that define.
_BETWEEN = r"\b(?:\s*\([^)]*\))?(?:\s*,\s*[^,]+,\s*)?(?:\s*(?:sometimes|commonly|also|frequently|often|abbreviated\s+to\s+['\"\w\s.-]+|referred\s+to\s+as\s+['\"\w\s.-]+))*\s+\b"
_VERBS = r"(?:is\s+a|refers\s+to|means|is\s+the\s+general\s+term|is\s+defined\s+as|can\s+be\s+defined\s+as|is\s+a\s+relatively\s+new\s+form|is\s+a\s+type\s+of)\b"
_GAP_VERBS = r"(?:is a|refers to|defined as|means|is the general term|is a type of|is a relatively new form)\b"


@dataclass(frozen=True)
class Ranking:
    """Weights of the ranking. The defaults are the ranking in use; the two variants are earlier experiments."""

    k1: float = 1.5
    b: float = 0.75
    vector_weight: float = 0.6
    keyword_weight: float = 0.4
    pattern_boost: float = 0.05
    subject_boost: float = 0.45
    header_boost: float = 0.10
    header_low: int = 3
    header_high: int = 39
    header_by_line: bool = False
    subject_gap: bool = False
    threshold: float = 0.5


VARIANT_A = Ranking(pattern_boost=0.15, subject_boost=0.0, header_low=0, header_high=59, header_by_line=True)
VARIANT_B = Ranking(subject_boost=0.25, subject_gap=True)

#: Questions scored together; more come in further passes over the vectors, so that what is sent with a task is bounded.
QUESTION_BLOCK = 5_000


def question_features(questions: DataFrame) -> DataFrame:
    """The questions with what ranking needs: is_definition, subject, content_words and terms, computed once per question."""
    q = F.lower(X.strip(F.coalesce("question", F.lit(""))))
    prefix = "^(?:" + "|".join(DEFINITION_PREFIXES) + ")"
    subject = F.btrim(F.btrim(X.strip(F.regexp_replace(q, prefix, "")), F.lit("? .!")), F.lit(" \t\r\n"))
    return questions.select(
        "*", q.rlike(prefix).alias("is_definition"), F.when(q.rlike(prefix), subject).otherwise(q).alias("subject"),
        F.filter(X.words(q), lambda w: (F.length(w) > 3) & ~w.isin(*CONTENT_STOP)).alias("content_words"), X.terms(F.col("question")).alias("terms"),
    )


def _distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, d: s + d)


def _nearest(df: DataFrame, questions: DataFrame) -> DataFrame:
    """The candidates by distance. The literal limit lets each task drop all but that many of a question before the shuffle."""
    most = max(15, 3 * (questions.agg(F.max("top_k")).first()[0] or 0))
    w = Window.partitionBy("query_id").orderBy("distance", "doc_id", "chunk_index")
    ranked = df.withColumn("vector_rank", F.row_number().over(w)).where(F.col("vector_rank") <= most)
    return ranked.where(F.col("vector_rank") <= A.candidate_count(F.col("top_k")))


def candidates_in_scope(questions: DataFrame, vectors: DataFrame) -> DataFrame:
    """(query_id, top_k, doc_id, chunk_index, distance, vector_rank): nearest chunks of the documents each question names.

    ``questions``: query_id, top_k, vector, doc_ids; ``vectors``: doc_id, chunk_index, embedding. The scope is an equi-join on
    doc_id, so only named documents are read past it. Distances are squared, in double precision.
    """
    asked = questions.select("query_id", "top_k", "vector", F.explode(F.array_distinct("doc_ids")).alias("doc_id"))
    met = asked.join(vectors.select("doc_id", "chunk_index", "embedding"), "doc_id").where(F.size("vector") == F.size("embedding"))
    return _nearest(met.select("query_id", "top_k", "doc_id", "chunk_index", _distance(F.col("vector"), F.col("embedding")).alias("distance")), questions)


def candidates(questions: DataFrame, vectors: DataFrame, block: int = QUESTION_BLOCK) -> DataFrame:
    """As :func:`candidates_in_scope`, over all vectors: a stated set of questions, in blocks, against every vector.

    Each task keeps the best of its vectors per question, so what is shuffled grows with the questions, not with the pairs.
    """
    n_blocks = max(1, -(-questions.count() // block))
    out: DataFrame | None = None
    for i in range(n_blocks):
        part = questions.where(F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)) == i).select("query_id", "top_k", "vector").where("vector is not null")
        found = _scan(part.toPandas(), vectors, questions)
        out = found if out is None else out.unionByName(found)
    assert out is not None
    return _nearest(out, questions)


def _scan(asked: pd.DataFrame, vectors: DataFrame, questions: DataFrame) -> DataFrame:
    ids, tops = asked["query_id"].to_numpy(), asked["top_k"].to_numpy(dtype=int) if len(asked) else np.zeros(0, int)
    matrix = np.array([np.asarray(v, np.float64) for v in asked["vector"]]) if len(asked) else np.zeros((0, 0))

    def scan(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            pdf = pdf[[v is not None and len(v) == matrix.shape[1] for v in pdf["embedding"]]].reset_index(drop=True)
            if not len(pdf) or not len(matrix):
                continue
            pdf = pdf.sort_values(["doc_id", "chunk_index"], na_position="first", ignore_index=True)  # a place settles equal distances
            x = np.stack(pdf["embedding"].to_numpy()).astype(np.float64)
            largest = (x * x).sum(1).max()
            for at in range(0, len(matrix), 256):
                q = matrix[at : at + 256]
                rough = (q * q).sum(1)[:, None] + (x * x).sum(1)[None] - 2 * q @ x.T
                k = min(len(x), max(15, 3 * int(tops.max())) + 5)
                # all that may be among the k nearest, however many are equally near; then the cut by distance and place
                slack = 1e-12 * ((q * q).sum(1)[:, None] + largest)
                rows, cols = np.nonzero(~(rough > np.partition(rough, k - 1, axis=1)[:, k - 1, None] + slack))
                exact = np.concatenate([((q[rows[a : a + 65_536]] - x[cols[a : a + 65_536]]) ** 2).sum(1) for a in range(0, len(rows), 65_536)])
                order = np.lexsort((cols, exact, rows))
                order = order[np.arange(len(rows)) - np.searchsorted(rows, rows) < k]
                rows, exact, hit = rows[order], exact[order], pdf.iloc[cols[order]]
                yield pd.DataFrame({
                    "query_id": ids[at + rows], "top_k": tops[at + rows],
                    "doc_id": hit["doc_id"].to_numpy(), "chunk_index": hit["chunk_index"].to_numpy(), "distance": exact,
                })

    kind = questions.schema["query_id"].dataType.simpleString()
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    held = vectors.select("doc_id", "chunk_index", "embedding").where(F.col("embedding").isNotNull() & finite)
    return held.mapInPandas(scan, f"query_id {kind}, top_k int, doc_id string, chunk_index int, distance double")


def scored(cands: DataFrame, questions: DataFrame, chunks: DataFrame, ranking: Ranking = Ranking()) -> DataFrame:
    """Candidates with every score: one row per question and candidate.

    (query_id, doc_id, chunk_index, vector_rank, distance, similarity, keyword, keyword_norm, pattern_boost, subject_boost,
    header_boost, hybrid, rank, text, reasons), ``reasons`` naming the boosts that it got. The keyword score's corpus is the candidates of the question, a few dozen at most, so they are gathered
    in one array and scored by array functions: one shuffle by question, no join of terms.
    """
    held = cands.join(chunks.select("doc_id", "chunk_index", "text"), ["doc_id", "chunk_index"])
    item = F.struct("vector_rank", "doc_id", "chunk_index", "distance", F.coalesce("text", F.lit("")).alias("text"), X.terms(F.col("text")).alias("t"))
    grouped = held.select("query_id", item.alias("c")).groupBy("query_id").agg(F.array_sort(F.collect_list("c")).alias("cs"))
    asked = question_features(questions.select("query_id", "question"))
    g = grouped.join(asked, "query_id")
    n = F.size("cs").cast("double")
    total = F.aggregate("cs", F.lit(0.0), lambda s, c: s + F.size(c["t"]))
    g = g.withColumn("mean_length", F.when(total > 0, total / n).otherwise(1.0))
    # a query term with its weight, once per time it is asked
    weight = lambda df: F.log((n - df + 0.5) / (df + 0.5) + 1.0)
    with_df = F.transform("terms", lambda q: F.struct(q.alias("q"), F.size(F.filter("cs", lambda c: F.array_contains(c["t"], q))).cast("double").alias("df")))
    g = g.withColumn("weights", F.transform(with_df, lambda x: F.struct(x["q"].alias("q"), weight(x["df"]).alias("w"))))

    def keyword(c: Column) -> Column:
        slack = ranking.k1 * (1.0 - ranking.b + ranking.b * (F.size(c["t"]) / F.col("mean_length")))
        counted = F.transform("weights", lambda x: F.struct(x["w"].alias("w"), F.size(F.filter(c["t"], lambda t: t == x["q"])).cast("double").alias("tf")))
        return F.aggregate(counted, F.lit(0.0), lambda s, x: s + F.when(x["tf"] > 0, x["w"] * x["tf"] * (ranking.k1 + 1) / (x["tf"] + slack)).otherwise(0.0))

    g = g.withColumn("cs", F.transform("cs", lambda c: F.struct(c["vector_rank"].alias("vector_rank"), c["doc_id"].alias("doc_id"), c["chunk_index"].alias("chunk_index"), c["distance"].alias("distance"), c["text"].alias("text"), keyword(c).alias("keyword"))))
    rows = g.withColumn("most", F.array_max(F.transform("cs", lambda c: c["keyword"]))).select("query_id", "is_definition", "subject", "content_words", "most", F.inline("cs"))

    text, lower = F.col("text"), F.lower("text")
    pattern = F.when(F.col("is_definition") & lower.rlike("|".join(DEFINITION_PATTERNS)), ranking.pattern_boost).otherwise(0.0)
    quoted = F.concat(F.lit("\\Q"), F.replace("subject", F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    near = F.concat(F.lit("(?iU)\\b"), quoted, F.lit("\\b(?:[^\\n]{0,50})?\\b" + _GAP_VERBS)) if ranking.subject_gap else F.concat(F.lit("(?iU)"), quoted, F.lit(_BETWEEN + _VERBS))
    subject = F.when(F.col("is_definition") & (F.col("subject") != "") & F.regexp_like(text, near), ranking.subject_boost).otherwise(0.0)
    if ranking.header_by_line:
        heads = F.filter(F.transform(F.split(text, "\n"), X.strip), lambda p: (F.length(p) <= ranking.header_high) & (F.upper(p) == p) & (F.lower(p) != p))
    else:
        heads = X.header_segments(text, ranking.header_low, ranking.header_high)
    header = F.when(F.exists(heads, lambda h: F.exists("content_words", lambda w: F.lower(h).contains(w))), ranking.header_boost).otherwise(0.0)
    norm = F.when(F.col("most") > 0, F.col("keyword") / F.col("most")).otherwise(0.0)
    rows = rows.select("*", A.similarity(F.col("distance")).alias("similarity"), norm.alias("keyword_norm"), pattern.alias("pattern_boost"), subject.alias("subject_boost"), header.alias("header_boost"))
    base = ranking.vector_weight * F.col("similarity") + ranking.keyword_weight * F.col("keyword_norm")
    hybrid = F.least(F.lit(1.0), base + F.col("pattern_boost") + F.col("subject_boost") + F.col("header_boost"))
    rows = rows.withColumn("hybrid", hybrid)
    boosted = (("pattern_boost", "definition pattern"), ("subject_boost", "subject next to its definition"), ("header_boost", "word of the question in a header"))
    reasons = F.array_compact(F.array(*[F.when(F.col(c) > 0, text_) for c, text_ in boosted]))
    # rounded, so that noise in the last bits does not decide an order; equal ones stay in the order of the vectors
    w = Window.partitionBy("query_id").orderBy(F.round("hybrid", 9).desc(), "vector_rank")
    return rows.select(
        "query_id", "doc_id", "chunk_index", "vector_rank", "distance", "similarity", "keyword", "keyword_norm", "pattern_boost", "subject_boost", "header_boost", "hybrid",
        F.row_number().over(w).alias("rank"), "text", reasons.alias("reasons"),
    )


def kept(rows: DataFrame, questions: DataFrame, ranking: Ranking = Ranking()) -> DataFrame:
    """The first top_k of each question, less those below the threshold; no others move up."""
    return rows.join(questions.select("query_id", "top_k"), "query_id").where((F.col("rank") <= F.col("top_k")) & (F.round("hybrid", 9) >= ranking.threshold)).drop("top_k")


def with_neighbours(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """Each row with the text of the chunk after it in its document, null at the end; joined after the cut."""
    after = chunks.select("doc_id", (F.col("chunk_index") - 1).alias("chunk_index"), F.col("text").alias("next_text"))
    return rows.join(after, ["doc_id", "chunk_index"], "left")


def results(rows: DataFrame) -> DataFrame:
    """(query_id, place, doc_id, chunk_index, text, hybrid, distance): results in rank order, each with the text after it.

    A chunk already used, as a result or as the continuation of an earlier result, is passed over. That depends on the order, so it
    is a fold over the few results of a question.
    """
    item = F.struct("rank", "doc_id", "chunk_index", "hybrid", "text", "next_text")
    lists = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("cs"))
    key = lambda d, i: F.concat_ws("\0", d, i.cast("string"))
    shape = "struct<seen: array<string>, taken: array<int>>"

    def step(acc: Column, c: Column) -> Column:
        own, following = key(c["doc_id"], c["chunk_index"]), key(c["doc_id"], c["chunk_index"] + 1)
        marks = F.when(c["next_text"].isNotNull(), F.array(own, following)).otherwise(F.array(own))
        taken = F.struct(F.concat(acc["seen"], marks).alias("seen"), F.concat(acc["taken"], F.array(c["rank"])).alias("taken"))
        return F.when(F.array_contains(acc["seen"], own), acc).otherwise(taken)

    start = F.struct(F.array().cast("array<string>").alias("seen"), F.array().cast("array<int>").alias("taken")).cast(shape)
    chosen = lists.withColumn("taken", F.aggregate("cs", start, step)["taken"])
    out = chosen.select("query_id", "taken", F.inline("cs")).where(F.array_contains("taken", F.col("rank")))
    joiner = F.when(F.col("text").endswith("\n"), "").otherwise("\n")
    text = F.when(F.col("next_text").isNotNull(), F.concat("text", joiner, "next_text")).otherwise(F.col("text"))
    return out.select("query_id", F.array_position("taken", F.col("rank")).cast("int").alias("place"), "doc_id", "chunk_index", text.alias("text"), "hybrid", (2.0 * (1.0 - F.col("hybrid"))).alias("distance"))


def search(questions: DataFrame, vectors: DataFrame, chunks: DataFrame, ranking: Ranking = Ranking(), scoped: bool = False) -> DataFrame:
    """The whole of it: candidates, scores, cut, continuation and dedupe."""
    near = candidates_in_scope(questions, vectors) if scoped else candidates(questions, vectors)
    cut = kept(scored(near, questions, chunks, ranking), questions, ranking)
    return results(with_neighbours(cut, chunks))
