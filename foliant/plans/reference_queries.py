"""Registered queries of the document engine's own operators, over the whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import answers as A
from foliant.functions import render as R
from foliant.functions import text as X
from foliant.operators import catalog, chunking, compare, nested, retrieval
from foliant.operators.ordering import numbered
from foliant.plans.data_queries import ENTITY_SQL, OPTION_SQL, QUESTION_COUNT_SQL, RECORD_SQL, REPAIRED_SQL
from foliant.session import cut_lineage, key_of, table
from foliant.streaming import events

Query = Callable[[SparkSession, str], DataFrame]


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.flat_chunks(table(spark, d, "chunks"))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    """One vector per chunk, that of the lowest vec_id; vectors that cannot be compared go."""
    m, e = F.col("metadata"), F.col("embedding")
    rows = table(spark, d, "chunk_vectors").select(key_of(m["doc_id"]).alias("doc_id"), m["chunk_index"].alias("chunk_index"), "vec_id", "embedding")
    good = rows.where("doc_id is not null and chunk_index is not null and vec_id is not null").where((F.size(e) == 64) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x)) & F.exists(e, lambda x: x != 0))
    return good.groupBy("doc_id", "chunk_index").agg(F.min_by(F.struct("vec_id", "embedding"), "vec_id").alias("v")).select("doc_id", "chunk_index", "v.vec_id", "v.embedding")


def _questions(spark: SparkSession, d: str, scoped: bool = False) -> DataFrame:
    """A question for every vector whose vec_id is divisible by 100: its text asks for two words of the vector's chunk."""
    asked = _vectors(spark, d).where("vec_id % 100 = 0").join(_chunks(spark, d).select("doc_id", "chunk_index", "text"), ["doc_id", "chunk_index"])
    word = lambda i: F.split_part(F.coalesce("text", F.lit("")), F.lit(" "), F.lit(i))
    question = F.concat(F.lit("What is "), word(3), F.lit(" "), word(4), F.lit("?"))
    columns = [F.col("vec_id").alias("query_id"), question.alias("question"), F.lit(5).alias("top_k"), F.col("embedding").alias("vector")]
    # written once: their number, their most results and their vectors are each asked for before the search begins
    return cut_lineage(asked.select(*columns, *([F.array("doc_id").alias("doc_ids")] if scoped else [])))


def _scored(spark: SparkSession, d: str, ranking: retrieval.Ranking = retrieval.Ranking(), scoped: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    questions, vectors, chunks = _questions(spark, d, scoped), _vectors(spark, d), _chunks(spark, d)
    near = retrieval.candidates_in_scope(questions, vectors) if scoped else retrieval.candidates(questions, vectors)
    return retrieval.scored(near, questions, chunks, ranking), questions, chunks


def _kept(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows, questions, chunks = _scored(spark, d)
    return retrieval.kept(rows, questions), chunks


def _results(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    cut, chunks = _kept(spark, d)
    return retrieval.results(retrieval.with_neighbours(cut, chunks)), chunks


def vector_knn(spark: SparkSession, d: str) -> DataFrame:
    near = retrieval.candidates(_questions(spark, d), _vectors(spark, d))
    return near.select("query_id", "doc_id", "chunk_index", "vector_rank", F.round("distance", 6).alias("distance"), F.round(A.similarity(F.col("distance")), 6).alias("similarity"))


def _rounded(rows: DataFrame, *names: str) -> DataFrame:
    return rows.select("query_id", "doc_id", "chunk_index", *[F.round(n, 5).alias(n) if n not in ("rank", "vector_rank") else F.col(n) for n in names])


def hybrid_rank(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_scored(spark, d)[0], "vector_rank", "keyword_norm", "pattern_boost", "subject_boost", "header_boost", "hybrid", "rank")


def search(spark: SparkSession, d: str) -> DataFrame:
    return _results(spark, d)[0].select("query_id", "place", "doc_id", "chunk_index", "text", F.round("hybrid", 5).alias("hybrid"))


def search_confidence(spark: SparkSession, d: str) -> DataFrame:
    results, chunks = _results(spark, d)
    out = compare.answer_context(results, chunks.select("doc_id", "chunk_index", "doc_name", "page"))
    return out.select("query_id", "confidence", "label", F.size("sources").alias("sources"), F.length("context").alias("context_length"))


def search_scoped(spark: SparkSession, d: str) -> DataFrame:
    rows, _, _ = _scored(spark, d, scoped=True)
    return _rounded(rows, "vector_rank", "hybrid")


def neighbour_expand(spark: SparkSession, d: str) -> DataFrame:
    """Every chunk with the length of the one after it in its document."""
    chunks = _chunks(spark, d)
    return retrieval.with_neighbours(chunks.select("doc_id", "chunk_index"), chunks).select("doc_id", "chunk_index", F.length("next_text").alias("next_length"))


def compare_context(spark: SparkSession, d: str) -> DataFrame:
    results, chunks = _results(spark, d)
    return compare.by_document(results, chunks.select("doc_id", "chunk_index", "doc_name", "page")).select("query_id", "doc_id", "first_place", "chunks", F.length("text").alias("length"))


def compare_requested(spark: SparkSession, d: str) -> DataFrame:
    """Each question put to the documents of the first request, among those for two or more, that names its own document; where none does, to its own
    and to the next one in the catalogue's order of keys."""
    keys = F.array_distinct(F.filter(F.transform("doc_ids", lambda x: key_of(x)), lambda x: x.isNotNull()))
    requests = table(spark, d, "chat_pairs").where("pair_id is not null").select("pair_id", keys.alias("doc_ids")).where("size(doc_ids) >= 2")
    named = requests.select(F.explode("doc_ids").alias("own"), "pair_id", "doc_ids").groupBy("own").agg(F.min(F.struct("pair_id", "doc_ids"))["doc_ids"].alias("doc_ids"))
    own = _questions(spark, d, scoped=True).withColumn("own", F.element_at("doc_ids", 1)).drop("doc_ids")
    known = numbered(_documents(spark, d).select(key_of("id").alias("own"), F.lit(0).alias("all")).where("own is not null").distinct(), ["all"], F.substring("own", 1, 3), ["own"]).select("own", "place")
    following = known.join(known.select(F.col("own").alias("next"), (F.col("place") - 1).alias("place")), "place").select("own", "next")
    asked = own.join(named, "own", "left").join(following, "own", "left").withColumn("doc_ids", F.coalesce("doc_ids", F.array_compact(F.array("own", "next"))))
    questions, chunks = cut_lineage(asked.drop("own", "next")), _chunks(spark, d)
    results = retrieval.search(questions, _vectors(spark, d), chunks, scoped=True)
    grouped = compare.by_document(results, chunks.select("doc_id", "chunk_index", "doc_name", "page"))
    return compare.compared(questions, grouped).select("query_id", "doc_id", F.length("context").alias("length"))


def recursive_chunks(spark: SparkSession, d: str) -> DataFrame:
    pages = _documents(spark, d).select("doc_id", F.col("name").alias("doc_name"), F.lit(1).alias("page"), "text")
    return chunking.chunk_pages(pages).select("doc_id", "chunk_index", "text")


def ownership_violations(spark: SparkSession, d: str) -> DataFrame:
    requests = table(spark, d, "chat_pairs").select(F.col("pair_id").alias("request_id"), "user_id", "doc_ids")
    return catalog.ownership_violations(requests, _documents(spark, d))


def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "analytics").select(key_of("doc_id").alias("doc_id"), "word_count", "page_count", "complexity_score", "loaded_at").where("doc_id is not null")
    early, late = rows.where("loaded_at < timestamp'2025-12-01 00:00:00'"), rows.where("loaded_at >= timestamp'2025-12-01 00:00:00'")
    return catalog.upsert(early, late, ["doc_id"], "loaded_at").select("doc_id", "word_count", "page_count", "complexity_score")


def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "deletions").where("lower(trim(table_name)) = 'documents'").select(key_of("record_key").alias("doc_id")).where("doc_id is not null")
    children = {n: table(spark, d, n).select(key_of("doc_id").alias("doc_id")) for n in ("analytics", "quizzes", "chat_messages")} | {"chunks": table(spark, d, "chunks").select(key_of(F.col("metadata.doc_id")).alias("doc_id"))}
    out = None
    for name, left in catalog.cascade(log, children).items():
        part = left.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).select(F.lit(name).alias("child"), "doc_id", "n")
        out = part if out is None else out.unionByName(part)
    return out


def delete_owned(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each table left when every request's user deletes the documents it names: only those that are the user's own go."""
    requests = table(spark, d, "chat_pairs").select("user_id", F.explode("doc_ids").alias("doc_id"))
    children = {n: table(spark, d, n).select("doc_id") for n in ("analytics", "quizzes", "chat_messages")}
    _, left = catalog.delete_documents(requests, _documents(spark, d).select("id", "user_id"), children)
    out = None
    for name, rows in left.items():
        part = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("child"), "n")
        out = part if out is None else out.unionByName(part)
    return out


def insert_absent(spark: SparkSession, d: str) -> DataFrame:
    """Owners of documents that the table of users does not hold."""
    asked = _documents(spark, d).select(key_of("user_id").alias("id")).where("id is not null")
    return catalog.insert_absent(table(spark, d, "users").select(key_of("id").alias("id")), asked, ["id"])


def indexed_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents per owner that have vectors."""
    files = _vectors(spark, d).select(F.col("doc_id").alias("id"))
    docs = _documents(spark, d).select(key_of("id").alias("id"), key_of("user_id").alias("user_id"))
    return catalog.with_files(docs, files).where("user_id is not null").groupBy("user_id").agg(F.count("*").alias("documents"))


def answer_parts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "chat_pairs").where("pair_id is not null").select("pair_id", "answer").distinct()
    cited = A.cited_indices(F.col("answer"))
    return rows.select("pair_id", F.array_join(cited, ",").alias("cited"), A.without_citations(F.col("answer")).alias("answer"), A.found_nothing(F.col("answer")).alias("found_nothing"))


def sources_cited(spark: SparkSession, d: str) -> DataFrame:
    kind = "array<struct<text: string, page: int, doc_id: string, relevance: double>>"
    rows = table(spark, d, "chat_messages").select(key_of("id").alias("id"), F.from_json("sources", kind).alias("sources"), A.cited_indices(F.coalesce("content", F.lit(""))).alias("cited")).where("sources is not null and size(sources) > 0")
    pruned = rows.select("id", F.size("cited").alias("n_cited"), A.cited_sources(F.col("sources"), F.col("cited")).alias("s")).distinct()
    return pruned.select("id", "n_cited", F.size("s").alias("n_sources"), F.array_join(F.transform("s", lambda x: x["page"].cast("string")), ",", "-").alias("pages"))


def assistant_sources(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "chat_messages").where(F.lower(F.trim("role")).isin("assistant", "ai", "bot"))
    pages = F.transform(F.from_json("sources", "array<struct<page: int, relevance: double>>"), lambda x: x["page"].cast("string"))
    return rows.select(key_of("id").alias("id"), F.substring("content", 1, 60).alias("start"), F.array_join(pages, ",", "-").alias("pages")).distinct()


def confidence_levels(spark: SparkSession, d: str) -> DataFrame:
    label = A.level(F.col("confidence"))
    rows = table(spark, d, "chat_messages").where("confidence is not null").select("confidence", label.alias("label"), A.match_label(F.col("confidence")).alias("match_label"), A.level_colour(label).alias("colour"), A.meter_width(F.col("confidence"), label).alias("width"))
    return rows.groupBy("confidence", "label", "match_label", "colour", "width").agg(F.count("*").alias("messages"))


def intent_classes(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "chat_messages").where("lower(trim(role)) in ('user', 'human')").select(F.coalesce("content", F.lit("")).alias("content"))
    return rows.select(A.intent(F.col("content")).alias("intent")).groupBy("intent").agg(F.count("*").alias("messages"))


def mode_params(spark: SparkSession, d: str) -> DataFrame:
    k = A.mode_top_k(F.col("mode"))
    rows = table(spark, d, "chat_pairs").select("mode", k.alias("top_k"), A.mode_temperature(F.col("mode")).alias("temperature"), A.candidate_count(k).alias("candidates"))
    return rows.groupBy("mode", "top_k", "temperature", "candidates").agg(F.count("*").alias("requests"))


def transcript(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as text in pages of 50 messages, in their order, each message as loaded last."""
    line = F.concat(F.when(F.lower(F.trim("role")).isin("user", "human"), "User:").otherwise("AI Response:"), F.lit("\n"), F.coalesce("content", F.lit("")))
    placed = catalog.ordered_messages(table(spark, d, "chat_messages").select("id", "user_id", "doc_id", "role", "content", "timestamp", "loaded_at")).withColumn("page", F.floor(F.col("seq") / 50).cast("int"))
    g = placed.groupBy("user_id", "doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("seq", line.alias("b")))).alias("bs"))
    return g.select("user_id", "doc_id", "page", F.array_join(F.transform("bs", lambda x: x["b"]), "\n\n").alias("transcript"))


def analytics_repaired(spark: SparkSession, d: str) -> DataFrame:
    tree = nested.entities(nested.entity_tree(table(spark, d, "analytics")))
    return tree.select("doc_id", "item_no", F.coalesce("name", F.lit("Unknown")).alias("name"), F.coalesce("type", F.lit("Concept")).alias("type"), F.coalesce("description", F.lit("")).alias("description"))


def quiz_score(spark: SparkSession, d: str) -> DataFrame:
    """Each quiz as answered by someone who always takes the first option."""
    tree = cut_lineage(nested.question_tree(table(spark, d, "quizzes")))
    asked = nested.questions(tree).groupBy("doc_id").agg(F.count("*").alias("questions"))
    right = nested.options(tree).where("sub_no = 0").groupBy("doc_id").agg(F.count_if("is_correct").alias("right"))
    pct = R.percent(F.col("right"), F.col("questions"))
    return asked.join(right, "doc_id", "left").withColumn("right", F.coalesce("right", F.lit(0))).select("doc_id", "questions", "right", pct.alias("percent"), (pct >= 70).alias("passed"))


def queries() -> dict[str, Query]:
    doc = lambda f: lambda s, d: f(_documents(s, d))
    terms = lambda df: df.select("doc_id", F.explode(X.terms(F.col("text"))).alias("term"))
    return {
        "tokenize_terms": doc(lambda df: df.select("doc_id", F.array_join(X.terms(F.col("text")), " ").alias("terms"))),
        "term_freq": doc(lambda df: terms(df).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))),
        "term_doc_freq": doc(lambda df: terms(df).groupBy("term").agg(F.countDistinct("doc_id").alias("df"))),
        "avg_doc_len": doc(lambda df: df.select(F.size(X.terms(F.col("text"))).alias("n")).agg(F.count("*").alias("docs"), F.sum("n").alias("total"), F.round(F.avg("n"), 6).alias("mean"))),
        "doc_word_stats": lambda s, d: chunking.page_stats(_chunks(s, d)),
        "recursive_chunks": recursive_chunks,
        "line_chunks": doc(chunking.line_chunks),
        "snippets": doc(lambda df: df.select("doc_id", X.snippet(F.col("text"), 60).alias("snippet"))),
        "header_segments": doc(lambda df: df.select("doc_id", F.explode(X.header_segments(F.col("text"))).alias("header")).distinct()),
        "query_features": lambda s, d: retrieval.question_features(
            table(s, d, "chat_pairs").where("pair_id is not null").select(F.col("pair_id").alias("query_id"), F.coalesce("question", F.lit("")).alias("question")).distinct()
        ).select("query_id", "is_definition", "subject", F.array_join("content_words", " ").alias("content_words"), F.array_join("terms", " ").alias("terms")),
        "vector_knn": vector_knn,
        "bm25_scores": lambda s, d: _rounded(_scored(s, d)[0], "keyword", "keyword_norm"),
        "hybrid_rank": hybrid_rank,
        "rank_reasons": lambda s, d: _scored(s, d)[0].select("query_id", "doc_id", "chunk_index", F.array_join("reasons", "; ").alias("reasons")).where("reasons <> ''"),
        "hybrid_threshold": lambda s, d: _rounded(_kept(s, d)[0], "rank", "hybrid"),
        "hybrid_rank_variant_a": lambda s, d: _rounded(_scored(s, d, retrieval.VARIANT_A)[0], "pattern_boost", "header_boost", "hybrid"),
        "hybrid_rank_variant_b": lambda s, d: _rounded(_scored(s, d, retrieval.VARIANT_B)[0], "subject_boost", "hybrid"),
        "neighbour_expand": neighbour_expand,
        "page_filter": lambda s, d: _chunks(s, d).where(F.col("page").isin(2, 4)).select("doc_id", "chunk_index", "page"),
        "assistant_sources": assistant_sources,
        "comparable_requests": lambda s, d: table(s, d, "chat_pairs").where((F.size("doc_ids") >= 2) & (F.trim("question") != "")).select("pair_id").distinct().agg(F.count("*").alias("requests")),
        "search": search,
        "search_scoped": search_scoped,
        "search_confidence": search_confidence,
        "compare_context": compare_context,
        "compare_requested": compare_requested,
        "owner_documents": doc(lambda df: df.select(key_of("user_id").alias("user_id"), "size").where("user_id is not null").groupBy("user_id").agg(F.count("*").alias("documents"), F.sum("size").alias("bytes"))),
        "ownership_violations": ownership_violations,
        "indexed_documents": indexed_documents,
        "active_chats": lambda s, d: catalog.active_chats(table(s, d, "chat_messages")),
        "history": lambda s, d: catalog.history(catalog.ordered_messages(table(s, d, "chat_messages"))).drop("sources"),
        "transcript": transcript,
        "upsert_latest": upsert_latest,
        "insert_absent": insert_absent,
        "cascade_delete": cascade_delete,
        "analytics_named": lambda s, d: catalog.named(table(s, d, "analytics").select("doc_id", "word_count", "complexity_score").distinct(), _documents(s, d)).select("doc_id", "doc_name", "word_count", "complexity_score").distinct(),
        "analytics_repaired": analytics_repaired,
        "overview_sample": lambda s, d: compare.overview_sample(_chunks(s, d)),
        "spread_sample": lambda s, d: compare.spread_sample(_chunks(s, d)),
        "overview_context": lambda s, d: compare.joined_context(compare.overview_sample(_chunks(s, d)), F.coalesce("text", F.lit("")), "\n\n"),
        "quiz_context": lambda s, d: compare.joined_context(compare.spread_sample(_chunks(s, d)), F.concat(F.lit("[PAGE "), F.col("page").cast("string"), F.lit("]: "), F.coalesce("text", F.lit(""))), "\n\n---\n\n"),
        "quiz_score": quiz_score,
        "quiz_repaired": lambda s, d: nested.repaired_questions(table(s, d, "quizzes")),
        "analytics_record": lambda s, d: nested.analytics_record(table(s, d, "analytics")).withColumns({c: F.array_join(c, "|") for c in ("summary", "suggested_questions")}),
        "delete_owned": delete_owned,
        "intent_classes": intent_classes,
        "mode_params": mode_params,
        "answer_parts": answer_parts,
        "sources_cited": sources_cited,
        "confidence_levels": confidence_levels,
        "format_bytes": doc(lambda df: df.select("doc_id", R.format_bytes(F.col("size")).alias("size_text"))),
        "markdown_lines": lambda s, d: R.markdown_lines(table(s, d, "chat_pairs").where("pair_id is not null and answer is not null").select("pair_id", "answer").distinct(), "pair_id", "answer"),
        "event_tokens": lambda s, d: events.tokens_of(table(s, d, "chat_pairs").where("pair_id is not null and answer is not null").select(F.col("pair_id").alias("stream_id"), "answer").distinct(), "answer"),
        "event_fold_tokens": lambda s, d: events.folded(events.events_of(table(s, d, "chat_pairs").where("pair_id is not null and answer is not null").select(F.col("pair_id").alias("stream_id"), "answer", "confidence").distinct(), whole=False)).select("stream_id", "content", "confidence", "confidence_label"),
        "event_fold": lambda s, d: events.folded(events.events_of(table(s, d, "chat_pairs").where("pair_id is not null and answer is not null").select(F.col("pair_id").alias("stream_id"), "answer", "confidence").distinct())).select("stream_id", "content", "confidence", "tokens"),
    }


# ---- SQL

_B = "' ' || chr(9) || chr(10) || chr(13) || chr(160)"
_key = lambda c: f"nullif(lower(trim({c}, {_B})), '')"
_SPACES = "[\\s\\p{Z}\\x{85}\\x{1c}-\\x{1f}\\x0b]"
_STRIP = lambda c: f"regexp_replace({c}, '^{_SPACES}+|{_SPACES}+$', '', 'g')"
_PUNCT = "[!-/:-@\\[-`{-~]"


def _words(c: str) -> str:
    return f"list_filter(string_split_regex(coalesce({c}, ''), '{_SPACES}+'), lambda w: w <> '')"


def _terms(c: str) -> str:
    bare = f"list_filter(list_transform({_words(c)}, lambda w: regexp_replace(w, '^{_PUNCT}+|{_PUNCT}+$', '', 'g')), lambda w: w <> '')"
    opened = "regexp_replace(regexp_replace(w, '([A-Z])([À-ɏ])', '\\1_\\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g')"
    parts = f"regexp_extract_all({opened}, '[A-Z]+\\b|[A-Z]?[a-z]+|[0-9]+')"
    lowered = f"flatten(list_transform({bare}, lambda w: case when len({parts}) > 0 then list_transform({parts}, lambda p: lower(p)) else [lower(w)] end))"
    stop = ", ".join(f"'{w}'" for w in X.STOP_WORDS)
    return f"list_filter({lowered}, lambda t: t not in ({stop}))"


_CHUNKS = f"""
  select {_key("metadata.doc_id")} doc_id, metadata.chunk_index chunk_index, min(coalesce(text, '')) as text,
         arg_min(metadata.page, coalesce(text, '') || chr(0) || coalesce(metadata.doc_name, '') || chr(0) || coalesce(metadata.page, 0)) page,
         arg_min(metadata.doc_name, coalesce(text, '') || chr(0) || coalesce(metadata.doc_name, '')) doc_name
  from chunks where {_key("metadata.doc_id")} is not null and metadata.chunk_index is not null group by 1, 2"""
_VECTORS = f"""
  select {_key("metadata.doc_id")} doc_id, metadata.chunk_index chunk_index, vec_id, embedding::double[64] e from chunk_vectors
  where len(embedding) = 64 and list_bool_and(list_transform(embedding, lambda x: coalesce(not isnan(x), false))) and list_bool_or(list_transform(embedding, lambda x: x <> 0))
  qualify row_number() over (partition by {_key("metadata.doc_id")}, metadata.chunk_index order by vec_id) = 1"""


def _ranked(scope: str = "", ranking: retrieval.Ranking = retrieval.Ranking()) -> str:
    r = ranking
    segments = f"list_transform(regexp_split_to_array(text, '{chr(92)}n' ), lambda p: {_STRIP('p')})" if r.header_by_line else f"list_transform(string_split_regex(text, '[\\n|<>]'), lambda p: {_STRIP('p')})"
    low = 1 if r.header_by_line else r.header_low
    header = f"list_bool_or(list_transform(list_filter({segments}, lambda p: length(p) >= {low} and length(p) <= {r.header_high} and upper(p) = p and lower(p) <> p), lambda h: coalesce(list_bool_or(list_transform(content_words, lambda w: contains(lower(h), w))), false)))"
    patterns = " or ".join(f"contains(lower(text), '{p}')" for p in retrieval.DEFINITION_PATTERNS)
    quoted = "regexp_replace(subject, '([^a-z0-9_ ])', '\\\\\\1', 'g')"
    near = f"'(?i)\\b' || {quoted} || '\\b(?:[^\\n]{{0,50}})?\\b{retrieval._GAP_VERBS}'" if r.subject_gap else f"'(?i)' || {quoted} || '{retrieval._BETWEEN.replace(chr(39), chr(39) * 2)}{retrieval._VERBS}'"
    prefix = "^(?:" + "|".join(retrieval.DEFINITION_PREFIXES) + ")"
    scopes = {"": "true", "own": "q.own = v.doc_id", "asked": "list_contains(q.doc_ids, v.doc_id)"}
    asked = "q as (select * from q_own)," if scope != "asked" else f"""
requested as (select pair_id, list_distinct(list_filter(list_transform(doc_ids, lambda x: {_key("x")}), lambda x: x is not null)) doc_ids from chat_pairs where pair_id is not null),
named as (select own, arg_min(doc_ids, pair_id) doc_ids from (select unnest(doc_ids) own, pair_id, doc_ids from requested where len(doc_ids) >= 2) group by 1),
following as (select id own, lead(id) over (order by id) nxt from (select distinct {_key("id")} id from documents) where id is not null),
q as (select q_own.*, coalesce(named.doc_ids, list_filter([q_own.own, following.nxt], lambda x: x is not null)) doc_ids from q_own left join named using (own) left join following using (own)),"""
    return f"""
with c as ({_CHUNKS}), v as ({_VECTORS}),
q_own as (select v.vec_id query_id, 'What is ' || split_part(c.text, ' ', 3) || ' ' || split_part(c.text, ' ', 4) || '?' question, v.e, v.doc_id own from v join c using (doc_id, chunk_index) where v.vec_id % 100 = 0),
{asked}
ql as (select *, lower({_STRIP("question")}) lq from q),
f as (select query_id, regexp_matches(lq, '{prefix}') is_definition,
             case when regexp_matches(lq, '{prefix}') then trim(trim({_STRIP(f"regexp_replace(lq, '{prefix}', '')")}, '? .!'), ' ' || chr(9) || chr(10) || chr(13)) else lq end subject,
             list_filter({_words("lq")}, lambda w: length(w) > 3 and w not in ('what', 'with', 'from', 'that')) content_words, {_terms("question")} terms from ql),
d as (select q.query_id, v.doc_id, v.chunk_index, list_sum(list_transform(range(1, 65), lambda i: (q.e[i] - v.e[i]) * (q.e[i] - v.e[i]))) distance from q join v on {scopes[scope]}),
k as (select *, row_number() over (partition by query_id order by distance, doc_id, chunk_index) vector_rank from d),
n as (select k.*, c.text, {_terms("c.text")} t from k join c using (doc_id, chunk_index) where vector_rank <= 15),
s as (select query_id, count(*)::double n, case when sum(len(t)) > 0 then sum(len(t)) / count(*)::double else 1.0 end mean_length from n group by 1),
qt as (select query_id, unnest(terms) term from f),
df as (select x.query_id, x.term, count(*) filter (list_contains(n.t, x.term))::double df from (select distinct * from qt) x join n using (query_id) group by all),
kw as (select n.query_id, n.doc_id, n.chunk_index,
              sum(ln((s.n - df.df + 0.5) / (df.df + 0.5) + 1.0) * tf * ({r.k1} + 1) / (tf + {r.k1} * (1.0 - {r.b} + {r.b} * (len(n.t) / s.mean_length)))) keyword
       from (select n.*, qt.term, len(list_filter(n.t, lambda t: t = qt.term))::double tf from n join qt using (query_id)) n join s using (query_id) join df on df.query_id = n.query_id and df.term = n.term
       where tf > 0 group by all),
a as (select n.*, f.*exclude(query_id), coalesce(kw.keyword, 0.0) keyword, max(coalesce(kw.keyword, 0.0)) over (partition by n.query_id) most, greatest(0.0, least(1.0, 1.0 - n.distance / 2.0)) similarity
      from n join f using (query_id) left join kw using (query_id, doc_id, chunk_index)),
b as (select *, case when most > 0 then keyword / most else 0.0 end keyword_norm, case when is_definition and ({patterns}) then {r.pattern_boost} else 0.0 end::double pattern_boost,
             case when is_definition and subject <> '' and regexp_matches(text, {near}) then {r.subject_boost} else 0.0 end::double subject_boost,
             case when coalesce({header}, false) then {r.header_boost} else 0.0 end::double header_boost from a),
h as (select *, least(1.0, {r.vector_weight} * similarity + {r.keyword_weight} * keyword_norm + pattern_boost + subject_boost + header_boost)::double hybrid from b),
ranked as (select *, row_number() over (partition by query_id order by round(hybrid, 9) desc, vector_rank) "rank" from h)
"""


def _found(scope: str = "") -> str:
    """The fold over each question's results, a step per place; marks of used chunks are kept in a list."""
    return _ranked(scope).replace("\nwith c as", "\nwith recursive c as", 1) + """,
items as (select r.query_id, r.doc_id, r.chunk_index, r.text, r.hybrid, x.text next_text, row_number() over (partition by r.query_id order by "rank") i
          from ranked r left join c x on x.doc_id = r.doc_id and x.chunk_index = r.chunk_index + 1 where "rank" <= 5 and round(hybrid, 9) >= 0.5),
marked as (select *, doc_id || chr(0) || chunk_index own, case when next_text is null then [doc_id || chr(0) || chunk_index] else [doc_id || chr(0) || chunk_index, doc_id || chr(0) || (chunk_index + 1)] end marks from items),
fold as (select query_id, i, marks seen, 1 place, true taken from marked where i = 1
         union all
         select m.query_id, m.i, case when list_contains(f.seen, m.own) then f.seen else list_concat(f.seen, m.marks) end,
                f.place + case when list_contains(f.seen, m.own) then 0 else 1 end, not list_contains(f.seen, m.own)
         from fold f join marked m on m.query_id = f.query_id and m.i = f.i + 1),
found as (select m.query_id, f.place, m.doc_id, m.chunk_index, m.hybrid,
                 case when m.next_text is null then m.text when m.text like '%' || chr(10) then m.text || m.next_text else m.text || chr(10) || m.next_text end as text
          from marked m join fold f on f.query_id = m.query_id and f.i = m.i and f.taken)
"""


def oracle_sql() -> dict[str, str]:
    doc_terms = f"select doc_id, unnest({_terms('text')}) term from documents"
    five = lambda *names: ", ".join(f"round({n}, 5) {n}" for n in names)
    ordered = f"with c as ({_CHUNKS}), o as (select *, row_number() over (partition by doc_id order by coalesce(page, 0), coalesce(chunk_index, 0)) - 1 place, count(*) over (partition by doc_id) n from c)"
    overview = f"{ordered}, s as (select doc_id, place, text from o where n <= 8 or place < 5 or place >= n - 3 union all select doc_id, n - 4, '{compare.GAP_MARK}' from o where n > 8 and place = n - 3)"
    spread = f"{ordered}, s as (select doc_id, place, coalesce(page, 1) page, text from o where place % greatest(1, n // 10) = 0 and place // greatest(1, n // 10) < 10)"
    answers = "select distinct pair_id, answer from chat_pairs where pair_id is not null"
    mode = lambda i: "case mode " + " ".join(f"when '{m}' then {x[i]}" for m, x in A.MODES.items() if m) + f" else {A.MODES[None][i]} end"
    quoted = lambda xs: ", ".join("'" + x.replace("'", "''") + "'" for x in xs)
    level = lambda c: f"case when {c} >= 80 then 'High' when {c} >= 65 then 'Medium' else 'Low' end"
    key_user, key_doc = _key("user_id"), _key("doc_id")
    cited = "list_transform(list_filter(list_transform(string_split(regexp_extract({0}, '(?i)Cited Source Indices:\\s*([\\d\\s,]+)', 1), ','), lambda x: trim(x, " + _B + ")), lambda x: regexp_full_match(x, '[0-9]+')), lambda x: x::int)"
    placed = f"""
            with m as (select * replace ({key_user} as user_id, {key_doc} as doc_id, {_key("id")} as id) from chat_messages where {key_user} is not null and {key_doc} is not null and {_key("id")} is not null
                       qualify row_number() over (partition by {_key("id")} order by loaded_at desc) = 1),
            t as (select *, case when regexp_full_match(timestamp, '\\d{{1,11}}') then make_timestamp(timestamp::bigint * 1000000) else try_cast(replace(timestamp, 'T', ' ') as timestamp) end at_ from m),
            p as (select *, (row_number() over (partition by user_id, doc_id order by at_ nulls last, case when lower(trim(role)) in ('user', 'human') then 0 else 1 end, id) - 1)::int seq from t)"""
    return {
        "tokenize_terms": f"select doc_id, array_to_string({_terms('text')}, ' ') terms from documents",
        "term_freq": f"select doc_id, term, count(*) tf from ({doc_terms}) group by all",
        "term_doc_freq": f"select term, count(distinct doc_id) df from ({doc_terms}) group by all",
        "avg_doc_len": f"select count(*) docs, sum(n)::bigint total, round(avg(n), 6) mean from (select len({_terms('text')}) n from documents)",
        "doc_word_stats": f"""select doc_id, word_count, page_count, greatest(1, round_even(word_count / 200.0::double, 0))::int read_time_mins
            from (select doc_id, sum(len({_words("text")}))::bigint word_count, max(coalesce(page, 1)) page_count from ({_CHUNKS}) group by 1)""",
        "line_chunks": f"select doc_id, unnest(range(len(l)))::int chunk_index, unnest(l) as text from (select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {_STRIP('x')}), lambda x: x <> '') l from documents)",
        "snippets": "select doc_id, replace(substring(text, 1, 60), chr(10), ' ') snippet from documents",
        "header_segments": f"select distinct doc_id, h as header from (select doc_id, unnest(list_transform(string_split_regex(text, '[\\n|<>]'), lambda p: {_STRIP('p')})) h from documents) where length(h) between 3 and 39 and upper(h) = h and lower(h) <> h",
        "query_features": f"""
            with q as (select distinct pair_id query_id, coalesce(question, '') question from chat_pairs where pair_id is not null), l as (select *, lower({_STRIP("question")}) lq from q)
            select query_id, regexp_matches(lq, '^(?:{"|".join(retrieval.DEFINITION_PREFIXES)})') is_definition,
                   case when regexp_matches(lq, '^(?:{"|".join(retrieval.DEFINITION_PREFIXES)})') then trim(trim({_STRIP("regexp_replace(lq, '^(?:" + "|".join(retrieval.DEFINITION_PREFIXES) + ")', '')")}, '? .!'), ' ' || chr(9) || chr(10) || chr(13)) else lq end subject,
                   array_to_string(list_filter({_words("lq")}, lambda w: length(w) > 3 and w not in ('what', 'with', 'from', 'that')), ' ') content_words, array_to_string({_terms("question")}, ' ') terms from l""",
        "vector_knn": _ranked() + f"select query_id, doc_id, chunk_index, vector_rank::int vector_rank, round(distance, 6) distance, round(greatest(0.0, least(1.0, 1.0 - distance / 2.0)), 6) similarity from k where vector_rank <= 15",
        "bm25_scores": _ranked() + f"select query_id, doc_id, chunk_index, {five('keyword', 'keyword_norm')} from ranked",
        "hybrid_rank": _ranked() + f'select query_id, doc_id, chunk_index, vector_rank::int vector_rank, {five("keyword_norm", "pattern_boost", "subject_boost", "header_boost", "hybrid")}, "rank"::int "rank" from ranked',
        "hybrid_threshold": _ranked() + f'select query_id, doc_id, chunk_index, "rank"::int "rank", {five("hybrid")} from ranked where "rank" <= 5 and round(hybrid, 9) >= 0.5',
        "hybrid_rank_variant_a": _ranked(ranking=retrieval.VARIANT_A) + f"select query_id, doc_id, chunk_index, {five('pattern_boost', 'header_boost', 'hybrid')} from ranked",
        "hybrid_rank_variant_b": _ranked(ranking=retrieval.VARIANT_B) + f"select query_id, doc_id, chunk_index, {five('subject_boost', 'hybrid')} from ranked",
        "search_scoped": _ranked("own") + f"select query_id, doc_id, chunk_index, vector_rank::int vector_rank, {five('hybrid')} from ranked",
        "search": _found() + f"select query_id, place::int place, doc_id, chunk_index, text, {five('hybrid')} from found",
        "search_confidence": _found() + f"""
            , g as (select query_id, floor(round(avg(greatest(0.0, least(1.0, hybrid))) * 100, 9))::int confidence, count(*)::int sources,
                           length(string_agg('Source Index: ' || (place - 1) || chr(10) || 'Document: ' || coalesce(doc_name, 'Unknown Document') || ' (Page ' || coalesce(page, 1) || ')' || chr(10) || 'Content: ' || found.text || chr(10) || '---', chr(10)))::int context_length
                    from found join c using (doc_id, chunk_index) group by 1)
            select query_id, confidence, {level("confidence")} label, sources, context_length from g""",
        "compare_context": _found() + """
            select query_id, doc_id, min(place)::int first_place, count(*) chunks, length(string_agg('[Page ' || coalesce(page, 1) || ']: ' || found.text, chr(10)))::int length
            from found join c using (doc_id, chunk_index) group by 1, 2""",
        "sources_cited": f"""
            with m as (select distinct {_key("id")} id, from_json(sources, '[{{"page": "INTEGER"}}]') s, {cited.format("coalesce(content, '')")} c from chat_messages where json_array_length(sources) > 0),
            v as (select *, list_filter(c, lambda i: i < len(s)) good from m),
            p as (select id, len(c)::int n_cited, case when len(good) > 0 then list_transform(good, lambda i: s[i + 1].page) else list_transform(s, lambda x: x.page) end pages from v)
            select id, n_cited, len(pages)::int n_sources, array_to_string(list_transform(pages, lambda x: coalesce(x::varchar, '-')), ',') pages from p""",
        "compare_requested": _found("asked") + """
            , g as (select query_id, doc_id, length(substring(string_agg('[Page ' || coalesce(page, 1) || ']: ' || found.text, chr(10) order by place), 1, 3000))::int length from found join c using (doc_id, chunk_index) group by 1, 2),
            wanted as (select distinct query_id, unnest(doc_ids) doc_id from q)
            select query_id, doc_id, coalesce(length, length('no direct mention'))::int length from wanted left join g using (query_id, doc_id)""",
        "rank_reasons": _ranked() + """select query_id, doc_id, chunk_index, array_to_string([case when pattern_boost > 0 then 'definition pattern' end, case when subject_boost > 0 then 'subject next to its definition' end,
            case when header_boost > 0 then 'word of the question in a header' end], '; ') reasons from ranked where pattern_boost + subject_boost + header_boost > 0""",
        "analytics_repaired": f"select doc_id, item_no, coalesce(name, 'Unknown') as name, coalesce(type, 'Concept') as type, coalesce(description, '') description from ({ENTITY_SQL})",
        "quiz_score": f"""
            with n as ({QUESTION_COUNT_SQL}), r as (select doc_id, count(*) filter (is_correct) "right" from ({OPTION_SQL}) where sub_no = 0 group by 1),
            s as (select doc_id, questions, coalesce("right", 0) "right" from n left join r using (doc_id))
            select doc_id, questions, "right", floor("right" * 100.0 / questions + 0.5)::bigint "percent", floor("right" * 100.0 / questions + 0.5) >= 70 passed from s""",
        "page_filter": f"select doc_id, chunk_index, page from ({_CHUNKS}) where page in (2, 4)",
        "assistant_sources": f"""select distinct {_key("id")} id, substring(content, 1, 60) start, array_to_string(list_transform(from_json(sources, '[{{"page": "INTEGER", "relevance": "DOUBLE"}}]'), lambda x: coalesce(x.page::varchar, '-')), ',') pages
            from chat_messages where lower(trim(role)) in ('assistant', 'ai', 'bot')""",
        "comparable_requests": "select count(*) requests from (select distinct pair_id from chat_pairs where len(doc_ids) >= 2 and trim(question) <> '')",
        "neighbour_expand": f"with c as ({_CHUNKS}) select a.doc_id, a.chunk_index, length(b.text)::int next_length from c a left join c b on b.doc_id = a.doc_id and b.chunk_index = a.chunk_index + 1",
        "owner_documents": f"select {key_user} user_id, count(*) documents, sum(size)::bigint bytes from documents where {key_user} is not null group by 1",
        "ownership_violations": f"""
            with r as (select distinct pair_id request_id, {key_user} user_id, {_key("doc")} doc_id from (select pair_id, user_id, unnest(doc_ids) doc from chat_pairs))
            select request_id, doc_id from r where user_id is not null and doc_id is not null and not exists (select 1 from documents d where {_key("d.id")} = r.doc_id and {_key("d.user_id")} = r.user_id)""",
        "indexed_documents": f"select {key_user} user_id, count(*) documents from documents where {key_user} is not null and {_key('id')} in (select doc_id from ({_VECTORS})) group by 1",
        "active_chats": f"select distinct {key_user} user_id, {key_doc} doc_id from chat_messages where {key_user} is not null and {key_doc} is not null",
        "history": f"{placed} select user_id, doc_id, seq, id, \"role\", content, confidence, coalesce(json_array_length(sources), 0)::int n_sources, timestamp, {level('coalesce(confidence, 0)')} confidence_label from p",
        "quiz_repaired": REPAIRED_SQL,
        "analytics_record": RECORD_SQL,
        "delete_owned": f"""
            with asked as (select distinct {key_user} u, {_key("doc")} k from (select user_id, unnest(doc_ids) doc from chat_pairs)),
            gone as (select distinct k from asked join documents d on {_key("d.id")} = k and {_key("d.user_id")} = u)
            select 'documents' child, count(*) n from documents where coalesce({_key("id")} not in (select k from gone), true) union all select 'analytics', count(*) from analytics where coalesce({key_doc} not in (select k from gone), true)
            union all select 'quizzes', count(*) from quizzes where coalesce({key_doc} not in (select k from gone), true) union all select 'chat_messages', count(*) from chat_messages where coalesce({key_doc} not in (select k from gone), true)""",
        "event_fold_tokens": f"with a as (select distinct pair_id, answer, confidence from chat_pairs where pair_id is not null and answer is not null) select pair_id stream_id, answer || ' ' as content, confidence, {level('coalesce(confidence, 0)')} confidence_label from a",
        "transcript": f"""
            {placed}
            select user_id, doc_id, (seq // 50)::int page, string_agg(case when lower(trim(role)) in ('user', 'human') then 'User:' else 'AI Response:' end || chr(10) || coalesce(content, ''), chr(10) || chr(10) order by seq) transcript
            from p group by 1, 2, 3""",
        "upsert_latest": f"select {key_doc} doc_id, word_count, page_count, complexity_score from analytics where {key_doc} is not null qualify row_number() over (partition by {key_doc} order by loaded_at desc) = 1",
        "insert_absent": f"select distinct {key_user} id from documents where {key_user} is not null and {key_user} not in (select {_key('id')} from users where id is not null)",
        "cascade_delete": f"""
            with gone as (select {_key("record_key")} k from deletions where lower(trim(table_name)) = 'documents' and {_key("record_key")} is not null),
            r as (select 'analytics' child, {key_doc} doc_id from analytics union all select 'quizzes', {key_doc} from quizzes union all select 'chat_messages', {key_doc} from chat_messages union all select 'chunks', {_key("metadata.doc_id")} from chunks)
            select child, doc_id, count(*) n from r where doc_id is not null and doc_id not in (select k from gone) group by all""",
        "analytics_named": f"select distinct {_key('a.doc_id')} doc_id, d.name doc_name, a.word_count, a.complexity_score from analytics a join documents d on {_key('d.id')} = {_key('a.doc_id')}",
        "overview_sample": overview + " select doc_id, place::int place, text from s",
        "spread_sample": spread + " select doc_id, place::int place, page, text from s",
        "overview_context": overview + " select doc_id, substring(string_agg(text, chr(10) || chr(10) order by place), 1, 12000) context from s group by 1",
        "quiz_context": spread + " select doc_id, substring(string_agg('[PAGE ' || page || ']: ' || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by place), 1, 12000) context from s group by 1",
        "intent_classes": f"""
            with q as (select translate(lower({_STRIP("coalesce(content, '')")}), '?!.,', '') q, trim(lower({_STRIP("coalesce(content, '')")}), '?.! ') bare from chat_messages where lower(trim(role)) in ('user', 'human'))
            select case when {_STRIP("q")} = '' or q in ({quoted(A.GREETINGS)}) or {_STRIP("q")} in ({quoted(A.SINGLE_WORDS)}) or {" or ".join(f"contains(q, '{p}')" for p in A.OUTSIDE_PHRASES)} then 'CONVERSATIONAL'
                        when length(bare) <= 2 or bare in ({quoted(A.VAGUE)}) then 'AMBIGUOUS' else 'FACTUAL' end intent, count(*) messages from q group by 1""",
        "mode_params": f"select mode, {mode(0)} top_k, ({mode(1)})::double temperature, greatest(3 * {mode(0)}, 15) candidates, count(*) requests from chat_pairs group by all",
        "answer_parts": f"""with a as ({answers}) select pair_id, array_to_string({cited.format("answer")}, ',') cited,
            {_STRIP("regexp_replace(answer, '(?i)\\n*Cited Source Indices:\\s*[^\\n]*', '', 'g')")} answer,
            {" or ".join(f"contains(lower(answer), '{p}')" for p in A.NOTHING_FOUND)} found_nothing from a""",
        "confidence_levels": f"""
            with m as (select confidence, {level("confidence")} label from chat_messages where confidence is not null)
            select confidence, label, label || ' Match' match_label, case label when 'High' then 'success' when 'Medium' then 'warning' else 'error' end colour,
                   case when confidence <> 0 then confidence else 35 end width, count(*) messages from m group by all""",
        "format_bytes": """
            with p as (select doc_id, size, case when size >= 1073741824 then 3 when size >= 1048576 then 2 when size >= 1024 then 1 else 0 end p from documents)
            select doc_id, case when size = 0 then '0 Bytes' when size > 0 then regexp_replace(regexp_replace(round(size / pow(1024.0, p), 2)::decimal(30, 2)::varchar, '0+$', ''), '\\.$', '') || ' ' || ['Bytes', 'KB', 'MB', 'GB'][p + 1] end size_text from p""",
        "markdown_lines": f"""
            with a as ({answers} and answer is not null), l as (select pair_id, unnest(range(len(string_split(answer, chr(10)))))::int line_no, unnest(string_split(answer, chr(10))) line from a),
            t as (select *, {_STRIP("line")} t from l),
            k as (select *, case when t like '- %' or t like '* %' then 'item' when line = '' then 'blank' when t like '### %' then 'h3' when t like '## %' then 'h2' when t like '# %' then 'h1' else 'paragraph' end kind from t),
            c as (select *, case when kind = 'item' then substring(t, 3) when kind in ('h1', 'h2', 'h3') then substring(t, right(kind, 1)::int + 2) else line end content,
                         case when kind = 'item' and coalesce(lag(kind) over (partition by pair_id order by line_no), '') <> 'item' then 1 else 0 end starts from k)
            select pair_id, line_no, kind, content, (len(string_split(content, '**')) // 2)::int bold_parts, case when kind = 'item' then sum(starts) over (partition by pair_id order by line_no) - 1 end::bigint list_no from c""",
        "event_tokens": f"with a as ({answers} and answer is not null) select pair_id stream_id, unnest(range(len(string_split(answer, ' '))))::int seq, unnest(list_transform(string_split(answer, ' '), lambda x: x || ' ')) token from a",
        "event_fold": "with a as (select distinct pair_id, answer, confidence from chat_pairs where pair_id is not null and answer is not null) select pair_id stream_id, answer content, confidence, len(string_split(answer, ' '))::bigint tokens from a",
    }
