"""From a set of questions to stored answers: intent, search, context, a model's answer, citations, history; and summaries that compare documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions import answers as A
from foliant.operators import compare, retrieval
from foliant.session import cut_lineage
from foliant.sources import providers

UNCLEAR = "The question is unclear. Please say which document or section is meant."
NOT_FOUND = "I cannot find any information related to your question in the uploaded documents."
SMALL_TALK = "I answer questions about your documents."
#: What the model is told in each mode.
INSTRUCTIONS = {
    "qa": "Answer precisely from the context.", "summary": "Sum up what the context says.", "deep": "Explain in depth what the context says.",
    "eli5": "Explain in the simplest words, keeping to the facts of the context.",
}


#: What binds a model to the context, and in the mode that may use comparisons.
CRITICAL_RULE = "Use only facts that the context states; leave out what it does not say."
CRITICAL_RULE_SIMPLE = "Comparisons a child knows are allowed; all facts must still come from the context."


def answer(questions: DataFrame, vectors: DataFrame, chunks: DataFrame, models: list[providers.ChatModel] | None = None, ranking: retrieval.Ranking = retrieval.Ranking()) -> DataFrame:
    """(query_id, intent, answer, confidence, confidence_label, sources) for (query_id, question, mode, doc_ids, vector) and, if there is one, history.

    The model gets the mode's instruction, the history (an array of role and content), the context with the mode's critical rule and the question, at the mode's temperature.

    Small talk and unclear questions are answered without a search. A null or empty doc_ids asks all documents of ``vectors``.
    Only cited sources are kept; an answer that found nothing has none and no confidence.
    """
    past = F.col("history") if "history" in questions.columns else F.lit(None)
    past = F.coalesce(past.cast("array<struct<role: string, content: string>>"), F.array().cast("array<struct<role: string, content: string>>")).alias("history")
    asked = questions.select("query_id", "question", "mode", "doc_ids", "vector", past, A.intent(F.col("question")).alias("intent"), A.mode_top_k(F.col("mode")).alias("top_k"))
    asked = cut_lineage(asked)
    real = asked.where("intent = 'FACTUAL'")
    everywhere = (F.col("doc_ids").isNull()) | (F.size("doc_ids") == 0)
    near = retrieval.candidates(real.where(everywhere), vectors).unionByName(retrieval.candidates_in_scope(real.where(~everywhere), vectors))
    cut = retrieval.kept(retrieval.scored(near, real, chunks, ranking), real, ranking)
    found = compare.answer_context(retrieval.results(retrieval.with_neighbours(cut, chunks)), chunks.select("doc_id", "chunk_index", "doc_name", "page"))
    rule = F.lit(INSTRUCTIONS["qa"])
    for mode, text in INSTRUCTIONS.items():
        rule = F.when(F.col("mode") == mode, text).otherwise(rule)
    prompts = found.join(real.select("query_id", "question", "mode", "history"), "query_id")
    critical = F.when(F.col("mode") == "eli5", CRITICAL_RULE_SIMPLE).otherwise(CRITICAL_RULE)
    asks = F.concat_ws("\n", F.lit("--- CONTEXT ---"), F.substring("context", 1, compare.CONTEXT_LIMIT), F.lit("--- END ---"), critical, "question")
    message = lambda role, text: F.array(F.struct(F.lit(role).alias("role"), text.alias("content")))
    talk = providers.as_roles(F.concat(message("system", rule), F.col("history"), message("user", asks)))
    prompts = prompts.select("query_id", "confidence", "label", "sources", talk.alias("messages"), A.mode_temperature(F.col("mode")).alias("temperature"))
    said = providers.chat(prompts, "messages", "temperature", models).select("query_id", "confidence", "label", "sources", F.col("answer").alias("raw"))
    nothing = A.found_nothing(F.col("raw"))
    empty = F.filter("sources", lambda s: F.lit(False))
    said = said.select(
        "query_id", A.without_citations(F.col("raw")).alias("answer"), F.when(nothing, 0).otherwise(F.col("confidence")).alias("confidence"), F.when(nothing, "Low").otherwise(F.col("label")).alias("confidence_label"),
        F.when(nothing, empty).otherwise(A.cited_sources(F.col("sources"), A.cited_indices(F.col("raw")))).alias("sources"),
    )
    canned = F.when(F.col("intent") == "CONVERSATIONAL", SMALL_TALK).when(F.col("intent") == "AMBIGUOUS", UNCLEAR).otherwise(NOT_FOUND)
    out = asked.select("query_id", "intent").join(said, "query_id", "left")
    label = F.coalesce("confidence_label", F.when(F.col("intent") == "CONVERSATIONAL", "High").otherwise("Low"))
    return out.select("query_id", "intent", F.coalesce("answer", canned).alias("answer"), F.coalesce("confidence", F.lit(0)).alias("confidence"), label.alias("confidence_label"), "sources")
