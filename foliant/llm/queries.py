"""Registered queries of the operators for training data and, where SQL can say it, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foliant.llm import conversations, language_id, leakage, neighbours, quality, splitting, tokenizer
from foliant.session import table

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "p1_found": lambda spark, d: neighbours.similar_pairs(table(spark, d, "chunk_vectors")),
        "p1_neighbours": lambda spark, d: neighbours.ranked_neighbours(table(spark, d, "chunk_vectors"), queries="id % 100 = 0"),
        "p1_embeddings": lambda spark, d: neighbours.ranked_neighbours(table(spark, d, "embeddings"), queries="id % 100 = 0"),
        "p2_found": lambda spark, d: quality.broken_pairs(table(spark, d, "chat_pairs")),
        "p2_empty": lambda spark, d: quality.broken_pairs(table(spark, d, "chat_pairs")).where("defect = 'empty'").select("pair_id"),
        "p2_report": lambda spark, d: quality.defect_report(table(spark, d, "chat_pairs")),
        "p4_found": lambda spark, d: splitting.oversized(table(spark, d, "chunks")),
        "p4_pieces": lambda spark, d: splitting.split_chunks(table(spark, d, "chunks")),
        "p4_properties": lambda spark, d: splitting.piece_properties(table(spark, d, "chunks")).distinct(),
        "p6_found": lambda spark, d: conversations.dropped(table(spark, d, "chat_messages")),
        "p6_conversations": lambda spark, d: conversations.conversations(table(spark, d, "chat_messages")),
        "p6_linked": lambda spark, d: conversations.dropped(m := table(spark, d, "chat_messages"), conversations.reply_links(m)),
        "p7_ids": lambda spark, d: tokenizer.encode_corpus(table(spark, d, "documents")),
        "p8_found": lambda spark, d: leakage.leaked_documents(table(spark, d, "documents"), table(spark, d, "eval_items")),
        "p8_spans": lambda spark, d: leakage.removal_spans(table(spark, d, "documents"), table(spark, d, "eval_items")),
        "p9_found": lambda spark, d: language_id.mislabelled(table(spark, d, "documents")),
        "p9_languages": lambda spark, d: language_id.document_languages(table(spark, d, "documents")),
        "p9_passages": lambda spark, d: language_id.segments(table(spark, d, "documents")),
    }


_BLANKS = "' ' || chr(9) || chr(10) || chr(13) || chr(160)"
_UNSEEN = "[\\s\\p{Z}\\p{Cc}\\p{Cf}\\x{2800}\\x{3164}\\x{115f}\\x{1160}\\x{ffa0}\\x{034f}\\x{fe0e}\\x{fe0f}]"

_key = lambda c: f"nullif(lower(trim({c}, {_BLANKS})), '')"
_SPOKEN = f"""{_key("id")} id, content,
    case when lower(trim(role, {_BLANKS})) in ('user', 'human') then 0 when lower(trim(role, {_BLANKS})) in ('assistant', 'ai', 'bot') then 1
         when lower(trim(role, {_BLANKS})) = 'system' then 2 else 3 end kind,
    case when regexp_full_match(timestamp, '\\d{{1,11}}') then make_timestamp(timestamp::bigint * 1000000) else try_cast(replace(timestamp, 'T', ' ') as timestamp) end at_,
    coalesce(regexp_replace(content, '{_UNSEEN}', '', 'g') <> '', false) text"""
P6_MESSAGES = f"""
  select {_key("user_id")} user_id, {_key("doc_id")} doc_id, {_SPOKEN} from chat_messages where {_key("user_id")} is not null and {_key("doc_id")} is not null
  qualify row_number() over (partition by {_key("id")} order by loaded_at desc) = 1
"""
#: Messages that lack a user or a document take the key of the one that they follow within ten minutes.
P6_LINKED = f"""
  with raw as (select {_key("user_id")} u, {_key("doc_id")} d, {_SPOKEN} from chat_messages qualify row_number() over (partition by {_key("id")} order by loaded_at desc) = 1),
  met as (select a.id, b.u, b.d, row_number() over (partition by a.id order by b.at_ desc, b.id desc) n from raw a join raw b on (a.u = b.u or a.d = b.d) and b.id <> a.id and b.at_ <= a.at_ and b.at_ >= a.at_ - interval 10 minute
          where (a.u is null) <> (a.d is null) and b.u is not null and b.d is not null)
  select coalesce(met.u, raw.u) user_id, coalesce(met.d, raw.d) doc_id, raw.id, content, kind, at_, text from raw left join met on met.id = raw.id and met.n = 1 where coalesce(met.u, raw.u) is not null and coalesce(met.d, raw.d) is not null
"""


def _judged(messages: str) -> str:
    return f"""
with m as ({messages}),
spoken as (select *, lag(kind) over w prev, lead(kind) over w nxt, lead(text) over w nxt_text from m where kind <> 2
  window w as (partition by user_id, doc_id order by at_, kind, id)),
c as (select user_id, doc_id, count(*) filter (kind <> 2 and text) texts, count(*) filter (kind = 3 or (kind <> 2 and at_ is null) or (kind = 0 and not text)) bad from m group by all),
s as (select user_id, doc_id, bool_or(kind = 1 and coalesce(prev, 9) <> 0) broken, bool_or(kind = 0 and not (coalesce(nxt, 9) = 1 and nxt_text)) missing from spoken group by all)
select user_id, doc_id, case when texts = 0 then 'empty' when bad > 0 or broken then 'broken' when missing then 'missing_reply' end reason
from c left join s using (user_id, doc_id)
"""


# RE2 knows only ASCII white space as \\s
_GAP = "[^\\s\\p{Z}\\x{85}\\x{1c}-\\x{1f}.!?。！？]"


def _ranked(name: str, condition: str) -> str:
    return f"""
        with v as (select distinct vec_id, embedding::double[64] e from {name}
                   where len(embedding) = 64 and list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false))) and list_bool_or(list_transform(embedding, lambda x: x <> 0))),
        r as (select a.vec_id, b.vec_id other, array_cosine_similarity(a.e, b.e) s,
                     row_number() over (partition by a.vec_id order by array_cosine_similarity(a.e, b.e) desc, b.vec_id) "rank"
              from v a join v b on a.vec_id <> b.vec_id where {condition})
        select vec_id, "rank", other, s from r where "rank" <= 5"""


def oracle_sql() -> dict[str, str]:
    top = lambda name: f'select vec_id, "rank"::int "rank", other, round(s, 5) similarity from ({_ranked(name, "a.vec_id % 100 = 0")})'
    return {
        "p1_found": f'select distinct least(vec_id, other) vec_a, greatest(vec_id, other) vec_b from ({_ranked("chunk_vectors", "true")}) where s >= 0.85',
        "p1_neighbours": top("chunk_vectors"),
        "p1_embeddings": top("embeddings"),
        "p4_found": f"""
            select distinct nullif(lower(trim(metadata.doc_id, {_BLANKS})), '') doc_id, metadata.chunk_index chunk_index,
                   case when regexp_matches(text, '{_GAP}{{400}}[^\\s\\p{{Z}}\\x{{85}}\\x{{1c}}-\\x{{1f}}]') then 'forced' else 'natural' end kind
            from chunks where length(text) > 400""",
        "p4_properties": f"""
            select distinct nullif(lower(trim(metadata.doc_id, {_BLANKS})), '') doc_id, metadata.chunk_index chunk_index, length(text)::int length, true within_limit, true covers, true in_place, true "overlaps" from chunks where length(text) > 400""",
        # placeholders stated anew, not taken from the operator
        "p2_empty": f"""
            with a as (select distinct pair_id, regexp_replace(regexp_replace(coalesce(answer, ''), '(?i)cited source indices\\s*:[^\\n]*', '', 'g'), '[\\p{{Cf}}\\x{{34f}}\\x{{115f}}\\x{{1160}}\\x{{2800}}\\x{{3164}}\\x{{fe0e}}\\x{{fe0f}}]', '', 'g') t from chat_pairs where pair_id is not null),
            w as (select pair_id, array_to_string(regexp_extract_all(lower(t), '[\\p{{L}}\\p{{N}}]+'), ' ') w from a)
            select distinct pair_id from w where w in ('', 'n a', 'na', 'nan', 'null', 'nil', 'none', 'tbd', 'todo', 'undefined', 'placeholder', 'no answer', 'answer', 'empty', 'no content', 'no response', 'answer here', 'your answer here')""",
        "p8_found": """
            with w as (select doc_id, regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}]+') l from documents where text is not null),
            d as (select distinct doc_id, unnest(list_transform(range(1, len(l) - 10), lambda i: array_to_string(list_slice(l, i, i + 11), ' '))) g from w where len(l) >= 12),
            v as (select item_id, regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}]+') l from eval_items where text is not null),
            e as (select distinct item_id, unnest(list_transform(range(1, len(l) - 10), lambda i: array_to_string(list_slice(l, i, i + 11), ' '))) g from v where len(l) >= 12)
            select distinct doc_id, item_id from d join e using (g)""",
        "p6_found": f"select * from ({_judged(P6_MESSAGES)}) where reason is not null",
        "p6_linked": f"select * from ({_judged(P6_LINKED)}) where reason is not null",
        "p6_conversations": f"""
            with j as ({_judged(P6_MESSAGES)}), m as ({P6_MESSAGES})
            select m.user_id, m.doc_id, row_number() over (partition by m.user_id, m.doc_id order by at_, kind, id) - 1 seq, id,
                   case kind when 0 then 'user' else 'assistant' end "role", content, at_ "at"
            from m join j on j.user_id = m.user_id and j.doc_id = m.doc_id and j.reason is null where kind < 2""",
    }
