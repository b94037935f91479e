"""Registered queries of the general data operators (problems 3 and 5) and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foliant.operators import nested, orphans
from foliant.session import table

Query = Callable[[SparkSession, str], DataFrame]


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    refs = orphans.references([
        orphans.Reference("documents", t("documents"), "id", "user_id", "users"),
        orphans.Reference("analytics", t("analytics"), "doc_id", "doc_id", "documents"),
        orphans.Reference("quizzes", t("quizzes"), "doc_id", "doc_id", "documents"),
        orphans.Reference("chat_messages", t("chat_messages"), "id", "doc_id", "documents", ("global",)),
    ])
    parents = orphans.parents_of({"users": (t("users"), "id"), "documents": (t("documents"), "id")}, t("deletions"))
    return orphans.orphans(refs, parents)


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans.orphan_report(p3_found(spark, sf_dir))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.flat_rows(table(spark, sf_dir, "analytics"), table(spark, sf_dir, "quizzes"))


def queries() -> dict[str, Query]:
    analytics = lambda f: lambda spark, d: f(table(spark, d, "analytics"))
    return {
        "p3_found": p3_found,
        "p3_report": p3_report,
        "p5_found": p5_found,
        "p5_entities": analytics(lambda a: nested.entities(nested.entity_tree(a))),
        "p5_mentions": analytics(lambda a: nested.mentions(nested.entity_tree(a))),
        "p5_alerts": analytics(nested.alerts),
        "p5_questions": lambda spark, d: nested.questions(nested.question_tree(table(spark, d, "quizzes"))),
        "p5_options": lambda spark, d: nested.options(nested.question_tree(table(spark, d, "quizzes"))),
    }


_KEY = "nullif(lower(trim({}, ' ' || chr(9) || chr(10) || chr(13) || chr(160))), '')"


def _key(column: str) -> str:
    return _KEY.format(column)


def _refs(name: str, row_id: str, ref: str, parent: str) -> str:
    return (
        f"select '{name}' table_name, {_key(row_id)} row_id, {_key(ref)} k, loaded_at, '{parent}' parent from {name} "
        f"qualify row_number() over (partition by {_key(row_id)} order by loaded_at nulls last) = 1"
    )


P3_SQL = f"""
with refs as (
  {_refs("documents", "id", "user_id", "users")} union all
  {_refs("analytics", "doc_id", "doc_id", "documents")} union all
  {_refs("quizzes", "doc_id", "doc_id", "documents")} union all
  {_refs("chat_messages", "id", "doc_id", "documents")}),
parents as (
  select 'users' parent, {_key("id")} k, min(loaded_at) since from users group by 2 union all
  select 'documents' parent, {_key("id")} k, min(loaded_at) since from documents group by 2),
gone as (select distinct lower(trim(table_name)) parent, {_key("record_key")} k from deletions),
judged as (
  select r.table_name, r.row_id,
         case when p.k is not null then case when p.since > r.loaded_at then 'late' end when g.k is not null then 'deleted' else 'missing' end reason,
         strftime(timezone('UTC', r.loaded_at), '%Y-%m') period
  from refs r left join parents p on p.parent = r.parent and p.k = r.k left join gone g on g.parent = r.parent and g.k = r.k
  where r.k is not null and not (r.table_name = 'chat_messages' and r.k = 'global'))
select table_name, row_id, reason, period from judged where reason is not null
"""


_EDGE = "[\\s\\x{feff}\\x{a0}]"


def _bare(text: str) -> str:
    """The text inside a code fence, or the text itself."""
    t = f"regexp_replace({text}, '^{_EDGE}+|{_EDGE}+$', '', 'g')"
    return f"case when {t} like '```%' then regexp_replace(regexp_replace({t}, '^```\\w*{_EDGE}*', ''), '{_EDGE}*```$', '') else {t} end"


def _items(table_name: str, column: str, name: str) -> str:
    """Common table ``name``: (doc_id, item_no, o): the objects of the column's JSON in each document's latest row."""
    return f"""
{name}_1 as (select {_key("doc_id")} doc_id, {_bare(column)} t from {table_name} where {_key("doc_id")} is not null qualify row_number() over (partition by {_key("doc_id")} order by loaded_at desc) = 1),
{name}_2 as (select doc_id, case when json_valid(t) and json_type(t) = 'VARCHAR' then {_bare("(t::json ->> '$')")} else t end t from {name}_1),
{name}_3 as (select doc_id, case when json_valid(t) then t::json end j from {name}_2),
{name}_4 as (select doc_id, case when json_type(j) = 'OBJECT' and json_type(j -> '{column}') in ('ARRAY', 'OBJECT') then j -> '{column}' else j end j from {name}_3),
{name}_5 as (select doc_id, case json_type(j) when 'ARRAY' then json_extract(j, '$[*]') when 'OBJECT' then [j] end l from {name}_4),
{name}_6 as (select doc_id, unnest(range(len(l)))::int item_no, unnest(l) o from {name}_5),
{name} as (select * from {name}_6 where json_type(o) = 'OBJECT')"""


_ENTITIES, _ALERTS, _QUESTIONS = _items("analytics", "entities", "e"), _items("analytics", "alerts", "a"), _items("quizzes", "questions", "q")
_MENTIONS = """
m_1 as (select doc_id, item_no, case json_type(o -> 'mentions') when 'ARRAY' then json_extract(o, '$.mentions[*]') when 'OBJECT' then [o -> 'mentions'] end l from e),
m as (select doc_id, item_no, unnest(range(len(l)))::int sub_no, unnest(l) x from m_1)"""
_OPTIONS = """
o_1 as (select doc_id, item_no, o ->> 'correct' correct, o -> 'options' s from q),
o_2 as (select doc_id, item_no, correct, case when json_type(s) = 'ARRAY' then list_transform(json_extract(s, '$[*]'), lambda x: case when json_type(x) = 'OBJECT' then struct_pack(label := x ->> 'label', "text" := x ->> 'text') else struct_pack(label := null::varchar, "text" := x ->> '$') end)
          when json_type(s) = 'OBJECT' and (s ->> 'text') is not null then [struct_pack(label := s ->> 'label', "text" := s ->> 'text')]
          when json_type(s) = 'OBJECT' then list_transform(json_keys(s), lambda k: struct_pack(label := k, "text" := json_extract_string(s, '$."' || k || '"'))) end l from o_1),
o as (select doc_id, item_no, correct, unnest(range(len(l)))::int sub_no, unnest(l) x from o_2)"""
_PAGE = "trunc(try_cast(regexp_extract({}, '-?\\d+(\\.\\d+)?') as double))::int"
ENTITY_SQL = f"with {_ENTITIES} select doc_id, item_no, o ->> 'name' as name, o ->> 'type' as type, o ->> 'description' description from e"
QUESTION_COUNT_SQL = f"with {_QUESTIONS} select doc_id, count(*) questions from q group by 1"
OPTION_SQL = f"with {_QUESTIONS}, {_OPTIONS} select doc_id, item_no, sub_no, x.label label, x.text as text, x.text = correct is_correct from o"


_fill = {k: f"'{v}'" if isinstance(v, str) else v for k, v in nested.FALLBACK_QUESTION.items()}
REPAIRED_SQL = f"""with {_QUESTIONS},
    sound as (select doc_id, l is not null and (len(l) = 0 or list_bool_and(list_transform(l, lambda x: json_type(x) = 'OBJECT'))) ok from q_5)
    select doc_id, item_no, coalesce(try_cast(o ->> 'id' as int), item_no + 1) question_id, coalesce(o ->> 'question', {_fill["question"]}) question, coalesce(o ->> 'correct', '') correct,
           coalesce(o ->> 'difficulty', {_fill["difficulty"]}) difficulty, coalesce({_PAGE.format("o ->> 'page_ref'")}, {_fill["page_ref"]}) page_ref from q join sound using (doc_id) where ok
    union all select doc_id, 0, 1, {_fill["question"]}, {_fill["correct"]}, {_fill["difficulty"]}, {_fill["page_ref"]} from sound where not ok"""
_LISTS = {c: _items("analytics", c, f"{c[0]}l") for c in ("summary", "suggested_questions", "entities", "alerts")}
_LISTS["suggested_questions"] = _items("analytics", "suggested_questions", "nl")
RECORD_SQL = f"""with {", ".join(_LISTS.values())},
    l as (select {_key("doc_id")} doc_id, word_count, coalesce(complexity_score, 'Medium') complexity_score from analytics where {_key("doc_id")} is not null qualify row_number() over (partition by {_key("doc_id")} order by loaded_at desc) = 1)
    select l.*, coalesce(array_to_string(list_transform(sl_5.l, lambda x: x ->> '$'), '|'), '{nested.NO_SUMMARY}') summary, coalesce(array_to_string(list_transform(nl_5.l, lambda x: x ->> '$'), '|'), '') suggested_questions,
           coalesce(len(list_filter(el_5.l, lambda x: json_type(x) = 'OBJECT')), 0)::int entities, coalesce(len(list_filter(al_5.l, lambda x: json_type(x) = 'OBJECT')), 0)::int alerts
    from l join sl_5 using (doc_id) join nl_5 using (doc_id) join el_5 using (doc_id) join al_5 using (doc_id)"""


def oracle_sql() -> dict[str, str]:
    texts = ", ".join(f"nullif(o ->> '{f}', '')" for f in nested.ALERT_TEXT)
    return {
        "p5_found": f"""with {_ENTITIES}, {_ALERTS}, {_QUESTIONS}, {_MENTIONS}, {_OPTIONS}
            select 'entity' child, doc_id, item_no, -1 sub_no from e union all select 'alert', doc_id, item_no, -1 from a union all select 'question', doc_id, item_no, -1 from q
            union all select 'mention', doc_id, item_no, sub_no from m union all select 'option', doc_id, item_no, sub_no from o""",
        "p5_entities": ENTITY_SQL,
        "p5_mentions": f"""with {_ENTITIES}, {_MENTIONS} select doc_id, item_no, sub_no, {_PAGE.format("x ->> 'page'")} page, try_cast(x ->> '$.span.start' as int) span_start, try_cast(x ->> '$.span.end' as int) span_end from m""",
        "p5_alerts": f"""with {_ALERTS} select doc_id, item_no, coalesce(o ->> 'type', 'insight') as type, coalesce({texts}) as content, {_PAGE.format("o ->> 'page'")} page from a""",
        "p5_questions": f"""with {_QUESTIONS} select doc_id, item_no, coalesce(try_cast(o ->> 'id' as int), item_no + 1) question_id, o ->> 'question' question, o ->> 'correct' correct, o ->> 'difficulty' difficulty, {_PAGE.format("o ->> 'page_ref'")} page_ref from q""",
        "p5_options": OPTION_SQL,
"p3_found": P3_SQL,
        "p3_report": f"select table_name, reason, period, count(*) orphans from ({P3_SQL}) group by all",
    }
