"""Deeply nested semi-structured records into related flat tables that keep parent and place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.session import key_of

_SPACE = "[\\s﻿ ]"


def unwrap_json(text: Column) -> Column:
    """The text inside a code fence, or the text itself, without blanks and byte-order mark around it."""
    bare = F.regexp_replace(text, f"^{_SPACE}+|{_SPACE}+$", "")
    inner = F.regexp_replace(F.regexp_replace(bare, f"^```\\w*{_SPACE}*", ""), f"{_SPACE}*```$", "")
    return F.when(bare.startswith("```"), inner).otherwise(bare)


def json_items(df: DataFrame, column: str, wrapper: str) -> DataFrame:
    """(doc_id, items): the elements of the column's JSON as JSON texts: of an array, of the array under ``wrapper``, or a lone object.

    A string that holds JSON counts as that JSON. Text that is cut off or is no JSON gives null. Each step is a named column that
    the next ones share, so every text is parsed once.
    """
    in_list = lambda c: F.from_json(F.concat(F.lit("["), c, F.lit("]")), "array<string>")
    t, lone, held = F.col("_t"), F.col("_lone"), F.col("_held")
    steps = df.select("doc_id", unwrap_json(F.col(column)).alias("_t"))
    steps = steps.select("doc_id", F.when(t.startswith('"'), unwrap_json(F.element_at(in_list(t), 1))).otherwise(t).alias("_t"))
    steps = steps.select("doc_id", "_t", F.when(t.startswith("{"), in_list(t)).alias("_lone"))
    steps = steps.select("doc_id", "_t", "_lone", F.get_json_object(F.element_at(lone, 1), f"$.{wrapper}").alias("_held"))
    items = F.when(t.startswith("["), F.from_json(t, "array<string>")).when(held.startswith("["), F.from_json(held, "array<string>")).when(held.startswith("{"), F.array(held)).otherwise(lone)
    return steps.select("doc_id", items.alias("items"))


def latest(df: DataFrame, key: str, columns: list[str], at: str = "loaded_at") -> DataFrame:
    """(key, columns) of the row with the latest ``at`` of each key; equal times are settled by content.

    Partial aggregation keeps one row per key and task before the shuffle, so a key with a third of all rows costs no more than another.
    """
    picked = F.struct(*[F.col(c) for c in columns])
    order = F.struct(F.col(at), F.xxhash64(*columns))
    return df.select(key_of(key).alias(key), at, *columns).where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(picked, order).alias("r")).select(key, "r.*")


def _objects(items: Column, fields: str, whole: bool = False) -> Column:
    """(item_no, o) per element that is an object: its place and its fields; other elements give none but keep their places.

    The transforms are nested, not one lambda, so that no JSON is parsed once per field. With ``whole`` the JSON stays, as ``json``.
    """
    placed = F.filter(F.transform(items, lambda x, i: F.struct(i.alias("item_no"), x.alias("json"))), lambda p: p["json"].startswith("{"))
    return F.transform(placed, lambda p: F.struct(p["item_no"].alias("item_no"), F.from_json(p["json"], fields).alias("o"), *([p["json"].alias("json")] if whole else [])))


def _page(text: Column) -> Column:
    """A page as a whole number: from 3, "3", 3.7, "3.7" or "p. 3"; else null."""
    return F.regexp_extract(text, "-?\\d+(\\.\\d+)?", 0).try_cast("double").try_cast("int")


def _list(text: Column) -> Column:
    return F.when(text.startswith("["), F.from_json(text, "array<string>")).when(text.startswith("{"), F.array(text))


def entity_tree(analytics: DataFrame) -> DataFrame:
    """(doc_id, items): the entities of each document's latest row, each with its place and its mentions.

    One pass of nested transforms; :func:`entities` and :func:`mentions` read it. Null, empty and cut-off JSON give a null list.
    """

    def build(e: Column) -> Column:
        o = e["o"]
        sub = F.transform(_list(o["mentions"]), lambda m, j: F.struct(e["item_no"].alias("item_no"), j.alias("sub_no"), m.alias("json")))
        return F.struct(e["item_no"].alias("item_no"), o["name"].alias("name"), o["type"].alias("type"), o["description"].alias("description"), sub.alias("subs"))

    rows = json_items(latest(analytics, "doc_id", ["entities"]), "entities", "entities")
    return rows.select("doc_id", F.transform(_objects(F.col("items"), "name string, type string, description string, mentions string"), build).alias("items"))


def entities(tree: DataFrame) -> DataFrame:
    """(doc_id, item_no, name, type, description): one row per entity; absent fields are null."""
    rows = F.transform("items", lambda e: F.struct(e["item_no"].alias("item_no"), e["name"].alias("name"), e["type"].alias("type"), e["description"].alias("description")))
    return tree.select("doc_id", F.inline(rows))


def mentions(tree: DataFrame) -> DataFrame:
    """(doc_id, item_no, sub_no, page, span_start, span_end): one row per mention, tied to its entity by item_no."""

    parsed = F.transform(F.flatten(_subs()), lambda m: F.struct(m["item_no"].alias("item_no"), m["sub_no"].alias("sub_no"), F.from_json(m["json"], "page string, span struct<start: string, end: string>").alias("o")))

    def row(m: Column) -> Column:
        o = m["o"]
        return F.struct(
            m["item_no"].alias("item_no"), m["sub_no"].alias("sub_no"), _page(o["page"]).alias("page"),
            o["span"]["start"].try_cast("int").alias("span_start"), o["span"]["end"].try_cast("int").alias("span_end"),
        )

    return tree.select("doc_id", F.inline(F.transform(parsed, row)))


def _subs() -> Column:
    """The inner lists of all items; flatten gives null if one of them is null, so those go first."""
    return F.filter(F.transform("items", lambda e: e["subs"]), lambda s: s.isNotNull())


#: Fields that may hold an alert's text, in order of preference.
ALERT_TEXT = ("content", "text", "description", "message", "note")
#: Text of an alert that has none.
ALERT_DEFAULT = "Key metric highlighted in document."


def _other_text(json: Column) -> Column:
    """The first string of an object, in the order written, that is not empty nor its type or page."""
    fields = F.map_entries(F.from_json(json, "map<string,variant>"))
    texts = F.filter(fields, lambda f: ~f["key"].isin("type", "page") & (F.schema_of_variant(f["value"]) == "STRING") & (F.try_variant_get(f["value"], "$", "string") != ""))
    return F.try_variant_get(F.get(texts, F.lit(0))["value"], "$", "string")


def alerts(analytics: DataFrame) -> DataFrame:
    """(doc_id, item_no, type, content, page): the alerts of each document's latest row, with the text from whichever field holds it: the known ones, else the first other string, else a default."""

    def build(e: Column) -> Column:
        o = e["o"]
        text = F.coalesce(*[F.when(o[f] != "", o[f]) for f in ALERT_TEXT], _other_text(e["json"]), F.lit(ALERT_DEFAULT))
        return F.struct(e["item_no"].alias("item_no"), F.coalesce(o["type"], F.lit("insight")).alias("type"), text.alias("content"), _page(o["page"]).alias("page"))

    rows = json_items(latest(analytics, "doc_id", ["alerts"]), "alerts", "alerts")
    fields = "type string, page string, " + ", ".join(f"{f} string" for f in ALERT_TEXT)
    return rows.select("doc_id", F.inline(F.transform(_objects(F.col("items"), fields, whole=True), build)))


def question_tree(quizzes: DataFrame) -> DataFrame:
    """(doc_id, items): the questions of each document's latest row, each with its place and its options.

    Options come as texts, as objects with label and text, or as an object from label to text, in the order written.
    """

    def build(p: Column) -> Column:
        o = p["o"]
        lone = F.get_json_object(o["options"], "$.text").isNotNull()
        by_label = F.transform(F.map_entries(F.from_json(o["options"], "map<string,string>")), lambda e: F.struct(e["key"].alias("label"), e["value"].alias("text")))
        one = lambda x: F.when(
            x.startswith("{"), F.struct(F.get_json_object(x, "$.label").alias("label"), F.get_json_object(x, "$.text").alias("text"))
        ).otherwise(F.struct(F.lit(None).cast("string").alias("label"), x.alias("text")))
        options = F.when(o["options"].startswith("{") & ~lone, by_label).otherwise(F.transform(_list(o["options"]), one))
        sub = F.transform(
            options, lambda x, j: F.struct(p["item_no"].alias("item_no"), j.alias("sub_no"), x["label"].alias("label"), x["text"].alias("text"), (x["text"] == o["correct"]).alias("is_correct"))
        )
        return F.struct(
            p["item_no"].alias("item_no"), F.coalesce(o["id"].try_cast("int"), p["item_no"] + 1).alias("question_id"), o["question"].alias("question"),
            o["correct"].alias("correct"), o["difficulty"].alias("difficulty"), _page(o["page_ref"]).alias("page_ref"), sub.alias("subs"),
        )

    rows = json_items(latest(quizzes, "doc_id", ["questions"]), "questions", "questions")
    fields = "id string, question string, options string, correct string, difficulty string, page_ref string"
    return rows.select("doc_id", F.transform(_objects(F.col("items"), fields), build).alias("items"))


def questions(tree: DataFrame) -> DataFrame:
    """(doc_id, item_no, question_id, question, correct, difficulty, page_ref): one row per question."""
    names = ("item_no", "question_id", "question", "correct", "difficulty", "page_ref")
    return tree.select("doc_id", F.inline(F.transform("items", lambda e: F.struct(*[e[n].alias(n) for n in names]))))


#: What a quiz holds where its JSON cannot be read, and what a question has where a field is absent. Difficulty and page.
FALLBACK_QUESTION = {"question": "What is the main subject of this document?", "correct": "Its main subject", "difficulty": "Medium", "page_ref": 1}


def repaired_questions(quizzes: DataFrame) -> DataFrame:
    """(doc_id, item_no, question_id, question, correct, difficulty, page_ref): the questions of every quiz, absent fields filled in.

    A quiz that is null, unreadable, cut off or holds an element that is no object is replaced as a whole by one stand-in question; an empty list stays empty.
    """
    fill = FALLBACK_QUESTION
    fields = "id string, question string, correct string, difficulty string, page_ref string"
    rows = json_items(latest(quizzes, "doc_id", ["questions"]), "questions", "questions")
    sound = F.coalesce(F.forall("items", lambda x: x.startswith("{")), F.lit(False))

    def build(p: Column) -> Column:
        o = p["o"]
        return F.struct(
            p["item_no"].alias("item_no"), F.coalesce(o["id"].try_cast("int"), p["item_no"] + 1).alias("question_id"), F.coalesce(o["question"], F.lit(fill["question"])).alias("question"),
            F.coalesce(o["correct"], F.lit("")).alias("correct"), F.coalesce(o["difficulty"], F.lit(fill["difficulty"])).alias("difficulty"), F.coalesce(_page(o["page_ref"]), F.lit(fill["page_ref"])).alias("page_ref"),
        )

    stand_in = F.array(F.struct(F.lit(0).alias("item_no"), F.lit(1).alias("question_id"), *[F.lit(fill[c]).alias(c) for c in ("question", "correct", "difficulty", "page_ref")]))
    items = F.when(sound, F.transform(_objects(F.col("items"), fields), build)).otherwise(stand_in)
    return rows.select("doc_id", F.inline(items))


def analytics_record(analytics: DataFrame) -> DataFrame:
    """(doc_id, word_count, complexity_score, summary, suggested_questions, entities, alerts): each document's latest analytics, decoded.

    Lists of texts are arrays; entities and alerts are counted. JSON that is null, unreadable or cut off gives the fail-safe record: one line of summary
    that says so, no questions, entities or alerts; an absent complexity is Medium.
    """
    columns = ["word_count", "complexity_score", "summary", "suggested_questions", "entities", "alerts"]
    rows = latest(analytics, "doc_id", columns)

    def texts(column: str) -> DataFrame:
        return json_items(rows.select("doc_id", column), column, column).withColumnRenamed("items", column)

    # wrappings differ by column, so each is unwrapped by itself; the keys are partitioned alike and joins move nothing more
    plain = rows.select("doc_id", "word_count", F.coalesce("complexity_score", F.lit("Medium")).alias("complexity_score"))
    for column in columns[2:]:
        plain = plain.join(texts(column), "doc_id")
    objects = lambda c: F.coalesce(F.size(F.filter(c, lambda x: x.startswith("{"))), F.lit(0))
    none = F.array().cast("array<string>")
    return plain.select(
        "doc_id", "word_count", "complexity_score", F.coalesce("summary", F.array(F.lit(NO_SUMMARY))).alias("summary"), F.coalesce("suggested_questions", none).alias("suggested_questions"),
        objects("entities").alias("entities"), objects("alerts").alias("alerts"),
    )


#: The summary of a document whose analytics cannot be read.
NO_SUMMARY = "No summary could be made of this document."


def options(tree: DataFrame) -> DataFrame:
    """(doc_id, item_no, sub_no, label, text, is_correct): one row per option, tied to its question by item_no."""
    return tree.select("doc_id", F.inline(F.flatten(_subs())))


def flat_rows(analytics: DataFrame, quizzes: DataFrame) -> DataFrame:
    """(child, doc_id, item_no, sub_no) of all five flat tables, each from its own operator; sub_no is -1 where a row has no inner place."""
    trees = entity_tree(analytics), question_tree(quizzes)
    tables = {"entity": entities(trees[0]), "mention": mentions(trees[0]), "alert": alerts(analytics), "question": questions(trees[1]), "option": options(trees[1])}
    out: DataFrame | None = None
    for child, rows in tables.items():
        inner = F.col("sub_no") if "sub_no" in rows.columns else F.lit(-1)
        part = rows.select(F.lit(child).alias("child"), "doc_id", F.col("item_no").cast("int").alias("item_no"), inner.cast("int").alias("sub_no"))
        out = part if out is None else out.unionByName(part)
    return out
