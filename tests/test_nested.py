"""Flat tables against a plain reading of the same JSON."""

import json
import re
from datetime import datetime

import pyarrow.parquet as pq

from foliant.operators import nested
from foliant.session import table

DIR = "/root/testdata/sf0.01"


def read(text, wrapper):
    for _ in range(2):
        if text is None:
            return []
        text = text.strip().lstrip("﻿").strip()
        if text.startswith("```"):
            text = re.sub(r"\s*```$", "", re.sub(r"^```\w*\s*", "", text))
        try:
            value = json.loads(text)
        except ValueError:
            return []
        if not isinstance(value, str):
            break
        text = value
    if isinstance(value, dict) and isinstance(value.get(wrapper), (list, dict)):
        value = value[wrapper]
    return [value] if isinstance(value, dict) else value if isinstance(value, list) else []


def inner(value):
    if isinstance(value, dict):
        return [value] if "text" in value or "page" in value else list(value)
    return value if isinstance(value, list) else []


def brute(name, column, item, sub=None, field=None):
    last = {}
    for r in pq.read_table(f"{DIR}/{name}.parquet").to_pylist():
        key = (r["doc_id"] or "").strip().lower()
        if key and (key not in last or r["loaded_at"] > last[key]["loaded_at"]):
            last[key] = r
    out = set()
    for key, r in last.items():
        for i, o in enumerate(read(r[column], column)):
            if isinstance(o, dict):
                out.add((item, key, i, -1))
                out |= {(sub, key, i, j) for j, _ in enumerate(inner(o.get(field)))} if sub else set()
    return out


def test_whole_tables(spark):
    got = nested.flat_rows(table(spark, DIR, "analytics"), table(spark, DIR, "quizzes")).select("child", "doc_id", "item_no", "sub_no").collect()
    want = brute("analytics", "entities", "entity", "mention", "mentions") | brute("analytics", "alerts", "alert") | brute("quizzes", "questions", "question", "option", "options")
    assert len(got) == len(set(map(tuple, got))) and set(map(tuple, got)) == want


SCHEMA = "doc_id string, entities string, alerts string, questions string, loaded_at timestamp, items string, json string"


def rows(spark, *texts):
    at = datetime(2025, 1, 1)
    return spark.createDataFrame([(f"d{i}", t, t, t, at, "clash", "clash") for i, t in enumerate(texts)], SCHEMA)


def test_wrappings_places_and_cut_off_json(spark):
    df = rows(
        spark, '[{"name": "A", "mentions": [{"page": "3.7", "span": {"start": 1, "end": 2}}, null]}, null, 7, [], {"name": "B", "mentions": {"page": 2}}]',
        '```json\n{"entities": {"name": "C"}}\n```', json.dumps('[{"name": "D"}]'), '[{"name": "E"}, {"na', "", None, "null", "n/a", '﻿ [{"name": "F"}] ', "[]",
    )
    tree = nested.entity_tree(df)
    assert sorted(map(tuple, nested.entities(tree).select("doc_id", "item_no", "name").collect())) == [("d0", 0, "A"), ("d0", 4, "B"), ("d1", 0, "C"), ("d2", 0, "D"), ("d8", 0, "F")]
    assert sorted(map(tuple, nested.mentions(tree).select("item_no", "sub_no", "page").fillna(-9).collect())) == [(0, 0, 3), (0, 1, -9), (4, 0, 2)]


def test_options_in_three_shapes(spark):
    one = [{"question": "q", "options": o, "correct": "x"} for o in (["x", "y"], [{"label": "A", "text": "x"}], {"B": "x", "A": "z"}, {"label": "L", "text": "t"}, "x", None, [])]
    got = nested.options(nested.question_tree(rows(spark, json.dumps(one)))).select("item_no", "sub_no", "label", "text").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(0, 0, None, "x"), (0, 1, None, "y"), (1, 0, "A", "x"), (2, 0, "B", "x"), (2, 1, "A", "z"), (3, 0, "L", "t")], key=str)


def test_latest_row_ties_and_missing_keys(spark):
    a, b = datetime(2025, 1, 1), datetime(2025, 2, 1)
    data = [(" K ", '[{"question": "old"}]', a), ("k", '[{"question": "new"}]', b), ("k", '[{"question": "new"}]', b), (None, '[{"question": "x"}]', b), ("  ", '[{"question": "x"}]', b)]
    df = spark.createDataFrame(data, "doc_id string, questions string, loaded_at timestamp")
    assert [tuple(r) for r in nested.questions(nested.question_tree(df)).select("doc_id", "question", "question_id").collect()] == [("k", "new", 1)]


def test_empty_table_and_long_text(spark):
    assert nested.flat_rows(rows(spark).limit(0), rows(spark).limit(0)).count() == 0
    assert nested.alerts(rows(spark, json.dumps([{"text": "z" * 300_000, "page": "p. 4"}]))).select("page").collect()[0][0] == 4


def test_alert_text_under_other_keys_and_default(spark):
    given = [{"type": "t", "page": "2", "n": 3, "e": "", "zeta": "first", "alpha": "second"}, {"type": "t", "n": 3, "o": {"q": "x"}, "l": ["y"], "z": None}, {"content": "", "zeta": "other"}, {"zeta": "other", "note": "known"}]
    got = nested.alerts(rows(spark, json.dumps(given))).select("item_no", "content").collect()
    assert sorted(map(tuple, got)) == [(0, "first"), (1, nested.ALERT_DEFAULT), (2, "other"), (3, "known")]
