from datetime import datetime, timedelta
import random

import pytest

from foliant.llm import conversations as C
from foliant.llm.components import components

AT = datetime(2025, 5, 1)
SCHEMA = "id string, user_id string, doc_id string, role string, content string, timestamp string, loaded_at timestamp, at string, conv int"


def rows(spark, data):
    return spark.createDataFrame([(f"m{i}" if m[0] is None else m[0], *m[1:6], AT + timedelta(days=m[6] if len(m) > 6 else 0), "clash", 1) for i, m in enumerate(data)], SCHEMA)


def reasons(spark, data, links=None):
    got = C.dropped(rows(spark, data), spark.createDataFrame(links, "id string, target string") if links else None).collect()
    return {(r.user_id, r.doc_id): r.reason for r in got}


def turn(user, doc, n=0):
    return [(None, user, doc, "User", "q", f"2025-01-0{n + 1} 00:00:00"), (None, user, doc, " AI", "a", f"2025-01-0{n + 1} 00:00:00")]


def test_each_reason_and_its_order(spark):
    t = "2025-01-09T00:00:00"
    data = [
        *turn("ok", "d"), *turn("ok", "d", 1), (None, "ok", "d", "system", None, None),
        (None, "e", "d", "user", "​ \n", t), (None, "e", "d", "bot", None, t), (None, "sys", "d", "system", "text", t),
        *turn("b1", "d"), (None, "b1", "d", "tool", "x", t), *turn("b2", "d"), (None, "b2", "d", "user", "x", "unknown"),
        *turn("b3", "d"), (None, "b3", "d", "assistant", "x", t), *turn("b4", "d"), (None, "b4", "d", None, "x", t),
        *turn("m1", "d"), (None, "m1", "d", "human", "x", "1736380800"), *turn("m2", "d"), (None, "m2", "d", "user", "x", t), (None, "m2", "d", "bot", "  ", t),
        *turn("m3", "D "), (None, "m3", " d", "user", "x", t), (None, "m3", "d", "user", "y", t), (None, "m3", "d", "bot", "y", t),
        (None, None, "d", "tool", "x", t), (None, "u", " ", "tool", "x", t),
    ]
    want = {"e": "empty", "sys": "empty", "b1": "broken", "b2": "broken", "b3": "broken", "b4": "broken", "m1": "missing_reply", "m2": "missing_reply", "m3": "missing_reply"}
    assert reasons(spark, data) == {(u, "d"): r for u, r in want.items()}


def test_repeated_ids_count_once_and_neighbours_on_other_days(spark):
    data = [("x", "u", "d", "user", "q", "2025-01-01 23:59:59"), ("x", "U", "d ", "user", "q", "2025-01-01 23:59:59", 3), ("y", "u", "d", "ai", "a", "2025-01-05 00:00:00")]
    assert reasons(spark, data) == {}
    got = C.conversations(rows(spark, data)).orderBy("seq").select("seq", "id", "role", "content").collect()
    assert [tuple(r) for r in got] == [(0, "x", "user", "q"), (1, "y", "assistant", "a")]


def test_links_reach_rows_without_keys(spark):
    data = [("x", "u", "d", "user", "q", "2025-01-01 00:00:00"), ("y", None, None, "ai", "a", "2025-01-01 00:00:01"), ("z", None, None, "ai", "a", "2025-01-01 00:00:01")]
    assert reasons(spark, data) == {("u", "d"): "missing_reply"}
    assert reasons(spark, data, [("y", "x"), ("q", "x"), (None, "x")]) == {}


def test_empty_table(spark):
    assert reasons(spark, []) == {} and C.conversations(rows(spark, [])).count() == 0


@pytest.mark.parametrize("shape", ["chain", "star", "random"])
def test_components_against_union_find(spark, shape):
    rng = random.Random(5)
    n = 3000 if shape == "star" else 400
    pairs = {"chain": [(i, i + 1) for i in range(n)], "star": [(7, 7 + i) for i in range(n)], "random": [(rng.randrange(n), rng.randrange(n)) for _ in range(n // 2)]}[shape]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    got = components(spark.createDataFrame([*pairs, (None, 3), *pairs[:5]], "a long, b long")).collect()
    assert {r.node: r.component for r in got} == {x: root(x) for x in parent}


def test_reply_links_decide_where_keys_lack(spark):
    """A reply without its document follows the user's last message; too late ones, and ones before it, link to nothing."""
    t = "2025-01-01 00:%s:00"
    data = [
        ("a", "u", "d", "user", "q", t % "01"), ("b", "U ", None, "ai", "a", t % "02"), ("c", "v", "d", "user", "q", t % "30"), ("e", "v", " ", "ai", "a", t % "45"), ("f", "w", "d", "user", "q", t % "50"),
        ("g", "w", None, "ai", "a", t % "49"), ("h", None, None, "ai", "a", t % "02"), ("i", "u", None, "ai", "a", "unknown"),
    ]
    df = rows(spark, data)
    assert {tuple(r) for r in C.reply_links(df).collect()} == {("b", "a")}
    assert {(r.user_id, r.doc_id): r.reason for r in C.dropped(df, C.reply_links(df)).collect()} == {("v", "d"): "missing_reply", ("w", "d"): "missing_reply"}
    assert C.dropped(df.limit(0), C.reply_links(df.limit(0))).count() == 0


def test_components_decide_of_every_message(spark, monkeypatch):
    """Without links too: messages that name one key, however spelled, are joined, and what the components say is the conversation."""
    seen = []
    monkeypatch.setattr(C, "components", lambda edges: seen.append(edges) or components(edges))
    t = "2025-01-01 00:00:0%d"
    data = [
        ("a", "u", "d", "user", "q", t % 0), ("b", "U ", "D", "ai", "a", t % 1), ("b", "u", "d", "ai", "a", t % 1), ("c", "u", " d", "user", "q", t % 2),
        ("x", "v", "d", "user", "q", t % 0), ("y", "w", "d", "ai", "a", t % 1), ("z", None, "d", "ai", "a", t % 3),
    ]
    assert reasons(spark, data) == {("u", "d"): "missing_reply", ("v", "d"): "missing_reply", ("w", "d"): "broken"}
    (edges,) = seen
    nodes = {n for e in edges.collect() for n in (e.a, e.b)}
    assert len(nodes) == 5 and len({r.component for r in components(edges).collect()}) == 3

    # one component: the same rows are one conversation under the least key
    monkeypatch.setattr(C, "components", lambda edges: components(edges.unionByName(edges.selectExpr("a", "min(b) over () b"))))
    assert reasons(spark, data) == {("u", "d"): "broken"}


def test_links_join_keys_and_chains(spark):
    """Links between two keys make one conversation, named by the least; a chain of messages without a key ends where its key is."""
    t = "2025-01-01 00:00:0%d"
    data = [("a", "v", "d", "user", "q", t % 0), ("b", "u", "d", "ai", "a", t % 1), ("c", None, "d", "user", "q", t % 2), ("e", None, None, "ai", "a", t % 3), ("f", None, "d", "ai", "a", t % 4), ("g", "u", None, "ai", "a", t % 5)]
    links = [("b", "a"), ("e", "c"), ("c", "b"), ("g", "f"), ("c", "gone")]
    assert reasons(spark, data, links) == {}
    got = C.conversations(rows(spark, data), spark.createDataFrame(links, "id string, target string")).orderBy("seq").select("user_id", "doc_id", "seq", "id").collect()
    assert [tuple(r) for r in got] == [("u", "d", i, m) for i, m in enumerate("abce")]
