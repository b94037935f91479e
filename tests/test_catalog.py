from datetime import datetime

import json

from foliant.operators import catalog
from foliant.sources import files, providers, schemas, vectors
from pyspark.sql import functions as F


def test_upsert_insert_update_and_cascade(spark):
    base = spark.createDataFrame([("a", 1, "old"), ("b", 1, None)], "k string, version int, v string")
    new = spark.createDataFrame([("a", 2, None, 7), ("c", 1, "x", 8), ("c", 1, "x", 8)], "k string, version int, v string, extra int")
    assert sorted(map(tuple, catalog.upsert(base, new, ["k"]).collect()), key=str) == sorted([("a", 2, None, 7), ("b", 1, None, None), ("c", 1, "x", 8)], key=str)
    assert [r.k for r in catalog.insert_absent(base, new.select("k"), ["k"]).collect()] == ["c"]
    changed = catalog.update_matched(base, spark.createDataFrame([("b", "set"), ("a", None)], "k string, v string"), "k", ["v"])
    assert {r.k: r.v for r in changed.collect()} == {"a": "old", "b": "set"}
    child = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "doc_id string, x int")
    left = catalog.cascade(spark.createDataFrame([("a",), ("a",)], "doc_id string"), {"c": child})["c"]
    assert sorted(r.x for r in left.collect()) == [2, 3]
    assert catalog.upsert(base.limit(0), new.limit(0), ["k"]).count() == 0


def test_owners_histories_and_selections(spark):
    docs = spark.createDataFrame([("D1 ", "u1"), ("d2", "U2"), ("d3", None)], "id string, user_id string")
    asked = spark.createDataFrame([(1, "U1", ["d1", "d2", None]), (2, "u2", ["D2 "]), (3, None, ["d1"]), (4, "u1", [])], "request_id int, user_id string, doc_ids array<string>")
    assert [tuple(r) for r in catalog.ownership_violations(asked, docs).collect()] == [(1, "d2")]
    assert catalog.owned(docs, " u2").count() == 1
    m = spark.createDataFrame([("u", "d"), ("U ", "D"), ("u", "e"), (None, "d"), ("u", " ")], "user_id string, doc_id string")
    assert sorted(map(tuple, catalog.active_chats(m).collect())) == [("u", "d"), ("u", "e")]
    assert catalog.remove_history(m, "u", "d").count() == 4
    s = spark.createDataFrame([(["a", "b"],)], "s array<string>")
    assert tuple(s.select(catalog.toggled(F.col("s"), F.lit("a")), catalog.toggled(F.col("s"), F.lit("c"))).first()) == (["b"], ["a", "b", "c"])
    assert s.select(catalog.placeholder(F.array(F.lit("Please wait a moment.")))).first()[0]


def test_vector_store(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = spark.createDataFrame([(f"d{i}", i, [float(i)]) for i in range(20)], "doc_id string, chunk_index int, embedding array<float>")
    assert vectors.append(rows, path, 4) and not vectors.append(rows.limit(0), path, 4)
    assert vectors.append(rows.where("chunk_index = 3").withColumn("chunk_index", F.lit(99)), path, 4)
    assert sorted(r.chunk_index for r in vectors.read(spark, path, ["d3", "d5", "none"], 4).collect()) == [3, 5, 99]
    assert vectors.read(spark, path, [], 4).count() == 0 and vectors.read(spark, path).count() == 21
    plan = vectors.read(spark, path, ["d3"], 4)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    vectors.delete(spark, path, ["d3", "d4"], 4)
    assert vectors.read(spark, path).count() == 18
    vectors.delete(spark, path, [f"d{i}" for i in range(20)], 4)


def test_uploads_and_pages(spark, tmp_path):
    for name, body in (("a.pdf", b"one\ftwo\f \fthree"), ("b.PDF", b"x"), ("c.txt", b"x")):
        (tmp_path / name).write_bytes(body)
    got = files.pages(files.uploads(spark, str(tmp_path)), lambda c: c.decode().split("\f")).collect()
    assert [(r.name, r.size, r.page, r.text) for r in got] == [("a.pdf", 15, 1, "one"), ("a.pdf", 15, 2, "two"), ("a.pdf", 15, 4, "three")]
    docs = spark.createDataFrame([("d", "n", "one\f\ftwo"), ("e", "n", None)], "id string, name string, text string")
    assert [(r.page, r.text) for r in files.text_pages(docs).collect()] == [(1, "one"), (3, "two")]


def test_earlier_store(spark, tmp_path):
    store = {"documents": {"d1": {"name": "N", "size": 3}, "d2": {}}, "analytics": {"d1": {"word_count": 5, "entities": [{"name": "E"}]}}, "quizzes": {"d2": [{"question": "q"}]}}
    (tmp_path / "m.json").write_text(json.dumps(store, indent=1))
    t = files.earlier_store(spark, str(tmp_path / "m.json"))
    assert sorted(map(tuple, t["documents"].collect())) == [("d1", "N", 3, ""), ("d2", "Unknown", 0, "")]
    a = t["analytics"].first()
    assert (a.word_count, a.complexity_score, json.loads(a.entities), a.alerts) == (5, "Medium", [{"name": "E"}], "[]")
    assert json.loads(t["quizzes"].first().questions) == [{"question": "q"}]


def test_schemas(spark, tmp_path):
    assert [f.name for f in schemas.schema(schemas.VECTORS)["metadata"].dataType] == ["doc_id", "doc_name", "page", "chunk_index"]
    spark.createDataFrame([("d", 1)], "id string, size int").write.parquet(str(tmp_path / "t"))
    spark.createDataFrame([("e", "n")], "id string, name string").write.mode("append").parquet(str(tmp_path / "t"))
    got = schemas.read_table(spark, str(tmp_path / "t"), schemas.DOCUMENTS)
    assert {tuple(r)[:4] for r in got.collect()} == {("d", None, None, 1), ("e", None, "n", None)}
    assert schemas.duplicate_keys(got.union(got), ["id"]).count() == 2
    assert schemas.Options.of(spark) == schemas.Options()


def test_providers(spark):
    rows = spark.createDataFrame([("the model is a model",), ("",), (None,)], "text string")
    v = [r.embedding for r in providers.embed(rows, "text").collect()]
    assert len(v[0]) == 64 and abs(sum(x * x for x in v[0]) - 1) < 1e-6 and not any(v[1]) and not any(v[2])
    own = providers.embed(rows, "text", lambda ts: [[float(len(t))] for t in ts], batch=1).collect()
    assert [r.embedding for r in own] == [[20.0], [0.0], [0.0]]


def test_history_labels(spark):
    rows = spark.createDataFrame([("1", "user", "q", None, "[]", "t"), ("2", "ai", "a", 81, '[{"text": "x", "page": 3}]', "t"), ("3", "ai", "a", 65, "broken", "t")], "id string, role string, content string, confidence int, sources string, timestamp string")
    assert [(r.id, r.n_sources, r.confidence_label) for r in catalog.history(rows).orderBy("id").collect()] == [("1", 0, "Low"), ("2", 1, "High"), ("3", 0, "Medium")]
    named = catalog.named(spark.createDataFrame([("D ",), ("x",), (None,)], "doc_id string"), spark.createDataFrame([("d", "N")], "id string, name string"))
    assert [tuple(r) for r in named.collect()] == [("d", "N")]


def test_messages_in_order_whatever_the_form_of_their_time(spark):
    """Dates with a blank, with T, and seconds; latest copy of an id; the user first at equal times; unreadable times last."""
    at = lambda day: datetime(2025, 1, day)
    rows = [
        ("c", "U ", "D", "assistant", "3", "2025-01-02T00:00:00", at(1)), ("b", "u", "d", "user", "2", "2025-01-02 00:00:00", at(1)), ("a", "u", "d", "user", "1", "1735689600", at(1)),
        ("e", "u", "d", "ai", "5", "soon", at(1)), ("d", "u", "d", "ai", "old", "2025-01-01 00:00:00", at(1)), ("d", "u", "d", "ai", "4", "2025-01-03 00:00:00", at(2)), (None, "u", "d", "ai", "x", None, at(1)), ("f", None, "d", "ai", "x", None, at(1)),
    ]
    df = spark.createDataFrame(rows, "id string, user_id string, doc_id string, role string, content string, timestamp string, loaded_at timestamp")
    stored = catalog.ordered_messages(df)
    assert [(r.seq, r.content) for r in stored.orderBy("seq").collect()] == [(0, "1"), (1, "2"), (2, "3"), (3, "4"), (4, "5")]
    new = spark.createDataFrame([("g", "u", "d", "user", "6", "2024-01-01 00:00:00", at(3)), ("a", "u", "d", "user", "1", None, at(3)), ("h", "v", "d", "user", "0", None, at(3))], df.schema)
    assert {(r.user_id, r.seq, r.content) for r in catalog.append_messages(stored, new).collect()} == {("u", 5, "6"), ("v", 0, "0")}
    assert catalog.ordered_messages(df.limit(0)).count() == 0


def test_only_an_owners_documents_are_deleted(spark):
    docs = spark.createDataFrame([("A", "u", 1), ("b", "v", 2), (None, "u", 3)], "id string, user_id string, doc_id int")
    child = spark.createDataFrame([("a ", 1), ("b", 2), (None, 3)], "doc_id string, n int")
    asked = spark.createDataFrame([("U", "a"), ("u", "B"), ("u", None), (None, "b")], "user_id string, doc_id string")
    allowed, left = catalog.delete_documents(asked, docs, {"child": child})
    assert [r.doc_id for r in allowed.collect()] == ["a"]
    assert sorted(r.n for r in left["child"].collect()) == [2, 3] and sorted(r.doc_id for r in left["documents"].collect()) == [2, 3]
