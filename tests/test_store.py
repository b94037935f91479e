import pytest

from foliant.operators import nested
from foliant.operators.skew import join_unique
from foliant.sources import files, providers, vectors
from foliant.session import shared_folder
from pyspark.sql import functions as F


def test_damaged_files_are_named(spark, tmp_path):
    path = str(tmp_path / "v")
    vectors.append(spark.createDataFrame([(f"d{i}", i) for i in range(40)], "doc_id string, chunk_index int"), path)
    files = sorted((tmp_path / "v").rglob("*.parquet"))
    assert vectors.skipped_files(spark, path).count() == 0
    files[-1].write_bytes(b"damaged")
    for crc in files[-1].parent.glob(".*.crc"):
        crc.unlink()
    assert [r.path.endswith(files[-1].name) for r in vectors.skipped_files(spark, path).collect()] == [True]
    assert vectors.read(spark, path).count() < 40


def test_a_cluster_needs_a_shared_folder(spark):
    class Stand:
        conf, sparkContext = type("C", (), {"get": staticmethod(lambda *a: None)}), type("S", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError, match="checkpoint"):
        shared_folder(Stand())


def test_parts_of_a_hot_key_grow_with_its_share(spark):
    big = spark.range(3000).select(F.when(F.col("id") < 1500, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id")
    small = big.groupBy("k").agg(F.count("*").alias("n")).withColumn("v", F.length("k"))
    got = join_unique(big, small, ["k"], "n", F.lit(3000), F.xxhash64("id"))
    assert got.count() == 3000 and got.where("v <> length(k)").count() == 0 and got.columns == ["k", "id", "v"]


def test_quizzes_and_analytics_that_cannot_be_read(spark):
    q = spark.createDataFrame([("a", '[{"question": "q"}]', None), ("b", '[{"question": "q"}, 7]', None), ("c", "{cut", None), ("d", "[]", None), ("e", None, None), (None, "[]", None)], "doc_id string, questions string, loaded_at timestamp")
    got = {(r.doc_id, r.question, r.difficulty, r.page_ref) for r in nested.repaired_questions(q).collect()}
    assert got == {("a", "q", "Medium", 1)} | {(d, nested.FALLBACK_QUESTION["question"], "Medium", 1) for d in "bce"}
    a = spark.createDataFrame([("a", 1, None, '["s"]', '```json\n["q"]\n```', '[{"name": "x"}, 3]', None, None), ("b", None, "High", "[cut", "", None, "{}", None)], "doc_id string, word_count int, complexity_score string, summary string, suggested_questions string, entities string, alerts string, loaded_at timestamp")
    got = {r.doc_id: (r.complexity_score, r.summary, r.suggested_questions, r.entities, r.alerts) for r in nested.analytics_record(a).collect()}
    assert got == {"a": ("Medium", ["s"], ["q"], 1, 0), "b": ("High", [nested.NO_SUMMARY], [], 0, 1)}


def test_import_of_an_earlier_store_and_uploads(spark, tmp_path):
    path = tmp_path / "m.json"
    path.write_text('{"documents": {"d1": {"name": "N"}, "d2": {}}, "quizzes": {"d1": [], "d2": []}}')
    stored = {"documents": spark.createDataFrame([("d2",)], "id string"), "quizzes": spark.createDataFrame([("d1",)], "doc_id string")}
    got = files.import_earlier_store(spark, str(path), "admin", stored)
    assert [(r.id, r.user_id) for r in got["documents"].collect()] == [("d1", "admin")] and [r.doc_id for r in got["quizzes"].collect()] == ["d2"]
    assert files.mark_imported(spark, str(path)) and files.import_earlier_store(spark, str(path), "admin", stored) == {} and not files.mark_imported(spark, str(path))
    with pytest.raises(FileNotFoundError):
        files.uploads(spark, str(tmp_path / "nothing"))
    pages = spark.createDataFrame([("/x/a.pdf", "a.pdf", 9, 1, "one two three"), ("/x/a.pdf", "a.pdf", 9, 2, "four " * 200), ("/x/b.pdf", "b.pdf", 1, 1, "  ")], "path string, name string, size long, page int, text string")
    made = files.ingest(pages, F.lit("u"), F.lit("2025-01-01 00:00:00").cast("timestamp"))
    assert sorted((r.name, r.user_id, r.size, r.upload_time) for r in made["documents"].collect()) == [("a.pdf", "u", 9, "2025-01-01 00:00:00"), ("b.pdf", "u", 1, "2025-01-01 00:00:00")]
    chunks, analytics = made["chunks"].collect(), made["analytics"].collect()
    assert len(chunks) > 2 and all(len(r.embedding) == 64 for r in chunks) and [(r.page_count, r.word_count >= 203) for r in analytics] == [(2, True)]
    assert files.pending(made["analytics"]).count() == 1
    done = made["analytics"].withColumn("summary", F.lit('["real"]')).withColumn("loaded_at", F.col("loaded_at") + F.expr("interval 1 day"))
    assert files.pending(made["analytics"].unionByName(done)).count() == 0


def test_chat_calls_have_roles_history_and_temperature(spark):
    talks = [(1, [("AI", "a"), ("System", "s"), ("human", None)], 0.5), (2, [], 0.2)]
    df = spark.createDataFrame(talks, "id int, m array<struct<role: string, content: string>>, heat double").withColumn("m", providers.as_roles(F.col("m")))
    got = {r.id: r.answer for r in providers.chat(df, "m", "heat", [lambda ts, heat: [f"{heat} {t}" for t in ts]]).collect()}
    assert got == {1: "0.5 [('assistant', 'a'), ('system', 's'), ('user', '')]", 2: "0.2 []"}
    assert {r.answer for r in providers.chat(df, "m", "heat", [lambda ts, heat: []]).collect()} != {""}
