import json
import random

from pyspark.sql import functions as F

from foliant.streaming import events as V

ANSWERS = [("a", "One two  three.", 81), ("b", "", 10), ("c", "é 文 \n x", None)]


def answers(spark):
    return spark.createDataFrame(ANSWERS, "stream_id string, answer string, confidence int")


def test_tokens_and_fold(spark):
    got = V.tokens_of(answers(spark), "answer").orderBy("stream_id", "seq").collect()
    assert [r.token for r in got if r.stream_id == "a"] == ["One ", "two ", " ", "three. "]
    ev = V.events_of(answers(spark))
    assert {r.stream_id: (r.content, r.confidence) for r in V.folded(ev).collect()} == {s: (t, c) for s, t, c in ANSWERS}
    early = V.folded(ev.where("not (event.type = 'metadata' and event.content is not null)").where("event.type <> 'done'"))
    assert {r.stream_id: r.content for r in early.collect()}["a"] == "One two  three. "


def test_lines(spark):
    lines = ['data: {"type": "token", "text": "x"}', "data: [DONE]", ": ping", "data: {broken", ' data: {"type": "done"} ', 'data: {"choices": [{"delta": {"content": "hey"}}]}', ""]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    assert sorted(r.event.type for r in V.parsed_lines(df).collect()) == ["done", "token"]
    assert [r.text for r in V.deltas(df).collect()] == ["hey"]


def test_live_messages_equal_the_batch_result(spark, tmp_path):
    """Lines cut anywhere, pieces out of order and spread over files."""
    rng = random.Random(2)
    rows = []
    for stream, text, conf in ANSWERS:
        sent = [{"type": "metadata", "confidence": conf, "confidence_label": "x"}, *({"type": "token", "text": t + " "} for t in text.split(" ")), {"type": "metadata", "confidence": conf, "confidence_label": "y", "content": text}]
        wire = "".join(f"data: {json.dumps(e)}\n\n" for e in sent)
        cuts = sorted(rng.sample(range(1, len(wire)), 9))
        rows += [(stream, i, wire[a:b]) for i, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(wire)]))]
    rng.shuffle(rows)
    schema = "stream_id string, seq long, piece string"
    for i in range(3):
        spark.createDataFrame(rows[i::3], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # timeouts alone would keep a bounded run going
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = V.live_messages(stream).writeStream.outputMode("update").format("memory").queryName("live").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    last = spark.table("live").groupBy("stream_id").agg(F.max_by("content", F.length("content")).alias("content"), F.max_by("confidence_label", F.col("confidence_label").isNotNull()).alias("label"))
    got = {r.stream_id: r.content.rstrip(" ") for r in last.collect()}
    assert got == {s: t.rstrip(" ") for s, t, _ in ANSWERS}


def test_history_rows(spark):
    turns = spark.createDataFrame([(1, "u", [" D1", "d2"], "q", "a", 7), (2, "u", [], "q", "a", None), (3, "u", None, "q", None, None)], "turn_id int, user_id string, doc_ids array<string>, question string, answer string, confidence int")
    got = sorted((r.turn_id, r.seq, r.doc_id, r.role, r.confidence) for r in V.history_rows(turns).collect())
    assert got == [(1, 0, "d1", "user", 0), (1, 1, "d1", "assistant", 7), (2, 0, "global", "user", 0), (2, 1, "global", "assistant", 0), (3, 0, "global", "user", 0), (3, 1, "global", "assistant", 0)]
