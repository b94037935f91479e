"""Event streams of answers: tokens, their lines, and the state that a reader builds from them, in batch and as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from foliant.functions import answers as A
from foliant.session import key_of

EVENT = "type string, text string, confidence int, confidence_label string, content string, mode string, sources array<struct<text: string, page: int, doc_id: string, doc_name: string, relevance: double>>"


def tokens_of(answers: DataFrame, column: str) -> DataFrame:
    """(stream_id, seq, token): an answer as it is sent: parted at blanks, each part with a blank after it."""
    return answers.select("stream_id", F.posexplode(F.split(column, " ")).alias("seq", "t")).select("stream_id", "seq", F.concat("t", F.lit(" ")).alias("token"))


def events_of(answers: DataFrame, whole: bool = True) -> DataFrame:
    """(stream_id, seq, event): metadata, tokens, metadata with the whole content, done; ``answers``: stream_id, answer, confidence.

    Without ``whole`` the last metadata has no content, so that a reader has only the tokens.
    """
    event = lambda kind, **f: F.from_json(F.lit("{}"), EVENT).withField("type", F.lit(kind)) if not f else _with(F.from_json(F.lit("{}"), EVENT).withField("type", F.lit(kind)), f)
    label = A.level(F.coalesce("confidence", F.lit(0)))
    first = event("metadata", confidence=F.col("confidence"), confidence_label=label)
    parts = F.transform(F.split("answer", " "), lambda t: event("token", text=F.concat(t, F.lit(" "))))
    last = event("metadata", confidence=F.col("confidence"), confidence_label=label, **({"content": F.col("answer")} if whole else {}))
    return answers.select("stream_id", F.posexplode(F.concat(F.array(first), parts, F.array(last, event("done")))).alias("seq", "event"))


def _with(struct: Column, fields: dict[str, Column]) -> Column:
    for name, value in fields.items():
        struct = struct.withField(name, value)
    return struct


def folded(events: DataFrame) -> DataFrame:
    """(stream_id, content, confidence, confidence_label, tokens): what a reader ends with.

    Tokens are appended in the order of seq; metadata replaces confidence and label, and the content if it carries one. Only tokens after the last
    metadata with content count beyond it.
    """
    e = F.col("event")
    item = F.struct("seq", e["type"].alias("type"), e["text"].alias("text"), e["content"].alias("content"), e["confidence"].alias("confidence"), e["confidence_label"].alias("label"))
    lists = events.where(e["type"].isin("metadata", "token")).groupBy("stream_id").agg(F.array_sort(F.collect_list(item)).alias("es"))  # bounded by one answer
    start = F.expr("cast(named_struct('parts', array(), 'confidence', null, 'label', null) as struct<parts: array<string>, confidence: int, label: string>)")

    def step(s: Column, x: Column) -> Column:
        token = F.struct(F.concat(s["parts"], F.array(x["text"])).alias("parts"), s["confidence"].alias("confidence"), s["label"].alias("label"))
        parts = F.when(x["content"].isNotNull(), F.array(x["content"])).otherwise(s["parts"])
        return F.when(x["type"] == "token", token).otherwise(F.struct(parts.alias("parts"), x["confidence"].alias("confidence"), x["label"].alias("label")))

    out = lists.select("stream_id", F.aggregate("es", start, step).alias("s"), F.size(F.filter("es", lambda x: x["type"] == "token")).cast("long").alias("tokens"))
    return out.select("stream_id", F.array_join("s.parts", "").alias("content"), "s.confidence", F.col("s.label").alias("confidence_label"), "tokens")


def parsed_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Lines of an event stream as events: "data: " lines with a JSON object; [DONE], other and broken lines go. Works on streams too."""
    body = F.trim(F.expr(f"substring(trim({column}), 7)"))
    kept = lines.where(F.trim(column).startswith("data: ")).withColumn("_body", body).where("_body <> '[DONE]'")
    return kept.withColumn("event", F.from_json("_body", EVENT)).where("event.type is not null").drop("_body")


def deltas(lines: DataFrame, column: str = "value") -> DataFrame:
    """Pieces of text in the lines that a chat model's service sends."""
    body = F.trim(F.expr(f"substring(trim({column}), 7)"))
    kept = lines.where(F.trim(column).startswith("data: ")).withColumn("_body", body).where("_body <> '[DONE]'")
    piece = F.from_json("_body", "choices array<struct<delta: struct<content: string>>>")["choices"][0]["delta"]["content"]
    return kept.withColumn("text", piece).where("text is not null and text <> ''").drop("_body")


_OUT = "stream_id string, content string, confidence int, confidence_label string, done boolean"
_STATE = "rest string, content string, confidence int, confidence_label string, next long, early string"


def _fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The state of one stream after more of its network pieces; a line that is not whole is kept for the next piece, a piece that is early for its turn."""
    import json

    rest, content, confidence, label, following, early = state.get if state.exists else ("", "", None, None, 0, "{}")
    waiting = {int(k): v for k, v in json.loads(early).items()}
    for pdf in parts:
        waiting.update((int(s), p or "") for s, p in zip(pdf["seq"], pdf["piece"]) if int(s) >= following)
    done = bool(state.hasTimedOut)
    while following in waiting:
        *whole, rest = (rest + waiting.pop(following)).split("\n")
        following += 1
        for line in whole:
            body = line.strip()[6:].strip() if line.strip().startswith("data: ") else ""
            if body == "[DONE]":
                done = True
                continue
            try:
                event = json.loads(body) if body else {}
            except ValueError:
                continue
            if not isinstance(event, dict):
                continue
            if event.get("type") == "token":
                content += event.get("text") or ""
            elif event.get("type") == "metadata":
                confidence, label = event.get("confidence"), event.get("confidence_label")
                content = event.get("content", content) if event.get("content") is not None else content
            done |= event.get("type") == "done"
    if done:
        state.remove()
    else:
        state.update((rest, content, confidence, label, following, json.dumps(waiting)))
        state.setTimeoutDuration(3_600_000)
    yield pd.DataFrame([(str(key[0]), content, confidence, label, done)], columns=["stream_id", "content", "confidence", "confidence_label", "done"]).astype({"confidence": "Int32"})


def live_messages(pieces: DataFrame) -> DataFrame:
    """The message that each stream has built so far, after each trigger; ``pieces``: stream_id, seq, piece of a stream of network pieces.

    Lines may be cut anywhere and pieces may come out of order. The state of a stream goes when it is done or silent for an hour.
    """
    return pieces.groupBy("stream_id").applyInPandasWithState(_fold, _OUT, _STATE, "update", GroupStateTimeout.ProcessingTimeTimeout)


def history_rows(turns: DataFrame) -> DataFrame:
    """The two rows that a finished turn leaves in the history: the user's, then the assistant's, under the first document asked for or global."""
    doc = F.coalesce(key_of(F.get("doc_ids", F.lit(0))), F.lit("global"))
    rows = F.array(F.struct(F.lit(0).alias("seq"), F.lit("user").alias("role"), F.col("question").alias("content"), F.lit(0).alias("confidence")), F.struct(F.lit(1).alias("seq"), F.lit("assistant").alias("role"), F.col("answer").alias("content"), F.coalesce("confidence", F.lit(0)).alias("confidence")))
    return turns.select("turn_id", "user_id", doc.alias("doc_id"), F.inline(rows))
