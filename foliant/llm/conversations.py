"""Rebuilding ordered conversations from message rows, and the reasons for which some are dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.times import DAY, time_micros
from foliant.llm.components import components
from foliant.operators.skew import join_unique
from foliant.session import BLANKS, cut_lineage, key_of

#: Roles as stored, ignoring case and blanks around them.
USER_ROLES, ASSISTANT_ROLES, SYSTEM_ROLES = ("user", "human"), ("assistant", "ai", "bot"), ("system",)
USER, ASSISTANT, SYSTEM, UNKNOWN = 0, 1, 2, 3

#: A character that can be seen: no white space, control or format character, filler or variation selector.
VISIBLE = "[^\\s\\p{Z}\\p{Cc}\\p{Cf}\\u2800\\u3164\\u115f\\u1160\\uffa0\\u034f\\ufe0e\\ufe0f]"


def has_text(text: Column) -> Column:
    return F.coalesce(text.rlike(VISIBLE), F.lit(False))


def role_kind(role: Column) -> Column:
    bare = F.lower(F.btrim(role, F.lit(BLANKS)))
    return F.when(bare.isin(*USER_ROLES), USER).when(bare.isin(*ASSISTANT_ROLES), ASSISTANT).when(bare.isin(*SYSTEM_ROLES), SYSTEM).otherwise(UNKNOWN)


def _rows(rows: DataFrame) -> DataFrame:
    """The columns that matter, keys in their one spelling, null unless a row has both, ``key`` (128 bits for the two), and ``tie``, which settles equal times of loading."""
    user, doc = key_of("user_id"), key_of("doc_id")
    keyed = user.isNotNull() & doc.isNotNull()
    base = rows.select(
        F.coalesce(key_of("id"), F.concat(F.lit("\0"), F.hex(F.xxhash64("user_id", "doc_id", "role", "content", "timestamp")))).alias("id"),
        F.when(keyed, user).alias("user_id"), F.when(keyed, doc).alias("doc_id"), F.when(keyed, F.unhex(F.md5(F.concat_ws("\0", F.length(user), user, doc)))).alias("key"),
        role_kind(F.col("role")).alias("kind"), time_micros(F.col("timestamp")).alias("at"), has_text(F.col("content")).alias("text"), "content", "loaded_at",
    )
    return base.withColumn("tie", F.xxhash64("user_id", "doc_id", "kind", "at", "text"))


def messages(rows: DataFrame, links: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """One row per message id with its conversation, (conv, id, kind, at, text), and the conversations' names, (conv, user_id, doc_id).

    Messages are the nodes of a graph, numbered as they are written, so that no two are taken for one. Each is joined to the first of those that name
    the same user_id and doc_id, in whatever spelling, and to those that ``links`` (id, target: replies and quotes) join it to. The connected components,
    by alternating large-star and small-star joins, are the conversations, named by the least key in them. A component without a key has no name and counts as none.
    Of rows with the same id the one loaded last counts (equal ones: by a hash); rows without an id are told apart by content.
    """
    base = _rows(rows) if links is not None else _rows(rows).where("key is not null")
    once = base.groupBy("id").agg(F.max_by(F.struct("key", "kind", "at", "text"), F.struct("loaded_at", "tie")).alias("m")).select("id", "m.*")
    once = cut_lineage(once.withColumn("node", F.monotonically_increasing_id()))
    keyed = once.where("key is not null").select("key", "node")
    firsts = cut_lineage(keyed.groupBy("key").agg(F.min("node").alias("first"), F.count("*").alias("n")))
    total = firsts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).scalar()
    edges = join_unique(keyed, firsts, ["key"], "n", total, F.xxhash64("node")).select(F.col("node").alias("a"), F.col("first").alias("b"))
    if links is not None:
        pairs = links.select(key_of("id").alias("id"), key_of("target").alias("target")).where("id is not null and target is not null").distinct()
        hop = pairs.join(once.select("id", F.col("node").alias("a")), "id").join(once.select(F.col("id").alias("target"), F.col("node").alias("b")), "target")
        edges = edges.unionByName(hop.select("a", "b"))
    label = components(edges).withColumnRenamed("component", "conv")
    spelled = base.where("key is not null").groupBy("key").agg(F.first("user_id").alias("user_id"), F.first("doc_id").alias("doc_id"))
    held = firsts.select(F.col("first").alias("node"), "key").join(label, "node").join(spelled, "key")
    names = held.groupBy("conv").agg(F.min(F.struct("user_id", "doc_id")).alias("k")).select("conv", "k.*")
    return once.join(label, "node").select("conv", "id", "kind", "at", "text"), names


def reply_links(rows: DataFrame, minutes: int = 10) -> DataFrame:
    """(id, target): for each message that has only a user or only a document, the last message before it with a full key, of that user or in that
    document, at most ``minutes`` earlier: what it follows on. Of rows with the same id the one loaded last counts. Ties go to the greatest id; unreadable times link nothing.

    Messages meet by user or document and slot of time, so that a user with a third of all rows makes no task long.
    """
    slot = minutes * 60_000_000
    each = rows.select(key_of("id").alias("id"), "loaded_at", F.struct(key_of("user_id").alias("u"), key_of("doc_id").alias("d"), time_micros(F.col("timestamp")).alias("at")).alias("r"))
    base = each.where("id is not null").groupBy("id").agg(F.max_by("r", F.struct("loaded_at", F.xxhash64("r"))).alias("r")).select("id", "r.*").where("at is not null")
    named = lambda u, d: F.array_compact(F.array(F.concat(F.lit("u"), u), F.concat(F.lit("d"), d)))
    lone = base.where("(u is null) <> (d is null)").select("id", "at", F.explode(named(F.col("u"), F.col("d"))).alias("part"))
    asked = lone.select("id", "at", "part", F.explode(F.array(F.floor(F.col("at") / slot), F.floor(F.col("at") / slot) - 1)).alias("slot"))
    held = base.where("u is not null and d is not null").select(F.col("id").alias("target"), F.col("at").alias("then"), F.explode(named(F.col("u"), F.col("d"))).alias("part"), F.floor(F.col("at") / slot).alias("slot"))
    met = asked.join(held, ["part", "slot"]).where(f"target <> id and then <= at and then >= at - {slot}")
    return met.groupBy("id").agg(F.max(F.struct("then", "target"))["target"].alias("target"))


def judged(msgs: DataFrame) -> DataFrame:
    """(conv, reason): every conversation with the first reason to drop it, or null.

    Only neighbours in the order of time, then user before assistant, matter. Messages of one instant are aggregated first; instants
    are compared with their neighbours within a day, and days by their first and last instant. So no window holds more than the
    instants of one day or the days of one conversation, however hot the conversation.
    """
    counts = lambda cond: F.count_if(cond)
    kind, text, at = F.col("kind"), F.col("text"), F.col("at")
    system = kind == SYSTEM
    instants = msgs.groupBy("conv", "at").agg(
        counts(kind == USER).alias("users"), counts(kind == ASSISTANT).alias("assistants"), counts((kind == ASSISTANT) & text).alias("replies"),
        counts(~system & text).alias("texts"), counts((kind == UNKNOWN) | (~system & at.isNull()) | ((kind == USER) & ~text)).alias("bad"),
    )
    users, assistants, replies = F.col("users"), F.col("assistants"), F.col("replies")
    spoken = (users + assistants) > 0
    part = instants.withColumn("day", F.floor(at / DAY)).select(
        "*", F.when(spoken, F.struct((assistants == 0).alias("open"))).alias("end"), F.when(spoken, F.struct((users == 0).alias("reply"), (replies > 0).alias("text"))).alias("start")
    )
    w = Window.partitionBy("conv", "day").orderBy("at")
    # system rows alone make an instant without start and end: it is passed over
    before, after = F.last("end", True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.first("start", True).over(w.rowsBetween(1, Window.unboundedFollowing))
    part = part.select("*", before.alias("before"), after.alias("after"))
    own_broken = (assistants > 1) | ((users == 0) & (assistants > 0) & F.coalesce(~F.col("before.open"), F.lit(False)))
    own_missing = (users > 1) | ((users > 0) & (assistants > 0) & (replies == 0)) | ((users > 0) & (assistants == 0) & F.coalesce(~(F.col("after.reply") & F.col("after.text")), F.lit(False)))
    days = part.groupBy("conv", "day").agg(
        F.sum("texts").alias("texts"), F.sum("bad").alias("bad"), F.max(own_broken).alias("broken"), F.max(own_missing).alias("missing"),
        F.min_by("start", F.when(F.col("start").isNotNull(), at)).alias("start"), F.max_by("end", F.when(F.col("end").isNotNull(), at)).alias("end"),
    )
    d = Window.partitionBy("conv").orderBy(F.col("day").asc_nulls_first())
    before, after = F.last("end", True).over(d.rowsBetween(Window.unboundedPreceding, -1)), F.first("start", True).over(d.rowsBetween(1, Window.unboundedFollowing))
    days = days.select("*", before.alias("before"), after.alias("after"))
    edge_broken = F.coalesce(F.col("start.reply") & ~F.coalesce(F.col("before.open"), F.lit(False)), F.lit(False))
    edge_missing = F.coalesce(F.col("end.open") & ~F.coalesce(F.col("after.reply") & F.col("after.text"), F.lit(False)), F.lit(False))
    whole = days.groupBy("conv").agg(
        F.sum("texts").alias("texts"), F.max((F.col("bad") > 0) | F.col("broken") | edge_broken).alias("broken"), F.max(F.col("missing") | edge_missing).alias("missing")
    )
    reason = F.when(F.col("texts") == 0, "empty").when(F.col("broken"), "broken").when(F.col("missing"), "missing_reply")
    return whole.select("conv", reason.alias("reason"))


def dropped(rows: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """(user_id, doc_id, reason) of the conversations that are empty, broken or lack a reply, by the first of these that applies.

    Null and blank contents, invisible characters, null roles and times, repeated rows and ties count as the class docs say; empty input gives no rows.
    """
    msgs, names = messages(rows, links)
    return judged(msgs).where("reason is not null").join(names, "conv").select("user_id", "doc_id", "reason")


def conversations(rows: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """(user_id, doc_id, seq, id, role, content, at): the messages of each sound conversation in order, seq from 0.

    The place within a day and the number of messages on earlier days make up seq; ties in time go user first, then by id.
    """
    msgs, names = messages(rows, links)
    msgs = cut_lineage(msgs)
    verdicts = cut_lineage(judged(msgs).where("reason is null").join(names, "conv").select("conv", "user_id", "doc_id"))  # read twice
    spoken = msgs.where(F.col("kind").isin(USER, ASSISTANT)).withColumn("day", F.floor(F.col("at") / DAY))
    per_day = spoken.groupBy("conv", "day").agg(F.count("*").alias("n"))
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("conv").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    days = per_day.select("conv", "day", "n", earlier.alias("earlier")).join(verdicts, "conv")
    total = per_day.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).scalar()
    kept = join_unique(spoken, days, ["conv", "day"], "n", total, F.xxhash64("id"))
    place = F.row_number().over(Window.partitionBy("conv", "day").orderBy("at", "kind", "id")) - 1
    placed = kept.select("user_id", "doc_id", (F.col("earlier") + place).alias("seq"), "id", F.when(F.col("kind") == USER, "user").otherwise("assistant").alias("role"), F.timestamp_micros("at").alias("at"))
    # contents move once, by id, and only meet messages that have their place
    contents = _rows(rows).groupBy("id").agg(F.max_by("content", F.struct("loaded_at", "tie", F.xxhash64("content"))).alias("content"))
    return placed.join(contents, "id").select("user_id", "doc_id", "seq", "id", "role", "content", "at")
