"""The catalogue: owner-scoped documents, keyed upserts, cascading deletes, checks of references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import answers as A
from foliant.functions.times import DAY, time_micros
from foliant.operators.ordering import numbered
from foliant.session import key_of


def current(df: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The last version of each key, all columns of one row; equal versions are settled by content. Partial aggregation, no sort of a hot key."""
    row = F.struct(*[F.col(c) for c in df.columns if c not in keys])
    return df.groupBy(*keys).agg(F.max_by(row, F.struct(F.col(version), F.xxhash64(*[c for c in df.columns if c not in keys]))).alias("_r")).select(*keys, "_r.*").select(*df.columns)


def upsert(table: DataFrame, rows: DataFrame, keys: list[str], version: str = "version") -> DataFrame:
    """The table after replacing rows of the same keys by later versions and adding the others; new columns are kept, absent ones null."""
    return current(table.unionByName(rows, allowMissingColumns=True), keys, version)


def insert_absent(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose keys the table does not hold yet, one per key."""
    return rows.dropDuplicates(keys).join(table.select(*keys), keys, "left_anti")


def update_matched(table: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The table with ``columns`` replaced where a change gives a value; a null in a change leaves the old value."""
    new = changes.dropDuplicates([key]).select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    joined = table.join(new, key, "left")
    return joined.select(*[F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in table.columns])


def remove(table: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return table.join(gone.select(*keys).distinct(), keys, "left_anti")


def delete_documents(requests: DataFrame, documents: DataFrame, children: dict[str, DataFrame]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """(allowed, tables left) for requests (user_id, doc_id) to delete: only an owner's own documents go, with all rows that belong to them.

    The tables left are ``children``, by their doc_id, and ``documents``. Vectors of the allowed documents go by :func:`foliant.sources.vectors.delete`.
    """
    asked = requests.select(key_of("user_id").alias("user_id"), key_of("doc_id").alias("doc_id")).distinct()
    held = documents.select(key_of("id").alias("doc_id"), key_of("user_id").alias("user_id")).where("doc_id is not null and user_id is not null").distinct()
    allowed = asked.join(held, ["doc_id", "user_id"], "left_semi").select("doc_id").distinct()
    left = cascade(allowed, {name: child.withColumn("doc_id", key_of("doc_id")) for name, child in children.items()})
    return allowed, left | {"documents": documents.join(allowed.withColumnRenamed("doc_id", "_gone"), key_of("id") == F.col("_gone"), "left_anti")}


def cascade(gone: DataFrame, children: dict[str, DataFrame], key: str = "doc_id") -> dict[str, DataFrame]:
    """Each child table without the rows that belong to deleted documents."""
    return {name: remove(child, gone, [key]) for name, child in children.items()}


def remove_history(messages: DataFrame, user_id: str, doc_id: str) -> DataFrame:
    return messages.where(~(F.coalesce(F.col("user_id") == user_id, F.lit(False)) & F.coalesce(F.col("doc_id") == doc_id, F.lit(False))))


def owned(documents: DataFrame, user_id: str) -> DataFrame:
    return documents.where(key_of("user_id") == user_id.strip().lower())


def with_files(documents: DataFrame, files: DataFrame, key: str = "id") -> DataFrame:
    """Documents whose file exists."""
    return documents.join(files.select(key).distinct(), key, "left_semi")


def ownership_violations(requests: DataFrame, documents: DataFrame) -> DataFrame:
    """(request_id, doc_id): documents asked for that the asker does not own; ``requests``: request_id, user_id, doc_ids."""
    asked = requests.select("request_id", key_of("user_id").alias("user_id"), F.explode("doc_ids").alias("doc_id")).withColumn("doc_id", key_of("doc_id")).where("user_id is not null and doc_id is not null").distinct()
    held = documents.select(key_of("id").alias("doc_id"), key_of("user_id").alias("user_id"))
    return asked.join(held, ["doc_id", "user_id"], "left_anti").select("request_id", "doc_id")


def active_chats(messages: DataFrame) -> DataFrame:
    """(user_id, doc_id): the documents each user has talked about."""
    return messages.select(key_of("user_id").alias("user_id"), key_of("doc_id").alias("doc_id")).where("user_id is not null and doc_id is not null").distinct()


def ordered_messages(messages: DataFrame) -> DataFrame:
    """The messages of each user and document with their place, ``seq`` from 0: by time, then the user before others, then by id; unreadable times last.

    Of rows with the same id the one loaded last counts; rows without user, document or id go. Days are the blocks of the order, so that a conversation with a
    third of all rows is sorted in as many tasks as it has days.
    """
    keyed = messages.withColumns({k: key_of(k) for k in ("id", "user_id", "doc_id")}).where("id is not null and user_id is not null and doc_id is not null")
    rows = current(keyed, ["id"], "loaded_at").withColumns({"_at": time_micros(F.col("timestamp")), "_kind": F.when(F.lower(F.trim("role")).isin("user", "human"), 0).otherwise(1)})
    day = F.coalesce(F.floor(F.col("_at") / DAY), F.lit(1 << 40))
    return numbered(rows, ["user_id", "doc_id"], day, [F.col("_at").asc_nulls_last(), "_kind", "id"]).drop("_at", "_kind", "n").withColumnRenamed("place", "seq")


def append_messages(stored: DataFrame, rows: DataFrame) -> DataFrame:
    """New messages as rows to append: each with the ``seq`` that follows on the last one stored of its user and document. Ids that are stored already add nothing."""
    last = stored.groupBy("user_id", "doc_id").agg((F.max("seq") + 1).alias("_next"))
    fresh = ordered_messages(rows.withColumn("id", key_of("id")).join(stored.select("id"), "id", "left_anti"))
    return fresh.join(last, ["user_id", "doc_id"], "left").withColumn("seq", F.col("seq") + F.coalesce("_next", F.lit(0))).drop("_next")


def history(messages: DataFrame) -> DataFrame:
    """Messages as shown again, with any ``seq`` and keys that they have: sources decoded and counted, and the label that the stored confidence has."""
    source = "array<struct<text: string, page: int, doc_id: string, doc_name: string, relevance: double>>"
    decoded = F.from_json("sources", source)
    placed = [c for c in ("user_id", "doc_id", "seq") if c in messages.columns]
    return messages.select(*placed, "id", "role", "content", "confidence", decoded.alias("sources"), F.coalesce(F.size(decoded), F.lit(0)).alias("n_sources"), "timestamp", A.level(F.coalesce("confidence", F.lit(0))).alias("confidence_label"))


def named(child: DataFrame, documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of a child table with the name of their document; rows without one go."""
    names = documents.select(key_of("id").alias(key), F.col("name").alias("doc_name"))
    return child.withColumn(key, key_of(key)).join(names, key)


def placeholder(summary: Column, marks: tuple[str, ...] = ("Analyzing document content", "Please wait a moment")) -> Column:
    """Whether a summary is only a stand-in for one that is being made."""
    return F.exists(summary, lambda s: s.rlike("|".join(f"\\Q{m}\\E" for m in marks)))


def toggled(selected: Column, item: Column) -> Column:
    """A selection with an item taken out if it is in, else put in."""
    return F.when(F.array_contains(selected, item), F.array_except(selected, F.array(item))).otherwise(F.array_union(selected, F.array(item)))
