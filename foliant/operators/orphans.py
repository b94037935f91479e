"""References to records that do not exist: orphan rows and their counts per table and period."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.session import cut_lineage, key_of, utc

#: A key is heavy when more than one reference in HEAVY_SHARE points to it, so there are fewer than HEAVY_SHARE heavy keys
#: at any size of the tables: that is the proven bound of everything broadcast here.
HEAVY_SHARE = 1000


@dataclass(frozen=True)
class Reference:
    """Rows of ``child`` refer through ``ref`` to ``parent``; ``no_parent`` lists keys that have no parent by design."""

    table_name: str
    child: DataFrame
    row_id: str
    ref: str
    parent: str
    no_parent: tuple[str, ...] = ()


def references(refs: list[Reference]) -> DataFrame:
    """(table_name, parent, row_id, key, loaded_at): one row per row_id, by its earliest loaded_at, with a reference."""
    out: DataFrame | None = None
    for r in refs:
        rows = r.child.select(key_of(r.row_id).alias("row_id"), key_of(r.ref).alias("key"), F.col("loaded_at"))
        # a reference that is the row_id itself needs no ordered pick: hash aggregation suffices
        if r.row_id == r.ref:
            once = rows.groupBy("row_id").agg(F.min("loaded_at").alias("loaded_at")).withColumn("key", F.col("row_id"))
        else:
            order = F.struct(F.col("loaded_at").isNull(), F.col("loaded_at"), F.col("key"))
            once = rows.groupBy("row_id").agg(F.min_by(F.struct("key", "loaded_at"), order).alias("r")).select("row_id", "r.key", "r.loaded_at")
        once = once.where(F.col("key").isNotNull() & ~F.col("key").isin(*r.no_parent) if r.no_parent else F.col("key").isNotNull())
        once = once.select(F.lit(r.table_name).alias("table_name"), F.lit(r.parent).alias("parent"), "row_id", "key", "loaded_at")
        out = once if out is None else out.unionByName(once)
    assert out is not None, "at least one reference is needed"
    return out


def parents_of(tables: dict[str, tuple[DataFrame, str]], deletions: DataFrame) -> DataFrame:
    """(parent, key, first_loaded, present, deleted): one row per key that a parent table or the log of deletions holds."""
    out: DataFrame | None = None
    for name, (df, key) in tables.items():
        rows = df.select(F.lit(name).alias("parent"), key_of(key).alias("key"), F.col("loaded_at").alias("first_loaded"), F.lit(True).alias("present"))
        out = rows if out is None else out.unionByName(rows)
    assert out is not None, "at least one parent table is needed"
    log = deletions.select(
        F.lower(F.trim("table_name")).alias("parent"), key_of("record_key").alias("key"), F.lit(None).cast("timestamp").alias("first_loaded"), F.lit(False).alias("present")
    )
    return (
        out.unionByName(log)
        .where(F.col("key").isNotNull())
        .groupBy("parent", "key")
        .agg(F.min("first_loaded").alias("first_loaded"), F.max("present").alias("present"), F.max(~F.col("present")).alias("deleted"))
    )


def _period(at: Column) -> Column:
    return F.date_format(utc(at), "yyyy-MM")


def orphans(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """Orphan rows as (table_name, row_id, reason, period).

    ``refs`` as from :func:`references`, ``parents`` as from :func:`parents_of`. References are counted per key and period
    first. The few keys that draw more than a thousandth of them are looked up by a broadcast of those keys, the rest by
    a shuffled join on pre-aggregated keys; only keys that can make an orphan go back to the rows, again split into heavy
    (broadcast) and light (shuffled), and both results are united. No rows, no parents or no deletions are no error.
    A null loaded_at is never late; its period is null. A null or blank reference is none.
    """
    refs = cut_lineage(refs)  # counted, and then read again for the rows of heavy and of light keys
    per_period = refs.groupBy("parent", "key", _period(F.col("loaded_at")).alias("period")).agg(F.count("*").alias("n"), F.min("loaded_at").alias("first_ref"))
    per_key = per_period.groupBy("parent", "key").agg(F.sum("n").alias("n"), F.min("first_ref").alias("first_ref"))
    total = per_key.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).scalar()
    marked = per_key.withColumn("heavy", F.col("n") * HEAVY_SHARE > total)

    heavy = marked.where("heavy")
    few_parents = parents.join(F.broadcast(heavy.select("parent", "key")), ["parent", "key"], "left_semi")  # at most as many rows as heavy keys
    looked_up = heavy.join(F.broadcast(few_parents), ["parent", "key"], "left").unionByName(marked.where(~F.col("heavy")).join(parents, ["parent", "key"], "left"))
    present = F.coalesce(F.col("present"), F.lit(False))
    suspects = looked_up.where(~present | (F.col("first_loaded") > F.col("first_ref"))).select(
        "parent", "key", "heavy", present.alias("present"), "first_loaded", F.coalesce(F.col("deleted"), F.lit(False)).alias("deleted")
    )

    hot, cold = suspects.where("heavy").drop("heavy"), suspects.where(~F.col("heavy")).drop("heavy")
    # rows of hot keys meet them by broadcast; the others are shuffled without those rows, so that no key makes one task long
    hot_keys = F.broadcast(heavy.select("parent", "key"))
    found = refs.join(F.broadcast(hot), ["parent", "key"]).unionByName(refs.join(hot_keys, ["parent", "key"], "left_anti").join(cold, ["parent", "key"]))
    reason = F.when(F.col("present"), F.when(F.col("first_loaded") > F.col("loaded_at"), "late")).when(F.col("deleted"), "deleted").otherwise("missing")
    return found.select("table_name", "row_id", reason.alias("reason"), _period(F.col("loaded_at")).alias("period")).where(F.col("reason").isNotNull())


def orphan_report(found: DataFrame) -> DataFrame:
    """Orphans counted per table, reason and period."""
    return found.groupBy("table_name", "reason", "period").agg(F.count("*").alias("orphans"))
