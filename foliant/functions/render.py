"""Expressions that shape results for readers: sizes, percentages, markdown lines, events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import strip

# Icon of each kind of alert; others are as insight.
ALERT_ICONS = {"warning": "⚠️", "date": "📅", "stat": "📈", "insight": "💡"}
UNITS = ("Bytes", "KB", "MB", "GB")


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5).cast("long")


def percent(part: Column, whole: Column) -> Column:
    """Whole per cent, halves up; null where there is no whole."""
    return half_up(part * 100.0 / F.nullif(whole.cast("double"), F.lit(0.0)))


def format_bytes(size: Column) -> Column:
    """A size in the largest fitting unit with at most two decimals; null for null and negative sizes."""
    power = F.least(F.when(size >= 1 << 30, 3).when(size >= 1 << 20, 2).when(size >= 1 << 10, 1).otherwise(0), F.lit(3))
    scaled = F.round(size.cast("double") / F.pow(F.lit(1024.0), power), 2)
    digits = F.regexp_replace(F.regexp_replace(scaled.cast("decimal(30,2)").cast("string"), "0+$", ""), "\\.$", "")
    return F.when(size == 0, "0 Bytes").when(size > 0, F.concat(digits, F.lit(" "), F.element_at(F.array(*map(F.lit, UNITS)), power + 1)))


def alert_icon(kind: Column) -> Column:
    out = F.lit(ALERT_ICONS["insight"])
    for name, icon in ALERT_ICONS.items():
        out = F.when(kind == name, icon).otherwise(out)
    return out


def markdown_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, kind, content, bold_parts, list_no): each line's kind; items in a row are one list, numbered from 0 within the text."""
    lines = df.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line")).withColumn("t", strip(F.col("line")))
    t = F.col("t")
    item = t.startswith("- ") | t.startswith("* ")
    kind = F.when(item, "item").when(F.col("line") == "", "blank").when(t.startswith("### "), "h3").when(t.startswith("## "), "h2").when(t.startswith("# "), "h1").otherwise("paragraph")
    content = F.when(F.col("kind") == "item", F.expr("substring(t, 3)")).when(F.col("kind").isin("h1", "h2", "h3"), F.expr("substring(t, cast(right(kind, 1) as int) + 2)")).otherwise(F.col("line"))
    lines = lines.withColumn("kind", kind).withColumn("content", content)
    w = Window.partitionBy(key).orderBy("line_no")  # bounded by the lines of one text
    starts = (F.col("kind") == "item") & (F.coalesce(F.lag("kind").over(w), F.lit("")) != "item")
    lines = lines.withColumn("list_no", F.when(F.col("kind") == "item", F.sum(starts.cast("int")).over(w) - 1))
    bold = F.floor(F.size(F.split("content", "\\*\\*")) / 2).cast("int")
    return lines.select(key, "line_no", "kind", "content", bold.alias("bold_parts"), "list_no")


def event_line(event: Column) -> Column:
    """A struct as one line of an event stream."""
    return F.concat(F.lit("data: "), F.to_json(event), F.lit("\n\n"))
