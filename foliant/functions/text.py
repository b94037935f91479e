"""Text expressions: words, terms, headers, snippets. All are column expressions that stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# English words that carry no meaning for keyword search, and what is left of contractions.
STOP_WORDS = (
    "the a an and or but in on at to for of with by about against between into through during before after above below from "
    "up down out off over under again further then once here there when where why how all any both each few more most other some such "
    "no nor not only own same so than too very s t can will just don should now "
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself "
    "they them their theirs themselves what which who whom this that these those am is are was were be been being "
    "have has had having do does did doing would could"
).split()

# ASCII punctuation as a class, and the parts of a word in mixed case.
PUNCTUATION = "[!-/:-@\\[-`{-~]"
WORD_PARTS = "[A-Z]+(?=[A-Z][a-z]|\\b)|[A-Z]?[a-z]+|[0-9]+"

SPACE_ENDS = "(?U)^\\s+|\\s+\\z"


def strip(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(text, SPACE_ENDS, "")


def words(text: Column) -> Column:
    """The runs of non-space; an empty array for blank text, null for null."""
    return F.filter(F.split(text, "(?U)\\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.size(words(F.coalesce(text, F.lit("")))), F.lit(0))


def reading_minutes(count: Column, per_minute: int = 200) -> Column:
    """At least one; halves go to the even minute."""
    return F.greatest(F.lit(1), F.bround(count / per_minute).cast("int"))


def terms(text: Column, stop_words: list[str] | tuple[str, ...] = STOP_WORDS) -> Column:
    """Search terms in order: punctuation around words goes, mixed case and digits part them, lower case, no stop words. Null gives none."""
    bare = F.filter(F.transform(words(F.coalesce(text, F.lit(""))), lambda w: F.regexp_replace(w, f"^{PUNCTUATION}+|{PUNCTUATION}+$", "")), lambda w: w != "")
    parted = F.transform(bare, lambda w: F.struct(w.alias("w"), F.regexp_extract_all(w, F.lit(WORD_PARTS), F.lit(0)).alias("p")))
    lowered = F.flatten(F.transform(parted, lambda x: F.when(F.size(x["p"]) > 0, F.transform(x["p"], F.lower)).otherwise(F.array(F.lower(x["w"])))))
    return F.filter(lowered, lambda t: ~t.isin(*stop_words)) if stop_words else lowered


def header_segments(text: Column, low: int = 3, high: int = 39) -> Column:
    """Segments of lines, parted by | < or >, that are all upper case and of ``low`` to ``high`` characters."""
    parts = F.transform(F.split(text, "[\n|<>]"), strip)
    return F.filter(parts, lambda p: (F.length(p) >= low) & (F.length(p) <= high) & (F.upper(p) == p) & (F.lower(p) != p))


def snippet(text: Column, n: int) -> Column:
    """The first ``n`` characters on one line."""
    return F.translate(F.substring(text, 1, n), "\n", " ")
