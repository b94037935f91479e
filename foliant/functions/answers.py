"""Expressions on questions and answers: intent, citations, confidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.functions.text import strip

# Small talk, as whole messages.
GREETINGS = [
    "hi", "hello", "hey", "hola", "greetings", "good morning", "good afternoon", "good evening",
    "how are you", "how is it going", "how's it going", "what's up", "yo", "sup", "howdy",
    "who are you", "what are you", "your name", "what is your name", "who built you",
    "thank you", "thanks", "bye", "goodbye", "help", "what can you do", "hi there", "hello there", "hey there",
    "ok", "okay", "got it", "i see", "understood", "okay thanks", "thanks a lot", "thank you so much",
    "never mind", "nevermind", "no thanks", "no thank you", "fine", "cool", "great", "awesome",
    "not there", "it is not there", "it's not there", "is it in the document", "is this in the document",
    "not in the doc", "it is not in the doc", "it's not in the doc", "out of the doc", "that is out of scope", "this is out of scope",
]
# Small talk of one word.
SINGLE_WORDS = ["hi", "hello", "hey", "hola", "yo", "howdy", "thanks", "help", "ok", "okay", "fine", "cool", "great", "understood", "awesome", "yes", "no"]
# Phrases that make a message small talk wherever they stand.
OUTSIDE_PHRASES = [
    "out of the document", "not in the document", "out of document", "not in document", "not there in the document",
    "not present in the document", "not present in the documents",
]
# Single words too vague to answer.
VAGUE = ["v", "india", "roles", "salary", "home"]
# Phrases of an answer that found nothing.
NOTHING_FOUND = [
    "cannot find that information", "cannot find this information", "not find that information", "not find this information",
    "not present in the uploaded documents", "not mentioned in the provided", "information is not in the", "not found in the uploaded",
    "do not contain information", "does not contain information", "no information about", "unable to find", "cannot find information",
    "not found in the provided", "not mention this", "not mention that",
]
# Results and temperature of each mode; others are as the last entry.
MODES = {"qa": (3, 0.2), "summary": (5, 0.3), "deep": (9, 0.5), "eli5": (5, 0.6), None: (5, 0.2)}


def _any_contained(text: Column, phrases: list[str]) -> Column:
    return F.lit(False) if not phrases else text.rlike("|".join(f"\\Q{p}\\E" for p in phrases))


def is_small_talk(question: Column) -> Column:
    """A greeting, thanks, acknowledgement or remark on the document's limits; blank and null questions too."""
    q = F.translate(F.lower(strip(F.coalesce(question, F.lit("")))), "?!.,", "")
    return (strip(q) == "") | q.isin(*GREETINGS) | strip(q).isin(*SINGLE_WORDS) | _any_contained(q, OUTSIDE_PHRASES)


def intent(question: Column) -> Column:
    """CONVERSATIONAL, AMBIGUOUS (two characters or less, or a vague word) or FACTUAL."""
    bare = F.btrim(F.lower(strip(question)), F.lit("?.! "))
    return F.when(is_small_talk(question), "CONVERSATIONAL").when((F.length(bare) <= 2) | bare.isin(*VAGUE), "AMBIGUOUS").otherwise("FACTUAL")


def normalised_note(question: Column, normalised: Column) -> Column:
    """A note for the answer's head if the question was corrected, else the empty string."""
    return F.when(F.lower(strip(question)) != F.lower(strip(normalised)), F.concat(F.lit("Assuming you meant: "), normalised, F.lit("\n\n"))).otherwise("")


def _of_mode(mode: Column, place: int) -> Column:
    out = F.lit(MODES[None][place])
    for name, values in MODES.items():
        if name:
            out = F.when(mode == name, values[place]).otherwise(out)
    return out


def mode_top_k(mode: Column) -> Column:
    return _of_mode(mode, 0)


def mode_temperature(mode: Column) -> Column:
    return _of_mode(mode, 1)


def candidate_count(top_k: Column) -> Column:
    return F.greatest(top_k * 3, F.lit(15))


def cited_indices(answer: Column) -> Column:
    """Indices in the first line of citations, in the order cited; entries that are not all digits are dropped."""
    listed = F.regexp_extract(answer, "(?i)Cited Source Indices:\\s*([\\d\\s,]+)", 1)
    entries = F.filter(F.transform(F.split(listed, ","), strip), lambda x: x.rlike("^[0-9]+\\z"))
    return F.transform(entries, lambda x: x.try_cast("int"))


def without_citations(answer: Column) -> Column:
    return strip(F.regexp_replace(answer, "(?id)\\n*Cited Source Indices:\\s*.*", ""))


def cited_sources(sources: Column, indices: Column) -> Column:
    """The sources cited, in that order, repeated ones kept; all sources if none of the indices names one."""
    valid = F.filter(indices, lambda i: (i >= 0) & (i < F.size(sources)))
    return F.when(F.size(valid) > 0, F.transform(valid, lambda i: F.get(sources, i))).otherwise(sources)


def found_nothing(answer: Column) -> Column:
    return _any_contained(F.lower(answer), NOTHING_FOUND)


def similarity(distance: Column) -> Column:
    """From a squared distance of unit vectors to 0..1."""
    return F.when(distance.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - distance / 2.0)))


def relevance(distance: Column) -> Column:
    return F.bround(similarity(distance) * 100, 1)


def confidence(mean_distance: Column) -> Column:
    """Whole per cent, cut off; nothing found gives 0. Noise below 1e-9 does not turn 80 into 79."""
    return F.coalesce(F.floor(F.round(similarity(mean_distance) * 100, 9)).cast("int"), F.lit(0))


def level(score: Column) -> Column:
    return F.when(score >= 80, "High").when(score >= 65, "Medium").otherwise("Low")


def match_label(score: Column) -> Column:
    return F.concat(level(score), F.lit(" Match"))


def level_colour(label: Column) -> Column:
    return F.when(label == "High", "success").when(label == "Medium", "warning").otherwise("error")


def meter_width(score: Column, label: Column) -> Column:
    """The width of a meter: the score, or a stand-in by label where it is 0 or null."""
    return F.coalesce(F.nullif(score, F.lit(0)), F.when(label == "High", 90).when(label == "Medium", 65).otherwise(35))


def context_block(index: Column, name: Column, page: Column, text: Column) -> Column:
    head = F.concat(F.lit("Source Index: "), index.cast("string"), F.lit("\nDocument: "), F.coalesce(name, F.lit("Unknown Document")), F.lit(" (Page "), F.coalesce(page, F.lit(1)).cast("string"))
    return F.concat(head, F.lit(")\nContent: "), text, F.lit("\n---"))
