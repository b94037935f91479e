"""Splitting oversized items at natural boundaries by dynamic programming."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.session import key_of

LIMIT, OVERLAP = 400, 50
#: What a cut costs: after a paragraph, a line, a sentence, at white space, and where there is no boundary.
PARAGRAPH, LINE, SENTENCE, SPACE, FORCED = 0.0, 0.15, 0.2, 1.0, 1000.0
#: What a piece costs that is empty or at the limit where the text allows equal ones, and an overlap that is lost.
IMBALANCE, LOST_OVERLAP = 1.0, 2.0
#: Ends whose pieces are weighed at once.
BAND = 512

_SPACES, _ENDS = re.compile(r"\s+"), re.compile("[.!?。！？]")


def boundaries(text: str, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """(places, costs): where the text may be cut. Stretches of more than ``limit`` characters without boundary get forced places."""
    n = len(text)
    cost: dict[int, float] = {}
    for m in _ENDS.finditer(text):
        cost[m.end()] = SENTENCE if m.end() == n or text[m.end()].isspace() or m.group() in "。！？" else SPACE
    for m in _SPACES.finditer(text):
        run, a, b = m.group(), m.start(), m.end()
        lines = run.count("\n")
        kind = PARAGRAPH if lines > 1 else LINE if lines else SPACE
        sentence = a > 0 and text[a - 1] in ".!?。！？"
        for p in range(a, b + 1):
            cost[p] = min(cost.get(p, FORCED), kind, SENTENCE if sentence else FORCED)
    cost[0] = cost[n] = 0.0
    places = np.array(sorted(cost), np.int64)
    for i in np.flatnonzero(np.diff(places) > limit):
        for p in range(int(places[i]) + 1, int(places[i + 1])):
            cost[p] = FORCED
    places = np.array(sorted(cost), np.int64)
    return places, np.array([cost[p] for p in places.tolist()])


def cuts(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> tuple[list[int], bool]:
    """(ends, forced): the ends of the pieces at least total cost, and whether one of them is no natural boundary."""
    n = len(text)
    if n <= limit:
        return [n], False
    step = limit - overlap
    ideal = (n - overlap) / -(-(n - overlap) // step)
    places, costs = boundaries(text, limit)
    best, back = np.full(len(places), np.inf), np.zeros(len(places), np.int64)
    best[0] = 0.0
    first = np.searchsorted(places, places - limit)
    room = np.append(np.diff(places) <= step, False)  # the next boundary leaves room for the whole overlap, so none is lost after this one
    forced_at = costs >= FORCED
    wide = int((np.arange(len(places)) - first).max())
    for at in range(1, len(places), BAND):
        # what a piece between two places costs, for a band of ends and all the places that may begin them
        j = np.arange(at, min(at + BAND, len(places)))
        i = first[j][:, None] + np.arange(wide)
        inside = i < j[:, None]
        i = np.minimum(i, len(places) - 1)
        gap = places[j][:, None] - places[i]
        piece = IMBALANCE * ((gap - ideal) / ideal) ** 2
        late = (gap > step) & (first[j] > 0)[:, None]  # the first piece has no overlap to lose
        if overlap:
            piece = piece + np.where(late, LOST_OVERLAP * (gap - step) / overlap, 0.0)
        piece[~inside | (late & (forced_at[j][:, None] | forced_at[i] | (room[i] if overlap else False)))] = np.inf
        for row, (end, low) in enumerate(zip(j.tolist(), first[j].tolist())):
            total = best[low : low + wide] + piece[row, : len(best) - low]
            k = int(total.argmin())
            best[end], back[end] = total[k] + costs[end], low + k
    ends, j = [], len(places) - 1
    forced = False
    while j:
        ends.append(int(places[j]))
        forced |= bool(costs[j] >= FORCED)
        j = int(back[j])
    return ends[::-1], forced


def pieces_of(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> tuple[list[tuple[int, int]], bool]:
    """([start, end) of each piece, forced). Pieces cover the text, hold at most ``limit`` characters and share ``overlap`` with the one before.

    Where a stretch between two natural boundaries leaves no room for the whole overlap, the overlap gives way, not the boundary;
    a piece with a forced end always has the whole overlap.
    """
    ends, forced = cuts(text, limit, overlap)
    starts = [0, *(max(a - overlap, b - limit, 0) for a, b in zip(ends, ends[1:]))]
    return list(zip(starts, ends)), forced


_SCHEMA = "doc_id string, chunk_index int, doc_name string, page int, kind string, piece_no int, start int, end int, text string"


def split_chunks(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, whole: bool = False) -> DataFrame:
    """(doc_id, chunk_index, doc_name, page, kind, piece_no, start, end, text): the pieces of every chunk of more than ``limit`` characters.

    ``kind`` is that of the chunk: forced if a stretch of more than ``limit`` characters has no boundary in it, else natural.
    Null and short texts give no rows, repeated rows count once, null places stay null. Only oversized texts reach Python.
    With ``whole`` each piece brings the text that it was cut from.
    """
    schema = _SCHEMA + (", whole string" if whole else "")
    m = F.col("metadata")
    rows = chunks.where(F.length("text") > limit).select(key_of(m["doc_id"]).alias("doc_id"), m["chunk_index"].alias("chunk_index"), m["doc_name"].alias("doc_name"), m["page"].alias("page"), "text").distinct()
    # the few oversized texts are much work each: they are spread anew, over all tasks of a shuffle
    rows = rows.repartition(int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def split(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for r in pdf.itertuples(index=False):
                spans, forced = pieces_of(r.text, limit, overlap)
                out += [(r.doc_id, r.chunk_index, r.doc_name, r.page, "forced" if forced else "natural", i, a, b, r.text[a:b], *([r.text] if whole else [])) for i, (a, b) in enumerate(spans)]
            table = pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])
            yield table.astype({"chunk_index": "Int32", "page": "Int32"})

    return rows.mapInPandas(split, schema)


def piece_properties(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, chunk_index, length, within_limit, covers, in_place, overlaps): per oversized text, whether its pieces keep to the limit, cover the text, are where
    they say, and each shares ``overlap`` with the one before or, where no boundary left room for that, fills the limit. Each text counts once per place."""
    at = F.struct("piece_no", "start", "end", F.length("text").alias("n"), F.xxhash64("text").alias("h"))
    per = split_chunks(chunks, limit, overlap, whole=True).withColumnRenamed("whole", "of").groupBy("doc_id", "chunk_index", "of").agg(F.array_sort(F.collect_list(at)).alias("ps"))
    before = lambda i: F.get("ps", i - 1)
    shares = F.forall(F.transform("ps", lambda p, i: (i == 0) | (before(i)["end"] - p["start"] == overlap) | (p["n"] == limit) | (p["start"] == 0)), lambda x: x)
    joined = F.forall(F.transform("ps", lambda p, i: F.when(i == 0, p["start"] == 0).otherwise((p["start"] <= before(i)["end"]) & (p["end"] > before(i)["end"]))), lambda x: x)
    return per.select(
        "doc_id", "chunk_index", F.length("of").alias("length"), F.forall("ps", lambda p: (p["n"] <= limit) & (p["n"] > 0)).alias("within_limit"), (joined & (F.element_at("ps", -1)["end"] == F.length("of"))).alias("covers"),
        F.forall("ps", lambda p: (p["end"] - p["start"] == p["n"]) & (F.xxhash64(F.substring("of", p["start"] + 1, p["n"])) == p["h"])).alias("in_place"), shares.alias("overlaps"),
    )


def oversized(chunks: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(doc_id, chunk_index, kind): the chunks that are split, and how; equal places with several texts give each kind once."""
    return split_chunks(chunks, limit).where("piece_no = 0").select("doc_id", "chunk_index", "kind").distinct()
