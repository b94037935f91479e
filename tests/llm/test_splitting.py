import random
import re
from itertools import combinations

import pytest

from foliant.llm import splitting as S
from foliant.session import table


def stretch(text, limit):
    return any(len(x) > limit for x in re.findall(r"[^\s.!?。！？]*[.!?。！？]|[^\s.!?。！？]+", text))


def brute(text, limit, overlap):
    """The least cost over all choices of places."""
    places, costs = S.boundaries(text, limit)
    n, step = len(text), limit - overlap
    ideal = (n - overlap) / -(-(n - overlap) // step)
    best = float("inf")
    for k in range(len(places) - 1):
        for inner in combinations(range(1, len(places) - 1), k):
            ends = [0, *inner, len(places) - 1]
            gaps = [places[b] - places[a] for a, b in zip(ends, ends[1:])]
            if max(gaps) <= limit:
                cost = sum(costs[e] for e in ends[1:]) + sum(S.IMBALANCE * ((g - ideal) / ideal) ** 2 for g in gaps)
                first = S.boundaries(text, limit)[0]
                cost += sum(S.LOST_OVERLAP * max(g - step, 0) / overlap for g, e in zip(gaps, ends[1:]) if first[e] > limit)
                best = min(best, cost)
    return best


@pytest.mark.parametrize("seed", range(40))
def test_pieces(seed):
    rng = random.Random(seed)
    text = "".join(rng.choice(["word", " ", ". ", "\n", "\n\n", "長い文。", "x" * rng.randrange(1, 500), "é", "　"]) for _ in range(rng.randrange(5, 400)))
    spans, forced = S.pieces_of(text)
    assert spans[0][0] == 0 and spans[-1][1] == len(text) and all(0 < b - a <= S.LIMIT for a, b in spans)
    assert all(c <= b for (_, b), (c, _) in zip(spans, spans[1:]))
    assert all(b - c == S.OVERLAP or d - c == S.LIMIT or c == 0 for (_, b), (c, d) in zip(spans, spans[1:]))
    assert forced == stretch(text, S.LIMIT)


@pytest.mark.parametrize("seed", range(8))
def test_least_cost(seed):
    rng = random.Random(seed)
    text = "".join(rng.choice(["ab", "cde", "f"]) + rng.choice([" ", ". ", "\n"]) for _ in range(7))
    ends, _ = S.cuts(text, 12, 3)
    places, costs = map(list, S.boundaries(text, 12))
    ideal = (len(text) - 3) / -(-(len(text) - 3) // 9)
    gaps = [b - a for a, b in zip([0, *ends], ends)]
    cost = sum(costs[places.index(e)] for e in ends) + sum(S.IMBALANCE * ((g - ideal) / ideal) ** 2 + (S.LOST_OVERLAP * max(g - 9, 0) / 3 if e > 12 else 0) for g, e in zip(gaps, ends))
    assert cost == pytest.approx(brute(text, 12, 3))


@pytest.mark.parametrize("seed", range(12))
def test_overlap_gives_way_only_where_no_boundary_leaves_room(seed):
    rng = random.Random(seed)
    text = "".join("x" * rng.choice([3, 20, 60, 120, 200, 340, 355, 390]) + rng.choice([" ", ". ", "\n", "\n\n"]) for _ in range(30))
    places = S.boundaries(text)[0]
    spans, _ = S.pieces_of(text)
    for (_, a), (c, d) in zip(spans, spans[1:]):
        assert a - c >= min(a, S.OVERLAP) or not ((places > a) & (places <= a + S.LIMIT - S.OVERLAP)).any()


def test_exact_limits():
    assert S.pieces_of("x" * 400)[0] == [(0, 400)] and S.pieces_of("x" * 401)[1] and not S.pieces_of("x" * 400 + " " + "y" * 400)[1]
    assert S.pieces_of("x" * 400 + ".")[1] and not S.pieces_of("x" * 399 + "." + "y" * 400)[1]
    assert len(S.pieces_of("z" * 100_000)[0]) >= 280


def test_tables(spark):
    rows = [("A ", 0, "x " * 300), ("a", 0, "x " * 300), ("a", 1, "short"), ("a", 2, None), ("b", 0, "y" * 900), (None, None, "z" * 401), ("c", 0, "")]
    df = spark.createDataFrame([((d, None, None, i), t, "clash") for d, i, t in rows], "metadata struct<doc_id: string, doc_name: string, page: int, chunk_index: int>, text string, kind string")
    assert sorted(map(tuple, S.oversized(df).collect()), key=str) == sorted([("a", 0, "natural"), ("b", 0, "forced"), (None, None, "forced")], key=str)
    assert S.oversized(df.limit(0)).count() == 0
    whole = table(spark, "/root/testdata/sf0.01", "chunks")
    texts = {(r.metadata.doc_id.strip().lower(), r.metadata.chunk_index): r.text for r in whole.collect() if r.text and len(r.text) > 400}
    assert {tuple(r) for r in S.oversized(whole).collect()} == {(*k, "forced" if stretch(t, 400) else "natural") for k, t in texts.items()}
