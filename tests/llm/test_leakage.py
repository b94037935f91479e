import random
from collections import defaultdict

import numpy as np
import pytest

from foliant.llm import leakage as L
from foliant.session import table

DIR = "/root/testdata/sf0.01"


def brute(docs, items, n=L.PHRASE):
    grams = defaultdict(set)
    for i, t in items:
        w = L.words_of(t)
        for j in range(len(w) - n + 1):
            grams[tuple(w[j : j + n])].add(i)
    return {(d, i) for d, t in docs for w in [L.words_of(t)] for j in range(len(w) - n + 1) for i in grams.get(tuple(w[j : j + n]), ())}


def test_whole_table(spark):
    docs, items = table(spark, DIR, "documents"), table(spark, DIR, "eval_items")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    got = [tuple(r) for r in L.leaked_documents(docs, items).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 20
    texts = {r.doc_id: r.text for r in docs.collect()}
    spans = L.removal_spans(docs, items).collect()
    assert {r.doc_id for r in spans} == {d for d, _ in want}
    for r in spans:
        assert len(L.words_of(texts[r.doc_id][r.start : r.end])) >= L.PHRASE


def test_case_accents_breaks_and_short_items(spark):
    item = "Élan one two three four five six seven eight nine ten eleven"
    docs = [
        (1, "x ELAN, one-two\nthree four five six seven eight NINE ten; eleven y"), (2, item.replace("five", "fi-ve")), (3, "Élan " + item[5:]), (4, item[5:]), (5, None), (6, ""),
        (7, " ".join([item] * 3)), (8, "z " * 50_000 + item), (1, "x ELAN, one-two\nthree four five six seven eight NINE ten; eleven y"),
    ]
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, item_id int")
    i = spark.createDataFrame([(9, item, "a"), (8, "too short", "a"), (7, None, "a"), (6, item, "a")], "item_id long, text string, doc_id string")
    assert {tuple(r) for r in L.leaked_documents(d, i).collect()} == {(k, n) for k in (1, 3, 7, 8) for n in (6, 9)}
    spans = {r.doc_id: r for r in L.removal_spans(d, i).collect()}
    assert spans[7].start == 0 and spans[7].end == 3 * len(item) + 2 and spans[7].items == [6, 9]
    assert L.leaked_documents(d.limit(0), i).count() == 0 and L.leaked_documents(d, i.limit(0)).count() == 0


@pytest.mark.parametrize("kinds,n", [(3, 400), (40, 3000)])
def test_index_against_plain_search(kinds, n):
    rng = random.Random(kinds)
    s = np.array([rng.randrange(1, kinds) for _ in range(n)] + [0])
    index = L.FMIndex(s, kinds)
    phrases = np.array([s[i : i + 3] if rng.random() < 0.7 else [rng.randrange(1, kinds) for _ in range(3)] for i in rng.sample(range(n - 3), 60)])
    low, high = index.search(phrases)
    for p, a, b in zip(phrases, low, high):
        want = [i for i in range(n - 2) if (s[i : i + 3] == p).all()]
        assert sorted(index.locate(np.arange(a, b))) == want if b > a else want == []


def test_many_items_are_searched_block_by_block_in_one_index(spark):
    """Blocks of 7 items against a few long documents; what a block finds does not depend on the others."""
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(400)}"
    items = [(i, " ".join(word() for _ in range(rng.randrange(5, 40)))) for i in range(60)]
    docs = [(d, " ".join([word() for _ in range(500)] + [items[rng.randrange(60)][1].upper() for _ in range(3)] + [word()])) for d in range(20)]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert {tuple(r) for r in L.leaks(d, i, shard_words=3000, item_block=7).select("doc_id", "item_id").collect()} == want and len(want) > 20
