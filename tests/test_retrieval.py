"""The ranking against a plain Python reading of its definition."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.functions.text import STOP_WORDS
from foliant.operators import answering, compare, retrieval
from foliant.plans import reference_queries
from tests.test_text import plain_terms

DIM = 8
WORDS = "model retrieval METHODS is a refers to the deposit annex Generative AI layer rota | SAFETY NOTES | means table".split(" ")


def data(seed, n_docs=6, n_chunks=7):
    rng = random.Random(seed)
    chunks = [(f"d{d}", f"Doc {d}", 1 + i // 3, i, " ".join(rng.choice(WORDS) for _ in range(rng.randrange(0, 25))) + rng.choice(["", "\n"])) for d in range(n_docs) for i in range(n_chunks)]
    vectors = {(c[0], c[3]): [rng.gauss(0, 1) for _ in range(DIM)] for c in chunks if rng.random() < 0.9}
    vectors = {k: [x / math.sqrt(sum(y * y for y in v)) for x in v] for k, v in vectors.items()}
    asked = ["What is Generative AI?", "describe the model", "annex methods deposit", "What are", "SAFETY notes table"]
    questions = [(i, q, 4, [x + rng.gauss(0, 0.2) for x in vectors[rng.choice(list(vectors))]]) for i, q in enumerate(asked)]
    return chunks, vectors, questions


def frames(spark, chunks, vectors, questions):
    c = spark.createDataFrame(chunks, "doc_id string, doc_name string, page int, chunk_index int, text string")
    v = spark.createDataFrame([(*k, e) for k, e in vectors.items()], "doc_id string, chunk_index int, embedding array<double>")
    return c, v, spark.createDataFrame(questions, "query_id int, question string, top_k int, vector array<double>")


def terms(text):
    return [t for t in plain_terms(text) if t not in STOP_WORDS]


def plain(chunks, vectors, question, top_k, vector):
    text_of = {(c[0], c[3]): c[4] for c in chunks}
    near = sorted((float(((np.array(vector) - np.array(e)) ** 2).sum()), *k) for k, e in vectors.items())[: max(15, 3 * top_k)]
    cands = [(d, k, text_of[k]) for d, *k in ((d, doc, i) for d, doc, i in near) for k in [tuple(k)]]
    bags = [terms(t) for _, _, t in cands]
    mean = sum(map(len, bags)) / len(bags) or 1.0
    words = terms(question)
    keyword = []
    for bag in bags:
        s = 0.0
        for w in words:
            tf, df = bag.count(w), sum(w in b for b in bags)
            s += math.log((len(bags) - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(bag) / mean)) if tf else 0
        keyword.append(s)
    q = question.lower().strip()
    prefix = next((p for p in retrieval.DEFINITION_PREFIXES if q.startswith(p)), None)
    subject = q[len(prefix) :].strip().strip("? .!").strip() if prefix else q
    content = [w for w in q.split() if len(w) > 3 and w not in retrieval.CONTENT_STOP]
    out = []
    for rank, ((d, k, t), s) in enumerate(zip(cands, keyword)):
        h = 0.6 * max(0, min(1, 1 - d / 2)) + 0.4 * (s / max(keyword) if max(keyword) else 0)
        if prefix and any(p in t.lower() for p in retrieval.DEFINITION_PATTERNS):
            h += 0.05
        if prefix and subject and re.search(re.escape(subject) + retrieval._BETWEEN + retrieval._VERBS, t, re.I):
            h += 0.45
        heads = [p.strip() for p in re.split(r"[\n|<>]", t)]
        if any(2 < len(p) < 40 and p.isupper() and any(w in p.lower() for w in content) for p in heads):
            h += 0.10
        out.append((-round(min(1, h), 9), rank, k, t))
    used, results = set(), []
    for h, _, k, t in sorted(out)[:top_k]:
        if -h < 0.5 or k in used:
            continue
        used.add(k)
        following = (k[0], k[1] + 1)
        if following in text_of:
            t += ("" if t.endswith("\n") else "\n") + text_of[following]
            used.add(following)
        results.append((*k, t, round(-h, 6)))
    return results


@pytest.mark.parametrize("seed", range(3))
def test_search_against_plain_reading(spark, seed):
    chunks, vectors, questions = data(seed)
    c, v, q = frames(spark, chunks, vectors, questions)
    got = {}
    for r in retrieval.search(q, v, c).orderBy("query_id", "place").collect():
        got.setdefault(r.query_id, []).append((r.doc_id, r.chunk_index, r.text, round(r.hybrid, 6)))
    want = {i: plain(chunks, vectors, *rest) for i, *rest in questions}
    assert got == {i: r for i, r in want.items() if r} and any(want.values())


def test_blocks_and_scopes_agree(spark):
    c, v, q = frames(spark, *data(9))
    key = lambda df: sorted((r.query_id, r.doc_id, r.chunk_index, r.vector_rank) for r in df.collect())
    every = [f"d{i}" for i in range(6)]
    scoped = q.withColumn("doc_ids", F.array(*map(F.lit, [*every, "d0", "none"])))
    assert key(retrieval.candidates(q, v)) == key(retrieval.candidates(q, v, block=2)) == key(retrieval.candidates_in_scope(scoped, v))
    assert retrieval.candidates(q.limit(0), v).count() == 0 and retrieval.candidates(q, v.limit(0)).count() == 0


def test_more_equally_near_vectors_than_a_batch_keeps(spark):
    """All but a few chunks have one embedding: the first by document and place win, wherever they lie in a batch."""
    keys = [(f"d{i // 20:02d}", i % 20) for i in range(600)]
    rows = [(d, i, [1.0, 0.0] if (d, i) != ("d29", 19) else [0.8, 0.6]) for d, i in reversed(keys)]
    v = spark.createDataFrame(rows, "doc_id string, chunk_index int, embedding array<double>")
    q = spark.createDataFrame([(0, "x", 4, [0.8, 0.6]), (1, "x", 4, [1.0, 0.0])], "query_id int, question string, top_k int, vector array<double>")
    got = {}
    for parts in (1, 7):
        for r in retrieval.candidates(q, v.coalesce(1).repartition(parts)).orderBy("query_id", "vector_rank").collect():
            got.setdefault((parts, r.query_id), []).append((r.doc_id, r.chunk_index))
    assert got == {(p, i): ([("d29", 19)] if i == 0 else []) + keys[: 14 if i == 0 else 15] for p in (1, 7) for i in (0, 1)}


SUBJECTS = {
    "Generative AI (GenAI) is a field": True, "generative ai, a subset of ML, refers to models": True, "Generative AI often is a field": True, "Generative AI in this area is a field": False, "Generative AIs is a field": False,
    "Generative AI referred to as é is a field": True,
}


def test_definition_and_header_boosts(spark):
    questions = [(0, "What is Generative AI?", 9, [1.0, 0.0])]
    texts = [*SUBJECTS, "this area", "AI | GENERATIVE MODELS | 3", "nothing here", "GENERATIVE", "AI?"]
    chunks = [(f"d{i}", "n", 1, 0, t) for i, t in enumerate(texts)]
    c, v, q = frames(spark, chunks, {(f"d{i}", 0): [1.0, 0.0] for i in range(len(texts))}, questions)
    got = {r.text: (r.pattern_boost, r.subject_boost, r.header_boost) for r in retrieval.scored(retrieval.candidates(q, v), q, c).collect()}
    assert {t: got[t][1] > 0 for t in SUBJECTS} == SUBJECTS
    assert got["this area"][0] > 0 and got["AI | GENERATIVE MODELS | 3"][2] > 0 and got["GENERATIVE"][2] > 0 and got["nothing here"] == (0.0, 0.0, 0.0) and got["AI?"][2] == 0
    loose = {r.text: r.subject_boost for r in retrieval.scored(retrieval.candidates(q, v), q, c, retrieval.VARIANT_B).collect()}
    assert loose["Generative AI in this area is a field"] == 0.25


def test_quoted_subjects_do_not_act_as_patterns(spark):
    chunks = [("d", "n", 1, 0, "a.c is a letter")]
    c, v, q = frames(spark, chunks, {("d", 0): [1.0]}, [(0, "what is a\\E.*c", 1, [1.0]), (1, "what is (", 1, [1.0]), (2, "what is a.c", 1, [1.0])])
    assert {r.query_id: r.subject_boost for r in retrieval.scored(retrieval.candidates(q, v), q, c).collect()} == {0: 0.0, 1: 0.0, 2: 0.45}


@pytest.mark.parametrize("n", [0, 1, 8, 9, 10, 19, 20, 95])
def test_samples(spark, n):
    chunks = spark.createDataFrame([("d", 1 + i // 2, i, f"t{i}") for i in range(n)], "doc_id string, page int, chunk_index int, text string")
    t = [f"t{i}" for i in range(n)]
    over = [r.text for r in compare.overview_sample(chunks).orderBy("place").collect()]
    assert over == (t if n <= 8 else [*t[:5], compare.GAP_MARK, *t[-3:]])
    assert [r.text for r in compare.spread_sample(chunks).orderBy("place").collect()] == t[:: max(1, n // 10)][:10]


def test_answers_from_end_to_end(spark):
    chunks, vectors, _ = data(1)
    c, v, _ = frames(spark, chunks, vectors, [(0, "", 1, [0.0])])
    near = vectors["d0", 0] if ("d0", 0) in vectors else next(iter(vectors.values()))
    rows = [(1, "What is the model?", "qa", None, near), (2, "hi", "qa", None, near), (3, "v", "deep", [], near), (4, "retrieval annex deposit", "summary", ["d0"], near), (5, "annex words", "qa", ["none"], near)]
    q = spark.createDataFrame(rows, "query_id int, question string, mode string, doc_ids array<string>, vector array<double>")
    got = {r.query_id: r for r in answering.answer(q, v, c).collect()}
    assert got[2].answer == answering.SMALL_TALK and got[2].confidence_label == "High" and got[3].intent == "AMBIGUOUS" and got[5].answer == answering.NOT_FOUND
    assert got[1].confidence > 0 and len(got[1].sources) == 1 and "Cited" not in got[1].answer
    def broken(*_):
        raise RuntimeError("down")
    failed = {r.query_id: r.answer for r in answering.answer(q, v, c, [broken]).collect()}
    assert failed[1] == "Error: down"
    assert {r.query_id: r.answer for r in answering.answer(q, v, c, [broken, lambda talks, heat: ["I am unable to find it."] * len(talks)]).collect()}[1] == "I am unable to find it."


def test_questions_compare_the_real_documents_of_requests(spark):
    d = "/root/testdata/sf0.01"
    first = {}
    for r in sorted(reference_queries.table(spark, d, "chat_pairs").select("pair_id", "doc_ids").where("pair_id is not null").collect(), key=lambda r: r.pair_id, reverse=True):
        docs = {x.strip().lower() for x in r.doc_ids or [] if x and x.strip()}
        if len(docs) >= 2:
            first |= {x: docs for x in docs}
    own = {r.query_id: r.doc_ids[0] for r in reference_queries._questions(spark, d, scoped=True).select("query_id", "doc_ids").collect()}
    known = sorted({r.id.strip().lower() for r in reference_queries.table(spark, d, "documents").select("id").collect() if r.id and r.id.strip()})
    following = dict(zip(known, known[1:]))
    got = reference_queries.queries()["compare_requested"](spark, d).collect()
    assert {(r.query_id, r.doc_id) for r in got} == {(q, x) for q, o in own.items() for x in first.get(o, {o, following.get(o, o)})} and {r.query_id for r in got} == set(own)
    hit = [r for r in got if r.length != len("no direct mention")]
    assert any(r.doc_id == own[r.query_id] for r in hit) and any(r.doc_id in known and r not in hit for r in got)
