import random
import re
import string

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliant.functions import answers as A
from foliant.functions import render as R
from foliant.functions import text as X
from foliant.operators.chunking import chunk_pages, line_chunks, page_stats, split_recursively


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("out")).first().out


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}")
    return [r.out for r in df.select("i", expression.alias("out")).orderBy("i").collect()]


def plain_terms(text):
    out = []
    for w in text.split():
        w = w.strip(string.punctuation)
        if w:
            out += [p.lower() for p in re.findall(r"[A-Z]+(?=[A-Z][a-z]|\b)|[A-Z]?[a-z]+|[0-9]+", w)] or [w.lower()]
    return out


WORDS = {
    "GenerativeAI": ["generative", "ai"], "RAGModel": ["rag", "model"], "GPT4": ["4"], "AI2x": ["2", "x"], "iPhone15Pro": ["i", "phone", "15", "pro"], "école": ["cole"], "É": ["é"],
    "NOÉ": ["noé"], "don't": ["don", "t"], "HTTPServer2": ["http", "server", "2"], "": [], None: [], "...": [], "文書館": ["文書館"],
}


def test_terms(spark):
    assert column(spark, list(WORDS), X.terms(F.col("x"), ())) == list(WORDS.values())
    assert column(spark, ["The retrieval OF a Model", "don't"], X.terms(F.col("x"))) == [["retrieval", "model"], []]


def test_terms_of_random_texts(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("aBcD1 .,-|\n\té文Z") for _ in range(60)) for _ in range(300)]
    assert column(spark, texts, X.terms(F.col("x"), ())) == [plain_terms(t) for t in texts]


def test_counts_and_minutes(spark):
    assert column(spark, ["a  b\tc\n", "", None, " x "], X.word_count(F.col("x"))) == [3, 0, 0, 1]
    assert column(spark, [500, 700, 0, 199, 100, 300], X.reading_minutes(F.col("x")), "int") == [2, 4, 1, 1, 1, 2]


def test_headers_and_snippets(spark):
    texts = ["AI | GENERATIVE MODELS | 3\nMixed Case", "AB\n" + "X" * 39 + "\n" + "Y" * 40, None, "123\nÉTÉ"]
    assert column(spark, texts, X.header_segments(F.col("x"))) == [["GENERATIVE MODELS"], ["X" * 39], None, ["ÉTÉ"]]
    assert column(spark, ["ab\ncd"], X.snippet(F.col("x"), 4)) == ["ab c"]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab \n\n.x"), max_size=900), st.integers(20, 90))
def test_recursive_split_properties(text, size):
    pieces = split_recursively(text, size, size // 8)
    assert all(0 < len(p) <= size and p == p.strip() for p in pieces)
    assert set("".join(text.split())) == set("".join("".join(pieces).split()))


def test_recursive_split_overlaps_and_numbers(spark):
    text = " ".join(f"w{i:03d}" for i in range(300))
    pieces = split_recursively(text)
    assert pieces[0].split()[-1] in pieces[1].split() and all(len(p) <= 400 for p in pieces)
    pages = spark.createDataFrame([("d", "n", 2, text), ("d", "n", 1, "first"), ("d", "n", 3, " \n"), ("e", "n", 1, None)], "doc_id string, doc_name string, page int, text string")
    got = chunk_pages(pages).orderBy("chunk_index").collect()
    assert [r.chunk_index for r in got] == list(range(len(pieces) + 1)) and got[0].text == "first" and [r.text for r in got[1:]] == pieces
    stats = page_stats(chunk_pages(pages)).collect()
    assert [(r.doc_id, r.page_count, r.word_count) for r in stats] == [("d", 2, 1 + sum(len(p.split()) for p in pieces))]
    assert line_chunks(pages.where("page = 3")).count() == 0


CITED = {
    "A.\nCited Source Indices: 0, 2": [0, 2], "A. cited source indices: 7, 7": [7, 7], "A.\n\nCited Source Indices: 1 2": [], "A.": [], "A. Cited Source Indices: 1\nB.": [1], "Cited Source Indices: 9\n": [9], "Cited Source Indices:": [],
}


def test_citations(spark):
    assert column(spark, list(CITED), A.cited_indices(F.col("x"))) == list(CITED.values())
    stripped = column(spark, list(CITED), A.without_citations(F.col("x")))
    assert stripped == [re.sub(r"\n*Cited Source Indices:\s*.*", "", t, flags=re.I).strip() for t in CITED]
    sources = F.array(*[F.lit(s) for s in "abc"])
    for indices, want in (([2, 0], "ca"), ([1, 1], "bb"), ([5], "abc"), ([], "abc"), ([5, 2], "c")):
        assert "".join(one(spark, A.cited_sources(sources, F.array(*map(F.lit, indices)).cast("array<int>")))) == want


def test_intent(spark):
    asked = {"Hi!": "CONVERSATIONAL", "": "CONVERSATIONAL", None: "CONVERSATIONAL", "  thanks a lot. ": "CONVERSATIONAL", "That is not in the document, is it?": "CONVERSATIONAL", "roles?": "AMBIGUOUS", "v": "AMBIGUOUS", "xy!": "AMBIGUOUS", "What is AI?": "FACTUAL"}
    assert column(spark, list(asked), A.intent(F.col("x"))) == list(asked.values())


def test_confidence_relevance_and_modes(spark):
    assert column(spark, [0.4, 0.0, 3.0, None, 0.7, 2 * (1 - 0.8)], A.confidence(F.col("x")), "double") == [80, 100, 0, 0, 65, 80]
    assert column(spark, [0.0, 1.0, 0.3333, 5.0], A.relevance(F.col("x")), "double") == [100.0, 50.0, 83.3, 0.0]
    assert column(spark, [80, 79, 65, 64], A.level(F.col("x")), "int") == ["High", "Medium", "Medium", "Low"]
    assert column(spark, [50, 0, None], A.meter_width(F.col("x"), F.lit("High")), "int") == [50, 90, 90]
    assert column(spark, ["qa", "deep", "odd", None], A.mode_top_k(F.col("x"))) == [3, 9, 5, 5] and column(spark, ["eli5", None], A.mode_temperature(F.col("x"))) == [0.6, 0.2]


def test_sizes_and_percentages(spark):
    sizes = [0, 1, 1023, 1024, 1536, 1 << 20, 1288490188, 5 * (1 << 40), None, -1]
    assert column(spark, sizes, R.format_bytes(F.col("x")), "long") == ["0 Bytes", "1 Bytes", "1023 Bytes", "1 KB", "1.5 KB", "1 MB", "1.2 GB", "5120 GB", None, None]
    assert column(spark, [1, 3, 0], R.percent(F.col("x"), F.lit(8)), "int") == [13, 38, 0] and one(spark, R.percent(F.lit(1), F.lit(0))) is None


def test_markdown(spark):
    text = "# Head\n- one **b** two\n* three\n\ntext\n### Sub\n- four"
    got = R.markdown_lines(spark.createDataFrame([(1, text), (2, "")], "id int, text string"), "id", "text").orderBy("id", "line_no").collect()
    assert [(r.kind, r.content, r.bold_parts, r.list_no) for r in got if r.id == 1] == [
        ("h1", "Head", 0, None), ("item", "one **b** two", 1, 0), ("item", "three", 0, 0), ("blank", "", 0, None), ("paragraph", "text", 0, None), ("h3", "Sub", 0, None), ("item", "four", 0, 1),
    ]
    assert [(r.kind, r.content) for r in got if r.id == 2] == [("blank", "")]


@pytest.mark.parametrize("phrase", A.NOTHING_FOUND)
def test_nothing_found(spark, phrase):
    assert one(spark, A.found_nothing(F.lit(f"I could {phrase.upper()} here"))) and not one(spark, A.found_nothing(F.lit("It is found.")))
