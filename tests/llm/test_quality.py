import pytest

from foliant.llm import quality as Q
from foliant.llm.languages import code_of, short_text_language

ASK = "What does the annex say about the deposit?"
CASES = [
    (ASK, None, ["empty"]), (ASK, " ​\n", ["empty"]), (ASK, "N/A", ["empty"]), (ASK, "…", ["empty"]), (ASK, "Cited Source Indices: 0, 2", ["empty"]), (None, "", ["empty"]),
    (ASK, "No.", []), (ASK, "9 days", []), (ASK, "Tador", []), (ASK, "- the deposit\n- the annex", []), (ASK, "The deposit is due in March. [60]", []),
    (ASK, "The deposit is due in March. (see https://docs.example.invalid/a5)", []), (ASK, "The deposit is due in March. “ref 5”", []), (ASK, "It says: \"Sorry, no refunds after day ten.\"", []),
    (ASK, ASK, ["copied_question"]), (ASK, "**what  does the annex say about the deposit**\nCited Source Indices: 1", ["copied_question"]), (ASK, f"Question: {ASK}", ["copied_question"]),
    (ASK, f"{ASK} {ASK}", ["copied_question"]), (ASK, "> Question: " + ASK, ["copied_question"]), (ASK, ASK[:34], ["copied_question"]), (ASK, f"{ASK} It is due in March and is held by the bank.", []), (None, "It is due in March.", []),
    (ASK, "Sorry, I can’t answer that from the files you gave me.", ["refusal"]), (ASK, "Thank you for your question. There is nothing about the deposit in your documents.", ["refusal"]),
    (ASK, "Visitors are not able to enter the yard alone; the guard opens it for them.", []), (ASK, "The annex gives no year, but section 4 explains that the deposit is due.", []),
    (ASK, "I am not able to help with this request. The deposit is due in March and is held by the bank.", []), ("Was sagt der Anhang über die Kaution?", "Dazu steht nichts in den hochgeladenen Seiten.", ["refusal"]),
    ("なぜですか。", "申し訳ありませんが、その質問にはお答えできません。", ["refusal"]), ("Что сказано про это?", "К сожалению, я не могу ответить на этот вопрос.", ["refusal"]),
    (ASK, "The deposit is due in March. The bank holds it until", ["truncated"]), (ASK, "The deposit is due in March. The bank holds (the", ["truncated"]), (ASK, "The deposit is due in March. The bank,", ["truncated"]),
    (ASK, "1. The deposit is due.\n2. The bank holds it.\n3.", ["truncated"]), (ASK, "1. The deposit is due.\n2. The bank holds", ["truncated"]), (ASK, "The first of the parties is to pay the deposit to the bank of the other in the", ["truncated"]),
    (ASK, "Die Kaution ist im März fällig, und die Bank verwahrt sie.", ["other_language"]), (ASK, "保証金は三月に支払われる。", ["other_language"]),
    (f"Please reply in German. {ASK}", "Die Kaution ist im März fällig, und die Bank verwahrt sie.", []), (f"Answer in Italian: {ASK}", "Die Kaution ist im März fällig, und die Bank verwahrt sie.", ["other_language"]),
]


@pytest.mark.parametrize("question,answer,want", CASES)
def test_rules(question, answer, want):
    assert Q.defects_of(question, answer) == want


def test_table_with_repeats_nulls_clashes_and_long_texts(spark):
    rows = [(1, ASK, "", "x"), (1, ASK, "", "x"), (2, ASK, "It is due. " * 40_000, "x"), (None, ASK, "", "x"), (3, None, None, "x")]
    df = spark.createDataFrame(rows, "pair_id long, question string, answer string, defect string")
    assert sorted(map(tuple, Q.broken_pairs(df).collect())) == [(1, "empty"), (3, "empty")]
    assert Q.broken_pairs(df.limit(0)).count() == 0


def test_labels_and_short_texts():
    assert [code_of(x) for x in ("EN", " en-GB", "deu", "Japanese", "pt_BR", "xx", "", None, "unknown")] == ["en", "en", "de", "ja", "pt", None, None, None, None]
    assert short_text_language("Entro dieci giorni lavorativi, il consiglio richiede le letture.") == "it" and short_text_language("Tador 42") is None
