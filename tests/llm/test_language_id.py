import numpy as np
import pytest

from foliant.llm import language_id as L
from foliant.llm.languages import LANGUAGES, short_text_language
from foliant.session import table

DIR = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def net(spark):
    return L.fit(table(spark, DIR, "documents").limit(6000), docs=300)


def test_held_out_sentences(spark, net):
    """Sentences of other tables' documents, judged by their function words and script where these tell."""
    texts = [r.text for r in table(spark, "/root/testdata/sf0.01", "documents").where("text is not null").collect()]
    found = [(s, c) for t in texts for a, b, whole in L.units(t) if whole for s in [t[a:b]] for c in [short_text_language(s)] if c]
    p = L._classify(net, [s for s, _ in found])
    right = np.array([LANGUAGES[k] == c for k, (_, c) in zip(p.argmax(1), found)])
    assert len(found) > 5000 and right.mean() > 0.995


EN = "The tenant delays the deposit for reasons given below. The night shift covers the older readings in most cases."
DE = "Der Mietvertrag verzögert den vereinbarten Grenzwert gemäß dem Anhang. Das Archiv ersetzt eine schriftliche Mitteilung zweimal im Jahr."
JA = "第二査読者は契約が終わる前に古い測定値を必要とする。安全担当者は残りの予算を監視するが、屋根の修理が必要である。"


def test_labels_passages_and_scraps(spark, net):
    docs = [
        (1, EN, "en-GB"), (2, EN, None), (3, EN, " "), (4, EN, "xx"), (5, EN, "German"), (6, f"{EN}\n\n{DE}", "en"), (7, f"{EN}\n“alle offenen Fragen”\nSeite 2\nÜBERSICHT", "EN"),
        (8, f"{DE}\n{JA}", "ja"), (9, None, None), (10, "", None), (11, "12 - ...", None), (12, JA, "Japanese"), (2, EN, None), (None, EN, None), (13, (EN + " ") * 3000, "deu"), (14, "THE ANNEX", None),
    ]
    df = spark.createDataFrame([(*d, "clash", 1.0) for d in docs], "doc_id long, text string, lang string, label string, confidence double")
    got = sorted(tuple(r) for r in L.mislabelled(df, net).collect() if r.doc_id != 14)
    assert got == [(2, "en"), (3, "en"), (4, "en"), (5, "en"), (6, "de"), (6, "en"), (8, "de"), (8, "ja"), (13, "en")]
    spans = {(r.doc_id, r.lang): df.where(f"doc_id = {r.doc_id}").first().text[r.start : r.end] for r in L.segments(df.where("doc_id in (6, 8)"), net).collect()}
    assert spans == {(6, "en"): EN, (6, "de"): DE, (8, "de"): DE, (8, "ja"): JA}
    assert all(0.5 < r.confidence <= 1.0 + 1e-6 for r in L.document_languages(df.where("doc_id < 9"), net).collect())


def test_empty_and_unlabelled_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert L.mislabelled(df).count() == 0
    assert L.mislabelled(spark.createDataFrame([(1, EN, None)], df.schema)).count() == 1


def test_gradients():
    rng = np.random.default_rng(1)
    net = L.ByteNet.fresh(rng, each=4, size=3)
    for name in ("embedding", "weights", "bias"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    net.filters, net.biases = [f.astype(np.float64) for f in net.filters], [b.astype(np.float64) for b in net.biases]
    x, y = rng.integers(0, 256, (6, L.WINDOW)).astype(np.uint8), rng.integers(0, 8, 6)
    loss = lambda: -np.log(net.probabilities(x)[np.arange(6), y]).mean()
    for p, g in zip(net._parts(), net._gradients(x, y)):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        was = p[at]
        p[at] = was + 1e-6
        up = loss()
        p[at] = was - 1e-6
        down = loss()
        p[at] = was
        assert (up - down) / 2e-6 == pytest.approx(g[at], rel=1e-3)


def test_units_of_wrapped_lines_and_very_long_texts():
    wrapped = "The tenant delays the dep-\nosit for reasons\ngiven below. The night shift\nSECTION 2\ncovers it now."
    assert [wrapped[a:b] for a, b, whole in L.units(wrapped) if whole] == ["The tenant delays the dep-\nosit for reasons\ngiven below.", "covers it now."]
    long = "word word\n" * 200_000
    assert [(a, b, w) for a, b, w in L.units(long)] == [(0, len(long) - 1, False)]
    assert len(L.windows_of("x" * 1_000_000)) == -(-1_000_000 // L.WINDOW)
