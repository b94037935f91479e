"""Missing or wrong language labels: a byte convolutional network, trained in numpy, applied to the sentences of each document."""

from __future__ import annotations

import hashlib
import io
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.languages import CODE_OF, LANGUAGES
from foliant.session import BLANKS, shared_folder

#: Bytes of a window; a longer sentence has several, which together cover it.
WINDOW = 96
#: The bounded sample that the network is trained on: documents of each labelled language, and sentences in all.
FIT_DOCS, FIT_SENTENCES = 300, 30_000
#: Steps of training at least: a small sample is gone through more often.
LEAST_STEPS = 1200
#: Longest text that is taken into the training sample (nothing is left out when the network is applied).
FIT_LENGTH = 20_000
#: A sentence counts for a passage in a language if the network gives it at least this.
SURE = 0.6

_LINE = re.compile(r"[^\r\n]+")
_SENTENCE = re.compile(r"\S.*?(?:(?<![.!?…])[.!?…]++[\"'”’»)\]]*(?=\s|$)|(?<![。！？])[。！？]++[」』）”]*|$)", re.S)
_STOPS, _CLOSING = frozenset(".!?。！？…"), frozenset("\"'”’»)]」』）")
_THREE_WORDS = re.compile(r"(?<![^\W\d_])[^\W\d_]++(?:[\W\d_]++[^\W\d_]++){2}")
_SIX_CJK = re.compile("(?:[぀-ヿ㐀-鿿][^぀-ヿ㐀-鿿]*){6}")
_WRAPPED = re.compile(r"(?<=[^\W\d_])-[^\S\r\n]*+[\r\n]\s*+(?=[^\W\d_])")


def _end(text: str, a: int, b: int) -> tuple[int, bool]:
    """(end, whole) of text[a:b]: its end without blanks, and whether a stop stands there, before any closing marks."""
    while b > a and text[b - 1].isspace():
        b -= 1
    at = b
    while at > a and text[at - 1] in _CLOSING:
        at -= 1
    return b, at > a and text[at - 1] in _STOPS


def units(text: str) -> list[tuple[int, int, bool]]:
    """(start, end, whole) of the sentences and scraps of a text; whole: a sentence of several words with its stop.

    A line goes on in the next one if it breaks off within a word or if the next begins in lower case.
    """
    blocks: list[list[int]] = []
    for m in _LINE.finditer(text):
        if not m.group().strip():
            continue
        if blocks:
            here, (end, stopped) = m.group().lstrip(), _end(text, *blocks[-1])
            if not stopped and here[:1].islower() and (text[end - 1].isalpha() or text[end - 1] in "-,;"):
                blocks[-1][1] = m.end()
                continue
        blocks.append([m.start(), m.end()])
    out = []
    for a, b in blocks:
        for m in _SENTENCE.finditer(text, a, b):
            piece = m.group()
            whole = _end(piece, 0, len(piece))[1] and bool(_THREE_WORDS.search(piece) or _SIX_CJK.search(piece))
            out.append((m.start(), m.end(), whole))
    return out


def windows_of(text: str) -> list[bytes]:
    """The bytes of a sentence, in lower case and in pieces of at most WINDOW; the last piece reaches back to be full."""
    if "\n" in text or "\r" in text:
        text = _WRAPPED.sub("", text)
    raw = " ".join(text.split()).lower().encode("utf-8", "replace")
    if len(raw) <= WINDOW:
        return [raw]
    return [raw[i : i + WINDOW] for i in range(0, len(raw) - WINDOW, WINDOW)] + [raw[-WINDOW:]]


def as_array(windows: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(w.ljust(WINDOW, b"\0") for w in windows), np.uint8).reshape(len(windows), WINDOW)


@dataclass
class ByteNet:
    """Embedding of bytes, filters of several widths over them, the maximum of each filter, and a softmax over the languages."""

    embedding: np.ndarray
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    weights: np.ndarray
    bias: np.ndarray

    @staticmethod
    def fresh(rng: np.random.Generator, widths: tuple[int, ...] = (2, 3, 4), size: int = 12, each: int = 32) -> ByteNet:
        normal = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        embedding = (rng.standard_normal((256, size)) * 0.5).astype(np.float32)
        return ByteNet(embedding, [normal(w * size, each) for w in widths], [np.zeros(each, np.float32) for _ in widths], normal(each * len(widths), len(LANGUAGES)), np.zeros(len(LANGUAGES), np.float32))

    def _places(self) -> int:
        """Places of a window at which all filters are applied."""
        return WINDOW - max(len(f) for f in self.filters) // self.embedding.shape[1] + 1

    def _spread(self, x: np.ndarray, width: int) -> np.ndarray:
        """The bytes under the filter at each place, embedded, side by side."""
        e, n = self.embedding[x], self._places()
        return np.concatenate([e[:, j : n + j] for j in range(width)], axis=2)

    def _byte_tables(self) -> np.ndarray:
        """What each byte adds to all filters at each place under them: (places, 256, filters), with an even number of places."""
        size, total = self.embedding.shape[1], sum(f.shape[1] for f in self.filters)
        wide = max(len(f) for f in self.filters) // size
        single = np.zeros((wide + wide % 2, 256, total), self.embedding.dtype)
        at = 0
        for f in self.filters:
            for j in range(len(f) // size):
                single[j, :, at : at + f.shape[1]] = self.embedding @ f[j * size : (j + 1) * size]
            at += f.shape[1]
        return single

    def probabilities(self, x: np.ndarray, batch: int = 8) -> np.ndarray:
        """The convolution as sums of table rows: only pairs of bytes that occur get a row, and small batches stay in the cache."""
        if not len(x):
            return np.zeros((0, len(LANGUAGES)), np.float32)
        single, n = self._byte_tables(), self._places()
        pairs = x[:, :-1].astype(np.int32) * 256 + x[:, 1:]
        used = np.flatnonzero(np.bincount(pairs.ravel(), minlength=65536))
        row = np.zeros(65536, np.int32)
        row[used] = np.arange(len(used))
        tables = [single[j][used >> 8] + single[j + 1][used & 255] for j in range(0, len(single), 2)]
        pairs, pooled = row[pairs], np.empty((len(x), single.shape[2]), single.dtype)
        for at in range(0, len(x), batch):
            part = pairs[at : at + batch]
            s = tables[0][part[:, :n]]
            for j, t in enumerate(tables[1:], 1):
                s += t[part[:, 2 * j : 2 * j + n]]
            s.max(1, out=pooled[at : at + batch])
        z = np.maximum(pooled + np.concatenate(self.biases), 0) @ self.weights + self.bias
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        size, n = self.embedding.shape[1], len(x)
        pooled, best, spreads = [], [], []
        for f, b in zip(self.filters, self.biases):
            s = self._spread(x, len(f) // size)
            a = (s.reshape(-1, len(f)) @ f).reshape(n, -1, f.shape[1])
            k = a.argmax(1)
            pooled.append(np.take_along_axis(a, k[:, None], 1)[:, 0] + b)
            best.append(k)
            spreads.append(s)
        h = np.concatenate(pooled, 1)
        r = np.maximum(h, 0)
        z = r @ self.weights + self.bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(n), y] -= 1
        p /= n
        back = (p @ self.weights.T) * (h > 0)
        g_embedding, g_filters, g_biases, at = np.zeros_like(self.embedding), [], [], 0
        for f, k, s in zip(self.filters, best, spreads):
            g = back[:, at : at + f.shape[1]]
            at += f.shape[1]
            chosen = s[np.arange(n)[:, None], k]  # the spread at the maximum of each filter
            g_filters.append(np.einsum("nfi,nf->if", chosen, g, optimize=True))
            g_biases.append(g.sum(0))
            down = (g[:, :, None] * f.T[None]).reshape(n, f.shape[1], -1, size)
            for j in range(down.shape[2]):
                under = x[np.arange(n)[:, None], k + j].ravel().astype(np.int64)
                places = (under[:, None] * size + np.arange(size)).ravel()
                g_embedding += np.bincount(places, down[:, :, j].ravel(), g_embedding.size).reshape(g_embedding.shape).astype(g_embedding.dtype)
        return [g_embedding, *g_filters, *g_biases, r.T @ p, p.sum(0)]

    def _parts(self) -> list[np.ndarray]:
        return [self.embedding, *self.filters, *self.biases, self.weights, self.bias]

    def train(self, x: np.ndarray, y: np.ndarray, rng: np.random.Generator, epochs: int = 4, batch: int = 128, rate: float = 0.004) -> None:
        """Adam; before each later epoch, sentences whose label the network finds unlikely are left out, more strictly each time: labels may be wrong."""
        epochs = max(epochs, -(-LEAST_STEPS * batch // len(x)))
        m, v, step = [np.zeros_like(p) for p in self._parts()], [np.zeros_like(p) for p in self._parts()], 0
        for epoch in range(epochs):
            kept = np.arange(len(x)) if not epoch else np.flatnonzero(self.probabilities(x)[np.arange(len(x)), y] > min(0.5, 0.6 * epoch / epochs))
            order = rng.permutation(kept)
            for at in range(0, len(order), batch):
                rows = order[at : at + batch]
                step += 1
                for i, (p, g) in enumerate(zip(self._parts(), self._gradients(x[rows], y[rows]))):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    p -= (rate / (1 + 4 * epoch / epochs)) * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-7)


def label_code(label: Column | str) -> Column:
    """As code_of, as a column expression: the two-letter code that a label stands for, null for none of the eight."""
    bare = F.lower(F.btrim(label, F.lit(BLANKS)))
    codes = F.create_map(*[F.lit(x) for pair in CODE_OF.items() for x in pair])
    return F.coalesce(F.element_at(codes, F.coalesce(bare, F.lit(""))), F.element_at(codes, F.coalesce(F.split(bare, "[-_ (]")[0], F.lit(""))))


def training_sentences(documents: DataFrame, docs: int = FIT_DOCS) -> tuple[list[str], np.ndarray]:
    """(sentences, languages): of at most ``docs`` documents of each label, those with the lowest hash of their text; labels may be wrong.

    One pass: each task keeps its own lowest before the shuffle.
    """
    held = documents.select("text", label_code("lang").alias("code")).where("code is not null and length(text) > 0").where(F.length("text") <= FIT_LENGTH)
    lowest = F.row_number().over(Window.partitionBy("code").orderBy(F.xxhash64("text"), "text"))
    sample = held.withColumn("place", lowest).where(F.col("place") <= docs).select("code", "text").collect()  # at most docs a language
    found = [(r.text[a:b], LANGUAGES.index(r.code)) for r in sorted(sample) for a, b, whole in units(r.text) if whole]
    rng = np.random.default_rng(5)
    picked = [found[i] for i in rng.permutation(len(found))]
    per = FIT_SENTENCES // len(LANGUAGES)
    seen, sentences, languages = [0] * len(LANGUAGES), [], []
    for s, c in picked:
        if seen[c] < per:
            seen[c] += 1
            sentences.append(s)
            languages.append(c)
    return sentences, np.array(languages, np.int64)


def fit(documents: DataFrame, docs: int = FIT_DOCS, epochs: int = 4) -> ByteNet:
    """The network, trained on a bounded sample of labelled documents; without any labelled text it is untrained and knows nothing.

    It is kept in the shared folder under a fingerprint of the sample and of what shapes the training, so that the same sample trains it once.
    """
    sentences, languages = training_sentences(documents, docs)
    rng = np.random.default_rng(11)
    net = ByteNet.fresh(rng)
    made_of = hashlib.sha256(repr((WINDOW, FIT_SENTENCES, LEAST_STEPS, epochs, [p.shape for p in net._parts()])).encode())
    for s, k in zip(sentences, languages.tolist()):
        made_of.update(f"{k}{s}\0".encode("utf-8", "replace"))
    spark = documents.sparkSession
    jvm, path = spark._jvm, f"{shared_folder(spark)}/foliant-net-{made_of.hexdigest()}"
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if fs.exists(at):
        with np.load(io.BytesIO(bytes(spark.read.format("binaryFile").load(path).select("content").first()[0]))) as kept:
            for p, name in zip(net._parts(), kept.files):
                p[...] = kept[name]
        return net
    if len(sentences):
        cut = [windows_of(s) for s in sentences]
        x, y = as_array([w for ws in cut for w in ws]), np.repeat(languages, [len(ws) for ws in cut])
        if len(x) > FIT_SENTENCES * 3 // 2:
            rows = np.sort(rng.permutation(len(x))[: FIT_SENTENCES * 3 // 2])
            x, y = x[rows], y[rows]
        net.train(x, y, rng, epochs)
    raw = io.BytesIO()
    np.savez(raw, *net._parts())
    part = jvm.org.apache.hadoop.fs.Path(f"{path}-{uuid.uuid4().hex}")  # renamed when it is whole
    out = fs.create(part, True)
    out.write(bytearray(raw.getvalue()))
    out.close()
    if not fs.rename(part, at):
        fs.delete(part, True)
    return net


def _classify(net: ByteNet, texts: list[str]) -> np.ndarray:
    """The mean probabilities of each text's windows."""
    cut = [windows_of(t) for t in texts]
    sizes = np.array([len(c) for c in cut], np.int64)
    if not len(sizes):
        return np.zeros((0, len(LANGUAGES)))
    p = net.probabilities(as_array([w for c in cut for w in c]))
    return np.add.reduceat(p, np.cumsum(sizes) - sizes) / sizes[:, None]


def _runs(text: str, spans: list[tuple[int, int, bool]], p: np.ndarray) -> list[tuple[int, int, int, float, int]]:
    """(start, end, language, confidence, sentences) of the stretches of whole sentences in one language, others between them passed over."""
    out: list[list] = []
    for (a, b, _), q in zip(spans, p):
        k = int(q.argmax())
        if out and out[-1][2] == k:
            out[-1][1], out[-1][3], out[-1][4] = b, out[-1][3] + float(q[k]), out[-1][4] + 1
        else:
            out.append([a, b, k, float(q[k]), 1])
    return [(a, b, k, s / n, n) for a, b, k, s, n in out]


def _segments(documents: DataFrame, net: ByteNet) -> DataFrame:
    """(doc_id, label, main, start, end, lang, confidence, sentences) of every stretch of every text that has words."""
    kind = documents.schema["doc_id"].dataType.simpleString()

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for at in range(0, len(pdf), 500):
                part = pdf.iloc[at : at + 500]
                found, texts = [], []
                for text in part["text"]:
                    spans = units(text)
                    whole = [u for u in spans if u[2]]
                    if not whole:  # no sentence: the text as one
                        whole = [(spans[0][0], spans[-1][1], False)] if spans else []
                    found.append(whole)
                    texts += [text[a:b] for a, b, _ in whole]
                p, out, at_unit = _classify(net, texts), [], 0
                for doc_id, label, text, spans in zip(part["doc_id"], part["label"], part["text"], found):
                    if not spans:
                        continue
                    own = p[at_unit : at_unit + len(spans)]
                    at_unit += len(spans)
                    weight = np.array([b - a for a, b, _ in spans])
                    main = int((own * weight[:, None]).sum(0).argmax())
                    for run in _runs(text, spans, own):
                        out.append((doc_id, label, LANGUAGES[main], run[0], run[1], LANGUAGES[run[2]], run[3], run[4]))
                yield pd.DataFrame(out, columns=["doc_id", "label", "main", "start", "end", "lang", "confidence", "sentences"])

    # words: at least one letter
    rows = documents.select("doc_id", label_code("lang").alias("label"), "text").where("doc_id is not null").where(F.col("text").rlike("\\p{L}"))
    return rows.mapInPandas(batches, f"doc_id {kind}, label string, main string, start int, end int, lang string, confidence double, sentences int")


def segments(documents: DataFrame, net: ByteNet | None = None) -> DataFrame:
    """(doc_id, start, end, lang, confidence, sentences): each passage, two or more whole sentences in a row in one language, and its place in characters.

    Null, blank and wordless texts have none. Lines between the sentences (headings, page lines, code) belong to no passage and break none.
    """
    found = _segments(documents, net or fit(documents))
    return found.where((F.col("sentences") >= 2) & (F.col("confidence") >= SURE)).select("doc_id", "start", "end", "lang", "confidence", "sentences")


def document_languages(documents: DataFrame, net: ByteNet | None = None) -> DataFrame:
    """(doc_id, label, lang, confidence, sentences): the languages of each text: that of most of it, and any that has a passage.

    ``label`` is the code that lang stands for, null if it is missing or names none of the languages.
    """
    found = _segments(documents, net or fit(documents))
    passage = (F.col("sentences") >= 2) & (F.col("confidence") >= SURE)
    kept = found.where(passage | (F.col("lang") == F.col("main")))
    mean = F.sum(F.col("confidence") * F.col("sentences")) / F.sum("sentences")
    return kept.groupBy("doc_id", "label", "lang").agg(mean.alias("confidence"), F.sum("sentences").alias("sentences"))


def mislabelled(documents: DataFrame, net: ByteNet | None = None) -> DataFrame:
    """(doc_id, lang): the languages of the documents whose label is missing or none of them, or that have more than one."""
    found = document_languages(documents, net).select("doc_id", "label", "lang")
    own = found.groupBy("doc_id", "label").agg(F.array_sort(F.collect_set("lang")).alias("langs"))  # at most eight a document
    cases = own.where(F.col("label").isNull() | ~F.array_contains("langs", F.col("label")) | (F.size("langs") > 1))
    return cases.select("doc_id", F.explode("langs").alias("lang")).distinct()
