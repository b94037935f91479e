"""Evaluation texts leaking into training text: an FM-index of each shard of documents, searched for the items' phrases."""

from __future__ import annotations

import itertools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.session import cut_lineage

#: Consecutive words that make a leak.
PHRASE = 12
#: Words of documents that one index holds; a longer document has one of its own.
SHARD_WORDS = 1_000_000
#: Items searched for at once. A task reads them block by block from one file and searches each of its indexes for each block.
ITEM_BLOCK = 20_000
SAMPLE = 16

_WORD = regex.compile(r"[\p{L}\p{N}][\p{L}\p{N}\p{M}]*")
_END, _OTHER = 0, 1  # symbols: the end of the shard; any word that no item holds, and the end of a document


def plain(word: str) -> str:
    """A word without case and accents."""
    if word.isascii():
        return word.lower()
    return "".join(c for c in unicodedata.normalize("NFD", word.lower()) if not unicodedata.combining(c))


def words_of(text: str | None) -> list[str]:
    return [plain(w) for w in _WORD.findall(text)] if text else []


class _Bits:
    """A bit vector that counts the ones before any place."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(np.append(bits, np.zeros(64 - len(bits) % 64, bool)), bitorder="little").view(np.uint64)
        self.words, ones = packed, np.bitwise_count(packed).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(ones)[:-1]])

    def rank(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)


class WaveletTree:
    """Ranks of symbols in a sequence, its levels laid out as a matrix: at each level the zeros come before the ones."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels = []
        for level in range(bits - 1, -1, -1):
            ones = (symbols >> level) & 1 == 1
            self.levels.append((level, _Bits(ones), int(len(symbols) - ones.sum())))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before its place."""
        start, end = np.zeros_like(at), at
        for level, bits, zeros in self.levels:
            one = (symbol >> level) & 1 == 1
            a, b = bits.rank(start), bits.rank(end)
            start, end = np.where(one, zeros + a, start - a), np.where(one, zeros + b, end - b)
        return end - start


def suffix_array(s: np.ndarray) -> np.ndarray:
    """The places of ``s`` ordered by the suffixes that begin there, by doubling the compared length."""
    n, k = len(s), 1
    rank = s.astype(np.int64)
    while True:
        second = np.full(n, -1, np.int64)
        second[: n - k] = rank[k:]
        key = rank * (n + int(s.max()) + 2) + second + 1
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        fresh = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        if fresh[-1] == n - 1 or k >= n:
            return order
        k *= 2


class FMIndex:
    """Finds phrases in a sequence of symbols that ends with 0, held as its Burrows-Wheeler transform."""

    def __init__(self, symbols: np.ndarray, kinds: int):
        sa = suffix_array(symbols)
        self.n = len(symbols)
        self.last = symbols[sa - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=kinds))])
        self.tree = WaveletTree(self.last, max(1, int(kinds - 1).bit_length()))
        sampled = sa % SAMPLE == 0
        self.sampled, self.places = _Bits(sampled), sa[sampled]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows [low, high) that begin with each phrase, found from its last symbol backwards."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        alive = np.arange(len(phrases))
        for j in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[alive, j]
            low[alive] = self.first[c] + self.tree.rank(c, low[alive])
            high[alive] = self.first[c] + self.tree.rank(c, high[alive])
            alive = alive[low[alive] < high[alive]]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The place in the text of each row: step back through the text until a sampled place is met."""
        out, steps, open_ = np.zeros(len(rows), np.int64), 0, np.arange(len(rows))
        rows = rows.copy()
        while len(open_):
            hit = self.sampled.get(rows[open_]) == 1
            done = open_[hit]
            out[done] = self.places[self.sampled.rank(rows[done])] + steps
            open_ = open_[~hit]
            c = self.last[rows[open_]]
            rows[open_] = self.first[c] + self.tree.rank(c, rows[open_])
            steps += 1
        return out


class _Phrases:
    """The distinct phrases of a block of items, as rows of symbols, with the items that hold each."""

    def __init__(self, items: list[tuple[int, str | None]], n: int, symbol: dict[str, int]):
        held: dict[tuple[int, ...], list[int]] = {}
        for i, text in items:
            ids = [symbol[w] for w in words_of(text)]
            for j in range(len(ids) - n + 1):
                held.setdefault(tuple(ids[j : j + n]), []).append(i)
        self.rows = np.array(list(held), np.int64).reshape(len(held), n)
        self.items = [sorted(set(x)) for x in held.values()]


class _Items:
    """The items in a file that every executor has: their words as symbols, and their phrases block by block. Only one block is held at a time."""

    def __init__(self, path: str, n: int, block: int):
        self.path, self.n, self.block = path, n, block
        self.symbol: dict[str, int] = {}
        for block in self._texts():
            for _, text in block:
                for w in words_of(text):
                    self.symbol.setdefault(w, len(self.symbol) + 2)
        self.kept: list[_Phrases] | None = None

    def _texts(self) -> Iterator[list[tuple[int, str | None]]]:
        for batch in pq.ParquetFile(self.path).iter_batches(self.block, columns=["item_id", "text"]):
            yield list(zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist()))

    def blocks(self) -> Iterator[_Phrases]:
        if self.kept is None:
            first = [_Phrases(x, self.n, self.symbol) for x in itertools.islice(self._texts(), 2)]
            if len(first) < 2:
                self.kept = first  # a single block stays for the next shard
        yield from self.kept if self.kept is not None else (_Phrases(x, self.n, self.symbol) for x in self._texts())


def _search_shard(docs: list[tuple[int, str]], symbols: list[np.ndarray], items: _Items, n: int) -> Iterator[pd.DataFrame]:
    """(doc_id, item_id, start, end, words): the merged spans of each item in each document of a shard, in characters. The index is built once."""
    kept, where, doc = [], [], []
    for d, s in enumerate(symbols):
        s = np.append(s, _OTHER)
        keep = (s != _OTHER) | np.concatenate([[True], s[:-1] != _OTHER])  # a run of other words is one: no phrase crosses it
        kept.append(s[keep])
        where.append(np.flatnonzero(keep))
        doc.append(np.full(int(keep.sum()), d))
    text, where_, doc_ = np.append(np.concatenate(kept), _END), np.concatenate(where), np.concatenate(doc)
    index = FMIndex(text, len(items.symbol) + 2)
    for phrases in items.blocks():
        if len(phrases.rows):
            yield _spans(index, phrases, docs, doc_, where_, n)


def _spans(index: FMIndex, phrases: _Phrases, docs: list[tuple[int, str]], doc_: np.ndarray, where_: np.ndarray, n: int) -> pd.DataFrame:
    low, high = index.search(phrases.rows)
    count = np.maximum(high - low, 0)
    phrase = np.repeat(np.arange(len(low)), count)
    rows = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + low[phrase]
    at = index.locate(rows)
    spans: dict[tuple[int, int], list[int]] = {}
    for p, d, w in zip(phrase.tolist(), doc_[at].tolist(), where_[at].tolist()):
        for item in phrases.items[p]:
            spans.setdefault((d, item), []).append(w)
    out, bounds = [], {}
    for (d, item), starts in spans.items():
        if d not in bounds:
            bounds[d] = [m.span() for m in _WORD.finditer(docs[d][1])]
        starts.sort()
        begin = end = starts[0]
        for w in [*starts[1:], None]:
            if w is None or w > end + n:
                out.append((docs[d][0], item, bounds[d][begin][0], bounds[d][end + n - 1][1], end + n - begin))
                begin = w
            end = w
    return pd.DataFrame(out, columns=["doc_id", "item_id", "start", "end", "words"])


def leaks(documents: DataFrame, items: DataFrame, phrase: int = PHRASE, shard_words: int = SHARD_WORDS, item_block: int = ITEM_BLOCK) -> DataFrame:
    """(doc_id, item_id, start, end, words): every stretch of a document that an item holds too, of at least ``phrase`` words.

    Words are unbroken runs of letters and digits, compared without case and accents. Documents are read whole and never
    shuffled: each task builds indexes over its own. Null and wordless texts, and items of fewer words, give no rows; repeated
    rows give repeated rows. Items go to the executors as one file, written without passing the driver; a task searches its indexes
    for them in blocks of ITEM_BLOCK, so that documents are read and indexed once, however many items there are.
    """
    spark, n = documents.sparkSession, phrase
    held = cut_lineage(items.select("item_id", "text").where("item_id is not null and text is not null").coalesce(1))
    files = held.inputFiles()
    if files:
        spark.sparkContext.addFile(files[0])
    name = files[0].rpartition("/")[2] if files else None

    def shards(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if name is None:
            return
        held = _Items(SparkFiles.get(name), n, item_block)
        if not held.symbol:
            return
        cache: dict[str, int] = {}
        docs: list[tuple[int, str]] = []
        symbols: list[np.ndarray] = []
        size = 0
        for pdf in it:
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                ids = []
                for w in _WORD.findall(text):
                    s = cache.get(w)
                    if s is None:
                        if len(cache) > 500_000:
                            cache.clear()
                        s = cache[w] = held.symbol.get(plain(w), _OTHER)
                    ids.append(s)
                if len(ids) < n:
                    continue
                docs.append((doc_id, text))
                symbols.append(np.array(ids, np.int64))
                size += len(ids)
                if size >= shard_words:
                    yield from _search_shard(docs, symbols, held, n)
                    docs, symbols, size = [], [], 0
        if docs:
            yield from _search_shard(docs, symbols, held, n)

    texts = documents.select("doc_id", "text").where("doc_id is not null and text is not null")
    return texts.mapInPandas(shards, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, item_id long, start int, end int, words int")


def leaked_documents(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id): each document with each item of which it holds a passage."""
    return leaks(documents, items).select("doc_id", "item_id").distinct()


def removal_spans(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, start, end, items): what to cut from each document: the spans of all items, merged where they meet or overlap."""
    spans = leaks(documents, items).select("doc_id", F.struct("start", "end", "item_id").alias("s")).distinct()
    lists = spans.groupBy("doc_id").agg(F.array_sort(F.collect_list("s")).alias("spans"))  # bounded by the length of one text
    step = lambda acc, s: F.when(
        (F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= s["start"]),
        F.concat(
            F.slice(acc, 1, F.size(acc) - 1),
            F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end"), F.array_union(F.element_at(acc, -1)["items"], F.array(s["item_id"])).alias("items"))),
        ),
    ).otherwise(F.concat(acc, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"), F.array(s["item_id"]).alias("items")))))
    merged = F.aggregate("spans", F.array().cast("array<struct<start: int, end: int, items: array<bigint>>>"), step)
    return lists.select("doc_id", F.inline(merged)).withColumn("items", F.array_sort("items"))
