import random

import public_tokenizers as P
import pytest
import tiktoken

from foliant.llm import tokenizer as Z
from foliant.session import table


@pytest.fixture(scope="module")
def plain():
    ranks = Z.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    return tiktoken.Encoding("plain", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_whole_table_as_the_public_encoder(spark, plain):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r.ids for r in Z.encode_corpus(docs).collect()}
    assert got == {d: plain.encode_ordinary(t or "") for d, t in texts.items()}


def test_odd_texts_nulls_and_repeated_rows(spark, plain):
    texts = [None, "", " ", "<|endoftext|>", "a" * 20_000, "-" * 500, "日本語" * 400, "é" * 60, "\U0001f50d" * 90, "\x00\t\r\n  x", "don't DON'T", "x", "x"]
    df = spark.createDataFrame([(i // 2, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = sorted((r.doc_id, r.ids) for r in Z.encode_corpus(df).collect())
    assert got == sorted((i // 2, plain.encode_ordinary(t or "")) for i, t in enumerate(texts))
    assert Z.encode_corpus(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def test_random_bytes(name):
    ranks = Z.read_ranks(P.path(name))
    plain = tiktoken.Encoding("plain", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(3)
    words = {bytes(rng.choice(b"aeinrst lo" if i % 2 else range(256)) for _ in range(rng.randrange(1, 40))) for i in range(3000)}
    assert Z.TrieEncoder(ranks).encode(words) == {w: plain._encode_single_piece(w) for w in words}
