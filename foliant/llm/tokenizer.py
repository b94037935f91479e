"""Encoding a corpus with a public byte-level BPE by depth-first traversal of the trie of its distinct words."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Distinct words a task remembers; beyond it the memory starts anew, which changes nothing but the time taken.
REMEMBERED = 400_000


def public_vocabulary(name: str = "byte_bpe_50k.tiktoken") -> tuple[str, str]:
    """(path, pattern) of a vocabulary of the installed public tokenizers; the files stay where they are."""
    import public_tokenizers

    return str(public_tokenizers.path(name)), public_tokenizers.PATTERN


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class TrieEncoder:
    """Encodes many words at once.

    A token sequence is the BPE encoding of its bytes exactly when every two neighbouring tokens encode to themselves. So the
    encoding of a prefix is known from its last token alone: the encoding of the prefix without that token, and the token. The
    state of a trie node is the last token of the prefix that it stands for. The trie is visited depth first by taking its words
    in order: what a word shares with the word before are the nodes already on the stack, whose states are kept and not computed again.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.bytes_of = ranks, {r: t for t, r in ranks.items()}
        self.reach: dict[bytes, int] = {}  # by its last two bytes, how long a token can be
        for t in ranks:
            self.reach[t[-2:]] = max(self.reach.get(t[-2:], 0), len(t))
        self.joins: dict[tuple[int, int], bool] = {}

    def _merged(self, piece: bytes) -> list[int]:
        """Plain BPE of a short piece: the pair of lowest rank is merged first, the leftmost of equals."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            ranks = [self.ranks.get(a + b) for a, b in zip(parts, parts[1:])]
            low = min((r for r in ranks if r is not None), default=None)
            if low is None:
                break
            i = ranks.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def _stands(self, left: int, right: int) -> bool:
        known = self.joins.get((left, right))
        if known is None:
            if len(self.joins) > 2_000_000:
                self.joins.clear()
            known = self.joins[left, right] = self._merged(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        return known

    def encode(self, words: set[bytes] | list[bytes]) -> dict[bytes, list[int]]:
        ranks, reach, stands = self.ranks, self.reach, self._stands
        out: dict[bytes, list[int]] = {}
        last: list[int] = []  # last token of each prefix on the stack
        size: list[int] = []  # and its length in bytes
        before = b""
        for word in sorted(words):
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del last[shared:], size[shared:]
            for end in range(shared + 1, len(word) + 1):
                for n in range(min(end, reach.get(word[max(0, end - 2) : end], 1) if end > 1 else 1), 0, -1):
                    token = ranks.get(word[end - n : end])
                    if token is not None and (n == end or stands(last[end - n - 1], token)):
                        last.append(token)
                        size.append(n)
                        break
            ids, end = [], len(word)
            while end:
                ids.append(last[end - 1])
                end -= size[end - 1]
            ids.reverse()
            out[word] = ids
            before = word
        return out


def encode_corpus(documents: DataFrame, vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, ids): the token ids of every text, without special tokens.

    Null and empty texts give the empty list; strings that look like special tokens are ordinary text. Rows come out as they came in,
    repeated ones too. No shuffle: each task meets its distinct words once. Texts of any length are encoded whole.
    """
    known = public_vocabulary() if vocabulary is None or pattern is None else ("", "")
    path, split = vocabulary or known[0], pattern or known[1]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, find, seen = TrieEncoder(read_ranks(path)), regex.compile(split).findall, {}
        for batch in it:
            texts = [find(t) if t else () for t in batch.column("text").to_pylist()]
            fresh = {w for words in texts for w in words if w not in seen}
            if len(seen) + len(fresh) > REMEMBERED:
                seen.clear()
                fresh = {w for words in texts for w in words}
            raw = {w.encode("utf-8", "replace"): w for w in fresh}
            seen.update((raw[b], ids) for b, ids in encoder.encode(list(raw)).items())
            offsets, flat = [0], []
            for words in texts:
                for w in words:
                    flat += seen[w]
                offsets.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids], ["doc_id", "ids"])

    kind = documents.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return documents.select("doc_id", F.col("text")).mapInArrow(batches, schema)
