"""Most similar vectors for every vector: multi-index hashing over learned, rotated binary codes."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.operators.skew import join_unique
from foliant.session import cut_lineage

#: Vectors that the rotations are learned from: a bounded sample; every vector is indexed.
FIT_ROWS = 20_000
#: Vectors that a bucket should hold. It sets the length of the substrings: one bit more for twice as many vectors.
BUCKET = 2048
#: Bits of a substring, at any number of vectors, and 64-bit words of a code at least. A word holds whole substrings; each of them is indexed.
MIN_BITS, MAX_BITS, WORDS = 5, 40, 2
#: The number of substrings is such that a pair of this cosine similarity shares one with this probability.
AIM_SIMILARITY, AIM_RECALL = 0.85, 0.985
#: Where thresholds cut a dense cluster its pairs share less, so tables are added, up to this many times the number, until the sample's pairs do.
GROWTH, PROBES = 3, 2000
#: Codes kept for each vector, and for each query where not all vectors are, to be reranked by floats: the nearest by Hamming distance.
KEPT, KEPT_ASKED = 64, 128
#: Without a least similarity the radius grows until a query probes this many codes in each table, so that few vectors find their nearest too.
PROBED = 512
#: Of a query's codes in one of the many buckets that it probes, this many go on to be chosen from.
KEPT_PROBED = 32
#: A pair of the least similarity lies within the radius unless its distance is this many standard deviations above the mean.
DEVIATIONS = 2.5
#: A bucket that would hold more than HOT times BUCKET is compared in blocks: pairs of parts of at most PART times BUCKET vectors. So is one in which
#: more than KEPT codes lie within the radius of one: there codes do not tell neighbours apart, and the floats themselves are compared.
HOT, PART = 8, 6
#: Codes and floats of a bucket that are compared at once, and rows that are written at once.
BLOCK, CODE_PAIRS, PAIRS, WRITTEN = 1024, 1 << 18, 1 << 22, 1 << 16
#: What a row does in a bucket or block: is only found, only asks, does both with all others, or does both with the rows of the other part.
FOUND, ASKS, BOTH, LOW, HIGH = range(5)


def _rotation(x: np.ndarray, rng: np.random.Generator, bits: int, rounds: int = 30) -> np.ndarray:
    """Orthogonal directions whose signs lose least of ``x``: alternately the signs are taken and the rotation is fitted to them."""
    dim = x.shape[1]
    r = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    for _ in range(rounds):
        u, _, vt = np.linalg.svd(x.T @ np.sign(x @ r))
        r = u @ vt
    return r[:, rng.permutation(dim)[:bits]]


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of all codes ``a`` to all codes ``b``, word by word."""
    out = np.bitwise_count(a[:, 0, None] ^ b[None, :, 0])
    if a.shape[1] > 3:
        out = out.astype(np.uint16)
    for w in range(1, a.shape[1]):
        out += np.bitwise_count(a[:, w, None] ^ b[None, :, w])
    return out


@dataclass
class Codes:
    """Codes of ``tables`` substrings of ``bits`` bits each: directions, thresholds, the radius of the search, and the parts of dense buckets.

    ``dense`` has for each bucket (table, bucket) in which floats are compared, in the order of tables, the parts (first, number) of groups of its
    vectors: those that were already together in an earlier such bucket, by its place in ``dense``, and at -1 all others.
    """

    bits: int
    tables: int
    directions: np.ndarray
    thresholds: np.ndarray
    radius: int = 0
    dense: dict[tuple[int, int], dict[int, tuple[int, int]]] = field(default_factory=dict)

    @staticmethod
    def learn(sample: np.ndarray, n: int, least: float | None = None, seed: int = 7) -> Codes:
        """Codes for ``n`` vectors, learned from the unit vectors of ``sample``."""
        aim = AIM_SIMILARITY if least is None else least
        bits = min(MAX_BITS, max(MIN_BITS, math.ceil(math.log2(max(n, 1) / BUCKET))))
        differ = math.acos(max(-1.0, min(1.0, aim))) / math.pi
        agree = (1 - differ) ** bits
        tables = max(WORDS * (64 // bits), 1 if agree == 1 else math.ceil(math.log(1 - AIM_RECALL) / math.log(1 - agree)))
        dim, rng = sample.shape[1], np.random.default_rng(seed)
        centred = sample - sample.mean(0)
        columns: list[np.ndarray] = []
        share, most = n / len(sample), GROWTH * tables
        asks = np.random.default_rng(seed).permutation(len(sample))[:PROBES]
        near, real = _nearest_in(sample, asks, aim)
        while True:
            while sum(c.shape[1] for c in columns) < bits * tables:  # each rotation gives as many bits as there are dimensions
                columns.append(_rotation(centred, rng, dim))
            directions = np.concatenate(columns, 1)[:, : bits * tables]
            codes = Codes(bits, tables, directions, np.median(sample @ directions, 0))
            own = codes.buckets(sample)
            hot = codes._hot(own, share)
            if tables >= most or codes._shared(own, hot.any(1), asks, near, real) >= AIM_RECALL:
                break
            tables = min(most, tables + max(1, tables // 8))
        length = bits * tables
        packed = codes.pack(own)
        apart = np.bitwise_count(packed[asks][:, None] ^ packed[near]).sum(-1)[real]
        codes.radius = min(length, max(math.ceil(length * differ + DEVIATIONS * math.sqrt(length * differ * (1 - differ))), int(np.quantile(apart, 0.998)) if len(apart) else 0))
        # in the sample's scale: more than KEPT, beyond what chance makes of fewer
        crowd = KEPT / share + (4 * math.sqrt(KEPT / share) if share > 1 else 0)
        crowded = np.zeros(len(sample), bool)
        for at in range(0, len(asks), 128):
            crowded[asks[at : at + 128]] = (_distances(packed[asks[at : at + 128]], packed) <= codes.radius).sum(1) - 1 > crowd
        met = np.full(len(sample), -1)
        for t, bucket_of in enumerate(own.T):
            for bucket in np.unique(bucket_of[crowded | hot[:, t]]):
                rows = np.flatnonzero(bucket_of == bucket)
                sizes = {int(g): c * share for g, c in zip(*np.unique(met[rows], return_counts=True)) if g >= 0 and c * share >= PART * BUCKET}
                sizes = {-1: len(rows) * share - sum(sizes.values())} | sizes
                layout, first = {}, 0
                for g, size in sizes.items():
                    layout[g] = first, max(1, math.ceil(size / (PART * BUCKET)))
                    first += layout[g][1]
                met[rows[met[rows] < 0]] = len(codes.dense)
                codes.dense[t, int(bucket)] = layout
        return codes

    def _hot(self, own: np.ndarray, share: float) -> np.ndarray:
        """Whether each vector of the sample is in a bucket, of each table, that is hot among all vectors."""
        hot = np.zeros(own.shape, bool)
        for t, column in enumerate(own.T):
            _, inverse, counts = np.unique(column, return_inverse=True, return_counts=True)
            hot[:, t] = (counts[inverse] * share > HOT * BUCKET) & (counts[inverse] > 1)
        return hot

    def _shared(self, own: np.ndarray, hot: np.ndarray, asks: np.ndarray, near: np.ndarray, real: np.ndarray) -> float:
        """The part of the probed pairs that share a bucket: of those of vectors in hot buckets or of the others, whichever is less."""
        shared = (own[asks][:, None, :] == own[near]).any(-1)
        return min((shared[m].mean() for m in (real & hot[asks][:, None], real & ~hot[asks][:, None]) if m.any()), default=1.0)

    def buckets(self, x: np.ndarray) -> np.ndarray:
        """The substring of each vector in each table, as a number."""
        signs = (x @ self.directions > self.thresholds).reshape(len(x), self.tables, self.bits)
        return signs @ (1 << np.arange(self.bits, dtype=np.int64))

    def pack(self, own: np.ndarray) -> np.ndarray:
        """The code as 64-bit words, each of whole substrings, the first lowest."""
        each = 64 // self.bits
        words = np.zeros((len(own), -(-self.tables // each)), np.uint64)
        for t in range(self.tables):
            words[:, t // each] |= own[:, t].astype(np.uint64) << np.uint64(t % each * self.bits)
        return words

    def met_before(self, differing: np.ndarray, table: int, flips: int) -> np.ndarray:
        """Whether codes that differ in these words share, but for ``flips`` bits, a substring before that of ``table``."""
        each, mask, out = 64 // self.bits, np.uint64((1 << self.bits) - 1), np.zeros(len(differing), bool)
        for t in range(table):
            out |= np.bitwise_count((differing[:, t // each] >> np.uint64(t % each * self.bits)) & mask) <= flips
        return out

    def enough(self, n: int, flips: int) -> int:
        """The least number of flipped bits, ``flips`` or more, at which a query among ``n`` vectors probes PROBED codes in each table, or all."""
        probed = lambda f: n / 2**self.bits * sum(math.comb(self.bits, r) for r in range(f + 1))
        return next(f for f in range(flips, self.bits + 1) if f == self.bits or probed(f) >= min(n, PROBED))

    def _salts(self, x: np.ndarray, ids: np.ndarray | None) -> np.ndarray:
        return ((np.arange(len(x)) if ids is None else ids).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)

    def every(self, own: np.ndarray, salts: np.ndarray) -> tuple[np.ndarray, ...]:
        """(row, table, bucket, block, side): where each vector is compared, so that all that share a bucket meet.

        Block -1 is a whole bucket, whose codes are compared. In a dense bucket any two parts make a block, whose floats are compared; parts of a
        group that was already together in an earlier dense bucket do not meet again.
        """
        cool, met, out = np.ones(own.shape, bool), np.full(len(own), -1), []
        for place, ((t, bucket), layout) in enumerate(self.dense.items()):
            rows = np.flatnonzero(own[:, t] == bucket)
            cool[rows, t] = False
            group = np.where(np.isin(met[rows], list(layout)), met[rows], -1)
            parts = sum(number for _, number in layout.values())
            for g, (first, number) in layout.items():
                mine = rows[group == g]
                part = first + salts[mine] % number
                for other in range(parts) if len(mine) else ():
                    if g < 0 or not first <= other < first + number:
                        block = np.minimum(part, other) * parts + np.maximum(part, other)
                        out.append((mine, np.full(len(mine), t), own[mine, t], block, np.where(part == other, BOTH, np.where(part < other, LOW, HIGH))))
            met[rows[met[rows] < 0]] = place
        rows, t = np.nonzero(cool)
        out.append((rows, t, own[rows, t], np.full(len(rows), -1), np.full(len(rows), BOTH)))
        return tuple(np.concatenate(c) for c in zip(*out))

    def some(self, own: np.ndarray, salts: np.ndarray, side: int, flips: int, spread: float) -> tuple[np.ndarray, ...]:
        """As :meth:`every`, of queries, in each table at the substrings within ``flips`` bits, or of vectors that they are to find.

        Queries go to all parts of a dense bucket, vectors to one; there are ``spread`` times as many queries as vectors.
        """
        masks = [sum(1 << b for b in c) for r in range(min(flips, self.bits) + 1 if side == ASKS else 1) for c in combinations(range(self.bits), r)]
        out = []
        for t in range(self.tables):
            dense = {bucket: sum(number for _, number in layout.values()) for (u, bucket), layout in self.dense.items() if u == t}
            for mask in masks:
                bucket_of = own[:, t] ^ mask
                cool = np.flatnonzero(~np.isin(bucket_of, list(dense)))
                out.append((cool, np.full(len(cool), t), bucket_of[cool], np.full(len(cool), -1)))
                for bucket, parts in dense.items():
                    rows = np.flatnonzero(bucket_of == bucket)
                    lots = max(1, math.ceil(parts * min(1.0, spread)))
                    for i in range(parts if side == ASKS else lots):
                        block = salts[rows] % lots * parts + i if side == ASKS else i * parts + salts[rows] % parts
                        out.append((rows, np.full(len(rows), t), np.full(len(rows), bucket), block))
        placed = tuple(np.concatenate(c) for c in zip(*out))
        return *placed, np.full(len(placed[0]), side)


def _nearest_in(sample: np.ndarray, asks: np.ndarray, aim: float, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(near, real): the nearest others in the sample of each vector asked for, and which of these are of the similarity ``aim``."""
    near, real = [], []
    for at in range(0, len(asks), 256):
        a = asks[at : at + 256]
        s = (sample[a].astype(np.float32) @ sample.T.astype(np.float32))
        s[np.arange(len(a)), a] = -2
        best = np.argsort(-s, axis=1)[:, :k] if s.shape[1] <= k else np.argpartition(-s, k - 1, axis=1)[:, :k]
        near.append(best)
        real.append(np.take_along_axis(s, best, 1) >= aim)
    return np.concatenate(near), np.concatenate(real)


def comparable(vectors: DataFrame, dim: int) -> DataFrame:
    """(id, embedding) of the rows that can be compared: an id, ``dim`` numbers, all finite and not all zero."""
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    e = F.col("embedding")
    kept = vectors.select(F.col("vec_id").alias("id"), "embedding").where("id is not null and embedding is not null").where(F.size(e) == dim)
    return kept.where(F.forall(e, number) & F.exists(e, lambda x: x != 0))


def _unit(raw: np.ndarray) -> np.ndarray:
    x = raw.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _binary(rows: np.ndarray) -> pa.Array:
    """Rows of equal length as a column of bytes."""
    width = rows.shape[1] * rows.itemsize
    offsets = np.arange(0, (len(rows) + 1) * width, width, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def _encode(rows: DataFrame, codes: Codes, dim: int, side: int = BOTH, flips: int = 0, spread: float = 0.0) -> DataFrame:
    """(place, block, id, side, held): the index. ``held`` is the code, in dense buckets the vector itself, and for queries both.

    ``place`` is the table and the bucket in one number.
    """

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                raw = np.asarray(part.column("embedding").flatten(), np.float32).reshape(part.num_rows, dim)
                ids, own = np.asarray(part.column("id")), codes.buckets(_unit(raw))
                salts, words = codes._salts(raw, ids), codes.pack(own)
                placed = codes.every(own, salts) if side == BOTH else codes.some(own, salts, side, flips, spread)
                for dense in (False, True):
                    kept = np.flatnonzero((placed[3] >= 0) == dense)
                    for start in range(0, len(kept), WRITTEN):
                        where, t, bucket, block, kind = (c[kept[start : start + WRITTEN]] for c in placed)
                        vectors, code = raw[where].view(np.uint8), words[where].view(np.uint8)
                        held = vectors if dense else np.concatenate([code, vectors], 1) if side == ASKS else code
                        place = (t.astype(np.int64) << MAX_BITS) | bucket.astype(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(block.astype(np.int64)), pa.array(ids[where]), pa.array(kind.astype(np.int8)), _binary(held)], ["place", "block", "id", "side", "held"])

    return rows.select("id", "embedding").mapInArrow(batches, "place long, block long, id long, side byte, held binary")


def _lists(asked: list[np.ndarray], found: list[np.ndarray], scores: list[np.ndarray]) -> pa.Table:
    """Rows in the order of those that ask, as one list for each."""
    rows, cols, values = (np.concatenate(x) if x else np.zeros(0, kind) for x, kind in ((asked, np.int64), (found, np.int64), (scores, float)))
    starts = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]])) if len(rows) else np.zeros(0, np.int64)
    offsets = pa.array(np.append(starts, len(rows)), pa.int32())
    return pa.table([pa.array(rows[starts]), *(pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (cols, values))], ["id", "other", "score"])


def _first(rows: np.ndarray, order: np.ndarray, k: int) -> np.ndarray:
    """Of ``order``, in which equal ``rows`` stand together, the places of the first k of each."""
    ordered = rows[order]
    return order[np.arange(len(ordered)) - np.searchsorted(ordered, ordered) < k]


def _near_codes(bucket: pa.Table, codes: Codes, radius: int | None, keep: int, flips: int) -> pa.Table:
    """For each row that asks, the ``keep`` nearest codes of a bucket, of those within ``radius`` if one is given, less those it met in an earlier table.

    Queries that are not all vectors bring their floats, and the bits of a code count by how far the query is from their thresholds.
    """
    side, ids, table = bucket["side"].to_numpy(), bucket["id"].to_numpy(), bucket["place"][0].as_py() >> MAX_BITS
    size = -(-codes.tables // (64 // codes.bits)) * 8
    raw = bucket["held"].to_pylist()
    words = np.frombuffer(b"".join(r[:size] for r in raw), np.uint64).reshape(len(raw), -1)
    out: tuple[list, list, list] = [], [], []
    for asking, answering in ((BOTH, BOTH), (ASKS, FOUND)):
        asks, held = np.flatnonzero(side == asking), np.flatnonzero(side == answering)
        if not len(asks) or not len(held):
            continue
        target, step = np.ascontiguousarray(words[held]), max(1, min(BLOCK, CODE_PAIRS // len(held)))
        if asking == ASKS:
            signs = (np.unpackbits(target.view(np.uint8), axis=1, bitorder="little").astype(np.float32) * 2 - 1).T.copy()
        for at in range(0, len(asks), step):
            a = asks[at : at + step]
            if asking == ASKS:
                x = _unit(np.frombuffer(b"".join(raw[i][size:] for i in a), np.float32).reshape(len(a), -1)) @ codes.directions - codes.thresholds
                each, weights = 64 // codes.bits, np.zeros((len(a), target.shape[1] * 64), np.float32)
                for t in range(codes.tables):
                    first = t // each * 64 + t % each * codes.bits
                    weights[:, first : first + codes.bits] = x[:, t * codes.bits : (t + 1) * codes.bits]
                total = np.abs(weights).sum(1, keepdims=True)
                score = (total - weights @ signs) / np.maximum(total, 1e-9)
            else:
                score = _distances(words[a], target)
            if radius is not None and asking == BOTH:
                high = radius
            else:  # the place beyond is for the row itself
                high = np.partition(score, keep, axis=1)[:, keep, None] if len(held) > keep + 1 else np.inf
            rows, cols = np.divmod(np.flatnonzero(score <= high), len(held))
            others = ids[a[rows]] != ids[held[cols]]
            rows, cols = rows[others], cols[others]
            scores = score[rows, cols].astype(float)
            kept = _first(rows, np.lexsort((ids[held[cols]], scores, rows)), keep)
            kept = kept[~codes.met_before(words[a[rows[kept]]] ^ target[cols[kept]], table, flips)]
            out[0].append(ids[a[rows[kept]]])
            out[1].append(ids[held[cols[kept]]])
            out[2].append(np.maximum(scores[kept], 0.0))
    return _lists(*out)


def _near_vectors(block: pa.Table, dim: int, k: int, least: float | None) -> pa.Table:
    """For each row of a block that asks, its ``k`` most similar other vectors there, with minus two minus the similarity as their score."""
    n, side = block.num_rows, block["side"].to_numpy()
    ids, vectors = block["id"].to_numpy(), _unit(np.frombuffer(b"".join(v[-4 * dim :] for v in block["held"].to_pylist()), np.float32).reshape(n, dim))
    rough = vectors.astype(np.float32)
    out: tuple[list, list, list] = [], [], []
    for asking, answering in ((BOTH, BOTH), (ASKS, FOUND), (LOW, HIGH), (HIGH, LOW)):
        asks, held = np.flatnonzero(side == asking), np.flatnonzero(side == answering)
        targets = rough[held].T.copy()
        step = max(1, min(BLOCK, PAIRS // max(1, len(held))))
        for at in range(0, len(asks), step) if len(held) else ():
            a = asks[at : at + step]
            s = rough[a] @ targets
            s[ids[a][:, None] == ids[held][None, :]] = -2
            low = -1.5 if least is None else least - 1e-4
            if s.shape[1] > k and (least is None or np.count_nonzero(s >= low) > 8 * k * len(a)):
                # all that may be among the k best in double precision
                low = np.maximum(low, np.partition(s, s.shape[1] - k, axis=1)[:, -k, None] - 1e-5)
            rows, cols = np.nonzero(s >= low)
            sims = np.empty(len(rows))
            for b in range(0, len(rows), WRITTEN):
                sims[b : b + WRITTEN] = np.einsum("ij,ij->i", vectors[a[rows[b : b + WRITTEN]]], vectors[held[cols[b : b + WRITTEN]]])
            kept = _first(rows, np.lexsort((ids[held[cols]], -sims, rows)), k)
            out[0].append(ids[a[rows[kept]]])
            out[1].append(ids[held[cols[kept]]])
            out[2].append(-2.0 - sims[kept])
    return _lists(*out)


def _reranked(pairs: DataFrame, reps: DataFrame, dim: int) -> DataFrame:
    """(id, other, similarity) of pairs (id, other): each vector's floats come to its pairs once, whatever the number of tables."""

    def similarity(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            a, b = (_unit(np.asarray(batch.column(c).flatten(), np.float32).reshape(batch.num_rows, dim)) for c in ("a", "b"))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("other"), pa.array(np.einsum("ij,ij->i", a, b))], ["id", "other", "similarity"])

    met = pairs.join(reps.select(F.col("id").alias("other"), F.col("embedding").alias("b")), "other").join(reps.select("id", F.col("embedding").alias("a")), "id")
    return met.select("id", "other", "a", "b").mapInArrow(similarity, "id long, other long, similarity double")


def neighbours(vectors: DataFrame, k: int = 5, dim: int = 64, least: float | None = None, queries: str | None = None, flips: int | None = None) -> DataFrame:
    """(id, other, similarity): up to ``k`` most similar other vectors of every vector, or of those that the condition ``queries`` on id names.

    A vector's code, not its floats, is indexed under each of its substrings. Codes that differ in fewer bits than there are substrings share one
    (pigeonhole) and so does, very likely, any pair of similarity AIM_SIMILARITY, or ``least``; with ``flips`` bits of each of a query's substrings
    flipped the radius grows by as many substrings per bit (named queries flip one, and all flip as many as PROBED needs). Of the codes met in a bucket, each once, in the first table that it is met in, those within the
    radius of the least similarity, at most the KEPT nearest, go on, and their floats are compared (the KEPT_ASKED nearest where queries are named).
    Substrings lengthen with the number of vectors, so that a bucket does not. Where the sample shows a bucket to be hot, or more than KEPT codes within
    the radius of one, codes do not tell neighbours apart: there floats are compared whole, in blocks of two parts, so no pair is lost, at a cost
    that grows with the bucket's square.

    Equal vectors are indexed once. Of a group of them the k + 1 lowest ids can be among anyone's best k, ties going to the lower
    id, so no more are carried; the other members have the k lowest as their best. Rows that are null, of another length, not
    finite or all zero take no part; repeated rows count once; an id with several vectors counts with each. With ``least`` only pairs
    of at least that similarity are returned. Empty input gives no rows.
    """
    spark = vectors.sparkSession
    held = comparable(vectors, dim).select("*", F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(1), "embedding").alias("h2"))
    reps = cut_lineage(held.groupBy("h1", "h2").agg(F.min("id").alias("id"), F.first("embedding").alias("embedding")))
    n = reps.count()
    if not n:
        return spark.createDataFrame([], "id long, other long, similarity double")
    part = min(1.0, FIT_ROWS / n)
    sample = reps.where(F.pmod(F.xxhash64("h2"), F.lit(1 << 30)) < int(part * (1 << 30)) + 1).select("embedding").toPandas()["embedding"]
    codes = Codes.learn(_unit(np.stack(sample.to_numpy())) if len(sample) else np.eye(1, dim), n, least)

    members = held.select("h1", "h2", "id").distinct()
    w = F.row_number().over(_window(["h1", "h2"], "id"))
    lowest = members.withColumn("place", w).where(F.col("place") <= k + 1).groupBy("h1", "h2").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    copies = lowest.where(F.size("ids") > 1).select("h1", "h2", F.element_at("ids", 1).alias("rep"), "ids")
    copies = cut_lineage(copies)

    every = queries is None
    if flips is None:
        flips = 0 if least is not None and every else codes.enough(n, 0 if every else 1)
    index_all = every and not flips
    if index_all:
        index, keep = _encode(reps, codes, dim), KEPT
    else:
        # a group is asked for if any of its members is a query
        asked = reps if every else reps.join(members.where(queries).select("h1", "h2").distinct(), ["h1", "h2"], "left_semi")
        spread = asked.count() / n if codes.dense else 0.0
        index, keep = _encode(reps, codes, dim, FOUND, 0, spread).unionByName(_encode(asked, codes, dim, ASKS, flips, spread)), KEPT_ASKED
    radius = None if least is None else codes.radius

    def best(bucket: pa.Table) -> pa.Table:
        return _near_vectors(bucket, dim, k, least) if bucket["block"][0].as_py() >= 0 else _near_codes(bucket, codes, radius, keep if index_all else KEPT_PROBED, flips)

    lists = index.groupBy("place", "block").applyInArrow(best, "id long, other array<long>, score array<double>")
    scored = F.transform(F.arrays_zip("score", "other"), lambda x: F.struct(x["score"].alias("s"), x["other"].alias("o")))
    met = lists.select("id", scored.alias("p")).groupBy("id").agg(F.array_sort(F.flatten(F.collect_list("p"))).alias("p"))
    # a pair may meet in several dense buckets, with the same score, so that its copies stand together
    exact = F.filter("p", lambda x, i: (x["s"] < 0) & ((i == 0) | (F.get("p", i - 1)["o"] != x["o"])))
    chosen = F.concat(F.slice(exact, 1, 2 * k), F.slice(F.filter("p", lambda x: x["s"] >= 0), 1, keep))
    pairs = met.select("id", F.explode(F.array_distinct(F.transform(chosen, lambda x: x["o"]))).alias("other"))
    if index_all:  # the floats of a pair are compared once for both of its vectors
        near = _reranked(pairs.select(F.least("id", "other").alias("id"), F.greatest("id", "other").alias("other")).distinct(), reps, dim)
        near = near.select(F.inline(F.array(F.struct("id", "other", "similarity"), F.struct(F.col("other").alias("id"), F.col("id").alias("other"), "similarity"))))
    else:
        near = _reranked(pairs, reps, dim)
    near = near if least is None else near.where(F.col("similarity") >= least)
    best_of = near.groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("s"), F.col("other").alias("o")))), 1, k).alias("p"))

    # other representatives stand for all of their copies
    groups = copies.select(F.col("rep").alias("other"), F.col("ids").alias("others"))
    opened = best_of.select("id", F.inline("p")).select("id", F.col("s").alias("s"), F.col("o").alias("other")).join(groups, "other", "left")
    opened = opened.select("id", "s", F.explode(F.coalesce("others", F.array("other"))).alias("o"))
    outer = opened.groupBy("id").agg(F.collect_list(F.struct("s", "o")).alias("p"))
    own = copies.select(F.col("rep").alias("id"), "ids")
    both = outer.join(own, "id", "full").select("id", F.coalesce("ids", F.array("id")).alias("ids"), F.coalesce("p", F.array().cast("array<struct<s: double, o: bigint>>")).alias("p"))
    each = both.select(F.explode("ids").alias("id"), "ids", "p")
    mine = F.transform(F.filter("ids", lambda i: i != F.col("id")), lambda i: F.struct(F.lit(-1.0).alias("s"), i.alias("o")))
    ranked = F.slice(F.array_sort(F.array_distinct(F.concat(mine, F.filter("p", lambda x: x["o"] != F.col("id"))))), 1, k)
    result = each.select("id", F.inline(ranked)).select("id", F.col("o").alias("other"), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), -F.col("s"))).alias("similarity"))

    # members beyond the k + 1 lowest of a group of copies
    large = copies.where(F.size("ids") > k).join(members.groupBy("h1", "h2").agg(F.count("*").alias("n")), ["h1", "h2"])
    total = members.agg(F.count("*")).scalar()
    rest = join_unique(members, large.drop("rep"), ["h1", "h2"], "n", total, F.xxhash64("id")).where(F.col("id") > F.array_max("ids"))
    rest = rest.select("id", F.explode(F.slice("ids", 1, k)).alias("other"), F.lit(1.0).alias("similarity"))
    result = result.unionByName(rest)
    return result if every else result.where(queries)


def _window(partition: list[str], order: str):
    from pyspark.sql import Window

    return Window.partitionBy(*partition).orderBy(order)


def similar_pairs(vectors: DataFrame, least: float = 0.85, k: int = 5, dim: int = 64) -> DataFrame:
    """(vec_a, vec_b): pairs of at least ``least`` similarity of which one is among the other's ``k`` most similar; vec_a < vec_b."""
    found = neighbours(vectors, k, dim, least).where(F.col("similarity") >= least)
    return found.select(F.least("id", "other").alias("vec_a"), F.greatest("id", "other").alias("vec_b")).where("vec_a < vec_b").distinct()


def ranked_neighbours(vectors: DataFrame, k: int = 5, dim: int = 64, queries: str | None = None) -> DataFrame:
    """(vec_id, rank, other, similarity): the neighbours of each vector asked for, the most similar first, equal ones by id."""
    from pyspark.sql import Window

    w = Window.partitionBy("id").orderBy(F.col("similarity").desc(), "other")  # at most k rows of an id
    found = neighbours(vectors, k, dim, queries=queries)
    return found.select(F.col("id").alias("vec_id"), F.row_number().over(w).alias("rank"), "other", F.round("similarity", 5).alias("similarity"))
