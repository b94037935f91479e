import numpy as np
import pytest

from foliant.llm import neighbours as N
from foliant.session import table

SCHEMA = "vec_id long, embedding array<float>, id string, similarity int, key int"


def frame(spark, vectors, first=0):
    return spark.createDataFrame([(first + i, None if v is None else [None if x is None else float(x) for x in v], "clash", 1, 1) for i, v in enumerate(vectors)], SCHEMA)


def brute(vectors, k=5):
    x = np.asarray(vectors, np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(x @ x.T, 12)
    np.fill_diagonal(s, -2)
    return {i: [(-a, b) for a, b in sorted(zip(-row, range(len(x))))[:k]] for i, row in enumerate(s)}


def clouds(rng, centres, size, spread, dim=16):
    c = rng.standard_normal((centres, dim))
    return np.concatenate([m + spread * rng.standard_normal((size, dim)) for m in c])


def test_small_collection_is_exact(spark):
    v = clouds(np.random.default_rng(1), 12, 9, 0.4)
    want = brute(v)
    got = {}
    for r in N.ranked_neighbours(frame(spark, v), dim=16).collect():
        got.setdefault(r.vec_id, []).append((r.rank, r.other))
    assert {i: [o for _, o in sorted(x)] for i, x in got.items()} == {i: [o for _, o in x] for i, x in want.items()}
    pairs = {tuple(r) for r in N.similar_pairs(frame(spark, v), dim=16).collect()}
    assert pairs == {(min(i, o), max(i, o)) for i, x in want.items() for s, o in x if s >= 0.85}


def test_copies_ties_repeats_and_vectors_that_cannot_be_compared(spark):
    one = [1.0, 2, 0, 0]
    vectors = [one] * 9 + [[1, 2, 0, 0.1], None, [0, 0, 0, 0], [1, 2], [1, None, 0, 0], [float("nan"), 1, 1, 1], [float("inf"), 1, 1, 1], [0, 0, 0, 1], [-2, 1, 0, 0]]
    df = frame(spark, vectors)
    got = {}
    for r in N.neighbours(df.union(df), dim=4).collect():
        got.setdefault(r.id, []).append((round(-r.similarity, 9), r.other))
    ok = [i for i in range(len(vectors)) if i < 10 or i > 15]
    want = {ok[i]: [ok[o] for _, o in x] for i, x in brute([vectors[i] for i in ok]).items()}
    assert {i: [o for _, o in sorted(x)] for i, x in got.items()} == want
    assert {tuple(r) for r in N.similar_pairs(df, dim=4).collect()} == {(min(a, b), max(a, b)) for a in range(10) for b in want[a] if b < 10}
    assert N.neighbours(df.limit(0), dim=4).count() == 0 and N.similar_pairs(df.where("vec_id >= 16"), dim=4).count() == 0


@pytest.mark.parametrize("kind", ["clouds", "hot"])
def test_recall_with_many_buckets(spark, monkeypatch, kind):
    """Buckets of 32 on 3,000 vectors; "hot": a third of them in one tight cloud, whose floats are compared."""
    monkeypatch.setattr(N, "BUCKET", 32)
    rng = np.random.default_rng(2)
    v = clouds(rng, 100, 30, 0.25, 64) if kind == "clouds" else np.concatenate([clouds(rng, 66, 30, 0.25, 64), clouds(rng, 1, 1000, 0.25, 64)])
    codes = N.Codes.learn(N._unit(v), len(v))
    assert codes.bits >= 6 and bool(codes.dense) == (kind == "hot")
    want = {(min(i, o), max(i, o)) for i, x in brute(v).items() for s, o in x if s >= 0.85}
    got = {tuple(r) for r in N.similar_pairs(frame(spark, v)).collect()}
    assert len(got & want) >= 0.98 * len(want) > 0 and got <= {(i, o) for i, o in got if i < o}


def test_codes_are_in_use_at_any_size_and_lose_nothing_on_the_small_table(spark):
    df = table(spark, "/root/testdata/sf0.01", "chunk_vectors")
    rows = {r.id: r.embedding for r in N.comparable(df, 64).collect()}
    ids, x = list(rows), np.array(list(rows.values()))
    for n in (1, 10, len(x)):
        codes = N.Codes.learn(N._unit(x[:n]), n, 0.85)
        assert codes.bits >= 3 and codes.tables >= 2 * (64 // codes.bits) and codes.directions.shape == (64, codes.bits * codes.tables)
    want = {(min(ids[i], ids[o]), max(ids[i], ids[o])) for i, near in brute(x).items() for s, o in near if s >= 0.85}
    got = {tuple(r) for r in N.similar_pairs(df).collect()}
    assert len(got ^ want) <= 0.01 * len(want) and len(want) > 1000  # equal similarities may settle otherwise by rounding


def test_only_codes_are_indexed_where_no_bucket_is_dense(spark):
    df = frame(spark, clouds(np.random.default_rng(4), 40, 20, 0.3, 64))
    reps = N.comparable(df, 64)
    codes = N.Codes.learn(N._unit(np.array([r.embedding for r in reps.collect()])), 800)
    index = N._encode(reps, codes, 64)
    assert not codes.dense and {len(r.held) for r in index.select("held").distinct().collect()} == {16}
    assert index.count() == 800 * codes.tables


def test_pigeonhole_codes_that_differ_in_fewer_bits_than_tables_share_a_substring():
    rng = np.random.default_rng(3)
    x = N._unit(rng.standard_normal((4000, 64)))
    codes = N.Codes.learn(x, 400_000)
    own = codes.buckets(x)
    words = codes.pack(own)
    bits = N._distances(words[:400], words[:400]).astype(int)
    plain = np.unpackbits((own[:400, None, :] ^ own[None, :400, :]).astype(np.uint32)[..., None].view(np.uint8), axis=-1).sum((-1, -2))
    share = (own[:400, None, :] == own[None, :400, :]).any(-1)
    assert (bits == plain).all() and share[bits < codes.tables].all()
    a, b = np.divmod(np.arange(160_000), 400)
    for table_no in (1, 7, codes.tables):
        near = np.array([[bin(int(v)).count("1") for v in row] for row in own[a[:2000], :table_no] ^ own[b[:2000], :table_no]])
        for flips in (0, 1):
            assert (codes.met_before(words[a[:2000]] ^ words[b[:2000]], table_no, flips) == (near <= flips).any(1)).all()


@pytest.mark.parametrize("spread", [0.001, 0.25])
def test_recall_inside_a_hot_cluster(spark, monkeypatch, spread):
    """A third of the vectors in one cluster, at 0.001 nearly equal: dense buckets are compared whole, so only what no table holds together is lost."""
    monkeypatch.setattr(N, "BUCKET", 32)
    rng = np.random.default_rng(2)
    v = np.concatenate([clouds(rng, 66, 30, 0.25, 64), clouds(rng, 1, 1000, spread, 64)])
    x = N._unit(np.asarray(v, np.float32))
    codes = N.Codes.learn(x, len(x))
    own = codes.buckets(x)
    shared = (own[:, None, :] == own[None, :, :]).any(-1)
    # all that share a bucket meet, though in a dense one only parts that did not meet before
    meet = np.zeros(shared.shape, bool)
    rows, t, bucket, block, side = codes.every(own, codes._salts(x, None))
    keys = (t << 50) | (bucket << 30) | (block + 1)
    for key in np.unique(keys):
        for a, b in ((N.BOTH, N.BOTH), (N.LOW, N.HIGH), (N.HIGH, N.LOW)):
            meet[np.ix_(rows[(keys == key) & (side == a)], rows[(keys == key) & (side == b)])] = True
    assert codes.dense and (meet == shared).all()
    best = brute(v)
    want = {(min(i, o), max(i, o)) for i, near in best.items() for s, o in near if s >= 0.85 and i >= 1980}
    got = {tuple(r) for r in N.similar_pairs(frame(spark, v)).collect()}
    assert len(got & want) >= 0.97 * len(want) > 0  # the aim is an average over the sample's five nearest
    asked = {}
    for r in N.ranked_neighbours(frame(spark, v), queries="id % 10 = 0").collect():
        asked.setdefault(r.vec_id, set()).add(r.other)
    hot = [i for i in asked if i >= 1980]
    assert len(asked) == 298 and np.mean([len(asked[i] & {o for _, o in best[i]}) / 5 for i in hot]) >= 0.97
