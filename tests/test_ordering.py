import random

from pyspark.sql import functions as F

from foliant.operators.ordering import numbered
from foliant.operators.skew import join_unique


def test_places(spark):
    rng = random.Random(1)
    rows = [("hot" if i % 3 else f"k{i % 7}", rng.randrange(5), i) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, b int, x int")
    got = {(r.k, r.x): (r.place, r.n) for r in numbered(df, ["k"], F.col("b"), ["x"]).collect()}
    for k in {r[0] for r in rows}:
        own = sorted((b, x) for q, b, x in rows if q == k)
        assert {x: got[k, x] for _, x in own} == {x: (i, len(own)) for i, (_, x) in enumerate(own)}
    assert numbered(df.limit(0), ["k"], F.col("b"), ["x"]).count() == 0


def test_join_of_hot_keys(spark):
    big = spark.createDataFrame([("hot" if i % 3 else f"k{i}", i) for i in range(6000)], "k string, x int")
    small = big.groupBy("k").agg(F.count("*").alias("n")).withColumn("v", F.length("k")).where("k <> 'k0'")
    got = join_unique(big, small, ["k"], "n", big.agg(F.count("*")).scalar(), F.xxhash64("x"))
    assert sorted(got.columns) == ["k", "v", "x"] and got.count() == 5999 and got.where("v <> length(k)").count() == 0
