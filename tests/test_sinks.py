from foliant.streaming import sinks


def test_upserts_of_a_stream(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "table")
    schema = "k string, version int, v string"
    for rows in ([("a", 1, "wait"), ("b", 1, "x")], [("a", 2, "done")], [("a", 1, "late"), ("c", 5, None)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    assert sinks.read(spark, out) is None
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = stream.writeStream.foreachBatch(sinks.upsert_sink(out, ["k"])).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(90)
    want = [("a", 2, "done"), ("b", 1, "x"), ("c", 5, None)]
    assert sorted(map(tuple, sinks.read(spark, out).collect()), key=str) == want
    sinks.upsert_sink(out, ["k"])(spark.createDataFrame([("c", 5, None)], schema), 2)  # the last batch once more
    assert sorted(map(tuple, sinks.read(spark, out).collect()), key=str) == want


def test_a_batch_writes_only_the_buckets_it_touches(spark, tmp_path):
    out, schema = str(tmp_path / "t"), "k string, version int"
    write = sinks.upsert_sink(out, ["k"])
    for epoch, rows in enumerate([[(f"k{i}", 1) for i in range(200)], [("k3", 2)], [], [("k4", 2)]]):
        write(spark.createDataFrame(rows, schema), epoch)
    assert len(list((tmp_path / "t/data/batch=1").glob("bucket=*"))) == 1 and len(list((tmp_path / "t/states").glob("[0-9]*"))) == sinks.KEPT_STATES
    got = {r.k: r.version for r in sinks.read(spark, out).collect()}
    assert len(got) == 200 and [k for k, v in got.items() if v == 2] in (["k3", "k4"], ["k4", "k3"])
