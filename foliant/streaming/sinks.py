"""Tables that a stream keeps up to date by key: hash buckets, of which a batch writes only those that its keys touch."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators.catalog import current, upsert

#: Buckets of a table, and complete states of it that stay readable.
BUCKETS, KEPT_STATES = 64, 2


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def _states(spark: SparkSession, path: str) -> dict[int, dict[str, int]]:
    """The complete states of a table by batch: in each, the batch that last wrote each bucket. A state's file appears when its buckets are written."""
    fs, at = _files(spark, f"{path}/states")
    if not fs.exists(at):
        return {}
    numbers = sorted(int(s.getPath().getName()) for s in fs.listStatus(at) if s.getPath().getName().isdigit())
    return {n: json.loads(spark.read.text(f"{path}/states/{n}").first()[0]) for n in numbers}


def _rows(spark: SparkSession, path: str, state: dict[str, int]) -> DataFrame | None:
    parts = [f"{path}/data/batch={n}/bucket={b}" for b, n in state.items()]
    return spark.read.option("basePath", f"{path}/data").parquet(*parts).drop("batch", "bucket") if parts else None


def read(spark: SparkSession, path: str) -> DataFrame | None:
    """The last complete state, None before the first."""
    states = _states(spark, path)
    return _rows(spark, path, states[max(states)]) if states else None


def upsert_sink(path: str, keys: list[str], version: str = "version", buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each batch makes a new state of the table from the one before and its own rows, the later of each key.

    Only buckets that hold a key of the batch are read and written; the others stay where they are. A batch that is run again after a failure writes its
    own buckets anew, so that each counts once. No bucket is read while it is written; buckets that none of the last KEPT_STATES states needs are deleted.
    """
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        batch.persist()
        states = {n: s for n, s in _states(spark, path).items() if n < epoch}
        before = states[max(states)] if states else {}
        touched = [str(r[0]) for r in batch.select(bucket).distinct().collect()]  # at most ``buckets`` numbers
        old = _rows(spark, path, {b: n for b, n in before.items() if b in touched})
        new = (upsert(old, batch, keys, version) if old is not None else current(batch, keys, version)).withColumn("bucket", bucket)
        new.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/batch={epoch}")
        batch.unpersist()
        states[epoch] = before | {b: epoch for b in touched}
        fs, at = _files(spark, f"{path}/states/{epoch}")
        out = fs.create(at, True)
        out.write(bytearray(json.dumps(states[epoch]).encode()))
        out.close()
        kept = sorted(states)[-KEPT_STATES:]
        for n in sorted(states)[:-KEPT_STATES]:
            gone = [b for b, m in states[n].items() if not any(states[k].get(b) == m for k in kept)]
            for b in gone:
                fs.delete(_files(spark, f"{path}/data/batch={states[n][b]}/bucket={b}")[1], True)
            fs.delete(_files(spark, f"{path}/states/{n}")[1], True)

    return write
