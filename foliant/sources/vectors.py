"""The vector store: chunks with their vectors, in partitions by a hash of the document, so that a search reads only its documents' partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.session import cut_lineage

BUCKETS = 256


def _bucket(doc_id, buckets: int):
    return F.pmod(F.xxhash64(doc_id), F.lit(buckets)).cast("int")


def append(rows: DataFrame, path: str, buckets: int = BUCKETS) -> bool:
    """Add (doc_id, ...) rows to the store; nothing is written for no rows. One file per partition and task at most, whatever the number of documents."""
    if rows.isEmpty():
        return False
    rows.withColumn("bucket", _bucket(F.col("doc_id"), buckets)).repartition("bucket").write.mode("append").partitionBy("bucket").parquet(path)
    return True


def read(spark: SparkSession, path: str, doc_ids: list[str] | None = None, buckets: int = BUCKETS) -> DataFrame:
    """The rows of the documents named, or all; partitions of other documents are not read. Files that vanish or are damaged are passed over; :func:`skipped_files` names them."""
    df = spark.read.option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").parquet(path)
    if doc_ids is not None:
        places = spark.range(1).select(F.array(*[_bucket(F.lit(d), buckets) for d in doc_ids]) if doc_ids else F.array().cast("array<int>")).first()[0]
        df = df.where(F.col("bucket").isin(*places) & F.col("doc_id").isin(*doc_ids)) if doc_ids else df.limit(0)
    return df.drop("bucket")


def skipped_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, size): the files of the store from which no row can be read. Sizes come from the listing; only footers and one column are read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path).select("path", F.col("length").alias("size"))
    read_from = spark.read.option("mergeSchema", "true").option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").parquet(path).groupBy(F.input_file_name().alias("path")).agg(F.count("doc_id").alias("n"))
    bare = lambda c: F.regexp_replace(c, "^[a-z0-9]+:/+", "/")
    return listed.withColumn("k", bare(F.col("path"))).join(read_from.select(F.url_decode(bare(F.col("path"))).alias("k")), "k", "left_anti").select("path", "size")


def delete(spark: SparkSession, path: str, doc_ids: list[str], buckets: int = BUCKETS) -> None:
    """Take documents out: only their partitions are written anew."""
    if not doc_ids:
        return
    places = {r[0] for r in spark.createDataFrame([(d,) for d in doc_ids], "d string").select(_bucket(F.col("d"), buckets)).collect()}
    left = cut_lineage(spark.read.parquet(path).where(F.col("bucket").isin(*places) & ~F.col("doc_id").isin(*doc_ids)))
    kept = {r[0] for r in left.select("bucket").distinct().collect()}
    left.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    for bucket in places - kept:  # partitions in which nothing is left
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/bucket={bucket}")
        at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
