"""Schemas of the stored tables, and reading rows that were written under an earlier one."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

DOCUMENTS = "id string, user_id string, name string, size bigint, upload_time string"
USERS = "id string, username string, password_hash string, email string, full_name string"
PLACE = "doc_id string, doc_name string, page int, chunk_index int"
CHUNKS = f"text string, metadata struct<{PLACE.replace(' ', ': ').replace(',: ', ', ')}>"
VECTORS = CHUNKS + ", embedding array<float>"
ENTITY = "array<struct<name: string, type: string, description: string>>"
ALERT = "array<struct<type: string, content: string, page: int>>"
QUESTION = "array<struct<id: int, question: string, options: array<string>, correct: string, difficulty: string, page_ref: int>>"
ANALYTICS = f"doc_id string, word_count int, page_count int, read_time_mins int, complexity_score string, summary array<string>, entities {ENTITY}, alerts {ALERT}, suggested_questions array<string>"
QUIZZES = f"doc_id string, questions {QUESTION}"
MESSAGES = "id string, user_id string, doc_id string, role string, content string, confidence int, sources string, timestamp string"


def schema(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)


def conform(df: DataFrame, ddl: str) -> DataFrame:
    """The columns of ``ddl`` in its order and types; columns that the rows lack are null, others go."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema(ddl)])


def read_table(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """A stored table whose files may have fewer columns than today's schema."""
    return conform(spark.read.option("mergeSchema", "true").parquet(path), ddl)


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n): keys that are not unique, null ones too."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where((F.col("n") > 1) | F.expr(" or ".join(f"{k} is null" for k in keys)))


@dataclass(frozen=True)
class Options:
    """Sizes that shape a run; each can be set by a Spark setting foliant.<name>."""

    chunk_size: int = 400
    chunk_overlap: int = 50
    dimensions: int = 64
    vector_buckets: int = 256

    @staticmethod
    def of(spark: SparkSession) -> Options:
        return Options(**{k: int(spark.conf.get(f"foliant.{k}", str(v))) for k, v in Options().__dict__.items()})
