"""Joins that keep a hot key from making one long task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot when it holds more than one row in HOT_SHARE, so there are fewer than HOT_SHARE hot keys at any size: the bound of the broadcast.
HOT_SHARE = 1000


def join_unique(big: DataFrame, small: DataFrame, keys: list[str], n: str, total: Column, salt: Column, how: str = "inner") -> DataFrame:
    """Join ``big`` with ``small``, which has one row per key and in ``n`` the key's number of rows in ``big``; n is dropped.

    ``total`` is the number of rows in ``big`` (a scalar subquery), ``salt`` a hash of ``big``'s columns that differs within a key.
    Rows of a hot key are spread over as many tasks as it has thousandths of all rows, so that no part of a key holds more; to each goes the key's one row of ``small``.
    """
    parts = F.greatest(F.lit(1), F.ceil(F.col(n) * HOT_SHARE / total)).cast("int")
    sized = small.withColumn("_parts", F.coalesce(parts, F.lit(1)))
    hot_keys = sized.where("_parts > 1").select(*keys, "_parts")
    salted = big.join(F.broadcast(hot_keys), keys, "left").withColumn("_salt", F.coalesce(F.pmod(salt, F.col("_parts")).cast("int"), F.lit(0))).drop("_parts")
    spread = sized.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop(n, "_parts")
    return salted.join(spread, [*keys, "_salt"], how).drop("_salt")
